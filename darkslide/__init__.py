"""Analytics over photo metadata and text corpora on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel by value: a cluster needs no copy of this package on its machines.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
