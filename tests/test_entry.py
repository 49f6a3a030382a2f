"""The driver's entry file, with and without the training-data operators."""

import importlib.util
import os
import shutil
import subprocess
import sys

import __spark_entry__
from darkslide.plans import catalog

REPO = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_queries_and_sql_fit():
    assert set(catalog.queries()) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_without_the_training_data_operators(tmp_path):
    shutil.copytree(os.path.join(REPO, "darkslide"), tmp_path / "darkslide", ignore=lambda d, names: [n for n in names if n in ("llm", "__pycache__")])
    shutil.copy(os.path.join(REPO, "__spark_entry__.py"), tmp_path)
    pipeline = os.path.join(REPO, "corpus_pipeline.py")
    if os.path.exists(pipeline):  # with the pipeline left behind as well as without it
        shutil.copy(pipeline, tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()))"
    for _ in range(2):
        out = subprocess.run([sys.executable, "-B", "-c", code], cwd=tmp_path, env=os.environ | {"PYTHONPATH": str(tmp_path)}, capture_output=True, text=True)
        assert out.returncode == 0, out.stderr
        assert list(map(int, out.stdout.split())) == [len(catalog.queries()), len(catalog.oracle_sql())]
        (tmp_path / "corpus_pipeline.py").unlink(missing_ok=True)


def test_entry(spark):
    rows = __spark_entry__.entry(spark)
    assert rows.columns == ["key", "count", "share"] and rows.count() > 0


def test_all_ten_operators_are_registered_if_they_are_there():
    if importlib.util.find_spec("darkslide.llm") is not None:
        names = __spark_entry__.queries()
        assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names
