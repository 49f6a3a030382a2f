"""Training-data operators: packing, filtering, deduplication, scoring and formatting of text corpora."""
