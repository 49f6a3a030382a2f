"""Contamination against all pairs of texts and items, and benchmarks that take several shards."""

import random
from collections import Counter

import pandas as pd

from darkslide.llm import decontam

SF = "/root/testdata/sf0.001"


def holds(item, text, limits=decontam.Thresholds()):
    """Whether some stretch of the text, a quarter longer than the item, has it by the rule; every stretch is tried."""
    need = limits.lcs_with_answer * len(item)
    if (Counter(item) & Counter(text)).total() < need:
        return False
    size, tail = len(item) + len(item) // 4, item[-min(limits.answer_words, len(item)) :]
    for lo in range(max(1, len(text) - size + 1)):
        part = text[lo : lo + size]
        got = decontam.lcs(item, part)
        if got >= limits.lcs * len(item) or (got >= need and decontam.lcs(tail, part) >= limits.answer * len(tail)):
            return True
    return False


def test_all_pairs(spark):
    docs, bench = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    r = random.Random(4)
    items = {i: decontam.words_of(t) for i, t in zip(bench.item_id, bench.text)}
    for k, n in enumerate((65, 80, 129, 500)):  # longer ones than the table has
        items[9000 + k] = [f"q{r.randrange(4 * n)}" for _ in range(n)]
    texts = dict(zip(docs.doc_id.tolist(), docs.text))
    for k, (i, w) in enumerate([*items.items()] * 2):  # some words dropped, some replaced, some added
        said = [y for x in w if (p := r.random()) > 0.12 for y in ([x] if p < 0.9 else ["new", x] if p < 0.95 else ["other"])]
        host = texts[docs.doc_id.iloc[k % len(docs)]].split()[:300]
        at = r.randrange(len(host) + 1)
        texts[100_000 + k] = " ".join([*host[:at], *said, *host[at:]])
    words = {i: decontam.words_of(t) for i, t in texts.items()}
    want = {(d, i) for d, text in words.items() for i, item in items.items() if item and holds(item, text)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {(x["doc_id"], x["item_id"]) for x in decontam.find_contamination(df, spark.createDataFrame([(int(i), " ".join(w)) for i, w in items.items()], "item_id long, text string")).collect()}
    assert len(want) > len(items) and len(want & got) >= 0.95 * len(want)
    assert all(decontam.lcs(items[i], words[d]) >= 0.6 * len(items[i]) for d, i in got)


def test_shards_find_the_same(spark, monkeypatch):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    of = lambda: {(x["doc_id"], x["item_id"]) for x in decontam.find_contamination(docs, bench).collect()}
    rows = [(int(r["item_id"]), r["text"]) for r in bench.orderBy("item_id").collect()]
    whole = of()
    monkeypatch.setattr(decontam, "SHARD_WORDS", len({w for _, t in rows for w in decontam.words_of(t)}) * 2 // 3)
    parts = list(decontam.shards(rows))
    assert len(parts) > 1 and [i for p in parts for i, _ in p] == [i for i, t in rows if decontam.words_of(t)]
    assert whole and of() == whole
    monkeypatch.setattr(decontam, "SHARD_SEGMENTS", 1)
    assert all(len(p) == 1 for p in decontam.shards([(1, "a b"), (2, "c " * 500), (3, "")]))
