"""Languages where the declaration is hidden or wrong, and the fusion of evidence against a plain version."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from darkslide.llm import langid

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model(spark):
    return langid.fit_text_model(spark.read.parquet(f"{SF}/documents.parquet"))


@pytest.mark.parametrize("wrong", [None, 0.1])
def test_pages_whose_declaration_is_hidden_or_wrong(spark, model, wrong):
    rows = langid.page_rows(spark.read.parquet(f"{SF}/pages.parquet")).where("declared is not null")
    true = {r["id"]: r["declared"] for r in rows.select("id", "declared").collect()}
    r = random.Random(1)
    said = {i: None if wrong is None else r.choice([x for x in model.languages if x != t]) if r.random() < wrong else t for i, t in true.items()}
    other = spark.createDataFrame(list(said.items()), "id long, declared string")
    got = {x["id"]: x["language"] for x in langid.identify(rows.drop("declared").join(other, "id"), model).collect()}
    assert got.keys() == true.keys() and sum(got[i] == t for i, t in true.items()) >= 0.97 * len(true)
    if wrong:
        odd = [i for i, t in true.items() if said[i] != t]
        assert len(odd) > 10 and sum(got[i] == true[i] for i in odd) >= 0.9 * len(odd)


def test_the_stage_drops_what_declares_another_language_and_keeps_the_rest(spark):
    docs = langid.keep_declared(spark.read.parquet(f"{SF}/documents.parquet"))
    rows = [r.asDict() for r in docs.collect()]
    r, languages = random.Random(2), sorted({x["lang"] for x in rows if x["lang"]})
    odd = {x["doc_id"] for x in rows if len((x["text"] or "").split()) >= 20 and r.random() < 0.08}
    swapped = [x | {"lang": r.choice([y for y in languages if y != x["lang"]])} if x["doc_id"] in odd else x for x in rows]
    kept = {x["doc_id"] for x in langid.keep_declared(spark.createDataFrame(swapped, docs.schema)).collect()}
    assert len(odd) > 30 and len(odd & kept) <= 0.05 * len(odd)
    assert sum(x["doc_id"] not in kept for x in rows if x["doc_id"] not in odd) <= 0.01 * len(rows)


def plain(rows, model):
    """The posteriors of (id, text, declared, suffix, domain, host), row by row."""
    k = len(model.languages)
    soft = lambda v: np.exp(v - np.max(v)) / np.exp(v - np.max(v)).sum()
    ll = []
    for _, text, *_ in rows:
        x = langid.bins(text or "", len(model.logs))
        s = model.logs[x].astype(float).sum(axis=0) if len(x) else np.zeros(k)
        ll.append((s - s.max()) * min(1.0, langid.SAYS / max(1, len(x))))
    p = [soft(v) for v in ll]
    sums = {}
    for row, q in zip(rows, p):
        for c, v in zip(("declared", "suffix", "domain", "host"), row[2:]):
            if v is not None:
                sums[c, v] = sums.get((c, v), np.zeros(k)) + q
    everywhere = sum(p) + 1
    out = []
    for row, q, v in zip(rows, p, ll):
        prior = everywhere / everywhere.sum()
        own = dict(zip(("declared", "suffix", "domain", "host"), row[2:]))
        for c in ("suffix", "domain", "host"):
            if own[c] is not None:
                n = np.maximum(sums[c, own[c]] - q, 0)
                prior = (n + langid.WEIGHT * prior) / (n.sum() + langid.WEIGHT)
        trust = np.zeros(k) if own["declared"] is None else np.log((np.maximum(sums["declared", own["declared"]] - q, 0) + 0.5) / (everywhere + 1))
        out.append(soft(v + np.log(prior + 1e-9) + trust))
    return out


def test_fusion_against_a_plain_version(spark, model):
    r = random.Random(3)
    texts = [x[0] for x in spark.read.parquet(f"{SF}/documents.parquet").select("text").limit(60).collect()]
    pick = lambda *a: r.choice([None, *a])
    rows = []
    for i in range(120):
        text = r.choice([None, "", "x", *texts])
        rows.append((i, text if text is None else text[: r.randint(0, 80)], pick("de", "fr", "xx"), pick("de", "org"), pick("a.de", "b.org"), pick("w.a.de", "v.b.org")))
    got = {x["id"]: x for x in langid.identify(spark.createDataFrame(rows, "id long, text string, declared string, suffix string, domain string, host string"), model).collect()}
    for row, want in zip(rows, plain(rows, model)):
        assert math.isclose(got[row[0]]["probability"], want.max(), rel_tol=1e-6), row
        assert want[model.languages.index(got[row[0]]["language"])] >= want.max() - 1e-9


def test_no_language_is_left_out(spark, monkeypatch):
    r = random.Random(6)
    words = [["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(6)) for _ in range(20)] for _ in range(40)]
    rows = [(" ".join(r.choice(w) for _ in range(80)), f"l{k:03}") for k, w in enumerate(words)]
    df = spark.createDataFrame(rows, "text string, lang string")
    monkeypatch.setattr(langid, "WEIGHTS", 40 * 4096)  # as with thousands of languages: fewer bins, all languages
    model = langid.fit_text_model(df)
    assert len(model.languages) == 40 and len(model.logs) == 4096
    ids = df.select(F.monotonically_increasing_id().alias("id"), "text", "lang", *(F.lit(None).cast("string").alias(c) for c in ("declared", "suffix", "domain", "host")))
    got = {x["id"]: x["language"] for x in langid.identify(ids, model).collect()}
    assert all(got[x["id"]] == x["lang"] for x in ids.select("id", "lang").collect())
    monkeypatch.setattr(langid, "LANGUAGES", 39)
    with pytest.raises(ValueError, match="39"):
        langid.fit_text_model(df)
