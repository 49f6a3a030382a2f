"""Language identification by Bayesian evidence fusion.

Four witnesses speak on a text's language: the text itself, under byte trigrams of each language; the language that
its markup declares; the suffix of its address; and the host that serves it. What a declaration, a suffix or a host
says is learnt by grouped sums of the texts' own posteriors. A host's prior is smoothed towards its domain's, that
towards its suffix's, and that towards all texts'; each text's own share is taken out of its host's and domain's sums.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import tuned, written

#: Trigrams are hashed to so many bins.
BINS = 1 << 16
#: A text's likelihood counts as that of so many trigrams at most, as they don't speak independently.
SAYS = 60.0
#: Texts that a level of the host priors weighs as much as its parent.
WEIGHT = 5.0
#: Weights of a model, at most; with more than 256 languages each has fewer bins. More than the last are no languages.
WEIGHTS, LANGUAGES = 1 << 24, 1 << 10

_MARKUP = r"(?is)<(script|style|noscript|template)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>"
_DECLARED = r"(?is)<html\b[^>]*?\blang\s*=\s*[\"']?\s*([a-z]{2,3})"


class TextModel(NamedTuple):
    """Languages, and the log probability of each trigram bin in each."""

    languages: list[str]
    logs: np.ndarray


def bins(text: str, size: int = BINS) -> np.ndarray:
    """The hashed byte trigrams of a text in lower case, digits as one, runs of white space as one space; in a power of two of bins."""
    b = " ".join(text.lower().split()).encode("utf-8", "replace")
    if not b:
        return np.zeros(0, np.uint16)
    x = np.frombuffer(b" " + b + b" ", np.uint8)
    x = np.where((x >= 48) & (x <= 57), np.uint8(48), x).astype(np.uint32)
    return (((x[:-2] * 961 + x[1:-1]) * 961 + x[2:]) * np.uint32(2654435761) >> np.uint32(33 - size.bit_length())).astype(np.uint16)


def fit_text_model(docs: DataFrame) -> TextModel:
    """Counts trigrams by language over all rows of ``docs`` (text, lang), for all languages that they name.

    Rows of null or empty lang or null text count for nothing, repeated rows count each. Beyond 256 languages trigrams share
    bins, beyond 1,024 it refuses. An empty table gives a model of no languages.
    """
    tuned(docs)
    src = docs.select(F.lower(F.trim(F.col("lang").cast("string"))).alias("lang"), F.col("text").cast("string").alias("text")).where("lang is not null and lang <> '' and text is not null")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                if lang not in sums:
                    sums[lang] = np.zeros(BINS, np.int64)
                x = bins(text)
                if len(x) > 20_000:
                    sums[lang] += np.bincount(x, minlength=BINS)
                else:
                    np.add.at(sums[lang], x, 1)
        for lang, n in sums.items():
            at = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(n[at])], ["lang", "bin", "n"])

    rows = written(src.mapInArrow(run, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")))
    named = rows.select("lang").distinct().limit(LANGUAGES + 1).toArrow().column("lang").to_pylist()
    if len(named) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values")
    languages = sorted(named)
    size = BINS
    while size * len(languages) > WEIGHTS:
        size //= 2
    found = rows.groupBy("lang", F.floor(F.col("bin") / (BINS // size)).cast("int").alias("bin")).agg(F.sum("n").alias("n")).toArrow()  # WEIGHTS at most
    counts = np.zeros((len(languages), size))
    if languages:
        at = pc.index_in(found.column("lang"), value_set=pa.array(languages)).to_numpy()
        counts[at, found.column("bin").to_numpy()] = found.column("n").to_numpy()
    common = counts.sum(axis=0) + 1
    common /= common.sum()
    logs = np.log((counts + 1000 * common) / (counts.sum(axis=1, keepdims=True) + 1000))
    return TextModel(languages, np.ascontiguousarray(logs.T).astype(np.float32))


def _heard(model: TextModel):
    """Each text's log likelihoods, tempered, highest 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k, size = len(model.languages), len(model.logs)
        for b in batches:
            out = np.zeros((b.num_rows, k))
            for i, text in enumerate(b.column("text").to_pylist()):
                if text and len(x := bins(text, size)):
                    ll = model.logs[x].sum(axis=0, dtype=np.float64) if len(x) <= 1 << 18 else np.bincount(x, minlength=size) @ model.logs.astype(np.float64)
                    out[i] = (ll - ll.max()) * min(1.0, SAYS / len(x))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(b.num_rows + 1, dtype=np.int32) * k), pa.array(out.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in b.schema.names if c != "text"), lists], [*(c for c in b.schema.names if c != "text"), "ll"])

    return run


def _softmax(logs: Column) -> Column:
    top = F.array_max(logs)
    e = F.transform(logs, lambda x: F.exp(x - top))
    total = F.aggregate(e, F.lit(0.0), lambda a, x: a + x)
    return F.transform(e, lambda x: x / total)


def identify(rows: DataFrame, model: TextModel) -> DataFrame:
    """Fuses the evidence on ``rows`` (id, text, declared, suffix, domain, host), of which all but id may be null.

    Returns (id, language, probability, text_language, declared) for every row; a witness that is null or new says
    nothing, so that a row without any gets the prior of all texts. Without languages in the model both are null.
    """
    tuned(rows)
    k = len(model.languages)
    kind = rows.schema["id"].dataType.simpleString()
    if not k:
        none = F.lit(None).cast("string")
        return rows.select("id", none.alias("language"), F.lit(None).cast("double").alias("probability"), none.alias("text_language"), "declared")
    src = rows.select("id", *(F.col(c).cast("string").alias(c) for c in ("declared", "suffix", "domain", "host", "text")))
    heard = src.mapInArrow(_heard(model), f"id {kind}, declared string, suffix string, domain string, host string, ll array<double>")
    own = written(heard.withColumn("p", _softmax(F.col("ll"))))
    sums = [F.sum(F.col("p")[i]).alias(f"s{i}") for i in range(k)]
    listed = F.array(*(F.col(f"s{i}") for i in range(k)))
    total = list(own.agg(*sums).first())
    everywhere = np.array([x or 0.0 for x in total]) + 1.0
    prior = F.array(*(F.lit(float(x)) for x in everywhere / everywhere.sum()))
    # declared languages and suffixes are few; hosts and domains may be many and hot, so that their joins read written tables
    by = {c: written(own.where(F.col(c).isNotNull()).groupBy(c).agg(*sums).select(c, listed.alias(f"n_{c}"))) for c in ("declared", "suffix", "domain", "host")}
    out = own
    for c in ("declared", "suffix", "domain", "host"):
        out = out.join(by[c], c, "left")
    empty = F.array(*(F.lit(0.0) for _ in range(k)))

    def under(c: str, parent: Column, leave_out: bool) -> Column:
        n = F.coalesce(F.col(f"n_{c}"), empty)
        n = F.when(F.col(f"n_{c}").isNotNull(), F.zip_with(n, "p", lambda a, b: F.greatest(a - b, F.lit(0.0)))).otherwise(n) if leave_out else n
        size = F.aggregate(n, F.lit(0.0), lambda a, x: a + x)
        return F.zip_with(n, parent, lambda a, b: (a + WEIGHT * b) / (size + WEIGHT))

    out = out.withColumn("prior", under("suffix", prior, True)).withColumn("prior", under("domain", F.col("prior"), True)).withColumn("prior", under("host", F.col("prior"), True))
    # how often texts of a language carry this declaration, against all texts: n(declared, language) / n(language), smoothed
    trust = F.when(F.col("n_declared").isNotNull(), F.zip_with(F.zip_with("n_declared", "p", lambda a, b: F.greatest(a - b, F.lit(0.0))), F.array(*(F.lit(float(x)) for x in everywhere)), lambda a, n: F.ln((a + 0.5) / (n + 1.0)))).otherwise(empty)
    post = _softmax(F.zip_with(F.zip_with("ll", F.transform("prior", lambda x: F.ln(x + 1e-9)), lambda a, b: a + b), trust, lambda a, b: a + b))
    names = F.array(*(F.lit(x) for x in model.languages))
    at = lambda a: F.element_at(names, F.array_position(a, F.array_max(a)).cast("int"))
    return out.withColumn("post", post).select("id", at(F.col("post")).alias("language"), F.array_max("post").alias("probability"), F.when(F.array_min("ll") < 0, at(F.col("p"))).alias("text_language"), "declared")


def page_rows(pages: DataFrame) -> DataFrame:
    """What pages (page_id, url, html) bring as evidence."""
    host = F.lower(F.regexp_extract(F.col("url").cast("string"), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    host = F.when(host != "", host)
    html = F.col("html").cast("string")
    declared = F.lower(F.regexp_extract(html, _DECLARED, 1))
    return pages.select(
        F.col("page_id").cast("long").alias("id"), F.regexp_replace(html, _MARKUP, " ").alias("text"), F.when(declared != "", declared).alias("declared"),
        F.regexp_extract(host, r"([^.]+)\.?$", 1).alias("suffix"), F.regexp_extract(host, r"([^.]+\.[^.]+|[^.]+)\.?$", 1).alias("domain"), host.alias("host"),
    )


def document_rows(docs: DataFrame) -> DataFrame:
    """What documents (doc_id, text, lang, source) bring as evidence: the source is their host."""
    none = F.lit(None).cast("string")
    declared = F.lower(F.trim(F.col("lang").cast("string")))
    return docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"), F.when(declared != "", declared).alias("declared"), none.alias("suffix"), none.alias("domain"), F.col("source").cast("string").alias("host"))


def keep_declared(docs: DataFrame, sure: float = 0.999999) -> DataFrame:
    """``docs`` without those that are in another language than they declare, with a probability of ``sure`` or more.

    Documents that declare nothing stay, as do those of a null doc_id and those whose evidence doesn't decide.
    """
    found = identify(document_rows(docs), fit_text_model(docs))
    wrong = found.where((F.col("language") != F.col("declared")) & (F.col("probability") >= sure)).select(F.col("id").alias("_wrong")).distinct()
    return docs.join(wrong, docs["doc_id"] == wrong["_wrong"], "left_anti")
