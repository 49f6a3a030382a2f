"""Toxicity of disguised text: a noisy channel is undone, then the restored words are scored.

A writer who hides a word puts digits for letters, spaces it out or repeats letters. Every token that may be such a
word becomes a lattice: for each character the letters it may stand for, nothing for a separator, one or two letters
for a run. Viterbi decoding under a character trigram model of the corpus finds the likeliest word of the lattice.
A logistic regression over words and word beginnings, fitted on labelled rows, scores what was restored.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import filtered, forget, tuned, written

#: Labelled rows that the classifier is fitted on, at most.
FIT_ROWS = 40_000
#: Standard errors by which a word's share in toxic and other rows must differ for the classifier to weigh it.
APART = 4.0
#: Distinct tokens whose weights a worker remembers; then it starts anew.
REMEMBERED = 500_000

#: What a character may stand for.
STANDS_FOR = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "¡": "i",
}
SEPARATORS = ".-_*~'·/\\,"
#: Breaks of a spelt run: anywhere between its characters.
SPELT = "anywhere"
#: What it costs to read a doubled letter once: about as much as a letter less gains.
ONCE = -2.5
#: What it costs to end a word within a spelt run.
BREAK = -4.0
#: The costs with which a spelt run is read to be scored: no single one finds all words.
BREAKS = (BREAK, -1.0, -2.0, -3.0, -5.0, -6.0)

_CLASSES = "abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþ"
_SUSPECT = re.compile(r"[^\W\d_].*[0-9@$!|+€£(¡]|[0-9@$!|+€£(¡].*[^\W\d_]|([^\W\d_])\1|[^\W\d_][.\-_*~'·/\\,]+[^\W\d_]")
# White space as Python splits at it; letters of _CLASSES, and each of them twice.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_LATIN = rf"\A[{_CLASSES}]+\z"
_TWICE = "|".join(c * 2 for c in _CLASSES)
#: Punctuation at a token's ends that says nothing.
_EDGE = ".,;:?\"'()[]-*"
_RUN = re.compile(r"(.)\1+", re.S)
_THRICE = re.compile(r"([^\W\d_])\1\1")
_SINGLES = re.compile(r"(?<!\S)(?:[^\W_][.,!?]|\S)(?!\S)(?:\s+(?:[^\W_][.,!?]|\S)(?!\S))+")
_EDGES = re.compile(r"^[^\w@$€£]+|[^\w]+$")
_PARTS = re.compile(r"[^\w]+")


class CharModel(NamedTuple):
    """Trigram counts over 64 character classes; 0 is what stands between words, 63 any other character."""

    three: np.ndarray

    @classmethod
    def of(cls, counts: np.ndarray) -> "CharModel":
        three = counts.reshape(64, 64, 64).astype(np.float64)
        two, one = three.sum(axis=0), three.sum(axis=(0, 1))
        p1 = (one + 1) / (one.sum() + 64)
        p2 = (two + 8 * p1) / (two.sum(axis=1, keepdims=True) + 8)
        p3 = (three + 8 * p2) / (three.sum(axis=2, keepdims=True) + 8)
        return cls(np.log(p3).astype(np.float32))


def _class_table() -> np.ndarray:
    """The class of each character of the first plane; those beyond it are other characters."""
    table = np.array([63 * chr(i).isalnum() for i in range(1 << 16)], np.uint8)
    for i, c in enumerate(_CLASSES):
        table[ord(c)] = i + 1
    return table


_TABLE = _class_table()
_OF = {c: i + 1 for i, c in enumerate(_CLASSES)}


def classes(text: str) -> np.ndarray:
    """The class of each character of a lower-case text."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    return np.where(code < 1 << 16, _TABLE[np.minimum(code, 0xFFFF)], 63)


_latest: tuple[np.ndarray | None, list[float]] = (None, [])


def _flat(model: CharModel) -> list[float]:
    """The model's logarithms as a list, by (a * 64 + b) * 64 + c; a worker keeps that of the latest model."""
    global _latest
    if _latest[0] is not model.three:
        _latest = (model.three, model.three.reshape(-1).tolist())
    return _latest[1]


#: A path through a lattice: what came before, and the letters that its last step adds.
Path = tuple["Path | None", str]


def _text(path: Path | None) -> str:
    out: list[str] = []
    while path:
        path, said = path
        out.append(said)
    return "".join(reversed(out))


def decode(token: str, model: CharModel, breaks: str = "", cost: float = BREAK) -> str:
    """The likeliest words that ``token`` hides: one, or several with a space between where ``breaks`` has what may stand for it.

    A separator in ``breaks`` may be a space; if that is ``SPELT``, so may any place between two characters. The time
    is in proportion to the token's length, and no token is cut.
    """
    logs = _flat(model)
    best: dict[int, tuple[float, Path | None]] = {0: (0.0, None)}  # by the classes of the last two letters
    anywhere = breaks == SPELT
    for m in re.finditer(r"(.)\1*", token, re.S):
        c, run = m[1], len(m[0])
        if c in SEPARATORS:
            if c in breaks:
                best = _broken(best, logs)
            continue
        letters = STANDS_FOR.get(c, c if c.isalpha() else "")
        if not letters:
            continue
        if anywhere:
            best = _broken(best, logs, cost)
        once, chance = (0.0, ONCE, -0.7)[min(run, 3) - 1], -math.log(len(letters))
        paths: dict[int, tuple[float, Path | None]] = {}
        for state, (score, path) in best.items():
            b = state & 63
            for letter in letters:
                k = int(classes(letter)[0]) if letter not in _OF else _OF[letter]
                one = score + logs[state << 6 | k] + chance
                ways = [(b << 6 | k, one + once, letter)]
                if run > 1:
                    ways.append((k << 6 | k, one + logs[(b << 6 | k) << 6 | k] - (0.0 if run == 2 else 0.7), letter * 2))
                    if anywhere:  # the same letter ends a word and begins the next
                        ways.append((k, one + logs[(b << 6 | k) << 6] + logs[k << 12 | 0 << 6 | k] + cost, f"{letter} {letter}"))
                for to, s, said in ways:
                    if to not in paths or s > paths[to][0]:
                        paths[to] = (s, (path, said))
        best = paths
    return _text(max(((score + logs[state << 6], path) for state, (score, path) in best.items()), key=lambda x: x[0])[1]).strip()


def _broken(best: dict[int, tuple[float, Path | None]], logs: list[float], cost: float = 0.0) -> dict[int, tuple[float, Path | None]]:
    """The paths, and each with its word ended."""
    out = dict(best)
    for state, (score, path) in best.items():
        b = state & 63
        if b and (s := score + logs[state << 6] + cost) > out.get(b << 6, (-math.inf, None))[0]:
            out[b << 6] = (s, (path, " "))
    return out


def _collapsed(word: str) -> str:
    return _RUN.sub(r"\1", word)


class Reach:
    """Which words with doubled letters may turn into one of some features: those that are like it without doubles."""

    def __init__(self, features: Iterable[str]):
        whole, self.starts = set(), set()
        for f in features:
            (self.starts if f.endswith("*") else whole).add(_collapsed(f.rstrip("*")))
        self.whole, self.sizes = frozenset(whole), sorted({len(s) for s in self.starts})

    def __contains__(self, word: str) -> bool:
        plain = _collapsed(word)
        return plain in self.whole or any(plain[:k] in self.starts for k in self.sizes)


def words_of(token: str, model: CharModel, reach: Reach | None = None) -> list[str]:
    """What a lower-case token says: its word, or the words it hides; then what it shows, where that is words too.

    With ``reach``, letters that stand twice are looked into only where a word of interest can come of it.
    """
    if token.isalpha() and (not _SUSPECT.search(token) or (reach is not None and not _THRICE.search(token) and token not in reach)):
        return [token]
    core = _EDGES.sub("", token)
    if not core:
        return []
    if _SUSPECT.search(core):
        parts = [p for p in _PARTS.split(core) if p]
        plain = [core] if core.isalpha() and not _THRICE.search(core) else [p for p in parts if len(p) > 2 or (p.isalpha() and len(parts) == 2)]
        joined = [decode(core, model)] if len(parts) > 1 else []
        return list(dict.fromkeys([*decode(core, model, SEPARATORS).split(), *(w for w in joined if w), *plain]))
    return [p for p in _PARTS.split(core) if p]


def _spelt(text: str) -> Iterator[tuple[int, int, str]]:
    """Where two and more single characters stand in a row, a letter among them: the place, and the characters without the punctuation after them."""
    for m in _SINGLES.finditer(text):
        run = "".join(t[0] for t in m[0].split())
        if any(map(str.isalpha, run)):
            yield m.start(), m.end(), run


def spaced(text: str, model: CharModel) -> list[str]:
    """The words that a lower-case text's runs of single characters spell out; of each run as several costs of a break read it, and as one word."""
    return [w for _, _, run in _spelt(text) for w in dict.fromkeys([*(w for c in BREAKS for w in decode(run, model, SPELT, c).split()), decode(run, model)]) if w]


def restore(text: str | None, model: CharModel) -> str:
    """The text with disguised words undone, in lower case, words joined by a space."""
    said = (text or "").lower()
    out: list[str] = []
    at = 0
    for lo, hi, run in [*_spelt(said), (len(said), len(said), "")]:
        for t in said[at:lo].split():
            words = words_of(t, model)
            out += words[:1] if t.isalpha() else words
        out += decode(run, model, SPELT).split()
        at = hi
    return " ".join(out)


def features_of(word: str) -> tuple[str, ...]:
    """A word and its beginnings."""
    return (word, *(f"{word[:k]}*" for k in (4, 5) if len(word) > k))


def _doc_features(text: str | None, model: CharModel, seen: dict[str, tuple[str, ...]], known: dict[str, float] | dict[str, int] | None = None, reach: Reach | None = None) -> set[str]:
    """The features of a text, of those ``known`` if given, with their ``reach``. ``seen`` remembers what each token gave."""
    said, out = (text or "").lower(), set()
    for t in set(said.split()):
        if (f := seen.get(t)) is None:
            if len(seen) > REMEMBERED:
                seen.clear()
            f = seen[t] = tuple(x for w in words_of(t, model, reach) for x in features_of(w) if known is None or x in known)
        if f:
            out.update(f)
    out.update(x for w in spaced(said, model) for x in features_of(w) if known is None or x in known)
    return out


class ToxicityModel(NamedTuple):
    chars: CharModel
    weights: dict[str, float]
    bias: float


def char_counts(docs: DataFrame) -> np.ndarray:
    """Trigram counts of classes over all texts; each task sends 64 cubed sums at most."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(64**3, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                c = classes(f"  {(t or '').lower()} ").astype(np.int32)
                c = c[np.append(True, (c[1:] != 0) | (c[:-1] != 0))] if len(c) else c  # runs of what stands between words count once
                total += np.bincount((np.append(0, c[:-2]) * 64 + c[:-1]) * 64 + c[1:], minlength=64**3) if len(c) > 2000 else 0
                if 1 < len(c) <= 2000:
                    code, n = np.unique((np.append(0, c[:-2]) * 64 + c[:-1]) * 64 + c[1:], return_counts=True)
                    total[code] += n
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["code", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(run, "code int, n long").groupBy("code").agg(F.sum("n").alias("n"))
    out = np.zeros(64**3, np.int64)
    for code, n in rows.collect():
        out[code] = n
    return out


def _fit(row: np.ndarray, col: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, float]:
    """Logistic regression by accelerated gradient steps, with a little shrinkage; each row's features as pairs (row, column)."""
    w, bias, m, v = np.zeros(k), math.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5)), np.zeros(k + 1), np.zeros(k + 1)
    for step in range(1, 401):
        p = 1 / (1 + np.exp(-(bias + np.bincount(row, weights=w[col], minlength=len(y)))))
        g = np.append(np.bincount(col, weights=(p - y)[row], minlength=k) / len(y) + 1e-5 * w, (p - y).mean())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        d = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-9)
        w, bias = w - d[:-1], bias - d[-1]
        if np.abs(d).max() < 1e-4:
            break
    return w, float(bias)


def fit_toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, apart: float = APART) -> ToxicityModel:
    """Fits on at most ``fit_rows`` rows of ``labels`` (doc_id, toxic), the first by a hash of doc_id.

    Labels other than 0 and 1 and null ids count for nothing; of repeated labels the larger counts, of rows of the same
    doc_id the text with the least hash. The character model counts all texts. Words and beginnings whose shares differ by
    ``apart`` standard errors are weighed, however many. Null texts are empty. Without labels of both kinds every score
    is 0 or 1 at the share of positives, 0 if none.
    """
    spark = tuned(docs)
    chars = CharModel.of(char_counts(docs))
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("toxic").cast("int").alias("_toxic"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(fit_rows)
    sample = spark.createDataFrame(sample.toPandas(), "_id long, _toxic int")  # bounded by fit_rows
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).join(F.broadcast(sample), "_id")
    rows = written(texts.groupBy("_id", "_toxic").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("text", "_toxic"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: tuple[Counter, Counter] = (Counter(), Counter())
        seen: dict[str, tuple] = {}

        def sums() -> pa.RecordBatch:
            keys = list(by[0].keys() | by[1].keys())
            out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([by[1][k] for k in keys], pa.int64()), pa.array([by[0][k] for k in keys], pa.int64())], ["feature", "pos", "neg"])
            by[0].clear()
            by[1].clear()
            return out

        for b in batches:
            for text, y in zip(b.column("text").to_pylist(), b.column("_toxic").to_pylist()):
                by[y].update(_doc_features(text, chars, seen))
            if len(by[0]) > 1_000_000:
                yield sums()
        yield sums()

    n = dict(rows.groupBy("_toxic").count().collect())
    pos, neg = max(1, n.get(1, 0)), max(1, n.get(0, 0))
    df = rows.mapInArrow(count, "feature string, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg"))
    gap = F.col("pos") / pos - F.col("neg") / neg
    spread = F.sqrt((F.col("pos") + F.col("neg") + 1) / (pos + neg) * (1 / pos + 1 / neg))
    found = df.where(F.col("pos") + F.col("neg") >= 2).where(F.abs(gap) / spread >= apart).select("feature").toPandas()["feature"]
    index = {f: i for i, f in enumerate(sorted(found))}

    def sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = _Finder(chars, index)
        for b in batches:
            own = [sorted(index[f] for f in features) for features in find(b.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.list_(pa.int32())), b.column("_toxic")], ["f", "y"])

    fitted = rows.mapInArrow(sparse, "f array<int>, y int").toArrow().combine_chunks()  # fit_rows at most
    forget(rows)
    y = fitted.column("y").to_numpy().astype(np.float64)
    if not y.any():
        return ToxicityModel(chars, {}, -50.0)
    if y.all():
        return ToxicityModel(chars, {}, 50.0)
    own = fitted.column("f").combine_chunks()
    w, bias = _fit(np.repeat(np.arange(len(y)), np.diff(own.offsets.to_numpy())), own.flatten().to_numpy(), y, len(index))
    return ToxicityModel(chars, {f: float(w[i]) for f, i in index.items()}, bias)


class _Finder:
    """The known features of many texts at once: the same as ``_doc_features`` finds in each.

    Distinct tokens are numbered by Arrow. Words of Latin letters, none twice in a row, are looked up there; only other
    tokens, and words that have a feature, are read one by one.
    """

    def __init__(self, chars: CharModel, known: dict[str, float]):
        self.chars, self.known, self.reach = chars, known, Reach(known)
        self.seen: dict[str, tuple[str, ...]] = {}
        self.whole = pa.array([f for f in known if not f.endswith("*")], pa.string())
        self.starts = {k: pa.array([f[:-1] for f in known if f.endswith("*") and len(f) == k + 1], pa.string()) for k in (4, 5)}

    def _features(self, token: str) -> tuple[str, ...]:
        if (f := self.seen.get(token)) is None:
            if len(self.seen) > REMEMBERED:
                self.seen.clear()
            f = self.seen[token] = tuple(x for w in words_of(token, self.chars, self.reach) for x in features_of(w) if x in self.known)
        return f

    def __call__(self, texts: list[str | None]) -> list[set[str]]:
        said = [(t or "").lower() for t in texts]
        out: list[set[str]] = [set() for _ in said]
        split = pc.split_pattern_regex(pa.array(said, pa.string()), f"[{_WHITE}]+")
        coded = split.flatten().dictionary_encode()
        code, tokens, ends = coded.indices.to_numpy(), coded.dictionary, split.offsets.to_numpy()
        if not len(code):
            return out
        where = lambda x: x.to_numpy(zero_copy_only=False).astype(bool)
        core = pc.utf8_trim(tokens, characters=_EDGE)
        plain = where(pc.match_substring_regex(core, _LATIN)) & ~where(pc.match_substring_regex(core, _TWICE))
        size, has = pc.utf8_length(core).to_numpy(), where(pc.is_in(core, value_set=self.whole))
        for k, starts in self.starts.items():
            has |= (size > k) & where(pc.is_in(pc.utf8_slice_codeunits(core, 0, k), value_set=starts))
        at = np.flatnonzero(has | ~plain)
        found = {}
        for i, token in zip(at.tolist(), tokens.take(pa.array(at)).to_pylist()):
            if f := self._features(token):
                found[i] = f
        has = np.zeros(len(tokens), bool)
        has[list(found)] = True
        hit = np.flatnonzero(has[code])
        for text, i in zip((np.searchsorted(ends, hit, side="right") - 1).tolist(), code[hit].tolist()):
            out[text].update(found[i])
        # texts where two single characters stand in a row
        single = where(pc.match_substring_regex(tokens, r"\A(?:[^\s]|[\pL\pN][.,!?])\z"))[code]
        row = np.flatnonzero(single[1:] & single[:-1])
        first = np.searchsorted(ends, row, side="right") - 1
        for text in np.unique(first[row + 1 < ends[first + 1]]).tolist():
            out[text].update(x for w in spaced(said[text], self.chars) for x in features_of(w) if x in self.known)
        return out


def _scorer(model: ToxicityModel):
    """A task's function from texts to scores."""
    chars, weights, bias = model

    def make():
        find = _Finder(chars, weights)

        def scores(texts: list[str | None]) -> list[float]:
            z = (bias + sum(weights[x] for x in sorted(f)) for f in find(texts))
            return [1 / (1 + math.exp(-max(-60.0, min(60.0, x)))) for x in z]

        return scores

    return make


def score_toxicity(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, score) for every row, over its whole text; a null text counts as empty, a null doc_id stays null."""
    tuned(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    make = _scorer(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = make()
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(scores(b.column("text").to_pylist()), pa.float64())], ["doc_id", "score"])

    return src.mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: ToxicityModel, at: float = 0.5) -> DataFrame:
    """``docs`` without those that score ``at`` or more: all columns as they are, null and empty texts by their score, repeated rows alike."""
    make = _scorer(model)

    def judge():
        scores = make()
        return lambda texts: [s < at for s in scores(texts)]

    return filtered(docs, judge)
