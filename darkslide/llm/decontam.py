"""Benchmark decontamination by latent semantic retrieval.

Documents are cut into passages of words, weighed by TF-IDF over the words of the benchmark. A randomised SVD, whose
products with the passage matrix are summed over all tasks, gives the latent directions. Passages and benchmark items
meet in that space by their cosine; where it suffices, or where they share words in a row, the longest common subsequence of their words decides, with a
check that the item's last words, its answer, are there too. Every pass streams over the documents: nothing but
sums over the benchmark's words goes to the driver, and no document is shuffled. The benchmark is taken in shards of a
bounded number of words and segments, one after the other, so that what goes to each task is as large for any benchmark.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tuned, written

#: Words of a block; passages are 2 to 5 blocks in a row, one more than their item needs.
BLOCK = 16
#: Words of an item that are searched for at once; longer items are searched for in segments.
SEGMENT = 64
#: Distinct words and segments of a shard of the benchmark, at most; an item that has more alone is a shard.
SHARD_WORDS, SHARD_SEGMENTS = 60_000, 8_192
#: Blocks that are searched at once.
SEARCHED = 1024
#: Latent directions.
RANK = 128
#: What the benchmark's items, which are passages of the matrix as well, weigh together, against all other passages.
ITEMS_WEIGH = 0.3
#: A word that stands as near as this before counts once.
REPEAT = 4
#: Words in a row that a text and an item share, and how many such places make a candidate beside the cosine.
IN_A_ROW, PLACES = 3, 2


# Fixed value: what is no part of a word at its ends.
ENDS = ".,;:!?\"'()[]{}#*%$&|-"


class Thresholds(NamedTuple):
    cosine: float = 0.60
    lcs: float = 0.8  # of the item's words in order
    lcs_with_answer: float = 0.6  # if the answer is there as well
    answer_words: int = 6
    answer: float = 0.65


def words_of(text: str | None) -> list[str]:
    """Words in lower case without punctuation at their ends."""
    return [w for w in (t.strip(ENDS) for t in (text or "").lower().split()) if w]


def numbers(texts: pa.Array, words: pa.Array) -> list[np.ndarray]:
    """Each text's words as numbers, 0 for words that the benchmark lacks; all in Arrow's own string functions."""
    split = pc.utf8_split_whitespace(pc.utf8_lower(texts.fill_null("")))
    tokens = pc.utf8_trim(split.flatten(), characters=ENDS)
    found = pc.index_in(tokens, value_set=words).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) + 1
    said = pc.binary_length(tokens).to_numpy(zero_copy_only=False) > 0
    ends = np.append(0, np.cumsum(said))[split.offsets.to_numpy() - split.offsets[0].as_py()]
    found = found[said]
    return [found[a:b] for a, b in zip(ends[:-1], ends[1:])]


def encoded(docs: DataFrame, words: list[str]) -> DataFrame:
    """(doc_id, ids): each text's words as numbers, little-endian; read once here, then by each pass."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, kind = pa.array(words, pa.string()), _kind(words)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([x.astype(kind).tobytes() for x in numbers(b.column("text"), known)], pa.binary())], ["doc_id", "ids"])

    return written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, ids binary"))


def _kind(words: list[str]) -> str:
    return "<u2" if len(words) < 65535 else "<u4"


def _once(x: np.ndarray) -> np.ndarray:
    """The numbers, with those that repeat a near one as unknown."""
    again = np.zeros(len(x), bool)
    for lag in range(1, REPEAT + 1):
        again[lag:] |= x[lag:] == x[:-lag]
    return np.where(again, 0, x)


def _passes(texts: DataFrame, words: list[str], table: np.ndarray | None) -> np.ndarray:
    """Sums over all passages of 32 words of ``encoded`` texts. Without a ``table``: the passages that have each word, and at 0 all passages.

    With one (words x directions, last the squared weight): the transposed passage matrix times its product with the
    directions, each passage scaled to length 1; without the words' own weights.
    """
    n, size, kind = len(words) + 1, 2 * BLOCK, _kind(words)
    k = 1 if table is None else table.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, rows = np.zeros((n, k)), np.empty((size * 256, k + 1), np.float32)
        for b in batches:
            docs_ = [np.frombuffer(x, kind).astype(np.int64) for x in b.column("ids").to_pylist()]
            x = np.concatenate([np.append(d, np.zeros(-len(d) % size, np.int64)) for d in docs_] or [np.zeros(0, np.int64)])
            x = _once(x)
            for lo in range(0, len(x), size * 256):
                cut = x[lo : lo + size * 256]
                passage = np.arange(len(cut)) // size
                if table is None:
                    pair = np.unique(passage * n + cut)
                    out[:, 0] += np.bincount(pair % n, minlength=n)
                    out[0, 0] += passage[-1] + 1 - (pair % n == 0).sum()
                    continue
                y = np.take(table, cut, axis=0, out=rows[: len(cut)], mode="clip").reshape(-1, size, k + 1).sum(axis=1)
                y = y[:, :-1] / y[:, -1:]
                own, at = np.unique(cut, return_inverse=True)
                has = np.zeros((len(own), len(y)), np.float32)  # the chunk's part of the transposed matrix
                np.add.at(has, (at, passage), np.float32(1))
                out[own] += has @ y
        at = np.flatnonzero(out.any(axis=1))
        sums = pa.FixedSizeListArray.from_arrays(pa.array(out[at].reshape(-1)), k) if len(at) else pa.array([], pa.list_(pa.float64(), k))
        yield pa.RecordBatch.from_arrays([pa.array(at), sums.cast(pa.list_(pa.float64()))], ["word", "s"])

    total = np.zeros((n, k))
    for r in texts.select("ids").mapInArrow(run, "word long, s array<double>").groupBy("word").agg(*(F.sum(F.col("s")[i]) for i in range(k))).collect():  # a row for each word of the benchmark
        total[r[0]] = r[1:]
    return total


class Latent(NamedTuple):
    words: list[str]
    idf: np.ndarray
    unknown: float
    directions: np.ndarray

    def table(self) -> np.ndarray:
        """A word's share in the latent directions, and its squared weight."""
        out = np.column_stack([self.directions * self.idf[:, None], self.idf**2]).astype(np.float32)
        out[0] = 0
        out[0, -1] = self.unknown**2
        return out


def fit_latent(texts: DataFrame, words: list[str], items: list[list[str]], rank: int = RANK, seed: int = 9) -> Latent:
    """Inverse passage frequencies and the leading latent directions over all passages of ``encoded`` texts and the items."""
    n, index = len(words) + 1, {w: i + 1 for i, w in enumerate(words)}
    df = _passes(texts, words, None)[:, 0]
    total = float(df[0])
    idf = np.log((total + 1) / (df + 1)) + 0.5
    idf[0] = 0
    rows = np.repeat(np.arange(len(items)), [len(x) for x in items])
    cell, times = np.unique(rows * n + np.array([index[w] for x in items for w in x], np.int64), return_counts=True)
    row, col = cell // n, cell % n
    value = times * idf[col]
    value /= np.sqrt(np.bincount(row, weights=value**2, minlength=len(items)))[row]

    def gram(basis: np.ndarray) -> np.ndarray:
        """The items' matrix, transposed, times its product with the directions; only its entries are held."""
        out, inner = np.zeros_like(basis), np.zeros((len(items), basis.shape[1]))
        for lo in range(0, len(row), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            np.add.at(inner, row[at], value[at, None] * basis[col[at]])
        for lo in range(0, len(row), 1 << 16):
            at = slice(lo, lo + (1 << 16))
            np.add.at(out, col[at], value[at, None] * inner[row[at]])
        return out

    weight = ITEMS_WEIGH * max(total, 1.0) / len(items)
    k = min(rank, n - 1)
    basis = np.random.default_rng(seed).normal(size=(n, k))
    basis[0] = 0
    latent = Latent(words, idf, float(np.log(total + 1) + 0.5), basis)

    def image(basis: np.ndarray) -> np.ndarray:
        return _passes(texts, words, latent._replace(directions=basis).table()) * idf[:, None] + weight * gram(basis)

    basis = np.linalg.qr(image(basis))[0]  # the range of the words' co-occurrence
    seen = image(basis)
    values, turn = np.linalg.eigh((basis.T @ seen + seen.T @ basis) / 2)
    return latent._replace(directions=basis @ turn[:, ::-1])


def lcs(a: list, b: list) -> int:
    """Length of the longest common subsequence, 64 and more of its rows at a time as bits of a number."""
    where: dict = {}
    for i, w in enumerate(a):
        where[w] = where.get(w, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for w in b:
        if m := where.get(w):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


class _Searcher:
    """Benchmark items in latent space, by the passage length that holds them."""

    def __init__(self, latent: Latent, items: list[tuple[int, list[str]]], limits: Thresholds):
        self.limits, self.table = limits, latent.table()[:, :-1].copy()
        self.rows = np.empty((SEARCHED * BLOCK + 64 * BLOCK, self.table.shape[1]), np.float32)
        index = {w: i + 1 for i, w in enumerate(latent.words)}
        self.whole = [(i, np.array([index[x] for x in w])) for i, w in items]
        # (item, first word, words); the last segment ends with the item, so that every word is searched for
        self.items = [(i, k, w[k : k + SEGMENT]) for i, (_, w) in enumerate(self.whole) for k in sorted({*range(0, max(1, len(w) - SEGMENT), SEGMENT), max(0, len(w) - SEGMENT)})]
        self.base = len(latent.words) + 1
        self.rows_of = self._rows()
        scale: dict[int, list[int]] = {}
        for at, (_, _, w) in enumerate(self.items):
            scale.setdefault(-(-len(w) // BLOCK) + 1, []).append(at)
        self.scales = []
        for size, ats in sorted(scale.items()):
            y = np.stack([self.table[_once(self.items[a][2])].sum(axis=0) for a in ats])
            self.scales.append((size, ats, (y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-9)).T))

    def _keys(self, x: np.ndarray, size: int) -> np.ndarray:
        """A number for each ``size`` words in a row."""
        n = max(0, len(x) - size + 1)
        out = np.zeros(n, np.uint64)
        for i in range(size):
            out = out * np.uint64(self.base) + x[i : i + n].astype(np.uint64)
        return out

    def _rows(self) -> list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """By the number of words in a row: the sorted distinct keys, where each begins among the segments' places, those segments, and the places."""
        out = []
        for size in range(1, IN_A_ROW + 1):
            ats = [a for a, (_, _, w) in enumerate(self.items) if min(len(w), IN_A_ROW) == size]
            if not ats:
                continue
            keys = [self._keys(self.items[a][2], size) for a in ats]
            seg, place, key = np.repeat(ats, [len(k) for k in keys]), np.concatenate([np.arange(len(k)) for k in keys]), np.concatenate(keys)
            order = np.argsort(key, kind="stable")
            own, begin = np.unique(key[order], return_index=True)
            out.append((size, own, np.append(begin, len(key)), seg[order], place[order]))
        return out

    def _shared(self, docs: list[np.ndarray]) -> list[tuple[int, int, int]]:
        """(text, segment, first block) where words in a row are shared at PLACES places, about as far apart in both."""
        lengths = np.array([len(d) for d in docs], np.int64)
        x = np.concatenate([*docs, np.zeros(0, np.int64)]).astype(np.int64)
        first = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(docs)), lengths)
        out = []
        for size, own, begin, seg, place in self.rows_of:
            n = max(0, len(x) - size + 1)
            fits = doc[:n] == doc[size - 1 :][:n]
            for i in range(size):
                fits &= x[i : i + n] > 0
            at = np.flatnonzero(fits)
            key = self._keys(x, size)[at]
            k = np.minimum(np.searchsorted(own, key), len(own) - 1)
            hit = own[k] == key
            at, k = at[hit], k[hit]
            times = begin[k + 1] - begin[k]
            which = np.repeat(begin[k], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            at, s = np.repeat(at, times), seg[which]
            block = np.maximum(at - first[doc[at]] - place[which], 0) // BLOCK
            # a hit counts for its block and the one before: words may be missing or added in between
            rows = np.column_stack([np.append(doc[at], doc[at]), np.append(s, s), np.append(block, block - 1), np.append(place[which], place[which])])
            rows = np.unique(rows[rows[:, 2] >= 0], axis=0)
            places, n_places = np.unique(rows[:, :3], axis=0, return_counts=True)
            most = np.bincount(seg, minlength=len(self.items))
            out += map(tuple, places[n_places >= np.minimum(PLACES, most[places[:, 1]])].tolist())
        return out

    def batch(self, docs: list[np.ndarray]) -> list[tuple[int, int, float, float, bool, int]]:
        """(text, item, cosine, share of the item's words in order, answer found, first word) where an item is found."""
        top = self.scales[-1][0]
        n_blocks = np.array([-(-len(d) // BLOCK) + top - 1 if len(d) else 0 for d in docs], np.int64)  # so that no passage reaches into the next text
        ends = np.cumsum(n_blocks)
        x = np.zeros(int(ends[-1]) * BLOCK if len(ends) else 0, np.int64)
        for d, end, n in zip(docs, ends, n_blocks):
            x[(end - n) * BLOCK : (end - n) * BLOCK + len(d)] = _once(d)
        out = []
        for d, at, block in self._shared(docs):
            w = self.items[at][2]
            size = (-(-len(w) // BLOCK) + 1) * BLOCK
            y, q = (self.table[_once(v)].sum(axis=0) for v in (docs[d][block * BLOCK : block * BLOCK + size], w))
            out.append((d, at, float(y @ q / max(np.linalg.norm(y) * np.linalg.norm(q), 1e-9)), block * BLOCK, size))
        for lo in range(0, len(x) // BLOCK, SEARCHED):
            cut = x[lo * BLOCK : (lo + SEARCHED + top - 1) * BLOCK]
            blocks = np.take(self.table, cut, axis=0, out=self.rows[: len(cut)], mode="clip").reshape(-1, BLOCK, self.table.shape[1]).sum(axis=1)
            blocks = np.concatenate([blocks, np.zeros((top, blocks.shape[1]), np.float32)])
            m = min(SEARCHED, len(x) // BLOCK - lo)
            y, have = blocks[:m].copy(), 1
            for size, ats, q in self.scales:
                while have < size:
                    y += blocks[have : have + m]
                    have += 1
                cos = (y @ q) / np.maximum(np.linalg.norm(y, axis=1), 1e-6)[:, None]
                rows, cols = np.nonzero(cos >= self.limits.cosine)
                d = np.searchsorted(ends, lo + rows, side="right")
                starts = (lo + rows - (ends[d] - n_blocks[d])) * BLOCK
                out += zip(d.tolist(), (ats[c] for c in cols.tolist()), cos[rows, cols].tolist(), starts.tolist(), [size * BLOCK] * len(rows))
        return self._verified(docs, out)

    def _verified(self, docs: list[np.ndarray], candidates: list[tuple[int, int, float, int, int]]) -> list[tuple[int, int, float, float, bool, int]]:
        best: dict[tuple[int, int], tuple[float, float, bool, int]] = {}
        lim, tried = self.limits, set()
        for d, at, cos, start, size in sorted(candidates, key=lambda c: -c[2]):
            item, offset, segment = self.items[at]
            if ((d, item) in best and best[d, item][1] >= 0.999) or (d, at, start) in tried:
                continue
            tried.add((d, at, start))
            numbers = self.whole[item][1].tolist()
            # the whole item around the segment found, with a quarter more for words that were added
            after = len(numbers) - offset - len(segment)
            region = docs[d][max(0, start - offset - offset // 4 - BLOCK) : start + size + after + after // 4 + BLOCK]
            region = region.tolist()
            if len(set(numbers).intersection(region)) < 0.5 * lim.lcs_with_answer * len(set(numbers)):
                continue
            got = lcs(numbers, region) / len(numbers)
            if got < lim.lcs_with_answer:
                continue
            tail = numbers[-min(lim.answer_words, len(numbers)) :]
            answer = lcs(tail, region) >= lim.answer * len(tail)
            if got >= lim.lcs or answer:
                if (d, item) not in best or got > best[d, item][1]:
                    best[d, item] = (cos, got, answer, start)
        return [(d, self.whole[item][0], *v) for (d, item), v in sorted(best.items())]


_FOUND = "doc_id long, item_id long, cosine double, lcs_share double, answer_found boolean, at_word long"


def shards(rows: Iterable[tuple[int, str | None]]) -> Iterator[list[tuple[int, list[str]]]]:
    """Items with words, as they come, in shards of a bounded size."""
    held: list[tuple[int, list[str]]] = []
    words: set[str] = set()
    segments = 0
    for i, text in rows:
        if not (own := words_of(text)):
            continue
        if held and (len(words.union(own)) > SHARD_WORDS or segments + len(own) // SEGMENT + 1 > SHARD_SEGMENTS):
            yield held
            held, words, segments = [], set(), 0
        held.append((int(i), own))
        words.update(own)
        segments += len(own) // SEGMENT + 1
    if held:
        yield held


def find_contamination(docs: DataFrame, benchmark: DataFrame, limits: Thresholds = Thresholds(), rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, cosine, lcs_share, answer_found, at_word) for each benchmark item that a document holds.

    The benchmark comes to the driver a shard at a time, and each shard goes to every task; the documents are read anew for
    each. Null and empty texts hold nothing and are held by nothing, a null doc_id stays null, items of a null item_id are
    left out. Of an item's places in a document the best counts; repeated rows count each. Very long texts and items
    are searched whole. Empty tables give no rows; other columns are not read.
    """
    spark = tuned(docs)
    rows = benchmark.where("item_id is not null").select(F.col("item_id").cast("long"), F.col("text").cast("string")).orderBy("item_id", "text")
    found: list[DataFrame] = []
    for items in shards(rows.toLocalIterator()):
        if found:  # several shards: each is searched for before the next one comes
            found[-1] = written(found[-1])
        found.append(_find(docs, items, limits, rank))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], _FOUND)


def _find(docs: DataFrame, items: list[tuple[int, list[str]]], limits: Thresholds, rank: int) -> DataFrame:
    words = sorted({w for _, x in items for w in x})
    texts = encoded(docs, words)
    latent = fit_latent(texts, words, [w for _, w in items], rank)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        search, kind = _Searcher(latent, items, limits), _kind(words)
        for b in batches:
            found = search.batch([np.frombuffer(x, kind).astype(np.int64) for x in b.column("ids").to_pylist()])
            ids = b.column("doc_id").take(pa.array([f[0] for f in found], pa.int64()))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([f[i] for f in found], t) for i, t in zip(range(1, 6), (pa.int64(), pa.float64(), pa.float64(), pa.bool_(), pa.int64())))], ["doc_id", "item_id", "cosine", "lcs_share", "answer_found", "at_word"])

    return texts.mapInArrow(run, _FOUND)


def decontaminate(docs: DataFrame, benchmark: DataFrame, limits: Thresholds = Thresholds(), rank: int = RANK) -> DataFrame:
    """``docs`` without those that hold a benchmark item, all columns as they are; rows of a null doc_id stay, as nothing tells them apart."""
    found = written(find_contamination(docs, benchmark, limits, rank).select(F.col("doc_id").alias("_held")).distinct())
    return docs.join(found, docs["doc_id"] == found["_held"], "left_anti")
