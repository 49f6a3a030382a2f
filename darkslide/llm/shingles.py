"""Near duplicates by the similarity of word shingles: a self-join of SimHash tries finds candidates, the shingles decide.

A text is the set of its five-word shingles, as 32-bit hashes. Two texts are near duplicates if they share at least
0.8 of the shingles that either has (Jaccard). Texts of equal sets are one node. Sets at 0.8 differ in some 15 % of a
SimHash's bits, far more than three, so that the SimHash has 512: the paths on top of the tries are drawn from 384 of them, as
many tries as leave one pair at 0.8 in 5,000 without a common path, and below it two nodes are taken down together over
the other 128 bits (``simhash.trie_pairs``). Pairs within the budget are candidates. They are compared by their whole
sets, which are made again for them alone, each pair once for all tries. Where a cell's candidates are too dense for that,
as among many copies, they are a bucket: each member is compared with the bucket's first; then, in buckets that aren't
one component by that, members of different components. Such large buckets are dealt out to tasks in parts, and the
members outside the largest component go to every part.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from math import comb
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, grouped, labels_of, sized, tuned, written
from .graph import connected_components
from .simhash import trie_pairs

#: Words of a shingle, and the share of common shingles from which two texts are near duplicates.
WORDS, SIMILAR = 5, 0.8
#: Bits of a fingerprint that are walked down, and those of which the paths above are drawn.
WALKED, DRAWN = 128, 384
#: Walked bits in which candidates differ at most, and bits of all: 3.6 standard deviations and more above what sets at 0.8 differ in.
BUDGET, IN_ALL = 40, 128
#: Pairs at 0.8 that have no common path: one in so many.
LOST = 5000
#: The share of bits in which two sets at 0.8 differ, 0.1515 for large ones, at most; that of sets of FEW shingles, where one vote counts for more.
FLIPS, FLIPS_OF_FEW, FEW = 0.1615, 0.1875, 5
#: Members of a bucket that one task takes; larger buckets are dealt out. An evenly filled subtree holds up to twice as many nodes, and one of eight times as many is dealt out.
PART = 512
#: Pairs for each member, from which the candidates of a cell are a bucket; and pairs that a task holds at once.
DENSE, HELD = 4, 1 << 20
#: Candidates or large subtrees whose list is broadcast.
LISTED = 500_000

_R = np.random.default_rng(5)
_MIX = _R.integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)  # fixed: odd factors
_A = _R.integers(1, 2**63, (WALKED + DRAWN) // 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _R.integers(0, 2**63, (WALKED + DRAWN) // 64, dtype=np.uint64)
_SIGN = np.uint64(1 << 63)


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """The sorted 32-bit hashes of a text's word shingles; of fewer words than ``size`` all are one shingle."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint32)
    digest = xxhash.xxh64_intdigest
    h = np.array([digest(w) for w in words], np.uint64)
    k = min(size, len(h))
    n = len(h) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _MIX[i % 64]
        out ^= out >> np.uint64(29)
    return np.unique(((out * _MIX[0]) >> np.uint64(32)).astype(np.uint32))


def fingerprint(ids: np.ndarray) -> bytes | None:
    """The SimHash of a set: a bit is 1 if more than half of the members' hashes have it; nothing of an empty set."""
    if not len(ids):
        return None
    ones = np.zeros(WALKED + DRAWN, np.int64)
    for k in range(0, len(ids), 255):  # so many fit a byte's count
        h = ids[k : k + 255, None].astype(np.uint64) * _A + _B
        h ^= h >> np.uint64(32)
        h *= _MIX[1]
        h ^= h >> np.uint64(29)
        ones += np.unpackbits(h.view(np.uint8), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(ones * 2 > len(ids)).tobytes()


def _tries_needed(path: int, flips: float) -> int:
    """Tries with paths of so many bits that all but one in LOST of pairs share one of, if their bits differ with the probability ``flips``."""
    differ = np.arange(DRAWN + 1)
    likely = np.array([comb(DRAWN, k) * flips**k * (1 - flips) ** (DRAWN - k) for k in differ.tolist()])
    common = np.prod([np.clip((DRAWN - differ - i) / (DRAWN - i), 0, 1) for i in range(path)], axis=0)
    return next(n for n in itertools.count(1) if likely @ (1 - common) ** n <= 1 / LOST)


class Paths(NamedTuple):
    """The tries' paths: bits of the fingerprint's drawn part; the first ``tries`` are for all nodes, the others for sets of FEW shingles."""

    tries: int
    bits: np.ndarray

    def subtrees(self, prints: list[bytes]) -> np.ndarray:
        """Each node's subtree in each trie: nodes x tries."""
        drawn = np.unpackbits(np.frombuffer(b"".join(prints), np.uint8).reshape(len(prints), -1)[:, WALKED // 8 :], axis=1)
        out = np.zeros((len(prints), len(self.bits)), np.int32)
        for column in self.bits.T:
            out = out * 2 + drawn[:, column]
        return out


def paths_for(count: int) -> Paths:
    """Paths as short as keep a subtree of evenly spread nodes within two parts: short ones lose fewer pairs each."""
    path = next(p for p in itertools.count(4) if count <= 2 * PART << p)
    tries, all_tries = (_tries_needed(path, f) for f in (FLIPS, FLIPS_OF_FEW))
    r, each = np.random.default_rng(path), DRAWN // path
    bits = np.concatenate([r.permutation(DRAWN)[: each * path].reshape(each, path) for _ in range(-(-all_tries // each))])
    return Paths(tries, bits[:all_tries])


def _placed(paths: Paths):
    """A task's function from nodes to their places: (trie, subtree, rep, the walked bits in two words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            prints = b.column("print").to_pylist()
            at = paths.subtrees(prints)
            wanted = np.arange(at.shape[1])[None, :] < np.where(b.column("few").to_numpy(zero_copy_only=False), at.shape[1], paths.tries)[:, None]
            row, trie = np.nonzero(wanted)
            # as signed words in the order of unsigned ones
            walked = (np.frombuffer(b"".join(p[: WALKED // 8] for p in prints), ">u8").astype(np.uint64).reshape(-1, 2) ^ _SIGN).view(np.int64)
            columns = trie.astype(np.int32), at[row, trie], b.column("rep").to_numpy()[row], walked[row, 0], walked[row, 1]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["trie", "subtree", "rep", "walked", "rest"])

    return run


def near_in_cells(reps: np.ndarray, keys: np.ndarray, rest: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Candidates within cells as rows (key, a, b): pairs have the key 0; a row with a key other than that is a bucket's member a.

    The same members make a bucket of the same key, in whichever trie.
    """
    n = len(reps)
    label, dense, edges = np.arange(n), np.zeros(n, bool), np.zeros(n, np.int64)
    pairs = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    fresh: list[tuple[np.ndarray, np.ndarray]] = []
    held = 0

    def settle() -> None:
        """Joins components by the fresh pairs, and lets go of the pairs of dense ones."""
        nonlocal label, dense
        i, j = (np.concatenate(x) for x in zip(*fresh))
        np.add.at(edges, i, 1)
        label = labels_of(n, np.append(i, np.arange(n)), np.append(j, label))
        thick = np.bincount(label, edges, n) > DENSE * np.bincount(label, minlength=n)
        thick[label[dense]] = True
        dense = thick[label]
        pairs[:] = [(x[~dense[x]], y[~dense[x]]) for x, y in (*pairs, (i, j))]
        fresh.clear()

    for i, j in trie_pairs(keys, starts, 64, BUDGET, rest):
        news = ~dense[i] | (label[i] != label[j])
        if news.any():
            fresh.append((i[news], j[news]))
            held += np.count_nonzero(news)
        if held > HELD:
            settle()
            held = 0
    if fresh:
        settle()
    i, j = (np.concatenate(x) for x in zip(*pairs))
    key = np.zeros(n, np.uint64)
    mixed = reps.view(np.uint64) * _MIX[2]
    mixed ^= mixed >> np.uint64(31)
    np.add.at(key, label, mixed * _MIX[3])
    key = (key | np.uint64(1)).view(np.int64)
    low, high = np.minimum(reps[i], reps[j]), np.maximum(reps[i], reps[j])
    some = np.flatnonzero(dense)
    return np.append(np.zeros(len(i), np.int64), key[label[some]]), np.append(low, reps[some]), np.append(high, reps[some])


def _candidates(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t, starts in grouped(batches, ["trie", "subtree", "part", "other"]):
        reps, keys, rest = (t.column(c).to_numpy() for c in ("rep", "walked", "rest"))
        found = near_in_cells(reps, keys.view(np.uint64) ^ _SIGN, rest.view(np.uint64), starts)
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], ["key", "a", "b"])


def candidates(nodes: DataFrame) -> DataFrame:
    """(key, a, b) of ``nodes`` (rep, few, print), as ``near_in_cells`` gives them: what a self-join of all tries finds."""
    nodes = nodes.where("print is not null").select("rep", "few", "print")
    paths = paths_for(nodes.count())
    rows = nodes.mapInArrow(_placed(paths), "trie int, subtree int, rep long, walked long, rest long")
    large = written(rows.groupBy("trie", "subtree").count().where(F.col("count") > 8 * PART).select("trie", "subtree", F.ceil(F.col("count") / (8 * PART)).cast("int").alias("parts")))
    if n := large.count():
        listed = F.broadcast(large) if n <= LISTED else large
        dealt = rows.join(listed, ["trie", "subtree"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int"))
        rows = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("trie", "subtree", F.least("own", "to").alias("part"), F.greatest("own", "to").alias("other"), "rep", "walked", "rest")
    else:
        rows = rows.select("trie", "subtree", F.lit(0).alias("part"), F.lit(0).alias("other"), "rep", "walked", "rest")
    place = ("trie", "subtree", "part", "other")
    found = written(rows.repartition(*place).sortWithinPartitions(*place, "walked").mapInArrow(_candidates, "key long, a long, b long").distinct())
    forget(large)
    return found


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """The share of two sorted sets' members that both have; 1 for two empty sets."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both) if len(a) + len(b) else 1.0


def _linker(similar: float):
    """A task's function from cells of (rep, group, own part, whether it goes to every part, print, ids) to links between groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in grouped(batches, ["key", "part"], 4000):
            t = t.take(pa.compute.sort_indices(t.append_column("cell", pa.array(np.repeat(np.arange(len(starts) - 1), np.diff(starts)))), [("cell", "ascending"), ("rep", "ascending")]))
            reps, own, part = (t.column(c).to_pylist() for c in ("rep", "own", "part"))
            sets = [np.frombuffer(x, "<u4") for x in t.column("ids").to_pylist()]
            prints = np.frombuffer(b"".join(t.column("print").to_pylist()), np.uint64).reshape(len(reps), -1)
            group, roams = t.column("group").to_numpy().copy(), t.column("roams").to_pylist()
            a, b = [], []
            for lo, hi in zip(starts[:-1].tolist(), starts[1:].tolist()):
                for i in range(lo + 1, hi):
                    if (group[lo:i] == group[i]).all():
                        continue
                    near = np.bitwise_count(prints[lo:i] ^ prints[i]).sum(axis=1, dtype=np.int64) <= IN_ALL
                    for j in (np.flatnonzero(near & (group[lo:i] != group[i])) + lo).tolist():
                        n, m = len(sets[i]), len(sets[j])
                        # two that go to every part are compared in one alone
                        if group[j] == group[i] or (roams[i] and roams[j] and own[j] != part[j]) or min(n, m) < similar * max(n, m) or similarity(sets[i], sets[j]) < similar:
                            continue
                        a.append(reps[j])
                        b.append(reps[i])
                        of = group[lo:hi]
                        of[of == group[j]] = group[i]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _within(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's pairs whose whole fingerprints are within the budget."""
    for t in batches:
        if not t.num_rows:
            continue
        x, y = (np.frombuffer(b"".join(t.column(c).to_pylist()), np.uint64).reshape(t.num_rows, -1) for c in ("a_print", "b_print"))
        yield t.select(["a", "b"]).filter(pa.array(np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64) <= IN_ALL))


def _compared(similar: float):
    """A task's links among candidate pairs with their sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in batches:
            near = []
            for x, y in zip(t.column("a_ids").to_pylist(), t.column("b_ids").to_pylist()):
                n, m = sorted((len(x), len(y)))
                near.append(n >= similar * m and similarity(np.frombuffer(x, "<u4"), np.frombuffer(y, "<u4")) >= similar)
            yield t.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    return run


def near_components(docs: DataFrame, size: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """(doc_id, component_id) for each row of a doc_id: the least doc_id reachable by links between near duplicates.

    Null texts are empty, and texts without words are alike. Rows of a null doc_id are left out, repeated rows stay, an
    empty table gives no rows. Very long texts are shingled whole.
    """
    tuned(docs)

    def marked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, size) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_copy(x) for x in sets], pa.binary()), pa.array([len(x) <= FEW for x in sets]), pa.array([fingerprint(x) for x in sets], pa.binary())], ["doc_id", "copy", "few", "print"])

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingles(t, size) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array([_copy(x) for x in sets], pa.binary()), pa.array([x.astype("<u4").tobytes() for x in sets], pa.binary())], ["rep", "copy", "ids"])

    src = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    own = written(src.mapInArrow(marked, "doc_id long, copy binary, few boolean, print binary"))
    nodes = written(own.groupBy("copy").agg(F.min("doc_id").alias("rep"), F.first("few").alias("few"), F.first("print").alias("print")))
    tried = candidates(nodes)
    in_cells = tried.where("key <> 0").select("key", F.col("a").alias("rep"))
    buckets = in_cells.groupBy("key").agg(F.count("*").alias("n"), F.min("rep").alias("lead"))
    members = written(in_cells.join(buckets.select("key", "lead", F.ceil(F.col("n") / PART).cast("int").alias("parts")), "key").withColumn("own", F.pmod(F.xxhash64("rep"), "parts").cast("int")))
    # the pairs, and each member with its bucket's first: the same pair of all tries is one
    first = members.where("rep <> lead").select(F.col("lead").alias("a"), F.col("rep").alias("b"))
    drawn = written(tried.where("key = 0").select("a", "b").union(first).distinct())
    print_of = lambda c: nodes.select(F.col("rep").alias(c), F.col("print").alias(f"{c}_print"))
    pairs = written(drawn.join(print_of("b"), "b").join(print_of("a"), "a").mapInArrow(_within, "a long, b long"))
    of_pairs = pairs.select(F.explode(F.array("a", "b")).alias("rep"))
    wanted = written(of_pairs.union(members.select("rep")).distinct().join(nodes.select("rep", "copy", "print"), "rep"))
    if wanted.count() <= LISTED:  # their texts alone; else the sets of all texts, which are smaller, meet them in a shuffle
        src = src.join(F.broadcast(wanted.select(F.col("rep").alias("doc_id"))), "doc_id", "left_semi")
    made = src.mapInArrow(whole, "rep long, copy binary, ids binary").join(wanted.withColumnRenamed("copy", "_copy"), "rep").where("copy = _copy")
    sets = written(made.dropDuplicates(["rep"]).select("rep", "print", "ids"))
    of = lambda c: sets.select(F.col("rep").alias(c), F.col("ids").alias(f"{c}_ids"))
    edges = written(pairs.join(of("b"), "b").join(of("a"), "a").mapInArrow(_compared(similar), "a long, b long"))
    found = written(connected_components(edges))
    labelled = written(members.join(found.select(F.col("node").alias("rep"), "component"), "rep", "left").withColumn("group", F.coalesce("component", "rep")))
    # in a bucket that isn't one component, those outside its largest meet all others
    sizes = labelled.groupBy("key", "group").count().groupBy("key")
    split = written(sizes.agg(F.count("*").alias("groups"), F.max(F.struct("count", "group")).alias("most")).where("groups > 1").select("key", F.col("most.group").alias("most")))
    apart = written(labelled.join(split, "key").select("key", "rep", "group", "own", "parts", (F.col("group") != F.col("most")).alias("roams")))
    if n := apart.agg(F.sum(F.when(F.col("roams"), F.col("parts")).otherwise(1))).first()[0]:
        every = F.sequence(F.lit(0), F.col("parts") - 1)
        cells = apart.select("key", "rep", "group", "own", "roams", F.explode(F.when(F.col("roams"), every).otherwise(F.array("own"))).alias("part"))
        dealt = cells.join(sets, "rep").select("key", "part", "rep", "group", "own", "roams", "print", "ids").repartition("key", "part").sortWithinPartitions("key", "part")
        more = written(sized(dealt, n, PART).mapInArrow(_linker(similar), "a long, b long").distinct())
        found = written(connected_components(edges.unionByName(more)))
        forget(more)
    classes = written(nodes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("copy", F.coalesce("component", "rep").alias("component_id")))
    out = written(own.select("doc_id", "copy").join(classes, "copy").select("doc_id", "component_id"))
    forget(own, nodes, tried, members, drawn, pairs, wanted, sets, edges, labelled, split, apart, found, classes)
    return out


def _copy(ids: np.ndarray) -> bytes:
    """What equal sets have in common."""
    return xxhash.xxh3_128_digest(ids.astype("<u4").tobytes())


def near_dedup(docs: DataFrame, size: int = WORDS, similar: float = SIMILAR) -> DataFrame:
    """``docs`` with one document of each group of near duplicates: that of the least doc_id; of its repeated rows one stays.

    Texts without words are near duplicates of each other. Rows with a null doc_id stay as they are.
    """
    if not docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        docs = written(docs.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null")))
    gone = near_components(docs, size, similar).where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
