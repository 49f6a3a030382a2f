"""SimHash near-duplicates by a self-join of a binary trie.

All fingerprints stand in a binary trie. Two of its nodes are taken down together, bit by bit; the bits in which
their paths differ add up, and a pair that differs in more than the budget is pruned with all below it. The 64 bits
are cut into blocks, more than the budget: two fingerprints within 3 bits agree in all blocks but three at least.
Each choice of so many blocks is put on top once, so that in one of these tries the pair's common path is as long as
the blocks are, and each subtree below that depth can be searched for itself, by any task. Four blocks give four tries of
65,536 subtrees; where a subtree would hold more fingerprints than a task takes, there are more blocks and longer paths.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, grouped, labels_of, tuned, written
from .graph import connected_components

#: Fingerprints of a subtree that one task takes; larger subtrees are dealt out by pairs of their parts.
PART = 1024
#: Bits in which linked fingerprints differ at most.
BUDGET = 3
#: Large subtrees whose list is broadcast; a longer list is joined by a shuffle.
LISTED = 300_000
#: Shingles whose bits are counted at once.
CHUNK = 1 << 15
#: Node pairs with at most so many fingerprint pairs are compared outright.
LEAF = 64
#: The same for keys of 128 bits, and the keys of a node that are compared at once.
WIDE_LEAF, BLOCK = 1 << 14, 512


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """The unsigned 64-bit SimHash of a text's word shingles; 0 if it has no words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - size + 1)
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for k in range(0, n, CHUNK):
        part = words[k : k + CHUNK + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if n > 1 or len(words) >= size else [b" ".join(words)]
        bits = np.frombuffer(b"".join([digest(s, seed) for s in shingles]), np.uint8).reshape(-1, 8)
        ones += np.unpackbits(bits, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > n).tobytes(), "big")


def trie_pairs(keys: np.ndarray, starts: np.ndarray, depth: int, budget: int, rest: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) of sorted 64-bit ``keys`` that differ in at most ``budget`` of their lower ``depth`` bits.

    ``starts`` has the first index of each subtree, and the end; the keys of a subtree share the bits above. ``rest``
    has 64 further bits of each key, which count too: such a wide budget prunes late, so that larger nodes are compared.
    """
    leaf = LEAF if rest is None else WIDE_LEAF
    lo, hi = starts[:-1], starts[1:]
    wide = hi - lo > 1
    a_lo, a_hi = lo[wide], hi[wide]
    b_lo, b_hi, diff = a_lo, a_hi, np.zeros(len(a_lo), np.int64)
    for bit in range(depth - 1, -2, -1):
        size = (a_hi - a_lo) * (b_hi - b_lo)
        done = (size <= leaf) if bit >= 0 else np.ones(len(size), bool)
        if done.any() and rest is not None:
            for pair in zip(a_lo[done].tolist(), a_hi[done].tolist(), b_lo[done].tolist(), b_hi[done].tolist()):
                yield from _near_blocks(keys, rest, *pair, budget)
        elif done.any():
            n_b, s = (b_hi - b_lo)[done], size[done]
            at = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
            n_b = np.repeat(n_b, s)
            i, j = np.repeat(a_lo[done], s) + at // n_b, np.repeat(b_lo[done], s) + at % n_b
            near = (i < j) & (np.bitwise_count(keys[i] ^ keys[j]) <= budget)
            yield i[near], j[near]
        if done.any():
            keep = ~done
            a_lo, a_hi, b_lo, b_hi, diff = a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep], diff[keep]
        if bit < 0 or not len(a_lo):
            return
        ones = np.append(0, np.cumsum((keys >> np.uint64(bit)) & np.uint64(1), dtype=np.int64))
        a_mid, b_mid = a_hi - (ones[a_hi] - ones[a_lo]), b_hi - (ones[b_hi] - ones[b_lo])
        same = (a_lo == b_lo) & (a_hi == b_hi)
        four = [(a_lo, a_mid, b_lo, b_mid, diff), (a_mid, a_hi, b_mid, b_hi, diff), (a_lo, a_mid, b_mid, b_hi, diff + 1)]
        mixed = ~same
        four.append((a_mid[mixed], a_hi[mixed], b_lo[mixed], b_mid[mixed], diff[mixed] + 1))
        a_lo, a_hi, b_lo, b_hi, diff = (np.concatenate(x) for x in zip(*four))
        keep = (a_hi > a_lo) & (b_hi > b_lo) & (diff <= budget) & ((a_lo != b_lo) | (a_hi - a_lo > 1))
        a_lo, a_hi, b_lo, b_hi, diff = a_lo[keep], a_hi[keep], b_lo[keep], b_hi[keep], diff[keep]


def _near_blocks(keys: np.ndarray, rest: np.ndarray, a_lo: int, a_hi: int, b_lo: int, b_hi: int, budget: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of two nodes of 128-bit keys that are within the budget, block by block."""
    for a in range(a_lo, a_hi, BLOCK):
        for b in range(b_lo, b_hi, BLOCK):
            x, y = slice(a, min(a + BLOCK, a_hi)), slice(b, min(b + BLOCK, b_hi))
            far = np.bitwise_count(keys[x, None] ^ keys[None, y])
            far += np.bitwise_count(rest[x, None] ^ rest[None, y])
            i, j = np.nonzero(far <= budget)
            i, j = i + a, j + b
            yield i[i < j], j[i < j]


class Tries(NamedTuple):
    """How fingerprints are cut: the blocks' widths, and for each trie the blocks in their order, those on top first."""

    widths: tuple[int, ...]
    orders: tuple[tuple[int, ...], ...]

    @property
    def top(self) -> int:
        """Bits of the shortest common path."""
        return min(sum(self.widths[i] for i in o[: len(self.widths) - BUDGET]) for o in self.orders)

    def turned(self, bits: Column, trie: int) -> Column:
        """The fingerprint with its blocks in a trie's order."""
        first, out, left = [0, *itertools.accumulate(self.widths)], F.lit(0).cast("long"), 64
        for i in self.orders[trie]:
            left -= self.widths[i]
            block = F.shiftrightunsigned(bits, 64 - first[i + 1]).bitwiseAND((1 << self.widths[i]) - 1)
            out = out.bitwiseOR(F.shiftleft(block, left))
        return out


def tries_for(count: int) -> Tries:
    """As few blocks as keep a subtree of evenly spread fingerprints within a task's part."""
    for n in itertools.count(BUDGET + 1):
        widths = tuple(64 * (i + 1) // n - 64 * i // n for i in range(n))
        tops = itertools.combinations(range(n), n - BUDGET)
        found = Tries(widths, tuple((*t, *(i for i in range(n) if i not in t)) for t in tops))
        if count <= PART << found.top:
            return found


def _links(depth: int):
    """A task's spanning forests of subtrees' links: as many edges as nodes at most, however dense the links are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in grouped(batches, ["trie", "subtree", "part", "other"]):
            keys = t.column("turned").to_numpy().view(np.uint64)
            node = t.column("bits").to_numpy()
            label = np.arange(len(keys))
            for i, j in trie_pairs(keys, starts, depth, BUDGET):
                if len(i):
                    label = labels_of(len(keys), np.append(i, np.arange(len(keys))), np.append(j, label))
            low = np.full(len(keys), np.iinfo(np.int64).max)
            np.minimum.at(low, label, node)
            far = low[label] != node
            yield pa.RecordBatch.from_arrays([pa.array(node[far]), pa.array(low[label][far])], ["a", "b"])

    return run


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, bits) of every row, over its whole text; bits is the fingerprint as a signed long. Null text: empty."""
    tuned(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(bits.view(np.int64))], ["doc_id", "bits"])

    return src.mapInArrow(run, "doc_id long, bits long")


def simhash_components(docs: DataFrame) -> DataFrame:
    """(doc_id, bits, component_id) for every row of ``docs``; component_id is the least doc_id reachable by links.

    Documents link if their fingerprints differ in at most 3 bits. Rows of equal fingerprints are one node of the
    graph, so copies make no pairs. Null texts count as empty: fingerprint 0, which links like any other. Rows of a
    null doc_id link like any others, and lead from one document to another; where no linked row has a doc_id,
    component_id is null. Repeated rows stay. Empty in, empty out; other columns are not read.
    """
    own = written(fingerprints(docs))
    nodes = written(own.groupBy("bits").agg(F.min("doc_id").alias("rep")))
    tries = tries_for(nodes.count())
    turned = F.array(*(F.struct(F.lit(k).alias("trie"), tries.turned(F.col("bits"), k).alias("turned")) for k in range(len(tries.orders))))
    rows = nodes.select("bits", F.explode(turned).alias("x")).select("bits", "x.trie", "x.turned", F.shiftrightunsigned("x.turned", 64 - tries.top).alias("subtree"))
    large = written(rows.groupBy("trie", "subtree").count().where(F.col("count") > PART).select("trie", "subtree", F.ceil(F.col("count") / PART).cast("int").alias("parts")))
    listed = F.broadcast(large) if large.count() <= LISTED else large
    dealt = rows.join(listed, ["trie", "subtree"], "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("turned"), F.col("parts")).cast("int"))
    cells = dealt.select("trie", "subtree", "turned", "bits", "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("to"))
    cells = cells.select("trie", "subtree", F.least("own", "to").alias("part"), F.greatest("own", "to").alias("other"), "turned", "bits")
    # the unsigned order of keys within a subtree is their signed order too: they share the highest bit
    place = ("trie", "subtree", "part", "other")
    edges = written(cells.repartition(*place).sortWithinPartitions(*place, "turned").mapInArrow(_links(64 - tries.top), "a long, b long"))
    found = connected_components(edges)
    forget(edges, large)
    groups = written(nodes.join(found.withColumnRenamed("node", "bits"), "bits", "left").select("bits", "rep", F.coalesce("component", "bits").alias("group")))
    least = groups.groupBy("group").agg(F.min("rep").alias("component_id"))
    classes = written(groups.join(least, "group").select("bits", "component_id"))
    forget(nodes, groups)
    return own.join(classes, "bits", "left").select("doc_id", "bits", "component_id")


def simhash_dedup(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group: the one whose doc_id is the least; of its repeated rows one stays.

    Rows with a null doc_id stay as they are: nothing tells them apart.
    """
    found = written(simhash_components(docs).where("doc_id is not null").select("doc_id", "component_id"))
    repeated = not found.groupBy("doc_id").count().where("count > 1").isEmpty()
    if repeated:
        docs = docs.where("doc_id is not null").dropDuplicates(["doc_id"]).unionByName(docs.where("doc_id is null"))
    gone = found.where("doc_id <> component_id").select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
