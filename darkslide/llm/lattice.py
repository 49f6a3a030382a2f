"""Near-duplicate vectors by lattice hashing.

In each of several tables a vector is projected to 16 random directions, scaled, and each half of the projection is
decoded to the nearest point of the E8 lattice; the two points are its cell. A vector is stored in its own cell and
also probes the neighbouring cells that lie nearest to it, one across a wall of each half. Cells travel without the
vectors; only members of cells where vectors meet get them, and those pairs are verified by their cosine in double
precision. A pair counts where it meets first, so that links are counted without a list of pairs, and each task reduces
its links to a spanning forest.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, grouped, labels_of, tuned, written
from .graph import connected_components

#: Rows of a cell that one task takes; larger cells are dealt out by pairs of their parts.
PART = 256


class Lattice(NamedTuple):
    """With these, pairs of cosine 0.93, 0.95 and 0.97 in 64 dimensions meet with probability 0.98, 0.997 and 0.9997."""

    tables: int = 8
    scale: float = 0.45
    seed: int = 8


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Whole-number points of even sum nearest to x: where rounding gives an odd sum, the worst coordinate goes the other way."""
    near = np.rint(x)
    odd = np.flatnonzero(near.sum(axis=1).astype(np.int64) & 1)
    gap = (x - near)[odd]
    worst = np.abs(gap).argmax(axis=1)
    near[odd, worst] += np.where(gap[np.arange(len(odd)), worst] >= 0, 1, -1)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest point of E8, which is D8 and D8 moved by a half in every coordinate."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    return np.where((((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1))[:, None], a, b)


def nearest_root(x: np.ndarray) -> np.ndarray:
    """The shortest vector of E8, of its 240, that points most in the direction of x.

    They are two ones of any sign, or eight halves of which an even number is negative.
    """
    size, rows = np.abs(x), np.arange(len(x))
    sign = np.where(x >= 0, 1.0, -1.0)
    order = np.argsort(size, axis=1)
    ones = np.zeros_like(x)
    for k in (-1, -2):
        ones[rows, order[:, k]] = sign[rows, order[:, k]]
    odd = (x < 0).sum(axis=1) & 1
    halves = sign / 2
    halves[rows, order[:, 0]] *= np.where(odd, -1, 1)
    take = size[rows, order[:, -1]] + size[rows, order[:, -2]] >= size.sum(axis=1) / 2 - odd * size[rows, order[:, 0]]
    return np.where(take[:, None], ones, halves)


def _mix(rows: np.ndarray, salt: int) -> np.ndarray:
    """A 64-bit hash of each row of small integers."""
    h = np.full(len(rows), salt, np.uint64)
    with np.errstate(over="ignore"):
        for c in rows.T:
            h = (h ^ c.astype(np.int64).view(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return h


def cells(unit: np.ndarray, labels: np.ndarray, lattice: Lattice) -> np.ndarray:
    """For each vector and table the hashes of its own cell and of the two cells that it probes: (n, tables, 3).

    A vector's are the same to the last bit whatever vectors stand beside it, as no sum depends on them.
    """
    n, dim = unit.shape
    out = np.zeros((n, lattice.tables, 3), np.uint64)
    rng = np.random.default_rng([lattice.seed, dim])
    for t in range(lattice.tables):
        halves, others = [], []
        for _ in range(2):
            x = np.einsum("ij,jk->ik", unit, rng.normal(size=(dim, 8)) * lattice.scale)
            c = nearest_e8(x)
            halves.append(np.rint(2 * c))
            others.append(np.rint(2 * (c + nearest_root(x - c))))
        for k, pair in enumerate(((halves[0], halves[1]), (others[0], halves[1]), (halves[0], others[1]))):
            out[:, t, k] = _mix(np.column_stack([labels, *pair]), 1000 * dim + t)
    return out


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(axis=1, keepdims=True)  # no overflow in the squares
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _stored(lattice: Lattice):
    """A row for each vector and cell that it is stored in or probes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, v in _by_size(b.column("emb")):
                own = cells(_unit(v), b.column("lab").to_numpy()[at], lattice)
                n, k = len(at), 3 * lattice.tables
                yield pa.RecordBatch.from_arrays([
                    pa.array(own.reshape(-1).view(np.int64)), pa.array(np.tile(np.repeat(np.arange(lattice.tables, dtype=np.int32), 3), n)),
                    pa.array(np.tile(np.arange(3) == 0, n * lattice.tables)), b.column("rep").take(pa.array(np.repeat(at, k))),
                ], ["cell", "tab", "owner", "rep"])

    return run


def _by_size(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of the same length and their values, out of lists without nulls."""
    sizes = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[first[at][:, None] + np.arange(size)]


def _links(threshold: float, lattice: Lattice):
    """A task's links as spanning forests, with each vector's number of them, out of rows of cells dealt out in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, starts in grouped(batches, ["cell", "part", "other"], 8_000):
            rep, mult, owner, tab, cell, lab = (t.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "mult", "owner", "tab", "cell", "lab"))
            own, part, other = (t.column(c).to_numpy() for c in ("own", "part", "other"))
            label = t.column("label").to_numpy(zero_copy_only=False)
            linked: list[tuple[np.ndarray, np.ndarray]] = []
            hashes = np.zeros((t.num_rows, lattice.tables, 3), np.uint64)
            for rows, v in _by_size(t.column("emb").combine_chunks()):  # one length at a time; a cell holds one alone
                x = _unit(v)
                found: list[tuple[np.ndarray, np.ndarray]] = []
                for lo, hi in zip(*(np.searchsorted(rows, s) for s in (starts[:-1], starts[1:]))):
                    if hi - lo < 2 or not owner[rows[lo:hi]].any():
                        continue
                    mine = x[lo:hi]
                    i, j = np.nonzero(np.triu(mine @ mine.T >= threshold - 1e-9, 1))
                    if len(i):
                        near = np.einsum("ij,ij->i", mine[i], mine[j]) >= threshold
                        found.append((i[near] + lo, j[near] + lo))
                if found:
                    i, j = (np.concatenate(c) for c in zip(*found))
                    linked.append((rows[i], rows[j]))
                    # where the linked vectors meet at all: their cells once more, once for each vector
                    at = np.unique(np.concatenate([i, j]))
                    _, one, back = np.unique(rep[rows[at]], return_index=True, return_inverse=True)
                    hashes[rows[at]] = cells(x[at[one]], lab[rows[at[one]]], lattice)[back]
            if not linked:
                continue
            i, j = (np.concatenate(c) for c in zip(*linked))
            swap = rep[i] > rep[j]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            # parts of a large cell: a pair within one part counts only where that part meets itself
            ok = (owner[i] | owner[j]) & (rep[i] != rep[j]) & (label[i] == label[j]) & ((own[i] != own[j]) | (part[i] == other[i]))
            i, j = i[ok], j[ok]
            a, b = hashes[i], hashes[j]
            meets = (a[:, :, :1] == b).any(axis=2) | (b[:, :, :1] == a).any(axis=2)
            first = meets.argmax(axis=1) == tab[i]
            here = np.arange(len(i)), tab[i]
            k = cell[i].view(np.uint64)
            turn = (a[here][:, 0] == k) | ~(b[here] == a[here][:, :1]).any(axis=1)
            i, j = i[first & turn], j[first & turn]
            if not len(i):
                continue
            who, back = np.unique(np.concatenate([rep[i], rep[j]]), return_inverse=True)
            n = np.bincount(back, weights=np.concatenate([mult[j], mult[i]]), minlength=len(who)).astype(np.int64)
            low = who[labels_of(len(who), back[: len(i)], back[len(i) :])]
            yield pa.RecordBatch.from_arrays([pa.array(who), pa.array(low), pa.array(n)], ["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, threshold: float = 0.93, lattice: Lattice = Lattice()) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of ``vectors`` (vec_id, embedding, label).

    Vectors link if their labels are equal and their cosine is ``threshold`` or more. Equal vectors are one class: they
    link with each other and share all other links. Vectors that are null, empty, zero or hold nulls or non-finite
    components, and those of a null label, link with nothing, as do vectors of different length. A row of a null vec_id
    links with nothing and has no component. Labels may be of any type that has a text. Repeated rows count as vectors of
    their own, and of a repeated vec_id with equal vectors too. Empty in, empty out; other columns are not read.
    """
    tuned(vectors)
    kind = "float" if "float" in vectors.schema["embedding"].dataType.simpleString() else "double"
    sound = "label is not null and vec_id is not null and size(embedding) > 0 and forall(embedding, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(embedding, x -> x <> 0)"
    src = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), F.col("embedding").cast(f"array<{kind}>").alias("emb"), F.coalesce(F.expr(sound), F.lit(False)).alias("sound"))
    src = src.select("*", F.xxhash64("emb").alias("k1"), F.xxhash64(F.lit(11), "emb").alias("k2"))
    ids = written(src.select("vec_id", "label", "sound", "k1", "k2"))
    classes = src.where("sound").groupBy("label", "k1", "k2").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("mult"), F.first("emb").alias("emb"))
    classes = written(classes.withColumn("lab", F.xxhash64("label")))
    rows = written(classes.select("lab", "rep", "emb").mapInArrow(_stored(lattice), "cell long, tab int, owner boolean, rep long"))
    # cells where vectors meet, one of which is stored there; most cells hold one vector alone
    met = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("owner").alias("owned")).where("n > 1 and owned")
    met = written(met.select("cell", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    members = written(rows.join(met, "cell"))
    forget(rows, met)
    dealt = members.join(classes.drop("k1", "k2"), "rep").withColumn("own", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("to", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", F.least("own", "to").alias("part"), F.greatest("own", "to").alias("other"), "own", "tab", "owner", "rep", "mult", "label", "lab", "emb")
    place = ("cell", "part", "other")
    links = written(dealt.repartition(*place).sortWithinPartitions(*place).mapInArrow(_links(threshold, lattice), "a long, b long, n long"))
    counts = links.groupBy(F.col("a").alias("rep")).agg(F.sum("n").alias("n"))
    found = connected_components(links.select("a", "b"))
    of = classes.join(counts, "rep", "left").join(found.withColumnRenamed("node", "rep"), "rep", "left")
    of = written(of.select("label", "k1", "k2", (F.coalesce("n", F.lit(0)) + F.col("mult") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id")))
    forget(members, links)
    mine = ids.join(of, ["label", "k1", "k2"], "left")
    take = lambda c, other: F.when(F.col("sound"), F.col(c)).otherwise(other).alias(c)
    return mine.select("vec_id", take("n_links", F.lit(0)).cast("long").alias("n_links"), take("component_id", F.col("vec_id"))).withColumn("kept", F.col("vec_id") == F.col("component_id"))
