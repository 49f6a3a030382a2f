"""Code lengths of text under a context-tree weighting of its bytes.

A byte is eight binary decisions. For each of the 255 places among them there is a tree of the bytes that stand
before, down to a fixed depth. Each node holds a Krichevsky-Trofimov estimate of its bit and is mixed with what its
children say, half and half beforehand; the counts of the corpus turn the halves into weights. Below the last context
that was seen nothing is mixed in. A byte's probability is the product of its eight mixtures over all depths of its context.

The texts are written once, in blocks of a bounded size that no later reading cuts anew. A block's distinct grams
(context and byte) go out in a few compressed chunks, are summed by gram, go to the subtree of their three latest
context bytes, and their probabilities come back to the blocks that hold them, which then score their texts. A split's
blocks go to the task of the split's number, one after the other. No task sees more than a block or a part of the
distinct grams at a time (a subtree of three bytes has 16.7 million grams at most, whatever the input), and nothing is
broadcast but the nodes of the top two levels.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, tuned, written

#: Context bytes before a byte, from 3 to 7; with it they fill a 64-bit key at most.
DEPTH = 5
#: Bytes of text from which a block is full.
BLOCK = 24_000_000
#: What ends a text and stands before it; UTF-8 has no such byte.
END = 0xFF
#: Distinct grams that a block gathers before it merges them.
MERGE = 4_000_000


def words_of(text: str | None) -> list[bytes]:
    """A text's words, A-Z in lower case."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def grams(texts: Iterable[list[bytes]], depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """For texts of words: the gram that ends at each of their bytes, words joined by a space, and at their end; and how many a text has."""
    pad, parts, n = bytes([END]) * depth, [], []
    for w in texts:
        joined = b" ".join(w)
        parts += [pad, joined, pad[:1]]
        n.append(len(joined) + 1)
    data = np.frombuffer(b"".join([*parts, bytes(8)]), np.uint8)
    lengths = np.array(n, np.int64)
    windows = np.lib.stride_tricks.as_strided(data.view(np.uint8), (len(data) - 8, 8), (1, 1))
    keys = np.ascontiguousarray(windows).view(">u8").reshape(-1).astype(np.uint64) >> np.uint64(8 * (7 - depth))
    first = np.cumsum(lengths + depth) - (lengths + depth)
    keep = np.ones(len(keys), bool)
    for k in range(depth):
        keep[first + lengths + k] = False
    return keys[keep], lengths


def _merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Sums of counts by key, keys ascending."""
    keys, n = np.concatenate([k for k, _ in parts]), np.concatenate([n for _, n in parts])
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    at = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
    return keys[at], (np.add.reduceat(n, at) if len(at) else n)


def _pack(keys: np.ndarray, values: np.ndarray) -> tuple[bytes, bytes]:
    """Ascending keys as differences, byte planes apart; and values."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    small = values.astype(values.dtype.newbyteorder("<")).view(np.uint8).reshape(-1, values.dtype.itemsize)
    z = zstandard.ZstdCompressor(level=1)
    return z.compress(np.ascontiguousarray(gaps.T).tobytes()), z.compress(np.ascontiguousarray(small.T).tobytes())


def _unpack(keys: bytes, values: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    z, size = zstandard.ZstdDecompressor(), np.dtype(kind).itemsize
    planes = np.frombuffer(z.decompress(keys), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=np.uint64), np.ascontiguousarray(np.frombuffer(z.decompress(values), np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def _part(keys: np.ndarray, parts: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)) % np.uint64(parts)


def _chunks(keys: np.ndarray, values: np.ndarray, parts: np.ndarray) -> Iterator[tuple[int, bytes, bytes]]:
    """Ascending keys dealt out by their part."""
    order = np.argsort(parts, kind="stable")
    cut = np.flatnonzero(np.append(True, parts[order][1:] != parts[order][:-1])) if len(order) else []
    for lo, hi in zip(cut, [*cut[1:], len(order)]):
        at = order[lo:hi]
        yield int(parts[at[0]]), *_pack(keys[at], values[at])


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Logarithm of the gamma function for x > 0, by Stirling's series above 8."""
    x = np.asarray(x, np.float64)
    low, y = np.zeros_like(x), x.copy()
    for _ in range(8):
        small = y < 8
        low[small] += np.log(y[small])
        y[small] += 1
    r = 1 / (y * y)
    return (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y - low


def log_kt(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Log probability that the Krichevsky-Trofimov estimator gives to a sequence of so many zeros and ones."""
    return log_gamma(zeros + 0.5) + log_gamma(ones + 0.5) - log_gamma(zeros + ones + 1) - math.log(math.pi)


class Level:
    """The nodes of one depth: their key (context and place among the bits), counts, and log weighted probability."""

    def __init__(self, key, zeros, ones, below=None):
        self.key, self.zeros, self.ones = key, zeros, ones
        self.log_kt = log_kt(zeros, ones)
        self.log_w = self.log_kt if below is None else np.logaddexp(self.log_kt, below) - math.log(2)
        #: how much the node's own estimate counts against its children's
        self.own = np.ones(len(key)) if below is None else np.exp(self.log_kt - math.log(2) - self.log_w)

    def estimate(self, bit: np.ndarray, at: np.ndarray) -> np.ndarray:
        return (np.where(bit, self.ones[at], self.zeros[at]) + 0.5) / (self.zeros[at] + self.ones[at] + 1)

    def above(self) -> tuple["Level", np.ndarray]:
        """The level one byte of context up, and each node's parent there."""
        key = ((self.key >> np.uint64(16)) << np.uint64(8)) | (self.key & np.uint64(255))
        up, parent = np.unique(key, return_inverse=True)
        total = lambda x: np.bincount(parent, weights=x, minlength=len(up))
        return Level(up, total(self.zeros), total(self.ones), total(self.log_w)), parent


def latest_first(keys: np.ndarray, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """A gram's context with the latest byte on top, and the byte itself."""
    out = np.zeros_like(keys)
    for k in range(1, depth + 1):
        out = (out << np.uint64(8)) | ((keys >> np.uint64(8 * k)) & np.uint64(255))
    return out, keys & np.uint64(255)


def _leaves(keys: np.ndarray, n: np.ndarray, depth: int) -> tuple[Level, np.ndarray, np.ndarray]:
    """The deepest level under grams; for each gram and bit the node there and the bit."""
    context, byte = latest_first(keys, depth)
    place = np.stack([np.uint64(1 << k) | (byte >> np.uint64(8 - k)) for k in range(8)])
    bit = np.stack([((byte >> np.uint64(7 - k)) & np.uint64(1)).astype(bool) for k in range(8)])
    key, at = np.unique((context << np.uint64(8)) | place, return_inverse=True)
    at = at.reshape(8, -1)
    each = np.tile(n.astype(np.float64), 8)
    sums = lambda m: np.bincount(at.reshape(-1), weights=each * m.reshape(-1), minlength=len(key))
    return Level(key, sums(~bit), sums(bit)), at, bit


def subtree(keys: np.ndarray, n: np.ndarray, top: list[Level] | None = None, depth: int = DEPTH, down_to: int = 3):
    """The nodes at depth ``down_to`` over whole subtrees of grams; with the ``top`` levels, the grams' log10 probabilities."""
    level, at, bit = _leaves(keys, n, depth)
    levels, steps = [level], []
    for _ in range(depth - down_to):
        level, parent = level.above()
        levels.append(level)
        steps.append(parent)
    if top is None:
        return level
    for above in top:  # from depth down_to - 1 to 0
        key = ((levels[-1].key >> np.uint64(16)) << np.uint64(8)) | (levels[-1].key & np.uint64(255))
        steps.append(np.searchsorted(above.key, key))
        levels.append(above)
    count = lambda level: (level.zeros + level.ones)[at]
    p, seen = levels[0].estimate(bit, at), count(levels[0]) > 0
    for level, parent in zip(levels[1:], steps):
        at = parent[at]
        own, estimate = level.own[at], level.estimate(bit, at)
        p = np.where(seen, own * estimate + (1 - own) * p, estimate)  # a context that was never seen has nothing to say
        seen = count(level) > 0
    return np.log10(p).sum(axis=0)


def top_levels(rows: pa.Table) -> list[Level]:
    """The levels above the subtrees, deepest first, from sums over the subtrees' nodes by their parent (key, zeros, ones, below)."""
    key, zeros, ones, below = (c.to_numpy() for c in rows.columns)
    key = key.view(np.uint64)
    order = np.argsort(key)
    zeros, ones, below = zeros[order], ones[order], below[order]
    out = [Level(key[order], zeros, ones, below)]
    while len(out) < 3:
        out.append(out[-1].above()[0])
    return out


class KeyTable:
    """Finds values by 64-bit keys: open addressing, all look-ups at once."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(2 * len(keys)).bit_length())
        self.keys, self.values = np.zeros(1 << self.bits, np.uint64), np.full(1 << self.bits, np.nan)
        used = np.zeros(1 << self.bits, bool)
        left, slot = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = ~used[slot]
            self.keys[slot[free]] = keys[left[free]]
            won = free & (self.keys[slot] == keys[left])
            used[slot[won]] = True
            self.values[slot[won]] = values[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __getitem__(self, keys: np.ndarray) -> np.ndarray:
        slot = self._slot(keys)
        out = self.values[slot]
        left = np.flatnonzero(self.keys[slot] != keys)
        slot = slot[left]
        while len(left):
            slot = (slot + 1) & ((1 << self.bits) - 1)
            found = self.keys[slot] == keys[left]
            out[left[found]] = self.values[slot[found]]
            if np.isnan(self.values[slot[~found]]).any():
                raise LookupError("a block holds grams that were not gathered from it: the table changed between two reads")
            left, slot = left[~found], slot[~found]
        return out


def _packed(rows: pa.RecordBatch) -> bytes:
    """Rows as one compressed value: texts move as a third of their bytes."""
    out = pa.BufferOutputStream()
    with pa.ipc.new_stream(out, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
        w.write_batch(rows)
    return out.getvalue().to_pybytes()


def _unpacked(packs: pa.Array) -> Iterator[pa.RecordBatch]:
    for p in packs:
        yield from pa.ipc.open_stream(p.as_buffer())


def _blocked(size: int):
    """Packs of rows with the number of their split, and of their block in it; a text stays whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, full = TaskContext.get().partitionId(), 0
        for b in batches:
            ends = full + np.cumsum(np.nan_to_num(pc.binary_length(b.column("text")).to_numpy(zero_copy_only=False)).astype(np.int64))
            block = (np.append(full, ends)[: b.num_rows] // size).astype(np.int32)
            full = int(ends[-1]) if len(ends) else full
            for lo, hi in zip(at := np.flatnonzero(np.append(True, block[1:] != block[:-1])[: b.num_rows]), [*at[1:], b.num_rows]):
                yield pa.RecordBatch.from_arrays([pa.array([split], pa.int32()), pa.array(block[lo : lo + 1]), pa.array([_packed(b.slice(lo, hi - lo))], pa.binary())], ["split", "block", "pack"])

    return run


def _runs(batches: Iterator[pa.RecordBatch], *columns: str) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of batches with the same values in some columns."""
    for b in batches:
        values = [b.column(c).to_numpy() for c in columns]
        new = np.ones(b.num_rows, bool)
        new[1:] = np.any([v[1:] != v[:-1] for v in values], axis=0)
        at = np.flatnonzero(new)
        for lo, hi in zip(at, [*at[1:], b.num_rows]):
            yield tuple(int(v[lo]) for v in values), b.slice(lo, hi - lo)


def _gathered(parts: int, depth: int):
    """A block's distinct grams and words with their counts in training texts, in chunks by part."""

    def chunks(block: tuple[int, int], words: Counter[bytes], held: list[tuple[np.ndarray, np.ndarray]], texts: int) -> pa.RecordBatch:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w, 4) for w in words), np.uint64, len(words))
        rows = []
        for kind, (keys, n) in enumerate((_merged(held), _merged([(hashes, np.fromiter(words.values(), np.int64, len(words)))]))):
            rows += [(*block, kind, *c) for c in _chunks(keys, n.astype(np.int32 if n.max(initial=0) < 2**31 else np.int64), _part(keys, parts))]
        each = [texts, *(0 for _ in rows[1:])]  # counted once, with the block's first chunk
        return pa.RecordBatch.from_arrays([*(pa.array(list(c), t) for c, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))), pa.array(each, pa.int64())], ["split", "block", "kind", "part", "keys", "vals", "texts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, words, held, texts, size = None, Counter(), [], 0, 0
        for block, b in _runs(batches, "split", "block"):
            if block != at:
                if at is not None:
                    yield chunks(at, words, held, texts)
                at, words, held, texts, size = block, Counter(), [], 0, 0
            for rows in _unpacked(b.column("pack")):
                for wanted in (True, False):
                    some = [words_of(t) for t, x in zip(rows.column("text").to_pylist(), rows.column("trains").to_pylist()) if x == wanted]
                    if not some:
                        continue
                    keys = np.sort(grams(some, depth)[0])
                    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
                    held.append((keys[first], np.diff(np.append(first, len(keys))) if wanted else np.zeros(len(first), np.int64)))
                    size += len(first)
                    for w in some:
                        words.update(w if wanted else dict.fromkeys(w, 0))
                    texts += wanted * len(some)
                if size > MERGE:
                    held = [_merged(held)]
                    size = 0
        if at is not None:
            yield chunks(at, words, held, texts)

    return run


def _counts(keys: bytes, vals: bytes) -> tuple[np.ndarray, np.ndarray]:
    z = np.frombuffer(zstandard.ZstdDecompressor().decompress(keys), np.uint8).size // 8
    n = zstandard.frame_content_size(vals)
    k, v = _unpack(keys, vals, "<i4" if n == 4 * z else "<i8")
    return k, v.astype(np.int64)


def _by_part(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of batches sorted by their first column, in runs of the same value."""
    held: list[tuple] = []
    for b in batches:
        for row in zip(*(b.column(c).to_pylist() for c in columns)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


def _summed(subs: int, depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches, ["part", "kind", "keys", "vals"]):
            out, seen, total, distinct = [], 0, 0, 0
            for kind in (0, 1):
                some = [_counts(k, v) for _, x, k, v in rows if x == kind]
                if not some:
                    continue
                keys, n = _merged(some)
                if kind:
                    total, distinct = int(n.sum()), int((n > 0).sum())
                else:
                    latest = latest_first(keys, depth)[0] >> np.uint64(8 * (depth - 3))
                    out = list(_chunks(keys, n.astype(np.int64), _part(latest, subs)))
            out = [(*c, 0, 0) for c in out] + [(-1, b"", b"", total, distinct)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64()))], ["sub", "keys", "vals", "total", "distinct"])

    return run


def _nodes(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches, ["sub", "keys", "vals"]):
            level = subtree(*_merged([_unpack(k, v, "<i8") for _, k, v in rows]), depth=depth)
            up = ((level.key >> np.uint64(16)) << np.uint64(8)) | (level.key & np.uint64(255))
            yield pa.RecordBatch.from_arrays([pa.array(up.view(np.int64)), pa.array(level.zeros), pa.array(level.ones), pa.array(level.log_w)], ["key", "zeros", "ones", "below"])

    return run


def _probabilities(parts: int, top: list[Level], depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_part(batches, ["sub", "keys", "vals"]):
            keys, n = _merged([_unpack(k, v, "<i8") for _, k, v in rows])
            out = list(_chunks(keys, subtree(keys, n, top, depth), _part(keys, parts)))
            none = pa.array([-1] * len(out), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array([0] * len(out), pa.int32()), none, none, *(pa.array(list(c), t) for c, t in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary())))], ["kind", "split", "block", "part", "keys", "vals"])

    return run


def _returned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each block's chunks of grams and words get: log10 probabilities, and counts."""
    for rows in _by_part(batches, ["part", "kind", "split", "block", "keys", "vals"]):
        known = [_unpack(k, v, "<f8") for _, _, split, _, k, v in rows if split < 0]
        keys, logs = np.concatenate([k for k, _ in known] or [np.zeros(0, np.uint64)]), np.concatenate([v for _, v in known] or [np.zeros(0)])
        order = np.argsort(keys)
        keys, logs = keys[order], logs[order]
        words = _merged([_counts(k, v) for _, kind, _, _, k, v in rows if kind == 1] or [(np.zeros(0, np.uint64), np.zeros(0, np.int64))])
        for _, kind, split, block, k, v in rows:
            if split < 0:
                continue
            own = _counts(k, v)[0]
            value = words[1][np.searchsorted(words[0], own)].astype(np.float64) if kind else logs[np.searchsorted(keys, own)]
            packed = _pack(own, value)
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int32()) for x in (split, block, kind)] + [pa.array([packed[0]]), pa.array([packed[1]])], ["split", "block", "kind", "keys", "vals"])


class _WordLogs(dict):
    """A word's base score, from the count that its block got for it."""

    def __init__(self, counts: dict[int, float], total: float):
        super().__init__()
        self.counts, self.total = counts, total

    def __missing__(self, word: bytes) -> float:
        out = self[word] = math.log10((self.counts[xxhash.xxh64_intdigest(word, 4)] + 0.5) / self.total)
        return out


def _scored(n_train: int, distinct: int, texts: int, depth: int):
    total = n_train + 0.5 * (distinct + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, chunks, ready = None, [], None
        for (block, is_text), b in _runs(batches, "block", "is_text"):
            if block != at:
                at, chunks, ready = block, [], None
            if not is_text:
                chunks += zip(*(b.column(c).to_pylist() for c in ("kind", "keys", "vals")))
                continue
            if ready is None:
                both = [[_unpack(k, v, "<f8") for kind, k, v in chunks if kind == x] for x in (0, 1)]
                join = lambda some, i, kind: np.concatenate([x[i] for x in some] or [np.zeros(0, kind)])
                ready = KeyTable(join(both[0], 0, np.uint64), join(both[0], 1, float)), _WordLogs(dict(zip(join(both[1], 0, np.uint64).tolist(), join(both[1], 1, float).tolist())), total)
                chunks = []
            logs, base = ready
            unknown, last = math.log10(0.5 / total), math.log10((texts + 0.5) / total)
            for rows in _unpacked(b.column("pack")):
                some = [words_of(t) for t in rows.column("text").to_pylist()]
                keys, sizes = grams(some, depth)
                score = np.add.reduceat(logs[keys], np.cumsum(sizes) - sizes)
                each = [list(map(base.__getitem__, w)) for w in some]
                out = [(len(e) + 1, len(e) - e.count(unknown) + (texts > 0), math.fsum(e) + last) for e in each]
                yield pa.RecordBatch.from_arrays([rows.column("doc_id"), *(pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.float64()))), pa.array(score), pa.array(sizes), pa.array(-score / (sizes * math.log10(2)))], ["doc_id", "n_tokens", "n_known", "base_score", "score", "n_bytes", "bits_per_byte"])

    return run


def score_texts(docs: DataFrame, trains, depth: int = DEPTH, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) for every row of ``docs`` (doc_id, text).

    ``trains``: a boolean column expression; where it is true the text is learnt from, null counts as true. ``score`` is
    the log10 probability of the text's words joined by single spaces, A-Z in lower case, and of its end; ``n_bytes`` its
    bytes with the end, ``bits_per_byte`` its code length in bits for each of them. ``base_score`` is that of a smoothed
    count of words. ``depth`` context bytes are mixed over, and blocks are full from ``block`` bytes on. Null texts count
    as empty: they have their end alone. Without training texts all estimates are one half. No text is cut, however long.
    Repeated rows count each, a null doc_id stays null, other columns are not read. An empty table gives no
    rows. Words are counted by a 64-bit hash.
    """
    if not 3 <= depth <= 7:
        raise ValueError("depth must be from 3 to 7")
    tuned(docs)
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.coalesce(trains, F.lit(True)).alias("trains"))
    blocks = written(src.mapInArrow(_blocked(block), "split int, block int, pack binary"))
    splits = (blocks.agg(F.max("split")).first()[0] or 0) + 1
    parts = max(16, 2 * splits)  # the chunks of all blocks for a part are as much at every size
    sent = written(blocks.mapInArrow(_gathered(parts, depth), "split int, block int, kind int, part int, keys binary, vals binary, texts long"))
    by = lambda df, c: df.repartitionById(parts, F.col(c)).sortWithinPartitions(c)
    summed = written(by(sent.select("part", "kind", "keys", "vals"), "part").mapInArrow(_summed(parts, depth), "sub int, keys binary, vals binary, total long, distinct long"))
    texts = int(sent.agg(F.sum("texts")).first()[0] or 0)
    total, distinct = (int(x or 0) for x in summed.agg(F.sum("total"), F.sum("distinct")).first())
    by_sub = by(summed.where("sub >= 0").select("sub", "keys", "vals"), "sub")
    # the nodes at depth 2: 65,536 contexts times 255 places at most, some 100,000 in texts
    top = top_levels(by_sub.mapInArrow(_nodes(depth), "key long, zeros double, ones double, below double").groupBy("key").agg(F.sum("zeros"), F.sum("ones"), F.sum("below")).toArrow())
    logs = by_sub.mapInArrow(_probabilities(parts, top, depth), "kind int, split int, block int, part int, keys binary, vals binary")
    back = written(by(sent.select("kind", "split", "block", "part", "keys", "vals").unionByName(logs), "part").mapInArrow(_returned, "split int, block int, kind int, keys binary, vals binary"))
    forget(sent, summed)
    none = lambda c, t: F.lit(None).cast(t).alias(c)
    rows = back.select("split", "block", F.lit(0).alias("is_text"), "kind", "keys", "vals", none("pack", "binary"))
    rows = rows.unionByName(blocks.select("split", "block", F.lit(1).alias("is_text"), none("kind", "int"), none("keys", "binary"), none("vals", "binary"), "pack"))
    n_train = total + texts
    out = rows.repartitionById(splits, F.col("split")).sortWithinPartitions("block", "is_text").drop("split")
    out = out.mapInArrow(_scored(n_train, distinct + (texts > 0), texts, depth), "doc_id long, n_tokens long, n_known long, base_score double, score double, n_bytes long, bits_per_byte double")
    return out.withColumn("train_tokens", F.lit(n_train).cast("long"))
