"""Vector bin packing of training examples.

An example takes up three things at once: tokens, one segment, and loss-bearing tokens. A sequence has a
capacity for each. The dot-product heuristic fills one sequence at a time: of the examples that fit, it takes
the one whose demand points most in the direction of what the sequence has left. Each task packs its own
split as it streams by, so nothing is shuffled, and a lost task packs the same rows the same way again.
"""

from __future__ import annotations

import base64
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import tuned

#: Examples that wait in a task for a sequence, whole ones and such that may be cut. They bound its memory, not what is packed.
POOL, CUT_POOL = 2048, 256
#: The sequence's number, above the bits that count within a task.
SHIFT = 40
#: Characters of texts whose words are tokenized together.
TOGETHER = 12_000_000


# White space beside a space or at an end; what Unicode and Python call white space.
_WHITE = r"\t-\r\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_ODD = rf"(?:\A|[ ])(?:[{_WHITE}]|\z)|[{_WHITE}](?:[ ]|\z)"


class Limits(NamedTuple):
    tokens: int = 1024
    segments: int = 256
    loss_tokens: int = 1024


class Placed(NamedTuple):
    key: int
    start: int
    length: int
    sequence: int
    offset: int


class VectorPacker:
    """Packs (tokens, 1, loss tokens) demands. With ``cut``, an example may be cut to fill a sequence up."""

    def __init__(self, limits: Limits = Limits(), cut: bool = False, pool: int = POOL):
        self.caps = np.array(limits, np.float64)
        self.cut, self.pool, self.sequence = cut, pool, 0
        self.waiting: list[tuple[int, int, int, int]] = []

    def add(self, key: int, tokens: int, loss_tokens: int, start: int = 0) -> Iterator[Placed]:
        """Queues an example; yields what got its place meanwhile."""
        if tokens > self.caps[0] or loss_tokens > self.caps[2]:
            if not self.cut:  # it fits nowhere: a sequence of its own
                yield Placed(key, start, tokens, self._next(), 0)
                return
            whole = int(min(self.caps[0], self.caps[2]))
            while tokens >= whole:
                yield Placed(key, start, whole, self._next(), 0)
                start, tokens = start + whole, tokens - whole
            loss_tokens = min(loss_tokens, tokens)
        if tokens:
            self.waiting.append((key, start, tokens, loss_tokens))
        if len(self.waiting) >= self.pool:
            yield from self.drain(self.pool // 2)

    def _next(self) -> int:
        self.sequence += 1
        return self.sequence - 1

    def drain(self, down_to: int = 0) -> Iterator[Placed]:
        """Fills sequences until at most ``down_to`` examples wait."""
        key = np.array([x[0] for x in self.waiting], np.int64)
        start = np.array([x[1] for x in self.waiting], np.int64)
        demand = np.array([(x[2], 1, x[3]) for x in self.waiting], np.float64).reshape(-1, 3)
        left = np.ones(len(key), bool)
        n_left = len(key)
        while n_left > down_to:
            room, offset, last, at = self.caps.copy(), 0, down_to == 0, self._next()
            whole: list[Placed] = []
            while n_left and room[0] > 0 and room[1] > 0:
                fits = left & (demand <= room).all(axis=1)
                if fits.any():
                    score = (demand / self.caps) @ (room / self.caps)
                    best = int(np.argmax(np.where(fits, score, -1)))
                    whole.append(Placed(int(key[best]), int(start[best]), int(demand[best, 0]), at, offset))
                    left[best], n_left = False, n_left - 1
                    room -= demand[best]
                elif self.cut:
                    best = int(np.argmax(np.where(left, demand[:, 0], -1)))
                    take = int(min(room[0], room[2]))
                    if take <= 0:
                        break
                    whole.append(Placed(int(key[best]), int(start[best]), take, at, offset))
                    start[best] += take
                    demand[best] -= (take, 0, min(take, demand[best, 2]))
                    room -= (take, 1, take)
                else:
                    break
                offset += whole[-1].length
            if last and self.cut and n_left == 0:
                whole = self._tail(whole)
            yield from whole
        self.waiting = [(int(key[i]), int(start[i]), int(demand[i, 0]), int(demand[i, 2])) for i in np.flatnonzero(left)]

    def _tail(self, placed: list[Placed]) -> list[Placed]:
        """The last, partly filled sequence as sequences of powers of two, which need no padding."""
        total = sum(p.length for p in placed)
        out, at, room, offset = [], placed[0].sequence, 0, 0
        sizes = [1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1]
        for p in placed:
            start, length = p.start, p.length
            while length:
                if not room:
                    at = p.sequence if not out else self._next()
                    room, offset = sizes.pop(0), 0
                take = min(room, length)
                out.append(Placed(p.key, start, take, at, offset))
                start, length, room, offset = start + take, length - take, room - take, offset + take
        return out


def pack_examples(df: DataFrame, id_col: str, tokens_col: str, loss_col: str, limits: Limits = Limits()) -> DataFrame:
    """Packs whole examples of given sizes; returns (id, sequence_id, offset, length, oversize).

    A null or negative size counts as 0 and an example of no tokens gets no place, its sequence_id is null. An
    example over a limit gets a sequence of its own and is marked ``oversize``. Loss tokens count up to the tokens.
    """
    src = df.select(F.col(id_col).alias("id"), *(F.greatest(F.coalesce(F.col(c).cast("long"), F.lit(0)), F.lit(0)).alias(n) for c, n in ((tokens_col, "tokens"), (loss_col, "loss"))))
    schema = f"id {src.schema['id'].dataType.simpleString()}, sequence_id long, offset long, length long, oversize boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, ids, count = VectorPacker(limits), TaskContext.get().partitionId() << SHIFT, {}, 0

        def rows(placed: list[Placed]) -> pa.RecordBatch:
            own = [ids.pop(p.key) for p in placed]
            return pa.RecordBatch.from_arrays([
                pa.array(own, b.schema.field("id").type), pa.array([base + p.sequence for p in placed], pa.int64()),
                pa.array([p.offset for p in placed], pa.int64()), pa.array([p.length for p in placed], pa.int64()),
                pa.array([p.length > limits.tokens for p in placed], pa.bool_()),
            ], ["id", "sequence_id", "offset", "length", "oversize"])

        b = None
        for b in batches:
            placed: list[Placed] = []
            none = []
            for i, n, loss in zip(*(b.column(c).to_pylist() for c in ("id", "tokens", "loss"))):
                if not n:
                    none.append(i)
                    continue
                ids[count] = i
                placed += packer.add(count, n, min(n, loss))
                count += 1
            yield rows(placed)
            if none:
                k = len(none)
                yield pa.RecordBatch.from_arrays([pa.array(none, b.schema.field("id").type), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.array([0] * k, pa.int64()), pa.array([False] * k)], ["id", "sequence_id", "offset", "length", "oversize"])
        if b is not None:
            yield rows(list(packer.drain()))

    tuned(df)
    return src.mapInArrow(run, schema)


class WordIds:
    """From texts to their ids as little-endian 32-bit bytes; the distinct words of many texts are tokenized together.

    The tokenizer's own pattern never joins what stands on both sides of a single space between other characters, so a
    space and the word after it have the same ids everywhere. Words are found and numbered by Arrow, tokenized in one
    go, told apart by their bytes, and put in the words' places. Texts with other white space beside a space or at an
    end, or with a special token, are tokenized whole.
    """

    def __init__(self, ranks_path: str, pattern: str, special: dict[str, int]):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("byte_bpe", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.special = set(special)
        self.sizes = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, rank in ranks.items():
            self.sizes[rank] = len(token)

    def _whole(self, text: str) -> bytes:
        return np.array(self.encoding.encode(text, allowed_special=self.special), "<u4").tobytes()

    def ids_of(self, texts: list[str]) -> list[bytes]:
        out, some, size = [], [], 0
        for t in texts:
            some.append(t)
            size += len(t)
            if size >= TOGETHER:
                out += self._together(some)
                some, size = [], 0
        return out + (self._together(some) if some else [])

    def _together(self, texts: list[str]) -> list[bytes]:
        first, pieces = [], []  # very long texts are cut at spaces, so that arrays stay small
        for t in texts:
            first.append(len(pieces))
            lo = 0
            while lo + TOGETHER < len(t) and (cut := t.find(" ", lo + TOGETHER // 2)) >= 0:
                pieces.append(t[lo:cut])
                lo = cut + 1
            pieces.append(t[lo:])
        odd = pc.match_substring_regex(pa.array(pieces, pa.string()), _ODD).to_numpy(zero_copy_only=False)
        ends = [*first[1:], len(pieces)]
        odd = np.add.reduceat(odd, first) > 0
        fine = ~np.repeat(odd, np.diff(first, append=len(pieces)))
        begins = np.isin(np.arange(len(pieces)), first)
        out: list[bytes] = [b""] * len(pieces)
        lo = 0
        while lo < len(pieces):
            hi, size = lo, 0
            while hi < len(pieces) and size < TOGETHER:
                size += len(pieces[hi])
                hi += 1
            at = lo + np.flatnonzero(fine[lo:hi])
            for k, ids in zip(at.tolist(), self._pieces([pieces[k] for k in at], begins[at]) if len(at) else []):
                out[k] = ids
            lo = hi
        return [self._whole(t) if x or any(s in t for s in self.special) else b"".join(out[a:b]) for t, x, a, b in zip(texts, odd.tolist(), first, ends)]

    def _pieces(self, pieces: list[str], begins: np.ndarray) -> list[bytes]:
        """Each piece's ids. ``begins``: no space stands before the piece."""
        split = pc.split_pattern(pa.array(pieces, pa.string()), " ")
        ends = split.offsets.to_numpy()
        coded = split.flatten().dictionary_encode()
        code, words = coded.indices.to_numpy().astype(np.int64), coded.dictionary
        joined = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words), " ")[0].as_py()
        ids = np.array(self.encoding.encode_ordinary(" " + joined), "<u4")
        last = np.searchsorted(np.cumsum(self.sizes[ids]), np.cumsum(pc.binary_length(words).to_numpy().astype(np.int64) + 1)) + 1
        # a first word has no space before it, and ids of its own
        at = np.flatnonzero(begins)
        own = [self.encoding.encode_ordinary(w) for w in words.take(pa.array(code[ends[at]])).to_pylist()]
        code[ends[at]] = len(words) + np.arange(len(at))
        count = np.concatenate([np.diff(last, prepend=0), np.array([len(f) for f in own], np.int64)])
        ids = np.concatenate([ids, np.array([i for f in own for i in f], "<u4")])
        n = count[code]
        place = np.cumsum(n) - n
        data = ids[np.arange(n.sum()) + np.repeat((np.cumsum(count) - count)[code] - place, n)].tobytes()
        stop = (4 * np.append(place, n.sum())[ends]).tolist()
        return [data[a:b] for a, b in zip(stop[:-1], stop[1:])]

    def ids(self, text: str) -> bytes:
        return self.ids_of([text])[0]


def _filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches put together up to the bytes whose words are tokenized together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.nbytes for x in held) >= TOGETHER:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


def pack_documents(docs: DataFrame, ranks_path: str, pattern: str, special: dict[str, int], limits: Limits = Limits(), end_id: int = 0) -> DataFrame:
    """Tokenizes texts, ends each with ``end_id``, and packs them, cutting freely; one row for each piece.

    A null text counts as empty and gets a piece of its end id alone; a null doc_id stays null. Repeated rows are
    packed each for itself. Only the last sequence of a task can be partly filled; it is cut into powers of two.
    An empty table gives no rows. Other columns are not read.
    """
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    src = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, packer = WordIds(ranks_path, pattern, special), VectorPacker(limits, cut=True, pool=CUT_POOL)
        base, end, count = TaskContext.get().partitionId() << SHIFT, np.array([end_id], "<u4").tobytes(), 0
        held: dict[int, list] = {}  # documents not wholly placed: id, ids from ``first`` on, first, tokens, tokens to place

        def rows(placed: list[Placed]) -> pa.RecordBatch:
            out: list[tuple] = []
            for p in placed:
                doc = held[p.key]
                cut = doc[1][4 * (p.start - doc[2]) : 4 * (p.start - doc[2] + p.length)]
                out.append((doc[0], p.start, p.length, zlib.crc32(cut), doc[3], base + p.sequence, p.offset))
                doc[4] -= p.length
                if not doc[4]:
                    del held[p.key]
            return pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*out)] if out else [pa.array([], pa.int64())] * 7, names)

        for some in _filled(batches):
            placed = []
            fresh: list[int] = []
            for i, ids in zip(some.column("doc_id").to_pylist(), words.ids_of([t or "" for t in some.column("text").to_pylist()])):
                ids += end
                n = len(ids) // 4
                held[count] = [i, ids, 0, n, n]
                fresh.append(count)
                placed += packer.add(count, n, n)
                count += 1
            yield rows(placed)
            for k in fresh:  # of the rest, keep only what is still to place
                if k in held:
                    first = held[k][3] - held[k][4]
                    held[k][1], held[k][2] = held[k][1][4 * (first - held[k][2]) :], first
        yield rows(list(packer.drain()))

    tuned(docs)
    return src.mapInArrow(run, ", ".join(f"{n} long" for n in names))
