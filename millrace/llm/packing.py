"""Token ids packed into binary matrices by best-fit decreasing.

Every text's ids end with the end-of-text id. Texts longer than a row are split without
loss into whole rows and a rest. Texts are packed a shard at a time (consecutive texts
of one partition, about ``SHARD_TOKENS`` tokens), so nothing is shuffled and memory
doesn't grow with the data; the shards, and so which texts share a row, follow the
layout of the input's files. Pieces go, longest first, into the open row with the least
room that holds them; a segment tree over room left finds it. A row's unused places hold
the padding id.

A shard is one output row: ``ids`` (row-major little-endian matrix of uint16, or uint32
where the vocabulary, the end or the padding id needs it), and by segment in order its
matrix row, doc_id, piece number and length; ``cu_seqlens`` are the cumulative lengths
within each matrix row, and ``resets`` the places of the flat matrix at which position
ids begin again at 0: every segment's first, and a row's first padding. ``positions``
makes the position ids of them.

Defined cases: a null or empty text is the end-of-text id alone; a null doc_id stays
null; repeated rows are packed repeatedly; other columns are ignored; an empty table
gives an empty result. Ids are those of the rank file under the pattern, without special
tokens, as the tiktoken library gives them; texts with a run of over ``LONG_RUN``
characters without, or of, white space go to the linear codec of ``bpe``, which gives the same.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.bpe import Codec, read_ranks
from millrace.llm.common import sole, tune

SHARD_TOKENS, LONG_RUN = 1 << 20, 2000
_LONG = re.compile(rf"\S{{{LONG_RUN}}}|\s{{{LONG_RUN}}}").search


class Encoder:
    """Ids of texts as arrays of the smallest kind that holds the vocabulary and these further ids."""

    def __init__(self, path: str, pattern: str, *more: int):
        ranks = read_ranks(path)
        self.pattern, self.ranks, self.slow = pattern, ranks, None
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.kind = np.dtype("<u2" if max(*ranks.values(), *more) < 1 << 16 else "<u4")

    def __call__(self, text: str) -> np.ndarray:
        if _LONG(text) is None:
            return self.fast.encode_to_numpy(text, disallowed_special=())
        self.slow = self.slow or Codec(self.ranks, self.pattern)
        return np.array(self.slow.encode(text), np.uint32)


_encoders: dict[tuple, Encoder] = {}


def encoder(*key) -> Encoder:
    sole("packing", _encoders.clear)
    if key not in _encoders:
        _encoders[key] = Encoder(*key)
    return _encoders[key]


class Rooms:
    """Open rows by room left; a segment tree over 0..capacity says which rooms have a row."""

    def __init__(self, capacity: int):
        self.n = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.n)
        self.rows: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, room: int, row: int) -> None:
        self.rows[room].append(row)
        i = room + self.n
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """The row with the least room of at least size, with that room."""
        i, count = size + self.n, self.count
        if not count[i]:
            while i > 1 and (i & 1 or not count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.n:
                i = 2 * i if count[2 * i] else 2 * i + 1
        room = i - self.n
        while i:
            count[i] -= 1
            i >>= 1
        return self.rows[room].pop(), room


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], int]:
    """The row of each size, taken longest first (ties in order), and the number of rows."""
    rooms, where, n = Rooms(capacity), [0] * len(sizes), 0
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        got = rooms.take(sizes[i])
        if got is None:
            row, room = n, capacity
            n += 1
        else:
            row, room = got
        where[i] = row
        rooms.add(room - sizes[i], row)
    return where, n


def positions(resets: np.ndarray, size: int) -> np.ndarray:
    """Position ids of a flat matrix of so many places that begin again at these."""
    starts = np.zeros(size, np.int64)
    starts[resets] = resets
    return np.arange(size) - np.maximum.accumulate(starts)


def _pack(shard: list[tuple[int | None, np.ndarray]], length: int, pad: int, kind) -> dict:
    parts = [(d, p, ids[a : a + length]) for d, ids in shard for p, a in enumerate(range(0, len(ids), length))]
    where, n = best_fit([len(x[2]) for x in parts], length)
    matrix, filled = np.full((n, length), pad, kind), [0] * n
    segments: list[list] = [[] for _ in range(n)]
    for (doc, part, ids), row in zip(parts, where):
        start = filled[row]
        matrix[row, start : start + len(ids)] = ids
        filled[row] += len(ids)
        segments[row].append((row, doc, part, len(ids), filled[row], row * length + start))
    flat = [s for row in segments for s in row]
    rows, docs, numbers, lens, cu, resets = (list(c) for c in zip(*flat))
    resets = sorted(resets + [row * length + used for row, used in enumerate(filled) if used < length])
    return {"n_rows": n, "row_length": length, "ids": matrix.tobytes(), "seg_row": rows, "doc_id": docs, "part": numbers, "seg_length": lens, "cu_seqlens": cu, "resets": resets}


_SCHEMA = "n_rows long, row_length long, ids binary, seg_row array<int>, doc_id array<long>, part array<int>, seg_length array<int>, cu_seqlens array<int>, resets array<int>"
_ARROW = pa.schema([("n_rows", pa.int64()), ("row_length", pa.int64()), ("ids", pa.binary()), ("seg_row", pa.list_(pa.int32())), ("doc_id", pa.list_(pa.int64())), *((c, pa.list_(pa.int32())) for c in ("part", "seg_length", "cu_seqlens", "resets"))])


def pack(docs: DataFrame, path: str, pattern: str, length: int = 2048, end: int = 50256, pad: int = 50256) -> DataFrame:
    """One row a shard, as the module says."""

    def each(batches):
        ids_of, shard, n = encoder(path, pattern, end, pad), [], 0
        for b in batches:
            for doc_id, text in zip(b["doc_id"].to_pylist(), b["text"].to_pylist()):
                ids = np.append(ids_of(text or ""), end).astype(ids_of.kind)
                shard.append((doc_id, ids))
                n += len(ids)
                if n >= SHARD_TOKENS:
                    yield pa.RecordBatch.from_pylist([_pack(shard, length, pad, ids_of.kind)], _ARROW)
                    shard, n = [], 0
        if shard:
            yield pa.RecordBatch.from_pylist([_pack(shard, length, pad, ids_of.kind)], _ARROW)

    tune(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, _SCHEMA)


def unpack(row: dict) -> list[tuple[int | None, int, list[int]]]:
    """(doc_id, part, ids) of every segment of an output row."""
    width = len(row["ids"]) // max(1, row["n_rows"] * row["row_length"])
    matrix = np.frombuffer(row["ids"], f"<u{width}").reshape(row["n_rows"], row["row_length"])
    return [(d, p, matrix[r, z - n : z].tolist()) for r, d, p, n, z in zip(row["seg_row"], row["doc_id"], row["part"], row["seg_length"], row["cu_seqlens"])]
