"""What the training-data operators share: scratch tables, word scanning, components.

Words are maximal runs of bytes outside ``\\x20\\x09-\\x0D``; a null text has none.
"""

from __future__ import annotations

import atexit
import ctypes
import gc
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

_own: dict[str, str] = {}


def tune(spark: SparkSession) -> SparkSession:
    """Small Arrow batches (texts can be long); shuffle files go when their query ends."""
    for key, value in {
        "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
        "spark.sql.execution.arrow.maxBytesPerBatch": str(8 << 20),
        "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    }.items():
        spark.conf.set(key, value)
    return spark


def scratch(spark: SparkSession) -> str:
    """This application's folder below spark.checkpoint.dir; where that is unset, a temp folder, which only a local master may have."""
    app = spark.sparkContext.applicationId
    if app not in _own:
        base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
        if base is None:
            if not spark.sparkContext.master.split("[")[0] == "local":
                raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = tempfile.mkdtemp(prefix="millrace-")
        _own[app] = path = f"{base.rstrip('/')}/millrace-{app}"
        atexit.register(_remove, spark, path)
    return _own[app]


def _remove(spark: SparkSession, path: str) -> None:
    try:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session may be gone by now; the cluster's own expiry then applies
        pass


def keep(df: DataFrame, parts: int | None = None) -> DataFrame:
    """Cut lineage: a Parquet table in the shared folder, read back with its own schema."""
    spark = df.sparkSession
    path = f"{scratch(spark)}/{uuid.uuid4().hex}"
    (df.coalesce(parts) if parts else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._millrace_path = path
    return out


def drop(*kept: DataFrame) -> None:
    """Deletes tables of ``keep`` that nothing reads any more."""
    for df in kept:
        _remove(df.sparkSession, df._millrace_path)


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underlines before those that a table has already (in any case)."""
    have = {c.lower() for c in taken}
    out = []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        out.append(n)
        have.add(n.lower())
    return out


_tenant: list = [None, lambda: None]


def sole(name: str, release: Callable[[], None]) -> None:
    """Says which operator uses this worker now. Workers go on from stage to stage: what another one memoised goes first."""
    if _tenant[0] != name:
        _tenant[1]()
        _tenant[:] = name, release
        gc.collect()
        libc = ctypes.CDLL(None)
        if hasattr(libc, "malloc_trim"):
            libc.malloc_trim(0)


# ---------------------------------------------------------------- words as arrays

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_KEYS = np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 63, (4, 2), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
LONG_WORD = 256


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Scan:
    """The words of some texts: byte bounds, each text's first word, and hashes of words and n-grams."""

    def __init__(self, texts: pa.Array):
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.cast(pa.large_string()).fill_null("")
        off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        body = texts.buffers()[2] if len(texts) else None
        self.bytes = np.frombuffer(body, np.uint8)[off[0] : off[-1]] if body is not None and off[-1] > off[0] else np.zeros(0, np.uint8)
        self.off = off - off[0]
        n = len(self.bytes)
        space = _SPACE[self.bytes]
        before, after = np.ones(n, bool), np.ones(n, bool)
        before[1:], after[:-1] = space[:-1], space[1:]
        inner = self.off[(self.off > 0) & (self.off < n)]
        before[inner], after[inner - 1] = True, True
        self.space = space
        self.starts = np.flatnonzero(~space & before)
        self.ends = np.flatnonzero(~space & after) + 1
        self.first = np.searchsorted(self.starts, self.off)
        self.n_words = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(self.n_words)), self.n_words)

    def hashes(self, key: int = 0) -> np.ndarray:
        """A 64-bit hash of each word; keys 0 to 3 give independent ones. Eight bytes a step, chained through a bijective mixer."""
        first, second = _KEYS[key]
        if not len(self.starts):
            return np.zeros(0, np.uint64)
        padded = np.concatenate([self.bytes, np.zeros(8, np.uint8)])
        eight = np.ndarray((len(self.bytes) + 1,), "<u8", padded.data, strides=(1,))
        size = self.ends - self.starts
        out = mix((eight[self.starts] & _LOW[np.minimum(size, 8)]) ^ first) + size.astype(np.uint64) * second
        at, step = np.flatnonzero((size > 8) & (size <= LONG_WORD)), 8
        while len(at):
            part = eight[self.starts[at] + step] & _LOW[np.minimum(size[at] - step, 8)]
            out[at] = mix(out[at]) * second + mix(part ^ first)
            step += 8
            at = at[size[at] > step]
        for i in np.flatnonzero(size > LONG_WORD):
            out[i] = xxhash.xxh3_64_intdigest(self.bytes[self.starts[i] : self.ends[i]].tobytes(), int(first))
        return mix(out)


def grams(words: np.ndarray, k: int, salt: int = 0x2545F4914F6CDD1D) -> np.ndarray:
    """A 64-bit hash of each k consecutive word hashes, text ends not regarded."""
    n = max(0, len(words) - k + 1)
    out = words[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(salt) + words[j : j + n]
    return mix(out)


def pieces(batch: pa.RecordBatch | pa.Table, column: str, limit: int = 1 << 20):
    """Slices of about ``limit`` bytes of a text column, so that work arrays stay small; a longer text stands alone."""
    size = pc.binary_length(batch[column]).fill_null(0).to_numpy(zero_copy_only=False)
    total, at = 0, 0
    for i, n in enumerate(size):
        if total and total + n > limit:
            yield batch.slice(at, i - at)
            total, at = 0, i
        total += int(n)
    if at < len(size):
        yield batch.slice(at)


def runs(batches, keys: list[str]):
    """From batches sorted by ``keys``: tables that never end within a run of equal keys."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        table = pa.Table.from_batches([batch])
        if rest is not None:
            table = pa.concat_tables([rest, table]).combine_chunks()
        same = np.ones(table.num_rows, bool)
        for k in keys:
            col = table[k].to_numpy(zero_copy_only=False)
            same &= col == col[-1]
        cut = table.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0
        if cut:
            yield table.slice(0, cut)
        rest = table.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest index that the links a-b connect it to."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        was = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        np.minimum.at(label, a, low)
        np.minimum.at(label, b, low)
        label = label[label]
        if (label == was).all():
            break
    return label


# ---------------------------------------------------------------- components

def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the links (a, b): the smallest node reachable.

    Alternating large-star and small-star steps; each step's links are written to the
    shared folder. Only two numbers a round come to the driver. A hub's links can be
    split: each join reads two plain tables, and what follows it is pre-aggregated.
    """
    now = keep(
        edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    mark = _mark(now)
    while mark[0]:
        before = now
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = keep(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")))
        large = keep(both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct())
        least = keep(large.groupBy("a").agg(F.min("b").alias("m")))
        small = large.join(least, "a").select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        now = keep(small.distinct())
        drop(before, low, large, least)
        was, mark = mark, _mark(now)
        if was == mark:
            break
    ends = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    tops = now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    return ends.unionByName(tops)


def _mark(edges: DataFrame) -> tuple:
    row = edges.agg(
        F.count("*"),
        F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)),
        F.coalesce(F.sum(F.col("b").cast("decimal(38,0)")), F.lit(0)),
    ).first()
    return tuple(row)
