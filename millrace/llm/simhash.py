"""SimHash near-duplicates through pivot distance tables.

A fingerprint's coordinates are its Hamming distances to fixed reference fingerprints
(pivots). By the triangle inequality two fingerprints within ``bits`` of each other
differ by at most ``bits`` in every coordinate, so a pair with a larger maximum
coordinate difference is discarded before its exact distance is taken.

Which pairs are looked at: random pivots leave about half of all pairs each, so cells of
quantised coordinates would send a row to 1.75 cells a pivot for 0.6 of the rows each: more
copies than pairs of chunks, whatever their number. So 64 bits are cut into ``bits + 3``
blocks; two fingerprints within ``bits`` agree wholly in some 3 of them, and only
fingerprints that agree in 3 given blocks (about 32 bits) meet. A bucket is sorted by the
first coordinate, and a row paired with those within ``bits`` of its own only; the other
coordinates discard more. Equal fingerprints are one class beforehand. A crowded bucket is
dealt to pairs of chunks, each a group of its own, and a group gives a spanning forest of
its links, never all of them.

``similar`` is for a similarity instead of a number of bits (five words and a Jaccard
similarity of 0.8 unless told otherwise). Such texts differ by so many bits (19 of 128 at
0.8) that neither blocks of bits nor references chosen without regard to the texts tell
them from others. So texts meet where the least hashes of their shingles agree (12 bands of
4: 99.8 % of pairs at 0.8 exactly, more above it); a group's references are fingerprints of
its own texts, which do discard pairs; and survivors are verified on the whole sets of
shingles, in the group. Texts with one set are one class beforehand. A crowded bucket goes
in chunks: first each by itself, then one text of each component found, then whatever texts
are still in different components, so that a large group of near copies is no square.

Defined cases: null or wordless text has fingerprint 0 and links like any other; equal
fingerprints link; repeated doc_ids stay repeated rows; a null doc_id stands in no
component's minimum, and a component of null ids alone is null; other columns are
ignored; an empty table gives an empty result. A single text must fit a worker.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import Scan, components, grams, keep, mix, pieces, roots, runs, sole, tune

PIVOTS = np.random.Generator(np.random.PCG64(64)).integers(0, 1 << 64, 24, dtype=np.uint64)
CHUNK = 256


def fingerprint(text: str | bytes | None, shingle: int = 3) -> int:
    """Majority bits of the XXH64 (seed 42) of the text's word shingles, A-Z lowered."""
    words = (text.encode() if isinstance(text, str) else text or b"").lower().split()
    if not words:
        return 0
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(b" ".join(words), 42)
    joined, digest = b" ".join(words), xxhash.xxh64_digest
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = len(words) - shingle + 1
    votes, step = np.zeros(64, np.int64), 1 << 16
    spans = zip(starts[:n].tolist(), ends[shingle - 1 :].tolist())
    hashes = b"".join([digest(joined[s:e], 42) for s, e in spans])
    for at in range(0, n, step):
        part = np.frombuffer(hashes, np.uint8)[8 * at : 8 * (at + step)]
        votes += np.unpackbits(part).reshape(-1, 64).sum(0, dtype=np.uint32)
    return int.from_bytes(np.packbits(2 * votes > n).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp): the fingerprint as a signed long."""

    def each(batches):
        sole("simhash", lambda: None)
        for b in batches:
            got = np.array([fingerprint(t, shingle) for t in b["text"].to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(got.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, fp long")


def masks(bits: int) -> list[int]:
    """Bit masks of every choice of 3 out of bits + 3 blocks."""
    n = bits + 3
    cuts = [64 * i // n for i in range(n + 1)]
    blocks = [sum(1 << i for i in range(a, b)) for a, b in zip(cuts, cuts[1:])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    return [signed(x | y | z) for x, y, z in combinations(blocks, 3)]


def coordinates(fp: np.ndarray) -> np.ndarray:
    """The distance table: a row a fingerprint, its Hamming distance to each pivot."""
    return np.bitwise_count(fp[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def near(fp: np.ndarray, last: np.ndarray, table: np.ndarray, apart: np.ndarray | None, bits: int):
    """Pairs within ``bits``, of rows in groups (``last``: where a row's group ends) sorted by the first pivot's distance.

    A row is only paired with those after it whose first coordinate is at most ``bits`` more: a window of the sorted group.
    Of these pairs the other coordinates discard more, and the exact distance decides. ``apart``: only rows that differ in it are paired.
    """
    found, first, i, off = [], table[:, 0], np.arange(len(fp)), 1
    while len(i := i[i + off < last[i]]) and len(i := i[first[i + off] - first[i] <= bits]):
        a = i if apart is None else i[apart[i] != apart[i + off]]
        for p in range(1, len(PIVOTS)):
            if not len(a):
                break
            a = a[np.abs(table[a, p] - table[a + off, p]) <= bits]
        a = a[np.bitwise_count(fp[a] ^ fp[a + off]) <= bits]
        found.append((a, a + off))
        off += 1
    return (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int))


def _forest(bits: int):
    def links(table: pa.Table) -> pa.RecordBatch:
        col = {c: table[c].to_numpy() for c in ("t", "k", "lo", "hi", "c", "fp")}
        edge = np.ones(table.num_rows, bool)
        edge[1:] = False
        for c in ("t", "k", "lo", "hi"):
            edge[1:] |= col[c][1:] != col[c][:-1]
        group = np.cumsum(edge) - 1
        fp = col["fp"].view(np.uint64)
        order = np.lexsort((np.bitwise_count(fp ^ PIVOTS[0]), group))
        fp, n = fp[order], table.num_rows
        last = np.append(np.flatnonzero(edge)[1:], n)[group]
        # Rows of one chunk are all paired; of a pair of chunks, only rows of different ones.
        chunk = np.where(col["lo"] != col["hi"], col["c"], np.arange(n))[order]
        top = roots(n, *near(fp, last, coordinates(fp), chunk, bits))
        at = np.flatnonzero(top != np.arange(n))
        return pa.RecordBatch.from_arrays([pa.array(fp[at].view(np.int64)), pa.array(fp[top[at]].view(np.int64))], names=["a", "b"])

    def each(batches):
        for table in runs(batches, ["t", "k", "lo", "hi"]):
            yield links(table)

    return each


def buckets(classes: DataFrame, bits: int) -> DataFrame:
    """(t, k, lo, hi, c, fp): the groups in which fingerprints meet; k is what they agree in under mask t."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(m)).alias("k")) for t, m in enumerate(masks(bits))])
    rows = classes.select("fp", F.explode(tables).alias("x")).select("x.t", "x.k", "fp")
    full = keep(rows.groupBy("t", "k").agg(F.count("*").alias("n")).where("n > 1"))
    chunks = F.ceil(F.col("n") / F.lit(CHUNK)).cast("long")
    met = rows.join(full, ["t", "k"]).withColumn("c", F.pmod(F.xxhash64("fp"), chunks))
    return met.select("t", "k", "c", "fp", F.explode(F.sequence(F.lit(0).cast("long"), chunks - 1)).alias("o")).select(
        "t", "k", F.least("c", "o").alias("lo"), F.greatest("c", "o").alias("hi"), "c", "fp"
    )


def links(classes: DataFrame, bits: int = 3) -> DataFrame:
    """(a, b): links between fingerprints that connect just what all links within ``bits`` connect."""
    groups = buckets(classes, bits).repartition("t", "k", "lo", "hi").sortWithinPartitions("t", "k", "lo", "hi")
    return groups.mapInArrow(_forest(bits), "a long, b long")


def near_duplicates(docs: DataFrame, bits: int = 3, shingle: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) of every document."""
    tune(docs.sparkSession)
    prints = keep(fingerprints(docs, shingle))
    classes = keep(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    joined = components(links(classes, bits))
    of = classes.join(joined, F.col("fp") == F.col("node"), "left").select("fp", "rep", F.coalesce("component", "fp").alias("c"))
    of = keep(of)
    least = keep(of.groupBy("c").agg(F.min("rep").alias("component_id")))
    of = keep(of.join(least, "c").select("fp", "component_id"))
    return prints.join(of, "fp").select("doc_id", "fp", "component_id")


# ---------------------------------------------------------------- by similarity

LANES = (np.uint64(0x8F1BBCDCBFA53E0B), np.uint64(0x3C6EF372FE94F82B))
WIDE, VOTES = 64 * len(LANES), 1 << 16
BANDS, ROWS, REFERENCES = 12, 4, 8
_SALTS = np.random.Generator(np.random.PCG64(128)).integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' shingles of k words, A-Z lowered, and the text of each; a text of fewer words is one shingle."""
    scan = Scan(pc.ascii_lower(texts))
    words = scan.hashes()
    at = np.arange(max(0, len(words) - k + 1))
    at = at[scan.doc[at] == scan.doc[at + k - 1]] if len(at) else at
    g, doc = grams(words, k)[at] if len(at) else np.zeros(0, np.uint64), scan.doc[at]
    few = np.flatnonzero((scan.n_words > 0) & (scan.n_words < k))
    if len(few):
        whole = np.array([grams(words[scan.first[d] : scan.first[d + 1]], int(scan.n_words[d]))[0] for d in few], np.uint64)
        g, doc = np.concatenate([g, whole]), np.concatenate([doc, few])
        order = np.argsort(doc, kind="stable")
        g, doc = g[order], doc[order]
    return g, doc


def distinct_shingles(texts: pa.Array, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The same, each once a text, sorted by text and hash."""
    g, doc = shingles(texts, k)
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    once = np.ones(len(g), bool)
    once[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[once], doc[once]


def wide(g: np.ndarray, doc: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A row of majority bits of each text's set of shingles, a column a lane; a hash of the set; its size. Wordless texts have zeros."""
    out = np.zeros((texts, len(LANES)), np.uint64)
    count = np.bincount(doc, minlength=texts)
    for lane, salt in enumerate(LANES):
        votes = np.zeros((texts, 64), np.int64)
        for a in range(0, len(g), VOTES):
            d = doc[a : a + VOTES]
            heads = np.flatnonzero(np.diff(d, prepend=-1))
            bits = np.unpackbits(mix(g[a : a + VOTES] ^ salt).view(np.uint8)).reshape(-1, 64)
            votes[d[heads]] += np.add.reduceat(bits, heads, axis=0, dtype=np.uint32)
        out[:, lane] = np.packbits(2 * votes > count[:, None], axis=1).view(np.uint64)[:, 0]
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(g + LANES[0]), dtype=np.uint64)))
    ends = np.cumsum(count)
    return out, sums[ends] - sums[ends - count], count


def bands(g: np.ndarray, doc: np.ndarray, texts: int) -> np.ndarray:
    """A row a text: BANDS keys, each of the least values of its set under ROWS hash functions. Texts without shingles have zeros."""
    out = np.zeros((texts, BANDS), np.uint64)
    if len(g):
        heads = np.flatnonzero(np.diff(doc, prepend=-1))
        least = np.zeros((len(heads), ROWS), np.uint64)
        for band in range(BANDS):
            for row in range(ROWS):
                x = (g ^ (g >> np.uint64(29))) * _SALTS[band * ROWS + row]
                least[:, row] = np.minimum.reduceat(x ^ (x >> np.uint64(32)), heads)
            key = np.full(len(heads), band, np.uint64)
            for row in range(ROWS):
                key = mix(key + least[:, row])
            out[doc[heads], band] = key
    return out


def most_bits(similarity: float) -> int:
    """By how many bits of WIDE two sets of this similarity may differ: expected, and four deviations more."""
    apart = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(WIDE * apart + 4 * math.sqrt(WIDE * apart * (1 - apart)))


def linked(f: np.ndarray, sets: list[np.ndarray], label: np.ndarray, apart: np.ndarray | None, similarity: float) -> np.ndarray:
    """For each row of a group the smallest row that links of at least ``similarity`` or equal labels connect it to.

    f: fingerprints, a row each; sets: sorted shingles; ``apart``: only rows that differ in it are compared. Distances
    to a few of the group's fingerprints (the pivots) discard pairs whose coordinates differ by more than the bits
    allowed; the exact distance and the sizes discard more; the whole sets decide. Rows already connected are skipped.
    """
    n, most = len(sets), most_bits(similarity)
    size = np.array([len(x) for x in sets])
    if n == 2:
        same = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([0, int(same < similarity * (size.sum() - same))])
    pivots = f[np.unique(np.linspace(0, n - 1, min(n, REFERENCES)).astype(int))]
    distance = lambda x, y: sum(np.bitwise_count(x[:, lane] ^ y[lane]).astype(np.int16) for lane in range(f.shape[1]))
    table = np.stack([distance(f, p) for p in pivots], 1)
    own, at = np.unique(np.concatenate(sets), return_inverse=True)
    ends = np.cumsum(size)
    starts, flag = ends - size, np.zeros(len(own), bool)
    _, first, label = np.unique(label, return_index=True, return_inverse=True)
    top = first[label]  # rows of one component have the same top
    for i in range(1, n):
        j = np.flatnonzero((top[:i] != top[i]) & (np.abs(table[:i] - table[i]).max(1) <= most))
        if apart is not None:
            j = j[apart[j] != apart[i]]
        j = j[(np.minimum(size[j], size[i]) >= similarity * np.maximum(size[j], size[i])) & (distance(f[j], f[i]) <= most)]
        if not len(j):
            continue
        mine = at[starts[i] : ends[i]]
        flag[mine] = True
        spans = np.concatenate([at[starts[x] : ends[x]] for x in j])
        same = np.add.reduceat(flag[spans], np.cumsum(size[j]) - size[j], dtype=np.int64)
        flag[mine] = False
        good = np.unique(top[j[same >= similarity * (size[j] + size[i] - same)]])
        if len(good):
            joined = np.append(good, top[i])
            top[np.isin(top, joined)] = joined.min()
    return top


def _forest_of(keys: list[str], similarity: float):
    """(a, b) by group: links of a spanning forest, between labels."""

    def each(batches):
        sole("simhash", lambda: None)
        for table in runs(batches, keys):
            table = table.combine_chunks()
            n = table.num_rows
            col = {c: table[c].to_numpy() for c in [*keys, "comp", "c", "f0", "f1"]}
            edge = np.ones(n, bool)
            edge[1:] = False
            for k in keys:
                edge[1:] |= col[k][1:] != col[k][:-1]
            heads = np.append(np.flatnonzero(edge), n)
            f = np.stack([col["f0"], col["f1"]], 1).view(np.uint64)
            raw, out = table["s"], []
            for x, y in zip(heads, heads[1:]):
                comp = col["comp"][x:y]
                if y - x < 2 or (comp == comp[0]).all():
                    continue
                across = col["lo"][x] != col["hi"][x]
                sets = [np.frombuffer(b.as_buffer(), np.uint32) for b in raw.slice(x, y - x)]
                top = linked(f[x:y], sets, comp, col["c"][x:y] if across else None, similarity)
                ends = np.stack([comp, comp[top]], 1)
                out.append(np.unique(ends[ends[:, 0] != ends[:, 1]], axis=0))
            if out:
                a, b = np.concatenate(out).T
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return each


def similar(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, component_id) of every document with an id: the smallest doc_id that links of at least this similarity reach.

    Rows of one doc_id are one document, which any of its texts links. Texts with one set
    of shingles are one class, named by its smallest doc_id. A row without an id
    is in no group and not returned.
    """
    spark = tune(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id IS NOT NULL")
    keys = [f"k{i}" for i in range(BANDS)]
    longs = ["h", "f0", "f1", "n", *keys]

    def each(batches):
        sole("simhash", lambda: None)
        for batch in batches:
            for b in pieces(batch, "text"):
                g, doc = distinct_shingles(b["text"], shingle)
                bits, whole, size = wide(g, doc, b.num_rows)
                near = bands(g, doc, b.num_rows)
                cols = [pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (whole, bits[:, 0], bits[:, 1], size, *near.T)]
                short = (g >> np.uint64(32)).astype(np.uint32)  # still sorted within a text
                ends = 4 * np.concatenate(([0], np.cumsum(size)))
                sets = pa.LargeBinaryArray.from_buffers(pa.large_binary(), b.num_rows, [None, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(short)])
                yield pa.RecordBatch.from_arrays([b["doc_id"], *cols, sets.cast(pa.binary())], names=["doc_id", *longs, "s"])

    prints = rows.mapInArrow(each, f"doc_id long, {', '.join(c + ' long' for c in longs)}, s binary")
    prints = keep(prints.withColumn("rid", F.monotonically_increasing_id()))
    classes = prints.groupBy("h", "f0", "f1").agg(F.min("doc_id").alias("rep"), F.min("rid").alias("rid"), *[F.min(c).alias(c) for c in ["n", *keys]])
    classes = keep(classes)
    met = classes.where("n > 0").select("rid", "rep", "f0", "f1", "n", F.explode(F.array(*keys)).alias("k"))
    full = met.groupBy("k").agg(F.count("*").alias("rows"), F.sum("n").alias("size")).where("rows > 1")
    # A chunk has at most about ``chunk`` rows, or as many shingles as that many texts of 4,096.
    chunks = F.ceil(F.greatest(F.col("rows") / F.lit(chunk), F.col("size") / F.lit(4096 * chunk))).cast("long")
    full = keep(full.select("k", chunks.alias("chunks")))
    met = met.join(full, "k").withColumn("c", F.pmod(F.xxhash64("rid"), F.col("chunks")))
    met = keep(met.join(prints.select("rid", "s"), "rid").select("k", "chunks", "c", "rid", "rep", "f0", "f1", "s"))
    group = ["k", "lo", "hi"]
    shape = "a long, b long"

    def forest(groups: DataFrame) -> DataFrame:
        """Links of rows (k, lo, hi, c, comp, f0, f1, s)."""
        dealt = groups.repartition(*group).sortWithinPartitions(*group)
        return keep(dealt.mapInArrow(_forest_of(group, similarity), shape))

    edges = forest(met.select("k", F.col("c").alias("lo"), F.col("c").alias("hi"), "c", F.col("rep").alias("comp"), "f0", "f1", "s"))
    comps = keep(components(edges))
    if full.where("chunks > 1").limit(1).count():
        crowded = met.where("chunks > 1")
        for everyone in (False, True):
            labelled = crowded.join(comps, F.col("rep") == F.col("node"), "left").withColumn("comp", F.coalesce("component", "rep")).drop("node", "component")
            more = forest(_across(labelled, chunk) if everyone else _heads(labelled, chunk))
            edges = keep(edges.unionByName(more))
            comps = keep(components(edges))
    of = classes.join(comps, F.col("rep") == F.col("node"), "left").select("h", "f0", "f1", F.coalesce("component", "rep").alias("component_id"))
    return prints.select("doc_id", "h", "f0", "f1").join(of, ["h", "f0", "f1"]).groupBy("doc_id").agg(F.min("component_id").alias("component_id"))


def _pairs(chunks: Column, own: Column) -> Column:
    """An array of (lo, hi): the groups in which a row of chunk ``own`` meets each chunk of its bucket."""
    one = lambda o: F.struct(F.least(own, o).alias("lo"), F.greatest(own, o).alias("hi"))
    return F.transform(F.sequence(F.lit(0).cast("long"), chunks - 1), one)


def _heads(rows: DataFrame, chunk: int) -> DataFrame:
    """One row of each component of a bucket; those of a bucket meet."""
    first = rows.groupBy("k", "comp").agg(F.min("rid").alias("rid"))
    many = first.groupBy("k").agg(F.ceil(F.count("*") / F.lit(chunk)).cast("long").alias("many"))
    first = first.join(many, "k").withColumn("c", F.pmod(F.xxhash64("rid"), F.col("many")))
    groups = first.select("k", "rid", "c", F.explode(_pairs(F.col("many"), F.col("c"))).alias("g")).select("k", "rid", "c", "g.lo", "g.hi")
    return groups.join(rows.select("k", "rid", "comp", "f0", "f1", "s"), ["k", "rid"])


def _across(rows: DataFrame, chunk: int) -> DataFrame:
    """All rows of buckets with several components; those of the largest one need not meet each other."""
    sizes = rows.groupBy("k", "comp").agg(F.count("*").alias("m"))
    top = sizes.groupBy("k").agg(F.max(F.struct("m", "comp")).alias("top"), F.sum("m").alias("all")).where("all > top.m")
    parts = lambda c: F.ceil(c / F.lit(chunk)).cast("long")
    top = keep(top.select("k", F.col("top.comp").alias("largest"), parts(F.col("top.m")).alias("shut"), parts(F.col("all") - F.col("top.m")).alias("open")))
    met = rows.join(top, "k").withColumn("done", F.col("comp") == F.col("largest"))
    own = F.pmod(F.xxhash64("rid"), F.when(F.col("done"), F.col("shut")).otherwise(F.col("open")))
    met = met.withColumn("c", F.when(F.col("done"), -1 - own).otherwise(own))
    # Chunks of the largest component are numbered from -1 down, those of the other rows from 0 up.
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    pair = lambda x, y: F.struct(F.least(x, y).alias("lo"), F.greatest(x, y).alias("hi"))
    others = F.transform(upto(F.col("open")), lambda o: pair(F.col("c"), o))
    groups = F.when(F.col("done"), others).otherwise(F.concat(others, F.transform(upto(F.col("shut")), lambda o: pair(-1 - o, F.col("c")))))
    return met.select("k", "c", "comp", "f0", "f1", "s", F.explode(groups).alias("g")).select("k", "g.lo", "g.hi", "c", "comp", "f0", "f1", "s")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
