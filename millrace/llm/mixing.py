"""Mixing sources to target weights through hash-threshold histograms.

A source's target is its weight's share of all words, at most ``most`` times its size;
what is cut off is shared among the others by weight until none is above. A source takes
each document floor(target / size) times, and once more where the document's hash is
below the source's threshold. The threshold is found by summing words by source and hash
bucket, walking the buckets up to what is wanted, and refining the boundary bucket alone
by its next 12 bits; documents are filtered by it, never sorted. What is known of a source
is a row of a table; the driver sees sums over all sources only.

Defined cases: null text has size 0; a null source is a source of its own, the last in
order; a source of size 0 has target 0; the last boundary (documents that hash alike,
repeated rows among them) goes to whichever side is nearer; a null doc_id hashes by its
text; other columns don't matter; an empty table gives an empty result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import fresh, keep, sole, tune
from millrace.operators.ranks import with_rank

BITS, STEP = 63, 12
MOST_BROADCAST = 100_000  # rows about sources; beyond it the join is left to the planner


def _about(table: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(table) if rows <= MOST_BROADCAST else table


def targets(sizes: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """(source, n, target) of (source, n); sources in code point order, null last, have the weights in turn.

    What a unit of weight gets rises as sources reach their limit, until no further one does: a sum over the sources a round.
    """
    ranked = with_rank(sizes.withColumn("absent", F.col("source").isNull()), ["absent", "source"], "i")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("i") % len(weights) + 1).cast("int"))
    table = keep(ranked.select("source", "n", weight.alias("w")))
    share, over = 0.0, F.lit(False)
    while True:
        row = table.agg(F.sum("n").alias("n"), F.sum(F.when(over, F.col("n"))).alias("shut"), F.sum(F.when(~over, F.col("w"))).alias("w")).first()
        now = ((row.n or 0) - most * (row.shut or 0)) / row.w if row.w else share
        if now <= share:
            break
        share = now
        over = F.lit(share) * F.col("w") > F.lit(most) * F.col("n")
    target = F.when(over, (F.lit(most) * F.col("n")).cast("double")).otherwise(F.lit(share) * F.col("w"))
    return table.select("source", "n", target.alias("target"))


def sized(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size, h): words, and 63 bits of hash."""

    def each(batches):
        sole("mixing", lambda: None)
        for b in batches:
            n = [len(t.encode().split()) if t else 0 for t in b["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([b["doc_id"], b["source"], pa.array(n, pa.int64()), b["h"]], names=["doc_id", "source", "size", "h"])

    tune(docs.sparkSession)
    hashed = F.shiftrightunsigned(F.xxhash64("doc_id", "text"), 1).alias("h")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), "text").select("doc_id", "source", "text", hashed).mapInArrow(each, "doc_id long, source string, size long, h long")


def _same(source: str, other: str) -> Column:
    return F.col(source).eqNullSafe(F.col(other))


def thresholds(rows: DataFrame, wanted: DataFrame, sources: int) -> DataFrame:
    """(s, upto): by source the largest hash that is taken once more (-1: none), so that these words come nearest to those wanted.

    rows: (source, size, h); wanted: (s, n), the words.
    """
    closed = [wanted.where("n <= 0").select("s", F.lit(-1).cast("long").alias("upto"))]
    open_ = keep(wanted.where("n > 0").select("s", "n", F.lit(0).cast("long").alias("p")))  # p: the bucket in whose hashes the threshold lies
    shift, left = BITS, open_.count()
    while left:
        above, shift = shift, shift - min(STEP, shift)
        inside = _same("source", "s") & (F.shiftrightunsigned("h", above) == F.col("p") if above < BITS else F.lit(True))
        part = rows.where("size > 0").join(_about(open_, sources), inside)
        hist = part.groupBy("s", "n", "p", F.shiftrightunsigned("h", shift).alias("b")).agg(F.sum("size").alias("words"), F.count("*").alias("docs"))
        hist = hist.withColumn("upto", F.sum("words").over(Window.partitionBy("s").orderBy("b")))
        at = hist.where("upto > n AND upto - words <= n").select(F.col("s").alias("t"), "b", "docs", "words", "upto")
        found = keep(open_.join(_about(at, sources), _same("s", "t"), "left"))
        first, end = (lambda c: F.shiftleft(F.col(c), shift)), F.shiftleft(F.lit(1).cast("long"), shift) - 1
        whole = F.lit(2**63 - 1).cast("long") if above >= BITS else F.shiftleft(F.col("p"), above) + ((1 << above) - 1)
        nearer = F.when(F.col("upto") - F.col("n") <= F.col("n") - (F.col("upto") - F.col("words")), first("b") + end).otherwise(first("b") - 1)
        refine = F.col("b").isNotNull() & (F.col("docs") > 1) & F.lit(shift > 0)
        closed.append(found.where(~refine).select("s", F.when(F.col("b").isNull(), whole).otherwise(nearer).cast("long").alias("upto")))
        open_ = keep(found.where(refine).select("s", (F.col("n") - (F.col("upto") - F.col("words"))).alias("n"), F.col("b").alias("p")))
        left = open_.count()
    out = closed[0]
    for more in closed[1:]:
        out = out.unionByName(more)
    return out


def mix(docs: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) of every document."""
    rows = keep(sized(docs))
    return _plan(rows, weights, most)


def _plan(rows: DataFrame, weights, most) -> DataFrame:
    goal = keep(targets(rows.groupBy("source").agg(F.sum("size").alias("n")), weights, most))
    sources = goal.count()
    times = F.when(F.col("n") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("n")))).otherwise(0).cast("int")
    plan = keep(goal.select(F.col("source").alias("s"), F.col("n").alias("source_size"), "target", times.alias("times")))
    rest = F.when(F.col("times") < most, F.col("target") - F.col("times") * F.col("source_size")).otherwise(F.lit(0.0))
    upto = thresholds(rows, plan.select("s", rest.alias("n")), sources).select(F.col("s").alias("t"), "upto")
    plan = keep(plan.join(_about(upto, sources), _same("s", "t")).drop("t"))
    copies = (F.col("times") + (F.col("h") <= F.col("upto")).cast("int")).alias("copies")
    out = rows.join(_about(plan, sources), _same("source", "s")).select("doc_id", "source", "h", "size", "source_size", "target", copies)
    return out.withColumn("taken", F.col("size") * F.col("copies"))


def mixed(docs: DataFrame, weights=(1, 2, 3), most: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken; those without a word aren't."""
    rows = keep(sized(docs))
    sources = _plan(rows, weights, most).groupBy("source", "copies").agg(F.min("h").alias("low"), F.max("h").alias("high"))
    names = docs.columns
    h, source, copies, low, high, copy = fresh(names, "h", "s", "copies", "low", "high", "copy")
    # A source has two numbers of copies at most, on either side of its threshold.
    hashed = docs.withColumn(h, F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("long"), "text"), 1))
    plan = keep(sources.select(*[F.col(c).alias(n) for c, n in (("source", source), ("copies", copies), ("low", low), ("high", high))]), 1)
    on = F.col("source").cast("string").eqNullSafe(F.col(source)) & F.col(h).between(F.col(low), F.col(high))
    out = hashed.where(F.regexp_like("text", F.lit(r"[^\x20\x09-\x0D]"))).join(plan, on)
    return out.where(F.col(copies) > 0).select(*names, F.explode(F.sequence(F.lit(1), F.col(copies))).alias(copy)).select(*names)
