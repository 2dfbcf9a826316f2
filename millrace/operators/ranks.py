"""Global row numbers without a single-task sort."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Sampled rows for each range: enough that ranges of this many rows' share differ little.
SAMPLED = 40


def fresh(taken: list[str], *names: str) -> list[str]:
    """The names, with underlines before those that a table has already (in any case)."""
    have, out = {c.lower() for c in taken}, []
    for n in names:
        while n.lower() in have:
            n = "_" + n
        have.add(n.lower())
        out.append(n)
    return out


def _edges(df: DataFrame, order: list[str], n: int) -> list:
    """At most n - 1 rows of the order's columns, spaced evenly in a sample of bounded size (seeded, so reruns agree on the same input)."""
    total = df.count()
    if n < 2 or total < 2 * n:
        return []
    sample = df.select(*order).sample(min(1.0, SAMPLED * n / total), 7).dropDuplicates().orderBy(*order).collect()
    return [sample[i] for i in sorted({len(sample) * k // n for k in range(1, n)})] if sample else []


def _bucket(df: DataFrame, order: list[str], edges: list) -> Column:
    """Which of the ranges between the edges a row lies in, by bisection."""
    kinds = {f.name: f.dataType for f in df.schema}
    row = F.struct(*order)
    at = lambda e: F.struct(*[F.lit(v).cast(kinds[c]).alias(c) for c, v in zip(order, e)])

    def half(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(row <= at(edges[mid]), half(low, mid)).otherwise(half(mid + 1, high))

    return half(0, len(edges))


def with_rank(df: DataFrame, order: list[str], name: str, parts: int | None = None) -> DataFrame:
    """Adds the 0-based rank in ``order``, which has to be unique; nulls come first.

    Rows are cut into ranges of the whole order at rows of a sample, so that many rows with
    one first value are many ranges too; a range's rows are numbered by themselves and
    shifted by the counts of the ranges before it. The driver sees the sample's rows (40 a range) and
    a count a range. An empty table gives an empty result.
    """
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (range_,) = fresh(df.columns, "range")
    edges = _edges(df, order, n)
    keyed = df.withColumn(range_, _bucket(df, order, edges))
    counts = {r[0]: r[1] for r in keyed.groupBy(range_).count().collect()} if edges else {}
    offsets, total = [], 0
    for b in range(len(edges) + 1):
        offsets.append(total)
        total += counts.get(b, 0)
    local = F.row_number().over(Window.partitionBy(range_).orderBy(*order)) - 1
    before = F.element_at(F.array(*[F.lit(x).cast("long") for x in offsets]), F.col(range_) + 1)
    return keyed.withColumn(name, local + before).drop(range_)
