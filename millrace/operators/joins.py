"""Joins: interval join of two keyed streams, and lookups of a static table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.windows import micros

#: A static table is broadcast if its plan is known to give at most so many bytes; else the planner joins by shuffle.
MOST_BROADCAST = 64 << 20


def interval_join(left: DataFrame, right: DataFrame, width: str, first_match: bool = False) -> DataFrame:
    """(key, left_value, right_value, left_ts, right_ts) of pairs of one key with right.ts in [left.ts - width, left.ts + width).

    Both sides have (key, value, ts). In batch rows also meet by time buckets as wide as the interval, so that
    a hot key is many join keys. In streams both sides need watermarks, from which state is
    dropped. ``first_match`` keeps for each left row the earliest partner only, ties to the
    smaller value (batch only; needs left rows to differ).
    """
    a = left.select("key", F.col("value").alias("left_value"), F.col("ts").alias("left_ts"))
    b = right.select(F.col("key").alias("right_key"), F.col("value").alias("right_value"), F.col("ts").alias("right_ts"))
    w = F.expr(f"INTERVAL {width}")
    meets = (F.col("key") == F.col("right_key")) & (F.col("right_ts") >= F.col("left_ts") - w) & (F.col("right_ts") < F.col("left_ts") + w)
    if not (left.isStreaming or right.isStreaming):
        bucket = lambda c: F.floor(F.unix_micros(F.col(c).cast("timestamp")) / F.lit(micros(width))).cast("long")
        a = a.withColumn("left_bucket", F.explode(F.sequence(bucket("left_ts") - 1, bucket("left_ts") + 1)))
        b = b.withColumn("right_bucket", bucket("right_ts"))
        meets = (F.col("left_bucket") == F.col("right_bucket")) & meets
    out = a.join(b, meets).select("key", "left_value", "right_value", "left_ts", "right_ts")
    if first_match:
        one = Window.partitionBy("key", "left_ts", "left_value").orderBy("right_ts", "right_value")
        out = out.withColumn("nth", F.row_number().over(one)).where("nth = 1").drop("nth")
    return out


def pair(joined: DataFrame) -> DataFrame:
    """(key, [left, right], ts): both values as an array."""
    return joined.select("key", F.array("left_value", "right_value").alias("values"), F.col("right_ts").alias("ts"))


def plan_bytes(df: DataFrame) -> int:
    """What the optimised plan is known to give at most: files' sizes, as far as filters and columns tell."""
    return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())


def lookup_join(rows: DataFrame, table: DataFrame, on: str, most: int = MOST_BROADCAST) -> DataFrame:
    """Rows with their match in a static table; rows without one go. Broadcast only if the table's plan is bounded by ``most`` bytes. No job is run to tell."""
    return rows.join(F.broadcast(table) if plan_bytes(table) <= most else table, on, "inner")
