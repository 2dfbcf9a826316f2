"""Linear Road: stopped vehicles, accidents, segment speeds and tolls, in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.aggregates import keyed

STOP_REPORTS, SEGMENT, TOLL_SECONDS, FAST = 4, 5280, 300, 40


def stops(reports: DataFrame) -> DataFrame:
    """(vid, pos, seg, stopped_at, left_at) of each stretch of at least 4 successive reports of speed 0 at one position.

    reports: (vid, time, speed, pos), (vid, time) unique. stopped_at is the time of the 4th
    report; left_at is the time of the vehicle's next report elsewhere or moving, or null. One sort
    by vehicle and time serves both running values.
    """
    by = Window.partitionBy("vid").orderBy("time")
    new = (F.col("speed") != 0) | F.coalesce((F.lag("pos").over(by) != F.col("pos")) | (F.lag("speed").over(by) != 0), F.lit(True))
    islands = reports.select("vid", "time", "speed", "pos", new.alias("new")).withColumn("island", F.sum(F.col("new").cast("long")).over(by))
    islands = islands.withColumn("next", F.lead("time").over(by)).withColumn("third", F.lag("island", STOP_REPORTS - 1).over(by))
    # A report is at least the 4th of its stretch if the one three before it is of the same.
    out = islands.where("speed = 0").groupBy("vid", "island").agg(F.first("pos").alias("pos"), F.min(F.when(F.col("third") == F.col("island"), F.col("time"))).alias("stopped_at"), F.max_by("next", "time").alias("left_at"))
    return out.where("stopped_at IS NOT NULL").select("vid", "pos", F.floor(F.col("pos") / SEGMENT).cast("long").alias("seg"), "stopped_at", "left_at")


def accidents(stopped: DataFrame) -> DataFrame:
    """(pos, seg, from, to): times at which two or more vehicles stand stopped at one position; to is null while open.

    A sweep over a position's arrivals and departures, so work grows with the stops and
    not with their pairs.
    """
    arrive = stopped.select("pos", "seg", F.col("stopped_at").alias("at"), F.lit(1).alias("d"))
    leave = stopped.where("left_at IS NOT NULL").select("pos", "seg", F.col("left_at").alias("at"), F.lit(-1).alias("d"))
    net = arrive.unionByName(leave).groupBy("pos", "seg", "at").agg(F.sum("d").alias("d"))
    by = Window.partitionBy("pos", "seg").orderBy("at")
    level = net.withColumn("n", F.sum("d").over(by))
    level = level.withColumn("was", F.col("n") - F.col("d"))
    turns = level.where("(n >= 2) <> (was >= 2)").withColumn("to", F.lead("at").over(by))
    return turns.where("n >= 2").select("pos", "seg", F.col("at").alias("from"), "to")


def segment_speeds(reports: DataFrame, seconds: int = TOLL_SECONDS) -> DataFrame:
    """(seg, slot, reports, speed_sum): by segment and slot of 300 s."""
    return reports.groupBy(F.floor(F.col("pos") / SEGMENT).cast("long").alias("seg"), F.floor(F.col("time") / seconds).cast("long").alias("slot")).agg(F.count("*").alias("reports"), F.sum("speed").cast("long").alias("speed_sum"))


def tolls(speeds: DataFrame, crashes: DataFrame, seconds: int = TOLL_SECONDS) -> DataFrame:
    """(seg, slot, toll_vehicles): slots with a mean speed over 40 in segments without an accident during the slot."""
    fast = speeds.where(F.col("speed_sum") > FAST * F.col("reports"))
    c = crashes.select(F.col("seg").alias("c_seg"), "from", "to")
    during = (F.col("from") < (F.col("slot") + 1) * seconds) & (F.col("to").isNull() | (F.col("to") > F.col("slot") * seconds))
    return fast.join(c, (F.col("seg") == F.col("c_seg")) & during, "left_anti").select("seg", "slot", F.col("reports").alias("toll_vehicles"))


def position_reports(reports: DataFrame) -> DataFrame:
    """Reports of type 0, the positions; the other types are queries."""
    return reports.where("type = 0")


def toll_sums(reports: DataFrame, size: str, start: str = "1970-01-01") -> DataFrame:
    """(start, end, key, total): tolls of position reports, emitted when their slot ends, summed by window and segment."""
    due = tolls(segment_speeds(reports), accidents(stops(reports)))
    ts = F.timestamp_seconds(F.unix_seconds(F.lit(start).cast("timestamp")) + (F.col("slot") + 1) * TOLL_SECONDS)
    return keyed(due.select(ts.alias("ts"), F.col("seg").alias("key"), "toll_vehicles"), size, ["key"], total=F.sum("toll_vehicles"))
