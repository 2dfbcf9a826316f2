"""Running the same operators as streams: watermarks, sinks, stateful operators, progress."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.operators.ranks import fresh, with_rank
from millrace.operators.road import SEGMENT, STOP_REPORTS, tolls
from millrace.operators.windows import top_k as batch_top_k


def watermarked(df: DataFrame, ts: str = "ts", delay: str = "0 seconds") -> DataFrame:
    """Late rows are dropped by the watermark; windows go out once their end is at or below it."""
    return df.withWatermark(ts, delay)


# ------------------------------------------------------------------ sinks


def to_memory(df: DataFrame, name: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs over what is available now and gives the result, for tests and reports."""
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name)


def to_parquet(df: DataFrame, path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """An exactly-once file sink; ``every`` is the trigger's interval, else what is available now."""
    out = df.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (out.trigger(processingTime=every) if every else out.trigger(availableNow=True)).start()


def collected(df: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Runs a stream over what is available now into a folder of Parquet, which it gives to read."""
    to_parquet(df, path, checkpoint).awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(path)


def counting(df: DataFrame, checkpoint: str, each: Callable[[int, int], None], mode: str = "append") -> StreamingQuery:
    """A sink that only counts: ``each`` gets batch and number of rows."""
    return df.writeStream.foreachBatch(lambda d, i: each(i, d.count())).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------------------ progress


def progress(query: StreamingQuery) -> list[dict]:
    """Rows and rates of the recent batches."""
    keys = "batchId", "numInputRows", "inputRowsPerSecond", "processedRowsPerSecond", "durationMs"
    return [{k: p[k] for k in keys if k in p} for p in query.recentProgress]


def observed(df: DataFrame, name: str) -> DataFrame:
    """Adds the number of rows that pass here in a batch to the query's progress; see ``statistics``."""
    return df.observe(name, F.count(F.lit(1)).alias("rows"))


def statistics(query: StreamingQuery, record_bytes: int = 0) -> list[dict]:
    """By operator (each ``observed`` one, and the source): K records and MB a second, in the last batch and on average.

    K is 1,024 records and MB 2**20 bytes. A batch's time is that of its trigger; ``record_bytes`` 0 leaves MB 0.
    """
    rows: dict[str, list[tuple[int, float]]] = {}
    for p in query.recentProgress:
        seconds = max(p["durationMs"].get("triggerExecution", 0), 1) / 1000
        rows.setdefault("source", []).append((p["numInputRows"], seconds))
        for name, metrics in (p["observedMetrics"] or {}).items():
            rows.setdefault(name, []).append((metrics["rows"], seconds))
    out = []
    for name, batches in rows.items():
        (n, s), total, time = batches[-1], sum(b[0] for b in batches), sum(b[1] for b in batches)
        rates = [n / s, total / time]
        out.append({"name": name, "mb_s": rates[0] * record_bytes / 2**20, "avg_mb_s": rates[1] * record_bytes / 2**20, "krec_s": rates[0] / 1024, "avg_krec_s": rates[1] / 1024})
    return out


def first_result_ms(df: DataFrame, checkpoint: str, mode: str = "append") -> float:
    """Milliseconds from a stream's start until its sink gets the first row, over what is available now; infinite if none comes."""
    import time

    came: list[float] = []

    def each(batch: DataFrame, i: int) -> None:
        if batch.count() and not came:  # all of the batch, so that every state is committed
            came.append(time.time())

    began = time.time()
    df.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    return (came[0] - began) * 1000 if came else float("inf")


# ------------------------------------------------------------------ ranks in streams


def top_k(agg: DataFrame, k: int, value: str, key: str, window: str = "window") -> DataFrame:
    """Top k of each window within a stream's plan, where ranks aren't allowed: a second aggregation over the first one's rows (``keyed`` with keep_window).

    A window's keys meet in its state, so they must fit one; ties go to the smaller key. ``top_k_batches`` has no such bound.
    """
    entry = F.struct((-F.col(value)).alias("neg"), F.col(key).alias("key"))
    best = F.slice(F.sort_array(F.collect_list(entry)), 1, k)
    out = agg.groupBy(window).agg(best.alias("best")).select(window, F.explode("best").alias("b"))
    return out.select(window, F.col("b.key").alias(key), (-F.col("b.neg")).alias(value))


def top_k_batches(agg: DataFrame, k: int, value: str, key: str, sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Top k of each window of an aggregate in append mode: a window's rows all come in one batch, where ranks are allowed and need k rows a task and window."""

    def each(batch: DataFrame, i: int) -> None:
        sink(batch_top_k(batch, k, "start", value, key), i)

    return agg.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def count_windows(df: DataFrame, n: int, by: list[str], checkpoint: str, sink: Callable[[DataFrame, int], None]) -> StreamingQuery:
    """Count windows in order of batches, and of ``by`` (unique, nulls first) within one: ranks go on from the rows of all batches before.

    How many rows came up to a batch is kept beside the checkpoint under the batch's id, so that a restart goes on where it
    stopped and a batch that is run again gets the same windows. An empty batch changes nothing.
    """

    def upto(spark, i: int) -> int:
        return spark.read.schema("total long").parquet(f"{checkpoint}/counted/{i}").first()[0] if i >= 0 else 0

    def each(batch: DataFrame, i: int) -> None:
        batch.persist()
        start = upto(batch.sparkSession, i - 1)
        (rank,) = fresh(batch.columns, "rank")
        ranked = with_rank(batch, by, rank)
        sink(ranked.withColumn("win_id", F.floor((F.col(rank) + start) / F.lit(n)).cast("long")).drop(rank), i)
        batch.sparkSession.range(1).select(F.lit(start + batch.count()).cast("long").alias("total")).coalesce(1).write.mode("overwrite").parquet(f"{checkpoint}/counted/{i}")
        batch.unpersist()

    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# ------------------------------------------------------------------ Linear Road

STOPS = "vid long, pos long, seg long, at long, arrives boolean"


def road_stops(reports: DataFrame, idle: str | None = "1 hour", ts: str = "ts") -> DataFrame:
    """(vid, pos, seg, at, arrives): a vehicle's 4th successive report of speed 0 at one position, and its next report elsewhere or moving.

    reports: (vid, time, speed, pos) and, if ``idle`` is given, an event time with a watermark; a vehicle silent for so
    long is forgotten, so that state holds the vehicles on the road only. State by vehicle: position, count, time of
    the last report. Reports not later than the last one are skipped, and so are reports without a time, speed
    or position; reports without a vehicle belong to none.
    """
    wait = pd.Timedelta(idle).value // 10**6 if idle else 0

    def step(key, frames, state: GroupState):
        if state.hasTimedOut:
            state.remove()
            return
        pos, n, last, until = state.get if state.exists else (-1, 0, -1, 0)
        out = []
        for frame in frames:
            for r in frame.dropna().sort_values("time").itertuples():
                if r.time <= last:
                    continue
                stands = r.speed == 0
                if n >= STOP_REPORTS and not (stands and r.pos == pos):
                    out.append((int(key[0]), pos, pos // SEGMENT, int(r.time), False))
                n = (n + 1 if r.pos == pos and n else 1) if stands else 0
                pos, last = int(r.pos), int(r.time)
                if n == STOP_REPORTS:
                    out.append((int(key[0]), pos, pos // SEGMENT, last, True))
            if idle and len(frame):
                until = max(until, int(frame[ts].max().timestamp() * 1000) + wait)
        state.update((pos, int(n), last, until))
        if idle and until > state.getCurrentWatermarkMs():
            state.setTimeoutTimestamp(until)
        yield pd.DataFrame(out, columns=["vid", "pos", "seg", "at", "arrives"])

    rows = reports.where("vid IS NOT NULL").select("vid", "time", "speed", "pos", *([ts] if idle else []))
    timeout = GroupStateTimeout.EventTimeTimeout if idle else GroupStateTimeout.NoTimeout
    return rows.groupBy("vid").applyInPandasWithState(step, STOPS, "pos long, n long, last long, until long", "append", timeout)


ACCIDENTS = "pos long, seg long, at long, begins boolean"


def road_accidents(stops: DataFrame) -> DataFrame:
    """(pos, seg, at, begins): when a second vehicle comes to stand at a position, and when fewer than two are left.

    stops: rows of ``road_stops``, streamed from the folder that they are written to without a limit of files a trigger, so that
    the files of a batch come together; a position's rows of a trigger are put in order of time. State by position:
    the vehicles that stand there; none for a position where none does.
    """

    def step(key, frames, state: GroupState):
        there = set(state.get[0]) if state.exists else set()
        out = []
        for at, rows in pd.concat(list(frames)).sort_values("at").groupby("at"):
            was = len(there) >= 2
            for r in rows.itertuples():
                (there.add if r.arrives else there.discard)(int(r.vid))
            if was != (len(there) >= 2):
                out.append((int(key[0]), int(rows.seg.iloc[0]), int(at), not was))
        if there:
            state.update((sorted(there),))
        elif state.exists:
            state.remove()
        yield pd.DataFrame(out, columns=["pos", "seg", "at", "begins"])

    return stops.groupBy("pos").applyInPandasWithState(step, ACCIDENTS, "vids array<long>", "append", GroupStateTimeout.NoTimeout)


def accident_spans(turns: DataFrame) -> DataFrame:
    """(pos, seg, from, to) of the rows of ``road_accidents`` written so far; to is null while open. Batch."""
    from pyspark.sql import Window

    by = Window.partitionBy("pos").orderBy("at", F.col("begins").asc())
    return turns.withColumn("to", F.lead("at").over(by)).where("begins").select("pos", "seg", F.col("at").alias("from"), "to")


def road_tolls(speeds: DataFrame, accidents: Callable[[], DataFrame], sink: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Tolls of the slots that a stream of segment speeds (seg, slot, reports, speed_sum) closes, against the accidents known by then."""

    def each(batch: DataFrame, i: int) -> None:
        sink(tolls(batch, accidents()), i)

    return speeds.writeStream.foreachBatch(each).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
