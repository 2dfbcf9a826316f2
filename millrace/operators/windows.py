"""Window assignment. Every function works on batch and streaming frames unless it says otherwise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.operators.ranks import fresh, with_rank

MICRO = "1 microsecond"


def times(size: str, n: int) -> str:
    """An interval of one number and unit, n times."""
    number, unit = size.split()
    return f"{int(number) * n} {unit}"


_MICROS = {"microsecond": 1, "millisecond": 1000, "second": 10**6, "minute": 60 * 10**6, "hour": 3600 * 10**6, "day": 86400 * 10**6, "week": 7 * 86400 * 10**6}


def micros(size: str) -> int:
    """An interval of one number and unit, in microseconds."""
    number, unit = size.split()
    return int(number) * _MICROS[unit.rstrip("s")]


def fixed(ts: Column | str, size: str, origin: str | None = None) -> Column:
    """Half-open event-time windows [start, start + size), aligned to the epoch or shifted by ``origin``."""
    return F.window(ts, size, startTime=origin) if origin else F.window(ts, size)


def sliding(ts: Column | str, length: str, slide: str) -> Column:
    return F.window(ts, length, slide)


def processing_time(df: DataFrame, size: str) -> DataFrame:
    """Adds ``window`` by arrival instead of event time; results depend on when it runs."""
    return df.withColumn("window", F.window(F.current_timestamp(), size))


def session(ts: Column | str, seconds: int) -> Column:
    """Sessions of records that last ``seconds``: overlapping ones merge, merely touching ones don't.

    The built-in merges touching sessions, so the gap is a microsecond shorter; ``session_bounds`` restores the end.
    """
    return F.session_window(ts, f"{seconds * 1_000_000 - 1} microseconds")


def session_bounds(w: Column | str) -> list[Column]:
    w = F.col(w) if isinstance(w, str) else w
    return [w["start"].alias("start"), (w["end"] + F.expr(f"INTERVAL {MICRO}")).alias("end")]


def count_windows(df: DataFrame, n: int, order: list[str], compat: bool = False, parts: int | None = None) -> DataFrame:
    """Adds ``win_id``: every n records in ``order`` (unique, or which of the rows that tie at an edge goes where hangs on the input's layout). Batch only; see streaming.count_windows.

    ``compat`` numbers records from 1 before dividing, so that window 0 holds n - 1 of them.
    Ranks come from a range-partitioned sort and each range's offset (a row a range
    on the driver), not from one global window in one task.
    """
    (rank,) = fresh(df.columns, "rank")
    ranked = with_rank(df, order, rank, parts)
    return ranked.withColumn("win_id", F.floor((F.col(rank) + (1 if compat else 0)) / F.lit(n)).cast("long")).drop(rank)


def top_k(df: DataFrame, k: int, by: str, value: str, tie: str) -> DataFrame:
    """The k rows with the largest value of each ``by``, ties to the smaller ``tie``. Batch; see streaming.top_k."""
    rank = Window.partitionBy(by).orderBy(F.col(value).desc(), F.col(tie))
    return df.withColumn("rank", F.row_number().over(rank)).where(F.col("rank") <= k)
