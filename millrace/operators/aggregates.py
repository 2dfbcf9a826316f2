"""Windowed aggregates, keyed and global: partial aggregation before the shuffle, then a final one."""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.operators.windows import fixed, micros, sliding, times

STRETCH = 10_000


def keyed(df: DataFrame, size: str, keys: list, ts: str = "ts", keep_window: bool = False, **aggs: Column) -> DataFrame:
    """One row per window and key, with ``start`` and ``end``; nothing for windows without rows.

    ``keep_window`` also keeps the ``window`` itself, by which a stream can be aggregated further.
    """
    out = df.groupBy(fixed(ts, size).alias("window"), *keys).agg(*[c.alias(n) for n, c in aggs.items()])
    kept = [c for c in out.columns if keep_window or c != "window"]
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *kept)


def windowed(df: DataFrame, size: str, ts: str = "ts", **aggs: Column) -> DataFrame:
    return keyed(df, size, [], ts, **aggs)


def dense(agg: DataFrame, size: str, **empty) -> DataFrame:
    """Adds the windows without data between the first and the last, with the given values. Batch only.

    Windows are made a stretch of ``STRETCH`` at a time, so that a long span is many tasks' work. The aggregate is planned twice, for its ends and its rows.
    """
    step = micros(size)
    n, long = F.lit(step).cast("long"), F.lit(step * STRETCH).cast("long")
    at = lambda c: F.timestamp_micros(c)
    tasks = int(agg.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # a number, or the few rows are coalesced into one task
    ends = agg.agg(F.min(F.unix_micros("start")).alias("a"), F.max(F.unix_micros("start")).alias("z")).where("a IS NOT NULL")
    parts = ends.select(F.explode(F.sequence("a", "z", long)).alias("a"), "z").repartition(tasks, "a")
    all_ = parts.select(F.explode(F.sequence("a", F.least("z", F.col("a") + long - n), n)).alias("start")).select(at("start").alias("start"))
    out = all_.join(agg, "start", "left").withColumn("end", at(F.unix_micros("start") + n))
    for name, value in empty.items():
        out = out.withColumn(name, F.coalesce(name, F.lit(value)))
    return out.select(*agg.columns)


def sliding_sum(df: DataFrame, value: str, panes: int, pane: str, ts: str = "ts", keys: list | None = None) -> DataFrame:
    """Sums over ``panes`` consecutive panes, sliding by one, in batch and in streams.

    Rows are summed by pane first, and only panes are repeated into the windows they lie
    in, so that work doesn't grow with the overlap.
    """
    keys = keys or []
    part = df.groupBy(fixed(ts, pane).alias("pane"), *keys).agg(F.sum(value).alias("total"))
    wide = sliding(F.window_time("pane"), times(pane, panes), pane)
    out = part.groupBy(wide.alias("window"), *[k if isinstance(k, str) else F.col(part.columns[i + 1]) for i, k in enumerate(keys)]).agg(F.sum("total").alias("total"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c != "window"])


def distinct_values(value: Column | str) -> Column:
    """Set union, sorted."""
    return F.sort_array(F.collect_set(value))


def bag(value: Column | str) -> Column:
    """Bag union, sorted."""
    return F.sort_array(F.collect_list(value))


def end_micros(end: str = "end") -> Column:
    """The window's end as a number, to join on."""
    return F.unix_micros(F.col(end).cast("timestamp"))


def sketch_distinct(value: str) -> Column:
    """Approximate count of distinct values in bounded state."""
    return F.approx_count_distinct(value)


def reducer(returns: str):
    """A decorator: a function from a pandas Series of one group to a value becomes a grouped aggregate. The group must fit a worker.

    Groups are collected and reach Python many in a batch, as a batch a group costs more than most functions do.
    """

    def over(f):
        def each(groups: pa.Array) -> pa.Array:
            return pa.array([f(g) for g in _series(groups)], from_pandas=True)

        values = F.arrow_udf(each, returns)
        return lambda value: values(F.collect_list(F.struct((F.col(value) if isinstance(value, str) else value).alias("v")))["v"])

    return over


def _series(groups: pa.Array) -> Iterator[pd.Series]:
    """Lists as pandas Series, times without a zone. Only a list that has nulls itself is converted by itself: its integers become floats."""
    flat, lengths = groups.flatten(), groups.value_lengths().to_pylist()
    whole, at = _pandas(flat).to_numpy() if flat.null_count == 0 else None, 0
    for n in lengths:
        yield _pandas(flat.slice(at, n)) if whole is None else pd.Series(whole[at : at + n])
        at += n


def _pandas(values: pa.Array) -> pd.Series:
    out = values.to_pandas(date_as_object=True, coerce_temporal_nanoseconds=True)
    return out.dt.tz_localize(None) if isinstance(out.dtype, pd.DatetimeTZDtype) else out


class Fold:
    """A user aggregate in three parts; unlike ``reducer`` it needs no group in one place.

    ``zero`` begins a state (any JSON value), ``add`` takes it and a pandas Series of values further, ``merge`` joins two states.
    """

    def zero(self):
        return None

    def add(self, state, values: pd.Series):
        raise NotImplementedError

    def merge(self, a, b):
        raise NotImplementedError


def fold(df: DataFrame, fn: Fold, keys: list[str], value: str, name: str, returns: str = "string") -> DataFrame:
    """(*keys, name): states folded batch by batch where the rows are, then merged by key, a state a batch and key. Null keys are a key."""
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    shape = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "state string"])

    def part(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [(*(k if isinstance(k, tuple) else (k,)), json.dumps(fn.add(fn.zero(), g[value]))) for k, g in b.groupby(keys, dropna=False, sort=False)]
            yield pd.DataFrame(rows, columns=[*keys, "state"])

    def whole(states: pd.Series) -> str:
        return json.dumps(reduce(fn.merge, map(json.loads, states)))

    merged = df.select(*keys, value).mapInPandas(part, shape).groupBy(*keys).agg(reducer("string")(whole)("state").alias(name))
    return merged.withColumn(name, F.col(name).cast(returns))
