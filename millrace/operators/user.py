"""User functions: record to record, record to records, columns in place, with a batch's beginning and end."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame


class BatchFn:
    """Override any of these; start and finish are called once a partition."""

    def start(self) -> None: ...

    def process(self, batch: pd.DataFrame) -> pd.DataFrame:
        return batch

    def finish(self) -> pd.DataFrame | None:
        return None


def par_do(df: DataFrame, fn: BatchFn, schema: str) -> DataFrame:
    """Arrow batches through ``fn``; each may give any number of rows."""

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fn.start()
        for batch in batches:
            yield fn.process(batch)
        rest = fn.finish()
        if rest is not None:
            yield rest

    return df.mapInPandas(each, schema)


def map_columns(df: DataFrame, **columns: Column) -> DataFrame:
    """New columns in place of all old ones."""
    return df.select(*[c.alias(n) for n, c in columns.items()])


def update_columns(df: DataFrame, where: Column | None = None, **columns: Column) -> DataFrame:
    """Columns changed in place; rows that fail ``where`` go."""
    return (df if where is None else df.where(where)).withColumns(columns)


def identity(df: DataFrame) -> DataFrame:
    return df


def split(df: DataFrame, *branches: Callable[[DataFrame], DataFrame]) -> list[DataFrame]:
    """One frame into several branches."""
    return [b(df) for b in branches]
