"""F5 — looks at a table: its head, its tail, and random rows, by stratum if wanted.

``key_cols`` must be unique, so that every look is repeatable. A random row is one with a
small md5 of its key; equal digests go by the key. Null strata are a stratum of their own.
Each task keeps its own ``n`` rows (a stratum) before anything is shuffled, so a stratum of
any size costs the shuffle ``n`` rows a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def key_digest(key_cols: list[str]) -> Column:
    return F.md5(F.concat_ws(":", *[F.col(c).cast("string") for c in key_cols]))


def _numbered(df: DataFrame, n: int, strata: list[str], order: list[Column]) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*strata).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= n)


def sample_peek(df: DataFrame, n: int, key_cols: list[str], strata: list[str]) -> DataFrame:
    """``n`` random rows of each stratum (all, if fewer), numbered from 1 in ``place``."""
    return _numbered(df, n, strata, [key_digest(key_cols), *[F.col(c) for c in key_cols]])


def head(df: DataFrame, n: int, key_cols: list[str]) -> DataFrame:
    """The first ``n`` rows in key order: a top-k, no full sort."""
    return df.orderBy(*key_cols).limit(n)


def tail(df: DataFrame, n: int, key_cols: list[str]) -> DataFrame:
    """The last ``n`` rows in key order, the last first."""
    return df.orderBy(*[F.col(c).desc() for c in key_cols]).limit(n)
