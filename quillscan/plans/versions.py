"""A3 + A4 — cached and frozen datasets, known by the content they were made from.

A version lies in ``<path>/<fingerprint of its input>``: the rows in ``data`` and, written
after them, a one-row ``manifest`` with the rows' own count and fingerprint. A version
without a manifest was interrupted and is written anew; one with a manifest is never
written again. A changed input has another fingerprint, so it is another version.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

LANES = 4


def row_digest(cols: list[str]) -> Column:
    """md5 of a row: each value as its length, a colon and its text, ``-`` for null."""
    def part(c: str) -> Column:
        t = F.col(f"`{c}`").cast("string")
        return F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-"))
    return F.md5(F.concat(*[part(c) for c in sorted(cols)]))


def fingerprint(df: DataFrame) -> DataFrame:
    """One row (rows, fingerprint), the same for any order of rows and columns.

    The rows' 128-bit digests are added in four lanes of 32 bits, so repeated rows count;
    a hash aggregate with one row a task.
    """
    lanes = df.select(row_digest(df.columns).alias("d")).select(*[
        F.conv(F.substring("d", 8 * i + 1, 8), 16, 10).cast("bigint").alias(f"l{i}") for i in range(LANES)])
    got = lanes.agg(F.count(F.lit(1)).alias("rows"), *[F.coalesce(F.sum(f"l{i}"), F.lit(0)).alias(f"l{i}") for i in range(LANES)])
    return got.select("rows", F.concat_ws("-", "rows", *[f"l{i}" for i in range(LANES)]).alias("fingerprint"))


def manifest(spark: SparkSession, path: str) -> Row | None:
    """The manifest's row, or None if the version is not (wholly) there."""
    try:
        return spark.read.schema("rows long, fingerprint string").parquet(f"{path}/manifest").first()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
    return None


def holds_files(spark: SparkSession, path: str) -> bool:
    """Whether Parquet files lie in ``path`` itself, where a version has only its two folders."""
    try:
        spark.read.format("binaryFile").load(f"{path}/*.parquet")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def freeze(df: DataFrame, path: str) -> None:
    """A4: write ``df`` below ``path``, the manifest last; a finished version stays as it is, and so do other files."""
    spark = df.sparkSession
    if holds_files(spark, path):
        raise FileExistsError(f"{path} holds files that are no version")
    if manifest(spark, path) is not None:
        raise FileExistsError(f"{path} holds a finished version")
    df.write.mode("overwrite").parquet(f"{path}/data")
    fingerprint(spark.read.parquet(f"{path}/data")).write.mode("overwrite").parquet(f"{path}/manifest")


def versioned(source: DataFrame, path: str, build: Callable[[DataFrame], DataFrame],
              known: str | None = None) -> tuple[DataFrame, str]:
    """A3: ``build(source)`` from the version that this content of ``source`` has, made if it is missing.

    Returns the rows and the version's path. ``known`` is the fingerprint of a ``source`` that is itself
    a finished version: its manifest was made from the stored rows, so they aren't read once more for it.
    """
    spark = source.sparkSession
    own = f"{path.rstrip('/')}/{known or fingerprint(source).first()['fingerprint']}"
    if manifest(spark, own) is None:
        freeze(build(source), own)
    return spark.read.parquet(f"{own}/data"), own
