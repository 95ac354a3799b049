"""Helpers shared by the training-data operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder that the cluster names in spark.checkpoint.dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def frozen(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a table in the shared folder and read back.

    Cuts lineage and pins rows that several later steps must agree on; a lost executor
    costs only the tasks that ran on it.
    """
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tasks(spark: SparkSession) -> int:
    """Partitions for a shuffle whose few small rows stand for much work each."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def row_key(*cols: str):
    """A 64-bit key of a row's content; rows equal in ``cols`` share it."""
    return F.xxhash64(*[F.col(f"`{c}`") for c in cols])


def join_named(rows: DataFrame, names: DataFrame, key: str, copies: str) -> DataFrame:
    """``rows`` with the columns of ``names`` (one row a key; ``copies``: rows of that key), without a hot task.

    At most 1,000 keys can each hold more than a thousandth of all rows: these are broadcast,
    the rest is joined by shuffles.
    """
    total = names.agg(F.sum(copies)).first()[0] or 0
    hot = F.col(copies) * 1000 > total
    often = F.broadcast(names.where(hot).drop(copies))
    few = rows.join(often.select(key), key, "left_anti").join(names.where(~hot).drop(copies), key)
    return rows.join(often, key).unionByName(few)
