"""B10 + C4 — scored essays as two tables bucketed by essay, for lookups and joins.

``<name>_sentences`` holds every scored sentence (and one row without text for an essay
that has none), ``<name>_essays`` a verdict per essay. Both are bucketed and sorted by
``essay_id`` with the same number of buckets, one file a bucket: a lookup reads the buckets
of its ids, and the roll-up and the join run inside the buckets, with no exchange.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import screening as op
from ..session import checkpoint_dir
from . import screen as scr


def write_store(essays: DataFrame, name: str, buckets: int, digits: int | None = 6) -> None:
    """Score ``essays`` once and store both tables below the shared folder.

    ``buckets`` is for the data's size: some hundred MB of sentences a bucket.
    """
    spark = essays.sparkSession
    base = f"{checkpoint_dir(spark).rstrip('/')}/{name}"

    def save(df: DataFrame, table: str) -> None:
        (df.write.format("parquet").option("path", f"{base}/{table}").bucketBy(buckets, "essay_id")
         .sortBy("essay_id").mode("errorifexists").saveAsTable(f"{name}_{table}"))

    scored = scr.scored_sentences(essays, keep_empty=True)
    save(scored.repartition(buckets, "essay_id"), "sentences")
    stored = spark.table(f"{name}_sentences")
    save(scr._finish(op.screen_rollup(stored), "production", digits, []), "essays")


def essay_with_sentences(spark: SparkSession, name: str, ids: list[int] | None = None) -> DataFrame:
    """A row per essay and sentence, with the essay's verdict; an essay without a sentence has one row.

    With ``ids`` only their buckets are read. The merge join keeps to the buckets.
    """
    one, many = spark.table(f"{name}_essays"), spark.table(f"{name}_sentences").where(F.col("text").isNotNull())
    if ids is not None:
        one, many = one.where(F.col("essay_id").isin(ids)), many.where(F.col("essay_id").isin(ids))
    many = many.select("essay_id", "sent_pos", "text", "probability", "label")
    return one.select("essay_id", "essay_label", "composite_score", "total_sentences").hint("merge").join(many, "essay_id", "left")
