"""Ordering operators: consecutive numbering, pseudo-essays, keep-first, splits, folds.

Operators E1, E3/D16, E4, E5, E6, E7 and D25.

Consecutive numbering in a total order (``consecutive_index``) never funnels a
whole group into one task: rows are range-partitioned on (group, key) -- the
range partitioner splits even a hot group over many tasks -- and numbered inside
each partition by the JVM's record counter; a small table of per-(partition,
group) counts gives the offsets. Only that table (bounded by partitions + groups)
is windowed; whether to broadcast it is left to the adaptive planner.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def consecutive_index(df: DataFrame, order_cols: list[str], group_col: str | None = None,
                      out: str = "row_index", partitions: int | None = None, total: str | None = None) -> DataFrame:
    """0-based position of each row in ``order_cols`` order (within ``group_col``).

    ``order_cols`` (with the group) must be unique, like a primary key. ``total`` names a
    column for the number of the group's rows.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ([group_col] if group_col else []) + list(order_cols)
    g = F.col(group_col) if group_col else F.lit(0)
    ranged = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    mid = F.monotonically_increasing_id()
    tagged = ranged.select("*", F.shiftright(mid, 33).alias("_pid"),
                           (mid - F.shiftleft(F.shiftright(mid, 33), 33)).alias("_rec"),
                           g.alias("_grp"))
    # Freeze the numbering: both branches below must see the same record ids, and a
    # reliable checkpoint (shared folder) also survives executor loss.
    checkpoint_dir(spark)
    tagged = tagged.checkpoint(eager=True)
    parts = tagged.groupBy("_pid", "_grp").agg(F.count(F.lit(1)).alias("_n"), F.min("_rec").alias("_first"))
    w = Window.partitionBy("_grp").orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_pid", "_grp", "_first",
                           F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_off"), F.sum("_n").over(Window.partitionBy("_grp")).alias("_all"))
    offsets = offsets.withColumnsRenamed({"_pid": "_opid", "_grp": "_ogrp"})
    joined = tagged.join(offsets, (F.col("_pid") == F.col("_opid")) & F.col("_grp").eqNullSafe(F.col("_ogrp")))
    more = [F.col("_all").alias(total)] if total else []
    return joined.select(*df.columns, (F.col("_off") + F.col("_rec") - F.col("_first")).alias(out), *more)


def pseudo_essay_id(df: DataFrame, order_cols: list[str], size: int = 5,
                    group_col: str | None = None, out: str = "essay_id") -> DataFrame:
    """Consecutive rows in blocks of ``size`` (``index // size``)."""
    idx = consecutive_index(df, order_cols, group_col, out="_idx")
    return idx.withColumn(out, F.floor(F.col("_idx") / size).cast("bigint")).drop("_idx")


def concat_sentences(df: DataFrame, id_col: str, pos_col: str, text_col: str,
                     sep: str = ". ") -> DataFrame:
    """Rebuild a text by joining its sentences in order with ``sep``."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(pos_col).alias("p"), F.col(text_col).alias("t"))))
    return df.groupBy(id_col).agg(F.concat_ws(sep, F.transform(parts, lambda x: x["t"])).alias("text"),
                                  F.count(F.lit(1)).alias("n_sentences"))


def keep_first(df: DataFrame, key_cols: list[str], order_cols: list[str]) -> DataFrame:
    """Keep the first row per key in ``order_cols`` order (null keys form one group).

    ``min_by`` over the order key is an aggregate with a map-side partial step, so a
    hot key is pre-reduced before the shuffle instead of being sorted in one task.
    ``order_cols`` must be unique (a source order / primary key).
    """
    others = [c for c in df.columns if c not in key_cols]
    if not others:
        return df.select(*key_cols).distinct()
    order = F.struct(*[F.col(c) for c in order_cols])
    row = F.min_by(F.struct(*[F.col(c) for c in others]), order).alias("_row")
    return df.groupBy(*key_cols).agg(row) \
        .select(*key_cols, *[F.col("_row")[c].alias(c) for c in others]).select(*df.columns)


def duplicate_count(df: DataFrame, key_cols: list[str]) -> DataFrame:
    """Rows removed by keep-first de-duplication."""
    keyed = F.struct(*[F.col(c) for c in key_cols])   # a struct is never null: null keys count once
    return df.agg((F.count(F.lit(1)) - F.count_distinct(keyed)).alias("duplicates_removed"),
                  F.count(F.lit(1)).alias("rows_before"))


def hash_unit(c: Column) -> Column:
    """Deterministic uniform [0,1) from md5 (same hex in Spark and DuckDB)."""
    return F.conv(F.substring(F.md5(c.cast("string")), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def _label_index(df: DataFrame, label_col: str, key_col: str, total: str | None = None) -> DataFrame:
    """Position of each row inside its label in md5(key) order (skew-safe, no per-label task)."""
    keyed = df.withColumn("_h", F.md5(F.col(key_col).cast("string")))
    return consecutive_index(keyed, ["_h", key_col], group_col=label_col, out="_li", total=total).drop("_h")


def attach_group_totals(df: DataFrame, group_cols: list[str], aggs: list[Column]) -> DataFrame:
    """Join per-group aggregates back to the rows; null groups are groups like any other."""
    if not group_cols:
        tot = df.agg(*aggs).withColumn("_one", F.lit(1))
        return df.withColumn("_one", F.lit(1)).join(F.broadcast(tot), "_one").drop("_one")
    tot = df.groupBy(*[F.col(c).alias(f"_group_{c}") for c in group_cols]).agg(*aggs)
    same = [F.col(c).eqNullSafe(F.col(f"_group_{c}")) for c in group_cols]
    return df.join(tot, same).drop(*[f"_group_{c}" for c in group_cols])


def stratified_split(df: DataFrame, label_col: str, key_col: str, test_fraction: float = 0.2,
                     exact: bool = True, stored: bool = False) -> DataFrame:
    """Deterministic stratified train/test flag (``is_test``).

    exact: per label, the first ceil(n * f) rows in md5(key) order are test, so the
    per-label counts match the fraction exactly; a label's number of rows comes with the
    numbering, no row meets its label's in a join. ``stored``: the same split of rows that are
    written once, compressed, and not moved. Scale form: stateless md5 threshold.
    """
    if not exact:
        return df.withColumn("is_test", hash_unit(F.col(key_col)) < test_fraction)
    if not stored:
        idx = _label_index(df, label_col, key_col, total="_n")
        return idx.withColumn("is_test", F.col("_li") < F.ceil(F.col("_n") * F.lit(test_fraction))) \
            .select(*df.columns, "is_test")
    path = f"{checkpoint_dir(df.sparkSession).rstrip('/')}/split-{uuid.uuid4().hex}"
    numbered = df.withColumn("_split_row", F.monotonically_increasing_id())
    numbered.write.parquet(path, compression="zstd")
    rows = df.sparkSession.read.schema(numbered.schema).parquet(path)
    return stored_split(rows, label_col, key_col, test_fraction, tiebreak="_split_row")


def stored_split(df: DataFrame, label_col: str, key_col: str, test_fraction: float = 0.2,
                 tiebreak: str | None = None) -> DataFrame:
    """The exact ``stratified_split`` of stored rows, without moving or writing them.

    ``df`` is read three times, and its keys are not null and unique in their label; if they
    aren't, ``tiebreak`` names a stored column that is, and is dropped. Counts by the first
    digits of md5(key) tell in which of 65,536 ranges a label's last test row lies; only that
    range is ordered. The labels' last test rows are kept and broadcast.
    """
    checkpoint_dir(df.sparkSession)
    h, key = F.md5(F.col(key_col).cast("string")), F.col(key_col)
    if tiebreak:
        h, key = F.coalesce(h, F.lit("")), F.col(tiebreak)    # null keys come first; equal hashes are equal keys
    rows = df.select(F.col(label_col).alias("_label"), h.alias("_h"), key.alias("_key"))
    digits = F.substring("_h", 1, 4)
    counts = rows.groupBy("_label", digits.alias("_digits")).agg(F.count(F.lit(1)).alias("_n"))
    label = Window.partitionBy("_label")
    so_far = F.sum("_n").over(label.orderBy("_digits").rowsBetween(Window.unboundedPreceding, 0))
    placed = counts.withColumns({"_to": so_far, "_last": F.ceil(F.sum("_n").over(label) * F.lit(test_fraction))})
    at = placed.where((F.col("_to") >= F.col("_last")) & (F.col("_to") - F.col("_n") < F.col("_last"))) \
        .select(F.col("_label").alias("_in"), F.col("_digits").alias("_range"), (F.col("_last") - F.col("_to") + F.col("_n")).alias("_place"))
    near = rows.join(F.broadcast(at), F.col("_label").eqNullSafe(F.col("_in")) & (digits == F.col("_range")))
    ends = near.withColumn("_row", F.row_number().over(label.orderBy("_h", "_key"))).where(F.col("_row") == F.col("_place")) \
        .select("_in", F.col("_h").alias("_end_h"), F.col("_key").alias("_end_key")).checkpoint(eager=True)
    test = (h < F.col("_end_h")) | ((h == F.col("_end_h")) & (key <= F.col("_end_key")))
    return df.join(F.broadcast(ends), F.col(label_col).eqNullSafe(F.col("_in")), "left") \
        .select(*[c for c in df.columns if c != tiebreak], F.coalesce(test, F.lit(False)).alias("is_test"))


def folds(df: DataFrame, label_col: str, key_col: str, k: int = 5, out: str = "fold") -> DataFrame:
    """Label-stratified fold number in md5(key) order."""
    return _label_index(df, label_col, key_col).withColumn(out, (F.col("_li") % k).cast("int")).drop("_li")


def cap_class(df: DataFrame, n: int, key_col: str, tiebreak: list[str] | None = None) -> DataFrame:
    """E5: at most ``n`` rows, the first in md5(key) order (deterministic seeded-sample stand-in).

    A bounded top-k: each task keeps its best ``n`` rows, only those are merged."""
    h = F.md5(F.col(key_col).cast("string"))
    return df.orderBy(h, F.col(key_col), *[F.col(c) for c in (tiebreak or [])]).limit(n)


def share_of_total(df: DataFrame, value_col: str, group_cols: list[str], out: str = "share") -> DataFrame:
    """Value / sum(value) within the group (group totals joined back, no global window)."""
    t = attach_group_totals(df, group_cols, [F.sum(value_col).alias("_tot")])
    return t.withColumn(out, F.col(value_col) / F.col("_tot")).drop("_tot")


def prefix_sum(df: DataFrame, order_cols: list[str], value_col: str, out: str = "cum_before",
               partitions: int | None = None) -> DataFrame:
    """Exclusive running sum of ``value_col`` in ``order_cols`` order, without a global window.

    Range-partition on the order, run a window inside each range partition, and add
    the totals of the earlier partitions (a table of one row per partition).
    ``order_cols`` must be unique.
    """
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *order_cols).withColumn("_pid", F.spark_partition_id())
    checkpoint_dir(spark)
    ranged = ranged.checkpoint(eager=True)
    local = Window.partitionBy("_pid").orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, -1)
    with_local = ranged.withColumn("_loc", F.coalesce(F.sum(value_col).over(local), F.lit(0)))
    totals = ranged.groupBy("_pid").agg(F.sum(value_col).alias("_tot"))
    before = Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("_pid", F.coalesce(F.sum("_tot").over(before), F.lit(0)).alias("_off"))
    return with_local.join(F.broadcast(offsets), "_pid") \
        .select(*df.columns, (F.col("_off") + F.col("_loc")).alias(out))
