"""C4-C6 — both analyses side by side, and the documented screening cascade.

Both per-essay results are aggregations keyed by ``essay_id`` (hash-partitioned
on it), so joining them is a co-partitioned equi-join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from . import profile as prof
from . import screen as scr


def full_analysis(essays: DataFrame, digits: int | None = 6) -> DataFrame:
    """Binary and pattern results for every essay, always both computed."""
    b = scr.screen_essays(essays, digits=digits)
    p = prof.profile_essays(essays, digits=digits)
    bs = b.select("essay_id", F.struct(*[c for c in b.columns if c != "essay_id"]).alias("binary"))
    ps = p.select("essay_id", F.struct(*[c for c in p.columns if c != "essay_id"]).alias("patterns"))
    return bs.join(ps, "essay_id")


def gated_analysis(essays: DataFrame, digits: int | None = 6) -> DataFrame:
    """NORMAL essays stop after screening; flagged ones also get a pattern profile."""
    checkpoint_dir(essays.sparkSession)
    b = scr.screen_essays(essays, digits=digits).checkpoint(eager=True)  # a row per essay; screened once
    flagged = b.where(F.col("essay_label").isNotNull() & (F.col("essay_label") != "NORMAL ESSAY"))
    stage2 = essays.join(flagged.select(F.col("essay_id")), "essay_id", "left_semi")
    p = prof.profile_essays(stage2, digits=digits)
    return b.join(p.select("essay_id", "risk_score", "risk_level", "dominant"), "essay_id", "left")


def essay_sentences(essays: DataFrame, essay_id: int) -> DataFrame:
    """B10 + C4: one essay's summary with its ordered sentences (point lookup)."""
    one = essays.where(F.col("essay_id") == essay_id)
    return scr.screen_results_nested(one)
