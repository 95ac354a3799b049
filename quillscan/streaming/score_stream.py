"""J1 — the scoring calls as an unbounded table of essays (Structured Streaming).

Each essay is one whole row, so a micro-batch can be scored independently: no
state store and no watermark are needed. ``foreachBatch`` runs the batch flow on
every micro-batch and writes each of its results to a parquet sink of its own; the
checkpoint location makes the query restartable: an epoch whose sinks were written before
a crash, but not its checkpoint, is written over (exactly-once by per-epoch folders).
With ``duplicates_within`` an essay that comes again is dropped: the state keeps an id for
that long after its file's time, and no longer.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir
from ..sources.tables import ESSAYS_SCHEMA

FLOWS = {}


def _flow(name):
    def deco(fn):
        FLOWS[name] = fn
        return fn
    return deco


@_flow("screen")
def _screen(df: DataFrame) -> DataFrame:
    from ..plans.screen import screen_essays
    return screen_essays(df, digits=6)


@_flow("patterns")
def _patterns(df: DataFrame) -> DataFrame:
    from ..plans.profile import profile_essays
    return profile_essays(df, digits=6)


@_flow("full")
def _full(df: DataFrame) -> dict[str, DataFrame]:
    """Both results, a sink each."""
    return {"binary": _screen(df), "patterns": _patterns(df)}


def write_epoch(result: DataFrame | dict[str, DataFrame], sink: str, epoch: int) -> None:
    """One folder a sink and epoch, written over when the epoch runs again."""
    named = result if isinstance(result, dict) else {"": result}
    for name, df in named.items():
        df.write.mode("overwrite").parquet("/".join(x for x in (sink, name, f"epoch={epoch}") if x))


def score_stream(spark: SparkSession, source: str, sink: str, checkpoint: str,
                 flow: str = "screen", max_files_per_trigger: int | None = None,
                 duplicates_within: str | None = None) -> None:
    """Run the stream until the available input is processed (``availableNow``)."""
    reader = spark.readStream.schema(ESSAYS_SCHEMA)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source)
    if duplicates_within:
        stream = (stream.select("*", F.col("_metadata.file_modification_time").alias("_seen"))
                  .withWatermark("_seen", duplicates_within).dropDuplicatesWithinWatermark(["essay_id"]).drop("_seen"))
    fn = FLOWS[flow]

    def write_batch(batch: DataFrame, epoch: int) -> None:
        batch.persist()  # a flow with two sinks reads it twice
        try:
            write_epoch(fn(batch), sink, epoch)
        finally:
            batch.unpersist()

    q = (stream.writeStream.foreachBatch(write_batch)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()


def staged_stream(spark: SparkSession, essays: DataFrame, flow: str) -> str:
    """Stage ``essays`` as files in the shared folder and score them as a stream; the sinks' folder."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    essays.write.parquet(f"{base}/in")
    score_stream(spark, f"{base}/in", f"{base}/out", f"{base}/ckpt", flow)
    return f"{base}/out"


def stream_equals_batch_input(spark: SparkSession, essays: DataFrame, flow: str = "screen") -> DataFrame:
    """The sink of a flow with one result, over ``essays`` read as a stream."""
    return spark.read.parquet(staged_stream(spark, essays, flow)).drop("epoch")
