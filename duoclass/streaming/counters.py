"""Running confusion counters over a file stream.

The graph metrics being re-expressed kept their counters as state that was
initialised once and never reset, so every evaluation saw the totals of all
earlier ones.  In Structured Streaming that is a stateful ``groupBy(truth, pred)
.count()`` in complete mode: the state store holds four counters per key, each
micro-batch adds to them, and the checkpoint (in the shared checkpoint folder)
makes the totals survive a restart or the loss of an executor.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclass.operators.metrics import hard_auc_from_counts
from duoclass.session import scratch_path


def event_truth(df_cols=None) -> Column:
    return (F.col("event_type") == F.lit("purchase")).cast("int")


def event_pred() -> Column:
    return F.coalesce(F.col("value") > F.lit(100.0), F.lit(False)).cast("int")


def confusion_stream(spark: SparkSession, source_dir: str, file_glob: str = "events.parquet",
                     truth: Column | None = None, pred: Column | None = None,
                     max_files_per_trigger: int | None = None) -> DataFrame:
    """Streaming (truth, pred, n) counters over the Parquet files matching ``file_glob``.

    How many files a micro-batch takes is the source's choice unless given."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(source_dir).schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if max_files_per_trigger is not None:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    src = reader.parquet(source_dir)
    t = truth if truth is not None else event_truth()
    p = pred if pred is not None else event_pred()
    return src.select(t.alias("truth"), p.alias("pred")).groupBy("truth", "pred").agg(
        F.count(F.lit(1)).alias("n"))


def run_confusion_stream(spark: SparkSession, source_dir: str, file_glob: str = "events.parquet",
                         max_files_per_trigger: int | None = None, name: str | None = None) -> DataFrame:
    """Drain the stream (``availableNow``) and return the counters after the last batch."""
    batches = resume_confusion_stream(spark, source_dir, name or uuid.uuid4().hex[:12], file_glob, max_files_per_trigger)
    last = batches.agg(F.max("batch").alias("b")).first()["b"]
    return batches.where(F.col("batch") == F.lit(last)).select("truth", "pred", "n")


def _folder(spark: SparkSession, name: str, part: str) -> str:
    return scratch_path(spark, "streams", name, part)


def resume_confusion_stream(spark: SparkSession, source_dir: str, name: str, file_glob: str = "events.parquet",
                            max_files_per_trigger: int | None = None) -> DataFrame:
    """Take up the stream ``name`` where it stopped (or begin it), drain what is there, and
    return (batch, truth, pred, n): the running counters after every micro-batch so far.

    The checkpoint holds which files were read and the counters; a batch that is done again
    after a failure writes the same folder (``batch=<id>``) again, so nothing counts twice.
    """
    out = _folder(spark, name, "counters")
    counts = confusion_stream(spark, source_dir, file_glob, max_files_per_trigger=max_files_per_trigger)

    def sink(batch: DataFrame, batch_id: int) -> None:
        batch.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(counts.writeStream.outputMode("complete").foreachBatch(sink)
          .option("checkpointLocation", _folder(spark, name, "checkpoint")))
    return spark.read.option("basePath", out).parquet(out).select(F.col("batch").cast("long").alias("batch"), "truth", "pred", "n")


def drain(writer) -> None:
    """Run a stream over what is there now, to its end; a failure is the caller's."""
    q = writer.trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise RuntimeError(str(q.exception()))


def running_auc(batches: DataFrame) -> DataFrame:
    """(batch, tp, fp, tn, fn, auc): the hard-label AUC of the running counters after each
    batch, with truth and prediction exchanged as the metric being mirrored had them."""
    count = lambda t, p: F.sum(F.when((F.col("truth") == t) & (F.col("pred") == p), F.col("n")).otherwise(0)).cast("long")
    c = batches.groupBy("batch").agg(count(1, 1).alias("tp"), count(0, 1).alias("fp"), count(0, 0).alias("tn"), count(1, 0).alias("fn"))
    return c.withColumn("auc", hard_auc_from_counts(F.col("tp"), F.col("fn"), F.col("tn"), F.col("fp")))
