"""Scoring a file stream: batch normalisation with the moments of each micro-batch.

A network whose normalisation uses the rows being fed needs two passes over them.  A
micro-batch is such a set of rows: it is scored inside ``foreachBatch`` with the batch
operators, first its moments, then its outputs, and written to a folder of its own, which a
batch that is done again writes again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclass.operators.model import Model
from duoclass.operators.scoring import score
from duoclass.session import scratch_path
from duoclass.streaming.counters import drain


def score_stream(spark: SparkSession, source_dir: str, model: Model, name: str, prepare, keep: list[str],
                 max_files_per_trigger: int | None = None) -> DataFrame:
    """Score every file that appeared below ``source_dir`` since the stream ``name`` stopped.

    ``prepare`` turns the source's rows into ``features`` and the columns ``keep``.  Returns
    (batch, <keep>, outputs of ``score``) of all micro-batches so far.  A micro-batch without
    rows scores nothing.
    """
    out = scratch_path(spark, "streams", name, "scores")
    source = spark.readStream.schema(spark.read.parquet(source_dir).schema)
    if max_files_per_trigger is not None:
        source = source.option("maxFilesPerTrigger", max_files_per_trigger)

    def sink(batch: DataFrame, batch_id: int) -> None:
        score(prepare(batch), model, keep=keep).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    drain(source.parquet(source_dir).writeStream.foreachBatch(sink)
          .option("checkpointLocation", scratch_path(spark, "streams", name, "checkpoint")))
    return spark.read.option("basePath", out).parquet(out).withColumn("batch", F.col("batch").cast("long"))
