"""Table loading and the derived inputs shared by several queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclass.operators.model import intmod_model
from duoclass.sources.standins import label01

SEED = 42
TRAIN_FRAC = 0.67
HIDDEN2 = [8]          # 64 -> 8 -> 2
HIDDEN3 = [8, 4]       # 64 -> 8 -> 4 -> 2
EMB_WIDTH = 64
SPARSE_THRESHOLD = 0.1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def embeddings_dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, label (0/1: class < 5), features ARRAY<FLOAT>."""
    emb = table(spark, sf_dir, "embeddings")
    return emb.select("vec_id", label01(F.col("label")).alias("label"), F.col("embedding").alias("features"))


def mlp2():
    return intmod_model(EMB_WIDTH, HIDDEN2)


def mlp3():
    return intmod_model(EMB_WIDTH, HIDDEN3)
