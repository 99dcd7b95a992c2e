"""Streams that stop and go on: counters, running AUC, scores; batches done twice."""

import uuid

from pyspark.sql import functions as F

from duoclass.operators.metrics import hard_auc_value
from duoclass.operators.model import intmod_model
from duoclass.operators.scoring import score
from duoclass.session import scratch_path
from duoclass.streaming.counters import resume_confusion_stream, running_auc
from duoclass.streaming.scoring import score_stream
from tests.conftest import SF001


def counts(rows):
    return {(r["truth"], r["pred"]): r["n"] for r in rows}


def batch_counts(df):
    return counts(df.selectExpr("CAST(event_type = 'purchase' AS INT) AS truth", "CAST(coalesce(value > 100, false) AS INT) AS pred")
                  .groupBy("truth", "pred").agg(F.count("*").alias("n")).collect())


def test_stop_after_k_files_and_go_on(spark, tmpdir_path):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    name, src = uuid.uuid4().hex, f"{tmpdir_path}/in"
    for k in range(3):
        ev.where(F.col("event_id") % 3 == k).repartition(2).write.mode("append").parquet(src)
        got = resume_confusion_stream(spark, src, name, "*.parquet", max_files_per_trigger=1)
        last = got.agg(F.max("batch")).first()[0]
        assert last == 2 * k + 1
        assert counts(got.where(F.col("batch") == last).collect()) == batch_counts(ev.where(F.col("event_id") % 3 <= k))
    # nothing new: taking it up again changes nothing
    assert resume_confusion_stream(spark, src, name, "*.parquet").count() == got.count()
    auc = {r["batch"]: r for r in running_auc(got).collect()}
    r = auc[5]
    whole = batch_counts(ev)
    assert (r["tp"], r["fp"], r["tn"], r["fn"]) == tuple(whole[x] for x in ((1, 1), (0, 1), (0, 0), (1, 0)))
    assert abs(r["auc"] - hard_auc_value(r["tp"], r["fn"], r["tn"], r["fp"])) < 1e-12


def test_a_batch_done_again_counts_once(spark, tmpdir_path):
    """The last commit is lost (as if the driver died after the sink): the batch runs again."""
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    name, src = uuid.uuid4().hex, f"{tmpdir_path}/in"
    ev.coalesce(1).write.parquet(src)
    first = counts(resume_confusion_stream(spark, src, name, "*.parquet").collect())
    commits = scratch_path(spark, "streams", name, "checkpoint") + "/commits"
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(f"{commits}/0")
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(p, False)
    fs.delete(jvm.org.apache.hadoop.fs.Path(f"{commits}/.0.crc"), False)
    again = resume_confusion_stream(spark, src, name, "*.parquet")
    assert counts(again.collect()) == first and again.count() == len(first)


def test_scores_use_each_batch_alone(spark, tmpdir_path):
    emb = spark.read.parquet(f"{SF001}/embeddings.parquet")
    model, name, src = intmod_model(64, [4]), uuid.uuid4().hex, f"{tmpdir_path}/in"

    def prepare(b):
        return b.select("vec_id", F.col("label").alias("label"), F.col("embedding").alias("features"))

    for k in range(2):
        emb.where(F.col("vec_id") % 2 == k).coalesce(1).write.mode("append").parquet(src)
        got = score_stream(spark, src, model, name, prepare, ["vec_id"])
    assert got.count() == emb.count()
    for k in range(2):
        want = {r["vec_id"]: r["p0"] for r in score(prepare(emb.where(F.col("vec_id") % 2 == k)), model, keep=["vec_id"]).collect()}
        have = {r["vec_id"]: r["p0"] for r in got.where(F.col("batch") == k).collect()}
        assert want.keys() == have.keys() and all(abs(want[i] - have[i]) < 1e-12 for i in want)
