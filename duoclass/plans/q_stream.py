"""Streaming queries: counters that survive restarts, scores of micro-batches."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duoclass.functions.columns import r6
from duoclass.operators.metrics import TF_EPS
from duoclass.plans import sqlgen as Q
from duoclass.plans.inputs import EMB_WIDTH, HIDDEN2, mlp2, table
from duoclass.plans.q_score import SCORE_COLS
from duoclass.session import scratch_path
from duoclass.sources.standins import label01
from duoclass.streaming.counters import resume_confusion_stream, running_auc
from duoclass.streaming.scoring import score_stream

PARTS = 3


def _arriving(spark, sf, name, key):
    """The table in parts that arrive one after another: yields the folder after each."""
    src = scratch_path(spark, "streams", uuid.uuid4().hex[:12], "in")
    rows = table(spark, sf, name)
    for k in range(PARTS):
        rows.where(F.pmod(F.col(key), F.lit(PARTS)) == k).write.mode("append").parquet(src)
        yield src


def stream_restart(spark, sf):
    """The stream is stopped after each part of the events and taken up when the next has
    arrived: counters after every batch, never reset, and their AUC."""
    name = uuid.uuid4().hex[:12]
    for src in _arriving(spark, sf, "events", "event_id"):
        batches = resume_confusion_stream(spark, src, name, "*.parquet")
    return running_auc(batches).select("batch", "tp", "fp", "tn", "fn", r6("auc").alias("auc"))


def stream_score(spark, sf):
    """Embeddings arriving in parts, each scored with its own moments."""
    def prepare(batch):
        return batch.select("vec_id", label01(F.col("label")).alias("label"), F.col("embedding").alias("features"))

    name = uuid.uuid4().hex[:12]
    for src in _arriving(spark, sf, "embeddings", "vec_id"):
        scores = score_stream(spark, src, mlp2(), name, prepare, ["vec_id", "label"])
    return scores.select("batch", "vec_id", "label", *[r6(c).alias(c) for c in SCORE_COLS], "pred")


QUERIES = {"stream_restart": stream_restart, "stream_score": stream_score}

_E = f"CAST({TF_EPS!r} AS DOUBLE)"

ORACLE = {
    "stream_restart": f"""
WITH e AS (SELECT event_id % {PARTS} AS k, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS t, CASE WHEN value > 100 THEN 1 ELSE 0 END AS p FROM events),
c AS (SELECT b.range AS batch, sum(t * p) AS tp, sum((1 - t) * p) AS fp, sum((1 - t) * (1 - p)) AS tn, sum(t * (1 - p)) AS fn
      FROM e JOIN range({PARTS}) b ON e.k <= b.range GROUP BY b.range),
r AS (SELECT *, (tp + {_E}) / (tp + fp + {_E}) AS tpr, fn / (fn + tn + {_E}) AS fpr, (fn + tn) / (fn + tn + {_E}) AS fpr0, {_E} / (tp + fp + {_E}) AS tpr2 FROM c)
SELECT CAST(batch AS BIGINT) AS batch, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(tn AS BIGINT) AS tn, CAST(fn AS BIGINT) AS fn,
  {Q.r6("(fpr0 - fpr) * (CAST(1 AS DOUBLE) + tpr) / CAST(2 AS DOUBLE) + fpr * (tpr + tpr2) / CAST(2 AS DOUBLE)")} AS auc FROM r""",
    "stream_score": f"""WITH {Q.EMB_CELLS},
src AS (SELECT id, id % {PARTS} AS g, label, i, v FROM emb_cells),
{Q.mlp_ctes("src", EMB_WIDTH, HIDDEN2)}
SELECT CAST(g AS BIGINT) AS batch, id AS vec_id, label, {Q.r6('y0')} AS y0, {Q.r6('y1')} AS y1, {Q.r6('p0')} AS p0, {Q.r6('p1')} AS p1, pred FROM scored""",
}
