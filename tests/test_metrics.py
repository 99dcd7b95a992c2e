"""AUC, hard AUC, confusion, histogram against brute force."""

import itertools
import math
import random

from pyspark.sql import functions as F

from duoclass.operators import metrics as M


def brute_auc(pairs):
    pos = [s for y, s in pairs if y == 1]
    neg = [s for y, s in pairs if y == 0]
    tot = sum(1.0 if p > n else 0.5 if p == n else 0.0 for p, n in itertools.product(pos, neg))
    return tot / (len(pos) * len(neg))


def test_tied_scores_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5)], "label int, p0 double")
    assert M.roc_auc(df).first()["roc_auc"] == 0.5


def test_auc_brute_force_with_ties(spark):
    rnd = random.Random(5)
    pairs = [(rnd.randint(0, 1), round(rnd.random(), 2)) for _ in range(600)]
    df = spark.createDataFrame(pairs, "label int, p0 double")
    got = M.roc_auc(df, rows_per_bucket=10).first()["roc_auc"]  # force many buckets
    assert abs(got - brute_auc(pairs)) < 1e-12


def test_auc_grouped(spark):
    rnd = random.Random(9)
    rows = [(g, rnd.randint(0, 1), rnd.random()) for g in ("a", "b") for _ in range(200)]
    df = spark.createDataFrame(rows, "g string, label int, p0 double")
    got = {r["g"]: r["roc_auc"] for r in M.roc_auc(df, group_cols=["g"]).collect()}
    for g in ("a", "b"):
        assert abs(got[g] - brute_auc([(y, s) for gg, y, s in rows if gg == g])) < 1e-12


def test_hard_auc_limits(spark):
    rows = [(1, 1)] * 30 + [(1, 0)] * 10 + [(0, 1)] * 20 + [(0, 0)] * 40
    df = spark.createDataFrame(rows, "t int, p int")
    right = M.hard_auc(df, F.col("t"), F.col("p")).first()["hard_auc"]
    tpr, tnr = 30 / 40, 40 / 60
    assert abs(right - (tpr + tnr) / 2) < 1e-6
    sw = M.hard_auc(df, F.col("t"), F.col("p"), swapped=True).first()["hard_auc"]
    ppv, npv = 30 / 50, 40 / 50
    assert abs(sw - (ppv + npv) / 2) < 1e-6


def test_cumulative_counters(spark):
    counts = spark.createDataFrame([(0, 1, 1, 1, 1), (1, 2, 0, 0, 2)], "epoch int, tp long, fp long, tn long, fn long")
    out = M.cumulative_hard_auc(counts, "epoch", swapped=False).orderBy("epoch").collect()
    assert [r["cum_tp"] for r in out] == [1, 3] and [r["cum_fn"] for r in out] == [1, 3]


def test_chance_agreement(spark):
    df = spark.createDataFrame([(1, 1), (1, 0), (0, 0), (0, 0)], "t int, p int")
    # P(t=1)=.5 P(p=1)=.25 ; P(t=0)=.5 P(p=0)=.75
    assert abs(M.chance_agreement(df, "t", "p").first()[0] - (0.5 * 0.25 + 0.5 * 0.75)) < 1e-12


def test_histogram_counts(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    h = M.histogram(df, "v", 10).orderBy("bin").collect()
    assert [r["count"] for r in h] == [10] * 10
    assert math.isclose(h[0]["lo_edge"], 0.0) and math.isclose(h[-1]["hi_edge"], 99.0)


def test_auc_single_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.9)], "label int, p0 double")
    assert M.roc_auc(df).first()["roc_auc"] is None


def test_hard_auc_value_matches_column_form(spark):
    df = spark.createDataFrame([(3, 2, 5, 1)], "tp long, fp long, tn long, fn long")
    col = df.select(M.hard_auc_from_counts(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn"))).first()[0]
    assert abs(col - M.hard_auc_value(3, 2, 5, 1)) < 1e-15


def test_histogram_explicit_bounds_drop_outside(spark):
    df = spark.range(100).select(F.col("id").cast("double").alias("v"))
    h = M.histogram(df, "v", 5, lo=10.0, hi=60.0).orderBy("bin").collect()
    assert [r["count"] for r in h] == [10, 10, 10, 10, 11]  # 10..60 inclusive, 60 in the last bin


def test_histogram_counts_what_lies_outside(spark):
    df = spark.createDataFrame([(x,) for x in (-9.0, -1.0, 0.0, 0.4, 1.0, 2.0, 3.0, None, float("nan"))], "v double")
    inside = [(r["bin"], r["count"]) for r in M.histogram(df, "v", 2, lo=0, hi=1).orderBy("bin").collect()]
    assert inside == [(0, 2), (1, 1)]
    rows = M.histogram(df, "v", 2, lo=0, hi=1, outside=True).orderBy("bin").collect()
    assert [(r["bin"], r["count"]) for r in rows] == [(-1, 2), (0, 2), (1, 1), (2, 2)]
    assert rows[0]["lo_edge"] == -math.inf and rows[0]["hi_edge"] == 0 and rows[-1]["hi_edge"] == math.inf and rows[-1]["lo_edge"] == 1
