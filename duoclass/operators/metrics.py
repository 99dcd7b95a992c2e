"""Evaluation metrics as aggregates (one row per group).

Label convention: ``label`` is 0/1; the one-hot pair is ``[label, 1 - label]`` so
class index 0 is the positive class; ``pred`` is the argmax class index.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from duoclass.operators.ordering import bucketize, quantile_cuts
from duoclass.session import MAX_BROADCAST_CELLS, reliable_checkpoint

TF_EPS = 1e-7  # fixed epsilon of the streaming-AUC rates


def truth_index(label: Column) -> Column:
    """argmax of the one-hot pair [l, 1-l]: 0 for label 1, 1 for label 0."""
    return F.when(label >= F.lit(0.5), F.lit(0)).otherwise(F.lit(1))


def accuracy(df: DataFrame, label: str = "label", pred: str = "pred",
             group_cols: list[str] = ()) -> DataFrame:
    hit = (F.col(pred) == truth_index(F.col(label))).cast("double")
    return df.groupBy(*group_cols).agg(F.avg(hit).alias("accuracy"))


def cross_entropy_col(label: Column, logp0: Column, logp1: Column) -> Column:
    """Softmax cross-entropy with the one-hot pair: -(l log p0 + (1-l) log p1)."""
    return -(label * logp0 + (F.lit(1.0) - label) * logp1)


def cross_entropy(df: DataFrame, label: str = "label", group_cols: list[str] = ()) -> DataFrame:
    ce = cross_entropy_col(F.col(label).cast("double"), F.col("logp0"), F.col("logp1"))
    return df.groupBy(*group_cols).agg(F.avg(ce).alias("cross_entropy"))


def score_report(df: DataFrame, label: str = "label", pred: str = "pred",
                 group_cols: list[str] = (), graph_counts: bool = False) -> DataFrame:
    """Rows, accuracy, mean cross-entropy and exact ROC AUC per group from one
    grouped pass over the scores (the additive sums ride along the AUC grouping).
    ``graph_counts`` adds the confusion counts as the graph's streaming AUC saw them
    (the predicted class index passed as labels, the true one as predictions) as
    ``tp fp tn fn`` from the same pass."""
    truth = truth_index(F.col(label))
    hit = (F.col(pred) == truth).cast("double")
    ce = cross_entropy_col(F.col(label).cast("double"), F.col("logp0"), F.col("logp1"))
    carry = {"n_rows": F.lit(1).cast("long"), "_hits": hit, "_ce": ce}
    extra = []
    if graph_counts:  # predicted index as labels, true index as predictions
        p, t = F.col(pred), truth
        for name, cond in (("tp", (p == 1) & (t == 1)), ("fp", (p == 0) & (t == 1)),
                           ("tn", (p == 0) & (t == 0)), ("fn", (p == 1) & (t == 0))):
            carry[name] = cond.cast("long")
            extra.append(name)
    r = roc_auc(df, label, "p0", group_cols, carry=carry)
    return r.select(*group_cols, "n_rows", (F.col("_hits") / F.col("n_rows")).alias("accuracy"),
                    (F.col("_ce") / F.col("n_rows")).alias("cross_entropy"), "roc_auc", *extra)


def roc_auc(df: DataFrame, label: str = "label", score: str = "p0", group_cols: list[str] = (),
            out: str = "roc_auc", rows_per_bucket: int = 1_000_000, max_buckets: int = 65_536,
            carry: dict[str, Column] | None = None) -> DataFrame:
    """Exact ROC AUC (Mann-Whitney; tied scores count one half).

    1. ``groupBy(group, score)``: positives / negatives per distinct score (partial
       aggregation first, so a score shared by a third of all rows is one row).
       This table is checkpointed: the (often expensive) scoring upstream runs
       once, and the bucket cut points below stay valid for it.
    2. Distinct scores get a monotone bucket from approximate quantiles, as many
       buckets as needed for about ``rows_per_bucket`` distinct scores each and at
       least one per shuffle partition.
    3. Negatives per (group, bucket) -> running sum over buckets (a table of
       groups x buckets rows) -> broadcast back as offsets.
    4. Inside a bucket, a window gives the negatives strictly below each score.
    AUC = sum(pos * (neg_below + neg_equal / 2)) / (P * N).

    ``carry`` maps output names to per-row expressions whose sums ride along the
    score grouping (row counts, hits, loss sums), so other additive metrics come
    out of the same pass, in the same row.
    """
    carry = dict(carry or {})
    group_cols = list(group_cols)
    y = F.col(label).cast("double")
    g = reliable_checkpoint(df.groupBy(*group_cols, F.col(score).alias("_s")).agg(
        F.sum(y).alias("_pos"), F.sum(F.lit(1.0) - y).alias("_neg"),
        *[F.sum(e).alias(f"_c_{k}") for k, e in carry.items()]))
    n_scores = g.count()  # cheap: reads the checkpoint
    least = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    nb = int(min(max_buckets, max(least, math.ceil(n_scores / float(rows_per_bucket)))))
    cuts = quantile_cuts(g, "_s", nb)
    gb = bucketize(g, "_s", cuts, "_b")
    per_b = gb.groupBy(*group_cols, "_b").agg(F.sum("_neg").alias("_bneg"))
    wo = Window.partitionBy(*group_cols).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offs = per_b.select(*group_cols, "_b", F.coalesce(F.sum("_bneg").over(wo), F.lit(0.0)).alias("_off"))
    # groups x buckets rows: broadcast when bounded (always without group columns)
    small = not group_cols or per_b.count() <= MAX_BROADCAST_CELLS // 4
    j = gb.join(F.broadcast(offs) if small else offs, group_cols + ["_b"])
    wi = Window.partitionBy(*group_cols, "_b").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum("_neg").over(wi), F.lit(0.0)) + F.col("_off")
    contrib = j.withColumn("_c", F.col("_pos") * (below + F.col("_neg") * F.lit(0.5)))
    # a group with only one class has no pairs: AUC is undefined (null), not an error
    return contrib.groupBy(*group_cols).agg(
        F.try_divide(F.sum("_c"), F.sum("_pos") * F.sum("_neg")).alias(out),
        *[F.sum(f"_c_{k}").alias(k) for k in carry])


def roc_auc_macro(df: DataFrame, label: str = "label", group_cols: list[str] = (),
                  out: str = "roc_auc_macro") -> DataFrame:
    """Average of the per-column AUCs of the one-hot pair against (p0, p1): both
    columns stacked with a column key, one grouped AUC, then the mean."""
    group_cols = list(group_cols)
    y = F.col(label).cast("double")
    # one pass over the scores gives both columns
    both = df.select(*group_cols, F.stack(F.lit(2), F.lit(0), y, F.col("p0"), F.lit(1), F.lit(1.0) - y, F.col("p1"))
                     .alias("_col", "_y", "_p"))
    per_col = roc_auc(both, "_y", "_p", group_cols + ["_col"], out="_a")
    return per_col.groupBy(*group_cols).agg(F.avg("_a").alias(out))


def confusion(df: DataFrame, truth: Column, pred: Column, group_cols: list[str] = ()) -> DataFrame:
    """Counts tp, fp, tn, fn for 0/1 truth and prediction (one row per group)."""
    t, p = truth.cast("int"), pred.cast("int")
    c = lambda cond: F.sum(F.when(cond, F.lit(1)).otherwise(F.lit(0))).cast("long")
    return df.groupBy(*group_cols).agg(
        c((t == 1) & (p == 1)).alias("tp"), c((t == 0) & (p == 1)).alias("fp"),
        c((t == 0) & (p == 0)).alias("tn"), c((t == 1) & (p == 0)).alias("fn"))


def hard_auc_from_counts(tp: Column, fp: Column, tn: Column, fn: Column) -> Column:
    """Trapezoidal AUC of a 0/1 prediction, with the rates' fixed epsilon:
    points (1, 1), (fpr, tpr), (0, eps/(P+eps)) over the threshold grid."""
    e = F.lit(TF_EPS)
    P, N = (tp + fn).cast("double"), (fp + tn).cast("double")
    tpr_m = (tp.cast("double") + e) / (P + e)
    fpr_m = fp.cast("double") / (N + e)
    fpr_0 = N / (N + e)
    tpr_2 = e / (P + e)
    return (fpr_0 - fpr_m) * (F.lit(1.0) + tpr_m) / F.lit(2.0) + fpr_m * (tpr_m + tpr_2) / F.lit(2.0)


def hard_auc_value(tp: float, fp: float, tn: float, fn: float) -> float:
    """:func:`hard_auc_from_counts` for four driver-side counts."""
    e = TF_EPS
    P, N = tp + fn, fp + tn
    tpr_m, fpr_m = (tp + e) / (P + e), fp / (N + e)
    return (N / (N + e) - fpr_m) * (1.0 + tpr_m) / 2.0 + fpr_m * (tpr_m + e / (P + e)) / 2.0


def hard_auc(df: DataFrame, truth: Column, pred: Column, swapped: bool = False,
             group_cols: list[str] = (), out: str = "hard_auc") -> DataFrame:
    """AUC of hard 0/1 outputs.  ``swapped=True`` passes the prediction as labels and
    the truth as predictions, as the graph metric was wired (its value tends to
    (PPV + NPV) / 2; the right way tends to (TPR + TNR) / 2)."""
    if swapped:
        truth, pred = pred, truth
    c = confusion(df, truth, pred, group_cols)
    return c.select(*group_cols, "tp", "fp", "tn", "fn",
                    hard_auc_from_counts(F.col("tp"), F.col("fp"), F.col("tn"), F.col("fn")).alias(out))


def cumulative_hard_auc(counts: DataFrame, order: str, swapped: bool = True,
                        partition: list[str] = (), out: str = "cumulative_auc") -> DataFrame:
    """Counters that are never reset: running sums of per-evaluation confusion counts
    (``counts`` has tp, fp, tn, fn per ``order`` value), then the AUC of the totals.
    ``counts`` has one row per evaluation, so the window is over a small table."""
    w = Window.partitionBy(*partition).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    run = counts.select(*partition, order, *[F.sum(c).over(w).alias(f"cum_{c}") for c in ("tp", "fp", "tn", "fn")])
    tp, fp, tn, fn = (F.col(f"cum_{c}") for c in ("tp", "fp", "tn", "fn"))
    if swapped:  # roles of truth and prediction exchanged: tp stays, fp <-> fn
        fp, fn = fn, fp
    return run.withColumn(out, hard_auc_from_counts(tp, fp, tn, fn))


def chance_agreement(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """sum_c P(pred = c) * P(truth = c): what comparing an [N] prediction with an
    [N, 1] label computes after broadcasting to N x N."""
    n = df.count()
    pt = df.groupBy(F.col(truth).alias("c")).agg((F.count(F.lit(1)) / F.lit(float(n))).alias("pt"))
    pp = df.groupBy(F.col(pred).alias("c")).agg((F.count(F.lit(1)) / F.lit(float(n))).alias("pp"))
    return pt.join(pp, "c").agg(F.sum(F.col("pt") * F.col("pp")).alias("chance_agreement"))


def histogram(df: DataFrame, value: str, n_bins: int = 30, lo: float | None = None,
              hi: float | None = None, group_cols: list[str] = (), outside: bool = False) -> DataFrame:
    """Equal-width histogram: ``bin = least(n-1, floor((v - lo) / (hi - lo) * n))``
    with lo/hi the column's min/max unless given.  Returns (group, bin, lo_edge,
    hi_edge, count), empty bins included, so a group has ``n_bins`` rows.  Values outside
    [lo, hi] are in no bin, or with ``outside`` in bin -1 (below, open to minus infinity) and
    bin ``n_bins`` (above); null and NaN have no place on the axis.
    """
    v = F.col(value).cast("double")
    seen = df.filter(v.isNotNull() & ~F.isnan(v))
    if lo is None or hi is None:
        r = seen.agg(F.min(v).alias("lo"), F.max(v).alias("hi")).first()
        lo = r["lo"] if lo is None else lo
        hi = r["hi"] if hi is None else hi
    lo, hi = float(lo or 0.0), float(hi or 0.0)
    width = (hi - lo) if hi > lo else 1.0
    b = F.least(F.lit(n_bins - 1), F.floor((v - F.lit(lo)) / F.lit(width) * F.lit(n_bins))).cast("int")
    if outside:
        b = F.when(v < lo, -1).when(v > hi, n_bins).otherwise(b)
    counts = (seen.filter(F.lit(outside) | v.between(lo, hi)).groupBy(*group_cols, b.alias("bin"))
              .agg(F.count(F.lit(1)).alias("_n")))
    # a map of a group's filled bins, then every bin: no join, n_bins entries at most
    by_group = counts.groupBy(*group_cols).agg(
        F.map_from_entries(F.collect_list(F.struct("bin", "_n"))).alias("_m"))
    out = by_group.select(*group_cols, "_m", F.explode(F.sequence(F.lit(-1 if outside else 0), F.lit(n_bins if outside else n_bins - 1))).alias("bin"))
    low, high = (F.lit(lo) + (F.col("bin") + k) * F.lit(width) / F.lit(n_bins) for k in (0, 1))
    return out.select(*group_cols, "bin", F.when(F.col("bin") < 0, -math.inf).otherwise(low).alias("lo_edge"),
                      F.when(F.col("bin") >= n_bins, math.inf).otherwise(high).alias("hi_edge"),
                      F.coalesce(F.try_element_at("_m", F.col("bin")), F.lit(0)).cast("long").alias("count"))
