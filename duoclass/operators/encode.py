"""Label and feature encodings (built-in expressions, joins and aggregates)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from duoclass.session import MAX_BROADCAST_CELLS


def onehot_pair(label: Column) -> Column:
    """``[l, 1 - l]``: column 0 is the positive class."""
    l = label.cast("double")
    return F.array(l, F.lit(1.0) - l)


def labels_for_model(label: Column, n_outputs: int) -> Column:
    """Targets shaped for the model: the one-hot pair when its output width is 2,
    the plain class index otherwise (a forest takes the label itself)."""
    return onehot_pair(label) if n_outputs == 2 else label.cast("int")


def label_classes(df: DataFrame, label: str) -> DataFrame:
    """Distinct labels in sorted order with their 0-based class index; null is no class.

    The distinct set is aggregated first (partial aggregation per task), so the
    window that ranks it sees one row per class, never one per example.
    """
    d = df.select(F.col(label).alias("_cls")).filter(F.col(label).isNotNull()).distinct()
    return d.withColumn("_k", (F.dense_rank().over(Window.orderBy("_cls")) - 1).cast("int"))


def label_binarize(df: DataFrame, label: str, out: str = "label_bin") -> tuple[DataFrame, int]:
    """Two classes -> one 0/1 column (1 for the larger label); K > 2 -> an
    ``ARRAY<INT>`` of K indicators in sorted class order.  A null label is no class:
    its output is null.  Returns (df, K)."""
    k = df.select(label).filter(F.col(label).isNotNull()).distinct().count()
    classes = label_classes(df, label)
    side = F.broadcast(classes) if k <= MAX_BROADCAST_CELLS // 2 else classes
    j = df.join(side, df[label] == classes["_cls"], "left").drop("_cls")
    if k <= 2:
        return j.withColumn(out, F.col("_k")).drop("_k"), k
    ind = F.transform(F.sequence(F.lit(0), F.lit(k - 1)),
                      lambda c: F.when(c == F.col("_k"), F.lit(1)).otherwise(F.lit(0)))
    return j.withColumn(out, F.when(F.col("_k").isNotNull(), ind)).drop("_k"), k


def truncate_feats(feats: Column, width: int) -> Column:
    """Keep sparse cells with index < width (do this before densifying)."""
    return F.filter(feats, lambda f: f["i"] < F.lit(width))


def truncate_dense(features: Column, width: int) -> Column:
    return F.slice(features, 1, width)


def feature_width(df: DataFrame, features: str = "features") -> DataFrame:
    """Rows, min and max feature count: a ragged input shows min != max."""
    s = F.size(features)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.min(s).alias("min_width"),
                  F.max(s).alias("max_width"))


def to_triples(df: DataFrame, row: str, feats: str = "feats") -> DataFrame:
    """COO triples ``(row, col, value)`` from per-row sparse cells."""
    return df.select(row, F.inline(F.col(feats))).select(
        row, F.col("i").alias("col"), F.col("v").alias("value"))


def zero_ratio_filter(triples: DataFrame, n_rows: int, width: int, lo: float, hi: float,
                      row: str = "row_id") -> tuple[DataFrame, DataFrame]:
    """Drop feature columns whose share of zero cells lies outside [lo, hi].

    Zero share of a column = 1 - (rows with a non-zero stored cell) / n_rows.
    ``triples`` must hold one cell per (row, col) (dedupe rows map-side first, e.g.
    :func:`duoclass.operators.vectors.dedupe_frame`), so the count per column is a
    partial aggregation, not a shuffle of every cell.  The per-column table has at
    most ``width`` rows (broadcast within the bound); the triples are kept with a
    left-semi join.  Returns (kept triples, column stats).
    """
    nz = triples.filter(F.col("value") != F.lit(0.0)).groupBy("col").agg(
        F.count(F.lit(1)).alias("nnz"))
    cols = triples.sparkSession.range(width).select(F.col("id").cast("int").alias("col"))
    stats = cols.join(nz, "col", "left").select(
        "col", (F.lit(1.0) - F.coalesce(F.col("nnz"), F.lit(0)).cast("double") / F.lit(float(n_rows)))
        .alias("zero_share"))
    keep = stats.filter(F.col("zero_share").between(lo, hi)).select("col")
    keep_b = F.broadcast(keep) if width <= MAX_BROADCAST_CELLS else keep
    return triples.join(keep_b, "col", "left_semi"), stats
