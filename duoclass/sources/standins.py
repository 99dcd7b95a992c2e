"""Derive the reference's text layouts from the given Parquet tables.

The scripts being re-expressed read text files that are not shipped.  These
builders produce the same layouts from the driver's tables with Spark
expressions only, so every reader can be exercised at table scale and checked
against a SQL oracle on the same tables.  Extra columns (ids) ride along.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def label01(label: Column, cut: int = 5) -> Column:
    """Binary stand-in label for the ten-class ``embeddings.label``: 1 if < cut."""
    return F.when(label < F.lit(cut), F.lit(1)).otherwise(F.lit(0))


def _cells(emb: Column, threshold: float, fmt) -> Column:
    t = F.lit(float(threshold))
    made = F.transform(emb, lambda x, i: F.when(F.abs(x.cast("double")) > t, fmt(x.cast("double"), i)))
    return F.filter(made, lambda c: c.isNotNull())


def dense_csv_lines_from_lineitem(li: DataFrame) -> DataFrame:
    """``l_quantity,l_extendedprice,l_discount,l_tax,label`` with label = returnflag 'R'."""
    label = F.when(F.col("l_returnflag") == F.lit("R"), F.lit("1")).otherwise(F.lit("0"))
    line = F.concat_ws(",", *[F.col(c).cast("string") for c in
                             ("l_quantity", "l_extendedprice", "l_discount", "l_tax")], label)
    return li.select("l_orderkey", "l_linenumber", line.alias("value"))


def keyed_lines_from_embeddings(emb: DataFrame, threshold: float = 0.1) -> DataFrame:
    """``vec_id<TAB>L i:v ...`` over cells with ``abs(v) > threshold`` (0-based)."""
    cells = _cells(F.col("embedding"), threshold,
                   lambda x, i: F.concat(i.cast("string"), F.lit(":"), x.cast("string")))
    line = F.concat(F.col("vec_id").cast("string"), F.lit("\t"),
                    label01(F.col("label")).cast("string"), F.lit(" "), F.concat_ws(" ", cells))
    return emb.select("vec_id", line.alias("value"))


def folded_keyed_lines(emb: DataFrame, fold: int = 16, threshold: float = 0.1) -> DataFrame:
    """Keyed lines whose index is ``i % fold``: rows carry repeated indices, the
    input for the duplicate-index rules (last value wins vs. values add up)."""
    cells = _cells(F.col("embedding"), threshold,
                   lambda x, i: F.concat((i % F.lit(fold)).cast("string"), F.lit(":"), x.cast("string")))
    line = F.concat(F.col("vec_id").cast("string"), F.lit("\t"),
                    label01(F.col("label")).cast("string"), F.lit(" "), F.concat_ws(" ", cells))
    return emb.select("vec_id", line.alias("value"))


def svm_lines_from_embeddings(emb: DataFrame, base: int = 1, threshold: float = 0.1) -> DataFrame:
    """``L i:v ...`` with L in {1, -1} (label < 5 is 1) and indices ``i + base``."""
    cells = _cells(F.col("embedding"), threshold,
                   lambda x, i: F.concat((i + F.lit(base)).cast("string"), F.lit(":"), x.cast("string")))
    lab = F.when(F.col("label") < F.lit(5), F.lit("1")).otherwise(F.lit("-1"))
    line = F.concat(lab, F.lit(" "), F.concat_ws(" ", cells))
    return emb.select("vec_id", line.alias("value"))


def token_lines_from_embeddings(emb: DataFrame) -> DataFrame:
    """``L c0dK c1dK ...``: one token per embedding cell whose last character is the
    digit ``floor(abs(v) * 100) % 10``."""
    toks = F.transform(F.col("embedding"), lambda x, i: F.concat(
        F.lit("c"), i.cast("string"), F.lit("d"),
        (F.floor(F.abs(x.cast("double")) * F.lit(100.0)) % F.lit(10)).cast("string")))
    line = F.concat(label01(F.col("label")).cast("string"), F.lit(" "), F.concat_ws(" ", toks))
    return emb.select("vec_id", line.alias("value"))


def faulty_lines(li: DataFrame) -> DataFrame:
    """(layout, value): lines of three layouts from ``lineitem``, some with a fault, in turn
    by order key: a blank line, a missing field, a word for a number, two colons in a token,
    an index beyond 100, an svmlight comment and ``qid:``, or none."""
    k = F.col("l_orderkey")
    q, t = F.col("l_quantity").cast("string"), F.col("l_tax").cast("string")
    csv = (F.when(k % 7 == 0, F.lit("")).when(k % 7 == 1, F.concat_ws(",", q, F.lit("1")))
           .when(k % 7 == 2, F.concat_ws(",", q, F.lit("word"), F.lit("0"))).otherwise(F.concat_ws(",", q, t, F.lit("1"))))
    keyed = (F.when(k % 7 == 0, F.lit("")).when(k % 7 == 1, F.concat(F.lit("k\t1 1:2:3 4:"), q))
             .when(k % 7 == 2, F.concat(F.lit("k\t1 700:"), q)).otherwise(F.concat(F.lit("k\t0 3:"), q)))
    svm = (F.when(k % 7 == 0, F.lit("# only a comment")).when(k % 7 == 1, F.concat(F.lit("1 qid:3 1:"), q, F.lit(" # note 5:5")))
           .when(k % 7 == 2, F.concat(F.lit("1 1:2:3 4:"), q)).otherwise(F.concat(F.lit("-1 2:"), q)))
    return li.select(F.stack(F.lit(3), F.lit("csv"), csv, F.lit("keyed"), keyed, F.lit("svmlight"), svm).alias("layout", "value"))
