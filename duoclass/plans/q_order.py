"""Shuffle / split / batch queries over orders, and label-table metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from duoclass.functions.columns import r6
from duoclass.operators import metrics as M
from duoclass.operators.ordering import minibatches, ordered_index, shuffled_index, split_shuffled, split_ordered
from duoclass.plans.inputs import SEED, TRAIN_FRAC, table

BATCH = 40


def _orders(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice")


def seeded_shuffle(spark, sf):
    return shuffled_index(_orders(spark, sf), "o_orderkey", SEED, "ix").select("o_orderkey", "ix")


def split_shuffled_q(spark, sf):
    return split_shuffled(_orders(spark, sf), "o_orderkey", SEED, TRAIN_FRAC, drop_edges=True).select(
        "o_orderkey", "ix", "split")


def split_shuffled_exact(spark, sf):
    return split_shuffled(_orders(spark, sf), "o_orderkey", SEED, TRAIN_FRAC, drop_edges=False).select(
        "o_orderkey", "ix", "split")


def split_ordered_q(spark, sf):
    return split_ordered(_orders(spark, sf), "o_orderkey", TRAIN_FRAC).select("o_orderkey", "ix", "split")


def minibatch_short(spark, sf):
    o = _orders(spark, sf)
    n = o.count()
    ix = shuffled_index(o, "o_orderkey", SEED, "ix", n_rows=n)
    return minibatches(ix, BATCH, short=True, n_rows=n).select("o_orderkey", "batch", "pos")


def minibatch_full(spark, sf):
    o = _orders(spark, sf)
    n = o.count()
    ix = shuffled_index(o, "o_orderkey", SEED, "ix", n_rows=n)
    return minibatches(ix, BATCH, short=False, n_rows=n).select("o_orderkey", "batch", "pos")


def minibatch_sequential(spark, sf):
    o = _orders(spark, sf)
    n = o.count()
    ix = ordered_index(o, "o_orderkey", "ix", n_rows=n)
    return minibatches(ix, BATCH, short=True, n_rows=n).select("o_orderkey", "batch", "pos")


def _labelled_docs(spark, sf):
    lab = table(spark, sf, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf, "documents").select("doc_id", "lang")
    return lab.join(docs, "doc_id")


def confusion(spark, sf):
    """Truth = quality, prediction = toxic, per document language."""
    d = _labelled_docs(spark, sf)
    return M.confusion(d, F.col("quality"), F.col("toxic"), group_cols=["lang"])


def chance_agreement(spark, sf):
    lab = table(spark, sf, "labels")
    return M.chance_agreement(lab, "quality", "toxic").select(r6("chance_agreement").alias("chance_agreement"))


def histogram(spark, sf):
    li = table(spark, sf, "lineitem")
    h = M.histogram(li, "l_extendedprice", 30)
    return h.select("bin", r6("lo_edge").alias("lo_edge"), r6("hi_edge").alias("hi_edge"), "count")


def _event_counts(ev):
    truth = (F.col("event_type") == F.lit("purchase")).cast("int")
    pred = (F.col("value") > F.lit(100.0)).cast("int")
    day = F.date_format(F.col("ts"), "yyyy-MM-dd")
    return M.confusion(ev.withColumn("day", day), truth, pred, group_cols=["day"])


def cumulative_auc(spark, sf):
    """Per-day evaluations with counters that are never reset (running totals)."""
    counts = _event_counts(table(spark, sf, "events"))
    out = M.cumulative_hard_auc(counts, "day", swapped=True)
    return out.select("day", "cum_tp", "cum_fp", "cum_tn", "cum_fn", r6("cumulative_auc").alias("cumulative_auc"))


def stream_confusion(spark, sf):
    from duoclass.streaming.counters import run_confusion_stream
    return run_confusion_stream(spark, sf)


QUERIES = {
    "seeded_shuffle": seeded_shuffle,
    "split_shuffled": split_shuffled_q,
    "split_shuffled_exact": split_shuffled_exact,
    "split_ordered": split_ordered_q,
    "minibatch_short": minibatch_short,
    "minibatch_full": minibatch_full,
    "minibatch_sequential": minibatch_sequential,
    "confusion": confusion,
    "chance_agreement": chance_agreement,
    "histogram": histogram,
    "cumulative_auc": cumulative_auc,
    "stream_confusion": stream_confusion,
}

# ----------------------------------------------------------------- oracles ---
_SHUF = ("SELECT o_orderkey, CAST(row_number() OVER (ORDER BY md5('42:' || CAST(o_orderkey AS VARCHAR)), "
         "o_orderkey) - 1 AS BIGINT) AS ix FROM orders")
_ORD = "SELECT o_orderkey, CAST(row_number() OVER (ORDER BY o_orderkey) - 1 AS BIGINT) AS ix FROM orders"
_NK = "nk AS (SELECT count(*) AS n, CAST(round(CAST(0.67 AS DOUBLE) * count(*)) AS BIGINT) AS k FROM orders)"


def _split_sql(src: str, d: int) -> str:
    return f"""WITH s AS ({src}), {_NK}
SELECT o_orderkey, ix, CASE WHEN ix < k - {d} THEN 'train' ELSE 'test' END AS split FROM s, nk
WHERE ix < k - {d} OR (ix >= k AND ix < n - {d})"""


def _batch_sql(src: str, short: bool) -> str:
    cond = f"AND ix % {BATCH} <> {BATCH - 1}" if short else ""
    return f"""WITH s AS ({src}), n AS (SELECT count(*) // {BATCH} AS nb FROM orders)
SELECT o_orderkey, CAST(ix // {BATCH} AS BIGINT) AS batch, CAST(ix % {BATCH} AS BIGINT) AS pos FROM s, n
WHERE ix // {BATCH} < nb {cond}"""


_EV = """c AS (SELECT strftime(ts, '%Y-%m-%d') AS day,
  CAST(sum(CASE WHEN event_type = 'purchase' AND value > CAST(100 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN event_type <> 'purchase' AND value > CAST(100 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN event_type <> 'purchase' AND NOT (value > CAST(100 AS DOUBLE)) THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN event_type = 'purchase' AND NOT (value > CAST(100 AS DOUBLE)) THEN 1 ELSE 0 END) AS BIGINT) AS fn
  FROM events GROUP BY 1)"""

_E = "CAST(0.0000001 AS DOUBLE)"

ORACLE = {
    "seeded_shuffle": _SHUF,
    "split_shuffled": _split_sql(_SHUF, 1),
    "split_shuffled_exact": _split_sql(_SHUF, 0),
    "split_ordered": f"WITH s AS ({_ORD}), {_NK}\nSELECT o_orderkey, ix, CASE WHEN ix < k THEN 'train' ELSE 'test' END AS split FROM s, nk",
    "minibatch_short": _batch_sql(_SHUF, True),
    "minibatch_full": _batch_sql(_SHUF, False),
    "minibatch_sequential": _batch_sql(_ORD, True),
    "confusion": """SELECT d.lang,
  CAST(sum(CASE WHEN quality = 1 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
  CAST(sum(CASE WHEN quality = 0 AND toxic = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
  CAST(sum(CASE WHEN quality = 0 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
  CAST(sum(CASE WHEN quality = 1 AND toxic = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn
FROM labels l JOIN documents d ON l.doc_id = d.doc_id GROUP BY d.lang""",
    "chance_agreement": """WITH n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM labels),
pt AS (SELECT quality AS c, count(*) / n.n AS pt FROM labels, n GROUP BY quality, n.n),
pp AS (SELECT toxic AS c, count(*) / n.n AS pp FROM labels, n GROUP BY toxic, n.n)
SELECT round(sum(pt * pp), 6) + CAST(0 AS DOUBLE) AS chance_agreement FROM pt JOIN pp ON pt.c = pp.c""",
    "histogram": """WITH r AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(least(29, floor((l_extendedprice - lo) / (hi - lo) * CAST(30 AS DOUBLE))) AS INTEGER) AS bin
      FROM lineitem, r),
c AS (SELECT bin, count(*) AS n FROM b GROUP BY bin)
SELECT CAST(a.range AS INTEGER) AS bin, round(lo + a.range * (hi - lo) / CAST(30 AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS lo_edge,
       round(lo + (a.range + 1) * (hi - lo) / CAST(30 AS DOUBLE), 6) + CAST(0 AS DOUBLE) AS hi_edge,
       CAST(coalesce(n, 0) AS BIGINT) AS count
FROM range(30) a, r LEFT JOIN c ON c.bin = a.range""",
    "cumulative_auc": f"""WITH {_EV},
r AS (SELECT day,
  CAST(sum(tp) OVER w AS BIGINT) AS cum_tp, CAST(sum(fp) OVER w AS BIGINT) AS cum_fp,
  CAST(sum(tn) OVER w AS BIGINT) AS cum_tn, CAST(sum(fn) OVER w AS BIGINT) AS cum_fn
  FROM c WINDOW w AS (ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
q AS (SELECT *, cum_tp AS tp, cum_fn AS fp, cum_tn AS tn, cum_fp AS fn,
             CAST(cum_tp + cum_fp AS DOUBLE) AS P, CAST(cum_fn + cum_tn AS DOUBLE) AS N FROM r)
SELECT day, cum_tp, cum_fp, cum_tn, cum_fn,
  round(((N / (N + {_E})) - fp / (N + {_E})) * (CAST(1 AS DOUBLE) + (tp + {_E}) / (P + {_E})) / CAST(2 AS DOUBLE)
        + (fp / (N + {_E})) * ((tp + {_E}) / (P + {_E}) + {_E} / (P + {_E})) / CAST(2 AS DOUBLE), 6)
  + CAST(0 AS DOUBLE) AS cumulative_auc FROM q""",
    "stream_confusion": """SELECT CAST(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS INTEGER) AS truth,
  CAST(CASE WHEN value > CAST(100 AS DOUBLE) THEN 1 ELSE 0 END AS INTEGER) AS pred, CAST(count(*) AS BIGINT) AS n
FROM events GROUP BY 1, 2""",
}
