"""Scans and encodings: text layouts derived from the tables, parsed back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from duoclass.functions.columns import r6
from duoclass.operators import encode as E
from duoclass.operators.ordering import first_rows, ordered_index, row_slices, split_bounds, split_ordered
from duoclass.operators.vectors import dedupe_frame, densify_frame
from duoclass.plans.inputs import EMB_WIDTH, TRAIN_FRAC, embeddings_dense, table
from duoclass.session import scratch_path
from duoclass.sources import standins as S
from duoclass.sources import text as TX


def dense_csv_scan(spark, sf):
    lines = S.dense_csv_lines_from_lineitem(table(spark, sf, "lineitem"))
    rows = TX.good_rows(TX.parse_dense_csv(lines))
    return rows.select("l_orderkey", "l_linenumber", "label",
                       *[F.col("features")[k].alias(f"f{k}") for k in range(4)])


def scan_quarantine(spark, sf):
    """Rows read, kept and set aside by each reader on lines with faults of all kinds, each
    source read once: the counts are observed while good and bad rows are written."""
    lines = S.faulty_lines(table(spark, sf, "lineitem").select("l_orderkey", "l_quantity", "l_tax"))
    parsed = {"csv": lambda d: TX.parse_dense_csv(d, width=2), "keyed": lambda d: TX.parse_keyed_sparse(d, width=101),
              "svmlight": lambda d: TX.parse_svmlight(d, base=1)}
    out = None
    for name, parse in parsed.items():
        good, bad, n = TX.scan(lines.filter(F.col("layout") == name).select("value"), parse)
        kept = good.select(F.lit(1).alias("ok")).unionByName(bad.select(F.lit(0).alias("ok")))
        r = kept.agg(F.sum("ok").alias("n_ok"), F.sum(1 - F.col("ok")).alias("n_bad")).select(
            F.lit(name).alias("layout"), F.lit(n["n_rows"]).cast("long").alias("n_rows"), "n_ok", "n_bad")
        out = r if out is None else out.unionByName(r)
    return out


def _as_text(spark, lines, order):
    """Write lines as text files below the checkpoint root, in order, and read them as a
    user's files are read: with a row id."""
    path = scratch_path(spark, "text", uuid.uuid4().hex[:12])
    lines.orderBy(*order).select("value").write.text(path)
    return TX.read_lines(spark, path)


def text_csv_scan(spark, sf):
    lines = S.dense_csv_lines_from_lineitem(table(spark, sf, "lineitem"))
    rows = TX.parse_dense_csv(_as_text(spark, lines, ["l_orderkey", "l_linenumber", "value"]), width=4)
    return TX.good_rows(rows).select("row_id", "label", *[F.col("features")[k].alias(f"f{k}") for k in range(4)])


def text_keyed_scan(spark, sf):
    rows = TX.parse_keyed_sparse(_as_text(spark, S.keyed_lines_from_embeddings(table(spark, sf, "embeddings")), ["vec_id"]))
    return TX.good_rows(rows).select("row_id", "key", "label", F.inline("feats"))


def text_svmlight_scan(spark, sf):
    rows = TX.parse_svmlight(_as_text(spark, S.svm_lines_from_embeddings(table(spark, sf, "embeddings"), base=1), ["vec_id"]))
    return TX.good_rows(rows).select("row_id", "label", F.inline("feats"))


def text_token_scan(spark, sf):
    lines = _as_text(spark, S.token_lines_from_embeddings(table(spark, sf, "embeddings")), ["vec_id"])
    rows = TX.good_rows(TX.parse_onehot_tokens(lines, EMB_WIDTH + 1))
    return rows.select("row_id", "label", F.posexplode("features").alias("k", "f"))


def _keyed_lines(spark, sf):
    return S.keyed_lines_from_embeddings(table(spark, sf, "embeddings"))


def _keyed(spark, sf, width=None, truncate=False):
    return TX.good_rows(TX.parse_keyed_sparse(_keyed_lines(spark, sf), width=width, truncate=truncate))


def _keyed_indexed(spark, sf, name):
    """Good rows with their line number: lines are numbered before they are parsed, so the
    passes that find the numbers read the key only."""
    return TX.good_rows(TX.parse_keyed_sparse(ordered_index(_keyed_lines(spark, sf), "vec_id", name)))


def keyed_sparse_scan(spark, sf):
    return _keyed(spark, sf).select("key", "label", F.posexplode("feats").alias("pos", "cell")).select(
        "key", "label", "pos", F.col("cell.i").alias("i"), F.col("cell.v").alias("v"))


def sparse_triples(spark, sf):
    """COO triples; repeated indices in a row add up (per row, map-side)."""
    rows = _keyed_indexed(spark, sf, "row_id").select("row_id", "feats")
    return E.to_triples(dedupe_frame(rows, rule="sum"), "row_id")


def svmlight_scan(spark, sf):
    lines = S.svm_lines_from_embeddings(table(spark, sf, "embeddings"), base=1)
    rows = TX.good_rows(TX.parse_svmlight(lines, base="auto"))
    return rows.select("vec_id", "label", F.inline("feats"))


def onehot_token_scan(spark, sf):
    lines = S.token_lines_from_embeddings(table(spark, sf, "embeddings"))
    rows = TX.good_rows(TX.parse_onehot_tokens(lines, EMB_WIDTH + 1))
    return rows.select("vec_id", "label", F.posexplode("features").alias("k", "f"))


def row_cap(spark, sf, cap=10_000):
    """First ``cap`` orders in key order, with the full count (the capped read)."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    n = orders.count()
    return first_rows(orders, "o_orderkey", cap, "ix", n_rows=n).select(
        "o_orderkey", "o_totalprice", F.lit(n).cast("long").alias("n_total"))


def onehot_pair(spark, sf):
    emb = embeddings_dense(spark, sf)
    pair = E.onehot_pair(F.col("label"))
    return emb.select("vec_id", pair[0].alias("y0"), pair[1].alias("y1"))


def _svm_labels(spark, sf):
    lines = S.svm_lines_from_embeddings(table(spark, sf, "embeddings"))
    return TX.good_rows(TX.parse_svmlight(lines, base=1)).select("vec_id", F.col("label").alias("label_raw"))


def label_binarize(spark, sf):
    df, _ = E.label_binarize(_svm_labels(spark, sf), "label_raw", "label_bin")
    return df.select("vec_id", "label_raw", "label_bin")


def label_indicator_k(spark, sf):
    emb = table(spark, sf, "embeddings").select("vec_id", "label")
    df, _ = E.label_binarize(emb, "label", "ind")
    return df.select("vec_id", F.posexplode("ind").alias("k", "indicator"))


def feature_width(spark, sf):
    lines = S.dense_csv_lines_from_lineitem(table(spark, sf, "lineitem"))
    return E.feature_width(TX.good_rows(TX.parse_dense_csv(lines, width=None)))


def truncate_features(spark, sf, width=48):
    lines = S.svm_lines_from_embeddings(table(spark, sf, "embeddings"), base=1)
    rows = TX.good_rows(TX.parse_svmlight(lines, base=1, width=width, truncate=True))
    return rows.select("vec_id", F.inline("feats"))


def densify(spark, sf):
    rows = _keyed(spark, sf).select("key", "feats")
    return densify_frame(rows, EMB_WIDTH).select("key", F.posexplode("features").alias("i", "value"))


def _folded(spark, sf):
    lines = S.folded_keyed_lines(table(spark, sf, "embeddings"), fold=16)
    return TX.good_rows(TX.parse_keyed_sparse(lines))


def dup_index_last(spark, sf):
    rows = dedupe_frame(_folded(spark, sf).select("vec_id", "feats"), rule="last")
    return rows.select("vec_id", F.inline("feats")).select("vec_id", "i", r6("v").alias("v"))


def dup_index_sum(spark, sf):
    rows = dedupe_frame(_folded(spark, sf).select("vec_id", "feats"), rule="sum")
    return rows.select("vec_id", F.inline("feats")).select("vec_id", "i", r6("v").alias("v"))


def csr_triples(spark, sf):
    """Ordered split into train/test parts; each part's rows re-indexed from 0, with
    its shape (rows, width)."""
    lines = _keyed_lines(spark, sf)
    n_all = lines.count()
    n_train = split_bounds(n_all, TRAIN_FRAC, False)[1]
    parts = TX.good_rows(TX.parse_keyed_sparse(split_ordered(lines, "vec_id", TRAIN_FRAC, n_rows=n_all)))
    local = F.when(F.col("split") == "train", F.col("ix")).otherwise(F.col("ix") - F.lit(n_train))
    shape = F.when(F.col("split") == "train", F.lit(n_train)).otherwise(F.lit(n_all - n_train))
    t = parts.select(F.col("split").alias("part"), local.alias("row"), shape.cast("long").alias("n_rows"),
                     F.inline("feats"))
    return t.select("part", "row", F.col("i").alias("col"), F.col("v").alias("value"), "n_rows",
                    F.lit(EMB_WIDTH).alias("n_cols"))


def row_slice(spark, sf, size=100):
    lines = _keyed_lines(spark, sf)
    n = lines.count()
    rows = TX.good_rows(TX.parse_keyed_sparse(row_slices(ordered_index(lines, "vec_id", "ix", n_rows=n), size, n_rows=n)))
    return rows.select("slice", "row", F.inline("feats")).select(
        "slice", "row", F.col("i").alias("col"), F.col("v").alias("value"))


def zero_ratio_filter(spark, sf, lo=0.55, hi=0.59):
    rows = _keyed_indexed(spark, sf, "row_id").select("row_id", "feats")
    n = _keyed(spark, sf).count()
    kept, _ = E.zero_ratio_filter(E.to_triples(dedupe_frame(rows, rule="sum"), "row_id"), n, EMB_WIDTH, lo, hi)
    return kept.select("row_id", "col", "value")


QUERIES = {
    "scan_quarantine": scan_quarantine,
    "text_csv_scan": text_csv_scan,
    "text_keyed_scan": text_keyed_scan,
    "text_svmlight_scan": text_svmlight_scan,
    "text_token_scan": text_token_scan,
    "dense_csv_scan": dense_csv_scan,
    "keyed_sparse_scan": keyed_sparse_scan,
    "sparse_triples": sparse_triples,
    "svmlight_scan": svmlight_scan,
    "onehot_token_scan": onehot_token_scan,
    "row_cap": row_cap,
    "onehot_pair": onehot_pair,
    "label_binarize": label_binarize,
    "label_indicator_k": label_indicator_k,
    "feature_width": feature_width,
    "truncate_features": truncate_features,
    "densify": densify,
    "dup_index_last": dup_index_last,
    "dup_index_sum": dup_index_sum,
    "csr_triples": csr_triples,
    "row_slice": row_slice,
    "zero_ratio_filter": zero_ratio_filter,
}

# ----------------------------------------------------------------- oracles ---
# Shared CTE: embedding cells with their 0-based index, as DOUBLE.
CELLS = """cells AS (
  SELECT vec_id, label AS cls, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label01,
         CAST(unnest(embedding) AS DOUBLE) AS v, unnest(range(len(embedding))) AS i
  FROM embeddings)"""
KEPT = "abs(v) > CAST(0.1 AS DOUBLE)"

_ROW = "r AS (SELECT vec_id, CAST(row_number() OVER (ORDER BY vec_id) - 1 AS BIGINT) AS row_id FROM embeddings)"

ORACLE = {
    "scan_quarantine": """
WITH l AS (SELECT l_orderkey % 7 AS k, count(*) AS n FROM lineitem GROUP BY 1),
x(layout, k, read, ok) AS (SELECT v.layout, l.k, n, CASE
    WHEN v.layout = 'csv' AND l.k <= 2 THEN 0 WHEN v.layout = 'keyed' AND l.k <= 2 THEN 0
    WHEN v.layout = 'svmlight' AND l.k = 2 THEN 0 ELSE n END
  FROM l, (VALUES ('csv'), ('keyed'), ('svmlight')) v(layout) WHERE NOT (v.layout = 'svmlight' AND l.k = 0))
SELECT layout, CAST(sum(read) AS BIGINT) AS n_rows, CAST(sum(ok) AS BIGINT) AS n_ok, CAST(sum(read - ok) AS BIGINT) AS n_bad
FROM x GROUP BY layout""",
    "text_csv_scan": """
WITH l AS (SELECT *, CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END AS label,
  concat_ws(',', l_quantity, l_extendedprice, l_discount, l_tax, CASE WHEN l_returnflag = 'R' THEN '1' ELSE '0' END) AS value FROM lineitem)
SELECT CAST(row_number() OVER (ORDER BY l_orderkey, l_linenumber, value) - 1 AS BIGINT) AS row_id, CAST(label AS DOUBLE) AS label,
  CAST(l_quantity AS DOUBLE) AS f0, CAST(l_extendedprice AS DOUBLE) AS f1, CAST(l_discount AS DOUBLE) AS f2, CAST(l_tax AS DOUBLE) AS f3
FROM l""",
    "text_keyed_scan": f"""
WITH {CELLS}, {_ROW}
SELECT row_id, CAST(vec_id AS VARCHAR) AS key, CAST(label01 AS DOUBLE) AS label, CAST(i AS INTEGER) AS i, v
FROM cells JOIN r USING (vec_id) WHERE {KEPT}""",
    "text_svmlight_scan": f"""
WITH {CELLS}, {_ROW}
SELECT row_id, CASE WHEN label01 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS label, CAST(i AS INTEGER) AS i, v
FROM cells JOIN r USING (vec_id) WHERE {KEPT}""",
    "text_token_scan": f"""
WITH {CELLS}, {_ROW}, t AS (
  SELECT vec_id, label01, CAST(i + 1 AS INTEGER) AS k, CAST(CAST(floor(abs(v) * CAST(100 AS DOUBLE)) AS BIGINT) % 10 AS INTEGER) AS f FROM cells
  UNION ALL SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END, 0, CASE WHEN label < 5 THEN 1 ELSE 0 END FROM embeddings)
SELECT row_id, CAST(label01 AS DOUBLE) AS label, k, f FROM t JOIN r USING (vec_id)""",
    "dense_csv_scan": """
SELECT l_orderkey, l_linenumber,
       CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS label,
       CAST(l_quantity AS DOUBLE) AS f0, CAST(l_extendedprice AS DOUBLE) AS f1,
       CAST(l_discount AS DOUBLE) AS f2, CAST(l_tax AS DOUBLE) AS f3
FROM lineitem""",
    "keyed_sparse_scan": f"""
WITH {CELLS}
SELECT CAST(vec_id AS VARCHAR) AS key, CAST(label01 AS DOUBLE) AS label,
       CAST(row_number() OVER (PARTITION BY vec_id ORDER BY i) - 1 AS INTEGER) AS pos,
       CAST(i AS INTEGER) AS i, v
FROM cells WHERE {KEPT}""",
    "sparse_triples": f"""
WITH {CELLS}, r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM embeddings)
SELECT CAST(r.row_id AS BIGINT) AS row_id, CAST(i AS INTEGER) AS col, sum(v) AS value
FROM cells JOIN r USING (vec_id) WHERE {KEPT} GROUP BY r.row_id, i""",
    "svmlight_scan": f"""
WITH {CELLS}
SELECT vec_id, CASE WHEN label01 = 1 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS label,
       CAST(i AS INTEGER) AS i, v
FROM cells WHERE {KEPT}""",
    "onehot_token_scan": f"""
WITH {CELLS}
SELECT vec_id, CAST(label01 AS DOUBLE) AS label, CAST(i + 1 AS INTEGER) AS k,
       CAST(CAST(floor(abs(v) * CAST(100 AS DOUBLE)) AS BIGINT) % 10 AS INTEGER) AS f
FROM cells
UNION ALL
SELECT vec_id, CAST(CASE WHEN label < 5 THEN 1 ELSE 0 END AS DOUBLE) AS label, CAST(0 AS INTEGER) AS k,
       CAST(CASE WHEN label < 5 THEN 1 ELSE 0 END AS INTEGER) AS f
FROM embeddings""",
    "row_cap": """
SELECT o_orderkey, o_totalprice, CAST((SELECT count(*) FROM orders) AS BIGINT) AS n_total
FROM orders ORDER BY o_orderkey LIMIT 10000""",
    "onehot_pair": """
SELECT vec_id, CAST(CASE WHEN label < 5 THEN 1 ELSE 0 END AS DOUBLE) AS y0,
       CAST(CASE WHEN label < 5 THEN 0 ELSE 1 END AS DOUBLE) AS y1
FROM embeddings""",
    "label_binarize": """
SELECT vec_id, CASE WHEN label < 5 THEN CAST(1 AS DOUBLE) ELSE CAST(-1 AS DOUBLE) END AS label_raw,
       CAST(CASE WHEN label < 5 THEN 1 ELSE 0 END AS INTEGER) AS label_bin
FROM embeddings""",
    "label_indicator_k": """
WITH cls AS (SELECT label AS c, CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS k
             FROM (SELECT DISTINCT label FROM embeddings))
SELECT e.vec_id, cls.k AS k, CAST(CASE WHEN e.label = cls.c THEN 1 ELSE 0 END AS INTEGER) AS indicator
FROM embeddings e, cls""",
    "feature_width": """
SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(4 AS INTEGER) AS min_width, CAST(4 AS INTEGER) AS max_width
FROM lineitem""",
    "truncate_features": f"""
WITH {CELLS}
SELECT vec_id, CAST(i AS INTEGER) AS i, v FROM cells WHERE {KEPT} AND i < 48""",
    "densify": f"""
WITH {CELLS}
SELECT CAST(vec_id AS VARCHAR) AS key, CAST(i AS INTEGER) AS i,
       CASE WHEN {KEPT} THEN v ELSE CAST(0 AS DOUBLE) END AS value
FROM cells""",
    "dup_index_last": f"""
WITH {CELLS}
SELECT vec_id, CAST(i % 16 AS INTEGER) AS i, round(arg_max(v, i), 6) + CAST(0 AS DOUBLE) AS v
FROM cells WHERE {KEPT} GROUP BY vec_id, i % 16""",
    "dup_index_sum": f"""
WITH {CELLS}
SELECT vec_id, CAST(i % 16 AS INTEGER) AS i, round(sum(v), 6) + CAST(0 AS DOUBLE) AS v
FROM cells WHERE {KEPT} GROUP BY vec_id, i % 16""",
    "csr_triples": f"""
WITH {CELLS},
n AS (SELECT count(*) AS n_all, CAST(round(CAST(0.67 AS DOUBLE) * count(*)) AS BIGINT) AS k FROM embeddings),
r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ix FROM embeddings)
SELECT CASE WHEN r.ix < n.k THEN 'train' ELSE 'test' END AS part,
       CAST(CASE WHEN r.ix < n.k THEN r.ix ELSE r.ix - n.k END AS BIGINT) AS row,
       CAST(i AS INTEGER) AS col, v AS value,
       CAST(CASE WHEN r.ix < n.k THEN n.k ELSE n.n_all - n.k END AS BIGINT) AS n_rows,
       CAST(64 AS INTEGER) AS n_cols
FROM cells JOIN r USING (vec_id), n WHERE {KEPT}""",
    "row_slice": f"""
WITH {CELLS},
n AS (SELECT count(*) // 100 AS nb FROM embeddings),
r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS ix FROM embeddings)
SELECT CAST(r.ix // 100 AS BIGINT) AS slice, CAST(r.ix % 100 AS BIGINT) AS row,
       CAST(i AS INTEGER) AS col, v AS value
FROM cells JOIN r USING (vec_id), n WHERE {KEPT} AND r.ix < n.nb * 100""",
    "zero_ratio_filter": f"""
WITH {CELLS},
r AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS row_id FROM embeddings),
t AS (SELECT r.row_id, CAST(i AS INTEGER) AS col, v AS value FROM cells JOIN r USING (vec_id) WHERE {KEPT}),
z AS (SELECT col, CAST(1 AS DOUBLE) - CAST(count(DISTINCT row_id) AS DOUBLE) / CAST((SELECT count(*) FROM embeddings) AS DOUBLE) AS zs
      FROM t WHERE value <> 0 GROUP BY col)
SELECT CAST(row_id AS BIGINT) AS row_id, col, value FROM t
WHERE col IN (SELECT col FROM z WHERE zs BETWEEN CAST(0.55 AS DOUBLE) AND CAST(0.59 AS DOUBLE))""",
}
