"""Scoring and evaluation queries over the embeddings table."""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import functions as F

from duoclass.functions.columns import r6
from duoclass.functions.hashing import mix_uniform_col, mix_uniform_sql
from duoclass.operators import metrics as M
from duoclass.operators.encode import to_triples
from duoclass.operators.model import Model, intmod_model
from duoclass.operators.ordering import split_shuffled_fast
from duoclass.operators.scoring import (affine, affine_relational, argmax2, batch_norm_long, dense_sparse_diff, relu as relu_col,
                                        score, score_relational, softmax2, weights_frame)
from duoclass.operators.vectors import dedupe_frame
from duoclass.plans import sqlgen as Q
from duoclass.plans.inputs import EMB_WIDTH, HIDDEN2, HIDDEN3, SEED, TRAIN_FRAC, embeddings_dense, mlp2, mlp3, table
from duoclass.session import scratch_path
from duoclass.sources import standins as S
from duoclass.sources import text as TX

SCORE_COLS = ["y0", "y1", "p0", "p1"]


def _scored_out(s):
    return s.select("vec_id", "label", *[r6(c).alias(c) for c in SCORE_COLS], "pred")


def score_mlp2(spark, sf):
    return _scored_out(score(embeddings_dense(spark, sf), mlp2()))


def score_mlp3(spark, sf):
    return _scored_out(score(embeddings_dense(spark, sf), mlp3()))


def _scored2(spark, sf):
    return score(embeddings_dense(spark, sf), mlp2())


def _scored2_split(spark, sf):
    emb = split_shuffled_fast(embeddings_dense(spark, sf), "vec_id", SEED, TRAIN_FRAC)
    return score(emb, mlp2(), group_cols=["split"], keep=["vec_id", "label", "split"])


def accuracy(spark, sf):
    return M.accuracy(_scored2(spark, sf)).select(r6("accuracy").alias("accuracy"))


def cross_entropy(spark, sf):
    return M.cross_entropy(_scored2(spark, sf)).select(r6("cross_entropy").alias("cross_entropy"))


def roc_auc(spark, sf):
    return M.roc_auc(_scored2(spark, sf)).select(r6("roc_auc").alias("roc_auc"))


def roc_auc_macro(spark, sf):
    s = _scored2(spark, sf)
    return M.roc_auc_macro(s).select(r6("roc_auc_macro").alias("roc_auc_macro"))


def loss_by_split(spark, sf):
    return M.cross_entropy(_scored2_split(spark, sf), group_cols=["split"]).select(
        "split", r6("cross_entropy").alias("cross_entropy"))


def metric_report(spark, sf):
    rep = M.score_report(_scored2_split(spark, sf), group_cols=["split"])
    return rep.select(F.lit(0).alias("epoch"), "split", r6("accuracy").alias("accuracy"),
                      r6("cross_entropy").alias("cross_entropy"), r6("roc_auc").alias("roc_auc"))


def hard_auc_swapped(spark, sf):
    s = _scored2(spark, sf)
    out = M.hard_auc(s, truth=M.truth_index(F.col("label")), pred=F.col("pred"), swapped=True)
    return out.select("tp", "fp", "tn", "fn", r6("hard_auc").alias("hard_auc"))


def hard_auc(spark, sf):
    s = _scored2(spark, sf)
    out = M.hard_auc(s, truth=F.col("label"), pred=F.lit(1) - F.col("pred"), swapped=False)
    return out.select("tp", "fp", "tn", "fn", r6("hard_auc").alias("hard_auc"))


def dataset_shape(spark, sf):
    emb = embeddings_dense(spark, sf)
    return emb.agg(F.count(F.lit(1)).alias("n_rows"), F.max(F.size("features")).alias("n_features"),
                   F.lit(2).alias("n_outputs"))


def _long(df, arr, name, key="vec_id"):
    return df.select(key, F.posexplode(arr).alias("unit", name))


def affine_dense(spark, sf):
    m = mlp2()
    z = affine(embeddings_dense(spark, sf), m.hidden[0].W, m.hidden[0].b, keep=["vec_id"])
    return _long(z, "z", "z").select("vec_id", "unit", r6("z").alias("z"))


def _keyed_rows(spark, sf):
    lines = S.keyed_lines_from_embeddings(table(spark, sf, "embeddings"))
    return TX.good_rows(TX.parse_keyed_sparse(lines))


def affine_sparse(spark, sf):
    m = mlp2()
    z = affine(_keyed_rows(spark, sf), m.hidden[0].W, m.hidden[0].b, features="feats", sparse=True,
               keep=["vec_id"])
    return _long(z, "z", "z").select("vec_id", "unit", r6("z").alias("z"))


def _bn(spark, sf):
    m = mlp2()
    z = affine(embeddings_dense(spark, sf), m.hidden[0].W, m.hidden[0].b, keep=["vec_id"])
    zl = _long(z, "z", "z")
    h = m.hidden[0]
    sc = spark.createDataFrame([(int(j), float(h.scale[j]), float(h.beta[j])) for j in range(h.units)],
                               "unit int, scale double, beta double")
    return batch_norm_long(zl, scale=sc, eps=m.eps)


def batch_norm(spark, sf):
    return _bn(spark, sf).select("vec_id", "unit", r6("u").alias("u"))


def relu(spark, sf):
    return _bn(spark, sf).select("vec_id", "unit", r6(relu_col(F.col("u"))).alias("h"))


def dropout_mask(spark, sf, keep=0.5, step=0, layer=1, units=8):
    emb = table(spark, sf, "embeddings").select("vec_id")
    cells = emb.select("vec_id", F.explode(F.sequence(F.lit(0), F.lit(units - 1))).alias("unit"))
    u = mix_uniform_col(SEED, step * 16 + layer, F.col("vec_id"), F.col("unit"))
    return cells.select("vec_id", "unit", (F.when(u < F.lit(keep), F.lit(1.0)).otherwise(F.lit(0.0))
                                           / F.lit(keep)).alias("mask"))


def _linear_logits(spark, sf):
    m = intmod_model(EMB_WIDTH, [])
    z = affine(embeddings_dense(spark, sf), m.W_out, m.b_out, keep=["vec_id"])
    return z.select("vec_id", F.col("z")[0].alias("y0"), F.col("z")[1].alias("y1"))


def softmax(spark, sf):
    y = _linear_logits(spark, sf)
    p0, p1 = softmax2(F.col("y0"), F.col("y1"))
    return y.select("vec_id", r6(p0).alias("p0"), r6(p1).alias("p1"))


def argmax_class(spark, sf):
    y = _linear_logits(spark, sf)
    return y.select("vec_id", argmax2(F.col("y0"), F.col("y1")).alias("pred"))


def linear_score(spark, sf):
    """y = x * w + b with a stored model: w is saved as 2, then assigned 3 and saved again;
    the restored one scores every row."""
    from duoclass.sources.params_store import load_model, save_params
    root = scratch_path(spark, "params", uuid.uuid4().hex[:12])
    for version, w in enumerate((2.0, 3.0)):
        save_params(spark, Model([], np.array([[w]]), np.array([0.0])), root, "linear", version)
    m = load_model(spark, root, "linear")
    w, b = float(m.W_out[0, 0]), float(m.b_out[0])
    li = table(spark, sf, "lineitem")
    return li.select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("x"),
                     (F.col("l_quantity") * F.lit(w) + F.lit(b)).alias("y"))


def score_by_class(spark, sf):
    """Batch-norm moments of every class, joined to the rows (as for too many groups to ship)."""
    rows = table(spark, sf, "embeddings").select("vec_id", S.label01(F.col("label")).alias("label"),
                                                 F.col("label").alias("cls"), F.col("embedding").alias("features"))
    s = score(rows, mlp3(), group_cols=["cls"], keep=["vec_id", "label", "cls"], max_moment_rows=0)
    return s.select("vec_id", "cls", *[r6(c).alias(c) for c in SCORE_COLS], "pred")


def affine_relational_q(spark, sf):
    """The first layer as a join of stored cells with a weight table."""
    m = mlp2()
    rows = dedupe_frame(_keyed_rows(spark, sf).select("vec_id", "feats"), rule="last")
    cells = to_triples(rows, "vec_id")
    w, b = weights_frame(spark, m.hidden[0].W, m.hidden[0].b)
    z = affine_relational(cells, table(spark, sf, "embeddings").select("vec_id"), w, b, row="vec_id")
    return z.select("vec_id", "unit", r6("z").alias("z"))


def dense_sparse_reconcile(spark, sf):
    """The same keyed sparse file through the dense path (densify, then affine) and
    the sparse path (affine on stored cells), compared inside each row: both forms
    are computed on the same row, so no join is needed."""
    m = mlp2()
    per_row = dense_sparse_diff(_keyed_rows(spark, sf).select("vec_id", "feats"), m.hidden[0].W, m.hidden[0].b).select(
        "vec_id", "n_units", F.col("diff").alias("d"))
    return per_row.agg(F.count(F.lit(1)).alias("n_rows"), F.max("n_units").cast("long").alias("n_units"),
                       (F.round(F.max("d"), 9) + F.lit(0.0)).alias("max_abs_diff"),
                       F.sum(F.when(F.col("d") > F.lit(1e-9), 1).otherwise(0)).cast("long").alias("n_over_tol"))


def score_params_table(spark, sf):
    """Every row scored from the saved parameter table, each layer a join and an aggregate."""
    from duoclass.sources.params_store import load_params_frame, save_params
    root = scratch_path(spark, "params", uuid.uuid4().hex[:12])
    save_params(spark, mlp3(), root, "mlp", 0)
    emb = embeddings_dense(spark, sf)
    cells = emb.select("vec_id", F.posexplode("features").alias("col", "v")).select("vec_id", "col", F.col("v").cast("double").alias("value"))
    s = score_relational(cells, emb.select("vec_id"), load_params_frame(spark, root, "mlp"), row="vec_id")
    return s.select("vec_id", *[r6(c).alias(c) for c in SCORE_COLS], "pred")


QUERIES = {
    "score_mlp2": score_mlp2,
    "score_params_table": score_params_table,
    "score_mlp3": score_mlp3,
    "accuracy": accuracy,
    "cross_entropy": cross_entropy,
    "roc_auc": roc_auc,
    "roc_auc_macro": roc_auc_macro,
    "loss_by_split": loss_by_split,
    "metric_report": metric_report,
    "hard_auc_swapped": hard_auc_swapped,
    "hard_auc": hard_auc,
    "dataset_shape": dataset_shape,
    "affine_dense": affine_dense,
    "affine_sparse": affine_sparse,
    "batch_norm": batch_norm,
    "relu": relu,
    "dropout_mask": dropout_mask,
    "softmax": softmax,
    "argmax_class": argmax_class,
    "linear_score": linear_score,
    "score_by_class": score_by_class,
    "affine_relational": affine_relational_q,
    "dense_sparse_reconcile": dense_sparse_reconcile,
}

# ----------------------------------------------------------------- oracles ---
_R = Q.r6
_MLP2 = Q.emb_src() + ",\n" + Q.mlp_ctes("src", EMB_WIDTH, HIDDEN2)
_MLP3 = Q.emb_src() + ",\n" + Q.mlp_ctes("src", EMB_WIDTH, HIDDEN3)
_MLP2S = Q.emb_src("split") + ",\n" + Q.mlp_ctes("src", EMB_WIDTH, HIDDEN2)
_SCORED_SELECT = (f"SELECT id AS vec_id, label, {_R('y0')} AS y0, {_R('y1')} AS y1, {_R('p0')} AS p0, "
                  f"{_R('p1')} AS p1, pred FROM scored")
_CE = "-(CAST(label AS DOUBLE) * logp0 + (CAST(1 AS DOUBLE) - CAST(label AS DOUBLE)) * logp1)"
_TRUTH_IX = "CASE WHEN label = 1 THEN 0 ELSE 1 END"


def _hard_sql(t: str, p: str) -> str:
    e = "CAST(0.0000001 AS DOUBLE)"
    return f"""WITH {_MLP2},
c AS (SELECT CAST(sum(CASE WHEN {t} = 1 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS tp,
             CAST(sum(CASE WHEN {t} = 0 AND {p} = 1 THEN 1 ELSE 0 END) AS BIGINT) AS fp,
             CAST(sum(CASE WHEN {t} = 0 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS tn,
             CAST(sum(CASE WHEN {t} = 1 AND {p} = 0 THEN 1 ELSE 0 END) AS BIGINT) AS fn FROM scored),
r AS (SELECT *, CAST(tp + fn AS DOUBLE) AS P, CAST(fp + tn AS DOUBLE) AS N FROM c)
SELECT tp, fp, tn, fn,
  {_R(f"((N / (N + {e})) - fp / (N + {e})) * (CAST(1 AS DOUBLE) + (tp + {e}) / (P + {e})) / CAST(2 AS DOUBLE)"
      f" + (fp / (N + {e})) * ((tp + {e}) / (P + {e}) + {e} / (P + {e})) / CAST(2 AS DOUBLE)")} AS hard_auc
FROM r"""


def _affine_sql(cond: str) -> str:
    b = Q.intmod_sql(1, 1, "0", "w.j")
    return f"""WITH {Q.EMB_CELLS}, {Q.weights_cte('w1', 1, EMB_WIDTH, 8)},
ids AS (SELECT vec_id AS id FROM embeddings),
s AS (SELECT c.id, w.j, sum(c.v * w.w) AS s FROM emb_cells c JOIN w1 w ON c.i = w.i WHERE {cond} GROUP BY c.id, w.j),
u AS (SELECT ids.id, w.j FROM ids, (SELECT DISTINCT j FROM w1) w)
SELECT u.id AS vec_id, CAST(u.j AS INTEGER) AS unit, {_R(f"coalesce(s.s, CAST(0 AS DOUBLE)) + {b.replace('w.j', 'u.j')}")} AS z
FROM u LEFT JOIN s ON u.id = s.id AND u.j = s.j"""


_BN = f"""WITH {Q.EMB_CELLS}, {Q.weights_cte('w1', 1, EMB_WIDTH, 8)},
z AS (SELECT c.id, w.j, sum(c.v * w.w) + {Q.intmod_sql(1, 1, '0', 'w.j')} AS z
      FROM emb_cells c JOIN w1 w ON c.i = w.i GROUP BY c.id, w.j),
m AS (SELECT j, avg(z) AS mu, var_pop(z) AS var FROM z GROUP BY j),
bn AS (SELECT z.id, z.j, (CAST(1 AS DOUBLE) + {Q.intmod_sql(1, 2, '0', 'z.j')}) * ((z.z - m.mu) / sqrt(m.var + CAST(0.001 AS DOUBLE)))
              + {Q.intmod_sql(1, 3, '0', 'z.j')} AS u FROM z JOIN m ON z.j = m.j)"""

_LIN = f"""WITH {Q.EMB_CELLS}, {Q.weights_cte('wo', 1, EMB_WIDTH, 2)},
yl AS (SELECT c.id, w.j, sum(c.v * w.w) + {Q.intmod_sql(1, 1, '0', 'w.j')} AS y
       FROM emb_cells c JOIN wo w ON c.i = w.i GROUP BY c.id, w.j),
yp AS (SELECT id, max(CASE WHEN j = 0 THEN y END) AS y0, max(CASE WHEN j = 1 THEN y END) AS y1 FROM yl GROUP BY id),
ye AS (SELECT id, y0, y1, exp(y0 - greatest(y0, y1)) AS e0, exp(y1 - greatest(y0, y1)) AS e1 FROM yp)"""

ORACLE = {
    "score_params_table": f"WITH {_MLP3}\nSELECT id AS vec_id, {_R('y0')} AS y0, {_R('y1')} AS y1, {_R('p0')} AS p0, {_R('p1')} AS p1, pred FROM scored",
    "score_mlp2": f"WITH {_MLP2}\n{_SCORED_SELECT}",
    "score_mlp3": f"WITH {_MLP3}\n{_SCORED_SELECT}",
    "accuracy": f"WITH {_MLP2}\nSELECT {_R(f'avg(CASE WHEN pred = {_TRUTH_IX} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)')} AS accuracy FROM scored",
    "cross_entropy": f"WITH {_MLP2}\nSELECT {_R(f'avg({_CE})')} AS cross_entropy FROM scored",
    "roc_auc": f"WITH {_MLP2}\nSELECT {_R('roc_auc')} AS roc_auc FROM {Q.auc_sql('scored', 'p0', 'label')} a",
    "roc_auc_macro": (f"WITH {_MLP2}, fl AS (SELECT p1, 1 - label AS l1 FROM scored)\n"
                      f"SELECT {_R('(a0.a + a1.a) / CAST(2 AS DOUBLE)')} AS roc_auc_macro "
                      f"FROM {Q.auc_sql('scored', 'p0', 'label', out='a')} a0, {Q.auc_sql('fl', 'p1', 'l1', out='a')} a1"),
    "loss_by_split": f"WITH {_MLP2S}\nSELECT g AS split, {_R(f'avg({_CE})')} AS cross_entropy FROM scored GROUP BY g",
    "metric_report": (f"WITH {_MLP2S}, sc AS (SELECT g AS split, * FROM scored),\n"
                      f"acc AS (SELECT split, avg(CASE WHEN pred = {_TRUTH_IX} THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) AS accuracy, "
                      f"avg({_CE}) AS ce FROM sc GROUP BY split)\n"
                      f"SELECT 0 AS epoch, acc.split, {_R('accuracy')} AS accuracy, {_R('ce')} AS cross_entropy, "
                      f"{_R('auc.roc_auc')} AS roc_auc FROM acc JOIN {Q.auc_sql('sc', 'p0', 'label', 'split')} auc "
                      f"ON acc.split = auc.split"),
    "hard_auc_swapped": _hard_sql("pred", _TRUTH_IX),
    "hard_auc": _hard_sql("label", "(1 - pred)"),
    "dataset_shape": ("SELECT CAST(count(*) AS BIGINT) AS n_rows, CAST(max(len(embedding)) AS INTEGER) AS n_features, "
                      "2 AS n_outputs FROM embeddings"),
    "affine_dense": _affine_sql("TRUE"),
    "affine_sparse": _affine_sql("abs(c.v) > CAST(0.1 AS DOUBLE)"),
    "batch_norm": f"{_BN}\nSELECT id AS vec_id, CAST(j AS INTEGER) AS unit, {_R('u')} AS u FROM bn",
    "relu": f"{_BN}\nSELECT id AS vec_id, CAST(j AS INTEGER) AS unit, {_R('greatest(CAST(0 AS DOUBLE), u)')} AS h FROM bn",
    "dropout_mask": (f"SELECT vec_id, CAST(u.range AS INTEGER) AS unit, CASE WHEN "
                     f"({mix_uniform_sql(SEED, 1, 'vec_id', 'u.range')}) < CAST(0.5 AS DOUBLE) "
                     f"THEN CAST(2 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END AS mask FROM embeddings, range(8) u"),
    "softmax": f"{_LIN}\nSELECT id AS vec_id, {_R('e0 / (e0 + e1)')} AS p0, {_R('e1 / (e0 + e1)')} AS p1 FROM ye",
    "argmax_class": f"{_LIN}\nSELECT id AS vec_id, CASE WHEN y0 >= y1 THEN 0 ELSE 1 END AS pred FROM ye",
    "score_by_class": f"""WITH {Q.EMB_CELLS},
src AS (SELECT c.id, e.label AS g, c.label, c.i, c.v FROM emb_cells c JOIN embeddings e ON e.vec_id = c.id),
{Q.mlp_ctes("src", EMB_WIDTH, HIDDEN3)}
SELECT id AS vec_id, CAST(g AS INTEGER) AS cls, {_R('y0')} AS y0, {_R('y1')} AS y1, {_R('p0')} AS p0, {_R('p1')} AS p1, pred FROM scored""",
    "affine_relational": _affine_sql("abs(c.v) > CAST(0.1 AS DOUBLE)"),
    "linear_score": ("SELECT l_orderkey, l_linenumber, l_quantity AS x, "
                     "l_quantity * CAST(3 AS DOUBLE) + CAST(0 AS DOUBLE) AS y FROM lineitem"),
    "dense_sparse_reconcile": f"""WITH {Q.EMB_CELLS}, {Q.weights_cte('w1', 1, EMB_WIDTH, 8)},
d AS (SELECT c.id, w.j, sum(CASE WHEN abs(c.v) > CAST(0.1 AS DOUBLE) THEN c.v ELSE CAST(0 AS DOUBLE) END * w.w) AS z
      FROM emb_cells c JOIN w1 w ON c.i = w.i GROUP BY c.id, w.j),
s AS (SELECT c.id, w.j, sum(c.v * w.w) AS z FROM emb_cells c JOIN w1 w ON c.i = w.i
      WHERE abs(c.v) > CAST(0.1 AS DOUBLE) GROUP BY c.id, w.j),
x AS (SELECT d.id, d.j, abs(d.z - coalesce(s.z, CAST(0 AS DOUBLE))) AS diff FROM d LEFT JOIN s ON d.id = s.id AND d.j = s.j)
SELECT CAST(count(DISTINCT id) AS BIGINT) AS n_rows, CAST(count(DISTINCT j) AS BIGINT) AS n_units,
       round(max(diff), 9) + CAST(0 AS DOUBLE) AS max_abs_diff,
       CAST(sum(CASE WHEN diff > CAST(0.000000001 AS DOUBLE) THEN 1 ELSE 0 END) AS BIGINT) AS n_over_tol FROM x""",
}
