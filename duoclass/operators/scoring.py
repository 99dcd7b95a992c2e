"""Scoring a table with a batch-normalised network (forward pass at table scale).

Batch-norm uses the moments of the rows being scored (per ``group_cols`` group,
e.g. per split), so a pass over L hidden layers is:

* L moment passes: ``mapInPandas`` computes layer l's pre-activation per Arrow
  batch and emits mergeable (n, mean, M2) per (group, unit) - one row per unit per
  partition; ``groupBy`` merges them (map-side partial aggregation).
* one output pass: ``mapInPandas`` with the parameters and moments shipped as a
  broadcast variable (both model-sized; sizes checked against ``MAX_BROADCAST_CELLS``).

No pass shuffles rows; the only exchanges carry per-partition moment rows, summed
around one fixed centre so that they combine before the shuffle.  When the moments
do not fit the bound (very many groups) they stay a table and are joined to the rows
by group.  :func:`score` refuses a model beyond ``MAX_MODEL_CELLS``; :func:`score_relational`
takes the parameter table itself (each layer a join and an aggregate), whatever its size.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoclass.operators.encode import truncate_feats
from duoclass.operators.kernels import Inputs, Moments, forward, log_softmax, slices, softmax
from duoclass.operators.model import Model
from duoclass.operators.vectors import dedupe_cells
from duoclass.session import MAX_BROADCAST_CELLS, MAX_MODEL_CELLS, release, share, ship_package


# ---------------------------------------------------------------- inputs -----

def dense_input(df: DataFrame, features: str = "features") -> DataFrame:
    return df.withColumn("_x", F.col(features).cast("array<double>"))


def sparse_input(df: DataFrame, feats: str = "feats") -> DataFrame:
    """``feats ARRAY<STRUCT<i,v>>`` -> parallel ``_xi``/``_xv`` arrays (Arrow-friendly)."""
    return (df.withColumn("_xi", F.transform(feats, lambda f: f["i"].cast("int")))
              .withColumn("_xv", F.transform(feats, lambda f: f["v"].cast("double"))))


def _inputs_of(pdf: pd.DataFrame, d: int, truncate: bool = False) -> Inputs:
    if "_x" in pdf.columns:
        return Inputs.from_dense(pdf["_x"], d)
    return Inputs.from_sparse(pdf["_xi"], pdf["_xv"], d, truncate)


def _input_cols(df: DataFrame) -> list[str]:
    if "_x" in df.columns:
        return ["_x"]
    if "_xi" in df.columns:
        return ["_xi", "_xv"]
    raise ValueError("call dense_input() or sparse_input() first")


def _check_model_size(model: Model) -> None:
    if model.n_cells > MAX_MODEL_CELLS:
        raise ValueError(
            f"model has {model.n_cells} cells, above the bound {MAX_MODEL_CELLS}; "
            "use score_relational() on its parameter table")


def _norm_key(k) -> tuple:
    """pandas reports a null group value as NaN; Spark rows give None."""
    k = k if isinstance(k, tuple) else (k,)
    return tuple(None if (v is None or (isinstance(v, float) and np.isnan(v)) or v is pd.NA) else v for v in k)


def _group_key(pdf: pd.DataFrame, group_cols: list[str]):
    if not group_cols:
        return [((), pdf)]
    return [(_norm_key(k), g) for k, g in pdf.groupby(group_cols, sort=False, dropna=False)]


# --------------------------------------------------------------- moments -----

def _known_moments(key: tuple, g: pd.DataFrame, moments: dict, upto: int) -> list:
    """(mean, std) of hidden layers 1..upto: joined to the rows, or from the dict."""
    if "_mu1" in g.columns:
        return [(np.asarray(g[f"_mu{l}"].iloc[0]), np.asarray(g[f"_sd{l}"].iloc[0])) for l in range(1, upto + 1)]
    return [moments[(key, l)] for l in range(1, upto + 1)]


def _moment_cols(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.startswith(("_mu", "_sd"))]


def layer_moments(df: DataFrame, model: Model, layer: int, moments: dict,
                  group_cols: list[str] = (), dropout: dict | None = None,
                  row_id: str | None = None, handles: list | None = None) -> DataFrame:
    """Per (group, unit): n, mean and population variance of hidden layer ``layer``'s
    pre-activation.  ``moments`` holds the earlier layers (see :func:`collect_moments`).
    ``dropout`` (seed, step, keep, input) applies training masks keyed by ``row_id``.

    Tasks emit (n, sum(z - c), sum((z - c)^2)) per unit around a centre ``c`` close to
    the data (one row's pre-activation), so the sums combine map-side without the loss
    of precision that sums around zero have.
    """
    _check_model_size(model)
    group_cols = list(group_cols)
    d = model.n_inputs
    cols = group_cols + _input_cols(df) + _moment_cols(df) + ([row_id] if dropout else [])
    src = df.select(*cols)

    def pre_activation(model_, moments_, key, g):
        drop = dict(dropout, row_ids=g[row_id].values.astype(np.int64)) if dropout else None
        return forward(_inputs_of(g, d), model_, _known_moments(key, g, moments_, layer - 1), stop_at=layer,
                       dropout=drop)["z"][-1]

    head = src.limit(1).toPandas()
    centre = np.zeros(model.hidden[layer - 1].units)
    for key, g in _group_key(head, group_cols):
        centre = pre_activation(model, moments, key, g)[0]
    gfields = [df.schema[c] for c in group_cols]
    schema = T.StructType(gfields + [T.StructField("unit", T.IntegerType()), T.StructField("n", T.LongType()),
                                     T.StructField("c", T.DoubleType()), T.StructField("s1", T.DoubleType()),
                                     T.StructField("s2", T.DoubleType())])
    shared = share(df, (model, moments, centre), handles)

    def fn(it):
        model_, moments_, c = shared.value
        acc: dict = {}
        for pdf in it:
            for key, g in _group_key(pdf, group_cols):
                for part in slices(g, d, model_.n_units):
                    z = pre_activation(model_, moments_, key, part)
                    acc.setdefault(key, Moments(z.shape[1])).add(z)
        for key, m in acc.items():
            k = len(m.mean)
            out = {g: [key[i]] * k for i, g in enumerate(group_cols)}
            out.update(unit=np.arange(k, dtype=np.int32), n=np.full(k, m.n, dtype=np.int64), c=c,
                       s1=m.n * (m.mean - c), s2=m.m2 + m.n * (m.mean - c) ** 2)
            yield pd.DataFrame(out)

    ship_package(df.sparkSession)
    n, s1 = F.sum("n"), F.sum("s1")
    return src.mapInPandas(fn, schema).groupBy(*group_cols, "unit").agg(
        n.alias("n"), (F.max("c") + s1 / n).alias("mean"),
        F.greatest(F.sum("s2") / n - (s1 / n) * (s1 / n), F.lit(0.0)).alias("var"))


def collect_moments(df: DataFrame, model: Model, group_cols: list[str] = (),
                    max_rows: int = MAX_BROADCAST_CELLS // 3) -> dict | None:
    """All hidden layers' moments as ``{(group_key, layer): (mean, std)}``.

    Each layer is one job; its result (groups x units rows) is size-checked before
    it is brought to the driver and shipped to the next pass.  None if there are more
    than ``max_rows`` of them (:func:`join_moments` then).
    """
    group_cols = list(group_cols)
    moments: dict = {}
    for l, layer in enumerate(model.hidden, start=1):
        handles: list = []
        rows = layer_moments(df, model, l, moments, group_cols, handles=handles).limit(max_rows + 1).collect()
        release(handles)
        if len(rows) > max_rows:
            return None
        per: dict = {}
        for r in rows:
            key = tuple(r[c] for c in group_cols)
            per.setdefault(key, {})[r["unit"]] = (r["mean"], r["var"])
        for key, units in per.items():
            mu = np.array([units[u][0] for u in range(layer.units)])
            var = np.array([units[u][1] for u in range(layer.units)])
            moments[(key, l)] = (mu, np.sqrt(var + model.eps))
    return moments


def join_moments(df: DataFrame, model: Model, group_cols: list[str]) -> DataFrame:
    """Each row with its group's moments as ``_mu1, _sd1, ...`` arrays: a join by group
    per hidden layer (null groups match; a hot group's rows are split by the skew join)."""
    for l in range(1, len(model.hidden) + 1):
        m = layer_moments(df, model, l, {}, group_cols)
        cells = F.sort_array(F.collect_list(F.struct("unit", "mean", "var")))
        by = m.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group_cols]).agg(cells.alias("_cells"))
        on = None
        for c in group_cols:
            same = F.col(c).eqNullSafe(F.col(f"_g_{c}"))
            on = same if on is None else on & same
        df = (df.join(by, on).withColumn(f"_mu{l}", F.col("_cells.mean"))
                .withColumn(f"_sd{l}", F.transform("_cells.var", lambda v: F.sqrt(v + F.lit(model.eps))))
                .drop("_cells", *[f"_g_{c}" for c in group_cols]))
    return df


# ---------------------------------------------------------------- scoring ----

def score(df: DataFrame, model: Model, features: str = "features", sparse: bool = False,
          group_cols: list[str] = (), keep: list[str] | None = None, truncate: bool = False,
          max_moment_rows: int = MAX_BROADCAST_CELLS // 3) -> DataFrame:
    """Score every row: logits ``y0..``, softmax ``p0..`` and ``pred`` (argmax, ties to
    the lowest index).  Column 0 is the positive class (one-hot is ``[l, 1-l]``), so
    ``pred = 0`` means "label 1".  ``keep`` columns ride along (default: all but the
    features).  A row of another width than the model's is an error; ``truncate`` drops
    the sparse cells beyond it before anything is computed."""
    _check_model_size(model)
    group_cols = list(group_cols)
    if sparse and truncate:
        df = df.withColumn(features, truncate_feats(F.col(features), model.n_inputs))
    prepared = sparse_input(df, features) if sparse else dense_input(df, features)
    keep = [c for c in (keep if keep is not None else df.columns) if c != features]
    for g in group_cols:
        if g not in keep:
            keep.append(g)
    moments = collect_moments(prepared, model, group_cols, max_moment_rows)
    if moments is None:
        moments, prepared = {}, join_moments(prepared, model, group_cols)
    d, k = model.n_inputs, model.n_outputs
    out_fields = [prepared.schema[c] for c in keep]
    out_fields += [T.StructField(f"y{j}", T.DoubleType()) for j in range(k)]
    out_fields += [T.StructField(f"p{j}", T.DoubleType()) for j in range(k)]
    out_fields += [T.StructField("logp0", T.DoubleType()), T.StructField("logp1", T.DoubleType()),
                   T.StructField("pred", T.IntegerType())]
    schema = T.StructType(out_fields)
    shared = share(df, (model, moments))

    def fn(it):
        model_, moments_ = shared.value
        for pdf in it:
            for key, g in _group_key(pdf, group_cols):
                mom = _known_moments(key, g, moments_, len(model_.hidden))
                for part in slices(g, d, model_.n_units):
                    y = forward(_inputs_of(part, d), model_, mom)["y"]
                    p = softmax(y)
                    lp = log_softmax(y)
                    out = {c: part[c].values for c in keep}
                    for j in range(k):
                        out[f"y{j}"] = y[:, j]
                    for j in range(k):
                        out[f"p{j}"] = p[:, j]
                    out["logp0"] = lp[:, 0]
                    out["logp1"] = lp[:, 1] if k > 1 else np.zeros(len(part))
                    out["pred"] = np.argmax(y, axis=1).astype(np.int32)
                    yield pd.DataFrame(out)

    ship_package(df.sparkSession)
    return prepared.select(*keep, *_input_cols(prepared), *_moment_cols(prepared)).mapInPandas(fn, schema)


def affine(df: DataFrame, W: np.ndarray, b: np.ndarray, features: str = "features",
           sparse: bool = False, keep: list[str] | None = None, out: str = "z") -> DataFrame:
    """``z = x W + b`` per row as ``ARRAY<DOUBLE>`` (dense rows or sparse struct arrays)."""
    if W.size > MAX_MODEL_CELLS:
        raise ValueError("weight matrix above the broadcast bound; use affine_relational()")
    prepared = sparse_input(df, features) if sparse else dense_input(df, features)
    keep = [c for c in (keep if keep is not None else df.columns) if c != features]
    schema = T.StructType([prepared.schema[c] for c in keep] +
                          [T.StructField(out, T.ArrayType(T.DoubleType()))])
    d = W.shape[0]
    shared = share(df, (W, b))

    def fn(it):
        W_, b_ = shared.value
        for pdf in it:
            for part in slices(pdf, d, W_.shape[1]):
                z = _inputs_of(part, d).matmul(W_) + b_
                res = {c: part[c].values for c in keep}
                res[out] = list(z)
                yield pd.DataFrame(res)

    ship_package(df.sparkSession)
    return prepared.select(*keep, *_input_cols(prepared)).mapInPandas(fn, schema)


def dense_sparse_diff(df: DataFrame, W: np.ndarray, b: np.ndarray, features: str = "feats",
                      keep: list[str] | None = None) -> DataFrame:
    """``x W + b`` of sparse rows both ways in one pass: on stored cells, and after
    densifying (last value of a repeated index wins in both).  Per row: units, and the
    largest absolute difference."""
    prepared = sparse_input(df, features)
    keep = [c for c in (keep if keep is not None else df.columns) if c != features]
    schema = T.StructType([prepared.schema[c] for c in keep] + [T.StructField("n_units", T.IntegerType()),
                                                                T.StructField("diff", T.DoubleType())])
    d = W.shape[0]
    shared = share(df, (W, b))

    def fn(it):
        W_, b_ = shared.value
        for pdf in it:
            for part in slices(pdf, d, W_.shape[1], dense=True):
                x = _inputs_of(part, d)
                rows, idx, val = dedupe_cells(x.rows, x.idx, x.val, "last")
                dense = np.zeros((x.n, d))
                dense[rows, idx] = val
                zs = Inputs(x.n, d, rows=rows, idx=idx, val=val).matmul(W_) + b_
                out = {c: part[c].values for c in keep}
                out["n_units"] = np.full(x.n, W_.shape[1], dtype=np.int32)
                out["diff"] = np.abs(dense @ W_ + b_ - zs).max(axis=1)
                yield pd.DataFrame(out)

    ship_package(df.sparkSession)
    return prepared.select(*keep, *_input_cols(prepared)).mapInPandas(fn, schema)


# ------------------------------------------------------- relational forms ----

def weights_frame(spark, W: np.ndarray, b: np.ndarray | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(i, j, w) and (j, b) tables for the relational forms."""
    ii, jj = np.indices(W.shape)
    wdf = spark.createDataFrame(pd.DataFrame({"i": ii.ravel().astype(np.int32),
                                              "j": jj.ravel().astype(np.int32),
                                              "w": W.ravel().astype(np.float64)}))
    bdf = None
    if b is not None:
        bdf = spark.createDataFrame(pd.DataFrame({"j": np.arange(len(b), dtype=np.int32),
                                                  "b": np.asarray(b, dtype=np.float64)}))
    return wdf, bdf


def affine_relational(triples: DataFrame, rows: DataFrame, weights: DataFrame, bias: DataFrame,
                      row: str = "row_id", col: str = "col", value: str = "value") -> DataFrame:
    """Sparse affine as a join: ``(row, col, value) JOIN (i, j, w) ON col = i``,
    summed per (row, j), plus the bias.  Only stored cells contribute; a row with no
    stored cell still gets ``z = b`` because every (row, unit) starts from the
    row list (``rows``) with the bias vector's units exploded onto it.

    The weight table is broadcast when it is within the bound, otherwise joined
    with a shuffle on the column index.
    """
    n_w = weights.count()
    w = F.broadcast(weights) if n_w <= MAX_BROADCAST_CELLS // 3 else weights
    prod = (triples.join(w, triples[col] == w["i"])
                   .groupBy(row, "j").agg(F.sum(F.col(value) * F.col("w")).alias("_s")))
    # every row has every unit: an output of rows x units, made by exploding the bias vector
    vec = sorted((r["j"], r["b"]) for r in bias.select("j", "b").collect())
    pairs = F.arrays_zip(F.lit([j for j, _ in vec]).alias("j"), F.lit([b for _, b in vec]).alias("b"))
    base = rows.select(row, F.inline(pairs).alias("j", "b"))
    return (base.join(prod, [row, "j"], "left")
                .select(row, F.col("j").alias("unit"),
                        (F.col("b") + F.coalesce(F.col("_s"), F.lit(0.0))).alias("z")))


def batch_norm_long(df: DataFrame, unit: str = "unit", value: str = "z", scale: DataFrame | None = None,
                    group_cols: list[str] = (), eps: float = 1e-3, out: str = "u") -> DataFrame:
    """Batch normalisation on a long (row, unit, z) table: population moments per
    (group, unit) - an aggregate with one row per unit - broadcast back and applied.
    ``scale`` is a (unit, scale, beta) table; without it scale = 1, shift = 0."""
    keys = list(group_cols) + [unit]
    mom = df.groupBy(*keys).agg(F.avg(value).alias("_mu"), F.var_pop(value).alias("_var"))
    small = not group_cols or mom.count() <= MAX_BROADCAST_CELLS // 4  # groups x units rows
    j = df.join(F.broadcast(mom) if small else mom, keys)
    zh = (F.col(value) - F.col("_mu")) / F.sqrt(F.col("_var") + F.lit(eps))
    if scale is not None:
        n_units = scale.count()
        j = j.join(F.broadcast(scale) if n_units <= MAX_BROADCAST_CELLS // 4 else scale, unit)
        res = F.col("scale") * zh + F.col("beta")
        return j.withColumn(out, res).drop("_mu", "_var", "scale", "beta")
    return j.withColumn(out, zh).drop("_mu", "_var")


def score_relational(cells: DataFrame, rows: DataFrame, params: DataFrame, row: str = "row_id", eps: float = 1e-3) -> DataFrame:
    """(<row>, y0, y1, p0, p1, pred): the whole network from its parameter table.

    ``cells`` are the rows' stored input cells (<row>, col, value), ``rows`` all row ids (a
    row without a cell is scored as well) and ``params`` (layer, name, i, j, value), two
    outputs.  The model never reaches the driver but for a layer's bias vector.
    """
    last = params.where("name = 'W'").agg(F.max("layer").alias("l")).first()["l"]

    def part(layer, name):
        return params.where((F.col("layer") == layer) & (F.col("name") == name))

    for layer in range(1, last + 1):
        weights = part(layer, "W").select("i", "j", F.col("value").alias("w"))
        bias = part(layer, "b").select("j", F.col("value").alias("b"))
        z = affine_relational(cells, rows, weights, bias, row=row)
        if layer == last:
            break
        scale = (part(layer, "scale").select(F.col("j").alias("unit"), F.col("value").alias("scale"))
                 .join(part(layer, "beta").select(F.col("j").alias("unit"), F.col("value").alias("beta")), "unit"))
        u = batch_norm_long(z, scale=scale, eps=eps)
        cells = u.select(row, F.col("unit").alias("col"), relu(F.col("u")).alias("value"))
    y = z.groupBy(row).agg(*[F.max(F.when(F.col("unit") == k, F.col("z"))).alias(f"y{k}") for k in (0, 1)])
    p0, p1 = softmax2(F.col("y0"), F.col("y1"))
    return y.select(row, "y0", "y1", p0.alias("p0"), p1.alias("p1"), argmax2(F.col("y0"), F.col("y1")).alias("pred"))


def relu(c: Column) -> Column:
    return F.greatest(F.lit(0.0), c)


def softmax2(y0: Column, y1: Column) -> tuple[Column, Column]:
    m = F.greatest(y0, y1)
    e0, e1 = F.exp(y0 - m), F.exp(y1 - m)
    return e0 / (e0 + e1), e1 / (e0 + e1)


def argmax2(y0: Column, y1: Column) -> Column:
    """Index of the larger logit; ties go to index 0."""
    return F.when(y0 >= y1, F.lit(0)).otherwise(F.lit(1))
