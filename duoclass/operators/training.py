"""Data-parallel training of the batch-normalised network.

One optimisation step over a batch that may span any number of partitions:

* L moment passes (layer l needs layers < l): mergeable (n, mean, M2) per unit.
* L backward passes, top layer first.  Every gradient term is a plain sum over
  rows, so per-partition partial sums add up to the exact batch gradient:

      du   = dA * dropout_mask * [u > 0]              (per row)
      S1   = sum(du),  S2 = sum(du * zhat)            (-> d beta, d scale)
      dW   = (g / s) * [ a^T du - (1/N) (a^T 1) S1^T - (1/N) (a^T zhat) * S2 ]
      dz   = (g / s) * (du - S1 / N - zhat * S2 / N)  (per row, for the layer below)

  The hidden bias cancels with the batch mean, so its gradient is zero.

Each pass is ``mapInPandas`` (NumPy on Arrow batches, one output per partition) whose
partial sums travel as blocks of matrix rows, one binary row per (matrix, block), and are
added block by block in a tree of bounded fan-in.  Gradient, parameters and Adam's state are
tables of blocks (``optimizer``); the driver reads the parameters back for the next pass.

Training takes few, large batches: an epoch's batches are written once to the shared
folder, one directory each, and a step reads its own.
"""

from __future__ import annotations

import math
import time

import numpy as np
import pandas as pd
from pyspark import StorageLevel, TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoclass.operators import metrics as M
from duoclass.operators.kernels import Inputs, forward, log_softmax, slices, softmax
from duoclass.operators.model import Model
from duoclass.operators.optimizer import BLOCK_ROWS, BLOCK_SCHEMA, adam_step, state_of, with_values
from duoclass.operators.ordering import minibatches, ordered_index, shuffled_index
from duoclass.operators.scoring import _check_model_size, dense_input, layer_moments, score, sparse_input
from duoclass.session import release, remove_path, scratch_path, share, ship_package, written

ROWS_PER_STEP_TASK = 50_000
FAN_IN = 16  # partial sums of one block that meet in a task

SUMS = T.StructType([T.StructField("key", T.StringType()), T.StructField("block", T.IntegerType()),
                     T.StructField("part", T.IntegerType()), T.StructField("height", T.IntegerType()),
                     T.StructField("width", T.IntegerType()), T.StructField("rows", T.BinaryType()),
                     T.StructField("data", T.BinaryType())])


def _block_rows(acc: dict, part: int = 0) -> pd.DataFrame:
    """{name: matrix} as rows of (name, block, part, height, width, rows, float64 bytes).

    Only the matrix rows that aren't all zero travel (``rows`` says which), and no block
    without one, but for the first of each name.
    """
    out = []
    for key, a in acc.items():
        a = np.atleast_2d(np.asarray(a, dtype=np.float64))
        for lo in range(0, a.shape[0], BLOCK_ROWS):
            block = a[lo:lo + BLOCK_ROWS]
            rows = np.flatnonzero(block.any(axis=1))
            if len(rows) or lo == 0:
                out.append((key, lo // BLOCK_ROWS, part, block.shape[0], a.shape[1], rows.astype(np.uint8).tobytes(),
                            np.ascontiguousarray(block[rows]).tobytes()))
    return pd.DataFrame(out, columns=SUMS.names)


def _block_of(height: int, width: int, rows: bytes, data: bytes) -> np.ndarray:
    block = np.zeros((height, width))
    block[np.frombuffer(rows, np.uint8)] = np.frombuffer(data).reshape(-1, width)
    return block


def _add_blocks(it):
    """Add the blocks of one (name, block, part) that met in this task."""
    acc: dict = {}
    for pdf in it:
        for key, block, part, height, width, rows, data in pdf.itertuples(index=False):
            a = _block_of(height, width, rows, data)
            k = (key, block, part)
            acc[k] = acc[k] + a if k in acc else a
    out = []
    for (key, block, part), a in acc.items():
        rows = np.flatnonzero(a.any(axis=1))
        out.append((key, block, part, *a.shape, rows.astype(np.uint8).tobytes(), np.ascontiguousarray(a[rows]).tobytes()))
    if out:
        yield pd.DataFrame(out, columns=SUMS.names)


def tree_levels(parts: int) -> list[int]:
    """Parts left after each level of the reduction: each part adds up at most FAN_IN."""
    out = []
    while parts > 1:
        parts = math.ceil(parts / FAN_IN)
        out.append(parts)
    return out or [1]


def _sum_blocks(df: DataFrame, batch_fn, shared=None, model: Model | None = None) -> DataFrame:
    """Run ``batch_fn(pdf, shared_value) -> {key: array}`` on every Arrow batch (in slices,
    where a ``model`` gives the width of its rows), add the results inside each partition, then block by block in a tree over the partitions; the total's
    blocks as a table, one row each."""
    width = (model.n_inputs, model.n_units, model.n_cells) if model else (0, 0)

    def fn(it):
        val = shared.value if shared is not None else None
        acc: dict = {}
        for pdf in it:
            if len(pdf) == 0:
                continue
            for part in slices(pdf, *width):
                for k, v in batch_fn(part, val).items():
                    if k in acc:
                        acc[k] += v
                    else:
                        acc[k] = np.array(v, dtype=np.float64)
        if acc:
            yield _block_rows(acc, TaskContext.get().partitionId())

    ship_package(df.sparkSession)
    sums = df.mapInPandas(fn, SUMS)
    for parts in tree_levels(df.rdd.getNumPartitions()):
        sums = sums.withColumn("part", (F.col("part") % parts).cast("int")).repartition("key", "block", "part").mapInPandas(_add_blocks, SUMS)
    return sums


def _collected(sums: DataFrame) -> dict[str, np.ndarray]:
    """Small totals (one number a unit) as arrays."""
    parts: dict = {}
    for r in sums.collect():
        parts.setdefault(r["key"], {})[r["block"]] = _block_of(r["height"], r["width"], bytes(r["rows"]), bytes(r["data"]))
    return {k: np.concatenate([p[b] for b in sorted(p)]) for k, p in parts.items()}


def _gradient_rows(sums: DataFrame, layer: int, n: int, scale=None, sd=None, s1=None, s2=None) -> DataFrame:
    """Gradient blocks of one pass: the sums of a block meet and give the gradient of its weights."""
    names = {"W_out": (layer + 1, "W"), "b_out": (layer + 1, "b"), "S1": (layer, "beta"), "S2": (layer, "scale")}

    def fn(it):
        got: dict = {}
        for pdf in it:
            for key, block, _, height, width, rows, data in pdf.itertuples(index=False):
                got.setdefault(block, {})[key] = _block_of(height, width, rows, data)
        out = []
        for block, p in got.items():
            for key, a in p.items():
                if key in names:
                    out.append((*names[key], block, a.shape[1], a.ravel()))
                if key == "S1":
                    out.append((layer, "b", block, a.shape[1], np.zeros(a.size)))
            if p.keys() & {"A", "c", "E"}:
                a, c, e = (p.get(x, 0.0) for x in ("A", "c", "E"))   # absent: all zero
                w = (scale / sd)[None, :] * (a - c * s1[None, :] / n - e * s2[None, :] / n)
                out.append((layer, "W", block, w.shape[1], w.ravel()))
        if out:
            yield pd.DataFrame(out, columns=["layer", "name", "block", "width", "value"])

    return sums.filter(~F.col("key").isin("loss", "hits")).repartition("block").mapInPandas(fn, BLOCK_SCHEMA)


def _targets(labels: np.ndarray) -> np.ndarray:
    l = labels.astype(np.float64)
    return np.column_stack([l, 1.0 - l])


class StepContext:
    """Per-step settings a task needs besides the (broadcast) parameters."""

    def __init__(self, d: int, keep_prob: float, seed: int, step: int, row_id: str,
                 label: str, input_dropout: bool):
        self.d, self.keep, self.seed, self.step = d, keep_prob, seed, step
        self.row_id, self.label, self.input_dropout = row_id, label, input_dropout

    def inputs(self, pdf):
        if "_x" in pdf.columns:
            return Inputs.from_dense(pdf["_x"], self.d)
        return Inputs.from_sparse(pdf["_xi"], pdf["_xv"], self.d)

    def dropout(self, pdf):
        if self.keep >= 1.0:
            return None
        return {"seed": self.seed, "step": self.step, "keep": self.keep,
                "row_ids": pdf[self.row_id].values.astype(np.int64), "input": self.input_dropout}


def gradient_blocks(df: DataFrame, model: Model, keep_prob: float = 1.0, seed: int = 0, step: int = 0,
                    row_id: str = "row_id", label: str = "label", features: str = "features",
                    sparse: bool = False, input_dropout: bool = True) -> tuple[DataFrame, dict]:
    """Exact gradient of the mean cross-entropy over all rows of ``df`` (one batch).

    Returns ``(grads, stats)``: the gradient as a written table of blocks (of a sparse input
    only the blocks that a row touches) and the batch's row count, loss and accuracy.  What
    reaches the driver is one number a unit.
    """
    _check_model_size(model)
    prepared = sparse_input(df, features) if sparse else dense_input(df, features)
    cols = [row_id, label] + (["_xi", "_xv"] if sparse else ["_x"])
    src = prepared.select(*cols)
    ctx = StepContext(model.n_inputs, keep_prob, seed, step, row_id, label, input_dropout)
    L = len(model.hidden)

    # ---- moment passes: one job per hidden layer, merged per unit inside Spark
    moments: list = []
    N = None
    drop = None if keep_prob >= 1.0 else {"seed": seed, "step": step, "keep": keep_prob,
                                           "input": input_dropout}
    handles: list = []
    for l in range(1, L + 1):
        known = {((), i + 1): m for i, m in enumerate(moments)}
        rows = layer_moments(src, model, l, known, [], dropout=drop, row_id=row_id, handles=handles).collect()
        by_unit = {r["unit"]: r for r in rows}
        units = model.hidden[l - 1].units
        mu = np.array([by_unit[u]["mean"] for u in range(units)])
        var = np.array([by_unit[u]["var"] for u in range(units)])
        moments.append((mu, np.sqrt(var + model.eps)))
        N = int(by_unit[0]["n"])
    if N is None:
        N = src.count()

    grads: list = []
    held: list = []
    S: dict = {}
    stats: dict = {}
    shared = share(df, (model, moments), handles)
    for k in range(L, 0, -1):
        def bwd_fn(pdf, val, k=k, S=dict(S)):
            model, moments = val
            x = ctx.inputs(pdf)
            c = forward(x, model, moments, dropout=ctx.dropout(pdf))
            Tg = _targets(pdf[label].values)
            y = c["y"]
            p = softmax(y)
            dy = (p - Tg) / N
            out = {}
            if k == L:
                aL = c["a"][-1] if L else None
                out["W_out"] = aL.T @ dy
                out["b_out"] = dy.sum(axis=0)[None, :]
                lp = log_softmax(y)
                out["loss"] = np.array([[-(Tg * lp).sum()]])
                out["hits"] = np.array([[float((np.argmax(y, 1) == np.argmax(Tg, 1)).sum())]])
            dA = dy @ model.W_out.T
            for l in range(L, k - 1, -1):
                layer = model.hidden[l - 1]
                mask = c["mask"][l - 1] if c["mask"] else 1.0
                du = dA * mask * (c["u"][l - 1] > 0)
                zh = c["zh"][l - 1]
                if l == k:
                    prev = c["a"][l - 2] if l >= 2 else None
                    out["S1"] = du.sum(axis=0)[None, :]
                    out["S2"] = (du * zh).sum(axis=0)[None, :]
                    if prev is None:
                        xin = c["x"]
                        out["A"] = xin.t_matmul(du)
                        out["c"] = xin.t_matmul(np.ones((x.n, 1)))
                        out["E"] = xin.t_matmul(zh)
                    else:
                        out["A"] = prev.T @ du
                        out["c"] = prev.sum(axis=0)[:, None]
                        out["E"] = prev.T @ zh
                    break
                s1, s2 = S[l]
                g, sd = layer.scale, moments[l - 1][1]
                dz = (g / sd) * (du - s1 / N - zh * s2 / N)
                dA = dz @ layer.W.T
            return out

        sums = _sum_blocks(src, bwd_fn, shared, model).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(sums)
        r = _collected(sums.filter(F.col("key").isin("S1", "S2", "loss", "hits")))
        if k == L:
            stats = {"n": N, "loss": float(r["loss"][0, 0]) / N, "accuracy": float(r["hits"][0, 0]) / N}
        s1, s2 = r["S1"][0], r["S2"][0]
        S[k] = (s1, s2)
        grads.append(_gradient_rows(sums, k, N, model.hidden[k - 1].scale, moments[k - 1][1], s1, s2))
    if L == 0:  # linear model: one pass
        def lin_fn(pdf, val):
            model = val[0]
            x = ctx.inputs(pdf)
            y = x.matmul(model.W_out) + model.b_out
            Tg = _targets(pdf[label].values)
            dy = (softmax(y) - Tg) / N
            return {"W_out": x.t_matmul(dy), "b_out": dy.sum(axis=0)[None, :],
                    "loss": np.array([[-(Tg * log_softmax(y)).sum()]])}
        sums = _sum_blocks(src, lin_fn, shared, model).persist(StorageLevel.MEMORY_AND_DISK)
        held.append(sums)
        stats = {"n": N, "loss": float(_collected(sums.filter(F.col("key") == "loss"))["loss"][0, 0]) / N}
        grads.append(_gradient_rows(sums, 0, N))
    whole = grads[0]
    for g in grads[1:]:
        whole = whole.unionByName(g)
    whole = written(whole, "gradient")
    for sums in held:
        sums.unpersist()
    release(handles)
    return whole, stats


def batch_gradient(df: DataFrame, model: Model, *args, **kwargs) -> tuple[dict, dict]:
    """:func:`gradient_blocks` with the gradient as arrays keyed like ``Model.arrays()``."""
    blocks, stats = gradient_blocks(df, model, *args, **kwargs)
    grads = {k: np.zeros_like(a) for k, a in model.arrays().items()}
    for r in blocks.collect():
        part = np.array(r["value"]).reshape(-1, r["width"])
        if r["name"] == "W":
            grads[r["layer"], "W"][r["block"] * BLOCK_ROWS:][:len(part)] = part
        else:
            grads[r["layer"], r["name"]] = part[0]
    remove_path(df.sparkSession, blocks.written_path)
    return grads, stats


def check_width(df: DataFrame, model: Model, features: str = "features", sparse: bool = False,
                on_mismatch: str = "raise") -> int:
    """Compare the data's feature width with the model's input width.

    Dense: ``max(size(features))``; sparse: ``max(index) + 1``.  One aggregate.
    ``on_mismatch='warn'`` only prints (the behaviour being mirrored printed an
    error and went on); the default refuses to continue.
    """
    if sparse:
        w = df.select(F.max(F.array_max(F.transform(features, lambda f: f["i"]))) + 1).first()[0]
        bad = w is not None and w > model.n_inputs
    else:
        w = df.select(F.max(F.size(features))).first()[0]
        bad = w is not None and w != model.n_inputs
    if bad:
        msg = f"feature width {w} does not match the model's {model.n_inputs}"
        if on_mismatch == "raise":
            raise ValueError(msg)
        print("error: " + msg)
    return int(w or 0)


def staircase_lr(lr0: float, rate: float, decay_steps: int, step: int) -> float:
    """lr0 * rate ** floor(step / decay_steps)."""
    return lr0 * rate ** math.floor(step / decay_steps)


def evaluate_rows(df: DataFrame, model: Model, split_col: str = "split", label: str = "label",
                  features: str = "features", sparse: bool = False) -> list:
    """:func:`evaluate`, collected (metric rows only)."""
    return evaluate(df, model, split_col, label, features, sparse).collect()


def _scored(df, model, split_col, label, features, sparse):
    # read once: the metrics come from a single grouped pass over the scores
    return score(df, model, features, sparse, group_cols=[split_col], keep=[label, split_col])


def evaluate(df: DataFrame, model: Model, split_col: str = "split", label: str = "label",
             features: str = "features", sparse: bool = False) -> DataFrame:
    """Per split: accuracy, mean cross-entropy and exact ROC AUC (batch-norm moments
    of each split, as when a whole split is fed at once)."""
    return _metrics_of(_scored(df, model, split_col, label, features, sparse), split_col, label)


def _metrics_of(s: DataFrame, split_col: str, label: str) -> DataFrame:
    """Long (split, metric, value) rows; the graph-AUC confusion counts ride along
    as metrics ``tp fp tn fn`` so a training loop can keep them as running counters."""
    rep = M.score_report(s, label, group_cols=[split_col], graph_counts=True)
    pairs = [("accuracy", "accuracy"), ("cross_entropy", "cross_entropy"), ("roc_auc", "roc_auc"),
             ("graph_tp", "tp"), ("graph_fp", "fp"), ("graph_tn", "tn"), ("graph_fn", "fn")]
    args = [F.lit(len(pairs))]
    for m, c in pairs:
        args += [F.lit(m), F.col(c).cast("double")]
    return rep.select(split_col, F.stack(*args).alias("metric", "value"))


def report(metrics: DataFrame) -> DataFrame:
    """One row an epoch of a metrics table (run, epoch, split, metric, value), with a column
    ``<split>_<metric>`` for each pair that it holds."""
    pairs = metrics.withColumn("pair", F.concat_ws("_", "split", "metric"))
    return pairs.groupBy("run", "epoch").pivot("pair").agg(F.first("value"))


def train(spark: SparkSession, data: DataFrame, model: Model, epochs: int, n_batches: int = 4,
          lr0: float = 0.05, decay_rate: float = 0.95, decay_steps: int = 5000, keep_prob: float = 0.5,
          seed: int = 0, eval_every: int = 10, row_id: str = "row_id", label: str = "label",
          features: str = "features", sparse: bool = False, short_batches: bool = True,
          shuffle: bool = True, input_dropout: bool = True, params_root: str | None = None,
          metrics_root: str | None = None, model_name: str = "mlp", run: str = "run0",
          warm_start: bool = False) -> tuple[Model, DataFrame]:
    """Epochs of ``n_batches`` large batches of Adam with a stair-case learning rate.

    ``data`` has ``split`` ('train'/'test'), ``row_id`` (unique), ``label`` (0/1) and
    the features.  It is written once to the shared folder.  Each epoch re-shuffles the
    train rows with a seed of its own (``seed:epoch``), cuts them into batches
    (``short_batches`` drops the last position of each, as the slicing being mirrored
    did) and writes them, a directory per batch; a step is a distributed gradient over
    its directory.  Every ``eval_every`` epochs both splits are scored and metrics
    appended to ``metrics_root``; the parameters are saved (version = epoch) under
    ``params_root``.  ``warm_start`` restores them instead of taking ``model``.
    """
    from duoclass.sources.params_store import load_model, save_state
    if warm_start:
        if not params_root:
            raise ValueError("warm_start needs params_root")
        model = load_model(spark, params_root, model_name)
    data = written(data, "training")
    check_width(data, model, features, sparse)
    train_rows = data.filter(F.col("split") == "train")
    n_train = train_rows.count()
    batch_size = n_train // n_batches
    if batch_size < 2:
        raise ValueError("fewer training rows than two a batch")
    tasks = max(1, math.ceil(batch_size / ROWS_PER_STEP_TASK))
    records = []
    counters: dict = {}
    state = written(state_of(spark, model), "state")
    for epoch in range(epochs):
        index = shuffled_index if shuffle else ordered_index
        order = (f"{seed}:{epoch}",) if shuffle else ()
        ix = index(train_rows, row_id, *order, name="ix", n_rows=n_train)
        path = scratch_path(spark, "training", f"{run}-{time.time_ns()}")
        (minibatches(ix, batch_size, short=short_batches, n_rows=n_train)
         .repartition("batch", F.pmod(F.xxhash64(row_id), F.lit(tasks))).write.partitionBy("batch").parquet(path))
        table = spark.read.parquet(path)
        t0 = time.time()
        losses = []
        for j in range(n_batches):
            lr = staircase_lr(lr0, decay_rate, decay_steps, model.global_step)
            g, st = gradient_blocks(table.filter(F.col("batch") == F.lit(j)), model, keep_prob, seed,
                                    model.global_step, row_id, label, features, sparse, input_dropout)
            after = written(adam_step(state, g, lr, model.global_step + 1), "state")
            remove_path(spark, g.written_path)
            remove_path(spark, state.written_path)
            state = after
            model = with_values(model, state)
            model.global_step += 1
            losses.append(st["loss"])
        remove_path(spark, path)
        records.append((run, epoch, "train_batches", "mean_batch_loss", float(np.mean(losses))))
        records.append((run, epoch, "train_batches", "seconds", time.time() - t0))
        records.append((run, epoch, "train_batches", "learning_rate",
                        staircase_lr(lr0, decay_rate, decay_steps, model.global_step)))
        if params_root:
            save_state(spark, state, model, params_root, model_name, epoch)
        if eval_every and (epoch % eval_every == 0 or epoch == epochs - 1):
            ev = evaluate_rows(data, model, "split", label, features, sparse)
            records.extend((run, epoch, r["split"], r["metric"], float(r["value"])) for r in ev)
            # counters initialised once and never reset: each evaluation adds to them
            for r in ev:
                if r["metric"].startswith("graph_"):
                    key = (r["split"], r["metric"][6:])
                    counters[key] = counters.get(key, 0.0) + float(r["value"])
            for sp in sorted({k[0] for k in counters}):
                c = {k[1]: v for k, v in counters.items() if k[0] == sp}
                records.append((run, epoch, sp, "auc_graph_cumulative",
                                M.hard_auc_value(c["tp"], c["fp"], c["tn"], c["fn"])))
    with_values(model, state, slots=True)
    remove_path(spark, state.written_path)
    remove_path(spark, data.written_path)
    mdf = spark.createDataFrame(records, "run string, epoch int, split string, metric string, value double")
    if metrics_root:
        mdf.write.mode("append").partitionBy("run").parquet(metrics_root)
        mdf = spark.read.parquet(metrics_root).filter(F.col("run") == run)
    return model, mdf
