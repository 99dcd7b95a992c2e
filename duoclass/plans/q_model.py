"""Model queries: parameter save/restore, scoring a saved model, gradients,
training runs, the forest, and the define -> train -> test sequence."""

from __future__ import annotations

import math
import uuid

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from duoclass.functions.columns import r6
from duoclass.operators import metrics as M
from duoclass.operators.encode import labels_for_model
from duoclass.operators.forest import forest_score as rf_score
from duoclass.operators.forest import (forest_descend, forest_score_nodes, forest_summary, forest_train as rf_train,
                                       load_forest, save_forest)
from duoclass.operators.model import Model, init_cells, init_model, intmod_model, truncated_normal_sql
from duoclass.operators.ordering import split_shuffled_fast
from duoclass.operators.scoring import score
from duoclass.operators.optimizer import adam_step, cells, state_of, with_values
from duoclass.operators.training import evaluate, gradient_blocks, report, train
from duoclass.plans import sqlgen as Q
from duoclass.plans.inputs import EMB_WIDTH, HIDDEN2, SEED, TRAIN_FRAC, embeddings_dense, mlp2
from duoclass.session import scratch_path, written
from duoclass.sources.params_store import (commit_version, load_model, load_params_frame, params_frame, read_pointer, save_params,
                                            save_table, stage_table)


WIDE = [574, 750, 350]


def _root(spark, what):
    return scratch_path(spark, what, uuid.uuid4().hex[:12])


def _emb_split(spark, sf):
    return split_shuffled_fast(embeddings_dense(spark, sf), "vec_id", SEED, TRAIN_FRAC)


def save_params_q(spark, sf):
    """Define step: feature width from the data, seeded init as a table, saved as version 0."""
    emb = embeddings_dense(spark, sf)
    d = emb.agg(F.max(F.size("features")).alias("d")).first()["d"]
    root = _root(spark, "params")
    save_table(init_cells(spark, int(d), HIDDEN2, seed=SEED), root, "mlp", 0)
    return load_params_frame(spark, root, "mlp").select("layer", "name", "i", "j", (F.round("value", 9) + F.lit(0.0)).alias("value"))


def centroid_model(emb):
    """A linear model learned in one aggregate: per feature, the mean over label 1 less the
    mean over label 0, and its negative for the other class."""
    cells = emb.select("label", F.posexplode("features").alias("i", "v"))
    mean = lambda l: F.avg(F.when(F.col("label") == l, F.col("v").cast("double")))
    rows = cells.groupBy("i").agg((mean(1) - mean(0)).alias("w")).orderBy("i").collect()  # one row a feature
    w = np.array([r["w"] for r in rows])
    return Model([], np.column_stack([w, -w]), np.zeros(2))


def export_tagged(spark, sf):
    """Two models saved under their tags, as an export for serving and one for training on;
    each is read by its tag, and a tag that a model wasn't saved under reads nothing."""
    emb = embeddings_dense(spark, sf)
    root = _root(spark, "params")
    save_params(spark, centroid_model(emb), root, "serve", 0, tag="serve")
    save_params(spark, centroid_model(emb.filter(F.col("vec_id") % 2 == 0)), root, "train", 0, tag="train")
    parts = [load_params_frame(spark, root, t, tag=t) for t in ("serve", "train")]
    wrong = load_params_frame(spark, root, "serve", tag="train")
    return (parts[0].unionByName(parts[1]).unionByName(wrong).filter(F.col("name") == "W")
            .groupBy("tag").agg(F.count("*").alias("cells"), r6(F.sum(F.abs("value"))).alias("size")))


def param_histogram(spark, sf):
    """Weight histogram of a saved model: twelve bins over its matrix."""
    root = _root(spark, "params")
    save_params(spark, centroid_model(embeddings_dense(spark, sf)), root, "linear", 0)
    w = load_params_frame(spark, root, "linear").filter(F.col("name") == "W")
    h = M.histogram(w, "value", 12, lo=-0.03, hi=0.03)
    return h.select("bin", r6("lo_edge").alias("lo_edge"), r6("hi_edge").alias("hi_edge"), "count")


def width_report(spark, sf):
    """Feature width of the table against a saved model's input width."""
    emb = embeddings_dense(spark, sf)
    root = _root(spark, "params")
    save_params(spark, mlp2(), root, "mlp", 0)
    model = load_model(spark, root, "mlp")
    s = F.size("features")
    return emb.agg(F.count("*").alias("n_rows"), F.min(s).alias("min_width"), F.max(s).alias("max_width"),
                   F.sum((s != model.n_inputs).cast("int")).cast("long").alias("n_misfit")).withColumn(
        "model_width", F.lit(model.n_inputs))


def model_targets(spark, sf):
    """Targets shaped for the model: the one-hot pair for a two-column output, the class
    itself for a forest."""
    emb = embeddings_dense(spark, sf).select("vec_id", "label")
    net, forest = labels_for_model(F.col("label"), mlp2().n_outputs), labels_for_model(F.col("label"), 1)
    return emb.select("vec_id", net[0].alias("y0"), net[1].alias("y1"), forest.alias("cls"))


def load_params_q(spark, sf):
    """Two saved versions (seeded init, then the integer-derived weights); the latest
    is restored by partition pruning on ``version``."""
    emb = embeddings_dense(spark, sf)
    d = int(emb.agg(F.max(F.size("features")).alias("d")).first()["d"])
    root = _root(spark, "params")
    save_params(spark, init_model(d, HIDDEN2, seed=SEED), root, "mlp", 0)
    save_params(spark, intmod_model(d, HIDDEN2), root, "mlp", 1)
    return (load_params_frame(spark, root, "mlp").filter(~F.col("name").isin("global_step", "eps"))
            .select("layer", "name", "i", "j", "value"))


def score_saved_model(spark, sf):
    root = _root(spark, "params")
    save_params(spark, mlp2(), root, "mlp", 0, tag="tag")
    model = load_model(spark, root, "mlp")
    test = _emb_split(spark, sf).filter(F.col("split") == "test")
    s = score(test, model, keep=["vec_id", "label"])
    return (M.score_report(s)
             .select("n_rows", r6("accuracy").alias("accuracy"), r6("roc_auc").alias("roc_auc"),
                     r6("cross_entropy").alias("cross_entropy")))


def batch_gradient(spark, sf):
    """Gradient of the mean cross-entropy over the whole table as one batch."""
    emb = embeddings_dense(spark, sf).withColumnRenamed("vec_id", "row_id")
    g, _ = gradient_blocks(emb, mlp2(), keep_prob=1.0)
    return cells(g, out="grad").select("layer", "name", "i", "j", (F.round(F.col("grad"), 9) + F.lit(0.0)).alias("grad"))


def adam_step_q(spark, sf):
    """Parameters and moments after one and after two Adam steps, each over the whole table."""
    emb = embeddings_dense(spark, sf).withColumnRenamed("vec_id", "row_id")
    model = mlp2()
    state = state_of(spark, model)
    out = None
    for step in (1, 2):
        grads, _ = gradient_blocks(emb, with_values(model, state), keep_prob=1.0)
        state = written(adam_step(state, grads, 0.01, step), "state")
        value, m, v = (cells(state, c, c) for c in ("value", "m", "v"))
        at = ["layer", "name", "i", "j"]
        rows = value.join(m, at).join(v, at).select(F.lit(step).alias("step"), *at, *[r6(c).alias(c) for c in ("value", "m", "v")])
        out = rows if out is None else out.unionByName(rows)
    return out


def epoch_report(spark, sf):
    """Two epochs of training, each one whole batch of the train split at a decaying rate; the
    report is a pivot over the metrics table that training appends to."""
    data = _emb_split(spark, sf).withColumnRenamed("vec_id", "row_id")
    _, metrics = train(spark, data, mlp2(), epochs=2, n_batches=1, lr0=0.02, decay_rate=0.5, decay_steps=1, keep_prob=1.0,
                       seed=SEED, eval_every=1, short_batches=False, params_root=_root(spark, "params"),
                       metrics_root=_root(spark, "metrics"))
    rep = report(metrics)
    return rep.select("epoch", *[r6(f"{sp}_{m}").alias(f"{sp}_{m}") for m in ("accuracy", "cross_entropy", "roc_auc") for sp in ("train", "test")],
                      r6("train_batches_mean_batch_loss").alias("batch_loss"))


def batch_gradient_wide(spark, sf):
    """The same at the scripts' shape, 574 -> 750 -> 350 -> 2: the table's features
    repeated in scaled copies.  One row per parameter array: cells, sum, sum of sizes."""
    copies = F.transform(F.sequence(F.lit(0), F.lit(WIDE[0] - 1)), lambda i: F.get("features", (i % EMB_WIDTH).cast("int")).cast("double")
                         * (i % 9 + F.lit(1)).cast("double"))
    emb = embeddings_dense(spark, sf).select(F.col("vec_id").alias("row_id"), "label", copies.alias("features"))
    g, _ = gradient_blocks(emb, intmod_model(WIDE[0], WIDE[1:]), keep_prob=1.0)
    total = lambda f: F.sum(F.aggregate(F.transform("value", f), F.lit(0.0), lambda a, x: a + x))
    return g.groupBy("layer", "name").agg(F.sum(F.size("value")).alias("cells"), r6(total(lambda x: x)).alias("total"), r6(total(F.abs)).alias("size"))


def metrics_log(spark, sf):
    """Evaluate the saved model on both splits and append the rows to a metrics table."""
    root = _root(spark, "metrics")
    ev = evaluate(_emb_split(spark, sf), mlp2()).withColumn("epoch", F.lit(0)).withColumn("run", F.lit("r0"))
    ev.write.mode("append").partitionBy("run").parquet(root)
    return spark.read.parquet(root).select("run", "epoch", "split", "metric", r6("value").alias("value"))


def train_mlp(spark, sf, epochs=3, n_batches=3):
    """Epochs of large distributed batches; one row per logged metric with what must hold
    of it (bounds, the decayed rate, and counts that add up to the split)."""
    data = _emb_split(spark, sf).withColumnRenamed("vec_id", "row_id")
    model = init_model(EMB_WIDTH, [16], seed=SEED)
    _, metrics = train(spark, data, model, epochs=epochs, n_batches=n_batches, lr0=0.01, decay_rate=0.5,
                       decay_steps=n_batches, keep_prob=0.5, seed=SEED, eval_every=2, run="r0",
                       params_root=_root(spark, "params"), metrics_root=_root(spark, "metrics"))
    v, m = F.col("value"), F.col("metric")
    ok = (F.when(m == "learning_rate", F.abs(v - 0.01 * F.pow(F.lit(0.5), F.col("epoch") + 1)) < 1e-12)
          .when(m.isin("cross_entropy", "mean_batch_loss"), (v > 0) & (v < 5))
          .when(m.startswith("graph_"), (v >= 0) & (v == F.floor(v)))
          .otherwise((v >= 0) & (v <= 1)))
    counts = F.sum(F.when(m.startswith("graph_"), v)).over(Window.partitionBy("epoch", "split")).cast("long")
    return metrics.filter(m != "seconds").select("run", "epoch", "split", "metric", ok.alias("ok"), counts.alias("split_rows"))


def warm_start(spark, sf):
    """Train an epoch of one whole batch, save, restore into a fresh run and train another:
    the parameters and moments that two steps from the first weights give."""
    data = _emb_split(spark, sf).withColumnRenamed("vec_id", "row_id")
    root = _root(spark, "params")
    run = dict(epochs=1, n_batches=1, lr0=0.01, keep_prob=1.0, seed=SEED, eval_every=0, short_batches=False, params_root=root)
    train(spark, data, mlp2(), **run)
    train(spark, data, init_model(EMB_WIDTH, HIDDEN2, seed=SEED + 1), warm_start=True, **run)
    saved = load_params_frame(spark, root, "mlp").filter(F.col("name") != "eps")
    return saved.select("layer", "name", "i", "j", r6("value").alias("value"))


def forest_train(spark, sf):
    """One row per tree: within the node and depth limits, and more than a stump."""
    train_rows = _emb_split(spark, sf).filter(F.col("split") == "train")
    model = rf_train(train_rows, seed=SEED)
    s = spark.createDataFrame(forest_summary(model), "tree int, nodes int, depth int")
    return s.select("tree", F.col("nodes").between(3, 1000).alias("nodes_ok"), F.col("depth").between(1, 9).alias("depth_ok"))


def forest_score(spark, sf):
    """Held-out rows scored from the forest's stored node table, restored, beside Spark ML's
    own scores of the same forest."""
    data = _emb_split(spark, sf)
    test = data.filter(F.col("split") == "test")
    model = rf_train(data.filter(F.col("split") == "train"), seed=SEED)
    root = _root(spark, "params")
    save_forest(spark, model, root, "forest", 0)
    own = forest_score_nodes(load_forest(spark, root, "forest"), test, "vec_id").select("vec_id", F.col("pred").alias("own_pred"), F.col("p1").alias("own_p1"))
    s = rf_score(model, test, keep=["vec_id", "label"]).join(own, "vec_id")
    return s.select("vec_id", "label", (F.abs(F.col("own_p1") - F.col("p1")) < 1e-9).alias("p1_equal"),
                    (F.col("own_pred") == F.col("pred")).alias("pred_equal"))


def forest_nodes_q(spark, sf, trees=5):
    """Node tables of forests grown on every training row (none drawn): per tree, the rows of
    each class at its root, summed over its leaves, and counted by sending every training row
    down the stored tree."""
    train_rows = _emb_split(spark, sf).filter(F.col("split") == "train")
    root = _root(spark, "params")
    grown = rf_train(train_rows, seed=SEED, numTrees=trees, bootstrap=False, featureSubsetStrategy="sqrt")
    save_forest(spark, grown, root, "whole", 0)
    nodes = load_forest(spark, root, "whole")
    by_class = lambda at, pre: [F.sum(F.get("counts", F.lit(k))).cast("long").alias(f"{pre}{k}") for k in (0, 1)]
    roots = nodes.where("node = 0").groupBy("tree").agg(*by_class(0, "root"))
    leaves = nodes.where("feature IS NULL").groupBy("tree").agg(*by_class(0, "leaf"), F.count("*").alias("n_leaves"))
    sent = forest_descend(nodes, train_rows, "vec_id").join(train_rows.select("vec_id", "label"), "vec_id")
    reached = sent.groupBy("tree", "node").agg(*[F.sum((F.col("label") == k).cast("double")).alias(f"c{k}") for k in (0, 1)])
    same = (nodes.where("feature IS NULL").join(reached, ["tree", "node"], "left")
            .groupBy("tree").agg(F.sum((F.array("c0", "c1") == F.col("counts")).cast("int")).alias("n_same"),
                                 F.sum("c0").cast("long").alias("sent0"), F.sum("c1").cast("long").alias("sent1")))
    return (roots.join(leaves, "tree").join(same, "tree")
            .select("tree", "root0", "root1", "leaf0", "leaf1", "sent0", "sent1", (F.col("n_same") == F.col("n_leaves")).alias("leaves_hold_their_rows")))


def checkpoint_versions(spark, sf):
    """What a reader sees of a model after each save: version 0 committed; version 1 written
    but not committed; version 1 committed; version 0 saved again from other rows; and what
    the pointer file says then."""
    emb = embeddings_dense(spark, sf)
    root = _root(spark, "params")
    seen = []

    def look(step):
        w = load_params_frame(spark, root, "linear").filter(F.col("name") == "W")
        seen.append(w.groupBy("version").agg(F.count("*").alias("cells"), r6(F.sum(F.abs("value"))).alias("size"))
                    .withColumn("step", F.lit(step)))
        named = read_pointer(spark, f"{root}/model=linear/checkpoint")["model_checkpoint_path"][0]
        seen[-1] = written(seen[-1].withColumn("pointer", F.lit(named)), "seen")

    def part(m):
        return params_frame(spark, centroid_model(emb.filter(F.col("vec_id") % m == 0)))

    save_table(part(1), root, "linear", 0)
    look("first")
    run, _ = stage_table(part(2), root, "linear", 1)
    look("half-written")
    commit_version(spark, root, "linear", 1, run)
    look("committed")
    save_table(part(3), root, "linear", 0)
    look("replaced")
    out = seen[0]
    for s in seen[1:]:
        out = out.unionByName(s)
    return out.select("step", "version", "cells", "size", "pointer")


def three_step_train_test(spark, sf, epochs=2):
    """Step 1 defines and saves a model; step 2 restores it, trains and saves the
    trained version; step 3 restores the trained model and scores the held-out rows."""
    root = _root(spark, "params")
    d = int(embeddings_dense(spark, sf).agg(F.max(F.size("features"))).first()[0])
    save_table(init_cells(spark, d, HIDDEN2, seed=SEED), root, "dnn", 0)          # step 1
    data = _emb_split(spark, sf).withColumnRenamed("vec_id", "row_id")
    m = load_model(spark, root, "dnn")                                            # step 2
    m, _ = train(spark, data, m, epochs=epochs, n_batches=1, lr0=0.05, keep_prob=1.0, seed=SEED, eval_every=0, short_batches=False)
    save_params(spark, m, root, "dnn", 1)
    trained = load_model(spark, root, "dnn")                                      # step 3
    test = data.filter(F.col("split") == "test")
    s = score(test, trained, keep=["row_id", "label"])
    return (M.score_report(s)
             .select(F.lit(int(trained.global_step)).alias("global_step"), "n_rows", r6("accuracy").alias("accuracy"),
                     r6("cross_entropy").alias("cross_entropy"), r6("roc_auc").alias("roc_auc")))


QUERIES = {
    "save_params": save_params_q,
    "load_params": load_params_q,
    "score_saved_model": score_saved_model,
    "export_tagged": export_tagged,
    "param_histogram": param_histogram,
    "width_report": width_report,
    "model_targets": model_targets,
    "batch_gradient": batch_gradient,
    "adam_step": adam_step_q,
    "epoch_report": epoch_report,
    "batch_gradient_wide": batch_gradient_wide,
    "warm_start": warm_start,
    "metrics_log": metrics_log,
    "train_mlp": train_mlp,
    "forest_train": forest_train,
    "forest_score": forest_score,
    "forest_nodes": forest_nodes_q,
    "checkpoint_versions": checkpoint_versions,
    "three_step_train_test": three_step_train_test,
}

# ----------------------------------------------------------------- oracles ---


def _param_rows_body() -> str:
    parts = []
    sizes = [EMB_WIDTH] + HIDDEN2
    for l in range(1, len(sizes)):
        parts.append(f"SELECT {l} AS layer, 'W' AS name, a.range AS i, b.range AS j, "
                     f"{Q.intmod_sql(l, 0, 'a.range', 'b.range')} AS value FROM range({sizes[l-1]}) a, range({sizes[l]}) b")
        for code, name in ((1, "b"), (2, "scale"), (3, "beta")):
            v = Q.intmod_sql(l, code, "0", "b.range")
            if name == "scale":
                v = f"CAST(1 AS DOUBLE) + {v}"
            parts.append(f"SELECT {l} AS layer, '{name}' AS name, 0 AS i, b.range AS j, {v} AS value "
                         f"FROM range({sizes[l]}) b")
    L = len(sizes)
    parts.append(f"SELECT {L} AS layer, 'W' AS name, a.range AS i, b.range AS j, "
                 f"{Q.intmod_sql(L, 0, 'a.range', 'b.range')} AS value FROM range({sizes[-1]}) a, range(2) b")
    parts.append(f"SELECT {L} AS layer, 'b' AS name, 0 AS i, b.range AS j, {Q.intmod_sql(L, 1, '0', 'b.range')} "
                 f"AS value FROM range(2) b")
    return "\nUNION ALL ".join(parts)


def _param_rows_sql() -> str:
    return (f"SELECT CAST(layer AS INTEGER) AS layer, name, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, "
            f"value FROM ({_param_rows_body()}) p WHERE (SELECT max(len(embedding)) FROM embeddings) = {EMB_WIDTH}")


_MLP2T = (Q.emb_src("split") + ",\n" + Q.mlp_ctes("src", EMB_WIDTH, HIDDEN2))

def _gradient_ctes(src: str, width: int, hidden: list[int], params: str | None = None, t: str = "") -> str:
    """Relational backward pass over all rows as one batch, ending in ``g(layer, name, i, j, grad)``.

    ``params`` and ``t`` as in ``sqlgen.mlp_ctes``.
    """
    L = len(hidden)
    eps = "CAST(0.001 AS DOUBLE)"
    parts = [Q.mlp_ctes(src, width, hidden, params=params, t=t), f"n{t} AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM labels_src{t})"]
    for l in range(1, L + 1):
        sc = Q.vector_sql(l, "scale", "z.j", params)
        be = Q.vector_sql(l, "beta", "z.j", params)
        parts.append(f"""u{l}{t} AS (SELECT z.id, z.j AS i, (z.z - m.mu) / sqrt(m.var + {eps}) AS zh,
              {sc} * ((z.z - m.mu) / sqrt(m.var + {eps})) + {be} AS u, sqrt(m.var + {eps}) AS sd, {sc} AS g
       FROM z{l}{t} z JOIN m{l}{t} m ON z.j = m.j)""")
    parts.append(f"""dy{t} AS (SELECT s.id, k.j, ((CASE WHEN k.j = 0 THEN s.p0 ELSE s.p1 END)
              - (CASE WHEN k.j = 0 THEN CAST(s.label AS DOUBLE) ELSE CAST(1 - s.label AS DOUBLE) END)) / n.n AS d
       FROM scored{t} s, (SELECT range AS j FROM range(2)) k, n{t} n)""")
    above, w = f"dy{t}", f"wo{t}"
    g = [f"SELECT {L + 1} AS layer, 'W' AS name, h.i AS i, dy.j AS j, sum(h.v * dy.d) AS grad FROM h{L}{t} h JOIN dy{t} dy ON h.id = dy.id GROUP BY h.i, dy.j",
         f"SELECT {L + 1}, 'b', 0, j, sum(d) FROM dy{t} GROUP BY j"]
    for l in range(L, 0, -1):
        parts.append(f"da{l}{t} AS (SELECT a.id, w.i, sum(a.d * w.w) AS da FROM {above} a JOIN {w} w ON a.j = w.j GROUP BY a.id, w.i)")
        parts.append(f"""du{l}{t} AS (SELECT a.id, a.i, CASE WHEN u.u > 0 THEN a.da ELSE CAST(0 AS DOUBLE) END AS du, u.zh, u.sd, u.g
       FROM da{l}{t} a JOIN u{l}{t} u ON a.id = u.id AND a.i = u.i)""")
        parts.append(f"s{l}{t} AS (SELECT i, sum(du) AS s1, sum(du * zh) AS s2 FROM du{l}{t} GROUP BY i)")
        parts.append(f"""dz{l}{t} AS (SELECT d.id, d.i AS j, (d.g / d.sd) * (d.du - s.s1 / n.n - d.zh * s.s2 / n.n) AS d
       FROM du{l}{t} d JOIN s{l}{t} s ON d.i = s.i, n{t} n)""")
        below = f"h{l - 1}{t}" if l > 1 else src
        g += [f"SELECT {l}, 'W', x.i, dz.j, sum(x.v * dz.d) FROM {below} x JOIN dz{l}{t} dz ON x.id = dz.id GROUP BY x.i, dz.j",
              f"SELECT {l}, 'b', 0, i, CAST(0 AS DOUBLE) FROM s{l}{t}", f"SELECT {l}, 'scale', 0, i, s2 FROM s{l}{t}",
              f"SELECT {l}, 'beta', 0, i, s1 FROM s{l}{t}"]
        above, w = f"dz{l}{t}", f"w{l}{t}"
    parts.append(f"g{t} AS (" + "\n  UNION ALL ".join(g) + ")")
    return ",\n".join(parts)


def _adam_ctes(src: str, lrs: list[float], b1: float = 0.9, b2: float = 0.999, first: str | None = None) -> str:
    """Whole-batch Adam steps from the integer-derived weights (or the relation ``first``): ``a0`` to
    ``a<n>`` (layer, name, i, j, value, m, v)."""
    parts = [f"a0 AS MATERIALIZED (SELECT layer, name, i, j, value, CAST(0 AS DOUBLE) AS m, CAST(0 AS DOUBLE) AS v FROM ({first or _param_rows_body()}) p)"]
    for step, lr in enumerate(lrs, start=1):
        t = f"_{step}"
        rate = lr * math.sqrt(1 - b2 ** step) / (1 - b1 ** step)
        parts.append(_gradient_ctes(src, EMB_WIDTH, HIDDEN2, f"a{step - 1}", t))
        parts.append(f"""mv{step} AS (SELECT p.layer, p.name, p.i, p.j, p.value, {b1!r}::DOUBLE * p.m + {1 - b1!r}::DOUBLE * g.grad AS m,
    {b2!r}::DOUBLE * p.v + {1 - b2!r}::DOUBLE * g.grad * g.grad AS v
  FROM a{step - 1} p JOIN g{t} g ON p.layer = g.layer AND p.name = g.name AND p.i = g.i AND p.j = g.j)""")
        parts.append(f"a{step} AS (SELECT layer, name, i, j, value - {rate!r}::DOUBLE * m / (sqrt(v) + 1e-8::DOUBLE) AS value, m, v FROM mv{step})")
    return ",\n".join(parts)


def _adam_sql() -> str:
    cols = ", ".join(f"{Q.r6(c)} AS {c}" for c in ("value", "m", "v"))
    steps = "\nUNION ALL ".join(f"SELECT {k} AS step, CAST(layer AS INTEGER) AS layer, name, CAST(i AS INTEGER) AS i, "
                                f"CAST(j AS INTEGER) AS j, {cols} FROM a{k}" for k in (1, 2))
    return f"WITH {Q.emb_src()},\n{_adam_ctes('src', [0.01, 0.01])}\n{steps}"


def _epoch_report_sql() -> str:
    """Two epochs of one whole batch of the train split, each scored on both splits."""
    ce = "-(CAST(label AS DOUBLE) * logp0 + (CAST(1 AS DOUBLE) - CAST(label AS DOUBLE)) * logp1)"
    hit = "CASE WHEN pred = (CASE WHEN label = 1 THEN 0 ELSE 1 END) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    parts, rows = [], []
    for e in (0, 1):
        t = f"_e{e}"
        parts.append(Q.mlp_ctes("src", EMB_WIDTH, HIDDEN2, params=f"a{e + 1}", t=t))
        parts.append(f"r{e} AS (SELECT g AS split, avg({hit}) AS accuracy, avg({ce}) AS ce FROM scored{t} GROUP BY g)")
        parts.append(f"u{e} AS {Q.auc_sql(f'scored{t}', 'p0', 'label', 'g')}")
        pick = lambda c, sp, e=e: f"(SELECT {Q.r6(c)} FROM r{e} WHERE split = '{sp}')"
        auc = lambda sp, e=e: f"(SELECT {Q.r6('roc_auc')} FROM u{e} WHERE g = '{sp}')"
        rows.append(f"SELECT {e} AS epoch, {pick('accuracy', 'train')} AS train_accuracy, {pick('accuracy', 'test')} AS test_accuracy, "
                    f"{pick('ce', 'train')} AS train_cross_entropy, {pick('ce', 'test')} AS test_cross_entropy, "
                    f"{auc('train')} AS train_roc_auc, {auc('test')} AS test_roc_auc, "
                    f"(SELECT {Q.r6(f'avg({ce})')} FROM scored_{e + 1}) AS batch_loss")
    whole = "batch AS (SELECT id, 'all' AS g, label, i, v FROM src WHERE g = 'train')"
    return (f"WITH {Q.emb_src('split')},\n{whole},\n{_adam_ctes('batch', [0.02, 0.01])},\n" + ",\n".join(parts)
            + "\n" + "\nUNION ALL ".join(rows))


def _init_body(std: float = 0.1) -> str:
    """(layer, name, i, j, value) of every cell that an initialised model must have."""
    sizes = [EMB_WIDTH] + HIDDEN2 + [2]
    L = len(sizes) - 1
    parts = []
    for l in range(1, L + 1):
        parts.append(f"SELECT {l}, 'W', a.range, b.range, {truncated_normal_sql(SEED, l, 'a.range', 'b.range')} * {std!r}::DOUBLE "
                     f"FROM range({sizes[l - 1]}) a, range({sizes[l]}) b")
        vectors = (("b", 0.1),) if l == L else (("b", 0.1), ("scale", 1.0), ("beta", 0.0))
        parts += [f"SELECT {l}, '{n}', 0, b.range, {x!r}::DOUBLE FROM range({sizes[l]}) b" for n, x in vectors]
    parts += ["SELECT 0, 'global_step', 0, 0, 0::DOUBLE", "SELECT 0, 'eps', 0, 0, 0.001::DOUBLE"]
    body = "\nUNION ALL ".join(parts)
    return f"SELECT * FROM ({body}) c(layer, name, i, j, value)"


def _warm_start_sql() -> str:
    parts = ["SELECT layer, name, i, j, value FROM a2", "SELECT layer, 'm:' || name, i, j, m FROM a2", "SELECT layer, 'v:' || name, i, j, v FROM a2",
             "SELECT 0, 'global_step', 0, 0, CAST(2 AS DOUBLE)"]
    whole = "batch AS (SELECT id, 'all' AS g, label, i, v FROM src WHERE g = 'train')"
    return (f"WITH {Q.emb_src('split')},\n{whole},\n{_adam_ctes('batch', [0.01, 0.01])}\n"
            f"SELECT CAST(layer AS INTEGER) AS layer, name, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, {Q.r6('value')} AS value "
            f"FROM ({' UNION ALL '.join(parts)}) p")


def _three_step_sql(epochs: int = 2) -> str:
    ce = "-(CAST(label AS DOUBLE) * logp0 + (CAST(1 AS DOUBLE) - CAST(label AS DOUBLE)) * logp1)"
    hit = "CASE WHEN pred = (CASE WHEN label = 1 THEN 0 ELSE 1 END) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END"
    sides = ("batch AS (SELECT id, 'all' AS g, label, i, v FROM src WHERE g = 'train')",
             "held AS (SELECT id, 'all' AS g, label, i, v FROM src WHERE g = 'test')")
    drawn = f"SELECT * FROM ({_init_body()}) d WHERE layer > 0"
    return (f"WITH {Q.emb_src('split')},\n" + ",\n".join(sides) + f",\n{_adam_ctes('batch', [0.05] * epochs, first=drawn)},\n"
            + Q.mlp_ctes("held", EMB_WIDTH, HIDDEN2, params=f"a{epochs}", t="_h")
            + f"\nSELECT {epochs} AS global_step, count(*) AS n_rows, {Q.r6(f'avg({hit})')} AS accuracy, {Q.r6(f'avg({ce})')} AS cross_entropy, "
              f"(SELECT {Q.r6('roc_auc')} FROM {Q.auc_sql('scored_h', 'p0', 'label')} a) AS roc_auc FROM scored_h")


def _init_sql() -> str:
    return (f"SELECT CAST(layer AS INTEGER) AS layer, name, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j, round(value, 9) + CAST(0 AS DOUBLE) AS value "
            f"FROM ({_init_body()}) p WHERE (SELECT max(len(embedding)) FROM embeddings) = {EMB_WIDTH}")


def _gradient_sql() -> str:
    return f"""WITH {Q.emb_src()},
{_gradient_ctes("src", EMB_WIDTH, HIDDEN2)}
SELECT CAST(layer AS INTEGER) AS layer, name, CAST(i AS INTEGER) AS i, CAST(j AS INTEGER) AS j,
       round(grad, 9) + CAST(0 AS DOUBLE) AS grad FROM g"""


def _gradient_wide_sql() -> str:
    return f"""WITH {Q.EMB_CELLS},
wide AS (SELECT c.id, 'all' AS g, c.label, r.range AS i, c.v * CAST(r.range % 9 + 1 AS DOUBLE) AS v
         FROM emb_cells c JOIN range({WIDE[0]}) r ON r.range % {EMB_WIDTH} = c.i),
{_gradient_ctes("wide", WIDE[0], WIDE[1:])}
SELECT CAST(layer AS INTEGER) AS layer, name, count(*) AS cells, {Q.r6("sum(grad)")} AS total, {Q.r6("sum(abs(grad))")} AS size
FROM g GROUP BY layer, name"""


_CENTROID = f"""{Q.EMB_CELLS},
w AS (SELECT t.tag, c.i, avg(CASE WHEN c.label = 1 THEN c.v END) - avg(CASE WHEN c.label = 0 THEN c.v END) AS w
      FROM emb_cells c JOIN (VALUES ('serve', 1), ('train', 2)) t(tag, m) ON c.id % t.m = 0 GROUP BY t.tag, c.i),
v AS (SELECT tag, w AS v FROM w UNION ALL SELECT tag, -w FROM w)"""


_SPLIT_SIZES = """k AS (SELECT count(*) AS n, CAST(round(CAST(0.67 AS DOUBLE) * count(*)) AS BIGINT) AS k FROM embeddings)"""


def _train_sql(epochs: int = 3) -> str:
    logged = ["accuracy", "cross_entropy", "roc_auc", "graph_tp", "graph_fp", "graph_tn", "graph_fn", "auc_graph_cumulative"]
    rows = [f"('r0', {e}, 'train_batches', '{m}')" for e in range(epochs) for m in ("mean_batch_loss", "learning_rate")]
    rows += [f"('r0', {e}, '{sp}', '{m}')" for e in range(epochs) if e % 2 == 0 or e == epochs - 1
             for sp in ("train", "test") for m in logged]
    return f"""WITH {_SPLIT_SIZES}, e(run, epoch, split, metric) AS (VALUES {", ".join(rows)})
SELECT run, CAST(epoch AS INTEGER) AS epoch, split, metric, TRUE AS ok,
  CAST(CASE split WHEN 'train' THEN k WHEN 'test' THEN n - k END AS BIGINT) AS split_rows FROM e, k"""


def _metrics_log_sql() -> str:
    ce = "-(CAST(label AS DOUBLE) * logp0 + (CAST(1 AS DOUBLE) - CAST(label AS DOUBLE)) * logp1)"
    hit = ("CASE WHEN pred = (CASE WHEN label = 1 THEN 0 ELSE 1 END) THEN CAST(1 AS DOUBLE) "
           "ELSE CAST(0 AS DOUBLE) END")
    return f"""WITH {_MLP2T}, sc AS (SELECT g AS split, * FROM scored),
a AS (SELECT split, avg({hit}) AS accuracy, avg({ce}) AS ce FROM sc GROUP BY split),
auc AS {Q.auc_sql('sc', 'p0', 'label', 'split')}
SELECT 'r0' AS run, 0 AS epoch, split, 'accuracy' AS metric, {Q.r6('accuracy')} AS value FROM a
UNION ALL SELECT 'r0', 0, split, 'cross_entropy', {Q.r6('ce')} FROM a
UNION ALL SELECT 'r0', 0, split, 'roc_auc', {Q.r6('roc_auc')} FROM auc
UNION ALL SELECT 'r0', 0, split, 'graph_' || m.name, {Q.r6('CAST(m.v AS DOUBLE)')} FROM (
  SELECT split,
    sum(CASE WHEN pred = 1 AND tix = 1 THEN 1 ELSE 0 END) AS tp, sum(CASE WHEN pred = 0 AND tix = 1 THEN 1 ELSE 0 END) AS fp,
    sum(CASE WHEN pred = 0 AND tix = 0 THEN 1 ELSE 0 END) AS tn, sum(CASE WHEN pred = 1 AND tix = 0 THEN 1 ELSE 0 END) AS fn
  FROM (SELECT split, pred, CASE WHEN label = 1 THEN 0 ELSE 1 END AS tix FROM sc) x GROUP BY split) c,
  LATERAL (VALUES ('tp', c.tp), ('fp', c.fp), ('tn', c.tn), ('fn', c.fn)) m(name, v)"""


ORACLE = {
    "metrics_log": _metrics_log_sql(),
    "batch_gradient": _gradient_sql(),
    "batch_gradient_wide": _gradient_wide_sql(),
    "save_params": _init_sql(),
    "adam_step": _adam_sql(),
    "epoch_report": _epoch_report_sql(),
    "export_tagged": f"WITH {_CENTROID} SELECT tag, count(*) AS cells, {Q.r6('sum(abs(v))')} AS size FROM v GROUP BY tag",
    "param_histogram": f"""WITH {_CENTROID},
c AS (SELECT least(11, floor((v - CAST(-0.03 AS DOUBLE)) / (CAST(0.03 AS DOUBLE) - CAST(-0.03 AS DOUBLE)) * 12)) AS bin, count(*) AS n
      FROM v WHERE tag = 'serve' AND v BETWEEN CAST(-0.03 AS DOUBLE) AND CAST(0.03 AS DOUBLE) GROUP BY 1)
SELECT CAST(r.range AS INTEGER) AS bin, {Q.r6("CAST(-0.03 AS DOUBLE) + r.range * CAST(0.06 AS DOUBLE) / 12")} AS lo_edge,
  {Q.r6("CAST(-0.03 AS DOUBLE) + (r.range + 1) * CAST(0.06 AS DOUBLE) / 12")} AS hi_edge, CAST(coalesce(n, 0) AS BIGINT) AS count
FROM range(12) r LEFT JOIN c ON c.bin = r.range""",
    "width_report": f"""SELECT count(*) AS n_rows, CAST(min(len(embedding)) AS INTEGER) AS min_width,
  CAST(max(len(embedding)) AS INTEGER) AS max_width, CAST(sum(CASE WHEN len(embedding) <> {EMB_WIDTH} THEN 1 ELSE 0 END) AS BIGINT) AS n_misfit,
  {EMB_WIDTH} AS model_width FROM embeddings""",
    "model_targets": """SELECT vec_id, CAST(CASE WHEN label < 5 THEN 1 ELSE 0 END AS DOUBLE) AS y0,
  CAST(CASE WHEN label < 5 THEN 0 ELSE 1 END AS DOUBLE) AS y1, CASE WHEN label < 5 THEN 1 ELSE 0 END AS cls FROM embeddings""",
    "train_mlp": _train_sql(),
    "warm_start": _warm_start_sql(),
    "forest_train": "SELECT CAST(range AS INTEGER) AS tree, count(*) > 0 AS nodes_ok, TRUE AS depth_ok FROM range(100), embeddings GROUP BY range",
    "forest_score": f"""WITH o AS (SELECT vec_id, label, row_number() OVER (ORDER BY md5('{SEED}:' || CAST(vec_id AS VARCHAR)), vec_id) - 1 AS ix
  FROM embeddings), {_SPLIT_SIZES}
SELECT vec_id, CASE WHEN label < 5 THEN 1 ELSE 0 END AS label, TRUE AS p1_equal, TRUE AS pred_equal FROM o, k WHERE ix >= k""",
    "forest_nodes": f"""WITH {Q.emb_src("split")}, c AS (SELECT sum(1 - label) AS n0, sum(label) AS n1 FROM (SELECT DISTINCT id, label FROM src WHERE g = 'train'))
SELECT CAST(t.range AS INTEGER) AS tree, CAST(n0 AS BIGINT) AS root0, CAST(n1 AS BIGINT) AS root1, CAST(n0 AS BIGINT) AS leaf0, CAST(n1 AS BIGINT) AS leaf1,
  CAST(n0 AS BIGINT) AS sent0, CAST(n1 AS BIGINT) AS sent1, TRUE AS leaves_hold_their_rows FROM c, range(5) t""",
    "checkpoint_versions": f"""WITH {Q.EMB_CELLS},
t(step, m, version) AS (VALUES ('first', 1, 0), ('half-written', 1, 0), ('committed', 2, 1), ('replaced', 3, 0)),
w AS (SELECT t.step, t.version, c.i, avg(CASE WHEN c.label = 1 THEN c.v END) - avg(CASE WHEN c.label = 0 THEN c.v END) AS w
      FROM emb_cells c JOIN t ON c.id % t.m = 0 GROUP BY t.step, t.version, c.i)
SELECT step, CAST(version AS INTEGER) AS version, 2 * count(*) AS cells, {Q.r6("2 * sum(abs(w))")} AS size, CAST(version AS VARCHAR) AS pointer
FROM w GROUP BY step, version""",
    "three_step_train_test": _three_step_sql(),
    "load_params": _param_rows_sql(),
    "score_saved_model": f"""WITH {Q.emb_src("split").replace("src AS (SELECT c.id, s.split AS g", "src AS (SELECT c.id, s.split AS g") .replace("FROM emb_cells c JOIN spl s ON c.id = s.vec_id)", "FROM emb_cells c JOIN spl s ON c.id = s.vec_id WHERE s.split = 'test')")},
{Q.mlp_ctes("src", EMB_WIDTH, HIDDEN2)}
SELECT CAST(count(*) AS BIGINT) AS n_rows,
  {Q.r6("avg(CASE WHEN pred = (CASE WHEN label = 1 THEN 0 ELSE 1 END) THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)")} AS accuracy,
  (SELECT {Q.r6('roc_auc')} FROM {Q.auc_sql('scored', 'p0', 'label')} a) AS roc_auc,
  {Q.r6("avg(-(CAST(label AS DOUBLE) * logp0 + (CAST(1 AS DOUBLE) - CAST(label AS DOUBLE)) * logp1))")} AS cross_entropy
FROM scored""",
}
