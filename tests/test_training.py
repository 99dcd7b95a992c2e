"""Distributed gradient vs finite differences; Adam step; loss falls."""

import math

import numpy as np
import pandas as pd

from duoclass.operators.kernels import Inputs, forward, log_softmax
from duoclass.operators.model import init_model
from duoclass.operators.optimizer import BLOCK_ROWS, adam_step, arrays_of, block_tuples, cells, state_of, BLOCK_SCHEMA
from duoclass.operators.training import batch_gradient, gradient_blocks, staircase_lr, train


def data(spark, n=48, d=4, parts=3, seed=0):
    rng = np.random.default_rng(seed)
    X = rng.normal(size=(n, d))
    y = (X[:, 0] + 0.3 * rng.normal(size=n) > 0).astype(int)
    pdf = pd.DataFrame({"row_id": np.arange(n), "label": y, "features": list(X)})
    return spark.createDataFrame(pdf).repartition(parts), X, y


def np_loss(model, X, y, drop):
    x = Inputs(len(X), X.shape[1], dense=X)
    moms = []
    for l in range(1, len(model.hidden) + 1):
        z = forward(x, model, moms, stop_at=l, dropout=drop)["z"][-1]
        moms.append((z.mean(0), np.sqrt(z.var(0) + model.eps)))
    yv = forward(x, model, moms, dropout=drop)["y"]
    T = np.column_stack([y, 1 - y]).astype(float)
    return -(T * log_softmax(yv)).sum() / len(X)


def test_gradient_finite_differences(spark):
    df, X, y = data(spark)
    for hidden, keep in (([3], 1.0), ([3, 2], 0.5)):
        m = init_model(4, hidden, seed=4)
        g, st = batch_gradient(df, m, keep_prob=keep, seed=11, step=3)
        drop = None if keep >= 1 else {"seed": 11, "step": 3, "keep": keep, "row_ids": np.arange(len(X)),
                                      "input": True}
        assert abs(st["loss"] - np_loss(m, X, y, drop)) < 1e-12
        for key, a in m.arrays().items():
            for idx in list(np.ndindex(a.shape))[:6]:
                mp, mm = m.copy(), m.copy()
                ap, am = mp.arrays()[key].copy(), mm.arrays()[key].copy()
                ap[idx] += 1e-6
                am[idx] -= 1e-6
                mp.set_array(key, ap)
                mm.set_array(key, am)
                num = (np_loss(mp, X, y, drop) - np_loss(mm, X, y, drop)) / 2e-6
                assert abs(num - g[key][idx]) < 1e-7, (hidden, key, idx)


def np_adam(p, g, m, v, lr, t):
    m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
    return p - lr * math.sqrt(1 - 0.999 ** t) / (1 - 0.9 ** t) * m / (np.sqrt(v) + 1e-8), m, v


def test_adam_and_staircase(spark):
    """Two steps of the joined update against NumPy; a block without gradient decays."""
    assert staircase_lr(0.05, 0.95, 5000, 4999) == 0.05
    assert math.isclose(staircase_lr(0.05, 0.95, 5000, 10000), 0.05 * 0.95 ** 2)
    model = init_model(3 * BLOCK_ROWS + 5, [4], seed=0)
    r = np.random.default_rng(1)
    state = state_of(spark, model)
    want = {k: (a, np.zeros_like(a), np.zeros_like(a)) for k, a in model.arrays().items()}
    for t in (1, 2):
        g = {k: r.normal(size=a.shape) for k, a in model.arrays().items()}
        if t == 2:
            g[1, "W"][BLOCK_ROWS:2 * BLOCK_ROWS] = 0
        rows = [x for x in block_tuples(g) if t == 1 or x[:3] != (1, "W", 1)]
        grads = spark.createDataFrame(rows + [(9, "W", 0, 1, [1.0])], BLOCK_SCHEMA)
        state = adam_step(state, grads, 0.1, t)
        want = {k: np_adam(p, g[k], m, v, 0.1, t) for k, (p, m, v) in want.items()}
    for i, column in enumerate(("value", "m", "v")):
        got = arrays_of(state, column)
        assert got.keys() == want.keys()
        assert all(np.allclose(got[k], want[k][i], rtol=1e-13, atol=1e-15) for k in want)
    c = {(x["name"], x["layer"], x["i"], x["j"]): x["value"] for x in cells(state).collect()}
    assert len(c) == model.n_cells and c["W", 1, 2 * BLOCK_ROWS + 3, 2] == arrays_of(state)[1, "W"][2 * BLOCK_ROWS + 3, 2]


def test_sparse_gradient_has_touched_blocks_only(spark):
    """Rows travel only where a feature occurs: of 40 blocks, two have a gradient row."""
    width = 40 * BLOCK_ROWS
    feats = [[(i * 7 % 20, 1.0), (30 * BLOCK_ROWS + i % 5, 0.5 + i)] for i in range(30)]
    df = spark.createDataFrame([(i, i % 2, f) for i, f in enumerate(feats)], "row_id long, label int, feats array<struct<i:int,v:double>>").repartition(5)
    m = init_model(width, [3], seed=2)
    blocks, _ = gradient_blocks(df, m, features="feats", sparse=True)
    assert sorted(r["block"] for r in blocks.filter("layer = 1 AND name = 'W'").collect()) == [0, 30]
    g, _ = batch_gradient(df, m, features="feats", sparse=True)
    dense = np.zeros((30, width))
    for i, f in enumerate(feats):
        for j, x in f:
            dense[i, j] += x
    full = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(30), "label": np.arange(30) % 2, "features": list(dense)})).repartition(3)
    gd, _ = batch_gradient(full, m)
    assert all(np.allclose(g[k], gd[k], atol=1e-12) for k in g)


def test_reduction_tree_has_bounded_fan_in(spark):
    """No task receives a block from every partition."""
    from duoclass.operators.training import FAN_IN, _add_blocks, _block_rows, _sum_blocks, tree_levels
    assert tree_levels(1) == [1] and tree_levels(16) == [1] and tree_levels(17) == [2, 1] and tree_levels(10 ** 6)[-1] == 1
    left = 10 ** 6
    for parts in tree_levels(left):
        assert max(len(range(p, left, parts)) for p in {0, parts - 1}) <= FAN_IN
        left = parts
    df = spark.range(0, 900, 1, 90)
    sums = _sum_blocks(df, lambda pdf, _: {"n": np.full((70, 2), float(len(pdf))), "none": np.zeros((200, 1))})
    got = {(r["key"], r["block"]): r for r in sums.collect()}
    assert sorted(got) == [("n", 0), ("n", 1), ("none", 0)]
    assert np.frombuffer(bytes(got["n", 1]["data"])).tolist() == [900.0] * 12
    a = _block_rows({"x": np.eye(3) * [1, 0, 2]}, 4)
    assert list(_add_blocks([a]))[0]["rows"].tolist() == [bytes([0, 2])]


def test_loss_falls(spark):
    df, X, y = data(spark, n=160, seed=2)
    from pyspark.sql import functions as F
    df = df.withColumn("split", F.when(F.col("row_id") < 120, "train").otherwise("test"))
    m = init_model(4, [6], seed=1)
    m, metrics = train(spark, df, m, epochs=5, n_batches=3, lr0=0.05, keep_prob=1.0, seed=1, eval_every=4)
    losses = [r["value"] for r in metrics.filter("metric = 'mean_batch_loss'").orderBy("epoch").collect()]
    assert losses[-1] < losses[0]
    assert m.global_step == 5 * 3


def test_width_check_and_warm_start(spark, tmpdir_path):
    import pytest
    from pyspark.sql import functions as F

    from duoclass.operators.training import check_width
    from duoclass.sources.params_store import load_model, save_params
    df, X, y = data(spark, n=80, seed=3)
    df = df.withColumn("split", F.when(F.col("row_id") < 60, "train").otherwise("test"))
    with pytest.raises(ValueError):
        check_width(df, init_model(5, [3]))
    assert check_width(df, init_model(5, [3]), on_mismatch="warn") == 4
    m = init_model(4, [3], seed=9)
    save_params(spark, m, tmpdir_path, "mlp", 0)
    fresh = init_model(4, [3], seed=123)
    out, _ = train(spark, df, fresh, epochs=1, n_batches=2, keep_prob=1.0, eval_every=0,
                   params_root=tmpdir_path, model_name="mlp", warm_start=True)
    # warm start continued from the saved version, then saved epoch 0 over it
    assert out.global_step == 2
    again = load_model(spark, tmpdir_path, "mlp")
    assert again.global_step == 2 and not np.allclose(again.W_out, m.W_out)


def test_gradient_does_not_depend_on_partitions(spark):
    df, X, y = data(spark, n=64, d=4, parts=4, seed=5)
    for hidden, keep in (([3], 0.5), ([4, 3], 0.5), ([3], 1.0), ([70], 1.0)):
        m = init_model(4, hidden, seed=2)
        g1, s1 = batch_gradient(df, m, keep_prob=keep, seed=3, step=4)
        g2, s2 = batch_gradient(df.coalesce(1), m, keep_prob=keep, seed=3, step=4)
        assert set(g1) == set(g2)
        for k in g1:
            assert g1[k].shape == m.arrays()[k].shape and np.allclose(g1[k], g2[k], atol=1e-12), k
        assert abs(s1["loss"] - s2["loss"]) < 1e-12 and s1["n"] == s2["n"] == 64


def test_sparse_and_dense_inputs_same_gradient(spark):
    rng = np.random.default_rng(7)
    n, d = 40, 6
    X = np.where(rng.random((n, d)) < 0.4, rng.normal(size=(n, d)), 0.0)
    y = (rng.random(n) < 0.5).astype(int)
    feats = [[(int(j), float(X[i, j])) for j in range(d) if X[i, j] != 0.0] for i in range(n)]
    sp = spark.createDataFrame(list(zip(range(n), y.tolist(), feats)),
                               "row_id long, label int, feats array<struct<i:int,v:double>>").repartition(3)
    de = spark.createDataFrame(pd.DataFrame({"row_id": np.arange(n), "label": y, "features": list(X)})).repartition(3)
    m = init_model(d, [4], seed=3)
    gs, _ = batch_gradient(sp, m, keep_prob=0.5, seed=1, step=2, features="feats", sparse=True)
    gd, _ = batch_gradient(de, m, keep_prob=0.5, seed=1, step=2)
    for k in gd:
        assert np.allclose(gs[k], gd[k], atol=1e-12), k


def test_sequential_batches_training(spark):
    """D7: batches in file order (no shuffle); same step count, loss falls."""
    from pyspark.sql import functions as F
    df, X, y = data(spark, n=120, seed=8)
    df = df.withColumn("split", F.when(F.col("row_id") < 100, "train").otherwise("test"))
    m, metrics = train(spark, df, init_model(4, [5], seed=2), epochs=3, n_batches=4, lr0=0.05,
                       keep_prob=1.0, shuffle=False, eval_every=0)
    assert m.global_step == 3 * 4
    losses = [r["value"] for r in metrics.filter("metric = 'mean_batch_loss'").orderBy("epoch").collect()]
    assert losses[-1] < losses[0]


def test_initial_weights_are_the_same_in_every_form(spark):
    """Cells by column expressions = NumPy = any split into partitions; within two deviations."""
    from duoclass.operators.model import init_cells, truncated_normal_np
    m = init_model(37, [9, 5], seed=6)
    rows = {(r["layer"], r["name"], r["i"], r["j"]): r["value"] for r in init_cells(spark, 37, [9, 5], seed=6).collect()}
    assert len(rows) == m.n_cells + 2
    for (layer, name), a in m.arrays().items():
        for at in np.ndindex(a.shape):
            i, j = at if len(at) == 2 else (0, at[0])
            assert abs(rows[layer, name, i, j] - a[at]) < 1e-14
    z = truncated_normal_np(1, 1, 300, 300)
    assert np.abs(z).max() <= 2 and abs(z.mean()) < 0.02 and abs(z.std() - 0.8796) < 0.01
    assert abs(np.corrcoef(z.ravel(), truncated_normal_np(1, 2, 300, 300).ravel())[0, 1]) < 0.02


def test_wide_batches_are_taken_in_slices(spark):
    """an Arrow batch of wide rows isn't worked on at once."""
    from duoclass.operators.kernels import SLICE_CELLS, slices
    from duoclass.operators.training import _sum_blocks

    m = init_model(574, [750, 350], seed=1)
    seen = _sum_blocks(spark.range(0, 2000, 1, 1), lambda pdf, _: {"calls": np.ones((1, 1)), "rows": np.full((1, 1), float(len(pdf))),
                                                                   "ids": pdf[["id"]].to_numpy(np.float64).sum(axis=0)[None, :]}, model=m)
    got = {r["key"]: np.frombuffer(bytes(r["data"]))[0] for r in seen.collect()}
    assert got["rows"] == 2000 and got["ids"] == 1999000
    assert got["calls"] >= 2000 * (574 + m.n_units) / SLICE_CELLS > 3
    dense = pd.DataFrame({"_x": [[0.0]] * 2000, "id": np.arange(2000)})
    sparse = pd.DataFrame({"_xi": [list(range(k % 40)) for k in range(2000)], "id": np.arange(2000)})
    for pdf, cells in ((dense, np.full(2000, 574 + 1102)), (sparse, np.array([1102 * (1 + k % 40) for k in range(2000)]))):
        parts = [p["id"].tolist() for p in slices(pdf, 574, 1102)]
        assert [i for p in parts for i in p] == list(range(2000))
        assert all(cells[p].sum() < SLICE_CELLS + cells.max() for p in parts)
        assert len(list(slices(pdf, 574, 1102, least=10 ** 9))) == 1
    assert [len(p) for p in slices(dense[:0], 574, 1102)] == [0]
