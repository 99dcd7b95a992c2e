"""Forward pass: batch-norm semantics, sparse/dense agreement, partition-proofness."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from duoclass.operators.kernels import Inputs, forward, softmax
from duoclass.operators.model import Layer, Model, init_model, intmod_model
from duoclass.operators.scoring import affine, affine_relational, score, weights_frame


def frame(spark, X, y, parts=4):
    pdf = pd.DataFrame({"row_id": np.arange(len(y)), "label": y, "features": list(X)})
    return spark.createDataFrame(pdf).repartition(parts)


def numpy_scores(X, model):
    x = Inputs(len(X), X.shape[1], dense=X)
    moms = []
    for l in range(1, len(model.hidden) + 1):
        z = forward(x, model, moms, stop_at=l)["z"][-1]
        moms.append((z.mean(0), np.sqrt(z.var(0) + model.eps)))
    return softmax(forward(x, model, moms)["y"])


def test_score_matches_numpy_any_partitioning(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(300, 6))
    y = (rng.random(300) < 0.5).astype(int)
    m = init_model(6, [5, 3], seed=1)
    ref = numpy_scores(X, m)[:, 0]
    for parts in (1, 4, 16):
        got = {r["row_id"]: r["p0"] for r in score(frame(spark, X, y, parts), m).collect()}
        assert max(abs(got[i] - ref[i]) for i in range(300)) < 1e-12


def test_constant_column_gives_shift(spark):
    X = np.ones((20, 3))
    m = Model([Layer(np.ones((3, 2)), np.zeros(2), np.array([2.0, 3.0]), np.array([0.7, -0.4]))],
              np.eye(2), np.zeros(2))
    s = score(frame(spark, X, np.zeros(20, dtype=int)), m).collect()
    # z is constant -> zhat = 0 -> u = beta -> relu -> output logits = relu(beta)
    for r in s:
        assert abs(r["y0"] - 0.7) < 1e-12 and abs(r["y1"] - 0.0) < 1e-12


def test_hidden_bias_has_no_effect(spark):
    rng = np.random.default_rng(2)
    X = rng.normal(size=(50, 4))
    m = init_model(4, [3], seed=2)
    m2 = m.copy()
    m2.hidden[0].b = m2.hidden[0].b + 5.0
    a = sorted((r["row_id"], r["p0"]) for r in score(frame(spark, X, np.zeros(50, dtype=int)), m).collect())
    b = sorted((r["row_id"], r["p0"]) for r in score(frame(spark, X, np.zeros(50, dtype=int)), m2).collect())
    assert max(abs(x[1] - y[1]) for x, y in zip(a, b)) < 1e-9


def test_sparse_equals_dense_and_zero_row_is_bias(spark):
    W = intmod_model(5, [3]).hidden[0].W
    b = np.array([0.1, -0.2, 0.3])
    rows = [(0, [(0, 1.0), (3, 2.0)]), (1, []), (2, [(4, -1.5)])]
    sp = spark.createDataFrame(rows, "row_id long, feats array<struct<i:int,v:double>>")
    zs = {r["row_id"]: r["z"] for r in affine(sp, W, b, features="feats", sparse=True).collect()}
    dense = np.zeros((3, 5))
    dense[0, 0], dense[0, 3], dense[2, 4] = 1.0, 2.0, -1.5
    for i in range(3):
        assert np.allclose(zs[i], dense[i] @ W + b)
    assert np.allclose(zs[1], b)
    # relational form agrees, and keeps the all-zero row
    trip = sp.select("row_id", F.inline("feats")).select("row_id", F.col("i").alias("col"), F.col("v").alias("value"))
    wdf, bdf = weights_frame(spark, W, b)
    rel = affine_relational(trip, sp.select("row_id"), wdf, bdf).collect()
    assert len(rel) == 9
    for r in rel:
        assert abs(r["z"] - zs[r["row_id"]][r["unit"]]) < 1e-12


def test_params_roundtrip(spark, tmpdir_path):
    from duoclass.sources.params_store import load_model, save_params
    m = init_model(7, [4, 3], seed=5)
    m.slots[(1, "W", "m")] = np.ones((7, 4))
    m.global_step = 12
    save_params(spark, m, tmpdir_path, "mlp", 0)
    m2 = m.copy()
    m2.W_out = m2.W_out + 1
    save_params(spark, m2, tmpdir_path, "mlp", 3)
    back = load_model(spark, tmpdir_path, "mlp")
    assert np.array_equal(back.W_out, m2.W_out) and back.global_step == 12
    v0 = load_model(spark, tmpdir_path, "mlp", version=0)
    for k, a in m.arrays().items():
        assert np.array_equal(v0.arrays()[k], a)
    assert np.array_equal(v0.slots[(1, "W", "m")], np.ones((7, 4)))


def test_toy_linear_round_trip(spark, tmpdir_path):
    """Save a one-weight linear model (w assigned 3 after an initial 2, b = 0),
    restore it from the parameter table and ask it at x = 3: y = 9."""
    from duoclass.sources.params_store import load_model, save_params
    m = Model([], np.array([[2.0]]), np.array([0.0]))
    m.W_out = np.array([[3.0]])  # the assignment made before saving
    save_params(spark, m, tmpdir_path, "toy", 0, tag="tag")
    back = load_model(spark, tmpdir_path, "toy", tag="tag")
    x = spark.createDataFrame([(0, [3.0])], "row_id long, features array<double>")
    y = affine(x, back.W_out, back.b_out, keep=["row_id"]).first()["z"]
    assert y == [9.0]


def test_grouped_scoring_with_null_group(spark):
    rng = np.random.default_rng(4)
    X = rng.normal(size=(60, 3))
    groups = ["a"] * 20 + [None] * 20 + ["b"] * 20
    pdf = pd.DataFrame({"row_id": np.arange(60), "label": np.zeros(60, dtype=int), "g": groups,
                        "features": list(X)})
    df = spark.createDataFrame(pdf, "row_id long, label int, g string, features array<double>").repartition(3)
    m = init_model(3, [2], seed=0)
    got = {r["row_id"]: r["p0"] for r in score(df, m, group_cols=["g"]).collect()}
    for lo in (0, 20, 40):  # each group normalised by its own moments
        ref = numpy_scores(X[lo:lo + 20], m)[:, 0]
        assert max(abs(got[lo + i] - ref[i]) for i in range(20)) < 1e-12


def test_batch_norm_long_per_group(spark):
    from duoclass.operators.scoring import batch_norm_long
    rng = np.random.default_rng(6)
    rows = [(g, r, u, float(rng.normal() * (3 if g == "a" else 1)))
            for g in ("a", "b") for r in range(30) for u in range(2)]
    df = spark.createDataFrame(rows, "g string, row_id long, unit int, z double")
    got = {(r["g"], r["row_id"], r["unit"]): r["u"] for r in batch_norm_long(df, group_cols=["g"]).collect()}
    for g in ("a", "b"):
        for u in range(2):
            z = np.array([v for gg, r, uu, v in rows if gg == g and uu == u])
            ref = (z - z.mean()) / np.sqrt(z.var() + 1e-3)
            assert max(abs(got[(g, r, u)] - ref[r]) for r in range(30)) < 1e-12


def test_too_wide_sparse_rows_are_an_error_or_cut_on_request(spark):
    import pytest
    df = spark.createDataFrame([(1, [(0, 1.0), (70, 2.0)]), (2, [(1, 3.0)])], "row_id long, feats array<struct<i:int,v:double>>")
    m = intmod_model(64, [])
    with pytest.raises(Exception, match="does not fit"):
        affine(df, m.W_out, m.b_out, features="feats", sparse=True).collect()
    with pytest.raises(Exception, match="does not fit"):
        score(df, m, "feats", sparse=True).collect()
    cut = score(df, m, "feats", sparse=True, truncate=True, keep=["row_id"]).collect()
    plain = score(spark.createDataFrame([(1, [(0, 1.0)]), (2, [(1, 3.0)])], df.schema), m, "feats", sparse=True, keep=["row_id"]).collect()
    assert sorted(map(tuple, cut)) == sorted(map(tuple, plain))


def test_joined_moments_equal_shipped_moments(spark):
    """More groups than the bound: the moments are joined to the rows, null group included."""
    rng = np.random.default_rng(4)
    rows = [(i, None if i % 7 == 0 else f"g{i % 7}", [float(v) for v in rng.normal(size=5)]) for i in range(140)]
    df = spark.createDataFrame(rows, "row_id long, grp string, features array<double>").repartition(3)
    for hidden in ([4], [4, 3]):
        m = intmod_model(5, hidden)
        a, b = (score(df, m, group_cols=["grp"], keep=["row_id"], max_moment_rows=k).orderBy("row_id").toPandas() for k in (10**6, 0))
        assert (a["row_id"] == b["row_id"]).all()
        assert np.allclose(a[["y0", "y1", "p0"]], b[["y0", "y1", "p0"]], atol=1e-9)


def test_moments_far_from_zero_keep_their_precision(spark):
    from duoclass.operators.scoring import dense_input, layer_moments
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 3)) + 1e6
    df = spark.createDataFrame([(list(map(float, v)),) for v in x], "features array<double>").repartition(4)
    m = intmod_model(3, [2])
    z = x @ m.hidden[0].W + m.hidden[0].b
    got = {r["unit"]: (r["n"], r["mean"], r["var"]) for r in layer_moments(dense_input(df), m, 1, {}).collect()}
    for u in range(2):
        assert got[u][0] == 300 and np.isclose(got[u][1], z[:, u].mean(), rtol=1e-12)
        assert np.isclose(got[u][2], z[:, u].var(), rtol=1e-6)
