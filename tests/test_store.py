"""Commit protocol of the parameter store; forests as node tables."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from duoclass.operators.forest import (forest_descend, forest_nodes, forest_score, forest_score_nodes, forest_train, load_forest, nodes_depth,
                                       save_forest)
from duoclass.operators.model import init_model
from duoclass.operators.optimizer import state_of
from duoclass.sources.params_store import (commit_version, committed_versions, latest_version, load_model, load_table, parse_pointer, read_pointer,
                                           save_params, save_state, save_table, stage_table)


def rows(spark, n):
    return spark.range(n)


def test_half_written_and_replaced_versions(spark, tmpdir_path):
    with pytest.raises(FileNotFoundError):
        latest_version(spark, tmpdir_path, "m")
    save_table(rows(spark, 3), tmpdir_path, "m", 4)
    run, path = stage_table(rows(spark, 5), tmpdir_path, "m", 7)
    assert latest_version(spark, tmpdir_path, "m") == 4 and load_table(spark, tmpdir_path, "m").count() == 3
    with pytest.raises(FileNotFoundError):
        load_table(spark, tmpdir_path, "m", 7)
    commit_version(spark, tmpdir_path, "m", 7, run)
    assert latest_version(spark, tmpdir_path, "m") == 7 and load_table(spark, tmpdir_path, "m").count() == 5
    again, _ = stage_table(rows(spark, 9), tmpdir_path, "m", 7)      # a second save of 7 in the making
    assert load_table(spark, tmpdir_path, "m", 7).count() == 5
    commit_version(spark, tmpdir_path, "m", 7, again)
    assert load_table(spark, tmpdir_path, "m", 7).count() == 9
    assert {v: m["rows"] for v, m in committed_versions(spark, tmpdir_path, "m").items()} == {4: 3, 7: 9}
    left = [n for _, _, files in os.walk(tmpdir_path) for n in files if n.startswith(".checkpoint.") and not n.endswith(".crc")]
    assert not left      # nothing lies beside the pointer
    os.remove(f"{tmpdir_path}/model=m/checkpoint")
    assert latest_version(spark, tmpdir_path, "m") == 7


def test_pointer_file(spark, tmpdir_path):
    """The two-line form, with paths and stray lines."""
    with open(f"{tmpdir_path}/checkpoint", "w") as f:
        f.write('model_checkpoint_path: "models/my M-3"\n# note\nall_model_checkpoint_paths: "a"\nall_model_checkpoint_paths: "models/my M-3"\n\nbroken: x\n')
    got = read_pointer(spark, f"{tmpdir_path}/checkpoint")
    assert got == {"model_checkpoint_path": ["models/my M-3"], "all_model_checkpoint_paths": ["a", "models/my M-3"]}
    assert parse_pointer(spark.createDataFrame([], "value string")).count() == 0
    save_table(rows(spark, 1), tmpdir_path, "m", 2)
    assert read_pointer(spark, f"{tmpdir_path}/model=m/checkpoint") == {"model_checkpoint_path": ["2"], "all_model_checkpoint_paths": ["2"]}


def test_state_saved_from_table_to_table(spark, tmpdir_path):
    m = init_model(70, [3], seed=1)
    m.slots[1, "W", "m"] = np.arange(210.0).reshape(70, 3)
    m.global_step = 5
    save_state(spark, state_of(spark, m), m, tmpdir_path, "a", 0)
    save_params(spark, m, tmpdir_path, "b", 0)
    a, b = load_model(spark, tmpdir_path, "a"), load_model(spark, tmpdir_path, "b")
    assert a.global_step == b.global_step == 5
    assert all(np.array_equal(a.arrays()[k], b.arrays()[k]) for k in b.arrays())
    assert np.array_equal(a.slots[1, "W", "m"], b.slots[1, "W", "m"]) and not a.slots[1, "W", "v"].any()


def forest_data(spark, n=400):
    r = np.random.default_rng(3)
    x = r.normal(size=(n, 4)).round(1)
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    return spark.createDataFrame([(i, int(y[i]), x[i].tolist()) for i in range(n)], "id long, label int, features array<double>").repartition(3)


def test_restored_forest_equals_spark_ml(spark, tmpdir_path):
    df = forest_data(spark)
    model = forest_train(df, numTrees=6, maxDepth=5, minInstancesPerNode=3, seed=1)
    save_forest(spark, model, tmpdir_path, "f", 1)
    nodes = load_forest(spark, tmpdir_path, "f")
    assert nodes_depth(nodes) == max(t.depth for t in model.trees)
    assert nodes.count() == sum(t.numNodes for t in model.trees)
    want = {r["id"]: r for r in forest_score(model, df, keep=["id"]).collect()}
    for max_cells in (10 ** 7, 0):      # broadcast and shuffled trees
        leaf = forest_descend(nodes, df, "id", max_cells=max_cells)
        assert leaf.count() == 6 * len(want)
    got = forest_score_nodes(nodes, df, "id").collect()
    assert len(got) == len(want)
    assert all(abs(r["p1"] - want[r["id"]]["p1"]) < 1e-12 and r["pred"] == want[r["id"]]["pred"] for r in got)


def test_forest_scores_in_a_session_with_observed_metrics(spark):
    """the trained model's summary holds the session, and with it its observations."""
    from pyspark.sql import Observation

    df = forest_data(spark, 60)
    seen = Observation("forest_rows")
    assert df.observe(seen, F.count(F.lit(1)).alias("n")).count() == 60 and seen.get == {"n": 60}
    model = forest_train(df, numTrees=2, maxDepth=2, minInstancesPerNode=3, seed=1)
    got = forest_score(model, df, keep=["id"]).collect()
    assert sorted(r["id"] for r in got) == list(range(60)) and all(0.0 <= r["p1"] <= 1.0 for r in got)
    assert model.hasSummary


def test_descent_by_hand_and_missing_values(spark):
    nodes = spark.createDataFrame([(0, 0, 1, 0.5, 1, 2, [4.0, 4.0]), (0, 1, None, None, None, None, [3.0, 1.0]), (0, 2, None, None, None, None, [1.0, 3.0]),
                                   (1, 0, None, None, None, None, [2.0, 2.0])],
                                  "tree int, node int, feature int, threshold double, left int, right int, counts array<double>")
    df = spark.createDataFrame([(1, [9.0, 0.5]), (2, [9.0, 0.6]), (3, [9.0]), (4, [9.0, None]), (5, None)], "id long, features array<double>")
    got = {r["id"]: (r["p1"], r["pred"]) for r in forest_score_nodes(nodes, df, "id").collect()}
    assert got == {1: (0.375, 0), 2: (0.625, 1), 3: (0.625, 1), 4: (0.625, 1), 5: (0.625, 1)}


def test_whole_tree_counts(spark):
    df = forest_data(spark)
    model = forest_train(df, numTrees=2, maxDepth=4, minInstancesPerNode=5, bootstrap=False, seed=2)
    nodes = forest_nodes(spark, model)
    n = [df.filter(f"label = {k}").count() for k in (0, 1)]
    for r in nodes.where("node = 0").collect():
        assert r["counts"] == [float(x) for x in n]
    inner = {(r["tree"], r["node"]): r for r in nodes.collect()}
    for (t, _), r in inner.items():
        if r["feature"] is not None:
            a, b = inner[t, r["left"]]["counts"], inner[t, r["right"]]["counts"]
            assert [x + y for x, y in zip(a, b)] == r["counts"]
    assert nodes.select(F.count_distinct("tree")).first()[0] == 2
