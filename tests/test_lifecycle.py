"""End-to-end lifecycles on real text files: dense CSV and keyed sparse training."""

import numpy as np
from pyspark.sql import functions as F

from duoclass.operators import metrics as M
from duoclass.operators.model import init_model
from duoclass.operators.ordering import split_shuffled
from duoclass.operators.training import train
from duoclass.sources import text as TX


def _write(path, lines):
    with open(path, "w") as f:
        f.write("\n".join(lines) + "\n")


def test_dense_csv_file_train_and_test(spark, tmpdir_path):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(240, 5))
    y = (X[:, 0] - X[:, 1] > 0).astype(int)
    _write(f"{tmpdir_path}/training_set", [",".join(f"{v:.6f}" for v in x) + f",{l}" for x, l in zip(X, y)])
    rows = TX.good_rows(TX.parse_dense_csv(TX.read_lines(spark, f"{tmpdir_path}/training_set")))
    data = split_shuffled(rows, "row_id", 1, 0.67)
    m, metrics = train(spark, data, init_model(5, [8], seed=0), epochs=3, n_batches=4, lr0=0.05,
                       keep_prob=1.0, seed=0, eval_every=2)
    auc = {r["split"]: r["value"] for r in metrics.filter("metric = 'roc_auc' AND epoch = 2").collect()}
    assert auc["train"] > 0.8 and auc["test"] > 0.7


def test_keyed_sparse_file_train(spark, tmpdir_path):
    rng = np.random.default_rng(1)
    lines = []
    for r in range(200):
        idx = sorted(rng.choice(30, size=5, replace=False))
        lab = int(idx[0] < 6)
        lines.append(f"k{r}\t{lab} " + " ".join(f"{i}:1" for i in idx))
    _write(f"{tmpdir_path}/part-r-0", lines)
    rows = TX.good_rows(TX.parse_keyed_sparse(TX.read_lines(spark, f"{tmpdir_path}/part-r-0"), width=30))
    data = split_shuffled(rows.drop("key"), "row_id", 2, 0.67)
    m, metrics = train(spark, data, init_model(30, [6], seed=0), epochs=2, n_batches=2, lr0=0.05,
                       keep_prob=0.5, seed=0, eval_every=1, features="feats", sparse=True, input_dropout=False)
    assert metrics.filter("metric = 'roc_auc'").count() == 4


def test_auc_invariant_to_row_order(spark):
    rng = np.random.default_rng(3)
    pdf = [(int(a), float(b)) for a, b in zip(rng.integers(0, 2, 500), rng.random(500).round(3))]
    df = spark.createDataFrame(pdf, "label int, p0 double")
    a = M.roc_auc(df).first()[0]
    b = M.roc_auc(df.orderBy(F.rand(7)).repartition(5)).first()[0]
    assert a == b
