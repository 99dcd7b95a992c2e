"""Exact global index, splits and batches (edge semantics and partition-proofness)."""

import hashlib

from pyspark.sql import functions as F

from duoclass.operators.ordering import (minibatches, ordered_index, row_slice, shuffled_index,
                                         split_bounds, split_shuffled)


def test_split_edges():
    assert split_bounds(15000, 0.67, True) == (0, 10049, 10050, 14999)
    a, b, c, d = split_bounds(15000, 0.67, False)
    assert (b - a, d - c) == (10050, 4950)


def test_shuffled_index_matches_md5_order(spark):
    df = spark.range(3000).withColumnRenamed("id", "k")
    got = {r["k"]: r["ix"] for r in shuffled_index(df, "k", 7, "ix", rows_per_bucket=100).collect()}
    order = sorted(range(3000), key=lambda k: (hashlib.md5(f"7:{k}".encode()).hexdigest(), k))
    assert got == {k: i for i, k in enumerate(order)}


def test_index_same_for_any_partitioning(spark):
    base = spark.range(2000).withColumnRenamed("id", "k")
    outs = []
    for p in (1, 4, 16):
        df = base.repartition(p)
        outs.append(sorted((r["k"], r["ix"]) for r in shuffled_index(df, "k", 3, "ix").collect()))
        outs.append(sorted((r["k"], r["ix"]) for r in ordered_index(df, "k", "ix").collect()))
    assert all(o == outs[0] for o in outs[0::2]) and all(o == outs[1] for o in outs[1::2])
    assert [ix for _, ix in outs[1]] == list(range(2000))


def test_split_counts_orders(spark):
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey")
    s = split_shuffled(o, "o_orderkey", 42, 0.67, drop_edges=True)
    c = {r["split"]: r["count"] for r in s.groupBy("split").count().collect()}
    assert c == {"train": 10049, "test": 4949}
    e = split_shuffled(o, "o_orderkey", 42, 0.67, drop_edges=False)
    c = {r["split"]: r["count"] for r in e.groupBy("split").count().collect()}
    assert c == {"train": 10050, "test": 4950}


def test_short_batches(spark):
    df = spark.range(100).withColumnRenamed("id", "ix")
    b = minibatches(df, 40, short=True)
    assert sorted(r["count"] for r in b.groupBy("batch").count().collect()) == [39, 39]
    f = minibatches(df, 40, short=False)
    assert sorted(r["count"] for r in f.groupBy("batch").count().collect()) == [40, 40]


def test_row_slice_overrun_runs_to_end(spark):
    df = spark.range(10).withColumnRenamed("id", "ix")
    assert row_slice(df, 7, 5).count() == 3
    assert row_slice(df, 2, -1).count() == 8
    assert [r["row"] for r in row_slice(df, 2, 3).orderBy("ix").collect()] == [0, 1, 2]
    assert row_slice(df, 0, 4).agg(F.max("ix")).first()[0] == 3


def test_ordered_index_many_buckets(spark):
    """Quantile buckets (about 100 rows each) still give the exact key order."""
    df = spark.range(2000).select((F.col("id") * 7 % 2000 * 3 + 11).alias("k")).repartition(6)
    got = sorted((r["k"], r["ix"]) for r in ordered_index(df, "k", "ix", rows_per_bucket=100).collect())
    assert [ix for _, ix in got] == list(range(2000))


def test_first_rows_exact(spark):
    from duoclass.operators.ordering import first_rows
    df = spark.range(5000).select(((F.col("id") * 7919) % 5000 * 2 + 1).alias("k")).repartition(5)
    for n in (1, 37, 1000, 4999, 6000):
        got = sorted(r["k"] for r in first_rows(df, "k", n).collect())
        assert got == [2 * i + 1 for i in range(min(n, 5000))]


def test_fast_split_equals_indexed_split(spark):
    from duoclass.operators.ordering import split_shuffled_fast
    o = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select("o_orderkey")
    for drop in (True, False):
        for rpb in (2_000_000, 500):  # one hex digit of buckets, and many buckets
            ref = {r["o_orderkey"]: r["split"] for r in split_shuffled(o, "o_orderkey", 42, 0.67, drop).collect()}
            got = {r["o_orderkey"]: r["split"] for r in
                   split_shuffled_fast(o, "o_orderkey", 42, 0.67, drop, rows_per_bucket=rpb).collect()}
            assert got == ref


def test_fast_split_tiny_inputs(spark):
    from duoclass.operators.ordering import split_shuffled_fast
    for n in (1, 2, 3, 5, 12):
        df = spark.range(n).withColumnRenamed("id", "k")
        for drop in (True, False):
            ref = sorted((r["k"], r["split"]) for r in split_shuffled(df, "k", 9, 0.67, drop).collect())
            got = sorted((r["k"], r["split"]) for r in split_shuffled_fast(df, "k", 9, 0.67, drop).collect())
            assert got == ref, (n, drop)


def test_first_rows_double_key(spark):
    from duoclass.operators.ordering import first_rows
    df = spark.range(3000).select((F.col("id").cast("double") / F.lit(7.0)).alias("k"))
    got = sorted(r["k"] for r in first_rows(df, "k", 250).collect())
    assert got == [i / 7.0 for i in range(250)]


def test_rows_without_a_key_come_last(spark):
    from duoclass.operators.ordering import ordered_index, shuffled_index, split_shuffled, split_shuffled_fast
    df = spark.createDataFrame([(None if i % 10 == 0 else i,) for i in range(1000)], "k long").repartition(4)
    for ix in (ordered_index(df, "k"), shuffled_index(df, "k", 3)):
        rows = ix.collect()
        assert sorted(r["ix"] for r in rows) == list(range(1000))
        assert {r["ix"] for r in rows if r["k"] is None} == set(range(900, 1000))
    a = sorted(r["split"] for r in split_shuffled(df, "k", 3).collect())
    assert a == sorted(r["split"] for r in split_shuffled_fast(df, "k", 3).collect()) and len(a) == 1000


def test_plans_have_no_nested_loop_and_rank_rows_in_buckets(spark):
    """Only tables of one row per bucket may meet in a single partition."""
    import __spark_entry__ as E
    from tests.conftest import SF01
    from tests.test_plans import plan as executed_plan
    q = E.queries()
    for name in ("sparse_triples", "csr_triples", "row_slice", "zero_ratio_filter", "split_ordered", "minibatch_sequential",
                 "row_cap", "seeded_shuffle", "split_shuffled"):
        plan = executed_plan(q[name](spark, SF01))
        assert "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan, name
        # what meets in one partition are the buckets' counts, never rows
        lines = plan.splitlines()
        for at, line in enumerate(lines):
            if "SinglePartition" in line:
                assert "HashAggregate(keys=[_b#" in lines[at + 1] and "functions=[count(1)]" in lines[at + 1], name
        assert "row_number() windowspecdefinition(_b#" in plan, name


def test_row_cap_sketch_is_bounded(spark):
    """The cap's quantile keeps a sketch whose size its error fixes, not the table's."""
    import duoclass.operators.ordering as O
    assert O.SKETCH_ERROR >= 1e-4
    df = spark.range(200_000).select((200_000 - F.col("id")).alias("k"))
    for n in (1, 37, 5000, 199_999):
        got = [(r["k"], r["ix"]) for r in O.first_rows(df, "k", n).collect()]
        assert sorted(got) == [(i + 1, i) for i in range(n)]


def test_quantile_sketch_has_a_fixed_size(spark):
    """Cut points come from a sketch whose size doesn't grow with the rows, near the true ranks."""
    from duoclass.operators.ordering import quantile_cuts, quantile_sketch
    size = []
    for n in (20_000, 400_000):
        df = spark.range(0, n, 1, 8).select(F.xxhash64("id").cast("double").alias("x"))
        size.append(len(quantile_sketch(df, "x", 1024).first()["sketch"]))
        cuts = quantile_cuts(df, "x", 50)
        assert len(cuts) == 49 and cuts == sorted(cuts)
        below = df.agg(*[F.avg((F.col("x") <= c).cast("double")) for c in cuts]).first()
        assert max(abs(b - (i + 1) / 50) for i, b in enumerate(below)) < 0.01
    assert size[1] < 1.3 * size[0] < 200_000
    odd = spark.createDataFrame([(None,), (float("nan"),), (2.0,), (2.0,)], "x double")
    assert quantile_cuts(odd, "x", 4) == [2.0] and quantile_cuts(odd.where("x > 5"), "x", 4) == [] and quantile_cuts(odd, "x", 1) == []
