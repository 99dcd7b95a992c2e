"""Readers on hand-made lines (FIXTURES.md section 3) and on real text files."""

from pyspark.sql import functions as F

from duoclass.operators import encode as E
from duoclass.sources import text as TX


def lines(spark, *vals):
    return spark.createDataFrame([(v,) for v in vals], "value string")


def test_keyed_duplicate_index_last_vs_sum(spark):
    p = TX.parse_keyed_sparse(lines(spark, "k\t1 0:1.5 3:2 3:4")).first()
    assert p["ok"] and p["label"] == 1.0 and p["key"] == "k"
    df = TX.parse_keyed_sparse(lines(spark, "k\t1 0:1.5 3:2 3:4"))
    from duoclass.operators.vectors import densify_frame
    last, tot = (list(densify_frame(df.select("key", "feats"), 5, rule=r).first()["features"]) for r in ("last", "sum"))
    assert last == [1.5, 0.0, 0.0, 4.0, 0.0]
    assert tot == [1.5, 0.0, 0.0, 6.0, 0.0]


def test_multichar_label_and_quarantine(spark):
    df = TX.parse_keyed_sparse(lines(spark, "k\t-1 0:1", "k\t10 2:3", "k\tx 0:1", "k\t1 0:abc", "nokey"))
    rows = {r["value"] if "value" in r else i: r for i, r in enumerate(df.collect())}
    got = [(r["label"], r["ok"]) for r in df.collect()]
    assert got[0] == (-1.0, True) and got[1] == (10.0, True)
    assert not got[2][1] and not got[3][1] and not got[4][1]
    q = TX.quarantine_report(df).first()
    assert (q["n_rows"], q["n_ok"], q["n_bad"]) == (5, 2, 3)
    assert rows


def test_trailing_space_counts_empty_token(spark):
    df = TX.parse_keyed_sparse(lines(spark, "k\t1 0:1 "))
    r = df.first()
    assert r["ok"] and r["n_empty"] == 1 and len(r["feats"]) == 1
    assert TX.quarantine_report(df).first()["n_empty_tokens"] == 1


def test_index_beyond_width(spark):
    df = TX.parse_keyed_sparse(lines(spark, "k\t1 700:1 3:2"), width=600)
    assert not df.first()["ok"]
    t = TX.parse_keyed_sparse(lines(spark, "k\t1 700:1 3:2"), width=600, truncate=True).first()
    assert t["ok"] and [c["i"] for c in t["feats"]] == [3]


def test_all_zero_row_kept(spark):
    r = TX.parse_keyed_sparse(lines(spark, "k\t0 ")).first()
    assert r["ok"] and r["label"] == 0.0 and r["feats"] == []


def test_svmlight_zero_based_auto(spark):
    df = lines(spark, "1 0:1.0 3:2.0", "-1 2:5")
    assert TX.svmlight_base(df) == 0
    rows = TX.parse_svmlight(df).collect()
    assert [(c["i"], c["v"]) for c in rows[0]["feats"]] == [(0, 1.0), (3, 2.0)]
    one = lines(spark, "1 1:1.0 4:2.0")
    assert TX.svmlight_base(one) == 1
    assert [c["i"] for c in TX.parse_svmlight(one).first()["feats"]] == [0, 3]


def test_labels_minus_one_binarised(spark):
    df = TX.good_rows(TX.parse_svmlight(lines(spark, "-1 1:1", "1 1:2", "-1 2:1"), base=1))
    b, k = E.label_binarize(df, "label", "y")
    assert k == 2
    assert sorted((r["label"], r["y"]) for r in b.collect()) == [(-1.0, 0), (-1.0, 0), (1.0, 1)]


def test_ragged_csv_width(spark):
    raw = lines(spark, "1,2,3,0", "1,2,1", "x,1,0")
    w = E.feature_width(TX.good_rows(TX.parse_dense_csv(raw, width=None))).first()
    assert (w["n_rows"], w["min_width"], w["max_width"]) == (2, 2, 3)
    fixed = TX.parse_dense_csv(raw)  # width that most lines have: the long row is quarantined
    assert [r["ok"] for r in fixed.collect()] == [False, True, False]


def test_one_overlong_line_decides_nothing(spark):
    raw = lines(spark, *["1,2,0"] * 3, "1,2,3,0", *["3,4,1"] * 2, "", "")
    assert len(TX.good_rows(TX.parse_dense_csv(raw)).collect()) == 5
    assert TX.csv_width(raw) == 2 and TX.csv_width(lines(spark, "1,2", "1,2,3")) == 2
    assert TX.csv_width(spark.createDataFrame([], "value string")) == 0


def test_good_and_bad_rows_from_one_pass(spark):
    """Kept + bad = read; the quarantine holds the lines as they were; the source is read once."""
    raw = spark.createDataFrame([(1, "k\t1 1:2"), (2, "k\t1 x:2"), (3, None), (4, ""), (5, "k\t0 3:1 "), (6, "k\t1 9:1")], "n int, value string").repartition(3)
    reads = spark.sparkContext.accumulator(0)

    def count(it):
        for pdf in it:
            reads.add(len(pdf))
            yield pdf

    good, bad, n = TX.scan(raw.mapInPandas(count, raw.schema), lambda d: TX.parse_keyed_sparse(d, width=5))
    assert n == {"n_rows": 6, "n_ok": 2, "n_bad": 4, "n_empty_tokens": 1} and reads.value == 6
    assert sorted(r["n"] for r in good.collect()) == [1, 5] and good.columns == ["n", "key", "label", "feats", "n_empty"]
    assert sorted((r["n"], r["line"]) for r in bad.collect() if r["n"] != 3) == [(2, "k\t1 x:2"), (4, ""), (6, "k\t1 9:1")]
    none = TX.scan(spark.createDataFrame([], "value string"), lambda d: TX.parse_dense_csv(d, width=2))
    assert none[0].count() == none[1].count() == 0 and none[2]["n_rows"] == 0


def test_first_line_decides_nothing(spark):
    for first in ("", "7,1", "a,b,c,d"):
        raw = lines(spark, first, "1,2,3,0", "4,5,6,1").coalesce(1)
        kept = TX.good_rows(TX.parse_dense_csv(raw)).collect()
        assert sorted(r["features"] for r in kept) == [[1.0, 2.0, 3.0], [4.0, 5.0, 6.0]]
        q = TX.quarantine_report(TX.parse_dense_csv(raw)).first()
        assert (q["n_rows"], q["n_ok"], q["n_bad"]) == (3, 2, 1)
    wide = TX.parse_dense_csv(lines(spark, ",".join(["1"] * 5001)))
    assert len(wide.first()["features"]) == 5000 and wide.first()["ok"]


def test_token_with_two_colons_is_bad(spark):
    assert [r["ok"] for r in TX.parse_keyed_sparse(lines(spark, "k\t1 1:2:3", "k\t1 1:2", "k\t1 12")).collect()] == [False, True, False]


def test_svmlight_comments_and_query_ids(spark):
    raw = lines(spark, "# header", "1 qid:4 1:2 3:4 # tail 9:9", "", "  ", "-1 2:5#x", "0 1:2:3")
    rows = TX.parse_svmlight(raw, base=1).collect()
    got = sorted((r["label"], [(c["i"], c["v"]) for c in r["feats"]]) for r in rows if r["ok"])
    assert got == [(-1.0, [(1, 5.0)]), (1.0, [(0, 2.0), (2, 4.0)])]
    assert len(rows) == 3


def test_null_label_is_no_class(spark):
    df = spark.createDataFrame([(0,), (1,), (None,)], "l int")
    b, k = E.label_binarize(df, "l", "y")
    assert k == 2 and {(r["l"], r["y"]) for r in b.collect()} == {(0, 0), (1, 1), (None, None)}
    b, k = E.label_binarize(spark.createDataFrame([(0,), (1,), (5,), (None,)], "l int"), "l", "y")
    assert k == 3 and {r["l"]: r["y"] for r in b.collect()} == {0: [1, 0, 0], 1: [0, 1, 0], 5: [0, 0, 1], None: None}


def test_too_wide_cells_are_not_dropped_silently(spark):
    import pytest

    from duoclass.operators.vectors import densify_frame
    df = TX.parse_keyed_sparse(lines(spark, "k\t1 1:2 9:4")).select("key", "feats")
    with pytest.raises(Exception, match="does not fit"):
        densify_frame(df, 5).collect()
    assert list(densify_frame(df, 5, truncate=True).first()["features"]) == [0, 2, 0, 0, 0]


def test_vectorised_dedupe_and_densify(spark):
    from duoclass.operators.vectors import dedupe_frame, densify_frame
    df = TX.parse_keyed_sparse(lines(spark, "k\t1 0:1.5 3:2 3:4", "z\t0 ")).select("key", "feats")
    d = {r["key"]: r["features"] for r in densify_frame(df, 5, rule="last").collect()}
    assert d["k"] == [1.5, 0.0, 0.0, 4.0, 0.0] and d["z"] == [0.0] * 5
    s = {r["key"]: r["features"] for r in densify_frame(df, 5, rule="sum").collect()}
    assert s["k"] == [1.5, 0.0, 0.0, 6.0, 0.0]
    u = {r["key"]: [(c["i"], c["v"]) for c in r["feats"]] for r in dedupe_frame(df, rule="last").collect()}
    assert u == {"k": [(0, 1.5), (3, 4.0)], "z": []}


def test_onehot_tokens(spark):
    r = TX.parse_onehot_tokens(lines(spark, "1 a3 b7 c0"), 4).first()
    assert r["label"] == 1.0 and r["features"] == [1, 3, 7, 0]


def test_read_lines_row_id_in_file_order(spark, tmpdir_path):
    path = f"{tmpdir_path}/train.txt"
    with open(path, "w") as f:
        for i in range(1000):
            f.write(f"{i},{i * 2},1\n")
    df = TX.read_lines(spark, path)
    got = sorted((r["row_id"], r["value"]) for r in df.collect())
    assert [g[0] for g in got] == list(range(1000))
    assert all(int(v.split(",")[0]) == rid for rid, v in got)


def test_dense_csv_from_file(spark, tmpdir_path):
    path = f"{tmpdir_path}/d.csv"
    with open(path, "w") as f:
        f.write("0.5,1.5,1\n2,3,0\n")
    df = TX.good_rows(TX.parse_dense_csv(TX.read_lines(spark, path)))
    rows = sorted((r["row_id"], r["label"], r["features"]) for r in df.collect())
    assert rows == [(0, 1.0, [0.5, 1.5]), (1, 0.0, [2.0, 3.0])]


def test_row_id_follows_path_order_across_files(spark, tmpdir_path):
    """Part files of different sizes: ids run through part-0, part-1, part-2 in order,
    although the scan packs the largest split first."""
    import os
    d = f"{tmpdir_path}/parts"
    os.makedirs(d)
    sizes = [5, 4000, 300]
    k = 0
    for p, n in enumerate(sizes):
        with open(f"{d}/part-{p}", "w") as f:
            for _ in range(n):
                f.write(f"{k},1\n")
                k += 1
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        df = TX.read_lines(spark, d)
        got = sorted((r["row_id"], int(r["value"].split(",")[0])) for r in df.collect())
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [g[0] for g in got] == list(range(sum(sizes)))
    assert all(rid == k for rid, k in got)


def test_dedupe_truncate_and_targets(spark):
    from duoclass.operators.vectors import dedupe_frame
    df = TX.parse_keyed_sparse(lines(spark, "k\t1 4:1 0:2 4:3 9:1", "z\t0 ")).select("key", "feats")
    for rule, four in (("last", 3.0), ("sum", 4.0)):
        vec = {r["key"]: [(c["i"], c["v"]) for c in r["feats"]] for r in dedupe_frame(df, rule=rule).collect()}
        assert vec == {"k": [(0, 2.0), (4, four), (9, 1.0)], "z": []}
    t = df.select("key", E.truncate_feats(F.col("feats"), 5).alias("t")).collect()
    assert {r["key"]: [c["i"] for c in r["t"]] for r in t} == {"k": [4, 0, 4], "z": []}
    dense = spark.createDataFrame([([1.0, 2.0, 3.0],)], "f array<double>")
    assert dense.select(E.truncate_dense(F.col("f"), 2)).first()[0] == [1.0, 2.0]
    lab = spark.createDataFrame([(1,), (0,)], "l int")
    assert [r[0] for r in lab.select(E.labels_for_model(F.col("l"), 2)).collect()] == [[1.0, 0.0], [0.0, 1.0]]
    assert [r[0] for r in lab.select(E.labels_for_model(F.col("l"), 1)).collect()] == [1, 0]
