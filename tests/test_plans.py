"""Plan-shape guards: the scale properties checked with explain() stay true."""

import __spark_entry__ as E
from tests.conftest import SF001, SF01


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def scan_schemas(df) -> list[str]:
    txt = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in txt.splitlines() if "FileScan parquet" in line]


def test_scoring_is_map_only(spark):
    p = plan(E.queries()["score_mlp2"](spark, SF001))
    assert "MapInPandas" in p and "Exchange" not in p


def test_csv_scan_prunes_columns(spark):
    scans = scan_schemas(E.queries()["dense_csv_scan"](spark, SF001))
    assert scans and all("l_partkey" not in s and "l_shipdate" not in s for s in scans)


def test_row_cap_threshold_reaches_scan(spark):
    # sf0.01: more orders than the cap, so the threshold path is taken
    scans = scan_schemas(E.queries()["row_cap"](spark, SF01))
    assert any("LessThanOrEqual(o_orderkey" in s for s in scans)


def test_confusion_never_reads_document_text(spark):
    scans = scan_schemas(E.queries()["confusion"](spark, SF001))
    doc = [s for s in scans if "documents" in s]
    assert doc and all("text" not in s.split("ReadSchema")[-1] for s in doc)


def test_shuffle_offsets_are_broadcast(spark):
    p = plan(E.queries()["seeded_shuffle"](spark, SF001))
    assert "BroadcastExchange" in p or "BroadcastHashJoin" in p


def test_auc_ranks_scores_in_buckets(spark):
    """No nested-loop join and no window over all scores, however few scores there are."""
    q = E.queries()
    for name in ("roc_auc", "roc_auc_macro", "metric_report"):
        p = plan(q[name](spark, SF001))
        assert "BroadcastNestedLoopJoin" not in p and "CartesianProduct" not in p, name
        assert "_b#" in p and "windowspecdefinition(_b#" in p or "_b#" in p.split("windowspecdefinition(")[1], name


def test_gradient_blocks_follow_the_model_not_the_rows(spark):
    """A partial sum travels as one row per block of matrix rows."""
    import numpy as np

    from duoclass.operators.training import BLOCK_ROWS, _add_blocks, _block_rows
    a = np.arange(3 * BLOCK_ROWS * 5, dtype=float).reshape(-1, 5)
    pdf = _block_rows({"A": a, "s": np.array([[1.0, 2.0]])})
    assert len(pdf) == 4
    twice = list(_add_blocks(iter([pdf, pdf])))[0]
    got = {(r.key, r.block): np.frombuffer(r.data) for r in twice.itertuples()}
    assert (pdf.part == 0).all() and len(pdf.rows[0]) == BLOCK_ROWS - 0
    assert np.allclose(got["A", 1], 2 * a[BLOCK_ROWS:2 * BLOCK_ROWS].ravel()) and list(got["s", 0]) == [2.0, 4.0]
