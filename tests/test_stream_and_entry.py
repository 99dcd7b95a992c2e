"""Stream counters equal the batch result; driver contract; oracle agreement on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from duoclass.streaming.counters import run_confusion_stream
from tests.conftest import SF001

ALL_ORACLES = sorted(E.oracle_sql())


def test_entry_one_row(spark):
    rows = E.entry(spark).collect()
    assert len(rows) == 1 and rows[0]["n_rows"] == 500
    assert set(E.oracle_sql()) <= set(E.queries())


def test_stream_equals_batch(spark):
    got = {(r["truth"], r["pred"]): r["n"] for r in run_confusion_stream(spark, SF001).collect()}
    con = duckdb.connect()
    exp = con.execute(f"""SELECT CASE WHEN event_type='purchase' THEN 1 ELSE 0 END,
        CASE WHEN value > 100 THEN 1 ELSE 0 END, count(*) FROM '{SF001}/events.parquet' GROUP BY 1, 2""").fetchall()
    assert got == {(a, b): c for a, b, c in exp}


@pytest.mark.parametrize("name", ALL_ORACLES)
def test_oracle_agreement(spark, name):
    from tools.oracle_check import digest, duck
    df = E.queries()[name](spark, SF001)
    rows = [tuple(r) for r in df.collect()]
    cur = duck(SF001).execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    orows = cur.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert digest(df.columns, rows)[0] == digest(ocols, orows)[0]


def test_stream_state_accumulates_over_micro_batches(spark, tmpdir_path):
    """Three files, one per trigger: the counters carry over between micro-batches."""
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    src = f"{tmpdir_path}/events_in"
    for k in range(3):
        ev.filter(f"event_id % 3 = {k}").coalesce(1).write.parquet(f"{src}/part{k}")
    import glob
    import shutil
    flat = f"{tmpdir_path}/flat"
    import os
    os.makedirs(flat)
    for k, f in enumerate(sorted(glob.glob(f"{src}/part*/*.parquet"))):
        shutil.copy(f, f"{flat}/events-{k}.parquet")
    got = {(r["truth"], r["pred"]): r["n"]
           for r in run_confusion_stream(spark, flat, file_glob="events-*.parquet").collect()}
    exp = {(r["t"], r["p"]): r["n"] for r in ev.selectExpr(
        "CAST(event_type = 'purchase' AS INT) AS t", "CAST(coalesce(value > 100, false) AS INT) AS p")
        .groupBy("t", "p").count().withColumnRenamed("count", "n").collect()}
    assert got == exp


def test_entry_from_another_directory_with_default_session(tmpdir_path):
    """The driver's way: a plain SparkSession, started elsewhere; workers must still
    import the package (shipped with addPyFile)."""
    import os
    import subprocess
    import sys
    repo = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        "import importlib.util\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false').getOrCreate()\n"
        f"spec = importlib.util.spec_from_file_location('se', '{repo}/__spark_entry__.py')\n"
        "m = importlib.util.module_from_spec(spec); spec.loader.exec_module(m)\n"
        "rows = m.entry(s).collect()\n"
        "print('ROWS', len(rows), rows[0]['n_rows'])\n"
    )
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-c", code], cwd=tmpdir_path, env=env, capture_output=True,
                         text=True, timeout=600)
    assert "ROWS 1 500" in out.stdout, out.stderr[-2000:]
