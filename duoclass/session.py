"""Session helpers: sane defaults for local runs and the shared checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import SparkSession

# Upper bound (in 8-byte cells) for anything shipped to executors inside a task
# closure or as a broadcast side.  Model parameters, moments and offset tables are
# checked against it; beyond it the relational (shuffle) form is used instead.
MAX_BROADCAST_CELLS = 8_000_000

# Bound (in 8-byte cells, 1 GB) for a model: its arrays are on the driver before they
# are sent, so this is what a driver and its executors are asked to hold.
MAX_MODEL_CELLS = 128_000_000


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``duoclass`` importable in Python workers on every executor.

    Task closures refer to the package's functions by module name, so executors
    must be able to import it.  The package is zipped once per SparkContext and
    distributed with ``addPyFile`` (Spark's own file distribution).
    """
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    fd, path = tempfile.mkstemp(prefix="duoclass-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as zf:
        for root, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    zf.write(full, os.path.relpath(full, os.path.dirname(pkg_dir)))
    sc.addPyFile(path)
    _SHIPPED.add(key)


def _driver_memory() -> str:
    """Local mode runs everything in the driver JVM: give it 60% of the machine's
    memory, at most 16 GB, so a small box is not over-committed."""
    try:
        with open("/proc/meminfo") as f:
            kb = next(int(l.split()[1]) for l in f if l.startswith("MemTotal:"))
        mb = int(kb / 1024 * 0.6)
    except (OSError, StopIteration, ValueError):
        mb = 4096
    return f"{max(1024, min(16 * 1024, mb))}m"


def get_session(master: str | None = None, app: str = "duoclass",
                shuffle_partitions: int | None = None, **extra: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    conf = {
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": _driver_memory(),
    }
    if shuffle_partitions:
        conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra)
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_root(spark)
    ship_package(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``.

    On a cluster the setting must exist (a machine-local folder would not survive
    the loss of an executor).  Only in local mode, where it is unset, a fresh
    folder under /tmp is created and registered on the session.
    """
    sc = spark.sparkContext
    d = None
    try:
        d = spark.conf.get("spark.checkpoint.dir", None)
    except Exception:  # pragma: no cover - conf access differs in some deployments
        d = None
    if not d:
        d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        d = sc.getCheckpointDir()
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a shared folder on a cluster")
        d = tempfile.mkdtemp(prefix="duoclass-ckpt-", dir="/tmp")
        try:
            spark.conf.set("spark.checkpoint.dir", d)
        except Exception:
            pass
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(d)
    return d.rstrip("/")


def scratch_path(spark: SparkSession, *parts: str) -> str:
    """A path below the checkpoint root for tables written by a job."""
    return os.path.join(checkpoint_root(spark), *parts)


def written(df, *parts: str):
    """Write ``df`` below the checkpoint root and read it back (``written_path`` holds the
    place): cuts the lineage with shared storage instead of executor-local blocks."""
    path = scratch_path(df.sparkSession, *parts, uuid.uuid4().hex[:12])
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a table below the checkpoint root that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def reliable_checkpoint(df):
    """``df.checkpoint()`` into the shared checkpoint folder (never a local one):
    materialises once, cuts the lineage, and survives the loss of an executor."""
    checkpoint_root(df.sparkSession)
    return df.checkpoint(eager=True)


def share(df, value, handles: list | None = None):
    """A broadcast variable for model-sized values read by every task (sent once
    per executor, not once per task inside the pickled closure).  Callers check
    the size first; ``handles`` collects it for :func:`release`."""
    b = df.sparkSession.sparkContext.broadcast(value)
    if handles is not None:
        handles.append(b)
    return b


def release(handles: list) -> None:
    """Drop broadcast copies on the executors once the job that used them is done."""
    for b in handles:
        try:
            b.unpersist()
        except Exception:  # pragma: no cover - best effort cleanup
            pass
    handles.clear()
