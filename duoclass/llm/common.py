"""Shared helpers: Arrow stages, byte blocks of a text column, written cuts."""

from __future__ import annotations

import ctypes
import gc
import math
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclass.session import checkpoint_root, ship_package

# Rows of one Arrow batch handed to a Python worker.  Documents are kilobytes long,
# so this keeps a batch in the tens of megabytes; long documents are cut into byte
# blocks by the stages themselves.
BATCH_ROWS = 1000

# Most rows of an id list that is broadcast (16 bytes a row, so 16 MB at most).
BROADCAST_IDS = 1_000_000

# Rows of one file of a table whose size is known before it is written.
FILE_ROWS = 500_000


def prepare(spark: SparkSession) -> None:
    """Ship the package and bound the Arrow batches of this session."""
    ship_package(spark)
    checkpoint_root(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, table: str, *cols: str) -> DataFrame:
    """The named columns of a table (others, whatever their names, are not read)."""
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").select(*cols)


def cut(df: DataFrame, what: str, rows: int | None = None) -> DataFrame:
    """Write ``df`` as a table below the shared checkpoint folder and read it back:
    cuts the lineage and survives the loss of an executor.

    ``rows``, where it is known, sizes the files (``FILE_ROWS`` each), so that a small
    table isn't written as one file for each shuffle partition.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(1, math.ceil(rows / FILE_ROWS)))
    path = f"{checkpoint_root(spark)}/llm-{what}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._llm_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table behind a :func:`cut` that nothing reads any more."""
    path = getattr(df, "_llm_path", None)
    if path:
        jvm = df.sparkSession._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(p, True)


def shuffle_partitions(spark: SparkSession, n_bytes: float, per_task: int) -> int:
    """Tasks for ``n_bytes``, never fewer than the session's own setting."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(n_bytes / per_task))


def small_or_shuffled(ids: DataFrame, n_rows: int) -> DataFrame:
    """Broadcast hint behind a check of the counted size; a shuffle join beyond it."""
    return F.broadcast(ids) if n_rows <= BROADCAST_IDS else ids


def as_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(data, offsets) of a text column in UTF-8; a null text is empty."""
    if pa.types.is_string(col.type) or pa.types.is_large_string(col.type):
        col = pc.fill_null(col, "").cast(pa.large_string()).cast(pa.large_binary())
    else:
        col = pc.fill_null(col, b"").cast(pa.large_binary())
    _, off, data = col.buffers()
    o = np.frombuffer(off, np.int64)[col.offset:col.offset + len(col) + 1]
    d = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return d, o


def batch_of(names: list[str], *cols) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in cols], names=names)


# What a worker keeps between tasks (a model with its cache): one operator's at a time, as
# Spark reuses its Python workers from stage to stage.
_STATE: dict[str, object] = {}


def worker_state(key: str, make):
    """The state under ``key``, made on first use; any other is let go."""
    if key not in _STATE:
        no_state()
        _STATE[key] = make()
    return _STATE[key]


def no_state() -> None:
    """A stage without a state of its own lets go of what an earlier one kept, and gives
    the memory back: workers are reused from stage to stage."""
    if _STATE:
        _STATE.clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)   # where the C library has it
        if trim:
            trim(0)


# Rolling 64-bit hashes: byte values from a fixed random table, powers of an odd base.
_RNG = np.random.default_rng(20240229)
BYTE_HASH = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_HASH2 = _RNG.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_POW: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2^64, at least ``n`` of them."""
    if not _POW or len(_POW[0]) < n:
        size = 1 << max(16, (n - 1).bit_length())
        made = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            a = np.full(size, base, np.uint64)
            a[0] = 1
            made.append(np.multiply.accumulate(a))
        _POW[:] = made
    return _POW[0], _POW[1]


def prefix_sums(values: np.ndarray) -> np.ndarray:
    """P with P[j] - P[i] = sum of values[i:j] * base^position (mod 2^64)."""
    p = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * powers(len(values) + 1)[0][:len(values)], out=p[1:])
    return p


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xC2B2AE3D27D4EB4F)
    h ^= h >> np.uint64(32)
    return h
