"""Versioned tables on Parquet: the save / restore / export surface of models.

    <root>/model=<name>/version=<v>/run=<id>/part-*.parquet   data of one save
    <root>/model=<name>/_commits/<v>                           its manifest
    <root>/model=<name>/checkpoint                             pointer to the version saved last

A save writes its data to a folder of its own, then the manifest, then the pointer; each of
the two small files is written beside its place and renamed over it, so a reader sees the
old or the new one.  Readers go by the manifests: a save that stopped half-way isn't seen,
and saving a version again leaves readers the earlier data until the new manifest is there.

The pointer holds two lines, ``model_checkpoint_path: "<version>"`` and
``all_model_checkpoint_paths: "<version>"``.  Networks are stored cell by cell as (tag,
layer, name, i, j, value), forests node by node (``operators.forest``).
"""

from __future__ import annotations

import json
import os
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duoclass.operators.model import Model

PARAM_SCHEMA = T.StructType([
    T.StructField("tag", T.StringType()),
    T.StructField("layer", T.IntegerType()),
    T.StructField("name", T.StringType()),
    T.StructField("i", T.IntegerType()),
    T.StructField("j", T.IntegerType()),
    T.StructField("value", T.DoubleType()),
])
POINTER = "checkpoint"
_POINTER_KEYS = ("model_checkpoint_path", "all_model_checkpoint_paths")


# ---- small files -----------------------------------------------------------

def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read_small(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def _replace_small(spark: SparkSession, path: str, text: str) -> None:
    """Write beside ``path`` and rename over it (one atomic step of the file system)."""
    jvm = spark._jvm
    folder, name = os.path.split(path)
    fs, fresh = _fs(spark, f"{folder}/.{name}.{uuid.uuid4().hex}")
    stream = fs.create(fresh, True)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration())
    how = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    how[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(fs.makeQualified(fresh), fs.makeQualified(jvm.org.apache.hadoop.fs.Path(path)), how)


def parse_pointer(lines: DataFrame) -> DataFrame:
    """(key, value) of a pointer file's lines (a ``value`` column of ``key: "value"`` texts).

    Lines of another form are left out; a quoted value may hold any character but a quote.
    """
    form = r'^\s*(\w+)\s*:\s*"([^"]*)"\s*$'
    return (lines.where(F.col("value").rlike(form))
            .select(F.regexp_extract("value", form, 1).alias("key"), F.regexp_extract("value", form, 2).alias("value")))


def read_pointer(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """A pointer file (this store's or another tool's of the same two-line form)."""
    out: dict[str, list[str]] = {}
    for r in parse_pointer(spark.read.text(path)).collect():
        out.setdefault(r["key"], []).append(r["value"])
    return out


# ---- versions --------------------------------------------------------------

def _model_dir(root: str, model_name: str) -> str:
    return f"{root.rstrip('/')}/model={model_name}"


def stage_table(df: DataFrame, root: str, model_name: str, version: int) -> tuple[str, str]:
    """Write the data of a version without committing it; (run id, path)."""
    run = uuid.uuid4().hex[:12]
    path = f"{_model_dir(root, model_name)}/version={int(version)}/run={run}"
    df.write.parquet(path)
    return run, path


def commit_version(spark: SparkSession, root: str, model_name: str, version: int, run: str) -> None:
    """Manifest of a staged version (with its row count, read from the files), then pointer."""
    path = f"{_model_dir(root, model_name)}/version={int(version)}/run={run}"
    n = spark.read.parquet(path).count()
    fs, folder = _fs(spark, f"{_model_dir(root, model_name)}/_commits")
    fs.mkdirs(folder)
    _replace_small(spark, f"{_model_dir(root, model_name)}/_commits/{int(version)}",
                   json.dumps({"version": int(version), "run": run, "rows": n}))
    _replace_small(spark, f"{_model_dir(root, model_name)}/{POINTER}", "".join(f'{k}: "{int(version)}"\n' for k in _POINTER_KEYS))


def save_table(df: DataFrame, root: str, model_name: str, version: int) -> str:
    """Write and commit one version (other versions stay)."""
    run, path = stage_table(df, root, model_name, version)
    commit_version(df.sparkSession, root, model_name, version, run)
    return path


def committed_versions(spark: SparkSession, root: str, model_name: str) -> dict[int, dict]:
    """Manifests by version."""
    fs, folder = _fs(spark, f"{_model_dir(root, model_name)}/_commits")
    if not fs.exists(folder):
        return {}
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = [json.loads(_read_small(spark, f"{_model_dir(root, model_name)}/_commits/{n}")) for n in names if n.isdigit()]
    return {m["version"]: m for m in found}


def latest_version(spark: SparkSession, root: str, model_name: str) -> int:
    """The version that the pointer names; without a pointer, the highest committed one."""
    done = committed_versions(spark, root, model_name)
    path = f"{_model_dir(root, model_name)}/{POINTER}"
    fs, p = _fs(spark, path)
    if fs.exists(p):
        named = read_pointer(spark, path).get(_POINTER_KEYS[0], [""])[0]
        if named.isdigit() and int(named) in done:
            return int(named)
    if not done:
        raise FileNotFoundError(f"no saved version of model {model_name!r} under {root}")
    return max(done)


def load_table(spark: SparkSession, root: str, model_name: str, version: int | None = None) -> DataFrame:
    """A committed version's rows with ``model`` and ``version``."""
    v = latest_version(spark, root, model_name) if version is None else int(version)
    m = committed_versions(spark, root, model_name).get(v)
    if m is None:
        raise FileNotFoundError(f"version {v} of model {model_name!r} isn't saved under {root}")
    return (spark.read.parquet(f"{_model_dir(root, model_name)}/version={v}/run={m['run']}")
            .select("*", F.lit(model_name).alias("model"), F.lit(v).alias("version")))


# ---- networks --------------------------------------------------------------

def params_frame(spark: SparkSession, model: Model, tag: str = "tag", with_slots: bool = True) -> DataFrame:
    rows = model.to_rows(with_slots)
    pdf = pd.DataFrame(rows, columns=["layer", "name", "i", "j", "value"])
    pdf.insert(0, "tag", tag)
    pdf = pdf.astype({"layer": "int32", "i": "int32", "j": "int32", "value": "float64"})
    return spark.createDataFrame(pdf, schema=PARAM_SCHEMA)


def save_params(spark: SparkSession, model: Model, root: str, model_name: str, version: int,
                tag: str = "tag", with_slots: bool = True) -> str:
    """Save a model that the driver holds."""
    return save_table(params_frame(spark, model, tag, with_slots), root, model_name, version)


def state_cells(state: DataFrame, model: Model, tag: str = "tag") -> DataFrame:
    """An optimiser's state table (``operators.optimizer``) as parameter rows, slots included."""
    from duoclass.operators.optimizer import cells

    parts = [cells(state, c).withColumn("name", F.concat(F.lit(prefix), "name")) for c, prefix in (("value", ""), ("m", "m:"), ("v", "v:"))]
    scalars = state.sparkSession.createDataFrame([(0, "global_step", 0, 0, float(model.global_step)), (0, "eps", 0, 0, float(model.eps))],
                                                 "layer int, name string, i int, j int, value double")
    whole = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(scalars)
    return whole.select(F.lit(tag).alias("tag"), "layer", "name", "i", "j", "value")


def save_state(spark: SparkSession, state: DataFrame, model: Model, root: str, model_name: str, version: int,
               tag: str = "tag") -> str:
    """Save a state table as a version: its cells go from table to table, not by the driver."""
    return save_table(state_cells(state, model, tag), root, model_name, version)


def load_params_frame(spark: SparkSession, root: str, model_name: str, version: int | None = None,
                      tag: str | None = None) -> DataFrame:
    df = load_table(spark, root, model_name, version)
    return df if tag is None else df.filter(F.col("tag") == tag)


def load_model(spark: SparkSession, root: str, model_name: str, version: int | None = None,
               tag: str | None = None) -> Model:
    """Restore a model; only the parameter rows (model-sized) come to the driver."""
    rows = load_params_frame(spark, root, model_name, version, tag).select(
        "layer", "name", "i", "j", "value").collect()
    return Model.from_rows(rows)
