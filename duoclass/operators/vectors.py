"""Vectorised sparse-vector operators (NumPy on Arrow batches).

Densifying or de-duplicating cells needs, per row, a lookup by index, which SQL
can only write as a per-cell lambda scan (O(width x nnz), interpreted).  These
operators do the same work once per Arrow batch with sorting and scatter, map-side
(no shuffle).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from duoclass.session import ship_package

FEATS_T = "array<struct<i:int,v:double>>"


def _flat(pdf: pd.DataFrame):
    lens = np.fromiter((len(a) for a in pdf["_xi"].values), dtype=np.int64, count=len(pdf))
    if lens.sum():
        idx = np.concatenate([np.asarray(a, dtype=np.int64) for a in pdf["_xi"].values])
        val = np.concatenate([np.asarray(a, dtype=np.float64) for a in pdf["_xv"].values])
    else:
        idx, val = np.zeros(0, dtype=np.int64), np.zeros(0)
    rows = np.repeat(np.arange(len(pdf)), lens)
    return rows, idx, val


def dedupe_cells(rows: np.ndarray, idx: np.ndarray, val: np.ndarray, rule: str):
    """One cell per (row, index), ordered by (row, index).  ``last``: the value
    written last wins; ``sum``: repeated cells add up."""
    if rows.size == 0:
        return rows, idx, val
    pos = np.arange(rows.size)
    order = np.lexsort((pos, idx, rows))
    r, i, v = rows[order], idx[order], val[order]
    new = np.ones(r.size, dtype=bool)
    new[1:] = (r[1:] != r[:-1]) | (i[1:] != i[:-1])
    starts = np.flatnonzero(new)
    if rule == "sum":
        vv = np.add.reduceat(v, starts)
    elif rule == "last":
        ends = np.append(starts[1:], r.size) - 1
        vv = v[ends]
    else:
        raise ValueError(rule)
    return r[starts], i[starts], vv


def _prep(df: DataFrame, feats: str) -> DataFrame:
    return (df.withColumn("_xi", F.transform(feats, lambda f: f["i"]))
              .withColumn("_xv", F.transform(feats, lambda f: f["v"].cast("double"))))


def dedupe_frame(df: DataFrame, feats: str = "feats", rule: str = "last", out: str = "feats") -> DataFrame:
    keep = [c for c in df.columns if c not in (feats, out)]
    src = _prep(df, feats).select(*keep, "_xi", "_xv")
    schema = T.StructType([src.schema[c] for c in keep] + [
        T.StructField("_xi", T.ArrayType(T.IntegerType())), T.StructField("_xv", T.ArrayType(T.DoubleType()))])

    def fn(it):
        for pdf in it:
            rows, idx, val = _flat(pdf)
            r, i, v = dedupe_cells(rows, idx, val, rule)
            counts = np.bincount(r, minlength=len(pdf))
            cuts = np.cumsum(counts)[:-1]
            res = {c: pdf[c].values for c in keep}
            res["_xi"] = [a.astype(np.int32) for a in np.split(i, cuts)]
            res["_xv"] = np.split(v, cuts)
            yield pd.DataFrame(res)

    ship_package(df.sparkSession)
    return src.mapInPandas(fn, schema).select(
        *keep, F.arrays_zip("_xi", "_xv").cast(FEATS_T).alias(out))


def densify_frame(df: DataFrame, width: int, feats: str = "feats", rule: str = "last",
                  out: str = "features", truncate: bool = False) -> DataFrame:
    """Sparse cells -> ``ARRAY<DOUBLE>`` of ``width`` (zeros elsewhere); repeated indices
    follow ``rule``.  A cell at or beyond the width is an error unless ``truncate``
    asks for such cells to be dropped."""
    keep = [c for c in df.columns if c not in (feats, out)]
    src = _prep(df, feats).select(*keep, "_xi", "_xv")
    schema = T.StructType([src.schema[c] for c in keep] + [T.StructField(out, T.ArrayType(T.DoubleType()))])

    def fn(it):
        for pdf in it:
            rows, idx, val = _flat(pdf)
            ok = (idx >= 0) & (idx < width)
            if not truncate and not ok.all():
                raise ValueError(f"feature index {int(idx[~ok][0])} does not fit the width {width}")
            r, i, v = dedupe_cells(rows[ok], idx[ok], val[ok], rule)
            dense = np.zeros((len(pdf), width))
            dense[r, i] = v
            res = {c: pdf[c].values for c in keep}
            res[out] = list(dense)
            yield pd.DataFrame(res)

    ship_package(df.sparkSession)
    return src.mapInPandas(fn, schema)
