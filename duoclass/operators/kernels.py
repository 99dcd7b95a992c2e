"""NumPy kernels that run inside Arrow batches on executors.

Only forward/backward algebra lives here; the Spark side decides which rows meet
in a batch, how partial results are summed and what is broadcast.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from duoclass.functions.hashing import mix_uniform_np, mix_uniform_pairs_np
from duoclass.operators.model import Model

# Inputs and units of the rows that a kernel works on at once; several arrays of that size
# are alive in a pass, so an Arrow batch of wide rows is taken in slices.
SLICE_CELLS = 1_000_000


class Inputs:
    """A batch of examples, dense (n x d) or sparse (index / value arrays per row)."""

    def __init__(self, n: int, d: int, dense: np.ndarray | None = None,
                 rows: np.ndarray | None = None, idx: np.ndarray | None = None,
                 val: np.ndarray | None = None):
        self.n, self.d = n, d
        self.dense, self.rows, self.idx, self.val = dense, rows, idx, val

    @staticmethod
    def from_dense(series: pd.Series, d: int) -> "Inputs":
        n = len(series)
        if n == 0:
            return Inputs(0, d, dense=np.zeros((0, d)))
        lens = np.fromiter((len(v) for v in series.values), dtype=np.int64, count=n)
        if (lens != d).any():
            raise ValueError(f"feature width {int(lens[lens != d][0])} does not match the model's {d}")
        X = np.concatenate(series.values).astype(np.float64, copy=False).reshape(n, d)
        return Inputs(n, d, dense=X)

    @staticmethod
    def from_sparse(idx_series: pd.Series, val_series: pd.Series, d: int, truncate: bool = False) -> "Inputs":
        """Cells at or beyond the width are an error, like a dense row of another width;
        ``truncate`` drops them instead."""
        n = len(idx_series)
        lens = np.fromiter((len(a) for a in idx_series.values), dtype=np.int64, count=n)
        idx = (np.concatenate([np.asarray(a, dtype=np.int64) for a in idx_series.values])
               if n and lens.sum() else np.zeros(0, dtype=np.int64))
        val = (np.concatenate([np.asarray(a, dtype=np.float64) for a in val_series.values])
               if n and lens.sum() else np.zeros(0))
        keep = (idx >= 0) & (idx < d)
        if not truncate and not keep.all():
            raise ValueError(f"feature index {int(idx[~keep][0])} does not fit the model's width {d}")
        rows = np.repeat(np.arange(n), lens)
        return Inputs(n, d, rows=rows[keep], idx=idx[keep], val=val[keep])

    @staticmethod
    def _segment_sum(keys: np.ndarray, vals: np.ndarray, size: int) -> np.ndarray:
        """Sum rows of ``vals`` by ``keys`` (sorted ascending) into ``size`` slots."""
        out = np.zeros((size, vals.shape[1]))
        if keys.size:
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
            out[keys[starts]] = np.add.reduceat(vals, starts, axis=0)
        return out

    def matmul(self, W: np.ndarray) -> np.ndarray:
        if self.dense is not None:
            return self.dense @ W
        # cells of a row are contiguous, so rows are already sorted
        return self._segment_sum(self.rows, W[self.idx] * self.val[:, None], self.n)

    def t_matmul(self, D: np.ndarray) -> np.ndarray:
        """X^T D (d x k)."""
        if self.dense is not None:
            return self.dense.T @ D
        order = np.argsort(self.idx, kind="stable")
        return self._segment_sum(self.idx[order], (D[self.rows] * self.val[:, None])[order], self.d)

    def dropped(self, seed: int, step: int, row_ids: np.ndarray, keep: float) -> "Inputs":
        """Input-layer dropout.  Sparse rows draw the mask only at stored cells (a
        dense n x d mask would not fit for wide sparse data); the values are the
        same as the dense mask's at those cells."""
        if self.dense is not None:
            return Inputs(self.n, self.d, dense=self.dense * dropout_mask(seed, step, 0, row_ids, self.d, keep))
        u = mix_uniform_pairs_np(seed, step * 16, np.asarray(row_ids, dtype=np.int64)[self.rows], self.idx)
        return Inputs(self.n, self.d, rows=self.rows, idx=self.idx, val=self.val * ((u < keep) / keep))


def slices(pdf: pd.DataFrame, inputs: int, units: int, least: int = 0, dense: bool = False):
    """``pdf`` in ranges of rows with about ``SLICE_CELLS`` cells (or ``least``, if that is
    more: the cells that a kernel gives back for each range).

    A row counts its inputs and units; a sparse one (``_xi``) its units once for each stored
    cell, and its inputs only where it is made ``dense``.
    """
    size = np.full(len(pdf), units, dtype=np.int64)
    sparse = "_xi" in pdf.columns
    if sparse:
        size += units * np.fromiter(map(len, pdf["_xi"].values), dtype=np.int64, count=len(pdf))
    if dense or not sparse:
        size += inputs
    part = np.cumsum(size) // max(SLICE_CELLS, least)
    at = [0, *(np.flatnonzero(np.diff(part)) + 1), len(pdf)]
    for lo, hi in zip(at, at[1:]):
        yield pdf.iloc[lo:hi] if hi - lo < len(pdf) else pdf


def dropout_mask(seed: int, step: int, layer: int, row_ids: np.ndarray, units: int,
                 keep: float) -> np.ndarray:
    """Inverted dropout: keep with probability ``keep`` and scale by 1/keep."""
    u = mix_uniform_np(seed, step * 16 + layer, row_ids, np.arange(units))
    return (u < keep).astype(np.float64) / keep


def softmax(y: np.ndarray) -> np.ndarray:
    m = y.max(axis=1, keepdims=True)
    e = np.exp(y - m)
    return e / e.sum(axis=1, keepdims=True)


def log_softmax(y: np.ndarray) -> np.ndarray:
    m = y.max(axis=1, keepdims=True)
    return y - m - np.log(np.exp(y - m).sum(axis=1, keepdims=True))


def forward(x: Inputs, model: Model, moments: list[tuple[np.ndarray, np.ndarray]],
            stop_at: int | None = None, dropout: dict | None = None) -> dict:
    """Forward pass.  ``moments[l] = (mean, std)`` of layer l+1's pre-activation over
    the fed rows.  With ``stop_at = l`` it returns after computing ``z`` of hidden
    layer l (1-based), which is what the moment pass needs.

    ``dropout = {"seed", "step", "keep", "row_ids"}`` applies training masks.
    """
    cache: dict = {"a": [], "z": [], "zh": [], "u": [], "mask": []}
    a_in = x
    if dropout and dropout.get("input", True):
        a_in = x.dropped(dropout["seed"], dropout["step"], dropout["row_ids"], dropout["keep"])
    cache["x"] = a_in
    prev = None
    for l, layer in enumerate(model.hidden, start=1):
        z = (a_in.matmul(layer.W) if prev is None else prev @ layer.W) + layer.b
        if stop_at == l:
            cache["z"].append(z)
            return cache
        mu, sd = moments[l - 1]
        zh = (z - mu) / sd
        u = layer.scale * zh + layer.beta
        a = np.maximum(u, 0.0)
        if dropout:
            mk = dropout_mask(dropout["seed"], dropout["step"], l, dropout["row_ids"], a.shape[1], dropout["keep"])
            a = a * mk
            cache["mask"].append(mk)
        cache["z"].append(z)
        cache["zh"].append(zh)
        cache["u"].append(u)
        cache["a"].append(a)
        prev = a
    y = (a_in.matmul(model.W_out) if prev is None else prev @ model.W_out) + model.b_out
    cache["y"] = y
    return cache


class Moments:
    """Mergeable (n, mean, M2) per unit (Chan et al. parallel update)."""

    def __init__(self, k: int):
        self.n = 0
        self.mean = np.zeros(k)
        self.m2 = np.zeros(k)

    def add(self, z: np.ndarray) -> None:
        nb = z.shape[0]
        if nb == 0:
            return
        mb = z.mean(axis=0)
        m2b = ((z - mb) ** 2).sum(axis=0)
        n = self.n + nb
        delta = mb - self.mean
        self.mean = self.mean + delta * (nb / n)
        self.m2 = self.m2 + m2b + delta ** 2 * (self.n * nb / n)
        self.n = n
