"""Network parameters as a small driver-side object <-> a long Parquet table.

A model is a stack of batch-normalised ReLU layers and a linear output layer:

    z_l = a_{l-1} W_l + b_l ;  zhat_l = (z_l - mean_l) / sqrt(var_l + eps)
    a_l = relu(scale_l * zhat_l + beta_l)           (dropout while training)
    y   = a_L W_out + b_out ;  p = softmax(y)

Batch-norm always uses the moments of the rows being fed (no moving averages),
so a hidden bias cancels with the mean.  The parameter table is

    params(model STRING, version INT, layer INT, name STRING, i INT, j INT, value DOUBLE)

with matrices at (i = input, j = unit) and vectors at (i = 0, j = unit); the
output layer is layer L+1.  Optimiser slots are rows named ``m:<name>``/``v:<name>``
and the step counter is the row ``global_step``.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclass.functions.hashing import mix_uniform_col, mix_uniform_np, mix_uniform_sql

PARAM_NAMES = ("W", "b", "scale", "beta")
EPSILON = 1e-3


@dataclass
class Layer:
    W: np.ndarray
    b: np.ndarray
    scale: np.ndarray
    beta: np.ndarray

    @property
    def units(self) -> int:
        return self.W.shape[1]


@dataclass
class Model:
    hidden: list[Layer]
    W_out: np.ndarray
    b_out: np.ndarray
    eps: float = EPSILON
    global_step: int = 0
    slots: dict = field(default_factory=dict)  # (layer, name, kind) -> array

    @property
    def n_inputs(self) -> int:
        return (self.hidden[0].W if self.hidden else self.W_out).shape[0]

    @property
    def n_outputs(self) -> int:
        return self.W_out.shape[1]

    @property
    def n_cells(self) -> int:
        return sum(a.size for a in self.arrays().values())

    @property
    def n_units(self) -> int:
        return sum(layer.units for layer in self.hidden) + self.n_outputs

    def arrays(self) -> dict[tuple[int, str], np.ndarray]:
        out = {}
        for l, layer in enumerate(self.hidden, start=1):
            for n in PARAM_NAMES:
                out[(l, n)] = getattr(layer, n)
        L = len(self.hidden) + 1
        out[(L, "W")] = self.W_out
        out[(L, "b")] = self.b_out
        return out

    def set_array(self, key: tuple[int, str], value: np.ndarray) -> None:
        l, n = key
        if l <= len(self.hidden):
            setattr(self.hidden[l - 1], n, value)
        elif n == "W":
            self.W_out = value
        else:
            self.b_out = value

    def copy(self) -> "Model":
        return Model([Layer(*(getattr(h, n).copy() for n in PARAM_NAMES)) for h in self.hidden],
                     self.W_out.copy(), self.b_out.copy(), self.eps, self.global_step,
                     {k: v.copy() for k, v in self.slots.items()})

    # ---- long-table form -------------------------------------------------
    def to_rows(self, with_slots: bool = True) -> list[tuple[int, str, int, int, float]]:
        rows = []

        def emit(l, name, a):
            a = np.asarray(a, dtype=np.float64)
            if a.ndim == 1:
                rows.extend((l, name, 0, int(j), float(v)) for j, v in enumerate(a))
            else:
                ii, jj = np.indices(a.shape)
                rows.extend(zip([l] * a.size, [name] * a.size, ii.ravel().tolist(),
                                jj.ravel().tolist(), a.ravel().tolist()))
        for (l, n), a in self.arrays().items():
            emit(l, n, a)
        if with_slots:
            for (l, n, kind), a in self.slots.items():
                emit(l, f"{kind}:{n}", a)
        rows.append((0, "global_step", 0, 0, float(self.global_step)))
        rows.append((0, "eps", 0, 0, float(self.eps)))
        return rows

    @staticmethod
    def from_rows(rows) -> "Model":
        """Rebuild from (layer, name, i, j, value) tuples or Rows."""
        groups: dict[tuple[int, str], list] = {}
        step, eps = 0, EPSILON
        for r in rows:
            l, n, i, j, v = (r["layer"], r["name"], r["i"], r["j"], r["value"]) if hasattr(r, "asDict") else r
            if n == "global_step":
                step = int(v)
                continue
            if n == "eps":
                eps = float(v)
                continue
            groups.setdefault((int(l), n), []).append((int(i), int(j), float(v)))
        L = max(l for (l, n) in groups if n == "W")

        def build(cells, vector):
            if vector:
                a = np.zeros(max(j for _, j, _ in cells) + 1)
                for _, j, v in cells:
                    a[j] = v
                return a
            a = np.zeros((max(i for i, _, _ in cells) + 1, max(j for _, j, _ in cells) + 1))
            for i, j, v in cells:
                a[i, j] = v
            return a
        hidden = []
        for l in range(1, L):
            hidden.append(Layer(*(build(groups[(l, n)], n != "W") for n in PARAM_NAMES)))
        m = Model(hidden, build(groups[(L, "W")], False), build(groups[(L, "b")], True), eps, step)
        for (l, n), cells in groups.items():
            if ":" in n:
                kind, base = n.split(":", 1)
                m.slots[(l, base, kind)] = build(cells, base != "W")
        return m


# ---- initialisers -----------------------------------------------------------

def intmod_value(layer: int, code: int, i, j):
    """Deterministic integer-derived weight: ((31i + 17j + 7layer + 3code) % 21 - 10) / 100.

    Exactly representable in any engine (integer arithmetic, then one division), so
    scoring with it can be checked cell for cell against a SQL oracle.
    """
    return (((31 * np.asarray(i) + 17 * np.asarray(j) + 7 * layer + 3 * code) % 21) - 10) / 100.0


def intmod_model(n_inputs: int, hidden: list[int], n_outputs: int = 2) -> Model:
    sizes = [n_inputs] + list(hidden)
    layers = []
    for l in range(1, len(sizes)):
        d, h = sizes[l - 1], sizes[l]
        ii, jj = np.indices((d, h))
        units = np.arange(h)
        layers.append(Layer(intmod_value(l, 0, ii, jj).astype(np.float64),
                            intmod_value(l, 1, 0, units).astype(np.float64),
                            1.0 + intmod_value(l, 2, 0, units).astype(np.float64),
                            intmod_value(l, 3, 0, units).astype(np.float64)))
    L = len(sizes)
    ii, jj = np.indices((sizes[-1], n_outputs))
    return Model(layers, intmod_value(L, 0, ii, jj).astype(np.float64),
                 intmod_value(L, 1, 0, np.arange(n_outputs)).astype(np.float64))


DRAWS = 8   # tries a cell has for a normal within two deviations (0.0455 ** 8 miss all: then 0)


def _draw_steps(layer: int) -> list[tuple[int, int]]:
    """Steps of the mixer for both uniforms of each try."""
    return [(layer * 64 + 2 * k, layer * 64 + 2 * k + 1) for k in range(DRAWS)]


def truncated_normal_col(seed: int, layer: int, i: Column, j: Column) -> Column:
    """Standard normal within two deviations at cell (i, j): the first of ``DRAWS`` tries that
    is, by a counter-based generator, so any cell can be made alone and again."""
    tries = []
    for a, b in _draw_steps(layer):
        z = F.sqrt(-2.0 * F.log(1.0 - mix_uniform_col(seed, a, i, j))) * F.cos(2.0 * math.pi * mix_uniform_col(seed, b, i, j))
        tries.append(F.when(F.abs(z) <= 2.0, z))
    return F.coalesce(*tries, F.lit(0.0))


def truncated_normal_sql(seed: int, layer: int, i: str, j: str) -> str:
    tries = []
    for a, b in _draw_steps(layer):
        z = (f"sqrt(-2::DOUBLE * ln(1::DOUBLE - {mix_uniform_sql(seed, a, i, j)})) * "
             f"cos({2.0 * math.pi!r}::DOUBLE * ({mix_uniform_sql(seed, b, i, j)}))")
        tries.append(f"CASE WHEN abs({z}) <= 2 THEN {z} END")
    return f"coalesce({', '.join(tries)}, 0::DOUBLE)"


def truncated_normal_np(seed: int, layer: int, rows: int, units: int) -> np.ndarray:
    out = np.zeros((rows, units))
    todo = np.ones((rows, units), bool)
    for a, b in _draw_steps(layer):
        u, w = (mix_uniform_np(seed, s, np.arange(rows), np.arange(units)) for s in (a, b))
        z = np.sqrt(-2.0 * np.log(1.0 - u)) * np.cos(2.0 * math.pi * w)
        take = todo & (np.abs(z) <= 2.0)
        out[take] = z[take]
        todo &= ~take
    return out


def init_cells(spark: SparkSession, n_inputs: int, hidden: list[int], n_outputs: int = 2, seed: int = 0,
               std: float = 0.1, bias: float = 0.1, tag: str = "tag") -> DataFrame:
    """The parameter table of a freshly initialised model, its cells made by the executors."""
    sizes = [n_inputs, *hidden, n_outputs]
    last = len(sizes) - 1
    parts = [spark.createDataFrame([(0, "global_step", 0, 0, 0.0), (0, "eps", 0, 0, EPSILON)], "layer int, name string, i int, j int, value double")]
    for layer in range(1, last + 1):
        h = sizes[layer]
        at = spark.range(sizes[layer - 1] * h)
        i, j = F.floor(F.col("id") / h), F.col("id") % h
        parts.append(at.select(F.lit(layer).alias("layer"), F.lit("W").alias("name"), i.cast("int").alias("i"), j.cast("int").alias("j"),
                               (truncated_normal_col(seed, layer, i, j) * std).alias("value")))
        vectors = [("b", bias)] if layer == last else [("b", bias), ("scale", 1.0), ("beta", 0.0)]
        for name, x in vectors:
            parts.append(spark.range(h).select(F.lit(layer).alias("layer"), F.lit(name).alias("name"), F.lit(0).alias("i"),
                                               F.col("id").cast("int").alias("j"), F.lit(float(x)).alias("value")))
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole.select(F.lit(tag).alias("tag"), "*")


def init_model(n_inputs: int, hidden: list[int], n_outputs: int = 2, seed: int = 0,
               std: float = 0.1, bias: float = 0.1) -> Model:
    """Weights ~ truncated normal(0.1), biases 0.1, scale 1, shift 0; the values of
    :func:`init_cells`, for a model that the driver holds."""
    sizes = [n_inputs] + list(hidden)
    layers = [Layer(truncated_normal_np(seed, l, sizes[l - 1], sizes[l]) * std,
                    np.full(sizes[l], bias), np.ones(sizes[l]), np.zeros(sizes[l]))
              for l in range(1, len(sizes))]
    return Model(layers, truncated_normal_np(seed, len(sizes), sizes[-1], n_outputs) * std, np.full(n_outputs, bias))
