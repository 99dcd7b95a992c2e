"""Parameters, gradients and optimiser state as tables; Adam as a join.

All three hold matrices in blocks of ``BLOCK_ROWS`` rows, one table row for each
(layer, name, block), with the block's cells row by row in an array:

    blocks(layer INT, name STRING, block INT, width INT, value ARRAY<DOUBLE>)

The state has two more arrays, Adam's moments ``m`` and ``v``.  A step joins state and
gradient on (layer, name, block) and updates the arrays with column expressions; nothing
of it passes through the driver.  A block without a gradient row has gradient zero (a sparse
input's features that no row of the batch has), and its moments decay all the same.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duoclass.operators.model import Model

BLOCK_ROWS = 64   # matrix rows that travel together
KEYS = ["layer", "name", "block"]
BLOCK_SCHEMA = "layer int, name string, block int, width int, value array<double>"


def block_tuples(arrays: dict) -> list[tuple]:
    """{(layer, name): array} as rows of the block table."""
    out = []
    for (layer, name), a in arrays.items():
        a = np.atleast_2d(np.asarray(a, dtype=np.float64))
        for lo in range(0, a.shape[0], BLOCK_ROWS):
            out.append((int(layer), name, lo // BLOCK_ROWS, int(a.shape[1]), a[lo:lo + BLOCK_ROWS].ravel().tolist()))
    return out


def state_of(spark: SparkSession, model: Model) -> DataFrame:
    """A model's parameters with its optimiser slots (zeros where it has none) as a table.

    A model that the driver was given (defined or restored) is model-sized there already.
    """
    def slot(kind):
        return {k: model.slots.get((k[0], k[1], kind), np.zeros_like(a)) for k, a in model.arrays().items()}

    rows = [(*p, m[-1], v[-1]) for p, m, v in zip(block_tuples(model.arrays()), block_tuples(slot("m")), block_tuples(slot("v")))]
    return spark.createDataFrame(rows, f"{BLOCK_SCHEMA}, m array<double>, v array<double>")


def cells(blocks: DataFrame, column: str = "value", out: str = "value") -> DataFrame:
    """(layer, name, i, j, <out>): one row for each cell."""
    c = blocks.select("layer", "name", "block", "width", F.posexplode(column).alias("_at", out))
    row = F.col("block") * BLOCK_ROWS + F.floor(F.col("_at") / F.col("width"))
    return c.select("layer", "name", row.cast("int").alias("i"), (F.col("_at") % F.col("width")).cast("int").alias("j"), out)


def adam_step(state: DataFrame, grads: DataFrame, lr: float, step: int, b1: float = 0.9, b2: float = 0.999,
              eps: float = 1e-8) -> DataFrame:
    """The state after one Adam step with bias-corrected step size; ``step`` counts from 1.

    Every row of the state stays; gradient rows that no parameter has are ignored.
    """
    rate = lr * math.sqrt(1 - b2 ** step) / (1 - b1 ** step)
    zero = F.transform("value", lambda _: F.lit(0.0))
    joined = state.join(grads.select(*KEYS, F.col("value").alias("grad")), KEYS, "left").withColumn("grad", F.coalesce("grad", zero))
    moved = (joined.withColumn("m", F.zip_with("m", "grad", lambda m, g: m * b1 + g * (1 - b1)))
             .withColumn("v", F.zip_with("v", "grad", lambda v, g: v * b2 + g * g * (1 - b2)))
             .withColumn("change", F.zip_with("m", "v", lambda m, v: m * rate / (F.sqrt(v) + eps)))
             .withColumn("value", F.zip_with("value", "change", lambda p, c: p - c)))
    return moved.select(*KEYS, "width", "value", "m", "v")


def arrays_of(blocks: DataFrame, column: str = "value") -> dict[tuple[int, str], np.ndarray]:
    """Blocks back as arrays, vectors one-dimensional (model-sized, for the next forward pass)."""
    parts: dict = {}
    for r in blocks.select(*KEYS, "width", column).collect():
        parts.setdefault((r["layer"], r["name"]), {})[r["block"]] = np.array(r[column]).reshape(-1, r["width"])
    whole = {k: np.concatenate([p[b] for b in sorted(p)]) for k, p in parts.items()}
    return {k: a if k[1] == "W" else a[0] for k, a in whole.items()}


def with_values(model: Model, state: DataFrame, slots: bool = False) -> Model:
    """``model`` with the values of a state table (and its slots, where they are wanted)."""
    for key, a in arrays_of(state).items():
        model.set_array(key, a)
    if slots:
        for kind in ("m", "v"):
            for (layer, name), a in arrays_of(state, kind).items():
                model.slots[layer, name, kind] = a
    return model
