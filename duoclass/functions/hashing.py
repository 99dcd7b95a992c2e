"""Seeded, partition-proof hashing.

Two families:

* ``seeded_hex``: md5 of ``"<seed>:<key>"`` as lowercase hex.  The text form is
  identical in Spark and in ANSI engines with an ``md5`` function, so orders built
  on it can be checked by a plain ``row_number() OVER (ORDER BY md5(...))``.
* ``mix_uniform``: a small modular mixer over a prime field that has the same
  value as a Spark expression, as SQL and as vectorised NumPy.  It drives dropout
  masks, where a mask is needed for every (row, unit) pair inside an Arrow batch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the mixer (prime modulus and multipliers).
MIX_P = 2147483647
MIX_A = 48271
MIX_B = 69621
MIX_C = 16807
MIX_D = 39373


def seeded_hex(seed: int | str, key: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def hex_bucket(hex_col: Column, n_chars: int) -> Column:
    """Leading ``n_chars`` hex digits as an integer: monotone in the hex order."""
    return F.conv(F.substring(hex_col, 1, n_chars), 16, 10).cast("long")


def _scalar_offset(seed: int, step: int) -> int:
    return (int(seed) * 1000003 + int(step) * 7919 + 12345) % MIX_P


def mix_uniform_col(seed: int, step: int, row: Column, unit: Column) -> Column:
    """Uniform in [0, 1) from (seed, step, row, unit); rows and units are >= 0."""
    a = _scalar_offset(seed, step)
    p = F.lit(MIX_P).cast("long")
    r = row.cast("long")
    # ids of the modulus and more: the part above it is mixed in as well
    high = F.call_function("div", r, p)
    h = ((r % p) * F.lit(MIX_A) + (high % p) * F.lit(MIX_D) + F.lit(a)) % p
    h = (h * h + (unit.cast("long") % p) * F.lit(MIX_B) + F.lit(1)) % p
    h = (h * F.lit(MIX_C) + F.lit(11)) % p
    h = (h * h + F.lit(7)) % p
    return h.cast("double") / F.lit(float(MIX_P))


def mix_uniform_sql(seed: int, step: int, row: str, unit: str) -> str:
    a = _scalar_offset(seed, step)
    p = MIX_P
    r = f"CAST({row} AS BIGINT)"
    h = f"(({r} % {p}) * {MIX_A} + (({r} // {p}) % {p}) * {MIX_D} + {a}) % {p}"
    h = f"(({h}) * ({h}) + (CAST({unit} AS BIGINT) % {p}) * {MIX_B} + 1) % {p}"
    h = f"(({h}) * {MIX_C} + 11) % {p}"
    h = f"(({h}) * ({h}) + 7) % {p}"
    return f"CAST({h} AS DOUBLE) / CAST({p} AS DOUBLE)"


def mix_uniform_np(seed: int, step: int, rows: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Same values as ``mix_uniform_col`` for the outer product rows x units."""
    return mix_uniform_pairs_np(seed, step, np.asarray(rows)[:, None], np.asarray(units)[None, :])


def mix_uniform_pairs_np(seed: int, step: int, rows: np.ndarray, units: np.ndarray) -> np.ndarray:
    """Same values as ``mix_uniform_col`` for (row, unit) pairs (broadcasting)."""
    a = _scalar_offset(seed, step)
    p = np.int64(MIX_P)
    rows = np.asarray(rows, dtype=np.int64)
    r, high = rows % p, (rows // p) % p
    u = np.asarray(units, dtype=np.int64) % p
    h = (r * MIX_A + high * MIX_D + a) % p
    h = (h * h + u * MIX_B + 1) % p
    h = (h * MIX_C + 11) % p
    h = (h * h + 7) % p
    return h.astype(np.float64) / float(MIX_P)
