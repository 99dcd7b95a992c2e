"""Column-level helpers (pure Spark expressions, no Python in the data path)."""

from duoclass.functions.hashing import (  # noqa: F401
    seeded_hex, hex_bucket, mix_uniform_col, mix_uniform_np,
)
from duoclass.functions.columns import r6, round_half_away  # noqa: F401
