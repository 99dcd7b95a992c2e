"""Small column helpers shared by operators and query plans."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def r6(c: Column | str, digits: int = 6) -> Column:
    """Round a double for reporting; ``+ 0.0`` folds ``-0.0`` into ``0.0``."""
    col = F.col(c) if isinstance(c, str) else c
    return F.round(col.cast("double"), digits) + F.lit(0.0)


def round_half_away(x: float) -> int:
    """Round to the nearest integer, halves away from zero (Python 2 ``round``)."""
    return int(math.floor(abs(x) + 0.5)) * (1 if x >= 0 else -1)
