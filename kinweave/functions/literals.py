"""Array literals built in one call; element-wise literals cost a gateway round trip each."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def _spell(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return f"{value}L" if abs(value) >= 2**31 - 1 else str(value)
    if isinstance(value, float):
        if not math.isfinite(value):
            return f"double('{'NaN' if math.isnan(value) else 'Infinity' if value > 0 else '-Infinity'}')"
        return f"{value!r}D"
    text = str(value).replace("\\", "\\\\").replace("'", "\\'")
    return f"'{text}'"


def array_of(values: Sequence) -> Column:
    """Array literal of numbers or strings (one kind per call, at least one value)."""
    return F.expr(f"array({', '.join(_spell(v) for v in values)})")
