"""Reproducible random numbers derived from row keys.

``rand(seed)`` changes with the partitioning and with task retries; these do
not, so every sampling operator gives the same rows on any cluster and can be
recomputed by another SQL engine.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_DIGITS = 13  # hexadecimal digits of a digest in one number: 52 bits, all exact in a double
_RANGE = 2.0 ** (4 * _DIGITS)


def as_column(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def hash_uniform(*keys: Column | str, salt: str, seed: int = 0, part: int = 0) -> Column:
    """Uniform number in [0, 1) from 52 bits of an md5 over key, salt and seed.

    One digest holds two independent numbers (``part`` 0 and 1); Spark computes a shared digest once.  Higher parts come
    from further digests.
    """
    parts = [as_column(k).cast("string") for k in keys]
    text = F.concat_ws(":", *parts, *[F.lit(w) for w in _suffix(salt, seed, part)])
    digits = F.substring(F.md5(text), 1 + _DIGITS * (part % 2), _DIGITS)
    return F.conv(digits, 16, 10).cast("double") / F.lit(_RANGE)


def _suffix(salt: str, seed: int, part: int) -> list[str]:
    return [salt, str(seed), *([str(part // 2)] if part > 1 else [])]


def uniform_sql(*keys: str, salt: str, seed: int = 0, part: int = 0) -> str:
    """DuckDB spelling of :func:`hash_uniform`."""
    parts = ", ".join(f"({k})::VARCHAR" for k in keys)
    rest = ", ".join(f"'{w}'" for w in _suffix(salt, seed, part))
    digest = f"md5(concat_ws(':', {parts}, {rest}))"
    return f"(('0x' || substr({digest}, {1 + _DIGITS * (part % 2)}, {_DIGITS}))::UBIGINT::DOUBLE / {_RANGE!r}::DOUBLE)"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, even where ``use`` reads it inside a lambda."""
    return F.element_at(F.transform(F.array(value), use), 1)


def hash_normal(*keys: Column | str, salt: str, seed: int = 0) -> Column:
    """Standard normal number (Box-Muller on two hash uniforms)."""
    u1 = hash_uniform(*keys, salt=salt, seed=seed, part=0)
    u2 = hash_uniform(*keys, salt=salt, seed=seed, part=1)
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2.0 * math.pi) * u2)


def normal_sql(*keys: str, salt: str, seed: int = 0) -> str:
    u1 = uniform_sql(*keys, salt=salt, seed=seed, part=0)
    u2 = uniform_sql(*keys, salt=salt, seed=seed, part=1)
    return f"(sqrt(-2.0::DOUBLE * ln(1.0::DOUBLE - {u1})) * cos({2.0 * math.pi!r}::DOUBLE * {u2}))"


def gumbel(uniform: Column) -> Column:
    """Gumbel noise; the uniform is shifted off zero by half a step."""
    return -F.log(-F.log(uniform + F.lit(0.5 / _RANGE)))


def gumbel_sql(uniform: str) -> str:
    return f"(-ln(-ln({uniform} + {0.5 / _RANGE!r}::DOUBLE)))"
