"""Numeric column functions with the reference's IEEE edge behaviour.

Spark's ``log10`` returns NULL for 0 and negatives, where NumPy gives -inf
and NaN; the helpers here restore the NumPy edges explicitly so that the
value a user sees matches the pandas workflow.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NEG_INF = float("-inf")
NAN = float("nan")


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def log10_ieee(c) -> Column:
    """log10 with 0 -> -inf and negative -> NaN; NULL stays NULL."""
    c = _c(c)
    return (F.when(c.isNull(), F.lit(None).cast("double"))
            .when(c == 0, F.lit(NEG_INF))
            .when(c < 0, F.lit(NAN))
            .otherwise(F.log10(c)))


def log10p1(c) -> Column:
    """log10(x + 1) with IEEE edges (x = -1 -> -inf, x < -1 -> NaN)."""
    return log10_ieee(_c(c) + F.lit(1.0))


def unlog10p1(c) -> Column:
    """Inverse of :func:`log10p1`: 10^x - 1."""
    return F.pow(F.lit(10.0), _c(c)) - F.lit(1.0)


def log10_floor(c, floor: float | None) -> Column:
    """log10(max(x, floor)); NULL stays NULL (``greatest`` alone skips NULL)."""
    c = _c(c)
    if floor is None:
        return log10_ieee(c)
    return log10_ieee(F.when(c.isNotNull(), F.greatest(c, F.lit(float(floor)))))


def is_close(c, to: float = 1.0, rtol: float = 1e-5, atol: float = 1e-8) -> Column:
    """NumPy ``isclose``: |x - to| <= atol + rtol * |to|."""
    return F.abs(_c(c) - F.lit(float(to))) <= F.lit(atol + rtol * abs(float(to)))


def fmt2(c) -> Column:
    """Python ``f'{x:.2f}'``: half-even on the exact binary value, no grouping.

    ``format_number(x, '0.00')`` uses the exact decimal expansion of the double,
    as Python does; ``format_string('%.2f')`` rounds half-up and differs.
    """
    c = _c(c)
    return (F.when(c.isNull(), F.lit(None).cast("string"))
            .when(F.isnan(c), F.lit("nan"))
            .when(c == F.lit(float("inf")), F.lit("inf"))
            .when(c == F.lit(NEG_INF), F.lit("-inf"))
            .otherwise(F.call_function("format_number", c, F.lit("0.00"))))


def trunc_int(c) -> Column:
    """Python ``int(x)`` for display: truncation toward zero."""
    return _c(c).cast("bigint")


def hash_unit(key: Column, part: int = 0) -> Column:
    """Uniform (0, 1) number from 32 bits of ``md5(key)``; ``part`` picks the bits."""
    hexpart = F.substring(F.md5(key), 1 + 8 * part, 8)
    return (F.conv(hexpart, 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)


def hashed_gauss(key: Column, sd: float = 1.0) -> Column:
    """Normal(0, sd) draw keyed by ``key`` (Box-Muller over two md5 words).

    The value depends only on the key, so it is the same under any
    partitioning and on recomputation after an executor loss (``randn`` is
    neither).
    """
    u1 = hash_unit(key, 0)
    u2 = hash_unit(key, 1)
    z = F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2.0 * 3.141592653589793) * u2)
    return z * F.lit(float(sd))
