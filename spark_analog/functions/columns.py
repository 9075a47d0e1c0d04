"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def finite(c) -> Column:
    """NaN and infinities become NULL, the only spelling of "missing" used here."""
    c = col(c).cast("double")
    return F.when(F.isnan(c) | (F.abs(c) == F.lit(float("inf"))), None).otherwise(c)


def rounded(c, digits: int = 6) -> Column:
    """Rounding for comparisons between engines.

    The shift keeps exact decimal half-way cases, where the last bit of a sum
    decides, away from the boundary.
    """
    return F.round(col(c) + F.lit(1.3e-9), digits) + F.lit(0.0)


def at_least(c, low) -> Column:
    """``max(c, low)`` that keeps NULL (``greatest`` would drop it)."""
    return F.when(col(c).isNotNull(), F.greatest(col(c), F.lit(low)))


def clip(c, low, high) -> Column:
    return F.when(col(c).isNotNull(), F.least(F.greatest(col(c), F.lit(low)), F.lit(high)))


def sigmoid(c) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-col(c)))


def log1p_clamped(c, high: float) -> Column:
    return F.log1p(clip(c, 0.0, high))


def let(value, fn) -> Column:
    """``fn(value)`` with ``value`` evaluated once, not once per element of an inner lambda."""
    return F.element_at(F.transform(F.array(value), fn), 1)


def array_sum(a) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def array_mean(a) -> Column:
    """Mean over the non-NULL elements; NULL when there are none."""
    return let(F.filter(a, lambda x: x.isNotNull()),
               lambda k: F.when(F.size(k) > 0, array_sum(k) / F.size(k)))


def array_diff_mean(a, b, fn) -> Column:
    """Mean of ``fn(a_i, b_i)`` over positions."""
    return array_mean(F.zip_with(a, b, fn))


def literal_array(values, kind: str = "double") -> Column:
    return F.array(*[F.lit(v).cast(kind) for v in values])


def axis_values(index: Column, **axes) -> list[Column]:
    """Values of grid point ``index`` in loop order (first axis slowest).

    With ``explode(sequence(0, n - 1))`` it multiplies rows by a constant
    without any join and without one literal per grid point.
    """
    out, below = [], 1
    for name, values in reversed(list(axes.items())):
        kind = "int" if all(isinstance(v, int) for v in values) else "double"
        position = F.floor(index / below) % len(values) + 1
        out.append(F.element_at(literal_array(values, kind), position.cast("int")).alias(name))
        below *= len(values)
    return out[::-1]


def grid_size(**axes) -> int:
    n = 1
    for values in axes.values():
        n *= len(values)
    return n


def grid_ids(**axes) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(grid_size(**axes) - 1)))
