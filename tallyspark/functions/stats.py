"""Column arithmetic for intervals and tolerant comparison."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Two-sided 95 % normal quantile, comparison tolerances.
Z95 = 1.959963984540054
REL_TOL = 1e-9
ABS_TOL = 1e-2


def wilson(successes: Column, total: Column, z: float = Z95) -> tuple[Column, Column]:
    """Wilson score interval for a rate; NULL when nothing was counted."""
    n = F.when(total > 0, total.cast("double"))
    rate = successes / n
    scale = 1 + z * z / n
    centre = (rate + z * z / (2 * n)) / scale
    spread = z * F.sqrt(rate * (1 - rate) / n + z * z / (4 * n * n)) / scale
    low = F.when(n.isNotNull(), F.greatest(F.lit(0.0), centre - spread))
    high = F.when(n.isNotNull(), F.least(F.lit(1.0), centre + spread))
    return low, high


def close(a: Column, b: Column, rel: float = REL_TOL, tol: float = ABS_TOL) -> Column:
    """Numbers equal within the larger of a relative and an absolute tolerance."""
    return F.abs(a - b) <= F.greatest(rel * F.greatest(F.abs(a), F.abs(b)), F.lit(tol))


def ratio(top: Column, bottom: Column) -> Column:
    """Quotient, NULL when the divisor is zero."""
    return F.when(bottom != 0, top / bottom)
