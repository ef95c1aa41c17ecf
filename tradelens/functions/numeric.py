"""Numeric column helpers shared by every plan."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Abramowitz & Stegun 7.1.26 polynomial for erf.
ERF_P = 0.3275911
ERF_A = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rnd(c: Column | str, digits: int = 6) -> Column:
    """Round a double for a report. The nudge sends exact ties one way whatever the summation order
    was; negative zero becomes zero."""
    return F.round(col(c).cast("double") + F.lit(1e-9), digits) + F.lit(0.0)


def div(a: Column | str, b: Column | str) -> Column:
    """NULL instead of an error when the divisor is zero."""
    return F.try_divide(col(a), col(b))


def div0(a: Column | str, b: Column | str) -> Column:
    """Zero when the divisor is zero."""
    return F.coalesce(div(a, b), F.lit(0.0))


def sum_if(value: Column | str, cond: Column) -> Column:
    """Conditional sum that is zero, not NULL, when nothing matches."""
    return F.coalesce(F.sum(F.when(cond, col(value))), F.lit(0.0))


def count_if(cond: Column) -> Column:
    return F.count(F.when(cond, F.lit(1)))


def avg_if(value: Column | str, cond: Column) -> Column:
    return F.avg(F.when(cond, col(value)))


def min_if(value: Column | str, cond: Column) -> Column:
    return F.min(F.when(cond, col(value)))


def max_if(value: Column | str, cond: Column) -> Column:
    return F.max(F.when(cond, col(value)))


def above_zero(c: Column | str) -> Column:
    """Positive beyond the noise that summation order leaves in a money total."""
    return F.round(col(c), 9) > 0


def clamp(c: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def ladder(value: Column, steps: Iterable[tuple[float, float]], otherwise: Column | float, op: str = ">=") -> Column:
    """First matching step wins: ``(bound, result)`` compared with ``op``."""
    tests = {
        ">=": lambda v, b: v >= b,
        ">": lambda v, b: v > b,
        "<": lambda v, b: v < b,
        "<=": lambda v, b: v <= b,
    }
    test = tests[op]
    out = None
    for bound, result in steps:
        cond = test(value, F.lit(bound))
        result_col = result if isinstance(result, Column) else F.lit(result)
        out = F.when(cond, result_col) if out is None else out.when(cond, result_col)
    tail = otherwise if isinstance(otherwise, Column) else F.lit(otherwise)
    return out.otherwise(tail)


def horner(x: Column, coefficients: Iterable[float]) -> Column:
    """Polynomial without constant term: c1*x + c2*x^2 + ..."""
    return reduce(lambda acc, c: (acc + F.lit(c)) * x, reversed(list(coefficients)), F.lit(0.0))


def erf(x: Column, t: Column | None = None) -> Column:
    """Error function; ``t`` may name a column that already holds ``erf_step(x)``."""
    t = erf_step(x) if t is None else t
    return F.signum(x) * (F.lit(1.0) - horner(t, ERF_A) * F.exp(-x * x))


def erf_step(x: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.lit(ERF_P) * F.abs(x))


def with_upper_tails(df: DataFrame, scores: Mapping[str, Column]) -> DataFrame:
    """Add a one-tailed normal p-value of |z| per named score.

    The steps are separate columns, so the long polynomial is written once per score.
    """
    staged = df.withColumns({f"_x_{n}": F.abs(z) / F.sqrt(F.lit(2.0)) for n, z in scores.items()})
    staged = staged.withColumns({f"_t_{n}": erf_step(F.col(f"_x_{n}")) for n in scores})
    tail = lambda n: F.lit(1.0) - F.lit(0.5) * (F.lit(1.0) + erf(F.col(f"_x_{n}"), F.col(f"_t_{n}")))
    out = staged.withColumns({n: F.least(F.lit(1.0), F.greatest(F.lit(0.0), tail(n))) for n in scores})
    return out.drop(*[f"_{k}_{n}" for n in scores for k in "xt"])


def epoch_micros(ts: Column | str) -> Column:
    return F.unix_micros(col(ts))


def seconds_between(start: Column | str, end: Column | str) -> Column:
    """Whole seconds crossed between two timestamps (each floored to its second first)."""
    return F.unix_seconds(col(end)) - F.unix_seconds(col(start))


def millis_between(start: Column | str, end: Column | str) -> Column:
    return F.unix_millis(col(end)) - F.unix_millis(col(start))


def int_div(value: Column, width: int) -> Column:
    """Integer division that truncates toward zero."""
    whole = F.floor(F.abs(value) / F.lit(width)).cast("bigint")
    return F.when(value < 0, -whole).otherwise(whole)


def log_segment(value: Column, resolution: int = 32) -> Column:
    """Order-preserving bucket of a number: never decreases as the value grows.

    The bucket count grows with the logarithm of the value range, so per-bucket totals stay small
    whatever the number of rows.
    """
    v = value.cast("double")
    return F.floor(F.signum(v) * F.log1p(F.abs(v) * F.lit(16.0)) * F.lit(float(resolution))).cast("bigint")
