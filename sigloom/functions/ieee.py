"""IEEE arithmetic on top of ANSI SQL: division by zero gives infinities or NaN, NaN equals nothing, min and max skip it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NAN, INF = float("nan"), float("inf")


def f_div(a: Column, b: Column) -> Column:
    at_zero = F.when(F.isnan(a) | (a == 0), F.lit(NAN)).when((a > 0) == ~is_negative(b), F.lit(INF)).otherwise(F.lit(-INF))
    return F.when(b == 0, at_zero).otherwise(F.try_divide(a, b))


def f_mod(a: Column, b: Column) -> Column:
    return F.when((b == 0) | F.isnan(b) | F.isnan(a) | (F.abs(a) == INF), F.lit(NAN)).otherwise(F.try_mod(a, b))


def f_pow(a: Column, b: Column) -> Column:
    return F.pow(a, b)


def is_negative(a: Column) -> Column:
    """True for negative values and for -0.0."""
    return (a < 0) | ((a == 0) & (a.cast("string") == "-0.0"))


def _real(a: Column, b: Column) -> Column:
    return ~F.isnan(a) & ~F.isnan(b)


def f_eq(a: Column, b: Column) -> Column:
    return _real(a, b) & (a == b)


def f_ne(a: Column, b: Column) -> Column:
    return ~_real(a, b) | (a != b)


def f_lt(a: Column, b: Column) -> Column:
    return _real(a, b) & (a < b)


def f_le(a: Column, b: Column) -> Column:
    return _real(a, b) & (a <= b)


def f_gt(a: Column, b: Column) -> Column:
    return _real(a, b) & (a > b)


def f_ge(a: Column, b: Column) -> Column:
    return _real(a, b) & (a >= b)


COMPARE = {"==": f_eq, "!=": f_ne, "<": f_lt, "<=": f_le, ">": f_gt, ">=": f_ge}
ARITHMETIC = {"+": lambda a, b: a + b, "-": lambda a, b: a - b, "*": lambda a, b: a * b, "/": f_div, "%": f_mod, "^": f_pow, "atan2": F.atan2}


def f_max(v: Column) -> Column:
    """Aggregate that skips NaN unless there is nothing else."""
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.max(v))


def f_min(v: Column) -> Column:
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.min(v))


def f_sgn(v: Column) -> Column:
    """Sign, with 1 for +0 and -1 for -0."""
    return F.when(F.isnan(v), v).when(is_negative(v), F.lit(-1.0)).otherwise(F.lit(1.0))


def f_log(v: Column, base: Column | None = None) -> Column:
    log = F.ln(v) if base is None else F.log2(v) if base is LOG2 else F.log10(v)
    return F.when(v > 0, log).when(v == 0, F.lit(-INF)).otherwise(F.lit(NAN))


LOG2, LOG10 = object(), object()
UNARY = {
    "abs": F.abs,
    "ceil": lambda v: F.when(F.isnan(v) | (F.abs(v) == INF), v).otherwise(F.ceil(v).cast("double")),
    "floor": lambda v: F.when(F.isnan(v) | (F.abs(v) == INF), v).otherwise(F.floor(v).cast("double")),
    "exp": F.exp,
    "ln": f_log,
    "log2": lambda v: f_log(v, LOG2),
    "log10": lambda v: f_log(v, LOG10),
    "sqrt": F.sqrt,
    "sgn": f_sgn,
}


def rendered(v: Column) -> Column:
    """Text of a sample value: NaN, +Inf, -Inf, integers without a fraction."""
    whole = (F.abs(v) < 1e15) & (v == F.floor(v))
    return F.when(F.isnan(v), "NaN").when(v == INF, "+Inf").when(v == -INF, "-Inf").when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))
