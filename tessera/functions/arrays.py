"""Array column expressions: JVM-side higher-order functions, no Python per
row. Spark interprets them outside whole-stage code generation, so whatever
does not depend on the element is bound once with ``let``: a value used inside
a lambda is otherwise computed again for every element."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def as_double(vec) -> Column:
    return _c(vec).cast("array<double>")


def sum_sq(vec) -> Column:
    return F.aggregate(as_double(vec), F.lit(0.0), lambda acc, x: acc + x * x)


def l2_norm(vec) -> Column:
    return F.sqrt(sum_sq(vec))


def l2_normalize(vec) -> Column:
    """``v / ||v||``; a zero vector stays null (division by zero)."""
    return let(l2_norm(vec), lambda n: F.when(n > 0, F.transform(as_double(vec), lambda x: x / n)))


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(as_double(a), as_double(b), lambda x, y: x * y),
                       F.lit(0.0), lambda acc, x: acc + x)


def l2_distance(a, b) -> Column:
    d = F.zip_with(as_double(a), as_double(b), lambda x, y: (x - y) * (x - y))
    return F.sqrt(F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x))


def argmax(arr):
    """0-based index of the first maximum (``numpy.argmax`` tie rule). An Arrow
    array of equally long lists, none empty, gives an Arrow array."""
    if isinstance(arr, pa.Array):
        width = len(arr.flatten()) // max(len(arr), 1)
        if not pc.all(pc.equal(pc.list_value_length(arr), width)).as_py() and len(arr):
            raise ValueError("lists of different lengths")
        return pa.array(arr.flatten().to_numpy(zero_copy_only=False).reshape(len(arr), -1 if len(arr) else 1).argmax(axis=1).astype("int32"))
    a = _c(arr)
    return (F.array_position(a, F.array_max(a)) - 1).cast("int")


def logsumexp(arr) -> Column:
    """Max-shifted log-sum-exp in double precision."""
    return let(as_double(arr), lambda a: let(F.array_max(a), lambda m: m + F.log(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + F.exp(x - m)))))


def pad_fixed(arr, n: int | Column, value, left: bool = False) -> Column:
    """Pad ``arr`` with ``value`` up to length ``n`` (never truncates)."""
    a = _c(arr)
    nn = n if isinstance(n, Column) else F.lit(n)
    fill = F.array_repeat(F.lit(value) if not isinstance(value, Column) else value,
                          F.greatest(nn - F.size(a), F.lit(0)).cast("int"))
    return F.concat(fill, a) if left else F.concat(a, fill)


def truncate(arr, n: int | Column) -> Column:
    nn = n if isinstance(n, Column) else F.lit(n)
    return F.slice(_c(arr), 1, nn)


def ones_like(arr, value: int = 1) -> Column:
    return F.array_repeat(F.lit(value), F.size(_c(arr)))


# DuckDB twins ---------------------------------------------------------------

def sql_sum_sq(expr: str) -> str:
    return f"list_sum(list_transform(CAST({expr} AS DOUBLE[]), lambda x: x * x))"


def sql_l2_normalize(expr: str) -> str:
    n = f"sqrt({sql_sum_sq(expr)})"
    return f"(CASE WHEN {n} > 0 THEN list_transform(CAST({expr} AS DOUBLE[]), lambda x: x / {n}) END)"


def sql_l2_distance(a: str, b: str) -> str:
    return (f"sqrt(list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), "
            f"lambda p: (p[1] - p[2]) * (p[1] - p[2]))))")


def sql_dot(a: str, b: str) -> str:
    return (f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), "
            f"lambda p: p[1] * p[2]))")


def sql_argmax(expr: str) -> str:
    return f"CAST(list_position({expr}, list_max({expr})) - 1 AS INTEGER)"
