"""String column helpers with the semantics of the Python string methods
the original tooling relies on, written once as regexes that both Spark
(Java regex) and DuckDB (RE2) accept verbatim."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts (str.strip()
# removes exactly these), and the line boundaries of str.splitlines().
PY_SPACE_CLASS = (
    r"[\t\n\x{0b}\x{0c}\r\x{1c}-\x{1f} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
PY_STRIP_RE = r"\A" + PY_SPACE_CLASS + r"+|" + PY_SPACE_CLASS + r"+\z"
SPLITLINES_RE = r"\r\n|[\n\r\x{0b}\x{0c}\x{1c}\x{1d}\x{1e}\x{85}\x{2028}\x{2029}]"
FILE_LINES_RE = r"\r\n|[\n\r]"
WS_RE = PY_SPACE_CLASS + "+"


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a bound lambda
    variable. Column expressions are trees: using a sub-expression twice
    would evaluate it twice (and nested reuse grows the tree
    exponentially)."""
    return F.element_at(F.transform(F.array(value), body), 1)


def py_strip(col) -> Column:
    """``str.strip()``: removes every Python whitespace character, which is
    wider than SQL ``trim`` (that only removes spaces). The regex only runs
    when the first or last character is whitespace."""
    def body(x):
        edge = F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(PY_SPACE_CLASS)
        return F.when(edge, F.regexp_replace(x, PY_STRIP_RE, "")).otherwise(x)
    return let(_c(col), body)


def _drop_last_empty(arr: Column) -> Column:
    return let(arr, lambda a: F.when(F.element_at(a, -1) == F.lit(""),
                                     F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(0)))).otherwise(a))


def split_lines(col, unicode_breaks: bool = True) -> Column:
    """Array of lines. ``unicode_breaks=True`` is ``str.splitlines()`` (breaks
    at VT, FF, FS/GS/RS, NEL, U+2028/9 too); False is file iteration
    (``\\n``, ``\\r``, ``\\r\\n`` only). A trailing break opens no extra line
    and an empty text has no lines."""
    pat = SPLITLINES_RE if unicode_breaks else FILE_LINES_RE
    return _drop_last_empty(F.split(_c(col), pat, -1))


def split_ws(col) -> Column:
    """``str.split()`` with no argument: strip, then split on whitespace
    runs; an all-blank text gives an empty array."""
    return let(py_strip(col), lambda s: F.when(s == F.lit(""), F.array().cast("array<string>"))
               .otherwise(F.split(s, WS_RE, -1)))


def prefix_before(col, sep: str) -> Column:
    """Text before the first ``sep`` (whole text when absent)."""
    return F.substring_index(_c(col), sep, 1)


# DuckDB twins, used to build the oracle SQL from the same constants.
def sql_py_strip(expr: str) -> str:
    return f"regexp_replace({expr}, '{PY_STRIP_RE}', '', 'g')"


def sql_split_lines(expr: str, unicode_breaks: bool = True) -> str:
    pat = SPLITLINES_RE if unicode_breaks else FILE_LINES_RE
    a = f"regexp_split_to_array({expr}, '{pat}')"
    return (f"(CASE WHEN {a}[-1] = '' THEN {a}[1:len({a}) - 1] ELSE {a} END)")


def sql_split_ws(expr: str) -> str:
    s = sql_py_strip(expr)
    return f"(CASE WHEN {s} = '' THEN []::VARCHAR[] ELSE regexp_split_to_array({s}, '{WS_RE}') END)"
