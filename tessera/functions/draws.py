"""Reproducible random draws as column expressions.

A draw is the first 32 bits of ``md5(key)`` scaled to [0, 1). The same
formula is writable in DuckDB SQL, which is what lets randomised operators
(masking, shuffles, order coins) be checked against an oracle. Never
``rand()`` (depends on partitioning) or ``xxhash64`` (no SQL twin).
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

try:
    from _md5 import md5            # a third of the time of hashlib's for short keys
except ImportError:
    from hashlib import md5

_TWO32 = 4294967296.0


def draw_key(*parts) -> Column:
    """``concat_ws(':', parts...)`` with every part cast to string."""
    cols = [p if isinstance(p, Column) else F.lit(p) for p in parts]
    return F.concat_ws(":", *[c.cast("string") for c in cols])


def uniform(*parts) -> Column:
    """U[0,1) draw keyed by ``parts``."""
    h = F.substring(F.md5(draw_key(*parts)), 1, 8)
    return F.conv(h, 16, 10).cast("bigint") / F.lit(_TWO32)


def uniforms(keys: list[bytes]) -> np.ndarray:
    """The draws of :func:`uniform` for whole keys, in a Python worker."""
    return np.frombuffer(b"".join([md5(k).digest() for k in keys]), ">u4")[::4] / _TWO32


def coin(*parts) -> Column:
    """0/1 draw with probability 1/2 (the per-pair order of TLM)."""
    return (uniform(*parts) < F.lit(0.5)).cast("int")


def randint(n: int | Column, *parts) -> Column:
    """Integer draw in [0, n)."""
    nn = n if isinstance(n, Column) else F.lit(n)
    return F.floor(uniform(*parts) * nn).cast("int")


def normal(*parts) -> Column:
    """Standard-normal draw (Box-Muller on two independent md5 draws)."""
    u1 = uniform(*parts, "n1")
    u2 = uniform(*parts, "n2")
    # 1 - u1 is in (0, 1] so the log is finite
    return F.sqrt(F.lit(-2.0) * F.log(F.lit(1.0) - u1)) * F.cos(F.lit(2 * math.pi) * u2)


def sql_uniform(key_sql: str) -> str:
    """DuckDB twin of :func:`uniform` for a key that is already a string."""
    return f"(CAST(('0x' || substr(md5({key_sql}), 1, 8)) AS BIGINT) / 4294967296.0)"


def sql_key(*parts: str) -> str:
    """DuckDB twin of :func:`draw_key`; parts are SQL expressions."""
    return "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts) + ")"
