"""Deterministic pseudo-random draws from md5, identical in any SQL engine."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(seed: int | Column, tag: str, key: str | Column) -> Column:
    """32 hex digits that depend only on (seed, tag, key)."""
    seed_c = F.lit(str(seed)) if isinstance(seed, int) else seed.cast("string")
    key_c = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat_ws("|", seed_c, F.lit(tag), key_c.cast("string")))


def draw_int(hex_col: Column, start: int = 1, digits: int = 8) -> Column:
    """Non-negative integer from a slice of a draw."""
    return F.conv(F.substring(hex_col, start, digits), 16, 10).cast("bigint")


def draw_unit(hex_col: Column, start: int = 1) -> Column:
    """Uniform double in [0, 1)."""
    return draw_int(hex_col, start, 8) / F.lit(4294967296.0)


def pick(values: list, index: Column) -> Column:
    """values[index] for a zero-based integer column."""
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))
