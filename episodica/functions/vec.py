"""Array-column helpers."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import Column, functions as F


def dbl(c: Column) -> Column:
    return c.cast("array<double>")


def zeros(n) -> Column:
    return F.array_repeat(F.lit(0.0), n)


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def sub(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * k)


def lerp(a: Column, b: Column, t: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + (y - x) * t)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def pad_to(a: Column, n: int, fill: float = 0.0) -> Column:
    """Right-pad to ``n`` entries; longer arrays are left alone."""
    return F.concat(a, F.array_repeat(F.lit(fill), F.greatest(F.lit(0), F.lit(n) - F.size(a))))


def safe_sequence(lo: Column, hi: Column) -> Column:
    """Ascending sequence; empty when ``lo > hi`` (Spark's own would count down)."""
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<bigint>"))


def at(a: Column, i: int) -> Column:
    """0-based element."""
    return F.get(a, F.lit(i))


def items(a: Column, idx: Sequence[int]) -> list[Column]:
    return [F.get(a, F.lit(i)) for i in idx]


def rpad_keep(c: Column, width: int) -> Column:
    """Right-pad with blanks; never cuts longer text."""
    return F.when(F.length(c) < width, F.rpad(c, width, " ")).otherwise(c)


def in_runs(i: Column, runs: Sequence[int]) -> Column:
    """Whether position ``i`` lies in a positive one of consecutive signed runs (2, -3: two in, three out)."""
    ends = list(accumulate(abs(r) for r in runs))
    inside = F.lit(False)
    for r, end in zip(runs, ends):
        if r > 0:
            inside = inside | ((i >= end - r) & (i < end))
    return inside


def on_runs(a: Column, other: Column, runs: Sequence[int], fn: Callable[[Column, Column], Column]) -> Column:
    """Apply ``fn(a_i, other_i)`` in the positive runs; other entries pass through."""
    return F.transform(a, lambda x, i: F.when(in_runs(i, runs), fn(x, F.coalesce(F.get(other, i), F.lit(0.0)))).otherwise(x))
