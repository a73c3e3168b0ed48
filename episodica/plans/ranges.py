"""Range joins with an equi key, so no nested-loop join is planned.

A range is cut into pieces by aligned blocks of ``width`` places.  Its two ends lie in
one block each and are compared place by place; the whole blocks between them form
aligned runs of 1, 2, 4, ... blocks, at most two of each length.  A range of n places
so adds at most 2 + 2 log2(n / width) rows, and a point looks in its own block and,
for every length that occurs, in the run that holds it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from episodica.plans.ordered import number_rows, prefix

#: doublings that a run of blocks can have
LEVELS = 52

#: places of a key that lie in one block when its ranges are merged
MERGE_SPAN = 1 << 20

_PIECE = "struct<level:int,at:bigint,lo:bigint,hi:bigint>"


def pieces(lo: Column, hi: Column, width: int) -> Column:
    """The pieces of ``[lo, hi)``: array<struct<level, at, lo, hi>>; level -1 is an end, level k a run of 2^k whole blocks."""
    lo, hi = lo.cast("long"), hi.cast("long")
    whole_lo, whole_hi = F.ceil(lo / width).cast("long"), F.floor(hi / width).cast("long")
    piece = lambda level, at, a, b: F.struct(level.cast("int").alias("level"), at.cast("long").alias("at"), a.cast("long").alias("lo"), b.cast("long").alias("hi"))
    end = F.lit(-1)
    # one block or less, or two ends without a whole block between them
    head = F.when(lo < whole_lo * width, piece(end, whole_lo - 1, lo, F.least(hi, whole_lo * width)))
    tail = F.when((hi > whole_hi * width) & (whole_hi >= whole_lo), piece(end, whole_hi, F.greatest(lo, whole_hi * width), hi))
    none = F.array().cast(f"array<{_PIECE}>")

    def run(acc: Column, k: Column) -> Column:
        a, b = acc["a"], acc["b"]
        more = a < b
        odd_a, odd_b = more & (a % 2 == 1), more & (b % 2 == 1) & (a + F.when(a % 2 == 1, 1).otherwise(0) < b)
        size = F.pow(F.lit(2.0), k).cast("long") * width
        first = F.when(odd_a, F.array(piece(k, a, a * size, (a + 1) * size))).otherwise(none)
        last = F.when(odd_b, F.array(piece(k, b - 1, (b - 1) * size, b * size))).otherwise(none)
        a2, b2 = F.when(odd_a, a + 1).otherwise(a), F.when(odd_b, b - 1).otherwise(b)
        return F.struct(
            F.when(more, F.floor(a2 / 2)).otherwise(a).cast("long").alias("a"), F.when(more, F.floor(b2 / 2)).otherwise(b).cast("long").alias("b"),
            F.concat(acc["p"], first, last).alias("p"),
        )

    start = F.struct(whole_lo.alias("a"), F.greatest(whole_lo, whole_hi).alias("b"), none.alias("p"))
    middle = F.aggregate(F.sequence(F.lit(0), F.lit(LEVELS)), start, run, lambda acc: acc["p"])
    return F.concat(F.array_compact(F.array(head, tail)), middle)


def merged(ranges: DataFrame, keys: Sequence[str], lo: str, hi: str) -> DataFrame:
    """Disjoint ranges that cover the same places, per ``keys``; ranges that touch become one."""
    keys = list(keys)
    d = ranges.select(*keys, F.col(lo).cast("long").alias("lo"), F.col(hi).cast("long").alias("hi")).where("lo < hi")
    d = number_rows(d, keys, ["lo", "hi"], F.floor(F.col("lo") / MERGE_SPAN), "__i")
    d = prefix(d, keys, "__i", {"__to": ("max", F.col("hi"))}, current=False)
    opens = (F.col("__to").isNull() | (F.col("lo") > F.col("__to"))).cast("long")
    d = prefix(d.withColumn("__o", opens), keys, "__i", {"__run": ("sum", F.col("__o"))})
    return d.groupBy(*keys, "__run").agg(F.min("lo").alias(lo), F.max("hi").alias(hi)).drop("__run")


def range_join(
    points: DataFrame,
    ranges: DataFrame,
    keys: Sequence[str],
    point: str,
    lo: str,
    hi: str,
    width: int = 4096,
    how: str = "inner",
) -> DataFrame:
    """Join points to half-open ranges ``[lo, hi)`` of the same ``keys``; null keys are keys.

    ``how`` is ``inner`` (a row per point and range) or ``left_semi``.
    """
    keys = list(keys)
    if how == "left_semi":
        # disjoint ranges: a point lies in one piece at most
        ranges = merged(ranges, keys, lo, hi)
    r = ranges.where(F.col(lo) < F.col(hi)).withColumn("__piece", F.explode(pieces(F.col(lo), F.col(hi), width)))
    r = r.select(
        *[F.col(k).alias(f"__r_{k}") for k in keys], *[c for c in ranges.columns if c not in keys], F.col("__piece.level").alias("__level"),
        F.col("__piece.at").alias("__at"), F.col("__piece.lo").alias("__lo"), F.col("__piece.hi").alias("__hi"),
    )
    # the lengths that occur, at most LEVELS + 2 numbers
    levels = sorted(x[0] for x in r.select("__level").distinct().collect())
    block = F.floor(F.col(point) / width)
    looks = [F.struct(F.lit(k).alias("level"), (block if k < 0 else F.floor(block / F.lit(float(1 << k)))).cast("long").alias("at")) for k in levels]
    if len(levels) <= 1:
        p = points.withColumn("__look", looks[0] if levels else F.struct(F.lit(-1).alias("level"), F.lit(0).cast("long").alias("at")))
    else:
        p = points.withColumn("__look", F.explode(F.array(*looks)))
    cond = (F.col("__look.level") == F.col("__level")) & (F.col("__look.at") == F.col("__at"))
    cond = cond & (F.col(point) >= F.col("__lo")) & (F.col(point) < F.col("__hi"))
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"__r_{k}"))
    out = p.join(r, cond, how)
    return out.drop("__look", "__level", "__at", "__lo", "__hi", *[f"__r_{k}" for k in keys])
