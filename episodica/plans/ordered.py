"""Ordered computations that stay parallel when one group holds most rows.

Spark sorts a window partition in one task.  An episode, stream or domain may
hold a third of a table, so no helper here sorts a whole group.  Groups are cut
into blocks of the order axis:

* ``number_rows``  row numbers: local number + offset of earlier blocks
* ``prefix``       running max / min / sum / last value: local value + carry
* ``halo``         bounded lag / lead frames: block + a few copied border rows

Groups that fit in one block pay one shuffle (``halo``) or one shuffle plus a
table of one row per group (``number_rows``, ``prefix``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

#: rows per block of a dense index
BLOCK_ROWS = 262_144

#: leading hex digits of a hash that name its block (65,536 uniform blocks)
HASH_DIGITS = 4


def hash_hex(*parts) -> Column:
    """md5 over '|'-joined parts: the reproducible pseudo-random order."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]))


def hash_block(hex_col: Column) -> Column:
    """Block id of a hash order: its leading hex digits."""
    return F.conv(F.substring(hex_col, 1, HASH_DIGITS), 16, 10).cast("int")


def hash_uniform(*parts) -> Column:
    """Uniform number in [0, 1) from the first eight hex digits of the hash."""
    return F.conv(F.substring(hash_hex(*parts), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)


def index_block(idx: str | Column, rows: int = BLOCK_ROWS) -> Column:
    col = F.col(idx) if isinstance(idx, str) else idx
    return F.floor(col / F.lit(rows))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi join on ``keys`` in which null equals null; the keys of ``left`` stay.

    ``how`` is inner, left, left_semi or left_anti.  Where ``left`` comes from a
    bucketed frame table (``plans.blocks``) and ``keys`` are its episode keys, the
    right side is brought to its buckets and the frames stay where they lie.
    """
    from episodica.plans.blocks import by_bucket

    return by_bucket(left, right, list(keys), how) or _join_same(left, right, keys, how)


def _join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    named = right.select(*[F.col(k).alias(f"__same{i}") for i, k in enumerate(keys)], *[c for c in right.columns if c not in keys])
    cond = None
    for i, k in enumerate(keys):
        c = F.col(k).eqNullSafe(F.col(f"__same{i}"))
        cond = c if cond is None else cond & c
    return left.join(named, cond, how).drop(*[f"__same{i}" for i in range(len(keys))])


def number_rows(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str | Column],
    block: Column | None,
    out: str = "rn",
    total: str | None = None,
) -> DataFrame:
    """0-based row number per ``keys`` in ``order``; ``block`` must be monotone in the order.

    Null keys form a group and a null block sorts first, like any other value.
    With ``block=None`` the group is bounded by construction and one window is
    used.  ``total`` also adds the size of each group.
    """
    keys = list(keys)
    if block is None:
        w = W.partitionBy(*keys)
        df = df.withColumn(out, F.row_number().over(w.orderBy(*order)).cast("long") - 1)
        return df.withColumn(total, F.count(F.lit(1)).over(w)) if total else df
    d = df.withColumn("__blk", block)
    sizes = d.groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__cnt"))
    wk = W.partitionBy(*keys).orderBy("__blk")
    offs = sizes.withColumn(
        "__off", F.coalesce(F.sum("__cnt").over(wk.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    if total:
        offs = offs.withColumn(total, F.sum("__cnt").over(W.partitionBy(*keys)))
    offs = offs.drop("__cnt")
    loc = d.withColumn("__lrn", F.row_number().over(W.partitionBy(*keys, "__blk").orderBy(*order)) - 1)
    return (
        join_same(loc, offs, [*keys, "__blk"])
        .withColumn(out, F.col("__lrn") + F.col("__off"))
        .drop("__lrn", "__off", "__blk")
    )


def draw_first(df: DataFrame, keys: Sequence[str], hex_col: str, count, out: str = "is_first") -> DataFrame:
    """Flag the first ``count(n)`` rows of every group of ``n`` rows in the order of a hash.

    Only counts per hash block are gathered; they name the block in which the
    draw ends, that block alone is ordered, and every other row is decided by its
    block.  Rows of equal hash (equal identities) stand or fall together.  Where a draw
    ends is one small row a group, evaluated at once, so the rows are not dealt by group.
    """
    from episodica.plans.small import lookup

    keys = list(keys)
    d = df.withColumn("__blk", hash_block(F.col(hex_col)))
    wk = W.partitionBy(*keys)
    sizes = d.groupBy(*keys, "__blk").agg(F.count(F.lit(1)).alias("__cnt"))
    sizes = sizes.withColumn("__before", F.sum("__cnt").over(wk.orderBy("__blk")) - F.col("__cnt")).withColumn("__n", F.sum("__cnt").over(wk))
    # the block that holds the last row drawn, and how many of its rows are drawn
    left = F.least(F.col("__n"), count(F.col("__n"))) - F.col("__before")
    cut = sizes.withColumn("__left", left).where((F.col("__left") > 0) & (F.col("__left") <= F.col("__cnt")))
    cut = lookup(cut.select(*keys, F.col("__blk").alias("__cut"), "__left"))
    inside = join_same(d.select(*keys, "__blk", F.col(hex_col).alias("__hex")), cut, keys).where("__blk = __cut")
    rank = F.row_number().over(W.partitionBy(*keys).orderBy("__hex"))
    last = inside.withColumn("__r", rank).where(F.col("__r") <= F.col("__left")).groupBy(*keys).agg(F.max("__cut").alias("__cut"), F.max("__hex").alias("__last"))
    d = join_same(d, lookup(last), keys, "left")
    first = (F.col("__blk") < F.col("__cut")) | ((F.col("__blk") == F.col("__cut")) & (F.col(hex_col) <= F.col("__last")))
    return d.withColumn(out, F.coalesce(first, F.lit(False))).drop("__blk", "__cut", "__last")


def hot_groups(df: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """Keys of groups above ``rows`` rows; there are at most ``count(df) / rows`` of them."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > rows).select(*keys)


def halo(
    df: DataFrame, keys: Sequence[str], idx: str, before: int = 0, after: int = 0, rows: int = BLOCK_ROWS
) -> tuple[DataFrame, "W", Column]:
    """Cut groups into blocks with copied border rows.

    ``idx`` must be the dense 0-based position in the group.  Returns the
    blocked rows, a window ordered by ``idx`` inside a block and the condition
    that drops the copies again.  A frame reaching ``before`` rows back and
    ``after`` rows ahead of a home row lies inside its block.
    """
    lo = F.greatest(F.lit(0), F.floor((F.col(idx) - F.lit(after)) / F.lit(rows)))
    hi = F.floor((F.col(idx) + F.lit(before)) / F.lit(rows))
    d = df.withColumn("__blk", F.explode(F.sequence(lo, hi)))
    w = W.partitionBy(*keys, "__blk").orderBy(idx)
    return d, w, F.col("__blk") == index_block(idx, rows)


_LOCAL = {"max": F.max, "min": F.min, "sum": F.sum}


def prefix(
    df: DataFrame,
    keys: Sequence[str],
    idx: str,
    specs: dict[str, tuple[str, Column]],
    current: bool = True,
    reverse: bool = False,
    rows: int = BLOCK_ROWS,
) -> DataFrame:
    """Running values over an unbounded frame, ``specs = {out: (kind, column)}``.

    Kinds: ``max``, ``min``, ``sum`` and ``last`` (latest non-null value).  The
    frame ends at the current row (``current``) or just before it, and runs from
    the end of the group when ``reverse``.
    """
    keys = list(keys)
    sgn = -1 if reverse else 1
    d = df.withColumn("__blk", index_block(idx, rows))
    for out, (_, c) in specs.items():
        d = d.withColumn(f"__v_{out}", c)
    ends = (W.unboundedPreceding, 0 if current else -1)
    order = (F.col(idx) * sgn).asc()
    wl = W.partitionBy(*keys, "__blk").orderBy(order).rowsBetween(*ends)
    wb = W.partitionBy(*keys).orderBy((F.col("__blk") * sgn).asc()).rowsBetween(W.unboundedPreceding, -1)

    aggs, carries = [], []
    for out, (kind, _) in specs.items():
        v = F.col(f"__v_{out}")
        if kind == "last":
            aggs.append(F.max_by(v, F.when(v.isNotNull(), F.col(idx) * sgn)).alias(f"__t_{out}"))
            carries.append(F.last(f"__t_{out}", ignorenulls=True).over(wb).alias(f"__c_{out}"))
        else:
            aggs.append(_LOCAL[kind](v).alias(f"__t_{out}"))
            carries.append(_LOCAL[kind](f"__t_{out}").over(wb).alias(f"__c_{out}"))
    carry = d.groupBy(*keys, "__blk").agg(*aggs).select(*keys, "__blk", *carries)

    for out, (kind, _) in specs.items():
        v = F.col(f"__v_{out}")
        d = d.withColumn(
            f"__l_{out}",
            F.last(v, ignorenulls=True).over(wl) if kind == "last" else _LOCAL[kind](v).over(wl),
        )
    d = join_same(d, carry, [*keys, "__blk"])
    for out, (kind, _) in specs.items():
        loc, car = F.col(f"__l_{out}"), F.col(f"__c_{out}")
        if kind == "last":
            val = F.coalesce(loc, car)
        elif kind == "sum":
            val = F.coalesce(loc + car, loc, car)
        else:
            val = F.greatest(loc, car) if kind == "max" else F.least(loc, car)
        d = d.withColumn(out, val)
    drop = ["__blk"] + [f"__{p}_{o}" for o in specs for p in "vlc"]
    return d.drop(*drop)


def explode_range(df: DataFrame, lo: Column, hi: Column, out: str, chunk: int = 65_536, spread: bool = False) -> DataFrame:
    """One row per integer in [lo, hi]; rows with ``lo > hi`` vanish.

    Two nested explodes keep each array short however wide the range is.  With
    ``spread`` the chunk starts are redistributed first, so one very wide row is
    expanded by many tasks.
    """
    d = df.withColumn("__lo", lo.cast("long")).withColumn("__hi", hi.cast("long")).where("__lo <= __hi")
    d = d.withColumn("__from", F.explode(F.sequence(F.col("__lo"), F.col("__hi"), F.lit(chunk).cast("long"))))
    if spread:
        d = d.repartition("__from", *[c for c, t in df.dtypes if t in ("string", "bigint", "int")])
    d = d.withColumn(
        out, F.explode(F.sequence(F.col("__from"), F.least(F.col("__hi"), F.col("__from") + F.lit(chunk - 1))))
    )
    return d.drop("__lo", "__hi", "__from")
