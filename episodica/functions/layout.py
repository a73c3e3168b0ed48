"""The packed vector layout: block names, widths and positions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

POSE_DIM, ARM_DIM, HAND_SLOTS, SUPP_DIM = 9, 7, 32, 15
SIDE_DIM = POSE_DIM + ARM_DIM + HAND_SLOTS
GRIPPER_SLOT = 28
AREAS_PER_HAND = 24
ACTION_HORIZON = 32

# Fixed order of the blocks: right side, left side, head, supplementary.
BLOCKS = [
    ("right-wrist-pos", 3), ("right-wrist-rot", 6), ("right-arm-joints", ARM_DIM), ("right-hand-joints", HAND_SLOTS),
    ("left-wrist-pos", 3), ("left-wrist-rot", 6), ("left-arm-joints", ARM_DIM), ("left-hand-joints", HAND_SLOTS),
    ("head-track-pos", 3), ("head-track-rot", 6), ("supplementary-joints", SUPP_DIM),
]
WIDTH = sum(w for _, w in BLOCKS)


def block_ranges() -> list[tuple[str, int, int]]:
    out, at = [], 0
    for name, width in BLOCKS:
        out.append((name, at, at + width))
        at += width
    return out


def block_of(dim: Column) -> Column:
    """Block name of a vector position (no join needed)."""
    c = None
    for name, lo, hi in block_ranges():
        cond = (dim >= lo) & (dim < hi)
        c = F.when(cond, name) if c is None else c.when(cond, name)
    return c


def block_offset(dim: Column) -> Column:
    c = None
    for _, lo, hi in block_ranges():
        cond = (dim >= lo) & (dim < hi)
        c = F.when(cond, dim - lo) if c is None else c.when(cond, dim - lo)
    return c


def dim_label(dim: Column) -> Column:
    return F.concat(block_of(dim), F.lit("-"), block_offset(dim).cast("string"))


def dims_catalog(spark: SparkSession) -> DataFrame:
    """(dim, block, label) of every vector position."""
    d = F.col("id")
    return spark.range(WIDTH).select(d.alias("dim"), block_of(d).alias("block"), dim_label(d).alias("label"))


def shared_dims(mode: str) -> list[int]:
    """Positions fitted over all domains; the others are fitted per domain.

    ``joint`` shares the wrist and head poses, ``all`` nothing, ``none`` everything.
    """
    if mode == "all":
        return []
    if mode == "none":
        return list(range(WIDTH))
    if mode == "joint":
        s = SIDE_DIM
        return [*range(0, 9), *range(s, s + 9), *range(2 * s, 2 * s + 9)]
    raise ValueError(f"unknown independent norm mode {mode}")
