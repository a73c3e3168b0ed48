"""Frame tables that lie in buckets, and joins that leave them there.

A stored frame table has two more columns: ``ep_key``, one text for the keys of an
episode (nulls included, so that plain equality is null-safe), and ``ep_block``, the
block of the frame index.  The table is bucketed and sorted by the two.  An episode
that holds a third of all rows is spread over the buckets by its blocks.

What a join brings to the frames is a table of episodes.  It is small beside them, so
it is listed once for every block of an episode and moved to the buckets; the frames
are not shuffled.  The list of blocks comes from the buckets as well (its
aggregation needs no exchange of frames).  Operators that re-number or drop frames
keep the two columns, which then still say where a row lies.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from episodica.plans.ordered import BLOCK_ROWS

KEY, BLOCK = "ep_key", "ep_block"


def episode_key(keys: Sequence[str]) -> Column:
    """One text for several keys; equal exactly if all keys are, null being equal to null."""
    parts = []
    for k in keys:
        v = F.col(k).cast("string")
        parts.append(F.when(v.isNull(), F.lit("-")).otherwise(F.concat(F.length(v).cast("string"), F.lit(":"), v)))
    return F.concat(*parts)


def place(frames: DataFrame, keys: Sequence[str], rows: int = BLOCK_ROWS) -> DataFrame:
    """Add the two columns of a stored frame table; the key remembers which keys it stands for."""
    at = F.floor(F.col("frame_idx") / F.lit(rows)).cast("long")
    d = frames.withColumn(KEY, episode_key(keys)).withColumn(BLOCK, F.coalesce(at, F.lit(-1).cast("long")))
    return d.withMetadata(KEY, {"episode_keys": json.dumps(list(keys)), "rows": rows})


def stored_keys(frames: DataFrame) -> list[str] | None:
    """The episode keys that a frame table is stored by, or None."""
    if KEY not in frames.columns or BLOCK not in frames.columns:
        return None
    named = frames.schema[KEY].metadata.get("episode_keys")
    return json.loads(named) if named else None


def narrow(frames: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Keys and ``cols`` only, with the place of stored frames."""
    stored = [KEY, BLOCK] if stored_keys(frames) == list(keys) else []
    return frames.select(*keys, *dict.fromkeys(c for c in cols if c not in keys), *stored)


def by_bucket(frames: DataFrame, table: DataFrame, keys: list[str], how: str) -> DataFrame | None:
    """Join a table of episodes to stored frames in their buckets; None for other frames.

    ``keys`` may be the stored keys in any order.  ``table`` may have several rows of an
    episode, like the right side of any join.
    """
    stored = stored_keys(frames)
    if stored is None or sorted(stored) != sorted(keys) or KEY in table.columns:
        return None
    blocks = frames.groupBy(KEY, BLOCK).agg(F.lit(1).alias("__one")).drop("__one")
    brought = table.withColumn("__ep", episode_key(stored)).drop(*keys)
    brought = blocks.withColumnRenamed(BLOCK, "__block").join(brought, F.col(KEY) == F.col("__ep")).drop(KEY)
    cond = (F.col(KEY) == F.col("__ep")) & (F.col(BLOCK) == F.col("__block"))
    return frames.join(brought, cond, how).drop("__ep", "__block")

