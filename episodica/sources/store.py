"""Stored frame tables: written once by episode, joined ever after without moving a frame."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from episodica.plans.blocks import BLOCK, KEY, place
from episodica.plans.ordered import BLOCK_ROWS
from episodica.sources.frames import EPISODE

#: rows for which a bucket is made
BUCKET_ROWS = 2_000_000


def store_frames(
    frames: DataFrame,
    name: str,
    path: str | None = None,
    keys: Sequence[str] = EPISODE,
    buckets: int | None = None,
    block_rows: int = BLOCK_ROWS,
    mode: str = "errorifexists",
) -> DataFrame:
    """Write frames as a table bucketed and sorted by episode and block, and return it.

    ``frames`` has ``keys`` and the dense ``frame_idx``.  Every bucket is one file, so a
    reader finds it sorted.  ``buckets`` defaults to one for BUCKET_ROWS rows; tables
    that are joined to each other should have the same number.  ``path`` makes it an
    external table.  Null keys are episodes like any other.
    """
    placed = place(frames, keys, block_rows)
    n = buckets or max(1, -(-frames.count() // BUCKET_ROWS))
    # the same hash deals rows to tasks and to buckets: one file each
    dealt = placed.repartition(n, KEY, BLOCK).sortWithinPartitions(KEY, BLOCK, "frame_idx")
    out = dealt.write.mode(mode).format("parquet").bucketBy(n, KEY, BLOCK).sortBy(KEY, BLOCK, "frame_idx")
    if path is not None:
        out = out.option("path", path)
    out.saveAsTable(name)
    return open_frames(frames.sparkSession, name)


def open_frames(spark: SparkSession, name: str) -> DataFrame:
    """A stored frame table; operators with its keys join it bucket by bucket."""
    return spark.table(name)
