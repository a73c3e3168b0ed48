"""Frame tables: indexing, scanning, appending, validating, reading back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F
from pyspark.sql.types import ArrayType, StructType

from episodica.plans.ordered import hot_groups, join_same, number_rows
from episodica.plans.small import lookup

EPISODE = ("domain", "file_id", "episode_id")

#: rows of one episode that a single sort task may number
HOT_EPISODE_ROWS = 5_000_000


def index_frames(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column,
    hot_rows: int = HOT_EPISODE_ROWS,
    out: str = "frame_idx",
) -> DataFrame:
    """Add the dense 0-based position of a row in its episode.

    Episodes above ``hot_rows`` rows are numbered block by block (``block`` is
    any expression monotone in the order, e.g. the minute of the time stamp);
    the rest in one window.  The count that finds them reads the keys only.
    Null keys form an episode; the result is the same for every ``hot_rows``.
    """
    hot = lookup(hot_groups(df, keys, hot_rows))
    if hot.isEmpty():
        return number_rows(df, keys, order, None, out)
    flagged = join_same(df, hot.withColumn("__hot", F.lit(True)), list(keys), "left")
    blk = F.when(F.col("__hot"), block.cast("double")).otherwise(F.lit(0.0))
    return number_rows(flagged, keys, order, blk, out).drop("__hot")


def scan_frames(spark: SparkSession, catalog: DataFrame, schema: StructType | str | None = None) -> DataFrame:
    """Read every enabled domain folder of a catalog, one row per frame.

    Adds ``domain`` (catalog name) and ``source_file``.  Missing columns are
    NULL.  Catalog rows name folders, so there are few of them; the paths are
    what the driver needs to plan the scan.
    """
    entries = catalog.orderBy("config_index").select("name", "path").collect()
    parts = []
    by_path: dict[str, list[str]] = {}
    for e in entries:
        by_path.setdefault(e.path, []).append(e.name)
    for path, names in by_path.items():
        # without a schema the columns of all files count, not those of one
        reader = spark.read.schema(schema) if schema is not None else spark.read.option("mergeSchema", "true")
        d = reader.option("recursiveFileLookup", "false").parquet(path)
        d = d.withColumn("source_file", F.col("_metadata.file_path"))
        d = d.drop("domain") if "domain" in d.columns else d
        parts.append(d.withColumn("domain", F.explode(F.array(*[F.lit(n) for n in names]))))
    if not parts:
        # no folder, no columns but those that a scan adds and those that were asked for
        empty = spark.createDataFrame([], schema) if schema is not None else spark.createDataFrame([], "domain string")
        return empty.drop("domain").withColumns({"source_file": F.lit(None).cast("string"), "domain": F.lit(None).cast("string")})
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def file_numbers(frames: DataFrame, per_file: int = 100, written: DataFrame | None = None, episodes: DataFrame | None = None) -> DataFrame:
    """Assign ``file_no = floor(episode position in the domain / per_file)``.

    ``written`` (domain, next_seq) tells where the numbering of a domain goes on;
    ``episodes`` (domain, episode_id) are those of ``frames``, where a caller has them.
    """
    eps = episodes if episodes is not None else frames.select("domain", "episode_id").distinct()
    eps = number_rows(eps, ["domain"], ["episode_id"], F.floor(F.col("episode_id") / 100_000), "episode_seq")
    if written is not None:
        eps = join_same(eps, written, ["domain"], "left")
        eps = eps.withColumn("episode_seq", F.col("episode_seq") + F.coalesce("next_seq", F.lit(0))).drop("next_seq")
    eps = eps.withColumn("file_no", F.floor(F.col("episode_seq") / per_file))
    return join_same(frames, eps, ["domain", "episode_id"])


def highest_episodes(spark: SparkSession, path: str) -> DataFrame | None:
    """(domain, next_seq) of a written frame table, or None where nothing is written yet."""
    try:
        written = spark.read.parquet(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise
    return written.groupBy("domain").agg((F.max("episode_seq") + 1).alias("next_seq"))


def append_episodes(frames: DataFrame, path: str, per_file: int = 100) -> None:
    """Append whole episodes, ``per_file`` episodes to a logical file, one folder per domain.

    Numbers go on where the last append of the domain ended, so a file that is not
    full is filled up.
    ``file_no`` is a clustered column rather than a folder: row-group statistics
    prune on it without a tiny file per hundred episodes.  The rebalance hint lets
    Spark merge small groups and split a huge one over several tasks.
    """
    out = file_numbers(frames, per_file, highest_episodes(frames.sparkSession, path))
    (
        out.hint("rebalance", "domain", "file_no")
        .sortWithinPartitions("domain", "file_no", "episode_seq", "frame_idx")
        .write.mode("append").partitionBy("domain").parquet(path)
    )


def _sizes(a: Column, kind: ArrayType) -> list[tuple[Column, Column]]:
    """(smallest, largest) size at each level of a nested array; null where there is none."""
    size = F.when(a.isNotNull(), F.size(a))
    out = [(size, size)]
    while isinstance(kind.elementType, ArrayType):
        kind = kind.elementType
        inner = F.transform(a, lambda x: F.when(x.isNotNull(), F.size(x)))
        out.append((F.array_min(inner), F.array_max(inner)))
        a = F.flatten(F.filter(a, lambda x: x.isNotNull()))
    return out


def validate_frames(frames: DataFrame, arrays: Sequence[str], episode_ends: DataFrame | None = None) -> DataFrame:
    """Violations as (domain, file_id, key, rule).

    Rules: ``shape`` a key has more than one trailing shape in a file (sizes at
    every level of a nested array);
    ``length`` a key is present in some frames of a file only (unequal lengths);
    ``end`` the number of frames differs from the last recorded episode end.
    Only counts, minima and maxima cross the shuffle.
    """
    aggs, levels = [F.count(F.lit(1)).alias("n")], {}
    for a in arrays:
        aggs.append(F.count(F.col(a)).alias(f"n_{a}"))
        for level, (low, high) in enumerate(_sizes(F.col(a), frames.schema[a].dataType)):
            aggs += [F.min(low).alias(f"min_{level}_{a}"), F.max(high).alias(f"max_{level}_{a}")]
            levels[a] = level + 1
    g = frames.groupBy("domain", "file_id").agg(*aggs)
    checks = []
    for a in arrays:
        uneven = F.lit(False)
        for level in range(levels[a]):
            uneven = uneven | F.coalesce(F.col(f"min_{level}_{a}") != F.col(f"max_{level}_{a}"), F.lit(False))
        checks.append(F.when(uneven, F.struct(F.lit(a).alias("key"), F.lit("shape").alias("rule"))))
        checks.append(F.when((F.col(f"n_{a}") > 0) & (F.col(f"n_{a}") != F.col("n")),
                             F.struct(F.lit(a).alias("key"), F.lit("length").alias("rule"))))
    if episode_ends is not None:
        ends = episode_ends.groupBy("domain", "file_id").agg(F.max("episode_end").alias("__end"))
        g = join_same(g, ends, ["domain", "file_id"], "left")
        checks.append(F.when(~F.col("n").eqNullSafe(F.col("__end")),
                             F.struct(F.lit("episode_ends").alias("key"), F.lit("end").alias("rule"))))
    bad = g.withColumn("v", F.explode(F.array_compact(F.array(*checks))))
    return bad.select("domain", "file_id", "v.key", "v.rule")


def step_slice(frames: DataFrame, start: int, stop: int, step: int = 1, idx: str = "frame_idx") -> DataFrame:
    """Rows ``[start:stop:step]`` of every episode."""
    i = F.col(idx)
    return frames.where((i >= start) & (i < stop) & ((i - start) % step == 0))


def _newest(frames: DataFrame) -> DataFrame:
    return frames.groupBy("domain", "file_id").agg(F.max("episode_id").alias("episode_id"))


def drop_last_episode(frames: DataFrame) -> DataFrame:
    """Remove the newest episode of every file."""
    return join_same(frames, _newest(frames), EPISODE, "left_anti")


def pop_episode(frames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(newest episode per file, the rest)."""
    last = join_same(frames, _newest(frames), EPISODE, "left_semi")
    return last, drop_last_episode(frames)


def discover_inputs(
    listing: DataFrame,
    path_regex: str,
    excluded: Sequence[str] = (),
    allow: Sequence[str] | None = None,
    max_sources: int | None = None,
) -> DataFrame:
    """Raw paths -> (path, task, source, episode_no), in numeric episode order.

    ``path_regex`` captures task, source and episode stem.  A stem that is not a
    number sorts as 0.  Paths with an ``excluded`` folder are skipped, tasks can
    be limited to ``allow`` and sources per task to the first ``max_sources``.
    """
    d = listing.where(F.regexp_extract("path", path_regex, 0) != "")
    parts = F.split("path", "/")
    for e in excluded:
        d = d.where(~F.array_contains(parts, e))
    stem = F.regexp_extract("path", path_regex, 3)
    d = d.select(
        "path",
        F.regexp_extract("path", path_regex, 1).alias("task"),
        F.regexp_extract("path", path_regex, 2).alias("source"),
        F.coalesce(stem.try_cast("bigint"), F.lit(0).cast("bigint")).alias("episode_no"),
    )
    if allow is not None:
        d = d.where(F.col("task").isin(list(allow)))
    if max_sources is not None:
        # rank the distinct sources, not the rows
        s = d.select("task", "source").distinct()
        s = s.withColumn("__r", F.row_number().over(W.partitionBy("task").orderBy("source")))
        d = d.join(s.where(F.col("__r") <= max_sources).drop("__r"), ["task", "source"], "left_semi")
    return d
