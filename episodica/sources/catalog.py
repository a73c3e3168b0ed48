"""Dataset catalogs, task settings and persisted statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

ENTRY = (
    "array<struct<name:string,path:string,use_trajectory_ratio:double,"
    "norm_stats_domain_name:string,enabled:boolean,config_index:bigint>>"
)
CATALOG_SCHEMA = f"datasets {ENTRY}, default_use_trajectory_ratio double"


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """JSON catalog -> name, path, use_trajectory_ratio, norm_domain, config_index.

    Disabled entries are dropped.  A missing ratio takes the file's default
    (else 1.0), a missing name the last path part, a missing norm domain the name.
    """
    raw = spark.read.schema(CATALOG_SCHEMA).option("multiLine", True).json(path)
    d = raw.select("default_use_trajectory_ratio", F.posexplode("datasets").alias("__at", "e"))
    # an entry of a catalog in several documents says its own place
    at = F.coalesce(F.col("e.config_index"), F.col("__at").cast("bigint"))
    return resolve_catalog(d.select(at.alias("config_index"), F.col("e").dropFields("config_index").alias("e"), "default_use_trajectory_ratio").select("config_index", "e.*", "default_use_trajectory_ratio"))


def resolve_catalog(entries: DataFrame) -> DataFrame:
    """Apply the catalog defaults to rows with the raw entry columns."""
    last = F.element_at(F.split(F.regexp_replace("path", "/+$", ""), "/"), -1)
    name = F.coalesce(F.col("name"), last)
    return entries.where(F.coalesce(F.col("enabled"), F.lit(True))).select(
        name.alias("name"),
        "path",
        F.coalesce("use_trajectory_ratio", "default_use_trajectory_ratio", F.lit(1.0)).alias("use_trajectory_ratio"),
        F.coalesce(F.col("norm_stats_domain_name"), name).alias("norm_domain"),
        F.col("config_index").cast("bigint").alias("config_index"),
    )


def write_catalog_parts(catalog: DataFrame, path: str, default_ratio: float = 1.0, per_document: int = 1000) -> None:
    """A long catalog as many JSON documents of ``per_document`` entries, each a file, written in parallel."""
    part = F.floor(F.col("config_index") / per_document).alias("part")
    entry = F.struct(
        "config_index", "name", "path", "use_trajectory_ratio",
        F.col("norm_domain").alias("norm_stats_domain_name"), F.lit(True).alias("enabled"),
    )
    doc = catalog.groupBy(part).agg(F.array_sort(F.collect_list(entry)).alias("datasets"))
    doc = doc.select("part", F.to_json(F.struct("datasets", F.lit(default_ratio).alias("default_use_trajectory_ratio"))).alias("value"))
    # a folder per document, so that no file holds two
    doc.write.mode("overwrite").partitionBy("part").text(path)


def write_catalog(catalog: DataFrame, path: str, default_ratio: float = 1.0) -> None:
    """One JSON document with all entries, in config order (catalogs list folders, so few rows)."""
    entry = F.struct(
        "config_index", "name", "path", "use_trajectory_ratio",
        F.col("norm_domain").alias("norm_stats_domain_name"), F.lit(True).alias("enabled"),
    )
    doc = catalog.agg(F.array_sort(F.collect_list(entry)).alias("datasets")).select(
        F.transform("datasets", lambda e: e.dropFields("config_index")).alias("datasets"),
        F.lit(default_ratio).alias("default_use_trajectory_ratio"),
    )
    doc.select(F.to_json(F.struct("*")).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def dedupe_catalog(catalog: DataFrame) -> DataFrame:
    """Map each entry to the first entry with the same (path, ratio, norm domain).

    Adds ``representative`` (config index) and ``is_representative``.
    """
    w = W.partitionBy("path", "use_trajectory_ratio", "norm_domain")
    return catalog.withColumn("representative", F.min("config_index").over(w)).withColumn(
        "is_representative", F.col("representative") == F.col("config_index")
    )


def pick_representative(catalog: DataFrame) -> DataFrame:
    """Per norm domain the entry with the highest ratio; the first one wins ties."""
    best = F.struct(F.col("use_trajectory_ratio"), -F.col("config_index"))
    return catalog.groupBy("norm_domain").agg(F.max_by(F.struct(*catalog.columns), best).alias("e")).select("e.*")


def task_settings_filter(frames: DataFrame, settings: DataFrame, instructions: DataFrame, wrist_cols=()) -> DataFrame:
    """Apply per-task settings: camera set and default instruction.

    Tasks without a setting use the head camera; wrist camera columns survive
    only for ``camera_type = 'all'``.  The task's default instruction, else the
    task name with blanks, is added as ``instruction``.
    """
    d = frames.join(settings.select("task", "camera_type"), "task", "left")
    d = d.join(instructions.select("task", F.col("instruction").alias("__ins")), "task", "left")
    d = d.withColumn("camera_type", F.coalesce("camera_type", F.lit("head")))
    for c in wrist_cols:
        d = d.withColumn(c, F.when(F.col("camera_type") == "all", F.col(c)))
    return d.withColumn("instruction", F.coalesce("__ins", F.regexp_replace("task", "_", " "))).drop("__ins")


def stats_to_json(stats: DataFrame, keys=("domain", "key")) -> DataFrame:
    """Long statistics (keys, dim, lo, hi, mode) -> one JSON document per key.

    ``mode`` marks string entries such as ``ignore``; numeric entries become
    lists ordered by dim (a few hundred dims at most).
    """
    ordered = F.array_sort(F.collect_list(F.when(F.col("mode").isNull(), F.struct("dim", "lo", "hi"))))
    doc = stats.groupBy(*keys).agg(ordered.alias("p"), F.max("mode").alias("mode"))
    return doc.select(
        *keys,
        F.when(F.col("mode").isNotNull(), F.to_json(F.struct("mode")))
        .otherwise(F.to_json(F.struct(
            F.transform("p", lambda e: e["lo"]).alias("lo"), F.transform("p", lambda e: e["hi"]).alias("hi"))))
        .alias("doc"),
    )


def stats_from_json(docs: DataFrame, keys=("domain", "key")) -> DataFrame:
    """Parse :func:`stats_to_json` documents back to the long table."""
    s = docs.withColumn("s", F.from_json("doc", "struct<mode:string,lo:array<double>,hi:array<double>>"))
    num = s.where(F.col("s.mode").isNull()).select(
        *keys, F.posexplode(F.arrays_zip("s.lo", "s.hi")).alias("dim", "z")
    ).select(*keys, F.col("dim").cast("bigint").alias("dim"), "z.lo", "z.hi", F.lit(None).cast("string").alias("mode"))
    txt = s.where(F.col("s.mode").isNotNull()).select(
        *keys, F.lit(None).cast("bigint").alias("dim"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.col("s.mode").alias("mode"))
    return num.unionByName(txt)
