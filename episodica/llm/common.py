"""Small column helpers shared by the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: words: runs of anything but ASCII white space
WORD = r"[^\x20\x09-\x0D]+"

AZ = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def n_words(text: str | Column) -> Column:
    """Number of words of a text; null has none."""
    col = F.col(text) if isinstance(text, str) else text
    return F.coalesce(F.regexp_count(col, F.lit(WORD)), F.lit(0)).cast("long")


def hash_unit(*parts: str | Column) -> Column:
    """Uniform double in (0, 1) from a 64-bit hash of the parts."""
    h = F.xxhash64(F.lit(0x5EED), *parts)
    return (F.shiftrightunsigned(h, 11).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def require(df: DataFrame, *names: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")


#: bytes of texts that reach a Python worker at once
BATCH_BYTES = 8 << 20

#: where this checkout's packages live, for Python workers that share its disk
ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


#: workers are used again by later stages: what they free goes back to the system at once
ALLOCATOR = {"ARROW_DEFAULT_MEMORY_POOL": "system", "MALLOC_MMAP_THRESHOLD_": str(1 << 20), "MALLOC_TRIM_THRESHOLD_": str(8 << 20), "MALLOC_ARENA_MAX": "2"}


def prepare(spark: SparkSession, batch_bytes: int = BATCH_BYTES) -> SparkSession:
    """Session settings of the operators with Python stages: small Arrow batches, allocator, the packages' folder."""
    env = spark.sparkContext.environment
    for name, value in ALLOCATOR.items():
        env.setdefault(name, value)
    if ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [ROOT, env.get("PYTHONPATH", "")]))
    # Spark sets this variable for functions of columns only, and each set of variables gets its own daemon and workers
    if spark.conf.get("spark.sql.execution.pyspark.udf.simplifiedTraceback.enabled") == "true":
        env.setdefault("SPARK_SIMPLIFIED_TRACEBACK", "1")
    setting = "spark.sql.execution.arrow.maxBytesPerBatch"
    # a session that chose its own limit keeps it
    if spark.conf.get(setting) in ("67108864b", f"{BATCH_BYTES}b"):
        spark.conf.set(setting, f"{batch_bytes}b")
    return spark
