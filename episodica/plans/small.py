"""Size-checked broadcast and reliable lineage cuts."""

from __future__ import annotations

import gc

from pyspark.sql import DataFrame, functions as F

from episodica.session import scratch_path

#: rows and bytes up to which a lookup table may be broadcast
BROADCAST_ROWS = 100_000
BROADCAST_BYTES = 64 << 20

#: rows for which a step of :func:`few` gets a task of its own
ROWS_A_TASK = 20_000


def keep(df: DataFrame, name: str = "kept") -> DataFrame:
    """Write ``df`` to the shared folder and read it back (survives executor loss)."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._kept_path = path
    return out


def few(df: DataFrame, rows: int, per: int = ROWS_A_TASK) -> DataFrame:
    """``df``, its last step in no more tasks than ``rows``, a bound on what it reads, ask for.

    A table of a few thousand rows else costs a task and a file for every shuffle partition.
    """
    return df.coalesce(max(1, -(-rows // per)))


def forget(*tables: DataFrame | None, shuffles: bool = False) -> None:
    """Remove tables that :func:`keep` wrote and that nothing will read again.

    Only for tables whose readers have been written themselves: their rows are gone.
    With ``shuffles`` the driver collects its garbage as well, so that Spark drops the
    shuffle files of plans that have ended (it takes a moment: once a phase, not once a table).
    """
    paths = [(t, p) for t in tables if t is not None and (p := getattr(t, "_kept_path", None))]
    for t, p in paths:
        path = t.sparkSession._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
    if paths and shuffles:
        gc.collect()
        paths[0][0].sparkSession._jvm.System.gc()


def lookup(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Evaluate a summary table once and return it as a join side.

    At most ``max_rows`` rows are fetched (pass less for wide rows).  If the table
    is that small, and below ``BROADCAST_BYTES``, it comes
    back as a local relation with a broadcast hint, so its size is proven.  A
    larger table is written to the shared folder and joined by shuffle instead.
    """
    head = df.limit(max_rows + 1).toArrow()
    if head.num_rows > max_rows or head.nbytes > BROADCAST_BYTES:
        return keep(df, "lookup")
    # columnar fetch keeps doubles bit-exact; the schema is pinned to the source's
    return F.broadcast(df.sparkSession.createDataFrame(head, schema=df.schema))
