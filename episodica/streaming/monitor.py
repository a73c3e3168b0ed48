"""Streaming statistics and loss monitoring."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from episodica.operators.normalize import stats_from_histogram
from episodica.plans.quantiles import is_finite, log_bin
from episodica.session import scratch_path


def loss_window_stream(events: DataFrame, time: str, width: str, delay: str, domain: Column) -> DataFrame:
    """Tumbling windows of the loss per domain (append mode); rows later than ``delay`` are dropped."""
    d = events.withWatermark(time, delay).withColumn("domain", F.coalesce(domain.cast("string"), F.lit("unknown")))
    g = d.groupBy(F.window(time, width), "domain").agg(F.sum("loss").alias("s"), F.max("loss").alias("max_loss"), F.count("loss").alias("n"))
    return g.select(F.col("window.start").alias("start"), "domain", (F.col("s") / F.col("n")).alias("mean_loss"), "max_loss", "n")


def loss_steps_stream(events: DataFrame, every: int) -> DataFrame:
    """Windows of ``every`` steps per domain (update mode)."""
    d = events.withColumn("domain", F.coalesce(F.col("domain").cast("string"), F.lit("unknown")))
    g = d.groupBy(F.floor(F.col("step") / every).alias("window"), "domain").agg(
        F.sum("loss").alias("s"), F.max("loss").alias("max_loss"), F.count("loss").alias("n"))
    return g.select("window", "domain", (F.col("s") / F.col("n")).alias("mean_loss"), "max_loss", "n")


def run_to_end(stream: DataFrame, mode: str, name: str, feed: Iterable = (None,), progress: list | None = None) -> str:
    """Drain the source into a table of the shared folder and return its path.

    The query runs once per element of ``feed``, from where it stopped; an iterator
    that adds files to the source before each element so makes each addition a
    micro-batch, whatever its number of files.
    Update mode keeps every version with its ``batch_id``; a replayed batch
    overwrites its own folder, so results stay exact after a failure.
    ``progress`` collects the reports of the query.
    """
    spark = stream.sparkSession
    out, ckpt = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    w = stream.writeStream.outputMode(mode).option("checkpointLocation", ckpt).trigger(availableNow=True)

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")

    for _ in feed:
        q = w.format("parquet").start(out) if mode == "append" else w.foreachBatch(put).start()
        q.awaitTermination()
        if progress is not None:
            progress += q.recentProgress
    return out


def state_rows(progress: list) -> list[int]:
    """Rows of state after each micro-batch, over all stateful operators."""
    return [sum(o["numRowsTotal"] for o in p["stateOperators"]) for p in progress]


class RunningStatsSink:
    """Mergeable statistics of a stream of (keys, value) rows.

    Every micro-batch writes its own partial table (count, sums, extremes and
    counts per fine value bin) under its batch id; reading merges them.  Partial
    tables are tiny, replays overwrite, nothing is kept in the driver.
    """

    FINE = 4096  # value bins per power of two

    def __init__(self, spark, keys: Sequence[str], value: str = "value"):
        self.spark, self.keys, self.value = spark, list(keys), value
        self.root, self.ckpt = scratch_path(spark, "running-stats"), scratch_path(spark, "running-ckpt")

    def _merge_batch(self, batch: DataFrame, batch_id: int) -> None:
        v = F.col(self.value)
        # null, NaN and infinite values have no place among the statistics
        part = batch.where(is_finite(v)).groupBy(*self.keys, log_bin(v, self.FINE).alias("vbin")).agg(
            F.count(F.lit(1)).alias("c"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.min(v).alias("lo"), F.max(v).alias("hi"))
        part.write.mode("overwrite").parquet(f"{self.root}/batch_id={batch_id}")

    def start(self, stream: DataFrame) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(self._merge_batch).option("checkpointLocation", self.ckpt)
                .trigger(availableNow=True).start())

    def statistics(self, bins: int = 5000) -> DataFrame:
        """Merged count, min, max, mean, std and histogram quantiles (within one bin width)."""
        parts = self.spark.read.parquet(self.root)
        n = F.sum("c")
        m = parts.groupBy(*self.keys).agg(n.alias("n"), F.min("lo").alias("min"), F.max("hi").alias("max"),
                                          (F.sum("s") / n).alias("mean"), (F.sum("ss") / n).alias("mean_sq"))
        d = parts.groupBy(*self.keys, "vbin").agg(F.sum("c").alias("c"), F.min("lo").alias("x")).join(m.select(*self.keys, "min", "max"), self.keys)
        lo, hi = F.col("min") - 1e-10, F.col("max") + 1e-10
        b = F.least(F.floor((F.col("x") - lo) / (hi - lo) * bins), F.lit(bins - 1))
        h = d.groupBy(*self.keys, b.alias("bin")).agg(F.sum("c").alias("c"))
        return stats_from_histogram(m, h, self.keys, bins=bins)


class SketchStatsSink:
    """Mergeable statistics of a stream in one small row per key.

    Count, sums, extremes and a KLL sketch of the values (Spark's own aggregate, at most
    a few ``k`` numbers however long the stream runs).  A micro-batch is merged with the
    state behind the batch before it and written under its own batch id; the state before
    stays until the next batch, so a replay merges the same two again.  Quantiles are
    right within :meth:`rank_error` of the rank, everything else is exact.
    """

    def __init__(self, spark, keys: Sequence[str], value: str = "value", k: int = 400):
        self.spark, self.keys, self.value, self.k = spark, list(keys), value, k
        self.root, self.ckpt = scratch_path(spark, "sketch-stats"), scratch_path(spark, "sketch-ckpt")

    def rank_error(self) -> float:
        """Error of a rank as a share of the count (99 % of the time), for the sketch's ``k``."""
        return 2.296 / self.k**0.9021

    def _batches(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(path):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(path)]
        # a batch counts once its write has been committed
        return sorted(int(n[6:]) for n in names if n.startswith("batch=") and fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{n}/_SUCCESS")))

    def _state(self, batch: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/batch={batch}")

    def _merge_batch(self, batch: DataFrame, batch_id: int) -> None:
        v = F.col(self.value).cast("double")
        part = batch.where(is_finite(v)).groupBy(*self.keys).agg(
            F.count(F.lit(1)).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("ss"), F.min(v).alias("min"), F.max(v).alias("max"),
            F.kll_sketch_agg_double(v, F.lit(self.k)).alias("sketch"))
        before = [b for b in self._batches() if b < batch_id]
        if before:
            part = part.unionByName(self._state(before[-1])).groupBy(*self.keys).agg(
                *[F.sum(c).alias(c) for c in ("n", "s", "ss")], F.min("min").alias("min"), F.max("max").alias("max"),
                F.kll_merge_agg_double("sketch", F.lit(self.k)).alias("sketch"))
        part.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}")
        # the state before is what a replay of this batch starts from; older ones are of no use
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path
        for old in before[:-1]:
            path = fs_path(f"{self.root}/batch={old}")
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def start(self, stream: DataFrame) -> StreamingQuery:
        return (stream.writeStream.foreachBatch(self._merge_batch).option("checkpointLocation", self.ckpt)
                .trigger(availableNow=True).start())

    def state_bytes(self) -> int:
        """Size of the largest sketch."""
        return self._state(self._batches()[-1]).agg(F.max(F.octet_length("sketch"))).first()[0]

    def statistics(self, quantiles: Sequence[tuple[str, float]] = (("q01", 0.01), ("q99", 0.99))) -> DataFrame:
        """Keys, n, min, max, mean, std and the wanted quantiles; null keys are keys."""
        d = self._state(self._batches()[-1])
        mean = F.col("s") / F.col("n")
        var = F.greatest(F.lit(0.0), F.col("ss") / F.col("n") - mean * mean)
        return d.select(*self.keys, "n", "min", "max", mean.alias("mean"), F.sqrt(var).alias("std"),
                        *[F.kll_sketch_get_quantile_double("sketch", F.lit(float(q))).alias(name) for name, q in quantiles])
