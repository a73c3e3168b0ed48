"""Statistics that grow with their table: an append costs the new files only.

Every data file has a partial result: moments per key and dim, and counts of values in
fine logarithmic bins.  Partials are kept on disk with the file's name, size and time
of change.  A refresh lists the files (their contents are not touched), reads those
without a partial and adds theirs; partials of files that were replaced or removed no
longer count.  Merging adds counts and combines moments, so the result is that of a
fit from scratch whatever the appends were.

Quantiles are ranks over the bins: the smallest value of the bin that holds the rank,
within 1 part in BINS of the value.  Everything else is exact.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from episodica.operators.normalize import guard_stats, vector_cells
from episodica.plans.ordered import join_same
from episodica.plans.quantiles import is_finite, log_bin
from episodica.plans.small import keep

#: bins for each power of two
BINS = 1024

#: files that one job reads
JOB_FILES = 5_000


class StatsStore:
    """Mergeable statistics of ``vec`` in the Parquet files below ``data``, kept below ``root``.

    ``keys`` are columns of the frames ``prepare`` makes of the files (the files'
    own columns by default); null keys are keys.
    """

    def __init__(self, spark: SparkSession, data: str, root: str, keys: Sequence[str], vec: str, prepare: Callable[[DataFrame], DataFrame] | None = None):
        self.spark, self.data, self.root = spark, data, root.rstrip("/")
        self.keys, self.vec, self.prepare = list(keys), vec, prepare or (lambda d: d)

    def _read(self, table: str) -> DataFrame | None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{table}")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return None
        return self.spark.read.parquet(f"{self.root}/{table}")

    def files(self) -> DataFrame:
        """(file, size, changed) of the data files, from the listing alone."""
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").load(self.data)
        return found.select(F.col("path").alias("file"), F.col("length").alias("size"), F.col("modificationTime").alias("changed"))

    def refresh(self) -> list[str]:
        """Add the partials of new and changed files; returns the files that were read.

        A refresh that ended half way is done again by the next one: files count from
        the list written last.
        """
        done = self._read("files")
        now = self.files()
        if done is not None:
            now = now.join(done.select("file", "size", "changed"), ["file", "size", "changed"], "left_anti")
        new = keep(now, "new-files")
        names = [r.file for r in new.select("file").collect()]
        for at in range(0, len(names), JOB_FILES):
            self._add(names[at : at + JOB_FILES], new)
        return names

    def _add(self, names: list[str], new: DataFrame) -> None:
        raw = self.spark.read.option("basePath", self.data).parquet(*names)
        # names as the listing writes them
        d = self.prepare(raw.withColumn("__file", F.col("_metadata.file_path")))
        cells = vector_cells(d, ["__file", *self.keys], self.vec).where(is_finite(F.col("value")))
        by = ["__file", *self.keys, "dim"]
        v = F.col("value")
        bins = keep(cells.groupBy(*by, log_bin(v, BINS).alias("bin")).agg(
            F.count(F.lit(1)).alias("c"), F.avg(v).alias("mean"), (F.var_pop(v) * F.count(F.lit(1))).alias("m2"), F.min(v).alias("lo"), F.max(v).alias("hi")), "partials")
        listed = new.where(F.col("file").isin(names)) if len(names) <= 100 else new
        tag = listed.select(F.col("file").alias("__file"), "size", "changed")
        bins.join(F.broadcast(tag) if len(names) <= JOB_FILES else tag, "__file").withColumnRenamed("__file", "file").write.mode("append").parquet(f"{self.root}/bins")
        # a file is done when its partial is there; one without cells is done as well
        listed.where(F.col("file").isin(names)).write.mode("append").parquet(f"{self.root}/files")

    def _partials(self) -> DataFrame:
        bins = self._read("bins")
        if bins is None:
            raise ValueError(f"no statistics below {self.root}; refresh them first")
        cols = [*self.keys, "dim", "bin", "c", "mean", "m2", "lo", "hi"]
        # a refresh that was cut off may have left a file's partial twice
        one = bins.dropDuplicates(["file", "size", "changed", *self.keys, "dim", "bin"])
        return one.join(self.files(), ["file", "size", "changed"], "left_semi").select(*cols)

    def statistics(self, quantiles: Sequence[tuple[str, float]] = (("q01", 0.01), ("q99", 0.99))) -> DataFrame:
        """Keys, dim, n, min, max, mean, std and the quantiles, merged from the partials of the present files."""
        by = [*self.keys, "dim"]
        n = F.sum("c")
        # partials of one bin meet about their common mean
        same = W.partitionBy(*by, "bin")
        part = self._partials().withColumn("__m", F.sum(F.col("mean") * F.col("c")).over(same) / F.sum("c").over(same))
        apart = F.col("mean") - F.col("__m")
        per = keep(part.groupBy(*by, "bin").agg(
            n.alias("c"), F.max("__m").alias("mean"), F.sum(F.col("m2") + F.col("c") * apart * apart).alias("m2"), F.min("lo").alias("lo"), F.max("hi").alias("hi")), "merged-bins")
        total = per.groupBy(*by).agg(n.alias("n"), (F.sum(F.col("mean") * F.col("c")) / n).alias("mean"), F.min("lo").alias("min"), F.max("hi").alias("max"))
        off = F.col("mean") - F.col("__mean")
        spread = join_same(per, total.select(*by, F.col("mean").alias("__mean")), by).groupBy(*by).agg(F.sum(F.col("m2") + F.col("c") * off * off).alias("__m2"))
        run = F.sum("c").over(W.partitionBy(*by).orderBy("bin").rowsBetween(W.unboundedPreceding, 0))
        cum = join_same(per.withColumn("__to", run), total.select(*by, "n"), by)
        q = cum.groupBy(*by).agg(*[F.min(F.when(F.col("__to") >= F.lit(p) * F.col("n"), F.struct("bin", "lo"))).alias(name) for name, p in quantiles])
        out = join_same(join_same(total, spread, by), q, by)
        return out.select(*by, "n", "min", "max", "mean", F.sqrt(F.col("__m2") / F.col("n")).alias("std"), *[F.col(name)["lo"].alias(name) for name, _ in quantiles])

    def norm_stats(self, norm_type: str) -> DataFrame:
        """Statistics as the normalisation uses them: keys, dim, lo, hi with the guards for flat dims."""
        s = self.statistics()
        pair = ("q01", "q99") if norm_type == "quantile" else ("mean", "std")
        lo, hi = guard_stats(norm_type, F.col(pair[0]), F.col(pair[1]))
        return s.select(*self.keys, "dim", lo.alias("lo"), hi.alias("hi"))
