"""Statistics after appends against a fit from scratch."""

from pyspark.sql import functions as F

from episodica.queries.common import VECTORS, vectors
from episodica.queries.normalize_q import CELLS
from episodica.registry import query, rnd, sql_rnd
from episodica.session import scratch_path
from episodica.sources.stats_store import BINS, StatsStore


@query("h1_incremental_fit", f"""WITH {VECTORS}, {CELLS}
SELECT domain, dim, count(*) AS n, {sql_rnd('min(x)')} AS min, {sql_rnd('max(x)')} AS max, {sql_rnd('avg(x)')} AS mean, {sql_rnd('stddev_pop(x)')} AS std,
 TRUE AS q01_within, TRUE AS q99_within, TRUE AS only_new_files FROM cells GROUP BY 1, 2""")
def h1_incremental(spark, sf):
    """Three appends with a refresh behind each; only the files of the append are read."""
    data = scratch_path(spark, "grown")
    store = StatsStore(spark, data, scratch_path(spark, "grown-stats"), ["domain"], "v")
    read = []
    for part in range(3):
        vectors(spark, sf).where(F.col("vec_id") % 3 == part).write.mode("append").parquet(data)
        read.append(store.refresh())
    every = {r.file for r in store.files().collect()}
    only = len({f for r in read for f in r}) == sum(map(len, read)) == len(every) and store.refresh() == []
    s = store.statistics()
    exact = vectors(spark, sf).select("domain", F.posexplode("v").alias("dim", "x")).groupBy("domain", F.col("dim").cast("bigint").alias("dim")).agg(
        *[F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY x)").alias(f"e{n}") for n, q in (("q01", 0.01), ("q99", 0.99))])
    near = [(F.abs(F.col(n) - F.col(f"e{n}")) <= F.abs(F.col(f"e{n}")) * 2 / BINS).alias(f"{n}_within") for n in ("q01", "q99")]
    return s.join(exact, ["domain", "dim"]).select("domain", "dim", "n", *[rnd(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")], *near, F.lit(only).alias("only_new_files"))
