"""Flagship: per-domain statistics of action chunks, applied and summarised."""

from pyspark.sql import functions as F

from episodica.operators import align as A, normalize as N
from episodica.queries.common import FRAMES, frames
from episodica.plans.small import keep
from episodica.registry import query, rnd, sql_rnd

HORIZON = 4
DIMS = 4


@query("flagship_chunk_statistics", f"""WITH {FRAMES},
e AS (SELECT *, max(frame_idx) OVER (PARTITION BY episode_id) AS l FROM frames),
c AS (SELECT e.domain, e.episode_id, e.frame_idx, j AS step, d AS dim, CASE d WHEN 0 THEN s.q0 WHEN 1 THEN s.q1 WHEN 2 THEN s.q2 ELSE s.q3 END AS x
  FROM e, (SELECT unnest(range(0, 4)) AS j), (SELECT unnest(range(0, 4)) AS d) JOIN frames s ON s.episode_id = e.episode_id AND s.frame_idx = least(e.frame_idx + j, e.l)),
st AS (SELECT domain, dim, avg(x) AS lo, stddev_pop(x) AS hi FROM c GROUP BY 1, 2),
z AS (SELECT domain, dim, step, greatest(-10.0::DOUBLE, least(10.0::DOUBLE, (x - lo) / hi)) AS y FROM c JOIN st USING (domain, dim))
SELECT domain, step, dim, count(*) AS n, {sql_rnd('avg(y)', 4)} AS mean, {sql_rnd('stddev_pop(y)', 4)} AS std, {sql_rnd('min(y)', 4)} AS min, {sql_rnd('max(y)', 4)} AS max FROM z GROUP BY 1, 2, 3""")
def chunk_statistics(spark, sf):
    """Frames -> action chunks -> z-score statistics per domain -> normalised chunks -> summary."""
    d = frames(spark, sf).withColumn("v", F.array("q0", "q1", "q2", "q3"))
    # numbered once, read for the fit and for the chunks
    d = keep(d.select("domain", "episode_id", "frame_idx", "v"), "flagship-frames")
    stats = N.norm_fit_chunks(d, ["domain"], "v", "zscore", HORIZON).withColumn("scope", F.lit("domain"))
    d = A.action_chunk(d, ["v"], HORIZON)
    y = N.norm_apply(d, "chunk_v", stats, "zscore", 4)
    # a row a step: its dims are aggregated side by side and become rows behind the sums
    y = y.select("domain", F.posexplode("chunk_v").alias("step", "row"))
    aggs = []
    for i in range(DIMS):
        v = F.get("row", F.lit(i))
        aggs.append(F.struct(F.lit(i).cast("bigint").alias("dim"), F.count(F.lit(1)).alias("n"), rnd(F.avg(v), 4).alias("mean"), rnd(F.stddev_pop(v), 4).alias("std"),
                             rnd(F.min(v), 4).alias("min"), rnd(F.max(v), 4).alias("max")))
    g = y.groupBy("domain", F.col("step").cast("bigint").alias("step")).agg(F.array(*aggs).alias("dims"))
    return g.select("domain", "step", F.inline("dims"))
