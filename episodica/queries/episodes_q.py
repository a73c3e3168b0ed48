"""Queries over episode indexing, selection and trimming."""

from pyspark.sql import functions as F

from episodica.operators import episodes as E
from episodica.queries.common import FRAMES, RAW_FRAMES, SAMPLES, bigint, frames, hide, raw_frames, samples, table
from episodica.queries.sources_q import CATALOG, catalog
from episodica.registry import query, rnd, sql_rnd
from episodica.sources import catalog as C

RANKED = """eps AS (SELECT domain, file_id, episode_id, count(*) AS length FROM frames GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY domain, file_id ORDER BY episode_id) - 1 AS ep_no,
  count(*) OVER (PARTITION BY domain, file_id) AS n_eps FROM eps)"""


@query("b1_episode_index", f"""WITH {FRAMES},
eps AS (SELECT domain, file_id, episode_id, count(*) AS length FROM frames GROUP BY ALL),
w AS (SELECT *, CAST(sum(length) OVER (ORDER BY domain, file_id, episode_id) AS BIGINT) AS "end",
  row_number() OVER (ORDER BY domain, file_id, episode_id) - 1 AS episode_no FROM eps)
SELECT domain, file_id, episode_id, length, "end" - length AS start, "end", episode_no FROM w""")
def b1(spark, sf):
    return E.episode_index(frames(spark, sf))


@query("b2_drop_unused_frames", f"""WITH {RAW_FRAMES}
SELECT episode_id, frame_idx FROM raw_frames WHERE flag = 'R' OR status = 'O'""")
def b2(spark, sf):
    d = raw_frames(spark, sf).withColumn("lefthand_used", F.col("flag") == "R").withColumn("righthand_used", F.col("status") == "O")
    return E.drop_unused_frames(d).select("episode_id", *bigint("frame_idx"))


@query("b3_take_trajectory_prefix", f"""WITH {FRAMES}, {RANKED}
SELECT f.domain, f.file_id, f.episode_id, count(*) AS n FROM frames f JOIN ranked r USING (domain, file_id, episode_id)
WHERE r.ep_no < floor(r.n_eps * 0.6) GROUP BY ALL""")
def b3(spark, sf):
    d = E.take_trajectory_prefix(frames(spark, sf), 0.6)
    return d.groupBy("domain", "file_id", "episode_id").agg(F.count(F.lit(1)).alias("n"))


@query("b4_slice_episodes", f"""WITH {FRAMES}, {RANKED}
SELECT f.episode_id, f.file_id, CAST(f.frame_idx // 2 AS DOUBLE) AS ts, CAST(f.frame_idx // 2 // 2 AS BIGINT) AS frame_idx, {sql_rnd('q1')} AS q1
FROM frames f JOIN ranked r USING (domain, file_id, episode_id)
WHERE r.ep_no >= 1 AND r.ep_no < 9 AND r.length >= 2 AND f.frame_idx < r.length - 1 AND f.frame_idx % 2 = 0
  AND f.frame_idx < 6 AND (f.frame_idx // 2) % 2 = 0""")
def b4(spark, sf):
    d = E.slice_episodes(frames(spark, sf), stride=2, start_episode=1, max_episodes=8, max_steps=3, downsample=2, reserve_last=True)
    return d.select("episode_id", "file_id", "ts", *bigint("frame_idx"), rnd(F.col("q1")).alias("q1"))


@query("b5_trim_idle", f"""WITH {SAMPLES},
f AS (SELECT *, first_value(value) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS v0 FROM samples),
m AS (SELECT episode_id, coalesce(min(CASE WHEN frame_idx >= 1 AND sqrt((value - v0) ** 2) > 4.0 THEN frame_idx END), 0) AS mv FROM f GROUP BY 1),
s AS (SELECT f.episode_id, coalesce(min(CASE WHEN k >= 50 THEN frame_idx END), max(frame_idx) + 1) AS st FROM f JOIN m USING (episode_id) WHERE frame_idx >= mv GROUP BY 1)
SELECT episode_id, event_id, frame_idx - st AS frame_idx FROM f JOIN s USING (episode_id) WHERE frame_idx >= st AND frame_idx - st < 40 - st""")
def b5(spark, sf):
    d = samples(spark, sf).withColumn("act", F.when(F.col("k") >= 50, F.col("k")).otherwise(0)).withColumn("cut", F.lit(40))
    d = E.trim_idle(d, ["value"], ["act"], eps=4.0, frame_cut="cut")
    return d.select("episode_id", "event_id", *bigint("frame_idx"))


@query("b6_chunk_overlap", f"""WITH {SAMPLES},
l AS (SELECT episode_id, count(*) AS len FROM samples GROUP BY 1),
c AS (SELECT episode_id, len, unnest(range(0, greatest((len - 5) // 8, 0) + 1)) AS chunk_no, greatest((len - 5) // 8, 0) AS n FROM l)
SELECT s.episode_id, c.chunk_no, s.frame_idx - c.chunk_no * 8 AS chunk_idx, s.event_id
FROM c JOIN samples s USING (episode_id)
WHERE s.frame_idx >= c.chunk_no * 8 AND s.frame_idx < (c.chunk_no + 1) * 8 + 5 AND (c.chunk_no < c.n OR c.len % 8 <> 0)""")
def b6(spark, sf):
    return E.chunk_overlap(samples(spark, sf), 8, 5).select("episode_id", *bigint("chunk_no", "chunk_idx"), "event_id")


@query("b7_every_kth", f"""WITH {SAMPLES}, r AS (SELECT DISTINCT episode_id, CASE WHEN episode_id % 3 = 0 THEN 0.34 WHEN episode_id % 3 = 1 THEN 0.2 ELSE 1.0 END AS ratio FROM samples)
SELECT episode_id, frame_idx, event_id FROM samples JOIN r USING (episode_id)
WHERE frame_idx % (CASE WHEN ratio < 1 THEN CAST(floor(1 / ratio) AS BIGINT) ELSE 1 END) = 0""")
def b7(spark, sf):
    s = samples(spark, sf)
    m = F.col("episode_id") % 3
    ratios = s.select("episode_id").distinct().withColumn("ratio", F.when(m == 0, 0.34).when(m == 1, 0.2).otherwise(1.0))
    return E.every_kth(s, ratios=ratios, idx="frame_idx", key="episode_id").select("episode_id", *bigint("frame_idx"), "event_id")


@query("b8_global_index", f"""WITH {FRAMES}
SELECT row_number() OVER (ORDER BY domain, file_id, episode_id, frame_idx) - 1 AS sample_no, episode_id, frame_idx, {sql_rnd('q1')} AS q1 FROM frames""")
def b8(spark, sf):
    return E.global_index(frames(spark, sf)).select(*bigint("sample_no", "episode_id", "frame_idx"), rnd(F.col("q1")).alias("q1"))


@query("b8_locate", f"""WITH {FRAMES},
g AS (SELECT domain, row_number() OVER (ORDER BY domain, file_id, episode_id, frame_idx) - 1 AS i FROM frames),
b AS (SELECT domain, min(i) AS lo, max(i) AS hi FROM g GROUP BY 1)
SELECT o_orderkey AS request, o_orderkey * 3 AS sample_no, b.domain, o_orderkey * 3 - b.lo AS local_idx
FROM orders JOIN b ON o_orderkey * 3 BETWEEN b.lo AND b.hi""")
def b8_locate(spark, sf):
    req = table(spark, sf, "orders").select(F.col("o_orderkey").alias("request"), (F.col("o_orderkey") * 3).alias("sample_no"))
    return E.locate(req, E.domain_bounds(frames(spark, sf))).select("request", "sample_no", "domain", "local_idx")


@query("b9_keep_ranges", f"""WITH {SAMPLES}
SELECT episode_id, frame_idx, event_id FROM samples s WHERE EXISTS (
  SELECT 1 FROM customer WHERE c_custkey = s.episode_id AND (
    (frame_idx >= c_nationkey AND frame_idx < c_nationkey + 6) OR (frame_idx >= 10 AND frame_idx < 10 + c_nationkey)))""")
def b9(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("episode_id"), F.col("c_nationkey").cast("long").alias("n"))
    r = c.select("episode_id", F.col("n").alias("start"), (F.col("n") + 6).alias("end")).unionByName(
        c.select("episode_id", F.lit(10).cast("long").alias("start"), (F.col("n") + 10).alias("end")))
    frames = samples(spark, sf)
    return E.keep_ranges(frames, hide(r), width=16).select("episode_id", *bigint("frame_idx"), "event_id")


@query("b10_success_only", r"""SELECT page_id, url FROM pages WHERE regexp_full_match(url, 'https://.*/en/[0-9]+.*')""")
def b10(spark, sf):
    return E.success_only(table(spark, sf, "pages").select("page_id", "url"), r"https://.*/en/[0-9]+.*", "url")


@query("b11_dedupe_catalog", f"""WITH {CATALOG}
SELECT config_index, min(config_index) OVER (PARTITION BY path, use_trajectory_ratio, norm_domain) AS representative,
  config_index = min(config_index) OVER (PARTITION BY path, use_trajectory_ratio, norm_domain) AS is_representative FROM catalog""")
def b11(spark, sf):
    return C.dedupe_catalog(catalog(spark, sf)).select("config_index", "representative", "is_representative")


@query("b12_pick_representative", f"""WITH {CATALOG}
SELECT norm_domain, config_index, {sql_rnd('use_trajectory_ratio')} AS ratio FROM (
  SELECT *, row_number() OVER (PARTITION BY norm_domain ORDER BY use_trajectory_ratio DESC, config_index) AS r FROM catalog) WHERE r = 1""")
def b12(spark, sf):
    return C.pick_representative(catalog(spark, sf)).select("norm_domain", "config_index", rnd(F.col("use_trajectory_ratio")).alias("ratio"))
