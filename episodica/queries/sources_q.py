"""Queries over sources, sinks and catalogs."""

from pyspark.sql import functions as F

from episodica.queries.common import (
    FRAMES, RAW_FRAMES, bigint, frames, raw_frames, table,
)
from episodica.plans.small import keep
from episodica.registry import ORACLES, query, rnd, sql_rnd
from episodica.session import scratch_path
from episodica.sources import catalog as C, frames as S
from episodica.sources.append import append_batch, read_batches

CATALOG = """entries AS (
  SELECT CAST(c_custkey AS BIGINT) AS config_index,
         CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_name END AS name,
         '/data/' || c_mktsegment || '/set' || CAST(c_nationkey AS VARCHAR) AS path,
         CASE WHEN c_acctbal < 0 THEN NULL ELSE floor(c_acctbal / 200.0) / 100.0 + 0.1 END AS use_trajectory_ratio,
         CASE WHEN c_custkey % 2 = 0 THEN 'N' || CAST(c_nationkey AS VARCHAR) END AS norm_stats_domain_name,
         CASE WHEN c_custkey % 7 <> 0 THEN true WHEN c_custkey % 14 = 0 THEN false END AS enabled
  FROM customer),
catalog AS (
  SELECT config_index, path, coalesce(use_trajectory_ratio, 0.5) AS use_trajectory_ratio,
         coalesce(name, 'set' || split_part(path, '/set', 2)) AS name,
         coalesce(norm_stats_domain_name, name, 'set' || split_part(path, '/set', 2)) AS norm_domain
  FROM entries WHERE coalesce(enabled, true))"""


def entries(spark, sf):
    """Catalog entries derived from customers (one entry per customer)."""
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        k.alias("config_index"),
        F.when(k % 3 != 0, F.col("c_name")).alias("name"),
        F.concat(F.lit("/data/"), "c_mktsegment", F.lit("/set"), F.col("c_nationkey").cast("string")).alias("path"),
        F.when(F.col("c_acctbal") >= 0, F.floor(F.col("c_acctbal") / 200.0) / 100.0 + 0.1).alias("use_trajectory_ratio"),
        F.when(k % 2 == 0, F.concat(F.lit("N"), F.col("c_nationkey").cast("string"))).alias("norm_stats_domain_name"),
        F.when(k % 7 != 0, F.lit(True)).when(k % 14 == 0, F.lit(False)).alias("enabled"),
        F.lit(0.5).alias("default_use_trajectory_ratio"),
    )


def catalog(spark, sf):
    return C.resolve_catalog(entries(spark, sf))


@query("a1_catalog_round_trip", f"WITH {CATALOG} SELECT config_index, name, path, {sql_rnd('use_trajectory_ratio')} AS ratio, norm_domain FROM catalog")
def a1_round_trip(spark, sf):
    """Written as documents of 50 entries and read again."""
    root = scratch_path(spark, "catalog-files")
    C.write_catalog_parts(catalog(spark, sf), root, 0.5, 50)
    return C.read_catalog(spark, root).select(
        "config_index", "name", "path", rnd(F.col("use_trajectory_ratio")).alias("ratio"), "norm_domain")


@query("a1_read_catalog", f"WITH {CATALOG} SELECT config_index, name, path, {sql_rnd('use_trajectory_ratio')} AS ratio, norm_domain FROM catalog")
def a1(spark, sf):
    path = scratch_path(spark, "catalogs")
    # one JSON document per norm-domain-sized group of customers, as a catalog folder holds
    doc = entries(spark, sf).groupBy("default_use_trajectory_ratio", (F.col("config_index") % 64).alias("part")).agg(
        F.collect_list(F.struct("name", "path", "use_trajectory_ratio", "norm_stats_domain_name", "enabled",
                                "config_index")).alias("datasets"))
    doc.select(F.to_json(F.struct("datasets", "default_use_trajectory_ratio")).alias("value")).write.text(path)
    raw = spark.read.schema(
        "datasets array<struct<name:string,path:string,use_trajectory_ratio:double,norm_stats_domain_name:string,"
        "enabled:boolean,config_index:bigint>>, default_use_trajectory_ratio double").json(path)
    flat = raw.select("default_use_trajectory_ratio", F.inline("datasets"))
    return C.resolve_catalog(flat).select(
        "config_index", "name", "path", rnd(F.col("use_trajectory_ratio")).alias("ratio"), "norm_domain")


@query("a2_scan_frames", f"""WITH {FRAMES}
SELECT domain, count(*) AS n_frames, count(DISTINCT file_id) AS n_files, count(DISTINCT episode_id) AS n_episodes,
       {sql_rnd('sum(q0)', 4)} AS s0 FROM frames GROUP BY domain""")
def a2(spark, sf):
    root = scratch_path(spark, "frames")
    frames(spark, sf).hint("rebalance", "domain").write.partitionBy("domain").parquet(root)
    doms = table(spark, sf, "nation").select(
        F.col("n_name").alias("name"), F.concat(F.lit(root + "/domain="), "n_name").alias("path"),
        F.col("n_nationkey").cast("bigint").alias("config_index"))
    return S.scan_frames(spark, doms).groupBy("domain").agg(
        F.count(F.lit(1)).alias("n_frames"), F.count_distinct("file_id").alias("n_files"),
        F.count_distinct("episode_id").alias("n_episodes"), rnd(F.sum("q0"), 4).alias("s0"))


@query("a3_append_episodes", f"""WITH {FRAMES},
e AS (SELECT domain, episode_id, count(*) AS n FROM frames GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY episode_id) - 1 AS s FROM e)
SELECT domain, CAST(s // 100 AS BIGINT) AS file_no, count(*) AS n_episodes, CAST(sum(n) AS BIGINT) AS n_frames
FROM r GROUP BY ALL""")
def a3(spark, sf):
    root = scratch_path(spark, "appended")
    S.append_episodes(frames(spark, sf), root)
    return spark.read.parquet(root).groupBy("domain", F.col("file_no").cast("bigint").alias("file_no")).agg(
        F.count_distinct("episode_id").alias("n_episodes"), F.count(F.lit(1)).alias("n_frames"))


@query("a3_append_twice", f"""WITH {FRAMES},
e AS (SELECT domain, episode_id, count(*) AS n, episode_id % 2 AS part FROM frames GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY part, episode_id) - 1 AS s FROM e)
SELECT domain, CAST(s // 100 AS BIGINT) AS file_no, count(*) AS n_episodes, CAST(sum(n) AS BIGINT) AS n_frames, CAST(max(s) AS BIGINT) AS last_seq
FROM r GROUP BY ALL""")
def a3_twice(spark, sf):
    root = scratch_path(spark, "appended-twice")
    # numbered once, read by each append
    d = keep(frames(spark, sf), "append-frames")
    for part in (0, 1):
        S.append_episodes(d.where(F.col("episode_id") % 2 == part), root)
    return spark.read.parquet(root).groupBy("domain", F.col("file_no").cast("bigint").alias("file_no")).agg(
        F.count_distinct("episode_id").alias("n_episodes"), F.count(F.lit(1)).alias("n_frames"), F.max("episode_seq").cast("bigint").alias("last_seq"))


@query("a3_append_batches", ORACLES["a3_append_twice"])
def a3_batches(spark, sf):
    """Two named batches; the first one comes again behind the second and changes nothing."""
    root = scratch_path(spark, "appended-batches")
    # numbered once, read by each append
    d = keep(frames(spark, sf), "append-frames")
    for part in (0, 1, 0):
        append_batch(d.where(F.col("episode_id") % 2 == part), root, f"part-{part}")
    return read_batches(spark, root).groupBy("domain", F.col("file_no").cast("bigint").alias("file_no")).agg(
        F.count_distinct("episode_id").alias("n_episodes"), F.count(F.lit(1)).alias("n_frames"), F.max("episode_seq").cast("bigint").alias("last_seq"))


def _ragged(d):
    """Frames with a few damaged keys, so that the rules have something to find."""
    vec = F.array("q0", "q1", "q2", "q3")
    return d.withColumn("signal", F.when((F.col("q0") == 50) & (F.col("q3") == 0), F.slice(vec, 1, 3)).otherwise(vec)) \
        .withColumn("extra", F.when((F.col("q2") < 0.095) | (F.col("file_id") % 2 == 0), F.array("q0")))


@query("a4_validate_frames", f"""WITH {FRAMES},
g AS (SELECT domain, file_id, count(*) AS n,
   min(CASE WHEN q0 = 50 AND q3 = 0 THEN 3 ELSE 4 END) AS a, max(CASE WHEN q0 = 50 AND q3 = 0 THEN 3 ELSE 4 END) AS b,
   count(CASE WHEN q2 < 0.095 OR file_id % 2 = 0 THEN 1 END) AS x FROM frames GROUP BY ALL),
ends AS (SELECT domain, file_id, count(*) + max(CASE WHEN file_id % 11 = 0 THEN 1 ELSE 0 END) AS e FROM frames GROUP BY ALL)
SELECT domain, file_id, 'signal' AS key, 'shape' AS rule FROM g WHERE a <> b
UNION ALL SELECT domain, file_id, 'extra', 'length' FROM g WHERE x > 0 AND x <> n
UNION ALL SELECT domain, file_id, 'episode_ends', 'end' FROM g JOIN ends USING (domain, file_id) WHERE n <> e""")
def a4(spark, sf):
    d = _ragged(frames(spark, sf))
    ends = d.groupBy("domain", "file_id").agg(
        (F.count(F.lit(1)) + F.max(F.when(F.col("file_id") % 11 == 0, 1).otherwise(0))).alias("episode_end"))
    return S.validate_frames(d, ["signal", "extra"], ends)


@query("a4_observed_append", ORACLES["a4_validate_frames"].split("\nUNION ALL SELECT domain, file_id, 'episode_ends'")[0])
def a4_observed(spark, sf):
    """What an append finds while it writes."""
    return append_batch(_ragged(frames(spark, sf)), scratch_path(spark, "appended-observed"), "one", arrays=["signal", "extra"])


@query("a5_step_slice", f"""WITH {RAW_FRAMES}
SELECT episode_id, frame_idx, {sql_rnd('q1')} AS q1 FROM raw_frames WHERE frame_idx >= 1 AND frame_idx < 6 AND (frame_idx - 1) % 2 = 0""")
def a5(spark, sf):
    d = S.step_slice(raw_frames(spark, sf), 1, 6, 2)
    return d.select("episode_id", *bigint("frame_idx"), rnd(F.col("q1")).alias("q1"))


@query("a5_drop_last_episode", f"""WITH {FRAMES},
m AS (SELECT domain, file_id, max(episode_id) AS episode_id FROM frames GROUP BY ALL)
SELECT domain, file_id, episode_id, count(*) AS n FROM frames ANTI JOIN m USING (domain, file_id, episode_id) GROUP BY ALL""")
def a5_drop(spark, sf):
    return S.drop_last_episode(frames(spark, sf)).groupBy("domain", "file_id", "episode_id").agg(F.count(F.lit(1)).alias("n"))


@query("a5_pop_episode", f"""WITH {FRAMES},
m AS (SELECT domain, file_id, max(episode_id) AS episode_id FROM frames GROUP BY ALL)
SELECT domain, file_id, episode_id, count(*) AS n, {sql_rnd('sum(q0)', 4)} AS s0 FROM frames SEMI JOIN m USING (domain, file_id, episode_id) GROUP BY ALL""")
def a5_pop(spark, sf):
    last, _ = S.pop_episode(frames(spark, sf))
    return last.groupBy("domain", "file_id", "episode_id").agg(F.count(F.lit(1)).alias("n"), rnd(F.sum("q0"), 4).alias("s0"))


URL = r"^https?://([^/]+)/([a-z]+)/([^/?#.]*)"


@query("a6_discover_inputs", r"""WITH p AS (
  SELECT url AS path, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([^/?#.]*)', 1) AS task,
         regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([^/?#.]*)', 2) AS source,
         coalesce(TRY_CAST(regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([^/?#.]*)', 3) AS BIGINT), 0) AS episode_no
  FROM pages WHERE regexp_matches(url, '^https?://([^/]+)/([a-z]+)/([^/?#.]*)')
    AND NOT list_contains(string_split(url, '/'), 'spam-farm.example.org')),
s AS (SELECT task, source, row_number() OVER (PARTITION BY task ORDER BY source) AS r FROM (SELECT DISTINCT task, source FROM p))
SELECT p.* FROM p JOIN s USING (task, source) WHERE r <= 2""")
def a6(spark, sf):
    listing = table(spark, sf, "pages").select(F.col("url").alias("path"))
    return S.discover_inputs(listing, URL, excluded=["spam-farm.example.org"], max_sources=2)


@query("a6_discover_inputs_all", """SELECT url AS path, regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([^/?#.]*)', 1) AS task,
  regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([^/?#.]*)', 2) AS source,
  coalesce(TRY_CAST(regexp_extract(url, '^https?://([^/]+)/([a-z]+)/([^/?#.]*)', 3) AS BIGINT), 0) AS episode_no
  FROM pages WHERE regexp_matches(url, '^https?://([^/]+)/([a-z]+)/([^/?#.]*)')""")
def a6_all(spark, sf):
    return S.discover_inputs(table(spark, sf, "pages").select(F.col("url").alias("path")), URL)


@query("a7_stats_json", f"""WITH s AS (SELECT label, unnest(CAST(embedding AS DOUBLE[])) AS x, unnest(range(1, len(embedding) + 1)) - 1 AS dim FROM embeddings)
SELECT CAST(label AS BIGINT) AS domain, 'state' AS key, dim, {sql_rnd('min(x)')} AS lo, {sql_rnd('max(x)')} AS hi, NULL::VARCHAR AS mode FROM s GROUP BY ALL
UNION ALL SELECT DISTINCT CAST(label AS BIGINT), 'binary', NULL, NULL, NULL, 'ignore' FROM embeddings""")
def a7(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("label").cast("bigint").alias("domain"), F.posexplode("embedding").alias("dim", "x"))
    num = e.groupBy("domain", "dim").agg(F.min(F.col("x").cast("double")).alias("lo"), F.max(F.col("x").cast("double")).alias("hi"))
    num = num.select("domain", F.lit("state").alias("key"), F.col("dim").cast("bigint").alias("dim"), "lo", "hi",
                     F.lit(None).cast("string").alias("mode"))
    txt = e.groupBy("domain").agg(F.lit("binary").alias("key")).select(
        "domain", "key", F.lit(None).cast("bigint").alias("dim"), F.lit(None).cast("double").alias("lo"),
        F.lit(None).cast("double").alias("hi"), F.lit("ignore").alias("mode"))
    path = scratch_path(spark, "stats")
    C.stats_to_json(num.unionByName(txt)).write.json(path)
    back = C.stats_from_json(spark.read.schema("domain bigint, key string, doc string").json(path))
    return back.select("domain", "key", "dim", rnd(F.col("lo")).alias("lo"), rnd(F.col("hi")).alias("hi"), "mode")


@query("a8_task_settings_filter", f"""WITH {FRAMES},
st AS (SELECT n_name AS task, CASE WHEN n_regionkey = 1 THEN 'all' ELSE 'head' END AS camera_type FROM nation WHERE n_nationkey % 4 <> 0),
ins AS (SELECT n_name AS task, 'handle ' || lower(n_name) || '.' AS instruction FROM nation WHERE n_nationkey % 3 = 0)
SELECT domain AS task, coalesce(camera_type, 'head') AS camera_type, coalesce(instruction, replace(domain, '_', ' ')) AS instruction,
  count(*) AS n, {sql_rnd("sum(CASE WHEN camera_type = 'all' THEN q1 END)", 2)} AS wrist, {sql_rnd('sum(q0)', 2)} AS head
FROM frames LEFT JOIN st ON domain = st.task LEFT JOIN ins ON domain = ins.task GROUP BY 1, 2, 3""")
def a8(spark, sf):
    n = table(spark, sf, "nation")
    st = n.where("n_nationkey % 4 <> 0").select(
        F.col("n_name").alias("task"), F.when(F.col("n_regionkey") == 1, "all").otherwise("head").alias("camera_type"))
    ins = n.where("n_nationkey % 3 = 0").select(
        F.col("n_name").alias("task"), F.concat(F.lit("handle "), F.lower("n_name"), F.lit(".")).alias("instruction"))
    d = C.task_settings_filter(frames(spark, sf).withColumnRenamed("domain", "task"), st, ins, ["q1"])
    return d.groupBy("task", "camera_type", "instruction").agg(
        F.count(F.lit(1)).alias("n"), rnd(F.sum("q1"), 2).alias("wrist"), rnd(F.sum("q0"), 2).alias("head"))


