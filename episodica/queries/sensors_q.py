"""Queries over sensor cleaning and contact detection."""

from pyspark.sql import functions as F

from episodica.operators import sensors as S
from episodica.queries.common import EVENTS, FRAMES, SAMPLES, VECTORS, bigint, events, forms, frames, hide, samples, sql_forms, vectors
from episodica.registry import query, rnd, sql_rnd
from episodica.sources.frames import index_frames

STREAMS = EVENTS + """,
streams AS (SELECT *, row_number() OVER (PARTITION BY episode_id, stream ORDER BY ts) - 1 AS frame_idx FROM events0)"""


def streams(spark, sf):
    return hide(index_frames(events(spark, sf), ["episode_id", "stream"], ["ts"], F.floor(F.col("ts") / 60)))


@query("f1_baseline_denoise", f"""WITH {STREAMS},
b AS (SELECT episode_id, stream, avg(value) AS b FROM streams WHERE frame_idx < 5 GROUP BY ALL),
x AS (SELECT s.*, CASE WHEN value - b < 2.0 THEN 0.0::DOUBLE ELSE value - b END AS x FROM streams s JOIN b USING (episode_id, stream))
SELECT episode_id, stream, frame_idx, {sql_rnd('greatest(0.0::DOUBLE, (coalesce(lag(x) OVER w, x) + x + coalesce(lead(x) OVER w, x)) / 3)', 5)} AS value
FROM x WINDOW w AS (PARTITION BY episode_id, stream ORDER BY frame_idx)""")
def f1(spark, sf):
    d = S.baseline_denoise(streams(spark, sf), "value", 5, 2.0, 3, ["episode_id", "stream"])
    return d.select("episode_id", "stream", *bigint("frame_idx"), rnd(F.col("value"), 5).alias("value"))


@query("f2_regroup_taxels", f"""WITH {VECTORS}, p AS (SELECT vec_id, v || v || v[1:9] AS p, v || v || v || v || v || v || v || v || v || v || v || v AS mat FROM vectors),
f AS (SELECT vec_id, p[49:60] || p[37:48] || p[25:36] || p[13:24] || p[1:12] AS left_fingers, p[1:60] AS right_fingers,
  p[66:77] || [0.0::DOUBLE, 0.0, 0.0] || p[78:137] AS left_palm, [0.0::DOUBLE, 0.0, 0.0] || p[66:77] || p[78:137] AS right_palm,
  flatten(list_transform(range(0, 12), lambda r: mat[r*64+1 : r*64+32])) AS sensor0, flatten(list_transform(range(0, 12), lambda r: mat[r*64+33 : r*64+64])) AS sensor1 FROM p)
{sql_forms('f', 'vec_id', ['left_fingers', 'right_fingers', 'left_palm', 'right_palm', 'sensor0', 'sensor1'])}""")
def f2(spark, sf):
    d = vectors(spark, sf).withColumn("p", F.concat("v", "v", F.slice("v", 1, 9))).withColumn("mat", F.flatten(F.array_repeat("v", 12)))
    for side in ("left", "right"):
        d = S.regroup_fingers(d, "p", side, f"{side}_fingers").withColumn(f"{side}_fingers", F.flatten(f"{side}_fingers"))
        d = S.regroup_palm(d, "p", side, f"{side}_palm")
    d = S.split_mat(d, "mat").withColumn("sensor0", F.get("halves", F.lit(0))).withColumn("sensor1", F.get("halves", F.lit(1)))
    return forms(d, ["vec_id"], ["left_fingers", "right_fingers", "left_palm", "right_palm", "sensor0", "sensor1"])


@query("f3_repair_glitches", f"""WITH {SAMPLES},
x AS (SELECT episode_id, frame_idx, value, k, k % 3 = 0 OR value > 30 AS bad FROM samples),
p AS (SELECT *, max(CASE WHEN NOT bad THEN frame_idx END) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS lo,
  min(CASE WHEN NOT bad THEN frame_idx END) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS hi FROM x),
c AS (SELECT episode_id, frame_idx, CASE WHEN lo IS NOT NULL AND (hi IS NULL OR frame_idx - lo <= hi - frame_idx) THEN lo ELSE hi END AS src FROM p)
SELECT c.episode_id, c.frame_idx, {sql_rnd('coalesce(x.value, 0)')} AS j0, CAST(coalesce(x.k, 0) AS BIGINT) AS j1 FROM c LEFT JOIN x ON x.episode_id = c.episode_id AND x.frame_idx = c.src""")
def f3(spark, sf):
    v = F.when(F.col("k") % 6 == 0, F.lit(float("nan"))).when(F.col("k") % 3 == 0, F.lit(1e30)).otherwise(F.col("value"))
    d = samples(spark, sf).withColumn("j", F.array(F.when(F.col("value") > 30, F.lit(-500.0)).otherwise(v), F.col("k").cast("double")))
    d = S.repair_glitches(d, "j")
    return d.select("episode_id", *bigint("frame_idx"), rnd(F.get("j", F.lit(0))).alias("j0"), F.get("j", F.lit(1)).cast("bigint").alias("j1"))


@query("f4_clean_flags", """SELECT event_id, CASE WHEN event_id % 7 IN (0, 2) THEN 0::BIGINT WHEN event_id % 7 = 1 THEN 1 WHEN value / 20 > 0.5 THEN 1 ELSE 0 END AS flag FROM events""")
def f4(spark, sf):
    m = F.col("event_id") % 7
    raw = F.when(m == 0, F.lit(float("nan"))).when(m == 1, F.lit(float("inf"))).when(m == 2, F.lit(float("-inf"))).otherwise(F.col("value") / 20)
    return events(spark, sf).select("event_id", S.clean_flag(raw).cast("bigint").alias("flag"))


SCORES = STREAMS + """,
pv AS (SELECT *, lag(value) OVER w AS pval, lag(k) OVER w AS pk FROM streams WINDOW w AS (PARTITION BY episode_id, stream ORDER BY frame_idx)),
scores AS (SELECT episode_id, stream, frame_idx, event_id, CASE WHEN pval IS NULL THEN NULL
   WHEN k % 5 = 0 OR pk % 5 = 0 THEN abs(value - pval) ELSE (abs(value - pval) + abs(k - pk)) / 2 END AS score FROM pv)"""


def scores(spark, sf):
    kk = F.when(F.col("k") % 5 == 0, F.lit(float("nan"))).otherwise(F.col("k").cast("double"))
    d = streams(spark, sf).withColumn("data", F.array(F.col("value"), kk))
    return S.delta_score(d, "data", ["episode_id", "stream"])


@query("f5_delta_score", f"WITH {SCORES} SELECT event_id, {sql_rnd('score')} AS score FROM scores")
def f5(spark, sf):
    return scores(spark, sf).select("event_id", rnd(F.col("score")).alias("score"))


THRESHOLDS = SCORES + """,
fin AS (SELECT stream, score AS s FROM scores WHERE score IS NOT NULL UNION ALL SELECT 'dead', 0.0::DOUBLE FROM scores WHERE score IS NULL),
med AS (SELECT stream, median(s) AS score_median FROM fin WHERE s > 0 GROUP BY 1),
noise AS (SELECT stream, s FROM fin JOIN med USING (stream) WHERE s > 0 AND s <= score_median),
nm AS (SELECT stream, median(s) AS noise_median, count(*) AS noise_pool_count FROM noise GROUP BY 1),
md AS (SELECT stream, median(abs(s - noise_median)) AS noise_mad FROM noise JOIN nm USING (stream) GROUP BY 1),
thr AS (SELECT stream, score_median, noise_median, noise_mad, noise_pool_count, greatest(0.0::DOUBLE, noise_median + 3.0::DOUBLE * (1.4826::DOUBLE * noise_mad)) AS threshold FROM med JOIN nm USING (stream) JOIN md USING (stream)),
ex AS (SELECT stream, count(CASE WHEN s > threshold THEN 1 END) AS exceed_count, count(*) AS n FROM fin JOIN thr USING (stream) WHERE s > 0 GROUP BY 1)"""


def _with_dead_stream(s):
    dead = s.where("score IS NULL").withColumn("stream", F.lit("dead")).withColumn("score", F.lit(0.0))
    return s.unionByName(dead)


@query("f6_contact_thresholds", f"""WITH {THRESHOLDS},
c AS (SELECT stream, count(*) AS score_count, count(CASE WHEN s > 0 THEN 1 END) AS positive_score_count, count(CASE WHEN s <= 0 THEN 1 END) AS non_positive_score_count FROM fin GROUP BY 1)
SELECT stream, score_count, positive_score_count, non_positive_score_count, noise_pool_count, exceed_count, {sql_rnd('score_median')} AS score_median, {sql_rnd('noise_median')} AS noise_median,
 {sql_rnd('noise_mad')} AS noise_mad, {sql_rnd('threshold')} AS threshold, {sql_rnd('exceed_count / n')} AS exceed_fraction, {sql_rnd('1 - exceed_count / n')} AS threshold_quantile,
 CASE WHEN threshold IS NULL THEN 'no_positive_scores' ELSE 'ok' END AS status FROM c LEFT JOIN thr USING (stream) LEFT JOIN ex USING (stream)""")
def f6(spark, sf):
    d = S.contact_thresholds(_with_dead_stream(scores(spark, sf)))
    return d.select("stream", "score_count", "positive_score_count", "non_positive_score_count", "noise_pool_count", "exceed_count", "status",
                    *[rnd(F.col(c)).alias(c) for c in ("score_median", "noise_median", "noise_mad", "threshold", "exceed_fraction", "threshold_quantile")])


@query("f6_score_summary", f"""WITH {SCORES}
SELECT stream, count(score) AS count, {sql_rnd('min(score)')} AS min, {sql_rnd('max(score)')} AS max, {sql_rnd('avg(score)')} AS mean, {sql_rnd('stddev_pop(score)')} AS std,
 {', '.join(f"{sql_rnd(f'quantile_cont(score, {q})')} AS {n}" for n, q in S.SUMMARY_QUANTILES.items())} FROM scores GROUP BY 1""")
def f6_summary(spark, sf):
    d = S.score_summary(scores(spark, sf), ["stream"])
    return d.select("stream", "count", *[rnd(F.col(c)).alias(c) for c in ("min", "max", "mean", "std", *S.SUMMARY_QUANTILES)])




@query("f7_contact_flag", f"""WITH {THRESHOLDS}
SELECT episode_id, frame_idx, bool_or(coalesce(score > threshold, false)) AS is_contact FROM scores JOIN thr USING (stream) GROUP BY 1, 2""")
def f7(spark, sf):
    s = scores(spark, sf)
    d = S.contact_flag(s, S.contact_thresholds(s), ["episode_id", "frame_idx"])
    return d.select("episode_id", *bigint("frame_idx"), "is_contact")


@query("f7_missing_thresholds", f"""WITH {THRESHOLDS} SELECT DISTINCT stream FROM fin WHERE stream NOT IN (SELECT stream FROM thr)""")
def f7_missing(spark, sf):
    s = _with_dead_stream(scores(spark, sf))
    return S.missing_thresholds(s, S.contact_thresholds(s))


@query("f8_contact_dropout", """SELECT event_id, NOT (value > 5 AND CAST(('0x' || substr(md5(concat_ws('|', '9', CAST(event_id AS VARCHAR))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE <= 0.4::DOUBLE) AS state_mask FROM events""")
def f8(spark, sf):
    d = events(spark, sf).select("event_id", (F.col("value") > 5).alias("is_contact"), F.lit(True).alias("state_mask"))
    return S.contact_dropout(d, 0.4, F.col("event_id"), ["state_mask"], 9).select("event_id", "state_mask")


TACTILE = """tact AS (SELECT domain, episode_id, frame_idx, flag AS sensor, status AS ttype, [1, 2, CAST(q0 AS BIGINT) % 3 + 4, 3] AS shape, CAST(q1 AS BIGINT) % 24 AS area FROM frames)"""


def tactile(spark, sf):
    # halves go to the even number, as in a cast of the SQL
    d = frames(spark, sf)
    return d.select("domain", "episode_id", "frame_idx", F.array("flag").alias("sensor_meta"), F.array(F.col("status").cast("binary")).alias("type_meta"),
                    F.array(F.lit(1), F.lit(2), (F.rint("q0").cast("bigint") % 3 + 4).cast("int"), F.lit(3)).alias("shape"),
                    (F.rint("q1").cast("bigint") % 24).alias("area"))


@query("f9_stream_identity", f"""WITH {FRAMES}, {TACTILE}
SELECT sensor || '_' || ttype || '_' || CAST(shape[3] AS VARCHAR) || '_3' AS stream, count(*) AS n FROM tact GROUP BY 1""")
def f9(spark, sf):
    d = tactile(spark, sf)
    key = S.stream_identity(S.first_text(F.col("sensor_meta")), S.first_text(F.col("type_meta")), F.col("shape"))
    return d.select(key.alias("stream")).groupBy("stream").agg(F.count(F.lit(1)).alias("n"))


@query("f10_stream_catalog", f"""WITH {FRAMES}, {TACTILE},
o AS (SELECT *, row_number() OVER (PARTITION BY domain, sensor ORDER BY episode_id, frame_idx) AS r FROM tact)
SELECT domain, sensor AS stream, ttype, area, shape[3] AS height FROM o WHERE r = 1""")
def f10(spark, sf):
    d = tactile(spark, sf).withColumn("stream", S.first_text(F.col("sensor_meta"))).withColumn("ttype", S.first_text(F.col("type_meta")))
    d = S.stream_catalog(d, ["episode_id", "frame_idx"], cols=["shape", "area", "ttype"])
    return d.select("domain", "stream", "ttype", "area", F.get("shape", F.lit(2)).cast("bigint").alias("height"))


@query("f11_metadata_drift", f"""WITH {FRAMES}
SELECT domain, episode_id, arg_min(flag, frame_idx) AS first_flag, count(DISTINCT flag) > 1 AS drift_flag, arg_min(status, frame_idx) AS first_status, count(DISTINCT status) > 1 AS drift_status FROM frames GROUP BY 1, 2""")
def f11(spark, sf):
    return S.metadata_drift(frames(spark, sf), ["flag", "status"], ["domain", "episode_id"])


@query("f12_blank_frames", f"""WITH {SAMPLES}, m AS (SELECT episode_id, count(*) // 2 AS m FROM samples GROUP BY 1)
SELECT episode_id, frame_idx, event_id, k % 4 IN (0, 1) AS is_blank FROM samples JOIN m USING (episode_id) WHERE frame_idx = m""")
def f12(spark, sf):
    z = F.lit(0).cast("bigint")
    px = F.when(F.col("k") % 4 == 0, F.array().cast("array<bigint>")).when(F.col("k") % 4 == 1, F.array(z, z)).otherwise(F.array(z, F.col("event_id") + 1))
    d = S.middle_frames(samples(spark, sf).withColumn("px", px))
    return d.select("episode_id", *bigint("frame_idx"), "event_id", S.blank_frame(F.col("px")).alias("is_blank"))


@query("f13_expand_gray_flatten_areas", f"""WITH {VECTORS}, a AS (SELECT vec_id, j AS area_no, v[j * 16 + 1 : j * 16 + 16] AS px FROM vectors, (SELECT unnest(range(0, 4)) AS j)),
f AS (SELECT vec_id, area_no, flatten(list_transform(px, lambda x: [x, x, x])) AS rgb FROM a) {sql_forms('f', 'vec_id, area_no', ['rgb'])}""")
def f13(spark, sf):
    d = vectors(spark, sf).select("vec_id", F.array(*[F.slice("v", i * 16 + 1, 16) for i in range(4)]).alias("data"))
    d = S.flatten_areas(d).withColumn("rgb", S.expand_gray(F.col("data"))).withColumn("area_no", F.col("area_no").cast("bigint"))
    return forms(d, ["vec_id", "area_no"], ["rgb"])
