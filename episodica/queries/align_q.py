"""Queries over clock alignment, resampling and frame windows."""

from pyspark.sql import functions as F

from episodica.operators import align as A
from episodica.queries.common import EVENTS, SAMPLES, bigint, events, hide, samples, table
from episodica.registry import query, rnd, sql_rnd
from episodica.sources.frames import index_frames

DT = 21_600.0  # six hours

ALIGNED = """g AS (SELECT *, CAST(floor((ts - {start}) / 21600.0::DOUBLE + 1e-5::DOUBLE) AS BIGINT) AS g FROM samples),
p AS (SELECT *, max(g) OVER (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g {where}),
aligned AS (SELECT * EXCLUDE (g, prev), unnest(range(greatest(coalesce(prev + 1, {first}), {first}), least(g, {stop}) + 1)) AS bucket FROM p)"""


@query("d1_grid_align", f"""WITH {SAMPLES}, {ALIGNED.format(start='86400.0::DOUBLE', where='WHERE g >= 0', first=0, stop='g')}
SELECT episode_id, bucket, event_id, {sql_rnd('value')} AS value FROM aligned""")
def d1(spark, sf):
    d = A.grid_align(samples(spark, sf), 86_400.0, DT)
    return d.select("episode_id", "bucket", "event_id", rnd(F.col("value")).alias("value"))


@query("d2_align_to_targets", f"""WITH {SAMPLES}, {ALIGNED.format(start='864000.0::DOUBLE', where='', first=-8, stop=90)},
l AS (SELECT episode_id, arg_max(event_id, frame_idx) AS event_id, greatest(max(g) + 1, -8) AS lo FROM g GROUP BY 1)
SELECT episode_id, bucket, event_id FROM aligned
UNION ALL SELECT episode_id, unnest(range(lo, 91)), event_id FROM l""")
def d2(spark, sf):
    return A.align_to_targets(samples(spark, sf), 864_000.0, DT, -8, 90).select("episode_id", "bucket", "event_id")


@query("d3_attach_camera", f"""WITH {SAMPLES},
cam AS (SELECT doc_id % 150 AS episode_id, doc_id, (doc_id * 7919) % 2400000 * 1.0::DOUBLE AS ts, n_chars FROM documents),
ci AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ts, doc_id) - 1 AS i FROM cam),
sp AS (SELECT episode_id, min(ts) AS s, max(frame_idx) AS last FROM samples GROUP BY 1),
g AS (SELECT ci.*, last, CAST(floor((ci.ts - s) / 36000.0::DOUBLE + 1e-5::DOUBLE) AS BIGINT) AS g FROM ci JOIN sp USING (episode_id) WHERE ci.ts >= s - 36000),
p AS (SELECT *, max(g) OVER (PARTITION BY episode_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g WHERE g >= 0),
a AS (SELECT episode_id, doc_id, ts AS camera_ts, n_chars, unnest(range(coalesce(prev + 1, 0), least(g, last) + 1)) AS frame_idx FROM p)
SELECT episode_id, frame_idx, event_id, doc_id, camera_ts, n_chars FROM samples JOIN a USING (episode_id, frame_idx)""")
def d3(spark, sf):
    cam = table(spark, sf, "documents").select(
        (F.col("doc_id") % 150).alias("episode_id"), "doc_id",
        ((F.col("doc_id") * 7919) % 2_400_000).cast("double").alias("ts"), "n_chars")
    cam = index_frames(cam, ["episode_id"], ["ts", "doc_id"], F.floor(F.col("ts") / 3600))
    frames = samples(spark, sf)
    d = A.attach_camera(frames, hide(cam), 36_000.0, ["doc_id", "n_chars"])
    return d.select("episode_id", *bigint("frame_idx"), "event_id", "doc_id", "camera_ts", "n_chars")


@query("d4_obs_accumulator", f"""WITH {SAMPLES}, {ALIGNED.format(start='0.0::DOUBLE', where='WHERE g >= 0', first=0, stop='g')}
SELECT episode_id, bucket, {sql_rnd('bucket * 21600.0::DOUBLE')} AS bucket_ts, event_id FROM aligned""")
def d4(spark, sf):
    return A.obs_accumulator(samples(spark, sf), 0.0, DT).select("episode_id", "bucket", rnd(F.col("bucket_ts")).alias("bucket_ts"), "event_id")


@query("d5_action_accumulator", f"""WITH {SAMPLES},
g AS (SELECT *, k % 4 AS put_no, CAST(floor((ts - 172800.0::DOUBLE) / 21600.0::DOUBLE + 1e-5::DOUBLE) AS BIGINT) AS g FROM samples),
p AS (SELECT *, max(g) OVER (PARTITION BY episode_id, put_no ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g WHERE g >= 0),
a AS (SELECT episode_id, put_no, event_id, unnest(range(coalesce(prev + 1, g), g + 1)) AS bucket FROM p)
SELECT episode_id, bucket, CAST(max(put_no) AS BIGINT) AS put_no, arg_max(event_id, put_no) AS event_id FROM a GROUP BY 1, 2""")
def d5(spark, sf):
    d = samples(spark, sf).withColumn("put_no", F.col("k") % 4)
    d = A.action_accumulator(d, 172_800.0, DT, ["event_id"])
    return d.select("episode_id", *bigint("bucket", "put_no"), "event_id")


@query("d6_strictly_newer", f"""WITH {SAMPLES},
a AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY k, event_id) AS i FROM events0),
m AS (SELECT *, max(ts) OVER (PARTITION BY episode_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM a)
SELECT episode_id, event_id FROM m WHERE seen IS NULL OR ts > seen""")
def d6(spark, sf):
    d = index_frames(events(spark, sf), ["episode_id"], ["k", "event_id"], F.col("k"))
    return A.strictly_newer(d).select("episode_id", "event_id")


GRID = """gp AS (SELECT episode_id, min(ts) AS s, max(ts) AS e, (max(ts) - min(ts)) / (count(*) - 1) / 1.7::DOUBLE AS dt FROM samples GROUP BY 1 HAVING count(*) > 1),
grid AS (SELECT episode_id, unnest(range(0, CAST(floor((e - s) / dt) AS BIGINT) + 1)) AS grid_idx, s, dt FROM gp),
gt AS (SELECT episode_id, grid_idx, s + grid_idx * dt AS t FROM grid),
nx AS (SELECT *, lead(ts) OVER w AS ts2, lead(value) OVER w AS v2 FROM samples WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)),
br AS (SELECT gt.*, n.ts, n.ts2, n.value, n.v2, n.stream, n.k FROM gt ASOF JOIN nx n ON gt.episode_id = n.episode_id AND gt.t >= n.ts)"""


@query("d7_resample_grid", f"WITH {SAMPLES}, {GRID} SELECT episode_id, grid_idx, CAST(floor(t * 1000.0::DOUBLE) AS BIGINT) AS t_ms FROM gt")
def d7(spark, sf):
    return A.resample_grid(samples(spark, sf), 1.7).select("episode_id", "grid_idx", F.floor(F.col("t") * 1000.0).alias("t_ms"))


@query("d8_interp_linear", f"""WITH {SAMPLES}, {GRID}
SELECT episode_id, grid_idx, {sql_rnd('CASE WHEN ts2 IS NULL THEN value ELSE value + (v2 - value) * ((t - ts) / (ts2 - ts)) END', 4)} AS value FROM br""")
def d8(spark, sf):
    return A.interp_linear(samples(spark, sf), 1.7, ["value"]).select("episode_id", "grid_idx", rnd(F.col("value"), 4).alias("value"))


@query("d10_interp_floor", f"""WITH {SAMPLES}, {GRID}, f AS (SELECT episode_id, stream AS first_stream FROM samples WHERE frame_idx = 0)
SELECT episode_id, grid_idx, CAST(k AS BIGINT) AS k, first_stream FROM br JOIN f USING (episode_id)""")
def d10(spark, sf):
    d = A.interp_floor(samples(spark, sf), 1.7, ["k"], ["stream"])
    return d.select("episode_id", "grid_idx", *bigint("k"), "first_stream")


@query("d11_history", f"""WITH {SAMPLES}
SELECT episode_id, frame_idx, coalesce(lag(event_id, 7) OVER w, first_value(event_id) OVER w) AS h0, coalesce(lag(event_id, 2) OVER w, first_value(event_id) OVER w) AS h1, event_id AS h2
FROM samples WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx)""")
def d11(spark, sf):
    d = A.history(samples(spark, sf), ["event_id"], [2, 7])
    return d.select("episode_id", *bigint("frame_idx"), *[F.get("hist_event_id", F.lit(i)).alias(f"h{i}") for i in range(3)])


def sql_chunk(h, s, clamp=False):
    last = "l" if clamp else f"frame_idx + (l - frame_idx) // {s} * {s}"
    return f"""e AS (SELECT *, max(frame_idx) OVER (PARTITION BY episode_id) AS l FROM samples),
x AS (SELECT episode_id, frame_idx, l, j, least(frame_idx + j * {s}, {last}) AS src FROM e, (SELECT unnest(range(0, {h})) AS j)),
chunks AS (SELECT x.episode_id, x.frame_idx, x.j, CAST(least({h}, (x.l - x.frame_idx) // {s} + 1) AS BIGINT) AS n_valid, s.event_id, s.value FROM x JOIN samples s ON s.episode_id = x.episode_id AND s.frame_idx = x.src)"""


def _steps(d, col):
    return d.select("episode_id", *bigint("frame_idx", "n_valid"), F.posexplode(col).alias("j", "event_id")).select(
        "episode_id", "frame_idx", "n_valid", *bigint("j"), "event_id")


@query("d12_action_chunk", f"WITH {SAMPLES}, {sql_chunk(8, 3)} SELECT episode_id, frame_idx, n_valid, j, event_id FROM chunks")
def d12(spark, sf):
    return _steps(A.action_chunk(samples(spark, sf), ["event_id"], 8, 3), "chunk_event_id")


@query("d12_action_chunk_clamped", f"WITH {SAMPLES}, {sql_chunk(8, 3, True)} SELECT episode_id, frame_idx, n_valid, j, event_id FROM chunks")
def d12_clamp(spark, sf):
    return _steps(A.action_chunk(samples(spark, sf), ["event_id"], 8, 3, clamp=True), "chunk_event_id")


@query("d13_lookahead_by_time", f"""WITH {SAMPLES}, e AS (SELECT *, max(frame_idx) OVER (PARTITION BY episode_id) AS l FROM samples)
SELECT e.episode_id, e.frame_idx, j.d AS k, e.frame_idx + j.d > e.l AS is_pad, s.event_id
FROM e, (SELECT unnest([0, 2, 5]) AS d) j JOIN samples s ON s.episode_id = e.episode_id AND s.frame_idx = least(e.frame_idx + j.d, e.l)""")
def d13(spark, sf):
    d = A.lookahead_by_time(samples(spark, sf), ["event_id"], 10.0, [0.0, 0.2, 0.5])
    z = F.arrays_zip(F.array(F.lit(0), F.lit(2), F.lit(5)).alias("k"), F.col("is_pad"), F.col("at_event_id"))
    d = d.select("episode_id", *bigint("frame_idx"), F.explode(z).alias("z"))
    return d.select("episode_id", "frame_idx", F.col("z")["k"].cast("bigint").alias("k"), "z.is_pad", F.col("z.at_event_id").alias("event_id"))


@query("d13_lookahead_by_ts", f"""WITH {SAMPLES}, e AS (SELECT *, max(ts) OVER (PARTITION BY episode_id) AS l FROM samples),
j AS (SELECT unnest([0, 1, 2]) AS k, unnest([0.0::DOUBLE, 3600.0::DOUBLE, 86400.0::DOUBLE]) AS d),
n AS (SELECT e.episode_id, e.frame_idx, j.k, e.ts + d > e.l AS is_pad, s.event_id, abs(s.ts - (e.ts + d)) AS off,
  row_number() OVER (PARTITION BY e.episode_id, e.frame_idx, j.k ORDER BY abs(s.ts - (e.ts + d)), s.ts) AS r
  FROM e, j, samples s WHERE s.episode_id = e.episode_id)
SELECT episode_id, frame_idx, CAST(k AS BIGINT) AS k, is_pad, NOT is_pad AND off > 7200 AS is_off, event_id FROM n WHERE r = 1""")
def d13_ts(spark, sf):
    d = A.lookahead_by_ts(samples(spark, sf), ["event_id"], [0.0, 3600.0, 86400.0], 7200.0, ["episode_id"], 86400.0)
    return d.select("episode_id", *bigint("frame_idx", "k"), "is_pad", "is_off", "event_id")


@query("d0_index_null_keys", f"""WITH {EVENTS}, n AS (SELECT event_id, CASE WHEN event_id % 5 = 0 THEN NULL ELSE stream END AS key, CASE WHEN event_id % 50 = 0 THEN NULL ELSE ts END AS t FROM events0)
SELECT key, event_id, row_number() OVER (PARTITION BY key ORDER BY t NULLS FIRST, event_id) - 1 AS frame_idx FROM n""")
def d0_null_keys(spark, sf):
    """Null keys and null order values are numbered like any other, in blocks too."""
    d = events(spark, sf).select("event_id", F.when(F.col("event_id") % 5 != 0, F.col("stream")).alias("key"), F.when(F.col("event_id") % 50 != 0, F.col("ts")).alias("t"))
    out = index_frames(d, ["key"], ["t", "event_id"], F.floor(F.col("t") / 86400), hot_rows=500)
    return out.select("key", "event_id", *bigint("frame_idx"))


@query("d14_instruction_boundary_mask", """WITH t AS (SELECT conv_id AS episode_id, turn AS frame_idx, substr(role, 1, 1) || CAST(turn // 3 AS VARCHAR) AS ins,
 max(turn) OVER (PARTITION BY conv_id) AS l FROM conversations),
x AS (SELECT episode_id, frame_idx, ins, j, least(frame_idx + j, l) AS src FROM t, (SELECT unnest(range(0, 5)) AS j)),
y AS (SELECT x.*, t.ins <> x.ins AS diff FROM x JOIN t ON t.episode_id = x.episode_id AND t.frame_idx = x.src)
SELECT episode_id, frame_idx, ins AS prompt, j, CASE WHEN bool_or(diff) OVER (PARTITION BY episode_id, frame_idx ORDER BY j) THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END AS mask FROM y""")
def d14(spark, sf):
    c = table(spark, sf, "conversations").select(
        F.col("conv_id").alias("episode_id"), F.col("turn").alias("frame_idx"),
        F.concat(F.substring("role", 1, 1), F.floor(F.col("turn") / 3).cast("string")).alias("ins"))
    d = A.action_chunk(c, ["ins"], 5).withColumn("mask", F.array_repeat(F.lit(1.0), 5))
    d = A.instruction_boundary_mask(d, "chunk_ins", "mask")
    return d.select("episode_id", "frame_idx", "prompt", F.posexplode("mask").alias("j", "mask")).withColumn("j", F.col("j").cast("bigint"))


@query("d15_open_loop_steps", f"""WITH {SAMPLES}
SELECT s.episode_id, s.frame_idx, s.frame_idx // 6 * 6 AS predicted_at, s.event_id AS action FROM samples s""")
def d15(spark, sf):
    d = A.action_chunk(samples(spark, sf), ["event_id"], 8)
    return A.open_loop_steps(d, "chunk_event_id", 6).select("episode_id", *bigint("frame_idx", "predicted_at"), "action")


@query("d16_static_window_flag", f"""WITH {SAMPLES}, p AS (SELECT episode_id, frame_idx, CASE WHEN k < 90 THEN 1.0::DOUBLE ELSE value END AS x FROM samples)
SELECT episode_id, frame_idx, max(x) OVER w - first_value(x) OVER w <= 1e-6::DOUBLE + 1e-5::DOUBLE * abs(first_value(x) OVER w)
  AND first_value(x) OVER w - min(x) OVER w <= 1e-6::DOUBLE + 1e-5::DOUBLE * abs(first_value(x) OVER w) AS is_static
FROM p WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx ROWS BETWEEN 5 PRECEDING AND 6 FOLLOWING)""")
def d16(spark, sf):
    d = samples(spark, sf).withColumn("x", F.when(F.col("k") < 90, F.lit(1.0)).otherwise(F.col("value")))
    return A.static_window_flag(d, [F.col("x")], 0, 3).select("episode_id", *bigint("frame_idx"), "is_static")
