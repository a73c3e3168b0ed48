"""Streaming queries; each must give the result of its batch form."""

from pyspark.sql import functions as F

from episodica.queries.align_q import ALIGNED, DT
from episodica.queries.common import EVENTS, SAMPLES, bigint, events, samples, table
from episodica.registry import ORACLES, query, rnd, sql_rnd
from episodica.session import scratch_path
from episodica.streaming import accumulators as A, monitor as M

SLICES = 3
SPAN = 2_592_000.0  # the events cover thirty days


def _stream(spark, df, name, by="ts", span=SPAN, time=None, days=100, **closing):
    """(stream, feed): the table as consecutive slices, each written in parallel and then read as one micro-batch.

    With an event time a closing row follows, so that all state can end.
    """
    path = scratch_path(spark, name)
    df = df.withColumn("__s", F.least(F.floor(F.col(by) / (span / SLICES)), F.lit(SLICES - 1)))
    plain = df.drop("__s")
    plain.limit(0).write.parquet(path)

    def feed():
        for i in range(SLICES):
            df.where(F.col("__s") == i).drop("__s").write.mode("append").parquet(path)
            yield i
        if time is not None:
            _closing(plain, time, days, **closing).write.mode("append").parquet(path)
            yield SLICES

    return spark.readStream.schema(plain.schema).parquet(path), feed()


#: episodes of the events count as over after forty days without a record
SILENCE = 40 * 86_400.0
EPOCH = 1_704_067_200


def time_of(seconds):
    return F.timestamp_micros(((seconds + EPOCH) * 1_000_000).cast("bigint"))


def _closing(df, time, days, **values):
    """One row some days on that has a time and nothing else but ``values``: it moves the watermark past every silence."""
    after = df.agg((F.max(time) + F.expr(f"INTERVAL {days} DAYS")).alias(time))
    return after.select(*[F.col(c) if c == time else F.lit(values.get(c)).cast(t).alias(c) for c, t in df.dtypes])


@query("d4_obs_accumulator_stream", f"""WITH {SAMPLES}, {ALIGNED.format(start='0.0::DOUBLE', where='WHERE g >= 0', first=0, stop='g')}
SELECT episode_id, bucket, event_id FROM aligned""")
def d4_stream(spark, sf):
    rows, feed = _stream(spark, events(spark, sf).select("episode_id", "event_id", "ts"), "obs")
    out = M.run_to_end(A.obs_accumulator_stream(rows, 0.0, DT), "append", "obs", feed)
    return spark.read.parquet(out).select("episode_id", *bigint("bucket"), "event_id")


@query("d5_action_accumulator_stream", f"""WITH {SAMPLES},
g AS (SELECT *, CAST(floor(ts / 172800.0::DOUBLE) AS BIGINT) * 4 + k % 4 AS put_no, CAST(floor((ts - 172800.0::DOUBLE) / 21600.0::DOUBLE + 1e-5::DOUBLE) AS BIGINT) AS g FROM samples),
p AS (SELECT *, max(g) OVER (PARTITION BY episode_id, put_no ORDER BY frame_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM g WHERE g >= 0),
a AS (SELECT episode_id, put_no, event_id, unnest(range(coalesce(prev + 1, g), g + 1)) AS bucket FROM p)
SELECT episode_id, bucket, CAST(max(put_no) AS BIGINT) AS put_no, arg_max(event_id, put_no) AS event_id FROM a GROUP BY 1, 2""")
def d5_stream(spark, sf):
    # a put is one message with the times and values of its steps, of at most two days
    e = events(spark, sf).withColumn("put_no", F.floor(F.col("ts") / 172_800.0) * 4 + F.col("k") % 4)
    puts = e.groupBy("episode_id", "put_no").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("r"))
    puts = puts.select("episode_id", "put_no", F.col("r.ts").alias("ts"), F.col("r.event_id").alias("event_id"))
    rows, feed = _stream(spark, puts, "puts", "put_no", 60.0)
    log = spark.read.parquet(M.run_to_end(A.action_accumulator_stream(rows, 172_800.0, DT, "event_id"), "update", "puts", feed))
    return A.latest(log, ["episode_id", "bucket"]).select("episode_id", *bigint("bucket", "put_no"), "event_id")


@query("d6_strictly_newer_stream", f"""WITH {SAMPLES},
a AS (SELECT *, CASE WHEN ts < 864000 THEN 0 WHEN ts < 1728000 THEN 1 ELSE 2 END AS s FROM events0),
b AS (SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY s, k, event_id) AS i FROM a),
m AS (SELECT *, max(ts) OVER (PARTITION BY episode_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM b)
SELECT episode_id, event_id FROM m WHERE seen IS NULL OR ts > seen""")
def d6_stream(spark, sf):
    # arrival order inside a slice: by slot, then id
    d = events(spark, sf).select("episode_id", "event_id", "ts", (F.col("k") * 1_000_000_000_000 + F.col("event_id")).alias("arrival"))
    rows, feed = _stream(spark, d, "newer")
    return spark.read.parquet(M.run_to_end(A.strictly_newer_stream(rows, "arrival"), "append", "newer", feed)).select("episode_id", "event_id")


@query("h5_running_stats_stream", f"""WITH {EVENTS} SELECT stream, count(*) AS n, {sql_rnd('min(value)')} AS min, {sql_rnd('max(value)')} AS max, {sql_rnd('avg(value)')} AS mean, {sql_rnd('sqrt(avg(value * value) - avg(value) ** 2)')} AS std FROM events0 GROUP BY 1""")
def h5_stream(spark, sf):
    sink = M.RunningStatsSink(spark, ["stream"])
    rows, feed = _stream(spark, events(spark, sf).select("stream", "value", "ts"), "stats")
    for _ in feed:
        sink.start(rows).awaitTermination()
    return sink.statistics().select("stream", "n", *[rnd(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")])


@query("i5_loss_steps_stream", f"""WITH {EVENTS} SELECT event_id // 500 AS "window", stream AS domain, {sql_rnd('avg(value)')} AS mean_loss, max(value) AS max_loss, count(*) AS n FROM events0 GROUP BY 1, 2""")
def i5_steps_stream(spark, sf):
    d = events(spark, sf).select(F.col("event_id").alias("step"), F.col("stream").alias("domain"), F.col("value").alias("loss"), "ts")
    rows, feed = _stream(spark, d, "loss")
    log = spark.read.parquet(M.run_to_end(M.loss_steps_stream(rows, 500), "update", "loss", feed))
    return A.latest(log, ["window", "domain"]).select("window", "domain", rnd(F.col("mean_loss")).alias("mean_loss"), "max_loss", "n")


# slices arrive in order, so no row is late; windows close once the watermark, an hour behind the last row, has passed them
@query("i5_loss_window_stream", f"""WITH {EVENTS}, d AS (SELECT *, CAST(floor(ts / 86400) AS BIGINT) AS day FROM events0)
SELECT (1704067200 + day * 86400) * 1000000 AS start_us, stream AS domain, {sql_rnd('avg(value)')} AS mean_loss, max(value) AS max_loss, count(*) AS n
FROM d WHERE (day + 1) * 86400 <= (SELECT max(ts) FROM d) - 3600 GROUP BY 1, 2""")
def i5_window_stream(spark, sf):
    d = events(spark, sf).select("ts", F.timestamp_micros(((F.col("ts") + 1_704_067_200) * 1_000_000).cast("bigint")).alias("time"), F.col("stream").alias("d0"), F.col("value").alias("loss"))
    rows, feed = _stream(spark, d, "lossw")
    s = M.loss_window_stream(rows, "time", "1 day", "1 hour", F.col("d0"))
    out = spark.read.parquet(M.run_to_end(s, "append", "lossw", feed))
    return out.select(F.unix_micros("start").alias("start_us"), "domain", rnd(F.col("mean_loss")).alias("mean_loss"), "max_loss", "n")


def _ended(progress, own=0):
    """No state is left behind the last micro-batch but the ``own`` rows of the closing ones."""
    left = M.state_rows(progress)
    if not left or left[-1] > own or max(left) <= own:
        raise AssertionError(f"state after each micro-batch: {left}")


@query("d4_obs_accumulator_timers", f"""WITH {SAMPLES}, {ALIGNED.format(start='0.0::DOUBLE', where='WHERE g >= 0', first=0, stop='g')}
SELECT episode_id, bucket, event_id FROM aligned""")
def d4_timers(spark, sf):
    """Silent episodes leave no state behind."""
    d = events(spark, sf).select("episode_id", "event_id", "ts", time_of(F.col("ts")).alias("time"))
    rows, feed = _stream(spark, d, "obs-timers", time="time")
    progress = []
    out = M.run_to_end(A.obs_accumulator_stream(rows, 0.0, DT, silence=SILENCE, time="time"), "append", "obs-timers", feed, progress)
    _ended(progress)
    return spark.read.parquet(out).select("episode_id", *bigint("bucket"), "event_id")


@query("d5_action_buffer_timers", ORACLES["d5_action_accumulator_stream"])
def d5_timers(spark, sf):
    """Every bucket once, when its episode has ended."""
    e = events(spark, sf).withColumn("put_no", F.floor(F.col("ts") / 172_800.0) * 4 + F.col("k") % 4)
    puts = e.groupBy("episode_id", "put_no").agg(F.array_sort(F.collect_list(F.struct("ts", "event_id"))).alias("r"))
    puts = puts.select("episode_id", "put_no", F.col("r.ts").alias("ts"), F.col("r.event_id").alias("event_id"), time_of(F.col("put_no") * 43_200.0).alias("time"))
    rows, feed = _stream(spark, puts, "puts-timers", "put_no", 60.0, time="time")
    progress = []
    out = M.run_to_end(A.action_buffer_stream(rows, 172_800.0, DT, "event_id", SILENCE, "time"), "append", "puts-timers", feed, progress)
    _ended(progress)
    return spark.read.parquet(out).select("episode_id", *bigint("bucket", "put_no"), "event_id")


@query("d6_strictly_newer_timers", ORACLES["d6_strictly_newer_stream"])
def d6_timers(spark, sf):
    d = events(spark, sf).select("episode_id", "event_id", "ts", (F.col("k") * 1_000_000_000_000 + F.col("event_id")).alias("arrival"), time_of(F.col("ts")).alias("time"))
    rows, feed = _stream(spark, d, "newer-timers", time="time")
    progress = []
    # inside a slice records arrive out of order, so the watermark stays a slice behind
    s = A.strictly_newer_stream(rows, "arrival", silence=SILENCE, time="time", delay="11 days")
    out = M.run_to_end(s, "append", "newer-timers", feed, progress)
    _ended(progress)
    return spark.read.parquet(out).select("episode_id", "event_id")


@query("d3_attach_camera_stream", ORACLES["d3_attach_camera"])
def d3_stream(spark, sf):
    """Frames and camera records as two streams, joined on an interval of event time."""
    dt = 36_000.0
    f = samples(spark, sf).select("episode_id", "frame_idx", "event_id", "ts")
    f = f.join(f.groupBy("episode_id").agg(F.min("ts").alias("start")), "episode_id")
    f = f.withColumn("at", F.col("start") + F.col("frame_idx") * dt).withColumn("time", time_of(F.col("at")))
    cam = table(spark, sf, "documents").select(
        (F.col("doc_id") % 150).alias("episode_id"), "doc_id", ((F.col("doc_id") * 7919) % 2_400_000).cast("double").alias("ts"), "n_chars")
    cam = cam.withColumn("cam_time", time_of(F.col("ts")))
    frames, feed = _stream(spark, f.drop("at", "ts"), "frames", "frame_idx", 90.0, "time", 400, episode_id=-1, frame_idx=0, event_id=0, start=0.0)
    camera, cam_feed = _stream(spark, cam, "camera", "ts", SPAN, "cam_time", 400, episode_id=-2, doc_id=0, ts=0.0, n_chars=0)
    # slices of either side reach far in time, so the watermark waits for the whole recording
    joined = A.attach_camera_stream(frames, camera, dt, ["doc_id", "n_chars"], "start", "time", "cam_time", "40 DAYS", "90 days", order="doc_id")
    progress = []
    out = M.run_to_end(joined, "append", "camera", (None for _ in zip(feed, cam_feed)), progress)
    _ended(progress, own=2)
    return spark.read.parquet(out).select("episode_id", *bigint("frame_idx"), "event_id", "doc_id", "camera_ts", "n_chars")


#: quantiles asked of the sketch; a rank may be off by twice its stated error
SKETCH_Q = (("q05", 0.05), ("q50", 0.5), ("q95", 0.95))


@query("h5_sketch_stats_stream", f"""WITH {EVENTS}
SELECT stream, count(*) AS n, {sql_rnd('min(value)')} AS min, {sql_rnd('max(value)')} AS max, {sql_rnd('avg(value)')} AS mean, {sql_rnd('sqrt(avg(value * value) - avg(value) ** 2)')} AS std,
 TRUE AS q05_within, TRUE AS q50_within, TRUE AS q95_within, TRUE AS small FROM events0 GROUP BY 1""")
def h5_sketch(spark, sf):
    """The share of values up to a quantile of the sketch lies within its stated error of the wanted one."""
    e = events(spark, sf).select("stream", "value", "ts")
    sink = M.SketchStatsSink(spark, ["stream"])
    rows, feed = _stream(spark, e, "sketch")
    for _ in feed:
        sink.start(rows).awaitTermination()
    s = sink.statistics(SKETCH_Q)
    v = e.join(F.broadcast(s.select("stream", *[n for n, _ in SKETCH_Q])), "stream")
    share = [a for n, _ in SKETCH_Q for a in (F.avg((F.col("value") <= F.col(n)).cast("double")).alias(f"{n}_le"), F.avg((F.col("value") < F.col(n)).cast("double")).alias(f"{n}_lt"))]
    got = v.groupBy("stream").agg(*share)
    off = 2 * sink.rank_error()
    within = [((F.col(f"{n}_le") >= q - off) & (F.col(f"{n}_lt") <= q + off)).alias(f"{n}_within") for n, q in SKETCH_Q]
    return s.join(got, "stream").select(
        "stream", "n", *[rnd(F.col(c)).alias(c) for c in ("min", "max", "mean", "std")], *within, F.lit(sink.state_bytes() < 64 * 1024).alias("small"))
