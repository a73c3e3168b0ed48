"""Streaming pieces against plain loops."""

import math
from datetime import datetime, timedelta, timezone

import numpy as np
import pytest

from episodica.streaming import accumulators as A, monitor as M


@pytest.mark.parametrize("seed", range(5))
def test_put_buckets_match_a_loop(spark, seed):
    rng = np.random.default_rng(seed)
    ts = [float(x) for x in np.sort(rng.random(12) * 20 - 3)]
    want, nxt = [], None
    for i, t in enumerate(ts):
        g = math.floor(t - 0.5 + 1e-5)
        if g < 0:
            continue
        nxt = g if nxt is None else nxt
        while nxt <= g:
            want.append((nxt, i))
            nxt += 1
    d = spark.createDataFrame([(ts,)], "ts array<double>").select(A.put_buckets("ts", 0.5, 1.0).alias("b"))
    assert [(x.bucket, x.i) for x in d.first().b] == want


def test_late_rows_are_dropped_by_the_state(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in ([(1, 5.0, 0), (1, 7.0, 1)], [(1, 6.0, 2), (1, 7.0, 3), (1, 8.0, 4)]):
        spark.createDataFrame(part, "episode_id long, ts double, n long").coalesce(1).write.mode("append").parquet(src)
    s = spark.readStream.schema("episode_id long, ts double, n long").option("maxFilesPerTrigger", 1).parquet(src)
    out = M.run_to_end(A.strictly_newer_stream(s, "n"), "append", "t")
    assert sorted(r.n for r in spark.read.parquet(out).collect()) == [0, 1, 4]


def test_running_stats_quantiles_within_a_bin(spark, tmp_path):
    rng = np.random.default_rng(9)
    v = rng.normal(size=3000)
    src = str(tmp_path / "in")
    for part in np.array_split(v, 3):
        spark.createDataFrame([("k", float(x)) for x in part], "key string, value double").coalesce(1).write.mode("append").parquet(src)
    sink = M.RunningStatsSink(spark, ["key"])
    sink.start(spark.readStream.schema("key string, value double").option("maxFilesPerTrigger", 1).parquet(src)).awaitTermination()
    r = sink.statistics().first()
    width = (v.max() - v.min()) / 5000
    assert r.n == 3000 and r["mean"] == pytest.approx(v.mean()) and r["std"] == pytest.approx(v.std())
    for q, got in ((0.01, r.q01), (0.99, r.q99)):
        assert abs(got - np.sort(v)[math.ceil(q * 3000) - 1]) <= 3 * width


def feed_rows(spark, path, parts, schema, name, make, mode="append"):
    """Run a stream over parts, one micro-batch each; (rows, progress)."""
    spark.createDataFrame([], schema).write.parquet(path)

    def feed():
        for part in parts:
            spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(path)
            yield

    progress = []
    out = M.run_to_end(make(spark.readStream.schema(schema).parquet(path)), mode, name, feed(), progress)
    return spark.read.parquet(out), progress


T = "episode_id long, ts double, n long, time timestamp"


def at(s):
    return datetime(2024, 1, 1, tzinfo=timezone.utc) + timedelta(seconds=s)


def rec(e, ts, n):
    return (e, float(ts), n, at(ts))


def test_a_silent_episode_is_forgotten_and_begins_anew(spark, tmp_path):
    end = [(None, None, None, at(10_000))]
    parts = [[rec(1, 0, 0), rec(1, 2, 1), rec(2, 1, 2)], [rec(2, 40, 3)], [rec(1, 100, 4), rec(2, 99, 5)], end]
    got, progress = feed_rows(spark, str(tmp_path / "a"), parts, T, "silent", lambda s: A.strictly_newer_stream(s, "n", silence=30.0, time="time"))
    assert sorted(r.n for r in got.collect()) == [0, 1, 2, 3, 4, 5]
    left = M.state_rows(progress)
    assert max(left) > 0 and left[-1] == 0


def test_runs_of_a_key_are_cut_to_what_matters(spark, tmp_path):
    rng = np.random.default_rng(0)
    ts = rng.random(5000) * 50
    rows = [rec(1, t, i) for i, t in enumerate(ts)] + [rec(None, 3.5, -1)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        got, _ = feed_rows(spark, str(tmp_path / "a"), [rows, [rec(1, 60, 9999)]], T, "runs", lambda s: A.obs_accumulator_stream(s, 0.0, 1.0))
        got = sorted((r.episode_id or 0, r.bucket, r.n) for r in got.collect())
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    first, nxt, want = np.argsort(ts), 0, [(0, b, -1) for b in range(4)]
    for i in first:
        while nxt <= int(ts[i] + 1e-5):
            want.append((1, nxt, int(i)))
            nxt += 1
    want += [(1, b, 9999) for b in range(nxt, 61)]
    assert got == sorted(want)


def test_actions_are_handed_on_when_the_episode_ends(spark, tmp_path):
    schema = "episode_id long, put_no long, ts array<double>, v array<long>, time timestamp"
    big = 2**60 + 1
    parts = [[(1, 0, [0.5, 1.5, 2.5], [10, 11, big], at(0)), (2, 0, [0.5], [7], at(0))], [(1, 1, [2.2, 3.1], [20, 21], at(2)), (1, 2, [], [], at(3))], [(None, None, None, None, at(9_999))]]
    got, progress = feed_rows(spark, str(tmp_path / "a"), parts, schema, "act", lambda s: A.action_buffer_stream(s, 0.0, 1.0, "v", 60.0, "time"))
    assert sorted(map(tuple, got.select("episode_id", "bucket", "put_no", "v").collect())) == [(1, 0, 0, 10), (1, 1, 0, 11), (1, 2, 1, 20), (1, 3, 1, 21), (2, 0, 0, 7)]
    assert M.state_rows(progress)[-1] == 0


def test_camera_records_meet_frames_and_leave(spark, tmp_path):
    fs, cs = "episode_id long, frame_idx long, start double, time timestamp", "episode_id long, ts double, pic string, cam_time timestamp"
    frame = lambda e, i: (e, i, 0.0, at(i))
    cam = lambda e, t, p: (e, float(t), p, at(t))
    slices = [
        ([frame(1, 0), frame(1, 1), frame(None, 0)], [cam(1, 0.2, "a"), cam(None, 0.1, "z")]),
        ([frame(1, 2), frame(1, 3)], [cam(1, 2.4, "c"), cam(1, 1.7, "b"), cam(1, 2.9, "d")]),
        # the camera is silent for longer than the gap: frame 4 stays without a record
        ([frame(1, 4), frame(1, 30)], [cam(1, 30.5, "e")]),
        ([frame(-1, 900)], [cam(-2, 900, "end")]),
    ]
    f, c = str(tmp_path / "f"), str(tmp_path / "c")
    spark.createDataFrame([], fs).write.parquet(f)
    spark.createDataFrame([], cs).write.parquet(c)

    def feed():
        for a, b in slices:
            spark.createDataFrame(a, fs).write.mode("append").parquet(f)
            spark.createDataFrame(b, cs).write.mode("append").parquet(c)
            yield

    s = A.attach_camera_stream(spark.readStream.schema(fs).parquet(f), spark.readStream.schema(cs).parquet(c), 1.0, ["pic"], "start", "time", "cam_time", "5 SECONDS", "1 second")
    progress = []
    got = spark.read.parquet(M.run_to_end(s, "append", "cam", feed(), progress)).collect()
    assert sorted((r.episode_id or 0, r.frame_idx, r.pic) for r in got) == [(0, 0, "z"), (1, 0, "a"), (1, 1, "b"), (1, 2, "c"), (1, 30, "e")]
    assert M.state_rows(progress)[-1] <= 2


def test_sketch_state_is_small_and_replays(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=30_000)
    sink = M.SketchStatsSink(spark, ["key"])
    for i, part in enumerate(np.array_split(v, 5)):
        d = spark.createDataFrame([(None if j % 2 else "k", float(x)) for j, x in enumerate(part)] + [("k", float("nan"))], "key string, value double")
        sink._merge_batch(d, i)
        if i == 3:
            sink._merge_batch(d, i)
    assert sink._batches() == [3, 4] and sink.state_bytes() < 32_768
    halves = {"k": np.concatenate([p[0::2] for p in np.array_split(v, 5)]), None: np.concatenate([p[1::2] for p in np.array_split(v, 5)])}
    for r in sink.statistics((("q01", 0.01), ("q50", 0.5), ("q99", 0.99))).collect():
        x = np.sort(halves[r.key])
        assert r.n == len(x) and r["mean"] == pytest.approx(x.mean()) and r["std"] == pytest.approx(x.std())
        for q, got in ((0.01, r.q01), (0.5, r.q50), (0.99, r.q99)):
            assert abs(np.searchsorted(x, got) / len(x) - q) <= 2 * sink.rank_error()
