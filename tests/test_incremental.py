"""Statistics kept file by file."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import normalize as N
from episodica.sources.stats_store import BINS, StatsStore


def rows(rng, key, n, at=0.0):
    return [(key, [float(at + rng.normal()), float(rng.integers(5)), float("nan") if rng.random() < 0.1 else -1e6 - float(rng.random())]) for _ in range(n)]


def check(store, data):
    got = {(r.domain, r.dim): r for r in store.statistics((("q10", 0.1), ("q90", 0.9))).collect()}
    keys = {k for k, _ in data}
    assert set(got) == {(k, d) for k in keys for d in range(3)}
    for k in keys:
        v = np.array([x for key, x in data if key == k])
        for d in range(3):
            x, r = v[:, d][np.isfinite(v[:, d])], got[k, d]
            assert (r.n, r["min"], r["max"]) == (len(x), x.min(), x.max())
            assert r["mean"] == pytest.approx(x.mean(), rel=1e-12) and r["std"] == pytest.approx(x.std(), rel=1e-6, abs=1e-9)
            for q, v_q in ((0.1, r.q10), (0.9, r.q90)):
                want = np.sort(x)[int(np.ceil(q * len(x))) - 1]
                assert abs(v_q - want) <= abs(want) / BINS * 2 + 1e-12


def test_appends_removals_and_replacements(spark, tmp_path):
    rng = np.random.default_rng(0)
    data, root = f"file://{tmp_path}/data", f"file://{tmp_path}/stats"
    store = StatsStore(spark, data, root, ["domain"], "v")
    parts = [rows(rng, "a", 80) + rows(rng, None, 30, 5.0), rows(rng, "a", 50, 1e5), rows(rng, "b", 1)]
    seen, read = [], 0
    for part in parts:
        spark.createDataFrame(part, "domain string, v array<double>").repartition(2).write.mode("append").parquet(data)
        seen += part
        names = store.refresh()
        assert names and len(names) <= 2
        read += len(names)
        check(store, seen)
    assert read == store.files().count() and store.refresh() == []
    z = {(r.domain, r.dim): (r.lo, r.hi) for r in store.norm_stats("zscore").collect()}
    s = {(r.domain, r.dim): (r.lo, r.hi) for r in N.norm_fit(spark.read.parquet(data), ["domain"], "v", "zscore").collect()}
    assert z.keys() == s.keys() and all(z[k] == pytest.approx(s[k], rel=1e-6) for k in z)
    # a refresh that is done again counts nothing twice
    store._add([r.file for r in store.files().collect()][:1], store.files())
    check(store, seen)
    # the whole table written anew: the old partials no longer count
    spark.createDataFrame(parts[0], "domain string, v array<double>").coalesce(1).write.mode("overwrite").parquet(data)
    assert len(store.refresh()) == 1
    check(store, parts[0])


def test_without_partials_there_is_an_error(spark, tmp_path):
    spark.createDataFrame([("a", [1.0])], "domain string, v array<double>").write.parquet(f"file://{tmp_path}/d")
    with pytest.raises(ValueError, match="refresh"):
        StatsStore(spark, f"file://{tmp_path}/d", f"file://{tmp_path}/s", ["domain"], "v").statistics()


@pytest.mark.parametrize("norm", ["zscore", "quantile"])
@pytest.mark.parametrize("horizon, stride, clamp, per_time", [(4, 1, False, False), (5, 3, False, True), (5, 3, True, False), (3, 2, True, True)])
def test_weighted_frames_equal_exploded_chunks(spark, norm, horizon, stride, clamp, per_time):
    from episodica.operators import align as A

    rng = np.random.default_rng(horizon + stride)
    data = [(f"d{e % 2}" if e else None, e if e != 3 else None, i, [float(rng.normal()), float(rng.integers(3))]) for e in range(6) for i in range(int(rng.integers(1, 14)))]
    d = spark.createDataFrame(data, "domain string, episode_id long, frame_idx long, v array<double>")
    got = N.norm_fit_chunks(d, ["domain"], "v", norm, horizon, stride, clamp, per_time=per_time)
    want = N.norm_fit(A.action_chunk(d, ["v"], horizon, stride, clamp), ["domain"], "chunk_v", norm, per_time=per_time)
    keys = ["domain", "t", "dim"] if per_time else ["domain", "dim"]
    a, b = ({tuple(r[k] for k in keys): (r.lo, r.hi) for r in x.collect()} for x in (got, want))
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)


def test_weights_are_the_counts_of_exploded_chunks(spark):
    from episodica.operators import align as A

    d = spark.createDataFrame([(e, i) for e, n in ((1, 9), (2, 1), (None, 4)) for i in range(n)], "episode_id long, frame_idx long")
    for horizon, stride, clamp in ((4, 1, False), (4, 3, False), (4, 3, True), (1, 2, False)):
        w = A.chunk_weights(d, horizon, stride, clamp).select("episode_id", "frame_idx", F.posexplode("weights").alias("t", "n")).where("n > 0")
        c = A.action_chunk(d, ["frame_idx"], horizon, stride, clamp).select("episode_id", F.posexplode("chunk_frame_idx").alias("t", "frame_idx"))
        want = {(r.episode_id, r.frame_idx, r.t): r["count"] for r in c.groupBy("episode_id", "frame_idx", "t").count().collect()}
        assert {(r.episode_id, r.frame_idx, r.t): r.n for r in w.collect()} == want
