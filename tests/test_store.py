"""Stored frame tables and null keys."""

import re
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import align as A, episodes as E, normalize as N, sensors as S
from episodica.plans import quantiles as Q
from episodica.plans.blocks import episode_key, stored_keys
from episodica.session import scratch_path
from episodica.sources import frames as FR
from episodica.sources.store import open_frames, store_frames

KEYS = ["domain", "file_id", "episode_id"]


@pytest.fixture(scope="module")
def nulls(spark):
    """A hot episode, a null episode, a null file and a null domain."""
    rows = []
    for dom, f, e, n in (("a", 1, 1, 400), ("a", 1, None, 6), ("a", None, 3, 7), (None, 2, 4, 5), (None, None, None, 9), ("", 1, 1, 3)):
        rows += [(dom, f, e, i, float(i), float(i % 5), 0.0 if i < 2 else 1.0) for i in range(n)]
    return spark.createDataFrame(rows, "domain string, file_id long, episode_id long, frame_idx long, ts double, x double, a double").repartition(3).cache()


@pytest.fixture(scope="module")
def stored(spark, nulls):
    name = f"frames_{uuid.uuid4().hex}"
    store_frames(nulls, name, scratch_path(spark, "store"), KEYS, buckets=4, block_rows=50)
    return open_frames(spark, name)


def rows(df, cols):
    return sorted(map(str, df.select(*cols).collect()))


OPERATORS = {
    "trim_idle": lambda d: E.trim_idle(d, ["x"], ["a"], eps=0.5, keys=KEYS),
    "slice_episodes": lambda d: E.slice_episodes(d, stride=2, max_steps=40),
    "global_index": E.global_index,
    "take_trajectory_prefix": lambda d: E.take_trajectory_prefix(d, 0.5),
    "drop_last_episode": FR.drop_last_episode,
    "baseline_denoise": lambda d: S.baseline_denoise(d, "x", 3, 0.1, 1, KEYS),
    "middle_frames": lambda d: S.middle_frames(d, KEYS),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_stored_frames_stay_in_their_buckets(spark, nulls, stored, name):
    op = OPERATORS[name]
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = op(stored)
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    plain = op(nulls)
    assert rows(out, plain.columns) == rows(plain, plain.columns)
    assert stored_keys(out) == KEYS
    # the left side of the outermost join runs down to the scan without an exchange
    lines = plan.splitlines()
    top = next(i for i, x in enumerate(lines) if "SortMergeJoin" in x)
    depth = lines[top].index("SortMergeJoin")
    left = []
    for x in lines[top + 1 :]:
        at = re.search(r"[A-Za-z*]", x).start()
        if at <= depth + 3 and left:
            break
        left.append(x)
    assert any("Scan" in x and "Bucketed: true" in x for x in left) and not any("Exchange" in x for x in left)


def test_a_hot_episode_lies_in_several_buckets(stored):
    parts = stored.where("domain = 'a' and file_id = 1 and episode_id = 1").select(F.spark_partition_id().alias("p"), "ep_block").distinct().collect()
    assert len({r.ep_block for r in parts}) == 8 and len({r.p for r in parts}) > 1


def test_keys_that_look_alike_stay_apart(spark):
    d = spark.createDataFrame([("a", "b:c"), ("a:1", "c"), (None, "-"), ("-", None), ("", None), (None, "")], "x string, y string")
    assert d.select(episode_key(["x", "y"]).alias("k")).distinct().count() == 6


def same_as_named(spark, df, op, key, name):
    """``op`` over null keys equals ``op`` over the same rows with a name for null."""
    named = op(df.fillna(name, [key]))
    got = op(df).fillna(name, [key])
    cols = named.columns
    assert rows(got, cols) == rows(named, cols) and got.count() > 0


@pytest.mark.parametrize("op", [
    lambda d: E.episode_index(d).select("domain", "file_id", "episode_id", "length"),
    lambda d: E.chunk_overlap(d, 3, 1, KEYS),
    lambda d: E.keep_ranges(d, d.select("episode_id", F.lit(1).alias("start"), F.lit(4).alias("end")).distinct()),
    lambda d: A.interp_linear(d, 1.5, ["x"], KEYS),
    lambda d: A.interp_floor(d, 1.5, ["x"], ["a"], KEYS),
    lambda d: A.attach_camera(d, d.select(*KEYS, "frame_idx", "ts", F.col("x").alias("c")), 1.0, ["c"], KEYS),
    lambda d: E.every_kth(d, ratios=d.select("episode_id").distinct().withColumn("ratio", F.lit(0.5)), idx="frame_idx", key="episode_id"),
    lambda d: FR.pop_episode(d)[0],
])
def test_operators_keep_null_episodes(spark, nulls, op):
    same_as_named(spark, nulls, op, "episode_id", -1)


def test_statistics_of_a_null_domain(spark):
    d = spark.createDataFrame([(k, [float(i), float(i * m)]) for k, m in (("a", 1), (None, 3)) for i in range(20)], "domain string, v array<double>")
    for mode in ("all", "joint", "none"):
        s = N.norm_fit_scoped(d, "v", mode, "zscore", 2)
        assert {r.scope for r in s.collect()} <= {"shared", "domain"}
        got = N.norm_apply(d, "v", s, "zscore", 2).fillna("z", ["domain"])
        want = N.norm_apply(d.fillna("z", ["domain"]), "v", N.norm_fit_scoped(d.fillna("z", ["domain"]), "v", mode, "zscore", 2), "zscore", 2)
        assert rows(got, ["domain", "v"]) == rows(want, ["domain", "v"])


def test_thresholds_of_a_null_stream(spark):
    rng = np.random.default_rng(1)
    vals = [(s, float(v)) for s in ("a", None, "one", "flat") for v in (rng.choice([0.0, 0.5, 1.0, 2.0, 7.0], 300) * rng.random(300)).round(2)]
    vals = [(s, 3.0 if s == "flat" else v) for s, v in vals if s != "one"] + [("one", 4.0), ("dead", 0.0), ("dead", float("nan"))]
    d = spark.createDataFrame(vals, "stream string, score double")
    got = {r.stream: r for r in S.contact_thresholds(d).collect()}
    assert set(got) == {"a", None, "one", "flat", "dead"} and got["dead"].status == "no_positive_scores"
    for s in ("a", None, "one", "flat"):
        x = np.array([v for k, v in vals if k == s and v > 0])
        noise = x[x <= np.median(x)]
        mad = np.median(np.abs(noise - np.median(noise)))
        thr = np.median(noise) + 3 * 1.4826 * mad
        r = got[s]
        assert (r.status, r.noise_pool_count) == ("ok", len(noise))
        assert np.allclose([r.score_median, r.noise_median, r.noise_mad, r.threshold], [np.median(x), np.median(noise), mad, thr], atol=1e-12)
        assert r.exceed_count == (x > r.threshold).sum()


@pytest.mark.parametrize("seed", range(4))
def test_ranks_and_deviations_from_one_histogram(spark, seed):
    rng = np.random.default_rng(seed)
    vals = [(k, float(v)) for k, n in (("a", 700), ("b", 1), ("c", 2), (None, 60)) for v in np.abs(rng.choice([rng.normal(0, 3, n), rng.integers(1, 4, n)])) + 1e-3]
    d = spark.createDataFrame(vals, "k string, v double").withColumn("bin", Q.log_bin(F.col("v"), 4))
    h = Q.value_bins(d, ["k"], "v", "bin")
    n = d.groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    ranks = n.select("k", F.lit(0).cast("long").alias("first"), F.floor((F.col("n") - 1) / 3).alias("third"), (F.col("n") - 1).alias("last"))
    got = {r.k: r for r in Q.values_at(d, h, ["k"], "v", "bin", ranks, ["first", "third", "last"]).collect()}
    for k in ("a", "b", "c", None):
        x = np.sort([v for s, v in vals if s == k])
        t = x[(len(x) - 1) // 3]
        assert (got[k].first, got[k].third, got[k].last) == (x[0], t, x[-1]) and got[k].upto_third == (x <= t).sum()
    for q in (0.0, 0.5, 0.9):
        pool = h.join(n.withColumnRenamed("k", "k2"), F.col("k").eqNullSafe(F.col("k2"))).drop("k2").withColumn("centre", F.lit(1.7)).withColumn("top", F.lit(1e9))
        dev = {r.k: r.dev for r in Q.deviations_at(d, pool, ["k"], "v", "bin", q).collect()}
        for k in ("a", "b", "c", None):
            x = np.abs(np.array([v for s, v in vals if s == k]) - 1.7)
            assert dev[k] == pytest.approx(np.quantile(x, q), abs=1e-12)
