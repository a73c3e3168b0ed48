"""Ranges in aligned pieces, appends that can be repeated, catalogs in parts."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators import episodes as E
from episodica.plans.ranges import merged, pieces, range_join
from episodica.sources import catalog as C, frames as FR
from episodica.sources.append import BatchLog, append_batch, read_batches


@pytest.mark.parametrize("width", [1, 4, 1024])
def test_pieces_tile_the_range(spark, width):
    rng = np.random.default_rng(width)
    cases = [(0, 1), (0, 4), (3, 5), (5, 5 + width), (1, 10**9 + 7), (0, 2**40), (width, 2 * width)] + [tuple(sorted(map(int, rng.integers(0, 5000, 2)))) for _ in range(60)]
    cases = [(a, b) for a, b in cases if a < b]
    rows = spark.createDataFrame(cases, "lo long, hi long").select("lo", "hi", pieces(F.col("lo"), F.col("hi"), width).alias("p")).collect()
    for r in rows:
        at = r.lo
        for p in sorted(r.p, key=lambda p: p.lo):
            assert p.lo == at < p.hi
            at = p.hi
            size = width if p.level < 0 else width << p.level
            assert p.lo // size == (p.hi - 1) // size == p.at
            assert p.level < 0 or p.hi - p.lo == size
        assert at == r.hi and len(r.p) <= 2 + 2 * np.log2(max(2, (r.hi - r.lo) / width))
        if r.hi == 10**9 + 7 and width == 1024:
            assert len(r.p) < 70


def test_joins_equal_a_plain_loop(spark):
    rng = np.random.default_rng(2)
    pts = [(k, i) for k in ("a", None, "b") for i in range(0, 400, 3)]
    rgs = [(k, int(a), int(a + n), j) for j, (k, a, n) in enumerate(zip(rng.choice(np.array(["a", "b", None], dtype=object), 40), rng.integers(0, 400, 40), rng.choice([0, 1, 7, 60, 300], 40)))]
    p = spark.createDataFrame(pts, "k string, x long")
    r = spark.createDataFrame(rgs, "k string, lo long, hi long, j int")
    want = sorted((str(k), x, j) for k, x in pts for q, a, b, j in rgs if q == k and a <= x < b)
    for width in (1, 8, 4096):
        got = range_join(p, r, ["k"], "x", "lo", "hi", width).select("k", "x", "j").collect()
        assert sorted((str(g.k), g.x, g.j) for g in got) == want
        semi = range_join(p, r, ["k"], "x", "lo", "hi", width, "left_semi")
        assert semi.columns == ["k", "x"] and sorted((str(g.k), g.x) for g in semi.collect()) == sorted({w[:2] for w in want})
    assert range_join(p, r.where("false"), ["k"], "x", "lo", "hi").count() == 0


def test_merged_ranges_are_disjoint(spark):
    r = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 10), (1, 2, 3), (None, 0, 10**9), (None, 10**8, 10**9 + 1), (2, 4, 4)], "k long, a long, b long")
    assert sorted(map(str, map(tuple, merged(r, ["k"], "a", "b").collect()))) == sorted(map(str, [(1, 0, 7), (1, 9, 10), (None, 0, 10**9 + 1)]))


def test_a_very_wide_range_costs_few_rows(spark):
    f = spark.createDataFrame([(e, i) for e in (1, None) for i in (0, 17, 10**8, 10**9 - 1, 10**9)], "episode_id long, frame_idx long")
    r = spark.createDataFrame([(1, 1, 10**9), (None, 0, 18)], "episode_id long, start long, end long")
    got = E.keep_ranges(f, r).collect()
    assert sorted((x.episode_id or 0, x.frame_idx) for x in got) == [(0, 0), (0, 17), (1, 17), (1, 10**8), (1, 10**9 - 1)]


# ---------------------------------------------------------------- appends
def eps(spark, ids, dom="a"):
    rows = [(dom, 1, e, i, [1.0, 2.0]) for e in ids for i in range(2)]
    return spark.createDataFrame(rows, "domain string, file_id long, episode_id long, frame_idx long, v array<double>")


def numbers(spark, path):
    d = read_batches(spark, path).select("batch", "domain", "episode_id", "episode_seq").distinct().collect()
    return sorted((str(r.domain), r.episode_seq, str(r.episode_id), r.batch) for r in d)


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    append_batch(eps(spark, [1, 2, None]), path, "one")
    append_batch(eps(spark, [7]).unionByName(eps(spark, [8], None)), path, "two")
    before = numbers(spark, path)
    assert [(d, s) for d, s, _, _ in before] == [("None", 0), ("a", 0), ("a", 1), ("a", 2), ("a", 3)]
    append_batch(eps(spark, [1, 2, None]), path, "one")
    assert numbers(spark, path) == before and read_batches(spark, path).count() == 10
    with pytest.raises(ValueError, match="other episodes"):
        append_batch(eps(spark, [1]), path, "one")
    append_batch(eps(spark, [9]), path, "three")
    assert ("a", 4, "9", "three") in numbers(spark, path)


def test_a_batch_that_failed_keeps_its_numbers(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    log = BatchLog(spark, path)
    # the writer of "one" died between its claim and its frames, another one between the file and its text
    assert log.claim("one", {"a": 3}) == {"a": 0}
    open(f"{tmp_path}/t-log/000000000001", "w").close()
    import episodica.sources.append as mod

    mod.PATIENCE, held = 0.3, mod.PATIENCE
    try:
        append_batch(eps(spark, [5]), path, "two")
        append_batch(eps(spark, [1, 2, 3]), path, "one")
    finally:
        mod.PATIENCE = held
    assert [s for _, s, _, _ in numbers(spark, path)] == [0, 1, 2, 3]
    assert json.loads(open(f"{tmp_path}/t-log/000000000002").read())["batch"] == "two"


def test_observed_checks_equal_validation(spark, tmp_path):
    good = eps(spark, [1, 2])
    assert append_batch(good, f"file://{tmp_path}/a", "x", arrays=["v"]).count() == 0
    bad = good.withColumn("v", F.when((F.col("episode_id") == 2) & (F.col("frame_idx") == 1), F.array(F.lit(1.0))).otherwise(F.col("v")))
    got = append_batch(bad, f"file://{tmp_path}/b", "x", arrays=["v"]).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, FR.validate_frames(bad, ["v"]).collect())) == [("a", 1, "v", "shape")]


# ---------------------------------------------------------------- catalogs
def test_catalog_in_parts_and_none(spark, tmp_path):
    rows = [(i, f"n{i}", f"/p/{i}", 0.25 * (i % 4 + 1), "d") for i in range(23)]
    cat = spark.createDataFrame(rows, "config_index long, name string, path string, use_trajectory_ratio double, norm_domain string")
    C.write_catalog_parts(cat, f"file://{tmp_path}/c", per_document=5)
    back = C.read_catalog(spark, f"file://{tmp_path}/c")
    assert sorted(map(tuple, back.select(*cat.columns).collect())) == rows
    none = FR.scan_frames(spark, cat.where("false"), "x double")
    assert none.count() == 0 and none.columns == ["x", "source_file", "domain"]
    assert FR.scan_frames(spark, cat.where("false")).columns == ["source_file", "domain"]
