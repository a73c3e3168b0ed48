"""Blocked windows against brute force; one group holds more than a third of the rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from episodica.plans import quantiles as Q
from episodica.plans.ordered import draw_first, explode_range, halo, hash_block, hash_hex, number_rows, prefix
from episodica.plans.ranges import range_join
from episodica.plans.small import keep, lookup
from episodica.sources.frames import index_frames


@pytest.fixture(scope="module")
def pdf():
    rng = np.random.default_rng(0)
    rows = []
    for key, n in (("hot", 500), ("a", 7), ("b", 1), ("c", 60)):
        for i in range(n):
            rows.append((key, i, float(rng.normal()), None if rng.random() < 0.6 else int(rng.integers(100))))
    d = pd.DataFrame(rows, columns=["key", "i", "x", "y"])
    d["y"] = d["y"].astype("Int64")
    return d


@pytest.fixture(scope="module")
def sdf(spark, pdf):
    rows = [(r.key, int(r.i), float(r.x), None if r.y is pd.NA else int(r.y)) for r in pdf.itertuples()]
    return spark.createDataFrame(rows, "key string, i long, x double, y long")


def test_prefix_matches_pandas(sdf, pdf):
    d = prefix(sdf, ["key"], "i", {"mx": ("max", F.col("x")), "sm": ("sum", F.col("x")), "ls": ("last", F.col("y"))}, rows=16)
    got = d.toPandas().sort_values(["key", "i"]).reset_index(drop=True)
    want = pdf.sort_values(["key", "i"]).reset_index(drop=True)
    g = want.groupby("key")
    assert np.allclose(got["mx"], g["x"].cummax())
    assert np.allclose(got["sm"], g["x"].cumsum())
    assert got["ls"].fillna(-1).astype(int).tolist() == g["y"].ffill().fillna(-1).astype(int).tolist()


def test_prefix_before_and_reverse(sdf, pdf):
    d = prefix(sdf, ["key"], "i", {"mn": ("min", F.col("x"))}, current=False, rows=16)
    got = d.toPandas().sort_values(["key", "i"])["mn"].to_numpy()
    want = pdf.sort_values(["key", "i"]).groupby("key")["x"].transform(lambda s: s.cummin().shift()).to_numpy()
    assert np.allclose(got, want, equal_nan=True)
    d = prefix(sdf, ["key"], "i", {"nx": ("last", F.col("y"))}, reverse=True, rows=16)
    got = d.toPandas().sort_values(["key", "i"])["nx"].fillna(-1).astype(int).tolist()
    assert got == pdf.sort_values(["key", "i"]).groupby("key")["y"].bfill().fillna(-1).astype(int).tolist()


@pytest.mark.parametrize("rows", [3, 16, 1000])
def test_halo_lag_lead(sdf, pdf, rows):
    d, w, home = halo(sdf, ["key"], "i", before=5, after=4, rows=rows)
    d = d.select("key", "i", "__blk", F.lag("x", 5).over(w).alias("a"), F.lead("x", 4).over(w).alias("b")).where(home)
    got = d.toPandas().sort_values(["key", "i"])
    g = pdf.sort_values(["key", "i"]).groupby("key")["x"]
    assert len(got) == len(pdf)
    assert np.allclose(got["a"], g.shift(5), equal_nan=True)
    assert np.allclose(got["b"], g.shift(-4), equal_nan=True)


def test_index_frames_hot_equals_plain(sdf):
    plain = index_frames(sdf, ["key"], ["x"], F.floor(F.col("x") * 4)).select("key", "i", "frame_idx")
    hot = index_frames(sdf, ["key"], ["x"], F.floor(F.col("x") * 4), hot_rows=100).select("key", "i", "frame_idx")
    assert plain.exceptAll(hot).count() == 0 and hot.count() == sdf.count()


def test_hash_order_numbering(sdf):
    h = sdf.withColumn("h", hash_hex(1, F.col("key"), F.col("i")))
    d = number_rows(h, [], ["h"], hash_block(F.col("h")), "rn", "n").orderBy("rn").collect()
    assert [r.rn for r in d] == list(range(568)) and all(a.h < b.h for a, b in zip(d, d[1:])) and d[0].n == 568


def test_explode_range_chunks(spark):
    d = spark.createDataFrame([(0, 10), (5, 4), (-3, 3)], "lo long, hi long")
    got = sorted(r.v for r in explode_range(d, F.col("lo"), F.col("hi"), "v", chunk=4).collect())
    assert got == sorted([*range(0, 11), *range(-3, 4)])


def test_range_join_semi_no_duplicates(spark):
    p = spark.range(100).select(F.lit("k").alias("key"), F.col("id").alias("p"))
    r = spark.createDataFrame([("k", 3, 20), ("k", 10, 15), ("k", 90, 90), ("x", 0, 99)], "key string, lo long, hi long")
    got = sorted(x.p for x in range_join(p, r, ["key"], "p", "lo", "hi", 4, "left_semi").collect())
    assert got == list(range(3, 20))


@pytest.mark.parametrize("refine", [10, 10**9])
def test_exact_quantiles(spark, monkeypatch, refine):
    monkeypatch.setattr(Q, "REFINE_ROWS", refine)
    rng = np.random.default_rng(1)
    data = {"hot": np.concatenate([rng.normal(size=400), np.zeros(50), np.full(30, 2.5)]), "neg": -rng.random(33) * 1e-6, "one": np.array([7.0]),
            "ties": np.repeat([1.0, 1.0 + 1e-12, 3.0], 5)}
    d = spark.createDataFrame([(k, float(v)) for k, a in data.items() for v in a], "key string, v double")
    qs = {"a": 0.01, "b": 0.5, "c": 0.99, "d": 0.0, "e": 1.0, "f": 0.37}
    for r in Q.exact_quantiles(d, ["key"], "v", qs).collect():
        want = np.quantile(data[r.key], list(qs.values()))
        assert np.allclose([r[n] for n in qs], want, rtol=1e-12, atol=1e-15), r.key


def test_lookup_falls_back_to_a_written_table(spark):
    small = lookup(spark.range(10), 20)
    big = lookup(spark.range(30), 20)
    assert small.count() == 10 and big.count() == 30
    assert "broadcast" in small._jdf.queryExecution().analyzed().toString().lower()
    assert "broadcast" not in big._jdf.queryExecution().analyzed().toString().lower()
    assert keep(spark.range(3)).count() == 3


@pytest.mark.parametrize("hot", [0, 100, 10**9])
def test_null_keys_and_null_blocks_are_numbered(spark, hot):
    rows = [(None if i % 3 else "k", None if i % 10 == 0 else i, i) for i in range(300)]
    d = spark.createDataFrame(rows, "key string, t long, id long")
    got = {r.id: r.frame_idx for r in index_frames(d, ["key"], ["t", "id"], F.floor(F.col("t") / 20), hot_rows=hot).collect()}
    want = {}
    for key in ("k", None):
        order = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
        want.update({r[2]: n for n, r in enumerate(order)})
    assert got == want


def test_prefix_keeps_null_keys(spark):
    d = spark.createDataFrame([(None, i, float(i % 7)) for i in range(100)], "key string, i long, x double")
    got = [r.m for r in prefix(d, ["key"], "i", {"m": ("max", F.col("x"))}, rows=8).orderBy("i").collect()]
    assert got == list(np.maximum.accumulate([float(i % 7) for i in range(100)]))


@pytest.mark.parametrize("refine", [0, 10**9])
def test_quantiles_pass_over_what_is_not_finite(spark, monkeypatch, refine):
    monkeypatch.setattr(Q, "REFINE_ROWS", refine)
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    wild = [float("inf"), float("-inf"), float("nan"), None]
    d = spark.createDataFrame([(None, float(v)) for v in x] + [(None, w) for w in wild] + [("w", w) for w in wild], "key string, x double")
    got = Q.exact_quantiles(d, ["key"], "x", {"a": 0.01, "b": 0.5}).collect()
    assert len(got) == 1 and got[0].key is None
    assert np.allclose([got[0].a, got[0].b], np.quantile(x, [0.01, 0.5]))


@pytest.mark.parametrize("k", [0, 1, 7, 60, 500, 10_000])
def test_draws_equal_a_full_sort(spark, k):
    rows = [(None if i % 4 == 0 else "hot" if i % 4 < 3 else "c", i) for i in range(900)]
    d = spark.createDataFrame(rows, "key string, i long").withColumn("h", hash_hex(3, F.col("i")))
    got = {(r.key, r.i) for r in draw_first(d, ["key"], "h", lambda n: F.lit(k)).where("is_first").collect()}
    want = set()
    for key in ("hot", "c", None):
        want |= {(key, r.i) for r in sorted((r for r in d.collect() if r.key == key), key=lambda r: r.h)[:k]}
    assert got == want
