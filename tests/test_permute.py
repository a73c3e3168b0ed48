"""Keyed orders: bijections with an inverse."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from episodica.operators.permute import Permutation, epoch_order, epoch_part


@pytest.mark.parametrize("n", [1, 2, 3, 5, 16, 17, 1000, 9973])
def test_every_place_once_and_back(spark, n):
    p = Permutation(n, 3, 1)
    d = spark.range(n).select("id", p.place(F.col("id")).alias("p")).withColumn("b", p.number(F.col("p")))
    rows = d.collect()
    assert sorted(r.p for r in rows) == list(range(n)) and all(r.b == r.id for r in rows)


def test_restart_anywhere(spark):
    n = 5000
    whole = {r.place: r.id for r in epoch_order(spark.range(n), "id", n, 9, 4).collect()}
    for start, stop in ((0, 10), (1234, 1300), (4990, 9999), (5000, 5001)):
        part = epoch_part(spark, n, start, stop, 9, 4).collect()
        assert [r.place for r in part] == list(range(start, min(stop, n))) and all(whole[r.place] == r.sample_no for r in part)
    plan = epoch_order(spark.range(n), "id", n)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Sort" not in plan


def test_orders_differ_and_look_random(spark):
    n = 20_000
    a, b = (np.array([r[0] for r in spark.range(n).select(Permutation(n, 1, e).place(F.col("id"))).collect()]) for e in (0, 1))
    assert (a == b).mean() < 0.01
    assert abs(np.corrcoef(a, np.arange(n))[0, 1]) < 0.03 and abs(np.corrcoef(a, b)[0, 1]) < 0.03
    # neighbours are torn apart, and every eighth of the order holds an eighth of every eighth of the samples
    assert np.abs(np.diff(a)).mean() == pytest.approx(n / 3, rel=0.05)
    counts = np.histogram2d(np.arange(n), a, bins=8)[0]
    assert counts.min() > 0.8 * n / 64 and counts.max() < 1.2 * n / 64


def test_very_many_numbers_and_bounds(spark):
    for n in (10**12 + 39, 10**18):
        p = Permutation(n, 2)
        x = [0, 1, n // 2, n - 1, n, -1]
        rows = spark.createDataFrame([(i,) for i in x], "id long").select("id", p.place(F.col("id")).alias("p")).withColumn("b", p.number(F.col("p"))).collect()
        for r in rows:
            assert (r.p is None) == (not 0 <= r.id < n) and r.b == (r.id if 0 <= r.id < n else None)
    with pytest.raises(ValueError):
        Permutation(1 << 61)
