"""Draws of the first rows of a group."""

import hashlib

from pyspark.sql import functions as F

from episodica.plans.ordered import draw_first, hash_hex


def test_a_draw_does_not_deal_its_rows_by_group(spark):
    d = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, F.col("id") % 3).alias("g")).withColumn("h", hash_hex(7, F.col("id")))
    got = draw_first(d, ["g"], "h", lambda n: F.floor(n * 0.1))
    # a few groups hold all rows: dealt by group they would lie in as few tasks
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning" not in plan and "SortMergeJoin" not in plan
    for g in (None, 1, 2):
        ids = sorted((i for i in range(3000) if (i % 3 or None) == g), key=lambda i: hashlib.md5(f"7|{i}".encode()).hexdigest())
        assert {r.id for r in got.where(F.col("g").eqNullSafe(F.lit(g))).where("is_first").collect()} == set(ids[:100])
