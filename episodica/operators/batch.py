"""Batch assignment: domain-pure batches, rank shards, collation, shuffling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from episodica.plans.ordered import hash_block, hash_hex, number_rows


def domain_batches(
    samples: DataFrame, key: str, batch_size: int, world: int = 1, seed: int = 0, epoch: int = 0
) -> DataFrame:
    """Assign every sample to a batch of its own domain.

    Adds ``batch_in_domain``, ``slot``, ``batch_no`` (hash order over all
    batches) and ``rank = batch_no % world``.  The last batch of a domain is
    filled by cycling its own rows, so every batch has ``batch_size`` rows.
    """
    b = batch_size
    d = samples.withColumn("__h", hash_hex(seed, epoch, F.col("domain"), F.col(key)))
    d = number_rows(d, ["domain"], ["__h"], hash_block(F.col("__h")), "__rn", "__n").drop("__h")
    d = d.withColumn("batch_in_domain", F.floor(F.col("__rn") / b))
    rest = F.col("__n") % b
    slot = F.col("__rn") % b
    in_tail = F.col("__rn") >= F.col("__n") - rest
    # a tail row at slot p repeats at p + r, p + 2r, ... below the batch size
    fill = F.when(in_tail & (rest > 0), F.sequence(slot, F.lit(b - 1).cast("bigint"), F.greatest(rest, F.lit(1)))) \
        .otherwise(F.array(slot))
    # one row per batch: its first sample
    plan = d.where(F.col("__rn") % b == 0).select("domain", "batch_in_domain")
    d = d.withColumn("slot", F.explode(fill)).drop("__rn")
    plan = plan.withColumn("__h", hash_hex(seed, epoch, "batch", F.col("domain"), F.col("batch_in_domain")))
    plan = number_rows(plan, [], ["__h"], hash_block(F.col("__h")), "batch_no").drop("__h")
    d = d.join(plan, ["domain", "batch_in_domain"]).drop("__n")
    return d.withColumn("rank", F.pmod(F.col("batch_no"), F.lit(world)))


def batch_count(samples: DataFrame, batch_size: int) -> DataFrame:
    """Batches per domain: the ceiling per domain, not of the total."""
    return samples.groupBy("domain").agg(F.ceil(F.count(F.lit(1)) / batch_size).alias("n_batches"))


def rank_shards(samples: DataFrame, key: str, world: int, batch_size: int, seed: int = 0) -> DataFrame:
    """Plain sharding without domains: equal share per rank, incomplete batches dropped."""
    d = samples.withColumn("__h", hash_hex(seed, F.col(key)))
    d = number_rows(d, [], ["__h"], hash_block(F.col("__h")), "__rn", "__n").drop("__h")
    per_rank = F.floor(F.col("__n") / (world * batch_size)) * batch_size
    d = d.withColumn("rank", F.pmod(F.col("__rn"), F.lit(world))).withColumn("__i", F.floor(F.col("__rn") / world))
    d = d.where(F.col("__i") < per_rank)
    return d.withColumn("batch_no", F.floor(F.col("__i") / batch_size)).withColumn(
        "slot", F.col("__i") % batch_size).drop("__i", "__rn", "__n")


def collate(batched: DataFrame, cols: Sequence[str], maps: Sequence[str] = (), by: str = "batch_no") -> DataFrame:
    """One row per batch with an array per column, ordered by slot.

    Map columns become maps of arrays over the union of their keys; a key a
    sample lacks is NULL there.  A batch has a fixed size, so lists are bounded.
    """
    # maps have no order, their entries do
    rows = F.array_sort(F.collect_list(F.struct("slot", *cols, *[F.map_entries(m).alias(m) for m in maps])))
    d = batched.groupBy(by).agg(rows.alias("__r"))
    return d.select(by, *[F.col("__r")[c].alias(c) for c in cols], *[_collated_map(m).alias(m) for m in maps])


def _collated_map(m: str) -> Column:
    per_row = F.transform(F.col("__r")[m], lambda e: F.map_from_entries(e))
    keys = F.array_sort(F.array_distinct(F.flatten(F.transform(per_row, lambda r: F.map_keys(r)))))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.transform(per_row, lambda r: F.try_element_at(r, k))))


def shuffle_samples(samples: DataFrame, key: str, seed: int = 0, out: str = "order_no") -> DataFrame:
    """Number samples in a reproducible random order (sort by ``out`` to read them so)."""
    d = samples.withColumn("__h", hash_hex(seed, F.col(key)))
    return number_rows(d, [], ["__h"], hash_block(F.col("__h")), out).drop("__h")


def pick_one(cols: Sequence[Column], seed: int, *key: Column) -> Column:
    """One of several alternative columns per row, by hash; NULL alternatives are skipped."""
    arr = F.array_compact(F.array(*cols))
    h = F.conv(F.substring(hash_hex(seed, *key), 1, 8), 16, 10).cast("bigint")
    return F.get(arr, F.pmod(h, F.greatest(F.size(arr), F.lit(1))).cast("int"))


