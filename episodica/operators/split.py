"""Leak-free train / validation splits.

Random draws are a hash order: md5 over seed and identity.  The counts and
guarantees of a random sample hold, and any engine reproduces the choice.
Drawing the k first of a pool counts hash blocks and orders only the block in which
the draw ends, so a norm domain that holds most episodes is never sorted.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from episodica.plans.ordered import draw_first, explode_range, hash_hex

SPLIT_VERSION = 4


def val_count(total: Column, val_ratio: float) -> Column:
    """ratio < 1: floor(total * ratio); otherwise a fixed count; within [0, total]."""
    k = F.lit(int(val_ratio)) if val_ratio >= 1 else F.floor(total * F.lit(float(val_ratio)))
    return F.greatest(F.lit(0), F.least(k, total))


def _draw(pool: DataFrame, identity: Sequence[str], val_ratio: float, seed: int) -> DataFrame:
    """Pool with ``is_val``: the k hash-first identities of each norm domain."""
    h = pool.withColumn("__h", hash_hex(seed, F.col("norm_domain"), *[F.col(c) for c in identity]))
    return draw_first(h, ["norm_domain"], "__h", lambda n: val_count(n, val_ratio), "is_val").drop("__h")


def _label(is_val: Column) -> Column:
    return F.when(is_val, F.lit("val")).otherwise(F.lit("train"))


def split_pooled(entry_episodes: DataFrame, val_ratio: float, seed: int = 0) -> DataFrame:
    """Pool (entry, position) rows of a norm domain and draw k for validation."""
    d = _draw(entry_episodes, ["entry", "position"], val_ratio, seed)
    return d.withColumn("split", _label(F.col("is_val"))).drop("is_val")


def entry_prefixes(entries: DataFrame, pools: DataFrame) -> DataFrame:
    """Expand entries (norm_domain, entry, source_id, n_selected) to source positions.

    An entry that selects more episodes than its source pool has is an error.
    """
    d = entries.join(pools.select("source_id", "n_pool"), "source_id")
    n = F.when(F.col("n_selected") <= F.col("n_pool"), F.col("n_selected")).otherwise(
        F.raise_error(F.lit("an entry selects more episodes than its source pool holds")).cast("bigint")
    )
    return explode_range(d, F.lit(0), n - 1, "position", spread=True).drop("n_pool", "n_selected")


def split_by_source(entries: DataFrame, pools: DataFrame, val_ratio: float, seed: int = 0) -> DataFrame:
    """Split over unique (source, episode) identities and project to every entry.

    The pool is each source's whole episode list, so an identity is on the same
    side in every entry that holds it.
    """
    src = entries.select("norm_domain", "source_id").distinct().join(pools, "source_id")
    pool = explode_range(src, F.lit(0), F.col("n_pool") - 1, "position", spread=True)
    drawn = _draw(pool.drop("n_pool"), ["source_id", "position"], val_ratio, seed)
    d = entry_prefixes(entries, pools).join(drawn, ["norm_domain", "source_id", "position"])
    return d.withColumn("split", _label(F.col("is_val"))).drop("is_val")


def split_by_positions(entry_positions: DataFrame, val_ratio: float, seed: int = 0) -> DataFrame:
    """Split on explicit positions (norm_domain, entry, source_id, position, ratio, config_index).

    With a fixed count (``val_ratio >= 1``) one owner entry validates an
    identity: highest ratio, then config order.  Other copies drop the row.
    """
    ident = ["norm_domain", "source_id", "position"]
    owner_rank = F.struct(F.col("ratio"), -F.col("config_index"))
    pool = entry_positions.groupBy(*ident).agg(F.max_by("entry", owner_rank).alias("__owner"))
    drawn = _draw(pool, ["source_id", "position"], val_ratio, seed)
    d = entry_positions.join(drawn, ident)
    if val_ratio >= 1:
        d = d.where(~F.col("is_val") | (F.col("entry") == F.col("__owner")))
    return d.withColumn("split", _label(F.col("is_val"))).drop("is_val", "__owner")


def split_leaks(split: DataFrame) -> DataFrame:
    """Identities found on both sides (empty for a sound split)."""
    g = split.groupBy("norm_domain", "source_id", "position").agg(
        F.max((F.col("split") == "val").cast("int")).alias("v"), F.max((F.col("split") == "train").cast("int")).alias("t")
    )
    return g.where("v = 1 AND t = 1").drop("v", "t")


def legacy_keys(ratio: Column) -> tuple[Column, Column]:
    tag = F.when(ratio >= 1, F.lit("")).otherwise(F.format_string("_r%.4f", ratio))
    return F.concat(F.lit("train_episode_idx"), tag), F.concat(F.lit("val_episode_idx"), tag)


def json_string(text: Column) -> Column:
    """A JSON string in ASCII: quotes, backslashes, controls and all other characters escaped."""
    short = {8: "\\b", 9: "\\t", 10: "\\n", 12: "\\f", 13: "\\r", 34: '\\"', 92: "\\\\"}

    def unit(code: Column) -> Column:
        return F.concat(F.lit("\\u"), F.lpad(F.lower(F.hex(code)), 4, "0"))

    def escaped(c: Column) -> Column:
        code = F.ascii(c)
        out = F.when(code > 0xFFFF, F.concat(unit(F.floor((code - 0x10000) / 1024) + 0xD800), unit((code - 0x10000) % 1024 + 0xDC00)))
        for k, v in short.items():
            out = out.when(code == k, F.lit(v))
        return out.when((code < 32) | (code > 126), unit(code)).otherwise(c)

    return F.concat(F.lit('"'), F.array_join(F.transform(F.filter(F.split(text, ""), lambda c: c != ""), escaped), ""), F.lit('"'))


def split_manifest(catalog: DataFrame, config_path: str, config_sha1: str, val_ratio: float, seed: int) -> DataFrame:
    """Stable key names per catalog entry and the id of the bound split file.

    A norm domain with one entry uses the legacy key names; copies get
    ``<name>_<first ten hex digits of sha1(path|ratio)>``.
    """
    n = catalog.groupBy("norm_domain").agg(F.count(F.lit(1)).alias("__n"))
    ratio = F.col("use_trajectory_ratio")
    safe = F.regexp_replace(F.regexp_replace("name", "[^A-Za-z0-9_]+", "_"), "^_+|_+$", "")
    safe = F.when(safe == "", "dataset").otherwise(safe)
    digest = F.substring(F.sha1(F.concat(F.col("path"), F.lit("|"), F.format_string("%.8f", ratio))), 1, 10)
    copy_id = F.concat(safe, F.lit("_"), digest)
    lt, lv = legacy_keys(ratio)
    binding = F.concat(
        F.lit(f'{{"dataset_config_path": {json.dumps(config_path)}, "dataset_config_sha1": {json.dumps(config_sha1)}, "norm_stats_domain_name": '),
        json_string(F.col("norm_domain")),
        F.lit(f', "seed": {int(seed)}, "val_ratio": {float(val_ratio)}}}'),
    )
    return catalog.join(n, "norm_domain").select(
        "config_index", "norm_domain",
        F.when(F.col("__n") <= 1, lt).otherwise(F.concat(F.lit("train_episode_idx_"), copy_id)).alias("train_key"),
        F.when(F.col("__n") <= 1, lv).otherwise(F.concat(F.lit("val_episode_idx_"), copy_id)).alias("val_key"),
        lt.alias("legacy_train_key"), lv.alias("legacy_val_key"),
        F.concat(F.lit("train_val_split_"), F.substring(F.sha1(binding), 1, 12)).alias("split_file"),
    )


def manifest_reuse(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """Per norm domain: may the stored split be reused?

    ``stored(norm_domain, key, version)`` must hold every key of the manifest at
    the current version.
    """
    need = manifest.select("norm_domain", F.explode(F.array("train_key", "val_key")).alias("key")).distinct()
    have = stored.where(F.col("version") == SPLIT_VERSION).select("norm_domain", "key").distinct()
    miss = need.join(have, ["norm_domain", "key"], "left_anti").groupBy("norm_domain").agg(F.count(F.lit(1)).alias("n_missing"))
    doms = need.select("norm_domain").distinct().join(miss, "norm_domain", "left")
    return doms.select("norm_domain", F.coalesce("n_missing", F.lit(0)).alias("n_missing"),
                       F.col("n_missing").isNull().alias("reusable"))


def resolve_split_key(manifest: DataFrame, stored: DataFrame, split: str) -> DataFrame:
    """Key under which an entry's episodes are stored: own, legacy by ratio, then plain."""
    plain = F.lit(f"{split}_episode_idx")
    cand = manifest.select(
        "config_index", "norm_domain",
        F.posexplode(F.array(F.col(f"{split}_key"), F.col(f"legacy_{split}_key"), plain)).alias("__p", "key"),
    )
    have = stored.select("norm_domain", "key").distinct()
    found = cand.join(have, ["norm_domain", "key"]).groupBy("config_index").agg(F.min_by("key", "__p").alias("key"))
    return manifest.select("config_index", "norm_domain").join(found, "config_index", "left")
