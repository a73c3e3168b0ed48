"""Operators over stored frame tables: the same results, frames left in their buckets."""

import uuid

from pyspark.sql import functions as F

from episodica.operators import episodes as E
from episodica.queries.common import bigint, frames, samples
from episodica.registry import ORACLES, query, rnd
from episodica.session import scratch_path
from episodica.sources.frames import EPISODE
from episodica.sources.store import store_frames


def stored(spark, df, keys=EPISODE, block_rows=262_144):
    name = f"episodica_frames_{uuid.uuid4().hex}"
    return store_frames(df, name, scratch_path(spark, "store"), keys, buckets=16, block_rows=block_rows)


@query("b4_slice_episodes_stored", ORACLES["b4_slice_episodes"])
def b4_stored(spark, sf):
    d = E.slice_episodes(stored(spark, frames(spark, sf)), stride=2, start_episode=1, max_episodes=8, max_steps=3, downsample=2, reserve_last=True)
    return d.select("episode_id", "file_id", "ts", *bigint("frame_idx"), rnd(F.col("q1")).alias("q1"))


@query("b5_trim_idle_stored", ORACLES["b5_trim_idle"])
def b5_stored(spark, sf):
    """Blocks of 16 frames, so every episode lies in several buckets."""
    d = stored(spark, samples(spark, sf), ["episode_id"], 16)
    d = d.withColumn("act", F.when(F.col("k") >= 50, F.col("k")).otherwise(0)).withColumn("cut", F.lit(40))
    d = E.trim_idle(d, ["value"], ["act"], eps=4.0, frame_cut="cut")
    return d.select("episode_id", "event_id", *bigint("frame_idx"))


@query("b6_chunk_overlap_stored", ORACLES["b6_chunk_overlap"])
def b6_stored(spark, sf):
    d = stored(spark, samples(spark, sf), ["episode_id"], 16)
    return E.chunk_overlap(d, 8, 5).select("episode_id", *bigint("chunk_no", "chunk_idx"), "event_id")


@query("b8_global_index_stored", ORACLES["b8_global_index"])
def b8_stored(spark, sf):
    d = E.global_index(stored(spark, frames(spark, sf)))
    return d.select(*bigint("sample_no", "episode_id", "frame_idx"), rnd(F.col("q1")).alias("q1"))
