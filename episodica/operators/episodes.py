"""Episode indexing, selection and trimming.

Frame tables carry a dense 0-based ``frame_idx`` per (domain, file_id,
episode_id).  Selections are arithmetic on that index or on a small episode
table; no operator sorts the frames of a whole episode in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from episodica.plans.blocks import narrow
from episodica.plans.ordered import explode_range, halo, join_same, number_rows, prefix
from episodica.plans.ranges import range_join
from episodica.plans.small import keep
from episodica.sources.frames import EPISODE

#: episode ids per block when episodes of a file are numbered
EPISODE_BLOCK = 1_000_000


def rank_episodes(eps: DataFrame, keys: Sequence[str] = ("domain", "file_id")) -> DataFrame:
    """Add ``ep_no`` (0-based position in the file) and ``n_eps`` to an episode table."""
    return number_rows(eps, list(keys), ["episode_id"], F.floor(F.col("episode_id") / EPISODE_BLOCK), "ep_no", "n_eps")


def episode_lengths(frames: DataFrame) -> DataFrame:
    return frames.groupBy(*EPISODE).agg(F.count(F.lit(1)).alias("length"))


def episode_index(frames: DataFrame) -> DataFrame:
    """Length, global half-open frame range and position of every episode.

    Offsets are summed level by level (domains, files of a domain, episodes of
    a file), so only the table of domains is ever ordered globally.
    """
    # one row per episode, read four times below
    eps = keep(episode_lengths(frames), "episode-lengths")
    files = eps.groupBy("domain", "file_id").agg(F.sum("length").alias("fl"), F.count(F.lit(1)).alias("fe"))
    doms = files.groupBy("domain").agg(F.sum("fl").alias("dl"), F.sum("fe").alias("de"))
    before = (W.unboundedPreceding, -1)
    z = F.lit(0).cast("long")
    wd = W.orderBy("domain").rowsBetween(*before)
    doms = doms.select("domain", F.coalesce(F.sum("dl").over(wd), z).alias("d_off"),
                       F.coalesce(F.sum("de").over(wd), z).alias("d_eps"))
    wf = W.partitionBy("domain").orderBy("file_id").rowsBetween(*before)
    files = files.select("domain", "file_id", F.coalesce(F.sum("fl").over(wf), z).alias("f_off"),
                         F.coalesce(F.sum("fe").over(wf), z).alias("f_eps"))
    # a file may hold very many episodes: running sums go block by block
    eps = prefix(eps, ["domain", "file_id"], "episode_id",
                 {"e_off": ("sum", F.col("length")), "e_no": ("sum", F.lit(1).cast("long"))}, current=False, rows=EPISODE_BLOCK)
    eps = eps.fillna(0, ["e_off", "e_no"])
    d = join_same(join_same(eps, files, ["domain", "file_id"]), doms, ["domain"])
    start = F.col("d_off") + F.col("f_off") + F.col("e_off")
    return d.select(
        *EPISODE, "length", start.alias("start"), (start + F.col("length")).alias("end"),
        (F.col("d_eps") + F.col("f_eps") + F.col("e_no")).alias("episode_no"),
    )


def drop_unused_frames(frames: DataFrame, left: str = "lefthand_used", right: str = "righthand_used") -> DataFrame:
    """Keep frames where either hand is used; without both flags keep all."""
    if left not in frames.columns or right not in frames.columns:
        return frames
    used = F.col(left) | F.col(right)
    return frames.where(F.coalesce(used, F.lit(True)))


def take_trajectory_prefix(frames: DataFrame, ratio: float | str) -> DataFrame:
    """Keep the first ``int(n_episodes * ratio)`` episodes of each file.

    ``ratio`` is a number or the name of a per-row column; it must lie in (0, 1].
    """
    if not isinstance(ratio, str) and not 0.0 < ratio <= 1.0:
        raise ValueError(f"trajectory ratio {ratio} outside (0, 1]")
    keys = list(EPISODE)
    if isinstance(ratio, str):
        eps = frames.groupBy(*keys).agg(F.first(ratio).alias("__ratio"))
        r = F.col("__ratio")
        r = F.when((r > 0) & (r <= 1), r).otherwise(F.raise_error(F.lit("trajectory ratio outside (0, 1]")))
    else:
        eps, r = frames.groupBy(*keys).agg(F.lit(float(ratio)).alias("__ratio")), F.lit(float(ratio))
    ranked = rank_episodes(eps).where(F.col("ep_no") < F.floor(F.col("n_eps") * r))
    return join_same(frames, ranked.select(*keys), keys, "left_semi")


def slice_episodes(
    frames: DataFrame,
    stride: int = 1,
    start_episode: int = 0,
    max_episodes: int | None = None,
    max_steps: int | None = None,
    downsample: int = 1,
    reserve_last: bool = False,
) -> DataFrame:
    """Temporal stride, episode window, step limit, then every ``downsample``-th row.

    ``max_steps`` counts strided steps.  ``reserve_last`` keeps the last frame
    back for the action and drops episodes shorter than two frames.  The new
    ``frame_idx`` is dense; ``ts`` becomes the strided step number.
    """
    eps = rank_episodes(episode_lengths(frames))
    eps = eps.where(F.col("ep_no") >= start_episode)
    if max_episodes is not None:
        eps = eps.where(F.col("ep_no") < start_episode + max_episodes)
    if reserve_last:
        eps = eps.where(F.col("length") >= 2)
    d = join_same(frames, eps.select(*EPISODE, "length"), EPISODE)
    i = F.col("frame_idx")
    d = d.where(i % stride == 0)
    if reserve_last:
        d = d.where(i < F.col("length") - 1)
    if max_steps is not None:
        d = d.where(i < max_steps * stride)
    step = F.floor(i / stride)
    return (
        d.where(step % downsample == 0)
        .withColumn("ts", step.cast("double"))
        .withColumn("frame_idx", F.floor(step / downsample))
        .drop("length")
    )


def trim_idle(
    frames: DataFrame,
    position: Sequence[str],
    action: Sequence[str],
    eps: float = 0.005,
    frame_cut: str | None = None,
    keys: Sequence[str] = ("episode_id",),
) -> DataFrame:
    """Cut the resting head of each episode and re-index.

    The head ends at the first frame farther than ``eps`` from frame 0 (never
    moved: nothing is cut).  Leading frames with an all-zero action are cut
    next.  ``frame_cut`` names a column with an absolute frame limit.
    Only per-episode minima cross the shuffle.
    """
    keys = list(keys)
    first = frames.where(F.col("frame_idx") == 0).select(*keys, *[F.col(c).alias(f"__0{c}") for c in position])
    d = join_same(narrow(frames, keys, ["frame_idx", *position]), first, keys)
    sq = sum(((F.col(c) - F.col(f"__0{c}")) ** 2 for c in position), F.lit(0.0))
    moved = d.groupBy(*keys).agg(
        F.coalesce(F.min(F.when((F.sqrt(sq) > eps) & (F.col("frame_idx") >= 1), F.col("frame_idx"))), F.lit(0)).alias("__m")
    )
    nonzero = F.lit(False)
    for c in action:
        nonzero = nonzero | (F.col(c) != 0)
    d = join_same(narrow(frames, keys, ["frame_idx", *action]), moved, keys).where(F.col("frame_idx") >= F.col("__m"))
    begin = d.groupBy(*keys).agg(
        F.coalesce(F.min(F.when(nonzero, F.col("frame_idx"))), F.max("frame_idx") + 1).alias("__s")
    )
    out = join_same(frames, begin, keys).where(F.col("frame_idx") >= F.col("__s"))
    out = out.withColumn("frame_idx", F.col("frame_idx") - F.col("__s"))
    if frame_cut is not None:
        out = out.where(F.col(frame_cut).isNull() | (F.col("frame_idx") < F.col(frame_cut) - F.col("__s")))
    return out.drop("__s")


def chunk_overlap(
    frames: DataFrame, max_frames: int, extend: int, keys: Sequence[str] = ("episode_id",)
) -> DataFrame:
    """Split episodes into chunks of ``max_frames`` plus ``extend`` look-ahead frames.

    Adds ``chunk_no`` and ``chunk_idx``; a frame in an overlap appears in each
    of its chunks.  The remainder after the full chunks is kept only when the
    length is no multiple of ``max_frames``.
    """
    keys = list(keys)
    lens = frames.groupBy(*keys).agg(F.count(F.lit(1)).alias("__len"))
    full = F.greatest(F.floor((F.col("__len") - extend) / max_frames), F.lit(0))
    lens = lens.withColumn("__last", full - F.when(F.col("__len") % max_frames == 0, 1).otherwise(0))
    i = F.col("frame_idx")
    lo = F.greatest(F.lit(0), F.ceil((i - (max_frames + extend) + 1) / max_frames))
    hi = F.least(F.floor(i / max_frames), F.col("__last"))
    d = explode_range(join_same(frames, lens, keys), lo, hi, "chunk_no")
    return d.withColumn("chunk_idx", i - F.col("chunk_no") * max_frames).drop("__len", "__last")


def every_kth(
    samples: DataFrame, ratio: float | None = None, ratios: DataFrame | None = None, idx: str = "sample_idx",
    key: str = "domain",
) -> DataFrame:
    """Keep every ``int(1/ratio)``-th row; ``ratios(key, ratio)`` gives one per domain."""
    if ratios is None:
        k = 1 if ratio is None or ratio >= 1 else int(1 / ratio)
        return samples.where(F.col(idx) % k == 0)
    d = join_same(samples, ratios.select(key, F.col("ratio").alias("__r")), [key], "left")
    k = F.when(F.col("__r") < 1, F.floor(1 / F.col("__r"))).otherwise(F.lit(1))
    return d.where(F.col(idx) % k == 0).drop("__r")


def global_index(frames: DataFrame) -> DataFrame:
    """Contiguous sample number over all domains, files, episodes and frames."""
    idx = episode_index(frames).select(*EPISODE, "start")
    return join_same(frames, idx, EPISODE).withColumn("sample_no", F.col("start") + F.col("frame_idx")).drop("start")


def domain_bounds(frames: DataFrame) -> DataFrame:
    """Half-open range of sample numbers per domain."""
    d = frames.groupBy("domain").agg(F.count(F.lit(1)).alias("n"))
    w = W.orderBy("domain").rowsBetween(W.unboundedPreceding, 0)
    return d.withColumn("hi", F.sum("n").over(w)).select("domain", (F.col("hi") - F.col("n")).alias("lo"), "hi")


def locate(requests: DataFrame, bounds: DataFrame, idx: str = "sample_no") -> DataFrame:
    """Sample number -> (domain, local index)."""
    d = range_join(requests, bounds, [], idx, "lo", "hi", width=65_536)
    return d.withColumn("local_idx", F.col(idx) - F.col("lo")).drop("lo", "hi", "n")


def keep_ranges(frames: DataFrame, ranges: DataFrame | None, key: str = "episode_id", width: int = 1024) -> DataFrame:
    """Frames inside any ``[start, end)`` range of their episode; no table keeps all."""
    if ranges is None:
        return frames
    return range_join(frames, ranges.select(key, "start", "end"), [key], "frame_idx", "start", "end", width, "left_semi")


def success_only(episodes: DataFrame, pattern: str, path: str = "path") -> DataFrame:
    """Full-match regex on the episode's file path."""
    return episodes.where(F.col(path).rlike(f"^(?:{pattern})$"))
