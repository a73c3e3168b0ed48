"""Sensor cleaning, contact detection and quality checks.

Signals come in long form (keys + value) or as one array per frame; keys end in
the stream or taxel id.  ``frame_idx`` is dense inside the keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from episodica.plans.ordered import halo, hash_uniform, join_same, prefix
from episodica.plans.quantiles import deviations_at, exact_quantiles, is_finite, log_bin, value_bins, values_at
from episodica.plans.small import keep, lookup

EP = ("episode_id",)

MAD_SCALE = 1.4826
SUMMARY_QUANTILES = {"p10": 0.10, "p25": 0.25, "p50": 0.50, "p75": 0.75, "p90": 0.90, "p95": 0.95, "p99": 0.99}


def baseline_denoise(
    frames: DataFrame, value: str = "value", n: int = 10, threshold: float = 0.2, window: int = 3, keys: Sequence[str] = EP
) -> DataFrame:
    """Subtract the mean of the first ``n`` frames, zero small values, smooth, clip at 0.

    The moving average is centred and repeats the edge values.
    """
    keys = list(keys)
    base = frames.where(F.col("frame_idx") < n).groupBy(*keys).agg(F.avg(value).alias("__b"))
    x = F.col(value) - F.col("__b")
    d = join_same(frames, base, keys).withColumn("__x", F.when(x < threshold, F.lit(0.0)).otherwise(x)).drop("__b")
    if window <= 1:
        return d.withColumn(value, F.greatest(F.col("__x"), F.lit(0.0))).drop("__x")
    left, right = window // 2, window - window // 2 - 1
    d, w, home = halo(d, keys, "frame_idx", before=left, after=max(right, left))
    # a frame cut off by the episode end starts (ends) at the edge value
    terms = [F.first("__x").over(w.rowsBetween(-o, 0)) for o in range(1, left + 1)]
    terms += [F.last("__x").over(w.rowsBetween(0, o)) for o in range(1, right + 1)]
    total = F.col("__x")
    for t in terms:
        total = total + t
    d = d.withColumn("__s", total / window).where(home)
    return d.withColumn(value, F.greatest(F.col("__s"), F.lit(0.0))).drop("__s", "__x", "__blk")


def regroup_fingers(df: DataFrame, port: str, side: str, out: str = "fingers") -> DataFrame:
    """Port readings 1..60 -> five areas of twelve; the left hand lists fingers in reverse."""
    order = range(4, -1, -1) if side == "left" else range(5)
    return df.withColumn(out, F.array(*[F.slice(port, i * 12 + 1, 12) for i in order]))


def regroup_palm(df: DataFrame, port: str, side: str, out: str = "palm") -> DataFrame:
    """Port readings 66..137 -> one 5 x 15 area; the short first row is padded on the outer side."""
    row, rest, pad = F.slice(port, 66, 12), F.slice(port, 78, 60), F.array_repeat(F.lit(0.0), 3)
    parts = (row, pad, rest) if side == "left" else (pad, row, rest)
    return df.withColumn(out, F.concat(*parts))


def split_mat(df: DataFrame, data: str, rows: int = 12, cols: int = 64, out: str = "halves") -> DataFrame:
    """A flat rows x cols mat -> two sensors of half the width."""
    half = cols // 2

    def side(k):
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)),
                                     lambda r: F.slice(F.col(data), r * cols + 1 + k * half, F.lit(half))))

    return df.withColumn(out, F.array(side(0), side(1)))


def repair_glitches(frames: DataFrame, joints: str, limit: float = 100.0, keys: Sequence[str] = EP) -> DataFrame:
    """Frames with a non-finite or huge joint take the nearest clean frame of the episode.

    Ties go to the earlier frame; an episode without a clean frame becomes zeros.
    """
    bad = F.exists(joints, lambda x: F.isnan(x) | (F.abs(x) > limit) | x.isNull())
    d = frames.withColumn("__g", F.when(~bad, F.struct(F.col("frame_idx").alias("i"), F.col(joints).alias("v"))))
    d = prefix(d, keys, "frame_idx", {"__p": ("last", F.col("__g"))})
    d = prefix(d, keys, "frame_idx", {"__n": ("last", F.col("__g"))}, reverse=True)
    i = F.col("frame_idx")
    early = F.col("__n.i").isNull() | (i - F.col("__p.i") <= F.col("__n.i") - i)
    fixed = F.when(F.col("__p.i").isNotNull() & early, F.col("__p.v")).when(F.col("__n.i").isNotNull(), F.col("__n.v"))
    zero = F.transform(joints, lambda x: F.lit(0.0))
    return d.withColumn(joints, F.coalesce(fixed, zero)).drop("__g", "__p", "__n")


def clean_flag(c: Column) -> Column:
    """Binary usage flag: above 0.5 -> 1, else 0; NaN and -Inf count as 0, +Inf as 1."""
    inf = F.lit(float("inf"))
    x = F.when(F.isnan(c) | (c == -inf), F.lit(0.0)).when(c == inf, F.lit(1.0)).otherwise(c)
    return F.when(x > 0.5, F.lit(1)).otherwise(F.lit(0))


def delta_score(frames: DataFrame, data: str, keys: Sequence[str] = EP, out: str = "score") -> DataFrame:
    """Mean absolute change to the previous frame over finite elements.

    0 when no element is finite, NULL for the first frame; unequal sizes are an error.
    """
    d, w, home = halo(frames, keys, "frame_idx", before=1)
    d = d.withColumn("__p", F.lag(data).over(w)).where(home).drop("__blk")
    same = F.size("__p") == F.size(data)
    diff = F.zip_with(F.col(data), F.col("__p"), lambda a, b: F.abs(a - b))
    fin = F.filter(diff, lambda x: ~F.isnan(x) & (x < float("inf")))
    d = d.withColumn("__d", F.when(F.col("__p").isNull(), None).when(same, fin).otherwise(
        F.raise_error(F.lit("tactile frame shapes differ")).cast("array<double>")))
    n = F.size("__d")
    mean = F.aggregate("__d", F.lit(0.0), lambda s, x: s + x) / F.greatest(n, F.lit(1))
    return d.withColumn(out, F.when(F.col("__p").isNotNull(), F.when(n == 0, F.lit(0.0)).otherwise(mean))).drop("__p", "__d")


def score_summary(scores: DataFrame, stream: Sequence[str], score: str = "score") -> DataFrame:
    """Count, min, max, mean, population std and quantiles of the scores per stream."""
    base = scores.groupBy(*stream).agg(
        F.count(score).alias("count"), F.min(score).alias("min"), F.max(score).alias("max"),
        F.avg(score).alias("mean"), F.stddev_pop(score).alias("std"))
    return join_same(base, exact_quantiles(scores, stream, score, SUMMARY_QUANTILES), stream, "left")


def contact_thresholds(scores: DataFrame, stream: Sequence[str] = ("stream",), score: str = "score", k: float = 3.0) -> DataFrame:
    """Robust contact threshold per stream: noise median + k * 1.4826 * MAD.

    The noise pool is the lower half of the positive scores.  Streams without a
    positive score get a NULL threshold and status ``no_positive_scores``.
    """
    stream = list(stream)
    s = F.col(score).cast("double")
    binned = F.when(s > 0, log_bin(s, 64))
    fin = keep(scores.where(is_finite(s)).select(*stream, s.alias("s"), binned.alias("bin")), "scores")
    # the one pass over all scores; everything below reads the histogram and a few bins
    hist = keep(value_bins(fin, stream, "s", "bin"), "score-bins")
    positive = F.col("bin").isNotNull()
    counts = hist.groupBy(*stream).agg(
        F.sum("cnt").alias("score_count"), F.coalesce(F.sum(F.when(positive, F.col("cnt"))), F.lit(0)).alias("positive_score_count"),
        F.coalesce(F.sum(F.when(~positive, F.col("cnt"))), F.lit(0)).alias("non_positive_score_count"))
    counts = lookup(counts)
    middle = lambda n: (F.floor((n - 1) / 2).cast("long").alias("a"), F.ceil((n - 1) / 2).cast("long").alias("b"))
    mean = lambda: F.col("a") + (F.col("b") - F.col("a")) * F.when(F.col("a") == F.col("b"), 0.0).otherwise(0.5)
    n = F.col("positive_score_count")
    med = values_at(fin, hist, stream, "s", "bin", counts.where(n > 0).select(*stream, *middle(n)), ["a", "b"])
    # the noise pool is what is not above the median, so it ends with the lower middle value
    med = lookup(med.select(*stream, mean().alias("score_median"), F.col("a").alias("top"), F.col("upto_a").alias("noise_pool_count")))
    pool_n = F.col("noise_pool_count")
    low = values_at(fin, hist, stream, "s", "bin", med.select(*stream, *middle(pool_n)), ["a", "b"])
    t = lookup(join_same(med, low.select(*stream, mean().alias("noise_median")), stream))
    part = join_same(hist.where(positive), t.select(*stream, "top", pool_n.alias("n"), F.col("noise_median").alias("centre")), stream)
    part = part.where(F.col("lo") <= F.col("top")).withColumn("cnt", F.least(F.col("before") + F.col("cnt"), F.col("n")) - F.col("before"))
    part = part.withColumn("hi", F.least("hi", "top"))
    mad = deviations_at(fin, part, stream, "s", "bin", 0.5)
    t = join_same(t.drop("top"), mad.withColumnRenamed("dev", "noise_mad"), stream)
    t = t.withColumn("robust_std", F.lit(MAD_SCALE) * F.col("noise_mad")).withColumn(
        "threshold", F.greatest(F.lit(0.0), F.col("noise_median") + F.lit(float(k)) * F.col("robust_std")))
    t = lookup(t)
    # whole bins above the threshold are counted, the bin it falls into is read
    cut = join_same(hist.where(positive), t.select(*stream, "threshold"), stream)
    above = cut.groupBy(*stream).agg(F.sum(F.when(F.col("lo") > F.col("threshold"), F.col("cnt")).otherwise(F.lit(0))).alias("__whole"))
    across = cut.where((F.col("lo") <= F.col("threshold")) & (F.col("hi") > F.col("threshold"))).select(*stream, "bin", "threshold")
    some = join_same(fin, across, [*stream, "bin"]).groupBy(*stream).agg(F.count(F.when(F.col("s") > F.col("threshold"), 1)).alias("__some"))
    exceed = join_same(above, some, stream, "left").select(*stream, (F.col("__whole") + F.coalesce("__some", F.lit(0))).alias("exceed_count"))
    out = join_same(join_same(counts, t, stream, "left"), exceed, stream, "left")
    frac = F.col("exceed_count") / F.col("positive_score_count")
    return out.withColumn("exceed_fraction", frac).withColumn("threshold_quantile", 1 - frac).withColumn(
        "status", F.when(F.col("threshold").isNull(), "no_positive_scores").otherwise("ok"))


def missing_thresholds(scores: DataFrame, thresholds: DataFrame, stream: Sequence[str] = ("stream",)) -> DataFrame:
    """Streams that have frames but no usable threshold."""
    return join_same(scores.select(*stream).distinct(), thresholds.where("threshold IS NOT NULL"), stream, "left_anti")


def contact_flag(scores: DataFrame, thresholds: DataFrame, frame: Sequence[str], stream: Sequence[str] = ("stream",)) -> DataFrame:
    """Per frame: does any stream's score exceed its threshold?  A missing threshold is an error."""
    t = lookup(thresholds.select(*stream, "threshold"))
    d = join_same(scores, t, stream, "left")
    thr = F.when(F.col("threshold").isNull(), F.raise_error(F.lit("a stream has no contact threshold")).cast("double")).otherwise(F.col("threshold"))
    hit = F.when(F.col("score").isNull(), F.lit(False)).otherwise(F.col("score") > thr)
    return d.groupBy(*frame).agg(F.bool_or(hit).alias("is_contact"))


def contact_dropout(samples: DataFrame, ratio: float, key: Column, masks: Sequence[str], seed: int = 0) -> DataFrame:
    """Mask (set to false) the given columns of contact frames with probability ``ratio``."""
    if ratio <= 0:
        return samples
    drop = F.col("is_contact") & (hash_uniform(seed, key) <= ratio)
    return samples.withColumns({m: F.when(drop, F.lit(False)).otherwise(F.col(m)) for m in masks})


def stream_identity(sensor: Column, ttype: Column, shape: Column, leading: int = 2) -> Column:
    """Stable key ``sensor_type_shape``; the shape drops its leading (time, area) axes."""
    tail = F.slice(shape, leading + 1, F.greatest(F.size(shape) - leading, F.lit(0)))
    bad = (F.size(tail) == 0) | sensor.isNull() | ttype.isNull()
    key = F.concat_ws("_", sensor, ttype, F.array_join(tail.cast("array<string>"), "_"))
    return F.when(bad, F.raise_error(F.lit("empty tactile metadata or shape")).cast("string")).otherwise(key)


def first_text(c: Column) -> Column:
    """First element of array metadata, decoded to text."""
    return F.get(c, F.lit(0)).cast("string")


def stream_catalog(tactile: DataFrame, order: Sequence[str], keys: Sequence[str] = ("domain", "stream"),
                   cols: Sequence[str] = ("shape", "area", "sensor", "ttype")) -> DataFrame:
    """Metadata of the first sample per domain and stream."""
    return tactile.groupBy(*keys).agg(F.min_by(F.struct(*cols), F.struct(*order)).alias("m")).select(*keys, "m.*")


def metadata_drift(tactile: DataFrame, cols: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """Metadata that changes within the keys: first value and whether it drifts."""
    aggs = []
    for c in cols:
        aggs += [F.min_by(c, "frame_idx").alias(f"first_{c}"),
                 ((F.min(c) != F.max(c)) | ((F.count(c) > 0) & (F.count(c) < F.count(F.lit(1))))).alias(f"drift_{c}")]
    return tactile.groupBy(*keys).agg(*aggs)


def blank_frame(pixels: Column) -> Column:
    """Empty or all-zero frame."""
    return (F.size(pixels) <= 0) | (F.coalesce(F.array_max(pixels), F.lit(0)) == 0)


def middle_frames(frames: DataFrame, keys: Sequence[str] = EP) -> DataFrame:
    """The middle frame (index n div 2) of each episode."""
    n = frames.groupBy(*keys).agg(F.floor(F.count(F.lit(1)) / 2).alias("__m"))
    # written as a difference, or it would become a key of the join and move stored frames
    return join_same(frames, n, keys).where(F.col("frame_idx") - F.col("__m") == 0).drop("__m")


def expand_gray(pixels: Column, channels: int = 3) -> Column:
    """Repeat every pixel of a single-channel image (channels last)."""
    return F.flatten(F.transform(pixels, lambda x: F.array_repeat(x, channels)))


def flatten_areas(tactile: DataFrame, data: str = "data", out: str = "area_no") -> DataFrame:
    """One row per function area of nested tactile data."""
    rest = [c for c in tactile.columns if c != data]
    return tactile.select(*rest, F.posexplode(data).alias(out, data))
