"""Normalisation statistics: fit, scope, apply, invert, override.

Statistics are a long table (keys, dim, lo, hi[, t], mode): ``lo/hi`` are
q01/q99 (``quantile``) or mean/std (``zscore``).  Fitting explodes vectors
inside the map side of an aggregate, so only per-dim partial results shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from episodica.functions.layout import WIDTH, shared_dims
from episodica.operators.align import chunk_weights
from episodica.plans.ordered import draw_first, hash_hex, hash_uniform, join_same
from episodica.plans.quantiles import exact_quantiles, is_finite
from episodica.plans.small import lookup

EPS = 1e-8
RTOL = 1e-5
CLIP = {"quantile": 2.0, "zscore": 10.0}
CORRUPT_STD, CORRUPT_MEAN = 1000.0, 1e6
HIST_BINS = 5000


def guard_stats(norm_type: str, lo: Column, hi: Column) -> tuple[Column, Column]:
    """Flat dims: q01/q99 open to a unit interval, zero or invalid std becomes 1."""
    if norm_type == "quantile":
        flat = F.abs(lo - hi) <= F.lit(EPS) + F.lit(RTOL) * F.abs(hi)
        return (F.when(lo.isNull(), F.lit(-0.5)).when(flat, lo - 0.5).otherwise(lo),
                F.when(lo.isNull(), F.lit(0.5)).when(flat, lo + 0.5).otherwise(hi))
    bad = hi.isNull() | F.isnan(hi) | (hi <= EPS)
    return F.coalesce(lo, F.lit(0.0)), F.when(bad, F.lit(1.0)).otherwise(hi)


def fit_cells(cells: DataFrame, keys: Sequence[str], norm_type: str, report: bool = False) -> DataFrame:
    """Statistics of (keys, value, valid) cells; keys end in the dim (and time step).

    Only finite values count.  ``report`` adds ``n_bad``, the number of valid cells
    that are null, NaN or infinite.
    """
    keys = list(keys)
    bad_cells = F.count_if(F.col("valid") & ~is_finite(F.col("value"))).alias("n_bad")
    if norm_type == "quantile":
        dims = cells.groupBy(*keys).agg(bad_cells)
        q = exact_quantiles(cells.where("valid"), keys, "value", {"lo": 0.01, "hi": 0.99})
        d = join_same(dims, q.select(*keys, "lo", "hi"), keys, "left")
    elif norm_type == "zscore":
        v = F.when(F.col("valid") & is_finite(F.col("value")), F.col("value"))
        d = cells.groupBy(*keys).agg(F.avg(v).alias("lo"), F.stddev_pop(v).alias("hi"), bad_cells)
    else:
        raise ValueError(f"unknown normalisation type {norm_type}")
    lo, hi = guard_stats(norm_type, F.col("lo"), F.col("hi"))
    return d.select(*keys, lo.alias("lo"), hi.alias("hi"), *(["n_bad"] if report else []))


def vector_cells(samples: DataFrame, keys: Sequence[str], vec: str, mask: str | None = None, per_time: bool = False) -> DataFrame:
    """Explode ``vec`` (one vector, or a chunk of vectors) to cells.

    A chunk keeps its step as ``t`` only with ``per_time``.
    """
    keys = list(keys)
    chunked = samples.schema[vec].dataType.elementType.typeName() == "array"
    dim, t = F.col("dim").cast("bigint").alias("dim"), []
    if mask is None:  # plain explodes, no struct per cell
        d = samples.select(*keys, F.col(vec).alias("v"))
        if chunked:
            d = d.select(*keys, F.posexplode("v").alias("t", "v"))
            t = [F.col("t").cast("bigint").alias("t")] if per_time else []
        d = d.select(*keys, *t, F.posexplode("v").alias("dim", "value"))
        return d.select(*keys, *(["t"] if t else []), dim, F.col("value").cast("double").alias("value"), F.lit(True).alias("valid"))
    d = samples.select(*keys, F.arrays_zip(F.col(vec).alias("v"), F.col(mask).alias("m")).alias("z"))
    if chunked:
        d = d.select(*keys, F.posexplode("z").alias("t", "z")).select(*keys, "t", F.arrays_zip(F.col("z.v").alias("v"), F.col("z.m").alias("m")).alias("z"))
        t = [F.col("t").cast("bigint").alias("t")] if per_time else []
    d = d.select(*keys, *t, F.posexplode("z").alias("dim", "z"))
    return d.select(*keys, *(["t"] if t else []), dim, F.col("z.v").cast("double").alias("value"),
                    F.coalesce(F.col("z.m") > 0, F.lit(False)).alias("valid"))


def norm_fit(samples: DataFrame, keys: Sequence[str], vec: str, norm_type: str, mask: str | None = None, per_time: bool = False, report: bool = False) -> DataFrame:
    """Per keys and dim (and step): q01/q99 or mean/std with guards; the mask limits the cells."""
    cells = vector_cells(samples, keys, vec, mask, per_time)
    return fit_cells(cells, [*keys, *(["t"] if per_time else []), "dim"], norm_type, report)


def weighted_moments(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Mean and population std of (keys, value, valid, weight) cells as ``lo`` and ``hi``.

    Moments of the cells of one weight come from Spark's stable aggregates; there are
    few weights, so they meet in one short list per key.
    """
    keys = list(keys)
    v = F.when(F.col("valid") & is_finite(F.col("value")) & (F.col("weight") > 0), F.col("value"))
    one = cells.groupBy(*keys, "weight").agg(F.count(v).alias("n"), F.avg(v).alias("a"), F.var_pop(v).alias("s"))
    part = F.when(F.col("n") > 0, F.struct((F.col("weight") * F.col("n")).cast("double").alias("w"), "a", "s"))
    g = one.groupBy(*keys).agg(F.collect_list(part).alias("p"))
    total = F.aggregate("p", F.lit(0.0), lambda t, x: t + x["w"])
    g = g.withColumn("w", F.when(F.size("p") > 0, total)).withColumn("lo", F.aggregate("p", F.lit(0.0), lambda t, x: t + x["w"] * x["a"]) / F.col("w"))
    spread = F.aggregate("p", F.lit(0.0), lambda t, x: t + x["w"] * (x["s"] + (x["a"] - F.col("lo")) * (x["a"] - F.col("lo"))))
    return g.select(*keys, "lo", F.sqrt(spread / F.col("w")).alias("hi"))


def norm_fit_chunks(
    frames: DataFrame, keys: Sequence[str], vec: str, norm_type: str, horizon: int, stride: int = 1, clamp: bool = False,
    episode: Sequence[str] = ("episode_id",), mask: str | None = None, per_time: bool = False,
) -> DataFrame:
    """The statistics of :func:`norm_fit` over action chunks, from the frames.

    A frame counts as often as it stands in a chunk (``align.chunk_weights``), so no chunk
    is made and a frame's cells are read once, not ``horizon`` times; with ``per_time``
    once for each step it stands at.
    """
    keys = list(keys)
    d = chunk_weights(frames, horizon, stride, clamp, episode, "__weights")
    if per_time:
        d = d.select(*keys, vec, *([mask] if mask else []), F.posexplode("__weights").alias("t", "weight")).withColumn("t", F.col("t").cast("bigint"))
        by = [*keys, "t"]
    else:
        d = d.withColumn("weight", F.aggregate("__weights", F.lit(0).cast("long"), lambda a, b: a + b))
        by = keys
    cells = vector_cells(d, [*by, "weight"], vec, mask)
    by = [*by, "dim"]
    if norm_type == "zscore":
        s = weighted_moments(cells, by)
    elif norm_type == "quantile":
        s = exact_quantiles(cells.where("valid"), by, "value", {"lo": 0.01, "hi": 0.99}, weight="weight")
        s = join_same(cells.select(*by).distinct(), s, by, "left")
    else:
        raise ValueError(f"unknown normalisation type {norm_type}")
    lo, hi = guard_stats(norm_type, F.col("lo"), F.col("hi"))
    return s.select(*by, lo.alias("lo"), hi.alias("hi"))


def hash_limit(samples: DataFrame, keys: Sequence[str], order: Column, limit: int, seed: int = 0) -> DataFrame:
    """At most ``limit`` rows per keys, chosen by hash (a sampling setting of the fit)."""
    d = samples.withColumn("__h", hash_hex(seed, order))
    return draw_first(d, list(keys), "__h", lambda n: F.lit(limit), "__in").where("__in").drop("__h", "__in")


def norm_fit_scoped(samples: DataFrame, vec: str, mode: str, norm_type: str, width: int = WIDTH, mask: str | None = None,
                    per_time: bool = False, ratio: float = 1.0, sample: Column | None = None, seed: int = 0) -> DataFrame:
    """Fit domain dims per domain and shared dims over all domains, in one pass.

    Rows of shared dims carry ``domain = NULL`` and ``scope = 'shared'``.  With
    ``per_time`` every step ``t`` of a chunk has statistics of its own.  A
    ``ratio`` below 1 fits on that share of the samples, drawn by a hash of the
    identity ``sample``.
    """
    shared = [d for d in shared_dims(mode) if d < width]
    if ratio < 1.0:
        if sample is None:
            raise ValueError("a sample ratio needs the identity of a sample")
        samples = samples.where(hash_uniform(seed, sample) < ratio)
    cells = vector_cells(samples, ["domain"], vec, mask, per_time)
    is_shared = F.col("dim").isin(shared) if shared else F.lit(False)
    cells = cells.withColumn("domain", F.when(~is_shared, F.col("domain")))
    s = fit_cells(cells, ["domain", *(["t"] if per_time else []), "dim"], norm_type)
    # the dim tells the scope: a domain may be null itself
    return s.withColumn("scope", F.when(is_shared, "shared").otherwise("domain"))


def norm_fit_streams(tactile: DataFrame, data: str, ttype: str, norm_type: str, keys: Sequence[str] = ("domain", "stream")) -> DataFrame:
    """Statistics per stream identity, areas as extra samples.

    ``data`` is one array per area.  Streams of binary type get mode ``ignore``;
    two types under one key are an error.
    """
    keys = list(keys)
    types = tactile.groupBy(*keys).agg(F.min(ttype).alias("a"), F.max(ttype).alias("b"))
    t = F.when(F.col("a") != F.col("b"), F.raise_error(F.lit("mixed tactile types under one stream")).cast("string")).otherwise(F.col("a"))
    types = types.select(*keys, t.alias("__type"))
    areas = tactile.where(F.lower(ttype) != "binary").select(*keys, F.explode(data).alias("v"))
    fit = norm_fit(areas, keys, "v", norm_type)
    d = join_same(types, fit, keys, "left")
    return d.select(*keys, "dim", "lo", "hi", F.when(F.lower("__type") == "binary", "ignore").alias("mode"))


def norm_fit_channels(pixels: DataFrame, key: Sequence[str], batch: str, sample: Column, channels: str, norm_type: str,
                      per_batch: int = 0, budget: int = 0, seed: int = 0) -> DataFrame:
    """Per-channel statistics of scaled pixels from a bounded hash sample.

    At most ``per_batch`` vectors of a batch and ``budget`` of a key are used
    (0 = no limit); hash order spreads the budget over all batches.  Quantiles
    come from the 5000-bin histogram.
    """
    key = list(key)
    d = pixels
    if per_batch > 0:
        d = hash_limit(d, [*key, batch], sample, per_batch, seed)
    if budget > 0:
        d = hash_limit(d, key, sample, budget, seed + 1)
    cells = vector_cells(d, key, channels).withColumn("value", F.col("value") / 255.0 * 2.0 - 1.0)
    r = running_stats(cells, [*key, "dim"], "value")
    lo, hi = ("q01", "q99") if norm_type == "quantile" else ("mean", "std")
    return r.select(*key, "dim", F.col(lo).alias("lo"), F.col(hi).alias("hi"), F.lit("div255_mul2_minus1").alias("preprocess"))


# ------------------------------------------------------------- running stats
def histogram(values: DataFrame, keys: Sequence[str], value: str, bins: int = HIST_BINS) -> tuple[DataFrame, DataFrame]:
    """(moments per keys, counts per keys and bin) over the final value range."""
    keys = list(keys)
    v = F.col(value)
    m = values.groupBy(*keys).agg(F.count(v).alias("n"), F.min(v).alias("min"), F.max(v).alias("max"),
                                  F.avg(v).alias("mean"), F.avg(v * v).alias("mean_sq"))
    m = lookup(m)
    d = values.select(*keys, v.alias("__v")).where(v.isNotNull())
    d = join_same(d, m, keys)
    lo, hi = F.col("min") - 1e-10, F.col("max") + 1e-10
    b = F.least(F.floor((F.col("__v") - lo) / (hi - lo) * bins), F.lit(bins - 1))
    return m, d.groupBy(*keys, b.alias("bin")).agg(F.count(F.lit(1)).alias("c"))


def stats_from_histogram(m: DataFrame, h: DataFrame, keys: Sequence[str], quantiles=(("q01", 0.01), ("q99", 0.99)), bins: int = HIST_BINS) -> DataFrame:
    """Mean, std and quantiles (left edge of the first bin reaching q * n)."""
    keys = list(keys)
    w = W.partitionBy(*keys).orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    cum = join_same(h, m, keys).withColumn("cum", F.sum("c").over(w))
    lo, hi = F.col("min") - 1e-10, F.col("max") + 1e-10
    edge = lo + F.col("bin") * (hi - lo) / bins
    q = cum.groupBy(*keys).agg(*[F.min(F.when(F.col("cum") >= F.lit(p) * F.col("n"), edge)).alias(name) for name, p in quantiles])
    n = F.when(F.col("n") < 2, F.raise_error(F.lit("statistics need at least two vectors")).cast("bigint")).otherwise(F.col("n"))
    var = F.greatest(F.lit(0.0), F.col("mean_sq") - F.col("mean") * F.col("mean"))
    return join_same(m, q, keys).select(*keys, n.alias("n"), "min", "max", "mean", F.sqrt(var).alias("std"), *[name for name, _ in quantiles])


def running_stats(values: DataFrame, keys: Sequence[str], value: str = "value") -> DataFrame:
    """Count, min, max, mean, std and histogram quantiles of long values."""
    m, h = histogram(values, keys, value)
    return stats_from_histogram(m, h, keys)


# ------------------------------------------------------------ apply / invert
def stat_arrays(stats: DataFrame, keys: Sequence[str], width: int) -> DataFrame:
    """Long statistics -> one row per keys with ``lo``/``hi`` arrays of ``width`` (NULL = not listed).

    Statistics per step are laid out step after step: entry ``t * width + dim``.
    """
    at = F.col("dim") + F.col("t") * width if "t" in stats.columns else F.col("dim")
    m = stats.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct(at.cast("int"), F.struct("lo", "hi")))).alias("__m"))
    last = F.greatest(F.lit(width), F.array_max(F.map_keys("__m")) + 1) - 1 if "t" in stats.columns else F.lit(width - 1)
    idx = F.sequence(F.lit(0), last)
    return m.select(*keys, F.transform(idx, lambda i: F.try_element_at("__m", i)["lo"]).alias("__lo"),
                    F.transform(idx, lambda i: F.try_element_at("__m", i)["hi"]).alias("__hi"))


def _forward(norm_type: str, x: Column, lo: Column, hi: Column) -> Column:
    if norm_type == "quantile":
        y = (x - lo) / (hi - lo + 1e-6) * 2.0 - 1.0
    else:
        y = (x - lo) / F.when(F.abs(hi) < EPS, F.lit(1.0)).otherwise(hi)
    c = CLIP[norm_type]
    return F.greatest(F.lit(-c), F.least(F.lit(c), y))


def _backward(norm_type: str, y: Column, lo: Column, hi: Column) -> Column:
    return (y + 1.0) / 2.0 * (hi - lo) + lo if norm_type == "quantile" else y * hi + lo


def _over(vec: str, fn, nested: bool, step: int) -> Column:
    """``fn`` on every listed entry; ``step`` is the number of statistics between two steps of a chunk (0 = one set for all)."""
    def one(v: Column, base: Column) -> Column:
        return F.transform(v, lambda x, i: F.when(F.get("__lo", base + i).isNull(), x).otherwise(fn(x, F.get("__lo", base + i), F.get("__hi", base + i))))

    return F.transform(vec, lambda v, t: one(v, t * step)) if nested else one(F.col(vec), F.lit(0))


def _with_stats(samples: DataFrame, vec: str, stats: DataFrame, keys: Sequence[str], width: int, fn) -> DataFrame:
    nested = samples.schema[vec].dataType.elementType.typeName() == "array"
    per_time = "t" in stats.columns
    if per_time and not nested:
        raise ValueError(f"statistics per step need chunks, {vec} is a single vector")
    d = join_same(samples, lookup(stat_arrays(stats, keys, width), 20_000), keys, "left")
    size = F.size(F.get(vec, F.lit(0))) if nested else F.size(vec)
    wrong = F.raise_error(F.lit(f"{vec} is not {width} wide")).cast(samples.schema[vec].dataType)
    unknown = F.raise_error(F.concat(F.lit("no statistics for "), F.concat_ws(", ", *[F.col(k).cast("string") for k in keys])))
    unknown = unknown.cast(samples.schema[vec].dataType)
    body = F.when(F.col("__lo").isNull(), unknown).otherwise(_over(vec, fn, nested, width if per_time else 0))
    if per_time:
        short = F.raise_error(F.lit(f"{vec} has more steps than its statistics")).cast(samples.schema[vec].dataType)
        body = F.when(F.size(vec) * width > F.ceil(F.size("__lo") / width) * width, short).otherwise(body)
    # a null or empty vector has nothing to normalise
    return d.withColumn(vec, F.when(F.col(vec).isNull() | (F.size(vec) == 0), F.col(vec)).when(size != width, wrong).otherwise(body)).drop("__lo", "__hi")


def _scoped(samples, vec, stats, norm_type, width, fn_of):
    """Domain and shared dims are disjoint, so both scopes meet in one array per domain."""
    # evaluated once: the fit may be a lazy plan over the samples themselves
    stats = lookup(stats)
    cols = [*(["t"] if "t" in stats.columns else []), "dim", "lo", "hi"]
    shared = stats.where("scope = 'shared'").select(*cols)
    own = stats.where("scope = 'domain'").select("domain", *cols)
    if own.isEmpty():
        doms = samples.select("domain").distinct()
    else:
        # the domains that were fitted; any other has no statistics of its own and is an error
        doms = own.select("domain").distinct()
    # every domain sees the shared dims: the list of them rides on the small domain table
    arr = shared.agg(F.collect_list(F.struct(*cols)).alias("s")).scalar()
    both = own.unionByName(doms.select("domain", F.explode(arr).alias("e")).select("domain", "e.*"))
    return _with_stats(samples, vec, both, ["domain"], width, fn_of(norm_type))


def norm_apply(samples: DataFrame, vec: str, stats: DataFrame, norm_type: str, width: int = WIDTH) -> DataFrame:
    """Normalise listed dims (quantile clips at 2, z-score at 10); other dims pass through.

    ``stats`` comes from :func:`norm_fit_scoped`: domain dims use the domain's
    rows, shared dims the rows of all domains.  Statistics with a step ``t`` apply
    to that step of a chunk.  A wrong width is an error, and so is a domain that
    has no statistics.
    """
    return _scoped(samples, vec, stats, norm_type, width, lambda t: lambda x, lo, hi: _forward(t, x, lo, hi))


def norm_invert(samples: DataFrame, vec: str, stats: DataFrame, norm_type: str, width: int = WIDTH) -> DataFrame:
    """Undo :func:`norm_apply` inside the clip range (quantile: up to its epsilon)."""
    return _scoped(samples, vec, stats, norm_type, width, lambda t: lambda y, lo, hi: _backward(t, y, lo, hi))


def norm_apply_streams(tactile: DataFrame, data: str, stats: DataFrame, norm_type: str, own: str, identity: str, invert: bool = False) -> DataFrame:
    """Normalise one array per stream, by the stream's own key, else by its identity.

    ``ignore`` streams pass through, ``image_norm`` pixels are only scaled, fitted
    pixels are scaled first.  A stream without statistics is an error.
    """
    stats = stats if "preprocess" in stats.columns else stats.withColumn("preprocess", F.lit(None).cast("string"))
    s = stats.groupBy("stream").agg(
        F.array_sort(F.collect_list(F.when(F.col("lo").isNotNull(), F.struct("dim", "lo", "hi")))).alias("p"),
        F.max("mode").alias("mode"), F.max("preprocess").alias("pre"))
    s = lookup(s.withColumn("hit", F.lit(True)))
    a, b = s.select(*[F.col(c).alias(f"a_{c}") for c in s.columns]), s.select(*[F.col(c).alias(f"b_{c}") for c in s.columns])
    # without a key of its own a stream goes by its identity, which may be null as well
    d = tactile.join(a, F.col(own) == F.col("a_stream"), "left")
    d = d.join(b, F.col(identity).eqNullSafe(F.col("b_stream")), "left")
    pick = lambda c: F.when(F.col("a_hit"), F.col(f"a_{c}")).otherwise(F.col(f"b_{c}"))
    d = d.withColumns({"__p": pick("p"), "__mode": pick("mode"), "__pre": pick("pre"), "__hit": F.coalesce("a_hit", "b_hit")})
    x = F.transform(data, lambda v: v.cast("double"))
    scaled = F.transform(x, lambda v: v / 255.0 * 2.0 - 1.0)
    body = F.when(F.col("__pre").isNotNull(), scaled).otherwise(x)
    fn = _backward if invert else _forward
    src = x if invert else body
    fitted = F.zip_with(src, F.col("__p"), lambda v, e: fn(norm_type, v, e["lo"], e["hi"]))
    if invert:
        undo = lambda c: F.transform(c, lambda v: (v + 1.0) / 2.0 * 255.0)
        fitted = F.when(F.col("__pre").isNotNull(), undo(fitted)).otherwise(fitted)
        scaled = undo(x)
    bad = F.raise_error(F.concat(F.lit("no statistics for stream "), F.col(identity))).cast("array<double>")
    out = F.when(F.col("__hit").isNull(), bad).when(F.col("__mode") == "ignore", x).when(F.col("__mode") == "image_norm", scaled).otherwise(fitted)
    drop = [f"{t}_{c}" for t in "ab" for c in s.columns]
    return d.withColumn(data, out).drop(*drop, "__p", "__mode", "__pre", "__hit")


def scale_simple(x: Column, lo: Column, hi: Column, quantile: bool = False) -> Column:
    """Generic forward scaling: no clip, statistics cut to the data width."""
    if quantile:
        f = lambda v, i: (v - F.get(lo, i)) / (F.get(hi, i) - F.get(lo, i) + 1e-6) * 2.0 - 1.0
    else:
        f = lambda v, i: (v - F.get(lo, i)) / (F.get(hi, i) + 1e-6)
    return F.transform(x, f)


def unscale_simple(x: Column, lo: Column, hi: Column, quantile: bool = False) -> Column:
    """Exact inverse of :func:`scale_simple`; dims beyond the statistics: pass (quantile) or mean 0, std 1."""
    if quantile:
        f = lambda v, i: F.when(F.get(lo, i).isNull(), v).otherwise(
            (v + 1.0) / 2.0 * (F.get(hi, i) - F.get(lo, i) + 1e-6) + F.get(lo, i))
    else:
        f = lambda v, i: v * (F.coalesce(F.get(hi, i), F.lit(1.0)) + 1e-6) + F.coalesce(F.get(lo, i), F.lit(0.0))
    return F.transform(x, f)


# -------------------------------------------------------- hygiene, overrides
def stats_sanitize(stats: DataFrame, mean: str = "lo", std: str = "hi") -> DataFrame:
    """Non-finite or absurd z-score dims become (0, 1); ``was_corrupt`` reports them."""
    def wild(c, limit):
        return c.isNull() | F.isnan(c) | (F.abs(c) > limit)

    bad = wild(F.col(std), CORRUPT_STD) | wild(F.col(mean), CORRUPT_MEAN)
    d = stats.withColumn("was_corrupt", bad)
    return d.withColumn(mean, F.when(bad, F.lit(0.0)).otherwise(F.col(mean))).withColumn(
        std, F.when(F.col("was_corrupt"), F.lit(1.0)).otherwise(F.col(std)))


def stats_overlay(current: DataFrame, override: DataFrame, keys: Sequence[str], values: Sequence[str], only_changed: bool = False) -> DataFrame:
    """Replace entries present on both sides; ``replaced`` marks them.

    Norm statistics count every match, contact thresholds (``only_changed``)
    just those whose value differs.
    """
    o = override.select(*keys, *[F.col(v).alias(f"__o_{v}") for v in values], F.lit(True).alias("__hit"))
    d = join_same(current, o, keys, "left")
    hit = F.coalesce("__hit", F.lit(False))
    changed = F.lit(False)
    for v in values:
        changed = changed | ~F.col(v).eqNullSafe(F.col(f"__o_{v}"))
    d = d.withColumn("replaced", hit & changed if only_changed else hit)
    d = d.withColumns({v: F.when(hit, F.col(f"__o_{v}")).otherwise(F.col(v)) for v in values})
    return d.drop("__hit", *[f"__o_{v}" for v in values])


def params_diff(saved: DataFrame, current: DataFrame, ignored: Sequence[str] = (), key: str = "key", saved_only: bool = False) -> DataFrame:
    """Differing settings: key, saved, current, status (``changed`` / ``missing``).

    ``saved_only`` compares the saved keys alone and reports those now missing.
    """
    s = saved.select(key, F.col("value").alias("saved"), F.lit(True).alias("__s"))
    c = current.select(key, F.col("value").alias("current"), F.lit(True).alias("__c"))
    d = s.join(c, key, "left" if saved_only else "full_outer")
    if ignored:
        d = d.where(~F.col(key).isin(list(ignored)))
    diff = ~F.col("saved").eqNullSafe(F.col("current"))
    missing = F.col("__s").isNull() | F.col("__c").isNull()
    keep = (diff | missing) if saved_only else diff
    return d.where(keep).select(key, "saved", "current", F.when(missing, "missing").otherwise("changed").alias("status"))


def pick_stats(candidates: DataFrame, expected: Column | None = None, kind: str = "independent") -> DataFrame:
    """Choose a statistics file per domain from (domain, dir, name) candidates.

    A domain's own folder (``dir = domain``) hides the root folder (``dir = ''``).
    The expected name wins; else quantile before z-score, joint, all, none, t0, t1, name.
    """
    ok = F.col("name").rlike(f"^{kind}_norm_stats_.*_t.*_(quantile|zscore)\\.json$")
    own = F.max((F.col("dir") == F.col("domain")).cast("int")).over(W.partitionBy("domain"))
    d = candidates.withColumn("__own", own).where((F.col("__own") == 0) | (F.col("dir") == F.col("domain")))
    exact = F.lit(False) if expected is None else F.coalesce(F.col("name") == expected, F.lit(False))
    d = d.withColumn("__exact", exact).where(ok | F.col("__exact"))
    n = F.col("name")
    mode = F.when(n.contains("_joint_"), 0).when(n.contains("_all_"), 1).when(n.contains("_none_"), 2).otherwise(3)
    t = F.when(n.contains("_t0_"), 0).when(n.contains("_t1_"), 1).otherwise(2)
    q = F.when(n.endswith("_quantile.json"), 0).otherwise(1)
    rank = F.struct((~F.col("__exact")).cast("int").alias("e"), q.alias("q"), mode.alias("m"), t.alias("t"), n.alias("n"))
    return d.groupBy("domain").agg(F.min_by(F.struct("dir", "name"), rank).alias("p")).select("domain", "p.dir", "p.name")
