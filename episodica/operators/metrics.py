"""Evaluation metrics and monitoring aggregates.

Predictions, truths and masks are flat arrays of ``horizon * dims`` values per
sample.  NULL marks an invalid metric; -1.0 appears only at the edge.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from episodica.functions import rotation as R
from episodica.functions.layout import block_of, block_ranges, dim_label
from episodica.operators.geometry import _gram_schmidt
from episodica.plans.ordered import join_same, number_rows
from episodica.plans.quantiles import exact_quantiles
from episodica.plans.small import keep

APE_FLOOR = 0.001
GROUP = ("domain", "batch_id")


def cells(df: DataFrame, keys: Sequence[str], pred: str, truth: str, mask: str, dims: int) -> DataFrame:
    """Valid cells: keys, t, dim, err, truth."""
    z = F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(truth).alias("g"), F.col(mask).alias("m")))
    d = df.select(*keys, z.alias("__i", "z")).where(F.col("z.m") > 0)
    return d.select(*keys, F.floor(F.col("__i") / dims).alias("t"), (F.col("__i") % dims).cast("bigint").alias("dim"),
                    (F.col("z.p") - F.col("z.g")).alias("err"), F.col("z.g").alias("truth"))


def _trim(d: DataFrame, keys: list[str], value: str, q: float) -> DataFrame:
    """Values outside their [q, 1 - q] quantiles become null; a group of which none is left (of two values, say) stays."""
    if not 0 < q < 0.5:
        return d
    b = exact_quantiles(d, keys, value, {"__lo": q, "__hi": 1 - q})
    inside = (F.col(value) >= F.col("__lo")) & (F.col(value) <= F.col("__hi"))
    return join_same(d, b, keys, "left").withColumn(value, F.when(inside, F.col(value))).drop("__lo", "__hi")


def error_metrics(valid: DataFrame, trim: float = 0.0, keys: Sequence[str] = GROUP) -> DataFrame:
    """RMSE and weighted APE per block and in total, long form (keys, block, name, value).

    APE = sum|err| / sum|truth| over |truth| >= 0.001.  Trimming drops the outer
    quantiles of the squared and of the absolute errors.
    """
    keys = [*keys, "block"]
    d = valid.withColumn("block", F.explode(F.array(block_of(F.col("dim")), F.lit("total"))))
    d = d.withColumn("sq", F.col("err") * F.col("err")).withColumn("ab", F.abs("err")).withColumn("mag", F.abs("truth"))
    if not 0 < trim < 0.5:
        big = F.col("mag") >= APE_FLOOR
        g = d.groupBy(*keys).agg(F.sqrt(F.avg("sq")).alias("rmse"),
                                 (F.sum(F.when(big, F.col("ab"))) / F.sum(F.when(big, F.col("mag")))).alias("ape"))
    else:
        rm = _trim(d, keys, "sq", trim).groupBy(*keys).agg(F.sqrt(F.avg("sq")).alias("rmse"))
        kept = F.when(F.col("ab").isNotNull(), F.col("mag"))
        ap = _trim(d.where(F.col("mag") >= APE_FLOOR), keys, "ab", trim).groupBy(*keys).agg((F.sum("ab") / F.sum(kept)).alias("ape"))
        g = join_same(rm, ap, keys, "left")
    m = F.explode(F.map_from_arrays(F.array(F.lit("rmse"), F.lit("ape")), F.array("rmse", "ape"))).alias("name", "value")
    return g.select(*keys, m)


def jitter(df: DataFrame, pred: str, mask: str, dims: int, keys: Sequence[str] = GROUP) -> DataFrame:
    """RMS of second differences along the chunk where three consecutive steps are valid."""
    p, m = (lambda i: F.get(pred, i)), (lambda i: F.get(mask, i) > 0)
    n = F.size(pred) - 2 * dims
    idx = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    ok = F.filter(idx, lambda i: m(i) & m(i + dims) & m(i + 2 * dims))
    d2 = F.transform(ok, lambda i: p(i + 2 * dims) - 2 * p(i + dims) + p(i))
    d = df.select(*keys, F.aggregate(d2, F.lit(0.0), lambda s, x: s + x * x).alias("s"), F.size(ok).alias("n"))
    return d.groupBy(*keys).agg(F.when(F.sum("n") > 0, F.sqrt(F.sum("s") / F.sum("n"))).alias("jitter"))


def pose_errors(steps: DataFrame, pred: str, truth: str, mask: str, trim: float = 0.0, keys: Sequence[str] = GROUP) -> DataFrame:
    """Mean position error and mean rotation angle (degrees) of 9-value poses.

    A position needs its three mask entries, a rotation its six and finite values.
    """
    keys = list(keys)
    d = steps.withColumn("__a", F.slice(pred, 4, 6)).withColumn("__b", F.slice(truth, 4, 6))
    d = _gram_schmidt(_gram_schmidt(d, "__a", "__ra"), "__b", "__rb")
    tr = R.dot(R.comps("__ra", 9), R.comps("__rb", 9))
    cos = R.fn("greatest", -1.0, R.fn("least", 1.0, (tr - 1.0) / 2.0))
    pos = R.vnorm(R.vsub(R.comps(pred, 3), R.comps(truth, 3)))
    on = lambda a, n: F.forall(F.slice(mask, a, n), lambda x: x > 0)
    fin = F.forall(F.concat("__a", "__b"), lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    d = d.select(*keys, F.when(on(1, 3), F.expr(pos)).alias("pos"), F.when(on(4, 6) & fin, F.degrees(F.expr(R.fn("acos", cos)))).alias("rot"))
    names = {"pos": "position_error", "rot": "rotation_error_deg"}
    if not 0 < trim < 0.5:
        g = d.groupBy(*keys).agg(*[F.avg(c).alias(n) for c, n in names.items()])
    else:
        # quantiles read the errors several times; a written table also keeps the
        # geometry out of pushed-down filters
        d = keep(d, "pose-errors")
        pos, rot = [_trim(d.where(F.col(c).isNotNull()), keys, c, trim).groupBy(*keys).agg(F.avg(c).alias(n)) for c, n in names.items()]
        g = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).drop("__n")
        g = join_same(join_same(g, pos, keys, "left"), rot, keys, "left")
    return g


def at_edge(value: Column) -> Column:
    """NULL (invalid) -> -1.0."""
    return F.coalesce(value, F.lit(-1.0))


def metric_rollup(metrics: DataFrame) -> DataFrame:
    """Mean over batches of (domain, name, value), per domain and in total; invalid values are ignored."""
    v = F.when(F.col("value") >= 0, F.col("value"))
    g = metrics.groupingSets([["name"], ["domain", "name"]], "domain", "name").agg(F.avg(v).alias("value"), F.count(v).alias("n_batches"),
                                                                                     F.grouping("domain").alias("is_total"))
    return g.select("domain", "name", "value", "n_batches", (F.col("is_total") == 1).alias("is_total"))


def loss_window(events: DataFrame, every: int, known: Sequence | None = None) -> DataFrame:
    """Mean, max and count of the loss per window of steps and domain, and the window mean.

    Unlisted or missing domains fall into ``unknown``; empty pairs do not appear.
    """
    dom = F.coalesce(F.col("domain").cast("string"), F.lit("unknown"))
    if known is not None:
        dom = F.when(dom.isin([str(k) for k in known]), dom).otherwise(F.lit("unknown"))
    d = events.select(F.floor(F.col("step") / every).alias("window"), dom.alias("domain"), "loss")
    g = d.groupBy("window", "domain").agg(F.sum("loss").alias("s"), F.max("loss").alias("max_loss"), F.count("loss").alias("n"))
    allw = g.groupBy("window").agg((F.sum("s") / F.sum("n")).alias("window_mean"))
    return g.join(allw, "window").select("window", "domain", (F.col("s") / F.col("n")).alias("mean_loss"), "max_loss", "n", "window_mean")


def block_presence(mask: Column, dims: int) -> dict[str, Column]:
    """Per block: does any cell of the flat mask count?"""
    return {name: _any_in(mask, dims, lo, hi) for name, lo, hi in block_ranges() if lo < dims}


def _any_in(mask: Column, dims: int, lo: int, hi: int) -> Column:
    return F.coalesce(F.array_max(F.transform(mask, lambda m, i: (m > 0) & (i % dims >= lo) & (i % dims < hi))), F.lit(False))


def group_presence(samples: DataFrame, mask: str, dims: int) -> DataFrame:
    """(block, n): samples with any valid cell in the block."""
    p = block_presence(F.col(mask), dims)
    flags = samples.select(F.map_from_arrays(F.array(*[F.lit(b) for b in p]), F.array(*[c.cast("int") for c in p.values()])).alias("m"))
    return flags.select(F.explode("m").alias("block", "x")).groupBy("block").agg(F.sum("x").alias("n"))


def group_frequency(samples: DataFrame, mask: str, dims: int, order: str) -> DataFrame:
    """Presence of each block by domain, judged on the domain's first sample.

    Returns (domain, block, present, n_samples, count, frequency) rows and the
    totals over all domains with ``domain = NULL``.
    """
    d = samples.groupBy("domain").agg(F.min_by(mask, order).alias("__m"), F.count(F.lit(1)).alias("n_samples"))
    p = block_presence(F.col("__m"), dims)
    d = d.withColumn("e", F.explode(F.array(*[F.struct(F.lit(b).alias("block"), c.cast("int").alias("present")) for b, c in p.items()])))
    d = d.select("domain", "e.block", "e.present", "n_samples", (F.col("e.present") * F.col("n_samples")).alias("count"))
    g = d.groupingSets([["domain", "block"], ["block"]], "domain", "block").agg(
        F.max("present").alias("present"), F.sum("n_samples").alias("n_samples"), F.sum("count").alias("count"))
    return g.withColumn("frequency", F.col("count") / F.col("n_samples"))


def group_weights(freq: DataFrame, gamma: float, eps: float, lo: float, hi: float, normalize: bool = True) -> DataFrame:
    """Loss weight per block: clip((geometric mean / (f + eps)) ^ gamma), mean 1 over seen blocks; unseen = 1."""
    f = F.col("frequency")
    seen = f > 0
    ref = freq.agg(F.exp(F.avg(F.when(seen, F.log(f)))).alias("r")).scalar()
    w = F.greatest(F.lit(float(lo)), F.least(F.lit(float(hi)), F.pow(ref / (f + eps), F.lit(float(gamma)))))
    d = freq.withColumn("weight", F.when(seen, w).otherwise(F.lit(1.0)))
    if normalize:
        mean = d.agg(F.avg(F.when(seen, F.col("weight"))).alias("m")).scalar()
        d = d.withColumn("weight", F.when(seen, F.col("weight") / mean).otherwise(F.lit(1.0)))
    return d


def balanced_loss(cells_: DataFrame, weights: DataFrame, sample: str = "sample_id") -> DataFrame:
    """One row: block-balanced loss of (sample, block, loss, mask) cells.

    Masked mean per sample and block, weighted mean over valid blocks (divisor at
    least 1), mean over samples with any valid block.
    """
    b = cells_.groupBy(sample, "block").agg(F.sum(F.col("loss") * F.col("mask")).alias("l"), F.sum("mask").alias("m"))
    b = b.where("m > 0").withColumn("l", F.col("l") / F.greatest(F.col("m"), F.lit(1.0)))
    b = b.join(weights.select("block", "weight"), "block")
    s = b.groupBy(sample).agg(F.sum(F.col("weight") * F.col("l")).alias("num"), F.sum("weight").alias("den"))
    s = s.where("den > 0").withColumn("ls", F.col("num") / F.greatest(F.col("den"), F.lit(1.0)))
    return s.agg((F.coalesce(F.sum("ls"), F.lit(0.0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("loss"), F.count(F.lit(1)).alias("n_samples"))


def curve_rows(df: DataFrame, pred: str, truth: str, mask: str, dims: int, n: int | None = None, batch: str = "batch_id", order: str = "sample_id") -> DataFrame:
    """Curves on dims valid at least once: (batch, sample, label, t, truth, prediction).

    All samples, or only the first ``n`` of every batch.
    """
    d = df if n is None else number_rows(df, [batch], [order], None, "__r").where(F.col("__r") < n)
    z = F.posexplode(F.arrays_zip(F.col(pred).alias("p"), F.col(truth).alias("g")))
    used = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda k: F.exists(
        F.transform(F.sequence(F.lit(0), F.floor(F.size(mask) / dims).cast("int") - 1), lambda t: F.get(mask, t * dims + k) > 0), lambda x: x))
    d = d.withColumn("__u", used)
    d = d.select(batch, order, "__u", z.alias("__i", "z")).withColumn("dim", (F.col("__i") % dims).cast("int"))
    d = d.where(F.get("__u", F.col("dim")))
    return d.select(batch, order, F.col("dim").cast("bigint").alias("dim"), dim_label(F.col("dim")).alias("label"),
                    F.floor(F.col("__i") / dims).alias("t"), F.col("z.g").alias("truth"), F.col("z.p").alias("prediction"))
