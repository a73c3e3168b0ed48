"""Exact linear-interpolated quantiles without holding a group in one task.

Values fall into fixed logarithmic bins (monotone in the value, no data pass
needed to place them).  Counts per bin are pre-aggregated map-side, the bins
that contain the wanted ranks are found on the counts, and only values of those
bins are ordered, after equal values are merged.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from episodica.plans.ordered import join_same
from episodica.plans.small import lookup

#: rows a final bin may hold before it is refined once more
REFINE_ROWS = 2_000_000


def is_finite(v: Column) -> Column:
    """False for null, NaN and infinities."""
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf")))


def log_bin(v: Column, per_octave: int) -> Column:
    """Monotone bin id of a finite double."""
    mag = F.floor(F.log2(F.abs(v)) * F.lit(float(per_octave))) + F.lit(1100 * per_octave)
    return F.when(v == 0, F.lit(0).cast("long")).when(v > 0, mag).otherwise(-mag)


def _ranks(n: Column, q: float) -> tuple[Column, Column, Column]:
    pos = (n - F.lit(1)).cast("double") * F.lit(float(q))
    return F.floor(pos), F.ceil(pos), pos - F.floor(pos)


def _target_bins(binned: DataFrame, keys: list[str], qs: Sequence[float], carried: bool) -> DataFrame:
    """Bins holding a wanted rank: keys, n, __before (values below the bin), __bin, __cnt."""
    extra = ["__n", "__start"] if carried else []
    group = [*keys, *extra, "__bin"] if not carried else [*keys, "__outer", *extra, "__bin"]
    hist = binned.groupBy(*group).agg(F.sum("__w").alias("__cnt"))
    part = [*keys, "__outer"] if carried else keys
    wk = W.partitionBy(*part)
    run = F.sum("__cnt").over(wk.orderBy("__bin").rowsBetween(W.unboundedPreceding, 0)) - F.col("__cnt")
    if carried:
        hist = hist.withColumn("__before", run + F.col("__start"))
    else:
        hist = hist.withColumn("__before", run).withColumn("__n", F.sum("__cnt").over(wk))
    hit = F.lit(False)
    for q in qs:
        lo, hi, _ = _ranks(F.col("__n"), q)
        for r in (lo, hi):
            hit = hit | ((r >= F.col("__before")) & (r < F.col("__before") + F.col("__cnt")))
    return hist.where(hit).select(*keys, "__bin", "__n", "__before", "__cnt")


def exact_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, qs: dict[str, float], per_octave: int = 64, weight: str | None = None
) -> DataFrame:
    """Quantiles per ``keys`` of the finite values; one column per name in ``qs``.

    Null, NaN and infinite values have no rank and are passed over.  A ``weight`` column
    (whole numbers) says how often a value counts, as if its row stood there so often.
    """
    keys = list(keys)
    probs = list(qs.values())
    v = F.col(value).cast("double")
    times = F.lit(1).cast("long") if weight is None else F.col(weight).cast("long")
    d = df.where(is_finite(v)).select(*keys, v.alias("__v"), times.alias("__w"))
    d = d if weight is None else d.where("__w > 0")
    nk = []
    for i, k in enumerate(keys):  # null-safe group keys
        nk.append(F.col(k).eqNullSafe(F.col(f"__k{i}")))

    def attach(bins: DataFrame, rows: DataFrame) -> DataFrame:
        b = bins.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)],
                        *[c for c in bins.columns if c not in keys])
        cond = F.col("__b") == F.col("__bin")
        for c in nk:
            cond = cond & c
        return rows.join(b, cond).drop("__b", *[f"__k{i}" for i in range(len(keys))])

    t = lookup(_target_bins(d.withColumn("__bin", log_bin(F.col("__v"), per_octave)), keys, probs, False))
    rows = attach(t, d.withColumn("__b", log_bin(F.col("__v"), per_octave)))
    big = t.agg(F.max("__cnt")).first()[0]
    if big is not None and big > REFINE_ROWS:
        fine = per_octave * 65_536
        sub = rows.withColumnRenamed("__bin", "__outer").withColumnRenamed("__before", "__start")
        sub = sub.withColumn("__bin", log_bin(F.col("__v"), fine)).drop("__cnt")
        t = lookup(_target_bins(sub, keys, probs, True))
        rows = attach(t, d.withColumn("__b", log_bin(F.col("__v"), fine)))
    vals = rows.groupBy(*keys, "__bin", "__n", "__before", "__v").agg(F.sum("__w").alias("__m"))
    w = W.partitionBy(*keys, "__bin").orderBy("__v").rowsBetween(W.unboundedPreceding, 0)
    vals = vals.withColumn("__hi", F.sum("__m").over(w) + F.col("__before")).withColumn(
        "__lo", F.col("__hi") - F.col("__m")
    )
    aggs = [F.max("__n").alias("__n")]
    for i, q in enumerate(probs):
        lo, hi, _ = _ranks(F.col("__n"), q)
        for tag, r in (("a", lo), ("b", hi)):
            aggs.append(F.max(F.when((r >= F.col("__lo")) & (r < F.col("__hi")), F.col("__v"))).alias(f"__{tag}{i}"))
    out = vals.groupBy(*keys).agg(*aggs)
    cols = []
    for i, (name, q) in enumerate(qs.items()):
        frac = _ranks(F.col("__n"), q)[2]
        a, b = F.col(f"__a{i}"), F.col(f"__b{i}")
        cols.append((a + (b - a) * frac).alias(name))
    return out.select(*keys, *cols)


# ------------------------------------------------------ one histogram, several questions
def value_bins(rows: DataFrame, keys: Sequence[str], value: str, bin_col: str) -> DataFrame:
    """The cumulative histogram of binned rows: keys, bin, cnt, lo, hi (extreme values) and before (values below the bin).

    Rows of a null bin are counted in one entry of their own, which comes first and
    is not counted in ``before``.
    """
    keys = list(keys)
    h = rows.groupBy(*keys, F.col(bin_col).alias("bin")).agg(
        F.count(F.lit(1)).alias("cnt"), F.min(value).alias("lo"), F.max(value).alias("hi")
    )
    ranked = F.when(F.col("bin").isNotNull(), F.col("cnt")).otherwise(F.lit(0))
    w = W.partitionBy(*keys).orderBy(F.col("bin").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    return h.withColumn("before", F.sum(ranked).over(w) - ranked)


def values_at(rows: DataFrame, hist: DataFrame, keys: Sequence[str], value: str, bin_col: str, ranks: DataFrame, names: Sequence[str]) -> DataFrame:
    """For every 0-based rank in the columns ``names`` of ``ranks``: its value and ``upto_<name>``, how many values are not above it.

    A bin that holds one value answers by itself; rows are read in the other bins hit,
    where equal values are merged before they are ordered.
    """
    keys = list(keys)
    listed = hist.where(F.col("bin").isNotNull())
    wanted = [F.struct(F.lit(n).alias("name"), F.col(n).alias("rank")) for n in names]
    asked = ranks.select(*keys, F.explode(F.array(*wanted)).alias("__q")).select(*keys, "__q.*").where(F.col("rank").isNotNull())
    hit = join_same(listed, asked, keys).where((F.col("rank") >= F.col("before")) & (F.col("rank") < F.col("before") + F.col("cnt")))
    hit = lookup(hit)
    known = hit.where("lo = hi").select(*keys, "name", F.col("lo").alias("v"), (F.col("before") + F.col("cnt")).alias("upto"))
    bins = hit.where("lo < hi").select(*keys, "bin", "before").distinct()
    # no larger than the hits, whose size has been checked; Spark plans the join by what they are
    inside = join_same(rows.select(*keys, F.col(bin_col).alias("bin"), F.col(value).alias("v")), bins, [*keys, "bin"])
    each = inside.groupBy(*keys, "bin", "before", "v").agg(F.count(F.lit(1)).alias("m"))
    w = W.partitionBy(*keys, "bin").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    each = each.withColumn("upto", F.sum("m").over(w) + F.col("before")).withColumn("from", F.col("upto") - F.col("m")).drop("before", "m")
    named = hit.where("lo < hi").select(*keys, "bin", "name", "rank")
    read = join_same(each, named, [*keys, "bin"]).where((F.col("rank") >= F.col("from")) & (F.col("rank") < F.col("upto")))
    both = known.unionByName(read.select(*keys, "name", "v", "upto"))
    aggs = [a for n in names for a in (F.max(F.when(F.col("name") == n, F.col("v"))).alias(n), F.max(F.when(F.col("name") == n, F.col("upto"))).alias(f"upto_{n}"))]
    return both.groupBy(*keys).agg(*aggs)


def deviations_at(rows: DataFrame, pool: DataFrame, keys: Sequence[str], value: str, bin_col: str, q: float) -> DataFrame:
    """Quantile ``q`` of ``|value - centre|`` as column ``dev``.

    ``pool`` is the histogram of the values that count, with their ``centre``, the
    ``top`` above which a value does not count and ``n``, how many do.  Two cursors
    move outward from the centre: by the farthest deviation of the bins the wanted rank
    is reached at the latest, by their nearest one at the earliest.  Bins wholly nearer
    are counted; rows are read in the bins between only.
    """
    keys = list(keys)
    a, b = F.abs(F.col("lo") - F.col("centre")), F.abs(F.col("hi") - F.col("centre"))
    over = (F.col("lo") <= F.col("centre")) & (F.col("centre") <= F.col("hi"))
    low, high, frac = _ranks(F.col("n"), q)
    d = pool.withColumn("far", F.greatest(a, b)).withColumn("near", F.when(over, F.lit(0.0)).otherwise(F.least(a, b)))
    group = W.partitionBy(*keys)
    d = d.withColumn("__f", F.sum("cnt").over(group.orderBy("far"))).withColumn("__n", F.sum("cnt").over(group.orderBy("near")))
    d = d.withColumn("__latest", F.min(F.when(F.col("__f") > high, F.col("far"))).over(group))
    d = d.withColumn("__soonest", F.min(F.when(F.col("__n") > low, F.col("near"))).over(group))
    d = d.withColumn("before", F.sum(F.when(F.col("far") < F.col("__soonest"), F.col("cnt")).otherwise(F.lit(0))).over(group))
    hit = d.where((F.col("far") >= F.col("__soonest")) & (F.col("near") <= F.col("__latest")))
    hit = lookup(hit.select(*keys, "bin", "centre", "top", "n", "before"))
    inside = join_same(rows.select(*keys, F.col(bin_col).alias("bin"), F.col(value).alias("v")), hit, [*keys, "bin"]).where(F.col("v") <= F.col("top"))
    each = inside.groupBy(*keys, "n", "before", F.abs(F.col("v") - F.col("centre")).alias("x")).agg(F.count(F.lit(1)).alias("m"))
    each = each.withColumn("upto", F.sum("m").over(group.orderBy("x")) + F.col("before")).withColumn("from", F.col("upto") - F.col("m"))
    pick = lambda r: F.max(F.when((r >= F.col("from")) & (r < F.col("upto")), F.col("x")))
    out = each.groupBy(*keys).agg(pick(low).alias("__a"), pick(high).alias("__b"), F.max("n").alias("n"))
    return out.select(*keys, (F.col("__a") + (F.col("__b") - F.col("__a")) * frac).alias("dev"))
