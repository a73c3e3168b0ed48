"""Mixing sources to target weights by entropy balancing.

Every document gets a rate, the expected number of its copies in the mix.  Among
all rates in (0, cap] that meet the word target of each source, the ones closest
to 1 in relative entropy are exponentially tilted in the constrained quantity,

    rate = min(cap, exp(lam * size / unit)),

with one multiplier per source (``unit``, the word-weighted mean size, only
scales it).  ``lam`` solves the convex dual of that problem, here by safeguarded
Newton steps for all sources at once: a step is one aggregation over the exact
histogram (source, size, documents), so it never touches the texts again.

Rates become copies by weighted sampling without replacement: every document
gets the whole part of its rate, and the fractional parts are granted in the
order of hash / fraction until the words still missing in the source are
reached; documents next to that limit fill the gap that is left.  All of it
is expressed per source, so documents meet only a table of one row per source.

DataFrame functions only; no Python on the executors.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window as W, functions as F

from episodica.llm.common import hash_unit, n_words, require
from episodica.plans.small import keep

#: rows per bin of the sampling order
BIN_ROWS = 16_384

#: relative error at which the Newton steps end, and their largest number
TOLERANCE = 1e-10
STEPS = 60


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """Targets of the sources in ``sizes`` (source, source_size): columns sid, source, source_size, target.

    Sources in code-point order, null last, take the weights in turn and share
    the sum of all sizes by weight; no target exceeds ``cap`` times its source, and
    the excess goes to the others by weight.  A source of size 0 has target 0.
    """
    # ordered by range, numbered by partition and offset: no global sort in one task
    parts = max(1, sizes.sparkSession.sparkContext.defaultParallelism)
    key = [F.col("source").asc_nulls_last()]
    s = keep(sizes.repartitionByRange(parts, *key).withColumn("__p", F.spark_partition_id()), "mix-sources")
    before = F.sum("__n").over(W.orderBy("__p").rowsBetween(W.unboundedPreceding, -1))
    offset = s.groupBy("__p").agg(F.count(F.lit(1)).alias("__n")).select("__p", F.coalesce(before, F.lit(0)).alias("__off"))
    n = len(weights)
    rank = F.row_number().over(W.partitionBy("__p").orderBy(*key)) - 1 + F.col("__off")
    s = s.join(F.broadcast(offset), "__p").select(rank.alias("sid"), "source", "source_size")  # one row per range
    turn = F.pmod(F.col("sid"), F.lit(n)).cast("int")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn + 1)
    s = keep(s.select(F.col("sid").cast("long"), "source", "source_size", weight.alias("w")), "mix-ranked")

    limit = F.lit(float(cap)) * F.col("source_size")
    level, seen = 0.0, -1
    while True:
        full = limit <= F.lit(level) * F.col("w")
        row = s.agg(
            F.sum("source_size"), F.count(F.when(full, 1)), F.sum(F.when(full, limit)), F.sum(F.when(~full, F.col("w")))
        ).first()
        total, capped, taken, free = float(row[0] or 0), row[1], row[2] or 0.0, row[3] or 0.0
        if capped == seen or not free or not total:
            break
        level, seen = (total - taken) / free, capped
    return s.select("sid", "source", "source_size", F.least(limit, F.lit(level) * F.col("w")).alias("target"))


def _rate(cap: float):
    """Rounded, so that a rate is the same number wherever it is computed again."""
    return F.round(F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * F.col("size") / F.col("unit"), F.lit(50.0)))), 9)


def solve_rates(hist: DataFrame, sources: DataFrame, cap: float) -> DataFrame:
    """``sources`` with the multiplier ``lam`` and ``unit`` of each.

    ``hist`` has sid, size and n.  Sources at their cap get an unbounded
    multiplier (every rate is the cap); empty sources get 0.
    """
    unit = hist.groupBy("sid").agg((F.sum(F.col("n") * F.col("size") * F.col("size")) / F.sum(F.col("n") * F.col("size"))).alias("unit"))
    inf = F.lit(float("inf"))
    at_cap = F.col("target") >= F.col("source_size") * F.lit(cap * (1 - 1e-12))
    empty = (F.col("source_size") <= 0) | (F.col("target") <= 0)
    state = sources.join(unit, "sid", "left").select(
        "sid", "source", "source_size", "target",
        F.coalesce(F.col("unit"), F.lit(1.0)).alias("unit"),
        F.when(empty, 0.0).when(at_cap, inf).otherwise(F.log(F.col("target") / F.col("source_size"))).alias("lam"),
        (-inf).alias("lo"), inf.alias("hi"), (empty | at_cap).alias("done"),
    )
    state = keep(state, "mix-state")
    carried = ["source", "source_size", "target", "unit", "lam", "lo", "hi", "done"]
    for step_no in range(STEPS + 1):
        if state.where(~F.col("done")).isEmpty():
            break
        if step_no == STEPS:
            # bisection halves the bracket in every step that Newton does not shorten more
            open_ = [r["source"] for r in state.where(~F.col("done")).select("source").limit(5).collect()]
            raise RuntimeError(f"no rate found for sources {open_} in {STEPS} steps")
        x = F.col("size") / F.col("unit")
        r = F.least(F.lit(float(cap)), F.exp(F.least(F.col("lam") * x, F.lit(50.0))))
        inside = F.col("lam") * x < F.lit(math.log(cap))
        step = (
            state.join(hist, "sid", "left").groupBy("sid")
            .agg(
                *[F.first(c).alias(c) for c in carried],
                F.sum(F.col("n") * F.col("size") * r).alias("f"),
                F.sum(F.when(inside, F.col("n") * F.col("size") * x * r)).alias("df"),
            )
        )
        gap = F.col("f") - F.col("target")
        lo = F.when(gap < 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(gap > 0, F.col("lam")).otherwise(F.col("hi"))
        step = step.withColumns({"gap": gap, "lo2": lo, "hi2": hi}).withColumn("newton", F.col("lam") - F.col("gap") / F.col("df"))
        unbound = F.abs("lo2").isin(float("inf")) | F.abs("hi2").isin(float("inf"))
        safe = F.when(~unbound, (F.col("lo2") + F.col("hi2")) / 2).otherwise(
            F.when(F.col("gap") < 0, F.abs("lam") * 2 + 1).otherwise(-F.abs("lam") * 2 - 1)
        )
        good = F.col("newton").isNotNull() & ~F.isnan("newton") & (F.col("newton") > F.col("lo2")) & (F.col("newton") < F.col("hi2"))
        ended = F.col("done") | (F.abs("gap") <= F.lit(TOLERANCE) * F.col("target"))
        state = keep(
            step.select(
                "sid", "source", "source_size", "target", "unit",
                F.when(ended, F.col("lam")).when(good, F.col("newton")).otherwise(safe).alias("lam"),
                F.col("lo2").alias("lo"), F.col("hi2").alias("hi"), ended.alias("done"),
            ),
            "mix-state",
        )
    return state.select("sid", "source", "source_size", "target", "unit", "lam")


def mix_copies(
    docs: DataFrame,
    weights: tuple[float, ...] = (5.0, 2.0, 1.0),
    cap: float = 3.0,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """``docs`` with size, source_size, target, rate and copies added.

    Null and empty texts have size 0 and no copies.  A null source is a source
    of its own.  Rows that agree in id and size agree in copies, so rows repeated
    in great number can miss the target by their own size.  Columns of the added
    names are replaced; no rows give no rows.
    """
    require(docs, id_col, text_col, source_col)
    spark = docs.sparkSession
    digest = keep(
        docs.select(F.col(source_col).alias("source"), F.col(id_col).alias("__id"), n_words(text_col).alias("size")), "mix-digest"
    )
    sources = source_targets(digest.groupBy("source").agg(F.sum("size").alias("source_size")), weights, cap)
    sources = keep(sources, "mix-targets")
    hist = digest.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n"))
    same = F.col("h.source").eqNullSafe(F.col("s.source"))
    hist = keep(hist.alias("h").join(sources.alias("s"), same).select("s.sid", "h.size", "h.n").where("size > 0"), "mix-sizes")
    solved = solve_rates(hist, sources, cap)

    # -- rounding: the limit of the sampling order in each source
    ranked = _ordered(digest.alias("h").join(solved.alias("s"), same).select("h.__id", "h.size", "s.*"), cap)
    bins = max(1, -(-digest.count() // BIN_ROWS))
    ranked = ranked.withColumn("bin", F.floor(F.least(F.col("order"), F.lit(4.0)) * bins))
    whole = ranked.groupBy("sid").agg(F.sum(F.col("base") * F.col("size")).alias("whole"))
    missing = solved.join(whole, "sid", "left").select("sid", (F.col("target") - F.coalesce(F.col("whole"), F.lit(0))).alias("missing"))
    per_bin = ranked.where("order is not null").groupBy("sid", "bin").agg(F.sum("size").alias("words"))
    upto = F.sum("words").over(W.partitionBy("sid").orderBy("bin"))
    per_bin = per_bin.withColumn("upto", upto).join(missing, "sid")
    # the first bin that passes the limit
    cross = (
        per_bin.where(F.col("upto") > F.col("missing")).groupBy("sid")
        .agg(F.min("bin").alias("cross"), F.min_by(F.col("missing") - (F.col("upto") - F.col("words")), "bin").alias("rest"))
    )
    # documents of that bin and the next only; equal ones stand or fall together
    edge = (
        ranked.where("order is not null").join(cross, "sid").where("bin in (cross, cross + 1)")
        .groupBy("sid", "order", "__id", "size").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
    )
    run = F.sum("words").over(W.partitionBy("sid").orderBy("order", "size"))
    edge = keep(edge.withColumn("run", run), "mix-edge")
    last = edge.where(F.col("run") <= F.col("rest")).groupBy("sid").agg(F.max("order").alias("limit"), F.max("run").alias("run"))
    last = cross.join(last, "sid", "left").select(
        "sid", F.coalesce(F.col("limit"), F.col("cross") / F.lit(bins) - F.lit(1e-12)).alias("limit"),
        (F.col("rest") - F.coalesce(F.col("run"), F.lit(0))).alias("gap"),
    )
    # what is missing after the limit is filled by the documents there that come nearest to it
    fill = None
    for _ in range(3):
        last = keep(last if fill is None else last.join(fill, "sid", "left").select(
            "sid", "limit", (F.col("gap") - F.coalesce(F.col("words"), F.lit(0))).alias("gap"),
            F.when(F.col("more").isNull(), F.col("extra")).otherwise(F.concat("extra", F.array("more"))).alias("extra"),
        ), "mix-limit")
        if "extra" not in last.columns:
            last = last.withColumn("extra", F.expr("cast(array() as array<double>)"))
        fits = edge.select("sid", "order", "words").join(last, "sid").where(
            (F.col("order") > F.col("limit")) & (F.col("words") < 2 * F.col("gap")) & ~F.array_contains("extra", F.col("order"))
        )
        best = F.min(F.struct(F.abs(F.col("gap") - F.col("words")).alias("off"), "words", "order"))
        fill = fits.groupBy("sid").agg(best.alias("b")).select("sid", F.col("b.words").alias("words"), F.col("b.order").alias("more"))
    limits = solved.join(last.select("sid", "limit", "extra"), "sid", "left")
    limits = keep(limits, "mix-limits")

    added = ["size", "source_size", "target", "rate", "copies"]
    names = [c for c in docs.columns if c not in added]
    d = docs.select(F.struct(*names).alias("d"), F.col(id_col).alias("__id"), F.col(source_col).alias("source"), n_words(text_col).alias("size"))
    d = _ordered(d.alias("h").join(limits.alias("s"), same).select("h.d", "h.__id", "h.size", "s.*"), cap)
    granted = F.coalesce((F.col("order") <= F.col("limit")) | F.array_contains("extra", F.col("order")), F.lit(False))
    # without a bin that passes the limit, all fractions are needed
    granted = granted | (F.col("limit").isNull() & F.col("order").isNotNull())
    copies = F.when(F.col("size") > 0, F.col("base") + granted.cast("long")).otherwise(0).cast("long")
    return d.select("d.*", "size", "source_size", "target", "rate", copies.alias("copies"))


def _ordered(d: DataFrame, cap: float) -> DataFrame:
    """Adds rate, base (whole copies) and order (the sampling order, null without a fraction)."""
    d = d.withColumn("rate", F.when(F.col("size") > 0, _rate(cap)).otherwise(0.0))
    d = d.withColumn("base", F.floor("rate"))
    frac = F.round(F.col("rate") - F.col("base"), 9)
    return d.withColumn("order", F.when(frac > 0, hash_unit("__id", "size") / frac))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), cap: float = 3.0) -> DataFrame:
    """The mix itself: every document as often as it has copies, with the columns of ``docs``."""
    d = mix_copies(docs.select(F.struct(*docs.columns).alias("__d"), *[F.col(c) for c in ("doc_id", "text", "source")]), weights, cap)
    d = d.where("copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return d.select("__d.*")
