"""Connected components of a distributed graph, and a bounded row filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from episodica.plans.small import few, forget, keep

#: bits of the row filter; its table has at most FILTER_BITS / 64 rows
FILTER_BITS = 1 << 22


def components(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b); comp is the smallest node reached.

    ``rows`` is the number of edges, if known: few edges then take few tasks.

    Each step takes the smallest label among a node and its neighbours and then
    follows labels to the label's own label, so long chains shorten quickly.
    Labels are written out every step; nothing but a count reaches the driver.
    """
    rows = 2 * (edges.count() if rows is None else rows)
    both = keep(few(edges.select("a", "b").union(edges.select("b", "a")).distinct(), rows), "cc-edges")
    labels = keep(few(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("comp")), rows), "cc-labels")
    kept = labels
    while True:
        seen = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        step = labels.join(seen, "node").select("node", "comp", F.least("comp", "near").alias("new"))
        jump = step.select(F.col("node").alias("new"), F.col("new").alias("far"))
        # a label is itself a node with a label
        step = step.join(jump, "new", "left").select("node", F.col("comp").alias("old"), F.least("new", F.coalesce("far", "new")).alias("comp"))
        step = keep(few(step, rows), "cc-labels")
        forget(kept)
        kept, labels = step, step.select("node", "comp")
        if step.where("old != comp").isEmpty():
            forget(both)
            return labels


def _bucket(key: str):
    h = F.pmod(F.xxhash64(F.lit(11), key), F.lit(FILTER_BITS))
    return F.floor(h / 64).cast("int"), F.pmod(h, F.lit(64)).cast("int")


def maybe_among(df: DataFrame, key: str, keys: DataFrame, negate: bool = False) -> DataFrame:
    """Rows of ``df`` whose ``key`` may be in ``keys`` (or, negated, surely is not).

    A bit table of fixed size is broadcast, so wide rows that are not wanted need
    no shuffle; the caller joins the rest exactly.
    """
    word, bit = _bucket(keys.columns[0])
    one = F.expr("shiftleft(1L, __bit)")
    table = keys.select(word.alias("__word"), bit.alias("__bit")).groupBy("__word").agg(F.bit_or(one).alias("__bits"))
    names = df.columns
    word, bit = _bucket(key)
    d = df.withColumns({"__w": word, "__bit": bit}).join(F.broadcast(table), F.col("__w") == F.col("__word"), "left")
    hit = F.coalesce(F.col("__bits").bitwiseAND(one) != 0, F.lit(False))
    return d.where(~hit if negate else hit).select(*names)
