"""Merkle manifest of a dataset: a tree for each source, joined by one over the sources.

``H`` is the lowercase hex sha256 of its inputs joined, with digests as hex text.  A
leaf is H of a row's fields, each ``-`` if null, else its UTF-8 byte count, ``:`` and
its value.  In every source the leaves ascend by id; every three neighbours (the last
run may be shorter) become their H until one node is left, and the sources' nodes, in
order of the source, become the root in the same way.

A level is never a table of nodes.  Places are cut into aligned blocks of 3^HEIGHT
nodes, and a row holds a block whose levels are hex strings of 64 characters a node:
a parent is the hash of a substring of fixed width, a node's siblings are the
substrings at its sides, so nothing is joined inside a block.  The roots of the blocks
are the leaves of the next round, until every group fits in one block; what a round
finds out (siblings up to its roots) meets the round below by one row per block.

Sources may hold any share of the rows: places come from a range partitioning by
source and id plus one offset for each pair of partition and source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from episodica.llm.common import require
from episodica.plans.ordered import join_same
from episodica.plans.small import keep, lookup

#: levels in a block, which has 3^HEIGHT nodes at most
HEIGHT = 5
ARITY = 3

#: rows that one partition orders
RANGE_ROWS = 50_000

#: characters of a digest
HEX = 64

SIBLINGS = "array<struct<left:string,right:string>>"


def sha(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf_hash(fields: list[Column]) -> Column:
    """H of the fields of a row."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.when(f.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return sha(F.concat(*parts))


def places(nodes: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """``nodes`` with pos, the 0-based place in its group, and n, the size of the group.

    Rows are dealt into ranges of ``keys`` and ``order`` (and where they stand in the
    table, so equal rows spread too) and numbered where they lie; an offset for each
    pair of range and group makes the numbers places.  Equal rows are interchangeable.
    """
    parts = max(1, -(-nodes.count() // RANGE_ROWS))
    by = [*[F.col(k).asc_nulls_first() for k in keys], *order, F.col("__row").asc()]
    d = nodes.withColumn("__row", F.monotonically_increasing_id())
    d = d.repartitionByRange(parts, *by).sortWithinPartitions(*by).drop("__row")
    # the high bits name the range, the low ones count its rows
    d = keep(d.withColumn("__at", F.monotonically_increasing_id()), "merkle-order")
    d = d.withColumn("__part", F.shiftright("__at", 33))
    sizes = d.groupBy(*keys, "__part").agg(F.min("__at").alias("__first"), F.count(F.lit(1)).alias("__n"))
    group = W.partitionBy(*keys)
    before = F.sum("__n").over(group.orderBy("__part")) - F.col("__n")
    offs = sizes.select(*keys, "__part", F.sum("__n").over(group).alias("n"), (before - F.col("__first")).alias("__off"))
    d = join_same(d, lookup(offs), [*keys, "__part"])
    return d.withColumn("pos", F.col("__at") + F.col("__off")).drop("__at", "__part", "__off")


def _height(n: Column) -> Column:
    """Levels above ``n`` nodes until one is left."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        F.struct(n.cast("long").alias("n"), F.lit(0).alias("h")),
        lambda acc, _: F.struct(F.ceil(acc["n"] / ARITY).cast("long").alias("n"), (acc["h"] + (acc["n"] > 1).cast("int")).alias("h")),
        lambda acc: acc["h"],
    )


def _parents(level: Column) -> Column:
    """The next level: each substring of three digests becomes its hash."""
    runs = F.ceil(F.octet_length(level) / F.lit(ARITY * HEX)).cast("int")
    hashes = F.transform(F.sequence(F.lit(0), runs - 1), lambda i: F.sha2(F.substring(level, i * (ARITY * HEX) + 1, F.lit(ARITY * HEX)), 256))
    return F.array_join(hashes, "").cast("binary")


def _beside(level: Column, at: Column) -> Column:
    """What flanks the node ``at`` in its run: (left, right)."""
    inside = F.pmod(at, F.lit(ARITY)).cast("int")
    start = ((at - inside) * HEX + 1).cast("int")
    left = F.substring(level, start, inside * HEX)
    right = F.substring(level, (start + (inside + 1) * HEX).cast("int"), (F.lit(ARITY - 1) - inside) * HEX)
    return F.struct(left.cast("string").alias("left"), right.cast("string").alias("right"))


def _blocks(nodes: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """One row per block: keys, block, members (in place order), levels l0 .. lHEIGHT, height, top.

    ``nodes`` has keys, pos, n, node and the columns ``carry``.  A group that fits in
    one block stops at its last node; others rise HEIGHT levels.
    """
    size = ARITY**HEIGHT
    member = F.struct("pos", "node", *carry)
    b = nodes.groupBy(*keys, F.floor(F.col("pos") / size).cast("long").alias("block")).agg(
        F.array_sort(F.collect_list(member)).alias("members"), F.first("n").alias("n")
    )
    b = b.withColumn("height", F.when(F.col("n") > size, F.lit(HEIGHT)).otherwise(_height(F.col("n"))))
    b = b.withColumn("l0", F.array_join(F.transform("members", lambda m: m["node"]), "").cast("binary"))
    for k in range(HEIGHT):
        b = b.withColumn(f"l{k + 1}", F.when(F.col("height") > k, _parents(F.col(f"l{k}"))).otherwise(F.col(f"l{k}")))
    return b.withColumn("top", F.col(f"l{HEIGHT}").cast("string"))


def _paths(at: Column) -> Column:
    """Siblings of the member at place ``at`` of its block, up to the top of the block."""
    steps, place = [], at
    for k in range(HEIGHT):
        steps.append(_beside(F.col(f"l{k}"), place))
        place = F.floor(place / ARITY)
    return F.slice(F.array(*steps), F.lit(1), F.col("height"))


def tree(nodes: DataFrame, keys: list[str], carry: list[str]) -> DataFrame:
    """Root and siblings of every node.

    ``nodes`` has keys, pos, n, node and ``carry``; the result has these (without pos
    and n), ``top`` (root of the group) and ``path``, the siblings from the node up.
    Every round is written, and has one row for 3^HEIGHT of the round before.
    """
    blocks = keep(_blocks(nodes, keys, carry), "merkle-blocks")
    size = ARITY**HEIGHT
    if blocks.where(F.col("n") > size).isEmpty():
        blocks = blocks.withColumn("above", F.array().cast(SIBLINGS))
    else:
        up = blocks.select(*keys, F.col("block").alias("pos"), F.ceil(F.col("n") / size).cast("long").alias("n"), F.col("top").alias("node"))
        over = tree(up.withColumn("block", F.col("pos")), keys, ["block"]).select(*keys, "block", "top", F.col("path").alias("above"))
        blocks = join_same(blocks.drop("top"), over, [*keys, "block"])
    per = F.transform(
        "members",
        lambda m, i: F.struct(*[m[c].alias(c) for c in ["node", *carry]], F.concat(_paths(i), F.col("above")).alias("path")),
    )
    return blocks.select(*keys, "top", F.explode(per).alias("m")).select(*keys, "top", "m.*")


def fold(node: Column, path: Column) -> Column:
    """The root that a node and its siblings lead to."""
    return F.aggregate(path, node, lambda acc, s: sha(F.concat(s["left"], acc, s["right"])))


def proof_text(path: Column) -> Column:
    """All siblings in order, as one string."""
    return F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), "")


def manifest(
    docs: DataFrame,
    fields: list[str],
    id_col: str = "doc_id",
    group_col: str = "source",
    also: dict[str, Column] | None = None,
) -> DataFrame:
    """``id_col``, leaf, subroot, root and path (siblings up to the root) of every row, and the columns ``also``.

    ``fields`` are hashed in their order.  Null ids come first in their source and the
    null source before all others, which follow in bytewise order; rows with equal ids
    are ordered by leaf, so equal rows are interchangeable.  Other columns are not read;
    no rows give no rows.  ``also`` are further columns over the row (a second leaf).
    """
    require(docs, id_col, group_col, *fields)
    also = also or {}
    rows = docs.select(
        F.col(id_col).alias("__id"), F.col(group_col).alias("__g"), leaf_hash([F.col(f) for f in fields]).alias("node"),
        *[c.alias(f"__also{i}") for i, c in enumerate(also.values())],
    )
    extra = [f"__also{i}" for i in range(len(also))]
    rows = places(keep(rows, "merkle-leaves"), ["__g"], [F.col("__id").asc_nulls_first(), F.col("node").asc()])
    leaves = keep(tree(rows, ["__g"], ["__id", *extra]), "merkle-paths")
    tops = keep(leaves.select("__g", F.col("top").alias("node")).distinct(), "merkle-tops")
    whole = places(tops.withColumn("__all", F.lit(0)), ["__all"], [F.col("__g").asc_nulls_first()])
    whole = tree(whole, ["__all"], ["__g"]).select("__g", F.col("top").alias("root"), F.col("path").alias("__over"))
    out = join_same(leaves, lookup(whole, 20_000), ["__g"])
    return out.select(
        F.col("__id").alias(id_col), F.col("node").alias("leaf"), F.col("top").alias("subroot"), "root",
        F.concat("path", "__over").alias("path"), *[F.col(e).alias(n) for e, n in zip(extra, also)],
    )
