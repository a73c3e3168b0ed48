"""N-gram Jaccard join by filtering under several global token orders.

Two documents link when the Jaccard similarity of their shingle sets reaches
num / den.  Under ANY global order of the shingles, two such sets share a shingle
among the first n - ceil(t n) + 1 of each (their prefixes).  Prefixes are built under
three orders, all of them rare shingles first by different counts: pairs come
from a join on the first, and must also share prefix shingles under the
second and the third before anything is verified.  A parity bitmap of the set adds
an exact bound on the symmetric difference.

What is asked for are classes of linked documents, so pairs inside a class that is
already connected need not be looked at.  Documents with equal sets are one node.
Pairs that meet in a shingle of few postings are listed, a bounded number per
shingle.  Of those, and of one hub node per frequent shingle, every node is checked
against the nearest candidate, in rounds that go on while they link many; after
that, ALL pairs left between different classes are checked.  A group of near copies
so costs its size and not its square, and no link between different texts is lost.

How often shingles occur is counted over all documents in two tables of counters
under different hashes.  A shingle's rank is its counter in one table, in the
other, or the smaller of both: these are the three orders.  Counters only order
shingles, so collisions cannot change the result.  Prefixes of the first order go
straight into the shuffle that makes pairs of them; those of the other two orders
are made for the nodes that met another one.  Verification computes the whole sets
again from the texts of the documents in question.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F, types as T

from episodica.llm.common import require
from episodica.llm.components import components, maybe_among
from episodica.plans.small import few, forget, keep

#: parity bits of a set, and longs that hold them
BITS = 512
LONGS = BITS // 64

#: rounds in which nodes are checked against one hub: at least, and at most while they find
#: a link for one in LINKING of the nodes that the largest round checked
ROUNDS, MOST_ROUNDS, LINKING = 2, 5, 5

#: postings up to which all pairs of a shingle are listed at once
RARE = 12

#: log2 of the most counters in a table
MAX_BUCKETS = 23

#: members checked against one copy of a hub's text
HUB_ROWS = 500

#: rows in one block of a frequent shingle when all its pairs are formed
BLOCK_ROWS = 1000

#: rows with sets or texts for a task of a small step
WIDE_ROWS = 2_500

#: text bytes turned into sets at once
SLICE_BYTES = 4 << 20

_MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


# ---------------------------------------------------------------- sets
def _mixed(x: np.ndarray, k: int) -> np.ndarray:
    x = x * np.uint64(_MIX[k])
    x = (x ^ (x >> np.uint64(32))) * np.uint64(_MIX[(k + 1) % 3])
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts, n: int) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of each text (Arrow strings).

    Words are runs of anything but ASCII white space, A-Z lower-cased.  A text of
    fewer words is one shingle; one without words has none.
    """
    import pyarrow as pa
    import pyarrow.compute as pc
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat = split.flatten()
    coded = flat.dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = coded.dictionary.to_pylist()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), dtype=np.uint64, count=len(words))
    which = coded.indices.to_numpy(zero_copy_only=False)
    offsets = split.offsets.to_numpy() - split.offsets[0].as_py()
    if "" in words:
        full = which != words.index("")
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        which = which[full]
    h = table[which] if len(which) else np.zeros(0, dtype=np.uint64)
    grams = h[: max(0, len(h) - n + 1)].copy()
    for j in range(1, n):
        grams = _mixed(grams, 0) + h[j : j + len(grams)]
    grams = _mixed(grams, 1)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            x = np.array([b - a], dtype=np.uint64)
            for i in range(a, b):
                x = _mixed(x, 2) + h[i : i + 1]
            yield x
        else:
            yield np.zeros(0, dtype=np.uint64)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - (num * n + den - 1) // den + 1


def prefix(tokens: np.ndarray, rank: np.ndarray, k: int, size: int) -> np.ndarray:
    """First ``size`` of the sorted ``tokens`` under order k: rank (rare first), then a mix of the token."""
    key = (rank.astype(np.uint64) << np.uint64(56)) | (_mixed(tokens, k) >> np.uint64(8))
    # stable, so equal keys fall back on the token itself
    return tokens[np.argsort(key, kind="stable")[:size]]


def parity(tokens: np.ndarray) -> np.ndarray:
    """Bitmap in which every token flips one bit: bits that differ bound the symmetric difference from below."""
    odd = np.bincount((tokens >> np.uint64(7)) & np.uint64(BITS - 1), minlength=BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def counters(tokens: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of tokens in the first and the second table of counters."""
    mask = np.uint64(buckets - 1)
    return (tokens & mask).astype(np.int64), ((tokens >> np.uint64(33)) & mask).astype(np.int64) + buckets


def ranks(counts: np.ndarray) -> np.ndarray:
    """Rank of each counter, in steps of a ninth or so."""
    return np.minimum(np.round(8 * np.log2(1.0 + counts)), 255).astype(np.uint8)


def linked(x: np.ndarray, y: np.ndarray, num: int, den: int) -> bool:
    both = len(np.intersect1d(x, y, assume_unique=True))
    return den * both >= num * (len(x) + len(y) - both)


def _slices(batch, col: str):
    import pyarrow.compute as pc

    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(col)), 0).to_numpy(zero_copy_only=False))
    start = 0
    while start < len(size):
        base = size[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(size, base + SLICE_BYTES, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


# ---------------------------------------------------------------- passes over the texts
_FIRST = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("tk", T.LongType()), T.StructField("n", T.LongType()),
    T.StructField("node", T.LongType()), T.StructField("bits", T.ArrayType(T.LongType())), T.StructField("chunk", T.IntegerType()),
    T.StructField("counts", T.BinaryType()),
])
_POSTING = T.StructType([T.StructField("token", T.LongType()), T.StructField("node", T.LongType()), T.StructField("n", T.LongType())])
_ORDERS = T.StructType([
    T.StructField("node", T.LongType()), T.StructField("p2", T.ArrayType(T.IntegerType())), T.StructField("p3", T.ArrayType(T.IntegerType())),
])
_CHUNKS = 512


def _lists(arrays: list[np.ndarray], kind):
    """Arrow list array of the arrays."""
    import pyarrow as pa

    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(arrays), kind))


def _node(tokens: np.ndarray) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(tokens.tobytes()) - (1 << 63)


def _first_pass(d: DataFrame, n: int, buckets: int) -> DataFrame:
    """Rows of documents (id, tk, n, node, parity bits), and rows of counts of shingles, from one reading."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard
        from pyspark.sql.pandas.types import to_arrow_schema

        schema, counts = to_arrow_schema(_FIRST), np.zeros(2 * buckets, dtype=np.uint16)
        for batch in batches:
            for part in _slices(batch, "text"):
                sizes, nodes, bits, held = [], [], [], []
                for s in shingle_sets(part.column("text"), n):
                    sizes.append(len(s))
                    nodes.append(_node(s) if len(s) else None)
                    bits.append(parity(s))
                    held.append(s)
                for at in counters(np.concatenate(held), buckets):
                    places, seen = np.unique(at, return_counts=True)
                    # a task's counts stop at 65,535: only ranks come of them
                    counts[places] = np.minimum(counts[places] + seen, 65_535)
                none = [None] * len(sizes)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id"), part.column("tk"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.int64()),
                     _lists(bits, pa.int64()), pa.array(none, pa.int32()), pa.array(none, pa.binary())], schema=schema)
        z, each = zstandard.ZstdCompressor(level=1), 2 * buckets // _CHUNKS
        rows = [(c, counts[c * each : (c + 1) * each]) for c in range(_CHUNKS)]
        rows = [{"chunk": c, "counts": z.compress(x.tobytes())} for c, x in rows if x.any()]
        # a few at a time: the JVM holds a batch of them outside its heap
        for at in range(0, len(rows), _CHUNKS // 16):
            yield pa.RecordBatch.from_pylist([dict.fromkeys(schema.names) | r for r in rows[at : at + _CHUNKS // 16]], schema)

    return keep(d.mapInArrow(run, _FIRST), "jaccard-sets")


def _count_ranks(first: DataFrame, buckets: int) -> np.ndarray:
    """Ranks of all counters of both tables: partial counts are added chunk by chunk, in the tasks."""

    def add(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        z, now, total = zstandard.ZstdDecompressor(), None, None

        def out():
            return pa.RecordBatch.from_pydict({"chunk": pa.array([now], pa.int32()), "ranks": pa.array([ranks(total).tobytes()], pa.binary())})

        for batch in batches:
            for chunk, data in zip(batch.column("chunk").to_pylist(), batch.column("counts").to_pylist()):
                part = np.frombuffer(z.decompress(data), dtype=np.uint16)
                if chunk != now:
                    if now is not None:
                        yield out()
                    now, total = chunk, np.zeros(len(part), dtype=np.uint64)
                total += part
        if now is not None:
            yield out()

    parts = first.where("chunk is not null").select("chunk", "counts").repartition("chunk").sortWithinPartitions("chunk")
    # a byte for each of 2 * buckets counters, whatever the size of the corpus
    out, each = np.zeros(2 * buckets, dtype=np.uint8), 2 * buckets // _CHUNKS
    for row in parts.mapInArrow(add, "chunk int, ranks binary").collect():
        out[row["chunk"] * each : (row["chunk"] + 1) * each] = np.frombuffer(row["ranks"], dtype=np.uint8)
    return out


def _postings(d: DataFrame, n: int, num: int, den: int, table) -> DataFrame:
    """(token, node, n): the prefixes under the first order, of every row with words; ``table`` is the broadcast of ranks."""
    buckets = len(table.value) // 2

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        rare = table.value
        for batch in batches:
            for part in _slices(batch, "text"):
                nodes, sizes, p = [], [], []
                for s in shingle_sets(part.column("text"), n):
                    if not len(s):
                        continue
                    r1, r2 = (rare[at] for at in counters(s, buckets))
                    p.append(prefix(s, np.minimum(r1, r2), 0, prefix_length(len(s), num, den)).view(np.int64))
                    nodes.append(_node(s))
                    sizes.append(len(s))
                if nodes:
                    each = [len(x) for x in p]
                    cols = (np.concatenate(p), np.repeat(np.array(nodes, dtype=np.int64), each), np.repeat(np.array(sizes, dtype=np.int64), each))
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=_POSTING.names)

    return d.select("text").mapInArrow(run, _POSTING)


def _other_orders(d: DataFrame, wanted: DataFrame, n: int, num: int, den: int, table, rows: int) -> DataFrame:
    """(node, p2, p3): the prefixes under the second and third order of the ``wanted`` nodes (node, tk)."""
    buckets = len(table.value) // 2

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        rare, schema = table.value, to_arrow_schema(_ORDERS)
        for batch in batches:
            for part in _slices(batch, "text"):
                nodes, p = [], ([], [])
                for s in shingle_sets(part.column("text"), n):
                    if not len(s):
                        continue
                    nodes.append(_node(s))
                    size = prefix_length(len(s), num, den)
                    for k, at in enumerate(counters(s, buckets)):
                        p[k].append((prefix(s, rare[at], k + 1, size) >> np.uint64(32)).astype(np.uint32).view(np.int32))
                if nodes:
                    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), *(_lists(x, pa.int32()) for x in p)], schema=schema)

    # the bit filter may let others pass
    found = maybe_among(d.select("tk", "text"), "tk", wanted.select("tk")).select("text").mapInArrow(run, _ORDERS)
    found = found.join(wanted.select("node"), "node", "left_semi")
    found = found.groupBy("node").agg(F.first("p2").alias("p2"), F.first("p3").alias("p3"))
    return keep(few(found, rows, WIDE_ROWS), "jaccard-orders")


# ---------------------------------------------------------------- candidates
def _off(x: str, y: str) -> Column:
    """Bits in which two nodes differ."""
    return sum((F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(LONGS)), F.lit(0)).cast("long")


def _may_link(x: str, y: str, num: int, den: int) -> Column:
    """Exact bounds on two nodes: sizes, and bits that differ."""
    nx, ny = F.col(f"{x}.n"), F.col(f"{y}.n")
    sizes = F.least(nx, ny) * den >= F.greatest(nx, ny) * num
    return sizes & (_off(x, y) * (den + num) <= (nx + ny) * (den - num))


def _share_prefixes(pairs: DataFrame, orders: DataFrame) -> DataFrame:
    """Pairs (a, b, off) whose prefixes also meet under the second and third order."""
    named = maybe_among(orders, "node", pairs.select("a").union(pairs.select("b")))
    x, y = named.alias("x"), named.alias("y")
    d = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node"))
    return d.where(F.arrays_overlap("x.p2", "y.p2") & F.arrays_overlap("x.p3", "y.p3")).select("a", "b", "off")


def _verify(pairs: DataFrame, checked: int, reps: DataFrame, d: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """Those of the ``checked`` pairs (a, b) that link, from the whole sets of both texts.

    Rows are dealt by b; its text comes first, the texts of its partners follow in
    a stream, at most HUB_ROWS or so to one copy of it.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        key = hub = None
        for batch in batches:
            for part in _slices(batch, "text"):
                keys = zip(part.column("b").to_pylist(), part.column("salt").to_pylist(), part.column("a").to_pylist())
                found = []
                for (b, salt, a), s in zip(keys, shingle_sets(part.column("text"), n)):
                    if a is None:
                        key, hub = (b, salt), s
                    elif key == (b, salt) and linked(s, hub, num, den):
                        found.append((a, b))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], names=["a", "b"])

    wanted = pairs.select("a").union(pairs.select("b")).distinct()
    wanted = keep(wanted.join(reps, F.col("a") == F.col("node")).select("tk", "node"), "jaccard-wanted")
    texts = maybe_among(d.select("tk", "text"), "tk", wanted).join(wanted, "tk").groupBy("node").agg(F.min("text").alias("text"))
    texts = keep(few(texts, 2 * checked, WIDE_ROWS), "jaccard-texts")
    width = pairs.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / HUB_ROWS).alias("w"))
    salted = pairs.join(width, "b").select("a", "b", "w", F.pmod(F.xxhash64("a"), F.col("w")).alias("salt"))
    partners = salted.join(texts, F.col("a") == F.col("node")).select("b", "salt", "a", "text")
    hubs = width.select("b", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") - 1)).alias("salt"))
    hubs = hubs.join(texts, F.col("b") == F.col("node")).select("b", "salt", F.lit(None).cast("long").alias("a"), "text")
    rows = partners.union(hubs).repartition("b", "salt").sortWithinPartitions("b", "salt", F.col("a").asc_nulls_first())
    # rows of one (b, salt) stay next to each other when partitions are put together
    links = keep(few(rows, 2 * checked, WIDE_ROWS).mapInArrow(run, "a long, b long"), "jaccard-links")
    forget(wanted, texts)
    return links


def _classed(d: DataFrame, comp: DataFrame | None, *cols: str) -> DataFrame:
    """``d`` with the class of each named node column; a node without links is its own class."""
    for c in cols:
        if comp is None:
            d = d.withColumn(f"{c}_comp", F.col(c))
        else:
            d = d.join(comp.select(F.col("node").alias(f"__{c}"), F.col("comp").alias(f"{c}_comp")), F.col(c) == F.col(f"__{c}"), "left")
            d = d.withColumn(f"{c}_comp", F.coalesce(f"{c}_comp", c)).drop(f"__{c}")
    return d


class TokenRuns:
    """Postings sorted by (token, node) -> pairs of rare shingles, and the postings of frequent ones.

    Takes them in pieces of any size and holds at most RARE rows of the token that
    may go on in the next piece.
    """

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        none = np.zeros(0, dtype=np.int64)
        self.held, self.hot = (none, none, none), None

    def add(self, token: np.ndarray, node: np.ndarray, n: np.ndarray, last: bool = False) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """[(tokens, a, b)]; b is None for postings of frequent shingles."""
        token, node, n = (np.concatenate(x) for x in zip(self.held, (token, node, n)))
        if not len(token):
            return []
        # copies of a document post the same twice
        new = np.concatenate([[True], (token[1:] != token[:-1]) | (node[1:] != node[:-1])])
        token, node, n = token[new], node[new], n[new]
        starts = np.flatnonzero(np.concatenate([[True], token[1:] != token[:-1]]))
        length = np.diff(np.append(starts, len(token)))
        often = length > RARE
        if self.hot is not None and token[0] == self.hot:
            often[0] = True
        self.hot = token[-1] if often[-1] else None
        done = len(token)
        if not last and not often[-1]:
            done = starts[-1]  # this token may go on
        self.held = tuple(x[done:] for x in (token, node, n)) if not often[-1] else tuple(x[-1:] for x in (token, node, n))
        run = np.repeat(np.arange(len(starts)), length)
        flag = often[run]
        out = []
        if flag.any():
            out.append((token[flag], node[flag], None))
        rare = np.flatnonzero(~flag[:done])
        t, v, size = token[rare], node[rare], n[rare]
        for k in range(1, RARE):
            if k >= len(t):
                break
            near = t[k:] == t[:-k]
            if not near.any():
                break
            small, large = np.minimum(size[k:], size[:-k]), np.maximum(size[k:], size[:-k])
            at = np.flatnonzero(near & (small * self.den >= large * self.num))
            if len(at):
                out.append((t[at], v[at], v[at + k]))
        return out


def _met(posted: DataFrame, num: int, den: int) -> DataFrame:
    """(token, a, b): the pairs that meet in rare shingles, and (b null) the postings of frequent ones.

    One shuffle of the postings, read in order as a stream.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        runs = TokenRuns(num, den)

        def rows(parts):
            for t, a, b in parts:
                b = pa.nulls(len(a), pa.int64()) if b is None else pa.array(b, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(t, pa.int64()), pa.array(a, pa.int64()), b], names=["token", "a", "b"])

        for batch in batches:
            yield from rows(runs.add(*(batch.column(c).to_numpy(zero_copy_only=False) for c in ("token", "node", "n"))))
        none = np.zeros(0, dtype=np.int64)
        yield from rows(runs.add(none, none, none, last=True))

    posted = posted.repartition("token").sortWithinPartitions("token", "node")
    return keep(posted.mapInArrow(run, "token long, a long, b long"), "jaccard-met")


def _rare_pairs(met: DataFrame, info: DataFrame, num: int, den: int, rows: int) -> DataFrame:
    """All pairs (a, b) of rare shingles that may link, with their differing bits."""
    pairs = met.where("b is not null").select("a", "b").distinct()
    x, y = info.alias("x"), info.alias("y")
    d = pairs.join(x, F.col("a") == F.col("x.node")).join(y, F.col("b") == F.col("y.node")).where(_may_link("x", "y", num, den))
    return keep(few(d.select("a", "b", _off("x", "y").alias("off")), rows), "jaccard-pairs")


def _mixed_tokens(d: DataFrame) -> DataFrame:
    """Postings of shingles that still meet in several classes."""
    mixed = d.groupBy("token").agg(F.min("node_comp").alias("lo"), F.max("node_comp").alias("hi")).where("lo < hi").select("token")
    return d.join(mixed, "token")


def _hub_pairs(d: DataFrame, seed: int, num: int, den: int) -> DataFrame:
    """For every node the hubs of its shingles that are in another class and may link."""
    row = F.struct("node", "n", "bits", "node_comp")
    hubs = d.groupBy("token").agg(F.min_by(row, F.xxhash64(F.lit(seed), "token", "node_comp", "node")).alias("h")).select("token", "h.*")
    x, y = d.alias("x"), hubs.alias("y")
    pairs = x.join(y, (F.col("x.token") == F.col("y.token")) & (F.col("x.node_comp") != F.col("y.node_comp")) & _may_link("x", "y", num, den))
    pairs = pairs.groupBy(F.col("x.node").alias("a")).agg(F.min(F.struct(_off("x", "y").alias("off"), F.col("y.node").alias("b"))).alias("m"))
    return pairs.select("a", "m.b", "m.off")


def _all_pairs(d: DataFrame, num: int, den: int) -> DataFrame:
    """All pairs between different classes that share a shingle and may link.

    The rows of a frequent shingle are dealt into blocks; every two blocks meet once.
    """
    size = d.groupBy("token").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    d = d.join(size, "token").withColumn("mine", F.pmod(F.xxhash64(F.lit(5), "node"), F.col("blocks")).cast("int"))
    d = d.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    d = d.withColumns({"lo": F.least("mine", "other"), "hi": F.greatest("mine", "other")})
    x, y = d.alias("x"), d.alias("y")
    same = (F.col("x.token") == F.col("y.token")) & (F.col("x.lo") == F.col("y.lo")) & (F.col("x.hi") == F.col("y.hi"))
    # rows of one block meet in its own cell, rows of two blocks in the cell of the two
    cell = F.when(F.col("x.mine") == F.col("y.mine"), F.col("x.lo") == F.col("x.hi")).otherwise(True)
    once = F.col("x.node") < F.col("y.node")
    pairs = x.join(y, same & cell & once & (F.col("x.node_comp") != F.col("y.node_comp")) & _may_link("x", "y", num, den))
    return pairs.select(F.col("x.node").alias("a"), F.col("y.node").alias("b"), _off("x", "y").alias("off")).distinct()


def jaccard_components(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """id, n_shingles, component_id, tk (hash of the text) and comp of every row of ``docs``.

    ``component_id`` is the smallest id reachable by links.  Null texts and texts
    without words have no shingles and link with nothing: their component is
    their own id.  Rows with equal sets link.  Ids are cast to long; null ids are
    passed over in the minimum.  ``comp`` names the component even where ids are
    null or repeat; it is null without shingles.  Extra columns are not read; no
    rows give no rows.
    """
    require(docs, id_col, text_col)
    d = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("tk"), F.col(text_col).alias("text"))
    rows = docs.count()
    # 32 counters a document, up to a bound that fits into a worker
    buckets = 1 << int(np.clip(np.ceil(np.log2(max(1, 32 * rows))), 16, MAX_BUCKETS))
    first = _first_pass(d, n, buckets)
    table = docs.sparkSession.sparkContext.broadcast(_count_ranks(first, buckets))
    sets = keep(first.where("chunk is null").select("id", "tk", "n", "node"), "jaccard-rows")
    info = first.where("node is not null").groupBy("node").agg(F.min("tk").alias("tk"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    info = keep(few(info, rows, WIDE_ROWS), "jaccard-nodes")
    forget(first, shuffles=True)
    reps, bits = info.select("node", "tk"), info.select("node", "n", "bits")

    met = _met(_postings(d, n, num, den, table), num, den)
    meetings = met.count()
    near = _rare_pairs(met, bits, num, den, meetings + rows)
    often = met.where("b is null").select("token", F.col("a").alias("node")).distinct()
    often = keep(few(often.join(bits, "node"), meetings + rows), "jaccard-postings")
    forget(met, shuffles=True)
    pairings, postings = near.count(), often.count()
    wanted = near.select(F.col("a").alias("node")).union(near.select("b")).union(often.select("node")).distinct()
    wanted = keep(few(wanted.join(reps, "node"), 2 * pairings + postings + rows), "jaccard-wanted")
    among = wanted.count()
    orders = _other_orders(d, wanted, n, num, den, table, among)
    rare = keep(few(_share_prefixes(near, orders), pairings + 2 * among), "jaccard-rare")
    forget(wanted, near, shuffles=True)

    comp = edges = None
    rounds, most, links, last = 0, 0, 0, False
    while True:
        left = keep(_classed(rare, comp, "a", "b").where("a_comp != b_comp").select("a", "b", "off"), "jaccard-left")
        classed = keep(_classed(often, comp, "node"), "jaccard-often")
        d2 = _mixed_tokens(classed)
        # a posting meets one hub at most; all pairs have no such bound
        more = keep(_all_pairs(d2, num, den) if last else few(_hub_pairs(d2, rounds, num, den), postings), "jaccard-pairs")
        pairs = left.unionByName(_share_prefixes(more, orders))
        if not last:
            # the nearest candidate of every node
            pairs = pairs.groupBy("a").agg(F.min_by("b", F.struct("off", "b")).alias("b"))
        pairs = keep(few(pairs.select("a", "b").distinct(), left.count() + more.count()), "jaccard-candidates")
        checked = pairs.count()
        new, old = _verify(pairs, checked, reps, d, n, num, den), edges
        rounds += 1
        found = new.count()
        links, most = links + found, max(most, checked)
        edges = new if old is None else keep(few(old.union(new), links), "jaccard-edges")
        comp = components(edges, links)
        # what this round made is in the links by now
        forget(left, classed, more, pairs, *([old, new] if old is not None else []), shuffles=True)
        if last:
            break
        last = rounds >= MOST_ROUNDS or (rounds >= ROUNDS and found * LINKING <= most)
    forget(info, rare, often, orders, edges, shuffles=True)
    labelled = sets.join(comp, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    smallest = labelled.where("comp is not null").groupBy("comp").agg(F.min("id").alias("component_id"))
    out = labelled.join(smallest, "comp", "left")
    return out.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce("component_id", F.when(F.col("node").isNull(), F.col("id"))).alias("component_id"), "tk", "comp")


def one_of_each(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """The documents that represent their component, with their columns.

    Of each component the row with the smallest (doc_id, text hash) stays, null ids
    last, and only one of rows that agree in both.  Documents without words all stay.
    The texts of documents that surely stay are not shuffled.
    """
    found = keep(jaccard_components(docs, n, num, den).where("comp is not null"), "jaccard-components")
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "tk")
    first = found.groupBy("comp").agg(F.min(key).alias("first"))
    rows = found.groupBy("comp", "doc_id", "tk").agg(F.count(F.lit(1)).alias("rows")).join(first, "comp")
    rows = rows.withColumn("stays", key.eqNullSafe(F.col("first"))).where("not stays or rows > 1")
    judged = keep(rows.select("tk", F.col("doc_id").alias("__doc"), "stays"), "jaccard-judged")
    d = docs.select(F.struct(*docs.columns).alias("d"), F.col("doc_id").cast("long").alias("__id"), F.xxhash64("text").alias("__tk"))
    safe = maybe_among(d, "__tk", judged.select("tk"), negate=True)
    rest = maybe_among(d, "__tk", judged.select("tk"))
    rest = rest.join(judged, (F.col("__tk") == F.col("tk")) & F.col("__id").eqNullSafe(F.col("__doc")), "left")
    one = rest.where("stays").dropDuplicates(["__id", "__tk"])
    return safe.select("d.*").unionByName(rest.where("stays is null").select("d.*")).unionByName(one.select("d.*"))
