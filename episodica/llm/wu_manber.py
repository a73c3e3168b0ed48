"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Patterns are windows of ``window`` consecutive words of the benchmark items (a
shorter item is one window of its own length).  For each pattern length m:

* SHIFT  maps a block of two words to how far the search may jump when the block
  ends at the current word; a block of no pattern allows m - 1 words, so most
  words of a document are never looked at.
* BUCKETS maps the last block of the patterns to those that end with it, by their
  first block, so that few strings are left to test.
* a direct comparison of the words confirms an occurrence.

The benchmark is a stated set of queries: it is read in blocks of ``block_windows``
windows at most, and each block is searched in the whole of every document.  A
benchmark of one block is searched in one projection.  With more, each block has a
pass of its own, which writes the spans it finds by text, so that plan and workers
hold one block at a time and the driver three at most; the spans meet the documents
in a join.  Tables are built from the patterns in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from episodica.llm.common import require
from episodica.plans.small import keep, lookup

#: windows in one set of search tables
BLOCK_WINDOWS = 200_000

#: A-Z in lower case, other ASCII but digits and a-z a blank; bytes above stay
_FOLD = bytes(
    c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def words(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


def windows(item: list[bytes], size: int) -> Iterator[tuple[bytes, ...]]:
    if item:
        for i in range(max(1, len(item) - size + 1)):
            yield tuple(item[i : i + size])


class Matcher:
    """Search tables of patterns of one length."""

    def __init__(self, m: int, patterns: dict[tuple[bytes, ...], list[str]]):
        self.m, self.block = m, min(2, m)
        self.free = m - self.block + 1
        self.shift: dict[bytes, int] = {}
        self.buckets: dict[bytes, dict[bytes, list[tuple[list[bytes], list[str]]]]] = {}
        for p, items in patterns.items():
            for end in range(self.block, m + 1):
                key = b" ".join(p[end - self.block : end])
                self.shift[key] = min(self.shift.get(key, self.free), m - end)
            first, last = b" ".join(p[: self.block]), b" ".join(p[m - self.block :])
            self.buckets.setdefault(last, {}).setdefault(first, []).append((list(p), items))

    def search(self, w: list[bytes]) -> Iterator[tuple[int, list[str]]]:
        """(first word, items) of every occurrence, in order."""
        m, n, free, shift = self.m, len(w), self.free, self.shift.get
        two = self.block == 2
        i = m - 1
        while i < n:
            key = w[i - 1] + b" " + w[i] if two else w[i]
            step = shift(key, free)
            if step:
                i += step
                continue
            at = i - m + 1
            first = w[at] + b" " + w[at + 1] if two else w[at]
            for p, items in self.buckets[key].get(first, ()):
                if w[at : i + 1] == p:
                    yield at, items
            i += 1


def build(items: Iterable[tuple[str | None, list[bytes]]], window: int) -> list[Matcher]:
    """Tables of all windows; those of an item without an id name no item."""
    by_length: dict[int, dict[tuple[bytes, ...], list[str]]] = {}
    for item, ws in items:
        for p in windows(ws, window):
            names = by_length.setdefault(len(p), {}).setdefault(p, [])
            if item is not None and item not in names:
                names.append(item)
    return [Matcher(m, ps) for m, ps in sorted(by_length.items())]


def find(w: list[bytes], matchers: list[Matcher]) -> tuple[list[tuple[int, int]], list[str]]:
    """Merged spans [start, stop) of hit words, and the items that occur."""
    raw, items = [], set()
    for m in matchers:
        for at, names in m.search(w):
            raw.append((at, at + m.m))
            items.update(names)
    spans: list[tuple[int, int]] = []
    for a, b in sorted(raw):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], max(b, spans[-1][1]))
        else:
            spans.append((a, b))
    return spans, sorted(items)


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("stop", T.IntegerType())])
_FOUND = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("spans", T.ArrayType(_SPAN)),
    T.StructField("items", T.ArrayType(T.StringType())),
])


_ARROW = pa.struct([
    ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.string())),
])


def _searcher(block: list[tuple[str | None, list[bytes]]], window: int):
    @F.arrow_udf(_FOUND)
    def search(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matchers = build(block, window)
        for texts in batches:
            rows = []
            for t in texts.to_pylist():
                w = words(t)
                spans, items = find(w, matchers)
                rows.append({"n_words": len(w), "spans": [{"start": a, "stop": b} for a, b in spans], "items": items})
            yield pa.array(rows, _ARROW)

    return search


def _blocks(benchmark: DataFrame, window: int, block_windows: int) -> Iterator[list[tuple[str | None, list[bytes]]]]:
    """Items with at most ``block_windows`` windows together; a longer item is cut, its parts sharing no window."""
    held, n, some = [], 0, False
    for row in benchmark.toLocalIterator():
        ws, at = words(row["text"]), 0
        left = max(1, len(ws) - window + 1) if ws else 0
        while left:
            take = min(left, block_windows - n)
            held.append((row["id"], ws[at : at + take + window - 1]))
            at, left, n = at + take, left - take, n + take
            if n == block_windows:
                yield held
                held, n, some = [], 0, True
    # a benchmark without words is one empty block
    if n or not some:
        yield held


@F.arrow_udf(T.LongType())
def _count_words(texts: pa.Array) -> pa.Array:
    return pa.array([len(words(t)) for t in texts.to_pylist()], pa.int64())


def _pass_by_pass(d: DataFrame, blocks: Iterator[list[tuple[str | None, list[bytes]]]], window: int) -> DataFrame:
    """``d`` (doc, __text) with the spans of all blocks, one written pass for each."""
    key = [F.xxhash64(F.lit(seed), "__text").alias(f"__k{seed}") for seed in (1, 2)]
    hits = None
    for block in blocks:
        f = d.select(*key, _searcher(block, window)(F.col("__text")).alias("f")).where(F.size("f.spans") > 0)
        # equal texts have equal hits
        one = keep(f.groupBy("__k1", "__k2").agg(F.first("f").alias("f")), "benchmark-pass")
        hits = one if hits is None else hits.union(one)
    hits = hits.groupBy("__k1", "__k2").agg(F.flatten(F.collect_list("f.spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("f.items"))).alias("items"))
    d = d.select("doc", _count_words(F.col("__text")).alias("n_words"), *key).join(lookup(hits, 20_000), ["__k1", "__k2"], "left")
    none = [F.coalesce(c, F.array().cast(_FOUND[c].dataType)).alias(c) for c in ("spans", "items")]
    return d.select("doc", "n_words", *none)


def _union(spans: Column) -> Column:
    """Number of words in sorted spans that may overlap."""
    zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))

    def add(acc, s):
        start = F.greatest(s["start"], acc["end"])
        return F.struct(
            F.greatest(acc["end"], s["stop"]).alias("end"), (acc["n"] + F.greatest(F.lit(0), s["stop"] - start).cast("long")).alias("n")
        )

    return F.aggregate(F.array_sort(spans), zero, add, lambda acc: acc["n"])


def find_benchmark(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = 10,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text: str = "text",
    block_windows: int = BLOCK_WINDOWS,
) -> DataFrame:
    """``docs`` as a struct column ``doc``, with n_words, n_hit, spans and items.

    ``spans`` are word ranges hit by windows, ``items`` the sorted ids (as strings)
    of items with occurring windows.  Null and empty texts have no words and no
    hits; items without words match nothing; windows of items without an id are
    hits that name no item; items that repeat count once; a benchmark without rows
    or words leaves every document clean.
    """
    require(docs, text_col)
    require(benchmark, item_col, item_text)
    d = docs.select(F.struct(*docs.columns).alias("doc"), F.col(text_col).alias("__text"))
    stated = benchmark.select(F.col(item_col).cast("string").alias("id"), F.col(item_text).alias("text"))
    blocks = _blocks(stated, window, max(1, block_windows))
    first, second = next(blocks), next(blocks, None)
    if second is None:
        d = d.select("doc", _searcher(first, window)(F.col("__text")).alias("f")).select("doc", "f.*")
    else:
        d = _pass_by_pass(d, chain([first, second], blocks), window)
    return d.select("doc", "n_words", _union(F.col("spans")).alias("n_hit"), "spans", F.array_sort("items").alias("items"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, window: int = 10) -> DataFrame:
    """The documents without any benchmark window, with their columns."""
    return find_benchmark(docs, benchmark, window).where("n_hit = 0").select("doc.*")
