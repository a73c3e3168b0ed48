"""Ranked lexical search: the best documents for each item of a query set.

Documents are cut into shards where they lie (an Arrow batch is one), so postings need
no shuffle to be made: a task lists, for every term of the queries, the documents of
its shard that hold it.  Only counts per term leave the shards before they are scored.
A shard is then searched for every query by a hybrid of two orders:

* term at a time: the short lists of a query are summed into accumulators, one per
  document they hold, and the accumulators become one sorted list whose bound is their
  largest sum;
* document at a time: that list and the long lists, each with its bound, are walked
  together in windows of ascending documents.  Lists whose bounds together cannot
  reach the score to beat are not walked; they are only looked up for documents that
  the others bring up and that can still reach it.

A task carries its best documents, and so the score to beat, from shard to shard and
returns k rows per query.  The query set is searched in blocks of a bounded number of
terms, each block against all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from episodica.llm.common import require
from episodica.llm.wu_manber import words
from episodica.plans.small import keep

#: query terms (with repeats between items) that are searched together
BLOCK_TERMS = 200_000

#: lists up to this share of a shard's documents are summed term at a time
SHORT_SHARE = 1 / 32
SHORT_LEAST = 16

#: documents of a shard that are walked before the score to beat is raised
WINDOW = 1024

#: the number under which a shard's documents stand among its terms
DOCS = -1

_POSTINGS = "shard long, term int, n_docs long, n_terms long, at array<int>, tf array<int>, ids array<long>"
_POSTINGS_ARROW = pa.schema([
    ("shard", pa.int64()), ("term", pa.int32()), ("n_docs", pa.int64()), ("n_terms", pa.int64()), ("at", pa.list_(pa.int32())),
    ("tf", pa.list_(pa.int32())), ("ids", pa.list_(pa.int64())),
])


def _lists(flat: np.ndarray, ends: np.ndarray, kind) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(flat, kind))


def shard_postings(shard: int, ids: pa.Array, texts: list[str | None], vocabulary: dict[bytes, int]) -> Iterator[pa.RecordBatch]:
    """The rows of one shard: its documents with their lengths, and a posting list per term it holds."""
    flat: list[int] = []
    lengths = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        w = words(t)
        lengths[i] = len(w)
        flat += map(vocabulary.get, w, repeat(DOCS))
    n = len(texts)
    term = np.fromiter(flat, np.int64, len(flat))
    key = (term * n + np.repeat(np.arange(n), lengths))[term >= 0]
    key, tf = np.unique(key, return_counts=True)
    term, at = key // n if n else key, key % n if n else key
    names, first, count = np.unique(term, return_index=True, return_counts=True)
    everything = np.concatenate([[DOCS], names])
    no_ids = pa.ListArray.from_arrays(pa.array(np.full(len(names) + 1, 0), pa.int32()), pa.array([], pa.int64()))
    docs = pa.RecordBatch.from_arrays(
        [
            pa.array([shard], pa.int64()), pa.array([DOCS], pa.int32()), pa.array([int((lengths > 0).sum())], pa.int64()),
            pa.array([int(lengths.sum())], pa.int64()), pa.array([[]], pa.list_(pa.int32())),
            _lists(lengths, np.array([n]), pa.int32()), pa.ListArray.from_arrays(pa.array([0, n], pa.int32()), ids),
        ],
        schema=_POSTINGS_ARROW,
    )
    yield docs
    if len(everything) > 1:
        ends = first + count
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.full(len(names), shard), pa.int64()), pa.array(names, pa.int32()), pa.array(count, pa.int64()),
                pa.array(np.add.reduceat(tf, first), pa.int64()), _lists(at, ends, pa.int32()), _lists(tf, ends, pa.int32()), no_ids,
            ],
            schema=_POSTINGS_ARROW,
        )


class Best:
    """The k best (score, id) so far; ids without a value come last among equals."""

    def __init__(self, k: int):
        self.k = k
        self.score = np.zeros(0, np.int64)
        self.id = np.zeros(0, np.int64)
        self.null = np.zeros(0, bool)

    @property
    def beat(self) -> int:
        """Documents below this score cannot enter (an equal one can, by its id)."""
        return int(self.score[-1]) if len(self.score) == self.k else 1

    def add(self, score: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        s, i, n = np.concatenate([self.score, score]), np.concatenate([self.id, ids]), np.concatenate([self.null, null])
        best = np.lexsort((i, n, -s))[: self.k]
        self.score, self.id, self.null = s[best], i[best], n[best]


def search_shard(lists: list[tuple[np.ndarray, np.ndarray]], n: int, ids: np.ndarray, null: np.ndarray, best: Best, window: int = WINDOW) -> None:
    """Offer a query's documents of one shard to ``best``.

    ``lists`` holds (ascending places, scores) per term of the query; places are below ``n``.
    """
    short = max(SHORT_LEAST, int(n * SHORT_SHARE))
    long = [x for x in lists if len(x[0]) > short]
    few = [x for x in lists if len(x[0]) <= short]
    if len(few) > 1:
        # term at a time: one accumulator per document of the short lists
        at, back = np.unique(np.concatenate([a for a, _ in few]), return_inverse=True)
        total = np.zeros(len(at), np.int64)
        np.add.at(total, back, np.concatenate([s for _, s in few]))
        few = [(at, total)]
    walk = sorted(((int(s.max()), a, s) for a, s in long + few), key=lambda x: x[0])
    # what the lists up to each one can add together
    reach = np.cumsum([b for b, _, _ in walk])
    for start in range(0, n, window):
        beat = best.beat
        free = int(np.searchsorted(reach, beat, side="left"))
        if free == len(walk):
            return
        # document at a time: the lists that can bring up a document of this window
        parts = []
        for _, a, s in walk[free:]:
            lo, hi = np.searchsorted(a, (start, start + window))
            if lo < hi:
                parts.append((a[lo:hi], s[lo:hi]))
        if not parts:
            continue
        if len(parts) == 1:
            at, score = parts[0]
        else:
            dense = np.zeros(window, np.int64)
            for a, s in parts:
                dense[a - start] += s
            at = np.flatnonzero(dense)
            score, at = dense[at], at + start
        # the others are looked up for documents that can still reach the score
        for j in range(free - 1, -1, -1):
            can = score + reach[j] >= beat
            if not can.all():
                at, score = at[can], score[can]
            if not len(at):
                break
            _, a, s = walk[j]
            where = np.minimum(np.searchsorted(a, at), len(a) - 1)
            score = score + np.where(a[where] == at, s[where], 0)
        can = score >= beat
        if can.any():
            at = at[can]
            best.add(score[can], ids[at], null[at])


def _rank(queries: list[np.ndarray], weight: np.ndarray, n_docs: int, n_terms: int, k: int):
    """Rows of postings, by shard -> the k best documents of every query."""

    def score(rows: list[pa.RecordBatch], best: dict[int, Best]) -> None:
        t = pa.Table.from_batches(rows).combine_chunks()
        term = t["term"].to_numpy()
        own = int(np.flatnonzero(term == DOCS)[0])
        ids, lengths = t["ids"][own].values, t["tf"][own].values.to_numpy()
        null = ids.is_null().to_numpy(zero_copy_only=False)
        ids = ids.fill_null(0).to_numpy(zero_copy_only=False)
        value, back = np.unique(lengths, return_inverse=True)
        # in Python's numbers, since the product may pass 64 bits
        m = np.array([10 + 90 * int(v) * n_docs // n_terms for v in value], np.int64)[back]
        lists = {}
        size = t["at"].combine_chunks().value_lengths().to_numpy()
        at, tf = t["at"].combine_chunks().flatten().to_numpy(), t["tf"].combine_chunks()
        tf = pa.concat_arrays([tf[i].values for i in range(len(term)) if i != own]).to_numpy() if len(term) > 1 else at
        tf = tf.astype(np.int64)
        each = np.repeat(weight[np.maximum(term, 0)], size) * (1_000_000_000 * tf // (1000 * tf + 8 * m[at]))
        ends = np.cumsum(size)
        for i, x in enumerate(term.tolist()):
            if x != DOCS and weight[x] > 0:
                lists[x] = (at[ends[i] - size[i] : ends[i]], each[ends[i] - size[i] : ends[i]])
        for q, terms in enumerate(queries):
            held = [lists[x] for x in terms if x in lists]
            if held:
                if q not in best:
                    best[q] = Best(k)
                search_shard(held, len(lengths), ids, null, best[q])

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[int, Best] = {}
        held: list[pa.RecordBatch] = []
        shard = None
        for batch in batches:
            names = batch.column("shard").to_numpy()
            cuts = np.flatnonzero(np.diff(names)) + 1
            for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(names)]):
                if lo == hi:
                    continue
                if held and names[lo] != shard:
                    score(held, best)
                    held = []
                shard = names[lo]
                held.append(batch.slice(lo, hi - lo))
        if held:
            score(held, best)
        for q, b in best.items():
            ids = pa.array(b.id, pa.int64(), mask=b.null)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), q), pa.int32()), ids, pa.array(b.score, pa.int64())], ["q", "id", "score"])

    return rank


def search(
    docs: DataFrame,
    items: DataFrame,
    k: int = 10,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    query_col: str = "text",
    block_terms: int = BLOCK_TERMS,
) -> DataFrame:
    """``item_col``, rank (from 1), ``id_col`` (a long) and score of the ``k`` best documents of every item.

    Terms are lower-cased (A-Z) runs of ASCII letters, digits and non-ASCII characters;
    a term of an item counts once.  Only scores above 0 are ranked, equal ones by
    ascending id, rows without an id last.  Null and empty texts have no terms: such
    items have no rows, such documents are none of the collection.  Every row is a
    document or an item of its own, whatever its id, so repeated items are ranked each;
    other columns are not read; an empty table gives no rows.
    """
    require(docs, id_col, text_col)
    require(items, item_col, query_col)
    spark = docs.sparkSession

    def listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = [sorted(set(words(t))) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("row"), pa.array(own, pa.list_(pa.binary()))], ["row", "terms"])

    asked = keep(items.select(F.monotonically_increasing_id().alias("row"), F.col(item_col).alias("item"), F.col(query_col).alias("text")), "search-items")
    terms = keep(asked.select("row", "text").mapInArrow(listed, "row long, terms array<binary>").where(F.size("terms") > 0), "search-terms")
    blocks = max(1, -(-(terms.agg(F.sum(F.size("terms"))).first()[0] or 0) // block_terms))
    block = F.pmod(F.xxhash64("row"), F.lit(blocks))
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))

    found = []
    for b in range(blocks):
        # one block of the query set: block_terms terms, or one long item
        here = terms.where(block == b).orderBy("row").toArrow()
        words_of = here["terms"].to_pylist()
        vocabulary = {t: i for i, t in enumerate(dict.fromkeys(t for ts in words_of for t in ts))}
        queries = [np.array([vocabulary[t] for t in ts], np.int64) for ts in words_of]
        found.append(_search_block(spark, plain, here["row"].to_numpy(), queries, vocabulary, k))
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out.join(asked.select("row", "item"), "row").select(F.col("item").alias(item_col), "rank", F.col("id").alias(id_col), "score")


def _search_block(spark, plain: DataFrame, rows: np.ndarray, queries: list[np.ndarray], vocabulary: dict[bytes, int], k: int) -> DataFrame:
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        for i, b in enumerate(batches):
            if b.num_rows:
                yield from shard_postings((part << 32) + i, b.column("id"), b.column("text").to_pylist(), vocabulary)

    postings = keep(plain.mapInArrow(post, _POSTINGS), "search-postings")
    counts = postings.groupBy("term").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms"))
    whole = counts.where(F.col("term") == DOCS).first()
    n_docs, n_terms = (whole["n_docs"], whole["n_terms"]) if whole else (0, 0)
    # one row for each term of the block
    of = counts.where(F.col("term") != DOCS).select("term", F.floor(F.lit(1000.0) * F.log((2.0 * n_docs + 2) / (2.0 * F.col("n_docs") + 1))).alias("w")).toArrow()
    weight = np.zeros(max(1, len(vocabulary)), np.int64)
    weight[of["term"].to_numpy()] = of["w"].to_numpy()
    ranked = postings.repartition("shard").sortWithinPartitions("shard", "term").mapInArrow(_rank(queries, weight, n_docs, n_terms, k), "q int, id long, score long")
    order = W.partitionBy("q").orderBy(F.col("score").desc(), F.col("id").asc_nulls_last())
    top = ranked.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    names = spark.createDataFrame([(i, int(r)) for i, r in enumerate(rows.tolist())], "q int, row long")
    return top.join(F.broadcast(names), "q").select("row", "rank", "id", "score")
