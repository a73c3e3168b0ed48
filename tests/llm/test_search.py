"""Hybrid ranked search against scoring every document."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from episodica.llm import lexical

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(t):
    return [w.translate(AZ) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]


def brute(docs, items, k=10):
    """(item, rank, doc, score); every row is a document or an item of its own."""
    held = [(i, Counter(terms(t))) for i, t in docs]
    df = Counter(t for _, c in held for t in c)
    N, L = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    out = []
    for item, text in items:
        scored = []
        for i, c in held:
            n = sum(c.values())
            s = 0
            for t in set(terms(text)):
                if t in c:
                    m = 10 + 90 * n * N // L
                    s += math.floor(1000 * math.log((2 * N + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored, key=lambda x: x[:3])[:k])]
    return out


def found(df):
    return sorted(map(str, ((r[0], r[1], r[2], r[3]) for r in df.select("item_id", "rank", "doc_id", "score").collect())))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(300)]
    # frequent and rare words, ties, equal texts
    weights = [1 / (i + 1) for i in range(300)]
    docs = [(i, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 80)))) for i in range(2500)]
    docs += [(3000 + i, docs[i % 7][1]) for i in range(120)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(1, 15)) + vocabulary[: i % 4])) for i in range(40)]
    return docs, items


@pytest.mark.parametrize("block, window, share", [(200_000, 64, 1 / 32), (60, 1024, 0.5), (200_000, 100_000, 0.0)])
def test_search_equals_brute_force(llm, corpus, monkeypatch, block, window, share):
    docs, items = corpus
    monkeypatch.setattr(lexical, "WINDOW", window)
    monkeypatch.setattr(lexical, "SHORT_SHARE", share)
    d = llm.createDataFrame(docs, "doc_id long, text string").repartition(3)
    q = llm.createDataFrame(items, "item_id long, text string")
    assert found(lexical.search(d, q, 10, block_terms=block)) == sorted(map(str, brute(docs, items)))


def test_several_shards_in_one_task(llm, corpus):
    docs, items = corpus
    llm.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")
    try:
        d = llm.createDataFrame(docs, "doc_id long, text string").coalesce(2)
        got = found(lexical.search(d, llm.createDataFrame(items, "item_id long, text string"), 3))
    finally:
        llm.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == sorted(map(str, brute(docs, items, 3)))


def test_windows_skip_lists_that_cannot_win():
    # a frequent term of no weight to speak of beside a rare one: only the rare one's documents are walked
    n = 100_000
    often = (np.arange(n, dtype=np.int64), np.ones(n, np.int64))
    rare = (np.arange(0, n, 5000, dtype=np.int64), np.full(20, 1000, np.int64))
    offered = []

    class Watched(lexical.Best):
        def add(self, score, ids, null):
            offered.extend(ids.tolist())
            super().add(score, ids, null)

    best = Watched(5)
    lexical.search_shard([often, rare], n, np.arange(n), np.zeros(n, bool), best)
    assert best.id.tolist() == [0, 5000, 10000, 15000, 20000] and set(best.score) == {1001}
    assert len(offered) < 25_000


def test_random_lists():
    rng = np.random.default_rng(4)
    for _ in range(200):
        n = int(rng.integers(1, 300))
        lists = []
        for _ in range(rng.integers(1, 8)):
            at = np.flatnonzero(rng.random(n) < rng.choice([0.01, 0.1, 0.8]))
            if len(at):
                lists.append((at, rng.integers(1, 6, len(at)) * int(rng.choice([1, 10]))))
        if not lists:
            continue
        total = defaultdict(int)
        for a, s in lists:
            for x, y in zip(a.tolist(), s.tolist()):
                total[x] += y
        best = lexical.Best(4)
        lexical.search_shard(lists, n, np.arange(n), np.zeros(n, bool), best, window=int(rng.integers(1, 50)))
        assert list(zip(best.id.tolist(), best.score.tolist())) == sorted(total.items(), key=lambda x: (-x[1], x[0]))[:4]


def test_rows_of_every_kind(llm, messy, messy_rows):
    base = messy_rows[0][1]
    items = [(1, base[:200]), (1, base[:200]), (None, "One two"), (2, None), (3, ""), (4, " \t.;"), (5, "été ÄÖ"), (6, messy_rows[11][1]), (7, "nosuchword")]
    q = llm.createDataFrame([(*x, "x") for x in items], "item_id long, text string, q string")
    assert found(lexical.search(messy, q, 10)) == sorted(map(str, brute([r[:2] for r in messy_rows], items)))


def test_empty_tables(llm, empty, messy):
    q = llm.createDataFrame([(1, "one two")], "item_id long, text string")
    assert lexical.search(empty, q).collect() == []
    assert lexical.search(messy, q.where("false")).collect() == []
    assert lexical.search(messy, q.where("false")).columns == ["item_id", "rank", "doc_id", "score"]
