"""The Merkle manifest against a tree built node by node."""

from collections import defaultdict
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from episodica.llm import merkle

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def H(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def tree(nodes):
    """(root, siblings of every node from the bottom up)."""
    paths, place = [[] for _ in nodes], list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(place):
            run = p // 3 * 3
            paths[i].append(("".join(nodes[run:p]), "".join(nodes[p + 1 : run + 3])))
            place[i] = p // 3
        nodes = [H(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
    return nodes[0], paths


def brute(rows):
    """(id, leaf, subroot, root, siblings as text) of every row; fields in the order of FIELDS."""
    by = defaultdict(list)
    for r in rows:
        by[r[1]].append((r[0] is not None, r[0] or 0, leaf(r)))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    tops = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    root, over = tree([tops[s][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for (has, i, h), path in zip(sorted(by[s]), tops[s][1]):
            out.append((i if has else None, h, tops[s][0], root, "".join(a + b for a, b in path + over[k])))
    return out


def result(df):
    out = merkle.manifest(df, FIELDS).withColumn("proof", merkle.proof_text(F.col("path"))).withColumn("again", merkle.fold(F.col("leaf"), F.col("path"))).collect()
    # every untouched row proves itself
    assert all(r["again"] == r["root"] for r in out)
    return [(r["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof"]) for r in out]


def same(got, want):
    assert sorted(map(str, got)) == sorted(map(str, want))


@pytest.mark.parametrize("height, rows", [(1, 7), (2, 20), (5, 50_000)])
def test_rows_of_every_kind(llm, messy, messy_rows, monkeypatch, height, rows):
    monkeypatch.setattr(merkle, "HEIGHT", height)
    monkeypatch.setattr(merkle, "RANGE_ROWS", rows)
    want = brute([(r[0], r[3], r[2], r[4], r[1]) for r in messy_rows])
    same(result(messy), want)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 27, 28])
def test_sizes_around_powers_of_three(llm, monkeypatch, n):
    monkeypatch.setattr(merkle, "HEIGHT", 2)
    monkeypatch.setattr(merkle, "RANGE_ROWS", 10)
    rows = [(i, "hot", "en", i, f"text\n{i}") for i in range(n)] + [(100, "Z", None, 1, ""), (101, "é", None, 1, None), (102, None, None, None, "x")]
    df = llm.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    same(result(df), brute(rows))


def test_many_sources_and_one_row(llm, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    rows = [(i, f"s{i % 11}", "en", 0, "t") for i in range(30)]
    for some in (rows, rows[:1]):
        df = llm.createDataFrame([(r[0], r[4], r[2], r[1], r[3]) for r in some], "doc_id long, text string, lang string, source string, n_chars long")
        same(result(df), brute(some))


def test_any_change_is_noticed(llm, messy):
    made = merkle.manifest(messy.where("text like '%o%'"), FIELDS, also={"other": merkle.leaf_hash([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars"), F.replace(F.col("text"), F.lit("o"), F.lit(""))])})
    made = made.withColumn("folded", merkle.fold(F.col("other"), F.col("path")))
    assert made.count() > 10 and made.where("folded = root").count() == 0


def test_empty_table(empty):
    out = merkle.manifest(empty, FIELDS)
    assert out.columns == ["doc_id", "leaf", "subroot", "root", "path"] and out.count() == 0
