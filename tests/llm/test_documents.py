"""Operators on documents against brute force, on hard rows."""

import random
import re
import zlib
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from episodica.llm import bitplanes, components, entropy_mix, jaccard, line_windows, vector_shards, weak_supervision, wu_manber
from tests.llm.conftest import sentence

AZ = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


# ---------------------------------------------------------------- sharding
def test_shards(messy, messy_rows):
    out = vector_shards.pack_shards(messy, 4).toPandas()
    assert len(out) == len(messy_rows)
    assert sorted(out["size"]) == sorted(len((r[1] or "").encode()) + 1 for r in messy_rows)
    assert sorted(out["text_crc32"]) == sorted(zlib.crc32((r[1] or "").encode()) for r in messy_rows)
    for _, g in out.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))


def test_shards_keep_equal_texts_together_and_are_even(llm):
    rows = [(i, f"text number {i % 400} " + "word " * (i % 37)) for i in range(4000)]
    out = vector_shards.pack_shards(llm.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    assert out.groupby("text_crc32")["shard"].nunique().max() == 1
    by = out.groupby("shard").agg({"size": "sum", "tokens": "sum", "slot": "count"})
    assert len(by) == 8
    assert ((by.max() - by.min()) / by.mean() < 0.05).all()


def test_a_group_larger_than_a_shard_is_cut(llm):
    rows = [(i, "same text " * 5 if i % 2 else f"other {i} " * 5) for i in range(4000)]
    out = vector_shards.pack_shards(llm.createDataFrame(rows, "doc_id long, text string"), 8).toPandas()
    by = out.groupby("shard")["size"].sum()
    assert (by.max() - by.min()) / by.mean() < 0.05


def test_placement_prefers_the_highest_dot_product():
    # the second item is token heavy: it goes where tokens are left
    w = np.array([[0.5, 0.1], [0.1, 0.4], [0.2, 0.1]])
    assert vector_shards.place(w, 2).tolist() == [0, 1, 1]
    assert vector_shards.place(np.zeros((0, 3)), 4).tolist() == []


# ---------------------------------------------------------------- binary ids
@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=300), st.sampled_from(["bit", "byte"]))
def test_planes_round_trip(ids, plane):
    a = np.array(ids, dtype="<u4")
    assert (bitplanes.decode_planes(bitplanes.encode_planes(a, plane), len(a), plane) == a).all()


@pytest.mark.parametrize("plane", ["bit", "byte"])
def test_id_files(llm, messy, messy_rows, tmp_path, plane):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(bitplanes.word_tokenizer())
    made = bitplanes.write_ids(messy, f"file://{tmp_path}/ids", bitplanes.word_tokenizer(), 1, plane=plane, chunk_ids=500, file_bytes=20_000)
    got = bitplanes.read_ids(made).toPandas().sort_values("start")
    rows = sorted(messy_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for (i, t, *_), g in zip(rows, got.itertuples()):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], dtype="<u4")
        assert (g.doc_id is None or np.isnan(g.doc_id)) if i is None else g.doc_id == i
        assert (g.start, g.n_tokens, g.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert len(got) == len(rows)
    file = made.orderBy("file_no").first()
    reader = bitplanes.PlaneReader(file["file"])
    whole = np.concatenate([p for _, ps in reader.documents() for p in ps])
    assert (reader.ids(450, 1100) == whole[450:1100]).all() and len(whole) == file["n_ids"]


def test_words_and_marks_have_the_ids_of_whole_texts():
    import pyarrow as pa
    from tokenizers import Tokenizer

    texts = ["\u0130. K. \u212a. A. b, c; D: e! F? g.. h?! ., ...", "", "Caf\u00e9, CAF\u00c9. na\u00efve! word Word WORD, a1. \ufb01. I'm don't."]
    tok = Tokenizer.from_file(bitplanes.word_tokenizer())
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    encode = bitplanes.word_encoder(bitplanes.word_tokenizer())
    for _ in range(2):  # new words, then known ones
        ids, n = encode(pa.array(texts))
        # a mark after a letter that lower-cases to two code points was encoded apart before
        assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])


def test_words_of_letters_go_through_the_tokenizer_once_and_together(monkeypatch):
    import pyarrow as pa
    from tokenizers import Tokenizer

    given = []

    class Counting:
        def __init__(self, tok):
            self.get_vocab, self.get_vocab_size, self.tok = tok.get_vocab, tok.get_vocab_size, tok

        def encode_batch_fast(self, words, **kw):
            given.extend(words)
            return self.tok.encode_batch_fast(words, **kw)

    tok = Tokenizer.from_file(bitplanes.word_tokenizer())
    texts = ["Été,*** été ÉTÉ!! straße STRASSE... été", "don't L'été's, ab'!! ab12, ẞ <|endoftext|> abc<|endoftext|> w</w>, x≮ word≮ abc\u0301, \u0301x", "×a ÿ! Ÿ µ ª, #%& ..."]
    want = [tok.encode(t, add_special_tokens=False).ids for t in texts]
    monkeypatch.setattr(Tokenizer, "from_file", lambda path: Counting(tok))
    monkeypatch.setattr(bitplanes, "_TOKENIZERS", {})
    encode = bitplanes.word_encoder(bitplanes.word_tokenizer())
    ids, n = encode(pa.array(texts))
    assert n.tolist() == list(map(len, want)) and ids.tolist() == sum(want, [])
    # every spelling was a call of its own before
    assert [w for w in given if "été" in w.lower() and "'" not in w] == ["été straße strasse ÿ"]


def test_id_files_of_nothing(llm, empty, tmp_path):
    made = bitplanes.write_ids(empty, f"file://{tmp_path}/ids", bitplanes.word_tokenizer())
    assert bitplanes.read_ids(made).count() == 0


def test_a_torn_file_is_refused(tmp_path):
    (tmp_path / "x.planes").write_bytes(bitplanes.MAGIC + b"0123456789abcdefgh")
    with pytest.raises(ValueError):
        bitplanes.PlaneReader(f"file://{tmp_path}/x.planes")


# ---------------------------------------------------------------- mixing
def brute_targets(sizes, weights, cap):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        free = sum(w[s] for s in names if s not in full)
        level = (total - sum(cap * sizes[s] for s in full)) / free if free else 0
        more = {s for s in names if s not in full and level * w[s] >= cap * sizes[s]}
        if not more:
            return {s: min(cap * sizes[s], level * w[s]) for s in names}
        full |= more


def test_mix(messy, messy_rows):
    out = entropy_mix.mix_copies(messy).toPandas().astype({"source": object})
    assert len(out) == len(messy_rows)
    sizes = defaultdict(int)
    for r in messy_rows:
        sizes[r[3]] += len(words(r[1]))
    want = brute_targets(sizes, (5, 2, 1), 3)
    largest = max(len(words(r[1])) for r in messy_rows if r[0] != 9)
    for s, g in out.groupby("source", dropna=False):
        s = s if isinstance(s, str) else None
        assert g["source_size"].eq(sizes[s]).all()
        assert np.allclose(g["target"], want[s])
        # rates solve the dual: they meet the target, and are tilted by size alone
        uncut = (g["rate"] > 0) & (g["rate"] < 3 - 1e-6)
        assert abs((g["rate"] * g["size"]).sum() - want[s]) < 1e-4 * max(1, want[s])
        lam = np.log(g["rate"][uncut]) / g["size"][uncut]
        assert lam.max() - lam.min() < 1e-6 if uncut.any() else True
        assert abs((g["copies"] * g["size"]).sum() - want[s]) <= max(largest, max(g["size"]))
    assert (out["copies"] <= 3).all()


def test_mix_meets_targets_closely_and_reruns_agree(llm, messy_rows):
    rows = [(i, "w " * (1 + i * 7919 % 400), f"s{i % 5}") for i in range(3000)]
    d = llm.createDataFrame(rows, "doc_id long, text string, source string")
    one = entropy_mix.mix_copies(d).select("doc_id", "source", "size", "target", "copies").toPandas()
    two = entropy_mix.mix_copies(d.repartition(7)).select("doc_id", "copies").toPandas()
    g = one.assign(taken=one["copies"] * one["size"]).groupby("source").agg({"taken": "sum", "target": "first"})
    assert (abs(g["taken"] / g["target"] - 1) < 0.002).all()
    assert one.set_index("doc_id")["copies"].sort_index().equals(two.set_index("doc_id")["copies"].sort_index())
    assert entropy_mix.mixed_documents(d).count() == one["copies"].sum()


def test_mix_of_nothing(empty):
    assert entropy_mix.mix_copies(empty).count() == 0
    assert entropy_mix.mixed_documents(empty).columns == empty.columns


def test_targets_stop_at_the_cap(llm):
    sizes = {"a": 10, "b": 1000, "c": 0, None: 5}
    d = llm.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in entropy_mix.source_targets(d).collect()}
    want = brute_targets(sizes, (5, 2, 1), 3)
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}


# ---------------------------------------------------------------- quality
def brute_base(t):
    w = words(t)
    grams = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {i + j for i in range(len(w) - 7) if grams[tuple(w[i : i + 8])] > 1 for j in range(8)}
    seen, dup = set(), 0
    for line in (t or "").split("\n"):
        if words(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), dup, len(cover)


def test_quality_counts(messy, messy_rows):
    out = weak_supervision.judge_quality(messy).toPandas()
    want = Counter(brute_base(r[1]) for r in messy_rows)
    assert Counter(tuple(map(int, x)) for x in out[weak_supervision.BASE].to_numpy()) == want
    short = out[out["n_words"] < 20]
    assert short["base_failed"].all() and not short["kept"].any()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c d", "a b c d e f g h i", "\n", "#x", "é*"]), max_size=40))
def test_measures(parts):
    t = " ".join(parts)
    assert tuple(weak_supervision.measure(t)[0]) == brute_base(t)


@pytest.mark.parametrize("n,want", [(99, 1.0), (100, 1.0), (199, (1 + 0.02) / 2), (200, (1 + 0.01) / 2), (250, (1 + 0.01 + 0.01) / 3)])
def test_variety_sees_every_word(n, want):
    # a hundred different words, then one over and over
    t = " ".join([f"w{i}" for i in range(min(n, 100))] + ["same"] * (n - 100))
    assert weak_supervision.measure(t)[1]["variety"] == pytest.approx(want)


def test_em_finds_the_bad_class():
    rng = np.random.default_rng(1)
    good = rng.random(20_000) < 0.8
    k = len(weak_supervision.RULES)
    # a rule rarely objects to good documents, and each sees a part of the bad ones
    object_ = np.where(good[:, None], rng.random((20_000, k)) < 0.004, rng.random((20_000, k)) < 0.35)
    votes = np.where(object_, 2, np.where(rng.random((20_000, k)) < 0.9, 1, 0))
    codes = (votes * 3 ** np.arange(k - 1, -1, -1)).sum(axis=1)
    pattern, back, n = np.unique(codes, return_inverse=True, return_counts=True)
    post, rates = weak_supervision.fit_votes(pattern, n)
    assert ((post[back] > 0.5) == good).mean() > 0.97
    assert np.allclose(rates[0, :, 2], 0.004, atol=0.003) and np.allclose(rates[1, :, 2], 0.35, atol=0.05)


def test_quality_against_labels(llm, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    out = weak_supervision.judge_quality(llm.read.parquet(f"{sf}/documents.parquet"))
    d = out.join(llm.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed").toPandas()
    assert (d["kept"] == (d["quality"] == 1)).mean() > 0.97


def test_quality_filter_keeps_columns_and_rows(messy, empty):
    kept = weak_supervision.quality_filter(messy)
    judged = weak_supervision.judge_quality(messy)
    assert kept.columns == messy.columns
    assert kept.count() == judged.where("kept").count()
    assert weak_supervision.quality_filter(empty).count() == 0


# ---------------------------------------------------------------- decontamination
def bench_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(AZ))


def brute_hits(t, items, size=10):
    w, hit, found = bench_words(t), set(), set()
    for i, it in items:
        ws = bench_words(it)
        for a in range(max(1, len(ws) - size + 1) if ws and i is not None else 0):
            p = ws[a : a + size]
            for at in range(len(w) - len(p) + 1):
                if w[at : at + len(p)] == p:
                    hit.update(range(at, at + len(p)))
                    found.add(str(i))
    return len(w), len(hit), sorted(found)


ITEMS = [(1, "a b c d e f g h i j k l"), (2, "x Y z"), (3, "x y"), (30, "c d e f g h i j k l m n"), (4, None), (5, " !! "), (None, "q q"), (3, "x y"), (6, "solo")]


@pytest.mark.parametrize("block", [1, 3, 1000])
def test_decontamination(llm, messy, messy_rows, block):
    bench = llm.createDataFrame(ITEMS, "item_id long, text string")
    extra = [(900, "zz A b, c d-e f g h i j k l m n o"), (901, "x y x y z solo"), (902, "a b c d e f g h i x")]
    d = messy.select("doc_id", "text", "id").union(llm.createDataFrame([(i, t, "x") for i, t in extra], "doc_id long, text string, id string"))
    got = wu_manber.find_benchmark(d, bench, 10, block_windows=block).toPandas()
    want = Counter((t, *map(str, brute_hits(t, ITEMS))) for t in [r[1] for r in messy_rows] + [t for _, t in extra])
    assert Counter((r.doc["text"], str(r.n_words), str(r.n_hit), str(list(r.items))) for r in got.rename(columns={"items": "items_"}).rename(columns={"items_": "items"})[["doc", "n_words", "n_hit", "items"]].itertuples(index=False)) == want


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), max_size=14), max_size=5))
def test_search_equals_brute_force(doc, items):
    items = [(i, " ".join(x)) for i, x in enumerate(items)]
    tables = wu_manber.build([(str(i), wu_manber.words(t)) for i, t in items], 4)
    spans, found = wu_manber.find(wu_manber.words(" ".join(doc)), tables)
    assert (sum(b - a for a, b in spans), found) == brute_hits(" ".join(doc), items, 4)[1:]


def test_empty_benchmark_and_documents(llm, messy, empty):
    none = llm.createDataFrame([], "item_id long, text string")
    assert wu_manber.drop_contaminated(messy, none).count() == messy.count()
    assert wu_manber.find_benchmark(empty, llm.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


@pytest.mark.parametrize("block", [1, 1000])
def test_items_without_an_id_are_searched(llm, block):
    bench = llm.createDataFrame([(None, "q Q"), (None, "r s"), (7, "r s"), (None, None)], "item_id long, text string")
    d = llm.createDataFrame([(1, "a q q"), (2, "r s"), (3, "a b"), (4, None)], "doc_id long, text string")
    got = wu_manber.find_benchmark(d, bench, 10, block_windows=block).select("doc.doc_id", "n_hit", "items").collect()
    assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in got} == {1: (2, []), 2: (2, ["7"]), 3: (0, []), 4: (0, [])}
    assert {r["doc_id"] for r in wu_manber.drop_contaminated(d, bench).collect()} == {3, 4}


def test_blocks_are_bounded_and_searched_one_by_one(llm):
    text = " ".join(f"w{i}" for i in range(40))
    bench = llm.createDataFrame([(1, text), (2, "solo"), (None, "q q")], "item_id long, text string")
    stated = bench.selectExpr("cast(item_id as string) as id", "text")
    sizes = [sum(max(1, len(ws) - 9) for _, ws in b) for b in wu_manber._blocks(stated, 10, 7)]
    assert max(sizes) <= 7 and sum(sizes) == 33
    d = llm.createDataFrame([(1, text), (1, text), (2, "solo q q"), (3, None), (4, "w1 w2")], "doc_id long, text string")
    many, one = (wu_manber.find_benchmark(d, bench, 10, block_windows=n) for n in (7, 1000))
    plain = lambda x: sorted((r["doc"]["doc_id"], r["n_words"], r["n_hit"], r["items"]) for r in x.collect())
    assert plain(many) == plain(one) == [(1, 40, 40, ["1"]), (1, 40, 40, ["1"]), (2, 3, 3, ["2"]), (3, 0, 0, []), (4, 2, 0, [])]
    # each block was searched in a pass of its own, so none is left in the plan
    assert many._jdf.queryExecution().toString().count("search(") == 0


def test_benchmark_without_words(llm, messy):
    bench = llm.createDataFrame([(1, None), (2, ""), (3, " !! "), (None, None)], "item_id long, text string")
    assert wu_manber.drop_contaminated(messy, bench).count() == messy.count()


# ---------------------------------------------------------------- Jaccard
def brute_sets(rows, n):
    out = []
    for t in rows:
        w = words((t or "").translate(AZ))
        out.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    return out


def brute_groups(rows, n, num):
    sets = brute_sets([r[1] for r in rows], n)
    label = list(range(len(rows)))
    for i, x in enumerate(sets):
        for j in range(i):
            y = sets[j]
            if x and y and 100 * len(x & y) >= num * len(x | y) and label[i] != label[j]:
                old = label[i]
                label = [label[j] if v == old else v for v in label]
    return sets, label


@pytest.mark.parametrize("n,num", [(3, 90), (5, 80)])
def test_jaccard(llm, messy, messy_rows, n, num):
    import random

    rng = random.Random(5)
    rows = list(messy_rows)
    for g in range(4):
        stem = [f"w{rng.randint(0, 500)}" for _ in range(80)]
        for i in range(25):  # chains and bundles of near copies
            w = list(stem)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(80)] = f"x{rng.randint(0, 99)}"
            rows.append((1000 + 100 * g + i, " ".join(w), "en", "a", 0))
    d = llm.createDataFrame([r[:2] for r in rows], "doc_id long, text string").repartition(5)
    got = jaccard.jaccard_components(d, n, num, 100).toPandas()
    sets, label = brute_groups(rows, n, num)
    least = {}
    for r, g in zip(rows, label):
        least[g] = min([x for x in (least.get(g), r[0]) if x is not None], default=None)
    want = Counter((r[0], len(s), least[g] if s else r[0]) for r, s, g in zip(rows, sets, label))
    whole = lambda x: None if x is None or np.isnan(x) else int(x)
    assert Counter((whole(r.doc_id), int(r.n_shingles), whole(r.component_id)) for r in got.itertuples()) == want
    kept = jaccard.one_of_each(d, n, num).toPandas()
    assert len(kept) == len({g for s, g in zip(sets, label) if s}) + sum(not s for s in sets)


def test_jaccard_keeps_prefixes_only_of_nodes_that_met(llm, monkeypatch):
    rng, sizes, real = random.Random(5), {}, jaccard.keep

    def kept(df, name="kept"):
        out = real(df, name)
        folder = Path(out._kept_path.removeprefix("file:"))
        sizes[name] = max(sizes.get(name, 0), sum(f.stat().st_size for f in folder.glob("*.parquet")))
        return out

    monkeypatch.setattr(jaccard, "keep", kept)
    texts = [sentence(rng, 1500) for _ in range(60)]
    d = llm.createDataFrame(list(enumerate([*texts, texts[0] + " more"])), "doc_id long, text string").repartition(2)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(d).collect()}
    assert got == {i: i % 60 for i in range(61)}
    # "jaccard-sets" holds the counters, which do not grow beyond their number
    assert sum(v for k, v in sizes.items() if k != "jaccard-sets") < 0.5 * sum(map(len, texts))


def test_near_copies_are_joined_before_all_pairs_are_formed(llm, monkeypatch):
    rng, seen, real = random.Random(7), [], jaccard._all_pairs

    def formed(d, num, den):
        seen.append(real(d, num, den).count())
        return real(d, num, den)

    monkeypatch.setattr(jaccard, "_all_pairs", formed)
    base, rows = sentence(rng, 150).split(), []
    for i in range(300):
        words = list(base)
        for at in rng.sample(range(150), rng.randint(1, 3)):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(llm.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [{tuple(t.split()[j : j + 5]) for j in range(146)} for _, t in rows]
    near = {i: [j for j in range(300) if j != i and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])] for i in range(300)}
    want = {}
    for i in range(300):
        todo = [i] if i not in want else []
        while todo:
            j = todo.pop()
            if j not in want:
                want[j] = i
                todo += near[j]
    assert got == want
    # 670 after two rounds
    assert sum(seen) < 100


def test_rounds_on_few_links_take_few_tasks(llm, monkeypatch):
    rng, files, rounds, real, verify = random.Random(9), [], [], components.keep, jaccard._verify

    def kept(df, name="kept"):
        out = real(df, name)
        files.append(len(list(Path(out._kept_path.removeprefix("file:")).glob("*.parquet"))))
        return out

    monkeypatch.setattr(components, "keep", kept)
    monkeypatch.setattr(jaccard, "_verify", lambda *a: rounds.append(1) or verify(*a))
    base, rows = sentence(rng, 150).split(), []
    for i in range(200):
        words = list(base)
        for at in rng.sample(range(150), 2):
            words[at] = f"w{i}x{at}"
        rows.append((i, " ".join(words)))
    held = {k: llm.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        llm.conf.set("spark.sql.shuffle.partitions", "60")
        llm.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        got = jaccard.jaccard_components(llm.createDataFrame(rows, "doc_id long, text string")).collect()
    finally:
        for k, v in held.items():
            llm.conf.set(k, v)
    assert {r["component_id"] for r in got} == {0} and len(got) == 200
    # a file for each partition that has labels before, 40 and more
    assert max(files) == 1 and len(rounds) <= 4


def test_jaccard_of_nothing(empty):
    assert jaccard.jaccard_components(empty, 3, 90).count() == 0
    assert jaccard.one_of_each(empty).columns == empty.columns


def test_blocks_of_a_frequent_shingle_lose_no_pair(llm, monkeypatch):
    from pyspark.sql import functions as F

    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 7)
    d = llm.range(40).select(F.lit(1).cast("long").alias("token"), F.col("id").alias("node"), F.col("id").alias("node_comp"), F.lit(10).cast("long").alias("n"),
                             F.array_repeat(F.lit(0).cast("long"), jaccard.LONGS).alias("bits"))
    got = jaccard._all_pairs(d, 90, 100).collect()
    assert len(got) == len(set(got)) == 40 * 39 // 2


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 4), st.integers(0, 40)), max_size=150), st.integers(1, 30))
def test_token_runs(rows, step):
    rows = sorted(rows)
    size = lambda v: 90 + v
    runs, pairs, often = jaccard.TokenRuns(90, 100), set(), set()
    pieces = [rows[i : i + step] for i in range(0, len(rows), step)] + [None]
    for piece in pieces:
        cols = [np.array(c, dtype=np.int64) for c in (([t for t, _ in piece or []]), ([v for _, v in piece or []]), ([size(v) for _, v in piece or []]))]
        for t, a, b in runs.add(*cols, last=piece is None):
            if b is None:
                often |= set(zip(t.tolist(), a.tolist()))
            else:
                pairs |= set(zip(t.tolist(), a.tolist(), b.tolist()))
    nodes = defaultdict(set)
    for t, v in rows:
        nodes[t].add(v)
    for t, vs in nodes.items():
        if len(vs) > jaccard.RARE:
            assert {v for u, v in often if u == t} == vs and not [p for p in pairs if p[0] == t]
        else:
            want = {(t, a, b) for a in vs for b in vs if a < b and 100 * size(a) >= 90 * size(b)}
            assert {p for p in pairs if p[0] == t} == want and not [v for u, v in often if u == t]


@settings(max_examples=100, deadline=None)
@given(st.sets(st.integers(0, 60)), st.sets(st.integers(0, 60)), st.sampled_from([50, 80, 90, 100]))
def test_filters_are_exact(x, y, num):
    if not x or not y:
        return
    token = lambda s: np.unique(jaccard._mixed(np.array(sorted(s), dtype=np.uint64), 2))
    a, b = token(x), token(y)
    if not jaccard.linked(a, b, num, 100):
        return
    rank = lambda t: (t & np.uint64(1)).astype(np.uint8)
    for k in range(3):
        p, q = (jaccard.prefix(t, rank(t), k, jaccard.prefix_length(len(t), num, 100)) for t in (a, b))
        assert len(np.intersect1d(p, q))
    off = sum(bin(int(u) ^ int(v)).count("1") for u, v in zip(jaccard.parity(a).view(np.uint64), jaccard.parity(b).view(np.uint64)))
    assert off <= len(np.setxor1d(a, b)) and off * (100 + num) <= (len(a) + len(b)) * (100 - num)


# ---------------------------------------------------------------- lines
def brute_lines(rows):
    """Rows of (id, text); text hashes do not matter when ids differ."""
    out, seen = {}, set()
    for i, t in sorted(rows):
        lines = t.split("\n")
        full = [k for k, x in enumerate(lines) if words(x)]
        gone = set()
        for a in range(len(full) - 2):
            w = tuple(lines[full[a + j]] for j in range(3))
            if w in seen:
                gone.update(full[a : a + 3])
            seen.add(w)
        out[i] = "\n".join(x for k, x in enumerate(lines) if k not in gone)
    return out


def test_lines(llm):
    rows = [(1, "a\nb\nc\nd"), (2, "x\nb\n\nc\nd\ny"), (3, "a\nb"), (4, "q\nq\nq\nq\nq"), (5, ""), (6, "b\nc\nd\na\nb\nc\nd"), (7, "\n\n\n"), (8, "a\nb\nc\nd\n")]
    d = llm.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lines string")
    got = {r["doc_id"]: r for r in line_windows.drop_repeated_lines(d).collect()}
    want = brute_lines(rows)
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_lines"] == len(t.split("\n")) for (i, t), r in zip(rows, (got[i] for i, _ in rows)))
    assert got[1]["lines"] == "x"


def test_lines_of_hard_rows(messy, messy_rows, empty):
    out = line_windows.drop_repeated_lines(messy).toPandas()
    assert len(out) == len(messy_rows) and out["text"].isna().sum() == sum(r[1] is None for r in messy_rows)
    assert out[out["doc_id"] == 9]["n_removed"].eq(0).all()
    assert line_windows.drop_repeated_lines(empty).count() == 0


def test_copies_of_one_or_two_lines_go(llm):
    rows = [(1, "a\nb"), (2, "\na\n \nb"), (3, "a"), (4, "a"), (5, "b\na"), (6, "a\nb\nc"), (7, "a\nb\nc"), (8, ""), (9, ""), (10, "\n")]
    d = llm.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["text"], r["n_removed"]) for r in line_windows.drop_repeated_lines(d).collect()}
    assert got == {i: (t, 0) for i, t in rows} | {2: ("\n ", 2), 4: ("", 1), 7: ("", 3)}
    kept = {r["doc_id"]: r["n_removed"] for r in line_windows.drop_repeated_lines(d, short=False).collect()}
    assert kept == {i: 3 if i == 7 else 0 for i, _ in rows}


# ---------------------------------------------------------------- vote rates
def _objective(n, rates):
    return (n * np.log(rates)).sum()


def test_vote_rates_are_the_best_under_the_constraint():
    rng = np.random.default_rng(1)
    for _ in range(60):
        n = rng.integers(0, 40, size=(2, 10, 3)) + 0.5
        r = weak_supervision.vote_rates(n)
        assert np.allclose(r.sum(axis=2), 1) and (r[0, :, 2] <= r[1, :, 2] + 1e-12).all()
        # no allowed neighbour is better
        for _ in range(40):
            other = np.clip(r + rng.normal(0, 0.02, r.shape), 1e-3, None)
            other /= other.sum(axis=2, keepdims=True)
            ok = other[0, :, 2] <= other[1, :, 2]
            other = np.where(ok[None, :, None], other, r)
            assert _objective(n, other) <= _objective(n, r) + 1e-9


def test_em_never_loses_likelihood_and_equals_a_plain_loop():
    rng = np.random.default_rng(5)
    patterns = np.unique(rng.integers(0, 3**10, 300))
    counts = rng.integers(1, 30, len(patterns))
    votes = np.array([[p // 3 ** (9 - j) % 3 for j in range(10)] for p in patterns])

    def bound(post, rates, share):
        """Log likelihood with the half counts and the prior of the share."""
        a = np.log(share) + np.log(rates[0])[np.arange(10), votes].sum(axis=1)
        b = np.log(1 - share) + np.log(rates[1])[np.arange(10), votes].sum(axis=1)
        return (counts * np.logaddexp(a, b)).sum() + 0.5 * np.log(rates).sum() + np.log(share) + np.log(1 - share)

    post = np.where((votes == 2).any(axis=1), 0.3, 0.95)
    last = -np.inf
    for _ in range(500):
        n = np.full((2, 10, 3), 0.5)
        for i, v in enumerate(votes):
            for j in range(10):
                n[0, j, v[j]] += counts[i] * post[i]
                n[1, j, v[j]] += counts[i] * (1 - post[i])
        rates = weak_supervision.vote_rates(n)
        share = ((counts * post).sum() + 1) / (counts.sum() + 2)
        now = bound(post, rates, share)
        assert now >= last - 1e-7
        last = now
        a = np.log(share) + np.log(rates[0])[np.arange(10), votes].sum(axis=1)
        b = np.log(1 - share) + np.log(rates[1])[np.arange(10), votes].sum(axis=1)
        new = 1 / (1 + np.exp(np.clip(b - a, -700, 700)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    got, _ = weak_supervision.fit_votes(patterns, counts)
    assert np.abs(got - new).max() < 1e-6
