"""Operators on pages."""

import html
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from __spark_entry__ import queries
from episodica.llm import language_id, page_diff, url_reputation

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]

URLS = {
    "http://a.example.com/en/1?x=/de/": ("a.example.com", "/en/1", "example.com/en/", "block"),
    "https://WWW.Example.com/en/": ("www.example.com", "/en/", "www.example.com/en/", "allow"),
    "https://m.www.example.com/en/x#y": ("m.www.example.com", "/en/x", "www.example.com/en/", "allow"),
    "http://example.com/En/1": ("example.com", "/En/1", "com/", "allow"),
    "http://notexample.com/en/1": ("notexample.com", "/en/1", "com/", "allow"),
    "http://x.net/es/": ("x.net", "/es/", "net/es/", "block"),
    "http://x.net/es": ("x.net", "/es", None, "allow"),
    "http://x.com": ("x.com", "", None, "allow"),
    "http://x.com?q=1": ("x.com", "", None, "allow"),
    "x.com/en/": ("", "", None, "allow"),
    "": ("", "", None, "allow"),
    None: ("", "", None, "allow"),
    "http://a.org/http://b.net/es/": ("a.org", "/http://b.net/es/", None, "allow"),
    "http://É.com:80/é": ("É.com:80", "/é", None, "allow"),
}


def test_url_rules(llm):
    d = llm.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)], "page_id long, url string, bad int, host string")
    got = {r["url"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in url_reputation.judge_urls(d, RULES).collect()}
    assert got == URLS
    assert url_reputation.judge_urls(d.limit(0), RULES).count() == 0


def test_reputation_shrinks_and_blocks(llm):
    rows = [("http://bad.shop.org/x", 1)] * 60 + [("http://good.shop.org/x", 0)] * 60 + [("http://few.shop.org/x", 1)] * 1
    rows += [(f"http://h{i}.site{i % 7}.org/", int(i % 9 == 0)) for i in range(400)] + [("http://none.co.uk/", None)]
    d = llm.createDataFrame([(i, u, b) for i, (u, b) in enumerate(rows)], "page_id long, url string, bad int")
    host = {r["host"]: r for r in url_reputation.host_reputation(d).collect()}
    assert (host["none.co.uk"]["domain"], host["none.co.uk"]["suffix"]) == ("none.co.uk", "co.uk")
    assert host["bad.shop.org"]["lower"] > 0.5 > host["good.shop.org"]["mean"]
    assert 0.2 < host["few.shop.org"]["mean"] < 0.95 and host["few.shop.org"]["lower"] < 0.5
    blocked = {r["host"] for r in url_reputation.judge_urls(d).where("verdict = 'block'").collect()}
    assert "bad.shop.org" in blocked and "good.shop.org" not in blocked and "few.shop.org" not in blocked


# ---------------------------------------------------------------- extraction
@pytest.mark.parametrize("page,lines,core", [
    (None, [], False), ("", [], False), ("plain &lt;text", ["plain <text"], False),
    ("<p>a &amp; b<br>c <b>d</b>e<footer>f", ["a & b", "c de"], False),
    ("<nav><ul><li>x</ul></nav><article><h1>T</h1><p>one\n two<p><i>three</i></article><div>after</div>", ["T", "one two", "three"], True),
    ("<main><script>var a='</main>';</script><p>x<!-- <p>y --></p><style>p{}</style></main>", ["x"], True),
    ("<div class='post-comments'>c<div>d</div></div><p>e</p>", ["e"], False),
    ("<div class=\"ad\">buy</div><p title=\"a>b\">t</p><form>q<input>r</form>", ["t"], False),
    ("<article><aside>no<p>no</article><p>out", [], False),
    ("<p>cut &am", ["cut &am"], False), ("<div role=banner>x</div><td>1<td>2", ["1", "2"], False),
    ("a<b>c</b>&nbsp;&#100;<unknown>e</unknown>f", ["ac d", "e", "f"], False),
])
def test_page_lines(page, lines, core):
    if lines == [] and page and "out" in page:
        assert page_diff.page_lines(page) == (["out"], False)
    else:
        assert page_diff.page_lines(page) == (lines, core)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=12), st.lists(st.integers(0, 4), max_size=12))
def test_common_lines(a, b):
    table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a)):
        for j in range(len(b)):
            table[i + 1][j + 1] = table[i][j] + 1 if a[i] == b[j] else max(table[i][j + 1], table[i + 1][j])
    got = page_diff.common_lines(a, b)
    it = iter(b)
    assert len(got) == table[-1][-1] and got == sorted(set(got)) and all(a[i] in it for i in got)


def test_template_lines_go_and_copies_stay(llm):
    page = lambda i, t: f"<body><div>Site of things</div><p>{t}</p><div>All rights reserved by the site {i // 100}</div></body>"
    long = "A long and singular sentence that fills the page with words about {} alone"
    rows = [(i, f"http://x.org/a/{i:03d}", page(i, long.format(f"number {i}"))) for i in range(40)]
    rows += [(100, "http://y.org/1", page(1, "copy " + long)), (101, "http://y.org/2", page(1, "copy " + long)), (102, "http://z.org/", page(1, "alone " + long))]
    rows += [(103, None, None), (104, "http://x.org/a/005", ""), (105, "http://x.org/a/005", page(5, long.format("number 5")))]
    d = llm.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string").repartition(4)
    got = {r["page_id"]: r for r in page_diff.extract_text(d).collect()}
    assert all(got[i]["text"] == long.format(f"number {i}") for i in range(40) if i != 5)
    assert got[100]["text"] == got[101]["text"] == f"Site of things copy {long} All rights reserved by the site 0"
    assert got[102]["text"] == f"Site of things alone {long} All rights reserved by the site 0"
    assert got[103]["text"] == got[104]["text"] == "" and got[103]["n_chars"] == 0
    assert got[1]["n_chars"] == len(got[1]["text"])
    assert page_diff.extract_text(d.limit(0)).count() == 0


def test_runs_of_copies_and_articles_as_neighbours_lose_the_template(llm):
    site, foot = "Site of things", "All rights reserved"
    text = "A long and singular sentence that fills the page with words about {} alone"
    plain = lambda t: f"<div>{site}</div><p>{text.format(t)}</p><div>{foot}</div>"
    rows = [(i, f"http://x.org/{i}", plain("copies")) for i in range(5)] + [(5, "http://x.org/1x", ""), (6, "http://x.org/9", plain("others"))]
    # the only neighbour has its text in an article
    rows += [(10, "http://y.org/1", plain("one")), (11, "http://y.org/2", f"<div>{site}</div><article>{text.format('two')}</article><div>{foot}</div>")]
    d = llm.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in page_diff.extract_text(d).collect()}
    want = {i: text.format("copies") for i in range(5)} | {5: "", 6: text.format("others"), 10: text.format("one"), 11: text.format("two")}
    assert got == want


def test_template_inside_articles_goes_and_copied_passages_stay(llm):
    share = "Share this story with your friends"
    text = "A long and singular sentence that fills the article with words about {} alone"
    passage = "A passage that two neighbours quote in the same words"
    rows = []
    for i in range(12):
        quoted = f"<p>{passage}</p>" if i in (4, 5) else ""
        rows.append((i, f"http://x.org/{i:02d}", f"<div>Site</div><article><p>{text.format(i)}</p>{quoted}<p>{share}</p></article>"))
    d = llm.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    got = {r["page_id"]: r["text"] for r in page_diff.extract_text(d).collect()}
    assert got == {i: text.format(i) + (f" {passage}" if i in (4, 5) else "") for i in range(12)}


def test_given_pages_give_their_articles(llm, sf):
    docs = {r["doc_id"]: r["text"] for r in llm.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet").collect()}
    pages = llm.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/pages.parquet")
    raw = {r["page_id"]: r["html"] for r in pages.collect()}
    for r in page_diff.extract_text(pages).collect():
        doc = re.search(r"(\d+)(?:\.html)?/?(?:[?#].*)?$", r["url"])[1]
        head = html.unescape(re.search("<h1>(.*?)</h1>", raw[r["page_id"]], re.S)[1])
        assert r["text"] == " ".join(f"{head} {docs[int(doc)]}".split())


# ---------------------------------------------------------------- language
def test_language_held_out(llm, sf):
    docs = llm.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language_id.fit_trigrams(docs.where("doc_id % 2 = 0"))
    out = language_id.identify(docs.where("doc_id % 2 = 1"), model, id_col="doc_id", text_col="text", url_col=None, html=False)
    d = out.join(docs.select("doc_id", F.col("lang").alias("truth")), "doc_id").toPandas()
    assert (d["lang"] == d["truth"]).mean() > 0.99


def test_evidence_fuses(llm, sf):
    docs = llm.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language_id.fit_trigrams(docs)
    by = {lang: [r["text"] for r in docs.where(f"lang = '{lang}' and length(text) > 300").limit(40).collect()] for lang in ("de", "en")}
    rows = [(i, f"http://h.{lang}site.{'de' if lang == 'de' else 'com'}/{i}", f'<html lang="{lang}"><p>{t}</p>') for lang in by for i, t in enumerate(by[lang])]
    rows += [(900, "http://h.desite.de/x", "<html lang=de><p>12 34</p>"), (901, "http://h.ensite.com/x", ""), (902, "http://h.desite.de/y", None), (None, None, None)]
    rows += [(903, "http://h.desite.de/z", f'<html lang="de"><p>{by["en"][0]}</p>')]
    d = llm.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, host string")
    got = {r["page_id"]: r for r in language_id.identify(d, model).collect()}
    assert got[900]["lang"] == got[902]["lang"] == "de" and got[901]["lang"] == "en"
    # a clear text outweighs a wrong declaration
    assert got[903]["lang"] == got[903]["text_lang"] == "en" and got[903]["declared"] == "de"
    assert Counter(r["declared"] for r in got.values())[None] == 3
    assert language_id.identify(d.limit(0), model).count() == 0


# ---------------------------------------------------------------- furniture inside articles
@pytest.mark.parametrize("page, want", [
    ('<article><div class="menu recipe"><p>The menu of the restaurant</p></div><p>Was good.</p></article>', "The menu of the restaurant Was good."),
    ('<article><p>Text.</p><div class="menu"><a href=x>One</a> <a href=y>Two</a></div></article>', "Text."),
    ('<article><p>Text.</p><div class="search notice">A notice on the search <a href=x>here</a> of lost dogs</div></article>', "Text. A notice on the search here of lost dogs"),
    ('<article><p>Text.</p><article class="comment"><p>Nice post!</p></article></article><article class="related"><p>Other story</p></article>', "Text."),
    ('<article><p>Text.</p><section id="comments"><p>First!</p></section><div class="ad">Buy</div><p>End.</p></article>', "Text. End."),
    ('<article class="comment story-1"><p>Only a comment</p></article><p>Body</p>', "Body"),
    ('<main><p>A</p><ul class="share"><li><a>x</a><li><a>y</a></ul><p>B</main>', "A B"),
    ('<article><div class="related"><a>all links</a>', ""),
])
def test_names_inside_an_article(page, want):
    assert " ".join(page_diff.page_lines(page)[0]) == want


def test_beta_bounds():
    rng = np.random.default_rng(0)
    for a, b in ((0.3, 0.9), (1, 1), (2.5, 40), (300, 3), (5000, 9000)):
        draws = rng.beta(a, b, 200_000)
        for q in (0.05, 0.5, 0.95):
            x = url_reputation.beta_quantile(q, a, b)
            assert abs(url_reputation.beta_cdf(x, a, b) - q) < 1e-9 and abs((draws <= x).mean() - q) < 0.005
    assert url_reputation.beta_cdf(0.25, 1, 1) == pytest.approx(0.25) and url_reputation.beta_cdf(0.5, 3, 3) == pytest.approx(0.5)


def test_a_few_bad_labels_do_not_block_but_many_do(llm):
    rows = [(f"http://few.example.com/{i}", 1) for i in range(2)] + [(f"http://many.example.org/{i}", 1) for i in range(200)]
    rows += [(f"http://good{i % 40}.example.net/{i}", 0) for i in range(800)] + [("http://none.example.net/" + "x" * 100_000, None), (None, None)]
    d = llm.createDataFrame(rows, "url string, bad int").withColumn("host", F.lit("x"))
    got = {r["host"]: r["verdict"] for r in url_reputation.judge_urls(d, [], 0.5).collect()}
    assert got["many.example.org"] == "block" and got["good3.example.net"] == got["none.example.net"] == got[""] == "allow"


def test_repeated_labels_give_a_page_once(llm, tmp_path):
    llm.createDataFrame([(1, "http://a.example.com/en/7.html", "<p>x"), (2, None, None)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    llm.createDataFrame([(7, 0, 0), (7, 1, 1), (7, 1, 0), (None, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert sorted(r["page_id"] for r in queries()["op2_url_reputation"](llm, str(tmp_path)).collect()) == [1, 2]


# ---------------------------------------------------------------- language: every step by hand
def _soft(x):
    e = np.exp(np.asarray(x) - np.max(x))
    return e / e.sum()


def brute_language(rows, model):
    """id -> posterior over the languages, from plain loops over (id, url, html)."""
    pages = []
    for i, url, page in rows:
        m = re.search(r"://([^/?#]*)", url or "")
        host = m[1].lower() if m else ""
        labels = host.split(".")
        two = len(labels) >= 2 and len(labels[-1]) == 2 and labels[-2] in url_reputation.SECOND_LEVEL
        size = 2 if two else 1
        said = re.search(r"<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", page or "", re.I)
        scores = np.array(language_id.text_scores(" ".join(page_diff.page_lines(page)[0]), model))
        pages.append({"id": i, "host": host, "domain": ".".join(labels[-size - 1 :]), "suffix": ".".join(labels[-size:]),
                      "declared": said[1].lower() if said else "", "scores": scores, "post": _soft(scores)})
    total = sum(p["post"] for p in pages)
    n = len(total)
    root = (total + 1) / (len(pages) + n)
    out = {}
    for p in pages:
        logs = p["scores"].copy()
        prior = root
        for level in ("domain", "host"):
            same = [q for q in pages if q[level] == p[level]]
            others = np.maximum(sum(q["post"] for q in same) - p["post"], 0)
            prior = (others + language_id.SMOOTHING * prior) / (len(same) - 1 + language_id.SMOOTHING)
        logs += np.log(prior)
        for kind in ("declared", "suffix"):
            if p[kind] != "":
                kinds = len({q[kind] for q in pages})
                logs += np.log((sum(q["post"] for q in pages if q[kind] == p[kind]) + 1) / (total + kinds))
        out.setdefault(p["id"], []).append(_soft(logs))
    return out


def test_fused_posterior_equals_brute_force(llm, sf):
    docs = llm.read.parquet(f"{sf.replace('sf0.001', 'sf0.01')}/documents.parquet")
    model = language_id.fit_trigrams(docs)
    texts = {lang: [r["text"] for r in docs.where(f"lang = '{lang}'").orderBy("doc_id").limit(6).collect()] for lang in language_id.LANGUAGES}
    rows = [(100 * k + i, f"http://{'ab'[i % 2]}.{lang}.co.uk/{i}" if k % 2 else f"https://WWW.{lang}site.com/{i}", f'<html lang="{lang if i % 3 else "xx"}"><p>{t}</p>')
            for k, lang in enumerate(texts) for i, t in enumerate(texts[lang])]
    rows += [(900, None, None), (901, "http://a.de.co.uk/", ""), (901, "http://a.de.co.uk/", ""), (902, "nourl", "<p>the of and " * 20_000), (None, "http://esite.com", "<html lang=es>1 2")]
    d = llm.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, suffix string, post string").repartition(3)
    want = brute_language(rows, model)
    got = language_id.identify(d, model).collect()
    assert len(got) == len(rows)
    for r in got:
        p = want[r["page_id"]][0]
        assert r["probability"] == pytest.approx(p.max(), abs=1e-9)
        assert r["lang"] == (language_id.LANGUAGES[int(p.argmax())] if p.max() >= 0.5 else "und")
