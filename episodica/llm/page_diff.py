"""Main text of web pages by differencing each page with its nearest neighbour.

A page becomes a list of text lines (blocks).  Elements whose markup names them as
furniture (menus, headers, footers, forms, adverts, comments, ...) give no lines.
Pages are ordered by host and URL path; a page is compared with the neighbour of
the same host whose path is nearer: the lines of both are aligned by their longest
common subsequence, and what they share is template and is deleted.

Two rules keep real text.  Articles quote each other, so what two of them share need
not be template: of a page with <article> or <main> the lines in there are the
text, and one that its neighbour shares is deleted only if at least half of the
host's different pages, and COMMON_PAGES of them, have it.  As a
neighbour such a page counts with its lines outside the article too.  And pages
of a host with equal lines are compared as one, at the first of their paths, so
that a run of copies meets the next different page; pages without lines are
passed over.  A neighbour that differs but shares at least half of the text is a
near copy, not another page of the same template, so the other neighbour is
taken, or none.

Only hashes of lines are ordered and compared; the pages meet the list of
deleted lines in a join, and most pages have no such list.
"""

from __future__ import annotations

import html as _html
import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F, types as T

from episodica.llm.common import require
from episodica.llm.url_reputation import url_host, url_path
from episodica.plans.small import keep, lookup

# fixed values: element names of the HTML standard
_RAW = {"script", "style", "noscript", "template", "title", "textarea", "iframe", "svg", "math", "object", "xmp"}
_FURNITURE = {"nav", "header", "footer", "aside", "form", "menu", "dialog", "button", "select", "head"}
_CORE = {"article", "main"}
_INLINE = {
    "a", "abbr", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label",
    "mark", "q", "s", "samp", "small", "span", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: elements that may end without an end tag; they are never on the stack
_LOOSE = {"p", "li", "dt", "dd", "tr", "td", "th", "thead", "tbody", "tfoot", "option", "rt", "rp", "caption", "colgroup"}
_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "dialog", "alert"}
#: parts of class and id values that name furniture
_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "banner", "sponsor", "sponsored", "promo", "sidebar", "menu", "nav", "navbar",
    "breadcrumb", "breadcrumbs", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter",
    "subscribe", "signup", "login", "share", "sharing", "social", "related", "recommended", "comment", "comments", "disqus", "reply",
    "replies", "respond", "pagination", "pager", "widget", "toolbar", "masthead", "footer", "footnav", "topbar", "skip", "search",
}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_ATTR = re.compile(r"(class|id|role|hidden|aria-hidden)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?", re.I)


#: pages of a host that have a line, at least, before it can be template inside an article
COMMON_PAGES = 4

#: of these, names of what is no text of an article wherever it stands
_ALIEN = {
    "ad", "ads", "advert", "adverts", "advertisement", "sponsor", "sponsored", "comment", "comments", "disqus", "reply", "replies", "respond",
}
#: names of an <article> that leads to another one
_TEASER = _ALIEN | {"related", "recommended", "teaser", "promo"}


def _is_furniture(name: str, attrs: str, inside: bool = False) -> bool | None:
    """Whether an element is furniture; None if only its structure can tell.

    ``inside`` an article a name like "menu" or "notice" may well be the subject: there
    the block goes if most of its text is links.
    """
    if name in _FURNITURE:
        return True
    if not attrs or name in ("html", "body"):
        return False
    doubt = False
    for key, value in _ATTR.findall(attrs):
        key, value = key.lower(), value.strip("\"'").lower()
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "role" and value in _ROLES):
            return True
        if key in ("class", "id"):
            names = set(re.split(r"[^a-z0-9]+", value))
            if name in _CORE:
                if name == "article" and not _TEASER.isdisjoint(names):
                    return True
            elif not _NAMES.isdisjoint(names):
                if not inside or not _ALIEN.isdisjoint(names):
                    return True
                doubt = True
    return None if doubt else False


def marked_lines(page: str | None) -> list[tuple[str, bool]]:
    """Text lines of a page in order, each with whether it is inside an <article> or <main>.

    Unclosed elements end with their parent or the page; markup cut off at the end
    is text.  White space in a line is one blank; empty lines are left out.
    """
    if not page:
        return []
    lines: list[tuple[str, bool]] = []
    stack: list[tuple] = []  # name, skipped, core, and where a doubtful block began
    held: list[str] = []
    skip = inside = False
    # characters of text so far, and of those inside links
    seen = linked = 0
    link = False

    def flush() -> None:
        if held:
            line = " ".join(_html.unescape("".join(held)).split())
            if line:
                lines.append((line, inside))
            held.clear()

    def take(text: str) -> None:
        nonlocal seen, linked
        held.append(text)
        n = len(text.strip())
        seen, linked = seen + n, linked + n * link

    def end(block: tuple) -> None:
        began = block[3]
        # furniture by structure: at least half of the block's text is links
        if began is not None and seen > began[1] and 2 * (linked - began[2]) >= seen - began[1]:
            del lines[began[0] :]

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if m is None:
            if not skip:
                take(page[at:])
            break
        if m.start() > at and not skip:
            take(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name, closing = name.lower(), m[1] or m[4]
        if name not in _INLINE:
            flush()
        if name == "a":
            link = not closing
        if closing:
            if name in _LOOSE or name in _INLINE:
                continue
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    for block in reversed(stack[k:]):
                        end(block)
                    del stack[k:]
                    skip, inside = (stack[-1][1], stack[-1][2]) if stack else (False, False)
                    break
            continue
        if name in _RAW:
            over = re.compile(rf"</{re.escape(name)}[^>]*>", re.I).search(page, at)
            at = over.end() if over else n
        elif name not in _VOID and name not in _LOOSE and name not in _INLINE:
            attrs = m[3] or m[6] or ""
            furniture = _is_furniture(name, attrs, inside)
            skip = skip or furniture is True
            inside = inside or (name in _CORE and not skip)
            if not attrs.endswith("/"):
                stack.append((name, skip, inside, (len(lines), seen, linked) if furniture is None else None))
    flush()
    for block in reversed(stack):
        end(block)
    return lines


def page_lines(page: str | None) -> tuple[list[str], bool]:
    """(text lines, whether they come from an <article> or <main>) of a page."""
    lines = marked_lines(page)
    core = [x for x, inside in lines if inside]
    return (core, True) if core else ([x for x, _ in lines], False)


def common_lines(a: list[int], b: list[int]) -> list[int]:
    """Places in ``a`` of a longest common subsequence of ``a`` and ``b``."""
    where: dict[int, list[int]] = {}
    for j, x in enumerate(b):
        where.setdefault(x, []).append(j)
    tails: list[int] = []  # smallest end in b of a common run of each length
    ends: list[tuple[int, int | None]] = []  # (place in a, link) of those runs
    links: list[tuple[int, int | None]] = []
    for i, x in enumerate(a):
        for j in reversed(where.get(x, ())):
            k = bisect_left(tails, j)
            links.append((i, ends[k - 1][1] if k else None))
            entry = (j, len(links) - 1)
            if k == len(tails):
                tails.append(j)
                ends.append(entry)
            elif j < tails[k]:
                tails[k], ends[k] = j, entry
    out, link = [], ends[-1][1] if ends else None
    while link is not None:
        i, link = links[link]
        out.append(i)
    return out[::-1]


def shared_lines(page: dict, neighbours: list[dict | None]) -> list[int]:
    """Line numbers shared with the nearest neighbour of the host that is no copy; in an article if the page has one."""
    if not page["hashes"]:
        return []
    near = [x for x in neighbours if x is not None and x["host"] == page["host"] and x["hashes"]]
    core = any(page["inside"])
    own = [i for i, inside in enumerate(page["inside"]) if inside or not core]

    def prefix(x: dict) -> int:
        p, q = page["path"], x["path"]
        return next((i for i, (c, d) in enumerate(zip(p, q)) if c != d), min(len(p), len(q)))

    for x in sorted(near, key=lambda x: -prefix(x)):
        both = set(common_lines(page["hashes"], x["hashes"])).intersection(own)
        if 2 * sum(page["sizes"][i] for i in both) < sum(page["sizes"][i] for i in own):
            return sorted(both)
    return []


_RECORD = T.StructType([
    T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("host", T.StringType()),
    T.StructField("path", T.StringType()), T.StructField("inside", T.ArrayType(T.BooleanType())),
    T.StructField("hashes", T.ArrayType(T.LongType())), T.StructField("sizes", T.ArrayType(T.IntegerType())),
])
_DIGEST = T.StructType(_RECORD.fields[4:])
_EDGE = T.StructType([
    T.StructField("k1", T.LongType()), T.StructField("k2", T.LongType()), T.StructField("gone", T.ArrayType(T.IntegerType())),
    T.StructField("part", T.IntegerType()), T.StructField("place", T.IntegerType()), T.StructField("page", _RECORD),
    T.StructField("before", _RECORD), T.StructField("after", _RECORD),
])


def _line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - (1 << 63)


@F.pandas_udf(_DIGEST)
def _digest(pages: pd.Series) -> pd.DataFrame:
    rows = []
    for p in pages:
        lines = marked_lines(p)
        rows.append(([inside for _, inside in lines], [_line_hash(x) for x, _ in lines], [len(x) for x, _ in lines]))
    return pd.DataFrame(rows, columns=["inside", "hashes", "sizes"])


@F.pandas_udf(T.StringType())
def _text(pages: pd.Series, gone: pd.Series) -> pd.Series:
    out = []
    for p, g in zip(pages, gone):
        if g is None or not len(g):
            out.append(" ".join(page_lines(p)[0]))
            continue
        drop, lines = set(g), marked_lines(p)
        core = any(inside for _, inside in lines)
        out.append(" ".join(x for i, (x, inside) in enumerate(lines) if i not in drop and (inside or not core)))
    return pd.Series(out, dtype=object)


def _compare(batches: Iterator) -> Iterator:
    """Sorted pages -> lists of deleted lines; pages at the ends of a partition are handed on whole."""
    import pyarrow as pa
    from pyspark import TaskContext
    from pyspark.sql.pandas.types import to_arrow_schema

    part, schema = TaskContext.get().partitionId(), to_arrow_schema(_EDGE)
    before = page = None
    place, out = 0, []

    def row(gone, place, page, before, after):
        return {"k1": page["k1"], "k2": page["k2"], "gone": gone, "part": part, "place": place,
                "page": page if place else None, "before": before if place else None, "after": after if place else None}

    # place: 1 first of the partition, 2 last, 3 both, 0 neither
    for batch in batches:
        for after in batch.to_pylist():
            if page is not None:
                if before is None:
                    out.append(row(None, 1, page, None, after))
                else:
                    gone = shared_lines(page, [before, after])
                    if gone:
                        out.append(row(gone, 0, page, None, None))
                if len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
            before, page = page, after
    if page is not None:
        out.append(row(None, 3 if before is None else 2, page, before, None))
    if out:
        yield pa.RecordBatch.from_pylist(out, schema)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def _compare_edge(page: pd.DataFrame, before: pd.DataFrame, after: pd.DataFrame) -> pd.Series:
    def rec(frame: pd.DataFrame, i: int) -> dict | None:
        x = frame.iloc[i].to_dict()
        return None if x["hashes"] is None else x | {c: list(x[c]) for c in ("inside", "hashes", "sizes")}

    return pd.Series([shared_lines(rec(page, i), [rec(before, i), rec(after, i)]) for i in range(len(page))], dtype=object)


def _template(gone: DataFrame, first: DataFrame) -> DataFrame:
    """Of the shared lines (k1, k2, gone) those that are template; in an article most pages of the host must have them."""
    lines = gone.join(first.select("k1", "k2", "host", "inside", "hashes"), ["k1", "k2"]).withColumn("i", F.explode("gone"))
    lines = keep(lines.select("k1", "k2", "i", "host", F.expr("hashes[i]").alias("line"), F.expr("inside[i]").alias("core")), "page-shared")
    core = lines.where("core")
    having = first.select("host", F.explode(F.array_distinct("hashes")).alias("line"))
    having = having.join(core.select("host", "line").distinct(), ["host", "line"], "left_semi").groupBy("host", "line").agg(F.count(F.lit(1)).alias("having"))
    pages = first.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    common = having.join(pages, "host").where((F.col("having") >= COMMON_PAGES) & (2 * F.col("having") >= F.col("pages"))).select("host", "line")
    lines = lines.where("not core").unionByName(core.join(common, ["host", "line"], "left_semi"))
    return lines.groupBy("k1", "k2").agg(F.sort_array(F.collect_list("i")).alias("gone"))


def deleted_lines(pages: DataFrame, keys: list[Column], url: Column, html: Column) -> DataFrame:
    """(k1, k2, gone): numbers of the lines to delete, for pages that lose any."""
    d = pages.select(keys[0].alias("k1"), keys[1].alias("k2"), url_host(url).alias("host"), url_path(url).alias("path"), _digest(html).alias("d"))
    d = d.select("k1", "k2", "host", "path", "d.inside", "d.hashes", "d.sizes")
    same = [F.xxhash64(F.lit(seed), "host", "inside", "hashes") for seed in (3, 4)]
    d = keep(d.where(F.size("hashes") > 0).withColumns({"c1": same[0], "c2": same[1]}), "page-lines")
    # pages of a host with equal lines are one page of the comparison
    first = d.groupBy("host", "c1", "c2").agg(F.min(F.struct("path", "inside", "hashes", "sizes")).alias("f"))
    first = keep(first.select(F.col("c1").alias("k1"), F.col("c2").alias("k2"), "host", "f.*"), "page-firsts")
    order = ["host", "path", "k1", "k2"]
    found = keep(first.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_compare, _EDGE), "page-compare")
    # at most two rows per partition
    w = W.orderBy("part", "place")
    edges = found.where("place > 0").withColumns({"lag": F.lag("page").over(w), "lead": F.lead("page").over(w)})
    before, after = F.coalesce("before", "lag"), F.coalesce("after", "lead")
    edges = edges.select("k1", "k2", _compare_edge(F.col("page"), before, after).alias("gone"))
    gone = found.where("place = 0").select("k1", "k2", "gone").union(edges).where(F.size("gone") > 0)
    gone = lookup(_template(gone, first).select(F.col("k1").alias("c1"), F.col("k2").alias("c2"), "gone"), 20_000)
    gone = d.select("k1", "k2", "c1", "c2").join(gone, ["c1", "c2"])
    return keep(gone.groupBy("k1", "k2").agg(F.max("gone").alias("gone")), "page-deleted")


def extract_text(pages: DataFrame, url_col: str = "url", html_col: str = "html", id_col: str = "page_id") -> DataFrame:
    """``pages`` without the html, with text and n_chars (code points) added.

    Null and empty pages have an empty text.  Pages without a host are neighbours
    of each other.  Rows with the same id, url and html are one page and get the
    same text.  Columns text and n_chars are replaced; no rows give no rows.
    """
    require(pages, url_col, html_col, id_col)
    cols = [F.col(id_col), F.col(url_col), F.col(html_col)]
    keys = [F.xxhash64(F.lit(1), *cols), F.xxhash64(F.lit(2), *cols)]
    gone = deleted_lines(pages, keys, F.col(url_col), F.col(html_col))
    others = [c for c in pages.columns if c not in ("text", "n_chars", html_col)]
    d = pages.select(F.struct(*others).alias("p"), F.col(html_col).alias("html"), keys[0].alias("k1"), keys[1].alias("k2"))
    d = d.join(gone, ["k1", "k2"], "left").select("p", _text(F.col("html"), F.col("gone")).alias("text"))
    return d.select("p.*", "text", F.length("text").cast("long").alias("n_chars"))
