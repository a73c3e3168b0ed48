"""The corpus operators on the given tables."""

from __future__ import annotations

import corpus_pipeline
from pyspark.sql import DataFrame, SparkSession, functions as F

from episodica.llm.bitplanes import token_table, word_tokenizer
from episodica.llm.common import prepare
from episodica.llm.entropy_mix import mix_copies
from episodica.llm.jaccard import jaccard_components
from episodica.llm.language_id import LANGUAGES, fit_trigrams, identify
from episodica.llm.lexical import search
from episodica.llm.line_windows import drop_repeated_lines
from episodica.llm.merkle import fold, leaf_hash, manifest, proof_text, sha
from episodica.llm.page_diff import extract_text
from episodica.llm.piece_bpe import piece_model, piece_round_trip
from episodica.llm.url_reputation import judge_urls, url_path
from episodica.llm.weak_supervision import judge_quality
from episodica.llm.wu_manber import find_benchmark
from episodica.llm.vector_shards import pack_shards
from episodica.registry import query


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf}/{name}.parquet")


query("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)


@query("op10_vector_shards")
def op10_vector_shards(spark: SparkSession, sf: str) -> DataFrame:
    out = pack_shards(table(spark, sf, "documents"), 8)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"), "tokens",
    )


@query("op4_bitplane_ids")
def op4_bitplane_ids(spark: SparkSession, sf: str) -> DataFrame:
    return token_table(spark, table(spark, sf, "documents"), word_tokenizer(), end_id=1)


@query("op7_entropy_mix")
def op7_entropy_mix(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mix_copies(table(spark, sf, "documents"), (5.0, 2.0, 1.0), 3.0)
    return mixed.select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "rate", "copies"
    )


@query("op6_weak_supervision")
def op6_weak_supervision(spark: SparkSession, sf: str) -> DataFrame:
    out = judge_quality(table(spark, sf, "documents"))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior"
    )


DECONTAMINATION_SQL = """
WITH az AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
item_words AS (
  SELECT item_id, regexp_extract_all(translate(text, up, low), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark, az WHERE text IS NOT NULL),
item_windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i : i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM item_words WHERE len(w) > 0)),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), up, low), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents, az),
lengths AS (SELECT DISTINCT m FROM item_windows),
doc_windows AS (
  SELECT doc_id, m, i, array_to_string(w[i : i + m - 1], ' ') AS s
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc_words, lengths WHERE len(w) >= m)),
occurs AS (SELECT doc_id, item_id, i, d.m FROM doc_windows d JOIN item_windows t ON d.s = t.s AND d.m = t.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occurs) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids
  FROM occurs GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@query("op1_wu_manber", DECONTAMINATION_SQL)
def op1_wu_manber(spark: SparkSession, sf: str) -> DataFrame:
    found = find_benchmark(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 10)
    return found.select(
        "doc.doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


URL_RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"),
]

#: as in the query: a page is labelled through the document its path names
REPUTATION_SQL = """
WITH p AS (
  SELECT page_id, url, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
o AS (
  SELECT p.*, bad
  FROM p LEFT JOIN (SELECT doc_id, max(CASE WHEN quality = 0 OR toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id) ON TRY_CAST(nullif(regexp_extract(path, '([0-9]+)(?:\\.html)?/?$', 1), '') AS BIGINT) = doc_id),
h0 AS (SELECT host, count(bad) AS n, coalesce(sum(bad), 0) AS k, string_split(regexp_replace(host, ':[0-9]*$', ''), '.') AS l FROM o GROUP BY host),
h1 AS (SELECT *, CASE WHEN len(l) >= 2 AND length(l[-1]) = 2 AND l[-2] IN ('ac', 'co', 'com', 'edu', 'gov', 'net', 'org') THEN 2 ELSE 1 END AS s FROM h0),
h AS (SELECT host, n, k, array_to_string(l[greatest(1, len(l) - s) :], '.') AS domain, array_to_string(l[greatest(1, len(l) - s + 1) :], '.') AS suffix FROM h1),
root AS (SELECT (sum(k) + 1) / (sum(n) + 2) AS m0 FROM h),
s0 AS (SELECT suffix, sum(n) AS n, sum(k) AS k, any_value(m0) AS p FROM h, root GROUP BY suffix),
s1 AS (SELECT least(1000, greatest(1, 1 / greatest(coalesce((sum(n * pow(k / n - p, 2) / (p * (1 - p))) FILTER (n > 0) - count(*) FILTER (n > 0))
    / sum(n - 1) FILTER (n > 1), 0), 1e-6) - 1)) AS st FROM s0),
sfx AS (SELECT suffix, (st * p + k) / (st + n) AS m1 FROM s0, s1),
d0 AS (SELECT domain, sum(n) AS n, sum(k) AS k, any_value(m1) AS p FROM h JOIN sfx USING (suffix) GROUP BY domain),
d1 AS (SELECT least(1000, greatest(1, 1 / greatest(coalesce((sum(n * pow(k / n - p, 2) / (p * (1 - p))) FILTER (n > 0) - count(*) FILTER (n > 0))
    / sum(n - 1) FILTER (n > 1), 0), 1e-6) - 1)) AS st FROM d0),
dom AS (SELECT domain, (st * p + k) / (st + n) AS m2 FROM d0, d1),
e0 AS (SELECT host, n, k, m2 AS p FROM h JOIN dom USING (domain)),
e1 AS (SELECT least(1000, greatest(1, 1 / greatest(coalesce((sum(n * pow(k / n - p, 2) / (p * (1 - p))) FILTER (n > 0) - count(*) FILTER (n > 0))
    / sum(n - 1) FILTER (n > 1), 0), 1e-6) - 1)) AS st FROM e0),
e AS (SELECT host, (st * p + k) / (st + n) AS m, st * p + k AS a, st * (1 - p) + n - k AS b FROM e0, e1),
-- I(a, b), the chance of a share up to one half, by its continued fraction; the smaller side converges
g AS (SELECT host, greatest(a, b) AS p, least(a, b) AS q, a >= b AS bad_side, lgamma(a + b) - lgamma(a) - lgamma(b) + (a + b) * ln(0.5::DOUBLE) AS front FROM e),
cf AS (SELECT *, list_reduce(list_transform(range(1, 400), lambda i: {'c': CAST(i AS DOUBLE), 'd': 0.0::DOUBLE, 'h': 0.0::DOUBLE}),
  lambda s, t: {
    'c': 1 + (CASE WHEN CAST(t.c AS BIGINT) % 2 = 0 THEN (t.c / 2) * (q - t.c / 2) * 0.5 / ((p + t.c - 1) * (p + t.c))
      ELSE -(p + (t.c - 1) / 2) * (p + q + (t.c - 1) / 2) * 0.5 / ((p + t.c - 1) * (p + t.c)) END) / s.c,
    'd': 1 / (1 + (CASE WHEN CAST(t.c AS BIGINT) % 2 = 0 THEN (t.c / 2) * (q - t.c / 2) * 0.5 / ((p + t.c - 1) * (p + t.c))
      ELSE -(p + (t.c - 1) / 2) * (p + q + (t.c - 1) / 2) * 0.5 / ((p + t.c - 1) * (p + t.c)) END) * s.d),
    'h': s.h * (1 + (CASE WHEN CAST(t.c AS BIGINT) % 2 = 0 THEN (t.c / 2) * (q - t.c / 2) * 0.5 / ((p + t.c - 1) * (p + t.c))
      ELSE -(p + (t.c - 1) / 2) * (p + q + (t.c - 1) / 2) * 0.5 / ((p + t.c - 1) * (p + t.c)) END) / s.c)
      / (1 + (CASE WHEN CAST(t.c AS BIGINT) % 2 = 0 THEN (t.c / 2) * (q - t.c / 2) * 0.5 / ((p + t.c - 1) * (p + t.c))
      ELSE -(p + (t.c - 1) / 2) * (p + q + (t.c - 1) / 2) * 0.5 / ((p + t.c - 1) * (p + t.c)) END) * s.d)},
  {'c': 1e300::DOUBLE, 'd': 1.0::DOUBLE, 'h': 1.0::DOUBLE}).h AS h FROM g),
v AS (SELECT host, CASE WHEN (CASE WHEN bad_side THEN exp(front) * h / p ELSE 1 - exp(front) * h / p END) < 0.05 THEN 'block' ELSE 'allow' END AS method FROM cf),
r AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR host LIKE '%.www.example.com') AND path LIKE '/en/%' THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND path LIKE '/en/%' THEN 'example.com/en/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/es/%' THEN 'net/es/'
  WHEN (host = 'net' OR host LIKE '%.net') AND path LIKE '/fr/%' THEN 'net/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND path LIKE '/%' THEN 'com/' END AS rule FROM p)
SELECT page_id, r.host AS host, path, rule,
  CASE WHEN rule IN ('com/', 'www.example.com/en/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' ELSE method END AS verdict
FROM r JOIN v ON r.host = v.host
"""


@query("op2_url_reputation", REPUTATION_SQL)
def op2_url_reputation(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select("page_id", "url")
    bad = F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1).otherwise(0)
    # one label a document, however often it was labelled
    labels = table(spark, sf, "labels").where("doc_id is not null").groupBy("doc_id").agg(F.max(bad).alias("bad"))
    # a page shows the document that its path names
    named = F.expr("try_cast(nullif(regexp_extract(__path, '([0-9]+)(?:[.]html)?/?$', 1), '') as bigint)")
    pages = pages.withColumn("__path", url_path(F.col("url"))).withColumn("__doc", named)
    judged = judge_urls(pages.join(labels, pages["__doc"] == labels["doc_id"], "left"), URL_RULES, 0.5)
    return judged.select("page_id", "host", "path", "rule", "verdict")


@query("op5_page_diff")
def op5_page_diff(spark: SparkSession, sf: str) -> DataFrame:
    return extract_text(table(spark, sf, "pages")).select("page_id", "url", "text", "n_chars")


LINES_SQL = """
WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
f AS (SELECT doc_id, l, list_filter(range(1, len(l) + 1), lambda i: regexp_matches(l[i], '[^\\x20\\x09-\\x0D]')) AS p FROM l WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, p, m, array_to_string(list_transform(p[i : i + m - 1], lambda j: l[j]), chr(10)) AS s
  FROM (SELECT *, least(len(p), 3) AS m, unnest(range(1, greatest(len(p) - 2, 1) + 1)) AS i FROM f WHERE len(p) > 0)),
r AS (SELECT doc_id, i, p, m, row_number() OVER (PARTITION BY s, m ORDER BY doc_id, i) AS rn FROM w),
gone AS (SELECT DISTINCT doc_id, unnest(p[i : i + m - 1]) AS pos FROM r WHERE rn > 1),
x AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS pos, unnest(l) AS line FROM l WHERE text IS NOT NULL),
k AS (SELECT x.doc_id, string_agg(line, chr(10) ORDER BY x.pos) AS t, count(*) AS n FROM x ANTI JOIN gone
  ON x.doc_id = gone.doc_id AND x.pos = gone.pos GROUP BY x.doc_id)
SELECT l.doc_id, CASE WHEN text IS NULL THEN NULL ELSE coalesce(t, '') END AS text,
  CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(l) - coalesce(n, 0), 0) AS BIGINT) AS n_removed
FROM l LEFT JOIN k ON l.doc_id = k.doc_id
"""


@query("op8_line_windows", LINES_SQL)
def op8_line_windows(spark: SparkSession, sf: str) -> DataFrame:
    return drop_repeated_lines(table(spark, sf, "documents").select("doc_id", "text"))


@query("op9_language_fusion")
def op9_language_fusion(spark: SparkSession, sf: str) -> DataFrame:
    """Pages (with address and markup) and documents (text alone), one row each."""
    docs = table(spark, sf, "documents")
    model = fit_trigrams(docs, LANGUAGES)
    pages = identify(table(spark, sf, "pages"), model)
    texts = identify(docs.select("doc_id", "text"), model, id_col="doc_id", text_col="text", url_col=None, html=False)
    return pages.withColumn("doc_id", F.lit(None).cast("long")).unionByName(texts.withColumn("page_id", F.lit(None).cast("long")))


JACCARD_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 2], ' ') AS x
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
c AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS same FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN c ca ON a = ca.doc_id JOIN c cb ON b = cb.doc_id WHERE 100 * same >= 90 * (ca.n + cb.n - same)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(doc_id, comp) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.comp FROM r JOIN e ON r.doc_id = e.a)
SELECT d.doc_id, CAST(coalesce(c.n, 0) AS BIGINT) AS n_shingles, m.component_id
FROM documents d JOIN (SELECT doc_id, min(comp) AS component_id FROM r GROUP BY doc_id) m ON d.doc_id = m.doc_id
LEFT JOIN c ON d.doc_id = c.doc_id
"""


@query("op3_jaccard_orders", JACCARD_SQL)
def op3_jaccard_orders(spark: SparkSession, sf: str) -> DataFrame:
    return jaccard_components(table(spark, sf, "documents"), 3, 90, 100).select("doc_id", "n_shingles", "component_id")


@query("op11_piece_bpe")
def op11_piece_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = piece_round_trip(table(spark, sf, "documents"), piece_model())
    digits = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return coded.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits.cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


MERKLE_FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def _sql_leaf(text: str) -> str:
    values = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"CASE WHEN {v} IS NULL THEN '-' ELSE CAST(strlen({v}) AS VARCHAR) || ':' || {v} END" for v in values) + ")"


#: levels are lists, one row per source and level; crc32 takes its digits through eight shifts each
MERKLE_SQL = f"""
WITH RECURSIVE
digits(doc_id, s, c) AS (
  SELECT DISTINCT doc_id, CAST(doc_id AS VARCHAR), CAST(4294967295 AS BIGINT) FROM documents
  UNION ALL
  SELECT doc_id, s[2:], list_reduce(range(1, 9), lambda x, y: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END), xor(c, CAST(ascii(s[1]) AS BIGINT)))
  FROM digits WHERE s <> ''),
leaf AS (
  SELECT doc_id, source, {_sql_leaf("text")} AS leaf, c & 1 = 1 AS tampered,
    {_sql_leaf("replace(text, chr(10), '')")} AS other,
    row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS pos
  FROM documents JOIN digits USING (doc_id) WHERE s = ''),
lv(source, h, nodes) AS (
  SELECT source, 0, list(leaf ORDER BY doc_id) FROM leaf GROUP BY source
  UNION ALL
  SELECT source, h + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))
  FROM lv WHERE len(nodes) > 1),
top AS (SELECT source, nodes[1] AS subroot, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS pos FROM lv WHERE len(nodes) = 1),
tv(h, nodes) AS (
  SELECT 0, list(subroot ORDER BY pos) FROM top
  UNION ALL
  SELECT h + 1, list_transform(range(0, (len(nodes) + 2) // 3), lambda i: sha256(array_to_string(nodes[3 * i + 1 : 3 * i + 3], '')))
  FROM tv WHERE len(nodes) > 1),
places AS (
  SELECT doc_id, h AS k, nodes, pos // CAST(pow(3, h) AS BIGINT) AS p FROM leaf JOIN lv ON leaf.source IS NOT DISTINCT FROM lv.source WHERE len(nodes) > 1
  UNION ALL
  SELECT doc_id, 1000 + h, nodes, top.pos // CAST(pow(3, h) AS BIGINT) FROM leaf JOIN top ON leaf.source IS NOT DISTINCT FROM top.source, tv WHERE len(nodes) > 1),
steps AS (
  SELECT doc_id, k, array_to_string(nodes[p // 3 * 3 + 1 : p], '') AS l, array_to_string(nodes[p + 2 : p // 3 * 3 + 3], '') AS r FROM places),
paths AS (SELECT doc_id, list(l ORDER BY k) AS l, list(r ORDER BY k) AS r, string_agg(l || r, '' ORDER BY k) AS proof FROM steps GROUP BY doc_id),
folded(doc_id, i, cur, l, r) AS (
  SELECT doc_id, 1, CASE WHEN tampered THEN other ELSE leaf END, coalesce(l, []), coalesce(r, []) FROM leaf LEFT JOIN paths USING (doc_id)
  UNION ALL
  SELECT doc_id, i + 1, sha256(l[i] || cur || r[i]), l, r FROM folded WHERE i <= len(l))
SELECT leaf.doc_id, leaf, subroot, tv.nodes[1] AS root, sha256(coalesce(proof, '')) AS proof_sha256, cur AS folded_root, cur = tv.nodes[1] AS verified
FROM leaf JOIN top ON leaf.source IS NOT DISTINCT FROM top.source LEFT JOIN paths ON leaf.doc_id = paths.doc_id
JOIN folded ON leaf.doc_id = folded.doc_id AND i = len(folded.l) + 1, tv WHERE len(tv.nodes) = 1
"""


@query("op13_merkle_manifest", MERKLE_SQL)
def op13_merkle_manifest(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    # where 2 divides the crc32 of the id, someone has deleted the line ends
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    other = leaf_hash([F.col(c) if c != "text" else F.replace(F.col(c), F.lit("\n"), F.lit("")) for c in MERKLE_FIELDS])
    made = manifest(docs, MERKLE_FIELDS, also={"tampered": F.when(touched, other)})
    out = made.withColumn("folded_root", fold(F.coalesce("tampered", "leaf"), F.col("path")))
    return out.select(
        "doc_id", "leaf", "subroot", "root", sha(proof_text(F.col("path"))).alias("proof_sha256"), "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


SEARCH_SQL = """
WITH az AS (SELECT 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' AS up, 'abcdefghijklmnopqrstuvwxyz' AS low),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(text, up, low), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM documents, az),
n AS (SELECT doc_id, count(*) AS n FROM d GROUP BY doc_id),
c AS (SELECT CAST(count(*) AS BIGINT) AS nn, CAST(sum(n) AS BIGINT) AS l FROM n),
q AS (SELECT DISTINCT item_id, t FROM (
  SELECT item_id, unnest(regexp_extract_all(translate(text, up, low), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t FROM benchmark, az)),
p AS (SELECT t, doc_id, count(*) AS tf FROM d WHERE t IN (SELECT t FROM q) GROUP BY t, doc_id),
w AS (SELECT t, CAST(floor(1000 * ln((2.0::DOUBLE * nn + 2) / (2.0::DOUBLE * count(*) + 1))) AS BIGINT) AS w FROM p, c GROUP BY t, nn),
i AS (SELECT t, p.doc_id, w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * nn) // l))) AS s FROM p JOIN w USING (t) JOIN n USING (doc_id), c),
r AS (SELECT item_id, doc_id, CAST(sum(s) AS BIGINT) AS score FROM q JOIN i USING (t) GROUP BY item_id, doc_id HAVING sum(s) > 0),
k AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM r)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""


@query("op12_hybrid_search", SEARCH_SQL)
def op12_hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    return search(table(spark, sf, "documents"), table(spark, sf, "benchmark"), 10)
