"""Language identification by Bayesian fusion of evidence.

For a page and each language, four sources of evidence multiply:

* text: naive Bayes over byte trigrams of the visible text.  Trigrams of a text
  depend on each other, so a text counts as at most ``EVIDENCE`` independent ones.
* declaration: how often pages in a language declare what this page declares in
  its markup (a wrong declaration is thereby weak evidence).
* suffix: how often pages in a language have this address suffix.
* host: the share of the language on the host, smoothed towards the share on its
  registered domain, and that towards all pages; the page itself is left out.

The last three are counted by grouped aggregations of the text posteriors over all
pages.  The trigram model is counted over all labelled documents, by partial count
vectors of fixed length; what is broadcast is that table, one number per trigram
bucket and language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from episodica.llm.common import require
from episodica.llm.page_diff import page_lines
from episodica.llm.url_reputation import host_parts, url_host
from episodica.plans.small import keep

#: trigram buckets, a power of two
BUCKETS = 1 << 15

#: independent trigrams that a text may count as
EVIDENCE = 60.0

#: pages that a prior of the next level counts as
SMOOTHING = 10.0

LANGUAGES = ("de", "en", "es", "fr")

_DECLARED = re.compile(r"<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z]{2,3})", re.I)


def trigrams(text: str | None) -> np.ndarray:
    """Bucket of every trigram of the lower-cased text in UTF-8, blanks at both ends."""
    raw = f" {text or ''} ".lower().encode("utf-8", "surrogatepass")
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, dtype=np.uint32)
    mixed = (b[:-2] * np.uint32(0x9E3779B1)) ^ (b[1:-1] * np.uint32(0x85EBCA6B)) ^ (b[2:] * np.uint32(0xC2B2AE35))
    return (mixed ^ (mixed >> np.uint32(15))) & np.uint32(BUCKETS - 1)


def fit_trigrams(docs: DataFrame, languages: Sequence[str] = LANGUAGES, text_col: str = "text", lang_col: str = "lang") -> np.ndarray:
    """log P(trigram | language), (BUCKETS, languages), from all documents labelled with one of them."""
    langs = list(languages)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((len(langs), BUCKETS), dtype=np.int64)
        for pdf in batches:
            for lang, text in zip(pdf["lang"], pdf["text"]):
                total[langs.index(lang)] += np.bincount(trigrams(text), minlength=BUCKETS)
        for i in range(len(langs)):
            at = np.flatnonzero(total[i])
            yield pd.DataFrame({"i": np.full(len(at), i, dtype=np.int32), "bucket": at.astype(np.int32), "n": total[i][at]})

    d = docs.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("lang").isin(*langs) & F.col("text").isNotNull())
    # at most BUCKETS * languages rows reach the driver
    rows = d.mapInPandas(count, "i int, bucket int, n long").groupBy("i", "bucket").agg(F.sum("n").alias("n")).toPandas()
    table = np.full((BUCKETS, len(langs)), 0.5)
    table[rows["bucket"], rows["i"]] += rows["n"].to_numpy()
    return np.log(table / table.sum(axis=0)).astype(np.float32)


def text_scores(text: str | None, model: np.ndarray) -> list[float]:
    """Tempered log-likelihoods of a text, the best 0; a text without letters says nothing."""
    t = trigrams(text)
    if not text or not len(t):
        return [0.0] * model.shape[1]
    total = np.zeros(model.shape[1])
    for i in range(0, len(t), 1 << 16):
        total += model[t[i : i + (1 << 16)]].sum(axis=0, dtype=np.float64)
    total *= min(1.0, EVIDENCE / len(t))
    return (total - total.max()).tolist()


def _scorer(model: np.ndarray, html: bool):
    schema = T.StructType([T.StructField("scores", T.ArrayType(T.DoubleType())), T.StructField("declared", T.StringType())])

    @F.pandas_udf(schema)
    def score(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            said = _DECLARED.search(t) if html and t else None
            rows.append((text_scores(" ".join(page_lines(t)[0]) if html else t, model), said[1].lower() if said else None))
        return pd.DataFrame(rows, columns=["scores", "declared"])

    return score


def _softmax(logs: Column) -> Column:
    e = F.transform(logs, lambda x: F.exp(x - F.array_max(logs)))
    return F.transform(e, lambda x: x / F.aggregate(e, F.lit(0.0), lambda a, b: a + b))


def _sums(n: int) -> list[Column]:
    return [F.sum(F.get("post", F.lit(i))).alias(f"s{i}") for i in range(n)]


def _array(n: int) -> Column:
    return F.array(*[F.col(f"s{i}") for i in range(n)])


def identify(
    pages: DataFrame,
    model: np.ndarray,
    languages: Sequence[str] = LANGUAGES,
    id_col: str = "page_id",
    text_col: str = "html",
    url_col: str | None = "url",
    html: bool = True,
    least: float = 0.5,
) -> DataFrame:
    """id, lang, probability, text_lang, declared and kept of every page.

    ``lang`` is the most probable language ('und' below the probability ``least``),
    ``text_lang`` that of the text alone, ``kept`` whether a language was found.
    Missing evidence (null or empty text, no declaration, null url) counts as
    none: the page falls back on its host, domain and all pages.  Ids may repeat or
    be null; extra columns are not read; no rows give no rows.
    """
    require(pages, id_col, text_col)
    n, langs = len(languages), F.array(*[F.lit(x) for x in languages])
    url = F.col(url_col) if url_col else F.lit(None).cast("string")
    d = pages.select(F.col(id_col).alias("id"), url_host(url).alias("host"), _scorer(model, html)(F.col(text_col)).alias("s"))
    domain, suffix = host_parts(F.col("host"))
    d = d.select("id", "host", "s.scores", F.coalesce("s.declared", F.lit("")).alias("declared"), domain.alias("domain"), suffix.alias("suffix"))
    d = keep(d.withColumn("post", _softmax(F.col("scores"))), "language-scores")

    ones = F.lit(1.0)
    # shares of languages: all pages (one row), domains, hosts
    every = d.agg(F.count(ones).alias("n"), *_sums(n))
    root = F.transform(_array(n), lambda s: (F.coalesce(s, F.lit(0.0)) + ones) / (F.col("n") + F.lit(float(n))))
    root = F.broadcast(every.select(root.alias("p0")))
    hosts = keep(d.groupBy("host", "domain").agg(F.count(ones).cast("double").alias("n"), *_sums(n)), "language-hosts")
    domains = hosts.groupBy("domain").agg(F.sum("n").alias("dn"), *[F.sum(f"s{i}").alias(f"s{i}") for i in range(n)])
    domains = domains.select("domain", "dn", _array(n).alias("ds"))
    hosts = hosts.select("host", F.col("domain").alias("d"), "n", _array(n).alias("hs"))
    hosts = hosts.join(domains.withColumnRenamed("domain", "d"), "d").drop("d")

    # P(value | language), smoothed, for declarations and suffixes; one row per distinct value
    def likelihood(col: str, out: str) -> DataFrame:
        by = d.groupBy(col).agg(*_sums(n)).select(col, _array(n).alias("c"))
        kinds = by.agg(F.count(ones).alias("kinds"))
        total = every.select(_array(n).alias("t")).crossJoin(kinds)
        logs = F.zip_with("c", "t", lambda c, t: F.log((c + ones) / (t + F.col("kinds"))))
        return by.crossJoin(F.broadcast(total)).select(col, F.when(F.col(col) == "", F.array_repeat(F.lit(0.0), n)).otherwise(logs).alias(out))

    d = d.join(hosts, "host").join(likelihood("declared", "l1"), "declared").join(likelihood("suffix", "l2"), "suffix").crossJoin(root)
    m = F.lit(SMOOTHING)
    # the page's own text is left out of the counts of its domain and host
    others = F.zip_with("ds", "post", lambda a, b: a - b)
    p1 = F.zip_with(others, "p0", lambda c, p: (F.greatest(c, F.lit(0.0)) + m * p) / (F.col("dn") - 1 + m))
    d = d.withColumn("p1", p1)
    others = F.zip_with("hs", "post", lambda a, b: a - b)
    prior = F.zip_with(others, "p1", lambda c, p: F.log((F.greatest(c, F.lit(0.0)) + m * p) / (F.col("n") - 1 + m)))
    d = d.withColumn("prior", prior)
    add = lambda a, b: F.zip_with(a, b, lambda x, y: x + y)
    d = d.withColumn("logs", add(add("scores", "prior"), add("l1", "l2"))).withColumn("p", _softmax(F.col("logs")))
    best = F.array_max("p")
    pick = lambda a: F.element_at(langs, F.array_position(a, F.array_max(a)).cast("int"))
    sure = best >= F.lit(least)
    return d.select(
        F.col("id").alias(id_col), F.when(sure, pick(F.col("p"))).otherwise("und").alias("lang"), best.alias("probability"),
        pick(F.col("post")).alias("text_lang"), F.nullif("declared", F.lit("")).alias("declared"), sure.alias("kept"),
    )
