"""Quality rules as weak supervision.

Rules vote good, bad or abstain on a document.  Nobody labels documents: the
rules' accuracies are estimated by expectation-maximisation from how they agree,
and a document is kept by its posterior probability of being good, not by
passing every rule.

A document's votes are one of 3 ** len(RULES) patterns.  Counting patterns over
all documents is one grouped aggregation with a proven bound on its result, and
EM on the counts equals EM on the documents, whatever their number.
"""

from __future__ import annotations

import warnings

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from episodica.llm.common import require
from episodica.plans.small import keep

_SPACE = b" \t\n\r\x0b\x0c"
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123)) + bytes(range(128, 256))
_SYMBOLS = "#*$%&|<>"

#: words in a repeated window
WINDOW = 8

#: name, measure, vote: (good from, good to, bad below, bad above); outside both it abstains
RULES = [
    ("few symbols", "symbols", (0.0, 0.02, -1.0, 0.1)),
    ("no repeated passages", "repeats", (0.0, 0.05, -1.0, 0.3)),
    ("no repeated lines", "dup_lines", (0.0, 0.0, -1.0, 0.5)),
    ("usual word length", "word_length", (3.5, 7.0, 2.5, 10.0)),
    ("mostly letters", "letters", (0.85, 1.0, 0.7, 2.0)),
    ("usual punctuation", "punctuation", (0.04, 0.45, 0.01, 0.8)),
    ("varied words", "variety", (0.6, 1.0, 0.4, 2.0)),
    ("no shouting", "upper", (0.0, 0.15, -1.0, 0.4)),
    ("no stuttering", "stutter", (0.0, 0.03, -1.0, 0.15)),
    ("lines end as sentences", "sentence_ends", (0.9, 1.0, 0.4, 2.0)),
]

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_SCHEMA = T.StructType([T.StructField(c, T.LongType()) for c in BASE] + [T.StructField("pattern", T.IntegerType())])


def repeat_cover(h: np.ndarray, window: int = WINDOW) -> int:
    """Words inside windows that occur twice or more, from the words' hashes."""
    n = len(h) - window + 1
    if n < 2:
        return 0
    g = np.zeros(n, dtype=np.uint64)
    for i in range(window):
        g = g * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n]
        g ^= g >> np.uint64(29)
    order = np.sort(g)
    same = order[1:] == order[:-1]
    if not same.any():
        return 0
    hit = np.flatnonzero(np.isin(g, order[1:][same]))
    edge = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(edge, hit, 1)
    np.add.at(edge, hit + window, -1)
    return int((np.cumsum(edge[:-1]) > 0).sum())


def measure(text: str | None) -> tuple[list[int], dict[str, float]]:
    """Base counts and the measures of the rules; a null text has no words."""
    text = text or ""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(raw.count(c) for c in (b" ", b"\t", b"\n", b"\r", b"\x0b", b"\x0c"))
    symbols = sum(map(text.count, _SYMBOLS))
    seen, dup, lines, ends = set(), 0, 0, 0
    for line in raw.split(b"\n"):
        body = line.rstrip()
        if body:
            lines += 1
            dup += line in seen
            seen.add(line)
            ends += body[-1:] in b".!?\"):;'"
    if not n:
        return [0, 0, symbols, 0, 0], {}
    h = np.fromiter(map(hash, words), dtype=np.int64, count=n).astype(np.uint64)
    repeated = repeat_cover(h)
    size = min(n, 100)
    # the last block overlaps the one before, so that every word counts
    whole, last = h[: n // size * size].reshape(-1, size), h[n - size :].reshape(1, size)
    block = np.sort(np.concatenate([whole, last]) if n % size else whole, axis=1)
    variety = (1 + (block[:, 1:] != block[:, :-1]).sum(axis=1)).mean() / size
    solid = len(raw) - sum(raw.count(bytes([c])) for c in _SPACE)
    letters = len(raw) - len(raw.translate(None, _LETTERS))
    upper = len(raw) - len(raw.translate(None, _UPPER))
    return [n, chars, symbols, dup, repeated], {
        "symbols": symbols / n,
        "repeats": repeated / n,
        "dup_lines": dup / max(lines, 1),
        "word_length": chars / n,
        "letters": letters / max(solid, 1),
        "punctuation": sum(raw.count(c) for c in (b".", b",", b"!", b"?", b";")) / n,
        "variety": float(variety),
        "upper": upper / max(letters, 1),
        "stutter": float((h[1:] == h[:-1]).mean()) if n > 1 else 0.0,
        "sentence_ends": ends / max(lines, 1),
    }


def vote(value: float | None, limits: tuple[float, float, float, float]) -> int:
    """1 good, 2 bad, 0 abstain."""
    if value is None:
        return 0
    good_from, good_to, bad_below, bad_above = limits
    if good_from <= value <= good_to:
        return 1
    return 2 if value < bad_below or value > bad_above else 0


@F.arrow_udf(_SCHEMA)
def _measures(texts: pa.Array) -> pa.Array:
    rows = []
    for t in texts.to_pylist():
        base, m = measure(t)
        code = 0
        for _, name, limits in RULES:
            code = code * 3 + vote(m.get(name), limits)
        rows.append((*base, code))
    columns = list(zip(*rows)) or [()] * (len(BASE) + 1)
    kinds = [pa.int64()] * len(BASE) + [pa.int32()]
    return pa.StructArray.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [*BASE, "pattern"])


def vote_rates(n: np.ndarray) -> np.ndarray:
    """Vote rates (class, rule, vote) of highest likelihood for counts ``n``, objections being no rarer in class bad.

    Where the plain rates would cross, both classes share the pooled rate of
    objections and the rest is divided between the other two votes as counted.
    """
    total = n.sum(axis=2, keepdims=True)
    rates = n / total
    crossed = rates[0, :, 2] > rates[1, :, 2]
    pooled = n[:, :, 2].sum(axis=0) / total[:, :, 0].sum(axis=0)
    for c in (0, 1):
        rest = n[c, :, :2] / n[c, :, :2].sum(axis=1, keepdims=True) * (1 - pooled)[:, None]
        rates[c] = np.where(crossed[:, None], np.concatenate([rest, pooled[:, None]], axis=1), rates[c])
    return rates


def fit_votes(patterns: np.ndarray, counts: np.ndarray, steps: int = 500) -> tuple[np.ndarray, np.ndarray]:
    """EM on vote patterns: posterior of each pattern, and table (class, rule, vote) of vote rates.

    Votes are independent given the class.  A rule has a rate for each vote in
    each class (class 0 good, 1 bad), so one that sees a single kind of junk may
    call other junk good without losing its weight when it objects.  Documents
    without an objection start as good, others as doubtful, and a rule's rate of
    objections never is higher among good documents than among bad ones:
    this fixes which class is which.
    """
    k = len(RULES)
    votes = np.stack([patterns // 3 ** (k - 1 - j) % 3 for j in range(k)], axis=1)
    onehot = np.stack([votes == v for v in range(3)], axis=2).astype(float)
    w = counts.astype(float)
    post = np.where((votes == 2).any(axis=1), 0.3, 0.95)
    rates = np.full((2, k, 3), 1 / 3)
    for _ in range(steps):
        # expected counts of each vote with half a count added
        n = np.stack([np.einsum("i,ijv->jv", p, onehot) + 0.5 for p in (w * post, w * (1 - post))])
        rates = vote_rates(n)
        share = (w @ post + 1) / (w.sum() + 2)
        logs = np.einsum("ijv,cjv->ic", onehot, np.log(rates))
        odds = np.clip(logs[:, 1] + np.log(1 - share) - logs[:, 0] - np.log(share), -700, 700)
        new = 1 / (1 + np.exp(odds))
        moved, post = np.abs(new - post).max(initial=0), new
        if moved < 1e-9:
            return post, rates
    # a flat likelihood: the posteriors are those of the last step, which differ from the one before by this much
    warnings.warn(f"vote rates still moved by {moved:.2g} after {steps} steps", RuntimeWarning, stacklevel=2)
    return post, rates


def _with_posterior(d: DataFrame, counted: DataFrame) -> DataFrame:
    """``d`` with the posterior of its ``pattern``, from all documents' counts."""
    rows = counted.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("pattern")
    post, _ = fit_votes(rows["pattern"].to_numpy(), rows["n"].to_numpy())
    table = [(int(p), float(x)) for p, x in zip(rows["pattern"], post)]
    # at most 3 ** len(RULES) rows of two numbers
    return d.join(F.broadcast(d.sparkSession.createDataFrame(table, "pattern int, posterior double")), "pattern", "left")


def _judged(d: DataFrame, threshold: float) -> DataFrame:
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    kept = ~failed & (F.col("posterior") >= F.lit(threshold))
    return d.withColumns({"base_failed": failed}).withColumn("kept", kept)


def judge_quality(docs: DataFrame, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Base counts, posterior quality and verdict of every document.

    Columns: id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    posterior, base_failed, kept.  A null text counts as empty: no words, every
    rule abstains, and it fails the base rules.  Ids may be null or repeated; extra
    columns are not read; no rows give no rows.
    """
    require(docs, id_col, text_col)
    d = docs.select(F.col(id_col).alias("__id"), _measures(F.col(text_col)).alias("m")).select("__id", "m.*")
    d = keep(d, "quality")
    d = _judged(_with_posterior(d, d), threshold)
    return d.select(F.col("__id").alias(id_col), *BASE, "posterior", "base_failed", "kept")


def quality_filter(docs: DataFrame, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that ``judge_quality`` keeps, with their columns.

    Reads the texts twice (counts, then verdicts) and never shuffles them.
    """
    measured = docs.select(F.struct(*docs.columns).alias("__d"), _measures(F.col(text_col)).alias("__m")).select("__d", "__m.*")
    return _judged(_with_posterior(measured, measured.select("pattern")), threshold).where("kept").select("__d.*")
