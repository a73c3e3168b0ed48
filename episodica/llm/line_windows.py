"""Line deduplication by overlapping windows of three lines.

Every three consecutive lines (blank ones aside) form a window; a document of one
or two lines is one window of its own length.  Windows are hashed to 128 bits and grouped over all documents; every occurrence but the first
is a repeat, and the lines covered by repeats are removed, overlapping ones merged.

The first occurrence is the one with the lowest (document id, text hash, place).
A line is only removed if the window before it in that order holds the same
line, so every removed line still stands somewhere.

Groups are aggregated with map-side combination to one row per window, and only
windows that repeat are joined back, so a passage in a third of all documents
costs no task more than its share.  DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from episodica.llm.common import require
from episodica.plans.small import keep

WINDOW = 3


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _full(lines: Column) -> Column:
    """Places of the lines that are not blank."""
    places = F.sequence(F.lit(0), F.size(lines) - 1)
    return F.filter(places, lambda i: lines[i].rlike(r"[^\x20\x09-\x0D]"))


def repeated_windows(docs: DataFrame, id_col: str, text_col: str, window: int = WINDOW, short: bool = True) -> DataFrame:
    """(id, k, at): starts of the repeated windows of every document, ``k`` being its text hash."""
    d = docs.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), F.xxhash64(F.lit(9), text_col).alias("k"), _lines(F.col(text_col)).alias("lines"))
    d = d.select("id", "k", F.transform(F.filter("lines", lambda x: x.rlike(r"[^\x20\x09-\x0D]")), lambda x: F.xxhash64(x)).alias("h"))
    d = d.where(F.size("h") >= (1 if short else window))
    # a window shorter than three lines differs from longer ones by its length
    d = d.withColumn("n", F.least(F.size("h"), F.lit(window))).withColumn("at", F.explode(F.sequence(F.lit(0), F.size("h") - F.col("n"))))
    three = [F.get("h", F.col("at") + j) for j in range(window)]
    # rows of one document that are equal in all columns are one occurrence
    w = keep(d.select("id", "k", "at", F.xxhash64(F.lit(1), "n", *three).alias("w1"), F.xxhash64(F.lit(2), "n", *three).alias("w2")), "line-windows")
    here = F.struct("id", "k", "at")
    seen = w.groupBy("w1", "w2").agg(F.min(here).alias("first"), F.max(here).alias("last"))
    seen = seen.where(~F.col("first").eqNullSafe(F.col("last"))).drop("last")
    again = w.join(seen, ["w1", "w2"]).where(~here.eqNullSafe(F.col("first")))
    return again.groupBy("id", "k").agg(F.collect_set("at").alias("at"))


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, short: bool = True) -> DataFrame:
    """``docs`` with the text less its repeated lines, and n_lines and n_removed added.

    Null texts stay null with no lines; an empty text has one empty line.  A text of
    fewer full lines than a window repeats only as a whole, in texts of the same
    full lines; with ``short=False`` it is not touched.  Blank lines belong to no window and
    stay.  Rows that agree in id and text are one document and get the same
    result.  Columns n_lines and n_removed are replaced; no rows give no rows.
    """
    require(docs, id_col, text_col)
    gone = repeated_windows(docs, id_col, text_col, window, short)
    names = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    d = docs.select(F.struct(*names).alias("d"), F.col(id_col).alias("__id"), F.xxhash64(F.lit(9), text_col).alias("__k"))
    d = d.join(gone, d["__id"].eqNullSafe(gone["id"]) & (d["__k"] == gone["k"]), "left")
    text = F.col(f"d.{text_col}")
    d = d.withColumn("lines", F.when(F.col("at").isNotNull(), _lines(text)))
    d = d.withColumn("full", F.when(F.col("at").isNotNull(), _full(F.col("lines"))))
    covered = F.flatten(F.transform("at", lambda i: F.slice("full", i + 1, window)))
    d = d.withColumn("kept", F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), covered))
    new = F.when(F.col("at").isNull(), text).otherwise(F.array_join(F.transform("kept", lambda i: F.get("lines", i)), "\n"))
    n = F.when(text.isNull(), 0).otherwise(F.length(text) - F.length(F.replace(text, F.lit("\n"))) + 1).cast("long")
    left = F.when(F.col("at").isNull(), n).otherwise(F.size("kept").cast("long"))
    cols = [new.alias(c) if c == text_col else F.col(f"d.{c}") for c in names]
    return d.select(*cols, n.alias("n_lines"), (n - left).alias("n_removed"))
