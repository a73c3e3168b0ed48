"""Instruction text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from episodica.functions.vec import rpad_keep
from episodica.plans.ordered import hash_hex, number_rows

BASE_COPIES = 10


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def instruction_from_name(name: Column) -> Column:
    """Text between the first and the last "+", blanks for underscores, ending with ".".

    Missing marks, nested marks and empty text are errors.
    """
    inner = F.regexp_extract(name, r"(?s)^[^+]+\+(.*)\+[^+]*$", 1)
    text = F.translate(_strip(inner), "_", " ")
    text = F.when(F.endswith(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".")))
    bad = F.instr(name, "+") < 2
    return F.when(bad | F.contains(text, F.lit("+")), F.raise_error(F.concat(F.lit("no single instruction in "), name)).cast("string")) \
        .otherwise(text)


def valid_instruction_name(name: Column) -> Column:
    """Would :func:`instruction_from_name` accept it?"""
    inner = F.regexp_extract(name, r"(?s)^[^+]+\+(.*)\+[^+]*$", 1)
    return (F.instr(name, "+") >= 2) & ~F.contains(inner, F.lit("+"))


def instruction_from_parts(folder: Column, skip: int = 2) -> Column:
    """Underscore-joined parts of a folder name after the first ``skip``."""
    p = F.split(folder, "_")
    return F.array_join(F.slice(p, skip + 1, F.greatest(F.size(p) - skip, F.lit(0))), "_")


def instruction_normalize(text: Column, width: int = 0) -> Column:
    """Drop "dataset" marks and underscores; blank text falls back to the input; pad to ``width``."""
    t = F.replace(F.replace(text, F.lit("_dataset"), F.lit("")), F.lit("dataset"), F.lit(""))
    t = _strip(F.translate(t, "_", " "))
    t = F.when(t == "", text).otherwise(t)
    return rpad_keep(t, width) if width else t


def instruction_pool(base: DataFrame, expanded: DataFrame, width: int, key: str = "task") -> DataFrame:
    """Candidates per task: the expansions plus ten copies of the base, exact width only.

    Rows are (task, cand_no, text); texts longer than ``width`` cannot be drawn.
    """
    exp = expanded.select(key, F.col("pos").cast("bigint").alias("pos"), rpad_keep(F.col("text"), width).alias("text"))
    copies = base.select(key, F.explode(F.sequence(F.lit(0), F.lit(BASE_COPIES - 1))).alias("c"), rpad_keep(F.col("text"), width).alias("text"))
    n = expanded.groupBy(key).agg((F.max("pos") + 1).alias("__n"))
    copies = copies.join(n, key, "left").select(key, (F.coalesce("__n", F.lit(0)) + F.col("c")).cast("bigint").alias("pos"), "text")
    pool = exp.unionByName(copies).where(F.length("text") == width)
    return pool.withColumnRenamed("pos", "cand_no")


def _numbered(pool: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """Candidates with a dense number per task, and the number of candidates."""
    p = number_rows(pool, [key], ["cand_no"], F.floor(F.col("cand_no") / 1_000_000), "__ci")
    p = p.select(F.col(key), "__ci", F.col("text").alias("__text"))
    return p, pool.groupBy(key).agg(F.count(F.lit(1)).alias("__n"))


def _hash_int(h: Column, start: int) -> Column:
    return F.conv(F.substring(h, start, 8), 16, 10).cast("bigint")


def draw_instruction(episodes: DataFrame, pool: DataFrame, seed: int, key: str = "task", episode: str = "episode_id") -> DataFrame:
    """One candidate per episode, by hash; the draw is an equi join on (task, number)."""
    cand, n = _numbered(pool, key)
    d = episodes.join(n, key).withColumn("__ci", F.pmod(_hash_int(hash_hex(seed, F.col(episode)), 1), F.col("__n")))
    return d.join(cand, [key, "__ci"]).withColumnRenamed("__text", "instruction").drop("__ci", "__n")


def draw_instruction_per_frame(frames: DataFrame, base: DataFrame, pool: DataFrame, seed: int, key: str = "task", frame: str = "frame_id") -> DataFrame:
    """Per frame: the base text once in five, else a candidate, by hash."""
    cand, n = _numbered(pool, key)
    h = hash_hex(seed, F.col(frame))
    d = frames.join(base.select(key, F.col("text").alias("__base")), key).join(n, key)
    d = d.withColumn("__ci", F.pmod(_hash_int(h, 9), F.col("__n"))).join(cand, [key, "__ci"])
    d = d.withColumn("instruction", F.when(F.pmod(_hash_int(h, 1), F.lit(5)) == 0, F.col("__base")).otherwise(F.col("__text")))
    return d.drop("__base", "__ci", "__n", "__text")


def instruction_pool_clean(pools: DataFrame, key: str = "task") -> DataFrame:
    """Normalise stored pools (task, pos, text), drop copies of the base text, keep at least one.

    Text that mentions "dataset" or equals the task name becomes the normalised
    task name; a pool of nothing else keeps a single copy of it.
    """
    base = instruction_normalize(F.col(key))
    t = _strip(F.col("text"))
    nb = lambda c: F.replace(c, F.lit(" "), F.lit(""))
    t = F.when(F.contains(t, F.lit("dataset")) | (nb(t) == nb(F.col(key))), base).otherwise(t)
    d = pools.select(key, "pos", t.alias("text"), base.alias("__b"))
    d = d.withColumn("__o", F.col("text") != F.col("__b"))
    has = d.groupBy(key).agg(F.bool_or("__o").alias("__has"), F.min("pos").alias("__first"))
    d = d.join(has, key)
    keep = F.col("__o") | (~F.col("__has") & (F.col("pos") == F.col("__first")))
    return d.where(keep).select(key, "pos", "text")


def parse_pools(docs: DataFrame, col: str = "doc") -> DataFrame:
    """JSON maps task -> [texts] to rows (task, pos, text)."""
    m = docs.select(F.explode(F.from_json(col, "map<string,array<string>>")).alias("task", "texts"))
    return m.select("task", F.posexplode("texts").alias("pos", "text"))


def parse_numbered_lines(text: Column) -> Column:
    """Lines of a numbered reply ("[i] text") -> trimmed texts without blanks."""
    lines = F.filter(F.transform(F.split(text, "\n"), _strip), lambda x: x != "")
    return F.transform(lines, lambda x: _strip(F.element_at(F.split(x, r"\] "), -1)))
