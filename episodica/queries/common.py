"""How the given tables stand in for episode data, in Spark and in SQL.

* order lines: domain = nation, file = customer, episode = order, frame = line
* events: episode = user, stream = event type, clock = seconds since 2024-01-01
* embeddings: domain = label, sample = vec_id
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from episodica.functions.vec import dbl
from episodica.sources.frames import index_frames


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def bigint(*names: str) -> list[Column]:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# ------------------------------------------------------------------ null keys
_HIDDEN: ContextVar[dict | None] = ContextVar("hidden", default=None)


@contextmanager
def hidden_keys(*names: str) -> Iterator[dict]:
    """The smallest value of each named key is null in the sources read inside; yields these values."""
    token = _HIDDEN.set(dict.fromkeys(names))
    try:
        yield _HIDDEN.get()
    finally:
        _HIDDEN.reset(token)


def hide(df: DataFrame) -> DataFrame:
    """``df`` with the keys hidden that :func:`hidden_keys` names; every source passes here."""
    least = _HIDDEN.get()
    names = [c for c in least or () if c in df.columns]
    for c in names:
        if least[c] is None:
            least[c] = df.agg(F.min(c)).first()[0]
    return df.withColumns({c: F.when(F.col(c) != least[c], F.col(c)) for c in names}) if names else df


def with_null_keys(fn: Callable, *names: str) -> Callable:
    """The query ``fn`` over sources with null keys, which its result calls by their names again."""

    def run(spark: SparkSession, sf: str) -> DataFrame:
        with hidden_keys(*names) as least:
            out = fn(spark, sf)
        # a null domain of shared statistics is none that was hidden
        own = F.col("scope") != "shared" if "scope" in out.columns else F.lit(True)
        return out.withColumns({c: F.when(F.col(c).isNull() & own, F.lit(v)).otherwise(F.col(c)) for c, v in least.items() if c in out.columns and v is not None})

    return run


# ---------------------------------------------------------------- order lines
def episodes(spark, sf) -> DataFrame:
    """Episode table: domain, file_id, episode_id (orders, also those without frames)."""
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    c = table(spark, sf, "customer").select("c_custkey", "c_nationkey")
    n = table(spark, sf, "nation").select("n_nationkey", "n_name")
    return (
        o.join(c, o.o_custkey == c.c_custkey)
        .join(n, c.c_nationkey == n.n_nationkey)
        .select(F.col("n_name").alias("domain"), F.col("o_custkey").alias("file_id"),
                F.col("o_orderkey").alias("episode_id"))
    )


EPISODES = """episodes AS (
  SELECT n_name AS domain, o_custkey AS file_id, o_orderkey AS episode_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""

def raw_frames(spark, sf, *extra: str) -> DataFrame:
    """Order lines with a dense frame index, before the episode attributes."""
    li = table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("episode_id"), "l_shipdate", "l_linenumber", "l_partkey", "l_suppkey",
        F.col("l_quantity").alias("q0"), F.col("l_extendedprice").alias("q1"),
        F.col("l_discount").alias("q2"), F.col("l_tax").alias("q3"),
        F.col("l_returnflag").alias("flag"), F.col("l_linestatus").alias("status"),
    )
    li = li.withColumn("ts", F.datediff(F.to_date("l_shipdate"), F.lit("1990-01-01").cast("date")).cast("double"))
    out = index_frames(li, ["episode_id"], ["l_shipdate", "l_linenumber", "l_partkey", "l_suppkey"], F.col("ts"))
    return out.select("episode_id", "frame_idx", "ts", "q0", "q1", "q2", "q3", "flag", "status", *extra)


def frames(spark, sf, *extra: str) -> DataFrame:
    """Frame table: domain, file_id, episode_id, frame_idx, ts, q0..q3, flag, status."""
    return hide(raw_frames(spark, sf, *extra).join(episodes(spark, sf), "episode_id"))


RAW_FRAMES = """raw_frames AS (
  SELECT l_orderkey AS episode_id,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey) - 1 AS frame_idx,
         CAST(date_diff('day', TIMESTAMP '1990-01-01', l_shipdate) AS DOUBLE) AS ts,
         l_quantity AS q0, l_extendedprice AS q1, l_discount AS q2, l_tax AS q3,
         l_returnflag AS flag, l_linestatus AS status
  FROM lineitem)"""
FRAMES = (
    EPISODES + ",\n" + RAW_FRAMES + """,
frames AS (SELECT r.*, e.domain, e.file_id FROM raw_frames r JOIN episodes e USING (episode_id))"""
)


# --------------------------------------------------------------------- events
def events(spark, sf) -> DataFrame:
    """Raw samples: episode_id, ts (seconds), stream, value, k."""
    return table(spark, sf, "events").select(
        F.col("user_id").alias("episode_id"), "event_id",
        (F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ '2024-01-01 00:00:00'"), F.col("ts"))
         / F.lit(1e6)).alias("ts"),
        F.col("event_type").alias("stream"), "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )


def samples(spark, sf) -> DataFrame:
    """Events with a dense index per episode."""
    return hide(index_frames(events(spark, sf), ["episode_id"], ["ts"], F.floor(F.col("ts") / 60)))


EVENTS = """events0 AS (
  SELECT user_id AS episode_id, event_id,
         date_diff('microsecond', TIMESTAMP '2024-01-01', ts) / 1e6 AS ts,
         event_type AS stream, value, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k
  FROM events)"""
SAMPLES = EVENTS + """,
samples AS (
  SELECT *, row_number() OVER (PARTITION BY episode_id ORDER BY ts) - 1 AS frame_idx FROM events0)"""


# ----------------------------------------------------------------- embeddings
def vectors(spark, sf) -> DataFrame:
    return hide(table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").alias("domain"), dbl(F.col("embedding")).alias("v")
    ))


VECTORS = "vectors AS (SELECT vec_id, label AS domain, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"


def longer(df: DataFrame, keys: list[str], arr: str = "v", pos: str = "dim", val: str = "value", digits=6) -> DataFrame:
    """Explode an array column to (keys, pos, rounded value)."""
    from episodica.registry import rnd

    return df.select(*keys, F.posexplode(arr).alias("p_", "x_")).select(
        *keys, F.col("p_").cast("bigint").alias(pos), rnd(F.col("x_"), digits).alias(val)
    )


def sql_longer(source: str, keys: str, arr: str = "v", pos: str = "dim", val: str = "value", digits=6) -> str:
    from episodica.registry import sql_rnd

    return (
        f"SELECT {keys}, CAST(i_ - 1 AS BIGINT) AS {pos}, {sql_rnd('x_', digits)} AS {val} FROM "
        f"(SELECT {keys}, unnest({arr}) AS x_, unnest(range(1, len({arr}) + 1)) AS i_ FROM {source})"
    )


def forms(df: DataFrame, keys: list[str], cols: list[str], digits: int = 6) -> DataFrame:
    """Several array columns in long form: keys, form, dim, value."""
    from episodica.registry import rnd

    pick = F.explode(F.array(*[F.struct(F.lit(c).alias("form"), F.col(c).alias("a")) for c in cols])).alias("f_")
    d = df.select(*keys, pick).select(*keys, "f_.form", F.posexplode("f_.a").alias("p_", "x_"))
    return d.select(*keys, "form", F.col("p_").cast("bigint").alias("dim"), rnd(F.col("x_"), digits).alias("value"))


def sql_forms(source: str, keys: str, cols: list[str], digits: int = 6) -> str:
    from episodica.registry import sql_rnd

    parts = [
        f"SELECT {keys}, '{c}' AS form, CAST(i_ - 1 AS BIGINT) AS dim, {sql_rnd('x_', digits)} AS value FROM "
        f"(SELECT {keys}, unnest({c}) AS x_, unnest(range(1, len({c}) + 1)) AS i_ FROM {source})"
        for c in cols
    ]
    return "\nUNION ALL ".join(parts)
