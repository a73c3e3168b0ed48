"""Sharding by vector bin packing.

Groups of equal texts are items with three weights: bytes, tokens and rows.
Every shard has a capacity of one n-th of each total; an item goes to the shard
where the dot product of its weights with the residual capacity is highest.

Only a bounded table reaches the driver.  A group above 1 / BLOCKS of any total
is an item of its own (there are at most 3 * BLOCKS of those); all other groups
are hashed whole into BLOCKS blocks, and a block is placed as one item.  A group
larger than a whole shard cannot stay together in equal shards; it is cut into
pieces of at most a quarter of a shard by a hash of the row identity.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from episodica.llm.common import n_words, require
from episodica.plans.ordered import number_rows
from episodica.plans.small import keep

#: hash blocks of light groups, and the share above which a group is placed alone
BLOCKS = 4096

#: rows that share one window when slots are numbered
SLOT_ROWS = 8192

_DIMS = ["bytes", "tokens", "rows"]


def place(weights: np.ndarray, shards: int) -> np.ndarray:
    """Shard of each item (rows of ``weights``), largest items first.

    Weights are fractions of the totals.  Among the shards that still hold the
    item, the highest dot product with the residual wins; if none holds it, the
    shard that is least overfull afterwards.  Ties go to the lower shard.
    """
    residual = np.full((shards, weights.shape[1]), 1.0 / shards)
    out = np.zeros(len(weights), dtype=np.int32)
    for i in np.argsort(-weights.max(axis=1), kind="stable") if len(weights) else []:
        w = weights[i]
        left = residual - w
        fits = (left >= -1e-12).all(axis=1)
        score = np.where(fits, residual @ w, -np.inf) if fits.any() else left.min(axis=1)
        out[i] = s = int(np.argmax(score))
        residual[s] = left[s]
    return out


def pack_shards(docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Shard and slot of every row.

    Returns ``id_col``, size (UTF-8 bytes + 1), tokens (words), text_crc32, shard
    (0 .. shards - 1) and slot (gapless from 0 in each shard, in a hashed order).
    Null and empty texts are equal texts of size 1; rows with equal or null ids
    are rows like any other; other columns are ignored; no rows give no rows.
    """
    require(docs, id_col, text_col)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = keep(
        docs.select(
            F.col(id_col).alias("__id"),
            (F.octet_length(text).cast("long") + 1).alias("size"),
            n_words(text).alias("tokens"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.md5(text.cast("binary")).alias("__g"),
        ),
        "shard-digest",
    )
    total = digest.agg(F.sum("size"), F.sum("tokens"), F.count(F.lit(1))).first()
    totals = [float(x or 0) or 1.0 for x in total]

    groups = digest.groupBy("__g").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
    share = F.greatest(*[F.col(d) / F.lit(t) for d, t in zip(_DIMS, totals)])
    heavy = groups.withColumn("__share", share).where(F.col("__share") > 1.0 / BLOCKS)
    # a group larger than a shard in any weight is cut
    pieces = F.when(F.col("__share") * shards > 1, F.ceil(F.col("__share") * shards * 4)).otherwise(1)
    # at most 3 * BLOCKS rows of a hash and a number
    heavy = F.broadcast(heavy.select("__g", pieces.cast("long").alias("__pieces")))

    piece = F.when(F.col("__pieces") > 1, F.pmod(F.xxhash64(F.lit(7), "__id"), F.col("__pieces"))).otherwise(0)
    item = F.when(F.col("__pieces").isNotNull(), F.concat_ws(":", "__g", piece.cast("string"))).otherwise(
        F.pmod(F.xxhash64("__g"), F.lit(BLOCKS)).cast("string")
    )
    rows = digest.join(heavy, "__g", "left").withColumn("__item", item).drop("__pieces")
    items = (
        rows.groupBy("__item").agg(F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows"))
        .toPandas().sort_values("__item", ignore_index=True)
    )
    placed = items[["__item"]].assign(shard=place(items[_DIMS].to_numpy(dtype=float) / totals, shards))
    spark = docs.sparkSession
    table = F.broadcast(spark.createDataFrame(list(placed.itertuples(index=False, name=None)), "__item string, shard int"))

    blocks = max(1, int(totals[2]) // (shards * SLOT_ROWS))
    order = [F.col(c) for c in ("__id", "text_crc32", "__g", "size")]
    numbered = number_rows(
        rows.join(table, "__item"), ["shard"], order, F.pmod(F.xxhash64(F.lit(3), "__id"), F.lit(blocks)), out="slot"
    )
    return numbered.select(F.col("__id").alias(id_col), "size", "tokens", "text_crc32", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = 8, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the documents as one folder per shard.

    ``id_col`` must be unique here, since it joins the rows to their shards.
    """
    where = pack_shards(docs, shards, id_col, text_col).select(F.col(id_col).alias("__id"), "shard", "slot")
    docs.join(where, docs[id_col].eqNullSafe(where["__id"])).drop("__id").write.partitionBy("shard").parquet(path)
