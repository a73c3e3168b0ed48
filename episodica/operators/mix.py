"""Dataset statistics, mixing plans and reports (tables of datasets, never of frames)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from episodica.functions.vec import safe_sequence


def scan_stats(frames: DataFrame) -> DataFrame:
    """Files, episodes and steps per dataset; files without readable frames do not count."""
    ok = frames.where(F.col("frame_idx").isNotNull())
    eps = ok.groupBy("domain", "file_id", "episode_id").agg(F.count(F.lit(1)).alias("n"))
    files = eps.groupBy("domain", "file_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("e"))
    return files.groupBy("domain").agg(
        F.count(F.lit(1)).alias("files"), F.sum("e").alias("episodes"), F.sum("n").alias("steps")
    )


def mix_weights(
    stats: DataFrame, members: DataFrame, groups: DataFrame,
    total_steps: float | None = None, total_episodes: float | None = None,
) -> DataFrame:
    """Target steps and scale of each dataset.

    ``members(grp, domain)``, ``groups(grp, alpha, share)``.  Weight = steps^alpha
    inside the group; shares are normalised over all groups, even empty ones.
    The target is steps, else episodes times the mean length, else all steps.
    """
    used = members.join(stats, "domain").where("steps > 0").join(groups, "grp")
    share = groups.agg(F.sum("share").alias("s")).scalar()
    tot = stats.agg(F.sum("steps").alias("s"))
    if total_steps is not None:
        target = F.lit(float(total_steps))
    elif total_episodes is not None:
        mean = stats.agg((F.sum("steps") / F.sum("episodes")).alias("m")).scalar()
        target = F.round(F.lit(float(total_episodes)) * mean)
    else:
        target = tot.scalar().cast("double")
    w = F.when(F.col("alpha") == 0, F.lit(1.0)).otherwise(F.pow(F.col("steps").cast("double"), F.col("alpha")))
    d = used.withColumn("weight", w)
    d = d.withColumn("fraction", F.col("weight") / F.sum("weight").over(W.partitionBy("grp")))
    d = d.withColumn("target_steps", target * (F.col("share") / share) * F.col("fraction"))
    return d.withColumn("scale", F.col("target_steps") / F.col("steps"))


def _copies():
    full0 = F.floor("scale")
    rem0 = F.col("scale") - full0
    full = full0 + F.when(rem0 > 0.99, 1).otherwise(0)
    rem = F.when((rem0 > 0.99) | (rem0 < 0.01), F.lit(0.0)).otherwise(rem0)
    return full, rem


def mix_plan(weights: DataFrame) -> DataFrame:
    """Whole copies plus at most one partial entry per dataset."""
    full, rem = _copies()
    d = weights.withColumn("full", full).withColumn("rem", rem)
    name = F.when((F.col("full") > 1) | (F.col("rem") > 0),
                  F.concat(F.col("domain"), F.lit("_copy"), F.col("i").cast("string"))).otherwise(F.col("domain"))
    whole = d.withColumn("i", F.explode(safe_sequence(F.lit(0).cast("bigint"), F.col("full") - 1))).select(
        "grp", "domain", name.alias("name"), F.lit(1.0).alias("ratio"))
    pname = F.when(F.col("full") > 0, F.concat(F.col("domain"), F.lit("_copy"), F.col("full").cast("string"), F.lit("_partial"))) \
        .otherwise(F.concat(F.col("domain"), F.lit("_partial")))
    part = d.where("rem > 0").select("grp", "domain", pname.alias("name"), F.round("rem", 4).alias("ratio"))
    return whole.unionByName(part)


def mix_report(weights: DataFrame) -> DataFrame:
    """Final episodes, steps, entries and shares per dataset, with a TOTAL row.

    ``pos`` orders rows by steps inside a group (descending).
    """
    full, rem = _copies()
    d = weights.select(
        "grp", "domain", "scale",
        (F.col("episodes") * F.col("scale")).alias("eps"), (F.col("steps") * F.col("scale")).alias("stp"),
        (full + F.when(rem > 0, 1).otherwise(0)).alias("entries"),
    )
    g = d.groupingSets([["grp", "domain"], []], "grp", "domain").agg(
        F.sum("eps").alias("final_episodes"), F.sum("stp").alias("final_steps"), F.sum("entries").alias("entries"),
        F.grouping("domain").alias("is_total"),
    )
    tot = W.partitionBy("is_total")
    pos = F.row_number().over(W.partitionBy("is_total", "grp").orderBy(F.desc("final_steps"), "domain"))
    return g.select(
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("grp")).alias("grp"), "domain",
        "final_episodes", "final_steps", "entries",
        (100.0 * F.col("final_episodes") / F.sum("final_episodes").over(tot)).alias("pct_episodes"),
        (100.0 * F.col("final_steps") / F.sum("final_steps").over(tot)).alias("pct_steps"),
        F.when(F.col("is_total") == 0, pos.cast("bigint")).alias("pos"),
    )


def dataset_report(frames: DataFrame, batch_size: int) -> DataFrame:
    """Per split and domain: tasks, trajectories, frames, steps per epoch, with TOTAL rows."""
    eps = frames.groupBy("split", "domain", "file_id", "episode_id").agg(F.count(F.lit(1)).alias("n"))
    files = eps.groupBy("split", "domain", "file_id").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("e"))
    g = files.groupingSets([["split", "domain"], ["split"]], "split", "domain").agg(
        F.count(F.lit(1)).alias("tasks"), F.sum("e").alias("trajectories"), F.sum("n").alias("frames"))
    return g.withColumn("domain", F.coalesce("domain", F.lit("TOTAL"))).withColumn(
        "steps_per_epoch", F.ceil(F.col("frames") / batch_size))
