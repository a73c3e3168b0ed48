"""How often an append reads its frames."""

from pyspark.sql import functions as F

from episodica.sources.append import append_batch, read_batches


def test_a_batch_reads_its_frames_twice(spark, tmp_path):
    read = spark.sparkContext.accumulator(0)

    def seen(i):
        read.add(1)
        return i

    d = spark.range(400).select(F.lit("a").alias("domain"), F.udf(seen, "long")(F.floor(F.col("id") / 4)).alias("episode_id"), (F.col("id") % 4).alias("frame_idx"))
    append_batch(d, str(tmp_path / "t"), "one", per_file=10)
    # once for the episodes, once for the rows
    assert read.value <= 800
    got = read_batches(spark, str(tmp_path / "t"))
    assert got.count() == 400 and sorted(r.episode_seq for r in got.select("episode_seq").distinct().collect()) == list(range(100))
