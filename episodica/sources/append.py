"""Appends that can be repeated: a batch has a name, its numbers are taken once.

A log beside the table holds one small file per batch with the episode numbers the
batch took in every domain.  The next entry is claimed by creating its file, which only
one writer can do; who comes second reads the log again.  A batch that is in the log
gets the same numbers again, and its frames replace those of the first attempt
(``batch=<name>`` folders, dynamic partition overwrite), so a retry changes nothing.

Shapes and lengths are observed while the frames are written; only if they are not
uniform over the whole batch is it read again to name the files at fault.
"""

from __future__ import annotations

import json
import time
from collections.abc import Sequence

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from episodica.plans.small import forget, keep
from episodica.sources.frames import _sizes, file_numbers, validate_frames

#: seconds that the writer of an empty log entry has to fill it
PATIENCE = 5.0


class BatchLog:
    """Which batch took which episode numbers; in ``<path>-log``."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.conf = spark._jvm, spark._jsc.hadoopConfiguration()
        self.root = path.rstrip("/") + "-log"

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def _fs(self):
        path = self._path(self.root)
        return path.getFileSystem(self.conf)

    def entries(self) -> list[dict]:
        """The log in order; an entry whose writer died before filling it counts for nothing."""
        fs = self._fs()
        if not fs.exists(self._path(self.root)):
            return []
        names = sorted(s.getPath().getName() for s in fs.listStatus(self._path(self.root)))
        return [e for n in names if not n.startswith(".") and (e := self._read(n)) is not None]

    def _read(self, name: str) -> dict | None:
        until = time.time() + PATIENCE
        while True:
            stream = self._fs().open(self._path(f"{self.root}/{name}"))
            text = bytes(stream.readAllBytes()).decode()
            stream.close()
            if text.endswith("\n"):
                return json.loads(text)
            if time.time() > until:
                return None
            time.sleep(0.2)

    def claim(self, batch: str, counts: dict[str | None, int]) -> dict[str | None, int]:
        """First episode number of the batch in every domain; taken now or, for a repeated batch, then."""
        fs = self._fs()
        fs.mkdirs(self._path(self.root))
        while True:
            done = self.entries()
            for e in done:
                if e["batch"] == batch:
                    if {d: n for d, _, n in e["domains"]} != counts:
                        raise ValueError(f"batch {batch!r} was appended before with other episodes")
                    return {d: s for d, s, _ in e["domains"]}
            ends: dict[str | None, int] = {}
            for e in done:
                for d, s, n in e["domains"]:
                    ends[d] = max(ends.get(d, 0), s + n)
            taken = [[d, ends.get(d, 0), n] for d, n in sorted(counts.items(), key=lambda x: (x[0] is not None, x[0] or ""))]
            held = [s.getPath().getName() for s in fs.listStatus(self._path(self.root))]
            number = max((int(n) for n in held if n.isdigit()), default=-1) + 1
            try:
                out = fs.create(self._path(f"{self.root}/{number:012d}"), False)
            except Exception as e:  # noqa: BLE001 - the gateway's error, whose cause is looked at
                if "exist" in str(e).lower():
                    continue
                raise
            out.write(bytearray((json.dumps({"batch": batch, "domains": taken}) + "\n").encode()))
            out.close()
            return {d: s for d, s, _ in taken}


def append_batch(frames: DataFrame, path: str, batch: str, per_file: int = 100, arrays: Sequence[str] = ()) -> DataFrame:
    """Append whole episodes as one named batch; returns violations (domain, file_id, key, rule) of ``arrays``.

    Frames are stored below ``batch=<name>/domain=<domain>``.  The same name again writes
    the same episodes to the same place; with other episodes it is an error.  Numbers go
    on where the batches claimed before end, per domain, whichever batch is written first.
    Null domains and null episodes are ones like any other.
    """
    spark = frames.sparkSession
    # domains are folders of the table, so the list of them is what the driver keeps anyway
    eps = keep(frames.select("domain", "episode_id").distinct(), "append-episodes")
    per = eps.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()
    starts = BatchLog(spark, path).claim(batch, {r.domain: r.n for r in per})
    first = spark.createDataFrame([(d, s) for d, s in starts.items()], "domain string, next_seq long")
    out = file_numbers(frames, per_file, first, eps).withColumn("batch", F.lit(batch))
    seen, checks = Observation(), [F.count(F.lit(1)).alias("rows")]
    for a in arrays:
        checks.append(F.count(a).alias(f"n_{a}"))
        for level, (low, high) in enumerate(_sizes(F.col(a), frames.schema[a].dataType)):
            checks += [F.min(low).alias(f"low_{level}_{a}"), F.max(high).alias(f"high_{level}_{a}")]
    (
        out.hint("rebalance", "domain", "file_no").observe(seen, *checks)
        .sortWithinPartitions("domain", "file_no", "episode_seq", "frame_idx")
        .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "domain").parquet(path)
    )
    forget(eps)
    got = seen.get
    uneven = any(v != got[k.replace("low_", "high_", 1)] for k, v in got.items() if k.startswith("low_"))
    missing = any(0 < got[f"n_{a}"] < got["rows"] for a in arrays)
    if not (uneven or missing):
        return spark.createDataFrame([], "domain string, file_id long, key string, rule string")
    # one shape over all files is one in each of them; only what is not uniform is looked at again
    written = read_batches(spark, path).where(F.col("batch") == batch)
    return validate_frames(written, arrays)


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """The table with its ``batch`` and ``domain`` columns as text."""
    try:
        found = spark.read.option("basePath", path).parquet(path)
    except PySparkException as e:
        raise ValueError(f"no batch below {path}") from e
    return found.withColumns({c: F.col(c).cast("string") for c in ("batch", "domain")})
