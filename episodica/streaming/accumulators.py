"""Streaming forms of the clock accumulators.

State per key is a single number (next bucket, last kept time) or the open buckets of
an episode.  With ``silence`` the state lives on event time: a timer runs behind the
last record of a key, and when the watermark passes it what is held is flushed and the
state removed, so it is as large as the episodes that are still running.  Rows older
than the watermark are dropped, and an episode that speaks again after its silence is
a new one.

Keys are many and small, so a processor works on plain rows: frames made for each key
cost more than all else.  It reads and writes one value a key and micro-batch, hands on
ranges and pages of buckets and leaves their rows to Spark.  Rows that cannot matter (not
the first of a bucket, not newer than all before) are left out while the rows of a key
are read, and before they are shuffled, so a key with very many rows holds its buckets.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

#: filled buckets handed on at once, and rows of a key read before they are cut
CHUNK = 65_536

#: buckets of an episode that lie in one entry of the state
PAGE = 256

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_state_store(df: DataFrame) -> None:
    """Arbitrary state needs the RocksDB store."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


def _millis(time: str) -> Column:
    return F.unix_millis(F.col(time))


class _Timed(StatefulProcessor):
    """Forgets a key that has been silent for ``silence`` seconds of event time.

    The state of a key is one row: the time of its newest record (``ms``) and ``kept``.
    """

    #: column with the event time in milliseconds, beside the columns of the output
    MS = "event_ms"

    def __init__(self, silence: float | None, kept: str):
        self.silence = None if silence is None else int(silence * 1000)
        self.kept = kept

    def init(self, handle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", f"ms long, kept {self.kept}")

    def recall(self) -> tuple:
        """(ms, kept) of the key, both None if it is new."""
        return tuple(self.state.get() or (None, None))

    def remember(self, old: tuple, ms: int | None, kept) -> None:
        """Write what has changed and move the timer of the key behind its newest record."""
        before = old[0]
        newer = self.silence is not None and ms is not None and (before is None or ms > before)
        if newer:
            if before is not None:
                self.handle.deleteTimer(before + self.silence)
            self.handle.registerTimer(ms + self.silence)
        new = (ms if newer else before, kept)
        if new != old:
            self.state.update(new)

    def timed(self, rows: Iterable[Row], *names: str) -> Iterator[tuple]:
        """(row, event time, the named values) of every row."""
        at = None
        for r in rows:
            if at is None:
                fields = r.__fields__
                at = [fields.index(n) for n in names]
                ms = fields.index(self.MS) if self.silence is not None else None
            yield (r, None if ms is None else r[ms], *[r[i] for i in at])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        yield from self.flush(key)
        self.state.clear()

    def flush(self, key) -> Iterable[Row]:
        """What is handed on at the end of a key; most rows were when they came."""
        return ()

    def close(self) -> None:
        pass


def _real(t: float | None) -> bool:
    """Neither null, nor NaN, nor infinite."""
    return t is not None and -math.inf < t < math.inf


def _later(a: int | None, b: int | None) -> int | None:
    return b if a is None or (b is not None and b > a) else a


def first_of_buckets(d: pd.DataFrame, by: list[str], start: float, dt: float, eps: float) -> pd.DataFrame:
    """The earliest row of each own bucket (``__g``); no other row ever fills one."""
    d = d[d["ts"].notna()]
    g = np.floor((d["ts"].to_numpy(dtype=float) - start) / dt + eps).astype(np.int64)
    d = d.assign(__g=g)[g >= 0].sort_values("ts", kind="stable")
    return d.drop_duplicates([*by, "__g"])


class _ObsProcessor(_Timed):
    """Fills clock buckets; earlier buckets are never overwritten. Hands on rows with the range of buckets they fill."""

    def __init__(self, start: float, dt: float, eps: float, names: list[str], silence: float | None):
        super().__init__(silence, "long")
        self.start, self.dt, self.eps, self.names = start, dt, eps, names
        self.row = Row(*names, "from_bucket", "to_bucket")

    def handleInputRows(self, key, rows, timerValues):
        old = self.recall()
        nxt = old[1] or 0
        first, newest = {}, None
        for r, ms, ts in self.timed(rows, "ts"):
            if not _real(ts):
                continue
            newest = _later(newest, ms)
            g = math.floor((ts - self.start) / self.dt + self.eps)
            if g >= nxt and (g not in first or ts < first[g][0]):
                first[g] = (ts, r)
        # a bucket without an own record is filled by the next one
        self.remember(old, newest, max(first) + 1 if first else old[1])
        for g in sorted(first):
            values = [first[g][1][n] for n in self.names]
            # a wide gap is filled in pieces
            for a in range(nxt, g + 1, CHUNK):
                yield self.row(*values, a, min(a + CHUNK - 1, g))
            nxt = g + 1


def _with_time(stream: DataFrame, time: str | None, silence: float | None, delay: str) -> DataFrame:
    if silence is None:
        return stream
    if time is None:
        raise ValueError("a silence needs the event time column")
    return stream.withColumn(_Timed.MS, _millis(time)).withWatermark(time, delay)


def obs_accumulator_stream(
    stream: DataFrame, start: float, dt: float, key: str = "episode_id", eps: float = 1e-5,
    silence: float | None = None, time: str | None = None, delay: str = "0 seconds",
) -> DataFrame:
    """Incremental observation buffer (append mode): input columns plus ``bucket``.

    With ``silence`` (seconds) and the event time column ``time`` the state of an episode
    that has been silent that long is removed.  Rows without ``ts`` fill nothing; they
    only move the watermark on.
    """
    use_state_store(stream)
    names = stream.columns

    def cut(runs: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for run in runs:
            rest = run[run["ts"].isna()]
            run = first_of_buckets(run, [key], start, dt, eps)[names]
            yield run if rest.empty else pd.concat([run, rest])

    out = StructType([*stream.schema.fields, StructField("from_bucket", LongType()), StructField("to_bucket", LongType())])
    few = _with_time(stream.mapInPandas(cut, stream.schema), time, silence, delay)
    mode = "None" if silence is None else "EventTime"
    filled = few.groupBy(key).transformWithState(_ObsProcessor(start, dt, eps, names, silence), out, "Append", mode)
    return filled.select(*names, F.explode(F.sequence("from_bucket", "to_bucket")).alias("bucket"))


def record_times(rows: list[tuple]) -> list[tuple]:
    """Of (arrival, ts, row) those whose time exceeds all before them, in the order of arrival; no arrival comes last."""
    out = []
    for x in sorted(rows, key=lambda x: (x[0] is None, 0 if x[0] is None else x[0])):
        if not out or x[1] > out[-1][1]:
            out.append(x)
    return out


class _NewerProcessor(_Timed):
    """Keeps records whose time exceeds the last kept time of the key."""

    def __init__(self, order: str, names: list[str], silence: float | None):
        super().__init__(silence, "double")
        self.order, self.names = order, names
        self.row = Row(*names)

    def handleInputRows(self, key, rows, timerValues):
        old = self.recall()
        seen = -math.inf if old[1] is None else old[1]
        held, limit, newest = [], CHUNK, None
        for r, ms, ts, arrival in self.timed(rows, "ts", self.order):
            if ts is None or ts != ts:
                continue
            newest = _later(newest, ms)
            if ts > seen:
                held.append((arrival, ts, r))
                if len(held) >= limit:
                    held = record_times(held)
                    limit = max(CHUNK, 2 * len(held))
        held = record_times(held)
        self.remember(old, newest, held[-1][1] if held else old[1])
        for _, _, r in held:
            yield self.row(*[r[n] for n in self.names])


def strictly_newer_stream(
    stream: DataFrame, order: str, key: str = "episode_id",
    silence: float | None = None, time: str | None = None, delay: str = "0 seconds",
) -> DataFrame:
    """Drop records that are not newer than the last kept one (append mode); ``order`` is the arrival order.

    ``silence``, ``time`` and ``delay`` as in :func:`obs_accumulator_stream`; rows without ``ts`` are dropped.
    """
    use_state_store(stream)
    mode = "None" if silence is None else "EventTime"
    timed = _with_time(stream, time, silence, delay)
    return timed.groupBy(key).transformWithState(_NewerProcessor(order, stream.columns, silence), stream.schema, "Append", mode)


def put_buckets(ts: str, start: float, dt: float, eps: float = 1e-5) -> Column:
    """Buckets of one put: array<struct<bucket, i>>, ``i`` the index of the record that fills it.

    The put starts at its own first bucket; gaps come from the next record.
    """
    def at(t: Column) -> Column:
        return F.floor((t - F.lit(start)) / F.lit(dt) + F.lit(eps)).cast("bigint")

    t = F.col(ts)
    # each time beside the one before it, so every entry is looked at once
    before = F.concat(F.array(F.lit(None).cast("double")), F.slice(t, 1, F.greatest(F.lit(0), F.size(t) - 1)))
    steps = F.zip_with(before, t, lambda p, c: F.struct(at(p).alias("p"), at(c).alias("c")))
    steps = F.transform(steps, lambda s, i: F.struct(s["p"].alias("p"), s["c"].alias("c"), i.alias("i")))
    steps = F.filter(steps, lambda s: (s["c"] >= 0) & (s["p"].isNull() | (s["p"] < 0) | (s["c"] > s["p"])))
    return F.flatten(F.transform(steps, lambda s: F.transform(
        F.sequence(F.when(s["p"].isNull() | (s["p"] < 0), s["c"]).otherwise(s["p"] + 1), s["c"]),
        lambda b: F.struct(b.alias("bucket"), s["i"].alias("i")))))


def action_accumulator_stream(puts: DataFrame, start: float, dt: float, value: str, key: str = "episode_id", put: str = "put_no") -> DataFrame:
    """Action buffer over a stream of puts (update mode): later puts overwrite buckets.

    A put is one row with sorted ``ts`` and ``value`` arrays.  Expanding it needs
    no state; the overwrite is a streaming ``max_by`` per (key, bucket).
    """
    d = puts.where(F.size("ts") > 0).withColumn("__b", F.explode(put_buckets("ts", start, dt)))
    d = d.select(key, put, F.col("__b.bucket").alias("bucket"), F.get(value, F.col("__b.i")).alias(value))
    return d.groupBy(key, "bucket").agg(F.max_by(value, put).alias(value), F.max(put).alias(put))


class _ActionProcessor(_Timed):
    """Holds the open buckets of an episode in pages; a later put overwrites."""

    def __init__(self, key: str, put: str, kind: str, silence: float):
        super().__init__(silence, "long")
        self.put, self.kind = put, kind
        self.row = Row(key, "buckets", "puts", "values")

    def init(self, handle) -> None:
        super().init(handle)
        self.pages = handle.getMapState("pages", "page long", f"buckets array<long>, puts array<long>, values array<{self.kind}>")

    def handleInputRows(self, key, rows, timerValues):
        new, newest = {}, None
        for _, ms, put, buckets, values in self.timed(rows, self.put, "buckets", "values"):
            if not buckets:
                continue
            newest = _later(newest, ms)
            for bucket, value in zip(buckets, values):
                page = new.setdefault(bucket // PAGE, {})
                if bucket not in page or put >= page[bucket][0]:
                    page[bucket] = (put, value)
        if new:
            old = self.recall()
            self.remember(old, newest, old[1])
            for no, page in new.items():
                if old[0] is not None and self.pages.containsKey((no,)):
                    for bucket, put, value in zip(*self.pages.getValue((no,))):
                        if bucket not in page or put > page[bucket][0]:
                            page[bucket] = (put, value)
                self.pages.updateValue((no,), (list(page), [p for p, _ in page.values()], [v for _, v in page.values()]))
        return iter(())

    def flush(self, key):
        for _, (buckets, puts, values) in self.pages.iterator():
            yield self.row(key[0], list(buckets), list(puts), list(values))
        self.pages.clear()


def action_buffer_stream(
    puts: DataFrame, start: float, dt: float, value: str, silence: float, time: str, delay: str = "0 seconds",
    key: str = "episode_id", put: str = "put_no",
) -> DataFrame:
    """Action buffer of every episode, handed on once, when it has been silent for ``silence`` seconds (append mode).

    Puts as in :func:`action_accumulator_stream`, with the event time ``time``.  Returns
    key, bucket, put and value; the state holds the buckets of running episodes alone.
    A put without times only moves the watermark on.
    """
    use_state_store(puts)
    kind = puts.schema[value].dataType.elementType
    at = put_buckets("ts", start, dt)
    d = puts.select(
        key, F.coalesce(put, F.lit(0).cast("long")).alias(put), time, F.transform(at, lambda x: x["bucket"]).alias("buckets"),
        F.transform(at, lambda x: F.get(value, x["i"])).alias("values"),
    )
    longs = ArrayType(LongType())
    out = StructType([puts.schema[key], StructField("buckets", longs), StructField("puts", longs), StructField("values", ArrayType(kind))])
    p = _ActionProcessor(key, put, kind.simpleString(), silence)
    pages = _with_time(d, time, silence, delay).groupBy(key).transformWithState(p, out, "Append", "EventTime")
    each = pages.select(key, F.explode(F.arrays_zip("buckets", "puts", "values")).alias("__e"))
    return each.select(key, F.col("__e.buckets").alias("bucket"), F.col("__e.puts").cast(puts.schema[put].dataType).alias(put), F.col("__e.values").alias(value))


def attach_camera_stream(
    frames: DataFrame, camera: DataFrame, dt: float, cols: Sequence[str], start: str, frame_time: str, camera_time: str,
    max_gap: str, delay: str = "0 seconds", key: str = "episode_id", order: str = "ts", eps: float = 1e-5,
) -> DataFrame:
    """Give every frame the camera record of its clock bucket, live (append mode).

    A frame carries the ``start`` of its recording (seconds) and ``frame_time``, the
    time of its bucket (start + frame_idx * dt); a camera record its ``ts`` and
    ``camera_time``.  The record of a bucket is the first one that is not before it, so
    frames meet the records of an interval: from the bucket's time to ``max_gap`` later.
    Both sides have a watermark; a frame is held for ``max_gap``, a record until no
    frame can ask for it, and the earliest record is handed on when the watermark has
    passed the interval.  Rows that come later than ``delay`` behind the newest row of
    the slower side are dropped; a gap in the camera longer than ``max_gap`` leaves its
    frames without a row, where the batch form reaches farther.
    """
    f = frames.withWatermark(frame_time, delay).select(*[F.col(c) if c == frame_time else F.col(c).alias(f"__f_{c}") for c in frames.columns])
    c = camera.withWatermark(camera_time, delay).select(
        F.col(key).alias("__c_key"), F.col("ts").alias("__c_ts"), F.col(camera_time).alias("__c_time"), F.col(order).alias("__c_order"), *[F.col(x).alias(f"__c_{i}") for i, x in enumerate(cols)]
    )
    bucket = F.floor((F.col("__c_ts") - F.col(f"__f_{start}")) / F.lit(dt) + F.lit(eps))
    near = (F.col("__c_time") >= F.col(frame_time) - F.expr("INTERVAL 1 SECOND")) & (F.col("__c_time") <= F.col(frame_time) + F.expr(f"INTERVAL {max_gap}"))
    met = f.join(c, F.col(f"__f_{key}").eqNullSafe(F.col("__c_key")) & near & (bucket >= F.col("__f_frame_idx")))
    held = [x for x in frames.columns if x != frame_time]
    first = F.min_by(F.struct(F.col("__c_ts").alias("ts"), *[F.col(f"__c_{i}").alias(f"c{i}") for i in range(len(cols))]), F.struct("__c_ts", "__c_order"))
    got = met.groupBy(frame_time, *[F.col(f"__f_{x}") for x in held]).agg(first.alias("__r"))
    return got.select(*[F.col(f"__f_{x}").alias(x) for x in held], frame_time, F.col("__r.ts").alias("camera_ts"), *[F.col(f"__r.c{i}").alias(x) for i, x in enumerate(cols)])


def latest(updates: DataFrame, keys: Sequence[str], version: str = "batch_id") -> DataFrame:
    """Last version of every key of an update-mode log."""
    rest = [c for c in updates.columns if c not in (*keys, version)]
    return updates.groupBy(*keys).agg(F.max_by(F.struct(*rest), version).alias("r")).select(*keys, "r.*")
