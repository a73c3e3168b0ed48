"""Clock alignment, resampling and windows of frames.

Inputs carry a dense ``frame_idx`` per episode (see ``index_frames``).  As-of
lookups against a regular grid are *interval explodes*: every record owns the
grid points up to its successor, so no union, no join and no unbounded sort.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from episodica.plans.ordered import explode_range, halo, join_same, number_rows, prefix

EP = ("episode_id",)


def _col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def grid_align(
    samples: DataFrame,
    start,
    dt,
    keys: Sequence[str] = EP,
    eps: float = 1e-5,
    first: int | None = 0,
    allow_negative: bool = False,
    stop=None,
    out: str = "bucket",
) -> DataFrame:
    """Assign records to clock buckets ``floor((ts - start) / dt + eps)``.

    A bucket takes the first record whose own bucket is not before it, so gaps
    are filled from the next record.  Numbering starts at ``first``; with
    ``None`` at the first record's bucket.  ``stop`` is the last bucket kept.
    """
    g = F.floor((F.col("ts") - _col(start)) / _col(dt) + F.lit(eps))
    d = samples.withColumn("__g", g)
    if not allow_negative:
        d = d.where(F.col("__g") >= 0)
    d = prefix(d, keys, "frame_idx", {"__prev": ("max", F.col("__g"))}, current=False)
    nxt = F.coalesce(F.col("__prev") + 1, F.col("__g")) if first is None else F.greatest(F.col("__prev") + 1, F.lit(first))
    hi = F.col("__g") if stop is None else F.least(F.col("__g"), _col(stop))
    return explode_range(d, nxt, hi, out).drop("__g", "__prev")


def align_to_targets(samples: DataFrame, start, dt, lo: int, hi: int, keys: Sequence[str] = EP, eps: float = 1e-5) -> DataFrame:
    """Exactly one record per target bucket ``lo..hi``; a missing tail repeats the last record."""
    keys = list(keys)
    got = grid_align(samples, start, dt, keys, eps, lo, True, hi)
    g = F.floor((F.col("ts") - _col(start)) / _col(dt) + F.lit(eps))
    last = samples.groupBy(*keys).agg(
        F.max(g).alias("__g"), F.max_by(F.struct(*[c for c in samples.columns if c not in keys]), "frame_idx").alias("__r"))
    tail = explode_range(last, F.greatest(F.col("__g") + 1, F.lit(lo)), F.lit(hi), "bucket", spread=True)
    return got.unionByName(tail.select(*keys, "__r.*", "bucket"))


def attach_camera(frames: DataFrame, camera: DataFrame, dt: float, cols: Sequence[str], keys: Sequence[str] = EP) -> DataFrame:
    """Give every frame the camera record of its clock bucket.

    Camera rows more than ``dt`` before the first frame are ignored.  Frames
    after the camera's end are dropped.  The camera's own time is kept as
    ``camera_ts``.
    """
    keys = list(keys)
    span = frames.groupBy(*keys).agg(F.min("ts").alias("__start"), F.max("frame_idx").alias("__last"))
    cam = join_same(camera, span, keys).where(F.col("ts") >= F.col("__start") - dt)
    cam = grid_align(cam, F.col("__start"), dt, keys, stop=F.col("__last"))
    cam = cam.select(*keys, F.col("bucket").alias("frame_idx"), F.col("ts").alias("camera_ts"), *cols)
    return join_same(frames, cam, [*keys, "frame_idx"])


def obs_accumulator(samples: DataFrame, start, dt, keys: Sequence[str] = EP) -> DataFrame:
    """Observation buffer: earlier buckets are never overwritten; adds the bucket's clock time."""
    d = grid_align(samples, start, dt, keys)
    return d.withColumn("bucket_ts", _col(start) + F.col("bucket") * _col(dt))


def action_accumulator(samples: DataFrame, start, dt, value: Sequence[str], put: str = "put_no", keys: Sequence[str] = EP) -> DataFrame:
    """Action buffer: each put starts at its own first bucket and overwrites earlier puts."""
    keys = list(keys)
    d = grid_align(samples, start, dt, [*keys, put], first=None)
    return d.groupBy(*keys, "bucket").agg(
        F.max_by(F.struct("ts", *value), put).alias("__r"), F.max(put).alias(put)
    ).select(*keys, "bucket", put, "__r.*")


def strictly_newer(samples: DataFrame, keys: Sequence[str] = EP, idx: str = "frame_idx") -> DataFrame:
    """Keep a record only if its time exceeds that of the last kept one, in arrival order ``idx``."""
    d = prefix(samples, keys, idx, {"__seen": ("max", F.col("ts"))}, current=False)
    return d.where(F.col("__seen").isNull() | (F.col("ts") > F.col("__seen"))).drop("__seen")


def grid_params(frames: DataFrame, speed: float, keys: Sequence[str] = EP) -> DataFrame:
    """Start, step and last index of the new clock; ``speed > 1`` makes more frames."""
    n = F.count(F.lit(1))
    g = frames.groupBy(*keys).agg(F.min("ts").alias("t_start"), F.max("ts").alias("t_end"), n.alias("n_org")).where("n_org > 1")
    dt = (F.col("t_end") - F.col("t_start")) / (F.col("n_org") - 1) / F.lit(float(speed))
    g = g.withColumn("dt", dt).where("dt > 0")
    return g.withColumn("n_last", F.floor((F.col("t_end") - F.col("t_start")) / F.col("dt"))).drop("t_end", "n_org")


def resample_grid(frames: DataFrame, speed: float, keys: Sequence[str] = EP) -> DataFrame:
    """New clock of every episode: (keys, grid_idx, t)."""
    g = explode_range(grid_params(frames, speed, keys), F.lit(0), F.col("n_last"), "grid_idx", spread=True)
    return g.select(*keys, "grid_idx", (F.col("t_start") + F.col("grid_idx") * F.col("dt")).alias("t"))


def bracket(frames: DataFrame, grid: DataFrame, cols: Sequence[str], keys: Sequence[str] = EP) -> DataFrame:
    """Each grid point with the records around it.

    ``grid`` comes from :func:`grid_params`.  Returns keys, grid_idx, t, the
    record at or before t, the one after as ``next_*`` and the fraction ``w``.
    """
    keys = list(keys)
    d, win, home = halo(frames.select(*keys, "frame_idx", "ts", *cols), keys, "frame_idx", after=1)
    d = d.select("*", *[F.lead(c).over(win).alias(f"next_{c}") for c in ("ts", *cols)]).where(home).drop("__blk")
    d = join_same(d, grid, keys)
    to_k = lambda c: F.floor((c - F.col("t_start")) / F.col("dt"))
    lo = F.greatest(F.lit(0), to_k(F.col("ts")) - 1)
    hi = F.least(F.col("n_last"), F.coalesce(to_k(F.col("next_ts")) + 1, F.col("n_last")))
    d = explode_range(d, lo, hi, "grid_idx").withColumn("t", F.col("t_start") + F.col("grid_idx") * F.col("dt"))
    # candidate range is one step wide on both sides; the times decide
    d = d.where((F.col("t") >= F.col("ts")) & (F.col("next_ts").isNull() | (F.col("t") < F.col("next_ts"))))
    w = F.when(F.col("next_ts").isNull(), F.lit(0.0)).otherwise((F.col("t") - F.col("ts")) / (F.col("next_ts") - F.col("ts")))
    return d.withColumn("w", w).drop("t_start", "dt", "n_last")


def lerp_cols(name: str) -> Column:
    """Linear value of a scalar column of a bracket, end-clamped."""
    a, b = F.col(name), F.col(f"next_{name}")
    return F.when(F.col("next_ts").isNull(), a).otherwise(a + (b - a) * F.col("w"))


def lerp_array(name: str) -> Column:
    """Linear value of an array column of a bracket, end-clamped."""
    a, b = F.col(name), F.col(f"next_{name}")
    return F.when(F.col("next_ts").isNull(), a).otherwise(F.zip_with(a, b, lambda x, y: x + (y - x) * F.col("w")))


def interp_linear(frames: DataFrame, speed: float, cols: Sequence[str], keys: Sequence[str] = EP) -> DataFrame:
    """Linear interpolation of scalar or array columns on the new clock."""
    b = bracket(frames, grid_params(frames, speed, keys), cols, keys)
    arrays = {f.name for f in frames.schema.fields if f.dataType.typeName() == "array"}
    return b.select(*keys, "grid_idx", "t", *[(lerp_array(c) if c in arrays else lerp_cols(c)).alias(c) for c in cols])


def interp_floor(frames: DataFrame, speed: float, cols: Sequence[str], first: Sequence[str] = (), keys: Sequence[str] = EP) -> DataFrame:
    """Categorical columns take the record at or before the grid time; ``first`` columns the episode's first value."""
    keys = list(keys)
    b = bracket(frames, grid_params(frames, speed, keys), cols, keys).select(*keys, "grid_idx", "t", *cols)
    if first:
        f = frames.where("frame_idx = 0").select(*keys, *[F.col(c).alias(f"first_{c}") for c in first])
        b = join_same(b, f, keys)
    return b


def history(frames: DataFrame, cols: Sequence[str], offsets: Sequence[int], keys: Sequence[str] = EP, disable_history: bool = False) -> DataFrame:
    """Arrays [t - d_n, ..., t - d_1, t] per column (``hist_*``), clamped to the episode, oldest first."""
    if disable_history and len(offsets) > 0:
        raise ValueError("history offsets must be empty when history is disabled")
    steps = list(reversed(list(offsets)))
    if not steps:
        return frames.select("*", *[F.array(c).alias(f"hist_{c}") for c in cols])
    d, w, home = halo(frames, keys, "frame_idx", before=max(steps))
    out = []
    for c in cols:
        start = F.first(c).over(w.rowsBetween(W.unboundedPreceding, 0))
        vals = [F.when(F.col("frame_idx") < k, start).otherwise(F.lag(c, k).over(w)) for k in steps]
        out.append(F.array(*vals, F.col(c)).alias(f"hist_{c}"))
    return d.select("*", *out).where(home).drop("__blk")


def _field_at(arr: str, name: str):
    return lambda i: F.get(F.col(arr), i)[name]


def action_chunk(
    frames: DataFrame, cols: Sequence[str], horizon: int, stride: int = 1, clamp: bool = False, keys: Sequence[str] = EP
) -> DataFrame:
    """Future rows t, t+s, ... of the episode as ``chunk_*`` arrays of length ``horizon``.

    ``n_valid`` steps lie inside the episode; the rest repeat the last strided
    step, or the last frame of the episode when ``clamp``.
    """
    reach = (horizon - 1) * stride
    d, w, home = halo(frames, keys, "frame_idx", after=reach)
    ahead = F.collect_list(F.struct(*cols)).over(w.rowsBetween(0, reach))
    d = d.withColumn("__a", ahead).where(home).drop("__blk")
    n = F.floor((F.size("__a") - 1) / stride) + 1
    d = d.withColumn("n_valid", n.cast("int"))
    if stride == 1:  # the last step is the last frame: append copies of it, no lambda needed
        def padded(c: str) -> Column:
            v = F.col("__a")[c]
            return F.concat(v, F.array_repeat(F.element_at(v, -1), F.lit(horizon) - F.size(v)))

        return d.select(*[c for c in d.columns if c != "__a"], *[padded(c).alias(f"chunk_{c}") for c in cols])
    last = F.size("__a") - 1 if clamp else (F.col("n_valid") - 1) * stride
    idx = F.transform(F.sequence(F.lit(0), F.lit(horizon - 1)), lambda k: F.least(k * stride, last))
    d = d.withColumn("__i", idx)
    return d.select(
        *[c for c in d.columns if c not in ("__a", "__i")],
        *[F.transform("__i", _field_at("__a", c)).alias(f"chunk_{c}") for c in cols],
    )


def chunk_weights(
    frames: DataFrame, horizon: int, stride: int = 1, clamp: bool = False, keys: Sequence[str] = EP, out: str = "weights"
) -> DataFrame:
    """How often a frame stands at each step of the chunks of :func:`action_chunk`, without making them.

    ``out`` is an array over the steps.  At step k a frame stands in the chunk that
    begins k strides before it; the frames at which padding stops (the last one with
    ``clamp``, else the last ``stride`` ones) also stand in the chunks that end there.
    """
    keys = list(keys)
    length = frames.groupBy(*keys).agg((F.max("frame_idx") + 1).alias("__len"))
    d = join_same(frames, length, keys)
    f, n = F.col("frame_idx"), F.col("__len")

    def at(k: Column) -> Column:
        inside = (f >= k * stride).cast("long")
        if clamp:
            return inside + F.when(f == n - 1, F.least(k * stride, n)).otherwise(0)
        return inside + F.when(f > n - 1 - stride, F.least(k, F.floor(f / stride) + 1)).otherwise(0)

    return d.withColumn(out, F.transform(F.sequence(F.lit(0).cast("long"), F.lit(horizon - 1).cast("long")), at)).drop("__len")


def lookahead_by_time(frames: DataFrame, cols: Sequence[str], fps: float, deltas: Sequence[float], keys: Sequence[str] = EP) -> DataFrame:
    """Rows at time offsets ``deltas`` (seconds) of a clock with ``fps`` frames per second.

    Offsets are whole frames, ``round(delta * fps)``; past the end the last
    frame repeats and ``is_pad`` is true.
    """
    steps = [int(round(x * fps)) for x in deltas]
    if any(s < 0 for s in steps):
        raise ValueError("look-ahead offsets must not be negative")
    reach = max(steps)
    d, w, home = halo(frames, keys, "frame_idx", after=reach)
    d = d.withColumn("__a", F.collect_list(F.struct(*cols)).over(w.rowsBetween(0, reach))).where(home).drop("__blk")
    n = F.size("__a")
    d = d.select("*", F.array(*[F.lit(s) >= n for s in steps]).alias("is_pad"),
                 *[F.array(*[F.get("__a", F.least(F.lit(s), n - 1))[c] for s in steps]).alias(f"at_{c}") for c in cols])
    return d.drop("__a")


def lookahead_by_ts(frames: DataFrame, cols: Sequence[str], deltas: Sequence[float], tolerance: float, keys: Sequence[str] = EP,
                    block_seconds: float = 3600.0) -> DataFrame:
    """Frames nearest to ``ts + delta`` on the recorded clock, a row per frame and delta.

    Returns keys, frame_idx, ``k`` (position of the delta), is_pad (past the last
    frame, which then repeats), is_off (no frame within ``tolerance`` seconds) and
    the ``cols``.  Of two frames equally near the earlier one counts.  Targets
    are merged into the frames' order and see their neighbours through running values,
    so a long episode is cut into blocks of ``block_seconds``.
    """
    keys, none = list(keys), F.lit(None)
    row = F.struct("ts", *cols)
    kind = frames.select(row.alias("r")).schema["r"].dataType
    own = frames.select(*keys, "frame_idx", "ts", row.alias("__r"), none.cast("int").alias("k"))
    wanted = frames.select(*keys, "frame_idx", "ts", F.posexplode(F.array(*[F.lit(float(d)) for d in deltas])).alias("k", "__d"))
    wanted = wanted.select(*keys, "frame_idx", (F.col("ts") + F.col("__d")).alias("ts"), none.cast(kind).alias("__r"), "k")
    d = number_rows(own.unionByName(wanted), keys, ["ts", "k", "frame_idx"], F.floor(F.col("ts") / block_seconds), "__i")
    d = prefix(d, keys, "__i", {"__b": ("last", F.col("__r"))})
    d = prefix(d, keys, "__i", {"__a": ("last", F.col("__r"))}, reverse=True).where(F.col("k").isNotNull())
    before, after = F.col("ts") - F.col("__b.ts"), F.col("__a.ts") - F.col("ts")
    pick = F.when(F.col("__a").isNull() | (before <= after), F.col("__b")).otherwise(F.col("__a"))
    d = d.withColumn("__p", pick).withColumn("is_pad", F.col("__a").isNull() & (before > 0))
    off = ~F.col("is_pad") & (F.abs(F.col("__p.ts") - F.col("ts")) > F.lit(float(tolerance)))
    return d.select(*keys, "frame_idx", "k", "is_pad", off.alias("is_off"), *[F.col("__p")[c].alias(c) for c in cols])


def instruction_boundary_mask(chunks: DataFrame, instructions: str, mask: str) -> DataFrame:
    """Prompt = first instruction of the chunk; mask every step from the first change on."""
    d = chunks.withColumn("prompt", F.get(instructions, F.lit(0)))
    differs = F.transform(F.col(instructions), lambda x: ~x.eqNullSafe(F.col("prompt")))
    d = d.withColumn("__c", F.array_position(differs, F.lit(True)))
    m = F.transform(F.col(mask), lambda x, i: F.when((F.col("__c") > 0) & (i >= F.col("__c") - 1), F.lit(0).cast("double")).otherwise(x))
    return d.withColumn(mask, m).drop("__c")


def open_loop_steps(chunks: DataFrame, chunk: str, horizon: int, keys: Sequence[str] = EP) -> DataFrame:
    """Executed step t takes element t % H of the chunk predicted at floor(t / H) * H.

    Rows between predictions are never read, so no join is needed; ``n_valid``
    bounds the steps to the episode.
    """
    d = chunks.where(F.col("frame_idx") % horizon == 0)
    d = d.select(*keys, "frame_idx", "n_valid", F.posexplode(F.slice(chunk, 1, horizon)).alias("__k", "action"))
    return d.where(F.col("__k") < F.col("n_valid")).select(
        *keys, (F.col("frame_idx") + F.col("__k")).alias("frame_idx"), F.col("frame_idx").alias("predicted_at"), "action")


def static_window_flag(
    frames: DataFrame, pose: Sequence[Column], before: int, horizon: int, stride: int = 1, margin: int = 5,
    keys: Sequence[str] = EP, atol: float = 1e-6, rtol: float = 1e-5,
) -> DataFrame:
    """``is_static``: no pose entry leaves its value at the start of the window.

    The window runs from ``before + margin`` frames back to ``margin - 1`` frames
    past the last action step, inside the episode.
    """
    reach = (horizon - 1) * stride
    names = [f"__p{i}" for i in range(len(pose))]
    d = frames.select("*", *[c.alias(n) for c, n in zip(pose, names)])
    d, w, home = halo(d, keys, "frame_idx", before=before + margin, after=reach + margin - 1)
    frame = w.rowsBetween(-(before + margin), reach + margin - 1)
    if stride <= margin:  # the last action step is within the margin of the frame's end
        ok = F.lit(True)
        cols = []
        for n in names:
            cols += [F.first(n).over(frame).alias(f"{n}f"), F.min(n).over(frame).alias(f"{n}l"), F.max(n).over(frame).alias(f"{n}h")]
            tol = F.lit(atol) + F.lit(rtol) * F.abs(F.col(f"{n}f"))
            ok = ok & (F.col(f"{n}h") - F.col(f"{n}f") <= tol) & (F.col(f"{n}f") - F.col(f"{n}l") <= tol)
        d = d.select("*", *cols).where(home).withColumn("is_static", ok)
        extra = [f"{n}{s}" for n in names for s in "flh"]
    else:
        d = d.select("*", F.collect_list(F.array(*names)).over(frame).alias("__w"),
                     F.count(F.lit(1)).over(w.rowsBetween(0, reach)).alias("__n")).where(home)
        back = F.least(F.col("frame_idx"), F.lit(before + margin))
        keep = back + F.floor((F.col("__n") - 1) / stride) * stride + margin
        d = d.withColumn("__w", F.slice("__w", F.lit(1), keep.cast("int")))
        d = d.withColumn("is_static", F.forall("__w", lambda r: F.forall(
            F.zip_with(r, F.get("__w", F.lit(0)), lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda b: b)))
        extra = ["__w", "__n"]
    return d.drop("__blk", *names, *extra)
