"""Packing frames into the fixed vector layout, and small vector transforms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from episodica.functions.layout import ARM_DIM, AREAS_PER_HAND, GRIPPER_SLOT, HAND_SLOTS, POSE_DIM, SIDE_DIM, SUPP_DIM
from episodica.functions.vec import on_runs, pad_to, sub, zeros

JOINT_MODES = {"abs": "absolute", "absolute": "absolute", "relative": "relative", "mix": "mix"}


def joint_mode(mode: str) -> str:
    m = JOINT_MODES.get(mode.strip().lower())
    if m is None:
        raise ValueError(f"unknown joint representation {mode}")
    return m


def _arm(c: Column) -> Column:
    too_wide = F.raise_error(F.lit(f"more than {ARM_DIM} arm joints")).cast("array<double>")
    return F.when(c.isNull(), zeros(ARM_DIM)).when(F.size(c) > ARM_DIM, too_wide).otherwise(pad_to(c, ARM_DIM))


def scatter_slots(values: Column, slots: Column) -> Column:
    """Values placed by slot id; a repeated slot takes its last value, absent ones 0."""
    v, s = F.reverse(values), F.reverse(slots)
    return F.transform(F.sequence(F.lit(0), F.lit(HAND_SLOTS - 1)),
                       lambda k: F.coalesce(F.get(v, F.array_position(s, k).cast("int") - 1), F.lit(0.0)))


def joints_relative(values: Column, base: Column, mode: str, slots: Column | None = None) -> Column:
    """Joints relative to the base values; in ``mix`` the gripper slot stays absolute."""
    m = joint_mode(mode)
    if m == "absolute":
        return values
    rel = sub(values, base)
    if m == "relative" or slots is None:
        return rel
    return F.zip_with(F.zip_with(values, rel, lambda a, r: F.struct(a.alias("a"), r.alias("r"))), slots,
                      lambda p, s: F.when(s == GRIPPER_SLOT, p["a"]).otherwise(p["r"]))


def side_vector(pose9: Column, arm: Column, hand: Column, slots: Column) -> Column:
    """9 pose + 7 arm + 32 hand values of one side; all zero without hand joints."""
    full = F.concat(F.coalesce(pose9, zeros(POSE_DIM)), _arm(arm), scatter_slots(hand, slots))
    return F.when(hand.isNull(), zeros(SIDE_DIM)).otherwise(full)


def side_mask(pose9: Column, arm: Column, hand: Column, slots: Column, usage: Column | None = None) -> Column:
    """Validity of one side's positions; a hand-usage value scales the whole side."""
    one = lambda n: F.array_repeat(F.lit(1.0), n)
    pose = F.when(pose9.isNull(), zeros(POSE_DIM)).otherwise(one(POSE_DIM))
    arm_m = F.when(arm.isNull(), zeros(ARM_DIM)).otherwise(pad_to(one(F.size(arm)), ARM_DIM))
    hand_m = scatter_slots(F.transform(slots, lambda _: F.lit(1.0)), slots)
    m = F.when(hand.isNull(), zeros(SIDE_DIM)).otherwise(F.concat(pose, arm_m, hand_m))
    if usage is None:
        return m
    u = F.coalesce(usage.cast("double"), F.lit(1.0))
    return F.transform(m, lambda x: x * u)


def _supp(c: Column) -> Column:
    return F.when(c.isNull(), zeros(SUPP_DIM)).otherwise(pad_to(c, SUPP_DIM))


def pack_state(df: DataFrame, out: str = "state", proprio: str = "absolute") -> DataFrame:
    """State vector in the order right, left, head, supplementary.

    Reads ``{side}_pose9, {side}_arm_joints, {side}_hand_joints,
    {side}_hand_joints_idx, head_pose9, supplementary_joints``; with a relative
    proprioception, joints are relative to ``*_base`` columns (the last state).
    """
    parts = []
    rel = joint_mode(proprio) == "relative"

    def joints(name: str) -> Column:
        c = F.col(name)
        base = F.col(f"{name}_base") if f"{name}_base" in df.columns else c
        return F.when(c.isNotNull(), sub(c, base)) if rel else c

    for s in ("right", "left"):
        parts.append(side_vector(F.col(f"{s}_pose9"), joints(f"{s}_arm_joints"), joints(f"{s}_hand_joints"), F.col(f"{s}_hand_joints_idx")))
    parts += [F.coalesce(F.col("head_pose9"), zeros(POSE_DIM)), _supp(joints("supplementary_joints"))]
    return df.withColumn(out, F.concat(*parts))


def pack_actions(df: DataFrame, mode: str = "absolute") -> DataFrame:
    """``actions`` and ``action_mask``: one packed vector per chunk step.

    Reads ``chunk_*`` arrays (one entry per step) beside the current row's
    columns, which are the base of relative joints and name the hand slots.
    """
    m = joint_mode(mode)
    cols = set(df.columns)
    # an absent stream is NULL, so the longest chunk gives the horizon
    horizon = F.greatest(F.lit(0), *[F.size(c) for c in df.columns if c.startswith("chunk_")])
    steps = F.when(horizon > 0, F.sequence(F.lit(0), horizon - 1))

    def at(name: str, k: Column) -> Column:
        return F.get(F.col(f"chunk_{name}"), k)

    def vector(k: Column) -> Column:
        parts = []
        for s in ("right", "left"):
            slots = F.col(f"{s}_hand_joints_idx")
            arm = at(f"{s}_arm_joints", k)
            hand = at(f"{s}_hand_joints", k)
            if m != "absolute":
                arm = F.when(arm.isNotNull(), sub(arm, F.col(f"{s}_arm_joints")))
                hand = F.when(hand.isNotNull(), joints_relative(hand, F.col(f"{s}_hand_joints"), m, slots))
            parts.append(side_vector(at(f"{s}_pose9", k), arm, hand, slots))
        supp = at("supplementary_joints", k)
        if m == "relative":
            supp = F.when(supp.isNotNull(), sub(supp, F.col("supplementary_joints")))
        return F.concat(*parts, F.coalesce(at("head_pose9", k), zeros(POSE_DIM)), _supp(supp))

    def mask(k: Column) -> Column:
        parts = []
        for s in ("right", "left"):
            usage = F.get(F.col(f"chunk_{s}_hand_usage"), k) if f"chunk_{s}_hand_usage" in cols else None
            parts.append(side_mask(at(f"{s}_pose9", k), at(f"{s}_arm_joints", k), at(f"{s}_hand_joints", k), F.col(f"{s}_hand_joints_idx"), usage))
        head, supp = at("head_pose9", k), at("supplementary_joints", k)
        parts.append(F.when(head.isNull(), zeros(POSE_DIM)).otherwise(F.array_repeat(F.lit(1.0), POSE_DIM)))
        parts.append(F.when(supp.isNull(), zeros(SUPP_DIM)).otherwise(pad_to(F.array_repeat(F.lit(1.0), F.size(supp)), SUPP_DIM)))
        return F.concat(*parts)

    return df.withColumn("actions", F.transform(steps, vector)).withColumn("action_mask", F.transform(steps, mask))


# Fixed priority of the camera columns.
CAMERAS = ["camera_main_rgb", "camera_ego_rgb", "right_wrist_camera_rgb", "left_wrist_camera_rgb"]


def coalesce_camera(frames: DataFrame, cameras: Sequence[str] = CAMERAS, out: str = "base_image") -> DataFrame:
    """First available camera by priority (none is an error) and a presence mask per camera."""
    have = [c for c in cameras if c in frames.columns]
    base = F.coalesce(*[F.col(c) for c in have]) if have else F.lit(None)
    checked = F.coalesce(base, F.raise_error(F.lit("a frame has no camera image")).cast(frames.schema[have[0]].dataType)) if have \
        else F.raise_error(F.lit("a frame has no camera image"))
    masks = {f"{c}_mask": (F.col(c).isNotNull() if c in have else F.lit(False)) for c in cameras}
    return frames.withColumn(out, checked).withColumns(masks)


def side_area_offset(areas: Column, side: Column) -> Column:
    """Left-hand area ids are shifted past the right hand's."""
    return F.when(side == "left", F.transform(areas, lambda x: x + AREAS_PER_HAND)).otherwise(areas)


def prompt_clean(text: Column, domain: Column | None = None, lower: bool = False, flatten: bool = False) -> Column:
    """Prompt text: trimmed, ending with "."; optional ``[domain] `` prefix.

    ``flatten`` turns underscores and newlines to blanks; ``lower`` lowercases.
    """
    t = F.regexp_replace(F.coalesce(text, F.lit("finish tasks.")), r"^\s+|\s+$", "")
    t = F.when(F.endswith(t, F.lit(".")), t).otherwise(F.concat(t, F.lit(".")))
    if domain is not None:
        t = F.concat(F.lit("["), domain.cast("string"), F.lit("] "), t)
    if lower:
        t = F.lower(t)
    if flatten:
        t = F.translate(t, "_\n", "  ")
    return t


def delta_actions(chunk: Column, state: Column, runs: Sequence[int]) -> Column:
    """Subtract the state from every step in the positive ones of the signed runs (2, -2, 3: dims 0, 1, 4, 5, 6)."""
    return F.transform(chunk, lambda a: on_runs(a, state, runs, lambda x, s: x - s))


def absolute_actions(chunk: Column, state: Column, runs: Sequence[int]) -> Column:
    """Undo :func:`delta_actions`."""
    return F.transform(chunk, lambda a: on_runs(a, state, runs, lambda x, s: x + s))


def pad_dims(v: Column, n: int) -> Column:
    """Zero-pad to ``n`` entries; wider vectors stay as they are."""
    return pad_to(v, n)


def subsample_chunk(chunk: Column, k: int) -> Column:
    """Every k-th step of a chunk."""
    return F.filter(chunk, lambda _, i: i % k == 0)


def discretize_state(x: Column, bins: int = 256) -> Column:
    """Bin index of [-1, 1] values; below the range -1, above it the last bin."""
    top = F.lit(bins - 1)
    return F.transform(x, lambda v: F.when(F.isnan(v), top).when(v < -1, F.lit(-1)).otherwise(
        F.least(F.floor((v + 1) * (bins / 2.0)), top.cast("bigint"))).cast("int"))


def state_text(x: Column, bins: int = 256) -> Column:
    """The bins as blank-separated text."""
    return F.array_join(discretize_state(x, bins).cast("array<string>"), " ")


def undiscretize(tokens: Column, bins: int = 256) -> Column:
    return F.transform(tokens, lambda t: t / bins * 2 - 1)


def pixel_scale(x: Column, detect: bool = False) -> Column:
    """0..255 -> -1..1; with ``detect`` values that never exceed 1 are left alone."""
    scaled = F.transform(x, lambda v: v / 255.0 * 2.0 - 1.0)
    return F.when(F.array_max(x) > 1.0, scaled).otherwise(F.transform(x, lambda v: v.cast("double"))) if detect else scaled


def pixel_unscale(x: Column) -> Column:
    return F.transform(x, lambda v: (v + 1.0) / 2.0 * 255.0)
