"""Rigid-body geometry over frame columns: native expressions, no UDF.

Each step of a chain is its own column, which keeps expression trees small and
lets whole-stage code generation evaluate every intermediate once per row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from episodica.functions import rotation as R
from episodica.operators.align import bracket, grid_params
from episodica.plans.ordered import halo, join_same, number_rows, prefix

WIDTH = {"rotvec": 3, "quat": 4, "euler": 3, "mat": 9, "rot6d": 6}


# -------------------------------------------------------------- conversions
def rot_convert(df: DataFrame, src: str, kind: str, to: str, out: str) -> DataFrame:
    """Convert a rotation column between rotvec, quat (xyzw), euler (xyz), mat and rot6d."""
    c = R.comps(src, WIDTH[kind])
    if kind == to:
        return df.withColumn(out, F.col(src))
    if kind == "rotvec":
        df = df.withColumn("__rq", R.pack(R.rotvec_to_quat(c)))
    elif kind == "quat":
        df = df.withColumn("__rq", R.pack(R.quat_unit(c)))
    elif kind == "euler":
        df = df.withColumn("__rm", R.pack(R.euler_to_mat(c)))
    elif kind == "rot6d":
        df = _gram_schmidt(df, src, "__rm")
    else:
        df = df.withColumn("__rm", F.col(src))
    if "__rq" in df.columns and to in ("rotvec", "quat"):
        df = df.withColumn("__rq", R.pack(R.canonical(R.comps("__rq", 4))))
    elif "__rq" in df.columns:
        df = df.withColumn("__rm", R.pack(R.quat_to_mat(R.comps("__rq", 4))))
    elif to in ("rotvec", "quat"):
        df = df.withColumn("__rr", R.pack(R.mat_to_quat(R.comps("__rm", 9))))
        df = df.withColumn("__rq", R.pack(R.quat_unit(R.comps("__rr", 4)))).drop("__rr")
        df = df.withColumn("__rq", R.pack(R.canonical(R.comps("__rq", 4))))
    if to == "rotvec":
        res = R.pack(R.quat_to_rotvec(R.comps("__rq", 4)))
    elif to == "quat":
        res = F.col("__rq")
    elif to == "mat":
        res = F.col("__rm")
    elif to == "euler":
        res = R.pack(R.mat_to_euler(R.comps("__rm", 9)))
    else:
        res = R.pack(R.mat_to_rot6d(R.comps("__rm", 9)))
    return df.withColumn(out, res).drop("__rq", "__rm")


def _gram_schmidt(df: DataFrame, src: str, out: str, eps: float = 1e-12) -> DataFrame:
    a1, a2 = R.comps(src, 3), R.comps(src, 3, 3)
    n1 = R.fn("greatest", R.vnorm(a1), eps)
    df = df.withColumn("__b1", R.pack([x / n1 for x in a1]))
    b1 = R.comps("__b1", 3)
    df = df.withColumn("__b2", R.pack(R.vsub(a2, R.vscale(b1, R.dot(b1, a2)))))
    b2 = R.comps("__b2", 3)
    n2 = R.fn("greatest", R.vnorm(b2), eps)
    df = df.withColumn("__b2", R.pack([x / n2 for x in b2]))
    b2 = R.comps("__b2", 3)
    return df.withColumn(out, R.pack([*b1, *b2, *R.cross(b1, b2)])).drop("__b1", "__b2")


#: pose layouts: position first, then the rotation form
POSES = {"pose6": "rotvec", "pose7": "quat", "pose9": "rot6d", "euler_pose": "euler"}


def pose_convert(df: DataFrame, src: str, kind: str, to: str, out: str) -> DataFrame:
    """Convert rotations, or poses (``pose6/pose7/pose9/euler_pose/tf``), both ways.

    ``tf`` is twelve values: rotation rows, then position.
    """
    if kind in WIDTH:
        return rot_convert(df, src, kind, to, out)
    if kind == "tf":
        df = df.withColumn("__pos", F.slice(src, 10, 3)).withColumn("__rot", F.slice(src, 1, 9))
        rot = "mat"
    else:
        rot = POSES[kind]
        df = df.withColumn("__pos", F.slice(src, 1, 3)).withColumn("__rot", F.slice(src, 4, WIDTH[rot]))
    if to == "tf":
        df = rot_convert(df, "__rot", rot, "mat", "__out").withColumn(out, F.concat("__out", "__pos"))
    else:
        df = rot_convert(df, "__rot", rot, POSES[to], "__out").withColumn(out, F.concat("__pos", "__out"))
    return df.drop("__pos", "__rot", "__out")


def to_tf(df: DataFrame, src: str, out: str) -> DataFrame:
    """6-vector pose -> transform."""
    d = df.withColumn("__rq", R.pack(R.rotvec_to_quat(R.comps(src, 3, 3))))
    return d.withColumn(out, R.pack([*R.quat_to_mat(R.comps("__rq", 4)), *R.comps(src, 3)])).drop("__rq")


def from_tf(df: DataFrame, src: str, out: str) -> DataFrame:
    """Transform -> 6-vector pose."""
    d = df.withColumn("__rr", R.pack(R.mat_to_quat(R.comps(src, 9))))
    d = d.withColumn("__rr", R.pack(R.quat_normal(R.comps("__rr", 4))))
    return d.withColumn(out, R.pack([*R.comps(src, 3, 9), *R.quat_to_rotvec(R.comps("__rr", 4))])).drop("__rr")


def _tf(x) -> list:
    return R.comps(x, 12) if isinstance(x, str) else R.lits(x)


# --------------------------------------------------------------- transforms
def pose_transform(df: DataFrame, pose: str, tx, side: str = "left", invert: bool = False, out: str | None = None) -> DataFrame:
    """Multiply a 6-vector pose by a constant (12 numbers) or a per-row transform column."""
    d = to_tf(df, pose, "__p")
    p, x = R.comps("__p", 12), _tf(tx)
    if side == "left":
        y = R.tf_left_div(x, p) if invert else R.tf_mul(x, p)
    else:
        y = R.tf_mul(p, R.tf_inv(x) if invert else x)
    d = d.withColumn("__y", R.pack(y)).drop("__p")
    return from_tf(d, "__y", out or pose).drop("__y")


def transform_point(df: DataFrame, point: str, tx, out: str) -> DataFrame:
    return df.withColumn(out, R.pack(R.tf_point(_tf(tx), R.comps(point, 3))))


def project_point(df: DataFrame, point: str, intrinsics: Sequence[float], out: str) -> DataFrame:
    """Pinhole projection with a row-major 3x3 camera matrix."""
    d = df.withColumn("__h", R.pack(R.mat_vec(R.lits(intrinsics), R.comps(point, 3))))
    h = R.comps("__h", 3)
    return d.withColumn(out, R.pack([h[0] / h[2], h[1] / h[2]])).drop("__h")


def apply_delta_pose(df: DataFrame, pose: str, delta: str, out: str) -> DataFrame:
    """Add positions, left-multiply the delta rotation."""
    d = df.withColumn("__a", R.pack(R.rotvec_to_quat(R.comps(pose, 3, 3)))).withColumn(
        "__b", R.pack(R.rotvec_to_quat(R.comps(delta, 3, 3))))
    d = d.withColumn("__c", R.pack(R.quat_mul(R.comps("__b", 4), R.comps("__a", 4))))
    d = d.withColumn("__c", R.pack(R.canonical(R.comps("__c", 4))))
    pos = R.vadd(R.comps(pose, 3), R.comps(delta, 3))
    return d.withColumn(out, R.pack([*pos, *R.quat_to_rotvec(R.comps("__c", 4))])).drop("__a", "__b", "__c")


# ---------------------------------------------------------- representations
def pose_represent(df: DataFrame, pose: str, base: str, mode: str, out: str, backward: bool = False,
                   keys: Sequence[str] = ("sample_id",), idx: str = "step") -> DataFrame:
    """Express poses relative to a base pose, or undo it.

    ``abs`` as is; ``rel`` subtracts positions and right-divides rotations;
    ``relative`` is inv(base) * pose; ``delta`` is the step from the previous
    row of the chunk (the base precedes row 0).  Chunks have a fixed horizon.
    """
    if mode == "abs":
        return df.withColumn(out, F.col(pose))
    if mode == "delta":
        return _undelta(df, pose, base, out, keys, idx) if backward else _delta(df, pose, base, out, keys, idx)
    if mode not in ("rel", "relative"):
        raise ValueError(f"unknown pose representation {mode}")
    d = to_tf(to_tf(df, pose, "__p"), base, "__b")
    p, b = R.comps("__p", 12), R.comps("__b", 12)
    if mode == "relative":
        res = R.tf_mul(b, p) if backward else R.tf_left_div(b, p)
    elif not backward:
        res = [*R.mat_mul(p[:9], R.mat_t(b[:9])), *R.vsub(p[9:], b[9:])]
    else:
        res = [*R.mat_mul(p[:9], b[:9]), *R.vadd(p[9:], b[9:])]
    d = d.withColumn("__y", R.pack(res)).drop("__p", "__b")
    return from_tf(d, "__y", out).drop("__y")


def _delta(df, pose, base, out, keys, idx):
    d, w, home = halo(df, keys, idx, before=1)
    d = d.withColumn("__prev", F.coalesce(F.lag(pose).over(w), F.col(base))).where(home).drop("__blk")
    d = d.withColumn("__a", R.pack(R.rotvec_to_quat(R.comps(pose, 3, 3)))).withColumn(
        "__b", R.pack(R.rotvec_to_quat(R.comps("__prev", 3, 3))))
    d = d.withColumn("__c", R.pack(R.quat_mul(R.comps("__a", 4), R.quat_conj(R.comps("__b", 4)))))
    d = d.withColumn("__c", R.pack(R.canonical(R.comps("__c", 4))))
    pos = R.vsub(R.comps(pose, 3), R.comps("__prev", 3))
    return d.withColumn(out, R.pack([*pos, *R.quat_to_rotvec(R.comps("__c", 4))])).drop("__a", "__b", "__c", "__prev")


def _undelta(df, delta, base, out, keys, idx):
    """Cumulative form: positions are a running sum, rotations an ordered product over the chunk."""
    keys = list(keys)
    specs = {f"__s{i}": ("sum", F.get(delta, F.lit(i))) for i in range(3)}
    d = prefix(df, keys, idx, specs)
    d = d.withColumn("__rq", R.pack(R.rotvec_to_quat(R.comps(delta, 3, 3))))
    # running products of one chunk, folded once; its horizon bounds the list
    order = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(F.col(idx).alias("i"), F.col("__rq").alias("q")))).alias("__l"))
    step = R.array_sql(R.quat_mul(R.comps("e.q", 4), R.comps("element_at(acc, -1)", 4)))
    run = f"aggregate(slice(__l, 2, size(__l)), array(__l[0].q), (acc, e) -> concat(acc, array({step})))"
    order = order.select(*keys, F.col("__l.i").alias("__i"), F.expr(run).alias("__l"))
    d = join_same(d, order, keys).withColumn("__b", R.pack(R.rotvec_to_quat(R.comps(base, 3, 3))))
    d = d.withColumn("__q", F.element_at("__l", F.array_position("__i", F.col(idx)).cast("int")))
    d = d.withColumn("__c", R.pack(R.quat_mul(R.comps("__q", 4), R.comps("__b", 4))))
    d = d.withColumn("__c", R.pack(R.canonical(R.comps("__c", 4))))
    pos = R.vadd([R.Term(f"__s{i}") for i in range(3)], R.comps(base, 3))
    return d.withColumn(out, R.pack([*pos, *R.quat_to_rotvec(R.comps("__c", 4))])).drop(
        "__rq", "__l", "__i", "__q", "__b", "__c", *specs)


def _finite(c: Column) -> Column:
    return ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def to_camera_frame(frames: DataFrame, poses: Sequence[str], camera: str = "camera_ego_pose") -> DataFrame:
    """Poses in the current camera frame; a missing or non-finite camera counts as the identity."""
    ok = F.coalesce(F.forall(camera, _finite), F.lit(False))
    d = frames.withColumn("__cam", F.when(ok, F.col(camera)).otherwise(R.pack([0.0] * 6)))
    d = to_tf(d, "__cam", "__c").drop("__cam")
    for p in poses:
        d = pose_transform(d, p, "__c", invert=True)
    return d.drop("__c")


# ------------------------------------------------------------------ the rig
# Fixed values of the calibrated rig (transforms are rotation rows, then position).
RIG_AXIS_SWAP = [-1, 0, 0, 0, -1, 0, 0, 0, 1, 0, 0, 0]
RIG_HALF_TURN = [-1, 0, 0, 0, -1, 0, 0, 0, 1, 0, 0, 0]
RIG_REFLECT = [-1, 1, 1, 1, -1, -1]
RIG_BIAS = {"left": [0, -0.08, -0.01, 0, 0, 0], "right": [-0.05, -0.07, -0.04, 0, 0, 0]}
RIG_TRACKER_SHIFT = [0.08, 0.0, 0.0, 0, 0, 0]
RIG_STANDARD = {
    "left": [0, -1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0],
    "right": [0, 1, 0, -1, 0, 0, 0, 0, 1, 0, 0, 0],
}


def rig_calibrate(frames: DataFrame, camera: str, wrists: dict[str, str], fingers: dict[str, str] | None = None) -> DataFrame:
    """Move tracker poses into the standard wrist frames.

    ``wrists`` and ``fingers`` map a column to its side.  The camera axes are
    swapped first; poses go to the camera, are turned, mirrored and shifted per
    side, and return to the world.  Wrists also get the tracker shift and the
    standard frame.
    """
    d = pose_transform(frames, camera, RIG_AXIS_SWAP, "right")
    d = to_tf(d, camera, "__cam")
    for col, side, wrist in [(c, s, True) for c, s in wrists.items()] + [(c, s, False) for c, s in (fingers or {}).items()]:
        d = pose_transform(d, col, "__cam", invert=True)
        d = pose_transform(d, col, RIG_HALF_TURN)
        bias = RIG_BIAS[side]
        shift = RIG_TRACKER_SHIFT if wrist else [0.0] * 6
        d = d.withColumn(col, R.pack([
            x * float(m) + float(b + s) for x, m, b, s in zip(R.comps(col, 6), RIG_REFLECT, bias, shift)]))
        d = pose_transform(d, col, "__cam")
        if wrist:
            d = pose_transform(d, col, RIG_STANDARD[side], "right")
    return d.drop("__cam")


def turn_local_z(df: DataFrame, pose: str) -> DataFrame:
    """Rotate the orientation by +90 degrees about its own z-axis; the position stays."""
    return pose_transform(df, pose, [0, -1, 0, 1, 0, 0, 0, 0, 1, 0, 0, 0], "right")


def decimetres_to_metres(df: DataFrame, col: str) -> DataFrame:
    return df.withColumn(col, F.transform(col, lambda x: x * 0.1))


# ------------------------------------------------------------- hand angles
# Fixed order of the joint angles and the slot of each angle.
HAND_ANGLES = [
    ("palm_adduction", 1), ("thumb_adduction", 26), ("thumb_mcp", 2), ("thumb_ip", 3),
    ("index_adduction", 6), ("index_mcp", 7), ("index_pip", 8), ("index_dip", 9),
    ("middle_adduction", 11), ("middle_mcp", 12), ("middle_pip", 13), ("middle_dip", 14),
    ("ring_adduction", 16), ("ring_mcp", 17), ("ring_pip", 18), ("ring_dip", 19),
    ("pinky_adduction", 21), ("pinky_mcp", 22), ("pinky_pip", 23), ("pinky_dip", 24),
    ("palm", 27),
]
# Bone pairs per angle: (u from, u to), (v from, v to), normal (from, to) or None for u x v.
HAND_BENDS = {
    "thumb_mcp": ((1, 2), (2, 3), (5, 2)), "thumb_ip": ((2, 3), (3, 4), (5, 3)),
    "index_mcp": ((0, 5), (5, 8), (9, 5)), "middle_mcp": ((0, 9), (9, 12), (13, 9)),
    "ring_mcp": ((0, 13), (13, 16), (17, 13)), "pinky_mcp": ((0, 17), (17, 20), (17, 13)),
    "index_pip": ((5, 6), (6, 7), None), "middle_pip": ((9, 10), (10, 11), None),
    "ring_pip": ((13, 14), (14, 15), None), "pinky_pip": ((17, 18), (18, 19), None),
    "index_dip": ((6, 7), (7, 8), None), "middle_dip": ((10, 11), (11, 12), None),
    "ring_dip": ((14, 15), (15, 16), None), "pinky_dip": ((18, 19), (19, 20), None),
    "palm": ((1, 2), (1, 17), None),
}
# Spread angles: the bone, and the two bones that span the reference plane.
HAND_SPREADS = {
    "thumb_adduction": ((2, 4), (2, 5), (2, 13)), "index_adduction": ((5, 8), (0, 5), (0, 9)),
    "middle_adduction": ((9, 12), (0, 9), (0, 13)), "ring_adduction": ((13, 16), (0, 13), (0, 17)),
    "pinky_adduction": ((17, 20), (0, 17), (0, 13)), "palm_adduction": ((1, 4), (1, 9), (1, 13)),
}


def _signed_angle(u, v, n) -> R.Term:
    c = R.dot(u, v) / (R.vnorm(u) * R.vnorm(v) + 1e-8)
    return R.fn("acos", R.fn("greatest", -1.0, R.fn("least", 1.0, c))) * R.fn("signum", R.dot(R.cross(u, v), n))


def hand_joint_angles(df: DataFrame, keypoints: str, wrist: str, side: str, out: str = "hand_joints") -> DataFrame:
    """20 finger keypoints (flat, 60 values) and the wrist pose -> 21 signed angles.

    Adds ``out``, ``out_idx`` (slot ids) and ``out_points`` (21 points in the
    wrist frame, flat).  The left hand mirrors every explicit normal.
    """
    sgn = 1.0 if side == "right" else -1.0
    d = to_tf(df, wrist, "__w")
    w = R.comps("__w", 12)
    pts = [*R.lits([0, 0, 0])]
    for k in range(20):
        pts += R.mat_vec(R.mat_t(w[:9]), R.vsub(R.comps(keypoints, 3, 3 * k), w[9:]))
    d = d.withColumn(f"{out}_points", R.pack(pts)).drop("__w")

    def bone(ab):
        a, b = ab
        return R.vsub(R.comps(f"{out}_points", 3, 3 * b), R.comps(f"{out}_points", 3, 3 * a))

    d = d.withColumn("__n", R.pack(R.vscale(R.cross(bone((0, 5)), bone((0, 13))), sgn)))
    d = d.withColumns({f"__c_{n}": R.pack(R.cross(bone(v), bone(w))) for n, (_, v, w) in HAND_SPREADS.items()})
    unit = {n: R.comps(f"__c_{n}", 3) for n in HAND_SPREADS}
    d = d.withColumns({f"__p_{n}": R.pack([x / (R.vnorm(p) + 1e-8) for x in p]) for n, p in unit.items()})
    flat = {}
    for n, (u, _, _) in HAND_SPREADS.items():
        p = R.comps(f"__p_{n}", 3)
        flat[f"__f_{n}"] = R.pack(R.vsub(bone(u), R.vscale(p, R.dot(bone(u), p))))
    d = d.withColumns(flat)
    angles = []
    for name, _ in HAND_ANGLES:
        if name in HAND_SPREADS:
            flat, ref, n = R.comps(f"__f_{name}", 3), bone(HAND_SPREADS[name][1]), R.comps("__n", 3)
            ang = _signed_angle(ref, flat, n) if side == "right" else _signed_angle(flat, ref, n)
        else:
            u, v, n = HAND_BENDS[name]
            nv = R.vscale(bone(n), sgn) if n else R.cross(bone(u), bone(v))
            ang = _signed_angle(bone(u), bone(v), nv)
            if name == "palm":
                ang = R.fn("pi") / 2 - ang
        angles.append(ang)
    d = d.withColumn(out, R.pack(angles)).withColumn(f"{out}_idx", F.array(*[F.lit(s) for _, s in HAND_ANGLES]))
    return d.drop("__n", *[f"__{p}_{n}" for n in HAND_SPREADS for p in "cpf"])


def lift_landmarks(df: DataFrame, points: str, width: float, height: float, mirror: bool = False) -> DataFrame:
    """21 pixel landmarks (flat x, y, z) -> metric points and the wrist pose.

    Depth follows from the palm length in pixels (0.1 m); the wrist frame has x
    towards the middle knuckle and y in the palm plane.
    """
    wrist, mid = R.comps(points, 2), R.comps(points, 2, 27)
    size = R.vnorm(R.vsub(wrist, mid))
    d = df.withColumn("__d", F.expr(R.when(f"{size} > 0", R.Term(f"{0.1 * width!r}D") / size, 0.5)))
    k = R.Term("__d") * 0.5
    out = []
    for i in range(21):
        x, y, z = R.comps(points, 3, 3 * i)
        nx = (x - width / 2) / (width / 2)
        nx = -nx if mirror else nx
        ny = (y - height / 2) / (height / 2)
        out += [nx * k, -ny * k, R.Term("__d") + z * 0.05]
    d = d.withColumn("landmarks", R.pack(out)).drop("__d")

    def unit(df, col):
        v = R.comps(col, 3)
        return df.withColumn(col, R.pack([c / (R.vnorm(v) + 1e-8) for c in v]))

    base = R.comps("landmarks", 3)
    d = unit(d.withColumn("__x", R.pack(R.vsub(R.comps("landmarks", 3, 27), base))), "__x")
    t, x = R.vsub(R.comps("landmarks", 3, 15), base), R.comps("__x", 3)
    d = unit(d.withColumn("__y", R.pack(R.vsub(t, R.vscale(x, R.dot(t, x))))), "__y")
    y = R.comps("__y", 3)
    d = unit(d.withColumn("__z", R.pack(R.cross(x, y))), "__z")
    z = R.comps("__z", 3)
    # the axes are the matrix columns
    d = d.withColumn("__rm", R.pack([x[0], y[0], z[0], x[1], y[1], z[1], x[2], y[2], z[2]]))
    d = rot_convert(d.withColumnRenamed("__rm", "__axes"), "__axes", "mat", "rotvec", "__rr")
    return d.withColumn("wrist_pose", F.concat(F.slice("landmarks", 1, 3), F.col("__rr"))).drop("__x", "__y", "__z", "__rr", "__axes")


def keypoints_to_world(df: DataFrame, points: str, wrist: str, n_points: int, out: str) -> DataFrame:
    """Local points (flat) -> world, by wrist pose (position, then quaternion w, x, y, z)."""
    q = R.comps(wrist, 4, 3)
    d = df.withColumn("__rq", R.pack(R.quat_unit([q[1], q[2], q[3], q[0]])))
    d = d.withColumn("__t", F.concat(R.pack(R.quat_to_mat(R.comps("__rq", 4))), F.slice(wrist, 1, 3))).drop("__rq")
    pts = []
    for k in range(n_points):
        pts += R.tf_point(R.comps("__t", 12), R.comps(points, 3, 3 * k))
    return d.withColumn(out, R.pack(pts)).drop("__t")


def mean_speed(frames: DataFrame, position: Sequence[str], keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Mean step displacement per episode (NULL for a single frame)."""
    d, w, home = halo(frames, keys, "frame_idx", before=1)
    prev = [F.lag(c).over(w).alias(f"__{c}") for c in position]
    d = d.select(*keys, "frame_idx", "__blk", *position, *prev).where(home)
    step = F.sqrt(sum(((F.col(c) - F.col(f"__{c}")) ** 2 for c in position), F.lit(0.0)))
    return d.groupBy(*keys).agg(F.avg(step).alias("mean_speed"))


def pointcloud_prepare(points: DataFrame, cameras: DataFrame, max_dist: float = 2.0, every: int = 1, voxel: float = 0.01,
                       key: str = "cloud_id", idx: str = "point_idx", block_rows: int = 1_000_000) -> DataFrame:
    """Finite, near points, every k-th survivor, moved to the world and averaged per voxel.

    ``points(cloud_id, point_idx, xyz, ...)``; ``cameras(cloud_id, camera_pose)``.
    """
    ok = F.forall("xyz", _finite)
    d = points.where(ok).where(F.expr(f"{R.vnorm(R.comps('xyz', 3))} < {float(max_dist)!r}D"))
    if every > 1:
        d = number_rows(d, [key], [idx], F.floor(F.col(idx) / block_rows), "__n").where(F.col("__n") % every == 0).drop("__n")
    d = d.join(to_tf(cameras.select(key, "camera_pose"), "camera_pose", "__c").drop("camera_pose"), key)
    d = transform_point(d, "xyz", "__c", "__w").drop("__c")
    w = [F.get("__w", F.lit(i)) for i in range(3)]
    vox = [F.floor(c / voxel).alias(n) for c, n in zip(w, ("vx", "vy", "vz"))]
    return d.select(*vox, *[c.alias(n) for c, n in zip(w, "xyz")]).groupBy("vx", "vy", "vz").agg(
        F.count(F.lit(1)).alias("n"), *[F.avg(c).alias(c) for c in "xyz"])


# --------------------------------------------------------------- resampling
def interp_pose(frames: DataFrame, speed: float, pose: str, keys: Sequence[str] = ("episode_id",)) -> DataFrame:
    """Poses on the new clock: linear positions, shortest-arc slerp of rotations, clamped ends."""
    b = bracket(frames, grid_params(frames, speed, keys), [pose], keys)
    nxt = f"next_{pose}"
    b = b.withColumn(nxt, F.coalesce(nxt, pose))
    b = b.withColumn("__a", R.pack(R.rotvec_to_quat(R.comps(pose, 3, 3)))).withColumn(
        "__b", R.pack(R.rotvec_to_quat(R.comps(nxt, 3, 3))))
    b = b.withColumn("__d", R.pack(R.quat_mul(R.quat_conj(R.comps("__a", 4)), R.comps("__b", 4))))
    b = b.withColumn("__d", R.pack(R.canonical(R.comps("__d", 4))))
    b = b.withColumn("__rr", R.pack(R.vscale(R.quat_to_rotvec(R.comps("__d", 4)), R.Term("w"))))
    b = b.withColumn("__s", R.pack(R.rotvec_to_quat(R.comps("__rr", 3))))
    b = b.withColumn("__s", R.pack(R.quat_mul(R.comps("__a", 4), R.comps("__s", 4))))
    b = b.withColumn("__s", R.pack(R.canonical(R.comps("__s", 4))))
    pos = [x + (y - x) * R.Term("w") for x, y in zip(R.comps(pose, 3), R.comps(nxt, 3))]
    return b.select(*keys, "grid_idx", "t", R.pack([*pos, *R.quat_to_rotvec(R.comps("__s", 4))]).alias(pose))
