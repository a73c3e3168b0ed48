"""Queries over rigid-body geometry."""

from pyspark.sql import functions as F

from episodica.operators import geometry as G
from episodica.queries import sqlgeo as Q
from episodica.queries.align_q import GRID
from episodica.queries.common import SAMPLES, VECTORS, bigint, forms, samples, sql_forms, vectors
from episodica.registry import query, rnd, sql_rnd


def poses(spark, sf):
    v = [F.get("v", F.lit(i)) for i in range(12)]
    d = vectors(spark, sf)
    return d.select("vec_id", "domain", F.array(*v[:3], *[x * 4 for x in v[3:6]]).alias("pose"),
                    F.array(*v[6:9], *[x * 4 for x in v[9:12]]).alias("base"), "v")


TH = "sqrt(pose[4]*pose[4]+pose[5]*pose[5]+pose[6]*pose[6])"


@query("e1_pose_convert", f"""WITH {VECTORS}, {Q.POSES},
m AS (SELECT *, {Q.rod('pose', 3)} AS mat FROM poses),
f AS (SELECT vec_id, [pose[4]*sin({TH}/2)/{TH}, pose[5]*sin({TH}/2)/{TH}, pose[6]*sin({TH}/2)/{TH}, cos({TH}/2)] AS quat, mat,
  [atan2(mat[8], mat[9]), -asin(mat[7]), atan2(mat[4], mat[1])] AS euler, mat[1:6] AS rot6d, {Q.rv('mat')} AS back, pose[1:3] || mat[1:6] AS pose9 FROM m)
{sql_forms('f', 'vec_id', ['quat', 'mat', 'euler', 'rot6d', 'back', 'pose9'])}""")
def e1(spark, sf):
    d = poses(spark, sf).withColumn("rv", F.slice("pose", 4, 3))
    for to in ("quat", "mat", "euler", "rot6d"):
        d = G.pose_convert(d, "rv", "rotvec", to, to)
    d = G.pose_convert(d, "rot6d", "rot6d", "rotvec", "back")
    d = G.pose_convert(d, "pose", "pose6", "pose9", "pose9")
    return forms(d, ["vec_id"], ["quat", "mat", "euler", "rot6d", "back", "pose9"])


def lst(xs):
    return "[" + ", ".join(xs) + "]"


K = [500.0, 0.0, 320.0, 0.0, 510.0, 240.0, 0.0, 0.0, 1.0]
T_BASE = ["pose[1]-base[1]", "pose[2]-base[2]", "pose[3]-base[3]"]


@query("e2_pose_transform", f"""WITH {VECTORS}, {Q.POSES},
m AS (SELECT *, {Q.rod('pose', 3)} AS a, {Q.rod('base', 3)} AS b FROM poses),
p AS (SELECT *, {Q.mm('b', 'a')} AS ba, {Q.mm('b', 'a', ta=True)} AS ia, {Q.mm('a', 'b')} AS ab FROM m),
f AS (SELECT vec_id, {lst([f"{x} + base[{i + 1}]" for i, x in enumerate(Q.mv('b', ['pose[1]', 'pose[2]', 'pose[3]']))])} || {Q.rv('ba')} AS "left",
  {lst(Q.mv('b', T_BASE, t=True))} || {Q.rv('ia')} AS inverse,
  {lst([f"{x} + pose[{i + 1}]" for i, x in enumerate(Q.mv('a', ['base[1]', 'base[2]', 'base[3]']))])} || {Q.rv('ab')} AS "right",
  [pose[1]+base[1], pose[2]+base[2], pose[3]+base[3]] || {Q.rv('ba')} AS delta,
  {lst([f"{x} + base[{i + 1}]" for i, x in enumerate(Q.mv('b', ['v[13]', 'v[14]', 'v[15]+1.5']))])} AS point,
  [(500.0::DOUBLE*v[13] + 320.0::DOUBLE*(v[15]+1.5::DOUBLE)) / (v[15]+1.5::DOUBLE), (510.0::DOUBLE*v[14] + 240.0::DOUBLE*(v[15]+1.5::DOUBLE)) / (v[15]+1.5::DOUBLE)] AS pixel FROM p)
{sql_forms('f', 'vec_id', ['"left"', 'inverse', '"right"', 'delta', 'point', 'pixel']).replace("'" + '"left"' + "'", "'left'").replace("'" + '"right"' + "'", "'right'")}""")
def e2(spark, sf):
    d = G.to_tf(poses(spark, sf), "base", "tf")
    d = d.withColumn("pt", F.array(F.get("v", F.lit(12)), F.get("v", F.lit(13)), F.get("v", F.lit(14)) + 1.5))
    d = G.pose_transform(d, "pose", "tf", "left", out="left")
    d = G.pose_transform(d, "pose", "tf", "left", invert=True, out="inverse")
    d = G.pose_transform(d, "pose", "tf", "right", out="right")
    d = G.apply_delta_pose(d, "pose", "base", "delta")
    d = G.transform_point(d, "pt", "tf", "point")
    d = G.project_point(d, "pt", K, "pixel")
    return forms(d, ["vec_id"], ["left", "inverse", "right", "delta", "point", "pixel"])


# a chunk = the vectors of one label in blocks of eight ids
CHUNKS = """steps AS (SELECT *, row_number() OVER (PARTITION BY vec_id // 8 ORDER BY vec_id) - 1 AS step, vec_id // 8 AS sample_id FROM poses),
rep AS (SELECT steps.* EXCLUDE (base), b.base FROM steps JOIN (SELECT sample_id, base FROM steps WHERE step = 0) b USING (sample_id)),
lagged AS (SELECT *, coalesce(lag(pose) OVER (PARTITION BY sample_id ORDER BY step), base) AS prev FROM rep)"""


def chunks(spark, sf):
    d = poses(spark, sf).withColumn("sample_id", F.floor(F.col("vec_id") / 8)).withColumn("step", F.col("vec_id") % 8)
    base = d.where("step = 0").select("sample_id", "base")
    return d.drop("base").join(base, "sample_id")


@query("e3_pose_represent", f"""WITH {VECTORS}, {Q.POSES}, {CHUNKS},
m AS (SELECT *, {Q.rod('pose', 3)} AS a, {Q.rod('base', 3)} AS b, {Q.rod('prev', 3)} AS c FROM lagged),
p AS (SELECT *, {Q.mm('a', 'b', tb=True)} AS r1, {Q.mm('b', 'a', ta=True)} AS r2, {Q.mm('a', 'c', tb=True)} AS r3 FROM m),
f AS (SELECT vec_id, [pose[1]-base[1], pose[2]-base[2], pose[3]-base[3]] || {Q.rv('r1')} AS rel,
  {lst(Q.mv('b', T_BASE, t=True))} || {Q.rv('r2')} AS relative,
  [pose[1]-prev[1], pose[2]-prev[2], pose[3]-prev[3]] || {Q.rv('r3')} AS delta, pose AS abs FROM p)
{sql_forms('f', 'vec_id', ['rel', 'relative', 'delta', 'abs'])}""")
def e3(spark, sf):
    d = chunks(spark, sf)
    for mode in ("rel", "relative", "delta", "abs"):
        d = G.pose_represent(d, "pose", "base", mode, mode)
    return forms(d, ["vec_id"], ["rel", "relative", "delta", "abs"])


RESTORED = f"""WITH {VECTORS}, {Q.POSES}, {CHUNKS}, f AS (SELECT vec_id, pose[1:3] || {Q.rod('pose', 3)} AS restored FROM rep)
{sql_forms('f', 'vec_id', ['restored'])}"""


def _restore(spark, sf, mode):
    """Representation and its inverse, compared as matrices (the half-turn sign is free)."""
    d = G.pose_represent(chunks(spark, sf), "pose", "base", mode, "f")
    d = G.pose_represent(d, "f", "base", mode, "b", backward=True)
    d = G.to_tf(d, "b", "t").withColumn("restored", F.concat(F.slice("t", 10, 3), F.slice("t", 1, 9)))
    return forms(d, ["vec_id"], ["restored"])


@query("e3_restore_rel", RESTORED)
def e3_restore_rel(spark, sf):
    return _restore(spark, sf, "rel")


@query("e3_restore_relative", RESTORED)
def e3_restore_relative(spark, sf):
    return _restore(spark, sf, "relative")


@query("e3_restore_delta", RESTORED)
def e3_restore_delta(spark, sf):
    return _restore(spark, sf, "delta")


@query("e4_to_camera_frame", f"""WITH {VECTORS}, {Q.POSES},
c AS (SELECT vec_id, pose, CASE WHEN vec_id % 7 = 0 THEN [0.0::DOUBLE, 0.0, 0.0, 0.0, 0.0, 0.0] ELSE base END AS cam FROM poses),
m AS (SELECT *, {Q.rod('pose', 3)} AS a, {Q.rod('cam', 3)} AS b FROM c),
p AS (SELECT *, {Q.mm('b', 'a', ta=True)} AS r FROM m),
f AS (SELECT vec_id, {lst(Q.mv('b', ['pose[1]-cam[1]', 'pose[2]-cam[2]', 'pose[3]-cam[3]'], t=True))} || {Q.rv('r')} AS pose FROM p)
{sql_forms('f', 'vec_id', ['pose'])}""")
def e4(spark, sf):
    cam = F.when(F.col("vec_id") % 14 == 0, F.array(*[F.lit(float("nan"))] * 6)).when(F.col("vec_id") % 7 != 0, F.col("base"))
    d = poses(spark, sf).withColumn("camera_ego_pose", cam)
    return forms(G.to_camera_frame(d, ["pose"]), ["vec_id"], ["pose"])


def _rig_sql():
    half, swap = Q.const(G.RIG_HALF_TURN[:9]), Q.const(G.RIG_AXIS_SWAP[:9])
    bias, std = G.RIG_BIAS["left"], Q.const(G.RIG_STANDARD["left"][:9])
    p1 = Q.mv("cam", ["pose[1]-base[1]", "pose[2]-base[2]", "pose[3]-base[3]"], t=True)
    shift = [0.08, 0, 0]
    p2 = [f"(p2[{i + 1}] * ({G.RIG_REFLECT[i]}) + ({bias[i] + shift[i]}))" for i in range(3)]
    r2 = [f"r2[{i + 1}] * ({G.RIG_REFLECT[3 + i]})" for i in range(3)]
    return f"""WITH {VECTORS}, {Q.POSES},
a AS (SELECT vec_id, pose, base, {Q.rod('base', 3)} AS cam0, {Q.rod('pose', 3)} AS m, {half} AS h, {swap} AS sw, {std} AS st FROM poses),
b AS (SELECT *, {Q.mm('cam0', 'sw')} AS cam FROM a),
c AS (SELECT *, {Q.mm('cam', 'm', ta=True)} AS rel, {lst(p1)} AS p1 FROM b),
d AS (SELECT *, {Q.mm('h', 'rel')} AS turned, {lst(Q.mv('h', ['p1[1]', 'p1[2]', 'p1[3]']))} AS p2 FROM c),
e AS (SELECT *, {Q.rv('turned')} AS r2 FROM d),
f AS (SELECT *, {lst(r2)} AS r3, {lst(p2)} AS p3 FROM e),
g AS (SELECT *, {Q.rod('r3')} AS m3 FROM f),
h AS (SELECT *, {Q.mm('cam', 'm3')} AS m4, {lst([f'{x} + base[{i + 1}]' for i, x in enumerate(Q.mv('cam', ['p3[1]', 'p3[2]', 'p3[3]']))])} AS p4 FROM g),
o AS (SELECT vec_id, {Q.mm('m4', 'st')} AS r, p4 FROM h), f2 AS (SELECT vec_id, p4 AS pos, r AS rot FROM o)
{sql_forms('f2', 'vec_id', ['pos', 'rot'])}"""


@query("e5_rig_calibrate", _rig_sql())
def e5(spark, sf):
    d = G.rig_calibrate(poses(spark, sf), "base", {"pose": "left"})
    d = G.to_tf(d, "pose", "t").withColumn("pos", F.slice("t", 10, 3)).withColumn("rot", F.slice("t", 1, 9))
    return forms(d, ["vec_id"], ["pos", "rot"])


def _hand_sql(side):
    # DuckDB fixed arrays give cross and inner products
    def sub(ab):
        a, b = ab[0] + 1, ab[1] + 1
        return f"[k[{b}][1]-k[{a}][1], k[{b}][2]-k[{a}][2], k[{b}][3]-k[{a}][3]]::DOUBLE[3]"

    def ang(u, v, n):
        return (f"acos(greatest(-1.0, least(1.0, array_inner_product({u}, {v}) / (sqrt(array_inner_product({u}, {u})) * sqrt(array_inner_product({v}, {v})) + 1e-8)))) "
                f"* sign(array_inner_product(array_cross_product({u}, {v}), {n}))")

    flip = side == "left"
    cols, bones = [], {}
    for name, (u, v, w) in G.HAND_SPREADS.items():
        bones[name] = (u, v, w)
    pre = ", ".join(f"array_cross_product({sub(v)}, {sub(w)}) AS c_{n}" for n, (u, v, w) in bones.items())
    pre2 = ", ".join(
        "[" + ", ".join(f"c_{n}[{i}] / (sqrt(array_inner_product(c_{n}, c_{n})) + 1e-8)" for i in (1, 2, 3)) + f"]::DOUBLE[3] AS n_{n}"
        for n in bones)
    pre3 = ", ".join(
        "[" + ", ".join(f"({sub(u)})[{i}] - array_inner_product({sub(u)}, n_{n}) * n_{n}[{i}]" for i in (1, 2, 3)) + f"]::DOUBLE[3] AS f_{n}"
        for n, (u, v, w) in bones.items())
    palm = f"array_cross_product({sub((0, 13))}, {sub((0, 5))})" if flip else f"array_cross_product({sub((0, 5))}, {sub((0, 13))})"
    for name, _ in G.HAND_ANGLES:
        if name in bones:
            ref = sub(bones[name][1])
            cols.append(ang(f"f_{name}", ref, "palm") if flip else ang(ref, f"f_{name}", "palm"))
        else:
            u, v, n = G.HAND_BENDS[name]
            nv = sub(n[::-1] if flip else n) if n else f"array_cross_product({sub(u)}, {sub(v)})"
            a = ang(sub(u), sub(v), nv)
            cols.append(f"pi() / 2 - {a}" if name == "palm" else a)
    pts = ["[0.0::DOUBLE, 0.0, 0.0]"] + [
        lst(Q.mv("w", [f"(v[{3 * j + 1}] - base[1])", f"(v[{3 * j + 2}] - base[2])", f"(v[{3 * j + 3}] - base[3])"], t=True)) for j in range(20)]
    return f"""WITH {VECTORS}, {Q.POSES},
a AS (SELECT vec_id, v, base, {Q.rod('base', 3)} AS w FROM poses),
b AS (SELECT vec_id, {lst(pts)} AS k FROM a),
c AS (SELECT *, {palm} AS palm, {pre} FROM b), c2 AS (SELECT *, {pre2} FROM c), c3 AS (SELECT *, {pre3} FROM c2),
f AS (SELECT vec_id, {lst(cols)} AS angles FROM c3)
{sql_forms('f', 'vec_id', ['angles'])}"""


def _hand(spark, sf, side):
    d = poses(spark, sf).withColumn("kp", F.slice("v", 1, 60))
    return forms(G.hand_joint_angles(d, "kp", "base", side, "angles"), ["vec_id"], ["angles"])


@query("e6_hand_joint_angles_right", _hand_sql("right"))
def e6_right(spark, sf):
    return _hand(spark, sf, "right")


@query("e6_hand_joint_angles_left", _hand_sql("left"))
def e6_left(spark, sf):
    return _hand(spark, sf, "left")


_PX = "(v[{0}] * 900.0::DOUBLE + {1}.0::DOUBLE)"


def _lift_sql():
    px = []
    for i in range(21):
        px += [_PX.format(3 * i + 1, 320), _PX.format(3 * i + 2, 240), f"v[{3 * i + 3}]"]
    pts = []
    for i in range(21):
        x, y, z = f"p[{3 * i + 1}]", f"p[{3 * i + 2}]", f"p[{3 * i + 3}]"
        pts += [f"({x} - 320) / 320.0::DOUBLE * dep * 0.5::DOUBLE", f"-(({y} - 240) / 240.0::DOUBLE) * dep * 0.5::DOUBLE", f"dep + {z} * 0.05::DOUBLE"]
    un = lambda c: "[" + ", ".join(f"{c}[{i}] / (sqrt(array_inner_product({c}, {c})) + 1e-8)" for i in (1, 2, 3)) + "]::DOUBLE[3]"
    return f"""WITH {VECTORS},
a AS (SELECT vec_id, {lst(px)} AS p FROM vectors),
b AS (SELECT *, CASE WHEN sqrt((p[1]-p[28])**2 + (p[2]-p[29])**2) > 0 THEN 64.0::DOUBLE / sqrt((p[1]-p[28])**2 + (p[2]-p[29])**2) ELSE 0.5 END AS dep FROM a),
c AS (SELECT vec_id, {lst(pts)} AS l FROM b),
d AS (SELECT *, [l[28]-l[1], l[29]-l[2], l[30]-l[3]]::DOUBLE[3] AS x0, [l[16]-l[1], l[17]-l[2], l[18]-l[3]]::DOUBLE[3] AS t FROM c),
e AS (SELECT *, {un('x0')} AS x FROM d),
g AS (SELECT *, [t[1] - array_inner_product(t, x) * x[1], t[2] - array_inner_product(t, x) * x[2], t[3] - array_inner_product(t, x) * x[3]]::DOUBLE[3] AS y0 FROM e),
h AS (SELECT *, {un('y0')} AS y FROM g), i AS (SELECT *, array_cross_product(x, y) AS z0 FROM h), j AS (SELECT *, {un('z0')} AS z FROM i),
k AS (SELECT *, [x[1], y[1], z[1], x[2], y[2], z[2], x[3], y[3], z[3]] AS m FROM j), q AS (SELECT *, {Q.quat_mat('m')} AS q FROM k),
f AS (SELECT vec_id, l AS landmarks, [l[1], l[2], l[3]] AS wrist_pos, {Q.quat_rot('q')} AS wrist_mat FROM q)
{sql_forms('f', 'vec_id', ['landmarks', 'wrist_pos', 'wrist_mat'], 5)}"""


@query("e7_lift_landmarks", _lift_sql())
def e7(spark, sf):
    px = []
    for i in range(21):
        px += [F.get("v", F.lit(3 * i)) * 900.0 + 320.0, F.get("v", F.lit(3 * i + 1)) * 900.0 + 240.0, F.get("v", F.lit(3 * i + 2))]
    d = G.lift_landmarks(vectors(spark, sf).withColumn("px", F.array(*px)), "px", 640, 480)
    d = G.to_tf(d, "wrist_pose", "t").withColumn("wrist_pos", F.slice("t", 10, 3)).withColumn("wrist_mat", F.slice("t", 1, 9))
    return forms(d, ["vec_id"], ["landmarks", "wrist_pos", "wrist_mat"], 5)


def _world_sql():
    q = {"w": "q[1]", "x": "q[2]", "y": "q[3]", "z": "q[4]"}
    w, x, y, z = q["w"], q["x"], q["y"], q["z"]
    m = (f"[{w}*{w}+{x}*{x}-{y}*{y}-{z}*{z}, 2*({x}*{y}-{w}*{z}), 2*({x}*{z}+{w}*{y}), 2*({x}*{y}+{w}*{z}), {w}*{w}-{x}*{x}+{y}*{y}-{z}*{z}, 2*({y}*{z}-{w}*{x}),"
         f" 2*({x}*{z}-{w}*{y}), 2*({y}*{z}+{w}*{x}), {w}*{w}-{x}*{x}-{y}*{y}+{z}*{z}]")
    pts = []
    for j in range(19):
        r = Q.mv("m", [f"v[{7 + 3 * j + 1}]", f"v[{7 + 3 * j + 2}]", f"v[{7 + 3 * j + 3}]"])
        pts += [f"{c} + v[{i + 1}]" for i, c in enumerate(r)]
    return f"""WITH {VECTORS},
a AS (SELECT vec_id, v, sqrt(v[4]**2 + v[5]**2 + v[6]**2 + v[7]**2) AS n FROM vectors),
b AS (SELECT vec_id, v, [v[4]/n, v[5]/n, v[6]/n, v[7]/n] AS q FROM a), c AS (SELECT vec_id, v, {m} AS m FROM b),
f AS (SELECT vec_id, {lst(pts)} AS world FROM c)
{sql_forms('f', 'vec_id', ['world'])}"""


@query("e8_keypoints_to_world", _world_sql())
def e8(spark, sf):
    d = vectors(spark, sf).withColumn("wrist", F.slice("v", 1, 7)).withColumn("pts", F.slice("v", 8, 57))
    return forms(G.keypoints_to_world(d, "pts", "wrist", 19, "world"), ["vec_id"], ["world"])


@query("e9_mean_speed", f"""WITH {SAMPLES},
d AS (SELECT episode_id, sqrt((value - lag(value) OVER w) ** 2 + (k - lag(k) OVER w) ** 2) AS s FROM samples WINDOW w AS (PARTITION BY episode_id ORDER BY frame_idx))
SELECT episode_id, {sql_rnd('avg(s)')} AS mean_speed FROM d GROUP BY 1""")
def e9(spark, sf):
    d = G.mean_speed(samples(spark, sf), ["value", "k"])
    return d.select("episode_id", rnd(F.col("mean_speed")).alias("mean_speed"))


@query("e10_pointcloud_prepare", f"""WITH {VECTORS}, {Q.POSES},
pts AS (SELECT vec_id AS cloud_id, j AS point_idx, [v[3*j+1]*9, v[3*j+2]*9, v[3*j+3]*9] AS xyz, base FROM poses, (SELECT unnest(range(0, 21)) AS j)),
ok AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY point_idx) - 1 AS n FROM pts WHERE (cloud_id + point_idx) % 17 <> 0 AND sqrt(xyz[1]**2 + xyz[2]**2 + xyz[3]**2) < 2.0),
m AS (SELECT *, {Q.rod('base', 3)} AS b FROM ok WHERE n % 3 = 0),
w AS (SELECT {lst([f'{x} + base[{i + 1}]' for i, x in enumerate(Q.mv('b', ['xyz[1]', 'xyz[2]', 'xyz[3]']))])} AS p FROM m)
SELECT CAST(floor(p[1] / 0.1::DOUBLE) AS BIGINT) AS vx, CAST(floor(p[2] / 0.1::DOUBLE) AS BIGINT) AS vy, CAST(floor(p[3] / 0.1::DOUBLE) AS BIGINT) AS vz, count(*) AS n,
 {sql_rnd('avg(p[1])')} AS x, {sql_rnd('avg(p[2])')} AS y, {sql_rnd('avg(p[3])')} AS z FROM w GROUP BY 1, 2, 3""")
def e10(spark, sf):
    p = poses(spark, sf)
    d = p.select(F.col("vec_id").alias("cloud_id"), F.explode(F.sequence(F.lit(0), F.lit(20))).alias("point_idx"), "v")
    at = [F.get("v", F.col("point_idx") * 3 + i) * 9 for i in range(3)]
    bad = (F.col("cloud_id") + F.col("point_idx")) % 17 == 0
    d = d.select("cloud_id", "point_idx", F.array(F.when(bad, F.lit(float("nan"))).otherwise(at[0]), *at[1:]).alias("xyz"))
    cam = p.select(F.col("vec_id").alias("cloud_id"), F.col("base").alias("camera_pose"))
    o = G.pointcloud_prepare(d, cam, 2.0, 3, 0.1)
    return o.select(*bigint("vx", "vy", "vz", "n"), *[rnd(F.col(c)).alias(c) for c in "xyz"])


def _slerp_sql():
    th = "sqrt({0}[4]*{0}[4]+{0}[5]*{0}[5]+{0}[6]*{0}[6])"

    def quat(p):
        t = th.format(p)
        return f"[{p}[4]*sin({t}/2)/{t}, {p}[5]*sin({t}/2)/{t}, {p}[6]*sin({t}/2)/{t}, cos({t}/2)]"

    return f"""WITH {SAMPLES}, {GRID},
w AS (SELECT episode_id, grid_idx, CASE WHEN ts2 IS NULL THEN 0.0::DOUBLE ELSE (t - ts) / (ts2 - ts) END AS w,
  [value, k, 1.0::DOUBLE, value / 100 + 0.1::DOUBLE, k / 80.0::DOUBLE, 0.3::DOUBLE] AS a,
  [coalesce(v2, value), coalesce(k2, k), 1.0::DOUBLE, coalesce(v2, value) / 100 + 0.1::DOUBLE, coalesce(k2, k) / 80.0::DOUBLE, 0.3::DOUBLE] AS b FROM brk),
q AS (SELECT *, {quat('a')} AS qa, {quat('b')} AS qb0 FROM w),
s AS (SELECT *, qa[1]*qb0[1]+qa[2]*qb0[2]+qa[3]*qb0[3]+qa[4]*qb0[4] AS d0 FROM q),
o AS (SELECT *, CASE WHEN d0 < 0 THEN [-qb0[1], -qb0[2], -qb0[3], -qb0[4]] ELSE qb0 END AS qb, acos(least(1.0, abs(d0))) AS om FROM s),
r AS (SELECT *, CASE WHEN om < 1e-7 THEN 1 - w ELSE sin((1 - w) * om) / sin(om) END AS f1, CASE WHEN om < 1e-7 THEN w ELSE sin(w * om) / sin(om) END AS f2 FROM o),
z AS (SELECT *, [qa[1]*f1+qb[1]*f2, qa[2]*f1+qb[2]*f2, qa[3]*f1+qb[3]*f2, qa[4]*f1+qb[4]*f2] AS qi FROM r),
f AS (SELECT episode_id, grid_idx, [a[1] + (b[1]-a[1])*w, a[2] + (b[2]-a[2])*w, a[3]] AS pos,
  [1-2*(qi[2]**2+qi[3]**2), 2*(qi[1]*qi[2]-qi[3]*qi[4]), 2*(qi[1]*qi[3]+qi[2]*qi[4]), 2*(qi[1]*qi[2]+qi[3]*qi[4]), 1-2*(qi[1]**2+qi[3]**2), 2*(qi[2]*qi[3]-qi[1]*qi[4]),
   2*(qi[1]*qi[3]-qi[2]*qi[4]), 2*(qi[2]*qi[3]+qi[1]*qi[4]), 1-2*(qi[1]**2+qi[2]**2)] AS rot FROM z)
{sql_forms('f', 'episode_id, grid_idx', ['pos', 'rot'], 4)}""".replace(
        "WITH " + SAMPLES + ", " + GRID,
        "WITH " + SAMPLES + ", " + GRID + ",\nkx AS (SELECT episode_id, frame_idx, ts, lead(k) OVER (PARTITION BY episode_id ORDER BY frame_idx) AS k2 FROM samples),\n"
        "brk AS (SELECT br.*, kx.k2 FROM br JOIN kx ON kx.episode_id = br.episode_id AND kx.ts = br.ts)")


@query("d9_interp_pose", _slerp_sql())
def d9(spark, sf):
    v, k = F.col("value"), F.col("k").cast("double")
    d = samples(spark, sf).withColumn("pose", F.array(v, k, F.lit(1.0), v / 100 + 0.1, k / 80.0, F.lit(0.3)))
    d = G.interp_pose(d, 1.7, "pose")
    d = G.to_tf(d, "pose", "t2").withColumn("pos", F.slice("t2", 10, 3)).withColumn("rot", F.slice("t2", 1, 9))
    return forms(d, ["episode_id", "grid_idx"], ["pos", "rot"], 4)
