"""Rotation expressions against numpy, including half turns."""

import numpy as np
import pytest

from episodica.operators import geometry as G


def rod(r):
    r = np.asarray(r, float)
    t = np.linalg.norm(r)
    k = np.array([[0, -r[2], r[1]], [r[2], 0, -r[0]], [-r[1], r[0], 0]])
    if t < 1e-12:
        return np.eye(3) + k
    k = k / t
    return np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k


ANGLES = [0.0, 1e-9, 1e-4, np.pi / 2, np.pi - 1e-6, np.pi]
AXES = [[1, 0, 0], [0, 1, 0], [0, 0, 1], [1, 2, -3], [-1, 0.1, 0.2]]


@pytest.fixture(scope="module")
def rots(spark):
    rows = [(i, [float(x) for x in np.array(a) / np.linalg.norm(a) * t]) for i, (a, t) in enumerate((a, t) for a in AXES for t in ANGLES)]
    return spark.createDataFrame(rows, "id long, r array<double>"), dict(rows)


def test_matrix_and_back(rots):
    df, src = rots
    d = G.rot_convert(G.rot_convert(df, "r", "rotvec", "mat", "m"), "m", "mat", "rotvec", "b")
    for r in d.collect():
        m = np.array(r.m).reshape(3, 3)
        assert np.allclose(m, rod(src[r.id]), atol=1e-12)
        assert np.allclose(rod(r.b), m, atol=1e-9) and np.linalg.norm(r.b) <= np.pi + 1e-9


@pytest.mark.parametrize("to", ["quat", "rot6d", "euler"])
def test_other_forms_round_trip(rots, to):
    df, src = rots
    d = G.rot_convert(G.rot_convert(df, "r", "rotvec", to, "x"), "x", to, "mat", "m")
    for r in d.collect():
        assert np.allclose(np.array(r.m).reshape(3, 3), rod(src[r.id]), atol=1e-7)
        if to == "quat":
            assert r.x[3] >= 0
        if to == "rot6d":
            assert np.allclose(r.x, rod(src[r.id])[:2].ravel(), atol=1e-9)


@pytest.mark.parametrize("mode", ["rel", "relative", "delta"])
def test_representation_inverts(spark, mode):
    rng = np.random.default_rng(2)
    base = [float(x) for x in rng.normal(size=6)]
    rows = [(1, k, [float(x) for x in rng.normal(size=6)], base) for k in range(5)]
    d = spark.createDataFrame(rows, "sample_id long, step long, pose array<double>, base array<double>")
    d = G.pose_represent(d, "pose", "base", mode, "f")
    d = G.pose_represent(d, "f", "base", mode, "b", backward=True)
    for r in d.collect():
        assert np.allclose(r.b[:3], r.pose[:3], atol=1e-9) and np.allclose(rod(r.b[3:]), rod(r.pose[3:]), atol=1e-9)


def test_camera_frame_identity_when_not_finite(spark):
    p = [1.0, 2.0, 3.0, 0.1, 0.2, 0.3]
    d = spark.createDataFrame([(1, p, [float("nan")] * 6), (2, p, None), (3, p, p)], "id long, w array<double>, camera_ego_pose array<double>")
    r = {x.id: x.w for x in G.to_camera_frame(d, ["w"]).collect()}
    assert np.allclose(r[1], p) and np.allclose(r[2], p) and np.allclose(r[3], 0, atol=1e-12)


def test_slerp_midpoint_takes_the_short_way(spark):
    rows = [(1, 0, 0.0, [0.0, 0.0, 0.0, 0.0, 0.0, 3.0]), (1, 1, 1.0, [2.0, 0.0, 0.0, 0.0, 0.0, -3.0])]
    d = spark.createDataFrame(rows, "episode_id long, frame_idx long, ts double, pose array<double>")
    r = {x.grid_idx: x.pose for x in G.interp_pose(d, 2.0, "pose").collect()}
    assert np.allclose(rod(r[1][3:]), rod([0, 0, np.pi]), atol=1e-9) and r[1][0] == pytest.approx(1.0)


def test_hand_angles_of_a_straight_finger(spark):
    pts = np.zeros((21, 3))
    for f in range(5):
        for j in range(4):
            pts[1 + 4 * f + j] = [f * 0.1 - 0.2, 1 + j * 0.2, 0.0]
    d = spark.createDataFrame([([float(x) for x in pts[1:].ravel()], [0.0] * 6)], "k array<double>, w array<double>")
    r = G.hand_joint_angles(d, "k", "w", "right", "j").first()
    names = [n for n, _ in G.HAND_ANGLES]
    assert len(r.j) == 21 and r.j_idx[0] == 1 and abs(r.j[names.index("index_pip")]) < 1e-3


def test_turn_local_z(spark):
    d = spark.createDataFrame([([1.0, 2.0, 3.0, 0.3, -0.2, 0.1],)], "p array<double>")
    r = G.turn_local_z(d, "p").first().p
    assert np.allclose(rod(r[3:]), rod([0.3, -0.2, 0.1]) @ rod([0, 0, np.pi / 2]), atol=1e-12) and r[:3] == [1.0, 2.0, 3.0]
    assert G.decimetres_to_metres(d, "p").first().p[0] == pytest.approx(0.1)
