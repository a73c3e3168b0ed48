"""Rotation and rigid-transform expressions.

Small vectors are lists of SQL terms.  A whole formula reaches Spark as one
``F.expr`` text, which is far cheaper to build than a tree of column calls.
Quaternions are (x, y, z, w) with w >= 0; matrices are row-major lists of nine;
a rigid transform is twelve values, rotation first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, functions as F

Vec = list


def _txt(x) -> str:
    return str(x) if isinstance(x, str) else f"{float(x)!r}D"


class Term(str):
    """SQL text of a double expression with arithmetic operators."""

    def __add__(self, o):
        return Term(f"({str(self)} + {_txt(o)})")

    def __radd__(self, o):
        return Term(f"({_txt(o)} + {str(self)})")

    def __sub__(self, o):
        return Term(f"({str(self)} - {_txt(o)})")

    def __rsub__(self, o):
        return Term(f"({_txt(o)} - {str(self)})")

    def __mul__(self, o):
        return Term(f"({str(self)} * {_txt(o)})")

    def __rmul__(self, o):
        return Term(f"({_txt(o)} * {str(self)})")

    def __truediv__(self, o):
        return Term(f"({str(self)} / {_txt(o)})")

    def __neg__(self):
        return Term(f"(-{str(self)})")


def fn(name: str, *args) -> Term:
    return Term(f"{name}({', '.join(_txt(a) for a in args)})")


def when(cond: str, a, b) -> Term:
    return Term(f"(CASE WHEN {cond} THEN {_txt(a)} ELSE {_txt(b)} END)")


def comps(arr: str, n: int, start: int = 0) -> Vec:
    return [Term(f"get({arr}, {start + i})") for i in range(n)]


def array_sql(v: Sequence) -> str:
    return f"array({', '.join(_txt(x) for x in v)})"


def pack(v: Sequence) -> Column:
    return F.expr(array_sql(v))


def lits(v: Sequence[float]) -> Vec:
    return [Term(_txt(float(x))) for x in v]


def dot(a: Vec, b: Vec) -> Term:
    s = a[0] * b[0]
    for x, y in zip(a[1:], b[1:]):
        s = s + x * y
    return s


def cross(a: Vec, b: Vec) -> Vec:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def vadd(a: Vec, b: Vec) -> Vec:
    return [x + y for x, y in zip(a, b)]


def vsub(a: Vec, b: Vec) -> Vec:
    return [x - y for x, y in zip(a, b)]


def vscale(a: Vec, k) -> Vec:
    return [x * k for x in a]


def vnorm(a: Vec) -> Term:
    return fn("sqrt", dot(a, a))


# ------------------------------------------------------------- quaternions
def rotvec_to_quat(r: Vec) -> Vec:
    n = vnorm(r)
    s = when(f"{n} < 1e-8D", 0.5 - n * n / 48.0, fn("sin", n / 2) / n)
    return [*vscale(r, s), fn("cos", n / 2)]


def canonical(q: Vec) -> Vec:
    s = when(f"{q[3]} < 0", -1.0, 1.0)
    return [x * s for x in q]


def quat_unit(q: Vec) -> Vec:
    n = vnorm(q)
    return [x / n for x in q]


def quat_normal(q: Vec) -> Vec:
    """Unit length and canonical sign in one step."""
    k = when(f"{q[3]} < 0", -1.0, 1.0) / vnorm(q)
    return vscale(q, k)


def quat_to_rotvec(q: Vec) -> Vec:
    """Rotation vector of at most pi; ``q`` must be canonical."""
    n = vnorm(q[:3])
    k = when(f"{n} < 1e-14D", 2.0, 2.0 * fn("atan2", n, q[3]) / n)
    return vscale(q[:3], k)


def quat_mul(a: Vec, b: Vec) -> Vec:
    ax, ay, az, aw = a
    bx, by, bz, bw = b
    return [
        aw * bx + ax * bw + ay * bz - az * by,
        aw * by - ax * bz + ay * bw + az * bx,
        aw * bz + ax * by - ay * bx + az * bw,
        aw * bw - ax * bx - ay * by - az * bz,
    ]


def quat_conj(q: Vec) -> Vec:
    return [-q[0], -q[1], -q[2], q[3]]


def quat_to_mat(q: Vec) -> Vec:
    x, y, z, w = q
    return [
        1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w),
        2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w),
        2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y),
    ]


def mat_to_quat(m: Vec) -> Vec:
    """Quaternion by the largest-component branch (stable up to a half turn)."""
    m00, m01, m02, m10, m11, m12, m20, m21, m22 = m
    tr = m00 + m11 + m22
    cand = {
        "w": [m21 - m12, m02 - m20, m10 - m01, 1 + tr],
        "x": [1 + m00 - m11 - m22, m01 + m10, m02 + m20, m21 - m12],
        "y": [m01 + m10, 1 - m00 + m11 - m22, m12 + m21, m02 - m20],
        "z": [m02 + m20, m12 + m21, 1 - m00 - m11 + m22, m10 - m01],
    }
    top = fn("greatest", tr, m00, m11, m22)
    return [
        when(f"{tr} = {top}", w, when(f"{m00} = {top}", x, when(f"{m11} = {top}", y, z)))
        for w, x, y, z in zip(cand["w"], cand["x"], cand["y"], cand["z"])
    ]


# ---------------------------------------------------------------- matrices
def mat_mul(a: Vec, b: Vec) -> Vec:
    return [dot(a[3 * i : 3 * i + 3], [b[j], b[3 + j], b[6 + j]]) for i in range(3) for j in range(3)]


def mat_t(a: Vec) -> Vec:
    return [a[3 * j + i] for i in range(3) for j in range(3)]


def mat_vec(a: Vec, v: Vec) -> Vec:
    return [dot(a[3 * i : 3 * i + 3], v) for i in range(3)]


def euler_to_mat(e: Vec) -> Vec:
    """Fixed-axis x, then y, then z."""
    cx, cy, cz = [fn("cos", x) for x in e]
    sx, sy, sz = [fn("sin", x) for x in e]
    return [
        cz * cy, cz * sy * sx - sz * cx, cz * sy * cx + sz * sx,
        sz * cy, sz * sy * sx + cz * cx, sz * sy * cx - cz * sx,
        -sy, cy * sx, cy * cx,
    ]


def mat_to_euler(m: Vec) -> Vec:
    return [
        fn("atan2", m[7], m[8]),
        fn("asin", fn("greatest", -1.0, fn("least", 1.0, -m[6]))),
        fn("atan2", m[3], m[0]),
    ]


def mat_to_rot6d(m: Vec) -> Vec:
    """First two rows."""
    return list(m[:6])


# -------------------------------------------------------- rigid transforms
def tf_mul(a: Vec, b: Vec) -> Vec:
    return [*mat_mul(a[:9], b[:9]), *vadd(mat_vec(a[:9], b[9:]), a[9:])]


def tf_left_div(a: Vec, b: Vec) -> Vec:
    """inv(a) * b."""
    rt = mat_t(a[:9])
    return [*mat_mul(rt, b[:9]), *mat_vec(rt, vsub(b[9:], a[9:]))]


def tf_inv(a: Vec) -> Vec:
    rt = mat_t(a[:9])
    return [*rt, *[-x for x in mat_vec(rt, a[9:])]]


def tf_point(a: Vec, p: Vec) -> Vec:
    return vadd(mat_vec(a[:9], p), a[9:])


IDENTITY = [1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0]
