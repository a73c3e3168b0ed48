"""SQL text for rotations, by other formulas than the Spark side uses.

Matrices come from Rodrigues' formula and rotation vectors from the matrix
trace; Spark goes through quaternions.
"""

from __future__ import annotations


def rod(r: str, off: int = 0) -> str:
    """Rotation vector at list column ``r`` (1-based offset) -> nine-element list."""
    x, y, z = (f"{r}[{off + i}]" for i in (1, 2, 3))
    th = f"greatest(sqrt({x}*{x}+{y}*{y}+{z}*{z}), 1e-9)"
    s, c = f"(sin({th})/{th})", f"((1-cos({th}))/({th}*{th}))"
    return (
        f"[1-{c}*({y}*{y}+{z}*{z}), {c}*{x}*{y}-{s}*{z}, {c}*{x}*{z}+{s}*{y},"
        f" {c}*{x}*{y}+{s}*{z}, 1-{c}*({x}*{x}+{z}*{z}), {c}*{y}*{z}-{s}*{x},"
        f" {c}*{x}*{z}-{s}*{y}, {c}*{y}*{z}+{s}*{x}, 1-{c}*({x}*{x}+{y}*{y})]"
    )


def rv(m: str) -> str:
    """Nine-element list column -> rotation vector list."""
    th = f"acos(greatest(-1.0, least(1.0, ({m}[1]+{m}[5]+{m}[9]-1)/2)))"
    k = f"(CASE WHEN {th} < 1e-7 THEN 0.5 ELSE {th}/(2*sin({th})) END)"
    return f"[({m}[8]-{m}[6])*{k}, ({m}[3]-{m}[7])*{k}, ({m}[4]-{m}[2])*{k}]"


def mm(a: str, b: str, ta: bool = False, tb: bool = False) -> str:
    """Product of two nine-element list columns, optionally transposed."""

    def el(m, i, j, t):
        return f"{m}[{3 * j + i + 1}]" if t else f"{m}[{3 * i + j + 1}]"

    cells = [
        "+".join(f"{el(a, i, k, ta)}*{el(b, k, j, tb)}" for k in range(3)) for i in range(3) for j in range(3)
    ]
    return "[" + ", ".join(cells) + "]"


def mv(a: str, v: list[str], t: bool = False) -> list[str]:
    return [
        "(" + "+".join(f"{a}[{(3 * k + i if t else 3 * i + k) + 1}]*({v[k]})" for k in range(3)) + ")" for i in range(3)
    ]


def quat_mat(m: str) -> str:
    """Nine-element list, rotation up to rounding -> its proper rotation, by the largest diagonal term."""
    w = f"[{m}[8]-{m}[6], {m}[3]-{m}[7], {m}[4]-{m}[2], 1+{m}[1]+{m}[5]+{m}[9]]"
    x = f"[1+{m}[1]-{m}[5]-{m}[9], {m}[2]+{m}[4], {m}[3]+{m}[7], {m}[8]-{m}[6]]"
    y = f"[{m}[2]+{m}[4], 1-{m}[1]+{m}[5]-{m}[9], {m}[6]+{m}[8], {m}[3]-{m}[7]]"
    z = f"[{m}[3]+{m}[7], {m}[6]+{m}[8], 1-{m}[1]-{m}[5]+{m}[9], {m}[4]-{m}[2]]"
    tr = f"({m}[1]+{m}[5]+{m}[9])"
    top = f"greatest({tr}, {m}[1], {m}[5], {m}[9])"
    return f"CASE {top} WHEN {tr} THEN {w} WHEN {m}[1] THEN {x} WHEN {m}[5] THEN {y} ELSE {z} END"


def quat_rot(q: str) -> str:
    """Four-element list (any length) -> matrix."""
    n = f"({q}[1]**2+{q}[2]**2+{q}[3]**2+{q}[4]**2)"
    x, y, z, w = (f"{q}[{i}]" for i in (1, 2, 3, 4))
    return (f"[1-2*({y}*{y}+{z}*{z})/{n}, 2*({x}*{y}-{z}*{w})/{n}, 2*({x}*{z}+{y}*{w})/{n}, 2*({x}*{y}+{z}*{w})/{n}, 1-2*({x}*{x}+{z}*{z})/{n},"
            f" 2*({y}*{z}-{x}*{w})/{n}, 2*({x}*{z}-{y}*{w})/{n}, 2*({y}*{z}+{x}*{w})/{n}, 1-2*({x}*{x}+{y}*{y})/{n}]")


def const(m: list[float]) -> str:
    return "[" + ", ".join(f"{float(x)}::DOUBLE" for x in m) + "]"


POSES = """poses AS (SELECT vec_id, domain,
  [v[1], v[2], v[3], 4*v[4], 4*v[5], 4*v[6]] AS pose, [v[7], v[8], v[9], 4*v[10], 4*v[11], 4*v[12]] AS base, v FROM vectors)"""
