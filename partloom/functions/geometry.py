"""Column functions for 3-D geometry. Points and directions are triples of columns, so scans can prune them."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

Triple = tuple[Column, Column, Column]


def triple(prefix: str, suffixes: str = "xyz") -> Triple:
    return tuple(F.col(prefix + s) for s in suffixes)


def minus(a: Triple, b: Triple) -> Triple:
    return tuple(x - y for x, y in zip(a, b, strict=True))


def plus(a: Triple, b: Triple) -> Triple:
    return tuple(x + y for x, y in zip(a, b, strict=True))


def times(a: Triple, k) -> Triple:
    return tuple(x * k for x in a)


def dot(a: Triple, b: Triple) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Triple, b: Triple) -> Triple:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a: Triple) -> Column:
    return F.sqrt(dot(a, a))


def distance(a: Triple, b: Triple) -> Column:
    return norm(minus(a, b))


def off_axis(point: Triple, origin: Triple, direction: Triple) -> Column:
    """Distance of a point from the line through origin along a unit direction."""
    d = minus(point, origin)
    t = dot(d, direction)
    return norm(minus(d, times(direction, t)))


def angle_between(a: Triple, b: Triple) -> Column:
    """Angle of two unit vectors in radians, with the cosine clipped to [-1, 1]."""
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot(a, b))))


# Coordinate systems: right-handed Z-up mm is canonical.


def canonical_to_engine(p: Triple) -> Triple:
    """Right-handed Z-up mm -> left-handed Z-up cm: Y is mirrored."""
    return (p[0] * 0.1, -p[1] * 0.1, p[2] * 0.1)


def engine_to_canonical(p: Triple) -> Triple:
    return (p[0] * 10.0, -p[1] * 10.0, p[2] * 10.0)


def canonical_to_gltf(p: Triple) -> Triple:
    """Right-handed Z-up mm -> right-handed Y-up m."""
    return (p[0] * 0.001, p[2] * 0.001, -p[1] * 0.001)


def gltf_to_canonical(p: Triple) -> Triple:
    return (p[0] * 1000.0, -p[2] * 1000.0, p[1] * 1000.0)


def apply_matrix(m: list[Column], p: Triple) -> Triple:
    """A row-major 4x4 matrix, as 16 columns, applied to a point."""
    return tuple(m[4 * i] * p[0] + m[4 * i + 1] * p[1] + m[4 * i + 2] * p[2] + m[4 * i + 3] for i in range(3))


def decompose(m: list[Column]) -> dict[str, Column]:
    """A row-major 4x4 matrix -> translation t*, quaternion q* (xyzw) and scale s*.

    The scale is the length of each column; the rotation is what remains. A
    column without length keeps scale 1 there.
    """
    lengths = [F.sqrt(m[j] * m[j] + m[4 + j] * m[4 + j] + m[8 + j] * m[8 + j]) for j in range(3)]
    safe = [F.when(x > 1e-12, x).otherwise(1.0) for x in lengths]
    r = [[m[4 * i + j] / safe[j] for j in range(3)] for i in range(3)]
    trace = r[0][0] + r[1][1] + r[2][2]
    root = lambda x: F.sqrt(F.greatest(x, F.lit(0.0))) * 2.0
    s0 = root(trace + 1.0)
    s1, s2, s3 = root(1.0 + r[0][0] - r[1][1] - r[2][2]), root(1.0 + r[1][1] - r[0][0] - r[2][2]), root(1.0 + r[2][2] - r[0][0] - r[1][1])
    arms = {
        "qx": ((r[2][1] - r[1][2]) / s0, 0.25 * s1, (r[0][1] + r[1][0]) / s2, (r[0][2] + r[2][0]) / s3),
        "qy": ((r[0][2] - r[2][0]) / s0, (r[0][1] + r[1][0]) / s1, 0.25 * s2, (r[1][2] + r[2][1]) / s3),
        "qz": ((r[1][0] - r[0][1]) / s0, (r[0][2] + r[2][0]) / s1, (r[1][2] + r[2][1]) / s2, 0.25 * s3),
        "qw": (0.25 * s0, (r[2][1] - r[1][2]) / s1, (r[0][2] - r[2][0]) / s2, (r[1][0] - r[0][1]) / s3),
    }
    first = (r[0][0] > r[1][1]) & (r[0][0] > r[2][2])
    pick = lambda a: F.when(trace > 0, a[0]).when(first, a[1]).when(r[1][1] > r[2][2], a[2]).otherwise(a[3])
    return {"tx": m[3], "ty": m[7], "tz": m[11], **{k: pick(a) for k, a in arms.items()}, "sx": safe[0], "sy": safe[1], "sz": safe[2]}


FULL_TURN = 2.0 * math.pi
