"""Geometry of tube segments as column expressions.

A segment is an elliptic cylinder: radius (along y), scale (x radius = radius * scale), length, theta
about x and psi about z, and a start point; its axis spans length - 1. Angles are radians. Vectors are
triples of columns, so that all of it stays inside generated code.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

Vector = tuple[Column, Column, Column]


def vector(prefix: str) -> Vector:
    """The columns <prefix>x, <prefix>y and <prefix>z."""
    return tuple(F.col(f"{prefix}{a}").cast("double") for a in "xyz")


def dot(a: Vector, b: Vector) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def minus(a: Vector, b: Vector) -> Vector:
    return tuple(p - q for p, q in zip(a, b, strict=True))


def plus(a: Vector, b: Vector, k: Column | float = 1.0) -> Vector:
    return tuple(p + q * k for p, q in zip(a, b, strict=True))


def squared_distance(a: Vector, b: Vector) -> Column:
    d = minus(a, b)
    return dot(d, d)


def distance(a: Vector, b: Vector) -> Column:
    return F.sqrt(squared_distance(a, b))


def cross(a: Vector, b: Vector) -> Vector:
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def direction(theta: Column, psi: Column) -> Vector:
    """The unit vector of an axis."""
    return (F.sin(psi) * F.sin(theta), -F.cos(psi) * F.sin(theta), F.cos(theta))


def angles(v: Vector) -> tuple[Column, Column]:
    """theta and psi of a direction, turned to z >= 0."""
    sign = F.when(v[2] < 0, -1.0).otherwise(1.0)
    length = F.sqrt(dot(v, v))
    x, y, z = (c * sign / length for c in v)
    full = F.lit(2 * math.pi)
    return F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), z))), F.pmod(F.atan2(x, -y), full)


def rotate(v: Vector, theta: Column, psi: Column) -> Vector:
    """About x by theta, then about z by psi."""
    x, y, z = v
    y1, z1 = y * F.cos(theta) - z * F.sin(theta), y * F.sin(theta) + z * F.cos(theta)
    return (x * F.cos(psi) - y1 * F.sin(psi), x * F.sin(psi) + y1 * F.cos(psi), z1)


def rotate_back(v: Vector, theta: Column, psi: Column) -> Vector:
    """The inverse of ``rotate``."""
    x, y, z = v
    x1, y1 = x * F.cos(psi) + y * F.sin(psi), -x * F.sin(psi) + y * F.cos(psi)
    return (x1, y1 * F.cos(theta) + z * F.sin(theta), -y1 * F.sin(theta) + z * F.cos(theta))


def normal_angles(theta: Column, psi: Column) -> tuple[Column, Column]:
    """The same orientation with theta in [0, pi] and psi in [0, 2 pi)."""
    full = F.lit(2 * math.pi)
    t = F.pmod(theta, full)
    over = t > math.pi
    return F.when(over, full - t).otherwise(t), F.pmod(psi + F.when(over, math.pi).otherwise(0.0), full)


def ends(at: Vector, axis: Vector, length: Column, alignment: str = "start") -> tuple[Vector, Vector, Vector]:
    """Start, centre and end of a segment whose start, centre or end is given."""
    back = {"start": 0.0, "center": 0.5, "end": 1.0}[alignment]
    start = plus(at, axis, -(length - 1) * back)
    return start, plus(start, axis, (length - 1) * 0.5), plus(start, axis, length - 1)


def inside_segment(p: Vector, start: Vector, theta: Column, psi: Column, radius: Column, scale: Column, length: Column) -> Column:
    """Within the ellipse and from half a voxel before the start to length - 0.5 along the axis."""
    x, y, z = rotate_back(minus(p, start), theta, psi)
    return (F.pow(x / (radius * scale), 2) + F.pow(y / radius, 2) <= 1) & (z >= -0.5) & (z <= length - 0.5)


def surface_distance(p: Vector, start: Vector, theta: Column, psi: Column, radius: Column, scale: Column, length: Column) -> Column:
    """0 within the ellipse from half a voxel before the start to ``length``; else the distance to the point on
    the ray from the axis that lies on the surface, between start and end."""
    x, y, z = rotate_back(minus(p, start), theta, psi)
    norm = F.sqrt(F.pow(x / (radius * scale), 2) + F.pow(y / radius, 2))
    beyond = z - F.greatest(F.lit(0.0), F.least(z, length - 1))
    radial = F.when(norm > 1, F.sqrt(x * x + y * y) * (1 - 1 / norm)).otherwise(0.0)
    inside = (norm <= 1) & (z >= -0.5) & (z <= length)
    return F.when(inside, 0.0).otherwise(F.sqrt(radial * radial + beyond * beyond))


def point_segment_distance(p: Vector, a: Vector, b: Vector) -> Column:
    """Distance to the line segment from a to b."""
    ab = minus(b, a)
    length = dot(ab, ab)
    t = F.when(length > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(minus(p, a), ab) / length))).otherwise(0.0)
    return distance(p, plus(a, ab, t))


def segment_distance(p0: Vector, p1: Vector, q0: Vector, q1: Vector, eps: float = 1e-9) -> Column:
    """Distance of two line segments: between inner points of both where there are such, else the best of
    the four ends."""
    u, v, w = minus(p1, p0), minus(q1, q0), minus(p0, q0)
    a, b, c, d, e = dot(u, u), dot(u, v), dot(v, v), dot(u, w), dot(v, w)
    den = a * c - b * b
    s, t = (b * e - c * d) / den, (a * e - b * d) / den
    inner = (den > eps) & s.between(0, 1) & t.between(0, 1)
    best = F.least(point_segment_distance(p0, q0, q1), point_segment_distance(p1, q0, q1), point_segment_distance(q0, p0, p1), point_segment_distance(q1, p0, p1))
    return F.when(inner, distance(plus(p0, u, s), plus(q0, v, t))).otherwise(best)


def dilated(radius: Column, scale: Column, ratio: float = 1.5, diff: float = 0.0, most: float = 3.0) -> tuple[Column, Column]:
    """Radius and scale of a segment grown in both directions, by ``most`` at the most."""
    x, y = radius * scale, radius
    if most > 0:
        nx, ny = F.least(x * ratio + diff, x + most), F.least(y * ratio + diff, y + most)
    else:
        nx, ny = x * ratio + diff, y * ratio + diff
    return ny, nx / ny


def flipped(theta: Column, psi: Column) -> tuple[Column, Column]:
    """The angles of the opposite direction."""
    full = F.lit(2 * math.pi)
    return F.pmod(math.pi - theta, full), F.pmod(psi + math.pi, full)


def ball_radius(radius: Column, scale: Column, length: Column) -> Column:
    """Half the diagonal of a segment's box."""
    return F.sqrt(F.pow(radius * F.greatest(scale, F.lit(1.0)), 2) + length * length) / 2


def least_score(score: float, radius: Column, scale: Column) -> Column:
    """The score that a segment of this size must pass."""
    return score * (1 + 1 / (2 + F.exp(4 - radius * F.sqrt(scale))))


def sharp_turn(a: Vector, b: Vector, c: Vector) -> Column:
    """Whether the way a, b, c turns by a right angle or more."""
    return dot(minus(b, a), minus(c, b)) <= 0


def turn_angle(a: Vector, b: Vector) -> Column:
    """Angle between two directions."""
    n = cross(a, b)
    return F.atan2(F.sqrt(dot(n, n)), dot(a, b))


def box_gap(a: Sequence[tuple[Column, Column]], b: Sequence[tuple[Column, Column]]) -> Column:
    """Distance of two boxes given as (low, high) by axis."""
    total = F.lit(0.0)
    for (al, ah), (bl, bh) in zip(a, b, strict=True):
        total = total + F.pow(F.greatest(bl - ah, al - bh, F.lit(0.0)), 2)
    return F.sqrt(total)


def connection_reach(largest_radius: Column, limit: float = 11.0, half: float = 5.0) -> Column:
    """How far apart centres can be for a connection of at most ``limit``."""
    return 2 * F.sqrt(F.pow(largest_radius, 2) + half * half) + limit


def connection_cost(gap: Column) -> Column:
    """Between 0.5 and 1 for gaps from 0."""
    return 1 / (1 + F.exp(-gap / 100))


def voxel_weight(step: Column, a: Column, b: Column, threshold: Column, scale: Column) -> Column:
    """Cost of the way between two voxels: cheap where both are bright."""
    return step * (1 / (1 + F.exp((a - threshold) / scale)) + 1 / (1 + F.exp((b - threshold) / scale)) + 1e-5)


def raster_index(x: Column, y: Column, z: Column, width: int, height: int, depth: int) -> Column:
    """x + W y + W H z, or -1 outside."""
    ok = x.between(0, width - 1) & y.between(0, height - 1) & z.between(0, depth - 1)
    return F.when(ok, x + y * width + z * (width * height)).otherwise(-1)


def raster_point(index: Column, width: int, height: int) -> Vector:
    """x, y and z of a raster index."""
    whole = index.cast("bigint")
    return F.pmod(whole, F.lit(width)), F.pmod(F.floor(whole / width), F.lit(height)), F.floor(whole / (width * height))


def kernel(d2: Column) -> Column:
    """The Mexican hat of a squared distance."""
    return (1 - d2) * F.exp(-d2)
