"""Rotations, rigid transforms, serial chains and clearances as column expressions.

A vector is array<double>, a matrix array of rows; angles are radians. A table of
joint values or poses is mapped row by row in the JVM, with the robot as literals.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from quarry.functions.neural import dot, matrix
from quarry.functions.waves import let

_c = lambda x: F.col(x) if isinstance(x, str) else x
_v = lambda *x: F.array(*(e.cast("double") if isinstance(e, Column) else F.lit(float(e)) for e in x))


def wrap_angle(a) -> Column:
    """Into -pi (included) to pi."""
    return F.pmod(_c(a) + math.pi, F.lit(2 * math.pi)) - math.pi


def skew(v) -> Column:
    v = _c(v)
    return F.array(_v(0, -v[2], v[1]), _v(v[2], 0, -v[0]), _v(-v[1], v[0], 0))


def unskew(m) -> Column:
    m = _c(m)
    return _v((m[2][1] - m[1][2]) / 2, (m[0][2] - m[2][0]) / 2, (m[1][0] - m[0][1]) / 2)


def rot_x(a) -> Column:
    c, s = F.cos(_c(a)), F.sin(_c(a))
    return F.array(_v(1, 0, 0), _v(0, c, -s), _v(0, s, c))


def rot_y(a) -> Column:
    c, s = F.cos(_c(a)), F.sin(_c(a))
    return F.array(_v(c, 0, s), _v(0, 1, 0), _v(-s, 0, c))


def rot_z(a) -> Column:
    c, s = F.cos(_c(a)), F.sin(_c(a))
    return F.array(_v(c, -s, 0), _v(s, c, 0), _v(0, 0, 1))


def transposed(m) -> Column:
    return let(_c(m), lambda a: F.transform(F.sequence(F.lit(0), F.size(a[0]) - 1), lambda k: F.transform(a, lambda row: F.get(row, k))))


def product(a, b) -> Column:
    """Of two matrices."""
    return let(transposed(b), lambda columns: F.transform(_c(a), lambda row: F.transform(columns, lambda col: dot(row, col))))


def applied(m, v) -> Column:
    return let(_c(v), lambda x: F.transform(_c(m), lambda row: dot(row, x)))


def rpy_to_matrix(roll, pitch, yaw) -> Column:
    """First roll about x, then pitch about y, then yaw about z, about fixed axes."""
    return product(rot_z(yaw), product(rot_y(pitch), rot_x(roll)))


def euler_to_matrix(angles, order: str = "xyz") -> Column:
    """Of an array of angles, about fixed axes in order."""
    turns = {"x": rot_x, "y": rot_y, "z": rot_z}
    out = turns[order[0]](_c(angles)[0])
    for k, axis in enumerate(order[1:], 1):
        out = product(turns[axis](_c(angles)[k]), out)
    return out


def matrix_to_euler(m) -> Column:
    """Roll, pitch, yaw; at a pitch of 90 degrees the yaw is 0."""
    def found(r):
        flat = F.sqrt(r[0][0] * r[0][0] + r[1][0] * r[1][0])
        usual = _v(F.atan2(r[2][1], r[2][2]), F.atan2(-r[2][0], flat), F.atan2(r[1][0], r[0][0]))
        return F.when(flat > 1e-9, usual).otherwise(_v(F.atan2(-r[1][2], r[1][1]), F.atan2(-r[2][0], flat), 0))

    return let(_c(m), found)


def quaternion_to_matrix(q) -> Column:
    """w, x, y, z, of any length but 0."""
    def turned(u):
        w, x, y, z = (u[k] for k in range(4))
        return F.array(_v(1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)), _v(2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)), _v(2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)))

    return let(_c(q), lambda p: let(F.transform(p, lambda e: e / F.sqrt(dot(p, p))), turned))


def matrix_to_quaternion(m) -> Column:
    """w, x, y, z with w of 0 or more; by the largest of the four, so that small ones keep their digits."""
    def found(r):
        # each row is four times the quaternion times one of its parts
        rows = F.array(
            _v(1 + r[0][0] + r[1][1] + r[2][2], r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1]), _v(r[2][1] - r[1][2], 1 + r[0][0] - r[1][1] - r[2][2], r[0][1] + r[1][0], r[0][2] + r[2][0]),
            _v(r[0][2] - r[2][0], r[0][1] + r[1][0], 1 - r[0][0] + r[1][1] - r[2][2], r[1][2] + r[2][1]), _v(r[1][0] - r[0][1], r[0][2] + r[2][0], r[1][2] + r[2][1], 1 - r[0][0] - r[1][1] + r[2][2]))
        best = F.array_max(F.transform(rows, lambda row, i: F.struct(F.get(row, i).alias("size"), row.alias("row"))))
        return let(best, lambda s: F.transform(s["row"], lambda v: F.when(s["row"][0] < 0, -v).otherwise(v) / (2 * F.sqrt(s["size"]))))

    return let(_c(m), found)


def homogeneous(rotation, shift) -> Column:
    """A 4 x 4 transform."""
    return let(F.struct(_c(rotation).alias("r"), _c(shift).alias("t")), lambda s: F.concat(F.zip_with(s["r"], s["t"], lambda row, t: F.concat(row, F.array(t))), F.array(_v(0, 0, 0, 1))))


def inverted(m) -> Column:
    """Of a rigid transform."""
    def run(a):
        r = transposed(F.transform(F.slice(a, 1, 3), lambda row: F.slice(row, 1, 3)))
        return let(r, lambda r: homogeneous(r, F.transform(applied(r, _v(a[0][3], a[1][3], a[2][3])), lambda v: -v)))

    return let(_c(m), run)


def transformed(m, points) -> Column:
    """An array of points."""
    return let(_c(m), lambda a: F.transform(_c(points), lambda p: F.transform(F.slice(a, 1, 3), lambda row: dot(F.slice(row, 1, 3), p) + row[3])))


def interpolated(start, end, share) -> Column:
    """Straight between two points."""
    t = share if isinstance(share, Column) else F.lit(float(share))
    return F.zip_with(_c(start), _c(end), lambda a, b: a + (b - a) * t)


def dh_transform(a: float, alpha: float, d: float, theta) -> Column:
    """Of one link by its four parameters, the joint angle a column."""
    c, s, ca, sa = F.cos(_c(theta)), F.sin(_c(theta)), math.cos(alpha), math.sin(alpha)
    return F.array(_v(c, -s * ca, s * sa, a * c), _v(s, c * ca, -c * sa, a * s), _v(0, sa, ca, d), _v(0, 0, 0, 1))


def chain_transforms(links: Sequence[tuple[float, float, float]], joints) -> list[Column]:
    """Transforms of all links (a, alpha, d) from the base, joints an array of angles."""
    out, at = [], None
    for k, (a, alpha, d) in enumerate(links):
        own = dh_transform(a, alpha, d, _c(joints)[k])
        at = own if at is None else product(at, own)
        out.append(at)
    return out


def forward_kinematics(links, joints) -> Column:
    return chain_transforms(links, joints)[-1]


def _origin(m: Column) -> Column:
    return let(m, lambda a: _v(a[0][3], a[1][3], a[2][3]))


def chain_positions(links, joints) -> Column:
    """The base's place and those of all links' ends."""
    return F.array(_v(0, 0, 0), *map(_origin, chain_transforms(links, joints)))


def cross(a: Column, b: Column) -> Column:
    return _v(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def geometric_jacobian(links, joints) -> Column:
    """6 rows: linear and angular velocity of the end for each joint of a chain of revolute joints."""
    frames = chain_transforms(links, joints)
    axes = [_v(0, 0, 1), *(let(m, lambda a: _v(a[0][2], a[1][2], a[2][2])) for m in frames[:-1])]
    places = [_v(0, 0, 0), *map(_origin, frames)]
    end = places[-1]
    columns = [F.concat(let(F.struct(z.alias("z"), F.zip_with(end, p, lambda u, v: u - v).alias("r")), lambda s: cross(s["z"], s["r"])), z) for z, p in zip(axes, places)]
    return transposed(F.array(*columns))


def planar_2r_jacobian(l1: float, l2: float, joints) -> Column:
    q = _c(joints)
    a, b = q[0], q[0] + q[1]
    return F.array(_v(-l1 * F.sin(a) - l2 * F.sin(b), -l2 * F.sin(b)), _v(l1 * F.cos(a) + l2 * F.cos(b), l2 * F.cos(b)))


def inverse_planar_2r(l1: float, l2: float, x, y) -> Column:
    """Joint angles with the elbow down; null out of reach."""
    c = (_c(x) * _c(x) + _c(y) * _c(y) - l1 * l1 - l2 * l2) / (2 * l1 * l2)
    q2 = F.acos(c)
    return F.when(F.abs(c) <= 1, _v(F.atan2(_c(y), _c(x)) - F.atan2(l2 * F.sin(q2), l1 + l2 * F.cos(q2)), q2))


def clipped(joints, low: Sequence[float], high: Sequence[float]) -> Column:
    limits = F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(low, high)))
    return F.zip_with(_c(joints), limits, lambda q, s: F.least(F.greatest(q, s["a"]), s["b"]))


def limit_violation(joints, low: Sequence[float], high: Sequence[float]) -> Column:
    """The largest distance beyond a limit; 0 within."""
    return F.array_max(F.zip_with(_c(joints), clipped(joints, low, high), lambda a, b: F.abs(a - b)))


def within_limits(joints, low: Sequence[float], high: Sequence[float]) -> Column:
    return limit_violation(joints, low, high) <= 0


def _less(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda u, v: u - v)


def length(v: Column) -> Column:
    return let(v, lambda x: F.sqrt(dot(x, x)))


def point_segment_distance(p, a, b) -> Column:
    def run(s):
        ab, ap = _less(s["b"], s["a"]), _less(s["p"], s["a"])
        t = let(F.struct(dot(ab, ab).alias("n"), dot(ap, ab).alias("d")), lambda q: F.when(q["n"] > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), q["d"] / q["n"]))).otherwise(0.0))
        return let(t, lambda t: length(_less(s["p"], F.zip_with(s["a"], ab, lambda u, v: u + t * v))))

    return let(F.struct(_c(p).alias("p"), _c(a).alias("a"), _c(b).alias("b")), run)


def sphere_clearance(p, centre: Sequence[float], radius: float) -> Column:
    return length(_less(_c(p), _v(*centre))) - radius


def box_clearance(p, low: Sequence[float], high: Sequence[float]) -> Column:
    """Negative within, by the way to the nearest side."""
    gaps = F.zip_with(_c(p), F.array(*(F.struct(F.lit(float(a)).alias("a"), F.lit(float(b)).alias("b")) for a, b in zip(low, high))), lambda x, s: F.greatest(s["a"] - x, x - s["b"]))
    return let(gaps, lambda g: length(F.transform(g, lambda v: F.greatest(v, F.lit(0.0)))) + F.least(F.array_max(g), F.lit(0.0)))


def capsule_clearance(p, a: Sequence[float], b: Sequence[float], radius: float) -> Column:
    return point_segment_distance(p, _v(*a), _v(*b)) - radius


def chain_clearance(links, joints, centre: Sequence[float], radius: float, link_radius: float = 0.0) -> Column:
    """The least clearance of a chain's links to a sphere."""
    return let(chain_positions(links, joints), lambda p: F.array_min(F.transform(F.sequence(F.lit(0), F.size(p) - 2), lambda k: point_segment_distance(_v(*centre), F.get(p, k), F.get(p, k + 1)) - radius - link_radius)))


def cubic_scaling(t) -> Column:
    """0 to 1 with no speed at the ends."""
    return let(F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(t))), lambda s: s * s * (3 - 2 * s))


def quintic_scaling(t) -> Column:
    """0 to 1 with no speed and acceleration at the ends."""
    return let(F.least(F.lit(1.0), F.greatest(F.lit(0.0), _c(t))), lambda s: s * s * s * (10 - 15 * s + 6 * s * s))


def joint_trajectory(start, end, t, duration: float, scaling: str = "quintic") -> Column:
    """Joint values at time t of a move."""
    share = {"cubic": cubic_scaling, "quintic": quintic_scaling, "linear": lambda s: F.least(F.lit(1.0), F.greatest(F.lit(0.0), s))}[scaling](_c(t) / duration)
    return let(share, lambda s: interpolated(start, end, s))


def literal(rows: Sequence[Sequence[float]]) -> Column:
    return matrix(rows)
