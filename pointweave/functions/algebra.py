"""Rigid-motion algebra over anything that adds and multiplies: Spark columns, SQL text, numbers.

Vectors are tuples (x, y, z), quaternions (x, y, z, w), poses (quaternion, vector). `m` supplies
square roots, angles and choices for the kind of number at hand; `Spark` builds expressions that
Catalyst compiles, so nothing here runs row by row in Python.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


class Spark:
    sqrt, sin, cos, acos, exp, log, absolute = F.sqrt, F.sin, F.cos, F.acos, F.exp, F.log, F.abs

    @staticmethod
    def least(a, b) -> Column:
        return F.least(*[x if isinstance(x, Column) else F.lit(x) for x in (a, b)])

    @staticmethod
    def when(condition: Column, a, b) -> Column:
        return F.when(condition, a).otherwise(b)

    @staticmethod
    def divide(a, b) -> Column:
        return F.try_divide(a, b)


def add(a, b):
    return tuple(x + y for x, y in zip(a, b, strict=True))


def sub(a, b):
    return tuple(x - y for x, y in zip(a, b, strict=True))


def scale(a, k):
    return tuple(x * k for x in a)


def dot(a, b):
    first, *rest = (x * y for x, y in zip(a, b, strict=True))
    for x in rest:
        first = first + x
    return first


def cross(a, b):
    return (a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def norm(a, m=Spark):
    return m.sqrt(dot(a, a))


def normalize(a, m=Spark):
    n = norm(a, m)
    return tuple(x / n for x in a)


def multiply(p, q):
    """Hamilton product."""
    v = add(add(scale(q[:3], p[3]), scale(p[:3], q[3])), cross(p[:3], q[:3]))
    return (*v, p[3] * q[3] - dot(p[:3], q[:3]))


def conjugate(q):
    return (-q[0], -q[1], -q[2], q[3])


def rotate(q, v):
    t = scale(cross(q[:3], v), 2.0)
    return add(add(v, scale(t, q[3])), cross(q[:3], t))


def transform(pose, v):
    return add(rotate(pose[0], v), pose[1])


def compose(a, b, m=Spark):
    return normalize(multiply(a[0], b[0]), m), transform(a, b[1])


def inverse(pose):
    q = conjugate(pose[0])
    return q, scale(rotate(q, pose[1]), -1.0)


def relative(a, b, m=Spark):
    return compose(inverse(a), b, m)


def slerp(p, q, w, m=Spark):
    """Shortest-arc interpolation; linear where the two are almost equal."""
    d = dot(p, q)
    c = m.least(m.absolute(d), 1.0)
    angle = m.acos(c)
    near, s = c > 1.0 - 1e-12, m.sin(angle)
    safe = m.when(near, 1.0, s)
    a = m.when(near, 1.0 - w, m.sin((1.0 - w) * angle) / safe)
    b = m.when(near, w, m.sin(w * angle) / safe) * m.when(d < 0.0, -1.0, 1.0)
    return normalize(add(scale(p, a), scale(q, b)), m)


def interpolate(a, b, w, m=Spark):
    return slerp(a[0], b[0], w, m), add(scale(a[1], 1.0 - w), scale(b[1], w))


def angle_degrees(p, q, m=Spark):
    """Angle between two rotations."""
    return m.acos(m.least(m.absolute(dot(p, q)), 1.0)) * 2.0 * 57.29577951308232


def alpha(t, t0, t1, m=Spark):
    """Place of t between two times: 0 outside of them, 1 where they are equal."""
    return m.when(t0 == t1, 1.0, m.when((t < t0) | (t > t1), 0.0, (t - t0) / m.when(t0 == t1, 1.0, t1 - t0)))


def alpha_inside(t: Column, t0: Column, t1: Column) -> Column:
    """alpha() of a time that has to be inside; another one raises."""
    return F.when(F.assert_true((t >= t0) & (t <= t1), F.lit("the time is outside of the poses")).isNull(), alpha(t, t0, t1))


def middle(a, b, m=Spark):
    """The pose half way between two."""
    return interpolate(a, b, 0.5, m)


def distances(a, b, c, d, m=Spark) -> dict:
    """Of two frames, from pose a to b and from c to d: location (of the begins), translation and rotation (of begins and ends together), ego angle (of the second frame). Angles in degrees."""
    gap = lambda p, q: norm(sub(p[1], q[1]), m)
    return {"location": gap(a, c), "translation": gap(a, c) + gap(b, d), "rotation": angle_degrees(a[0], c[0], m) + angle_degrees(b[0], d[0], m), "ego": angle_degrees(c[0], d[0], m)}


def parameters(pose) -> list:
    """The 7 numbers of a pose: quaternion, translation."""
    return [*pose[0], *pose[1]]


IDENTITY = (0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0)


def random_pose(seed: int, shift: float = 1.0) -> tuple:
    """A pose drawn on the executors: a uniform rotation and a translation of at most `shift` on each axis."""
    u, v, w = (F.rand(seed + i) for i in range(3))
    a, b = F.sqrt(1.0 - u), F.sqrt(u)
    two = 6.283185307179586
    return (a * F.sin(v * two), a * F.cos(v * two), b * F.sin(w * two), b * F.cos(w * two)), tuple((F.rand(seed + 3 + i) * 2.0 - 1.0) * shift for i in range(3))


# Residuals of a transformed point against a reference, and robust losses of a squared residual.
def point_to_plane(p, reference, normal):
    return dot(sub(reference, p), normal)


def point_to_line(p, reference, direction, m=Spark):
    return norm(cross(direction, sub(p, reference)), m)


def point_to_distribution(p, mean, cov, m=Spark, ridge: float = 0.05):
    """Squared Mahalanobis distance; cov = (xx, xy, xz, yy, yz, zz), with `ridge` added to its diagonal."""
    a, b, c, d, e, f = cov[0] + ridge, cov[1], cov[2], cov[3] + ridge, cov[4], cov[5] + ridge
    i = (d * f - e * e, c * e - b * f, b * e - c * d, a * f - c * c, b * c - a * e, a * d - b * b)
    det = a * i[0] + b * i[1] + c * i[2]
    x, y, z = sub(p, mean)
    return (x * x * i[0] + y * y * i[3] + z * z * i[5] + (x * y * i[1] + x * z * i[2] + y * z * i[4]) * 2.0) / det


def cauchy(s, k, m=Spark):
    return m.log(s / (k * k) + 1.0) * (k * k)


def huber(s, k, m=Spark):
    return m.when(s <= k * k, s, m.sqrt(s) * (2.0 * k) - k * k)


def truncated(s, k, m=Spark):
    return m.least(s, k * k)


def tukey(s, k, m=Spark):
    u = s / (k * k) * -1.0 + 1.0
    return m.when(s <= k * k, (u * u * u * -1.0 + 1.0) * (k * k / 3.0), k * k / 3.0)


def tolerant(s, a, b, m=Spark):
    """Softened threshold at a of width b."""
    from math import exp, log

    return m.log(m.exp((s - a) / b) + 1.0) * b - b * log(1.0 + exp(-a / b))


LOSSES = {"standard": lambda s, m=Spark: s, "cauchy": lambda s, m=Spark: cauchy(s, 0.5, m), "huber": lambda s, m=Spark: huber(s, 0.5, m), "truncated": lambda s, m=Spark: truncated(s, 0.5, m), "tukey": lambda s, m=Spark: tukey(s, 0.5, m), "tolerant": lambda s, m=Spark: tolerant(s, 0.05, 0.1, m)}
