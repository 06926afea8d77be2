"""Synthetic scenes: distances of points to primitives as column expressions, and points drawn on them.

A primitive's place is a parameter, so its frame is worked out once, on the driver. Distances to a
line or a triangle are those to its corners and its centre, or to the foot on it; beyond its edge
the foot's own distance to corners and centre is added.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algebra as A

Place = tuple[float, float, float]


def _unit(v: np.ndarray) -> tuple:
    return tuple((v / np.linalg.norm(v)).tolist())


def _to_nearest(p: tuple, places: list[tuple], m):
    return reduce(m.least, [A.norm(A.sub(p, c), m) for c in places])


def _draw(seed: int) -> Column:
    return F.rand(seed) * 2.0 - 1.0


@dataclass(frozen=True)
class Sphere:
    centre: Place
    radius: float

    def distance(self, p: tuple, m=A.Spark):
        return m.absolute(A.norm(A.sub(p, self.centre), m) - self.radius)

    def at(self, draws: list[Column]) -> tuple:
        return A.add(A.scale(A.normalize(tuple(draws[:3])), self.radius), tuple(F.lit(c) for c in self.centre))


@dataclass(frozen=True)
class Ball(Sphere):
    def distance(self, p: tuple, m=A.Spark):
        out = A.norm(A.sub(p, self.centre), m) - self.radius
        return m.when(out > 0.0, out, 0.0)

    def at(self, draws: list[Column]) -> tuple:
        inside = A.scale(A.normalize(tuple(draws[:3])), F.abs(draws[3]) * self.radius)
        return A.add(inside, tuple(F.lit(c) for c in self.centre))


@dataclass(frozen=True)
class Line:
    """A segment; what lies before its begin is mirrored onto it."""

    begin: Place
    end: Place

    def distance(self, p: tuple, m=A.Spark):
        a, b = np.array(self.begin), np.array(self.end)
        direction, places = _unit(b - a), [self.begin, self.end, tuple(((a + b) / 2).tolist())]
        along = m.absolute(A.dot(A.sub(p, self.begin), direction))
        foot = tuple(along * d + c for d, c in zip(direction, self.begin, strict=True))
        beyond = m.when(along > float(np.linalg.norm(b - a)), _to_nearest(foot, places, m), 0.0)
        return m.least(_to_nearest(p, places, m), A.norm(A.sub(foot, p), m) + beyond)

    def at(self, draws: list[Column]) -> tuple:
        u, v = F.abs(draws[0]), F.abs(draws[1])
        return tuple((u * a + v * b) / (u + v) for a, b in zip(self.begin, self.end, strict=True))


@dataclass(frozen=True)
class Triangle:
    """Its plane must not hold the origin: the corners' weights of a foot come from a 3x3 system."""

    a: Place
    b: Place
    c: Place

    def distance(self, p: tuple, m=A.Spark):
        corners = np.array([self.a, self.b, self.c])
        normal = _unit(np.cross(corners[1] - corners[0], corners[2] - corners[0]))
        places = [self.a, self.b, self.c, tuple(corners.mean(0).tolist())]
        off = A.dot(A.sub(p, self.c), normal)
        foot = tuple(x - off * n for x, n in zip(p, normal, strict=True))
        away = _to_nearest(foot, places, m)
        inside = 0.0
        for row in np.linalg.inv(corners.T).tolist():
            weight = A.dot(foot, tuple(row))
            inside = m.when(weight < 0.0, away, m.when(weight > 1.0, away, inside))
        return m.least(m.absolute(off) + inside, _to_nearest(p, places, m))

    def at(self, draws: list[Column]) -> tuple:
        w = [F.pow(d + 1.0, F.lit(1.5)) for d in draws[:3]]
        return tuple((w[0] * a + w[1] * b + w[2] * c) / (w[0] + w[1] + w[2]) for a, b, c in zip(self.a, self.b, self.c, strict=True))


def draw(spark: SparkSession, shapes: list, each: int, seed: int = 0) -> DataFrame:
    """shape (place in the list), point_id, x, y, z: `each` random points of every shape, drawn on the executors."""
    parts = []
    for i, s in enumerate(shapes):
        drawn = spark.range(each).select(F.lit(i).alias("shape"), F.col("id").alias("point_id"), *[_draw(seed + 10 * i + k).alias(f"u{k}") for k in range(4)])
        parts.append(drawn.select("shape", "point_id", *[v.alias(a) for v, a in zip(s.at([F.col(f"u{k}") for k in range(4)]), "xyz", strict=True)]))
    return reduce(DataFrame.unionByName, parts)


def sensor_frame(points: DataFrame, begin: tuple, end: tuple, seed: int = 0) -> DataFrame:
    """points as a sensor sees them that moves from one pose to another: alpha, and x, y, z in its own coordinates at that moment."""
    timed = points.withColumn("alpha", F.rand(seed))
    at = A.interpolate(begin, end, F.col("alpha"))
    seen = A.transform(A.inverse(at), (F.col("x"), F.col("y"), F.col("z")))
    return timed.select(*[c for c in timed.columns if c not in ("x", "y", "z")], *[v.alias(a) for v, a in zip(seen, "xyz", strict=True)])


def near(points: DataFrame, place: Place, distance: float) -> DataFrame:
    """Points within a distance of a place."""
    return points.filter(A.norm(A.sub((F.col("x"), F.col("y"), F.col("z")), place)) <= distance)


@dataclass(frozen=True)
class Acquisition:
    """A scene and a sensor's path through it. poses: (t, frame number, quaternion, place), in order."""

    shapes: tuple
    poses: tuple
    frequency: float = 10.0
    each: int = 300
    reach: float = 100.0

    @classmethod
    def of(cls, tree: dict) -> Acquisition:
        """From the tree of a scene file: lists of triangles, lines, balls and spheres, the path's poses, frequency, reach and points a shape."""
        scene = tree.get("acquisition", tree)
        places = lambda n: tuple(tuple(map(float, p)) for p in n)
        shapes = [Triangle(*places(n)) for n in scene.get("triangles", [])] + [Line(*places(n)) for n in scene.get("lines", [])]
        for name, kind in (("balls", Ball), ("spheres", Sphere)):
            shapes += [kind(tuple(map(float, n["center"])), float(n["radius"])) for n in scene.get(name, [])]
        path = []
        for i, n in enumerate(scene.get("poses", [])):
            frame = int(n.get("dest_frame_id", i))
            path.append((float(n.get("dest_timestamp", frame)), frame, _unit(np.array(n["quaternion"], float)), tuple(map(float, n["translation"]))))
        return cls(tuple(shapes), tuple(path), float(tree.get("sample_frequency", 10.0)), int(tree.get("num_points_per_primitives", 300)), float(tree.get("max_lidar_distance", 100.0)))

    def at(self, t: float) -> tuple:
        """The sensor's pose at a time, as numbers; the first or last one outside of the path."""
        times = [p[0] for p in self.poses]
        k = min(max(int(np.searchsorted(times, t, "right")), 1), len(times) - 1)
        (a, _, q, v), (b, _, r, w) = self.poses[k - 1], self.poses[k]
        share = min(max((t - a) / (b - a), 0.0), 1.0)
        q, r = np.array(q), np.array(r)
        r = -r if q @ r < 0 else r
        angle = np.arccos(min(1.0, float(q @ r)))
        turned = q if angle < 1e-9 else (np.sin((1 - share) * angle) * q + np.sin(share * angle) * r) / np.sin(angle)
        return _unit(turned), tuple((np.array(v) * (1 - share) + np.array(w) * share).tolist())

    def path(self, spark: SparkSession) -> DataFrame:
        """pose_id, t and the pose at every period of the frequency, from the first to the last pose."""
        first, last = self.poses[0][0], self.poses[-1][0]
        rows = []
        for i in range(int((last - first) * self.frequency + 1e-9) + 1):
            q, v = self.at(first + i / self.frequency)
            rows.append((i, first + i / self.frequency, *q, *v))
        return spark.createDataFrame(rows, "pose_id long, t double, qx double, qy double, qz double, qw double, x double, y double, z double")

    def frame(self, spark: SparkSession, number: int, seed: int = 0) -> DataFrame:
        """frame_id, point_id, shape, alpha, t, x, y, z of one frame: points near the sensor, as it sees them while it moves for a period."""
        begin = self.poses[0][0] + number / self.frequency
        end = begin + 1 / self.frequency
        a, b = (tuple(tuple(F.lit(x) for x in part) for part in self.at(t)) for t in (begin, end))
        drawn = near(draw(spark, list(self.shapes), self.each, seed + 1000 * number), self.at(begin)[1], self.reach)
        seen = sensor_frame(drawn, a, b, seed + 1000 * number + 999)
        return seen.select(F.lit(number).cast("long").alias("frame_id"), (F.col("shape") * self.each + F.col("point_id")).cast("long").alias("point_id"), "shape", "alpha", (F.lit(begin) + F.col("alpha") / self.frequency).alias("t"), "x", "y", "z")


def turned_noise(poses: DataFrame, degrees: float, shift: float, seed: int = 0) -> DataFrame:
    """poses moved by uniform noise: a turn of at most `degrees` about each axis in turn, a shift of at most `shift` on each."""
    half = [_draw(seed + i) * float(np.radians(degrees) / 2) for i in range(3)]
    drawn = poses.withColumns({f"__h{i}": h for i, h in enumerate(half)} | {f"__s{i}": _draw(seed + 3 + i) * shift for i in range(3)})
    unit = lambda i: tuple(F.sin(f"__h{i}") if j == i else F.lit(0.0) for j in range(3)) + (F.cos(f"__h{i}"),)
    q = A.multiply(A.multiply(unit(0), unit(1)), unit(2))
    drawn = drawn.withColumns(dict(zip(("__qx", "__qy", "__qz", "__qw"), q, strict=True)))
    turn = tuple(F.col(f"__{n}") for n in ("qx", "qy", "qz", "qw")), tuple(F.col(f"__s{i}") for i in range(3))
    own = tuple(F.col(n) for n in ("qx", "qy", "qz", "qw")), tuple(F.col(a) for a in "xyz")
    moved = A.compose(turn, own)
    return drawn.select(*[c for c in poses.columns if c not in ("qx", "qy", "qz", "qw", "x", "y", "z")], *[v.alias(n) for n, v in zip(("qx", "qy", "qz", "qw", "x", "y", "z"), (*moved[0], *moved[1]), strict=True)])


def noisy(poses: DataFrame, shift: float, seed: int = 0) -> DataFrame:
    """poses with uniform noise of at most `shift` on each coordinate."""
    return poses.withColumns({a: F.col(a) + _draw(seed + i) * shift for i, a in enumerate("xyz")})
