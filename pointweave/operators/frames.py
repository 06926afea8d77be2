"""Frames of points on a moving sensor. Points have frame_id, t and x, y, z in the sensor's own coordinates.

A frame's begin pose has the prefix b_, its end pose e_. Each step is a projection of its own, so
that an interpolated pose is worked out once and not wherever one of its components is used.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import algebra as A
from . import trajectories as T

XYZ = ("x", "y", "z")


def _point(names: tuple[str, ...] = XYZ) -> tuple:
    return tuple(F.col(n) for n in names)


def moved(points: DataFrame, prefix: str, names: tuple[str, str, str] = ("wx", "wy", "wz")) -> DataFrame:
    """points with their place under a pose's columns."""
    return points.withColumns(dict(zip(names, A.transform(T.pose(prefix), _point()), strict=True)))


def raw_to_world(points: DataFrame, poses: DataFrame) -> DataFrame:
    """points (seq, t, pose_id, x, y, z) with wx, wy, wz, moved by the trajectory's pose at their own time. Points of sequences without a pose go."""
    at = T.interpolated(T.bracket(poses, points).filter("lo is not null"), "i_")
    return moved(at, "i_").drop("lo", "hi", "alpha", *[f"i_{n}" for n in T.POSE])


def undistorted(points: DataFrame, alpha: str = "alpha") -> DataFrame:
    """points, carrying b_ and e_ poses and their share of the frame, as the sensor at the end of the frame would see them."""
    at = points.withColumns(dict(zip([f"__i{n}" for n in ("qx", "qy", "qz", "qw", *XYZ)], sum(A.interpolate(T.pose("b_"), T.pose("e_"), F.col(alpha)), ()), strict=True)))
    seen = moved(at, "__i", ("__wx", "__wy", "__wz"))
    local = A.rotate(A.conjugate(T.pose("e_")[0]), A.sub(_point(("__wx", "__wy", "__wz")), T.pose("e_")[1]))
    out = seen.select(*[c for c in points.columns if c not in XYZ], *[v.alias(a) for a, v in zip(XYZ, local, strict=True)])
    return out


def continuous_residuals(points: DataFrame, kind: str = "plane", alpha: str = "alpha") -> DataFrame:
    """points with the residual of their place (moved by the pose at their share of the frame) against a reference rx, ry, rz.

    kind: plane (normal nx, ny, nz: signed distance), line (direction nx, ny, nz: distance), point
    (distance) or distribution (covariance cxx to czz: squared Mahalanobis distance).
    """
    at = points.withColumns(dict(zip([f"__i{n}" for n in ("qx", "qy", "qz", "qw", *XYZ)], sum(A.interpolate(T.pose("b_"), T.pose("e_"), F.col(alpha)), ()), strict=True)))
    seen = moved(at, "__i", ("__wx", "__wy", "__wz"))
    p, r, n = _point(("__wx", "__wy", "__wz")), _point(("rx", "ry", "rz")), lambda: _point(("nx", "ny", "nz"))
    residual = {
        "plane": lambda: A.point_to_plane(p, r, n()), "line": lambda: A.point_to_line(p, r, n()), "point": lambda: A.norm(A.sub(p, r)),
        "distribution": lambda: A.point_to_distribution(p, r, tuple(F.col(f"c{k}") for k in ("xx", "xy", "xz", "yy", "yz", "zz"))),
    }[kind]()
    return seen.withColumn("residual", residual).drop(*[c for c in seen.columns if c.startswith("__")])


def with_pairs(poses: DataFrame) -> DataFrame:
    """Successive poses of a sequence as b_ and e_ columns: seq, pose_id, and both poses."""
    return T.with_next(poses).select("seq", "pose_id", "t", *T.columns(T.pose(), "b_"), *T.columns(T.pose(of="next"), "e_"))


def predicted(pairs: DataFrame) -> DataFrame:
    """with_pairs() with the pose p_ that follows if the motion goes on: the last pose times the motion between the two."""
    step = pairs.withColumns(dict(zip([f"__r{n}" for n in ("qx", "qy", "qz", "qw", *XYZ)], sum(A.relative(T.pose("b_"), T.pose("e_")), ()), strict=True)))
    return step.withColumns(dict(zip([f"p_{n}" for n in ("qx", "qy", "qz", "qw", *XYZ)], sum(A.compose(T.pose("e_"), T.pose("__r")), ()), strict=True))).drop(*[c for c in step.columns if c.startswith("__")])


def deltas(frames: DataFrame) -> DataFrame:
    """Of frames (seq, pose_id, t, b_ and e_ poses, in order): the four distances to the frame before.

    distance_correction: between its end and this begin; relative_distance and relative_orientation:
    between the two ends; ego_orientation: between own begin and end. 0 for a first frame.
    """
    names = ("qx", "qy", "qz", "qw", *XYZ)
    last = frames.withColumns({f"__l{n}": F.lag(f"e_{n}").over(T.by()) for n in names})
    gap = lambda p, q: A.norm(A.sub(p[1], q[1]))
    zero = F.lit(0.0)
    return last.select(
        "seq", "pose_id",
        F.coalesce(gap(T.pose("b_"), T.pose("__l")), zero).alias("distance_correction"), F.coalesce(A.angle_degrees(T.pose("__l")[0], T.pose("e_")[0]), zero).alias("relative_orientation"),
        F.coalesce(gap(T.pose("e_"), T.pose("__l")), zero).alias("relative_distance"), A.angle_degrees(T.pose("b_")[0], T.pose("e_")[0]).alias("ego_orientation"),
    )


def checked(frames: DataFrame, expected: float, tolerance: float = 0.05) -> DataFrame:
    """Of frames (seq, frame_id, t_min, t_max): `used`, whether the frame's duration is the expected one within a share of it (a first frame always is), and `gap`, whether more than a frame is missing before it.

    A gap is counted from the last frame that was used.
    """
    order = Window.partitionBy("seq").orderBy("frame_id")
    first = F.row_number().over(order) == 1
    share = (F.col("t_max") - F.col("t_min")) / F.lit(float(expected))
    out = frames.withColumn("used", first | share.between(1 - tolerance, 1 + tolerance))
    before = F.last(F.when(F.col("used"), F.col("t_max")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    return out.withColumn("gap", F.col("used") & F.coalesce(F.abs(F.col("t_min") - before) > expected, F.lit(False)))


def extent(points: DataFrame, keys: list[str]) -> DataFrame:
    """keys, t_min, t_max and n of each frame."""
    return points.groupBy(*keys).agg(F.min("t").alias("t_min"), F.max("t").alias("t_max"), F.count(F.lit(1)).alias("n"))


def with_share(points: DataFrame, keys: list[str]) -> DataFrame:
    """points with `alpha`, the share of their frame's time that has gone at their own; 1 in a frame of one moment."""
    ends = extent(points, keys).drop("n")
    span = F.col("t_max") - F.col("t_min")
    return points.join(ends, keys).withColumn("alpha", F.when(span > 0, (F.col("t") - F.col("t_min")) / span).otherwise(F.lit(1.0))).drop("t_min", "t_max")


def queue(frames: DataFrame, n: int, value: Column) -> DataFrame:
    """frames with `recent`, the value over the last n frames of the sequence, the own one included."""
    return frames.withColumn("recent", value.over(Window.partitionBy("seq").orderBy("frame_id").rowsBetween(-n + 1, 0)))


def durations(ticks: DataFrame, keys: list[str]) -> DataFrame:
    """count, total, mean and longest `seconds` of each key."""
    return ticks.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("total"), F.avg("seconds").alias("mean"), F.max("seconds").alias("longest"))


# --- poses that know their two frames ---------------------------------------------------------------
_POSE = ("qx", "qy", "qz", "qw", *XYZ)


def inverted(poses: DataFrame) -> DataFrame:
    """poses (frame_id, t to ref_frame, ref_t) seen the other way round: the pose is inverted, frames and times change places."""
    q, v = A.inverse(T.pose())
    swapped = {"frame_id": "ref_frame", "t": "ref_t", "ref_frame": "frame_id", "ref_t": "t"}
    values = dict(zip(_POSE, (*q, *v), strict=True))
    return poses.select(*[values[c].alias(c) if c in values else F.col(swapped.get(c, c)).alias(c) for c in poses.columns])


def joined(pairs: DataFrame, left: str = "b_", right: str = "e_") -> DataFrame:
    """The pose left times right of each row, from left's reference to right's frame. A right pose that doesn't begin where the left one ends, in frame and time, raises."""
    fits = F.assert_true((F.col(f"{right}ref_frame") == F.col(f"{left}frame_id")) & (F.col(f"{right}ref_t") == F.col(f"{left}t")), F.lit("the poses don't meet"))
    q, v = A.compose(T.pose(left), T.pose(right))
    ends = [F.col(f"{right}frame_id").alias("frame_id"), F.col(f"{right}t").alias("t"), F.col(f"{left}ref_frame").alias("ref_frame"), F.col(f"{left}ref_t").alias("ref_t")]
    rest = [c for c in pairs.columns if not c.startswith((left, right))]
    return pairs.select(*rest, *ends, *[F.when(fits.isNull(), x).alias(n) for n, x in zip(_POSE, (*q, *v), strict=True)])


def interpolated_inside(found: DataFrame, prefix: str = "i_") -> DataFrame:
    """T.bracket()'s rows with the interpolated pose; a time outside of the poses raises."""
    at = found.withColumn("alpha", A.alpha_inside(F.col("t"), F.col("lo.t"), F.col("hi.t")))
    return at.select("*", *T.columns(A.interpolate(T.pose(of="lo"), T.pose(of="hi"), F.col("alpha")), prefix))


#: Ways to bring a frame's points into the world: by the frame's end alone, or by the pose at each point's own time.
MODES = {"none": False, "constant_velocity": False, "iterative": True, "continuous": True}


def to_world(points: DataFrame, mode: str, alpha: str = "alpha") -> DataFrame:
    """points, carrying b_ and e_ poses and their share of the frame, with wx, wy, wz by a mode."""
    if not MODES[mode]:
        return moved(points, "e_")
    at = points.withColumns(dict(zip([f"__i{n}" for n in _POSE], sum(A.interpolate(T.pose("b_"), T.pose("e_"), F.col(alpha)), ()), strict=True)))
    return moved(at, "__i").drop(*[f"__i{n}" for n in _POSE])


def consistent(frames: DataFrame, shift: float, degrees: float) -> DataFrame:
    """frames (b_, e_ and predicted p_b_, p_e_ poses) with `agrees`: bit 1 if the begins, 2 if the ends, 4 if the motions agree within bounds of shift and turn."""
    rel = frames.withColumns(dict(zip([f"__r{n}" for n in _POSE], sum(A.relative(T.pose("b_"), T.pose("e_")), ()), strict=True)) | dict(zip([f"__p{n}" for n in _POSE], sum(A.relative(T.pose("p_b_"), T.pose("p_e_")), ()), strict=True)))
    near = lambda a, b: (A.norm(A.sub(T.pose(a)[1], T.pose(b)[1])) <= shift) & (A.angle_degrees(T.pose(a)[0], T.pose(b)[0]) <= degrees)
    bits = [F.when(near(a, b), F.lit(k)).otherwise(F.lit(0)) for k, a, b in ((1, "b_", "p_b_"), (2, "e_", "p_e_"), (4, "__r", "__p"))]
    return rel.withColumn("agrees", bits[0] + bits[1] + bits[2]).drop(*[c for c in rel.columns if c.startswith("__")])


def entering(frames: DataFrame, shift: float, every: int = 0) -> DataFrame:
    """seq, pose_id, gone and enters of poses in order: `gone` is the path since the last one that entered a map, which the first does, and then each that has gone `shift` or comes `every` poses later.

    What enters depends on what entered before, so a sequence's steps, two numbers a pose, are walked in one task.
    """
    steps = T.steps(frames).withColumn("rank", F.row_number().over(T.by())).select(F.col("seq").cast("long").alias("seq"), F.col("pose_id").cast("long").alias("pose_id"), F.col("rank").cast("long").alias("rank"), "step")

    def walk(t: pa.Table) -> pa.Table:
        t = t.sort_by("rank")
        gone, enters, far, skipped = [], [], 0.0, 0
        for i, step in enumerate(t["step"].to_pylist()):
            far, skipped = far + step, skipped + 1
            enter = i == 0 or far >= shift or bool(every and skipped >= every)
            gone.append(far)
            enters.append(enter)
            if enter:
                far, skipped = 0.0, 0
        return t.select(["seq", "pose_id"]).append_column("gone", pa.array(gone, pa.float64())).append_column("enters", pa.array(enters, pa.bool_()))

    return steps.groupBy("seq").applyInArrow(walk, "seq long, pose_id long, gone double, enters boolean")
