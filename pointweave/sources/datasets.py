"""Sequences of known data sets under a root folder: a catalogue, their frames, their ground truth.

The catalogue is a list of folders, found on the driver through the store's own listing; frames and
poses are read by Spark.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..operators import frames as M
from ..operators import registration as R
from ..operators import trajectories as T
from . import files

# Published calibrations (rotation row by row, translation) and numbers of frames.
_KITTI_A = ((4.276802385584e-04, -9.999672484946e-01, -8.084491683471e-03, -7.210626507497e-03, 8.081198471645e-03, -9.999413164504e-01, 9.999738645903e-01, 4.859485810390e-04, -7.206933692422e-03), (-1.198459927713e-02, -5.403984729748e-02, -2.921968648686e-01))
_KITTI_B = ((2.347736981471e-04, -9.999441545438e-01, -1.056347781105e-02, 1.044940741659e-02, 1.056535364138e-02, -9.998895741176e-01, 9.999453885620e-01, 1.243653783865e-04, 1.045130299567e-02), (-2.796816941295e-03, -7.510879138296e-02, -2.721327964059e-01))
_KITTI_C = ((-1.857739385241e-03, -9.999659513510e-01, -8.039975204516e-03, -6.481465826011e-03, 8.051860151134e-03, -9.999466081774e-01, 9.999773098287e-01, -1.805528627661e-03, -6.496203536139e-03), (-4.784029760483e-03, -7.337429464231e-02, -3.339968064433e-01))
_KITTI_360 = ((9.999290633685804508e-01, 5.805355888196038310e-03, 1.040029024212630118e-02, 5.774300279226996999e-03, -9.999787876452227442e-01, 3.013573682642321436e-03, 1.041756443854582707e-02, -2.953305511449066945e-03, -9.999413744330052367e-01), (-7.640302229235816922e-01, 2.966030253893782165e-01, -8.433819635885287935e-01))
KITTI_FRAMES = (4540, 1100, 4660, 800, 270, 2760, 1100, 1100, 4070, 1590, 1200, 920, 1060, 3280, 630, 1900, 1730, 490, 1800, 4980, 830, 2720)
KITTI_360_FRAMES = {"00": 11500, "02": 19230, "03": 1029, "04": 11399, "05": 6722, "06": 9697, "07": 3160, "09": 13954, "10": 3742}
HILTI_FRAMES = (895, 2004, 2641, 5824, 1130, 3308, 3503, 1357, 1995, 3992, 4298, 3749)
#: Sensor to inertial unit: quaternion x, y, z, w and translation.
HILTI_2021 = ((0.999993918507834, 0.0012283821413574625, -0.0032596475280467258, -0.00016947759535612024), (0.01001966915517371, -0.006645473484212856, 0.09473042428051345))
HILTI_2022 = ((0.7071068, -0.7071068, 0.0, 0.0), (-0.001, -0.00855, 0.055))
NCLT_DAYS = (
    "2012-01-08", "2012-01-15", "2012-01-22", "2012-02-02", "2012-02-04", "2012-02-05", "2012-02-12", "2012-02-18", "2012-02-19", "2012-03-17", "2012-03-25", "2012-03-31", "2012-04-29", "2012-05-11",
    "2012-05-26", "2012-06-15", "2012-08-04", "2012-08-20", "2012-09-28", "2012-10-28", "2012-11-04", "2012-11-16", "2012-11-17", "2012-12-01", "2013-01-10", "2013-02-23", "2013-04-05",
)
#: Mounting of the sensor: roll, pitch and yaw in degrees, translation.
NCLT_MOUNT = ((0.807, 0.166, -90.703), (0.002, -0.004, -0.957))

Pose = tuple[tuple[float, float, float, float], tuple[float, float, float]]
IDENTITY: Pose = ((0.0, 0.0, 0.0, 1.0), (0.0, 0.0, 0.0))


def _of_matrix(given: tuple) -> Pose:
    return tuple(R.quaternion(np.array(given[0]).reshape(3, 3))), given[1]


def _unit(given: Pose) -> Pose:
    size = math.sqrt(sum(v * v for v in given[0]))
    return tuple(v / size for v in given[0]), given[1]


def _of_angles(given: tuple) -> Pose:
    turn = [R.rotation(np.radians(angle) * axis) for angle, axis in zip(given[0], np.eye(3), strict=True)]
    return tuple(R.quaternion(turn[2] @ turn[1] @ turn[0])), given[1]


def _kitti(name: str) -> Pose:
    n = int(name)
    return _of_matrix(_KITTI_A if n <= 2 else _KITTI_B if n == 3 else _KITTI_C)


@dataclass(frozen=True)
class Kind:
    """A data set: names of its sequences, calibration by name, where frames and poses are in a sequence, when the poses' times begin (None: as read)."""

    names: tuple[str, ...]
    calibration: Callable[[str], Pose] = lambda name: IDENTITY
    frames: str = "{name}/frames"
    poses: str = "{name}/{name}.txt"
    form: str = "matrix"
    offset: float | None = 0.0
    period: float = 0.1
    sizes: dict[str, int] | None = None


_two = tuple(f"{i:02d}" for i in range(22))
KINDS: dict[str, Kind] = {
    "KITTI": Kind(_two, _kitti, offset=0.5, sizes=dict(zip(_two, KITTI_FRAMES, strict=True))),
    "KITTI_raw": Kind(_two[:11], _kitti, offset=0.5, sizes=dict(zip(_two, KITTI_FRAMES, strict=False))),
    "KITTI_360": Kind(tuple(KITTI_360_FRAMES), lambda name: _of_matrix(_KITTI_360), offset=0.5, sizes=KITTI_360_FRAMES),
    "KITTI_CARLA": Kind(tuple(f"Town{i:02d}" for i in range(1, 8)), poses="{name}/poses_gt.txt"),
    "HILTI_2021": Kind(_two[:12], lambda name: _unit(HILTI_2021), poses="{name}/{name}.txt", form="spaced", offset=None, sizes=dict(zip(_two, HILTI_FRAMES, strict=False))),
    "HILTI_2022": Kind(_two[:12], lambda name: _unit(HILTI_2022), poses="{name}/{name}.txt", form="spaced", offset=None),
    "NCLT": Kind(NCLT_DAYS, lambda name: _of_angles(NCLT_MOUNT), frames="{name}_vel/velodyne_hits.bin", poses="{name}/groundtruth_{name}.csv", form="angles", offset=None),
    "PLY_DIRECTORY": Kind(("frames",), frames="frames", poses="", offset=None),
}


def _listed(spark: SparkSession, path: str) -> set[str]:
    """Names in a folder; none if it isn't there."""
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    store = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return {x.getPath().getName() for x in store.listStatus(at)} if store.exists(at) else set()


def catalogue(spark: SparkSession, root: str, kind: str, only: tuple[str, ...] = (), start_frame: int = 0, max_frames: int = 0) -> DataFrame:
    """seq, kind, name, frames_path, poses_path (null without ground truth), size (null if unknown), start_frame and max_frames of each sequence under root.

    A sequence is there if the first part of its frames' path is. only: names to keep.
    """
    k, root, rows = KINDS[kind], root.rstrip("/"), []
    there = _listed(spark, root)
    for i, name in enumerate(k.names):
        frames, poses = k.frames.format(name=name), k.poses.format(name=name)
        if frames.split("/")[0] not in there or (only and name not in only):
            continue
        folder, _, file = poses.rpartition("/")
        truth = f"{root}/{poses}" if poses and file in _listed(spark, f"{root}/{folder}") else None
        rows.append((i, kind, name, f"{root}/{frames}", truth, (k.sizes or {}).get(name), start_frame, max_frames or None))
    return spark.createDataFrame(rows, "seq long, kind string, name string, frames_path string, poses_path string, size long, start_frame long, max_frames long")


def concatenated(*catalogues: DataFrame) -> DataFrame:
    """Catalogues of several data sets as one, with new numbers."""
    rows = [r.asDict() | {"seq": i} for i, r in enumerate(r for c in catalogues for r in c.collect())]
    return catalogues[0].sparkSession.createDataFrame(rows, catalogues[0].schema)


def with_truth(listed: DataFrame) -> DataFrame:
    """The sequences that have ground truth."""
    return listed.filter("poses_path is not null")


def sequence(listed: DataFrame, name: str):
    """The row of a sequence; an unknown name raises."""
    found = listed.filter(F.col("name") == name).collect()
    if len(found) != 1:
        raise KeyError(name)
    return found[0]


def conjugated(poses: DataFrame, calibration: Pose) -> DataFrame:
    """poses C^-1 P C, as seen by a sensor whose place in the poses' frame is C."""
    c = tuple(tuple(F.lit(v) for v in part) for part in calibration)
    half = poses.withColumns(dict(zip([f"__{n}" for n in ("qx", "qy", "qz", "qw", "x", "y", "z")], sum(A.compose(A.inverse(c), T.pose()), ()), strict=True)))
    q, v = A.compose(T.pose("__"), c)
    return half.select(*[n for n in poses.columns if n not in T.POSE], *[x.alias(n) for n, x in zip(("qx", "qy", "qz", "qw", "x", "y", "z"), (*q, *v), strict=True)])


def ground_truth(spark: SparkSession, row) -> DataFrame:
    """seq, pose_id, frame_id, t and pose of a catalogue row's sequence, in the sensor's frame."""
    k = KINDS[row.kind]
    if row.poses_path is None:
        return spark.createDataFrame([], "seq long, pose_id long, frame_id long, t double, qx double, qy double, qz double, qw double, x double, y double, z double")
    if k.form == "matrix":
        poses = files.read_matrix_poses(spark, row.poses_path, k.period)
    else:
        poses = (files.read_spaced_poses if k.form == "spaced" else files.read_angle_poses)(spark, row.poses_path).withColumn("pose_id", F.monotonically_increasing_id())
    if k.form == "angles":
        poses = files.rebased(poses.withColumn("__one", F.lit(0)), ["__one"], ["t"]).drop("__one")
    poses = conjugated(poses, k.calibration(row.name))
    t = (F.col("pose_id") + k.offset) * k.period if k.offset is not None else F.col("t")
    return poses.select(F.lit(row.seq).cast("long").alias("seq"), F.col("pose_id").cast("long").alias("pose_id"), F.col("pose_id").cast("long").alias("frame_id"), t.alias("t"), *[F.col(n) for n in ("qx", "qy", "qz", "qw", "x", "y", "z")])


def frames(spark: SparkSession, row, packets: int = 220) -> DataFrame:
    """seq, frame_id, point_id, t, x, y, z of a catalogue row's sequence; frames before start_frame and beyond max_frames aren't kept."""
    points = files.read_hits(spark, row.frames_path, packets) if row.kind == "NCLT" else files.read_ply_files(spark, row.frames_path)
    if "t" not in points.columns:
        points = points.withColumnRenamed("timestamp", "t") if "timestamp" in points.columns else points.withColumn("t", F.lit(None).cast("double"))
    out = points.select(F.lit(row.seq).cast("long").alias("seq"), F.col("frame_id").cast("long").alias("frame_id"), "point_id", F.col("t").cast("double").alias("t"), *[F.col(a).cast("double").alias(a) for a in "xyz"])
    return frame_range(out, row.start_frame, row.max_frames)


def frame_range(points: DataFrame, start_frame: int = 0, max_frames: int | None = None) -> DataFrame:
    """Points of max_frames frames from start_frame on; frames are numbered without a gap."""
    out = points.filter(F.col("frame_id") >= start_frame)
    return out if max_frames is None else out.filter(F.col("frame_id") < start_frame + max_frames)


def with_end_poses(points: DataFrame, truth: DataFrame) -> DataFrame:
    """seq, frame_id, t_min, t_max of each frame with its true begin (b_) and end (e_) pose, interpolated at these times."""
    ends = M.extent(points, ["seq", "frame_id"])
    asked = ends.select("seq", "frame_id", F.explode(F.array(F.struct(F.lit("b_").alias("end"), F.col("t_min").alias("t")), F.struct(F.lit("e_").alias("end"), F.col("t_max").alias("t")))).alias("a"))
    asked = asked.select("seq", "frame_id", "a.end", "a.t", F.col("frame_id").alias("pose_id"))
    at = T.interpolated(T.bracket(truth.select("seq", "t", "pose_id", *T.POSE), asked).filter("lo is not null"), "i_")
    names = ("qx", "qy", "qz", "qw", "x", "y", "z")
    side = lambda end: at.filter(F.col("end") == end).select("seq", "frame_id", *[F.col(f"i_{n}").alias(f"{end}{n}") for n in names])
    return ends.join(side("b_"), ["seq", "frame_id"]).join(side("e_"), ["seq", "frame_id"])
