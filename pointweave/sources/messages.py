"""Records of a message transport as tables: packed point clouds, odometry, inertial samples.

The transport itself is not read; its records come as rows of any source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Number of a packed field's type -> numpy type.
FIELD_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 8: "f8"}
#: Extra columns of a point as some drivers give them.
LIDAR_POINT = {"x": "float", "y": "float", "z": "float", "t": "double", "intensity": "float", "laser_id": "int", "device_id": "short", "label": "short"}
#: A packed cloud: fields of name, offset and type, the size of a point, and the bytes of all points.
CLOUD = "frame_id long, sec long, nsec long, point_step int, is_bigendian boolean, fields array<struct<name: string, offset: int, datatype: int>>, data binary"


def stamp(sec: Column | str, nsec: Column | str) -> Column:
    """Seconds of a stamp in two parts."""
    return F.col(sec).cast("double") + F.col(nsec).cast("double") * 1e-9 if isinstance(sec, str) else sec.cast("double") + nsec.cast("double") * 1e-9


def points(clouds: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """frame_id, point_id, stamp and some fields, as doubles, of packed clouds (CLOUD); a field that a cloud doesn't have is null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                order, there = (">" if r["is_bigendian"] else "<"), {f["name"]: f for f in r["fields"]}
                own = [c for c in columns if c in there]
                kind = np.dtype({"names": own, "formats": [order + FIELD_TYPES[there[c]["datatype"]] for c in own], "offsets": [there[c]["offset"] for c in own], "itemsize": r["point_step"]})
                n = len(r["data"]) // r["point_step"] if r["point_step"] else 0
                rows = np.frombuffer(r["data"], kind, n)
                cols = [pa.array(rows[c].astype(np.float64)) if c in own else pa.nulls(n, pa.float64()) for c in columns]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, r["frame_id"])), pa.array(np.arange(n)), pa.array(np.full(n, r["sec"] + r["nsec"] * 1e-9)), *cols], names=["frame_id", "point_id", "stamp", *columns])

    return clouds.select("frame_id", "sec", "nsec", "point_step", "is_bigendian", "fields", "data").mapInArrow(decode, ", ".join(["frame_id long", "point_id long", "stamp double", *[f"{c} double" for c in columns]]))


def packed(cloud: DataFrame, columns: tuple[str, ...] = ("x", "y", "z")) -> DataFrame:
    """CLOUD rows of 32-bit floats, a row a frame, of points (frame_id, point_id, t and the columns). A frame has to fit one task."""
    step = 4 * len(columns)

    def encode(t: pa.Table) -> pa.Table:
        t = t.sort_by("point_id")
        body = np.stack([t[c].to_numpy() for c in columns], 1).astype("<f4").tobytes()
        first = float(np.min(t["t"].to_numpy()))
        layout = [{"name": c, "offset": 4 * i, "datatype": 7} for i, c in enumerate(columns)]
        return pa.table({"frame_id": [t["frame_id"][0].as_py()], "sec": [int(first)], "nsec": [round((first - int(first)) * 1e9)], "point_step": pa.array([step], pa.int32()), "is_bigendian": [False], "fields": pa.array([layout], pa.list_(pa.struct([("name", pa.string()), ("offset", pa.int32()), ("datatype", pa.int32())]))), "data": [body]})

    return cloud.select(F.col("frame_id").cast("long").alias("frame_id"), "point_id", F.col("t").cast("double").alias("t"), *columns).groupBy("frame_id").applyInArrow(encode, CLOUD)


def lidar_points(cloud: DataFrame) -> DataFrame:
    """cloud with the columns and types of LIDAR_POINT; those that it doesn't have are 0."""
    return cloud.select(*[(F.col(c) if c in cloud.columns else F.lit(0)).cast(kind).alias(c) for c, kind in LIDAR_POINT.items()])


def poses(odometry: DataFrame) -> DataFrame:
    """frame_id, t and pose of rows (frame_id, sec, nsec, position struct, orientation struct)."""
    return odometry.select("frame_id", stamp("sec", "nsec").alias("t"), *[F.col(f"orientation.{a}").alias(f"q{a}") for a in "xyzw"], *[F.col(f"position.{a}").alias(a) for a in "xyz"])


def odometry(poses_: DataFrame, source: str, child: str) -> DataFrame:
    """Odometry rows of poses (frame_id, t and the pose): what poses() reads, with the names of the two frames."""
    sec = F.floor("t").cast("long")
    return poses_.select("frame_id", sec.alias("sec"), F.round((F.col("t") - sec) * 1e9).cast("long").alias("nsec"), F.lit(source).alias("source"), F.lit(child).alias("child"), F.struct("x", "y", "z").alias("position"), F.struct(*[F.col(f"q{a}").alias(a) for a in "xyzw"]).alias("orientation"))


def samples(imu: DataFrame) -> DataFrame:
    """t and the columns of an inertial sample of rows (sec, nsec, orientation, angular_velocity, linear_acceleration structs)."""
    return imu.select(stamp("sec", "nsec").alias("timestamp"), *[F.col(f"orientation.{a}").alias(f"q{a}") for a in "xyzw"], *[F.col(f"angular_velocity.{a}").alias(f"w{a}") for a in "xyz"], *[F.col(f"linear_acceleration.{a}").alias(f"a{a}") for a in "xyz"])


def clouds_by_milliseconds(points_: DataFrame) -> DataFrame:
    """points (frame_id, stamp) with `name`, the milliseconds of the frame since the first frame of all, as files of an export are called."""
    first = points_.agg(F.min("stamp").alias("__first"))
    return points_.join(F.broadcast(first)).withColumn("name", F.format_string("%010d", F.round((F.col("stamp") - F.col("__first")) * 1000).cast("long"))).drop("__first")
