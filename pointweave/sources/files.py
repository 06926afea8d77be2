"""Readers and writers of point-cloud and pose files.

Files are read by Spark's own readers (binaryFile, text), so any store that Spark reaches will do,
and decoded on the executors: a file is one row, decoded with numpy in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import algebra as A

# Type names of the PLY format with their numpy and Spark types.
PLY_TYPES = {
    "char": ("i1", "byte"), "int8": ("i1", "byte"), "uchar": ("u1", "short"), "uint8": ("u1", "short"), "short": ("i2", "short"), "int16": ("i2", "short"), "ushort": ("u2", "int"), "uint16": ("u2", "int"),
    "int": ("i4", "int"), "int32": ("i4", "int"), "uint": ("u4", "long"), "uint32": ("u4", "long"), "float": ("f4", "float"), "float32": ("f4", "float"), "double": ("f8", "double"), "float64": ("f8", "double"),
}
_WRITTEN = {"tinyint": "char", "smallint": "short", "int": "int", "float": "float", "double": "double"}
#: Fixed value: the two bytes that a packet of hits begins with, four times.
HITS_MAGIC = 44444


def ply_header(content: bytes) -> tuple[str, list[tuple[str, int, list[tuple[str, str]]]], int]:
    """(format, elements with their count and (name, type) properties, size of the header)."""
    end = content.index(b"end_header") + len(b"end_header")
    end = content.index(b"\n", end) + 1
    kind, elements = "ascii", []
    for line in content[:end].decode("ascii").splitlines():
        word = line.split()
        if word[:1] == ["format"]:
            kind = word[1]
        elif word[:1] == ["element"]:
            elements.append((word[1], int(word[2]), []))
        elif word[:1] == ["property"]:
            if word[1] == "list":
                raise ValueError("list properties are not read")
            elements[-1][2].append((word[2], word[1]))
    return kind, elements, end


def ply_element(content: bytes, element: str) -> np.ndarray:
    """One element of a PLY file as a structured array."""
    kind, elements, at = ply_header(content)
    order = ">" if kind == "binary_big_endian" else "<"
    lines = content[at:].split(b"\n") if kind == "ascii" else []
    for name, count, properties in elements:
        dtype = np.dtype([(p, order + PLY_TYPES[t][0]) for p, t in properties])
        if kind == "ascii":
            rows, lines = lines[:count], lines[count:]
            if name == element:
                return np.array([tuple(float(x) for x in r.split()) for r in rows], dtype)
        else:
            if name == element:
                return np.frombuffer(content, dtype, count, at)
            at += count * dtype.itemsize
    raise ValueError(f"no element {element}")


def read_ply(spark: SparkSession, path: str, element: str = "vertex", columns: list[str] | None = None) -> DataFrame:
    """path, point_id (place in the file) and the element's properties, as the first file's header has them; `columns` prunes."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    head = files.limit(1).select(F.substring("content", 1, 65536).alias("head")).first()
    properties = next(p for n, _, p in ply_header(bytes(head["head"]))[1] if n == element)
    properties = [(n.lower(), n, t) for n, t in properties if columns is None or n.lower() in columns]
    schema = ", ".join(["path string", "point_id long", *[f"`{low}` {PLY_TYPES[t][1]}" for low, _, t in properties]])
    kinds = {"byte": pa.int8(), "short": pa.int16(), "int": pa.int32(), "long": pa.int64(), "float": pa.float32(), "double": pa.float64()}

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                rows = ply_element(content.as_py(), element)
                for s in range(0, len(rows), 65536):
                    part = rows[s : s + 65536]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([name] * len(part)), pa.array(np.arange(s, s + len(part))), *[pa.array(part[n].astype(part[n].dtype.newbyteorder("="))).cast(kinds[PLY_TYPES[t][1]]) for _, n, t in properties]],
                        names=["path", "point_id", *[low for low, _, _ in properties]],
                    )

    return files.mapInArrow(decode, schema)


def to_ply(df: DataFrame, key: str, order: str, columns: list[str], element: str = "vertex") -> DataFrame:
    """key and content: a binary PLY file for each key, its rows by `order`. A key's rows have to fit one task, as a frame does."""
    types = dict(df.dtypes)
    properties = [(c, _WRITTEN[types[c]]) for c in columns]
    dtype = np.dtype([(c, "<" + PLY_TYPES[t][0]) for c, t in properties])

    def encode(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        rows = np.zeros(table.num_rows, dtype)
        for c in columns:
            rows[c] = table[c].to_numpy()
        head = f"ply\nformat binary_little_endian 1.0\nelement {element} {len(rows)}\n" + "".join(f"property {t} {c}\n" for c, t in properties) + "end_header\n"
        return pa.table({key: table[key][:1], "content": [head.encode() + rows.tobytes()]})

    return df.select(*dict.fromkeys([key, order, *columns])).groupBy(key).applyInArrow(encode, f"{key} {types[key]}, content binary")


def read_hits(spark: SparkSession, path: str, packets: int = 220) -> DataFrame:
    """path, frame_id, point_id, t, x, y, z, intensity, laser of packets of hits; `packets` of them make a frame."""
    hit = np.dtype([("x", "<u2"), ("y", "<u2"), ("z", "<u2"), ("intensity", "u1"), ("laser", "u1")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content, at, number, point = value.as_py(), 0, 0, 0
                while at + 24 <= len(content):
                    if np.frombuffer(content, "<u2", 4, at).tolist() != [HITS_MAGIC] * 4:
                        raise ValueError(f"no packet at byte {at} of {name}")
                    n, t = int(np.frombuffer(content, "<u4", 1, at + 8)[0]), int(np.frombuffer(content, "<u8", 1, at + 12)[0])
                    rows = np.frombuffer(content, hit, n, at + 24)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([name] * n), pa.array(np.full(n, number // packets, np.int32)), pa.array(np.arange(point, point + n)), pa.array(np.full(n, float(t))),
                            *[pa.array(rows[a].astype(np.float64) * 0.005 - 100.0) for a in "xyz"], pa.array(rows["intensity"].astype(np.int16)), pa.array(rows["laser"].astype(np.int16)),
                        ],
                        names=["path", "frame_id", "point_id", "t", "x", "y", "z", "intensity", "laser"],
                    )
                    at, number, point = at + 24 + n * hit.itemsize, number + 1, point + n

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, "path string, frame_id int, point_id long, t double, x double, y double, z double, intensity short, laser short")


def quaternion(r: list[Column]) -> tuple[Column, ...]:
    """Unit quaternion (x, y, z, w) of a rotation matrix, row by row; the largest component decides the branch."""
    xx, xy, xz, yx, yy, yz, zx, zy, zz = r
    trace = xx + yy + zz
    cases = (
        (trace > 0, (zy - yz, xz - zx, yx - xy, trace + 1)),
        ((xx >= yy) & (xx >= zz), (xx - yy - zz + 1, xy + yx, xz + zx, zy - yz)),
        (yy >= zz, (xy + yx, yy - xx - zz + 1, yz + zy, xz - zx)),
        (F.lit(True), (xz + zx, yz + zy, zz - xx - yy + 1, yx - xy)),
    )
    raw = []
    for i in range(4):
        c = F.when(cases[0][0], cases[0][1][i])
        for condition, values in cases[1:]:
            c = c.when(condition, values[i])
        raw.append(c)
    return A.normalize(tuple(raw))


def matrix(q: tuple) -> list[Column]:
    """Rotation matrix of a unit quaternion, row by row."""
    one, zero = F.lit(1.0), F.lit(0.0)
    cols = [A.rotate(q, v) for v in ((one, zero, zero), (zero, one, zero), (zero, zero, one))]
    return [cols[j][i] for i in range(3) for j in range(3)]


def read_matrix_poses(spark: SparkSession, path: str, period: float = 0.1) -> DataFrame:
    """path, pose_id (line of the file), t, and the pose of text lines with 12 numbers, a 3x4 matrix row by row."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.posexplode(F.split("value", "\n")).alias("pose_id", "line"))
    n = F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.cast("double"))
    rows = lines.filter(F.trim("line") != "").withColumn("n", n)
    m = [F.col("n")[i] for i in range(12)]
    q = quaternion([m[0], m[1], m[2], m[4], m[5], m[6], m[8], m[9], m[10]])
    return rows.select("path", "pose_id", (F.col("pose_id") * period).alias("t"), *[c.alias(k) for k, c in zip(("qx", "qy", "qz", "qw"), q, strict=True)], m[3].alias("x"), m[7].alias("y"), m[11].alias("z"))


def matrix_pose_lines(poses: DataFrame) -> DataFrame:
    """pose_id and line: the text read_matrix_poses() reads."""
    r = matrix(tuple(F.col(n) for n in ("qx", "qy", "qz", "qw")))
    t = [F.col(n) for n in ("x", "y", "z")]
    return poses.select("pose_id", F.concat_ws(" ", *[c.cast("string") for c in (*r[:3], t[0], *r[3:6], t[1], *r[6:], t[2])]).alias("line"))


def read_spaced_poses(spark: SparkSession, path: str) -> DataFrame:
    """t, x, y, z, qx, qy, qz, qw of lines with these numbers."""
    n = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    return spark.read.text(path).filter("trim(value) <> ''").select(n.alias("n")).select(*[F.col("n")[i].alias(k) for i, k in enumerate(("t", "x", "y", "z", "qx", "qy", "qz", "qw"))])


def read_angle_poses(spark: SparkSession, path: str) -> DataFrame:
    """t, x, y, z and quaternion of CSV lines with roll, pitch and yaw; lines with NaN go."""
    schema = "t double, x double, y double, z double, roll double, pitch double, yaw double"
    rows = spark.read.csv(path, schema).dropna()
    for c in ("x", "y", "z", "roll", "pitch", "yaw"):
        rows = rows.filter(~F.isnan(c))
    half = lambda c, axis: tuple(F.sin(F.col(c) / 2) if i == axis else F.lit(0.0) for i in range(3)) + (F.cos(F.col(c) / 2),)
    q = A.multiply(A.multiply(half("yaw", 2), half("pitch", 1)), half("roll", 0))
    return rows.select("t", "x", "y", "z", *[c.alias(k) for k, c in zip(("qx", "qy", "qz", "qw"), q, strict=True)])


# --- further readers ------------------------------------------------------------------------------
def read_ply_files(spark: SparkSession, path: str, pattern: str = r"(\d+)", element: str = "vertex", columns: list[str] | None = None) -> DataFrame:
    """read_ply() of a folder, with frame_id: the last number in each file's name, by a pattern of one group."""
    rows = read_ply(spark, path, element, columns)
    name = F.element_at(F.split("path", "/"), -1)
    return rows.withColumn("frame_id", F.element_at(F.regexp_extract_all(name, F.lit(pattern), F.lit(1)), -1).cast("long"))


#: Blocks of an inertial record and the properties of each.
_COVARIANCE = tuple(f"c_{i}" for i in range(9))
IMU = {
    "properties": ("timestamp",), "orientation": ("qx", "qy", "qz", "qw"), "angular_velocity": ("wx", "wy", "wz"), "linear_acceleration": ("ax", "ay", "az"),
    "orientation_cov": _COVARIANCE, "angular_velocity_cov": _COVARIANCE, "linear_acceleration_cov": _COVARIANCE,
}
_IMU_COLUMNS = [(block, p, f"{block}_{p}" if block.endswith("_cov") else p) for block, ps in IMU.items() for p in ps]


def read_imu(spark: SparkSession, path: str) -> DataFrame:
    """path, record and the columns of all blocks of inertial PLY files; blocks that a file doesn't have are null."""

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                content = value.as_py()
                there = {e: count for e, count, _ in ply_header(content)[1]}
                n, blocks = there["properties"], {b: ply_element(content, b) for b in IMU if b in there}
                cols = [pa.array(blocks[b][p].astype(np.float64)) if b in blocks else pa.nulls(n, pa.float64()) for b, p, _ in _IMU_COLUMNS]
                yield pa.RecordBatch.from_arrays([pa.array([name] * n), pa.array(np.arange(n)), *cols], names=["path", "record", *[c for _, _, c in _IMU_COLUMNS]])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(decode, ", ".join(["path string", "record long", *[f"{c} double" for _, _, c in _IMU_COLUMNS]]))


_POSE_PLY = (*[(n, "double") for n in ("qx", "qy", "qz", "qw", "x", "y", "z", "ref_t", "dest_t")], ("ref_fid", "int"), ("dest_fid", "int"))


def read_ply_poses(spark: SparkSession, path: str) -> DataFrame:
    """path, pose_id, t, frame_id, ref_t, ref_frame and the pose of the `pose` element of PLY files."""
    rows = read_ply(spark, path, "pose")
    return rows.select("path", F.col("point_id").alias("pose_id"), F.col("dest_t").alias("t"), F.col("dest_fid").alias("frame_id"), "ref_t", F.col("ref_fid").alias("ref_frame"), "x", "y", "z", "qx", "qy", "qz", "qw")


def rebased(poses: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """poses as seen from the first one of their group."""
    names = ("qx", "qy", "qz", "qw", "x", "y", "z")
    w = Window.partitionBy(*keys).orderBy(*order)
    first = poses.withColumns({f"__{n}": F.first(n).over(w) for n in names})
    get = lambda pre: (tuple(F.col(pre + n) for n in names[:4]), tuple(F.col(pre + n) for n in names[4:]))
    q, v = A.relative(get("__"), get(""))
    return first.select(*[c for c in poses.columns if c not in names], *[c.alias(n) for n, c in zip(names, (*q, *v), strict=True)])


_FRAME = ("frame_id", "t", "ref_frame", "ref_t", "qx", "qy", "qz", "qw", "x", "y", "z")


def read_trajectory_frames(spark: SparkSession, path: str) -> DataFrame:
    """Begin (b_) and end (e_) pose of each line of 22 numbers, each with frame_id, t, ref_frame and ref_t before it; empty lines go."""
    n = F.transform(F.split(F.trim("value"), r"\s+"), lambda x: x.cast("double"))
    rows = spark.read.text(path).filter("trim(value) <> ''").select(n.alias("n"))
    kinds = ("long", "double", "long", "double", *["double"] * 7)
    return rows.select(*[F.col("n")[11 * k + i].cast(kind).alias(f"{pre}{name}") for k, pre in enumerate(("b_", "e_")) for i, (name, kind) in enumerate(zip(_FRAME, kinds, strict=True))])


# --- writers ----------------------------------------------------------------------------------------
def write_files(contents: DataFrame, folder: str, name: str = "name", content: str = "content") -> int:
    """Write each row's content to folder/name through the store's own file system, on the executors; returns the number of files.

    A file is written under a name of its own and renamed, so one that is there is whole, and a task
    that runs again replaces it. Stores other than the local one need a pyarrow file system.
    """
    from pyarrow import fs

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
        store.create_dir(root, recursive=True)
        done = 0
        for batch in batches:
            for file, value in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                body = value.as_py()
                with store.open_output_stream(f"{root}/.{file}.open") as out:
                    out.write(body if isinstance(body, bytes) else body.encode())
                store.move(f"{root}/.{file}.open", f"{root}/{file}")
                done += 1
        yield pa.RecordBatch.from_arrays([pa.array([done], pa.int64())], names=["n"])

    return contents.select(F.col(name).cast("string"), content).mapInArrow(write, "n long").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]


def write_ply(df: DataFrame, folder: str, key: str = "frame_id", order: str = "point_id", columns: list[str] | None = None, name: str = "frame_%06d.ply", element: str = "vertex") -> int:
    """A binary PLY file for each key."""
    columns = columns or [c for c in df.columns if c not in (key, order) and dict(df.dtypes)[c] in _WRITTEN]
    return write_files(to_ply(df, key, order, columns, element).withColumn("name", F.format_string(name, F.col(key))), folder)


def write_ply_poses(poses: DataFrame, folder: str, key: str = "seq", name: str = "poses_%02d.ply") -> int:
    """A PLY file of poses (pose_id, t, frame_id, ref_t, ref_frame and the pose) for each key."""
    renamed = poses.withColumnsRenamed({"t": "dest_t", "frame_id": "dest_fid", "ref_frame": "ref_fid"})
    rows = renamed.select(key, "pose_id", *[F.col(n).cast(kind) for n, kind in _POSE_PLY])
    return write_ply(rows, folder, key, "pose_id", [n for n, _ in _POSE_PLY], name, "pose")


def write_imu(records: DataFrame, folder: str, key: str = "seq", order: str = "record", blocks: tuple[str, ...] = tuple(IMU), name: str = "imu_%02d.ply") -> int:
    """A PLY file of inertial records with some blocks for each key; columns as read_imu() names them."""
    wanted = [(b, p, c) for b, p, c in _IMU_COLUMNS if b in blocks]

    def encode(table: pa.Table) -> pa.Table:
        table, head, body = table.sort_by(order), "ply\nformat binary_little_endian 1.0\n", b""
        for block in blocks:
            own = [(p, c) for b, p, c in wanted if b == block]
            head += f"element {block} {table.num_rows}\n" + "".join(f"property double {p}\n" for p, _ in own)
            body += np.stack([table[c].to_numpy() for _, c in own], 1).astype("<f8").tobytes()
        return pa.table({key: table[key][:1], "content": [(head + "end_header\n").encode() + body]})

    rows = records.select(key, order, *[F.col(c).cast("double") for _, _, c in wanted])
    files = rows.groupBy(key).applyInArrow(encode, f"{key} {dict(records.dtypes)[key]}, content binary")
    return write_files(files.withColumn("name", F.format_string(name, F.col(key))), folder)


def write_lines(lines: DataFrame, folder: str, key: str, order: str, name: str) -> int:
    """A text file for each key, of its lines (column `line`) in order. A key's lines have to fit one task."""

    def join(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        return pa.table({key: table[key][:1], "content": [("\n".join(table["line"].to_pylist()) + "\n").encode()]})

    files = lines.select(key, order, "line").groupBy(key).applyInArrow(join, f"{key} {dict(lines.dtypes)[key]}, content binary")
    return write_files(files.withColumn("name", F.format_string(name, F.col(key))), folder)


def write_matrix_poses(poses: DataFrame, folder: str, key: str = "seq", name: str = "%02d.txt") -> int:
    """A file of 3x4 matrices, a pose a line by pose_id, for each key; read_matrix_poses() reads it."""
    r = matrix(tuple(F.col(n) for n in ("qx", "qy", "qz", "qw")))
    t = [F.col(n) for n in ("x", "y", "z")]
    line = F.concat_ws(" ", *[c.cast("string") for c in (*r[:3], t[0], *r[3:6], t[1], *r[6:], t[2])])
    return write_lines(poses.select(key, "pose_id", line.alias("line")), folder, key, "pose_id", name)


def write_trajectory_frames(frames: DataFrame, folder: str, key: str = "seq", name: str = "trajectory_%02d.txt") -> int:
    """A file of begin and end poses, a frame a line by the end's frame, for each key; read_trajectory_frames() reads it."""
    line = F.concat_ws(" ", *[F.col(f"{pre}{n}").cast("string") for pre in ("b_", "e_") for n in _FRAME])
    return write_lines(frames.select(key, F.col("e_frame_id").alias("__order"), line.alias("line")), folder, key, "__order", name)
