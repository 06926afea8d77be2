"""Shapes of point tables: the canonical form, guarded columns, positional joins, time units.

A cloud in canonical form has point_id, frame_id, t, raw x, y, z and world wx, wy, wz, whatever names
its source used. Columns beyond these stay.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

XYZ = ("x", "y", "z")
#: Names that sources use, first match first, for each canonical column and its type.
KNOWN: dict[str, tuple[str, tuple[str, ...]]] = {
    "point_id": ("long", ("point_id", "index", "id")), "frame_id": ("long", ("frame_id", "index_frame", "frame", "fid")), "t": ("double", ("t", "timestamp", "time", "alpha_timestamp")),
    "x": ("double", ("x", "raw_x", "px")), "y": ("double", ("y", "raw_y", "py")), "z": ("double", ("z", "raw_z", "pz")),
    "wx": ("double", ("wx", "world_x", "w_x")), "wy": ("double", ("wy", "world_y", "w_y")), "wz": ("double", ("wz", "world_z", "w_z")),
    "nx": ("double", ("nx", "normal_x")), "ny": ("double", ("ny", "normal_y")), "nz": ("double", ("nz", "normal_z")),
}
#: Seconds of a unit.
UNITS = {"s": 1.0, "ms": 1e-3, "us": 1e-6, "ns": 1e-9}


def fields(df: DataFrame) -> dict[str, str]:
    """Canonical column -> the column of df that has it."""
    low = {c.lower(): c for c in df.columns}
    return {k: low[n] for k, (_, names) in KNOWN.items() for n in [next((n for n in names if n in low), None)] if n}


def mapped(df: DataFrame, columns: dict[str, tuple[str, str]]) -> DataFrame:
    """New names and types: {name: (column of df, type)}; no other column is read."""
    return df.select(*[F.col(c).cast(kind).alias(name) for name, (c, kind) in columns.items()])


def canonical(df: DataFrame, frame_id: int | Column = 0) -> DataFrame:
    """df in canonical form. Without coordinates it raises; absent times are null, an absent frame is `frame_id`, absent world coordinates are the raw ones."""
    found = fields(df)
    if not all(a in found for a in XYZ):
        raise ValueError(f"no x, y and z among {df.columns}")
    out = {k: F.col(found[k]).cast(KNOWN[k][0]) if k in found else None for k in ("point_id", "frame_id", "t", *XYZ, "wx", "wy", "wz")}
    out["frame_id"] = out["frame_id"] if out["frame_id"] is not None else (frame_id if isinstance(frame_id, Column) else F.lit(frame_id)).cast("long")
    out["t"] = out["t"] if out["t"] is not None else F.lit(None).cast("double")
    out["point_id"] = out["point_id"] if out["point_id"] is not None else F.monotonically_increasing_id()
    for a in XYZ:
        out[f"w{a}"] = out[f"w{a}"] if out[f"w{a}"] is not None else out[a]
    rest = [c for c in df.columns if c not in found.values()]
    return df.select(*[v.alias(k) for k, v in out.items()], *rest)


def added(df: DataFrame, name: str, value: Column | float = 0.0, kind: str | None = None) -> DataFrame:
    """df with a new column; a name that is there already raises."""
    if name in df.columns:
        raise ValueError(f"column {name} exists")
    value = value if isinstance(value, Column) else F.lit(value)
    return df.withColumn(name, value.cast(kind) if kind else value)


def with_struct(df: DataFrame, name: str, columns: list[str]) -> DataFrame:
    """df with some columns as one structured column in their place."""
    return df.select(*[c for c in df.columns if c not in columns], F.struct(*columns).alias(name))


def removed(df: DataFrame, *columns: str) -> DataFrame:
    """df without columns; the coordinates can't go."""
    held = {fields(df).get(a) for a in XYZ} & set(columns)
    if held:
        raise ValueError(f"coordinates stay: {sorted(held)}")
    return df.drop(*columns)


def with_xyz(df: DataFrame, x: str, y: str, z: str) -> DataFrame:
    """df with other columns as its coordinates; the former ones are kept as old_x, old_y, old_z."""
    out = df.withColumnsRenamed({a: f"old_{a}" for a in XYZ if a in df.columns and a not in (x, y, z)})
    return out.withColumnsRenamed(dict(zip((x, y, z), XYZ, strict=True)))


def beside(left: DataFrame, right: DataFrame, key: str = "point_id") -> DataFrame:
    """The rows of two tables of equal keys side by side."""
    return left.join(right, key)


def same_schema(a: DataFrame, b: DataFrame) -> bool:
    """Whether names and types agree, in order."""
    return [(f.name, f.dataType) for f in a.schema.fields] == [(f.name, f.dataType) for f in b.schema.fields]


def typed_empty(spark, schema: StructType | str) -> DataFrame:
    return spark.createDataFrame([], schema)


def seconds(t: Column | str, unit: str) -> Column:
    """Times of a unit in seconds; `auto` takes it from the size of the number (an epoch in s, ms, us or ns)."""
    t = F.col(t) if isinstance(t, str) else t
    if unit != "auto":
        return t * UNITS[unit]
    size = F.abs(t)
    return F.when(size < 1e11, t).when(size < 1e14, t * 1e-3).when(size < 1e17, t * 1e-6).otherwise(t * 1e-9)


def selected(df: DataFrame, ids: list[int], key: str = "point_id") -> DataFrame:
    """Rows by a list of ids, as often and in the order (column `place`) as the list has them. The list goes with the plan, so it is one that a driver holds."""
    places = F.explode(F.transform(F.sequence(F.lit(0), F.lit(len(ids) - 1)), lambda i: F.struct(i.alias("place"), F.element_at(F.array(*[F.lit(int(v)) for v in ids]), i + 1).alias(key))))
    wanted = df.sparkSession.range(1).select(places.alias("s")).select("s.*") if ids else df.sparkSession.createDataFrame([], f"place int, {key} long")
    return wanted.withColumn(key, F.col(key).cast("long")).join(df, key)


def has_frame(df: DataFrame, keys: list[str], frame_id: int) -> DataFrame:
    """keys and whether any row of the group is of a frame."""
    return df.groupBy(*keys).agg(F.bool_or(F.col("frame_id") == frame_id).alias("has_frame"))


def in_order(poses: DataFrame) -> DataFrame:
    """seq, n, and of poses in order of frame and time: one_reference (all have one ref_frame), late, the number of those whose time is before that of the pose ahead."""
    w = Window.partitionBy("seq").orderBy("frame_id", "t", "pose_id")
    seen = poses.withColumn("__late", F.coalesce(F.col("t") < F.lag("t").over(w), F.lit(False)))
    return seen.groupBy("seq").agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("ref_frame") <= 1).alias("one_reference"), F.count_if("__late").alias("late"))


def apply_each(df: DataFrame, *steps: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """df after filters of one's own, in turn."""
    for f in steps:
        df = df.transform(f)
    return df
