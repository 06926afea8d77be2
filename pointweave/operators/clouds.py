"""Point-cloud operators: voxels, sampling, neighbours, maps, shape. Clouds have columns x, y, z and a unique order."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import algebra as A

AXES = ("x", "y", "z")
#: Lower bound of the range, voxel size; the last bound ends the cloud.
BANDS = ((0.5, 0.1), (2.0, 0.2), (4.0, 0.4), (8.0, 0.8), (16.0, 1.6))
FAR = 200.0


def voxel(size: float | Column, prefix: str = "v") -> list[Column]:
    """Voxel coordinates, truncated toward zero: the voxels at 0 are twice as wide."""
    return [(F.col(a) / size).cast("int").alias(f"{prefix}{a}") for a in AXES]


def with_voxel(points: DataFrame, size: float | Column) -> DataFrame:
    return points.select("*", *voxel(size))


def first_in_groups(points: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return points.withColumn("__rank", rank).filter(F.col("__rank") <= k).drop("__rank")


def grid_sample(points: DataFrame, size: float, order: list, k: int = 1, cap: int | None = None) -> DataFrame:
    """The first k points of each voxel in the given order; at most cap of all, in that order."""
    out = first_in_groups(with_voxel(points, size), ["vx", "vy", "vz"], order, k)
    return out if cap is None else out.orderBy(*order).limit(cap)


def sub_sample(points: DataFrame, size: float, order: list | None = None, seed: int = 0, point_id: str = "point_id") -> DataFrame:
    """One point of each voxel (voxels are 16-bit numbers): the first one in the given order, or in the order of a hash of the id."""
    short = points.select("*", *[c.cast("short").alias(n) for c, n in zip(voxel(size), ("vx", "vy", "vz"), strict=True)])
    return first_in_groups(short, ["vx", "vy", "vz"], order or [F.xxhash64(point_id, F.lit(seed)), point_id], 1)


def random_cap(points: DataFrame, n: int, seed: int = 0, point_id: str = "point_id") -> DataFrame:
    """At most n points, drawn by a hash of the id: the same ones whatever the partitions."""
    return points.orderBy(F.xxhash64(point_id, F.lit(seed)), point_id).limit(n)


def adaptive_sample(points: DataFrame, order: list, k: int = 1) -> DataFrame:
    """grid_sample with a voxel size that grows with the range; points nearer or farther than all bands go."""
    r = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    size = reduce(lambda c, b: c.when(F.col("range") >= b[0], b[1]), reversed(BANDS), F.when(F.lit(False), F.lit(0.0)))
    ranged = points.withColumn("range", r).filter((F.col("range") >= BANDS[0][0]) & (F.col("range") < FAR)).withColumn("size", size)
    return first_in_groups(with_voxel(ranged, F.col("size")), ["size", "vx", "vy", "vz"], order, k)


def neighbours(queries: DataFrame, points: DataFrame, radius: float | Column, size: float, reach: int, query_id: str = "query_id", point_id: str = "point_id") -> DataFrame:
    """Pairs within radius by an equi-join on voxels: each query asks the voxels up to `reach` around its own.

    With reach * size >= radius no neighbour is missed. A query asks (2 * reach + 1)**3 voxels,
    whatever the number of points.
    """
    around = F.explode(F.sequence(F.lit(-reach), F.lit(reach)))
    q = queries.select(F.col(query_id).alias("query_id"), *[F.col(a).alias(f"q{a}") for a in AXES], *voxel(size, "o"), F.lit(radius).alias("radius") if not isinstance(radius, Column) else radius.alias("radius"))
    for a in AXES:
        q = q.withColumn("__d", around).withColumn(f"v{a}", F.col(f"o{a}") + F.col("__d")).drop("__d", f"o{a}")
    p = with_voxel(points.select(F.col(point_id).alias("point_id"), *AXES), size)
    square = sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in AXES), F.lit(0.0))
    return q.join(p, ["vx", "vy", "vz"]).withColumn("square", square).filter(F.col("square") <= F.col("radius") * F.col("radius"))


def nearest(pairs: DataFrame, k: int) -> DataFrame:
    """The k nearest of each query, with their rank from 1."""
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("square", "point_id"))
    return pairs.withColumn("rank", rank).filter(F.col("rank") <= k)


@dataclass(frozen=True)
class Tree:
    """Leaves that hold about as many points each, by cuts at the median of the widest axis. Nodes are numbered as in a heap from 1, leaves are its last level."""

    depth: int
    axis: np.ndarray
    cut: np.ndarray
    low: np.ndarray
    high: np.ndarray

    @staticmethod
    def over(p: np.ndarray, depth: int) -> Tree:
        n = 2 << depth
        t = Tree(depth, np.zeros(n, int), np.full(n, np.inf), np.full((n, 3), -np.inf), np.full((n, 3), np.inf))
        own = {1: p}
        for node in range(1, 1 << depth):
            q = own.pop(node)
            if len(q):
                t.axis[node] = np.ptp(q, axis=0).argmax()
                t.cut[node] = np.median(q[:, t.axis[node]])
            axis, right = t.axis[node], q[:, t.axis[node]] >= t.cut[node]
            for side, child in enumerate((2 * node, 2 * node + 1)):
                t.low[child], t.high[child], own[child] = t.low[node], t.high[node], q[right == side]
                (t.low if side else t.high)[child, axis] = t.cut[node]
        return t

    def home(self, p: np.ndarray) -> np.ndarray:
        node = np.ones(len(p), int)
        for _ in range(self.depth):
            node = 2 * node + (p[np.arange(len(p)), self.axis[node]] >= self.cut[node])
        return node

    def reached(self, p: np.ndarray, square: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of p and leaf, of all leaves within a squared distance. Sums are in the order of those of points, so rounding loses none."""
        row, node = np.arange(len(p)), np.ones(len(p), int)
        for _ in range(self.depth):
            row, node = np.repeat(row, 2), (2 * node[:, None] + [0, 1]).ravel()
            gap = np.maximum(np.maximum(self.low[node] - p[row], p[row] - self.high[node]), 0)
            stay = gap[:, 0] * gap[:, 0] + gap[:, 1] * gap[:, 1] + gap[:, 2] * gap[:, 2] <= square[row]
            row, node = row[stay], node[stay]
        return row, node


#: Points of a leaf, rows a leaf has among those that cuts are taken from, most levels of the tree.
_LEAF, _SEEN, _DEEPEST = 2048, 32, 15


def _closest(q: np.ndarray, p: np.ndarray, k: int, bound: np.ndarray, strict: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row of q, row of p and squared distance of the k nearest within bound, of equally near ones the first in p, for some rows of q at a time."""
    many = max(1, (1 << 20) // max(1, len(p)))
    for at in range(0, len(q) if len(p) else 0, many):
        d = [q[at : at + many, i, None] - p[None, :, i] for i in range(3)]
        square, limit = d[0] * d[0] + d[1] * d[1] + d[2] * d[2], bound[at : at + many, None]
        near = square < limit if strict else square <= limit
        if len(p) > k:
            near &= square <= np.partition(square, k - 1, axis=1)[:, k - 1 : k]
        row, col = np.nonzero(near)
        order = np.lexsort((col, square[row, col], row))
        row, col = row[order], col[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        row, col = row[place < k], col[place < k]
        yield row + at, col, square[row, col]


def nearest_within(queries: DataFrame, points: DataFrame, k: int, square: float, strict: bool = False, query_id: str = "query_id", point_id: str = "point_id") -> DataFrame:
    """query_id, point_id, square and rank of the k nearest points of each query up to a squared distance (strict: below it), by square and point_id.

    Pairs within the distance are never listed: their number grows with the square of the density.
    Space is cut into leaves of about 2048 points. A query looks into the leaf it is in, then into
    those that its k-th distance reaches beyond it, and the best of all leaves are its neighbours.
    Of points at one place only the first k count. Cuts are medians of points picked by a hash;
    results don't depend on them.
    """
    spark = points.sparkSession
    finite = " and ".join(f"abs({a}) < double('infinity')" for a in AXES)
    p = first_in_groups(points.select(F.col(point_id).alias("point_id"), *[F.col(a).cast("double").alias(a) for a in AXES]).filter(finite), list(AXES), ["point_id"], k)
    q = queries.select(F.col(query_id).alias("query_id"), *[F.col(a).cast("double").alias(a) for a in AXES]).filter(finite)
    n = points.filter(finite).count()
    depth = min(_DEEPEST, max(0, int(np.ceil(np.log2(max(1, n) / _LEAF)))))
    share = max(1, (n >> depth) // _SEEN)
    seen = points.select(*[F.col(a).cast("double").alias(a) for a in AXES]).filter(finite).filter(F.pmod(F.xxhash64(*AXES), F.lit(share)) == 0).distinct().toArrow() if depth else None
    tree = spark.sparkContext.broadcast(Tree.over(np.stack([seen[a].to_numpy() for a in AXES], 1) if depth else np.zeros((0, 3)), depth))
    place = lambda t: np.stack([t[a].to_numpy(zero_copy_only=False) for a in AXES], 1)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(tree.value.home(place(b)).astype(np.int32))], names=[*b.schema.names, "leaf"])

    kinds = dict(p.dtypes) | dict(q.dtypes)
    xyz = "x double, y double, z double"
    own = p.mapInArrow(dealt, f"point_id {kinds['point_id']}, {xyz}, leaf int").groupBy("leaf")
    found = f"query_id {kinds['query_id']}, point_id {kinds['point_id']}, square double, {xyz}, bound double, leaf int"

    def search(asked: pa.Table, there: pa.Table, first: bool) -> pa.Table:
        """Rows with point_id are neighbours; those without ask a further leaf."""
        there = there.sort_by("point_id")
        at = place(asked)
        bound = np.full(len(at), square) if first else asked["bound"].to_numpy()
        parts = list(_closest(at, place(there), k, bound, strict))
        r, c, s = (np.concatenate([x[i] for x in parts]) if parts else np.zeros(0, float if i == 2 else int) for i in range(3))
        hits = {"query_id": asked["query_id"].take(pa.array(r)), "point_id": there["point_id"].take(pa.array(c)), "square": pa.array(s)}
        if not first:
            return pa.table(hits)
        n = np.bincount(r, minlength=len(at))
        last = np.full(len(at), square)
        last[n == k] = s[np.cumsum(n)[n == k] - 1]
        far, leaf = tree.value.reached(at, last)
        away = leaf != tree.value.home(at)[far]
        far, leaf = far[away], leaf[away]
        none = lambda n, kind: pa.nulls(n, kind)
        near = [*hits.values(), *[none(len(r), pa.float64())] * 4, none(len(r), pa.int32())]
        more = [asked["query_id"].take(pa.array(far)), none(len(far), there["point_id"].type), none(len(far), pa.float64()), *[pa.array(x) for x in at[far].T.copy()], pa.array(last[far]), pa.array(leaf.astype(np.int32))]
        return pa.concat_tables([pa.table(x, names=["query_id", "point_id", "square", *AXES, "bound", "leaf"]) for x in (near, more)])

    asked = q.mapInArrow(dealt, f"query_id {kinds['query_id']}, {xyz}, leaf int").groupBy("leaf")
    once = asked.cogroup(own).applyInArrow(lambda a, b: search(a, b, True), found)
    twice = once.filter("leaf is not null").groupBy("leaf").cogroup(own).applyInArrow(lambda a, b: search(a, b, False), f"query_id {kinds['query_id']}, point_id {kinds['point_id']}, square double")
    return nearest(once.filter("leaf is null").select("query_id", "point_id", "square").unionByName(twice), k)


def level_for(radius: Column, resolutions: tuple[float, ...]) -> Column:
    """Index of the coarsest level not coarser than the radius, else of the finest."""
    ordered = sorted(enumerate(resolutions), key=lambda x: x[1])
    return reduce(lambda c, x: F.when(radius >= x[1], F.lit(x[0])).otherwise(c), ordered, F.lit(ordered[0][0]))


def nearest_squared(queries: DataFrame, points: DataFrame, k: int, radius: float, **ids: str) -> DataFrame:
    """The k nearest points of each query whose squared distance is under `radius`."""
    return nearest_within(queries, points, k, radius, True, **ids)


@dataclass(frozen=True)
class Level:
    """One resolution of a map: size of its voxels, least distance of the points of a voxel, points a voxel holds at most."""

    size: float
    min_distance: float
    cap: int


#: The usual resolutions.
LEVELS = (Level(0.2, 0.03, 50), Level(0.5, 0.1, 40), Level(1.5, 0.15, 40))
_CELL = ["level", "vx", "vy", "vz"]


def insert(points: DataFrame, levels: tuple[Level, ...] = LEVELS, order: str = "point_id", existing: DataFrame | None = None) -> DataFrame:
    """Cells of a map of several levels: level, vx, vy, vz, place, the order column, x, y, z and the other columns of points.

    In order, a point enters its voxel of each level if that has room and no point within the least
    distance. Points of `existing`, a map of the same columns, are there first. Voxels are read as a
    sorted stream, in which a task holds one Arrow batch and what it has kept of one voxel.
    """
    sizes = F.array(*[F.lit(float(x.size)) for x in levels])
    rows = points.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(len(levels) - 1)))).withColumn("__size", F.get(sizes, F.col("level")))
    rows = rows.select("*", *voxel(F.col("__size"))).drop("__size")
    rest = [c for c in rows.columns if c not in (*_CELL, order, *AXES)]
    rows = rows.select(*_CELL, F.lit(1).alias("place"), order, *AXES, *rest)
    if existing is not None:
        rows = existing.select(*_CELL, F.lit(0).alias("place"), order, *AXES, *rest).unionByName(rows)
    dealt = rows.repartition(*_CELL).sortWithinPartitions(*_CELL, "place", order)
    return dealt.mapInArrow(lambda b: _keep(b, levels), rows.schema)


def _keep(batches: Iterator[pa.RecordBatch], levels: tuple[Level, ...]) -> Iterator[pa.RecordBatch]:
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        t = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        t, cell = _kept(t, levels)
        last = int(cell[-1])  # the last voxel may go on in the next batch
        cut = int(np.searchsorted(cell, last))
        yield from t.slice(0, cut).to_batches()
        held = t.slice(cut)
    if held is not None:
        yield from held.to_batches()


def _kept(t: pa.Table, levels: tuple[Level, ...]) -> tuple[pa.Table, np.ndarray]:
    """Rows that enter, with their place in the voxel, and the number of each row's voxel. In each round every voxel takes its first row that is left."""
    keys = np.stack([t[c].to_numpy() for c in _CELL])
    cell = np.concatenate(([0], np.cumsum((keys[:, 1:] != keys[:, :-1]).any(0))))
    p = np.stack([t[c].to_numpy() for c in AXES], 1)
    least, cap = np.array([x.min_distance**2 for x in levels])[keys[0]], np.array([x.cap for x in levels])[keys[0]]
    place, left, turn = np.full(len(cell), -1), np.arange(len(cell)), 0
    while len(left):
        new = np.concatenate(([True], cell[left][1:] != cell[left][:-1]))
        first = left[new]
        place[first] = turn
        own = first[np.cumsum(new) - 1]
        turn += 1
        left = left[~new & (((p[left] - p[own]) ** 2).sum(1) > least[left]) & (turn < cap[left])]
    stay = np.flatnonzero(place >= 0)
    t = t.take(pa.array(stay))
    return t.set_column(t.schema.get_field_index("place"), t.schema.field("place"), pa.array(place[stay].astype(np.int32))), cell[stay]


def insert_greedy(points: DataFrame, size: float, min_distance: float, cap: int, order: str = "point_id") -> DataFrame:
    """insert() at one level."""
    return insert(points.select(order, *AXES), (Level(size, min_distance, cap),), order).drop("level")


def block_normals(cells: DataFrame, least: int = 5) -> DataFrame:
    """cells with nx, ny, nz, the normal of the plane through all points of their voxel (null in voxels of fewer than `least` points)."""
    shape = shape_features(moments(cells, _CELL, least))
    return cells.join(shape.select(*_CELL, "nx", "ny", "nz"), _CELL, "left")


def oriented(points: DataFrame, sensors: DataFrame, keep: int | None = None) -> DataFrame:
    """points (frame_id, x, y, z, nx, ny, nz) with normals that face the sensor of their frame, and `oriented`.

    sensors: frame_id, sx, sy, sz, where the frame begins. keep: of the last so many frames the
    sensor is known; points of others keep their normal and aren't oriented.
    """
    if keep is not None:
        sensors = sensors.filter(F.col("frame_id") > F.lit(sensors.agg(F.max("frame_id")).first()[0] or 0) - keep)
    out = points.join(sensors, "frame_id", "left")
    known = F.col("sx").isNotNull() & F.col("nx").isNotNull()
    flip = F.when(known, orient(*[tuple(F.col(f"{n}{a}") for a in AXES) if n else tuple(F.col(a) for a in AXES) for n in ("n", "", "s")])).otherwise(F.lit(1))
    turned = out.withColumn("__flip", flip).withColumn("oriented", known)
    return turned.select(*[c for c in points.columns if c not in ("nx", "ny", "nz")], *[(F.col(f"n{a}") * F.col("__flip")).alias(f"n{a}") for a in AXES], "oriented")


def visible(points: DataFrame, view: tuple[float, float, float]) -> DataFrame:
    """Oriented points whose normal faces a place."""
    side = sum(((F.col(a) - v) * F.col(f"n{a}") for a, v in zip(AXES, view, strict=True)), F.lit(0.0))
    return points.filter(F.col("oriented") & (side < 0))


def radius_search(queries: DataFrame, cells: DataFrame, radius: Column, levels: tuple[Level, ...], k: int, least: int = 1, sensor: tuple[float, float, float] | None = None, query_id: str = "query_id", point_id: str = "point_id") -> DataFrame:
    """The k nearest cells of each query within its radius, at the level that goes with the radius; queries with fewer than `least` give none.

    A query asks ceil(radius / size) voxels to each side at its level. With a sensor, points whose
    oriented normal looks away from it, seen from the query, don't count.
    """
    sizes = F.array(*[F.lit(float(x.size)) for x in levels])
    q = queries.select(F.col(query_id).alias("query_id"), *[F.col(a).alias(f"q{a}") for a in AXES], radius.alias("radius"))
    q = q.withColumn("level", level_for(F.col("radius"), tuple(x.size for x in levels))).withColumn("__size", F.get(sizes, F.col("level")))
    q = q.withColumn("__reach", F.ceil(F.col("radius") / F.col("__size")).cast("int"))
    for a in AXES:
        q = q.withColumn("__d", F.explode(F.sequence(-F.col("__reach"), F.col("__reach")))).withColumn(f"v{a}", (F.col(f"q{a}") / F.col("__size")).cast("int") + F.col("__d")).drop("__d")
    square = sum(((F.col(a) - F.col(f"q{a}")) * (F.col(a) - F.col(f"q{a}")) for a in AXES), F.lit(0.0))
    pairs = q.join(cells.withColumnRenamed(point_id, "point_id"), _CELL).withColumn("square", square).filter(F.col("square") <= F.col("radius") * F.col("radius"))
    if sensor is not None:
        side = sum(((F.lit(s) - F.col(f"q{a}")) * F.col(f"n{a}") for a, s in zip(AXES, sensor, strict=True)), F.lit(0.0))
        pairs = pairs.filter(~F.coalesce(F.col("oriented") & (side < 0), F.lit(False)))
    found = nearest(pairs, k)
    if least > 1:
        found = found.withColumn("__n", F.count(F.lit(1)).over(Window.partitionBy("query_id"))).filter(F.col("__n") >= least).drop("__n")
    return found.select("query_id", "point_id", "level", "rank", "square")


def radius_by_distance(least: float, largest: float, range_at: float, exponent: float) -> Column:
    """Search radius of a point by its distance from the sensor: from `least` at the sensor to `largest` from `range_at` on."""
    far = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y") + F.col("z") * F.col("z"))
    share = F.pow(F.least(far, F.lit(float(range_at))) / float(range_at), F.lit(float(exponent)))
    return share * float(largest) + (F.lit(1.0) - share) * float(least)


def lifted(points: DataFrame, above: float = -5.0, degrees: float = 0.205) -> DataFrame:
    """points above a height turned by an angle about their cross product with the vertical, others moved to the origin; none is dropped.

    The axis (y, -x, 0) is level and normal to the point, so by Rodrigues' formula the turned point
    is p cos(a) + (axis x p) sin(a); on the vertical there is no axis and the point stays.
    """
    c, s = float(np.cos(np.radians(degrees))), float(np.sin(np.radians(degrees)))
    level = F.sqrt(F.col("x") * F.col("x") + F.col("y") * F.col("y"))
    flat = points.withColumn("__level", level)
    safe = F.when(F.col("__level") > 0, F.col("__level")).otherwise(F.lit(1.0))
    # axis x p = (-x z, -y z, x x + y y) / level
    turned = {"x": F.col("x") * c - F.col("x") * F.col("z") / safe * s, "y": F.col("y") * c - F.col("y") * F.col("z") / safe * s, "z": F.col("z") * c + F.col("__level") * s}
    return flat.select(*[F.when(F.col("z") <= above, F.lit(0.0)).when(F.col("__level") > 0, turned[n]).otherwise(F.col(n)).alias(n) if n in turned else F.col(n) for n in points.columns])


def evict_by_centre(cells: DataFrame, size: float, at: tuple[float, float, float], distance: float) -> DataFrame:
    """Rows whose voxel's centre is at most `distance` from a place."""
    square = sum((((F.col(f"v{a}") + 0.5) * size - c) * ((F.col(f"v{a}") + 0.5) * size - c) for a, c in zip(AXES, at, strict=True)), F.lit(0.0))
    return cells.filter(square <= distance * distance)


def evict_by_first(cells: DataFrame, at: tuple[float, float, float], distance: float, order: str = "point_id") -> DataFrame:
    """Rows of voxels whose first point is at most `distance` from a place."""
    square = sum(((F.col(a) - c) * (F.col(a) - c) for a, c in zip(AXES, at, strict=True)), F.lit(0.0))
    first = F.first(square).over(Window.partitionBy("vx", "vy", "vz").orderBy(order))
    return cells.withColumn("__first", first).filter(F.col("__first") <= distance * distance).drop("__first")


def moments(points: DataFrame, keys: list[str], least: int = 5) -> DataFrame:
    """n, mean and population covariance of each group of at least `least` points, in one pre-aggregated pass that keeps its digits far from the origin."""
    pairs = [(a, b) for i, a in enumerate(AXES) for b in AXES[i:]]
    out = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), *[F.avg(a).alias(f"m{a}") for a in AXES], *[(F.var_pop(a) if a == b else F.covar_pop(a, b)).alias(f"c{a}{b}") for a, b in pairs])
    return out.filter(F.col("n") >= least)


def shape_features(m: DataFrame) -> DataFrame:
    """moments() with s0 >= s1 >= s2 (eigenvalues of the covariance), planarity, linearity, a2d, det, the line lx, ly, lz (axis of s0) and the normal nx, ny, nz (axis of s2).

    All matrices of an Arrow batch are decomposed at once. An axis has its largest component
    positive. Shares of a covariance of 0 are null.
    """
    names = ["s0", "s1", "s2", "planarity", "linearity", "a2d", "det", *[f"l{a}" for a in AXES], *[f"n{a}" for a in AXES]]

    def decompose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            c = {k: batch.column(f"c{k}").to_numpy() for k in ("xx", "xy", "xz", "yy", "yz", "zz")}
            cov = np.stack([np.stack([c["xx"], c["xy"], c["xz"]], 1), np.stack([c["xy"], c["yy"], c["yz"]], 1), np.stack([c["xz"], c["yz"], c["zz"]], 1)], 1)
            value, axis = np.linalg.eigh(cov)
            s2, s1, s0 = value.T
            root = np.sqrt(np.maximum(value, 0))
            with np.errstate(divide="ignore", invalid="ignore"):
                shares = [(s1 - s2) / s0, (s0 - s1) / s0, (root[:, 1] - root[:, 0]) / root[:, 2]]
            vectors = []
            for v in (axis[:, :, 2], axis[:, :, 0]):
                big = np.take_along_axis(v, np.abs(v).argmax(1)[:, None], 1)
                vectors += list((v * np.where(big < 0, -1, 1)).T)
            out = [s0, s1, s2, *[pa.array(x, mask=~np.isfinite(x)) for x in shares], value.prod(1), *vectors]
            yield pa.RecordBatch.from_arrays([*batch.columns, *[x if isinstance(x, pa.Array) else pa.array(np.ascontiguousarray(x)) for x in out]], names=[*batch.schema.names, *names])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in m.schema.fields] + [f"{n} double" for n in names]
    return m.mapInArrow(decompose, ", ".join(fields))


def eigenvalues(cov: tuple, m) -> tuple:
    """Eigenvalues of a symmetric 3x3 matrix (xx, xy, xz, yy, yz, zz), largest first, in closed form."""
    xx, xy, xz, yy, yz, zz = cov
    q = (xx + yy + zz) / 3.0
    off = xy * xy + xz * xz + yz * yz
    p2 = (xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + off * 2.0
    p = m.sqrt(p2 / 6.0)
    safe = m.when(p > 0.0, p, 1.0)
    a, b, c, d, e, f = (xx - q) / safe, xy / safe, xz / safe, (yy - q) / safe, yz / safe, (zz - q) / safe
    half = (a * (d * f - e * e) - b * (b * f - c * e) + c * (b * e - c * d)) / 2.0
    third = m.acos(m.when(half < -1.0, -1.0, m.least(half, 1.0))) / 3.0
    one, three = q + p * m.cos(third) * 2.0, q + p * m.cos(third + 2.0943951023931953) * 2.0
    return one, q * 3.0 - one - three, three


def orient(normal: tuple, point: tuple, sensor: tuple) -> Column:
    """-1 where a normal has to be flipped to face the sensor, else 1."""
    side = sum(((p - s) * n for p, s, n in zip(point, sensor, normal, strict=True)), F.lit(0.0))
    return F.when(side > 0, F.lit(-1)).otherwise(F.lit(1))


def normal_equations(rows: DataFrame, u: list[Column], s: Column, keys: list[str] | None = None) -> DataFrame:
    """Sums of u u^T (upper half, a_i_j) and of u s (b_i): one pre-aggregated pass."""
    out = [F.sum(u[i] * u[j]).alias(f"a_{i}_{j}") for i in range(len(u)) for j in range(i, len(u))]
    return rows.groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("n"), *out, *[F.sum(x * s).alias(f"b_{i}") for i, x in enumerate(u)])
