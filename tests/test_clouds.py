"""Cloud operators against brute force."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointweave.functions import schema as H
from pointweave.operators import clouds as C
from pointweave.operators import registration as R

LEVELS = (C.Level(0.5, 0.05, 4), C.Level(1.0, 0.3, 6))


def cloud(n, seed=0, spread=1.0):
    rng = np.random.default_rng(seed)
    return pd.DataFrame({"point_id": np.arange(n), "frame_id": np.arange(n) % 5, **dict(zip("xyz", rng.uniform(-spread, spread, (3, n)), strict=True))})


def brute_map(p, levels):
    cells = {}
    for r in p.itertuples():
        for k, o in enumerate(levels):
            at = np.array([r.x, r.y, r.z])
            cell = cells.setdefault((k, *np.trunc(at / o.size).astype(int)), [])
            if len(cell) < o.cap and all(((at - q) ** 2).sum() > o.min_distance**2 for _, q in cell):
                cell.append((r.point_id, at))
    return {(*k, i) for k, cell in cells.items() for i, _ in cell}


def test_map_of_levels(spark):
    p = cloud(600)
    old = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)  # voxels reach over batches
    try:
        got = C.insert(spark.createDataFrame(p), LEVELS).collect()
        first = C.insert(spark.createDataFrame(p[:300]), LEVELS)
        later = C.insert(spark.createDataFrame(p[300:]), LEVELS, existing=first).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", old)
    want = brute_map(p, LEVELS)
    for rows in (got, later):
        assert {(r.level, r.vx, r.vy, r.vz, r.point_id) for r in rows} == want and len(rows) == len(want)


def test_numpy_map_is_the_same(spark):
    o = R.Options(voxel=0.5, min_distance=0.05, cap=4)
    cells, p = R.VoxelMap(o), cloud(500, 3)
    for part in np.array_split(p[["x", "y", "z"]].to_numpy(), 4):
        cells.insert(part)
    want = brute_map(p, (C.Level(0.5, 0.05, 4),))
    xyz = {i: tuple(p.loc[i, ["x", "y", "z"]]) for *_, i in want}
    assert len(cells) == len(want) and {tuple(q) for q in cells.cloud()} == set(xyz.values())


def test_radius_search_with_a_sensor(spark):
    p = spark.createDataFrame(cloud(400, 5))
    normals = C.block_normals(C.insert(p, LEVELS))
    sensors = spark.createDataFrame([(f, 3.0, 0.0, 1.0 * f) for f in (0, 1, 2)], "frame_id long, sx double, sy double, sz double")
    cells = C.oriented(normals, sensors)
    rows = cells.toPandas()
    for r in rows.itertuples():
        if r.oriented:
            assert r.frame_id < 3 and (r.x - 3) * r.nx + r.y * r.ny + (r.z - r.frame_id) * r.nz <= 1e-9
    at, sensor = spark.createDataFrame(cloud(40, 6)), (0.5, 2.0, 0.0)
    got = C.radius_search(at, cells, F.lit(0.6), LEVELS, 5, 2, sensor, "point_id").collect()
    want = set()
    for q in cloud(40, 6).itertuples():
        near = []
        for r in rows[rows.level == 0].itertuples():
            d = (r.x - q.x) ** 2 + (r.y - q.y) ** 2 + (r.z - q.z) ** 2
            away = r.oriented and (sensor[0] - q.x) * r.nx + (sensor[1] - q.y) * r.ny + (sensor[2] - q.z) * r.nz < 0
            if d <= 0.36 and not away:
                near.append((d, r.point_id))
        if len(near) >= 2:
            want |= {(q.point_id, i) for _, i in sorted(near)[:5]}
    assert {(r.query_id, r.point_id) for r in got} == want


def test_shape_far_from_the_origin(spark):
    rng = np.random.default_rng(0)
    p = rng.normal(size=(200, 3)) * (1.0, 0.1, 0.01) + 1e7
    df = spark.createDataFrame(pd.DataFrame(p, columns=list("xyz")).assign(k=1))
    got = C.shape_features(C.moments(df, ["k"])).first()
    cov = np.cov(p.T, bias=True)
    assert np.allclose([got.s2, got.s1, got.s0], np.linalg.eigvalsh(cov), rtol=1e-3)
    assert abs(got.nz) > 0.99 and abs(got.lx) > 0.99 and got.linearity > 0.9 and np.isclose(got.det, np.linalg.det(cov), rtol=1e-2)


def test_lifted_points(spark):
    p = spark.createDataFrame([(1, 3.0, 4.0, 1.0), (2, 1.0, 1.0, -5.0), (3, 0.0, 0.0, 2.0)], "point_id long, x double, y double, z double")
    got = {r.point_id: np.array([r.x, r.y, r.z]) for r in C.lifted(p, degrees=10.0).collect()}
    axis = np.cross([3, 4, 1], [0, 0, 1.0])
    assert np.allclose(got[1], R.rotation(np.radians(10) * axis / np.linalg.norm(axis)) @ [3, 4, 1])
    assert (got[2] == 0).all() and (got[3] == [0, 0, 2]).all()


def test_sampling_by_hash_is_alike_everywhere(spark):
    p = spark.createDataFrame(cloud(500))
    a, b = (sorted(r.point_id for r in C.sub_sample(x, 0.5).collect()) for x in (p, p.repartition(7)))
    assert a == b and len(a) == len(np.unique(np.trunc(cloud(500)[["x", "y", "z"]] / 0.5), axis=0))
    assert sorted(r.point_id for r in C.random_cap(p, 20).collect()) == sorted(r.point_id for r in C.random_cap(p.repartition(5), 20).collect())


def test_canonical_tables(spark):
    raw = spark.createDataFrame([(1, 2.0, 3.0, 4.0, 9)], "Timestamp int, X double, y double, z double, extra int")
    row = H.canonical(raw, 5).first()
    assert (row.frame_id, row.t, row.x, row.wx, row.extra) == (5, 1.0, 2.0, 2.0, 9)
    for f in (lambda: H.canonical(raw.drop("z")), lambda: H.removed(raw, "y"), lambda: H.added(raw, "extra")):
        try:
            f()
        except ValueError:
            continue
        raise AssertionError("no error")
    assert H.same_schema(raw, raw.limit(0)) and not H.same_schema(raw, raw.drop("y"))
    assert H.with_struct(raw, "p", ["X", "y", "z"]).first().p.y == 3.0
    assert H.typed_empty(spark, raw.schema).count() == 0 and H.apply_each(raw, lambda d: d.filter("y > 5"), lambda d: d.drop("z")).count() == 0
    stamps = spark.createDataFrame([(1.5e9,), (1.5e12,), (1.5e15,), (1.5e18,)], "t double").select(H.seconds("t", "auto").alias("s")).collect()
    assert all(abs(r.s - 1.5e9) < 1e-3 for r in stamps)


def test_nearest_of_many_leaves(spark, monkeypatch):
    monkeypatch.setattr(C, "_LEAF", 16)
    p = cloud(300)
    p.loc[:99, ["x", "y", "z"]] = p.loc[:99, ["x", "y", "z"]].round(0)  # equal distances and equal places
    q = p.iloc[::3]
    got = C.nearest_within(spark.createDataFrame(q), spark.createDataFrame(p), 3, 0.25, query_id="point_id")
    assert "SortMergeJoin" not in got._jdf.queryExecution().toString()
    at = p[["x", "y", "z"]].to_numpy()
    expected = set()
    for i in q.point_id:
        d = at - at[i]
        square = d[:, 0] * d[:, 0] + d[:, 1] * d[:, 1] + d[:, 2] * d[:, 2]
        expected |= {(i, j, r + 1) for r, j in enumerate([j for j in np.lexsort((p.point_id, square)) if square[j] <= 0.25][:3])}
    assert {(r.query_id, r.point_id, r.rank) for r in got.collect()} == expected


def test_nearest_squared_lists_no_pairs(spark):
    p = spark.createDataFrame(cloud(50))
    assert "Join" not in C.nearest_squared(p, p, 4, 0.02, query_id="point_id")._jdf.queryExecution().toString()


def test_nearest_other_point_lists_no_pairs(spark):
    from pointweave.plans import catalogue

    from .conftest import SF

    assert "Join" not in catalogue.QUERIES["nn1_lines"](spark, SF)._jdf.queryExecution().toString()
