"""Data sets, files, options and streams."""

import dataclasses

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointweave import config
from pointweave.operators import registration as R
from pointweave.operators import scenes as S
from pointweave.operators import solvers as L
from pointweave.operators import trajectories as T
from pointweave.sources import datasets as D
from pointweave.sources import files, messages
from pointweave.streaming import odometry as Live

from .test_geometry import poses


def matrix_of(r):
    m = np.eye(4)
    x, y, z, w = r[["qx", "qy", "qz", "qw"]].to_numpy(float)
    m[:3, :3] = [[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]]
    m[:3, 3] = r[["x", "y", "z"]].to_numpy(float)
    return m


def test_a_folder_of_sequences(spark, tmp_path):
    p = poses(5)
    for name in ("00", "04"):
        files.write_matrix_poses(spark.createDataFrame(p), f"{tmp_path}/{name}", name=f"{name}.txt")
        files.write_ply(spark.createDataFrame(pd.concat([R.box_scan(0, f, 50) for f in range(3)])), f"{tmp_path}/{name}/frames", columns=["x", "y", "z", "t"])
    (tmp_path / "07" / "frames").mkdir(parents=True)
    (tmp_path / "notes").mkdir()
    listed = D.catalogue(spark, str(tmp_path), "KITTI", start_frame=1, max_frames=1)
    assert [(r.name, r["size"]) for r in listed.orderBy("name").collect()] == [("00", 4540), ("04", 270), ("07", 1100)]
    assert [r.name for r in D.with_truth(listed).orderBy("name").collect()] == ["00", "04"]
    assert D.catalogue(spark, str(tmp_path), "KITTI", ("04",)).count() == 1 and D.catalogue(spark, f"{tmp_path}/none", "NCLT").count() == 0
    with pytest.raises(KeyError):
        D.sequence(listed, "21")
    row = D.sequence(listed, "04")
    truth, c = D.ground_truth(spark, row).orderBy("pose_id").toPandas(), np.eye(4)
    q, v = D.KINDS["KITTI"].calibration("04")
    c = matrix_of(pd.Series(dict(zip(("qx", "qy", "qz", "qw", "x", "y", "z"), (*q, *v), strict=True))))
    for i in range(5):
        assert np.allclose(matrix_of(truth.loc[i]), np.linalg.inv(c) @ matrix_of(p.loc[i]) @ c, atol=1e-6)
    assert np.allclose(truth.t, (np.arange(5) + 0.5) * 0.1)
    points = D.frames(spark, row)
    assert {r.frame_id for r in points.select("frame_id").distinct().collect()} == {1}
    assert D.ground_truth(spark, D.sequence(listed, "07")).count() == 0
    both = D.concatenated(listed, D.catalogue(spark, str(tmp_path), "KITTI_raw"))
    assert both.count() == 6 and both.select("seq").distinct().count() == 6


def test_calibrations_are_rotations():
    for kind in D.KINDS.values():
        for name in kind.names:
            assert abs(sum(v * v for v in kind.calibration(name)[0]) - 1) < 1e-9
    assert len(D.KITTI_FRAMES) == 22 and len(D.NCLT_DAYS) == 27


def test_frames_with_true_ends(spark):
    truth = poses(4).assign(t=[0.0, 1.0, 2.0, 3.0], seq=0)
    points = spark.createDataFrame([(0, 7, 0.5), (0, 7, 2.5), (0, 8, 1.0)], "seq long, frame_id long, t double")
    got = {r.frame_id: r for r in D.with_end_poses(points, spark.createDataFrame(truth)).collect()}
    assert abs(got[7].b_x - (truth.x[0] + truth.x[1]) / 2) < 1e-9 and abs(got[7].e_y - (truth.y[2] + truth.y[3]) / 2) < 1e-9 and abs(got[8].b_x - truth.x[1]) < 1e-9


def test_pose_files_of_other_forms(spark, tmp_path):
    (tmp_path / "a.txt").write_text("1.5 1 2 3 0 0 0 1\n\n2.5   4 5 6 0 0 1 0\n")
    got = files.read_spaced_poses(spark, str(tmp_path / "a.txt")).orderBy("t").collect()
    assert [(r.t, r.x, r.qz, r.qw) for r in got] == [(1.5, 1, 0, 1), (2.5, 4, 1, 0)]
    (tmp_path / "b.csv").write_text("10,1,2,3,0.1,0.2,0.3\n11,NaN,2,3,0,0,0\n12,2,2,3,0.1,0.2,0.3\n")
    rows = files.read_angle_poses(spark, str(tmp_path / "b.csv"))
    q = rows.orderBy("t").first()
    turn = R.rotation(np.array([0, 0, 0.3])) @ R.rotation(np.array([0, 0.2, 0])) @ R.rotation(np.array([0.1, 0, 0]))
    assert np.allclose([q.qx, q.qy, q.qz, q.qw], R.quaternion(turn)) and rows.count() == 2
    based = files.rebased(rows.withColumn("k", F.lit(0)), ["k"], ["t"]).orderBy("t").collect()
    assert np.allclose([based[0].x, based[0].qw], [0, 1]) and np.allclose([based[1].x, based[1].y, based[1].z], turn.T @ [1, 0, 0])


def test_files_are_replaced_whole(spark, tmp_path):
    df = spark.createDataFrame([("a.txt", "one"), ("b.txt", "two")], "name string, content string")
    assert files.write_files(df, str(tmp_path)) == 2 and files.write_files(df.limit(1), str(tmp_path)) == 1
    assert sorted(p.name for p in tmp_path.iterdir()) == ["a.txt", "b.txt"] and (tmp_path / "b.txt").read_text() == "two"


def test_messages(spark):
    rows = spark.createDataFrame([(3, 10, 500_000_000, (1.0, 2.0, 3.0), (0.0, 0.0, 0.0, 1.0))], "frame_id long, sec long, nsec long, position struct<x: double, y: double, z: double>, orientation struct<x: double, y: double, z: double, w: double>")
    p = messages.poses(rows)
    assert (p.first().t, p.first().y, p.first().qw) == (10.5, 2.0, 1.0)
    back = messages.odometry(p, "map", "base").first()
    assert (back.sec, back.nsec, back.position.z, back.child) == (10, 500_000_000, 3.0, "base")
    cloud = spark.createDataFrame([(1, 0, 0.25, 1.0, 2.0, 3.0), (1, 1, 0.5, 4.0, 5.0, 6.0)], "frame_id long, point_id long, t double, x double, y double, z double")
    got = messages.points(messages.packed(cloud), ("x", "z", "ring")).orderBy("point_id").collect()
    assert [(r.x, r.z, r.ring, r.stamp) for r in got] == [(1, 3, None, 0.25), (4, 6, None, 0.25)]
    assert messages.lidar_points(cloud).first().label == 0
    stamped = spark.createDataFrame([(1, 5.0), (2, 5.1)], "frame_id long, stamp double")
    assert [r.name for r in messages.clouds_by_milliseconds(stamped).orderBy("frame_id").collect()] == ["0000000000", "0000000100"]


def test_options_from_yaml():
    tree = config.load("loss: huber\nsigma: 1\nattempts:\n  - {start: still, reach: 2}\n  - {}\ngates: [{name: turn, limit: 3}]\n")
    tree = config.overridden(tree, ["iterations=7", "keypoint_voxel=0.5"])
    o = config.options(L.Effort, tree)
    assert (o.loss, o.sigma, o.iterations, o.attempts, o.gates) == ("huber", 1.0, 7, (L.Attempt("still", 2.0), L.Attempt()), (L.Gate("turn", 3.0),))
    assert config.options(L.Effort, {}, L.PRESETS["driving"]) == L.PRESETS["driving"]
    again = config.options(L.Effort, config.load(config.dump(o)))
    assert again == o
    for bad in ({"los": "x"}, {"sigma": "wide"}, {"iterations": 1.5}, {"classes": 1}, {"attempts": 3}):
        with pytest.raises(ValueError):
            config.options(L.Effort, bad)
    deep = config.merged({"a": {"b": 1, "c": 2}}, {"a": {"c": 3}, "d": 4})
    assert deep == {"a": {"b": 1, "c": 3}, "d": 4} and config.find(deep, "a.c") == 3 and config.find(deep, "a.x.y", 0) == 0
    assert config.put({}, "a.b.c", 1) == {"a": {"b": {"c": 1}}} and config.load("") == {} and dataclasses.is_dataclass(o)
    with pytest.raises(ValueError):
        config.overridden({}, ["a.b"])


def test_metrics_and_poses_as_yaml(spark):
    p = config.poses(spark, [{"quaternion": [0, 0, 0, 2], "translation": [1, 2, 3]}, {"quaternion": [0, 1, 0, 0], "translation": [0, 0, 0], "dest_frame_id": 4}])
    assert [(r.t, r.qw, r.x) for r in p.orderBy("t").collect()] == [(0.0, 1.0, 1.0), (4.0, 0.0, 0.0)]
    assert config.poses(spark, config.pose_nodes(p)).orderBy("t").select("t", "qy", "x").collect() == p.orderBy("t").select("t", "qy", "x").collect()
    table = spark.createDataFrame([(1, 0.5), (0, 0.25)], "seq long, mean_ape double")
    assert config.load(config.metrics(table)) == {"0": {"mean_ape": 0.25}, "1": {"mean_ape": 0.5}}


SCENE = """
sample_frequency: 4.0
max_lidar_distance: 6.0
num_points_per_primitives: 40
acquisition:
  poses:
    - {quaternion: [0, 0, 0, 1], translation: [2, 2, 1], dest_frame_id: 0}
    - {quaternion: [0, 0, 1, 1], translation: [4, 2, 1], dest_frame_id: 1}
  triangles: [[[0, 0, 0.5], [0, 10, 0.5], [5, 10, 0.5]]]
  lines: [[[5, 0, 0], [5, 0, 5]]]
  spheres: [{radius: 1.0, center: [3, 4, 1]}]
  balls: [{radius: 0.5, center: [3, 1, 1]}]
"""


def test_a_scene_file(spark):
    a = S.Acquisition.of(config.load(SCENE))
    path = a.path(spark).orderBy("t").toPandas()
    assert path.t.tolist() == [0, 0.25, 0.5, 0.75, 1.0] and np.allclose(path.x, [2, 2.5, 3, 3.5, 4]) and np.allclose(path.qz[4], np.sqrt(0.5))
    f = a.frame(spark, 2, 5).toPandas()
    assert len(f) and f.t.between(0.5, 0.75).all() and set(f["shape"]) <= {0, 1, 2, 3}
    for r in f.itertuples():  # back in the world each point lies on its shape, near the sensor
        q, v = a.at(0.5)
        r0, r1 = ((1 - r.alpha), r.alpha)
        (q0, v0), (q1, v1) = a.at(0.5), a.at(0.75)
        m = R.Motion(*[x for p in ((q0, v0), (q1, v1)) for x in (matrix_of(pd.Series(dict(zip(("qx", "qy", "qz", "qw", "x", "y", "z"), (*p[0], *p[1]), strict=True))))[:3, :3], np.array(p[1]))])
        world = m.move(np.array([[r.x, r.y, r.z]]), np.array([r1]))[0]
        assert np.linalg.norm(world - v) <= 6.0 + 1e-6 and r0 >= 0
        if r.shape == 2:
            assert np.linalg.norm(world - [3, 1, 1]) <= 0.5 + 1e-6
        if r.shape == 3:
            assert abs(np.linalg.norm(world - [3, 4, 1]) - 1) < 1e-6
        if r.shape == 0:
            assert abs(world[2] - 0.5) < 1e-6
    noisy = S.turned_noise(a.path(spark), 2.0, 0.1, 3).toPandas()
    assert np.allclose((noisy[["qx", "qy", "qz", "qw"]] ** 2).sum(axis=1), 1) and not np.allclose(noisy.x, path.x)


def test_streams_are_handed_on_and_evaluated(spark, tmp_path):
    for f in range(3):
        pd.DataFrame({"seq": [0], "frame_id": [f], "ex": [0.5 * f], "ey": [0.0], "ez": [0.0], "eqx": [0.0], "eqy": [0.0], "eqz": [0.0], "eqw": [1.0]}).to_parquet(tmp_path / f"{f}.parquet")
    for f in range(3):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"{f}.parquet").rename(tmp_path / "in" / f"{f}.parquet")
    schema = spark.read.parquet(str(tmp_path / "in")).schema
    truth = spark.createDataFrame([(0, f, 1.0 * f, 0.0, 0.0, 0.0, 0.0, 0.0, 1.0) for f in range(3)], "seq long, frame_id long, x double, y double, z double, qx double, qy double, qz double, qw double")
    stream = Live.replay(spark, str(tmp_path / "in"), schema)
    seen, other = [], []
    q = Live.fan_out(stream, [lambda b, n: seen.append(b.count()), lambda b, n: other.extend(r.frame_id for r in Live.newest(b, 1).collect())], str(tmp_path / "c"))
    q.processAllAvailable()
    q.stop()
    assert seen == [1, 1, 1] and sorted(other) == [0, 1, 2]
    run = Live.errors(stream, truth).writeStream.format("memory").queryName("ape").outputMode("complete").trigger(availableNow=True).start()
    run.awaitTermination()
    r = spark.table("ape").first()
    assert (r.n, r.mean_ape, r.max_ape) == (3, 0.5, 1.0)
    assert Live.describe({"poses": stream}).count() == len(schema)
    batch = spark.createDataFrame([(0, f, p) for f in range(5) for p in range(3)], "seq long, frame_id long, point_id long")
    assert {r.frame_id for r in Live.newest(batch, 2).collect()} == {3, 4} and Live.newest(batch, 2).count() == 6


def test_registered_frames(spark):
    from pointweave.plans import catalogue

    for name in ("icp_gn", "icp_lm", "icp_robust"):
        for r in catalogue.QUERIES[name](spark, "").collect():
            assert r.success and r.begin_error < 0.1 and r.end_error < 0.1, (name, r)


def test_frame_windows(spark):
    df = spark.createDataFrame([(f,) for f in range(6)], "frame_id long")
    assert [r.frame_id for r in T.window_by_frame(df, 2, 3).orderBy("frame_id").collect()] == [2, 3]
    assert [r.frame_id for r in D.frame_range(df, 4, 5).orderBy("frame_id").collect()] == [4, 5]
