import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from pointweave.functions import algebra as A
from pointweave.operators import clouds as C
from pointweave.operators import registration as R
from pointweave.operators import trajectories as T
from pointweave.sources import files
from pointweave.streaming import odometry as Live


def poses(n, seed=0):
    rng = np.random.default_rng(seed)
    q = rng.normal(size=(n, 4))
    q /= np.linalg.norm(q, axis=1)[:, None]
    return pd.DataFrame({"seq": 0, "pose_id": range(n), "t": np.arange(n) * 0.1, **dict(zip(("qx", "qy", "qz", "qw"), q.T, strict=True)), **dict(zip("xyz", rng.uniform(-100, 100, (3, n)), strict=True))})


def test_inverse_times_pose_is_identity(spark):
    df = spark.createDataFrame(poses(50))
    q, v = A.compose(A.inverse(T.pose()), T.pose())
    for r in df.select(*T.columns((q, v))).collect():
        assert max(abs(r.x), abs(r.y), abs(r.z), abs(r.qx), abs(r.qy), abs(r.qz), abs(abs(r.qw) - 1)) < 1e-9


def test_chained_relative_poses_give_the_poses(spark):
    df = spark.createDataFrame(poses(12))
    first = poses(12).iloc[0]
    start = tuple(F.lit(float(first[c])) for c in ("qx", "qy", "qz", "qw")), tuple(F.lit(float(first[c])) for c in "xyz")
    got = T.chained(T.relative_poses(df)).select("pose_id", *T.columns(A.compose(start, T.pose()))).orderBy("pose_id").toPandas()
    want = poses(12).iloc[1:]
    assert np.allclose(got[["x", "y", "z"]], want[["x", "y", "z"]], atol=1e-8)


def test_bracket_known_answers(spark):
    truth = poses(3).assign(t=[0.0, 1.0, 2.0])
    queries = pd.DataFrame({"seq": 0, "pose_id": range(10, 15), "t": [-1.0, 0.0, 0.5, 2.0, 3.0]})
    got = T.bracket(spark.createDataFrame(truth), spark.createDataFrame(queries)).orderBy("t").select("lo.pose_id", "hi.pose_id").collect()
    assert [tuple(r) for r in got] == [(0, 0), (0, 0), (0, 1), (2, 2), (2, 2)]


def test_nearest_neighbour_of_a_point_is_itself(spark):
    rng = np.random.default_rng(1)
    p = spark.createDataFrame(pd.DataFrame({"point_id": range(100), **dict(zip("xyz", rng.uniform(-1, 1, (3, 100)), strict=True))}))
    got = C.nearest(C.neighbours(p, p, 0.5, 0.5, 1, "point_id"), 1).select("query_id", "point_id").collect()
    assert len(got) == 100 and all(r.query_id == r.point_id for r in got)


def test_voxels_truncate_toward_zero(spark):
    df = spark.createDataFrame([(-0.9, 0.9, -1.1)], "x double, y double, z double")
    assert tuple(C.with_voxel(df, 1.0).first())[3:] == (0, 0, -1)


def test_alignment_recovers_a_motion(spark):
    rng = np.random.default_rng(2)
    a = rng.normal(size=(50, 3))
    r, t = R.rotation(np.array([0.3, -0.2, 0.5])), np.array([1.0, 2.0, 3.0])
    b = a @ r.T + t
    df = spark.createDataFrame(pd.DataFrame({"k": 1, **dict(zip(("x", "y", "z"), a.T, strict=True)), **dict(zip(("gx", "gy", "gz"), b.T, strict=True))}))
    got = R.align(df, ["k"]).first()
    assert np.allclose([got.x, got.y, got.z], t, atol=1e-8) and np.allclose([got.qx, got.qy, got.qz, got.qw], R.quaternion(r), atol=1e-8)
    assert np.allclose(R.procrustes(b, a)[0], r, atol=1e-8)


def test_odometry_follows_a_box(spark):
    points = pd.concat([R.box_scan(0, f) for f in range(8)])
    out = R.odometry(spark.createDataFrame(points)).orderBy("frame_id").toPandas()
    assert out.success.all()
    assert np.allclose(out.ex, [0, 0, 0.6, 0.9, 1.2, 1.5, 1.8, 2.1], atol=0.12) and np.allclose(out[["ey", "ez"]], 0, atol=0.05)


def test_stream_gives_the_batch_poses(spark, tmp_path):
    for f in range(4):
        spark.createDataFrame(R.box_scan(0, f)).coalesce(1).write.parquet(f"{tmp_path}/in/{f}")
    batch = spark.read.parquet(*[f"{tmp_path}/in/{f}" for f in range(4)])
    stream = Live.odometry(spark.readStream.schema(batch.schema).parquet(f"{tmp_path}/in/*"))
    q = stream.writeStream.format("memory").queryName("poses").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    a, b = (x.orderBy("frame_id").toPandas() for x in (spark.table("poses"), R.odometry(batch)))
    assert len(a) == 4 and np.allclose(a.ex, b.ex, atol=1e-9)
    # a batch that comes later goes on from the state; a late frame and one of an odd duration are skipped
    for f, t in ((2, 1.0), (4, 1.0), (5, 0.5), (6, 1.0)):
        spark.createDataFrame(R.box_scan(0, f).assign(t=lambda p, f=f, t=t: f + (p.t - f) * t)).coalesce(1).write.parquet(f"{tmp_path}/more/{f}")
    both = f"{tmp_path}/{{in,more}}/*"
    live = Live.odometry(spark.readStream.schema(batch.schema).parquet(both), expected=1.0)
    q = live.writeStream.format("memory").queryName("later").outputMode("append").option("checkpointLocation", f"{tmp_path}/state2").trigger(availableNow=True).start()
    q.awaitTermination()
    later = spark.table("later").orderBy("frame_id").toPandas()
    assert 5 not in set(later.frame_id) and later.frame_id.is_unique and later.success.all()


def test_files_round_trip(spark, tmp_path):
    rows = R.box_scan(0, 1, 100).astype({"x": "float32"})
    for r in files.to_ply(spark.createDataFrame(rows), "frame_id", "point_id", ["x", "y", "t"]).collect():
        (tmp_path / "f.ply").write_bytes(bytes(r.content))
    got = files.read_ply(spark, str(tmp_path / "f.ply")).orderBy("point_id").toPandas()
    assert (got.x.to_numpy() == rows.x.to_numpy()).all() and (got.t.to_numpy() == rows.t.to_numpy()).all()
    p = poses(9)
    lines = files.matrix_pose_lines(spark.createDataFrame(p)).orderBy("pose_id").collect()
    (tmp_path / "p.txt").write_text("".join(r.line + "\n" for r in lines))
    got = files.read_matrix_poses(spark, str(tmp_path / "p.txt")).orderBy("pose_id").toPandas()
    q, want = (x[["qx", "qy", "qz", "qw"]].to_numpy() for x in (got, p))
    assert np.allclose(np.abs((q * want).sum(1)), 1, atol=1e-12) and np.allclose(got[["x", "y", "z"]], p[["x", "y", "z"]], atol=1e-12)


def test_hits(spark, tmp_path):
    hit = np.array([(20000, 20200, 19800, 7, 3)], [("x", "<u2"), ("y", "<u2"), ("z", "<u2"), ("i", "u1"), ("l", "u1")])
    packet = np.array([44444] * 4, "<u2").tobytes() + np.array([1], "<u4").tobytes() + np.array([5], "<u8").tobytes() + b"\0" * 4 + hit.tobytes()
    (tmp_path / "h.bin").write_bytes(packet * 3)
    got = files.read_hits(spark, str(tmp_path / "h.bin"), 2).orderBy("point_id").toPandas()
    assert got.frame_id.tolist() == [0, 0, 1] and np.allclose(got[["x", "y", "z"]].iloc[0], [0, 1, -1])
