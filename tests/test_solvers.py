from dataclasses import replace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from pointweave.operators import registration as R
from pointweave.operators import scenes as S
from pointweave.operators import solvers as L


@pytest.mark.parametrize("loss", sorted(L.LOSSES))
def test_slopes_of_losses(loss):
    o = L.Effort()
    z = np.array([0.0, 0.001, 0.004, 0.03, 0.4, 3.0])
    f = lambda x: L.LOSSES[loss](x, o)[0]
    assert np.allclose((f(z + 1e-7) - f(z)) / 1e-7, L.LOSSES[loss](z, o)[1], atol=1e-4)


def test_slopes_of_priors():
    o = L.Effort(location=0.3, velocity=0.2, orientation=0.5, still=0.1)
    last = R.Motion(te=np.array([1.0, 2.0, 3.0]), re=R.rotation(np.array([0.1, 0.2, -0.1])))
    m = R.Motion(R.rotation(np.array([0.2, -0.3, 0.4])), np.array([0.5, 1.0, 0.0]), R.rotation(np.array([0.0, 0.3, 0.1])), np.array([1.0, 1.0, 1.0]))
    value, rows = L.priors(m, last, 10, o)
    for i in range(12):
        x = np.zeros(12)
        x[i] = 1e-7
        assert np.allclose((L.priors(L.moved(m, x), last, 10, o)[0] - value) / 1e-7, rows[:, i], atol=1e-5)


@pytest.mark.parametrize("classes", [False, True])
@pytest.mark.parametrize("loss", sorted(L.LOSSES))
def test_damped_solver_follows_a_box(loss, classes):
    state = L.RobustOdometry(replace(L.PRESETS["robust_driving"], loss=loss, classes=classes))
    ends = []
    for f in range(6):
        p = R.box_scan(0, f)
        got = state.add(p[["x", "y", "z"]].to_numpy(), p["t"].to_numpy())
        assert got.success and got.inserted
        ends.append(got.motion.te)
    assert np.allclose(np.array(ends)[:, 0], [0, 0, 0.6, 0.9, 1.2, 1.5], atol=0.12) and np.allclose(np.array(ends)[:, 1:], 0, atol=0.05)


def test_odometry_on_spark_is_that_of_the_state(spark):
    points = pd.concat([R.box_scan(s, f) for s in range(2) for f in range(3)])
    out = L.odometry(spark.createDataFrame(points)).toPandas()
    assert len(out) == 6 and out.success.all() and set(out.attempts) <= {1} and out[out.frame_id == 2].ex.between(0.48, 0.72).all()


def test_gates():
    o = L.Effort()
    far, turned = R.Motion(te=np.array([9.0, 0, 0])), R.Motion(re=R.rotation(np.array([0, 0, np.radians(10)])))
    assert L.refusals(R.Motion(), None, 0, o) == [] and L.refusals(far, None, 4, o) == ["length"]
    assert L.refusals(turned, R.Motion(), 0, o) == ["turn"] and L.refusals(turned, R.Motion(), 1, o) == []
    assert L.refusals(R.Motion(tb=np.array([2.0, 0, 0]), te=np.array([2.0, 0, 0])), R.Motion(), 0, o) == ["jump"]
    known = replace(o, gates=tuple(L.Gate(n, -1.0) for n in L.MEASURES))
    assert set(L.refusals(R.Motion(te=np.ones(3)), R.Motion(), 0, known)) == set(L.MEASURES)


@pytest.mark.parametrize("attempts", [L.ONCE, L.PATIENT])
def test_a_refused_frame_is_no_success_and_stays_out_of_the_map(attempts):
    o = replace(L.PRESETS["driving"], attempts=attempts, gates=(L.Gate("length", 0.1),))
    state, told = L.RobustOdometry(o), []
    for f in range(2):
        p = R.box_scan(0, f)
        assert state.add(p[["x", "y", "z"]].to_numpy(), p["t"].to_numpy()).success
    state.listeners = (lambda what, details: told.append((what, details)),)
    size, p = len(state.cells), R.box_scan(0, 2)
    got = state.add(p[["x", "y", "z"]].to_numpy(), p["t"].to_numpy())
    assert not got.success and not got.inserted and got.attempts == len(attempts) and len(state.cells) == size
    assert [d["refused"] for what, d in told if what == "attempt"] == [["length"]] * len(attempts)
    assert told[0][0] == "begin" and told[-1][0] == "end" and any(what == "step" for what, _ in told)


def test_further_attempts_and_the_one_the_next_frame_begins_with():
    blind, state, counts = L.Attempt(reach=0.001), L.RobustOdometry(L.PRESETS["driving"]), []
    for f in range(8):
        p = R.box_scan(0, f)
        if f == 3:
            state.o = replace(state.o, attempts=(blind, blind, L.Attempt("half"), L.Attempt("still")))
        got = state.add(p[["x", "y", "z"]].to_numpy(), p["t"].to_numpy())
        assert got.success
        counts.append((got.attempts, state.level))
    assert counts[2:] == [(1, 0), (3, 1), (2, 1), (2, 1), (2, 1), (2, 1)] and abs(got.motion.te[0] - 2.1) < 0.12


def test_frames_enter_the_map_by_distance():
    state, entered = R.Odometry(R.Options(insert_shift=0.5)), []
    for f in range(8):
        p = R.box_scan(0, f)
        entered.append(state.add(p[["x", "y", "z"]].to_numpy(), p["t"].to_numpy()).inserted)
    assert entered == [True, True, True, False, True, False, True, False]
    every = R.Odometry(R.Options(insert_every=3))
    assert [every.add(p[["x", "y", "z"]].to_numpy(), p["t"].to_numpy()).inserted for p in (R.box_scan(0, f) for f in range(8))] == [True, True, False, False, True, False, False, True]


def test_state_as_bytes():
    a, b = L.RobustOdometry(L.Effort()), L.RobustOdometry(L.Effort())
    for f in range(4):
        p = R.box_scan(0, f)
        b.restore(a.state())
        x, y = (s.add(p[["x", "y", "z"]].to_numpy(), p["t"].to_numpy()) for s in (a, b))
        assert np.allclose(x.motion.te, y.motion.te, atol=1e-12) and len(a.cells) == len(b.cells)
    a.reset()
    assert len(a.cells) == 0 and a.last is None


@pytest.mark.parametrize("sampling", ["grid", "adaptive", "none"])
def test_sampling_of_keypoints(sampling):
    state = R.Odometry(R.Options(sampling=sampling, max_keypoints=300, start_frames=1))
    for f in range(4):
        p = R.box_scan(0, f)
        got = state.add(p[["x", "y", "z"]].to_numpy(), p["t"].to_numpy())
        assert got.success and (f < 2 or 100 < got.keypoints <= 300)
    assert abs(got.motion.te[0] - 0.9) < 0.12


def test_classes_of_residuals():
    """Points of a wall, an edge and a ball of points."""
    rng = np.random.default_rng(0)
    wall, edge, ball = rng.uniform(0, 1, (60, 3)) * (1, 1, 0), rng.uniform(0, 1, (60, 3)) * (0, 0, 1) + (20, 20, 0), rng.uniform(0, 0.9, (60, 3)) + (40, 40, 0)
    o = L.Effort(classes=True, min_distance=0.0, cap=60, neighbours=60, voxel=2.0, radius=3.0, max_plane_distance=1.0)
    cells = R.VoxelMap(o)
    cells.insert(np.vstack((wall, edge, ball)))
    places = np.array([[0.5, 0.5, 0.1], [20.1, 20.0, 0.5], [40.4, 40.4, 0.4]])
    found = L.Residuals.around(places, cells, o)
    assert found.kind.tolist() == [L.PLANE, L.LINE, L.DISTRIBUTION]
    got = L.diagnosed(places, np.ones(3), R.Motion(), cells, replace(o, shape_weight=0.0))
    assert got["place"].tolist() == [0, 1, 2] and got["residual"][0] < 0.1 and got["residual"][1] < 0.1


def test_consistency_with_a_prediction():
    m = R.Motion(te=np.array([1.0, 0, 0]))
    off = R.Motion(tb=np.array([0.5, 0, 0]), te=np.array([1.5, 0, 0]))
    assert L.consistent(m, m, 0.1, 1.0) == {"begin": True, "end": True, "relative": True}
    assert L.consistent(off, m, 0.1, 1.0) == {"begin": False, "end": False, "relative": True}
    value, rows = L.priors(off, None, 4, replace(L.Effort(), predicted_begin=1.0, predicted_end=0.25), m)
    assert np.allclose(value, [1.0, 0, 0, 0.5, 0, 0]) and rows.shape == (6, 12)


SHAPES = [S.Sphere((1.0, 2.0, 3.0), 2.0), S.Ball((0.0, 1.0, 0.0), 1.5), S.Line((1.0, 0.0, 0.0), (4.0, 4.0, 1.0)), S.Triangle((1.0, 0.0, 0.5), (0.0, 1.0, 0.5), (0.0, 0.2, 1.5))]


def test_points_lie_on_their_shapes(spark):
    drawn = S.draw(spark, SHAPES, 50, 3)
    for i, s in enumerate(SHAPES):
        far = drawn.filter(F.col("shape") == i).agg(F.max(s.distance(tuple(F.col(a) for a in "xyz"))), F.count("*")).first()
        assert far[0] < 1e-9 and far[1] == 50


def test_distances(spark):
    p = tuple(F.lit(v) for v in (1.0, 2.0, 6.0))
    got = spark.range(1).select(SHAPES[0].distance(p), S.Ball((1.0, 2.0, 3.0), 2.0).distance(p), S.Ball((1.0, 2.0, 5.5), 2.0).distance(p), S.Line((0.0, 2.0, 6.0), (5.0, 2.0, 6.0)).distance(p)).first()
    assert np.allclose(list(got), [1, 1, 0, 0])


def test_a_frame_seen_from_its_poses(spark):
    rest = tuple(F.lit(v) for v in (0.0, 0.0, 0.0, 1.0)), tuple(F.lit(v) for v in (1.0, 0.0, 0.0))
    seen = S.sensor_frame(spark.createDataFrame([(5, 1.0, 2.0, 3.0)], "k int, x double, y double, z double"), rest, rest).first()
    assert np.allclose([seen.x, seen.y, seen.z], [0, 2, 3]) and 0 <= seen.alpha < 1 and seen.k == 5
