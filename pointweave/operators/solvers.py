"""Damped least squares for registration, gates on its result, and further attempts after a refusal.

The solver minimises robust losses of weighted residuals plus priors on the motion, by
Levenberg-Marquardt steps on the 12 unknowns of a begin and an end pose. What a residual is depends
on the neighbourhood of its point: distance to a plane or a line, or from a distribution, each
written as a matrix that the offset from the neighbourhood is multiplied by.

Gates and attempts are data: a gate measures a motion against a limit, an attempt says where to
start from and how widely to look. A frame goes through the attempts in turn until no gate refuses
its motion. A motion that is refused to the end is reported as no success and doesn't enter the map.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame

from . import registration as R

Motion = R.Motion


# --- losses ---------------------------------------------------------------------------------------
def _tolerant(z: np.ndarray, o: Effort) -> tuple[np.ndarray, np.ndarray]:
    b, a = o.sigma**2, o.tolerant_at**2
    u = np.clip((z - a) / b, -500, 500)
    return b * np.logaddexp(0, u) - b * np.log1p(np.exp(-a / b)), 1 / (1 + np.exp(-u))


Loss = Callable[[np.ndarray, "Effort"], tuple[np.ndarray, np.ndarray]]
#: Of squared residuals z: (loss, its slope).
LOSSES: dict[str, Loss] = {
    "standard": lambda z, o: (z, np.ones_like(z)),
    "cauchy": lambda z, o: (o.sigma**2 * np.log1p(z / o.sigma**2), 1 / (1 + z / o.sigma**2)),
    "huber": lambda z, o: (np.where(z <= o.sigma**2, z, 2 * o.sigma * np.sqrt(z) - o.sigma**2), np.where(z <= o.sigma**2, 1, o.sigma / np.sqrt(np.maximum(z, 1e-300)))),
    "truncated": lambda z, o: (np.minimum(z, o.sigma**2), (z < o.sigma**2).astype(float)),
    "tolerant": _tolerant,
}


# --- attempts and gates ---------------------------------------------------------------------------
@dataclass(frozen=True)
class Attempt:
    """start: the guess as it is (`guess`), the last frame's end twice (`still`), or half the predicted motion (`half`).

    reach: times the largest distance of a residual; detail: times the size of keypoint voxels;
    iterations: times those of the options.
    """

    start: str = "guess"
    reach: float = 1.0
    detail: float = 1.0
    iterations: float = 1.0


@dataclass(frozen=True)
class Gate:
    """Refuses a motion whose measure is over the limit, in the first `until` attempts (0: in all)."""

    name: str
    limit: float
    until: int = 0


#: What a gate can measure, of a motion and the one before: lengths, and degrees.
MEASURES: dict[str, Callable[[Motion, Motion | None], float]] = {
    "length": lambda m, last: float(np.linalg.norm(m.te - m.tb)),
    "own turn": lambda m, last: R.turn_between(m.rb, m.re),
    "turn": lambda m, last: R.turn_between(last.re, m.re) if last else 0.0,
    "jump": lambda m, last: float(np.linalg.norm(m.tb - last.te)) if last else 0.0,
    "change of speed": lambda m, last: float(np.linalg.norm((m.te - m.tb) - (last.te - last.tb))) if last else 0.0,
}
ONCE = (Attempt(),)
#: From the prediction, then wider and finer, then from other starts.
PATIENT = (Attempt(), Attempt(reach=2.0, iterations=1.5), Attempt("half", 2.5, 0.75, 2.0), Attempt("still", 3.0, 0.75, 2.0), Attempt("still", 4.0, 0.5, 3.0))


@dataclass(frozen=True)
class Effort(R.Options):
    """Options of the damped solver. A weight of 0 leaves a prior out; stop_turn is in degrees.

    classes: residuals by the shape of the neighbourhood, lines from `linear` and planes from
    `planar` on, distributions below; else all are planes. ridge: added to a distribution's variances.
    """

    loss: str = "cauchy"
    sigma: float = 0.1
    tolerant_at: float = 0.05
    steps: int = 5
    max_residuals: int = 0
    classes: bool = False
    linear: float = 0.8
    planar: float = 0.5
    ridge: float = 0.05
    shape_weight: float = 0.9
    near_weight: float = 0.1
    power: float = 2.0
    orientation: float = 0.0
    still: float = 0.0
    predicted_begin: float = 0.0
    predicted_end: float = 0.0
    stop_turn: float = 1e-3
    stop_shift: float = 1e-3
    attempts: tuple[Attempt, ...] = PATIENT
    gates: tuple[Gate, ...] = (Gate("length", 4.0), Gate("own turn", 25.0), Gate("turn", 25.0), Gate("turn", 8.0, 1), Gate("jump", 1.5, 3))


#: Options for usual driving, for driving with new attempts after a refusal, and for sensors that are carried.
PRESETS: dict[str, Effort] = {
    "driving": Effort(attempts=ONCE),
    "robust_driving": Effort(min_neighbours=10),
    "robust_outdoor": Effort(voxel=0.8, keypoint_voxel=1.0, max_plane_distance=0.5, velocity=0.0, gates=(Gate("length", 2.0), Gate("own turn", 45.0), Gate("turn", 45.0), Gate("jump", 0.7, 3))),
}


def refusals(m: Motion, last: Motion | None, attempt: int, o: Effort) -> list[str]:
    """Names of the gates that refuse a motion at an attempt (counted from 0)."""
    return [g.name for g in o.gates if (not g.until or attempt < g.until) and MEASURES[g.name](m, last) > g.limit]


def consistent(estimate: Motion, prediction: Motion, shift: float, degrees: float) -> dict[str, bool]:
    """Whether begin, end and relative motion of an estimate are as predicted, within bounds of shift and turn."""
    near = lambda a, b, r, q: float(np.linalg.norm(a - b)) <= shift and R.turn_between(r, q) <= degrees
    own, told = (m.rb.T @ m.re for m in (estimate, prediction))
    moved = [m.rb.T @ (m.te - m.tb) for m in (estimate, prediction)]
    return {"begin": near(estimate.tb, prediction.tb, estimate.rb, prediction.rb), "end": near(estimate.te, prediction.te, estimate.re, prediction.re), "relative": near(*moved, own, told)}


# --- the solver -----------------------------------------------------------------------------------
#: Classes of a neighbourhood.
PLANE, LINE, DISTRIBUTION = range(3)


@dataclass
class Residuals:
    """Points (places in a frame), what each is compared with, and the matrix W of W (moved point - reference)."""

    at: np.ndarray
    reference: np.ndarray
    matrix: np.ndarray
    kind: np.ndarray
    weight: np.ndarray

    @classmethod
    def around(cls, world: np.ndarray, cells: R.VoxelMap, o: Effort) -> Residuals:
        hood = cells.around(world)
        low, mid, high = hood.value.T
        top = np.maximum(high, 1e-300)
        kind = np.full(len(world), PLANE)
        if o.classes:
            kind = np.where((high - mid) / top >= o.linear, LINE, np.where((mid - low) / top >= o.planar, PLANE, DISTRIBUTION))
        reference = np.where((kind == PLANE)[:, None], hood.nearest, hood.mean)
        matrix = hood.normal[:, :, None] * hood.normal[:, None, :]
        line = hood.axes[:, :, 2]
        matrix = np.where((kind == LINE)[:, None, None], np.eye(3) - line[:, :, None] * line[:, None, :], matrix)
        if (kind == DISTRIBUTION).any():  # whitened, and scaled so that the widest axis counts as a distance
            spread = np.maximum(low, 0)[:, None] + o.ridge
            white = hood.axes * np.sqrt(spread / (np.maximum(hood.value, 0) + o.ridge))[:, None, :]
            matrix = np.where((kind == DISTRIBUTION)[:, None, None], np.swapaxes(white, 1, 2), matrix)
        off = np.linalg.norm(np.einsum("nij,nj->ni", matrix, world - reference), axis=1)
        at = np.flatnonzero(hood.ok & (off < o.max_plane_distance))
        at = at[: o.max_residuals] if o.max_residuals else at
        apart = np.linalg.norm(hood.nearest - world, axis=1)[at] / (o.max_plane_distance * o.min_neighbours)
        weight = (o.shape_weight * hood.flatness[at] ** o.power + o.near_weight * np.exp(-apart)) / (o.shape_weight + o.near_weight)
        return cls(at, reference[at], matrix[at] * weight[:, None, None], kind[at], weight)


def priors(m: Motion, last: Motion | None, n: float, o: Effort, prediction: Motion | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Residuals of the motion itself, scaled by the number of point residuals, and their slopes."""
    rows: list[np.ndarray] = []
    values: list[float] = []

    def add(weight: float, value: np.ndarray, begin: float, end: float) -> None:
        k = np.sqrt(n * weight)
        for i in range(3):
            row = np.zeros(12)
            row[3 + i], row[9 + i] = k * begin, k * end
            rows.append(row)
            values.append(k * value[i])

    if last is not None:
        if o.location:
            add(o.location, m.tb - last.te, 1, 0)
        if o.velocity:
            add(o.velocity, (m.te - m.tb) - (last.te - last.tb), -1, 1)
        if o.orientation:
            v = R.rotation_vector(m.rb @ last.re.T)
            angle, k = np.linalg.norm(v), np.sqrt(n * o.orientation)
            row = np.zeros(12)
            if angle > 1e-12:
                row[:3] = k * np.sin(angle) / 2 * v / angle
            rows.append(row)
            values.append(k * np.sin(angle / 2) ** 2)
    if o.still:
        add(o.still, m.tb - m.te, 1, -1)
    if prediction is not None and o.predicted_begin:
        add(o.predicted_begin, m.tb - prediction.tb, 1, 0)
    if prediction is not None and o.predicted_end:
        add(o.predicted_end, m.te - prediction.te, 0, 1)
    return np.array(values), np.array(rows).reshape(-1, 12)


def moved(m: Motion, x: np.ndarray) -> Motion:
    return Motion(R.rotation(x[:3]) @ m.rb, m.tb + x[3:6], R.rotation(x[6:9]) @ m.re, m.te + x[9:])


def fit(points: np.ndarray, alpha: np.ndarray, m: Motion, last: Motion | None, found: Residuals, o: Effort, prediction: Motion | None = None) -> Motion:
    """Levenberg-Marquardt steps for fixed neighbourhoods; a step that raises the cost is taken back and damped more.

    Priors weigh against the points as many as the loss counts them for at the start, so a loss of a
    small slope isn't outweighed by them.
    """
    p, a = points[found.at], alpha[found.at]
    e = np.einsum("nij,nj->ni", found.matrix, m.move(p, a) - found.reference)
    n = float(LOSSES[o.loss]((e * e).sum(1), o)[1].sum())

    def parts(m: Motion) -> tuple[np.ndarray, np.ndarray, float]:
        e = np.einsum("nij,nj->ni", found.matrix, m.move(p, a) - found.reference)
        cost, slope = LOSSES[o.loss]((e * e).sum(1), o)
        return e, slope, float(cost.sum() + (priors(m, last, n, o, prediction)[0] ** 2).sum())

    damping, (e, slope, cost) = 1e-4, parts(m)
    for _ in range(o.steps):
        u = np.einsum("nij,njk->nik", found.matrix, R.slopes(p, a, m))
        value, row = priors(m, last, n, o, prediction)
        left = np.einsum("n,nij,nik->jk", slope, u, u, optimize=True) + row.T @ row
        right = -np.einsum("n,nij,ni->j", slope, u, e) - row.T @ value
        x = np.linalg.solve(left + damping * np.diag(np.diag(left)) + 1e-9 * np.eye(12), right)
        tried = moved(m, x)
        new = parts(tried)
        if new[2] < cost:
            gain = cost - new[2]
            m, (e, slope, cost), damping = tried, new, damping / 3
            if gain <= 1e-10 * max(cost, 1e-300):
                break
        else:
            damping *= 4
    return m


def register(points: np.ndarray, alpha: np.ndarray, guess: Motion, last: Motion | None, cells: R.VoxelMap, o: Effort, prediction: Motion | None = None, listen: Callable | None = None) -> tuple[Motion, int, bool]:
    """(motion, residuals used, whether there were enough): neighbourhoods anew in each iteration, until both poses rest."""
    m, used = guess, 0
    for i in range(o.iterations):
        found = Residuals.around(m.move(points, alpha), cells, o)
        used = len(found.at)
        if used < o.min_residuals:
            return m, used, False
        before, m = m, fit(points, alpha, m, last, found, o, prediction)
        if listen:
            listen(i, m, used)
        shift = np.linalg.norm(m.tb - before.tb) + np.linalg.norm(m.te - before.te)
        if shift < o.stop_shift and R.turn_between(m.rb, before.rb) + R.turn_between(m.re, before.re) < o.stop_turn:
            break
    return m, used, True


def diagnosed(points: np.ndarray, alpha: np.ndarray, m: Motion, cells: R.VoxelMap, o: Effort) -> dict[str, np.ndarray]:
    """Of the points that have a residual under a motion: their place, the residual's length, its class and weight."""
    world = m.move(points, alpha)
    found = Residuals.around(world, cells, o)
    off = np.einsum("nij,nj->ni", found.matrix, world[found.at] - found.reference)
    return {"place": found.at, "residual": np.linalg.norm(off, axis=1), "kind": found.kind, "weight": found.weight}


class RobustOdometry(R.Odometry):
    """Odometry by the damped solver. A frame begins with the attempt before the one that the last frame needed."""

    def solve(self, points: np.ndarray, alpha: np.ndarray, guess: Motion, last: Motion | None) -> R.Registered:
        base: Effort = self.o
        done = R.Registered(guess, 0, 0, False, 0)
        for level in range(min(self.level, len(base.attempts) - 1), len(base.attempts)):
            plan = base.attempts[level]
            iterations = base.start_iterations if self.frames <= base.start_frames else base.iterations
            o = replace(base, iterations=round(iterations * plan.iterations), max_plane_distance=base.max_plane_distance * plan.reach)
            keys = self.keypoints(points, max(base.keypoint_voxel * plan.detail, base.frame_voxel))
            motion, used, enough = register(points[keys], alpha[keys], start(plan.start, guess, last), last, self.cells, o, guess, lambda i, m, n: self.tell("step", iteration=i, motion=m, residuals=n))
            refused = refusals(motion, last, level, base)
            done = R.Registered(motion, len(keys), used, enough and not refused, done.attempts + 1)
            self.tell("attempt", level=level, refused=refused, enough=enough)
            if done.success:
                break
        self.level = max(0, level - 1) if done.success else level
        return done


def start(name: str, guess: Motion, last: Motion | None) -> Motion:
    """Where an attempt starts from."""
    if name == "guess" or last is None:
        return guess
    if name == "still":
        return Motion(last.re, last.te, last.re.copy(), last.te.copy())
    half = R.rotation(R.rotation_vector(guess.rb.T @ guess.re) / 2)
    return Motion(guess.rb, guess.tb, guess.rb @ half, guess.tb + (guess.te - guess.tb) / 2)


def odometry(points: DataFrame, options: Effort = PRESETS["robust_driving"]) -> DataFrame:
    """R.odometry() by the damped solver."""
    return R.odometry(points, options, RobustOdometry)
