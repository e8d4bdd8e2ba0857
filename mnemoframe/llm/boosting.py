"""Gradient-boosted trees for two classes, with calibrated probabilities: grown on all rows of a table by Spark, or on arrays by numpy.

Both add up the same histograms, of whole numbers, so a model doesn't depend on the order of rows or on how they are dealt to tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mnemoframe.llm.common import batches, materialize

#: Bins of a feature, between its quantiles.
BINS = 32
#: What a gradient of one is in sums of whole numbers.
UNIT = 1 << 24
#: Margins are tallied in steps of a thousandth.
STEPS = 1000
#: Rounds after which rows are written with their margins, so that a pass goes through no more trees than these.
WRITE_EVERY = 10


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


@dataclass
class Trees:
    """Trees of fixed depth as arrays: node k's children are 2k + 1 and 2k + 2; left holds feature <= cut."""

    depth: int
    base: float
    feature: list[np.ndarray] = field(default_factory=list)
    cut: list[np.ndarray] = field(default_factory=list)
    leaf: list[np.ndarray] = field(default_factory=list)
    slope: float = 1.0
    shift: float = 0.0

    def descend(self, tree: int, x: np.ndarray, steps: int) -> np.ndarray:
        f, c, rows = self.feature[tree], self.cut[tree], np.arange(len(x))
        node = np.zeros(len(x), np.int64)
        for _ in range(steps):
            node = 2 * node + 1 + (x[rows, f[node]] > c[node])
        return node

    def margin(self, x: np.ndarray, start: np.ndarray | None = None, since: int = 0, until: int | None = None) -> np.ndarray:
        """From ``start`` on, which holds the base and the trees before ``since``."""
        out = np.full(len(x), self.base) if start is None else start.copy()
        for t in range(since, len(self.leaf) if until is None else until):
            out += self.leaf[t][self.descend(t, x, self.depth) - (2**self.depth - 1)]
        return out

    def calibrated(self, margin: np.ndarray) -> np.ndarray:
        return _sigmoid(self.slope * margin + self.shift)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return self.calibrated(self.margin(x))


def _start(pos: int, n: int, depth: int) -> Trees:
    share = np.clip(pos / n if n else 0.5, 1e-3, 1 - 1e-3)
    return Trees(depth, float(np.log(share / (1 - share))))


def _histograms(models: list[Trees], level: int, cuts: list[np.ndarray], x: np.ndarray, fold: np.ndarray, n: np.ndarray, pos: np.ndarray, start: np.ndarray, since: int) -> np.ndarray:
    """Sums of gradients and curvatures by model, node of the newest tree's level, feature and bin. Rows of fold i count for all models but the i-th."""
    width = x.shape[1]
    out = np.zeros((len(models), 2, 2**level * width * BINS), np.int64)
    bins = np.stack([np.searchsorted(c, x[:, j], "left") + j * BINS for j, c in enumerate(cuts)], axis=1)  # values <= c[i] are in bins <= i
    for i, model in enumerate(models):
        own = np.flatnonzero(fold != i)
        mine, newest = x[own], len(model.leaf) - 1
        p = _sigmoid(model.margin(mine, start[own, i], since, newest))
        up, down, h = (np.rint(v * UNIT).astype(np.int64) for v in (p, 1 - p, np.maximum(p * (1 - p), 1e-6)))
        node = model.descend(newest, mine, level) - (2**level - 1)
        at = (node[:, None] * (width * BINS) + bins[own]).ravel()
        np.add.at(out[i, 0], at, np.repeat((n[own] - pos[own]) * up - pos[own] * down, width))
        np.add.at(out[i, 1], at, np.repeat(n[own] * h, width))
    return np.moveaxis(out.reshape(len(models), 2, 2**level, width, BINS), 1, -1)


def _split(model: Trees, level: int, sums: np.ndarray, cuts: list[np.ndarray], rate: float, lam: float) -> None:
    """The best split of each node of a level of the newest tree, and below the last level its leaves."""
    none = np.arange(BINS - 1)[None] >= np.array([len(c) for c in cuts])[:, None]
    for k, (g, h) in enumerate(zip(sums[..., 0] / UNIT, sums[..., 1] / UNIT, strict=True)):
        gs, hs = g[0].sum(), h[0].sum()
        gl, hl = (np.cumsum(v, axis=1)[:, :-1] for v in (g, h))
        gain = np.where(none, -np.inf, gl**2 / (hl + lam) + (gs - gl) ** 2 / (hs - hl + lam) - gs**2 / (hs + lam))
        j, i = np.unravel_index(gain.argmax(), gain.shape)
        left = gs, hs
        if gain[j, i] > 1e-9:
            at = 2**level - 1 + k
            model.feature[-1][at], model.cut[-1][at], left = j, cuts[j][i], (gl[j, i], hl[j, i])
        if level == model.depth - 1:
            model.leaf[-1][2 * k : 2 * k + 2] = [-rate * a / (b + lam) for a, b in (left, (gs - left[0], hs - left[1]))]


def _add_trees(models: list[Trees], cuts: list[np.ndarray], sums: Callable[[int], np.ndarray], rate: float, lam: float) -> None:
    """One more tree for each model; ``sums`` gives the histograms of a level."""
    depth = models[0].depth
    for m in models:
        m.feature.append(np.zeros(2**depth - 1, np.int64))
        m.cut.append(np.full(2**depth - 1, np.inf))
        m.leaf.append(np.zeros(2**depth))
    for level in range(depth):
        for m, own in zip(models, sums(level), strict=True):
            _split(m, level, own, cuts, rate, lam)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = 40, depth: int = 3, rate: float = 0.3, lam: float = 1.0) -> Trees:
    """Newton boosting on the log loss; splits at up to 32 quantiles of each feature; every fourth row is kept aside for calibration."""
    aside = np.arange(len(y)) % 4 == 3
    if aside.all() or not aside.any() or len(np.unique(y[aside])) < 2:
        aside = np.zeros(len(y), bool)
    tx, ty = x[~aside], y[~aside].astype(np.int64)
    cuts = [np.unique(np.quantile(tx[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
    model = _start(ty.sum(), len(ty), depth)
    one, none = np.ones(len(ty), np.int64), np.full(len(ty), -1)
    for _ in range(rounds):
        _add_trees([model], cuts, lambda level: _histograms([model], level, cuts, tx, none, one, ty, np.full((len(ty), 1), model.base), 0), rate, lam)
    if aside.any():
        _calibrate(model, model.margin(x[aside]), y[aside].astype(float))
    return model


def fit_table(rows: DataFrame, folds: int, rounds: int = 40, depth: int = 3, rate: float = 0.3, lam: float = 1.0) -> tuple[Trees, pd.DataFrame] | None:
    """Trees of all of ``rows``, and how their margins tell the classes apart; None if there are rows of one class or none.

    ``rows`` are distinct (x array<float>, fold int from 0, n and pos bigint: rows of both classes, and those of class 1), read once for each level
    of a tree. Beside the trees of all rows, as many more are grown without one fold each; these judge the fold that they haven't seen, and
    the calibration follows from all rows, so judged. The tally has, for each value of the first feature and each thousandth of the margin (clipped at 30), n and pos.
    What reaches the driver is bounded by features, bins and these steps.
    """
    first = rows.select(F.size("x").alias("width")).first()
    if first is None:
        return None
    seen = [F.sum(F.when(F.col("fold") != k, F.col(c))).alias(f"{c}{k}") for k in range(folds + 1) for c in ("n", "pos")]
    quantiles = [F.percentile(F.col("x")[j].cast("double"), [k / BINS for k in range(1, BINS)], F.col("n")).alias(f"q{j}") for j in range(first.width)]
    got = rows.agg(*seen, *quantiles).first()
    if not 0 < got[f"pos{folds}"] < got[f"n{folds}"]:
        return None
    cuts = [np.unique(got[f"q{j}"]) for j in range(first.width)]
    models = [_start(got[f"pos{k}"] or 0, got[f"n{k}"] or 0, depth) for k in range(folds + 1)]
    rows, since = rows.withColumn("m", F.array(*[F.lit(m.base) for m in models])), 0
    for t in range(rounds):
        _add_trees(models, cuts, lambda level: _sums(rows, models, level, cuts, since), rate, lam)  # noqa: B023
        if (t + 1) % WRITE_EVERY == 0 and t + 1 < rounds:
            rows, since = materialize(_with_margins(rows, models, since), "margins"), t + 1
    judged = _with_margins(rows, models, since).select(F.col("x")[0].alias("first"), F.rint(F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.get("m", "fold"))) * STEPS).cast("int").alias("m"), "n", "pos")
    tally = judged.groupBy("first", "m").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos")).toPandas().sort_values(["first", "m"], ignore_index=True)
    tally["m"] = tally["m"] / STEPS
    _calibrate(models[-1], *(tally[c].to_numpy(float) for c in ("m", "pos", "n")))
    return models[-1], tally


def _arrays(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """x, fold, n, pos, m"""
    flat = lambda c: c.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(b.num_rows, -1)
    return flat(b.column("x")), *(b.column(c).to_numpy() for c in ("fold", "n", "pos")), flat(b.column("m"))


def _sums(rows: DataFrame, models: list[Trees], level: int, cuts: list[np.ndarray], since: int) -> np.ndarray:
    shape = len(models), 2**level, len(cuts), BINS, 2

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape, np.int64)
        for b in batches(it, 50_000):
            total += _histograms(models, level, cuts, *_arrays(b), since)
        total = total.reshape(-1, 2)
        at = np.flatnonzero(total.any(axis=1))
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at, 0]), pa.array(total[at, 1])], names=["at", "g", "h"])

    got = rows.select("x", "fold", "n", "pos", "m").mapInArrow(run, "at bigint, g bigint, h bigint").groupBy("at").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).toPandas()
    out = np.zeros((int(np.prod(shape[:-1])), 2), np.int64)
    out[got["at"].to_numpy(np.int64)] = got[["g", "h"]].to_numpy(np.int64)
    return out.reshape(shape)


def _with_margins(rows: DataFrame, models: list[Trees], since: int) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches(it, 50_000):
            x, *_, start = _arrays(b)
            m = np.stack([model.margin(x, start[:, i], since) for i, model in enumerate(models)], axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(m.tolist(), pa.list_(pa.float64()))], names=["x", "fold", "n", "pos", "m"])

    return rows.select("x", "fold", "n", "pos", "m").mapInArrow(run, "x array<float>, fold int, n bigint, pos bigint, m array<double>")


def _calibrate(model: Trees, m: np.ndarray, pos: np.ndarray, n: np.ndarray | float = 1.0) -> None:
    """Platt scaling with smoothed targets, by Newton steps; of ``n`` rows with a margin, ``pos`` are of class 1."""
    yes, no = pos.sum(), (n - pos).sum()
    t = pos * (yes + 1) / (yes + 2) + (n - pos) / (no + 2)
    w = np.array([1.0, 0.0])
    z = np.stack([m, np.ones(len(m))], axis=1)
    for _ in range(30):
        p = _sigmoid(z @ w)
        hess = (z * (n * p * (1 - p))[:, None]).T @ z + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, z.T @ (n * p - t) + 1e-3 * (w - [1.0, 0.0]))
        w = w - np.clip(step, -1, 1)
    model.slope, model.shift = float(w[0]), float(w[1])


def threshold(p: np.ndarray, y: np.ndarray, precision: float, n: np.ndarray | float = 1.0) -> float:
    """The least probability from which on the rows' precision is at least ``precision``; above 1 if there is none. ``n``: rows with a probability, of which ``y`` are of class 1."""
    order = np.argsort(-p, kind="stable")
    hit, rows = np.cumsum(y[order]), np.cumsum(np.broadcast_to(n, p.shape)[order])
    good = np.flatnonzero((hit / rows >= precision) & np.append(np.diff(p[order]) < 0, True))
    return float(p[order][good[-1]]) if len(good) else 1.1
