"""Gaussian mixtures of many groups and many numbers of components at once.

Rows stay where they are. A step sends all mixtures' parameters to the tasks, and each task sends back sums over its rows:
for every mixture the log-likelihood and, for every component, its share of the rows, of their values and of their
squares. Parameters depend on groups, components and width, never on the rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Added to variances, so that a component on equal rows has one; log-likelihood a row that a step has to add; steps at most.
FLOOR, LEAST_GAIN, STEPS = 1e-4, 1e-3, 200
#: Rows of a group on which its mixtures start, those with the smallest hashes.
START_ROWS = 2000


@dataclass
class Mixture:
    """Weights, means and covariances; these are matrices if full, else variances."""

    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray

    @property
    def full(self) -> bool:
        return self.covariances.ndim == 3

    def free(self) -> int:
        k, w = self.means.shape
        return k - 1 + k * w + k * (w * (w + 1) // 2 if self.full else w)

    def densities(self, x: np.ndarray) -> np.ndarray:
        """Log of weight times density of each row in each component."""
        out = np.empty((len(x), len(self.means)))
        for j, (mean, c) in enumerate(zip(self.means, self.covariances, strict=True)):
            d = x - mean
            if self.full:
                root = np.linalg.cholesky(c)
                z, size = np.linalg.solve(root, d.T).T, 2 * np.log(np.diag(root)).sum()
            else:
                z, size = d / np.sqrt(c), np.log(c).sum()
            out[:, j] = np.log(self.weights[j]) - 0.5 * (z * z).sum(axis=1) - 0.5 * (size + x.shape[1] * math.log(2 * math.pi))
        return out

    def posteriors(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(posterior of each component, log-likelihood) of each row."""
        said = self.densities(x)
        high = said.max(axis=1, keepdims=True)
        row = high[:, 0] + np.log(np.exp(said - high).sum(axis=1))
        return np.exp(said - row[:, None]), row

    def sums(self, x: np.ndarray) -> np.ndarray:
        """What a step needs of some rows, in one line: log-likelihood, rows, and of each component the sums of posteriors, values and squares."""
        p, row = self.posteriors(x)
        squares = np.einsum("nk,ni,nj->kij", p, x, x, optimize=True) if self.full else p.T @ (x * x)
        return np.concatenate(([row.sum(), len(x)], p.sum(axis=0), (p.T @ x).ravel(), squares.ravel()))


def stepped(line: np.ndarray, k: int, width: int, full: bool) -> Mixture:
    """The mixture with the largest likelihood for the posteriors that were summed up."""
    n = line[2 : 2 + k] + 10 * np.finfo(float).eps
    means = line[2 + k : 2 + k + k * width].reshape(k, width) / n[:, None]
    squares = line[2 + k + k * width :]
    if full:
        covariances = squares.reshape(k, width, width) / n[:, None, None] - means[:, :, None] * means[:, None, :] + FLOOR * np.eye(width)
    else:
        covariances = np.maximum(squares.reshape(k, width) / n[:, None] - means**2, 0) + FLOOR
    return Mixture(n / n.sum(), means, covariances)


def start(sample: np.ndarray, k: int, full: bool, seed: int) -> Mixture:
    """From centres that are far from each other, moved to the means of what is nearest."""
    random = np.random.default_rng([seed, k])
    centres = sample[[random.integers(len(sample))]]
    while len(centres) < k:
        far = ((sample[:, None] - centres[None]) ** 2).sum(axis=2).min(axis=1)
        centres = np.concatenate((centres, sample[[random.choice(len(sample), p=far / far.sum()) if far.sum() > 0 else random.integers(len(sample))]]))
    for _ in range(10):
        nearest = ((sample[:, None] - centres[None]) ** 2).sum(axis=2).argmin(axis=1)
        centres = np.stack([sample[nearest == j].mean(axis=0) if (nearest == j).any() else centres[j] for j in range(k)])
    p = np.eye(k)[nearest]
    squares = np.einsum("nk,ni,nj->kij", p, sample, sample, optimize=True) if full else p.T @ (sample * sample)
    return stepped(np.concatenate(([0, len(sample)], p.sum(axis=0), (p.T @ sample).ravel(), squares.ravel())), k, sample.shape[1], full)


def _points(batch: pa.RecordBatch) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(rows, values) of each group of a batch with ``g`` and ``x`` as its first columns."""
    groups, x = batch.column(0).to_numpy(), batch.column(1)
    out = {}
    for g in np.unique(groups).tolist():
        at = np.flatnonzero(groups == g)
        out[g] = at, x.take(pa.array(at)).flatten().to_numpy().reshape(len(at), -1)
    return out


def _summed(rows: DataFrame, work) -> dict[tuple[int, int], np.ndarray]:
    """``work(group, values)`` gives ``(k, line)``; lines of one group and k are added up over all rows."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            for g, (_, x) in _points(batch).items():
                for k, line in work(g, x):
                    held[g, k] = held[g, k] + line if (g, k) in held else line
        for (g, k), line in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([g], pa.int32()), pa.array([k], pa.int32()), pa.array([line.tolist()], pa.list_(pa.float64()))], ["g", "k", "line"])

    lines = rows.select("g", "x").mapInArrow(run, "g int, k int, line array<double>").select("g", "k", F.posexplode("line").alias("i", "v"))
    found = lines.groupBy("g", "k", "i").agg(F.sum("v").alias("v")).groupBy("g", "k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda s: s["v"]).alias("line"))
    return {(r["g"], r["k"]): np.array(r["line"]) for r in found.collect()}


def axes(rows: DataFrame, most: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """(mean, main axes) of the rows (g, x) of each group; the largest part of an axis is positive."""
    moments = _summed(rows, lambda g, x: [(0, np.concatenate(([len(x)], x.sum(axis=0), (x.T @ x).ravel())))])
    out = {}
    for (g, _), line in moments.items():
        n, width = int(line[0]), int((math.isqrt(4 * len(line) - 3) - 1) // 2)
        mean = line[1 : 1 + width] / n
        _, found = np.linalg.eigh(line[1 + width :].reshape(width, width) / n - np.outer(mean, mean))
        found = found[:, ::-1][:, : max(1, min(most, n - 1, width))].T
        out[g] = mean, found * np.sign(found[np.arange(len(found)), np.abs(found).argmax(axis=1)])[:, None]
    return out


def projected(rows: DataFrame, along: dict[int, tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """Rows (g, x, id) with ``x`` along the axes of their group."""

    def run(batches):
        for batch in batches:
            for g, (at, x) in _points(batch).items():
                mean, found = along[g]
                flat = (x - mean) @ found.T
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(at), pa.int32()), pa.array(list(flat), pa.list_(pa.float64())), batch.column(2).take(pa.array(at))], ["g", "x", "id"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("g", "x", "id").mapInArrow(run, f"g int, x array<double>, id {kind}")


def fitted(rows: DataFrame, most: dict[int, int], full: bool, seed: int = 0) -> dict[int, Mixture]:
    """For each group of rows (g, x) the mixture of two to ``most`` components, fewer than rows, with the least BIC; none for groups of fewer than three rows.

    All mixtures take their steps together, and one that gains no more stands still. ``rows`` is read once a step.
    """
    nth = F.row_number().over(Window.partitionBy("g").orderBy(F.xxhash64("x"), "x"))
    sample: dict[int, list] = {}
    for r in rows.select("g", "x").withColumn("n", nth).where(F.col("n") <= START_ROWS).collect():
        sample.setdefault(r["g"], []).append(r["x"])
    now: dict[tuple[int, int], Mixture] = {}
    for g, x in sample.items():
        x = np.array(sorted(x))
        now |= {(g, k): start(x, k, full, seed) for k in range(2, min(most[g], len(x) - 1) + 1)}
    least, before = {}, {}
    active = set(now)
    for _ in range(STEPS + 1):
        if not active:
            break
        moving: dict[int, list] = {}
        for g, k in sorted(active):
            moving.setdefault(g, []).append((k, now[g, k]))
        for (g, k), line in _summed(rows, lambda g, x, moving=moving: [(k, m.sums(x)) for k, m in moving.get(g, [])]).items():
            mixture, likelihood, n = now[g, k], line[0], line[1]
            least[g, k] = mixture.free() * math.log(n) - 2 * likelihood
            if abs(likelihood / n - before.get((g, k), -math.inf)) < LEAST_GAIN:
                active.discard((g, k))
            else:
                before[g, k] = likelihood / n
                now[g, k] = stepped(line, k, mixture.means.shape[1], full)
    # one that still moves has the BIC of the step before its last
    best: dict[int, tuple[float, int]] = {}
    for (g, k), bic in least.items():
        best[g] = min(best.get(g, (math.inf, 0)), (bic, k))
    return {g: now[g, k] for g, (_, k) in best.items()}


def members(rows: DataFrame, mixtures: dict[int, Mixture], membership: float) -> DataFrame:
    """``(g, component, id, weight)``: each row (g, x, id) with every component that has this posterior or more."""

    def run(batches):
        for batch in batches:
            for g, (at, x) in _points(batch).items():
                if g in mixtures:
                    p, _ = mixtures[g].posteriors(x)
                    row, component = np.nonzero(p >= membership)
                    yield pa.RecordBatch.from_arrays([pa.array([g] * len(row), pa.int32()), pa.array(component, pa.int32()), batch.column(2).take(pa.array(at[row])), pa.array(p[row, component])], ["g", "component", "id", "weight"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.select("g", "x", "id").mapInArrow(run, f"g int, component int, id {kind}, weight double")
