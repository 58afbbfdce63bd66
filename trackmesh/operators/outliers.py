"""Detectors fitted on bounded samples: an isolation forest and a one-class machine with a radial kernel."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trackmesh.session import ship


def feature_rows(durations: DataFrame, timed: DataFrame) -> DataFrame:
    """(subject_id, at_ns, features): [duration, 0, 0] of stays, and [0, gap in seconds, hour] of a subject's events."""
    zero = F.lit(0.0)
    stays = durations.select("subject_id", "at_ns", F.array(F.col("duration_ns").cast("double"), zero, zero).alias("features"))
    gap = F.col("at_ns") - F.lag("at_ns").over(W.partitionBy("subject_id").orderBy("at_ns", "event_id"))
    hour = F.pmod(F.floor(F.col("at_ns") / 3_600_000_000_000), F.lit(24)).cast("double")
    events = timed.filter("subject_id is not null").withColumn("gap", gap).filter("gap > 0")
    return stays.unionByName(events.select("subject_id", "at_ns", F.array(zero, F.col("gap") / 1e9, hour).alias("features")))


def _sample(rows: DataFrame, n: int, seed: int) -> np.ndarray:
    """The n rows first by a seeded hash: the same rows in every run, a bounded number, each task keeping its own n."""
    first = rows.select("features").orderBy(F.xxhash64("features", F.lit(seed)), "features").limit(n).collect()
    return np.array([r.features for r in first], float) if first else np.zeros((0, 1))


def _mean_path(n: np.ndarray | float) -> np.ndarray:
    """Mean depth of a search among n values that fails."""
    n = np.asarray(n, float)
    m = np.maximum(n - 1, 1)
    return np.where(n > 2, 2 * (np.log(m) + np.euler_gamma) - 2 * m / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


def _score_with(rows: DataFrame, score) -> DataFrame:
    ship(rows.sparkSession)

    @F.pandas_udf("double")
    def scored(features: pd.Series) -> pd.Series:
        return pd.Series(score(np.stack(features.to_numpy()).astype(float)) if len(features) else [], dtype=float)

    return rows.withColumn("score", scored("features"))


@dataclass
class IsolationForest:
    """Trees on small samples cut at random; rows that few cuts set apart score near 1.

    At most ``trees * sample`` rows are drawn, whatever the input's size; a tree is a set of arrays, levels of one node
    after the other, so a batch of rows goes down all trees at once.
    """

    trees: int = 50
    sample: int = 64
    depth: int = 0
    seed: int = 7

    def fit(self, rows: DataFrame) -> IsolationForest:
        data = _sample(rows, self.trees * self.sample, self.seed)
        rng = np.random.default_rng(self.seed)
        size = min(self.sample, len(data))
        depth = self.depth or max(int(np.ceil(np.log2(max(size, 2)))), 1)
        nodes = 2 ** (depth + 1) - 1
        self.axis, self.cut, self.length = (np.full((self.trees, nodes), v, float) for v in (-1, 0, 0))
        for tree in range(self.trees if size else 0):
            where = {0: data[rng.choice(len(data), size, replace=len(data) < size)]}
            for node in range(nodes):
                part = where.pop(node, None)
                if part is None:
                    continue
                level = (node + 1).bit_length() - 1
                spread = np.flatnonzero(np.ptp(part, axis=0) > 0) if len(part) > 1 and level < depth else []
                if not len(spread):
                    self.length[tree, node] = level + _mean_path(len(part))
                    continue
                axis = rng.choice(spread)
                cut = rng.uniform(part[:, axis].min(), part[:, axis].max())
                self.axis[tree, node], self.cut[tree, node] = axis, cut
                below = part[:, axis] <= cut
                where[2 * node + 1], where[2 * node + 2] = part[below], part[~below]
        self.levels, self.unit = depth, max(float(_mean_path(max(size, 2))), 1e-6)
        self.empty = size == 0
        return self

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.empty:
            return np.zeros(len(x))
        tree = np.arange(self.trees)[None, :]
        at = np.zeros((len(x), self.trees), int)
        for _ in range(self.levels):
            axis = self.axis[tree, at].astype(int)
            value = np.take_along_axis(x, np.maximum(axis, 0), axis=1)
            at = np.where(axis < 0, at, 2 * at + np.where(value <= self.cut[tree, at], 1, 2))
        return 2 ** -(self.length[tree, at].mean(axis=1) / self.unit)

    def transform(self, rows: DataFrame) -> DataFrame:
        return _score_with(rows, self.scores)


@dataclass
class OneClass:
    """Mean kernel to at most ``supports`` standardised rows, less its nu-quantile among them; score 1 - sigmoid of it.

    Mean and deviation are those of all rows; the supports are a bounded sample.
    """

    nu: float = 0.1
    gamma: float = 0.0
    supports: int = 256
    seed: int = 7

    def fit(self, rows: DataFrame) -> OneClass:
        data = _sample(rows, self.supports, self.seed)
        self.ready = len(data) >= 2
        if not self.ready:
            return self
        n = data.shape[1]
        at = [F.col("features")[i] for i in range(n)]
        stats = rows.agg(*[F.avg(c) for c in at], *[F.stddev_pop(c) for c in at]).first()
        self.mean, self.std = np.array(stats[:n], float), np.maximum(np.array(stats[n:], float), 1e-6)
        self.support = (data - self.mean) / self.std
        far = self._square(self.support, self.support)[np.triu_indices(len(data), 1)]
        far = far[far > 0]
        width = float(np.median(np.sqrt(far))) if len(far) else 1.0
        self.width = self.gamma or 1 / (2 * max(width, 1e-3) ** 2)
        self.rho = 0.0
        inside = np.sort(self.decision(data))
        self.rho = float(inside[int(np.clip(self.nu, 0.01, 1.0) * (len(inside) - 1))])
        return self

    @staticmethod
    def _square(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum((a**2).sum(1)[:, None] + (b**2).sum(1)[None, :] - 2 * a @ b.T, 0)

    def decision(self, x: np.ndarray) -> np.ndarray:
        return np.exp(-self.width * self._square((x - self.mean) / self.std, self.support)).mean(axis=1) - self.rho

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 - 1 / (1 + np.exp(-self.decision(x))) if self.ready else np.zeros(len(x))

    def transform(self, rows: DataFrame) -> DataFrame:
        return _score_with(rows, self.scores)
