"""A model of detection pairs: weighted logistic regression on pair features, fitted by sums in SQL.

Every round is one aggregation. The gradient, the curvature and the loss are sums
over rows, taken map-side, so one row of (k + 1)(k + 4) / 2 + 1 numbers comes back
whatever the number of pairs. Scores are plain column expressions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Geometry and scores of both ends, as ``pairs.edge_pairs`` gives them.
FEATURES = ("d", "dz", "dy", "dx", "score_i", "score_j")


@dataclass(frozen=True)
class PairModel:
    """Weights of standardised features, the constant first."""

    features: tuple[str, ...]
    means: tuple[float, ...]
    deviations: tuple[float, ...]
    weights: tuple[float, ...]
    loss: float
    rounds: int

    def inputs(self) -> list[Column]:
        scaled = [(F.col(c).cast("double") - F.lit(m)) / F.lit(s) for c, m, s in zip(self.features, self.means, self.deviations, strict=True)]
        return [F.lit(1.0), *scaled]

    def logit(self, weights=None) -> Column:
        return _sum(F.lit(float(w)) * x for w, x in zip(self.weights if weights is None else weights, self.inputs(), strict=True))

    def probability(self) -> Column:
        """Null where a feature is null or not finite."""
        return F.when(_usable(self.features), 1 / (1 + F.exp(-self.logit())))


def _sum(columns) -> Column:
    return reduce(lambda a, b: a + b, columns)


def _usable(features: tuple[str, ...]) -> Column:
    """Every feature is there and finite (infinite ones and NaN give NaN less themselves)."""
    rests = (F.col(c).cast("double") - F.col(c).cast("double") for c in features)
    return reduce(lambda a, b: a & b, [F.coalesce(r == 0, F.lit(False)) for r in rests])


def fit(pairs: DataFrame, features: tuple[str, ...] = FEATURES, label: str = "label", positive_weight: float = 5.0, ridge: float = 1e-3, rounds: int = 50, tolerance: float = 1e-10) -> PairModel:
    """Least loss: the sum of weighted log losses plus ``ridge`` / 2 times the squared weights without the constant.

    Newton steps, halved while the loss does not fall. Rows whose label is neither 0 nor 1 or whose features are null or
    not finite are left out; a feature without spread gets weight 0; without rows, or with one label only, it raises.
    ``pairs`` is read once a round, so a dear plan is best written to a table before.
    """
    features = tuple(features)
    rows = pairs.where(_usable(features) & F.col(label).isin(0, 1)).select(F.col(label).cast("double").alias("_y"), *[F.col(c).cast("double").alias(c) for c in features])
    about = rows.agg(F.count("*").alias("n"), F.sum("_y").alias("positive"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(features)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(features)]).first()
    if not about.n or about.positive in (0, about.n):
        raise ValueError("pairs of both labels are needed")
    k = len(features)
    means, spread = ([float(about[f"{p}{i}"]) for i in range(k)] for p in "ms")
    constant = [s <= 1e-12 * max(1.0, abs(m)) for m, s in zip(means, spread, strict=True)]
    model = PairModel(features, tuple(means), tuple(1.0 if c else s for c, s in zip(constant, spread, strict=True)), (0.0,) * (k + 1), np.inf, 0)
    penalty = np.array([0.0, *[ridge] * k])
    free = np.array([True, *[not c for c in constant]])
    weights, step = np.zeros(k + 1), np.zeros(k + 1)
    best = None
    for done in range(1, rounds + 1):
        tried = weights + step
        loss, gradient, curvature = _sums(rows, model, tried, positive_weight)
        loss += float(penalty @ tried**2) / 2
        if best is not None and loss > best + 1e-12 * abs(best):
            step = step / 2
            if np.abs(step).max() < tolerance:
                break
            continue
        weights, best = tried, loss
        gradient = gradient - penalty * weights
        curvature = curvature + np.diag(penalty)
        step = np.zeros(k + 1)
        step[free] = np.linalg.solve(curvature[np.ix_(free, free)], gradient[free])
        if np.abs(step).max() < tolerance:
            break
    else:
        raise RuntimeError("the fit did not settle")
    return PairModel(features, model.means, model.deviations, tuple(float(w) for w in weights), best, done)


def _sums(rows: DataFrame, model: PairModel, weights: np.ndarray, positive_weight: float) -> tuple[float, np.ndarray, np.ndarray]:
    """Loss, its negative gradient and its curvature at the weights: one row of sums."""
    k = len(weights)
    table = rows.select("_y", model.logit(weights).alias("_z"), *[x.alias(f"_x{i}") for i, x in enumerate(model.inputs())])
    y, z, p = F.col("_y"), F.col("_z"), F.col("_p")
    table = table.withColumn("_p", 1 / (1 + F.exp(-z))).withColumn("_w", F.when(y == 1, F.lit(positive_weight)).otherwise(F.lit(1.0)))
    slack = F.greatest(z, F.lit(0.0)) - y * z + F.log1p(F.exp(-F.abs(z)))  # the log loss, without overflow
    x = [F.col(f"_x{i}") for i in range(k)]
    at = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.sum(F.col("_w") * slack), *[F.sum(F.col("_w") * (y - p) * c) for c in x], *[F.sum(F.col("_w") * p * (1 - p) * x[i] * x[j]) for i, j in at]]
    found = np.array(table.agg(*[s.alias(f"s{i}") for i, s in enumerate(sums)]).first(), dtype=float)
    curvature = np.zeros((k, k))
    for (i, j), v in zip(at, found[1 + k :], strict=True):
        curvature[i, j] = curvature[j, i] = v
    return float(found[0]), found[1 : 1 + k], curvature
