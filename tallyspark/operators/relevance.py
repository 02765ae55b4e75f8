"""A conditional logit whose features' relevance is learned, by stochastic variational inference.

Every weight has a normal prior with a precision of its own, every precision a Gamma prior. The posterior is taken as
independent normals of the weights and log-normals of the precisions; a step draws weights from it, takes the likelihood's
gradients at them over one slice of the events (one job for all draws), and climbs the evidence bound. What concerns the
precisions needs no data and is climbed in the driver.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .frontier import fit_many, sums
from .models import packed
from .training import Adam


def with_interactions(alternatives: DataFrame, names: list[str]) -> tuple[DataFrame, list[str]]:
    """Alternatives with the product of every two features, and all names."""
    made = {f"{a}__x__{b}": F.col(a) * F.col(b) for a, b in combinations(names, 2)}
    return alternatives.withColumns(made), [*names, *made]


@dataclass
class RelevanceLogit:
    """``relevant`` names the features whose mean precision stays below ``threshold``; the others' weights count as 0 in
    ``score``. A temperature is picked on validation events. ``bound`` has the evidence bound's estimate at each step."""

    names: list[str]
    interactions: bool = False
    steps: int = 60
    draws_a_step: int = 4
    slices: int = 4
    a0: float = 1e-3
    b0: float = 1e-3
    threshold: float = 1e3
    rate: float = 0.05
    seed: int = 0
    bound: list[float] = field(default_factory=list)

    def _columns(self, alternatives: DataFrame) -> tuple[DataFrame, list[str]]:
        return with_interactions(alternatives, self.names) if self.interactions else (alternatives, self.names)

    def fit(self, training: DataFrame, validation: DataFrame | None = None) -> RelevanceLogit:
        scratch = Scratch(training.sparkSession)
        wide, self.features = self._columns(training)
        k = len(self.features)
        stats = wide.agg(*(F.avg(n) for n in self.features), *(F.stddev_pop(n) for n in self.features)).first()
        self.mean, self.std = np.array([x or 0.0 for x in stats[:k]], float), np.array([x or 1.0 for x in stats[k:]], float)
        events = packed(self._scaled(wide), self.features).select("x", "own", F.lit(True).alias("train"), F.pmod(F.xxhash64("event_id"), F.lit(self.slices)).cast("int").alias("slice"))
        events = scratch.stored(events, "relevance", by=("slice",))
        n = {r["slice"]: r["n"] for r in events.groupBy("slice").agg(F.count("*").alias("n")).collect()}
        total = sum(n.values())
        every = list(range(k))
        # The mode and curvature under a weak prior are where the climb begins.
        (start, got), = fit_many(events, k, [every], 1e-2)[0]
        mean = start.copy()
        spread = np.log(np.sqrt(np.diag(np.linalg.inv((got.hess if got else np.zeros((k, k))) + 1e-2 * np.eye(k)))))
        place, width = -np.log(mean**2 + np.exp(2 * spread)), np.full(k, np.log(0.5))
        rng, adam = np.random.default_rng(self.seed), Adam(2 * k, self.rate, self.steps, clip=np.inf)
        late: list[np.ndarray] = []
        for step in range(self.steps if total else 0):
            place, width = self._precisions(mean, spread, place, width)
            expected = np.exp(place + np.exp(2 * width) / 2)
            s = sorted(n)[step % len(n)]
            noise = rng.normal(size=(self.draws_a_step, k))
            at = mean + np.exp(spread) * noise
            parts = sums(events.filter(F.col("slice") == s), k, [(every, w) for w in at])
            share = total / n[s]
            grads = np.array([p.grad for p in parts]) * share
            scale = np.exp(2 * spread)
            d_mean = grads.mean(0) + expected * mean
            d_spread = (grads * noise * np.exp(spread)).mean(0) + expected * scale - 1
            self.bound.append(-float(np.mean([p.loss for p in parts])) * share - self._distance(mean, spread, place, width))
            # The steps are as long as the posterior is wide.
            moved = adam.step(np.zeros(2 * k), np.concatenate((d_mean * np.exp(spread), d_spread)))
            mean, spread = mean + moved[:k] * np.exp(spread), spread + moved[k:]
            if step >= self.steps // 2:
                late.append(np.concatenate((mean, spread)))
        if late:  # the mean of the later half wavers less
            mean, spread = np.mean(late, axis=0).reshape(2, k)
            place, width = self._precisions(mean, spread, place, width)
        self.posterior_mean, self.posterior_deviation = mean, np.exp(spread)
        self.precisions = np.exp(place + np.exp(2 * width) / 2)
        self.relevant = [f for f, a in zip(self.features, self.precisions) if a < self.threshold]
        self.weights = np.where(self.precisions < self.threshold, mean, 0.0)
        self.temperature = self._temperature(validation) if validation is not None else 1.0
        scratch.clear()
        return self

    def _scaled(self, wide: DataFrame) -> DataFrame:
        return wide.withColumns({n: (F.col(n) - float(m)) / float(s) for n, m, s in zip(self.features, self.mean, self.std)})

    def _precisions(self, mean: np.ndarray, spread: np.ndarray, place: np.ndarray, width: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log-normals of the precisions that are best for the weights' normals; each has its own closed form: the
        bound is (a0 + 1/2) place - (b0 + (mean² + spread²) / 2) exp(place + width² / 2) + log width."""
        rate, shape = self.b0 + (mean**2 + np.exp(2 * spread)) / 2, self.a0 + 0.5
        # Setting both derivatives to 0 gives width² = 1 / shape and exp(place + width² / 2) = shape / rate.
        square = np.full_like(place, 1 / shape)
        return np.log(shape / rate) - square / 2, np.log(square) / 2

    def _distance(self, mean: np.ndarray, spread: np.ndarray, place: np.ndarray, width: np.ndarray) -> float:
        """Of posterior and prior, without constants."""
        expected = np.exp(place + np.exp(2 * width) / 2)
        return -float(((self.a0 + 0.5) * place - (self.b0 + (mean**2 + np.exp(2 * spread)) / 2) * expected + spread + width).sum())

    def _temperature(self, validation: DataFrame, rounds: int = 30) -> float:
        """The best of a grid over its logarithm, then of a finer one around it; a grid is one job."""
        scratch = Scratch(validation.sparkSession)
        rows = scratch.stored(packed(self._scaled(self._columns(validation)[0]), self.features).select("x", "own", F.lit(True).alias("train")), "temperature")
        grid = np.linspace(np.log(0.05), np.log(20), 2 * rounds + 1)
        every = list(range(len(self.features)))
        got = sums(rows, len(every), [(every, self.weights / np.exp(t)) for t in grid])
        best = int(np.argmin([g.loss for g in got]))
        fine = np.linspace(grid[max(best - 1, 0)], grid[min(best + 1, len(grid) - 1)], 2 * rounds + 1)
        got = sums(rows, len(every), [(every, self.weights / np.exp(t)) for t in fine])
        scratch.clear()
        return float(np.exp(fine[int(np.argmin([g.loss for g in got]))]))

    def draws(self, n: int, seed: int = 0) -> np.ndarray:
        """Draws of the weights of scaled features from their posterior."""
        return self.posterior_mean + self.posterior_deviation * np.random.default_rng(seed).normal(size=(n, len(self.features)))

    def score(self, alternatives: DataFrame) -> DataFrame:
        wide, _ = self._columns(alternatives)
        out = F.lit(0.0)
        for n, w, m, s in zip(self.features, self.weights, self.mean, self.std):
            if w:
                out = out + (F.col(n) - float(m)) * float(w / s / self.temperature)
        return wide.withColumn("score", out).select(*alternatives.columns, "score")
