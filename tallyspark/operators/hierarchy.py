"""A conditional logit of three levels: everybody's weights, a category's deviation and a customer's deviation.

The joint posterior is raised block by block: everybody's weights, then all categories, then all customers, each by a
Newton step of its own with the other levels as they are. Categories' and customers' deviations are state tables, joined
to the events by key; a pass adds up curvature by key, in each task first, so a key that holds many events is no group.
Events and customers' states are stored in buckets of the customer, so this join needs no exchange.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.shared import Scratch
from .models import packed

LEVELS = ("global", "category", "customer")


def _numbers(batch: pa.RecordBatch, column: str, k: int) -> np.ndarray:
    """A row of k numbers for each row of a batch, zeros where there is none."""
    lists = batch.column(column)
    out = np.zeros((batch.num_rows, k))
    there = np.flatnonzero(lists.is_valid().to_numpy(zero_copy_only=False))
    if len(there):
        out[there] = lists.drop_null().flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    return out


def _by_event(batch: pa.RecordBatch, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every event of a batch, under its own weights ``w``: loss, gradient, Hessian (k * k)."""
    k = w.shape[1]
    sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False) // k
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, k)
    starts = np.cumsum(sizes) - sizes
    s = (x * np.repeat(w, sizes, axis=0)).sum(1)
    s -= np.repeat(np.maximum.reduceat(s, starts), sizes)
    e = np.exp(s)
    total = np.add.reduceat(e, starts)
    p = e / np.repeat(total, sizes)
    own = starts + batch.column("own").to_numpy(zero_copy_only=False)
    mean = np.add.reduceat(x * p[:, None], starts)
    outer = np.add.reduceat((x * p[:, None])[:, :, None] * x[:, None, :], starts) - mean[:, :, None] * mean[:, None, :]
    weight = batch.column("weight").to_numpy(zero_copy_only=False)
    return weight * (np.log(total) - s[own]), weight[:, None] * (mean - x[own]), (weight[:, None, None] * outer).reshape(-1, k * k)


@dataclass
class HierarchicalLogit:
    """names: features; sigma, tau, nu: deviations of the normal priors of everybody's weights, a category's and a
    customer's deviations. ``fit`` takes alternatives in long form with customer_id and a category that is the same for
    all alternatives of an event, and may have a weight for each event; ``history`` has the joint log posterior after
    each pass, which never falls. A customer or category that is new gets no deviation.
    """

    names: list[str]
    sigma: float = 10.0
    tau: float = 1.0
    nu: float = 0.5
    rounds: int = 20
    tolerance: float = 1e-5
    buckets: int = 8
    category: str = "event_category"
    history: list[float] = field(default_factory=list)

    def events(self, alternatives: DataFrame) -> DataFrame:
        """One row an event: keys, features by position, place of the choice, weight."""
        weight = F.col("weight").cast("double") if "weight" in alternatives.columns else F.lit(1.0)
        keys = alternatives.groupBy("event_id").agg(F.first("customer_id").alias("customer_id"), F.first(self.category).alias("category"), F.first(weight).alias("weight"))
        return packed(alternatives, self.names).join(keys, "event_id")

    def fit(self, training: DataFrame) -> HierarchicalLogit:
        spark = training.sparkSession
        self._scratch, k = Scratch(spark), len(self.names)
        self._rows = self._scratch.bucketed(self.events(training), "hierarchy_events", "customer_id", self.buckets)
        self.weights, self.history = np.zeros(k), []
        self._tables: dict[str, tuple[Scratch, DataFrame] | None] = {"category": None, "customer": None}
        self._shares: dict[str, float] = {}
        before, low, level, tried = -np.inf, -np.inf, 0, 0
        last = (lambda share: None), 1.0  # how to take back part of the last block's step, and how much of it stands
        while True:
            scratch, sums = self._pass(LEVELS[level])
            posterior = -(sums.agg(F.sum("loss")).first()[0] or 0.0) - self._penalty()
            if posterior < before - 1e-9 * abs(before) and tried < 20:
                last[0](last[1] / 2)
                last, tried = (last[0], last[1] / 2), tried + 1
                scratch.clear()
                continue
            self.history.append(posterior)
            before, tried = posterior, 0
            done = len(self.history) > self.rounds * len(LEVELS)
            if level == 0:
                done = done or posterior - low <= self.tolerance * abs(posterior)
                low = posterior
            if done:
                scratch.clear()
                break
            last = self._step(LEVELS[level], scratch, sums), 1.0
            level = (level + 1) % len(LEVELS)
        self.posterior = posterior
        return self

    # --- passes and steps

    def _joined(self, rows: DataFrame) -> DataFrame:
        for name in ("customer", "category"):
            key, table = f"{name}_id" if name == "customer" else name, self._tables[name]
            rows = rows.withColumn(f"w_{name}", F.lit(None).cast("array<double>")) if table is None else rows.join(self.deviations(name).withColumnsRenamed({"w": f"w_{name}", "key": key}), key, "left")
        return rows

    def deviations(self, level: str) -> DataFrame:
        """(key, w): the state table of a level, as it stands."""
        table = self._tables[level]
        if table is None:
            raise ValueError("not fitted")
        share = self._shares[level]
        # All of a step stands but where the posterior fell.
        w = F.col("new") if share == 1.0 else F.zip_with("old", "new", lambda a, b: a + share * (b - a))
        return table[1].select("key", w.alias("w"))

    def _penalty(self) -> float:
        out = float(self.weights @ self.weights) / (2 * self.sigma**2)
        for level, width in (("category", self.tau), ("customer", self.nu)):
            if self._tables[level] is not None:
                squares = self.deviations(level).agg(F.sum(F.aggregate("w", F.lit(0.0), lambda a, b: a + b * b))).first()[0]
                out += (squares or 0.0) / (2 * width**2)
        return out

    def _pass(self, level: str) -> tuple[Scratch, DataFrame]:
        """Loss, gradient and Hessian by key of a level, stored: (key, old, loss, out)."""
        k, everybody = len(self.names), self.weights
        key = {"global": F.lit(""), "category": F.col("category"), "customer": F.col("customer_id")}[level]
        rows = self._joined(self._rows).withColumn("key", key)
        own = f"w_{level}"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                state = {c: _numbers(batch, c, k) for c in ("w_category", "w_customer")}
                loss, grad, hess = _by_event(batch, everybody + state["w_category"] + state["w_customer"])
                coded = batch.column("key").dictionary_encode(null_encoding="encode")
                code = coded.indices.to_numpy(zero_copy_only=False)
                order = np.argsort(code, kind="stable")
                at = np.flatnonzero(np.diff(code[order], prepend=-1))
                sums = np.add.reduceat(np.column_stack((loss, grad, hess))[order], at)
                old = state[own][order][at] if own in state else np.zeros((len(at), k))
                yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(code[order][at])), pa.array(list(old), pa.list_(pa.float64())), pa.array(list(sums), pa.list_(pa.float64()))], names=["key", "old", "out"])

        parts = rows.select("key", "x", "own", "weight", "w_category", "w_customer").mapInArrow(run, "key string, old array<double>, out array<double>")
        added = [F.sum(F.col("out")[i]) for i in range(1 + k + k * k)]
        sums = parts.groupBy("key").agg(F.first("old").alias("old"), F.array(*added).alias("out")).select("key", "old", F.col("out")[0].alias("loss"), "out")
        scratch = Scratch(self._rows.sparkSession)
        return scratch, scratch.stored(sums, f"hierarchy_{level}")

    def _step(self, level: str, scratch: Scratch, sums: DataFrame):
        """Takes a level's Newton step; gives a function that leaves only a share of it."""
        k = len(self.names)
        if level == "global":
            r = sums.first()
            old = self.weights
            if r is not None:
                out, hold = np.array(r["out"]), 1 / self.sigma**2
                self.weights = old - np.linalg.solve(out[1 + k :].reshape(k, k) + hold * np.eye(k), out[1 : 1 + k] + hold * old)
            new = self.weights
            scratch.clear()

            def part(share: float) -> None:
                self.weights = old + share * (new - old)

            return part
        hold = 1 / {"category": self.tau, "customer": self.nu}[level] ** 2

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    old, out = _numbers(batch, "old", k), _numbers(batch, "out", 1 + k + k * k)
                    hess = out[:, 1 + k :].reshape(-1, k, k) + hold * np.eye(k)
                    new = old - np.linalg.solve(hess, (out[:, 1 : 1 + k] + hold * old)[:, :, None])[:, :, 0]
                    yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("old"), pa.array(list(new), pa.list_(pa.float64()))], names=["key", "old", "new"])

        made = Scratch(self._rows.sparkSession)
        table = sums.filter("key IS NOT NULL").select("key", "old", "out").mapInArrow(solve, "key string, old array<double>, new array<double>")
        table = made.bucketed(table, "hierarchy_customers", "key", self.buckets) if level == "customer" else made.stored(table, "hierarchy_categories")
        before = self._tables[level]
        self._tables[level], self._shares = (made, table), {**self._shares, level: 1.0}
        scratch.clear()
        if before is not None:
            before[0].clear()

        def part(share: float) -> None:
            self._shares = {**self._shares, level: share}

        return part

    # --- use

    def score(self, alternatives: DataFrame) -> DataFrame:
        keyed = alternatives.withColumn("_category", F.col(self.category))
        for level, key in (("category", "_category"), ("customer", "customer_id")):
            table = self._tables[level]
            keyed = keyed.withColumn(f"_w_{level}", F.lit(None).cast("array<double>")) if table is None else keyed.join(self.deviations(level).withColumnsRenamed({"key": key, "w": f"_w_{level}"}), key, "left")
        out = F.lit(0.0)
        for i, n in enumerate(self.names):
            w = F.lit(float(self.weights[i])) + F.coalesce(F.col("_w_category")[i], F.lit(0.0)) + F.coalesce(F.col("_w_customer")[i], F.lit(0.0))
            out = out + F.col(n) * w
        return keyed.withColumn("score", out).drop("_category", "_w_category", "_w_customer")

    def clear(self) -> None:
        """Drops the stored tables, once nothing is scored any more."""
        self._scratch.clear()
        for table in self._tables.values():
            if table is not None:
                table[0].clear()


def tuned(training: DataFrame, validation: DataFrame, names: list[str], sigmas: tuple[float, ...] = (5.0, 10.0, 20.0), taus: tuple[float, ...] = (0.5, 1.0, 2.0), nus: tuple[float, ...] = (0.25, 0.5, 1.0, 2.0), **options) -> tuple[HierarchicalLogit, list[dict]]:
    """(the fit whose priors give validation events the greatest likelihood, a row for each setting of the grid)."""
    from . import metrics

    best, rows = None, []
    for sigma, tau, nu in product(sigmas, taus, nus):
        model = HierarchicalLogit(names, sigma, tau, nu, **options).fit(training)
        nll = metrics.per_event(model.score(validation)).agg(F.avg("nll")).first()[0]
        rows.append({"sigma": sigma, "tau": tau, "nu": nu, "nll": nll, "posterior": model.posterior})
        if best is None or nll < best[0]:
            if best is not None:
                best[1].clear()
            best = nll, model
        else:
            model.clear()
    return best[1], rows
