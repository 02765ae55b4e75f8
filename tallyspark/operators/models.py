"""Choice models over alternatives in long form. A fitted model scores a DataFrame: event_id, alt_idx, score."""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from itertools import product

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassifier, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import stored
from .choice import uniform


@dataclass
class Popularity:
    """log(count + alpha) of the item among choices, or of the category and position where items aren't known."""

    alpha: float = 1.0
    by: tuple[str, ...] = ("asin",)

    def fit(self, training: DataFrame) -> Popularity:
        self.counts = training.filter("chosen").groupBy(*self.by).agg(F.count("*").alias("_n"))
        return self

    def score(self, alternatives: DataFrame) -> DataFrame:
        return alternatives.join(self.counts, list(self.by), "left").withColumn("score", F.log(F.coalesce("_n", F.lit(0)) + self.alpha)).drop("_n")


def _events(pdf: pd.DataFrame, k: int, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """All events of a batch at once: (summed loss, features of all alternatives, their probabilities, event means less
    the chosen features)."""
    flat = [np.asarray(x, float) for x in pdf["x"]]
    size = np.array([len(x) // k for x in flat])
    x = np.concatenate(flat).reshape(-1, k)
    starts = np.cumsum(size) - size
    s = x @ w
    s = s - np.repeat(np.maximum.reduceat(s, starts), size)
    e = np.exp(s)
    total = np.add.reduceat(e, starts)
    own = starts + pdf["own"].to_numpy()
    p = e / np.repeat(total, size)
    mean = np.add.reduceat(x * p[:, None], starts)
    return float((np.log(total) - s[own]).sum()), x, p, np.stack((mean, mean - x[own]))


def _parts(batches: Iterator[pd.DataFrame], names: list[str], w: np.ndarray) -> Iterator[pd.DataFrame]:
    """Sum of negative log likelihoods, of gradients and the number of events of a partition."""
    loss, grad, n = 0.0, np.zeros(len(w)), 0
    for pdf in batches:
        if len(pdf):
            part, _, _, means = _events(pdf, len(names), w)
            loss, grad, n = loss + part, grad + means[1].sum(0), n + len(pdf)
    yield pd.DataFrame({"loss": [loss], "grad": [grad.tolist()], "n": [n]})


def packed(alternatives: DataFrame, names: list[str]) -> DataFrame:
    """One row an event: its feature matrix by position, and the position of the choice."""
    rows = alternatives.groupBy("event_id").agg(
        F.array_sort(F.collect_list(F.struct("alt_idx", F.array(*(F.col(n).cast("double") for n in names)).alias("x"), "chosen"))).alias("a")
    )
    return rows.select("event_id", F.flatten(F.transform("a", lambda r: r["x"])).alias("x"), (F.array_position(F.transform("a", lambda r: r["chosen"]), True) - 1).cast("int").alias("own"))


def loss_and_gradient(events: DataFrame, names: list[str], w: np.ndarray) -> tuple[float, np.ndarray, int]:
    """Over all events: each partition gives one row, which add up in the driver."""
    run = lambda it: _parts(it, names, w)
    rows = events.mapInPandas(run, "loss double, grad array<double>, n long").agg(
        F.sum("loss").alias("loss"), F.array(*(F.sum(F.col("grad")[i]) for i in range(len(names)))).alias("grad"), F.sum("n").alias("n")
    )
    r = rows.first()
    n = max(int(r["n"] or 0), 1)
    return (r["loss"] or 0.0) / n, np.array([g or 0.0 for g in r["grad"]]) / n, n


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(-1, keepdims=True))
    return x / x.sum(-1, keepdims=True)


def curvature(events: DataFrame, names: list[str], w: np.ndarray, count: bool = False) -> tuple:
    """Summed negative log likelihood, gradient and Hessian over packed events, with ``count`` also their number; a
    partition gives one row."""
    k = len(names)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        loss, n, out = 0.0, 0, np.zeros(k + k * k)
        for pdf in batches:
            if len(pdf):
                part, x, p, means = _events(pdf, k, w)
                loss, n = loss + part, n + len(pdf)
                out[:k] += means[1].sum(0)
                out[k:] += ((x * p[:, None]).T @ x - means[0].T @ means[0]).ravel()
        yield pd.DataFrame({"loss": [loss], "n": [n], "out": [out.tolist()]})

    r = events.mapInPandas(run, "loss double, n long, out array<double>").agg(F.sum("loss"), F.array(*(F.sum(F.col("out")[i]) for i in range(k + k * k))), F.sum("n")).first()
    out = np.array([x or 0.0 for x in r[1]])
    found = (r[0] or 0.0, out[:k], out[k:].reshape(k, k))
    return (*found, int(r[2] or 0)) if count else found


@dataclass
class PriorLogit:
    """Conditional logit with a Gaussian prior of its own precision on every weight, by Newton steps.

    With ``relevance`` the precisions are learned: each becomes one over the weight's square and its posterior variance,
    and weights whose precision passes ``dropped`` count as irrelevant. This stands in for sampling the posterior.
    """

    names: list[str]
    precision: float | dict[str, float] = 1.0
    relevance: bool = False
    rounds: int = 8
    dropped: float = 1e4

    def fit(self, training: DataFrame) -> PriorLogit:
        events = packed(training, self.names).persist()
        try:
            a = np.array([self.precision.get(n, 1.0) if isinstance(self.precision, dict) else self.precision for n in self.names], float)
            w = np.zeros(len(a))
            for _ in range(self.rounds):
                _, grad, hess = curvature(events, self.names, w)
                full = hess + np.diag(a)
                w = w - np.linalg.solve(full, grad + a * w)
                if self.relevance:
                    a = np.minimum(1 / (w**2 + np.diag(np.linalg.inv(full))), 1e8)
            self.weights, self.precisions = w, a
            self.covariance = np.linalg.inv(full)
            self.relevant = [n for n, x in zip(self.names, a) if x < self.dropped]
            return self
        finally:
            events.unpersist()

    def draws(self, n: int, seed: int = 0) -> np.ndarray:
        """Draws of the weights from their posterior, taken as normal around its mode."""
        return np.random.default_rng(seed).multivariate_normal(self.weights, self.covariance, n, method="eigh")

    def score(self, alternatives: DataFrame) -> DataFrame:
        out = F.lit(0.0)
        for n, w in zip(self.names, self.weights):
            out = out + F.col(n) * float(w)
        return alternatives.withColumn("score", out)


@dataclass
class PersonalLogit:
    """A conditional logit whose weights differ by customer: everybody's are fitted first, then each customer's own, held
    to everybody's by a prior of some precision. Customers are fitted side by side, each in one group of bounded work;
    one who has no training event gets everybody's weights."""

    names: list[str]
    precision: float = 4.0
    rounds: int = 8

    def fit(self, training: DataFrame) -> PersonalLogit:
        self.base = PriorLogit(self.names, rounds=self.rounds).fit(training)
        k, centre, hold, rounds = len(self.names), self.base.weights, self.precision, self.rounds
        who = training.groupBy("event_id").agg(F.first("customer_id").alias("customer_id"))

        def own(pdf: pd.DataFrame) -> pd.DataFrame:
            w = centre.copy()
            for _ in range(rounds):
                _, x, p, means = _events(pdf, k, w)
                hess = (x * p[:, None]).T @ x - means[0].T @ means[0] + hold * np.eye(k)
                step = np.linalg.solve(hess, means[1].sum(0) + hold * (w - centre))
                w = w - step
                if np.abs(step).max() < 1e-6:
                    break
            return pd.DataFrame({"customer_id": [pdf["customer_id"].iloc[0]], "w": [w.tolist()]})

        rows = packed(training, self.names).join(who, "event_id")
        self.own = stored(rows.groupBy("customer_id").applyInPandas(own, "customer_id string, w array<double>"), "personal")
        return self

    def score(self, alternatives: DataFrame) -> DataFrame:
        everybody = F.array(*(F.lit(float(x)) for x in self.base.weights))
        rows = alternatives.join(self.own.withColumnRenamed("w", "_w"), "customer_id", "left").withColumn("_w", F.coalesce("_w", everybody))
        out = F.lit(0.0)
        for i, n in enumerate(self.names):
            out = out + F.col(n) * F.col("_w")[i]
        return rows.withColumn("score", out).drop("_w")


def hierarchical(alternatives: DataFrame, names: list[str], group: str, values: list[str]) -> tuple[DataFrame, list[str]]:
    """Alternatives with a deviation column for each feature and group value: shared weights plus a group's own, whose
    prior says how far groups may differ."""
    made = {f"{n}__{i}": F.when(F.col(group) == v, F.col(n)).otherwise(0.0) for n in names for i, v in enumerate(values)}
    return alternatives.withColumns(made), [*names, *made]


#: Features up to which a sparse logit takes curvature steps.
FEW_FEATURES = 30


@dataclass
class SparseLogit:
    """Conditional logit with an L1 penalty down a descending path of penalties, each started from the last; the penalty
    and a temperature are chosen on validation events, a tenth of the training ones where none are given. Few features
    take curvature steps, many take accelerated proximal ones."""

    names: list[str]
    penalties: tuple[float, ...] = (0.1, 0.03, 0.01, 0.003, 0.001)
    rounds: int = 40

    def fit(self, training: DataFrame, validation: DataFrame | None = None) -> SparseLogit:
        if validation is None:
            held = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
            training, validation = training.filter(~held), training.filter(held)
        stats = training.agg(*(F.avg(n).alias(f"m_{n}") for n in self.names), *(F.stddev_pop(n).alias(f"s_{n}") for n in self.names)).first()
        self.mean = np.array([stats[f"m_{n}"] or 0.0 for n in self.names])
        self.std = np.array([stats[f"s_{n}"] or 1.0 for n in self.names])
        train, val = (self._scaled(d).persist() for d in (training, validation))
        w, best = np.zeros(len(self.names)), (np.inf, None)
        try:
            for penalty in sorted(self.penalties, reverse=True):
                w = self._path(train, w, penalty)
                nll = loss_and_gradient(val, self.names, w)[0]
                if nll < best[0]:
                    best = (nll, w.copy())
            self.weights = best[1] if best[1] is not None else w
            lo, hi = np.log(0.01), np.log(1000.0)  # golden section over the temperature
            g = (5**0.5 - 1) / 2
            f = lambda t: loss_and_gradient(val, self.names, self.weights / np.exp(t))[0]
            a, b = hi - g * (hi - lo), lo + g * (hi - lo)
            fa, fb = f(a), f(b)
            for _ in range(10):
                if fa < fb:
                    hi, b, fb = b, a, fa
                    a = hi - g * (hi - lo)
                    fa = f(a)
                else:
                    lo, a, fa = a, b, fb
                    b = lo + g * (hi - lo)
                    fb = f(b)
            self.temperature = float(np.exp((lo + hi) / 2))
        finally:
            train.unpersist()
            val.unpersist()
        return self

    def _scaled(self, df: DataFrame) -> DataFrame:
        cols = {n: (F.col(n) - float(m)) / float(s) for n, m, s in zip(self.names, self.mean, self.std)}
        return packed(df.withColumns(cols), self.names)

    def _path(self, events: DataFrame, w: np.ndarray, penalty: float) -> np.ndarray:
        return self._newton(events, w, penalty) if len(w) <= FEW_FEATURES else self._gradient(events, w, penalty)

    def _newton(self, events: DataFrame, w: np.ndarray, penalty: float) -> np.ndarray:
        """Curvature steps: the penalised quadratic around w is solved coordinate by coordinate in the driver."""
        loss, grad, hess = self._mean(events, w)
        for _ in range(self.rounds):
            new = w.copy()
            for _ in range(200):
                before = new.copy()
                for i in range(len(w)):
                    h = hess[i, i] + 1e-9
                    z = new[i] - (grad[i] + hess[i] @ (new - w)) / h
                    new[i] = np.sign(z) * max(abs(z) - penalty / h, 0.0)
                if np.abs(new - before).max(initial=0) < 1e-9:
                    break
            step, value = 1.0, loss + penalty * np.abs(w).sum()
            while True:
                at = w + step * (new - w)
                got = self._mean(events, at)
                if got[0] + penalty * np.abs(at).sum() <= value + 1e-12 or step < 1e-4:
                    break
                step /= 2
            moved, w, (loss, grad, hess) = np.abs(at - w).max(initial=0), at, got
            if moved < 1e-5:
                break
        return w

    def _mean(self, events: DataFrame, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        loss, grad, hess, n = curvature(events, self.names, w, count=True)
        return loss / max(n, 1), grad / max(n, 1), hess / max(n, 1)

    def _gradient(self, events: DataFrame, w: np.ndarray, penalty: float) -> np.ndarray:
        step, y, t = 1.0, w.copy(), 1.0
        for _ in range(self.rounds):
            f, grad, _n = loss_and_gradient(events, self.names, y)
            while True:
                z = y - step * grad
                new = np.sign(z) * np.maximum(np.abs(z) - step * penalty, 0)
                d = new - y
                if step < 1e-6 or loss_and_gradient(events, self.names, new)[0] <= f + grad @ d + d @ d / (2 * step) + 1e-12:
                    break
                step /= 2
            t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
            y = new + (t - 1) / t_new * (new - w)
            if np.abs(new - w).max(initial=0) < 1e-4:
                return new
            w, t = new, t_new
        return w

    def score(self, alternatives: DataFrame) -> DataFrame:
        out = F.lit(0.0)
        for n, w, m, s in zip(self.names, self.weights, self.mean, self.std):
            if w:
                out = out + (F.col(n) - float(m)) / float(s) * float(w / self.temperature)
        return alternatives.withColumn("score", out)


@dataclass
class Classifier:
    """A classifier of chosen against other alternatives, each weighted by one over their number; score: its log odds.

    The perceptron knows no weights. ``options`` are the classifier's own settings.
    """

    names: list[str]
    kind: str = "forest"
    seed: int = 0
    options: dict = field(default_factory=dict)

    def fit(self, training: DataFrame) -> Classifier:
        return self._fit(self.rows(training))

    def rows(self, training: DataFrame) -> DataFrame:
        """Vectors, labels and weights, which every setting of a grid takes."""
        self.vector = VectorAssembler(inputCols=self.names, outputCol="_x", handleInvalid="error")
        weight = 1.0 / F.count("*").over(Window.partitionBy("event_id"))
        return self.vector.transform(training.withColumns({"_y": F.col("chosen").cast("double"), "_w": weight})).select("_x", "_y", "_w")

    def _fit(self, rows: DataFrame) -> Classifier:
        common = {"featuresCol": "_x", "labelCol": "_y", "seed": self.seed}
        make = {
            "forest": lambda: RandomForestClassifier(**common, weightCol="_w", **{"numTrees": 30, "maxDepth": 6, "minInstancesPerNode": 2} | self.options),
            "boosting": lambda: GBTClassifier(**common, weightCol="_w", **{"maxIter": 20, "maxDepth": 3} | self.options),
            "perceptron": lambda: MultilayerPerceptronClassifier(**common, layers=[len(self.names), *self.options.get("hidden", (16,)), 2], **{"maxIter": 60} | {k: v for k, v in self.options.items() if k != "hidden"}),
        }
        self.model = make[self.kind]().fit(rows)
        return self

    def score(self, alternatives: DataFrame) -> DataFrame:
        got = self.model.transform(self.vector.transform(alternatives))
        p = vector_to_array("probability")[1]
        odds = F.log(F.greatest(p, F.lit(1e-12))) - F.log(F.greatest(1 - p, F.lit(1e-12)))
        return got.withColumn("score", odds).select(*alternatives.columns, "score")


#: Settings that tuning tries.
GRIDS: dict[str, list[dict]] = {
    "forest": [{"numTrees": 100, "maxDepth": 6}, {"numTrees": 100, "maxDepth": 10}, {"numTrees": 300, "maxDepth": 14}],
    "boosting": [{"maxIter": 40, "maxDepth": 4, "stepSize": 0.1}, {"maxIter": 40, "maxDepth": 6, "stepSize": 0.05}, {"maxIter": 80, "maxDepth": 5, "stepSize": 0.05}],
    "perceptron": [{"hidden": (32,)}, {"hidden": (64, 32)}, {"hidden": (64, 32), "stepSize": 0.01}],
}


def tuned_classifier(names: list[str], training: DataFrame, validation: DataFrame | None = None, kind: str = "forest", grid: list[dict] | None = None, seed: int = 0, together: int = 3) -> tuple[Classifier, list[dict]]:
    """(the classifier of greatest validation likelihood, every setting with its likelihood).

    Likelihood is that of whole events: scores go through a softmax over an event's alternatives. Without validation
    events a tenth of the training events, by hash and never parts of one, is held out. The vectors are stored once; some
    settings are fitted side by side.
    """
    from concurrent.futures import ThreadPoolExecutor

    from . import metrics

    if validation is None:
        held = F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0
        training, validation = training.filter(~held), training.filter(held)
    rows = Classifier(names, kind, seed).rows(training).persist()
    validation = validation.persist()

    def one(options: dict) -> tuple[float, Classifier]:
        model = Classifier(names, kind, seed, options)
        model.vector = VectorAssembler(inputCols=names, outputCol="_x", handleInvalid="error")
        model._fit(rows)
        return metrics.per_event(model.score(validation)).agg(F.avg("nll")).first()[0], model

    try:
        with ThreadPoolExecutor(max(1, together)) as pool:
            got = list(pool.map(one, grid if grid is not None else GRIDS[kind]))
    finally:
        rows.unpersist()
        validation.unpersist()
    trials = [{**m.options, "nll": nll} for nll, m in got]
    return min(got, key=lambda x: x[0] if x[0] is not None else np.inf)[1], trials


def profiles(events: DataFrame) -> DataFrame:
    """A customer's shares by category and five scalars: repeat rate, closeness of repeats, novelty, log count, entropy."""
    n = events.groupBy("customer_id", "category").agg(F.count("*").alias("n"))
    total = n.groupBy("customer_id").agg(F.sum("n").alias("total"))
    shares = n.join(total, "customer_id").withColumn("p", F.col("n") / F.col("total"))
    long = shares.groupBy("customer_id").agg((-F.sum(F.col("p") * F.log("p"))).alias("cat_entropy"), F.map_from_entries(F.collect_list(F.struct("category", "p"))).alias("shares"))
    scalars = events.groupBy("customer_id").agg(
        F.avg((F.col("routine") > 0).cast("double")).alias("repeat_rate"), F.avg(1.0 / (1.0 + F.col("recency_days"))).alias("mean_recency"),
        F.avg((F.col("novelty") == 1).cast("double")).alias("novelty_rate"), F.log1p(F.count("*").cast("double")).alias("purchase_freq"),
    )
    return scalars.join(long, "customer_id")


SCALARS = ("repeat_rate", "mean_recency", "novelty_rate", "purchase_freq", "cat_entropy")


def standardised(df: DataFrame, columns: tuple[str, ...] | list[str]) -> DataFrame:
    """Columns less their mean over their population deviation, which counts as 1 where it is next to nothing."""
    stats = df.agg(*(F.avg(c).alias(f"_m_{c}") for c in columns), *(F.when(F.stddev_pop(c) < 1e-12, 1.0).otherwise(F.stddev_pop(c)).alias(f"_s_{c}") for c in columns))
    wide = df.crossJoin(F.broadcast(stats))  # one row
    return wide.withColumns({c: (F.col(c) - F.col(f"_m_{c}")) / F.col(f"_s_{c}") for c in columns}).drop(*stats.columns)


def leverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """leverage of each row: x' (X'X)+ x. The Gram matrix is an aggregate of few numbers."""
    k = len(columns)
    g = df.agg(*(F.sum(F.col(a) * F.col(b)).alias(f"{i}_{j}") for i, a in enumerate(columns) for j, b in enumerate(columns))).first()
    gram = np.array([g[f"{i}_{j}"] or 0.0 for i in range(k) for j in range(k)]).reshape(k, k)
    inverse = np.linalg.pinv(gram, rcond=1e-12, hermitian=True)
    out = F.lit(0.0)
    for i, a in enumerate(columns):
        for j, b in enumerate(columns):
            out = out + F.col(a) * F.col(b) * float(inverse[i, j])
    return df.withColumn("leverage", F.greatest(out, F.lit(1e-10)))


def random_subsample(events: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """(customer_id, weight 1) of n customers, those whose hashes are least."""
    ids = events.select("customer_id").distinct()
    return ids.orderBy(F.md5(F.concat(F.lit(f"{seed}|"), "customer_id").cast("binary")), "customer_id").limit(n).withColumn("weight", F.lit(1.0))


def share_columns(top: list[str]) -> list:
    """The shares of these categories, each a column, and the sum of all others' shares."""
    rest = F.map_filter("shares", lambda c, _: ~F.coalesce(c.isin(top), F.lit(False)))
    others = F.aggregate(F.map_values(rest), F.lit(0.0), lambda a, b: a + b)
    return [*(F.coalesce(F.try_element_at("shares", F.lit(c)), F.lit(0.0)).alias(f"c{i}") for i, c in enumerate(top)), F.coalesce(others, F.lit(0.0)).alias("others")]


def leverage_subsample(events: DataFrame, n: int, components: int = 20, per_cluster: int = 2, seed: int = 42, most_categories: int = 200) -> DataFrame:
    """(customer_id, weight): of each behaviour cluster the customers of greatest leverage, the rest in proportion to
    leverage; weights are inverse probabilities that sum to the number of customers.

    The draw in proportion takes the greatest keys u^(1/leverage). Categories beyond the ``most_categories`` most
    frequent share one column.
    """
    p = profiles(events)
    top = [r[0] for r in events.groupBy("category").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "category").limit(most_categories + 1).collect()]
    # Where no category is beyond the most frequent, the others' column would be zero everywhere.
    shares = share_columns(top[:most_categories])[: len(top)]
    wide = p.select("customer_id", *SCALARS, *shares).persist()
    try:
        total = wide.count()
        k = max(1, min(components, len(shares) - 1, total - 1))
        vector = VectorAssembler(inputCols=wide.columns[1 + len(SCALARS) :], outputCol="_c").transform(wide)
        pca = PCA(k=k, inputCol="_c", outputCol="_p").fit(vector)
        scores = pca.transform(vector).select("customer_id", *SCALARS, *(vector_to_array("_p")[i].alias(f"p{i}") for i in range(k)))
        columns = [*SCALARS, *(f"p{i}" for i in range(k))]
        x = leverage(standardised(scores, columns), columns)
        wanted = min(n, total)
        clusters = min(max(wanted // 5, 2), total)
        x = VectorAssembler(inputCols=columns, outputCol="_x").transform(x)
        x = KMeans(k=clusters, seed=seed, featuresCol="_x", predictionCol="cluster").fit(x).transform(x).select("customer_id", "leverage", "cluster").persist()
        rank = F.row_number().over(Window.partitionBy("cluster").orderBy(F.desc("leverage"), "customer_id"))
        sure = (rank <= per_cluster).cast("int")
        key = F.log(uniform(F.lit(seed), "customer_id")) / F.col("leverage")
        chosen = x.withColumns({"sure": sure, "key": key}).orderBy(F.desc("sure"), F.desc("key"), "customer_id").limit(wanted)
        raw = chosen.withColumn("raw", 1.0 / F.col("leverage"))
        return raw.crossJoin(F.broadcast(raw.agg(F.sum("raw").alias("_sum")))).select("customer_id", (F.col("raw") * total / F.col("_sum")).alias("weight"))
    finally:
        wide.unpersist()


@dataclass
class UtilityNet:
    """The main utility model: attribute heads over outcome vectors, person weights, salience over outcomes.

    A forward pass runs in Arrow batches over events (z, e: alternatives x outcomes x width, flat); training is Adam in
    NumPy over a bounded sample of events. Ablations: ``salience`` "uniform" instead of "net", ``weighting`` "softplus"
    instead of "softmax", and ``utility``: "concat", one hidden layer over outcome and person together, or "film", one
    over the outcome whose units the person scales and shifts, instead of "attributes".
    """

    attributes: int = 5
    outcomes: int = 3
    width: int = 64
    persons: int = 26
    hidden: int = 32
    temperature: float = 1.0
    salience: str = "net"
    weighting: str = "softmax"
    utility: str = "attributes"
    seed: int = 0

    def init(self) -> UtilityNet:
        rng = np.random.default_rng(self.seed)
        w = lambda a, b: rng.standard_normal((a, b)) * (2 / (a + b)) ** 0.5
        made = {
            "attributes": lambda: {
                "h1": w(self.width, self.hidden * self.attributes), "h2": rng.standard_normal((self.attributes, self.hidden)) * 0.1,
                "w1": w(self.persons, self.hidden), "w2": w(self.hidden, self.attributes),
            },
            "concat": lambda: {"c1": w(self.width + self.persons, self.hidden), "c2": w(self.hidden, 1)},
            "film": lambda: {"f1": w(self.width, self.hidden), "scale": w(self.persons, self.hidden), "shift": w(self.persons, self.hidden), "f2": w(self.hidden, 1)},
        }
        self.p = made[self.utility]() | {"s1": w(self.width + self.persons, self.hidden), "s2": w(self.hidden, 1)}
        return self

    @property
    def n_params(self) -> int:
        return sum(v.size for v in self.p.values())

    def forward(self, z: np.ndarray, e: np.ndarray) -> dict[str, np.ndarray]:
        """z (b, persons), e (b, j, k, width): S and U (b, j, k), V (b, j); of attributes also A (b, j, k, m), w (b, m)."""
        b, j, k, _ = e.shape
        both = np.concatenate((e, np.broadcast_to(z[:, None, None, :], (b, j, k, z.shape[1]))), -1)
        out = {"both": both, "sh": both @ self.p["s1"]}
        out["S"] = np.full((b, j, k), 1 / k) if self.salience == "uniform" else _softmax((np.maximum(out["sh"], 0) @ self.p["s2"])[..., 0])
        if self.utility == "concat":
            out["pre"] = both @ self.p["c1"]
            out["U"] = (np.maximum(out["pre"], 0) @ self.p["c2"])[..., 0]
        elif self.utility == "film":
            out["plain"], out["gain"] = e @ self.p["f1"], (1 + z @ self.p["scale"])[:, None, None, :]
            out["pre"] = out["gain"] * out["plain"] + (z @ self.p["shift"])[:, None, None, :]
            out["U"] = (np.maximum(out["pre"], 0) @ self.p["f2"])[..., 0]
        else:
            out["pre"] = (e @ self.p["h1"]).reshape(b, j, k, self.attributes, self.hidden)
            out["A"] = (np.maximum(out["pre"], 0) * self.p["h2"]).sum(-1)
            out["zh"] = z @ self.p["w1"]
            out["raw"] = np.maximum(out["zh"], 0) @ self.p["w2"]
            out["w"] = np.logaddexp(0, out["raw"]) if self.weighting == "softplus" else _softmax(out["raw"])
            out["U"] = (out["A"] * out["w"][:, None, None, :]).sum(-1)
        out["V"] = (out["S"] * out["U"]).sum(-1) / self.temperature
        return out

    def gradient(self, z: np.ndarray, e: np.ndarray, own: np.ndarray, weight: np.ndarray, weight_l2: float = 0.0) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted mean negative log likelihood (with a penalty on the person weights) and its gradient."""
        f = self.forward(z, e)
        p = _softmax(f["V"])
        rows = np.arange(len(own))
        share = weight / weight.sum()
        loss = float(-(share * np.log(np.maximum(p[rows, own], 1e-300))).sum())
        d = p.copy()
        d[rows, own] -= 1
        d = d * share[:, None] / self.temperature
        du, ds = d[:, :, None] * f["S"], d[:, :, None] * f["U"]
        g: dict[str, np.ndarray] = {}
        if self.utility == "attributes":
            loss += float(weight_l2 * (share * (f["w"] ** 2).sum(1)).sum())
            da = du[..., None] * f["w"][:, None, None, :]
            dw = (du[..., None] * f["A"]).sum((1, 2)) + 2 * weight_l2 * share[:, None] * f["w"]
            draw = dw / (1 + np.exp(-f["raw"])) if self.weighting == "softplus" else f["w"] * (dw - (f["w"] * dw).sum(-1, keepdims=True))
            g["h2"] = (da[..., None] * np.maximum(f["pre"], 0)).sum((0, 1, 2))
            dpre = da[..., None] * self.p["h2"] * (f["pre"] > 0)
            g["h1"] = e.reshape(-1, self.width).T @ dpre.reshape(-1, self.attributes * self.hidden)
            g["w2"] = np.maximum(f["zh"], 0).T @ draw
            g["w1"] = z.T @ (draw @ self.p["w2"].T * (f["zh"] > 0))
        else:
            last = "c2" if self.utility == "concat" else "f2"
            g[last] = np.maximum(f["pre"], 0).reshape(-1, self.hidden).T @ du.reshape(-1, 1)
            dpre = du[..., None] * self.p[last][:, 0] * (f["pre"] > 0)
            if self.utility == "concat":
                g["c1"] = f["both"].reshape(-1, self.width + self.persons).T @ dpre.reshape(-1, self.hidden)
            else:
                g["f1"] = e.reshape(-1, self.width).T @ (dpre * f["gain"]).reshape(-1, self.hidden)
                g["scale"] = z.T @ (dpre * f["plain"]).sum((1, 2))
                g["shift"] = z.T @ dpre.sum((1, 2))
        if self.salience == "uniform":
            g["s1"], g["s2"] = np.zeros_like(self.p["s1"]), np.zeros_like(self.p["s2"])
        else:
            dsr = (f["S"] * (ds - (f["S"] * ds).sum(-1, keepdims=True)))[..., None]
            g["s2"] = np.maximum(f["sh"], 0).reshape(-1, self.hidden).T @ dsr.reshape(-1, 1)
            dsh = dsr @ self.p["s2"].T * (f["sh"] > 0)
            g["s1"] = f["both"].reshape(-1, self.width + self.persons).T @ dsh.reshape(-1, self.hidden)
        return loss, g

    def fit(self, train: tuple, val: tuple, epochs: int = 30, batch: int = 64, rate: float = 1e-3, patience: int = 5, weight_l2: float = 0.0) -> list[float]:
        """Adam with a cosine rate and gradients cut at norm 1; ends after ``patience`` epochs without a better validation
        likelihood, and the best epoch's weights stay. train and val: (z, e, own, weight). Gives the validation curve."""
        self.init()
        rng = np.random.default_rng(self.seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(x) for k, x in self.p.items()}
        z, e, own, weight = train
        steps, step = max(1, epochs * -(-len(own) // batch)), 0
        best, kept, curve = np.inf, {k: x.copy() for k, x in self.p.items()}, []
        for _ in range(epochs):
            order = rng.permutation(len(own))
            for i in range(0, len(own), batch):
                b = order[i : i + batch]
                _, g = self.gradient(z[b], e[b], own[b], weight[b], weight_l2)
                norm = np.sqrt(sum((x**2).sum() for x in g.values()))
                step += 1
                now = rate * 0.5 * (1 + np.cos(np.pi * step / steps))
                for k, x in g.items():
                    x = x / max(norm, 1.0)
                    m[k] = 0.9 * m[k] + 0.1 * x
                    v[k] = 0.999 * v[k] + 0.001 * x * x
                    self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
            curve.append(self.gradient(val[0], val[1], val[2], np.ones(len(val[2])))[0])
            if curve[-1] < best:
                best, kept = curve[-1], {k: x.copy() for k, x in self.p.items()}
            elif len(curve) - int(np.argmin(curve)) > patience:
                break
        self.p = kept
        return curve

    def parts(self, events: DataFrame) -> DataFrame:
        """What an attribute net's utilities are made of: for each event, alternative, outcome k and attribute m its value
        a and the person's weight w, with the outcome's salience s and whether the alternative is the choice (where
        ``events`` have own)."""
        net = self
        if net.utility != "attributes":
            raise ValueError("only a net of attributes has such parts")

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for event, z, e, own in zip(pdf["event_id"], pdf["z"], pdf["e"], pdf["own"]):
                    f = net.forward(np.asarray(z, float)[None], np.asarray(e, float).reshape(1, -1, net.outcomes, net.width))
                    j, k, m = f["A"].shape[1:]
                    alt, out, at = (x.ravel() for x in np.indices((j, k, m)))
                    yield pd.DataFrame({"event_id": event, "alt_idx": alt, "k": out, "m": at, "a": f["A"].ravel(), "w": f["w"][0][at], "s": f["S"][0][alt, out], "chosen": alt == own})

        rows = events if "own" in events.columns else events.withColumn("own", F.lit(-1))
        return rows.select("event_id", "z", "e", F.coalesce("own", F.lit(-1)).alias("own")).mapInPandas(run, "event_id long, alt_idx long, k long, m long, a double, w double, s double, chosen boolean")

    def score(self, events: DataFrame) -> DataFrame:
        """events: event_id, z array, e array (alternatives x outcomes x width). Rows (event_id, alt_idx, score).

        Events of a batch that have as many alternatives go through the net together, some hundred at a time.
        """
        net = self

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for size, same in pdf.groupby(pdf["e"].map(len)):
                    j = size // (net.outcomes * net.width)
                    some = max(1, 4096 // max(1, j * net.outcomes))
                    for a in range(0, len(same), some):
                        part = same.iloc[a : a + some]
                        e = np.concatenate(part["e"].tolist()).astype(float).reshape(len(part), j, net.outcomes, net.width)
                        v = net.forward(np.array(part["z"].tolist(), float), e)["V"]
                        yield pd.DataFrame({"event_id": part["event_id"].to_numpy().repeat(j), "alt_idx": np.tile(np.arange(j), len(part)), "score": v.ravel()})

        return events.select("event_id", "z", "e").mapInPandas(run, "event_id long, alt_idx long, score double")


def sweep(train: tuple, val: tuple, grid: dict[str, list], net: UtilityNet | None = None, **options) -> list[dict]:
    """Every setting of a grid over the net's fields, with its validation likelihood, the best first. ``outcomes`` below
    the data's take the first ones."""
    out = []
    for values in product(*grid.values()):
        made = replace(net or UtilityNet(), **dict(zip(grid, values)))
        cut = lambda part: (part[0], part[1][:, :, : made.outcomes], *part[2:])  # noqa: B023, E731
        curve = made.fit(cut(train), cut(val), **options)
        out.append({**dict(zip(grid, values)), "nll": float(min(curve)), "n_params": made.n_params})
    return sorted(out, key=lambda r: r["nll"])


def guarded_subsample(events: DataFrame, n: int | None, seed: int = 42, method: str = "leverage") -> DataFrame | None:
    """(customer_id, weight) of a subsample, None where none is asked for or it can't be made, which is warned of: then
    all customers count, with weight 1. An unknown method raises."""
    made = {"leverage": leverage_subsample, "random": random_subsample}
    if method not in made:
        raise ValueError(f"unknown method {method!r}; there are {sorted(made)}")
    if n is None:
        return None
    try:
        return made[method](events, n, seed=seed)
    except Exception as e:  # noqa: BLE001  a run goes on without weights
        warnings.warn(f"no {method} subsample: {type(e).__name__}: {e}", stacklevel=2)
        return None
