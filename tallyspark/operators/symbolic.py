"""Search for utility equations: proposals, coefficients by BFGS on derivatives of the equation, a memory and concepts.

The search looks at a bounded sample of events; the coefficients of the equation that it finds are fitted to all events,
a job for each step, and it is compiled to a column that scores any number.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.formula import NUMPY_FUNCTIONS, NUMPY_SLOPES, FormulaError, concepts, instance, trivial, utility, utility_gradient
from ..sources.shared import Scratch
from .models import packed

FIT_EVENTS = 4_000


def sample(alternatives: DataFrame, names: list[str], events: int = FIT_EVENTS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """(inputs over all alternatives, the event of each, the choices' places) of at most ``events`` events by hash."""
    ids = alternatives.select("event_id").distinct().orderBy(F.xxhash64("event_id"), "event_id").limit(events)
    return sample_packed(packed(alternatives.join(F.broadcast(ids), "event_id"), names), len(names), events)


def sample_packed(events: DataFrame, width: int, most: int = FIT_EVENTS) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The same of events that are packed already."""
    rows = events.select("event_id", "x", "own").orderBy(F.xxhash64("event_id"), "event_id").limit(most).collect()
    flat, event, own, n = [], [], [], 0
    for i, r in enumerate(sorted(rows, key=lambda r: r["event_id"])):
        x = np.asarray(r["x"], float).reshape(-1, width)
        flat.append(x)
        event += [i] * len(x)
        own.append(n + r["own"])
        n += len(x)
    x = np.concatenate(flat) if flat else np.zeros((0, width))
    return [x[:, i] for i in range(width)], np.array(event, int), np.array(own, int)


def likelihood(u: np.ndarray, event: np.ndarray, own: np.ndarray) -> float:
    """Mean negative log likelihood of utilities laid end to end."""
    u = np.broadcast_to(u, event.shape)
    if not np.isfinite(u).all():
        return float("inf")
    starts = np.flatnonzero(np.diff(event, prepend=-1))
    top = np.maximum.reduceat(u, starts)
    log_sum = top + np.log(np.add.reduceat(np.exp(u - top[event]), starts))
    return float((log_sum - u[own]).mean())


def bfgs(f: Callable[[np.ndarray], tuple[float, np.ndarray]], start: np.ndarray, rounds: int = 200, tolerance: float = 1e-5) -> tuple[float, np.ndarray]:
    """Least value of a function that gives value and gradient: quasi-Newton steps with a halving line search.

    Where the value or gradient is no number, the step is halved; a start without a value stays as it is.
    """
    x = start.astype(float)
    value, grad = f(x)
    inverse = np.eye(len(x))
    for _ in range(rounds):
        if not np.isfinite(value) or np.abs(grad).max(initial=0) < tolerance:
            break
        step = -inverse @ grad
        slope = float(step @ grad)
        if slope >= 0:
            inverse, step = np.eye(len(x)), -grad
            slope = -float(grad @ grad)
        length = 1.0 if np.abs(step).max() < 10 else 10 / np.abs(step).max()
        while True:
            new, (to, there) = x + length * step, f(x + length * step)
            if (np.isfinite(to) and np.isfinite(there).all() and to <= value + 1e-4 * length * slope) or length < 1e-10:
                break
            length /= 2
        if length < 1e-10 or value - to < 1e-12 * max(1.0, abs(value)):
            if length >= 1e-10 and to < value:
                x, value = new, to
            break
        s, y = new - x, there - grad
        x, value, grad = new, to, there
        if (sy := float(s @ y)) > 1e-12:
            left = np.eye(len(x)) - np.outer(s, y) / sy
            inverse = left @ inverse @ left.T + np.outer(s, s) / sy
    return value, x


def value_and_gradient(text: str, inputs: list[np.ndarray], event: np.ndarray, own: np.ndarray, c: np.ndarray) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood of an equation over a sample, and its gradient by the coefficients."""
    with np.errstate(all="ignore"):
        u, slopes = utility_gradient(text, inputs, list(c), NUMPY_FUNCTIONS, NUMPY_SLOPES, float)
        u = np.broadcast_to(np.asarray(u, float), event.shape)
        if not len(u) or not np.isfinite(u).all():
            return float("inf"), np.zeros(len(c))
        starts = np.flatnonzero(np.diff(event, prepend=-1))
        e = np.exp(u - np.maximum.reduceat(u, starts)[event])
        p = e / np.add.reduceat(e, starts)[event]
        p[own] -= 1
        grad = np.array([float((p * np.broadcast_to(slopes[k], p.shape)).sum()) if k in slopes else 0.0 for k in range(len(c))])
    return likelihood(u, event, own), grad / len(own)


def fit(text: str, data: tuple, restarts: int = 4, seed: int = 0) -> tuple[float, np.ndarray]:
    """(likelihood, coefficients) of an equation over a sample, the best of some starts."""
    inputs, event, own = data
    n = utility(text, inputs, [], NUMPY_FUNCTIONS, float)[1]
    f = lambda c: value_and_gradient(text, inputs, event, own, c)
    if not n:
        return f(np.zeros(0))[0], np.zeros(0)
    rng = np.random.default_rng(seed)
    return min((bfgs(f, rng.normal(size=n) * 0.3) for _ in range(restarts)), key=lambda x: x[0])


def over_all(events: DataFrame, text: str, width: int, c: np.ndarray) -> tuple[float, np.ndarray, int]:
    """(mean negative log likelihood, gradient, events) over all packed events: one job, one row of sums a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loss, n, grad = 0.0, 0, np.zeros(len(c))
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column("x").value_lengths().to_numpy(zero_copy_only=False) // width
                x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
                own = np.cumsum(sizes) - sizes + batch.column("own").to_numpy(zero_copy_only=False)
                part, g = value_and_gradient(text, _four(x), np.repeat(np.arange(len(sizes)), sizes), own, c)
                loss, grad, n = loss + part * len(own), grad + g * len(own), n + len(own)
        yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([grad], pa.list_(pa.float64())), pa.array([n])], names=["loss", "grad", "n"])

    total = events.select("x", "own").mapInArrow(run, "loss double, grad array<double>, n long")
    r = total.agg(F.sum("loss"), F.array(*(F.sum(F.col("grad")[i]) for i in range(len(c)))) if len(c) else F.expr("cast(array() as array<double>)"), F.sum("n")).first()
    n = max(int(r[2] or 0), 1)
    return (r[0] or 0.0) / n, np.array([g or 0.0 for g in r[1]]) / n, int(r[2] or 0)


def _four(x: np.ndarray) -> list[np.ndarray]:
    """The four inputs of an equation; those that aren't there are 0."""
    return [x[:, i] if i < x.shape[1] else np.zeros(len(x)) for i in range(4)]


@dataclass
class Library:
    """Canonical parts of good equations that proposals can use, by name.

    A part comes in when ``promote_at`` survivors have it, or when the proposer nominates a name and one survivor has a
    part that isn't in yet: the most frequent such part gets the name. Trivial parts stay out. Parts that no survivor had
    for ``lifetime`` updates go, as do the least used, oldest first, beyond ``size``.
    """

    size: int = 20
    promote_at: int = 3
    lifetime: int = 5
    parts: dict[str, dict] = field(default_factory=dict)

    def update(self, survivors: list[str], nominations: list[str], step: int) -> None:
        counts = Counter(c for text in survivors for c in concepts(text))
        for name, p in self.parts.items():
            p["used"] = counts[p["form"]]
            p["unused"] = 0 if p["used"] else p["unused"] + 1
        known = {p["form"] for p in self.parts.values()}
        ranked = [c for c, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0])) if c not in known and not trivial(c)]
        often = [c for c in ranked if counts[c] >= self.promote_at]
        rest = [c for c in ranked if counts[c] < self.promote_at]
        for i, form in enumerate(often):
            self._put(f"concept_{step}_{i}", form, counts[form], step)
        for name in dict.fromkeys(nominations):
            if name not in self.parts and rest:
                form = rest.pop(0)
                self._put(name, form, counts[form], step)
        self.parts = {k: p for k, p in self.parts.items() if p["unused"] < self.lifetime}
        kept = sorted(self.parts, key=lambda k: (-self.parts[k]["used"], -self.parts[k]["since"], k))[: self.size]
        self.parts = {k: p for k, p in self.parts.items() if k in kept}

    def _put(self, name: str, form: str, used: int, step: int) -> None:
        self.parts[name] = {"form": form, "used": used, "unused": 0, "since": step}

    @property
    def forms(self) -> list[str]:
        return sorted(p["form"] for p in self.parts.values())


_NOMINATED = re.compile(r"^\s*NOMINATE:\s*(\w+)\s*$", re.M)


def answer(said: str) -> tuple[str, list[str]]:
    """(the equation, the names nominated) of a proposer's answer."""
    at = said.find("def ")
    return said[max(at, 0) :].strip(), _NOMINATED.findall(said[: max(at, 0)])


def stub_proposals(rng: np.random.Generator, memory: list[str], library: list[str]) -> str:
    """An equation of one to three weighted parts; stands in for a language model, which may take its place.

    Parts are the library's, or those of the memory's best equations, or random forms; now and then a name is nominated.
    """
    forms = ["x[{i}]", "log1p(x[{i}])", "x[{i}] ** 2", "tanh(x[{i}])", "x[{i}] * x[{j}]", "sqrt(x[{i}])"]
    parts, at = [], 0
    good = [c for text in memory[:3] for c in sorted(concepts(text)) if not trivial(c)]
    for _ in range(int(rng.integers(1, 4))):
        i, j, draw = *rng.integers(0, 4, 2), rng.random()
        pool = library if draw < 0.4 else good if draw < 0.7 else []
        if pool:
            part, after = instance(pool[int(rng.integers(len(pool)))], at)
            parts.append(part if after > at else f"c[{at}] * {part}")
            at = max(after, at + 1)
        else:
            parts.append(f"c[{at}] * {forms[rng.integers(len(forms))].format(i=i, j=j)}")
            at += 1
    nominated = f"NOMINATE: shape_{int(rng.integers(1000))}\n" if rng.random() < 0.1 else ""
    return f"{nominated}def utility(x, c):\n    return {' + '.join(parts)}"


stub_proposals.stand_in = True


@dataclass
class EquationSearch:
    """Proposals with a memory of the best; with ``library`` parts of good equations become concepts that proposals can
    use. The best equation's coefficients are fitted to all events."""

    names: list[str]
    proposals: int = 100
    memory: int = 10
    library: int = 0
    promote_at: int = 3
    lifetime: int = 5
    every: int = 5
    propose: Callable[[np.random.Generator, list[str], list[str]], str] = stub_proposals
    seed: int = 0
    history: list[tuple[float, str]] = field(default_factory=list)

    def fit(self, training: DataFrame) -> EquationSearch:
        """An answer that is no equation counts as a proposal; the library is updated after every few."""
        if len(self.names) > 4:
            raise ValueError("an equation has four inputs at most")
        scratch = Scratch(training.sparkSession)
        events = scratch.stored(packed(training, self.names), "equations")
        columns, event, own = sample_packed(events, len(self.names))
        data = _four(np.column_stack(columns)), event, own
        rng, known, nominated = np.random.default_rng(self.seed), {}, []
        self.concepts = Library(self.library, self.promote_at, self.lifetime)
        best: list[str] = []
        for step in range(self.proposals):
            text, names = answer(self.propose(rng, best, self.concepts.forms if self.library else []))
            nominated += names
            try:
                if text not in known:
                    known[text] = fit(text, data, seed=self.seed)
                self.history.append((known[text][0], text))
            except FormulaError:
                pass
            best = [t for _, t in sorted((v, t) for t, (v, _) in known.items() if np.isfinite(v))[: self.memory]]
            if self.library and step % self.every == self.every - 1:
                self.concepts.update(best, nominated, step // self.every)
                nominated = []
        if not best:
            raise FormulaError("no proposal has a likelihood")
        self.text = best[0]
        start = known[self.text][1]
        at = lambda c: over_all(events, self.text, len(self.names), c)
        self.likelihood, self.coefficients = bfgs(lambda c: at(c)[:2], start, rounds=20)
        self.n = at(self.coefficients)[2]
        scratch.clear()
        return self

    def score(self, alternatives: DataFrame) -> DataFrame:
        inputs = [F.col(n).cast("double") for n in self.names] + [F.lit(0.0)] * (4 - len(self.names))
        return alternatives.withColumn("score", utility(self.text, inputs, list(self.coefficients))[0])
