"""Structure search, rankers, simulation, the leaderboard run and per-decision reports."""

from __future__ import annotations

import time
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import prompts
from ..functions.terms import BASE, COMBINATORS, Term, compiled, log_prior, parse
from ..functions.text import rotations
from . import metrics
from .choice import uniform
from .history import latest_before
from .models import SparseLogit

LETTERS = "ABCDEFGHIJ"
FLOOR = 1e-12


# Rankers: probabilities of letters over rotations of the alternatives.
def _bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often it is named."""
    return F.element_at(F.transform(F.array(value), use), 1)


def letter_probabilities(response: Column, letters: str = LETTERS) -> Column:
    """Probabilities that a response states as a JSON object of letters; else a fixed stand-in from its hash."""
    object_ = F.regexp_extract(F.coalesce(response, F.lit("")), r"(\{[^{}]*\})", 1)
    all_ = F.array(*map(F.lit, letters))
    said = lambda m: F.transform(all_, lambda c: F.coalesce(F.try_element_at(m, c), F.try_element_at(m, F.lower(c)), F.lit(0.0)))
    stand_in = lambda r: F.transform(all_, lambda c: uniform(c, r))
    total = lambda v: F.aggregate(v, F.lit(0.0), lambda a, b: a + b)
    share = lambda v: _bound(total(v), lambda t: F.when(t > 0, F.transform(v, lambda x: x / t)))
    stated = _bound(F.from_json(object_, "map<string, double>"), lambda m: _bound(said(m), share))
    return F.coalesce(stated, _bound(F.coalesce(response, F.lit("")), lambda r: _bound(stand_in(r), share)))


def logprob_probabilities(top: Column, letters: str = LETTERS) -> Column:
    """Probabilities from the likeliest tokens of an answer (array of token, logprob): a softmax over the letters' best
    token each, whatever spaces or marks it has around it; null where no letter is among them."""
    letter = lambda t: F.regexp_replace(F.upper(t), r"^[\s(\"']+|[\s).:,\"']+$", "")
    best = lambda c: F.array_max(F.transform(F.filter(top, lambda t: letter(t["token"]) == c), lambda t: t["logprob"].cast("double")))
    all_ = F.transform(F.array(*map(F.lit, letters)), best)

    def softmax(v: Column) -> Column:
        most = F.array_max(v)
        raised = F.transform(v, lambda x: F.coalesce(F.exp(x - most), F.lit(0.0)))
        total = F.aggregate(raised, F.lit(0.0), lambda a, b: a + b)
        return F.when(most.isNotNull(), F.transform(raised, lambda x: x / total))

    return _bound(all_, softmax)


def few_shot(events: DataFrame, timeline: DataFrame, ask: Callable[[Column], Column], shots: int = 5, budget: int = 2000, k: int = 10) -> DataFrame:
    """(event_id, alt_idx, score): rotated ranking of prompts that show a customer's latest training choices before the
    event, oldest first, as many as fit the token budget.

    ``events``: event_id, customer_id, us, c_d and alts (title, price); ``timeline``: training rows with title, category
    and price. ``ask`` turns a prompt into a response.
    """
    probes = events.select("customer_id", F.col("us").alias("probe_us"), F.col("event_id").alias("probe_id"))
    past = latest_before(timeline, probes, shots, columns=("us", "seq", "title", "category", "price"))
    lines = F.transform(F.reverse("examples"), lambda x: prompts.example_line(x["title"], x["category"], x["price"]))
    shown = past.select(F.col("probe_id").alias("event_id"), prompts.within_budget(lines, budget).alias("shown_before"))
    rows = events.join(shown, "event_id", "left")
    return rank_by_letters(rows, lambda alts: ask(prompts.ranker(F.col("c_d"), alts, F.coalesce("shown_before", F.expr("cast(array() as array<string>)")))), k)


def rank_by_letters(events: DataFrame, ask: Callable[[Column], Column], k: int = 10) -> DataFrame:
    """(event_id, alt_idx, score): log mean probability over k rotations of the alternatives (array ``alts``), so a
    letter's place says nothing. ``ask`` turns a rotation into a response."""
    rows = events.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.lit(k), F.size("alts")) - 1)))
    order = rotations(F.sequence(F.lit(0), F.size("alts") - 1), F.col("k"))
    rows = rows.withColumn("order", order).withColumn("shown", F.transform("order", lambda i: F.element_at("alts", i + 1)))
    rows = rows.withColumn("p", letter_probabilities(ask(F.col("shown"))))
    long = rows.select("event_id", F.posexplode("order").alias("place", "alt_idx"), "p").withColumn("p", F.element_at("p", F.col("place") + 1))
    return long.groupBy("event_id", F.col("alt_idx").cast("long").alias("alt_idx")).agg(F.log(F.greatest(F.avg("p"), F.lit(FLOOR))).alias("score"))


def leaking_features(alternatives: DataFrame, features: list[str]) -> list[str]:
    """Features that are set on the chosen alternative and on no other, in every event: they give the choice away."""
    per = alternatives.groupBy("event_id").agg(
        *(((F.max(F.when(F.col("chosen"), F.col(f))) != 0) & (F.max(F.when(~F.col("chosen"), F.abs(F.col(f)))) == 0)).alias(f) for f in features)
    )
    every = per.agg(*(F.min(F.coalesce(f, F.lit(False)).cast("int")).alias(f) for f in features)).first()
    return [f for f in features if every[f] == 1]


# Structures of terms.
def fit_structure(terms: list[Term], training: DataFrame, validation: DataFrame, rounds: int = 6) -> tuple[float, SparseLogit]:
    """(validation likelihood a structure reaches, its fitted logit)."""
    names = [f"t{i}" for i in range(len(terms))]
    made = {n: compiled(t) for n, t in zip(names, terms)}
    model = SparseLogit(names, penalties=(1e-3,), rounds=rounds).fit(training.withColumns(made), validation.withColumns(made))
    scored = model.score(validation.withColumns(made))
    return metrics.per_event(scored).agg(F.avg("nll")).first()[0], model


def greedy(gain: float, _: float, __: float) -> bool:
    return gain > 0


def annealed(seed: int, start: float = 0.05, rate: float = 0.8) -> Callable[[float, float, float], bool]:
    rng = np.random.default_rng(seed)
    return lambda gain, step, _: bool(gain > 0 or rng.random() < np.exp(gain / (start * rate**step)))


def by_posterior(gain: float, _: float, prior_gain: float) -> bool:
    return gain + prior_gain > 0


def within_tolerance(gain: float, _: float, __: float, least: float = -1e-3) -> bool:
    return gain > least


def propose(terms: list[Term], base: list[str], rng: np.random.Generator) -> list[Term]:
    """One change: a term more, a term less, or a combinator over base terms."""
    kind = rng.integers(3)
    if kind == 0 and len(terms) > 1:
        gone = rng.integers(len(terms))
        return [t for i, t in enumerate(terms) if i != gone]
    if kind == 1:
        new = Term(str(rng.choice(base)))
    else:
        name = str(rng.choice(sorted(COMBINATORS)))
        new = Term(name, tuple(str(x) for x in rng.choice(base, COMBINATORS[name][0])))
    return terms if new in terms else [*terms, new]


def descend(terms: list[Term], training: DataFrame, validation: DataFrame, base: list[str], steps: int = 10, seed: int = 0, accept: Callable[[float, float, float], bool] = greedy, proposer: Callable = propose) -> tuple[list[Term], float, list[dict]]:
    """Structure descent: propose, fit, accept or not. Fits are kept by structure; (best terms, likelihood, history)."""
    rng = np.random.default_rng(seed)
    kept: dict[tuple[Term, ...], float] = {}

    def nll(s: list[Term]) -> float:
        key = tuple(sorted(s, key=lambda t: t.shown))
        if key not in kept:
            kept[key] = fit_structure(s, training, validation)[0]
        return kept[key]

    now = best = terms
    history = []
    for step in range(steps):
        new = proposer(now, base, rng)
        gain = nll(now) - nll(new)
        taken = new != now and accept(gain, step, log_prior(new) - log_prior(now))
        history.append({"step": step, "terms": [t.shown for t in new], "gain": gain, "accepted": taken})
        now = new if taken else now
        best = min(best, now, key=nll)
    return best, nll(best), history


def proposals(completion: str) -> list[Term]:
    """The terms that a completion names, one a line, bullets and quotes around them aside; what is no term is left out."""
    out = []
    for line in completion.splitlines():
        try:
            out.append(parse(line.strip().strip("-*`\"' ")))
        except ValueError:
            continue
    return list(dict.fromkeys(out))


def propose_by(ask: Callable[[str], str], base: list[str]) -> Callable[[list[Term], list[str], np.random.Generator], list[Term]]:
    """A proposer that asks a language model for the next structure; where its answer has no usable term, a random change."""

    def run(terms: list[Term], names: list[str], rng: np.random.Generator) -> list[Term]:
        said = ask(f"Current terms:\n{chr(10).join(t.shown for t in terms)}\nBase terms: {', '.join(base)}\nCombinators: {', '.join(COMBINATORS)}\nName the terms of a better structure, one a line.")
        usable = [t for t in proposals(said) if set(t.args or (t.name,)) <= set(base)]
        return usable or propose(terms, names, rng)

    return run


# Legacy feature rows: real history for the chosen alternative, never-seen values for the others.
def legacy_rows(alternatives: DataFrame, popularity: DataFrame, category_price: DataFrame) -> DataFrame:
    """All twelve base terms of every alternative; those that need data of their own (hours, ratings, brands, delivery,
    co-purchases) are 0 for all."""
    rows = alternatives.join(popularity, "asin", "left").join(category_price, "category", "left")
    pick = lambda own, other: F.when(F.col("chosen"), own).otherwise(F.lit(other))
    ratio = F.col("price") / (F.coalesce("category_price", F.lit(10.0)) + 1e-8)
    made = {
        "routine": pick(F.col("routine").cast("double"), 0.0), "recency": pick(1.0 / (1.0 + F.col("recency_days")), 1.0 / 1000.0),
        "novelty": pick(F.col("novelty").cast("double"), 1.0), "popularity": F.log1p(F.coalesce("popularity", F.lit(0)).cast("double")),
        "affinity": pick(F.log1p(F.col("cat_affinity").cast("double")), 0.0), "price_sensitivity": pick(1.0 - ratio, 0.0), "price_rank": pick(1.0 - ratio, 0.0),
    }
    return rows.select("event_id", "alt_idx", "chosen", *(made.get(n, F.lit(0.0)).alias(n) for n in BASE))


def legacy_lookups(alternatives: DataFrame, events: DataFrame) -> DataFrame:
    """The twelve base terms of every alternative (event_id, alt_idx, customer_id, asin, category) from what its customer
    last had with the item, its category and its brand."""
    last = lambda c: F.max_by(c, F.struct("us", "seq"))
    by_key = lambda rows, key, *values: rows.groupBy("customer_id").agg(F.map_from_entries(F.collect_list(F.when(F.col(key).isNotNull(), F.struct(key, F.struct(*values))))).alias(f"_by_{key}"))
    pair = by_key(events.groupBy("customer_id", "asin").agg(last("routine").alias("routine"), last("recency_days").alias("recency"), last("price").alias("price")), "asin", "routine", "recency", "price")
    item = events.groupBy("asin").agg(F.count("*").alias("_popularity"), F.min_by("category", F.struct("us", "seq")).alias("_category"), F.min_by("brand", F.struct("us", "seq")).alias("brand"))
    near = by_key(events.groupBy("customer_id", "category").agg(last("cat_affinity").alias("affinity")), "category", "affinity")
    brand = by_key(events.groupBy("customer_id", "brand").agg(F.count("*").alias("n")), "brand", "n")
    price = events.groupBy(F.col("category").alias("_category")).agg(F.avg("price").alias("_mean"))
    # What a customer had with items, categories and brands is one row, so alternatives meet it in one exchange.
    people = pair.join(near, "customer_id", "left").join(brand, "customer_id", "left")
    rows = alternatives.select("event_id", "alt_idx", "customer_id", "asin", "category").join(item, "asin", "left").withColumn("_category", F.coalesce("_category", "category"))
    of = lambda key, column: F.try_element_at(f"_by_{key}", F.col(column))
    rows = rows.join(people, "customer_id", "left").withColumns({"_pair": of("asin", "asin"), "_affinity": of("category", "_category")["affinity"], "_brand": of("brand", "brand")["n"]})
    rows = rows.withColumns({"_routine": F.col("_pair.routine"), "_recency": F.col("_pair.recency"), "_price": F.col("_pair.price")}).drop("_by_asin", "_by_category", "_by_brand", "_pair").join(price, "_category", "left")
    number = lambda c, other=0.0: F.coalesce(F.col(c).cast("double"), F.lit(other))
    mean = number("_mean", 10.0)
    ratio = F.coalesce(F.col("_price"), mean) / (mean + 1e-8)
    made = {
        "routine": number("_routine"), "recency": 1.0 / (1.0 + number("_recency", 999.0)), "novelty": F.col("_routine").isNull().cast("double"), "popularity": F.log1p(number("_popularity")),
        "affinity": F.log1p(number("_affinity")), "price_sensitivity": 1.0 - ratio, "brand_affinity": F.log1p(number("_brand")), "price_rank": 1.0 - ratio,
    }
    return rows.select("event_id", "alt_idx", *(made.get(n, F.lit(0.0)).alias(n) for n in BASE))


def numbered(items: DataFrame, keys: list[str], buckets: int = 1024) -> DataFrame:
    """Items (asin and ``keys``) with ``at``, their place from 0 on among those of equal keys, and ``size``, how many
    these are; places are ranks within buckets of hashes plus the sizes of the buckets before."""
    rows = items.withColumn("_b", F.pmod(F.xxhash64("asin"), F.lit(buckets)))
    sizes = rows.groupBy(*keys, "_b").agg(F.count("*").alias("_n"))
    every = Window.partitionBy(*keys)
    base = sizes.select(*keys, "_b", (F.sum("_n").over(every.orderBy("_b")) - F.col("_n")).alias("_base"), F.sum("_n").over(every).alias("size"))
    at = F.row_number().over(Window.partitionBy(*keys, "_b").orderBy("asin")) - 1 + F.col("_base")
    return rows.join(base, [*keys, "_b"]).withColumn("at", at).drop("_b", "_base")


def places(size: Column, k: int, *parts: Column) -> Column:
    """``k`` distinct places below ``size`` (all, where it has no more), every set as likely; fixed by their parts."""

    def step(got: Column, j: Column) -> Column:
        x = F.floor(uniform(*parts, j) * (j + 1)).cast("long")
        return F.array_append(got, F.when(F.array_contains(got, x), j).otherwise(x))

    empty = F.expr("cast(array() as array<long>)")
    return F.when(size > 0, F.aggregate(F.sequence(F.greatest(size - k, F.lit(0)).cast("long"), (size - 1).cast("long")), empty, step)).otherwise(empty)


def simulate(events: DataFrame, weight: float, steps: int = 10, candidates: int = 10, seed: int = 42) -> DataFrame:
    """(customer_id, us, seq, asin, category, price): for each customer ``steps`` purchases after the last, each drawn by a
    logit over candidates by how often they bought them. Half of the candidates, rounded down, are of their last category,
    the rest of the whole catalogue, drawn anew for each customer and step; category is the last one, price the item's mean.

    A customer's steps don't feed back into counts, so all steps are one join; draws are Gumbel keys from hashes.
    """
    last = events.groupBy("customer_id").agg(F.max("us").alias("us"), F.max_by("category", F.struct("us", "seq")).alias("category"))
    items = events.groupBy("asin").agg(F.avg("price").alias("price"))
    near = numbered(events.select("category", "asin").filter("category is not null").distinct(), ["category"]).join(items, "asin")
    whole = numbered(items, [])
    one = whole.agg(F.count("*").alias("_all"))
    rows = last.join(near.groupBy("category").agg(F.max("size").alias("_own")), "category", "left").crossJoin(F.broadcast(one)).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(steps))))
    same = candidates // 2
    pick = lambda size, k, tag: F.explode(places(size, k, F.lit(seed), F.lit(tag), F.col("customer_id"), F.col("step"))).alias("at")
    kept = ["customer_id", "step", "asin", "price"]
    own = rows.select("customer_id", "category", "step", pick(F.coalesce("_own", F.lit(0)), same, "own")).join(near.select("category", "at", "asin", "price"), ["category", "at"]).select(*kept)
    rest = rows.select("customer_id", "step", pick(F.col("_all"), candidates - same, "all")).join(whole.select("at", "asin", "price").filter("asin is not null"), "at").select(*kept)
    bought = events.groupBy("customer_id", "asin").agg(F.count("*").alias("n"))
    # What a customer bought and did last meets their candidates in one exchange by customer. An item that is a candidate
    # twice has one key, so it can stay twice.
    past = bought.groupBy("customer_id").agg(F.map_from_entries(F.collect_list(F.when(F.col("asin").isNotNull(), F.struct("asin", "n")))).alias("_bought")).join(last, "customer_id")
    drawn_from = own.union(rest).join(past, "customer_id").withColumn("n", F.try_element_at("_bought", F.col("asin"))).drop("_bought")
    noise = -F.log(-F.log(uniform(F.lit(seed), "customer_id", "step", "asin")))
    keyed = drawn_from.withColumn("key", F.coalesce("n", F.lit(0)) * weight + noise)
    drawn = keyed.groupBy("customer_id", "step").agg(F.max_by(F.struct("us", "asin", "category", "price"), F.struct("key", "asin")).alias("x"))
    gap = (1 + F.floor(uniform(F.lit(seed), F.lit("gap"), "customer_id", "step") * 29)).cast("long")
    days = F.sum(gap).over(Window.partitionBy("customer_id").orderBy("step"))
    return drawn.select("customer_id", (F.col("x.us") + days * 86_400_000_000).alias("us"), F.lpad(F.col("step").cast("string"), 6, "0").alias("seq"), "x.asin", "x.category", "x.price")


# Runs and reports.
def is_stand_in(model: object) -> bool:
    """Whether a model asks a stand-in where a language model is meant: what it asks by is marked as one."""
    return any(getattr(getattr(model, a, None), "stand_in", False) for a in ("ask", "propose"))


def leaderboard(models: dict[str, Callable[[], object]], training: DataFrame, test: DataFrame, reference: str = "popularity", stand_ins: bool = True) -> DataFrame:
    """One row a model: status (ok, unavailable or errored), panel, fit seconds and uplift over the reference.

    A model that can't be imported or fitted doesn't end the run. Without ``stand_ins`` a model that asks one isn't
    fitted but errored, so no row of a real run comes of a stand-in.
    """
    rows = []
    n_train = training.select("event_id").distinct().count()
    for name, make in models.items():
        start = time.time()
        try:
            model = make()
            if not stand_ins and is_stand_in(model):
                raise ValueError("a stand-in takes the place of a language model")
            fitted = model.fit(training)
            p = metrics.panel(metrics.per_event(fitted.score(test)), len(getattr(fitted, "names", [])), n_train).first()
            rows.append((name, "ok", float(p["nll"]), float(p["top1"]), float(p["mrr"]), time.time() - start, None))
        except ImportError as e:
            rows.append((name, "unavailable", None, None, None, time.time() - start, str(e)))
        except Exception as e:  # noqa: BLE001  one failed model must not end the others
            rows.append((name, "errored", None, None, None, time.time() - start, f"{type(e).__name__}: {e}"[:500]))
    base = next((r[2] for r in rows if r[0] == reference and r[1] == "ok"), None)
    done = [(*r, None if base is None or r[2] is None else base - r[2]) for r in rows]
    return test.sparkSession.createDataFrame(done, "model string, status string, nll double, top1 double, mrr double, seconds double, note string, uplift double")


def decision(attributes: DataFrame, weights: DataFrame, event_id: int) -> DataFrame:
    """(alt_idx, k, parts): an event's outcomes with what each attribute adds to their utility, greatest first."""
    rows = attributes.filter(F.col("event_id") == event_id).join(weights.filter(F.col("event_id") == event_id), ["event_id", "m"])
    part = F.struct((F.col("w") * F.col("a")).alias("part"), "m")
    return rows.groupBy("alt_idx", "k").agg(F.reverse(F.array_sort(F.collect_list(part))).alias("parts"))


def counterfactual(events: DataFrame, score: Callable[[DataFrame], DataFrame], change: Callable[[Column], Column]) -> DataFrame:
    """(event_id, alt_idx, before, after, delta): scores with the person vector as it is and as ``change`` makes it."""
    a = score(events).withColumnRenamed("score", "before")
    b = score(events.withColumn("z", change(F.col("z")))).withColumnRenamed("score", "after")
    return a.join(b, ["event_id", "alt_idx"]).withColumn("delta", F.col("after") - F.col("before"))


def synthetic(spark, n: int, weights: list[float], alternatives: int = 10, seed: int = 0) -> DataFrame:
    """Events with normal features and a Gumbel choice by known weights; every value is fixed by its event and place."""
    rows = spark.range(n).withColumnRenamed("id", "event_id").withColumn("alt_idx", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(alternatives - 1).cast("long"))))
    u = lambda tag: uniform(F.lit(seed), F.lit(tag), "event_id", "alt_idx")
    normal = lambda i: F.sqrt(-2 * F.log(u(f"r{i}"))) * F.cos(2 * np.pi * u(f"a{i}"))
    rows = rows.withColumns({f"x{i}": normal(i) for i in range(len(weights))})
    utility = F.lit(0.0)
    for i, w in enumerate(weights):
        utility = utility + F.col(f"x{i}") * w
    key = utility - F.log(-F.log(u("g")))
    w = Window.partitionBy("event_id")
    return rows.withColumn("_k", key).withColumn("chosen", F.col("_k") == F.max("_k").over(w)).drop("_k")


def external_scores(alternatives: DataFrame, logits: DataFrame) -> DataFrame:
    """Alternatives with another model's scores (event_id, alt_idx, logit); one without a score raises when read."""
    got = alternatives.join(logits, ["event_id", "alt_idx"], "left")
    return got.withColumn("score", F.coalesce("logit", F.raise_error(F.lit("an alternative without a score")).cast("double"))).drop("logit")


def unknown_customers(metrics_: DataFrame, sidecar: DataFrame) -> DataFrame:
    """Rows of customer metrics whose customer the seed's events don't have."""
    return metrics_.join(sidecar.select("seed", "customer_id").distinct(), ["seed", "customer_id"], "left_anti")
