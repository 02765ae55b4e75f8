"""Fits over all events against fits on one machine, and planted signals that must come back."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.operators import models, training


def net_events(n=900, width=6, outcomes=2, seed=0):
    """Events of 2 to 4 alternatives whose choice follows the outcomes' first entry and the person's."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        j = int(rng.integers(2, 5))
        e, z = rng.normal(size=(j, outcomes, width)), rng.normal(size=3)
        u = 2 * e[:, :, 0].mean(1) + e[:, :, 1].mean(1) * np.sign(z[0]) + rng.gumbel(size=j) * 0.5
        rows.append((i, z.tolist(), e.ravel().tolist(), int(u.argmax()), float(1 + i % 3)))
    return rows


NET = "event_id long, z array<double>, e array<double>, own int, weight double"


def test_gradient_over_partitions_equals_the_drivers(spark, monkeypatch):
    monkeypatch.setattr(training, "BLOCK", 37)
    monkeypatch.setattr(training, "TOGETHER", 40)
    rows = [r for r in net_events(200) if len(r[2]) == 3 * 2 * 6]
    net = models.UtilityNet(outcomes=2, width=6, persons=3, hidden=5, attributes=3).init()
    z, e, own, weight = (np.array([r[i] for r in rows]) for i in (1, 2, 3, 4))
    loss, grad = net.gradient(z, e.reshape(len(rows), 3, 2, 6), own, weight, 0.01)
    got = training.gradient_sum(spark.createDataFrame(rows, NET).repartition(3), net, 0.01)
    assert got[3] == len(rows) and got[2] == pytest.approx(weight.sum()) and got[0] / got[2] == pytest.approx(loss)
    assert np.allclose(got[1] / got[2], training.flat(grad))
    assert training.gradient_sum(spark.createDataFrame([], NET), net)[3] == 0


def test_trainer_sees_all_events_and_comes_near_the_drivers_fit(spark):
    rows = net_events()
    train, held = spark.createDataFrame(rows[:700], NET).drop("weight"), spark.createDataFrame(rows[700:], NET)
    net = models.UtilityNet(outcomes=2, width=6, persons=3, hidden=8, attributes=3)
    t = training.Trainer(net, epochs=12, batch=100, rate=0.03).fit(train, held)
    assert all(c["events"] == 700 and c["validation_events"] == 200 for c in t.curve)
    assert [c["steps"] for c in t.curve] == [7 * (i + 1) for i in range(len(t.curve))]
    rates = [c["rate"] for c in t.curve]
    assert rates[0] == 0.03 and rates == sorted(rates, reverse=True)
    null = np.mean([np.log(len(r[2]) / 12) for r in rows[700:]])
    best = min(c["nll"] for c in t.curve)
    assert best < 0.75 * null and training.likelihood(held, t.net)[0] == pytest.approx(best)
    p = t.score(held).withColumn("p", F.exp("score")).groupBy("event_id").agg(F.count("*").alias("n"))
    assert p.count() == 200
    # A driver's fit to the same events of one size.
    same = [r for r in rows if len(r[2]) == 36]
    cut = len(same) * 3 // 4
    arrays = lambda some: (np.array([r[1] for r in some]), np.array([r[2] for r in some]).reshape(len(some), 3, 2, 6), np.array([r[3] for r in some]), np.ones(len(some)))
    one = models.UtilityNet(outcomes=2, width=6, persons=3, hidden=8, attributes=3)
    curve = one.fit(arrays(same[:cut]), arrays(same[cut:]), epochs=12, batch=64, rate=0.03)
    u = training.Trainer(models.UtilityNet(outcomes=2, width=6, persons=3, hidden=8, attributes=3), epochs=12, batch=64, rate=0.03)
    u.fit(spark.createDataFrame(same[:cut], NET).drop("weight"), spark.createDataFrame(same[cut:], NET))
    assert min(c["nll"] for c in u.curve) < 1.1 * min(curve)


def test_trainer_stops_early(spark):
    rng = np.random.default_rng(1)
    noise = [(r[0], r[1], r[2], int(rng.integers(len(r[2]) // 12)), 1.0) for r in net_events(120)]
    net = models.UtilityNet(outcomes=2, width=6, persons=3, hidden=16, attributes=3)
    t = training.Trainer(net, epochs=30, batch=200, rate=0.2, patience=2).fit(spark.createDataFrame(noise[:80], NET), spark.createDataFrame(noise[80:], NET))
    curve = [c["nll"] for c in t.curve]
    assert t.stopped_early and len(curve) < 30 and int(np.argmin(curve)) == len(curve) - 3
    assert training.likelihood(spark.createDataFrame(noise[80:], NET), t.net)[0] == pytest.approx(min(curve))


def hierarchy_rows(n=1200, seed=3):
    """Long form: two features whose weights differ by category and customer. Customer 0 has a third of all events."""
    rng = np.random.default_rng(seed)
    by_category = {c: w for c, w in zip("abc", ([1.5, 0.0], [0.0, 0.0], [-1.5, 0.5]))}
    by_customer = rng.normal(size=(40, 2)) * 0.8
    rows = []
    for i in range(n):
        customer = 0 if i % 3 == 0 else int(rng.integers(40))
        category = "abc"[int(rng.integers(3))]
        x = rng.normal(size=(4, 2))
        u = x @ (np.array([1.0, -2.0]) + by_category[category] + by_customer[customer]) + rng.gumbel(size=4)
        rows += [(i, j, bool(j == u.argmax()), f"k{customer}", category, float(x[j, 0]), float(x[j, 1])) for j in range(4)]
    return rows, by_category, by_customer


LONG = "event_id long, alt_idx long, chosen boolean, customer_id string, event_category string, f double, g double"


def test_three_levels_are_fitted_together(spark):
    from tallyspark.operators import hierarchy, metrics

    rows, by_category, by_customer = hierarchy_rows()
    train, test = spark.createDataFrame(rows[:4000], LONG), spark.createDataFrame(rows[4000:], LONG)
    model = hierarchy.HierarchicalLogit(["f", "g"], tau=2.0, nu=1.0, rounds=8, tolerance=1e-6, buckets=3).fit(train)
    assert all(b >= a - 1e-6 for a, b in zip(model.history, model.history[1:])) and len(model.history) > 6
    # The posterior, its penalties and its stationary point, in one process.
    own = {level: {r["key"]: np.array(r["w"]) for r in model.deviations(level).collect()} for level in ("category", "customer")}
    assert set(own["category"]) == set("abc") and len(own["customer"]) == 40
    posterior, grad = 0.0, {"g": -model.weights / 100, **{("category", k): -w / 4 for k, w in own["category"].items()}, **{("customer", k): -w for k, w in own["customer"].items()}}
    for at in range(0, 4000, 4):
        some = rows[at : at + 4]
        x, (customer, category) = np.array([r[5:] for r in some]), some[0][3:5]
        s = x @ (model.weights + own["category"][category] + own["customer"][customer])
        p = np.exp(s - s.max()) / np.exp(s - s.max()).sum()
        place = [r[2] for r in some].index(True)
        posterior += np.log(p[place])
        for key in ("g", ("category", category), ("customer", customer)):
            grad[key] = grad[key] + x[place] - p @ x
    posterior -= model.weights @ model.weights / 200 + sum(w @ w for w in own["category"].values()) / 8 + sum(w @ w for w in own["customer"].values()) / 2
    assert model.posterior == pytest.approx(posterior, rel=1e-5)
    assert max(np.abs(v).max() for v in grad.values()) < 5  # of sums over 1,000 events: near the top
    # Planted effects: differences between categories, and of the customer with many events.
    found = own["category"]["a"] - own["category"]["c"]
    assert np.allclose(found, np.subtract(by_category["a"], by_category["c"]), atol=0.8)
    hot = own["customer"]["k0"] - np.mean(list(own["customer"].values()), axis=0)
    assert np.allclose(hot, by_customer[0] - by_customer.mean(0), atol=0.8)
    nll = lambda m: metrics.per_event(m.score(test)).agg(F.avg("nll")).first()[0]
    assert nll(model) < nll(models.PriorLogit(["f", "g"]).fit(train)) - 0.02
    new = model.score(test.withColumns({"customer_id": F.lit("never seen"), "event_category": F.lit(None).cast("string")}))
    assert new.count() == test.count() and new.filter("score IS NULL").count() == 0
    model.clear()


def test_priors_are_picked_by_validation_likelihood(spark):
    from tallyspark.operators import hierarchy

    rows, *_ = hierarchy_rows(300)
    train, test = spark.createDataFrame(rows[:800], LONG), spark.createDataFrame(rows[800:], LONG)
    model, grid = hierarchy.tuned(train, test, ["f", "g"], sigmas=(10.0,), taus=(0.01, 2.0), nus=(0.5,), rounds=2, buckets=2)
    assert [(r["tau"], r["nu"]) for r in grid] == [(0.01, 0.5), (2.0, 0.5)]
    assert grid[1]["nll"] < grid[0]["nll"] and model.tau == 2.0
    model.clear()


def term_rows(n=900, seed=5):
    """Alternatives whose choice follows routine, and popularity only where novelty is 1."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        routine, popularity, novelty = rng.integers(0, 4, 5), rng.integers(0, 200, 5), rng.integers(0, 2, 5)
        recency = rng.integers(0, 50, 5)
        u = 0.8 * routine + 0.7 * novelty * np.log1p(popularity) + rng.gumbel(size=5)
        rows += [(i, j, bool(j == u.argmax()), f"c{i % 4}", bool(novelty[j] == 0), bool(popularity[j] > 100), int(routine[j]), float(recency[j]), int(novelty[j]), int(popularity[j])) for j in range(5)]
    return rows


TERMS = "event_id long, alt_idx long, chosen boolean, category string, is_repeat boolean, is_popular boolean, routine int, recency_days double, novelty int, popularity int"


def test_a_frontier_is_fitted_in_one_go(spark):
    from tallyspark.functions.terms import parse
    from tallyspark.operators import frontier

    rows = term_rows()
    train, held = spark.createDataFrame(rows[:3500], TERMS), spark.createDataFrame(rows[3500:], TERMS)
    base = ["routine", "recency", "novelty", "popularity"]
    structures = [tuple(map(parse, s)) for s in (["routine"], ["routine", "popularity"], ["routine", "interaction(novelty, popularity)"], ["ratio(routine, recency)", "threshold(popularity, cutoff=3)"])]
    one, all_ = frontier.TermFits(train, held, base), frontier.TermFits(train, held, base)
    for s in structures:
        one.fit([s])
    all_.fit([*structures, structures[0]])
    assert all_.jobs < one.jobs / 2
    for s in structures:
        assert all_.score(s) == pytest.approx(one.score(s), rel=1e-6) and all_.known[s][1].n == 700 and all_.known[s][1].held_n == 200
        assert np.abs(all_.known[s][1].grad + all_.known[s][0] / 100).max() < 1e-2  # at the top
    assert max(structures, key=all_.score) == structures[2]
    w = models.PriorLogit(["a", "b"], precision=0.01).fit(train.withColumns({"a": F.col("routine").cast("double"), "b": F.log1p("popularity")})).weights
    assert np.allclose(w, all_.known[structures[1]][0], atol=1e-3)
    wrong = all_.residuals(structures[0])
    assert len(wrong) == 4 and {r["category"] for r in wrong} == {"c0", "c1", "c2", "c3"} and all(r["error_rate"] > 0.3 for r in wrong)
    count = all_.jobs
    all_.fit(structures)
    assert all_.jobs == count
    one.clear()
    all_.clear()


def test_search_finds_the_planted_interaction(spark):
    from tallyspark.functions.terms import parse
    from tallyspark.operators import frontier

    rows = term_rows()
    fits = frontier.TermFits(spark.createDataFrame(rows[:3500], TERMS), spark.createDataFrame(rows[3500:], TERMS), ["routine", "recency", "novelty", "popularity"])
    seen = []

    def propose(now, slices, base, rng, n):
        seen.append(slices)
        return frontier.by_residuals(now, slices, base, rng, n)

    search = frontier.FrontierSearch(rounds=4, propose=propose, seed=1)
    best = search.search(fits, (parse("routine"),))
    assert any({"novelty", "popularity"} == set(t.args) for t in best) and parse("routine") in best
    assert len(seen) == 4 and all(s and {"pattern", "error_rate"} <= set(s[0]) for s in seen)
    assert fits.score(best) == max(h["score"] for h in search.history if h["accepted"])
    assert {h["kind"] for h in search.history} == {"start", "guided", "random"}
    none = frontier.FrontierSearch(rounds=2, guided=0, drawn=5, seed=1)
    none.search(fits, (parse("routine"),))
    assert {h["kind"] for h in none.history} == {"start", "random"}
    fits.clear()


def test_rules_of_acceptance():
    from tallyspark.operators import frontier

    greedy, late = frontier.Greedy(), frontier.LateAcceptance(2)
    assert greedy(1, 2, 1, 5) and not greedy(1, 1, 1, 5)
    margin = frontier.Threshold(5, 0)
    assert margin(10, 6, 0, 5) and not margin(10, 5, 0, 5) and not margin(10, 9.9, 5, 5)
    assert late(1, 2, 1, 9) and late(2, 3, 2, 9) and late(3, 2.5, 3, 9) and not late(2.5, 2.5, 4, 9)
    hot, cold = frontier.Annealing(1e6, 1e6), frontier.Annealing(1e-9, 1e-9)
    assert all(hot(1, 0.5, i, 9) for i in range(20)) and not any(cold(1, 0.5, i, 9) for i in range(20)) and cold(1, 1.1, 0, 9)
    half = frontier.Annealing(1.0, 1.0)
    taken = sum(half(0, -np.log(2), i, 9) for i in range(2000)) / 2000
    assert abs(taken - 0.5) < 0.05


EQUATIONS = [
    "c[0] * x[0]", "c[0] + c[1] * x[1]", "log1p(c[0] * x[0] - x[1])", "exp(c[0] * x[0] + c[1])", "sqrt(c[0] * x[0] * x[1])", "tanh(c[0] * x[2]) * c[1]", "abs(c[0] * x[0] - c[1]) * x[3]",
    "(c[0] * x[0] + c[1]) ** 2", "(c[0] * x[0]) ** 0 + c[1] ** 1 * x[1]", "-c[0] * (x[0] - c[1] * x[1])", "c[0] * c[0] * x[0] * exp(-c[1] * x[1])", "2 * x[0] - c[3] * x[1]", "x[0] * x[1]", "3",
]


@pytest.mark.parametrize("body", EQUATIONS)
def test_derivatives_equal_differences(spark, body):
    """In arrays and in columns, for every form of the grammar."""
    from tallyspark.functions import formula

    text = f"def utility(x, c):\n    return {body}"
    rng = np.random.default_rng(len(body))
    x, c = [rng.normal(size=30) for _ in range(4)], rng.normal(size=8)
    numpy = lambda c: formula.utility_gradient(text, x, list(c), formula.NUMPY_FUNCTIONS, formula.NUMPY_SLOPES, float)
    value, slopes = numpy(c)
    assert len(slopes) <= formula.utility(text, x, list(c), formula.NUMPY_FUNCTIONS, float)[1]
    for k in range(8):
        step = np.eye(8)[k] * 1e-6
        differ = np.broadcast_to((numpy(c + step)[0] - numpy(c - step)[0]) / 2e-6, 30)
        assert np.allclose(np.broadcast_to(slopes.get(k, 0.0), 30), differ, rtol=1e-4, atol=1e-6)
    rows = spark.createDataFrame([tuple(float(v) for v in r) for r in zip(*x)], "x0 double, x1 double, x2 double, x3 double")
    u, du = formula.utility_gradient(text, [F.col(f"x{i}") for i in range(4)], list(c))
    got = rows.select(u.alias("u"), *(d.alias(f"d{k}") for k, d in du.items())).collect()
    assert np.allclose([r["u"] for r in got], np.broadcast_to(value, 30))
    assert all(np.allclose([r[f"d{k}"] for r in got], np.broadcast_to(slopes[k], 30)) for k in du)


def test_quasi_newton_steps():
    from tallyspark.operators import symbolic

    valley = lambda x: (float((1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2), np.array([-2 * (1 - x[0]) - 400 * x[0] * (x[1] - x[0] ** 2), 200 * (x[1] - x[0] ** 2)]))
    value, x = symbolic.bfgs(valley, np.array([-1.2, 1.0]))
    assert value < 1e-8 and np.allclose(x, 1, atol=1e-3)
    walled = lambda x: (float(x[0] - np.log(x[0])), 1 - 1 / x) if x[0] > 0 else (float("inf"), np.zeros(1))
    assert symbolic.bfgs(walled, np.array([9.0]))[1][0] == pytest.approx(1, abs=1e-3)
    assert symbolic.bfgs(walled, np.array([-1.0]))[0] == float("inf")


def test_coefficients_are_fitted_to_all_events(spark):
    from tallyspark.functions.formula import NUMPY_FUNCTIONS, utility
    from tallyspark.operators import metrics, symbolic

    rng = np.random.default_rng(2)
    rows = []
    for i in range(500):
        x = rng.normal(size=(3, 2))
        u = 2 * np.tanh(1.5 * x[:, 0]) - x[:, 1] + rng.gumbel(size=3)
        rows += [(i, j, bool(j == u.argmax()), float(x[j, 0]), float(x[j, 1])) for j in range(3)]
    table = spark.createDataFrame(rows, "event_id long, alt_idx long, chosen boolean, a double, b double")
    text = "def utility(x, c):\n    return c[0] * tanh(c[1] * x[0]) + c[2] * x[1]"
    search = symbolic.EquationSearch(["a", "b"], proposals=3, propose=lambda *_: text)
    search.fit(table)
    assert search.n == 500 and np.abs(symbolic.over_all(models.packed(table, ["a", "b"]), text, 2, search.coefficients)[1]).max() < 1e-3
    assert abs(search.coefficients[2] + 1) < 0.3 and abs(search.coefficients[0] * np.tanh(search.coefficients[1]) - 2 * np.tanh(1.5)) < 0.4
    one = symbolic.fit(text, (*[([np.array([r[3] for r in rows]), np.array([r[4] for r in rows]), np.zeros(1500), np.zeros(1500)])], np.repeat(np.arange(500), 3), np.array([i for i, r in enumerate(rows) if r[2]])))
    assert search.likelihood == pytest.approx(one[0], abs=1e-5)
    assert metrics.per_event(search.score(table)).agg(F.avg("nll")).first()[0] == pytest.approx(search.likelihood)
    assert utility(text, [0.0] * 4, [], NUMPY_FUNCTIONS, float)[1] == 3


def test_concepts_come_in_and_go():
    from tallyspark.functions.formula import instance, trivial
    from tallyspark.operators.symbolic import Library, answer, stub_proposals

    wrap = lambda body: f"def utility(x, c):\n    return {body}"
    often, once = wrap("c[0] * log1p(x[1]) + c[1] * x[0]"), wrap("c[0] * tanh(x[2] * x[3])")
    plain, named = Library(promote_at=3), Library(promote_at=3)
    survivors = [often, wrap("c[0] * log1p(x[1])"), wrap("x[0] - c[2] * log1p(x[1])"), once]
    plain.update(survivors, [], 0)
    named.update(survivors, ["curve"], 0)
    assert "(c*log1p(x[1]))" in plain.forms and not any("tanh" in f for f in plain.forms)
    assert "curve" in named.parts and named.parts["curve"]["form"] not in plain.forms and named.parts["curve"]["used"] == 1
    assert not any(trivial(f) for f in named.forms) and trivial("(c*x[0])") and trivial("tanh(c)")
    for step in range(1, 6):
        named.update([survivors[1]], [], step)
    assert "curve" not in named.parts  # no survivor had it for five updates
    small = Library(size=1, promote_at=1)
    small.update(survivors, [], 0)
    assert len(small.parts) == 1
    assert instance("(c*tanh((c+x[0])))", 3) == ("(c[3]*tanh((c[4]+x[0])))", 5)
    assert answer("NOMINATE: a\n NOMINATE: b1\ndef utility(x, c):\n    return x[0]") == ("def utility(x, c):\n    return x[0]", ["a", "b1"])
    draw = lambda i, memory, library: answer(stub_proposals(np.random.default_rng(i), memory, library))[0]
    assert sum("tanh((x[2]*x[3]))" in draw(i, [], ["tanh((x[2]*x[3]))"]) for i in range(60)) > 10
    assert sum("tanh(x[1])" in draw(i, [wrap("c[0] * sqrt(tanh(x[1]))")], []) for i in range(60)) > 5
    assert not any("tanh(x[1])" in draw(i, [], []) and "tanh((" in draw(i, [], []) for i in range(60))


def test_text_net_stops_and_drops_what_gives_the_choice_away(spark):
    from tallyspark.operators import metrics, nets

    rng = np.random.default_rng(3)
    words = ["plain", "large", "small", "red", "cheap"]
    rows = []
    for i in range(500):
        own = [words[j] for j in rng.choice(5, 4, replace=False)]
        u = np.array([2.0 * (w == "cheap") - (w == "large") for w in own]) + rng.gumbel(size=4)
        rows += [(i, j, bool(j == u.argmax()), f"{w} thing", bool(j == u.argmax()), bool(rng.random() < 0.3)) for j, w in enumerate(own)]
    table = spark.createDataFrame(rows, "event_id long, alt_idx long, chosen boolean, title string, leak boolean, fair boolean")
    train, test = table.filter("event_id < 400"), table.filter("event_id >= 400")
    leaky, fair = (nets.TextNet("title", repeat, width=32, epochs=40, patience=3).fit(train) for repeat in ("leak", "fair"))
    assert leaky.dropped_repeat and not fair.dropped_repeat
    nll = lambda m: metrics.per_event(m.score(test)).agg(F.avg("nll")).first()[0]
    assert np.log(4) - 0.2 > nll(leaky) > 0.5 and leaky.score(test).columns == [*test.columns, "score"]
    assert len(leaky.net.curve) < 40 and int(np.argmin(leaky.net.curve)) >= len(leaky.net.curve) - 4
    held = train.filter(F.pmod(F.xxhash64(F.lit("held"), "event_id"), F.lit(10)) == 0)
    assert metrics.per_event(leaky.score(held)).agg(F.avg("nll")).first()[0] == pytest.approx(min(leaky.net.curve), abs=1e-6)


def test_dropout_gradient_equals_differences():
    from tallyspark.operators import nets

    rng = np.random.default_rng(0)
    net = nets.NetLogit(["a", "b"], hidden=4, monotone={"a": 1})
    net.p = {"a": rng.normal(size=(2, 4)), "b": rng.normal(size=4), "c": rng.normal(size=4), "w": rng.normal(size=2)}
    x, event, own = rng.normal(size=(12, 2)), np.repeat(np.arange(4), 3), np.array([0, 4, 8, 10])
    mask = (rng.random((12, 4)) > 0.3) / 0.7
    _, g = net.loss(x, event, own, mask)
    for name, z in net.p.items():
        for at in np.ndindex(z.shape):
            old = z[at]
            z[at] = old + 1e-6
            up = net.loss(x, event, own, mask)[0]
            z[at] = old - 1e-6
            down = net.loss(x, event, own, mask)[0]
            z[at] = old
            assert g[name][at] == pytest.approx((up - down) / 2e-6, abs=1e-5)


def test_no_stand_in_in_a_real_run(spark):
    from tallyspark.operators import runs, search

    rows, names, form = logit_rows([1.0, 0.5], n=60)
    table = spark.createDataFrame(rows, form).withColumns({"asin": F.col("alt_idx").cast("string"), "t": F.lit("x")})
    ask = lambda shown: F.lit('{"A": 1}')
    made = {"relevance_logit": lambda: models.PriorLogit(names), "equations": lambda: runs.symbolic.EquationSearch(names, proposals=2), "ranker": lambda: runs.Ranker("t", ask)}
    status = lambda **k: {r["model"]: r["status"] for r in search.leaderboard(made, table, table, **k).collect()}
    assert status(stand_ins=False) == {"relevance_logit": "ok", "equations": "errored", "ranker": "ok"}
    ask.stand_in = True
    assert status(stand_ins=False)["ranker"] == "errored"


def logit_rows(weights, n=800, alternatives=4, seed=0):
    rng = np.random.default_rng(seed)
    names = [f"x{i}" for i in range(len(weights))]
    rows = []
    for i in range(n):
        x = rng.normal(size=(alternatives, len(weights)))
        u = x @ np.array(weights) + 0.8 * x[:, 0] * x[:, 1] * (seed == 9) + rng.gumbel(size=alternatives)
        rows += [(i, j, bool(j == u.argmax()), *map(float, x[j])) for j in range(alternatives)]
    return rows, names, "event_id long, alt_idx long, chosen boolean, " + ", ".join(f"{n} double" for n in names)


def test_variational_posterior_is_near_the_laplace_one(spark):
    from tallyspark.operators import metrics, relevance

    rows, names, form = logit_rows([1.5, -1.0, 0.0, 0.0])
    train, test = spark.createDataFrame(rows[:2400], form), spark.createDataFrame(rows[2400:], form)
    model = relevance.RelevanceLogit(names, steps=40, threshold=200).fit(train, test)
    laplace = models.PriorLogit(names, relevance=True, rounds=10, dropped=200).fit(train)
    natural = model.posterior_mean / model.std
    assert np.allclose(natural[:2], laplace.weights[:2], atol=0.1) and np.abs(natural[2:]).max() < 0.15
    wide = np.sqrt(np.diag(laplace.covariance))[:2]
    assert np.allclose(model.posterior_deviation[:2] / model.std[:2], wide, rtol=0.35)
    assert {"x0", "x1"} <= set(model.relevant) and model.precisions[:2].max() < 5 and model.precisions[2:].min() > 5 * model.precisions[:2].max()
    assert np.mean(model.bound[-8:]) >= np.mean(model.bound[:8]) - 5  # each slice twice
    assert np.allclose(model.draws(20_000).std(0), model.posterior_deviation, rtol=0.05)
    nll = metrics.per_event(model.score(test)).agg(F.avg("nll")).first()[0]
    assert nll < np.log(4) - 0.3 and 0.7 < model.temperature < 1.4


def test_interactions_and_temperature(spark):
    from tallyspark.operators import metrics, relevance

    rows, names, form = logit_rows([1.0, 0.5], seed=9)
    train, test = spark.createDataFrame(rows[:2400], form), spark.createDataFrame(rows[2400:], form)
    with_, without = (relevance.RelevanceLogit(names, interactions=i, steps=16).fit(train) for i in (True, False))
    assert with_.features == ["x0", "x1", "x0__x__x1"] and abs(with_.posterior_mean[2] / with_.std[2] - 0.8) < 0.25
    nll = lambda m: metrics.per_event(m.score(test)).agg(F.avg("nll")).first()[0]
    assert nll(with_) < nll(without) - 0.03 and with_.score(test).columns == [*test.columns, "score"]
    with_.weights = with_.weights * 3  # too sure of itself
    assert abs(with_._temperature(test) - 3) < 0.8


def test_classifiers_weigh_events_alike_and_are_tuned(spark):
    from tallyspark.operators import metrics

    rng = np.random.default_rng(4)
    rows = []
    for i in range(400):
        j = int(rng.choice([2, 10]))
        x = rng.normal(size=(j, 2))
        u = 2.5 * x[:, 0] + rng.gumbel(size=j)
        rows += [(i, a, bool(a == u.argmax()), float(x[a, 0]), float(x[a, 1])) for a in range(j)]
    table = spark.createDataFrame(rows, "event_id long, alt_idx long, chosen boolean, x double, y double").repartition(3)
    weights = {r["n"]: (r["w"], r["total"]) for r in models.Classifier(["x", "y"]).rows(table).groupBy(F.round(1 / F.col("_w")).alias("n")).agg(F.first("_w").alias("w"), F.sum("_w").alias("total")).collect()}
    size = {k: sum(1 for i in {r[0] for r in rows} if sum(r[0] == i for r in rows) == k) for k in (2, 10)}
    assert weights[2.0][0] == pytest.approx(1 / 2) and weights[10.0][0] == pytest.approx(1 / 10)
    assert weights[2.0][1] == pytest.approx(size[2]) and weights[10.0][1] == pytest.approx(size[10])
    grid = [{"numTrees": 1, "maxDepth": 0}, {"numTrees": 20, "maxDepth": 4}]
    best, trials = models.tuned_classifier(["x", "y"], table, grid=grid)
    assert [t["maxDepth"] for t in trials] == [0, 4] and trials[1]["nll"] < trials[0]["nll"] and best.options == grid[1]
    held = table.filter(F.pmod(F.xxhash64("event_id"), F.lit(10)) == 0)
    assert trials[1]["nll"] == pytest.approx(metrics.per_event(best.score(held)).agg(F.avg("nll")).first()[0])
    deep, _ = models.tuned_classifier(["x", "y"], table, held, "perceptron", [{"hidden": (4, 3), "maxIter": 5}])
    assert deep.score(held).filter("score IS NULL").count() == 0
