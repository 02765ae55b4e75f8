"""Semantics that SQL alone doesn't show: leakage, errors, sampling, sources."""

import json

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tallyspark.functions import formula, text
from tallyspark.operators import catalog, choice, history, legacy, metrics, models, outcomes, persons, posthoc, split, validate
from tallyspark.sources import store
from tallyspark.streaming.popularity import windowed_popularity

DAY = 86_400_000_000
EVENTS = "customer_id string, us long, asin string, category string, price double, quantity double, seq string, title string, state string"


def event(c, day, asin, category="toys", seq=0, title="Acme ball", price=2.0):
    return (c, int(day * DAY), asin, category, price, 1.0, f"{seq:04d}", title, "XX")


@pytest.fixture(scope="module")
def events(spark):
    rows = []
    for c in range(12):
        for i in range(14):
            rows.append(event(f"c{c}", i * 3 + c % 3, f"i{(c * 5 + i * i) % 9}", f"k{(c + i) % 3}", i, f"{'new' if i % 2 else ''} Brand{(c + i) % 4} thing", 1.0 + i))
    return spark.createDataFrame(rows, EVENTS)


def test_history_by_hand(spark):
    rows = [event("a", 0, "x", seq=0), event("a", 0, "x", seq=1), event("a", 1.5, "y", seq=2), event("a", 7, "x", seq=3), event("a", 40, "x", "food", seq=4)]
    got = {r["seq"]: r for r in history.state_features(spark.createDataFrame(rows, EVENTS)).collect()}
    assert [got[f"{i:04d}"]["routine"] for i in range(5)] == [0, 1, 0, 2, 3]
    assert [got[f"{i:04d}"]["recency_days"] for i in range(5)] == [999, 0, 999, 7, 33]
    assert [got[f"{i:04d}"]["cat_count_7d"] for i in range(5)] == [1, 2, 3, 2, 1]
    assert [got[f"{i:04d}"]["cat_affinity"] for i in range(5)] == [0, 1, 2, 3, 0]
    assert [got[f"{i:04d}"]["novelty"] for i in range(5)] == [1, 0, 1, 0, 0]


def test_single_event_customer_has_no_train_row(spark):
    one = split.temporal_split(spark.createDataFrame([event("a", 0, "x")], EVENTS))
    assert one.first()["split"] == "test"
    with pytest.raises(validate.Violation, match="train row"):
        validate.temporal_split(one)


def test_catalogue_ignores_later_rows(events):
    """Whatever val and test rows hold, what training rows say about items stays."""
    s = split.temporal_split(events)
    spoiled = s.withColumns({c: F.when(F.col("split") == "train", F.col(c)).otherwise(F.lit(v).cast(s.schema[c].dataType)) for c, v in (("title", "Evil"), ("category", "bad"), ("us", "0"))})
    for f in (catalog.popularity, catalog.brand_map, catalog.first_seen, catalog.dominant_category):
        assert sorted(map(tuple, f(s).collect())) == sorted(map(tuple, f(spoiled).collect()))


def test_splits_partition_customers(events):
    cold = split.cold_start_split(events, 0.2, 0.2)
    validate.cold_start_split(cold)
    assert {r[0] for r in cold.select("split").distinct().collect()} == {"train", "val", "test"}
    folds = split.kfold(events, 4).collect()
    tests = [r["customer_id"] for r in folds if r["split"] == "test"]
    assert sorted(tests) == sorted({r["customer_id"] for r in folds}) and len(folds) == 4 * 12
    with pytest.raises(validate.Violation):
        validate.cold_start_split(split.temporal_split(events))


def test_choice_sets(events):
    s = split.temporal_split(events)
    sets = choice.choice_sets(s, negatives=4, resamples=2)
    again = choice.choice_sets(s.repartition(7, "asin"), negatives=4, resamples=2)
    got = sorted(map(str, sets.collect()))
    assert got == sorted(map(str, again.collect())) and len(got) == 2 * 12 * 14
    seen = {r["asin"]: r["first_us"] for r in catalog.first_seen(s).collect()}
    when = {f"{r['customer_id']}|{r['seq']}": r["us"] for r in events.collect()}
    other = 0
    for r in sets.collect():
        assert r["choice_asins"][r["chosen_idx"]] == r["chosen_asin"] and len(r["choice_asins"]) == 5
        negatives = [a for a in r["choice_asins"] if a != r["chosen_asin"]]
        assert all(seen[a] < when[r["event_key"]] for a in negatives)
        if not r["dedup_fallback"]:
            assert len(set(negatives)) == 4
            other += 1
    assert other > 100


def test_pool_lines_hold_all_draws(events):
    laid = choice.line(choice.catalogue(split.temporal_split(events)))
    total = laid.agg(F.max("high")).first()[0]
    points = laid.sparkSession.range(3000).withColumn("at", choice.uniform(F.col("id")) * total)
    found = choice.drawn(points, laid)
    assert found.count() == 3000
    share = {r["asin"]: r["n"] / 3000 for r in found.groupBy("asin").agg(F.count("*").alias("n")).collect()}
    want = {r["asin"]: r["weight"] / total for r in laid.collect()}
    assert all(abs(share.get(a, 0) - w) < 0.04 for a, w in want.items())


@pytest.mark.parametrize("bad", ["__import__('os')", "a.b", "[1]", "lambda: 1", "a if b else c", "a == 1 == 2", "'x' + 1", "nope + 1", "`a", "a; b", "abs(a, a)", "min(a)", "t + 1", "f(a)", "a < 1"])
def test_hostile_formulas(spark, bad):
    with pytest.raises(formula.FormulaError):
        formula.composite(bad, {"a": "double", "b": "double", "c": "double", "t": "string"})


@pytest.mark.parametrize(
    "bad", ["import os", "def utility(x, c): return x[9]", "def utility(x, c): return c[-1]", "def utility(x): return 1", "def utility(x, c):\n    y = 1\n    return y", "def utility(x, c): return x[0] ** 3", "def utility(x, c): return x[0] / x[1]", "def utility(x, c): return open('f')", "def utility(x, c=1): return 1"]
)
def test_hostile_equations(spark, bad):
    with pytest.raises(formula.FormulaError):
        formula.utility(bad, [F.lit(1.0)] * 4, [1.0] * 8)


def test_formula_missing_values(spark):
    df = spark.createDataFrame([(1.0, None, "x", True), (None, 0.0, None, None)], "a double, b double, t string, f boolean")
    k = dict(df.dtypes)
    got = df.select(formula.composite("a / b", k, fallback=-1), formula.composite("t == 'x'", k), formula.composite("f + 1", k), formula.composite("max(a, b)", k, low=5.0)).collect()
    assert [tuple(r) for r in got] == [(-1.0, 1.0, 2.0, None), (-1.0, 0.0, None, None)]
    _, n = formula.utility("def utility(x, c):\n    return -c[2] * x[0] ** 0 + exp(x[1])", [F.lit(1.0)] * 4, [])
    assert n == 3


def test_unknown_category_raises(spark):
    df = spark.createDataFrame([("1", "a"), ("2", "zzz")], "id string, s string")
    with pytest.raises(Exception, match="unknown"):
        persons.translate(df, [persons.Field("s", "categorical_map", "s", {"a": "A"})], "id").collect()
    with pytest.raises(ValueError):
        persons.translate(df, [persons.Field("s", "constant", "s")], "id")


def test_vector_and_context(spark):
    row = ("1", "65+", "<25k", 7, 1, "rural", 2, 5, 0.6, 2.5, 0.85)
    kinds = "customer_id string, age_bucket string, income_bucket string, household_size int, has_kids int, city_size string, education int, health_rating int, risk_tolerance double, purchase_frequency double, novelty_rate double"
    df = spark.createDataFrame([row], kinds)
    z = persons.vectors(df, persons.fit(df)).first()["z"]
    assert len(z) == 26 and z[5] == 1 and z[6] == 1 and z[15] == 1 and z[16] == 1 and z[17] == 1 and z[-1] == pytest.approx(0.85)
    out = df.select(persons.context(recent=F.array(F.lit("ball")), now=F.lit("Monday")).alias("c")).first()["c"].split("\n")
    assert out[1] == "- Age: mid-60s or older; household of 7 (several children)." and out[5].startswith("- Buys at the store roughly twice per week; nearly all")
    assert out[-2:] == ["Recent purchases (last 30 days): ball.", "Current time: Monday."]
    assert df.select(persons.leaks(F.lit("aged 25-34"))).first()[0] and not df.select(persons.leaks(persons.context())).first()[0]
    with pytest.raises(Exception, match="vocabulary"):
        persons.vectors(df.withColumn("age_bucket", F.lit("?")), persons.fit(df)).collect()


def test_text_functions(spark):
    one = spark.range(1)
    get = lambda c: one.select(c).first()[0]
    assert get(catalog.brand_token(F.lit("NEW, 2pk 10-pack !Acme! ball"))) == "acme"
    assert get(text.scrub_title(F.lit("a 65+ b"))) == "a b" and get(text.scrub_title(F.lit("x" * 100))) == "x" * 80
    assert text.snake_case(" Q-demos (Age)? ") == "q_demos_age"
    assert get(text.outcomes(F.lit(" a \n\n b\n"), 3)) == ["a", "b", text.PAD]
    assert get(text.title_of_alternative(F.lit("t"), F.lit("c"), F.lit(1.25), F.lit(3))) .startswith("t. Category: c. Price: $1.")


def test_metrics_by_hand(spark):
    rows = [(1, i, s, i == 1) for i, s in enumerate([1.0, 1.0, 0.0])] + [(2, i, s, i == 0) for i, s in enumerate([5.0, 1.0, 0.0])]
    got = {r["event_id"]: r for r in metrics.per_event(spark.createDataFrame(rows, "event_id long, alt_idx long, score double, chosen boolean")).collect()}
    assert got[1]["rr"] == pytest.approx(1 / 1.5) and got[1]["rank"] == 1 and not got[1]["top1"] and got[2]["top1"]
    e = np.exp([1.0, 1.0, 0.0])
    assert got[1]["nll"] == pytest.approx(-np.log(e[1] / e.sum()))
    with pytest.raises(Exception, match="hour"):
        spark.range(1).select(metrics.time_of_day(F.lit(24))).collect()


def test_validators(spark):
    df = spark.createDataFrame([("a", 1.0, "x"), (None, -1.0, "y"), ("c", float("nan"), None)], "a string, b double, c string")
    for check in (validate.not_null("a"), validate.not_negative("b"), validate.within("c", ["x"])):
        with pytest.raises(validate.Violation) as e:
            validate.validate(df, [check], "test")
        assert 1 <= len(e.value.rows) <= validate.MOST_ROWS
    validate.validate(df.limit(1), [validate.not_negative("b", sentinel=-1.0)], "test")
    with pytest.raises(validate.Violation):
        validate.columns_present(df, ["zz"], "test")
    with pytest.raises(validate.Violation):
        validate.type_is(df, "a", "int", "test")
    with pytest.raises(validate.Violation):
        validate.joined(df, ["c"])
    good = spark.createDataFrame([(1, 0, [1.0, 0.0], 2.0, 1.0, True), (1, 1, [0.0, 1.0], 2.0, 1.0, False)], "event_id long, alt_idx int, e array<float>, price double, omega double, chosen boolean")
    validate.batch(good, 2, 2)
    for c, v in (("e", F.array(F.lit(3.0), F.lit(0.0)).cast("array<float>")), ("price", F.lit(-1.0)), ("chosen", F.lit(True))):
        with pytest.raises(validate.Violation):
            validate.batch(good.withColumn(c, v), 2, 2)


def test_sources(spark, tmp_path):
    p = tmp_path / "e.csv"
    p.write_text('Order Date,Title,Price\n2020-01-01,"a, ""b""\nc",1.5\n2020-01-02,plain,oops\n')
    raw = store.read_csv(spark, str(p))
    assert raw.count() == 2 and raw.first()["Title"] == 'a, "b"\nc'
    schema = store.Schema("events: {column_map: {Nope: title, Title: title, Price: price, Order Date: day}, dropna_subset: [title], dtype_coerce: {price: float}}\ntraining: {choice_set_size: 4}")
    assert [r["price"] for r in store.clean(raw, schema).collect()] == [1.5, None] and schema.choice_set_size == 4
    with pytest.raises(store.SchemaError):
        store.Schema("events: {column_map: {Nope: title}}").event_columns(raw.columns)
    with pytest.raises(store.SchemaError):
        store.Schema("events: {dtype_coerce: {a: date}}")
    with pytest.raises(Exception):
        store.read_csv(spark, str(tmp_path / "none.csv")).count()

    stages = store.Stages(spark, str(tmp_path / "stages"))
    assert stages.status() == [] and not stages.has("a")
    stages.save("a", raw)
    assert stages.status() == ["a"] and stages.load("a").count() == 2
    with pytest.raises(FileNotFoundError, match="it has: a"):
        stages.load("b")
    stages.clear("a")
    assert not stages.has("a")

    board = spark.createDataFrame([("m", 1.0, [0.5])], "model string, nll double, per_event array<double>")
    store.save_leaderboard(board, str(tmp_path / "out"), "seed7")
    assert spark.read.option("header", True).csv(str(tmp_path / "out/leaderboard_seed7.csv")).first()["per_event"] == "[0.5]"
    (tmp_path / "events_seed7.json").write_text(json.dumps({"n": 1}))
    (tmp_path / "events_seed8.json").write_text(json.dumps({"n": 1}))
    seeds = store.read_seeds(spark, str(tmp_path / "events_seed*.json"))
    assert {r["seed"] for r in seeds.collect()} == {"7", "8"}
    assert store.unpaired(seeds, seeds.filter("seed = '7'")) == ["8"]


def test_cache_last_put_wins(spark):
    cache = spark.createDataFrame([("k", "old", 1.0)], "key string, value string, created_at double")
    new = store.put(cache, spark.createDataFrame([("k", "new", 2.0), ("l", "x", 1.0)], cache.schema))
    assert {tuple(r)[:2] for r in new.collect()} == {("k", "new"), ("l", "x")}
    hits, lost = store.lookup(spark.createDataFrame([("k",), ("z",), ("z",)], "key string"), new)
    assert [r["value"] for r in hits.collect()] == ["new"] and [r["key"] for r in lost.collect()] == ["z"]


def test_posthoc_planted_effect(spark):
    rng = np.random.default_rng(0)
    rows = [(m, "1", i, f"c{i % 7}", None, False, float(rng.normal(gap)), bool(rng.random() < rate), "ok") for m, gap, rate in (("own", 0.0, 0.8), ("same", 0.0, 0.8), ("worse", 1.0, 0.3)) for i in range(300)]
    r = spark.createDataFrame(rows, "model string, seed string, event_idx long, customer_id string, category string, is_repeat boolean, nll double, top1 boolean, status string")
    pairs = posthoc.paired(r, "own")
    w = {x["model"]: posthoc.wilcoxon_p(x["statistic"], x["n"], x["tie_term"]) for x in posthoc.wilcoxon(pairs).collect()}
    m = {x["model"]: posthoc.chi2_p(x["statistic"]) for x in posthoc.mcnemar(pairs).collect()}
    b = {x["model"]: x for x in posthoc.bootstrap(pairs, 300).collect()}
    assert w["worse"] < 1e-6 < 0.01 < w["same"] and m["worse"] < 1e-6 < 0.01 < m["same"]
    assert b["worse"]["delta_lo"] > 0.5 and b["same"]["delta_lo"] < 0 < b["same"]["delta_hi"]
    assert posthoc.shown_p(1e-9) == "<1e-6" and posthoc.shown_p(0.005) == "5.00e-03"


def test_models_find_planted_signal(spark):
    rng = np.random.default_rng(1)
    rows = []
    for e in range(400):
        x = rng.normal(size=(4, 3))
        own = int((2 * x[:, 0] + rng.gumbel(size=4)).argmax())
        rows += [(e, j, *map(float, x[j]), j == own) for j in range(4)]
    df = spark.createDataFrame(rows, "event_id long, alt_idx long, a double, b double, c double, chosen boolean")
    train, val = df.filter("event_id < 300"), df.filter("event_id >= 300")
    logit = models.SparseLogit(["a", "b", "c"], penalties=(0.05, 0.01), rounds=8).fit(train, val)
    assert logit.weights[0] > 1 and abs(logit.weights[1]) < 0.3 and abs(logit.weights[2]) < 0.3
    top = metrics.per_event(logit.score(val)).agg(F.avg(F.col("top1").cast("int"))).first()[0]
    assert top > 0.5
    for kind in ("forest", "boosting", "perceptron"):
        got = metrics.per_event(models.Classifier(["a", "b", "c"], kind).fit(train).score(val)).agg(F.avg(F.col("top1").cast("int"))).first()[0]
        assert got > 0.4


def test_subsamples(events):
    h = history.state_features(events)
    r = models.random_subsample(h, 5).collect()
    assert len(r) == 5 and all(x["weight"] == 1 for x in r)
    lev = models.leverage_subsample(h, 6, components=2).collect()
    assert len({x["customer_id"] for x in lev}) == 6 and sum(x["weight"] for x in lev) == pytest.approx(12)


def test_shares_of_other_categories_have_a_column(spark):
    p = spark.sql("select map('a', 0.5D, 'b', 0.25D, 'c', 0.125D, 'd', 0.125D) as shares union all select map('a', 1.0D)")
    got = sorted(map(tuple, p.select(*models.share_columns(["a", "b"])).collect()))
    assert got == [(0.5, 0.25, 0.25), (1.0, 0.0, 0.0)]


def test_leverage_follows_other_categories(events):
    h = history.state_features(events)
    got = models.leverage_subsample(h, 6, components=1, most_categories=1).collect()
    assert len({x["customer_id"] for x in got}) == 6


def test_outcomes(spark):
    t = spark.createDataFrame([("alpha beta",), ("alpha beta",), ("x",), (None,)], "text string")
    e = {r["text"]: r["e"] for r in outcomes.encode(t, outcomes.hash_vector).collect()}
    assert set(e) == {"alpha beta", "x"} and all(abs(sum(x * x for x in v) - 1) < 1e-5 for v in e.values())
    s = spark.range(1).select(outcomes.stub_outcomes(F.lit("k"), 3, F.lit(1)).alias("o")).first()["o"]
    assert len(s) == 3 == len(set(s))
    net = models.UtilityNet(outcomes=2, width=4, persons=3).init()
    out = net.forward(np.ones((2, 3)), np.ones((2, 5, 2, 4)))
    assert out["V"].shape == (2, 5) and np.allclose(out["S"].sum(-1), 1) and np.allclose(out["w"].sum(-1), 1)


def test_legacy_compare(events):
    s = legacy.posterior_stats(events, "title")
    assert {r["pct_diff"] for r in legacy.compare(s, s).collect()} == {0.0}


def test_stream_counts(spark, tmp_path, sf):
    path = str(tmp_path / "in")
    spark.read.parquet(f"{sf}/events.parquet").write.parquet(path)
    schema = spark.read.parquet(path).schema
    stream = windowed_popularity(spark.readStream.schema(schema).parquet(path), "ts", "event_type")
    q = stream.writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = windowed_popularity(spark.read.parquet(path), "ts", "event_type")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))


def test_terms():
    from tallyspark.functions import terms

    t = terms.parse("threshold(popularity, cutoff=2.5)")
    assert t.shown == "threshold(popularity, cutoff=2.5)" and t.complexity == 2 and terms.parse("routine").complexity == 1
    assert terms.log_prior([t, terms.parse("routine")]) == pytest.approx(-3 * np.log(2))
    for bad in ("nope", "interaction(routine)", "interaction(routine, nope)", "threshold(popularity, cutoff=x)", "f(x", "power(routine, novelty)"):
        with pytest.raises(formula.FormulaError):
            terms.parse(bad)


def test_rankers_and_leaks(spark):
    from tallyspark.operators import search

    r = spark.createDataFrame([('x {"A": 1, "b": 3}',), ("nothing",), (None,)], "r string")
    got = [x[0] for x in r.select(search.letter_probabilities(F.col("r"), "ABC")).collect()]
    assert got[0] == [0.25, 0.75, 0.0] and all(abs(sum(g) - 1) < 1e-9 for g in got) and got[1] != got[2]
    ev = spark.createDataFrame([(1, ["p", "q", "r"])], "event_id long, alts array<string>")
    fair = search.rank_by_letters(ev, lambda shown: F.lit('{"A": 1}'), 3).collect()
    assert {round(x["score"], 6) for x in fair} == {round(float(np.log(1 / 3)), 6)}
    rows = spark.createDataFrame([(1, 0, True, 1.0, 1.0), (1, 1, False, 0.0, 1.0), (2, 0, False, 0.0, 0.0), (2, 1, True, 3.0, 0.0)], "event_id long, alt_idx long, chosen boolean, a double, b double")
    assert search.leaking_features(rows, ["a", "b"]) == ["a"]


def test_structure_search_and_leaderboard(spark):
    from tallyspark.functions.terms import Term
    from tallyspark.operators import search

    rows = search.synthetic(spark, 240, [2.0, 0.0], alternatives=4, seed=3).withColumns({"routine": F.col("x0"), "novelty": F.col("x1"), "asin": F.col("alt_idx").cast("string")})
    train, test = rows.filter("event_id < 180"), rows.filter("event_id >= 180")
    best, nll, log = search.descend([Term("novelty")], train, test, ["routine"], steps=3, seed=2)
    assert nll < np.log(4) - 0.2 and any(t.name == "routine" or "routine" in t.args for t in best) and len(log) == 3
    board = {r["model"]: r for r in search.leaderboard({"popularity": models.Popularity, "broken": lambda: 1 / 0, "forest": lambda: models.Classifier(["x0", "x1"])}, train, test).collect()}
    assert board["broken"]["status"] == "errored" and board["popularity"]["uplift"] == 0.0 and board["forest"]["uplift"] > 0.1
    assert search.annealed(0)(1.0, 0, 0) and not search.greedy(0.0, 0, 0) and search.by_posterior(-0.1, 0, 0.5) and search.within_tolerance(-1e-4, 0, 0)


def test_reports_and_simulation(spark, events):
    from tallyspark.operators import search

    sim = search.simulate(events, 1.0, steps=4)
    last = {r["customer_id"]: r["m"] for r in events.groupBy("customer_id").agg(F.max("us").alias("m")).collect()}
    got = sim.collect()
    assert len(got) == 12 * 4 and all(r["us"] > last[r["customer_id"]] for r in got)
    a = spark.createDataFrame([(1, 0, 0, m, float(m)) for m in range(3)], "event_id long, alt_idx long, k long, m long, a double")
    w = spark.createDataFrame([(1, m, 2.0) for m in range(3)], "event_id long, m long, w double")
    assert [p["m"] for p in search.decision(a, w, 1).first()["parts"]] == [2, 1, 0]
    net = models.UtilityNet(outcomes=1, width=2, persons=2).init()
    ev = spark.createDataFrame([(1, [0.5, 1.0], [1.0, 0.0, 0.0, 1.0])], "event_id long, z array<double>, e array<double>")
    same = search.counterfactual(ev, net.score, lambda z: z).collect()
    assert len(same) == 2 and all(r["delta"] == 0 for r in same)
    with pytest.raises(Exception, match="without a score"):
        search.external_scores(spark.createDataFrame([(1, 0)], "event_id long, alt_idx long"), spark.createDataFrame([], "event_id long, alt_idx long, logit double")).collect()


def test_registered_models_are_fitted_in_full(spark, sf, monkeypatch):
    from tallyspark.operators import nets, symbolic
    from tallyspark.plans import registry

    class Seen(Exception):
        pass

    def fit(self, *_):
        raise Seen(self)

    fields = {models.SparseLogit: ("penalties", "rounds"), models.PriorLogit: ("rounds",), nets.TextNet: ("width", "epochs"), symbolic.EquationSearch: ("proposals",), models.UtilityNet: ()}
    for c in fields:
        monkeypatch.setattr(c, "fit", fit)
    for name in ("m2_sparse_logit", "m4_relevance_logit", "m15_hierarchical_logit", "m7_text_net", "m9_m10_equation_search", "e8_counterfactual"):
        with pytest.raises(Seen) as got:
            registry.queries()[name](spark, sf)
        model = got.value.args[0]
        assert all(getattr(model, f) == type(model).__dataclass_fields__[f].default for f in fields[type(model)])


def test_simulation_draws_from_the_whole_category_and_catalogue(spark):
    from tallyspark.operators import search

    rows = [(f"c{c}", c * 40 + i, f"{i:04}", f"a{i % 60:02}" if c % 2 else f"b{i % 60:02}", "A" if c % 2 else "B", 1.0 * (i % 60)) for c in range(40) for i in range(60)]
    events = spark.createDataFrame(rows, "customer_id string, us long, seq string, asin string, category string, price double")
    got = search.simulate(events, 0.0).collect()
    assert len(got) == 400 and all(r["price"] == float(r["asin"][1:]) for r in got)
    assert len({r["asin"] for r in got}) > 100  # of 120; ten fixed ones a category would give 20
    own = sum(r["asin"][0].upper() == r["category"] for r in got) / 400
    assert 0.6 < own < 0.85  # five of the category, and half of the other five
    at = spark.range(2000).select(search.places(F.lit(7), 5, F.col("id")).alias("p")).collect()
    assert all(len(set(r["p"])) == 5 and set(r["p"]) <= set(range(7)) for r in at)
    assert all(1300 < sum(x in r["p"] for r in at) < 1560 for x in range(7))
    assert spark.range(1).select(search.places(F.lit(3), 5, F.col("id")).alias("p")).first()["p"].__len__() == 3
    keep = search.simulate(events.filter("customer_id = 'c1'"), 50.0).collect()
    assert len(keep) == 10


def test_utility_net_learns_and_its_gradient_is_right():
    rng = np.random.default_rng(0)
    for salience, weighting, utility in (("net", "softmax", "attributes"), ("uniform", "softplus", "attributes"), ("net", "softmax", "concat"), ("net", "softmax", "film"), ("uniform", "softmax", "film")):
        net = models.UtilityNet(attributes=2, outcomes=2, width=3, persons=2, hidden=4, salience=salience, weighting=weighting, utility=utility).init()
        z, e, own, w = rng.normal(size=(5, 2)), rng.normal(size=(5, 3, 2, 3)), rng.integers(0, 3, 5), rng.random(5) + 0.5
        _, g = net.gradient(z, e, own, w, 0.1)
        for k, v in net.p.items():
            i = tuple(rng.integers(0, n) for n in v.shape)
            v[i] += 1e-5
            up = net.gradient(z, e, own, w, 0.1)[0]
            v[i] -= 2e-5
            down = net.gradient(z, e, own, w, 0.1)[0]
            v[i] += 1e-5
            assert (up - down) / 2e-5 == pytest.approx(g[k][i], abs=1e-6)
    n = 400
    z, e = rng.normal(size=(n, 2)), rng.normal(size=(n, 3, 2, 3))
    own = (e[..., 0].mean(-1) * 3).argmax(1)
    data = lambda s: (z[s], e[s], own[s], np.ones(len(own[s])))
    net = models.UtilityNet(attributes=2, outcomes=2, width=3, persons=2, hidden=8)
    curve = net.fit(data(slice(0, 300)), data(slice(300, n)), epochs=25, rate=0.02)
    assert min(curve) < np.log(3) * 0.7 and net.gradient(*data(slice(300, n)))[0] == pytest.approx(min(curve))


def test_prior_logit(spark):
    from tallyspark.operators import search

    rows = search.synthetic(spark, 500, [1.5, 0.0, 0.0], alternatives=4, seed=9).withColumn("g", (F.col("event_id") % 2).cast("string"))
    ard = models.PriorLogit(["x0", "x1", "x2"], relevance=True, rounds=12).fit(rows)
    assert "x0" in ard.relevant and abs(ard.weights[0] - 1.5) < 0.4 and ard.precisions[0] < min(ard.precisions[1:])
    wide, names = models.hierarchical(rows, ["x0"], "g", ["0", "1"])
    h = models.PriorLogit(names, {n: 50.0 for n in names[1:]} | {"x0": 0.01}).fit(wide)
    assert abs(h.weights[0] - 1.5) < 0.5 and np.abs(h.weights[1:]).max() < 0.5


def test_equation_search(spark):
    from tallyspark.operators import search, symbolic

    a, b = "def utility(x, c):\n    return c[0] * x[1] + log1p(x[0]) * 2.0", "def utility(x, c):\n    return 3 * log1p(x[0]) + x[1] * c[4]"
    assert formula.concepts(a) & formula.concepts(b) >= {"log1p(x[0])"} or formula.concepts(a, 2, 4) & formula.concepts(b, 2, 4)
    rows = search.synthetic(spark, 300, [2.0, 0.0], alternatives=4, seed=4)
    found = symbolic.EquationSearch(["x0", "x1"], proposals=12, library=20, promote_at=1).fit(rows.filter("event_id < 200"))
    test = rows.filter("event_id >= 200")
    nll = metrics.per_event(found.score(test)).agg(F.avg("nll")).first()[0]
    assert found.likelihood < np.log(4) - 0.2 and nll < np.log(4) - 0.15 and found.concepts.parts
    data = symbolic.sample(test, ["x0", "x1"])
    arrays = formula.utility(found.text, [*data[0], np.zeros(len(data[1])), np.zeros(len(data[1]))], list(found.coefficients), formula.NUMPY_FUNCTIONS, float)[0]
    assert symbolic.likelihood(arrays, data[1], data[2]) == pytest.approx(nll)


def test_monotone_net(spark):
    from tallyspark.operators import nets, search

    rows = search.synthetic(spark, 400, [1.5, 1.0], alternatives=4, seed=11)
    train, test = rows.filter("event_id < 300"), rows.filter("event_id >= 300")
    nll = lambda m: metrics.per_event(m.score(test)).agg(F.avg("nll")).first()[0]
    free = nets.NetLogit(["x0", "x1"]).fit(train)
    held = nets.NetLogit(["x0", "x1"], monotone={"x1": -1}, penalty=100.0).fit(train)
    assert nll(free) < np.log(4) - 0.3 and nll(held) > nll(free)
    rng = np.random.default_rng(0)
    x, event, own = rng.normal(size=(12, 2)), np.repeat(np.arange(4), 3), np.array([0, 4, 8, 9])
    _, g = held.loss(x, event, own)
    for k, v in held.p.items():
        i = tuple(rng.integers(0, n) for n in v.shape)
        v[i] += 1e-6
        up = held.loss(x, event, own)[0]
        v[i] -= 2e-6
        down = held.loss(x, event, own)[0]
        v[i] += 1e-6
        assert (up - down) / 2e-6 == pytest.approx(g[k][i], rel=1e-3, abs=1e-5)


def test_text_net(spark):
    from tallyspark.operators import nets

    rows = [(e, j, "lovely soft toy" if j == e % 3 else f"plain thing {j}", j == e % 3) for e in range(90) for j in range(3)]
    df = spark.createDataFrame(rows, "event_id long, alt_idx long, text string, chosen boolean")
    got = metrics.per_event(nets.TextNet(width=16).fit(df).score(df)).agg(F.avg(F.col("top1").cast("int"))).first()[0]
    assert got == 1.0
    assert spark.range(1).select(nets.rendered(F.lit("t"), F.lit("c"), F.lit(1.0), F.lit(2), F.lit(True))).first()[0].endswith("Bought before")


def test_ablations_and_sweeps(spark):
    rng = np.random.default_rng(1)
    n = 400
    z, e = rng.normal(size=(n, 2)), rng.normal(size=(n, 3, 2, 3))
    own = (e[..., 0].mean(-1) * z[:, :1] * 4).argmax(1)  # what is liked depends on the person
    data = lambda s: (z[s], e[s], own[s], np.ones(len(own[s])))
    base = models.UtilityNet(attributes=2, outcomes=2, width=3, persons=2, hidden=8)
    rows = models.sweep(data(slice(0, 300)), data(slice(300, n)), {"utility": ["attributes", "concat", "film"], "outcomes": [1, 2]}, base, epochs=15, rate=0.03)
    assert len(rows) == 6 and [r["nll"] for r in rows] == sorted(r["nll"] for r in rows)
    best = {u: min(r["nll"] for r in rows if r["utility"] == u) for u in ("attributes", "concat", "film")}
    assert all(v < np.log(3) - 0.05 for v in best.values())
    net = models.UtilityNet(outcomes=2, width=3, persons=2, utility="film").init()
    table = spark.createDataFrame([(i, z[i].tolist(), e[i, : 2 + i % 2].ravel().tolist()) for i in range(40)], "event_id long, z array<double>, e array<double>")
    got = {(r["event_id"], r["alt_idx"]): r["score"] for r in net.score(table).collect()}
    assert len(got) == sum(2 + i % 2 for i in range(40))
    assert all(got[i, j] == pytest.approx(net.forward(z[i : i + 1], e[i : i + 1])["V"][0, j]) for i, j in got)


def test_subsample_guard(spark, events):
    h = history.state_features(events)
    assert models.guarded_subsample(h, None) is None and models.guarded_subsample(h, 4, method="random").count() == 4
    with pytest.raises(ValueError, match="unknown method"):
        models.guarded_subsample(h, 4, method="best")
    with pytest.warns(UserWarning, match="no leverage subsample"):
        assert models.guarded_subsample(events, 4) is None


def test_structure_searches_find_planted_forms(spark):
    from tallyspark.operators import search, structures

    rows = search.synthetic(spark, 400, [1.5, 0.0, 0.0], alternatives=4, seed=21).withColumn("x1", F.exp("x1"))
    fits = structures.Fits(rows, ["x0", "x1", "x2"])
    plain = fits((1, 0, 0))
    assert plain.nll < np.log(4) - 0.2 and fits((0, 0, 0)).nll == pytest.approx(np.log(4)) and len(fits.known) == 2
    assert plain.weights[0] == pytest.approx(1.5, abs=0.35) and fits((1, 1, 0)).aic(fits.n) > plain.aic(fits.n) - 2
    every = min(((a, b, c) for a in range(4) for b in range(4) for c in range(4)), key=lambda s: fits(s).bic(fits.n))
    best, archive = structures.NeighbourhoodSearch(evaluations=40).search(fits)
    assert best == every and archive[0][2] == 0 and [a[1] for a in archive] == sorted((a[1] for a in archive), reverse=True)
    barred, _ = structures.NeighbourhoodSearch(evaluations=40, signs={"x0": -1}).search(fits)
    assert barred[0] == 0
    found, fit = structures.QSearch(episodes=40).search(fits)
    assert found[0] and fit.aic(fits.n) <= plain.aic(fits.n) + 2
    model = structures.Structured(["x0", "x1", "x2"], structures.NeighbourhoodSearch(evaluations=20)).fit(rows.filter("event_id < 300"))
    nll = metrics.per_event(model.score(rows.filter("event_id >= 300"))).agg(F.avg("nll")).first()[0]
    assert nll < np.log(4) - 0.15 and "x0" in " ".join(model.names)


def test_proposals_of_a_language_model(spark):
    from tallyspark.functions.terms import Term
    from tallyspark.operators import search

    said = "- routine\n`log_transform(popularity)`\nnonsense here\n* routine\npower(novelty, exponent=x)"
    assert search.proposals(said) == [Term("routine"), Term("log_transform", ("popularity",))]
    rng = np.random.default_rng(0)
    assert search.propose_by(lambda p: said, ["routine", "popularity"])([Term("novelty")], ["routine"], rng) == search.proposals(said)
    assert search.propose_by(lambda p: "no idea", ["routine"])([Term("novelty")], ["routine"], rng)


def test_poisson_multiplicities():
    m = posthoc.multiplicities(np.arange(4000), 200, 5)
    assert m.shape == (200, 4000) and abs(m.mean() - 1) < 0.01 and abs(m.var() - 1) < 0.02
    assert (m == posthoc.multiplicities(np.arange(4000), 200, 5)).all() and (m != posthoc.multiplicities(np.arange(4000), 200, 6)).any()
    assert abs(np.corrcoef(m[0], m[1])[0, 1]) < 0.06 and abs(np.corrcoef(m[:, 0], m[:, 1])[0, 1]) < 0.25


def test_as_of_examples(spark):
    line = spark.createDataFrame([("a", i // 2, f"{i}", f"x{i}") for i in range(7)] + [("b", 1, "0", "y")], "customer_id string, us long, seq string, asin string")
    probes = spark.createDataFrame([("a", 3, 1), ("a", 0, 2), ("a", 99, 3), ("c", 5, 4), ("b", 1, 5), ("b", 2, 6)], "customer_id string, probe_us long, probe_id long")
    got = {r["probe_id"]: [x["asin"] for x in r["examples"]] for r in history.latest_before(line, probes, 3).collect()}
    assert got == {1: ["x5", "x4", "x3"], 2: [], 3: ["x6", "x5", "x4"], 4: [], 5: [], 6: ["y"]}


def test_reports_of_significance_and_segments(spark, tmp_path):
    rng = np.random.default_rng(0)
    rows = [(m, "1", i, f"c{i % 7}", f"k{i % 3}", i % 2 == 0, float(rng.normal(gap)), bool(rng.random() < rate), "ok") for m, gap, rate in (("own", 0.0, 0.8), ("same", 0.0, 0.8), ("worse", 1.0, 0.3)) for i in range(300)]
    r = spark.createDataFrame(rows, "model string, seed string, event_idx long, customer_id string, category string, is_repeat boolean, nll double, top1 boolean, status string")
    report = posthoc.significance(r, "own", 200)
    assert list(report["pairs"]) == ["worse", "same"] and report["n_events"] == 300 and report["n_seeds"] == 1
    assert report["pairs"]["worse"]["wilcoxon_p_value"] < 1e-6 < report["pairs"]["same"]["wilcoxon_p_value"] and report["pairs"]["same"]["aso_epsilon_min"] is None
    text_ = posthoc.significance_text(report)
    assert "| worse | +" in text_ and "<1e-6" in text_ and text_.index("| worse") < text_.index("| same")
    posthoc.save_significance(report, str(tmp_path))
    assert json.loads((tmp_path / "pairwise_vs_own.json").read_text())["pairs"]["same"]
    seg = posthoc.segmentation(r, "own", least=8)
    assert set(seg["schemes"]) == set(posthoc.SCHEMES) and all(g["small"] for g in seg["schemes"]["novelty"]["segments"].values())
    first = next(iter(seg["schemes"]["novelty"]["segments"].values()))["models"]
    assert first[-1]["model"] == "worse" and "(small)" in posthoc.segmentation_text(seg, "novelty")
    posthoc.save_segmentation(seg, str(tmp_path / "seg"))
    assert (tmp_path / "seg/by_novelty.md").exists() and json.loads((tmp_path / "seg/summary.json").read_text()).keys() == set(posthoc.SCHEMES)


def test_adapters_stages_and_checked_cleaning(spark, tmp_path):
    reads = []
    schema = store.Schema("name: shop\nevents: {column_map: {A: customer_id, B: customer_id, P: price}, dropna_subset: [customer_id], dtype_coerce: {price: float}}\npersons: {id_column: R}")
    a = store.Adapter(schema, lambda: reads.append(1) or spark.range(2), lambda: spark.range(3))
    assert a.load_events().count() == 2 == a.load_events().count() and reads == [1] and a.load_persons().count() == 3
    stages = store.Stages(spark, str(tmp_path / "s"))
    stages.save("one", spark.range(1))
    with pytest.raises(FileNotFoundError, match="two, three: run these"):
        stages.require("one", "two", "three")
    assert [d.count() for d in stages.require("one")] == [1]
    validate.loaded(["B", "P"], ["R"], schema)
    with pytest.raises(validate.Violation, match="customer_id"):
        validate.loaded(["P"], ["R"], schema)
    with pytest.raises(validate.Violation, match="present"):
        validate.loaded(["A", "P"], ["x"], schema)
    raw = spark.createDataFrame([("a", "1"), (None, "2"), ("c", "3")], "A string, P string")
    with pytest.warns(UserWarning, match="drops 33.3%"):
        assert [r["customer_id"] for r in store.clean_checked(raw, schema, ["price"]).collect()] == ["a", "c"]
    with pytest.raises(validate.Violation):
        store.clean_checked(raw.filter("A = 'a'").withColumn("P", F.lit("-1")), schema)


def test_declarations_are_checked():
    good = "name: x\nevents: {column_map: {A: customer_id}}\npersons: {id_column: R, fields: {s: {kind: passthrough, source: S}}}\ntraining: {val_frac: 0.1, test_frac: 0.2}"
    assert store.problems(good) == []
    bad = "events: {dropna_subset: [z], dtype_coerce: {y: float}}\npersons: {fields: {a: {kind: odd}, b: {kind: constant}, c: {kind: composite}, d: {kind: ordinal_map}, e: {kind: passthrough}}}\ntraining: {val_frac: 0.6, test_frac: 0.6, choice_set_size: 1}"
    assert len(store.problems(bad)) == 11
    assert "SchemaError" in store.problems("events: {dtype_coerce: {a: date}}")[0] and store.problems("a: [")


def test_exact_quantiles(spark):
    from tallyspark.functions.quantiles import order_statistics, quantiles

    rng = np.random.default_rng(3)
    values = np.concatenate((rng.normal(size=5000), [1e12, -1e12], np.full(500, 0.25)))
    df = spark.createDataFrame([(float(x),) for x in values] + [(None,)], "x double")
    shares = [0.0, 0.1, 1 / 3, 0.5, 0.999, 1.0]
    assert np.allclose(quantiles(df, "x", shares), np.quantile(values, shares), rtol=0, atol=1e-12)
    assert quantiles(df.filter("x is null"), "x", [0.5]) == [None] and quantiles(df.filter("x = 0.25"), "x", [0.5]) == [0.25]
    assert order_statistics(df, "x", [7], bins=4) == {7: sorted(values)[7]}


def test_few_shot_prompts_show_only_the_past(spark):
    from tallyspark.functions import prompts
    from tallyspark.operators import search

    past = spark.createDataFrame([("a", i, f"{i}", f"item{i}", "toys", 1.0 * i) for i in range(6)], "customer_id string, us long, seq string, title string, category string, price double")
    ev = spark.createDataFrame([(1, "a", 4, "Someone", [("p", 1.0), ("q", None)]), (2, "b", 4, "Other", [("p", 1.0), ("q", 2.0)])], "event_id long, customer_id string, us long, c_d string, alts array<struct<title string, price double>>")
    # The stand-in prefers A where the prompt shows item3 and not item4.
    ask = lambda p: F.when(p.contains("item3") & ~p.contains("item4"), F.lit('{"A": 9, "B": 1}')).otherwise(F.lit('{"A": 1, "B": 1}'))
    got = {(r["event_id"], r["alt_idx"]): r["score"] for r in search.few_shot(ev, past, ask, shots=2).collect()}
    assert got[1, 0] == pytest.approx(np.log(0.5)) == got[1, 1] and len(got) == 4
    line = "x" * 40
    for budget, n in ((9, 0), (10, 1), (25, 2), (1000, 3)):
        assert len(spark.range(1).select(prompts.within_budget(F.array(*[F.lit(line)] * 3), budget).alias("x")).first()["x"]) == n
    with pytest.raises(ValueError, match="needs"):
        prompts.user(F.lit(""), F.lit(""), 2, ["title"])
    with pytest.raises(ValueError, match="itself"):
        prompts.user(F.lit(""), F.struct(*(F.lit("1").alias(f) for f in prompts.FIELDS)), 2, list(prompts.FIELDS), {"price": F.lit("1")})
    with pytest.raises(ValueError):
        prompts.system(0)


def test_generation_asks_again_until_lines_are_apart(spark):
    from tallyspark.operators import generation

    alt = F.struct(F.lit("t").alias("title"), F.lit("c").alias("category"), F.lit(1.0).alias("price"), F.lit("r").alias("popularity_rank"))
    requests = spark.range(3).select(F.lit("me").alias("customer_id"), F.col("id").cast("string").alias("asin"), F.lit("ctx").alias("c_d"), alt.alias("alt"))
    empty = spark.createDataFrame([], "key string, value string, created_at double")
    ask = lambda p, seed: F.when(seed == 5, F.lit("same\nsame")).when(seed == 6, F.lit("short")).otherwise(F.lit("this one\nand that"))
    accept = generation.apart(lambda t: F.transform(F.array(*map(F.lit, "sta")), lambda c: F.length(t) - F.length(F.replace(t, c))), 0.99)
    apart = lambda lines: F.element_at(lines, 1) != F.element_at(lines, 2)
    answers, fresh = generation.generate(requests.unionByName(requests), empty, ask, "M", k=2, seed=5, accept=apart)
    got = answers.collect()
    assert len(got) == 6 and all(r["outcomes"] == ["this one", "and that"] and r["metadata"]["seed"] == 7 and not r["metadata"]["was_padded"] for r in got)
    assert fresh.count() == 3 and not spark.range(1).select(accept(F.array(F.lit("sss"), F.lit("sss")))).first()[0]
    again, none = generation.generate(requests, fresh, lambda p, s: F.raise_error(F.lit("asked")).cast("string"), "M", k=2, seed=5)
    assert again.count() == 3 and none.count() == 0
    padded, _ = generation.generate(requests, empty, lambda p, s: F.lit("just one"), "M", k=2, retries=1)
    assert {(tuple(r["outcomes"]), r["metadata"]["was_padded"], r["metadata"]["seed"]) for r in padded.collect()} == {(("just one", text.PAD), True, 1)}


def test_records_need_a_person(spark, events):
    s = history.recent_titles(history.state_features(split.temporal_split(events)))
    sets = choice.choice_sets(s, negatives=4)
    people = events.select("customer_id").distinct().withColumns({"z": F.array(F.lit(1.0)), "name": F.concat(F.lit("I am "), "customer_id")})
    context = F.concat_ws("\n", "name", F.array_join("recent", ", "))
    got = choice.choice_records(sets, s, people, context).collect()
    assert len(got) == 12 * 14
    for r in got:
        own = r["alt_texts"][r["chosen_idx"]]
        assert len(r["alt_texts"]) == 5 and own["is_repeat"] == r["metadata"]["is_repeat"] == (r["chosen_features"]["routine"] > 0) and own["state"] == "XX"
        assert all(not a["is_repeat"] and a["state"] == "" and a["brand"].startswith("brand") for i, a in enumerate(r["alt_texts"]) if i != r["chosen_idx"])
        assert r["c_d"].startswith(f"I am {r['customer_id']}") and r["z_d"] == [1.0]
    with pytest.raises(Exception, match="no person row"):
        choice.choice_records(sets, s, people.filter("customer_id <> 'c1'"), context).collect()
    loose = choice.choice_sets(s, negatives=4, distinct=False)
    assert loose.count() == 12 * 14 and any(len(set(r["choice_asins"])) < 5 and not r["dedup_fallback"] for r in loose.collect())


def test_events_of_known_persons_and_weights(spark, events):
    some = spark.createDataFrame([("c1", 3.0), ("c2", 2.0), ("zz", 1.0)], "customer_id string, weight double")
    assert choice.with_persons(events, some).count() == 28
    assert {r["omega"] for r in choice.with_weights(events, some).filter("customer_id in ('c1', 'c3')").collect()} == {3.0, 1.0}
    s = split.temporal_split(events.unionByName(spark.createDataFrame([event("one", 0, "x")], EVENTS)))
    assert {r[0] for r in choice.selected_or_untrained(s, some).select("customer_id").distinct().collect()} == {"c1", "c2", "one"}
    side = choice.sidecar(s)
    assert side.filter("event_idx = 0").count() == 13 and side.filter("split <> 'test'").count() == 0


def test_context_length_and_leaks(spark):
    one = spark.range(1)
    assert one.select(persons.of_fair_length(F.lit("a\nb"))).first()[0] == "a\nb"
    with pytest.raises(Exception, match="2 to 12 lines"):
        one.select(persons.of_fair_length(F.lit("a"))).collect()
    assert one.select(persons.leaks(F.lit("her education"))).first()[0] and not one.select(persons.leaks(F.lit("college-educated"))).first()[0]


def test_run_writes_its_artefacts(spark, events, tmp_path):
    from tallyspark.operators import runs

    people = events.select("customer_id").distinct().withColumns({"z": F.array(F.lit(1.0)), "name": F.concat(F.lit("I am "), "customer_id")})
    chosen = {k: v for k, v in runs.registry(runs.FEATURES, "title", lambda shown: F.lit('{"A": 1}')).items() if k in ("popularity", "relevance_logit", "ranker", "sparse_logit")}
    board = runs.run(events, people, F.col("name"), str(tmp_path / "run"), chosen, negatives=4)
    got = {r["model"]: r for r in board.collect()}
    assert {r["status"] for r in got.values()} == {"ok"}, {k: r["note"] for k, r in got.items()}
    summary = json.loads((tmp_path / "run/summary.json").read_text())
    assert summary["n_test"] == 12 and {m["model"] for m in summary["models"]} == set(chosen)
    assert spark.read.json(str(tmp_path / "run/events_seed42.json")).count() == 12
    assert spark.read.option("header", True).csv(str(tmp_path / "run/leaderboard_seed42.csv")).count() == 4


def test_run_writes_reports_of_its_net(spark, events, tmp_path):
    from tallyspark.operators import models, runs, training
    from tallyspark.sources.artefacts import Artefacts

    people = events.select("customer_id").distinct().withColumns({"z": F.array(F.lit(1.0), F.lit(-0.5)), "name": F.concat(F.lit("I am "), "customer_id")})
    trainer = training.Trainer(models.UtilityNet(outcomes=2, width=8, persons=2, hidden=4, attributes=3), epochs=2, slices=2)
    runs.run(events, people, F.col("name"), f"file://{tmp_path}/run", {"popularity": models.Popularity}, negatives=4, trainer=trainer)
    at = Artefacts(spark, f"file://{tmp_path}/run")
    reports = {"head_naming.json", "per_decision.json", "dominant_attribute.json", "counterfactual.json"}
    assert reports | {"metrics.json", "metrics_test.json", "summary.json", "events_seed42.json", "leaderboard_seed42.csv"} <= set(at.names())
    summary = json.loads(at.read("summary.json"))
    assert [e["events"] for e in summary["training"]["epochs"]] == [summary["n_train"]] * 2 and reports <= set(summary["written"])
    assert json.loads(at.read("metrics_test.json"))["n"] == summary["n_test"]
    read = {n: spark.read.json(f"{tmp_path}/run/{n}") for n in reports}
    assert read["head_naming.json"].count() == 3 * 10 and read["head_naming.json"].filter("text like 'outcome %'").count() == 30
    assert read["per_decision.json"].count() == 5 * 2 and all(len(r["parts"]) == 3 for r in read["per_decision.json"].collect())
    assert read["dominant_attribute.json"].agg(F.sum("n")).first()[0] * 5 == read["counterfactual.json"].count()
    assert read["counterfactual.json"].filter("abs(delta - (after - before)) > 1e-9").count() == 0
    at.text("summary.json", "again")
    assert at.read("summary.json") == "again" and not any(n.startswith("_") for n in at.names())


def test_parts_of_a_net_make_its_scores(spark):
    from tallyspark.operators import models

    rng = np.random.default_rng(0)
    net = models.UtilityNet(outcomes=2, width=4, persons=2, hidden=3, attributes=3).init()
    rows = [(i, rng.normal(size=2).tolist(), rng.normal(size=(3, 2, 4)).ravel().tolist(), i % 3) for i in range(7)]
    events = spark.createDataFrame(rows, "event_id long, z array<double>, e array<double>, own int")
    parts = net.parts(events)
    got = parts.groupBy("event_id", "alt_idx").agg(F.sum(F.col("a") * F.col("w") * F.col("s")).alias("u"), F.max("chosen").alias("chosen")).join(net.score(events), ["event_id", "alt_idx"]).collect()
    assert len(got) == 21 and all(abs(r["u"] - r["score"]) < 1e-9 and r["chosen"] == (r["alt_idx"] == r["event_id"] % 3) for r in got)
    with pytest.raises(ValueError):
        models.UtilityNet(utility="film").init().parts(events)


def test_personal_logit(spark):
    from tallyspark.operators import search

    rows = search.synthetic(spark, 600, [1.0], alternatives=4, seed=31).withColumn("customer_id", F.when(F.col("event_id") < 300, "likes").otherwise("hates"))
    # The second customer picks what the first would like least.
    w = F.row_number().over(Window.partitionBy("event_id").orderBy("x0"))
    rows = rows.withColumn("chosen", F.when(F.col("customer_id") == "hates", w == 1).otherwise(F.col("chosen")))
    m = models.PersonalLogit(["x0"], precision=0.5).fit(rows)
    own = {r["customer_id"]: r["w"][0] for r in m.own.collect()}
    assert own["likes"] > 0.5 and own["hates"] < -1 and own["hates"] < m.base.weights[0] < own["likes"]
    other = m.score(rows.limit(4).withColumn("customer_id", F.lit("new"))).collect()
    assert all(r["score"] == pytest.approx(r["x0"] * m.base.weights[0]) for r in other)
    d = m.base.draws(4000)
    assert d.mean() == pytest.approx(m.base.weights[0], abs=0.02) and d.var() == pytest.approx(m.base.covariance[0, 0], rel=0.1)


def test_reports_of_a_model(spark):
    from tallyspark.operators import runs, search

    rows = search.synthetic(spark, 200, [2.0], alternatives=4, seed=5).withColumns({"customer_id": (F.col("event_id") % 9).cast("string"), "category": (F.col("event_id") % 2).cast("string"), "is_repeat": F.col("event_id") % 3 == 0})
    fitted = models.PriorLogit(["x0"]).fit(rows)
    got = runs.report(fitted, rows, rows, 1.5)
    assert got["n"] == got["n_train"] == 200 and got["nll"] < np.log(4) and len(got["by_category"]) == 2 and got["customers_mostly_right"] > 0.5 and got["fit_seconds"] == 1.5
    with pytest.raises(ValueError, match="alternatives"):
        runs.report(fitted, rows, rows.filter("event_id > 3 or alt_idx < 1 or chosen"))
    with pytest.raises(ValueError, match="top"):
        runs.report(fitted, rows, rows, top=0)
    a = spark.createDataFrame([(e, k, m, float(e + k - m)) for e in range(3) for k in range(2) for m in range(2)], "event_id long, k long, m long, a double")
    texts = spark.createDataFrame([(e, k, f"{e}/{k}") for e in range(3) for k in range(2)], "event_id long, k long, text string")
    assert {(r["head"], r["rn"], r["text"]) for r in runs.named_heads(a, texts, {0: "money"}, 1).collect()} == {("money", 1, "2/1"), ("head 1", 1, "2/1")}


@pytest.mark.parametrize("key", [None, "k"])
@pytest.mark.parametrize("how", ["sum", "max"])
def test_running_sums_along_ranges(spark, key, how):
    """Against a window, with null keys and values, one day for all rows, and ranges of about as many rows."""
    from pyspark.sql import Window
    from tallyspark.operators.prefix import running
    from tallyspark.sources.shared import Scratch

    rows = [("a" if i % 3 == 0 else None if i % 7 == 0 else f"k{i % 50}", 5, i * 37 % 4001, None if i % 11 == 0 else i % 13) for i in range(4000)]
    table = spark.createDataFrame(rows, "k string, us long, id long, v long").repartition(5)
    w = Window.partitionBy(*([key] if key else [])).orderBy("us", "id").rowsBetween(Window.unboundedPreceding, -1)
    want = table.withColumn("before", F.coalesce(F.sum("v").over(w), F.lit(0)) if how == "sum" else F.max("v").over(w).cast("double"))
    got = running(table, ["us", "id"], "v", key, how)
    assert sorted(map(tuple, got.collect()), key=lambda r: r[2]) == sorted(map(tuple, want.collect()), key=lambda r: r[2])
    where = Scratch(spark)
    running(table, ["us", "id"], "v", key, how, scratch=where)
    parts = spark.read.parquet(where.paths[0]).groupBy("_part").count().collect()
    assert len(parts) >= 3 and max(r["count"] for r in parts) <= 2 * len(rows) / len(parts)


def test_recent_titles_equal_brute_force(spark):
    import random

    rng = random.Random(4)
    day = 86_400_000_000
    rows = [(f"c{rng.randrange(4)}", rng.randrange(60) * day // 2, f"{i:04d}", None if i % 17 == 0 else f"t{i}") for i in range(500)]
    got = history.recent_titles(spark.createDataFrame(rows, "customer_id string, us long, seq string, title string"))
    assert got.columns == ["customer_id", "us", "seq", "title", "recent"]
    for r in got.collect():
        past = sorted((u, s, t) for c, u, s, t in rows if c == r["customer_id"] and r["us"] - 30 * day <= u < r["us"])
        assert r["recent"] == [t for *_, t in past[-5:]]
    assert got.count() == len(rows)
