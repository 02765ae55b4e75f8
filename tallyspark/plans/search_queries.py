"""Terms, rankers, simulation and reports, with their SQL where there is any."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import terms
from ..operators import catalog, choice, history, legacy, models, nets, persons, posthoc, runs, search, split, structures, symbolic
from ..sources.binding import PURCHASES, purchases, table
from ..sources.shared import stored
from .eval_queries import _EVENTS, _LONG, _PAIR, _RESULTS, alternatives, planted, results, scored
from .history_queries import SPLIT_SQL
from .model_queries import CUT_US
from .registry import query

_TERMS = ["interaction(routine, affinity)", "split_by(popularity, novelty)", "threshold(popularity, cutoff=2)", "log_transform(price_sensitivity)", "ratio(routine, popularity)", "power(price_sensitivity, exponent=2)", "difference(affinity, popularity)", "recency"]


@query(
    "l3_n2_feature_terms",
    """WITH b AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_linenumber::DOUBLE AS routine, ln(1 + l_suppkey) AS affinity, ln(1 + l_quantity) AS popularity, (l_linenumber % 2)::DOUBLE AS novelty,
  -(l_quantity / (20.0::DOUBLE + 1e-8) - 1) AS ps, 1 / (1 + l_quantity) AS recency FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, round(routine * affinity, 6) AS t0, round(popularity * novelty, 6) AS t1, (popularity > 2)::INT::DOUBLE AS t2, round(ln(1 + abs(ps)) * sign(ps), 6) + 0.0::DOUBLE AS t3, round(routine / (popularity + 1e-8), 6) AS t4,
  round(ps * ps * sign(ps), 6) + 0.0::DOUBLE AS t5, round(affinity - popularity, 6) AS t6, round(recency, 8) AS t7 FROM b""",
)
def l3_feature_terms(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns(
        {"routine": F.col("l_linenumber"), "cat_affinity": F.col("l_suppkey"), "popularity": F.col("l_quantity"), "novelty": F.col("l_linenumber") % 2, "price": F.col("l_quantity"), "category_price": F.lit(20.0), "recency_days": F.col("l_quantity")}
    )
    made = [terms.compiled(terms.parse(t)) for t in _TERMS]
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", *((F.round(c, 8 if i == 7 else 6) + 0.0).alias(f"t{i}") for i, c in enumerate(made)))


@query(
    "n4_j14_legacy_rows",
    f"""WITH {_LONG}, h AS (SELECT seq AS hseq, row_number() OVER (PARTITION BY customer_id, asin ORDER BY us, seq) - 1 AS routine FROM e), p AS (SELECT asin, count(*) AS popularity FROM e GROUP BY 1), c AS (SELECT category, avg(price) AS cp FROM e GROUP BY 1)
SELECT event_id, alt_idx, CASE WHEN chosen THEN routine ELSE 0 END::DOUBLE AS routine, CASE WHEN chosen AND routine > 0 THEN 0 ELSE 1 END::DOUBLE AS novelty, round(ln(1 + popularity), 7) AS popularity, round(CASE WHEN chosen THEN 1 - price / (cp + 1e-8) ELSE 0 END, 6) + 0.0::DOUBLE AS price_rank, 0.0::DOUBLE AS time_match, 0.0::DOUBLE AS co_purchase
FROM l JOIN h ON hseq = seq JOIN p USING (asin) JOIN c USING (category)""",
)
def n4_legacy_rows(spark, sf_dir):
    e = purchases(spark, sf_dir)
    h = history.state_features(e).select("seq", "routine", "novelty", "recency_days", "cat_affinity")
    price = e.groupBy("category").agg(F.avg("price").alias("category_price"))
    got = search.legacy_rows(alternatives(spark, sf_dir).join(h, "seq"), catalog.popularity(e), price)
    return got.select("event_id", "alt_idx", "routine", "novelty", F.round("popularity", 7).alias("popularity"), (F.round("price_rank", 6) + 0.0).alias("price_rank"), "time_match", "co_purchase")


@query("f20_letter_probabilities", "SELECT p_partkey, i::BIGINT AS i, round(CASE i WHEN 0 THEN 0.25 * p_size WHEN 1 THEN 2 ELSE 0 END / (0.25 * p_size + 2), 8) AS p FROM part, range(0, 3) AS r(i)")
def f20_letter_probabilities(spark, sf_dir):
    response = F.concat(F.lit('Sure: {"A": '), (F.col("p_size") * 0.25).cast("string"), F.lit(', "b": 2, "Z": 9} done'))
    p = search.letter_probabilities(response, "ABC")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(p).alias("i", "p")).select("p_partkey", F.col("i").cast("long").alias("i"), F.round("p", 8).alias("p"))


@query("m8_rotated_ranker", f"WITH {_LONG}, r AS (SELECT event_id, alt_idx, avg(p) AS p FROM (SELECT event_id, alt_idx, CASE WHEN (alt_idx - k + j) % j = 0 THEN 0.75 WHEN (alt_idx - k + j) % j = 1 THEN 0.25 ELSE 0 END AS p FROM l, range(0, 10) AS s(k) WHERE k < j) GROUP BY 1, 2) SELECT event_id, alt_idx, round(ln(greatest(p, 1e-12)), 7) AS score FROM r")
def m8_rotated_ranker(spark, sf_dir):
    events = alternatives(spark, sf_dir).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("alt_idx", "title"))), lambda x: x["title"]).alias("alts"))
    got = search.rank_by_letters(events, lambda shown: F.concat(F.lit('{"A": 3, "B": 1, "Z": '), F.size(shown).cast("string"), F.lit("}")))
    return got.withColumn("score", F.round("score", 7))


@query("j11_unknown_customers", f"WITH {_RESULTS} SELECT model, count(*) AS n FROM res WHERE (seed, customer_id) NOT IN (SELECT DISTINCT seed, customer_id FROM res WHERE customer_id LIKE '%1%') GROUP BY 1")
def j11_unknown_customers(spark, sf_dir):
    r = results(spark, sf_dir)
    return search.unknown_customers(r, r.filter("customer_id like '%1%'")).groupBy("model").agg(F.count("*").alias("n"))


@query("p13_batch_subset", f"WITH {_LONG} SELECT event_id, alt_idx FROM l WHERE event_id IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def p13_batch_subset(spark, sf_dir):
    chosen = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("event_id"))
    return choice.subset(alternatives(spark, sf_dir), chosen).select("event_id", "alt_idx")


_GIVES = "bool_and(coalesce({0} <> 0, false)) AND bool_and(coalesce({1} = 0, false))"


@query("m7_leak_detector", f"""WITH {_LONG}, v AS (SELECT event_id, chosen, chosen::INT::DOUBLE AS leak, 1.0::DOUBLE AS fair, quantity FROM l), u AS (UNPIVOT v ON leak, fair, quantity INTO NAME feature VALUE x),
p AS (SELECT feature, event_id, max(CASE WHEN chosen THEN x END) AS own, max(CASE WHEN NOT chosen THEN abs(x) END) AS other FROM u GROUP BY 1, 2) SELECT feature FROM p GROUP BY 1 HAVING {_GIVES.format("own", "other")}""")
def m7_leak_detector(spark, sf_dir):
    rows = alternatives(spark, sf_dir).withColumns({"leak": F.col("chosen").cast("double"), "fair": F.lit(1.0)})
    return spark.createDataFrame([(f,) for f in search.leaking_features(rows, ["leak", "fair", "quantity"])], "feature string")


@query("r10_simulated_purchases")
def r10_simulated_purchases(spark, sf_dir):
    events = stored(purchases(spark, sf_dir).select("customer_id", "us", "seq", "asin", "category", "price"), "simulated-from")
    return search.simulate(events, 0.5)


@query("s15_synthetic_events")
def s15_synthetic_events(spark, sf_dir):
    return search.synthetic(spark, 1000, [1.0, -0.5])


@query("s13_external_scores", f"WITH {_LONG} SELECT event_id, alt_idx, quantity AS score FROM l")
def s13_external_scores(spark, sf_dir):
    a = alternatives(spark, sf_dir)
    return search.external_scores(a.drop("score"), a.select("event_id", "alt_idx", F.col("quantity").alias("logit"))).select("event_id", "alt_idx", "score")


_ERFC = "CASE WHEN {x} > 3.7 THEN 0 ELSE round(1 - 2 / sqrt(pi()) * list_sum([(-1) ** i * ({x}) ** (2 * i + 1) / (exp(lgamma(i + 1)) * (2 * i + 1)) for i in range(0, 60)]), 5) END"


@query(
    "e13_significance_tests",
    f"""WITH {_RESULTS}, {_PAIR}, t AS (SELECT model, count(*) AS n, count(*) FILTER (NOT top1_a AND top1) AS b01, count(*) FILTER (top1_a AND NOT top1) AS b10 FROM pk GROUP BY 1),
d AS (SELECT model, nll - nll_a AS d FROM pk WHERE nll <> nll_a), k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(d)) AS lo, count(*) OVER (PARTITION BY model, abs(d)) AS n FROM d), r AS (SELECT *, lo + (n - 1) / 2.0::DOUBLE AS rank FROM k),
w AS (SELECT model, least(coalesce(sum(rank) FILTER (d > 0), 0), sum(rank) - coalesce(sum(rank) FILTER (d > 0), 0)) AS s, count(*)::DOUBLE AS m, sum(n * n - 1)::DOUBLE AS ties FROM r GROUP BY 1),
z AS (SELECT model, abs(s - m * (m + 1) / 4) / sqrt((m * (m + 1) * (2 * m + 1) - ties / 2) / 24) / sqrt(2) AS x FROM w), c AS (SELECT model, n, CASE WHEN b01 + b10 > 0 THEN sqrt((abs(b01 - b10) - 1) ** 2 / (b01 + b10)::DOUBLE / 2) ELSE 0 END AS y FROM t)
SELECT model, n, {_ERFC.format(x="x")}::DOUBLE + 0.0::DOUBLE AS wilcoxon_p, {_ERFC.format(x="y")}::DOUBLE + 0.0::DOUBLE AS mcnemar_p FROM c JOIN z USING (model)""",
)
def e13_significance_tests(spark, sf_dir):
    got = posthoc.pair_tests(posthoc.paired(results(spark, sf_dir), "own"))
    return got.select("model", "n", F.round("wilcoxon_p", 5).alias("wilcoxon_p"), F.round("mcnemar_p", 5).alias("mcnemar_p"))


@query("e13_significance_report")
def e13_significance_report(spark, sf_dir):
    report = posthoc.significance(results(spark, sf_dir), "own")
    return spark.createDataFrame([(line,) for line in posthoc.significance_text(report).splitlines()], "line string")


@query("m6_structure_by_q_learning")
def m6_structure_by_q_learning(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    return structures.Structured(["units", "price", "position"]).fit(train).score(test).select("event_id", "alt_idx", "score")


@query("m18_neighbourhood_search")
def m18_neighbourhood_search(spark, sf_dir):
    train, _ = _halves(spark, sf_dir)
    fits = structures.Fits(train, ["units", "price", "position"])
    best, archive = structures.NeighbourhoodSearch().search(fits)
    return spark.createDataFrame([(", ".join(fits.shown(s)), float(nll), size, s == best) for s, nll, size in archive], "structure string, nll double, size int, best boolean")


@query(
    "f20_logprobs",
    "SELECT p_partkey, i::BIGINT AS i, round(CASE i WHEN 0 THEN exp(-p_size / 10.0::DOUBLE) WHEN 1 THEN exp(-1) ELSE 0 END / (exp(-p_size / 10.0::DOUBLE) + exp(-1)), 8) AS p FROM part, range(0, 3) AS r(i)",
)
def f20_logprobs(spark, sf_dir):
    token = lambda t, x: F.struct(F.lit(t).alias("token"), x.alias("logprob"))
    top = F.array(token(" A", -F.col("p_size") / 10.0), token("b)", F.lit(-1.0)), token("a", F.lit(-99.0)), token("the", F.lit(-0.1)))
    p = search.logprob_probabilities(top, "ABC")
    return table(spark, sf_dir, "part").select("p_partkey", F.posexplode(p).alias("i", "p")).select("p_partkey", F.col("i").cast("long").alias("i"), F.round("p", 8).alias("p"))


@query(
    "m8_few_shot_prompts",
    f"""WITH {_LONG}, {SPLIT_SQL}, ev AS (SELECT event_id, any_value(customer_id) AS customer_id, max(us) AS us, count(*) AS j FROM l GROUP BY 1), p AS (SELECT event_id, j, s.title, s.category, s.price, row_number() OVER (PARTITION BY event_id ORDER BY s.us DESC, s.seq DESC) AS k FROM ev JOIN s ON s.customer_id = ev.customer_id AND s.us < ev.us AND split = 'train'),
c AS (SELECT event_id, count(*) AS shown FROM p WHERE k <= 4 GROUP BY 1)
SELECT l.event_id, alt_idx, round(ln((j + coalesce(shown, 0)) / (j * (10.0::DOUBLE + coalesce(shown, 0)))), 7) AS score FROM l LEFT JOIN c USING (event_id)""",
)
def m8_few_shot_prompts(spark, sf_dir):
    """The stand-in reads its prompt: letter A weighs one more for every earlier choice that it shows, the other nine
    letters one each. Every alternative is once at A, so its mean tells how many examples the prompts had."""
    rows = alternatives(spark, sf_dir)
    events = rows.groupBy("event_id").agg(F.max("customer_id").alias("customer_id"), F.max("us").alias("us"), F.transform(F.array_sort(F.collect_list(F.struct("alt_idx", "title", "price"))), lambda x: F.struct(x["title"].alias("title"), x["price"].alias("price"))).alias("alts"))
    events = stored(events, "few-shot-events").withColumn("c_d", F.lit("Someone"))
    past = stored(split.temporal_split(purchases(spark, sf_dir)).filter("split = 'train'").select("customer_id", "us", "seq", "title", "category", "price"), "few-shot-past")
    examples = lambda prompt: F.regexp_count(F.regexp_extract(prompt, r"(?s)Earlier choices of this person:\n(.*?)\nAlternatives:", 1), F.lit(r"(?m)^- .* \| \$"))
    asked = lambda prompt: F.concat(F.lit('{"A": '), (examples(prompt) + 1).cast("string"), F.lit(', "B": 1, "C": 1, "D": 1, "E": 1, "F": 1, "G": 1, "H": 1, "I": 1, "J": 1}'))
    return search.few_shot(events, past, asked, shots=4).select("event_id", "alt_idx", F.round("score", 7).alias("score"))


@query(
    "j14_legacy_lookups",
    f"""WITH {_LONG}, h AS (SELECT *, row_number() OVER (PARTITION BY customer_id, asin ORDER BY us, seq) - 1 AS routine, row_number() OVER (PARTITION BY customer_id, category ORDER BY us, seq) - 1 AS cat_affinity, split_part(title, ' ', 1) AS brand FROM e),
x AS (SELECT customer_id, (asin::BIGINT % 50)::VARCHAR AS asin, event_id, alt_idx, category FROM l), p AS (SELECT customer_id, asin, max(routine) AS r FROM h GROUP BY 1, 2), i AS (SELECT asin, count(*) AS n, arg_min(category, (us, seq)) AS c, arg_min(brand, (us, seq)) AS brand FROM h GROUP BY 1),
a AS (SELECT customer_id, category AS c, max(cat_affinity) AS af FROM h GROUP BY 1, 2), b AS (SELECT customer_id, brand, count(*) AS nb FROM h GROUP BY 1, 2)
SELECT event_id, alt_idx, coalesce(r, 0)::DOUBLE AS routine, (r IS NULL)::INT::DOUBLE AS novelty, round(ln(1 + coalesce(n, 0)), 7) AS popularity, round(ln(1 + coalesce(af, 0)), 7) AS affinity, round(ln(1 + coalesce(nb, 0)), 7) AS brand_affinity, 0.0::DOUBLE AS co_purchase
FROM x LEFT JOIN i USING (asin) LEFT JOIN p USING (customer_id, asin) LEFT JOIN a ON a.customer_id = x.customer_id AND a.c = coalesce(i.c, x.category) LEFT JOIN b ON b.customer_id = x.customer_id AND b.brand = i.brand""",
)
def j14_legacy_lookups(spark, sf_dir):
    e = history.state_features(purchases(spark, sf_dir)).withColumn("brand", F.split_part("title", F.lit(" "), F.lit(1)))
    rows = alternatives(spark, sf_dir).withColumn("asin", (F.col("asin").cast("long") % 50).cast("string"))
    e = stored(e.select("customer_id", "us", "seq", "asin", "category", "brand", "price", "routine", "recency_days", "cat_affinity"), "legacy-events")
    got = search.legacy_lookups(rows, e)
    return got.select("event_id", "alt_idx", "routine", "novelty", *(F.round(c, 7).alias(c) for c in ("popularity", "affinity", "brand_affinity")), "co_purchase")


@query("w7_split_counts", f"WITH e AS ({PURCHASES}), {SPLIT_SQL} SELECT split, count(*) AS n FROM s GROUP BY 1")
def split_counts(spark, sf_dir):
    return split.temporal_split(purchases(spark, sf_dir)).groupBy("split").agg(F.count("*").alias("n"))





def _halves(spark, sf_dir):
    a = planted(spark, sf_dir)
    return a.filter(F.col("us") < CUT_US), a.filter(F.col("us") >= CUT_US)


@query("m4_relevance_logit")
def m4_relevance_logit(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    return models.PriorLogit(["units", "log_price", "position"], relevance=True).fit(train).score(test).select("event_id", "alt_idx", "score")


@query("m15_hierarchical_logit")
def m15_hierarchical_logit(spark, sf_dir):
    a = planted(spark, sf_dir)
    top = [r["category"] for r in legacy.top_categories(a.filter(F.col("us") < CUT_US)).collect()]  # the most frequent have deviations of their own
    rows, names = models.hierarchical(a, ["units"], "category", top)
    fitted = models.PriorLogit(names, {n: 10.0 for n in names}).fit(rows.filter(F.col("us") < CUT_US))
    return fitted.score(rows.filter(F.col("us") >= CUT_US)).select("event_id", "alt_idx", "score")


@query("m15_personal_logit")
def m15_personal_logit(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    return models.PersonalLogit(["units", "log_price"]).fit(train).score(test).select("event_id", "alt_idx", "score")


@query("m5_monotone_net")
def m5_monotone_net(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    return nets.NetLogit(["units", "log_price", "position"], monotone={"log_price": -1}).fit(train).score(test).select("event_id", "alt_idx", "score")


@query("m7_text_net")
def m7_text_net(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    return nets.TextNet("title").fit(train).score(test).select("event_id", "alt_idx", "score")


@query("m9_m10_equation_search")
def m9_equation_search(spark, sf_dir):
    train, test = _halves(spark, sf_dir)
    found = symbolic.EquationSearch(["units", "log_price", "position"], library=20).fit(train)
    return found.score(test).select("event_id", "alt_idx", "score")


@query("e9_leaderboard")
def e9_leaderboard(spark, sf_dir):
    """The registry's models with their default settings, but for three that have queries of their own."""
    train, test = (stored(d, "halves") for d in _halves(spark, sf_dir))
    letters = lambda shown: F.concat(F.lit('{"A": 2, "B": 1, "n": '), F.size(shown).cast("string"), F.lit("}"))
    own = ("q_structure", "neighbourhood_structure", "personal_logit")
    chosen = {k: v for k, v in runs.registry(["units", "log_price", "position"], "title", letters).items() if k not in own}
    board = search.leaderboard(chosen, train, test)
    return board.select("model", "status", "nll", "top1", "mrr", "uplift", "note")


@query("s12_run")
def s12_run(spark, sf_dir):
    """From events to a leaderboard of three models, through choice sets and whole records."""
    from .person_queries import people

    who = people(spark, sf_dir)
    who = who.join(persons.vectors(who, persons.fit(who)), "customer_id")
    chosen = {k: v for k, v in runs.registry(runs.FEATURES).items() if k in ("popularity", "position", "relevance_logit")}
    return runs.run(purchases(spark, sf_dir), who, runs.person_context(), chosen=chosen).select("model", "status", "nll", "top1", "mrr", "uplift", "note")


def _net_events(spark, sf_dir):
    """Six vectors an event: two alternatives of three outcomes."""
    v = table(spark, sf_dir, "embeddings").withColumn("event_id", F.floor(F.col("vec_id") / 6))
    e = v.groupBy("event_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("e"), F.count("*").alias("n"))
    return e.filter("n = 6").withColumn("z", F.transform(F.sequence(F.lit(1), F.lit(26)), lambda i: i / 26.0))


def _net_sample(spark, sf_dir):
    """At most 5,000 events, each with its alternative of the greater sum of labels as the choice: (train, validation)."""
    events = _net_events(spark, sf_dir)
    labels = table(spark, sf_dir, "embeddings").select(F.floor(F.col("vec_id") / 6).alias("event_id"), F.when(F.col("vec_id") % 6 < 3, -F.col("label")).otherwise(F.col("label")).alias("d"))
    own = labels.groupBy("event_id").agg((F.sum("d") > 0).cast("int").alias("own"))
    rows = events.join(own, "event_id").orderBy(F.xxhash64("event_id"), "event_id").limit(5000).select("z", "e", "own").collect()
    z, e, own = np.array([r["z"] for r in rows], float), np.array([r["e"] for r in rows], float).reshape(len(rows), 2, 3, -1), np.array([r["own"] for r in rows], int)
    cut = max(1, len(rows) * 4 // 5)
    return (z[:cut], e[:cut], own[:cut], np.ones(cut)), (z[cut:], e[cut:], own[cut:])


@query("e8_counterfactual")
def e8_counterfactual(spark, sf_dir):
    net = models.UtilityNet()
    net.fit(*_net_sample(spark, sf_dir))
    return search.counterfactual(_net_events(spark, sf_dir), net.score, lambda z: F.transform(z, lambda x: x * 2))


@query("m12_ablation_sweep")
def m12_ablation_sweep(spark, sf_dir):
    grid = {"utility": ["attributes", "concat", "film"], "salience": ["net", "uniform"], "outcomes": [1, 3]}
    rows = models.sweep(*_net_sample(spark, sf_dir), grid, models.UtilityNet(hidden=16), epochs=10)
    return spark.createDataFrame([tuple(r.values()) for r in rows], "utility string, salience string, outcomes int, nll double, n_params int")


@query("e7_by_dominant_attribute", f"WITH {_EVENTS}, t AS (SELECT event_id, m, sum(x) AS s FROM (SELECT event_id, (event_id % 5)::BIGINT AS m, 1.0::DOUBLE AS x FROM pe) GROUP BY 1, 2) SELECT m, count(*) AS n, round(avg(nll), 7) AS nll FROM pe JOIN t USING (event_id) GROUP BY 1")
def e7_by_dominant_attribute(spark, sf_dir):
    """Attribute values are made so that attribute event_id % 5 dominates."""
    rows = scored(spark, sf_dir)
    m = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))).alias("m")
    made = rows.select("event_id", m).select("event_id", F.lit(0).cast("long").alias("k"), "m", F.when(F.col("m") == F.col("event_id") % 5, 2.0).otherwise(-1.0).alias("a"), F.lit(1.0).alias("w"))
    return runs.by_dominant(made, rows).select("m", "n", F.round("nll", 7).alias("nll"))


@query(
    "e6_decision_report",
    "WITH p AS (SELECT vec_id AS k, m::BIGINT AS m, (m * embedding[m]::DOUBLE) AS part FROM embeddings, range(1, 6) AS r(m)) SELECT k, string_agg(m::VARCHAR, ',' ORDER BY part DESC, m DESC) AS parts FROM p GROUP BY 1",
)
def e6_decision_report(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.lit(1).cast("long").alias("event_id"), F.lit(0).cast("long").alias("alt_idx"), F.col("vec_id").alias("k"), F.posexplode(F.slice("embedding", 1, 5)).alias("m", "a"))
    a = v.withColumns({"m": (F.col("m") + 1).cast("long"), "a": F.col("a").cast("double")})
    w = spark.range(1, 6).select(F.lit(1).cast("long").alias("event_id"), F.col("id").alias("m"), F.col("id").cast("double").alias("w"))
    return search.decision(a, w, 1).select("k", F.array_join(F.transform("parts", lambda p: p["m"].cast("string")), ",").alias("parts"))
