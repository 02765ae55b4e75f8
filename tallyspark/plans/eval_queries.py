"""Features, metrics, post-hoc and legacy statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import choice, features, legacy, metrics, posthoc, split
from ..sources.binding import CLICKS, DAY_US, PURCHASES, clicks, purchases, table
from .history_queries import SPLIT_SQL
from .registry import query

_LONG = f"""e AS ({PURCHASES}), l0 AS (SELECT *, order_id AS event_id, row_number() OVER (PARTITION BY order_id ORDER BY seq) - 1 AS alt_idx, count(*) OVER (PARTITION BY order_id) AS j FROM e),
l AS (SELECT *, alt_idx = event_id % j AS chosen, floor(quantity / 10)::DOUBLE AS score FROM l0 WHERE j BETWEEN 2 AND 10)"""


def alternatives(spark, sf_dir):
    """Orders as events, their lines as alternatives; one of them, by position, is the choice."""
    w = Window.partitionBy("event_id")  # the key of all that follows, so one exchange serves
    rows = purchases(spark, sf_dir).withColumnRenamed("order_id", "event_id").withColumns({"alt_idx": (F.row_number().over(w.orderBy("seq")) - 1).cast("long"), "j": F.count("*").over(w)})
    return rows.filter("j between 2 and 10").withColumns({"chosen": F.col("alt_idx") == F.col("event_id") % F.col("j"), "score": F.floor(F.col("quantity") / 10).cast("double")})


def planted(spark, sf_dir):
    """The same alternatives, with features and a choice that follows them: many units and a low price, beside chance.

    units counts for 0.8, log_price for -4 of a logit's utility, the rest is a Gumbel draw by hash.
    """
    a = alternatives(spark, sf_dir).withColumns({"log_price": F.log1p("price"), "position": F.col("alt_idx").cast("double"), "units": F.col("quantity") / 10})
    chance = -F.log(-F.log(choice.uniform(F.lit("planted"), F.col("seq"))))
    w = Window.partitionBy("event_id")
    a = a.withColumn("_u", 0.8 * F.col("units") - 4.0 * F.col("log_price") + chance)
    return a.withColumn("chosen", F.col("_u") == F.max("_u").over(w)).drop("_u", "score")


@query("w8_price_rank", f"WITH {_LONG} SELECT event_id, alt_idx, round((row_number() OVER (PARTITION BY event_id ORDER BY price, alt_idx) - 1) / (j - 1)::DOUBLE, 9) AS price_rank FROM l")
def w8_price_rank(spark, sf_dir):
    return alternatives(spark, sf_dir).select("event_id", "alt_idx", F.round(features.price_rank(), 9).alias("price_rank"))


@query("w9_cheaper_share", f"WITH {_LONG} SELECT event_id, alt_idx, round(1 - (rank() OVER (PARTITION BY event_id ORDER BY price) - 1) / j::DOUBLE, 9) AS r FROM l")
def w9_cheaper_share(spark, sf_dir):
    return alternatives(spark, sf_dir).select("event_id", "alt_idx", F.round(features.cheaper_share_rank(), 9).alias("r"))


@query(
    "p15_base_features",
    f"WITH {_LONG} SELECT event_id, alt_idx, coalesce(try_cast(regexp_extract(title || ' top 5%', '(\\d+(?:\\.\\d+)?)', 1) AS DOUBLE), 0.0) AS popularity_rank, round(ln(1 + greatest(price, 0)), 8) AS log1p_price, round((row_number() OVER (PARTITION BY event_id ORDER BY price, alt_idx) - 1) / (j - 1)::DOUBLE, 9) AS price_rank, quantity AS extra FROM l",
)
def p15_base_features(spark, sf_dir):
    rows = alternatives(spark, sf_dir).withColumn("title", F.concat("title", F.lit(" top 5%")))
    got = features.base_features(rows, "title", {"extra": F.col("quantity")})
    return got.select("event_id", "alt_idx", "popularity_rank", F.round("log1p_price", 8).alias("log1p_price"), F.round("price_rank", 9).alias("price_rank"), "extra")


@query("p14_long_form", f"WITH {_LONG} SELECT event_id, alt_idx, round(1.0::DOUBLE / j, 9) AS weight, CASE WHEN chosen THEN 1 ELSE 0 END::BIGINT AS label, asin FROM l")
def p14_long_form(spark, sf_dir):
    rows = alternatives(spark, sf_dir)
    records = rows.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("alt_idx", "asin"))), lambda a: F.struct(a["asin"].alias("asin"))).alias("alternatives"), F.max(F.when(F.col("chosen"), F.col("alt_idx"))).alias("chosen_idx"))
    return features.long_form(records).select("event_id", F.col("alt_idx").cast("long").alias("alt_idx"), F.round("weight", 9).alias("weight"), F.col("label").cast("long").alias("label"), F.col("alt.asin").alias("asin"))


_POOL = ["quantity", "size", "gap"]


def _pool_sql() -> str:
    out = _POOL + [f"round(sign({n}) * ln(1 + abs({n})), 6) AS log1p_{n}" for n in _POOL] + [f"round(sign({n}) * {n} * {n}, 6) AS sq_{n}" for n in _POOL]
    out += [f"round({a} * {b}, 6) + 0.0::DOUBLE AS {a}_x_{b}" for i, a in enumerate(_POOL) for b in _POOL[i + 1 :]]
    return f"SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, {', '.join(out)} FROM (SELECT *, l_quantity AS quantity, l_suppkey::DOUBLE AS size, l_quantity - 25 AS gap FROM lineitem)"


@query("p16_expanded_pool", _pool_sql())
def p16_expanded_pool(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").withColumns({"quantity": F.col("l_quantity"), "size": F.col("l_suppkey").cast("double"), "gap": F.col("l_quantity") - 25})
    pool = features.expanded(_POOL)
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *(c if n in _POOL else (F.round(c, 6) + 0.0).alias(n) for n, c in pool.items()))


_EVENTS = f"""{_LONG}, o AS (SELECT event_id, alt_idx AS own_idx, score AS own, customer_id, category, us FROM l WHERE chosen),
m AS (SELECT event_id, max(score) AS top FROM l GROUP BY 1), x AS (SELECT event_id, any_value(top) AS top, any_value(top) + ln(sum(exp(score - top))) AS log_sum FROM l JOIN m USING (event_id) GROUP BY 1),
ev AS (SELECT event_id, any_value(customer_id) AS customer_id, any_value(category) AS category, any_value(us) AS us, count(*) AS n_alts, any_value(log_sum - own) AS nll,
  count(*) FILTER (score > own) AS above, count(*) FILTER (score = own) - 1 AS equal, count(*) FILTER (score = own AND alt_idx < own_idx) AS before, any_value(exp(top - log_sum)) AS confidence
  FROM (SELECT l.event_id, l.score, l.alt_idx, o.* EXCLUDE (event_id) FROM l JOIN o USING (event_id)) JOIN x USING (event_id) GROUP BY 1),
pe AS (SELECT *, 1.0::DOUBLE / (1 + above + 0.5::DOUBLE * equal) AS rr, above + before AS rank, above + before < 1 AS top1, above + before < least(5, n_alts) AS topk FROM ev)"""


def scored(spark, sf_dir):
    rows = alternatives(spark, sf_dir)
    own = {"customer_id": "customer_id", "own_category": "category", "own_us": "us"}
    w = Window.partitionBy("event_id")
    marked = rows.withColumns({k: F.max(F.when(F.col("chosen"), F.col(v))).over(w) for k, v in own.items() if k != "customer_id"})
    got = metrics.per_event(marked, ["customer_id", "own_category", "own_us"])
    return got.withColumnsRenamed({"own_category": "category", "own_us": "us"})


@query("f26_f27_o2_per_event", f"WITH {_EVENTS} SELECT event_id, n_alts, round(nll, 8) AS nll, round(rr, 8) AS rr, rank, top1, topk, round(confidence, 8) AS confidence FROM pe")
def f26_per_event(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", "n_alts", F.round("nll", 8).alias("nll"), F.round("rr", 8).alias("rr"), "rank", "top1", "topk", F.round("confidence", 8).alias("confidence"))


_AGG = """count(*) AS n, round(avg(top1::INT), 7) AS top1, round(avg(topk::INT), 7) AS topk, round(avg(rr), 7) AS mrr, round(avg(nll), 7) AS nll, round(2.0 * 12 + 2.0 * 500 * avg(nll), 4) AS aic,
  round(12 * ln(500.0::DOUBLE) + 2.0 * 500 * avg(nll), 4) AS bic, round(1 - avg(nll) / avg(ln(n_alts)), 7) AS pseudo_r2"""


def _rounded(df):
    return df.select(*(F.round(c, 4 if c in ("aic", "bic") else 7).alias(c) if k == "double" else c for c, k in df.dtypes))


@query("e1_a26_metric_panel", f"WITH {_EVENTS} SELECT {_AGG} FROM pe")
def e1_metric_panel(spark, sf_dir):
    return _rounded(metrics.panel(scored(spark, sf_dir), 12, 500))


@query("e3_a13_a15_category_strata", f"WITH {_EVENTS} SELECT category, {_AGG} FROM pe GROUP BY 1")
def e3_category_strata(spark, sf_dir):
    return _rounded(metrics.panel(scored(spark, sf_dir), 12, 500, ["category"]))


@query("a27_ece", f"WITH {_EVENTS}, b AS (SELECT least(trunc(confidence * 15)::INT, 14) AS bin, count(*) AS n, avg(confidence) AS conf, avg(top1::INT) AS acc FROM pe GROUP BY 1) SELECT round(sum(n * abs(conf - acc)) / sum(n), 7) AS ece, sum(n)::BIGINT AS n FROM b")
def a27_ece(spark, sf_dir):
    return metrics.ece(scored(spark, sf_dir)).select(F.round("ece", 7).alias("ece"), "n")


@query("a12_per_customer", f"WITH {_EVENTS} SELECT customer_id, round(avg(nll), 7) AS nll, round(avg(top1::INT), 7) AS top1, count(*) AS n_events FROM pe GROUP BY 1")
def a12_per_customer(spark, sf_dir):
    return _rounded(metrics.per_customer(scored(spark, sf_dir)))


@query("a14_repeat_novel", f"WITH {_EVENTS}, r AS (SELECT *, n_alts % 2 = 0 AS is_repeat FROM pe), k(kind, is_repeat) AS (VALUES ('repeat', true), ('novel', false)) SELECT kind, count(event_id) AS n, round(coalesce(avg(top1::INT), 0), 7) AS top1 FROM k LEFT JOIN r USING (is_repeat) GROUP BY 1")
def a14_repeat_novel(spark, sf_dir):
    return _rounded(metrics.repeat_novel(scored(spark, sf_dir).withColumn("is_repeat", F.col("n_alts") % 2 == 0)))


@query("a20_j13_weighted_loss", f"WITH {_EVENTS}, w AS (SELECT c_custkey::VARCHAR AS customer_id, 1 + c_nationkey / 10.0::DOUBLE AS w FROM customer WHERE c_acctbal > 3000) SELECT round(sum(coalesce(w, 1) * nll) / sum(coalesce(w, 1)), 7) AS loss FROM pe LEFT JOIN w USING (customer_id)")
def a20_weighted_loss(spark, sf_dir):
    w = table(spark, sf_dir, "customer").filter("c_acctbal > 3000").select(F.col("c_custkey").cast("string").alias("customer_id"), (1 + F.col("c_nationkey") / 10.0).alias("weight"))
    return _rounded(metrics.weighted_loss(choice.with_weights(scored(spark, sf_dir), w), "omega"))


@query("f29_activity_tertile", f"WITH e AS ({PURCHASES}), c AS (SELECT customer_id, count(*) AS n FROM e GROUP BY 1), q AS (SELECT quantile_cont(n, 1/3::DOUBLE) AS a, quantile_cont(n, 2/3::DOUBLE) AS b FROM c) SELECT customer_id, n, CASE WHEN n >= b THEN 'high' WHEN n >= a THEN 'mid' ELSE 'low' END AS tertile FROM c, q")
def f29_activity_tertile(spark, sf_dir):
    return metrics.tertiles(purchases(spark, sf_dir).groupBy("customer_id").agg(F.count("*").alias("n")), "n")


@query("f28_time_of_day", "SELECT event_id, CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS part, CASE WHEN hour(ts) < 6 OR hour(ts) = 23 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' WHEN hour(ts) < 18 THEN 'afternoon' ELSE 'evening' END AS old_part FROM events")
def f28_time_of_day(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", metrics.time_of_day(F.hour("ts")).alias("part"), metrics.time_of_day(F.hour("ts"), 23).alias("old_part"))


_ATTR = "atr AS (SELECT vec_id AS event_id, (i - 1) // 16 AS k, (i - 1) % 16 AS m, embedding[i]::DOUBLE AS a, 1.0::DOUBLE + ((i - 1) % 16) / 16.0::DOUBLE AS w FROM embeddings, range(1, 65) AS r(i))"


def _attributes(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), F.posexplode("embedding").alias("i", "a"))
    return v.select("event_id", F.floor(F.col("i") / 16).alias("k"), (F.col("i") % 16).cast("long").alias("m"), F.col("a").cast("double").alias("a"), (1.0 + (F.col("i") % 16) / 16.0).alias("w"))


@query("e4_e7_dominant_attribute", f"WITH {_ATTR}, s AS (SELECT event_id, m, any_value(w) * avg(abs(a)) AS s FROM atr GROUP BY 1, 2) SELECT event_id, m FROM s QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY s DESC, m) = 1")
def e4_dominant_attribute(spark, sf_dir):
    return metrics.dominant(_attributes(spark, sf_dir))


@query("o3_e5_head_top_outcomes", f"WITH {_ATTR} SELECT m, event_id, k, rn FROM (SELECT *, row_number() OVER (PARTITION BY m ORDER BY a DESC, event_id, k) AS rn FROM atr) WHERE rn <= 20")
def o3_head_top_outcomes(spark, sf_dir):
    return legacy.top_of_heads(_attributes(spark, sf_dir), 20)


# Results of three models over two seeds, made from line items: a seed is a line status, an event a line.
_RESULTS = """res AS (SELECT m AS model, l_returnflag AS seed, l_orderkey * 1000 + row_number() OVER (PARTITION BY m, l_returnflag, l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS event_idx, l_suppkey::VARCHAR AS customer_id,
  CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE 'c' || l_linenumber END AS category, l_linenumber % 2 = 0 AS is_repeat, floor(l_quantity / (k + 1))::DOUBLE + (l_partkey % 7) * k AS nll, (l_partkey + k) % 3 = 0 AS top1, CASE WHEN m = 'late' AND l_returnflag = 'N' THEN 'errored' ELSE 'ok' END AS status
  FROM lineitem, (VALUES ('own', 0), ('popularity', 1), ('late', 2)) AS v(m, k))"""


def results(spark, sf_dir):
    models = F.explode(F.array(*(F.struct(F.lit(m).alias("m"), F.lit(k).alias("k")) for k, m in enumerate(("own", "popularity", "late")))))
    order = Window.partitionBy("seed", "l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")  # an order has few lines
    rows = table(spark, sf_dir, "lineitem").withColumn("seed", F.col("l_returnflag")).withColumn("event_idx", F.col("l_orderkey") * 1000 + F.row_number().over(order)).withColumn("v", models)
    return rows.select(
        F.col("v.m").alias("model"), "seed", "event_idx", F.col("l_suppkey").cast("string").alias("customer_id"),
        F.when(F.col("l_linenumber") % 5 != 0, F.concat(F.lit("c"), "l_linenumber")).alias("category"), (F.col("l_linenumber") % 2 == 0).alias("is_repeat"),
        (F.floor(F.col("l_quantity") / (F.col("v.k") + 1)).cast("double") + (F.col("l_partkey") % 7) * F.col("v.k")).alias("nll"), ((F.col("l_partkey") + F.col("v.k")) % 3 == 0).alias("top1"),
        F.when((F.col("v.m") == "late") & (F.col("seed") == "N"), "errored").otherwise("ok").alias("status"),
    )


_SEG = """sg AS (SELECT customer_id, CASE WHEN n <= 2 THEN 'short' WHEN n <= 6 THEN 'medium' ELSE 'long' END AS trajectory, CASE WHEN c <= 1 THEN 'single' WHEN c = 2 THEN 'dual' ELSE 'multi' END AS categories, CASE WHEN v < 0.3::DOUBLE THEN 'low' WHEN v <= 0.7::DOUBLE THEN 'mid' ELSE 'high' END AS novelty
  FROM (SELECT customer_id, count(*) AS n, count(DISTINCT coalesce(category, '?')) AS c, avg(CASE WHEN is_repeat THEN 0.0 ELSE 1.0 END) AS v FROM res WHERE model = 'own' GROUP BY 1))"""
_CM = "cm AS (SELECT model, customer_id, avg(nll) AS nll, avg(top1) AS top1, count(*) AS n_seeds FROM (SELECT model, seed, customer_id, avg(nll) AS nll, avg(top1::INT) AS top1 FROM res WHERE status = 'ok' GROUP BY 1, 2, 3) GROUP BY 1, 2)"


@query("a16_f30_segments", f"WITH {_RESULTS}, {_SEG} SELECT * FROM sg")
def a16_segments(spark, sf_dir):
    return posthoc.segments(results(spark, sf_dir).filter("model = 'own'"))


@query("a17_customer_metrics", f"WITH {_RESULTS}, {_CM} SELECT model, customer_id, round(nll, 7) AS nll, round(top1, 7) AS top1, n_seeds FROM cm")
def a17_customer_metrics(spark, sf_dir):
    return _rounded(posthoc.customer_metrics(results(spark, sf_dir)))


@query("a18_e14_by_segment", f"WITH {_RESULTS}, {_SEG}, {_CM} SELECT novelty AS segment, model, round(avg(nll), 7) AS nll_mean, round(coalesce(stddev_samp(nll), 0), 7) AS nll_std, round(avg(top1), 7) AS top1, count(*) AS n_customers FROM cm JOIN sg USING (customer_id) GROUP BY 1, 2")
def a18_by_segment(spark, sf_dir):
    r = results(spark, sf_dir)
    return _rounded(posthoc.by_segment(posthoc.customer_metrics(r), posthoc.segments(r.filter("model = 'own'")), "novelty"))


@query("o4_o5_segment_wins", f"WITH {_RESULTS}, {_SEG}, {_CM}, b AS (SELECT novelty AS segment, model, avg(nll) AS nll FROM cm JOIN sg USING (customer_id) GROUP BY 1, 2) SELECT segment, round(max(nll) FILTER (model = 'own'), 7) AS own, round(min(nll) FILTER (model <> 'own'), 7) AS best_other, round(min(nll) FILTER (model <> 'own') - max(nll) FILTER (model = 'own'), 7) AS gain FROM b GROUP BY 1 ORDER BY gain DESC, segment LIMIT 5")
def o4_segment_wins(spark, sf_dir):
    r = results(spark, sf_dir)
    return _rounded(posthoc.wins(posthoc.by_segment(posthoc.customer_metrics(r), posthoc.segments(r.filter("model = 'own'")), "novelty"), "own"))


@query("a19_uplift", f"WITH {_RESULTS}, b AS (SELECT model, avg(nll) AS nll FROM res WHERE status = 'ok' GROUP BY 1) SELECT model, round(nll, 7) AS nll, round((SELECT nll FROM b WHERE model = 'popularity') - nll, 7) AS uplift FROM b")
def a19_uplift(spark, sf_dir):
    return _rounded(posthoc.uplift(results(spark, sf_dir).filter("status = 'ok'").groupBy("model").agg(F.avg("nll").alias("nll"))))


_PAIR = """ow AS (SELECT seed, event_idx, nll AS nll_a, top1 AS top1_a FROM res WHERE model = 'own' AND status = 'ok'),
pr AS (SELECT res.model, seed, event_idx, nll, top1, nll_a, top1_a FROM res JOIN ow USING (seed, event_idx) WHERE model <> 'own' AND status = 'ok'),
pk AS (SELECT * FROM pr WHERE model IN (SELECT model FROM pr GROUP BY 1 HAVING count(DISTINCT seed) = (SELECT count(DISTINCT seed) FROM ow)))"""


@query("j12_paired_alignment", f"WITH {_RESULTS}, {_PAIR} SELECT model, seed, count(*) AS n, sum(nll - nll_a) AS d FROM pk GROUP BY 1, 2")
def j12_paired_alignment(spark, sf_dir):
    return posthoc.paired(results(spark, sf_dir), "own").groupBy("model", "seed").agg(F.count("*").alias("n"), F.sum(F.col("nll") - F.col("nll_a")).alias("d"))


@query("a25_e11_mcnemar", f"WITH {_RESULTS}, {_PAIR}, t AS (SELECT model, count(*) FILTER (NOT top1_a AND NOT top1) AS b00, count(*) FILTER (NOT top1_a AND top1) AS b01, count(*) FILTER (top1_a AND NOT top1) AS b10, count(*) FILTER (top1_a AND top1) AS b11 FROM pk GROUP BY 1) SELECT *, round(CASE WHEN b01 + b10 > 0 THEN (abs(b01 - b10) - 1) ** 2 / (b01 + b10)::DOUBLE END, 7) AS statistic FROM t")
def a25_mcnemar(spark, sf_dir):
    return _rounded(posthoc.mcnemar(posthoc.paired(results(spark, sf_dir), "own")))


@query("e10_wilcoxon", f"WITH {_RESULTS}, {_PAIR}, d AS (SELECT model, nll - nll_a AS d FROM pk WHERE nll <> nll_a), k AS (SELECT *, rank() OVER (PARTITION BY model ORDER BY abs(d)) AS lo, count(*) OVER (PARTITION BY model, abs(d)) AS n FROM d), r AS (SELECT *, lo + (n - 1) / 2.0::DOUBLE AS rank FROM k) SELECT model, least(coalesce(sum(rank) FILTER (d > 0), 0), sum(rank) - coalesce(sum(rank) FILTER (d > 0), 0)) AS statistic, count(*) AS n, sum(n * n - 1)::DOUBLE AS tie_term FROM r GROUP BY 1")
def e10_wilcoxon(spark, sf_dir):
    return posthoc.wilcoxon(posthoc.paired(results(spark, sf_dir), "own"))


@query("r9_bootstrap")
def r9_bootstrap(spark, sf_dir):
    return posthoc.bootstrap(posthoc.paired(results(spark, sf_dir), "own"))


_MOVES = "mv AS (SELECT category, lead(category) OVER (PARTITION BY customer_id ORDER BY us, seq) AS next FROM e), m2 AS (SELECT * FROM mv WHERE next IS NOT NULL), tp AS (SELECT category FROM m2 GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 3), tr AS (SELECT category, next, count(*) AS n FROM m2 WHERE category IN (FROM tp) AND next IN (FROM tp) GROUP BY 1, 2)"


@query("a22_w12_transitions", f"WITH e AS ({CLICKS}), {_MOVES} SELECT category, next, n, round(n / sum(n) OVER (PARTITION BY category)::DOUBLE, 8) AS share FROM tr")
def a22_transitions(spark, sf_dir):
    t = legacy.transitions(clicks(spark, sf_dir), 3)
    return t.withColumn("share", F.round("share", 8))


@query(
    "a23_w10_w11_posterior_stats",
    f"""WITH e AS ({PURCHASES}), r AS (SELECT *, (row_number() OVER (PARTITION BY customer_id, asin ORDER BY us, seq) > 1)::INT AS again, floor((us - lag(us) OVER (PARTITION BY customer_id ORDER BY us, seq)) / {DAY_US}::DOUBLE) AS gap FROM e),
c AS (SELECT customer_id, avg(again) AS again, avg(price) AS price FROM r GROUP BY 1), b AS (SELECT customer_id, sum(n * n) / (sum(n) ** 2)::DOUBLE AS hhi FROM (SELECT customer_id, state, title, count(*) AS n FROM e GROUP BY ALL) GROUP BY 1)
SELECT round(avg(again), 7) AS repeat_rate, (SELECT round(sum(gap) / count(gap), 7) FROM r) AS mean_gap, round(avg(price), 5) AS mean_price, round(avg(hhi), 7) AS brand_hhi FROM c JOIN b USING (customer_id)""",
)
def a23_posterior_stats(spark, sf_dir):
    s = legacy.posterior_stats(purchases(spark, sf_dir), "title")
    return s.select(*(F.round(c, 5 if c == "mean_price" else 7).alias(c) for c in s.columns))


@query(
    "m16_frequency_baseline",
    f"""WITH {_LONG}, h AS (SELECT customer_id, asin, count(*) AS bought FROM e GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(bought, 0) DESC, alt_idx) AS rk FROM l LEFT JOIN h USING (customer_id, asin))
SELECT round(avg((rk <= 1)::INT), 7) AS top1, round(avg((rk <= 5)::INT), 7) AS top5, round(avg(1.0::DOUBLE / rk), 7) AS mrr, count(*) AS n FROM r WHERE chosen""",
)
def m16_frequency_baseline(spark, sf_dir):
    return _rounded(legacy.frequency_baseline(alternatives(spark, sf_dir), purchases(spark, sf_dir)))


@query(
    "m16_markov_baseline",
    f"""WITH {_LONG}, {_MOVES.replace("LIMIT 3", "LIMIT 10")}, sh AS (SELECT category AS prev_category, next AS event_category, n / sum(n) OVER (PARTITION BY category)::DOUBLE AS share FROM tr), pp AS (SELECT category AS event_category, asin, count(*) AS pop FROM e GROUP BY 1, 2),
a AS (SELECT *, first_value(category) OVER (PARTITION BY event_id ORDER BY alt_idx) AS prev_category, max(CASE WHEN chosen THEN category END) OVER (PARTITION BY event_id) AS event_category FROM l),
r AS (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY coalesce(share, 1e-3) * (1 + coalesce(pop, 0)) DESC, alt_idx) AS rk FROM a LEFT JOIN sh USING (prev_category, event_category) LEFT JOIN pp USING (event_category, asin))
SELECT round(avg((rk <= 1)::INT), 7) AS top1, round(avg((rk <= 5)::INT), 7) AS top5, round(avg(1.0::DOUBLE / rk), 7) AS mrr, count(*) AS n FROM r WHERE chosen""",
)
def m16_markov_baseline(spark, sf_dir):
    w = Window.partitionBy("event_id")
    a = alternatives(spark, sf_dir).withColumns({"prev_category": F.first("category").over(w.orderBy("alt_idx")), "event_category": F.max(F.when(F.col("chosen"), F.col("category"))).over(w)})
    return _rounded(legacy.markov_baseline(a, purchases(spark, sf_dir)))


@query("n3_activity_level", f"WITH e AS ({PURCHASES}), c AS (SELECT customer_id, count(*) AS n FROM e GROUP BY 1), q AS (SELECT quantile_cont(n, 1/3::DOUBLE) AS a, quantile_cont(n, 2/3::DOUBLE) AS b FROM c) SELECT CASE WHEN n >= b THEN 'high' WHEN n >= a THEN 'medium' ELSE 'low' END AS level, count(*) AS customers FROM c, q GROUP BY 1")
def n3_activity_level(spark, sf_dir):
    return legacy.activity_levels(purchases(spark, sf_dir).groupBy("customer_id").agg(F.count("*").alias("n")), "n").groupBy("level").agg(F.count("*").alias("customers"))


@query("n5_error_slices", f"WITH {_EVENTS}, f AS (SELECT *, event_id % 2 = 0 AS is_repeat, n_alts > 5 AS is_popular, (NOT top1)::INT AS wrong FROM pe) SELECT category, count(*) AS n, round(avg(wrong), 7) AS error_rate, round(sum(wrong * (NOT is_repeat)::INT) / sum(wrong)::DOUBLE, 7) AS first_share, round(sum(wrong * is_popular::INT) / sum(wrong)::DOUBLE, 7) AS popular_share, CASE WHEN sum(wrong * (NOT is_repeat)::INT) / sum(wrong)::DOUBLE >= 0.4 THEN 'first buys' WHEN sum(wrong * is_popular::INT) / sum(wrong)::DOUBLE >= 0.4 THEN 'popular items' ELSE 'none' END AS pattern FROM f GROUP BY 1 ORDER BY error_rate DESC, category LIMIT 5")
def n5_error_slices(spark, sf_dir):
    rows = scored(spark, sf_dir).withColumns({"is_repeat": F.col("event_id") % 2 == 0, "is_popular": F.col("n_alts") > 5})
    return _rounded(legacy.error_slices(rows))


@query("n6_purchases_describe", f"WITH e AS ({PURCHASES}), c AS (SELECT customer_id, count(*) AS n FROM e GROUP BY 1) SELECT count(*) AS n, round(avg(n), 7) AS mean, round(stddev_samp(n), 7) AS std, min(n) AS least, quantile_cont(n, 0.25) AS q25, quantile_cont(n, 0.5) AS q50, quantile_cont(n, 0.75) AS q75, max(n) AS greatest FROM c")
def n6_purchases_describe(spark, sf_dir):
    return _rounded(legacy.describe(purchases(spark, sf_dir).groupBy("customer_id").agg(F.count("*").alias("n")), "n"))


@query("n6_monthly_counts", f"WITH e AS ({PURCHASES}), c AS (SELECT (year(make_timestamp(us)) * 12 + month(make_timestamp(us)) - 1)::BIGINT AS m, count(*) AS n FROM e GROUP BY 1), s AS (SELECT unnest(range((SELECT min(m) FROM c), (SELECT max(m) FROM c) + 1)) AS m) SELECT m // 12 AS year, m % 12 + 1 AS month, coalesce(n, 0) AS n FROM s LEFT JOIN c USING (m)")
def n6_monthly_counts(spark, sf_dir):
    return legacy.months(purchases(spark, sf_dir))


@query("n8_chosen_means", f"WITH {_LONG} SELECT chosen, round(avg(quantity), 7) AS quantity, round(avg(price), 5) AS price FROM l GROUP BY 1")
def n8_chosen_means(spark, sf_dir):
    return legacy.chosen_means(alternatives(spark, sf_dir), ["quantity", "price"]).select("chosen", F.round("quantity", 7).alias("quantity"), F.round("price", 5).alias("price"))


@query("n9_top_categories", f"WITH e AS ({PURCHASES}) SELECT category, count(*) AS n FROM e GROUP BY 1 ORDER BY n DESC, category LIMIT 20")
def n9_top_categories(spark, sf_dir):
    return legacy.top_categories(purchases(spark, sf_dir))


@query("m18_pareto_front", "SELECT p_partkey FROM part a WHERE NOT EXISTS (SELECT 1 FROM part b WHERE b.p_retailprice <= a.p_retailprice AND b.p_size >= a.p_size AND (b.p_retailprice < a.p_retailprice OR b.p_size > a.p_size))")
def m18_pareto_front(spark, sf_dir):
    return legacy.pareto(table(spark, sf_dir, "part"), "p_retailprice", "p_size").select("p_partkey")
