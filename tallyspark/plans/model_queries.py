"""Caches, outcomes, regularisers, choice sets, models and sources, with their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import prompts, text
from ..operators import catalog, choice, generation, history, legacy, models, outcomes, persons, split, validate
from ..sources import store
from ..sources.binding import CLICKS, PURCHASES, clicks, purchases, table
from ..sources.binding import persons as survey
from ..sources.shared import stored
from .eval_queries import _EVENTS, _LONG, _RESULTS, _rounded, alternatives, planted, results
from .history_queries import SPLIT_SQL
from .registry import query

#: Models train on events before the first day of 1997 and score later ones.
CUT_US = 852_076_800_000_000
_S = f"WITH e AS ({PURCHASES}), {SPLIT_SQL}"


def _cache(spark, sf_dir):
    p = table(spark, sf_dir, "part").filter("p_size > 15")
    put = F.explode(F.array(F.struct(F.lit(1).alias("t"), F.lit("old").alias("v")), F.struct(F.lit(2).alias("t"), F.lit("new").alias("v"))))
    rows = p.withColumn("x", put).filter("x.t = 1 or p_partkey % 2 = 0")
    return rows.select(text.cache_key(F.col("p_name"), F.col("p_partkey").cast("string")).alias("key"), store.as_payload(outcomes=F.array("p_name", "x.v")).alias("value"), F.col("x.t").cast("double").alias("created_at"))


_CACHE = """ca AS (SELECT sha256(p_name || chr(0) || p_partkey::VARCHAR) AS key, '{"outcomes":["' || p_name || '","' || CASE WHEN p_partkey % 2 = 0 THEN 'new' ELSE 'old' END || '"]}' AS value FROM part WHERE p_size > 15),
wa AS (SELECT p_partkey, sha256(p_name || chr(0) || p_partkey::VARCHAR) AS key FROM part)"""


@query("s5_s6_cache_hits", f"WITH {_CACHE} SELECT p_partkey, value FROM wa JOIN ca USING (key)")
def s5_cache_hits(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select("p_partkey", text.cache_key(F.col("p_name"), F.col("p_partkey").cast("string")).alias("key"))
    return store.lookup(wanted, _cache(spark, sf_dir))[0].select("p_partkey", "value")


@query("j10_cache_misses", f"WITH {_CACHE} SELECT DISTINCT key FROM wa WHERE key NOT IN (SELECT key FROM ca)")
def j10_cache_misses(spark, sf_dir):
    wanted = table(spark, sf_dir, "part").select("p_partkey", text.cache_key(F.col("p_name"), F.col("p_partkey").cast("string")).alias("key"))
    return store.lookup(wanted, _cache(spark, sf_dir))[1]


@query("s7_embedding_cache_valid", "SELECT vec_id::VARCHAR AS key, vec_id % 3 <> 0 AND vec_id % 5 <> 0 AS ok FROM embeddings")
def s7_embedding_cache_valid(spark, sf_dir):
    """A third of the vectors lacks a number, a fifth has a hole."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 3 == 0, F.slice("embedding", 1, 63)).when(F.col("vec_id") % 5 == 0, F.concat(F.slice("embedding", 1, 63), F.array(F.lit(None).cast("float")))).otherwise(F.col("embedding")).alias("value"))
    return v.select(F.col("vec_id").cast("string").alias("key"), F.coalesce(store.vectors_valid(64), F.lit(False)).alias("ok"))


@query("s7_embedding_cache_lookup", "SELECT vec_id::VARCHAR AS key, vec_id % 2 = 0 AS hit, CASE WHEN vec_id % 2 = 0 THEN round(embedding[1]::DOUBLE * CASE WHEN vec_id % 4 = 0 THEN 2 ELSE 1 END, 6) END AS first FROM embeddings")
def s7_embedding_cache_lookup(spark, sf_dir):
    """Half of the vectors are put, half of these once more with other values; the last put is found."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("vec_id").cast("string").alias("key"), F.transform("embedding", lambda x: x.cast("double")).alias("value"))
    row = lambda rows, at: rows.select("key", "value", F.lit(at).alias("created_at"))
    cache = store.vectors_put(row(v.filter("vec_id % 2 = 0"), 1.0), row(v.filter("vec_id % 4 = 0").withColumn("value", F.transform("value", lambda x: x * 2)), 2.0), 64)
    hits, lost = store.vectors_get(v.select("key"), cache, 64)
    return hits.select("key", F.lit(True).alias("hit"), F.round(F.col("value")[0], 6).alias("first")).union(lost.select("key", F.lit(False), F.lit(None).cast("double")))


@query("f24_stub_encoder")
def f24_stub_encoder(spark, sf_dir):
    got = outcomes.encode(table(spark, sf_dir, "part").select(F.col("p_name").alias("text")), lambda t: outcomes.stub_vector(t, 32))
    return got.select("text", F.round(outcomes.dot(F.col("e"), F.col("e")), 4).alias("norm"))


@query("f23_hash_embedder")
def f23_hash_embedder(spark, sf_dir):
    got = outcomes.encode(table(spark, sf_dir, "part").select(F.col("p_name").alias("text")), outcomes.hash_vector)
    return got.select("text", F.round(outcomes.dot(F.col("e"), F.col("e")), 4).alias("norm"))


_DOT = "list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query("f25_pairwise_cosine", f"SELECT (a.vec_id // 5) AS bucket, a.vec_id AS i, b.vec_id AS j, round({_DOT}, 6) AS cosine FROM embeddings a JOIN embeddings b ON a.vec_id // 5 = b.vec_id // 5 AND a.vec_id < b.vec_id WHERE {_DOT} > 0.1")
def f25_pairwise_cosine(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).alias("b"), F.col("embedding").alias("e"))
    got = outcomes.close_pairs(v, "vec_id", "b", 0.1)
    return got.withColumn("cosine", F.round("cosine", 6))


@query("f25_first_close_pair", f"SELECT bucket, i, j FROM (SELECT (a.vec_id // 5) AS bucket, a.vec_id AS i, b.vec_id AS j FROM embeddings a JOIN embeddings b ON a.vec_id // 5 = b.vec_id // 5 AND a.vec_id < b.vec_id WHERE {_DOT} > 0.1) QUALIFY row_number() OVER (PARTITION BY bucket ORDER BY i, j) = 1")
def f25_first_close_pair(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 5).alias("b"), F.col("embedding").alias("e"))
    return outcomes.first_close(v, "vec_id", "b", 0.1)


def _vectors(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings")
    return v.select(F.floor(F.col("vec_id") / 8).alias("event_id"), F.floor(F.col("vec_id") % 8 / 2).alias("alt_idx"), (F.col("vec_id") % 2).alias("k"), F.col("embedding").alias("e"))


_V = "v AS (SELECT vec_id // 8 AS event_id, vec_id % 8 // 2 AS alt_idx, vec_id % 2 AS k, embedding::DOUBLE[] AS e FROM embeddings)"


@query("m14_outcome_diversity", f"WITH {_V}, p AS (SELECT event_id, alt_idx, coalesce(max(CASE WHEN a.k < b.k THEN list_dot_product(a.e, b.e) END), 0) AS x FROM v a JOIN v b USING (event_id, alt_idx) GROUP BY 1, 2) SELECT round(avg(x), 7) AS diversity FROM p")
def m14_outcome_diversity(spark, sf_dir):
    return _rounded(outcomes.outcome_diversity(_vectors(spark, sf_dir)))


_ALG = f"""{_V}, at AS (SELECT event_id, alt_idx, k, m::BIGINT AS m, e[m] AS a, e[m + 8] AS w0 FROM v, range(1, 6) AS r(m)), wt AS (SELECT event_id, m, max(w0) AS w FROM at GROUP BY 1, 2),
sr AS (SELECT event_id, alt_idx, k, e[20] * 3 AS raw FROM v), s AS (SELECT *, exp(raw - max(raw) OVER w) / sum(exp(raw)) OVER w * exp(max(raw) OVER w) AS s FROM sr WINDOW w AS (PARTITION BY event_id, alt_idx))""".replace(" at AS", " atr AS").replace("FROM at ", "FROM atr ")


def _algebra(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    m = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("m")
    a = v.select("event_id", "alt_idx", "k", "e", m).select("event_id", "alt_idx", "k", "m", F.element_at("e", F.col("m")).cast("double").alias("a"), F.element_at("e", F.col("m") + 8).cast("double").alias("w0"))
    w = a.groupBy("event_id", "m").agg(F.max("w0").alias("w"))
    return a.drop("w0"), w, v.select("event_id", "alt_idx", "k", (F.element_at("e", 20).cast("double") * 3).alias("raw"))


@query("m11_utility_algebra", f"WITH {_ALG}, u AS (SELECT event_id, alt_idx, k, sum(w * a) AS u FROM atr JOIN wt USING (event_id, m) GROUP BY 1, 2, 3) SELECT event_id, alt_idx, round(sum(s * u) / 0.5, 7) AS logit FROM u JOIN s USING (event_id, alt_idx, k) GROUP BY 1, 2")
def m11_utility_algebra(spark, sf_dir):
    return _rounded(outcomes.utilities(*_algebra(spark, sf_dir), 0.5))


@query("m14_salience_entropy", f"WITH {_ALG}, h AS (SELECT event_id, alt_idx, -sum(s * ln(s + 1e-12)) AS h FROM s GROUP BY 1, 2) SELECT round(avg(h), 7) AS entropy FROM h")
def m14_salience_entropy(spark, sf_dir):
    raw = _algebra(spark, sf_dir)[2]
    return _rounded(outcomes.salience_entropy(raw.withColumn("s", outcomes.softmax("raw", "event_id", "alt_idx"))))


@query("m14_weight_penalty", f"WITH {_ALG}, x AS (SELECT event_id, sum(w * w) AS x FROM wt GROUP BY 1) SELECT round(avg(x), 7) AS weight_l2 FROM x")
def m14_weight_penalty(spark, sf_dir):
    return _rounded(outcomes.weight_penalty(_algebra(spark, sf_dir)[1]))


@query("m14_price_monotonicity", f"WITH {_LONG}, d AS (SELECT quantity - lag(quantity) OVER w AS dp, score - lag(score) OVER w AS du FROM l WINDOW w AS (PARTITION BY event_id ORDER BY quantity, alt_idx)) SELECT round(avg(greatest(du / dp, 0) ** 2), 7) AS penalty FROM d WHERE dp > 0")
def m14_price_monotonicity(spark, sf_dir):
    rows = alternatives(spark, sf_dir).withColumn("price", F.col("quantity"))
    return _rounded(outcomes.price_monotonicity(rows, "score"))


@query("r1_r3_choice_sets")
def r1_choice_sets(spark, sf_dir):
    return choice.choice_sets(split.temporal_split(clicks(spark, sf_dir)))


_CS = f"WITH e AS ({CLICKS}), {SPLIT_SQL}"


@query(
    "r1_choice_set_invariants",
    f"""{_CS}, f AS (SELECT asin, min(us) AS first_us FROM s WHERE split = 'train' GROUP BY 1), d AS (SELECT DISTINCT us FROM s), c AS (SELECT us, (SELECT count(*) FROM f WHERE first_us < d.us) AS pool FROM d),
p AS (SELECT s.*, pool - (first_us IS NOT NULL AND first_us < us)::INT AS others FROM s JOIN c USING (us) LEFT JOIN f USING (asin))
SELECT count(*) AS n, 0::BIGINT AS wrong_place, 0::BIGINT AS wrong_size, 0::BIGINT AS late, 0::BIGINT AS repeated, 0::BIGINT AS strange, count(*) FILTER (others < 9) AS few, count(*) FILTER (others < 9) AS few_flagged, count(*) FILTER (others = 0) AS alone FROM p""",
)
def r1_choice_set_invariants(spark, sf_dir):
    """Every set against the catalogue: negatives known before the event, from its category as far as it has any,
    distinct unless flagged; flagged wherever fewer than nine others were on offer."""
    s = split.temporal_split(clicks(spark, sf_dir))
    sets = choice.choice_sets(s)
    first = catalog.first_seen(s)
    own = s.select(F.concat_ws("|", "customer_id", "seq").alias("event_key"), "us", "category", F.col("asin").alias("own_asin"))
    pool = catalog.pool_sizes(s).join(first, "asin", "left").select(F.concat_ws("|", "customer_id", "seq").alias("event_key"), (F.col("pool") - F.coalesce((F.col("first_us") < F.col("us")).cast("int"), F.lit(0))).alias("others"))
    kind = catalog.dominant_category(s).withColumnRenamed("category", "item_category")
    long = sets.select("event_key", "chosen_asin", F.explode("choice_asins").alias("asin")).filter("asin <> chosen_asin").join(first, "asin", "left").join(kind, "asin", "left").join(own.drop("own_asin"), "event_key")
    per = long.groupBy("event_key").agg(
        F.count("*").alias("n"), F.countDistinct("asin").alias("kinds"), F.count_if(F.coalesce(F.col("first_us") >= F.col("us"), F.lit(True))).alias("late"), F.count_if(F.col("item_category") == F.col("category")).alias("same")
    )
    # Of the category at least one is there wherever the pool had any and the set could be filled.
    rows = sets.join(own, "event_key").join(pool, "event_key").join(per, "event_key", "left")
    at = F.element_at("choice_asins", F.col("chosen_idx") + 1)
    return rows.agg(
        F.count("*").alias("n"), F.count_if((at != F.col("own_asin")) | (F.col("chosen_asin") != F.col("own_asin"))).alias("wrong_place"), F.count_if(F.size("choice_asins") != 10).alias("wrong_size"), F.sum(F.coalesce("late", F.lit(0))).alias("late"),
        F.count_if(~F.col("dedup_fallback") & ((F.col("n") != 9) | (F.col("kinds") != 9))).alias("repeated"), F.count_if(~F.col("dedup_fallback") & (F.col("others") < 9)).alias("strange"),
        F.count_if(F.col("others") < 9).alias("few"), F.count_if((F.col("others") < 9) & F.col("dedup_fallback")).alias("few_flagged"), F.count_if((F.col("others") == 0) & F.col("n").isNull()).alias("alone"),
    )


@query("r1_sets_by_category", f"{_CS}, f AS (SELECT asin, min(us) AS first_us FROM s WHERE split = 'train' GROUP BY 1), g AS (SELECT asin, category, count(*) AS n, min({{'us': us, 'seq': seq}}) AS first FROM s WHERE split = 'train' GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY asin ORDER BY n DESC, first) = 1), o AS (SELECT s.customer_id || '|' || s.seq AS event_key, count(*) FILTER (f.first_us < s.us AND f.asin <> s.asin AND g.category = s.category) AS near FROM s, f JOIN g USING (asin) GROUP BY 1) SELECT event_key FROM o WHERE near > 0")
def r1_sets_by_category(spark, sf_dir):
    """Events with a negative of their own category: all that had any such item before them."""
    s = split.temporal_split(clicks(spark, sf_dir))
    kind = catalog.dominant_category(s).withColumnRenamed("category", "item_category")
    own = s.select(F.concat_ws("|", "customer_id", "seq").alias("event_key"), "category")
    long = choice.choice_sets(s).select("event_key", "chosen_asin", F.explode("choice_asins").alias("asin")).filter("asin <> chosen_asin").join(kind, "asin").join(own, "event_key")
    return long.filter("item_category = category").select("event_key").distinct()


_RECORD = f"""{_S}, f AS (SELECT asin, title AS t, category AS c, price AS p FROM s WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY asin ORDER BY us, seq) = 1), n AS (SELECT asin, count(*) AS popularity FROM s WHERE split = 'train' GROUP BY 1),
h AS (SELECT *, row_number() OVER (PARTITION BY customer_id, asin ORDER BY us, seq) - 1 AS routine FROM s), k AS (SELECT * FROM h WHERE split = 'test')"""


@query(
    "r1_p17_p19_choice_records",
    f"""{_RECORD} SELECT customer_id || '|' || k.seq AS event_key, customer_id, category, k.asin AS chosen_asin, routine::DOUBLE AS routine, coalesce(n.popularity, 0)::DOUBLE AS popularity, routine > 0 AS is_repeat, 'popularity score ' || coalesce(n.popularity, 0) || ',popularity score ' || coalesce(o.popularity, 0) AS ranks,
k.title || '|' || coalesce(f.t, '') AS titles, (routine > 0)::VARCHAR || ',false' AS repeats, 'About ' || customer_id AS c_d
FROM k LEFT JOIN n USING (asin) LEFT JOIN f ON f.asin = '7' LEFT JOIN n o ON o.asin = '7' WHERE customer_id NOT LIKE '%none%'""",
)
def r1_choice_records(spark, sf_dir):
    """Whole records of sets made of the chosen item and item 7; nobody's recent history is shown."""
    s = history.state_features(split.temporal_split(purchases(spark, sf_dir)))
    s = stored(s.select("customer_id", "us", "seq", "asin", "category", "title", "price", "state", "routine", "recency_days", "novelty", "cat_affinity", "split"), "record-events")
    s = s.withColumn("recent", F.expr("cast(array() as array<string>)"))
    sets = s.filter("split = 'test'").select(F.concat_ws("|", "customer_id", "seq").alias("event_key"), F.lit(0).alias("resample_k"), F.col("asin").alias("chosen_asin"), F.array("asin", F.lit("7")).alias("choice_asins"), F.lit(0).alias("chosen_idx"), F.lit(False).alias("dedup_fallback"))
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer_id"), F.array(F.lit(0.0)).alias("z"))
    got = choice.choice_records(sets, s, people, F.concat(F.lit("About "), F.col("customer_id")))
    joined = lambda f, by: F.array_join(F.transform("alt_texts", lambda a: a[f].cast("string")), by)
    return got.select(
        "event_key", "customer_id", "category", "chosen_asin", "chosen_features.routine", "chosen_features.popularity", "metadata.is_repeat",
        joined("popularity_rank", ",").alias("ranks"), joined("title", "|").alias("titles"), joined("is_repeat", ",").alias("repeats"), "c_d",
    )


@query("j9_uncovered_customers", f"WITH e AS ({PURCHASES}) SELECT DISTINCT customer_id FROM e WHERE customer_id NOT IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 0)")
def j9_uncovered_customers(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 0").select(F.col("c_custkey").cast("string").alias("customer_id"))
    return choice.uncovered(purchases(spark, sf_dir), known)


@query("j5_p17_p19_records", f"""{_S}, f AS (SELECT asin, title AS t, category AS c FROM s WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY asin ORDER BY us, seq) = 1),
k AS (SELECT customer_id || '|' || seq AS event_key, asin, title, category, state FROM s WHERE split = 'test')
SELECT event_key, 0::BIGINT AS alt_idx, asin, true AS chosen, title, category, state FROM k UNION ALL SELECT event_key, 1, '7', false, coalesce(t, ''), coalesce(c, 'Unknown'), '' FROM k LEFT JOIN f ON f.asin = '7'""")
def j5_records(spark, sf_dir):
    s = stored(split.temporal_split(purchases(spark, sf_dir)).select("customer_id", "us", "seq", "asin", "category", "title", "price", "state", "split"), "record-events")
    sets = s.filter("split = 'test'").select(F.concat_ws("|", "customer_id", "seq").alias("event_key"), F.lit(0).alias("resample_k"), F.lit(0).alias("chosen_idx"), F.array("asin", F.lit("7")).alias("choice_asins"))
    return choice.records(sets, s).select("event_key", F.col("alt_idx").cast("long").alias("alt_idx"), "asin", "chosen", "title", "category", "state")


_POP = f"""{_LONG}, tr AS (SELECT * FROM l WHERE us < {CUT_US}), c AS (SELECT asin, count(*) AS n FROM tr WHERE chosen GROUP BY 1)"""


@query("m1_popularity_scores", f"WITH {_POP} SELECT event_id, alt_idx, round(ln(coalesce(n, 0) + 1), 8) AS score FROM l LEFT JOIN c USING (asin) WHERE us >= {CUT_US}")
def m1_popularity_scores(spark, sf_dir):
    a = alternatives(spark, sf_dir).drop("score")
    return models.Popularity().fit(a.filter(F.col("us") < CUT_US)).score(a.filter(F.col("us") >= CUT_US)).select("event_id", "alt_idx", F.round("score", 8).alias("score"))


@query("m1_category_position_scores", f"WITH {_LONG}, c AS (SELECT category, alt_idx, count(*) AS n FROM l WHERE chosen AND us < {CUT_US} GROUP BY 1, 2) SELECT event_id, alt_idx, round(ln(coalesce(n, 0) + 0.5), 8) AS score FROM l LEFT JOIN c USING (category, alt_idx) WHERE us >= {CUT_US}")
def m1_category_position_scores(spark, sf_dir):
    a = alternatives(spark, sf_dir).drop("score")
    m = models.Popularity(0.5, ("category", "alt_idx")).fit(a.filter(F.col("us") < CUT_US))
    return m.score(a.filter(F.col("us") >= CUT_US)).select("event_id", "alt_idx", F.round("score", 8).alias("score"))




@query("m2_sparse_logit")
def m2_sparse_logit(spark, sf_dir):
    a = planted(spark, sf_dir)
    m = models.SparseLogit(["quantity", "log_price", "position"]).fit(a.filter(F.col("us") < CUT_US), a.filter(F.col("us") >= CUT_US))
    return m.score(a).select("event_id", "alt_idx", "score")


@query("m3_random_forest")
def m3_random_forest(spark, sf_dir):
    a = planted(spark, sf_dir)
    m = models.Classifier(["quantity", "log_price", "position"]).fit(a.filter(F.col("us") < CUT_US))
    return m.score(a.filter(F.col("us") >= CUT_US)).select("event_id", "alt_idx", "score")


@query("m11_forward_pass")
def m11_forward_pass(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").withColumn("event_id", F.floor(F.col("vec_id") / 6))
    e = v.groupBy("event_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("vec_id", "embedding"))), lambda x: x["embedding"])).alias("e"), F.count("*").alias("n")).filter("n = 6")
    return models.UtilityNet().init().score(e.withColumn("z", F.transform(F.sequence(F.lit(1), F.lit(26)), lambda i: i / 26.0)))


@query("r6_random_subsample", f"WITH e AS ({PURCHASES}), c AS (SELECT DISTINCT customer_id FROM e) SELECT customer_id, 1.0::DOUBLE AS weight FROM c ORDER BY md5('42|' || customer_id), customer_id LIMIT 100")
def r6_random_subsample(spark, sf_dir):
    return models.random_subsample(purchases(spark, sf_dir), 100)


@query("r7_leverage_subsample")
def r7_leverage_subsample(spark, sf_dir):
    return models.leverage_subsample(history.state_features(clicks(spark, sf_dir)), 40, components=3)


@query(
    "a10_customer_profile",
    f"""WITH e AS ({CLICKS}), r AS (SELECT *, row_number() OVER (PARTITION BY customer_id, asin ORDER BY us, seq) - 1 AS routine, coalesce(floor((us - lag(us) OVER (PARTITION BY customer_id, asin ORDER BY us, seq)) / 86400000000.0::DOUBLE), 999.0) AS rec FROM e),
n AS (SELECT customer_id, category, count(*) / sum(count(*)) OVER (PARTITION BY customer_id)::DOUBLE AS p FROM e GROUP BY 1, 2), h AS (SELECT customer_id, -sum(p * ln(p)) AS h, max(p) AS top, count(*) AS kinds FROM n GROUP BY 1)
SELECT customer_id, round(avg((routine > 0)::INT), 7) AS repeat_rate, round(avg(1 / (1 + rec)), 7) AS mean_recency, round(avg((routine = 0)::INT), 7) AS novelty_rate, round(ln(1 + count(*)), 7) AS purchase_freq, round(any_value(h), 7) AS cat_entropy, round(any_value(top), 7) AS top_share, any_value(kinds) AS kinds FROM r JOIN h USING (customer_id) GROUP BY 1""",
)
def a10_customer_profile(spark, sf_dir):
    p = models.profiles(history.state_features(clicks(spark, sf_dir)))
    return _rounded(p.select("customer_id", *models.SCALARS, F.array_max(F.map_values("shares")).alias("top_share"), F.size("shares").cast("long").alias("kinds")))


@query("a11_standardised", "SELECT c_custkey, round((c_acctbal - (SELECT avg(c_acctbal) FROM customer)) / (SELECT stddev_pop(c_acctbal) FROM customer), 7) AS c_acctbal FROM customer")
def a11_standardised(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    return models.standardised(c, ["c_acctbal"]).select("c_custkey", F.round("c_acctbal", 7).alias("c_acctbal"))


@query("a21_weight_summary", "SELECT min(c_acctbal) AS least, quantile_cont(c_acctbal, 0.5) AS median, max(c_acctbal) AS greatest, round(avg(c_acctbal), 6) AS mean, round(stddev_pop(c_acctbal), 6) AS std FROM customer")
def a21_weight_summary(spark, sf_dir):
    got = _rounded(legacy.weight_summary(table(spark, sf_dir, "customer"), "c_acctbal"))
    return got.select("least", "median", "greatest", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"))


@query("a24_n1_worst_categories", f"WITH {_EVENTS} SELECT category, count(*) AS n, round(avg((above < 1)::INT), 7) AS top1, round(avg(1.0::DOUBLE / (1 + above)), 7) AS mrr FROM pe GROUP BY 1 ORDER BY top1, category LIMIT 3")
def a24_worst_categories(spark, sf_dir):
    from .eval_queries import scored

    return _rounded(legacy.worst_categories(scored(spark, sf_dir)))


@query("p10_orphan_semi_join", f"WITH e AS ({PURCHASES}) SELECT customer_id, seq FROM e WHERE customer_id IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_acctbal > 3000)")
def p10_orphan_semi_join(spark, sf_dir):
    known = table(spark, sf_dir, "customer").filter("c_acctbal > 3000").select(F.col("c_custkey").cast("string").alias("customer_id"))
    return choice.with_persons(purchases(spark, sf_dir), known).select("customer_id", "seq")


@query("p11_cascade_filter", f"WITH e AS ({PURCHASES}) SELECT customer_id, seq FROM e WHERE customer_id IN (SELECT c_custkey::VARCHAR FROM customer WHERE c_mktsegment NOT IN ('MACHINERY'))")
def p11_cascade_filter(spark, sf_dir):
    """Events of the customers who are left after translation dropped those with an unknown label."""
    left = persons.translate(survey(spark, sf_dir), [persons.Field("segment", "passthrough", "Q-segment", drop=("MACHINERY",))], "Respondent ID")
    return choice.with_persons(purchases(spark, sf_dir), left).select("customer_id", "seq")


@query("p12_selected_or_untrained", f"{_S}, t AS (SELECT DISTINCT customer_id FROM s WHERE split = 'train') SELECT customer_id, count(*) AS n FROM s WHERE customer_id NOT IN (FROM t) OR customer_id LIKE '%1%' GROUP BY 1")
def p12_selected_or_untrained(spark, sf_dir):
    s = split.temporal_split(purchases(spark, sf_dir))
    chosen = s.filter("split = 'train'").select("customer_id").distinct().filter(F.col("customer_id").contains("1"))
    return choice.selected_or_untrained(s, chosen).groupBy("customer_id").agg(F.count("*").alias("n"))


SCHEMA = """
name: star
events:
  column_map: {missing_name: name, p_name: name, p_retailprice: price, p_size: size, p_type: category, p_brand: brand_number}
  dropna_subset: [name]
  dtype_coerce: {price: float, size: int, brand_number: int}
  category_null_fill: Unknown
"""


@query("p1_p5_clean", "SELECT p_name AS name, p_retailprice AS price, p_size::BIGINT AS size, coalesce(nullif(p_type, 'PROMO'), 'Unknown') AS category FROM part WHERE p_partkey % 7 <> 0")
def p1_clean(spark, sf_dir):
    raw = table(spark, sf_dir, "part").withColumns({"p_name": F.when(F.col("p_partkey") % 7 != 0, F.col("p_name")), "p_type": F.nullif("p_type", F.lit("PROMO"))})
    out = store.clean(raw, store.Schema(SCHEMA))
    return out.select("name", "price", F.col("size").cast("long").alias("size"), "category")


@query("v7_v9_violation_counts", f"WITH e AS ({PURCHASES}) SELECT count(*) FILTER (quantity < 25) AS low, count(*) FILTER (state NOT IN ('FRANCE', 'CHINA')) AS elsewhere, 0::BIGINT AS nulls FROM e")
def v7_violation_counts(spark, sf_dir):
    """Counts of broken checks over rows that pass those of their stages, which raise otherwise."""
    e = purchases(spark, sf_dir)
    validate.cleaned(e)
    rows = history.state_features(e)
    validate.state_features(rows)
    got = validate.counts(rows.withColumn("over", F.col("quantity") - 25), [validate.not_negative("over"), validate.within("state", ["FRANCE", "CHINA"]), validate.not_null("seq")])
    return got.toDF("low", "elsewhere", "nulls")


_BOARD = f"""{_RESULTS}, b AS (SELECT model, round(avg(nll), 4) AS nll, '[\"' || string_agg(DISTINCT seed, '\",\"' ORDER BY seed) || '\"]' AS seeds, count(DISTINCT seed) AS n FROM res WHERE status = 'ok' GROUP BY 1)"""


def _board(spark, sf_dir):
    done = results(spark, sf_dir).filter("status = 'ok'")
    return done.groupBy("model").agg(F.round(F.avg("nll"), 4).alias("nll"), F.array_sort(F.collect_set("seed")).alias("seeds"))


@query("s10_leaderboard_text", f"WITH {_BOARD} SELECT rpad(model, 14, ' ') || rpad(n::VARCHAR, 14, ' ') AS line FROM b")
def s10_leaderboard_text(spark, sf_dir):
    return store.leaderboard_text(_board(spark, sf_dir).withColumn("n", F.size("seeds")), ["model", "n"], 14)


@query("s10_leaderboard_rows", f"WITH {_BOARD} SELECT model, nll, seeds FROM b")
def s10_leaderboard_rows(spark, sf_dir):
    return store.leaderboard_rows(_board(spark, sf_dir))


@query("s11_event_sidecar", f"{_S} SELECT customer_id, seq, row_number() OVER (PARTITION BY customer_id ORDER BY us, seq) - 1 AS event_idx FROM s WHERE split = 'test'")
def s11_event_sidecar(spark, sf_dir):
    return choice.sidecar(split.temporal_split(purchases(spark, sf_dir))).select("customer_id", "seq", "event_idx")


@query("f17_f18_alternatives_block", f"WITH {_LONG} SELECT event_id, string_agg('ABCDEFGHIJ'[alt_idx + 1] || ') ' || title || ' | n/a', chr(10) ORDER BY alt_idx) AS block FROM l GROUP BY 1")
def f18_alternatives_block(spark, sf_dir):
    a = alternatives(spark, sf_dir).groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("alt_idx", "title"))), lambda x: F.struct(x["title"].alias("title"), F.lit(None).cast("double").alias("price"))).alias("alts"))
    return a.select("event_id", F.replace(text.alternatives_block(F.col("alts")), F.lit("$n/a"), F.lit("n/a")).alias("block"))


@query("f19_rotations", "SELECT n_nationkey::BIGINT AS n, array_to_string(list_concat(l[(n_nationkey % 4) + 1:], l[:n_nationkey % 4]), '') AS r FROM (SELECT n_nationkey, ['A', 'B', 'C', 'D'] AS l FROM nation)")
def f19_rotations(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"), F.array_join(text.rotations(F.array(*map(F.lit, "ABCD")), F.col("n_nationkey")), "").alias("r"))


@query("o8_token_budget", f"WITH e AS ({PURCHASES}), t AS (SELECT *, sum(ceil(length(title) / 4.0::DOUBLE)) OVER (PARTITION BY customer_id ORDER BY us DESC, seq DESC ROWS UNBOUNDED PRECEDING) AS used FROM e) SELECT customer_id, count(*) AS kept FROM t WHERE used <= 30 GROUP BY 1")
def o8_token_budget(spark, sf_dir):
    return legacy.newest_within(purchases(spark, sf_dir), 30).groupBy("customer_id").agg(F.count("*").alias("kept"))


@query("n10_grid_marginals", "SELECT l_linenumber::BIGINT AS value, round(avg(l_discount), 7) AS mean FROM lineitem GROUP BY 1")
def n10_grid_marginals(spark, sf_dir):
    got = legacy.grid_marginals(table(spark, sf_dir, "lineitem"), ["l_linenumber"], "l_discount")
    return got.select(F.col("value").cast("long").alias("value"), F.round("mean", 7).alias("mean"))


@query("n11_rejection_pattern", "WITH p AS (SELECT p_brand AS term, p_size % 2 = 0 AS accepted FROM part), r AS (SELECT term, count(*) AS n FROM p WHERE NOT accepted GROUP BY 1) SELECT term, n, round(n / (SELECT count(*) FROM p WHERE NOT accepted)::DOUBLE, 7) AS share FROM r WHERE n >= 3")
def n11_rejection_pattern(spark, sf_dir):
    tried = table(spark, sf_dir, "part").select(F.col("p_brand").alias("term"), (F.col("p_size") % 2 == 0).alias("accepted"))
    return _rounded(legacy.rejections(tried))


@query("f17_generator_prompt", f"""WITH {_LONG} SELECT event_id, alt_idx, 'Person:' || chr(10) || 'Lives in ' || state || '.' || chr(10) || chr(10) || 'Alternative:' || chr(10) || '- Name: ' || title || chr(10) || '- Category: ' || category || chr(10) || '- Price: $' || quantity::BIGINT || chr(10) || '- Popularity: score ' || alt_idx || chr(10) || '- state: ' || state || chr(10) || '- note: new' || chr(10) || chr(10) || 'Sentences wanted: 3' AS prompt FROM l""")
def f17_generator_prompt(spark, sf_dir):
    alt = F.struct("title", "category", F.col("quantity").cast("long").alias("price"), F.concat(F.lit("score "), F.col("alt_idx").cast("string")).alias("popularity_rank"), "state")
    rows = alternatives(spark, sf_dir).withColumn("alt", alt)
    prompt = prompts.user(F.concat(F.lit("Lives in "), "state", F.lit(".")), F.col("alt"), 3, rows.schema["alt"].dataType.names, {"note": F.lit("new")})
    return rows.select("event_id", "alt_idx", prompt.alias("prompt"))


@query("r1_generated_outcomes", f"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'kept a,kept b' WHEN p_partkey % 2 = 0 THEN 'one 7,two 7' ELSE 'one 8,two 8' END AS outcomes, (p_partkey % 3 <> 0) AS asked, CASE WHEN p_partkey % 3 = 0 THEN 1 WHEN p_partkey % 2 = 0 THEN 7 ELSE 8 END::BIGINT AS seed,
  'v1-K2-stub_x-cd' || substr(sha256('Person ' || p_partkey), 1, 16) AS version FROM part""")
def r1_generated_outcomes(spark, sf_dir):
    """A third of the items is in the cache; of the rest, odd ones get one line at first and are asked again."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.lit("c").alias("customer_id"), F.col("p_partkey").cast("string").alias("asin"), F.concat(F.lit("Person "), F.col("p_partkey").cast("string")).alias("c_d"), F.struct(F.col("p_name").alias("title"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"), F.lit("x").alias("popularity_rank")).alias("alt"))
    tag = generation.version(F.col("c_d"), 2, "Stub/X")
    old = part.filter("p_partkey % 3 = 0").select(
        text.cache_key(F.col("customer_id"), F.col("asin"), F.lit("7"), tag).alias("key"),
        store.as_payload(outcomes=F.array(F.lit("kept a"), F.lit("kept b")), metadata=F.struct(F.lit(1).alias("seed"), tag.alias("cache_prompt_version"))).alias("value"), F.lit(0.0).alias("created_at"),
    )
    # An odd item's price ends its prompt's line; the stand-in tells odd items by their context.
    odd = lambda prompt: F.regexp_extract(prompt, r"Person (\d+)", 1).cast("long") % 2 == 1
    ask = lambda prompt, seed: F.when(odd(prompt) & (seed == 7), F.lit("only one")).otherwise(F.concat(F.lit("one "), seed.cast("string"), F.lit("\n\n two "), seed.cast("string"), F.lit("\nthree")))
    answers, fresh = generation.generate(part, old, ask, "Stub/X", k=2, seed=7)
    got = answers.select("p_partkey", F.array_join("outcomes", ",").alias("outcomes"), F.col("metadata.seed").alias("seed"), F.col("metadata.cache_prompt_version").alias("version"))
    keyed = part.select("p_partkey", text.cache_key(F.col("customer_id"), F.col("asin"), F.lit("7"), tag).alias("key"))
    return got.join(keyed, "p_partkey").join(fresh.select("key", F.lit(True).alias("asked")), "key", "left").select("p_partkey", "outcomes", F.coalesce("asked", F.lit(False)).alias("asked"), "seed", "version")


@query("n6_price_histogram", f"WITH e AS ({PURCHASES}), b AS (SELECT least(greatest(floor(price / (4000 / 50.0::DOUBLE)), 0), 49)::BIGINT AS bin FROM e) SELECT bin, bin * (4000 / 50.0::DOUBLE) AS low, count(*) AS n FROM b GROUP BY 1")
def n6_price_histogram(spark, sf_dir):
    return legacy.price_histogram(purchases(spark, sf_dir), most=4000.0)


@query("x_stream_windowed_popularity", "SELECT epoch_us(date_trunc('day', ts)) AS day_us, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def x_stream_windowed_popularity(spark, sf_dir):
    from ..sources.binding import wall_us
    from ..streaming.popularity import windowed_popularity

    got = windowed_popularity(table(spark, sf_dir, "events"), "ts", "event_type")
    return got.select(wall_us(F.col("window_start")).alias("day_us"), "event_type", "n")



