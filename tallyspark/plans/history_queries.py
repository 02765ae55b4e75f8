"""History features, splits and catalogue statistics, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import catalog, history, split
from ..sources.binding import CLICKS, DAY_US, PURCHASES, clicks, purchases
from .registry import query

SPLIT_SQL = """s0 AS (SELECT *, count(*) OVER (PARTITION BY customer_id) AS n, row_number() OVER (PARTITION BY customer_id ORDER BY us, seq) AS rn FROM e),
s1 AS (SELECT *, greatest(1, floor(n * 0.1::DOUBLE)) AS t0 FROM s0),
s2 AS (SELECT *, CASE WHEN t0 + t0 >= n THEN 0 ELSE t0 END AS v, CASE WHEN t0 + t0 >= n THEN 1 ELSE t0 END AS t FROM s1),
s AS (SELECT * EXCLUDE (n, rn, t0, v, t), CASE WHEN rn <= n - t - v THEN 'train' WHEN rn <= n - t THEN 'val' ELSE 'test' END AS split FROM s2)"""


def _features(source: str) -> str:
    roll = lambda d: f"""(count(*) OVER (PARTITION BY customer_id, category ORDER BY us RANGE BETWEEN {d * DAY_US - 1} PRECEDING AND CURRENT ROW)
    - count(*) OVER (PARTITION BY customer_id, category, us ORDER BY seq DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::DOUBLE"""  # noqa: E731
    return f"""WITH e AS ({source})
SELECT customer_id, seq, row_number() OVER (PARTITION BY customer_id, asin ORDER BY us, seq) - 1 AS routine,
  (CASE WHEN row_number() OVER (PARTITION BY customer_id, asin ORDER BY us, seq) = 1 THEN 1 ELSE 0 END)::BIGINT AS novelty,
  coalesce(floor((us - lag(us) OVER (PARTITION BY customer_id, asin ORDER BY us, seq)) / {DAY_US}::DOUBLE), 999.0)::DOUBLE AS recency_days,
  row_number() OVER (PARTITION BY customer_id, category ORDER BY us, seq) - 1 AS cat_affinity,
  {roll(7)} AS cat_count_7d, {roll(30)} AS cat_count_30d FROM e"""


def _shown(df):
    return df.select("customer_id", "seq", "routine", F.col("novelty").cast("long").alias("novelty"), "recency_days", "cat_affinity", "cat_count_7d", "cat_count_30d")


@query("w_state_features", _features(CLICKS))
def w_state_features(spark, sf_dir):
    return _shown(history.state_features(clicks(spark, sf_dir)))


@query("w_state_features_ties", _features(PURCHASES))
def w_state_features_ties(spark, sf_dir):
    return _shown(history.state_features(purchases(spark, sf_dir)))


@query("w7_temporal_split", f"WITH e AS ({CLICKS}), {SPLIT_SQL} SELECT customer_id, seq, split FROM s")
def w7_temporal_split(spark, sf_dir):
    return split.temporal_split(clicks(spark, sf_dir)).select("customer_id", "seq", "split")


@query("w7_temporal_split_ties", f"WITH e AS ({PURCHASES}), {SPLIT_SQL} SELECT customer_id, seq, split FROM s")
def w7_temporal_split_ties(spark, sf_dir):
    return split.temporal_split(purchases(spark, sf_dir)).select("customer_id", "seq", "split")


_RANKED = """ids AS (SELECT customer_id, row_number() OVER (ORDER BY md5('42:' || customer_id)) - 1 AS rank, count(*) OVER () AS total FROM (SELECT DISTINCT customer_id FROM e))"""


@query(
    "r4_cold_start_split",
    f"""WITH e AS ({PURCHASES}), {_RANKED},
k AS (SELECT *, CASE WHEN floor(total * 0.1::DOUBLE) = 0 AND total > 2 THEN 1 ELSE floor(total * 0.1::DOUBLE) END AS c FROM ids)
SELECT CASE WHEN rank < c THEN 'test' WHEN rank < c + c THEN 'val' ELSE 'train' END AS split, count(DISTINCT e.customer_id) AS customers, count(*) AS n
FROM e JOIN k USING (customer_id) GROUP BY 1""",
)
def r4_cold_start_split(spark, sf_dir):
    return split.cold_start_split(purchases(spark, sf_dir)).groupBy("split").agg(F.countDistinct("customer_id").alias("customers"), F.count("*").alias("n"))


@query(
    "w13_kfold_buckets",
    f"""WITH e AS ({PURCHASES}), {_RANKED}, z AS (SELECT *, total // 7 AS small, total % 7 AS extra FROM ids)
SELECT customer_id, (CASE WHEN rank < extra * (small + 1) THEN rank // (small + 1) ELSE extra + (rank - extra * (small + 1)) // small END)::BIGINT AS bucket FROM z""",
)
def w13_kfold_buckets(spark, sf_dir):
    return split.kfold_buckets(purchases(spark, sf_dir), 7)


@query(
    "r5_kfold_labels",
    f"""WITH e AS ({PURCHASES}), {_RANKED}, z AS (SELECT *, total // 5 AS small, total % 5 AS extra FROM ids),
b AS (SELECT customer_id, CASE WHEN rank < extra * (small + 1) THEN rank // (small + 1) ELSE extra + (rank - extra * (small + 1)) // small END AS bucket FROM z),
f AS (SELECT fold, customer_id, bucket, md5('42:' || fold || ':' || customer_id) AS key FROM b, range(5) AS r(fold)),
v AS (SELECT fold, customer_id, key, min(key) OVER (PARTITION BY fold) AS least, ('0x' || substr(key, 1, 8))::BIGINT / 4294967296.0::DOUBLE AS share FROM f WHERE bucket <> fold)
SELECT fold::BIGINT AS fold, customer_id, CASE WHEN share < 0.1::DOUBLE OR key = least THEN 'val' ELSE 'train' END AS split FROM v
UNION ALL SELECT fold::BIGINT, customer_id, 'test' FROM f WHERE bucket = fold""",
)
def r5_kfold_labels(spark, sf_dir):
    return split.kfold(purchases(spark, sf_dir), 5).select(F.col("fold").cast("long").alias("fold"), "customer_id", "split")


def _split(spark, sf_dir, source=purchases):
    return split.temporal_split(source(spark, sf_dir))


_S = f"WITH e AS ({PURCHASES}), {SPLIT_SQL}"


@query("a1_j2_train_popularity", f"{_S}, p AS (SELECT asin, count(*) AS popularity FROM s WHERE split = 'train' GROUP BY 1) SELECT customer_id, seq, asin, coalesce(popularity, 0) AS popularity FROM s LEFT JOIN p USING (asin)")
def a1_j2_train_popularity(spark, sf_dir):
    return catalog.attach_popularity(_split(spark, sf_dir)).select("customer_id", "seq", "asin", "popularity")


_STOP = ", ".join(f"'{w}'" for w in catalog.NO_BRAND)
_STRIP = r"""regexp_replace(regexp_replace(lower(t), '^[,.:;!?()\[\]{}"'']+', ''), '[,.:;!?()\[\]{}"'']+$', '')"""
_TOKEN = f"""coalesce([w for w in [{_STRIP} for t in regexp_split_to_array(coalesce(title, ''), '\\s+')]
  if w <> '' AND w NOT IN ({_STOP}) AND NOT regexp_full_match(w, '[0-9.\\-x/]+') AND NOT regexp_full_match(w, '[0-9]+[a-z]{{1,3}}')][1], '')"""


@query("f1_brand_token", f"SELECT p_partkey, {_TOKEN.replace('title', 'p_name')} AS brand FROM part")
def f1_brand_token(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", catalog.brand_token(F.col("p_name")).alias("brand"))


def _mode(value: str, rows: str) -> str:
    return f"""c AS (SELECT asin, {value}, count(*) AS n, min(lpad(us::VARCHAR, 20, '0') || seq) AS first FROM {rows} GROUP BY 1, 2),
m AS (SELECT asin, {value} FROM c QUALIFY row_number() OVER (PARTITION BY asin ORDER BY n DESC, first) = 1)"""


@query("a2_j3_brand", f"{_S}, b AS (SELECT *, {_TOKEN} AS brand FROM s WHERE split = 'train'), b1 AS (SELECT * FROM b WHERE brand <> ''), {_mode('brand', 'b1')} SELECT customer_id, seq, coalesce(brand, '') AS brand FROM s LEFT JOIN m USING (asin)")
def a2_j3_brand(spark, sf_dir):
    return catalog.attach_brand(_split(spark, sf_dir)).select("customer_id", "seq", "brand")


@query("a3_dominant_category", f"WITH e AS ({CLICKS}), {SPLIT_SQL}, t AS (SELECT * FROM s WHERE split = 'train'), {_mode('category', 't')} SELECT asin, category FROM m")
def a3_dominant_category(spark, sf_dir):
    return catalog.dominant_category(_split(spark, sf_dir, clicks))


@query("a4_first_seen", f"{_S} SELECT asin, min(us) AS first_us FROM s WHERE split = 'train' GROUP BY 1")
def a4_first_seen(spark, sf_dir):
    return catalog.first_seen(_split(spark, sf_dir))


@query("a5_earliest_row", f"{_S} SELECT asin, customer_id, seq, category, quantity FROM s WHERE split = 'train' QUALIFY row_number() OVER (PARTITION BY asin ORDER BY us, seq) = 1")
def a5_earliest_row(spark, sf_dir):
    return catalog.earliest_rows(_split(spark, sf_dir), ["customer_id", "seq", "category", "quantity"])


_BAND = """p AS (SELECT asin, count(*) AS popularity FROM s WHERE split = 'train' GROUP BY 1),
q AS (SELECT quantile_cont(popularity, 0.5) AS q50, quantile_cont(popularity, 0.75) AS q75, quantile_cont(popularity, 0.95) AS q95 FROM p)"""


@query("a6_popularity_quantiles", f"{_S}, {_BAND} SELECT q50, q75, q95 FROM q")
def a6_popularity_quantiles(spark, sf_dir):
    return catalog.popularity_quantiles(_split(spark, sf_dir))


@query("f11_popularity_band", f"{_S}, {_BAND} SELECT asin, popularity, CASE WHEN popularity >= q95 THEN 'top 5%' WHEN popularity >= q75 THEN 'top 25%' WHEN popularity >= q50 THEN 'top 50%' ELSE 'bottom 50%' END AS band FROM p, q")
def f11_popularity_band(spark, sf_dir):
    s = _split(spark, sf_dir)
    q = catalog.popularity_quantiles(s)  # one row
    return catalog.popularity(s).crossJoin(F.broadcast(q)).select("asin", "popularity", catalog.band(F.col("popularity"), F.col("q50"), F.col("q75"), F.col("q95")).alias("band"))


@query("j6_pool_size", f"{_S}, f AS (SELECT asin, min(us) AS first_us FROM s WHERE split = 'train' GROUP BY 1), d AS (SELECT DISTINCT us FROM s), c AS (SELECT us, (SELECT count(*) FROM f WHERE first_us < d.us) AS pool FROM d) SELECT customer_id, seq, pool FROM s JOIN c USING (us)")
def j6_pool_size(spark, sf_dir):
    return catalog.pool_sizes(_split(spark, sf_dir)).select("customer_id", "seq", "pool")


@query(
    "j7_recent_history",
    f"""WITH e AS ({PURCHASES}), w AS (SELECT customer_id, seq, list({{'us': us, 'seq': seq, 'title': title}}) OVER (PARTITION BY customer_id ORDER BY us RANGE BETWEEN {30 * DAY_US} PRECEDING AND 1 PRECEDING) AS l FROM e)
SELECT customer_id, seq, coalesce(array_to_string([x.title for x in list_sort(l)[greatest(len(l) - 4, 1):]], ', '), '') AS recent, CASE WHEN l IS NULL THEN 0 ELSE least(len(l), 5) END AS n FROM w""",
)
def j7_recent_history(spark, sf_dir):
    got = history.recent_titles(purchases(spark, sf_dir))
    return got.select("customer_id", "seq", F.array_join("recent", ", ").alias("recent"), F.size("recent").cast("long").alias("n"))


@query(
    "j8_prior_examples",
    f"""{_S}, t AS (SELECT * FROM s WHERE split = 'train'), p AS (SELECT customer_id, us AS probe_us, seq AS probe_seq FROM s WHERE split = 'test'),
j AS (SELECT p.customer_id, probe_seq, t.seq, t.us FROM p JOIN t ON t.customer_id = p.customer_id AND t.us < p.probe_us),
r AS (SELECT *, row_number() OVER (PARTITION BY customer_id, probe_seq ORDER BY us DESC, seq DESC) AS k FROM j)
SELECT customer_id, probe_seq, k, seq FROM r WHERE k <= 3""",
)
def j8_prior_examples(spark, sf_dir):
    s = _split(spark, sf_dir)
    probes = s.filter("split = 'test'").select("customer_id", F.col("us").alias("probe_us"), F.xxhash64("customer_id", "seq").alias("probe_id"), F.col("seq").alias("probe_seq"))
    got = history.latest_before(s.filter("split = 'train'"), probes, 3)
    long = got.join(probes.select("probe_id", "probe_seq"), "probe_id").select("customer_id", "probe_seq", F.posexplode("examples").alias("k", "row"))
    return long.select("customer_id", "probe_seq", (F.col("k") + 1).cast("long").alias("k"), F.col("row.seq").alias("seq"))


@query("p9_n7_min_events", f"WITH e AS ({CLICKS}) SELECT customer_id, seq FROM e QUALIFY count(*) OVER (PARTITION BY customer_id) >= 60")
def p9_min_events(spark, sf_dir):
    return history.min_events(clicks(spark, sf_dir), 60).select("customer_id", "seq")


@query(
    "split_category_summary",
    f"""WITH e AS ({CLICKS}), {SPLIT_SQL}, p AS (SELECT asin, count(*) AS popularity FROM s WHERE split = 'train' GROUP BY 1),
h AS (SELECT *, row_number() OVER (PARTITION BY customer_id, asin ORDER BY us, seq) - 1 AS routine FROM s)
SELECT split, category, count(*) AS n, round(avg(CASE WHEN routine > 0 THEN 1.0 ELSE 0.0 END), 6) AS repeat_rate, round(avg(coalesce(popularity, 0)), 6) AS mean_popularity FROM h LEFT JOIN p USING (asin) GROUP BY 1, 2""",
)
def split_category_summary(spark, sf_dir):
    h = catalog.attach_popularity(history.state_features(_split(spark, sf_dir, clicks)))
    return h.groupBy("split", "category").agg(
        F.count("*").alias("n"), F.round(F.avg((F.col("routine") > 0).cast("double")), 6).alias("repeat_rate"), F.round(F.avg("popularity"), 6).alias("mean_popularity")
    )
