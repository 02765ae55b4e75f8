"""SQL for DuckDB of the queries that SQL can express on whole tables."""

from __future__ import annotations

from . import annulus, audit, chat, rules

_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_SHA = "sha256(coalesce({}, ''))"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT coalesce(item_id::VARCHAR, '') AS item, {_WORDS.format("coalesce(text, '')")} AS w FROM benchmark),
win AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM (SELECT item, w, least(13, len(w)) AS n FROM b WHERE len(w) > 0), unnest(range(1, len(w) - n + 2)) AS t(i)),
dw AS (SELECT rid, i, n, array_to_string(w[i:i + n - 1], ' ') AS k FROM d, (SELECT DISTINCT n FROM win), unnest(range(1, len(w) - n + 2)) AS t(i)),
occ AS (SELECT rid, i, dw.n, item FROM dw JOIN win USING (k)),
hit AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT rid, i, n FROM occ), unnest(range(i, i + n)) AS t(p) GROUP BY 1),
it AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, {_SHA.format("items")} AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hit USING (rid) LEFT JOIN it USING (rid)"""

QUALITY_RULES = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS host, coalesce(text, '') AS text, {_SPACED.format("coalesce(text, '')")} AS w FROM documents),
rep AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(w[i:i + 7], ' ')) AS n FROM d, unnest(range(1, len(w) - 6)) AS t(i)),
cov AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM rep, unnest(range(i, i + 8)) AS t(p) WHERE n > 1 GROUP BY 1),
ln AS (SELECT rid, host, text, line, array_to_string({_WORDS.format("line")}, ' ') AS norm, len({_WORDS.format("line")}) AS m, len({_SPACED.format("line")}) AS k FROM d, unnest(string_split(text, chr(10))) AS t(line)),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM ln WHERE k > 0 GROUP BY 1),
hosts AS (SELECT host, count(DISTINCT text) AS texts FROM d GROUP BY 1),
often AS (SELECT host, norm FROM ln JOIN hosts USING (host) WHERE m >= {rules.LINE_WORDS} GROUP BY host, norm, texts HAVING count(DISTINCT text) > {rules.LEAST_TEXTS} AND count(DISTINCT text) > least({rules.SHARE_OF_HOST}::DOUBLE * texts, {rules.MANY_TEXTS})),
gone AS (SELECT rid, sum(k)::BIGINT AS removed_words FROM ln JOIN often USING (host, norm) GROUP BY 1),
a AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
  coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words FROM d LEFT JOIN cov USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, removed_words,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND n_words - removed_words >= {rules.LEFT}::DOUBLE * n_words AS kept FROM a"""

JACCARD_JOIN = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
s AS (SELECT DISTINCT rid, array_to_string(w[i:i + 4], ' ') AS k FROM d, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS t(i) WHERE len(w) > 0),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY 1),
c AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.rid <> b.rid GROUP BY 1, 2),
e AS (SELECT a, b FROM c JOIN n x ON x.rid = a JOIN n y ON y.rid = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
r(a, b) AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(doc_id) AS least FROM r JOIN d ON d.rid = b GROUP BY 1),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY 1)
SELECT doc_id, least(doc_id, coalesce(least, doc_id)) AS class_id, coalesce(n_links, 0) AS n_links FROM d LEFT JOIN m ON m.a = rid LEFT JOIN l ON l.a = rid"""



def _clustering(k: int = annulus.CENTROIDS, rounds: int = annulus.ROUNDS) -> str:
    """Lloyd rounds spelt out: every vector against every centroid."""
    parts = [
        f"""v AS MATERIALIZED (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor({annulus.SCALE} * x::DOUBLE)::BIGINT) AS x FROM embeddings
  WHERE len(embedding) = {annulus.SIZE} AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""",
        f"""c0 AS MATERIALIZED (SELECT (row_number() OVER (ORDER BY key, x) - 1)::INT AS cluster, x FROM
  (SELECT sha256('2:' || coalesce(vec_id::VARCHAR, '')) AS key, x FROM v ORDER BY key, x LIMIT {k}))""",
    ]
    near = """a{0} AS MATERIALIZED (SELECT rid, min(s).d AS distance, min(s).cluster AS cluster FROM
  (SELECT rid, struct_pack(d := list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2])))::BIGINT, cluster := cluster) AS s FROM v, c{0} c) GROUP BY rid)"""
    for i in range(rounds):
        parts.append(near.format(i))
        parts.append(
            f"""s{i} AS (SELECT cluster, list(m ORDER BY place) AS x FROM (SELECT cluster, place, ((sum(e) - ((sum(e) % count(*)) + count(*)) % count(*)) // count(*))::BIGINT AS m
  FROM (SELECT cluster, unnest(x) AS e, unnest(range({annulus.SIZE})) AS place FROM a{i} JOIN v USING (rid)) GROUP BY 1, 2) GROUP BY 1)"""
        )
        parts.append(f"c{i + 1} AS MATERIALIZED (SELECT cluster, coalesce(s{i}.x, c{i}.x) AS x FROM c{i} LEFT JOIN s{i} USING (cluster))")
    parts.append(near.format(rounds))
    return (
        "WITH "
        + ",\n".join(parts)
        + f"""
SELECT vec_id, cluster, distance, (sum(distance) OVER (PARTITION BY cluster))::BIGINT AS cluster_inertia, (sum(distance) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(list_transform(c{rounds}.x, lambda e: e::VARCHAR), ',')) AS centroid_sha256 FROM a{rounds} JOIN v USING (rid) JOIN c{rounds} USING (cluster)"""
    )


_WORD_LIST = _SPACED.format("t")
FILTER_AUDIT = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, part, t, {_WORD_LIST} AS w FROM d),
f AS (SELECT rid, part, [len(w) < {audit.LEAST_WORDS}, 100 * len(list_distinct(w)) < {audit.DISTINCT_PERCENT} * len(w), 100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > {audit.CAPITAL_PERCENT} * length(t),
  regexp_matches(t, '[#$%&*|]'), coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)] AS fails, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic
  FROM w LEFT JOIN (SELECT doc_id, coalesce(bool_or(quality = 1), false) AS good, coalesce(bool_or(toxic = 1), false) AS toxic FROM labels GROUP BY 1) USING (doc_id)),
g AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS n_good, count(*) FILTER (toxic) AS n_toxic FROM f GROUP BY 1, 2),
o(filter_order) AS (SELECT '' UNION ALL SELECT filter_order || x FROM o, unnest(string_split('ABCDE', '')) AS t(x) WHERE NOT contains(filter_order, x)),
s AS (SELECT filter_order, step, ascii(filter_order[step]) - 64 AS own, list_transform(string_split(filter_order[:step - 1], ''), lambda x: ascii(x) - 64) AS before FROM (SELECT filter_order FROM o WHERE length(filter_order) = 5), unnest(range(1, 6)) AS t(step)),
r AS (SELECT part, filter_order, step, own, n, n_good, n_toxic, fails[own] AS bad, step > 1 AND len(list_filter(before, lambda b: fails[b])) > 0 AS gone, len(list_filter(fails, lambda x: x)) AS n_fails FROM g, s),
a AS (SELECT part, filter_order, step::INT AS step, own, coalesce(sum(n) FILTER (NOT gone AND NOT bad), 0)::BIGINT AS kept, coalesce(sum(n) FILTER (NOT gone AND bad), 0)::BIGINT AS removed, coalesce(sum(n) FILTER (gone AND bad), 0)::BIGINT AS redundant,
  coalesce(sum(n) FILTER (bad AND n_fails = 1), 0)::BIGINT AS unique_fails, coalesce(sum(n_good) FILTER (NOT gone AND bad), 0)::BIGINT AS good_lost, coalesce(sum(n_toxic) FILTER (NOT gone AND bad), 0)::BIGINT AS toxic_lost FROM r GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley FROM a"""

ORACLE = {
    "op2_ngram_jaccard_join": JACCARD_JOIN,
    "op3_decontamination": DECONTAMINATION,
    "op7_chat_formatting": chat.ORACLE,
    "op9_quality_rules": QUALITY_RULES,
    "op12_centroid_clustering": _clustering(),
    "op13_filter_audit": FILTER_AUDIT,
}
