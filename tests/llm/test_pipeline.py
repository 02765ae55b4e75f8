"""The pipeline's stages, each against a brute-force version on its own input."""

import re

import duckdb
import pytest

import corpus_pipeline
from tallyspark.llm import bpe, queries
from test_operators import brute_classes, brute_decontam, brute_secrets


@pytest.fixture(scope="module")
def staged(spark, sf, tmp_path_factory):
    at = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        path = str(at / re.sub(r"\W", "_", name))
        stage(spark, docs, sf).write.parquet(path)
        docs = spark.read.parquet(path)
        out.append(docs)
    return out


def test_columns_stay_but_for_the_last(staged):
    assert all(d.columns == staged[0].columns for d in staged[:-1])
    assert all(d.dtypes == staged[0].dtypes for d in staged[:-1])


def test_quality_stage(spark, sf, staged):
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in staged[1].select("doc_id").collect()}
    good = [d for d, q in labels.items() if q]
    assert sum(d in kept for d in good) >= 0.95 * len(good)


def test_one_of_each_class(staged):
    rows = [(r["doc_id"], r["text"]) for r in staged[1].collect()]
    want = {c for _, c, _ in brute_classes(rows)}
    assert {r["doc_id"] for r in staged[2].collect()} == want


def test_contaminated_go(spark, sf, staged):
    rows = [(r["doc_id"], r["text"]) for r in staged[2].collect()]
    bench = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = {x[0] for x in brute_decontam(rows, bench) if not x[-1]}
    assert {r["doc_id"] for r in staged[3].collect()} == want


def test_secrets_are_masked(staged):
    before = {r["doc_id"]: r["text"] for r in staged[3].collect()}
    after = {r["doc_id"]: r for r in staged[4].collect()}
    assert before.keys() == after.keys()
    for d, text in before.items():
        if not brute_secrets(text):
            assert after[d]["text"] == text or "[secret]" in after[d]["text"]
        assert not brute_secrets(after[d]["text"])


def test_last_stage_encodes_all(staged):
    library = bpe.library(queries.vocabulary())
    got = {r["doc_id"]: (r["n_tokens"], r["ids"], r["decoded"]) for r in staged[5].collect()}
    want = {}
    for r in staged[4].collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"]] = (len(ids), ids, library.decode(ids, skip_special_tokens=False))
    assert got == want


def test_run_gives_the_same(spark, sf, staged):
    flat = lambda rows: {(*r[:2], tuple(r["ids"]), *r[3:]) for r in rows}
    assert flat(corpus_pipeline.run(spark, sf).collect()) == flat(staged[5].collect())


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_oracles(spark, sf, name):
    base = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations", "embeddings"):
        base.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    want = base.execute(queries.ORACLE[name]).fetchdf()
    got = queries.QUERIES[name](spark, sf).toPandas()[list(want.columns)]
    key = list(want.columns)
    a = sorted(map(tuple, want[key].astype(str).values.tolist()))
    b = sorted(map(tuple, got[key].astype(str).values.tolist()))
    assert a == b


def test_stages_take_odd_rows_and_clashing_columns(spark, sf):
    """Nulls, empty texts, repeated rows, an empty table, and columns that carry names the operators use inside."""
    from pyspark.sql import functions as F
    from test_operators import DOCS, corpus

    rows = corpus()
    rows += [rows[1], (None, None, None, None, None, None, None, None), (None, "some words", None, None, None, None, None, None)]
    rows += [(900, "word and more " * 200_000, "en", "s0", None, "mine", "mine", "mine")]
    docs = spark.createDataFrame(rows, DOCS)
    for name in ("secrets", "redacted", "items", "spans", "digest", "log_weight", "id", "_id", "_hash", "_n", "text_hash", "_noise", "noise", "class_id", "best", "words", "items_so_far"):
        docs = docs.withColumn(name, F.lit(name))
    for stage_name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, stage_name
        got = out.collect()
        assert got and all(r["spans"] == "spans" and r["id"] == "id" for r in got), stage_name
        assert stage(spark, docs.filter("false"), sf).count() == 0, stage_name
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf).count() == len(rows)
