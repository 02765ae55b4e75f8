"""What must not be lost, take quadratic time, or grow without bound."""

import random
import re
import time
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import DataFrameWriter
from pyspark.sql import functions as F

import corpus_pipeline
from tallyspark.llm import common, decontam, jaccard, rules, secret_spans, templates, toxicity

# --- attributes of elements ---------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    "attributes",
    [
        'style="overflow:hidden"', 'style="visibility: visible"', 'style="displaynone"', 'title="hidden gem"', 'href="/hidden-lake"', 'onclick="x(\'hidden\')"', 'hidden-by="me"', "data-hidden", 'data-role="search"',
        'data-id="comments"', "data-class=advert", 'title="class=advert"', "title='id=sidebar hidden'", 'title=class="advert"', "aria-hidden=false", 'role="article"', 'title="a>b hidden"', "x=hidden", "/title=hidden/", 'alt="unclosed hidden',
        "id=market-share", 'class="market-share"', 'class="" class="advert"', "hiddenx", "xhidden=1", "class", "role",
    ],
)
@pytest.mark.parametrize("tag", ["div", "p", "span", "section", "a"])
def test_attributes_that_say_nothing(tag, attributes):
    page = f"<article><p>one</p><{tag} {attributes}>two</{tag}><p>three</p></article>"
    text = " ".join(templates.main_blocks(page)[0])
    if '"unclosed' in attributes:
        assert "three" in text
    else:
        assert text.split() == ["one", "two", "three"]


@pytest.mark.parametrize("attributes", ["hidden", "HIDDEN", 'hidden=""', "a=b hidden", 'title="x"hidden', 'style="color:red; DISPLAY : none !important"', "style=display:none", 'role="navigation"', "role=Search", 'aria-hidden="TRUE"', 'title=\'"\' hidden', "/hidden", 'class="advert"', "class=a&#100;vert", 'x class\n=\n"top advert"'])
def test_attributes_that_say_no_content(attributes):
    page = f"<article><p>one</p><div {attributes}><p>two</p></div><p>three</p></article>"
    assert templates.main_blocks(page)[0] == ["one", "three"]


def test_readers_comments_go_from_articles():
    for box in ('<section id="comments">', '<div id="comments">', '<ol id="comments">', '<section class="comments">'):
        end = re.match("<([a-z]+)", box)[1]
        page = f"<article><p>one</p><h2 id='comments'>On comments</h2><p id=comments>two</p>{box}<p>First!</p></{end}><p>three</p></article>"
        assert templates.main_blocks(page)[0] == ["one", "On comments", "two", "three"]


def slow_attributes(text):
    """A tag's attributes sign by sign."""
    out, i, n = {}, 0, len(text)
    while i < n:
        while i < n and (text[i].isspace() or text[i] in "/>"):
            i += 1
        a = i
        while i < n and not text[i].isspace() and text[i] not in "/>" and (text[i] != "=" or i == a):
            i += 1
        name, value, j = text[a:i].lower(), "", i
        while j < n and text[j].isspace():
            j += 1
        if name and j < n and text[j] == "=":
            j += 1
            while j < n and text[j].isspace():
                j += 1
            if j < n and text[j] in "\"'" and text.find(text[j], j + 1) >= 0:
                i = text.find(text[j], j + 1) + 1
                value = text[j + 1 : i - 1]
            else:
                i = j
                while i < n and not text[i].isspace() and text[i] != ">":
                    i += 1
                value = text[j:i]
        if name in templates.READ and name not in out:
            out[name] = value
    return out


def test_attributes_equal_brute_force():
    rng = random.Random(7)
    pieces = ["class", "id", "hidden", "style", "role", "data-", "aria-hidden", "=", "=", '"', "'", " ", "\n", "/", "x", "advert", "hidden", "none", "é", "-by"]
    for _ in range(30_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 14)))
        got, want = templates.attributes_of(text), slow_attributes(text)
        # A value of one quote on each side is what is between them, wherever that came from.
        strip = lambda v: v[1:-1] if len(v) > 1 and v[0] in "\"'" and v[0] == v[-1] else v
        assert {k: strip(v) for k, v in got.items()} == {k: strip(v) for k, v in want.items()}, text


def test_long_attributes_take_linear_time():
    start = time.time()
    for inner in ("a" * 2_000_000, "a=" * 1_000_000, "= " * 1_000_000, '"' * 2_000_001, "class " * 300_000, "/ " * 1_000_000, "a='" * 600_000):
        assert templates.main_blocks(f"<article><p {inner}>text</p></article>")[0][-1:] == ["text"] or '"' in inner or "'" in inner
    assert time.time() - start < 60


# --- secrets ------------------------------------------------------------------------------------------------------


def test_endpoints_equal_the_pattern():
    plain = re.compile(r"""[a-z][a-z0-9+.-]*://[^\s"'<>]{4,}""", re.A)
    rng = random.Random(3)
    pieces = ["://", "://", ":", "/", "a", "http", "9", "+", ".", "-", "A", "é", " ", "\n", '"', "<", "abcd", "x.y:8"]
    for _ in range(40_000):
        text = "".join(rng.choice(pieces) for _ in range(rng.randint(0, 16)))
        assert secret_spans.endpoints(text) == [("endpoint", *m.span()) for m in plain.finditer(text)], text


def test_long_runs_take_linear_time(spark):
    n = 5_000_000
    runs = ["a" * n, "0123456789abcdef" * (n // 16), "a." * (n // 2), "://" * (n // 3), "a://" * (n // 4), "x" * n + "://host.example/path", "AKIA" * (n // 4), "password" * (n // 8), "secret=" * (n // 7), "user:" * (n // 5), "Ab1" * (n // 3), " " * n, "\n" * n, "\n \n" * (n // 3)]
    rows = [(i, f"http://db.example/x user: bob {run} and key Zx81kQ99aa7LmN20pQ") for i, run in enumerate(runs)]
    start = time.time()
    got = secret_spans.digests(secret_spans.scan(spark.createDataFrame(rows, "doc_id int, text string"))).count()
    assert got == len(runs) and time.time() - start < 120


# --- labelled rows ------------------------------------------------------------------------------------------------


def test_labelled_rows_stay_within_their_bound(spark):
    docs = spark.createDataFrame([(1, f"text {i % 700} of one id is bad") for i in range(10_000)] + [(2, "a text of another id")] * 300, "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.training_rows(docs, labels, rows=50).count() <= 50
    assert toxicity.training_rows(docs, labels).count() == 701
    few = [sorted((r["toxic"], bytes(r["keys"])) for r in toxicity.training_rows(d, labels, rows=300).collect()) for d in (docs, docs.repartition(7))]
    assert few[0] == few[1] and len(few[0]) == 300


# --- lines --------------------------------------------------------------------------------------------------------


def test_short_lines_count(spark):
    rows = [(i, "\n".join(["home", "about us", "!!!", f"{'word ' * 20}{i}" if i % 2 else f"own{i}"] + ["home"] * 30), "h") for i in range(60)]
    got = {r["doc_id"]: r for r in rules.judge(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert {r["removed_words"] for r in got.values()} == {33}
    assert Counter(r["kept"] for i, r in got.items() if i % 2 == 0) == Counter({False: 30})


def test_many_texts_suffice_however_large_the_host(spark):
    rows = [(i, f"{'said by many' if i < 40 else 'said by few'} here\n" + " ".join(f"w{i}x{j}" for j in range(30)), "h") for i in range(1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    by = lambda **k: {r["doc_id"] for r in rules.judge(docs, share=0.5, **k).filter("removed_words > 0").collect()}
    assert by() == set(range(40, 1000)) and by(many_texts=30) == set(range(1000))


# --- weights and copies -------------------------------------------------------------------------------------------


def test_exact_weights_are_sums_over_all_ngrams(spark):
    import numpy as np

    from tallyspark.llm import resample

    docs = spark.createDataFrame([(1, "a b c d"), (2, " ".join(f"w{i}" for i in range(300))), (3, None)], "doc_id long, text string")
    ratios = np.linspace(-1, 1, resample.BUCKETS)
    exact, bounded = ({r["doc_id"]: r["log_weight"] for r in resample.weigh(docs, ratios, length=n).collect()} for n in (None, 100))
    for i, t in docs.collect():
        bucket, _ = resample.ngram_buckets([t.encode() if t else None], resample._Codes())
        want = ratios[bucket].sum() if len(bucket) else resample.NO_NGRAMS
        assert exact[i] == pytest.approx(want)
        assert bounded[i] == pytest.approx(want * min(100, len(bucket)) / max(len(bucket), 1) if len(bucket) else want)


def test_one_of_many_copies_without_an_id_stays(spark):
    from pyspark.sql import functions as F

    from tallyspark.llm import jaccard

    docs = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text that many rows have and nobody numbered").alias("text"), F.col("id").alias("other"))
    docs = docs.union(spark.createDataFrame([(1, "quite another text of some more words than five", 1)], "doc_id long, text string, other long")).repartition(6)
    kept = jaccard.keep_one(docs)
    assert "row_number" not in kept._jdf.queryExecution().toString()
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter([None, 1])


# --- memory of executors ------------------------------------------------------------------------------------------


def test_arrow_gives_back_what_a_task_no_longer_holds(monkeypatch):
    freed = []

    class Pool:
        def release_unused(self):
            freed.append(len(taken))

    taken = []
    monkeypatch.setattr(pa, "default_memory_pool", Pool)
    batch = pa.RecordBatch.from_pydict({"text": ["one"]})
    for got in common.freed(lambda batches: (b for b in batches))(iter([batch] * 3)):
        taken.append(got)
    assert taken == [batch] * 3 and freed == [3]
    common.freed(lambda batches: (b for b in batches))(iter([batch])).close()  # never begun
    stopped = common.freed(lambda batches: (b for b in batches))(iter([batch] * 3))
    next(stopped)
    stopped.close()
    assert freed == [3, 3]


def test_index_takes_few_bytes_a_symbol():
    most, n = 1000, 200_000
    text = np.random.default_rng(5).integers(1, most + 1, n)
    text[49::50] = 0
    tracemalloc.start()
    try:
        index = decontam.FMIndex(text, most)
        kept, peak = tracemalloc.get_traced_memory()
    finally:
        tracemalloc.stop()
    assert index.n == n
    assert kept < 56 * n and peak < 96 * n


def test_pipeline_sends_texts_to_python_in_small_batches(spark):
    session = spark.newSession()
    docs = session.range(0, 2_000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 2_000).alias("text"))

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"bytes": pa.array([b.nbytes], pa.int64()), "rows": pa.array([b.num_rows], pa.int64())})

    corpus_pipeline.secrets(session, docs, "")
    got = docs.mapInArrow(sizes, "bytes long, rows long").collect()
    assert sum(r["rows"] for r in got) == 2_000
    assert max(r["bytes"] for r in got) <= 2 * corpus_pipeline.BATCH_BYTES
    session.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20)  # what the session says stays
    corpus_pipeline.secrets(session, docs, "")
    assert session.conf.get("spark.sql.execution.arrow.maxBytesPerBatch") == str(1 << 20)


def test_join_stores_few_tables_and_holds_none_after(spark, monkeypatch):
    """Edges and labels of the join lie on executors' disks, not in files for each task of each round."""
    rng = random.Random(5)
    texts = [" ".join(f"w{rng.randrange(500)}" for _ in range(60)) for _ in range(30)]
    rows = [(3 * i + k, t + " tail" * k) for i, t in enumerate(texts) for k in range(3)]
    stored, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **b: (stored.append(path.rpartition("/")[2].partition("-")[0]), write(self, path, *a, **b))[1])
    held = lambda: spark.sparkContext._jsc.getPersistentRDDs().size()
    before = held()
    docs, info = jaccard.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert set(stored) <= {"signed", "one", "promising", "links", "label", "classes"} and stored.count("label") <= 1
    assert held() == before
    got = {r["doc_id"]: r["class_id"] for r in docs.join(info, "digest").collect()}
    assert got == {d: d - d % 3 for d, _ in rows}
