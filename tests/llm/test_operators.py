"""The operators against brute-force versions, and their stated results for odd rows."""

import hashlib
import random
import re
import time
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import bpe, chat, common, decontam, jaccard, lengths, queries, resample, rules, secret_spans, templates, toxicity

PATH = queries.vocabulary()
DOCS = "doc_id long, text string, lang string, source string, n_chars int, n_words string, row string, key string"
WORD = re.compile(common.WORD_FORM)


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def corpus():
    """Random texts with passages, copies, near copies, odd characters, secrets, empties and nulls."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(60)] + ["Élan", "straße", "naïve", "東京", "x²", "áb", "don't", "$5", "...", "1,000", "--", " y", "İz"]
    passage = [rng.choice(vocabulary[:60]) for _ in range(30)]
    texts = []
    for i in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.choice([1, 3, 8, 14, 40, 90]))]
        if i % 4 == 0:
            words[1:1] = passage[i % 10 : i % 10 + 20]
        texts.append(" ".join(w + rng.choice(["", "", "", ".", "\n", "\n\n"]) for w in words))
    base = [rng.choice(vocabulary) + str(i) for i in range(120)]
    for i in range(12):
        words = list(base)
        words[rng.randrange(120)] = f"edit{i}"
        texts.append(" ".join(words))
    texts += [texts[0]] * 5 + ["", None, "   ", "\n", "one", "Two words", "x " * 3000, "z" * 5000, "a<|endoftext|>b <|endoftext|>", "tab\tand\x1c\x0bfeed \r\n end", "𝒳 math 😀😀 done"]
    texts += ["password = hunter22 and AKIA" + "A" * 16 + " then " + "0a" * 12, 'Token: "abc" secret:token: abcdefgh', "user: bob\nat https://db.example.net/x key Zx81kQ99aa7LmN20pQ\n\n\nZx81kQ99aa7LmN20pQ alone"]
    texts += ["same line of five words here\nother " + str(i) for i in range(30)]
    return [(i, t, "en", None if i % 7 == 0 else f"s{i % 2}", None, "mine", "mine", "mine") for i, t in enumerate(texts)]


@pytest.fixture(scope="module")
def rows():
    out = corpus()
    return out + [out[3], (None, "null id words here now", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3)


def benchmark_rows(rows):
    texts = [r[1] or "" for r in rows]
    w = WORD.findall(lowered(texts[0]))
    return [(1, texts[0]), (2, " ".join(w[2:20])), (10, "two words"), (11, None), (12, ""), (13, "no such words at all"), (2, texts[4]), (None, "one")]


def brute_decontam(rows, bench, window=13):
    items = []
    for k, t in bench:
        w = WORD.findall(lowered(t))
        if w:
            items.append((str(k) if k is not None else "", {tuple(w[i : i + window]) for i in range(max(1, len(w) - window + 1))}))
    out = []
    for r in rows:
        w = WORD.findall(lowered(r[1]))
        hit, found = set(), set()
        for k, wins in items:
            for win in wins:
                for i in range(len(w) - len(win) + 1):
                    if tuple(w[i : i + len(win)]) == win:
                        hit |= set(range(i, i + len(win)))
                        found.add(k)
        out.append((r[0], len(w), len(hit), len(found), sha(",".join(sorted(found))), bool(hit) and 20 * len(hit) >= len(w)))
    return out


@pytest.mark.parametrize("room", [None, 40])
def test_decontamination(spark, docs, rows, monkeypatch, room):
    if room:
        monkeypatch.setattr(decontam, "PASS_BYTES", room)
    bench = benchmark_rows(rows)
    table = spark.createDataFrame(bench, "item_id long, text string")
    got = decontam.digests(decontam.find(docs, table, carry=["doc_id"])).drop("spans").collect()
    assert Counter(map(tuple, got)) == Counter(brute_decontam(rows, bench))


def test_decontamination_spans_and_empty(spark, docs, rows):
    table = spark.createDataFrame(benchmark_rows(rows), "item_id long, text string")
    for r in decontam.find(docs, table).collect():
        inside = sum(len(WORD.findall(lowered(r["text"][s["start"] : s["end"]]))) for s in r["spans"])
        assert inside == r["n_hit"]
    none = decontam.find(docs, table.filter("false")).agg(F.sum("n_hit"), F.count("*")).first()
    assert tuple(none) == (0, len(rows))
    assert decontam.find(docs.filter("false"), table).count() == 0


def test_fm_index_against_scan():
    rng = np.random.default_rng(3)
    for _ in range(20):
        most = int(rng.integers(1, 9))
        text = rng.integers(0, most + 1, int(rng.integers(2, 300)))
        text[-1] = 0
        index = decontam.FMIndex(text, most, sample=4)
        length = rng.integers(1, 5, 40)
        pattern = rng.integers(1, most + 1, (40, 4))
        which, at = index.search(pattern, length)
        expect = {(i, p) for i in range(40) for p in range(len(text) - length[i] + 1) if (text[p : p + length[i]] == pattern[i, : length[i]]).all()}
        assert {*zip(which.tolist(), at.tolist())} == expect and len(which) == len(expect)


@pytest.mark.parametrize("block_bytes", [200, 24 << 20])
def test_bpe_equals_library(docs, rows, block_bytes):
    library = bpe.library(PATH)
    want = Counter()
    for r in rows:
        ids = library.encode(r[1] or "", add_special_tokens=False).ids
        text = library.decode(ids, skip_special_tokens=False)
        want[(r[0], len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(text))] += 1
    got = bpe.digests(docs, PATH, block_bytes=block_bytes, spread=5).collect()
    assert Counter(map(tuple, got)) == want


def test_bpe_round_trip(docs, spark):
    out = bpe.encode_decode(docs, PATH)
    assert out.filter("decoded <> coalesce(text, '')").count() == 0
    assert out.filter("size(ids) <> n_tokens").count() == 0 and set(docs.columns) <= set(out.columns)
    assert bpe.encode_decode(docs.filter("false"), PATH).count() == 0


def test_split_is_exact_for_every_character():
    """The quick pattern and the library agree on any character, alone and between others."""
    tokenizer = bpe.library(PATH).pre_tokenizer
    for low in range(0, 0x3200, 64):
        text = "".join(f"a{chr(c)}1 {chr(c)}." for c in range(low, low + 64))
        assert bpe.split(text, PATH) == [text[a:b] for _, (a, b) in tokenizer.pre_tokenize_str(text)]
    for c in [*range(0x4E00, 0x9FA6, 97), *range(0xAC00, 0xD7A4, 97)]:
        assert bpe.split(f"a{chr(c)}1", PATH) == [f"a{chr(c)}", "1"]


def test_lengths(docs, rows, spark):
    n = sorted(len(bpe.library(PATH).encode(r[1] or "", add_special_tokens=False).ids) for r in rows)
    got = sorted(lengths.histogram(docs, PATH).collect())
    assert {r["n_tokens"]: r["n_docs"] for r in got} == Counter(n)
    for r in got:
        limit = r["n_tokens"]
        assert r["docs_longer"] == sum(x > limit for x in n)
        assert r["tokens_upto"] == sum(x for x in n if x <= limit)
        assert r["total_truncated"] == sum(min(x, limit) for x in n) and r["total_tokens"] == sum(n)
    hist = lengths.histogram(docs, PATH)
    assert lengths.truncated_total(hist, 7).first()["total_truncated"] == sum(min(x, 7) for x in n)
    assert lengths.histogram(docs.filter("false"), PATH).count() == 0


def shingles(text):
    w = WORD.findall(lowered(text))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    sets = [shingles(r[1]) for r in rows]
    near = [[i != j and a and b and 10 * len(a & b) >= 8 * len(a | b) for j, b in enumerate(sets)] for i, a in enumerate(sets)]
    seen, out = {}, []
    for i in range(len(rows)):
        if i in seen:
            continue
        group, todo = [], [i]
        seen[i] = group
        while todo:
            a = todo.pop()
            group.append(a)
            for b in range(len(rows)):
                if near[a][b] and b not in seen:
                    seen[b] = group
                    todo.append(b)
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in seen[i] if rows[j][0] is not None]
        out.append((r[0], min(ids) if ids else None, sum(map(bool, near[i]))))
    return out


@pytest.mark.parametrize("block, shingles_of_block", [(3, 1 << 20), (256, 150), (256, 1 << 20)])
def test_jaccard_join(docs, rows, monkeypatch, block, shingles_of_block):
    monkeypatch.setattr(jaccard, "BLOCK_SHINGLES", shingles_of_block)
    got = jaccard.join(docs, block=block).collect()
    assert Counter(map(tuple, got)) == Counter(brute_classes(rows))


def test_jaccard_keeps_one_of_each(docs, rows):
    kept = jaccard.keep_one(docs)
    assert kept.columns == docs.columns
    want = {(c if c is not None else ("none", i)) for i, (d, c, n) in enumerate(brute_classes(rows)) if shingles(rows[i][1])}
    no_words = sum(not shingles(r[1]) for r in rows)
    got = [tuple(r) for r in kept.collect()]
    assert len(got) == len(want) + no_words
    assert jaccard.join(docs.filter("false")).count() == 0 and jaccard.keep_one(docs.filter("false")).count() == 0


def test_jaccard_keeps_unrelated_classes_apart(spark):
    """Texts without an id, or with one id, are of one class only where they are near copies."""
    text = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    rows = [(None, text("a")), (None, text("a")), (None, text("a", 29)), (None, text("b")), (None, text("c")), (None, ""), (None, None)]
    rows += [(5, text("d")), (5, text("e")), (5, text("e")), (6, text("e", 31)), (6, text("f")), (7, text("d", 31))]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    kept = Counter(map(tuple, jaccard.keep_one(table).collect()))
    assert sum(kept[None, t] for t in (text("a"), text("a", 29))) == 1
    assert {r: n for r, n in kept.items() if not (r[1] or "").startswith("a")} == {
        (None, text("b")): 1, (None, text("c")): 1, (None, ""): 1, (None, None): 1, (5, text("d")): 1, (5, text("e")): 1, (6, text("f")): 1,
    }
    found, info = jaccard.classes(table)
    assert found.filter("digest is not null").join(info, "digest").select("key").distinct().count() == 6


def test_jaccard_takes_any_id_and_any_column(spark):
    text = lambda name, n=30: " ".join(f"{name}{i}" for i in range(n))
    rows = [("b", text("a")), ("a", text("a", 29)), (None, text("a")), ("c", text("b")), ("c", text("b")), ("d", "?!"), ("d", "?!")]
    names = ["_id", "_hash", "_i", "_h", "_n", "n", "words", "row", "text_hash", "digest", "best", "key"]
    table = spark.createDataFrame(rows, "doc_id string, text string").withColumns({c: F.lit(c) for c in names})
    kept = jaccard.keep_one(table)
    assert kept.columns == table.columns
    assert Counter(tuple(r)[:2] for r in kept.collect()) == {rows[1]: 1, rows[3]: 1, ("d", "?!"): 2}
    assert all(r[c] == c for r in kept.collect() for c in names)
    assert Counter(map(tuple, jaccard.join(table).collect())) == Counter([("b", "a", 2), ("a", "a", 2), (None, "a", 2), ("c", "c", 1), ("c", "c", 1), ("d", "d", 0), ("d", "d", 0)])


def test_jaccard_blocks_of_signatures(docs, rows):
    """Buckets larger than a block, and groups above and below the size that is handled at once."""
    assert Counter(map(tuple, jaccard.join(docs, sketch_block=2, block=3).collect())) == Counter(brute_classes(rows))


def test_promising_pairs_equal_brute_force():
    rng = np.random.default_rng(4)
    bands, rows, n = 6, 3, 150
    base = rng.integers(0, 256, (12, bands * rows)).astype(np.uint8)
    low = base[rng.integers(0, 12, n)]
    low = np.where(rng.random(low.shape) < 0.1, rng.integers(0, 256, low.shape), low).astype(np.uint8)
    of = np.zeros((n, bands), "<u4")
    for b in range(bands):
        of[:, b] = [int.from_bytes(x.tobytes(), "little") for x in low[:, b * rows : (b + 1) * rows]]
    size = rng.integers(50, 70, n)
    band = 2
    groups = sorted(range(n), key=lambda i: int(of[i, band]))
    fewest = jaccard._fewest(bands * rows, 0.8)
    for two in (False, True):
        block = rng.integers(0, 2, n)
        columns = {
            "bucket": pa.array(of[groups, band].astype(np.int64)), "i": pa.array(np.zeros(n, np.int32)), "j": pa.array(np.full(n, int(two), np.int32)), "band": pa.array(np.full(n, band, np.int32)),
            "digest": pa.array([str(g).encode() for g in groups], pa.binary()), "sketch": pa.array([of[g].tobytes() + low[g].tobytes() for g in groups], pa.binary()),
            "n_shingles": pa.array(size[groups]), "block": pa.array(block[groups].astype(np.int32)),
        }
        want = {
            str(a).encode()
            for a in range(n)
            for b in range(n)
            if a != b and of[a, band] == of[b, band] and not (of[a, :band] == of[b, :band]).any() and (low[a] == low[b]).sum() >= fewest
            and min(size[a], size[b]) >= 0.8 * max(size[a], size[b]) and not (two and block[a] == block[b])
        }
        batches = pa.table(columns).to_batches(max_chunksize=17)
        for small in (0, 3, 64):
            out = [x for b in jaccard._promising(bands, rows, 0.8, tile=7, small=small)(iter(batches)) for x in b.column("digest").to_pylist()]
            assert len(out) == len(want) and set(out) == want and 0 < len(want) < n


def test_models_still_score_after_the_join(spark, docs):
    """The join leaves nothing in the session that a later model would drag along."""
    from tallyspark.operators import models, search

    jaccard.join(docs).count()
    rows = search.synthetic(spark, 120, [2.0, 0.0], alternatives=3, seed=3)
    made = {kind: (lambda kind=kind: models.Classifier(["x0", "x1"], kind)) for kind in ("forest", "boosting", "perceptron")}
    board = search.leaderboard({"popularity": models.Popularity, **made}, rows.withColumn("asin", F.col("alt_idx").cast("string")).filter("event_id < 90"), rows.withColumn("asin", F.col("alt_idx").cast("string")).filter("event_id >= 90"))
    assert {r["model"]: r["status"] for r in board.collect()} == dict.fromkeys(["popularity", *made], "ok")


def test_banding_reaches_recall():
    for similarity in (0.5, 0.8, 0.9):
        b, r = jaccard.bands_and_rows(similarity, 0.999)
        assert 1 - (1 - similarity**r) ** b >= 0.999 and b * r <= jaccard.MOST_HASHES


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 102), (101, 102), (7, 7)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100, 102: 100}


def test_components_of_long_chains_with_random_ids(spark):
    """Two chains, one with shortcuts, and a tree: the rounds don't follow their length."""
    rng = random.Random(3)
    ids = rng.sample(range(1 << 40), 4500)
    path, braid, tree = ids[:3000], ids[3000:4000], ids[4000:]
    edges = [*zip(path, path[1:])] + [e for d in (1, 2, 3) for e in zip(braid, braid[d:])] + [(tree[i], tree[rng.randrange(max(0, i - 5), i)]) for i in range(1, 500)]
    got = dict(map(tuple, common.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: min(part) for part in (path, braid, tree) for i in part}


def test_toxicity_on_held_out(spark):
    rng = random.Random(1)
    bad = ["vile", "nasty", "rotten"]
    rows, labels = [], []
    for i in range(900):
        words = [rng.choice([f"w{k}" for k in range(300)]) for _ in range(rng.choice([10, 60, 200]))]
        toxic = i % 5 == 0
        for _ in range(rng.choice([1, 3, 6]) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(bad))
        rows.append((i, " ".join(words)))
        if i < 450:
            labels.append((i, 1, int(toxic)))
    docs, marks = spark.createDataFrame(rows + [(None, None), (901, "")], "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.grade(docs, marks).collect()}
    wrong = sum(got[i]["toxic"] != (i % 5 == 0) for i in range(450, 900))
    assert wrong <= 4
    assert all(0 <= r["expected_severity"] <= 3 for r in got.values()) and not got[901]["toxic"]
    severe = np.mean([got[i]["expected_severity"] for i in range(0, 900, 5)])
    assert severe > 1 > np.mean([got[i]["expected_severity"] for i in range(1, 900, 5)])
    none = toxicity.grade(docs, marks.filter("toxic = 0"))
    assert none.filter("toxic").count() == 0 and toxicity.grade(docs.filter("false"), marks).count() == 0


def test_toxicity_thresholds_are_ordered(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    model = toxicity.fit(toxicity.training_rows(docs, labels).collect())
    assert (np.diff(model.thresholds) > 0).all() and len(model.features) <= toxicity.MOST_FEATURES
    both = toxicity.score(docs, model).withColumnRenamed("toxic", "said").join(labels, "doc_id")
    assert both.filter(F.col("said") == (F.col("toxic") > 0)).count() >= 0.95 * labels.count()


def test_resampling_separates_quality(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    got = resample.resample(docs, labels)
    both = got.join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("share")).collect()
    share = {r["quality"]: r["share"] for r in both}
    assert share[1] > 0.97 and share[0] < 0.1
    kept = resample.keep(docs, labels)
    assert kept.columns == docs.columns
    assert {r[0] for r in kept.select("doc_id").collect()} == {r[0] for r in got.filter("kept").select("doc_id").collect()}


def test_resampling_edges(docs, spark, rows):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert resample.resample(docs, labels).count() == len(rows)
    assert resample.keep(docs, labels).columns == docs.columns
    assert resample.resample(docs, labels.filter("false")).filter("kept").count() == len(rows)
    assert resample.resample(docs.filter("false"), labels).count() == 0


def test_kth_greatest(spark):
    rng = np.random.default_rng(0)
    values = np.concatenate((rng.normal(size=3000), [-1e9] * 50, [2.5] * 40))
    keys = spark.createDataFrame([(float(x),) for x in values], "key double")
    for k in (1, 17, 700, 3000, 3080):
        assert resample.kth_greatest(keys, k, few=10, bins=16) == sorted(values, reverse=True)[k - 1]
    assert resample.kth_greatest(keys, len(values)) == float("-inf") and resample.kth_greatest(keys, 0) == float("inf")


def test_chat_round_trip(spark):
    hard = ["<|im_end|><|im_start|>assistant ok", "<^|", "<^^|im_end|>", "<||>", "plain", "", None, "a\n<|im_end|>\nb", "<|nl|>", "\\E x \\Q", "$1", "<|im_end|>\n", "<", "|"]
    rows = [(c, t, role, text) for c in range(6) for t, (role, text) in enumerate(zip(["system", "user", "assistant", None, "odd\nrole", "assistant", "<|nl|>", "a<^|b"] * 2, hard[c:] + hard[:c]))]
    rows += [(7, 1, "user", "x"), (7, 1, "assistant", "y"), (7, 1, "user", "x"), (None, 0, "assistant", "z"), (8, 0, "user", "only")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    groups = defaultdict(list)
    for c, t, r, x in [*rows, (-1, 0, "user", hard[0]), (-1, 1, "assistant", hard[0])]:
        groups[c].append((t, r or "", x or ""))
    out = chat.render(chat.with_probe(table)).collect()
    assert len(out) == len(groups)
    for o in out:
        source = sorted(groups[o["conv_id"]])
        assert [(t["role"], t["text"]) for t in o["turns"]] == [(r, x) for _, r, x in source]
        undo = lambda s: re.sub(r"<\^(\^*)\|", r"<\1|", s)
        under = "".join(undo(o["formatted"][s["start"] : s["end"]]) for s in o["loss"])
        assert under == "".join(x for _, r, x in source if r == "assistant")
        assert o["formatted"].count("<|im_start|>") == len(source) == o["formatted"].count("<|im_end|>")
    got = {r["conv_id"]: r for r in chat.digests(chat.render(table)).collect()}
    assert got[7]["turns_sha256"] == sha("assistant\ny\nuser\nx\nuser\nx\n") and got[8]["loss_sha256"] == sha("")
    assert chat.render(table.filter("false")).count() == 0


def brute_secrets(text):
    text, out = text or "", []
    for m in re.finditer(r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 6:
            out.append((m.start(), 0, m.end(), "assign"))
    out += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_secrets(docs, rows, spark):
    got = secret_spans.digests(secret_spans.scan(docs, carry=["doc_id"])).collect()
    want = Counter()
    for r in rows:
        s = brute_secrets(r[1])
        want[(r[0], *(sum(x.startswith(k) for x in s) for k in secret_spans.BASE), sha(",".join(s)))] += 1
    assert Counter(tuple(r)[:5] for r in got) == want
    spans = {r["doc_id"]: r["spans"] for r in got}
    linked = next(i for i, t in ((r[0], r[1]) for r in rows) if t and t.startswith("user: bob"))
    assert [s.split(":")[0] for s in spans[linked].split(",")] == ["ident", "endpoint", "weak"]
    masked = secret_spans.redact(docs)
    assert masked.columns == docs.columns and masked.filter("text like '%hunter22%'").count() == 0
    assert masked.count() == len(rows) and secret_spans.redact(docs.filter("false")).count() == 0


def test_secrets_link_over_the_whole_paragraph():
    """Runs of any length count, and parts link however far apart they lie in one paragraph."""
    spans = lambda t: [k for k, *_ in secret_spans.linked_spans(t, secret_spans.base_spans(t))]
    run = "Zx81kQ99aa7LmN20pQ"
    for n in (128, 129, 5000):
        assert spans("user: bob key " + (run * 300)[:n]) == ["weak", "ident"]
    assert spans("user: bob " + "and so on " * 500 + run) == ["weak", "ident"]
    assert spans(run + " " + "and so on\n" * 500 + "at https://db.example.net/x") == ["weak", "endpoint"]
    assert spans("user: bob\n\n" + run) == [] == spans("user: bob " + run[:15])


def brute_rules(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    at = defaultdict(list)
    for i in range(len(w) - 7):
        at[tuple(w[i : i + 8])].append(i)
    cover = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def test_rules(docs, rows):
    got = rules.judge(docs, least_texts=5).collect()
    assert Counter(tuple(r)[:7] for r in got) == Counter((r[0], *brute_rules(r[1])) for r in rows)
    by = defaultdict(set)
    texts = defaultdict(set)
    norm = lambda x: " ".join(WORD.findall(lowered(x)))
    for r in rows:
        host = r[3] or ""
        texts[host].add(r[1] or "")
        for line in (r[1] or "").split("\n"):
            if len(norm(line).split()) >= rules.LINE_WORDS:
                by[host, norm(line)].add(r[1] or "")
    often = {k for k, v in by.items() if len(v) > 5 and len(v) > rules.SHARE_OF_HOST * len(texts[k[0]])}
    assert often
    want = Counter()
    for r in rows:
        n, *_, failed = brute_rules(r[1])
        removed = sum(len(re.findall(r"[^\x20\x09-\x0D]+", line)) for line in (r[1] or "").split("\n") if (r[3] or "", norm(line)) in often)
        want[(r[0], removed, not failed and not n - removed < rules.LEFT * n)] += 1
    assert Counter((r["doc_id"], r["removed_words"], r["kept"]) for r in got) == want
    assert rules.judge(docs.filter("false")).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="nav-open">
<nav><ul><li><a href="/x">Menu</a></li></ul></nav><header>Site</header><div class="ad">Buy</div><!-- <p>no</p> -->
<{main}><h1>Head &amp; tail</h1><p><b>One  two.<br><p>Three&nbsp;four &lt;five&gt; &#233;<ul><li>a<li>b</ul>
<div class="box">Read also our letters</div><p>Said everywhere</p><table><tr><td>c<td>d</table><form>Join</form><div id="comments"><p>First!</p></div></{main}>
<aside>More</aside><div class="cookie-notice">Cookies</div><div class="plain">Site wide line</div><footer>&copy; x</footer></body></html>"""


def test_html(spark):
    rows = [(i, f"http://User@Big.example:80/{i}?q", PAGE.format(main="article").replace("One", f"One{i}")) for i in range(8)]
    rows += [(20, "https://small.example", PAGE.format(main="div")), (21, None, None), (22, "http://x", ""), (23, "http://x", "bare <b>text"), (24, "junk", "<p>open <i>a</p> tail &amp; <"), (0, rows[0][1], rows[0][2])]
    rows += [(30 + i, "http://none.example/", f"<body><div class=top>Same top</div><p>Own {i}</p><p>Twice told</p></body>") for i in range(6)]
    got = templates.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert len(got) == len(rows)
    text = {r["page_id"]: r["text"] for r in got}
    assert text[3] == "Head & tail\nOne3 two.\nThree four <five> é\na\nb\nSaid everywhere\nc\nd"
    assert text[20] == "Head & tail\nOne two.\nThree four <five> é\na\nb\nRead also our letters\nSaid everywhere\nc\nd\nSite wide line"
    assert text[21] == text[22] == "" and text[23] == "bare text" and text[24] == "open a\ntail & <"
    assert text[31] == "Own 1"
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    assert templates.extract(empty).count() == 0


def test_html_template_of_a_part_of_a_large_host(spark):
    """A section's menu and a box on very many pages go, however large the host; running text is not touched."""
    page = lambda part, i, more: (i, f"http://h.example/{part}/{i}", f"<body>{more}<p>Own {i}</p></body>")
    rows = [page("news", i, "<ul><li>News menu</ul><p>Said in the news</p>") for i in range(6)]
    rows += [page(f"p{i}", i, "<div>Box of many</div>" if i < 20 else "") for i in range(10, 400)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = {r["page_id"]: r["text"] for r in templates.extract(table, many_pages=10).collect()}
    assert text == {i: (f"Said in the news\nOwn {i}" if i < 6 else f"Own {i}") for i, *_ in rows}
    text = {r["page_id"]: r["text"] for r in templates.extract(table).collect()}
    assert text[12] == "Box of many\nOwn 12" and text[3] == "Said in the news\nOwn 3"


def test_html_keeps_content_with_names_of_furniture():
    texts = lambda body: templates.alone(f"<body>{body}</body>")
    body = "<h2 id=related-work>Related work</h2><p class=market-share>Ours grew</p><section id=search><p>How to search</p></section><div class='section social-history' id=social-history>Past</div>"
    kept = ["Related work", "Ours grew", "How to search", "Past"]
    for tag in ("article", "main"):
        assert texts(f"<{tag}>{body}<div id=comments>First</div><div class='share-buttons'>Tell</div><section class=comments-area>No</section></{tag}>") == kept
    assert texts("<div>" + body.split("<div")[0] + "</div><div id=search>Find</div><section id=comments>First</section>") == kept[:3]
    assert texts("<main><p>Text</p><article class='comment depth-1'>Reply</article><article id=comment-12>Reply</article></main>") == ["Text"]
    assert texts("<div><p>The real text</p></div><article class=related>Teaser</article>") == ["The real text"]
    assert texts("<div><p>The real text of this page, at length</p></div><article><p>Short</p></article>") == ["The real text of this page, at length", "Short"]
    assert texts("<div><a>Many links that say much more than the text</a></div><article class='post tag-social category-search'><p>Text</p></article>") == ["Text"]


class Tree(HTMLParser):
    """Well-formed markup as nested lists: tag, then texts and elements."""

    def __init__(self, page):
        super().__init__()
        self.open = [["root"]]
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.open[-1].append([tag])
        self.open.append(self.open[-1][-1])

    def handle_endtag(self, tag):
        self.open.pop()

    def handle_data(self, data):
        self.open[-1].append(data)


def brute_pages(rows, least, share, many):
    """Texts of pages made of div, ul, li and p: subtrees that recur on a host (lists and boxes: or a part of it) go."""
    trees = [Tree(page).open[0] for _, _, page in rows]
    site = [url.split("/")[2] for _, url, _ in rows]
    part = [url.split("/")[3] if url.count("/") > 3 else "" for _, url, _ in rows]

    def lines(tree, gone=lambda t: False):
        out = []
        for x in tree[1:]:
            if isinstance(x, str):
                out += [" ".join(x.split())] if x.strip() else []
            elif not gone(x):
                out += lines(x, gone)
        return out

    def inner(tree):
        for x in tree[1:]:
            if not isinstance(x, str):
                yield x
                yield from inner(x)

    on, pages = defaultdict(set), defaultdict(set)
    for t, s, q in zip(trees, site, part):
        key = "\n".join(lines(t))
        pages[s].add(key)
        pages[s, q].add(key)
        for x in inner(t):
            on[s, repr(x)].add(key)
            on[s, q, repr(x)].add(key)

    def template(s, q):
        def gone(x):
            wide, n, own = x[0] in ("div", "ul"), len(on[s, repr(x)]), len(on[s, q, repr(x)])
            if n >= least and (n >= share * len(pages[s]) or (wide and n >= many)):
                return True
            return wide and q != "" and own >= least and own >= share * len(pages[s, q])

        return gone

    return {i: "\n".join(lines(t, template(s, q))) for (i, _, _), t, s, q in zip(rows, trees, site, part)}


@pytest.mark.parametrize("many", [12, 1000])
def test_html_equals_brute_force_on_unmarked_sites(spark, many):
    """Pages without article or main: what counting says is all that decides."""
    rng = random.Random(11)
    rows = []
    for site, n in (("a.example", 60), ("b.example", 9), ("c.example", 3)):
        boxes = [f"<div><p>{site} box {k}</p><ul><li>x{k}</li><li>y</li></ul></div>" for k in range(6)]
        for i in range(n):
            q = rng.choice(["", "news/", "old/"])
            body = [f"<p>Own {site} {i}</p>", f"<div><p>Own box {i}</p></div>"]
            body += [b for k, b in enumerate(boxes) if rng.random() < 0.7**k]
            body += [f"<ul><li>Part {q}</li></ul>"] * (q != "") + ["<p>Said by some</p>"] * (rng.random() < 0.2) + [f"<div>Few {i % 7}</div>"]
            rng.shuffle(body)
            rows.append((len(rows), f"http://{site}/{q}{i}", f"<div>{''.join(body)}</div>"))
    rows += [(len(rows) + k, *rows[k][1:]) for k in (0, 1, 1)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in templates.extract(table, share=0.2, many_pages=many).collect()}
    want = brute_pages(rows, templates.LEAST_PAGES, 0.2, many)
    assert got == want and any("box 0" not in t for t in want.values()) and any("box 0" in t for t in want.values())


def test_html_counting_decides_over_names(spark):
    """A box called furniture stays on a host whose pages differ in it, goes where it recurs, and goes by name on a small host."""
    page = lambda host, i, more: (i, f"http://{host}.example/{i}", f"<body><div class=notice>{more}</div><p>Own {i}</p><div class=nav><a>To {i}</a></div></body>")
    rows = [page("many", i, f"Differs {i}") for i in range(8)] + [page("same", 10 + i, "Same") for i in range(8)] + [page("few", 20 + i, f"Differs {i}") for i in range(2)]
    table = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("cuts", "key", "trees", "text", "host", "part")})
    out = templates.extract(table)
    assert out.columns == ["page_id", "url", "text"]
    assert {r["page_id"]: r["text"] for r in out.collect()} == {i: f"Differs {i}\nOwn {i}" if i < 8 else f"Own {i}" for i, *_ in rows}


@pytest.mark.parametrize("page", ["<a " * 200_000, "<span>" * 100_000 + "</i>" * 100_000, "<b>" * 100_000 + "<hr>" * 100_000, "<!" * 300_000, '<a "x>y" ' * 100_000, "<div>x" * 100_000])
def test_html_of_hostile_pages_takes_linear_time(page):
    start = time.time()
    templates.main_blocks(page)
    assert time.time() - start < 20


def test_html_long_page(spark):
    page = "<article>" + "".join(f"<p>Line {i}</p>" for i in range(100_000)) + "</article>"
    table = spark.createDataFrame([(1, "http://x.example/1", page)], "page_id long, url string, html string")
    assert templates.extract(table).first()["text"] == "\n".join(f"Line {i}" for i in range(100_000))


def test_word_chunks_and_long_texts(spark):
    long = "word " * 400_000
    docs = spark.createDataFrame([(1, long, "a"), (2, long + "x", "a"), (3, None, None)], "doc_id long, text string, source string")
    bench = spark.createDataFrame([(1, "word " * 13)], "item_id long, text string")
    got = {r["doc_id"]: r["n_hit"] for r in decontam.find(docs, bench).collect()}
    assert got == {1: 400_000, 2: 400_000, 3: 0}
    assert {r["doc_id"]: r["n_words"] for r in rules.judge(docs).collect()} == {1: 400_000, 2: 400_001, 3: 0}
    assert {r["doc_id"]: r["n_links"] for r in jaccard.join(docs).collect()} == {1: 0, 2: 0, 3: 0}


def test_secret_scan_of_a_text_full_of_secrets():
    """Time follows the length, also where everything is a span."""
    text = "user: bob password=hunter22 https://x.example.net/a Zx81kQ99aa7LmN20pQ " * 20_000
    base = secret_spans.base_spans(text)
    assert len(base) == 20_000
    kinds = Counter(k for k, _, _ in secret_spans.linked_spans(text, base))
    assert kinds == {"ident": 20_000, "endpoint": 20_000, "weak": 20_000}


# What the methods compute, against plain versions of them.
def test_toxicity_scores_equal_brute_force(spark, docs, rows):
    labels = spark.createDataFrame([(r[0], 1, int("w1" in (r[1] or "").split())) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").distinct()
    model = toxicity.fit(toxicity.training_rows(docs, labels).collect())
    assert len(model.weights) and (np.diff(model.thresholds) > 0).all()
    got = Counter((r["doc_id"], round(r["expected_severity"], 9), round(r["p_toxic"], 9), r["grade"], r["toxic"]) for r in toxicity.score(docs, model, carry=["doc_id"]).collect())
    want = Counter()
    for r in rows:
        n = Counter(b for w in WORD.findall(lowered(r[1])) for b in toxicity.buckets(w.encode()) if b in model.features)
        x = sum(np.log1p(k) * model.weights[model.features[b]] for b, k in n.items())
        above = [1 / (1 + np.exp(t - x)) for t in model.thresholds]
        each = [1 - above[0], above[0] - above[1], above[1] - above[2], above[2]]
        want[(r[0], round(sum(above), 9), round(above[0], 9), int(np.argmax(each)), above[0] >= 0.5)] += 1
    assert got == want


def test_toxicity_fit_is_at_a_minimum():
    """The weights that one gradient step after another finds, against small changes of each."""
    rng = np.random.default_rng(2)
    rows = []
    for i in range(300):
        keys = np.unique(rng.integers(0, 40, 12)).astype(np.uint32)
        toxic = int((keys < 6).sum() + rng.normal() * 0.7 > 2)
        rows.append({"toxic": toxic, "keys": keys.tobytes(), "counts": np.ones(len(keys), np.uint32).tobytes()})
    model = toxicity.fit(rows, ridge=1e-2, rounds=3000, rate=0.02)
    toxic = np.array([r["toxic"] for r in sorted(rows, key=lambda r: (r["toxic"], r["keys"], r["counts"]))], bool)
    lists = [np.frombuffer(r["keys"], np.uint32) for r in sorted(rows, key=lambda r: (r["toxic"], r["keys"], r["counts"]))]
    used = sorted(model.features, key=model.features.get)
    x = np.array([[np.log(2) * (f in set(k.tolist())) for f in used] for k in lists])
    have = {f: [sum(f in k for k, t in zip(lists, toxic) if t == side) for side in (True, False)] for f in range(40)}
    odds = {f: np.log((a + 0.5) / (toxic.sum() + 1)) - np.log((b + 0.5) / ((~toxic).sum() + 1)) for f, (a, b) in have.items()}
    load = np.array([sum(np.log(2) * (odds[f] > 1) for f in k.tolist() if f in model.features) for k in lists])
    grade = np.where(toxic, 1 + np.searchsorted(np.quantile(load[toxic], [1 / 3, 2 / 3]), load), 0)

    def loss(w, t):
        z = (x @ w)[:, None] - t
        above = grade[:, None] > np.arange(3)
        return np.log1p(np.exp(np.where(above, -z, z))).sum(1).mean() + 5e-3 * (w**2).sum()

    best = loss(model.weights, model.thresholds)
    for i in range(len(model.weights)):
        for d in (-0.05, 0.05):
            w = model.weights.copy()
            w[i] += d
            assert loss(w, model.thresholds) > best - 1e-5
    for d in (-0.05, 0.05):
        assert loss(model.weights, model.thresholds + d) > best - 1e-5


def brute_buckets(text):
    """The buckets of a text's n-grams, one by one."""
    import xxhash

    def spread(x, salt):
        m = (1 << 64) - 1
        x = ((x + salt) * 0x9E3779B97F4A7C15) & m
        x = ((x ^ (x >> 32)) * 0xD6E8FEB86659FD93) & m
        return (x ^ (x >> 32)) % resample.BUCKETS

    words = (text or "").encode().split()
    word = [xxhash.xxh32_intdigest(w) for w in words]
    form = [12345 if i and word[i] == word[i - 1] else xxhash.xxh32_intdigest(resample.shape(w), 1) for i, w in enumerate(words)]
    out = []
    for values, salt in ((word, 1), (form, 2)):
        out += [spread(v, salt) for v in values]
        out += [spread((a * 31 + b * 0x85EBCA6B) & ((1 << 64) - 1), salt + 10) for a, b in zip(values, values[1:])]
    return out


@pytest.mark.parametrize("budget", [None, 17])
def test_resampling_equals_brute_force(spark, docs, rows, budget):
    good = {r[0] for r in rows if r[0] is not None and r[0] % 3 == 0}
    marks = {r[0]: int(r[0] in good) for r in rows if r[0] is not None and r[0] % 2 == 0}
    labels = spark.createDataFrame([(d, q, 0) for d, q in marks.items()], "doc_id long, quality int, toxic int")
    lists = [brute_buckets(r[1]) for r in rows]
    raw, target = np.ones(resample.BUCKETS), np.ones(resample.BUCKETS)
    for r, b in zip(rows, lists):
        for x in b:
            raw[x] += 1
            target[x] += marks.get(r[0], 0)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    assert np.allclose(resample.log_ratios(docs, labels), ratio)
    weight = [sum(ratio[x] for x in b) * min(len(b), resample.LENGTH) / len(b) if b else resample.NO_NGRAMS for b in lists]
    noise = {(r["doc_id"], r["text"]): r["g"] for r in docs.select("doc_id", "text", resample.gumbel(F.col("doc_id"), F.col("text")).alias("g")).collect()}
    key = [w + noise[r[0], r[1]] for w, r in zip(weight, rows)]
    k = budget
    if k is None:
        known = {}
        for r, w in zip(rows, weight):
            if r[0] in marks:
                known[r[0]] = min(w, known.get(r[0], w))
        order = sorted(known, key=lambda d: known[d])
        wrong = [sum(marks[d] for d in order[:i]) + sum(not marks[d] for d in order[i:]) for i in range(len(order) + 1)]
        i = int(np.argmin(wrong))
        cut = -np.inf if i == 0 else np.inf if i == len(order) else (known[order[i - 1]] + known[order[i]]) / 2
        k = sum(w >= cut for w in weight)
    least = sorted(key, reverse=True)[k - 1]
    want = Counter((r[0], round(w, 6), round(x, 6), x >= least - 1e-9) for r, w, x in zip(rows, weight, key))
    got = Counter((r["doc_id"], round(r["log_weight"], 6), round(r["key"], 6), r["kept"]) for r in resample.resample(docs, labels, budget=budget).collect())
    assert got == want and len({w[3] for w in want}) == 2


def test_resampling_draws_in_proportion(spark):
    """Over many seeds a text is drawn first as often as its weight says."""
    weights = np.log([4.0, 2.0, 1.0, 1.0])
    table = spark.range(4000).select((F.col("id") % 4).alias("doc"), F.floor(F.col("id") / 4).alias("run"))
    w = F.element_at(F.array(*map(F.lit, weights.tolist())), (F.col("doc") + 1).cast("int"))
    first = table.withColumn("key", w + resample.gumbel(F.col("doc"), F.col("run"))).groupBy("run").agg(F.max_by("doc", "key").alias("doc"))
    share = {r["doc"]: r["count"] / 1000 for r in first.groupBy("doc").count().collect()}
    assert all(abs(share[i] - p) < 0.05 for i, p in enumerate([0.5, 0.25, 0.125, 0.125]))


def brute_links(text):
    """Weak parts with complementary ones in their paragraph, pair by pair."""
    base = [(k, int(a), int(b)) for k, a, b in (x.split(":") for x in brute_secrets(text))]
    meets = lambda a, b, some: any(a < y and x < b for _, x, y in some)
    name = r"""(?:client_?id|user(?:name)?|login|account(?:_?id)?|access_?key(?:_?id)?)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@+-]{3,}"""
    ident = [("ident", *m.span()) for m in re.finditer(name, text, re.I | re.A) if not meets(*m.span(), base)]
    ends = [("endpoint", *m.span()) for m in re.finditer(r"[a-z][a-z0-9+.-]*://[^\s\"'<>]{4,}", text) if not meets(*m.span(), base)]
    weak = []
    for m in re.finditer(r"[A-Za-z0-9+/_=-]+", text):
        s = m[0]
        bits = -sum(n / len(s) * np.log2(n / len(s)) for n in Counter(s).values())
        kinds = sum(any(f(c) for c in s) for f in (str.islower, str.isupper, str.isdigit))
        if len(s) >= 16 and kinds >= 2 and any(map(str.isdigit, s)) and bits >= 3 and not meets(*m.span(), base + ident + ends):
            weak.append(("weak", *m.span()))
    breaks = [m.start() for m in re.finditer(r"\n\s*\n", text)]
    scope = lambda p: sum(b <= p[1] for b in breaks)
    beside = lambda p, some: any(scope(p) == scope(q) and (q[2] <= p[1] or q[1] >= p[2]) for q in some)
    weak = [p for p in weak if beside(p, ident + ends + [s for s in base if s[0] == "access"])]
    secret = weak + [s for s in base if s[0] != "access"]
    return sorted(weak + [p for p in ident + ends if beside(p, secret)])


def test_secret_links_equal_brute_force():
    rng = random.Random(8)
    runs = ["Zx81kQ99aa7LmN20pQ", "aaaaaaaaaaaaaaaaaaaa1", "Ab3" * 60, "nodigitsinthisrunatall", "0123456789abcdef0123456789", "q7Q" + "".join(rng.choice("abcXYZ0189+/_-") for _ in range(140))]
    parts = ["user: bob", "client_id=abc-1", "login : x", "https://db.example.net/x", "s3://b", "AKIA" + "Q7" * 9, "password = hunter22", "token: short", "and so on", "words here", "\n", "\n\n", "\n \n", *runs]
    some = 0
    for _ in range(600):
        text = "".join(rng.choice(parts) + rng.choice([" ", " ", ", ", "\n"]) for _ in range(rng.randrange(1, 14)))
        got = sorted(secret_spans.linked_spans(text, secret_spans.base_spans(text)))
        assert got == brute_links(text), text
        some += bool(got)
    assert some > 150


@pytest.mark.parametrize("text", [" " * 1_000_000, "a" * 1_000_000, "!?" * 500_000, "<|endoftext|>" * 20_000, "ab " * 300_000])
def test_lengths_and_ids_of_very_long_texts(spark, text):
    table = spark.createDataFrame([(1, text), (2, text + "x")], "doc_id long, text string")
    want = {d: len(bpe.library(PATH).encode(t, add_special_tokens=False).ids) for d, t in ((1, text), (2, text + "x"))}
    hist = {r["n_tokens"]: r["n_docs"] for r in lengths.histogram(table, PATH).collect()}
    assert hist == Counter(want.values())
    out = {r["doc_id"]: r for r in bpe.encode_decode(table, PATH, digest=True).collect()}
    assert all(out[d]["n_tokens"] == n == len(out[d]["ids"]) for d, n in want.items()) and out[1]["decoded"] == text
    plain = {r["doc_id"]: tuple(r) for r in bpe.digests(table, PATH).collect()}
    assert all(plain[d] == (d, out[d]["n_tokens"], out[d]["ids_sha256"], out[d]["decoded_sha256"]) for d in want)


CLASHING = ("toxic", "grade", "keys", "digest", "bands", "sketch", "items", "spans", "items_so_far", "noise", "_noise", "key", "log_weight", "secrets", "redacted", "cuts", "trees", "n_words", "lines", "block", "part", "at", "body", "ids", "formatted", "source", "turns", "loss")


def test_operators_take_columns_with_any_name(spark, docs, rows, monkeypatch):
    wide = docs.select("doc_id", "text", "source", *(F.lit(c).alias(c) for c in CLASHING if c != "source"))
    labels = spark.createDataFrame([(i, i % 2, i % 3 == 0) for i in range(40)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    bench = spark.createDataFrame(benchmark_rows(rows), "item_id long, text string")
    kept = lambda out, own: all(r[c] == c for r in out.collect() for c in CLASHING if c not in own and c in out.columns) and set(wide.columns) <= set(out.columns)
    assert kept(toxicity.grade(wide, labels), (*toxicity.OWN, "source"))
    assert kept(resample.weigh(wide, np.zeros(resample.BUCKETS)), (*resample.OWN, "source"))
    assert kept(resample.keep(wide, labels), ("source",))
    assert kept(secret_spans.scan(wide), ("secrets", "source")) and kept(secret_spans.redact(wide), ("source",))
    assert kept(bpe.encode_decode(wide, PATH), (*bpe.OWN, "source"))
    for room in (1 << 20, 40):
        monkeypatch.setattr(decontam, "PASS_BYTES", room)
        out = decontam.find(wide, bench)
        assert kept(out, (*decontam.OWN, "source")) and out.count() == len(rows)
    assert rules.judge(wide).count() == lengths.histogram(wide, PATH).agg(F.sum("n_docs")).first()[0] == len(rows)
    talk = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "x" * 2_000_000)], "conv_id long, turn long, role string, text string").select("*", *(F.lit(c).alias(c) for c in CLASHING))
    assert chat.digests(chat.render(talk)).first()["loss_chars"] == 2_000_000


def test_texts_of_megabytes(spark):
    long = "user: bob " + "plain words of no note " * 200_000 + "Zx81kQ99aa7LmN20pQ"
    table = spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r["doc_id"]: len(r["secrets"]) for r in secret_spans.scan(table).collect()} == {1: 2, 2: 0}
    assert toxicity.grade(table, labels).count() == resample.resample(table, labels).count() == 2


def test_join_finds_nearly_all_of_random_pairs(spark):
    """Pairs of known similarity at and above the bound."""
    rng = random.Random(9)
    rows = []
    for i in range(120):
        w = [f"x{rng.randrange(100_000)}" for _ in range(200)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[: rng.randrange(163, 200)]))]
    got = {r["doc_id"]: r["class_id"] for r in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    near = [i for i in range(120) if 10 * len(shingles(rows[2 * i][1]) & shingles(rows[2 * i + 1][1])) >= 8 * len(shingles(rows[2 * i][1]) | shingles(rows[2 * i + 1][1]))]
    assert len(near) > 90 and sum(got[2 * i + 1] == 2 * i for i in near) == len(near)
    assert all(got[2 * i + 1] == 2 * i + 1 for i in range(120) if i not in near)
