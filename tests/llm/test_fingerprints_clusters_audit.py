"""Improbable-feature fingerprints, centroid clustering and the filter audit against brute-force versions and odd rows."""

import hashlib
import random
import re
from collections import Counter
from itertools import permutations

import numpy as np
import pytest

from tallyspark.llm import annulus, audit, improbable


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# --- fingerprints -------------------------------------------------------------------------------------------------


def slow_level(window):
    total = sum(int(improbable.PARTS[c]) for c in Counter(window).values())
    return min(improbable.LEVELS - 1, (int(improbable.PARTS[improbable.WINDOW]) - total) >> 15)


def slow_features(data, ranks):
    """Features of one text by scanning every neighbourhood."""
    if not data:
        return []
    if len(data) < improbable.WINDOW:
        return [data]
    ranked = [int(ranks[slow_level(data[i : i + improbable.WINDOW])]) for i in range(len(data) - improbable.WINDOW + 1)]
    score = Counter()
    for at in range(1 - improbable.NEIGHBOURS, len(ranked)):
        inside = range(max(0, at), min(len(ranked), at + improbable.NEIGHBOURS))
        score[min(inside, key=lambda i: (ranked[i], i))] += 1
    return list(dict.fromkeys(data[i : i + improbable.WINDOW] for i in sorted(score) if score[i] >= improbable.LEAST_SCORE))


def slow_chain(data, ranks):
    import xxhash

    features, out = slow_features(data, ranks), b""
    for at in range(0, len(features), improbable.FEATURES):
        some, bits = features[at : at + improbable.FEATURES], 0
        for f in some:
            h = xxhash.xxh3_64_intdigest(f)
            for k in range(improbable.HASHES):
                bits |= 1 << (h >> 11 * k & improbable.BITS - 1)
        out += len(some).to_bytes(2, "little") + bits.to_bytes(improbable.BITS // 8, "little")
    return out


def slow_likeness(a, b):
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    each = 2 + improbable.BITS // 8
    filters = [[int.from_bytes(x[i + 2 : i + each], "little") for i in range(0, len(x), each)] for x in (a, b)]

    def one_way(xs, ys):
        total = 0.0
        for x in xs:
            best = 0.0
            for y in ys:
                n, m, common = x.bit_count(), y.bit_count(), (x & y).bit_count()
                chance = n * m / improbable.BITS
                best = max(best, (common - chance) / (min(n, m) - chance))
            total += min(1.0, best)
        return total / len(xs)

    x, y = filters
    if len(x) == len(y):
        return (one_way(x, y) + one_way(y, x)) / 2
    return one_way(x, y) if len(x) < len(y) else one_way(y, x)


def slow_ranks(texts):
    count = Counter(slow_level(t[i : i + improbable.WINDOW]) for t in texts for i in range(len(t) - improbable.WINDOW + 1))
    order = sorted(range(improbable.LEVELS), key=lambda v: (v < improbable.FLAT, count[v], v))
    ranks = np.empty(improbable.LEVELS, np.uint32)
    ranks[order] = np.arange(improbable.LEVELS)
    return ranks


def fingerprint_rows():
    rng = random.Random(2)
    words = ["alpha", "béta", "gamma", "δelta", "one", "two", "twenty-one", "東京", "😀", "=====", "0123456789abcdef"]
    texts = [" ".join(rng.choice(words) + rng.choice(["", str(rng.randrange(999))]) for _ in range(n)) for n in (1, 3, 9, 12, 40, 70, 130, 260)]
    texts += [None, "", "x", "é", "y" * 63, "y" * 64, "z" * 300, texts[6], texts[6] + " more", "ab" * 40, texts[7][:200] + texts[5]]
    rows = [(i * 3 % 19, t, "mine", "mine", 1.0) for i, t in enumerate(texts)]
    return rows + [rows[6], rows[6], (None, "a null id " * 20, None, None, None), (None, None, None, None, None), (5, "an id that is there twice " * 9, "x", "x", 0.0)]


FIELDS = "doc_id long, text string, fingerprint string, part string, near_next double"


def slow_neighbours(rows, order):
    """Rows in the given order, each with the one after it."""
    texts = [(r[1] or "").encode() for r in order]
    ranks = slow_ranks(texts)
    chains = [slow_chain(t, ranks) for t in texts]
    out = []
    for i, r in enumerate(order):
        t, after = r[1] or "", order[(i + 1) % len(order)][1] or ""
        new = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        made = slow_chain(new.encode(), ranks)
        out.append((r[0], len(t), sha(new), chains[i].hex(), made.hex(), round(slow_likeness(chains[i], made), 9), round(slow_likeness(chains[i], chains[(i + 1) % len(order)]), 9)))
    return Counter(out)


@pytest.mark.parametrize("size", [64 << 20, 700])
def test_fingerprints_of_neighbours(spark, monkeypatch, size):
    monkeypatch.setattr(improbable, "RANGE_BYTES", size)
    rows = fingerprint_rows()
    docs = spark.createDataFrame(rows, FIELDS).repartition(3)
    order = [r[:2] for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").orderBy("doc_id", "h").collect()]
    got = improbable.digests(improbable.neighbours(docs)).collect()
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == slow_neighbours(rows, order)
    same = {}
    for r, text in zip(sorted(got, key=lambda r: (r[0] is not None, r[0])), sorted(order, key=lambda r: (r[0] is not None, r[0]))):
        if r["doc_id"] not in (None, 5):
            assert same.setdefault(text[1] or "", r["fingerprint"]) == r["fingerprint"]


def test_fingerprints_store_nothing(spark):
    from pathlib import Path

    from tallyspark.sources.shared import shared_dir

    tables = Path(shared_dir(spark).removeprefix("file://").removeprefix("file:")) / "tables"
    before = set(tables.glob("*"))
    docs = spark.createDataFrame(fingerprint_rows(), FIELDS).repartition(3)
    assert improbable.neighbours(docs).count() == len(fingerprint_rows())
    assert set(tables.glob("*")) == before


@pytest.mark.parametrize("parts", ["1", "2", "30"])
def test_repeated_rows_lie_in_several_ranges(spark, parts):
    rows = fingerprint_rows()
    rows += [rows[5]] * 50 + [(None, None, None, None, None)] * 20
    docs = spark.createDataFrame(rows, FIELDS).repartition(4)
    order = [r[:2] for r in docs.selectExpr("doc_id", "text", "xxhash64(coalesce(text, '')) AS h").orderBy("doc_id", "h").collect()]
    given = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = improbable.digests(improbable.neighbours(docs)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", given)
    assert Counter((*r[:5], round(r[5], 9), round(r[6], 9)) for r in got) == slow_neighbours(rows, order)


def test_fingerprints_of_few(spark):
    docs = spark.createDataFrame(fingerprint_rows(), FIELDS)
    assert improbable.neighbours(docs.filter("false")).count() == 0
    one = improbable.neighbours(docs.filter("doc_id = 1")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    assert {r["near_edited"] for r in improbable.neighbours(docs.filter("text IS NULL")).collect()} == {1.0}
    plain = improbable.fingerprint(docs)
    assert plain.columns == ["doc_id", "text", "part", "near_next", "fingerprint"] and plain.filter("text IS NULL AND length(fingerprint) = 0").count() == 2


def test_long_text_is_cut_nowhere(monkeypatch):
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 110, n, np.uint8).tobytes() for n in (5000, 30, 0, 3000)]
    ranks = slow_ranks(texts)
    whole = improbable.fingerprints(texts, ranks)
    assert whole == [slow_chain(t, ranks) for t in texts]
    monkeypatch.setattr(improbable, "STRETCH", 100)
    assert improbable.fingerprints(texts, ranks) == whole


def test_likeness_follows_what_is_shared():
    rng = np.random.default_rng(4)
    a, b = (bytes(rng.integers(97, 123, 60_000, np.uint8)) for _ in range(2))
    ranks = slow_ranks([a[:20_000], b[:20_000]])
    chain = {k: improbable.fingerprints([a[: int(60_000 * k)] + b[: 60_000 - int(60_000 * k)]], ranks)[0] for k in (0, 0.25, 0.5, 0.75, 1)}
    near = [improbable.likeness(chain[1], chain[k]) for k in (0, 0.25, 0.5, 0.75, 1)]
    assert near == sorted(near) and near[0] < 0.1 and near[4] == 1
    assert all(abs(x - k) < 0.12 for x, k in zip(near, (0, 0.25, 0.5, 0.75, 1)))


# --- centroid clustering ------------------------------------------------------------------------------------------


def slow_clusters(rows, size, scale, k, rounds):
    kept = [(i, [int(np.floor(float(x) * scale)) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    centroids = [list(v) for _, v in sorted(kept, key=key)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        own = [nearest(v)[1] for _, v in kept]
        for n in range(len(centroids)):
            some = [v for (_, v), o in zip(kept, own) if o == n]
            if some:
                centroids[n] = [sum(c) // len(some) for c in zip(*some)]
    last = [(i, *nearest(v)) for i, v in kept]
    inertia, of = sum(d for _, d, _ in last), Counter()
    for _, d, n in last:
        of[n] += d
    return Counter((i, n, d, of[n], inertia, sha(",".join(map(str, centroids[n])))) for i, d, n in last)


def odd_vectors():
    rng = np.random.default_rng(8)
    rows = [(i, [float(x) for x in np.round(rng.normal(size=4) * rng.choice([0.01, 1, 30]), 2)]) for i in range(150)]
    rows += [(200 + i, [float(x) for x in rng.integers(-1, 2, 4)]) for i in range(60)]  # many equal distances
    rows += [(300, None), (301, []), (302, [1.0, None, 0.0, 0.0]), (303, [1.0, float("nan"), 0.0, 0.0]), (304, [float("inf"), 0.0, 0.0, 0.0]), (305, [1.0, 2.0, 3.0]), (306, [0.0] * 5)]
    return rows + [rows[3], rows[3], (7, [0.5, 0.5, 0.5, 0.5]), (None, [0.1, 0.2, 0.3, 0.4]), (None, [9.0, 9.0, -9.0, 9.0])]


@pytest.mark.parametrize("k", [1, 9, 500])
def test_clusters(spark, k):
    rows = odd_vectors()
    table = spark.createDataFrame([(i, v, 3, "x") for i, v in rows], "vec_id long, embedding array<double>, cluster int, v string").repartition(3)
    got = annulus.cluster(table, k, 3, size=4, scale=16)
    assert Counter(map(tuple, got.collect())) == slow_clusters(rows, 4, 16, k, 3)


def test_clusters_of_none(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert annulus.cluster(empty).count() == 0
    assert annulus.cluster(spark.createDataFrame([(1, [0.5])], "vec_id long, embedding array<float>")).count() == 0
    with pytest.raises(Exception, match="beyond"):
        annulus.cluster(spark.createDataFrame([(1, [1e30])], "vec_id long, embedding array<double>"), size=1).collect()


@pytest.mark.parametrize("most", [3, 1 << 19, 1 << 25])
def test_annulus_keeps_every_nearest(most):
    """Also where doubles don't hold the sums, and where distances tie on the annulus's boundary."""
    rng = np.random.default_rng(most)
    centroids = rng.integers(-most, most + 1, (50, 6))
    centroids[7] = centroids[3]
    x = np.concatenate((rng.integers(-most, most + 1, (3000, 6)), centroids, 2 * centroids[:5] - centroids[5:10], np.zeros((1, 6), np.int64)))
    every = np.array([[sum((int(a) - int(b)) ** 2 for a, b in zip(v, c)) for c in centroids] for v in x[-200:]])
    number, distance, compared = annulus.Annuli(centroids).nearest(x)
    assert (distance[-200:] == every.min(1)).all() and (number[-200:] == every.argmin(1)).all()
    assert compared <= len(x) * len(centroids)


def test_annulus_compares_few_where_norms_differ():
    rng = np.random.default_rng(0)
    centroids = np.outer(np.arange(1, 101) * 1000, np.ones(8, np.int64))
    x = centroids[rng.integers(0, 100, 5000)] + rng.integers(-20, 21, (5000, 8))
    number, _, compared = annulus.Annuli(centroids).nearest(x)
    assert (number == np.rint(x.mean(1) / 1000).astype(int) - 1).all() and compared < 3 * len(x)


# --- filter audit -------------------------------------------------------------------------------------------------


def audit_rows():
    rng = random.Random(9)
    out = []
    for i in range(160):
        words = [rng.choice("abcdefghij") * rng.randint(1, 2) + (str(rng.randrange(60)) if i % 3 else "") for _ in range(rng.choice([5, 49, 50, 90]))]
        text = rng.choice([" ", "\n", "\x0b"]).join(words) + rng.choice(["", "", " | x", " ÀÉ A", " X" * 40])
        out.append((i, text, rng.choice(["s0", "s0", "s1", "", None]), "mine", 1))
    out += [(200 + i, out[i % 7][1], "s1", "mine", 1) for i in range(40)] + [(300, None, "s0", "", 0), (301, "", "s2", "", 0), (302, "\x1c " * 60, None, "", 0)]
    return out + [out[0], out[9], out[9], (None, out[5][1], "s0", None, None), (None, None, None, None, None), (3, "another text of id three", "s9", None, None)]


def label_rows():
    rng = random.Random(3)
    rows = [(i, rng.choice([0, 1, None]), rng.choice([0, 0, 1, None])) for i in range(0, 320, 2)]
    return rows + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (9999, 1, 1)]


def slow_audit(rows, labels):
    good, toxic = ({i for i, *v in labels if i is not None and v[k] == 1} for k in (0, 1))
    least = {}
    for r in rows:
        if r[0] is not None:
            least[r[1] or ""] = min(r[0], least.get(r[1] or "", r[0]))
    facts = []
    for r in rows:
        t = r[1] or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {
            "A": len(w) < 50,
            "B": 100 * len(set(w)) < 65 * len(w),
            "C": 100 * len(re.findall("[A-Z]", t)) > 5 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": r[0] is not None and r[0] > least[t],
        }
        facts.append((r[2] or "", {f for f in fails if fails[f]}, r[0] in good, r[0] in toxic))
    out = []
    for part in {f[0] for f in facts}:
        own = [f[1:] for f in facts if f[0] == part]
        steps, total = [], Counter()
        for order in permutations("ABCDE"):
            left = own
            for k, f in enumerate(order):
                lost = [x for x in left if f in x[0]]
                left = [x for x in left if f not in x[0]]
                total[f] += len(lost)
                bad = [x for x in own if f in x[0]]
                steps.append((f, part, "".join(order), k + 1, len(left), len(lost), len(bad) - len(lost), sum(len(x[0]) == 1 for x in bad), sum(x[1] for x in lost), sum(x[2] for x in lost)))
        out += [(*s[1:], total[s[0]]) for s in steps]
    return Counter(out)


def test_audit(spark):
    rows = audit_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, part string, good int").repartition(3)
    labels = spark.createDataFrame(label_rows(), "doc_id long, quality int, toxic int")
    got = audit.audit(docs, labels)
    assert ", ".join(f"{n} {'long' if t == 'bigint' else t}" for n, t in got.dtypes) == audit.FORM
    assert Counter(map(tuple, got.collect())) == slow_audit(rows, label_rows())
    assert Counter(map(tuple, audit.audit(docs, labels.filter("false")).collect())) == slow_audit(rows, [])
    assert audit.audit(docs.filter("false"), labels).count() == 0


def test_bitmaps_count_as_rows_do():
    rng = np.random.default_rng(6)
    sizes = np.array([1, 64, 65, 200, 3])
    n = int(sizes.sum())
    fails, good, toxic = rng.integers(0, 16, n), rng.random(n) < 0.5, rng.random(n) < 0.1
    got = audit.subset_counts(fails, good, toxic, sizes, 4)
    part = np.repeat(np.arange(5), sizes)
    for p in range(5):
        for subset in range(16):
            left = (part == p) & (fails & subset == 0)
            assert got[p, subset].tolist() == [left.sum(), (left & good).sum(), (left & toxic).sum()]
