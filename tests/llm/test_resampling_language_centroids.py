"""Importance resampling, language identification and centroid clustering against plain versions, with odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from conftest import SMALL
from quillon.llm import centroids, language_id, resampling
from quillon.llm.queries import QUERIES

WORD = re.compile("[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TEXTS = [None, "", " ,; ", "One", "one two ONE two", "Éa ñ٣x y 日本 a-b c_d 9z", "x" * 3_000 + " y " + "é" * 200 + " z", "word " * 30_000, "a b c d e f g h i j k l m n o p q r s t u"]


def features(text):
    w = WORD.findall((text or "").translate(LOWER))
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])], len(w)


def plain_ranks(docs, target, percent=25, buckets=10_000):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = Counter(bucket(f) for _, x in docs for f in features(x)[0]), Counter(bucket(f) for x in target for f in features(x)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1.0) * (s_all + buckets) / ((s[b] + 1.0) * (t_all + buckets))))
    rows = []
    for i, x in docs:
        f, n = features(x)
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain(bucket(y)) for y in f) // len(f) if f else 0
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, n >= 20])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for rank, r in enumerate(able[: percent * len(able) // 100], 1):
        r[4] = rank
    return sorted((tuple(r[:5]) for r in rows), key=repr)


def clashing(spark, rows):
    schema = "doc_id long, text string, lang string, id int, score int, weight int, rank int, n_features int, part int, run int, lang_pred int"
    return spark.createDataFrame([(*r, *range(8)) for r in rows], schema)


def test_pairs_of_words_have_the_checksum_of_their_bytes():
    one, two, at = resampling.feature_buckets(pa.array(TEXTS), 10_007)
    for k, text in enumerate(TEXTS):
        w = WORD.findall((text or "").translate(LOWER))
        assert one[at[k] : at[k + 1]].tolist() == [zlib.crc32(x.encode()) % 10_007 for x in w]
        assert two[at[k] : at[k + 1]].tolist() == [zlib.crc32(f"{a} {b}".encode()) % 10_007 for a, b in zip(w, w[1:])] + [-1] * bool(w)


@given(st.lists(st.lists(st.integers(0, 30)), min_size=1, max_size=9), st.data())
@settings(max_examples=100, deadline=None)
def test_tournament(runs, data):
    runs = [sorted((x, k, i) for i, x in enumerate(sorted(r))) for k, r in enumerate(runs)]
    wanted = sorted(x for r in runs for x in r)
    n = data.draw(st.integers(0, len(wanted)))
    assert list(resampling.Tournament(runs).take(n)) == wanted[:n]


@pytest.mark.parametrize("range_rows", [7, 1 << 18])
def test_importance_ranks(spark, range_rows):
    rng = random.Random(3)
    texts = TEXTS + [" ".join(rng.choice("red blue green wolf lamb cow".split()) for _ in range(rng.choice([5, 19, 20, 21, 80]))) for _ in range(150)]
    docs = [(i, t, "en") for i, t in enumerate(texts)]
    docs += [(5_000, "lamb cow " * 15, "en")] * 90 + [(None, "lamb cow " * 15, "en")] * 7 + [(6_000 + i, "lamb cow " * 15, None) for i in range(30)]
    rng.shuffle(docs)
    target = ["wolf lamb", None, "lamb lamb cow", ""]
    df = clashing(spark, docs).repartition(9)
    out = resampling.importance_ranks(df, spark.createDataFrame([(t,) for t in target], "text string"), range_rows=range_rows)
    assert out.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    rows = sorted((tuple(r) for r in out.collect()), key=repr)
    assert rows == plain_ranks([d[:2] for d in docs], target)
    drawn = resampling.drawn_documents(df, out)
    assert drawn.filter("text is null").count() == 0 and drawn.columns.count("rank") == 1


def test_importance_ranks_of_nothing(spark):
    empty, some = clashing(spark, []), clashing(spark, [(1, "a " * 25, None), (2, None, None)])
    assert resampling.importance_ranks(empty, some).count() == 0
    assert {(r.doc_id, r.n_features, r.rank) for r in resampling.importance_ranks(some, empty, percent=100).collect()} == {(1, 49, 1), (2, 0, None)}


# ----------------------------------------------------------------------------------------------------------------------


def plain_languages(train, texts, entries, longest=5, smoothing=0.5):
    """The same model, written out with dictionaries."""
    words = lambda t: language_id.LETTERS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").lower())
    langs = sorted({x for _, x in train})
    prior = Counter(x for _, x in train)
    counts = Counter((w, x) for t, x in train for w in words(t))
    marks = lambda w, n: [f"^{w}$"[i : i + n] for i in range(len(w) + 3 - n)]

    def level(c):
        by = defaultdict(dict)
        for (e, x), n in c.items():
            by[e][x] = n
        size = Counter()
        for d in by.values():
            size[math.floor(math.log2(sum(d.values())) * 8)] += len(d)
        held, least = 0, math.inf
        for b in sorted(size, reverse=True):
            if held + size[b] > entries:
                break
            held, least = held + size[b], b
        known = {e: d for e, d in by.items() if math.floor(math.log2(sum(d.values())) * 8) >= least}
        total = {x: sum(d.get(x, 0) for d in by.values()) for x in langs}
        return {e: [math.log((d.get(x, 0) + smoothing) / (total[x] + smoothing * (len(known) + 1))) for x in langs] for e, d in known.items()}

    known = level({k: n for k, n in counts.items() if len(k[0]) <= language_id.WORD_LENGTH})
    backs = []
    for n in range(longest, 0, -1):
        c = Counter()
        for (w, x), k in counts.items():
            for g in marks(w, n):
                c[g, x] += k
        backs.append((n, level(c)))

    def word(w):
        if w in known:
            return known[w]
        for n, back in backs:
            if found := [back[g] for g in marks(w, n) if g in back]:
                return [sum(v) / len(found) for v in zip(*found)]
        return [0.0] * len(langs)

    out = []
    for t in texts:
        w = words(t)
        if not w or not langs:
            out.append(("und", 0.0))
            continue
        total = [math.log(prior[x] / len(train)) + sum(word(y)[i] for y in w) for i, x in enumerate(langs)]
        best = max(range(len(langs)), key=lambda i: (total[i], -i))
        out.append((langs[best], 1 / sum(math.exp(v - total[best]) for v in total)))
    return out


@pytest.mark.parametrize("entries", [40, 1 << 17])
def test_language_id_against_dictionaries(spark, entries):
    rng = random.Random(5)
    stock = {"xx": "ana bobo cici dada éé ananas", "yy": "wolf lamb cow straße lambda", "zz": "日本 本日 кот Кошка"}
    train = [(" ".join(rng.choice(stock[x].split()) for _ in range(rng.randint(0, 12))) + rng.choice(["", "!?", "12"]), x) for x in stock for _ in range(15)]
    train += [(None, "xx"), ("", "yy")] + [("wolf wolf", "yy")] * 20
    tests = [*TEXTS, "anana lambs", "кошки", "Wolf's LAMB—ana", "1234 ٣ ’", "ωμέγα", "İstanbul cow"]
    rows = [(i, t, x) for i, (t, x) in enumerate(train)] + [(1_000 + i, t, None) for i, t in enumerate(tests)] + [(None, "cow", "xx")]
    df = clashing(spark, rows).repartition(5)
    model = language_id.fit(df, F.col("doc_id").isNotNull(), entries=entries)
    out = language_id.identify(df, model)
    found = {r.doc_id: (r.lang_pred, r.score) for r in out.collect()}
    for i, (lang, p) in enumerate(plain_languages(train, tests, entries)):
        assert found[1_000 + i][0] == lang and abs(found[1_000 + i][1] - p) < 1e-9, tests[i]
    assert out.columns.count("score") == 1 and found[1_000] == ("und", 0.0)


def test_language_id_without_training_rows(spark):
    df = clashing(spark, [(1, "some words", None), (2, None, None)])
    model = language_id.fit(df, F.lit(True))
    assert [(r.lang_pred, r.score) for r in language_id.identify(df, model).collect()] == [("und", 0.0)] * 2
    assert language_id.identify(clashing(spark, []), model).count() == 0


def test_language_query_on_the_held_out_fold(spark, duck):
    langs = dict(duck.execute("select doc_id, lang from documents").fetchall())
    rows = QUERIES["op12_language_id"](spark, SMALL).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == langs[r.doc_id] for r in rows if r.held_out]) > 0.95


# ----------------------------------------------------------------------------------------------------------------------


def plain_clusters(points, ids, clusters, rounds):
    order = sorted(range(len(points)), key=lambda i: (ids[i] is None, hashlib.sha256(f"1:{ids[i]}".encode()).hexdigest(), points[i].tolist()))[:clusters]
    c = points[order].copy()
    for step in range(rounds + 1):
        d = ((points[:, None, :] - c[None]) ** 2).sum(2)
        own = d.argmin(1)
        if step < rounds:
            for k in range(len(c)):
                if (own == k).any():
                    c[k] = points[own == k].sum(0) // (own == k).sum()
    return own, d[np.arange(len(points)), own], c


@pytest.mark.parametrize("spread", [1, 3, 1_000_000])
def test_exponion_search_finds_the_nearest_and_smallest(spread):
    """Small grids are full of ties."""
    rng = np.random.default_rng(spread)
    for _ in range(30):
        points, c = rng.integers(-spread, spread + 1, (80, 3)), rng.integers(-spread, spread + 1, (rng.integers(1, 9), 3))
        own, upper, lower = np.zeros(80, np.int64), np.full(80, np.inf), np.zeros(80)
        looked = 0
        for _ in range(5):
            balls = centroids.Balls(c)
            own, upper, lower, n = balls.assign(points, own, upper, lower)
            looked += n
            d = ((points[:, None, :] - c[None]) ** 2).sum(2)
            assert (own == d.argmin(1)).all()
            two = np.sort(d, 1)
            assert (upper >= np.sqrt(two[:, 0])).all() and (len(c) == 1 or (lower <= np.sqrt(np.where(np.arange(len(c)) == own[:, None], np.inf, d).min(1))).all())
            after = c.copy()
            for k in range(len(c)):
                if (own == k).any():
                    after[k] = points[own == k].sum(0) // (own == k).sum()
            upper, lower = centroids.loosened(own, upper, lower, balls.moved(after))
            c = after
        assert looked <= 5 * 80 * len(c)


def test_exponion_search_looks_at_few(spark):
    rng = np.random.default_rng(1)
    c = rng.integers(-1_000, 1_000, (64, 2))
    points = np.repeat(c, 200, 0) + rng.integers(-20, 21, (64 * 200, 2))
    own, upper, lower, _ = (balls := centroids.Balls(c)).assign(points, np.zeros(len(points), np.int64), np.full(len(points), np.inf), np.zeros(len(points)))
    moved = c + rng.integers(-2, 3, c.shape)
    upper, lower = centroids.loosened(own, upper, lower, balls.moved(moved))
    again, *_, looked = centroids.Balls(moved).assign(points, own, upper, lower)
    assert (again == ((points[:, None, :] - moved[None]) ** 2).sum(2).argmin(1)).all() and looked < 4 * len(points)


def test_exponion_clusters(spark):
    rng = np.random.default_rng(7)
    vectors = [(i, rng.normal(0, 0.05 if i % 2 else 1, 4).tolist()) for i in range(300)]
    vectors += [(400, [0.25] * 4)] * 150 + [(401 + i, [0.25, -0.5, 0.0, 0.0]) for i in range(50)] + [(None, [1.0] * 4), (500, [1e4] * 4)]
    odd = [(600, None), (601, [1.0] * 3), (602, [1.0, None, 1.0, 1.0]), (603, [math.nan, 0.0, 0.0, 0.0]), (604, [math.inf, 0.0, 0.0, 0.0]), (605, []), (606, [1.0] * 5)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in vectors + odd], "vec_id long, embedding array<double>, cluster int, v int").repartition(6)
    out = centroids.exponion_clusters(df, clusters=7, rounds=3, dim=4)
    points = np.floor(64 * np.array([v for _, v in vectors])).astype(np.int64)
    own, d, c = plain_clusters(points, [i for i, _ in vectors], 7, 3)
    sha = [hashlib.sha256(",".join(map(str, x)).encode()).hexdigest() for x in c.tolist()]
    wanted = [(i, int(k), int(x), int(d[own == k].sum()), int(d.sum()), sha[k]) for (i, _), k, x in zip(vectors, own, d)]
    assert sorted((tuple(r) for r in out.collect()), key=repr) == sorted(wanted, key=repr)


def test_exponion_clusters_of_few(spark):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert centroids.exponion_clusters(df([]), dim=2).count() == 0
    assert [(r.cluster, r.distance, r.inertia) for r in centroids.exponion_clusters(df([(1, [0.5, 0.5]), (1, [0.5, 0.5]), (2, None)]), dim=2).collect()] == [(0, 0, 0)] * 2
    with pytest.raises(Exception, match="too large"):
        centroids.exponion_clusters(df([(1, [1e30, 0.0])]), dim=2).collect()
