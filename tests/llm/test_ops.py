"""Each operator on rows with nulls, empty and long texts, ties, repeats, clashing columns, and on an empty table."""

import base64
import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import bpe, line_dedup, near_dedup, packing, sharding, substring_dedup, tiff, topk, toxicity
from quillon.llm.class_lm import class_lm_scores

JSON, RANKS, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
CLASH = "shard int, slot int, n_lines int, n_dropped int, removed int, toxicity int, toxic int, media int, n_bytes int, page int, samples int, feature int, ids int, decoded int, class_id int, key int, id int, digest int, unit int, block int"
SCHEMA = "doc_id long, text string, " + CLASH


def table(spark, rows):
    return spark.createDataFrame([(i, t, *range(20)) for i, t in rows], SCHEMA)


ROWS = [
    (1, None), (2, ""), (3, " "), (4, "one"), (5, "The quick brown fox jumps over the lazy dog.\nSecond line here."), (5, "The quick brown fox jumps over the lazy dog.\nSecond line here."),
    (6, "word " * 40_000), (7, "\n\n \t\n"), (None, "no id at all"), (8, "é ß 日本 <|endoftext|> 'll  x   y \r\n z "), (9, "The quick brown fox jumps over the lazy dog.\nsecond line here."),
]


def by_id(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.doc_id].append(r)
    return out


def test_sharding(spark):
    df = table(spark, ROWS * 10)
    out = sharding.uniform_shards(df, shards=4, source_rows=16, bucket_rows=8)
    rows = out.collect()
    assert len(rows) == len(ROWS) * 10 and out.columns.count("shard") == 1
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert sorted(map(len, slots.values())) == [27, 27, 28, 28] and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert Counter(r.text for r in rows) == Counter(t for _, t in ROWS * 10)
    assert sharding.uniform_shards(table(spark, [])).count() == 0


def test_equal_rows_spread_over_sources_and_buckets(spark):
    """Thousands of rows that are equal in every column: no task gets them all, and all places are filled."""
    df = spark.createDataFrame([(7, "same")] * 6_000 + [(i, f"t{i}") for i in range(2_000)], "doc_id long, text string").repartition(6)
    rows = sharding.uniform_shards(df, shards=5, source_rows=200, bucket_rows=100).select("doc_id", "shard", "slot").collect()
    equal = Counter(r.shard for r in rows if r.doc_id == 7)
    assert all(abs(n - 1_200) < 150 for n in equal.values()) and len(rows) == 8_000
    for shard in range(5):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(1_600))
    assert sharding.uniform_shards(df.limit(3), shards=300_000).count() == 3  # more shards than rows, or than the matrix has room for


def test_communication_matrix_margins_and_means():
    sizes = sharding.exact_sizes(103, 4)
    assert sizes.tolist() == [26, 26, 26, 25]
    total = np.zeros((3, 4))
    for seed in range(400):
        a = sharding.communication_matrix([50, 0, 53], sizes, seed)
        assert (a.sum(0) == sizes).all() and (a.sum(1) == [50, 0, 53]).all() and (a >= 0).all()
        total += a
    assert np.allclose(total[0] / 400, 50 * sizes / 103, atol=0.6)


@pytest.mark.parametrize(("good", "bad", "sample", "limit"), [(2_000_000_000, 30_000_000_000, 5_000, 10**9), (60, 340, 100, 10), (7, 3, 6, 1), (5, 0, 3, 1), (0, 50, 10, 1)])
def test_hypergeometric_beyond_numpy(monkeypatch, good, bad, sample, limit):
    monkeypatch.setattr(sharding, "NUMPY_LIMIT", limit)
    rng = np.random.default_rng(1)
    drawn = np.array([sharding.hypergeometric(rng, good, bad, sample) for _ in range(4000)])
    p, n = good / (good + bad), good + bad
    spread = sample * p * (1 - p) * (n - sample) / max(n - 1, 1)
    assert abs(drawn.mean() - sample * p) <= 5 * np.sqrt(spread / 4000) + 1e-9
    assert abs(drawn.var() - spread) <= 0.12 * spread + 1e-9 and drawn.min() >= max(0, sample - bad) and drawn.max() <= min(sample, good)


def test_communication_matrix_varies_as_a_permutation_does():
    """Covariances over many draws against those of shuffled labels, which are known."""
    counts, sizes = np.array([30, 50, 20]), np.array([40, 40, 20])
    draws = np.array([sharding.communication_matrix(counts.tolist(), sizes, seed) for seed in range(3000)])
    n = 100
    want = counts[:, None] * sizes[None, :] * (n - counts[:, None]) * (n - sizes[None, :]) / (n * n * (n - 1))
    assert np.allclose(draws.var(axis=0), want, rtol=0.12)
    assert np.isclose(np.cov(draws[:, 0, 0], draws[:, 1, 1])[0, 1], counts[0] * counts[1] * sizes[0] * sizes[1] / (n * n * (n - 1)), rtol=0.3)


def test_slots_are_uniform(spark):
    """Over many seeds a row comes to every shard and every quarter of it as often as to any other."""
    df = spark.range(64).selectExpr("id AS doc_id", "'x' AS text").coalesce(1)
    seen = np.zeros((64, 16))
    for seed in range(40):
        for r in sharding.uniform_shards(df, shards=4, seed=seed, source_rows=8, bucket_rows=4).collect():
            seen[r.doc_id, r.shard * 4 + r.slot // 4] += 1
    expected = 40 / 16
    chi2 = ((seen - expected) ** 2 / expected).sum()
    assert abs(chi2 - 64 * 15) < 5 * np.sqrt(2 * 64 * 15)


def key_of(line):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\x0b\x0c\r"))


def plain_line_dedup(rows):
    held = defaultdict(set)
    for i, t in rows:
        if i is None:
            continue
        for k in {key_of(x) for x in (t or "").split("\n")}:
            held[k].add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or len(key_of(x)) < 20 or len(held[key_of(x)]) < 3 or max(held[key_of(x)]) == i]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(spark):
    rows = [*ROWS, (10, "  THE QUICK brown fox jumps over the lazy dog.\t\nÉtude longue de vingt lettres\n"), (11, "étude longue de vingt lettres\nÉtude longue de vingt lettres"), (12, "x\nÉtude longue de vingt lettres\nx"), (20, "a line of two ids in three rows"), (20, "a line of two ids in three rows\nx"), (21, "A line of two ids in three rows")]
    out = line_dedup.line_dedup(table(spark, rows))
    assert sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in out.collect()), key=repr) == plain_line_dedup(rows)
    assert out.columns.count("n_lines") == 1 and line_dedup.line_dedup(table(spark, [])).count() == 0


def passages():
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    sentence = lambda n=9: " ".join([word().capitalize(), *(word() for _ in range(n - 1))]) + "."
    passage = " ".join(sentence() for _ in range(7))
    filler = lambda: " ".join(word() for _ in range(30))
    stock = sentence(12)
    return passage, [(i, f"{filler()} {passage} {filler()}\n{stock}") for i in range(101, 106)] + [(109, f"{stock} {filler()}")]


def test_substring_dedup_cuts_repeats_alone(spark):
    passage, rows = passages()
    out = by_id(substring_dedup.substring_dedup(table(spark, rows + ROWS)))
    assert passage in out[101][0].text and not out[101][0].removed
    for i in range(102, 106):
        (r,), text = out[i], dict(rows)[i]
        assert [text[s["start"] : s["end"]] for s in r.removed] == [passage] and text.replace(passage, "") == r.text
    assert out[109][0].text == dict(rows)[109]  # a stock phrase stays
    for i, t in ROWS:
        assert all(r.text == (t or "") and not r.removed for r in out[i])
    assert substring_dedup.substring_dedup(table(spark, [])).count() == 0


def test_substring_dedup_cuts_passages_inside_sentences(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    plain = " ".join(word() for _ in range(51))  # no mark at all
    marked = plain[:100] + '." ' + plain[100:]
    ideographic = " ".join("日本語。" + word() for _ in range(60))
    rows = []
    for n, passage in enumerate((plain, marked, ideographic)):
        rows += [(10 * n + i, f"The {word()} {word()} {passage} {word()} {word()}. End {word()}") for i in range(3)]
    rows.append((90, " ".join(plain.split()[:49])))  # too short
    out = by_id(substring_dedup.substring_dedup(table(spark, rows)))
    for n, passage in enumerate((plain, marked, ideographic)):
        for i in range(3):
            (r,), text = out[10 * n + i], dict(rows)[10 * n + i]
            assert [text[s["start"] : s["end"]] for s in r.removed] == ([passage] if i else [])
    assert not out[90][0].removed


def plain_windows(rows, size):
    """The kept words of each text: a window with an earlier occurrence goes."""
    seen, out = {}, {}
    for i, t in sorted(rows):
        ws = t.split()
        gone = set()
        for a in range(len(ws) - size + 1):
            before = seen.get(tuple(ws[a : a + size]))
            if before is not None and (before[0] != i or a - before[1] > 1):
                gone |= set(range(a, a + size))
            if before is None or (before[0] == i and a - before[1] == 1):
                seen[tuple(ws[a : a + size])] = (i, a) if before is None else before
        out[i] = [w for k, w in enumerate(ws) if k not in gone]
    return out


def test_substring_dedup_against_plain(spark):
    rng = random.Random(8)
    pool = [[f"w{rng.randint(0, 400)}" for _ in range(30)] for _ in range(40)]
    rows = [(i, " ".join(w for _ in range(rng.randint(0, 6)) for w in rng.choice(pool)[rng.randint(0, 9) : rng.randint(10, 30)])) for i in range(300)]
    out = by_id(substring_dedup.substring_dedup(table(spark, rows).repartition(7), min_words=12))
    expected = plain_windows(rows, 12)
    assert all(out[i][0].text.split() == expected[i] for i, _ in rows) and sum(map(len, expected.values())) < sum(len(t.split()) for _, t in rows)


def test_units_digest_depends_on_words_alone():
    a, b = (substring_dedup.units(pa.array([t])) for t in ("zz Yy one two three four five six seven eight. Tail x", "other Text. Yy one  two three four five six seven eight. end"))
    assert set(a["digest"].tolist()) & set(b["digest"].tolist())


@settings(max_examples=60, deadline=None)
@given(st.binary(max_size=3000))
def test_codecs_round_trip(data):
    for data in (data, data * 5, bytes(len(data))):
        assert tiff.packbits_decode(tiff.packbits_encode(data)) == data
        assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


def test_lzw_long_and_table_full():
    data = np.random.default_rng(0).integers(0, 256, 200_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data)) == data


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, 32])
def test_tiff_pages(compression, predictor, tile):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, 256, (70, 45), dtype=np.uint8), np.zeros((1, 1), np.uint8), np.tile(np.arange(64, dtype=np.uint8), (300, 1))]
    found = [a[:, :, 0] for _, a in tiff.tiff_decode(tiff.tiff_encode(pages, compression, predictor, tile))]
    assert len(found) == 3 and all((a == b).all() for a, b in zip(pages, found, strict=True))


def test_tiff_big_endian_16_bits_planar_and_float_predictor():
    import struct

    a = np.arange(24, dtype=np.uint16).reshape(3, 4, 2) * 2731
    planes = [a[:, :, k].astype(">u2").tobytes() for k in range(2)]
    entries = [(256, 3, 1, 4), (257, 3, 1, 3), (258, 3, 1, 16), (259, 3, 1, 1), (273, 4, 2, 8), (277, 3, 1, 2), (278, 3, 1, 3), (279, 4, 2, 16), (284, 3, 1, 2)]
    body = struct.pack(">2I2I", 24, 48, 24, 24) + b"".join(planes)
    ifd = struct.pack(">H", len(entries)) + b"".join(struct.pack(">HHI", t, k, n) + (struct.pack(">HH", v, 0) if k == 3 and n == 1 else struct.pack(">I", v)) for t, k, n, v in entries) + b"\0\0\0\0"
    data = b"MM\0*" + struct.pack(">I", 8 + len(body)) + body + ifd
    ((_, found),) = tiff.tiff_decode(data)
    assert (found == a).all()
    f = np.array([[1.5, -2.25, 3e10, 0.0]], np.float32)
    raw = f.astype(">f4").view(np.uint8).reshape(1, 4, 4).transpose(0, 2, 1).reshape(1, 16)
    coded = np.concatenate([raw[:, :1], np.diff(raw, axis=1)], axis=1)
    back = tiff._undo(np.ascontiguousarray(coded).view(np.uint32).reshape(1, 4, 1), 3)
    assert (np.ascontiguousarray(back[:, :, 0]).view(np.float32) == f).all()


def test_tiff_column(spark):
    df = table(spark, ROWS)
    stored = tiff.store_texts(df)
    pages = tiff.page_features(tiff.tiff_pages(stored)).collect()
    want = Counter((t or "").encode() for _, t in ROWS)
    assert Counter(r.samples[: r.n_bytes] for r in pages) == want and all(len(r.samples) % 64 == 0 and len(r.samples) >= 64 for r in pages)
    assert len({(r.media, r.feature) for r in pages}) == len({r.samples for r in pages})
    loop = bytearray(tiff.tiff_encode([np.zeros((2, 2), np.uint8)]))
    at = int.from_bytes(loop[4:8], "little")
    n = int.from_bytes(loop[at : at + 2], "little")
    loop[at + 2 + 12 * n : at + 6 + 12 * n] = at.to_bytes(4, "little")
    odd = spark.createDataFrame([(1, b"junk"), (2, None), (3, b""), (4, bytes(loop)), (5, b"II*\0\xff\xff\0\0")], "doc_id long, media binary")
    out = by_id(tiff.tiff_pages(odd))
    assert out[1][0].error and 2 not in out and out[3][0].error and [r.error is None for r in out[4]] == [True, False] and out[5][0].error
    assert tiff.tiff_pages(tiff.store_texts(table(spark, []))).count() == 0


def tiff_of(pages, tags=None):
    """A file of (bits, width, height, bytes of the one strip, compression) pages."""
    import struct

    out, link = bytearray(b"II*\0\0\0\0\0"), 4
    for bits, width, height, strip, compression in pages:
        at = len(out)
        out += strip + b"\0" * (len(strip) % 2)
        entries = [(256, width), (257, height), (258, bits), (259, compression), (273, at), (277, 1), (278, height), (279, len(strip))]
        struct.pack_into("<I", out, link, len(out))
        out += struct.pack("<H", len(entries)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def test_tiff_small_samples_and_pages_after_a_bad_one(spark):
    rng = np.random.default_rng(3)
    pages, want = [], []
    for bits in (1, 2, 4):
        a = rng.integers(0, 1 << bits, (5, 13), dtype=np.uint8)
        rows = [np.packbits(np.concatenate([np.unpackbits(np.array([x], np.uint8))[8 - bits :] for x in row])).tobytes() for row in a]
        pages.append((bits, 13, 5, tiff.packbits_encode(b"".join(rows)), tiff.PACKBITS))
        want.append(a.tobytes())
    pages.insert(1, (8, 4, 4, b"short", tiff.NONE))
    pages.insert(2, (3, 4, 4, b"odd width", tiff.NONE))
    out = sorted(tiff.tiff_pages(spark.createDataFrame([(1, tiff_of(pages))], "doc_id long, media binary")).collect(), key=lambda r: r.page)
    assert [r.error is None for r in out] == [True, False, False, True, True]
    assert [bytes(r.samples) for r in out if r.error is None] == want and [r.bits for r in out if r.error is None] == [1, 2, 4]


@pytest.fixture(scope="module")
def reference():
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe(spark, reference):
    out = bpe.decode(bpe.encode(table(spark, ROWS), RANKS, PATTERN), RANKS)
    found = Counter((r.doc_id, tuple(r.ids), bytes(r.decoded)) for r in out.collect())
    assert found == Counter((i, tuple(reference.encode_ordinary(t or "")), (t or "").encode()) for i, t in ROWS)
    assert bpe.encode(table(spark, []), RANKS, PATTERN).count() == 0
    some = spark.createDataFrame([(1, [0, 1]), (2, []), (3, None)], "doc_id long, ids array<int>")
    assert {r.doc_id: None if r.decoded is None else bytes(r.decoded) for r in bpe.decode(some, RANKS).collect()} == {1: b'!"', 2: b"", 3: None}


ODD = st.lists(st.sampled_from([" ", "  ", "\n", "\t", "a", "bc", "'s", "'", "ll", "12", "é", "!", "<|endoftext|>", "日本", "\r\n", " ", "x" * 30]), max_size=14).map("".join)


@settings(max_examples=300, deadline=None)
@given(ODD)
def test_packing_ids_are_the_tokenizers(text):
    encoder = packing._encoder(JSON, RANKS, PATTERN)
    flat, at = encoder.ids(pa.array([text, "", "a " + text, text]))
    wanted = [encoder.tokenizer.encode(t, add_special_tokens=False).ids + [packing.END_ID] for t in (text, "", "a " + text, text)]
    assert [flat[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == wanted


def test_packing(spark):
    df = table(spark, ROWS)
    pieces = packing.with_crc32(packing.pack_along_curve(df, JSON, RANKS, PATTERN, length=64)).collect()
    whole = Tokenizer.from_file(JSON)
    want = Counter((i, tuple(whole.encode(t or "", add_special_tokens=False).ids) + (0,)) for i, t in ROWS)
    assert sum(r.length for r in pieces) == sum(len(ids) * n for (_, ids), n in want.items())
    assert all(zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and r.length == len(r.ids) for r in pieces)
    once = defaultdict(lambda: defaultdict(list))
    for r in pieces:
        once[r.doc_id][r.start].append(r)
    for (i, ids), n in want.items():
        if n == 1:
            assert tuple(x for s in sorted(once[i]) for x in once[i][s][0].ids) == ids
    totals, offsets = Counter(), defaultdict(list)
    for r in pieces:
        totals[r.sequence_id] += r.length
        offsets[r.sequence_id].append((r.offset, r.length))
    assert all(n <= 64 and n & (n - 1) == 0 for n in totals.values())
    for o in offsets.values():
        o.sort()
        assert [x for x, _ in o] == [0, *np.cumsum([n for _, n in o])[:-1]]
    assert packing.pack_along_curve(table(spark, []), JSON, RANKS, PATTERN).count() == 0


def test_packing_follows_the_curve(spark):
    """Pieces in the order of sequences and places stand in the order of their documents on the curve, over partitions."""
    rng = random.Random(7)
    topics = [["alpha", "beta", "gamma"], ["le", "chat", "gris"], ["42", "17", "99"]]
    df = table(spark, [(i, " ".join(rng.choice(topics[i % 3]) for _ in range(rng.randint(1, 60)))) for i in range(120)])
    curve = {r.id: r.curve for r in packing.tokenised(df, JSON, RANKS, PATTERN).collect()}
    pieces = sorted(packing.pack_along_curve(df, JSON, RANKS, PATTERN, length=64, partitions=3).collect(), key=lambda r: (r.sequence_id, r.offset))
    along = [(curve[r.doc_id], r.doc_id, r.start) for r in pieces]
    assert along == sorted(along) and len({r.sequence_id >> 36 for r in pieces}) == 3


def test_hilbert_curve_is_one_path():
    points = np.stack(np.meshgrid(*[np.arange(8)] * 3, indexing="ij"), -1).reshape(-1, 3)
    keys = packing.hilbert_key(points, 3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(points[np.argsort(keys)], axis=0)).sum(1)
    assert (steps == 1).all()


def plain_top(rows, k):
    ints = {i: [int(np.floor(256.0 * x)) for x in v] for i, v in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q in (i for i in ints if i % 5 == 0):
        s = sorted(((-sum(a * b for a, b in zip(ints[q], ints[c], strict=False)), c) for c in ints if c != q))[:k]
        out += [(q, n + 1, c, -x) for n, (x, c) in enumerate(s)]
    return sorted(out)


@pytest.mark.parametrize("scale", [1.0, 1e6])
def test_topk(spark, scale):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(size=8) * (scale if i % 7 else 0.01)]) for i in range(300)]
    rows += [(300 + i, rows[3][1]) for i in range(40)] + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 8), (403, [float("inf")] * 8), (405, []), (410, [0.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, rank int, score int")
    out = topk.top_k(df, F.col("vec_id") % 5 == 0, k=5, query_rows=16, band_rows=50)
    assert sorted(tuple(r) for r in out.collect()) == plain_top(rows, 5)
    equal = spark.createDataFrame([(i, [float(x) for x in rng.permutation([3, -2, 1, 0.5, 4, 0, 0, -1])]) for i in range(200)], "vec_id long, embedding array<double>")
    out = topk.top_k(equal, F.col("vec_id") % 5 == 0, k=5, query_rows=8, band_rows=30)  # one length, several cells
    assert sorted(tuple(r) for r in out.collect()) == plain_top([tuple(r) for r in equal.collect()], 5)
    few = topk.top_k(df.limit(0), F.lit(True))
    assert few.count() == 0
    two = spark.createDataFrame([(0, [1.0]), (5, [2.0])], "vec_id long, embedding array<double>")
    assert sorted(tuple(r) for r in topk.top_k(two, F.lit(True)).collect()) == [(0, 1, 5, 131072), (5, 1, 0, 131072)]


@pytest.mark.parametrize("tasks", [2, 23])
def test_bpe_with_several_blocks_in_a_partition(spark, monkeypatch, tasks):
    """Blocks of some texts, rows of few words, and more or fewer tasks than the session has."""
    monkeypatch.setattr(bpe, "BLOCK", 3_000)
    monkeypatch.setattr(bpe, "ROW_CODES", 40)
    monkeypatch.setattr(bpe, "tasks_for", lambda *a: tasks)
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé日 ") for _ in range(rng.randint(1, 9)))
    rows = [(i, " ".join(word() for _ in range(rng.choice([0, 3, 60, 400])))) for i in range(150)] + [(i, "one and the same text ") for i in range(200, 260)]
    plain = tiktoken.Encoding("r", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    out = bpe.decode(bpe.encode(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), RANKS, PATTERN), RANKS).collect()
    want = dict(rows)
    assert len(out) == len(rows) and all(r.ids == plain.encode_ordinary(want[r.doc_id]) and bytes(r.decoded).decode() == want[r.doc_id] for r in out)


def test_toxicity_of_texts_longer_than_a_slice(spark):
    long = "word " * 1_000_000  # 5 MB
    docs = table(spark, [(i, ("vile " if i % 2 else "kind ") + f"w{i} x{i % 7}") for i in range(60)] + [(100, long + "vile"), (101, long)])
    model = toxicity.fit(docs, spark.createDataFrame([(i, i % 2) for i in range(60)] + [(100, 1), (101, 0)], "doc_id long, toxic int"))
    out = {r.doc_id: r.toxicity for r in toxicity.score(docs, model).collect()}
    assert out[100] > out[101] and out[1] > 0.5 > out[0]


def test_toxicity_learns_pairs():
    rng = np.random.default_rng(0)
    rows, terms, labels = [], [], []
    for i in range(3000):
        a, b = rng.random() < 0.5, rng.random() < 0.5
        own = {int(x) for x in rng.integers(10, 2000, 20)} | ({1} if a else set()) | ({2} if b else set())
        rows += [i] * len(own)
        terms += sorted(own)
        labels.append(float(a and b))
    model = toxicity.fit_arrays(np.array(rows), np.array(terms), np.array(labels), bits=12)
    raw = lambda ts: toxicity._logistic(toxicity._raw(model.bias, model.weights, model.vectors, np.zeros(len(ts), int), np.array(ts), 1))[0]
    assert raw([1, 2]) > 0.9 and raw([1]) < 0.3 and raw([2]) < 0.3
    assert model.vectors[1] @ model.vectors[2] > 0


def test_toxicity_learns_pairs_of_neutral_terms():
    rng = np.random.default_rng(2)
    rows, terms, labels = [], [], []
    for i in range(8000):
        a = rng.random() < 0.1
        b = rng.random() < 0.1
        own = {int(x) for x in rng.integers(10, 2000, 20)} | ({1} if a else set()) | ({2} if b else set())
        rows += [i] * len(own)
        terms += sorted(own)
        labels.append(float(a and b or not a and not b and rng.random() < 0.1))
    rows, terms, labels = np.array(rows), np.array(terms), np.array(labels)
    assert all(abs(labels[np.unique(rows[terms == t])].mean() - labels.mean()) < 0.04 for t in (1, 2))
    model = toxicity.fit_arrays(rows, terms, labels, bits=12)
    assert not model.weights[1] and not model.weights[2]
    raw = lambda ts: toxicity._logistic(toxicity._raw(model.bias, model.weights, model.vectors, np.zeros(len(ts), int), np.array(ts), 1))[0]
    assert raw([1, 2]) > 0.5 and raw([1]) < 0.3 and raw([2]) < 0.3


@pytest.mark.parametrize("part_rows", [100, 4_096])
def test_toxicity_vectors_cost_no_held_out_loss(spark, monkeypatch, part_rows):
    """Terms that the label goes with, terms that it doesn't, and a pair that matters; learnt in one part or in several."""
    monkeypatch.setattr(toxicity, "PART_ROWS", part_rows)
    rng = random.Random(3)
    rows = []
    for i in range(1_400):
        a, b, vile = rng.random() < 0.35, rng.random() < 0.35, rng.random() < 0.12
        label = int(vile and rng.random() < 0.95 or a and b and rng.random() < 0.9)
        ws = [f"w{rng.randrange(300):03d}" for _ in range(25)] + ["group"] * a + ["insult"] * b + ["vile"] * vile
        rng.shuffle(ws)
        rows.append((i, " ".join(ws), label))
    docs = table(spark, [(i, t) for i, t, _ in rows])
    model = toxicity.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows if i < 900], "doc_id long, toxic int"))
    held = pa.array([t for i, t, _ in rows if i >= 900]), np.array([y for i, _, y in rows if i >= 900], float)
    with_pairs = toxicity._losses(model.score(held[0]), held[1]).mean()
    alone = toxicity._losses(toxicity.ToxicityModel(model.bias, model.weights, np.zeros_like(model.vectors)).score(held[0]), held[1]).mean()
    assert with_pairs <= alone
    assert toxicity.fit(docs, spark.createDataFrame([(i, 1) for i in range(9)], "doc_id long, toxic int")).score(held[0]).min() > 0.99


def test_toxicity_on_held_out_texts(spark):
    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 7)))
    rows, labels = [], []
    for i in range(800):
        bad = i % 5 == 0
        ws = [word() for _ in range(40)] + (["Vile!", "nasty,"] if bad else [])
        rng.shuffle(ws)
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    docs = table(spark, rows + [(None, "x"), (2000, None), (2001, "")])
    lab = spark.createDataFrame(labels + [(None, 1), (3, None)], "doc_id long, toxic int")
    model = toxicity.fit(docs, lab.filter("doc_id < 500 or doc_id is null"))
    out = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    assert all(out[i].toxic == y and 0 <= out[i].toxicity <= 1 for i, y in labels if i >= 500)
    assert out[2000].toxic == out[2001].toxic == 0 and out[2000].toxicity == out[2001].toxicity
    empty = toxicity.fit(docs, lab.limit(0))
    assert toxicity.score(docs, empty).filter("toxic = 1").count() == 0
    assert toxicity.score(table(spark, []), model).count() == 0


def plain_base(rows, train):
    toks = [(i, [w.encode().lower().decode() for w in (t or "").replace("\x0b", " ").split()] + [None]) for i, t in rows]
    c = Counter()
    for i, ws in toks:
        if train(i):
            c.update(ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(np.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, ws in toks), key=repr)


def lm_rows():
    rng = random.Random(2)
    en, fr = ["the", "cat", "sat", "on", "mat", "dog", "ran"], ["le", "chat", "est", "sur", "tapis", "chien", "va"]
    return [(i, " ".join(rng.choice(en if i % 2 else fr) for _ in range(30))) for i in range(200)]


def test_class_lm(spark):
    rows = [*lm_rows(), (500, None), (501, ""), (502, "THE  Cat"), (503, "unseen words here"), (503, "unseen words here")]
    out = class_lm_scores(table(spark, rows), F.col("doc_id") % 5 != 0).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out), key=repr) == plain_base(rows, lambda i: i % 5 != 0)
    held = [r for r in out if r.held_out and r.n_tokens > 10]
    assert held and all(r.held_out == (r.doc_id % 5 == 0) for r in out)
    assert sum(r.score for r in held) > sum(r.base_score for r in held) and all(r.score < 0 for r in out)
    none = class_lm_scores(table(spark, rows), F.lit(None).cast("boolean")).collect()
    assert all(r.held_out and r.n_known == 0 and r.train_tokens == 0 for r in none)
    assert class_lm_scores(table(spark, []), F.lit(True)).count() == 0


def plain_scores(rows, train, classes):
    """log10 probability of each text by the class model, from word classes alone."""
    from quillon.llm import class_lm as lm

    count = {w: n for w, (n, _) in classes.items()}
    in_class = np.zeros(lm.CLASSES)
    for n, c in classes.values():
        in_class[c] += n
    texts = [(i, (t or "").replace("\x0b", " ").lower().split()) for i, t in rows]
    n_docs = sum(train(i) for i, _ in texts)
    trans, rare = defaultdict(Counter), Counter()  # class before -> class after; class before -> words seen once
    words_once = 0
    for i, ws in texts:
        if train(i):
            before, before_once = lm.BORDER, False
            for w in [*ws, None]:
                now = lm.BORDER if w is None else classes[w][1]
                once = w is not None and count[w] == 1
                for state in (before, *([lm.UNSEEN] if before_once else [])):
                    trans[state][now] += 1
                    rare[state] += once
                words_once += once
                before, before_once = now, once
    total = in_class.sum() + n_docs
    share = (words_once + 1) / (total + 2)
    out = []
    for i, ws in texts:
        p, before = 0.0, lm.BORDER
        for w in [*ws, None]:
            n = sum(trans[before].values())
            unseen = (rare[before] + lm.KAPPA * share) / (n + lm.KAPPA)
            if w is not None and w not in classes:
                p, before = p + np.log10(unseen), lm.UNSEEN
                continue
            now = lm.BORDER if w is None else classes[w][1]
            prior = (n_docs if w is None else in_class[now]) / total
            p += np.log10((trans[before][now] + lm.MU * prior) / (n + lm.MU) * (1 - unseen))
            if w is not None:
                p += np.log10(count[w] / in_class[now])
            before = now
        out.append((i, round(float(p), 6)))
    return sorted(out)


def test_class_lm_against_plain(spark):
    """Several blocks and partitions: the likelihood of the class bigrams and all scores, from the words' classes."""
    from quillon.llm import class_lm as lm

    rows = [*lm_rows(), *[(300 + i, f"once{i} the cat le chat nonce{i} ran") for i in range(40)], (500, None), (501, "")]
    df = table(spark, rows).repartition(9, "doc_id")
    out = sorted((r.doc_id, round(r.score, 6)) for r in lm.class_lm_scores(df, F.col("doc_id") % 5 != 0).collect())
    source = df.select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).alias("text"), (F.col("doc_id") % 5 != 0).alias("train"))
    coded = lm.coded_corpus(source, 4)
    assert coded.select("block").distinct().count() == 9
    vocab = lm.vocabulary(coded, 4)
    known, seen = lm.exchange(coded, vocab, 4)
    classes = {r.word: (r.n, r["class"]) for r in lm.word_classes(vocab, known).collect()}
    assert {w: n for w, (n, _) in classes.items()} == dict(Counter(w for i, t in rows if i % 5 for w in (t or "").split()))
    assert out == plain_scores(rows, lambda i: i % 5 != 0, classes)

    def plain_likelihood(of):
        n = np.zeros((lm.CLASSES + 1, lm.CLASSES + 1))
        for i, t in rows:
            if i % 5 and (t or "").split():
                cs = [lm.EDGE, *(of(w) for w in t.split()), lm.EDGE]
                for a, b in zip(cs[:-1], cs[1:], strict=True):
                    n[a, b] += 1
        return lm.likelihood(n)

    assert np.isclose(seen[0], plain_likelihood(lambda w: lm.first_class(w.encode())))
    assert np.isclose(max(seen), plain_likelihood(lambda w: classes[w][1])) and max(seen) > seen[0]


def test_class_lm_probabilities_sum_to_one():
    from quillon.llm import class_lm as lm

    rng = np.random.default_rng(3)
    seen = rng.integers(0, 50, (lm.STATES, lm.STATES)).astype(float)
    seen[lm.UNSEEN], seen[:, lm.UNSEEN] = 0, 0
    n = seen.sum(axis=0)
    in_class = n[: lm.CLASSES] + n[lm.CLASSES + 2 :]
    p = 10 ** lm.transition_logs(seen, in_class, int(n[lm.BORDER])).reshape(lm.STATES, lm.STATES)
    assert np.allclose(p[:, : lm.CLASSES + 2].sum(axis=1), 1)


def shingle_set(t):
    w = (t or "").encode().lower().decode().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_near_duplicates(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    base = [[word() for _ in range(120)] for _ in range(30)]
    rows = []
    for k, ws in enumerate(base):
        rows.append((k * 100, " ".join(ws)))
        for j in range(1, 1 + (60 if k == 0 else 3)):
            copy = list(ws)
            copy[rng.randrange(120)] = word()
            rows.append((k * 100 + j, " ".join(copy)))
        rows.append((k * 100 + 90, " ".join(ws)))  # exact
        half = ws[:60] + [word() for _ in range(60)]
        rows.append((k * 100 + 95, " ".join(half)))  # no near copy
    out = near_dedup.near_duplicate_classes(table(spark, rows + [(5000, None), (5001, ""), (5002, " "), (5003, "a b"), (5004, "A  b"), (None, "a b"), (5003, "a b")]))
    cls = {r.doc_id: r.class_id for r in out.collect()}
    assert len(cls) == len(rows) + 5
    for k in range(30):
        assert {cls[i] for i, _ in rows if i // 100 == k and i % 100 != 95} == {k * 100} and cls[k * 100 + 95] == k * 100 + 95
    assert cls[5000] == cls[5001] == 5000 and cls[5002] == 5002 and cls[5004] == cls[5003] == 5003
    assert near_dedup.near_duplicate_classes(table(spark, [])).count() == 0
    kept = near_dedup.drop_near_duplicates(table(spark, rows))
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in rows if cls[i] == i}


def plain_links(rows, threshold):
    """{(i, j): weighted Jaccard} of rows whose similarity is at least threshold, from all pairs."""
    counted = {i: Counter(shingle_list(t)) for i, t in rows}
    df = Counter(x for c in counted.values() for x in c)
    n = len(rows)
    idf = {x: 1 + near_dedup.IDF * np.log((n + 1) / k) / np.log(n + 2) for x, k in df.items()}
    w = {i: {x: (1 + near_dedup.TF * np.log(k)) * idf[x] for x, k in c.items()} for i, c in counted.items()}
    out, ids = {}, sorted(w)
    for k, i in enumerate(ids):
        for j in ids[k + 1 :]:
            both = sum(min(w[i][x], w[j][x]) for x in w[i].keys() & w[j].keys())
            either = sum(w[i].values()) + sum(w[j].values()) - both
            if either and both >= threshold * either:
                out[i, j] = both / either
    return out


def shingle_list(t):
    w = t.lower().split()
    return [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []


def copies_of(rng, word, origin, n, changes, chain=0.3):
    """n texts, each a changed copy of the origin or, with a probability of chain, of an earlier copy."""
    made = [origin]
    for _ in range(n):
        copy = list(rng.choice(made) if rng.random() < chain else origin)
        for _ in range(rng.choice(changes)):
            copy[rng.randrange(len(copy))] = word()
        made.append(copy)
    return [" ".join(x) for x in made]


def test_near_duplicates_lose_no_link(spark, monkeypatch):
    """One large group with copies of copies, and many small groups, by bands of similarity."""
    monkeypatch.setattr(near_dedup, "SMALL", 4)
    monkeypatch.setattr(near_dedup, "BLOCK_BYTES", 60_000)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    large = copies_of(rng, word, [word() for _ in range(150)], 250, [1, 2, 3, 4, 5])
    some = [t for _ in range(10) for t in copies_of(rng, word, [word() for _ in range(100)], 6, [1, 2, 3])]
    rows = list(enumerate(large + some))
    links = plain_links(rows, 0.79)
    cls = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(table(spark, rows)).collect()}
    for low, high in ((0.805, 0.85), (0.85, 0.9), (0.9, 1.1)):  # hashed counters of frequencies move a similarity by some thousandths
        band = [(i, j) for (i, j), s in links.items() if low <= s < high]
        assert len(band) > 20 and all(cls[i] == cls[j] for i, j in band)
    root = {i: i for i, _ in rows}
    for i, j in sorted(links):  # and no classes but those of the links
        a, b = root[i], root[j]
        if a != b:
            root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    assert all(root[i] == root[c] for i, c in cls.items()) and len(set(cls.values())) > 11


def test_near_duplicates_of_one_id_with_several_texts(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(5))
    a, b = ([word() for _ in range(80)] for _ in range(2))
    rows = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join([*a[:-1], word()])), (3, " ".join([*b[:-1], word()])), (4, " ".join(b))]
    cls = {r.doc_id: r.class_id for r in near_dedup.near_duplicate_classes(table(spark, rows)).collect()}
    assert cls == {1: 1, 2: 1, 3: 1, 4: 1}


def test_block_links_and_prefixes_against_pairs():
    rng = random.Random(10)
    word = lambda: rng.choice("abcdefghijklmnopqrstuvw")
    texts = copies_of(rng, word, [word() for _ in range(60)], 40, [1, 2, 4]) + ["a b", "a b c d e f"]
    idf = near_dedup.idf_weights(*(lambda c: (c, 42))(np.bincount(near_dedup.counter_of(near_dedup.shingles(pa.array(texts))[1]), minlength=1 << near_dedup.DF_BITS)))
    n = len(texts)
    left, right = (pa.array([texts[k] for k in x]) for x in zip(*[(i, j) for i in range(n) for j in range(n)], strict=True))
    s = np.concatenate([near_dedup.weighted_jaccard(left[k : k + 500], right[k : k + 500], idf) for k in range(0, n * n, 500)]).reshape(n, n)
    t = pa.table({"node": [bytes([i]) for i in range(n)], "root": [bytes([i]) for i in range(n)], "bands": [[1] * near_dedup.BANDS] * n, "text": texts})
    found = near_dedup.block_links(t, t, idf, 0.8, 0)
    assert sorted(found) == sorted((bytes([i]), bytes([j])) for i in range(n) for j in range(n) if i != j and s[i, j] >= 0.8)
    assert not near_dedup.block_links(t, t, idf, 0.8, 1)  # they share the first band already
    rows, hashes = near_dedup.prefixes(pa.array(texts), idf, 0.8)
    own = [set(hashes[rows == i].tolist()) for i in range(n)]
    assert all(own[i] & own[j] for i in range(n) for j in range(n) if s[i, j] >= 0.8) and sum(map(len, own)) < 0.4 * sum(len(set(shingle_list(t))) for t in texts)


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 101), (101, 102), (100, 102), (7, 7)]
    out = near_dedup.components(spark.createDataFrame(edges, "a long, b long"))
    roots = {r.node: r.root for r in out.collect()}
    assert all(roots[i] == 0 for i in range(61)) and roots[102] == roots[100] == 100
