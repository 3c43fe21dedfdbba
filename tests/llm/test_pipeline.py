"""Each stage of the pipeline against a brute-force version, over rows with nulls, repeats, copies and passages."""

import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from test_ops import plain_line_dedup, plain_links, plain_windows
from tokenizers import Tokenizer

import corpus_pipeline as c
from quillon.llm.queries_models import toxicity_model


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    """Rows of documents and a folder with documents and labels."""
    rng = random.Random(12)
    pool = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(3, 8))) for _ in range(1500)]
    word = lambda: rng.choice(pool)
    some = lambda n: " ".join(word() for _ in range(n))
    stock, passage = some(9), some(60)
    rows, labels = [], []
    for i in range(160):
        bad = i % 8 == 0
        text = some(rng.randint(20, 90)) + (" vile Nasty, scum" if bad else "")
        if i % 5 == 1:
            text += "\n" + stock
        if i % 7 == 2:
            text = some(10) + " " + passage + " " + text
        rows.append((i, text))
        labels.append((i, int(bad)))
    for i in range(160, 200):  # copies, some of them near
        ws = dict(rows)[rng.randrange(40, 80)].split(" ")
        if i % 2:
            ws[rng.randrange(len(ws))] = word()
        rows.append((i, " ".join(ws)))
    rows += [(200, None), (201, ""), (None, rows[50][1]), (None, None), rows[60], rows[61], (202, " \n "), (203, some(3000))]
    df = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    folder = str(tmp_path_factory.mktemp("sf"))
    df.repartition(5).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    return rows, df, folder


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)


def test_toxicity(spark, corpus):
    rows, df, folder = corpus
    model = toxicity_model(spark, folder, df)
    score = model.score(pa.array([t or "" for _, t in rows]))
    kept = pairs(c.toxicity(spark, df, folder))
    assert kept == sorted((r for r, p in zip(rows, score, strict=True) if p < 0.3), key=repr)
    ids = {i for i, _ in kept}
    assert not [i for i in range(0, 160, 8) if i in ids] and sum(i in ids for i in range(160) if i % 8) >= 133


def test_line_dedup(spark, corpus):
    rows, df, folder = corpus
    want = sorted(((i, text) for i, _, _, text in plain_line_dedup(rows)), key=repr)
    assert pairs(c.line_dedup(spark, df, folder)) == want and sum(len(t) for _, t in want) < sum(len(t or "") for _, t in rows)


def test_near_dedup(spark, corpus):
    rows, df, folder = corpus
    texts = {i: t or "" for i, t in rows if i is not None}
    root = {i: i for i in texts}

    def join(i, j):
        a, b = sorted((root[i], root[j]))
        for k in root:
            root[k] = a if root[k] == b else root[k]

    for i, j in plain_links(list(texts.items()), 0.8):
        join(i, j)
    first = {}
    for i in sorted(texts):
        join(i, first.setdefault(texts[i], i))
    want = sorted(((i, t) for i, t in rows if i is None or root[i] == i), key=repr)
    assert pairs(c.near_dedup(spark, df, folder)) == want and len(want) < len(rows) - 25


def test_substring_dedup(spark, corpus):
    rows, df, folder = corpus
    own = {i: t or "" for i, t in rows if i is not None}
    want = plain_windows(list(own.items()), 50)
    out = c.substring_dedup(spark, df, folder).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    for r in out:
        assert r.text.split() == want[r.doc_id] if r.doc_id is not None else r.text in (rows[50][1], "")
    assert sum(map(len, want.values())) < sum(len(t.split()) for t in own.values())


def test_packing(spark, corpus):
    rows, df, folder = corpus
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = defaultdict(list)
    for i, t in rows:
        want[i].append(len(whole.encode(t or "", add_special_tokens=False).ids) + 1)
    got, full = defaultdict(int), defaultdict(int)
    for r in c.packing(spark, df, folder).collect():
        got[r.doc_id] += r.length
        full[r.sequence_id] += r.length
    assert got == {i: sum(n) for i, n in want.items()}
    assert all(n <= 1024 and n & (n - 1) == 0 for n in full.values())


def test_run(spark, corpus):
    """All stages one after the other, and each over an empty table."""
    _, df, folder = corpus
    docs = df
    for name, stage in c.STAGES[:-1]:
        empty = stage(spark, df.limit(0), folder)
        assert empty.columns == c.COLUMNS and empty.count() == 0, name
        docs = c.written(stage(spark, docs, folder), name)
    want = sorted(tuple(r) for r in c.STAGES[-1][1](spark, docs, folder).select("doc_id", "length", "ids_crc32").na.fill(-1).collect())
    assert sorted(tuple(r) for r in c.run(spark, folder).select("doc_id", "length", "ids_crc32").na.fill(-1).collect()) == want
    assert c.STAGES[-1][1](spark, df.limit(0), folder).count() == 0
    assert np.isfinite(len(want))
