import hashlib
import zlib

import numpy as np
import pytest
from same import rows_of, rows_of_sql

from conftest import SMALL
from quillon.llm.queries import ORACLES, QUERIES


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    found = rows_of(QUERIES[name](spark, SMALL))
    assert found[1]
    if name in ORACLES:
        assert found == rows_of_sql(duck, ORACLES[name])


def test_registry():
    assert {int(n[2:].split("_")[0]) for n in QUERIES} == set(range(1, 14)) and set(ORACLES) <= set(QUERIES)


def test_tiff_query_against_plain(spark, duck):
    docs = dict(duck.execute("select doc_id, text from documents").fetchall())
    for r in QUERIES["op3_tiff"](spark, SMALL).collect():
        b = docs[r.doc_id].encode()
        p = b + b"\0" * (-len(b) % 64 if b else 64)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.error) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), None)


def test_toxicity_query_on_the_held_out_fold(spark, duck):
    labels = dict(duck.execute("select doc_id, toxic from labels").fetchall())
    rows = QUERIES["op7_toxicity"](spark, SMALL).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and (r.score >= 0.3) == bool(r.predicted) for r in rows)
    seen = [(r.predicted, labels[r.doc_id]) for r in rows if r.doc_id in labels]
    assert np.mean([p == y for p, y in seen]) > 0.85


def test_pipeline_stages(spark):
    import corpus_pipeline as c

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    n = docs.count()
    for name, stage in c.STAGES[:-1]:
        docs = c.written(stage(spark, docs, SMALL), name)
        assert docs.columns == c.COLUMNS
        assert docs.count() <= n and docs.count() >= 0.6 * n, name
        assert docs.filter("n_chars <> char_length(text)").count() == 0
    pieces = c.STAGES[-1][1](spark, docs, SMALL)
    assert pieces.select("doc_id").distinct().count() == docs.count()
    assert [k for k, _ in c.STAGES] == ["toxicity", "line_dedup", "near_dedup", "substring_dedup", "packing"]
