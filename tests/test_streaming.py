"""The streamed ledger in chunks, passes that fail, and notifications."""

import os
import random

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quillon.operators.state import Ledger, Log
from quillon.streaming import sightings as S


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(1, 4), st.booleans()), max_size=60))
@settings(max_examples=150, deadline=None)
def test_chunked_log_is_the_log(steps):
    """Chunks of three changes, kept as a store keeps them: what was not written down is lost between batches."""
    store: dict[int, tuple[list[int], list[int]]] = {}
    plain, reads = Log(), []

    def read(number):
        reads.append(number)
        moments, rents = store[number]
        return list(moments), list(rents)

    chunked, size = S.ChunkedLog([], [], read), S.CHUNK
    S.CHUNK = 3
    try:
        for epoch, rent, new_batch in steps:
            if new_batch:
                store |= {n: chunked.held[n] for n in chunked.changed}
                chunked = S.ChunkedLog(list(chunked.starts), list(chunked.numbers), read)
            assert chunked.around(epoch) == plain.around(epoch)
            chunked.add(epoch, rent)
            plain.add(epoch, rent)
        found = [pair for n in chunked.numbers for pair in zip(*(chunked.held.get(n) or store[n]))]
        assert found == [(e, r) for e, _, r in plain.rows]
    finally:
        S.CHUNK = size


def test_a_batch_reads_the_chunks_it_needs():
    store = {n: ([1_000 * n + i for i in range(S.CHUNK)], [n] * S.CHUNK) for n in range(500)}
    reads = []
    log = S.ChunkedLog([1_000 * n for n in range(500)], list(range(500)), lambda n: reads.append(n) or store[n])
    ledger = Ledger(499_999, 7, log)
    for epoch in (250_010, 250_020, 3_005):
        ledger.sight(epoch, 9)
    assert set(reads) == {250, 3} and log.changed <= {250, 3, 500, 501}


def test_stream_over_many_batches_with_a_large_key(spark, tmp_path):
    """One key has half of the rows and more changes than a chunk holds."""
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 2, 3]), i, rng.randrange(5_000), rng.choice([None, *range(50)])) for i in range(2_400)]
    schema = "key long, seq long, at_epoch long, rent long"
    ledgers, want = {}, []
    for key, seq, at, rent in rows:
        new, current, previous, delta, drop, logged = ledgers.setdefault(key, Ledger()).sight(at, rent)
        want.append((key, seq, new, current, rent, previous, delta, drop, logged))
    assert len(ledgers[1].log.rows) > 2 * S.CHUNK
    for part in range(4):
        spark.createDataFrame(rows[part * 600 : part * 600 + 600], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        out = S.run_available(spark, f"{tmp_path}/in", schema, f"{tmp_path}/cp", f"{tmp_path}/out")
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[1]) == want


class Calls(dict):
    """A map state that counts what it is asked."""

    def __init__(self):
        self.reads = self.writes = 0

    def getValue(self, key):
        self.reads += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.writes += 1
        self[key] = value


def test_a_bucket_of_many_keys_is_one_group(monkeypatch):
    """Each key is read and written once a batch, however many there are; a long one has its chunks apart."""
    monkeypatch.setattr(S, "CHUNK", 24)
    monkeypatch.setattr(S, "FRAME", 50)
    rng, ledgers, processor = random.Random(5), {}, S.Sightings()
    processor.ledgers, processor.chunks = Calls(), Calls()
    for batch in range(4):
        rows = [(rng.choice([None, 0, 0, 0, 2**62 + 1, *range(3, 40)]), 1_000 * batch + i, rng.randrange(400), rng.choice([None, *range(9)])) for i in range(400)]
        want = []
        for key, seq, at, rent in rows:
            new, current, previous, delta, drop, logged = ledgers.setdefault(key, Ledger()).sight(at, rent)
            want.append((key, seq, new, current, rent, previous, delta, drop, logged))
        rng.shuffle(rows)
        frame = pd.DataFrame({"key": [r[0] or 0 for r in rows], "keyless": [r[0] is None for r in rows], "seq": [r[1] for r in rows], "at_epoch": [r[2] for r in rows], "rent": [r[3] or 0 for r in rows], "unknown": [r[3] is None for r in rows]})
        frame = frame.astype({c: np.int64 for c in ("key", "seq", "at_epoch", "rent")})
        processor.ledgers.reads = processor.ledgers.writes = 0
        out = pd.concat(processor.handleInputRows((7,), iter([frame[:150], frame[150:]]), None)).astype(object)
        found = [tuple(None if v is pd.NA else v for v in r) for r in out.itertuples(index=False)]
        assert sorted(found, key=lambda r: r[1]) == want
        assert processor.ledgers.reads == processor.ledgers.writes == len({r[0] for r in rows})
    long = {k: len(v.log.rows) for k, v in ledgers.items() if len(v.log.rows) > S.CHUNK}
    assert {k[:2] for k in processor.chunks} == {(k or 0, k is None) for k in long} and len(long) < len(ledgers) and long[0] > 2 * S.CHUNK


def test_a_pass_is_one_batch_in_few_partitions(spark, tmp_path):
    """Files of a pass hold any of its rows; keys are null, or no doubles; the session asks for 200 partitions."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2**62 + 1, 2**62 + 2]), i, rng.randrange(300), rng.choice([None, *range(50)])) for i in range(600)]
    ledgers, want = {}, []
    for key, seq, at, rent in rows:
        new, current, previous, delta, drop, logged = ledgers.setdefault(key, Ledger()).sight(at, rent)
        want.append((key, seq, new, current, rent, previous, delta, drop, logged))
    schema, asked = "key long, seq long, at_epoch long, rent long", spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        for part in (rows[:300], rows[300:]):
            spark.createDataFrame(part, schema).repartition(3).write.mode("append").parquet(f"{tmp_path}/in")
            out = S.run_available(spark, f"{tmp_path}/in", schema, f"{tmp_path}/cp", f"{tmp_path}/out", files_per_batch=None)
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", asked)
    assert sorted((tuple(r) for r in out.collect()), key=lambda r: r[1]) == want
    assert sorted(n for n in os.listdir(f"{tmp_path}/out") if n.startswith("batch=")) == ["batch=0", "batch=1"]
    assert sum(n.isdigit() for n in os.listdir(f"{tmp_path}/cp/state/0")) == 2 * spark.sparkContext.defaultParallelism


def test_watch_goes_on_after_a_pass_that_failed():
    ran, told = [], []

    def one():
        ran.append(len(ran))
        if len(ran) == 2:
            raise ValueError("no answer")

    assert S.watch(one, range(4), lambda number, message: told.append((number, message))) == 3
    assert ran == [0, 1, 2, 3] and told == [(1, "ValueError: no answer")]


def test_an_event_is_sent_again_only_if_its_note_is_missing(spark, tmp_path):
    events = spark.createDataFrame([("a",), ("b",), ("a",)], "key string")
    ledger, sent = f"{tmp_path}/ledger", []
    send = lambda fresh, batch: sent.append((batch, sorted({r.key for r in fresh.collect()}))) or True
    assert S.notify_once(events, ledger, 1, send) and not S.notify_once(events, ledger, 1, send)
    assert S.notify_once(events.union(spark.createDataFrame([("c",)], "key string")), ledger, 2, send)
    with pytest.raises(OSError):
        S.notify_once(spark.createDataFrame([("d",)], "key string"), ledger, 3, lambda fresh, batch: (_ for _ in ()).throw(OSError("stopped")))
    assert S.notify_once(spark.createDataFrame([("d",)], "key string"), ledger, 3, send)
    assert sent == [(1, ["a", "b"]), (2, ["c"]), (3, ["d"])]
    assert sorted(map(tuple, spark.read.parquet(ledger).select("key", "batch_id").collect())) == [("a", 1), ("b", 1), ("c", 2), ("d", 3)]
