"""Substring dedup on exact windows of words: keep the earliest occurrence of a repeated passage, remove the rest.

A window is ``min_words`` consecutive words of a document (A-Z in lower case, white space ignored), wherever it starts:
line breaks, sentence ends and capitals play no part. A word goes if a window over it has an earlier occurrence (by id,
then place), so every verbatim passage of at least ``min_words`` words is found to its first and last word. The offsets
of the removed runs in the original text are returned.

Windows need not be exchanged one by one: each has a key, the smallest hash of the runs of half as many words in it.
Equal windows have equal keys, and neighbouring windows mostly share theirs, so a row holds a key and the hashes of all
neighbours that share it; only those whose key occurs more than once are compared.

A worker first compares the windows of the slice of documents that it holds: only the earliest of each in a slice is
exchanged, so a passage that a third of all documents hold costs one row for each slice, not for each document.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.common import mix64, slices, word_hashes, words

WORD = re.compile("[^\x20\x09-\x0d]+")
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def units(texts: pa.Array, size: int = 8) -> dict[str, np.ndarray]:
    """The windows of ``size`` words of each text, in order: ``doc`` (row), ``start`` (first word, counted in the text),
    ``digest`` and ``key``."""
    dictionary, codes, at = words(texts)
    part = (size + 1) // 2
    n = len(codes)
    if n < size:
        return {"doc": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "digest": np.zeros(0, np.uint64), "key": np.zeros(0, np.uint64)}
    with np.errstate(over="ignore"):
        power = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE)]), dtype=np.uint64)
        total = np.concatenate([[np.uint64(0)], np.cumsum(word_hashes(dictionary)[codes] * power[:-1], dtype=np.uint64)])
        del power, codes
        inverse = np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, BASE_INVERSE)]), dtype=np.uint64)
        hashed = mix64((total[size:] - total[:-size]) * inverse[: n - size + 1])
        key = mix64((total[part:] - total[:-part]) * inverse[: n - part + 1], 3)
    del total, inverse
    width, done = size - part + 1, 1  # the smallest of so many, by doubling
    while done < width:
        step = min(done, width - done)
        key = np.minimum(key[:-step], key[step:])
        done += step
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = np.flatnonzero(row[: n - size + 1] == row[size - 1 :])  # the rest reach over a text's end
    row = row[whole]
    return {"doc": row, "start": whole - at[row], "digest": hashed[whole], "key": key[whole]}


def _rows(batch: pa.RecordBatch, size: int) -> pa.RecordBatch:
    """Runs of neighbouring windows of the slice: of its earliest windows with one key, or of repeats (``dup``)."""
    ids, t = np.asarray(batch["id"], dtype=np.int64), np.asarray(batch["t"], dtype=np.int64)
    order = np.lexsort((t, ids))
    ids, t = ids[order], t[order]
    first = np.append(True, (ids[1:] != ids[:-1]) | (t[1:] != t[:-1]))  # rows that repeat id and text are one
    ids, t = ids[first], t[first]
    row, at, hashed, key = units(batch["text"].take(pa.array(order[first])), size).values()
    n = len(row)
    order = np.argsort(hashed, kind="stable")
    again = np.append(False, hashed[order][1:] == hashed[order][:-1])
    # one word over and over is not its own repeat
    beside = np.append(False, (row[order][1:] == row[order][:-1]) & (at[order][1:] - at[order][:-1] == 1))
    apart = np.cumsum(again & ~beside)
    head = np.maximum.accumulate(np.where(again, 0, np.arange(n)))
    dup = np.zeros(n, bool)
    dup[order] = apart > apart[head] if n else False
    new = np.ones(n, bool)
    new[1:] = (row[1:] != row[:-1]) | (at[1:] != at[:-1] + 1) | (dup[1:] != dup[:-1]) | ~dup[1:] & (key[1:] != key[:-1])
    start = np.flatnonzero(new)
    count = np.diff(np.append(start, n))
    dup_run, row, at = dup[start], row[start], at[start]
    some = mix64(ids[row].astype(np.uint64) * np.uint64(1_000_003) + at.astype(np.uint64), 5)  # spreads the repeats
    offsets = np.concatenate([[0], np.cumsum(np.where(dup_run, 0, count))])
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.where(dup_run, some, key[start]).view(np.int64)),
            pa.array(ids[row]),
            pa.array(t[row]),
            pa.array(at.astype(np.int32)),
            pa.array(np.where(dup_run, count, 1).astype(np.int32)),
            pa.array(dup_run),
            pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(hashed[~dup].view(np.int64))),
        ],
        names=["key", "id", "t", "at", "n", "dup", "hashes"],
    )


def _spans(text: str, marks: np.ndarray, min_words: int) -> list[tuple[int, int]]:
    """Offsets of the runs of words below the marked windows, given as (first window, how many)."""
    place = [m.span() for m in WORD.finditer(text)]
    change = np.zeros(len(place) + 1, np.int64)
    np.add.at(change, marks[:, 0], 1)
    np.add.at(change, marks[:, 0] + marks[:, 1] + (min_words - 1), -1)
    edge = np.flatnonzero(np.diff(np.concatenate([[0], np.cumsum(change) > 0]).astype(np.int8)))
    return [(place[a][0], place[b - 1][1]) for a, b in edge.reshape(-1, 2).tolist()]


def substring_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with repeated passages cut from ``text`` and, added, ``removed``: array of (start, end), the cut
    passages' offsets in the original text, in code points.

    Of a passage of at least ``min_words`` words that occurs in several places the one with the smallest id, then the
    first in it, stays; one word over and over does not repeat itself within its document. Ids are integers. Null
    texts are empty; empty texts and texts of fewer than ``min_words`` words stay. Rows with a null id stay whole and
    are no one's earlier occurrence. Rows that repeat an id and text are one document: all are cut alike; of different
    texts with one id the one with the smallest hash comes first. An empty table gives no rows. A column of docs
    called removed is replaced; names that start with ``__`` are reserved.
    """
    docs = docs.drop("removed")
    rows = docs.withColumn(text_col, F.coalesce(F.col(text_col), F.lit(""))).withColumn("__t", F.xxhash64(F.lit(10), text_col))

    def windows_of(batches):
        for batch in slices(batches, "text"):
            yield _rows(batch, min_words)

    found = (
        rows.filter(F.col(id_col).isNotNull())
        .select(F.col(id_col).cast("long").alias("id"), F.col("__t").alias("t"), F.col(text_col).alias("text"))
        .mapInArrow(windows_of, "key long, id long, t long, at int, n int, dup boolean, hashes array<long>")
        .withColumn("__c", F.count(F.lit(1)).over(Window.partitionBy("key")))
        .filter(F.col("dup") | (F.col("__c") > 1))
        .select("key", "id", "t", "at", "n", "dup", F.posexplode_outer("hashes").alias("i", "hash"))
        .withColumn("__rank", F.rank().over(Window.partitionBy("key", "hash").orderBy("id", "t")))  # one document's own repeats are dup
        .filter(F.col("dup") | (F.col("__rank") > 1))
        .groupBy(F.col("id").alias("__id"), F.col("t").alias("__of"))
        .agg(F.collect_list(F.struct((F.col("at") + F.coalesce("i", F.lit(0))).alias("at"), "n")).alias("__marks"))
    )
    joined = rows.join(found, (rows[id_col].cast("long") == found["__id"]) & (rows["__t"] == found["__of"]), "left")
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*docs.schema.fields, T.StructField("removed", span)])
    names = docs.columns
    at = names.index(text_col)

    def cut(batches):
        for batch in slices(batches, text_col):
            spans = [[] for _ in range(batch.num_rows)]
            kept = batch[text_col].to_pylist()
            for i in np.flatnonzero(np.asarray(batch["__marks"].is_valid())):
                m, t = batch["__marks"][i].values, kept[i]
                spans[i] = _spans(t, np.stack([np.asarray(m.field(0), dtype=np.int64), np.asarray(m.field(1), dtype=np.int64)], axis=1), min_words)
                ends = [0, *(x for pair in spans[i] for x in pair), len(t)]
                kept[i] = "".join(t[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))
            columns = [batch[c] for c in names]
            columns[at] = pa.array(kept, pa.string())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            columns.append(pa.array([[{"start": a, "end": b} for a, b in s] for s in spans], kind))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "removed"])

    return joined.select(*[F.col(f"`{c}`") for c in names], "__marks").mapInArrow(cut, schema)
