"""Byte-level BPE encoding and decoding with a global shuffle of distinct words.

Texts are cut into words, whose positions are kept as codes into the dictionary of their block. The dictionaries' words
are shuffled by word; each distinct word of the corpus is encoded once, its ids come back to every block that has it,
and documents are put together again by position. Decoding joins ids with the table of token bytes, which has the
size of the vocabulary.

A word is one or more whole pre-tokens: a text is cut before its spaces, over which no pre-token reaches unless more
white space precedes them. Texts where it does are cut into the pre-tokens themselves.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.blocks import MEET, Block, blocks, blocks_met, by_bucket, meet, meet_rows, pack_words, squeeze, unpack_words, unsqueeze
from quillon.llm.common import give_back, tasks_for, text_bytes

#: Words of the documents that travel in one row and are put together at a time, one longer document aside.
ROW_CODES = 1 << 17

#: Bytes of text in a block.
BLOCK = 8 << 20

#: White space that cuts before spaces would not leave in whole pre-tokens.
IRREGULAR = re.compile(r"\s \s|\s \Z")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of base64 and number on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, f))}


_encodings: dict[tuple, object] = {}


def _encoding(path: str, pattern: str):
    if (path, pattern) not in _encodings:
        import tiktoken

        _encodings[path, pattern] = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=read_ranks(path), special_tokens={})
    return _encodings[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and ``ids``: the token ids of each row's whole text, each match of pattern encoded by the ranks of path.

    Null and empty texts have no ids. Null ids stay; repeated rows come out as often as they went in. Other columns
    are not returned. An empty table gives no rows. docs must give its rows in the same order again (tables do); if
    it doesn't, the job fails rather than mixing words up.
    """
    buckets = tasks_for(docs.sparkSession, text_bytes(docs, text_col))
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    split = regex.compile(pattern).findall

    def code(block: Block, part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
        """Words of each text, and all their codes; new words get the next places in the block's index."""
        index, texts = block.index, part["text"]
        odd = np.array([bool(IRREGULAR.search(t)) for t in texts.to_pylist()], bool)
        even = texts.filter(pa.array(~odd))
        parts = pc.split_pattern(even, " ")
        lengths = np.zeros(len(odd), np.int64)
        lengths[~odd] = np.asarray(pc.list_value_length(parts))
        coded = parts.flatten().dictionary_encode()
        place = np.fromiter((index[" " + w] for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
        flat = place[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.int64)
        starts = np.cumsum(lengths[~odd]) - lengths[~odd]
        flat[starts] = np.fromiter((index[t.partition(" ")[0]] for t in even.to_pylist()), np.int64, len(even))  # no space before it
        if not odd.any():
            return lengths, flat
        pieces = [split(t) for t in texts.filter(pa.array(odd)).to_pylist()]
        lengths[odd] = [len(x) for x in pieces]
        codes = np.zeros(int(lengths.sum()), np.int64)
        own = np.repeat(odd, lengths)
        codes[~own] = flat
        codes[own] = [index[p] for x in pieces for p in x]
        return lengths, codes

    def words(batches):
        for block in blocks(batches, code, BLOCK):
            known = [w.encode() for w in block.index]
            found = [(b, block.number, squeeze(at), pack_words([known[i] for i in at.tolist()])) for b, at in by_bucket(known, buckets)]
            columns = list(zip(*found, strict=True)) or [()] * 4
            kinds = (pa.int32(), pa.int64(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["bucket", "block", "places", "words"])
            del block, known, found, columns

    def once(batches):
        """Each distinct word that comes to this partition is encoded once."""
        one = _encoding(path, pattern).encode_ordinary  # each match of the pattern apart
        known: dict[bytes, list[int]] = {}
        for batch in batches:
            out = []
            for number, places, packed in zip(*(batch[c].to_pylist() for c in ("block", "places", "words")), strict=True):
                ids = []
                for word in unpack_words(packed):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = one(word.decode())
                    ids.append(found)
                out.append((number, 0, [], squeeze(unsqueeze(places)[0], np.fromiter(map(len, ids), np.uint32, len(ids)), np.fromiter((i for x in ids for i in x), np.uint32))))
            yield meet_rows(out)
            del out, batch
        known.clear()
        give_back()

    def keep(block: Block, part: pa.RecordBatch) -> None:
        lengths, codes = code(block, part)
        ends, at = np.concatenate([[0], np.cumsum(lengths)]), 0
        while at < len(lengths):
            to = min(at + 512, len(lengths), max(at + 1, int(np.searchsorted(ends, ends[at] + ROW_CODES, side="right")) - 1))
            block.kept.append((part["id"].slice(at, to - at).to_pylist(), squeeze(lengths[at:to], codes[ends[at] : ends[to]])))
            at = to

    def documents(batches):
        for block in blocks(batches, keep, BLOCK):
            for ids, data in block.kept:
                yield meet_rows([(block.number, 1, ids, data)])
            del block

    def table(packed: list[bytes]):
        parts = [unsqueeze(p) for p in packed]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        places, lengths, ids = (np.concatenate(x).astype(np.int64) for x in zip(*parts, strict=True))
        length, start = np.zeros(len(places), np.int64), np.zeros(len(places), np.int64)
        length[places], start[places] = lengths, np.cumsum(lengths) - lengths
        return length, start, ids.astype(np.int32)

    def assemble(batches):
        for (length, start, ids), doc_ids, sizes, codes in blocks_met(batches, table):
            each = length[codes]
            total = np.cumsum(each)
            flat = ids[np.repeat(start[codes] - (total - each), each) + np.arange(int(total[-1]) if len(total) else 0)]
            ends = np.concatenate([[0], total])[np.concatenate([[0], np.cumsum(sizes)])]
            yield pa.RecordBatch.from_arrays([pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[id_col, "ids"])

    dictionary = rows.mapInArrow(words, "bucket int, block long, places binary, words binary").repartition(buckets, "bucket").mapInArrow(once, MEET)
    return meet(dictionary, rows.mapInArrow(documents, MEET), buckets).mapInArrow(assemble, f"`{id_col}` long, ids array<int>")


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """``encoded`` with ``decoded``: the bytes of the tokens of ids_col, joined. Null ids give null; an id outside the
    vocabulary fails the job. A column called decoded is replaced."""
    keep = [f for f in encoded.schema.fields if f.name != "decoded"]
    names = [f.name for f in keep]
    ranks = read_ranks(path)
    table = [b""] * (max(ranks.values(), default=-1) + 1)
    for token, rank in ranks.items():
        table[rank] = token
    shared = encoded.sparkSession.sparkContext.broadcast(table)  # the vocabulary

    def join(batches):
        tokens = pa.array(shared.value, pa.large_binary())
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                lists = part[ids_col]
                ends = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64))])
                joined = tokens.take(lists.flatten())  # their bytes stand one after the other
                if not len(joined):
                    raw = pa.array([b""] * len(lists), pa.large_binary())
                else:
                    bounds = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
                    raw = pa.Array.from_buffers(pa.large_binary(), len(lists), [None, pa.py_buffer(np.ascontiguousarray(bounds[ends])), joined.buffers()[2]])
                raw = pc.if_else(lists.is_valid(), raw, None).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([*(part[c] for c in names), raw], names=[*names, "decoded"])
                del part, lists, joined, raw
            del batch
            give_back()

    return encoded.mapInArrow(join, T.StructType([*keep, T.StructField("decoded", T.BinaryType())]))
