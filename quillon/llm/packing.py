"""Packing along a space-filling curve: neighbouring documents share sequences.

Each document is tokenised once, its hashed token vector is projected to ``DIMENSIONS`` numbers, and their place on a
Hilbert curve is its key. Documents are range-partitioned and sorted by that key, and each partition is cut into
sequences of ``length`` tokens. What is left at a partition's end is cut into sequences whose lengths are powers of
two, so nothing is padded.
"""

from __future__ import annotations

import zlib
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillon.llm.bpe import IRREGULAR, read_ranks
from quillon.llm.common import mix64, slices, tasks_for, text_bytes, written

DIMENSIONS, KEY_BITS = 4, 12
#: Distinct words that a worker remembers; then it starts anew.
REMEMBERED = 500_000
#: Bytes of text whose distinct words are looked up at a time: the more, the fewer look-ups.
WORDS_BYTES = 12 << 20
SPECIAL = "<|endoftext|>"
#: Where the next id ends a document.
END_ID = 0


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file of 2^16 ids at most.

    A text is cut before its spaces: no pre-token reaches over a space that something else precedes, so the words are
    encoded apart and each distinct one once, by the rank file of the same vocabulary. Texts with a special token's
    string, or with white space that such cuts would not leave whole, go to the tokenizer as they are.
    """

    def __init__(self, path: str, ranks: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.one = tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=read_ranks(ranks), special_tokens={}).encode_ordinary
        self.known: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def word(self, word: str) -> bytes:
        """Ids of a word or words that are cut from what stands before them, as 16-bit numbers."""
        found = self.known.get(word)
        if found is None:
            found = self.known[word] = array("H", self.one(word)).tobytes()
        return found

    def ids(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(16-bit ids of all texts one after the other, each followed by the end id; offsets of the texts)."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        listed = texts.to_pylist()
        whole = np.fromiter((SPECIAL in t or bool(IRREGULAR.search(t)) for t in listed), bool, len(listed))
        cut = pc.split_pattern(pc.if_else(pa.array(whole), "", texts), " ")  # one empty word stands for a whole text
        coded = cut.flatten().dictionary_encode()
        sizes = np.asarray(pc.list_value_length(cut), dtype=np.int64)
        # entries: words after a space, the end, then the texts' beginnings
        entries = [self.word(" " + w) for w in coded.dictionary.to_pylist()]
        end = len(entries)
        entries.append(array("H", [END_ID]).tobytes())
        entries += [self.whole(t) if w else self.word(t.partition(" ")[0]) for t, w in zip(listed, whole.tolist(), strict=True)]
        ends = np.cumsum(sizes + 1)
        codes = np.full(int(ends[-1]) if len(ends) else 0, end, np.int64)
        inner = np.ones(len(codes), bool)
        inner[ends - 1] = False
        codes[inner] = np.asarray(coded.indices)
        codes[ends - sizes - 1] = end + 1 + np.arange(len(listed))
        table = np.frombuffer(b"".join(entries), np.uint16)
        length = np.fromiter(map(len, entries), np.int64, len(entries)) // 2
        each = length[codes]
        total = np.concatenate([[0], np.cumsum(each)])
        flat = table[np.repeat((np.cumsum(length) - length)[codes] - total[:-1], each) + np.arange(int(total[-1]))]
        return flat, total[np.concatenate([[0], ends])]


_encoders: dict[tuple, Encoder] = {}


def _encoder(*paths: str) -> Encoder:
    if paths not in _encoders:
        _encoders[paths] = Encoder(*paths)
    return _encoders[paths]


def token_directions(size: int = 1 << 16, dimensions: int = DIMENSIONS, seed: int = 2) -> np.ndarray:
    """A hashed, normally distributed direction of each id; ids of rarer merges (larger numbers) weigh more."""
    h = mix64(np.arange(size * dimensions), seed)
    u, v = ((h >> np.uint64(32)).astype(np.float64) + 0.5) / 2**32, (h & np.uint64(0xFFFFFFFF)).astype(np.float64) / 2**32
    normal = np.sqrt(-2 * np.log(u)) * np.cos(2 * np.pi * v)
    return (normal.reshape(size, dimensions) * np.log2(2.0 + np.arange(size))[:, None]).astype(np.float32)


def hilbert_key(points: np.ndarray, bits: int = KEY_BITS) -> np.ndarray:
    """Places on the Hilbert curve of points (rows) whose coordinates are whole numbers below 2^bits (Skilling 2004)."""
    x = points.astype(np.int64).copy()
    n = x.shape[1]
    q = 1 << (bits - 1)
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[:, i] & q) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, i]) & p)
            x[:, 0] = np.where(high, x[:, 0] ^ p, x[:, 0] ^ swap)
            x[:, i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[:, i] ^= x[:, i - 1]
    t = np.zeros(len(x), np.int64)
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where(x[:, n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    x ^= t[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = key << 1 | (x[:, i] >> b & 1)
    return key


def tokenised(docs: DataFrame, path: str, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, curve (the Hilbert key) and ids (16-bit, little-endian, with the end id) of each document."""

    def encode(batches):
        encoder, directions = _encoder(path, ranks, pattern), token_directions()
        for batch in slices(batches, "text", WORDS_BYTES):
            flat, at = encoder.ids(batch["text"])
            means = np.add.reduceat(directions[flat], at[:-1], axis=0).astype(np.float64)
            means /= np.maximum(np.linalg.norm(means, axis=1, keepdims=True), 1e-12)
            points = np.clip(((means + 1) / 2 * (1 << KEY_BITS)).astype(np.int64), 0, (1 << KEY_BITS) - 1)
            ids = pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer((2 * at).astype(np.int32)), pa.py_buffer(flat.astype("<u2"))])
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(hilbert_key(points)), ids], names=["id", "curve", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(encode, "id long, curve long, ids binary")


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack_along_curve(docs: DataFrame, path: str, ranks: str, pattern: str, length: int = 1024, id_col: str = "doc_id", text_col: str = "text", partitions: int | None = None) -> DataFrame:
    """``path``: the tokenizers file whose ids are packed; ``ranks``: its vocabulary as a rank file; ``pattern``: of its
    pre-tokens.

    Packs documents into sequences of at most ``length`` tokens (a power of two); one row per piece:
    id_col, ``start`` (the document's ids before it), ``length``, ``ids``, ``doc_tokens``, ``sequence_id``, ``offset``
    (its place in the sequence).

    Every sequence is full or has a power of two of tokens, so none needs padding. Null and empty texts are the end
    id alone. Null ids stay null. Repeated rows are packed as often as they occur, ties on the curve go by id, then by
    content. Only id and text are read; other columns are not returned. An empty table gives no rows.
    """
    spark = docs.sparkSession
    table = written(tokenised(docs, path, ranks, pattern, id_col, text_col), "tokens")
    n = partitions or tasks_for(spark, text_bytes(table, "ids"))

    def pack(batches):
        base = TaskContext.get().partitionId() << 36  # so many partitions keep their order along the curve
        made = 0
        held: list[tuple] = []  # pieces of the sequence that is not full yet: (id, start, ids, doc_tokens)
        filled = 0

        def rows(parts: list[tuple]):
            ids = [p[2] for p in parts]
            lengths = np.array([len(x) for x in ids], np.int64)
            flat = np.concatenate(ids).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(lengths)]), pa.int32()), pa.array(flat))
            column = lambda k: pa.array([p[k] for p in parts], pa.int64())
            return pa.RecordBatch.from_arrays(
                [column(0), column(1), pa.array(lengths), lists, column(3), column(4), column(5)], names=[id_col, "start", "length", "ids", "doc_tokens", "sequence_id", "offset"]
            )

        def close(parts: list[tuple]) -> list[tuple]:
            nonlocal made
            out, at = [], 0
            for i, start, ids, total in parts:
                out.append((i, start, ids, total, base + made, at))
                at += len(ids)
            made += 1
            return out

        done, size = [], 0
        for batch in batches:
            for i, ids in zip(batch["id"].to_pylist(), batch["ids"], strict=True):
                ids = np.frombuffer(ids.as_buffer(), "<u2")
                at = 0
                while at < len(ids):
                    take = min(length - filled, len(ids) - at)
                    held.append((i, at, ids[at : at + take], len(ids)))
                    at, filled = at + take, filled + take
                    if filled == length:
                        done += close(held)
                        held, filled, size = [], 0, size + length
                if size >= 1 << 20:
                    yield rows(done)
                    done, size = [], 0
        for power in _powers(filled):  # the rest, in sequences of 2^k tokens
            part, need = [], power
            while need:
                i, start, ids, total = held.pop(0)
                part.append((i, start, ids[:need], total))
                if len(ids) > need:
                    held.insert(0, (i, start + need, ids[need:], total))
                need -= min(need, len(ids))
            done += close(part)
        if done:
            yield rows(done)

    return (
        table.repartitionByRange(n, "curve", "id", F.xxhash64("ids"))
        .sortWithinPartitions("curve", "id", F.xxhash64("ids"))
        .mapInArrow(pack, f"`{id_col}` long, start long, length long, ids array<int>, doc_tokens long, sequence_id long, offset long")
    )


def with_crc32(pieces: DataFrame) -> DataFrame:
    """pieces with ``ids_crc32``: of the ids as little-endian unsigned 32-bit numbers. A column of that name is replaced."""
    pieces = pieces.drop("ids_crc32")
    names = pieces.columns

    def add(batches):
        for batch in batches:
            lists = batch["ids"]
            at = np.asarray(lists.offsets, dtype=np.int64)
            flat = np.ascontiguousarray(np.asarray(lists.values), dtype="<u4")
            sums = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums, pa.int64())], names=[*names, "ids_crc32"])

    return pieces.mapInArrow(add, T.StructType([*pieces.schema.fields, T.StructField("ids_crc32", T.LongType())]))
