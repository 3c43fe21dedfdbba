"""Corpora as blocks: each block of documents has a dictionary of its distinct words, and documents are codes into it.

A block is some tens of MB of consecutive text of one input partition. Its dictionary goes through a global shuffle
by word, where each distinct word of the corpus is treated once; what is found comes back to the block and meets the
documents' codes there. A word that a third of all tokens are costs one row for each block.

The dictionaries and the codes come from two scans of the same input. A block is named by a digest of its texts, so the
two scans agree wherever they run; if the input gave its rows in another order the second time, a block lacks its
dictionary and the job fails. Give such an input as a table.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame

from quillon.llm.common import SLICE_BYTES, give_back, slices

BLOCK_BYTES = 16 << 20


def squeeze(*arrays: np.ndarray) -> bytes:
    """Whole numbers below 2^32 as bytes: the arrays' lengths, then low, middle and high bytes apart, compressed."""
    head = np.array([len(arrays), *(len(a) for a in arrays)], "<u4").tobytes()
    flat = np.concatenate([np.asarray(a, np.uint32) for a in arrays]) if arrays else np.zeros(0, np.uint32)
    planes = flat.astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(head + np.ascontiguousarray(planes).tobytes(), 3)


def unsqueeze(data: bytes | pa.Buffer) -> list[np.ndarray]:
    raw = zstandard.decompress(data)
    count = int(np.frombuffer(raw, "<u4", 1)[0])
    lengths = np.frombuffer(raw, "<u4", count, 4).astype(np.int64)
    planes = np.frombuffer(raw, np.uint8, offset=4 + 4 * count).reshape(4, -1)
    flat = np.ascontiguousarray(planes.T).view("<u4").ravel()
    return np.split(flat, np.cumsum(lengths)[:-1]) if count else []


def pack_words(words: list[bytes]) -> bytes:
    return zstandard.compress(np.array([len(words), *map(len, words)], "<u4").tobytes() + b"".join(words), 3)


def unpack_words(data: bytes) -> list[bytes]:
    raw = zstandard.decompress(data)
    n = int(np.frombuffer(raw, "<u4", 1)[0])
    ends = 4 + 4 * n + np.concatenate([[0], np.cumsum(np.frombuffer(raw, "<u4", n, 4).astype(np.int64))])
    return [raw[a:b] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]


class Index(dict):
    """Word -> place of its first appearance."""

    def __missing__(self, word):
        self[word] = at = len(self)
        return at


class Block:
    """What has been read of a block: its index, a digest of its texts, and what the reader keeps."""

    def __init__(self):
        self.index, self.digest, self.bytes, self.kept, self.extra = Index(), hashlib.blake2b(digest_size=8), 0, [], np.zeros(0, np.int64)

    @property
    def number(self) -> int:
        return int.from_bytes(self.digest.digest(), "little", signed=True)


def blocks(batches, read: Callable[[Block, pa.RecordBatch], None], limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """Reads batches (columns id and text) slice by slice into blocks, and yields each block when it is full."""
    block = None
    for part in slices(batches, "text", SLICE_BYTES):
        block = block or Block()
        texts = part["text"]
        sizes = pc.fill_null(pc.binary_length(texts), 0)
        block.digest.update(np.asarray(sizes).tobytes())
        if texts.buffers()[2] is not None:
            at = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            block.digest.update(memoryview(texts.buffers()[2])[int(at[0]) : int(at[-1])])
        block.bytes += int(pc.sum(sizes).as_py() or 0)
        read(block, part)
        if block.bytes >= limit:
            yield block
            block = None
    if block is not None:
        yield block
    del block
    give_back()


def by_bucket(words: list[bytes], buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """(bucket, places) of the words: a bucket's words all meet in one place of the global shuffle."""
    bucket = np.fromiter(map(zlib.crc32, words), np.int64, len(words)) % buckets
    order = np.argsort(bucket, kind="stable")
    cut = np.flatnonzero(np.diff(bucket[order])) + 1
    for part in np.split(order, cut) if len(order) else []:
        yield int(bucket[part[0]]), part


#: Rows that meet in a block: its dictionary (kind 0, ``data`` as the operator packs it) and its documents (kind 1,
#: ``ids`` and packed code lengths and codes).
MEET = "block long, kind int, ids array<long>, data binary"


def meet(dictionary: DataFrame, documents: DataFrame, n: int) -> DataFrame:
    """Both kinds of rows of each block together in n tasks, the dictionary first."""
    return dictionary.unionByName(documents).repartition(n, "block").sortWithinPartitions("block", "kind")


def meet_rows(rows: list[tuple]) -> pa.RecordBatch:
    """A batch of MEET from (block, kind, ids, data)."""
    kinds = (pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.binary())
    columns = list(zip(*rows, strict=True)) or [()] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["block", "kind", "ids", "data"])


def blocks_met(batches, start: Callable[[list[bytes]], object]):
    """Yields (what start makes of a block's dictionary rows, ids, code lengths, codes) for each document row."""
    block, held, known = None, [], None
    for batch in batches:
        numbers, kinds = batch["block"].to_pylist(), batch["kind"].to_pylist()
        for i, (number, kind) in enumerate(zip(numbers, kinds, strict=True)):  # one row's data at a time
            if number != block:
                block, held, known = number, [], None
            if kind == 0:
                held.append(batch["data"][i].as_py())
                continue
            ids = batch["ids"][i].as_py()
            lengths, codes = unsqueeze(batch["data"][i].as_buffer())
            if known is None:
                if len(codes) and not held:
                    raise RuntimeError("the input's rows came in another order when they were read again; write it to a table first")
                known, held = (start(held),), []
            yield known[0], ids, lengths.astype(np.int64), codes.astype(np.int64)
        del batch
        give_back()
