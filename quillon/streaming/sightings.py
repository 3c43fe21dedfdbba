"""Sightings as a stream: each key's ledger in the state store, late data never dropped, notifications at least once.

A key's changes lie in RocksDB in chunks of time, found through an index of their first moments. A batch reads and
writes the chunks that its sightings fall into, and no others, however long the key's history is. Keys are judged in
buckets: a group's frames cost milliseconds, a key's ledger one read and one write.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from quillon.operators.state import REPLAYED, Ledger
from quillon.shared import exists, kept

#: Changes in a chunk, after which it is split.
CHUNK = 256
#: Groups that keys are dealt to by their hash. A checkpoint's state is bound to it.
BUCKETS = 2048
#: Rows of a frame of results.
FRAME = 10_000
PROVIDER = "spark.sql.streaming.stateStore.providerClass"
PARTITIONS = "spark.sql.shuffle.partitions"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def longs(values: Iterable[int] | bytes = ()) -> array:
    return array("q", values)


def packed(values: Iterable[int]) -> bytes:
    return longs(values).tobytes()


class ChunkedLog:
    """A key's changes in the order of time: chunks of (moments, rents) behind ``read``, and an index of (first moment,
    number of the chunk: 0, 1, 2, ... as they were split off). What was touched is in ``changed``."""

    def __init__(self, starts: list[int], numbers: list[int], read: Callable[[int], tuple[list[int], list[int]]]):
        self.starts, self.numbers, self.read = starts, numbers, read
        self.held: dict[int, tuple[list[int], list[int]]] = {}
        self.changed: set[int] = set()
        self.found: tuple[int, int, int] | None = None

    def _chunk(self, place: int) -> tuple[list[int], list[int]]:
        number = self.numbers[place]
        if number not in self.held:
            self.held[number] = self.read(number)
        return self.held[number]

    def around(self, epoch: int) -> tuple[int | None, int | None]:
        """The rents that held at a moment, and after it."""
        if not self.numbers:
            return None, None
        place = max(bisect_right(self.starts, epoch) - 1, 0)
        moments, rents = self._chunk(place)
        at = bisect_right(moments, epoch)
        self.found = (epoch, place, at)
        following = rents[at] if at < len(rents) else self._chunk(place + 1)[1][0] if place + 1 < len(self.numbers) else None
        return rents[at - 1] if at else None, following

    def add(self, epoch: int, rent: int) -> None:
        if not self.numbers:
            self.starts, self.numbers, self.held[0] = longs([epoch]), longs([0]), (longs(), longs())
        if self.found is None or self.found[0] != epoch:
            self.around(epoch)
        (_, place, at), self.found = self.found, None
        moments, rents = self._chunk(place)
        moments.insert(at, epoch)
        rents.insert(at, rent)
        if at == 0:
            self.starts[place] = epoch
        self.changed.add(self.numbers[place])
        if len(moments) > CHUNK:
            number, half = len(self.numbers), len(moments) // 2
            self.held[number] = (moments[half:], rents[half:])
            del moments[half:], rents[half:]
            self.starts.insert(place + 1, self.held[number][0][0])
            self.numbers.insert(place + 1, number)
            self.changed.add(number)


class Sightings(StatefulProcessor):
    """Judges the new sightings of a bucket's keys, each key's in the order of arrival (seq), against the key's ledger.

    A ledger is one value as long as its changes fit into one chunk; then its chunks are values of their own."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ledgers = handle.getMapState("ledgers", "key long, keyless boolean", "seen long, rent long, starts binary, numbers binary, moments binary, rents binary")
        self.chunks = handle.getMapState("chunks", "key long, keyless boolean, number long", "moments binary, rents binary")

    def _open(self, key: tuple[int, bool]) -> Ledger:
        seen, rent, starts, numbers, moments, rents = self.ledgers.getValue(key) or (None, None, b"", b"", b"", b"")
        log = ChunkedLog(longs(bytes(starts)), longs(bytes(numbers)), lambda number: tuple(longs(bytes(c)) for c in self.chunks.getValue((*key, number))))
        if len(log.numbers) == 1:
            log.held[0] = (longs(bytes(moments)), longs(bytes(rents)))
        return Ledger(seen, rent, log)

    def _close(self, key: tuple[int, bool], ledger: Ledger) -> None:
        log, alone = ledger.log, ((), ())
        if len(log.numbers) == 1:
            alone = log.held[0]
        else:
            for number in log.changed:
                self.chunks.updateValue((*key, number), tuple(map(packed, log.held[number])))
        self.ledgers.updateValue(key, (ledger.seen, ledger.rent, packed(log.starts), packed(log.numbers), *map(packed, alone)))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        parts = [[p[c].to_numpy(t) for c, t in ARRIVED.items()] for p in rows]
        columns = [np.concatenate(c) for c in zip(*parts, strict=True)]
        order = np.lexsort((columns[2], columns[0], columns[1]))
        now, ledger = None, None
        for at in range(0, len(order), FRAME):
            keys, keyless, seqs, epochs, rents, unknown = (c[order[at : at + FRAME]] for c in columns)
            judged = []
            for k, none, epoch, rent, lacking in zip(*(c.tolist() for c in (keys, keyless, epochs, rents, unknown)), strict=True):
                if (k, none) != now:
                    if ledger is not None:
                        self._close(now, ledger)
                    now = (k, none)
                    ledger = self._open(now)
                judged.append(ledger.sight(epoch, None if lacking else rent))
            new, current, previous, delta, drop, logged = map(list, zip(*judged, strict=True))
            known = [pd.arrays.IntegerArray(keys, keyless), seqs, new, current, pd.arrays.IntegerArray(rents, unknown), pd.array(previous, "Int64"), pd.array(delta, "Int64"), drop, logged]
            yield pd.DataFrame(dict(zip((f.name for f in REPLAYED), known, strict=True)))
        if ledger is not None:
            self._close(now, ledger)

    def close(self) -> None:
        pass


#: Sightings as they come to the processor: without nulls, which would make doubles of a frame's numbers.
ARRIVED = {"key": np.int64, "keyless": np.bool_, "seq": np.int64, "at_epoch": np.int64, "rent": np.int64, "unknown": np.bool_}


def judged_stream(sightings: DataFrame) -> DataFrame:
    """A stream of sightings (key, seq, at_epoch, rent) as each was judged on arrival; no watermark: state stays. The
    session's state store must be RocksDB (:func:`run_available` sees to it)."""
    key, rent = F.col("key").cast("long"), F.col("rent").cast("long")
    arrived = sightings.select(
        F.pmod(F.xxhash64(key), F.lit(BUCKETS)).alias("bucket"), F.coalesce(key, F.lit(0)).alias("key"), key.isNull().alias("keyless"),
        "seq", "at_epoch", F.coalesce(rent, F.lit(0)).alias("rent"), rent.isNull().alias("unknown"),
    )
    return arrived.groupBy("bucket").transformWithStateInPandas(statefulProcessor=Sightings(), outputStructType=REPLAYED, outputMode="Append", timeMode="None")


def run_available(spark: SparkSession, folder: str, schema: str, checkpoint: str, out: str, files_per_batch: int | None = 1, each: Callable[[DataFrame, int], None] = lambda batch, number: None) -> DataFrame:
    """Judges all sightings that have landed as Parquet files in folder since the last call, and returns all results
    so far. Files of one batch (None: all that landed) are judged together, in the order of seq, whichever file they are
    in. The checkpoint holds the state; a batch that is repeated overwrites its own output. ``each`` is called with
    every batch as written and its number; if it fails, the batch is judged again by the next call, from the state
    before it.

    Each partition of the state costs seconds in every batch, so there are two for each core at most; a checkpoint's
    first batch fixes their number."""
    reader = spark.readStream.schema(schema)
    stream = (reader.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else reader).parquet(folder)

    def write(batch: DataFrame, number: int) -> None:
        path = f"{out}/batch={number}"
        batch.write.mode("overwrite").parquet(path)
        each(spark.read.schema(batch.schema).parquet(path), number)

    parts = min(int(spark.conf.get(PARTITIONS)), 2 * spark.sparkContext.defaultParallelism)
    before = {c: spark.conf.get(c) for c in (PROVIDER, PARTITIONS)}
    try:
        spark.conf.set(PROVIDER, ROCKSDB)
        spark.conf.set(PARTITIONS, parts)
        judged_stream(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.parquet(out).drop("batch")


def watch(run: Callable[[], object], passes: Iterable[int], failed: Callable[[int, str], None]) -> int:
    """Runs a pass for each of ``passes``, one after the other; how many succeeded. One that fails is reported with its
    number and message, and the next one runs: it finds what landed in between and what the failed one left."""
    done = 0
    for number in passes:
        try:
            run()
            done += 1
        except Exception as e:
            failed(number, f"{type(e).__name__}: {e}")
    return done


def notify_once(events: DataFrame, ledger: str, batch: int, send) -> bool:
    """Sends the events (with a key) that no batch before this one has sent, and notes their keys once they were
    delivered. A batch that runs again after its note sends nothing; one that stops between sending and noting sends
    again, so an event arrives at least once."""
    spark = events.sparkSession
    fresh = events
    if exists(spark, ledger):
        fresh = events.join(spark.read.schema("key string, batch_id long").parquet(ledger).select(F.col("key").cast(events.schema["key"].dataType)).distinct(), "key", "left_anti")
    fresh = kept(fresh, "events")
    if fresh.isEmpty() or not send(fresh, batch):
        return False
    fresh.select(F.col("key").cast("string").alias("key"), F.lit(batch).cast("long").alias("batch_id")).distinct().write.mode("overwrite").parquet(f"{ledger}/part={batch}")
    return True
