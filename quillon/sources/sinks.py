"""Sinks of notifications: each batch of events goes to channels; it counts as delivered where one of them took it."""

from __future__ import annotations

from collections.abc import Callable
from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.operators.graph import numbered


class Channel(Protocol):
    name: str

    def send(self, events: DataFrame, batch: int) -> None: ...


class ConsoleChannel:
    name = "console"

    def send(self, events: DataFrame, batch: int) -> None:
        """All events, a line each; the driver holds one partition of them at a time."""
        for e in events.select("kind", "priority", "title", "text").toLocalIterator():
            print(f"[{e.kind} {e.priority}] {e.title}: {e.text}")


class FileChannel:
    """A folder for each batch, written whole or not at all: sending a batch again changes nothing."""

    name = "file"

    def __init__(self, path: str):
        self.path = path

    def send(self, events: DataFrame, batch: int) -> None:
        events.write.mode("overwrite").json(f"{self.path}/batch={batch}")


def notify(channels: list[Channel], problem: Callable[[str, Exception], None] = lambda name, e: None) -> Callable[[DataFrame, int], bool]:
    """A function for foreachBatch: sends to every channel; true if one succeeded."""

    def send(events: DataFrame, batch: int) -> bool:
        delivered = False
        for channel in channels:
            try:
                channel.send(events, batch)
                delivered = True
            except Exception as e:
                problem(channel.name, e)
        return delivered

    return send


#: Headlines in one digest; what is more goes into further ones.
DIGEST_LINES = 500


def event_rows(judged: DataFrame) -> DataFrame:
    """Notifications of judged listings (source, outcome, headline, text, high_priority, is_new_match, rent_drop): matches
    one by one, drops, and digests of each source's other listings, in order of the headline, DIGEST_LINES in each."""
    one = judged.filter("outcome = 'MATCH' and is_new_match").select(F.lit("match").alias("kind"), F.when(F.col("high_priority"), 5).otherwise(3).alias("priority"), F.col("headline").alias("title"), "text")
    drop = judged.filter("outcome = 'MATCH' and rent_drop").select(F.lit("rent_drop").alias("kind"), F.lit(3).alias("priority"), F.col("headline").alias("title"), "text")
    placed = numbered(judged.filter("outcome = 'DIGEST' and is_new_match").select("source", "headline"), ["source"], [F.col("headline")])
    paged = placed.select("source", "headline", F.floor(F.col("place") / DIGEST_LINES).alias("page"))
    digest = paged.groupBy("source", "page").agg(F.array_sort(F.collect_list("headline")).alias("lines"))
    title = F.concat(F.lit("digest of "), F.col("source"), F.when(F.col("page") > 0, F.concat(F.lit(", "), (F.col("page") + 1).cast("string"))).otherwise(""))
    return one.unionByName(drop).unionByName(digest.select(F.lit("digest").alias("kind"), F.lit(2).alias("priority"), title.alias("title"), F.array_join("lines", "\n").alias("text")))
