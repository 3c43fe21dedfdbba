"""What a source is: its name and profile, where its landed files are and how their items become listings. A harvest
reads all sources in one plan; what can't be read, row by row or as a whole, goes to quarantine.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from quillon.operators import health
from quillon.schema import ELIGIBLE, LISTING, TENURES, merged_with
from quillon.shared import kept
from quillon.sources import landed
from quillon.sources.listings import FieldMap, mail_listings, mapped_items

FAMILIES = ("institutional", "private")


@dataclass(frozen=True)
class Source:
    """A source as it is declared. ``default_tenure`` is a hint of last resort for classification, ``mixed_tenure``
    makes it fail closed. ``host`` is the site that its fetcher asks, None if it asks none."""

    name: str
    kind: str  # json, page or mail
    path: str
    fields: FieldMap | None = None
    family: str = "institutional"
    default_tenure: str | None = None
    mixed_tenure: bool = True
    host: str | None = None
    items: str = ""
    lines: bool = False
    card: str = ""
    selectors: dict[str, str] = field(default_factory=dict)
    sender: str | None = None
    newest: int | None = None
    charges_included: bool | None = None

    def __post_init__(self):
        if not self.name or self.kind not in ("json", "page", "mail") or self.family not in FAMILIES:
            raise ValueError(f"source {self.name!r}: unknown kind {self.kind!r} or family {self.family!r}")
        if self.default_tenure is not None and self.default_tenure not in TENURES:
            raise ValueError(f"source {self.name!r}: unknown tenure {self.default_tenure!r}")
        if self.kind != "mail" and self.fields is None or self.kind == "page" and not self.card:
            raise ValueError(f"source {self.name!r}: nothing says where its fields or cards are")

    def profile(self) -> tuple[str, str, str | None, bool]:
        return self.name, self.family, self.default_tenure, self.mixed_tenure

    def scan(self, spark: SparkSession) -> DataFrame:
        """(path, position, item, error) of all that has landed."""
        reader = spark.read.format("landed").option("kind", self.kind).option("items", self.items).option("lines", str(self.lines).lower())
        reader = reader.option("card", self.card).option("selectors", json.dumps(self.selectors))
        return (reader if self.newest is None else reader.option("newest", self.newest)).load(self.path)

    def listings(self, spark: SparkSession) -> DataFrame:
        """Listing rows with path, position and error: rows with an error have no other columns but source. Items that
        give no listing (without a reference; mails without a link to one) have an error too; mails of other senders
        are nobody's. What has landed is scanned once for all of these."""
        scanned = self.scan(spark)
        where = ["path", "position", "error"]
        if self.kind == "mail":
            mail = scanned.select(*where, F.from_json("item", "sender string, subject string, body string, links array<string>").alias("m")).select(*where, "m.*")
            if self.sender:
                mail = mail.filter(F.col("error").isNotNull() | F.contains(F.lower("sender"), F.lit(self.sender.lower())))
            found = mail_listings(mail, self.name, host=self.host, charges_included=self.charges_included, keep=where, every=True)
            named, why = "url", "no link to a listing"
        else:
            found = mapped_items(scanned.withColumn("__v", F.parse_json("item")), self.name, self.fields, "__v", keep=where)
            named, why = "external_id", "no reference"
        wrong = F.coalesce("error", F.when(F.col(named).isNull(), F.lit(why)))
        given = found.withColumn("error", wrong)
        listing = [F.when(F.col("error").isNull(), F.col(f.name)).alias(f.name) if f.name != "source" else F.col("source") for f in LISTING]
        return given.select(*listing, *where)


def profiles(spark: SparkSession, sources: list[Source]) -> DataFrame:
    """A row (source, family, default_tenure, mixed_tenure) for each source, for state.with_profile."""
    if len({s.name for s in sources}) < len(sources):
        raise ValueError("two sources have one name")
    return spark.createDataFrame([s.profile() for s in sources], "source string, family string, default_tenure string, mixed_tenure boolean")


@dataclass
class Harvest:
    rows: DataFrame  # listing rows with seq, their order of arrival
    quarantine: DataFrame  # source, path, position, error
    runs: DataFrame  # a run of each source: source, seq, item_count, ok, error, at_epoch
    counters: dict  # items and quarantined rows of all sources


def harvest(spark: SparkSession, sources: list[Source], at_epoch: int, seq: int = 0) -> Harvest:
    """All sources' landed files in one parallel plan, written once.

    A source's run is ok unless a whole file or its path could not be read, or it gave nothing but errors; its error is
    the first one by path and position. item_count is what was parsed, whatever becomes of it later.
    """
    landed.register(spark)
    names = spark.createDataFrame([(s.name,) for s in sources], "source string")
    every = reduce(DataFrame.unionByName, [s.listings(spark) for s in sources])
    seen = Observation()
    bad = F.col("error").isNotNull()
    told = kept(every.observe(seen, F.count_if(~bad).alias("items"), F.count_if(bad).alias("quarantined")), "harvest")
    counted = told.groupBy("source").agg(
        F.count_if(~bad).alias("item_count"),
        F.count_if(bad & F.col("position").isNull()).alias("__files"),
        F.count_if(bad).alias("__bad"),
        F.min(F.when(bad, F.struct("path", "position", "error"))).alias("__first"),
    )
    ok = (F.coalesce("__files", F.lit(0)) == 0) & ((F.coalesce("item_count", F.lit(0)) > 0) | (F.coalesce("__bad", F.lit(0)) == 0))
    runs = names.join(counted, "source", "left").select(
        "source", F.lit(seq).cast("long").alias("seq"), F.coalesce("item_count", F.lit(0)).alias("item_count"), ok.alias("ok"), F.col("__first.error").alias("error"), F.lit(at_epoch).cast("long").alias("at_epoch")
    )
    rows = told.filter(~bad).select(*[f.name for f in LISTING], F.monotonically_increasing_id().alias("seq"))
    return Harvest(rows, told.filter(bad).select("source", "path", "position", "error"), runs, seen.get)


def source_health(log: DataFrame, sources: list[Source], now_epoch: int) -> DataFrame:
    """The health of the declared sources from the log of their runs; one that never ran is NEVER_RUN."""
    return health.health(log, log.sparkSession.createDataFrame([(s.name,) for s in sources], "source string"), now_epoch)


def hydrated(listings: DataFrame, details: Callable[[DataFrame], DataFrame] | None, gate: Column | None, keys: tuple[str, ...] = ("source", "external_id")) -> DataFrame:
    """Listings with what their detail pages say. ``gate`` decides which pages are wanted at all: ``details`` gets the
    listings for which it holds (a null holds not) and returns listing rows of what it found; the others stay as they are.

    With details but no gate nothing is guessed: fetching all pages or none would both be wrong.
    """
    if details is None:
        return listings
    if gate is None:
        raise ValueError("detail pages are declared but no gate says whose are wanted")
    marked = listings.withColumn("__wanted", F.coalesce(gate, F.lit(False)))
    wanted = marked.filter("__wanted").drop("__wanted")
    return merged_with(wanted, details(wanted), list(keys)).unionByName(marked.filter(~F.col("__wanted")).drop("__wanted"))


def undecided() -> Column:
    """The usual gate: the page is worth a look where the listing's own tenure is unknown."""
    return ~F.coalesce(F.col("tenure").isin(ELIGIBLE), F.lit(False))
