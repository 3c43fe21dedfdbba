"""Health of sources from their run logs: source, seq (order of arrival), item_count, ok, at_epoch (seconds), error."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Days of the rolling window, runs, ratios and days that verdicts need.
WINDOW_DAYS, EMPTY_RUNS, DROP_RATIO, FLAKY_RUNS, FLAKY_RATIO, NEVER_DAYS = 7, 3, 0.3, 3, 0.3, 7
DAY = 86_400
WINDOW = WINDOW_DAYS * DAY


class Earlier:
    """Counts and sums of the values that have come before, by moment: sorted layers, each at least twice as long as the
    next, merged as they grow. A block of n values costs their sorting, and a search in each layer."""

    def __init__(self):
        self.layers: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # moments in order, counts and sums before each

    def _layer(self, moments: np.ndarray, counts: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = np.argsort(moments, kind="stable")
        return moments[order], np.concatenate([[0], np.cumsum(counts[order])]), np.concatenate([[0], np.cumsum(values[order])])

    def _up_to(self, moments: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Counts and sums of all held values at or before each moment."""
        n, total = np.zeros(len(moments), np.int64), np.zeros(len(moments), np.int64)
        for held, counts, sums in self.layers:
            at = np.searchsorted(held, moments, side="right")
            n += counts[at]
            total += sums[at]
        return n, total

    def _block(self, moments: np.ndarray, counts: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each value the values of its own block that come before it, at or before what it asks for."""
        n, total = np.zeros(len(moments), np.int64), np.zeros(len(moments), np.int64)
        width = 1
        while width < len(moments):  # left halves answer right halves, for all blocks of a width at once
            block = np.arange(len(moments)) // width
            left, right = np.flatnonzero(block % 2 == 0), np.flatnonzero(block % 2 == 1)
            order = left[np.lexsort((moments[left], block[left]))]
            ends = np.searchsorted(block[order], block[right] - 1, side="right")
            starts = np.searchsorted(block[order], block[right] - 1, side="left")
            ranks, shift = np.unique(np.concatenate([moments[order], wanted[right]]), return_inverse=True)
            held, asked = shift[: len(order)], shift[len(order) :]
            keys = block[order] * len(ranks) + held
            at = np.clip(np.searchsorted(keys, (block[right] - 1) * len(ranks) + asked, side="right"), starts, ends)
            c, v = np.concatenate([[0], np.cumsum(counts[order])]), np.concatenate([[0], np.cumsum(values[order])])
            n[right] += c[at] - c[starts]
            total[right] += v[at] - v[starts]
            width *= 2
        return n, total

    def take(self, moments: np.ndarray, counts: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each of the next values, in the order in which they come: how many before it were at or before ``wanted``,
        and their sum. Then they are held themselves."""
        n, total = self._up_to(wanted)
        own, sums = self._block(moments, counts, values, wanted)
        some = counts > 0
        self.layers.append(self._layer(moments[some], counts[some], values[some]))
        while len(self.layers) > 1 and len(self.layers[-2][0]) < 2 * len(self.layers[-1][0]):
            (m1, c1, s1), (m2, c2, s2) = self.layers.pop(), self.layers.pop()
            self.layers.append(self._layer(np.concatenate([m1, m2]), np.concatenate([np.diff(c1), np.diff(c2)]), np.concatenate([np.diff(s1), np.diff(s2)])))
        return n + own, total + sums


def _window_parts(batches):
    """(source, seq, n, total) of rows sorted by source, week and seq: what came before them in the week, up to wanted."""
    at, earlier = None, Earlier()
    for batch in batches:
        sources, weeks = batch["source"].to_pylist(), np.asarray(batch["week"])
        moments, counts, values, wanted = (np.asarray(batch[c], dtype=np.int64) for c in ("moment", "counts", "value", "wanted"))
        edges = [i for i in range(len(sources)) if i == 0 or sources[i] != sources[i - 1] or weeks[i] != weeks[i - 1]] + [len(sources)]
        n, total = np.zeros(len(sources), np.int64), np.zeros(len(sources), np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            if (key := (sources[a], weeks[a])) != at:
                at, earlier = key, Earlier()
            n[a:b], total[a:b] = earlier.take(moments[a:b], counts[a:b], values[a:b], wanted[a:b])
        yield pa.RecordBatch.from_arrays([batch["source"], batch["seq"], pa.array(n), pa.array(total)], names=["source", "seq", "n", "total"])


def before(runs: DataFrame) -> DataFrame:
    """runs with what preceded each: ``rolling_mean`` (of successful runs that arrived before it and are at most seven
    days older; those later by the clock don't count) and ``last_productive`` (the last positive count, else 0).

    The window of a run reaches over two weeks of the clock: its own, up to its moment, and the one before, from seven
    days earlier on (up to the opposite moment, if moments are negated). Each week of a source is passed once in the
    order of arrival, so clocks that were wrong cost no more than others.
    """
    order = Window.partitionBy("source").orderBy("seq")
    productive = F.last(F.when(F.col("ok") & (F.col("item_count") > 0), F.col("item_count")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))
    noted = runs.withColumn("last_productive", F.coalesce(productive, F.lit(0)).cast("long"))
    e, week, ok = F.col("at_epoch").cast("long"), F.floor(F.col("at_epoch") / WINDOW).cast("long"), F.coalesce(F.col("ok"), F.lit(False)).cast("long")
    n, value, nothing = ok.alias("counts"), F.when(F.col("ok"), F.col("item_count")).cast("long"), F.lit(0).cast("long")
    row = lambda k, moment, counts, amount, wanted: F.struct(k.alias("week"), moment.alias("moment"), counts.alias("counts"), F.coalesce(amount, nothing).alias("value"), wanted.alias("wanted"))
    least = F.lit(-(1 << 62)).cast("long")
    parts = F.array(row(2 * week, e, n, value, e), row(2 * week + 1, -e, n, value, least), row(2 * week - 1, least, nothing, nothing, WINDOW - e))
    rows = runs.select("source", F.col("seq").cast("long").alias("seq"), F.explode(parts).alias("p")).select("source", "seq", "p.*")
    passed = rows.repartition("source", "week").sortWithinPartitions("source", "week", "seq").mapInArrow(_window_parts, "source string, seq long, n long, total long")
    seen = passed.groupBy("source", "seq").agg(F.sum("n").alias("__n"), F.sum("total").alias("__total"))
    return noted.join(seen, ["source", "seq"], "left").withColumn("rolling_mean", F.when(F.col("__n") > 0, F.col("__total") / F.col("__n"))).drop("__n", "__total")


def summary(runs: DataFrame, now_epoch: int | None = None) -> DataFrame:
    """One row per source: last run, streak of empty runs, means, counts in the window, span."""
    noted = before(runs)
    empty = F.col("ok") & (F.col("item_count") == 0)
    last_other = F.max(F.when(~empty, F.col("seq")))
    edges = noted.groupBy("source").agg(last_other.alias("last_other"), F.max_by("at_epoch", "seq").alias("last_epoch"))
    joined = noted.join(edges, "source")
    edge = F.lit(now_epoch) if now_epoch is not None else F.col("last_epoch")
    inside = (F.col("at_epoch") <= edge) & (F.col("at_epoch") >= edge - WINDOW)
    streak = F.coalesce(F.col("seq") > F.col("last_other"), F.lit(True))
    aggs = [
        F.max_by("ok", "seq").alias("last_ok"),
        F.max_by("item_count", "seq").alias("last_count"),
        F.max_by("error", "seq").alias("last_error"),
        F.max_by("rolling_mean", "seq").alias("rolling_mean"),
        F.max_by("at_epoch", F.when(F.col("ok"), F.col("seq"))).alias("last_success"),
        F.max_by("at_epoch", F.when(~F.col("ok"), F.col("seq"))).alias("last_failure"),
        F.bool_or(F.col("ok") & (F.col("item_count") > 0)).alias("ever_produced"),
        F.count_if("ok").alias("successful_runs"),
        F.count(F.lit(1)).alias("total_runs"),
        (F.max("at_epoch") - F.min("at_epoch")).alias("span"),
        F.count_if(streak).alias("empty_streak"),
        F.min_by(F.coalesce("rolling_mean", F.col("last_productive").cast("double")), F.when(streak, F.col("seq"))).alias("streak_baseline"),
        F.count_if(inside).alias("runs_in_window"),
        F.count_if(inside & ~F.col("ok")).alias("failed_in_window"),
    ]
    if now_epoch is not None:
        aggs.append(F.max(F.when(F.col("at_epoch") <= now_epoch, F.col("at_epoch"))).alias("newest"))
    return joined.groupBy("source").agg(*aggs)


def failure_rate(failed: Column, runs: Column) -> Column:
    return F.try_divide(failed.cast("double"), runs)


def verdict(now_epoch: int | None = None) -> Column:
    """The first status that holds, over the columns of :func:`summary`."""
    c = F.when(~F.col("last_ok"), "BROKEN").when((F.col("empty_streak") >= EMPTY_RUNS) & (F.coalesce("streak_baseline", F.lit(0.0)) > 0), "BROKEN")
    if now_epoch is not None:
        c = c.when(F.col("newest").isNull() | (F.lit(now_epoch) - F.col("newest") > WINDOW), "STALE")
    return (
        c.when(~F.col("ever_produced") & (F.col("successful_runs") >= EMPTY_RUNS) & (F.col("span") >= NEVER_DAYS * DAY), "NEVER_PRODUCED")
        .when((F.col("runs_in_window") >= FLAKY_RUNS) & (failure_rate(F.col("failed_in_window"), F.col("runs_in_window")) > FLAKY_RATIO), "WARN_FLAKY")
        .when((F.col("rolling_mean") > 0) & (F.col("last_count") < F.col("rolling_mean") * DROP_RATIO), "WARN_DROP")
        .otherwise("OK")
    )


def health(runs: DataFrame, sources: DataFrame | None = None, now_epoch: int | None = None) -> DataFrame:
    """:func:`summary` with ``status`` and ``failure_rate``; sources (if given) without runs are NEVER_RUN."""
    out = summary(runs, now_epoch).withColumn("status", verdict(now_epoch)).withColumn("failure_rate", failure_rate(F.col("failed_in_window"), F.col("runs_in_window")))
    if sources is None:
        return out
    return sources.select("source").distinct().join(out, "source", "left").withColumn("status", F.coalesce("status", F.lit("NEVER_RUN")))


def is_alerting(status: Column) -> Column:
    return status != "OK"


def due_alerts(states: DataFrame, alerts: DataFrame, now_epoch: int, hours: int) -> DataFrame:
    """Alerting states (source, status) that were never reported, or long enough ago, or in the future."""
    last = alerts.select("source", "status", F.col("at_epoch").alias("alerted"))
    return states.filter(is_alerting(F.col("status"))).join(last, ["source", "status"], "left").filter(
        F.col("alerted").isNull() | (F.col("alerted") > now_epoch) | (F.lit(now_epoch) - F.col("alerted") >= hours * 3600)
    )


def recovered(states: DataFrame, alerts: DataFrame) -> DataFrame:
    """Sources that are fine and had been reported; their alerts are to be deleted."""
    return states.filter(~is_alerting(F.col("status"))).join(alerts.select("source").distinct(), "source", "left_semi")


def heartbeat_due(last_epoch: Column, now_epoch: int, hours: int) -> Column:
    return last_epoch.isNull() | (last_epoch > now_epoch) | (F.lit(now_epoch) - last_epoch >= hours * 3600)
