"""Bursts of severe levels and of overall traffic, and their alerts.

All of it runs on event time. The detectors read one table of events per level
and microsecond (``chain.event_counts``); events themselves are touched again
only where a result lists them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from lograin.functions.text import extract_level, first_ip
from lograin.functions.times import from_micros, micros
from lograin.operators.chain import WINDOW, event_counts, placed_counts, window_starts
from lograin.operators.stats import severity_filter
from lograin.params import Params
from lograin.session import materialize

_ID_BAND_BITS = 20


_WINDOW_STATE = "category string, start_us long, first boolean, seen long, sent long, last long, ip string"


class Bursts:
    """Burst detection over entries with ``event_id, ts, content``.

    ``carried`` holds, per category, the window that earlier entries left open
    (see ``open_windows``), so that a feed can be worked on piece by piece.
    """

    def __init__(self, entries: DataFrame, params: Params, carried: list[Row] = ()):
        self.params = params
        self.carried = {row["category"]: row for row in carried}
        self.events = entries.select(
            "event_id", "ts", "content",
            extract_level(F.col("content")).alias("level"),
            micros(F.col("ts")).alias("us"),
        )

    @classmethod
    def of_counts(cls, counts: DataFrame, params: Params, carried: list[Row]) -> Bursts:
        """Detection from counts alone; lists of single events are not at hand."""
        found = cls.__new__(cls)
        found.params, found.counts = params, counts
        found.carried = {row["category"]: row for row in carried}
        return found

    @cached_property
    def counts(self) -> DataFrame:
        """Events per severe level and microsecond; all others under ``''``."""
        return event_counts(self.events, burst_category(F.col("level"), self.params), F.col("us"))

    @cached_property
    def severity_counts(self) -> DataFrame:
        """Counts of severe levels with their windows.

        Other traffic is counted only where its counts are wanted, too.
        """
        if "counts" in self.__dict__:
            return self._placed(self.counts.filter("category <> ''"))
        severe = severity_filter(self.events, self.params)
        return self._placed(event_counts(severe, F.col("level"), F.col("us")))

    def _placed(self, counts: DataFrame) -> DataFrame:
        params = self.params
        deadlines = {name: row["start_us"] + params.limit_us for name, row in self.carried.items()}
        starts = window_starts(counts, params.limit_us, params.max_group_rows, deadlines, params.slice_rows)
        if not self.carried:
            placed = placed_counts(counts, starts, params.limit_us)
            return materialize(placed.withColumns({"sent": F.lit(0), "last": F.lit(None).cast("long")}))
        # at most one row per category
        carried = F.broadcast(counts.sparkSession.createDataFrame(list(self.carried.values()), _WINDOW_STATE))
        starts = starts.unionByName(carried.select("category", "start_us", "first"))
        placed = placed_counts(counts, starts, params.limit_us).join(
            carried.select(*WINDOW, "seen", "sent", "last"), WINDOW, "left"
        )
        before = F.col("before") + F.coalesce("seen", F.lit(0))
        placed = placed.withColumns({"before": before, "sent": F.coalesce("sent", F.lit(0)).cast("int")})
        return materialize(placed.drop("seen"))

    def _severe_events(self) -> DataFrame:
        severe = severity_filter(self.events, self.params)
        return severe.select("event_id", "ts", F.col("level").alias("category"), "us")

    @cached_property
    def overall_counts(self) -> DataFrame:
        """Counts that feed the overall counter, with their windows.

        A severe event feeds it while its window counts at most the threshold.
        """
        other = self.counts.filter("category = ''").select("us", "n")
        left = self.params.severity_threshold - F.col("before")
        opening = self.severity_counts.filter(left > 0).select("us", F.least("n", left).alias("n"))
        feed = other.unionByName(opening).groupBy("us").agg(F.sum("n").alias("n"))
        category = F.lit(self.params.overall_category).alias("category")
        return self._placed(materialize(feed.select(category, "us", "n")))

    def severity_windows(self) -> DataFrame:
        """Each severe event with its window and the running count there."""
        counted = running_count(self._severe_events(), self.severity_counts)
        return counted.select(
            "event_id", "ts", F.col("category").alias("level"),
            from_micros(F.col("start_us")).alias("window_start"), F.col("place").alias("count"),
        )

    def overall_input(self) -> DataFrame:
        """Events that feed the overall counter.

        Of the severe events only those at a window's first times come into
        question, and of one time only as many as the threshold has left.
        """
        threshold = self.params.severity_threshold
        times = self.severity_counts.filter(F.col("before") < threshold).select("category", "us", "before")
        of_time = Window.partitionBy("category", "us").orderBy("event_id")
        opening = (
            self._severe_events()
            .join(times, ["category", "us"])
            .withColumn("_rank", F.row_number().over(of_time))
            .filter((F.col("_rank") <= threshold) & (F.col("before") + F.col("_rank") <= threshold))
        )
        other = self.events.filter(~F.col("level").isin(*self.params.severity_levels))
        return other.select("event_id", "ts", "us", "level").unionByName(
            opening.select("event_id", "ts", "us", F.col("category").alias("level"))
        )

    def overall_windows(self) -> DataFrame:
        """Each feeding event with its overall window and the count after it.

        The first window counts its opener, later windows do not.
        """
        feed = self.overall_input().withColumn("category", F.lit(self.params.overall_category))
        counted = running_count(feed, self.overall_counts)
        return counted.select(
            "event_id", "ts", from_micros(F.col("start_us")).alias("window_start"),
            (F.col("place") - F.when(F.col("first"), 0).otherwise(1)).alias("count"),
        )

    def severity_points(self) -> DataFrame:
        params = self.params
        windows = self.severity_counts.withColumns(
            {"rank": F.lit(params.severity_threshold + 1), "uncounted": F.lit(0), "cap": F.lit(params.alert_cap)}
        )
        return alert_points(windows, params)

    def overall_points(self) -> DataFrame:
        """Later windows start with an uncounted opener and one alert spent."""
        params = self.params
        later = F.when(F.col("first"), 0).otherwise(1)
        windows = self.overall_counts.withColumns(
            {
                "rank": F.lit(params.overall_threshold) + later,
                "uncounted": later,
                "cap": F.lit(params.alert_cap) - later,
            }
        )
        return alert_points(windows, params)

    def severity_alerts(self) -> DataFrame:
        return _alert_columns(self.severity_points())

    def overall_alerts(self) -> DataFrame:
        return _alert_columns(self.overall_points())

    def open_windows(self, points: DataFrame) -> DataFrame:
        """The last window of every category with what it has counted and sent.

        ``points`` are the alerts of both detectors.
        """
        placed = self.severity_counts.unionByName(self.overall_counts)
        windows = placed.groupBy(*WINDOW, "first").agg(
            F.max(F.col("before") + F.col("n")).alias("seen"), F.max("sent").alias("sent"), F.max("last").alias("last")
        )
        names = ["start_us", "first", "seen", "sent", "last"]
        newest = windows.groupBy("category").agg(F.max_by(F.struct(*names), "start_us").alias("window"))
        alerted = points.groupBy(*WINDOW).agg(F.count("*").alias("_new"), F.max("us").alias("_last"))
        return (
            newest.select("category", "window.*")
            .join(alerted, WINDOW, "left")
            .select(
                "category", "start_us", "first", "seen",
                (F.col("sent") + F.coalesce("_new", F.lit(0))).alias("sent"),
                F.coalesce("_last", "last").alias("last"),
            )
        )

    def burst_ip(self) -> DataFrame:
        """Address in the first event ever of each category.

        The first times are one partial aggregate of a few rows, from the counts where they are
        at hand; they come back as literals, which the scan of the entries can push down.
        """
        category = burst_category(F.col("level"), self.params)
        times = self.counts if "counts" in self.__dict__ else self.events.select(category.alias("category"), "us")
        firsts = times.groupBy("category").agg(F.min("us").alias("us")).collect()
        wanted = [(row["category"], row["us"]) for row in firsts if row["category"]]
        if firsts:
            wanted.append((self.params.overall_category, min(row["us"] for row in firsts)))
        at_first = F.col("ts").isin(*[_literal_ts(us, self.events) for _, us in wanted])
        categories = F.array_compact(
            F.array(
                *[
                    F.when((F.col("us") == us) & ((F.col("level") == name) | F.lit(name == self.params.overall_category)), name)
                    for name, us in wanted
                ]
            )
        )
        return (
            self.events.filter(at_first)
            .withColumn("category", F.explode(categories))
            .groupBy("category")
            .agg(F.min_by("content", "event_id").alias("content"))
            .select("category", first_ip(F.col("content")).alias("ip"))
        )

    def alerts(self) -> DataFrame:
        """All alerts with the address of their category."""
        overall = self.overall_alerts()  # first: its counts serve both detectors
        points = self.severity_alerts().unionByName(overall)
        return points.join(self.burst_ip(), "category", "left")


def burst_category(level: Column, params: Params) -> Column:
    """Severe levels by name, all others as ``''``."""
    return F.when(level.isin(*params.severity_levels), level).otherwise("")


def _alert_columns(points: DataFrame) -> DataFrame:
    return points.select(
        "category",
        from_micros(F.col("start_us")).alias("window_start"),
        from_micros(F.col("us")).alias("ts"),
        "count",
    )


def _literal_ts(us: int, events: DataFrame) -> Column:
    return F.timestamp_micros(F.lit(us)).cast(events.schema["ts"].dataType)


def running_count(events: DataFrame, counts: DataFrame) -> DataFrame:
    """Add each event's window and its ``place`` there by (us, event_id).

    The counts tell how many events a window has before each time, so only
    events of one time remain to be numbered. Times shared by very many events
    are numbered by bands of ids instead.
    """
    events = events.join(counts.select("category", "us", "n", "start_us", "first", "before"), ["category", "us"])
    time = ["category", "us"]
    crowded = F.col("n") > (1 << _ID_BAND_BITS)
    if counts.filter(crowded).isEmpty():
        in_time = Window.partitionBy(*time).orderBy("event_id")
        return events.withColumn("place", F.col("before") + F.row_number().over(in_time))

    band = F.when(crowded, F.shiftright("event_id", _ID_BAND_BITS)).otherwise(0)
    events = events.withColumn("_band", band)
    by_band = Window.partitionBy(*time).orderBy("_band")
    bands = events.filter(crowded).groupBy(*time, "_band").agg(F.count("*").alias("_n"))
    bands = bands.select(*time, "_band", (F.sum("_n").over(by_band) - F.col("_n")).alias("_lower"))
    in_band = Window.partitionBy(*time, "_band").orderBy("event_id")
    # the explicit shuffle leaves the joins before it free to split hot times
    numbered = events.join(bands, [*time, "_band"], "left").repartition(*time, "_band")
    place = F.col("before") + F.coalesce("_lower", F.lit(0)) + F.row_number().over(in_band)
    return numbered.withColumn("place", place).drop("_band", "_lower")


def alert_points(windows: DataFrame, params: Params) -> DataFrame:
    """Alerts of each window, from its counts per microsecond.

    A window first alerts at its event number ``rank``, then at the first event
    at least the cooldown after the previous alert, ``cap`` times at most;
    ``sent`` alerts were given before, the last one at ``last``.

    Cut into cells of one cooldown, every alert lies at most two occupied cells
    after the one before. So only the occupied cells from the first alert to
    twice the cap beyond can matter; windows that never alert drop out here.
    """
    cooldown_us = params.cooldown_us
    cell = F.floor((F.col("us") - F.col("start_us")) / cooldown_us)
    due = (F.col("before") + F.col("n") >= F.col("rank")) & (
        F.col("last").isNull() | (F.col("us") >= F.col("last") + cooldown_us)
    )
    windows = windows.withColumn("_cell", cell)
    by_cell = Window.partitionBy(*WINDOW).orderBy("_cell")
    cells = (
        windows.groupBy(*WINDOW, "_cell")
        .agg(F.max(due).alias("_due"))
        .withColumn("_due", F.max("_due").over(by_cell))
        .filter("_due")
        .withColumn("_no", F.row_number().over(by_cell))
        .filter(F.col("_no") <= 2 * params.alert_cap)
        .select(*WINDOW, "_cell")
    )

    names = [*WINDOW, "us", "n", "before", "rank", "uncounted", "cap", "sent", "last"]
    rows = windows.join(cells, [*WINDOW, "_cell"], "left_semi").select(*names)
    # a window's rows stream through one task in order of time, none of them is held
    ordered = rows.repartition(*WINDOW).sortWithinPartitions(*WINDOW, "us")
    return ordered.mapInArrow(_cooled(cooldown_us), "category string, start_us long, us long, count long")


def _cooled(cooldown_us: int):
    """Rows of windows in order of time -> alerts; the window's last alert and their number are all that is kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        window, last, sent = None, None, 0
        for batch in batches:
            columns = {name: batch.column(name) for name in batch.schema.names}
            starts = columns["start_us"].to_numpy()
            categories = columns["category"].dictionary_encode()
            codes = categories.indices.to_numpy()
            edges = np.flatnonzero((starts[1:] != starts[:-1]) | (codes[1:] != codes[:-1])) + 1
            times, reached, before = (columns[name].to_numpy() for name in ("us", "n", "before"))
            reached = reached + before
            alerts: list[tuple] = []
            for start, stop in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows]):
                if start == stop:
                    continue
                own = (columns["category"][start].as_py(), int(starts[start]))
                if own != window:
                    window, last, sent = own, columns["last"][start].as_py(), columns["sent"][start].as_py()
                rank, uncounted, cap = (columns[name][start].as_py() for name in ("rank", "uncounted", "cap"))
                while sent < cap:
                    at = start + int(np.searchsorted(reached[start:stop], rank))
                    if last is not None:
                        at = max(at, start + int(np.searchsorted(times[start:stop], last + cooldown_us)))
                    if at == stop:
                        break
                    last, sent = int(times[at]), sent + 1
                    alerts.append((*own, last, max(rank, int(before[at]) + 1) - uncounted))
            if alerts:
                types = (pa.string(), pa.int64(), pa.int64(), pa.int64())
                arrays = [pa.array(values, kind) for values, kind in zip(zip(*alerts), types)]
                yield pa.RecordBatch.from_arrays(arrays, names=["category", "start_us", "us", "count"])

    return run
