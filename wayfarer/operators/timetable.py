"""Timetable operators: legs, interpolation, frequency departures, filters of trips and stops."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.session import cut


def _trip(order: str = "seq"):
    return Window.partitionBy("trip_id").orderBy(order)


def legs(stop_times: DataFrame) -> DataFrame:
    """trip_id, seq, from_stop, to_stop, dep, travel: each pair of neighbouring stops; travel is the next arrival less the departure, at least 0."""
    own = _trip()
    rows = stop_times.select("trip_id", "seq", F.col("stop_id").alias("from_stop"), F.lead("stop_id").over(own).alias("to_stop"), "dep", F.lead("arr").over(own).alias("next_arr"))
    return rows.filter(F.col("next_arr").isNotNull()).select("trip_id", "seq", "from_stop", "to_stop", "dep", F.greatest(F.lit(0), F.col("next_arr") - F.col("dep")).alias("travel"))


def chained(rows: DataFrame, key: str, order: list[str], value: str) -> DataFrame:
    """Adds prev_* and next_* of ``value`` along each key's chain."""
    own = Window.partitionBy(key).orderBy(*order)
    return rows.withColumn(f"prev_{value}", F.lag(value).over(own)).withColumn(f"next_{value}", F.lead(value).over(own))


def interpolate(stop_times: DataFrame) -> DataFrame:
    """Stop times with unknown times filled in between known ones, linearly by the number of stops, in whole seconds.

    A row with only one of arrival and departure has it for both. Rows before the first or after the last known time, and
    rows between times that run backwards, are dropped.
    """
    known = stop_times.withColumn("a", F.coalesce("arr", "dep")).withColumn("d", F.coalesce("dep", "arr"))
    own = _trip()
    before, after = own.rowsBetween(Window.unboundedPreceding, 0), own.rowsBetween(0, Window.unboundedFollowing)
    known = known.withColumn("k", F.row_number().over(own))
    mark = lambda c: F.when(F.col("a").isNotNull(), F.struct("k", F.col(c).alias("t")))
    known = known.withColumn("p", F.last(mark("d"), ignorenulls=True).over(before)).withColumn("q", F.first(mark("a"), ignorenulls=True).over(after))
    span, gap = F.col("q.k") - F.col("p.k"), F.col("q.t") - F.col("p.t")
    filled = F.expr("p.t + ((k - p.k) * (q.t - p.t)) div (q.k - p.k)").cast("int")
    rows = known.filter(F.col("a").isNotNull() | ((span > 0) & (gap >= 0)))
    return rows.select("trip_id", "seq", "stop_id", F.coalesce("a", filled).alias("arr"), F.coalesce("d", filled).alias("dep"))


def trips_with_stops(stop_times: DataFrame, stops: DataFrame, least: int = 2) -> DataFrame:
    """trip_id, stops: trips with at least ``least`` rows at the given stops; the stops are met by a hash join Spark chooses the side of."""
    return stop_times.join(stops.select("stop_id"), "stop_id", "left_semi").groupBy("trip_id").agg(F.count("*").alias("stops")).filter(F.col("stops") >= least)


def at_known_stops(stop_times: DataFrame, stops: DataFrame) -> DataFrame:
    """Stop times without those at other stops, before legs are made: A, B, C without B is a leg from A to C."""
    return stop_times.join(stops.select("stop_id"), "stop_id", "left_semi")


def scheduled(trips: DataFrame, frequencies: DataFrame) -> DataFrame:
    """Trips without a frequency."""
    return trips.join(frequencies.select("trip_id"), "trip_id", "left_anti")


def frequency_legs(stop_times: DataFrame, frequencies: DataFrame) -> DataFrame:
    """trip_id, leg, from_stop, to_stop, travel, start_time, end_time, headway: legs that repeat; frequencies with no headway are dropped."""
    rows = legs(stop_times).join(frequencies.filter("headway > 0"), "trip_id")
    own = Window.partitionBy("trip_id", "start_time").orderBy("seq")
    return rows.select("trip_id", F.row_number().over(own).alias("leg"), "from_stop", "to_stop", "travel", "start_time", "end_time", "headway")


def departures(freq_legs: DataFrame) -> DataFrame:
    """Every departure of every repeating leg: at start, and each headway after it, before the end. The same times hold at every stop of the trip."""
    times = F.when(F.col("end_time") > F.col("start_time"), F.sequence("start_time", F.col("end_time") - 1, F.col("headway")))
    return freq_legs.select("*", F.explode(times).alias("board"))


def departures_by_time(freq_legs: DataFrame) -> DataFrame:
    """The departures in the order of time, then trip and leg: range-partitioned, so that no task sorts all."""
    return departures(freq_legs).orderBy("board", "trip_id", "leg")


def as_trips(stop_times: DataFrame, frequencies: DataFrame, span=(None, None)) -> DataFrame:
    """Frequency trips as plain ones that can be boarded at their first row only: one for each leg and departure, running on by leg times without dwell.

    With a span of seconds, those alone that leave within it: the others cannot be boarded there.
    """
    on = frequency_legs(stop_times, frequencies)
    onward = Window.partitionBy("trip_id", "start_time").orderBy("leg")
    on = on.withColumn("ends", F.sum("travel").over(onward.rowsBetween(Window.unboundedPreceding, 0)))
    leave = departures(on)
    if span != (None, None):
        leave = leave.filter(F.col("board").between(*span))
    starts = leave.select("trip_id", "start_time", F.col("leg").alias("first"), "from_stop", "board", (F.col("ends") - F.col("travel")).alias("base"))
    rides = starts.join(on.select("trip_id", "start_time", "leg", "to_stop", "ends"), ["trip_id", "start_time"]).filter("leg >= first")
    name = F.concat_ws("/", F.col("trip_id").cast("string"), "start_time", "first", "board")
    heads = starts.select(name.alias("trip_id"), F.lit(0).alias("seq"), F.col("from_stop").alias("stop_id"), F.col("board").alias("arr"), F.col("board").alias("dep"), F.lit(True).alias("boardable"))
    tails = rides.select(name.alias("trip_id"), (F.col("leg") - F.col("first") + 1).alias("seq"), F.col("to_stop").alias("stop_id"), (F.col("board") + F.col("ends") - F.col("base")).cast("int").alias("arr"), (F.col("board") + F.col("ends") - F.col("base")).cast("int").alias("dep"), F.lit(False).alias("boardable"))
    return heads.unionByName(tails)


def boardable_rows(stop_times: DataFrame) -> DataFrame:
    """Stop times with ``segment`` and ``boardable``: a trip's last row cannot be boarded, nor one before a leg of no time, which also ends a ride."""
    own = _trip()
    zero = F.greatest(F.lit(0), F.lead("arr").over(own) - F.col("dep")) == 0
    rows = stop_times.withColumn("zero", F.coalesce(zero, F.lit(False))).withColumn("end", F.lead("arr").over(own).isNull())
    # a rider who arrives at the row of a zero leg ends there: the rows after it are a new segment
    segment = F.sum(F.col("zero").cast("int")).over(own.rowsBetween(Window.unboundedPreceding, -1))
    return rows.withColumn("segment", F.coalesce(segment, F.lit(0)).cast("int")).withColumn("boardable", ~F.col("zero") & ~F.col("end")).drop("zero", "end")


def dense_ids(rows: DataFrame, key: str, name: str) -> DataFrame:
    """Adds ``name``: the rank of ``key`` from 0.

    Keys are range-partitioned and counted; a partition's ids begin after those of the ones before, so no task sees all keys.
    """
    keys = rows.select(key).distinct()
    return rows.join(offsets(keys.withColumn("_one", F.lit(1)), key, "_one", name).drop("_one"), key)


def offsets(counts: DataFrame, key: str, n: str, name: str) -> DataFrame:
    """Adds ``name``: the sum of ``n`` over all rows with a lesser ``key``, keys being distinct.

    Rows are range-partitioned, written with their partition, and summed in it; the partitions' sums, a row each, are put before.
    """
    parts = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(counts.repartitionByRange(parts, key).withColumn("_part", F.spark_partition_id()))
    earlier = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy("_part").agg(F.sum(n).alias("_sum"))
    base = sums.select("_part", F.coalesce(F.sum("_sum").over(earlier(Window.orderBy("_part"))), F.lit(0)).alias("_base"))
    before = F.coalesce(F.sum(n).over(earlier(Window.partitionBy("_part").orderBy(key))), F.lit(0))
    return ranged.join(F.broadcast(base), "_part").withColumn(name, F.col("_base") + before).drop("_part", "_base")


def with_route_names(stop_times: DataFrame, trips: DataFrame, routes: DataFrame) -> DataFrame:
    """Stop times with ``route_id`` and the ``route``'s name; rows of unknown trips or routes are skipped."""
    named = trips.select("trip_id", "route_id").join(routes.select("route_id", F.col("name").alias("route")), "route_id")
    return stop_times.join(named, "trip_id")


def search_rows(stop_times: DataFrame, frequencies: DataFrame, span=(None, None), repeated: DataFrame | None = None) -> DataFrame:
    """Rows a search runs on: scheduled trips, and frequency trips as one for each leg and departure (within ``span``, if given); trip ids are texts.

    ``repeated`` are the stop times of frequency trips where ``stop_times`` may lack them.
    """
    fixed = boardable_rows(scheduled(stop_times, frequencies)).withColumn("trip_id", F.col("trip_id").cast("string"))
    return fixed.unionByName(as_trips(stop_times if repeated is None else repeated, frequencies, span).withColumn("segment", F.lit(0)))
