"""Service calendars: groups, masks, activity on a date, and what to do with stale feeds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import scalars as X

#: Days by which a feed's dates may miss today, or two services' dates each other.
THRESHOLD_DAYS = 7


def with_masks(services: DataFrame) -> DataFrame:
    """Services with weekdays for those that name dates only: from their added dates; if no service has a weekday and all name dates, every day."""
    mask = F.when((F.col("mask") == 0) & (F.size("adds") > 0), X.mask_of_dates(F.col("adds"))).otherwise(F.col("mask"))
    rows = services.withColumn("mask", mask)
    dated = (F.size("adds") > 0) | (F.size("removes") > 0)
    none = rows.agg(F.coalesce(F.bool_and((F.col("mask") == 0) & dated), F.lit(False)).alias("none"))  # one row
    return rows.crossJoin(F.broadcast(none)).withColumn("mask", F.when(F.col("none"), F.lit(127)).otherwise(F.col("mask"))).drop("none")


def patterns(services: DataFrame) -> DataFrame:
    """mask, start_date, end_date, adds, removes, services: services with equal calendars are one pattern."""
    rows = with_masks(services).withColumn("adds", F.array_sort("adds")).withColumn("removes", F.array_sort("removes"))
    return rows.groupBy("mask", "start_date", "end_date", "adds", "removes").agg(F.array_sort(F.collect_list("service_id")).alias("services"))


def date_range(services: DataFrame) -> DataFrame:
    """The least start and greatest end; 0 bounds nothing and does not count."""
    return services.agg(F.coalesce(F.min(F.nullif("start_date", F.lit(0))), F.lit(0)).alias("start_date"), F.coalesce(F.max("end_date"), F.lit(0)).alias("end_date"))


def time_ranges(services: DataFrame, trips: DataFrame, stop_times: DataFrame) -> DataFrame:
    """service_id, min_time, max_time of the departures of a service's trips; 0 and 0 without any. Times are reduced to a row a trip before they meet the services."""
    of_trip = stop_times.groupBy("trip_id").agg(F.min("dep").alias("least"), F.max("dep").alias("most"))
    ranges = trips.select("trip_id", "service_id").join(of_trip, "trip_id").groupBy("service_id").agg(F.min("least").alias("least"), F.max("most").alias("most"))
    return services.select("service_id").distinct().join(ranges, "service_id", "left").select("service_id", F.coalesce("least", F.lit(0)).alias("min_time"), F.coalesce("most", F.lit(0)).alias("max_time"))


def is_active(date: int | Column) -> Column:
    """Whether a calendar row holds on a date: not removed, and added or on its weekday within its range, where 0 is no bound."""
    d = F.lit(date) if isinstance(date, int) else date
    on_day = F.col("mask").bitwiseAND(X.day_bit(d)) != 0
    ranged = ((F.col("start_date") == 0) | (F.col("start_date") <= d)) & ((F.col("end_date") == 0) | (F.col("end_date") >= d))
    return ~F.array_contains("removes", d) & (F.array_contains("adds", d) | (on_day & ranged))


def active_services(services: DataFrame, date: int, *, strict_dates: bool = False) -> DataFrame:
    """Services that run on a date. ``strict_dates`` keeps services without weekdays to their added dates."""
    rows = services if strict_dates else with_masks(services)
    return rows.filter(is_active(date))


#: Dates of one word of a bitmap of days.
WORD = 60


def service_days(services: DataFrame, dates: list[int], *, strict_dates: bool = False) -> DataFrame:
    """service_id, days: on which of ``dates`` a service runs, as words of WORD bits, the k-th date being bit k % WORD of word k // WORD. Services that run on none are left out."""
    rows = services if strict_dates else with_masks(services)
    runs = F.transform(F.array(*map(F.lit, dates)), is_active)
    bits = lambda word: F.transform(F.slice("runs", word * WORD + 1, WORD), lambda on, k: F.when(on, F.call_function("shiftleft", F.lit(1).cast("long"), k)).otherwise(F.lit(0).cast("long")))
    words = F.array(*[F.aggregate(bits(k), F.lit(0).cast("long"), lambda acc, x: acc.bitwiseOR(x)) for k in range(-(-len(dates) // WORD))])
    return rows.withColumn("runs", runs).filter(F.exists("runs", lambda on: on)).select("service_id", words.alias("days"))


def runs_on(days: str, number: str | Column) -> Column:
    """Whether a bitmap of days has the date with a number."""
    k = F.col(number) if isinstance(number, str) else number
    return F.getbit(F.element_at(days, F.floor(k / WORD).cast("int") + 1), (k % WORD).cast("int")) == 1


def trip_days(trips: DataFrame, services: DataFrame, dates: list[int]) -> DataFrame:
    """trip_id, days of the trips that run on any of ``dates``: services are few, so the join is one pass over the trips."""
    return trips.join(service_days(services, dates), "service_id").select("trip_id", "days")


def stop_days(stop_times: DataFrame, trips: DataFrame, services: DataFrame, dates: list[int]) -> DataFrame:
    """stop_id, days: on which of ``dates`` any trip calls at a stop. Trips are reduced to a row for each stop and service before the bitmaps meet."""
    served = stop_times.select("trip_id", "stop_id").join(trips.select("trip_id", "service_id"), "trip_id").select("stop_id", "service_id").distinct()
    met = served.join(service_days(services, dates), "service_id")
    words = [F.bit_or(F.col("days")[k]).alias(f"w{k}") for k in range(-(-len(dates) // WORD))]
    return met.groupBy("stop_id").agg(*words).select("stop_id", F.array(*[f"w{k}" for k in range(len(words))]).alias("days"))


def active_trips(trips: DataFrame, services: DataFrame, date: int) -> DataFrame:
    """Trips of the active services: services are few, so the join is one pass over the trips."""
    return trips.join(active_services(services, date).select("service_id"), "service_id", "left_semi")


def handoffs(services: DataFrame) -> DataFrame:
    """service_id, has_successor, has_predecessor: another service that begins within a week of the day after this one's end and ends later, or ends within a week of the day before its start and began earlier.

    A band join over start weeks: each service meets only those whose dates fall into its neighbouring weeks.
    """
    days = services.select("service_id", X.epoch_days(F.col("start_date")).alias("s"), X.epoch_days(F.col("end_date")).alias("e"))
    week = lambda c: F.floor(c / THRESHOLD_DAYS)
    near = lambda c: F.explode(F.sequence(week(c) - 2, week(c) + 2))
    ends = days.filter(F.col("e").isNotNull()).select("service_id", "s", "e", near(F.col("e")).alias("w"))
    starts = days.filter(F.col("s").isNotNull()).select(F.col("service_id").alias("other"), F.col("s").alias("os"), F.col("e").alias("oe"), week(F.col("s")).alias("w"))
    after = ends.join(starts, "w").filter((F.col("service_id") != F.col("other")) & (F.col("oe").isNull() | (F.col("oe") > F.col("e"))) & (F.abs(F.col("os") - F.col("e") - 1) <= THRESHOLD_DAYS)).select("service_id").distinct()
    begun = days.filter(F.col("s").isNotNull()).select("service_id", "s", near(F.col("s")).alias("w"))
    ended = days.filter(F.col("e").isNotNull()).select(F.col("service_id").alias("other"), F.col("s").alias("os"), F.col("e").alias("oe"), week(F.col("e")).alias("w"))
    before = begun.join(ended, "w").filter((F.col("service_id") != F.col("other")) & (F.col("os").isNull() | (F.col("os") < F.col("s"))) & (F.abs(F.col("oe") - F.col("s") + 1) <= THRESHOLD_DAYS)).select("service_id").distinct()
    rows = services.select("service_id").join(after.withColumn("has_successor", F.lit(True)), "service_id", "left").join(before.withColumn("has_predecessor", F.lit(True)), "service_id", "left")
    return rows.select("service_id", *[F.coalesce(c, F.lit(False)).alias(c) for c in ("has_successor", "has_predecessor")])


def apply_stale_policy(services: DataFrame, today: int, feed_start: int | None, feed_end: int | None, allow_stale: bool | None = None) -> DataFrame:
    """Services of a feed that does not cover today made to: ``allow_stale`` False changes nothing, True unbounds all.

    By default a feed that ends within a week of today, or gives no end, has the ends of services without a successor
    opened; one that begins no more than a week before today, or gives no start, the starts of those without a predecessor.
    """
    if allow_stale is False:
        return services
    if allow_stale:
        return services.withColumn("start_date", F.lit(0)).withColumn("end_date", F.lit(0))
    day = X.epoch_days(F.lit(today))
    stale = F.coalesce(day + THRESHOLD_DAYS > X.epoch_days(F.lit(feed_end or 0)), F.lit(True))
    early = F.coalesce(X.epoch_days(F.lit(feed_start or 0)) + THRESHOLD_DAYS > day, F.lit(True))
    rows = services.join(handoffs(services), "service_id")
    end = F.when(stale & ~F.col("has_successor"), F.lit(0)).otherwise(F.col("end_date"))
    start = F.when(early & ~F.col("has_predecessor"), F.lit(0)).otherwise(F.col("start_date"))
    return rows.withColumn("end_date", end).withColumn("start_date", start).drop("has_successor", "has_predecessor")


def last_service_date(services: DataFrame) -> DataFrame:
    """last_date: the latest end or added date, 0 if none is known."""
    return services.agg(F.coalesce(F.max(F.greatest("end_date", F.coalesce(F.array_max("adds"), F.lit(0)))), F.lit(0)).alias("last_date"))


def expired(services: DataFrame, today: int) -> DataFrame:
    """last_date and whether it is more than a day before today."""
    days = X.epoch_days(F.lit(today)) - X.epoch_days(F.col("last_date"))
    return last_service_date(services).withColumn("expired", F.coalesce(days > 1, F.lit(False)))
