"""Journeys behind frontier rows: the boardings that they came from, resolved for all rows at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.session import cut, sweep


def _needed(front: DataFrame, boards: DataFrame) -> DataFrame:
    """The boardings that ``front``'s rows came from, each once, found backwards from their last rides.

    Boardings stay in the buckets of their trips; what is asked of a trip is dealt to it.
    """
    trip = ["query_id", "trip_id", "segment"]
    rows = boards.withColumnRenamed("h", "home_dep").withColumnRenamed("seq", "board_seq")
    asked = front.select("query_id", "home_dep", "last.end.trip_id", "last.end.segment", "last.end.board_seq")
    found = None
    while found is None or asked.limit(1).count():
        of_trip = asked.groupBy(*trip).agg(F.collect_set(F.struct("board_seq", "home_dep")).alias("asked"))
        got = cut(rows.join(of_trip.hint("shuffle_hash"), trip).filter(F.array_contains("asked", F.struct("board_seq", "home_dep"))).drop("asked"))
        sweep(front.sparkSession)
        found = got if found is None else found.unionByName(got)
        asked = got.filter("came is not null").select("query_id", "home_dep", "came.trip_id", "came.segment", "came.board_seq")
    return found.dropDuplicates([*trip, "board_seq", "home_dep"])


def trace(front: DataFrame, boards: DataFrame, routes_of_trips: DataFrame | None = None) -> DataFrame:
    """query_id, node_id, home_dep, arrival, step, trip_id, route_id, board_seq, board_stop, board_dep, alight_seq, alight_stop, alight_arr, walk_after of every ride.

    ``front`` holds the frontier rows asked for, with their last rides; ``boards`` is what the search left. Steps count back from
    the destination: step 0 is the last ride. A boarding names the one it came from, with the same home departure; chains are
    resolved by pointer doubling: each round joins every boarding to what its chain ends at so far, so chains of n rides take
    log2(n) joins. Only boardings that rows asked for came from take part. Without ``routes_of_trips`` routes are null.
    """
    keys, own = ["query_id", "node_id", "home_dep", "arrival"], ["query_id", "trip_id", "segment", "board_seq", "home_dep"]
    rows = _needed(front, boards)
    link = F.struct("trip_id", "board_seq", F.col("stop_id").alias("board_stop"), F.col("dep").alias("board_dep"), "access", "came")
    before = F.when(F.col("came").isNotNull(), F.struct("came.trip_id", "came.segment", "came.board_seq"))
    chains = cut(rows.select(*own, F.array(link).alias("chain"), before.alias("before")))
    while chains.filter("before is not null").limit(1).count():
        ends = chains.select("query_id", "home_dep", F.struct("trip_id", "segment", "board_seq").alias("before"), F.col("chain").alias("more"), F.col("before").alias("next"))
        open_ = chains.filter("before is not null").join(ends, ["query_id", "home_dep", "before"])
        chains = cut(chains.filter("before is null").unionByName(open_.select(*own, F.concat("chain", "more").alias("chain"), F.col("next").alias("before"))))
        sweep(front.sparkSession)
    last = front.select(*keys, "last.end.trip_id", "last.end.segment", "last.end.board_seq", "last")
    met = last.join(chains, own).select(*keys, "last", "chain", F.posexplode("chain").alias("step", "ride"))
    after = F.get("chain", F.col("step") - 1)["came"]  # how the ride after this one came from it; none after the last
    end = lambda mine, name: F.when(F.col("step") == 0, mine).otherwise(after[name]).alias(name)
    rides = met.select(
        *keys, "step", "ride.trip_id", "ride.board_seq", "ride.board_stop", "ride.board_dep", end(F.col("last.end.alight_seq"), "alight_seq"), end(F.col("last.alight_stop"), "alight_stop"), end(F.col("last.end.arr"), "alight_arr"),
        end(F.col("last.walk_after"), "walk_after"), F.col("ride.came").isNull().alias("first"), "ride.access",
    )
    out = rides.withColumn("route_id", F.lit(None).cast("int")) if routes_of_trips is None else rides.join(routes_of_trips.select("trip_id", "route_id"), "trip_id", "left")
    return out.select(*keys, "step", "trip_id", "route_id", "board_seq", "board_stop", "board_dep", "alight_seq", "alight_stop", "alight_arr", "walk_after", "first", F.when(F.col("first"), F.col("access")).alias("access"))


def segments(rides: DataFrame) -> DataFrame:
    """query_id, node_id, home_dep, arrival, n, kind, start_time, end_time, wait_time, from_stop, to_stop, route_id, trip_id in travel order.

    Walks of no length are left out. A ride's wait is the time since what came before ended. The walk from home starts at
    the home departure, so a rider held by the window's end waits at the stop.
    """
    keys, kinds = ["query_id", "node_id", "home_dep", "arrival"], rides.schema
    none = lambda name: F.lit(None).cast(kinds[name].dataType)
    step, names = F.col("step"), ("n", "kind", "start_time", "end_time", "from_stop", "to_stop", "route_id", "trip_id")
    part = lambda *values: F.struct(*[v.alias(name) for name, v in zip(names, values, strict=True)])
    on_foot = lambda n, *values: part(n, F.lit("walk"), *values, none("route_id"), none("trip_id"))
    home = F.when(F.col("first"), on_foot(-2 * step - 1, F.col("home_dep"), F.col("home_dep") + F.col("access"), none("board_stop"), F.col("board_stop")))
    ride = part(-2 * step, F.lit("transit"), F.col("board_dep"), F.col("alight_arr"), F.col("board_stop"), F.col("alight_stop"), F.col("route_id"), F.col("trip_id"))
    walk = on_foot(-2 * step + 1, F.col("alight_arr"), F.col("alight_arr") + F.col("walk_after"), F.col("alight_stop"), F.col("goal"))
    # a journey's rows are dealt once: its windows and what groups by the same keys follow where they lie
    next_board = F.lag("board_stop").over(Window.partitionBy(*keys).orderBy("step"))
    parts = F.filter(F.array(home, ride, walk), lambda x: (x["kind"] == "transit") | (x["end_time"] > x["start_time"]))
    rows = rides.withColumn("goal", next_board).select(*keys, F.explode(parts).alias("part")).select(*keys, "part.*")
    own = Window.partitionBy(*keys).orderBy("n")
    wait = F.when(F.col("kind") == "transit", F.col("start_time") - F.coalesce(F.lag("end_time").over(own), F.col("home_dep"))).otherwise(F.lit(0))
    return rows.withColumn("wait_time", wait.cast("int")).withColumn("n", F.row_number().over(own))


def placed(parts: DataFrame, stops: DataFrame, nodes: DataFrame, homes: DataFrame) -> DataFrame:
    """Segments with ``duration`` and the coordinates of both ends: those of stops, of the home (query_id, lat, lon) where a journey begins on foot, of the node where it ends so."""
    at = lambda df, key, name, tag: df.select(F.col(key).alias(name), F.col("lat").alias(f"{tag}_lat"), F.col("lon").alias(f"{tag}_lon"))
    rows = parts.join(at(stops, "stop_id", "from_stop", "a"), "from_stop", "left").join(at(stops, "stop_id", "to_stop", "b"), "to_stop", "left")
    rows = rows.join(at(nodes, "node_id", "node_id", "goal"), "node_id", "left").join(F.broadcast(at(homes, "query_id", "query_id", "home")), "query_id", "left")
    ends = [F.coalesce(f"{mine}_{c}", f"{other}_{c}").alias(f"{name}_{c}") for name, mine, other in (("from", "a", "home"), ("to", "b", "goal")) for c in ("lat", "lon")]
    return rows.select(*parts.columns, (F.col("end_time") - F.col("start_time")).alias("duration"), *ends)


def walk_minimum(walks: DataFrame) -> DataFrame:
    """node_id, walk: the least that walking all the way takes from any of the homes asked."""
    return walks.groupBy("node_id").agg(F.min("w").alias("walk"))


def journeys(parts: DataFrame, stops: DataFrame, routes: DataFrame) -> DataFrame:
    """query_id, node_id, home_dep, arrival, total_time, rides, dominant_route, view: one row a journey with its segments as an array and as JSON.

    The dominant route is that of the longest ride, of equal ones the last.
    """
    keys = ["query_id", "node_id", "home_dep", "arrival"]
    names = stops.select("stop_id", "name")
    rows = parts.join(names.toDF("from_stop", "from_name"), "from_stop", "left").join(names.toDF("to_stop", "to_name"), "to_stop", "left")
    rows = rows.join(routes.select("route_id", F.col("name").alias("route_name")), "route_id", "left")
    part = F.struct("n", "kind", "start_time", "end_time", "wait_time", F.coalesce("from_name", F.lit("")).alias("from_name"), F.coalesce("to_name", F.lit("")).alias("to_name"), "route_id", F.coalesce("route_name", F.lit("")).alias("route_name"))
    longest = F.max(F.when(F.col("kind") == "transit", F.struct((F.col("end_time") - F.col("start_time")).alias("d"), "n", "route_id")))
    out = rows.groupBy(*keys).agg(F.array_sort(F.collect_list(part)).alias("segments"), F.count_if(F.col("kind") == "transit").alias("rides"), longest.alias("longest"))
    total = (F.col("arrival") - F.col("home_dep")).alias("total_time")
    return out.select(*keys, total, "rides", F.col("longest.route_id").alias("dominant_route"), "segments").withColumn("view", F.to_json(F.struct("home_dep", "arrival", "total_time", "segments")))


def without_first_wait(journeys: DataFrame) -> DataFrame:
    """Journeys that leave as late as their first ride allows: its wait is taken from the total and added to the departure."""
    first = F.get(F.filter("segments", lambda s: s["kind"] == "transit"), F.lit(0))
    wait = F.coalesce(first["wait_time"], F.lit(0))
    rows = journeys.withColumn("wait", wait).withColumn("first_n", first["n"])
    moved = F.transform("segments", lambda s: s.withField("start_time", F.when(s["n"] < F.col("first_n"), s["start_time"] + F.col("wait")).otherwise(s["start_time"])).withField("end_time", F.when(s["n"] < F.col("first_n"), s["end_time"] + F.col("wait")).otherwise(s["end_time"])).withField("wait_time", F.when(s["n"] == F.col("first_n"), 0).otherwise(s["wait_time"])))
    return rows.select("query_id", "node_id", (F.col("home_dep") + F.col("wait")).alias("home_dep"), "arrival", (F.col("total_time") - F.col("wait")).alias("total_time"), moved.alias("segments"))


def ride_stops(rides: DataFrame, stop_times: DataFrame) -> DataFrame:
    """Adds ``stops``: the stops of each ride from boarding to alighting."""
    rows = rides.join(stop_times.select("trip_id", "seq", "stop_id"), "trip_id").filter("seq between board_seq and alight_seq")
    return rows.groupBy(*rides.columns).agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop_id"))), lambda x: x["stop_id"]).alias("stops"))


def merge_walks(steps: DataFrame) -> DataFrame:
    """path_id, n, kind, start_time, end_time: neighbouring steps of walking as one segment; rides stay apart."""
    own = Window.partitionBy("path_id").orderBy("n")
    new = F.when((F.col("kind") == "walk") & (F.lag("kind").over(own) == "walk"), 0).otherwise(1)
    rows = steps.withColumn("g", new)
    rows = rows.withColumn("g", F.sum("g").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("path_id", "g").agg(F.first("kind").alias("kind"), F.min("start_time").alias("start_time"), F.max("end_time").alias("end_time")).withColumnRenamed("g", "n")
