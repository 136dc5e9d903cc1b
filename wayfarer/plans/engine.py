"""The engine over one city's tables: snap a place, ask isochrones and journeys for many origins and windows at once."""

from __future__ import annotations

from contextlib import contextmanager
from dataclasses import dataclass, replace
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.session import cut
from wayfarer.operators import calendar, graph, paths, routing, shapes, spatial, timetable
from wayfarer.plans.catalog import Catalog


def _base():
    """The trip that a row's trip id names: a frequency trip's has the numbers of its start, leg and departure behind it."""
    return F.regexp_replace("trip_id", r"(/\d+){3}$", "")


@contextmanager
def cancellable(spark: SparkSession, tag: str):
    """Jobs inside carry ``tag``, by which ``cancel`` ends them and ``progress`` counts their tasks, both from another thread."""
    context = spark.sparkContext
    context.addJobTag(tag)
    try:
        yield
    finally:
        context.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> None:
    """Ends the jobs that carry ``tag`` just now; who waits for them gets an error, and a search drops its tables then."""
    spark.sparkContext.cancelJobsWithTag(tag)


def progress(spark: SparkSession, tag: str) -> tuple[int, int]:
    """(tasks done, tasks) of the stages that jobs with ``tag`` are at just now."""
    status, done, total = spark.sparkContext.statusTracker(), 0, 0
    for job in spark.sparkContext._jsc.sc().statusTracker().getJobIdsForTag(tag):
        found = status.getJobInfo(job)
        for stage in found.stageIds if found and found.status == "RUNNING" else ():
            if info := status.getStageInfo(stage):
                done, total = done + info.numCompletedTasks, total + info.numTasks
    return done, total


@dataclass(frozen=True)
class Answer:
    """What one search of a batch leaves: isochrones and journeys are read off it."""

    queries: DataFrame
    walks: DataFrame
    access: DataFrame
    state: DataFrame
    boards: DataFrame
    frontier: DataFrame


class Engine:
    """Questions to one city. ``max_walk`` bounds walks between stops and from them, in seconds."""

    def __init__(self, city: Catalog, *, max_walk: int = 1800):
        self.city, self.max_walk = city, max_walk
        self.spark = city.stops.sparkSession

    def snap(self, lat: float, lon: float) -> int | None:
        """The node nearest to a place; None if there is none around it."""
        point = self.spark.createDataFrame([(0, float(lat), float(lon))], "point_id long, lat double, lon double")
        found = spatial.nearest_nodes(point, self.city.nodes).first()
        return found and found.node_id

    @cached_property
    def egress(self) -> DataFrame:
        """stop_id, node_id, w: walks from every stop."""
        at = self.city.nodes.filter("stop_id is not null").select(F.col("node_id").alias("source"), "stop_id")
        walked = graph.walk_times(self.city.edges, at, self.max_walk)
        return cut(walked.join(at, "source").select("stop_id", "node_id", "w"))

    @cached_property
    def footpaths(self) -> DataFrame:
        """a, b, w: walks from stop to stop, each to itself at 0."""
        at = self.city.nodes.filter("stop_id is not null").select("node_id", F.col("stop_id").alias("b"))
        return cut(self.egress.join(at, "node_id").select(F.col("stop_id").alias("a"), "b", "w"))

    def patterns(self, date: int) -> int:
        """How many calendar patterns run on a date."""
        active = calendar.active_services(self.city.services, date).select("service_id")
        return calendar.patterns(self.city.services).select(F.explode("services").alias("service_id"), "mask", "start_date", "end_date", "adds", "removes").join(active, "service_id").select("mask", "start_date", "end_date", "adds", "removes").distinct().count()

    def rows(self, dates: list[int]) -> DataFrame:
        """Timetable rows of all dates, once each, with the ``days`` they run on: scheduled trips, and frequency trips as one for each leg and departure."""
        days = calendar.trip_days(self.city.trips, self.city.services, dates)
        times = self.city.stop_times.join(days.select("trip_id"), "trip_id", "left_semi")
        rows = timetable.search_rows(times, self.city.frequencies.join(days.select("trip_id"), "trip_id", "left_semi"))
        return rows.withColumn("base", _base()).join(days.withColumn("base", F.col("trip_id").cast("string")).select("base", "days"), "base").drop("base")

    def ask(self, queries: list[routing.Query], date: int | None = None, progress=None) -> Answer:
        """One search for all queries, each on its own date or else on ``date``; ``source`` is a node."""
        queries = [q if q.date is not None else replace(q, date=date) for q in queries]
        if any(q.date is None for q in queries):
            raise ValueError("a query has no date")
        asked = routing.query_table(self.spark, queries)
        found = graph.walk_times(self.city.edges, asked.select("source"), max(q.max_time for q in queries))
        walks = cut(found.join(F.broadcast(asked), "source").filter("w <= max_time").select("query_id", "node_id", "w"))
        at = self.city.nodes.filter("stop_id is not null").select("node_id", "stop_id")
        access = cut(walks.join(at, "node_id").select("query_id", "stop_id", "w"))
        left = routing.search(routing.events_of(self.rows(routing.dates_of(queries)), asked), access, self.footpaths, progress, journeys=True)
        return Answer(asked, walks, access, left.state, left.boards, cut(routing.frontier(left.state, self.egress, walks, rides=True)))

    def isochrone(self, answer: Answer) -> DataFrame:
        return routing.isochrone(answer.frontier, answer.walks, answer.queries)

    def rides(self, answer: Answer, node: int) -> DataFrame:
        """The rides of every best journey to a node."""
        names = answer.state.select("trip_id").distinct().withColumn("base", _base())
        routes = names.join(self.city.trips.select(F.col("trip_id").alias("base"), "route_id"), "base").select("trip_id", "route_id")
        asked = answer.frontier.filter(F.col("node_id") == node)
        return paths.trace(asked, answer.boards, routes)

    def segments(self, answer: Answer, node: int) -> DataFrame:
        """The segments of every best journey to a node."""
        return paths.segments(self.rides(answer, node))

    def journeys(self, answer: Answer, node: int) -> DataFrame:
        """Every best journey to a node, by query, departure and arrival."""
        return paths.journeys(self.segments(answer, node), self.city.stops, self.city.routes).orderBy("query_id", "home_dep", "arrival")

    def drawn(self, answer: Answer, node: int) -> DataFrame:
        """The segments of every best journey to a node with their durations and the coordinates of both ends."""
        homes = answer.queries.join(self.city.nodes.withColumnRenamed("node_id", "source"), "source").select("query_id", "lat", "lon")
        return paths.placed(self.segments(answer, node), self.city.stops, self.city.nodes, homes)

    def walking(self, answer: Answer, node: int) -> DataFrame:
        """query_id, home_dep, arrival of walking all the way, once a query."""
        return answer.walks.filter(F.col("node_id") == node).join(answer.queries, "query_id").select("query_id", F.col("window_start").alias("home_dep"), (F.col("window_start") + F.col("w")).alias("arrival"))

    def lines(self, answer: Answer, node: int) -> DataFrame:
        """ride_id, points: the drawn line of each ride of the journeys to a node, leg by leg through the stops it passes."""
        rides = self.rides(answer, node).select(F.concat_ws("|", "query_id", "home_dep", "step").alias("ride_id"), "trip_id", "route_id", "board_seq", "alight_seq")
        parts = paths.ride_stops(rides, answer.state.select("trip_id", "seq", "stop_id").distinct())
        return shapes.ride_shapes(parts.select("ride_id", "route_id", "stops"), self.city.leg_shapes, self.city.stops)
