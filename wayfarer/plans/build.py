"""Building a city: feeds and a street map to the prepared tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.functions import geo
from wayfarer.functions.scalars import walk_seconds
from wayfarer.functions.session import cut
from wayfarer.operators import calendar, graph, shapes, spatial
from wayfarer.plans.catalog import Catalog
from wayfarer.sources import gtfs


def _key(*parts: str):
    """One text key of a feed and an id in it."""
    return F.concat_ws(":", *parts)


def build_city(spark: SparkSession, feed: gtfs.Feed, nodes: DataFrame, ways: DataFrame, *, today: int, allow_stale: bool | None = None, least_nodes: int = graph.LEAST_NODES) -> Catalog:
    """The prepared tables of a city.

    Feeds are one dataset with keys of feed and id. Streets are contracted, small components dropped, stops snapped and
    edges cut, what no stop reaches and dead ends removed, and chains collapsed; only stops on the graph keep their times.
    """
    info = {r.feed: r for r in feed.info.collect()}
    calendars = None
    for name in sorted(r.feed for r in feed.services.select("feed").distinct().collect()):
        own = feed.services.filter(F.col("feed") == name).withColumn("service_id", _key("feed", "service_id")).drop("feed")
        dates = info.get(name)
        own = calendar.apply_stale_policy(own, today, dates and dates.start_date, dates and dates.end_date, allow_stale)
        calendars = own if calendars is None else calendars.unionByName(own)

    numbers = Window.orderBy("feed", "stop_id")  # stops of a city: some ten thousand rows
    stops = cut(feed.stops.select("feed", "stop_id", "name", "lat", "lon").withColumn("number", F.row_number().over(numbers).cast("long") - 1))
    streets = graph.drop_small(graph.contract(ways, nodes), least_nodes)
    streets = cut(streets)
    snapped = cut(spatial.snap(stops.select(F.col("number").alias("stop_id"), "lat", "lon"), streets, nodes))
    edges, at = spatial.split_edges(streets, snapped)
    # a stop is a node of its own, joined to its place on the street
    own_nodes = at.select((F.col("stop_id") - (1 << 40)).alias("u"), F.col("node_id").alias("v"), "dist", F.col("stop_id"))
    edges = cut(edges.unionByName(own_nodes.select("u", "v", "dist")))
    ends = cut(own_nodes.select(F.col("u").alias("node_id"), "stop_id"))
    edges = graph.collapse_chains(graph.prune_leaves(graph.reachable(edges, ends), ends), ends)

    kept = stops.join(ends.select(F.col("stop_id").alias("number")), "number", "left_semi")
    place = nodes.select("node_id", "lat", "lon")
    virtual = snapped.join(place.toDF("u", "ulat", "ulon"), "u").join(place.toDF("v", "vlat", "vlon"), "v")
    virtual = virtual.join(at.select("stop_id", "node_id"), "stop_id").filter(F.col("node_id") >= spatial.VIRTUAL_IDS).groupBy("node_id").agg(F.min(geo.between(F.col("ulat"), F.col("vlat"), F.col("t"))).alias("lat"), F.min(geo.between(F.col("ulon"), F.col("vlon"), F.col("t"))).alias("lon"))
    of_stops = kept.select((F.col("number") - (1 << 40)).alias("node_id"), "lat", "lon")
    used = edges.select(F.explode(F.array("u", "v")).alias("node_id")).distinct()
    all_nodes = place.unionByName(virtual).unionByName(of_stops).join(used, "node_id", "left_semi").join(ends, "node_id", "left")

    numbered = kept.select("feed", F.col("stop_id").alias("old"), F.col("number").alias("stop_id"))
    times = feed.stop_times.withColumnRenamed("stop_id", "old").join(numbered, ["feed", "old"]).select("feed", _key("feed", "trip_id").alias("trip_id"), "seq", "stop_id", "arr", "dep")
    trips = feed.trips.select("feed", _key("feed", "trip_id").alias("trip_id"), _key("feed", "route_id").alias("route_id"), _key("feed", "service_id").alias("service_id"), "shape_id")
    times, trips = cut(times), trips.join(times.select("trip_id").distinct(), "trip_id", "left_semi")
    routes = feed.routes.select(_key("feed", "route_id").alias("route_id"), "name", "color").join(trips.select("route_id").distinct(), "route_id", "left_semi")
    frequencies = feed.frequencies.select(_key("feed", "trip_id").alias("trip_id"), "start_time", "end_time", "headway").join(trips.select("trip_id"), "trip_id", "left_semi")

    lines = shapes.in_order(feed.shapes.withColumn("shape_id", _key("feed", "shape_id")))
    with_stops = times.join(kept.select(F.col("number").alias("stop_id"), "lat", "lon"), "stop_id").groupBy("trip_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "stop_id", "lat", "lon"))), lambda s: F.struct(s["stop_id"].alias("stop_id"), s["lat"].alias("lat"), s["lon"].alias("lon"))).alias("stops"))
    route_numbers = routes.select("route_id", F.dense_rank().over(Window.orderBy("route_id")).cast("long").alias("number"))  # some hundred routes
    shaped = with_stops.join(trips.select("trip_id", "route_id", _key("feed", "shape_id").alias("shape_id")), "trip_id").join(lines, "shape_id").join(route_numbers, "route_id")
    cos_lat = spatial.extent(stops).first().cos_lat or 1.0
    legs = shapes.leg_shapes(shaped.select(F.col("number").alias("route_id"), "stops", "line"), cos_lat)
    legs = legs.withColumnRenamed("route_id", "number").join(route_numbers, "number").drop("number")
    return Catalog({
        "nodes": all_nodes, "edges": edges.select("u", "v", walk_seconds(F.col("dist")).alias("w")), "stops": kept.select(F.col("number").alias("stop_id"), "name", "lat", "lon"),
        "routes": routes, "trips": trips.select("trip_id", "route_id", "service_id"), "stop_times": times.select("trip_id", "seq", "stop_id", "arr", "dep"),
        "services": calendars, "frequencies": frequencies, "leg_shapes": legs,
    })
