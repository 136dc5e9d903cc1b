"""What leaves the engine for maps, pages and texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayfarer.functions import geo
from wayfarer.functions import scalars as X


def flat_coordinates(nodes: DataFrame, chunk: int = 10_000) -> DataFrame:
    """chunk, coordinates: lat and lon of nodes by id in flat arrays of bounded length, to be written one after the other."""
    rows = nodes.select((F.col("node_id") / chunk).cast("long").alias("chunk"), "node_id", "lat", "lon")
    points = F.array_sort(F.collect_list(F.struct("node_id", "lat", "lon")))
    return rows.groupBy("chunk").agg(F.flatten(F.transform(points, lambda p: F.array(p["lat"], p["lon"]))).alias("coordinates"))


def raster_points(iso: DataFrame, nodes: DataFrame, *, zoom: int, left: float, top: float, width: int, height: int, max_time: int) -> DataFrame:
    """node_id, x, y (in clip space, -1 to 1), r, g, b of the nodes whose dot touches a view of ``width`` x ``height`` pixels at (left, top)."""
    size = geo.dot_size(zoom)
    px, py = geo.mercator(F.col("lat"), F.col("lon"), 256.0 * 2**zoom)
    seen = nodes.select("node_id", (px - left).alias("px"), (py - top).alias("py")).filter(F.col("px").between(-size, width + size) & F.col("py").between(-size, height + size))
    rows = iso.filter(F.col("mean_travel_time").between(0, max_time)).join(seen, "node_id")
    r, g, b = X.isochrone_colour(F.col("mean_travel_time"), F.lit(float(max_time)), F.col("reachable_fraction") / F.lit(65535.0))
    return rows.select("node_id", (F.col("px") * (2 / width) - 1).alias("x"), (1 - F.col("py") * (2 / height)).alias("y"), r.alias("r"), g.alias("g"), b.alias("b"))


def legend(max_time: float) -> Column:
    """The colour stops of a legend, evenly over the time budget, as CSS."""
    stops = []
    for k in range(5):
        t = F.lit(k / 4)
        r, g, b = X.warm_colour(t)
        stops.append(F.format_string("rgb(%d,%d,%d)", r, g, b))
    return F.concat(F.lit("linear-gradient(to right, "), F.concat_ws(", ", *stops), F.lit(")"))


def on_phase(board: Column, start: Column, end: Column, headway: Column) -> Column:
    """Whether a time is a departure of a headway service: from start, before end, a whole number of headways on."""
    return (board >= start) & (board < end) & ((board - start) % headway == 0)


def trip_summary(journeys: DataFrame) -> DataFrame:
    """query_id, node_id, home_dep, text: a journey as lines to copy: when it leaves and arrives, and its segments."""
    line = lambda s: F.concat(X.clock(s["start_time"]), F.lit(" "), F.when(s["kind"] == "walk", F.lit("walk")).otherwise(F.concat(s["route_name"], F.lit(" "), s["from_name"], F.lit(" to "), s["to_name"])), F.lit(" ("), X.minutes_seconds(s["end_time"] - s["start_time"]), F.lit(")"))
    head = F.concat(F.lit("Leave "), X.clock(F.col("home_dep")), F.lit(", arrive "), X.clock(F.col("arrival")), F.lit(", "), X.minutes_seconds(F.col("total_time")))
    return journeys.select("query_id", "node_id", "home_dep", F.concat(head, F.lit("\n"), F.array_join(F.transform("segments", line), "\n")).alias("text"))


def census(wanted: DataFrame, traced: DataFrame, keys: list[str]) -> DataFrame:
    """rows, traced: how many frontier rows there are and how many have a journey."""
    rows = wanted.select(*keys).join(traced.select(*keys).distinct().withColumn("ok", F.lit(1)), keys, "left")
    return rows.agg(F.count("*").alias("rows"), F.count("ok").alias("traced"))


def untraced(wanted: DataFrame, traced: DataFrame, keys: list[str], most: int = 5) -> DataFrame:
    """The first ``most`` frontier rows, by their keys, that have no journey: a report of what failed."""
    return wanted.select(*keys).join(traced.select(*keys), keys, "left_anti").orderBy(*keys).limit(most)


def size_table(files: DataFrame, largest: str = "G") -> DataFrame:
    """name, size: rows of a table of sizes, in units up to ``largest``, by name in any case."""
    return files.select("name", X.human_size(F.col("bytes"), largest).alias("size")).orderBy(F.lower("name"))
