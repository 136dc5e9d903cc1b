"""Timetable feeds: zips of comma-separated tables as typed DataFrames."""

from __future__ import annotations

import csv
import io
import uuid
import zipfile
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions import scalars as X
from wayfarer.functions.session import shared_dir
from wayfarer.operators import timetable

#: Tables of a feed, and those it may lack.
TABLES = ("stops", "routes", "trips", "stop_times", "calendar", "calendar_dates", "frequencies", "shapes", "feed_info")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
#: Rows in one batch that an executor hands on; characters of a part of a table, about.
_ROWS, PART = 20_000, 1 << 20


def member(names: list[str], table: str) -> str | None:
    """The zip's member of a table: by name in any case, in any folder."""
    wanted = f"{table}.txt"
    return next((n for n in names if n.lower() == wanted or n.lower().endswith("/" + wanted)), None)


def cut_at_rows(stream, size: int):
    """A table's text in parts of about ``size`` characters that end where a row does: a line end within quotes is none."""
    held = ""
    while chunk := stream.read(size):
        held += chunk
        at = held.rfind("\n")
        odd = held.count('"', 0, at + 1) % 2  # of quotes before the end
        while at >= 0 and odd:
            before = held.rfind("\n", 0, at)
            odd ^= held.count('"', before + 1, at + 1) % 2
            at = before
        if at >= 0:
            yield held[: at + 1]
            held = held[at + 1 :]
    if held:
        yield held


def unzipped(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """feed, part, header, lines, table: the tables of every zip under ``path``, unzipped once into the shared folder, in parts that are spread over the cluster.

    A zip is one row of a binary scan, so none may have over 2 GB; of its tables a part at a time is in memory as text.
    """

    def run(batches):
        for batch in batches:
            for feed, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = z.namelist()
                    for table in TABLES:
                        if name := member(names, table):
                            with z.open(name) as f:
                                header = None
                                for k, lines in enumerate(cut_at_rows(io.TextIOWrapper(f, "utf-8-sig", errors="replace", newline=""), PART)):
                                    header = header or [h.strip() for h in next(csv.reader(io.StringIO(lines, newline="")), [])]
                                    yield pa.RecordBatch.from_pydict({"feed": [feed], "part": pa.array([k], pa.int32()), "header": pa.array([header], pa.list_(pa.string())), "lines": [lines], "table": [table]})

    scan = spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+?)(\.gtfs)?\.zip$", 1).alias("feed"), "content")
    folder = f"{shared_dir(spark)}/feeds-{uuid.uuid4().hex}"
    parts = scan.mapInArrow(run, "feed string, part int, header array<string>, lines string, table string")
    parts.repartition(spark.sparkContext.defaultParallelism, "feed", "table", "part").write.partitionBy("table").parquet(folder)
    return spark.read.schema(parts.schema).parquet(folder)


def raw_table(parts: DataFrame, table: str) -> DataFrame:
    """feed, cells: a row of a table of every feed as a map of trimmed texts; ragged rows keep the cells they have. A table's parts alone are read, each in its own place."""

    def run(batches):
        for batch in batches:
            for feed, part, header, lines in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows = csv.reader(io.StringIO(lines, newline=""))
                if part == 0:
                    next(rows, None)
                out: list[list[tuple[str, str]]] = []
                for row in rows:
                    if row:
                        out.append([(h, v.strip()) for h, v in zip(header, row, strict=False)])
                    if len(out) >= _ROWS:
                        yield record(feed, out)
                        out = []
                yield record(feed, out)

    def record(feed, out):
        return pa.RecordBatch.from_arrays([pa.array([feed] * len(out), pa.string()), pa.array(out, pa.map_(pa.string(), pa.string()))], ["feed", "cells"])

    return parts.filter(F.col("table") == table).select("feed", "part", "header", "lines").mapInArrow(run, "feed string, cells map<string,string>")


def _cell(name: str) -> Column:
    return F.col("cells")[name]


def _text(name: str) -> Column:
    return F.coalesce(_cell(name), F.lit(""))


@dataclass(frozen=True)
class Feed:
    """The typed tables of one or more feeds; ids are unique within ``feed``."""

    stops: DataFrame
    routes: DataFrame
    trips: DataFrame
    stop_times: DataFrame
    services: DataFrame
    frequencies: DataFrame
    shapes: DataFrame
    info: DataFrame


def read(spark: SparkSession, path: str | list[str], bbox: tuple[float, float, float, float] | None = None) -> Feed:
    """The feeds under ``path``.

    Stops are places (no stations or entrances) with coordinates. Stop times of unknown trips or stops are left out, unknown
    times between known ones are filled in, and only then are stops outside of ``bbox`` dropped.
    """
    parts = unzipped(spark, path)
    raw = {t: raw_table(parts, t) for t in TABLES}
    place = F.coalesce(_cell("location_type"), F.lit("")).isin("", "0")
    lat, lon = X.number(_cell("stop_lat")), X.number(_cell("stop_lon"))
    stops = raw["stops"].filter(place & lat.isNotNull() & lon.isNotNull()).select("feed", _cell("stop_id").alias("stop_id"), _text("stop_name").alias("name"), lat.alias("lat"), lon.alias("lon"))
    r, g, b = X.colour_parts(_cell("route_color"))
    routes = raw["routes"].select("feed", _cell("route_id").alias("route_id"), X.first_named(_cell("route_short_name"), _cell("route_long_name")).alias("name"), F.when(r.isNotNull(), X.colour_hex(r, g, b)).alias("color"))
    trips = raw["trips"].select("feed", _cell("trip_id").alias("trip_id"), _cell("route_id").alias("route_id"), _cell("service_id").alias("service_id"), F.nullif(_cell("shape_id"), F.lit("")).alias("shape_id"))
    times = raw["stop_times"].select("feed", _cell("trip_id").alias("trip_id"), _cell("stop_id").alias("stop_id"), F.coalesce(_cell("stop_sequence").try_cast("int"), F.lit(0)).alias("seq"), X.time_of_day(_cell("arrival_time")).alias("arr"), X.time_of_day(_cell("departure_time")).alias("dep"))
    times = times.join(trips.select("feed", "trip_id"), ["feed", "trip_id"], "left_semi").join(stops.select("feed", "stop_id"), ["feed", "stop_id"], "left_semi")
    keyed = times.select(F.struct("feed", "trip_id").alias("trip_id"), "seq", "stop_id", "arr", "dep")
    filled = timetable.interpolate(keyed).select("trip_id.feed", "trip_id.trip_id", "seq", "stop_id", "arr", "dep")
    if bbox:
        stops = stops.filter(X.in_bbox(F.col("lat"), F.col("lon"), bbox))
        filled = filled.join(stops.select("feed", "stop_id"), ["feed", "stop_id"], "left_semi").select("feed", "trip_id", "seq", "stop_id", "arr", "dep")
    start, end = X.time_of_day(_cell("start_time")), X.time_of_day(_cell("end_time"))
    frequencies = raw["frequencies"].filter(start.isNotNull() & end.isNotNull()).select("feed", _cell("trip_id").alias("trip_id"), start.alias("start_time"), end.alias("end_time"), F.coalesce(_cell("headway_secs").try_cast("int"), F.lit(0)).alias("headway"))
    seq = _cell("shape_pt_sequence").try_cast("int")
    plat, plon = X.number(_cell("shape_pt_lat")), X.number(_cell("shape_pt_lon"))
    shapes = raw["shapes"].filter(seq.isNotNull() & plat.isNotNull() & plon.isNotNull()).select("feed", _cell("shape_id").alias("shape_id"), seq.alias("seq"), plat.alias("lat"), plon.alias("lon"))
    day = lambda c: F.nullif(X.date_number(_cell(c)), F.lit(0))
    info = raw["feed_info"].groupBy("feed").agg(F.first(day("feed_start_date"), ignorenulls=True).alias("start_date"), F.first(day("feed_end_date"), ignorenulls=True).alias("end_date"))
    return Feed(stops, routes, trips, filled, services(raw["calendar"], raw["calendar_dates"]), frequencies, shapes, info)


def services(calendar: DataFrame, dates: DataFrame) -> DataFrame:
    """feed, service_id, mask, start_date, end_date, adds, removes: calendars and their exceptions; a service may have either alone."""
    weekly = calendar.select("feed", _cell("service_id").alias("service_id"), X.weekday_mask([_cell(d) == "1" for d in DAYS]).alias("mask"), X.date_number(_cell("start_date")).alias("start_date"), X.date_number(_cell("end_date")).alias("end_date"))
    kind, day = _cell("exception_type"), X.date_number(_cell("date"))
    special = dates.filter(day != 0).groupBy("feed", _cell("service_id").alias("service_id")).agg(*[F.array_sort(F.collect_list(F.when(kind == k, day))).alias(n) for k, n in (("1", "adds"), ("2", "removes"))])
    none = F.expr("cast(array() as array<int>)")
    both = weekly.join(special, ["feed", "service_id"], "full")
    return both.select("feed", "service_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("mask", "start_date", "end_date")], *[F.coalesce(c, none).alias(c) for c in ("adds", "removes")])
