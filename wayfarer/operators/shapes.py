"""Shapes of rides: stops matched to a route's polyline, and the polyline between neighbouring stops."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Mean squared degrees above which the line's other direction is tried, and how many times better it must be.
POOR, BETTER = 0.0005**2, 5.0


#: Numbers of a table of stops by segments that are held at once.
CELLS = 1 << 20


def match_all(stops: np.ndarray, lines: np.ndarray, cos_lat: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(segment, lat/lon on it, squared distance) of each stop and the sum, of many rides with as many stops and line points each.

    Strictly rising segments with the least sum of squared distances: a running minimum over segments carries the best of
    the stops before, so the tables are filled a stop at a time. The sum is not finite where there is none.
    """
    n, m = stops.shape[1], lines.shape[1] - 1
    a, d = lines[:, :-1], np.diff(lines, axis=1)
    scale = np.array([1.0, cos_lat])
    d_, a_, p = (d * scale)[:, None], (a * scale)[:, None], (stops * scale)[:, :, None]
    length = (d_**2).sum(axis=3)
    t = ((p - a_) * d_).sum(axis=3)
    t = np.clip(np.where(length > 1e-20, t / np.maximum(length, 1e-20), 0.0), 0.0, 1.0)
    cost = ((a_ + t[..., None] * d_ - p) ** 2).sum(axis=3)
    best = cost[:, 0].copy()
    back = np.zeros(cost.shape, np.int64)
    for k in range(1, n):
        least = np.minimum.accumulate(best, axis=1)
        # the place of the running minimum
        at = np.maximum.accumulate(np.where(best == least, np.arange(m), 0), axis=1)
        best = np.full(best.shape, np.inf)
        best[:, 1:] = cost[:, k, 1:] + least[:, :-1]
        back[:, k, 1:] = at[:, :-1]
    ride = np.arange(len(stops))
    segment = np.empty(stops.shape[:2], np.int64)
    segment[:, -1] = best.argmin(axis=1)
    for k in range(n - 1, 0, -1):
        segment[:, k - 1] = back[ride, k, segment[:, k]]
    each, stop = ride[:, None], np.arange(n)
    place = a[each, segment] + t[each, stop, segment][..., None] * d[each, segment]
    return segment, place, cost[each, stop, segment], best[ride, segment[:, -1]]


def match(stops: np.ndarray, line: np.ndarray, cos_lat: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, float] | None:
    """``match_all`` of one ride: None without stops, without a segment, or with more stops than segments."""
    n, m = len(stops), len(line) - 1
    if n == 0 or m < 1 or n > m:
        return None
    segment, place, far, total = (x[0] for x in match_all(stops[None], line[None], cos_lat))
    return (segment, place, far, float(total)) if np.isfinite(total) else None


def match_all_either_way(stops: np.ndarray, lines: np.ndarray, cos_lat: float):
    """(segment, place, squared distance, sum, lines as they are run) along the lines, or against those where that is much better."""
    segment, place, far, total = match_all(stops, lines, cos_lat)
    poor = np.flatnonzero(total / stops.shape[1] > POOR)
    if len(poor):
        back = match_all(stops[poor], lines[poor, ::-1], cos_lat)
        better = back[3] * BETTER < total[poor]
        turned = poor[better]
        lines = lines.copy()
        lines[turned] = lines[turned, ::-1]
        for kept, new in zip((segment, place, far, total), back, strict=True):
            kept[turned] = new[better]
    return segment, place, far, total, lines


def match_either_way(stops: np.ndarray, line: np.ndarray, cos_lat: float):
    """(segment, place, squared distance, reversed) along the line, or against it where that is much better."""
    ahead = match(stops, line, cos_lat)
    if ahead is None:
        return None
    if ahead[3] / len(stops) > POOR:
        back = match(stops, line[::-1], cos_lat)
        if back is not None and back[3] * BETTER < ahead[3]:
            return *back[:3], True
    return *ahead[:3], False


def _matched(trips: DataFrame, cos_lat: float, rides: bool) -> DataFrame:
    """route_id, from_stop, to_stop, quality, points of every leg of every trip; with ``rides`` also ride_id, k (its place in the trip, from 0)
    and the legs of trips without a match, straight and of infinite quality."""
    names = ["ride_id", "k"] * rides + ["route_id", "from_stop", "to_stop", "quality", "points"]

    def parts(column, *names):
        """Lengths of a column's lists, and the fields of their elements in a row."""
        flat = column.flatten()
        fields = flat.flatten()
        return pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64), [fields[flat.type.get_field_index(x)] for x in names]

    def points(lat, lon):
        return np.stack([np.asarray(x.to_numpy(zero_copy_only=False), np.float64) for x in (lat, lon)], axis=1)

    def record(batch, ids, some, at, stops, quality, ends, out):
        """Legs of the rides ``some`` of a batch, ``stops`` - 1 each, ``at`` the places of their first stops in ``ids``; a leg's points in ``out`` end at ``ends``."""
        each, k = np.repeat(some, stops - 1), np.tile(np.arange(stops - 1), len(some))
        line = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(out[:, 0]), pa.array(out[:, 1])], ["lat", "lon"]))
        first = np.repeat(at, stops - 1) + k
        own = [batch.column(3).take(pa.array(each)), pa.array(k.astype(np.int32))] if rides else []
        return pa.RecordBatch.from_arrays([*own, batch.column(0).take(pa.array(each)), ids.take(pa.array(first)), ids.take(pa.array(first + 1)), pa.array(quality), line], names)

    def straight(batch, ids, some, at, places):
        """The legs of rides with as many stops each that have no match."""
        stops = places.shape[1]
        out = np.stack([places[:, :-1], places[:, 1:]], axis=2).reshape(-1, 2)
        legs = len(some) * (stops - 1)
        return record(batch, ids, some, at, stops, np.full(legs, np.inf), 2 * np.arange(1, legs + 1), out)

    def legs(batch, ids, some, at, stops, lines):
        """The legs of rides with as many stops and line points each."""
        segment, place, far, total, lines = match_all_either_way(stops, lines, cos_lat)
        met = np.isfinite(total)
        if rides and not met.all():
            yield straight(batch, ids, some[~met], at[~met], stops[~met])
        segment, place, far, lines = segment[met], place[met], far[met], lines[met]
        between = np.diff(segment, axis=1).ravel()  # vertices of each leg
        each = np.repeat(np.arange(len(segment)), stops.shape[1] - 1)
        ends = np.cumsum(between + 2)
        starts, inner = ends - between - 2, np.arange(between.sum()) - np.repeat(np.cumsum(between) - between, between)
        out = np.empty((int(ends[-1]) if len(ends) else 0, 2))
        out[starts], out[ends - 1] = place[:, :-1].reshape(-1, 2), place[:, 1:].reshape(-1, 2)
        out[np.repeat(starts + 1, between) + inner] = lines[np.repeat(each, between), np.repeat(segment[:, :-1].ravel() + 1, between) + inner]
        yield record(batch, ids, some[met], at[met], stops.shape[1], np.maximum(far[:, :-1], far[:, 1:]).ravel(), ends, out)

    def run(batches):
        for batch in batches:
            n, (ids, *at_stops) = parts(batch.column(1), "stop_id", "lat", "lon")
            m, at_line = parts(batch.column(2), "lat", "lon")
            ids, at_stops, at_line = ids.cast(pa.int64()), points(*at_stops), points(*at_line)
            first, begins = np.cumsum(n) - n, np.cumsum(m) - m
            # rides of one shape together
            for stops, line in np.unique(np.stack([n, m], axis=1), axis=0).tolist():
                matched = 2 <= stops < line
                if matched or (rides and stops >= 2):
                    alike, step = np.flatnonzero((n == stops) & (m == line)), max(1, CELLS // (stops * max(line, 1)))
                    for some in (alike[k : k + step] for k in range(0, len(alike), step)):
                        at, places = first[some], at_stops[first[some][:, None] + np.arange(stops)]
                        if matched:
                            yield from legs(batch, ids, some, at, places, at_line[begins[some][:, None] + np.arange(line)])
                        else:
                            yield straight(batch, ids, some, at, places)

    given = [F.col("route_id").cast("long").alias("route_id"), "stops", "line", *([F.col("trip_id").cast("long").alias("trip_id")] * rides)]
    return trips.select(*given).mapInArrow(run, "ride_id long, k int, " * rides + "route_id long, from_stop long, to_stop long, quality double, points array<struct<lat:double,lon:double>>")


def leg_shapes(trips: DataFrame, cos_lat: float) -> DataFrame:
    """route_id, from_stop, to_stop, quality, points: the polyline of each leg, of all trips that make it the one whose two stops lie nearest.

    ``trips``: route_id, stops (array of stop_id, lat, lon), line (array of lat, lon). A leg's line runs from the first
    stop's place on the shape over its vertices to the second's. The best is a minimum that tasks take before the shuffle.
    """
    rows = _matched(trips, cos_lat, False)
    return rows.groupBy("from_stop", "to_stop", "route_id").agg(F.min(F.struct("quality", "points")).alias("b")).select("route_id", "from_stop", "to_stop", "b.quality", "b.points")


def trip_shapes(trips: DataFrame, cos_lat: float) -> DataFrame:
    """ride_id, points: ``ride_shapes`` of whole trips by the ``leg_shapes`` of the same trips, which are met once: each leg
    carries its ride to where the best of the leg is told and from there to the ride.

    ``trips``: trip_id, route_id, stops, line as ``leg_shapes`` has them, ids not null; those of fewer than two stops have no line.
    """
    alike = Window.partitionBy("from_stop", "to_stop", "route_id")
    best = _matched(trips, cos_lat, True).select("ride_id", "k", F.min(F.struct("quality", "points")).over(alike)["points"].alias("line"))
    return _strung(best)


def ride_shapes(rides: DataFrame, shapes: DataFrame, stops: DataFrame) -> DataFrame:
    """ride_id, points: the legs' lines of each ride (ride_id, route_id, stops) in a row; joints once, a straight line where a leg has none."""
    legs = rides.select("ride_id", "route_id", F.posexplode(F.zip_with(F.slice("stops", F.lit(1), F.size("stops") - 1), F.slice("stops", F.lit(2), F.size("stops") - 1), lambda a, b: F.struct(a.alias("a"), b.alias("b")))).alias("k", "leg"))
    legs = legs.select("ride_id", "route_id", "k", F.col("leg.a").alias("from_stop"), F.col("leg.b").alias("to_stop")).join(shapes.select("route_id", "from_stop", "to_stop", "points"), ["route_id", "from_stop", "to_stop"], "left")
    place = stops.select("stop_id", F.struct("lat", "lon").alias("p"))
    legs = legs.join(place.toDF("from_stop", "pa"), "from_stop").join(place.toDF("to_stop", "pb"), "to_stop")
    return _strung(legs.select("ride_id", "k", F.coalesce("points", F.array("pa", "pb")).alias("line")))


def _strung(legs: DataFrame) -> DataFrame:
    """ride_id, points of legs (ride_id, k, line): their lines by k in a row, joints once."""
    rows = legs.withColumn("line", F.when(F.col("k") > 0, F.slice("line", F.lit(2), F.size("line"))).otherwise(F.col("line")))
    return rows.groupBy("ride_id").agg(F.sort_array(F.collect_list(F.struct("k", "line"))).alias("legs")).select("ride_id", F.flatten(F.col("legs.line")).alias("points"))


def drawn_once(segments: DataFrame) -> DataFrame:
    """Segments with each pair of stops of a route once, whichever way it is travelled."""
    return segments.withColumn("a", F.least("from_stop", "to_stop")).withColumn("b", F.greatest("from_stop", "to_stop")).dropDuplicates(["route_id", "a", "b"]).drop("a", "b")


def in_order(points: DataFrame) -> DataFrame:
    """shape_id, line: the points of each shape by sequence."""
    return points.groupBy("shape_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "lat", "lon"))), lambda p: F.struct(p["lat"].alias("lat"), p["lon"].alias("lon"))).alias("line"))


def with_previous(points: DataFrame) -> DataFrame:
    """Each point of a shape with the one before it."""
    own = Window.partitionBy("shape_id").orderBy("seq")
    return points.withColumn("plat", F.lag("lat").over(own)).withColumn("plon", F.lag("lon").over(own))
