"""Profile routing: for every departure second of a window at once, the latest departures and earliest arrivals at every place.

The search is a monotone fixpoint over timetable rows. Each row has ``h``, the latest home departure with which it can be
boarded, and ``m``, the latest with which one is aboard on arrival. Only what rises is handled: the rows of one trip of a
query lie in one bucket with the log of its boardings, those of one stop in another, and a round reads the trips and stops that
its rises touch: what is shuffled is who arrives and who is ready at stops anew, and the rows that this may raise. Every rise
keeps the boarding it came from. All queries of a batch run together: ``query_id`` is part of every key.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wayfarer.functions.session import cut, shared_dir, sweep
from wayfarer.operators import calendar

#: Values of a query that gives none: the whole service day, 45 minutes, one minute to change.
DEFAULT_WINDOW, DEFAULT_MAX_TIME, DEFAULT_SLACK = (0, 27 * 3600), 45 * 60, 60


@dataclass(frozen=True)
class Query:
    """One question: from a source, departing in a window of seconds (ends included) of a date, how far within ``max_time``."""

    query_id: int
    window_start: int = DEFAULT_WINDOW[0]
    window_end: int = DEFAULT_WINDOW[1]
    slack: int = DEFAULT_SLACK
    max_time: int = DEFAULT_MAX_TIME
    source: int = 0
    date: int | None = None

    def __post_init__(self):
        if self.window_end < self.window_start:
            raise ValueError("the window ends before it begins")
        if not 1 <= self.max_time < 65535:
            raise ValueError("max_time must be from 1 to 65534 seconds")
        if self.slack < 0:
            raise ValueError("slack must not be negative")


def dates_of(queries: list[Query]) -> list[int]:
    """The dates that a batch asks for, in order."""
    return sorted({q.date for q in queries if q.date is not None})


def query_table(spark: SparkSession, queries: list[Query]) -> DataFrame:
    """A row for each query; ``day`` is its date's number among those of the batch."""
    schema, dates = "query_id long, window_start int, window_end int, slack int, max_time int, source long, day int", dates_of(queries)
    return spark.createDataFrame([(q.query_id, q.window_start, q.window_end, q.slack, q.max_time, q.source, dates.index(q.date) if q.date is not None else None) for q in queries], schema)


def split_window(query: Query, parts: int) -> list[Query]:
    """The query as ``parts`` queries over neighbouring windows, none under 15 minutes; their frontiers together are the whole one's."""
    seconds = query.window_end - query.window_start + 1
    parts = max(1, min(parts, seconds // 900))
    cuts = [query.window_start + seconds * k // parts for k in range(parts + 1)]
    return [Query(query.query_id * parts + k, a, b - 1, query.slack, query.max_time, query.source, query.date) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def events_of(rows: DataFrame, queries: DataFrame) -> DataFrame:
    """Timetable rows (trip_id, segment, seq, stop_id, arr, dep, boardable) that each query can use.

    Queries are a driver's list, so they are broadcast; rows outside of all windows end at the scan's side of the join. Rows
    with ``days``, a bitmap over the batch's dates, are used by the queries of those dates alone.
    """
    near = (F.col("dep") >= F.col("window_start")) & (F.col("arr") <= F.col("window_end") + F.col("max_time"))
    near = near & calendar.runs_on("days", "day") if "days" in rows.columns else near
    return rows.join(F.broadcast(queries.drop("source")), near)


def _board(events: DataFrame, access: DataFrame) -> DataFrame:
    """``h`` of the first boarding: after the walk from home, with no slack; a departure after the window is waited for."""
    reach = access.select("query_id", "stop_id", F.col("w").alias("walk"))
    rows = events.join(reach, ["query_id", "stop_id"], "left")
    can = F.col("boardable") & (F.col("dep") >= F.col("window_start") + F.col("walk")) & (F.col("dep") <= F.col("window_end") + F.col("max_time"))
    return rows.withColumn("h", F.when(can, F.least(F.col("window_end"), F.col("dep") - F.col("walk")))).drop("walk")


def ride(events: DataFrame) -> DataFrame:
    """Adds ``m``: the latest home departure with which one is aboard on arrival at a row."""
    before = Window.partitionBy("query_id", "trip_id", "segment").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    return events.withColumn("m", F.max("h").over(before))


def transfers(arrivals: DataFrame, footpaths: DataFrame) -> DataFrame:
    """query_id, stop_id, ready, m: when riders who arrived can board again within walking reach; one row for each place and time."""
    walked = arrivals.join(footpaths.select(F.col("a").alias("stop_id"), "b", F.col("w").alias("walk")), "stop_id").filter(F.col("arr") + F.col("walk") - F.col("m") <= F.col("max_time"))
    return walked.groupBy("query_id", F.col("b").alias("stop_id"), (F.col("arr") + F.col("walk") + F.col("slack")).alias("ready")).agg(F.max("m").alias("m"))


def board_again(events: DataFrame, ready: DataFrame) -> DataFrame:
    """Raises ``h`` of boardable rows to the best of those ready at their stop by then: an as-of join by union and running maximum."""
    keep = [c for c in events.columns if c != "h"]
    both = events.withColumn("at", F.col("dep")).withColumn("late", F.lit(1)).withColumn("c", F.lit(None).cast("int"))
    more = ready.select("query_id", "stop_id", F.col("ready").alias("at"), F.lit(0).alias("late"), F.col("m").alias("c"))
    so_far = Window.partitionBy("query_id", "stop_id").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.unionByName(more, allowMissingColumns=True).withColumn("best", F.max("c").over(so_far)).filter("late = 1")
    return seen.select(*keep, F.when(F.col("boardable"), F.greatest("h", "best")).otherwise(F.col("h")).alias("h"))


#: Footpaths up to which they are broadcast (three numbers each); more are joined by a shuffle.
BROADCAST_PATHS = 1_000_000

_TRIP, _STOP = ["query_id", "trip_id", "segment"], ["query_id", "stop_id"]


@contextmanager
def _set(spark: SparkSession, key: str, value: str):
    """A setting, and what it was before again."""
    before = spark.conf.get(key)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before)


def _fixed_plans(spark: SparkSession):
    """Plans as they are made: the buckets fix the number of partitions, so there is nothing to adapt between a round's few stages."""
    return _set(spark, "spark.sql.adaptive.enabled", "false")


def _kept_buckets(spark: SparkSession):
    """Bucketed tables are read by bucket, also where nothing is joined yet: what is written from them lies in the same buckets."""
    return _set(spark, "spark.sql.sources.bucketing.autoBucketedScan.enabled", "false")


class _Buckets:
    """Tables of one search in the shared folder, bucketed by hash: what has the same key is joined and grouped where it lies."""

    def __init__(self, spark: SparkSession):
        self.spark, self.key = spark, f"search_{uuid.uuid4().hex}"
        self.folder, self.rows = f"{shared_dir(spark)}/{self.key}", {}
        self.number = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def add(self, name: str, rows: DataFrame, keys: list[str], order: str, *, deal: bool = True) -> DataFrame:
        """Appends rows to a table, which it gives. Without ``deal`` they lie in buckets already."""
        self.append(name, rows.repartition(self.number, *keys) if deal else rows, keys, order)
        return self.spark.table(f"{self.key}_{name}")

    def append(self, name: str, rows: DataFrame, keys: list[str], order: str) -> None:
        """Appends rows that lie in buckets already."""
        self.rows.setdefault(name, 0)
        writer = rows.write.bucketBy(self.number, *keys).sortBy(order).option("path", f"{self.folder}/{name}")
        writer.mode("append").format("parquet").saveAsTable(f"{self.key}_{name}")

    def added(self, name: str) -> int:
        """Rows added since this was last asked, from the files' footers."""
        before, self.rows[name] = self.rows[name], self.spark.table(f"{self.key}_{name}").count()
        return self.rows[name] - before

    def write(self, name: str, rows: DataFrame) -> int:
        """Writes rows as they are, to be read by name; gives how many they are."""
        rows.write.parquet(f"{self.folder}/{name}")
        table = self.spark.read.schema(rows.schema).parquet(f"{self.folder}/{name}")
        table.createOrReplaceTempView(f"{self.key}_{name}")
        return table.count()

    def drop(self) -> None:
        for name in ("feet", "now"):
            self.spark.catalog.dropTempView(f"{self.key}_{name}")
        for name in self.rows:
            self.spark.sql(f"DROP TABLE IF EXISTS {self.key}_{name}")
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


@dataclass(frozen=True)
class Found:
    """``state``: rows of all trips that can be boarded, with ``h``, ``m`` and ``board_seq``, the last row at which ``m`` can be had; ``boards``: every rise of a boarding and what it came from."""

    state: DataFrame
    boards: DataFrame | None


#: A round is two statements. The first finds who arrives better by the trips boarded anew in round ``now``. ``log``: each trip's boardings
#: so far. ``touched``: of those trips. ``rides``: their rows, with what is best aboard there now and before it. What an arrival at
#: the same stop matches, of this round or of one before (``past``), is beaten wherever it walks to, and ends here.
_ARRIVE = """
WITH log AS (
  SELECT query_id, trip_id, segment, collect_list(struct(seq, h, round)) AS boards, max(round) AS last FROM {key}_boards GROUP BY query_id, trip_id, segment),
touched AS (SELECT /*+ BROADCAST(n) */ l.*, n.now FROM log l JOIN {key}_now n ON l.last = n.now),
rides AS (
  SELECT /*+ SHUFFLE_HASH(l) */ t.query_id, t.trip_id, t.segment, t.seq, t.stop_id, t.arr, t.slack, t.max_time, l.now,
    array_max(transform(filter(boards, b -> b.seq < t.seq), b -> struct(b.h AS h, b.seq AS seq))) AS best,
    array_max(transform(filter(boards, b -> b.seq < t.seq AND b.round < l.now), b -> b.h)) AS was
  FROM {key}_trips t JOIN touched l ON t.query_id = l.query_id AND t.trip_id = l.trip_id AND t.segment = l.segment),
above AS (
  SELECT *, max(best.h) OVER (PARTITION BY query_id, stop_id ORDER BY arr, best.h DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above
  FROM rides WHERE best IS NOT NULL AND (was IS NULL OR best.h > was)),
past AS (SELECT query_id, stop_id, collect_list(struct(arr, m)) AS past FROM {key}_arrivals GROUP BY query_id, stop_id)
SELECT /*+ SHUFFLE_HASH(p) */ a.query_id, a.stop_id, a.arr, best.h AS m, slack, max_time, trip_id, segment, best.seq AS board_seq, seq AS alight_seq, now AS round
FROM above a LEFT JOIN past p ON a.query_id = p.query_id AND a.stop_id = p.stop_id
WHERE (above IS NULL OR best.h > above) AND NOT coalesce(exists(past, x -> x.arr <= a.arr AND x.m >= best.h), false)
"""

#: The second one boards them. ``ready``: who can board again after a walk, and how they came. ``steps``: of
#: those at a stop, the ones that no earlier one matches. ``raised``: the best step for each row of these stops.
#: Rows rise that beat their first boarding and their trip's log. Joins are by hash where the rows lie: nothing of the tables moves.
_ROUND = """
WITH log AS (SELECT query_id, trip_id, segment, collect_list(struct(seq, h)) AS boards FROM {key}_boards GROUP BY query_id, trip_id, segment),
fresh AS (SELECT /*+ BROADCAST(n) */ a.*, n.now FROM {key}_arrivals a JOIN {key}_now n ON a.round = n.now),
ready AS (
  SELECT {hint} r.query_id, f.b AS stop_id, arr + walk + slack AS ready, m, now,
    struct(trip_id, segment, board_seq, alight_seq, r.stop_id AS alight_stop, arr AS alight_arr, walk AS walk_after) AS came
  FROM fresh r JOIN {key}_feet f ON r.stop_id = f.stop_id WHERE arr + walk - m <= max_time),
above AS (
  SELECT *, max(m) OVER (PARTITION BY query_id, stop_id ORDER BY ready, m DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS above FROM ready),
steps AS (
  SELECT query_id, stop_id, collect_list(struct(m, ready, came)) AS steps, max(now) AS now FROM above WHERE above IS NULL OR m > above GROUP BY query_id, stop_id),
raised AS (
  SELECT /*+ SHUFFLE_HASH(p) */ s.query_id, s.trip_id, s.segment, s.seq, s.stop_id, s.dep, s.first, array_max(filter(steps, x -> x.ready <= s.dep)) AS best, now
  FROM {key}_stops s JOIN steps p ON s.query_id = p.query_id AND s.stop_id = p.stop_id)
SELECT /*+ SHUFFLE_HASH(l) */ r.query_id, r.trip_id, r.segment, r.seq, r.stop_id, r.dep, best.m AS h, CAST(NULL AS INT) AS access, CAST(best.came AS {came}) AS came, now + 1 AS round
FROM raised r LEFT JOIN log l ON r.query_id = l.query_id AND r.trip_id = l.trip_id AND r.segment = l.segment
WHERE best IS NOT NULL AND (first IS NULL OR best.m > first) AND coalesce(array_max(transform(filter(boards, b -> b.seq = r.seq), b -> b.h)) < best.m, true)
"""


def search(events: DataFrame, access: DataFrame, footpaths: DataFrame, progress=None, *, journeys: bool = False) -> Found:
    """The fixpoint. ``progress(round, risen, total)`` is called after each round with the boardings that rose in it and so far.

    What a round writes is what rose in it. The log of boardings and the rows that it is looked up for are tables bucketed by
    (query, trip, segment), rows that can be boarded are once more by (query, stop): neither is shuffled again. Arrivals that one at their
    stop matches are not walked on. ``boards`` is kept for ``journeys`` alone.
    """
    spark = events.sparkSession
    store = _Buckets(spark)
    columns = [*_TRIP, "seq", "stop_id", "arr", "dep", "boardable", "window_start", "window_end", "slack", "max_time"]
    try:
        by_trip = store.add("trips", events.select(*columns), _TRIP, "seq")
        walk = access.select("query_id", "stop_id", F.col("w").alias("access"))
        can = (F.col("dep") >= F.col("window_start") + F.col("access")) & (F.col("dep") <= F.col("window_end") + F.col("max_time"))
        first = F.when(can, F.least(F.col("window_end"), F.col("dep") - F.col("access")))
        at_stops = by_trip.filter("boardable").join(walk, _STOP, "left").select(*_TRIP, "seq", "stop_id", "dep", first.alias("first"), "access")
        by_stop = store.add("stops", at_stops, _STOP, "dep")
        feet = store.write("feet", footpaths.select(F.col("a").alias("stop_id"), "b", F.col("w").alias("walk")))
        sweep(spark)
        hint = "/*+ BROADCAST(f) */" if feet <= BROADCAST_PATHS else ""
        with _fixed_plans(spark), _kept_buckets(spark):
            boards = _rounds(store, by_trip, by_stop, hint, progress)
        of_trip = boards.groupBy(*_TRIP).agg(F.collect_list(F.struct("seq", "h")).alias("boards"))
        best = F.array_max(F.transform(F.filter("boards", lambda b: b["seq"] < F.col("seq")), lambda b: F.struct(b["h"].alias("h"), b["seq"].alias("seq"))))
        own = F.array_max(F.transform(F.filter("boards", lambda b: b["seq"] == F.col("seq")), lambda b: b["h"]))
        state = by_trip.join(of_trip, _TRIP).withColumn("h", own).withColumn("best", best).select(*columns, "h", F.col("best.h").alias("m"), F.col("best.seq").alias("board_seq"))
        with _kept_buckets(spark):
            return Found(cut(state), cut(boards.drop("round")) if journeys else None)
    finally:
        store.drop()


def _rounds(store: _Buckets, by_trip: DataFrame, by_stop: DataFrame, hint: str, progress) -> DataFrame:
    """The log of all boardings, once a round adds none."""
    kind = {c: by_trip.schema[c].dataType.simpleString() for c in ("trip_id", "segment", "seq", "stop_id", "arr")}
    came = f"struct<trip_id: {kind['trip_id']}, segment: {kind['segment']}, board_seq: {kind['seq']}, alight_seq: {kind['seq']}, alight_stop: {kind['stop_id']}, alight_arr: {kind['arr']}, walk_after: int>"
    begun = by_stop.filter("first is not null").select(*_TRIP, "seq", "stop_id", "dep", F.col("first").alias("h"), "access", F.lit(None).cast(came).alias("came"), F.lit(0).alias("round"))
    boards = store.add("boards", begun, _TRIP, "seq")
    arrivals = f"query_id long, stop_id {kind['stop_id']}, arr {kind['arr']}, m int, slack int, max_time int, trip_id {kind['trip_id']}, segment {kind['segment']}, board_seq {kind['seq']}, alight_seq {kind['seq']}, round int"
    store.append("arrivals", store.spark.createDataFrame([], arrivals), _STOP, "arr")
    number, total = 0, 0
    while risen := store.added("boards"):
        total += risen
        if progress:
            progress(number, risen, total)
        # the number is a row and no literal: the code made for a round serves the next one
        store.spark.createDataFrame([(number,)], "now int").createOrReplaceTempView(f"{store.key}_now")
        store.append("arrivals", store.spark.sql(_ARRIVE.format(key=store.key)), _STOP, "arr")
        boards = store.add("boards", store.spark.sql(_ROUND.format(key=store.key, hint=hint, came=came)), _TRIP, "seq", deal=False)
        number += 1
        sweep(store.spark)
    return boards


def fixpoint(events: DataFrame, access: DataFrame, footpaths: DataFrame, progress=None) -> DataFrame:
    """The state that ``search`` leaves."""
    return search(events, access, footpaths, progress).state


def frontier(state: DataFrame, egress: DataFrame, walks: DataFrame, *, keep_over_budget: bool = False, rides: bool = False) -> DataFrame:
    """query_id, node_id, home_dep, arrival: what no later departure with an earlier arrival beats, and walking does not.

    ``egress`` (stop_id, node_id, w) walks from stops to nodes; ``walks`` (query_id, node_id, w) from home to nodes. With
    ``rides`` each row has its last ride: of those that arrive in time the one that ends latest.
    """
    end = F.struct("arr", "trip_id", "segment", F.col("seq").alias("alight_seq"), "board_seq") if rides else F.col("arr")
    ended = state.filter("m is not null").select("query_id", "stop_id", "m", "arr", "max_time", end.alias("end")).repartition("stop_id")
    # what is beaten at a stop is beaten wherever one walks to from there
    ended = pareto(ended, ["query_id", "stop_id"], "m", "arr", "end")
    reached = ended.join(egress.withColumnRenamed("w", "out"), "stop_id")
    met = reached.join(walks.withColumnRenamed("w", "walk"), ["query_id", "node_id"], "left")
    arrival = F.col("arr") + F.col("out")
    rows = met.select("query_id", "node_id", F.col("m").alias("home_dep"), arrival.alias("arrival"), "walk", "max_time", F.col("out").alias("walk_after"), "stop_id", "end")
    if not keep_over_budget:
        rows = rows.filter(F.col("arrival") - F.col("home_dep") <= F.col("max_time"))
    rows = rows.filter(F.col("walk").isNull() | (F.col("arrival") - F.col("home_dep") < F.col("walk")))
    if not rides:
        return pareto(rows.groupBy("query_id", "node_id", "home_dep").agg(F.min("arrival").alias("arrival")), ["query_id", "node_id"])
    last = F.struct("arrival", "walk_after", "end", F.col("stop_id").alias("alight_stop"))
    return pareto(rows.select("query_id", "node_id", "home_dep", "arrival", last.alias("last")), ["query_id", "node_id"], "home_dep", "arrival", "last")


def pareto(rows: DataFrame, keys: list[str], late: str = "home_dep", early: str = "arrival", *then: str) -> DataFrame:
    """Rows of each key that no row with a later-or-equal ``late`` matches in ``early``; of rows equal in both the first by ``then``."""
    above = Window.partitionBy(*keys).orderBy(F.col(late).desc(), F.col(early), *then).rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("least", F.min(early).over(above)).filter(F.col("least").isNull() | (F.col(early) < F.col("least"))).drop("least")


def isochrone(front: DataFrame, walks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, node_id, num, den, mean_travel_time, reachable_fraction (of 65535) over every second of the window, in closed form.

    A frontier row serves the departures since the one before it, and each second of waiting adds one; departures for which
    that passes the time budget, or walking, do not count for it. Walking serves what is left. The mean is null if never reached.
    """
    own = Window.partitionBy("query_id", "node_id").orderBy("home_dep")
    asked = F.broadcast(queries.select("query_id", "window_start", "window_end", "max_time"))
    width = F.col("window_end") - F.col("window_start") + 1
    rows = front.join(asked, "query_id").join(walks.withColumnRenamed("w", "walk"), ["query_id", "node_id"], "left")
    travel = F.col("arrival") - F.col("home_dep")
    limit = F.coalesce(F.col("walk"), F.col("max_time") + 1)
    rows = rows.withColumn("limit", limit).withColumn("travel", travel.cast("long")).filter("travel < limit")
    rows = rows.withColumn("seg", F.col("home_dep") - F.coalesce(F.lag("home_dep").over(own), F.col("window_start") - 1))
    r = F.least(F.col("limit") - F.col("travel"), F.col("seg").cast("long"))
    rows = rows.withColumn("r", r).withColumn("s", F.expr("r * travel + r * (r - 1) div 2"))
    sums = rows.groupBy("query_id", "node_id").agg(F.sum("s").alias("num"), F.sum("r").alias("den"))
    walked = walks.filter(F.col("w").isNotNull()).select("query_id", "node_id", F.col("w").alias("walk"))
    both = sums.join(walked, ["query_id", "node_id"], "full").join(asked, "query_id")
    den0, num0 = F.coalesce("den", F.lit(0)), F.coalesce("num", F.lit(0))
    on_foot = F.col("walk").isNotNull() & (F.col("walk") <= F.col("max_time"))
    num = F.when(on_foot, num0 + F.col("walk") * (width - den0)).otherwise(num0)
    den = F.when(on_foot, width).otherwise(den0)
    out = both.select("query_id", "node_id", num.cast("long").alias("num"), den.cast("long").alias("den"), width.cast("long").alias("width")).filter("den > 0")
    return out.select("query_id", "node_id", "num", "den", F.expr("num div den").cast("int").alias("mean_travel_time"), F.expr("den * 65535 div width").cast("int").alias("reachable_fraction"))


def exploded_isochrone(front: DataFrame, walks: DataFrame, queries: DataFrame) -> DataFrame:
    """The same sums by every second of the window: the definition that ``isochrone`` has in closed form."""
    asked = F.broadcast(queries.select("query_id", "window_start", "window_end", "max_time"))
    own = Window.partitionBy("query_id", "node_id").orderBy("home_dep")
    rows = front.join(asked, "query_id").join(walks.withColumnRenamed("w", "walk"), ["query_id", "node_id"], "left")
    rows = rows.filter(F.col("arrival") - F.col("home_dep") < F.coalesce(F.col("walk"), F.col("max_time") + 1))
    rows = rows.withColumn("since", F.coalesce(F.lag("home_dep").over(own) + 1, F.col("window_start"))).filter("since <= home_dep")
    seconds = rows.withColumn("second", F.explode(F.sequence("since", "home_dep"))).withColumn("t", F.col("arrival") - F.col("second"))
    kept = seconds.filter(F.col("t") < F.coalesce(F.col("walk"), F.col("max_time") + 1))
    return kept.groupBy("query_id", "node_id").agg(F.sum("t").cast("long").alias("num"), F.count("*").alias("den"))


def summary(iso: DataFrame) -> DataFrame:
    """Nodes reached, least, mean and greatest whole minutes, and how many are reached always and sometimes."""
    minutes = F.floor(F.col("mean_travel_time") / 60)
    return iso.groupBy("query_id").agg(F.count("*").alias("reached"), F.min(minutes).alias("min_minutes"), F.expr("sum(mean_travel_time) div count(*) div 60").alias("avg_minutes"), F.max(minutes).alias("max_minutes"), F.count_if(F.col("reachable_fraction") == 65535).alias("always"), F.count_if(F.col("reachable_fraction") < 65535).alias("sometimes"))
