"""A deterministic transit network derived from the star-schema tables with integer arithmetic, for queries that need one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _place(df: DataFrame, key: str) -> DataFrame:
    lat = F.lit(41.66) + F.pmod(F.col(key) * 7919, F.lit(4200)) / F.lit(10000.0)
    lon = F.lit(-87.99) + F.pmod(F.col(key) * 1237, F.lit(5600)) / F.lit(10000.0)
    return df.withColumn("lat", lat).withColumn("lon", lon)


def stops(spark, sf_dir) -> DataFrame:
    """stop_id, name, feed, lat, lon."""
    return _place(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("stop_id"), F.col("s_name").alias("name"), F.col("s_nationkey").alias("feed")), "stop_id")


def nodes(spark, sf_dir) -> DataFrame:
    """node_id, lat, lon, stop_id: stops and the customers' places; stop_id is null for the latter."""
    of_stops = stops(spark, sf_dir).select(F.col("stop_id").alias("node_id"), "lat", "lon", "stop_id")
    homes = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 1_000_000).alias("node_id"))
    return of_stops.unionByName(_place(homes, "node_id").withColumn("stop_id", F.lit(None).cast("long")))


def walk_edges(spark, sf_dir) -> DataFrame:
    """u, v, w: undirected walks in seconds, one row for each pair in either direction given."""
    supplier = table(spark, sf_dir, "supplier")
    n = supplier.agg(F.count("*").alias("n"))
    homes = table(spark, sf_dir, "customer").crossJoin(F.broadcast(n)).select((F.col("c_custkey") + 1_000_000).alias("u"), F.pmod("c_custkey", "n").alias("v"), (F.pmod(F.col("c_custkey") * 37, F.lit(300)) + 20).cast("int").alias("w"))
    ring = supplier.crossJoin(F.broadcast(n)).select(F.col("s_suppkey").alias("u"), F.pmod(F.col("s_suppkey") + 1, F.col("n")).alias("v"), (F.pmod(F.col("s_suppkey") * 53, F.lit(200)) + 60).cast("int").alias("w"))
    return homes.unionByName(ring)


def routes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("route_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("feed"))


def trips(spark, sf_dir) -> DataFrame:
    """trip_id, route_id, service_id."""
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("trip_id"), F.pmod("o_orderkey", F.lit(25)).cast("int").alias("route_id"), F.col("o_orderpriority").alias("service_id"))


def services(spark, sf_dir) -> DataFrame:
    """service_id, mask, start_date, end_date, adds, removes: a calendar for each order priority."""
    day = F.date_format("o_orderdate", "yyyyMMdd").cast("int")
    special = lambda k: F.array_sort(F.collect_set(F.when((F.col("o_orderstatus") == "P") & (F.pmod("o_orderkey", F.lit(200)) == k), day)))
    mask = F.element_at(F.create_map(*[F.lit(x) for kv in MASKS.items() for x in kv]), F.col("service_id"))
    found = table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("service_id")).agg(F.min(day).alias("start_date"), F.max(day).alias("end_date"), special(0).alias("adds"), special(1).alias("removes"))
    return found.select("service_id", mask.alias("mask"), "start_date", "end_date", "adds", "removes")


#: Weekday masks by service.
MASKS = {"1-URGENT": 127, "2-HIGH": 31, "3-MEDIUM": 96, "4-NOT SPECIFIED": 21, "5-LOW": 64}


def stop_times(spark, sf_dir, until: int | None = None) -> DataFrame:
    """trip_id, seq, stop_id, arr, dep; with ``until``, whole trips that begin later are left out before they are sorted.

    A trip's times begin at a base that its id gives and rise by its quantities; where any of these is negative none is left out.
    """
    lines, base = table(spark, sf_dir, "lineitem"), F.pmod(F.col("l_orderkey") * 97, F.lit(60000)) + 18000
    if until is not None and lines.filter(F.col("l_quantity").cast("long") < 0).limit(1).count() == 0:
        lines = lines.filter(base - 5 <= until)  # arrivals are at most five seconds before departures
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_shipdate")
    rows = lines.select("l_orderkey", "l_suppkey", "l_partkey", F.row_number().over(order).alias("seq"), F.sum(F.col("l_quantity").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("q"))
    dep = (base + 10 * F.col("q")).cast("int")
    return rows.select(F.col("l_orderkey").alias("trip_id"), "seq", F.col("l_suppkey").alias("stop_id"), (dep - 5 * (F.col("seq") % 2)).cast("int").alias("arr"), dep.alias("dep"), "l_partkey")


def raw_stop_times(spark, sf_dir) -> DataFrame:
    """Stop times with gaps: those of every fifth part are unknown, but for a trip's first and last."""
    st = stop_times(spark, sf_dir).withColumn("last", F.max("seq").over(Window.partitionBy("trip_id")))
    hidden = (F.pmod("l_partkey", F.lit(5)) == 0) & (F.col("seq") > 1) & (F.col("seq") < F.col("last"))
    return st.select("trip_id", "seq", "stop_id", F.when(~hidden, F.col("arr")).alias("arr"), F.when(~hidden, F.col("dep")).alias("dep"))


def frequencies(spark, sf_dir) -> DataFrame:
    """trip_id, start_time, end_time, headway for every fiftieth trip."""
    rows = table(spark, sf_dir, "orders").filter(F.pmod("o_orderkey", F.lit(50)) == 0)
    return rows.select(F.col("o_orderkey").alias("trip_id"), F.lit(21600).alias("start_time"), F.lit(36000).alias("end_time"), (F.pmod("o_orderkey", F.lit(7)) * 60 + 600).cast("int").alias("headway"))


#: The same tables as DuckDB common table expressions, by name; each may use those before it.
SQL = {
    "stops": "SELECT s_suppkey AS stop_id, s_name AS name, s_nationkey AS feed, 41.66 + ((s_suppkey * 7919) % 4200) / CAST(10000 AS DOUBLE) AS lat, -87.99 + ((s_suppkey * 1237) % 5600) / CAST(10000 AS DOUBLE) AS lon FROM supplier",
    "nodes": "SELECT stop_id AS node_id, lat, lon, stop_id FROM stops UNION ALL SELECT id, 41.66 + ((id * 7919) % 4200) / CAST(10000 AS DOUBLE), -87.99 + ((id * 1237) % 5600) / CAST(10000 AS DOUBLE), NULL FROM (SELECT c_custkey + 1000000 AS id FROM customer)",
    "edges": "SELECT c_custkey + 1000000 AS u, c_custkey % (SELECT count(*) FROM supplier) AS v, CAST((c_custkey * 37) % 300 + 20 AS INTEGER) AS w FROM customer UNION ALL SELECT s_suppkey, (s_suppkey + 1) % (SELECT count(*) FROM supplier), CAST((s_suppkey * 53) % 200 + 60 AS INTEGER) FROM supplier",
    "routes": "SELECT n_nationkey AS route_id, n_name AS name, n_regionkey AS feed FROM nation",
    "trips": "SELECT o_orderkey AS trip_id, CAST(o_orderkey % 25 AS INTEGER) AS route_id, o_orderpriority AS service_id FROM orders",
    "services": "SELECT o_orderpriority AS service_id, CASE o_orderpriority WHEN '1-URGENT' THEN 127 WHEN '2-HIGH' THEN 31 WHEN '3-MEDIUM' THEN 96 WHEN '4-NOT SPECIFIED' THEN 21 ELSE 64 END AS mask, min(d) AS start_date, max(d) AS end_date, coalesce(list_sort(list_distinct(list(d) FILTER (p AND o_orderkey % 200 = 0))), []) AS adds, coalesce(list_sort(list_distinct(list(d) FILTER (p AND o_orderkey % 200 = 1))), []) AS removes FROM (SELECT *, CAST(strftime(o_orderdate, '%Y%m%d') AS INTEGER) AS d, o_orderstatus = 'P' AS p FROM orders) GROUP BY 1",
    "st": "SELECT l_orderkey AS trip_id, CAST(seq AS INTEGER) AS seq, l_suppkey AS stop_id, CAST((l_orderkey * 97) % 60000 + 18000 + 10 * q - 5 * (seq % 2) AS INTEGER) AS arr, CAST((l_orderkey * 97) % 60000 + 18000 + 10 * q AS INTEGER) AS dep, l_partkey FROM (SELECT *, row_number() OVER o AS seq, sum(CAST(l_quantity AS BIGINT)) OVER (o ROWS UNBOUNDED PRECEDING) AS q FROM lineitem WINDOW o AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey, l_extendedprice, l_shipdate))",
    "raw_st": "SELECT trip_id, seq, stop_id, CASE WHEN NOT hidden THEN arr END AS arr, CASE WHEN NOT hidden THEN dep END AS dep FROM (SELECT *, l_partkey % 5 = 0 AND seq > 1 AND seq < max(seq) OVER (PARTITION BY trip_id) AS hidden FROM st)",
    "freq": "SELECT o_orderkey AS trip_id, 21600 AS start_time, 36000 AS end_time, CAST((o_orderkey % 7) * 60 + 600 AS INTEGER) AS headway FROM orders WHERE o_orderkey % 50 = 0",
}


#: Derived tables that each derived table reads.
_USES = {"nodes": ["stops"], "raw_st": ["st"]}


def with_tables(names: str, *more: str, recursive: bool = False) -> str:
    """'WITH ...' of the named derived tables (space-separated) and further definitions; a SELECT follows."""
    order: list[str] = []
    for name in names.split():
        order += [x for x in (*_USES.get(name, ()), name) if x not in order]
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join([*(f"{n} AS ({SQL[n]})" for n in order), *more]) + "\n"
