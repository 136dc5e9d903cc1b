"""Charts over journeys: sawtooth series, unreachable gaps, picks, medians, texts and colours."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wayfarer.functions.scalars import clock, half_up


def tips(front: DataFrame) -> DataFrame:
    """query_id, node_id, tip_x, tip_y, left: each journey's last departure and its time, and where its tooth begins."""
    own = Window.partitionBy("query_id", "node_id").orderBy("tip_x")
    rows = front.select("query_id", "node_id", F.col("home_dep").alias("tip_x"), (F.col("arrival") - F.col("home_dep")).alias("tip_y"), "window_start")
    return rows.withColumn("left", F.coalesce(F.lag("tip_x").over(own), F.col("window_start"))).drop("window_start")


def gaps(intervals: DataFrame, keys: list[str], first: Column, last: Column) -> DataFrame:
    """keys, gap_start, gap_end: stretches between ``first`` and ``last`` that no interval (start, end) covers, of keys that have an interval."""
    own = Window.partitionBy(*keys).orderBy("start", "end")
    cursor = F.greatest(first, F.coalesce(F.max("end").over(own.rowsBetween(Window.unboundedPreceding, -1)), first))
    inner = intervals.select(*keys, cursor.alias("gap_start"), F.least("start", last).alias("gap_end"))
    tail = intervals.groupBy(*keys).agg(F.greatest(first, F.max("end")).alias("gap_start")).withColumn("gap_end", last)
    return inner.unionByName(tail.select(*keys, "gap_start", "gap_end")).filter("gap_end > gap_start")


def reachable_spans(teeth: DataFrame, most: int) -> DataFrame:
    """Departures from which a tip is within ``most`` seconds."""
    return teeth.filter(F.col("tip_y") <= most).select("query_id", "node_id", (F.col("tip_x") - (most - F.col("tip_y"))).alias("start"), F.col("tip_x").alias("end"))


def pick(teeth: DataFrame, moments: DataFrame, most: int) -> DataFrame:
    """query_id, node_id, t, tip_x: the journey of the tooth a moment falls in, null in a grey zone: a forward as-of join.

    Moments and tips are one series, latest first; the next tip at or after a moment is the last one met, so each row is
    seen once.
    """
    tip = F.struct("tip_x", "tip_y")
    both = teeth.select("query_id", "node_id", F.col("tip_x").alias("at"), F.lit(1).alias("kind"), tip.alias("tip")).unionByName(moments.select("query_id", "node_id", F.col("t").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("struct<tip_x:int,tip_y:int>").alias("tip")))
    so_far = Window.partitionBy("query_id", "node_id").orderBy(F.desc("at"), F.desc("kind")).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("next", F.last("tip", ignorenulls=True).over(so_far)).filter("kind = 0")
    ok = (F.col("next.tip_y") <= most) & (F.col("at") >= F.col("next.tip_x") - (F.lit(most) - F.col("next.tip_y")))
    return found.select("query_id", "node_id", F.col("at").alias("t"), F.when(ok, F.col("next.tip_x")).alias("tip_x"))


def median(front: DataFrame) -> DataFrame:
    """The middle journey of each node in the order of departure (the later of two)."""
    own = Window.partitionBy("query_id", "node_id")
    place = F.row_number().over(own.orderBy("home_dep", "arrival")) - 1
    return front.withColumn("place", place).withColumn("n", F.count("*").over(own)).filter("place = n div 2").drop("place", "n")


def hover(iso: DataFrame, front: DataFrame) -> DataFrame:
    """Adds ``travel_times`` to an isochrone: the times of a node's journeys, least first; none where it is reached by walking alone.

    A node has at most one journey for each second of the window.
    """
    times = front.groupBy("query_id", "node_id").agg(F.array_sort(F.collect_list((F.col("arrival") - F.col("home_dep")).cast("int"))).alias("travel_times"))
    return iso.join(times, ["query_id", "node_id"], "left").withColumn("travel_times", F.coalesce("travel_times", F.expr("cast(array() as array<int>)")))


def join_chunks(chunks: DataFrame) -> DataFrame:
    """Journeys of neighbouring windows as one list: of two in a row with one arrival the later departure stays."""
    own = Window.partitionBy("node_id").orderBy("home_dep", "arrival")
    return chunks.withColumn("next", F.lead("arrival").over(own)).filter(F.col("next").isNull() | (F.col("next") != F.col("arrival"))).drop("next")


def segment_text(kind: Column, seconds: Column, route: Column, a: Column, b: Column, wait: Column) -> Column:
    """Lines of a segment: walks by length; rides with the wait before them. Lengths have half a minute added and one decimal."""
    minutes = F.format_string("%.1f min", (seconds + 30) / F.lit(60.0))
    line = F.when(kind == "walk", F.concat(F.lit("Walk "), minutes)).otherwise(F.concat(route, F.lit(" · "), a, F.lit(" → "), b, F.lit(" "), minutes))
    waits = F.concat(F.lit("Wait "), F.format_string("%.1f min", (wait + 30) / F.lit(60.0)), F.lit("\n"))
    return F.concat(F.when((kind != "walk") & (wait > 0), waits).otherwise(F.lit("")), line)


def total_text(seconds: Column) -> Column:
    return F.concat(F.lit("Total: "), F.floor((seconds + 30) / 60).cast("string"), F.lit(" min"))


def title(mean: Column, fraction: Column) -> Column:
    """Heading of a place: mean minutes and how often it is reached, or that it is not."""
    share = F.round(fraction * 100).cast("int")
    minutes = F.concat(F.lit("Avg "), F.floor((mean + 30) / 60).cast("string"), F.lit(" min"))
    return F.when(mean.isNull(), "Unreachable").when(share < 100, F.concat(minutes, F.lit(" ("), share.cast("string"), F.lit("% reachable)"))).otherwise(minutes)


def trip_title(total: Column, departure: Column) -> Column:
    """Heading of a chosen journey: its whole minutes (halves up) and its departure, or that there is none."""
    minutes = half_up(total / F.lit(60.0)).cast("string")
    return F.when(total.isNull(), "Unreachable").otherwise(F.concat(F.lit("Travel time: "), minutes, F.lit(" min  (depart "), clock(departure), F.lit(")")))
