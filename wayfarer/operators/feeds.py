"""Feeds and city files: merging, staleness, and what to download or build again."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def merge(tables: dict[str, DataFrame]) -> DataFrame:
    """One table of several feeds': ids stay as they are beside a ``feed_id``, which is part of every key."""
    return reduce(DataFrame.unionByName, [df.withColumn("feed_id", F.lit(feed)) for feed, df in tables.items()])


def orphans(present: DataFrame, expected: DataFrame, key: str = "name") -> DataFrame:
    """Files that no city or feed expects."""
    return present.join(expected.select(key), key, "left_anti")


def needed_feeds(cities: DataFrame, cached: DataFrame) -> DataFrame:
    """feed_id: feeds of any city that the cache lacks."""
    return cities.select(F.explode("feed_ids").alias("feed_id")).distinct().join(cached.select("feed_id"), "feed_id", "left_anti")


def cities_of_feeds(cities: DataFrame) -> DataFrame:
    """feed_id, cities: sorted names."""
    return cities.select("city", F.explode("feed_ids").alias("feed_id")).groupBy("feed_id").agg(F.array_sort(F.collect_set("city")).alias("cities"))


def operator_names(operators: DataFrame) -> DataFrame:
    """feed_id, operators: the names of a feed's operators in order, joined; a name within another is not repeated."""
    names = operators.groupBy("feed_id").agg(F.array_sort(F.collect_set("name")).alias("names"))
    joined = F.aggregate("names", F.lit(""), lambda acc, n: F.when(F.instr(acc, n) > 0, acc).when(acc == "", n).otherwise(F.concat_ws(", ", acc, n)))
    return names.select("feed_id", joined.alias("operators"))


def staleness(local: DataFrame, remote: DataFrame, today: int, recheck_days: int = 2) -> DataFrame:
    """feed_id, state: 'fresh' if checked lately or equal, 'missing' without a local copy, 'stale' if hashes differ. Days are numbers."""
    rows = remote.join(local, "feed_id", "left")
    state = F.when(F.col("local_sha").isNull(), "missing").when(F.lit(today) - F.col("checked_day") < recheck_days, "fresh").when(F.col("local_sha") != F.col("remote_sha"), "stale").otherwise("fresh")
    return rows.select("feed_id", state.alias("state"))


def rebuild_reasons(cities: DataFrame) -> DataFrame:
    """city, reason: the first of missing file, stale feed, newer code and newer config that holds, else null."""
    built = F.col("built_at")
    reason = F.when(built.isNull(), "missing").when(F.col("stale_feeds") > 0, "stale feed").when(F.col("code_at") > built, "code changed").when(F.col("config_at") > built, "config changed")
    return cities.select("city", reason.alias("reason"))


def search(cities: DataFrame, tags: list[str], text: str) -> DataFrame:
    """Cities with all tags whose name and detail hold the text, in any case."""
    wanted = F.array(*[F.lit(t) for t in tags]) if tags else F.expr("cast(array() as array<string>)")
    hay = F.lower(F.concat_ws(" ", "name", "detail"))
    return cities.filter((F.size(F.array_except(wanted, F.col("tags"))) == 0) & hay.contains(text.strip().lower()))


def size_report(files: DataFrame) -> DataFrame:
    """name, bytes, percent of all, largest first by name order of the reader's choosing."""
    total = files.agg(F.sum("bytes").alias("total"))
    return files.crossJoin(F.broadcast(total)).select("name", "bytes", F.round(F.col("bytes") * 100.0 / F.col("total"), 2).alias("percent"))
