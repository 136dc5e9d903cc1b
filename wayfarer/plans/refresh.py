"""Keeping cities up to date: read configs, ask which feeds changed, decide, download, build again, remove what no city needs.

Decisions are the table operations of ``operators.feeds``. Questions and downloads run in Spark tasks, each by itself and
safe to repeat. ``cache`` and ``out`` are folders that the driver and the executors share.
"""

from __future__ import annotations

import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from datetime import date
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.session import cut
from wayfarer.functions.texts import cache_name
from wayfarer.operators import feeds
from wayfarer.plans.build import build_city
from wayfarer.sources import config, gtfs, osm, remote

#: Feeds that one task asks for or downloads at most.
PER_TASK = 4


@dataclass(frozen=True)
class Remote:
    """Where feeds and maps come from; the functions are sent to executors and raise OSError where they fail."""

    latest_sha1: Callable[[str], str | None]
    download: Callable[[str], bytes]
    request: remote.Request


def _listed(feed: str) -> bool:
    """Whether a catalogue tells the feed's hash; plain addresses have none."""
    return feed.startswith("f-")


class Refresh:
    """One run over the configs of a folder. ``code_at`` is when the code last changed, in seconds."""

    def __init__(self, spark: SparkSession, configs: str, cache: str, out: str, source: Remote, *, today: date, code_at: float = 0.0):
        self.spark, self.cache, self.out, self.source = spark, Path(cache), Path(out), source
        self.day, self.code_at = today.toordinal(), code_at
        self.today = today.year * 10_000 + today.month * 100 + today.day
        self.dated = config.read_dated(spark, configs)
        for folder in (self.cache, self.out):
            folder.mkdir(parents=True, exist_ok=True)

    def _frame(self, rows: list, schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def _in_tasks(self, names: list[str], each: Callable[[str], str | None]) -> list[tuple[str, str | None]]:
        """(feed, answer) of each feed, asked in tasks."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                yield pd.DataFrame({"feed_id": frame["feed_id"], "sha": [each(f) for f in frame["feed_id"]]})

        if not names:
            return []
        asked = self._frame([(f,) for f in names], "feed_id string").repartition(-(-len(names) // PER_TASK))
        return [tuple(r) for r in asked.mapInPandas(run, "feed_id string, sha string").collect()]

    @property
    def cities(self) -> DataFrame:
        """city, feed_ids, built_at, code_at, config_at of the enabled cities; ``built_at`` is null where there are no tables."""
        rows = []
        for city, at in self.dated:
            built = self.out / city.id / "_meta_version" / "_SUCCESS"  # written last
            rows.append((city.id, list(city.feed_ids), built.stat().st_mtime if built.exists() else None, self.code_at, at))
        return self._frame(rows, "city string, feed_ids array<string>, built_at double, code_at double, config_at double")

    def known(self) -> DataFrame:
        """feed_id, local_sha, checked_day: hashes of what the cache holds, and when they were last compared."""
        rows = []
        for p in sorted((self.cache / "sha1").glob("*.sha1")):
            sha, day = p.read_text().split()
            rows.append((p.name.removesuffix(".sha1"), sha, int(day)))
        return self._frame(rows, "feed_id string, local_sha string, checked_day int")

    def _note(self, feed: str, sha: str) -> None:
        remote.written(self.cache / "sha1" / f"{feed}.sha1", f"{sha} {self.day}".encode())

    def check(self) -> DataFrame:
        """feed_id, state ('fresh', 'stale', 'missing') of every feed of a city.

        Listed feeds compared less than two days ago are not asked for. A question that fails or has no answer leaves the
        feed fresh. Plain addresses are fresh once the cache has them.
        """
        named = self.cities.select(F.explode("feed_ids").alias("feed_id")).distinct()
        local = self.known()
        due = named.join(local, "feed_id").filter(F.lit(self.day) - F.col("checked_day") >= 2)
        before = {r.feed_id: r.local_sha for r in due.collect()}
        latest = self.source.latest_sha1

        def ask(feed: str) -> str | None:
            try:
                return latest(feed)
            except OSError:
                return None

        answers = self._in_tasks(sorted(before), ask)
        for feed, sha in answers:
            if sha == before[feed]:
                self._note(feed, sha)
        told = named.filter(F.col("feed_id").startswith("f-")).join(self._frame(answers, "feed_id string, remote_sha string"), "feed_id", "left")
        held = self._frame([(r.feed_id,) for r in named.collect() if not _listed(r.feed_id) and (self.cache / cache_name(r.feed_id)).exists()], "feed_id string")
        plain = named.filter(~F.col("feed_id").startswith("f-")).join(held.withColumn("state", F.lit("fresh")), "feed_id", "left")
        return cut(feeds.staleness(local, told, self.day).unionByName(plain.select("feed_id", F.coalesce("state", F.lit("missing")).alias("state"))))

    def decide(self, states: DataFrame) -> DataFrame:
        """city, reason: why each city is to be built again, null where it is not."""
        stale = self.cities.select("city", F.explode("feed_ids").alias("feed_id")).join(states.filter("state <> 'fresh'"), "feed_id")
        counted = self.cities.join(stale.groupBy("city").agg(F.count("*").alias("stale_feeds")), "city", "left").fillna(0, ["stale_feeds"])
        return cut(feeds.rebuild_reasons(counted))

    def download(self, states: DataFrame, reasons: DataFrame) -> list[str]:
        """Feeds of cities to be built that are not fresh or not in the cache, downloaded in tasks; their names."""
        needed = self.cities.join(reasons.filter("reason is not null"), "city", "left_semi").select(F.explode("feed_ids").alias("feed_id")).distinct()
        wanted = sorted(r.feed_id for r in needed.join(states, "feed_id").collect() if r.state != "fresh" or not (self.cache / cache_name(r.feed_id)).exists())
        source, cache = self.source, self.cache

        def get(feed: str) -> str | None:
            sha = source.latest_sha1(feed) if _listed(feed) else None
            remote.cached(feed, cache, source.download, again=True)
            return sha

        for feed, sha in self._in_tasks(wanted, get):
            if sha:
                self._note(feed, sha)
        return wanted

    def prep(self, city: config.City) -> None:
        """Builds one city's tables from the cache; its map is fetched if the cache lacks it."""
        path = remote.street_map(city, self.cache, self.source.request)
        if path.name.endswith(".pbf"):
            nodes, ways = osm.in_area(*osm.read_pbf(self.spark, str(path)), city.bbox)
        else:
            nodes, ways = osm.read_xml(self.spark, str(path))
        feed = gtfs.read(self.spark, [str(self.cache / cache_name(f)) for f in city.feed_ids], city.bbox)
        build_city(self.spark, feed, nodes, ways, today=self.today, allow_stale=city.allow_stale).save(str(self.out / city.id))

    def clean(self) -> list[str]:
        """Removes cached files and built cities that no config expects; their names."""
        names = {cache_name(f) for c, _ in self.dated for f in c.feed_ids}
        names |= {f"sha1/{f}.sha1" for c, _ in self.dated for f in c.feed_ids} | {n for c, _ in self.dated for n in remote.map_names(c)}
        names |= {f"out/{c.id}" for c, _ in self.dated}
        here = [p.name for pattern in ("*.gtfs.zip", "*.osm.pbf", "*.osm.xml") for p in self.cache.glob(pattern)]
        here += [f"sha1/{p.name}" for p in (self.cache / "sha1").glob("*.sha1")] + [f"out/{p.parent.name}" for p in self.out.glob("*/_meta_version")]
        gone = feeds.orphans(self._frame([(n,) for n in here], "name string"), self._frame([(n,) for n in names], "name string"))
        found = sorted(r.name for r in gone.collect())
        for name in found:
            if name.startswith("out/"):
                shutil.rmtree(self.out / name.removeprefix("out/"))
            else:
                (self.cache / name).unlink(missing_ok=True)
        return found

    def run(self, *, check_only: bool = False) -> DataFrame:
        """city, reason of every city; unless ``check_only`` those with a reason are built again and what is no longer needed is removed.

        A city that fails leaves its tables as they were and does not keep the others from being built; at the end all failures are raised together.
        """
        states = self.check()
        reasons = self.decide(states)
        failed: list[Exception] = []
        if not check_only and (again := {r.city for r in reasons.filter("reason is not null").collect()}):
            self.download(states, reasons)
            for city, _ in self.dated:
                if city.id in again:
                    try:
                        self.prep(city)
                    except Exception as e:
                        e.add_note(f"while building {city.id}")
                        failed.append(e)
            self.clean()
        if failed:
            raise ExceptionGroup("cities were not built", failed)
        return reasons


def generate(fetch: remote.Fetch, city_id: str, name: str, bbox: tuple[float, float, float, float], today: date, **more: str) -> str:
    """A new config's text: the box's feeds that can be downloaded, with their operators' names where those can be asked for."""
    try:
        operators = remote.operators_in(fetch, bbox)
    except OSError:
        operators = {}
    found = [f["id"] for f in remote.feeds_in(fetch, bbox, today) if f["url"]]
    return config.write_city(city_id, name, bbox, [(f, operators.get(f, "")) for f in found], **more)
