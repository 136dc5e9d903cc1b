"""City configs: JSON with comments, one file a city."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.texts import strip_comments


@dataclass(frozen=True)
class City:
    id: str
    name: str
    feed_ids: list[str]
    bbox: tuple[float, float, float, float]
    file: str = ""
    bbbike_name: str | None = None
    osm_url: str | None = None
    center: tuple[float, float] | None = None
    zoom: int = 11
    detail: str = ""
    tags: list[str] = field(default_factory=list)
    allow_stale: bool | None = None
    enabled: bool = True


def parse_bbox(text: str) -> tuple[float, float, float, float]:
    """'min_lon,min_lat,max_lon,max_lat'; raises unless there are exactly four numbers."""
    parts = [float(p) for p in text.split(",")]
    if len(parts) != 4:
        raise ValueError(f"a box has four numbers, not {len(parts)}: {text}")
    return tuple(parts)


def parse_city(text: str) -> City:
    raw = json.loads(strip_comments(text))
    known = {k: v for k, v in raw.items() if k in City.__dataclass_fields__}
    for feed in known.get("feed_ids", []):
        if not feed.startswith(("f-", "http://", "https://")):
            raise ValueError(f"{feed} is neither a feed id nor an address")
    return City(**known | {"bbox": parse_bbox(raw["bbox"]), "center": tuple(raw["center"]) if raw.get("center") else None, "id": raw.get("id") or raw.get("file", "")})


def read_dated(spark: SparkSession, path: str) -> list[tuple[City, float]]:
    """The enabled cities of a folder and when their configs last changed, in seconds, by name. Configs are a few small files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json*").load(path)
    rows = files.select(F.col("content").cast("string").alias("text"), F.col("modificationTime").cast("double").alias("at")).collect()
    return sorted(((c, r["at"]) for r in rows if (c := parse_city(r["text"])).enabled), key=lambda x: x[0].name)


def read_cities(spark: SparkSession, path: str) -> list[City]:
    """The enabled cities of a folder, by name."""
    return [city for city, _ in read_dated(spark, path)]


def write_city(city_id: str, name: str, bbox: tuple[float, float, float, float], feeds: list[tuple[str, str]], *, bbbike_name: str | None = None, osm_url: str | None = None) -> str:
    """A config's text: feeds with their operators as comments, and the box's centre."""
    lines = ["{", f"  {json.dumps('id')}: {json.dumps(city_id)},", f'  "name": {json.dumps(name)},', f'  "file": {json.dumps(city_id + ".bin")},']
    lines += [f"  {json.dumps(k)}: {json.dumps(v)}," for k, v in (("bbbike_name", bbbike_name), ("osm_url", osm_url)) if v]
    lines.append('  "feed_ids": [')
    lines += [f"    {json.dumps(feed)}{',' if k < len(feeds) - 1 else ''}{f' // {operators}' if operators else ''}" for k, (feed, operators) in enumerate(feeds)]
    lines += ["  ],", f'  "bbox": "{",".join(f"{v:g}" for v in bbox)}",', f'  "center": [{(bbox[1] + bbox[3]) / 2:.4f}, {(bbox[0] + bbox[2]) / 2:.4f}],', '  "zoom": 11', "}"]
    return "\n".join(lines) + "\n"
