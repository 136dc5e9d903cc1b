"""Catalogues and downloads: paged queries and cached files over a ``fetch`` the caller gives, so nothing here opens a connection itself."""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Callable
from datetime import date, timedelta
from pathlib import Path
from urllib.parse import urlencode

from wayfarer.functions.scalars import PEDESTRIAN_HIGHWAYS
from wayfarer.functions.texts import cache_name
from wayfarer.sources.config import City

Fetch = Callable[[str, dict], dict]
Download = Callable[[str], bytes]
#: Content of an address; with a body it is posted.
Request = Callable[[str, str | None], bytes]

#: Public servers of map extracts.
EXTRACTS = "https://download.bbbike.org/osm/bbbike"
MIRRORS = ("https://overpass-api.de/api/interpreter", "https://overpass.kumi.systems/api/interpreter")

#: Days for which a feed that has ended is still listed.
GRACE_DAYS = 30


def paged(fetch: Fetch, path: str, key: str, query: dict) -> list[dict]:
    """All items of a paged listing: pages name the next one by the last item's id."""
    out, after = [], None
    while True:
        page = fetch(path, query | ({"after": after} if after else {}))
        out += page.get(key, [])
        after = (page.get("meta") or {}).get("after")
        if not after or not page.get(key):
            return out


def feeds_in(fetch: Fetch, bbox, today: date) -> list[dict]:
    """id, sha1, url of feeds in the box whose latest version ended no more than GRACE_DAYS ago, or does not say."""
    found = []
    for feed in paged(fetch, "/feeds", "feeds", {"bbox": ",".join(map(str, bbox)), "spec": "gtfs"}):
        version = (feed.get("feed_state") or {}).get("feed_version") or {}
        last = version.get("latest_calendar_date")
        if last is None or date.fromisoformat(last) >= today - timedelta(days=GRACE_DAYS):
            found.append({"id": feed["onestop_id"], "sha1": version.get("sha1"), "url": (feed.get("urls") or {}).get("static_current")})
    return found


def operators_in(fetch: Fetch, bbox) -> dict[str, str]:
    """Operators of each feed in the box; a name that is part of the list already is not repeated."""
    names: dict[str, str] = {}
    for operator in paged(fetch, "/operators", "operators", {"bbox": ",".join(map(str, bbox))}):
        for feed in operator.get("feeds") or []:
            known = names.get(feed["onestop_id"], "")
            if operator["name"] not in known:
                names[feed["onestop_id"]] = f"{known}, {operator['name']}" if known else operator["name"]
    return names


def latest_sha1(fetch: Fetch, feed: str) -> str | None:
    versions = fetch(f"/feeds/{feed}", {}).get("feeds", [{}])[0].get("feed_versions") or []
    return versions[0].get("sha1") if versions else None


def written(target: Path, content: bytes) -> Path:
    """``target`` with the content; written beside under a name of its own and moved, so that no half file is ever read and tasks may repeat."""
    target.parent.mkdir(parents=True, exist_ok=True)
    part = target.with_name(f"{target.name}.{uuid.uuid4().hex}.part")
    part.write_bytes(content)
    os.replace(part, target)
    return target


def cached(feed: str, folder: str | Path, download: Download, *, again: bool = False) -> Path:
    """The feed's file in the cache, downloaded if it is not there."""
    target = Path(folder) / cache_name(feed)
    return written(target, download(feed)) if again or not target.exists() else target


def first_that_works(sources: list[tuple[str, Callable[[], bytes]]]) -> tuple[str, bytes]:
    """(name, content) of the first source that does not fail; raises with every failure if all do."""
    failures = []
    for name, get in sources:
        try:
            return name, get()
        except OSError as e:
            failures.append(f"{name}: {e}")
    raise OSError("; ".join(failures) or "no source")


def map_names(city: City) -> tuple[str, str, str]:
    """Names a city's map may have in the cache: a PBF and an XML extract of its own, and an XML extract of its box."""
    own = re.sub(r"[^\w-]", "_", city.id)
    return f"{own}.osm.pbf", f"{own}.osm.xml", f"box_{'_'.join(f'{v:.4f}' for v in city.bbox)}.osm.xml"


def map_query(bbox) -> str:
    """What a mirror is asked for: the box's ways that people walk on, and their nodes."""
    west, south, east, north = bbox
    return f'[out:xml][timeout:300];(way["highway"~"^({"|".join(PEDESTRIAN_HIGHWAYS)})$"]({south},{west},{north},{east}););(._;>;);out body;'


def street_map(city: City, folder: str | Path, request: Request, mirrors: tuple[str, ...] = MIRRORS) -> Path:
    """The city's map in the cache. A config's own address is the only source if there is one; else any cached map, then the
    named extract, then the mirrors in turn. Raises OSError if no source works."""
    pbf, xml, box = (Path(folder) / n for n in map_names(city))
    if city.osm_url:
        target = pbf if ".pbf" in city.osm_url else xml
        return target if target.exists() else written(target, request(city.osm_url, None))
    for target in (pbf, box):
        if target.exists():
            return target
    sources = []
    if city.bbbike_name:
        sources.append(("extract", lambda: request(f"{EXTRACTS}/{city.bbbike_name}/{city.bbbike_name}.osm.pbf", None)))
    body = urlencode({"data": map_query(city.bbox)})
    sources += [(m, lambda m=m: request(m, body)) for m in mirrors]
    name, content = first_that_works(sources)
    return written(pbf if name == "extract" else box, content)


def geocode(fetch: Fetch, text: str, bbox) -> list[dict]:
    """At most five places of a name in the box."""
    west, south, east, north = bbox
    found = fetch("/search", {"q": text, "viewbox": f"{west},{north},{east},{south}", "bounded": 1, "limit": 5, "format": "json"})
    return [{"name": p["display_name"], "lat": float(p["lat"]), "lon": float(p["lon"])} for p in found.get("places", [])[:5]]
