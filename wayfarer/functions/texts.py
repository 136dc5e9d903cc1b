"""Plain text rules that run on the driver: config comments, cache names, URL state."""

from __future__ import annotations

import math
from urllib.parse import parse_qs, urlencode

_MASK = (1 << 64) - 1


def strip_comments(text: str) -> str:
    """JSON with // and /* */ comments as JSON; what looks like one in a string stays."""
    out, i, quoted = [], 0, False
    while i < len(text):
        c, two = text[i], text[i : i + 2]
        if quoted:
            out.append(text[i : i + 2] if c == "\\" else c)
            i += 2 if c == "\\" else 1
            quoted = c != '"'
        elif two == "//":
            i = (text.find("\n", i) + 1 or len(text) + 1) - 1
        elif two == "/*":
            end = text.find("*/", i + 2)
            i = len(text) if end < 0 else end + 2
        else:
            quoted = c == '"'
            out.append(c)
            i += 1
    return "".join(out)


def url_hash(url: str) -> int:
    """64-bit hash of a URL's bytes: multiplied by the FNV prime, then xor with the byte."""
    h = 0xCBF29CE484222325
    for b in url.encode():
        h = (h * 0x100000001B3 & _MASK) ^ b
    return h


def cache_name(feed: str) -> str:
    """File name of a feed's zip in the cache."""
    return f"{feed}.gtfs.zip" if feed.startswith("f-") else f"url_{url_hash(feed):016x}.gtfs.zip"


_WHOLE = ("trip", "time", "dur", "maxtime", "slack", "zoom")
_ORDER = ("src", "dst", "trip", "style", "date", "time", "dur", "maxtime", "slack", "zoom", "center")


def read_state(fragment: str) -> dict:
    """The view state in a URL's fragment; keys that do not parse are left out."""
    found = {k: v[0] for k, v in parse_qs(fragment.removeprefix("#")).items()}
    out = {}
    for key in _ORDER:
        raw = found.get(key)
        if not raw:
            continue
        if key in ("src", "dst", "center"):
            try:
                point = tuple(float(x) for x in raw.split(",")[:2])
            except ValueError:
                continue
            if len(point) == 2 and all(map(math.isfinite, point)):
                out[key] = point
        elif key in _WHOLE:
            digits = raw.strip()
            sign = digits[:1] in "+-" and digits[:1]
            body = digits[1:] if sign else digits
            n = next((i for i, c in enumerate(body) if not c.isdigit()), len(body))
            if n:
                out[key] = int((sign or "") + body[:n])
        else:
            out[key] = raw
    return out


def write_state(state: dict) -> str:
    """The fragment of a view state: points with five decimals, keys in a fixed order."""
    items = []
    for key in _ORDER:
        value = state.get(key)
        if value is None or value == "":
            continue
        items.append((key, f"{value[0]:.5f},{value[1]:.5f}" if key in ("src", "dst", "center") else str(value)))
    return "#" + urlencode(items)
