"""Scalar rules of timetables, feeds and charts as Column expressions: no UDF, so all stay in code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Route colours by encounter order.
ROUTE_PALETTE = ("#e6194b", "#3cb44b", "#4363d8", "#f58231", "#911eb4", "#42d4f4", "#f032e6", "#bfef45", "#469990", "#e6beff")
#: Highway tags that a pedestrian may use.
PEDESTRIAN_HIGHWAYS = ("footway", "pedestrian", "path", "steps", "residential", "living_street", "tertiary", "secondary", "primary", "trunk", "service", "unclassified", "crossing", "cycleway", "track", "corridor")


def _whole(text: Column) -> Column:
    """A string of digits as int, else null."""
    return F.when(text.rlike(r"^\d+$"), text.try_cast("int"))


def time_of_day(text: Column) -> Column:
    """'H:M:S' as seconds after midnight of the service day; hours may pass 24. Null unless there are exactly three whole numbers."""
    parts = F.split(F.trim(text), ":")
    h, m, s = (_whole(F.trim(F.get(parts, F.lit(k)))) for k in range(3))
    return F.when(F.size(parts) == 3, h * 3600 + m * 60 + s)


def number(text: Column) -> Column:
    """Trimmed decimal number, null if empty or not one."""
    return F.nullif(F.trim(text), F.lit("")).try_cast("double")


def date_number(text: Column) -> Column:
    """yyyymmdd as int, 0 where it is none."""
    return F.coalesce(_whole(F.trim(text)), F.lit(0))


def first_named(*texts: Column) -> Column:
    """The first text that is neither null nor empty, else ''."""
    return F.coalesce(*[F.nullif(t, F.lit("")) for t in texts], F.lit(""))


def colour_parts(text: Column) -> tuple[Column, Column, Column]:
    """Red, green and blue of 'rrggbb' with or without '#'; null if it is not six hex digits."""
    bare = F.regexp_replace(F.trim(text), "^#", "")
    ok = bare.rlike("^[0-9A-Fa-f]{6}$")
    return tuple(F.when(ok, F.conv(F.substring(bare, k, 2), 16, 10).cast("int")) for k in (1, 3, 5))


def colour_hex(r: Column, g: Column, b: Column) -> Column:
    return F.concat(F.lit("#"), *[F.lower(F.lpad(F.hex(x.cast("long")), 2, "0")) for x in (r, g, b)])


def half_up(x: Column) -> Column:
    """Nearest whole number, halves up, as int."""
    return F.floor(x + F.lit(0.5)).cast("int")


def visible_colour(text: Column) -> Column:
    """A route colour scaled into the luminance band 100 to 220; black becomes #646464; null if malformed."""
    r, g, b = colour_parts(text)
    lum = (r * 299 + g * 587 + b * 114) / F.lit(1000.0)
    scale = F.when(lum < 100, F.lit(100.0) / lum).when(lum > 220, F.lit(220.0) / lum).otherwise(F.lit(1.0))
    parts = [half_up(F.least(x * scale, F.lit(255.0))) for x in (r, g, b)]
    return F.when(lum <= 0, F.lit("#646464")).when(lum > 0, colour_hex(*parts))


def as_date(yyyymmdd: Column) -> Column:
    """A yyyymmdd number as a date; null for 0 and for no date."""
    return F.when(yyyymmdd != 0, F.try_to_timestamp(yyyymmdd.cast("string"), F.lit("yyyyMMdd")).cast("date"))


def weekday(yyyymmdd: Column) -> Column:
    """Day of the week, Monday 0."""
    return F.weekday(as_date(yyyymmdd))


def day_bit(yyyymmdd: Column) -> Column:
    """The bit of a date's weekday, Monday's lowest."""
    return F.call_function("shiftleft", F.lit(1), weekday(yyyymmdd))


def epoch_days(yyyymmdd: Column) -> Column:
    return F.unix_date(as_date(yyyymmdd))


def weekday_mask(flags: list[Column]) -> Column:
    """Monday-first flags as bits."""
    total = F.lit(0)
    for k, flag in enumerate(flags):
        total = total + F.when(flag, F.lit(1 << k)).otherwise(F.lit(0))
    return total


def mask_of_dates(dates: Column) -> Column:
    """Weekday bits of an array of yyyymmdd numbers."""
    return F.aggregate(dates, F.lit(0), lambda acc, d: acc.bitwiseOR(F.coalesce(day_bit(d), F.lit(0))))


def walk_seconds(metres: Column) -> Column:
    """Seconds to walk at 1.4 m/s in single precision, at least 1, at most 65535."""
    seconds = (metres.cast("float") / F.lit(1.4).cast("float")).cast("float")  # Spark divides as doubles; the cast gives the single's quotient
    return F.greatest(F.lit(1), F.least(F.lit(65535), half_up(seconds.cast("double"))))


def clock(seconds: Column) -> Column:
    """HH:MM."""
    return F.format_string("%02d:%02d", F.floor(seconds / 3600), F.floor(seconds % 3600 / 60))


def snapped(value: Column, step: int, least: int, most: int) -> Column:
    """A slider's value: the nearest step (halves go up) within its ends."""
    return F.least(F.lit(most), F.greatest(F.lit(least), (half_up(value / F.lit(float(step))) * step).cast("int")))


#: Steps and ends of a question's values, in seconds: its window's ends, its time budget, the time to change.
SLIDERS = {"window": (300, 0, 27 * 3600), "max_time": (300, 600, 180 * 60), "slack": (15, 0, 300)}


def minutes_seconds(seconds: Column) -> Column:
    """M:SS."""
    return F.format_string("%d:%02d", F.floor(seconds / 60), (seconds % 60).cast("long"))


def next_monday(day: Column) -> Column:
    return F.next_day(day, "MON")


def date_to_number(day: Column) -> Column:
    return F.date_format(day, "yyyyMMdd").cast("int")


def human_size(n: Column, largest: str = "G") -> Column:
    """Bytes as B, K, M or G with one decimal, in no larger unit than ``largest``; a tie goes to the even digit, as printf has it."""
    out = F.when(n < 1024, F.concat(n.cast("string"), F.lit("B")))
    units = "KMG"[: "KMG".index(largest) + 1]
    for k, name in enumerate(units, 1):
        text = F.concat(F.format_string("%.1f", F.bround(n / F.lit(float(1024**k)), 1)), F.lit(name))
        out = out.otherwise(text) if name == largest else out.when(n < 1024 ** (k + 1), text)
    return out


def load_size(n: Column) -> Column:
    """Bytes as B, KB or MB as load reports have them."""
    return F.when(n >= 1 << 20, F.format_string("%.2f MB", n / F.lit(1048576.0))).when(n >= 1024, F.format_string("%.1f KB", n / F.lit(1024.0))).otherwise(F.concat(n.cast("string"), F.lit(" B")))


def file_name(text: Column) -> Column:
    """Letters, digits, '-' and '_' kept, anything else '_'."""
    return F.regexp_replace(text, r"[^\p{IsAlphabetic}\p{N}_-]", "_")


def form_encoded(text: Column) -> Column:
    """URL form encoding, space as '+'."""
    return F.url_encode(text)


def feed_kind(feed: Column) -> Column:
    """'transitland' for ids with f-, 'url' for http(s) addresses, else 'invalid'."""
    return F.when(feed.startswith("f-"), "transitland").when(feed.startswith("http://") | feed.startswith("https://"), "url").otherwise("invalid")


def bbox_numbers(text: Column) -> Column:
    """'a,b,c,d' as four doubles, null unless exactly four numbers."""
    parts = F.transform(F.split(text, ","), lambda p: number(p))
    return F.when((F.size(parts) == 4) & ~F.exists(parts, lambda p: p.isNull()), parts)


def in_bbox(lat: Column, lon: Column, bbox: tuple[float, float, float, float]) -> Column:
    """Inclusive on all sides; bbox is (min_lon, min_lat, max_lon, max_lat)."""
    return lat.between(bbox[1], bbox[3]) & lon.between(bbox[0], bbox[2])


def tick_step(value: Column, steps: list[int], most: Column, otherwise: Column) -> Column:
    """The first step of which ``value`` holds at most ``most``."""
    found = F.filter(F.array(*[F.lit(s) for s in steps]), lambda s: value / s <= most)
    return F.coalesce(F.get(found, F.lit(0)), otherwise)


def y_tick(seconds: Column) -> Column:
    """Seconds between the marks of a chart's travel-time axis: at most seven marks."""
    minutes = seconds / F.lit(60.0)
    return (tick_step(minutes, [5, 10, 15, 20, 30, 60], F.lit(7), F.ceil(minutes / 7).cast("int")) * 60).cast("int")


def x_tick(minutes: Column, width: Column) -> Column:
    """Minutes between the marks of a chart's time axis, by its width in pixels."""
    spacing = F.when(minutes > 120, 40).otherwise(28)
    most = F.greatest(F.lit(2), F.floor(width / spacing))
    return tick_step(minutes, [1, 2, 5, 10, 15, 30, 60, 120, 180, 240, 360, 480, 720], most, F.lit(720))


def _ramp(t: Column, stops: list[tuple[Column, Column, Column]]) -> list[Column]:
    """The colour of the quarter of [0, 1] that ``t`` is in."""
    return [F.when(t < 0.25, a).when(t < 0.5, b).when(t < 0.75, c).otherwise(d) for a, b, c, d in zip(*stops, strict=True)]


def _quarters(t: Column) -> list[Column]:
    return [(t - F.lit(0.25 * k)) / F.lit(0.25) for k in range(4)]


def warm_colour(t: Column) -> list[Column]:
    """Green, yellow, orange, red, dark red over the share ``t`` of the time budget."""
    a, b, c, d = _quarters(t)
    zero, full = F.lit(0), F.lit(255)
    return _ramp(t, [(half_up(a * 255), full, zero), (full, half_up((F.lit(1) - b * 0.47) * 255), zero), (half_up(F.lit(255) - c * 119), half_up(F.lit(136) - c * 136), zero), (half_up(F.lit(136) - d * 68), zero, zero)])


def cool_colour(t: Column) -> list[Column]:
    """Cyan, blue, purple, dark purple over ``t``."""
    a, b, c, d = _quarters(t)
    fade = lambda s, first, change: half_up(F.lit(first) + s * change)
    return _ramp(t, [(half_up(a * 60), fade(a, 200, -80), F.lit(255)), (fade(b, 60, 40), fade(b, 120, -80), fade(b, 255, -35)), (fade(c, 100, -20), fade(c, 40, -40), fade(c, 220, -60)), (fade(d, 80, -40), F.lit(0), fade(d, 160, -80))])


def isochrone_colour(seconds: Column, budget: Column, fraction: Column) -> list[Column]:
    """Warm where a place is always reached, cool where hardly ever, blended between."""
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), seconds / budget))
    f = F.greatest(F.lit(0.0), F.least(F.lit(1.0), fraction))
    return [half_up(w * f + c * (F.lit(1.0) - f)) for w, c in zip(warm_colour(t), cool_colour(t), strict=True)]


def palette_colour(place: Column) -> Column:
    """The palette's colour of the n-th route met, from 0."""
    return F.get(F.array(*[F.lit(c) for c in ROUTE_PALETTE]), F.pmod(place, F.lit(len(ROUTE_PALETTE))))
