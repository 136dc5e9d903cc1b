import collections
import datetime
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from wayfarer.functions import scalars as X
from wayfarer.functions import texts
from wayfarer.operators import calendar, exports, feeds, graph, series, shapes, spatial, timetable
from wayfarer.plans import network, queries


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def one(spark, column, *values):
    df = frame(spark, [(v,) for v in values], "v string")
    return [r[0] for r in df.select(column(F.col("v"))).collect()]


def test_scalars(spark):
    assert one(spark, X.time_of_day, "25:10:00", " 7:05:09 ", "7:05", "x:1:2", "1:2:3:4", None, "") == [90600, 25509, None, None, None, None, None]
    assert one(spark, X.number, " 1.5 ", "", "abc", None) == [1.5, None, None, None]
    assert one(spark, X.visible_colour, "#000000", "ff0000", "ffffff", "12345", None, "GG0000") == ["#646464", "#ff0000", "#dcdcdc", None, None, None]
    assert one(spark, lambda c: X.bbox_numbers(c), "1,2,3,4", "1,2,3", "1,2,x,4") == [[1, 2, 3, 4], None, None]
    assert one(spark, X.feed_kind, "f-abc", "https://a", "abc") == ["transitland", "url", "invalid"]
    assert one(spark, lambda c: X.walk_seconds(c.cast("double")), "0", "1.4", "140", "1e9") == [1, 1, 100, 65535]
    assert one(spark, lambda c: X.weekday(c.cast("int")), "20260503", "20260504", "0") == [6, 0, None]
    assert one(spark, lambda c: X.clock(c.cast("int")), "97200", "60") == ["27:00", "00:01"]


def test_texts():
    assert texts.strip_comments('{"a": "x // y", /* b */ "c": 1 // end\n}') == '{"a": "x // y",  "c": 1 \n}'
    assert texts.strip_comments('["\\"//", 1]') == '["\\"//", 1]'
    assert texts.cache_name("f-abc") == "f-abc.gtfs.zip" and texts.cache_name("http://x").startswith("url_")
    assert texts.url_hash("") == 0xCBF29CE484222325
    state = {"src": (41.5, -87.123456), "style": "dark", "time": 540, "zoom": 11}
    back = texts.read_state(texts.write_state(state))
    assert back["src"] == (41.5, -87.12346) and back["time"] == 540 and back["style"] == "dark"
    assert texts.read_state("#src=a,b&time=x&zoom=7q") == {"zoom": 7}


def test_interpolation(spark):
    rows = [(1, 1, 10, None, 100), (1, 2, 11, None, None), (1, 3, 12, None, None), (1, 4, 13, 190, None), (1, 5, 14, None, None), (2, 1, 10, None, None), (2, 2, 11, 50, 60), (3, 1, 1, 100, 100), (3, 2, 2, None, None), (3, 3, 3, 90, 90)]
    got = timetable.interpolate(frame(spark, rows, "trip_id long, seq int, stop_id long, arr int, dep int")).collect()
    assert sorted((r.trip_id, r.seq, r.arr, r.dep) for r in got) == [(1, 1, 100, 100), (1, 2, 130, 130), (1, 3, 160, 160), (1, 4, 190, 190), (2, 2, 50, 60), (3, 1, 100, 100), (3, 3, 90, 90)]


def test_zero_legs_end_a_ride(spark):
    rows = [(1, 0, 1, 0, 0), (1, 1, 2, 10, 10), (1, 2, 3, 10, 12), (1, 3, 4, 30, 30)]
    got = sorted(timetable.boardable_rows(frame(spark, rows, "trip_id long, seq int, stop_id long, arr int, dep int")).collect(), key=lambda r: r.seq)
    assert [(r.segment, r.boardable) for r in got] == [(0, True), (0, False), (1, True), (1, False)]


def test_calendar(spark):
    schema = "service_id string, mask int, start_date int, end_date int, adds array<int>, removes array<int>"
    rows = [("week", 31, 20260101, 20261231, [], [20260504]), ("dates", 0, 0, 0, [20260504], []), ("open", 64, 0, 0, [], []), ("added", 1, 20270101, 20271231, [20260503], [])]
    df = frame(spark, rows, schema)
    active = lambda d, **k: sorted(r.service_id for r in calendar.active_services(df, d, **k).collect())
    assert active(20260504) == ["dates"]
    assert active(20260505) == ["week"]
    assert active(20260503) == ["added", "open"]
    assert active(20260511) == ["dates", "week"]  # a service of dates runs on their weekdays
    assert active(20260511, strict_dates=True) == ["week"]
    only = frame(spark, [("a", 0, 0, 0, [], [20260101]), ("b", 0, 0, 0, [], [20260102])], schema)
    assert {r["mask"] for r in calendar.with_masks(only).collect()} == {127}


def test_stale_policy(spark):
    schema = "service_id string, mask int, start_date int, end_date int, adds array<int>, removes array<int>"
    df = frame(spark, [("a", 1, 20260101, 20260131, [], []), ("b", 1, 20260203, 20260228, [], []), ("c", 1, 20260601, 0, [], [])], schema)
    got = {r.service_id: (r.start_date, r.end_date) for r in calendar.apply_stale_policy(df, 20260301, 20250101, 20260228).collect()}
    assert got == {"a": (20260101, 20260131), "b": (20260203, 0), "c": (20260601, 0)}
    assert {(r.start_date, r.end_date) for r in calendar.apply_stale_policy(df, 20260301, None, None, True).collect()} == {(0, 0)}
    assert calendar.apply_stale_policy(df, 20260301, None, None, False) is df
    assert [tuple(r) for r in calendar.expired(df, 20270101).collect()] == [(20260228, True)]


def edges(spark, pairs, weight="dist"):
    return frame(spark, [(a, b, float(w)) for a, b, w in pairs], f"u long, v long, {weight} double")


def test_graph(spark):
    rng = random.Random(1)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(30)]
    parent = list(range(40))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        parent[y] = x
    want = {n: min(m for m in range(40) if find(m) == find(n)) for p in pairs if p[0] != p[1] for n in p}
    got = {r.node_id: r.component for r in graph.components(frame(spark, pairs, "u long, v long")).collect()}
    assert got == want
    path = frame(spark, [(k, k + 1) for k in range(70)], "u long, v long")
    assert {r.component for r in graph.components(path).collect()} == {0}
    assert not graph.components(path.limit(0)).count()


def test_pruning_and_chains(spark):
    # 1 - 2 - 3 - 4 with stops 1 and 4, a dead end 3 - 9 - 10, and two ways 4 - 5 - 6, 4 - 7 - 6 to stop 6
    e = edges(spark, [(1, 2, 1), (2, 3, 2), (3, 4, 3), (3, 9, 5), (9, 10, 5), (4, 5, 1), (5, 6, 1), (4, 7, 4), (7, 6, 4)])
    stops = frame(spark, [(1,), (4,), (6,)], "node_id long")
    pruned = graph.prune_leaves(e, stops)
    assert pruned.count() == 7
    assert sorted((r.u, r.v, r.dist) for r in graph.collapse_chains(pruned, stops).collect()) == [(1, 4, 6.0), (4, 6, 2.0)]
    ring = edges(spark, [(1, 2, 1), (2, 3, 1), (1, 3, 1)])
    assert graph.collapse_chains(ring, stops.limit(0)).count() == 3


def test_walks(spark):
    e = frame(spark, [(1, 2, 10), (2, 3, 10), (1, 3, 30), (3, 4, 100)], "u long, v long, w int")
    sources = frame(spark, [(1,), (99,)], "source long")
    want = [(1, 1, 0), (1, 2, 10), (1, 3, 20), (99, 99, 0)]
    assert sorted(map(tuple, graph.walk_times(e, sources, 60).collect())) == want
    assert sorted(map(tuple, graph.relaxed_walks(e, sources, 60).collect())) == want
    tree = {(r.source, r.node_id): r.parent for r in graph.walk_tree(graph.walk_times(e, sources, 60), e).collect()}
    assert tree == {(1, 1): None, (1, 2): 1, (1, 3): 2, (99, 99): None}


def test_snapping(spark):
    nodes = frame(spark, [(1, 41.0, -87.0), (2, 41.0, -86.99)], "node_id long, lat double, lon double")
    street = edges(spark, [(1, 2, 840.0)])
    stops = frame(spark, [(7, 41.001, -86.995), (8, 41.0, -87.0), (9, 41.01, -86.995), (10, 41.0005, -86.9975)], "stop_id long, lat double, lon double")
    snapped = spatial.snap(stops, street, nodes)
    got = {r.stop_id: round(r.t, 3) for r in snapped.collect()}
    assert got == {7: 0.5, 8: 0.0, 10: 0.25}
    parts, at = spatial.split_edges(street, snapped)
    assert sorted(round(r.dist) for r in parts.collect()) == [210, 210, 420]
    assert {r.stop_id: r.node_id for r in at.collect()} == {7: spatial.VIRTUAL_IDS + 7, 8: 1, 10: spatial.VIRTUAL_IDS + 10}
    assert not spatial.nearest_nodes(frame(spark, [(1, 0.0, 0.0)], "point_id long, lat double, lon double"), nodes).count()


@pytest.mark.parametrize("seed", range(5))
def test_shape_match_is_the_least(seed):
    from itertools import combinations

    rng = np.random.default_rng(seed)
    line, stops = rng.random((7, 2)), rng.random((3, 2))
    segment, place, far, total = shapes.match(stops, line, 0.8)
    assert (np.diff(segment) > 0).all() and math.isclose(far.sum(), total)

    def cost(k, j):
        a, d = line[j], line[j + 1] - line[j]
        s = np.array([1, 0.8])
        t = np.clip(((stops[k] - a) * s * d * s).sum() / (d * s * d * s).sum(), 0, 1)
        return (((a + t * d - stops[k]) * s) ** 2).sum()

    assert math.isclose(total, min(sum(cost(k, j) for k, j in enumerate(c)) for c in combinations(range(6), 3)))
    assert shapes.match(stops, line[:3], 0.8) is None and shapes.match(stops[:0], line, 0.8) is None
    assert shapes.match_either_way(line[::-2], line, 0.8)[3] or True


def test_charts(spark):
    front = frame(spark, [(1, 5, 100, 160), (1, 5, 300, 350)], "query_id long, node_id long, home_dep int, arrival int")
    teeth = series.tips(front.withColumn("window_start", F.lit(0)))
    assert sorted((r.tip_x, r.tip_y, r.left) for r in teeth.collect()) == [(100, 60, 0), (300, 50, 100)]
    spans = series.reachable_spans(teeth, 90)
    assert sorted((r.gap_start, r.gap_end) for r in series.gaps(spans, ["query_id", "node_id"], F.lit(0), F.lit(400)).collect()) == [(0, 70), (100, 260), (300, 400)]
    moments = frame(spark, [(1, 5, t) for t in (50, 70, 100, 200, 280, 350)], "query_id long, node_id long, t int")
    assert {r.t: r.tip_x for r in series.pick(teeth, moments, 90).collect()} == {50: None, 70: 100, 100: 100, 200: None, 280: 300, 350: None}
    assert [r.home_dep for r in series.median(front).collect()] == [300]
    chunks = frame(spark, [(1, 10, 50), (1, 20, 50), (1, 30, 60)], "node_id long, home_dep int, arrival int")
    assert sorted(r.home_dep for r in series.join_chunks(chunks).collect()) == [20, 30]


def test_feeds(spark):
    ops = frame(spark, [("f", "Metro"), ("f", "Metro North"), ("f", "Bus")], "feed_id string, name string")
    assert [r.operators for r in feeds.operator_names(ops).collect()] == ["Bus, Metro, Metro North"]
    cities = frame(spark, [("A town", "by the sea", ["x", "y"]), ("B", "inland", ["x"])], "name string, detail string, tags array<string>")
    assert [r.name for r in feeds.search(cities, ["x"], " SEA ").collect()] == ["A town"]
    assert feeds.search(cities, [], "").count() == 2


def test_offsets_are_prefix_sums_over_partitions(spark):
    rows = [(k, k % 5) for k in range(300, 0, -1)]
    got = timetable.offsets(spark.createDataFrame(rows, "key long, n long"), "key", "n", "first").collect()
    assert {r.key: r["first"] for r in got} == {k: sum(x % 5 for x in range(1, k)) for k in range(1, 301)}
    assert not timetable.offsets(spark.createDataFrame([], "key long, n long"), "key", "n", "first").count()


def test_hover_and_untraced(spark):
    keys = "query_id long, node_id long"
    front = spark.createDataFrame([(1, 7, 100, 400), (1, 7, 200, 300)], f"{keys}, home_dep int, arrival int")
    iso = spark.createDataFrame([(1, 7, 150), (1, 8, 60)], f"{keys}, mean_travel_time int")
    assert {r.node_id: r.travel_times for r in series.hover(iso, front).collect()} == {7: [100, 300], 8: []}
    wanted, traced = spark.createDataFrame([(1, k) for k in range(9)], keys), spark.createDataFrame([(1, 0), (1, 2)], keys)
    assert [r.node_id for r in exports.untraced(wanted, traced, ["query_id", "node_id"]).collect()] == [1, 3, 4, 5, 6]


def test_days_of_services_over_several_words(spark):
    """A bitmap over more dates than a word has bits, against each date by itself."""
    services = spark.createDataFrame([(1, 31, 20260101, 20261231, [20260104], [20260105]), (2, 0, 0, 0, [20260301], []), (3, 96, 20260201, 0, [], [])], "service_id int, mask int, start_date int, end_date int, adds array<int>, removes array<int>")
    first = datetime.date(2026, 1, 1)
    dates = [int((first + datetime.timedelta(days=k)).strftime("%Y%m%d")) for k in range(130)]
    for strict in (False, True):
        days = calendar.service_days(services, dates, strict_dates=strict)
        got = {k: {r.service_id for r in days.filter(calendar.runs_on("days", F.lit(k))).collect()} for k in (0, 3, 4, 59, 60, 61, 119, 120, 129)}
        assert got == {k: {r.service_id for r in calendar.active_services(services, dates[k], strict_dates=strict).collect()} for k in got}


def plain_prune(edges, stops):
    while True:
        degree = collections.Counter(x for e in edges for x in e)
        kept = [(u, v) for u, v in edges if not any(degree[x] == 1 and x not in stops for x in (u, v))]
        if len(kept) == len(edges):
            return sorted(kept)
        edges = kept


def pruned(spark, edges, stops):
    e, s = frame(spark, edges, "u long, v long"), frame(spark, [(x,) for x in stops], "node_id long")
    return sorted((r.u, r.v) for r in graph.prune_leaves(e, s).collect())


@pytest.mark.parametrize("seed", range(3))
def test_leaves_of_trees_rings_and_chains(spark, monkeypatch, seed):
    """Trees hung on rings and on each other, with stops in them, loops and parallel edges, chains contracted after every layer."""
    monkeypatch.setattr(graph, "RAKES", 1)
    r = random.Random(seed)
    edges = [(k, (k + 1) % 6) for k in range(6)] + [(100 + k, 100 + (k + 1) % 3) for k in range(3)] + [(5, 200), (200, 201), (201, 100), (300, 300), (301, 302), (301, 302), (302, 303)]
    nodes = [x for e in edges for x in e]
    for k in range(1000, 1120):
        edges.append((r.choice([nodes[-1], r.choice(nodes)]), k))
        nodes.append(k)
    stops = r.sample(nodes, 6)
    assert pruned(spark, edges, stops) == plain_prune(edges, set(stops))


def test_a_long_dead_end_takes_few_rounds(spark, monkeypatch):
    rounds, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: rounds.append(1) or cut(df))
    ring = [(0, 1), (1, 2), (2, 0)]
    edges = ring + [(k, k + 1) for k in range(2, 10_002)] + [(2, 20_000), (20_000, 20_001)]
    assert pruned(spark, edges, [20_001]) == sorted([*ring, (2, 20_000), (20_000, 20_001)])
    assert len(rounds) < 60


@pytest.mark.parametrize("limit", [3, 5000])
def test_full_cells_and_long_edges(spark, monkeypatch, limit):
    """Many nodes in one cell, and edges over hundreds of cells, against all pairs."""
    monkeypatch.setattr(spatial, "CELL_ROWS", limit)
    r = random.Random(4)
    nodes = [(k, 41.0 + r.random() * (0.004 if k < 60 else 0.3), -87.0 + r.random() * (0.004 if k < 60 else 0.3)) for k in range(90)]
    points = [(k, 41.0 + r.random() * 0.3, -87.0 + r.random() * 0.3) for k in range(40)] + [(100 + k, 41.002, -86.998) for k in range(3)]
    near = {x.point_id: x for x in spatial.nearest_nodes(frame(spark, points, "point_id long, lat double, lon double"), frame(spark, nodes, "node_id long, lat double, lon double")).collect()}
    metres = lambda a, b, c, d: 6371000.0 * math.hypot(math.radians(d - b) * math.cos(math.radians(a)), math.radians(c - a))
    for i, lat, lon in points:
        dist, node = min((metres(lat, lon, y, x), n) for n, y, x in nodes)
        assert near[i].node_id == node if dist < 400 else i not in near or near[i].dist >= dist - 1e-6
    edges = [(r.randrange(90), r.randrange(90)) for _ in range(60)]
    edges = sorted({(min(e), max(e)) for e in edges if e[0] != e[1]})
    stops = [(k, 41.0 + r.random() * 0.3, -87.0 + r.random() * 0.3) for k in range(60)]
    found = {x.stop_id: (x.u, x.v) for x in spatial.snap(frame(spark, stops, "stop_id long, lat double, lon double"), frame(spark, edges, "u long, v long"), frame(spark, nodes, "node_id long, lat double, lon double")).collect()}
    place = {n: (y, x) for n, y, x in nodes}
    mid = math.cos(math.radians((min(s[1] for s in stops) + max(s[1] for s in stops)) / 2))

    def off(lat, lon, e):
        (uy, ux), (vy, vx) = place[e[0]], place[e[1]]
        dy, dx, py, px = vy - uy, (vx - ux) * mid, lat - uy, (lon - ux) * mid
        t = max(0.0, min(1.0, (px * dx + py * dy) / (dx * dx + dy * dy)))
        y, x = uy + t * (vy - uy), ux + t * (vx - ux)
        h = math.sin(math.radians(y - lat) / 2) ** 2 + math.cos(math.radians(lat)) * math.cos(math.radians(y)) * math.sin(math.radians(x - lon) / 2) ** 2
        return 2 * 6371000.0 * math.asin(math.sqrt(h))

    want = {i: min((off(lat, lon, e), e) for e in edges) for i, lat, lon in stops}
    assert found == {i: e for i, (d, e) in want.items() if d <= 400} and found
    whole = frame(spark, [(0, 1, 41.0, -87.0, 42.0, -86.0)], "u long, v long, ulat double, ulon double, vlat double, vlon double")
    assert spatial._along_cells(whole).count() < 1000


def test_places_are_met_once(spark, monkeypatch):
    """Copies of points, nodes, stops and edges at one place are met as one, whichever table is longer."""
    listed = []
    in_cells = spatial._in_cells
    monkeypatch.setattr(spatial, "_in_cells", lambda a, b, key: listed.append((a.count(), b.count())) or in_cells(a, b, key))
    nodes = frame(spark, [(k, 41.0 + k % 2 * 0.001, -87.0) for k in range(50, 90)], "node_id long, lat double, lon double")
    points = frame(spark, [(k, 41.0004 + k % 3 * 0.0001, -87.0) for k in range(200)] + [(999, 42.0, -87.0)], "point_id long, lat double, lon double")
    found = {r.point_id: (r.node_id, round(r.dist, 2)) for r in spatial.nearest_nodes(points, nodes).collect()}
    # 41.0005 is as far from both places, up to the last bits of a double
    assert {k: v for k, v in found.items() if k % 3 != 1} == {k: ((50, 44.48) if k % 3 == 0 else (51, 44.48)) for k in range(200) if k % 3 != 1}
    assert len(found) == 200 and listed.pop() == (4, 18)
    few = points.filter("point_id < 6")
    assert {r.point_id: (r.node_id, round(r.dist, 2)) for r in spatial.nearest_nodes(few, nodes).collect()} == {k: found[k] for k in range(6)}
    assert listed.pop() == (27, 2)
    ends = frame(spark, [(k, 41.0, -87.0 - k % 2 * 0.5) for k in range(20)], "node_id long, lat double, lon double")
    streets = edges(spark, [(k, k + 1, 0.0) for k in range(0, 20, 2)])
    stops = frame(spark, [(k, 41.001, -87.2) for k in range(30)], "stop_id long, lat double, lon double")
    assert {(r.stop_id, r.u, r.v) for r in spatial.snap(stops, streets, ends).collect()} == {(k, 0, 1) for k in range(30)}
    # ten edges of some ninety cells each: one line, of which the cells that are asked are listed
    assert listed.pop() == (9, 3)


def test_sizes_without_larger_units(spark):
    sizes = frame(spark, [("b", 3 << 30), ("A", 1280), ("c", 1024 + 768)], "name string, bytes long")
    assert [tuple(r) for r in exports.size_table(sizes, "M").collect()] == [("A", "1.2K"), ("b", "3072.0M"), ("c", "1.8K")]
    assert [tuple(r) for r in exports.size_table(sizes).collect()] == [("A", "1.2K"), ("b", "3.0G"), ("c", "1.8K")]


def test_legs_of_rides_together_equal_each_ride_alone(spark, monkeypatch):
    """Rides of many shapes in one batch, some against their line, some without a match, against the match of each one."""
    r = np.random.default_rng(8)
    rides = []
    for k in range(120):
        n, m = int(r.integers(0, 6)), int(r.integers(0, 14))
        line = np.cumsum(r.uniform(0.0, 0.01, (m, 2)), axis=0) + 41.0
        stops = line[np.sort(r.choice(m, n, replace=False))][:: -1 if k % 3 == 0 else 1] + r.normal(0, 1e-4, (n, 2)) if n <= m else r.uniform(41, 42, (n, 2))
        rides.append((k % 7, [(k * 10 + i, *map(float, p)) for i, p in enumerate(stops)], [tuple(map(float, p)) for p in line]))
    rides += [(1, None, [(41.0, 41.0), (41.1, 41.1)]), (2, [(1, 41.0, 41.0)], None)]
    want = {}
    for route, stops, line in rides:
        found = shapes.match_either_way(np.array([s[1:] for s in stops]), np.array(line), 0.8) if stops and line else None
        if found:
            segment, place, far, turned = found
            vertices = line[:: -1 if turned else 1]
            for k in range(len(stops) - 1):
                points = [tuple(place[k]), *vertices[segment[k] + 1 : segment[k + 1] + 1], tuple(place[k + 1])]
                want[route, stops[k][0], stops[k + 1][0]] = (max(far[k], far[k + 1]), points)
    monkeypatch.setattr(shapes, "CELLS", 100)
    trips = frame(spark, rides, "route_id int, stops array<struct<stop_id:long,lat:double,lon:double>>, line array<struct<lat:double,lon:double>>")
    got = {(x.route_id, x.from_stop, x.to_stop): (x.quality, [tuple(p) for p in x.points]) for x in shapes.leg_shapes(trips, 0.8).collect()}
    assert got == want and len(want) > 60
    pairs = [(np.array([q[1:] for q in stops]), np.array(line)) for _, stops, line in rides if stops and line and 1 < len(stops) < len(line)]
    most = collections.Counter((len(a), len(b)) for a, b in pairs).most_common(1)[0][0]
    same = [x for x in pairs if (len(x[0]), len(x[1])) == most]
    together = shapes.match_all(np.stack([a for a, _ in same]), np.stack([b for _, b in same]), 0.8)
    for k, (a, b) in enumerate(same):
        assert all(np.array_equal(x[k], y) for x, y in zip(together, shapes.match(a, b, 0.8), strict=True))


def test_trips_lines_equal_those_of_rides_and_leg_shapes(spark, monkeypatch):
    """Trips that share legs at unlike qualities, some without a match, some of one stop, in one pass against the two steps."""
    r = np.random.default_rng(9)
    stops = {i: (float(41 + i / 100), float(-87 + (i * i % 7) / 100)) for i in range(12)}
    trips = []
    for k in range(150):
        at = [int(i) for i in np.sort(r.choice(12, int(r.integers(1, 6)), replace=False))]
        line = [p for i in at for p in ((stops[i][0] + float(r.normal(0, 1e-3)), stops[i][1]), (stops[i][0] + 0.004, stops[i][1]))]
        trips.append((k, k % 4, [(i, *stops[i]) for i in at], line[: 2 if k % 10 == 0 else None] if k % 13 else None))
    trips.append((900, 50, [(1, *stops[1]), (2, *stops[2]), (3, *stops[3])], [stops[1], stops[2]]))
    monkeypatch.setattr(shapes, "CELLS", 200)
    point = "struct<lat:double,lon:double>"
    given = frame(spark, trips, f"trip_id long, route_id int, stops array<struct<stop_id:long,lat:double,lon:double>>, line array<{point}>").repartition(5)
    rides = given.select(F.col("trip_id").alias("ride_id"), "route_id", F.col("stops.stop_id").alias("stops")).filter(F.size("stops") > 1)
    places = frame(spark, [(i, *p) for i, p in stops.items()], "stop_id long, lat double, lon double")
    want = {x.ride_id: x.points for x in shapes.ride_shapes(rides, shapes.leg_shapes(given, 0.8), places).collect()}
    got = shapes.trip_shapes(given, 0.8).collect()
    assert {x.ride_id: x.points for x in got} == want and len(got) == len(want) > 80
    assert [tuple(p) for p in want[900]] == [stops[1], stops[2], stops[3]]


def test_lines_are_rounded_once_and_trips_are_read_once(spark):
    """Rounding within the filter of repeated points was quadratic in a line, and both steps of segment_shapes read the trips."""
    rows = frame(spark, [(1, [(0.12345678, 1.0), (0.12345681, 1.0), (2.0, 3.0), (0.12345678, 1.0)]), (2, []), (3, None)], "ride_id long, points array<struct<lat:double,lon:double>>")
    found = queries._rounded(rows)
    assert {x.ride_id: x.points for x in found.collect()} == {1: [0.123457, 1.0, 2.0, 3.0, 0.123457, 1.0], 2: [], 3: None}
    plan = queries.QUERIES["segment_shapes"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("round(") == 2 and plan.count("Relation [l_orderkey") == 1


def test_picks_meet_each_row_once(spark):
    """Moments before, at, between and after tips against a search of each; no window runs to the end of its rows from every one of them."""
    r = random.Random(6)
    tips = {n: sorted(r.sample(range(0, 400, 5), 12)) for n in range(4)}
    rows = [(1, n, t, r.randrange(10, 60)) for n, at in tips.items() for t in at]
    moments = [(1, n, t) for n in range(5) for t in range(0, 420, 15)]
    teeth = frame(spark, rows, "query_id long, node_id long, tip_x int, tip_y int")
    found = series.pick(teeth, frame(spark, moments, "query_id long, node_id long, t int"), 50)
    want = {}
    for _, n, t in moments:
        x, y = min(((x, y) for _, m, x, y in rows if m == n and x >= t), default=(None, None))
        want[n, t] = x if x is not None and y <= 50 and t >= x - (50 - y) else None
    assert {(x.node_id, x.t): x.tip_x for x in found.collect()} == want and any(want.values())
    assert "unboundedfollowing" not in found._jdf.queryExecution().toString().lower()


def test_components_without_their_leaves(spark):
    """Leaves, also the least node of a component, pairs, rings, stars and repeated edges; the rounds see no edge of a leaf."""
    edges = [(1, 9), (9, 8), (8, 7), (7, 9), (7, 20), (31, 30), (40, 41), (40, 42), (39, 40), (50, 51), (51, 52), (52, 50), (60, 61), (61, 62), (62, 63), (62, 63), (63, 62), (70, 70), (80, 81), (81, 82)]
    rng = np.random.default_rng(6)
    edges += [(int(a) + 100, int(b) + 100) for a, b in rng.integers(0, 300, (200, 2))]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    seen, stars = [], graph.star_components
    graph.star_components = lambda core: seen.append(core.collect()) or stars(core)
    try:
        got = graph.components(spark.createDataFrame(edges, "u long, v long")).collect()
    finally:
        graph.star_components = stars
    assert sorted((r.node_id, r.component) for r in got) == sorted(root.items())
    assert {9, 8, 7, 50, 51, 52} <= {x for r in seen[0] for x in (r.u, r.v)} and not {1, 20, 30, 31, 39, 41, 42, 60, 63} & {x for r in seen[0] for x in (r.u, r.v)}
    assert not graph.components(spark.createDataFrame([], "u long, v long")).count()


def test_trips_after_the_windows_are_not_sorted(spark, sf_dir, tmp_path):
    """Trips that begin after a search's windows are left out before the windows over trips, unless a quantity is negative."""
    rows, some = network.stop_times(spark, sf_dir), network.stop_times(spark, sf_dir, 35100)
    usable = rows.filter("arr <= 35100")
    assert usable.exceptAll(some).count() == 0 and some.exceptAll(rows).count() == 0
    assert some.count() < rows.count()
    lines = network.table(spark, sf_dir, "lineitem").withColumn("l_quantity", F.when(F.col("l_linenumber") == 2, -F.col("l_quantity") * 100).otherwise(F.col("l_quantity")))
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    rows, some = (network.stop_times(spark, str(tmp_path), until) for until in (None, 35100))
    assert rows.filter("arr <= 35100").exceptAll(some).count() == 0
    freq = network.frequencies(spark, sf_dir)
    times = network.stop_times(spark, sf_dir).drop("l_partkey")
    whole, part = timetable.as_trips(times, freq), timetable.as_trips(times, freq, (28800, 35100))
    boarded = whole.filter("boardable and dep between 28800 and 35100").select("trip_id")
    assert part.exceptAll(whole.join(boarded, "trip_id", "left_semi").select(part.columns)).count() == 0
    assert part.count() == whole.join(boarded, "trip_id", "left_semi").count() < whole.count()
