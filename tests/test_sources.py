import csv
import io
import json
import os
import struct
import zipfile
import zlib
from datetime import date

import pytest

from wayfarer.functions.texts import cache_name
from wayfarer.operators import routing, timetable
from wayfarer.plans import build, refresh
from wayfarer.plans.catalog import Catalog, file_sizes, load_report
from wayfarer.plans.engine import Engine, cancellable
from wayfarer.sources import config, gtfs, osm, remote

FEED = {
    "stops.txt": "stop_id,stop_name,stop_lat,stop_lon,location_type\nA,First,41.0,-87.0,0\nB, Second ,41.0,-86.995,\nC,,41.0,-86.99,0\nS,Station,41.0,-87.0,1\nX,Nowhere,,,0\nF,Far,45.0,-80.0,0\n",
    "routes.txt": "route_id,route_short_name,route_long_name,route_color\nr1,,Long line,ff0000\nr2,2,Second,xyz\n",
    "trips.txt": "trip_id,route_id,service_id,shape_id\nt1,r1,week,s1\nt2,r2,dates,\n",
    "stop_times.txt": "trip_id,stop_id,stop_sequence,arrival_time,departure_time\nt1,A,1,08:00:00,08:00:00\nt1,B,2,,\nt1,C,3,08:10:00,08:10:00\nt2,C,1,25:00:00,25:00:00\nt2,A,2,25:10:00,\nghost,A,1,1:00:00,1:00:00\nt1,S,4,08:20:00,08:20:00\nt1,F,5,09:00:00,09:00:00\n",
    "calendar.txt": "service_id,monday,tuesday,wednesday,thursday,friday,saturday,sunday,start_date,end_date\nweek,1,1,1,1,1,0,0,20260101,20261231\n",
    "calendar_dates.txt": "service_id,date,exception_type\nweek,20260504,2\ndates,20260503,1\n",
    "frequencies.txt": "trip_id,start_time,end_time,headway_secs\nt1,06:00:00,07:00:00,600\nt1,bad,07:00:00,600\n",
    "shapes.txt": "shape_id,shape_pt_lat,shape_pt_lon,shape_pt_sequence\ns1,41.0,-86.99,4\ns1,41.0,-87.0,1\ns1,41.0,-86.997,2\ns1,41.0,-86.993,3\ns1,x,1,9\n",
    "feed_info.txt": "feed_publisher_name,feed_end_date\nme,20261231\n",
}


@pytest.fixture(scope="module")
def feed_dir(tmp_path_factory):
    folder = tmp_path_factory.mktemp("feeds")
    with zipfile.ZipFile(folder / "f-one.gtfs.zip", "w") as z:
        for name, text in FEED.items():
            z.writestr(f"inner/{name.upper() if name == 'stops.txt' else name}", "\ufeff" + text)
    return str(folder)


def test_feed(spark, feed_dir):
    feed = gtfs.read(spark, feed_dir, (-88, 40, -86, 42))
    assert sorted((r.feed, r.stop_id, r.name) for r in feed.stops.collect()) == [("f-one", "A", "First"), ("f-one", "B", "Second"), ("f-one", "C", "")]
    assert sorted((r.route_id, r.name, r.color) for r in feed.routes.collect()) == [("r1", "Long line", "#ff0000"), ("r2", "2", None)]
    assert sorted((r.trip_id, r.stop_id, r.arr, r.dep) for r in feed.stop_times.collect()) == [("t1", "A", 28800, 28800), ("t1", "B", 29100, 29100), ("t1", "C", 29400, 29400), ("t2", "A", 90600, 90600), ("t2", "C", 90000, 90000)]
    assert sorted((r.service_id, r["mask"], r.start_date, r.adds, r.removes) for r in feed.services.collect()) == [("dates", 0, 0, [20260503], []), ("week", 31, 20260101, [], [20260504])]
    assert [tuple(r) for r in feed.frequencies.collect()] == [("f-one", "t1", 21600, 25200, 600)]
    assert feed.shapes.count() == 4
    assert [(r.start_date, r.end_date) for r in feed.info.collect()] == [(None, 20261231)]


def test_city_build_and_catalog(spark, feed_dir, tmp_path):
    feed = gtfs.read(spark, feed_dir, (-88, 40, -86, 42))
    nodes = spark.createDataFrame([(k, 41.0001, -87.001 + 0.002 * k) for k in range(8)] + [(100, 41.003, -87.0)], "node_id long, lat double, lon double")
    ways = spark.createDataFrame([(1, list(range(8)), {"highway": "footway"}), (2, [0, 100], {"highway": "path"})], "id long, refs array<long>, tags map<string,string>")
    city = build.build_city(spark, feed, nodes, ways, today=20260601, least_nodes=2)
    city.save(str(tmp_path / "city"))
    city = Catalog.load(spark, str(tmp_path / "city"))
    files = sorted((tmp_path / "city" / "nodes").glob("*.parquet"))
    laid = [r for f in files for r in spark.read.parquet(str(f)).collect()]
    assert [r.stop_id is None for r in laid] == sorted(r.stop_id is None for r in laid) and set(laid[0].asDict()) == {"node_id", "lat", "lon", "stop_id"}
    assert city.stops.count() == 3 and city.stop_times.count() == 5
    ends = {r.node_id for r in city.edges.selectExpr("explode(array(u, v)) as node_id").collect()}
    assert ends == {r.node_id for r in city.nodes.collect()}
    assert sum(r.stop_id is not None for r in city.nodes.collect()) == 3
    legs = {(r.from_stop, r.to_stop): len(r.points) for r in city.leg_shapes.collect()}
    assert legs == {(0, 1): 3, (1, 2): 3}
    assert {r.name for r in file_sizes(spark, str(tmp_path / "city")).collect()} >= {"nodes", "edges"}
    report = {r.name: r for r in load_report(spark, str(tmp_path / "city")).collect()}
    assert report["stop_times"].rows == 5 and report["stops"].rows == 3 and all(r.bytes > 0 and r.seconds >= 0 for r in report.values())
    assert 99 < sum(r.percent for r in report.values()) <= 100.5
    city.views("c_")
    assert spark.sql("select count(*) from c_stops").first()[0] == 3
    state = timetable.boardable_rows(city.stop_times)
    assert routing.events_of(state, routing.query_table(spark, [routing.Query(1, 28000, 29000)])).count() == 3
    with pytest.raises(ValueError):
        Catalog({"nodes": city.nodes}).check()
    ask_the_city(spark, city)


def ask_the_city(spark, city):
    """A Friday from beside the first stop: its trip at eight, repeated by headways from six to seven."""
    engine = Engine(city, max_walk=600)
    home, goal = engine.snap(41.0, -87.0), engine.snap(41.0, -86.99)
    assert home is not None and goal is not None and engine.snap(10.0, 10.0) is None
    rounds = []
    with cancellable(spark, "ask"):
        answer = engine.ask([routing.Query(1, 21600, 30000, 0, 1200, source=home), routing.Query(2, 21600, 21700, 0, 1200, source=home)], 20260605, lambda *x: rounds.append(x))
    assert rounds and engine.patterns(20260605) == 1
    iso = engine.isochrone(answer)
    assert iso.filter(f"node_id = {home} and mean_travel_time = 0 and reachable_fraction = 65535").count() == 2
    best = engine.journeys(answer, goal).collect()
    assert best and all(r.segments[0].start_time >= r.home_dep and r.segments[-1].end_time == r.arrival for r in best)
    assert {s.route_name for r in best for s in r.segments if s.kind == "transit"} == {"Long line"}
    rides = {f"{r.query_id}|{r.home_dep}|{r.step}": r.alight_seq - r.board_seq for r in engine.rides(answer, goal).collect()}
    lines = {r.ride_id: r.points for r in engine.lines(answer, goal).collect()}
    assert lines.keys() == rides.keys() and all(len(p) >= rides[k] + 1 >= 2 for k, p in lines.items())
    assert all(r.arrival > r.home_dep for r in engine.walking(answer, goal).collect())
    assert [(r.query_id, r.home_dep) for r in best] == sorted((r.query_id, r.home_dep) for r in best)
    drawn = engine.drawn(answer, goal).orderBy("query_id", "home_dep", "arrival", "n").collect()
    at = {r.node_id: (r.lat, r.lon) for r in city.nodes.collect()}
    for a, b in zip([None, *drawn], [*drawn, None], strict=True):
        same = a and b and (a.query_id, a.home_dep, a.arrival) == (b.query_id, b.home_dep, b.arrival)
        assert (a.to_lat, a.to_lon) == (b.from_lat, b.from_lon) if same else True
        assert same or ((not a or (a.to_lat, a.to_lon) == at[goal]) and (not b or (b.from_lat, b.from_lon) == at[home]))
    assert drawn and all(r.duration == r.end_time - r.start_time >= 0 for r in drawn)
    # several dates in one search, of which the middle one, a Sunday, has no service
    dates = (20260605, 20260607, 20260612)
    both = engine.ask([routing.Query(k, 21600, 30000, 0, 1200, source=home, date=d) for k, d in enumerate(dates)])
    front = lambda a, k: sorted((r.node_id, r.home_dep, r.arrival) for r in a.frontier.filter(f"query_id = {k}").collect())
    assert front(answer, 1) == front(both, 0) == front(both, 2) and not front(both, 1)
    with pytest.raises(ValueError):
        engine.ask([routing.Query(1, source=home)])


def test_xml(spark, tmp_path):
    (tmp_path / "a.osm").write_text('<osm><node id="1" lat="1.5" lon="2"/><node id="0" lat="1" lon="2"/><node id="2" lat="1.6" lon="2.1"/><way id="9"><nd ref="1"/><nd ref="2"/><tag k="highway" v="steps"/></way><way id="8"><nd ref="1"/></way></osm>')
    nodes, ways = osm.read_xml(spark, str(tmp_path / "a.osm"))
    assert sorted(map(tuple, nodes.collect())) == [(1, 1.5, 2.0), (2, 1.6, 2.1)]
    assert [(r.id, r.refs, r.tags) for r in ways.collect()] == [(9, [1, 2], {"highway": "steps"})]


def _v(n):
    out = b""
    while n > 127:
        out += bytes([n & 127 | 128])
        n >>= 7
    return out + bytes([n])


def _z(n):
    return _v(n * 2 if n >= 0 else -n * 2 - 1)


def _f(k, data):
    return _v(k << 3 | 2) + _v(len(data)) + data


def _blob(kind, data):
    body = _f(3, zlib.compress(data)) + _v(2 << 3) + _v(len(data))
    head = _f(1, kind.encode()) + _v(3 << 3) + _v(len(body))
    return struct.pack(">I", len(head)) + head + body


def test_pbf(spark, tmp_path):
    dense = _f(1, _z(10) + _z(5)) + _f(8, _z(415000000) + _z(1000)) + _f(9, _z(-870000000) + _z(-1000))
    way = _v(1 << 3) + _v(77) + _f(2, _v(1)) + _f(3, _v(2)) + _f(8, _z(10) + _z(5))
    block = _f(1, _f(1, b"") + _f(1, b"highway") + _f(1, b"footway")) + _f(2, _f(2, dense)) + _f(2, _f(3, way))
    box = b"".join(_v(k << 3) + _z(n * 10**9) for k, n in ((1, -88), (2, -87), (3, 42), (4, 41)))
    (tmp_path / "a.pbf").write_bytes(_blob("OSMHeader", _f(1, box)) + _blob("OSMData", block))
    nodes, ways = osm.read_pbf(spark, str(tmp_path / "a.pbf"))
    assert sorted((r.node_id, round(r.lat, 7), round(r.lon, 7)) for r in nodes.collect()) == [(10, 41.5, -87.0), (15, 41.5001, -87.0001)]
    assert [(r.id, r.refs, r.tags) for r in ways.collect()] == [(77, [10, 15], {"highway": "footway"})]
    assert osm.header_bbox(next(osm.blobs((tmp_path / "a.pbf").read_bytes()))[1]) == (-88.0, 41.0, -87.0, 42.0)
    inside, walked = osm.in_area(nodes, ways, (-88, 41, -87.00005, 42))
    assert inside.count() == 2 and walked.count() == 1


def test_pbf_by_ranges_of_blobs(spark, tmp_path):
    """Many blobs in two files: several tasks, each blob once, a range's end wherever a blob ends."""
    for k, name in enumerate(("a b.pbf", "c.pbf")):
        blocks = []
        for j in range(30):
            dense = _f(1, _z(1000 * k + 10 * j) + _z(1)) + _f(8, _z(10 * j) + _z(1)) + _f(9, _z(0) + _z(0))
            way = _v(1 << 3) + _v(1000 * k + j) + _f(8, _z(1000 * k + 10 * j) + _z(1))
            blocks.append(_blob("OSMData", _f(1, _f(1, b"")) + _f(2, _f(2, dense)) + _f(2, _f(3, way))))
        (tmp_path / name).write_bytes(_blob("OSMHeader", b"") + b"".join(blocks))
    items = osm.pbf_items(spark, str(tmp_path / "*.pbf"), 300)
    assert items.rdd.getNumPartitions() > 10
    nodes, ways = osm.read_pbf(spark, str(tmp_path / "*.pbf"), 300)
    assert sorted(r.node_id for r in nodes.collect()) == sorted(1000 * k + 10 * j + x for k in range(2) for j in range(30) for x in range(2))
    assert sorted((r.id, r.refs) for r in ways.collect()) == sorted((1000 * k + j, [1000 * k + 10 * j, 1000 * k + 10 * j + 1]) for k in range(2) for j in range(30))
    (tmp_path / "empty.pbf").write_bytes(b"")
    assert osm.pbf_items(spark, str(tmp_path / "empty.pbf")).count() == 0


def test_feed_tables_in_parts(spark, tmp_path, monkeypatch):
    """Rows of a table cut into many parts, with quotes, line ends within quotes, and no line end at the end."""
    texts = ['a "b", c', "two\nlines", "plain", 'x""', "\r\n", ""] * 30
    text = io.StringIO(newline="")
    csv.writer(text).writerows([["stop_id", "stop_name"], *([str(k), t] for k, t in enumerate(texts))])
    with zipfile.ZipFile(tmp_path / "f.gtfs.zip", "w") as z:
        z.writestr("in/Stops.TXT", "\ufeff" + text.getvalue().rstrip("\r\n"))
        z.writestr("trips.txt", "trip_id\n")
    monkeypatch.setattr(gtfs, "PART", 64)
    parts = gtfs.unzipped(spark, str(tmp_path / "f.gtfs.zip"))
    assert parts.filter("table = 'stops'").count() > 20
    rows = {int(r.cells["stop_id"]): r.cells.get("stop_name") for r in gtfs.raw_table(parts, "stops").collect()}
    assert rows == {k: t.strip() for k, t in enumerate(texts)}
    assert gtfs.raw_table(parts, "trips").count() == 0 and gtfs.raw_table(parts, "routes").count() == 0
    for size in (1, 7, 1000):
        assert "".join(gtfs.cut_at_rows(io.StringIO(text.getvalue(), newline=""), size)) == text.getvalue()


def test_config(spark, tmp_path):
    text = config.write_city("x", "X", (-88, 41, -87, 42), [("f-a", "Metro"), ("f-b", "Bus")])
    (tmp_path / "x.jsonc").write_text(text)
    (tmp_path / "off.jsonc").write_text(json.dumps({"id": "o", "name": "O", "feed_ids": [], "bbox": "1,2,3,4", "enabled": False}))
    cities = config.read_cities(spark, str(tmp_path))
    assert [(c.id, c.feed_ids, c.bbox, c.center) for c in cities] == [("x", ["f-a", "f-b"], (-88.0, 41.0, -87.0, 42.0), (41.5, -87.5))]
    with pytest.raises(ValueError):
        config.parse_bbox("1,2,3")
    with pytest.raises(ValueError):
        config.parse_city('{"name": "a", "feed_ids": ["nope"], "bbox": "1,2,3,4"}')


def test_remote(tmp_path):
    pages = {None: {"feeds": [{"onestop_id": "f-a", "feed_state": {"feed_version": {"sha1": "1", "latest_calendar_date": "2020-01-01"}}}], "meta": {"after": 1}}, 1: {"feeds": [{"onestop_id": "f-b", "feed_state": {"feed_version": {"sha1": "2", "latest_calendar_date": "2026-01-01"}}}, {"onestop_id": "f-c"}], "meta": {}}}
    fetch = lambda path, q: pages[q.get("after")]
    assert [f["id"] for f in remote.feeds_in(fetch, (1, 2, 3, 4), date(2026, 1, 15))] == ["f-b", "f-c"]
    operators = lambda path, q: {"operators": [{"name": "Metro", "feeds": [{"onestop_id": "f-a"}]}, {"name": "Bus", "feeds": [{"onestop_id": "f-a"}]}, {"name": "Met", "feeds": [{"onestop_id": "f-a"}]}]}
    assert remote.operators_in(operators, (1, 2, 3, 4)) == {"f-a": "Metro, Bus"}
    calls = []
    get = lambda feed: calls.append(feed) or b"zip"
    assert remote.cached("f-a", tmp_path, get) == remote.cached("f-a", tmp_path, get) and calls == ["f-a"]

    def broken():
        raise OSError("no")

    assert remote.first_that_works([("a", broken), ("b", lambda: b"x")]) == ("b", b"x")
    with pytest.raises(OSError):
        remote.first_that_works([("a", broken)])
    assert remote.latest_sha1(lambda p, q: {"feeds": [{"feed_versions": [{"sha1": "9"}]}]}, "f-a") == "9"
    assert remote.geocode(lambda p, q: {"places": [{"display_name": "n", "lat": "1", "lon": "2"}]}, "n", (1, 2, 3, 4)) == [{"name": "n", "lat": 1.0, "lon": 2.0}]
    assert io.BytesIO(b"").read() == b""


def a_source(folder):
    """A catalogue and a map server played by files: hashes in ``sha``, one line in ``log`` a download or request."""

    def latest(feed):
        return (folder / "sha" / feed).read_text()

    def note(what):
        with open(folder / "log", "a") as f:
            f.write(what + "\n")

    def download(feed):
        note(feed)
        return (folder / "feed.zip").read_bytes()

    def ask(url, body):
        note(url)
        if "extract" in url or "kumi" not in url:
            raise OSError("down")
        return (folder / "map.xml").read_bytes()

    return refresh.Remote(latest, download, ask)


def test_refresh(spark, feed_dir, tmp_path):
    far = tmp_path / "far"
    (far / "sha").mkdir(parents=True)
    for feed in ("f-one", "f-two"):
        (far / "sha" / feed).write_text("s1")
    (far / "feed.zip").write_bytes(open(f"{feed_dir}/f-one.gtfs.zip", "rb").read())
    # a street whose places are all crossings of two ways, so that it is no small component
    places = [(k, 41.0001, -87.001 + 0.0001 * k) for k in range(1, 121)]
    xml = "".join(f'<node id="{i}" lat="{y}" lon="{x}"/>' for i, y, x in places)
    xml += "".join(f'<way id="{k}"><nd ref="{k}"/><nd ref="{k + 1}"/><tag k="highway" v="path"/></way>' for k in range(1, 120))
    (far / "map.xml").write_text(f"<osm>{xml}</osm>")
    configs = tmp_path / "configs"
    configs.mkdir()
    (configs / "x.jsonc").write_text(config.write_city("x", "X", (-88, 40, -86, 42), [("f-one", "Metro"), ("https://a/b.zip", "")], bbbike_name="extract"))
    cache, out = tmp_path / "cache", tmp_path / "out"

    def job(day, code_at=0.0):
        return refresh.Refresh(spark, str(configs), str(cache), str(out), a_source(far), today=date(2026, 6, day), code_at=code_at)

    def reasons(job):
        return {r.city: r.reason for r in job.run(check_only=True).collect()}

    first = job(1)
    assert reasons(first) == {"x": "missing"} and not (far / "log").exists()
    first.run()
    log = (far / "log").read_text().splitlines()
    assert sorted(log[:2]) == ["f-one", "https://a/b.zip"] and len(log) == 5 and "kumi" in log[-1]  # extract and first mirror were down
    city = Catalog.load(spark, str(out / "x"))
    assert city.stops.count() == 6 and city.edges.count() > 0  # three of each feed
    assert reasons(job(2)) == {"x": None} and (far / "log").read_text().splitlines() == log
    (far / "sha" / "f-one").write_text("s2")
    assert reasons(job(2)) == {"x": None}  # compared lately
    assert reasons(job(4)) == {"x": "stale feed"}
    (far / "sha" / "f-one").unlink()
    assert reasons(job(4)) == {"x": None}  # no answer
    (far / "sha" / "f-one").write_text("s1")
    assert reasons(job(4)) == {"x": None} and (cache / "sha1" / "f-one.sha1").read_text() == f"s1 {date(2026, 6, 4).toordinal()}"
    built = (out / "x" / "_meta_version" / "_SUCCESS").stat().st_mtime
    assert reasons(job(5, built + 1)) == {"x": "code changed"}
    os.utime(configs / "x.jsonc", (built + 5, built + 5))
    assert reasons(job(5)) == {"x": "config changed"}
    # another city takes the place of the first
    (configs / "x.jsonc").unlink()
    (configs / "y.jsonc").write_text(config.write_city("y", "Y", (-88, 40, -86, 42), [("f-two", "")]))
    assert job(5).clean() == ["f-one.gtfs.zip", "out/x", "sha1/f-one.sha1", cache_name("https://a/b.zip")]
    assert not (out / "x").exists() and sorted(p.name for p in cache.iterdir() if p.is_file()) == ["box_-88.0000_40.0000_-86.0000_42.0000.osm.xml"]
    # a city that fails before another one does not keep it from being built
    (configs / "a.jsonc").write_text(config.write_city("a", "A", (-88, 40, -86, 42), [("f-two", "")], bbbike_name="extract"))
    (cache / remote.map_names(config.City("a", "A", [], (-88.0, 40.0, -86.0, 42.0), bbbike_name="extract"))[0]).write_bytes(b"no map")
    with pytest.raises(ExceptionGroup) as e:
        job(6).run()
    assert [x.__notes__ for x in e.value.exceptions] == [["while building a"]]
    assert (out / "y" / "_meta_version").exists() and not (out / "a" / "_meta_version").exists()
    (configs / "a.jsonc").unlink()
    (configs / "y.jsonc").unlink()
    assert job(5).run().count() == 0


def test_street_map_and_generate(tmp_path):
    city = config.City("a b", "A", [], (1.0, 2.0, 3.0, 4.0), bbbike_name="B")
    asked = []

    def get(url, body):
        asked.append((url, body))
        return b"map"

    path = remote.street_map(city, tmp_path, get)
    assert path.name == "a_b.osm.pbf" and asked == [(f"{remote.EXTRACTS}/B/B.osm.pbf", None)]
    assert remote.street_map(city, tmp_path, get) == path and len(asked) == 1
    own = config.City("c", "C", [], (1.0, 2.0, 3.0, 4.0), osm_url="https://m/c.xml")
    assert remote.street_map(own, tmp_path, get).name == "c.osm.xml" and asked[-1][0] == "https://m/c.xml"
    box = config.City("d", "D", [], (1.0, 2.0, 3.0, 4.5))
    assert remote.street_map(box, tmp_path, get, ("https://one",)).name == "box_1.0000_2.0000_3.0000_4.5000.osm.xml"
    assert asked[-1][0] == "https://one" and "footway" in asked[-1][1]

    def down(url, body):
        raise OSError("down")

    with pytest.raises(OSError):
        remote.street_map(config.City("e", "E", [], (0.0, 0.0, 1.0, 1.0)), tmp_path, down)
    assert not list(tmp_path.glob("*.part"))

    listing = {"feeds": [{"onestop_id": "f-a", "urls": {"static_current": "https://a"}}, {"onestop_id": "f-b"}, {"onestop_id": "f-c", "urls": {"static_current": "https://c"}}], "operators": [{"name": "Metro", "feeds": [{"onestop_id": "f-a"}]}]}
    text = refresh.generate(lambda p, q: listing, "n", "N", (1.0, 2.0, 3.0, 4.0), date(2026, 1, 1), osm_url="https://m")
    made = config.parse_city(text)
    assert made.feed_ids == ["f-a", "f-c"] and made.osm_url == "https://m" and "// Metro" in text
