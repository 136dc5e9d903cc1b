import os
import random
import threading

import pytest
from pyspark import InheritableThread

from wayfarer.functions.session import shared_dir
from wayfarer.operators import paths, routing, timetable
from wayfarer.plans.engine import cancel, cancellable, progress

GOLDEN_TRIPS = {1: [(0, 28920), (1, 29100), (2, 29400)], 2: [(0, 29220), (1, 29400)], 3: [(1, 29220), (2, 29340)]}
GOLDEN_FOOT = [(s, s, 0) for s in range(3)]
GOLDEN_EGRESS = [(0, 0, 0), (1, 1, 0), (2, 2, 0), (0, 3, 60), (1, 4, 30)]
GOLDEN_WALKS = [(1, 3, 0), (1, 0, 60)]


def search(spark, trips, foot, egress, walks, queries):
    """trips: id to [(stop, arr, dep)]; walks: (query, node, seconds), stops being their own nodes."""
    rows = [(t, k, *x) for t, stops in trips.items() for k, x in enumerate(stops)]
    st = timetable.boardable_rows(spark.createDataFrame(rows, "trip_id long, seq int, stop_id long, arr int, dep int"))
    q = routing.query_table(spark, queries)
    w = spark.createDataFrame(walks, "query_id long, node_id long, w int")
    stops = {s for s, *_ in [x for v in trips.values() for x in v]} | {a for a, _, _ in foot}
    access = spark.createDataFrame([(q_, n, x) for q_, n, x in walks if n in stops], "query_id long, stop_id long, w int")
    feet = spark.createDataFrame(foot, "a long, b long, w int")
    out = spark.createDataFrame(egress, "stop_id long, node_id long, w int")
    found = routing.search(routing.events_of(st, q), access, feet, journeys=True)
    return q, w, found, out, routing.frontier(found.state, out, w)


def golden(spark, slack=60, max_time=900):
    trips = {t: [(s, x, x) for s, x in v] for t, v in GOLDEN_TRIPS.items()}
    return search(spark, trips, GOLDEN_FOOT, GOLDEN_EGRESS, GOLDEN_WALKS, [routing.Query(1, 28800, 29400, slack, max_time)])


def test_golden_network(spark):
    q, w, *_, front = golden(spark)
    rows = sorted((r.node_id, r.home_dep, r.arrival) for r in front.collect())
    assert rows == [(1, 28860, 29100), (1, 29160, 29400), (2, 28860, 29340), (4, 28860, 29130), (4, 29160, 29430)]
    iso = {r.node_id: (r.num, r.den, r.mean_travel_time, r.reachable_fraction) for r in routing.isochrone(front, w, q).collect()}
    assert iso == {0: (36060, 601, 60, 65535), 1: (133320, 361, 369, 39364), 2: (31110, 61, 510, 6651), 3: (0, 601, 0, 65535), 4: (144150, 361, 399, 39364)}


def test_golden_variants(spark):
    assert [r.arrival for r in golden(spark, slack=121)[-1].collect() if r.node_id == 2] == [29400]
    assert not [r for r in golden(spark, max_time=479)[-1].collect() if r.node_id == 2]


def brute(trips, foot, egress, walks, query):
    """Earliest arrival at each node for every second of departure."""
    feet = {}
    for a, b, w in foot:
        feet.setdefault(a, []).append((b, w))
    reach = {n: x for _, n, x in walks}
    best = {}
    for second in range(query.window_start, query.window_end + 1):
        ready = {s: second + x for s, x in reach.items()}
        aboard_first = True
        arrive, changed = {}, True
        while changed:
            changed = False
            for stops in trips.values():
                on = None
                for k, (s, arr, dep) in enumerate(stops):
                    if on and arr < arrive.get(s, 1 << 60) and arr - second <= query.max_time + (query.window_end - query.window_start):
                        arrive[s] = arr
                        changed = True
                    if on and k < len(stops) - 1 and max(0, stops[k + 1][1] - dep) == 0:
                        on = None
                    if k == len(stops) - 1 or max(0, stops[k + 1][1] - dep) == 0:
                        continue
                    first = s in ready and ready[s] <= dep
                    again = any(arrive[a] + w + query.slack <= dep and arrive[a] + w - second <= query.max_time for a in arrive for b, w in feet.get(a, []) if b == s)
                    on = on or (first and dep <= query.window_end + query.max_time) or again
        del aboard_first
        for s, n, w in egress:
            if s in arrive and arrive[s] + w - second <= query.max_time and arrive[s] + w - second < reach.get(n, 1 << 60):
                best[n, second] = min(best.get((n, second), 1 << 60), arrive[s] + w)
    return best


@pytest.mark.parametrize("seed", range(4))
def test_frontier_equals_every_second(spark, seed):
    rng = random.Random(seed)
    n = 6
    trips = {}
    for t in range(9):
        at, stops = rng.randrange(0, 260), []
        for s in rng.sample(range(n), rng.randrange(2, 5)):
            arr = at + rng.choice([0, 20, 45, 70])
            at = arr + rng.choice([0, 0, 10])
            stops.append((s, arr, at))
        trips[t] = stops
    foot = [(s, s, 0) for s in range(n)] + [(a, b, rng.randrange(10, 60)) for a, b in [(0, 1), (1, 0), (2, 3), (3, 2)]]
    egress = [(s, s, 0) for s in range(n)] + [(2, 50, 15), (4, 51, 30)]
    walks = [(1, 0, rng.randrange(0, 40)), (1, 2, rng.randrange(20, 90))]
    query = routing.Query(1, 0, 120, rng.choice([0, 15]), 300)
    q, w, *_, front = search(spark, trips, foot, egress, walks, [query])
    want = brute(trips, foot, egress, walks, query)
    steps: dict = {}
    for r in front.collect():
        steps.setdefault(r.node_id, []).append((r.home_dep, r.arrival))
    got = {}
    for node, pairs in steps.items():
        for second in range(query.window_start, query.window_end + 1):
            later = [a for h, a in pairs if h >= second]
            if later and min(later) - second <= query.max_time and min(later) - second < dict((x, y) for _, x, y in walks).get(node, 1 << 60):
                got[node, second] = min(later)
    assert got == want
    closed = {r.node_id: (r.num, r.den) for r in routing.isochrone(front, w, q).collect() if r.node_id not in (0, 2)}
    assert closed == {r.node_id: (r.num, r.den) for r in routing.exploded_isochrone(front, w, q).collect() if r.node_id not in (0, 2)}


def test_every_frontier_row_has_a_journey(spark):
    _, w, found, out, front = golden(spark)
    trips = spark.createDataFrame([(1, 0), (2, 1), (3, 2)], "trip_id long, route_id int")
    parts = paths.segments(paths.trace(routing.frontier(found.state, out, w, rides=True), found.boards, trips)).collect()
    journeys = {}
    for r in sorted(parts, key=lambda r: (r.node_id, r.home_dep, r.n)):
        journeys.setdefault((r.node_id, r.home_dep, r.arrival), []).append(r)
    assert set(journeys) == {(r.node_id, r.home_dep, r.arrival) for r in front.collect()}
    for (_, home, arrival), segments in journeys.items():
        assert segments[0].start_time == home and segments[-1].end_time == arrival
        for a, b in zip(segments, segments[1:], strict=False):
            assert b.start_time - b.wait_time == a.end_time
    assert [(r.kind, r.route_id) for r in journeys[2, 28860, 29340]] == [("walk", None), ("transit", 0), ("transit", 2)]


def test_queries_are_validated():
    for bad in ({"window_start": 10, "window_end": 5}, {"max_time": 0}, {"max_time": 65535}, {"slack": -1}):
        with pytest.raises(ValueError):
            routing.Query(1, **bad)


def test_split_windows_cover_the_window():
    parts = routing.split_window(routing.Query(1, 0, 7199), 8)
    assert len(parts) == 8 and parts[0].window_start == 0 and parts[-1].window_end == 7199
    assert all(a.window_end + 1 == b.window_start for a, b in zip(parts, parts[1:], strict=False))
    assert len(routing.split_window(routing.Query(1, 0, 600), 8)) == 1


def test_a_running_search_is_cancelled_and_leaves_nothing(spark):
    trips = {t: [(k, 100 * k + t, 100 * k + t) for k in range(8)] for t in range(50)}
    foot, queries = [(k, k, 0) for k in range(8)], [routing.Query(1, 0, 500, 0, 2000)]
    begun, failed, seen = threading.Event(), [], []

    def run():
        with cancellable(spark, "to-cancel"):
            try:
                rows = [(t, k, *x) for t, stops in trips.items() for k, x in enumerate(stops)]
                st = timetable.boardable_rows(spark.createDataFrame(rows, "trip_id long, seq int, stop_id long, arr int, dep int"))
                access = spark.createDataFrame([(1, 0, 0)], "query_id long, stop_id long, w int")
                routing.search(routing.events_of(st, routing.query_table(spark, queries)), access, spark.createDataFrame(foot, "a long, b long, w int"), lambda *x: (seen.append(x), begun.set()))
            except Exception as e:
                failed.append(e)

    thread = InheritableThread(target=run)
    thread.start()
    assert begun.wait(120)
    while thread.is_alive():
        done, total = progress(spark, "to-cancel")
        assert 0 <= done <= total
        cancel(spark, "to-cancel")
        thread.join(0.02)
    assert failed and seen
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("search_")]
    assert not [x for x in os.listdir(shared_dir(spark)) if x.startswith("search_")]


def test_rounds_leave_the_tables_where_they_are(spark, monkeypatch):
    """The plan of a round: what is shuffled is who is ready at stops and the rows that this may raise, never the timetable or the log."""
    plans, add = [], routing._Buckets.add

    def watched(self, name, rows, keys, order, *, deal=True):
        if not deal:
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
        return add(self, name, rows, keys, order, deal=deal)

    monkeypatch.setattr(routing._Buckets, "add", watched)
    risen = []
    trips = {t: [(s, x, x) for s, x in v] for t, v in GOLDEN_TRIPS.items()}
    rows = [(t, k, *x) for t, stops in trips.items() for k, x in enumerate(stops)]
    st = timetable.boardable_rows(spark.createDataFrame(rows, "trip_id long, seq int, stop_id long, arr int, dep int"))
    access = spark.createDataFrame([(1, 0, 60)], "query_id long, stop_id long, w int")
    feet = spark.createDataFrame(GOLDEN_FOOT, "a long, b long, w int")
    routing.search(routing.events_of(st, routing.query_table(spark, [routing.Query(1, 28800, 29400, 60, 900)])), access, feet, lambda *x: risen.append(x))
    assert plans and risen and risen[-1][2] == sum(n for _, n, _ in risen)
    for plan in plans:
        assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Bucketed: true") >= 3 and "SortMergeJoin" not in plan


def test_departures_of_frequencies_come_in_order(spark):
    st = spark.createDataFrame([(1, 0, 5, 0, 0), (1, 1, 6, 60, 60), (2, 0, 6, 0, 0), (2, 1, 7, 30, 30)], "trip_id long, seq int, stop_id long, arr int, dep int")
    freq = spark.createDataFrame([(1, 0, 600, 70), (2, 0, 600, 110)], "trip_id long, start_time int, end_time int, headway int")
    got = [(r.board, r.trip_id, r.leg) for r in timetable.departures_by_time(timetable.frequency_legs(st, freq)).collect()]
    assert got == sorted(got) and len(got) == 15


def test_a_trace_handles_what_best_journeys_came_from_alone(spark, monkeypatch):
    """Trips that leave with the best ones and arrive later share their home departures; none of their boardings is kept or dealt."""
    trips = {0: [(0, 100, 100), (1, 160, 160)], 1: [(1, 200, 200), (2, 260, 260)]}
    trips |= {t: [(1, 200 + t, 200 + t), (3, 300 + t, 300 + t), (4, 400 + t, 400 + t)] for t in range(2, 40)}
    foot, egress = [(s, s, 0) for s in range(5)], [(s, s, 0) for s in range(4)]
    _, w, found, out, front = search(spark, trips, foot, egress, [(1, 0, 0)], [routing.Query(1, 0, 300, 0, 2000)])
    last, kept, cut = routing.frontier(found.state, out, w, rides=True), [], paths.cut

    def watched(rows):
        rows = cut(rows)
        kept.append(rows.count())
        return rows

    monkeypatch.setattr(paths, "cut", watched)
    rides = paths.trace(last, found.boards)
    assert sorted((r.node_id, r.step, r.trip_id) for r in rides.collect()) == [(1, 0, 0), (2, 0, 1), (2, 1, 0), (3, 0, 2), (3, 1, 0)]
    assert found.boards.count() > 30 and max(kept) <= 3  # the boardings of trips 0, 1 and 2
    parts = paths.segments(rides)
    assert parts.count() == 5 and front.count() == 3
    plan = parts._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan  # a journey's walks and rides are dealt as one


def test_boards_are_left_in_the_buckets_of_their_trips(spark):
    """What is traced joins them where they lie."""
    _, _, found, *_ = golden(spark)
    trip = ["query_id", "trip_id", "segment"]
    plan = found.boards.groupBy(*trip).count()._jdf.queryExecution().executedPlan().toString()
    assert found.boards.count() and "Exchange" not in plan


def test_what_is_beaten_at_a_stop_is_not_walked_on(spark):
    """A stop's arrivals meet the walks from it only if no later departure is there as early."""
    _, w, found, out, _ = golden(spark)
    for rides in (False, True):
        front = routing.frontier(found.state, out, w, rides=rides)
        tree = front._jdf.queryExecution().optimizedPlan().toString().splitlines()
        depth = {k: len(x) - len(x.lstrip(" :+-")) for k, x in enumerate(tree)}
        inner = [k for k, x in enumerate(tree) if "Join Inner" in x and "stop_id" in x]
        assert inner and any("Window" in tree[k] and depth[k] > depth[inner[0]] for k in range(inner[0], len(tree)))


def test_arrivals_that_others_at_their_stop_match_are_not_walked_on(spark, monkeypatch):
    """Twenty trips from stop 0 to stop 1 leave together: the first to arrive is the only one walked on, and those that a later round finds end there."""
    found, plans, append = [], [], routing._Buckets.append

    def watched(self, name, rows, keys, order):
        append(self, name, rows, keys, order)
        if name == "arrivals":
            plans.append(rows._jdf.queryExecution().executedPlan().toString())
            found.append(sorted((r.stop_id, r.arr, r.m) for r in self.spark.table(f"{self.key}_{name}").collect()))

    monkeypatch.setattr(routing._Buckets, "append", watched)
    trips = {t: [(0, 100, 100), (1, 200 + t, 200 + t)] for t in range(20)}
    trips |= {30: [(1, 240, 240), (2, 300, 300)], 31: [(2, 310, 310), (1, 400, 400), (3, 500, 500)]}
    foot = [(s, s, 0) for s in range(4)]
    *_, front = search(spark, trips, foot, foot, [(1, 0, 0)], [routing.Query(1, 0, 300, 0, 2000)])
    assert sorted((r.node_id, r.home_dep, r.arrival) for r in front.collect()) == [(1, 100, 200), (2, 100, 300), (3, 100, 500)]
    assert found[0] == [] and found[1] == [(1, 200, 100)]
    assert found[-1] == [(1, 200, 100), (2, 300, 100), (3, 500, 100)]
    for plan in plans[1:]:  # arrivals alone are dealt
        assert plan.count("Exchange hashpartitioning") == 1 and "SortMergeJoin" not in plan
