"""Operators on small fixtures, against plain Python."""

import datetime as dt
import math
import random
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from wayloom import plugins
from wayloom.plans import api
from wayloom.functions import geo
from wayloom.operators import cards, hiking, planners as P, routing as G, search as S, sequences as Q, spatial as X, stores
from wayloom.sources import osm_pbf, osm_tables, rasters
from wayloom.streaming import tracks


def hav(a, b, c, d, r=geo.R_MEAN):
    p, q = math.radians(a), math.radians(c)
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(d - b) / 2) ** 2
    return 2 * r * math.asin(math.sqrt(h))


def test_radius_join_loses_no_pair_far_north(spark):
    rng = random.Random(1)
    a = [(i, rng.uniform(69, 71), rng.uniform(20, 24)) for i in range(120)]
    b = [(i, rng.uniform(69, 71), rng.uniform(20, 24)) for i in range(80)]
    got = X.radius_join(spark.createDataFrame(a, "id long, lat double, lon double"), spark.createDataFrame(b, "poi_id long, lat double, lon double"), 20_000.0).select("id", "poi_id").collect()
    want = {(i, j) for i, x, y in a for j, u, v in b if hav(x, y, u, v) <= 20_000}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_knn_reaches_far_points(spark):
    a = spark.createDataFrame([(1, 60.0, 10.0), (2, -30.0, 100.0)], "id long, lat double, lon double")
    b = spark.createDataFrame([(i, 60.0 + i / 10, 10.0) for i in range(4)], "poi_id long, lat double, lon double")
    got = {(r.id, r.rank): r.poi_id for r in X.knn(a, b, 2, 5000.0, most_m=25_000_000.0).collect()}
    assert got[(1, 1)] == 0 and got[(1, 2)] == 1


DIAMOND = [(1, 1, 2, 100.0, "motorway", None), (2, 2, 4, 100.0, "motorway", None), (3, 1, 3, 200.0, "primary", 3.0), (4, 3, 4, 200.0, "primary", None), (5, 1, 4, 900.0, "track", None)]


def diamond(spark):
    e = spark.createDataFrame(DIAMOND, "edge_idx long, src long, dst long, length_m double, highway string, maxheight_m double")
    return e.withColumns({"req_id": F.lit(1).cast("long"), "weight": F.col("length_m"), "is_toll": F.lit(None).cast("boolean"), "is_ferry": F.lit(False)})


@pytest.mark.parametrize("options, want", [({}, [1, 2]), ({"avoid_motorways": True}, [3, 4]), ({"avoid_motorways": True, "maxheight_m": 3.5}, [5])])
def test_diamond(spark, options, want):
    req = spark.createDataFrame([(1, 1, 4)], "req_id long, start long, goal long")
    got = G.shortest_paths(req, diamond(spark).where(G.allowed(**options))).orderBy("pos").collect()
    assert [r.edge_idx for r in got] == want


def test_unreachable_gives_no_row(spark):
    req = spark.createDataFrame([(1, 4, 1)], "req_id long, start long, goal long")
    assert G.shortest_paths(req, diamond(spark)).count() == 0


def test_split_ways_at_junctions(spark):
    w = spark.createDataFrame([(1, i, n) for i, n in enumerate([1, 2, 3, 4])] + [(2, i, n) for i, n in enumerate([5, 3, 6])], "way_id long, pos int, node long")
    c = spark.createDataFrame([(n, 60 + n / 100, 10.0) for n in range(1, 7)], "id long, lat double, lon double")
    got = {(r.way_id, r.src, r.dst, len(r.shape)) for r in G.split_ways(w, c).collect()}
    assert got == {(1, 1, 3, 3), (1, 3, 4, 2), (2, 5, 3, 2), (2, 3, 6, 2)}


def test_terrain_path_goes_round_a_wall():
    grid = [[0.0, 100.0, 0.0], [0.0, 100.0, 0.0], [0.0, 0.0, 0.0]]
    path, _ = G.terrain_path(grid, 40.0, (0, 0), (0, 2))
    assert (0, 1) not in path and (1, 1) not in path and path[0] == (0, 0) and path[-1] == (0, 2)
    assert G.terrain_path(grid, 40.0, (0, 0), (0, 2), wet={(2, 0): "hard", (2, 1): "hard", (2, 2): "hard", (1, 0): "hard"}) is None


def test_spaced_is_greedy(spark):
    s = spark.createDataFrame([(1, i, 60.0 + i * 0.01, 10.0) for i in range(6)], "req_id long, pos int, lat double, lon double")
    assert [r.pos for r in Q.spaced(s, 2000.0).orderBy("pos").collect()] == [0, 2, 4]


def test_european_and_american_days(spark):
    trips = spark.createDataFrame([(1, 7, 20.0, 1400.0, dt.date(2026, 7, 27))], "req_id long, driver long, hours double, km double, start date")
    none = spark.createDataFrame([], "driver long, day date, hours double")
    eu = P.plan_truck(trips, none).orderBy("day").collect()
    us = P.plan_fmcsa(trips, none).orderBy("day").collect()
    assert [r.driving_hours for r in eu] == [9.0, 9.0, 2.0] and [r.driving_hours for r in us] == [11.0, 9.0]
    assert eu[-1].end_km == 1400.0 and eu[0].rest_kind == "daily_regular" and eu[-1].rest_kind is None


def test_deadline(spark):
    r = spark.createDataFrame([(dt.date(2026, 7, 31),)], "d date").select(P.compensation_deadline(F.col("d")).alias("x"), P.week_monday(F.col("d")).alias("m")).first()
    assert r.m == dt.date(2026, 7, 27) and r.x == dt.date(2026, 8, 23)


def test_search_ranks_and_folds(spark):
    p = spark.createDataFrame([(1, "Åsen kafé", "amenity:cafe", 60.0, 10.0), (2, "Asker", "place:town", 60.0, 10.0), (3, "Nye Åsgard", "highway:residential", 60.0, 10.0)], "osm_id long, name string, kind string, lat double, lon double")
    assert [r.osm_id for r in S.search(p, "as", 5).collect()][0] == 2
    assert {r.osm_id for r in S.search(p, "as", 5).collect()} == {1, 2, 3} and S.search(p, "  ", 5).count() == 0
    assert [r.osm_id for r in S.search(p, "åsen kaf", 5).collect()] == [1]


def test_config_defaults(spark):
    log = spark.createDataFrame([("eco", '{"mass": 900}', 1), ("eco", '{"mass": 950}', 2)], "key string, value_json string, version long")
    assert tuple(stores.load_config(log, "eco", "mass double, cd double", {"mass": 1500.0, "cd": 0.32}).first()) == (950.0, 0.32)
    assert tuple(stores.load_config(log, "none", "mass double", {"mass": 1500.0}).first()) == (1500.0,)


def test_off_route_step():
    s, out = (None, False), []
    for off, t in ((True, 0), (True, 3000), (True, 5000), (True, 9000), (False, 9500), (True, 10000), (True, 15000)):
        s, a = tracks.off_route_step(s, off, False, t)
        out.append(a)
    assert out == ["none", "none", "reroute", "none", "none", "none", "reroute"]


def test_track_stream_matches_batch(spark, tmp_path):
    rows = [(i, i % 3, 100 + i, 60.0 + i / 100, 10.0) for i in range(30)]
    spark.createDataFrame(rows, "event_id long, station long, t long, lat double, lon double").write.parquet(str(tmp_path / "in"))
    src = spark.readStream.schema("event_id long, station long, t long, lat double, lon double").parquet(str(tmp_path / "in"))
    q = tracks.track_stream(src).writeStream.format("memory").queryName("tracks").outputMode("update").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(90)
    got = {r.station: r.t for r in spark.sql("select station, max(t) as t from tracks group by station").collect()}
    assert got == {0: 127, 1: 128, 2: 129}


def test_gpsd(spark):
    lines = [('{"class":"TPV","mode":3,"lat":60.0,"lon":10.0,"track":null}',), ('{"class":"TPV","mode":1,"lat":1.0,"lon":1.0}',), ('{"class":"SKY"}',), ("junk",)]
    assert [tuple(r)[:2] + (r.speed, r.course) for r in tracks.from_gpsd(spark.createDataFrame(lines, "value string")).collect()] == [(60.0, 10.0, 0.0, 0.0)]


def _vi(n):
    out = b""
    while True:
        out += bytes([n & 127 | (128 if n > 127 else 0)])
        n >>= 7
        if not n:
            return out


def _f(number, value):
    return _vi(number << 3) + _vi(value) if isinstance(value, int) else _vi(number << 3 | 2) + _vi(len(value)) + value


def _pbf(path):
    zz = lambda n: n << 1 if n >= 0 else (-n << 1) - 1
    strings = [b"", b"highway", b"primary", b"amenity", b"toilets", b"type", b"route", b"forward", b"natural", b"wetland"]
    table = _f(1, b"".join(_f(1, s) for s in strings))
    ids, lats, lons = [1, 1, 1, 1], [600000000, 1000000, 1000000, 0], [100000000, 0, 1000000, 1000000]
    dense = _f(1, b"".join(_vi(zz(i)) for i in ids)) + _f(8, b"".join(_vi(zz(v)) for v in lats)) + _f(9, b"".join(_vi(zz(v)) for v in lons)) + _f(10, b"\x03\x04\x00\x00\x00\x00")
    way = lambda i, refs, k, v: _f(1, i) + _f(2, _vi(k)) + _f(3, _vi(v)) + _f(8, b"".join(_vi(zz(r)) for r in refs))
    rel = _f(1, 9) + _f(2, _vi(5)) + _f(3, _vi(6)) + _f(8, _vi(7)) + _f(9, _vi(zz(5))) + _f(10, _vi(1))
    block = table + _f(2, _f(2, dense)) + _f(2, _f(3, way(5, [1, 1, 1], 1, 2)) + _f(3, way(6, [1, 1, 1, 1, -3], 8, 9))) + _f(2, _f(4, rel))
    with open(path, "wb") as f:
        for kind, data in ((b"OSMHeader", b""), (b"OSMData", block)):
            blob = _f(2, len(data)) + _f(3, zlib.compress(data))
            head = _f(1, kind) + _f(3, len(blob))
            f.write(struct.pack(">I", len(head)) + head + blob)


def test_pbf_source(spark, tmp_path):
    _pbf(tmp_path / "x.osm.pbf")
    osm_pbf.register(spark)
    osm = spark.read.format("osm_pbf").load(str(tmp_path / "x.osm.pbf"))
    assert {r.kind: r.n for r in osm.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"node": 4, "way": 2, "relation": 1}
    n = {r.id: (round(r.lat, 4), round(r.lon, 4)) for r in osm_tables.nodes(osm).collect()}
    assert n[1] == (60.0, 10.0) and n[4] == (60.2, 10.2)
    assert osm_tables.pois(osm).first().categories == ["restroom"]
    e = osm_tables.car_edges(osm).collect()
    assert {(r.src, r.dst, r.is_rev) for r in e} >= {(1, 3, False), (3, 1, True)} or {(r.src, r.dst) for r in e} >= {(1, 2), (2, 1)}
    assert osm_tables.wetlands(osm).first()["class"] == "soft"
    assert [r.way_id for r in osm_tables.network_ways(osm, lambda t: F.try_element_at(t, F.lit("type")) == "route").collect()] == [5]


def test_heights(spark, tmp_path):
    import numpy as np

    grid = np.arange(9, dtype=">i2").reshape(3, 3)
    grid[0, 2] = rasters.VOID
    (tmp_path / "N60E010.hgt").write_bytes(grid.tobytes())
    cells = rasters.read_hgt(spark, str(tmp_path))
    pts = spark.createDataFrame([(1, 60.0, 10.0), (2, 60.5, 10.5), (3, 60.99, 10.99), (4, 59.0, 10.0)], "id long, lat double, lon double")
    assert {r.id: r.h for r in rasters.sample_heights(pts, cells).collect()} == {1: 6.0, 2: 4.0, 3: None, 4: None}


def test_tiles(spark):
    assert rasters.tiles_of_bbox(spark, (59.0, 9.0, 61.0, 12.0), 3).groupBy("z").count().count() == 4
    assert {r.tile for r in rasters.dem_tiles_of_bbox(spark, (60.2, 9.9, 61.1, 10.1)).collect()} == {"N60E009", "N60E010", "N61E009", "N61E010"}
    assert rasters.tile_directory(bytes([2, 5, 3, 1, 1, 10, 20, 1, 0])) == [(5, 0, 10, 1), (8, 10, 20, 1)]


def test_plugins(spark):
    m = plugins.load('{"name": "p", "version": "1", "capabilities": ["log"]}', frozenset({"log"}))
    host = plugins.Host(m.capabilities)
    assert plugins.call(lambda h: h.log("x"), host, 5)[0] == "ok" and host.lines == ["x"]
    with pytest.raises(plugins.PluginError):
        host.position()
    with pytest.raises(plugins.PluginError):
        plugins.load('{"name": "p", "version": "1", "capabilities": ["poi_write"]}', frozenset({"log"}))
    import time

    assert plugins.call(lambda h: time.sleep(1.5), host, 0.1)[0] == "timeout"


def test_reduced_rests_run_out(spark):
    trips = spark.createDataFrame([(1, 7, 50.0, 3500.0, dt.date(2026, 7, 27))], "req_id long, driver long, hours double, km double, start date")
    none = spark.createDataFrame([], "driver long, day date, hours double")
    got = [r.rest_kind for r in P.plan_truck(trips, none, P.Ec561(prefer_reduced=True)).orderBy("day").collect()]
    assert got == ["daily_reduced"] * 3 + ["daily_regular", "daily_regular", None]


def test_debts_are_repaid_oldest_first(spark):
    reduced = spark.createDataFrame([(1, dt.date(2026, 7, 10)), (1, dt.date(2026, 7, 24))], "driver long, day date")
    rests = spark.createDataFrame([(1, dt.date(2026, 7, 12), 11.0), (1, dt.date(2026, 7, 14), 30.0)], "driver long, day date, hours double")
    got = {r.reduced_on: r.repaid_on for r in cards.settle(cards.new_debts(reduced), rests).collect()}
    assert got == {dt.date(2026, 7, 10): dt.date(2026, 7, 14), dt.date(2026, 7, 24): None}


def _walk(samples, total, huts, most, rules):
    """A hike planned point by point: samples (km, lat, lon), huts (id, lat, lon, network, rejected)."""

    def m(a, b):
        x = [math.radians(v) for v in (*a, *b)]
        h = math.sin((x[2] - x[0]) / 2) ** 2 + math.cos(x[0]) * math.cos(x[2]) * math.sin((x[3] - x[1]) / 2) ** 2
        return 2 * 6371008.8 * math.asin(math.sqrt(h))

    def at(km):
        for p, q in zip(samples, samples[1:]):
            if p[0] <= km < q[0] or q is samples[-1]:
                t = (km - p[0]) / (q[0] - p[0])
                return p[1] + (q[1] - p[1]) * t, p[2] + (q[2] - p[2]) * t

    def choice(point):
        near = [(h[4], not (h[3] and d <= rules.prefer_network_m), h[3], round(d, 3), h) for h in huts for d in [m(point, h[1:3])] if d <= (rules.network_m if h[3] else rules.cabin_m)]
        return min(near, key=lambda x: (*x[:4], x[4][0]), default=None)

    start, out = 0.0, []
    while start < total - 0.01:
        end = min(start + min(max(most, 1), total - start), total)
        hut, gap, stop = None, False, total
        if end < total - 0.01:
            best, k = None, 0
            while (km := start + 8 + 0.5 * k) <= end:
                k += 1
                c = choice(at(km))
                if c is None or c[3] > rules.near_m:
                    continue
                h = c[4]
                inside = [(round(m(s[1:], h[1:3]), 3), s[0]) for s in samples if start <= s[0] <= end]
                off, hut_km = min(inside) if inside else (round(m(at(km), h[1:3]), 3), km)
                if hut_km - start < 5:
                    continue
                if best is None:
                    take = True
                elif h[3] != best[2]:
                    take = h[3]
                elif abs(off - best[1]) > 500:
                    take = off < best[1]
                else:
                    take = hut_km > best[0] or (abs(hut_km - best[0]) < 1 and off < best[1])
                if take:
                    best = (hut_km, off, h[3], h)
            if best:
                stop, hut, gap = best[0], best[3][0], best[1] > rules.near_m or best[3][4]
            else:
                c = choice(at(end))
                stop, hut, gap = end, c and c[4][0], c is None or c[3] > rules.near_m or c[4][4]
        stop = min(max(stop, start + 0.01), total)
        out.append((len(out) + 1, round(start, 3), round(stop, 3), hut, gap))
        start = stop
    return out


def test_hut_days_equal_a_walk(spark):
    rng = random.Random(4)
    coords, huts, samples = [], [], {}
    for i in range(40):
        huts.append((i, 60 + rng.random() * 1.5, 10 + rng.random() * 0.3, rng.random() < 0.4, rng.random() < 0.2))
    for req in range(6):
        lat, lon = 60.0, 10.15
        for pos in range(30 if req else 1):
            coords.append((req, pos, lat, lon))
            lat, lon = lat + 0.02 + 0.05 * rng.random(), lon + 0.04 * (rng.random() - 0.5)
    c = Q.cumulative_m(spark.createDataFrame(coords, "req_id long, pos int, lat double, lon double"))
    for r in c.orderBy("req_id", "pos").collect():
        samples.setdefault(r.req_id, []).append((r.cum_m / 1000, r.lat, r.lon))
    h = spark.createDataFrame(huts, "hut_id long, lat double, lon double, is_network boolean, rejected boolean")
    got = {}
    for r in hiking.plan_hikes(c, h, 40.0).orderBy("req_id", "day").collect():
        got.setdefault(r.req_id, []).append((r.day, round(r.start_km, 3), round(r.end_km, 3), r.hut_id, r.gap))
    want = {q: _walk(s, s[-1][0], huts, 40.0, hiking.HutRules()) for q, s in samples.items() if s[-1][0] > 0.01}
    assert got == want and max(map(len, want.values())) > 3 and hiking.plan_hikes(c.limit(0), h).count() == 0
    assert all(d[3] is None for days in [sorted((r.day, r.start_km, r.end_km, r.hut_id) for r in hiking.plan_hikes(c.where("req_id = 1"), h.limit(0)).collect())] for d in days)


def test_plan_hikes(spark):
    coords = spark.createDataFrame([(1, i, 60.0 + i * 0.05, 10.0) for i in range(13)], "req_id long, pos int, lat double, lon double")
    huts = spark.createDataFrame([(5, 60.3, 10.01, True, False), (6, 60.2, 10.2, False, True)], "hut_id long, lat double, lon double, is_network boolean, rejected boolean")
    got = api.plan_hikes(coords, huts).orderBy("day").collect()
    assert got[0].hut_id == 5 and 30 < got[0].end_km < 36 and got[-1].end_km > 66 and not got[0].gap


def test_cards_and_polyline(spark):
    p = spark.createDataFrame([(1, 0, 60.0, 10.0), (1, 1, 60.0, 10.0), (1, 2, 61.0, 10.5)], "req_id long, pos int, lat double, lon double")
    assert cards.polyline(p, 1).first().polyline == "10.0,60.0;10.5,61.0"
    iso = spark.range(1).select(*(cards.rules_pack(F.lit(x)).alias(x) for x in ("us", "no", "gb"))).first()
    assert tuple(iso) == ("fmcsa", "ec561", "unknown")


def test_plan_routes(spark):
    nodes = spark.createDataFrame([(i, 60.0 + i * 0.01, 10.0) for i in range(5)] + [(9, 70.0, 25.0)], "id long, lat double, lon double")
    edges = spark.createDataFrame([(i, i, i + 1, 1112.0, "primary", 80.0, None) for i in range(4)], "edge_idx long, src long, dst long, length_m double, highway string, maxspeed_kmh double, maxheight_m double").withColumns({"weight": F.col("length_m"), "is_toll": F.lit(False), "is_ferry": F.lit(False)})
    req = spark.createDataFrame([(1, 60.0, 10.0, 60.04, 10.0), (2, 60.0, 10.0, 61.0, 10.0), (3, 60.04, 10.0, 60.0, 10.0)], "req_id long, a_lat double, a_lon double, b_lat double, b_lon double")
    got = {r.req_id: r for r in api.plan_routes(req, nodes, edges, maxheight_m=4.0).collect()}
    assert got[1].status == "ok" and got[1].length_m == 4448.0 and abs(got[1].minutes - 3.336) < 1e-9 and '"day":1' in got[1].cards
    assert got[2].status == "snap_too_far" and got[3].status == "no_path"


def test_nearest_vectors_have_no_cap(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(3)
    x = rng.integers(0, 6, (1300, 4)).astype(np.float32)  # many equal distances
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "vec_id long, embedding array<float>").repartition(5)
    monkeypatch.setattr(S, "QUERY_BLOCK", 500)
    got = {}
    for r in S.nearest_vectors(rows, rows, 5).collect():
        got.setdefault(r.q_id, set()).add((r.dist, r.vec_id))
    d = np.round(np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2, dtype=np.float64)), 4)
    assert got == {i: {(d[i, j], j) for j in sorted(range(len(x)), key=lambda j: (d[i, j], j))[:5]} for i in range(len(x))}
    assert S.nearest_vectors(rows, rows.limit(0), 5).count() == 0


def test_vector_topk_answers_all_its_queries(spark, tmp_path):
    from wayloom.plans import registry

    n = 20 * 1100
    spark.range(n).selectExpr("id as vec_id", "array(cast(id as float), cast(0 as float)) as embedding").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = registry.queries()["vector_topk"](spark, str(tmp_path))
    assert got.select("q_id").distinct().count() == 1100 and got.count() == 5500


@pytest.mark.parametrize("name", ["truck_days", "fmcsa_days", "hut_days"])
def test_planners_take_every_trip(spark, name):
    from wayloom.plans import planner_queries, registry, views

    d = "/root/testdata/sf0.001"
    want = views.nodes(spark, d).select("id") if name == "hut_days" else planner_queries._trips(spark, d).select("req_id")
    got = registry.queries()[name](spark, d).select("req_id").distinct()
    assert sorted(got.collect()) == sorted(want.distinct().collect())


def test_equal_hikes_are_planned_once(spark, monkeypatch):
    from wayloom.operators import hiking

    seen = []
    monkeypatch.setattr(hiking, "_one_day", lambda todo, *a, f=hiking._one_day: seen.append(todo.count()) or f(todo, *a))
    s = spark.sql("select t.id as req_id, p.id as pos, 60 + p.id * 0.1 as lat, 10D as lon, p.id * 11120D as cum_m from range(3) t, range(5) p").withColumn("lat", F.col("lat").cast("double"))
    h = spark.createDataFrame([(i, 60.2, 10.0, False, False) for i in (7, 5)], "hut_id long, lat double, lon double, is_network boolean, rejected boolean")
    got = {r.req_id: set() for r in s.collect()}
    for x in hiking.plan_hikes(s, h).collect():
        got[x.req_id].add((x.day, x.start_km, x.end_km, x.hut_id, x.gap))
    assert got[0] == got[1] == got[2] and {5} == {x[3] for x in got[0]} - {None} and set(seen) <= {0, 1}


def test_hikes_take_one_plan_however_many_days(spark, monkeypatch):
    """No round of jobs a day; huts beyond the broadcast are planned in rounds, with the same days."""
    rng = random.Random(21)
    coords = [(q, i, 60.0 + i * 0.06, (179.9 if q == 3 else 10.0) + rng.random() * 0.2) for q in range(5) for i in range(25)] + [(9, i, None if i == 4 else 60 + i * 0.1, 10.0) for i in range(9)]
    huts = [(i, 60 + rng.random() * 1.5, rng.choice([10.0, 179.9, -180.0]) + rng.random() * 0.2, rng.choice([True, False, None]), rng.choice([True, False, False, None])) for i in range(80)] + [(200, None, 10.0, True, False)]
    c = Q.cumulative_m(spark.createDataFrame(coords, "req_id long, pos int, lat double, lon double"))
    h = spark.createDataFrame(huts, "hut_id long, lat double, lon double, is_network boolean, rejected boolean")
    days = lambda: sorted((r.req_id, r.day, round(r.start_km, 3), round(r.end_km, 3), r.hut_id or -1, r.gap) for r in hiking.plan_hikes(c, h).collect())
    seen, f = [], hiking._one_day
    monkeypatch.setattr(hiking, "_one_day", lambda *a: seen.append(1) or f(*a))
    whole = days()
    assert not seen and max(x[1] for x in whole) > 3
    monkeypatch.setattr(hiking, "BROADCAST_HUTS", 0)
    assert days() == whole and seen
