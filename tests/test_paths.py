"""Profiles, stops, energy and histories: odd rows and empty tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from wayloom.functions import profiles as P
from wayloom.functions.energy import Eco
from wayloom.operators import paths as A


@pytest.fixture()
def line(spark):
    return spark.createDataFrame([(1, 0, 60.0, 10.0), (1, 1, 60.01, 10.0), (1, 2, 60.02, 10.0), (2, 0, 60.0, 10.0), (3, 0, None, 10.0), (3, 1, 60.0, 10.0)], "req_id long, pos int, lat double, lon double")


def test_legs_and_minutes(spark, line):
    legs = A.legs(line).withColumns({"length_m": F.when(F.col("pos") == 0, 1000.0), "speed_kmh": F.lit(0.0)})
    got = {r.req_id: r.minutes for r in A.minutes(legs).collect()}
    assert got[1] == pytest.approx(60 + 1113.19 / 1000 / 50 * 60, abs=0.01) and 2 not in got
    assert A.minutes(legs.limit(0)).count() == 0


def test_energy_and_steep_parts(spark):
    e = spark.createDataFrame([(1, 0, 100.0, 10.0), (1, 1, 100.0, -10.0), (1, 2, 10.0, 9.0), (1, 3, 200.0, None), (1, 4, 100.0, 6.0)], "req_id long, pos int, length_m double, climb double")
    b = A.energy_breakdown(e, eco=Eco(regen=0.5)).first()
    assert (b.climb_m, b.descent_m, b.regen_j) == (25.0, 10.0, pytest.approx(0.5 * 1500 * 9.80665 * 10)) and b.net_j == pytest.approx(b.uphill_j + b.downhill_j)
    text = A.energy_breakdown(e).select(A.energy_report({c: F.col(c) for c in ("climb_m", "descent_m", "uphill_j", "downhill_j", "regen_j", "net_j")}).alias("t")).first().t
    assert text.startswith("eco_climb_m=25.0; eco_descent_m=10.0; eco_uphill_j=")
    assert [(r.pos, r.along_m, round(r.grade_pct, 6)) for r in A.steep(e, 0.05).orderBy("pos").collect()] == [(0, 0.0, 10.0), (4, 410.0, 6.0)]


def test_polylines_skip_what_is_no_point(spark):
    rows = spark.createDataFrame([(1, "10.0,60.0;x,y;10.0;10.0,60.01"), (2, ""), (3, None)], "req_id long, polyline string")
    got = [(r.req_id, r.pos, round(r.km, 3)) for r in A.polyline_km(rows).orderBy("req_id", "pos").collect()]
    assert got == [(1, 0, 0.0), (1, 3, 1.112)]


def test_stops(spark):
    t = spark.createDataFrame([(1, 100.0), (1, 300.0), (2, 100.0)], "req_id long, target_km double")
    c = spark.createDataFrame([(1, 1, 101.0, "rest_area"), (1, 2, 106.0, "lodging"), (1, 3, 94.0, "lodging"), (1, 4, 326.0, "lodging")], "req_id long, cand_id long, along_km double, kind string")
    got = {(r.req_id, r.target_km): (r.cand_id, r.kind) for r in A.overnight_stops(t, c).collect()}
    assert got == {(1, 100.0): (2, "lodging"), (1, 300.0): (None, "none"), (2, 100.0): (None, "none")}
    assert A.overnight_stops(t, c.limit(0)).where("kind = 'none'").count() == 3


def test_night_places(spark):
    c = spark.createDataFrame([(1, 60.0, 10.0, True), (2, 60.1, 10.0, False), (3, 60.2, 10.0, False), (4, None, 10.0, False)], "poi_id long, lat double, lon double, established boolean")
    b = spark.createDataFrame([(60.001, 10.0), (60.2005, 10.0)], "lat double, lon double")
    g = spark.createDataFrame([(60.005, 10.0), (60.105, 10.0), (60.2, 10.0)], "lat double, lon double")
    assert {r.poi_id: r.reject for r in A.overnight_safety(c, b, g).collect()} == {1: "building", 2: "glacier", 3: "building", 4: None}
    assert {r.reject for r in A.overnight_safety(c, b.limit(0), g.limit(0)).collect()} == {None}


def test_vias_and_history(spark):
    schema = "req_id long, name string, lat double, lon double, km double"
    u = spark.createDataFrame([(1, "Hut A", 60.0, 10.0, 5.0)], schema)
    a = spark.createDataFrame([(1, "hut a", 61.0, 10.0, 1.0), (1, "B", 60.001, 10.0, 2.0), (1, "C", 60.1, 10.0, 3.0), (2, "Hut A", 60.0, 10.0, 1.0)], schema)
    assert [(r.req_id, r.pos, r.name) for r in A.merged_vias(u, a).orderBy("req_id", "pos").collect()] == [(1, 1, "C"), (1, 2, "Hut A"), (2, 1, "Hut A")]
    h = spark.createDataFrame([(1, dt.date(2026, 1, 1), 4.0), (1, dt.date(2026, 1, 20), 4.0), (2, dt.date(2025, 1, 1), 1.0)], "driver long, day date, hours double")
    new = spark.createDataFrame([(1, dt.date(2026, 1, 25), 3.0), (1, dt.date(2026, 1, 20), 1.0)], "driver long, day date, hours double")
    assert sorted((r.driver, r.day.day, r.hours) for r in A.record_hours(h, new).collect()) == [(1, 20, 5.0), (1, 25, 3.0), (2, 1, 1.0)]
    assert A.record_hours(h, new.limit(0)).count() == 3


def test_wetlands_and_progress(spark, line):
    ring = lambda i, hard, at: (i, hard, [{"lon": x, "lat": y} for x, y in ((at, 60.0), (at + 1, 60.0), (at + 1, 61.0), (at, 61.0))])
    rings = spark.createDataFrame([ring(1, False, 10.0), ring(2, True, 10.5)], "ring_id long, hard boolean, ring array<struct<lon:double,lat:double>>")
    e = spark.createDataFrame([(i, 60.4, x, 60.6, x, 2.0, b) for i, x, b in ((1, 10.2, False), (2, 10.7, False), (3, 10.7, True), (4, 9.0, True))], "edge_idx long, lat double, lon double, n_lat double, n_lon double, weight double, boardwalk boolean")
    assert {r.edge_idx: (r.effect, r.weight) for r in A.wetland_edges(e, rings, 0.3).collect()} == {1: ("soft", 10.0), 2: ("blocked", None), 3: ("boardwalk", 2.0), 4: ("none", 2.0)}
    p = A.progress(line.withColumns({"step_m": F.lit(10_000.0), "speed_kmh": F.lit(20.0)})).where("req_id = 1").orderBy("pos").collect()
    assert [(r.elapsed_hours, round(r.remaining_minutes, 6)) for r in p] == [(0.5, 60.0), (1.0, 30.0), (1.5, 0.0)]
    assert A.extent(line.limit(0)).first().south is None


def test_profiles(spark):
    rows = spark.createDataFrame([(p, None, None) for p in (*P.PROFILES, "boat", None)], "profile string, h double, k double")
    got = {r.profile: r for r in rows.select("profile", P.daily_budget(F.col("profile"), F.col("h"), F.col("k")).alias("b"), *(c.alias(n) for n, c in P.flags(F.col("profile")).items())).collect()}
    assert tuple(got["car"].b) == (8.0, None) and tuple(got["cycling"].b) == (None, 100.0) and tuple(got["truck"].b) == tuple(got["boat"].b) == (None, None)
    assert got["hiking"].eco_default and not got["hiking"].motor_days and got["mobile_home"].clearance_limits and not got["boat"].motor_days
