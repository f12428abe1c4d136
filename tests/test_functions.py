"""Golden values of the scalar functions."""

import math

from pyspark.sql import functions as F

from wayloom.functions import energy, geo, roads, tags as T


def one(spark, *cols):
    return tuple(spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first())


def test_distance_and_bearing(spark):
    d, b, n = one(spark, geo.haversine_m(60.0, 10.0, 61.0, 10.0), geo.bearing_deg(60.0, 10.0, 60.0, 11.0), geo.haversine_m(F.lit(None).cast("double"), 1.0, 2.0, 3.0))
    assert abs(d - math.radians(1) * geo.R_GRAPH) < 1e-3 and 89 < b < 90 and n is None


def test_roundabout_sectors(spark):
    got = one(spark, *(geo.roundabout_sector(F.lit(float(x))) for x in (-157, 0, -68, 202, 300, -300, 180)))
    assert got == (7, 4, 6, 0, 0, 8, 0)


def test_point_in_ring(spark):
    ring = F.array(*(F.struct(F.lit(x).alias("lon"), F.lit(y).alias("lat")) for x, y in ((0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0))))
    assert one(spark, geo.point_in_ring(F.lit(1.0), F.lit(1.0), ring), geo.point_in_ring(F.lit(3.0), F.lit(1.0), ring), geo.point_in_ring(F.lit(1.0), F.lit(1.0), F.slice(ring, 1, 2))) == (True, False, False)


def test_segments(spark):
    c = lambda *v: geo.segments_intersect(*(F.lit(float(x)) for x in v))
    assert one(spark, c(0, 0, 2, 2, 0, 2, 2, 0), c(0, 0, 1, 0, 2, 0, 3, 0), c(0, 0, 1, 0, 1, 0, 1, 5)) == (True, False, True)


def test_maxspeed(spark):
    got = one(spark, *(roads.parse_maxspeed_kmh(F.lit(x)) for x in ("80;70", "60 mph", "no:urban", "none", "0", "x")))
    assert got[0] == 80 and abs(got[1] - 96.56064) < 1e-9 and got[2:] == (50.0, None, None, None)


def test_labels(spark):
    assert one(spark, roads.format_distance(F.lit(999.4)), roads.format_distance(F.lit(1234.0)), roads.format_distance(F.lit(-1.0)), roads.road_label(F.lit(" "), F.lit("E6"), F.lit("trunk")), roads.road_label(F.lit(None).cast("string"), F.lit(None).cast("string"), F.lit("trunk_link"))) == ("999 m", "1.2 km", "", "E6", "Trunk road")


def test_folding_keeps_letters_of_their_own(spark):
    assert one(spark, roads.fold_name(F.lit("Ås Löten")), roads.fold_name(F.lit("Bærum Løten"))) == ("as loten", "bærum løten")


def test_energy(spark):
    flat, down, grade = one(spark, energy.flat_energy_j(F.lit(100.0)), energy.segment_energy_j(F.lit(100.0), F.lit(-50.0)), energy.climb_grade(energy.tractive_force_n(F.lit(85.0), F.lit(27.5)), F.lit(100.0), F.lit(0.008)))
    assert abs(down - flat) < 1e-6 and abs(grade - (85 / (27.5 * 0.0254 / 2) / 980.665 - 0.008)) < 1e-12


def test_energy_floor(spark):
    flat, down = one(spark, energy.flat_energy_j(F.lit(100.0), energy.Eco(regen=0.4)), energy.segment_energy_j(F.lit(100.0), F.lit(-500.0), energy.Eco(regen=0.4)))
    assert abs(down - 0.01 * flat) < 1e-6


def test_relations(spark):
    m = lambda **k: F.create_map(*(F.lit(x) for kv in k.items() for x in kv))
    assert one(spark, T.official_route(m(type="route", route="hiking", network="NWN")), T.pilgrim_route(m(type="route", route="foot", name="Olavsleden nord")), T.pilgrim_route(m(type="route", route="road"))) == (True, True, False)


def test_named_feature_takes_the_last_kind(spark):
    kv = F.array(*(F.struct(F.lit(k).alias("k"), F.lit(v).alias("v")) for k, v in (("place", "town"), ("amenity", "cafe"), ("name", "X"))))
    name, kind = T.named_feature(kv)
    assert one(spark, name, kind) == ("X", "amenity:cafe")
