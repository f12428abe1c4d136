"""Aggregates and sequences along paths: time, energy, steep parts, samples of polylines, stops and vias."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayloom.functions import energy, geo
from wayloom.operators import spatial
from wayloom.operators.lineage import cut

FALLBACK_KMH = 50.0
OVERNIGHT_KM, RANK_KM = 25.0, 5.0
BUILDING_M, GLACIER_M = 150.0, 1000.0
SAME_PLACE_M = 500.0
KEEP_DAYS = 21
SOFT_WETLAND = 5.0


def legs(points: DataFrame, key: str = "req_id") -> DataFrame:
    """Each point with the next one (n_lat, n_lon) and the great circle to it (leg_m); the last has none."""
    w = W.partitionBy(key).orderBy("pos")
    nxt = points.withColumns({"n_lat": F.lead("lat").over(w), "n_lon": F.lead("lon").over(w)}).where("n_lat is not null")
    return nxt.withColumn("leg_m", geo.haversine_m(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon")))


def minutes(legs: DataFrame, key: str = "req_id") -> DataFrame:
    """(key, minutes) of legs with the edge's length_m and speed_kmh; legs without an edge take FALLBACK_KMH on the great circle (leg_m)."""
    known = F.col("length_m") / 1000 / F.greatest(F.col("speed_kmh"), F.lit(1.0))
    return legs.groupBy(key).agg((F.sum(F.coalesce(known, F.col("leg_m") / 1000 / FALLBACK_KMH)) * 60).alias("minutes"))


def energy_breakdown(edges: DataFrame, key: str = "req_id", eco: energy.Eco = energy.Eco()) -> DataFrame:
    """One pass over edges (length_m, climb; null is level): climb, descent, uphill, downhill, regeneration and net energy."""
    dh = F.coalesce("climb", F.lit(0.0))
    own = energy.segment_energy_j(F.col("length_m"), dh, eco)
    up, down = dh >= 0, dh < 0
    some = lambda on, x: F.sum(F.when(on, x).otherwise(F.lit(0.0)))
    regen = min(1.0, max(0.0, eco.regen))
    return edges.groupBy(key).agg(
        some(up, dh).alias("climb_m"), some(down, -dh).alias("descent_m"), some(up, own).alias("uphill_j"), some(down, own).alias("downhill_j"),
        (some(down, -dh) * regen * eco.mass * energy.G).alias("regen_j"), F.sum(own).alias("net_j"),
    )


def energy_report(row: dict[str, Column]) -> Column:
    c = lambda name: row[name]
    return F.format_string(
        "eco_climb_m=%.1f; eco_descent_m=%.1f; eco_uphill_j=%.0f; eco_downhill_j=%.0f; eco_regen_credit_j=%.0f; eco_net_j=%.0f",
        c("climb_m"), c("descent_m"), c("uphill_j"), c("downhill_j"), c("regen_j"), c("net_j"))


def steep(edges: DataFrame, most: float, key: str = "req_id") -> DataFrame:
    """(key, pos, along_m, grade_pct) of edges that climb more than ``most`` (a fraction); along_m is where the edge starts."""
    w = W.partitionBy(key).orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    on = edges.withColumn("along_m", F.sum("length_m").over(w) - F.col("length_m"))
    return on.where(energy.grade_exceeds(F.col("climb"), F.col("length_m"), F.lit(most))).select(key, "pos", "along_m", (F.col("climb") / F.col("length_m") * 100).alias("grade_pct"))


def polyline_km(lines: DataFrame, key: str = "req_id") -> DataFrame:
    """(key, pos, lon, lat, km) of polylines "lon,lat;..."; parts that are no pair of numbers are skipped."""
    part = F.split(F.col("part"), ",")
    rows = lines.select(key, F.posexplode(F.split("polyline", ";")).alias("pos", "part")).select(key, "pos", F.get(part, F.lit(0)).try_cast("double").alias("lon"), F.get(part, F.lit(1)).try_cast("double").alias("lat"))
    w = W.partitionBy(key).orderBy("pos")
    rows = rows.where("lon is not null and lat is not null")
    step = geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"), geo.R_TRACKS) / 1000
    return rows.withColumn("_s", F.coalesce(step, F.lit(0.0))).withColumn("km", F.sum("_s").over(w.rowsBetween(W.unboundedPreceding, 0))).drop("_s")


def first_named(hits: DataFrame, key: str, order: str, name: str = "name") -> DataFrame:
    """Of each key the first row with a name, or the first row."""
    w = W.partitionBy(key).orderBy(F.trim(F.coalesce(F.col(name), F.lit(""))) == "", order)
    return hits.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def overnight_stops(targets: DataFrame, candidates: DataFrame, radius_km: float = OVERNIGHT_KM) -> DataFrame:
    """Every target (req_id, target_km) with the best candidate (req_id, cand_id, along_km, kind) within the radius, or kind none.

    Lodging, camping and rest areas count as 0, 5 and 10 km farther.
    """
    rank = F.when(F.col("kind") == "lodging", 0).when(F.col("kind") == "camping", 1).otherwise(2)
    cell = lambda km: F.floor(km / radius_km)
    t = targets.withColumn("_b", F.explode(F.sequence(cell(F.col("target_km")) - 1, cell(F.col("target_km")) + 1)))
    off = F.abs(F.col("along_km") - F.col("target_km"))
    near = t.join(candidates.withColumn("_b", cell(F.col("along_km"))), ["req_id", "_b"]).where(off <= radius_km)
    best = near.groupBy("req_id", "target_km").agg(F.min(F.struct(F.round(off + rank * RANK_KM, 6).alias("score"), F.col("cand_id"), F.col("kind"))).alias("m"))
    return targets.join(best, ["req_id", "target_km"], "left").select("req_id", "target_km", F.col("m.cand_id").alias("cand_id"), F.coalesce("m.kind", F.lit("none")).alias("kind"))


def overnight_safety(candidates: DataFrame, buildings: DataFrame, glaciers: DataFrame, building_m: float = BUILDING_M, glacier_m: float = GLACIER_M) -> DataFrame:
    """(poi_id, reject) of candidates (poi_id, lat, lon, established): building, glacier or null.

    Buildings count for all, glaciers only where no hut or cabin stands; buildings come first.
    """
    c = candidates.select("poi_id", "lat", "lon", "established")
    near = lambda of, m, name: spatial.radius_join(c, of.select("lat", "lon"), m).where(F.col("dist_m") < m).select("poi_id").distinct().withColumn(name, F.lit(True))
    j = c.join(near(buildings, building_m, "_b"), "poi_id", "left").join(near(glaciers, glacier_m, "_g"), "poi_id", "left")
    return j.select("poi_id", F.when(F.col("_b"), "building").when(F.col("_g") & ~F.col("established"), "glacier").alias("reject"))


def merged_vias(user: DataFrame, autos: DataFrame, key: str = "req_id") -> DataFrame:
    """User waypoints (key, name, lat, lon, km) and those automatic ones that no user waypoint already is (same name in any case, or near), in order of km and name."""
    a = autos.withColumn("_a", F.monotonically_increasing_id())
    u = user.select(F.col(key).alias("_k"), F.lower("name").alias("_n"), F.col("lat").alias("u_lat"), F.col("lon").alias("u_lon"))
    same = (F.lower("name") == F.col("_n")) | (geo.haversine_m(F.col("lat"), F.col("lon"), F.col("u_lat"), F.col("u_lon"), geo.R_MEAN) < SAME_PLACE_M)
    new = a.join(u, (F.col(key) == F.col("_k")) & same, "left_anti").drop("_a")
    both = user.withColumn("auto", F.lit(False)).unionByName(new.withColumn("auto", F.lit(True)))
    return both.withColumn("pos", F.row_number().over(W.partitionBy(key).orderBy("km", "name", "auto")))


def record_hours(history: DataFrame, driven: DataFrame, keep_days: int = KEEP_DAYS) -> DataFrame:
    """(driver, day, hours) after more driving; days more than ``keep_days`` before a driver's last driven day go.  Drivers without new hours keep all."""
    last = driven.groupBy("driver").agg(F.max("day").alias("_last"))
    both = history.select("driver", "day", "hours").unionByName(driven.select("driver", "day", "hours")).groupBy("driver", "day").agg(F.sum("hours").alias("hours"))
    return both.join(last, "driver", "left").where(F.col("_last").isNull() | (F.col("day") >= F.date_sub("_last", keep_days))).select("driver", "day", "hours")


def wetland_classes(points: DataFrame, rings: DataFrame, size_deg: float, point_id: str) -> DataFrame:
    """(point_id, wetland): hard or soft of the points in some ring (ring_id, ring, hard); hard wins where rings overlap."""
    place = spatial.places_with_flag(points, rings, size_deg, "hard")
    return points.select(point_id, "lat", "lon").join(place, ["lat", "lon"]).groupBy(point_id).agg(F.when(F.bool_or("hard"), "hard").otherwise("soft").alias("wetland"))


def wetland_edges(edges: DataFrame, rings: DataFrame, size_deg: float, edge_id: str = "edge_idx") -> DataFrame:
    """Edges (edge_id, lat, lon, n_lat, n_lon, weight, boardwalk) by the ring that holds their middle: effect and new weight.

    soft: the weight grows; hard: blocked, unless the edge is a boardwalk (kept); none: as it was.
    """
    middle = edges.select(edge_id, geo.interpolate(F.col("lat"), F.col("n_lat"), F.lit(0.5)).alias("lat"), geo.interpolate(F.col("lon"), F.col("n_lon"), F.lit(0.5)).alias("lon"))
    j = edges.join(wetland_classes(middle, rings, size_deg, edge_id), edge_id, "left")
    effect = F.when(F.col("wetland") == "soft", "soft").when((F.col("wetland") == "hard") & F.col("boardwalk"), "boardwalk").when(F.col("wetland") == "hard", "blocked").otherwise("none")
    return j.select(edge_id, effect.alias("effect"), F.when(effect == "soft", F.col("weight") * SOFT_WETLAND).when(effect != "blocked", F.col("weight")).alias("weight"))


def progress(samples: DataFrame, key: str = "req_id") -> DataFrame:
    """Samples (key, pos, step_m, speed_kmh) with elapsed_hours up to them and remaining_minutes from them."""
    w = W.partitionBy(key).orderBy("pos")
    hours = F.col("step_m") / 1000 / F.greatest(F.col("speed_kmh"), F.lit(1.0))
    on = samples.withColumn("_h", hours).withColumns({"elapsed_hours": F.sum("_h").over(w.rowsBetween(W.unboundedPreceding, 0)), "_all": F.sum("_h").over(W.partitionBy(key))})
    return on.select(key, "pos", "elapsed_hours", ((F.col("_all") - F.col("elapsed_hours")) * 60).alias("remaining_minutes"))


def extent(points: DataFrame) -> DataFrame:
    """One row: south, west, north, east of all points; null without any."""
    return points.agg(F.min("lat").alias("south"), F.min("lon").alias("west"), F.max("lat").alias("north"), F.max("lon").alias("east"))


PAUSE_CATEGORIES = ("rest_area", "general", "restroom", "overnight_facility", "cabin")
ROAD_LINK_M = 1000.0


def motor_pauses(targets: DataFrame, pois: DataFrame, vertices: DataFrame, radius_m: float) -> DataFrame:
    """Every target (target_id, lat, lon) with its pause: poi_id, name, kind, lat, lon.

    Places (poi_id, lat, lon, category, name) count within the radius if they stand on the route (a vertex within
    ROAD_LINK_M).  Named ones come first, then rest areas, then the nearer, then the smaller id; without any the
    pause is a rest stop at the target itself.
    """
    own = pois.where(F.col("category").isin(*PAUSE_CATEGORIES)).select("poi_id", "lat", "lon", "category", F.trim(F.coalesce("name", F.lit(""))).alias("name"))
    # of the places at one point only the first by this order can be picked, from wherever
    plain = ((F.col("name") == "").alias("a"), (F.col("category") != "rest_area").alias("b"))
    own = own.groupBy("lat", "lon").agg(F.min(F.struct(*plain, "poi_id", "name", "category")).alias("m")).select("lat", "lon", "m.poi_id", "m.name", "m.category")
    linked = spatial.radius_join(own, vertices.select("lat", "lon").distinct(), ROAD_LINK_M, how="left_semi")
    near = spatial.radius_join(targets.select("lat", "lon").distinct(), linked, radius_m)
    rank = F.struct(*plain, F.round("dist_m", 3).alias("c"), F.col("poi_id").alias("d"))
    pick = F.min(F.struct(rank.alias("rank"), "poi_id", "name", "category", "r_lat", "r_lon")).alias("m")
    place = near.groupBy("lat", "lon").agg(pick).select("lat", "lon", "m.*")
    best = targets.select("target_id", "lat", "lon").join(place, ["lat", "lon"]).groupBy("target_id").agg(F.min(F.struct("rank", "poi_id", "name", "category", "r_lat", "r_lon")).alias("m"))
    m = F.col("m")
    kind = F.when(m["category"] == "rest_area", "rest_area").when(m["category"].isin("overnight_facility", "cabin"), "hut").otherwise("amenity")
    name = F.when(m.isNull(), "Rest stop").when(m["name"] == "", F.concat(F.lit("Stop "), m["poi_id"].cast("string"))).otherwise(m["name"])
    return targets.join(best, "target_id", "left").select("target_id", m["poi_id"].alias("poi_id"), name.alias("name"), kind.alias("kind"), F.coalesce(m["r_lat"], "lat").alias("lat"), F.coalesce(m["r_lon"], "lon").alias("lon"))
