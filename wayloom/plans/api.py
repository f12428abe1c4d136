"""One-call facades: plan many routes or hikes at once, search places."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayloom.functions import energy, roads
from wayloom.operators import cards, hiking, planners, routing, search, sequences, spatial

search_places, nearby_places = search.search, search.nearby


def plan_routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, profile: str = "car", pad_deg: float = 0.35, daily_hours: float = 8.0, **options) -> DataFrame:
    """One result row a request (req_id, a_lat, a_lon, b_lat, b_lon).

    Snaps both ends to linked nodes, clips the edges to the padded box, finds
    the cheapest path and sums it up.  status is ok, snap_too_far or no_path.
    """
    linked = nodes.join(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct(), "id", "left_semi").select(F.col("id").alias("node"), "lat", "lon")
    ends = requests.select("req_id", F.explode(F.array(F.struct(F.lit("start").alias("end"), F.col("a_lat").alias("lat"), F.col("a_lon").alias("lon")), F.struct(F.lit("goal").alias("end"), F.col("b_lat").alias("lat"), F.col("b_lon").alias("lon")))).alias("e")).select(F.concat_ws(":", "req_id", "e.end").alias("end_id"), "req_id", "e.*")
    snap = spatial.knn(ends, linked, 1, 10_000.0, "end_id", "node")
    budget = routing.SNAP_M[profile]
    both = snap.groupBy("req_id").pivot("end", ["start", "goal"]).agg(F.first(F.struct("node", "dist_m")))
    ok = both.where((F.col("start.dist_m") <= budget) & (F.col("goal.dist_m") <= budget)).select("req_id", F.col("start.node").alias("start"), F.col("goal.node").alias("goal"))
    box = requests.join(ok.select("req_id"), "req_id", "left_semi").select(
        "req_id", (F.least("a_lat", "b_lat") - pad_deg).alias("min_lat"), (F.greatest("a_lat", "b_lat") + pad_deg).alias("max_lat"), (F.least("a_lon", "b_lon") - pad_deg).alias("min_lon"), (F.greatest("a_lon", "b_lon") + pad_deg).alias("max_lon"))
    size = max(pad_deg, 0.1)
    cells = spatial.box_cells(box, size, "min_lat", "min_lon", "max_lat", "max_lon")
    place = nodes.withColumns({"_row": F.floor(F.col("lat") / size), "_col": F.floor(F.col("lon") / size)})
    inside = place.join(cells, ["_row", "_col"]).where(F.col("lat").between(F.col("min_lat"), F.col("max_lat")) & F.col("lon").between(F.col("min_lon"), F.col("max_lon"))).select("req_id", F.col("id").alias("src"))
    own = edges.where(routing.allowed(**options)).join(inside, "src")
    path = routing.shortest_paths(ok, own)
    full = path.join(edges.select("edge_idx", "src", "dst", "length_m", "highway", "maxspeed_kmh"), ["edge_idx", "src", "dst"])
    speed = roads.edge_speed_kmh(F.col("maxspeed_kmh"), F.col("highway"))
    motorway = F.sum(F.when(roads.is_motorway(F.col("highway")), F.col("length_m")).otherwise(0.0)) / F.sum("length_m") * 100
    total = full.groupBy("req_id").agg(F.sum("length_m").alias("length_m"), (F.sum(energy.segment_hours(F.col("length_m"), speed)) * 60).alias("minutes"), motorway.alias("motorway_pct"), F.max("cost").alias("cost"), F.sum(energy.flat_energy_j(F.col("length_m"), energy.PROFILES.get(profile, energy.Eco()))).alias("energy_j"))
    days = planners.motor_days(total.select("req_id", (F.col("minutes") / 60).alias("hours"), (F.col("length_m") / 1000).alias("km")), cap_hours=daily_hours)
    status = F.when(F.col("start").isNull(), "snap_too_far").when(F.col("length_m").isNull(), "no_path").otherwise("ok")
    return requests.select("req_id").join(ok, "req_id", "left").join(total, "req_id", "left").join(cards.day_cards(days), "req_id", "left").withColumn("status", status)


def plan_hikes(coords: DataFrame, huts: DataFrame, most_km: float = 40.0) -> DataFrame:
    """Days with huts for paths (req_id, pos, lat, lon)."""
    return hiking.plan_hikes(sequences.cumulative_m(coords), huts, most_km)
