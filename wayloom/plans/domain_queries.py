"""Profiles, stops, energy, wetlands and histories over the test tables."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from wayloom.functions import profiles as P, texts as T
from wayloom.operators import paths as A, planners, spatial as X
from wayloom.plans import views as V
from wayloom.plans.planner_queries import TRIPS, TRUCK, _trips
from wayloom.plans.registry import register
from wayloom.plans.relational_queries import RINGS
from wayloom.plans.views import hav_sql, table

R = lambda c, n=6: F.round(c, n)
_list = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
PROFILE = "['" + "', '".join(P.PROFILES) + "'][p_partkey % 10 + 1]"


@register("profile_flags", f"""WITH p AS (SELECT p_partkey AS id, {PROFILE} AS profile, p_size::DOUBLE - 10 AS wish FROM part) SELECT id, profile, profile IN ('hiking', 'cycling', 'cycling_electric') AS eco_default,
 profile NOT IN ('hiking', 'cycling', 'cycling_electric') AS eco_toggle, profile NOT LIKE '%electric' OR profile = 'cycling_electric' AS menu_focus, profile NOT IN ('hiking', 'cycling', 'cycling_electric') AS toll_ferry_avoid,
 profile IN ('truck', 'truck_electric', 'mobile_home') AS clearance_limits, profile LIKE 'truck%' AS truck_rest, profile NOT LIKE 'truck%' AND profile <> 'hiking' AS motor_days,
 CASE WHEN profile NOT LIKE 'truck%' AND profile <> 'hiking' AND profile NOT LIKE 'cycling%' THEN CASE WHEN wish > 0 THEN wish ELSE 8 END END::DOUBLE AS budget_hours, CASE WHEN profile LIKE 'cycling%' THEN CASE WHEN wish * 5 > 0 THEN wish * 5 ELSE 100 END END::DOUBLE AS budget_km FROM p""")
def profile_flags(spark, d):
    p = F.element_at(F.array(*map(F.lit, P.PROFILES)), (F.col("p_partkey") % 10).cast("int") + 1)
    wish = F.col("p_size").cast("double") - 10
    t = table(spark, d, "part").select(F.col("p_partkey").alias("id"), p.alias("profile"), wish.alias("wish"))
    budget = P.daily_budget(F.col("profile"), F.col("wish"), F.col("wish") * 5)
    return t.select("id", "profile", *(c.alias(n) for n, c in P.flags(F.col("profile")).items()), budget["hours"].alias("budget_hours"), budget["km"].alias("budget_km"))


@register("named_huts", """SELECT p_partkey AS id, p_size % 3 <> 2 AND trim(n) <> '' AND NOT regexp_full_match(trim(n), 'Hut [0-9]*') AS named FROM (SELECT *, CASE p_partkey % 4 WHEN 0 THEN 'Hut ' || p_partkey WHEN 1 THEN ' ' WHEN 2 THEN 'Hut ' || p_name ELSE p_name END AS n FROM part)""")
def named_huts(spark, d):
    k = F.col("p_partkey") % 4
    name = F.when(k == 0, F.concat(F.lit("Hut "), F.col("p_partkey").cast("string"))).when(k == 1, " ").when(k == 2, F.concat(F.lit("Hut "), F.col("p_name"))).otherwise(F.col("p_name"))
    kind = F.element_at(F.array(F.lit("hut"), F.lit("network_hut"), F.lit("tent")), (F.col("p_size") % 3).cast("int") + 1)
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), P.named_hut(kind, name).alias("named"))


@register("small_rules", """SELECT o_orderkey AS id, o_orderkey % 3 = 0 AND (o_custkey * 1000) // 86400 >= 7 AS reminder, greatest(o_custkey * 3.0, o_totalprice * 0.15)::DOUBLE AS via_m, least(100000, greatest(500, o_totalprice - 1000))::DOUBLE AS radius_m,
 CASE WHEN o_orderkey % 2 = 0 THEN '15,30' ELSE '45' END AS parts FROM orders""")
def small_rules(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    return table(spark, d, "orders").select(
        k.alias("id"), P.reminder_due(k % 3 == 0, F.lit(0), F.col("o_custkey") * 1000).alias("reminder"), P.via_allowance_m(p, F.col("o_custkey") * 3.0).alias("via_m"),
        P.sane_radius_m(p - 1000).alias("radius_m"), F.array_join(P.truck_break_parts(k % 2 == 0).cast("array<string>"), ",").alias("parts"))


BOXES = ", ".join(f"('{k}', {v[0]}::DOUBLE, {v[1]}::DOUBLE, {v[2]}::DOUBLE, {v[3]}::DOUBLE)" for k, v in P.COUNTRY_BOXES.items())


@register("country_boxes", f"""WITH b(code, south, west, north, east) AS (VALUES {BOXES}), c AS (SELECT id, lat, lon, ['NO', 'se', 'De', 'xx'][id % 4 + 1] AS code FROM ({V.NODES}))
 SELECT id, south, east, coalesce(lat BETWEEN south AND north AND lon BETWEEN west AND east, false) AS inside FROM c LEFT JOIN b ON lower(c.code) = b.code""")
def country_boxes(spark, d):
    code = F.element_at(F.array(*map(F.lit, ("NO", "se", "De", "xx"))), (F.col("id") % 4).cast("int") + 1)
    n = V.nodes(spark, d).withColumn("box", P.country_box(code))
    inside = F.col("lat").between(F.col("box.south"), F.col("box.north")) & F.col("lon").between(F.col("box.west"), F.col("box.east"))
    return n.select("id", "box.south", "box.east", F.coalesce(inside, F.lit(False)).alias("inside"))


H = hav_sql("p.lat", "p.lon", "q.lat", "q.lon", 6371008.8)


@register("road_links", f"SELECT p.poi_id, min({H}) <= 1000 AS linked FROM ({V.POIS}) p CROSS JOIN (SELECT DISTINCT lat, lon FROM ({V.PATH})) q GROUP BY p.poi_id")
def road_links(spark, d):
    """Whether a path's vertex is within 1000 m of each place."""
    p = V.pois(spark, d).select("poi_id", "lat", "lon")
    near = X.radius_join(p, V.path(spark, d).select("lat", "lon").distinct(), 1000.0).select("poi_id").distinct().withColumn("linked", F.lit(True))
    return p.select("poi_id").join(near, "poi_id", "left").select("poi_id", F.coalesce("linked", F.lit(False)).alias("linked"))


BUILDINGS = f"SELECT lat + (poi_id % 9)::DOUBLE * 0.0005 AS lat, lon FROM ({V.POIS}) WHERE poi_id % 3 = 0"
GLACIERS = f"SELECT lat + (poi_id % 13)::DOUBLE * 0.002 AS lat, lon FROM ({V.POIS}) WHERE poi_id % 2 = 0"


@register("overnight_safety", f"""WITH c AS (SELECT * FROM ({V.POIS}) WHERE category IN ('cabin', 'network_hut', 'overnight_facility', 'tent_site')), b AS ({BUILDINGS}), g AS ({GLACIERS})
 SELECT poi_id, CASE WHEN EXISTS (SELECT 1 FROM b WHERE {hav_sql('c.lat', 'c.lon', 'b.lat', 'b.lon', 6371008.8)} < 150) THEN 'building' WHEN category = 'tent_site' AND EXISTS (SELECT 1 FROM g WHERE {hav_sql('c.lat', 'c.lon', 'g.lat', 'g.lon', 6371008.8)} < 1000) THEN 'glacier' END AS reject FROM c""")
def overnight_safety(spark, d):
    p = V.pois(spark, d)
    moved = lambda keep, m, step: p.where(keep).select((F.col("lat") + (F.col("poi_id") % m).cast("double") * step).alias("lat"), "lon")
    c = p.where(F.col("category").isin("cabin", "network_hut", "overnight_facility", "tent_site")).withColumn("established", F.col("category") != "tent_site")
    return A.overnight_safety(c, moved("poi_id % 3 = 0", 9, 0.0005), moved("poi_id % 2 = 0", 13, 0.002))


CAND = "SELECT l_orderkey % 300 AS req_id, l_orderkey * 10 + l_linenumber AS cand_id, l_quantity * 20 AS along_km, ['lodging', 'camping', 'rest_area'][l_linenumber % 3 + 1] AS kind FROM " + V.LINES + " WHERE l_partkey % 40 = 0"


@register("motor_overnights", f"""WITH c AS ({CAND}), t AS (SELECT DISTINCT o_orderkey % 300 AS req_id, unnest([100, 400, 700, 5000])::DOUBLE AS target_km FROM orders), s AS (SELECT t.req_id, target_km, cand_id, kind, round(abs(along_km - target_km) + CASE kind WHEN 'lodging' THEN 0 WHEN 'camping' THEN 5 ELSE 10 END, 6) AS score FROM t JOIN c ON t.req_id = c.req_id AND abs(along_km - target_km) <= 25),
 b AS (SELECT req_id, target_km, arg_min(cand_id, (score, cand_id)) AS cand_id, arg_min(kind, (score, cand_id)) AS kind FROM s GROUP BY ALL) SELECT t.req_id, t.target_km, b.cand_id, coalesce(b.kind, 'none') AS kind FROM t LEFT JOIN b ON t.req_id = b.req_id AND t.target_km = b.target_km""")
def motor_overnights(spark, d):
    n = F.col("l_linenumber")
    kind = F.element_at(F.array(F.lit("lodging"), F.lit("camping"), F.lit("rest_area")), (n % 3).cast("int") + 1)
    c = V.lines(spark, d).where("l_partkey % 40 = 0").select((F.col("l_orderkey") % 300).alias("req_id"), (F.col("l_orderkey") * 10 + n).alias("cand_id"), (F.col("l_quantity") * 20).alias("along_km"), kind.alias("kind"))
    t = table(spark, d, "orders").select((F.col("o_orderkey") % 300).alias("req_id")).distinct().withColumn("target_km", F.explode(F.array(*map(F.lit, (100.0, 400.0, 700.0, 5000.0)))))
    return A.overnight_stops(t, c)


LEGS = f"SELECT *, {hav_sql('lat', 'lon', 'n_lat', 'n_lon')} AS leg_m FROM (SELECT *, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon FROM ({V.PATH}) WINDOW w AS (PARTITION BY req_id ORDER BY pos)) WHERE n_lat IS NOT NULL"


@register("path_minutes", f"SELECT req_id, round(sum(CASE WHEN pos % 2 = 0 THEN qty * 100 / 1000 / greatest(pos * 10 + 20, 1) ELSE leg_m / 1000 / 50 END) * 60, 6) AS minutes FROM ({LEGS}) GROUP BY req_id")
def path_minutes(spark, d):
    even = F.col("pos") % 2 == 0  # the other legs have no edge
    legs = A.legs(V.path(spark, d)).withColumns({"length_m": F.when(even, F.col("qty") * 100), "speed_kmh": F.when(even, F.col("pos") * 10.0 + 20)})
    return A.minutes(legs).select("req_id", R(F.col("minutes")).alias("minutes"))


EDGE = f"SELECT src % 500 AS req_id, edge_idx AS pos, length_m, CASE WHEN edge_idx % 17 <> 0 THEN (edge_idx % 41 - 20)::DOUBLE END AS climb FROM ({V.EDGES})"
FLAT = "((0.015::DOUBLE * 1500 * 9.80665::DOUBLE + 0.5::DOUBLE * 1.225::DOUBLE * 0.32::DOUBLE * 2.2::DOUBLE * 625) * length_m)"


def _edge_path(spark, d):
    climb = F.when(F.col("edge_idx") % 17 != 0, (F.col("edge_idx") % 41 - 20).cast("double"))
    return V.edges(spark, d).select((F.col("src") % 500).alias("req_id"), F.col("edge_idx").alias("pos"), "length_m", climb.alias("climb"))


@register("path_energy", f"""WITH e AS (SELECT req_id, coalesce(climb, 0) AS dh, greatest({FLAT} + 1500 * 9.80665::DOUBLE * CASE WHEN coalesce(climb, 0) >= 0 THEN coalesce(climb, 0) ELSE climb * 0.4::DOUBLE END, {FLAT} * 0.01::DOUBLE) AS j FROM ({EDGE}))
 SELECT req_id, round(sum(greatest(dh, 0)), 3) AS climb_m, round(sum(greatest(-dh, 0)), 3) AS descent_m, round(coalesce(sum(j) FILTER (dh >= 0), 0) / 1000000, 3) AS uphill_mj, round(coalesce(sum(j) FILTER (dh < 0), 0) / 1000000, 3) AS downhill_mj,
 round(sum(greatest(-dh, 0)) * 0.4::DOUBLE * 1500 * 9.80665::DOUBLE / 1000000, 3) AS regen_mj, round(sum(j) / 1000000, 3) AS net_mj FROM e GROUP BY req_id""")
def path_energy(spark, d):
    from wayloom.functions.energy import Eco

    b = A.energy_breakdown(_edge_path(spark, d), eco=Eco(regen=0.4))
    return b.select("req_id", R(F.col("climb_m"), 3).alias("climb_m"), R(F.col("descent_m"), 3).alias("descent_m"), *(R(F.col(f"{c}_j") / 1_000_000, 3).alias(f"{c}_mj") for c in ("uphill", "downhill", "regen", "net")))


@register("steep_parts", f"SELECT req_id, pos, round(along_m, 3) AS along_m, round(climb / length_m * 100, 6) AS grade_pct FROM (SELECT *, sum(length_m) OVER (PARTITION BY req_id ORDER BY pos ROWS UNBOUNDED PRECEDING) - length_m AS along_m FROM ({EDGE})) WHERE climb > 0 AND length_m >= 15 AND climb / length_m > 0.01 + 1e-9")
def steep_parts(spark, d):
    s = A.steep(_edge_path(spark, d), 0.01)
    return s.select("req_id", "pos", R(F.col("along_m"), 3).alias("along_m"), R(F.col("grade_pct")).alias("grade_pct"))


@register("polyline_km", f"""WITH p AS (SELECT req_id, pos, row_number() OVER (PARTITION BY req_id ORDER BY pos) AS n, round(lat, 4) AS lat, round(lon, 4) AS lon FROM ({V.PATH})), s AS (SELECT *, coalesce({hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon', 6371000.0)}, 0) / 1000 AS step FROM p WINDOW w AS (PARTITION BY req_id ORDER BY n))
 SELECT req_id, (n - 1)::INTEGER AS pos, round(sum(step) OVER (PARTITION BY req_id ORDER BY n ROWS UNBOUNDED PRECEDING), 4) AS km FROM s""")
def polyline_km(spark, d):
    point = F.struct("pos", F.concat_ws(",", R(F.col("lon"), 4).cast("string"), R(F.col("lat"), 4).cast("string")).alias("x"))
    lines = V.path(spark, d).groupBy("req_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(point)), lambda p: p["x"]), ";").alias("polyline"))
    return A.polyline_km(lines).select("req_id", "pos", R(F.col("km"), 4).alias("km"))


@register("first_named", "SELECT p_size AS key, arg_min(p_partkey, (n = '', p_partkey)) AS p_partkey FROM (SELECT *, CASE WHEN p_partkey % 3 <> 0 THEN ' ' ELSE p_name END AS m, trim(m) AS n FROM part) GROUP BY p_size")
def first_named(spark, d):
    p = table(spark, d, "part").select(F.col("p_size").alias("key"), "p_partkey", F.when(F.col("p_partkey") % 3 != 0, " ").otherwise(F.col("p_name")).alias("name"))
    return A.first_named(p, "key", "p_partkey").select("key", "p_partkey")


UV = f"SELECT poi_id, poi_id % 40 AS req_id, 'Place ' || (poi_id % 97) AS name, lat, lon, (poi_id % 53)::DOUBLE AS km FROM ({V.POIS})"


@register("merged_vias", f"""WITH v AS ({UV}), u AS (SELECT * FROM v WHERE poi_id % 3 = 0), a AS (SELECT * FROM v WHERE poi_id % 3 <> 0),
 n AS (SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM u WHERE u.req_id = a.req_id AND (u.name = a.name OR {hav_sql('a.lat', 'a.lon', 'u.lat', 'u.lon', 6371008.8)} < 500))),
 b AS (SELECT *, false AS auto FROM u UNION ALL SELECT *, true FROM n) SELECT req_id, row_number() OVER (PARTITION BY req_id ORDER BY km, name, auto)::INTEGER AS pos, name, auto, km FROM b""")
def merged_vias(spark, d):
    k = F.col("poi_id")
    v = V.pois(spark, d).select(k, (k % 40).alias("req_id"), F.concat(F.lit("Place "), (k % 97).cast("string")).alias("name"), "lat", "lon", (k % 53).cast("double").alias("km"))
    shout = v.where("poi_id % 3 <> 0").withColumn("name", F.upper("name"))
    m = A.merged_vias(v.where("poi_id % 3 = 0"), shout)
    return m.select("req_id", "pos", F.when(F.col("auto"), F.initcap("name")).otherwise(F.col("name")).alias("name"), "auto", "km")


@register("recorded_hours", f"""WITH n AS (SELECT driver, day, 2::DOUBLE AS hours FROM (SELECT driver, max(day) AS day FROM ({V.DUTY}) WHERE driver % 2 = 0 GROUP BY driver)), b AS (SELECT driver, day, sum(hours) AS hours FROM (FROM ({V.DUTY}) UNION ALL FROM n) GROUP BY ALL)
 SELECT b.driver, b.day, b.hours FROM b LEFT JOIN n USING (driver) WHERE n.day IS NULL OR b.day >= n.day - 21""")
def recorded_hours(spark, d):
    h = V.duty(spark, d)
    return A.record_hours(h, h.where("driver % 2 = 0").groupBy("driver").agg(F.max("day").alias("day")).withColumn("hours", F.lit(2.0)))


WET = f"""WITH e AS MATERIALIZED (SELECT ring_id, lon AS ax, lat AS ay, coalesce(lag(lon) OVER w, last_value(lon) OVER v) AS bx, coalesce(lag(lat) OVER w, last_value(lat) OVER v) AS by_ FROM ({RINGS}) WINDOW w AS (PARTITION BY ring_id ORDER BY pos), v AS (PARTITION BY ring_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 s AS (SELECT poi_id AS edge_idx, lat + ((lat + 0.01) - lat) * 0.5::DOUBLE AS lat, lon + (lon - lon) * 0.5::DOUBLE AS lon, size::DOUBLE AS weight, poi_id % 5 = 0 AS boardwalk FROM ({V.POIS})),
 h AS (SELECT edge_idx, ring_id FROM s JOIN e ON lat >= least(ay, by_) AND lat <= greatest(ay, by_) WHERE (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax GROUP BY edge_idx, ring_id HAVING count(*) % 2 = 1),
 c AS (SELECT edge_idx, bool_or(ring_id % 2 = 0) AS hard FROM h GROUP BY edge_idx), x AS (SELECT s.*, CASE WHEN hard IS NULL THEN 'none' WHEN NOT hard THEN 'soft' WHEN boardwalk THEN 'boardwalk' ELSE 'blocked' END AS effect FROM s LEFT JOIN c USING (edge_idx))"""


def _wet_edges(spark, d):
    p = V.path(spark, d).groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).where("size(p) >= 3")
    near = lambda x, c: (F.col("p")[0][c] + (x[c] - F.col("p")[0][c]) / 20).alias(c)
    rings = p.select(F.col("req_id").alias("ring_id"), F.transform("p", lambda x: F.struct(near(x, "lon"), near(x, "lat"))).alias("ring"), (F.col("req_id") % 2 == 0).alias("hard"))
    k = V.pois(spark, d)
    edges = k.select(F.col("poi_id").alias("edge_idx"), "lat", "lon", (F.col("lat") + 0.01).alias("n_lat"), F.col("lon").alias("n_lon"), F.col("size").cast("double").alias("weight"), (F.col("poi_id") % 5 == 0).alias("boardwalk"))
    return A.wetland_edges(edges, rings, 0.1)


@register("wetland_edges", WET + " SELECT edge_idx, effect, CASE effect WHEN 'soft' THEN weight * 5 WHEN 'blocked' THEN NULL ELSE weight END AS weight FROM x")
def wetland_edges(spark, d):
    return _wet_edges(spark, d)


@register("wetland_stats", WET + " SELECT effect, count(*) AS n FROM x GROUP BY effect")
def wetland_stats(spark, d):
    return _wet_edges(spark, d).groupBy("effect").agg(F.count("*").alias("n"))


@register("route_progress", f"""WITH s AS (SELECT req_id, pos, qty * 40 / 1000 / greatest(pos * 10 + 20, 1) AS h FROM ({V.PATH})), e AS (SELECT *, sum(h) OVER (PARTITION BY req_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS x, sum(h) OVER (PARTITION BY req_id) AS a FROM s) SELECT req_id, pos, round(x, 6) AS elapsed_hours, round((a - x) * 60, 4) + 0.0 AS remaining_minutes FROM e""")
def route_progress(spark, d):
    s = V.path(spark, d).withColumns({"step_m": F.col("qty") * 40, "speed_kmh": F.col("pos") * 10.0 + 20})
    return A.progress(s).select("req_id", "pos", R(F.col("elapsed_hours")).alias("elapsed_hours"), (R(F.col("remaining_minutes"), 4) + 0.0).alias("remaining_minutes"))


@register("node_extent", f"SELECT min(lat) AS south, min(lon) AS west, max(lat) AS north, max(lon) AS east FROM ({V.NODES})")
def node_extent(spark, d):
    return A.extent(V.nodes(spark, d))


@register("update_urls", "SELECT o_orderkey AS id, 'https://download.geofabrik.de/europe/r' || o_custkey || '-latest.osm.pbf' AS latest, format('https://download.geofabrik.de/europe/r{}-updates/{:03d}/{:03d}/{:03d}.osc.gz', o_custkey, (o_orderkey * 977) // 1000000, (o_orderkey * 977 // 1000) % 1000, (o_orderkey * 977) % 1000) AS diff FROM orders")
def update_urls(spark, d):
    region = F.concat(F.lit("europe/r"), F.col("o_custkey").cast("string"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), T.latest_url(region).alias("latest"), T.diff_url(region, F.col("o_orderkey") * 977).alias("diff"))


@register("update_states", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 4 < 2 THEN o_orderkey END AS sequence, CASE o_orderkey % 4 WHEN 0 THEN '2024-01-15T01:02:03Z' WHEN 1 THEN 't' END AS timestamp FROM orders")
def update_states(spark, d):
    k = F.col("o_orderkey").cast("string")
    text = F.element_at(F.array(F.concat(F.lit("#x\ntimestamp=2024-01-15T01\\:02\\:03Z\n sequenceNumber= "), k), F.concat(F.lit("sequenceNumber=1\nsequenceNumber="), k, F.lit("\ntimestamp=t")), F.lit("timestamp=t"), F.lit("sequenceNumber=x\ntimestamp=t")), (F.col("o_orderkey") % 4).cast("int") + 1)
    s = T.update_state(text)
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), s["sequence"].alias("sequence"), s["timestamp"].alias("timestamp"))


@register("place_documents", """WITH p AS (SELECT p_partkey AS id, p_name || CASE p_partkey % 3 WHEN 0 THEN ' "x"' WHEN 1 THEN ' \\y' ELSE '' END AS name, p_partkey % 90 AS lat FROM part)
 SELECT id, '{"name":"' || replace(replace(name, '\\', '\\\\'), '"', '\\"') || '","lat":' || CASE WHEN id % 2 = 0 THEN lat::VARCHAR ELSE (lat::DOUBLE + 0.5)::VARCHAR END || ',"lon":10,"kind":"hut"}' AS doc, id % 4 >= 2 AS usable FROM p""")
def place_documents(spark, d):
    k = F.col("p_partkey")
    name = F.concat(F.col("p_name"), F.when(k % 3 == 0, ' "x"').when(k % 3 == 1, " \\y").otherwise(""))
    doc = T.place_json(name, (k % 90).cast("double") + F.when(k % 2 == 0, 0.0).otherwise(0.5), F.lit(10.0), F.lit("hut"))
    p = table(spark, d, "part").select(k.alias("id"), doc.alias("doc"))
    # lists of none to three of the document: two and more are usable
    many = F.concat(F.lit("["), F.array_join(F.array_repeat("doc", (F.col("id") % 4).cast("int")), ","), F.lit("]"))
    return p.select("id", "doc", T.waypoints(many).isNotNull().alias("usable"))


@register("break_rules", f"""WITH p AS (SELECT p_partkey AS id, {PROFILE} AS profile, p_partkey % 2 = 0 AS main, {V._sql_pick(V.CATEGORY, 'p_partkey % 11')} AS category FROM part)
 SELECT id, CASE WHEN profile = 'hiking' THEN CASE WHEN main THEN 11.295 ELSE 2.275 END WHEN profile LIKE 'cycling%' THEN CASE WHEN main THEN 28.24 ELSE 5.69 END END::DOUBLE AS next_km, CASE WHEN profile = 'hiking' THEN 40 WHEN profile LIKE 'cycling%' THEN 100 END::DOUBLE AS day_km,
 CASE WHEN category IN ('rest_area', 'lodging') THEN 20000 WHEN category = 'water' THEN 2000 WHEN category IN ('cabin', 'overnight_facility', 'tent_site') THEN 5000 WHEN category = 'network_hut' THEN 25000 WHEN category = 'restroom' THEN 3000 ELSE 15000 END::DOUBLE AS radius_m FROM p""")
def break_rules(spark, d):
    k = F.col("p_partkey")
    profile = F.element_at(F.array(*map(F.lit, P.PROFILES)), (k % 10).cast("int") + 1)
    radii = {"water": 2000.0, "cabin": 5000.0, "general": 15_000.0, "network_hut": 25_000.0, "restroom": 3000.0}
    return table(spark, d, "part").select(
        k.alias("id"), T.break_distance_km(profile, k % 2 == 0).alias("next_km"), T.day_distance_km(profile).alias("day_km"), T.category_radius_m(V._pick(V.CATEGORY, k % 11), radii).alias("radius_m"))


@register("car_ranges", "WITH o AS (SELECT o_orderkey AS id, o_totalprice * 1000 AS j, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE (o_orderkey % 50)::DOUBLE END AS kwh FROM orders), w AS (SELECT id, j / 0.85::DOUBLE / 3600 AS draw, CASE WHEN kwh > 0 THEN kwh ELSE 60 END * 1000 AS wh FROM o) SELECT id, wh::DOUBLE AS capacity_wh, round(draw, 4) AS draw_wh, round(draw / wh * 100, 6) AS pct FROM w")
def car_ranges(spark, d):
    k = F.col("o_orderkey")
    r = T.car_range(F.col("o_totalprice") * 1000, F.when(k % 3 != 0, (k % 50).cast("double")))
    return table(spark, d, "orders").select(k.alias("id"), r["capacity_wh"].alias("capacity_wh"), R(r["draw_wh"], 4).alias("draw_wh"), R(r["pct"]).alias("pct"))


@register("open_debts", f"""WITH RECURSIVE b AS (SELECT driver, day, 1 AS debt, 0::DOUBLE AS rest FROM ({V.DUTY}) WHERE hours >= 5 UNION ALL SELECT driver, day, 0, 24 + hours * 4 FROM ({V.DUTY})), e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY driver ORDER BY day, debt) AS n FROM b),
 w AS (SELECT driver, n, CASE WHEN debt = 1 THEN [day] ELSE []::DATE[] END AS owed FROM e WHERE n = 1 UNION ALL SELECT e.driver, e.n, CASE WHEN debt = 1 THEN list_append(owed, day) WHEN rest >= 30 AND len(owed) > 0 THEN owed[2:] ELSE owed END FROM w JOIN e ON e.driver = w.driver AND e.n = w.n + 1),
 l AS (SELECT driver, arg_max(owed, n) AS owed FROM w GROUP BY driver) SELECT driver, i::INTEGER AS pos, owed[i] AS reduced_on FROM (SELECT *, unnest(range(1, len(owed) + 1)) AS i FROM l)""")
def open_debts(spark, d):
    from wayloom.operators import cards

    rests = V.duty(spark, d).select("driver", "day", (F.lit(24.0) + F.col("hours") * 4).alias("hours"))
    return cards.outstanding(cards.settle(cards.new_debts(V.duty(spark, d).where("hours >= 5").select("driver", "day")), rests)).select("driver", "pos", "reduced_on")


@register("committed_plans", f"""WITH t AS (SELECT driver, max(req_id) AS req_id FROM ({TRIPS}) GROUP BY driver), n AS (SELECT t.driver, p.date AS day, p.driving_hours AS hours FROM t JOIN ({TRUCK}) p USING (req_id)), z AS (SELECT driver, max(day) AS last FROM n GROUP BY driver),
 b AS (SELECT driver, day, sum(hours) AS hours FROM (FROM ({V.DUTY}) UNION ALL FROM n) GROUP BY ALL) SELECT b.driver, b.day, round(b.hours, 6) AS hours FROM b JOIN z USING (driver) WHERE b.day >= z.last - 21""")
def committed_plans(spark, d):
    """Histories after each driver's last trip is planned and driven."""
    h, trips = V.duty(spark, d), _trips(spark, d)
    own = trips.join(trips.groupBy("driver").agg(F.max("req_id").alias("req_id")).select("req_id"), "req_id", "left_semi")
    plan = planners.plan_truck(own, h).join(own.select("req_id", "driver"), "req_id").select("driver", F.col("date").alias("day"), F.col("driving_hours").alias("hours"))
    return A.record_hours(h, plan).select("driver", "day", R(F.col("hours")).alias("hours"))


@register("job_tiles", """WITH j AS (SELECT s_suppkey AS job, (s_suppkey * 7 % 60)::DOUBLE + 0.25 AS south, (s_suppkey * 11 % 80)::DOUBLE - 40 AS west FROM supplier), y AS (SELECT *, unnest(range(floor(south)::BIGINT, floor(south + 1.5)::BIGINT + 1)) AS lat FROM j), t AS (SELECT *, unnest(range(floor(west)::BIGINT, floor(west + 2.2)::BIGINT + 1)) AS lon FROM y)
 SELECT job, CASE WHEN lat < 0 THEN 'S' ELSE 'N' END || lpad(abs(lat)::VARCHAR, 2, '0') || CASE WHEN lon < 0 THEN 'W' ELSE 'E' END || lpad(abs(lon)::VARCHAR, 3, '0') AS tile_id, 'pending' AS status FROM t""")
def job_tiles(spark, d):
    from wayloom.operators import stores

    k = F.col("s_suppkey")
    jobs = table(spark, d, "supplier").select(k.alias("job"), ((k * 7 % 60).cast("double") + 0.25).alias("south"), ((k * 11 % 80).cast("double") - 40).alias("west"))
    return stores.new_tiles(jobs.withColumns({"north": F.col("south") + 1.5, "east": F.col("west") + 2.2}), "job")


def _bearing(a_lat, a_lon, b_lat, b_lon):
    y = f"sin(radians({b_lon} - {a_lon})) * cos(radians({b_lat}))"
    x = f"cos(radians({a_lat})) * sin(radians({b_lat})) - sin(radians({a_lat})) * cos(radians({b_lat})) * cos(radians({b_lon} - {a_lon}))"
    return f"((degrees(atan2({y}, {x})) + 360) % 360)"


NODE = f"SELECT l_orderkey AS req_id, l_linenumber AS pos, l_partkey AS node, {V._sql_lat('l_partkey')} AS lat, {V._sql_lon('l_partkey')} AS lon, l_quantity AS qty FROM {V.LINES}"
WAYS = f"SELECT p_partkey AS node, (p_partkey * 7 + j * 13) % (SELECT count(*) FROM part) + 1 AS dest, j = 0 AND p_partkey % 2 = 0 AS is_ring FROM (SELECT *, unnest([0, 1, 2, 3]) AS j FROM part)"


@register("roundabout_exits", f"""WITH p AS (SELECT *, lag(node) OVER w AS p_node, lag(lat) OVER w AS p_lat, lag(lon) OVER w AS p_lon, lead(node) OVER w AS n_node FROM ({NODE}) WINDOW w AS (PARTITION BY req_id ORDER BY pos)),
 o AS (SELECT DISTINCT node AS o_node, dest, {V._sql_lat('dest')} AS to_lat, {V._sql_lon('dest')} AS to_lon FROM (SELECT node, dest FROM ({WAYS}) WHERE NOT is_ring UNION ALL SELECT node, n_node FROM p WHERE n_node IS NOT NULL)),
 s AS (SELECT req_id, min(pos) AS first, max(pos) AS last FROM (SELECT *, sum(CASE WHEN qty > 15 THEN 0 ELSE 1 END) OVER (PARTITION BY req_id ORDER BY pos) AS island FROM p) WHERE qty > 15 GROUP BY req_id, island),
 m AS (SELECT s.*, p.pos, p.n_node, o.dest, (({_bearing('lat', 'lon', 'to_lat', 'to_lon')} - {_bearing('p_lat', 'p_lon', 'lat', 'lon')} + 540) % 360) - 180 AS turn FROM s JOIN p ON p.req_id = s.req_id AND p.pos > s.first AND p.pos <= s.last JOIN o ON o.o_node = p.node AND o.dest <> p.p_node),
 r AS (SELECT *, row_number() OVER (PARTITION BY req_id, first, last, pos ORDER BY turn DESC, dest) AS nth, count(*) OVER (PARTITION BY req_id, first, last, pos) AS here FROM m),
 g AS (SELECT req_id, first, last, count(*) FILTER (pos < last) + coalesce(max(CASE WHEN pos = last AND dest = n_node THEN nth END), count(*) FILTER (pos = last)) AS n FROM r GROUP BY ALL)
 SELECT s.req_id, s.first, s.last, greatest(1, least(8, coalesce(g.n, 0)))::INTEGER AS exit FROM s LEFT JOIN g ON g.req_id = s.req_id AND g.first = s.first AND g.last = s.last""")
def roundabout_exits(spark, d):
    from wayloom.operators import sequences as Q

    k = F.col("l_partkey")
    path = V.lines(spark, d).select(F.col("l_orderkey").alias("req_id"), F.col("l_linenumber").alias("pos"), k.alias("node"), V._lat(k).alias("lat"), V._lon(k).alias("lon"), F.col("l_quantity").alias("qty"))
    n = table(spark, d, "part").agg(F.count("*").alias("n"))
    j = F.explode(F.array(*map(F.lit, range(4)))).alias("j")
    ways = table(spark, d, "part").select("p_partkey", j).crossJoin(F.broadcast(n)).select(F.col("p_partkey").alias("node"), ((F.col("p_partkey") * 7 + F.col("j") * 13) % F.col("n") + 1).alias("to"), ((F.col("j") == 0) & (F.col("p_partkey") % 2 == 0)).alias("is_ring"))
    nxt = path.select(F.col("req_id"), "pos", "node", F.lead("node").over(Window.partitionBy("req_id").orderBy("pos")).alias("to")).where("to is not null").select("node", "to", F.lit(False).alias("is_ring"))
    outs = ways.unionByName(nxt).withColumns({"to_lat": V._lat(F.col("to")), "to_lon": V._lon(F.col("to"))})
    return Q.roundabout_exits(path, outs, Q.runs(path, F.col("qty") > 15))


PLACE = f"SELECT poi_id, lat, lon, category, CASE WHEN poi_id % 3 = 0 THEN ' ' ELSE name END AS name FROM ({V.POIS})"


@register("motor_pauses", f"""WITH p AS (SELECT * FROM ({PLACE}) p WHERE category IN ('rest_area', 'general', 'restroom', 'overnight_facility', 'cabin') AND EXISTS (SELECT 1 FROM ({V.NODES}) q WHERE {H} <= 1000)),
 c AS (SELECT n.id AS target_id, p.*, round({hav_sql('n.lat', 'n.lon', 'p.lat', 'p.lon', 6371008.8)}, 3) AS d FROM ({V.NODES}) n JOIN p ON {hav_sql('n.lat', 'n.lon', 'p.lat', 'p.lon', 6371008.8)} <= 9000),
 b AS (SELECT target_id, arg_min(poi_id, (trim(name) = '', category <> 'rest_area', d, poi_id)) AS poi_id FROM c GROUP BY target_id)
 SELECT n.id AS target_id, b.poi_id, CASE WHEN b.poi_id IS NULL THEN 'Rest stop' WHEN trim(p.name) = '' THEN 'Stop ' || b.poi_id ELSE p.name END AS name, CASE WHEN p.category = 'rest_area' THEN 'rest_area' WHEN p.category IN ('overnight_facility', 'cabin') THEN 'hut' ELSE 'amenity' END AS kind, coalesce(p.lat, n.lat) AS lat, coalesce(p.lon, n.lon) AS lon
 FROM ({V.NODES}) n LEFT JOIN b ON b.target_id = n.id LEFT JOIN ({PLACE}) p ON p.poi_id = b.poi_id""")
def motor_pauses(spark, d):
    n = V.nodes(spark, d)
    p = V.pois(spark, d).withColumn("name", F.when(F.col("poi_id") % 3 == 0, " ").otherwise(F.col("name")))
    return A.motor_pauses(n.select(F.col("id").alias("target_id"), "lat", "lon"), p, n, 9000.0)
