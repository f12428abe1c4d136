"""Tags, boxes, tiles, heights, jobs and live positions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wayloom.functions import energy, geo, roads, tags as G
from wayloom.operators import cards, sequences as Q, stores
from wayloom.plans import views as V
from wayloom.plans.registry import register
from wayloom.plans.relational_queries import CUM2, RINGS
from wayloom.plans.views import hav_sql, table
from wayloom.sources import rasters
from wayloom.streaming import tracks

R = lambda c, n=6: F.round(c, n)
_in = lambda names: "(" + ", ".join(f"'{n}'" for n in names) + ")"
TYPE, ROUTE, NETWORK, NAME = ("Route", "route", "site"), ("hiking", "Foot", "bicycle", "pilgrimage", "bus"), ("nwn", "LWN", "ncn", "x"), ("Olavsleden west", "Old Road", "Camino X", "Service area")


def _relation(k):
    values = {"type": V._pick(TYPE, k % 3), "route": V._pick(ROUTE, k % 5), "network": V._pick(NETWORK, k % 4), "name": V._pick(NAME, F.floor(k / 3) % 4), "highway": V._pick(("services", "rest_area"), k % 2)}
    return F.map_from_arrays(F.array(*map(F.lit, values)), F.array(*values.values()))


REL = f"SELECT p_partkey AS id, {V._sql_pick(TYPE, 'p_partkey % 3')} AS type, {V._sql_pick(ROUTE, 'p_partkey % 5')} AS route, {V._sql_pick(NETWORK, 'p_partkey % 4')} AS network, {V._sql_pick(NAME, '(p_partkey // 3) % 4')} AS name, {V._sql_pick(('services', 'rest_area'), 'p_partkey % 2')} AS highway FROM part"


@register("route_relations", f"""SELECT id, lower(type) = 'route' AND lower(route) IN {_in(G.HIKING_ROUTES)} AND lower(network) IN {_in(G.HIKING_NETWORKS)} AS hiking, lower(type) = 'route' AND lower(route) IN {_in(G.CYCLING_ROUTES)} AND lower(network) IN {_in(G.CYCLING_NETWORKS)} AS cycling,
 lower(type) = 'route' AND (lower(route) = 'pilgrimage' OR lower(route) IN {_in(G.HIKING_ROUTES)} AND regexp_matches(lower(name), 'olavsleden|camino')) AS pilgrim, highway = 'services' OR contains(lower(name), 'service') AS weekly FROM ({REL})""")
def route_relations(spark, d):
    t = _relation(F.col("p_partkey"))
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("id"), G.official_route(t).alias("hiking"), G.official_route(t, "cycling").alias("cycling"), G.pilgrim_route(t).alias("pilgrim"), G.weekly_rest_suitable(t, F.lit("poi_x")).alias("weekly"))


@register("way_classes", f"""WITH e AS (SELECT p_partkey AS id, {V._sql_pick((*roads.CAR_HIGHWAYS, 'path', 'steps', 'corridor'), 'p_partkey % 20')} AS highway, CASE p_partkey % 4 WHEN 0 THEN ' Boardwalk' WHEN 1 THEN 'yes' END AS bridge, CASE p_partkey % 7 WHEN 0 THEN 'WOOD ' ELSE 'mud' END AS surface FROM part)
 SELECT id, highway NOT IN ('path', 'steps', 'corridor') AS car, coalesce(lower(trim(bridge)) = 'boardwalk', false) OR lower(trim(surface)) = 'wood' AS boardwalk FROM e""")
def way_classes(spark, d):
    k = F.col("p_partkey")
    highway = V._pick((*roads.CAR_HIGHWAYS, "path", "steps", "corridor"), k % 20)
    bridge, surface = F.when(k % 4 == 0, " Boardwalk").when(k % 4 == 1, "yes"), F.when(k % 7 == 0, "WOOD ").otherwise("mud")
    return table(spark, d, "part").select(k.alias("id"), highway.isin(*roads.CAR_HIGHWAYS).alias("car"), G.boardwalk(bridge, surface).alias("boardwalk"))


@register("named_features", """WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name END AS name, CASE WHEN p_partkey % 3 = 0 THEN 'Road ' || p_size END AS street, CASE WHEN p_partkey % 6 < 4 THEN p_size::VARCHAR END AS number, CASE p_partkey % 5 WHEN 0 THEN 'place:town' WHEN 1 THEN 'natural:peak' WHEN 2 THEN 'amenity:cafe' END AS kind FROM part)
 SELECT id, coalesce(name, street || ' ' || number, street) AS name, CASE WHEN coalesce(name, street) IS NOT NULL THEN coalesce(kind, CASE WHEN name IS NOT NULL THEN 'named' WHEN number IS NOT NULL THEN 'addr:housenumber' ELSE 'addr:street' END) END AS kind FROM t""")
def named_features(spark, d):
    k = F.col("p_partkey")
    pair = lambda on, key, value: F.when(on, F.struct(F.lit(key).alias("k"), value.alias("v")))
    size = F.col("p_size").cast("string")
    t = F.array_compact(F.array(
        pair(k % 2 == 0, "name", F.col("p_name")), pair(k % 3 == 0, "addr:street", F.concat(F.lit("Road "), size)), pair(k % 6 < 4, "addr:housenumber", size), pair(k % 5 == 2, "highway", F.lit("service")),
        pair(k % 5 == 0, "place", F.lit("town")), pair(k % 5 == 1, "natural", F.lit("peak")), pair(k % 5 == 2, "amenity", F.lit("cafe")), pair(k % 5 == 3, "natural", F.lit("wood"))))
    name, kind = G.named_feature(t)
    return table(spark, d, "part").select(k.alias("id"), name.alias("name"), kind.alias("kind"))


@register("box_points", f"SELECT id, lat BETWEEN 59 AND 60.5 AND lon BETWEEN 9 AND 12 AS inside FROM ({V.NODES})")
def box_points(spark, d):
    return V.nodes(spark, d).select("id", geo.in_bbox(F.col("lat"), F.col("lon"), (59.0, 9.0, 60.5, 12.0)).alias("inside"))


@register("jurisdictions", f"""WITH e AS (SELECT ring_id, lon AS ax, lat AS ay, coalesce(lag(lon) OVER w, last_value(lon) OVER v) AS bx, coalesce(lag(lat) OVER w, last_value(lat) OVER v) AS by_ FROM ({RINGS}) WINDOW w AS (PARTITION BY ring_id ORDER BY pos), v AS (PARTITION BY ring_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
 h AS (SELECT id, ring_id FROM ({V.NODES}) n JOIN e ON lat >= least(ay, by_) AND lat <= greatest(ay, by_) WHERE (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax GROUP BY id, ring_id HAVING count(*) % 2 = 1),
 f AS (SELECT id, ['no', 'us', 'gb'][min(ring_id) % 3 + 1] AS iso FROM h GROUP BY id) SELECT n.id, f.iso, CASE f.iso WHEN 'no' THEN 'ec561' WHEN 'us' THEN 'fmcsa' ELSE 'unknown' END AS pack FROM ({V.NODES}) n LEFT JOIN f USING (id)""")
def jurisdictions(spark, d):
    p = V.path(spark, d).groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).where("size(p) >= 3")
    near = lambda x, c: (F.col("p")[0][c] + (x[c] - F.col("p")[0][c]) / 20).alias(c)
    land = p.select(F.col("req_id").alias("ord"), V._pick(("no", "us", "gb"), F.col("req_id") % 3).alias("iso"), F.transform("p", lambda x: F.struct(near(x, "lon"), near(x, "lat"))).alias("ring"))
    return cards.jurisdiction(V.nodes(spark, d), land, "id")


@register("map_tiles", """WITH z AS (SELECT unnest(range(0, 11)) AS z), b AS (SELECT z, floor((10.2 + 180) / 360 * pow(2, z))::INTEGER AS x0, floor((11.9 + 180) / 360 * pow(2, z))::INTEGER AS x1, floor((1 - ln(tan(radians(61.1)) + 1 / cos(radians(61.1))) / 3.141592653589793) / 2 * pow(2, z))::INTEGER AS y0, floor((1 - ln(tan(radians(59.3)) + 1 / cos(radians(59.3))) / 3.141592653589793) / 2 * pow(2, z))::INTEGER AS y1 FROM z),
 c AS (SELECT z, y0, y1, unnest(range(x0, x1 + 1)) AS x FROM b) SELECT z::INTEGER AS z, x::INTEGER AS x, unnest(range(y0, y1 + 1))::INTEGER AS y FROM c""")
def map_tiles(spark, d):
    return rasters.tiles_of_bbox(spark, (59.3, 10.2, 61.1, 11.9), 10)


@register("height_tiles", "SELECT 'S' || lpad(y::VARCHAR, 2, '0') || 'W' || lpad(x::VARCHAR, 3, '0') AS tile FROM (SELECT unnest([2, 1]) AS y), (SELECT unnest([3, 2, 1]) AS x) UNION ALL SELECT 'N00W' || lpad(x::VARCHAR, 3, '0') FROM (SELECT unnest([3, 2, 1]) AS x)")
def height_tiles(spark, d):
    return rasters.dem_tiles_of_bbox(spark, (-1.5, -2.5, 0.5, -0.1))


N = 61  # cells a side of a made-up height tile
HEIGHT = "(y * 37 + x * 11 + r * 3 + c * 7) % 900"


@register("point_heights", f"""WITH p AS (SELECT id, floor(lat)::BIGINT AS y, floor(lon)::BIGINT AS x, round((1 - (lat - floor(lat))) * {N - 1})::BIGINT AS r, round((lon - floor(lon)) * {N - 1})::BIGINT AS c FROM ({V.NODES}))
 SELECT id, CASE WHEN y % 2 = 0 AND (r + c) % 50 <> 0 THEN {HEIGHT} END::DOUBLE AS h FROM p""")
def point_heights(spark, d):
    """Heights of nodes from tiles of which every second row of tiles is missing, with voids."""
    tile = spark.range(58, 62, 2).select(F.col("id").alias("y")).withColumn("x", F.explode(F.sequence(F.lit(8), F.lit(14))))
    cell = tile.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(N - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(N - 1))))
    h = F.when((F.col("r") + F.col("c")) % 50 != 0, F.expr(HEIGHT).cast("double"))
    cells = cell.select(geo.dem_stem(F.col("y").cast("double"), F.col("x").cast("double")).alias("tile"), F.lit(N).alias("size"), F.col("r").cast("int").alias("row"), F.col("c").cast("int").alias("col"), h.alias("h"))
    return rasters.sample_heights(V.nodes(spark, d), cells).select("id", "h")


@register("tile_sources", "SELECT 'N' || lpad((p_size)::VARCHAR, 2, '0') || 'E010' AS tile, arg_min('f' || p_partkey, (p_partkey % 4, p_partkey)) AS path FROM (SELECT *, row_number() OVER (PARTITION BY p_size, p_partkey % 4 ORDER BY p_partkey) AS n FROM part) WHERE p_partkey % 4 < 3 AND n = 1 GROUP BY p_size")
def tile_sources(spark, d):
    k = F.col("p_partkey")
    found = table(spark, d, "part").groupBy("p_size", (k % 4).alias("s")).agg(F.min("p_partkey").alias("k")).select(
        F.concat(F.lit("N"), F.lpad(F.col("p_size").cast("string"), 2, "0"), F.lit("E010")).alias("tile"), V._pick(("copernicus", "viewfinder", "srtm", "other"), F.col("s")).alias("source"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("path"))
    return rasters.best_source(found)


@register("live_energy", "SELECT o_orderkey AS id, round(CASE WHEN o_orderkey % 3 <> 0 AND o_totalprice > 0 THEN (o_orderkey % 3) * (o_totalprice / 1000 / greatest(o_custkey % 90, 1)) * 36000000 ELSE o_totalprice END, 3) AS joule, round((20 + o_custkey % 10) * 0.0254::DOUBLE / 2, 6) AS wheel_m FROM orders")
def live_energy(spark, d):
    k, p = F.col("o_orderkey"), F.col("o_totalprice")
    j = energy.live_energy_j(p, p, (k % 3).cast("double"), (F.col("o_custkey") % 90).cast("double"))
    return table(spark, d, "orders").select(k.alias("id"), R(j, 3).alias("joule"), R(energy.wheel_radius_m(20 + F.col("o_custkey") % 10)).alias("wheel_m"))


@register("roundabout_icons", """WITH a AS (SELECT o_orderkey AS id, (o_orderkey % 361 - 180)::DOUBLE AS d, (o_custkey % 200 - 100)::DOUBLE AS l FROM orders), n AS (SELECT *, 202 - CASE WHEN d < 0 THEN -floor(-d + 0.5) ELSE floor(d + 0.5) END AS n FROM a), s AS (SELECT *, greatest(1, least(8, CASE WHEN n < 0 THEN ceil(n / 45) ELSE floor(n / 45) END))::INTEGER AS s FROM n)
 SELECT id, CASE WHEN l < 20 THEN 'nav_roundabout_l' || CASE WHEN s = 8 THEN 8 ELSE 8 - s END ELSE 'nav_roundabout_r' || s END AS icon FROM s""")
def roundabout_icons(spark, d):
    k = F.col("o_orderkey")
    icon = geo.roundabout_icon((k % 361 - 180).cast("double"), (F.col("o_custkey") % 200 - 100).cast("double"), F.lit(20.0))
    return table(spark, d, "orders").select(k.alias("id"), icon.alias("icon"))


@register("avoidance_reports", "SELECT o_orderkey AS id, 'avoid: motorways, ferries; restricted edges on the reference path: ' || (o_orderkey % 40) || '; priority share ' || format('{:.1f}', (o_custkey % 97)::DOUBLE) || ' %' AS report FROM orders")
def avoidance_reports(spark, d):
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), cards.avoidance_report(F.col("o_orderkey") % 40, (F.col("o_custkey") % 97).cast("double"), True, False, True).alias("report"))


STATUS = ("pending", "downloading", "completed", "failed")


def _jobs(spark, d):
    k = F.col("o_orderkey")
    return table(spark, d, "orders").select((F.col("o_custkey") % 9).cast("string").alias("job_id"), F.concat(F.lit("t"), k.cast("string")).alias("tile_id"), V._pick(STATUS, k % 4).alias("status"), k)


@register("pending_tiles", "SELECT '3' AS job_id, 't' || o_orderkey AS tile_id, CASE o_orderkey % 4 WHEN 0 THEN 'pending' ELSE 'downloading' END AS status FROM orders WHERE o_custkey % 9 = 3 AND o_orderkey % 4 < 2")
def pending_tiles(spark, d):
    return stores.pending(_jobs(spark, d), "3").select("job_id", "tile_id", "status")


@register("covering_jobs", "SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 = 2 AND 60 BETWEEN 50 + o_orderkey % 15 AND 55 + o_orderkey % 15 AND 10 BETWEEN o_orderkey % 20 AND o_orderkey % 20 + 4")
def covering_jobs(spark, d):
    k = F.col("o_orderkey")
    j = _jobs(spark, d).withColumns({"min_lat": 50.0 + k % 15, "max_lat": 55.0 + k % 15, "min_lon": (k % 20).cast("double"), "max_lon": (k % 20 + 4).cast("double")})
    return stores.covering(j, 60.0, 10.0).select(k.alias("id"))


@register("stored_names", "SELECT o_custkey AS osm_id, arg_max('n' || o_orderkey, o_orderkey) AS name, max(o_orderkey) AS version FROM orders GROUP BY o_custkey")
def stored_names(spark, d):
    log = table(spark, d, "orders").select(F.col("o_custkey").alias("osm_id"), F.concat(F.lit("n"), F.col("o_orderkey").cast("string")).alias("name"), F.col("o_orderkey").alias("version"))
    return stores.current(log, ["osm_id"])


@register("stored_config", "SELECT 1000::DOUBLE + max(o_orderkey) FILTER (o_custkey % 5 = 1) AS mass, 0.32::DOUBLE AS cd FROM orders")
def stored_config(spark, d):
    log = table(spark, d, "orders").select(F.concat(F.lit("k"), (F.col("o_custkey") % 5).cast("string")).alias("key"), F.concat(F.lit('{"mass": '), (F.col("o_orderkey") + 1000).cast("string"), F.lit("}")).alias("value_json"), F.col("o_orderkey").alias("version"))
    return stores.load_config(log, "k1", "mass double, cd double", {"mass": 1500.0, "cd": 0.32})


A2 = "(2 * 6371000::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))".format(h="(pow(sin(radians(s_lat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(s_lat)) * pow(sin(radians(s_lon - lon) / 2), 2))")


@register("live_progress", f"""WITH f AS (SELECT req_id, req_id * 10 + pos AS event_id, pos::BIGINT AS t, lat + (pos % 3)::DOUBLE * 0.0004 AS lat, lon FROM ({V.PATH})), m AS (SELECT f.req_id, event_id, t, min((round({A2}, 3), cum_m)) AS m FROM f JOIN (SELECT req_id, lat AS s_lat, lon AS s_lon, cum_m FROM ({CUM2})) s USING (req_id) GROUP BY ALL),
 o AS (SELECT req_id, event_id, t, m[1] AS dist_m, m[1] > 50 AS off, m[2] AS cum FROM m) SELECT req_id, event_id, dist_m, off, round(last_value(CASE WHEN NOT off THEN cum END IGNORE NULLS) OVER (PARTITION BY req_id ORDER BY t, event_id ROWS UNBOUNDED PRECEDING), 2) AS along_m FROM o""")
def live_progress(spark, d):
    c = Q.cumulative_m(V.path(spark, d))
    fixes = c.select("req_id", (F.col("req_id") * 10 + F.col("pos")).alias("event_id"), F.col("pos").cast("long").alias("t"), (F.col("lat") + (F.col("pos") % 3).cast("double") * 0.0004).alias("lat"), "lon")
    return tracks.progress(fixes, c).withColumn("along_m", R(F.col("along_m"), 2))


@register("position_reports", f"SELECT lat, lon, coalesce(CASE WHEN event_id % 2 = 0 THEN speed END, 0) AS speed FROM ({V.FIXES}) WHERE event_id % 3 <> 0 AND event_id % 4 >= 2")
def position_reports(spark, d):
    e = F.col("event_id")
    report = F.to_json(F.struct(F.when(e % 3 == 0, "SKY").otherwise("TPV").alias("class"), (e % 4).alias("mode"), "lat", "lon", F.when(e % 2 == 0, F.col("speed")).alias("speed")))
    return tracks.from_gpsd(V.fixes(spark, d).select(report.alias("value"))).select("lat", "lon", "speed")
