"""Joins, aggregates, windows, search and set operations."""

from __future__ import annotations

from pyspark.sql import Window as W, functions as F

from wayloom.functions import geo, roads
from wayloom.operators import search as S, sequences as Q, spatial as X, stores
from wayloom.plans import views as V
from wayloom.plans.registry import register
from wayloom.plans.views import hav_sql, table
from wayloom.streaming import tracks

R = lambda c, n=3: F.round(c, n)
H = hav_sql("n.lat", "n.lon", "p.lat", "p.lon", 6371008.8)


@register("radius_pois", f"SELECT id, poi_id, round({H}, 3) AS dist_m FROM ({V.NODES}) n JOIN (SELECT * FROM ({V.POIS}) WHERE category IN ('water', 'cabin')) p ON {H} <= 10500")
def radius_pois(spark, d):
    p = V.pois(spark, d).where(F.col("category").isin("water", "cabin")).select("poi_id", "lat", "lon")
    return X.radius_join(V.nodes(spark, d), p, 10_500.0).select("id", "poi_id", R(F.col("dist_m")).alias("dist_m"))


@register("knn_pois", f"""SELECT id, poi_id, rank, dist_m FROM (SELECT id, poi_id, round({H}, 3) AS dist_m, row_number() OVER (PARTITION BY id ORDER BY round({H}, 3), poi_id)::INTEGER AS rank FROM ({V.NODES}) n CROSS JOIN (SELECT * FROM ({V.POIS}) WHERE category = 'lodging') p) WHERE rank <= 3""")
def knn_pois(spark, d):
    p = V.pois(spark, d).where("category = 'lodging'").select("poi_id", "lat", "lon")
    return X.knn(V.nodes(spark, d), p, 3, 40_000.0).select("id", "poi_id", F.col("rank").cast("int").alias("rank"), "dist_m")


@register("snap_nodes", f"""WITH linked AS (SELECT src AS id FROM ({V.EDGES}) UNION SELECT dst FROM ({V.EDGES})), l AS (SELECT n.* FROM ({V.NODES}) n JOIN linked USING (id)),
 s AS (SELECT p.poi_id, n.id AS node, round({H}, 3) AS dist_m, row_number() OVER (PARTITION BY p.poi_id ORDER BY round({H}, 3), n.id) AS rank FROM l n CROSS JOIN ({V.POIS}) p)
 SELECT poi_id, node, dist_m, dist_m <= 750 AS within_budget FROM s WHERE rank = 1""")
def snap_nodes(spark, d):
    from wayloom.operators.routing import SNAP_M

    e = V.edges(spark, d)
    linked = e.select(F.col("src").alias("id")).union(e.select("dst")).distinct()
    n = V.nodes(spark, d).join(linked, "id", "left_semi").select(F.col("id").alias("node"), "lat", "lon")
    near = X.knn(V.pois(spark, d).select("poi_id", "lat", "lon"), n, 1, 10_000.0, "poi_id", "node")
    return near.select("poi_id", "node", "dist_m", (F.col("dist_m") <= SNAP_M["car"]).alias("within_budget"))


SEG = f"SELECT req_id, pos, lat AS a_lat, lon AS a_lon, lead(lat) OVER w AS b_lat, lead(lon) OVER w AS b_lon FROM ({V.PATH}) WINDOW w AS (PARTITION BY req_id ORDER BY pos)"


def _segments(spark, d):
    w = W.partitionBy("req_id").orderBy("pos")
    p = V.path(spark, d)
    return p.select("req_id", "pos", F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lead("lat").over(w).alias("b_lat"), F.lead("lon").over(w).alias("b_lon")).where("b_lat is not null")


def _pd(lat, lon):
    kx = f"(111320::DOUBLE * cos(radians({lat})))"
    ax, ay, bx, by = f"((a_lon - {lon}) * {kx})", f"((a_lat - {lat}) * 111320::DOUBLE)", f"((b_lon - {lon}) * {kx})", f"((b_lat - {lat}) * 111320::DOUBLE)"
    l2 = f"(pow({bx} - {ax}, 2) + pow({by} - {ay}, 2))"
    t = f"greatest(0, least(1, -({ax} * ({bx} - {ax}) + {ay} * ({by} - {ay})) / {l2}))"
    return f"CASE WHEN {l2} < 1 THEN {hav_sql(lat, lon, 'a_lat', 'a_lon')} ELSE sqrt(pow({ax} + {t} * ({bx} - {ax}), 2) + pow({ay} + {t} * ({by} - {ay}), 2)) END"


@register("corridor_pois", f"""WITH s AS (SELECT * FROM ({SEG}) WHERE b_lat IS NOT NULL) SELECT DISTINCT s.req_id, p.poi_id FROM ({V.POIS}) p JOIN s
 ON p.lat >= least(a_lat, b_lat) - 0.02 AND p.lat <= greatest(a_lat, b_lat) + 0.02 WHERE p.lon BETWEEN least(a_lon, b_lon) - 0.05 AND greatest(a_lon, b_lon) + 0.05 AND {_pd('p.lat', 'p.lon')} <= 1500""")
def corridor_pois(spark, d):
    """Places within 1500 m of every path."""
    return X.within_corridor(V.pois(spark, d), _segments(spark, d), 1500.0, "poi_id", ("req_id",))


def _on(o, p, q, r):
    return f"(abs({o}) <= 1e-12 AND {r}_lon BETWEEN least({p}_lon, {q}_lon) - 1e-12 AND greatest({p}_lon, {q}_lon) + 1e-12 AND {r}_lat BETWEEN least({p}_lat, {q}_lat) - 1e-12 AND greatest({p}_lat, {q}_lat) + 1e-12)"


@register("barrier_crossings", f"""WITH s AS (SELECT * FROM ({SEG}) WHERE b_lat IS NOT NULL), l AS (SELECT * FROM s WHERE req_id % 20 = 0),
 r AS (SELECT req_id AS o_id, pos AS o_pos, a_lat AS c_lat, a_lon AS c_lon, a_lat + (b_lat - a_lat) / 64 AS d_lat, a_lon + (b_lon - a_lon) / 64 AS d_lon FROM s),
 o AS (SELECT *, (b_lon - a_lon) * (c_lat - a_lat) - (b_lat - a_lat) * (c_lon - a_lon) AS o1, (b_lon - a_lon) * (d_lat - a_lat) - (b_lat - a_lat) * (d_lon - a_lon) AS o2,
  (d_lon - c_lon) * (a_lat - c_lat) - (d_lat - c_lat) * (a_lon - c_lon) AS o3, (d_lon - c_lon) * (b_lat - c_lat) - (d_lat - c_lat) * (b_lon - c_lon) AS o4 FROM l JOIN r
  ON least(a_lat, b_lat) <= greatest(c_lat, d_lat) + 1e-9 AND greatest(a_lat, b_lat) >= least(c_lat, d_lat) - 1e-9 WHERE least(a_lon, b_lon) <= greatest(c_lon, d_lon) + 1e-9 AND greatest(a_lon, b_lon) >= least(c_lon, d_lon) - 1e-9)
 SELECT req_id, pos, o_id, o_pos FROM o WHERE (o1 * o2 < 0 AND o3 * o4 < 0) OR {_on('o1', 'a', 'b', 'c')} OR {_on('o2', 'a', 'b', 'd')} OR {_on('o3', 'c', 'd', 'a')} OR {_on('o4', 'c', 'd', 'b')}""")
def barrier_crossings(spark, d):
    """Legs of every twentieth path against the barriers that begin at all paths' points, touches included."""
    s = _segments(spark, d)
    part = lambda c: (F.col(f"a_{c}") + (F.col(f"b_{c}") - F.col(f"a_{c}")) / 64).alias(f"d_{c}")
    r = s.select(F.col("req_id").alias("o_id"), F.col("pos").alias("o_pos"), F.col("a_lat").alias("c_lat"), F.col("a_lon").alias("c_lon"), part("lat"), part("lon"))
    return X.crossing_pairs(s.where("req_id % 20 = 0"), r, 0.1).select("req_id", "pos", "o_id", "o_pos")


#: Rings: the points of a path drawn to a twentieth of their distance from its first point.
RINGS = f"SELECT req_id AS ring_id, pos, f_lon + (lon - f_lon) / 20 AS lon, f_lat + (lat - f_lat) / 20 AS lat FROM (SELECT *, first_value(lat) OVER w AS f_lat, first_value(lon) OVER w AS f_lon, count(*) OVER (PARTITION BY req_id) AS n FROM ({V.PATH}) WINDOW w AS (PARTITION BY req_id ORDER BY pos)) WHERE n >= 3"


@register("wetland_points", f"""WITH e AS (SELECT ring_id, lon AS ax, lat AS ay, coalesce(lag(lon) OVER w, last_value(lon) OVER v) AS bx, coalesce(lag(lat) OVER w, last_value(lat) OVER v) AS by_ FROM ({RINGS})
  WINDOW w AS (PARTITION BY ring_id ORDER BY pos), v AS (PARTITION BY ring_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING))
 SELECT id, ring_id FROM ({V.NODES}) n JOIN e ON lat >= least(ay, by_) AND lat <= greatest(ay, by_) WHERE (ay > lat) <> (by_ > lat) AND lon < (bx - ax) * (lat - ay) / (by_ - ay) + ax GROUP BY id, ring_id HAVING count(*) % 2 = 1""")
def wetland_points(spark, d):
    p = V.path(spark, d).groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).where("size(p) >= 3")
    near = lambda x, c: (F.col("p")[0][c] + (x[c] - F.col("p")[0][c]) / 20).alias(c)
    rings = p.select(F.col("req_id").alias("ring_id"), F.transform("p", lambda x: F.struct(near(x, "lon"), near(x, "lat"))).alias("ring"))
    return X.points_in_rings(V.nodes(spark, d), X.ring_bounds(rings), 0.1)


@register("nearest_road", f"""WITH s AS (SELECT * FROM ({SEG}) WHERE b_lat IS NOT NULL), m AS (SELECT p.poi_id, s.req_id, s.pos, round({_pd('p.lat', 'p.lon')}, 3) AS dist_m FROM (SELECT * FROM ({V.POIS}) WHERE poi_id % 20 = 0) p CROSS JOIN s)
 SELECT poi_id, min(dist_m) AS dist_m, arg_min(req_id, (dist_m, req_id, pos)) AS road FROM m GROUP BY poi_id""")
def nearest_road(spark, d):
    p = V.pois(spark, d).where("poi_id % 20 = 0").select("poi_id", "lat", "lon")
    return X.nearest_segment(p, _segments(spark, d)).select("poi_id", "dist_m", F.col("req_id").alias("road"))


@register("node_uses", f"""WITH w AS (SELECT req_id AS way_id, pos, max(pos) OVER (PARTITION BY req_id) AS z, min(pos) OVER (PARTITION BY req_id) AS a, 1 + floor(lat * 40)::BIGINT % 97 AS node FROM ({V.PATH}))
 SELECT node, sum(CASE WHEN pos = z OR pos = a THEN 2 ELSE 1 END)::BIGINT AS uses, sum(CASE WHEN pos = z OR pos = a THEN 2 ELSE 1 END) > 1 AS is_junction FROM w GROUP BY node""")
def node_uses(spark, d):
    from wayloom.operators.routing import junctions

    return junctions(V.path(spark, d).select(F.col("req_id").alias("way_id"), "pos", (F.lit(1) + F.floor(F.col("lat") * 40) % 97).alias("node")))


@register("path_totals", f"""WITH e AS (SELECT src % 500 AS req_id, * FROM ({V.EDGES})) SELECT req_id, round(sum(length_m), 3) AS length_m, round(sum(CASE WHEN highway IN ('motorway', 'motorway_link') THEN length_m ELSE 0 END) / sum(length_m) * 100, 6) AS motorway_pct,
 round(100 - sum(CASE WHEN highway IN ('motorway', 'motorway_link') THEN length_m ELSE 0 END) / sum(length_m) * 100, 6) AS other_pct, count(*) FILTER (WHERE is_toll OR is_ferry OR highway = 'motorway' OR coalesce(4 > maxheight_m, false)) AS restricted FROM e GROUP BY req_id""")
def path_totals(spark, d):
    from wayloom.operators.routing import allowed

    e = V.edges(spark, d).withColumn("req_id", F.col("src") % 500)
    pct = F.sum(F.when(roads.is_motorway(F.col("highway")), F.col("length_m")).otherwise(0.0)) / F.sum("length_m") * 100
    return e.groupBy("req_id").agg(R(F.sum("length_m")).alias("length_m"), R(pct, 6).alias("motorway_pct"), R(100 - pct, 6).alias("other_pct"), F.count_if(~allowed(True, True, True, maxheight_m=4.0)).alias("restricted"))


@register("eco_breakdown", f"""WITH e AS (SELECT src % 500 AS req_id, length_m, (edge_idx % 41 - 20)::DOUBLE AS dh FROM ({V.EDGES})) SELECT req_id, round(sum(CASE WHEN dh > 0 THEN dh ELSE 0 END), 3) AS climb_m, round(-sum(CASE WHEN dh < 0 THEN dh ELSE 0 END), 3) AS descent_m,
 round(sum(CASE WHEN dh > 0 THEN dh ELSE 0 END) * 1500::DOUBLE * 9.80665::DOUBLE, 3) AS uphill_j, round(coalesce(max(CASE WHEN dh > 0 AND length_m >= 15 THEN dh / length_m * 100 END), 0), 6) AS max_grade_pct FROM e GROUP BY req_id""")
def eco_breakdown(spark, d):
    dh = (F.col("edge_idx") % 41 - 20).cast("double")
    up, down = F.sum(F.when(dh > 0, dh).otherwise(0.0)), -F.sum(F.when(dh < 0, dh).otherwise(0.0))
    return V.edges(spark, d).groupBy((F.col("src") % 500).alias("req_id")).agg(R(up).alias("climb_m"), R(down).alias("descent_m"), R(up * 1500.0 * 9.80665, 3).alias("uphill_j"), R(F.coalesce(F.max(F.when((dh > 0) & (F.col("length_m") >= 15), dh / F.col("length_m") * 100)), F.lit(0.0)), 6).alias("max_grade_pct"))


CUM = f"SELECT req_id, pos, lat, lon, qty, coalesce({hav_sql('lag(lat) OVER w', 'lag(lon) OVER w', 'lat', 'lon')}, 0) AS step_m FROM ({V.PATH}) WINDOW w AS (PARTITION BY req_id ORDER BY pos)"
CUM2 = f"SELECT *, sum(step_m) OVER (PARTITION BY req_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS cum_m FROM ({CUM})"


@register("cumulative_km", f"SELECT req_id, pos, round(step_m, 2) AS step_m, round(cum_m, 2) AS cum_m FROM ({CUM2})")
def cumulative_km(spark, d):
    return Q.cumulative_m(V.path(spark, d)).select("req_id", "pos", R(F.col("step_m"), 2).alias("step_m"), R(F.col("cum_m"), 2).alias("cum_m"))


@register("interpolate_km", f"""WITH s AS (SELECT *, lead(cum_m) OVER w AS n_cum, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon, max(cum_m) OVER (PARTITION BY req_id) AS total FROM ({CUM2}) WINDOW w AS (PARTITION BY req_id ORDER BY pos)),
 t AS (SELECT req_id, max(total) * 0.37::DOUBLE AS target FROM s GROUP BY req_id HAVING max(total) > 0)
 SELECT t.req_id, round(s.lat + (s.n_lat - s.lat) * ((target - s.cum_m) / (n_cum - s.cum_m)), 6) AS lat, round(s.lon + (s.n_lon - s.lon) * ((target - s.cum_m) / (n_cum - s.cum_m)), 6) AS lon FROM t JOIN s ON t.req_id = s.req_id AND s.cum_m <= target AND s.n_cum > target""")
def interpolate_km(spark, d):
    c = Q.cumulative_m(V.path(spark, d))
    t = c.groupBy("req_id").agg((F.max("cum_m") * 0.37).alias("target_m")).where("target_m > 0")
    return Q.at_distance(c, t).select("req_id", R(F.col("lat"), 6).alias("lat"), R(F.col("lon"), 6).alias("lon"))


@register("sim_sample_counts", f"""WITH s AS (SELECT req_id, pos, step_m, lead(step_m) OVER (PARTITION BY req_id ORDER BY pos) AS n FROM ({CUM})) SELECT req_id, sum(CASE WHEN n IS NULL THEN 1 WHEN n <= 0.5 THEN 0 ELSE greatest(1, ceil(n / 5000)) END)::BIGINT AS n FROM s GROUP BY req_id""")
def sim_sample_counts(spark, d):
    return Q.sim_samples(V.path(spark, d), 5000.0).groupBy("req_id").agg(F.count("*").alias("n"))


@register("densify_counts", f"""WITH s AS (SELECT req_id, pos, lat, lon, lead(lat) OVER w AS n_lat, lead(lon) OVER w AS n_lon FROM ({V.PATH}) WINDOW w AS (PARTITION BY req_id ORDER BY pos)), m AS (SELECT *, {hav_sql('lat', 'lon', 'n_lat', 'n_lon', 6371008.8)} AS m FROM s)
 SELECT req_id, sum(CASE WHEN n_lat IS NULL OR m < 1 THEN 1 ELSE greatest(1, ceil(m / 2000)) END)::BIGINT AS n FROM m GROUP BY req_id""")
def densify_counts(spark, d):
    return X.densify(V.path(spark, d), 2000.0).groupBy("req_id").agg(F.count("*").alias("n"))


@register("roundabout_runs", f"""WITH f AS (SELECT req_id, pos, qty > 25 AS ring FROM ({V.PATH})), i AS (SELECT *, sum(CASE WHEN ring THEN 0 ELSE 1 END) OVER (PARTITION BY req_id ORDER BY pos) AS island FROM f)
 SELECT req_id, min(pos) AS first, max(pos) AS last, count(*) AS n FROM i WHERE ring GROUP BY req_id, island""")
def roundabout_runs(spark, d):
    return Q.runs(V.path(spark, d), F.col("qty") > 25)


@register("merged_legs", f"""WITH l AS (SELECT req_id // 10 AS trip, req_id AS leg, pos, cum_m FROM ({CUM2})), t AS (SELECT trip, leg, max(cum_m) AS len FROM l GROUP BY ALL), o AS (SELECT *, coalesce(sum(len) OVER (PARTITION BY trip ORDER BY leg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM t)
 SELECT l.trip, l.leg, pos, round(cum_m + off, 1) AS cum_m FROM l JOIN o USING (trip, leg)""")
def merged_legs(spark, d):
    c = Q.cumulative_m(V.path(spark, d))
    return Q.merge_legs(c.select(F.floor(F.col("req_id") / 10).alias("trip"), F.col("req_id").alias("leg"), "pos", "cum_m")).withColumn("cum_m", R(F.col("cum_m"), 1))


@register("spaced_stops", f"""WITH RECURSIVE p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY req_id ORDER BY pos) AS n FROM ({V.PATH})),
 w AS (SELECT req_id, n, pos, lat, lon, true AS kept, [{{'lat': lat, 'lon': lon}}] AS held FROM p WHERE n = 1
  UNION ALL SELECT q.req_id, q.n, q.pos, q.lat, q.lon, q.ok, CASE WHEN q.ok THEN list_append(held, {{'lat': q.lat, 'lon': q.lon}}) ELSE held END FROM (
   SELECT p.*, w.held, NOT list_bool_or(list_transform(w.held, lambda k: {hav_sql('k.lat', 'k.lon', 'p.lat', 'p.lon')} < 150000)) AS ok FROM w JOIN p ON p.req_id = w.req_id AND p.n = w.n + 1) q)
 SELECT req_id, pos, lat, lon FROM w WHERE kept""")
def spaced_stops(spark, d):
    return Q.spaced(V.path(spark, d), 150_000.0)


FOLD = "translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy')"


@register("place_search", f"""WITH p AS ({V.PLACES}), t AS (SELECT osm_id, unnest(list_distinct(regexp_split_to_array({FOLD.format("concat_ws(' ', name, kind)")}, '[^\\p{{L}}\\p{{N}}]+'))) AS token FROM p),
 h AS (SELECT DISTINCT osm_id FROM t WHERE starts_with(token, 'th')) SELECT p.osm_id, p.name, p.kind FROM p JOIN h USING (osm_id) ORDER BY CASE WHEN starts_with(lower(name), 'th') THEN 0 ELSE 1 END, strlen(name), osm_id LIMIT 25""")
def place_search(spark, d):
    return S.search(V.places(spark, d), "Th", 25).select("osm_id", "name", "kind")


@register("place_nearby", f"SELECT osm_id, round({hav_sql('59.5::DOUBLE', '10.5::DOUBLE', 'lat', 'lon', 6371000.0)}, 3) AS dist_m FROM ({V.PLACES}) WHERE round({hav_sql('59.5::DOUBLE', '10.5::DOUBLE', 'lat', 'lon', 6371000.0)}, 3) <= 60000 ORDER BY 2, 1 LIMIT 20")
def place_nearby(spark, d):
    return S.nearby(V.places(spark, d), 59.5, 10.5, 60_000.0, 20).select("osm_id", "dist_m")


@register("route_store", """WITH l AS (SELECT c_nationkey::VARCHAR AS id, c_name AS name, to_timestamp(c_custkey) AS created_at, c_custkey AS version FROM customer), m AS (SELECT id, max(version) AS version, arg_max(name, version) AS name FROM l GROUP BY id)
 SELECT id, CASE WHEN id = '3' THEN 'renamed' ELSE name END AS name, version FROM m WHERE id NOT IN ('5', '6')""")
def route_store(spark, d):
    c = table(spark, d, "customer")
    log = c.select(F.col("c_nationkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.timestamp_seconds("c_custkey").alias("created_at"), F.col("c_custkey").alias("version"))
    gone = log.where(F.col("id").isin("5", "6")).select("id")
    return stores.rename(stores.listing(log, ["id"], gone), "3", "renamed").select("id", "name", "version")


@register("job_progress", "SELECT (o_custkey % 50)::VARCHAR AS job_id, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) AS total FROM orders GROUP BY 1")
def job_progress(spark, d):
    o = table(spark, d, "orders")
    return stores.job_progress(o.select((F.col("o_custkey") % 50).cast("string").alias("job_id"), F.when(F.col("o_orderstatus") == "F", "completed").otherwise("pending").alias("status")))


@register("track_latest", f"SELECT station, max(t) AS t, arg_max(event_id, (t, event_id)) AS event_id, round(arg_max(lat, (t, event_id)), 6) AS lat FROM ({V.FIXES}) GROUP BY station")
def track_latest(spark, d):
    return tracks.latest(V.fixes(spark, d)).select("station", "t", "event_id", R(F.col("lat"), 6).alias("lat"))


@register("track_expired", f"WITH l AS (SELECT station, max(t) AS t FROM ({V.FIXES}) GROUP BY station), m AS (SELECT max(t) AS z FROM l) SELECT station FROM l, m WHERE z - 3000 - t > 3600")
def track_expired(spark, d):
    l = tracks.latest(V.fixes(spark, d))
    now = l.agg((F.max("t") - 3000).alias("now"))  # one row
    return tracks.expire(l.crossJoin(F.broadcast(now)), F.col("now"), 9999).select("station")


@register("track_visible", f"WITH l AS (SELECT station, arg_max(lat, (t, event_id)) AS lat, arg_max(lon, (t, event_id)) AS lon FROM ({V.FIXES}) GROUP BY station) SELECT station FROM l WHERE {hav_sql('60::DOUBLE', '11::DOUBLE', 'lat', 'lon', 6371000.0)} <= 150000")
def track_visible(spark, d):
    return tracks.visible(tracks.latest(V.fixes(spark, d)), 60.0, 11.0, 400.0).select("station")


@register("off_route_actions", f"""WITH f AS (SELECT station, t * 1000 + event_id % 1000 AS now_ms, event_id % 5 <> 0 AS off FROM ({V.FIXES})), i AS (SELECT *, sum(CASE WHEN off THEN 0 ELSE 1 END) OVER (PARTITION BY station ORDER BY now_ms) AS island FROM f),
 b AS (SELECT *, min(now_ms) OVER (PARTITION BY station, island) AS since FROM i WHERE off) SELECT station, min(now_ms) AS now_ms FROM b WHERE now_ms - since >= 5000 GROUP BY station, island""")
def off_route_actions(spark, d):
    f = V.fixes(spark, d).select("station", (F.col("t") * 1000 + F.col("event_id") % 1000).alias("now_ms"), (F.col("event_id") % 5 != 0).alias("off"))
    return tracks.off_route_batch(f)


@register("network_preference", f"""WITH n AS (SELECT DISTINCT way_id FROM ({V.EDGES}) WHERE way_id % 4 = 0) SELECT edge_idx, round(CASE WHEN n.way_id IS NULL THEN length_m * 2.5 ELSE length_m END, 3) AS weight FROM ({V.EDGES}) e LEFT JOIN n USING (way_id)""")
def network_preference(spark, d):
    from wayloom.operators.routing import prefer_network

    e = V.edges(spark, d).withColumn("weight", F.col("length_m"))
    return prefer_network(e, e.where("way_id % 4 = 0").select("way_id")).select("edge_idx", R(F.col("weight")).alias("weight"))


@register("common_label", "SELECT key, arg_min(label, (-n, p)) AS label FROM (SELECT p_size AS key, p_brand AS label, count(*) AS n, min(p_partkey) AS p FROM part GROUP BY ALL) GROUP BY key")
def common_label(spark, d):
    return S.most_common_label(table(spark, d, "part").select(F.col("p_size").alias("key"), F.col("p_brand").alias("label"), F.col("p_partkey").alias("pos")))


@register("speed_windows", "SELECT event_type, epoch(date_trunc('hour', ts))::BIGINT AS start, count(*) AS n, round(avg(value), 6) AS speed FROM events GROUP BY ALL")
def speed_windows(spark, d):
    e = table(spark, d, "events")
    g = e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), R(F.avg("value"), 6).alias("speed"))
    return g.select("event_type", F.unix_timestamp("w.start").alias("start"), "n", "speed")


@register("vector_topk", """WITH q AS (SELECT vec_id AS q_id, embedding AS q FROM embeddings WHERE vec_id % 20 = 0), s AS (SELECT q_id, vec_id, round(sqrt(list_sum(list_transform(range(1, len(q) + 1), lambda i: pow(q[i]::DOUBLE - embedding[i]::DOUBLE, 2)))), 4) AS dist FROM q CROSS JOIN embeddings)
 SELECT q_id, vec_id, dist FROM (SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY dist, vec_id) AS r FROM s) WHERE r <= 5""")
def vector_topk(spark, d):
    e = table(spark, d, "embeddings")
    return S.nearest_vectors(e, e.where("vec_id % 20 = 0"), 5)
