"""Typed tables from OSM rows (kind, id, lat, lon, tags, refs, members)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayloom.functions import geo, roads, tags as T
from wayloom.operators import routing


def nodes(osm: DataFrame, bbox=None) -> DataFrame:
    n = osm.where("kind = 'node'").select("id", "lat", "lon", "tags")
    return n if bbox is None else n.where(geo.in_bbox(F.col("lat"), F.col("lon"), bbox))


def way_nodes(osm: DataFrame) -> DataFrame:
    return osm.where("kind = 'way'").select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node"))


def ways_touching(osm: DataFrame, bbox) -> DataFrame:
    """Ids of ways with a node in the box."""
    return way_nodes(osm).join(nodes(osm, bbox).select(F.col("id").alias("node")), "node", "left_semi").select("way_id").distinct()


def car_edges(osm: DataFrame, bbox=None) -> DataFrame:
    """Directed car edges with limits, split at junctions; way_id and direction kept."""
    w = osm.where("kind = 'way'")
    w = w.where(T.tag(F.col("tags"), "highway").isin(*roads.CAR_HIGHWAYS) | (F.lower(T.tag(F.col("tags"), "route")) == "ferry"))
    if bbox is not None:
        w = w.join(ways_touching(osm, bbox).withColumnRenamed("way_id", "id"), "id", "left_semi")
    parts = routing.split_ways(w.select(F.col("id").alias("way_id"), F.posexplode("refs").alias("pos", "node")), nodes(osm).select("id", "lat", "lon"))
    t = lambda k: T.tag(F.col("tags"), k)
    attrs = w.select(
        F.col("id").alias("way_id"), t("highway").alias("highway"), roads.parse_maxspeed_kmh(t("maxspeed")).alias("maxspeed_kmh"), t("name").alias("name"), t("ref").alias("ref"),
        *(roads.parse_metric(t(k)).alias(c) for k, c in (("maxweight", "maxweight_t"), ("maxaxleload", "maxaxleload_t"), ("maxbogieweight", "maxbogieweight_t"), ("maxheight", "maxheight_m"), ("maxwidth", "maxwidth_m"), ("maxlength", "maxlength_m"))),
        roads.truthy(t("toll")).alias("is_toll"), F.coalesce(F.lower(t("route")) == "ferry", F.lit(False)).alias("is_ferry"),
        T.boardwalk(t("bridge"), t("surface")).alias("is_boardwalk"), F.coalesce(t("junction") == "roundabout", F.lit(False)).alias("is_roundabout"), roads.oneway_forward(t("oneway"), t("junction")).alias("oneway"))
    return routing.both_directions(parts.join(attrs, "way_id"), F.col("oneway")).withColumn("weight", F.col("length_m"))


def pois(osm: DataFrame, bbox=None) -> DataFrame:
    n = nodes(osm, bbox).withColumn("categories", T.poi_categories(F.col("tags"))).where(F.size("categories") > 0)
    return n.select(F.col("id").alias("poi_id"), "lat", "lon", "categories", T.icon_key(F.col("tags")).alias("icon"), T.tag(F.col("tags"), "name").alias("name"), "tags")


def _placed(osm: DataFrame, ways: DataFrame) -> DataFrame:
    pos = ways.select(F.col("id").alias("way_id"), "tags", F.posexplode("refs").alias("pos", "node"))
    return pos.join(nodes(osm).select(F.col("id").alias("node"), "lat", "lon"), "node")


def buildings(osm: DataFrame) -> DataFrame:
    """Building nodes, and building ways at the mean of their resolved nodes."""
    has = T.tag(F.col("tags"), "building").isNotNull()
    points = nodes(osm).where(has).select("lat", "lon")
    centres = _placed(osm, osm.where("kind = 'way'").where(has)).groupBy("way_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"))
    return points.unionByName(centres.select("lat", "lon"))


def rings(osm: DataFrame, classify, name: str = "class") -> DataFrame:
    """Closed ways with a class to rings; a ring with an unknown node is dropped."""
    w = osm.where("kind = 'way'").withColumn(name, classify(F.col("tags"))).where(F.col(name).isNotNull() & (F.size("refs") >= 3))
    pos = w.select(F.col("id").alias("ring_id"), name, F.size("refs").alias("n"), F.posexplode("refs").alias("pos", "node"))
    got = pos.join(nodes(osm).select(F.col("id").alias("node"), "lat", "lon"), "node")
    r = got.groupBy("ring_id", name, "n").agg(F.array_sort(F.collect_list(F.struct("pos", "lon", "lat"))).alias("p")).where(F.size("p") == F.col("n"))
    return r.select("ring_id", name, F.transform("p", lambda x: F.struct(x["lon"].alias("lon"), x["lat"].alias("lat"))).alias("ring"))


def wetlands(osm: DataFrame) -> DataFrame:
    return rings(osm, T.wetland_class)


def barrier_segments(osm: DataFrame) -> DataFrame:
    from pyspark.sql import Window as W

    w = osm.where("kind = 'way'").withColumn("kind_", T.barrier_kind(F.col("tags"))).where("kind_ is not null")
    p = _placed(osm, w).join(w.select(F.col("id").alias("way_id"), "kind_"), "way_id")
    o = W.partitionBy("way_id").orderBy("pos")
    return p.select("way_id", F.col("kind_").alias("kind"), F.col("lat").alias("a_lat"), F.col("lon").alias("a_lon"), F.lead("lat").over(o).alias("b_lat"), F.lead("lon").over(o).alias("b_lon")).where("b_lat is not null")


def network_ways(osm: DataFrame, predicate) -> DataFrame:
    """Ways of matching route relations and of the relations inside them, one level."""
    rel = osm.where("kind = 'relation'").select("id", "tags", F.explode("members").alias("m"))
    own = rel.where(predicate(F.col("tags")))
    child = own.where("m.type = 'relation'").select(F.col("m.ref").alias("id")).distinct()
    inner = rel.join(child, "id", "left_semi")
    return own.unionByName(inner).where("m.type = 'way'").select(F.col("m.ref").alias("way_id")).distinct()


def place_names(osm: DataFrame) -> DataFrame:
    """Named nodes, and named ways (roads left out) at the mean of their nodes; keyed by type and id."""
    entries = osm.withColumn("kv", F.transform(F.map_entries("tags"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v"))))
    name, kind = T.named_feature(F.col("kv"))
    n = entries.where("kind = 'node'").select(F.lit("node").alias("osm_type"), F.col("id").alias("osm_id"), name.alias("name"), kind.alias("pk"), "lat", "lon")
    w = entries.where("kind = 'way'").where(T.tag(F.col("tags"), "highway").isNull()).select("id", "refs", name.alias("name"), kind.alias("pk")).where("name is not null")
    c = w.select(F.col("id").alias("osm_id"), "name", "pk", F.explode("refs").alias("node")).join(nodes(osm).select(F.col("id").alias("node"), "lat", "lon"), "node")
    c = c.groupBy("osm_id", "name", "pk").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon")).select(F.lit("way").alias("osm_type"), "osm_id", "name", "pk", "lat", "lon")
    return n.where("name is not null").unionByName(c).withColumnRenamed("pk", "kind")
