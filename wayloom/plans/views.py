"""The engine's tables over the TPC-H-like inputs, in Spark and as SQL text.

Formulas use integers and double casts only, so both engines build equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

Q = 2500.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _lat(key: Column) -> Column:
    return F.lit(58.0) + ((key * 7919) % 10000).cast("double") / F.lit(2500.0)


def _lon(key: Column) -> Column:
    return F.lit(8.0) + ((key * 6007) % 10000).cast("double") / F.lit(1666.0)


def _sql_lat(key: str) -> str:
    return f"(58::DOUBLE + (({key} * 7919) % 10000)::DOUBLE / 2500::DOUBLE)"


def _sql_lon(key: str) -> str:
    return f"(8::DOUBLE + (({key} * 6007) % 10000)::DOUBLE / 1666::DOUBLE)"


CATEGORY = ("water", "cabin", "general", "network_hut", "restroom", "overnight_facility", "craft_brewery", "tent_site", "fishing", "rest_area", "lodging")
HIGHWAY = ("motorway", "trunk", "primary", "secondary", "tertiary", "residential", "service")


def _pick(options: tuple[str, ...], at: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, options)), at.cast("int") + 1)


def _sql_pick(options: tuple[str, ...], at: str) -> str:
    return "[" + ", ".join(f"'{o}'" for o in options) + f"][({at}) + 1]"


def nodes(spark, d) -> DataFrame:
    c = table(spark, d, "customer")
    return c.select(F.col("c_custkey").alias("id"), _lat(F.col("c_custkey")).alias("lat"), _lon(F.col("c_custkey")).alias("lon"))


NODES = f"SELECT c_custkey AS id, {_sql_lat('c_custkey')} AS lat, {_sql_lon('c_custkey')} AS lon FROM customer"


def pois(spark, d) -> DataFrame:
    s = table(spark, d, "part")
    k = F.col("p_partkey")
    return s.select(k.alias("poi_id"), _lat(k * 13 + 5).alias("lat"), _lon(k * 13 + 5).alias("lon"), _pick(CATEGORY, k % 11).alias("category"), F.col("p_name").alias("name"), F.col("p_size").alias("size"))


POIS = f"SELECT p_partkey AS poi_id, {_sql_lat('(p_partkey * 13 + 5)')} AS lat, {_sql_lon('(p_partkey * 13 + 5)')} AS lon, {_sql_pick(CATEGORY, 'p_partkey % 11')} AS category, p_name AS name, p_size AS size FROM part"


def lines(spark, d, by_order: bool = False) -> DataFrame:
    """Order lines with (l_orderkey, l_linenumber) made unique; ``by_order``: dealt by the order, for those who need its lines together."""
    li = table(spark, d, "lineitem")
    li = li.repartition("l_orderkey") if by_order else li
    return li.groupBy("l_orderkey", "l_linenumber").agg(*(F.max(c).alias(c) for c in ("l_partkey", "l_quantity", "l_tax", "l_discount")))


LINES = "(SELECT l_orderkey, l_linenumber, max(l_partkey) AS l_partkey, max(l_quantity) AS l_quantity, max(l_tax) AS l_tax, max(l_discount) AS l_discount FROM lineitem GROUP BY ALL)"


def edges(spark, d) -> DataFrame:
    """Directed edges; a customer's orders lead to nodes picked by their parts."""
    n = table(spark, d, "customer").count()
    li, o = lines(spark, d), table(spark, d, "orders")
    q = F.col("l_quantity")
    return li.join(o, li.l_orderkey == o.o_orderkey).select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_idx"), F.col("o_custkey").cast("long").alias("src"), (F.col("l_partkey") % n + 1).alias("dst"),
        (q * 100).alias("length_m"), _pick(HIGHWAY, F.col("l_linenumber") % 7).alias("highway"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_linenumber") * 10.0 + 20).alias("maxspeed_kmh"),
        F.when(F.col("l_orderkey") % 3 == 0, F.round(F.col("l_tax") * 100, 0) / 2 + 2).alias("maxheight_m"),
        F.when(F.col("l_orderkey") % 5 == 0, F.round(F.col("l_discount") * 100, 0) + 3).alias("maxweight_t"),
        (F.col("l_orderkey") % 11 == 0).alias("is_toll"), (F.col("l_orderkey") % 13 == 0).alias("is_ferry"), F.col("l_orderkey").alias("way_id"),
    )


EDGES = f"""SELECT l_orderkey * 10 + l_linenumber AS edge_idx, o_custkey::BIGINT AS src, l_partkey % (SELECT count(*) FROM customer) + 1 AS dst, l_quantity * 100 AS length_m,
 {_sql_pick(HIGHWAY, 'l_linenumber % 7')} AS highway, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 10::DOUBLE + 20 END AS maxspeed_kmh,
 CASE WHEN l_orderkey % 3 = 0 THEN round(l_tax * 100, 0) / 2 + 2 END AS maxheight_m, CASE WHEN l_orderkey % 5 = 0 THEN round(l_discount * 100, 0) + 3 END AS maxweight_t,
 l_orderkey % 11 = 0 AS is_toll, l_orderkey % 13 = 0 AS is_ferry, l_orderkey AS way_id FROM {LINES} JOIN orders ON l_orderkey = o_orderkey"""


def fixes(spark, d) -> DataFrame:
    e, k = table(spark, d, "events"), F.col("event_id")
    return e.select(k, F.col("user_id").alias("station"), F.unix_timestamp("ts").alias("t"), _lat(F.col("user_id") * 31 + k % 7).alias("lat"), _lon(F.col("user_id") * 31 + k % 7).alias("lon"), F.col("value").alias("speed"), "event_type")


FIXES = f"SELECT event_id, user_id AS station, epoch(date_trunc('second', ts))::BIGINT AS t, {_sql_lat('(user_id * 31 + event_id % 7)')} AS lat, {_sql_lon('(user_id * 31 + event_id % 7)')} AS lon, value AS speed, event_type FROM events"


def duty(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    return o.groupBy(F.col("o_custkey").alias("driver"), F.to_date("o_orderdate").alias("day")).agg(F.sum(1 + F.col("o_orderkey") % 5).cast("double").alias("hours"))


DUTY = "SELECT o_custkey AS driver, o_orderdate::DATE AS day, sum(1 + o_orderkey % 5)::DOUBLE AS hours FROM orders GROUP BY ALL"


def path(spark, d) -> DataFrame:
    """One path an order: its lines in order, with points picked by the parts."""
    k = F.col("l_partkey")
    return lines(spark, d, True).select(F.col("l_orderkey").alias("req_id"), F.col("l_linenumber").alias("pos"), _lat(k).alias("lat"), _lon(k).alias("lon"), F.col("l_quantity").alias("qty"))


PATH = f"SELECT l_orderkey AS req_id, l_linenumber AS pos, {_sql_lat('l_partkey')} AS lat, {_sql_lon('l_partkey')} AS lon, l_quantity AS qty FROM {LINES}"


def places(spark, d) -> DataFrame:
    w = F.split(F.regexp_replace(F.trim(F.coalesce("text", F.lit(""))), r"\s+", " "), " ")
    return table(spark, d, "documents").select(F.col("doc_id").alias("osm_id"), F.array_join(F.slice(w, 1, 3), " ").alias("name"), F.col("source").alias("kind"), _lat(F.col("doc_id")).alias("lat"), _lon(F.col("doc_id")).alias("lon"))


PLACES = f"SELECT doc_id AS osm_id, array_to_string(string_split(regexp_replace(trim(coalesce(text, ''), ' '), '\\s+', ' ', 'g'), ' ')[1:3], ' ') AS name, source AS kind, {_sql_lat('doc_id')} AS lat, {_sql_lon('doc_id')} AS lon FROM documents"


def hav_sql(lat1: str, lon1: str, lat2: str, lon2: str, r: float = 6378100.0) -> str:
    h = f"(pow(sin(radians({lat2} - {lat1}) / 2), 2) + cos(radians({lat1})) * cos(radians({lat2})) * pow(sin(radians({lon2} - {lon1}) / 2), 2))"
    return f"(2 * {r}::DOUBLE * asin(sqrt(CASE WHEN {h} > 1 THEN 1 ELSE {h} END)))"
