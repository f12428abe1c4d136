"""Operators along ordered points: distances, samples, interpolation, maneuvers, stops."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayloom.functions import geo, roads


def cumulative_m(points: DataFrame, key: str = "req_id", r: float = geo.R_GRAPH) -> DataFrame:
    """Adds step_m (from the previous point) and cum_m along each key's pos order."""
    w = W.partitionBy(key).orderBy("pos")
    step = F.coalesce(geo.haversine_m(F.lag("lat").over(w), F.lag("lon").over(w), F.col("lat"), F.col("lon"), r), F.lit(0.0))
    return points.withColumn("step_m", step).withColumn("cum_m", F.sum("step_m").over(w.rowsBetween(W.unboundedPreceding, 0)))


def at_distance(samples: DataFrame, targets: DataFrame, key: str = "req_id") -> DataFrame:
    """Linear position at target distances (key, target_m); clamps to the ends.

    Samples and targets are merged into one sorted sequence per key; each target
    sees its last sample before and first after through window functions.
    """
    own = samples.select(key, F.col("cum_m").alias("m"), F.lit(0).alias("k"), F.struct("cum_m", "lat", "lon").alias("s"))
    ask = targets.select(key, F.col("target_m").alias("m"), F.lit(1).alias("k"), F.lit(None).cast("struct<cum_m:double,lat:double,lon:double>").alias("s"))
    w = W.partitionBy(key).orderBy("m", "k")
    both = own.unionByName(ask).withColumns({
        "a": F.last("s", True).over(w.rowsBetween(W.unboundedPreceding, 0)), "b": F.first("s", True).over(w.rowsBetween(0, W.unboundedFollowing))}).where("k = 1")
    gap = F.col("b.cum_m") - F.col("a.cum_m")
    t = F.when(gap > 0, (F.col("m") - F.col("a.cum_m")) / gap).otherwise(F.lit(0.0))
    mix = lambda c: F.when(F.col("a").isNull(), F.col(f"b.{c}")).when(F.col("b").isNull(), F.col(f"a.{c}")).otherwise(geo.interpolate(F.col(f"a.{c}"), F.col(f"b.{c}"), t))
    return both.select(key, F.col("m").alias("target_m"), mix("lat").alias("lat"), mix("lon").alias("lon"))


def sim_samples(points: DataFrame, step_m: float = 20.0, key: str = "req_id") -> DataFrame:
    """Samples every ``step_m`` or less along each leg, the last point included; repeats within 0.5 m are dropped."""
    w = W.partitionBy(key).orderBy("pos")
    c = cumulative_m(points, key).withColumns({"n_lat": F.lead("lat").over(w), "n_lon": F.lead("lon").over(w), "n_cum": F.lead("cum_m").over(w)})
    length = F.col("n_cum") - F.col("cum_m")
    n = F.when(length.isNull(), 1).otherwise(F.greatest(F.lit(1), F.ceil(length / step_m))).cast("int")
    s = c.where(length.isNull() | (length > 0.5)).withColumn("n", n).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    t = F.col("i") / F.col("n")
    mix = lambda a, b: F.when(F.col("i") == 0, F.col(a)).otherwise(geo.interpolate(F.col(a), F.col(b), t))
    return s.select(key, "pos", "i", mix("lat", "n_lat").alias("lat"), mix("lon", "n_lon").alias("lon"), mix("cum_m", "n_cum").alias("cum_m"))


def turns(path: DataFrame, outs: DataFrame, key: str = "req_id") -> DataFrame:
    """Maneuvers at inner nodes of a path (key, pos, node, lat, lon, highway of the edge that leaves it).

    ``outs`` holds each node's outgoing neighbours (node, to, to_lat, to_lon).
    Merges and exits come first, then straights with a one-sided fork (keep),
    then turn classes by the number of same-side alternatives.
    """
    w = W.partitionBy(key).orderBy("pos")
    lag = lambda c: F.lag(c).over(w)
    lead = lambda c: F.lead(c).over(w)
    p = path.withColumns({"p_node": lag("node"), "p_lat": lag("lat"), "p_lon": lag("lon"), "h_in": lag("highway"), "n_node": lead("node"), "n_lat": lead("lat"), "n_lon": lead("lon")})
    p = p.where("p_node is not null and n_node is not null").withColumn("inb", geo.bearing_deg(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon")))
    p = p.withColumn("delta", geo.turn_delta_deg(F.col("inb"), geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("n_lat"), F.col("n_lon"))))
    o = p.join(outs.withColumnRenamed("node", "o_node"), (F.col("node") == F.col("o_node")) & (F.col("to") != F.col("n_node")) & (F.col("to") != F.col("p_node")), "left")
    dw = geo.turn_delta_deg(F.col("inb"), geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")))
    o = o.withColumn("dw", dw)
    left = F.col("delta") < 0
    same = F.when(left, F.col("dw") < -roads.MIN_TURN).otherwise(F.col("dw") > roads.MIN_TURN)
    sharper = same & F.when(left, F.col("dw") < F.col("delta")).otherwise(F.col("dw") > F.col("delta"))
    g = o.groupBy(key, "pos", "node", "lat", "lon", "h_in", "highway", "delta").agg(
        F.count_if(same).alias("ways"), F.count_if(sharper).alias("sharper"), F.max(F.when(F.col("dw") < 0, F.col("dw"))).alias("l"), F.min(F.when(F.col("dw") > 0, F.col("dw"))).alias("r"))
    near_l = F.coalesce(F.col("l") - F.col("delta") > -2 * roads.MIN_TURN, F.lit(False))
    near_r = F.coalesce(F.col("r") - F.col("delta") < 2 * roads.MIN_TURN, F.lit(False))
    keep = F.when(near_l & ~near_r, "keep_right").when(near_r & ~near_l, "keep_left")
    turn = roads.classify_turn(F.col("delta"), F.col("ways"), F.col("sharper"))
    kind = F.coalesce(roads.merge_or_exit(F.col("h_in"), F.col("highway"), F.col("delta")), F.when(F.abs("delta") < roads.MIN_TURN, keep), turn)
    return g.select(key, "pos", "node", F.col("delta"), "ways", "sharper", kind.alias("kind"), roads.maneuver_icon(kind, F.col("delta")).alias("icon"))


def destinations(path: DataFrame, key: str = "req_id") -> DataFrame:
    """(key, pos, node, kind, icon) of each path's last node, which ends the list of maneuvers."""
    last = path.groupBy(key).agg(F.max(F.struct("pos", "node")).alias("z")).select(key, "z.pos", "z.node", F.lit("destination").alias("kind"))
    return last.withColumn("icon", roads.maneuver_icon(F.col("kind"), F.lit(0.0)))


def roundabout_exits(path: DataFrame, outs: DataFrame, spans: DataFrame, key: str = "req_id") -> DataFrame:
    """(key, first, last, exit): the number, 1 to 8, of the exit by which a path leaves a roundabout.

    path: (key, pos, node, lat, lon); outs: (node, to, to_lat, to_lon, is_ring); spans: (key, first, last),
    the positions of entry and leaving.  Ways out that are no ring edge and do not lead back count from the
    entry's next node on; at the leaving node those to the right of the way taken (the larger change of
    bearing) and that way itself.  Where the way taken is none of them, all count.
    """
    w = W.partitionBy(key).orderBy("pos")
    step = path.withColumns({"p_node": F.lag("node").over(w), "p_lat": F.lag("lat").over(w), "p_lon": F.lag("lon").over(w), "n_node": F.lead("node").over(w)}).where("p_node is not null")
    inside = spans.select(key, "first", "last").join(step, key).where("pos > first and pos <= last")
    o = outs.where(~F.col("is_ring")).select(F.col("node").alias("o_node"), "to", "to_lat", "to_lon").distinct()
    inbound = geo.bearing_deg(F.col("p_lat"), F.col("p_lon"), F.col("lat"), F.col("lon"))
    turn = geo.turn_delta_deg(inbound, geo.bearing_deg(F.col("lat"), F.col("lon"), F.col("to_lat"), F.col("to_lon")))
    met = inside.join(o, (F.col("node") == F.col("o_node")) & (F.col("to") != F.col("p_node"))).withColumn("turn", turn)
    taken = F.max(F.when((F.col("pos") == F.col("last")) & (F.col("to") == F.col("n_node")), F.struct("turn", "to"))).over(W.partitionBy(key, "first", "last"))
    met = met.withColumn("taken", taken)
    counts = (F.col("pos") < F.col("last")) | F.col("taken").isNull() | (F.col("turn") > F.col("taken.turn")) | ((F.col("turn") == F.col("taken.turn")) & (F.col("to") <= F.col("taken.to")))
    n = met.groupBy(key, "first", "last").agg(F.count_if(counts).alias("n"))
    return spans.select(key, "first", "last").join(n, [key, "first", "last"], "left").select(key, "first", "last", F.greatest(F.lit(1), F.least(F.lit(8), F.coalesce("n", F.lit(0)))).cast("int").alias("exit"))


def runs(rows: DataFrame, flag: Column, key: str = "req_id") -> DataFrame:
    """Maximal runs of rows with the flag: (key, first, last, n)."""
    w = W.partitionBy(key).orderBy("pos")
    on = F.coalesce(flag, F.lit(False))
    s = rows.withColumn("_on", on).withColumn("_island", F.sum((~F.col("_on")).cast("int")).over(w))
    return s.where("_on").groupBy(key, "_island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"), F.count("*").alias("n")).drop("_island")


def spaced(stops: DataFrame, apart_m: float = 2000.0, key: str = "req_id") -> DataFrame:
    """Greedy: in order, keeps a stop unless a kept one lies within ``apart_m`` (order matters, so a fold).

    A trip's stops are one array; it is bounded by the trip, not by the data.
    """
    seq = stops.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "lat", "lon"))).alias("all"))

    def keep(kept, x):
        close = F.exists(kept, lambda k: geo.haversine_m(k["lat"], k["lon"], x["lat"], x["lon"], geo.R_GRAPH) < apart_m)
        return F.when(close, kept).otherwise(F.concat(kept, F.array(x)))

    return seq.select(key, F.explode(F.aggregate("all", F.slice("all", 1, 0), keep)).alias("s")).select(key, "s.pos", "s.lat", "s.lon")


def merge_legs(legs: DataFrame) -> DataFrame:
    """(trip, leg, pos, cum_m) to trip-wide cum_m: each leg is offset by the lengths of those before."""
    total = legs.groupBy("trip", "leg").agg(F.max("cum_m").alias("len"))
    w = W.partitionBy("trip").orderBy("leg").rowsBetween(W.unboundedPreceding, -1)
    return legs.join(total.withColumn("off", F.coalesce(F.sum("len").over(w), F.lit(0.0))), ["trip", "leg"]).select("trip", "leg", "pos", (F.col("cum_m") + F.col("off")).alias("cum_m"))
