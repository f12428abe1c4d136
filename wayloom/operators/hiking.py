"""Hiking days: overnight choice at a point, and days that end at huts."""

from __future__ import annotations

from dataclasses import asdict, dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayloom.functions import geo
from wayloom.operators import spatial
from wayloom.operators.lineage import cut
from wayloom.operators.sequences import at_distance

BROADCAST_HUTS = 1_000_000


@dataclass(frozen=True)
class HutRules:
    """Fixed distances in metres and kilometres."""

    network_m: float = 25_000.0
    cabin_m: float = 5_000.0
    prefer_network_m: float = 11_000.0
    near_m: float = 5_000.0
    first_probe_km: float = 8.0
    probe_km: float = 0.5
    slack_m: float = 500.0
    least_day_km: float = 5.0


def choose_overnight(targets: DataFrame, huts: DataFrame, rules: HutRules = HutRules()) -> DataFrame:
    """Best hut of every target (target_id, lat, lon) among huts (hut_id, lat, lon, is_network, rejected).

    Network huts count to their wider radius.  Order: networks inside the
    preference radius, then others before networks, then distance, then id; a
    safe hut beats all rejected ones.
    """
    near = spatial.radius_join(targets, huts, max(rules.network_m, rules.cabin_m))
    near = near.where((F.col("is_network") & (F.col("dist_m") <= rules.network_m)) | (F.col("dist_m") <= rules.cabin_m))
    preferred = F.col("is_network") & (F.col("dist_m") <= rules.prefer_network_m)
    rank = F.struct(F.col("rejected"), ~preferred, F.col("is_network"), F.round("dist_m", 3), F.col("hut_id"))
    best = near.groupBy("target_id").agg(F.min(F.struct(rank.alias("rank"), "hut_id", "is_network", "rejected", F.round("dist_m", 3).alias("dist_m"))).alias("m"))
    return best.select("target_id", "m.hut_id", "m.is_network", "m.rejected", "m.dist_m")


def _merged(best: Column, new: Column, slack: float) -> Column:
    """The better of two huts (km, off, network): networks first, then the one clearly nearer to the route, then the farther along."""
    apart = new["off"] - best["off"]
    by_distance = F.when(F.abs(apart) > slack, apart < 0).otherwise((new["km"] > best["km"]) | ((F.abs(new["km"] - best["km"]) < 1.0) & (apart < 0)))
    take = best.isNull() | F.when(new["network"] != best["network"], new["network"]).otherwise(by_distance)
    return F.when(take, new).otherwise(best)


def _one_day(todo: DataFrame, samples: DataFrame, huts: DataFrame, rules: HutRules) -> DataFrame:
    """The next day of trips (req_id, start_km, window_km, total_km) that do not end in it: req_id, end_km, hut_id, gap."""
    steps = F.floor((F.col("window_km") - F.col("start_km") - rules.first_probe_km) / rules.probe_km + 1e-9).cast("int")
    tries = F.when(steps >= 0, F.transform(F.sequence(F.lit(0), F.greatest(steps, F.lit(0))), lambda k: F.col("start_km") + rules.first_probe_km + k * rules.probe_km)).otherwise(F.array().cast("array<double>"))
    # the end of the window comes last and counts only if no probe has a hut
    ask = todo.select("req_id", F.posexplode(F.concat(tries, F.array("window_km"))).alias("n", "km"), F.size(tries).alias("end_n")).withColumn("target_m", F.col("km") * 1000)
    spots = at_distance(samples, ask.select("req_id", "target_m").distinct())
    probe = spots.join(ask, ["req_id", "target_m"]).withColumn("target_id", F.struct("req_id", "n", "km", "end_n"))
    chosen = choose_overnight(probe.select("target_id", "lat", "lon"), huts, rules).join(huts.select("hut_id", F.col("lat").alias("h_lat"), F.col("lon").alias("h_lon")), "hut_id")
    chosen = cut(chosen.select("target_id.*", "hut_id", "is_network", "rejected", "dist_m", "h_lat", "h_lon"))
    used = chosen.where((F.col("n") < F.col("end_n")) & (F.col("dist_m") <= rules.near_m))
    inside = samples.join(todo, "req_id").where((F.col("cum_m") / 1000).between(F.col("start_km"), F.col("window_km"))).where("lat is not null and lon is not null").select("req_id", "lat", "lon", (F.col("cum_m") / 1000).alias("s_km"))
    off = F.round(geo.haversine_m(F.col("lat"), F.col("lon"), F.col("h_lat"), F.col("h_lon"), geo.R_MEAN), 3)
    foot = used.select("req_id", "hut_id", "h_lat", "h_lon").distinct().join(inside, "req_id").groupBy("req_id", "hut_id").agg(F.min(F.struct(off.alias("off"), "s_km")).alias("foot"))
    seen = used.join(foot, ["req_id", "hut_id"], "left").join(todo.select("req_id", "start_km"), "req_id").select(
        "req_id", "n", F.coalesce("foot.s_km", "km").alias("km"), F.coalesce("foot.off", "dist_m").alias("off"), F.col("is_network").alias("network"), "hut_id", "rejected", "start_km")
    seen = seen.where(F.col("km") - F.col("start_km") >= rules.least_day_km)
    rows = seen.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("n", "km", "off", "network", "hut_id", "rejected"))).alias("rows"))
    nothing = F.lit(None).cast("struct<n:int,km:double,off:double,network:boolean,hut_id:bigint,rejected:boolean>")
    best = rows.select("req_id", F.aggregate("rows", nothing, lambda a, x: _merged(a, x, rules.slack_m)).alias("best"))
    last = chosen.where(F.col("n") == F.col("end_n")).select("req_id", F.struct("hut_id", "dist_m", "rejected").alias("last"))
    bad = lambda h, d: F.coalesce((d > rules.near_m) | h["rejected"], F.lit(True))
    b, l = F.col("best"), F.col("last")
    return todo.join(best, "req_id", "left").join(last, "req_id", "left").select(
        "req_id", F.coalesce(b["km"], F.col("window_km")).alias("end_km"), F.when(b.isNotNull(), b["hut_id"]).otherwise(l["hut_id"]).alias("hut_id"),
        F.when(b.isNotNull(), bad(b, b["off"])).otherwise(bad(l, l["dist_m"])).alias("gap"))


def _whole_trips(sent, rules: dict, most_km: float):
    """For mapInArrow: all days of each trip (req_id, shape), the same as of rounds of _one_day.

    ``sent``: a broadcast of the huts' lat, lon, network, rejected (-1: null) in the order of their ids.
    Workers need nothing but numpy: the functions go with their closure.
    """

    def metres(lat1, lon1, lat2, lon2):
        h = np.sin(np.radians(lat2 - lat1) / 2) ** 2 + np.cos(np.radians(lat1)) * np.cos(np.radians(lat2)) * np.sin(np.radians(lon2 - lon1) / 2) ** 2
        return 2 * r["earth_m"] * np.arcsin(np.sqrt(np.minimum(h, 1.0)))

    def to_mm(x):
        return np.floor(x * 1000 + 0.5) / 1000

    def at(cum, lat, lon, m):
        """Linear position at distances; clamps to the ends."""
        i = np.searchsorted(cum, m, side="right")
        a, b = np.clip(i - 1, 0, len(cum) - 1), np.clip(i, 0, len(cum) - 1)
        gap = cum[b] - cum[a]
        t = np.where(gap > 0, (m - cum[a]) / np.where(gap > 0, gap, 1.0), 0.0)
        return lat[a] + (lat[b] - lat[a]) * t, lon[a] + (lon[b] - lon[a]) * t

    def near(huts, lat, lon):
        """Indexes of the huts that may lie within reach of some place."""
        reach = max(r["network_m"], r["cabin_m"]) / 111_000.0
        ok = ~(np.isnan(lat) | np.isnan(lon))
        if not ok.any():
            return np.zeros(0, np.int64)
        lat, lon = lat[ok], lon[ok]
        found = (huts[0] >= lat.min() - reach) & (huts[0] <= lat.max() + reach)
        pole = np.abs(lat).max() + reach
        if pole < 85:
            wide = (lon.max() - lon.min()) / 2 + 1.01 * reach / np.cos(np.radians(pole))
            found &= np.abs((huts[1] - (lon.max() + lon.min()) / 2 + 180) % 360 - 180) <= wide
        return np.flatnonzero(found)

    def choose(huts, lat, lon):
        """(index, distance) of the best hut of every place, -1 without one; huts stand in the order of their ids."""
        if not len(huts[0]):
            return np.full(len(lat), -1), np.full(len(lat), np.nan)
        d = metres(lat[:, None], lon[:, None], huts[0], huts[1])
        net, rejected = huts[2], huts[3]
        within = ((net == 1) & (d <= r["network_m"])) | (d <= r["cabin_m"])
        close = d <= r["prefer_network_m"]
        second = np.where(net == 1, ~close, np.where((net == -1) & close, -1, 1))
        d = to_mm(d)
        key = np.where(within, (((rejected + 1) * 3 + second + 1) * 3 + net + 1) * 1e9 + d, np.inf)
        best = key.argmin(axis=1)
        row = np.arange(len(lat))
        held = np.isfinite(key[row, best])
        return np.where(held, best, -1), np.where(held, d[row, best], np.nan)

    def better(best, new):
        """Of (km, off, network): networks first, then the one clearly nearer to the route, then the farther along."""
        if best is None or (new[2] != best[2] and new[2] >= 0 and best[2] >= 0):
            return best is None or new[2] == 1
        apart = new[1] - best[1]
        return apart < 0 if abs(apart) > r["slack_m"] else new[0] > best[0] or (abs(new[0] - best[0]) < 1.0 and apart < 0)

    def day(huts, cum, lat, lon, start, window):
        """(end_km, hut or -1, gap)"""
        steps = int(np.floor((window - start - r["first_probe_km"]) / r["probe_km"] + 1e-9))
        km = np.append(start + r["first_probe_km"] + np.arange(max(steps + 1, 0)) * r["probe_km"], window)
        y, x = at(cum, lat, lon, km * 1000)
        own = near(huts, y, x)
        here = [h[own] for h in huts]
        hut, dist = choose(here, y, x)
        inside = (cum / 1000 >= start) & (cum / 1000 <= window) & ~(np.isnan(lat) | np.isnan(lon))
        s_km, s_lat, s_lon = cum[inside] / 1000, lat[inside], lon[inside]
        best, feet = None, {}
        for n in np.flatnonzero((hut[:-1] >= 0) & (dist[:-1] <= r["near_m"])):
            h = hut[n]
            if h not in feet and len(s_km):
                off = to_mm(metres(s_lat, s_lon, here[0][h], here[1][h]))
                i = np.lexsort((s_km, off))[0]
                feet[h] = s_km[i], off[i]
            at_km, off = feet.get(h, (km[n], dist[n]))
            new = (at_km, off, here[2][h], h)
            if at_km - start >= r["least_day_km"] and better(best, new):
                best = new
        if best is not None:
            return best[0], own[best[3]], bool(best[1] > r["near_m"] or here[3][best[3]] != 0)
        if hut[-1] < 0:
            return window, -1, True
        return window, own[hut[-1]], bool(dist[-1] > r["near_m"] or here[3][hut[-1]] != 0)

    def trip(huts, cum, lat, lon):
        total = cum.max() / 1000 if len(cum) else 0.0
        start, days = 0.0, []
        own = near(huts, lat, lon)  # all places of a trip lie between its samples
        here = [h[own] for h in huts]
        while start < total - 0.01 or (not days and total > 0.01):
            window = min(start + max(most_km, 1.0), total)
            if window >= total - 0.01:
                days.append((start, total, -1, False))
                break
            end, hut, gap = day(here, cum, lat, lon, start, window)
            stop = min(max(end, start + 0.01), total)
            days.append((start, stop, own[hut] if hut >= 0 else -1, gap))
            start = stop
        return days

    def run(batches):
        huts = sent.value
        number = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float64)
        for batch in batches:
            shape = batch.column(1)
            ends = np.cumsum(np.append(0, shape.value_lengths().to_numpy(zero_copy_only=False)))
            cum, lat, lon = (number(x) for x in shape.flatten().flatten())
            rows = [(i, n + 1, *d) for i in range(batch.num_rows) for n, d in enumerate(trip(huts, *(x[ends[i] : ends[i + 1]] for x in (cum, lat, lon))))]
            of, n, start, stop, hut, gap = (np.array(x) for x in zip(*rows)) if rows else (np.zeros(0),) * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(of, pa.int64())), pa.array(n, pa.int32()), pa.array(start, pa.float64()), pa.array(stop, pa.float64()), pa.array(hut, pa.int64()), pa.array(gap.astype(bool))],
                ["first", "day", "start_km", "end_km", "hut", "gap"])

    r = {**rules, "earth_m": geo.R_MEAN}
    return run


def _plan_whole(trips: DataFrame, huts: DataFrame, most_km: float, rules: HutRules) -> DataFrame:
    """Days of distinct trips (req_id, shape), each planned whole by one worker, which has all huts."""
    spark = trips.sparkSession
    h = huts.select("hut_id", "lat", "lon", *(F.coalesce(F.col(c).cast("int"), F.lit(-1)).alias(c) for c in ("is_network", "rejected"))).where("lat is not null and lon is not null").orderBy("hut_id", "lat", "lon").toArrow()
    sent = spark.sparkContext.broadcast([h.column(c).to_numpy() for c in ("lat", "lon", "is_network", "rejected")])
    kind = trips.schema["req_id"].dataType.simpleString()
    days = trips.mapInArrow(_whole_trips(sent, asdict(rules), most_km), f"first {kind}, day int, start_km double, end_km double, hut long, gap boolean")
    names = spark.createDataFrame(pa.table({"hut": pa.array(range(h.num_rows), pa.int64()), "hut_id": h.column("hut_id")}))
    return cut(days).join(F.broadcast(names), "hut", "left").select("first", "day", "start_km", "end_km", "hut_id", "gap")


def plan_hikes(samples: DataFrame, huts: DataFrame, most_km: float = 40.0, rules: HutRules = HutRules()) -> DataFrame:
    """Days of trips with samples (req_id, pos, lat, lon, cum_m) and huts: req_id, day, start_km, end_km, hut_id, gap.

    A day's window starts where the day before ended.  Up to BROADCAST_HUTS huts
    go to all workers, which plan whole trips; with more, days are planned in
    rounds, one day of all unfinished trips each.  In a day every half
    kilometre from 8 km on asks for its overnight choice; huts near it stand at
    the window's sample nearest to them, and the best of them ends the day.
    Without one the day ends with the window and its choice.  ``gap``: the night
    has no safe hut near.  Every day but a trip's last is at least
    ``least_day_km`` or a whole window long, so rounds end.

    Defined cases: trips without length have no days; without huts all nights
    are gaps with a null hut; huts with null coordinates are never chosen; an
    empty table gives an empty result.
    """
    # trips over the same samples are planned once, and of equal huts at one place only the smallest id can be chosen
    shape = samples.groupBy("req_id").agg(F.array_sort(F.collect_list(F.struct("cum_m", "lat", "lon"))).alias("shape"))
    trips = cut(shape.select("req_id", F.min("req_id").over(W.partitionBy("shape")).alias("first"), "shape"))
    own = trips.where("req_id = first").select("req_id", "shape")
    trips = trips.select("req_id", "first")
    huts = cut(huts.groupBy("lat", "lon", "is_network", "rejected").agg(F.min("hut_id").alias("hut_id")))
    if huts.count() <= BROADCAST_HUTS:
        tasks = int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        days = _plan_whole(own.repartition(tasks, "req_id"), huts, most_km, rules)
        return trips.join(days, "first").select("req_id", "day", "start_km", "end_km", "hut_id", "gap")
    samples = cut(samples.join(trips.where("req_id = first"), "req_id", "left_semi").select("req_id", "pos", "lat", "lon", "cum_m"))
    total = samples.groupBy("req_id").agg((F.max("cum_m") / 1000).alias("total_km"))
    todo = cut(total.where("total_km > 0.01").select("req_id", F.lit(0.0).alias("start_km"), "total_km", F.lit(1).alias("day")))
    done = []
    while not todo.isEmpty():
        window = todo.withColumn("window_km", F.least(F.col("start_km") + max(most_km, 1.0), "total_km"))
        final = F.col("window_km") >= F.col("total_km") - 0.01
        ends = window.where(final).select("req_id", "day", "start_km", F.col("total_km").alias("end_km"), F.lit(None).cast("long").alias("hut_id"), F.lit(False).alias("gap"))
        on = window.where(~final)
        own = cut(on.join(_one_day(on, samples, huts, rules), "req_id"))
        stop = F.least(F.greatest("end_km", F.col("start_km") + 0.01), "total_km")
        done += [ends, own.select("req_id", "day", "start_km", stop.alias("end_km"), "hut_id", "gap")]
        todo = cut(own.select("req_id", stop.alias("start_km"), "total_km", (F.col("day") + 1).alias("day")).where("start_km < total_km - 0.01"))
    if not done:
        return todo.select("req_id", "day", "start_km", F.col("total_km").alias("end_km"), F.lit(None).cast("long").alias("hut_id"), F.lit(False).alias("gap"))
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return trips.join(out.withColumnRenamed("req_id", "first"), "first").select("req_id", "day", "start_km", "end_km", "hut_id", "gap")
