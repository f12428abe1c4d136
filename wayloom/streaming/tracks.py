"""Position streams: latest station rows, expiry, route progress and off-route actions.

Each operator is a stateful processor for ``groupBy(key).transformWithStateInPandas``
around a plain step function, so batch folds and streams share one rule.
Rows of a micro-batch are taken in event order; a late row still replaces the
latest one if its batch comes later (arrival order, as stations report).
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from wayloom.functions import geo

# Fixed limits: seconds, kilometres, metres and milliseconds.
TIMEOUT_MOST_S, RANGE_KM = 3600, (50.0, 150.0)
OFF_ROUTE_M = {"motor": 75.0, "hiking": 100.0}
CONFIRM_MS = 5000
VIA_M, END_M = 80.0, 60.0


def clamp_timeout(seconds):
    return F.least(F.lit(TIMEOUT_MOST_S), F.greatest(F.lit(1), seconds))


def clamp_range(km):
    return F.least(F.lit(RANGE_KM[1]), F.greatest(F.lit(RANGE_KM[0]), km))


def visible(stations: DataFrame, lat: float, lon: float, range_km: float) -> DataFrame:
    """Stations within the clamped range of a centre."""
    r = min(RANGE_KM[1], max(RANGE_KM[0], range_km))
    return stations.where(geo.haversine_m(lat, lon, F.col("lat"), F.col("lon"), geo.R_TRACKS) <= r * 1000)


def latest(stations: DataFrame) -> DataFrame:
    """Batch form of the upsert: each station's row of the largest t, then event_id."""
    rest = [c for c in stations.columns if c != "station"]
    return stations.groupBy("station").agg(F.max_by(F.struct(*rest), F.struct("t", "event_id")).alias("r")).select("station", "r.*")


def expire(rows: DataFrame, now: int, timeout_s: int) -> DataFrame:
    """Stations not heard for more than the timeout."""
    return rows.where(F.lit(now) - F.col("t") > min(TIMEOUT_MOST_S, max(1, timeout_s)))


class TrackStore(StatefulProcessor):
    """Emits (station, outcome, t, lat, lon) for each update; state is the latest row, with a time to live."""

    def __init__(self, timeout_s: int = 900):
        self.timeout_ms = min(TIMEOUT_MOST_S, max(1, timeout_s)) * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("station", "t long, lat double, lon double", self.timeout_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        for pdf in rows:
            last = pdf.sort_values(["t", "event_id"]).iloc[-1]
            outcome = "updated" if self.state.exists() else "created"
            self.state.update((int(last.t), float(last.lat), float(last.lon)))
            yield pd.DataFrame({"station": [key[0]], "outcome": [outcome], "t": [int(last.t)], "lat": [float(last.lat)], "lon": [float(last.lon)]})

    def close(self) -> None:
        pass


TRACK_SCHEMA = "station long, outcome string, t long, lat double, lon double"


def track_stream(fixes: DataFrame, timeout_s: int = 900) -> DataFrame:
    """Streaming upsert; needs the RocksDB state store provider."""
    return fixes.groupBy("station").transformWithStateInPandas(TrackStore(timeout_s), TRACK_SCHEMA, "Update", "ProcessingTime")


def off_route_step(state: tuple, off: bool, busy: bool, now_ms: int, confirm_ms: int = CONFIRM_MS) -> tuple[tuple, str]:
    """((since, acted), action): one reroute after being off for confirm_ms, silent until back on the route."""
    since, acted = state
    if not off:
        return (None, False), "none"
    since = now_ms if since is None else since
    if acted or busy or now_ms - since < confirm_ms:
        return (since, acted), "none"
    return (since, True), "reroute"


class OffRoute(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("off", "since long, acted boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer) -> Iterator[pd.DataFrame]:
        state = tuple(self.state.get()) if self.state.exists() else (None, False)
        for pdf in rows:
            out = []
            for r in pdf.sort_values("now_ms").itertuples(index=False):
                state, action = off_route_step(state, bool(r.off), bool(r.busy), int(r.now_ms))
                if action != "none":
                    out.append((key[0], int(r.now_ms), action))
            yield pd.DataFrame(out, columns=["station", "now_ms", "action"])
        self.state.update(state)

    def close(self) -> None:
        pass


def off_route_batch(fixes: DataFrame) -> DataFrame:
    """(station, now_ms) of every reroute, by gaps and islands instead of state (no busy fixes).

    An island is a run of off-route fixes; it acts once, at the first fix
    CONFIRM_MS or more after the island began.
    """
    from pyspark.sql import Window as W

    w = W.partitionBy("station").orderBy("now_ms")
    i = fixes.withColumn("island", F.sum((~F.col("off")).cast("int")).over(w)).where("off")
    began = i.withColumn("since", F.min("now_ms").over(W.partitionBy("station", "island")))
    return began.where(F.col("now_ms") - F.col("since") >= CONFIRM_MS).groupBy("station", "island").agg(F.min("now_ms").alias("now_ms")).select("station", "now_ms")


def progress(fixes: DataFrame, samples: DataFrame, mode: str = "motor") -> DataFrame:
    """Nearest route sample of each fix and the off-route flag; along_m keeps its last on-route value while off."""
    from pyspark.sql import Window as W

    d = geo.haversine_atan2_m(F.col("lat"), F.col("lon"), F.col("s_lat"), F.col("s_lon"))
    s = samples.select("req_id", F.col("lat").alias("s_lat"), F.col("lon").alias("s_lon"), "cum_m")
    near = fixes.join(s, "req_id").groupBy("req_id", "event_id", "t").agg(F.min(F.struct(F.round(d, 3).alias("d"), F.col("cum_m"))).alias("m"))
    off = F.col("m.d") > OFF_ROUTE_M[mode]
    w = W.partitionBy("req_id").orderBy("t", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return near.select("req_id", "event_id", F.col("m.d").alias("dist_m"), off.alias("off"), F.last(F.when(~off, F.col("m.cum_m")), True).over(w).alias("along_m"))


def windowed_speed(fixes: DataFrame, late: str = "10 minutes", size: str = "5 minutes") -> DataFrame:
    """Mean speed by event-time window; rows later than the watermark are dropped by design."""
    return fixes.withWatermark("ts", late).groupBy(F.window("ts", size), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("speed"))


def imu_step(angle: tuple[float, float], gyro: tuple[float, float], accel: tuple[float, float, float], dt: float, alpha: float = 0.98) -> tuple[float, float]:
    """Complementary filter of pitch and roll in degrees."""
    import math

    ax, ay, az = accel
    pitch, roll = math.degrees(math.atan2(-ax, math.hypot(ay, az))), math.degrees(math.atan2(ay, az))
    return alpha * (angle[0] + gyro[1] * dt) + (1 - alpha) * pitch, alpha * (angle[1] + gyro[0] * dt) + (1 - alpha) * roll


def from_gpsd(lines: DataFrame) -> DataFrame:
    """TPV reports (column value, JSON) with a fix to positions; null speed and course count as 0."""
    j = F.from_json("value", "class string, mode int, lat double, lon double, alt double, speed double, track double, eph double")
    p = lines.select(j.alias("j")).where("j.class = 'TPV' and j.mode >= 2 and j.lat is not null and j.lon is not null")
    return p.select("j.lat", "j.lon", "j.alt", F.coalesce("j.speed", F.lit(0.0)).alias("speed"), F.coalesce("j.track", F.lit(0.0)).alias("course"), "j.eph")
