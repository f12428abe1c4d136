"""Geometry on latitude/longitude columns (degrees); every function returns a Column."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Earth radii in metres and metres a degree.
R_GRAPH = 6_378_100.0
R_TRACKS = 6_371_000.0
R_MEAN = 6_371_008.8
M_PER_DEG = 111_320.0


def _c(x) -> Column:
    return x if isinstance(x, Column) else F.lit(float(x))


def haversine_m(lat1, lon1, lat2, lon2, radius: float = R_GRAPH) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.asin(F.sqrt(F.when(h > 1, F.lit(1.0)).otherwise(h)))  # least() would skip nulls


def haversine_atan2_m(lat1, lon1, lat2, lon2, radius: float = R_TRACKS) -> Column:
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), F.lit(2.0)) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), F.lit(2.0))
    return F.lit(2 * radius) * F.atan2(F.sqrt(h), F.sqrt(F.when(h > 1, F.lit(0.0)).otherwise(1 - h)))


def bearing_deg(lat1, lon1, lat2, lon2) -> Column:
    """Initial bearing, 0 to 360."""
    lat1, lon1, lat2, lon2 = map(_c, (lat1, lon1, lat2, lon2))
    dlon = F.radians(lon2 - lon1)
    y = F.sin(dlon) * F.cos(F.radians(lat2))
    x = F.cos(F.radians(lat1)) * F.sin(F.radians(lat2)) - F.sin(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.cos(dlon)
    return F.pmod(F.degrees(F.atan2(y, x)) + 360.0, F.lit(360.0))


def turn_delta_deg(inbound: Column, outbound: Column) -> Column:
    """Signed change of bearing, -180 to 180; right is positive."""
    d = outbound - inbound
    return F.when(d > 180, d - 360).when(d < -180, d + 360).otherwise(d)


def adjust_delta_deg(delta: Column, reference: Column) -> Column:
    return F.when((delta >= 0) & (delta - reference > 180), delta - 360).when((delta <= 0) & (reference - delta > 180), delta + 360).otherwise(delta)


def half_away(x: Column) -> Column:
    """Rounds halves away from zero."""
    return F.when(x < 0, -F.floor(-x + 0.5)).otherwise(F.floor(x + 0.5))


def roundabout_sector(delta: Column) -> Column:
    """Clock-face sector 0 to 8 of an entry-to-exit change of bearing."""
    n = F.lit(202) - half_away(delta)
    return F.greatest(F.lit(0), F.least(F.lit(8), F.when(n < 0, F.ceil(n / 45)).otherwise(F.floor(n / 45)))).cast("int")


def roundabout_icon(delta: Column, leave_delta: Column, straight_delta: Column) -> Column:
    s = F.greatest(roundabout_sector(delta), F.lit(1))
    left = F.when(s == 8, F.lit(8)).otherwise(F.lit(8) - s)
    return F.when(leave_delta < straight_delta, F.concat(F.lit("nav_roundabout_l"), left.cast("string"))).otherwise(F.concat(F.lit("nav_roundabout_r"), s.cast("string")))


def m_per_lon(lat: Column) -> Column:
    """Metres a degree of longitude at a latitude."""
    return F.lit(M_PER_DEG) * F.cos(F.radians(lat))


def point_segment_m(lat, lon, a_lat, a_lon, b_lat, b_lon, kx: Column | None = None) -> Column:
    """Distance to a segment on a local plane at the point; to A by great circle if A and B nearly meet.  kx: m_per_lon(lat), if it is known."""
    lat, lon, a_lat, a_lon, b_lat, b_lon = map(_c, (lat, lon, a_lat, a_lon, b_lat, b_lon))
    kx = m_per_lon(lat) if kx is None else kx
    ax, ay, bx, by = (a_lon - lon) * kx, (a_lat - lat) * M_PER_DEG, (b_lon - lon) * kx, (b_lat - lat) * M_PER_DEG
    dx, dy = bx - ax, by - ay
    len2 = dx * dx + dy * dy
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), -(ax * dx + ay * dy) / len2))
    x, y = ax + t * dx, ay + t * dy
    return F.when(len2 < 1.0, haversine_m(lat, lon, a_lat, a_lon)).otherwise(F.sqrt(x * x + y * y))


def offset_lat(lat: Column, north_m: Column) -> Column:
    return lat + north_m / M_PER_DEG


def offset_lon(lat: Column, lon: Column, east_m: Column) -> Column:
    return lon + east_m / (M_PER_DEG * F.cos(F.radians(lat)))


def interpolate(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def orientation(ax, ay, bx, by, cx, cy) -> Column:
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def segment_box(px, py, qx, qy, slack: float = 1e-12) -> tuple[Column, Column, Column, Column]:
    """Least and greatest x, least and greatest y of a segment, widened by the slack."""
    return F.least(px, qx) - slack, F.greatest(px, qx) + slack, F.least(py, qy) - slack, F.greatest(py, qy) + slack


def segments_intersect(ax, ay, bx, by, cx, cy, dx, dy, slack: float = 1e-12, ab: tuple | None = None, cd: tuple | None = None) -> Column:
    """Proper crossings and touches, collinear ones included.  ab, cd: segment_box of both, if they are known.

    Short on purpose: a join whose code exceeds 8000 bytes is never compiled by the JVM.
    """
    o1, o2 = orientation(ax, ay, bx, by, cx, cy), orientation(ax, ay, bx, by, dx, dy)
    o3, o4 = orientation(cx, cy, dx, dy, ax, ay), orientation(cx, cy, dx, dy, bx, by)
    ab, cd = ab or segment_box(ax, ay, bx, by, slack), cd or segment_box(cx, cy, dx, dy, slack)

    def on(o, box, rx, ry):
        return (F.abs(o) <= slack) & (rx >= box[0]) & (rx <= box[1]) & (ry >= box[2]) & (ry <= box[3])

    cross = (F.signum(o1) * F.signum(o2) < 0) & (F.signum(o3) * F.signum(o4) < 0)
    return cross | on(o1, ab, cx, cy) | on(o2, ab, dx, dy) | on(o3, cd, ax, ay) | on(o4, cd, bx, by)


def edge_crossings(lon: Column, lat: Column, ring: Column) -> Column:
    """Number of ring edges that a ray from the point crosses (ring: array of structs lon, lat)."""
    n = F.size(ring)

    def crosses(i):
        a, b = ring[i - 1], F.when(i == 1, ring[n - 1]).otherwise(ring[i - 2])
        straddles = (a["lat"] > lat) != (b["lat"] > lat)
        x = (b["lon"] - a["lon"]) * (lat - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]
        return straddles & (lon < x)

    return F.size(F.filter(F.sequence(F.lit(1), n), crosses))


def point_in_ring(lon: Column, lat: Column, ring: Column) -> Column:
    """Even-odd rule; false for rings of fewer than three points."""
    return F.when(F.size(ring) >= 3, edge_crossings(lon, lat, ring) % 2 == 1).otherwise(F.lit(False))


def in_bbox(lat: Column, lon: Column, bbox: tuple[float, float, float, float]) -> Column:
    return lat.between(bbox[0], bbox[2]) & lon.between(bbox[1], bbox[3])


def tile_x(lon: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor((lon + 180.0) / 360.0 * n))).cast("int")


def tile_y(lat: Column, z: Column) -> Column:
    n = F.pow(F.lit(2.0), z)
    r = F.radians(F.greatest(F.lit(-85.0511), F.least(F.lit(85.0511), lat)))
    return F.greatest(F.lit(0.0), F.least(n - 1, F.floor((1 - F.log(F.tan(r) + 1 / F.cos(r)) / F.lit(3.141592653589793)) / 2 * n))).cast("int")


def dem_stem(lat: Column, lon: Column) -> Column:
    """Name of the 1 degree tile of a point, such as N61E009."""
    y, x = F.floor(lat).cast("int"), F.floor(lon).cast("int")
    return F.concat(F.when(y < 0, "S").otherwise("N"), F.lpad(F.abs(y).cast("string"), 2, "0"), F.when(x < 0, "W").otherwise("E"), F.lpad(F.abs(x).cast("string"), 3, "0"))


def parse_dem_stem(stem: Column) -> tuple[Column, Column]:
    ok = stem.rlike("^[NS][0-9]{2}[EW][0-9]{3}$")
    lat = F.substring(stem, 2, 2).try_cast("int") * F.when(F.substring(stem, 1, 1) == "S", -1).otherwise(1)
    lon = F.substring(stem, 5, 3).try_cast("int") * F.when(F.substring(stem, 4, 1) == "W", -1).otherwise(1)
    return F.when(ok, lat), F.when(ok, lon)
