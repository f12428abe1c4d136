"""Texts and small documents: update addresses and states, place objects, waypoint lists, range reports."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from wayloom.functions import energy
from wayloom.functions.roads import diff_path

# The public extract server, break and day distances in km, pack of an electric car.
EXTRACTS = "https://download.geofabrik.de"
BREAK_KM = {"hiking": (11.295, 2.275), "cycling": (28.24, 5.69), "cycling_electric": (28.24, 5.69)}
DAY_KM = {"hiking": 40.0, "cycling": 100.0, "cycling_electric": 100.0}
CAR_PACK_KWH, CAR_EFFICIENCY = 60.0, 0.85


def latest_url(region: Column) -> Column:
    return F.concat(F.lit(EXTRACTS + "/"), region, F.lit("-latest.osm.pbf"))


def diff_url(region: Column, sequence: Column) -> Column:
    return F.concat(F.lit(EXTRACTS + "/"), region, F.lit("-updates/"), diff_path(sequence), F.lit(".osc.gz"))


def update_state(text: Column) -> Column:
    """struct (sequence, timestamp) of a state file: the last line of each key counts; null if one is missing or no number."""
    last = lambda key: F.element_at(F.regexp_extract_all(F.concat(F.lit("\n"), text), F.lit(rf"\n\s*{key}=([^\n]*)"), F.lit(1)), -1)
    lines = lambda key: F.regexp_count(F.concat(F.lit("\n"), text), F.lit(rf"\n\s*{key}=")) > 0
    seq = F.when(lines("sequenceNumber"), F.trim(last("sequenceNumber")).try_cast("bigint"))
    at = F.when(lines("timestamp"), F.regexp_replace(F.trim(last("timestamp")), r"\\", ""))
    return F.when(seq.isNotNull() & at.isNotNull(), F.struct(seq.alias("sequence"), at.alias("timestamp")))


def place_json(name: Column, lat: Column, lon: Column, kind: Column) -> Column:
    """{"name":..,"lat":..,"lon":..,"kind":..}; whole numbers without a fraction, quotes and backslashes escaped."""
    own = lambda s: F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), '"', r'\\"')
    number = lambda x: F.regexp_replace(x.cast("string"), r"\.0$", "")
    return F.concat(F.lit('{"name":"'), own(name), F.lit('","lat":'), number(lat), F.lit(',"lon":'), number(lon), F.lit(',"kind":"'), own(kind), F.lit('"}'))


def waypoints(text: Column) -> Column:
    """array (name, lat, lon) of a JSON list; null if it is no list, has fewer than two, or one lacks a field."""
    got = F.from_json(text, "array<struct<name:string,lat:double,lon:double>>")
    whole = F.forall(got, lambda w: w["name"].isNotNull() & w["lat"].isNotNull() & w["lon"].isNotNull())
    return F.when((F.size(got) >= 2) & whole, got)


def break_distance_km(profile: Column, main: Column) -> Column:
    """Distance to the next break, main or alternative; null for profiles that break by the hour."""
    out = F.lit(None).cast("double")
    for name, (long, short) in BREAK_KM.items():
        out = F.when(profile == name, F.when(main, long).otherwise(short)).otherwise(out)
    return out


def day_distance_km(profile: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, km in DAY_KM.items():
        out = F.when(profile == name, km).otherwise(out)
    return out


def category_radius_m(category: Column, radii: dict[str, float]) -> Column:
    """Search radius of a place category from the radii of water, cabin, general, network_hut and restroom."""
    general = radii["general"]
    own = {**{c: radii[c] for c in ("water", "cabin", "network_hut", "restroom")}, "overnight_facility": radii["cabin"], "tent_site": radii["cabin"], "rest_area": max(general, 20_000.0), "lodging": max(general, 20_000.0)}
    out = F.lit(general)
    for name, r in own.items():
        out = F.when(category == name, F.lit(r)).otherwise(out)
    return out


def car_range(mechanical_j: Column, pack_kwh: Column) -> Column:
    """struct (capacity_wh, draw_wh, pct) of an electric car; an unset or non-positive pack is CAR_PACK_KWH."""
    wh = F.when(pack_kwh > 0, pack_kwh).otherwise(F.lit(CAR_PACK_KWH)) * 1000
    draw = energy.battery_wh(mechanical_j, CAR_EFFICIENCY)
    return F.struct(wh.alias("capacity_wh"), draw.alias("draw_wh"), (draw / wh * 100).alias("pct"))


def ebike_report(mechanical_j: Column, capacity_wh: float, efficiency: float, force_n: Column, most_pct: Column, steep: Column, worst_pct: Column, worst_m: Column) -> Column:
    """Lines on the battery, the climb and, with steep parts, the worst of them."""
    draw = energy.battery_wh(mechanical_j, efficiency)
    pct = draw / capacity_wh * 100
    head = F.format_string("ebike_battery_wh=%.0f; ebike_draw_wh=%.1f; ebike_pct_of_capacity=%.1f; ebike_motor_eff=%.2f; ebike_mech_j=%.0f\n", F.lit(capacity_wh), draw, pct, F.lit(efficiency), mechanical_j)
    climb = F.format_string("ebike_tractive_n=%.1f; ebike_max_grade_pct=%.1f\n", force_n, most_pct)
    ok = F.when(steep == 0, F.lit("ebike_climb_ok=true\n")).otherwise(
        F.format_string("ebike_climb_ok=false; ebike_steep_segments=%d\nsteepest: %.0f%% over %.0f m, the motor alone climbs %.0f%%\n", steep, worst_pct, worst_m, most_pct))
    return F.concat(head, climb, ok)
