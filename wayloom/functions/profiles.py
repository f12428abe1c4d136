"""Travel profiles: what each may use, its daily budget, and small rules about stops and places."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Profile names, their groups, pace and budgets, country boxes (south, west, north, east).
PROFILES = ("car", "car_electric", "truck", "truck_electric", "mobile_home", "hiking", "cycling", "cycling_electric", "motorcycle", "motorcycle_electric")
TRUCKS = ("truck", "truck_electric")
CYCLES = ("cycling", "cycling_electric")
MOTOR = ("car", "car_electric", "motorcycle", "motorcycle_electric", "truck", "truck_electric", "mobile_home")
MENU = ("car", "cycling", "cycling_electric", "hiking", "motorcycle", "truck", "mobile_home")
CAR_HOURS, CYCLE_KM = 8.0, 100.0
REMINDER_DAYS = 7
VIA_SHARE = 0.15
COUNTRY_BOXES = {
    "no": (57.9, 4.5, 71.5, 31.5),
    "se": (55.0, 10.0, 69.5, 24.5),
    "fi": (59.5, 19.0, 70.5, 32.0),
    "de": (47.0, 5.5, 55.5, 15.5),
    "ch": (45.5, 5.5, 48.0, 10.8),
    "at": (46.0, 9.0, 49.5, 17.5),
    "fr": (41.0, -5.5, 51.5, 10.0),
    "gb": (49.5, -8.5, 61.0, 2.0),
    "us": (24.0, -125.0, 50.0, -66.0),
    "ie": (51.4, -10.5, 55.5, -5.9),
    "is": (63.2, -24.6, 66.6, -13.4),
    "be": (49.4, 2.5, 51.6, 6.5),
    "nl": (50.7, 3.3, 53.6, 7.3),
    "dk": (54.5, 8.0, 57.8, 12.8),
    "pl": (49.0, 14.0, 54.9, 24.2),
    "it": (36.6, 6.6, 47.1, 18.6),
    "es": (35.9, -9.4, 43.8, 3.4),
    "pt": (36.9, -9.6, 42.2, -6.1),
}


def uses_truck_rest(profile: Column) -> Column:
    return profile.isin(*TRUCKS)


def uses_motor_days(profile: Column) -> Column:
    """Planned in days of a soft budget: neither trucks nor hikers."""
    return profile.isin(*PROFILES) & ~profile.isin(*TRUCKS, "hiking")


def flags(profile: Column) -> dict[str, Column]:
    return {
        "eco_default": profile.isin("hiking", *CYCLES), "eco_toggle": profile.isin(*MOTOR), "menu_focus": profile.isin(*MENU), "toll_ferry_avoid": profile.isin(*MOTOR),
        "clearance_limits": profile.isin(*TRUCKS, "mobile_home"), "truck_rest": uses_truck_rest(profile), "motor_days": uses_motor_days(profile),
    }


def daily_budget(profile: Column, car_hours: Column, cycle_km: Column) -> Column:
    """struct (hours, km): the set one is the budget; null for profiles without one; unset or non-positive wishes take the default."""
    hours = F.when(car_hours > 0, car_hours).otherwise(F.lit(CAR_HOURS))
    km = F.when(cycle_km > 0, cycle_km).otherwise(F.lit(CYCLE_KM))
    own = uses_motor_days(profile)
    return F.struct(F.when(own & ~profile.isin(*CYCLES), hours).alias("hours"), F.when(own & profile.isin(*CYCLES), km).alias("km"))


def named_hut(kind: Column, name: Column) -> Column:
    """A hut with a name of its own, not one made of "Hut" and digits."""
    own = F.trim(F.coalesce(name, F.lit("")))
    return F.coalesce(kind.isin("hut", "network_hut"), F.lit(False)) & (own != "") & ~own.rlike("^Hut [0-9]*$")


def reminder_due(opted_in: Column, checked: Column, now: Column) -> Column:
    """Opted in, and the last check is REMINDER_DAYS whole days ago or more (Unix seconds)."""
    return opted_in & (F.floor((now - checked) / 86_400) >= REMINDER_DAYS)


def via_allowance_m(leg_m: Column, cabin_radius_m: Column) -> Column:
    return F.greatest(cabin_radius_m, leg_m * VIA_SHARE)


def sane_radius_m(radius: Column) -> Column:
    return F.least(F.lit(100_000.0), F.greatest(F.lit(500.0), radius))


def truck_break_parts(split: Column) -> Column:
    """Minutes of the parts of the break that a driving block needs."""
    return F.when(split, F.array(F.lit(15), F.lit(30))).otherwise(F.array(F.lit(45)))


def country_box(code: Column) -> Column:
    """struct (south, west, north, east) of a country code in any case; null if unknown."""
    table = F.create_map(*(x for k, v in COUNTRY_BOXES.items() for x in (F.lit(k), F.struct(*(F.lit(n).alias(c) for n, c in zip(v, ("south", "west", "north", "east")))))))
    return F.try_element_at(table, F.lower(code))
