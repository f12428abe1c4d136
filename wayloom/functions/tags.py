"""Classification of map features from their tag maps."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Tag values, categories in their sort order, name hints.
CATEGORIES = ("water", "cabin", "general", "network_hut", "restroom", "overnight_facility", "craft_brewery", "tent_site", "fishing", "rest_area", "lodging")
HUT_NETWORKS = ("DNT", "STF", "DAV", "SAC", "OeAV", "Metsähallitus", "Metsahallitus")
HIKING_NETWORKS, CYCLING_NETWORKS = ("iwn", "nwn", "rwn", "lwn"), ("icn", "ncn", "rcn", "lcn")
HIKING_ROUTES, CYCLING_ROUTES = ("hiking", "foot"), ("bicycle", "mtb")
PILGRIM_HINTS = (
    "pilegrimsled", "pilegrim", "pilgrim", "camino", "way of st. james", "way of saint james", "via francigena", "jakobswege", "jakobsweg", "st olav",
    "st. olav", "olavsleden",
)
PILGRIM_KEYS = ("name", "name:en", "name:nb", "name:no", "operator", "ref")
DEAD_RAIL = ("abandoned", "disused", "razed", "dismantled")
BARRIER_WATER = ("river", "canal", "tidal_channel", "fairway")
SOFT_WETLAND, HARD_WETLAND = ("bog", "string_bog", "fen"), ("swamp", "reedbed")


def tag(tags: Column, key: str) -> Column:
    return F.try_element_at(tags, F.lit(key))


def _is(value: Column, *options: str) -> Column:
    return F.coalesce(value.isin(*options), F.lit(False))


def poi_categories(tags: Column) -> Column:
    """Sorted distinct categories; a feature may have several."""
    t = lambda k: tag(tags, k)
    amenity, tourism, natural = t("amenity"), t("tourism"), t("natural")
    hut = _is(tourism, "wilderness_hut", "alpine_hut")
    operated = F.lit(False)
    for n in HUT_NETWORKS:
        operated = operated | F.coalesce(F.coalesce(t("operator"), t("network")).contains(n), F.lit(False))
    shelter = _is(tourism, "wilderness_hut", "alpine_hut", "hostel", "camp_site", "camp_pitch") | _is(amenity, "shelter")
    hgv = _is(t("hgv"), "yes", "designated") | _is(t("access:hgv"), "yes", "designated")
    tests = {
        "water": _is(amenity, "drinking_water", "fountain", "water_point") | _is(natural, "spring"),
        "cabin": shelter,
        "general": _is(amenity, "cafe", "restaurant", "fast_food", "museum", "gallery", "zoo", "aquarium", "viewpoint", "picnic_site") | _is(tourism, "viewpoint", "attraction", "museum"),
        "network_hut": hut & operated,
        "overnight_facility": shelter,
        "tent_site": _is(tourism, "camp_site", "camp_pitch") | _is(amenity, "camping"),
        "restroom": _is(amenity, "toilets"),
        "craft_brewery": _is(t("microbrewery"), "yes") | _is(t("shop"), "alcohol") | _is(t("craft"), "brewery"),
        "fishing": _is(t("leisure"), "fishing", "fishing_pier") | _is(t("sport"), "fishing") | _is(t("shop"), "fishing"),
        "rest_area": _is(t("highway"), "rest_area", "services") | (_is(amenity, "parking") & hgv),
        "lodging": _is(tourism, "hotel", "motel", "guest_house", "apartment", "chalet", "hostel"),
    }
    return F.array_compact(F.array(*(F.when(tests[c], F.lit(c)) for c in CATEGORIES)))


def icon_key(tags: Column) -> Column:
    t = lambda k: tag(tags, k)
    named = [F.concat(F.lit(f"{k}-"), t(k)) for k in ("amenity", "tourism", "natural", "leisure", "shop", "highway")]
    brewery = _is(t("microbrewery"), "yes") | _is(t("craft"), "brewery") | _is(t("shop"), "alcohol")
    fishing = _is(t("leisure"), "fishing", "fishing_pier") | _is(t("sport"), "fishing") | _is(t("shop"), "fishing")
    return F.when(brewery, "shop-alcohol").when(fishing, "leisure-fishing").otherwise(F.coalesce(*named, F.lit("poi-generic")))


def weekly_rest_suitable(tags: Column, icon: Column) -> Column:
    return _is(tag(tags, "highway"), "services") | F.coalesce(icon.contains("services"), F.lit(False)) | F.coalesce(F.lower(tag(tags, "name")).contains("service"), F.lit(False))


def wetland_class(tags: Column) -> Column:
    """hard, soft or null."""
    v = F.lower(F.trim(tag(tags, "wetland")))
    return F.when(v.isin(*HARD_WETLAND), "hard").when(v.isin(*SOFT_WETLAND), "soft").when(_is(tag(tags, "natural"), "wetland"), "soft")


def boardwalk(bridge: Column, surface: Column) -> Column:
    return _is(F.lower(F.trim(bridge)), "boardwalk") | _is(F.lower(F.trim(surface)), "wood")


def barrier_kind(tags: Column) -> Column:
    """line, glacier or null."""
    rail, natural = tag(tags, "railway"), tag(tags, "natural")
    line = (rail.isNotNull() & ~_is(rail, *DEAD_RAIL)) | _is(tag(tags, "waterway"), *BARRIER_WATER) | _is(natural, "cliff", "arete")
    return F.when(line, "line").when(_is(natural, "glacier"), "glacier")


def official_route(tags: Column, kind: str = "hiking") -> Column:
    routes, networks = (HIKING_ROUTES, HIKING_NETWORKS) if kind == "hiking" else (CYCLING_ROUTES, CYCLING_NETWORKS)
    low = lambda k: F.lower(tag(tags, k))
    return _is(low("type"), "route") & _is(low("route"), *routes) & _is(low("network"), *networks)


def pilgrim_route(tags: Column) -> Column:
    low = lambda k: F.lower(tag(tags, k))
    hinted = F.lit(False)
    for key in PILGRIM_KEYS:
        for hint in PILGRIM_HINTS:
            hinted = hinted | F.coalesce(low(key).contains(hint), F.lit(False))
    return _is(low("type"), "route") & (_is(low("route"), "pilgrimage") | (_is(low("route"), *HIKING_ROUTES) & hinted))


def named_feature(tags: Column) -> tuple[Column, Column]:
    """(name, kind) from an array of structs (k, v): the last kind tag in order wins."""
    one = lambda k: F.element_at(F.filter(tags, lambda x: x["k"] == k), -1)["v"]
    has = lambda k: F.exists(tags, lambda x: x["k"] == k)
    kinds = F.filter(tags, lambda x: x["k"].isin("place", "tourism", "leisure", "highway", "amenity", "shop") | ((x["k"] == "natural") & (x["v"] == "peak")))
    kind = F.when(F.size(kinds) > 0, F.concat(F.element_at(kinds, -1)["k"], F.lit(":"), F.element_at(kinds, -1)["v"]))
    street, number = F.when(has("addr:street"), one("addr:street")), F.when(has("addr:housenumber"), one("addr:housenumber"))
    own = F.when(has("name"), one("name"))
    name = F.coalesce(own, F.concat(street, F.lit(" "), number), street)
    fallback = F.when(own.isNotNull(), "named").when(number.isNotNull(), "addr:housenumber").otherwise("addr:street")
    return name, F.when(name.isNotNull(), F.coalesce(kind, fallback))
