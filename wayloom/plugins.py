"""Extension surface: manifests with capabilities, a gate, and calls under a wall clock.

A plugin is a Python callable; what it may do is what its host object offers
for the capabilities that both its manifest and the host's policy name.  There
is no instruction budget in Spark, only the clock.
"""

from __future__ import annotations

import concurrent.futures
import json
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from wayloom.functions import geo

CAPABILITIES = frozenset({"log", "position", "poi_query", "poi_write"})


class PluginError(ValueError):
    pass


@dataclass(frozen=True)
class Manifest:
    name: str
    version: str
    capabilities: frozenset[str]

    @classmethod
    def parse(cls, text: str) -> "Manifest":
        try:
            raw = json.loads(text)
            name, version, wanted = raw["name"], raw["version"], raw["capabilities"]
        except (ValueError, KeyError, TypeError) as e:
            raise PluginError(f"bad manifest: {e}") from e
        if not name or not isinstance(wanted, list) or not wanted:
            raise PluginError("a manifest needs a name and at least one capability")
        if unknown := set(wanted) - CAPABILITIES:
            raise PluginError(f"unknown capabilities: {sorted(unknown)}")
        return cls(name, version, frozenset(wanted))


@dataclass
class Host:
    """What a plugin sees; methods without their capability raise."""

    allowed: frozenset[str]
    pois: DataFrame | None = None
    where: tuple[float, float] | None = None
    written: list[dict] = field(default_factory=list)
    lines: list[str] = field(default_factory=list)

    def _need(self, capability: str) -> None:
        if capability not in self.allowed:
            raise PluginError(f"capability not granted: {capability}")

    def log(self, text: str) -> None:
        self._need("log")
        self.lines.append(text)

    def position(self) -> tuple[float, float] | None:
        self._need("position")
        return self.where

    def poi_query(self, lat: float, lon: float, radius_m: float, limit: int = 100) -> list[Row]:
        self._need("poi_query")
        dist = geo.haversine_m(lat, lon, F.col("lat"), F.col("lon"), geo.R_MEAN)
        return self.pois.withColumn("dist_m", dist).where(F.col("dist_m") <= radius_m).orderBy("dist_m").limit(limit).collect()

    def poi_write(self, name: str, lat: float, lon: float, kind: str) -> None:
        self._need("poi_write")
        self.written.append({"name": name, "lat": lat, "lon": lon, "kind": kind})


def load(text: str, policy: frozenset[str]) -> Manifest:
    m = Manifest.parse(text)
    if refused := m.capabilities - policy:
        raise PluginError(f"host refuses: {sorted(refused)}")
    return m


def call(plugin: Callable[[Host], object], host: Host, seconds: float) -> tuple[str, object]:
    """('ok', result) or ('timeout', None); a plugin's own error is raised."""
    pool = concurrent.futures.ThreadPoolExecutor(1)
    try:
        return "ok", pool.submit(plugin, host).result(seconds)
    except concurrent.futures.TimeoutError:
        return "timeout", None
    finally:
        pool.shutdown(wait=False, cancel_futures=True)


def register_sql(spark: SparkSession, name: str, f: Callable, returns: str, manifest: Manifest) -> None:
    """Makes a plugin's scalar function callable from SQL under its own prefix."""
    spark.udf.register(f"{manifest.name}_{name}", F.pandas_udf(f, returns))
