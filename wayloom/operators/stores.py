"""Saved rows as append-only tables, with upsert, delete, rename and typed configuration."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from wayloom.functions import geo
from wayloom.operators.search import latest_by_key

SCHEMAS = {
    "routes": "id string, name string, start_lat double, start_lon double, end_lat double, end_lon double, created_at timestamp, version long",
    "places": "id string, name string, lat double, lon double, kind string, created_at timestamp, version long",
    "config": "key string, value_json string, version long",
    "jobs": "job_id string, region string, status string, min_lat double, min_lon double, max_lat double, max_lon double, version long",
    "job_tiles": "job_id string, tile_id string, status string, source string, bytes long, version long",
    "place_names": "osm_type string, osm_id long, name string, kind string, lat double, lon double, version long",
}


def current(log: DataFrame, keys: list[str], deleted: DataFrame | None = None) -> DataFrame:
    """Latest version of each key, without deleted keys."""
    now = latest_by_key(log, keys, ["version"])
    return now if deleted is None else now.join(deleted.select(*keys).distinct(), keys, "left_anti")


def listing(log: DataFrame, keys: list[str], deleted: DataFrame | None = None) -> DataFrame:
    return current(log, keys, deleted).orderBy(F.col("created_at").desc(), *keys)


def rename(table: DataFrame, row_id: str, name: str) -> DataFrame:
    return table.withColumn("name", F.when(F.col("id") == row_id, F.lit(name)).otherwise(F.col("name")))


def load_config(log: DataFrame, key: str, schema: str, defaults: dict) -> DataFrame:
    """One row with the stored value's fields; missing keys and fields take their defaults."""
    empty = log.sparkSession.createDataFrame([(key,)], "key string")
    row = empty.join(current(log, ["key"]), "key", "left").select(F.from_json(F.coalesce("value_json", F.lit("{}")), schema).alias("v"))
    return row.select(*(F.coalesce(F.col(f"v.{k}"), F.lit(v)).alias(k) for k, v in defaults.items()))


def job_progress(tiles: DataFrame) -> DataFrame:
    return tiles.groupBy("job_id").agg(F.count_if(F.col("status") == "completed").alias("completed"), F.count("*").alias("total"))


def pending(tiles: DataFrame, job_id: str) -> DataFrame:
    return tiles.where((F.col("job_id") == job_id) & F.col("status").isin("pending", "downloading")).orderBy("tile_id")


def covering(jobs: DataFrame, lat: float, lon: float) -> DataFrame:
    return jobs.where((F.col("status") == "completed") & F.lit(lat).between(F.col("min_lat"), F.col("max_lat")) & F.lit(lon).between(F.col("min_lon"), F.col("max_lon")))


def write_tables(tables: dict[str, DataFrame], root: str, partition: dict[str, str] | None = None) -> None:
    """Each table as Parquet under ``root``; Spark's committer makes a table appear whole or not at all."""
    for name, df in tables.items():
        writer = df.write.mode("overwrite")
        if partition and name in partition:
            writer = writer.partitionBy(partition[name])
        writer.parquet(f"{root}/{name}")


def new_tiles(jobs: DataFrame, key: str) -> DataFrame:
    """(key, tile_id, status) of all 1 degree tiles that the boxes (south, west, north, east) of new jobs touch, pending."""
    span = lambda a, b: F.sequence(F.floor(a).cast("int"), F.floor(b).cast("int"))
    cells = jobs.withColumn("_y", F.explode(span("south", "north"))).withColumn("_x", F.explode(span("west", "east")))
    return cells.select(key, geo.dem_stem(F.col("_y").cast("double"), F.col("_x").cast("double")).alias("tile_id"), F.lit("pending").alias("status"))
