"""Height tiles and tile archives."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from wayloom.functions import geo
from wayloom.sources.osm_pbf import varint

VOID = -32768


def hgt_cells(files: DataFrame) -> DataFrame:
    """Rows (tile, row, col, h) of .hgt files (binaryFile columns path, content); voids are null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                grid = np.frombuffer(content, ">i2").astype(np.float64)
                n = int(round(len(grid) ** 0.5))
                row, col = np.divmod(np.arange(n * n), n)
                yield pd.DataFrame({"tile": path.rsplit("/", 1)[-1].split(".")[0], "size": n, "row": row, "col": col, "h": np.where(grid == VOID, np.nan, grid)})

    return files.select("path", "content").mapInPandas(run, "tile string, size int, row int, col int, h double").withColumn("h", F.nullif(F.col("h"), F.lit(float("nan"))))


def read_hgt(spark: SparkSession, folder: str) -> DataFrame:
    return hgt_cells(spark.read.format("binaryFile").option("pathGlobFilter", "*.hgt").load(folder))


def sample_heights(points: DataFrame, cells: DataFrame) -> DataFrame:
    """points plus h: the cell of each point's tile; null where the tile or the value is missing."""
    size = cells.groupBy("tile").agg(F.max("size").alias("size"))
    p = points.withColumn("tile", geo.dem_stem(F.col("lat"), F.col("lon"))).join(size, "tile", "left")
    frac = lambda c: F.col(c) - F.floor(c)
    p = p.withColumns({"row": F.round((1 - frac("lat")) * (F.col("size") - 1)).cast("int"), "col": F.round(frac("lon") * (F.col("size") - 1)).cast("int")})
    return p.join(cells.select("tile", "row", "col", "h"), ["tile", "row", "col"], "left").drop("row", "col", "size")


def best_source(found: DataFrame) -> DataFrame:
    """(tile, path) of the preferred source: copernicus, then viewfinder, then srtm."""
    rank = F.when(F.col("source") == "copernicus", 0).when(F.col("source") == "viewfinder", 1).when(F.col("source") == "srtm", 2)
    return found.where(rank.isNotNull()).groupBy("tile").agg(F.min_by("path", rank).alias("path"))


def tile_directory(buffer: bytes) -> list[tuple[int, int, int, int]]:
    """(tile_id, offset, length, run) entries of a tile archive's directory: four varint columns, deltas for ids, 0 for 'follows the last'."""
    n, at = varint(buffer, 0)
    columns = []
    for _ in range(4):
        values = []
        for _ in range(n):
            v, at = varint(buffer, at)
            values.append(v)
        columns.append(values)
    ids, runs, lengths, raw = columns
    out, tile, offset = [], 0, 0
    for i in range(n):
        tile += ids[i]
        offset = offset + lengths[i - 1] if raw[i] == 0 and i else raw[i] - 1
        out.append((tile, offset, lengths[i], runs[i]))
    return out


def tiles_of_bbox(spark: SparkSession, bbox: tuple[float, float, float, float], max_zoom: int) -> DataFrame:
    """All (z, x, y) tiles of zoom 0 to max_zoom that meet the box."""
    lo_lat, lo_lon, hi_lat, hi_lon = map(F.lit, bbox)
    z = spark.range(0, max_zoom + 1).select(F.col("id").cast("int").alias("z"))
    x = z.withColumn("x", F.explode(F.sequence(geo.tile_x(lo_lon, F.col("z")), geo.tile_x(hi_lon, F.col("z")))))
    return x.withColumn("y", F.explode(F.sequence(geo.tile_y(hi_lat, F.col("z")), geo.tile_y(lo_lat, F.col("z")))))


def dem_tiles_of_bbox(spark: SparkSession, bbox: tuple[float, float, float, float]) -> DataFrame:
    lat = spark.range(int(np.floor(bbox[0])), int(np.floor(bbox[2])) + 1).select(F.col("id").cast("double").alias("lat"))
    cells = lat.withColumn("lon", F.explode(F.transform(F.sequence(F.lit(int(np.floor(bbox[1]))), F.lit(int(np.floor(bbox[3])))), lambda x: x.cast("double"))))
    return cells.select(geo.dem_stem(F.col("lat"), F.col("lon")).alias("tile")).distinct()
