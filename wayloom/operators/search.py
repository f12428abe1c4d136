"""Place search: token-prefix matching and ranking; nearby places; nearest vectors."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from wayloom.functions import geo
from wayloom.functions.roads import fold_name

SPLIT = r"[^\p{L}\p{N}]+"


def tokens(places: DataFrame) -> DataFrame:
    """Inverted index (token, osm_id) over name and kind, folded."""
    words = F.split(fold_name(F.concat_ws(" ", "name", "kind")), SPLIT)
    return places.select("osm_id", F.explode(F.array_distinct(F.filter(words, lambda t: t != ""))).alias("token"))


def kind_rank(kind: Column) -> Column:
    return F.when(kind.startswith("place:"), 0).when(kind.rlike("^(tourism|amenity|leisure|natural):"), 1).when(kind.startswith("addr:"), 3).otherwise(2)


def search(places: DataFrame, query: str, limit: int) -> DataFrame:
    """Places that have every word of the query, the last one as a prefix, best first.

    Rank: name starts with the query, kind, byte length of the name, id.  A
    blank query finds nothing.  The limit is the feature.
    """
    import re

    spark = places.sparkSession
    words = [w for w in re.split(r"[^\w]+", query.strip().lower()) if w]
    if not words:
        return places.limit(0)
    index = tokens(places)
    hits = None
    for i, word in enumerate(words):
        folded = fold_name(F.lit(word))
        test = F.startswith("token", folded) if i == len(words) - 1 else F.col("token") == folded
        found = index.where(test).select("osm_id").distinct()
        hits = found if hits is None else hits.join(found, "osm_id", "left_semi")
    starts = F.when(F.lower("name").startswith(query.strip().lower()), 0).otherwise(1)
    return places.join(hits, "osm_id", "left_semi").withColumn("_rank", F.struct(starts, kind_rank(F.col("kind")), F.octet_length("name"), F.col("osm_id"))).orderBy("_rank").limit(limit).drop("_rank")


def nearby(places: DataFrame, lat: float, lon: float, radius_m: float, limit: int) -> DataFrame:
    """Nearest first; the box prefilter reaches the scan, the exact distance follows."""
    pad = radius_m / 111_000
    import math

    lon_pad = pad / max(0.2, math.cos(math.radians(lat)))
    near = places.where(F.col("lat").between(lat - pad, lat + pad) & F.col("lon").between(lon - lon_pad, lon + lon_pad))
    return near.withColumn("dist_m", F.round(geo.haversine_m(lat, lon, F.col("lat"), F.col("lon"), geo.R_TRACKS), 3)).where(F.col("dist_m") <= radius_m).orderBy("dist_m", "osm_id").limit(limit)


def latest_by_key(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of every key (INSERT OR REPLACE as a view)."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*keys, "r.*")


def most_common_label(hits: DataFrame) -> DataFrame:
    """Mode of label per key; first seen wins ties."""
    n = hits.groupBy("key", "label").agg(F.count("*").alias("n"), F.min("pos").alias("p"))
    return n.groupBy("key").agg(F.min_by("label", F.struct(-F.col("n"), F.col("p"))).alias("label"))


QUERY_BLOCK = 1024  # query vectors compared at a time
ROUND_ERROR = 1e-4  # distances that may be equal when rounded to 4 places


def _nearest_in(ids: np.ndarray, queries: np.ndarray, k: int):
    """A partition's rows that may be among the k nearest of a query: all up to its k-th distance and what rounding may make equal to it."""

    def run(batches):
        best = np.full((len(ids), k), np.inf)
        which, vec, dist = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                rows = part.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(part.num_rows, -1)
                d = np.zeros((len(ids), len(rows)))
                for j in range(rows.shape[1]):  # in the order of the elements, so that sums do not depend on the blocks
                    d += (queries[:, j, None] - rows[None, :, j]) ** 2
                d = np.sqrt(d)
                best = np.sort(np.concatenate([best, d], axis=1), axis=1)[:, :k]
                limit = best[:, -1] + ROUND_ERROR
                q, r = np.nonzero(d <= limit[:, None])
                old = dist <= limit[which]
                which, dist = np.concatenate([which[old], q]), np.concatenate([dist[old], d[q, r]])
                vec = np.concatenate([vec[old], part.column(0).to_numpy(zero_copy_only=False)[r]])
        yield pa.RecordBatch.from_arrays([pa.array(ids[which]), pa.array(vec, pa.int64()), pa.array(dist)], ["q_id", "vec_id", "dist"])

    return run


def nearest_vectors(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(q_id, vec_id, dist): the k rows of ``vectors`` nearest to each of ``queries`` (vec_id, embedding), distance to 4 places, then id.

    Rows without an id or a vector are left out.  Queries may have any number: they are taken in blocks of QUERY_BLOCK, and each partition sends only its own nearest rows on.
    """
    rows = vectors.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null")
    found, block = [], []

    def flush():
        near = _nearest_in(np.array([i for i, _ in block], np.int64), np.array([v for _, v in block], np.float64), k)
        found.append(rows.mapInArrow(near, "q_id long, vec_id long, dist double"))
        block.clear()

    for q in queries.select(F.col("vec_id").cast("long"), "embedding").where("vec_id is not null and embedding is not null").toLocalIterator():
        block.append((q[0], q[1]))
        if len(block) == QUERY_BLOCK:
            flush()
    if block:
        flush()
    if not found:
        return rows.select(F.col("vec_id").alias("q_id"), "vec_id", F.lit(0.0).alias("dist")).limit(0)
    w = W.partitionBy("q_id").orderBy("dist", "vec_id")
    near = reduce(DataFrame.union, found).withColumn("dist", F.round("dist", 4))
    return near.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k).drop("r")
