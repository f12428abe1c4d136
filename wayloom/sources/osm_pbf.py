"""OpenStreetMap PBF as a Spark data source: one partition a blob, no native library.

``spark.read.format("osm_pbf").load(path)`` gives rows (kind, id, lat, lon,
tags, refs, members).  Paths must be readable by Python on every executor.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "kind string, id bigint, lat double, lon double, tags map<string,string>, refs array<bigint>, members array<struct<type:string,ref:bigint,role:string>>"


def varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        out |= (c & 0x7F) << shift
        i += 1
        if c < 0x80:
            return out, i
        shift += 7


def zigzag(n: int) -> int:
    return (n >> 1) ^ -(n & 1)


def fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message; lengths give bytes, the rest integers."""
    i = 0
    while i < len(b):
        key, i = varint(b, i)
        kind = key & 7
        if kind == 0:
            v, i = varint(b, i)
        elif kind == 2:
            n, i = varint(b, i)
            v, i = b[i : i + n], i + n
        else:
            size = 8 if kind == 1 else 4
            v, i = int.from_bytes(b[i : i + size], "little"), i + size
        yield key >> 3, v


def packed(b: bytes, signed: bool = False) -> list[int]:
    out, i = [], 0
    while i < len(b):
        v, i = varint(b, i)
        out.append(zigzag(v) if signed else v)
    return out


def running(values: list[int]) -> list[int]:
    total, out = 0, []
    for v in values:
        total += v
        out.append(total)
    return out


def blobs(path: str) -> Iterator[tuple[str, int, int]]:
    """(type, offset, size) of the file's blobs."""
    with open(path, "rb") as f:
        while head := f.read(4):
            header = dict(fields(f.read(struct.unpack(">I", head)[0])))
            yield header[1].decode(), f.tell(), header[3]
            f.seek(header[3], 1)


def unpack(blob: bytes) -> bytes:
    f = dict(fields(blob))
    return f[1] if 1 in f else zlib.decompress(f[3])


def block_rows(data: bytes) -> Iterator[tuple]:
    whole = list(fields(data))
    strings = [v.decode("utf-8", "replace") for n, v in fields(next(v for n, v in whole if n == 1))]
    scalar = {n: v for n, v in whole if n in (17, 19, 20)}
    grain, lat0, lon0 = scalar.get(17, 100), scalar.get(19, 0), scalar.get(20, 0)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    degrees = lambda base, v: 1e-9 * (signed(base) + grain * v)
    for n, group in whole:
        if n != 2:
            continue
        for kind, body in fields(group):
            m = list(fields(body))
            one = dict(m)
            tags = lambda: {strings[k]: strings[v] for k, v in zip(packed(one.get(2, b"")), packed(one.get(3, b"")))}  # noqa: B023, E731
            if kind == 1:
                yield "node", zigzag(one[1]), degrees(lat0, zigzag(one[8])), degrees(lon0, zigzag(one[9])), tags(), None, None
            elif kind == 2:
                ids, lats, lons = (running(packed(one[k], True)) for k in (1, 8, 9))
                kv, at = packed(one.get(10, b"")), 0
                for i, lat, lon in zip(ids, lats, lons):
                    own = {}
                    while at < len(kv) and kv[at]:
                        own[strings[kv[at]]] = strings[kv[at + 1]]
                        at += 2
                    at += 1
                    yield "node", i, degrees(lat0, lat), degrees(lon0, lon), own, None, None
            elif kind == 3:
                yield "way", one[1], None, None, tags(), running(packed(one.get(8, b""), True)), None
            elif kind == 4:
                roles, refs, types = packed(one.get(8, b"")), running(packed(one.get(9, b""), True)), packed(one.get(10, b""))
                members = [(("node", "way", "relation")[t], r, strings[s]) for s, r, t in zip(roles, refs, types)]
                yield "relation", one[1], None, None, tags(), None, members


class BlobPartition(InputPartition):
    def __init__(self, offset: int, size: int):
        self.offset, self.size = offset, size


class OsmPbfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[BlobPartition]:
        return [BlobPartition(o, s) for kind, o, s in blobs(self.path) if kind == "OSMData"]

    def read(self, partition: BlobPartition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            f.seek(partition.offset)
            yield from block_rows(unpack(f.read(partition.size)))


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> OsmPbfReader:
        return OsmPbfReader(self.options["path"].removeprefix("file://"))


def register(spark) -> None:
    spark.dataSource.register(OsmPbf)
