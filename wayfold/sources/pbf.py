"""A Python data source for OSM PBF files: one partition for a run of blobs, nodes only, standard library only."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import OSM


def varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed widths as bytes."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        else:
            n, at = varint(data, at) if kind == 2 else ({1: 8, 5: 4}[kind], at)
            value, at = data[at : at + n], at + n
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def signed(v: int) -> int:
    return v >> 1 ^ -(v & 1)


def running(values: list[int]) -> Iterator[int]:
    total = 0
    for v in values:
        total += signed(v)
        yield total


def blobs(f) -> Iterator[tuple[str, int, int]]:
    """(type, offset, size) of each blob."""
    while head := f.read(4):
        header = dict(fields(f.read(struct.unpack(">I", head)[0])))
        at = f.tell()
        yield header[1].decode(), at, header[3]
        f.seek(at + header[3])


def nodes(blob: bytes) -> Iterator[tuple]:
    parts = dict(fields(blob))
    block = parts[1] if 1 in parts else zlib.decompress(parts[3])
    strings: list[str] = []
    scale, lat0, lon0, groups = 100, 0, 0, []
    for k, v in fields(block):
        if k == 1:
            strings = [s.decode("utf-8", "replace") for _, s in fields(v)]
        elif k == 2:
            groups.append(v)
        elif k == 17:
            scale = v
        elif k == 19:
            lat0 = v - (1 << 64) if v >= 1 << 63 else v
        elif k == 20:
            lon0 = v - (1 << 64) if v >= 1 << 63 else v
    place = lambda lat, lon: (1e-9 * (lat0 + scale * lat), 1e-9 * (lon0 + scale * lon))
    for group in groups:
        for k, v in fields(group):
            if k == 1:
                n = {1: 0, 8: 0, 9: 0, 2: b"", 3: b""} | dict(fields(v))
                tags = {strings[a]: strings[b] for a, b in zip(packed(n[2]), packed(n[3]))}
                yield signed(n[1]), "node", *place(signed(n[8]), signed(n[9])), tags
            elif k == 2:
                d = {10: b""} | dict(fields(v))
                marks, at = packed(d[10]), 0
                for i, lat, lon in zip(running(packed(d[1])), running(packed(d[8])), running(packed(d[9]))):
                    tags = {}
                    while at < len(marks) and marks[at]:
                        tags[strings[marks[at]]] = strings[marks[at + 1]]
                        at += 2
                    at += 1
                    yield i, "node", *place(lat, lon), tags


class Run(InputPartition):
    def __init__(self, path: str, places: list[tuple[int, int]]):
        self.path, self.places = path, places


class Reader(DataSourceReader):
    def __init__(self, options):
        self.path = options["path"].removeprefix("file://")
        self.most = int(options.get("bytesPerPartition", 32 << 20))

    def partitions(self):
        runs, run, size = [], [], 0
        with open(self.path, "rb") as f:
            for kind, at, n in blobs(f):
                if kind != "OSMData":
                    continue
                if run and size + n > self.most:
                    runs.append(Run(self.path, run))
                    run, size = [], 0
                run.append((at, n))
                size += n
        return [*runs, Run(self.path, run)]

    def read(self, partition):
        with open(partition.path, "rb") as f:
            for at, n in partition.places:
                f.seek(at)
                yield from nodes(f.read(n))


class OsmPbf(DataSource):
    """``spark.read.format("osmpbf").load(path)`` on a path that all executors can open."""

    @classmethod
    def name(cls):
        return "osmpbf"

    def schema(self):
        return OSM

    def reader(self, schema):
        return Reader(self.options)
