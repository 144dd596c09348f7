"""OpenStreetMap PBF extracts as a Spark data source, ``osm_pbf``.

The path is a file or a folder of them (``.osm.pbf``).  The driver reads blob
headers only; every task decodes its own blobs.  Option
``kind`` is ``way`` (way_id, nodes, tags) or ``node`` (osm_id, lat, lon,
tags); plain and dense nodes come out alike, relations are skipped.  The path
or the address in a store, must be readable by driver and executors.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from . import files

SCHEMAS = {
    "way": "way_id bigint, nodes array<bigint>, tags map<string,string>",
    "node": "osm_id bigint, lat double, lon double, tags map<string,string>",
}
#: Bytes of compressed blobs that one task reads, about: decoding is slow, some 0.2 ms a way.
TASK_BYTES = 2 << 20


# ------------------------------------------------------------------- wire format


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 0x7F) << shift
        if byte < 0x80:
            return value, at
        shift += 7


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a message: numbers, or the bytes of what has a length."""
    at, end = 0, len(data)
    while at < end:
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 2:
            size, at = _varint(data, at)
            value, at = data[at : at + size], at + size
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"wire type {kind} is not part of the format")
        yield key >> 3, value


def packed(data: bytes, signed: bool = False) -> np.ndarray:
    """All numbers of a packed field at once."""
    raw = np.frombuffer(data, dtype=np.uint8)
    ends = np.flatnonzero(raw < 0x80)
    if not len(ends):
        return np.zeros(0, dtype=np.int64)
    starts = np.r_[0, ends[:-1] + 1]
    place = np.arange(len(raw)) - np.repeat(starts, ends - starts + 1)
    parts = (raw & 0x7F).astype(np.uint64) << (place * 7).astype(np.uint64)
    values = np.bitwise_or.reduceat(parts, starts)
    if signed:
        return (values >> np.uint64(1)).astype(np.int64) ^ -(values & np.uint64(1)).astype(np.int64)
    return values.astype(np.int64)


def zigzag(value: int) -> int:
    return (value >> 1) ^ -(value & 1)


# ------------------------------------------------------------------------ blocks


def blob_places(path: str) -> list[tuple[int, int]]:
    """Offset and size of each data blob."""
    places, offset = [], 0
    with files.opened(path) as file:
        while head := file.read(4):
            header = dict(fields(file.read(struct.unpack(">I", head)[0])))
            size = header[3]
            offset = file.tell()
            if header[1] == b"OSMData":
                places.append((offset, size))
            file.seek(offset + size)
    return places


def blob_data(blob: bytes) -> bytes:
    parts = dict(fields(blob))
    if 1 in parts:
        return parts[1]
    if 3 in parts:
        return zlib.decompress(parts[3])
    raise ValueError("blob is neither raw nor zlib")


@dataclass
class Block:
    strings: list[str]
    groups: list[bytes]
    granularity: int = 100
    lat_offset: int = 0
    lon_offset: int = 0

    @classmethod
    def of(cls, data: bytes) -> Block:
        block = cls([], [])
        for number, value in fields(data):
            if number == 1:
                block.strings = [v.decode("utf-8", "replace") for n, v in fields(value) if n == 1]
            elif number == 2:
                block.groups.append(value)
            elif number == 17:
                block.granularity = value
            elif number in (19, 20):
                value = value - (1 << 64) if value >> 63 else value
                block.lat_offset, block.lon_offset = (value, block.lon_offset) if number == 19 else (block.lat_offset, value)
        return block

    def tags(self, keys, values) -> list[tuple[str, str]]:
        """Pairs; of a repeated key the last value stays."""
        return list({self.strings[k]: self.strings[v] for k, v in zip(keys, values, strict=True)}.items())

    def degrees(self, value, offset: int):
        return 1e-9 * (offset + self.granularity * value)

    def ways(self) -> Iterator[tuple]:
        for group in self.groups:
            for number, message in fields(group):
                if number == 3:
                    got = dict(fields(message))
                    refs = np.cumsum(packed(got.get(8, b""), signed=True)).tolist()
                    yield got[1], refs, self.tags(packed(got.get(2, b"")).tolist(), packed(got.get(3, b"")).tolist())

    def nodes(self) -> Iterator[tuple]:
        for group in self.groups:
            for number, message in fields(group):
                if number == 1:
                    got = dict(fields(message))
                    yield zigzag(got[1]), self.degrees(zigzag(got[8]), self.lat_offset), self.degrees(zigzag(got[9]), self.lon_offset), self.tags(packed(got.get(2, b"")).tolist(), packed(got.get(3, b"")).tolist())
                elif number == 2:
                    yield from self._dense(dict(fields(message)))

    def _dense(self, got: dict) -> Iterator[tuple]:
        ids, lats, lons = (np.cumsum(packed(got.get(n, b""), signed=True)) for n in (1, 8, 9))
        words, at = packed(got.get(10, b"")).tolist(), 0
        for i, lat, lon in zip(ids.tolist(), self.degrees(lats, self.lat_offset).tolist(), self.degrees(lons, self.lon_offset).tolist(), strict=True):
            pairs = []
            while at < len(words) and words[at]:
                pairs.append((words[at], words[at + 1]))
                at += 2
            at += 1
            yield i, lat, lon, self.tags([k for k, _ in pairs], [v for _, v in pairs])


# ------------------------------------------------------------------------ source


@dataclass
class _Blobs(InputPartition):
    places: list[tuple[str, int, int]]


class _Reader(DataSourceReader):
    def __init__(self, path: str, kind: str) -> None:
        self.path, self.kind = path, kind

    def partitions(self) -> list[_Blobs]:
        parts, own, size = [], [], 0
        for path, offset, length in ((path, *place) for path in files.listed(self.path, ".osm.pbf") for place in blob_places(path)):
            own.append((path, offset, length))
            size += length
            if size >= TASK_BYTES:
                parts.append(_Blobs(own))
                own, size = [], 0
        return parts + ([_Blobs(own)] if own or not parts else [])

    def read(self, partition: _Blobs) -> Iterator[pa.RecordBatch]:
        tags = pa.map_(pa.string(), pa.string())
        if self.kind == "way":
            types = [("way_id", pa.int64()), ("nodes", pa.list_(pa.int64())), ("tags", tags)]
        else:
            types = [("osm_id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("tags", tags)]
        for path, places in groupby(partition.places, key=lambda place: place[0]):
            with files.opened(path) as file:
                for _, offset, size in places:
                    file.seek(offset)
                    block = Block.of(blob_data(file.read(size)))
                    rows = list(block.ways() if self.kind == "way" else block.nodes())
                    if rows:
                        columns = zip(*rows, strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(c, type=t) for c, (_, t) in zip(columns, types, strict=True)], names=[n for n, _ in types])


class OsmPbf(DataSource):
    @classmethod
    def name(cls) -> str:
        return "osm_pbf"

    def _kind(self) -> str:
        kind = self.options.get("kind", "way")
        if kind not in SCHEMAS:
            raise ValueError(f"kind must be one of {', '.join(SCHEMAS)}")
        return kind

    def schema(self) -> str:
        return SCHEMAS[self._kind()]

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._kind())


def read(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """The ways or nodes of an extract."""
    spark.dataSource.register(OsmPbf)
    return spark.read.format("osm_pbf").option("kind", kind).load(path)
