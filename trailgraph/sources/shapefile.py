"""Polyline shapefiles with their attribute tables as a Spark data source, ``road_shapefile``.

Rows have record_id (from 0), the attributes of forest-road records (text
fields, trimmed; others and missing ones null) and parts, a list of lists of
(lon, lat).  Polylines with or without M or Z values are read; other shapes
have no parts.  The path is a file or a folder of them (``.shp``), whose records
are numbered on from file to file.  The path, or the address in a store, must be readable by driver
and executors.
"""

from __future__ import annotations

import os
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schemas import USFS_RECORDS
from . import files

ATTRIBUTES = ("ROUTE_STAT", "OPER_MAINT", "OPENFORUSE", "OBJECTIVE_", "SURFACE_TY", "NAME")
#: Type codes of polylines, with Z and with M.
POLYLINES = (3, 13, 23)
TASK_RECORDS = 20_000


def parts_of(content: bytes) -> list[list[tuple[float, float]]]:
    """The parts of one shape record."""
    if len(content) < 44 or struct.unpack_from("<i", content)[0] not in POLYLINES:
        return []
    n_parts, n_points = struct.unpack_from("<2i", content, 36)
    starts = [*struct.unpack_from(f"<{n_parts}i", content, 44), n_points]
    points = np.frombuffer(content, dtype="<f8", count=2 * n_points, offset=44 + 4 * n_parts).reshape(-1, 2)
    return [[(x, y) for x, y in points[a:b].tolist()] for a, b in zip(starts, starts[1:], strict=False)]


@dataclass
class Table:
    """The layout of an attribute table."""

    records: int
    header: int
    width: int
    text: dict[str, tuple[int, int]]

    @classmethod
    def of(cls, path: str) -> Table:
        with files.opened(path) as file:
            head = file.read(32)
            records, header, width = struct.unpack("<4xIHH", head[:12])
            text, at = {}, 1
            for _ in range((header - 33) // 32):
                field = file.read(32)
                name = field[:11].split(b"\0")[0].decode("ascii", "replace").strip()
                if field[11:12] == b"C":
                    text[name] = (at, field[16])
                at += field[16]
        return cls(records, header, width, text)

    def row(self, record: bytes, encoding: str = "latin-1") -> list[str | None]:
        found = [self.text.get(name) for name in ATTRIBUTES]
        return [record[f[0] : f[0] + f[1]].decode(encoding).strip("\0 ").strip() if f else None for f in found]


@dataclass
class _Records(InputPartition):
    path: str
    record_id: int
    first: int
    offsets: list[int]


class _Reader(DataSourceReader):
    def __init__(self, path: str) -> None:
        self.path = path

    def _offsets(self, path: str) -> list[int]:
        """Byte offsets of the records: from the index file if there is one, else by walking record headers."""
        base = os.path.splitext(path)[0]
        if files.size(f"{base}.shx") is not None:
            with files.opened(f"{base}.shx") as file:
                file.seek(100)
                return (np.frombuffer(file.read(), dtype=">i4").reshape(-1, 2)[:, 0].astype(np.int64) * 2).tolist()
        found, size = [], files.size(path)
        with files.opened(path) as file:
            at = 100
            while at + 8 <= size:
                file.seek(at)
                found.append(at)
                at += 8 + 2 * struct.unpack(">2i", file.read(8))[1]
        return found

    def partitions(self) -> list[_Records]:
        parts, before = [], 0
        for path in files.listed(self.path, ".shp"):
            offsets = self._offsets(path)
            parts += [_Records(path, before + i, i, offsets[i : i + TASK_RECORDS]) for i in range(0, max(1, len(offsets)), TASK_RECORDS)]
            before += len(offsets)
        return parts

    def read(self, partition: _Records) -> Iterator[pa.RecordBatch]:
        base = os.path.splitext(partition.path)[0]
        table = Table.of(f"{base}.dbf")
        point = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])
        ids, attributes, shapes = [], [], []
        with files.opened(partition.path) as shp, files.opened(f"{base}.dbf") as dbf:
            for i, offset in enumerate(partition.offsets, partition.first):
                shp.seek(offset)
                length = struct.unpack(">2i", shp.read(8))[1]
                content = shp.read(2 * length)
                dbf.seek(table.header + i * table.width)
                ids.append(partition.record_id + i - partition.first)
                attributes.append(table.row(dbf.read(table.width)))
                shapes.append([[{"lon": x, "lat": y} for x, y in part] for part in parts_of(content)])
        if ids:
            columns = [pa.array(ids, pa.int64()), *(pa.array(c, pa.string()) for c in zip(*attributes, strict=True)), pa.array(shapes, pa.list_(pa.list_(point)))]
            yield pa.RecordBatch.from_arrays(columns, names=["record_id", *ATTRIBUTES, "parts"])


class RoadShapefile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "road_shapefile"

    def schema(self) -> str:
        return USFS_RECORDS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """The records of a shapefile."""
    spark.dataSource.register(RoadShapefile)
    return spark.read.format("road_shapefile").load(path)
