"""The derived network as files of the formats that the sources read: an extract of nodes and ways, and a shapefile of forest roads.

Both are folders of files, a run of entities to a file and a file to a task,
made from public format descriptions; they are inputs for queries of the
sources and no sinks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import batched, chain

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .fixture import Network
from .functions.storage import shared_path
from .sources import files

#: Entities of one block of an extract.
BLOCK = 8000
#: Width of a text field of the attribute table.
WIDTH = 40
FIELDS = ("ROUTE_STAT", "OPER_MAINT", "OPENFORUSE", "OBJECTIVE_", "SURFACE_TY", "NAME")


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, value: int | bytes) -> bytes:
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _deltas(values: Iterable[int]) -> bytes:
    out, last = bytearray(), 0
    for v in values:
        d, last = v - last, v
        out += _varint((d << 1) ^ (d >> 63))
    return bytes(out)


def _block(strings: list[str], group: bytes) -> bytes:
    table = _field(1, b"".join(_field(1, s.encode()) for s in ["", *strings]))
    return table + _field(2, group)


def _blob(kind: str, body: bytes) -> bytes:
    blob = _field(2, len(body)) + _field(3, zlib.compress(body))
    header = _field(1, kind.encode()) + _field(3, len(blob))
    return struct.pack(">I", len(header)) + header + blob


def extract(nodes: Iterable[tuple[int, int, int, dict[str, str]]], ways: Iterable[tuple[int, list[int], dict[str, str]]]) -> bytes:
    """An extract of (id, lat_e7, lon_e7, tags) nodes and (id, nodes, tags) ways."""
    blobs = [_blob("OSMHeader", b"")]
    for some in batched(nodes, BLOCK):
        strings = sorted({x for *_, tags in some for kv in tags.items() for x in kv})
        number = {x: i + 1 for i, x in enumerate(strings)}
        pairs = b"".join(b"".join(_varint(number[x]) for kv in tags.items() for x in kv) + b"\0" for *_, tags in some)
        dense = b"".join(_field(n, _deltas(x[i] for x in some)) for n, i in ((1, 0), (8, 1), (9, 2)))
        blobs.append(_blob("OSMData", _block(strings, _field(2, dense + _field(10, pairs)))))
    for some in batched(ways, BLOCK):
        strings = sorted({x for *_, tags in some for kv in tags.items() for x in kv})
        number = {x: i + 1 for i, x in enumerate(strings)}
        group = []
        for way_id, refs, tags in some:
            keys, values = (b"".join(_varint(number[x]) for x in side) for side in (tags, tags.values()))
            group.append(_field(3, _field(1, way_id) + _field(2, keys) + _field(3, values) + _field(8, _deltas(refs))))
        blobs.append(_blob("OSMData", _block(strings, b"".join(group))))
    return b"".join(blobs)


def shapes(records: Iterable[tuple[dict[str, str | None], list[list[tuple[float, float]]]]]) -> tuple[bytes, bytes, bytes]:
    """A file of polylines, its attribute table and its index, of (attributes, parts of (lon, lat)) records."""
    bodies, rows, index, place = [], [], [], 50
    for number, (attributes, parts) in enumerate(records, 1):
        points = [p for part in parts for p in part]
        starts, at = [], 0
        for part in parts:
            starts.append(at)
            at += len(part)
        shape = struct.pack("<i4d2i", 3, 0, 0, 0, 0, len(parts), len(points)) + struct.pack(f"<{len(starts)}i", *starts) + struct.pack(f"<{2 * at}d", *(x for p in points for x in p))
        bodies.append(struct.pack(">2i", number, len(shape) // 2) + shape)
        index.append(struct.pack(">2i", place, len(shape) // 2))
        place += 4 + len(shape) // 2
        rows.append(b" " + b"".join((attributes[n] or "").encode("latin-1").ljust(WIDTH) for n in FIELDS))
    fields = b"".join(n.encode().ljust(11, b"\0") + b"C" + bytes(4) + bytes([WIDTH]) + bytes(15) for n in FIELDS)
    head = struct.pack("<4BIHH20x", 3, 20, 1, 1, len(rows), 33 + len(fields), 1 + WIDTH * len(FIELDS))
    return bytes(100) + b"".join(bodies), head + fields + b"\r" + b"".join(rows) + b"\x1a", bytes(100) + b"".join(index)


def _write(rows: DataFrame, order: str, folder: str, name: str, packed: Callable[[Iterator[dict]], dict[str, bytes]]) -> None:
    """Files of runs of rows in the order of ``order``, one run and its files (by ending) to a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = (row for batch in batches for row in batch.to_pylist())
        first = next(own, None)
        if first is not None:
            for end, data in packed(chain([first], own)).items():
                files.write(f"{folder}/{name}-{TaskContext.get().partitionId():06}{end}", data)
        yield pa.RecordBatch.from_arrays([pa.array([int(first is not None)])], names=["files"])

    rows.repartitionByRange(order).sortWithinPartitions(order).mapInArrow(run, "files long").agg({"files": "sum"}).first()


def write_extract(net: Network) -> str:
    """A folder of extracts: nodes, then ways, in the order of their ids."""
    folder = shared_path(net.spark, "extract")

    def nodes(rows: Iterator[dict]) -> dict[str, bytes]:
        return {".osm.pbf": extract(((r["osm_id"], round(r["lat"] * 1e7), round(r["lon"] * 1e7), dict(r["tags"])) for r in rows), [])}

    def ways(rows: Iterator[dict]) -> dict[str, bytes]:
        return {".osm.pbf": extract([], ((r["way_id"], r["nodes"], dict(r["tags"])) for r in rows))}

    files.write(f"{folder}/header.osm.pbf", extract([], []))
    _write(net.tagged_nodes(), "osm_id", folder, "nodes", nodes)
    _write(net.ways(), "way_id", folder, "ways", ways)
    return folder


def write_shapes(net: Network) -> str:
    """A folder of shapefiles, records in the order of their ids."""
    folder = shared_path(net.spark, "shapes")

    def roads(rows: Iterator[dict]) -> dict[str, bytes]:
        made = shapes(({n: r[n] for n in FIELDS}, [[(p["lon"], p["lat"]) for p in part] for part in r["parts"]]) for r in rows)
        return dict(zip((".shp", ".dbf", ".shx"), made, strict=True))

    _write(net.usfs_records(), "record_id", folder, "roads", roads)
    if not files.listed(folder, ".shp"):
        for end, data in roads(iter(())).items():
            files.write(f"{folder}/roads{end}", data)
    return folder
