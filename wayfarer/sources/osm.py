"""Street maps: XML extracts by Spark's reader, PBF extracts by ranges of their blobs."""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from wayfarer.functions.scalars import in_bbox
from wayfarer.functions.session import shared_dir
from wayfarer.operators.graph import pedestrian_ways


def read_xml(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: node_id, lat, lon; ways: id, refs, tags) of an XML extract; what it holds is what was asked of the server, so nothing is filtered."""
    node = "_id long, _lat double, _lon double"
    nodes = spark.read.format("xml").option("rowTag", "node").schema(node).load(path)
    nodes = nodes.filter(F.col("_id").isNotNull() & (F.col("_id") != 0)).select(F.col("_id").alias("node_id"), F.col("_lat").alias("lat"), F.col("_lon").alias("lon"))
    way = "_id long, nd array<struct<_ref:long>>, tag array<struct<_k:string,_v:string>>"
    ways = spark.read.format("xml").option("rowTag", "way").schema(way).load(path)
    tags = F.map_from_entries(F.transform(F.coalesce("tag", F.expr("cast(array() as array<struct<_k:string,_v:string>>)")), lambda t: F.struct(t["_k"], t["_v"])))
    return nodes, ways.filter(F.size("nd") >= 2).select(F.col("_id").alias("id"), F.transform("nd", lambda x: x["_ref"]).alias("refs"), tags.alias("tags"))


def in_area(nodes: DataFrame, ways: DataFrame, bbox: tuple[float, float, float, float]) -> tuple[DataFrame, DataFrame]:
    """Pedestrian ways with a node in the box, and the nodes they use."""
    inside = nodes.filter(in_bbox(F.col("lat"), F.col("lon"), bbox)).select("node_id")
    walked = pedestrian_ways(ways)
    touched = walked.select("id", F.explode("refs").alias("node_id")).join(inside, "node_id", "left_semi").select("id").distinct()
    kept = walked.join(touched, "id", "left_semi")
    return nodes.join(kept.select(F.explode("refs").alias("node_id")).distinct(), "node_id", "left_semi"), kept


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A base-128 number and the place after it."""
    value = shift = 0
    while True:
        b = data[at]
        at += 1
        value |= (b & 127) << shift
        if b < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """(number, value) of each field of a message: ints for numbers, bytes for what has a length."""
    at = 0
    while at < len(data):
        key, at = varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind == 2:
            n, at = varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 1:
            value, at = int.from_bytes(data[at : at + 8], "little"), at + 8
        elif kind == 5:
            value, at = int.from_bytes(data[at : at + 4], "little"), at + 4
        else:
            raise ValueError(f"wire type {kind} is unknown")
        yield key >> 3, value


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        value, at = varint(data, at)
        out.append(value)
    return out


def signed(value: int) -> int:
    """A zigzag number."""
    return (value >> 1) ^ -(value & 1)


def sums(values: list[int]) -> list[int]:
    out, total = [], 0
    for v in values:
        total += signed(v)
        out.append(total)
    return out


def blobs(data: bytes):
    """(kind, bytes) of each block of a PBF file."""
    at = 0
    while at + 4 <= len(data):
        (n,) = struct.unpack_from(">I", data, at)
        head = dict(fields(data[at + 4 : at + 4 + n]))
        start = at + 4 + n
        at = start + head[3]
        blob = dict(fields(data[start:at]))
        yield head[1].decode(), blob[1] if 1 in blob else zlib.decompress(blob[3])


def header_bbox(block: bytes) -> tuple[float, float, float, float] | None:
    """(min_lon, min_lat, max_lon, max_lat) of a header block, if it names one."""
    box = dict(fields(block)).get(1)
    if box is None:
        return None
    found = {k: signed(v) / 1e9 for k, v in fields(box)}
    return found[1], found[4], found[2], found[3]


def decode(block: bytes):
    """('node', id, lat, lon) and ('way', id, refs, tags) of a data block."""
    parts = list(fields(block))
    texts = [v.decode() for k, v in fields(next(v for k, v in parts if k == 1)) if k == 1]
    scalar = dict((k, v) for k, v in parts if k in (17, 19, 20))
    grain, lat0, lon0 = scalar.get(17, 100), scalar.get(19, 0), scalar.get(20, 0)
    wide = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    place = lambda first, v: (wide(first) + grain * v) * 1e-9
    for group in (v for k, v in parts if k == 2):
        for kind, body in fields(group):
            if kind == 1:
                f = dict(fields(body))
                yield "node", signed(f[1]), place(lat0, signed(f[8])), place(lon0, signed(f[9]))
            elif kind == 2:
                f = dict(fields(body))
                for i, y, x in zip(*(sums(packed(f[k])) for k in (1, 8, 9)), strict=True):
                    yield "node", i, place(lat0, y), place(lon0, x)
            elif kind == 3:
                f = dict(fields(body))
                keys, values = packed(f.get(2, b"")), packed(f.get(3, b""))
                yield "way", f[1], sums(packed(f.get(8, b""))), {texts[a]: texts[b] for a, b in zip(keys, values, strict=True)}


#: Bytes of a range of blobs that one task reads, about.
RANGE = 16 << 20

_ITEMS = "id long, lat double, lon double, refs array<long>, tags map<string,string>"


def _opened(path: str):
    """A file by its address, on this machine or in a store that Arrow knows."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file(unquote("/" + path[5:].lstrip("/")))
    store, name = fs.FileSystem.from_uri(path)
    return store.open_input_file(name)


def ranges(file, size: int):
    """(start, end) of neighbouring blobs of about ``size`` bytes: one pass over the headers, which skips the blobs."""
    start = at = 0
    while len(head := file.read_at(4, at)) == 4:
        (n,) = struct.unpack(">I", head)
        at += 4 + n + dict(fields(file.read_at(n, at + 4)))[3]
        if at - start >= size:
            yield start, at
            start = at
    if at > start:
        yield start, at


@dataclass
class Blobs(InputPartition):
    """Some neighbouring blobs of a file."""

    path: str
    start: int
    end: int


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.paths, self.size = json.loads(options["paths"]), int(options["range"])

    def partitions(self) -> list[Blobs]:
        out = []
        for path in self.paths:
            with _opened(path) as file:
                out += [Blobs(path, *x) for x in ranges(file, self.size)]
        return out or [Blobs("", 0, 0)]

    def read(self, part: Blobs):
        if part.end == part.start:
            return
        with _opened(part.path) as file:
            data = file.read_at(part.end - part.start, part.start)
        kinds = pa.schema([("id", pa.int64()), ("lat", pa.float64()), ("lon", pa.float64()), ("refs", pa.list_(pa.int64())), ("tags", pa.map_(pa.string(), pa.string()))])
        for kind, block in blobs(data):
            if kind == "OSMData":
                rows = [dict(zip(("id", "lat", "lon") if x[0] == "node" else ("id", "refs", "tags"), x[1:], strict=True)) for x in decode(block)]
                for row in rows:
                    if "tags" in row:
                        row["tags"] = list(row["tags"].items())
                yield pa.RecordBatch.from_pylist(rows, kinds)


class PbfSource(DataSource):
    """Nodes and ways of PBF files (``paths``, as JSON), a partition for each range of blobs of about ``range`` bytes."""

    @classmethod
    def name(cls) -> str:
        return "wayfarer_pbf"

    def schema(self) -> str:
        return _ITEMS

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def pbf_items(spark: SparkSession, path: str, size: int = RANGE) -> DataFrame:
    """id and lat, lon of every node, id, refs and tags of every way of the PBF files at ``path``; each blob is read by one task."""
    spark.dataSource.register(PbfSource)
    found = sorted(r.path for r in spark.read.format("binaryFile").load(path).select("path").collect())  # listed, not read
    return spark.read.format(PbfSource.name()).option("paths", json.dumps(found)).option("range", str(size)).load()


def read_pbf(spark: SparkSession, path: str, size: int = RANGE) -> tuple[DataFrame, DataFrame]:
    """(nodes, ways) of PBF files, decoded once into Parquet in the shared folder, from which both are read."""
    folder = f"{shared_dir(spark)}/map-{uuid.uuid4().hex}"
    pbf_items(spark, path, size).withColumn("way", F.col("refs").isNotNull()).write.partitionBy("way").parquet(folder)
    rows = spark.read.schema(f"{_ITEMS}, way boolean").parquet(folder)
    return rows.filter("not way").select(F.col("id").alias("node_id"), "lat", "lon"), rows.filter("way").select("id", "refs", "tags")
