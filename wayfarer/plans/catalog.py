"""A city's prepared tables as Parquet, with a version and load statistics."""

from __future__ import annotations

import time
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfarer.functions.scalars import load_size
from wayfarer.operators import feeds, spatial

VERSION = 1
#: Tables of a city, and the columns each must have.
SCHEMAS = {
    "nodes": {"node_id", "lat", "lon", "stop_id"},
    "edges": {"u", "v", "w"},
    "stops": {"stop_id", "name", "lat", "lon"},
    "routes": {"route_id", "name", "color"},
    "trips": {"trip_id", "route_id", "service_id"},
    "stop_times": {"trip_id", "seq", "stop_id", "arr", "dep"},
    "services": {"service_id", "mask", "start_date", "end_date", "adds", "removes"},
    "frequencies": {"trip_id", "start_time", "end_time", "headway"},
    "leg_shapes": {"route_id", "from_stop", "to_stop", "points"},
}
#: How tables are laid out: rows that are read together lie together, and range statistics prune the rest. Nodes at stops
#: come first, and then both run along a Morton curve.
_ORDER = {"nodes": ["other", "morton"], "edges": ["u", "v"], "stop_times": ["trip_id", "seq"], "leg_shapes": ["route_id", "from_stop", "to_stop"]}


@dataclass(frozen=True)
class Catalog:
    """The tables of one city."""

    tables: dict[str, DataFrame] = field(default_factory=dict)

    def __getattr__(self, name: str) -> DataFrame:
        try:
            return self.__dict__["tables"][name]
        except KeyError:
            raise AttributeError(name) from None

    def check(self) -> None:
        """Raises unless every table has its columns."""
        for name, columns in SCHEMAS.items():
            if name not in self.tables:
                raise ValueError(f"table {name} is missing")
            if lacking := columns - set(self.tables[name].columns):
                raise ValueError(f"table {name} lacks {sorted(lacking)}")

    def save(self, path: str) -> None:
        self.check()
        spark = next(iter(self.tables.values())).sparkSession
        for name, df in self.tables.items():
            kept = df.columns
            if name == "nodes":
                df = spatial.morton_layout(df).withColumn("other", F.col("stop_id").isNull())
            if name in _ORDER:
                n = int(spark.conf.get("spark.sql.shuffle.partitions"))
                df = df.repartitionByRange(n, *_ORDER[name]).sortWithinPartitions(*_ORDER[name]).select(*kept)
            df.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{name}")
        spark.createDataFrame([(VERSION,)], "version int").coalesce(1).write.mode("overwrite").parquet(f"{path}/_meta_version")

    @staticmethod
    def load(spark: SparkSession, path: str) -> Catalog:
        version = spark.read.parquet(f"{path}/_meta_version").first().version
        if version != VERSION:
            raise ValueError(f"the city has version {version}, this reads {VERSION}")
        found = Catalog({name: spark.read.parquet(f"{path}/{name}") for name in SCHEMAS})
        found.check()
        return found

    def views(self, prefix: str = "") -> None:
        """Registers every table for SQL."""
        for name, df in self.tables.items():
            df.createOrReplaceTempView(prefix + name)


def file_sizes(spark: SparkSession, path: str) -> DataFrame:
    """name, bytes, size: what each table takes on disk."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(path).select("path", "length")
    name = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("name")
    return files.groupBy(name).agg(F.sum("length").alias("bytes")).withColumn("size", load_size(F.col("bytes")))


def load_report(spark: SparkSession, path: str) -> DataFrame:
    """name, rows, seconds, bytes, percent of all bytes, of every table of a saved city; seconds are those of reading all of its rows and columns."""
    city, found = Catalog.load(spark, path), []
    for name, df in city.tables.items():
        began = time.monotonic()
        df.write.format("noop").mode("overwrite").save()
        found.append((name, df.count(), time.monotonic() - began))
    sizes = feeds.size_report(file_sizes(spark, path))
    return spark.createDataFrame(found, "name string, rows long, seconds double").join(sizes, "name")
