"""Sources: parquet, JSON documents, GeoJSON pages, GeoPackage layers; sinks for tables, reports and rasters."""

from __future__ import annotations

import sqlite3
import struct
from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from terrakiln.functions.scalar import COMPOSITE_NODATA, finite

RING = "array<struct<x:double,y:double>>"
PERIMETERS = f"OBJECTID bigint, YEAR_ int, GIS_ACRES double, C_METHOD int, FIRE_NAME string, ALARM_DATE double, CONT_DATE double, rings array<{RING}>"


def read_parquet(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def geojson_features(pages: DataFrame, column: str = "value") -> DataFrame:
    """Perimeters of GeoJSON pages, one page in each row of text; an empty collection has none. All rings of all polygons are listed."""
    properties = "struct<OBJECTID:bigint,YEAR_:int,GIS_ACRES:double,C_METHOD:int,FIRE_NAME:string,ALARM_DATE:double,CONT_DATE:double>"
    kind = f"features array<struct<properties:{properties},geometry:struct<type:string,coordinates:string>>>"
    rows = pages.select(F.explode(F.from_json(F.col(column), kind)["features"]).alias("f")).select("f.properties.*", "f.geometry")
    ring = "array<array<array<double>>>"
    one = F.from_json(F.col("geometry.coordinates"), ring)
    many = F.flatten(F.from_json(F.col("geometry.coordinates"), f"array<{ring}>"))
    listed = F.when(F.col("geometry.type") == "Polygon", one).when(F.col("geometry.type") == "MultiPolygon", many)
    rings = F.transform(listed, lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y"))))
    return rows.withColumn("rings", rings).drop("geometry")


def keyset_pages(fetch: Callable[[int], list[dict[str, Any]]], size: int, key: str = "OBJECTID") -> Iterator[list[dict[str, Any]]]:
    """Pages of rows after the greatest key so far, until an empty or short page or one without keys; nothing at all is an error."""
    last, pages = 0, 0
    while page := fetch(last):
        pages += 1
        yield page
        if len(page) < size or any(row.get(key) is None for row in page):
            return
        last = max(row[key] for row in page)
    if not pages:
        raise ValueError("No fires found")


def decode_wkb(data: bytes) -> list[list[tuple[float, float]]]:
    """Rings or lines of a WKB point, line, polygon or collection of them (x and y only)."""

    def geometry(at: int) -> tuple[list, int]:
        order = "<" if data[at] else ">"
        kind = struct.unpack_from(f"{order}I", data, at + 1)[0]
        width = 2 + (kind // 1000 in (1, 2) or bool(kind & 0x80000000)) + 2 * (kind // 1000 == 3)
        kind, at = kind % 1000 & 0xFF, at + 5

        def points(at: int, n: int) -> tuple[list, int]:
            flat = struct.unpack_from(f"{order}{n * width}d", data, at)
            return list(zip(flat[::width], flat[1::width], strict=True)), at + 8 * n * width

        if kind == 1:
            found, at = points(at, 1)
            return [found], at
        count, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
        out = []
        if kind == 2:
            found, at = points(at, count)
            return [found], at
        for _ in range(count):
            if kind == 3:
                n, at = struct.unpack_from(f"{order}I", data, at)[0], at + 4
                found, at = points(at, n)
                out.append(found)
            else:
                found, at = geometry(at)
                out += found
        return out, at

    return geometry(0)[0]


def decode_gpkg(blob: bytes | None) -> list[list[tuple[float, float]]] | None:
    """Rings of a GeoPackage geometry: its header, whose envelope has 0, 4, 6, 6 or 8 numbers, then WKB; None for an empty one."""
    if blob is None or blob[:2] != b"GP" or blob[3] & 0x10:
        return None
    return decode_wkb(blob[8 + 8 * (0, 4, 6, 6, 8)[blob[3] >> 1 & 7] :])


class _Rows(InputPartition):
    def __init__(self, first: int, last: int) -> None:
        self.first, self.last = first, last


class GeoPackageReader(DataSourceReader):
    """Reads ranges of row numbers, one per partition; options path, layer, geometry, partitions."""

    def __init__(self, schema: StructType, options: dict[str, str]) -> None:
        self.schema, self.options = schema, options

    def partitions(self) -> list[InputPartition]:
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            low, high = db.execute(f'select min(rowid), max(rowid) from "{self.options["layer"]}"').fetchone()
        if low is None:
            return []
        n = max(1, int(self.options.get("partitions", 8)))
        step = -(-(high - low + 1) // n)
        return [_Rows(a, a + step - 1) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        shape = self.options.get("geometry", "geom")
        names = [f.name for f in self.schema if f.name != "rings"]
        wanted = ", ".join(f'"{n}"' for n in names)
        with sqlite3.connect(f"file:{self.options['path']}?mode=ro", uri=True) as db:
            for *values, blob in db.execute(f'select {wanted}, "{shape}" from "{self.options["layer"]}" where rowid between ? and ?', (partition.first, partition.last)):
                rings = decode_gpkg(blob)
                by_name = dict(zip(names, values, strict=True)) | {"rings": None if rings is None else [[{"x": x, "y": y} for x, y in r] for r in rings]}
                yield tuple(by_name[f.name] for f in self.schema)


class GeoPackage(DataSource):
    """spark.read.format("gpkg").option("path", ...).option("layer", ...).schema(...): the schema's `rings` is the geometry."""

    @classmethod
    def name(cls) -> str:
        return "gpkg"

    def reader(self, schema: StructType) -> DataSourceReader:
        return GeoPackageReader(schema, self.options)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Parquet; mode append adds a batch for resumption."""
    df.write.mode(mode).parquet(path)


def write_report(df: DataFrame, path: str) -> bool:
    """CSV with a header, if there are rows."""
    if df.isEmpty():
        return False
    df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)
    return True


def write_raster(df: DataFrame, path: str) -> None:
    """Pixel table with missing values marked as the composites mark them."""
    df.withColumn("value", F.coalesce(finite(F.col("value")), F.lit(COMPOSITE_NODATA))).write.mode("overwrite").parquet(path)


def write_json(df: DataFrame, path: str) -> None:
    """One document a row; null fields are left out."""
    df.write.mode("overwrite").option("ignoreNullFields", True).json(path)
