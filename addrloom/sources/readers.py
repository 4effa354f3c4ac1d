"""Readers: CSV in several encodings, GeoJSON, workbooks and shapefiles, by suffix. All of them read through Spark, from any
store that it reads."""

from __future__ import annotations

import io
import json
import os
import re
import struct
import zipfile
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import layers
from .shared import children
from .layers import dbf_fields

ENCODINGS = ("utf-8", "gbk", "gb2312", "latin-1")
CHARSETS = {"gbk": "GBK", "gb2312": "GB2312", "gb18030": "GB18030", "latin-1": "ISO-8859-1"}


def encoding_of(spark: SparkSession, path: str, tried: tuple[str, ...] = ENCODINGS) -> str:
    """The first encoding that all files of the path are valid in, to the last byte: the verdicts of all splits together."""
    def run(batches):
        held = (1 << len(tried)) - 1
        for batch in batches:
            raw = b"\n".join(batch.column(0).to_pylist())
            for i, name in enumerate(tried):
                if held >> i & 1:
                    try:
                        raw.decode(name)
                    except UnicodeDecodeError:
                        held &= ~(1 << i)
        yield pa.RecordBatch.from_arrays([pa.array([held], pa.int32())], ["held"])

    # The text scan splits files at line ends and hands on the bytes as they are; no such encoding has a line end inside a letter.
    lines = spark.read.text(path).select(F.col("value").cast("binary"))
    held = lines.mapInArrow(run, "held int").agg(F.bit_and("held")).first()[0]
    return next((name for i, name in enumerate(tried) if held is None or held >> i & 1), tried[-1])


def read_csv(spark: SparkSession, path: str, encoding: str | None = None, multi_line: bool = True) -> DataFrame:
    """All columns are strings; a byte order mark and each file's header are dropped. Fields in quotes may have line ends unless
    multi_line is off, which lets Spark split large files.

    Spark reads national encodings only with spark.sql.legacy.javaCharsets, and as long as rows are read: it is set here then."""
    encoding = encoding or encoding_of(spark, path)
    reader = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
    if encoding not in ("utf-8", "utf-8-sig"):
        if CHARSETS[encoding] != "ISO-8859-1":
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        reader = reader.option("encoding", CHARSETS[encoding])
    return reader.csv(path)


def read_geojson(spark: SparkSession, path: str) -> DataFrame:
    """A row per feature: its properties, and the geometry as JSON."""
    features = spark.read.option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    return features.select("f.properties.*", F.to_json("f.geometry").alias("geometry"))


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"


def workbook_rows(data: bytes, sheet: str | None = None) -> list[list[str | None]]:
    """Cells of a sheet (the first one, if none is named), as text; empty cells are None."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        names = z.namelist()
        shared = []
        if "xl/sharedStrings.xml" in names:
            shared = [
                "".join(t.text or "" for t in si.iter(_NS + "t"))
                for si in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(_NS + "si")
            ]
        sheets = [s.get("name") for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iter(_NS + "sheet")]
        at = sheets.index(sheet) + 1 if sheet else 1
        rows = []
        for row in ElementTree.fromstring(z.read(f"xl/worksheets/sheet{at}.xml")).iter(_NS + "row"):
            cells: dict[int, str | None] = {}
            for c in row.iter(_NS + "c"):
                column = 0
                for letter in re.match("[A-Z]+", c.get("r", "A")).group():
                    column = column * 26 + ord(letter) - 64
                value, kind = c.find(_NS + "v"), c.get("t")
                text = "".join(
                    t.text or "" for t in c.iter(_NS + "t")
                ) if kind == "inlineStr" else None if value is None else value.text
                cells[column - 1] = shared[int(text)] if kind == "s" and text is not None else text
            rows.append([cells.get(i) for i in range(max(cells, default=-1) + 1)])
    return rows


def header_colours(data: bytes) -> list[tuple[str, str | None]]:
    """The first sheet's header cells with the colours they are filled with."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        style = ElementTree.fromstring(z.read("xl/styles.xml"))
        fills = [f.find(f"{_NS}patternFill/{_NS}fgColor") for f in style.find(_NS + "fills")]
        forms = [int(x.get("fillId", 0)) for x in style.find(_NS + "cellXfs")]
        first = next(ElementTree.fromstring(z.read("xl/worksheets/sheet1.xml")).iter(_NS + "row"))
        cells = [(int(c.get("s", 0)), "".join(t.text or "" for t in c.iter(_NS + "t"))) for c in first]
    return [(text, None if fills[forms[s]] is None else fills[forms[s]].get("rgb")) for s, text in cells]


def _files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _strings(names: list[str]) -> str:
    return ", ".join(f"`{n.replace('`', '``')}` string" for n in names)


def _batch(names: list[str], rows: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """A workbook, or a folder of workbooks with the same header; columns without a name are left out. A task reads a file."""
    files = _files(spark, path).where(F.lower("path").rlike(r"\.xlsx?$"))

    def top(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array([workbook_rows(data, sheet)[0]], pa.list_(pa.string()))], ["header"])

    first = files.agg(F.min("path")).first()[0]
    header = files.where(F.col("path") == first).select("content").mapInArrow(top, "header array<string>").first().header
    named = [i for i, h in enumerate(header) if h]
    names = [header[i] for i in named]

    def run(batches):
        for batch in batches:
            for data in batch.column(0).to_pylist():
                rows = workbook_rows(data, sheet)[1:]
                yield _batch(names, [[row[i] if i < len(row) else None for i in named] for row in rows])

    return files.select("content").mapInArrow(run, _strings(names))


def shape_rows(shapes: bytes, table: bytes, projection: str | None) -> list[list[str | None]]:
    """Attributes as strings, geometry, crs of a layer whose files are at hand."""
    count, start, width = struct.unpack("<IHH", table[4:12])
    layer = layers.Layer("", dbf_fields(table), start, width, count, layers.crs_of(projection), False)
    at, geometries, out = 100, [], []
    while at < len(shapes):
        size = struct.unpack(">i", shapes[at + 4 : at + 8])[0] * 2
        geometries.append(layers.shape_wkt(shapes[at + 8 : at + 8 + size]))
        at += 8 + size
    for i in range(count):
        row = layer.values(table[start + i * width : start + (i + 1) * width])
        out.append([*row, geometries[i] if i < len(geometries) else None, layer.crs])
    return out


def _listed(spark: SparkSession, path: str) -> list[str]:
    """Layers at a .shp path or in a folder, without suffix, by name; from any store that Spark knows."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = where.getFileSystem(spark._jsc.hadoopConfiguration())
    found = [str(s.getPath()) for s in files.listStatus(where) if s.isFile()]
    return sorted(f[:-4] for f in found if f.lower().endswith(".shp"))


def _head(spark: SparkSession, path: str) -> bytes:
    """The head of an attribute table, of which no more is read."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    files, read = where.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.commons.io.IOUtils.toByteArray
    stream = files.open(where)
    try:
        first = bytes(read(stream, 32))
        return first + bytes(read(stream, struct.unpack("<H", first[8:10])[0] - 32))
    finally:
        stream.close()


def read_shapefile(spark: SparkSession, path: str, records: int = layers.RECORDS) -> DataFrame:
    """A .shp file with its .dbf (and .shx, .prj), or a folder of such files with the same attributes. Tasks read ranges of
    records; from a store that only Spark can open, a task reads a layer."""
    bases = _listed(spark, path)
    if not bases:
        raise FileNotFoundError(f"no layer at {path}")
    try:
        layers.store(bases[0])
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError):
        return _whole_layers(spark, bases)
    return layers.read(spark, bases, records)


def _whole_layers(spark: SparkSession, bases: list[str]) -> DataFrame:
    files = _files(spark, [f"{b}.*" for b in bases]).withColumn("kind", F.lower(F.regexp_extract("path", r"\.([^.]+)$", 1)))
    content = lambda kind: F.first(
        F.when(F.col("kind") == kind, F.col("content")), ignorenulls=True
    ).alias(kind)
    found = files.where(F.col("kind").isin("shp", "dbf", "prj")).groupBy(
        F.regexp_replace("path", r"\.[^.]+$", "").alias("base")
    ).agg(*map(content, ("shp", "dbf", "prj"))).where("shp is not null")
    names = [*(n for n, _, _ in dbf_fields(_head(spark, bases[0] + ".dbf"))), "geometry", "crs"]

    def run(batches):
        for batch in batches:
            for shapes, table, projection in zip(*(batch.column(i).to_pylist() for i in range(3))):
                yield _batch(names, shape_rows(shapes, table, projection and projection.decode("utf-8", "replace")))

    return found.select("shp", "dbf", "prj").mapInArrow(run, _strings(names))


def auto(spark: SparkSession, path: str) -> DataFrame:
    suffix = os.path.splitext(path)[1].lower()
    kinds = {
        ".csv": read_csv, ".txt": read_csv, ".geojson": read_geojson, ".json": read_geojson, ".xlsx": read_workbook,
        ".xls": read_workbook, ".shp": read_shapefile
    }
    if suffix not in kinds:
        raise ValueError(f"no reader for {suffix or path}")
    return kinds[suffix](spark, path)


def read_any(
    spark: SparkSession, path: str, tried: tuple[str, ...] = ("utf-8-sig", "gbk", "gb18030", "latin-1")
) -> DataFrame:
    """A CSV file in the first of the encodings that it is valid in, without line ends inside of fields: large files are split."""
    return read_csv(spark, path, encoding_of(spark, path, tried), multi_line=False)


def columns(spark: SparkSession, path: str) -> list[str]:
    return auto(spark, path).columns


def resolve(spark: SparkSession, name: str, folders: list[str]) -> str:
    """The first of the ordered folders that has the file."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for folder in folders:
        where = path(found := f"{folder.rstrip('/')}/{name}")
        if where.getFileSystem(conf).exists(where):
            return found
    raise FileNotFoundError(name)


def read_state(spark: SparkSession, path: str) -> dict:
    """What sinks.save_state has written: tasks, relations, lineage of files; a small file."""
    return json.loads(spark.read.text(path, wholetext=True).first().value)


def read_rows(spark: SparkSession, folder: str, kind: str, schema: str) -> DataFrame:
    """The last version of a state that sinks.save_rows has written to its end; no rows if there is none."""
    path, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for name in sorted(children(spark, f"{folder}/{kind}"), key=lambda n: -int(n.rpartition("=")[2])):
        done = path(f"{folder}/{kind}/{name}/_SUCCESS")
        if done.getFileSystem(conf).exists(done):
            return spark.read.schema(schema).json(f"{folder}/{kind}/{name}")
    return spark.createDataFrame([], schema)
