"""Shape layers (.shp, .shx, .dbf, .prj) as a Spark data source: read by ranges of records, written by parts.

Reading. The driver reads the head of a layer's attribute table (32 bytes and 32 for each attribute) and the files' lengths,
which say how many records there are. A task gets a range of them, reads its places from the index (.shx), and of the shapes
and the table those bytes alone. A layer without an index is read from its first to its last record by one task.

Writing. Every task writes parts of at most ``RECORDS`` records, layers of their own with the same attributes, under names that
nothing reads. When all tasks are done the driver gives them their names; a task that fails, or runs twice, leaves nothing.

Bytes are read and written through pyarrow's file systems; ``readers.read_shapefile`` has a way for stores that only Spark knows.
"""

from __future__ import annotations

import re
import struct
import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

from .sinks import clipped, dbf_names, dbf_type

#: Records a task reads, and a part has at most; bytes that are read at a time.
RECORDS, CHUNK = 50_000, 8 << 20
#: Tasks that read, beyond which a task gets several ranges of up to RECORDS together. Files that the driver opens at a time.
READERS, AT_ONCE = 128, 16


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it; an error where pyarrow has none."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w[\w+.-]+:", path) else (fs.LocalFileSystem(), path)


# Geometries -------------------------------------------------------------------------------------------------------------
KINDS = {"POINT": 1, "LINESTRING": 3, "MULTILINESTRING": 3, "POLYGON": 5, "MULTIPOLYGON": 5, "MULTIPOINT": 8}
_HEAD = re.compile(r"\s*(MULTIPOINT|POINT|MULTILINESTRING|LINESTRING|MULTIPOLYGON|POLYGON)\s*Z?M?\s*(EMPTY|\(.*\))\s*$", re.I | re.S)


def wkt_kind(wkt: str | None) -> str | None:
    """The kind of a geometry by its text, in capitals; none if it has no such form."""
    found = _HEAD.match(wkt or "")
    return found[1].upper() if found else None


def _points(text: str) -> list[tuple[float, float]]:
    return [tuple(map(float, p.strip(" ()").split()[:2])) for p in text.split(",")]


def parse_wkt(wkt: str | None) -> tuple[str, list[list[tuple[float, float]]]] | None:
    """(kind, parts): the rings or lines of a geometry, each a list of points; of points one part. None where the text is no
    geometry, or an empty one."""
    found = _HEAD.match(wkt or "")
    if not found or found[2].upper() == "EMPTY":
        return None
    kind, body = found[1].upper(), found[2]
    try:
        if KINDS[kind] in (1, 8):
            return kind, [_points(body.replace("(", " ").replace(")", " "))]
        parts = [_points(p) for p in re.findall(r"\(([^()]+)\)", body)]
    except ValueError:
        return None
    return (kind, parts) if parts else None


def _area(ring: list[tuple[float, float]]) -> float:
    """Twice the area, positive where the ring runs clockwise."""
    return sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in zip(ring, ring[1:] + ring[:1]))


def shape(wkt: str | None) -> tuple[bytes, tuple[float, float, float, float] | None]:
    """A record's content and its bounds; a null shape for what is no geometry.

    Of a polygon each first ring is turned clockwise and the others, its holes, the other way, as the format has it."""
    parsed = parse_wkt(wkt)
    if not parsed:
        return struct.pack("<i", 0), None
    kind, parts = parsed
    if KINDS[kind] == 5:
        outer = [True] + [False] * (len(parts) - 1)
        if kind == "MULTIPOLYGON":  # a ring after two closing brackets begins a polygon
            outer = [m[1].count("(") > 1 or i == 0 for i, m in enumerate(re.finditer(r"(\(+)\s*[^()\s]", wkt))]
        parts = [p if (_area(p) >= 0) == first else p[::-1] for p, first in zip(parts, outer)]
    points = [p for part in parts for p in part]
    xs, ys = zip(*points)
    box = (min(xs), min(ys), max(xs), max(ys))
    flat = struct.pack(f"<{2 * len(points)}d", *(v for p in points for v in p))
    if kind == "POINT":
        return struct.pack("<i", 1) + flat, box
    head = struct.pack("<i4d", KINDS[kind], *box)
    if kind == "MULTIPOINT":
        return head + struct.pack("<i", len(points)) + flat, box
    starts, n = [], 0
    for part in parts:
        starts.append(n)
        n += len(part)
    return head + struct.pack(f"<2i{len(parts)}i", len(parts), n, *starts) + flat, box


def _line(points) -> str:
    return "(" + ", ".join(f"{x:.10g} {y:.10g}" for x, y in points) + ")"


def shape_wkt(record: bytes) -> str | None:
    """Well-known text of a record's content; rings that run clockwise begin a polygon, the others are its holes."""
    kind = struct.unpack_from("<i", record)[0] % 10
    if kind == 1:
        return "POINT ({:.10g} {:.10g})".format(*struct.unpack_from("<2d", record, 4))
    if kind == 8:
        n = struct.unpack_from("<i", record, 36)[0]
        flat = struct.unpack_from(f"<{2 * n}d", record, 40)
        return "MULTIPOINT " + _line(zip(flat[::2], flat[1::2]))
    if kind not in (3, 5):
        return None
    count, n = struct.unpack_from("<2i", record, 36)
    starts = [*struct.unpack_from(f"<{count}i", record, 44), n]
    flat = struct.unpack_from(f"<{2 * n}d", record, 44 + 4 * count)
    points = list(zip(flat[::2], flat[1::2]))
    parts = [points[a:b] for a, b in zip(starts, starts[1:])]
    if kind == 3:
        return f"LINESTRING {_line(parts[0])}" if count == 1 else f"MULTILINESTRING ({', '.join(map(_line, parts))})"
    polygons: list[list[str]] = []
    for part in parts:
        if _area(part) >= 0 or not polygons:
            polygons.append([])
        polygons[-1].append(_line(part))
    whole = [f"({', '.join(rings)})" for rings in polygons]
    return f"POLYGON {whole[0]}" if len(whole) == 1 else f"MULTIPOLYGON ({', '.join(whole)})"


# Attributes -------------------------------------------------------------------------------------------------------------
def dbf_fields(head: bytes) -> list[tuple[str, str, int]]:
    """(name, type, size) of the attributes, by the head of a table."""
    size, out = struct.unpack_from("<H", head, 8)[0], []
    for at in range(32, size - 1, 32):
        if head[at] == 0x0D:
            break
        out.append((head[at : at + 11].split(b"\0")[0].decode("utf-8", "replace"), chr(head[at + 11]), head[at + 16]))
    return out


def crs_of(projection: str | None) -> str | None:
    """The authority's name of a .prj text, or else the name that it begins with."""
    name = re.search(r'AUTHORITY\["EPSG","(\d+)"\]\]\s*$', projection or "")
    found = re.search(r'\["([^"]+)"', projection or "")
    return f"EPSG:{name[1]}" if name else found[1] if found else None


@dataclass
class Layer:
    """A layer without its suffix, what its table's head says, and its number of records; none if there is no index."""

    base: str
    fields: list[tuple[str, str, int]]
    start: int
    width: int
    rows: int
    crs: str | None
    indexed: bool

    @classmethod
    def of(cls, base: str) -> Layer:
        files, path = store(base)
        with files.open_input_file(path + ".dbf") as file:
            head = file.read(32)
            rows, start, width = struct.unpack_from("<IHH", head, 4)
            fields = dbf_fields(head + file.read(start - 32))
        found = {i.path.rsplit(".", 1)[1]: i for i in files.get_file_info([path + ".shx", path + ".prj"]) if i.type == fs.FileType.File}
        crs = None
        if "prj" in found:
            with files.open_input_file(path + ".prj") as file:
                crs = crs_of(file.read().decode("utf-8", "replace"))
        return cls(base, fields, start, width, rows, crs, "shx" in found)

    def names(self) -> list[str]:
        return [*(n for n, _, _ in self.fields), "geometry", "crs"]

    def values(self, row: bytes) -> list[str | None]:
        out, at = [], 1
        for _, _, size in self.fields:
            out.append(row[at : at + size].decode("utf-8", "replace").strip() or None)
            at += size
        return out

    def shapes(self, first: int, last: int) -> Iterator[str | None]:
        """Geometries of a range of records; by the index, or from the beginning."""
        files, path = store(self.base)
        with files.open_input_file(path + ".shp") as file:
            if not self.indexed:
                file.seek(100)
                for _ in range(self.rows):
                    head = file.read(8)
                    if len(head) < 8:
                        yield None
                        continue
                    yield shape_wkt(file.read(2 * struct.unpack(">2i", head)[1]))
                return
            with files.open_input_file(path + ".shx") as index:
                index.seek(100 + 8 * first)
                places = index.read(8 * (last - first))
            at = [tuple(2 * x for x in p) for p in struct.iter_unpack(">2i", places)]
            i = 0
            while i < len(at):  # runs of records that lie one after the other, up to CHUNK bytes
                j = i
                while j + 1 < len(at) and 0 <= at[j + 1][0] + at[j + 1][1] - at[i][0] <= CHUNK:
                    j += 1
                file.seek(at[i][0])
                data = file.read(at[j][0] + at[j][1] + 8 - at[i][0])
                for offset, size in at[i : j + 1]:
                    begin = offset - at[i][0] + 8
                    yield shape_wkt(data[begin : begin + size])
                i = j + 1
            yield from [None] * (last - first - len(at))

    def records(self, first: int, last: int) -> Iterator[pa.RecordBatch]:
        files, path = store(self.base)
        shapes, names = self.shapes(first, last), self.names()
        with files.open_input_file(path + ".dbf") as file:
            file.seek(self.start + first * self.width)
            step = max(1, min(5000, CHUNK // max(1, self.width)))
            for at in range(first, last, step):
                n = min(step, last - at)
                data = file.read(n * self.width)
                rows = [
                    [*self.values(data[i * self.width : (i + 1) * self.width]), next(shapes, None), self.crs] for i in range(n)
                ]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.string()) for i in range(len(names))], names)


# The source -------------------------------------------------------------------------------------------------------------
@dataclass
class Records(InputPartition):
    ranges: list[tuple[Layer, int, int]]


class LayerReader(DataSourceReader):
    def __init__(self, bases: list[str], records: int):
        self.bases, self.records = bases, records

    def partitions(self) -> list[Records]:
        ranges = []
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for layer in pool.map(Layer.of, self.bases):
                step = self.records if layer.indexed else max(1, layer.rows)
                ranges += [(layer, i, min(i + step, layer.rows)) for i in range(0, max(1, layer.rows), step)]
        n = min(len(ranges), max(READERS, -(-sum(last - first for _, first, last in ranges) // RECORDS)))
        return [Records(ranges[i * len(ranges) // n : (i + 1) * len(ranges) // n]) for i in range(n)]

    def read(self, partition: Records) -> Iterator[pa.RecordBatch]:
        for layer, first, last in partition.ranges:
            yield from layer.records(first, last)


@dataclass
class Parts(WriterCommitMessage):
    """(temporary base, final base) of what a task has written."""

    written: list[tuple[str, str]]


class LayerWriter(DataSourceArrowWriter):
    """Rows whose columns are the attributes (text), geometry (text) and crs; the attributes' heads are an option."""

    def __init__(self, folder: str, heads: list[tuple[str, str, int, int]], projection: str | None, records: int):
        self.folder, self.heads, self.projection, self.records = folder.rstrip("/"), heads, projection, records
        self.run = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Parts:
        files, folder = store(self.folder)
        held, parts, task = [], [], TaskContext.get()
        name = f"part-{task.partitionId():05d}"

        def flush() -> None:
            final = f"{folder}/{name}-{len(parts):03d}-{self.run}"
            temporary = f"{folder}/_temporary-{self.run}/{task.taskAttemptId()}-{len(parts)}"
            files.create_dir(f"{folder}/_temporary-{self.run}", recursive=True)
            for suffix, data in layer_files(held, self.heads, self.projection).items():
                with files.open_output_stream(temporary + suffix) as out:
                    out.write(data)
            parts.append((temporary, final))
            held.clear()

        for batch in iterator:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                held.append(row)
                if len(held) == self.records:
                    flush()
        if held:
            flush()
        return Parts(parts)

    def _suffixes(self) -> list[str]:
        return [".shx", ".dbf", *([".prj"] if self.projection else []), ".shp"]

    def commit(self, messages: list[Parts]) -> None:
        files, folder = store(self.folder)
        def named(part: tuple[str, str]) -> None:
            for suffix in self._suffixes():
                files.move(part[0] + suffix, part[1] + suffix)

        with ThreadPoolExecutor(AT_ONCE) as pool:
            list(pool.map(named, (p for m in messages if m for p in m.written)))
        self._cleared(files, folder)

    def abort(self, messages: list[Parts]) -> None:
        self._cleared(*store(self.folder))

    def _cleared(self, files: fs.FileSystem, folder: str) -> None:
        if files.get_file_info(f"{folder}/_temporary-{self.run}").type == fs.FileType.Directory:
            files.delete_dir(f"{folder}/_temporary-{self.run}")


class LayerSource(DataSource):
    """Options: paths (of layers without suffix, one a line) to read; path, heads and prj to write; records."""

    @classmethod
    def name(cls) -> str:
        return "layer"

    def schema(self) -> StructType:
        names = Layer.of(self.options["paths"].split("\n")[0]).names()
        return StructType([StructField(n, StringType()) for n in names])

    def reader(self, schema: StructType) -> LayerReader:
        return LayerReader(self.options["paths"].split("\n"), int(self.options.get("records", RECORDS)))

    def writer(self, schema: StructType, overwrite: bool) -> LayerWriter:
        heads = [tuple(h.split("\t")) for h in self.options["heads"].split("\n") if h]
        return LayerWriter(
            self.options["path"], [(n, k, int(s), int(d)) for n, k, s, d in heads], self.options.get("prj"),
            int(self.options.get("records", RECORDS))
        )


def layer_files(rows: list[tuple], heads: list[tuple[str, str, int, int]], projection: str | None) -> dict[str, bytes]:
    """The files of one part. rows are (attributes, geometry); heads are (name, type, size, decimals)."""
    boxes, shapes, index, at = [], [], [], 100
    for n, row in enumerate(rows, 1):
        content, box = shape(row[len(heads)])
        boxes += [box] if box else []
        shapes.append(struct.pack(">2i", n, len(content) // 2) + content)
        index.append(struct.pack(">2i", at // 2, len(content) // 2))
        at += 8 + len(content)
    kinds = {struct.unpack_from("<i", s, 8)[0] for s in shapes} - {0}
    box = [f(b[i] for b in boxes) for f, i in ((min, 0), (min, 1), (max, 2), (max, 3))] if boxes else [0.0] * 4
    head = lambda size: struct.pack(">7i", 9994, 0, 0, 0, 0, 0, size // 2) + struct.pack(
        "<2i8d", 1000, max(kinds, default=0), *box, 0, 0, 0, 0
    )
    fields = b"".join(
        name.encode().ljust(11, b"\0") + kind.encode() + bytes(4) + bytes([size, min(decimals, 15)]) + bytes(14)
        for name, kind, size, decimals in heads
    )
    table = bytes([3, 100, 1, 1]) + struct.pack(
        "<IHH", len(rows), 33 + 32 * len(heads), 1 + sum(h[2] for h in heads)
    ) + bytes(20) + fields + b"\r"
    cells = lambda row: (
        clipped(v or "", size).ljust(size) if kind == "C" else clipped(v or "", size).rjust(size)
        for v, (_, kind, size, _) in zip(row, heads)
    )
    table += b"".join(b" " + b"".join(cells(row)) for row in rows) + b"\x1a"
    made = {".shp": head(at) + b"".join(shapes), ".shx": head(100 + 8 * len(rows)) + b"".join(index), ".dbf": table}
    return made | ({".prj": projection.encode()} if projection else {})


def read(spark: SparkSession, bases: list[str], records: int = RECORDS) -> DataFrame:
    """Layers (paths without suffix) with the same attributes: those as text, geometry as well-known text, and crs."""
    spark.dataSource.register(LayerSource)
    return spark.read.format("layer").option("paths", "\n".join(bases)).option("records", records).load()


def _heads(rows: DataFrame, names: list[str], first: list) -> list[tuple[str, str, int, int]]:
    """(name, type, size, decimals) of the attributes c0, c1 and so on, by one look at all rows."""
    def of(i: int) -> list:
        c, dot = F.col(f"c{i}"), F.instr(f"c{i}", ".")
        numbers = {"n": "long", "f": "double"}
        return [
            F.max(F.octet_length(c)).alias(f"s{i}"), F.max(F.when(dot > 0, F.length(c) - dot).otherwise(0)).alias(f"d{i}"),
            *(F.bool_and((c == "") | c.try_cast(kind).isNotNull()).alias(f"{n}{i}") for n, kind in numbers.items())
        ]

    found = rows.agg(*(x for i in range(len(names)) for x in of(i))).first() if names else None
    out = []
    for i, short in enumerate(dbf_names(names)):
        kind = dbf_type([r[i] for r in first])
        kind = "C" if kind == "C" or found[f"{kind.lower()}{i}"] is False else kind
        out.append((short, kind, max(1, min(254, found[f"s{i}"] or 1)), (found[f"d{i}"] or 0) if kind == "F" else 0))
    return out


def write(df: DataFrame, folder: str, geometry: str = "geometry", projection: str | None = None, records: int = RECORDS) -> None:
    """Writes rows as a layer in parts. All columns but the geometry are attributes: whole numbers, numbers or text by what the
    first hundred rows hold; of a text's bytes 254 are kept, cut between letters. A column of numbers that holds anything else
    later on is text. What is no geometry becomes a null shape; shapes of different kinds are an error. Without rows there is
    one empty part."""
    names = [c for c in df.columns if c != geometry]
    quoted = {c: F.col("`" + c.replace("`", "``") + "`") for c in df.columns}
    rows = df.select(
        *(F.coalesce(quoted[c].cast("string"), F.lit("")).alias(f"c{i}") for i, c in enumerate(names)),
        quoted[geometry].cast("string").alias("g")
    )
    word = F.upper(F.regexp_extract("g", r"(?i)^\s*(MULTIPOINT|POINT|MULTILINESTRING|LINESTRING|MULTIPOLYGON|POLYGON)", 1))
    kinds = {KINDS[r.k] for r in rows.select(word.alias("k")).where("k <> ''").distinct().collect()}
    if len(kinds) > 1:
        raise ValueError("a layer has shapes of one kind: write points, lines and polygons apart")
    first = rows.limit(100).collect()
    heads = _heads(rows, names, first)
    if not first:
        files, path = store(folder)
        files.create_dir(path, recursive=True)
        empty = f"{path}/part-00000-000-{uuid.uuid4().hex}"
        for suffix, data in layer_files([], heads, projection).items():
            with files.open_output_stream(empty + suffix) as out:
                out.write(data)
        return
    df.sparkSession.dataSource.register(LayerSource)
    out = rows.write.format("layer").mode("append").option("path", folder).option("records", records).option(
        "heads", "\n".join("\t".join(map(str, h)) for h in heads)
    )
    (out.option("prj", projection) if projection else out).save()


def write_points(df: DataFrame, folder: str, x: str, y: str, projection: str | None = None) -> None:
    """Rows with coordinates as a layer of points; a row that lacks one has a null shape."""
    at = [F.col("`" + c.replace("`", "``") + "`").cast("double").cast("string") for c in (x, y)]
    point = F.concat(F.lit("POINT ("), at[0], F.lit(" "), at[1], F.lit(")"))
    rest = [F.col("`" + c.replace("`", "``") + "`") for c in df.columns if c not in (x, y)]
    write(df.select(*rest, point.alias("_geometry")), folder, "_geometry", projection)
