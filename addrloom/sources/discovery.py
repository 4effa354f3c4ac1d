"""Which layers there are in folders and databases, and the first of them that serves a purpose.

Only names and headers are looked at: a layer's rows are read by whoever uses it, through Spark's readers."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from . import readers


@dataclass
class Layer:
    """Where a layer was found, by which it is opened."""

    name: str
    place: str
    open: Callable[[], DataFrame]

    def columns(self) -> list[str]:
        return self.open().columns

    def has(self, *names: str) -> bool:
        return set(names) <= {c.lower() for c in self.columns()}


def in_database(
    spark: SparkSession, url: str, tables: list[str], split: tuple[str, int, int, int] | None = None, **options: str
) -> Iterator[Layer]:
    """Tables of a database, over JDBC. split is (a whole-number column, its least and greatest value, parts to read at a time)."""
    for table in tables:
        source = spark.read.format("jdbc").options(url=url, dbtable=table, **options)
        if split:
            names = ("partitionColumn", "lowerBound", "upperBound", "numPartitions")
            source = source.options(**dict(zip(names, map(str, split))))
        yield Layer(table, url, source.load)


def in_folders(spark: SparkSession, folders: list[str]) -> Iterator[Layer]:
    """Files that a reader knows, and folders of the parts of one layer or table, by folder in the order given, then by name."""
    where, conf = spark._jvm.org.apache.hadoop.fs.Path, spark._jsc.hadoopConfiguration()
    for folder in folders:
        at = where(folder)
        files = at.getFileSystem(conf)
        if not files.exists(at):
            continue
        for status in sorted(files.listStatus(at), key=lambda s: s.getPath().getName()):
            name, path = status.getPath().getName(), str(status.getPath())
            if name[0] in "._":
                continue
            suffixes = {name.rpartition(".")[2].lower()} if status.isFile() else {
                s.getPath().getName().rpartition(".")[2].lower() for s in files.listStatus(status.getPath()) if s.isFile()
            }
            for suffix, opened in _READERS.items():
                if suffix in suffixes:
                    yield Layer(name, path, lambda opened=opened, path=path: opened(spark, path))
                    break


_READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "parquet": lambda spark, path: spark.read.parquet(path), "shp": readers.read_shapefile, "csv": readers.read_csv,
    "geojson": readers.read_geojson, "xlsx": readers.read_workbook
}


def first_with(layers: Iterator[Layer], *names: str) -> Layer | None:
    """The first layer that has the columns, whatever their case; databases go first where they are listed first. A layer that
    cannot be opened is passed over, as a project may name some that are gone."""
    for layer in layers:
        try:
            if layer.has(*names):
                return layer
        except Exception:  # noqa: BLE001 - what a store or a driver raises is not known here
            continue
    return None


def point_layer(spark: SparkSession, folders: list[str], databases: list[tuple[str, list[str]]] = (), **options: str) -> Layer | None:
    """The layer of points that linked rows are checked against: the first with a code and a name, databases before folders."""
    def all_layers():
        for url, tables in databases:
            yield from in_database(spark, url, tables, **options)
        yield from in_folders(spark, folders)

    return first_with(all_layers(), "code", "name")
