"""Files as frames with dense positions in the order of paths and rows."""

from __future__ import annotations

import os
from collections.abc import Iterable
from typing import Any

import pyarrow as pa
import pyarrow.ipc
from pyspark.sql import DataFrame, SparkSession

from weftline.ingest import frame
from weftline.position import with_row_index, with_scan_order


def paths(folder: str | None, files: str | Iterable[str] | None) -> list[str]:
    """The files of a source; a dict of splits is refused, since a source is one table."""
    if isinstance(files, dict):
        raise ValueError("A source takes a path or a list of paths; give each split a source of its own.")
    if files is None:
        return [folder]
    names = [files] if isinstance(files, str) else list(files)
    return [os.path.join(folder, n) if folder else n for n in names]


def parquet(spark: SparkSession, path: str, *columns: str) -> DataFrame:
    df = with_row_index(spark.read.parquet(path))
    return df.select(*columns, "__pos") if columns else df


def csv(spark: SparkSession, folder: str | None = None, files: str | Iterable[str] | None = None, sep: str = ",", schema: str | None = None, **options: Any) -> DataFrame:
    reader = spark.read.options(header=True, sep=sep, **options)
    reader = reader.schema(schema) if schema else reader.option("inferSchema", True)
    return with_scan_order(reader.csv(paths(folder, files)))


def json(spark: SparkSession, folder: str | None = None, files: str | Iterable[str] | None = None, schema: str | None = None, **options: Any) -> DataFrame:
    """One object a line, or with multiLine=True one array a file."""
    reader = spark.read.options(**options)
    return with_scan_order((reader.schema(schema) if schema else reader).json(paths(folder, files)))


def text(spark: SparkSession, folder: str | None = None, files: str | Iterable[str] | None = None, **options: Any) -> DataFrame:
    """One row a line, in the column text."""
    return with_scan_order(spark.read.options(**options).text(paths(folder, files))).withColumnRenamed("value", "text")


def saved(spark: SparkSession, path: str) -> DataFrame:
    """A saved dataset folder: Parquet, or Arrow stream and file shards (which the driver reads, so of driver size)."""
    shards = sorted(n for n in os.listdir(path) if n.endswith(".arrow")) if os.path.isdir(path) else []
    if not shards:
        return parquet(spark, path)
    tables = []
    for n in shards:
        with pa.memory_map(os.path.join(path, n)) as source:
            try:
                tables.append(pa.ipc.open_stream(source).read_all())
            except pa.ArrowInvalid:
                source.seek(0)
                tables.append(pa.ipc.open_file(source).read_all())
    return frame(spark, pa.concat_tables(tables))
