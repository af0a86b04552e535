"""Projections, filters and functions of rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from weftline.position import POS, visible


def names(columns: str | Iterable[str]) -> list[str]:
    return [columns] if isinstance(columns, str) else list(columns)


def _check(df: DataFrame, columns: Iterable[str]) -> None:
    missing = [c for c in columns if c not in visible(df)]
    if missing:
        raise AssertionError(f"No such columns: {missing}; there are {visible(df)}.")


def _hidden(df: DataFrame) -> list[str]:
    return [POS] if POS in df.columns else []


def select_columns(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    """The named columns in the order given; a missing one raises AssertionError."""
    wanted = names(columns)
    _check(df, wanted)
    return df.select(*(f"`{c}`" for c in wanted), *_hidden(df))


def remove_columns(df: DataFrame, columns: str | Iterable[str]) -> DataFrame:
    _check(df, names(columns))
    return df.drop(*names(columns))


def rename_columns(df: DataFrame, mapping: dict[str, str]) -> DataFrame:
    """Renamed columns; names that stay the same are no work. A new name that is taken raises ValueError."""
    mapping = {a: b for a, b in mapping.items() if a != b}
    _check(df, mapping)
    after = [mapping.get(c, c) for c in visible(df)]
    if len(set(after)) < len(after):
        raise ValueError(f"Renaming would repeat a name: {after}.")
    return df.withColumnsRenamed(mapping) if mapping else df


def rename_column(df: DataFrame, original: str, new: str) -> DataFrame:
    return rename_columns(df, {original: new})


def cast_column(df: DataFrame, column: str, kind: str) -> DataFrame:
    _check(df, [column])
    return df.withColumn(column, F.col(f"`{column}`").cast(kind))


def schema_of(schema: T.StructType | str) -> T.StructType:
    return T.StructType.fromDDL(schema) if isinstance(schema, str) else schema


def map_columns(df: DataFrame, columns: dict[str, Column], remove: Iterable[str] = ()) -> DataFrame:
    """Columns added or replaced by expressions: all of it stays in the plan that Spark optimises."""
    return df.withColumns(columns).drop(*remove)


def map_rows(
    df: DataFrame, function: Callable[..., Any], schema: T.StructType | str, *, with_indices: bool = False, input_columns: str | Iterable[str] | None = None,
    batched: bool = False, batch_size: int = 1000, remove: str | Iterable[str] | None = None,
) -> DataFrame:
    """Columns by a Python function of a row (dict to dict), or of a batch (dict of lists to dict of lists).

    schema names the columns the function returns; the others persist unless removed. A batch function may return another
    number of rows if all columns it doesn't return are removed; such rows get positions with gaps. With input_columns,
    the function gets their values one by one. Batches never cross partitions, so batch functions must work row by row.
    """
    out = schema_of(schema)
    dropped = set(names(remove or []))
    kept = [f for f in df.schema if f.name not in dropped and f.name not in out.names and f.name != POS]
    inputs = names(input_columns) if input_columns is not None else None
    positioned = POS in df.columns
    whole = T.StructType([*kept, *out.fields, *([T.StructField(POS, T.LongType())] if positioned else [])])
    kept_names, seen = [f.name for f in kept], visible(df)
    arrow = to_arrow_schema(whole)

    def call(values: dict[str, Any], index: Any) -> dict[str, Any]:
        args = [values[c] for c in inputs] if inputs is not None else [values]
        return function(*args, *([index] if with_indices else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, batch_size):
                b = big.slice(at, batch_size)
                columns = {c: b.column(c).to_pylist() for c in seen}
                index = b.column(POS).to_pylist() if positioned else [None] * b.num_rows
                if batched:
                    got = call(columns, index)
                    n = len(next(iter(got.values()))) if got else 0
                    if n != b.num_rows and kept_names:
                        raise ValueError(f"The function returned {n} rows for {b.num_rows}, but columns {kept_names} are kept.")
                    rows = {c: columns[c] for c in kept_names} | {c: list(got[c]) for c in out.names}
                    if n != b.num_rows and positioned:
                        first, last = (index[0], index[-1]) if index else (0, 0)
                        if n > last - first + 1:
                            raise ValueError("More rows than positions: number the rows anew (unordered) before.")
                        index = list(range(first, first + n))
                else:
                    got = [call({c: columns[c][i] for c in seen}, index[i]) for i in range(b.num_rows)]
                    rows = {c: columns[c] for c in kept_names} | {c: [g[c] for g in got] for c in out.names}
                if positioned:
                    rows[POS] = index
                yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) for f in arrow], schema=arrow)

    return df.mapInArrow(run, whole)


def filter_rows(df: DataFrame, function: Callable[..., Any], *, with_indices: bool = False, input_columns: str | Iterable[str] | None = None, batched: bool = False, batch_size: int = 1000) -> DataFrame:
    """The rows of which a Python function is true, in their order; its schema stays, also without rows."""
    inputs = names(input_columns) if input_columns is not None else None
    seen, positioned = visible(df), POS in df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for big in batches:
            for at in range(0, big.num_rows, batch_size):
                b = big.slice(at, batch_size)
                columns = {c: b.column(c).to_pylist() for c in (inputs or seen)}
                index = b.column(POS).to_pylist() if positioned else [None] * b.num_rows
                extra = (lambda i: [index[i]]) if with_indices else (lambda i: [])
                if batched:
                    args = [columns[c] for c in inputs] if inputs is not None else [columns]
                    keep = function(*args, *([index] if with_indices else []))
                else:
                    keep = [function(*([columns[c][i] for c in inputs] if inputs is not None else [{c: v[i] for c, v in columns.items()}]), *extra(i)) for i in range(b.num_rows)]
                yield b.filter(pa.array([bool(k) for k in keep], pa.bool_()))

    return df.mapInArrow(run, df.schema)
