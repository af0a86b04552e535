"""Any value a step returns, as rows: the driver's part, on Arrow, with one set of rules for types."""

from __future__ import annotations

import inspect
import pickle
from collections.abc import Callable, Iterable, Iterator
from datetime import datetime
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema

from weftline.position import POS
from weftline.storage import table_path


class StepOutputError(Exception):
    """What a step returned can't be its output."""


class StepOutputTypeError(TypeError, StepOutputError):
    """The values of a column have no common type."""


PICKLED = {b"weftline": b"pickled"}
#: What marks such a column in a schema of Spark.
PICKLED_MARK = "weftline.pickled"
#: Rows of a generator that the driver holds at a time.
HELD_ROWS = 50_000


class LazyRows:
    """A generator of rows that runs when its rows are needed, and how many it will give if that is known."""

    def __init__(self, rows: Callable[[], Iterable[Any]], total_num_rows: int | None = None, auto_progress: bool = True, save: bool = False) -> None:
        self.rows, self.total_num_rows, self.auto_progress, self.save = rows, total_num_rows, auto_progress, save


class LazyRowBatches(LazyRows):
    """The same for a generator of batches: dicts of columns, tuples of columns, or lists of rows or columns."""


def _plain(value: Any, allow_pickle: bool) -> Any:
    """A value Arrow knows: sets and tuples are lists; other objects only as pickled bytes."""
    if isinstance(value, (set, frozenset)):
        value = sorted(value, key=repr)
    if isinstance(value, (list, tuple)):
        return [_plain(v, allow_pickle) for v in value]
    if isinstance(value, dict):
        return {str(k): _plain(v, allow_pickle) for k, v in value.items()}
    if value is None or isinstance(value, (bool, int, float, str, bytes, datetime)):
        return value
    if hasattr(value, "tolist"):  # NumPy
        return _plain(value.tolist(), allow_pickle)
    if allow_pickle:
        return pickle.dumps(value)
    raise StepOutputTypeError(f"A value of type {type(value).__name__} can't be stored; pickling has to be asked for.")


def column(values: Iterable[Any], name: str = "", allow_pickle: bool = False) -> pa.Array:
    """Values as one Arrow column: int and float mix to float, dict keys are united, nothing else mixes."""
    plain = [_plain(v, allow_pickle) for v in values]
    kinds = {type(v) for v in plain if v is not None}
    if kinds == {int, float}:
        plain, kinds = [v if v is None else float(v) for v in plain], {float}
    if len(kinds) > 1:
        raise StepOutputTypeError(f"Column '{name}' mixes {', '.join(sorted(k.__name__ for k in kinds))}.")
    try:
        return pa.array(plain, pa.timestamp("us")) if kinds == {datetime} else pa.array(plain)
    except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
        raise StepOutputTypeError(f"Column '{name}': {e}") from e


def arrow_table(columns: dict[str, Iterable[Any]], allow_pickle: bool = False) -> pa.Table:
    arrays = {k: v if isinstance(v, (pa.Array, pa.ChunkedArray)) else column(v, k, allow_pickle) for k, v in columns.items()}
    lengths = {k: len(v) for k, v in arrays.items()}
    if len(set(lengths.values())) > 1:
        raise StepOutputError(f"Columns have different lengths: {lengths}.")
    fields = []
    for name, a in arrays.items():
        pickled = allow_pickle and pa.types.is_binary(a.type)
        fields.append(pa.field(name, a.type, metadata=PICKLED if pickled else None))
    return pa.table(list(arrays.values()), schema=pa.schema(fields))


def _is_column(value: Any) -> bool:
    return isinstance(value, (list, tuple, range, pa.Array, pa.ChunkedArray)) or hasattr(value, "__array__") or isinstance(value, Iterator)


def _from_rows(rows: list[dict[str, Any]], names: list[str]) -> dict[str, list[Any]]:
    for r in rows:
        if set(r) != set(names):
            raise StepOutputError(f"Expected rows with the keys {names}, got {sorted(r)}.")
    return {n: [r[n] for r in rows] for n in names}


def _from_row_tuples(rows: list[Any], names: list[str]) -> dict[str, list[Any]]:
    for r in rows:
        if len(r) != len(names):
            raise StepOutputError(f"Expected rows of {len(names)} values, got {len(r)}.")
    return {n: [r[i] for r in rows] for i, n in enumerate(names)}


def normalised(value: Any, names: list[str]) -> dict[str, list[Any]]:
    """A returned value as columns with the step's output names."""
    if isinstance(value, LazyRows):
        return _lazy(value, names)
    if inspect.isfunction(value) or inspect.ismethod(value):
        raise StepOutputError("A generator function has to be wrapped in LazyRows or LazyRowBatches.")
    if value is None:
        return {n: [] for n in names}
    if isinstance(value, Iterator):
        value = list(value)
    if isinstance(value, pa.Table):
        value = {c: value.column(c) for c in value.column_names}
    if isinstance(value, dict):
        if set(value) != set(names):
            raise StepOutputError(f"Expected the keys {names}, got {sorted(map(str, value))}.")
        if all(_is_column(v) for v in value.values()):
            return {n: list(value[n]) for n in names}
        if any(isinstance(v, (list, range)) or isinstance(v, Iterator) for v in value.values()):
            raise StepOutputError("A dict has to hold either columns or values of one row.")
        return {n: [value[n]] for n in names}
    if isinstance(value, (list, tuple)) and value and all(isinstance(v, dict) for v in value) and not (len(names) == 1 and names[0] not in value[0]):
        return _from_rows(list(value), names)
    if isinstance(value, list):
        if value and all(isinstance(v, tuple) for v in value):
            return _from_row_tuples(value, names) if len(names) > 1 or all(len(v) == 1 for v in value) else {names[0]: value}
        if len(names) == 1:
            return {names[0]: value}
        if value and all(_is_column(v) for v in value):
            value = tuple(value)
        elif value:
            raise StepOutputError(f"Expected {len(names)} columns, got a list of values.")
        else:
            return {n: [] for n in names}
    if isinstance(value, tuple):
        if len(value) != len(names):
            raise StepOutputError(f"Expected {len(names)} columns, got {len(value)}.")
        if all(_is_column(v) for v in value):
            return {n: list(v) for n, v in zip(names, value)}
        return {n: [v] for n, v in zip(names, value)}
    if len(names) == 1:
        return {names[0]: [value]}
    raise StepOutputError(f"Expected {len(names)} columns, got a value of type {type(value).__name__}.")


def _lazy(value: LazyRows, names: list[str]) -> dict[str, list[Any]]:
    out: dict[str, list[Any]] = {n: [] for n in names}
    for got in parts(value, names):
        for n in names:
            out[n] += got[n]
    return out


def parts(value: LazyRows, names: list[str]) -> Iterator[dict[str, list[Any]]]:
    """The columns of each row or batch as the generator gives it."""
    columns_seen = False
    for part in value.rows():
        if isinstance(value, LazyRowBatches):
            if isinstance(part, list) and part and all(isinstance(p, (list, tuple)) for p in part) and len(names) > 1:
                columns_seen = columns_seen or (len(part) == len(names) and not all(len(p) == len(names) for p in part))
                got = normalised(tuple(part) if columns_seen else [tuple(p) for p in part], names)
            else:
                got = normalised(part, names)
        else:
            got = normalised([part] if isinstance(part, (dict, tuple)) else ([tuple(part)] if isinstance(part, list) and len(names) > 1 else [part]), names)
        yield got


def streamed(spark: SparkSession, value: LazyRows, names: list[str], held: int = HELD_ROWS) -> tuple[DataFrame, int]:
    """The rows of a generator as a table written a part at a time, so the driver never holds more than so many, and their number.

    A column of nulls only is left out of its part, so the first other value says its type.
    """
    path, n, schema = table_path(spark), 0, T.StructType()
    rows: dict[str, list[Any]] = {c: [] for c in names}

    def write() -> None:
        nonlocal n
        table = arrow_table(rows)
        some = [c for c in names if not pa.types.is_null(table.schema.field(c).type)]
        df = frame(spark, table.select(some) if some else pa.table({})) if some else spark.range(table.num_rows).select(F.col("id").alias(POS))
        for f in df.schema:
            if f.name in schema.names and schema[f.name].dataType != f.dataType:
                raise StepOutputTypeError(f"Column '{f.name}' is {schema[f.name].dataType.simpleString()} first and {f.dataType.simpleString()} later.")
            if f.name not in schema.names:
                schema.add(f)
        df.withColumn(POS, F.col(POS) + F.lit(n).cast("bigint")).write.mode("append").parquet(path)
        n += table.num_rows
        for c in names:
            rows[c].clear()

    for got in parts(value, names):
        for c in names:
            rows[c] += got[c]
        if names and len(rows[names[0]]) >= held:
            write()
    if not n or (names and rows[names[0]]):
        write()
    for c in names:
        if c not in schema.names:
            schema.add(c, T.StringType())
    return spark.read.schema(schema).parquet(path).select(*(f"`{c}`" for c in names), POS), n


def frame(spark: SparkSession, table: pa.Table) -> DataFrame:
    """An Arrow table as a DataFrame with dense positions. Columns of nulls only are strings, since files can't hold the null type."""
    table = pa.table(
        [c.cast(pa.string()) if pa.types.is_null(c.type) else c for c in table.columns],
        schema=pa.schema([pa.field(f.name, pa.string() if pa.types.is_null(f.type) else f.type, metadata=f.metadata) for f in table.schema]),
    )
    pickled = {f.name for f in table.schema if (f.metadata or {}).get(b"weftline") == b"pickled"}
    table = table.append_column(POS, pa.array(range(table.num_rows), pa.int64()))
    schema = from_arrow_schema(table.schema, prefer_timestamp_ntz=True)
    fields = [T.StructField(f.name, f.dataType, f.nullable, {PICKLED_MARK: True} if f.name in pickled else None) for f in schema.fields]
    if table.num_rows == 0:
        return spark.createDataFrame([], T.StructType(fields))
    return spark.createDataFrame(table, T.StructType(fields))


def unpickled(value: bytes) -> Any:
    """A pickled value back. Only for values of one's own session: unpickling runs code."""
    return pickle.loads(value)  # noqa: S301
