"""Models over rows: one protocol, an Arrow runner, memoised runs and ways to run several models side by side.

A model is either a Column expression (JVM) or an object with run(list of inputs) that runs in the Python workers,
loaded once a worker. External services and GPU engines are adapters: objects with the same run().
"""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator, Sequence
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from weftline.functions.text import checked_length
from weftline.position import POS
from weftline.storage import Files


class Model:
    """name and version say which outputs are interchangeable; output_type is a Spark type; run() is deterministic for an input."""

    name, version, output_type = "model", "1", "string"
    max_length: int | None = None

    def load(self) -> None:
        """Called once in a worker before the first run()."""

    def run(self, inputs: list[Any], **options: Any) -> list[Any]:
        raise NotImplementedError

    def count_tokens(self, text: str) -> int:
        return len(text.split())


class Expression(Model):
    """A model that is an expression of the input column: it stays in the optimised plan."""

    def __init__(self, expression: Callable[[Column], Column], name: str = "expression", version: str = "1") -> None:
        self.expression, self.name, self.version = expression, name, version


class Dictionary(Model):
    """Known answers; others are an error or the default."""

    def __init__(self, answers: dict[str, Any], default: Any = None, name: str = "dictionary") -> None:
        self.answers, self.default, self.name = dict(answers), default, name
        self.version = hashlib.sha256(json.dumps(sorted(self.answers.items()), default=str).encode()).hexdigest()[:12]

    def run(self, inputs: list[Any], **options: Any) -> list[Any]:
        return [self.answers[x] if x in self.answers or self.default is None else self.default for x in inputs]


class HashEmbedder(Model):
    """Unit vectors from hashed words: deterministic, for tests and as a fallback."""

    output_type = "array<float>"

    def __init__(self, dimensions: int = 64, instruction: str = "") -> None:
        self.dimensions, self.instruction, self.name, self.version = dimensions, instruction, "hash_embedder", f"{dimensions}:{instruction}"

    def run(self, inputs: list[Any], **options: Any) -> list[Any]:
        out = []
        for text in inputs:
            v = np.zeros(self.dimensions, np.float32)
            for w in (self.instruction + (text or "")).lower().split():
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimensions] += 1 if h >> 63 else -1
            n = np.linalg.norm(v)
            out.append((v / n if n else v).tolist())
        return out


class Function(Model):
    """A model of a Python function of one input."""

    def __init__(self, function: Callable[[Any], Any], output_type: str = "string", name: str = "function", version: str = "1") -> None:
        self.function, self.output_type, self.name, self.version = function, output_type, name, version

    def run(self, inputs: list[Any], **options: Any) -> list[Any]:
        return [self.function(x) for x in inputs]


class BatchFunction(Function):
    """A model of a Python function of a list of inputs, such as a reward: texts to numbers."""

    def run(self, inputs: list[Any], **options: Any) -> list[Any]:
        return list(self.function(inputs))


class OutOfMemory(Exception):
    """Raised by a model whose batch was too large."""


def length(x: Any) -> int:
    return len(x) if hasattr(x, "__len__") else 0


class BatchSizes:
    """How many inputs a model takes at once, learned by a worker for inputs of each range of lengths (doubling from range to range)."""

    def __init__(self, most: int) -> None:
        self.most, self.known = most, {}

    def of(self, longest: int) -> int:
        """The least that was learned for inputs of this or a shorter length."""
        return min([self.most, *(n for size, n in self.known.items() if size <= longest.bit_length())])

    def failed(self, longest: int, n: int) -> None:
        """So many were too many: a tenth less from now on, one at least."""
        self.known[longest.bit_length()] = max(1, min(n - 1, int(n * 0.9)))


def batches_by_length(inputs: Sequence[Any], sizes: BatchSizes | int) -> Iterator[list[int]]:
    """Row numbers in batches of inputs of like length, each as large as sizes says when it is asked for."""
    sizes = BatchSizes(sizes) if isinstance(sizes, int) else sizes
    order = sorted(range(len(inputs)), key=lambda i: length(inputs[i]))
    at = 0
    while at < len(order):
        n = sizes.of(length(inputs[order[min(at + sizes.most, len(order)) - 1]]))
        yield order[at : at + n]
        at += n


def run_batch(model: Model, inputs: list[Any], options: dict[str, Any], retries: int = 3, pause: float = 0.5, sizes: BatchSizes | None = None) -> list[Any]:
    """One batch: in smaller ones while it is too large for the memory, tried again with growing pauses while a service fails."""
    sizes = sizes or BatchSizes(len(inputs))
    for attempt in range(retries + 1):
        try:
            out = list(model.run(inputs, **options))
            if len(out) != len(inputs):
                raise ValueError(f"{model.name} returned {len(out)} results for {len(inputs)} inputs.")
            return out
        except (OutOfMemory, MemoryError):
            if len(inputs) == 1:
                raise
            longest = max(map(length, inputs))
            sizes.failed(longest, len(inputs))
            n = sizes.of(longest)
            return [r for at in range(0, len(inputs), n) for r in run_batch(model, inputs[at : at + n], options, retries, pause, sizes)]
        except (ConnectionError, TimeoutError):
            if attempt == retries:
                raise
            time.sleep(pause * 2**attempt)
    raise AssertionError


def with_model(df: DataFrame, column: str, out: str, model: Model, batch_size: int = 10, check_length: bool = False, truncate: bool = False, **options: Any) -> DataFrame:
    """df with a column out: the model's output for each row's input. Batches hold inputs of like length; rows keep their order.

    An input of more tokens than max_length leaves, less the max_new_tokens asked for, is an error with check_length or
    max_new_tokens, and with truncate cut to so many words.
    """
    room = None if model.max_length is None else model.max_length - (options.get("max_new_tokens") or 0)
    checked = room is not None and (check_length or truncate or options.get("max_new_tokens") is not None)
    if isinstance(model, Expression):
        given = F.col(column)
        if checked:
            given = F.trim(F.regexp_extract(given, rf"^\s*(?:\S+\s*){{0,{room}}}", 0)) if truncate else checked_length(given, room)
        return df.withColumn(out, model.expression(given))
    schema = T.StructType([*[f for f in df.schema if f.name != out], T.StructField(out, T.StructType.fromDDL(f"x {model.output_type}")["x"].dataType)])
    kind = to_arrow_type(schema[out].dataType)

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if getattr(model, "in_use", False):
            raise RuntimeError(f"{model.name} is in use already: one model object runs once at a time in a worker.")
        model.in_use = True
        try:
            model.load()
            yield from each(parts)
        finally:
            model.in_use = False

    def each(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sizes = BatchSizes(batch_size)
        for b in parts:
            inputs = b.column(column).to_pylist()
            if checked:
                long = [i for i, x in enumerate(inputs) if isinstance(x, str) and model.count_tokens(x) > room]
                if long and not truncate:
                    raise ValueError(f"{len(long)} inputs are longer than {room} tokens.")
                for i in long:
                    inputs[i] = " ".join(inputs[i].split()[:room])
            results: list[Any] = [None] * len(inputs)
            for rows in batches_by_length(inputs, sizes):
                for i, r in zip(rows, run_batch(model, [inputs[i] for i in rows], options, sizes=sizes)):
                    results[i] = r
            keep = [n for n in b.schema.names if n != out]
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(results, kind)], [*keep, out])

    return df.mapInArrow(run, schema)


def cache_key(model: Model, column: Column, options: dict[str, Any] | None = None, seed: Column | None = None) -> Column:
    """What makes two runs the same: model, version, plain options, input and the row's seed; not the batch size."""
    plain = {k: v for k, v in sorted((options or {}).items()) if isinstance(v, (str, int, float, bool, type(None)))}
    parts = [F.lit(model.name).alias("m"), F.lit(model.version).alias("v"), F.lit(json.dumps(plain)).alias("o"), column.alias("i")]
    return F.sha2(F.to_json(F.struct(*parts, *([seed.alias("s")] if seed is not None else []))), 256)


def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    """__key and the answer of the latest run of each input in a cache folder."""
    if not Files(spark).exists(path):
        return None
    return spark.read.parquet(path).groupBy("__key").agg(F.max_by("__answer", "__run").alias("__answer"))


def with_model_memoised(df: DataFrame, column: str, out: str, model: Model, cache_path: str | None = None, cache_only: bool = False, force: bool = False, seed: str | None = None, **options: Any) -> DataFrame:
    """with_model(), but each different input is run once, and with cache_path none that an earlier run has answered.

    cache_only: an input without an answer is an error when it is read. force: all inputs are run, and their answers replace
    earlier ones. The seed column tells equal inputs apart. Nulls are inputs too. With cache_path, what is missing is run when
    this is called.
    """
    spark = df.sparkSession
    df = df.drop(out) if out != column else df
    keyed = df.withColumn("__key", cache_key(model, F.col(column), options, F.col(seed) if seed else None))
    known = _stored(spark, cache_path) if cache_path else None
    if cache_only:
        if known is None:
            raise ValueError("cache_only: there is no cache.")
        found = keyed.join(known.withColumn("__hit", F.lit(True)), "__key", "left")
        missing = F.raise_error(F.lit("cache_only: an input has no cached answer")).cast(dict(known.dtypes)["__answer"])
        return found.withColumn(out, F.when(F.col("__hit"), F.col("__answer")).otherwise(missing)).drop("__key", "__hit", "__answer")
    inputs = keyed.groupBy("__key").agg(F.first(column).alias(column))
    if known is not None and not force:
        inputs = inputs.join(known.select("__key"), "__key", "left_anti")
    new = with_model(inputs, column, "__answer", model, **options).select("__key", "__answer")
    if cache_path:
        new.withColumn("__run", F.lit(time.time_ns())).write.mode("append").parquet(cache_path)
        new = _stored(spark, cache_path)
    return keyed.join(new, "__key").withColumn(out, F.col("__answer")).drop("__key", "__answer")


def with_parallel_models(df: DataFrame, column: str, out: str, models: Sequence[Model], **options: Any) -> DataFrame:
    """Rows dealt to several equal models by a hash of their position; each group of partitions loads one of them."""
    key = F.col(POS) if POS in df.columns else F.col(column)
    parts = [with_model(df.filter(F.pmod(F.xxhash64(key), F.lit(len(models))) == i), column, out, m, **options) for i, m in enumerate(models)]
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    return both
