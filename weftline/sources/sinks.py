"""Frames as Python values, JSON, CSV, Parquet and fine-tuning files."""

from __future__ import annotations

import uuid
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.text import split_path, word_count
from weftline.ingest import PICKLED_MARK, unpickled
from weftline.position import POS, visible
from weftline.storage import Files


def _ordered(df: DataFrame) -> DataFrame:
    return df.orderBy(POS).drop(POS) if POS in df.columns else df


def to_list(df: DataFrame) -> list[dict[str, Any]]:
    """All rows in order; they have to fit the driver."""
    return unpickled_values(df, _ordered(df).toArrow().to_pylist())


def to_dict(df: DataFrame) -> dict[str, list[Any]]:
    return unpickled_values(df, _ordered(df).toArrow().to_pydict())


def _one_file(df: DataFrame, path: str, write) -> str:
    """One file at path: the sorted rows go through a single task, as one file in order needs."""
    folder, at = f"{path}.{uuid.uuid4().hex}", Files(df.sparkSession)
    write(_ordered(df).coalesce(1).write, folder)
    part = next(n for n in at.names(folder) if n.startswith("part-"))
    at.move(f"{folder}/{part}", path)
    at.delete(folder)
    return path


def to_json(df: DataFrame, path: str) -> str:
    """One object a line; nulls are written."""
    return _one_file(df, path, lambda w, p: w.option("ignoreNullFields", False).json(p))


def to_csv(df: DataFrame, path: str, sep: str = ",") -> str:
    return _one_file(df, path, lambda w, p: w.options(header=True, sep=sep, quote='"', escape='"').csv(p))


def to_parquet(df: DataFrame, path: str, num_shards: int | None = None) -> str:
    """A folder of Parquet files, rows in order over the files, written in parallel."""
    if POS in df.columns:
        df = df.repartitionByRange(num_shards, POS).sortWithinPartitions(POS).drop(POS) if num_shards else df.orderBy(POS).drop(POS)
    df.write.mode("overwrite").parquet(path)
    return path


def unpickled_values(df: DataFrame, values: Any) -> Any:
    """Exported rows or columns with the values of pickled columns (marked so in the schema) back as the objects they were."""
    pickled = [f.name for f in df.schema if PICKLED_MARK in f.metadata]
    back = lambda v: v if v is None else unpickled(v)
    if isinstance(values, list):
        return [{k: back(v) if k in pickled else v for k, v in r.items()} for r in values] if pickled else values
    return {k: [back(v) for v in vs] if k in pickled else vs for k, vs in values.items()}


def by_split(frames: dict[str, DataFrame], path: str, write) -> str | dict[str, str]:
    """One file if there is one split, else x.train.ext, x.val.ext and x.test.ext."""
    if len(frames) == 1:
        return write(next(iter(frames.values())), path)
    return {name: write(df, split_path(path, name)) for name, df in frames.items()}


def chat_lines(df: DataFrame, prompt: str, completion: str, system_prompt: str | None = None, chat: bool = True, most_tokens: int | None = None, truncate: bool = False) -> DataFrame:
    """One column value: the JSON line of each row for fine-tuning, as messages or as prompt and completion.

    With most_tokens, a longer text raises an error when it is read, or with truncate is cut to that many words.
    """

    def fitted(c: str):
        col = F.col(c)
        if most_tokens is None:
            return col
        if truncate:
            return F.regexp_extract(col, rf"^\s*(?:\S+\s*){{0,{most_tokens}}}", 0)
        return F.when(word_count(col) > most_tokens, F.raise_error(F.lit("a row is longer than the model takes")).cast("string")).otherwise(col)

    def message(role: str, content):
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    p, c = fitted(prompt), fitted(completion)
    if chat:
        parts = [message("system", F.lit(system_prompt))] if system_prompt is not None else []
        line = F.to_json(F.struct(F.array(*parts, message("user", p), message("assistant", c)).alias("messages")))
    else:
        line = F.to_json(F.struct(p.alias("prompt"), c.alias("completion")))
    return df.select(line.alias("value"), *([POS] if POS in df.columns else []))


def head(df: DataFrame, n: int = 5):
    """The first n rows as pandas."""
    return df.orderBy(POS).limit(n).drop(POS).toPandas()


def preview(df: DataFrame, n: int = 3) -> dict[str, list[Any]]:
    return to_dict(df.filter(F.col(POS) < n).select(*visible(df), POS))
