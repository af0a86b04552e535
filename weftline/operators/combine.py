"""Operators on several frames: ordered union, positional zips, joins, set operations."""

from __future__ import annotations

import functools
import itertools
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.position import POS, densified, visible


def concat(*frames: DataFrame, bounds: Sequence[int | None] | None = None) -> DataFrame:
    """All rows of all frames, one frame after the other; columns a frame lacks are null.

    bounds: a number above all positions of each frame. Positions then go on from bound to bound, with gaps, and no row is
    shuffled. Where one is unknown, or they add up to more than positions hold, rows are numbered anew, without gaps.
    """
    if not frames:
        raise ValueError("concat() needs at least one frame.")
    if bounds is not None and None not in bounds and sum(bounds) < 1 << 62:
        placed = [f.withColumn(POS, F.col(POS) + F.lit(sum(bounds[:i])).cast("bigint")) for i, f in enumerate(frames)]
        return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed)
    placed = [f.withColumn("__of", F.lit(i)) for i, f in enumerate(frames)]
    return densified(functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), placed), "__of").drop("__of")


def add_item(df: DataFrame, item: dict[str, Any], n: int) -> DataFrame:
    """One row more at the end; keys the item lacks are null, keys the frame lacks raise ValueError. n is the number of rows."""
    unknown = set(item) - set(visible(df))
    if unknown:
        raise ValueError(f"The item has columns the rows lack: {sorted(unknown)}.")
    schema = df.select(*(f"`{c}`" for c in visible(df))).schema
    for f in schema:
        f.nullable = True
    row = df.sparkSession.createDataFrame([tuple(item.get(f.name) for f in schema)], schema)
    return df.unionByName(row.withColumn(POS, F.lit(n).cast("bigint")))


def _renamed(frames: Iterable[DataFrame], last_wins: bool) -> list[DataFrame]:
    frames = list(frames)
    seen: set[str] = set()
    out = []
    for f in reversed(frames):
        again = [c for c in visible(f) if c in seen]
        if again and not last_wins:
            raise ValueError(f"Several frames have the columns {again}.")
        seen |= set(visible(f))
        out.append(f.drop(*again))
    return out[::-1]


def _by_position(frames: list[DataFrame], how: str) -> DataFrame:
    return functools.reduce(lambda a, b: a.join(b, POS, how), frames)


def zipped_strict(*frames: DataFrame) -> DataFrame:
    """Columns side by side, row by row; other numbers of rows raise an error when read, equal column names at once.

    Frames derived from one frame without changing rows need no join: select from that frame instead.
    """
    frames = _renamed(frames, last_wins=False)
    marked = [f.withColumn(f"__has{i}", F.lit(True)) for i, f in enumerate(frames)]
    joined = _by_position(marked, "full")
    has = [F.col(f"__has{i}") for i in range(len(frames))]
    whole = functools.reduce(lambda a, b: a & b, [h.isNotNull() for h in has])
    checked = F.when(whole, F.col(POS)).otherwise(F.raise_error(F.lit("zipped: the frames have different numbers of rows")).cast("bigint"))
    return joined.withColumn(POS, checked).drop(*(f"__has{i}" for i in range(len(frames))))


def zipped_padded(*frames: DataFrame) -> DataFrame:
    """Columns side by side; shorter frames are filled up with nulls."""
    return _by_position(_renamed(frames, last_wins=False), "full")


def zipped_shortest(*frames: DataFrame) -> DataFrame:
    """Columns side by side as far as the shortest frame goes; of equal column names the last frame's holds."""
    return _by_position(_renamed(frames, last_wins=True), "inner")


def joined(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by equal values; rows keep the left positions (with gaps and repeats: renumber before operators on order)."""
    keys = [on] if isinstance(on, str) else on
    clash = [c for c in visible(right) if c in visible(left) and c not in keys]
    return left.join(right.drop(POS).withColumnsRenamed({c: f"{c}_right" for c in clash}), keys, how)


def lookup(df: DataFrame, key: str, known: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose key known has, with its columns, and those it lacks."""
    return df.join(known, key), df.join(known.select(key), key, "left_anti")


def distinct_union(*frames: DataFrame) -> DataFrame:
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [f.drop(POS) for f in frames]).distinct()


def intersection(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.drop(POS).intersect(b.drop(POS).select(*visible(a)))


def difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.drop(POS).exceptAll(b.drop(POS).select(*visible(a)))


def attribute_product(spark: SparkSession, attributes: dict[str, list[Any]]) -> DataFrame:
    """Every combination of attribute values with its number from 0; the last attribute changes fastest. A list given by the user, so driver-sized."""
    names = list(attributes)
    rows = [(i, *combo) for i, combo in enumerate(itertools.product(*attributes.values()))]
    return spark.createDataFrame(rows, ", ".join(["combination bigint", *(f"`{n}` string" for n in names)]))


def gathered(df: DataFrame, indices: str, examples: DataFrame, value: str, out: str) -> DataFrame:
    """A column out: the values of examples at each row's indices (array of positions), in their order; missing ones left out.

    Rows are told apart by POS, which must be unique.
    """
    wanted = df.select(POS, F.posexplode(indices).alias("__at", "__index"))
    found = wanted.join(examples.select(F.col(POS).alias("__index"), F.col(value).alias("__value")), "__index")
    lists = found.groupBy(POS).agg(F.sort_array(F.collect_list(F.struct("__at", "__value"))).alias("__pairs"))
    values = F.coalesce(F.transform("__pairs", lambda p: p["__value"]), F.array().cast(f"array<{dict(examples.dtypes)[value]}>"))
    return df.join(lists, POS, "left").withColumn(out, values).drop("__pairs")


def ordinal(*order: str | Column, within: str | None = None) -> Column:
    """The number, from 0, of a row within its group."""
    w = Window.partitionBy(within).orderBy(*order) if within else Window.orderBy(*order)
    return F.row_number().over(w) - 1
