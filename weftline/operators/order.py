"""Operators on the order of rows. All take and give frames with dense positions (POS), but where they say otherwise."""

from __future__ import annotations

import math
from collections.abc import Iterable
from decimal import Decimal

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.position import POS, numbered, with_order_of


def take(df: DataFrame, n: int) -> DataFrame:
    """The first n rows, or all if there are fewer; a negative n raises ValueError. Positions may have gaps."""
    if n < 0:
        raise ValueError("take() needs a number of rows of 0 or more.")
    return df.orderBy(POS).limit(n)


def take_dense(df: DataFrame, n: int) -> DataFrame:
    """take() of a dense frame: a filter on positions, without a sort."""
    if n < 0:
        raise ValueError("take() needs a number of rows of 0 or more.")
    return df.filter(F.col(POS) < n)


def skip(df: DataFrame, n: int) -> DataFrame:
    """The rows from the n-th on; none if there are fewer."""
    if n < 0:
        raise ValueError("skip() needs a number of rows of 0 or more.")
    return df.filter(F.col(POS) >= n).withColumn(POS, F.col(POS) - n)


def select(df: DataFrame, indices: Iterable[int], n: int | None = None) -> DataFrame:
    """The rows at the indices, in the order given, repeated ones repeated.

    A negative index raises IndexError, one beyond the end too if n, the number of rows, is given; else it is an error when the rows are read.
    """
    wanted = indices if isinstance(indices, range) else list(indices)
    if len(wanted) and min(wanted) < 0:
        raise IndexError("Indices must be 0 or more.")
    if n is not None and len(wanted) and max(wanted) >= n:
        raise IndexError(f"There are {n} rows, but one with index {max(wanted)} is asked for.")
    first, last = (wanted[0], wanted[-1]) if len(wanted) else (0, -1)
    one_by_one = len(wanted) == last - first + 1 and all(a == b for a, b in zip(wanted, range(first, last + 1)))
    if one_by_one and n is not None:
        return df.filter(F.col(POS).between(first, last)).withColumn(POS, F.col(POS) - first)
    if one_by_one:
        places = df.sparkSession.range(first, last + 1).select((F.col("id") - first).alias("__to"), F.col("id").alias("__from"))
    else:
        places = df.sparkSession.createDataFrame(list(enumerate(wanted)), "__to bigint, __from bigint")
    found = places.join(df, F.col("__from") == F.col(POS), "left")
    missing = F.raise_error(F.concat(F.lit("select: there is no row with index "), F.col("__from").cast("string"))).cast("bigint")
    return found.withColumn(POS, F.when(F.col(POS).isNotNull(), F.col("__to")).otherwise(missing)).drop("__to", "__from")


def reverse(df: DataFrame, n: int) -> DataFrame:
    """The rows backwards; n is their number."""
    return df.withColumn(POS, F.lit(n - 1).cast("bigint") - F.col(POS))


def sort_keys(df: DataFrame, columns: list[str], reverse: bool | list[bool], null_placement: str) -> list[Column]:
    """Ordering with nulls placed as asked whatever the direction, NaN beside the nulls (before them at the end), ties in their old order."""
    backwards = [reverse] * len(columns) if isinstance(reverse, bool) else list(reverse)
    if len(backwards) != len(columns):
        raise ValueError("reverse needs one value, or one for each column.")
    if null_placement not in ("at_start", "at_end", "first", "last"):
        raise ValueError("null_placement is at_start or at_end.")
    end = null_placement in ("at_end", "last")
    keys: list[Column] = []
    for c, back in zip(columns, backwards):
        col = F.col(f"`{c}`")
        floating = isinstance(df.schema[c].dataType, (T.DoubleType, T.FloatType))
        odd = F.when(col.isNull(), 2).when(F.isnan(col), 1).otherwise(0) if floating else F.when(col.isNull(), 2).otherwise(0)
        keys += [odd.asc() if end else odd.desc(), col.desc() if back else col.asc()]
    return keys


def sort(df: DataFrame, columns: str | Iterable[str], reverse: bool | list[bool] = False, null_placement: str = "at_end") -> DataFrame:
    """A stable global sort; positions are renumbered in ranges, never in one task. The sorted rows are written when this is called."""
    wanted = [columns] if isinstance(columns, str) else list(columns)
    return _sorted(df, sort_keys(df, wanted, reverse, null_placement))


def _sorted(df: DataFrame, keys: list[Column]) -> DataFrame:
    from weftline.storage import materialised

    return numbered(materialised(df.orderBy(*keys, POS).withColumn("__id", F.monotonically_increasing_id())))


def top(df: DataFrame, columns: str | Iterable[str], n: int, reverse: bool | list[bool] = False, null_placement: str = "at_end") -> DataFrame:
    """sort() and take() in one: each partition keeps n rows, and positions are those of the result."""
    wanted = [columns] if isinstance(columns, str) else list(columns)
    first = df.orderBy(*sort_keys(df, wanted, reverse, null_placement), POS).limit(n)
    order = Window.orderBy(*sort_keys(df, wanted, reverse, null_placement), POS)  # over n rows
    return first.withColumn("__new", (F.row_number().over(order) - 1).cast("bigint")).drop(POS).withColumnRenamed("__new", POS)


def shuffle(df: DataFrame, seed: int = 0) -> DataFrame:
    """A permutation by a hash of position and seed; the same for any partitioning."""
    return with_order_of(df.withColumn("__mixed", F.xxhash64(F.lit(seed), POS)), "__mixed", POS).drop("__mixed")


def shuffle_within(df: DataFrame, buffer_size: int, seed: int = 0) -> DataFrame:
    """Rows mixed within windows of buffer_size positions of a dense frame: no global sort, and no row moves further than its window."""
    if buffer_size < 1:
        raise ValueError("A window has a row at least.")
    block = F.floor(F.col(POS) / buffer_size)
    rank = F.row_number().over(Window.partitionBy("__window").orderBy(F.xxhash64(F.lit(seed), POS), POS)) - 1
    mixed = df.withColumn("__window", block).withColumn("__new", (F.col("__window") * buffer_size + rank).cast("bigint"))
    return mixed.drop(POS, "__window").withColumnRenamed("__new", POS)


def shuffle_exact(df: DataFrame, n: int, seed: int | None) -> DataFrame:
    """The permutation numpy.random.default_rng(seed) draws for n rows, which the driver must hold: for small frames."""
    order = np.random.default_rng(seed).permutation(n)
    return select(df, order.tolist())


def shard(df: DataFrame, num_shards: int, index: int, contiguous: bool = False, n: int | None = None) -> DataFrame:
    """One of num_shards parts: every num_shards-th row, or a block (then n, the number of rows, is needed; the first n % k blocks are one longer)."""
    if not 0 <= index < num_shards:
        raise ValueError("index must be from 0 to num_shards - 1.")
    if not contiguous:
        return df.filter(F.pmod(F.col(POS), F.lit(num_shards)) == index).withColumn(POS, F.floor(F.col(POS) / num_shards))
    each, more = divmod(n, num_shards)
    start = index * each + min(index, more)
    end = start + each + (index < more)
    return df.filter((F.col(POS) >= start) & (F.col(POS) < end)).withColumn(POS, F.col(POS) - start)


def split_sizes(n: int, train: float | int | None = None, validation: float | int | None = None, test: float | int | None = None) -> dict[str, int]:
    """How many rows each split has, from the last split backwards in exact decimals. Shares must sum up to 1.0, numbers to n."""
    wanted = {k: Decimal(str(v)) if isinstance(v, float) else v for k, v in (("train", train), ("validation", validation), ("test", test)) if v}
    if not wanted:
        return {"train": n}
    total = sum(wanted.values())
    if total not in (Decimal("1.0"), n):
        raise ValueError(f"The sizes of train, validation and test must sum up to 1.0 or to the number of rows ({n}), not to {total}.")
    shares, left, of, out = total == Decimal("1.0"), n, Decimal("1.0"), {}
    for name in reversed(list(wanted)[1:]):
        size = math.ceil(float(wanted[name] / of) * left) if shares else int(wanted[name])
        out[name] = size
        left -= size
        of -= wanted[name] if shares else 0
    out[next(iter(wanted))] = left
    return {k: out[k] for k in wanted}


def splits(df: DataFrame, sizes: dict[str, int]) -> dict[str, DataFrame]:
    """Contiguous ranges of rows, in the order of the sizes."""
    out, start = {}, 0
    for name, size in sizes.items():
        out[name] = df.filter((F.col(POS) >= start) & (F.col(POS) < start + size)).withColumn(POS, F.col(POS) - start)
        start += size
    return out


def stratified(df: DataFrame, column: str, train: float, validation: float = 0.0, test: float = 0.0) -> DataFrame:
    """A column split, by each label's rows in their order: the first share of each label is for training, and so on.

    Rows are ranked within label and block of positions, so a label that most rows have isn't ranked in one task.
    """
    from weftline.position import BLOCK

    marked = df.withColumn("__block", F.floor(F.col(POS) / BLOCK))
    counts = marked.groupBy(column, "__block").agg(F.count("*").alias("__n"))
    of = Window.partitionBy(column).orderBy("__block")
    before = counts.select(F.col(column).alias("__label"), F.col("__block").alias("__b"), (F.sum("__n").over(of) - F.col("__n")).alias("__before"), F.sum("__n").over(Window.partitionBy(column)).alias("__of"))
    ranked = marked.withColumn("__rank", F.row_number().over(Window.partitionBy(column, "__block").orderBy(POS)) - 1)
    joined = ranked.join(before, ranked[column].eqNullSafe(F.col("__label")) & (F.col("__block") == F.col("__b")))
    rank = F.col("__rank") + F.col("__before")
    cut = F.when(rank < F.floor(F.col("__of") * train + 0.5), "train").when(rank < F.floor(F.col("__of") * (train + validation) + 0.5), "validation").otherwise("test" if test else ("validation" if validation else "train"))
    return joined.withColumn("split", cut).drop("__block", "__rank", "__label", "__b", "__before", "__of")
