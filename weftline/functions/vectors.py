"""Functions of embedding columns (arrays of floats), and exact nearest neighbours in blocks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(inner_product(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; a zero vector gives 0."""
    return inner_product(a, b) / F.greatest(norm(a) * norm(b), F.lit(1e-8))


def unit(a: Column) -> Column:
    """The vector at length 1; a zero vector stays."""
    n = norm(a)
    return F.transform(a, lambda x: F.when(n > 0, x / n).otherwise(x).cast("float"))


def argmax(a: Column) -> Column:
    """The place of the first greatest element, from 0."""
    return F.array_position(a, F.array_max(a)) - 1


#: Numbers that a task holds of the corpus (16 MB as doubles), and scores that it holds at a time (8 MB).
HELD_NUMBERS, HELD_SCORES = 2_000_000, 1_000_000
#: What a row costs besides its vector, counted in numbers, and the products that are worth a task.
ROW_NUMBERS, TASK_PRODUCTS = 16, 50_000_000


def _matrix(vectors: pa.Array) -> np.ndarray:
    """The vectors of a list column as rows of doubles."""
    sizes = pc.min_max(pc.list_value_length(vectors))
    if sizes["min"] != sizes["max"]:
        raise ValueError("Vectors differ in length.")
    return vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), sizes["max"].as_py())


def _best(scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the k greatest scores of each row, the first ones among equals. NaN, as null numbers give, is none of them."""
    k = min(k, scores.shape[1])
    given = ~np.isnan(scores)
    ranked = np.where(given, scores, -np.inf)
    least = np.partition(ranked, scores.shape[1] - k, axis=1)[:, -k:][:, :1]
    above, equal = ranked > least, (ranked == least) & given
    room = k - above.sum(axis=1, keepdims=True)
    return np.nonzero(above | (equal & (np.cumsum(equal, axis=1, dtype=np.int32) <= room)))


def _sizes(queries: DataFrame, corpus: DataFrame, vector: str) -> tuple[int, int, int]:
    """The numbers of queries and items, and of the numbers in a row."""
    n, m = (df.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size(vector)), F.lit(0)).alias("d")).withColumn("i", F.lit(i)) for i, df in enumerate((queries, corpus)))
    n, m = sorted(n.union(m).collect(), key=lambda r: r["i"])
    return n["n"], m["n"], max(n["d"], m["d"]) + ROW_NUMBERS


def top_k(queries: DataFrame, corpus: DataFrame, k: int, query: str = "query", vector: str = "embedding", item: str = "item") -> DataFrame:
    """query, item, score and rank (from 1) of the k items of the greatest inner product with each query, lower items first among equals.

    queries and corpus: id (query, item) and vector. Exact. The corpus is dealt to parts of bounded size and the queries to splits;
    a task has one part and one split. It holds its part and takes its queries a batch at a time: matrix products, of which it keeps
    k items a query, and these are merged. Null vectors match nothing, nor do null numbers. Both sides are read twice, so what a model makes is written first.
    """
    queries, corpus = queries.filter(F.col(vector).isNotNull()), corpus.filter(F.col(vector).isNotNull())
    kind = dict(queries.dtypes)[query], dict(corpus.dtypes)[item]
    vectors = dict(queries.dtypes)[vector], dict(corpus.dtypes)[vector]
    n, m, numbers = _sizes(queries, corpus, vector)
    tasks = min(int(corpus.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n * m * numbers // TASK_PRODUCTS))
    # So many parts that fewest rows are sent: each item goes to all splits, each query to all parts.
    parts = max(1, -(-m * numbers // HELD_NUMBERS), min(m, round((tasks * m / max(1, n)) ** 0.5)))
    splits = max(1, -(-tasks // parts))

    def side(df: DataFrame, name: str, others: int, task: Callable[[Column, Column], Column], of: int) -> DataFrame:
        own = F.pmod(F.xxhash64(name), F.lit(of)).cast("int")
        ids = [F.col(c) if c == name else F.lit(None).cast(t).alias(c) for c, t in zip((query, item), kind)]
        v = F.col(vector) if vectors[0] == vectors[1] else F.col(vector).cast("array<double>").alias(vector)
        sent = df.withColumn("__other", F.explode(F.sequence(F.lit(0), F.lit(others - 1))))
        return sent.select(task(own, F.col("__other")).alias("__task"), F.lit(name == query).alias("__asked"), *ids, v)

    both = side(corpus, item, splits, lambda part, split: part * splits + split, parts).union(side(queries, query, parts, lambda split, part: part * splits + split, splits))
    dealt = both.repartitionById(parts * splits, F.col("__task")).sortWithinPartitions("__asked", item)  # a task's items in their order, then its queries

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, rows, x = [], [], None
        for b in batches:
            known = b.num_rows - (pc.sum(b.column("__asked")).as_py() or 0)
            if known:
                ids.append(b.column(item)[:known])
                rows.append(_matrix(b.column(vector)[:known]))
            if known == b.num_rows or not ids:
                continue
            if x is None:
                x, items = np.concatenate(rows).T, pa.concat_arrays(ids)
            names, q = b.column(query)[known:], _matrix(b.column(vector)[known:])
            some = max(1, HELD_SCORES // x.shape[1])
            for at in range(0, len(q), some):
                scores = q[at : at + some] @ x
                of, found = _best(scores, k)
                yield pa.RecordBatch.from_arrays([names.take(pa.array(of + at)), items.take(pa.array(found)), pa.array(scores[of, found])], [query, item, "score"])

    found = dealt.mapInArrow(run, f"`{query}` {kind[0]}, `{item}` {kind[1]}, score double")
    rank = F.row_number().over(Window.partitionBy(query).orderBy(F.desc("score"), item))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def retrieval_results(found: DataFrame, query: str = "query", item: str = "item", text: str = "text") -> DataFrame:
    """One row a query with results: struct of indices, texts and scores, best first."""
    ordered = F.sort_array(F.collect_list(F.struct("rank", F.col(item).alias("i"), F.col(text).alias("t"), F.col("score").alias("s"))))
    lists = found.groupBy(query).agg(ordered.alias("__r"))
    return lists.select(query, F.struct(F.transform("__r", lambda r: r["i"]).alias("indices"), F.transform("__r", lambda r: r["t"]).alias("texts"), F.transform("__r", lambda r: r["s"].cast("float")).alias("scores")).alias("results"))
