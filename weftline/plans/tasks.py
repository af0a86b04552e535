"""Task steps: embedding, similarity, retrieval, classification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions import vectors as V
from weftline.models import Model, with_model
from weftline.position import POS
from weftline.storage import materialised


def embed(df: DataFrame, texts: str, model: Model, out: str = "embeddings", instruction: str | None = None, truncate: bool = False) -> DataFrame:
    """A column of embeddings; the instruction goes before each text without a space between."""
    if instruction:
        return with_model(df.withColumn("__text", F.concat(F.lit(instruction), F.col(texts))), "__text", out, model, truncate=truncate).drop("__text")
    return with_model(df, texts, out, model, truncate=truncate)


def cosine_similarity(df: DataFrame, a: str, b: str, model: Model | None = None, out: str = "similarities", truncate: bool = False) -> DataFrame:
    """The cosine of two columns, row by row; text columns are embedded first. A model without text columns raises ValueError."""
    kinds = dict(df.dtypes)
    strings = [c for c in (a, b) if kinds[c] == "string"]
    if model is not None and not strings:
        raise ValueError("An embedder is given, but both columns are embeddings.")
    if strings and model is None:
        raise ValueError(f"Columns {strings} are texts; an embedder is needed.")
    for c in strings:
        df = embed(df, c, model, f"__{c}", truncate=truncate)
    left, right = (F.col(f"__{c}") if c in strings else F.col(c) for c in (a, b))
    return df.withColumn(out, V.cosine(left, right)).drop(*(f"__{c}" for c in strings))


class Retriever:
    """An exact index: the texts of a frame (POS and a text column) with their embeddings, written as a table when it is made. Null texts are left out."""

    def __init__(self, texts: DataFrame, text: str, model: Model, instruction: str | None = None, query_instruction: str | None = None, path: str | None = None) -> None:
        self.model, self.query_instruction, self.text = model, query_instruction, text
        spark = texts.sparkSession
        texts = texts.filter(F.col(text).isNotNull())
        index = embed(texts.select(F.col(POS).alias("item"), F.col(text).alias("text")), "text", model, "embedding", instruction)
        if path is not None:
            try:
                index = spark.read.parquet(path)
            except Exception as e:  # noqa: BLE001
                if "PATH_NOT_FOUND" not in str(e):
                    raise
                index.write.parquet(path)
                index = spark.read.parquet(path)
        else:
            index = materialised(index)  # the embedder runs once a text, however many queries follow
        self.index = index

    def retrieve(self, queries: DataFrame, query: str, k: int = 5, out: str = "results") -> DataFrame:
        """queries (POS and a text column) with a column of results: struct of indices, texts and scores, best first; empty lists where nothing is found."""
        vectors = materialised(embed(queries.select(F.col(POS).alias("query"), F.col(query).alias("__q")), "__q", self.model, "embedding", self.query_instruction))
        found = V.top_k(vectors.select("query", "embedding"), self.index.select("item", "embedding"), k)
        results = V.retrieval_results(found.join(self.index.select("item", "text"), "item")).withColumnRenamed("results", out)
        none = F.struct(F.array().cast("array<bigint>").alias("indices"), F.array().cast("array<string>").alias("texts"), F.array().cast("array<float>").alias("scores"))
        return queries.join(results, queries[POS] == results["query"], "left").drop("query").withColumn(out, F.coalesce(out, none))


def run_task_model(df: DataFrame, texts: str, model: Model, out: str = "results", truncate: bool = False) -> DataFrame:
    """A classifier's scores for each text, as a struct or map."""
    return with_model(df, texts, out, model, truncate=truncate)
