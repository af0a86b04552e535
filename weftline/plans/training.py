"""Training sets and evaluation: labels, pairs, masks and metrics, as plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weftline.functions import vectors as V
from weftline.functions.text import causal_labels, word_count
from weftline.models import Model, with_model


def label_ids(*frames: DataFrame, label: str) -> DataFrame:
    """label and label_id of all labels in all frames, numbered by their order as strings; lists count by their elements, nulls not at all."""
    parts = []
    for f in frames:
        values = F.explode(F.transform(label, lambda x: x.cast("string"))) if isinstance(f.schema[label].dataType, T.ArrayType) else F.col(label).cast("string")
        parts.append(f.select(values.alias("label")))
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    distinct = both.filter("label is not null").distinct()
    return distinct.select("label", (F.row_number().over(Window.orderBy("label")) - 1).alias("label_id"))  # over distinct labels only


def encode_labels(df: DataFrame, label: str, ids: DataFrame, out: str = "labels") -> DataFrame:
    """A column out: the label's number, or for lists a vector of 0.0 and 1.0 in the order of numbers. Unknown labels give null or nothing."""
    if isinstance(df.schema[label].dataType, T.ArrayType):
        order = ids.agg(F.transform(F.sort_array(F.collect_list(F.struct("label_id", "label"))), lambda x: x["label"]).alias("__all"))
        strings = F.transform(label, lambda x: x.cast("string"))
        return df.crossJoin(F.broadcast(order)).withColumn(out, F.when(F.col(label).isNotNull(), F.transform("__all", lambda x: F.array_contains(strings, x).cast("double")))).drop("__all")  # one row of labels
    return df.join(ids.select(F.col("label").alias("__label"), F.col("label_id").alias(out)), F.col(label).cast("string") == F.col("__label"), "left").drop("__label")


def causal(df: DataFrame, prompt_ids: str, completion_ids: str, eos: int, most: int | None = None) -> DataFrame:
    ids, labels = causal_labels(F.col(prompt_ids), F.col(completion_ids), eos, most)
    return df.withColumns({"input_ids": ids, "labels": labels})


def preference_pairs(df: DataFrame, judgement: str, a: str, b: str, label_a: str) -> DataFrame:
    """chosen and rejected by a judgement."""
    first = F.col(judgement) == label_a
    return df.withColumns({"chosen": F.when(first, F.col(a)).otherwise(F.col(b)), "rejected": F.when(first, F.col(b)).otherwise(F.col(a))})


def reward_pairs(df: DataFrame, prompt: str, chosen: str, rejected: str, chosen_score: str | None = None, rejected_score: str | None = None) -> DataFrame:
    """The texts of reward pairs, with the margin of their scores if there are any."""
    both = {"chosen": F.concat(prompt, chosen), "rejected": F.concat(prompt, rejected)}
    margin = {"margin": F.col(chosen_score).cast("double") - F.col(rejected_score).cast("double")} if chosen_score else {}
    return df.withColumns(both | margin)


def with_ids(df: DataFrame, columns: dict[str, str], tokenizer: Model, most: int | None = None, eos: int | None = None) -> DataFrame:
    """Columns of token ids (new name: text column) by a tokenizer, a model whose outputs are arrays of int; ended by eos and cut to a length if so asked. Null texts have no ids."""
    for out, text in columns.items():
        df = with_model(df, text, out, tokenizer)
        ids = F.coalesce(F.col(out), F.array().cast("array<int>"))
        ids = F.concat(ids, F.array(F.lit(eos))) if eos is not None else ids
        df = df.withColumn(out, F.slice(ids, 1, most) if most else ids)
    return df


def seq2seq(df: DataFrame, text: str, target: str, tokenizer: Model, eos: int, most: int | None = None) -> DataFrame:
    """input_ids and labels (the target's ids) of pairs of texts."""
    return with_ids(df, {"input_ids": text, "labels": target}, tokenizer, most, eos)


def classification(df: DataFrame, text: str, label: str, ids: DataFrame, tokenizer: Model, most: int | None = None) -> DataFrame:
    """input_ids and labels (the label's number, or a vector for lists) of labelled texts."""
    return encode_labels(with_ids(df, {"input_ids": text}, tokenizer, most), label, ids)


def reward_pair_ids(df: DataFrame, prompt: str, chosen: str, rejected: str, tokenizer: Model, eos: int, most: int | None = None, chosen_score: str | None = None, rejected_score: str | None = None) -> DataFrame:
    """input_ids_chosen and input_ids_rejected of prompt and answer, and the margin of their scores if there are any."""
    texts = reward_pairs(df.withColumns({"__chosen": F.col(chosen), "__rejected": F.col(rejected)}), prompt, "__chosen", "__rejected", chosen_score, rejected_score)
    return with_ids(texts, {"input_ids_chosen": "chosen", "input_ids_rejected": "rejected"}, tokenizer, most, eos).drop("__chosen", "__rejected")


def reward_scores(df: DataFrame, prompt: str, answer: str, score: str, tokenizer: Model, eos: int, most: int | None = None) -> DataFrame:
    """input_ids of prompt and answer, and labels: the score as a double."""
    texts = df.withColumn("__text", F.concat(prompt, answer))
    return with_ids(texts, {"input_ids": "__text"}, tokenizer, most, eos).withColumn("labels", F.col(score).cast("double")).drop("__text")


def preference_ids(df: DataFrame, prompt: str, chosen: str, rejected: str, tokenizer: Model, eos: int, most: int | None = None) -> DataFrame:
    """prompt_input_ids, and for chosen and rejected input_ids of prompt and answer and labels with -100 for the prompt."""
    ids = with_ids(df, {"prompt_input_ids": prompt, "__c": chosen, "__r": rejected}, tokenizer)
    out = {}
    for name, answer in (("chosen", "__c"), ("rejected", "__r")):
        out[f"{name}_input_ids"], out[f"{name}_labels"] = causal_labels(F.col("prompt_input_ids"), F.col(answer), eos, most)
    return ids.withColumns(out).drop("__c", "__r")


def mean_reward(df: DataFrame, reward: str, batch: str | None = None) -> DataFrame:
    """The mean reward, with a batch column as the batches' means weighted by their sizes, which is the same."""
    if batch is None:
        return df.agg(F.avg(reward).alias("mean_reward"))
    each = df.groupBy(batch).agg(F.avg(reward).alias("m"), F.count(reward).alias("n"))
    return each.agg((F.sum(F.col("m") * F.col("n")) / F.sum("n")).alias("mean_reward"))


def longest(df: DataFrame, text: str, *by: str, count=word_count) -> DataFrame:
    """The most tokens that a text has, of each group; 0 for null texts."""
    return df.groupBy(*by).agg(F.max(count(F.col(text))).alias("max_tokens"))


def length_histogram(df: DataFrame, text: str, bins: int = 6, width: int = 64, count=word_count) -> DataFrame:
    """bin and n: how many texts have a length in each range of width tokens; the last range is open. For choosing batch sizes."""
    return df.groupBy(F.least(F.floor(count(F.col(text)) / width), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count("*").alias("n"))


def sentence_rows(df: DataFrame, anchor: str, positive: str, negative: str | None = None, label: str | None = None) -> DataFrame:
    """Triplets (anchor, positive, negative), pairs, or labelled pairs for sentence encoders."""
    out = [F.col(anchor).alias("anchor"), F.col(positive).alias("positive")]
    return df.select(*out, *([F.col(negative).alias("negative")] if negative else []), *([F.col(label).cast("double").alias("label")] if label else []))


def weighted_mean(df: DataFrame, value: str, weight: str, *by: str, out: str = "weighted_mean") -> DataFrame:
    """sum(value * weight) / sum(weight) of each group; values that are no numbers count as 0."""
    number = F.coalesce(F.col(value).try_cast("double"), F.lit(0.0))
    return df.groupBy(*by).agg((F.sum(number * F.col(weight)) / F.sum(weight)).alias(out))


def classification_metrics(df: DataFrame, predicted: str, label: str) -> DataFrame:
    """accuracy and micro-averaged f1 of single labels."""
    hit = (F.col(predicted) == F.col(label)).cast("double")
    return df.filter(F.col(predicted).isNotNull() & F.col(label).isNotNull()).agg(F.avg(hit).alias("accuracy"), F.avg(hit).alias("f1_micro"))


def multilabel_metrics(df: DataFrame, scores: str, labels: str, threshold: float = 0.5) -> DataFrame:
    """accuracy (whole rows) and micro-averaged f1 of label vectors."""
    predicted = F.transform(scores, lambda s: (s > threshold).cast("double"))
    pairs = F.arrays_zip(predicted.alias("p"), F.col(labels).alias("l"))
    rows = df.select(pairs.alias("x"), F.forall(F.zip_with(predicted, F.col(labels), lambda p, y: p == y), lambda b: b).alias("same"))
    count = lambda test: F.sum(F.size(F.filter("x", test)))
    tp, fp, fn = count(lambda x: (x["p"] == 1) & (x["l"] == 1)), count(lambda x: (x["p"] == 1) & (x["l"] != 1)), count(lambda x: (x["p"] != 1) & (x["l"] == 1))
    return rows.agg(F.avg(F.col("same").cast("double")).alias("accuracy"), (2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1))).alias("f1_micro"))


def triplet_accuracy(df: DataFrame, anchor: str, positive: str, negative: str) -> DataFrame:
    closer = V.cosine(F.col(anchor), F.col(positive)) > V.cosine(F.col(anchor), F.col(negative))
    return df.agg(F.avg(closer.cast("double")).alias("accuracy"))


def pair_metrics(df: DataFrame, chosen: str, rejected: str) -> DataFrame:
    """accuracy and cross-entropy of rewards of chosen over rejected answers."""
    margin = F.col(chosen) - F.col(rejected)
    return df.agg(F.avg((margin > 0).cast("double")).alias("accuracy"), F.avg(F.log1p(F.exp(-margin))).alias("loss"))


def mean_squared_error(df: DataFrame, predicted: str, label: str) -> DataFrame:
    return df.agg(F.avg(F.pow(F.col(predicted) - F.col(label), 2)).alias("mse"))


def perplexity(df: DataFrame, nll: str, batch: str) -> DataFrame:
    """exp(mean loss) of each batch, averaged by the batches' sizes."""
    each = df.groupBy(batch).agg(F.exp(F.avg(nll)).alias("p"), F.count(nll).alias("n"))
    return each.agg((F.sum(F.col("p") * F.col("n")) / F.sum("n")).alias("perplexity"))


def best(df: DataFrame, primary: str, secondary: str, *keep: str) -> DataFrame:
    """The row of the greatest primary metric, the secondary one deciding ties."""
    return df.agg(F.max_by(F.struct(*keep, primary, secondary), F.struct(primary, secondary)).alias("x")).select("x.*")


def argmax_column(scores: str) -> Column:
    return V.argmax(F.col(scores))
