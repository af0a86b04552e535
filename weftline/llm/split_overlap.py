"""Problem 3: prompts held out for evaluation that also stand, equal or nearly so, in training.

The join is the exact one of near_duplicates.py: regions of single word pairs, windows by set sizes, bit fingerprints within a
Hamming distance that the sizes allow, the texts last. Only rows of different splits meet. All word pairs of a text count, also
those of templates: they come last in the order of pivots, so they cost rows only where they make up half of a text.

Texts of equal sets of pairs take part under the hash of the set, once for each split and task that reads them, and are expanded at the end.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.near_duplicates import expanded, joined, least_tasks, regions, tasks_for
from weftline.llm.shared import surveyed, table, verified, written


def overlaps(records: DataFrame) -> DataFrame:
    """part, train_id and test_id of every two alike texts of a part, one of each split. records: part, id, trains (boolean), text.

    Rows with the same part and id are one record; rows without a split (null) take no part. Null, empty and short texts
    are alike to nothing; empty tables give no rows; texts of any length are taken whole.
    """
    records = records.filter("trains is not null")
    members, frequency = surveyed(records, "id", "trains")
    members = written(members.distinct())
    train, test = (regions(records.filter(side), frequency).withColumn("trains", F.lit(trains)) for side, trains in (("trains", True), ("not trains", False)))
    links = verified(joined(train.unionByName(test), tasks_for(frequency, least_tasks(records))).distinct(), records).select("k_a", "k_b")
    both = members.groupBy("k").agg(F.bool_or("trains").alias("t"), F.bool_or(~F.col("trains")).alias("e")).filter("t and e").select(F.col("k").alias("k_a"), F.col("k").alias("k_b"))
    left = members.filter("trains").select("part", F.col("k").alias("k_a"), F.col("id").alias("train_id"), F.col("id").alias("by"))
    right = members.filter("not trains").select(F.col("k").alias("k_b"), F.col("id").alias("test_id"), F.col("id").alias("by"))
    return expanded(links.unionByName(both), left, right).select("part", "train_id", "test_id")


SETS = {0: "dpo", 1: "prompt_log"}


def p3_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    dpo = [table(spark, sf_dir, name, "row_id", "source", text).select(F.lit(0).cast("tinyint").alias("part"), F.col("row_id").alias("id"), F.lit(trains).alias("trains"), F.lit(split).alias("split"), "source", F.col(text).alias("text"))
           for name, text, trains, split in (("dpo_train", "train_prompts", True, "train"), ("dpo_validation", "validation_prompts", False, "validation"))]
    split = F.when(F.col("split") == "val", "validation").otherwise(F.col("split"))
    log = table(spark, sf_dir, "prompt_log", "prompt_id", "split", "source", "prompt").withColumn("split", split)
    log = log.filter(F.col("split").isin("train", "validation", "test"))
    log = log.select(F.lit(1).cast("tinyint").alias("part"), F.col("prompt_id").alias("id"), (F.col("split") == "train").alias("trains"), "split", "source", F.col("prompt").alias("text"))
    return dpo[0].unionByName(dpo[1]).unionByName(log)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_set, id_a and id_b of every two alike prompts of which one is for training and one for evaluation."""
    name = F.when(F.col("part") == 0, SETS[0]).otherwise(SETS[1])
    return overlaps(p3_records(spark, sf_dir)).select(name.alias("record_set"), F.least("train_id", "test_id").alias("id_a"), F.greatest("train_id", "test_id").alias("id_b"))


def p3_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """record_set, split, source, n_records, n_overlapping and n_pairs of the evaluation records."""
    records = p3_records(spark, sf_dir)
    tests = records.filter("not trains").groupBy("part", "id").agg(F.first("split").alias("split"), F.first("source").alias("source"))
    pairs = overlaps(records).groupBy("part", F.col("test_id").alias("id")).agg(F.count("*").alias("n"))
    name = F.when(F.col("part") == 0, SETS[0]).otherwise(SETS[1])
    return tests.join(pairs, ["part", "id"], "left").groupBy(name.alias("record_set"), "split", "source").agg(F.count("*").alias("n_records"), F.count("n").alias("n_overlapping"), F.coalesce(F.sum("n"), F.lit(0)).alias("n_pairs"))
