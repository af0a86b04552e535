"""One query for each operator over the driver's tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.models import Expression, Function, with_model, with_model_memoised, with_parallel_models
from weftline.operators import combine, order, rows
from weftline.plans import prompts as P
from weftline.plans import training as T
from weftline.position import POS, densified
from weftline.sources import files, sinks
from weftline.sources.files import parquet
from weftline.storage import Files, table_path
from weftline.streaming import stateless

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def keep(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def read(spark: SparkSession, d: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{d}/{name}.parquet")
    return df.select(*columns) if columns else df


def placed(spark: SparkSession, d: str, name: str, key: str, *columns: str) -> DataFrame:
    """A table whose key is the row's number: the key is its position."""
    return read(spark, d, name, key, *columns).withColumn(POS, F.col(key).cast("bigint"))


def listed(column: str) -> Column:
    """An array as one text, to be compared."""
    return F.array_join(F.transform(column, lambda x: x.cast("string")), ",").alias(column)


def shown(df: DataFrame) -> DataFrame:
    """The position as a column pos, to compare orders."""
    return df.withColumnRenamed(POS, "pos")


# Projection, filters, functions


@query("SELECT o_orderkey, o_totalprice FROM orders")
def select_columns(spark, d):
    return rows.select_columns(read(spark, d, "orders"), ["o_orderkey", "o_totalprice"])


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def remove_columns(spark, d):
    return rows.remove_columns(read(spark, d, "orders"), ["o_orderdate", "o_orderpriority"])


@query("SELECT o_orderkey AS key, o_custkey FROM orders")
def rename_column(spark, d):
    return rows.rename_column(read(spark, d, "orders", "o_orderkey", "o_custkey"), "o_orderkey", "key")


@query("SELECT c_custkey AS id, c_name AS name, c_mktsegment FROM customer")
def rename_columns(spark, d):
    return rows.rename_columns(read(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment"), {"c_custkey": "id", "c_name": "name", "c_mktsegment": "c_mktsegment"})


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def filter_expr(spark, d):
    return read(spark, d, "orders").filter("o_orderstatus = 'F' and o_totalprice > 100000").select("o_orderkey", "o_totalprice")


@query("SELECT doc_id, source FROM documents WHERE coalesce(lang, 'x') = 'en' AND doc_id % 2 = 1")
def filter_callable(spark, d):
    return rows.filter_rows(read(spark, d, "documents", "doc_id", "source", "lang"), lambda r: r["lang"] == "en" and r["doc_id"] % 2).select("doc_id", "source")


@query("SELECT doc_id, length(text)::INT AS n FROM documents")
def map_expr(spark, d):
    return rows.map_columns(read(spark, d, "documents", "doc_id", "text"), {"n": F.length("text")}, ["text"])


@query("SELECT o_orderkey, CAST(o_custkey * 2 AS BIGINT) AS twice FROM orders")
def map_callable(spark, d):
    return rows.map_rows(read(spark, d, "orders", "o_orderkey", "o_custkey"), lambda k: {"twice": k * 2}, "twice bigint", input_columns="o_custkey", remove="o_custkey")


@query("SELECT o_orderkey, o_custkey, CAST(o_custkey + 1 AS BIGINT) AS next FROM orders")
def map_batched(spark, d):
    return rows.map_rows(read(spark, d, "orders", "o_orderkey", "o_custkey"), lambda b: {"next": [k + 1 for k in b["o_custkey"]]}, "next bigint", batched=True)


@query("SELECT o_orderkey, CAST(o_orderkey - (SELECT min(o_orderkey) FROM orders) AS BIGINT) AS i FROM orders")
def map_with_indices(spark, d):
    df = order_frame(spark, d)
    return rows.map_rows(df, lambda r, i: {"i": i}, "i bigint", with_indices=True).select("o_orderkey", "i")


def order_frame(spark: SparkSession, d: str) -> DataFrame:
    """orders in the order of its file, which is that of its key."""
    return parquet(spark, f"{d}/orders.parquet", "o_orderkey", "o_totalprice")


@query("SELECT doc_id, CAST(n_chars AS DOUBLE) AS n_chars FROM documents")
def cast_double(spark, d):
    return rows.cast_column(read(spark, d, "documents", "doc_id", "n_chars"), "n_chars", "double")


# Order

NUMBERED = "(SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, count(*) OVER () AS n FROM orders)"


@query(f"SELECT o_orderkey, o_totalprice, pos::BIGINT AS pos FROM {NUMBERED}")
def source_order(spark, d):
    return shown(order_frame(spark, d))


@query(f"SELECT o_orderkey, pos::BIGINT AS pos FROM {NUMBERED} WHERE pos < 1000")
def take(spark, d):
    return shown(order.take_dense(order_frame(spark, d).select("o_orderkey", POS), 1000))


@query(f"SELECT o_orderkey, (pos - 1000)::BIGINT AS pos FROM {NUMBERED} WHERE pos >= 1000")
def skip(spark, d):
    return shown(order.skip(order_frame(spark, d).select("o_orderkey", POS), 1000))


@query(f"SELECT o_orderkey, i::BIGINT AS pos FROM {NUMBERED} JOIN (VALUES (0, 7), (1, 3), (2, 7), (3, 900), (4, 0)) t(i, p) ON pos = p")
def select_indices(spark, d):
    return shown(order.select(order_frame(spark, d).select("o_orderkey", POS), [7, 3, 7, 900, 0]))


@query(f"SELECT o_orderkey, (n - 1 - pos)::BIGINT AS pos FROM {NUMBERED}")
def reverse(spark, d):
    df = order_frame(spark, d).select("o_orderkey", POS)
    return shown(order.reverse(df, df.count()))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::BIGINT AS pos FROM orders")
def sort(spark, d):
    return shown(order.sort(order_frame(spark, d), "o_totalprice", reverse=True)).select("o_orderkey", "pos")


@query("SELECT doc_id, lang, (row_number() OVER (ORDER BY lang ASC NULLS LAST, n_chars DESC NULLS LAST, doc_id) - 1)::BIGINT AS pos FROM documents")
def sort_nulls(spark, d):
    df = placed(spark, d, "documents", "doc_id", "lang", "n_chars")
    return shown(order.sort(df, ["lang", "n_chars"], reverse=[False, True])).select("doc_id", "lang", "pos")


@query("SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1)::BIGINT AS pos FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def sort_take(spark, d):
    return shown(order.top(order_frame(spark, d), "o_totalprice", 100, reverse=True))


DOCUMENTS = "(SELECT doc_id, lang, row_number() OVER (ORDER BY doc_id) - 1 AS pos, count(*) OVER () AS n FROM documents)"


@query(f"SELECT doc_id, lang FROM {DOCUMENTS} WHERE pos % 7 = 2")
def shard_strided(spark, d):
    return order.shard(parquet(spark, f"{d}/documents.parquet", "doc_id", "lang"), 7, 2).drop(POS)


@query(f"SELECT doc_id, lang FROM {DOCUMENTS} WHERE pos >= 3 * (n // 7) + least(3, n % 7) AND pos < 4 * (n // 7) + least(4, n % 7)")
def shard_contiguous(spark, d):
    df = parquet(spark, f"{d}/documents.parquet", "doc_id", "lang")
    return order.shard(df, 7, 3, contiguous=True, n=df.count()).drop(POS)


@query(f"SELECT o_orderkey, CASE WHEN pos < n - ceil(0.2 * n) - ceil(0.125 * (n - ceil(0.2 * n))) THEN 'train' WHEN pos < n - ceil(0.2 * n) THEN 'validation' ELSE 'test' END AS split FROM {NUMBERED}")
def splits(spark, d):
    df = order_frame(spark, d)
    parts = order.splits(df, order.split_sizes(df.count(), 0.7, 0.1, 0.2))
    out = [p.select("o_orderkey", F.lit(s).alias("split")) for s, p in parts.items()]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query("SELECT o_orderkey, CASE WHEN r <= floor(0.8 * n + 0.5) THEN 'train' ELSE 'test' END AS split FROM (SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS r, count(*) OVER (PARTITION BY o_orderpriority) AS n FROM orders)")
def splits_stratified(spark, d):
    df = parquet(spark, f"{d}/orders.parquet", "o_orderkey", "o_orderpriority")
    return order.stratified(df, "o_orderpriority", 0.8, 0.0, 0.2).select("o_orderkey", "split")


@query("SELECT count(*) AS n, count(*) AS n_rows, count(*) AS n_positions, 0::BIGINT AS first, (count(*) - 1)::BIGINT AS last, true AS most_moved, true AS same_again FROM documents")
def shuffle_hash(spark, d):
    """What makes it a permutation of all rows, that moves most of them and is the same for other partitions."""
    df = placed(spark, d, "documents", "doc_id")
    again = order.shuffle(df.repartition(7), 42).select(F.col("doc_id").alias("other"), F.col(POS).alias("at"))
    both = order.shuffle(df, 42).join(again, F.col("doc_id") == F.col("other"))
    return both.agg(
        F.count("*").alias("n"), F.countDistinct("doc_id").alias("n_rows"), F.countDistinct(POS).alias("n_positions"), F.min(POS).alias("first"), F.max(POS).alias("last"),
        (F.avg((F.col("doc_id") != F.col(POS)).cast("int")) > 0.9).alias("most_moved"), F.bool_and(F.col("at") == F.col(POS)).alias("same_again"),
    )


@query("SELECT r_regionkey, r_name, r_regionkey::BIGINT AS pos FROM region UNION ALL SELECT 99, 'ATLANTIS', (SELECT count(*) FROM region)")
def add_item(spark, d):
    df = placed(spark, d, "region", "r_regionkey", "r_name")
    return shown(combine.add_item(df, {"r_regionkey": 99, "r_name": "ATLANTIS"}, df.count()))


# Several inputs


@query("SELECT doc_id, lang, NULL::INT AS n_nationkey, NULL::VARCHAR AS n_name, (row_number() OVER (ORDER BY doc_id) - 1)::BIGINT AS pos FROM documents UNION ALL SELECT NULL, NULL, n_nationkey, n_name, (SELECT count(*) FROM documents) + n_nationkey FROM nation")
def concat(spark, d):
    return shown(densified(combine.concat(placed(spark, d, "documents", "doc_id", "lang"), placed(spark, d, "nation", "n_nationkey", "n_name"))))


@query("SELECT o_orderkey, o_totalprice, o_orderpriority FROM orders")
def zipped_strict(spark, d):
    right = parquet(spark, f"{d}/orders.parquet", "o_orderpriority")
    return combine.zipped_strict(order_frame(spark, d), right).drop(POS)


@query("SELECT r_name, n_name, coalesce(r_regionkey, n_nationkey)::BIGINT AS pos FROM region FULL JOIN (SELECT * FROM nation WHERE n_nationkey < 7) ON r_regionkey = n_nationkey")
def zipped_padded(spark, d):
    nations = order.take_dense(placed(spark, d, "nation", "n_nationkey", "n_name"), 7)
    return shown(combine.zipped_padded(placed(spark, d, "region", "r_regionkey", "r_name"), nations)).select("r_name", "n_name", "pos")


@query("SELECT r_name, n_name FROM region JOIN nation ON r_regionkey = n_nationkey")
def zipped_shortest(spark, d):
    return combine.zipped_shortest(placed(spark, d, "region", "r_regionkey", "r_name"), placed(spark, d, "nation", "n_nationkey", "n_name")).select("r_name", "n_name")


@query("SELECT o_orderkey, c_name, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey")
def joined(spark, d):
    left = read(spark, d, "orders", "o_orderkey", "o_custkey").withColumnRenamed("o_custkey", "k")
    right = read(spark, d, "customer", "c_custkey", "c_name", "c_mktsegment").withColumnRenamed("c_custkey", "k")
    return combine.joined(left, right, "k").drop("k")


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def lookup_misses(spark, d):
    known = read(spark, d, "orders", "o_custkey").distinct().withColumnRenamed("o_custkey", "c_custkey")
    return combine.lookup(read(spark, d, "customer", "c_custkey"), "c_custkey", known)[1]


@query("SELECT n_nationkey FROM nation INTERSECT SELECT c_nationkey FROM customer")
def intersection(spark, d):
    return combine.intersection(read(spark, d, "nation", "n_nationkey"), read(spark, d, "customer", "c_nationkey").withColumnRenamed("c_nationkey", "n_nationkey"))


@query("SELECT o_custkey FROM orders EXCEPT ALL SELECT c_custkey FROM customer")
def difference(spark, d):
    return combine.difference(read(spark, d, "orders", "o_custkey"), read(spark, d, "customer", "c_custkey").withColumnRenamed("c_custkey", "o_custkey"))


@query("SELECT s_nationkey AS k FROM supplier UNION SELECT c_nationkey FROM customer")
def distinct_union(spark, d):
    return combine.distinct_union(read(spark, d, "supplier", "s_nationkey").withColumnRenamed("s_nationkey", "k"), read(spark, d, "customer", "c_nationkey").withColumnRenamed("c_nationkey", "k"))


# Aggregates and training sets


@query("SELECT lang AS label, (row_number() OVER (ORDER BY lang) - 1)::INT AS label_id FROM (SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL)")
def label_ids(spark, d):
    return T.label_ids(read(spark, d, "documents", "lang"), label="lang")


@query("SELECT doc_id, dense_rank() OVER (ORDER BY kind)::INT - 1 AS labels FROM documents")
def label_encode(spark, d):
    df = read(spark, d, "documents", "doc_id", "kind")
    return T.encode_labels(df, "kind", T.label_ids(df, label="kind")).select("doc_id", "labels")


@query("SELECT event_type, round(sum(value * (user_id % 5 + 1)) / sum(user_id % 5 + 1), 6) AS weighted_mean FROM events GROUP BY event_type")
def weighted_metric(spark, d):
    df = read(spark, d, "events", "event_type", "value", "user_id").withColumn("w", F.col("user_id") % 5 + 1)
    return T.weighted_mean(df, "value", "w", "event_type").withColumn("weighted_mean", F.round("weighted_mean", 6))


@query(
    "WITH e AS (SELECT value > 50 AS p, user_id % 2 = 0 AS l FROM events), c AS (SELECT k, count(*) FILTER (p = k AND l = k) AS tp, count(*) FILTER (p = k AND l != k) AS fp, count(*) FILTER (p != k AND l = k) AS fn FROM e, (VALUES (true), (false)) t(k) GROUP BY k) "
    "SELECT (SELECT round(avg((p = l)::INT), 6) FROM e) AS accuracy, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS f1_micro FROM c"
)
def accuracy_f1(spark, d):
    df = read(spark, d, "events", "value", "user_id").select((F.col("value") > 50).cast("int").alias("p"), (F.col("user_id") % 2 == 0).cast("int").alias("l"))
    return T.classification_metrics(df, "p", "l").select(F.round("accuracy", 6).alias("accuracy"), F.round("f1_micro", 6).alias("f1_micro"))


@query("SELECT round(avg(power(o_totalprice / 1000 - 150, 2)), 3) AS mse FROM orders")
def mean_squared_error(spark, d):
    df = read(spark, d, "orders", "o_totalprice").select((F.col("o_totalprice") / 1000).alias("p"), F.lit(150.0).alias("l"))
    return T.mean_squared_error(df, "p", "l").select(F.round("mse", 3).alias("mse"))


@query("SELECT round(sum(p * n) / sum(n), 6) AS perplexity FROM (SELECT exp(avg(value / 100)) AS p, count(value) AS n FROM events GROUP BY event_type)")
def perplexity(spark, d):
    df = read(spark, d, "events", "value", "event_type").withColumn("nll", F.col("value") / 100)
    return T.perplexity(df, "nll", "event_type").select(F.round("perplexity", 6).alias("perplexity"))


@query("SELECT round(avg(CASE WHEN margin > 0 THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg(ln(1 + exp(-margin))), 6) AS loss FROM dpo_train WHERE margin IS NOT NULL")
def pair_metrics(spark, d):
    df = read(spark, d, "dpo_train", "margin").filter("margin is not null").withColumn("zero", F.lit(0.0))
    return T.pair_metrics(df, "margin", "zero").select(F.round("accuracy", 6).alias("accuracy"), F.round("loss", 6).alias("loss"))


@query("SELECT row_id, CASE WHEN row_id % 3 = 0 THEN chosen ELSE rejected END AS chosen, CASE WHEN row_id % 3 = 0 THEN rejected ELSE chosen END AS rejected FROM dpo_train")
def preference_pairs(spark, d):
    df = read(spark, d, "dpo_train", "row_id", "chosen", "rejected").withColumnsRenamed({"chosen": "a", "rejected": "b"}).withColumn("j", F.when(F.col("row_id") % 3 == 0, "A").otherwise("B"))
    return T.preference_pairs(df, "j", "a", "b", "A").select("row_id", "chosen", "rejected")


@query("SELECT row_id, train_prompts || chosen AS chosen, train_prompts || rejected AS rejected FROM dpo_train")
def reward_pairs(spark, d):
    df = read(spark, d, "dpo_train", "row_id", "train_prompts", "chosen", "rejected")
    return T.reward_pairs(df, "train_prompts", "chosen", "rejected").select("row_id", "chosen", "rejected")


@query("SELECT example_id, train_input || train_output AS text FROM finetune_rows")
def training_concat(spark, d):
    return read(spark, d, "finetune_rows", "example_id", "train_input", "train_output").select("example_id", X.prompt_completion(F.col("train_input"), F.col("train_output")).alias("text"))


@query("SELECT kind, CASE WHEN n < 1000 THEN 'n<1K' WHEN n < 10000 THEN '1K<n<10K' WHEN n < 100000 THEN '10K<n<100K' ELSE '100K<n<1M' END AS size FROM (SELECT kind, count(*) AS n FROM documents GROUP BY kind)")
def size_category(spark, d):
    return read(spark, d, "documents", "kind").groupBy("kind").count().select("kind", X.size_category(F.col("count")).alias("size"))


# Prompts and models


@query("SELECT doc_id, 'Input: ' || text || chr(10) || chr(10) || 'Instruction: Give the text a title.' AS prompt FROM documents WHERE text IS NOT NULL")
def process_prompt(spark, d):
    return read(spark, d, "documents", "doc_id", "text").filter("text is not null").select("doc_id", P.process_prompt(F.col("text"), "Give the text a title.").alias("prompt"))


@query("SELECT c_custkey, 'Name the segment.' || chr(10) || chr(10) || 'Input: a' || chr(10) || 'Output: 1' || chr(10) || 'Input: b' || chr(10) || 'Output: 2' || chr(10) || 'Input: ' || c_mktsegment || chr(10) || 'Output:' AS prompts FROM customer")
def few_shot(spark, d):
    return P.few_shot_prompts(read(spark, d, "customer", "c_custkey", "c_mktsegment"), "c_mktsegment", [("a", "1"), ("b", "2")], "Name the segment.").select("c_custkey", "prompts")


@query("SELECT id AS pos, 'Describe a ' || ['red', 'green'][(id // 2) % 2 + 1] || ' ' || ['cup', 'box'][id % 2 + 1] || '.' AS prompts, (id // 4)::BIGINT AS seed FROM range(10) t(id)")
def attributed_prompt(spark, d):
    return shown(P.attributed_prompts(spark, "Describe a {colour} {thing}.", {"colour": ["red", "green"], "thing": ["cup", "box"]}, 10)).select("pos", "prompts", "seed")


@query("SELECT id AS pos, 'Invent a riddle.' AS prompts, id::VARCHAR AS seed FROM range(50) t(id)")
def data_from_prompt(spark, d):
    return shown(P.data_from_prompt(spark, "Invent a riddle.", 50)).select("pos", "prompts", "seed")


@query("SELECT prompt_id, '<s>Be brief. [' || prompt || ']' AS chat FROM prompt_log")
def chat_template(spark, d):
    return read(spark, d, "prompt_log", "prompt_id", "prompt").select("prompt_id", X.chat_prompt("<s>{{system_prompt}} [{{prompt}}]", F.col("prompt"), "Be brief.").alias("chat"))


@query(r"SELECT doc_id, source FROM documents WHERE regexp_matches(text, '(?i)\byes\W*\b')")
def filter_prompt(spark, d):
    answer = Expression(lambda p: F.regexp_replace(p, r"(?s)^Input: (.*)\n\nInstruction: Is it so\?$", "$1"))
    return P.filter_with_prompt(read(spark, d, "documents", "doc_id", "source", "text"), "text", answer, "Is it so?").select("doc_id", "source")


ANSWERS = r"(SELECT DISTINCT prompt_id, try_cast(regexp_extract(generation, '[0-9\.]+', 0) AS DOUBLE) AS scores FROM prompt_log)"


@query(f"SELECT prompt_id, scores, (row_number() OVER (ORDER BY scores DESC NULLS LAST, prompt_id) - 1)::BIGINT AS pos FROM {ANSWERS}")
def rank_prompt(spark, d):
    """All answers in order; those without a number come last."""
    df = read(spark, d, "prompt_log", "prompt_id", "generation").dropDuplicates(["prompt_id"]).withColumn(POS, F.col("prompt_id"))
    answer = Expression(lambda p: F.regexp_replace(p, r"(?s)^Input: (.*)\n\nInstruction: Rate it\.$", "$1"))
    return shown(P.rank_with_prompt(df, "generation", answer, "Rate it.")).select("prompt_id", "scores", "pos")


@query("SELECT o_orderkey, (o_orderkey * 7919 % 1000)::DOUBLE AS scores, (row_number() OVER (ORDER BY o_orderkey * 7919 % 1000, o_orderkey) - 1)::BIGINT AS pos FROM orders WHERE o_orderkey * 7919 % 1000 >= 250")
def rank_prompt_threshold(spark, d):
    answer = Expression(lambda p: F.concat(F.lit("I say "), F.pmod(F.regexp_extract(p, r"Input: (\d+)", 1).cast("bigint") * 7919, F.lit(1000)).cast("string"), F.lit("!")))
    return shown(P.rank_with_prompt(order_frame(spark, d), "o_orderkey", answer, "Rate it.", reverse=False, threshold=250.0)).select("o_orderkey", "scores", "pos")


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 'Input A' ELSE 'Input B' END AS judgements FROM orders")
def judge_pairs(spark, d):
    df = order_frame(spark, d).withColumns({"a": F.col("o_totalprice").cast("decimal(18,2)").cast("string"), "b": F.lit("150000.00")})
    first, second = (F.regexp_extract("judge_prompts", rf"{x} ([0-9.]+)", 1).cast("double") for x in ("Input A:", "Input B:"))
    judge = Expression(lambda p: F.when(first > second, "Input A").otherwise("Input B"))
    return P.judge_pairs(df, "a", "b", judge, df.count()).select("o_orderkey", "judgements")


@query("SELECT c_custkey, upper(c_mktsegment) || '!' AS generations FROM customer")
def model_arrow(spark, d):
    shout = Function(lambda s: s.upper() + "!", name="shout")
    return with_model(read(spark, d, "customer", "c_custkey", "c_mktsegment"), "c_mktsegment", "generations", shout).select("c_custkey", "generations")


@query("SELECT c_custkey, length(c_mktsegment)::BIGINT AS n FROM customer")
def model_cache(spark, d):
    """Answered once for each input, then from the folder alone: the second model knows no answer."""
    df, folder = read(spark, d, "customer", "c_custkey", "c_mktsegment"), f"{_folder(spark)}/cache"
    with_model_memoised(df, "c_mktsegment", "n", Function(len, "bigint", name="size"), folder)
    return with_model_memoised(df, "c_mktsegment", "n", Function(lambda x: -1, "bigint", name="size"), folder).select("c_custkey", "n")


@query("SELECT c_custkey, 2 * length(c_mktsegment)::BIGINT AS n FROM customer")
def model_cache_force(spark, d):
    """New answers replace earlier ones, also for a later run that takes what is there."""
    df, folder = read(spark, d, "customer", "c_custkey", "c_mktsegment"), f"{_folder(spark)}/cache"
    with_model_memoised(df, "c_mktsegment", "n", Function(len, "bigint", name="size"), folder)
    with_model_memoised(df, "c_mktsegment", "n", Function(lambda x: 2 * len(x), "bigint", name="size"), folder, force=True)
    return with_model_memoised(df, "c_mktsegment", "n", Function(len, "bigint", name="size"), folder, cache_only=True).select("c_custkey", "n")


@query("SELECT c_custkey, length(c_name)::BIGINT AS n FROM customer")
def model_parallel(spark, d):
    models = [Function(len, "bigint", name=f"size{i}") for i in range(3)]
    return with_parallel_models(placed(spark, d, "customer", "c_custkey", "c_name"), "c_name", "n", models).select("c_custkey", "n")


@query(r"SELECT doc_id, coalesce(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')), 0)::INT AS n FROM documents")
def token_count(spark, d):
    return read(spark, d, "documents", "doc_id", "text").select("doc_id", X.word_count(F.col("text")).alias("n"))


# Vectors

NEXT = "(SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS b FROM embeddings)"


@query(f"SELECT vec_id, round(list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]), 6) AS similarity FROM {NEXT} WHERE b IS NOT NULL")
def cosine(spark, d):
    df = placed(spark, d, "embeddings", "vec_id", "embedding")
    after = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return df.join(after, "vec_id").select("vec_id", F.round(V.cosine(F.col("embedding"), F.col("b")), 6).alias("similarity"))


@query("SELECT query, item, score FROM (SELECT q.vec_id AS query, c.vec_id AS item, round(list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]), 6) AS score, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding::DOUBLE[], c.embedding::DOUBLE[]) DESC, c.vec_id) AS r FROM embeddings q, embeddings c WHERE q.vec_id % 50 = 0) WHERE r <= 5")
def retrieve_topk(spark, d):
    df = read(spark, d, "embeddings", "vec_id", "embedding")
    found = V.top_k(df.filter("vec_id % 50 = 0").withColumnRenamed("vec_id", "query"), df.withColumnRenamed("vec_id", "item"), 5)
    return found.select("query", "item", F.round("score", 6).alias("score"))


@query("SELECT e.vec_id, 'Document: ' || r_name || chr(10) || chr(10) || 'Question: ' || label AS prompt FROM embeddings e JOIN region ON r_regionkey = e.vec_id % 5")
def rag_prompt(spark, d):
    regions = read(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.array("r_name").alias("texts"))
    df = read(spark, d, "embeddings", "vec_id", "label").withColumn("k", F.col("vec_id") % 5).join(regions, "k").select("vec_id", F.struct("texts").alias("results"), F.col("label").cast("string").alias("q"))
    return P.rag_prompts(df, "q", out="prompt").select("vec_id", "prompt")


AFTER = "(SELECT vec_id, embedding AS a, lead(embedding) OVER (ORDER BY vec_id) AS p, lead(embedding, 2) OVER (ORDER BY vec_id) AS n FROM embeddings)"


@query(f"SELECT round(avg(CASE WHEN list_cosine_similarity(a::DOUBLE[], p::DOUBLE[]) > list_cosine_similarity(a::DOUBLE[], n::DOUBLE[]) THEN 1.0 ELSE 0.0 END), 6) AS accuracy FROM {AFTER} WHERE n IS NOT NULL")
def triplet_accuracy(spark, d):
    df = read(spark, d, "embeddings", "vec_id", "embedding")
    one = df.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("p"))
    two = df.select((F.col("vec_id") - 2).alias("vec_id"), F.col("embedding").alias("n"))
    return T.triplet_accuracy(df.join(one, "vec_id").join(two, "vec_id"), "embedding", "p", "n").select(F.round("accuracy", 6).alias("accuracy"))


@query("SELECT o_orderkey, array_to_string(([1, 2] || [o_custkey] || [9])[1:3], ',') AS input_ids, array_to_string(([-100, -100] || [o_custkey] || [9])[1:3], ',') AS labels FROM orders")
def causal_masks(spark, d):
    df = read(spark, d, "orders", "o_orderkey", "o_custkey").select("o_orderkey", F.array(F.lit(1), F.lit(2)).alias("p"), F.array(F.col("o_custkey").cast("int")).alias("c"))
    return T.causal(df, "p", "c", 9, 3).select("o_orderkey", listed("input_ids"), listed("labels"))


@query("SELECT event_type, round(p, 6) AS p, s FROM (SELECT event_type, avg(value) AS p, count(*) AS s FROM events GROUP BY event_type) ORDER BY p DESC, s DESC LIMIT 1")
def best_metric(spark, d):
    df = read(spark, d, "events", "event_type", "value").groupBy("event_type").agg(F.avg("value").alias("p"), F.count("*").alias("s"))
    return T.best(df, "p", "s", "event_type").withColumn("p", F.round("p", 6))


# Files and streams


def _folder(spark: SparkSession) -> str:
    return Files(spark).make(table_path(spark))


@query("SELECT n_nationkey, n_name, n_regionkey, n_nationkey::BIGINT AS pos FROM nation")
def csv_round_trip(spark, d):
    path = sinks.to_csv(placed(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"), f"{_folder(spark)}/x.csv", "|")
    return shown(files.csv(spark, files=path, sep="|"))


@query("SELECT s_suppkey, s_name, s_acctbal, (row_number() OVER (ORDER BY s_suppkey) - 1)::BIGINT AS pos FROM supplier")
def json_round_trip(spark, d):
    path = sinks.to_json(placed(spark, d, "supplier", "s_suppkey", "s_name", "s_acctbal"), f"{_folder(spark)}/x.json")
    return shown(files.json(spark, files=path))


@query("SELECT c_name AS text, (row_number() OVER (ORDER BY c_custkey) - 1)::BIGINT AS pos FROM customer")
def text_lines(spark, d):
    path = f"{_folder(spark)}/lines"
    placed(spark, d, "customer", "c_custkey", "c_name").orderBy(POS).coalesce(1).select("c_name").write.text(path)
    return shown(files.text(spark, path))


@query("SELECT o_orderkey, o_totalprice, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS pos FROM orders")
def sharded_export(spark, d):
    path = sinks.to_parquet(order_frame(spark, d), f"{_folder(spark)}/set", 4)
    return shown(files.saved(spark, path))


@query("SELECT row_id, train_prompts AS prompt, chosen FROM dpo_train WHERE chosen IS NOT NULL")
def finetune_lines(spark, d):
    df = read(spark, d, "dpo_train", "row_id", "train_prompts", "chosen").filter("chosen is not null").withColumn(POS, F.col("row_id"))
    lines = sinks.chat_lines(df, "train_prompts", "chosen", "Be brief.")
    message = lambda i: F.get_json_object("value", f"$.messages[{i}].content")
    return lines.select(F.col(POS).alias("row_id"), message(1).alias("prompt"), message(2).alias("chosen"))


@query("SELECT event_id, value * 2 AS twice FROM events WHERE event_type = 'click'")
def stream_stateless(spark, d):
    schema = read(spark, d, "events").schema
    source = spark.readStream.schema(schema).parquet(f"{d}/event?.parquet")
    out = stateless.stream(source, lambda df: df.filter("event_type = 'click'"), lambda df: df.select("event_id", (F.col("value") * 2).alias("twice")))
    folder = _folder(spark)
    stateless.to_table(out, f"{folder}/out", f"{folder}/check").awaitTermination()
    return spark.read.parquet(f"{folder}/out")


# The flagship


@query(
    "SELECT (row_number() OVER (ORDER BY scores DESC, doc_id) - 1)::BIGINT AS pos, doc_id, prompts, scores::DOUBLE AS scores FROM (SELECT doc_id, prompts, (length(prompts) * 37 + doc_id * 11) % 100 AS scores FROM "
    "(SELECT doc_id, 'Input: ' || coalesce(source, 'unknown') || chr(10) || chr(10) || 'Instruction: Rate the source. ' || doc_id AS prompts FROM documents WHERE lang = 'en')) WHERE scores >= 40 ORDER BY scores DESC, doc_id LIMIT 10"
)
def ranked_documents(spark, d):
    """English documents, rendered as prompts, answered by an expression, scored, and the ten best in order."""
    df = placed(spark, d, "documents", "doc_id", "source", "lang").filter("lang = 'en'")
    asked = df.withColumn("prompts", F.concat(P.process_prompt(F.coalesce("source", F.lit("unknown")), "Rate the source."), F.lit(" "), F.col("doc_id").cast("string")))
    answer = Expression(lambda p: F.concat(F.lit("I would say "), F.pmod(F.length(p) * 37 + F.regexp_extract(p, r"(\d+)$", 1).cast("bigint") * 11, F.lit(100)).cast("string"), F.lit("!")))
    scored = with_model(asked, "prompts", "generations", answer).withColumn("scores", X.parsed_score(F.col("generations"))).filter("scores >= 40")
    return order.top(scored, "scores", 10, reverse=True).select(F.col(POS).alias("pos"), "doc_id", "prompts", "scores")


def queries() -> dict[str, Query]:
    from weftline import step_queries  # noqa: F401, registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(_SQL)
