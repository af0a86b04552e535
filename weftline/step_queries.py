"""Queries of the steps: sessions, saved results, prompts with retrieval, judges, task steps, training sets with ids, and their SQL."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline import ingest, step
from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.models import BatchFunction, Expression, Function, with_model
from weftline.operators import combine
from weftline.plans import prompts as P
from weftline.plans import training as T
from weftline.position import POS
from weftline.queries import NUMBERED, _folder, listed, order_frame, placed, query, read, shown
from weftline.session import Session
from weftline.sources import files, sinks
from weftline.storage import materialised


@contextmanager
def session(spark: SparkSession, path: str | None = None):
    """A session for one query; the one that is active, if there is one, waits."""
    outer, Session.active = Session.active, None
    try:
        with Session(spark, path or ":memory:") as s:
            yield s
    finally:
        Session.active = outer


def frame(s: step.Step) -> DataFrame:
    return shown(s.dense)


# Order and combination


@query("SELECT name, (row_number() OVER (ORDER BY o, k) - 1)::BIGINT AS pos FROM (SELECT 0 AS o, r_regionkey AS k, r_name AS name FROM region UNION ALL SELECT 1, n_nationkey, n_name FROM nation UNION ALL SELECT 2, r_regionkey, r_name FROM region UNION ALL SELECT 3, n_nationkey, n_name FROM nation)")
def concat_nested(spark, d):
    regions, nations = (placed(spark, d, t, k, n).select(F.col(n).alias("name"), POS) for t, k, n in (("region", "r_regionkey", "r_name"), ("nation", "n_nationkey", "n_name")))
    return shown(combine.concat(combine.concat(regions, nations), combine.concat(regions, nations)))


@query("SELECT name, (row_number() OVER (ORDER BY o, k) - 1)::BIGINT AS pos FROM (SELECT 0 AS o, n_nationkey AS k, n_name AS name FROM nation WHERE n_regionkey = 1 UNION ALL SELECT 1, -n_nationkey, n_name FROM nation UNION ALL SELECT 2, r_regionkey, r_name FROM region)")
def concat_steps(spark, d):
    """Filtered, reversed and whole steps put together twice over."""
    with session(spark):
        nations = step.data_source("nations", placed(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")).rename_column("n_name", "name")
        regions = step.data_source("regions", placed(spark, d, "region", "r_regionkey", "r_name")).rename_column("r_name", "name").select_columns("name")
        both = step.concat(nations.filter("n_regionkey = 1").select_columns("name"), nations.select_columns("name").reverse())
        return frame(step.concat(both, regions))


@query(f"SELECT o_orderkey, (n - 1 - pos)::BIGINT AS pos FROM {NUMBERED}")
def dataset_round_trip_reversed(spark, d):
    with session(spark):
        s = step.data_source("orders", order_frame(spark, d).select("o_orderkey", POS)).reverse()
        return frame(step.saved_source("again", s.export_to_dataset(f"{_folder(spark)}/set")))


@query("SELECT o_orderkey, (row_number() OVER (ORDER BY o_orderkey) - 1)::BIGINT AS pos FROM orders WHERE o_totalprice > 100000")
def pushed_filter(spark, d):
    """A filter of a source, renumbered."""
    with session(spark):
        return frame(step.parquet_source("orders", f"{d}/orders.parquet").filter("o_totalprice > 100000").select_columns("o_orderkey"))


@query("SELECT n_name, pos FROM (VALUES (0, 'ARGENTINA')) t(p, x), (SELECT n_name, (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS pos FROM nation) LIMIT 5")
def head(spark, d):
    with session(spark):
        rows = step.data_source("nations", placed(spark, d, "nation", "n_nationkey", "n_name")).head(5)
    return spark.createDataFrame(rows.reset_index(names="pos")[["n_name", "pos"]], "n_name string, pos bigint")


@query("SELECT count(*) AS n, count(*) AS n_positions, true AS within, true AS most_moved FROM documents")
def shuffle_windows(spark, d):
    """Rows mixed within windows of 50: all positions, none outside its window, most moved."""
    with session(spark):
        df = step.data_source("documents", placed(spark, d, "documents", "doc_id"), total_num_rows=None).shuffle(seed=3, buffer_size=50).frame
    moved = F.avg((F.col("doc_id") != F.col(POS)).cast("int")) > 0.9
    return df.agg(F.count("*").alias("n"), F.countDistinct(POS).alias("n_positions"), F.bool_and(F.floor(F.col("doc_id") / 50) == F.floor(F.col(POS) / 50)).alias("within"), moved.alias("most_moved"))


@query("SELECT DISTINCT row_id, length(train_prompts || chosen) / 100 AS reward FROM dpo_train WHERE chosen IS NOT NULL")
def reward_callable(spark, d):
    """A function of a list of texts gives their rewards."""
    df = read(spark, d, "dpo_train", "row_id", "train_prompts", "chosen").filter("chosen is not null").dropDuplicates(["row_id"])
    return with_model(df.withColumn("t", F.concat("train_prompts", "chosen")), "t", "reward", BatchFunction(lambda texts: [len(t) / 100 for t in texts], "double")).select("row_id", "reward")


# Sources, sinks, sessions


@query("SELECT n_nationkey, n_name FROM nation WHERE n_nationkey % 2 = 0")
def exported_values(spark, d):
    """A dict of columns and a list of rows, as rows again."""
    with session(spark):
        s = step.data_source("nations", placed(spark, d, "nation", "n_nationkey", "n_name")).filter(F.col("n_nationkey") % 2 == 0)
        columns, rows = s.export_to_dict(), s.export_to_list()
    assert rows == [dict(zip(columns, r)) for r in zip(*columns.values())]
    return spark.createDataFrame([(r["n_nationkey"], r["n_name"]) for r in rows], "n_nationkey int, n_name string")


@query(f"SELECT o_orderkey, CASE WHEN pos < n - ceil(0.2 * n) - ceil(0.125 * (n - ceil(0.2 * n))) THEN 'train' WHEN pos < n - ceil(0.2 * n) THEN 'val' ELSE 'test' END AS split FROM {NUMBERED}")
def split_files(spark, d):
    """x.train.csv, x.val.csv and x.test.csv."""
    with session(spark):
        s = step.data_source("orders", order_frame(spark, d).select("o_orderkey", POS))
        found = s.export_to_csv(f"{_folder(spark)}/x.csv", train_size=0.7, validation_size=0.1, test_size=0.2)
    parts = [files.csv(spark, files=p).select("o_orderkey", F.lit(p.split(".")[-2]).alias("split")) for p in found.values()]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("SELECT id AS number, 'row ' || id AS name, CASE WHEN id % 3 = 0 THEN id / 2 END AS half, id AS pos FROM range(1000) t(id)")
def lazy_rows(spark, d):
    """A generator of rows, written a part at a time."""
    def rows():
        for i in range(1000):
            yield {"number": i, "name": f"row {i}", "half": i / 2 if i % 3 == 0 else None}

    df, _ = ingest.streamed(spark, ingest.LazyRows(rows), ["number", "name", "half"], held=128)
    return shown(df)


@query("SELECT n_name, n_regionkey FROM nation")
def hub_folder(spark, d):
    """A folder for a hub with data by split and a card, read back by one split."""
    with session(spark):
        s = step.data_source("nations", placed(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey")).select_columns(["n_name", "n_regionkey"])
        folder = s.export_for_hub(_folder(spark), train_size=0.8, test_size=0.2)
        train, test = (step.hub_source(x, folder, split=x) for x in ("train", "test"))
        return step.concat(train, test).frame.drop(POS)


@query("SELECT c_custkey, c_acctbal * 2 AS twice FROM customer")
def saved_step(spark, d):
    """Saved by one session and taken by the next, whose own function would fail."""
    path = _folder(spark)
    for function in (lambda r: {"twice": r["c_acctbal"] * 2}, lambda r: {"twice": r["no such column"]}):
        with session(spark, path):
            s = step.data_source("customers", placed(spark, d, "customer", "c_custkey", "c_acctbal")).map(function, "twice double", remove_columns="c_acctbal", key="twice").save("twice")
    return s.frame.drop(POS)


@query("SELECT n_name, n_nationkey * 3 AS z FROM nation")
def custom_step(spark, d):
    class Times(step.CustomStep):
        def setup(self):
            self.register_input("name")
            self.register_input("x")
            self.register_arg("by", required=False, default=2)
            self.register_output("name")
            self.register_output("y")

        def run(self):
            return {"name": list(self.inputs["name"]), "y": [v * self.args["by"] for v in self.inputs["x"]]}

    with session(spark):
        s = step.data_source("nations", placed(spark, d, "nation", "n_nationkey", "n_name"))
        out = Times("times", {"name": s["n_name"], "x": s["n_nationkey"]}, {"by": 3}, {"name": "n_name", "y": "z"}).output
        return out.frame.drop(POS).withColumn("z", F.col("z").cast("int"))


# Text functions


@query("SELECT o_orderkey, 'Value: ' || CASE WHEN x = 0 THEN 'True' WHEN x = 1 THEN 'False' WHEN x = 2 THEN (o_orderkey % 1000)::VARCHAR || '0000000.0' WHEN x = 3 THEN 'None' ELSE '0.000' || (1 + o_orderkey % 9) END AS prompt FROM (SELECT o_orderkey, o_orderkey % 5 AS x FROM orders) WHERE x != 2 OR o_orderkey % 1000 > 0")
def python_strings(spark, d):
    """Booleans, large and small numbers and nulls as Python writes them."""
    df = read(spark, d, "orders", "o_orderkey").filter("o_orderkey % 5 != 2 or o_orderkey % 1000 > 0")
    k = F.col("o_orderkey")
    df = df.withColumns({"b": k % 5 == 0, "x": F.when(k % 5 == 2, (k % 1000) * 1e7).when(k % 5 == 4, (1 + k % 9) / 10000.0)})
    value = F.when(k % 5 < 2, X.python_text(df, "b")).otherwise(X.python_text(df, "x"))
    return df.select("o_orderkey", X.labelled("Value:", value).alias("prompt"))


@query("SELECT prompt_id, trim(split_part(prompt, ' the ', 1), ' ' || chr(9) || chr(10) || chr(13)) AS cut FROM prompt_log WHERE prompt NOT LIKE '%' || chr(10) || '%'")
def stop_cut(spark, d):
    df = read(spark, d, "prompt_log", "prompt_id", "prompt").filter(~F.col("prompt").contains("\n"))
    return df.select("prompt_id", X.cut_at_stop(F.col("prompt"), [" the "]).alias("cut"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS norm, round(list_max(embedding)::DOUBLE / sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS most, list_position(embedding, list_max(embedding)) - 1 AS at FROM embeddings")
def unit_norm(spark, d):
    df = read(spark, d, "embeddings", "vec_id", "embedding").withColumn("unit", V.unit(F.transform("embedding", lambda x: x.cast("double"))))
    return df.select("vec_id", F.round(V.norm(F.col("embedding")), 6).alias("norm"), F.round(F.array_max("unit").cast("double"), 4).alias("most"), V.argmax(F.col("embedding")).cast("int").alias("at"))


@query("SELECT row_id, round(margin, 6) AS margin, chosen || '!' AS chosen FROM (SELECT row_id, length(chosen) * 0.5::DOUBLE - length(rejected) * 0.25::DOUBLE AS margin, train_prompts || chosen AS chosen FROM dpo_train)")
def score_margin(spark, d):
    df = read(spark, d, "dpo_train", "row_id", "train_prompts", "chosen", "rejected").withColumns({"a": F.length("chosen") * 0.5, "b": F.length("rejected") * 0.25})
    return T.reward_pairs(df, "train_prompts", "chosen", "rejected", "a", "b").select("row_id", F.round("margin", 6).alias("margin"), F.concat("chosen", F.lit("!")).alias("chosen"))


# Prompts


LETTERS = "aeiou"
COUNTS = "[" + ", ".join(f"(length({{0}}) - length(replace(lower({{0}}), '{c}', '')))::DOUBLE" for c in LETTERS) + "]"


def letter_counts() -> Expression:
    """An embedder in the plan: how often each vowel stands in a text."""
    out = Expression(lambda c: F.array(*(F.length(F.regexp_replace(F.lower(c), f"[^{x}]", "")).cast("float") for x in LETTERS)), name="letters")
    out.output_type = "array<float>"
    return out


def _nearest(k: int, of: str, key: str, more: str = "") -> str:
    """q, item, name, r: the k nations nearest to each row of a table of texts t and keys."""
    return (
        f"SELECT * FROM (SELECT q.{key}, n_nationkey, n_name, n_regionkey{more}, row_number() OVER (PARTITION BY q.{key} ORDER BY list_inner_product({COUNTS.format('q.t')}, {COUNTS.format('n_name')}) DESC, n_nationkey) AS r FROM {of} q, nation) WHERE r <= {k}"
    )


CUSTOMERS = "(SELECT c_custkey, c_mktsegment AS t FROM customer)"


@query(f"SELECT c_custkey, 'Give the number.' || chr(10) || chr(10) || string_agg('Input: ' || n_name || chr(10) || 'Output: ' || n_regionkey, chr(10) ORDER BY r) || chr(10) || 'Input: ' || any_value(t) || chr(10) || 'Output:' AS prompts, length(any_value(t)) AS n FROM ({_nearest(3, CUSTOMERS, 'c_custkey', ', q.t')}) GROUP BY c_custkey")
def few_shot_retrieval(spark, d):
    """Before each input the three nearest examples, best first."""
    with session(spark):
        examples = step.data_source("nations", placed(spark, d, "nation", "n_nationkey", "n_name", "n_regionkey"))
        s = step.data_source("customers", placed(spark, d, "customer", "c_custkey", "c_mktsegment"))
        asked = s.few_shot_prompt_with_retrieval("c_mktsegment", Expression(lambda p: F.regexp_extract(p, r"Input: (\w+)\nOutput:$", 1)), examples, "n_name", "n_regionkey", letter_counts(), 3, "Give the number.")
        return asked.frame.select("c_custkey", "prompts", F.length("generations").alias("n"))


@query(f"SELECT c_custkey, string_agg('Document: ' || n_name, chr(10) ORDER BY r) || chr(10) || chr(10) || 'Question: ' || any_value(t) AS prompt FROM ({_nearest(2, CUSTOMERS, 'c_custkey', ', q.t')}) GROUP BY c_custkey")
def rag_retrieval(spark, d):
    """Before each question the two nearest texts."""
    with session(spark):
        retriever = step.data_source("nations", placed(spark, d, "nation", "n_nationkey", "n_name")).retriever("n_name", letter_counts())
        s = step.data_source("customers", placed(spark, d, "customer", "c_custkey", "c_mktsegment"))
        return s.rag_prompt("c_mktsegment", Expression(lambda p: p), retriever, 2).frame.select("c_custkey", F.col("generations").alias("prompt"))


@query(f"SELECT c_custkey, string_agg(n_nationkey::VARCHAR, ',' ORDER BY r) AS indices, string_agg(n_name, ',' ORDER BY r) AS texts FROM ({_nearest(4, CUSTOMERS, 'c_custkey')}) GROUP BY c_custkey")
def retrieve_step(spark, d):
    with session(spark):
        retriever = step.data_source("nations", placed(spark, d, "nation", "n_nationkey", "n_name")).retriever("n_name", letter_counts())
        found = step.data_source("customers", placed(spark, d, "customer", "c_custkey", "c_mktsegment")).retrieve("c_mktsegment", retriever, 4)
        return found.frame.select("c_custkey", listed("results.indices").alias("indices"), F.array_join("results.texts", ",").alias("texts"))


@query("SELECT s_suppkey, 'Rate.' || chr(10) || chr(10) || string_agg(e, chr(10) ORDER BY i) || chr(10) || 'Input: ' || s_name || chr(10) || 'Output:' AS prompts FROM supplier, (VALUES (0, 'Input: a b c' || chr(10) || 'Output: 1'), (2, 'Input: d' || chr(10) || 'Output: 3')) t(i, e) GROUP BY s_suppkey, s_name")
def budget_packing(spark, d):
    """The second example doesn't fit; the third, shorter one does."""
    df = read(spark, d, "supplier", "s_suppkey", "s_name")
    examples = [("a b c", "1"), ("one two three four five six seven", "2"), ("d", "3")]
    return P.few_shot_prompts(df, "s_name", examples, "Rate.", budget=14).select("s_suppkey", "prompts")


@query("SELECT o_orderkey, CASE WHEN length(a) >= length(b) THEN 'Response A' ELSE 'Response B' END AS judgements FROM (SELECT o_orderkey, o_orderpriority AS a, o_orderstatus || '-123456' AS b FROM orders)")
def judge_generations(spark, d):
    """The longer answer to a prompt is better, whatever the order it is shown in."""
    df = order_frame(spark, d).join(read(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_orderstatus"), "o_orderkey").withColumns({"b": F.concat("o_orderstatus", F.lit("-123456")), "q": F.lit("How urgent?")})
    first, second = (F.length(F.regexp_extract("judge_prompts", rf"(?m)^Response {x}: (.*)$", 1)) for x in "AB")
    shown_first = F.regexp_extract("judge_prompts", r"(?m)^Response A: (.*)$", 1)
    judge = Expression(lambda p: F.when((first > second) | (first == second) & ~shown_first.rlike("-123456$"), "Response A").otherwise("Response B"))
    with session(spark):
        s = step.data_source("orders", df, total_num_rows=df.count())
        return s.judge_generation_pairs("q", "o_orderpriority", "b", judge).frame.select("o_orderkey", "judgements")


@query("SELECT o_orderkey, 1000 + o_orderkey % 7 AS judgements FROM orders")
def judgement_function(spark, d):
    with session(spark):
        s = step.data_source("orders", order_frame(spark, d).withColumns({"a": F.lit("x"), "b": (F.col("o_orderkey") % 7).cast("string")}))
        judge = Expression(lambda p: F.regexp_extract(p, r"([0-6])(?:\n|$)", 1))
        judged = s.judge_pairs("a", "b", judge, draws="hash", judgement_func=lambda answer, swapped: answer.cast("bigint") + 1000)
        return judged.frame.select("o_orderkey", "judgements")


@query("SELECT c_custkey, length('Input: ' || c_custkey || chr(10) || chr(10) || 'Instruction: Count.')::BIGINT AS generations FROM customer")
def post_processed(spark, d):
    """A Python function of each answer."""
    with session(spark):
        s = step.data_source("customers", placed(spark, d, "customer", "c_custkey"))
        return s.process_with_prompt("c_custkey", Expression(lambda p: F.upper(p)), "Count.", post_process=len, output_type="bigint").frame.select("c_custkey", "generations")


@query("SELECT p_partkey, '<s>Be brief. [' || upper(p_name) || ']' AS generations FROM part")
def prompt_step(spark, d):
    """A chat prompt, an answer cut at a stop string, and a function of the answer's column."""
    with session(spark):
        s = step.data_source("parts", placed(spark, d, "part", "p_partkey", "p_name"))
        asked = s.prompt("p_name", Expression(lambda p: F.concat(p, F.lit("STOP and more"))), template="<s>{{system_prompt}} [{{prompt}}]", system_prompt="Be brief.", stop=["STOP"], post_process=lambda g: F.concat(F.substring_index(g, "[", 1), F.lit("["), F.upper(F.substring_index(g, "[", -1))))
        return asked.frame.select("p_partkey", "generations")


@query("SELECT id AS pos, 'red' AS colour, ['cup', 'box'][id % 2 + 1] AS thing, upper('a red ' || ['cup', 'box'][id % 2 + 1]) AS generations FROM range(9) t(id)")
def attributed_step(spark, d):
    with session(spark):
        s = step.data_from_attributed_prompt("made", Expression(lambda p: F.upper(p)), "a {colour} {thing}", {"colour": ["red"], "thing": ["cup", "box"]}, 9)
        return frame(s).select("pos", "attributes.colour", "attributes.thing", "generations")


@query("SELECT id AS pos, 'Invent a riddle.' AS prompts, 'RIDDLE' AS generations FROM range(20) t(id)")
def data_step(spark, d):
    with session(spark):
        return frame(step.data_from_prompt("made", Function(lambda p: "RIDDLE"), "Invent a riddle.", 20)).select("pos", "prompts", "generations")


# Task steps


@query(f"SELECT doc_id, round(list_cosine_similarity({COUNTS.format('source')}, {COUNTS.format('kind')}), 6) AS similarities FROM documents WHERE source IS NOT NULL")
def cosine_step(spark, d):
    """Texts are embedded, then compared row by row."""
    with session(spark):
        s = step.data_source("documents", placed(spark, d, "documents", "doc_id", "source", "kind")).filter("source is not null")
        return s.cosine_similarity("source", "kind", letter_counts()).frame.select("doc_id", F.round("similarities", 6).alias("similarities"))


@query(f"SELECT c_custkey, array_to_string([v::INT FOR v IN {COUNTS.format('x')}], ',') AS embeddings FROM (SELECT c_custkey, 'query: ' || c_name AS x FROM customer)")
def embed_step(spark, d):
    """An instruction goes before each text."""
    with session(spark):
        s = step.data_source("customers", placed(spark, d, "customer", "c_custkey", "c_name")).embed("c_name", letter_counts(), instruction="query: ")
        return s.frame.select("c_custkey", F.array_join(F.transform("embeddings", lambda x: x.cast("int").cast("string")), ",").alias("embeddings"))


@query("SELECT doc_id, coalesce(length(text), 0) / 1000 AS long, CASE WHEN coalesce(length(text), 0) > 500 THEN 'long' ELSE 'short' END AS label FROM documents")
def run_task_model(spark, d):
    """A classifier's scores as a struct, and the label of the greatest."""
    model = Function(lambda t: {"long": len(t or "") / 1000, "short": 0.5}, "struct<long: double, short: double>", name="lengths")
    with session(spark):
        s = step.data_source("documents", placed(spark, d, "documents", "doc_id", "text")).run_task_model("text", model)
        return s.frame.select("doc_id", F.col("results.long").alias("long"), F.when(F.col("results.long") > F.col("results.short"), "long").otherwise("short").alias("label"))


# Training sets


WORDS = "coalesce([length(x) FOR x IN string_split({0}, ' ')], [])"


def word_lengths() -> Expression:
    """A tokenizer in the plan: the id of a word is its length."""
    out = Expression(lambda c: F.transform(F.split(c, " "), lambda w: F.length(w)), name="lengths")
    out.output_type = "array<int>"
    return out


@query(f"SELECT example_id, array_to_string(({WORDS.format('train_input')} || [7])[1:50], ',') AS input_ids, array_to_string(({WORDS.format('train_output')} || [7])[1:50], ',') AS labels FROM finetune_rows")
def seq2seq(spark, d):
    df = read(spark, d, "finetune_rows", "example_id", "train_input", "train_output")
    return T.seq2seq(df, "train_input", "train_output", word_lengths(), 7, 50).select("example_id", listed("input_ids"), listed("labels"))


@query(f"SELECT doc_id, array_to_string(({WORDS.format('text')})[1:20], ',') AS input_ids, dense_rank() OVER (ORDER BY kind)::INT - 1 AS labels FROM documents")
def classification_ids(spark, d):
    df = read(spark, d, "documents", "doc_id", "text", "kind")
    return T.classification(df, "text", "kind", T.label_ids(df, label="kind"), word_lengths(), 20).select("doc_id", listed("input_ids"), "labels")


@query(f"SELECT row_id, array_to_string({WORDS.format('train_prompts || chosen')} || [7], ',') AS input_ids_chosen, array_to_string({WORDS.format('train_prompts || rejected')} || [7], ',') AS input_ids_rejected, (length(chosen) - length(rejected))::DOUBLE AS margin FROM dpo_train")
def reward_pair_ids(spark, d):
    df = read(spark, d, "dpo_train", "row_id", "train_prompts", "chosen", "rejected").withColumns({"a": F.length("chosen"), "b": F.length("rejected")})
    return T.reward_pair_ids(df, "train_prompts", "chosen", "rejected", word_lengths(), 7, chosen_score="a", rejected_score="b").select("row_id", listed("input_ids_chosen"), listed("input_ids_rejected"), "margin")


@query(f"SELECT row_id, array_to_string({WORDS.format('train_prompts || chosen')} || [7], ',') AS input_ids, margin AS labels FROM dpo_train")
def reward_score_ids(spark, d):
    df = read(spark, d, "dpo_train", "row_id", "train_prompts", "chosen", "margin")
    return T.reward_scores(df, "train_prompts", "chosen", "margin", word_lengths(), 7).select("row_id", listed("input_ids"), "labels")


P_IDS, C_IDS, R_IDS = (WORDS.format(c) for c in ("train_prompts", "chosen", "rejected"))


@query(
    f"SELECT row_id, array_to_string({P_IDS}, ',') AS prompt_input_ids, array_to_string({P_IDS} || {C_IDS} || [7], ',') AS chosen_input_ids, array_to_string([-100 FOR x IN {P_IDS}] || {C_IDS} || [7], ',') AS chosen_labels, "
    f"array_to_string({P_IDS} || {R_IDS} || [7], ',') AS rejected_input_ids, array_to_string([-100 FOR x IN {P_IDS}] || {R_IDS} || [7], ',') AS rejected_labels FROM dpo_train"
)
def preference_ids(spark, d):
    df = read(spark, d, "dpo_train", "row_id", "train_prompts", "chosen", "rejected")
    out = T.preference_ids(df, "train_prompts", "chosen", "rejected", word_lengths(), 7)
    return out.select("row_id", *(listed(c) for c in ("prompt_input_ids", "chosen_input_ids", "chosen_labels", "rejected_input_ids", "rejected_labels")))


@query("SELECT train_prompts AS anchor, chosen AS positive, rejected AS negative FROM dpo_train")
def sentence_triplets(spark, d):
    return T.sentence_rows(read(spark, d, "dpo_train", "train_prompts", "chosen", "rejected"), "train_prompts", "chosen", "rejected")


@query("SELECT train_prompts AS anchor, chosen AS positive, margin AS label FROM dpo_train")
def sentence_pairs_labelled(spark, d):
    return T.sentence_rows(read(spark, d, "dpo_train", "train_prompts", "chosen", "margin"), "train_prompts", "chosen", label="margin")


@query("SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN '1.0' ELSE '0.0' END || ',' || CASE o_orderstatus WHEN 'O' THEN '1.0' ELSE '0.0' END || ',' || CASE WHEN o_orderkey % 2 = 0 THEN '1.0' ELSE '0.0' END || ',' || CASE o_orderstatus WHEN 'P' THEN '1.0' ELSE '0.0' END AS labels FROM orders")
def multi_hot(spark, d):
    """Lists of labels as vectors in the order of the labels: F, O, OLD, P."""
    df = read(spark, d, "orders", "o_orderkey", "o_orderstatus").withColumn("tags", F.array_compact(F.array(F.col("o_orderstatus"), F.when(F.col("o_orderkey") % 2 == 0, "OLD"))))
    return T.encode_labels(df, "tags", T.label_ids(df, label="tags")).select("o_orderkey", listed("labels"))


@query(
    "WITH x AS (SELECT value > 50 AS p1, user_id % 2 = 0 AS l1, value < 80 AS p2, event_id % 3 = 0 AS l2 FROM events), c AS (SELECT sum((p1 AND l1)::INT + (p2 AND l2)::INT) AS tp, sum((p1 AND NOT l1)::INT + (p2 AND NOT l2)::INT) AS fp, sum((NOT p1 AND l1)::INT + (NOT p2 AND l2)::INT) AS fn, avg((p1 = l1 AND p2 = l2)::INT) AS a FROM x) "
    "SELECT round(a, 6) AS accuracy, round(2 * tp / (2 * tp + fp + fn), 6) AS f1_micro FROM c"
)
def multilabel_metrics(spark, d):
    df = read(spark, d, "events", "value", "user_id", "event_id")
    hot = lambda c: F.when(c, 1.0).otherwise(0.0)
    df = df.select(F.array(hot(F.col("value") > 50), hot(F.col("value") < 80)).alias("s"), F.array(hot(F.col("user_id") % 2 == 0), hot(F.col("event_id") % 3 == 0)).alias("l"))
    return T.multilabel_metrics(df, "s", "l").select(F.round("accuracy", 6).alias("accuracy"), F.round("f1_micro", 6).alias("f1_micro"))


@query("SELECT round(sum(m * n) / sum(n), 6) AS mean_reward FROM (SELECT event_type, avg(value) AS m, count(value) AS n FROM events GROUP BY event_type)")
def mean_reward(spark, d):
    return T.mean_reward(read(spark, d, "events", "event_type", "value"), "value", "event_type").select(F.round("mean_reward", 6).alias("mean_reward"))


@query(r"SELECT kind, max(coalesce(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')), 0))::INT AS max_tokens FROM documents GROUP BY kind")
def longest_texts(spark, d):
    return T.longest(read(spark, d, "documents", "kind", "text"), "text", "kind")


@query(r"SELECT least(coalesce(len(regexp_extract_all(text, '[^ \t\n\v\f\r]+')), 0) // 64, 5)::INT AS bin, count(*) AS n FROM documents GROUP BY 1")
def length_histogram(spark, d):
    return T.length_histogram(read(spark, d, "documents", "text"), "text")


@query("SELECT doc_id, upper(coalesce(lang, '?')) AS g FROM documents")
def model_retries(spark, d):
    """A model that takes three inputs at once at most, in batches of ten."""
    from weftline.models import OutOfMemory

    class Small(Function):
        def run(self, inputs, **options):
            if len(inputs) > 3:
                raise OutOfMemory
            return super().run(inputs, **options)

    df = read(spark, d, "documents", "doc_id", "lang").withColumn("lang", F.coalesce("lang", F.lit("?")))
    return with_model(df, "lang", "g", Small(str.upper, name="small")).select("doc_id", "g")


@query("SELECT n_name AS value, (row_number() OVER (ORDER BY n_nationkey) - 1)::BIGINT AS pos FROM nation")
def arrow_shards(spark, d):
    """A saved folder of Arrow files."""
    import tempfile

    import pyarrow as pa
    import pyarrow.parquet as pq

    table = pq.read_table(f"{d}/nation.parquet", columns=["n_nationkey", "n_name"]).sort_by("n_nationkey").select(["n_name"]).rename_columns(["value"])
    with tempfile.TemporaryDirectory() as folder:  # what the driver's user has on the driver's disk
        for i in range(2):
            with pa.OSFile(f"{folder}/data-0000{i}-of-00002.arrow", "wb") as sink, pa.ipc.new_stream(sink, table.schema) as writer:
                writer.write_table(table.slice(i * 10, 10 if i == 0 else None))
        return materialised(shown(files.saved(spark, folder)))


@query("SELECT DISTINCT row_id, 'Prompt and more' AS prompt, chosen AS completion FROM dpo_train WHERE chosen IS NOT NULL")
def completion_lines(spark, d):
    """Fine-tuning lines of prompt and completion, the prompt cut to three words."""
    df = read(spark, d, "dpo_train", "row_id", "chosen").filter("chosen is not null").dropDuplicates(["row_id"]).withColumns({POS: F.col("row_id"), "p": F.lit("Prompt and more words")})
    lines = sinks.chat_lines(df.withColumn("c", F.lit("x")), "p", "c", chat=False, most_tokens=3, truncate=True)
    whole = sinks.chat_lines(df, "p", "chosen", chat=False)
    field = lambda x, at: F.trim(F.get_json_object(x, f"$.{at}"))
    return lines.select(F.col(POS).alias("row_id"), field("value", "prompt").alias("prompt")).join(whole.select(F.col(POS).alias("row_id"), F.get_json_object("value", "$.completion").alias("completion")), "row_id")
