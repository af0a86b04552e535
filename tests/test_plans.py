import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftline import step
from weftline.functions import text as X
from weftline.functions import vectors as V
from weftline.models import Dictionary, Expression, Function, HashEmbedder, Model, OutOfMemory, with_model, with_model_memoised
from weftline.plans import prompts as P
from weftline.plans import training as T
from weftline.plans.tasks import Retriever, cosine_similarity
from weftline.position import POS
from weftline.streaming import stateless

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def one(spark, expression, value="x"):
    return spark.createDataFrame([(value,)], "x string").select(expression(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("text, yes", [("Yes!", True), ("well, yes", True), ("yesterday", False), ("eyes", False), ("", False), (None, False)])
def test_yes(spark, text, yes):
    assert one(spark, X.says_yes, text) is yes


@pytest.mark.parametrize("text, score", [("I would say, 10!", 10.0), ("7.5.", None), ("none", None), (".", None), ("4.5 of 5", 4.5), (None, None)])
def test_score(spark, text, score):
    assert one(spark, X.parsed_score, text) == score


def test_templates(spark):
    assert X.template_variables("a {b} {{c}} {d.e:f} {b}") == ["b", "d.e:f"]
    assert one(spark, lambda x: X.filled("{a}-{b}", {"a": x, "b": F.lit("2")}), "{b}") == "{b}-2"
    assert one(spark, lambda x: X.chat_prompt("{{system_prompt}}|{{prompt}}", x, "sys"), "hi") == "sys|hi"
    assert one(spark, lambda x: X.cut_at_stop(x, ["STOP"]), "  one STOP two\nthree\t") == "one \nthree"
    assert one(spark, lambda x: X.python_string(F.lit(True), "boolean")) == "True"
    assert one(spark, lambda x: X.python_string(F.lit(1.0), "double")) == "1.0"
    assert X.split_path("a/x.json", "validation") == "a/x.val.json" and X.safe_name("My Step / Sub #2") == "my-step/sub-2"
    assert one(spark, lambda x: X.size_category(F.lit(5000))) == "1K<n<10K"


def test_judgement(spark):
    rows = [("Input A", False), ("Input A", True), ("both Input A, Input B", False), ("", True)]
    df = spark.createDataFrame(rows, "g string, s boolean")
    got = [r["j"] for r in df.select(X.judgement(F.col("g"), "Input A", "Input B", F.col("s"), F.lit("Input B")).alias("j")).collect()]
    assert got == ["Input A", "Input B", "Input B", "Input A"]


def test_packing(spark):
    df = spark.createDataFrame([(["a b c d e", "f", "g h"],)], "xs array<string>")
    pack = lambda **o: P.packed_prompts(df, "p", F.lit("begin"), F.col("xs"), F.lit("end"), "|", count=lambda s: len(s.replace("|", " ").split()), **o).first()["p"]
    assert pack() == "begin|a b c d e|f|g h|end"
    assert pack(budget=5) == "begin|f|g h|end"  # the long one is skipped
    assert pack(budget=5, max_examples=1) == "begin|f|end"
    with pytest.raises(Exception, match="needed"):
        pack(budget=2)
    with pytest.raises(Exception, match="longer"):
        pack(budget=1)
    assert pack(max_examples=0) == "begin|end"


def test_few_shot_and_attributes(spark):
    df = spark.createDataFrame([(3,), (4,)], "x bigint")
    got = [r["prompts"] for r in P.few_shot_prompts(df, "x", [(0, 0), (1, 1)]).collect()]
    assert got[0] == "Input: 0\nOutput: 0\nInput: 1\nOutput: 1\nInput: 3\nOutput:"
    rows = P.attributed_prompts(spark, "{a} {b}", {"a": ["x", "y"], "b": ["1", "2"]}, 5).orderBy(POS).collect()
    assert [(r["prompts"], r["seed"]) for r in rows] == [("x 1", 0), ("x 2", 0), ("y 1", 0), ("y 2", 0), ("x 1", 1)]
    with pytest.raises(ValueError):
        P.attributed_prompts(spark, "{a}", {"b": ["1"]}, 2)


def test_swaps_follow_the_generator(spark):
    df = spark.range(8).withColumnRenamed("id", POS)
    assert [r["s"] for r in df.select(POS, P.swap_flags(df, 8).alias("s")).orderBy(POS).collect()] == [False, False, True, False, True, True, True, True]


def test_cosine_and_retrieval(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [0.0, 2.0]), ([0.0, 0.0], [1.0, 1.0])]
    df = spark.createDataFrame(rows, "a array<float>, b array<float>")
    assert [round(r["similarities"], 6) for r in cosine_similarity(df, "a", "b").collect()] == [1.0, 0.0, 0.0]
    with pytest.raises(ValueError):
        cosine_similarity(df, "a", "b", HashEmbedder())
    texts = spark.createDataFrame([("red apple", 0), ("green pear", 1), ("red car", 2)], f"t string, {POS} bigint")
    queries = spark.createDataFrame([("green pear", 0), ("red apple pie", 1)], f"q string, {POS} bigint")
    got = Retriever(texts, "t", HashEmbedder()).retrieve(queries, "q", 2).orderBy(POS).collect()
    assert got[0]["results"]["indices"][0] == 1 and got[1]["results"]["texts"][0] == "red apple" and got[0]["results"]["scores"][0] == pytest.approx(1.0)


def test_top_k_in_many_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(60, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "item bigint, embedding array<float>")
    monkeypatch.setattr(V, "HELD_NUMBERS", 40)
    monkeypatch.setattr(V, "HELD_SCORES", 7)
    got = V.top_k(df.withColumnRenamed("item", "query"), df, 4)
    want = np.argsort(-(x.astype(np.float32).astype(float) @ x.astype(np.float32).astype(float).T), axis=1)[:, :4]
    assert sorted((r["query"], r["rank"], r["item"]) for r in got.collect()) == [(i, j + 1, int(want[i, j])) for i in range(60) for j in range(4)]


def test_top_k_with_ties_nulls_and_more_than_there_are(spark):
    corpus = spark.createDataFrame([(i, [1.0, 0.0]) for i in range(5)] + [(9, None)], "item bigint, embedding array<float>")
    queries = spark.createDataFrame([(0, [1.0, 0.0]), (1, None)], "query bigint, embedding array<float>")
    assert [(r["query"], r["item"]) for r in V.top_k(queries, corpus, 3).orderBy("rank").collect()] == [(0, 0), (0, 1), (0, 2)]
    assert V.top_k(queries, corpus, 50).count() == 5
    assert V.top_k(queries.limit(0), corpus, 3).count() == 0 and V.top_k(queries, corpus.limit(0), 3).count() == 0


@pytest.fixture
def sent(spark, monkeypatch):
    """What goes to and comes from the Python functions of the frames that a test makes."""
    frames, kind = [], type(spark.range(1))
    call = kind.mapInArrow

    def kept(df, *args, **options):
        out = call(df, *args, **options)
        frames.append((df, out))
        return out

    monkeypatch.setattr(kind, "mapInArrow", kept)
    return frames


def longest(df):
    """The most elements of an array in a frame's rows."""
    return max(df.agg(F.max(F.size(f.name))).first()[0] or 0 for f in df.schema if f.dataType.typeName() == "array")


def test_top_k_holds_no_row_of_many_queries_nor_all_that_are_equal(spark, sent):
    df = spark.range(30).select(F.col("id").alias("item"), F.array(F.lit(1.0), F.lit(0.0)).alias("embedding"))
    got = V.top_k(df.withColumnRenamed("item", "query"), df, 2)
    assert sorted((r["query"], r["item"]) for r in got.collect()) == [(i, j) for i in range(30) for j in range(2)]
    ((given, found),) = sent
    assert longest(given) == 2
    assert found.count() == 60


def test_top_k_of_scores_that_are_no_numbers_and_vectors_of_two_kinds(spark):
    corpus = spark.createDataFrame([(0, [float("nan")]), (1, [2.0]), (2, [None]), (3, [2.0]), (4, [float("-inf")])], "item bigint, embedding array<float>")
    queries = spark.createDataFrame([("a", [1.0]), ("b", [None])], "query string, embedding array<double>")
    assert [(r["query"], r["item"]) for r in V.top_k(queries, corpus, 4).orderBy("rank").collect()] == [("a", 1), ("a", 3), ("a", 4)]
    with pytest.raises(Exception, match="Vectors differ in length"):
        V.top_k(queries, spark.createDataFrame([(0, [1.0]), (1, [1.0, 2.0])], "item bigint, embedding array<float>"), 1).collect()


def lengths():
    return Expression(lambda c: F.array(F.length(c).cast("float"), F.lit(1).cast("float")), name="lengths")


def test_rag_prompt_sends_questions_as_rows(spark, session, sent):
    texts = step.data_source("texts", spark.createDataFrame([("a", 0), ("bbb", 1), ("ccc", 2)], f"t string, {POS} bigint"))
    asked = step.data_source("asked", spark.range(30).select(F.concat(F.lit("q"), F.col("id")).alias("q"), F.col("id").alias(POS)))
    got = asked.rag_prompt("q", Expression(lambda p: p), texts.retriever("t", lengths()), 2).export_to_list()
    assert [r["rag_prompts"] for r in got] == [f"Document: bbb\nDocument: ccc\n\nQuestion: q{i}" for i in range(30)]
    assert [longest(given) for given, _ in sent] == [2]


def test_retrieve_sends_queries_as_rows(spark, session, sent):
    texts = step.data_source("texts", spark.createDataFrame([("bb", 0), ("aa", 1), ("cccc", 2), (None, 3)], f"t string, {POS} bigint"))
    asked = step.data_source("asked", spark.range(30).select(F.when(F.col("id") > 0, F.concat(F.lit("q"), F.col("id"))).alias("q"), F.col("id").alias(POS)))
    got = asked.retrieve("q", texts.retriever("t", lengths()), 3).export_to_list()
    assert [r["results"]["indices"] for r in got] == [[]] + [[2, 0, 1]] * 29
    assert [r["results"]["texts"] for r in got] == [[]] + [["cccc", "bb", "aa"]] * 29
    assert [longest(given) for given, _ in sent] == [2]


class Counting(Model):
    name, output_type = "counting", "string"

    def __init__(self, folder, most=99):
        self.folder, self.most = folder, most

    def run(self, inputs, **options):
        import uuid

        if len(inputs) > self.most:
            raise OutOfMemory
        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("\n".join(inputs))
        return [i.upper() for i in inputs]


def test_models_run_once_for_equal_inputs_and_use_the_cache(spark, tmp_path):
    calls = tmp_path / "calls"
    calls.mkdir()
    seen = lambda: sorted(x for p in calls.iterdir() for x in p.read_text().split("\n"))
    df = spark.createDataFrame([(x,) for x in "abacaba"], "p string")
    cache = str(tmp_path / "cache")
    got = with_model_memoised(df, "p", "g", Counting(str(calls)), cache)
    assert sorted(r["g"] for r in got.collect()) == sorted("ABACABA") and seen() == ["a", "b", "c"]
    more = df.unionAll(spark.createDataFrame([("d",)], "p string"))
    assert with_model_memoised(more, "p", "g", Counting(str(calls)), cache).count() == 8 and seen() == ["a", "b", "c", "d"]
    assert with_model_memoised(more, "p", "g", Counting(str(calls)), cache, cache_only=True).count() == 8
    with pytest.raises(Exception, match="cache_only"):
        with_model_memoised(spark.createDataFrame([("z",)], "p string"), "p", "g", Counting(str(calls)), cache, cache_only=True).collect()


def test_batches_are_halved(spark, tmp_path):
    df = spark.createDataFrame([("x" * i,) for i in range(1, 9)], "p string").coalesce(1)
    got = with_model(df, "p", "g", Counting(str(tmp_path), most=2), batch_size=8).collect()
    assert [r["g"] for r in got] == ["X" * i for i in range(1, 9)]
    assert all(len(p.read_text().split("\n")) <= 2 for p in tmp_path.iterdir())
    with pytest.raises(Exception, match="KeyError"):
        with_model(df, "p", "g", Dictionary({"none": "x"})).collect()


def test_labels_and_metrics(spark):
    df = spark.createDataFrame([("b", ["x"]), ("a", ["y", "x"]), (None, []), ("b", None)], "l string, m array<string>")
    ids = T.label_ids(df, df, label="l")
    assert [tuple(r) for r in ids.orderBy("label").collect()] == [("a", 0), ("b", 1)]
    assert sorted(str(r["labels"]) for r in T.encode_labels(df, "l", ids).collect()) == ["0", "1", "1", "None"]
    hot = T.encode_labels(df, "m", T.label_ids(df, label="m")).collect()
    assert sorted(str(r["labels"]) for r in hot) == ["None", "[0.0, 0.0]", "[1.0, 0.0]", "[1.0, 1.0]"]
    vectors = spark.createDataFrame([([0.9, 0.1], [1.0, 0.0]), ([0.9, 0.9], [1.0, 0.0])], "s array<double>, l array<double>")
    m = T.multilabel_metrics(vectors, "s", "l").first()
    assert (m["accuracy"], round(m["f1_micro"], 6)) == (0.5, 0.8)
    assert T.best(spark.createDataFrame([(1, 0.5, 0.1), (2, 0.5, 0.3), (3, 0.4, 0.9)], "i int, p double, s double"), "p", "s", "i").first()["i"] == 2
    w = spark.createDataFrame([("1", 1.0), ("x", 1.0), ("5", 2.0)], "v string, w double")
    assert T.weighted_mean(w, "v", "w").first()[0] == pytest.approx(11 / 4)
    ids = spark.createDataFrame([([1, 2], [3])], "p array<int>, c array<int>")
    r = T.causal(ids, "p", "c", 9, 3).first()
    assert r["input_ids"] == [1, 2, 3] and r["labels"] == [-100, -100, 3]
    t = spark.createDataFrame([([1.0, 0.0], [1.0, 0.1], [0.0, 1.0])], "a array<double>, p array<double>, n array<double>")
    assert T.triplet_accuracy(t, "a", "p", "n").first()[0] == 1.0


def test_streams(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a", 1), ("b", 2)], "p string, n int").coalesce(1).write.json(str(source))
    stream = spark.readStream.schema("p string, n int").json(str(source))
    with pytest.raises(ValueError):
        stateless.require_batch(stream, "sort")
    out = stateless.stream(stream, lambda df: df.filter("n > 1"), lambda df: stateless.generated(df, "p", "g", Function(str.upper)))
    stateless.to_table(out, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(60)
    assert [r["g"] for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["B"]
    stateless.to_table(stream, str(tmp_path / "out2"), str(tmp_path / "check2"), each=lambda b: b.dropDuplicates(["p"])).awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out2")).count() == 2


def test_queries_have_names_and_sql():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and "ranked_documents" in queries and len(sql) > 55


def test_http_models(spark):
    import json
    import threading
    from http.server import BaseHTTPRequestHandler, HTTPServer

    from weftline.adapters import chat_service, embedding_service, sampling, tokens_left
    from weftline.models import run_batch

    failures = [503]

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            code = failures.pop() if failures else 200
            said = {"choices": [{"message": {"content": f" {body['messages'][-1]['content'].upper()} "}}] * body["n"]} if "messages" in body else {"data": [{"embedding": [1.0, 0.0]}]}
            self.send_response(code)
            self.end_headers()
            self.wfile.write(json.dumps(said).encode())

        def log_message(self, *args):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{server.server_port}"
    assert run_batch(chat_service(url, "m", "sys", threads=1), ["a", "b"], {"temperature": 0.0}, pause=0.01) == ["A", "B"]
    df = spark.createDataFrame([("x",)], "p string")
    assert with_model(df, "p", "g", chat_service(url, "m", n=2)).first()["g"] == ["X", "X"]
    assert with_model(df, "p", "g", embedding_service(url, "m")).first()["g"] == [1.0, 0.0]
    server.shutdown()
    assert sampling(0.0, 0.5, 7, ["x"]) == {"temperature": 0.0, "top_p": 1.0, "max_tokens": 7, "stop": ["x"]}
    assert tokens_left(10, 30) == 20 and tokens_left(10, 30, 5) == 5
    with pytest.raises(ValueError):
        tokens_left(10, 30, 21)
