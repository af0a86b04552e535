"""Orders that survive nesting and files, errors where there is nothing to give, and models that run once a row."""

import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftline import ingest
from weftline.fingerprint import files_state
from weftline.functions import text as X
from weftline.models import BatchSizes, Expression, Function, Model, OutOfMemory, batches_by_length, run_batch, with_model_memoised
from weftline.operators import combine, order
from weftline.plans import prompts as P
from weftline.plans.tasks import Retriever
from weftline.position import POS
from weftline.session import Session
from weftline.step import CompositeStep, CustomStep, concat, data_source, hub_source, parquet_source, saved_source
from weftline.storage import Files

cloudpickle.register_pickle_by_value(sys.modules[__name__])


def numbers(spark, *values):
    return spark.createDataFrame([(v, i) for i, v in enumerate(values)], f"x bigint, {POS} bigint")


def column(df):
    return [r["x"] for r in df.orderBy(POS).collect()]


def test_nested_concat(spark):
    a, b, c = numbers(spark, 1, 2), numbers(spark, 3, 4), numbers(spark, 5, 6)
    assert column(combine.concat(combine.concat(a, b), c)) == column(combine.concat(a, combine.concat(b, c))) == [1, 2, 3, 4, 5, 6]
    whole = combine.concat(combine.concat(a, b), combine.concat(c, a))
    assert sorted(r[POS] for r in whole.collect()) == list(range(8))
    far = a.withColumn(POS, F.col(POS) + (1 << 61))
    assert column(combine.concat(far, far, b)) == column(combine.concat(far, far, b, bounds=[1 << 62, 1 << 62, 2])) == [1, 2, 1, 2, 3, 4]
    assert column(combine.concat(a, b.limit(0), c, bounds=[2, 0, 2])) == [1, 2, 5, 6]


def test_nested_concat_of_steps(session, spark):
    a = data_source("a", {"x": [1, 2, 3]})
    many = data_source("many", spark.range(20).repartition(5).select(F.col("id").alias("x")))  # ids of monotonically_increasing_id
    both = concat(concat(a, a.filter("x > 1")), concat(a.reverse(), many.filter("x < 0")), many)
    got = both.export_to_dict()["x"]
    assert got[:8] == [1, 2, 3, 2, 3, 3, 2, 1] and sorted(got[8:]) == list(range(20))
    assert concat(a, a).skip(2).take(2).export_to_dict() == {"x": [3, 1]}


def test_saved_order(session, tmp_path):
    s = data_source("a", {"x": list(range(6))}).reverse()
    for shards in (None, 2):
        path = s.export_to_dataset(str(tmp_path / f"set{shards}"), num_shards=shards)
        assert saved_source("again", path).export_to_dict() == {"x": [5, 4, 3, 2, 1, 0]}


def test_select_beyond_the_end(session, spark):
    df = numbers(spark, 1, 2)
    with pytest.raises(IndexError):
        order.select(df, [0, 7], 2)
    with pytest.raises(IndexError):
        order.select(df, [-1])
    for wanted in ([0, 7], range(0, 3)):
        with pytest.raises(Exception, match="no row with index"):
            order.select(df, wanted).collect()
    assert column(order.select(df, [1, 1, 0])) == [2, 2, 1] and column(order.select(df, range(0, 2))) == [1, 2] and column(order.select(df, [])) == []
    with pytest.raises(IndexError):
        data_source("a", {"x": [1, 2]}).select([0, 7])


@pytest.mark.parametrize("value", [1.0, -2.5, 1e7, 12345678.9, 1e15, 123456789012345680.0, 1e16, 1.5e16, 1e22, 0.001, 0.0001, 0.00012, 1e-05, 1.25e-07, -3e-10, 0.0, 1 / 3, 2**53 + 0.0, float("inf"), float("nan")])
def test_floats_as_python_writes_them(spark, value):
    df = spark.createDataFrame([(value,)], "x double")
    assert df.select(X.python_text(df, "x").alias("t")).first()["t"] == str(value)


def test_values_as_python_writes_them(spark):
    from datetime import datetime

    rows = [(True, 5, "a", datetime(2030, 1, 2, 3, 4, 5, 120000)), (None, None, None, datetime(2030, 1, 2))]
    df = spark.createDataFrame(rows, "b boolean, i int, s string, t timestamp_ntz")
    got = df.select(*(X.python_text(df, c).alias(c) for c in df.columns)).collect()
    assert [tuple(r) for r in got] == [tuple(map(str, r)) for r in rows]
    asked = P.few_shot_prompts(spark.createDataFrame([(1e7,)], "x double"), "x", [(1e7, True)]).first()["prompts"]
    assert asked == "Input: 10000000.0\nOutput: True\nInput: 10000000.0\nOutput:"


class Counting(Model):
    name = "counting"

    def __init__(self, folder, answer=lambda x: "Yes, 5", output_type="string"):
        self.folder, self.answer, self.output_type = folder, answer, output_type

    def run(self, inputs, **options):
        import uuid

        with open(f"{self.folder}/{uuid.uuid4().hex}", "w") as f:
            f.write("x" * len(inputs))
        return [self.answer(i) for i in inputs]


@pytest.fixture
def counted(tmp_path):
    """A folder, and how many inputs were run since the last question."""
    folder = tmp_path / "calls"
    folder.mkdir()

    def calls():
        found = list(folder.iterdir())
        n = sum(p.stat().st_size for p in found)
        for p in found:
            p.unlink()
        return n

    return str(folder), calls


@pytest.fixture
def ten(spark, tmp_path):
    path = str(tmp_path / "ten.parquet")
    spark.range(10).selectExpr("id as x").coalesce(1).write.parquet(path)
    return path


def test_each_row_is_asked_once(session, spark, ten, counted):
    folder, calls = counted
    source, model = parquet_source("ten", ten), Counting(folder)
    assert source.process_with_prompt("x", model, "?").save().num_rows == 10 and calls() == 10
    assert source.filter_with_prompt("x", model, "?").save().num_rows == 10 and calls() == 10
    ranked = source.rank_with_prompt("x", model, "?", threshold=4).save()
    assert ranked.num_rows == 10 and ranked.take(3).num_rows == 3 and calls() == 10
    kept = source.filter_with_prompt("x", model, "?").skip(2).reverse()
    assert kept.export_to_dict() == {"x": list(range(9, 1, -1))} and calls() == 10
    judged = source.map({"a": F.lit("a"), "b": F.lit("b")}).judge_pairs("a", "b", model)
    assert judged.sort("x").num_rows == 10 and calls() == 10

    def once(r, out=folder):
        import uuid

        with open(f"{out}/{uuid.uuid4().hex}", "w") as f:
            f.write("x")
        return r["x"] % 2 == 0

    assert source.filter(once).skip(1).reverse().export_to_dict() == {"x": [8, 6, 4, 2]} and calls() == 10


def test_each_row_is_asked_once_and_saved(spark, ten, counted, tmp_path):
    folder, calls = counted
    with Session(spark, str(tmp_path / "out")):
        source = parquet_source("ten", ten)
        s = source.filter_with_prompt("x", Counting(folder), "?").save("kept")
        assert s.num_rows == 10 and s.skip(9).export_to_dict() == {"x": [9]} and calls() == 10
    with Session(spark, str(tmp_path / "out")):
        again = parquet_source("ten", ten).filter_with_prompt("x", Counting(folder), "?").save("kept")
        assert again.num_rows == 10 and again.skip(9).export_to_dict() == {"x": [9]} and calls() == 0


def test_each_text_is_embedded_once(session, ten, counted):
    folder, calls = counted
    embedder = Counting(folder, lambda x: [float(x), 1.0], "array<float>")
    texts = parquet_source("ten", ten).map({"t": F.col("x").cast("string")})
    retriever = texts.retriever("t", embedder)
    got = texts.retrieve("t", retriever, 2).export_to_list()
    assert got[3]["results"]["indices"] == [9, 8] and calls() == 20
    texts.retrieve("t", retriever, 1).save()
    assert calls() == 10


def test_filters_and_columns_reach_the_scan(session, spark, ten):
    step = parquet_source("ten", ten).filter("x > 3").take(3)
    assert step.export_to_dict() == {"x": [4, 5, 6]}
    wide = parquet_source("wide", ten)
    df = wide.filter("x > 3").frame
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(x,3)" in plan.split("PushedFilters: [")[1].split("]")[0] and plan.count("FileScan") == 1


def test_rows_of_several_files_are_in_order(session, spark, tmp_path):
    path = str(tmp_path / "many")
    spark.range(0, 1000, 1, 7).selectExpr("id as x", "'text' as t").write.parquet(path)
    s = parquet_source("many", path, "x")
    assert s.export_to_dict()["x"] == list(range(1000)) and s.skip(990).num_rows == 10
    assert s.filter("x % 100 = 7")[2]["x"] == 207
    assert [r[POS] for r in s.frame.orderBy("x").collect()] == list(range(1000))


def test_force_replaces_answers(spark, tmp_path):
    df, cache = spark.createDataFrame([("a",), ("b",), ("a",)], "p string"), str(tmp_path / "cache")
    run = lambda answer, **o: sorted(r["g"] for r in with_model_memoised(df, "p", "g", Function(answer, name="f"), cache, **o).collect())
    assert run(lambda x: "old") == ["old"] * 3 and run(lambda x: "new") == ["old"] * 3
    assert run(lambda x: "new", force=True) == ["new"] * 3 and run(lambda x: "later") == ["new"] * 3 and run(lambda x: "later", cache_only=True) == ["new"] * 3


def test_judging_is_as_asked_at_any_size(spark, monkeypatch):
    df = spark.range(64).select(F.col("id").alias(POS), F.lit("a").alias("a"), F.lit("b").alias("b"))
    unclear = Expression(lambda p: F.lit("both"))
    judge = lambda df, **o: [r["judgements"] for r in P.judge_pairs(df, "a", "b", unclear, 64, **o).orderBy(POS).collect()]
    assert judge(df) == judge(df.repartition(5)) and judge(df, draws="hash") == judge(df.repartition(5), draws="hash") != judge(df)
    monkeypatch.setattr(P, "BLOCK", 7)
    assert judge(df) == judge(df.repartition(3))
    monkeypatch.setattr(P, "SEQUENCE_ROWS", 10)
    with pytest.raises(ValueError):
        judge(df)
    assert len(judge(df, draws="hash")) == 64
    with pytest.raises(ValueError):
        judge(df, draws="dice")


def test_draws_of_unclear_rows_go_on_over_blocks(spark, monkeypatch):
    """The k-th unclear row takes the k-th draw also where blocks of positions end between them."""
    from random import Random

    monkeypatch.setattr(P, "BLOCK", 4)
    df = spark.range(20).select(F.col("id").alias(POS), F.col("id").cast("string").alias("a"), F.lit("z").alias("b"))
    got = P.judge_pairs(df, "a", "b", Expression(lambda p: F.lit("both")), 20, randomize=False).orderBy(POS).collect()
    r = Random(0)
    assert [x["judgements"] for x in got] == ["Input B" if r.randint(0, 1) == 1 else "Input A" for _ in range(20)]


def test_batch_sizes_are_learned():
    seen = []

    class Tight(Model):
        def run(self, inputs, **options):
            seen.append(len(inputs))
            if sum(map(len, inputs)) > 40:
                raise OutOfMemory
            return [x.upper() for x in inputs]

    sizes, inputs = BatchSizes(20), ["abcd"] * 60 + ["abcdefghij" * 3] * 3
    for rows in batches_by_length(inputs, sizes):
        assert run_batch(Tight(), [inputs[i] for i in rows], {}, sizes=sizes) == [inputs[i].upper() for i in rows]
    assert sizes.of(4) == 10 and sizes.of(30) == 1 and sizes.of(2) == 20
    assert seen.count(20) == 1, "what was too large is not tried again"
    with pytest.raises(OutOfMemory):
        run_batch(Tight(), ["x" * 50], {})


def test_a_model_runs_once_at_a_time(spark):
    model = Function(str.upper)
    model.in_use = True
    from weftline.models import with_model

    with pytest.raises(Exception, match="in use"):
        with_model(spark.createDataFrame([("a",)], "p string"), "p", "g", model).collect()


def test_generators_are_written_in_parts(session, spark):
    held = []

    def rows():
        for i in range(25):
            held.append(i)
            yield {"x": i, "t": None if i < 12 else "t", "n": None}

    df, n = ingest.streamed(spark, ingest.LazyRows(rows), ["x", "t", "n"], held=10)
    got = df.orderBy(POS).collect()
    assert n == 25 and [r["x"] for r in got] == list(range(25)) and got[11]["t"] is None and got[12]["t"] == "t" and got[0]["n"] is None
    with pytest.raises(ingest.StepOutputTypeError):
        ingest.streamed(spark, ingest.LazyRows(lambda: ({"x": i if i < 5 else "five"} for i in range(9))), ["x"], held=5)
    assert ingest.streamed(spark, ingest.LazyRows(lambda: iter([])), ["x"])[1] == 0

    def some():
        yield {"a": 1}
        yield {"a": 2}

    assert data_source("made", some, total_num_rows=2).reverse().export_to_dict() == {"a": [2, 1]}


def test_pickled_values_come_back(session, spark):
    table = ingest.arrow_table({"x": [1, 2], "o": [{"a": complex(1, 2)}["a"], None]}, allow_pickle=True)
    df = ingest.frame(spark, table)
    from weftline.sources import sinks

    assert sinks.to_list(df) == [{"x": 1, "o": complex(1, 2)}, {"x": 2, "o": None}] and sinks.to_dict(df)["o"] == [complex(1, 2), None]


def test_only_composite_steps_make_steps(session):
    def setup(self):
        self.register_input("x")
        self.register_output("x")

    run = lambda self: self.inputs["x"].step.map({"x": F.col("x") + 1}).select_columns("x")
    plain, composite = type("Plain", (CustomStep,), {"setup": setup, "run": run}), type("Whole", (CompositeStep,), {"setup": setup, "run": run})
    x = data_source("a", {"x": [1, 2]})["x"]
    with pytest.raises(RuntimeError, match="CompositeStep"):
        plain("plain", {"x": x})
    made = composite("whole", {"x": x})
    assert made.output.export_to_dict() == {"x": [2, 3]} and any(n.startswith("whole / ") for n in session.steps)
    assert list(x) == [1, 2] and x[1] == 2


def test_changed_files_are_noticed(spark, tmp_path):
    (tmp_path / "a.txt").write_text("one")
    before = files_state(spark, [str(tmp_path)])
    (tmp_path / "a.txt").write_text("three")
    assert before != files_state(spark, [f"file://{tmp_path}"]) and len(before) == 1 and files_state(spark, [str(tmp_path / "none")]) == []


def test_files_by_path(spark, tmp_path):
    at, path = Files(spark), f"file://{tmp_path}/f"
    at.write(f"{path}/x", "é\n")
    assert at.read(f"{path}/x") == "é\n" and at.exists(path) and at.names(path) == ["x"]
    at.move(f"{path}/x", f"{path}/deep/y")
    assert not at.exists(f"{path}/x") and at.read(f"{tmp_path}/f/deep/y") == "é\n"
    at.delete(path)
    assert not at.exists(path) and at.names(path) == []


def test_hub_splits(session, tmp_path):
    s = data_source("a", {"x": list(range(10))})
    folder = s.export_for_hub(str(tmp_path / "hub"), train_size=0.8, test_size=0.2)
    with pytest.raises(ValueError, match="splits"):
        hub_source("none", folder)
    assert hub_source("test", folder, split="test").export_to_dict() == {"x": [8, 9]}


def test_retrieval_leaves_null_texts_out(spark):
    texts = spark.createDataFrame([(None, 0), ("b", 1)], f"t string, {POS} bigint")
    embedder = Expression(lambda c: F.array(F.length(c).cast("float")))
    got = Retriever(texts, "t", embedder).retrieve(texts, "t", 2).orderBy(POS).collect()
    assert got[0]["results"]["indices"] == [] and got[1]["results"]["texts"] == ["b"]


def test_inputs_that_leave_no_room(spark):
    from weftline.models import with_model

    df = spark.createDataFrame([("a b c",), ("a b c d e",)], "p string")
    for model in (Function(str.upper), Expression(lambda c: F.upper(c))):
        model.max_length = 6
        assert sorted(r["g"] for r in with_model(df, "p", "g", model, check_length=True).collect()) == ["A B C", "A B C D E"]
        with pytest.raises(Exception, match="longer|more tokens"):
            P.generated(df, "p", model, max_new_tokens=2).collect()
        assert sorted(r["generations"] for r in P.generated(df, "p", model, max_new_tokens=2, truncate=True).collect()) == ["A B C", "A B C D"]


def test_windows_are_shuffled(session):
    s = data_source("a", {"x": list(range(23))}).shuffle(seed=1, buffer_size=5)
    got = s.export_to_dict()["x"]
    assert got != sorted(got) and [sorted(got[i : i + 5]) for i in range(0, 23, 5)] == [list(range(i, min(i + 5, 23))) for i in range(0, 23, 5)]
    assert s.num_rows == 23 and data_source("a", {"x": []}, columns=["x"]).shuffle(buffer_size=5).export_to_dict() == {"x": []}


def test_steps_are_saved_as_they_are_made(spark, ten, counted, tmp_path):
    folder, calls = counted
    for n in (10, 0):
        with Session(spark, str(tmp_path / "out"), saves=True):
            s = parquet_source("ten", ten).process_with_prompt("x", Counting(folder), "?")
            assert s.saved and s.num_rows == 10 and s.preview()["x"] == [0, 1, 2] and s.take(2).num_rows == 2 and calls() == n
