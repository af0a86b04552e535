import json
import os
from datetime import datetime

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from weftline import ingest
from weftline.models import Dictionary, Expression, Function
from weftline.session import Session, concurrent
from weftline.step import ColumnRef, CustomStep, Step, concat, csv_source, data_source, json_source, parquet_source, text_source, zipped


def numbers(name="numbers", values=(1, 2, 3)):
    return data_source(name, {"out1": list(values)})


@pytest.mark.parametrize(
    "value, names, expected",
    [
        (None, ["a"], {"a": []}),
        ({"a": [1, 2]}, ["a"], {"a": [1, 2]}),
        ({"a": 1, "b": 2}, ["a", "b"], {"a": [1], "b": [2]}),
        ([{"a": 1}, {"a": 2}], ["a"], {"a": [1, 2]}),
        ([(1, 2), (3, 4)], ["a", "b"], {"a": [1, 3], "b": [2, 4]}),
        (([1, 2], [3, 4]), ["a", "b"], {"a": [1, 2], "b": [3, 4]}),
        ([[1, 2], [3, 4]], ["a", "b"], {"a": [1, 2], "b": [3, 4]}),
        ([1, 2], ["a"], {"a": [1, 2]}),
        (5, ["a"], {"a": [5]}),
        (iter([1, 2]), ["a"], {"a": [1, 2]}),
        (ingest.LazyRows(lambda: iter([{"a": 1}, {"a": 2}])), ["a"], {"a": [1, 2]}),
        (ingest.LazyRowBatches(lambda: iter([{"a": [1, 2]}, {"a": [3]}])), ["a"], {"a": [1, 2, 3]}),
        (ingest.LazyRowBatches(lambda: iter([([1, 2], [3, 4])])), ["a", "b"], {"a": [1, 2], "b": [3, 4]}),
    ],
)
def test_returned_values(value, names, expected):
    assert ingest.normalised(value, names) == expected


@pytest.mark.parametrize("value, names", [({"b": [1]}, ["a"]), ((1, 2, 3), ["a", "b"]), ([{"b": 1, "c": 2}], ["a", "b"]), ([1, 2], ["a", "b"]), (lambda: None, ["a"])])
def test_returned_values_that_fit_nothing(value, names):
    with pytest.raises(ingest.StepOutputError):
        ingest.normalised(value, names)


def test_types():
    assert ingest.column([1, None]).type == pa.int64()
    assert ingest.column([1, 2.5]).to_pylist() == [1.0, 2.5]
    assert ingest.column([{"a": 1}, {"b": "x"}]).to_pylist() == [{"a": 1, "b": None}, {"a": None, "b": "x"}]
    assert ingest.column([{1, 2}, [3]]).to_pylist() == [[1, 2], [3]]
    assert ingest.column([datetime(2030, 1, 1)]).type == pa.timestamp("us")
    for bad in ([1, "a"], [1, [2]], [{"a": 1}, 2], [object()]):
        with pytest.raises(ingest.StepOutputTypeError):
            ingest.column(bad)
    assert ingest.unpickled(ingest.column([object], allow_pickle=True)[0].as_py()) is object


def test_chain(session):
    s = numbers(values=range(20)).filter(F.col("out1") % 2 == 0).map({"twice": F.col("out1") * 2}).reverse().skip(1).take(3)
    assert s.export_to_dict() == {"out1": [16, 14, 12], "twice": [32, 28, 24]}
    assert s[0] == {"out1": 16, "twice": 32} and s["out1"][1] == 14 and list(s["twice"]) == [32, 28, 24] and s[1:] == s.export_to_list()[1:]
    assert isinstance(s["out1"], ColumnRef)
    with pytest.raises(KeyError):
        s["none"]
    with pytest.raises(IndexError):
        s[99]


def test_names_fingerprints_and_cards(session):
    a, b = numbers(), numbers()
    assert (a.name, b.name) == ("numbers", "numbers #2") and a.fingerprint == b.fingerprint
    assert a.take(2).fingerprint != a.take(3).fingerprint and a.take(2).fingerprint == b.take(2).fingerprint
    k = 2
    f1, f2 = a.map(lambda r: {"x": r["out1"] * k}, "x bigint"), a.map(lambda r: {"x": r["out1"] * k}, "x bigint")
    assert f1.fingerprint == f2.fingerprint
    k = 3
    assert a.map(lambda r: {"x": r["out1"] * k}, "x bigint").fingerprint != f1.fingerprint
    a.register_data_card("License Information", "mit")
    assert a.take(1).reverse().data_card() == {"numbers": {"License Information": ["mit"]}}
    with pytest.raises(ValueError):
        a.register_data_card("Colour", "red")
    assert "numbers" in repr(a)


def test_combined_steps(session):
    a, b = numbers(), data_source("letters", {"out2": list("abcd")})
    assert zipped(a, b).export_to_dict() == {"out1": [1, 2, 3, None], "out2": list("abcd")}
    assert zipped(a, b).declared_rows == 4 and concat(a, a).declared_rows == 6
    with pytest.raises(ValueError):
        zipped(a, b, lazy=False)
    with pytest.raises(TypeError):
        concat(a, 5)
    with pytest.raises(ValueError):
        concat()
    assert {k: v.export_to_dict()["out1"] for k, v in numbers(values=range(10)).splits(0.7, 0.1, 0.2).items()} == {"train": list(range(7)), "validation": [7], "test": [8, 9]}
    assert a.add_item({"out1": 9}).export_to_dict() == {"out1": [1, 2, 3, 9]}
    assert a.head(2)["out1"].tolist() == [1, 2]
    assert a.sql("select out1 * 10 as x, __pos from {step}").export_to_dict() == {"x": [10, 20, 30]}
    assert concurrent(lambda: a.num_rows, lambda: b.num_rows) == [3, 4]


def test_resume_back_up_and_restore(spark, tmp_path):
    folder = str(tmp_path / "out")
    runs = []

    def build(columns):
        with Session(spark, folder):
            s = data_source("made", {columns: ["a", "b"]}).save()
            runs.append(os.stat(os.path.join(folder, "made", "step.json")).st_mtime_ns)
            return s.export_to_dict()

    assert build("out1") == {"out1": ["a", "b"]}
    assert build("out1") == {"out1": ["a", "b"]} and runs[0] == runs[1]
    assert build("out2") == {"out2": ["a", "b"]} and runs[2] != runs[1]
    assert build("out1") == {"out1": ["a", "b"]} and runs[3] == runs[0]
    with Session(spark, folder), pytest.raises(RuntimeError):
        Session(spark).__enter__()


def test_files(session, tmp_path):
    s = numbers(values=range(1, 11))
    assert s.export_to_json(str(tmp_path / "x.json"), 0.7, 0.1, 0.2) == {k: str(tmp_path / f"x.{v}.json") for k, v in (("train", "train"), ("validation", "val"), ("test", "test"))}
    path = s.export_to_csv(str(tmp_path / "x.csv"), sep="|")
    assert csv_source("csv", data_files=path, sep="|").export_to_dict() == {"out1": list(range(1, 11))}
    path = s.export_to_json(str(tmp_path / "y.json"))
    assert [json.loads(line) for line in open(path)] == [{"out1": i} for i in range(1, 11)]
    assert json_source("json", data_files=path).export_to_dict() == {"out1": list(range(1, 11))}
    (tmp_path / "t.txt").write_text("a\nb\n\nc")
    assert text_source("text", data_files=str(tmp_path / "t.txt")).export_to_dict() == {"text": ["a", "b", "", "c"]}
    s.export_to_dataset(str(tmp_path / "set"), num_shards=3)
    assert parquet_source("parquet", str(tmp_path / "set")).export_to_dict() == {"out1": list(range(1, 11))}
    many = tmp_path / "many"
    many.mkdir()
    for i, n in enumerate((50, 3, 2000)):
        (many / f"{i}.txt").write_text("\n".join(f"{i}-{j}" for j in range(n)))
    assert text_source("many", str(many)).export_to_dict()["text"] == [f"{i}-{j}" for i, n in enumerate((50, 3, 2000)) for j in range(n)]
    with pytest.raises(ValueError):
        csv_source("bad", data_files={"train": "x"})


def test_custom_step(session):
    class Double(CustomStep):
        def setup(self):
            self.register_input("x")
            self.register_arg("by", required=False, default=2)
            self.register_output("y")
            self.register_data_card("License Information", "mit")

        def run(self):
            return {"y": [v * self.args["by"] for v in self.inputs["x"]]}

    step = Double("double", {"x": numbers()["out1"]}, {"by": 3}, {"y": "z"}).output
    assert step.export_to_dict() == {"z": [3, 6, 9]} and step.data_card() == {"double": {"License Information": ["mit"]}}
    assert Double.help() == "Double(inputs: x; args: by=2; outputs: y)"
    with pytest.raises(ValueError):
        Double("no input")
    with pytest.raises(TypeError):
        type("Bad", (CustomStep,), {"__init__": lambda self: None})


def test_model_steps(session):
    s = data_source("words", {"x": [3, 4], "y": ["a", "b"]})
    answers = Dictionary({f"Input: {i}\n\nInstruction: Add one to the input.": str(i + 1) for i in (3, 4)})
    assert s.process_with_prompt("x", answers, "Add one to the input.").export_to_dict()["generations"] == ["4", "5"]
    yes = Expression(lambda p: F.when(p.contains("Input: 4"), "Yes!").otherwise("No!"))
    assert s.filter_with_prompt("x", yes, "Keep it?").export_to_list() == [{"x": 4, "y": "b"}]
    words = data_source("jokes", {"w": ["a", "b", "c"]})
    said = Function(lambda p: {"a": "Not funny, 0", "b": "Medium: 5", "c": "I would say, 10!"}[p[7]])
    ranked = words.rank_with_prompt("w", said, "How funny?", threshold=4)
    assert ranked.export_to_dict() == {"w": ["c", "b"], "scores": [10.0, 5.0]}
    pairs = data_source("pairs", {"a": ["good", "bad", "good"], "b": ["bad", "good", "bad"]})
    judge = Function(lambda p: "Input A" if "Input A: good" in p else "Input B")
    judged = pairs.judge_pairs("a", "b", judge)
    assert judged.export_to_dict()["judgements"] == ["Input A", "Input B", "Input A"]
    assert ["Input A: bad" in p for p in judged.export_to_dict()["judge_prompts"]] == [False, True, True]


def test_streams_have_no_steps(session, spark):
    stream = spark.readStream.format("rate").load().withColumn("__pos", F.col("value"))
    with pytest.raises(ValueError):
        Step("stream", stream)


def test_hub_folder_and_cards(session, tmp_path):
    from weftline.functions.cards import citations, licences
    from weftline.step import hub_source

    assert licences("---\nlicense:\n- mit\n- cc0-1.0\nlanguage: en\n---\n# X") == ["mit", "cc0-1.0"] and licences("---\nlicense: mit\n---") == ["mit"] and licences("# X") == []
    assert citations("x @article{a, title={B {C}}} y @book{open") == ["@article{a, title={B {C}}}"]
    s = numbers(values=range(10))
    s.register_data_card("License Information", "mit")
    folder = s.export_for_hub(str(tmp_path / "hub"), synthetic=True)
    again = hub_source("again", folder)
    assert again.export_to_dict() == {"out1": list(range(10))} and again.data_card()["again"]["License Information"] == ["mit"]
    assert "n<1K" in (tmp_path / "hub" / "README.md").read_text()


def test_background_and_progress(session):
    s = numbers(values=range(10)).map({"x": F.col("out1") + 1})
    assert s.save_in_background().result(60).saved
    same, seen = s.observed()
    same.frame.write.format("noop").mode("overwrite").save()
    assert seen.get["rows"] == 10 and same.columns == ["out1", "x"]


def test_chat_templates(session):
    from weftline.functions.chat_templates import TEMPLATES, template_for

    assert template_for("x/Llama-2-7b-chat-hf") == TEMPLATES["llama2"] and template_for("own") == TEMPLATES["plain"]
    assert template_for("x/CodeLlama-7b-Instruct-hf") == TEMPLATES["mistral"] and template_for("stablelm-zephyr-3b") == TEMPLATES["tulu"]
    assert template_for("my-own-model", {"own": "<{{prompt}}>"}) == "<{{prompt}}>" and all("{{prompt}}" in t for t in TEMPLATES.values())
