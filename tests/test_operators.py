import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import combine, order, rows
from weftline.position import POS, densified, with_order_of
from weftline.sources.sinks import to_dict, to_list


def frame(spark, values, schema="out1 bigint", parts=1):
    data = [(*(v if isinstance(v, tuple) else (v,)), i) for i, v in enumerate(values)]
    return spark.createDataFrame(data, f"{schema}, {POS} bigint").repartition(parts)


def values(df, column="out1"):
    return to_dict(df)[column]


@pytest.mark.parametrize("parts", [1, 7])
def test_order_operators_whatever_the_partitions(spark, parts):
    df = frame(spark, range(10), parts=parts)
    assert values(order.take(df, 3)) == [0, 1, 2]
    assert values(order.take(df, 99)) == list(range(10))
    assert values(order.skip(df, 8)) == [8, 9]
    assert values(order.skip(df, 99)) == []
    assert values(order.select(df, [7, 3, 7, 0])) == [7, 3, 7, 0]
    assert values(order.select(df, range(4, 7))) == [4, 5, 6]
    assert values(order.reverse(order.reverse(df, 10), 10)) == list(range(10))
    assert values(order.shard(df, 4, 1)) == [1, 5, 9]
    assert [values(order.shard(df, 4, i, True, 10)) for i in range(4)] == [[0, 1, 2], [3, 4, 5], [6, 7], [8, 9]]
    assert sorted(values(order.shuffle(df, 3))) == list(range(10))
    assert values(order.shuffle_exact(frame(spark, [1, 2, 3], parts=parts), 3, 42)) == [3, 2, 1]
    assert values(densified(df.filter("out1 % 3 = 0").withColumn(POS, F.col(POS) * 1_000_003))) == [0, 3, 6, 9]


def test_bad_arguments(spark):
    df = frame(spark, range(3))
    for f in (lambda: order.take(df, -1), lambda: order.skip(df, -1), lambda: order.shard(df, 2, 2), lambda: combine.concat()):
        with pytest.raises(ValueError):
            f()
    with pytest.raises(IndexError):
        order.select(df, [-1])
    with pytest.raises(AssertionError):
        rows.select_columns(df, ["none"])
    with pytest.raises(ValueError):
        rows.rename_columns(frame(spark, [(1, 2)], "a bigint, b bigint"), {"a": "b"})


def test_sort_is_stable_with_nulls_and_nan_at_the_end(spark):
    nan = float("nan")
    data = [(2.0, "a"), (None, "b"), (nan, "c"), (1.0, "d"), (2.0, "e"), (None, "f")]
    df = frame(spark, data, "x double, y string", 3)
    assert values(order.sort(df, "x"), "y") == list("daecbf")
    assert values(order.sort(df, "x", reverse=True), "y") == list("aedcbf")
    assert values(order.sort(df, "x", null_placement="at_start"), "y") == list("bfcdae")
    assert values(order.top(df, "x", 2, reverse=True), "y") == ["a", "e"]
    assert "TakeOrderedAndProject" in order.top(df, "x", 2)._jdf.queryExecution().executedPlan().toString()


def test_sort_of_empty_and_equal_rows(spark):
    assert values(order.sort(frame(spark, []), "out1")) == []
    assert values(order.sort(frame(spark, [5] * 9, parts=3), "out1")) == [5] * 9


def test_split_sizes():
    assert order.split_sizes(10, 0.7, 0.1, 0.2) == {"train": 7, "validation": 1, "test": 2}
    assert order.split_sizes(100, 0.7, 0.1, 0.2) == {"train": 70, "validation": 10, "test": 20}
    assert order.split_sizes(10) == {"train": 10}
    assert order.split_sizes(10, 6, 0, 4) == {"train": 6, "test": 4}
    for sizes in ((0.5, 0.1), (3, 4)):
        with pytest.raises(ValueError):
            order.split_sizes(10, *sizes)
    rng = random.Random(1)
    for _ in range(200):
        a = rng.randint(1, 8) / 10
        b = rng.randint(1, int(10 * (1 - a))) / 10 if a < 0.9 else 0.0
        c = round(1 - a - b, 1)
        n = rng.randint(3, 5000)
        assert sum(order.split_sizes(n, a, b, c).values()) == n


def test_stratified_keeps_shares(spark):
    df = frame(spark, [(i, "ab"[i % 2] if i < 90 else None) for i in range(100)], "n bigint, label string", 3)
    got = order.stratified(df, "label", 0.8, 0.0, 0.2).groupBy("label", "split").count().collect()
    assert {(r["label"], r["split"]): r["count"] for r in got} == {("a", "train"): 36, ("a", "test"): 9, ("b", "train"): 36, ("b", "test"): 9, (None, "train"): 8, (None, "test"): 2}


def test_concat_and_zips(spark):
    a, b = frame(spark, [1, 2, 3]), frame(spark, list("abcd"), "out2 string")
    assert to_list(combine.concat(a, frame(spark, ["x"], "out2 string"))) == [{"out1": i, "out2": None} for i in (1, 2, 3)] + [{"out1": None, "out2": "x"}]
    assert values(combine.zipped_padded(a, b)) == [1, 2, 3, None]
    assert to_dict(combine.zipped_shortest(a, b)) == {"out1": [1, 2, 3], "out2": ["a", "b", "c"]}
    with pytest.raises(Exception, match="different numbers"):
        to_dict(combine.zipped_strict(a, b))
    with pytest.raises(ValueError):
        combine.zipped_padded(a, a)
    assert values(combine.zipped_shortest(a, frame(spark, [9, 8, 7]))) == [9, 8, 7]
    assert values(combine.add_item(a, {"out1": None}, 3)) == [1, 2, 3, None]
    with pytest.raises(ValueError):
        combine.add_item(a, {"none": 1}, 3)
    whole = combine.concat(a, frame(spark, [4, 5]))
    assert values(order.take(densified(whole), 3)) == [1, 2, 3] and values(order.skip(densified(whole), 3)) == [4, 5]


def test_join_renames_clashing_columns(spark):
    a, b = frame(spark, [(1, "x")], "k bigint, v string"), frame(spark, [(1, "y")], "k bigint, v string")
    assert to_list(combine.joined(a, b, "k")) == [{"k": 1, "v": "x", "v_right": "y"}]


def test_python_functions(spark):
    df = frame(spark, [1, 2, 3], parts=2)
    assert values(rows.map_rows(df, lambda r: {"out1": r["out1"] * 2}, "out1 bigint")) == [2, 4, 6]
    assert values(rows.map_rows(df, lambda r, i: {"out1": i}, "out1 bigint", with_indices=True)) == [0, 1, 2]
    assert values(rows.map_rows(df, lambda b: {"out1": [x + 1 for x in b["out1"]]}, "out1 bigint", batched=True, batch_size=2)) == [2, 3, 4]
    assert values(rows.filter_rows(df, lambda r: r["out1"] in (1, 3))) == [1, 3]
    assert values(rows.filter_rows(df, lambda r, i: i == 1, with_indices=True)) == [2]
    empty = rows.filter_rows(df, lambda r: False)
    assert values(empty) == [] and empty.schema == df.schema
    two = frame(spark, [(1, 5), (2, 6)], "a bigint, b bigint")
    assert values(rows.map_rows(two, lambda a, b: {"c": a + b}, "c bigint", input_columns=["a", "b"]), "c") == [6, 8]
    with pytest.raises(Exception, match="returned 0 rows"):
        to_dict(rows.map_rows(two, lambda b: {"c": []}, "c bigint", batched=True))


def test_expressions_stay_out_of_python(spark):
    df = frame(spark, range(5))
    plan = rows.map_columns(order.take_dense(df, 3).filter("out1 > 0"), {"n": F.col("out1") * 2})._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


def test_order_of_a_key(spark):
    df = spark.range(1000).select((F.lit(1000) - F.col("id")).alias("k")).repartition(7)
    assert [r["k"] for r in with_order_of(df, "k").orderBy(POS).collect()] == list(range(1, 1001))


def test_product_and_gather(spark):
    assert [r.asDict() for r in combine.attribute_product(spark, {"a": ["x", "y"], "b": ["1", "2"]}).orderBy("combination").collect()] == [
        {"combination": i, "a": a, "b": b} for i, (a, b) in enumerate([("x", "1"), ("x", "2"), ("y", "1"), ("y", "2")])
    ]
    df = spark.createDataFrame([([2, 0], 0), ([], 1), ([9], 2)], f"i array<bigint>, {POS} bigint")
    examples = frame(spark, list("abc"), "v string")
    assert values(combine.gathered(df, "i", examples, "v", "got"), "got") == [["c", "a"], [], []]
