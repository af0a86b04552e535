"""Near-duplicates and overlaps of splits against brute force over all pairs."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from weftline.llm import near_duplicates as N
from weftline.llm import shared, split_overlap

WORDS = [f"w{i}" for i in range(400)]


def likeness(x, y):
    v, w = (re.findall(r"[^\W_]+", t.lower()) for t in (x, y))
    if len(v) < 20 or len(w) < 20:
        return 0.0
    s, t = set(zip(v, v[1:])), set(zip(w, w[1:]))
    return len(s & t) / len(s | t)


def edited(words, rng, share):
    out = []
    for w in words:
        r = rng.random()
        if r < share / 3:
            continue
        out.append(rng.choice(WORDS) if r < 2 * share / 3 else w)
        if r > 1 - share / 3:
            out.append(rng.choice(WORDS))
    return out


def corpus(seed=1, families=60):
    rng = random.Random(seed)
    texts = []
    for _ in range(families):
        base = rng.choices(WORDS, k=rng.randint(18, 160))
        texts += [" ".join(edited(base, rng, rng.choice((0.0, 0.05, 0.15, 0.3, 0.4)))) for _ in range(rng.randint(1, 6))]
    # copies, orders, empty, null, very long, all the same word
    long = " ".join(rng.choices(WORDS, k=700))
    texts += [texts[0], texts[0].upper(), None, "", "   ", "one", long, long + " more", " ".join(["same"] * 30), " ".join(["same"] * 40)]
    return texts


def rows(texts, parts=1):
    return [(p, i + 1000 * p, t) for p in range(parts) for i, t in enumerate(texts)]


def brute(texts):
    some = [(i, t) for i, t in enumerate(texts) if t]
    return {(i, j) for (i, x), (j, y) in itertools.combinations(some, 2) if likeness(x, y) >= 0.5}


@pytest.mark.parametrize("region", [8000, 3])
def test_near_duplicates_are_those_of_brute_force(spark, monkeypatch, region):
    """Also with regions so small that they are divided again and laid out as grids."""
    texts = corpus()
    code = N.regions.__code__
    monkeypatch.setattr(N, "REGION", region)
    assert N.regions.__code__ is code
    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(N)
    try:
        df = spark.createDataFrame(rows(texts, 2) + rows(texts)[:20], "part byte, id long, text string").repartition(3)
        got = {(r["part"], r["id_a"] - 1000 * r["part"], r["id_b"] - 1000 * r["part"]) for r in N.near_duplicates(df).collect()}
        out = N.near_duplicates(df)
        assert out.count() == len(got)
    finally:
        cloudpickle.unregister_pickle_by_value(N)
    want = brute(texts)
    assert len(want) > 60
    assert got == {(p, a, b) for p in (0, 1) for a, b in want}


def test_texts_of_one_and_two_word_pairs_in_large_regions(spark, monkeypatch):
    """A text of one repeated word and one with a second pair have likeness 0.5, also where their only common pair is frequent."""
    texts = [" ".join(["same"] * 30), *(" ".join(["same"] * 30 + [f"end{i}"]) for i in range(9)), " ".join(["same"] * 9 + ["other"] * 20), " ".join(WORDS[:30])]
    monkeypatch.setattr(N, "REGION", 3)
    cloudpickle.register_pickle_by_value(N)
    try:
        df = spark.createDataFrame(rows(texts), "part byte, id long, text string").repartition(3)
        got = {(r["id_a"], r["id_b"]) for r in N.near_duplicates(df).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(N)
    assert got == brute(texts) == {(0, i) for i in range(1, 10)}


def test_no_rows(spark):
    empty = spark.createDataFrame([], "part byte, id long, text string")
    assert N.near_duplicates(empty).count() == 0
    assert N.near_duplicates(spark.createDataFrame([(0, 1, None), (0, 2, "")], "part byte, id long, text string")).count() == 0
    assert split_overlap.overlaps(spark.createDataFrame([], "part byte, id long, trains boolean, text string")).count() == 0


def test_extra_columns_are_ignored(spark):
    text = " ".join(WORDS[:30])
    df = spark.createDataFrame([(0, 1, text, 5, "x"), (0, 2, text + " end", None, None)], "part byte, id long, text string, k int, pivot string")
    assert [tuple(r) for r in N.near_duplicates(df).collect()] == [(0, 1, 2)]


def test_overlaps_are_those_of_brute_force(spark):
    texts = corpus(3, 80)
    rng = random.Random(5)
    role = [rng.choice((True, True, True, False, None)) for _ in texts]
    df = spark.createDataFrame([(1, i, r, t) for i, (t, r) in enumerate(zip(texts, role))], "part byte, id long, trains boolean, text string").repartition(3)
    got = {(r["train_id"], r["test_id"]) for r in split_overlap.overlaps(df).collect()}
    want = {(a, b) if role[a] else (b, a) for a, b in brute(texts) if None not in (role[a], role[b]) and role[a] != role[b]}
    assert len(want) > 20 and got <= want
    strong = {(a, b) for a, b in want if likeness(texts[a], texts[b]) >= 0.6}
    assert strong <= got and len(got) >= 0.95 * len(want)


@pytest.mark.parametrize("region", [8000, 30])
def test_versions_of_one_prompt_among_a_third_of_all_texts(spark, monkeypatch, region):
    """Their shared word pairs are the most frequent ones and count all the same."""
    rng = random.Random(8)
    base = rng.choices(WORDS, k=100)
    texts = []
    for i in range(450):
        words = list(base) if i % 3 == 0 else rng.choices(WORDS, k=40)
        for at in rng.sample(range(100), 6) if i % 3 == 0 else ():
            words[at] = f"v{i}x{at}"
        texts.append(" ".join(words))
    df = spark.createDataFrame([(0, i, i % 2 == 0, t) for i, t in enumerate(texts)], "part byte, id long, trains boolean, text string").repartition(3)
    monkeypatch.setattr(N, "REGION", region)
    cloudpickle.register_pickle_by_value(N)
    try:
        got = {(r["train_id"], r["test_id"]) for r in split_overlap.overlaps(df).collect()}
    finally:
        cloudpickle.unregister_pickle_by_value(N)
    want = {(a, b) if a % 2 == 0 else (b, a) for a, b in brute(texts) if a % 2 != b % 2}
    assert len(want) > 5000 and got == want


def test_fingerprints_never_differ_more_than_the_sets():
    words = shared.Words()
    texts = [t for t in corpus() if t]
    b = shared.Bigrams(*words.of(texts))
    flat, width = N.parities(b)
    folded = N.narrowed(flat, width)
    sets = [set(b.pair[b.doc == i]) for i in range(len(texts))]
    for i, j in itertools.combinations(range(0, len(texts), 3), 2):
        w = min(width[i], width[j])
        assert int(np.bitwise_count(folded[w][i] ^ folded[w][j]).sum()) <= len(sets[i] ^ sets[j])


@pytest.mark.parametrize("copies", [2000, 6])
def test_a_third_of_all_rows_are_copies(spark, monkeypatch, copies):
    """Also where a class is dealt to several tasks."""
    text = " ".join(WORDS[:40])
    other = [" ".join(random.Random(i).choices(WORDS, k=40)) for i in range(40)]
    rows = [(0, i, text if i < 20 else text + " end" if i < 25 else other[i - 25]) for i in range(60)]
    df = spark.createDataFrame(rows, "part byte, id long, text string").repartition(5)
    monkeypatch.setattr(N, "COPIES", copies)
    got = [(r["id_a"], r["id_b"]) for r in N.near_duplicates(df).collect()]
    assert sorted(got) == [(i, j) for i in range(25) for j in range(i + 1, 25)]
    links = {r["id"]: (r["class"], r["n_copies"], r["n_links"]) for r in N.linked(df).collect()}
    assert links == {i: (0, 20, 24) if i < 20 else (20, 5, 24) if i < 25 else (i, 1, 0) for i in range(60)}
    trains = df.withColumn("trains", F.col("id") % 2 == 0)
    assert split_overlap.overlaps(trains).count() == 13 * 12


def test_filters_of_any_length(spark, monkeypatch):
    """A filter that is full lets all texts pass and loses none."""
    monkeypatch.setattr(shared, "LEAST_BITS", 3)
    monkeypatch.setattr(shared, "MOST_BITS", 4)
    texts = corpus(7, 20)
    df = spark.createDataFrame(rows(texts), "part byte, id long, text string").repartition(3)
    assert {(r["id_a"], r["id_b"]) for r in N.near_duplicates(df).collect()} == brute(texts)
