"""Encoding, packing, truncation, defects and abuse on small fixtures."""

import functools
import itertools
import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.llm import abuse, broken_pairs, byte_bpe, packing, refusals, truncation

ENCODER = byte_bpe.Encoder.load()


@functools.cache
def reference():
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(os.path.join(byte_bpe.folder(), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("abcdeIT éñß日本 \n\t\x1c​😀 123,.'s!?<|>")), max_size=80))
def test_encoding_is_that_of_the_vocabulary(text):
    assert ENCODER.encode(text) == reference()(text)
    assert ENCODER.decode(ENCODER.encode(text)) == text


def test_hard_pieces():
    want = reference()
    for text in ("a" * 3000, "ab" * 2000, " " * 500, "é" * 700, "=" * 1000, "<|endoftext|>", "don't we'll I'M", "\u0000\u0001", "x" * 63 + "y" * 70):
        assert ENCODER.encode(text) == want(text)
        assert ENCODER.decode(ENCODER.encode(text)) == text


def test_ascii_pattern():
    assert byte_bpe.ascii_pattern(r" ?\p{L}+|[^\s\p{L}\p{N}]+") == r" ?[a-zA-Z]+|[^\sa-zA-Z0-9]+"
    assert byte_bpe.ascii_pattern(r"\p{Lu}+") is None


def test_encoded_frames(spark):
    df = spark.createDataFrame([(1, "Hello world", 7), (2, None, 8), (3, "", 9), (3, "", 9)], "doc_id long, text string, ids int")
    got = byte_bpe.encode_texts(df)
    assert got.schema["ids"].dataType.simpleString() == "array<int>"
    rows = sorted((r["doc_id"], list(r["ids"])) for r in got.collect())
    assert rows == [(1, ENCODER.encode("Hello world")), (2, []), (3, []), (3, [])]
    assert [r["text"] for r in byte_bpe.decode_ids(got).orderBy("doc_id").collect()] == ["Hello world", "", "", ""]
    assert [r["n_tokens"] for r in byte_bpe.token_counts(df).orderBy("doc_id").collect()] == [2, 0, 0, 0]
    assert byte_bpe.encode_texts(df.limit(0)).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_hold_all_items_and_no_container_too_much(seed):
    rng = random.Random(seed)
    capacity = rng.choice((10, 64, 200))
    sizes = sorted(rng.sample(range(1, capacity + 1), rng.randint(1, min(capacity, 40))))
    counts = [rng.randint(1, 500) for _ in sizes]
    solution = packing.plan(np.array(sizes), np.array(counts), capacity)
    held = dict.fromkeys(sizes, 0)
    for pattern, n in solution:
        assert n > 0 and sum(s * k for s, k in pattern) <= capacity
        for s, k in pattern:
            held[s] += k * n
    assert held == dict(zip(sizes, counts))
    least = -(-sum(s * c for s, c in zip(sizes, counts)) // capacity)
    greedy = sum(n for _, n in packing.largest_first(np.array(sizes), np.array(counts), capacity))
    assert least <= sum(n for _, n in solution) <= greedy


def test_the_program_beats_the_greedy_way():
    """Thirds that only fit with the right partners."""
    sizes, counts = np.array([34, 35, 31, 65, 66, 69]), np.array([100] * 6)
    assert sum(n for _, n in packing.plan(sizes, counts, 100)) == 300


def test_packed_documents(spark):
    rng = random.Random(2)
    rows = [(i, rng.choice((3, 3, 3, 5, 17, 40, 0, 230))) for i in range(300)] + [(900, None), (901, -4)]
    df = spark.createDataFrame(rows, "doc_id long, n_tokens long")
    got = packing.packed(df, [("small", 50), ("large", 1000)]).collect()
    for model, capacity in (("small", 50), ("large", 1000)):
        parts = [r for r in got if r["model_name"] == model]
        used = {}
        for r in parts:
            used[r["container"]] = used.get(r["container"], 0) + r["n_tokens"]
        assert max(used.values()) <= capacity
        for i, n in rows:
            own = sorted((r["first_token"], r["n_tokens"]) for r in parts if r["doc_id"] == i)
            assert sum(k for _, k in own) == max(n or 0, 0) and own[0][0] == 0
            assert len(own) == max(1, -(-max(n or 0, 0) // capacity))
        least = -(-sum(max(n or 0, 0) for _, n in rows) // capacity)
        assert len([c for c in used if used[c]]) <= least * 1.08 + 1
    assert packing.packed(df.limit(0), [("small", 50)]).count() == 0 and packing.packed(df, []).count() == 0


def test_the_best_pattern_of_bounded_sizes():
    rng = random.Random(9)
    for _ in range(40):
        capacity, sizes = rng.randint(5, 40), np.array(sorted(rng.sample(range(1, 30), rng.randint(1, 4))))
        values, most = np.array([rng.random() for _ in sizes]), np.array([rng.randint(1, 7) for _ in sizes])
        got = packing.best_pattern(sizes, values, most, capacity)
        assert sum(n * sizes[i] for i, n in got.items()) <= capacity and all(n <= most[i] for i, n in got.items())
        best = max(sum(n * v for n, v in zip(c, values)) for c in itertools.product(*(range(m + 1) for m in most)) if sum(n * s for n, s in zip(c, sizes)) <= capacity)
        assert abs(sum(n * values[i] for i, n in got.items()) - best) < 1e-9


def test_many_models_and_a_large_capacity(spark):
    """No container of any of 20 models is too full, nor one of 2 ** 21 tokens beside a model of the next number."""
    rng = random.Random(11)
    df = spark.createDataFrame([(i, rng.choice((1, 7, 50, 51, 99, 130))) for i in range(400)], "doc_id long, n_tokens long").repartition(3)
    limits = [(f"m{i}", 60 + i) for i in range(20)] + [("large", 1 << 21), ("next", 100)]
    used = packing.packed(df, limits).groupBy("model_name", "container").agg(F.sum("n_tokens").alias("used"))
    rows = used.groupBy("model_name").agg(F.max("used").alias("most"), F.sum("used").alias("sum")).collect()
    total = df.agg(F.sum("n_tokens")).first()[0]
    assert len(rows) == 22 and all(r["most"] <= dict(limits)[r["model_name"]] and r["sum"] == total for r in rows)


CUT = ["It was late and the lam", "The end of the sentence was lost when the tow…", "Then nobody came...", "One.\n- moat (A)\n- re", "Text \\u00", "So it is and&am", "A.\n```python\nx = [", '{"a": "b', "He said [cut]", "Because the cherry is crimson,", "see https://exam", "and so d�"]
COMPLETE = ["All is well.", "Is it?", "He left. 🙂", "Both.", "No", "42%", "One.\n- moat (A)\n- reed (B)", "A.\n```python\nx = 1\n```", '{"a": "b"}', "Town: 85 kg", "He said “so.”", "i cant assist with that, sorry", "Done. (Anna)", "- tea\n- milk\n- bread"]
OPEN = ["It rained.\n\nBest regards,\nAnna-Maria", "Es regnete.\n\nMit freundlichen Grüßen\nAnna", "It rained. https://a.example/notes/41"]
NOTHING = [None, "", "  \n", "N/A", "nan", "...", "--", "<|endoftext|>", "[no output]", "(empty)", "​", " ", "[]", '""', "TODO"]


def test_endings(spark):
    texts = [(t, "cut") for t in CUT] + [(t, "complete") for t in COMPLETE] + [(t, "open") for t in OPEN] + [(t, "none") for t in NOTHING]
    df = truncation.with_ending(spark.createDataFrame(texts, "text string, want string"))
    assert [tuple(r) for r in df.filter("ending != want").collect()] == []
    assert df.filter(truncation.says_nothing(F.col("text")) != (F.col("want") == "none")).count() == 0


def test_runs_of_signs_of_any_length_say_nothing(spark):
    texts = [(sign * n, "none") for sign in "-._…?" for n in (60, 61, 90, 5000)] + [("[" + "-" * 90 + "]", "none"), ("-" * 90 + " and so the la", "cut"), ("A row. " + "-" * 90, "cut")]
    df = truncation.with_ending(spark.createDataFrame(texts, "text string, want string"))
    assert [tuple(r) for r in df.filter("ending != want").collect()] == []
    assert df.filter(truncation.says_nothing(F.col("text")) != (F.col("want") == "none")).count() == 0


def test_limits_and_cut_records(spark):
    rng = random.Random(3)
    sentence = lambda: " ".join(rng.choices("the lamp shines over a quiet road near many towns".split(), k=rng.randint(4, 14))).capitalize() + "."
    rows = []
    for i in range(600):
        text = " ".join(sentence() for _ in range(rng.randint(1, 8)))
        rows.append(("t", i, "short" if i % 2 else None, text[:120] if i % 2 else text))
    rows += [("t", 1000, None, None), ("t", 1001, None, ""), ("t", 0, None, rows[0][3])]
    df = spark.createDataFrame(rows, "tbl string, row_key long, source string, text string").repartition(3)
    found = truncation.limits(df)
    assert {(r["source"], r["unit"], r["length"]) for r in found.filter("unit = 'characters'").collect()} == {("short", "characters", 120)}
    got = {r["row_key"]: r["cause"] for r in truncation.truncated(df).collect()}
    want = {k for _, k, s, t in rows if s and len(t) == 120 and not t.rstrip().endswith(".")}
    assert set(got) == want and set(got.values()) == {"limit"} and len(want) > 100
    assert truncation.truncated(df.limit(0)).count() == 0 and truncation.limits(df.limit(0)).count() == 0


def test_limits_compare_hazards(spark):
    """At each length 15% of the texts left end, at 25 more than half: fewer than at many shorter lengths, which are no limits."""
    texts, left = [], 20000
    for length in range(1, 41):
        n = round(left * (0.55 if length == 25 else 0.15))
        texts += [chr(0x4E00 + i) * length for i in range(left - n, left)]
        left -= n
    df = spark.createDataFrame([("s", t) for t in texts], "source string, text string").repartition(3)
    found = truncation.limits(df).filter("unit = 'characters'").collect()
    assert [r["length"] for r in found] == [25]


def test_frequent_lengths_are_no_limits_however_many_texts(spark):
    """At length 12 half as many more texts end than at its neighbours, at 30 nearly all that are left: only that is a limit, with 300 texts and with 30,000."""
    for left in (300, 30000):
        texts = []
        for length in range(1, 31):
            n = left if length == 30 else round(left * (0.09 if length == 12 else 0.06))
            texts += [chr(0x4E00 + i % 20000) * (length - 1) + chr(0x4E00 + i // 20000) for i in range(left - n, left)]
            left -= n
        df = spark.createDataFrame([("s", t) for t in texts], "source string, text string").repartition(3)
        assert [r["length"] for r in truncation.limits(df).filter("unit = 'characters'").collect()] == [30]


def test_refusals(spark):
    yes = ["I can't help with that.", "Sorry, that is something I won't do. Is there anything else?", "I’m sorry, but I can’t help with the lamp.", "Je suis désolé, mais je ne peux pas répondre à cela.", "Darauf möchte ich lieber nicht antworten.", "Prefiero no hablar de ese tema.", "That is an interesting topic. Still, I will not answer it."]
    no = [None, "", "No.", "I'm sorry to hear that. The lamp fell.", '"I can\'t help you with that," said Anna. The lamp fell over.', "Dear Anna, I am sorry, but we cannot accept. The lamp is blue.", "The museum cannot be seen from here."]
    df = spark.createDataFrame([(t, True) for t in yes] + [(t, False) for t in no], "text string, want boolean")
    assert df.filter(refusals.declines(F.col("text")) != F.col("want")).collect() == []


def test_long_refusals(spark):
    """Apology, reason, policy and an offer, of any length; one other sentence at any place makes it an answer."""
    parts = ["I'm sorry, but I can't help with the lamp that hangs in the hall of the old mill near the road.", "As a language model I have no way to tell who put it there", "My guidelines do not allow me to guess at such things", "We are not able to make an exception for anybody who asks", "Is there anything else that you would like to know about the town"]
    long = parts[0] + " " + ". ".join(parts[1:] * 12)
    other = " The lamp is old and hangs in the hall" + " of the mill near the road" * 400
    texts = [(parts[0] + " " + ". ".join(parts[1:]) + "?", True), (long + ".", True), (long, True), (long + "." + other, False), (other + ". " + long, False), (long + "." + other + ". " + long, False)]
    df = spark.createDataFrame(texts, "text string, want boolean")
    words = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    for found in (refusals.declines(F.col("text")), refusals.declines(F.col("text"), words)):
        assert [len(r["text"]) for r in df.filter(found != F.col("want")).collect()] == []
    assert truncation.with_ending(df).filter("text = '%s'" % long.replace("'", "\\'")).first()["ending"] == "complete"
    rows = [("t", i, "s", "en", "Who put the lamp into the hall?", t) for i, (t, _) in enumerate(texts[:3])]
    pairs = spark.createDataFrame(rows, "tbl string, row_key long, source string, lang string, question string, text string")
    assert {(r["row_key"], r["defect"]) for r in broken_pairs.defects(pairs).collect()} == {(i, "refusal") for i in range(3)}


def test_defects(spark):
    q = "How did the mayor use the lamp to find the road near the town?"
    german = "Die Laterne war damals so hell, dass der Bürgermeister den Weg mit der Hilfe von Anna fand. Das ist alles, was die Leute wissen."
    english = "The mayor held the lamp up to the wall, and that was how the road was found."
    cases = [
        (q, english, None), (q, None, "empty"), (q, "N/A", "empty"), (q, "Yes.", None), (q, "7", None),
        (q, "I must decline this request.", "refusal"), (q, q, "copy"), (q, f"You asked: {q.upper()}", "copy"),
        (q, "The mayor held the lamp up to the wall, and that was how the ro", "truncated"), (q, "The mayor went to the hall with the lamp and the", "truncated"), (q, german, "language"), (q, "En Pleve-Orsk, el faro cruza la tiza cerca de Lopte.", "language"), (q, "Une fois par semaine, la lampe de Drovorvi garde Lopte.", "language"), (q, "la plaza", None), (q, "Ann, Bo: un", None),
        (f"Translate into German: {english}", german, None), (f"Repeat the following text word for word: {german}", german, None),
        ("Write a polite letter that declines an offer.", "I must decline this request.", None),
        (f"Input: {german}\n\nInstruction: Give the text a title.", english, None), (f"Give the text a title.\n\n{german}", english, None),
        (None, english, None), (q, "The mayor held the lamp.\n\nBest regards,\nAnn", "truncated"), (q, "The mayor held the lamp.\n\nBest regards,\nAnnabella", None),
    ]
    rows = [("t", i, "s", "en", a, b) for i, (a, b, _) in enumerate(cases)]
    df = spark.createDataFrame(rows + rows[:3], "tbl string, row_key long, source string, lang string, question string, text string").repartition(4)
    found = broken_pairs.defects(df).collect()
    got = {r["row_key"]: r["defect"] for r in found}
    assert {r["evidence"] for r in found if r["defect"] == "truncated"} == {"transfer", "neighbour"} and {r["evidence"] for r in found if r["defect"] != "truncated"} == {None}
    assert {i: (d, got.get(i)) for i, (_, _, d) in enumerate(cases) if got.get(i) != d} == {}
    assert broken_pairs.defects(df.limit(0)).count() == 0


def test_shortened_versions_across_ranges(spark):
    texts = [f"text number {i:03d} goes on" for i in range(50)]
    df = spark.createDataFrame([(t,) for t in texts + [t[:-1] for t in texts[::5]] + [t + " and on" for t in texts[::7]] + ["", None]], "text string").repartition(5)
    marked = broken_pairs.shortened(df).join(df.distinct().withColumn("same", F.xxhash64("text")), "same")
    assert {r["text"] for r in marked.collect()} == {t[:-1] for t in texts[::5]}


@pytest.mark.parametrize("n", [1, 4, 16])
def test_shortened_versions_with_other_texts_between(spark, n):
    """As over all pairs, in few and in many ranges: texts that go on with a blank or a sign sort before letters."""
    rng = random.Random(n)
    texts = ["Best, Ann", "Best, Ann B.", "Best, Ann, too", "Best, Annabel", "Best, Bo", "Best, Bo B.", "Best, Bo's"]
    for _ in range(150):
        texts.append("".join(rng.choice(["a", "b", " ", ",", "é", "Z"]) for _ in range(rng.randint(1, 9))))
    texts += ["stem"] + [f"stem {i:04d}" for i in range(200)] + ["stems"]
    want = {x for x in texts if any(y.startswith(x) and len(y) > len(x) and x[-1].isalnum() and y[len(x)].isalnum() for y in texts)}
    assert {"Best, Ann", "stem"} <= want and "Best, Bo" not in want
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", n)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", False)
    try:
        df = spark.createDataFrame([(t,) for t in texts + texts[::9]], "text string").repartition(3)
        same = {r["same"] for r in broken_pairs.shortened(df).collect()}
        assert {r["text"] for r in df.withColumn("same", F.xxhash64("text")).collect() if r["same"] in same} == want
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)


def test_disguises():
    known = np.sort(np.array([abuse.Terms().of(w)[0] for w in ("maggot", "magnet", "lamp")], np.uint64))
    t = abuse.Terms(known)
    word = lambda s: t.of(abuse.windows(s)[0][-1])[0]
    for disguised in ("MAGGOT", "m a g g o t", "m.a.g.g.o.t", "m@gg0t", "mаggоt", "ma​ggot", "maaaggot", "mag*ot", "maggo*", "a m a g g o t"):
        assert word(disguised) == word("maggot"), disguised
    assert word("mag*et") == word("magnet") != word("maggot") and word("ma**") not in known
    assert abuse.windows(None) == abuse.windows("") == abuse.windows(" .!? ") == []
    assert max(map(len, abuse.windows("word " * 500))) <= abuse.WINDOW


def test_words_of_like_letters_share_no_weight():
    """brain, burn and Birne: no two terms that the machine knows have one number."""
    words = "brain burn birne barn born bern marsh harsh".split()
    sample = abuse.Sample([" ".join(words), " ".join(words[::-1])], np.array([True, False]))
    at, terms = abuse.Terms(sample.known).flat([[w] for w in words])
    ids, starts = abuse.known_terms(at, terms, sample.known, len(words))
    assert len(set(ids.tolist())) == len(words) and set(np.diff(starts)) == {1}


def phrases(rng):
    insults, names = ["maggot", "wretch", "cretin", "scoundrel"], [f"n{i}" for i in range(60)]
    plain = lambda: f"the {rng.choice(['lamp', 'road', 'mill', 'barn'])} near {rng.choice(names)} is {rng.choice(['old', 'blue', 'wet', 'small'])} today."
    bad = lambda: f"you are nothing but a {rng.choice(insults)}, get lost!"
    cited = lambda: f"the report cites the word {rng.choice(insults)} as an example to filter."
    return plain, bad, cited


def documents_of(rng, n):
    plain, bad, cited = phrases(rng)
    texts, cases, true = [], [], []
    for i in range(n):
        kind = i % 10
        middle = bad() if kind == 0 else cited() if kind == 1 else plain()
        texts.append(" ".join([plain() for _ in range(rng.randint(0, 4))] + [middle] + [plain() for _ in range(rng.randint(0, 4))]))
        cases.append((kind == 0) ^ (rng.random() < 0.03))
        true.append(kind == 0)
    return texts, np.array(cases), np.array(true)


def test_a_learned_interaction_and_scores(spark):
    """An insult counts with an address and not in a report that cites it."""
    rng = random.Random(4)
    plain, bad, cited = phrases(rng)
    texts, cases, _ = documents_of(rng, 500)
    sample = abuse.Sample(texts, cases)
    machine, side_by_side = abuse.trained(sample), abuse.trained(sample, spark)
    assert machine.limit == side_by_side.limit and np.array_equal(machine.weight, side_by_side.weight)
    terms = abuse.Terms(machine.known)
    score = lambda s: machine.document_scores([s], terms)[0]
    assert score(plain() * 40 + " " + bad() + " " + plain()) > abuse.THRESHOLD
    assert score(cited()) < abuse.THRESHOLD and score(plain()) < abuse.THRESHOLD and score(None) == score("") == 0
    df = spark.createDataFrame([(1, bad(), 3.0, "a"), (2, plain(), None, None), (3, None, None, None), (4, "", 1.0, "b")], "doc_id long, text string, score double, source string")
    got = {r["doc_id"]: r["score"] for r in abuse.scored(df, machine).collect()}
    assert got[1] > abuse.THRESHOLD and got[2] < abuse.THRESHOLD and got[3] == got[4] == 0
    assert abuse.scored(df.limit(0), machine).count() == 0


def test_held_out_documents_with_noisy_labels():
    texts, cases, _ = documents_of(random.Random(6), 600)
    machine = abuse.trained(abuse.Sample(texts, cases))
    others, _, true = documents_of(random.Random(7), 400)
    found = machine.document_scores(others, abuse.Terms(machine.known)) >= abuse.THRESHOLD
    assert (found & true).sum() >= 0.95 * true.sum() and (found & ~true).sum() <= 0.05 * true.sum()


def test_limits_of_scores():
    z, cases = np.array([3.0, 2.0, 1.0, -1.0, -2.0]), np.array([True, True, False, True, False])
    assert abuse.best_limit(z, cases) == 1.5
    assert abuse.best_limit(z, np.zeros(5, bool)) == 0 and abuse.best_limit(z, np.ones(5, bool)) == -2.0


def test_no_labels(spark):
    df = spark.createDataFrame([(1, "you are a maggot")], "doc_id long, text string")
    for texts, cases in (([], []), (["a lamp", "a lamp"], [False, False]), (["", None], [True, True])):
        machine = abuse.trained(abuse.Sample(texts, np.array(cases, bool)), spark)
        assert abuse.scored(df, machine).first()["score"] < abuse.THRESHOLD


def test_labels(spark):
    """The majority of the raters holds; ties, nulls and repeated labels count nothing."""
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(6)] + [(6, None)], "doc_id long, text string")
    rows = [(0, "a", "abusive"), (0, "b", "none"), (1, "a", "sexual"), (1, "a", "sexual"), (2, "a", "none"), (2, "b", None), (3, "a", None), (4, "a", "hateful"), (4, "b", "abusive"), (4, "c", "none"), (6, "a", "abusive")]
    labels = spark.createDataFrame(rows, "doc_id long, rater string, label string")
    got = abuse.labelled(docs, labels)
    assert dict(zip(got["doc_id"], got["positive"])) == {1: True, 2: False, 4: True}
