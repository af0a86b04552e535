"""Problem 2: pairs of a question and an answer in which the answer is no usable one, each with its kind of defect.

Answers are sorted by text and compared with their neighbours: one that breaks off inside a word with which its neighbour
goes on is a shortened version. Together with the spikes of the lengths (truncation.py) this finds truncated answers. Rules
follow for stand-ins, answers that only decline, that only give back the question or are in another language.
"""

from __future__ import annotations

from collections.abc import Iterator
from os.path import commonprefix

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.refusals import declines
from weftline.llm.shared import Fresh, table, written
from weftline.llm.truncation import at_limit, limits, with_ending

# Words by which the four languages are told apart.
FUNCTION_WORDS = {
    "en": "the of and that with to from which who how was is when then this are a an by it what why has for",
    "fr": "le les des et du est une un dans qui pas au aux pour avec ne ce cette sur il elle que quand parce vous votre à puis sous",
    "de": "der die das und ist nicht von den dem ein eine einen einem im zu mit auf wie wenn weil für nach es dass sich über war wieder",
    "es": "el los las y del una un es por con para se como cuando al su ni unos según este esta que a lo pero cerca",
}
# What a question says that asks for a translation, a repetition or a letter that declines.
TRANSLATION = (
    r"(?i)\b(?:translat|translit|tradui|traduc|traduz|übersetz|übertrag)"
    r"|\b(?:in|into|to|en|auf|ins|al)\s+(?:english|french|german|spanish|anglais|français|allemand|espagnol|englisch\w*|französisch\w*|deutsch\w*|spanisch\w*|inglés|francés|alemán|español)\b"
)
REPETITION = (
    r"(?i)\b(?:repeat|copy|recopy|reproduce|echo|quote)\b|\bword for word\b|\bverbatim\b|\bwithout changes\b|\b(?:correct|fix)\b[^.:\n]{0,30}\b(?:spelling|grammar)\b|\breturn the (?:sentence|text)\b"
    r"|\b(?:répétez|répète|recopiez|recopie|copiez|copie|reproduisez)\b|\bmot pour mot\b|\b(?:corrigez|corrige)\b|\brendez la phrase\b"
    r"|\b(?:wiederhol\w*|kopier\w*|korrigier\w*)\b|\bwörtlich\b|\bschreib\w*\b[^.:\n]{0,30}\bab\b|\bohne änderung"
    r"|\b(?:repite|repita|copia|copie|transcribe|corrige|corrija)\b|\bpalabra por palabra\b|\bsin cambios\b"
)
DECLINING = r"(?i)\b(?:declin|refus|reject|turn(?:s|ing)? down|absag|ablehn|rechaz|negativ)"
#: Share of an answer's word pairs that also stand in the question, from which on it only gives the question back.
GIVEN_BACK = 0.7


# The rules run in stages: each stage's columns are computed once and used by the next, where one expression of all would
# repeat the costly parts many times over.


def asked(df: DataFrame) -> DataFrame:
    """df with a column asks: the part of its column question that asks, without the passages it cites."""
    labelled = r"(?:^|\n)\s*(?:Instruction|Question|Task|Aufgabe|Frage|Consigne|Tâche|Pregunta|Instrucción)\s*:\s*([^\n]*)"
    cited = r"(?m)^\s*(?:Input|Output|Document|Context|Contexte|Contexto|Kontext|Setting|Mention|Thema|Text|Texte|Texto|Example)\s*:.*$"
    df = df.withColumns({"__labelled": F.regexp_extract("question", labelled, 1), "__paragraphs": F.split(F.regexp_replace("question", cited, ""), r"\n\s*\n")})
    df = df.withColumn("__paragraphs", F.filter("__paragraphs", lambda p: p.rlike(r"\p{L}[^\p{L}]+\p{L}")))
    df = df.withColumn("__shortest", F.array_min(F.transform("__paragraphs", lambda p: F.struct(F.length(p).alias("n"), F.ltrim(p).alias("p"))))["p"])
    df = df.withColumn("__before", F.regexp_extract("__shortest", r"^\s*([^:\n]{8,90}):\s", 1))
    asks = F.when(F.col("__labelled") != "", F.col("__labelled")).when(F.col("__before") != "", F.col("__before")).otherwise(F.coalesce("__shortest", "question"))
    return df.withColumn("asks", asks).drop("__labelled", "__paragraphs", "__shortest", "__before")


def with_words(df: DataFrame, text: Column, out: str) -> DataFrame:
    return df.withColumn(out, F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), F.array().cast("array<string>")))


def with_languages(df: DataFrame, words: str, out: str, where: Column | None = None) -> DataFrame:
    """A column out: how many function words of each language the words have, the most first; null where the condition doesn't hold."""

    def count(known: str) -> Column:
        return F.size(F.filter(words, lambda w: w.isin(*known.split())))

    counts = [F.struct(count(known).alias("n"), F.lit(name).alias("name")) for name, known in FUNCTION_WORDS.items()]
    ranked = F.sort_array(F.array(*counts), asc=False)
    return df.withColumn(out, ranked if where is None else F.when(where, ranked))


def language(ranked: str, least: int, times: float) -> Column:
    """The language of the most function words, if it has at least so many, and so many times as many as any other; else null."""
    first, second = F.col(ranked)[0], F.col(ranked)[1]
    return F.when((first["n"] >= least) & (first["n"] >= times * second["n"]) & (first["n"] > second["n"]), first["name"])


def answer_language(ranked: str, words: str) -> Column:
    """The language of an answer: at least three function words and 1.5 times as many as of any other language; two or, among eight words, one if no other has any."""
    first, second = F.col(ranked)[0], F.col(ranked)[1]
    alone = (second["n"] == 0) & ((first["n"] >= 2) | (first["n"] == 1) & (F.size(words) >= 8))
    return F.coalesce(language(ranked, 3, 1.5), F.when(alone, first["name"]))


def with_given_back(df: DataFrame, question_words: str, answer_words: str, out: str) -> DataFrame:
    """A column out: the share of the answer's word pairs that also stand in the question; 0 below three words."""

    def pairs(words: str) -> Column:
        next_words = F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))
        return F.zip_with(words, next_words, lambda a, b: F.when(b.isNotNull(), F.xxhash64(a, b)))

    df = df.withColumns({"__qp": pairs(question_words), "__ap": F.array_compact(F.array_distinct(pairs(answer_words)))})
    share = F.size(F.array_intersect("__ap", "__qp")) / F.greatest(F.size("__ap"), F.lit(1))
    return df.withColumn(out, F.when(F.size(answer_words) >= 3, share).otherwise(0.0)).drop("__qp", "__ap")


def shortened(texts: DataFrame) -> DataFrame:
    """same (xxhash64) of the texts that stop inside a word with which another text goes on.

    All texts, copies once a task, are sorted over the cluster. A text stays open while the following ones start with it, until one
    goes on inside the word. What is open at the end of a range is a start of the next range's first text, so that text and
    the lengths of its starts with which others of its range go on inside a word decide. One task reads these in order.
    """

    def goes_on(y: str, n: int) -> bool:
        return len(y) > n > 0 and y[n - 1].isalnum() and y[n].isalnum()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        waiting: list[tuple[int, str]] = []  # open texts, each a start of the next
        shared, reached = 0, set()  # characters that the last text shares with the first
        for b in batches:
            found = []
            for same, text, at in zip(b.column("same").to_pylist(), b.column("text").to_pylist(), b.column("range").to_pylist()):
                if last == same:
                    continue
                while waiting and not text.startswith(waiting[-1][1]):
                    waiting.pop()
                found += [(x, None, None, None) for x, start in waiting if goes_on(text, len(start))]
                waiting = [w for w in waiting if not goes_on(text, len(w[1]))]
                if text[-1].isalnum():
                    waiting.append((same, text))
                if first is None:
                    first, shared = (text, at), len(text)
                elif shared:
                    if not text.startswith(first[0][:shared]):
                        shared = len(commonprefix([first[0][:shared], text]))
                    if goes_on(text, shared):
                        reached.add(shared)
                last = same
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in found], schema)
        if first:
            edges = [(None, *first, sorted(reached)), *((same, text, first[1], None) for same, text in waiting)]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r)) for r in edges], schema)

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple[int, str]] = []
        for b in batches:
            found = []
            for same, text, reached in zip(b.column("same").to_pylist(), b.column("text").to_pylist(), b.column("reached").to_pylist()):
                if reached is None:
                    waiting.append((same, text))
                    continue
                waiting = [w for w in waiting if text.startswith(w[1])]
                done = {x for x, start in waiting if goes_on(text, len(start)) or len(start) in reached}
                found += done
                waiting = [w for w in waiting if w[0] not in done]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.int64())], ["same"])

    names = ["same", "text", "range", "reached"]
    schema = pa.schema([("same", pa.int64()), ("text", pa.string()), ("range", pa.int32()), ("reached", pa.list_(pa.int32()))])

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh = Fresh()  # so that a text that most rows have doesn't fill its range
        for b in batches:
            yield b.filter(pa.array(fresh(b.column("same").to_numpy(), np.ones(len(b), bool))))

    distinct = texts.filter("text != ''").select("text", F.xxhash64("text").alias("same")).mapInArrow(once, "text string, same bigint")
    ranges = distinct.repartitionByRange("text").sortWithinPartitions("text").withColumn("range", F.spark_partition_id())
    out = written(ranges.mapInArrow(run, "same bigint, text string, range int, reached array<int>"))
    edges = out.filter("text is not null").repartition(1).sortWithinPartitions("range", F.col("reached").isNull(), F.length("text"))
    return out.filter("text is null").select("same").unionByName(edges.mapInArrow(follow, "same bigint")).distinct()


def defects(pairs: DataFrame) -> DataFrame:
    """tbl, row_key, source, defect and evidence of the defective pairs. pairs: tbl, row_key, source, lang, question, text (the answer).

    evidence says what shows a truncated answer besides its ending: 'limit' (a significant length), 'neighbour' (another answer goes on
    inside its last word) or, by the ending alone, 'transfer'; it is null for other defects.

    Rows with the same tbl and row_key are one pair. A null, empty or blank answer is 'empty'; a null question asks for nothing
    and can't be given back. Empty tables give no rows.
    """
    one = written(pairs.groupBy("tbl", "row_key").agg(*(F.first(c).alias(c) for c in ("source", "lang", "question", "text"))))
    question = F.col("question")
    df = with_ending(asked(one))
    df = with_words(with_words(df, F.col("question"), "qw"), F.col("text"), "tw")
    df = with_given_back(df, "qw", "tw", "share")
    df = with_languages(df, "tw", "tr").withColumn("told", F.when(F.col("lang").isin("fr", "de", "es"), F.col("lang")))
    df = with_words(df, F.when(F.col("told").isNull(), F.col("asks")), "aw")
    df = with_languages(df, "aw", "ar", F.col("told").isNull()).withColumn("told", F.coalesce("told", language("ar", 1, 1.0)))
    df = with_languages(df, "qw", "qr", F.col("told").isNull()).withColumn("told", F.coalesce("told", language("qr", 2, 1.5), "lang"))
    df = df.withColumns({"given": F.col("share") >= GIVEN_BACK, "other": F.coalesce(F.col("told") != answer_language("tr", "tw"), F.lit(False))})
    # What the question asks for is looked at only where it matters.
    asks_for = lambda pattern: F.coalesce(question.rlike(pattern), F.lit(False))
    marked = df.select(
        "tbl", "row_key", "source", "text", F.xxhash64("text").alias("same"), "ending", (F.col("ending") == "none").alias("empty"), (declines(F.col("text"), F.col("tw")) & ~asks_for(DECLINING)).alias("refusal"),
        (F.col("given") & ~asks_for(REPETITION)).alias("copy"), (F.col("other") & ~asks_for(TRANSLATION) & ~asks_for(REPETITION)).alias("other"),
    )
    spikes = at_limit(marked, limits(one))
    joined = spikes.join(shortened(one).withColumn("shortened", F.lit(True)), "same", "left")
    cut = (F.col("ending") == "cut") | (F.col("ending") == "open") & (F.col("limited") | F.coalesce("shortened", F.lit(False)))
    defect = F.when(F.col("empty"), "empty").when(F.col("refusal"), "refusal").when(F.col("copy"), "copy").when(cut, "truncated").when(F.col("other"), "language")
    evidence = F.when(F.col("defect") == "truncated", F.when(F.col("limited"), "limit").when(F.col("shortened"), "neighbour").otherwise("transfer"))
    return joined.withColumn("defect", defect).filter("defect is not null").select("tbl", "row_key", "source", "defect", evidence.alias("evidence"))


FIELDS = {"finetune_rows": ("example_id", "train_input", "train_output"), "dpo_train": ("row_id", "train_prompts", "chosen"), "dpo_validation": ("row_id", "validation_prompts", "chosen")}


def p2_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for name, (key, question, answer) in FIELDS.items():
        df = table(spark, sf_dir, name, key, "source", "lang", question, answer).select(
            F.lit(name).alias("tbl"), F.col(key).alias("row_key"), "source", "lang", F.col(question).alias("question"), F.col(answer).alias("text")
        )
        out = df if out is None else out.unionByName(df)
    return out


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, row_key and defect of every defective pair."""
    return defects(p2_pairs(spark, sf_dir)).select("tbl", "row_key", "defect")


def p2_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, defect, evidence and the number of such pairs."""
    return defects(p2_pairs(spark, sf_dir)).groupBy("source", "defect", "evidence").agg(F.count("*").alias("n_pairs"))
