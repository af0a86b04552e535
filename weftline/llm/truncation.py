"""Problem 4: texts cut off by field limits or in transfer.

Lengths are counted in characters, bytes and words. For each source and length the hazard (texts of just this length over
texts at least as long) is tested against TIMES the hazards of the neighbouring lengths, with a bound on the Poisson tail as
the p-value and a false-discovery rate over all tests. A text is cut if its ending is incomplete: at a significant length by the field's
limit, elsewhere in transfer. Endings that may be either (a letter's name, a link) count as cut only at significant lengths
or where the text is a shortened version of another one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.refusals import declines
from weftline.llm.shared import table

#: Lengths to each side whose hazards are compared, and the accepted share of false limits.
NEIGHBOURS, FALSE_DISCOVERY = 20, 0.01
#: How many times the neighbouring hazard a limit's hazard must exceed: sentences of like build make some lengths frequent too, and with enough texts any such difference is significant.
TIMES = 2.0
#: Space of any kind, also what is not seen.
BLANK = r"[\s ​‌‍⁠﻿]"
# Texts that stand for a missing value, in words or brackets, and by a run of signs.
STAND_IN = (
    r"(?i)^(?:n/?a|n\.a\.|nan|null|none|nil|nichts|undefined|missing|tbd|todo|fixme|empty|blank|no (?:output|answer|response|text)"
    r"|<\|?[a-z_/]*\|?>|</?s>|\[\]|\{\}|\(\)|\"\"|''|“”)$"
)
SIGNS = r"^(?:[-–—_.…?*#/\\]+|[\[(<]\s*[-–—_.…?*#/\\]+\s*[\])>])$"
# What a cut may leave behind: a broken character, escape or entity, a sign of omission.
LEFT_BEHIND = (
    r"(?:�|\\u[0-9a-fA-F]{0,4}|\\x?|&[a-zA-Z]{1,7}|&#\w{0,5}|<[a-zA-Z/][a-zA-Z]*|%[0-9A-F]?(?<=[a-z]%[0-9A-F]?)"
    r"|[\[(<]\s*(?:cut|truncated|snip|more|…|\.\.\.|gekürzt|tronqué|cortado|abgeschnitten|coupé)\s*[\])>]|…|\.\.\.)$"
)
STOP = r"[.!?。！？؟](?:[\"”“’»'\)\]*_`\p{So}\p{Sk}️‍]|[:;]-?[\)DP(]|<3|\s|\(\p{Lu}[^()\n]{0,40}\))*$"
ITEM = r"(?:[-*•–+]|\d{1,3}[.)])\s"


def trimmed(text: Column) -> Column:
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+$", "")


#: Characters at the end of a text that tell how it ends, and of a text that may be a stand-in other than a run of signs.
TAIL, SHORT = 120, 60


def _nothing(t: Column) -> Column:
    bare = F.regexp_replace(t, r"^[\[(<]\s*(.*?)\s*[\])>]$", "$1")
    return F.coalesce((F.length(t) <= SHORT) & ((t == "") | t.rlike(STAND_IN) | bare.rlike(STAND_IN)) | t.rlike(SIGNS), F.lit(True))


def says_nothing(text: Column) -> Column:
    """Whether text is null, blank or only a stand-in for a missing value."""
    return _nothing(trimmed(text))


def with_ending(df: DataFrame, text: str = "text") -> DataFrame:
    """df with a column ending: how a text ends.

    'none' (it says nothing), 'complete', 'open' (undecided: a name under a letter, a link) or 'cut'. The stages before the last
    keep costly parts from being repeated in every branch; what most texts are, ended by a stop, is decided first.
    """
    df = df.withColumn("__t", trimmed(F.col(text)))
    df = df.withColumns({"__tail": F.right("__t", F.lit(TAIL)), "__last": F.substring_index("__t", "\n", -1), "__none": _nothing(F.col("__t")), "__fenced": F.contains("__t", F.lit("```"))})
    df = df.withColumns({"__left": F.col("__tail").rlike(LEFT_BEHIND), "__stop": F.col("__tail").rlike(STOP)})
    t, last, stop = F.col("__t"), F.col("__last"), F.col("__stop")
    words = F.regexp_count(t, F.lit(r"\S+"))
    odd = F.regexp_count(t, F.lit("```")) % 2 == 1
    sibling = t.rlike(rf"(?:^|\n)\s*{ITEM}[^\n]*[.!?)]\s*\n\s*{ITEM}[^\n]*$")
    bare_sibling = t.rlike(rf"(?:^|\n)\s*{ITEM}[^\n]*[^.!?)\s]\s*\n\s*{ITEM}[^\n]*$")
    ending = (
        F.when(F.col("__none"), "none")
        .when(F.col("__left"), "cut")
        .when(F.col("__fenced"), F.when(odd, "cut").when(t.endswith("```") | stop, "complete").otherwise("cut"))
        .when(stop, "complete")
        .when(declines(F.col(text)), "complete")
        .when(t.rlike(r"^[\[{]"), F.when(t.rlike(r"[\]}]$"), "complete").when(F.try_parse_json(t).isNotNull(), "complete").otherwise("cut"))
        .when(t.rlike(r"https?:\S*$"), F.when(t.rlike(r"https?://[^\s/]+\.[^\s/]+/\S*[^\s/]$"), "open").otherwise("cut"))
        .when(last.rlike(rf"^\s*{ITEM}"), F.when(t.endswith(")"), "complete").when(sibling, "cut").when(bare_sibling, "complete").otherwise("cut"))
        .when(t.rlike(r"(?:,|\n\n[^\n.!?]{3,40})\n+\p{Lu}[\p{L}'’-]*(?: \p{L}[\p{L}'’-]*){0,2}$"), "open")
        .when(last.rlike(r"[,;:(\[{“«–—-]$"), "cut")
        .when((words <= 3) & ~t.rlike(r"[.!?]\s"), "complete")
        .when(last.endswith(")") & F.contains(t, F.lit("\n")), "complete")
        .otherwise("cut")
    )
    return df.withColumn("ending", ending).drop("__t", "__tail", "__last", "__none", "__fenced", "__left", "__stop")


UNITS = ("characters", "bytes", "words")


def lengths(text: Column) -> Column:
    """The lengths of a text in each unit."""
    counts = (F.length(text), F.octet_length(text), F.regexp_count(text, F.lit(r"\S+")))
    return F.array(*(F.struct(F.lit(unit).alias("unit"), n.cast("bigint").alias("length")) for unit, n in zip(UNITS, counts)))


def limits(records: DataFrame, neighbours: int = NEIGHBOURS, rate: float = FALSE_DISCOVERY) -> DataFrame:
    """source, unit, length, n, at_risk and log_p of the lengths at which significantly many texts of a source end: more than TIMES as many as at the neighbouring ones.

    records: source and text. Null and empty texts count nowhere, equal texts of a source once; null sources are one source.
    Only hashes with lengths and their counts are shuffled; the windows run over distinct lengths, not over texts.
    """
    counts = (
        records.filter("text is not null and text != ''")
        .select("source", F.xxhash64("text").alias("same"), lengths(F.col("text")).alias("lengths"))
        .distinct()
        .select("source", F.inline("lengths"))
        .groupBy("source", "unit", "length")
        .agg(F.count("*").alias("n"))
    )
    of = Window.partitionBy("source", "unit")
    tests = counts.withColumn("at_risk", F.sum("n").over(of.orderBy(F.desc("length"))))

    def hazard(w: int, more: int) -> Column:
        """Texts of the up to 2 w neighbouring lengths, and so many more, over the texts at risk there, also where a length has no text."""
        length, n, near = F.col("length"), F.col("n"), of.orderBy("length").rangeBetween(-w, w)
        low, high = F.greatest(length - w, F.lit(1)), length + w
        longer = F.col("at_risk") - F.sum("n").over(of.orderBy("length").rangeBetween(0, w))
        # A text inside the window is at risk at every length of it up to its own.
        risk = (high - low + 1) * longer + F.sum(n * length).over(near) - (low - 1) * F.sum("n").over(near) - F.when(length >= low, F.col("at_risk")).otherwise(0)
        return (F.sum("n").over(near) - n + more) / F.greatest(risk, F.lit(1))

    tests = tests.withColumn("expected", TIMES * F.col("at_risk") * F.greatest(hazard(neighbours, 1), hazard(2, 0)))
    # P(X >= n) of a Poisson variable is at most exp(-(n ln(n / m) - n + m)) for n > m.
    log_p = F.when(F.col("n") > F.col("expected"), -(F.col("n") * F.log(F.col("n") / F.col("expected")) - F.col("n") + F.col("expected"))).otherwise(0.0)
    tests = tests.withColumn("log_p", F.greatest(log_p, F.lit(-2000.0))).withColumn("bin", F.ceil(F.col("log_p") * 20).cast("int"))
    # Benjamini-Hochberg over bins of p-values: at most 40,001 bins whatever the number of tests.
    bins = tests.groupBy("bin").agg(F.count("*").alias("of_bin"))
    rank = F.sum("of_bin").over(Window.orderBy("bin"))
    total = F.sum("of_bin").over(Window.partitionBy())
    accepted = bins.select("bin", ((F.col("bin") / 20.0) <= F.log(F.lit(rate)) + F.log(rank) - F.log(total)).alias("ok")).filter("ok").agg(F.max("bin").alias("most"))
    return tests.join(F.broadcast(accepted), F.col("bin") <= F.col("most")).select("source", "unit", "length", "n", "at_risk", "log_p")


def at_limit(records: DataFrame, found: DataFrame) -> DataFrame:
    """records (source, text and others) without text, with limited: whether a length of the text is one of the limits found. Texts aren't shuffled."""
    per_source = found.groupBy("source").agg(F.collect_set(F.struct("unit", "length")).alias("__limits")).withColumnRenamed("source", "__source")
    of = lengths(F.col("text"))
    sized = records.withColumns({f"__l{i}": of[i]["length"] for i in range(3)}).drop("text")
    joined = sized.join(per_source, F.col("source").eqNullSafe(F.col("__source")), "left")
    own = F.array(*(F.struct(F.lit(unit).alias("unit"), F.col(f"__l{i}").alias("length")) for i, unit in enumerate(UNITS)))
    return joined.withColumn("limited", F.coalesce(F.arrays_overlap("__limits", own), F.lit(False))).drop("__source", "__limits", *(f"__l{i}" for i in range(3)))


def truncated(records: DataFrame) -> DataFrame:
    """tbl, row_key, source, cause ('limit' or 'transfer') of the records whose text was cut.

    records: tbl, row_key, source, text. Rows with the same tbl and row_key are one record. Nulls, blanks and stand-ins are not cut. Empty tables give no rows.
    """
    one = records.groupBy("tbl", "row_key").agg(F.first("source").alias("source"), F.first("text").alias("text"))
    marked = at_limit(with_ending(one), limits(one))
    cut = (F.col("ending") == "cut") | (F.col("ending") == "open") & F.col("limited")
    return marked.filter(cut).select("tbl", "row_key", "source", F.when(F.col("limited"), "limit").otherwise("transfer").alias("cause"))


FIELDS = {"finetune_rows": ("example_id", "train_output"), "dpo_train": ("row_id", "rejected"), "dpo_validation": ("row_id", "rejected")}


def p4_records(spark: SparkSession, sf_dir: str, fields: dict[str, tuple[str, str]] = FIELDS) -> DataFrame:
    out = None
    for name, (key, text) in fields.items():
        df = table(spark, sf_dir, name, key, "source", text).select(F.lit(name).alias("tbl"), F.col(key).alias("row_key"), "source", F.col(text).alias("text"))
        out = df if out is None else out.unionByName(df)
    return out


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl and row_key of every cut train_output and rejected."""
    return truncated(p4_records(spark, sf_dir)).select("tbl", "row_key")


def p4_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The significant lengths of each source."""
    return limits(p4_records(spark, sf_dir).dropDuplicates(["tbl", "row_key"])).withColumn("log_p", F.round("log_p", 4))


def p4_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, n_records, n_cut, n_at_limit and share_cut of each source."""
    records = p4_records(spark, sf_dir)
    total = records.groupBy("tbl", "row_key").agg(F.first("source").alias("source")).groupBy("source").agg(F.count("*").alias("n_records"))
    cut = truncated(records).groupBy("source").agg(F.count("*").alias("n_cut"), F.count_if(F.col("cause") == "limit").alias("n_at_limit"))
    n = F.coalesce("n_cut", F.lit(0))
    return total.join(cut.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select(
        "source", "n_records", n.alias("n_cut"), F.coalesce("n_at_limit", F.lit(0)).alias("n_at_limit"), F.round(n / F.col("n_records"), 6).alias("share_cut")
    )
