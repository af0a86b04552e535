"""Functions of text columns: templates, parsing of model output, token counts. All are expressions of the plan."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from pathlib import PurePath

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VARIABLE = re.compile(r"\{([a-zA-Z0-9:_.]+)\}")


def python_string(c: Column, kind: str) -> Column:
    """A value as Python's str() writes it: True, None, 10000000.0, 1e-05. Nested values are written as Spark does."""
    text = c.cast("string")
    if kind == "boolean":
        text = F.initcap(text)
    elif kind in ("double", "float"):
        text = F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(_python_float(c.cast("double")))
    elif kind.startswith("timestamp"):
        text = F.when(text.contains("."), F.concat(F.substring_index(text, ".", 1), F.lit("."), F.rpad(F.substring_index(text, ".", -1), 6, "0"))).otherwise(text)
    return F.coalesce(text, F.lit("None"))


def _python_float(c: Column) -> Column:
    """A finite double as Python writes it: an exponent only below 1e-4 and from 1e16 on, where Spark has one below 1e-3 and from 1e7 on."""
    spark = F.abs(c).cast("string")
    exponent = F.substring_index(spark, "E", -1).try_cast("int")
    digits = F.regexp_replace(F.replace(F.substring_index(spark, "E", 1), F.lit("."), F.lit("")), "0+$", "")
    whole = F.concat(F.substring(F.rpad(digits, exponent + 1, "0"), F.lit(1), exponent + 1), F.lit("."), F.when(F.length(digits) > exponent + 1, F.substring(digits, exponent + 2, F.length(digits))).otherwise("0"))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -exponent - 1), digits)
    mantissa = F.concat(F.substring(digits, 1, 1), F.when(F.length(digits) > 1, F.concat(F.lit("."), F.substring(digits, F.lit(2), F.length(digits)))).otherwise(""))
    scientific = F.concat(mantissa, F.lit("e"), F.when(exponent < 0, "-").otherwise("+"), F.lpad(F.abs(exponent).cast("string"), 2, "0"))
    text = F.when(~spark.contains("E"), spark).when((exponent >= 0) & (exponent < 16), whole).when((exponent < 0) & (exponent >= -4), small).otherwise(scientific)
    return F.concat(F.when(c < 0, "-").otherwise(""), text)


def python_text(df: DataFrame, column: str) -> Column:
    """A column of df as Python's str() writes its values."""
    return python_string(F.col(f"`{column}`"), dict(df.dtypes)[column])


def labelled(label: str | None, value: Column) -> Column:
    """'label value', or the value alone where the label is empty."""
    return F.concat_ws(" ", F.lit(label), value) if label else value


def joined_parts(parts: Sequence[Column | None], sep: str) -> Column:
    """The parts that are not null, joined by sep; empty strings count."""
    return F.concat_ws(sep, *(p for p in parts if p is not None))


def template_variables(template: str) -> list[str]:
    """The names in single braces, each once, in their order; double braces are no variables but hide none inside them."""
    found: list[str] = []
    for piece in re.split(r"\{\{|\}\}", template):
        found += [v for v in VARIABLE.findall(piece) if v not in found]
    return found


def filled(template: str, values: Mapping[str, Column]) -> Column:
    """The template with all variables replaced at once, so values may hold braces."""
    out, at = [], 0
    for m in VARIABLE.finditer(template):
        if m[1] in values:
            out += [F.lit(template[at : m.start()]), F.coalesce(values[m[1]].cast("string"), F.lit("None"))]
            at = m.end()
    return F.concat(*out, F.lit(template[at:]))


def chat_prompt(template: str, prompt: Column, system_prompt: str | None = None) -> Column:
    """A chat template filled in: the system prompt first, then the prompt."""
    return F.replace(F.lit(template.replace("{{system_prompt}}", system_prompt or "")), F.lit("{{prompt}}"), prompt)


def stripped(text: Column) -> Column:
    """Text without blanks of any kind at either end, as Python's strip()."""
    return F.regexp_replace(text, r"^[\s\u001c-\u001f\u0085  -     　]+|[\s\u001c-\u001f\u0085  -     　]+$", "")


def cut_at_stop(text: Column, stops: Sequence[str]) -> Column:
    """Text of which each line ends before the first stop string, without blanks around the whole."""
    if not stops:
        return text
    any_of = "|".join(re.escape(s) for s in sorted(stops, key=len, reverse=True))
    return stripped(F.regexp_replace(text, f"(?m)(?:{any_of}).*$", ""))


def says_yes(text: Column) -> Column:
    """Whether the word yes stands in the text, in any case; null counts as no."""
    return F.coalesce(text.rlike(r"(?i)\byes\W*\b"), F.lit(False))


def parsed_score(text: Column) -> Column:
    """The first number in the text; null where there is none or it is malformed."""
    return F.regexp_extract(text, r"[0-9.]+", 0).try_cast("double")


def judgement(text: Column, a: str, b: str, swapped: Column, otherwise: Column) -> Column:
    """The one of two labels a text names, or the one otherwise says if it names both or none; turned round where the order was swapped."""
    has_a, has_b = text.contains(a), text.contains(b)
    said = F.when(has_a & ~has_b, a).when(has_b & ~has_a, b).otherwise(otherwise)
    return F.when(swapped, F.when(said == b, a).otherwise(b)).otherwise(said)


def clean_label(label: str) -> str:
    return label.strip(":")


def word_count(text: Column) -> Column:
    """The default count of tokens: runs of non-blank characters; null and empty have 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0))


def checked_length(text: Column, most: int, count=word_count) -> Column:
    """The text, or an error when it is read if it has more than so many tokens."""
    return F.when(count(text) > most, F.raise_error(F.concat(F.lit("a text has more tokens than the model takes: "), count(text).cast("string"))).cast("string")).otherwise(text)


def prompt_completion(prompt: Column, completion: Column) -> Column:
    return F.concat(prompt, completion)


def causal_labels(prompt_ids: Column, completion_ids: Column, eos: int, most: int | None = None) -> tuple[Column, Column]:
    """Input ids, and labels with -100 for the prompt, both ended by eos and cut to a length."""
    ids = F.concat(prompt_ids, completion_ids, F.array(F.lit(eos)))
    labels = F.concat(F.array_repeat(F.lit(-100), F.size(prompt_ids)), completion_ids, F.array(F.lit(eos)))
    return (F.slice(ids, 1, most), F.slice(labels, 1, most)) if most else (ids, labels)


def size_category(n: Column) -> Column:
    """The range of a number of rows, in powers of ten."""
    bounds = [("1K", 10**3), ("10K", 10**4), ("100K", 10**5), ("1M", 10**6), ("10M", 10**7), ("100M", 10**8), ("1B", 10**9), ("10B", 10**10), ("100B", 10**11), ("1T", 10**12)]
    out = F.when(n < bounds[0][1], F.lit("n<1K"))
    for (low, _), (high, most) in zip(bounds, bounds[1:]):
        out = out.when(n < most, F.lit(f"{low}<n<{high}"))
    return out.otherwise(F.lit("n>1T"))


def safe_name(name: str) -> str:
    """A name for files: parts of ' / ' become folders, blanks hyphens; other signs go."""
    name = name.replace(" / ", "/").replace(" ", "-")
    return "".join(c for c in name if c.isalnum() or c in "-_/").lower()


def split_path(path: str, split: str) -> str:
    """x.ext becomes x.train.ext, x.val.ext or x.test.ext."""
    p = PurePath(path)
    return str(p.with_name(f"{p.stem}.{'val' if split == 'validation' else split}{p.suffix}"))
