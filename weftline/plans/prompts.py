"""Prompts and the steps around models: rendering, few-shot packing, retrieval, filtering, ranking, judging."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator, Sequence
from random import Random
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.functions import text as X
from weftline.functions.vectors import top_k
from weftline.models import Expression, Function, Model, with_model
from weftline.operators.combine import attribute_product
from weftline.position import BLOCK, POS, densified
from weftline.storage import materialised


def process_prompt(value: Column, instruction: str, input_label: str | None = "Input:", instruction_label: str | None = "Instruction:", sep: str = "\n\n") -> Column:
    return F.concat_ws(sep, X.labelled(input_label, value), F.lit(f"{instruction_label} {instruction}" if instruction_label else instruction))


def generated(
    df: DataFrame, prompts: str, model: Model, out: str = "generations", post_process: Callable[[Any], Any] | None = None, output_type: str | None = None, stop: Sequence[str] | None = None,
    template: str | None = None, system_prompt: str | None = None, max_new_tokens: int | None = None, **options: Any,
) -> DataFrame:
    """A model's answers to a column of prompts.

    template and system_prompt: the model gets the chat prompt they make. stop: answers end before the first of these strings
    in a line. max_new_tokens: a prompt that leaves less room in the model's max_length is an error. post_process: a function of
    the answers' Column, or with output_type a Python function of one answer.
    """
    if max_new_tokens is not None:
        options["max_new_tokens"] = max_new_tokens
    if stop:
        options["stop"] = list(stop)
    asked = df.withColumn("__chat", X.chat_prompt(template, F.col(prompts), system_prompt)) if template else df
    done = with_model(asked, "__chat" if template else prompts, out, model, **options).drop("__chat")
    if stop:
        done = done.withColumn(out, X.cut_at_stop(F.col(out), stop))
    if post_process is None:
        return done
    if output_type is None:
        return done.withColumn(out, post_process(F.col(out)))
    return with_model(done, out, out, Function(post_process, output_type))


def process_with_prompt(df: DataFrame, inputs: str, model: Model, instruction: str, post_process: Callable[[Any], Any] | None = None, output_type: str | None = None, **labels: Any) -> DataFrame:
    """Columns inputs, prompts and generations added to a frame. Values that are no texts are written as Python's str() does."""
    asked = df.withColumns({"inputs": F.col(inputs), "prompts": process_prompt(X.python_text(df, inputs), instruction, **labels)})
    return generated(asked, "prompts", model, post_process=post_process, output_type=output_type)


def packed_prompts(
    df: DataFrame, out: str, begin: Column | None, examples: Column, end: Column | None, sep: str = "\n", budget: int | None = None,
    min_examples: int | None = None, max_examples: int | None = None, count: Callable[[str], int] | None = None,
) -> DataFrame:
    """A column out: begin, as many examples as fit, end, joined by sep; null parts are left out.

    Examples are tried in order; one that doesn't fit the budget of tokens is skipped. Fewer than min_examples is an error, as
    is a prompt that is too long without any. Without a budget this is one expression of the plan.
    """
    null = F.lit(None).cast("string")
    if budget is None:
        chosen = F.slice(examples, 1, max_examples) if max_examples is not None else examples
        prompt = F.array_join(F.filter(F.concat(F.array(begin if begin is not None else null), chosen, F.array(end if end is not None else null)), lambda p: p.isNotNull()), sep)
        if min_examples:
            prompt = F.when(F.size(chosen) < min_examples, F.raise_error(F.lit("too few examples")).cast("string")).otherwise(prompt)
        return df.withColumn(out, prompt)
    tokens = count or (lambda s: len(s.split()))
    staged = df.withColumns({"__b": begin if begin is not None else null, "__x": examples, "__e": end if end is not None else null, out: null})

    def pack(b: str | None, xs: list[str], e: str | None) -> str:
        least = 1 if min_examples is None and xs else (min_examples or 0)
        whole = lambda ys: sep.join(p for p in (b, *ys, e) if p is not None)
        if tokens(whole([])) > budget:
            raise ValueError("a prompt is longer than the model takes")
        ys: list[str] = []
        for x in xs or []:
            if max_examples is not None and len(ys) >= max_examples:
                break
            if tokens(whole([*ys, x])) <= budget:
                ys.append(x)
        if len(ys) < least:
            raise ValueError(f"only {len(ys)} examples fit; {least} are needed")
        return whole(ys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prompts = [pack(*row) for row in zip(*(batch.column(c).to_pylist() for c in ("__b", "__x", "__e")))]
            i = batch.schema.get_field_index(out)
            yield batch.set_column(i, out, pa.array(prompts, pa.string()))

    return staged.mapInArrow(run, staged.schema).drop("__b", "__x", "__e")


def example_text(inputs: Column, outputs: Column, input_label: str = "Input:", output_label: str = "Output:", sep: str = "\n") -> Column:
    return F.concat_ws(sep, X.labelled(input_label, inputs), X.labelled(output_label, outputs))


def few_shot_prompts(df: DataFrame, inputs: str, examples: list[tuple[Any, Any]], instruction: str | None = None, out: str = "prompts", sep: str = "\n", input_label: str = "Input:", output_label: str = "Output:", **pack: Any) -> DataFrame:
    """Prompts of fixed examples, which the user gives as a list, and each row's input."""
    shown = F.array(*(F.lit(f"{input_label} {a}{sep}{output_label} {b}") for a, b in examples)) if examples else F.array().cast("array<string>")
    begin = F.lit(instruction + sep) if instruction is not None else None
    end = F.concat_ws(sep, X.labelled(input_label, X.python_text(df, inputs)), F.lit(output_label))
    return packed_prompts(df, out, begin, shown, end, sep, **pack)


def few_shot_prompts_retrieved(df: DataFrame, inputs: str, vectors: str, examples: DataFrame, k: int, instruction: str | None = None, out: str = "prompts", sep: str = "\n", **pack: Any) -> DataFrame:
    """Prompts of the k examples (POS, example_input, example_output, embedding) nearest to each row, best first. df: POS and a column of vectors."""
    found = top_k(df.select(F.col(POS).alias("query"), F.col(vectors).alias("embedding")), examples.select(F.col(POS).alias("item"), "embedding"), k)
    shown = example_text(X.python_text(examples, "example_input"), X.python_text(examples, "example_output"), sep=sep)
    lists = found.join(examples.select(F.col(POS).alias("item"), shown.alias("__t")), "item").groupBy("query").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "__t"))), lambda x: x["__t"]).alias("__list"))
    with_lists = df.join(lists, df[POS] == lists["query"], "left").drop("query").withColumn("__list", F.coalesce("__list", F.array().cast("array<string>")))
    begin = F.lit(instruction + sep) if instruction is not None else None
    end = F.concat_ws(sep, X.labelled("Input:", X.python_text(df, inputs)), F.lit("Output:"))
    return packed_prompts(with_lists, out, begin, F.col("__list"), end, sep, **pack).drop("__list")


def rag_prompts(df: DataFrame, prompts: str, results: str = "results", out: str = "rag_prompts", begin: str | None = None, sep: str = "\n", **pack: Any) -> DataFrame:
    """Prompts of the retrieved texts (results: struct with texts) and the question."""
    documents = F.transform(F.col(results)["texts"], lambda t: F.concat(F.lit("Document: "), t))
    end = F.concat(F.lit(sep + "Question: "), F.col(prompts))
    return packed_prompts(df, out, F.lit(begin) if begin is not None else None, documents, end, sep, **pack)


def data_from_prompt(spark: SparkSession, instruction: str, n: int, seed: int | None = None) -> DataFrame:
    """n copies of an instruction, each with its own seed."""
    return spark.range(n).select(F.lit(instruction).alias("prompts"), (F.col("id") if seed is None else F.concat_ws(",", F.lit(seed), "id")).cast("string").alias("seed"), F.col("id").alias(POS))


def attributed_prompts(spark: SparkSession, instruction: str, attributes: dict[str, list[str]] | list[dict[str, str]], n: int) -> DataFrame:
    """n prompts: the combinations of attributes, or the list given, again and again; the k-th use of one has the seed k."""
    variables = X.template_variables(instruction)
    keys = list(attributes) if isinstance(attributes, dict) else sorted({k for a in attributes for k in a}, key=variables.index if variables else None)
    if set(keys) != set(variables):
        raise ValueError(f"The instruction has the variables {sorted(variables)}, the attributes are {sorted(keys)}.")
    combos = attribute_product(spark, attributes) if isinstance(attributes, dict) else spark.createDataFrame([(i, *(a[k] for k in keys)) for i, a in enumerate(attributes)], ", ".join(["combination bigint", *(f"`{k}` string" for k in keys)]))
    m = len(list(itertools.product(*attributes.values()))) if isinstance(attributes, dict) else len(attributes)
    rows = spark.range(n).withColumn("combination", F.pmod("id", F.lit(m))).withColumn("seed", F.floor(F.col("id") / m)).join(combos, "combination")
    return rows.select(F.struct(*(f"`{k}`" for k in keys)).alias("attributes"), X.filled(instruction, {k: F.col(f"`{k}`") for k in keys}).alias("prompts"), "seed", F.col("id").alias(POS))


def filter_with_prompt(df: DataFrame, inputs: str, model: Model, instruction: str, condition: Callable[[Column], Column] = X.says_yes, **labels: Any) -> DataFrame:
    """The rows the model says yes to; the columns stay as they were."""
    asked = with_model(df.withColumn("__prompt", process_prompt(X.python_text(df, inputs), instruction, **labels)), "__prompt", "__answer", model)
    return asked.filter(condition(F.col("__answer"))).drop("__prompt", "__answer")


def rank_with_prompt(df: DataFrame, inputs: str, model: Model, instruction: str, reverse: bool = True, threshold: float | None = None, score: Callable[[Column], Column] = X.parsed_score, **labels: Any) -> DataFrame:
    """The rows with scores the model gives, sorted (best first unless reverse is False), those below the threshold left out.

    With a threshold, an answer without a number is an error when it is read, as there is nothing to compare; without one its score is null and sorts last.
    """
    from weftline.operators.order import sort

    asked = with_model(df.withColumn("__prompt", process_prompt(X.python_text(df, inputs), instruction, **labels)), "__prompt", "__answer", model)
    scored = asked.withColumn("scores", score(F.col("__answer"))).drop("__prompt", "__answer")
    scored = scored if isinstance(model, Expression) else materialised(scored)  # so that sampling, sorting and numbering ask the model nothing
    if threshold is not None:
        scored = scored.withColumn("scores", F.coalesce("scores", F.raise_error(F.lit("an answer has no score")).cast("double"))).filter(F.col("scores") >= threshold)
        scored = densified(scored)
    return sort(scored, "scores", reverse=reverse)


#: Rows up to which the judge's draws may be those of Python's generators: the driver draws them one by one.
SEQUENCE_ROWS = 10_000_000


def swap_flags(df: DataFrame, n: int, randomize: bool = True, seed: int = 1, draws: str = "sequence") -> Column:
    """Whether a row's pair is shown in the other order. draws: 'sequence' for those of Python's generator, 'hash' for hashes of positions."""
    if draws not in ("sequence", "hash"):
        raise ValueError("draws is 'sequence' or 'hash'.")
    if not randomize:
        return F.lit(False)
    if draws == "hash":
        return F.pmod(F.xxhash64(F.lit(seed), POS), F.lit(2)) == 1
    if n > SEQUENCE_ROWS:
        raise ValueError(f"A sequence is drawn for {SEQUENCE_ROWS} rows at most; ask for draws='hash'.")
    r = Random(seed)
    bits = bytearray(-(-n // 8) or 1)
    for i in range(n):
        if r.randint(0, 1) == 1:
            bits[i // 8] |= 1 << (i % 8)
    place = F.expr(f"conv(hex(substring(unhex('{bytes(bits).hex()}'), cast({POS} div 8 + 1 as int), 1)), 16, 10)").cast("int")
    return F.pmod(F.floor(place / F.pow(F.lit(2), F.pmod(F.col(POS), F.lit(8)))), F.lit(2)) == 1


#: Fixed value: what the judge is asked if nothing else is said.
ASKED = "Which {} is better? Respond with '{}' or '{}'."


def judge_pairs(
    df: DataFrame, a: str, b: str, model: Model, n: int, instruction: str | None = None, prompts: str | None = None, a_label: str | None = None, b_label: str | None = None,
    instruction_label: str | None = "Instruction:", randomize: bool = True, sep: str = "\n", draws: str = "sequence", judgement_func: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """judge_prompts, judge_generations and judgements (the label of the better one) added. n is the number of rows, positions are dense.

    With prompts, each pair is shown under its prompt and called Response A and Response B. draws: how pairs are swapped and
    unclear answers decided, see swap_flags(); in a sequence the k-th unclear row takes the k-th draw. judgement_func makes
    the judgement of the answer and whether the pair was swapped.
    """
    a_label, b_label = a_label or ("Response A:" if prompts else "Input A:"), b_label or ("Response B:" if prompts else "Input B:")
    label_a, label_b = X.clean_label(a_label), X.clean_label(b_label)
    instruction = instruction or ASKED.format("response" if prompts else "input", label_a, label_b)
    swapped = swap_flags(df, n, randomize, draws=draws)
    of_a, of_b = X.python_text(df, a), X.python_text(df, b)
    first, second = F.when(swapped, of_b).otherwise(of_a), F.when(swapped, of_a).otherwise(of_b)
    shown = F.concat(X.labelled(a_label, first), F.lit(sep * 2), X.labelled(b_label, second))
    if prompts:
        shown = F.concat(X.labelled("Prompt:", F.col(prompts)), F.lit(sep * 2), shown)
    prompt = F.concat_ws(sep, shown, F.lit(sep + (f"{instruction_label} {instruction}" if instruction_label else instruction)))
    asked = with_model(df.withColumn("judge_prompts", prompt).withColumn("__swapped", swapped), "judge_prompts", "judge_generations", model)
    if judgement_func is not None:
        return asked.withColumn("judgements", judgement_func(F.col("judge_generations"), F.col("__swapped"))).drop("__swapped")
    has_a, has_b = F.col("judge_generations").contains(label_a), F.col("judge_generations").contains(label_b)
    unclear = asked.withColumn("__unclear", F.coalesce(has_a == has_b, F.lit(True)))
    if draws == "hash":
        other = F.pmod(F.xxhash64(F.lit(0), POS), F.lit(2)) == 1
    else:
        # Unclear rows are numbered within blocks of positions, the blocks by a small table.
        unclear = unclear if isinstance(model, Expression) else materialised(unclear)
        unclear = unclear.withColumn("__block", F.floor(F.col(POS) / BLOCK))
        counts = unclear.groupBy("__block").agg(F.count_if("__unclear").alias("__n"))
        before = counts.select("__block", (F.sum("__n").over(Window.orderBy("__block")) - F.col("__n")).alias("__before"))
        within = F.sum(F.col("__unclear").cast("int")).over(Window.partitionBy("__block").orderBy(POS)) - 1
        unclear = unclear.withColumn("__k", within).join(before, "__block").withColumn("__k", F.greatest(F.col("__k") + F.col("__before"), F.lit(0)))
        r = Random(0)
        sequence = "".join(str(r.randint(0, 1)) for _ in range(n)) or "0"
        other = F.substring(F.lit(sequence), (F.col("__k") + 1).cast("int"), F.lit(1)) == "1"
    decided = X.judgement(F.col("judge_generations"), label_a, label_b, F.col("__swapped"), F.when(other, label_b).otherwise(label_a))
    return unclear.withColumn("judgements", decided).drop("__swapped", "__unclear", "__block", "__k", "__before")
