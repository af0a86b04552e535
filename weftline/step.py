"""Steps: named frames with an order, lineage and a fingerprint, and the operators on them as methods."""

from __future__ import annotations

import inspect
import itertools
import os
import warnings
from collections.abc import Callable, Iterable
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from weftline import ingest
from weftline.fingerprint import files_state, fingerprint
from weftline.functions import cards
from weftline.functions import text as X
from weftline.models import Expression, Model, with_model, with_model_memoised
from weftline.operators import combine, order, rows
from weftline.plans import prompts as P
from weftline.plans.tasks import Retriever, cosine_similarity, embed, run_task_model
from weftline.position import POS, densified, visible
from weftline.session import Session
from weftline.sources import files, sinks
from weftline.storage import Files, materialised

# The types of entries of a data card.
CARD_TYPES = ("Date & Time", "Dataset Name", "Model Name", "URL", "Dataset Card", "Model Card", "License Information", "Citation Information")
#: A number above all positions of a source whose number of rows isn't known.
BOUND = 1 << 40


class ColumnRef:
    """One column of a step."""

    def __init__(self, step: Step, name: str) -> None:
        if name not in step.columns:
            raise KeyError(name)
        self.step, self.name = step, name

    @property
    def fingerprint(self) -> str:
        return fingerprint(self.step.fingerprint, self.name)

    def __getitem__(self, i: int) -> Any:
        return self.step[i][self.name]

    def __iter__(self):
        return iter(sinks.to_dict(rows.select_columns(self.step.kept, self.name))[self.name])

    def __len__(self) -> int:
        return self.step.num_rows


class Step:
    """A frame with positions. Operators build on its plan, and most run nothing before an export, a count or save().

    sort, shuffle and rank_with_prompt write their rows when they are called, since their positions depend on all rows. What a
    model or Python function has made is written before it is counted or numbered, so it is made once.
    """

    def __init__(
        self, name: str, df: DataFrame, *, dense: bool = True, num_rows: int | None = None, parts: Iterable[Any] = (), card: dict[str, Any] | None = None,
        parents: Iterable[Step] = (), lazy: bool = True, session: Session | None = None, costly: bool = False, bound: int | None = None,
    ) -> None:
        self.session = session or Session.active
        if self.session is None:
            raise RuntimeError("No session is active.")
        if df.isStreaming and POS in df.columns:
            raise ValueError("A stream has no order of rows; see weftline.streaming.")
        if self.session.parents and not self.session.composite:
            raise RuntimeError(f"Step '{self.session.parents[-1]}' is no CompositeStep, so it makes no steps of its own.")
        self.name = self.session.unique(name)
        self.parents = list(parents)
        self.fingerprint = fingerprint(type(self).__name__, *parts, [p.fingerprint for p in self.parents])
        self._frame, self._dense, self._rows, self.lazy, self._costly = df, dense, num_rows, lazy, costly
        self._bound = (num_rows if num_rows is not None else BOUND) if dense and bound is None else bound
        self.card: dict[str, dict[str, list[Any]]] = {}
        for p in self.parents:
            for of, kinds in p.card.items():
                for kind, values in kinds.items():
                    self.card.setdefault(of, {}).setdefault(kind, [])
                    self.card[of][kind] += [v for v in values if v not in self.card[of][kind]]
        for kind, value in (card or {}).items():
            self.card.setdefault(self.name, {}).setdefault(kind, []).append(value)
        self.saved = False
        self.session.steps[self.name] = self
        if costly and self.session.saves:
            self.save()

    # What a step is

    @property
    def frame(self) -> DataFrame:
        return self._frame

    @property
    def kept(self) -> DataFrame:
        """The frame, written first if a model or a Python function makes it."""
        if self._costly:
            self._frame, self._costly = materialised(self._frame), False
        return self._frame

    @property
    def dense(self) -> DataFrame:
        """The frame with positions from 0 without gaps."""
        if not self._dense:
            self._frame, self._dense, self._bound = densified(self.kept), True, BOUND
        return self._frame

    @property
    def columns(self) -> list[str]:
        return visible(self._frame)

    @property
    def schema(self):
        return self._frame.drop(POS).schema

    @property
    def declared_rows(self) -> int | None:
        """The number of rows if it is known without counting."""
        return self._rows

    @property
    def num_rows(self) -> int:
        if self._rows is None:
            self._rows = self.kept.count()
        return self._rows

    def __len__(self) -> int:
        return self.num_rows

    def __getitem__(self, key: Any) -> Any:
        if isinstance(key, str):
            return ColumnRef(self, key)
        if isinstance(key, int):
            key = key if key >= 0 else self.num_rows + key
            found = self.dense.filter(F.col(POS) == key).drop(POS).toArrow().to_pylist()
            if not found:
                raise IndexError(key)
            return found[0]
        if isinstance(key, slice):
            start, stop, step = key.indices(self.num_rows)
            key = range(start, stop, step)
        return sinks.to_list(order.select(self.dense, key, self.num_rows))

    def __repr__(self) -> str:
        return f"{type(self).__name__}(name={self.name!r}, columns={self.columns}, rows={'unknown' if self._rows is None else self._rows}, fingerprint={self.fingerprint[:12]})"

    def register_data_card(self, kind: str, value: Any) -> None:
        if kind not in CARD_TYPES:
            raise ValueError(f"A data card has the types {CARD_TYPES}.")
        self.card.setdefault(self.name, {}).setdefault(kind, []).append(value)

    def data_card(self) -> dict[str, dict[str, list[Any]]]:
        return self.card

    def _next(self, operation: str, df: DataFrame, *parts: Any, dense: bool | None = None, num_rows: int | None = None, parents: Iterable[Step] = (), name: str | None = None, costly: bool | None = None) -> Step:
        base, dense = self.name.rpartition(" / ")[2], self._dense if dense is None else dense
        return Step(
            name or f"{base} ({operation})", df, dense=dense, num_rows=num_rows, parts=(operation, *parts), parents=[self, *parents], session=self.session,
            costly=self._costly if costly is None else costly, bound=None if dense else self._bound,
        )

    # Projection, filters and functions

    def select_columns(self, columns: str | Iterable[str], name: str | None = None) -> Step:
        wanted = rows.names(columns)
        return self._next("select_columns", rows.select_columns(self._frame, wanted), wanted, num_rows=self._rows, name=name)

    def remove_columns(self, columns: str | Iterable[str], name: str | None = None) -> Step:
        return self._next("remove_columns", rows.remove_columns(self._frame, columns), rows.names(columns), num_rows=self._rows, name=name)

    def rename_column(self, original: str, new: str, name: str | None = None) -> Step:
        return self.rename_columns({original: new}, name)

    def rename_columns(self, mapping: dict[str, str], name: str | None = None) -> Step:
        return self._next("rename_columns", rows.rename_columns(self._frame, mapping), mapping, num_rows=self._rows, name=name)

    def map(self, function: Callable[..., Any] | dict[str, Column], schema: Any = None, *, with_indices: bool = False, batched: bool = False, remove_columns: Any = None, total_num_rows: int | None = None, name: str | None = None, key: Any = None, **options: Any) -> Step:
        """Expressions ({name: Column}), or a Python function with the schema of what it returns. key replaces the function in the fingerprint."""
        if isinstance(function, dict):
            df = rows.map_columns(self._frame, function, rows.names(remove_columns or []))
            return self._next("map", df, {k: str(v) for k, v in function.items()}, num_rows=self._rows, name=name)
        if schema is None:
            raise ValueError("A Python function needs the schema of the columns it returns.")
        base = self.dense if with_indices else self._frame
        df = rows.map_rows(base, function, schema, with_indices=with_indices, batched=batched, remove=remove_columns, **options)
        known = total_num_rows if total_num_rows is not None else (None if batched else self._rows)
        return self._next("map", df, key or function, str(schema), with_indices, batched, options, dense=self._dense and not batched, num_rows=known, name=name, costly=True)

    def filter(self, condition: Column | str | Callable[..., Any], *, with_indices: bool = False, total_num_rows: int | None = None, name: str | None = None, key: Any = None, **options: Any) -> Step:
        if isinstance(condition, (Column, str)):
            df, costly = self._frame.filter(condition), None
        else:
            costly = True
            df = rows.filter_rows(self.dense if with_indices else self._frame, condition, with_indices=with_indices, **options)
        return self._next("filter", df, key or (str(condition) if isinstance(condition, (Column, str)) else condition), with_indices, options, dense=False, num_rows=total_num_rows, name=name, costly=costly)

    def cast_column(self, column: str, kind: str, name: str | None = None) -> Step:
        return self._next("cast_column", rows.cast_column(self._frame, column, kind), column, kind, num_rows=self._rows, name=name)

    def sql(self, query: str, name: str | None = None) -> Step:
        """Any SQL over the rows, as the table {step}; the result is in the order of its own sort key only if it keeps __pos."""
        df = self.session.spark.sql(query, step=self._frame)
        out = self._next("sql", df if POS in df.columns else df.withColumn(POS, F.monotonically_increasing_id()), query, dense=False, name=name)
        out._bound = None
        return out

    # Order

    def select(self, indices: Iterable[int], name: str | None = None) -> Step:
        wanted = indices if isinstance(indices, range) else list(indices)
        return self._next("select", order.select(self.dense, wanted, self._rows), wanted, dense=True, num_rows=len(wanted), name=name)

    def take(self, n: int, name: str | None = None) -> Step:
        known = None if self._rows is None else min(n, self._rows)
        df = order.take_dense(self._frame, n) if self._dense else order.take(self._frame, n)
        return self._next("take", df, n, num_rows=known, name=name)

    def skip(self, n: int, name: str | None = None) -> Step:
        return self._next("skip", order.skip(self.dense, n), n, dense=True, num_rows=None if self._rows is None else max(0, self._rows - n), name=name)

    def sort(self, columns: str | Iterable[str], reverse: bool | list[bool] = False, null_placement: str = "at_end", name: str | None = None) -> Step:
        return self._next("sort", order.sort(self.kept, columns, reverse, null_placement), rows.names(columns), reverse, null_placement, dense=True, num_rows=self._rows, name=name, costly=False)

    def top(self, columns: str | Iterable[str], n: int, reverse: bool | list[bool] = False, null_placement: str = "at_end", name: str | None = None) -> Step:
        return self._next("top", order.top(self._frame, columns, n, reverse, null_placement), rows.names(columns), n, reverse, null_placement, dense=True, name=name)

    def shuffle(self, seed: int = 0, exact: bool = False, buffer_size: int | None = None, name: str | None = None) -> Step:
        """A permutation of all rows, or with buffer_size of the rows within each window of so many."""
        if buffer_size is not None:
            return self._next("shuffle", order.shuffle_within(self.dense, buffer_size, seed), seed, buffer_size, dense=True, num_rows=self._rows, name=name)
        df = order.shuffle_exact(self.dense, self.num_rows, seed) if exact else order.shuffle(self.kept if self._dense else self.dense, seed)
        return self._next("shuffle", df, seed, exact, dense=True, num_rows=self._rows, name=name, costly=False)

    def reverse(self, name: str | None = None) -> Step:
        return self._next("reverse", order.reverse(self.dense, self.num_rows), dense=True, num_rows=self._rows, name=name)

    def shard(self, num_shards: int, index: int, contiguous: bool = False, name: str | None = None) -> Step:
        df = order.shard(self.dense, num_shards, index, contiguous, self.num_rows if contiguous else None)
        return self._next("shard", df, num_shards, index, contiguous, dense=True, name=name)

    def splits(self, train_size: Any = None, validation_size: Any = None, test_size: Any = None, stratify_by_column: str | None = None) -> dict[str, Step]:
        if stratify_by_column is not None:
            marked = order.stratified(self.dense, stratify_by_column, train_size or 0.0, validation_size or 0.0, test_size or 0.0)
            frames = {s: marked.filter(F.col("split") == s).drop("split") for s, size in (("train", train_size), ("validation", validation_size), ("test", test_size)) if size}
            return {s: self._next(f"{s} split", f, s, train_size, validation_size, test_size, stratify_by_column, dense=False) for s, f in frames.items()}
        sizes = order.split_sizes(self.num_rows, train_size, validation_size, test_size)
        return {s: self._next(f"{s} split", f, s, sizes, dense=True, num_rows=sizes[s]) for s, f in order.splits(self.dense, sizes).items()}

    def add_item(self, item: dict[str, Any], name: str | None = None) -> Step:
        return self._next("add_item", combine.add_item(self.dense, item, self.num_rows), item, dense=True, num_rows=self.num_rows + 1, name=name)

    # Models

    def generate(self, column: str, model: Model, out: str = "generations", cache: bool = False, name: str | None = None, **options: Any) -> Step:
        """A model's output for a column; with cache, each input is run once over all runs of the session's folder."""
        if cache:
            path = None if self.session.in_memory else os.path.join(self.session.path, ".cache", X.safe_name(f"{model.name}-{model.version}"))
            df = with_model_memoised(self._frame, column, out, model, path, **options)
        else:
            df = with_model(self._frame, column, out, model, **options)
        return self._asked("generate", df, model, column, out, options, name=name)

    def _asked(self, operation: str, df: DataFrame, model: Model, *parts: Any, num_rows: bool = True, name: str | None = None, parents: Iterable[Step] = (), **more: Any) -> Step:
        """A step whose rows a model has made."""
        costly = None if isinstance(model, Expression) else True
        step = self._next(operation, df, model, *parts, num_rows=self._rows if num_rows else None, name=name, parents=parents, **({"costly": costly} | more))
        step.register_data_card("Model Name", model.name)
        return step

    def prompt(self, prompts: str, model: Model, name: str | None = None, **options: Any) -> Step:
        """Columns prompts and generations: the model's answers to prompts as they are."""
        df = self._frame.withColumn("prompts", F.col(prompts)) if prompts != "prompts" else self._frame
        return self._asked("prompt", P.generated(df, "prompts", model, **options), model, prompts, options, name=name)

    def process_with_prompt(self, inputs: str, model: Model, instruction: str, name: str | None = None, **options: Any) -> Step:
        return self._asked("process_with_prompt", P.process_with_prompt(self._frame, inputs, model, instruction, **options), model, inputs, instruction, options, name=name)

    def few_shot_prompt(self, inputs: str, model: Model, examples: list[tuple[Any, Any]], instruction: str | None = None, post_process: Any = None, output_type: str | None = None, name: str | None = None, **pack: Any) -> Step:
        """Columns prompts and generations: fixed examples, a list of (input, output), before each input."""
        df = P.generated(P.few_shot_prompts(self._frame, inputs, examples, instruction, **pack), "prompts", model, post_process=post_process, output_type=output_type)
        return self._asked("few_shot_prompt", df, model, inputs, examples, instruction, post_process, pack, name=name)

    def few_shot_prompt_with_retrieval(
        self, inputs: str, model: Model, examples: Step, example_inputs: str, example_outputs: str, embedder: Model, k: int = 5, instruction: str | None = None,
        post_process: Any = None, output_type: str | None = None, name: str | None = None, **pack: Any,
    ) -> Step:
        """Columns prompts and generations: before each input the k examples nearest to it by an embedder, best first."""
        known = examples.dense.select(POS, F.col(example_inputs).alias("example_input"), F.col(example_outputs).alias("example_output"))
        known = materialised(embed(known.withColumn("__t", X.python_text(known, "example_input")), "__t", embedder, "embedding").drop("__t"))
        mine = materialised(embed(self.dense.withColumn("__t", X.python_text(self.dense, inputs)), "__t", embedder, "__vector").drop("__t"))
        df = P.few_shot_prompts_retrieved(mine, inputs, "__vector", known, k, instruction, **pack).drop("__vector")
        df = P.generated(df, "prompts", model, post_process=post_process, output_type=output_type)
        return self._asked("few_shot_prompt_with_retrieval", df, model, inputs, example_inputs, example_outputs, embedder, k, instruction, post_process, pack, parents=[examples], name=name)

    def rag_prompt(self, prompts: str, model: Model, retriever: Retriever, k: int = 5, begin: str | None = None, post_process: Any = None, output_type: str | None = None, name: str | None = None, **pack: Any) -> Step:
        """Columns rag_prompts and generations: the k texts a retriever finds before each question."""
        found = retriever.retrieve(self.dense, prompts, k, "__results")
        df = P.rag_prompts(found, prompts, "__results", "rag_prompts", begin, **pack).drop("__results")
        df = P.generated(df, "rag_prompts", model, post_process=post_process, output_type=output_type)
        return self._asked("rag_prompt", df, model, prompts, retriever, k, begin, post_process, pack, name=name)

    def filter_with_prompt(self, inputs: str, model: Model, instruction: str, name: str | None = None, **options: Any) -> Step:
        return self._asked("filter_with_prompt", P.filter_with_prompt(self._frame, inputs, model, instruction, **options), model, inputs, instruction, options, num_rows=False, dense=False, name=name)

    def rank_with_prompt(self, inputs: str, model: Model, instruction: str, reverse: bool = True, threshold: float | None = None, name: str | None = None, **options: Any) -> Step:
        df = P.rank_with_prompt(self._frame, inputs, model, instruction, reverse, threshold, **options)
        return self._asked("rank_with_prompt", df, model, inputs, instruction, reverse, threshold, options, num_rows=threshold is None, dense=True, costly=False, name=name)

    def judge_pairs(self, a: str, b: str, model: Model, name: str | None = None, **options: Any) -> Step:
        return self._asked("judge_pairs", P.judge_pairs(self.dense, a, b, model, self.num_rows, **options), model, a, b, options, dense=True, name=name)

    def judge_generation_pairs(self, prompts: str, a: str, b: str, model: Model, name: str | None = None, **options: Any) -> Step:
        """judge_pairs() of two answers to one prompt."""
        return self._asked("judge_generation_pairs", P.judge_pairs(self.dense, a, b, model, self.num_rows, prompts=prompts, **options), model, prompts, a, b, options, dense=True, name=name)

    def embed(self, texts: str, model: Model, out: str = "embeddings", name: str | None = None, **options: Any) -> Step:
        return self._asked("embed", embed(self._frame, texts, model, out, **options), model, texts, out, options, name=name)

    def cosine_similarity(self, a: str, b: str, model: Model | None = None, out: str = "similarities", name: str | None = None, **options: Any) -> Step:
        """The cosine of two columns row by row; texts are embedded first."""
        df = cosine_similarity(self._frame, a, b, model, out, **options)
        return self._asked("cosine_similarity", df, model, a, b, out, name=name) if model else self._next("cosine_similarity", df, a, b, out, num_rows=self._rows, name=name)

    def retriever(self, texts: str, model: Model, **options: Any) -> Retriever:
        """An exact index of a column of texts; results name rows by their positions here."""
        return Retriever(self.dense, texts, model, **options)

    def retrieve(self, queries: str, retriever: Retriever, k: int = 5, out: str = "results", name: str | None = None) -> Step:
        """A column of results: struct of indices, texts and scores of the k best, best first."""
        return self._next("retrieve", retriever.retrieve(self.dense, queries, k, out), queries, retriever, k, out, dense=True, num_rows=self._rows, name=name)

    def run_task_model(self, texts: str, model: Model, out: str = "results", name: str | None = None, **options: Any) -> Step:
        return self._asked("run_task_model", run_task_model(self._frame, texts, model, out, **options), model, texts, out, options, name=name)

    # Saving and exports

    def save(self, name: str | None = None) -> Step:
        """The rows materialised under the step's name, or an equal earlier result read again."""
        if self.session.in_memory:
            self._frame, self._dense, self.lazy, self.saved, self._costly = materialised(self._frame), self._dense, False, True, False
            return self
        at = name or self.name
        meta = self.session.found(at, self.fingerprint)
        if meta:
            df, n, dense, bound = self.session.load(at), meta["num_rows"], meta.get("dense", True), meta.get("bound")
        else:
            dense, bound = self._dense, self._bound
            df, n = self.session.save(at, self._frame, {"name": at, "fingerprint": self.fingerprint, "columns": self.columns, "schema": self.schema.jsonValue(), "data_card": self.card, "dense": dense, "bound": bound})
        self._frame, self._rows, self._dense, self._bound, self.lazy, self.saved, self._costly = df, n, dense, bound, False, True, False
        return self

    def copy(self, name: str | None = None) -> Step:
        return self._next("copy", self._frame, num_rows=self._rows, name=name)

    def _frames(self, train_size: Any, validation_size: Any, test_size: Any) -> dict[str, DataFrame]:
        if not (train_size or validation_size or test_size):
            return {"train": self.kept if self._costly and not self._dense else self._frame}
        return order.splits(self.dense, order.split_sizes(self.num_rows, train_size, validation_size, test_size))

    def _export(self, sizes: tuple[Any, Any, Any], one: Callable[[DataFrame], Any]) -> Any:
        frames = self._frames(*sizes)
        return one(frames["train"]) if len(frames) == 1 and "train" in frames else {s: one(f) for s, f in frames.items()}

    def export_to_dict(self, train_size: Any = None, validation_size: Any = None, test_size: Any = None) -> dict[str, Any]:
        return self._export((train_size, validation_size, test_size), sinks.to_dict)

    def export_to_list(self, train_size: Any = None, validation_size: Any = None, test_size: Any = None) -> Any:
        return self._export((train_size, validation_size, test_size), sinks.to_list)

    def export_to_json(self, path: str, train_size: Any = None, validation_size: Any = None, test_size: Any = None) -> Any:
        return sinks.by_split(self._frames(train_size, validation_size, test_size), path, sinks.to_json)

    def export_to_csv(self, path: str, sep: str = ",", train_size: Any = None, validation_size: Any = None, test_size: Any = None) -> Any:
        return sinks.by_split(self._frames(train_size, validation_size, test_size), path, lambda df, p: sinks.to_csv(df, p, sep))

    def export_to_dataset(self, path: str, train_size: Any = None, validation_size: Any = None, test_size: Any = None, num_shards: int | None = None) -> Any:
        frames = self._frames(train_size, validation_size, test_size)
        if len(frames) == 1:
            return sinks.to_parquet(frames.popitem()[1], path, num_shards)
        return {s: sinks.to_parquet(f, os.path.join(path, s), num_shards) for s, f in frames.items()}

    def export_for_hub(self, folder: str, synthetic: bool = False, **sizes: Any) -> str:
        """A folder to upload: Parquet files by split, a card with licences, size and lineage."""
        self.export_to_dataset(os.path.join(folder, "data"), **sizes)
        n = self.num_rows
        size = self.session.spark.range(1).select(X.size_category(F.lit(n)).alias("s")).first()["s"]
        self.session.files.write(f"{folder}/README.md", cards.written_card(self.name, n, size, self.card, synthetic, self.preview()))
        return folder

    def save_in_background(self, name: str | None = None):
        """save() on a thread of its own; the future's result() waits for it."""
        return self.session.pool.submit(self.save, name)

    def observed(self) -> tuple[Step, Observation]:
        """The same rows, and an observation that has their number once an action has written or read them in one pass (a sort samples its input first, which counts too)."""
        seen = Observation(f"rows of {self.name}")
        return self._next("observed", self._frame.observe(seen, F.count(F.lit(1)).alias("rows")), num_rows=self._rows), seen

    def preview(self, n: int = 3) -> dict[str, list[Any]]:
        """The first values of each column."""
        return sinks.preview(self.dense, n)

    def head(self, n: int = 5, shuffle: bool = False, seed: int = 0):
        return sinks.head(order.shuffle(self.dense, seed) if shuffle else self._frame, n)


def _of(values: tuple[Any, ...]) -> list[Step]:
    if not values:
        raise ValueError("At least one step is needed.")
    if not all(isinstance(v, Step) for v in values):
        raise TypeError("Only steps can be put together.")
    return list(values)


def concat(*steps: Step, name: str = "concat") -> Step:
    """All rows of all steps, in the order of the steps; columns a step lacks are null."""
    steps = tuple(_of(steps))
    known = [s.declared_rows for s in steps]
    bounds = [s._bound for s in steps]
    placed = None not in bounds and sum(bounds) < 1 << 62
    df = combine.concat(*(s.frame if placed else s.kept for s in steps), bounds=bounds)
    dense = not placed or all(s._dense and k is not None for s, k in zip(steps, known))
    return Step(name, df, dense=dense, num_rows=None if None in known else sum(known), parts=("concat",), parents=steps, costly=placed and any(s._costly for s in steps), bound=sum(bounds) if placed else None)


def zipped(*steps: Step, lazy: bool = True, name: str = "zipped") -> Step:
    """Columns side by side; lazy fills up shorter steps with nulls, otherwise other numbers of rows are an error."""
    steps = tuple(_of(steps))
    frames = [s.dense for s in steps]
    if not lazy:
        counts = {s.num_rows for s in steps}
        if len(counts) > 1:
            raise ValueError(f"The steps have different numbers of rows: {sorted(counts)}.")
        return Step(name, combine.zipped_shortest(*combine._renamed(frames, False)), num_rows=counts.pop(), parts=("zipped", lazy), parents=steps)
    known = [s.declared_rows for s in steps]
    return Step(name, combine.zipped_padded(*frames), num_rows=None if None in known else max(known), parts=("zipped", lazy), parents=steps)


def data_source(name: str, data: Any, total_num_rows: int | None = None, columns: Iterable[str] | None = None) -> Step:
    """A step of Python values, an Arrow table, a DataFrame, or a generator function of rows: it is read when this is called, and written a part at a time."""
    session = Session.active
    if isinstance(data, DataFrame):
        if POS in data.columns:
            return Step(name, data, num_rows=total_num_rows, parts=("frame", data.semanticHash()))
        return Step(name, data.withColumn(POS, F.monotonically_increasing_id()), dense=False, num_rows=total_num_rows, parts=("frame", data.semanticHash()))
    if inspect.isfunction(data):
        if total_num_rows is None:
            warnings.warn("The number of rows isn't known; progress can't be shown.", stacklevel=2)
        rows_of = iter(data())
        first = list(itertools.islice(rows_of, 1))
        wanted = list(columns) if columns else (list(first[0]) if first and isinstance(first[0], dict) else [])
        fill = (lambda r: {c: r.get(c) for c in wanted} if isinstance(r, dict) else r)
        df, n = ingest.streamed(session.spark, ingest.LazyRows(lambda: (fill(x) for x in itertools.chain(first, rows_of))), wanted)
        return Step(name, df, num_rows=n, parts=("generator", data, wanted), lazy=False)
    if isinstance(data, ingest.LazyRows):
        df, n = ingest.streamed(session.spark, data, list(columns or []))
        return Step(name, df, num_rows=n, parts=("generator", data.rows, list(columns or [])), lazy=False)
    if isinstance(data, dict) and data and all(isinstance(v, dict) for v in data.values()):
        raise ValueError("A source is one table, not a dict of splits.")
    if isinstance(data, pa.Table):
        table = data
    else:
        names = list(columns) if columns else (list(data) if isinstance(data, dict) else list(dict.fromkeys(k for r in data for k in r)) if isinstance(data, list) else [])
        filled = [{n: r.get(n) for n in names} for r in data] if isinstance(data, list) and data and isinstance(data[0], dict) else data
        table = ingest.arrow_table(ingest.normalised(filled, names))
    return Step(name, ingest.frame(session.spark, table), num_rows=table.num_rows, parts=("values", str(table.schema), fingerprint(table.to_pydict())), lazy=False)


def _file_source(kind: str, name: str, df: DataFrame, paths: list[str], *parts: Any) -> Step:
    return Step(name, df, parts=(kind, files_state(Session.active.spark, paths), *parts))


def csv_source(name: str, folder: str | None = None, data_files: Any = None, sep: str = ",", **options: Any) -> Step:
    paths = files.paths(folder, data_files)
    return _file_source("csv", name, files.csv(Session.active.spark, folder, data_files, sep, **options), paths, sep, options)


def json_source(name: str, folder: str | None = None, data_files: Any = None, **options: Any) -> Step:
    paths = files.paths(folder, data_files)
    return _file_source("json", name, files.json(Session.active.spark, folder, data_files, **options), paths, options)


def text_source(name: str, folder: str | None = None, data_files: Any = None, **options: Any) -> Step:
    paths = files.paths(folder, data_files)
    return _file_source("text", name, files.text(Session.active.spark, folder, data_files, **options), paths, options)


def parquet_source(name: str, path: str, *columns: str) -> Step:
    return _file_source("parquet", name, files.parquet(Session.active.spark, path, *columns), [path], columns)


def saved_source(name: str, path: str) -> Step:
    return _file_source("saved", name, files.saved(Session.active.spark, path), [path])


def data_from_prompt(name: str, model: Model, instruction: str, n: int, seed: int | None = None, post_process: Any = None, output_type: str | None = None, **options: Any) -> Step:
    """Columns prompts and generations: n answers to one instruction, each row with its own seed."""
    df = P.generated(P.data_from_prompt(Session.active.spark, instruction, n, seed), "prompts", model, post_process=post_process, output_type=output_type, **options)
    return _made(name, df, model, n, "data_from_prompt", instruction, seed, post_process, options)


def data_from_attributed_prompt(name: str, model: Model, instruction: str, attributes: Any, n: int, post_process: Any = None, output_type: str | None = None, **options: Any) -> Step:
    """Columns attributes, prompts and generations: the instruction filled with combinations of attributes, again and again up to n."""
    df = P.generated(P.attributed_prompts(Session.active.spark, instruction, attributes, n), "prompts", model, post_process=post_process, output_type=output_type, **options)
    return _made(name, df, model, n, "data_from_attributed_prompt", instruction, attributes, post_process, options)


def _made(name: str, df: DataFrame, model: Model, n: int, *parts: Any) -> Step:
    step = Step(name, df.drop("seed"), num_rows=n, parts=(model, n, *parts), costly=not isinstance(model, Expression))
    step.register_data_card("Model Name", model.name)
    return step


def hub_source(name: str, path: str, config: str | None = None, split: str | None = None, revision: str | None = None) -> Step:
    """A local copy of a published dataset: Parquet files below path, and README.md with its licences and citations.

    revision is a folder below path; in it or in path itself, data, config and then split may be folders. Several splits
    raise ValueError unless one is chosen.
    """
    files_at = Files(Session.active.spark)
    root = f"{path}/{revision}" if revision else path
    data = f"{root}/data" if files_at.exists(f"{root}/data") else root
    data = f"{data}/{config}" if config else data
    inside = [n for n in files_at.names(data) if n in ("train", "validation", "val", "test")]
    if split is None and len(inside) > 1:
        raise ValueError(f"Choose one of the splits {inside}.")
    chosen = split or (inside[0] if inside else None)
    step = parquet_source(name, f"{data}/{chosen}" if chosen else data)
    step.register_data_card("Dataset Name", name)
    card = f"{root}/README.md"
    if files_at.exists(card):
        text = files_at.read(card)
        step.register_data_card("Dataset Card", card)
        for kind, values in (("License Information", cards.licences(text)), ("Citation Information", cards.citations(text))):
            for v in values:
                step.register_data_card(kind, v)
    return step


class CustomStep:
    """A step of one's own: subclass it, declare inputs, arguments and outputs in setup(), and return rows from run().

    run() may return a DataFrame or any value ingest.normalised() takes. Subclasses have no constructor of their own. Only a
    CompositeStep may make other steps in run().
    """

    composite = False

    def __init_subclass__(cls, **kwargs: Any) -> None:
        super().__init_subclass__(**kwargs)
        if "__init__" in cls.__dict__:
            raise TypeError("A custom step declares its inputs and arguments in setup() and has no constructor.")

    def __init__(self, name: str, inputs: dict[str, ColumnRef] | None = None, args: dict[str, Any] | None = None, outputs: dict[str, str] | None = None) -> None:
        self.name, self.inputs, self.args = name, dict(inputs or {}), dict(args or {})
        self._inputs: set[str] = set()
        self._args: dict[str, tuple[bool, Any]] = {}
        self._outputs: list[str] = []
        self.card: dict[str, Any] = {}
        self.setup()
        unknown = set(self.inputs) - self._inputs | set(self.args) - set(self._args)
        missing = self._inputs - set(self.inputs) | {a for a, (required, _) in self._args.items() if required and a not in self.args}
        if unknown or missing:
            raise ValueError(f"Step '{name}': unknown {sorted(unknown)}, missing {sorted(missing)}.")
        if not self._outputs:
            raise ValueError(f"Step '{name}' declares no outputs.")
        self.args = {a: self.args.get(a, default) for a, (_, default) in self._args.items()}
        session = Session.active
        parents = list({id(c.step): c.step for c in self.inputs.values()}.values())
        if session.parents and not session.composite:
            raise RuntimeError(f"Step '{session.parents[-1]}' is no CompositeStep, so it makes no steps of its own.")
        session.parents.append(name)
        outer, session.composite = session.composite, self.composite
        try:
            value = self.run()
        finally:
            session.parents.pop()
            session.composite = outer
        if isinstance(value, Step):
            value = value.dense
        if isinstance(value, DataFrame):
            if set(visible(value)) != set(self._outputs):
                raise ingest.StepOutputError(f"Expected the columns {self._outputs}, got {visible(value)}.")
            df, dense, n = (value, True, None) if POS in value.columns else (value.withColumn(POS, F.monotonically_increasing_id()), False, None)
        elif isinstance(value, ingest.LazyRows):
            (df, n), dense = ingest.streamed(session.spark, value, self._outputs), True
        else:
            table = ingest.arrow_table(ingest.normalised(value, self._outputs))
            df, dense, n = ingest.frame(session.spark, table), True, table.num_rows
        df = rows.rename_columns(df, outputs or {})
        plain = {a: v for a, v in self.args.items()}
        self.step = Step(name, df, dense=dense, num_rows=n, parts=(type(self).__name__, plain, outputs, [c.fingerprint for c in self.inputs.values()]), card=self.card, parents=parents)

    def setup(self) -> None:
        raise NotImplementedError

    def run(self) -> Any:
        raise NotImplementedError

    def register_input(self, name: str) -> None:
        self._inputs.add(name)

    def register_arg(self, name: str, required: bool = True, default: Any = None) -> None:
        self._args[name] = (required, default)

    def register_output(self, name: str) -> None:
        if name in self._outputs:
            raise ValueError(f"Output '{name}' is declared twice.")
        self._outputs.append(name)

    def register_data_card(self, kind: str, value: Any) -> None:
        self.card[kind] = value

    @property
    def output(self) -> Step:
        return self.step

    @classmethod
    def help(cls) -> str:
        probe = object.__new__(cls)
        probe._inputs, probe._args, probe._outputs, probe.card = set(), {}, [], {}
        probe.setup()
        args = ", ".join(f"{a}{'' if required else f'={default!r}'}" for a, (required, default) in probe._args.items())
        return f"{cls.__name__}(inputs: {', '.join(sorted(probe._inputs)) or 'none'}; args: {args or 'none'}; outputs: {', '.join(probe._outputs)})"


class CompositeStep(CustomStep):
    """A custom step that may make steps of its own; they are named below it."""

    composite = True
