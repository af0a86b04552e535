"""Problem 6: documents put into contexts of fixed size with as little unused room as possible.

Only the histogram of sizes reaches the driver, at most one row for each size up to the capacity. From it, in one task a
model, a linear program over configurations (how many items of each size share a container) is solved by multiplicative
weights: the weights of sizes that are short of containers grow, and a knapsack by dynamic programming finds the best
configuration for the weights. The counts are rounded down, and what is left over is packed from the largest size down, by
groups of equal containers. The documents then get their containers from their rank among those of equal size, without a
task that sees all of a size.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from weftline.llm.byte_bpe import token_counts
from weftline.llm.shared import table, written

#: Rounds of multiplicative weights, and by how much a covered size loses weight in one.
ROUNDS, STEP = 120, 0.4
#: Rows of one size that one task ranks at most, about.
RANKED = 500_000

Pattern = tuple[tuple[int, int], ...]


def best_pattern(sizes: np.ndarray, values: np.ndarray, most: np.ndarray, capacity: int) -> dict[int, int]:
    """The multiset of sizes (index -> number) of the greatest value that fits the capacity; no size more often than most.

    A size that may be taken b times stands for items of 1, 2, 4 ... and the rest of it, so one vector operation prices each.
    """
    value = np.zeros(capacity + 1)
    taken: list[tuple[int, int, np.ndarray]] = []
    for i, s in enumerate(sizes.tolist()):
        left, times = min(int(most[i]), capacity // s), 1
        while left > 0:
            n = min(times, left)
            got, old = value[: capacity + 1 - n * s] + n * values[i], value[n * s :]
            taken.append((i, n, np.packbits(got > old)))
            np.maximum(old, got, out=old)
            left, times = left - n, times * 2
    out: dict[int, int] = {}
    c = capacity
    for i, n, better in reversed(taken):
        at = c - n * int(sizes[i])
        if at >= 0 and better[at >> 3] >> (7 - (at & 7)) & 1:
            out[i] = out.get(i, 0) + n
            c = at
    return out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = ROUNDS, step: float = STEP) -> list[tuple[Pattern, int]]:
    """Patterns ((size, number), ...) and how many containers have each, by the linear program; covers no size too often.

    Every ROUNDS / 8 rounds it is rounded, and ends early if it and the rest fill no more containers than all items need.
    """
    if not len(sizes) or counts.sum() < 2:
        return []
    used: dict[tuple[tuple[int, int], ...], float] = {}
    weights, least = np.ones(len(sizes)), -(-int((sizes * counts).sum()) // capacity)
    out: list[tuple[Pattern, int]] = []
    for r in range(1, rounds + 1):
        # A size's price is its share of the capacity, more where its items are short of containers.
        pattern = best_pattern(sizes, sizes * weights / capacity, counts, capacity)
        number = min(counts[i] / n for i, n in pattern.items())  # until the first size is all placed
        key = tuple(sorted(pattern.items()))
        used[key] = used.get(key, 0.0) + number
        for i, n in pattern.items():
            weights[i] *= (1 - step) ** (n * number / counts[i])
        weights /= weights.max()
        if r % max(1, rounds // 8) == 0 or r == rounds:
            out = rounded(sizes, counts, used)
            if sum(n for _, n in with_rest(out, sizes, counts, capacity)) <= least:
                break
    return out


def rounded(sizes: np.ndarray, counts: np.ndarray, used: dict[tuple[tuple[int, int], ...], float]) -> list[tuple[Pattern, int]]:
    """Whole numbers of containers for the patterns (index of a size, number) used so often, none so that a size is covered too often."""
    cover = np.zeros(len(sizes))
    for pattern, number in used.items():
        for i, n in pattern:
            cover[i] += n * number
    left, out = counts.copy(), []
    for pattern, number in sorted(used.items(), key=lambda x: -x[1]):
        over = max(cover[i] / counts[i] for i, _ in pattern)  # so that no size is covered more than once
        whole = min(int(number / max(over, 1e-9) + 1e-9), *(int(left[i] // n) for i, n in pattern))
        if whole > 0:
            out.append((tuple((int(sizes[i]), n) for i, n in pattern), whole))
            for i, n in pattern:
                left[i] -= n * whole
    return out


def largest_first(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and numbers of containers for items of these sizes, each put where it leaves the least room, from the largest down.

    Containers that are alike are one group, so the work grows with the number of sizes and not of items.
    """
    groups: dict[int, list[tuple[dict[int, int], int]]] = {}  # by room left
    rooms: list[int] = []  # its keys in order

    def put(room: int, pattern: dict[int, int], n: int) -> None:
        if room not in groups:
            groups[room] = []
            insort(rooms, room)
        groups[room].append((pattern, n))

    for s, left in sorted(zip(sizes.tolist(), counts.tolist()), reverse=True):
        while left > 0:
            at = bisect_left(rooms, s)
            if at == len(rooms):
                each = min(capacity // s, left)
                put(capacity - each * s, {s: each}, left // each)
                left -= left // each * each
                continue
            room = rooms[at]
            pattern, n = groups[room].pop()
            each = min(room // s, left)
            take = min(n, left // each)
            if take < n:
                groups[room].append((pattern, n - take))
            if not groups[room]:
                del groups[room]
                del rooms[at]
            put(room - each * s, pattern | {s: each}, take)
            left -= take * each
    return [(tuple(sorted(p.items())), n) for same in groups.values() for p, n in same]


def with_rest(first: list[tuple[Pattern, int]], sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and numbers of containers first, and those of the items they leave, from the largest down."""
    left = dict(zip(sizes.tolist(), counts.tolist()))
    for pattern, n in first:
        for s, k in pattern:
            left[s] -= k * n
    rest = [(s, n) for s, n in left.items() if n]
    return first + largest_first(np.array([s for s, _ in rest], np.int64), np.array([n for _, n in rest], np.int64), capacity)


def plan(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns and numbers of containers that hold all items: by the linear program and its rest, or all from the largest down if that needs fewer."""
    both = (with_rest(first, sizes, counts, capacity) for first in (configurations(sizes, counts, capacity), []))
    return min(both, key=lambda x: sum(n for _, n in x))


def places(solution: list[tuple[Pattern, int]]) -> np.ndarray:
    """Rows size, first rank, first container, number in a container: where the items of each size go by their rank."""
    rows, container, at = [], 0, {}
    for pattern, n in solution:
        for s, k in pattern:
            rows.append((s, at.get(s, 0), container, k))
            at[s] = at.get(s, 0) + k * n
        container += n
    return np.array(sorted(rows), np.int64).reshape(-1, 4)


def planned(spark: SparkSession, histograms: list[list[tuple[int, int]]], capacities: list[int]) -> np.ndarray:
    """Rows model, size, first rank, first container, number in a container, sorted; each model is planned in a task of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in b.column("id").to_pylist():
                sizes = np.array(sorted(histograms[i]), np.int64).reshape(-1, 2)
                rows = places(plan(sizes[:, 0], sizes[:, 1], capacities[i]))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(rows), i)), *(pa.array(rows[:, j]) for j in range(4))], list("msrck"))

    n = len(capacities)
    got = spark.range(0, n, 1, n).mapInArrow(run, "m bigint, s bigint, r bigint, c bigint, k bigint").toArrow()
    rows = np.column_stack([got.column(c).to_numpy() for c in "msrck"]).astype(np.int64)
    return rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]


def packed(sizes: DataFrame, limits: list[tuple[str, int]]) -> DataFrame:
    """model_name, doc_id, part, first_token, n_tokens and container of all documents, for each model's capacity.

    sizes: doc_id, n_tokens (a null or negative number counts as 0); rows are taken one for one, repeated ids too. A document is
    split only if it is larger than the capacity: into whole containers of its own ('own:<doc_id>:<part>') and a rest. All other
    parts are in shared containers ('<model>:<number>'); documents of no tokens are in the first. Empty tables and no models give no rows.
    """
    if not limits:
        return packed(sizes.limit(0), [("", 1)])
    model = F.explode(F.array(*(F.struct(F.lit(i).alias("m"), F.lit(c).cast("bigint").alias("capacity")) for i, (_, c) in enumerate(limits))))
    n = F.greatest(F.coalesce("n_tokens", F.lit(0)), F.lit(0)).cast("bigint")
    rows = sizes.select("doc_id", n.alias("n"), model.alias("of")).select("doc_id", "n", "of.m", "of.capacity")
    whole = F.when(F.col("n") > F.col("capacity"), F.floor(F.col("n") / F.col("capacity"))).otherwise(F.lit(0))
    items = rows.select("doc_id", "m", "capacity", whole.alias("whole"), (F.col("n") - whole * F.col("capacity")).alias("size"))
    histogram = items.groupBy("m", "size").agg(F.count("*").alias("n")).collect()  # at most capacity + 1 rows a model
    sizes_of: list[list[tuple[int, int]]] = [[] for _ in limits]
    for r in histogram:
        if r["size"] > 0:
            sizes_of[r["m"]].append((r["size"], r["n"]))
    where = planned(sizes.sparkSession, sizes_of, [c for _, c in limits])
    # Items stand in the order of model, size and rank: each size begins where the one before ends, so no two have a place in common.
    group, of = np.unique(where[:, :2], axis=0, return_inverse=True)
    total = {(r["m"], r["size"]): r["n"] for r in histogram}
    items_of = np.array([total[m, s] for m, s in group.tolist()], np.int64)
    base = np.cumsum(items_of) - items_of
    place, width = base[of.reshape(-1)] + where[:, 2], (int(group[:, 1].max()) if len(group) else 0) + 1
    group_key = group[:, 0] * width + group[:, 1]
    # The rank among the items of a size: within a bucket, plus the buckets before it.
    buckets = max([64, *(r["n"] // RANKED for r in histogram)])
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)).cast("int"))
    counts = items.filter("size > 0").groupBy("m", "size", "bucket").agg(F.count("*").alias("n"))
    offsets = counts.select("m", "size", "bucket", (F.sum("n").over(Window.partitionBy("m", "size").orderBy("bucket")) - F.col("n")).alias("offset"))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("m", "size", "bucket").orderBy("doc_id")) - 1)
    ranked = ranked.join(offsets.hint("merge"), ["m", "size", "bucket"], "left").select("doc_id", "m", "capacity", "whole", "size", (F.col("rank") + F.coalesce("offset", F.lit(0))).alias("rank"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            m, size, rank = (b.column(c).to_numpy() for c in ("m", "size", "rank"))
            container = np.zeros(len(m), np.int64)
            some = size > 0
            if some.any():
                g = np.searchsorted(group_key, m[some].astype(np.int64) * width + size[some])
                w = where[np.searchsorted(place, base[g] + rank[some], "right") - 1]
                container[some] = w[:, 3] + (rank[some] - w[:, 2]) // w[:, 4]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "m", "capacity", "whole", "size")), pa.array(container)], ["doc_id", "m", "capacity", "whole", "size", "shared"])

    kind = dict(sizes.dtypes)["doc_id"]
    out = ranked.mapInArrow(run, f"doc_id {kind}, m int, capacity bigint, whole bigint, size bigint, shared bigint")
    rest = (F.col("size") > 0) | (F.col("whole") == 0)
    part = F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("whole") - F.when(rest, 0).otherwise(1)))
    name = F.element_at(F.array(*(F.lit(m) for m, _ in limits)), F.col("m") + 1)
    own = F.col("part") < F.col("whole")
    return out.withColumn("part", part).select(
        name.alias("model_name"),
        "doc_id",
        F.col("part").cast("int").alias("part"),
        (F.col("part") * F.col("capacity")).alias("first_token"),
        F.when(own, F.col("capacity")).otherwise(F.col("size")).alias("n_tokens"),
        F.when(own, F.concat_ws(":", F.lit("own"), "doc_id", "part")).otherwise(F.concat_ws(":", name, "shared")).alias("container"),
    )


def model_limits(spark: SparkSession, sf_dir: str) -> list[tuple[str, int]]:
    """The models and their context sizes: a fixed table of a few rows."""
    rows = table(spark, sf_dir, "model_limits", "model_name", "max_tokens").filter("max_tokens > 0").dropDuplicates(["model_name"]).orderBy("model_name").collect()
    return [(r["model_name"], r["max_tokens"]) for r in rows]


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, sized by its number of byte_bpe_50k tokens, for each model."""
    sizes = written(token_counts(table(spark, sf_dir, "documents", "doc_id", "text")))
    return packed(sizes, model_limits(spark, sf_dir))


def p6_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model_name, max_tokens, n_containers, least_containers (tokens over capacity, rounded up) and share_unused."""
    limits = model_limits(spark, sf_dir)
    capacity = F.element_at(F.create_map(*(x for m, c in limits for x in (F.lit(m), F.lit(c)))), F.col("model_name"))
    each = p6_containers(spark, sf_dir).filter("n_tokens > 0").groupBy("model_name", "container").agg(F.sum("n_tokens").alias("used"))
    out = each.groupBy("model_name").agg(F.count("*").alias("n_containers"), F.sum("used").alias("used"), F.max("used").alias("most_used"))
    return out.select("model_name", capacity.alias("max_tokens"), "n_containers", F.ceil(F.col("used") / capacity).alias("least_containers"), "most_used", F.round(1 - F.col("used") / (F.col("n_containers") * capacity), 6).alias("share_unused"))
