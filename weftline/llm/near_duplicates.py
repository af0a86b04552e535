"""Problem 1: records whose texts are alike, within a table.

The method named is a metric-space join: pivots, Voronoi regions, windows that replicate boundary documents, exact joins
within regions. Its window from the triangle inequality is twice the radius. At a likeness of 0.5 the radius is 0.5, so
the window is 1, the diameter of the space: every document would be replicated to every region. The join here keeps the
shape and takes the window from set sizes, which is exact too and narrow:

* Pivots are the word pairs of the corpus, in one order, the rarest first (by counts over all rows). The region of a
  pivot holds the documents near it, those whose set has the pair; all others are at distance 1.
* A document is replicated to the pivots in its window: its n - ceil(n / 2) + 1 first ones. Two alike documents of n and m
  pairs share at least (n + m) / 3, so their first common pivot lies in both windows, and within the first third of the smaller.
* A region that may hold more than REGION documents (the counts are upper bounds) is divided again by the next pivots in
  the window, by the same rule, and what is large even so by a grid of blocks. So no task gets more than a bounded region.
* Within a region two documents meet only if positions, sizes and bit fingerprints (the parities of hashed pairs, whose
  Hamming distance never exceeds the number of pairs in just one set) allow 0.5; then the texts decide.

Texts with equal sets take part under the hash of the set, once for each task that reads them, and are expanded at the end.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.shared import MIN_WORDS, Bigrams, Fresh, Words, keys, mix, slot, surveyed, table, verified, written

#: Number of documents of a region above which it is divided.
REGION = 8_000
#: Rows of regions that one task joins, about, and copies of one text that one task expands.
JOINED, COPIES = 250_000, 2_000


#: Numbers of 64-bit words a fingerprint may have, and up to how many pairs each serves.
WIDTHS, SERVES = (1, 2, 4, 8), (24, 56, 112)


def parities(b: Bigrams) -> tuple[np.ndarray, np.ndarray]:
    """A fingerprint for each text, on end, and the numbers of its words: bit j says whether an odd number of its pairs hash to j.

    Each pair turns one bit, so two fingerprints differ in no more bits than pairs are in just one of the sets. A wide one
    becomes a narrow one by xor of its halves.
    """
    width = np.array(WIDTHS)[np.searchsorted(SERVES, b.size)]
    start = np.cumsum(width) - width
    bit = mix(b.pair, 21) % (width[b.doc] * 64).astype(np.uint64)
    out = np.zeros(int(width.sum()), np.uint64)
    np.bitwise_xor.at(out, start[b.doc] + (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out, width


def narrowed(flat: np.ndarray, width: np.ndarray) -> dict[int, np.ndarray]:
    """The fingerprints of rows by number of words, each folded to it; rows of narrower ones are 0 there."""
    start, out = np.cumsum(width) - width, {}
    for w in WIDTHS:
        out[w] = np.zeros((len(width), w), np.uint64)
    for w in WIDTHS:
        rows = np.flatnonzero(width == w)
        x = flat[start[rows, None] + np.arange(w)]
        while True:
            out[x.shape[1]][rows] = x
            if x.shape[1] == 1:
                break
            x = x[:, : x.shape[1] // 2] ^ x[:, x.shape[1] // 2 :]
    return out


def gridded(region: np.ndarray, most: np.ndarray, k: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of regions in blocks: number of the row, and block. What is too large is a grid: a row stands in the blocks of its line and of its column."""
    sides = -(-most // REGION)
    own = (k.view(np.uint64) >> np.uint64(8)).astype(np.int64) % sides
    times = np.where(sides > 1, 2 * sides - 1, 1)
    line = np.repeat(np.arange(len(region)), times)
    i = np.arange(len(line)) - np.repeat(np.cumsum(times) - times, times)
    g, o = sides[line], own[line]
    block = np.where(i < g, o * g + i, np.where(i - g < o, i - g, i - g + 1) * g + o)
    with np.errstate(over="ignore"):
        return line, mix(region[line] + block.astype(np.uint64), salt)


def regions(records: DataFrame, frequency: np.ndarray) -> DataFrame:
    """Of each text of at least MIN_WORDS words (columns part, text) its rows in regions: pivot, k, np (size and position), print (fingerprint).

    part (a small integer) keeps tables apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fresh = Words(), Fresh()
        for batch in batches:
            k, counts, b = keys(batch, words)
            new = fresh(k, counts >= MIN_WORDS)
            most = frequency[slot(b.pair)].astype(np.int64)
            order = np.lexsort((b.pair, most, b.doc))
            doc, pair, most = b.doc[order], b.pair[order], most[order]
            n = b.size[doc]
            position = np.arange(len(doc)) - b.start[doc]
            window = n - (n + 1) // 2 + 1
            part = batch.column("part").to_numpy(zero_copy_only=False).astype(np.uint64)[doc]
            with np.errstate(over="ignore"):
                pivot = mix(pair + part, 11)
            inside = (position < window) & new[doc]
            at = np.flatnonzero(inside & (most <= REGION))
            where, key = position[at], pivot[at]
            large = np.flatnonzero(inside & (most > REGION))
            # Two texts of one or two pairs may share just one, so nothing but its own grid divides its region.
            few = large[n[large] <= 2]
            if len(few):
                line, sub = gridded(pivot[few], most[few], k[doc[few]], 14)
                at, where, key = np.concatenate((at, few[line])), np.concatenate((where, position[few][line])), np.concatenate((key, sub))
            if len(large):  # divided by each further pivot of the window: both pivots are common then
                more = window[large] - position[large]
                base = np.repeat(large, more)
                step = np.arange(len(base)) - np.repeat(np.cumsum(more) - more, more) + 1
                there = position[base] + step < n[base]
                base, step = base[there], step[there]
                with np.errstate(over="ignore"):
                    sub = mix(pivot[base] * np.uint64(3) + pivot[base + step], 12)
                line, sub = gridded(sub, np.minimum(most[base], most[base + step]), k[doc[base]], 13)
                at, where, key = np.concatenate((at, base[line])), np.concatenate((where, (position[base] + step - 1)[line])), np.concatenate((key, sub))
            flat, width = parities(b)
            ends = np.concatenate(([0], np.cumsum(width) * 8)).astype(np.int32)
            prints = pa.Array.from_buffers(pa.binary(), len(width), [None, pa.py_buffer(ends), pa.py_buffer(flat)])
            d = doc[at]
            arrays = [(key & np.uint64(0xFFFFFFFF)).astype(np.uint32).view(np.int32), k[d], (n[at].astype(np.int64) << 32) | where, prints.take(pa.array(d))]
            whole = pa.RecordBatch.from_arrays([pa.array(x) for x in arrays], ["pivot", "k", "np", "print"])
            for i in range(0, whole.num_rows, 50_000):
                yield whole.slice(i, 50_000)

    return records.select("part", "text").mapInArrow(run, "pivot int, k bigint, np bigint, print binary")


class Region:
    """Rows sorted by pivot. With a column trains only rows of which one has it true and one false meet."""

    def __init__(self, t: pa.Table) -> None:
        position = t.column("np").to_numpy()
        self.pivot, self.k, self.n, self.p = t.column("pivot").to_numpy(), t.column("k").to_numpy(), position >> 32, position & 0xFFFFFFFF
        self.trains = t.column("trains").to_numpy() if "trains" in t.column_names else None
        prints = t.column("print").combine_chunks()
        prints = prints.chunk(0) if isinstance(prints, pa.ChunkedArray) else prints
        ends = np.frombuffer(prints.buffers()[1], np.int32)[prints.offset : prints.offset + len(prints) + 1]
        self.width = np.diff(ends) // 8
        self.prints = narrowed(np.frombuffer(prints.buffers()[2], np.uint8)[ends[0] : ends[-1]].copy().view(np.uint64), self.width)

    def meet(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """k of those rows i and j whose sizes, positions and fingerprints allow a likeness of 0.5, the smaller text first; with trains the one that trains."""
        n, p, k = self.n, self.p, self.k
        a, b = np.where((n[i] < n[j]) | (n[i] == n[j]) & (k[i] < k[j]), (i, j), (j, i))
        ok = (k[a] != k[b]) & (3 * p[a] <= n[a] + 3) & (2 * n[a] >= n[b]) & (3 * np.minimum(n[a] - p[a], n[b] - p[b]) >= n[a] + n[b])
        if self.trains is not None:
            ok &= self.trains[a] != self.trains[b]
        a, b = a[ok], b[ok]
        width, near = np.minimum(self.width[a], self.width[b]), np.zeros(len(a), bool)
        for w in WIDTHS:
            at = np.flatnonzero(width == w)
            differ = np.bitwise_count(self.prints[w][a[at]] ^ self.prints[w][b[at]]).sum(axis=1, dtype=np.int64)
            near[at] = 3 * differ <= n[a[at]] + n[b[at]]
        a, b = a[near], b[near]
        if self.trains is not None:
            a, b = np.where(self.trains[a], (a, b), (b, a))
        return k[a], k[b]

    def sides(self, small: np.ndarray, region: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """What of small is to meet what of region."""
        if self.trains is None:
            return [(small, region)]
        return [(small[self.trains[small] == side], region[self.trains[region] != side]) for side in (True, False)]


def tasks_for(frequency: np.ndarray, least: int) -> int:
    """How many tasks join the regions: half of all word pairs of texts stand in a window, so their rows grow with the counts, and the tasks with them."""
    return max(least, int(frequency.sum(dtype=np.uint64)) // 2 // JOINED + 1)


def joined(rows: DataFrame, tasks: int) -> DataFrame:
    """k_a and k_b of the rows that meet within their regions, each region joined in one task, none larger than REGION allows.

    Where rows have a column trains (boolean), k_a trains and k_b doesn't.
    """

    def within(t: pa.Table) -> pa.RecordBatch:
        x = Region(t)
        start = np.flatnonzero(np.concatenate(([True], x.pivot[1:] != x.pivot[:-1])))
        size = np.diff(np.concatenate((start, [len(t)])))
        found = []
        live, step = np.repeat(size, size) <= 64, 1
        left = np.repeat(start + size, size) - np.arange(len(t))  # rows up to the region's end
        i = np.flatnonzero(live & (left > step))
        while len(i):
            found.append(x.meet(i, i + step))
            step += 1
            i = i[left[i] > step]
        for s, m in zip(start[size > 64], size[size > 64]):
            region = np.arange(s, s + m)
            small = region[3 * x.p[region] <= x.n[region] + 3]
            for mine, others in x.sides(small, region):
                for at in range(0, len(mine), max(1, 1_000_000 // m)):
                    some = mine[at : at + max(1, 1_000_000 // m)]
                    found.append(x.meet(np.repeat(some, len(others)), np.tile(others, len(some))))
        a, b = (np.concatenate([f[side] for f in found] or [np.zeros(0, np.int64)]) for side in (0, 1))
        if len(a):
            order = np.lexsort((b, a))
            a, b = a[order], b[order]
            new = np.concatenate(([True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
            a, b = a[new], b[new]
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["k_a", "k_b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            held.append(b)
            n += b.num_rows
            if n < 200_000:
                continue
            t = pa.Table.from_batches(held)
            pivot = t.column("pivot").to_numpy()
            end = int(np.searchsorted(pivot, pivot[-1]))  # the last region may go on
            if end:
                yield within(t.slice(0, end))
            held, n = t.slice(end).to_batches(), len(t) - end
        if n:
            yield within(pa.Table.from_batches(held))

    return rows.repartition(tasks, "pivot").sortWithinPartitions("pivot").mapInArrow(run, "k_a bigint, k_b bigint")


def least_tasks(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def classes(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The membership (part, id, k) of all texts of at least MIN_WORDS words, and the pairs (k_a, k_b, likeness) of alike classes.

    Texts with the same set of word pairs are one class k. Copies are so many rows of the membership and no pairs. records: part, id, text.
    Rows with the same part and id are one record. Null, empty and short texts (under 20 words) are alike to nothing and in no class.
    Empty tables give no rows; further columns are ignored; texts of any length are taken whole.
    """
    members, frequency = surveyed(records, "id")
    links = verified(joined(regions(records, frequency), tasks_for(frequency, least_tasks(records))).distinct(), records)
    return written(members.distinct()), links


def expanded(links: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """The pairs of members of linked classes. links: k_a, k_b. left: k_a and others; right: k_b and others, each with a column by, which tells members apart.

    A class of more than COPIES members is dealt to several keys, so no task gets all its members.
    """
    out = links
    for k, salt, members in (("k_a", "__a", left), ("k_b", "__b", right)):
        large = members.groupBy(k).agg(F.count("*").alias("__n")).filter(F.col("__n") > COPIES).select(k, F.ceil(F.col("__n") / COPIES).alias("__s"))
        shares = F.coalesce("__s", F.lit(1))
        dealt = members.join(large, k, "left").withColumn(salt, F.pmod(F.xxhash64("by"), shares)).drop("__s", "by")
        out = out.join(large, k, "left").withColumn(salt, F.explode(F.sequence(F.lit(0).cast("bigint"), shares - 1))).drop("__s").join(dealt, [k, salt]).drop(salt)
    return out


def near_duplicates(records: DataFrame) -> DataFrame:
    """part, id_a and id_b (id_a < id_b) of every two records of a part with alike texts, copies among them: classes() expanded."""
    members, links = classes(records)
    same = members.groupBy("k").count().filter("count > 1").select(F.col("k").alias("k_a"), F.col("k").alias("k_b"))
    left, right = members.select("part", F.col("k").alias("k_a"), F.col("id").alias("x"), F.col("id").alias("by")), members.select(F.col("k").alias("k_b"), F.col("id").alias("y"), F.col("id").alias("by"))
    pairs = expanded(links.select("k_a", "k_b").unionByName(same), left, right).filter("k_a != k_b or x < y")
    return pairs.select("part", F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b"))


def linked(records: DataFrame) -> DataFrame:
    """part, id, class (the least id of the records with its set of word pairs), n_copies (their number) and n_links (other records with alike texts) of every record in a class."""
    members, links = classes(records)
    sizes = members.groupBy("part", "k").agg(F.count("*").alias("n_copies"), F.min("id").alias("class"))
    both = links.select(F.col("k_a").alias("k"), F.col("k_b").alias("of")).unionByName(links.select(F.col("k_b").alias("k"), F.col("k_a").alias("of")))
    others = both.join(sizes.select(F.col("k").alias("of"), "n_copies"), "of").groupBy("k").agg(F.sum("n_copies").alias("others"))
    of_class = sizes.join(others, "k", "left").select("k", "class", "n_copies", (F.col("n_copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"))
    return members.join(of_class, "k").select("part", "id", "class", "n_copies", "n_links")


TABLES = {0: ("prompt_log", "prompt_id", "prompt"), 1: ("finetune_rows", "example_id", "train_output")}


def p1_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = None
    for part, (name, key, text) in TABLES.items():
        df = table(spark, sf_dir, name, key, text).select(F.lit(part).cast("tinyint").alias("part"), F.col(key).alias("id"), F.col(text).alias("text"))
        out = df if out is None else out.unionByName(df)
    return out


def p1_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id, class, n_copies and n_links of every record of at least 20 words: as large as the tables, however many copies there are."""
    name = F.when(F.col("part") == 0, TABLES[0][0]).otherwise(TABLES[1][0])
    return linked(p1_records(spark, sf_dir)).select(name.alias("tbl"), "id", "class", "n_copies", "n_links")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tbl, id_a, id_b of every two alike records of prompt_log.prompt and of finetune_rows.train_output."""
    name = F.when(F.col("part") == 0, TABLES[0][0]).otherwise(TABLES[1][0])
    return near_duplicates(p1_records(spark, sf_dir)).select(name.alias("tbl"), "id_a", "id_b")
