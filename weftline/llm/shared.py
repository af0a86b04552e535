"""What the operators of this subpackage share: tables, words, bigram sets."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.storage import materialised as written

WORD = re.compile(r"[^\W_]+")
#: Words that one Python worker remembers the hash of; beyond it the memory is emptied, results stay the same.
MEMORY = 400_000
MIN_WORDS, LIKENESS = 20, 0.5
FREQUENCY_BITS = 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a Parquet table; only they reach the scan."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def mix(h: np.ndarray, salt: int = 0) -> np.ndarray:
    """A 64-bit finaliser over unsigned integers, element by element."""
    with np.errstate(over="ignore"):
        h = h ^ np.uint64((salt * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF)
        h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
        return h ^ (h >> np.uint64(32))


class Words:
    """Hashes of the words of texts, with a bounded memory of words seen."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def of(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' word hashes on end, and the number of words of each text (0 for null)."""
        known, out, counts = self.known, [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            if not text:
                continue
            words = WORD.findall(text.lower())
            counts[i] = len(words)
            try:
                out.extend([known[w] for w in words])
            except KeyError:
                if len(known) > MEMORY:
                    known.clear()
                for w in words:
                    if w not in known:
                        known[w] = xxhash.xxh3_64_intdigest(w)
                out.extend([known[w] for w in words])
        return np.array(out, np.uint64), counts


class Bigrams:
    """The sets of neighbouring word pairs of a batch of texts, on end: text number and hash."""

    def __init__(self, words: np.ndarray, counts: np.ndarray) -> None:
        ends = np.cumsum(counts)
        doc = np.repeat(np.arange(len(counts)), counts)
        inside = np.ones(max(len(words) - 1, 0), bool)
        inside[ends[(ends > 0) & (ends < len(words))] - 1] = False
        at = np.flatnonzero(inside)
        with np.errstate(over="ignore"):
            pair = mix(words[at] * np.uint64(3) + mix(words[at + 1], 1), 2)
        order = np.lexsort((pair, doc[at]))
        at, pair = at[order], pair[order]
        first = np.ones(len(at), bool)
        first[1:] = (doc[at][1:] != doc[at][:-1]) | (pair[1:] != pair[:-1])
        at, self.pair = at[first], pair[first]
        self.doc = doc[at]
        self.size = np.bincount(self.doc, minlength=len(counts))
        self.start = np.concatenate(([0], np.cumsum(self.size)[:-1]))

    def key(self, salt: int) -> np.ndarray:
        """One hash of each text's set, whatever its order; 0 for an empty set."""
        out = np.zeros(len(self.size), np.uint64)
        np.add.at(out, self.doc, mix(self.pair, salt))
        return mix(out, salt).view(np.int64)


def keys(b: pa.RecordBatch, words: Words) -> tuple[np.ndarray, np.ndarray, Bigrams]:
    """Of a batch with columns part and text: k (hash of each text's set of word pairs, and of part), the numbers of words, the sets."""
    hashes, counts = words.of(b.column("text").to_pylist())
    sets = Bigrams(hashes, counts)
    with np.errstate(over="ignore"):
        part = b.column("part").to_numpy(zero_copy_only=False).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return mix(sets.key(5).view(np.uint64) ^ part).view(np.int64), counts, sets


class Fresh:
    """Which keys a task meets for the first time, so that copies of a text are handled once a task.

    The memory is bounded; beyond it keys may pass again, which costs time and changes no result.
    """

    def __init__(self) -> None:
        self.seen: set[int] = set()

    def __call__(self, k: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        out, seen = wanted.copy(), self.seen
        if len(seen) > MEMORY:
            seen.clear()
        for i in np.flatnonzero(wanted):
            x = k[i]
            if x in seen:
                out[i] = False
            else:
                seen.add(x)
        return out


#: Bits of the filter for keys: 16 a key, but between these. At the most it is 16 MB; with more keys than that serves it lets more pass, which the join after it drops.
LEAST_BITS, MOST_BITS = 22, 27


def key_filter(found: DataFrame) -> np.ndarray:
    """A bitmap of the hashes of k_a and k_b of all rows, its length a power of 2. found: a written table."""
    width = min(MOST_BITS, max(LEAST_BITS, (32 * found.count()).bit_length()))
    shift = np.uint64(64 - width)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << width, bool)
        for b in batches:
            for side in ("k_a", "k_b"):
                bits[b.column(side).to_numpy().view(np.uint64) >> shift] = True
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(np.packbits(bits), 1)], pa.binary())], ["bits"])

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(1 << width >> 3, np.uint8)
        for b in batches:
            for x in b.column("bits").to_pylist():
                bits |= np.frombuffer(zlib.decompress(x), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array([zlib.compress(bits, 1)], pa.binary())], ["bits"])

    parts = found.select("k_a", "k_b").mapInArrow(mark, "bits binary")
    parts = parts.repartition(8).mapInArrow(unite, "bits binary")  # so the driver gets 8 bitmaps at most
    out = np.zeros(1 << width >> 3, np.uint8)
    for x in parts.toArrow().column("bits").to_pylist():
        out |= np.frombuffer(zlib.decompress(x), np.uint8)
    return out


def texts_of(records: DataFrame, wanted: np.ndarray) -> DataFrame:
    """k, part and text, one row for each set of word pairs of a part of which the filter wanted knows k. records: part (a small integer), text.

    Null, empty and texts under MIN_WORDS words have none. Equal k means an equal set, but for collisions of 64-bit hashes.
    """

    shift = np.uint64(64 - (len(wanted) * 8).bit_length() + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fresh = Words(), Fresh()
        for b in batches:
            k, counts, _ = keys(b, words)
            bit = k.view(np.uint64) >> shift
            known = (wanted[bit >> np.uint64(3)] >> (np.uint64(7) - (bit & np.uint64(7))).astype(np.uint8)) & 1
            yield b.append_column("k", pa.array(k)).filter(pa.array(fresh(k, (counts >= MIN_WORDS) & (known > 0))))

    rows = records.select("part", "text").mapInArrow(run, "part tinyint, text string, k bigint")
    return rows.groupBy("k").agg(F.first("text").alias("text"), F.first("part").alias("part"))


def verified(found: DataFrame, records: DataFrame) -> DataFrame:
    """The pairs k_a, k_b of found whose texts are alike, with likeness. Only texts of some pair are shuffled."""
    found = written(found)
    texts = texts_of(records, key_filter(found)).hint("merge")
    a, b = texts.alias("a"), texts.alias("b")
    pairs = found.join(a, F.col("k_a") == F.col("a.k")).select("k_a", "k_b", F.col("a.part").alias("part_a"), F.col("a.text").alias("text_a"))
    pairs = pairs.join(b, F.col("k_b") == F.col("b.k")).filter("part_a = b.part").select("k_a", "k_b", "text_a", F.col("b.text").alias("text_b"))
    return likeness(pairs, "k_a k_b")


def slot(pair: np.ndarray) -> np.ndarray:
    return (pair >> np.uint64(64 - FREQUENCY_BITS)).astype(np.int64)


def surveyed(records: DataFrame, *keep: str) -> tuple[DataFrame, np.ndarray]:
    """One pass over all records (part, text and the columns keep): members (part, keep, k) and the frequencies of word pairs.

    The frequencies are 2 ** FREQUENCY_BITS counters of texts (copies once a task), a fixed size at any scale. Several pairs may
    share one, so it is never below the number of different texts that have its pair. Members are the records of texts of at least MIN_WORDS words.
    """
    chunk = 1 << 14
    df = records.select("part", *keep, "text")
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, fresh, total, schema = Words(), Fresh(), np.zeros(1 << FREQUENCY_BITS, np.uint32), None
        for b in batches:
            k, counts, sets = keys(b, words)
            new = fresh(k, counts >= MIN_WORDS)
            total += np.bincount(slot(sets.pair[new[sets.doc]]), minlength=len(total)).astype(np.uint32)
            b = b.drop_columns(["text"]).append_column("k", pa.array(k)).filter(pa.array(counts >= MIN_WORDS))
            b = b.append_column("chunk", pa.nulls(len(b), pa.int32())).append_column("counts", pa.nulls(len(b), pa.binary()))
            schema = b.schema
            yield b
        if schema is not None:
            at = [i for i in range(0, len(total), chunk) if total[i : i + chunk].any()]
            rows = {"chunk": [i // chunk for i in at], "counts": [zlib.compress(total[i : i + chunk], 1) for i in at]}
            yield pa.RecordBatch.from_arrays([pa.array(rows[f.name], f.type) if f.name in rows else pa.nulls(len(at), f.type) for f in schema], schema=schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for i, c in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist()):
                total[i] = total.get(i, 0) + np.frombuffer(zlib.decompress(c), np.uint32).astype(np.uint64)
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["chunk", "counts"])

    both = written(df.mapInArrow(count, f"{kept}, k bigint, chunk int, counts binary"))
    got = both.filter("chunk is not null").select("chunk", "counts").repartition("chunk").mapInArrow(add, "chunk int, counts binary").toArrow()
    out = np.zeros(1 << FREQUENCY_BITS, np.uint64)
    for i, c in zip(got.column("chunk").to_pylist(), got.column("counts").to_pylist()):
        out[i * chunk : (i + 1) * chunk] = np.frombuffer(c, np.uint64)
    return both.filter("chunk is null").drop("chunk", "counts"), np.minimum(out, 0xFFFFFFFF).astype(np.uint32)


def likeness(pairs: DataFrame, keep: str) -> DataFrame:
    """The rows of pairs (columns named in keep, text_a, text_b) whose texts are alike, without the texts, plus likeness."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x, y in zip(b.column("text_a").to_pylist(), b.column("text_b").to_pylist()):
                v, w = WORD.findall(x.lower()), WORD.findall(y.lower())
                s, t = set(zip(v, v[1:])), set(zip(w, w[1:]))
                common = len(s & t)
                out.append(common / (len(s) + len(t) - common) if len(v) >= MIN_WORDS <= len(w) else 0.0)
            yield b.drop_columns(["text_a", "text_b"]).append_column("likeness", pa.array(out, pa.float64())).filter(pa.array([x >= LIKENESS for x in out], pa.bool_()))

    names = keep.split()
    df = pairs.select(*names, "text_a", "text_b")
    kinds = dict(df.dtypes)
    return df.mapInArrow(run, ", ".join(f"{n} {kinds[n]}" for n in names) + ", likeness double")
