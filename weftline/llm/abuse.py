"""Problem 7: a score for abusive, hateful or sexual language in every document.

A factorization machine over hashed terms scores windows of a few words: linear weights and pairwise interactions of terms,
such as an insult with an address or a group, or a word with the technical use around it. A document has the score of its
highest window, so a phrase counts in any part of a long text. Labels are of documents; training therefore alternates
between fitting the machine and choosing, in each document labelled as a case, the windows that make it one.

Terms are 64-bit hashes of words and of neighbouring words; the machine knows those that stand in two labelled documents at
least, so no two of them share a weight. Disguises are undone before hashing: look-alike letters, digits and signs for
letters, stretched or spaced-out words, characters that are not seen; a hidden letter is tried out against the known words.

The labelled documents are fitted once for each machine and once for each fold, side by side as tasks of the cluster. The
scores that documents get from the fold that didn't see them calibrate the log-odds, so THRESHOLD is the point where as many
of the labelled documents are cases as not.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from string import ascii_lowercase

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.llm.shared import mix, table

FACTORS = 4
#: Machines that are fitted from different starts and averaged, and folds of the labelled documents.
MACHINES, FOLDS = 3, 3
#: Labelled documents the machine is fitted on at most: those with the smallest hashes of their ids.
SAMPLE = 12_000
#: Score from which on a document is a case.
THRESHOLD = 0.5
#: Words a window has at most, and by how many the next one starts later.
WINDOW, STRIDE = 24, 12
#: Words that one Python worker remembers the terms of; beyond it the memory is emptied, results stay the same.
MEMORY = 300_000
CASES = ("abusive", "hateful", "sexual")
#: Log-odds of documents without windows.
NOWHERE = -30.0

UNSEEN = re.compile("[\u00ad\u200b-\u200f\u2060-\u2064\ufe00-\ufe0f\ufeff]")
# Cyrillic and Greek letters that look like Latin ones; digits and signs that stand for letters.
ALIKE = str.maketrans("авеёкмнорстухіјѕԁɡӏαβεικνορτυχ", "abeekmhopctyxijsdgiabeiknoptux")
SIGNS = str.maketrans("0134578@$€!|+", "oieastbaseiit")
SPACED = re.compile(r"(?<![^\W_])[^\W\d_](?:([ .\-_])[^\W\d_])(?:\1[^\W\d_])+(?![^\W_])")
TOKEN = re.compile(r"[@$*]*[^\W_]+(?:[@$!*|€#+]+[^\W_]+)*[@$*|€#+]*")
SENTENCE = re.compile(r"(?<=[.!?…])[\"”’»)!]*\s+|\n+")
STRETCHED = re.compile(r"(.)\1{2,}")
HIDDEN = re.compile(r"[*#]+")


def spaced(m: re.Match[str]) -> str:
    """The word that was spaced out; behind a word of one letter ('a f o o l') without that as well."""
    word = m[0].replace(m[1], "")
    return f"{word} {word[1:]}" if word[0] in "aeiouy" else word


def windows(text: str | None) -> list[list[str]]:
    """The words of each sentence, long ones in overlapping windows, with unseen characters and spaced-out words undone."""
    if not text:
        return []
    if not text.isascii():
        text = UNSEEN.sub("", text)
    out: list[list[str]] = []
    for sentence in SENTENCE.split(text.lower()):
        if not sentence:
            continue
        if SPACED.search(sentence):
            sentence = SPACED.sub(spaced, sentence)
        words = TOKEN.findall(sentence)
        if len(words) <= WINDOW:
            if words:
                out.append(words)
        else:
            out += [words[i : i + WINDOW] for i in range(0, len(words) - WINDOW + STRIDE, STRIDE)]
    return out


def plain(raw: str) -> str:
    """A word in Latin letters without accents, with signs for letters, look-alikes and stretched letters undone."""
    w = raw
    if not w.isascii():
        w = unicodedata.normalize("NFKC", w).lower().translate(ALIKE)
        w = "".join(c for c in unicodedata.normalize("NFD", w) if not unicodedata.combining(c)).replace("ß", "ss")
    if not w.isalpha() and any(c.isalpha() for c in w):
        w = w.translate(SIGNS)
    return STRETCHED.sub(r"\1", w)


DISGUISED = xxhash.xxh3_64_intdigest("disguised")


class Terms:
    """Hashed terms of windows. known: the sorted hashes that count, against which hidden letters are tried out; without it all count and these stay hidden."""

    def __init__(self, known: np.ndarray | None = None) -> None:
        self.known, self.some = known, set() if known is None else set(known.tolist())
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.more: dict[int, tuple[int, ...]] = {}
        self.hashes, self.counts = np.zeros(0, np.uint64), np.zeros(0, bool)

    def of(self, raw: str) -> tuple[int, tuple[int, ...]]:
        """The hash of a word, and further terms: that it looks disguised, and what it may be if a letter is hidden."""
        w = "0" if raw.isdigit() else plain(raw)
        main, more = xxhash.xxh3_64_intdigest(w), []
        if any(c in "*#@$€|" for c in raw) or not raw.isalpha() and not raw.isdigit() and len(re.sub(r"[^\W\d_]", "", raw)) < len(raw) - 1:
            more.append(DISGUISED)
        gap = HIDDEN.search(w)
        if gap and len(w) >= 4 and self.some:
            may = sorted({xxhash.xxh3_64_intdigest(w[: gap.start()] + c + w[gap.end() :]) for c in ("", *ascii_lowercase)} & self.some)
            if len(may) == 1:
                main = may[0]
            more += may
        return main, tuple(more)

    def numbers(self, rows: list[list[str]]) -> np.ndarray:
        """The numbers of the words of all rows on end; new words get their hashes first."""
        if len(self.number) > MEMORY:
            self.clear()
        number, out, new = self.number, [], []
        for words in rows:
            try:
                out.extend([number[w] for w in words])
            except KeyError:
                for w in words:
                    if w not in number:
                        number[w] = len(number)
                        new.append(w)
                out.extend([number[w] for w in words])
        if new:
            each = [self.of(w) for w in new]
            self.more |= {number[w]: more for w, (_, more) in zip(new, each) if more}
            self.hashes = np.concatenate((self.hashes, np.array([main for main, _ in each], np.uint64)))
            self.counts = np.ones(len(self.hashes), bool) if self.known is None else np.isin(self.hashes, self.known)
        return np.array(out, np.int64)

    def flat(self, rows: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Number of the row and hash of every term of rows of words, words and neighbouring words alike; terms may be repeated."""
        sizes = np.fromiter(map(len, rows), np.int64, len(rows))
        words, at = self.numbers(rows), np.repeat(np.arange(len(rows)), sizes)
        main, counts = self.hashes[words], self.counts[words]
        pair = np.flatnonzero((at[1:] == at[:-1]) & counts[1:] & counts[:-1])  # a pair is in no more documents than its words
        with np.errstate(over="ignore"):
            pairs = mix(main[pair] * np.uint64(3) + mix(main[pair + 1], 1), 2)
        odd = np.flatnonzero(np.isin(words, np.fromiter(self.more, np.int64, len(self.more)))) if self.more else []
        more = [(at[i], x) for i in odd for x in self.more[words[i]]]
        return np.concatenate((at[counts], at[pair], np.array([i for i, _ in more], np.int64))), np.concatenate((main[counts], pairs, np.array([x for _, x in more], np.uint64)))


def known_terms(at: np.ndarray, terms: np.ndarray, known: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n rows the numbers of their known terms on end, each once a row, and where each row starts (n + 1 places)."""
    place = np.searchsorted(known, terms)
    ok = place < len(known)
    ok[ok] = known[place[ok]] == terms[ok]
    at, ids = np.divmod(np.unique(at[ok] * max(len(known), 1) + place[ok]), max(len(known), 1))
    return ids, np.searchsorted(at, np.arange(n + 1))


class Machine:
    """A factorization machine: bias, a weight a term and numbers a term whose products weigh pairs of terms.

    A document's score is that of its highest log-odds above limit.
    """

    def __init__(self, known: np.ndarray, seed: int = 7) -> None:
        self.known, self.bias, self.limit, self.weight = known, -4.0, 0.0, np.zeros(len(known), np.float32)
        self.factor = np.random.default_rng(seed).normal(0, 0.02, (len(known), FACTORS)).astype(np.float32)

    def log_odds(self, ids: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """The log-odds of windows, of terms on end and the places where windows start, with the end as the last."""
        v = self.factor[ids]
        some = np.flatnonzero(np.diff(starts))
        out = np.full(len(starts) - 1, self.bias, np.float32)
        if len(some):
            out[some] += np.add.reduceat(self.weight[ids], starts[some]) + 0.5 * (np.add.reduceat(v, starts[some]) ** 2 - np.add.reduceat(v * v, starts[some])).sum(axis=1)
        return out

    def document_scores(self, texts: list[str | None], terms: Terms) -> np.ndarray:
        """The score of each text between 0 and 1: that of its highest window; 0 without words."""
        each = [windows(t) for t in texts]
        counts = np.fromiter(map(len, each), np.int64, len(each))
        out, some = np.zeros(len(each)), np.flatnonzero(counts)
        if len(some):
            z = self.log_odds(*known_terms(*terms.flat([w for d in each for w in d]), self.known, int(counts.sum())))
            top = np.maximum.reduceat(z, (np.cumsum(counts) - counts)[some]).astype(np.float64)
            out[some] = 1 / (1 + np.exp(-np.clip(top - self.limit, -30, 30)))
        return out

    def fit(self, ids: np.ndarray, starts: np.ndarray, rows: np.ndarray, label: np.ndarray, rounds: int, rate: float = 0.05, decay: float = 6e-4) -> Machine:
        """Adam over mini-batches of the windows rows, with weighted logistic loss: those of cases weigh together an eighth as much as the others, each at least 1."""
        n, length_of = len(rows), np.diff(starts)
        positive = label[rows].sum()
        weight = np.where(label, min(20.0, max(1.0, (n - positive) / max(1, positive) / 8)), 1.0).astype(np.float32)
        rng = np.random.default_rng(11)
        m = [np.zeros_like(self.weight), np.zeros_like(self.factor)]
        s = [np.zeros_like(self.weight), np.zeros_like(self.factor)]
        size = max(128, -(-n // 24))
        for _ in range(rounds):
            order = rows[rng.permutation(n)]
            for at in range(0, n, size):
                some = order[at : at + size]
                length = length_of[some]
                local = np.cumsum(length) - length
                of = ids[np.repeat(starts[some] - local, length) + np.arange(length.sum())]
                v = self.factor[of]
                total = np.add.reduceat(v, local)
                z = self.bias + np.add.reduceat(self.weight[of], local) + 0.5 * (total**2 - np.add.reduceat(v * v, local)).sum(axis=1)
                g = (weight[some] * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - label[some])).astype(np.float32) / weight[some].sum() * 50
                each = np.repeat(g, length)
                gv = each[:, None] * (np.repeat(total, length, axis=0) - v)
                touched, where = np.unique(of, return_inverse=True)
                gw = np.bincount(where, each, len(touched)).astype(np.float32)
                gv = np.stack([np.bincount(where, gv[:, f], len(touched)) for f in range(FACTORS)], axis=1).astype(np.float32)
                self.bias -= rate * 0.2 * float(g.sum())
                for x, grad, k, pace in ((self.weight, gw, 0, rate), (self.factor, gv, 1, rate / 4)):
                    grad = grad + decay * 50 * x[touched]
                    m[k][touched] = 0.9 * m[k][touched] + 0.1 * grad
                    s[k][touched] = 0.98 * s[k][touched] + 0.02 * grad * grad
                    x[touched] -= pace * m[k][touched] / (np.sqrt(s[k][touched]) + 1e-3)
        return self


def averaged(machines: list[Machine]) -> Machine:
    """One machine whose log-odds are the mean of several: the factors stand side by side."""
    out = Machine(machines[0].known)
    out.bias = float(np.mean([m.bias for m in machines]))
    out.weight = np.mean([m.weight for m in machines], axis=0).astype(np.float32)
    out.factor = np.concatenate([m.factor for m in machines], axis=1) / np.float32(np.sqrt(len(machines)))
    return out


class Sample:
    """The windows of labelled documents, each set of terms once a document: ids on end, starts, doc (document) and cases by document."""

    def __init__(self, texts: list[str], cases: np.ndarray) -> None:
        each = [windows(t) for t in texts]
        rows, doc = [w for d in each for w in d], np.repeat(np.arange(len(each)), np.fromiter(map(len, each), np.int64, len(each)))
        at, terms = Terms().flat(rows)
        found, which = np.unique(terms, return_inverse=True)
        n = np.bincount(np.unique(doc[at] * max(len(found), 1) + which) % max(len(found), 1), minlength=len(found))
        self.known = found[n >= 2]  # terms of a single document say nothing and weigh nothing
        hidden = np.array([any("*" in w or "#" in w for w in words) for words in rows], bool)
        again = np.flatnonzero(hidden)
        at2, terms2 = Terms(self.known).flat([rows[i] for i in again])
        plainly = ~hidden[at] if len(at) else np.zeros(0, bool)
        ids, starts = known_terms(np.concatenate((at[plainly], again[at2])), np.concatenate((terms[plainly], terms2)), self.known, len(rows))
        keep, seen = [], set()
        for i in range(len(rows)):
            key = (doc[i], ids[starts[i] : starts[i + 1]].tobytes())
            if starts[i + 1] > starts[i] and key not in seen:
                seen.add(key)
                keep.append(i)
        self.ids = np.concatenate([ids[starts[i] : starts[i + 1]] for i in keep]).astype(np.int32) if keep else np.zeros(0, np.int32)
        self.starts, self.doc, self.cases = np.concatenate(([0], np.cumsum(np.diff(starts)[keep]))).astype(np.int64), doc[keep], cases.astype(bool)

    def evidence(self, used: np.ndarray, folds: int = 5) -> tuple[np.ndarray, float]:
        """How much more often than by chance the terms of a window stand in cases, over the used documents of other folds, and what is chance."""
        n, cases = max(len(self.known), 1), self.cases
        doc, term = np.divmod(np.unique(np.repeat(self.doc, np.diff(self.starts)) * n + self.ids), n)
        fold = np.random.default_rng(5).permutation(len(cases)) % folds
        count = {(side, f): np.bincount(term[(cases[doc] == side) & (fold[doc] == f) & used[doc]], minlength=n) for side in (True, False) for f in range(folds)}
        out, chance = np.zeros(len(self.doc)), np.log(used.sum() + 20)  # the more documents, the more terms are telling by chance
        for f in range(folds):
            yes, no = (sum(count[side, g] for g in range(folds) if g != f) for side in (True, False))
            expected = (yes + no + 0.5) * cases[used].mean()
            surprise = np.where(yes > expected, yes * np.log(np.maximum(yes, 1) / expected) - yes + expected, 0.0)
            telling = np.where((yes >= 2) & (yes > 2 * no) & (surprise > 0.45 * chance), surprise, 0.0)
            of_fold = fold[self.doc] == f
            out[of_fold] = np.add.reduceat(telling[self.ids], self.starts[:-1])[of_fold]
        return out, float(chance)

    def fitted(self, seed: int, used: np.ndarray) -> Machine:
        """The machine of the used documents. Of a case those windows count that have telling terms, then of these those the first fit finds too.

        A case without such windows is left out. Where no term is telling yet, for want of labels, cases of a single window count.
        """
        mine, case = used[self.doc], self.cases[self.doc]
        if not (mine & case).any():
            out = Machine(self.known, seed)
            out.factor[:] = 0
            return out
        fit = lambda chosen, start, rounds: Machine(self.known, start).fit(self.ids, self.starts, np.flatnonzero(mine & (chosen | ~case)), chosen, rounds)
        evidence, chance = self.evidence(used)
        first = case & (evidence > 0.9 * chance)
        if not (mine & first).any():
            return fit(case & (np.bincount(self.doc)[self.doc] == 1), seed, 14)
        z = fit(first, seed, 12).log_odds(self.ids, self.starts)
        return fit(case & (evidence > 0.45 * chance) & (z > 0), seed + 100, 14)

    def highest(self, machine: Machine) -> np.ndarray:
        """The highest log-odds of each document, far below 0 without windows."""
        out = np.full(len(self.cases), NOWHERE)
        np.maximum.at(out, self.doc, machine.log_odds(self.ids, self.starts).astype(np.float64))
        return out


def best_limit(z: np.ndarray, cases: np.ndarray) -> float:
    """The log-odds that part documents with the fewest errors, halfway between two documents; 0 where none would be found. Those without windows don't count."""
    z, cases = z[z > NOWHERE], cases[z > NOWHERE]
    order = np.argsort(-z, kind="stable")
    errors = np.concatenate(([0], np.cumsum(np.where(cases[order], -1, 1))))
    i = int(errors.argmin())
    if not i:
        return 0.0
    return float((z[order[i - 1]] + z[order[i]]) / 2) if i < len(z) else float(z[order[-1]])


def fold_of(n: int, folds: int) -> np.ndarray:
    return np.random.default_rng(3).permutation(n) % folds


def trained(sample: Sample, spark: SparkSession | None = None, machines: int = MACHINES, folds: int = FOLDS) -> Machine:
    """The mean of the machines of the sample, with the limit that its folds give. With spark, each machine and each fold is a task."""
    fold = fold_of(len(sample.cases), folds)

    def one(i: int, sample: Sample) -> Machine:
        return sample.fitted(7 + i, np.ones(len(fold), bool) if i < machines else fold != i - machines)

    if spark is None:
        fitted = [one(i, sample) for i in range(machines + folds)]
    else:
        shared = spark.sparkContext.broadcast(sample)  # bounded by SAMPLE

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for i in b.column("id").to_pylist():
                    m = one(i, shared.value)
                    yield pa.RecordBatch.from_pylist([{"id": i, "bias": m.bias, "weight": m.weight.tobytes(), "factor": m.factor.tobytes()}], schema)

        schema = pa.schema([("id", pa.int64()), ("bias", pa.float64()), ("weight", pa.binary()), ("factor", pa.binary())])
        fitted = []
        found = spark.range(0, machines + folds, 1, machines + folds).mapInArrow(run, "id bigint, bias double, weight binary, factor binary").collect()
        for r in sorted(found, key=lambda r: r["id"]):
            m = Machine(sample.known)
            m.bias, m.weight, m.factor = r["bias"], np.frombuffer(r["weight"], np.float32), np.frombuffer(r["factor"], np.float32).reshape(-1, FACTORS)
            fitted.append(m)
        shared.unpersist()
    unseen = np.full(len(fold), NOWHERE)
    for f in range(folds):
        unseen[fold == f] = sample.highest(fitted[machines + f])[fold == f]
    out = averaged(fitted[:machines])
    out.limit = best_limit(unseen, sample.cases)
    used = (out.weight != 0) | out.factor.any(axis=1)
    out.known, out.weight, out.factor = out.known[used], out.weight[used], out.factor[used]
    return out


def labelled(documents: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> pd.DataFrame:
    """text and case of at most so many labelled documents: the majority of the labels, ties and nulls left out."""
    case = F.col("label").isin(*CASES)
    each = labels.filter("label is not null").dropDuplicates(["doc_id", "rater", "label"]).groupBy("doc_id").agg(F.avg(case.cast("int")).alias("share"))
    chosen = each.filter("share != 0.5").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    return documents.select("doc_id", "text").filter("text is not null").join(chosen, "doc_id").selectExpr("doc_id", "text", "share > 0.5 as positive").toPandas().sort_values("doc_id")


def scored(documents: DataFrame, machine: Machine) -> DataFrame:
    """documents with its column text replaced by score (0 to 1; 0 for null, empty and wordless texts). The machine is bounded by SAMPLE."""
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in documents.schema if f.name not in ("text", "score")), "score double"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(machine.known)
        for b in batches:
            keep = [n for n in b.schema.names if n not in ("text", "score")]
            texts, scores = b.column("text").to_pylist(), []
            for at in range(0, len(texts), 500):
                scores.append(machine.document_scores(texts[at : at + 500], terms))
            yield pa.RecordBatch.from_arrays([*(b.column(n) for n in keep), pa.array(np.concatenate(scores) if scores else np.zeros(0))], [*keep, "score"])

    return documents.mapInArrow(run, schema)


def learned(documents: DataFrame, labels: DataFrame) -> Machine:
    """The machine of a corpus, fitted on its labelled documents."""
    rows = labelled(documents, labels)
    return trained(Sample(rows["text"].tolist(), rows["positive"].to_numpy(bool)), documents.sparkSession)


def p7_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, source and score of every document."""
    documents = table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return scored(documents, learned(documents, table(spark, sf_dir, "doc_labels", "doc_id", "rater", "label")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id of every document of a score of at least THRESHOLD."""
    return p7_scores(spark, sf_dir).filter(F.col("score") >= THRESHOLD).select("doc_id")


def p7_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source, n_documents, n_cases and mean_score."""
    return p7_scores(spark, sf_dir).groupBy("source").agg(F.count("*").alias("n_documents"), F.count_if(F.col("score") >= THRESHOLD).alias("n_cases"), F.round(F.avg("score"), 6).alias("mean_score"))
