"""Operator 1: toxicity by a factorization machine over hashed terms."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollkeep.llm.storage import fresh, lean_batches, materialize
from rollkeep.llm.words import ALNUM, LOWER, VALUES, Block, blocks, mix, prefix_hash, span_hash

#: Lengths in bytes of the beginnings of longer words that count as terms besides the words.
STEMS = (4, 5, 6, 7, 8, 9)
#: Bounds of what is fitted: labelled rows in the sample (the toxic ones among them come first) and terms kept.
SAMPLE, TERMS = 8000, 1024
#: The least log-likelihood ratio (G squared) of a term against the label, so that chance finds among many terms stay out.
TELLING = 20.0
#: Terms that may tell only beside another: those in at least so many texts, counted beside the most telling and the most
#: frequent anchors. The ratio must be higher, as there are more pairs for chance to find.
LEAST_TEXTS, ANCHORS, TELLING_PAIR = 10, (64, 16), 30.0
RANK = 4
THRESHOLD = 0.7


def terms(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(text number, term hash) of each word and each stem of a longer word, repeats included."""
    prefix, text, length = prefix_hash(VALUES[LOWER[b.data]]), b.text_of_word, b.end - b.start
    texts, hashes = [text], [span_hash(prefix, b.start, b.end)]
    for n in STEMS:
        longer = length > n
        start = b.start[longer]
        texts.append(text[longer])
        hashes.append(mix(span_hash(prefix, start, start + n) + np.uint64(n)))
    return np.concatenate(texts), np.concatenate(hashes)


def count_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, toxic, clean): in how many toxic and clean texts of some blocks each term stands."""
    for batch in batches:
        label = batch.column("toxic").to_numpy()
        for b in blocks(batch.column("text"), ALNUM, block=4 << 20):
            t, h = terms(b)
            pairs = np.unique(np.rec.fromarrays([h, t], names="h,t"))
            toxic = label[b.offset + pairs.t] == 1
            term, at = np.unique(pairs.h, return_inverse=True)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (term.view(np.int64), np.bincount(at[toxic], minlength=len(term)), np.bincount(at[~toxic], minlength=len(term)))], names=["term", "toxic", "clean"])


def count_pairs(anchors: np.ndarray, frequent: np.ndarray):
    """Arrow function: (anchor, term, toxic, clean): in how many toxic and clean texts an anchor and a frequent term stand together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("toxic").to_numpy()
            for b in blocks(batch.column("text"), ALNUM):
                t, h = terms(b)
                at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                held = np.unique(t[frequent[at] == h] * len(frequent) + at[frequent[at] == h])
                text, term = held // len(frequent), held % len(frequent)
                found, out = np.searchsorted(anchors, frequent[term]), []
                is_anchor = anchors[np.minimum(found, len(anchors) - 1)] == frequent[term]
                first = np.searchsorted(text, np.arange(b.n + 1))
                for i in range(b.n):
                    mine = slice(first[i], first[i + 1])
                    beside = found[mine][is_anchor[mine]]
                    out.append(((beside[:, None] * len(frequent) + term[mine][None, :]) * 2 + int(label[b.offset + i] == 1)).reshape(-1))
                pairs, n = np.unique(np.concatenate(out), return_counts=True)
                pair, toxic = pairs // 2, pairs % 2 == 1
                which, back = np.unique(pair, return_inverse=True)
                sums = [np.bincount(back, np.where(x, n, 0), minlength=len(which)).astype(np.int64) for x in (toxic, ~toxic)]
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in ((which // len(frequent)).astype(np.int32), frequent[which % len(frequent)].view(np.int64), *sums)], names=["anchor", "term", "toxic", "clean"])

    return run


def active(known: np.ndarray, b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text number, place in the sorted ``known``, value) of the distinct known terms of each text.

    The value is the logarithm of one plus the term's occurrences in 100 words of the text.
    """
    maybe = np.zeros(1 << 16, dtype=bool)
    maybe[(known >> np.uint64(48)).astype(np.int64)] = True
    t, h = terms(b)
    some = maybe[(h >> np.uint64(48)).astype(np.int64)]
    t, h = t[some], h[some]
    at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
    same = known[at] == h if len(known) else np.zeros(0, dtype=bool)
    pairs, count = np.unique(t[same] * len(known) + at[same], return_counts=True)
    text = pairs // max(len(known), 1)
    return text, pairs % max(len(known), 1), np.log1p(100 * count / np.diff(b.first)[text])


@dataclass
class Machine:
    """A fitted factorization machine over ``known`` terms (sorted hashes)."""

    known: np.ndarray
    bias: float
    weight: np.ndarray
    factor: np.ndarray

    def scores(self, n: int, text: np.ndarray, term: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Probability of toxicity of n texts from their active (text, term, value)."""
        linear = np.bincount(text, self.weight[term] * value, minlength=n).astype(float)
        cross = np.zeros(n)
        for f in range(self.factor.shape[1]):
            v = self.factor[term, f] * value
            cross += np.bincount(text, v, minlength=n) ** 2 - np.bincount(text, v * v, minlength=n)
        return 1 / (1 + np.exp(-np.clip(self.bias + linear + cross / 2, -30, 30)))


def fit_machine(known: np.ndarray, rows: list[tuple[np.ndarray, np.ndarray]], label: np.ndarray, epochs: int = 60, decay: float = 1e-4, seed: int = 1) -> Machine:
    """Logistic loss, AdaGrad in batches of 64 rows; rows hold places in ``known`` and values."""
    rng = np.random.default_rng(seed)
    m = Machine(known, float(np.log((label.sum() + 1) / (len(label) - label.sum() + 1))), np.zeros(len(known)), rng.normal(0, 0.05, (len(known), RANK)))
    g_bias, g_weight, g_factor = 1.0, np.ones(len(known)), np.ones((len(known), RANK))
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for i in range(0, len(order), 64):
            some = order[i : i + 64]
            text = np.repeat(np.arange(len(some)), [len(rows[k][0]) for k in some])
            term, value = (np.concatenate([rows[k][c] for k in some]) for c in (0, 1))
            slope = m.scores(len(some), text, term, value) - label[some]
            each = slope[text] * value
            sums = np.zeros((len(some), RANK))
            np.add.at(sums, text, m.factor[term] * value[:, None])
            d_weight = np.bincount(term, each, minlength=len(known)).astype(float)
            d_factor = np.zeros_like(m.factor)
            np.add.at(d_factor, term, each[:, None] * (sums[text] - m.factor[term] * value[:, None]))
            seen = np.unique(term)
            d_weight[seen] += decay * len(some) * m.weight[seen]
            d_factor[seen] += decay * len(some) * m.factor[seen]
            g_weight += d_weight**2
            g_factor += d_factor**2
            g_bias += slope.sum() ** 2
            m.bias -= 0.3 * slope.sum() / np.sqrt(g_bias)
            m.weight -= 0.3 * d_weight / np.sqrt(g_weight)
            m.factor -= 0.1 * d_factor / np.sqrt(g_factor)
    return m


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic, one row for each labelled id."""
    return labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))


def sampling_shift(known: DataFrame, bound: int) -> float:
    """How much higher the log odds of toxicity are among all labels than among those that are sampled."""
    n = {r["toxic"]: r["n"] for r in known.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    taken = {k: min(v, bound // 2) for k, v in n.items()}
    if not taken.get(0) or not taken.get(1):
        return 0.0
    return float(np.log(n[1] / taken[1]) - np.log(n[0] / taken[0]))


def labelled_sample(docs: DataFrame, labels: DataFrame, bound: int) -> DataFrame:
    """text and toxic of at most ``bound`` labelled rows: up to half of it toxic, all by the hash of doc_id."""
    known = known_labels(labels)
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = known.where("toxic = 1").orderBy(*order).limit(bound // 2).unionByName(known.where("toxic = 0").orderBy(*order).limit(bound // 2))
    # At most ``bound`` ids are broadcast; an id that stands on many rows gives one of them.
    held = docs.join(F.broadcast(some), "doc_id").select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "toxic")
    return held.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("toxic").alias("toxic")).select("text", "toxic")


def _g2(toxic: Column, clean: Column, n1: int | Column, n0: int | Column) -> Column:
    """The log-likelihood ratio of a term's presence and the label among n1 toxic and n0 clean texts."""
    n1, n0 = (x if isinstance(x, Column) else F.lit(x) for x in (n1, n0))
    xlogx = lambda x: F.when(x > 0, x * F.log(x)).otherwise(0.0)
    cells = xlogx(toxic) + xlogx(clean) + xlogx(n1 - toxic) + xlogx(n0 - clean)
    return 2 * (cells + xlogx(n1 + n0) - xlogx(toxic + clean) - xlogx(n1 + n0 - toxic - clean) - xlogx(n1) - xlogx(n0))


def _telling_pairs(sample: DataFrame, counts: DataFrame, telling: list[int], n: int) -> list[int]:
    """Terms that tell beside an anchor, and these anchors, the most telling pair first."""
    texts = F.col("toxic") + F.col("clean")
    # Of a bounded sample; terms in nearly all texts set none of them apart.
    frequent = counts.where((texts >= LEAST_TEXTS) & (texts <= 0.9 * n)).select("term", texts.alias("n"))
    common = [r["term"] for r in frequent.orderBy(F.desc("n"), "term").limit(ANCHORS[1]).collect()]
    known = np.sort(np.array(frequent.select("term").toArrow().column(0), dtype=np.int64).view(np.uint64))
    anchors = np.intersect1d(np.array(sorted({*telling, *common}), dtype=np.int64).view(np.uint64), known)
    if not len(anchors):
        return []
    pairs = sample.mapInArrow(count_pairs(anchors, known), "anchor int, term long, toxic long, clean long").groupBy("anchor", "term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    pairs = materialize(pairs)
    own = sample.sparkSession.createDataFrame(list(enumerate(anchors.view(np.int64).tolist())), "anchor int, term long")
    alone = pairs.join(F.broadcast(own), ["anchor", "term"]).select("anchor", F.col("toxic").alias("n1"), F.col("clean").alias("n0"))  # a row for each anchor
    ratio = _g2(F.col("toxic"), F.col("clean"), F.col("n1"), F.col("n0"))
    found = pairs.join(F.broadcast(alone), "anchor").withColumn("ratio", ratio).where(F.col("ratio") >= TELLING_PAIR).orderBy(F.desc("ratio"), "anchor", "term").limit(TERMS).collect()
    return list(dict.fromkeys(x for r in found for x in (int(anchors.view(np.int64)[r["anchor"]]), r["term"])))


def fit(docs: DataFrame, labels: DataFrame, bound: int = SAMPLE, n_terms: int = TERMS) -> Machine:
    """Fit on a bounded sample: count its terms in Spark, keep the most telling, learn their weights.

    Half of the terms may be such that tell only beside another: among the texts with an
    anchor their ratio is high, whatever it is among all; their anchors are kept too.
    The sample thins the larger class alone once there are more labels than it holds; the
    bias is moved back to the odds among all labels.
    """
    lean_batches(docs.sparkSession)
    sample = materialize(labelled_sample(docs, labels, bound))
    counts = materialize(sample.mapInArrow(count_terms, "term long, toxic long, clean long").groupBy("term").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    telling = _g2(F.col("toxic"), F.col("clean"), n1, n0)
    best = counts.where(telling >= TELLING).orderBy(telling.desc(), "term").limit(n_terms).select("term").collect()
    beside = _telling_pairs(sample, counts, [r["term"] for r in best[: ANCHORS[0]]], n1 + n0)
    chosen = dict.fromkeys(beside[: n_terms // 2])
    chosen |= dict.fromkeys([r["term"] for r in best][: n_terms - len(chosen)])
    known = np.sort(np.array(list(chosen), dtype=np.int64).view(np.uint64))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text"), ALNUM):
                text, term, value = active(known, b)
                at = pa.array(np.searchsorted(text, np.arange(b.n + 1)).astype(np.int32))
                lists = [pa.ListArray.from_arrays(at, pa.array(x)) for x in (term.astype(np.int32), value)]
                yield pa.RecordBatch.from_arrays([batch.column("toxic")[b.offset : b.offset + b.n], *lists], names=["toxic", "terms", "values"])

    # At most ``bound`` rows of ``n_terms`` numbers come to the driver.
    got = sample.mapInArrow(rows, "toxic int, terms array<int>, values array<double>").collect()
    got.sort(key=lambda r: (r["toxic"], r["terms"], r["values"]))
    machine = fit_machine(known, [(np.array(r["terms"], dtype=np.int64), np.array(r["values"], dtype=float)) for r in got], np.array([r["toxic"] for r in got], dtype=float))
    machine.bias += sampling_shift(known_labels(labels), bound)
    return machine


def add_scores(docs: DataFrame, machine: Machine, name: str) -> DataFrame:
    """``docs`` with the score of ``text`` in a double column ``name``."""
    lean_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(machine)  # of a fixed number of terms

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [held.value.scores(b.n, *active(held.value.known, b)) for b in blocks(batch.column("text"), ALNUM)]
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.DoubleType())]))


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of each document.

    Rows with crc32(doc_id as text) mod 3 = 1 are held out: nothing is learned from their
    labels. Null texts count as empty and get the score of no terms; labels other than 0
    and 1 and labels without a document are ignored; an id labelled twice is toxic if either
    label is; without labels every score is one half. Other columns are ignored.
    """
    part = held_out_part(F.col("doc_id"))
    learn = labels.where(part != 1)
    machine = fit(docs.select("doc_id", "text"), learn)
    scored = add_scores(docs.select("doc_id", "text"), machine, "score")
    return scored.select("doc_id", (part == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def held_out_part(doc_id: Column) -> Column:
    """The fold of a document: crc32 of its id as text, modulo 3."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without those that score ``threshold`` or more."""
    score = fresh("_score", docs)
    machine = fit(docs.select("doc_id", "text"), labels.where(held_out_part(F.col("doc_id")) != 1))
    return add_scores(docs, machine, score).where(F.col(score) < threshold).select(*docs.columns)
