"""Operator 13: language of whole texts and of the spans of mixed ones."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollkeep.llm.storage import lean_batches
from rollkeep.llm.toxicity import held_out_part
from rollkeep.llm.words import mix, prefix_hash, span_hash

# First and last code points of scripts. Letters elsewhere share script 0.
SCRIPTS = {
    "latin": ((0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF), (0xFF21, 0xFF5A)),
    "greek": ((0x370, 0x3FF), (0x1F00, 0x1FFF)),
    "cyrillic": ((0x400, 0x52F), (0x1C80, 0x1C8F), (0x2DE0, 0x2DFF), (0xA640, 0xA69F)),
    "armenian": ((0x530, 0x58F),),
    "hebrew": ((0x590, 0x5FF), (0xFB1D, 0xFB4F)),
    "arabic": ((0x600, 0x6FF), (0x750, 0x77F), (0x8A0, 0x8FF), (0xFB50, 0xFDFF), (0xFE70, 0xFEFF)),
    "devanagari": ((0x900, 0x97F), (0xA8E0, 0xA8FF)),
    "bengali": ((0x980, 0x9FF),),
    "gurmukhi": ((0xA00, 0xA7F),),
    "gujarati": ((0xA80, 0xAFF),),
    "tamil": ((0xB80, 0xBFF),),
    "telugu": ((0xC00, 0xC7F),),
    "kannada": ((0xC80, 0xCFF),),
    "malayalam": ((0xD00, 0xD7F),),
    "thai": ((0xE00, 0xE7F),),
    "georgian": ((0x10A0, 0x10FF), (0x1C90, 0x1CBF)),
    "ethiopic": ((0x1200, 0x139F),),
    "kana": ((0x3040, 0x30FF), (0x31F0, 0x31FF), (0xFF66, 0xFF9F)),
    "hangul": ((0x1100, 0x11FF), (0x3130, 0x318F), (0xAC00, 0xD7AF)),
    "han": ((0x3005, 0x3007), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0x20000, 0x323AF)),
}
NONE, MARK = -1, -2
#: Slots of a language's counts, as powers of two: sequences of 1 to 4 letters, the word's edges included, and whole words.
BITS = (12, 14, 16, 17, 17)
#: The table of all languages has at most so many cells; with more languages than fit, each order has fewer slots.
CELLS, MOST_LANGUAGES = 1 << 23, 4096
#: A language is a candidate for words of a script that has this share of the letters it was learned from.
SCRIPT_SHARE = 0.001
#: What a change of language costs between two words (nats), and the part of a word's score when its script rules a language out.
SWITCH, RULED_OUT = 8.0, -1e4
#: Letters whose sequences are looked up together, and cells of word scores held at a time.
GROUP, HELD = 1 << 18, 1 << 25
UNDETERMINED = "und"


@cache
def letter_tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its script (NONE if it is no letter, MARK if it belongs to the letter before it) and its lower case."""
    n = 0x110000
    kind, lower = np.full(n, NONE, dtype=np.int8), np.arange(n, dtype=np.uint32)
    for c in range(n):
        category = unicodedata.category(chr(c))[0]
        if category == "L":
            kind[c] = 0
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
        elif category == "M":
            kind[c] = MARK
    for i, ranges in enumerate(SCRIPTS.values(), 1):
        for first, last in ranges:
            held = kind[first : last + 1]
            held[held == 0] = i
    return kind, lower


@dataclass
class Words:
    """The words of some whole texts: code points, starts, ends and scripts of words, and each text's first word (one entry more)."""

    codes: np.ndarray
    bounds: np.ndarray
    start: np.ndarray
    end: np.ndarray
    script: np.ndarray
    first: np.ndarray

    @property
    def text(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def words_of(texts: list[str | None]) -> Words:
    """Maximal runs of letters of one script; marks go with the letter before them."""
    kind_of, lower = letter_tables()
    bounds = np.concatenate([[0], np.cumsum([len(t or "") for t in texts])]).astype(np.int64)
    codes = np.frombuffer("".join(t or "" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    kind = kind_of[codes]
    begins = bounds[:-1][np.diff(bounds) > 0]
    opening = begins[kind[begins] == MARK]
    kind[opening] = NONE
    at = np.where(kind == MARK, 0, np.arange(len(kind)))
    kind = kind[np.maximum.accumulate(at)] if len(kind) else kind
    change = np.ones(len(kind), dtype=bool)
    change[1:] = kind[1:] != kind[:-1]
    change[begins] = True
    edges = np.append(np.flatnonzero(change), len(kind))
    inside = kind[edges[:-1]] >= 0
    start = edges[:-1][inside]
    return Words(lower[codes], bounds, start, edges[1:][inside], kind[start], np.searchsorted(start, bounds))


def bits_for(languages: int) -> tuple[int, ...]:
    less = 0
    while languages * sum(1 << (b - less) for b in BITS) > CELLS and less < min(BITS):
        less += 1
    return tuple(b - less for b in BITS)


def slots_of(w: Words, a: int, b: int, bits: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Slots of the words a to b: (orders, places) for letter sequences, -1 where there is none; the first place of each word; slots of the words."""
    length = w.end[a:b] - w.start[a:b]
    n, total = b - a, int(length.sum())
    before = np.cumsum(length) - length
    letters = np.arange(total)
    spelled = np.zeros(total + n + 1, dtype=np.uint64)  # each word with a 0 before and after it
    spelled[letters + np.repeat(np.arange(n) + 1, length)] = w.codes[letters + np.repeat(w.start[a:b] - before, length)]
    out = np.full((len(bits) - 1, total + n), -1, dtype=np.int64)
    base, gram, whole = 0, spelled, np.ones(total + n + 1, dtype=bool)
    for k, size in enumerate(bits[:-1]):
        if k:
            gram = gram[:-1] * np.uint64(0x9E3779B97F4A7C15) + spelled[k:]
            whole = whole[:-1] & (spelled[k - 1 : -1] != 0 if k > 1 else True)
        held = whole & (spelled != 0) if k == 0 else whole
        slot = base + (mix(gram + np.uint64(k)) >> np.uint64(64 - size)).astype(np.int64)
        # A sequence belongs to the word at its last place; place 0 is the 0 before the first word.
        out[k, max(k - 1, 0) :] = np.where(held, slot, -1)[1 if k == 0 else 0 :]
        base += 1 << size
    prefix, at = prefix_hash(spelled), before + np.arange(n)
    word = base + (span_hash(prefix, at + 1, at + 1 + length) >> np.uint64(64 - bits[-1])).astype(np.int64)
    return out, at, word


def groups(w: Words) -> Iterator[tuple[int, int]]:
    """Ranges of words with about GROUP letters."""
    upto = np.cumsum(w.end - w.start)
    a = 0
    while a < len(upto):
        b = max(a + 1, int(np.searchsorted(upto, (upto[a - 1] if a else 0) + GROUP, side="right")))
        yield a, b
        a = b


def count_letters(languages: int):
    """Arrow function over (text, lang): (slot, lang, n) of one task, scripts after the other slots."""
    bits = bits_for(languages)
    slots = sum(1 << b for b in bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells = np.zeros((slots + len(SCRIPTS) + 1) * languages, dtype=np.int64)
        for batch in batches:
            w = words_of(batch.column("text").to_pylist())
            lang = batch.column("lang").to_numpy()[w.text].astype(np.int64)
            for a, b in groups(w):
                grams, at, word = slots_of(w, a, b, bits)
                of = np.repeat(lang[a:b], np.diff(np.append(at, grams.shape[1])))
                for row in grams:
                    held = row >= 0
                    np.add.at(cells, row[held] * languages + of[held], 1)
                np.add.at(cells, word * languages + lang[a:b], 1)
                np.add.at(cells, (slots + w.script[a:b].astype(np.int64)) * languages + lang[a:b], w.end[a:b] - w.start[a:b])
        found = np.flatnonzero(cells)
        for i in range(0, len(found), 1 << 16):
            part = found[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array((part // languages).astype(np.int32)), pa.array((part % languages).astype(np.int32)), pa.array(cells[part])], names=["slot", "lang", "n"])

    return run


@dataclass
class Model:
    """``scores`` holds the log probability of each slot in each language (a last row of zeros), ``allowed`` the languages of each script, ``prior`` their log share of the learned texts."""

    languages: list[str]
    bits: tuple[int, ...]
    scores: np.ndarray
    allowed: np.ndarray
    prior: np.ndarray


def fit(docs: DataFrame) -> Model:
    """Learn from all rows of (text, lang) with a language.

    What meets on the driver is a count for each slot and language, at most ``CELLS`` of them and the scripts.
    Counts are mixed with the mean of all languages by the share of new sequences among all
    (Witten-Bell), so that what no language has seen tells nothing.
    """
    learned = docs.where("lang IS NOT NULL").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    counted = {r["lang"]: r["n"] for r in learned.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(counted) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    languages = sorted(counted)
    bits, k = bits_for(len(languages)), len(languages)
    slots = sum(1 << b for b in bits)
    cells = np.zeros((slots + len(SCRIPTS) + 1, k))
    if k:
        lean_batches(docs.sparkSession)
        number = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")) - 1
        found = learned.select("text", number.cast("int").alias("lang")).mapInArrow(count_letters(k), "slot int, lang int, n long").groupBy("slot", "lang").agg(F.sum("n").alias("n")).toArrow()
        cells[found["slot"].to_numpy(), found["lang"].to_numpy()] = found["n"].to_numpy()
    scores, base = np.zeros((slots + 1, k), dtype=np.float32), 0
    for size in bits:
        c = cells[base : base + (1 << size)]
        n, kinds = c.sum(axis=0), (c > 0).sum(axis=0)
        share = c / np.maximum(n, 1)
        pooled = (share.mean(axis=1) if k else np.zeros(len(c))) + 1e-8
        new = np.clip(kinds / np.maximum(n + kinds, 1), 0.01, 1)
        new[n == 0] = 1
        scores[base : base + (1 << size)] = np.log((1 - new) * share + new * pooled[:, None])
        base += 1 << size
    scripts = cells[slots:]
    allowed = scripts / np.maximum(scripts.sum(axis=0), 1) >= SCRIPT_SHARE
    total = sum(counted.values())
    return Model(languages, bits, scores, allowed, np.log(np.array([(counted[x] + 1) / (total + k) for x in languages])))


def word_scores(w: Words, m: Model) -> np.ndarray:
    """(words, languages): the mean over the orders of the log probabilities of a word's sequences; languages that don't use its script are ruled out."""
    k = len(m.languages)
    out = np.zeros((len(w.start), k), dtype=np.float32)
    step = max(1, (1 << 22) // k)
    for a, b in groups(w):
        grams, at, word = slots_of(w, a, b, m.bits)
        got = m.scores[word].astype(np.float64)
        of = np.repeat(np.arange(b - a), np.diff(np.append(at, grams.shape[1])))
        for i in range(0, grams.shape[1], step):
            part = of[i : i + step]
            edges = np.flatnonzero(np.diff(part, prepend=-1))
            for row in grams[:, i : i + step]:
                got[part[edges]] += np.add.reduceat(m.scores[row], edges, axis=0)
        out[a:b] = got / len(m.bits)
    allowed = m.allowed[w.script]
    out[~allowed & allowed.any(axis=1, keepdims=True)] = RULED_OUT
    out[~allowed.any(axis=1)] = 0
    return out


def best_path(scores: np.ndarray, first: np.ndarray, prior: np.ndarray, switch: float = SWITCH) -> np.ndarray:
    """Viterbi: the language of each word on the best path of each text.

    Texts advance together, the longest first, so a step costs one numpy call for all of them.
    A word's language is that of the word before it, or any other at the price ``switch``.
    """
    length = np.diff(first)
    order = np.argsort(-length, kind="stable")
    begin, length = first[:-1][order], length[order]
    longest = int(length[0]) if len(length) else 0
    active = len(length) - np.searchsorted(length[::-1], np.arange(longest), side="right")
    stay = np.ones(scores.shape, dtype=bool)
    leap = np.zeros(len(scores), dtype=np.int16)
    best = np.zeros((len(length), scores.shape[1]))
    for t in range(longest):
        n = active[t]
        at = begin[:n] + t
        if t == 0:
            best[:n] = prior + scores[at]
            continue
        now = best[:n]
        top = now.argmax(axis=1)
        other = now[np.arange(n), top] - switch
        kept = now >= other[:, None]
        stay[at], leap[at] = kept, top
        best[:n] = np.where(kept, now, other[:, None]) + scores[at]
    state = best.argmax(axis=1)
    out = np.zeros(len(scores), dtype=np.int16)
    for t in range(longest - 1, -1, -1):
        n = active[t]
        at = begin[:n] + t
        out[at] = state[:n]
        state[:n] = np.where(stay[at, state[:n]], state[:n], leap[at])
    return out


@dataclass
class Spans:
    """Runs of words of one text in one language: text, first and last word, language, letters, and how sure each language is."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    lang: np.ndarray
    letters: np.ndarray
    sure: np.ndarray


def spans_of(w: Words, m: Model) -> Spans:
    scores = word_scores(w, m)
    lang, text = best_path(scores, w.first, m.prior), w.text
    cut = np.ones(len(lang), dtype=bool)
    cut[1:] = (lang[1:] != lang[:-1]) | (text[1:] != text[:-1])
    first = np.flatnonzero(cut)
    if not len(first):
        none = np.zeros(0, dtype=np.int64)
        return Spans(none, none, none, none, none, np.zeros((0, len(m.languages))))
    total = np.add.reduceat(scores, first, axis=0, dtype=np.float64) + m.prior
    sure = np.exp(total - total.max(axis=1, keepdims=True))
    sure /= sure.sum(axis=1, keepdims=True)
    return Spans(text[first], first, np.append(first[1:], len(lang)) - 1, lang[first].astype(np.int64), np.add.reduceat(w.end - w.start, first), sure)


def pieces(column: pa.Array, m: Model) -> Iterator[tuple[int, Words]]:
    """Some whole texts at a time, and the number of the first."""
    texts, i = column.to_pylist(), 0
    most = HELD // max(1, len(m.languages))
    while i < len(texts):
        j, held = i + 1, len(texts[i] or "")
        while j < len(texts) and held + len(texts[j] or "") <= most:
            held += len(texts[j] or "")
            j += 1
        yield i, words_of(texts[i:j])
        i = j


def predicted(model):
    """Arrow function over (doc_id, held_out, text): doc_id, held_out, lang_pred and score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        k = len(m.languages)
        for batch in batches:
            names, score = [UNDETERMINED] * batch.num_rows, np.zeros(batch.num_rows)
            for offset, w in pieces(batch.column("text"), m) if k else ():
                s = spans_of(w, m)
                n = len(w.first) - 1
                letters = np.bincount(s.text * k + s.lang, weights=s.letters, minlength=n * k).reshape(n, k)
                pred, total = letters.argmax(axis=1), letters.sum(axis=1)
                sure = np.bincount(s.text, weights=s.letters * s.sure[np.arange(len(s.text)), pred[s.text]], minlength=n)
                for i in np.flatnonzero(total):
                    names[offset + i], score[offset + i] = m.languages[pred[i]], min(1.0, sure[i] / total[i])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(score)], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def spanned(model):
    """Arrow function over (doc_id, text): doc_id, start, end (code points, end exclusive), lang and score of each span."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for batch in batches:
            for offset, w in pieces(batch.column("text"), m) if m.languages else ():
                s = spans_of(w, m)
                begin = w.bounds[s.text]
                columns = [batch.column("doc_id").take(pa.array(s.text + offset)), pa.array(w.start[s.first] - begin), pa.array(w.end[s.last] - begin), pa.array([m.languages[x] for x in s.lang], pa.string()), pa.array(s.sure[np.arange(len(s.lang)), s.lang])]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "end", "lang", "score"])

    return run


def label_spans(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, start, end, lang, score: the spans of each text in one language, by words.

    Positions count code points; a span ends with its last word. A text without letters has no
    spans, nor has any text if the model knows no language. ``score`` is the probability of the span's
    language among all, by its words alone.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType())])
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(spanned(spark.sparkContext.broadcast(model)), schema)


def predict_languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for each row of ``docs`` (doc_id, text, lang).

    Learned from texts and languages of the rows whose crc32(doc_id as text) mod 3 isn't 1 and
    whose lang isn't null; a null doc_id counts as empty text. Words are runs of letters of
    one script. The script leaves the languages that use it as candidates; a Viterbi path over
    the words' scores, with a price for each change of language, labels spans, and
    ``lang_pred`` is the language with most letters in its spans (of equals the first by code
    point). ``score`` is the probability of that language in the spans, weighted by their letters.
    Null texts and texts without a letter, and all texts if nothing could be learned, are ``und``
    with score 0. Repeated rows and ids are rows like any others; other columns are ignored.
    An empty table gives no rows. The broadcast table is bounded by ``CELLS``.
    """
    spark = docs.sparkSession
    held = docs.select("doc_id", (held_out_part(F.col("doc_id")) == 1).alias("held_out"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    model = spark.sparkContext.broadcast(fit(held.where(~F.col("held_out"))))
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    lean_batches(spark)
    return held.select("doc_id", "held_out", "text").mapInArrow(predicted(model), schema)
