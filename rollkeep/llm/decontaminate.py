"""Operator 3: benchmark decontamination by winnowing."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeep.llm.storage import lean_batches, materialize
from rollkeep.llm.words import ALNUM, LOWER, anchors, blocks

WINDOW = 10
#: The same words for Spark's regular expressions, before lower-casing.
WORD = "[0-9A-Za-z\\x{80}-\\x{10FFFF}]+"
KEYS = "k1 long, k2 long"


def gram(n: int) -> int:
    """The k-gram length that winnows windows of n words: each has n - k + 1 of them."""
    return (n + 1) // 2


def keyed(docs: DataFrame) -> DataFrame:
    """The text and a 128-bit key of it: what is found for a text holds for all its copies."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"text": text, "k1": F.xxhash64(text), "k2": F.xxhash64(text, F.lit("second"))})


def fingerprints(lengths: list[int], exact: bool):
    """Arrow function: (k1, k2, n, pos, fp) for the winnowed k-grams of each text, for window lengths n.

    With ``exact``, as for the items, a text of fewer than ``WINDOW`` words counts as one
    window and gives fingerprints for its own length only.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k1, k2 = (batch.column(c).to_numpy() for c in ("k1", "k2"))
            for b in blocks(batch.column("text"), ALNUM):
                text, hashes, count = b.text_of_word, b.hashes(lower=True), np.diff(b.first)
                for n in lengths:
                    windows, at, grams = anchors(hashes, text, gram(n), n)
                    if exact:
                        own = np.minimum(count, WINDOW)[text[windows]] == n
                        at = at[own]
                    at = np.unique(at)
                    t = text[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(x) for x in (k1[b.offset + t], k2[b.offset + t], np.full(len(at), n, dtype=np.int32), (at - b.first[t]).astype(np.int32), grams[at].view(np.int64))],
                        names=["k1", "k2", "n", "pos", "fp"],
                    )

    return run


def item_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(item_id, n, words) for each window of an item; an item of under ``WINDOW`` words is one."""
    for batch in batches:
        ids = batch.column("item_id")
        for b in blocks(batch.column("text"), ALNUM):
            data = LOWER[b.data].tobytes()
            out: tuple[list, list, list] = ([], [], [])
            for i in range(b.n):
                words = [data[s:e] for s, e in zip(b.start[b.first[i] : b.first[i + 1]], b.end[b.first[i] : b.first[i + 1]], strict=True)]
                n = min(len(words), WINDOW)
                for j in range(len(words) - n + 1 if n else 0):
                    out[0].append(ids[b.offset + i].as_py())
                    out[1].append(n)
                    out[2].append(b" ".join(words[j : j + n]).decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string())], names=["item_id", "n", "words"])


def extended(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(k1, k2, n, start, words) for all windows that hold one of a text's hits (n, pos)."""
    for batch in batches:
        keys, hits = [batch.column(c) for c in ("k1", "k2")], batch.column("hits")
        for b in blocks(batch.column("text"), ALNUM):
            data = LOWER[b.data].tobytes()
            out: list[list] = [[], [], [], [], []]
            for i in range(b.n):
                lo, hi = int(b.first[i]), int(b.first[i + 1])
                starts = {(h["n"], s) for h in hits[b.offset + i].as_py() for s in range(max(0, h["pos"] - h["n"] + gram(h["n"])), min(h["pos"], hi - lo - h["n"]) + 1)}
                for n, s in sorted(starts):
                    words = b" ".join(data[x:y] for x, y in zip(b.start[lo + s : lo + s + n], b.end[lo + s : lo + s + n], strict=True))
                    for column, value in zip(out, (keys[0][b.offset + i].as_py(), keys[1][b.offset + i].as_py(), n, s, words.decode("utf-8", "replace")), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["k1", "k2", "n", "start", "words"])


def covered(spans: Column) -> Column:
    """How many words an array of spans (start, end) covers."""
    zero = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).alias("upto"))
    one = lambda acc, s: F.struct(
        (acc["words"] + F.greatest(s["end"] - F.greatest(s["start"], acc["upto"]), F.lit(0))).cast("long").alias("words"),
        F.greatest(acc["upto"], s["end"]).alias("upto"),
    )
    return F.aggregate(F.array_sort(spans), zero, one)["words"]


def contaminated_texts(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(k1, k2, n_hit, item_ids) for each distinct text of ``docs`` (keyed) that holds a window of an item.

    Winnowed fingerprints of both sides are joined; each hit is extended to the windows
    around it, which are joined with the items' windows word for word. Spark chooses
    how to join by the size of the items' side, so that a large benchmark shuffles.
    """
    lean_batches(docs.sparkSession)
    texts = keyed(items).select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), "text", "k1", "k2")
    windows = materialize(texts.select("item_id", "text").mapInArrow(item_windows, "item_id string, n int, words string").distinct())
    lengths = sorted(r["n"] for r in windows.select("n").distinct().collect())
    # Items that share a window are named by the set they form, so that copies of an item don't multiply rows.
    sets = materialize(windows.groupBy("n", "words").agg(F.sort_array(F.collect_set("item_id")).alias("items")).withColumn("set_id", F.md5(F.concat_ws(",", "items"))))

    form = f"{KEYS}, n int, pos int, fp long"
    marks = materialize(texts.select("k1", "k2", "text").mapInArrow(fingerprints(lengths, True), form).select("n", "fp").distinct())
    found = docs.select("k1", "k2", "text").mapInArrow(fingerprints(lengths, False), form).join(marks, ["n", "fp"])
    hits = materialize(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("n", "pos")).alias("hits")))

    around = docs.select("k1", "k2", "text").join(hits, ["k1", "k2"]).select("k1", "k2", "text", "hits")
    spans = around.mapInArrow(extended, f"{KEYS}, n int, start int, words string")
    held = materialize(spans.join(sets.select("n", "words", "set_id"), ["n", "words"]).select("k1", "k2", "start", (F.col("start") + F.col("n")).alias("end"), "set_id").distinct())

    words = held.groupBy("k1", "k2").agg(covered(F.collect_set(F.struct("start", "end"))).alias("n_hit"))
    named = sets.groupBy("set_id").agg(F.first("items").alias("items"))
    ids = held.select("k1", "k2", "set_id").distinct().join(named, "set_id").groupBy("k1", "k2").agg(F.array_distinct(F.flatten(F.collect_list("items"))).alias("item_ids"))
    return words.join(ids, ["k1", "k2"])


def decontaminate(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for each document.

    A window is 10 consecutive words of an item, or the whole of a shorter one. Null texts
    have no words; items without words match nothing; a null item_id is written as the
    empty string. Copies and repeated rows get equal results. Without items nothing is hit;
    an empty table gives no rows; other columns are ignored.
    """
    texts = keyed(docs.select("doc_id", "text"))
    hit = materialize(contaminated_texts(texts, items))
    counted = texts.select("doc_id", "k1", "k2", F.regexp_count("text", F.lit(WORD)).cast("long").alias("n_words"))
    ids = F.coalesce(F.array_sort("item_ids"), F.array().cast("array<string>"))
    return counted.join(hit, ["k1", "k2"], "left").select(
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )


def remove_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of an item."""
    hit = materialize(contaminated_texts(keyed(docs.select("text")), items).select(F.col("k1").alias("_hit1"), F.col("k2").alias("_hit2")))
    text = F.coalesce(docs["text"].cast("string"), F.lit(""))
    return docs.join(hit, (F.xxhash64(text) == hit["_hit1"]) & (F.xxhash64(text, F.lit("second")) == hit["_hit2"]), "left_anti")
