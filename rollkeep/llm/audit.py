"""Operator 12: what each of several filters removes in every order of applying them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeep.llm.anagram import UPPER
from rollkeep.llm.mixing import SPACES
from rollkeep.llm.storage import materialize

FILTERS = "ABCDE"
#: What is counted in each cell of documents that fail the same filters: all, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")
COLUMNS = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def walk(n: int) -> Iterator[tuple[list[int], int | None]]:
    """Every permutation of 0 to n-1, each one swap of neighbours from the one before, and the place of that swap.

    Each number moves in its direction; the largest that looks at a smaller one steps over
    it, and all larger ones turn round. The list is changed in place.
    """
    order, left = list(range(n)), [True] * n
    yield order, None
    while True:
        place = {x: i for i, x in enumerate(order)}
        aim = {x: i + (-1 if left[x] else 1) for x, i in place.items()}
        movable = [x for x in order if 0 <= aim[x] < n and order[aim[x]] < x]
        if not movable:
            return
        x = max(movable)
        i, j = place[x], aim[x]
        order[i], order[j] = order[j], order[i]
        for y in range(x + 1, n):
            left[y] = not left[y]
        yield order, min(i, j)


def audit_orders(cells: np.ndarray, names: str) -> dict[str, np.ndarray]:
    """All orders of one part. ``cells[count, mask]`` counts documents by the set of filters they fail (bit i: filter i).

    A filter removes at its step the documents that fail it and no filter before it. After a
    swap of neighbours only their two steps are counted again; the others stand.
    """
    n = len(names)
    masks = np.arange(1 << n)
    fails = [(masks >> f) & 1 == 1 for f in range(n)]
    failing = np.array([cells[0, fails[f]].sum() for f in range(n)])
    alone = np.array([cells[0, 1 << f] for f in range(n)])
    removed, shapley, rows = np.zeros((n, len(cells)), dtype=np.int64), np.zeros(n, dtype=np.int64), []
    for order, swap in walk(n):
        for k in range(n) if swap is None else (swap, swap + 1):
            before = sum(1 << f for f in order[:k])
            removed[k] = cells[:, fails[order[k]] & (masks & before == 0)].sum(axis=1)
        shapley[order] += removed[:, 0]
        rows.append((order.copy(), removed.copy()))
    at = np.array([o for o, _ in rows])
    lost = np.stack([r for _, r in rows])
    kept = cells[0].sum() - np.cumsum(lost[:, :, 0], axis=1)
    out = {"kept": kept, "removed": lost[:, :, 0], "redundant": failing[at] - lost[:, :, 0], "unique_fails": alone[at], "good_lost": lost[:, :, 1], "toxic_lost": lost[:, :, 2], "shapley": shapley[at]}
    texts = ["".join(names[f] for f in o) for o in at]
    return {"filter_order": np.repeat(texts, n), "step": np.tile(np.arange(1, n + 1), len(at))} | {k: v.ravel() for k, v in out.items()}


def walked(names: str):
    """Arrow function over parts, each with its cells as arrays of (mask, counts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, held in zip(batch.column("part").to_pylist(), batch.column("cells").to_pylist(), strict=True):
                cells = np.zeros((len(COUNTS), 1 << len(names)), dtype=np.int64)
                for c in held:
                    cells[:, c["mask"]] = [c[x] for x in COUNTS]
                rows = audit_orders(cells, names)
                columns = {"part": np.repeat(part, len(rows["step"]))} | rows
                columns["step"] = columns["step"].astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in columns.values()], names=list(columns))

    return run


def with_failures(docs: DataFrame) -> DataFrame:
    """doc_id, part, mask (bits of the filters A to D that the text fails) and the digest of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("_text"))
    held = held.withColumn("_words", F.filter(F.split("_text", SPACES), lambda w: w != ""))
    n, capitals = F.size("_words"), F.length("_text") - F.length(F.translate("_text", UPPER, ""))
    failing = [
        n < 50,
        F.size(F.array_distinct("_words")).cast("long") * 100 < n.cast("long") * 65,
        capitals.cast("long") * 100 > F.length("_text").cast("long") * 5,
        F.col("_text").rlike("[#$%&*|]"),
    ]
    mask = sum((F.when(c, 1 << i).otherwise(0) for i, c in enumerate(failing)), F.lit(0))
    return held.select("doc_id", "part", mask.alias("mask"), F.unhex(F.sha2("_text", 256)).alias("digest"))


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part (source), order of the five filters and step.

    ``docs`` has doc_id, text and source, ``labels`` doc_id, quality and toxic. Filters: A under 50
    words; B under 65 % different words; C over 5 % capitals A-Z; D any of ``#$%&*|``; E a
    text that also stands under a smaller doc_id, in any part and removed or not. Null texts
    are empty, null sources the part of the empty text; a row without doc_id never fails E and has
    no label, and rows that share a doc_id don't make each other fail. Several labels of a
    document count as good (toxic) if one says so. Other columns are ignored; an empty table
    gives no rows.

    Texts are only digested; the least doc_id of each text is combined before the shuffle and
    joined by text and doc_id together, so that a text that many documents share isn't one key
    in that join. Parts are counted by the set of failed filters, 32 cells at most each.
    """
    slim = materialize(with_failures(docs))
    first = slim.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).where("doc_id IS NOT NULL").withColumn("_first", F.lit(True))
    marks = labels.groupBy("doc_id").agg(F.max(F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), F.max(F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("toxic"))
    judged = slim.join(first, ["digest", "doc_id"], "left").join(marks, "doc_id", "left")
    copy = F.col("doc_id").isNotNull() & F.col("_first").isNull()
    cells = judged.groupBy("part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask")).agg(
        F.count("*").alias("n"), *[F.coalesce(F.sum(c), F.lit(0)).cast("long").alias(c) for c in ("good", "toxic")]
    )
    parts = cells.groupBy("part").agg(F.collect_list(F.struct("mask", *COUNTS)).alias("cells"))
    return parts.mapInArrow(walked(FILTERS), COLUMNS)
