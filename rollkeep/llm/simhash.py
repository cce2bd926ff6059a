"""Operator 8: SimHash near-duplicates, linked by pigeonring filtering."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollkeep.llm.graph import components
from rollkeep.llm.overlap import similar_links
from rollkeep.llm.storage import fresh, lean_batches, materialize
from rollkeep.llm.words import NOT_SPACE, blocks, mix, prefix_hash, span_hash

#: Segments of a fingerprint of 64 bits, and bits that may differ of one.
SEGMENTS, WIDTH = 4, 16
DISTANCE = 3
#: For groups of similar documents: words of a shingle, fingerprints of a document, and bits of all of them that may differ
#: (similarity 0.8 makes texts differ in 15% of the bits), and of three segments.
SHINGLE, PARTS, APART, AHEAD = 5, 4, 40, 7
#: Fingerprints of one chain key beyond this number are compared in blocks.
HOT = 4
BLOCK = 256

_hash = partial(xxhash.xxh64_intdigest, seed=42)


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """The majority of each bit over the XXH64 of all word shingles, repeats included."""
    words = text.lower().split()  # of bytes: A-Z only, and ASCII white space only
    if not words:
        return 0
    if len(words) <= shingle:
        return _hash(b" ".join(words))
    n = len(words) - shingle + 1
    hashes = np.fromiter(map(_hash, map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))), dtype=np.uint64, count=n)
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, n, 8192):
        part = hashes[i : i + 8192].astype(">u8").view(np.uint8)
        ones += np.unpackbits(part).reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n).view(">u8")[0])


def add_fingerprints(docs: DataFrame, name: str) -> DataFrame:
    """``docs`` with the fingerprint of ``text`` as a (signed) long in column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("text").cast(pa.large_binary())
            marks = np.array([fingerprint(t.as_py() or b"") for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(marks.view(np.int64))], names=[*batch.schema.names, name])

    lean_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.LongType())]))


def similar_marks(texts: pa.Array, shingle: int, parts: int) -> np.ndarray:
    """``parts`` fingerprints of each text from its word shingles, A-Z lower-cased, repeats included (text, part); zero without words."""
    out = np.zeros((len(texts), parts), dtype=np.uint64)
    for b in blocks(texts, NOT_SPACE):
        hashes, count = b.hashes(lower=True), np.diff(b.first)
        prefix = prefix_hash(hashes)
        for i in np.flatnonzero(count):
            lo, hi = int(b.first[i]), int(b.first[i + 1])
            start = np.arange(lo, max(lo, hi - shingle) + 1)
            ones, n = np.zeros((parts, 64), dtype=np.int64), len(start)
            for j in range(0, n, 8192):
                grams = span_hash(prefix, start[j : j + 8192], np.minimum(start[j : j + 8192] + shingle, hi))
                for k in range(parts):
                    ones[k] += np.unpackbits(mix(grams + np.uint64(k)).astype(">u8").view(np.uint8)).reshape(-1, 64).sum(axis=0, dtype=np.int64)
            out[b.offset + i] = np.packbits(2 * ones > n, axis=1).view(">u8")[:, 0]
    return out


def add_similar_marks(docs: DataFrame, name: str, shingle: int, parts: int) -> DataFrame:
    """``docs`` with the fingerprints of ``text`` as an array of longs in column ``name``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            marks = similar_marks(batch.column("text").cast(pa.large_string()), shingle, parts)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(marks) + 1, dtype=np.int32) * parts), pa.array(marks.view(np.int64).reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, name])

    lean_batches(docs.sparkSession)
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))]))


def _segment(fp, i: int):
    return F.shiftrightunsigned(fp, 64 - WIDTH * (i % SEGMENTS + 1)).bitwiseAND((1 << WIDTH) - 1)


def _chain(fp, i: int, flip: int = 0):
    """The key of segments i and i+1 on the ring, with bits of the second flipped."""
    second = _segment(fp, i + 1).bitwiseXOR(F.lit(flip).cast("long"))
    return F.lit(i << 2 * WIDTH).cast("long") + F.shiftleft(_segment(fp, i), WIDTH) + second


def _chained(apart, i, ahead: int):
    """Chain budgets from segment i: 0, 1 and ``ahead`` differing bits after 1, 2, 3 segments; the key grants the first two.

    Of 4 segments with 3 differing bits in all, some chain around the ring keeps within 0, 1 and 2.
    """
    bits = [F.bit_count(_segment(apart, k) + F.shiftleft(_segment(apart, k + 1), WIDTH) + F.shiftleft(_segment(apart, k + 2), 2 * WIDTH)) <= ahead for k in range(SEGMENTS)]
    return F.when(i == 0, bits[0]).when(i == 1, bits[1]).when(i == 2, bits[2]).otherwise(bits[3])


def _block_links(distance: int):
    """Pandas function: a forest that links what is linked between the probing and the indexed nodes of a block."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sides, width = [], len(pdf["marks"].iloc[0])
        for side in (0, 1):
            part = pdf[pdf["side"] == side].drop_duplicates("node").sort_values("node")
            sides.append((part["node"].to_numpy(dtype=np.int64), np.array(part["marks"].tolist(), dtype=np.int64).reshape(-1, width)))
        (a, marks_a), (b, marks_b) = sides
        apart = np.zeros((len(a), len(b)), dtype=np.int32)
        for k in range(width):
            apart += np.bitwise_count((marks_a[:, k, None] ^ marks_b[None, :, k]).view(np.uint64))
        near = apart <= distance
        top = np.iinfo(np.int64).max
        label_a, label_b = a.copy(), b.copy()
        while len(a) and len(b):
            new_b = np.minimum(label_b, np.where(near, label_a[:, None], top).min(axis=0))
            new_a = np.minimum(label_a, np.where(near, new_b[None, :], top).min(axis=1))
            if (new_a == label_a).all() and (new_b == label_b).all():
                break
            label_a, label_b = new_a, new_b
        out = pd.DataFrame({"a": np.concatenate([a, b]), "b": np.concatenate([label_a, label_b])})
        return out[out["a"] != out["b"]].drop_duplicates()

    return run


def links(nodes: DataFrame, distance: int = DISTANCE, ahead: int = 2) -> DataFrame:
    """Edges (a, b) that connect nodes whose fingerprints differ in at most ``distance`` bits together.

    ``nodes`` has node (long, distinct) and marks (array of longs). Each fingerprint is
    indexed under its 4 chain keys (two consecutive segments) and probes those keys with at
    most one bit of the second segment flipped. For one fingerprint and 3 bits no link is
    lost; for several the chain must stand in one of them. Keys that more than ``HOT`` nodes
    share are compared in salted blocks, and each block returns a spanning forest instead
    of its pairs; the components stay the same.
    """
    flips = [0, *(1 << k for k in range(WIDTH))]
    each = nodes.select("node", F.posexplode("marks").alias("part", "mark"))
    whose = lambda key: F.shiftleft(F.col("part").cast("long"), 2 * WIDTH + 2) + key
    index = materialize(each.select("node", F.explode(F.array(*[whose(_chain(F.col("mark"), i)) for i in range(SEGMENTS)])).alias("key")))
    probe = each.select(F.col("node").alias("probe"), F.explode(F.array(*[whose(_chain(F.col("mark"), i, f)) for i in range(SEGMENTS) for f in flips])).alias("key"))
    hot = materialize(index.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > HOT))
    cool = index if hot.isEmpty() else index.join(hot, "key", "left_anti")
    # Rows hold no more than key and node; the fingerprints of a candidate pair are looked up and count together.
    chain = F.shiftright("key", 2 * WIDTH).cast("int").alias("chain")
    # Spark sizes the probes by the nodes they are exploded from, 68 of them for each fingerprint: they must never be broadcast.
    found = materialize(probe.hint("merge").join(cool, "key").where("probe < node").select(F.col("probe").alias("a"), F.col("node").alias("b"), chain).distinct())
    for side in ("a", "b"):
        found = found.join(nodes.select(F.col("node").alias(side), F.col("marks").alias(f"marks_{side}")), side)
    differ = found.select("a", "b", "chain", F.zip_with("marks_a", "marks_b", lambda x, y: x.bitwiseXOR(y)).alias("apart"))
    whole = F.aggregate("apart", F.lit(0), lambda x, y: x + F.bit_count(y))
    part = F.get("apart", F.shiftright("chain", 2))
    edges = differ.where((whole <= distance) & _chained(part, F.col("chain").bitwiseAND(SEGMENTS - 1), ahead)).select("a", "b").distinct()
    if hot.isEmpty():
        return edges
    # Each side is cut into blocks by its own count; every block of one side meets every block of the other.
    # The few hot keys are turned instead of all fingerprints: who probes a key is indexed under it with the same bit flipped.
    # They are written, so that Spark knows their size and not only that of the hot keys.
    turned = materialize(hot.select("key", F.explode(F.array(*[F.col("key").bitwiseXOR(F.lit(f).cast("long")) for f in flips])).alias("_own")))
    probed = materialize(index.withColumnRenamed("key", "_own").join(turned, "_own").select("node", "key"))
    hot = materialize(hot.join(probed.groupBy("key").agg(F.count("*").alias("m")), "key"))
    n_index, n_probe = (F.ceil(F.col(c) / BLOCK) for c in ("n", "m"))
    block = lambda n: F.pmod(F.xxhash64("node"), n)
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), n - 1))
    sides = [
        index.select("node", "key").join(hot, "key").select("key", "node", F.lit(1).alias("side"), every(n_probe).alias("i"), block(n_index).alias("j")),
        probed.join(hot, "key").select("key", "node", F.lit(0).alias("side"), block(n_probe).alias("i"), every(n_index).alias("j")),
    ]
    rows = sides[0].unionByName(sides[1]).join(nodes, "node")
    return edges.unionByName(rows.groupBy("key", "i", "j").applyInPandas(_block_links(distance), "a long, b long"))


def roots(nodes: DataFrame, distance: int = DISTANCE, ahead: int = 2) -> DataFrame:
    """(node, root): for each node the smallest one it is connected to."""
    star = components(links(nodes, distance, ahead)).select(F.col("a").alias("node"), "root")
    return nodes.select("node").join(star, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (smallest doc_id reachable).

    Words are runs of other characters than white space, A-Z lower-cased; shingles are 3
    words (fewer words: all of them). Texts without words, null included, have fingerprint
    zero. A null doc_id never names a component unless all its doc_ids are null.
    Equal rows and ids get equal results; an empty table gives no rows.
    """
    marked = materialize(add_fingerprints(docs.select("doc_id", "text"), "fp").select("doc_id", "fp"))
    marks = materialize(marked.groupBy("fp").agg(F.min("doc_id").alias("least")))
    nodes = marks.select(F.col("fp").alias("node"), F.array("fp").alias("marks"))
    rooted = marks.join(roots(nodes).withColumnRenamed("node", "fp"), "fp")
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_mark = rooted.join(named, "root").select("fp", "component_id")
    return marked.join(by_mark, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = SHINGLE, parts: int = PARTS, distance: int = APART, ahead: int = AHEAD, percent: int | None = None) -> DataFrame:
    """``docs`` without near-duplicates: of each component the row with the smallest doc_id stays.

    Documents are linked whose fingerprints, ``parts`` of 64 bits over shingles of
    ``shingle`` words, differ in at most ``distance`` bits, as far as a chain of segments
    stands in one of them. With ``percent`` all documents are linked, too, that share so
    many of a hundred of their different shingles (those of both among those of either),
    whatever their fingerprints are: no such pair is left out.
    Texts without words, null included, are alike. A null doc_id comes last; of rows with
    equal ids, repeated rows included, the first read stays. An empty table gives no rows;
    other columns pass through, whatever their names.
    """
    mark, row = fresh("_marks", docs), fresh("_row", docs)
    marked = materialize(add_similar_marks(docs.withColumn("text", F.col("text").cast("string")), mark, shingle, parts).withColumn(row, F.monotonically_increasing_id()))
    node = F.xxhash64(F.array_join(F.col(mark).cast("array<string>"), ","))
    narrow = marked.select(node.alias("node"), F.col(mark).alias("marks"), F.col("doc_id").isNull().alias("unnamed"), "doc_id", F.col(row).alias("row"))
    firsts = materialize(narrow.groupBy("node").agg(F.first("marks").alias("marks"), F.min(F.struct("unnamed", "doc_id", "row")).alias("first")))
    rooted = roots(firsts.select("node", "marks"), distance, ahead)
    if percent is not None:
        rooted = materialize(rooted)
        texts = marked.select(F.col(row).alias("row"), node.alias("node"), F.col("text"))
        joined = components(similar_links(texts, rooted, shingle, percent)).select(F.col("a").alias("root"), F.col("root").alias("_to"))
        rooted = rooted.join(joined, "root", "left").select("node", F.coalesce("_to", "root").alias("root"))
    kept = firsts.select("node", "first").join(rooted, "node").groupBy("root").agg(F.min("first").alias("first"))
    return marked.join(kept.select(F.col("first.row").alias(row)), row, "left_semi").select(*docs.columns)
