"""All pairs of texts that share most of their word shingles, by prefix filtering: no such pair is lost."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.llm.storage import lean_batches, materialize
from rollkeep.llm.words import NOT_SPACE, blocks, prefix_hash, span_hash

#: Every how many-th text is counted for the order of shingles, and how many of the most frequent shingles come last. Any order gives the same pairs.
COUNTED, FREQUENT = 16, 1 << 16
#: Up to this number, the ids of texts to compare are sent to where the texts are.
LISTED = 100_000


def shingle_sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """For each text its different word shingles as sorted 64-bit hashes, A-Z lower-cased; fewer words: all of them, none: nothing."""
    for b in blocks(texts, NOT_SPACE):
        prefix = prefix_hash(b.hashes(lower=True))
        for lo, hi in zip(b.first[:-1].tolist(), b.first[1:].tolist(), strict=True):
            start = np.arange(lo, max(lo, hi - shingle) + 1 if hi > lo else lo)
            yield np.unique(span_hash(prefix, start, np.minimum(start + shingle, hi)))


def _lists(parts: list[np.ndarray], kind: type = np.int64) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.zeros(0, dtype=kind)]).view(kind)))


def _sets(texts: DataFrame, shingle: int, short: bool = False) -> DataFrame:
    """(row, size, grams) of ``texts``; ``short``: the different lowest 16 bits of the hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [s.view(np.int64) for s in shingle_sets(batch.column("text").cast(pa.large_string()), shingle)]
            sizes = pa.array([len(s) for s in sets], pa.int32())
            lists = _lists([np.unique(s.astype(np.int16)) for s in sets], np.int16) if short else _lists(sets)
            yield pa.RecordBatch.from_arrays([batch.column("row"), sizes, lists], names=["row", "size", "grams"])

    return texts.select("row", "text").mapInArrow(run, f"row long, size int, grams array<{'smallint' if short else 'long'}>")


def _compared(pairs: DataFrame, texts: DataFrame, shingle: int, percent: int, short: bool) -> DataFrame:
    """Those of ``pairs`` whose sets share enough, or may do so by their ``short`` hashes.

    Of what two sets share at most as much falls together in short hashes as in either set.
    """
    wanted = materialize(pairs.select(F.explode(F.array("row_a", "row_b")).alias("row")).distinct())
    wanted = F.broadcast(wanted) if wanted.count() <= LISTED else wanted
    sets, told = _sets(texts.join(wanted, "row", "left_semi"), shingle, short), pairs
    for s in ("a", "b"):
        told = told.join(sets.select(F.col("row").alias(f"row_{s}"), F.col("size").alias(f"size_{s}"), F.col("grams").alias(f"grams_{s}")), f"row_{s}")
    lost = F.least(*[F.col(f"size_{s}") - F.size(f"grams_{s}") for s in ("a", "b")])
    both = (F.size(F.array_intersect("grams_a", "grams_b")) + lost).cast("long")
    return materialize(told.where(100 * both >= percent * (F.col("size_a") + F.col("size_b") - both)).select(*pairs.columns))


def _prefixes(texts: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(row, node, digest, size, prefix): of each set its first shingles, rare ones before frequent ones, one of which every similar set shares."""
    some = _sets(texts.where(F.pmod(F.xxhash64("row"), F.lit(COUNTED)) == 0), shingle).select(F.explode("grams").alias("gram"))
    often = some.groupBy("gram").count().where("count > 2").orderBy(F.desc("count"), "gram").limit(FREQUENT).toArrow().to_pydict()
    grams, counts = np.array(often["gram"], dtype=np.int64).view(np.uint64), np.array(often["count"], dtype=np.int64)
    by = np.argsort(grams)
    grams, counts = grams[by], counts[by]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, firsts = [], [], []
            for s in shingle_sets(batch.column("text").cast(pa.large_string()), shingle):
                n, count = len(s), np.zeros(len(s), dtype=np.int64)
                if len(grams):
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    count = np.where(grams[at] == s, counts[at], 0)
                sizes.append(n)
                digests.append(int(span_hash(prefix_hash(s), np.array([0]), np.array([n]))[0]))
                firsts.append(s[np.lexsort((s, count))][: n - -(-percent * n // 100) + 1].view(np.int64))
            columns = [batch.column("row"), batch.column("node"), pa.array(np.array(digests, dtype=np.uint64).view(np.int64)), pa.array(sizes, pa.int32()), _lists(firsts)]
            yield pa.RecordBatch.from_arrays(columns, names=["row", "node", "digest", "size", "prefix"])

    return texts.select("row", "node", "text").mapInArrow(run, "row long, node long, digest long, size int, prefix array<long>")


def similar_links(texts: DataFrame, roots: DataFrame, shingle: int, percent: int) -> DataFrame:
    """Edges (a, b) between different roots that hold texts which share ``percent`` of a hundred of their shingles and more.

    ``texts`` has row (long, distinct), node and text, ``roots`` node and root; what is
    connected already (equal roots) isn't compared. The share is that of the shingles of
    both among those of either. Two sets that similar share one of the first shingles of
    each in any order of all shingles, and fewer first ones of the smaller set do (prefix
    filter). A frequent shingle is a first one only of sets that hold little else. Pairs that
    meet are compared by short hashes, which lose none, and then by their whole sets.
    """
    lean_batches(texts.sparkSession)
    items = materialize(_prefixes(texts, shingle, percent).groupBy("node", "digest").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("prefix").alias("prefix")))
    keys = items.select("row", "size", F.posexplode("prefix").alias("at", "gram"))
    indexed = F.col("at") <= F.col("size") - F.ceil(F.lit(2 * percent) * F.col("size") / F.lit(100 + percent))
    gram = W.partitionBy("gram")
    # Rows hold no more than the shingle and the text's row, doubled, with whether the shingle is one of the fewer.
    keys = keys.select("gram", (2 * F.col("row") + indexed.cast("long")).alias("_key"))
    keys = keys.withColumn("_n", F.count("*").over(gram)).withColumn("_any", F.max(F.col("_key") % 2).over(gram))
    shared = materialize(keys.where("_n > 1 and _any = 1").select("gram", F.shiftright("_key", 1).alias("row"), (F.col("_key") % 2 == 1).alias("indexed")))
    rooted = shared.join(items.select("row", "size", "node"), "row").join(roots, "node").drop("node")
    apart = materialize(rooted.withColumn("_least", F.min("root").over(gram)).withColumn("_most", F.max("root").over(gram)).where("_least <> _most").drop("_least", "_most"))
    side = lambda s: apart.select("gram", *[F.col(c).alias(f"{c}_{s}") for c in ("row", "size", "root", "indexed")])
    smaller = F.struct("size_a", "row_a") < F.struct("size_b", "row_b")
    pairs = side("a").where("indexed_a").join(side("b"), "gram").where(smaller & (F.col("root_a") != F.col("root_b")) & (100 * F.col("size_a").cast("long") >= percent * F.col("size_b").cast("long")))
    pairs = materialize(pairs.select("row_a", "row_b", "root_a", "root_b").distinct())
    for short in (True, False):
        pairs = _compared(pairs, texts, shingle, percent, short)
    return pairs.select(F.col("root_a").alias("a"), F.col("root_b").alias("b")).distinct()
