"""Operator 4: remove repeated spans of words by De Bruijn compaction.

The graph's edges are the windows of ``WINDOW`` words. Each window belongs to the vertex
that winnowing chooses in it, a k-gram of ``GRAM`` words; consecutive windows with the same
vertex form a run. A vertex is nonbranching if the run around it reads the same
wherever the vertex occurs: all its windows then occur in just the same documents, and the
run compacts to one row before anything is shuffled. Only vertices that branch, at the
ends of a repeated span, are taken apart into their windows.

Hashes of 64 bits only propose what may be repeated. Then each proposed span is read again
at its coordinates in its source, and spans are the same only if a 128-bit cryptographic
digest of their words agrees; runs that hashes held for the same but that differ are taken
apart as well.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeep.llm.storage import lean_batches, materialize
from rollkeep.llm.words import NOT_SPACE, anchors, blocks, mix, prefix_hash, span_hash

WINDOW, GRAM = 50, 16


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, node, path, lo, hi): each run of windows lo..hi around one vertex."""
    for batch in batches:
        for b in blocks(batch.column("text"), NOT_SPACE):
            hashes, text = b.hashes(lower=False), b.text_of_word
            windows, at, grams = anchors(hashes, text, GRAM, WINDOW)
            new = np.ones(len(at), dtype=bool)
            new[1:] = at[1:] != at[:-1]
            head = np.flatnonzero(new)
            tail = np.append(head[1:], len(at))[: len(head)] - 1
            lo, hi, node = windows[head], windows[tail], at[head]
            reads = span_hash(prefix_hash(hashes), lo, hi + WINDOW) ^ mix((node - lo).astype(np.uint64))
            t = text[lo]
            rows = pa.array(b.offset + t)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(grams[node].view(np.int64)), pa.array(reads.view(np.int64)), pa.array((lo - b.first[t]).astype(np.int32)), pa.array((hi - b.first[t]).astype(np.int32))],
                names=["doc_id", "text_key", "node", "path", "lo", "hi"],
            )


def canonical(b) -> tuple[np.ndarray, np.ndarray]:
    """The words of a block, one space after each, and the place of each word there."""
    length = b.end - b.start
    at = np.cumsum(length + 1) - length - 1
    out = np.full(int((length + 1).sum()), 0x20, dtype=np.uint8)
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + within] = b.data[np.repeat(b.start, length) + within]
    return out, at


def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_key, node, whole, words, start, end): the digest of the words of each run; of a branching run, of each of its windows."""
    for batch in batches:
        lists = batch.column("runs")
        counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
        flat = lists.flatten()
        node, lo, hi, branching = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("node", "lo", "hi", "branching"))
        ends = np.concatenate([[0], np.cumsum(counts)])
        for b in blocks(batch.column("text"), NOT_SPACE):
            part = slice(ends[b.offset], ends[b.offset + b.n])
            apart = branching[part].astype(bool)
            width = np.where(apart, hi[part] - lo[part] + 1, 1).astype(np.int64)
            t = np.repeat(np.arange(b.n), counts[b.offset : b.offset + b.n])
            run = np.repeat(np.arange(len(width)), width)
            start = lo[part][run] + np.arange(len(run)) - np.repeat(np.cumsum(width) - width, width)
            end = np.where(apart[run], start + WINDOW, hi[part][run] + WINDOW)
            words, at = canonical(b)
            view, first = memoryview(words), b.first[t[run]]
            spans = zip(at[first + start].tolist(), np.append(at, len(words))[first + end].tolist(), strict=True)
            found = b"".join(hashlib.blake2b(view[i:j], digest_size=16).digest() for i, j in spans)
            rows = pa.array(b.offset + t[run])
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(rows), batch.column("text_key").take(rows), pa.array(node[part][run]), pa.array(~apart[run])]
                + [pa.Array.from_buffers(pa.binary(16), len(run), [None, pa.py_buffer(found)]).cast(pa.binary()), pa.array(start.astype(np.int32)), pa.array(end.astype(np.int32))],
                names=["doc_id", "text_key", "node", "whole", "words", "start", "end"],
            )


def kept_texts(with_text: bool):
    """Arrow function: what is left of each text without the words in ``spans``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("spans")
            counts = pc.fill_null(pc.list_value_length(lists), 0).to_numpy()
            flat = lists.flatten()
            start, end = (flat.field(c).to_numpy() for c in ("start", "end"))
            ends = np.concatenate([[0], np.cumsum(counts)])
            for b in blocks(batch.column("text"), NOT_SPACE):
                part = slice(ends[b.offset], ends[b.offset + b.n])
                t = np.repeat(np.arange(b.n), counts[b.offset : b.offset + b.n])
                edges = np.zeros(len(b.start) + 1, dtype=np.int64)
                np.add.at(edges, b.first[t] + start[part], 1)
                np.add.at(edges, b.first[t] + end[part], -1)
                keep = np.cumsum(edges)[:-1] == 0
                texts = list(joined(b, keep))
                gone = np.concatenate([[0], np.cumsum(~keep)])
                rows = slice(b.offset, b.offset + b.n)
                out = [batch.column("doc_id")[rows], pa.array(np.diff(b.first)), pa.array(gone[b.first[1:]] - gone[b.first[:-1]]), pa.array([hashlib.sha256(x).hexdigest() for x in texts])]
                if with_text:
                    out.append(pa.array([x.decode("utf-8", "replace") for x in texts], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"][: len(out)])

    return run


def joined(b, keep: np.ndarray) -> Iterator[bytes]:
    """The kept words of each text of a block, joined by one space."""
    start, length = b.start[keep], (b.end - b.start)[keep]
    at = np.cumsum(length + 1) - length - 1
    out = np.full(int((length + 1).sum()), 0x20, dtype=np.uint8)
    within = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
    out[np.repeat(at, length) + within] = b.data[np.repeat(start, length) + within]
    whole, first = out.tobytes(), np.concatenate([[0], np.cumsum(keep)])[b.first]
    at = np.append(at, len(whole))
    for i, j in zip(first[:-1], first[1:], strict=True):
        yield whole[at[i] : at[j] - 1] if j > i else b""


def _same_doc(a: DataFrame, b: DataFrame) -> Column:
    return (a["text_key"] == b["text_key"]) & a["doc_id"].eqNullSafe(b["doc_id"])


def _read_again(docs: DataFrame, hits: DataFrame) -> DataFrame:
    """The digests of the words of ``hits``, runs of documents."""
    listed = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("node", "lo", "hi", "branching")).alias("runs"))
    around = docs.join(listed, _same_doc(docs, listed)).select(docs["doc_id"], docs["text_key"], "text", "runs")
    form = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, node long, whole boolean, words binary, start int, end int"
    return materialize(around.mapInArrow(digests, form))


def repeated_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, spans): the words to remove from each document, as spans of word numbers.

    ``docs`` has doc_id, text and text_key. Every window is removed whose words also stand
    in a document with a smaller doc_id; a null doc_id counts as larger than all others.
    """
    least, most = F.min("doc_id").alias("least"), F.max("doc_id").alias("most")
    unnamed = F.max(F.col("doc_id").isNull()).alias("unnamed")
    elsewhere = (F.col("least") < F.col("most")) | (F.col("least").isNotNull() & F.col("unnamed"))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    found = materialize(docs.select("doc_id", "text_key", "text").mapInArrow(runs, f"doc_id {doc_type}, text_key long, node long, path long, lo int, hi int"))
    nodes = found.groupBy("node").agg(least, most, unnamed, (F.min("path") != F.max("path")).alias("branching"))
    # Rows of one vertex meet only as minimum and maximum, so a vertex in a third of all rows is no burden.
    # Written first: a join of two plain exchanges can split a vertex that many rows share.
    repeated = materialize(nodes.where(elsewhere).select("node", "branching"))
    hits = materialize(found.join(repeated, "node").drop("path"))
    read = _read_again(docs, hits)
    # Runs of a vertex that hashes took for the same although their words differ.
    false = materialize(read.where("whole").groupBy("node").agg((F.min("words") != F.max("words")).alias("differ")).where("differ").select("node"))
    if not false.isEmpty():
        again = _read_again(docs, hits.join(false, "node", "left_semi").withColumn("branching", F.lit(True)))
        read = read.join(false, "node", "left_anti").unionByName(again)
    first = materialize(read.groupBy("words").agg(least, most, unnamed).where(elsewhere).select("words", "least"))
    later = F.col("doc_id").isNull() | (F.col("least") < F.col("doc_id"))
    spans = read.join(first, "words").where(later)
    return spans.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("start", "end")).alias("spans"))


def remove_repeats(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of each document, and its kept_text if asked for.

    Words are runs of other characters than white space. Windows are judged on the input.
    Null texts have no words; documents of fewer than 50 words lose none; rows with the
    same doc_id don't remove each other's words; of equal texts the smallest doc_id stays
    whole. An empty table gives no rows; other columns are ignored.
    """
    lean_batches(docs.sparkSession)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.xxhash64(text).alias("text_key"))
    spans = materialize(repeated_spans(keyed))
    marked = keyed.join(spans, _same_doc(keyed, spans), "left").select(keyed["doc_id"], "text", "spans")
    form = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string"
    return marked.mapInArrow(kept_texts(with_text), form + (", kept_text string" if with_text else ""))
