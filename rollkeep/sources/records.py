"""Records of delimited files, whose quoted cells may hold line breaks, read by file blocks.

Where a record ends depends on all quotes before it. Each line is therefore taken as a step
between two states, outside and inside a quoted cell: it keeps the state, sets it, or turns it round.
Such steps compose, so every block works out its lines for both states it may begin in,
one row for each block says how the block as a whole steps, and these rows give each block
the state, the record number and the length it begins with. No task reads more than a block, and a
quote that is never closed gathers no more than ``LONGEST_RECORD`` characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.sources.scratch import materialize

DELIMITERS = ",;\t|"
#: Characters of a line that are read, and of a record (where Python's csv module gives up).
LONGEST_LINE, LONGEST_RECORD = 64_000, 131_072
#: Bytes that tell a file's encoding.
HEAD = 65_536
OUTSIDE, INSIDE = 0, 1
KEPT, SET_OUTSIDE, SET_INSIDE, TURNED = "kept", "outside", "inside", "turned"
#: What Windows-1252 makes of the bytes 0x80 to 0x9F, which Latin-1 leaves as control characters.
_HIGH = "".join(map(chr, range(0x80, 0xA0)))
_WINDOWS = bytes(range(0x80, 0xA0)).decode("cp1252", errors="replace")


def sniff_encoding(head: bytes) -> str:
    """By the first block of a file: a byte-order mark, UTF-8, Windows-1252, else Latin-1."""
    if head[:3] == b"\xef\xbb\xbf":
        return "utf-8-sig"
    for name in ("utf-8", "cp1252"):
        try:
            head.decode(name)
        except UnicodeDecodeError as e:
            if name == "utf-8" and len(head) >= HEAD and e.start >= len(head) - 3 and e.reason == "unexpected end of data":
                return name  # the block ends within a character
            continue
        return name
    return "latin-1"


def detect_delimiter(header: str) -> str:
    """The one of the four that the header holds most of; a comma if none."""
    return max(DELIMITERS, key=lambda d: (header.count(d), -DELIMITERS.index(d))) if any(d in header for d in DELIMITERS) else ","


def raw_lines(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(path, block, at, bytes): lines of files, split at line feeds only; ``at`` orders those of a block (its first byte)."""
    read = spark.read.option("lineSep", "\n").text(paths)
    return read.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").cast("binary").alias("bytes"))


def file_heads(raw: DataFrame) -> DataFrame:
    """(path, encoding, delimiter, header) of each file, by the lines in its first ``HEAD`` bytes.

    Spark's reader takes a UTF-8 byte-order mark off before it is seen here; such a file is utf-8.
    """

    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for path, lines in zip(batch.column("path").to_pylist(), batch.column("lines").to_pylist(), strict=True):
                encoding = sniff_encoding(b"\n".join(line["bytes"] for line in lines)[:HEAD])
                header = lines[0]["bytes"].decode("utf-8-sig" if encoding == "utf-8" else encoding, errors="replace").rstrip("\r")[:LONGEST_LINE]
                rows.append({"path": path, "encoding": encoding, "delimiter": detect_delimiter(header), "header": header})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([(c, pa.string()) for c in ("path", "encoding", "delimiter", "header")]))

    in_file = W.partitionBy("path").orderBy("block", "at")
    # Every line has its line feed, so the first HEAD lines of these blocks hold the first HEAD bytes.
    first = raw.where(F.col("block") < HEAD).select("path", "block", "at", F.substring("bytes", 1, HEAD).alias("bytes"), (F.octet_length("bytes") + 1).alias("n"))
    near = first.withColumn("k", F.row_number().over(in_file)).where(F.col("k") <= HEAD)
    near = near.withColumn("before", F.coalesce(F.sum("n").over(in_file.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).where(F.col("before") < HEAD)
    heads = near.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("block", "at", "bytes"))).alias("lines"))
    return heads.mapInArrow(told, "path string, encoding string, delimiter string, header string")


def decoded(raw: DataFrame, heads: DataFrame) -> DataFrame:
    """(path, block, at, line, delimiter): lines as text, at most ``LONGEST_LINE`` characters; undecodable bytes are replaced."""
    latin = F.decode("bytes", "ISO-8859-1")
    text = F.when(F.col("encoding") == "cp1252", F.translate(latin, _HIGH, _WINDOWS)).when(F.col("encoding") == "latin-1", latin).otherwise(F.make_valid_utf8(F.col("bytes").cast("string")))
    return raw.join(heads.select("path", "encoding", "delimiter"), "path").select("path", "block", "at", F.substring(text, 1, LONGEST_LINE).alias("line"), "delimiter")


def line_step(pieces: Column, delimiter: Column) -> Column:
    """How a line, split at its quotes, changes the state: KEPT, SET_OUTSIDE, SET_INSIDE or TURNED.

    A quote opens a cell only at its start; inside, a doubled quote stands for one, and
    after the closing quote the rest of the cell is taken as it is. So what counts of the
    text before each quote is whether it is empty or ends with the delimiter.
    """
    at_start, inside, closed, within = 0, 1, 2, 3

    def fold(start: int) -> Column:
        def step(state: Column, piece: Column) -> Column:
            opens = piece.endswith(delimiter) | ((piece == "") & ((state == at_start) | (state == closed)))
            return F.when(state == inside, closed).when(opens, inside).otherwise(within)

        return F.aggregate(F.slice(pieces, F.lit(1), F.size(pieces) - 1), F.lit(start), step) == inside

    a, b = fold(at_start), fold(inside)
    return F.when(F.size(pieces) == 1, KEPT).when(a & b, SET_INSIDE).when(a, TURNED).when(b, KEPT).otherwise(SET_OUTSIDE)


def _stepped(df: DataFrame, parts: list[str], order: str) -> DataFrame:
    """Adds to rows with ``step`` what all rows before them in their part make of a state: ``set_to`` (null if they don't set it) and ``turns``."""
    before = W.partitionBy(*parts).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    upto = W.partitionBy(*parts).orderBy(order).rowsBetween(W.unboundedPreceding, W.currentRow)
    turned = df.withColumn("_turns", F.sum(F.when(F.col("step") == TURNED, 1).otherwise(0)).over(upto))
    sets = F.when(F.col("step") == SET_OUTSIDE, F.struct(F.lit(OUTSIDE).alias("to"), "_turns")).when(F.col("step") == SET_INSIDE, F.struct(F.lit(INSIDE).alias("to"), "_turns"))
    known = turned.withColumn("_set", F.last(sets, ignorenulls=True).over(before)).withColumn("_t", F.coalesce(F.max("_turns").over(before), F.lit(0)))
    return known.withColumn("set_to", F.col("_set.to")).withColumn("turns", (F.col("_t") - F.coalesce("_set._turns", F.lit(0))) % 2).drop("_set", "_t", "_turns")


def _entered(set_to: Column, turns: Column, state: Column) -> Column:
    """The state before a row, of a part that begins in ``state``."""
    return (F.coalesce(set_to, state) + turns) % 2


def records(lines: DataFrame) -> DataFrame:
    """(path, row_number, record) of lines (path, block, at, line, delimiter).

    ``at`` orders the lines of a block and ``block`` the blocks of a path; the first line of
    a path is its heading, a record by itself with number 1. Records count as a spreadsheet counts
    rows. Line breaks inside quoted cells stay as the file has them, those after a record
    go. A record that isn't closed runs to the end of its file and is cut at
    ``LONGEST_RECORD`` characters, at the end of a line.
    """
    block = ["path", "block"]
    # The heading is met by its block, so that the lines of a file stay spread over its blocks.
    first = lines.groupBy("path").agg(F.min(F.struct("block", "at")).alias("_first")).select("path", F.col("_first.block").alias("block"), F.col("_first.at").alias("_first"))
    led = lines.join(first, block, "left").withColumn("heading", F.coalesce(F.col("at") == F.col("_first"), F.lit(False))).drop("_first")
    cut = led.withColumn("_pieces", F.split("line", '"', -1))
    cut = cut.withColumn("step", F.when(F.col("heading"), SET_OUTSIDE).otherwise(line_step(F.col("_pieces"), F.col("delimiter")))).drop("_pieces", "heading")
    told = _stepped(cut, block, "at")
    upto = W.partitionBy(*block).orderBy("at").rowsBetween(W.unboundedPreceding, W.currentRow)
    told = told.withColumn("chars", F.sum(F.length("line").cast("long") + 1).over(upto))
    for state in (OUTSIDE, INSIDE):
        begins = _entered(F.col("set_to"), F.col("turns"), F.lit(state)) == OUTSIDE
        told = told.withColumn(f"n{state}", F.sum(begins.cast("long")).over(upto)).withColumn(f"from{state}", F.max(F.when(begins, F.col("chars") - F.length("line") - 1)).over(upto))
    told = materialize(told)
    last = F.max(F.struct("at", "step", "set_to", "turns", "chars", *[f"{c}{s}" for s in (OUTSIDE, INSIDE) for c in ("n", "from")])).alias("_l")
    steps = told.groupBy(*block).agg(last).select(*block, "_l.*").drop("at")
    after = lambda s: _after(F.col("step"), _entered(F.col("set_to"), F.col("turns"), F.lit(s)))
    whole = F.when(after(OUTSIDE) == after(INSIDE), F.when(after(OUTSIDE) == OUTSIDE, SET_OUTSIDE).otherwise(SET_INSIDE)).when(after(OUTSIDE) == OUTSIDE, KEPT).otherwise(TURNED)
    steps = _stepped(steps.withColumn("step", whole).drop("set_to", "turns"), ["path"], "block")
    # One row for each file block.
    steps = steps.withColumn("state", _entered(F.col("set_to"), F.col("turns"), F.lit(OUTSIDE)))
    by_state = lambda c: F.when(F.col("state") == OUTSIDE, F.col(f"{c}{OUTSIDE}")).otherwise(F.col(f"{c}{INSIDE}"))
    before = W.partitionBy("path").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    steps = steps.withColumn("base", F.coalesce(F.sum("chars").over(before), F.lit(0))).withColumn("rows_before", F.coalesce(F.sum(by_state("n")).over(before), F.lit(0)))
    steps = steps.withColumn("open_from", F.max(F.col("base") + by_state("from")).over(before)).select(*block, "state", "base", "rows_before", "open_from")

    placed = told.join(steps, block)
    entered = _entered(F.col("set_to"), F.col("turns"), F.col("state"))
    placed = placed.withColumn("_in", entered).withColumn("row_number", F.col("rows_before") + by_state("n"))
    begun = F.coalesce(F.col("base") + by_state("from"), F.col("open_from"))
    placed = placed.withColumn("_so_far", F.col("base") + F.col("chars") - F.length("line") - 1 - begun)
    single = (F.col("_in") == OUTSIDE) & (_after(F.col("step"), F.col("_in")) == OUTSIDE)
    alone = placed.where(single).select("path", "row_number", F.col("line").alias("record"))
    several = placed.where(~single & (F.col("_so_far") < LONGEST_RECORD)).groupBy("path", "row_number").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "at", "line"))), lambda x: x["line"]), "\n").alias("record"))
    return alone.unionByName(several).withColumn("record", F.regexp_replace("record", r"\r\z", ""))


def _after(step: Column, state: Column) -> Column:
    return F.when(step == SET_OUTSIDE, OUTSIDE).when(step == SET_INSIDE, INSIDE).when(step == TURNED, 1 - state).otherwise(state)


def read_records(spark: SparkSession, paths: str | list[str]) -> tuple[DataFrame, DataFrame]:
    """(path, row_number, record) of the files at ``paths`` and their heads (path, encoding, delimiter, header)."""
    raw = raw_lines(spark, paths)
    heads = materialize(file_heads(raw))
    return records(decoded(raw, heads)), heads
