"""Lines, columns and blocks out of the words of a page, in reading order.

Everything is windows over the words of a page and folds over short arrays: one shuffle by page,
and only the sorts within a page differ. A task holds a copy of its words for each of these sorts, so
pages are dealt by how many words there are, not by how small the shuffle is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.functions.text import ARABIC, WHITESPACE, fold_script, nfkc, normalize_text

#: How many lines back a word may join, and the share of the lower height they must have in common.
LOOK_BACK, OVERLAP = 3, 0.5
#: Gaps that begin a block (in median line heights), a column (in heights of the line) and a space (in heights of the smaller word).
BLOCK_GAP, COLUMN_GAP, SPACE_GAP = 1.6, 3.0, 0.08
#: Words that a task lays out, about; a page is never parted.
WORDS_A_TASK = 1 << 17
PAGE = ["document_id", "page_number"]
SIDES = ("x0", "y0", "x1", "y1")
_RECENT = "array<struct<id:int,y0:double,y1:double>>"
_STATE = f"struct<recent:{_RECENT},of:array<int>,n:int>"


def _shared(a: Column, b: Column) -> Column:
    """The common height over the lower height; of a flat word 1 where it touches."""
    common = F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"])
    lower = F.least(a["y1"] - a["y0"], b["y1"] - b["y0"])
    return F.when(lower > 0, F.greatest(common, F.lit(0.0)) / lower).otherwise((common >= 0).cast("double"))


def _line_numbers(words: Column) -> Column:
    """For an array of words in order of height: the number of the line each belongs to.

    A word joins the latest of the last lines begun that it shares enough height with, and widens
    it; else it begins a line.
    """

    def step(state: Column, word: Column) -> Column:
        joined = F.get(F.filter(state["recent"], lambda r: _shared(word, r) >= OVERLAP), F.lit(0))["id"]
        begun = F.slice(F.concat(F.array(F.struct(state["n"].alias("id"), word["y0"], word["y1"])), state["recent"]), 1, LOOK_BACK)
        widened = F.transform(state["recent"], lambda r: F.when(r["id"] == joined, F.struct(r["id"], F.least(r["y0"], word["y0"]).alias("y0"), F.greatest(r["y1"], word["y1"]).alias("y1"))).otherwise(r))
        recent = F.when(joined.isNull(), begun).otherwise(widened).cast(_RECENT)
        return F.struct(recent.alias("recent"), F.concat(state["of"], F.array(F.coalesce(joined, state["n"]))).alias("of"), (state["n"] + joined.isNull().cast("int")).alias("n")).cast(_STATE)

    start = F.struct(F.array().cast(_RECENT).alias("recent"), F.array().cast("array<int>").alias("of"), F.lit(0).alias("n")).cast(_STATE)
    return F.aggregate(words, start, step, lambda state: state["of"])


def visual_lines(words: DataFrame) -> DataFrame:
    """Adds ``_line`` (a number from the top, from 0) and the line's ``_top`` and ``_bottom`` to words with _key, text and box.

    Where no word above reaches down to a word, nothing joins across: the page falls into
    bands, whose lines are worked out apart from each other.
    """
    by_height = W.partitionBy(*PAGE).orderBy("_mid", "x0", "_key")
    above = F.max("y1").over(by_height.rowsBetween(W.unboundedPreceding, -1))
    banded = words.withColumn("_mid", (F.col("y0") + F.col("y1")) / 2).withColumn("_apart", F.coalesce(F.col("y0") > above, F.lit(True)).cast("int"))
    banded = banded.withColumn("_band", F.sum("_apart").over(by_height)).drop("_apart")
    kept = [c for c in banded.columns if c not in (*PAGE, "_band")]
    bands = banded.groupBy(*PAGE, "_band").agg(F.sort_array(F.collect_list(F.struct("_mid", "x0", "_key", *[c for c in kept if c not in ("_mid", "x0", "_key")]))).alias("_words"))
    told = bands.withColumn("_of", _line_numbers(F.col("_words")))
    each = told.select(*PAGE, "_band", F.explode(F.arrays_zip("_words", "_of")).alias("_w")).select(*PAGE, "_band", "_w._of", "_w._words.*")
    line = W.partitionBy(*PAGE, "_band", "_of")
    sized = each.withColumn("_top", F.min("y0").over(line)).withColumn("_bottom", F.max("y1").over(line)).withColumn("_left", F.min("x0").over(line))
    order = W.partitionBy(*PAGE).orderBy("_top", "_left", "_band", "_of")
    return sized.withColumn("_line", F.dense_rank().over(order) - 1).drop("_band", "_of", "_mid", "_left")


def _direction(arabic: Column, letters: Column) -> Column:
    """Whether a text is written leftwards; null without letters."""
    return F.when(letters > 0, arabic * 2 > letters)


def reading_order(words: DataFrame) -> DataFrame:
    """Adds to words of lines ``_at``, their place in the line as it is read (in order of ``_r`` and ``_i``), and ``_column``.

    Words come in runs: those of one ``line_key`` in their ``order`` where every word of the page has
    one, else each word by itself. Runs from left to right are cut into columns at wide gaps. A
    column is read in the direction of its first run with letters; runs against it
    are turned round together, with what stands between two of them. Columns of a line that is
    written leftwards throughout are read from the right.
    """
    line = [*PAGE, "_line"]
    letters = F.regexp_replace("text", "[^\\p{L}]", "")
    height = F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0"))
    told = words.withColumn("_letters", F.length(letters)).withColumn("_arabic", F.length(F.regexp_replace(letters, f"[^{ARABIC}]", "")))
    told = told.withColumn("_trusted", F.min(F.col("line_key").isNotNull()).over(W.partitionBy(*PAGE)))
    told = told.withColumn("_o", F.when(F.col("_trusted"), F.col("order").cast("double")).otherwise(F.col("x0")))
    engine = W.partitionBy(*line).orderBy("_o", "_key")
    same = F.col("_trusted") & (F.col("line_key") == F.lag("line_key").over(engine))
    told = told.withColumn("_new", 1 - F.coalesce(same, F.lit(False)).cast("int")).withColumn("_run", F.sum("_new").over(engine))
    told = told.withColumn("_height", F.coalesce(F.median(height).over(W.partitionBy(*line)), F.lit(1.0)))

    held = F.sort_array(F.collect_list(F.struct("_o", "_key", "text", *SIDES))).alias("_held")
    runs = told.groupBy(*line, "_run", "_height", "_top", "_bottom").agg(F.min("x0").alias("_x0"), F.max("x1").alias("_x1"), _direction(F.sum("_arabic"), F.sum("_letters")).alias("_left"), held)
    across = W.partitionBy(*line).orderBy("_x0", "_run")
    gap = F.greatest(F.col("_x0") - F.lag("_x1").over(across), F.lag("_x0").over(across) - F.col("_x1"), F.lit(0.0))
    runs = runs.withColumn("_wide", F.coalesce(gap > COLUMN_GAP * F.col("_height"), F.lit(False)).cast("int")).withColumn("_column", F.sum("_wide").over(across)).withColumn("_p", F.row_number().over(across))

    column = [*line, "_column"]
    whole = W.partitionBy(*column).orderBy("_p").rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    runs = runs.withColumn("_base", F.first("_left", ignorenulls=True).over(whole)).withColumn("_s", F.when(F.col("_base"), -F.col("_p")).otherwise(F.col("_p")))
    along = W.partitionBy(*column).orderBy("_s")
    before = F.coalesce(F.last("_left", ignorenulls=True).over(along.rowsBetween(W.unboundedPreceding, -1)), F.col("_base"))
    after = F.coalesce(F.first("_left", ignorenulls=True).over(along.rowsBetween(1, W.unboundedFollowing)), F.col("_base"))
    against = F.coalesce(F.col("_left") != F.col("_base"), (before != F.col("_base")) & (after != F.col("_base")), F.lit(False))
    runs = runs.withColumn("_against", against)
    turn = F.coalesce(F.col("_against") != F.lag("_against").over(along), F.lit(False)).cast("int")
    runs = runs.withColumn("_turn", turn).withColumn("_stretch", F.sum("_turn").over(along))
    leftwards = F.coalesce(F.min("_base").over(W.partitionBy(*line)), F.lit(False))
    runs = runs.withColumn("_column", F.when(leftwards, -F.col("_column")).otherwise(F.col("_column")))
    runs = runs.withColumn("_r", F.row_number().over(W.partitionBy(*line).orderBy("_column", "_stretch", F.when(F.col("_against"), -F.col("_s")).otherwise(F.col("_s")))))
    words = runs.select(*line, "_column", "_height", "_top", "_bottom", "_r", F.posexplode("_held").alias("_i", "_w"))
    placed = words.withColumn("_at", F.row_number().over(W.partitionBy(*line).orderBy("_r", "_i")) - 1)
    return placed.select(*line, "_column", "_height", "_top", "_bottom", "_r", "_i", "_at", "_w.text", *[f"_w.{s}" for s in SIDES])


def placed_words(words: DataFrame) -> DataFrame:
    """(document_id, page_number, line, block, position, before, text, x0, y0, x1, y1): each word where it is read.

    ``words`` has document_id, page_number, text and the box x0, y0, x1, y1, and may have ``line_key`` and
    ``order`` of an engine that knows the logical order of words within its runs. ``before`` is the blank that
    stands before the word in its line, or nothing. Words of blanks only and pages without words
    give no rows; equal words at one place are words like others. Other columns are ignored.
    """
    text = F.btrim(fold_script(nfkc(F.col("text").cast("string"))), F.lit(WHITESPACE))
    key = F.col("line_key").cast("string") if "line_key" in words.columns else F.lit(None).cast("string")
    order = F.col("order").cast("long") if "order" in words.columns else F.lit(None).cast("long")
    usable = words.select(*PAGE, text.alias("text"), *[F.col(s).cast("double").alias(s) for s in SIDES], key.alias("line_key"), order.alias("order")).where("text <> ''")
    usable = usable.repartition(max(1, -(-words.count() // WORDS_A_TASK)), *PAGE)
    # What tells words of equal place apart: the engine's order, then their boxes and texts.
    usable = usable.withColumn("_key", F.struct(F.coalesce("order", F.lit(0)).alias("o"), F.col("x1").alias("x"), F.col("y0").alias("y"), F.col("text").alias("t")))
    read = reading_order(visual_lines(usable))
    line = W.partitionBy(*PAGE, "_line").orderBy("_r", "_i")
    own = F.when(F.col("y1") > F.col("y0"), F.col("y1") - F.col("y0")).otherwise(F.col("_height"))
    near = F.lag(F.struct(F.col("x0").alias("a"), F.col("x1").alias("b"), own.alias("h"), F.col("_column").alias("c"))).over(line)
    read = read.withColumn("_own", own).withColumn("_near", near)
    gap = F.greatest(F.col("x0") - F.col("_near.b"), F.col("_near.a") - F.col("x1"), F.lit(0.0))
    spaced = (F.col("_near.c") != F.col("_column")) | (gap > SPACE_GAP * F.least("_own", "_near.h"))
    return with_blocks(read.withColumn("before", F.when(spaced, " ").otherwise("")))


def with_blocks(read: DataFrame) -> DataFrame:
    """Numbers blocks: one ends where the next line is further down than ``BLOCK_GAP`` median heights of the page's lines.

    The first word of a line stands for it, so that words needn't be joined with their lines.
    """
    opens = F.col("_at") == 0
    height = F.median(F.when(opens & (F.col("_bottom") > F.col("_top")), F.col("_bottom") - F.col("_top"))).over(W.partitionBy(*PAGE))
    down = W.partitionBy(*PAGE).orderBy("_line", "_r", "_i")
    told = read.withColumn("_median", height).withColumn("_far", (opens & F.coalesce(F.col("_top") - F.lag("_bottom").over(down) > BLOCK_GAP * F.col("_median"), F.lit(False))).cast("int"))
    told = told.withColumn("block", F.sum("_far").over(down.rowsBetween(W.unboundedPreceding, W.currentRow)))
    return told.select(*PAGE, F.col("_line").cast("long").alias("line"), F.col("block").cast("long").alias("block"), F.col("_at").cast("long").alias("position"), "before", "text", *SIDES)


def lines(words: DataFrame) -> DataFrame:
    """(document_id, page_number, line, block, text, x0, y0, x1, y1) of pages; see :func:`placed_words`."""
    parts = F.transform(F.sort_array(F.collect_list(F.struct("position", F.concat("before", "text").alias("t")))), lambda p: p["t"])
    box = [(F.min if s in ("x0", "y0") else F.max)(s).alias(s) for s in SIDES]
    joined = placed_words(words).groupBy(*PAGE, "line", "block").agg(F.array_join(parts, "").alias("_t"), *box)
    return joined.select(*PAGE, "line", "block", normalize_text(F.col("_t")).alias("text"), *SIDES)
