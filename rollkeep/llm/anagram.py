"""Operator 11: spelling variants of corpus words by anagram hashing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeep.llm.storage import materialize

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Letters count as their code point to this power; sums of two such powers are equal only for equal letters.
POWER = 5
#: Sums are kept modulo this prime, so that words of any length fit a long.
MODULUS = (1 << 61) - 1
#: A run is damaged where this divides its hash.
DAMAGE = 31


def damaged(doc_id: Column, run: Column) -> Column:
    """``run`` without one letter where 31 divides the crc32 of ``<doc_id>:<run>``, else ``run``."""
    h = F.crc32(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.length(run)).cast("int")
    return F.when(h % DAMAGE == 0, F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))).otherwise(run)


def corpus_words(docs: DataFrame, shortest: int = 7, least: int = 2) -> DataFrame:
    """(word, n): the words of all texts with at least ``shortest`` code points and ``least`` occurrences.

    Counts are combined before the shuffle, so a frequent word is a row for each task.
    """
    runs = F.regexp_extract_all(F.col("text").cast("string"), F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))
    words = docs.select("doc_id", F.explode(runs).alias("run")).select(damaged(F.col("doc_id"), F.translate("run", UPPER, LOWER)).alias("word"))
    return words.where(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least)


def letter_value(letter: Column) -> Column:
    """The code point to the fifth power."""
    code = F.ascii(letter).cast("long")
    return code * code * code * code * code


def keyed(words: DataFrame) -> DataFrame:
    """(key, first, letter, word, n): the integer keys of each word, whole (letter empty) and less one letter of each kind.

    Two words one letter apart have equal sums once the letters in which they differ are
    taken off: the whole shorter word and the longer one less the added letter, or both
    less the exchanged letters. What stands before the difference or what stands after it
    is at least half of the letters they share, so a key holds the first or the last half
    as it stands, and the sum of letter values where the order is open. A word
    has at most two rows for each kind of letter and two more, whatever its length.
    """
    held = words.withColumn("_l", F.split("word", "")).withColumn("_n", F.length("word"))
    held = held.withColumn("_sum", F.aggregate("_l", F.lit(0).cast("long"), lambda a, c: (a + letter_value(c)) % MODULUS))

    def keys(first: bool, less: int) -> Column:
        length = F.col("_n") - less
        half = F.ceil(length / 2).cast("int")
        kept = F.col("word").substr(F.lit(1), half) if first else F.col("word").substr(F.col("_n") - half + 1, half)
        free = F.slice("_l", half + 1, F.col("_n") - half) if first else F.slice("_l", F.lit(1), F.col("_n") - half)
        value = (lambda c: (F.col("_sum") - letter_value(c) + MODULUS) % MODULUS) if less else (lambda c: F.col("_sum"))
        return F.transform(F.array_distinct(free) if less else F.array(F.lit("")), lambda c: F.struct(F.xxhash64(F.lit(first), kept, length, value(c)).alias("key"), F.lit(first).alias("first"), c.alias("letter")))

    every = F.concat(*[keys(first, less) for first in (True, False) for less in (0, 1)])
    return held.select("word", "n", F.explode(every).alias("_k")).select("_k.*", "word", "n")


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, a_n, b, b_n): each two words exactly one inserted, deleted or replaced letter apart, once.

    Keys that differ by the value of a one-letter addition, removal or exchange meet in one
    equal join; then the order of the letters is verified. A pair with both halves in
    common is taken by its first half only.
    """
    rows = materialize(keyed(words))
    a, b = (rows.select("key", "first", F.col("letter").alias(f"{x}_letter"), F.col("word").alias(x), F.col("n").alias(f"{x}_n")) for x in "ab")
    met = a.join(b, ["key", "first"]).where(F.col("a_letter") < F.col("b_letter"))
    shared = F.least(F.length("a"), F.length("b")) - F.when(F.length("a") == F.length("b"), 1).otherwise(0)
    half = F.ceil(shared / 2).cast("int")
    alike = F.col("a").substr(F.lit(1), half) == F.col("b").substr(F.lit(1), half)
    return met.where(F.col("first") | ~alike).where(F.levenshtein("a", "b", 1) == 1).select("a", "a_n", "b", "b_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of rows (word, form): the end of each chain of forms, by doubling the steps.

    A form is at least ``ratio`` times as frequent as its word, so chains are short and have no rings.
    """
    now = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        nxt = now.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        stepped = materialize(now.join(nxt, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root"), F.col("_r").isNotNull().alias("moved")))
        now = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return now


def spelling_variants(docs: DataFrame, shortest: int = 7, least: int = 2, ratio: int = 10) -> DataFrame:
    """word, form, root, n, n_near, form_n for each word of at least ``shortest`` letters and ``least`` occurrences.

    ``docs`` has doc_id and text. Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF,
    A-Z lower-cased, some of them damaged as :func:`damaged` states. ``n_near`` counts the words
    exactly one inserted, deleted or replaced code point apart; ``form`` is the most frequent of
    them (of equals the first by code point) where it is at least ``ratio`` times as
    frequent, else null, and ``form_n`` its count; ``root`` ends the chain of forms, or is the
    word itself. Null and empty texts have no words; a null doc_id counts as an empty text
    before the colon; repeated rows and ids are documents like any others; other columns are
    ignored. An empty table gives no rows.
    """
    words = materialize(corpus_words(docs, shortest, least))
    sides = [F.struct(F.col(x).alias("word"), (-F.col(f"{y}_n")).alias("less"), F.col(y).alias("near")) for x, y in ("ab", "ba")]
    both = near_pairs(words).select(F.explode(F.array(*sides)).alias("_p")).select("_p.*")
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct("less", "near")).alias("_best"))
    near = -F.col("_best.less")
    joined = words.join(best, "word", "left").withColumn("_has", near >= ratio * F.col("n"))
    named = materialize(joined.select("word", F.when(F.col("_has"), F.col("_best.near")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(F.col("_has"), near).alias("form_n")))
    return named.join(roots(named.where("form IS NOT NULL")), "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
