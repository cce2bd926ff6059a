"""Text functions as column expressions: normal forms, keys, similarity, language, redaction.

All of them stay inside the JVM but for the Unicode normal form, for which Spark has no
function: only texts that aren't plain ASCII visit a vectorised Python function.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Look-alike letters and hyphens, invisible characters, Eastern digits, Arabic-script ranges, titles.
LOOKALIKES = "\u064a\u0649\u0643\u0647\u0629\u06bb\u2010\u2011\u2012\u2212"
CANONICAL = "\u06cc\u06cc\u06a9\u06c1\u06c3\u0679----"
INVISIBLE = "\u200b\u200c\u200d\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\ufeff"
EASTERN = "".join(chr(0x660 + d) for d in range(10)) + "".join(chr(0x6F0 + d) for d in range(10))
WESTERN = "0123456789" * 2
ARABIC = "\\x{0600}-\\x{06FF}\\x{0750}-\\x{077F}\\x{08A0}-\\x{08FF}\\x{FB50}-\\x{FDFF}\\x{FE70}-\\x{FEFF}"
KEY_LETTERS = "0-9a-z\u0600-\u06ff\u0750-\u077f"
TITLES = (
    "mr mrs miss ms dr prof hafiz hafiza syed syeda sheikh mian chaudhry ch malik raja sardar haji hajji alhaj begum sahib sahiba late mohtarma janab "
    "محترم محترمہ جناب سید سیدہ حاجی بیگم مرحوم مرحومہ"
).split()
KEY_LENGTH = 200
#: All blanks of Unicode.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())


@F.pandas_udf(StringType())
def _nfkc(text: pd.Series) -> pd.Series:
    return text.map(lambda t: None if t is None else unicodedata.normalize("NFKC", t))


def plain(text: Column) -> Column:
    """Whether a text is ASCII: its normal form has the same words."""
    return F.octet_length(text) == F.length(text)


def nfkc(text: Column) -> Column:
    """Unicode normal form KC."""
    return F.coalesce(F.when(plain(text), text), _nfkc(F.when(~plain(text), text)))


def fold_script(text: Column) -> Column:
    """One spelling for look-alike letters and hyphens, without soft hyphens and invisible characters."""
    folded = F.translate(text, LOOKALIKES, CANONICAL)
    folded = F.regexp_replace(folded, "(?<=\\p{L})\u00ad(?=\\p{L})", "")
    return F.translate(F.replace(folded, F.lit("\u00ad"), F.lit("-")), INVISIBLE, "")


def collapse_lines(text: Column) -> Column:
    """Runs of blanks become one, lines and the whole are trimmed, line breaks stay."""
    lines = F.split(text, "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085\u2028\u2029]")
    tidy = F.transform(lines, lambda x: F.regexp_replace(F.regexp_replace(x, "(?U)\\s+", " "), "^ | $", ""))
    return F.regexp_replace(F.array_join(tidy, "\n"), "^(?U)\\s+|(?U)\\s+$", "")


def normalize_text(text: Column) -> Column:
    """The form in which texts are compared."""
    return collapse_lines(fold_script(nfkc(text)))


def word_tokens(text: Column) -> Column:
    """Runs of letters, marks, digits and underscores of any script."""
    return F.regexp_extract_all(text, F.lit("([\\p{L}\\p{M}\\p{N}_]+)"), F.lit(1))


def western_digits(text: Column) -> Column:
    return F.translate(text, EASTERN, WESTERN)


def number_key(number: Column) -> Column:
    """What two printings of one certificate number share: its letters and digits."""
    held = F.coalesce(number, F.lit(""))
    folded = F.lower(F.when(plain(held), held).otherwise(western_digits(normalize_text(held))))
    return F.substring(F.regexp_replace(folded, f"[^{KEY_LETTERS}]+", ""), 1, KEY_LENGTH)


def name_tokens(name: Column) -> Column:
    """The words of a name without the titles in front."""
    held = F.coalesce(name, F.lit(""))
    words = word_tokens(F.lower(F.when(plain(held), held).otherwise(western_digits(normalize_text(held)))))
    titles = F.array(*[F.lit(t) for t in TITLES])
    # Drop words while all so far are titles: keep from the first that isn't one.
    state = F.aggregate(
        words,
        F.array().cast("array<string>"),
        lambda kept, w: F.when((F.size(kept) == 0) & F.array_contains(titles, w), kept).otherwise(F.concat(kept, F.array(w))),
    )
    return state


def name_key(name: Column) -> Column:
    return F.substring(F.array_join(name_tokens(name), " "), 1, KEY_LENGTH)


def shares_a_name(left: Column, right: Column) -> Column:
    """All words of one name stand in the other, and both have words."""
    a, b = name_tokens(left), name_tokens(right)
    return (F.size(a) > 0) & (F.size(b) > 0) & ((F.size(F.array_except(a, b)) == 0) | (F.size(F.array_except(b, a)) == 0))


def trigrams(text: Column) -> Column:
    """The different three-letter pieces of each word, padded by two blanks before and one after."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) + 1), lambda i: F.substring(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once, however often ``use`` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def similarity(left: Column, right: Column) -> Column:
    """Shared trigrams over all trigrams of both."""

    def share(g: Column) -> Column:
        both = F.size(F.array_union(g["a"], g["b"]))
        return F.when(both > 0, F.size(F.array_intersect(g["a"], g["b"])) / both).otherwise(F.lit(0.0))

    return bound(F.struct(trigrams(left).alias("a"), trigrams(right).alias("b")), share)


def detect_language(text: Column) -> Column:
    """'urd', 'eng' or both by the share of Arabic script among letters; null under three letters."""
    letters = F.length(F.regexp_replace(text, "[^\\p{L}]", ""))
    arabic = F.length(F.regexp_replace(F.regexp_replace(text, "[^\\p{L}]", ""), f"[^{ARABIC}]", ""))
    share = arabic / letters
    return F.when(letters < 3, F.lit(None)).when(share >= 0.85, "urd").when(share <= 0.05, "eng").otherwise("eng+urd")


def slug(text: Column) -> Column:
    """A field name made of a label: lower case, words joined by underscores, 60 characters."""
    words = F.regexp_replace(F.lower(text), "[^\\p{L}\\p{N}_\\s-]+", "")
    return F.substring(F.regexp_replace(F.regexp_replace(words, "[\\s-]+", "_"), "^_+|_+$", ""), 1, 60)


def formula_guard(text: Column) -> Column:
    """A quote before what a spreadsheet would take for a formula."""
    return F.when(text.rlike("^[=+\\-@\\t\\r]"), F.concat(F.lit("'"), text)).otherwise(text)


#: What free text is cleared of, in this order, and by what.
REDACTIONS = (
    ("eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+", "[token]"),
    ("(?i)bearer\\s+[A-Za-z0-9._~+/-]+=*", "[token]"),
    ("[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]{2,}", "[email]"),
    ("[0-9]{5}-[0-9]{7}-[0-9]", "[id]"),
    ("[0-9]{11,}", "[number]"),
    ("[0-9]{1,2}[-/.][0-9]{1,2}[-/.][0-9]{4}", "[date]"),
)


def redact(text: Column, longest: int = 500) -> Column:
    """Free text without tokens, addresses, ids, long numbers, dates and Arabic script, cut with a note of what is gone."""
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    text = F.regexp_replace(text, f"[{ARABIC}]+(?:\\s+[{ARABIC}]+)*", "[text]")
    text = F.regexp_replace(text, "(?i)(password|secret|token|api_key)\\s*[=:]\\s*[^\\s,;]+", "$1=[hidden]")
    over = F.length(text) - longest
    return F.when(over > 0, F.concat(F.substring(text, 1, longest), F.lit("... (+"), over.cast("string"), F.lit(" chars)"))).otherwise(text)
