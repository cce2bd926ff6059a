"""Labelled values out of lines of text: rules, extras, templates, fingerprints, learned rules."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.operators.likeness import damaged_names

FOUND = "array<struct<field:string,name:string,at:int,length:int,ratio:double>>"
SEPARATORS = ":=.\\-–—"
GENERIC = 7
SAME_LINE, NEXT_LINE, PROSE = 1.0, 0.8, 0.85
#: What is left of the confidence of a scan that nothing can be read in, and how far off a label in the other script may follow.
OCR_FLOOR, CHAIN = 0.6, 40
# What values of a kind look like.
SHAPES = {
    "date": "[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}|[0-9]{1,2}\\s*[-/.]\\s*[0-9]{1,2}\\s*[-/.]\\s*[0-9]{2,4}|[0-9]{1,2}\\s+\\p{L}{3,9}\\.?,?\\s+[0-9]{4}",
    "time": "(?i)[0-9]{1,2}\\s*[:.]\\s*[0-9]{2}\\s*(?:am|pm|a\\.m\\.|p\\.m\\.)?",
    "id_number": "[0-9]{5}[-\\s]?[0-9]{7}[-\\s]?[0-9]",
    "number": "[0-9][0-9,]*(?:\\.[0-9]+)?",
}


def lines_of(pages: DataFrame) -> DataFrame:
    """(document_id, page_number, line, text, next_text): the lines of each page that aren't blank."""
    rows = F.filter(F.split(F.replace("text", F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.trim(x) != "")
    arranged = pages.select("document_id", "page_number", rows.alias("rows")).select("document_id", "page_number", "rows", F.posexplode("rows").alias("line", "text"))
    return arranged.select("document_id", "page_number", F.col("line").cast("long").alias("line"), "text", F.get("rows", F.col("line") + 1).alias("next_text"))


def tidy(value: Column) -> Column:
    """A value without the separators around it and without stray single letters before it."""
    bare = F.regexp_replace(F.regexp_replace(value, f"^[\\s{SEPARATORS}/|]+", ""), f"[\\s{SEPARATORS}/|]+$", "")
    return F.regexp_replace(bare, "^(?:[^0-9\\s]\\s+)+(?=\\S)", "")


def shaped(value: Column, kind: str) -> Column:
    """The part of a value that looks like its kind; null if none does."""
    if kind not in SHAPES:
        return value
    found = F.trim(F.regexp_extract(value, f"({SHAPES[kind]})", 1))
    return F.when(found != "", found)


def _other_script(name: str, names: tuple[str, ...]) -> list[str]:
    """The names of a field that are written in the other script (Arabic or not) than one of them."""
    arabic = lambda t: sum("\u0600" <= c <= "\u06ff" for c in t) * 2 > sum(c.isalpha() for c in t)
    return [n for n in names if arabic(n) != arabic(name)]


def damaged_by_line(low: DataFrame, pairs: list[tuple[str, str]], least: float) -> DataFrame:
    """(_low, _damaged): for each different line the labels (field, name) that it holds damaged only."""
    found = damaged_names(low, [name for _, name in pairs], least)
    fields = {name: [f for f, n in pairs if n == name] for _, name in pairs}
    of = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.array(*[F.lit(f) for f in fs])) for n, fs in fields.items()]))
    each = found.withColumn("field", F.explode(F.element_at(of, F.col("name"))))
    # At most one for each label.
    return each.groupBy(F.col("low").alias("_low")).agg(F.collect_list(F.struct("field", "name", "at", "length", "ratio")).cast(FOUND).alias("_damaged"))


def labelled(lines: DataFrame, labels: dict[str, tuple[str, ...]], kinds: dict[str, str] | None = None, damaged: float | None = None) -> DataFrame:
    """(document_id, field, value, confidence, page_number, line): the best labelled value of each field.

    On each line the label that explains most of it counts (likeness times length), at its
    last place; short labels only at the line's start. With ``damaged``, a likeness from 0
    to 100, labels that a line doesn't hold are also looked for as poor scans leave them.
    The same label in the other script right after it is stepped over. The value is the
    rest of the line, else the next line unless that holds a label. A column
    ``ocr_confidence`` (0 to 100) of ``lines``, where there is one, scales the confidence
    of scanned lines. Of several readings those with an undamaged label come first, then
    those that explain most, the surest, and the earliest page and line. All lines are
    scanned once for all labels.
    """
    low, edge = F.lower("text"), f"[\\s{SEPARATORS}/|()\\[\\]]"
    pairs = [(field, name.lower()) for field, names in labels.items() for name in names]
    found = []
    for field, name in pairs:
        at = F.length(low) - F.instr(F.reverse(low), name[::-1]) - len(name) + 2
        found.append(F.when(F.instr(low, name) > 0, F.struct(F.lit(field).alias("field"), F.lit(name).alias("name"), at.alias("at"), F.lit(len(name)).alias("length"), F.lit(1.0).alias("ratio"))))
    exact = F.filter(F.array(*found), lambda c: c.isNotNull())
    every = exact
    if damaged is not None:
        lines = lines.join(damaged_by_line(lines.select(low.alias("low")), pairs, damaged), low == F.col("_low"), "left")
        every = F.concat(exact, F.coalesce("_damaged", F.array().cast(FOUND)))
    own = lambda c: F.trim(F.regexp_replace(F.substring(low, F.lit(1), c["at"] - 1), f"{edge}+", "")) == ""
    held = lines.withColumn("labels", every)
    met = held.select("*", F.inline(F.filter("labels", lambda c: (F.length(c["name"]) > GENERIC) | own(c))))
    met = met.withColumn("evidence", F.col("ratio") * F.length("name"))
    longest = F.row_number().over(W.partitionBy("document_id", "page_number", "line", "field").orderBy(F.desc("evidence"), "at", "name"))
    met = met.withColumn("place", longest).where("place = 1")

    rest = F.substring(F.col("text"), F.col("at") + F.col("length"), F.length("text"))
    stepped = rest
    for field, names in labels.items():
        for name in names:
            others = _other_script(name, names)
            if others:
                either = "|".join(re.escape(n) for n in sorted(others, key=len, reverse=True))
                stepped = F.when((F.col("field") == field) & (F.col("name") == name.lower()), F.regexp_replace(rest, f"(?i)^{edge}{{0,{CHAIN}}}(?:{either})", "")).otherwise(stepped)
    if damaged is not None:
        # The other script's name may be damaged as well: then it isn't found by its spelling but among the line's labels.
        other = F.map_from_entries(F.array(*[F.struct(F.lit(f"{field}\n{name.lower()}"), F.array(*[F.lit(n.lower()) for n in _other_script(name, names)]).cast("array<string>")) for field, names in labels.items() for name in dict.fromkeys(names)]))
        end = F.col("at") + F.col("length")
        between = lambda c: F.regexp_replace(F.substring(low, end, c["at"] - end), f"{edge}+", "") == ""
        theirs = F.element_at(other, F.concat("field", F.lit("\n"), "name"))
        beside = F.filter("labels", lambda c: (c["ratio"] < 1) & (c["field"] == F.col("field")) & F.array_contains(theirs, c["name"]) & (c["at"] >= end) & (c["at"] <= end + CHAIN) & between(c))
        nearest = F.get(F.array_sort(F.transform(beside, lambda c: F.struct((-F.length(c["name"])).alias("longest"), (c["at"] + c["length"]).alias("end")))), F.lit(0))["end"]
        met = met.withColumn("_next", nearest)
        stepped = F.when((stepped == rest) & F.col("_next").isNotNull(), F.substring(F.col("text"), F.col("_next"), F.length("text"))).otherwise(stepped)
    met = met.withColumn("rest", stepped)
    separated = F.col("rest").rlike(f"^\\s*[{SEPARATORS}/|]") | (F.col("rest") != rest)
    under = F.lower("next_text")
    free = ~F.exists(F.array(*[F.lit(name) for _, name in pairs]), lambda n: F.contains(under, n))
    here, below = tidy(F.col("rest")), tidy(F.col("next_text"))
    value = F.when(here != "", here).when((below != "") & free, below)
    place = F.when(here == "", NEXT_LINE).when(separated, SAME_LINE).otherwise(PROSE)
    read = F.coalesce(F.round(OCR_FLOOR + (1 - OCR_FLOOR) * F.col("ocr_confidence") / 100, 4), F.lit(1.0)) if "ocr_confidence" in lines.columns else F.lit(1.0)
    by_kind = value
    for k in SHAPES:
        some = [f for f, kind in (kinds or {}).items() if kind == k]
        if some:
            by_kind = F.when(F.col("field").isin(some), shaped(value, k)).otherwise(by_kind)
    rows = met.select("document_id", "field", by_kind.alias("value"), F.round(place * F.col("ratio") * read, 4).alias("confidence"), "ratio", "evidence", "page_number", "line").where("value is not null")
    best = F.row_number().over(W.partitionBy("document_id", "field").orderBy(F.desc(F.col("ratio") >= 1), F.desc("evidence"), F.desc("confidence"), "page_number", "line"))
    return rows.withColumn("place", best).where("place = 1").drop("place", "ratio", "evidence")


def extra_fields(lines: DataFrame, known: list[str]) -> DataFrame:
    """(document_id, label, value): 'label: value' lines whose label has nothing to do with a known one; the first wins."""
    shape = "^([^:]{3,60}):\\s*(.{1,200})$"
    pairs = lines.where(F.col("text").rlike(shape)).select("document_id", "page_number", "line", F.trim(F.regexp_extract("text", shape, 1)).alias("label"), F.trim(F.regexp_extract("text", shape, 2)).alias("value"))
    low, unknown = F.lower("label"), F.lit(True)
    for name in known:
        unknown = unknown & (F.instr(low, name.lower()) == 0) & (F.instr(F.lit(name.lower()), low) == 0)
    first = F.row_number().over(W.partitionBy("document_id", "label").orderBy("page_number", "line"))
    return pairs.where(unknown).withColumn("place", first).where("place = 1").select("document_id", "label", "value")


def fingerprints(pages: DataFrame, version: int = 1) -> DataFrame:
    """(document_id, fingerprint): a hash of the form's printed lines: label parts without digits, of 4 to 60 letters."""
    heads = F.transform(F.split("text", "\\r\\n|[\\n\\r]"), lambda x: F.lower(F.trim(F.regexp_replace(F.split_part(x, F.lit(":"), F.lit(1)), "\\s+", " "))))
    anchors = F.slice(F.array_distinct(F.filter(heads, lambda x: F.length(x).between(4, 60) & ~x.rlike("[0-9]"))), 1, 40)
    each = pages.select("document_id", F.explode_outer(anchors).alias("anchor"))
    found = each.groupBy("document_id").agg(F.array_sort(F.collect_set("anchor")).alias("anchors"))
    body = F.concat(F.lit(f"v{version}|"), F.array_join(F.transform("anchors", lambda a: F.concat(a, F.lit("\n"))), ""))
    return found.select("document_id", F.sha2(body, 256).alias("fingerprint"))


def applied(lines: DataFrame, rules: DataFrame) -> DataFrame:
    """(document_id, field, value, confidence): what template rules read.

    ``rules`` has fingerprint, field, anchor, where ('after' or 'below') and pattern (may
    be null); ``lines`` has the fingerprint of its document. The first line that holds the
    anchor and gives a value counts; of a pattern, the part that matches is the value.
    """
    met = lines.join(rules, "fingerprint").where(F.instr(F.lower("text"), F.lower("anchor")) > 0)
    after = tidy(F.substring(F.col("text"), F.instr(F.lower("text"), F.lower("anchor")) + F.length("anchor"), F.length("text")))
    value = F.when(F.col("where") == "below", tidy(F.col("next_text"))).otherwise(after)
    fits = F.col("pattern").isNull() | F.expr("coalesce(value rlike pattern, false)")
    part = F.when(F.col("pattern").isNull(), F.col("value")).otherwise(F.expr("regexp_substr(value, pattern)"))
    rows = met.withColumn("value", value).where(fits).withColumn("value", part).where("value != ''")
    first = F.row_number().over(W.partitionBy("document_id", "field").orderBy("page_number", "line"))
    return rows.withColumn("place", first).where("place = 1").select("document_id", "field", "value", F.lit(0.95).alias("confidence"))


def applied_cells(cells: DataFrame, rules: DataFrame) -> DataFrame:
    """(document_id, field, value, confidence): what rules that look to the right in a table read.

    ``cells`` has document_id, fingerprint, page_number, table, row, column (from 0) and
    text; ``rules`` has fingerprint, field, anchor and pattern (may be null). Of each page
    the first row counts whose first cell holds the anchor and which has another cell that
    isn't blank; the first page counts whose value fits the pattern.
    """
    place = ["document_id", "fingerprint", "page_number", "table", "row"]
    filled = F.when(F.trim("text") != "", F.struct("column", F.trim("text").alias("text")))
    rows = cells.groupBy(*place).agg(F.max(F.when(F.col("column") == 0, F.lower("text"))).alias("head"), F.min(F.when(F.col("column") > 0, filled)).alias("right"))
    met = rows.join(rules, "fingerprint").where(F.contains("head", F.lower("anchor")) & F.col("right").isNotNull())
    pages = met.groupBy("document_id", "field", "pattern", "page_number").agg(F.min(F.struct("table", "row", F.col("right")["text"].alias("value")))["value"].alias("value"))
    fits = F.col("pattern").isNull() | F.expr("coalesce(value rlike pattern, false)")
    part = F.when(F.col("pattern").isNull(), F.col("value")).otherwise(F.expr("regexp_substr(value, pattern)"))
    fitting = pages.where(fits).withColumn("value", part).where("value != ''")
    return fitting.groupBy("document_id", "field").agg(F.min(F.struct("page_number", "value"))["value"].alias("value"), F.lit(0.95).alias("confidence"))


def learned(lines: DataFrame, corrections: DataFrame) -> DataFrame:
    """(document_id, field, anchor, where): rules that would have read a corrected value.

    The value must stand on one line only; its label is what precedes it on the line, else
    the line above. Labels have 3 to 60 characters, letters and no digits.
    """
    above = lines.withColumn("above", F.lag("text").over(W.partitionBy("document_id", "page_number").orderBy("line")))
    held = above.join(corrections, "document_id").where(F.instr("text", F.col("value")) > 0)
    once = held.withColumn("n", F.count("*").over(W.partitionBy("document_id", "field"))).where("n = 1")
    before = tidy(F.substring(F.col("text"), F.lit(1), F.instr("text", F.col("value")) - 1))
    label = lambda c: F.when(F.length(c).between(3, 60) & c.rlike("\\p{L}") & ~c.rlike("[0-9]"), c)
    alone = F.trim("text") == F.col("value")
    rows = once.select("document_id", "field", F.when(alone, label(tidy(F.col("above")))).otherwise(label(before)).alias("anchor"), F.when(alone, "below").otherwise("after").alias("where"))
    return rows.where("anchor is not null")


def text_quality(pages: DataFrame, dictionary: DataFrame, least_chars: int = 100, least_hits: float = 0.35) -> DataFrame:
    """(document_id, page_number, char_count, alnum_ratio, hit_rate, tokens, needs_ocr) of each page.

    ``dictionary`` has lower-case words in column ``word``. Digits are hits; so are words
    with digits of up to 20 characters. Words meet the dictionary in one join, counted by page.
    """
    usable = F.length(F.regexp_replace("text", "[^\\p{L}\\p{N}]", ""))
    visible = F.length(F.regexp_replace("text", "\\s", ""))
    words = F.filter(F.regexp_extract_all("text", F.lit("([\\p{L}\\p{N}_]+)"), F.lit(1)), lambda w: (F.length(w) >= 2) & w.rlike("[\\p{L}\\p{N}]"))
    measured = pages.select("document_id", "page_number", usable.alias("char_count"), F.when(visible > 0, F.round(usable / visible, 4)).otherwise(0.0).alias("alnum_ratio"), words.alias("words"))
    tokens = measured.select("document_id", "page_number", F.explode("words").alias("w"))
    counted = tokens.groupBy("document_id", "page_number", F.lower("w").alias("word")).agg(F.count("*").alias("n"))
    known = dictionary.select("word").distinct().withColumn("known", F.lit(True))
    hit = F.when(F.col("word").rlike("^[0-9]+$"), True).when(F.col("word").rlike("[0-9]"), F.length("word") <= 20).otherwise(F.coalesce("known", F.lit(False)))
    rates = counted.join(known, "word", "left").groupBy("document_id", "page_number").agg(F.sum("n").alias("tokens"), F.sum(F.when(hit, F.col("n")).otherwise(0)).alias("hits"))
    joined = measured.drop("words").join(rates, ["document_id", "page_number"], "left")
    rate = F.coalesce(F.round(F.col("hits") / F.col("tokens"), 4), F.lit(0.0))
    return joined.select("document_id", "page_number", F.col("char_count").cast("long").alias("char_count"), "alnum_ratio", rate.alias("hit_rate"), F.coalesce("tokens", F.lit(0)).cast("long").alias("tokens"), ((F.col("char_count") < least_chars) | (rate < least_hits)).alias("needs_ocr"))


def best_attempts(attempts: DataFrame, key: str) -> DataFrame:
    """The best reading of each page: confidence and 40 times the hit rate; of equals the first attempt."""
    worth = F.col("confidence") + 40 * F.col("hit_rate")
    return attempts.groupBy(key).agg(F.max_by("attempt", F.struct(worth, -F.col("attempt"))).alias("attempt"), F.round(F.max(worth), 4).alias("worth"))
