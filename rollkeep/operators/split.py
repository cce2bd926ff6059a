"""Where certificates begin in a document, and what kind each is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.functions.text import bound
from rollkeep.operators.likeness import damaged_names

#: The weight of a phrase that is a title, and how long a line must be to hold a damaged one.
TITLE, SHORTEST_TITLE = 3.0, 8

# Titles of certificates and labels of their numbers.
HEADINGS = ("(?i)\\bcertificate\\s+of\\s+(birth|death|marriage)\\b", "(?i)\\b(birth|death|marriage|nikah)\\s+certificate\\b", "(?i)\\bnikah\\s*nama\\b", "(?i)\\bcertificate\\s+of\\s+registration\\s+of\\s+(birth|death|marriage)\\b", "سرٹیفکیٹ", "نکاح نامہ|نکاحنامہ")
NUMBERS = ("(?i)(?:certificate|registration|serial|reg)\\.?\\s*(?:no|number|#)\\.?\\s*[:\\-]?\\s*([A-Za-z0-9][A-Za-z0-9/\\-]{3,})", "(?:سرٹیفکیٹ|رجسٹریشن)\\s*نمبر\\s*[:\\-]?\\s*([A-Za-z0-9][A-Za-z0-9/\\-]{3,})")
KEYWORDS = {
    "BIRTH": {"certificate of birth": 3.0, "birth certificate": 3.0, "registration of birth": 3.0, "name of child": 2.0, "child's name": 2.0, "place of birth": 2.0, "time of birth": 2.0, "date of birth": 1.0, "father's name": 1.0, "mother's name": 1.0, "پیدائش کا سرٹیفکیٹ": 3.0, "برتھ سرٹیفکیٹ": 3.0, "بچے کا نام": 2.0, "جائے پیدائش": 2.0, "تاریخ پیدائش": 1.0, "والد کا نام": 1.0, "والدہ کا نام": 1.0},
    "DEATH": {"certificate of death": 3.0, "death certificate": 3.0, "registration of death": 3.0, "cause of death": 2.0, "date of death": 2.0, "place of death": 2.0, "name of deceased": 2.0, "deceased": 2.0, "age at death": 2.0, "spouse's name": 1.0, "informant": 1.0, "وفات کا سرٹیفکیٹ": 3.0, "موت کا سرٹیفکیٹ": 3.0, "تاریخ وفات": 2.0, "جائے وفات": 2.0, "متوفی": 2.0, "وجہ وفات": 2.0},
    "MARRIAGE": {"certificate of marriage": 3.0, "marriage certificate": 3.0, "nikah nama": 3.0, "nikahnama": 3.0, "registration of marriage": 3.0, "groom": 2.0, "bride": 2.0, "date of marriage": 2.0, "place of marriage": 2.0, "dower": 2.0, "mehr": 2.0, "witness": 1.0, "officiant": 1.0, "نکاح نامہ": 3.0, "نکاحنامہ": 3.0, "شادی کا سرٹیفکیٹ": 3.0, "دولہا": 2.0, "دلہن": 2.0, "حق مہر": 2.0, "تاریخ نکاح": 2.0, "گواہ": 1.0},
}


def lines(text: Column) -> Column:
    """The lines that hold more than blanks."""
    # A split by one plain character needs no regular expression; of \r\n a blank line is left, which goes.
    return F.filter(F.split(F.replace(text, F.lit("\r"), F.lit("\n")), "\n"), lambda x: F.trim(x) != "")


def heading_area(text: Column) -> Column:
    """The first lines of a page: about a third, one at least and six at most."""
    rows = lines(text)
    take = F.greatest(F.lit(1), F.least(F.lit(6), F.bround(F.size(rows) * 0.35).cast("int")))
    return F.array_join(F.slice(rows, F.lit(1), take), "\n")


def has_heading(text: Column, patterns: tuple[str, ...] = HEADINGS) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | text.rlike(p)
    return found


def printed_numbers(text: Column, patterns: tuple[str, ...] = NUMBERS) -> Column:
    """The numbers that labels announce, in order."""
    every = F.concat(*[F.regexp_extract_all(text, F.lit(p), F.lit(1)) for p in patterns])
    return F.filter(F.transform(every, lambda x: F.regexp_replace(x, "^[ .,:-]+|[ .,:-]+$", "")), lambda x: x != "")


def summaries(pages: DataFrame, headings: tuple[str, ...] = HEADINGS, numbers: tuple[str, ...] = NUMBERS) -> DataFrame:
    """(document_id, page_number, heading, number) of each page."""
    top = heading_area(F.col("text"))
    number = F.coalesce(F.get(printed_numbers(top, numbers), F.lit(0)), F.get(printed_numbers(F.col("text"), numbers), F.lit(0)))
    return pages.select("document_id", "page_number", has_heading(top, headings).alias("heading"), number.alias("number"))


def boundaries(pages: DataFrame, bookmarks: DataFrame | None = None) -> DataFrame:
    """(document_id, ordinal, page_start, page_end, method, confidence): the certificates of each document.

    Strategies in order: bookmarks, evenly spaced headings, changes of the printed
    number, the period behind irregular headings, headings as they fall, one document.
    ``pages`` comes from :func:`summaries`; a document's pages meet in one small array.
    """
    by_page = W.partitionBy("document_id").orderBy("page_number")
    changed = ~F.col("number").eqNullSafe(F.lag("number").over(by_page)) | (F.row_number().over(by_page) == 1)
    docs = pages.withColumn("changed", changed).groupBy("document_id").agg(
        F.max("page_number").alias("last"),
        F.array_sort(F.collect_set(F.when(F.col("heading"), F.col("page_number")))).alias("headings"),
        F.array_sort(F.collect_set(F.when(F.col("changed"), F.col("page_number")))).alias("changes"),
        F.bool_and(F.col("number").isNotNull()).alias("numbered"),
    )
    if bookmarks is not None:
        docs = docs.join(bookmarks.groupBy("document_id").agg(F.array_sort(F.collect_set("page_number")).alias("marks")), "document_id", "left")
    else:
        docs = docs.withColumn("marks", F.lit(None).cast("array<long>"))
    whole = lambda c: F.when((F.size(c) >= 2) & (F.get(c, F.lit(0)) == 1), c)
    inside = F.filter("marks", lambda p: (p >= 1) & (p <= F.col("last")))
    heads = whole(F.col("headings"))
    gaps = F.transform(F.slice(heads, F.lit(2), F.size(heads) - 1), lambda p, i: p - F.get(heads, i))
    even = (F.size(F.array_distinct(gaps)) == 1) & (F.get(gaps, F.lit(0)) == F.col("last") - F.element_at(heads, -1) + 1)
    stride = F.aggregate(gaps, F.lit(0).cast("long"), lambda a, b: _gcd(a, b.cast("long")))
    rhythm = (F.size(heads) >= 3) & (F.size(F.array_distinct(gaps)) > 1) & (stride >= 1) & (F.col("last") % stride == 0) & (F.floor(F.col("last") / stride) > F.size(heads))
    agreement = F.size(F.filter(gaps, lambda g: g == stride)) / F.size(gaps)
    choice = lambda starts, method, confidence: F.struct(starts.cast("array<long>").alias("starts"), F.lit(method).alias("method"), confidence.cast("double").alias("confidence"))
    single = choice(F.array(F.lit(1)), "single_document", F.when(F.col("last") == 1, 1.0).otherwise(0.6))
    picked = (
        F.when(F.col("last") == 1, single)
        .when(whole(inside).isNotNull(), choice(inside, "bookmark", F.lit(0.95)))
        .when(heads.isNotNull() & even, choice(heads, "uniform_page_count", F.lit(0.92)))
        .when(F.col("numbered") & whole(F.col("changes")).isNotNull(), choice(F.col("changes"), "serial_number", F.lit(0.88)))
        .when(heads.isNotNull() & rhythm, choice(F.sequence(F.lit(1).cast("long"), F.col("last").cast("long"), stride), "fixed_stride", F.round(0.55 + 0.15 * agreement, 2)))
        .when(heads.isNotNull(), choice(heads, "content_header", F.lit(0.85)))
        .otherwise(single)
    )
    found = docs.select("document_id", "last", picked.alias("c")).select("document_id", "last", "c.*")
    starts = found.select("document_id", "last", "method", "confidence", "starts", F.posexplode("starts").alias("ordinal", "page_start"))
    end = F.coalesce(F.get("starts", F.col("ordinal") + 1) - 1, F.col("last"))
    return starts.select("document_id", F.col("ordinal").cast("long").alias("ordinal"), F.col("page_start").cast("long").alias("page_start"), end.cast("long").alias("page_end"), "method", "confidence")


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's steps, enough for numbers of pages."""
    x, y = a, b
    pair = F.aggregate(
        F.sequence(F.lit(1), F.lit(40)),
        F.struct(x.alias("x"), y.alias("y")),
        lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), (s["x"] % F.when(s["y"] == 0, F.lit(1)).otherwise(s["y"])).alias("y"))),
    )
    return pair["x"]


def pages_of_units(units: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages with the unit that holds them: the range is unrolled, so that the join is on equal keys."""
    unrolled = units.withColumn("page_number", F.explode(F.sequence("page_start", "page_end")))
    return unrolled.join(pages, ["document_id", "page_number"])


def classify(text: Column, keywords: dict[str, dict[str, float]] = KEYWORDS, strong: float = 10.0, margin: float = 1.5, most: float = 0.98, title: Column | None = None) -> Column:
    """struct(type, confidence, top, second) by weighted phrases; those in the heading count twice.

    The first type in order wins a tie; without a clear winner the type is OTHER. ``title`` may give the
    struct(type, name) of a title that the heading holds damaged; it counts if the text doesn't hold it as it is.
    """
    return bound(F.lower(text), lambda low: _classified(low, title_lines(low), keywords, strong, margin, most, title))


def title_lines(low: Column) -> Column:
    """The top third of a text's lines, six at most; none of a text of under three lines."""
    top = lambda rows: F.slice(rows, F.lit(1), F.greatest(F.lit(1), F.least(F.lit(6), F.floor(F.size(rows) / 3).cast("int"))))
    return bound(lines(low), lambda rows: F.when(F.size(rows) >= 3, top(rows)).otherwise(F.array().cast("array<string>")))


def damaged_titles(headings: DataFrame, keywords: dict[str, dict[str, float]], least: float) -> DataFrame:
    """(_heading, _title) of different headings (heading: an array of lines): the struct(type, name) of the title most like one of their lines.

    Titles are the phrases of full weight. Of equals the one of the earlier line, then of the earlier type
    and phrase counts; lines of under eight characters don't.
    """
    titles = [(kind, name) for kind, phrases in keywords.items() for name, weight in phrases.items() if weight >= TITLE]
    rows = headings.select("heading").distinct().select("heading", F.posexplode("heading").alias("_at", "_line")).withColumn("low", F.trim("_line")).where(F.length("low") >= SHORTEST_TITLE)
    place = F.map_from_entries(F.array(*[F.struct(F.lit(n), F.lit(min(i for i, t in enumerate(titles) if t[1] == n))) for n in dict.fromkeys(n for _, n in titles)]))
    like = damaged_names(rows.select("low"), [n for _, n in titles], least, exact=True)
    best = rows.join(like, "low").groupBy("heading").agg(F.min(F.struct((-F.col("ratio")).alias("r"), "_at", F.element_at(place, F.col("name")).alias("t"))).alias("_b"))
    named = F.element_at(F.array(*[F.struct(F.lit(k).alias("type"), F.lit(n).alias("name")) for k, n in titles]), F.col("_b.t") + 1)
    return best.select(F.col("heading").alias("_heading"), named.alias("_title"))


def classified(pages: DataFrame, keywords: dict[str, dict[str, float]] = KEYWORDS, damaged: float = 85.0) -> DataFrame:
    """Adds to rows with a ``text`` the struct ``class`` of :func:`classify`, with titles as poor scans leave them.

    What a heading holds is worked out once for all texts that share it.
    """
    top = pages.withColumn("_top", title_lines(F.lower("text")))
    titled = damaged_titles(top.select(F.col("_top").alias("heading")), keywords, damaged)
    joined = top.join(titled, F.col("_top") == F.col("_heading"), "left")
    found = bound(F.lower("text"), lambda low: _classified(low, F.col("_top"), keywords, 10.0, 1.5, 0.98, F.col("_title")))
    return joined.withColumn("class", found).select(*pages.columns, "class")


def _classified(low: Column, top: Column, keywords: dict[str, dict[str, float]], strong: float, margin: float, most: float, title: Column | None) -> Column:
    heading = F.array_join(top, "\n")

    def scores(head: Column) -> Column:
        found = []
        for rank, (kind, phrases) in enumerate(keywords.items()):
            total = sum((F.when(F.contains(head, F.lit(p)), 2 * w).when(F.contains(low, F.lit(p)), w).otherwise(0.0) for p, w in phrases.items()), F.lit(0.0))
            if title is not None:
                total = total + F.when((title["type"] == kind) & ~F.contains(low, title["name"]), 2 * TITLE).otherwise(0.0)
            found.append(F.struct(total.alias("score"), F.lit(-rank).alias("rank"), F.lit(kind).alias("type")))
        return F.reverse(F.array_sort(F.array(*found)))

    return bound(bound(heading, scores), lambda ranked: _winner(ranked[0], ranked[1], strong, margin, most))


def _winner(first: Column, second: Column, strong: float, margin: float, most: float) -> Column:
    clear = (first["score"] > 0) & (first["score"] - second["score"] >= margin)
    share = first["score"] / F.when(first["score"] > 0, first["score"] + second["score"]).otherwise(F.lit(1.0))
    confidence = F.least(F.lit(most), F.round(F.least(F.lit(1.0), first["score"] / strong) * (2 * share - 1), 4))
    return F.struct(F.when(clear, first["type"]).otherwise("OTHER").alias("type"), F.when(clear, confidence).otherwise(0.0).alias("confidence"), first["score"].alias("top"), second["score"].alias("second"))
