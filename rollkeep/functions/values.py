"""Printed values to canonical ones: dates, times, sex, identity numbers, quantities."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rollkeep.functions.text import bound, normalize_text, western_digits

MALE = "m male boy man مرد لڑکا نر".split()
FEMALE = "f female girl woman عورت لڑکی خاتون مادہ".split()
MONTHS = {"january": 1, "february": 2, "march": 3, "april": 4, "may": 5, "june": 6, "july": 7, "august": 8, "september": 9, "october": 10, "november": 11, "december": 12, "جنوری": 1, "فروری": 2, "مارچ": 3, "اپریل": 4, "مئی": 5, "جون": 6, "جولائی": 7, "اگست": 8, "ستمبر": 9, "اکتوبر": 10, "نومبر": 11, "دسمبر": 12}
CNIC = "^[0-9]{5}-[0-9]{7}-[0-9]$"


def plain(text: Column) -> Column:
    return western_digits(normalize_text(F.coalesce(text, F.lit(""))))


def _iso(year: Column, month: Column, day: Column) -> Column:
    """The date as ISO text, or null if there is no such day."""
    text = F.concat_ws("-", F.lpad(year, 4, "0"), F.lpad(month, 2, "0"), F.lpad(day, 2, "0"))
    return F.when(year.try_cast("int") >= 1, F.date_format(F.try_to_date(text, "yyyy-MM-dd"), "yyyy-MM-dd"))


def read_date(printed: Column, normal: bool = False) -> Column:
    """struct(iso, ambiguous, impossible) of a printed date; ``normal`` texts aren't normalised again.

    All-digit dates are read day first, or year first if the first part exceeds 31; month
    first only where day first is no date. Dates with a month's name, English or Urdu (in
    full or by its first three letters), need day, month and year. Years stay as printed.
    """
    text = F.trim(F.coalesce(printed, F.lit("")) if normal else plain(printed))
    return bound(text, _date_of)


def _date_of(text: Column) -> Column:
    shape = "^\\s*([0-9]{1,4})\\s*[-/.]\\s*([0-9]{1,2})\\s*[-/.]\\s*([0-9]{1,4})\\s*$"
    names = "|".join(sorted({*MONTHS, *(m[:3] for m in MONTHS if m.isascii())}, key=len, reverse=True))
    lookup = F.create_map(*[F.lit(x) for k, v in ({m[:3]: n for m, n in MONTHS.items() if m.isascii()} | MONTHS).items() for x in (k, str(v))])
    word = f"^([0-9]{{1,2}})(?:st|nd|rd|th)?[\\s,.-]+({names})[\\s,.-]+([0-9]{{4}})$"
    back = f"^({names})[\\s.-]+([0-9]{{1,2}})(?:st|nd|rd|th)?[\\s,.-]+([0-9]{{4}})$"
    low = F.lower(text)
    named = F.when(low.rlike(word), _iso(F.regexp_extract(low, word, 3), F.try_element_at(lookup, F.regexp_extract(low, word, 2)), F.regexp_extract(low, word, 1))).when(
        low.rlike(back), _iso(F.regexp_extract(low, back, 3), F.try_element_at(lookup, F.regexp_extract(low, back, 1)), F.regexp_extract(low, back, 2))
    )

    def of_digits(p: Column) -> Column:
        a, b, c = p["a"], p["b"], p["c"]
        year_first = F.coalesce(a.try_cast("int"), F.lit(0)) > 31
        readings = F.struct(_iso(a, b, c).alias("y"), _iso(c, b, a).alias("d"), _iso(c, a, b).alias("m"))

        def chosen(r: Column) -> Column:
            iso = F.when(year_first, r["y"]).otherwise(F.coalesce(r["d"], r["m"]))
            both = ~year_first & r["d"].isNotNull() & r["m"].isNotNull() & (a.try_cast("int") != b.try_cast("int"))
            return F.struct(iso.alias("iso"), F.coalesce(both, F.lit(False)).alias("ambiguous"), iso.isNull().alias("impossible"))

        return bound(readings, chosen)

    digits = bound(F.struct(*[F.regexp_extract(text, shape, i).alias(n) for i, n in enumerate("abc", 1)]), of_digits)
    return F.when(text.rlike(shape), digits).otherwise(F.struct(named.alias("iso"), F.lit(False).alias("ambiguous"), F.lit(False).alias("impossible")))


def read_time(printed: Column) -> Column:
    """A printed time as HH:MM, or null."""
    text = plain(printed)
    shape = "(?i)([0-9]{1,2})\\s*[:.]\\s*([0-9]{2})\\s*(am|pm|a\\.m\\.|p\\.m\\.)?|([01][0-9]|2[0-3])([0-5][0-9])\\b"
    h, m, half, bare_h, bare_m = (F.regexp_extract(text, shape, i) for i in (1, 2, 3, 4, 5))
    half = F.replace(F.lower(half), F.lit("."), F.lit(""))
    hour = h.try_cast("int")
    hour = F.when((half == "pm") & (hour < 12), hour + 12).when((half == "am") & (hour == 12), 0).otherwise(hour)
    valid = hour.between(0, 23) & m.try_cast("int").between(0, 59)
    clock = F.when(valid, F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), m))
    return F.when(bare_h != "", F.concat(bare_h, F.lit(":"), bare_m)).otherwise(clock)


def read_sex(printed: Column, normal: bool = False) -> Column:
    """'male' or 'female' by the first word that says so: the whole text, then each word."""
    text = F.regexp_replace(F.trim(F.lower(F.coalesce(printed, F.lit("")) if normal else normalize_text(F.coalesce(printed, F.lit(""))))), "^\\.+|\\.+$", "")
    words = F.concat(F.array(text), F.split(text, "\\s+"))
    known = F.array(*[F.lit(w) for w in MALE + FEMALE])
    first = F.get(F.filter(words, lambda w: F.array_contains(known, w)), F.lit(0))
    return F.when(first.isin(MALE), "male").when(first.isin(FEMALE), "female")


def format_cnic(printed: Column) -> Column:
    """An identity number as 5-7-1 digits, or null."""
    text = F.trim(plain(printed))
    digits = F.regexp_replace(text, "[^0-9]", "")
    return F.when(text.rlike(CNIC), text).when(F.length(digits) == 13, F.regexp_replace(digits, "^([0-9]{5})([0-9]{7})([0-9])$", "$1-$2-$3"))


def read_number(printed: Column) -> Column:
    """The first quantity without thousands commas, or null."""
    found = F.regexp_extract(plain(printed), "(-?[0-9][0-9,]*(?:\\.[0-9]+)?)", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")))


def normalize_value(kind: str, printed: Column) -> Column:
    """The canonical form of a value of a field kind; what can't be read stays as printed, trimmed."""
    text = normalize_text(F.coalesce(printed, F.lit("")))
    reader = {"date": lambda c: read_date(c)["iso"], "time": read_time, "sex": read_sex, "id_number": format_cnic, "number": read_number}.get(kind)
    return F.coalesce(reader(printed), text) if reader else text


def age_in_years(birth: Column, day: Column) -> Column:
    """Whole years from birth to day by calendar date."""
    before = (F.month(day) < F.month(birth)) | ((F.month(day) == F.month(birth)) & (F.dayofmonth(day) < F.dayofmonth(birth)))
    return F.year(day) - F.year(birth) - before.cast("int")
