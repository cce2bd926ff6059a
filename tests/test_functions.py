from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollkeep.functions import text as T
from rollkeep.functions import values as V
from rollkeep.functions.fuzzy import best_window, partial_ratio
from rollkeep.operators import search, split, validate
from rollkeep.plans.schema import builtin, changed_keys, draft, patched


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()[0]


@pytest.mark.parametrize("printed", ["Q/17-b.006", "q 17 B 006", "Q‐17‑B−006", "q_17b#006", "Q/۱۷/b/٠٠۶"])
def test_spellings_of_a_number_share_a_key(spark, printed):
    assert one(spark, T.number_key(F.lit(printed))) == "q17b006"


def test_key_is_bounded(spark):
    assert len(one(spark, T.number_key(F.lit("9" * 500)))) == 200


@pytest.mark.parametrize(("name", "key"), [("Zoya Rehman Begum", "zoya rehman begum"), ("Begum Zoya Rehman", "zoya rehman"), ("Prof. Haji  Omar", "omar"), ("Sardar", ""), ("", ""), (None, "")])
def test_titles_count_only_in_front(spark, name, key):
    assert one(spark, T.name_key(F.lit(name).cast("string"))) == key


def test_trigram_similarity_follows_the_formula(spark):
    assert round(one(spark, T.similarity(F.lit("muhammad"), F.lit("mohammad"))), 3) == 0.5
    assert round(one(spark, T.similarity(F.lit("ahmed"), F.lit("ahmad"))), 3) == 0.333
    assert one(spark, T.similarity(F.lit(""), F.lit(""))) == 0.0


@pytest.mark.parametrize(
    ("printed", "iso", "ambiguous", "impossible"),
    [("03-04-2019", "2019-04-03", True, False), ("12-12-2019", "2019-12-12", False, False), ("31-02-2019", None, False, True), ("2019/3/14", "2019-03-14", False, False), ("04.25.2019", "2019-04-25", False, False), ("14 March 2019", "2019-03-14", False, False), ("۱۴ مارچ ۲۰۱۹", "2019-03-14", False, False), ("March 14, 2019", "2019-03-14", False, False), ("14-03-19", "0019-03-14", False, False), ("soon", None, False, False), ("", None, False, False)],
)
def test_dates(spark, printed, iso, ambiguous, impossible):
    r = one(spark, V.read_date(F.lit(printed)))
    assert (r["iso"], r["ambiguous"], r["impossible"]) == (iso, ambiguous, impossible)


@pytest.mark.parametrize(("printed", "time"), [("4:25 pm", "16:25"), ("12.05 am", "00:05"), ("0425", "04:25"), ("25:00", None), ("noon", None)])
def test_times(spark, printed, time):
    assert one(spark, V.read_time(F.lit(printed))) == time


def test_other_values(spark):
    assert one(spark, V.read_sex(F.lit("Sex: FEMALE."))) == "female" or one(spark, V.read_sex(F.lit("a female"))) == "female"
    assert one(spark, V.format_cnic(F.lit("4410398765432"))) == "44103-9876543-2"
    assert one(spark, V.format_cnic(F.lit("441039876543"))) is None
    assert one(spark, V.read_number(F.lit("PKR 500,000"))) == "500000"
    assert one(spark, V.normalize_value("date", F.lit(" no  date "))) == "no date"


def test_normal_form(spark):
    assert one(spark, T.normalize_text(F.lit("ﬁne ​  text\n\n  co­op  "))) == "fine text\n\ncoop"
    assert one(spark, T.detect_language(F.lit("پیدائش کا"))) == "urd"
    assert one(spark, T.detect_language(F.lit("ab"))) is None


def test_best_window():
    assert best_window("date of birth", "the date of birth: 1 May") == 100.0
    assert round(best_window("mother's name", "father's name: x"), 1) == 84.6
    assert round(best_window("order", "rder: x"), 1) == 88.9


def test_partial_ratio_column(spark):
    assert one(spark, partial_ratio(F.lit("abc"), F.lit("xxabcxx"))) == 100.0


def test_merge_needs_more_than_the_margin(spark):
    layer = lambda v, c: F.struct(F.lit(v).alias("value"), F.lit(c).alias("confidence"))
    assert one(spark, validate.merged_layers(F.array(layer("a", 0.5), layer("b", 0.7))))["value"] == "a"
    assert one(spark, validate.merged_layers(F.array(layer("a", 0.5), layer("b", 0.71))))["value"] == "b"
    assert one(spark, validate.merged_layers(F.array(layer("", 0.9), layer("b", 0.1))))["value"] == "b"


def test_patch(spark):
    old = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit("2"))
    change = F.create_map(F.lit("a"), F.lit(None).cast("string"), F.lit("c"), F.lit("3"))
    assert one(spark, patched(old, change)) == {"b": "2", "c": "3"}
    assert one(spark, changed_keys(old, patched(old, change))) == ["a", "c"]


def test_draft_of_a_birth(spark):
    rows = spark.createDataFrame([({"certificate_number": "B-1", "child_name": "Ali", "date_of_birth": "2019-03-14"},), ({"child_name": "Ali"},)], "fields map<string,string>")
    got = rows.select(*[c.alias(n) for n, c in draft(builtin("BIRTH")).items()]).collect()
    assert (got[0]["number"], got[0]["primary_name"], str(got[0]["event_date"]), got[0]["fileable"]) == ("B-1", "Ali", "2019-03-14", True)
    assert not got[1]["fileable"]


def test_boundaries_by_stride(spark):
    """Twelve pages, six certificates of two pages, the headings of two lost."""
    pages = spark.createDataFrame([(1, p, "Birth Certificate" if p in (1, 3, 7, 9) else "more") for p in range(1, 13)], "document_id long, page_number long, text string")
    got = split.boundaries(split.summaries(pages)).orderBy("ordinal").collect()
    assert [(r["page_start"], r["page_end"]) for r in got] == [(1, 2), (3, 4), (5, 6), (7, 8), (9, 10), (11, 12)]
    assert got[0]["method"] == "fixed_stride" and 0.5 < got[0]["confidence"] < 0.8


def test_bookmarks_come_first(spark):
    pages = spark.createDataFrame([(1, p, "text") for p in range(1, 7)], "document_id long, page_number long, text string")
    marks = spark.createDataFrame([(1, 1), (1, 4)], "document_id long, page_number long")
    got = split.boundaries(split.summaries(pages), marks).orderBy("ordinal").collect()
    assert [(r["page_start"], r["page_end"], r["method"]) for r in got] == [(1, 3, "bookmark"), (4, 6, "bookmark")]


def test_classifier(spark):
    text = "Government\nCertificate of Birth\nName of child: A\nDate of birth: 1\nx\ny"
    c = one(spark, split.classify(F.lit(text)))
    assert c["type"] == "BIRTH" and c["confidence"] > 0.5
    assert one(spark, split.classify(F.lit("hello")))["type"] == "OTHER"


def test_deep_offsets_give_nothing(spark):
    assert search.page(spark.range(5).withColumnRenamed("id", "id").selectExpr("id", "id as event_date", "id as created_at"), offset=10_001).count() == 0
