from __future__ import annotations

import pytest

from rollkeep.functions.fuzzy import best_window, damaged_place
from rollkeep.operators import extract

LABELS = {"child": ("name of child", "name", "بچے کا نام"), "sex": ("sex", "جنس"), "born": ("date of birth",)}


def read(spark, text, damaged=None, ocr=None):
    lines = extract.lines_of(spark.createDataFrame([(1, 1, text)], "document_id long, page_number long, text string"))
    if ocr is not None:
        lines = lines.selectExpr("*", f"{ocr}D as ocr_confidence")
    return {r["field"]: (r["value"], r["confidence"]) for r in extract.labelled(lines, LABELS, {"born": "date"}, damaged).collect()}


def test_damaged_place():
    assert damaged_place("name of child", "name 0f child: x", 85.0) == (0, 13, pytest.approx(12 / 13))
    assert damaged_place("name of child", "something else", 85.0) is None
    assert damaged_place("abcd", "", 85.0) is None
    for name, line in (("date of birth", "xx dale of birlh 1 may"), ("sex", "se"), ("name", "mean mane nane")):
        place, best = damaged_place(name, line, 60.0), best_window(name, line)
        assert (place is None and best < 60) or round(place[2] * 100, 6) == round(best, 6)


def test_damaged_labels(spark):
    text = "Name 0f Child: Omar Sheikh\nDate of B1rth: 14-03-2018"
    assert read(spark, text)["child"] == ("0f Child: Omar Sheikh", 0.85)
    got = read(spark, text, damaged=85.0)
    assert got["born"] == ("14-03-2018", round(12 / 13, 4))
    # An undamaged label comes first among lines; on one line what explains most counts.
    assert got["child"] == ("Omar Sheikh", round(12 / 13, 4))


def test_other_script_is_stepped_over(spark):
    assert read(spark, "Sex / جنس لڑکی")["sex"] == ("لڑکی", 1.0)


def test_next_line_is_no_label(spark):
    assert "child" not in read(spark, "Name of child\nDate of birth: 1-2-2019")
    assert read(spark, "Name of child\nOmar Sheikh")["child"] == ("Omar Sheikh", 0.8)


def test_scans_are_less_sure(spark):
    assert read(spark, "Name of child: Omar", ocr=50.0)["child"] == ("Omar", 0.8)


def test_other_script_is_stepped_over_when_damaged(spark):
    assert read(spark, "Name of child / بچے کا نا۔ علی", damaged=85.0)["child"] == ("علی", 1.0)
    assert read(spark, "Date f birth\n14-03-2018", damaged=85.0)["born"] == ("14-03-2018", round(0.8 * 22 / 24, 4))
