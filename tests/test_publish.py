from __future__ import annotations

import io
import random
import xml.etree.ElementTree as ET
import zipfile

from pyspark.sql import functions as F

from rollkeep.operators import export, extract, publish
from rollkeep.sources import delimited, readers


def by_hand(rows, register):
    """Rows in order, each looking at what is kept so far."""
    numbers, others = {n for n, _ in register}, {r for _, r in register if r}
    gone = set()
    for i, n, r in sorted(rows):
        if n in numbers or n in others or (r and r in others):
            gone.add(i)
        else:
            numbers.add(n)
            others |= {r} - {""}
    return gone


def test_second_numbers_depend_on_what_is_kept(spark):
    rng = random.Random(5)
    for size in (0, 1, 60):
        rows = [(i + 2, f"a{rng.randrange(25)}" if i % 3 else "hot", rng.choice(["", f"a{rng.randrange(25)}", f"b{rng.randrange(9)}"])) for i in range(size)]
        register = [("a3", "b1"), ("z", "")]
        df = spark.createDataFrame(rows, "row_number long, number_key string, registration_key string")
        reg = spark.createDataFrame(register, "number_key string, registration_key string")
        got = [r[0] for r in delimited.repeated_numbers(df, reg).collect()]
        assert sorted(got) == sorted(by_hand(rows, register))


def test_outcomes_by_policy(spark):
    rows = spark.createDataFrame([(2, {"n": "A1"}, False), (3, {"n": "a-1"}, False), (4, {}, False), (5, {"n": "B"}, True)], "row_number long, fields map<string,string>, too_many boolean")
    register = spark.createDataFrame([], "number_key string")
    code = lambda policy: {r["row_number"]: (r["outcome"], r["code"]) for r in delimited.outcomes(rows, "n", register, policy).collect()}
    bad = {4: ("failed", "missing_identifier"), 5: ("failed", "extra_columns")}
    assert code("skip") == {2: ("created", None), 3: ("skipped", "duplicate_number")} | bad
    assert code("record") == {2: ("created", None), 3: ("created", None)} | bad


def test_cells_to_the_right(spark):
    cells = [(1, "f", p, 0, r, c, t) for p, r, c, t in ((1, 0, 0, "Name:"), (1, 0, 1, " "), (1, 0, 2, " Ada "), (1, 1, 0, "Number"), (1, 1, 1, "none"), (2, 0, 0, "Reg. NUMBER"), (2, 0, 1, "no 17/4"), (2, 1, 0, "number"), (2, 1, 1, "99"))]
    df = spark.createDataFrame(cells, "document_id long, fingerprint string, page_number int, table int, row int, column int, text string")
    rules = spark.createDataFrame([("f", "name", "name", None), ("f", "number", "Number", "[0-9]+/[0-9]+"), ("f", "age", "age", None)], "fingerprint string, field string, anchor string, pattern string")
    assert {(r["field"], r["value"]) for r in extract.applied_cells(df, rules).collect()} == {("name", "Ada"), ("number", "17/4")}


def test_workbooks_hold_all_rows(spark):
    rows = spark.range(0, 25, 1, 2).select("id", F.concat(F.lit("=<&\x01>"), F.col("id").cast("string")).alias("text"), (F.col("id") % 5 == 0).alias("flag"))
    books = export.workbooks(rows, "flag", most=10).collect()
    assert sorted(b["n_rows"] for b in books) == [2, 3, 10, 10]
    seen, tinted = [], 0
    for b in books:
        sheet = ET.fromstring(zipfile.ZipFile(io.BytesIO(b["content"])).read("xl/worksheets/sheet1.xml"))
        lines = [[c.findtext(".//{*}t") for c in r] for r in sheet.iter("{*}row")] or [[c.findtext(".//{*}t") for c in r] for r in sheet.iter(f"{{{export._SHEETS}}}row")]
        assert lines[0] == ["id", "text"]
        seen += lines[1:]
        tinted += sum(r[0].get("s") == "2" for r in sheet.iter(f"{{{export._SHEETS}}}row"))
    assert sorted(seen) == sorted([str(i), f"'=<&>{i}"] for i in range(25))
    assert tinted == 5


def test_pages_by_an_engine(spark):
    files = spark.createDataFrame([(1, b"one|two"), (2, b"\xff"), (3, b"")], "id long, content binary")
    got = {(r[0], r[1]): (r[2], r[3]) for r in readers.pages_with(files, lambda b: bytes(b).decode().split("|")).collect()}
    assert got == {(1, 1): ("one", None), (1, 2): ("two", None), (2, 1): ("", "UnicodeDecodeError"), (3, 1): ("", None)}


def test_cursors_that_are_not_ours(spark):
    df = spark.createDataFrame([("?",), ("aGVsbG8=",), (None,)], "c string")
    assert [r[0] for r in df.select(publish.read_cursor(F.col("c"))).collect()] == [None, None, None]
