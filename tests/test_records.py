"""Records with line breaks in quoted cells, against Python's csv module, however the files are cut into blocks."""

from __future__ import annotations

import csv
import io
import random
import re

import pytest
from pyspark.sql import functions as F

from rollkeep.plans.schema import Field, Schema
from rollkeep.sources import delimited, records

SCHEMA = Schema((Field("number", "Certificate number", role="identifier", required=True), Field("name", "Full name")))
CELLS = ["", "x", '5" pipe', ' "q"', '"a"b', "é ß", '""', '"x""y"', '"one\ntwo"', '"\n\n"', '"a""\n, b"', '","', '"tail"x"y', 'z"', '"""\n"""', " spaced "]


@pytest.fixture
def small_blocks(spark):
    kept = {k: spark.conf.get(k, None) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield lambda size: spark.conf.set("spark.sql.files.maxPartitionBytes", f"{size}b")
    for k, v in kept.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(folder, n, seed):
    """n files of all delimiters, line ends and encodings, and their rows as Python reads them."""
    rng, want = random.Random(seed), {}
    for i in range(n):
        d, nl, encoding = rng.choice(",;\t|"), rng.choice(("\n", "\r\n")), rng.choice(("utf-8", "utf-8-sig", "cp1252"))
        body = "".join(d.join(rng.choice(CELLS).replace(",", d).replace("\n", nl) for _ in range(rng.randrange(1, 5))) + nl for _ in range(25))
        body += rng.choice(("", '"open' + nl + "to the end" + nl, "no line end", '"no line end"'))
        path = folder / f"f{i:02}.csv"
        path.write_bytes((f"a{d}b{d}c{nl}" + body).encode(encoding))
        want[path.name] = [[c.strip() for c in r] or [""] for r in csv.reader(io.StringIO(body, newline=""), delimiter=d)]
    return want


@pytest.mark.parametrize("size", [61, 400, 1 << 20])
def test_reads_as_pythons_csv(spark, tmp_path, small_blocks, size):
    want = written(tmp_path, 12, size)
    small_blocks(size)
    held, heads = records.read_records(spark, str(tmp_path))
    joined = held.join(heads, "path").select(F.substring_index("path", "/", -1).alias("name"), "row_number", delimited.cells_of(F.col("record"), F.col("delimiter")).alias("cells"))
    got = {}
    for r in joined.orderBy("name", "row_number").collect():
        got.setdefault(r["name"], []).append((r["row_number"], r["cells"]))
    assert {k: [c for _, c in v[1:]] for k, v in got.items()} == want
    assert all([n for n, _ in v] == list(range(1, len(v) + 1)) for v in got.values())
    if size == 61:
        assert records.raw_lines(spark, str(tmp_path)).select("path", "block").distinct().count() > 60


def test_a_quote_that_is_never_closed_is_cut(spark, tmp_path):
    line = "y" * 999
    (tmp_path / "a.csv").write_text('h,i\n1,"open\n' + f"{line}\n" * 2000)
    got = records.read_records(spark, str(tmp_path / "a.csv"))[0].orderBy("row_number").collect()
    assert len(got) == 2 and got[1]["record"].startswith('1,"open\n') and records.LONGEST_RECORD <= len(got[1]["record"]) <= records.LONGEST_RECORD + 1000


def test_long_cells_and_many_quotes(spark):
    cells = ['"' + 'a""' * 20000 + '"', '"' + "b" * 60000 + '"', "c" * 60000]
    got = spark.createDataFrame([(",".join(cells),)], "line string").select(delimited.cells_of(F.col("line"), F.lit(","))).first()[0]
    assert got == ['a"' * 20000, "b" * 60000, "c" * 60000]


def test_rows_of_records(spark):
    lines = [(1, "h"), (2, ',"# guide"'), (3, " , "), (4, '"A\n1", x'), (5, "B,y,z"), (6, "C"), (7, "D," + "v" * 5000), (8, "#E,w")]
    plan = delimited.plan_headers(SCHEMA, ["number", "full name"])
    got = {r["row_number"]: (r["fields"], r["too_many"], r["too_few"], r["oversized"]) for r in delimited.read_rows(spark.createDataFrame(lines, "row_number long, line string"), plan).collect()}
    assert got == {
        4: ({"number": "A\n1", "name": "x"}, False, False, False), 5: ({"number": "B", "name": "y"}, True, False, False), 6: ({"number": "C"}, False, True, False),
        7: ({"number": "D", "name": "v" * 4000}, False, False, True), 8: ({"number": "#E", "name": "w"}, False, False, False),
    }


def test_files_together(spark, tmp_path):
    (tmp_path / "a.csv").write_text('number,full name\nA-1,"x\ny"\na1,again\n,none\nB,b\n')
    (tmp_path / "b.csv").write_text("Full name;Certificate number\nz;b\nz;C\n")
    for name, head in (("c", "number,note\n"), ("d", "full name\n"), ("e", "number,Certificate number\n"), ("f", "number\n")):
        (tmp_path / f"{name}.csv").write_text(head + ("" if name == "f" else "D,1\n"))
    rows, files = delimited.import_files(spark, str(tmp_path), SCHEMA, spark.createDataFrame([("c",)], "number_key string"))
    name = F.substring_index("path", "/", -1)
    assert [tuple(r) for r in rows.orderBy("path", "row_number").select(name, "row_number", "outcome", "code").collect()] == [
        ("a.csv", 2, "created", None), ("a.csv", 3, "skipped", "duplicate_number"), ("a.csv", 4, "failed", "missing_identifier"), ("a.csv", 5, "created", None),
        ("b.csv", 2, "skipped", "duplicate_number"), ("b.csv", 3, "skipped", "duplicate_number"),
    ]
    told = [tuple(r) for r in files.orderBy("path").select(name, "delimiter", "failure", "total", "created", "skipped", "failed", "status").collect()]
    assert told == [
        ("a.csv", ",", None, 4, 2, 1, 1, "PARTIAL"), ("b.csv", ";", None, 2, 0, 2, 0, "PARTIAL"), ("c.csv", ",", "unknown_columns", 0, 0, 0, 0, "FAILED"),
        ("d.csv", ",", "missing_columns", 0, 0, 0, 0, "FAILED"), ("e.csv", ",", "duplicate_columns", 0, 0, 0, 0, "FAILED"), ("f.csv", ",", None, 0, 0, 0, 0, "COMPLETED"),
    ]
    kept, _ = delimited.import_files(spark, str(tmp_path), SCHEMA, spark.createDataFrame([], "number_key string"), on_duplicate="record", refuse=False)
    assert kept.where("outcome = 'created'").count() == 7


def test_lines_of_a_file_do_not_meet_in_one_task(spark, monkeypatch):
    lines = spark.createDataFrame([("f", b, i, f"{b},{i}", ",") for b in range(4) for i in range(3)], "path string, block long, at long, line string, delimiter string")
    seen, kept = [], records.materialize
    monkeypatch.setattr(records, "materialize", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert [r["record"] for r in records.records(lines).orderBy("row_number").collect()] == [f"{b},{i}" for b in range(4) for i in range(3)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert len(re.findall(r"Exchange hashpartitioning\(path#\d+, \d+\)", seen[0])) == 1  # of the heading's place only
