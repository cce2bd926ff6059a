from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from rollkeep import streaming
from rollkeep.operators import export, review
from rollkeep.plans.schema import Field, Schema
from rollkeep.sources import delimited, files

SCHEMA = Schema((Field("number", "Certificate number", role="identifier", required=True), Field("name", "Full name")))


def test_sniffing():
    assert delimited.sniff_encoding(b"\xef\xbb\xbfa,b") == "utf-8-sig"
    assert delimited.sniff_encoding("a,é".encode()) == "utf-8"
    assert delimited.sniff_encoding("a,é".encode("cp1252")) == "cp1252"
    assert delimited.detect_delimiter("a;b;c,d") == ";" and delimited.detect_delimiter("abc") == ","


def test_headings():
    plan = delimited.plan_headers(SCHEMA, ["Certificate-Number", "x", "number", ""])
    assert plan.columns == ("number", None, None, None) and plan.unknown == ("x",) and plan.repeated == ("number",) and plan.missing == ()
    assert delimited.plan_headers(SCHEMA, ["full name"]).missing == ("number",)


def test_file_to_counters(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_bytes(b"\xef\xbb\xbfCertificate number;Full name\r\nA-1;\"Ali; Khan\"\r\n\r\na 1;Again\r\n;None\r\nB;b;c\r\n")
    lines, delimiter = delimited.read_lines(spark, str(path))
    rows = delimited.read_rows(lines, delimited.plan_headers(SCHEMA, ["Certificate number", "Full name"]), delimiter)
    held = {r["row_number"]: r["fields"] for r in rows.collect()}
    assert delimiter == ";" and held[2] == {"number": "A-1", "name": "Ali; Khan"} and 3 not in held
    done = delimited.outcomes(rows, "number", spark.createDataFrame([], "number_key string"))
    c = delimited.counters(done).first()
    assert (c["total"], c["created"], c["skipped"], c["failed"], c["status"]) == (4, 1, 1, 2, "PARTIAL")


def test_csv_export(spark, tmp_path):
    rows = spark.createDataFrame([("=1+1", 2.5, True), ('say "x"', None, False)], "a string, b double, c boolean").coalesce(1)
    export.write_csv(rows, str(tmp_path / "out"))
    body = next((tmp_path / "out").glob("part-*")).read_bytes().decode()
    assert body == "a,b,c\r\n'=1+1,2.50,yes\r\n\"say \"\"x\"\"\",,no\r\n"


def test_csv_in_parts(spark, tmp_path):
    export.write_csv(spark.range(0, 6, 1, 3).toDF("a,b"), str(tmp_path / "out"), bom=True, one_heading=True)
    body = b"".join(p.read_bytes() for p in sorted((tmp_path / "out").glob("part-*")))
    assert body.decode() == "\ufeff\"a,b\"\r\n" + "".join(f"{i}\r\n" for i in range(6))


def test_archives(spark):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as z:
        z.writestr("a.txt", "hello")
        z.writestr("../b.txt", "out")
    df = spark.createDataFrame([(1, buffer.getvalue(), 0), (2, b"nothing", 0)], "id long, content binary, depth int")
    got = {(r["id"], r["member"]): r["problem"] for r in files.archive_members(df).collect()}
    assert got == {(1, "a.txt"): None, (1, "../b.txt"): "path", (2, None): "unreadable"}


def packed(**members):
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in members.items():
            z.writestr(name.replace("__", "/"), content)
    return buffer.getvalue()


def test_archives_in_archives(spark, monkeypatch):
    deep = packed(**{"d.txt": "deepest"})
    for name in ("three.zip", "two.zip", "one.zip"):
        deep = packed(**{name: deep, f"beside_{name}.txt": name})
    files_ = [(1, "a.zip", packed(**{"in__b.txt": "bb", "..__x.txt": "no", "c.zip": packed(**{"e.txt": "e" * 10, "f.pdf": "%PDF-1.4"})})), (2, "deep.zip", deep), (3, "plain.txt", b"text"), (4, "bad.zip", b"PK\x03\x04nothing"), (5, "bomb.zip", packed(**{"zeros": b"\0" * 3_000_000})), (6, "none", None)]
    df = spark.createDataFrame(files_, "id long, name string, content binary")
    got = {(r["root"], r["path"]): (r["depth"], r["kind"], r["problem"]) for r in files.expanded(df).where("problem is not null or kind <> 'zip'").collect()}
    assert got == {
        (1, "a.zip!in/b.txt"): (1, "unknown", None), (1, "a.zip!../x.txt"): (1, None, "path"), (1, "a.zip!c.zip!e.txt"): (2, "unknown", None), (1, "a.zip!c.zip!f.pdf"): (2, "pdf", None),
        (2, "deep.zip!beside_one.zip.txt"): (1, "unknown", None), (2, "deep.zip!one.zip!beside_two.zip.txt"): (2, "unknown", None), (2, "deep.zip!one.zip!two.zip!beside_three.zip.txt"): (3, "unknown", None),
        (2, "deep.zip!one.zip!two.zip!three.zip"): (3, None, "too_deep"), (3, "plain.txt"): (0, "unknown", None), (4, "bad.zip"): (0, None, "unreadable"), (5, "bomb.zip"): (0, None, "ratio"), (6, "none"): (0, "unknown", None),
    }
    assert all(r["content"] is None for r in files.expanded(df).where("kind = 'zip'").collect())
    monkeypatch.setattr(files, "LARGEST_TOTAL", 2 + len(packed(**{"e.txt": "e" * 10, "f.pdf": "%PDF-1.4"})))  # enough for the first round of the first file, not for both
    held = {(r["path"]): r["problem"] for r in files.expanded(df.where("id = 1")).where("kind is null").collect()}
    assert held == {"a.zip!../x.txt": "path", "a.zip!c.zip": "total"}
    assert files.expanded(df.limit(0)).count() == 0


def test_kinds(spark):
    df = spark.createDataFrame([(b"%PDF-1.4 /Type /Page \n%%EOF",), (b"zzz",)], "c binary")
    assert [r[0] for r in df.select(files.file_kind(F.col("c"), F.lit("x"))).collect()] == ["pdf", "unknown"]
    assert [r[0] for r in df.select(files.pdf_verdict(F.col("c"))).collect()] == ["none", "corrupt"]


def test_units(spark):
    units = spark.createDataFrame([(1, 0, 1, 4), (1, 1, 5, 6)], "document_id long, ordinal long, page_start long, page_end long")
    cut = review.split_unit(units, F.lit(3)).orderBy("ordinal").collect()
    assert [(r["page_start"], r["page_end"]) for r in cut] == [(1, 2), (3, 4), (5, 6)]
    assert [(r["page_start"], r["page_end"]) for r in review.merge_units(units, F.lit(0)).collect()] == [(1, 6)]


def test_replaced_link(spark):
    links = spark.createDataFrame([(1, 10, 1, 2, "PRIMARY")], "certificate_id long, document_id long, page_start long, page_end long, state string")
    new = spark.createDataFrame([(10, 11)], "document_id long, new_document_id long")
    assert {(r["document_id"], r["state"]) for r in review.replaced(links, new).collect()} == {(10, "SUPERSEDED"), (11, "PRIMARY")}


def stream_of(spark, tmp_path, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    return spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))


def run(df, name, mode, spark, tmp_path):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return spark.table(name).collect()


def test_limiter(spark, tmp_path):
    s = stream_of(spark, tmp_path, [(1, t) for t in range(10)] + [(1, 61)], "user_id long, s long").select("user_id", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))
    got = sorted((r["ts_us"] // 1_000_000 - 1000, r["accepted"]) for r in run(streaming.limited(s, most=3), "limited", "append", spark, tmp_path))
    assert [t for t, ok in got if ok] == [0, 1, 2, 61]


def test_progress(spark, tmp_path):
    s = stream_of(spark, tmp_path, [(1, True), (1, False), (2, True)], "batch_id long, finished boolean")
    got = {r["batch_id"]: r["percent"] for r in run(streaming.progress_changes(s), "progress", "update", spark, tmp_path)}
    assert got == {1: 50.0, 2: 100.0}


def test_first_uploads(spark, tmp_path):
    s = stream_of(spark, tmp_path, [(1, "a", 1), (1, "a", 2), (2, "a", 3)], "batch_id long, sha256 string, s long").withColumn("ts", F.timestamp_seconds("s"))
    assert len(run(streaming.first_uploads(s), "uploads", "append", spark, tmp_path)) == 2


def test_import_folder(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("Full name;Certificate number\r\n# guidance;required\r\nAli;A-1\r\n# not guidance;A-2;more\r\n")
    (folder / "b.csv").write_text("Certificate number,note\nB-1,x\n")
    (folder / "empty.csv").write_text("")  # Spark passes over files without bytes
    (folder / "head.csv").write_text("Full name\n")
    go = lambda: streaming.import_folder(spark, str(folder), SCHEMA, str(tmp_path / "out"), str(tmp_path / "cp"), refuse=False)
    go()
    rows = spark.read.parquet(str(tmp_path / "out/rows"))
    assert sorted((r["row_number"], r["fields"], r["too_many"]) for r in rows.collect()) == [
        (2, '{"number":"B-1"}', False),
        (3, '{"name":"Ali","number":"A-1"}', False),
        (4, '{"name":"# not guidance","number":"A-2"}', True),
    ]
    told = {r["path"][-5:]: (r["total"], r["unknown"], r["missing"]) for r in spark.read.parquet(str(tmp_path / "out/files")).collect()}
    assert told == {"a.csv": (2, [], []), "b.csv": (1, ["note"], []), "d.csv": (0, [], ["number"])}
    (folder / "c.csv").write_text("number\nC-1\nB 1\n")
    go()
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 5
    last = spark.read.parquet(str(tmp_path / "out/files")).where("path like '%c.csv'").first()
    assert (last["total"], last["created"], last["skipped"], last["failed"], last["status"]) == (2, 1, 1, 0, "PARTIAL")


def test_import_folder_delivers_a_batch_again(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "a.csv").write_text("number,full name\nA-1,\"two\nlines\"\nA-2,x\n")
    held = lambda: sorted((r["row_number"], r["fields"], r["outcome"]) for r in spark.read.parquet(str(tmp_path / "out/rows")).collect())
    go = lambda cp: streaming.import_folder(spark, str(folder), SCHEMA, str(tmp_path / "out"), str(tmp_path / cp), register=lambda s: s.createDataFrame([("a2",)], "number_key string"))
    go("cp")
    once = held()
    assert once == [(2, '{"number":"A-1","name":"two\\nlines"}', "created"), (3, '{"number":"A-2","name":"x"}', "skipped")]
    go("another")  # without the first checkpoint the batch comes again
    assert held() == once


def batches(spark, folder, parts, schema):
    """A stream that gives one part at a time."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder / f"in/part={i}"))
    return spark.readStream.schema(schema + ", part int").option("maxFilesPerTrigger", 1).parquet(str(folder / "in"))


def test_completions_equal_the_batch_closure(spark, tmp_path):
    # document, page, pages, failed, second; the third document never gets its page 2, the fourth too late.
    parts = [
        [(1, 1, 2, False, 0), (2, 1, 1, True, 10), (3, 1, 2, False, 20), (1, 1, 2, False, 30), (4, 1, 2, True, 40)],
        [(1, 2, 2, False, 60), (2, 1, 1, False, 70), (5, 1, 1, False, 80)],
        [(6, 1, 1, False, 90_000)],
        [(6, 1, 1, False, 90_010)],
        [(7, 1, 1, False, 90_020)],
    ]
    s = batches(spark, tmp_path, parts, "document_id long, page_number long, pages long, failed boolean, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    got = run(streaming.completions(s), "completions", "append", spark, tmp_path)
    told = {r["document_id"]: (r["status"], r["pages"], r["failed"], r["missing"]) for r in got}
    assert len(told) == len(got) and told == {1: ("COMPLETED", 2, 0, 0), 2: ("COMPLETED_WITH_ERRORS", 1, 1, 0), 3: ("TIMED_OUT", 1, 0, 1), 4: ("TIMED_OUT", 1, 1, 1), 5: ("COMPLETED", 1, 0, 0), 6: ("COMPLETED", 1, 0, 0), 7: ("COMPLETED", 1, 0, 0)}
    from rollkeep.operators.counts import closure

    pages = spark.createDataFrame([(d, bad, p < n and d in (3, 4)) for part in parts for d, p, n, bad, _ in part], "document_id long, failed boolean, open boolean")
    in_one = {r["document_id"]: r["status"] for r in closure(pages.where("document_id <> 2 or failed"), "document_id", "open", "failed").collect()}
    assert {d: s for d, (s, *_) in told.items() if s != "TIMED_OUT"} == {d: s for d, s in in_one.items() if s != "OPEN"}


def test_closed_documents_ignore_late_pages_and_lose_their_state(spark, tmp_path):
    hour = 3600
    parts = [[(1, 1, 1, False, 0)], [(1, 2, 2, True, 60)], [(9, 1, 2, False, 3 * hour)], [(9, 1, 2, False, 3 * hour + 1)], [(9, 2, 2, False, 3 * hour + 2)]]
    s = batches(spark, tmp_path, parts, "document_id long, page_number long, pages long, failed boolean, s long").withColumn("ts", F.timestamp_seconds(F.col("s") + 1000))
    q = streaming.completions(s).writeStream.outputMode("append").format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r["document_id"], r["status"]) for r in spark.table("late").collect()) == [(1, "COMPLETED"), (9, "COMPLETED")]
    assert q.lastProgress.stateOperators[0].numRowsTotal == 1  # document 9's mark only


def test_limiter_judges_by_time_and_forgets(spark, tmp_path):
    parts = [[(1, 30), (1, 0), (1, 20), (1, 10)], [(2, 5000)], [(2, 5001)], [(2, 5002)]]
    s = batches(spark, tmp_path, parts, "user_id long, s long").select("user_id", F.timestamp_seconds(F.col("s") + 1000).alias("ts"))
    q = streaming.limited(s, most=2).writeStream.outputMode("append").format("memory").queryName("limits").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted(r["ts_us"] // 1_000_000 - 1000 for r in spark.table("limits").where("accepted and user_id = 1").collect()) == [0, 10]
    assert q.lastProgress.stateOperators[0].numRowsTotal == 1


def test_numbers_are_rounded_by_their_exact_value(spark):
    held = [0.125, 1.005, 2.675, -0.005, -0.0, 4.5, None, 1e23, -12.345]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(held)], "i int, x double")
    got = [r["x"] for r in sorted(export.cells(rows).collect(), key=lambda r: int(r["i"]))]
    assert got == ["0.12", "1.00", "2.67", "'-0.01", "-0.00", "4.50", "", "99999999999999991611392.00", "'-12.35"]
