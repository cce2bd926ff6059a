from __future__ import annotations

import io
import zipfile

from pyspark.sql import functions as F

from rollkeep.plans.schema import builtin
from rollkeep.sources import delimited, readers

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def test_word_pages(spark):
    body = f'<w:document {NS}><w:body><w:p><w:r><w:t>One</w:t></w:r><w:r><w:br w:type="page"/><w:t>Two</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>a</w:t></w:r></w:p></w:tc><w:tc><w:p><w:r><w:t>b</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", body)
        z.writestr("word/header1.xml", f"<w:hdr {NS}><w:p><w:r><w:t>Top</w:t></w:r></w:p></w:hdr>")
    got = readers.docx_pages(spark.createDataFrame([(1, out.getvalue()), (2, b"x")], "id long, content binary")).orderBy("document_id", "page_number").collect()
    assert [(r["document_id"], r["page_number"], r["text"]) for r in got] == [(1, 1, "Top\nOne"), (1, 2, "Top\nTwo\na   b"), (2, 1, "")]


def test_safe_names(spark):
    names = ["../a/b?.pdf", "C:\\x\\con.txt", "...", "ok name-1.csv"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(readers.safe_name(F.col("n"))).collect()]
    assert got == ["b_.pdf", "_con.txt", "file", "ok name-1.csv"]


def test_import_template():
    head, guide, _ = delimited.import_template(builtin("OTHER")).split("\r\n")
    assert head.startswith("Certificate number,") and guide.startswith("# required,")
