"""Word documents to page texts, and names under which files may be kept."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
# Names that some systems keep for devices.
RESERVED = "(?i)^(con|prn|aux|nul|com[1-9]|lpt[1-9])(\\..*)?$"


def safe_name(name: Column, longest: int = 120) -> Column:
    """The last component of a path with unsafe characters replaced; never empty or a device name."""
    last = F.regexp_extract(F.replace(name, F.lit("\\"), F.lit("/")), "([^/]*)$", 1)
    plain = F.regexp_replace(F.regexp_replace(last, "[^\\p{L}\\p{N}._ -]", "_"), "^[. ]+|[. ]+$", "")
    kept = F.substring(F.when(plain.rlike(RESERVED), F.concat(F.lit("_"), plain)).otherwise(plain), 1, longest)
    return F.when(kept == "", "file").otherwise(kept)


def _paragraph(p: ET.Element) -> list[str]:
    """The text of a paragraph, cut at page breaks."""
    parts = [""]
    for e in p.iter():
        if e.tag == _W + "t":
            parts[-1] += e.text or ""
        elif e.tag in (_W + "tab", _W + "cr") or e.tag == _W + "br" and e.get(_W + "type") != "page":
            parts[-1] += " "
        elif e.tag == _W + "br":
            parts.append("")
    return parts


def _body(root: ET.Element) -> list[list[str]]:
    """Lines by page: paragraphs, and table rows with three blanks between cells."""
    pages: list[list[str]] = [[]]
    for block in root:
        if block.tag == _W + "p":
            first, *more = _paragraph(block)
            pages[-1].append(first)
            pages += [[m] for m in more]
        elif block.tag == _W + "tbl":
            for row in block.iter(_W + "tr"):
                pages[-1].append("   ".join(" ".join("".join(_paragraph(p)) for p in cell.iter(_W + "p")).strip() for cell in row.findall(_W + "tc")))
    return pages


def docx_texts(content: bytes) -> list[str]:
    """The text of each page: headers, body and footers; what can't be read is one empty page."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            edge = lambda kind: [line for n in sorted(z.namelist()) if n.startswith(f"word/{kind}") and n.endswith(".xml") for page in _body(ET.fromstring(z.read(n))) for line in page]
            top, bottom = edge("header"), edge("footer")
            body = ET.fromstring(z.read("word/document.xml")).find(_W + "body")
            return ["\n".join(x for x in [*top, *page, *bottom] if x.strip()) for page in _body(body)]
    except (zipfile.BadZipFile, KeyError, ET.ParseError, TypeError):
        return [""]


def docx_pages(files: DataFrame) -> DataFrame:
    """(document_id, page_number, text) of Word files with columns id and content; a file is read by one task."""
    kind = files.schema["id"].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, content in zip(frame["id"], frame["content"], strict=True):
                texts = docx_texts(content)
                yield pd.DataFrame({"document_id": [i] * len(texts), "page_number": range(1, len(texts) + 1), "text": texts})

    return files.select("id", "content").mapInPandas(read, f"document_id {kind}, page_number long, text string")


def pages_with(files: DataFrame, engine: Callable[[bytes], Iterable[str]]) -> DataFrame:
    """(document_id, page_number, text, problem) of files (columns id, content) by an engine of the caller's.

    ``engine`` turns the bytes of one file into page texts: a PDF reader, a converter or OCR.
    A file that it can't read is one empty page with the name of the error, not a failure.
    """
    kind = files.schema["id"].dataType.simpleString()

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, content in zip(frame["id"], frame["content"], strict=True):
                try:
                    texts, problem = [str(t) for t in engine(content)] or [""], None
                except Exception as e:  # noqa: BLE001 - whatever the engine raises belongs to this file
                    texts, problem = [""], type(e).__name__
                yield pd.DataFrame({"document_id": [i] * len(texts), "page_number": range(1, len(texts) + 1), "text": texts, "problem": [problem] * len(texts)})

    return files.select("id", "content").mapInPandas(read, f"document_id {kind}, page_number long, text string, problem string")


def newest_rules(rules: DataFrame) -> DataFrame:
    """One rule for each template and field: the newest."""
    newest = rules.groupBy("template_id", "field").agg(F.max("created_at").alias("created_at"))
    return rules.join(newest, ["template_id", "field", "created_at"])
