"""What files are: kinds by their first bytes, hashes, members of archives, image frames."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Iterator
from functools import reduce

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rollkeep.sources.scratch import materialize

# First bytes of file formats.
MAGIC = (("25504446", "pdf"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("49492A00", "tiff"), ("4D4D002A", "tiff"), ("424D", "bmp"), ("474946383961", "gif"), ("474946383761", "gif"), ("504B0304", "zip"), ("504B0506", "zip"), ("D0CF11E0A1B11AE1", "ole"))
DEEPEST, LARGEST_RATIO, LARGEST_TOTAL = 3, 100.0, 5_368_709_120
#: Bytes up to which a ratio says nothing.
SMALL_ENOUGH = 1_000_000


def file_kind(content: Column, name: Column) -> Column:
    """The kind of a file by its bytes; the name only tells Office formats in an OLE file apart."""
    head = F.hex(F.substring(content, 1, 16))
    out = F.when((F.substring(head, 1, 8) == "52494646") & (F.substring(head, 17, 8) == "57454250"), "webp")
    for magic, kind in MAGIC:
        out = out.when(head.startswith(magic), kind)
    kind = out.otherwise("unknown")
    word = (kind == "zip") & (F.instr(content.cast("string"), "[Content_Types].xml") > 0) & (F.instr(content.cast("string"), "word/") > 0)
    other_office = (kind == "ole") & F.lower(name).rlike("\\.(xls|ppt|msg)$")
    return F.when(word, "docx").when(other_office, "unsupported").when(kind == "ole", "doc").otherwise(kind)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def pdf_verdict(content: Column) -> Column:
    """'none', 'encrypted', 'corrupt' or 'empty', as far as the bytes of a PDF show."""
    text = F.decode(content, "ISO-8859-1")
    return F.when(~text.startswith("%PDF-"), "corrupt").when(text.rlike("/Encrypt\\s+[0-9]+\\s+[0-9]+\\s+R"), "encrypted").when(~text.contains("%%EOF"), "corrupt").when(~text.rlike("/Type\\s*/Page[^s]"), "empty").otherwise("none")


def archive_members(files: DataFrame) -> DataFrame:
    """(id, member, bytes, content, problem): the members of ZIP files (columns id, content, depth); bad ones are reported, not fatal.

    Members are handed on one at a time, so that an archive is never unpacked whole in memory.
    """
    names = ["id", "member", "bytes", "content", "problem"]

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for i, content, depth in zip(frame["id"], frame["content"], frame["depth"], strict=True):
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        total = 0
                        for m in z.infolist():
                            total += m.file_size
                            problem = (
                                "too_deep" if depth >= DEEPEST
                                else "path" if m.filename.startswith(("/", "\\")) or ".." in m.filename.replace("\\", "/").split("/")
                                else "ratio" if m.file_size > LARGEST_RATIO * max(m.compress_size, 1)
                                else "total" if total > LARGEST_TOTAL
                                else None
                            )
                            if not m.is_dir():
                                yield pd.DataFrame([(i, m.filename, m.file_size, None if problem else z.read(m), problem)], columns=names)
                except (zipfile.BadZipFile, RuntimeError):
                    yield pd.DataFrame([(i, None, None, None, "unreadable")], columns=names)

    id_type = files.schema["id"].dataType.simpleString()
    return files.select("id", "content", "depth").mapInPandas(members, f"id {id_type}, member string, bytes long, content binary, problem string")


def _leaves(name: str) -> bool:
    """Whether a member's path leads out of the folder it is unpacked in."""
    path = name.replace("\\", "/")
    return path.startswith("/") or path[1:2] == ":" or posixpath.normpath(path).split("/")[0] == ".."


def _opened(content: bytes, depth: int, left: int) -> Iterator[tuple[str | None, int | None, bytes | None, str | None]]:
    """(member, bytes, content, problem) of an archive; one row without a member if it is refused as a whole."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            held = [m for m in z.infolist() if not m.is_dir()]
            safe = [m for m in held if not _leaves(m.filename)]
            size, packed = sum(m.file_size for m in safe), sum(max(m.compress_size, 1) for m in safe)
            refused = "too_deep" if depth >= DEEPEST else "total" if size > left else "ratio" if size > SMALL_ENOUGH and size > LARGEST_RATIO * packed else None
            if refused:
                yield None, None, None, refused
                return
            for m in held:
                yield (m.filename, m.file_size, None, "path") if _leaves(m.filename) else (posixpath.normpath(m.filename.replace("\\", "/")), m.file_size, z.read(m), None)
    except (zipfile.BadZipFile, RuntimeError, NotImplementedError, EOFError, zlib.error):
        yield None, None, None, "unreadable"


def expanded(files: DataFrame) -> DataFrame:
    """(root, path, name, depth, bytes, digest, kind, content, problem): files (id, name, content), and what their archives hold, at any depth.

    Round by round the archives found so far are opened, until none is left or the next are
    nested too deeply. ``path`` joins the names of the archives on the way and of the member by '!'. An archive is refused as a whole
    (``problem`` too_deep, total, ratio or unreadable) if it is nested too deeply, would take the members of its root over
    ``LARGEST_TOTAL`` bytes together with all found in the rounds before, or is much larger than packed; members whose path leads out
    (problem path) are passed over. An archive that was opened has no content of its own. Members are handed on one at
    a time. Null contents are unreadable archives only if their name says so; rows without archives pass through.
    """
    form = T.StructType([T.StructField("root", files.schema["id"].dataType), *[T.StructField(n, t) for n, t in (("path", T.StringType()), ("depth", T.IntegerType()), ("bytes", T.LongType()), ("content", T.BinaryType()), ("problem", T.StringType()))]])

    def opened(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                row = {n: batch.column(n)[i].as_py() for n in ("path", "depth", "content", "left")}
                for member, size, content, problem in _opened(row["content"] or b"", row["depth"], row["left"]):
                    held = [[row["path"] if member is None else f"{row['path']}!{member}"], [row["depth"] + (member is not None)], [size], [content], [problem]]
                    kinds = (pa.string(), pa.int32(), pa.int64(), pa.binary(), pa.string())
                    yield pa.RecordBatch.from_arrays([batch.column("root").slice(i, 1), *[pa.array(v, k) for v, k in zip(held, kinds, strict=True)]], names=form.names)

    def known(df: DataFrame) -> DataFrame:
        name = F.substring_index(F.substring_index("path", "!", -1), "/", -1)
        return df.withColumn("name", name).withColumn("kind", F.when(F.col("problem").isNull(), file_kind(F.coalesce("content", F.lit(b"")), name))).withColumn("digest", F.when(F.col("problem").isNull(), content_hash(F.coalesce("content", F.lit(b"")))))

    columns = ["root", "path", "name", "depth", "bytes", "digest", "kind", "content", "problem"]
    first = files.select(F.col("id").alias("root"), F.coalesce(F.col("name").cast("string"), F.lit("")).alias("path"), F.lit(0).alias("depth"), F.octet_length("content").cast("long").alias("bytes"), "content", F.lit(None).cast("string").alias("problem"))
    level = materialize(known(first).select(*columns))
    done = []
    while True:
        archives = level.where("kind = 'zip'")
        done.append(level.where("kind <> 'zip' or kind is null").unionByName(archives.withColumn("content", F.lit(None).cast("binary"))))
        if archives.isEmpty():
            return reduce(DataFrame.unionByName, done)
        taken = reduce(DataFrame.unionByName, [d.where("depth > 0 and problem is null").select("root", "bytes") for d in done]).groupBy("root").agg(F.sum("bytes").alias("taken"))
        # Each archive of a round may take what its root has left; what all took counts in the next round.
        shared = archives.join(taken.withColumnRenamed("root", "_root"), F.col("root").eqNullSafe(F.col("_root")), "left")
        left = shared.select("root", "path", "depth", "content", (F.lit(LARGEST_TOTAL) - F.coalesce("taken", F.lit(0))).alias("left"))
        level = materialize(known(left.mapInArrow(opened, form)).select(*columns))


def frames(images: DataFrame, count: str) -> DataFrame:
    """An empty page that needs OCR for each frame of an image."""
    return images.select("id", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), F.col(count)))).alias("page_number"), F.lit("").alias("text"), F.lit(True).alias("needs_ocr"))


def assembled(chunks: DataFrame, size: int) -> DataFrame:
    """(upload_id, received, complete): the contiguous bytes of each upload.

    ``chunks`` has upload_id, at, length, total; repeats of a chunk count once. A chunk
    counts if it begins at a multiple of ``size`` and all before it are there.
    """
    from pyspark.sql import Window as W

    once = chunks.where((F.col("at") % size == 0) & (F.col("length") == F.least(F.lit(size), F.col("total") - F.col("at")))).dropDuplicates(["upload_id", "at"])
    place = F.row_number().over(W.partitionBy("upload_id").orderBy("at")) - 1
    ordered = once.withColumn("whole", F.col("at") == place * size)
    return ordered.groupBy("upload_id").agg(F.sum(F.when(F.col("whole"), F.col("length")).otherwise(0)).alias("received"), F.max("total").alias("total")).select("upload_id", "received", (F.col("received") == F.col("total")).alias("complete"))
