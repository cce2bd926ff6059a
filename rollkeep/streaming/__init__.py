"""Structured Streaming forms: de-duplication, progress, limits, windows, imports."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from rollkeep.plans.schema import Schema
from rollkeep.sources.delimited import import_files
from rollkeep.sources.scratch import materialize


def first_uploads(stream: DataFrame, within: str = "48 hours") -> DataFrame:
    """The first upload of the same bytes in a batch; state is dropped once the watermark passes."""
    return stream.withWatermark("ts", within).dropDuplicatesWithinWatermark(["batch_id", "sha256"])


def progress_changes(stream: DataFrame, idle: str = "1 hour") -> DataFrame:
    """(batch_id, done, total, percent) whenever a batch's percent changes.

    The state is two counters a batch, and goes when nothing of the batch has come for ``idle``; what comes later counts from nought.
    """
    wait = _milliseconds(idle)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        done, total, said = state.get if state.exists else (0, 0, -1.0)
        for f in frames:
            done, total = done + int(f["finished"].sum()), total + len(f)
        percent = round(100.0 * done / total, 1) if total else 0.0
        state.update((done, total, percent))
        state.setTimeoutDuration(wait)
        if percent != said:
            yield pd.DataFrame({"batch_id": [key[0]], "done": [done], "total": [total], "percent": [percent]})

    kind = stream.schema["batch_id"].dataType.simpleString()
    return stream.groupBy("batch_id").applyInPandasWithState(step, f"batch_id {kind}, done long, total long, percent double", "done long, total long, percent double", "update", GroupStateTimeout.ProcessingTimeTimeout)


def _milliseconds(length: str) -> int:
    return int(pd.Timedelta(length).total_seconds() * 1000)


def limited(stream: DataFrame, most: int = 5, seconds: int = 60, late: str = "1 minute") -> DataFrame:
    """(user_id, ts, accepted): requests under a sliding limit; refused ones don't count.

    The requests of a user that come together are judged in the order of their times. State is at most ``most``
    times a user and goes once the watermark, ``late`` behind the newest request, has passed the last by ``seconds``.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = list(state.get[0]) if state.exists else []
        times, accepted = sorted(t for f in frames for t in f["ts"].astype("datetime64[us]").astype("int64")), []
        for t in times:
            held = [h for h in held if h > t - seconds * 1_000_000]
            accepted.append(len(held) < most)
            if accepted[-1]:
                held.append(t)
        state.update((held,))
        state.setTimeoutTimestamp(max(max([*held, *times]) // 1000 + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"user_id": [key[0]] * len(times), "ts_us": times, "accepted": accepted})

    kind = stream.schema["user_id"].dataType.simpleString()
    timed = stream.withWatermark("ts", late)
    return timed.groupBy("user_id").applyInPandasWithState(step, f"user_id {kind}, ts_us long, accepted boolean", "held array<long>", "append", GroupStateTimeout.EventTimeTimeout)


def completions(stream: DataFrame, wait: str = "30 minutes", late: str = "10 minutes", keep: str = "1 hour") -> DataFrame:
    """(document_id, status, pages, failed, missing): one row when a document's pages are all in, or time is up.

    ``stream`` has document_id, page_number, pages (how many the document has), failed and ts; a page may
    come more than once, its first row counts. The status is COMPLETED or COMPLETED_WITH_ERRORS as
    :func:`rollkeep.operators.counts.closure` has it, or TIMED_OUT where the watermark, ``late`` behind the newest
    page, has passed the document's newest page by ``wait``; ``missing`` counts the pages that haven't come by
    then. Pages of a closed document change nothing for ``keep``; then its state goes. State is a page
    number for each page seen of an open document, and a mark for a closed one.
    """
    open_for, closed_for = _milliseconds(wait), _milliseconds(keep)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, failed, total, newest, closed = state.get if state.exists else ([], 0, 0, 0, False)
        now = state.getCurrentWatermarkMs()
        out = None
        if state.hasTimedOut:
            if closed:
                state.remove()
                return
            out = ("TIMED_OUT", len(seen), failed, max(total - len(seen), 0))
        else:
            seen = list(seen)
            for f in frames:
                for page, pages, bad, ts in zip(f["page_number"], f["pages"], f["failed"], f["ts"].astype("datetime64[ms]").astype("int64"), strict=True):
                    newest, total = max(newest, int(ts)), max(total, int(pages))
                    if not closed and int(page) not in seen:
                        seen.append(int(page))
                        failed += int(bool(bad))
            if not closed and len(seen) >= total:
                out = ("COMPLETED_WITH_ERRORS" if failed else "COMPLETED", len(seen), failed, 0)
        closed = closed or out is not None
        state.update(([] if closed else seen, failed, total, newest, closed))
        state.setTimeoutTimestamp(max((max(newest, now) + closed_for) if closed else newest + open_for, now + 1))
        if out:
            yield pd.DataFrame([(key[0], *out)], columns=["document_id", "status", "pages", "failed", "missing"])

    kind = stream.schema["document_id"].dataType.simpleString()
    timed = stream.select("document_id", "page_number", "pages", "failed", "ts").withWatermark("ts", late)
    return timed.groupBy("document_id").applyInPandasWithState(
        step, f"document_id {kind}, status string, pages long, failed long, missing long", "seen array<long>, failed long, total long, newest long, closed boolean", "append", GroupStateTimeout.EventTimeTimeout
    )


def windowed(stream: DataFrame, length: str = "10 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """An extension: events and their value by tumbling or sliding window."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    return stream.withWatermark("ts", late).groupBy(w, "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


def sessions(stream: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """An extension: sessions of a user's events."""
    return stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))


def import_folder(spark: SparkSession, folder: str, schema: Schema, sink: str, checkpoint: str, at_once: int = 1000, register: Callable[[SparkSession], DataFrame] | None = None, on_duplicate: str = "skip", refuse: bool = True) -> None:
    """Import the delimited files of a folder as they arrive; a restart goes on where it stopped.

    The files of a batch are read as one table, each an import of its own with its own
    encoding, delimiter and headings (see :func:`import_files`). Rows go to ``sink``/rows and a row
    of counters for each file to ``sink``/files, both in folders by the hash of the file's path, which
    a batch replaces, so that a batch that is delivered again gives the same result. A row is
    skipped for a number in the ``register`` or of a row created from another file before. The paths
    of at most ``at_once`` files are all that comes to the driver. Files without bytes are passed over.
    """
    form = "path string, modificationTime timestamp, length long, content binary"
    paths = spark.readStream.format("binaryFile").schema(form).option("maxFilesPerTrigger", at_once).load(folder).select("path")
    row_schema = "path string, row_number long, key string, fields string, too_many boolean, too_few boolean, oversized boolean, outcome string, code string, import string"

    def write(batch: DataFrame, epoch: int) -> None:
        here = batch.sparkSession
        found = [r["path"] for r in batch.collect()]
        if not found:
            return
        own = F.sha2("path", 256).alias("import")
        mine = here.createDataFrame([(p,) for p in found], "path string").select(own)
        known = here.read.schema(row_schema).parquet(f"{sink}/rows").where("outcome = 'created'").join(mine, "import", "left_anti").select(F.col("key").alias("number_key"))
        known = known if register is None else known.unionByName(register(here).select("number_key"))
        rows, files = import_files(here, found, schema, materialize(known), on_duplicate, refuse)
        out = rows.withColumn("fields", F.to_json("fields"))
        for name, table in (("rows", out), ("files", files)):
            table.select("*", own).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("import").parquet(f"{sink}/{name}")

    spark.createDataFrame([], row_schema).write.mode("append").partitionBy("import").parquet(f"{sink}/rows")  # so that the first batch finds the table
    paths.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
