"""Stages take effect once: repeated deliveries, a killed attempt, failures, streams."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rollkeep.streaming import stages

FORM = "document_id long, words int, code string"


def count(df):
    words = F.size(F.split("text", " "))
    return df.select("document_id", words.alias("words"), F.when(F.col("text") == "", "no_text").alias("code"))


READ = stages.Stage("read", ("QUEUED",), "READ", count)
SEAL = stages.Stage("seal", ("READ",), "SEALED", lambda df: df.select("document_id", F.lit(0).alias("words"), F.lit(None).cast("string").alias("code")))


def table(spark, rows):
    return spark.createDataFrame(rows, "document_id long, text string")


def held(spark, root):
    return {r["document_id"]: (r["version"], r["status"], r["code"]) for r in stages.states(stages.moves(spark, root)).collect()}


def outcome(spark, root):
    return sorted(tuple(r) for r in stages.results(spark, root, READ, FORM).select("document_id", "words", "code").collect())


def test_deliveries_take_effect_once(spark, tmp_path):
    root = str(tmp_path)
    docs = table(spark, [(1, "a b"), (2, ""), (3, "c"), (3, "c"), (None, "x")])
    for _ in range(2):
        stages.register(docs, root, "first")
    stages.register(docs, root, "again")
    stages.advance(docs, "d0", READ, root)
    once = held(spark, root), outcome(spark, root)
    assert once == ({1: (2, "READ", None), 2: (2, "FAILED", "no_text"), 3: (2, "READ", None)}, [(1, 2, None), (2, 1, "no_text"), (3, 1, None)])
    stages.advance(docs, "d0", READ, root)  # the same delivery again
    stages.advance(docs, "d1", READ, root)  # the same documents under another name
    assert (held(spark, root), outcome(spark, root)) == once
    stages.advance(docs, "d0", SEAL, root)
    stages.advance(docs, "d0", READ, root)  # late, when the documents have moved on
    assert held(spark, root) == {1: (3, "SEALED", None), 2: (2, "FAILED", "no_text"), 3: (3, "SEALED", None)} and outcome(spark, root) == once[1]
    stages.register(table(spark, [(4, "d"), (1, "a b")]), root, "more")
    assert held(spark, root)[4] == (1, "QUEUED", None) and held(spark, root)[1][0] == 3


def test_a_killed_attempt_leaves_nothing(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "root")
    spark.createDataFrame([(1, "a b"), (2, "c")], "document_id long, text string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stages.register(table(spark, [(1, ""), (2, "")]), root, "first")
    stream = lambda: spark.readStream.schema("document_id long, text string").parquet(str(tmp_path / "in"))
    write = stages._write

    def killed(df, path):
        if "/moves/stage=read" in path:
            raise RuntimeError("killed")
        write(df, path)

    monkeypatch.setattr(stages, "_write", killed)
    with pytest.raises(Exception, match="killed"):
        stages.run(stream(), READ, root, str(tmp_path / "cp"))
    assert held(spark, root) == {1: (1, "QUEUED", None), 2: (1, "QUEUED", None)} and outcome(spark, root) == []
    monkeypatch.setattr(stages, "_write", write)
    stages.run(stream(), READ, root, str(tmp_path / "cp"))
    stages.run(stream(), READ, root, str(tmp_path / "other"))  # all of it again, without the checkpoint
    assert held(spark, root) == {1: (2, "READ", None), 2: (2, "READ", None)} and outcome(spark, root) == [(1, 2, None), (2, 1, None)]


def test_two_moves_of_one_version(spark):
    log = spark.createDataFrame([(1, 1, "QUEUED", None, "register", "a"), (1, 2, "B", None, "y", "d0"), (1, 2, "A", None, "x", "d9")], stages.MOVES)
    assert [tuple(r) for r in stages.states(log).collect()] == [(1, 2, "A", None)]
    assert stages.states(log.limit(0)).count() == 0
