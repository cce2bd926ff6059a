"""Plans stay as they should be at scale."""

from __future__ import annotations

from pyspark.sql import functions as F

from rollkeep.operators import duplicates, search
from rollkeep.queries import register

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_disjunctive_duplicates_avoid_nested_loops(spark):
    text = plan(duplicates.same_number(register.keyed(spark, SF)))
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_similar_pairs_avoid_nested_loops(spark):
    assert "Cartesian" not in plan(register.similar_names(spark, SF))


def test_keyset_is_a_top_k(spark):
    assert "TakeOrderedAndProject" in plan(register.keyset(spark, SF))


def test_prefix_reaches_the_scan(spark):
    orders = spark.read.parquet(f"{SF}/orders.parquet")
    text = plan(orders.where(F.col("o_orderpriority").startswith("1-")).select("o_orderkey"))
    assert "StringStartsWith" in text and "ReadSchema: struct<o_orderkey:bigint,o_orderpriority:string>" in text


def test_similar_pairs_lose_nothing(spark):
    keys = spark.createDataFrame([(k,) for k in ("red widget", "red widgets", "blue ring", "blu ring", "x", "large blue ring")], "key string")
    got = {(r[0], r[1]) for r in search.similar_pairs(keys, keys, 0.35).select("left_key", "right_key").collect()}
    full = keys.crossJoin(keys.withColumnRenamed("key", "other")).where(search.similarity(F.col("key"), F.col("other")) >= 0.35)
    assert got == {(r[0], r[1]) for r in full.collect()}
