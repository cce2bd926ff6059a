"""Duplicate detection among entries and files; nothing is ever merged or overwritten."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from rollkeep.sources.scratch import materialize

#: How many candidates an entry has at most: the oldest of each kind, then the best of both kinds.
MOST = 20


def _oldest(rows: DataFrame, key: list[str], most: int) -> DataFrame:
    """The ``most`` oldest rows of each key. Spark keeps no more of them in a task before the shuffle either."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy("created_at", "id"))
    return rows.withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def _first_candidates(pairs: DataFrame) -> DataFrame:
    """(a_id, b_id): the ``MOST`` oldest candidates of each entry."""
    place = F.row_number().over(W.partitionBy("a_id").orderBy("b_created", "b_id"))
    return pairs.distinct().withColumn("_place", place).where(F.col("_place") <= MOST).select("a_id", "b_id")


#: What the joins below read of an entry.
_NUMBERS = ["id", "workspace_id", "status", "created_at", "number_key", "registration_key"]
_PEOPLE = ["id", "workspace_id", "type_id", "status", "created_at", "number_key", "name_key", "event_date"]


def _held(keyed: DataFrame, columns: list[str]) -> DataFrame:
    """Keys are made once, however many joins read them."""
    return materialize(keyed.select(*dict.fromkeys(columns)))


def union_of_keys(left: DataFrame, right: DataFrame, pairs: list[tuple[str, str]]) -> DataFrame:
    """(a_id, b_id, b_created): entries of one workspace that agree on any of several key pairs, the oldest by key.

    A join on an OR of equalities can't be hashed; a union of one equi-join for each key
    pair can. Of each key the oldest ``MOST`` and one more (the entry itself) are joined,
    so that a number that many share doesn't make all its pairs.
    """
    found = []
    for a, b in pairs:
        old = _oldest(right.where(F.col(b) != ""), ["workspace_id", b], MOST + 1).select("workspace_id", F.col("id").alias("b_id"), F.col(b).alias("k"), F.col("created_at").alias("b_created"))
        found.append(left.where(F.col(a) != "").select("workspace_id", F.col("id").alias("a_id"), F.col(a).alias("k")).join(old, ["workspace_id", "k"]).select("a_id", "b_id", "b_created"))
    return reduce(DataFrame.unionByName, found).where("a_id <> b_id")


def same_number(keyed: DataFrame) -> DataFrame:
    """(a_id, b_id): entry b isn't void, is in a's workspace, and has a's number or registration number, or a's registration number as its number."""
    return _same_number(_held(keyed, _NUMBERS))


def _same_number(keyed: DataFrame) -> DataFrame:
    return _first_candidates(union_of_keys(keyed, keyed.where("status <> 'VOID'"), [("number_key", "number_key"), ("registration_key", "registration_key"), ("registration_key", "number_key")]))


def same_person(keyed: DataFrame) -> DataFrame:
    """(a_id, b_id): entry b isn't void and has the workspace, type, name and event date of a, but another number. Blank names match nothing.

    Of one number no more than ``MOST`` entries can be candidates, and an entry passes over
    those of one number only: twice ``MOST`` of each person are enough.
    """
    return _same_person(_held(keyed, _PEOPLE))


def _same_person(keyed: DataFrame) -> DataFrame:
    person = ["workspace_id", "type_id", "name_key", "event_date"]
    named = keyed.where("name_key <> '' and event_date is not null")
    old = _oldest(_oldest(named.where("status <> 'VOID'"), [*person, "number_key"], MOST), person, 2 * MOST)
    b = old.select(*person, F.col("id").alias("b_id"), F.col("number_key").alias("b_number"), F.col("created_at").alias("b_created"))
    a = named.select(*person, F.col("id").alias("a_id"), F.col("number_key").alias("a_number"))
    return _first_candidates(a.join(b, person).where("a_id <> b_id and a_number <> b_number").select("a_id", "b_id", "b_created"))


def classified(keyed: DataFrame) -> DataFrame:
    """(a_id, b_id, reason, strong, place): the candidates of each entry, the first ``MOST`` in order.

    A shared number within one type is strong; a shared number of another type and a
    shared name and date aren't. Strong ones come first, then the same type, then those
    by number, then the oldest.
    """
    keyed = _held(keyed, [*_NUMBERS, *_PEOPLE])
    types = keyed.select("id", "type_id", "created_at")
    numbers = materialize(_same_number(keyed)).withColumn("by_number", F.lit(True))
    people = _same_person(keyed).join(numbers, ["a_id", "b_id"], "left_anti").withColumn("by_number", F.lit(False))
    both = numbers.unionByName(people)
    typed = both.join(types.select(F.col("id").alias("a_id"), F.col("type_id").alias("a_type")), "a_id").join(types.select(F.col("id").alias("b_id"), F.col("type_id").alias("b_type"), F.col("created_at").alias("b_created")), "b_id")
    same = F.col("a_type") == F.col("b_type")
    reason = F.when(F.col("by_number") & same, "same_number").when(F.col("by_number"), "same_number_other_type").otherwise("same_name_and_event_date")
    ranked = typed.withColumns({"reason": reason, "strong": F.col("by_number") & same})
    place = F.row_number().over(W.partitionBy("a_id").orderBy(F.desc("strong"), F.desc(same.cast("int")), F.desc(F.col("by_number").cast("int")), "b_created", "b_id"))
    return ranked.withColumn("place", place).where(F.col("place") <= MOST).select("a_id", "b_id", "reason", "strong", "place")


def first_copies(files: DataFrame, within: list[str], digest: str, order: list[str], id_column: str) -> DataFrame:
    """``files`` with ``duplicate_of``: the first row of the same bytes in the same batch, null for that row itself."""
    key = [*within, digest]
    firsts = files.groupBy(*key).agg(F.min(F.struct(*dict.fromkeys([*order, id_column]))).alias("first"))
    first = F.col(f"first.{id_column}")
    return files.join(firsts, key).withColumn("duplicate_of", F.when(first != F.col(id_column), first)).drop("first")


def fan_out(duplicates: DataFrame, units: DataFrame) -> DataFrame:
    """Units of the original for each duplicate document that has none of its own."""
    bare = duplicates.where("duplicate_of is not null").join(units.select("document_id").distinct(), "document_id", "left_anti")
    return bare.select("document_id", "duplicate_of").join(units.withColumnRenamed("document_id", "duplicate_of"), "duplicate_of").drop("duplicate_of")


def resolve(pairs: DataFrame) -> DataFrame:
    """Settle answered questions: of two entries for one certificate the later is superseded, else both are distinct.

    ``pairs`` has a_id, b_id, a_created, b_created, same.
    """
    a_first = F.struct("a_created", "a_id") <= F.struct("b_created", "b_id")
    kept, later = F.when(a_first, F.col("a_id")).otherwise(F.col("b_id")), F.when(a_first, F.col("b_id")).otherwise(F.col("a_id"))
    rows = F.when(
        F.col("same"),
        F.array(
            F.struct(kept.alias("id"), F.lit("ACTIVE").alias("status"), F.lit("CONFIRMED").alias("duplicate_status"), F.lit(None).cast("long").alias("superseded_by")),
            F.struct(later.alias("id"), F.lit("SUPERSEDED").alias("status"), F.lit("CONFIRMED").alias("duplicate_status"), kept.alias("superseded_by")),
        ),
    ).otherwise(
        F.array(
            F.struct(kept.alias("id"), F.lit("ACTIVE").alias("status"), F.lit("DISTINCT").alias("duplicate_status"), F.lit(None).cast("long").alias("superseded_by")),
            F.struct(later.alias("id"), F.lit("ACTIVE").alias("status"), F.lit("DISTINCT").alias("duplicate_status"), F.lit(None).cast("long").alias("superseded_by")),
        )
    )
    return pairs.select(F.inline(rows))
