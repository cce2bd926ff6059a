"""Lines and the names they may hold damaged."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeep.functions.fuzzy import SHORTEST, grams, lost_grams, placed


def damaged_names(lines: DataFrame, names: list[str], least: float, exact: bool = False) -> DataFrame:
    """(low, name, at, length, ratio): the windows of different lines ``low`` that are at least so like a name.

    A line that holds a name as it stands has no row for it, or with ``exact`` one of ratio 1. Of the pairs of
    neighbouring characters of a name (of a shorter line: of the line) a window that is like it
    keeps a certain number at least, which is counted before texts are compared. Lines of three
    characters must stand in the name. No line that is that like is lost. Only the pairs of names are looked
    for, so that a line is read once for each and nothing grows with its length but the line itself.
    ``names`` is a list of the caller's.
    """
    names = sorted({n for n in names if len(n) >= SHORTEST})
    longest = max(map(len, names), default=0)
    different = lines.select("low").where("low <> ''").distinct().withColumn("_n", F.length("low"))
    # How many pairs a line shorter than a name may lose; only of such lines all pairs are made.
    keeps = F.element_at(F.array(*[F.lit(lost_grams(n, least)) for n in range(1, longest + 1)] or [F.lit(0)]), F.col("_n"))
    pairs = F.array_distinct(F.transform(F.sequence(F.lit(1), F.col("_n") - 1), lambda i: F.substring("low", i, F.lit(2))))
    short = different.withColumn("_g", F.when((F.col("_n") > SHORTEST) & (F.col("_n") < longest), pairs))

    def may_hold(name: str) -> Column:
        need = len(grams(name)) - lost_grams(len(name), least)
        kept = sum((F.contains(F.col("low"), F.lit(g)).cast("int") for g in grams(name)), F.lit(0)) >= need if need > 0 else F.lit(True)
        shared = F.size(F.array_intersect("_g", F.array(*[F.lit(g) for g in grams(name)]))) >= F.size("_g") - keeps
        return F.when(F.col("_n") >= len(name), kept).when(F.col("_n") <= SHORTEST, F.contains(F.lit(name), F.col("low"))).otherwise(shared)

    met = F.filter(F.array(*[F.when(may_hold(n), F.lit(n)) for n in names]).cast("array<string>"), lambda n: n.isNotNull())
    asked = short.select("low", F.explode(met).alias("name"))

    held = F.contains(F.col("low"), F.col("name"))
    found = asked.where(~held).withColumn("_p", placed("name", "low", F.lit(float(least)))).where("_p.at IS NOT NULL").select("low", "name", "_p.*")
    if not exact:
        return found
    whole = asked.where(held).select("low", "name", F.instr("low", F.col("name")).alias("at"), F.length("name").alias("length"), F.lit(1.0).alias("ratio"))
    return found.unionByName(whole)
