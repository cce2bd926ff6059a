from __future__ import annotations

from pyspark.sql import functions as F

from rollkeep.functions import registered, text


def test_sql_functions_agree_with_the_columns(spark):
    registered.register(spark)
    names = ["Mr. Dr Ahmed  Khan", "SYED محمد علی", "ＡＢ-12/۳۴", "Mrs", "", None, "O'Neil co\u00adop x\u00ad1", "ali\u200bza 7", "x/\\y"]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(names)], "id int, a string")
    df.createOrReplaceTempView("registered_names")
    got = spark.sql("SELECT id, number_key(a) AS n, name_key(a) AS m, trigram_similarity(a, 'ahmed khan') AS s FROM registered_names").orderBy("id").collect()
    want = df.select("id", text.number_key(F.col("a")).alias("n"), text.name_key(F.col("a")).alias("m"), text.similarity(F.col("a"), F.lit("ahmed khan")).alias("s")).orderBy("id").collect()
    assert [tuple(r)[:3] for r in got] == [tuple(r)[:3] for r in want]
    assert all(abs(g["s"] - w["s"]) < 1e-12 for g, w in zip(got, want, strict=True) if names[g["id"]] is not None)
    assert spark.sql("SELECT trigram_similarity('Muhammad', 'Mohammad')").first()[0] == 0.5
