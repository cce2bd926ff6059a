"""The keys and the similarity of names as SQL functions of a session."""

from __future__ import annotations

from pyspark.sql import SparkSession

from rollkeep.functions import text as t

_WORDS = r"r'([\p{L}\p{M}\p{N}_]+)'"


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def statements() -> dict[str, str]:
    """name -> its definition; each uses only those before it."""
    plain = r"rlike(a, r'^[\x00-\x7F]*$')"
    folded = f"translate(coalesce(CASE WHEN {plain} THEN a END, rollkeep_nfkc(CASE WHEN NOT {plain} THEN a END), ''), {_quoted(t.LOOKALIKES)}, {_quoted(t.CANONICAL)})"
    soft = f"replace(regexp_replace(a, r'(?<=\\p{{L}})\u00ad(?=\\p{{L}})', ''), '\u00ad', '-')"
    digits = f"{_quoted(t.EASTERN)}, {_quoted(t.WESTERN)}"
    titles = ", ".join(map(_quoted, t.TITLES))
    first = f"array_position(transform(w, x -> array_contains(array({titles}), x)), false)"
    pieces = r"split(lower(a), r'[^\p{L}\p{N}]+')"
    return {
        "folded_text": f"(a STRING) RETURNS STRING RETURN {folded}",
        "number_key": f"(a STRING) RETURNS STRING RETURN substring(regexp_replace(lower(translate(folded_text(a), {digits})), '[^{t.KEY_LETTERS}]+', ''), 1, {t.KEY_LENGTH})",
        "plain_hyphens": f"(a STRING) RETURNS STRING RETURN translate({soft}, {_quoted(t.INVISIBLE)}, '')",
        "name_words": f"(a STRING) RETURNS ARRAY<STRING> RETURN regexp_extract_all(lower(translate(plain_hyphens(folded_text(a)), {digits})), {_WORDS}, 1)",
        "from_first_name": f"(w ARRAY<STRING>) RETURNS ARRAY<STRING> RETURN CASE WHEN {first} > 0 THEN slice(w, CAST({first} AS INT), size(w)) ELSE array() END",
        "name_key": f"(a STRING) RETURNS STRING RETURN substring(array_join(from_first_name(name_words(a)), ' '), 1, {t.KEY_LENGTH})",
        "trigrams": f"(a STRING) RETURNS ARRAY<STRING> RETURN array_distinct(flatten(transform(filter({pieces}, w -> w <> ''), w -> transform(sequence(1, length(w) + 1), i -> substring(concat('  ', w, ' '), i, 3)))))",
        "trigram_similarity": "(a STRING, b STRING) RETURNS DOUBLE RETURN coalesce(try_divide(size(array_intersect(trigrams(a), trigrams(b))), size(array_union(trigrams(a), trigrams(b)))), 0.0D)",
    }


def register(spark: SparkSession) -> SparkSession:
    """Make number_key, name_key and trigram_similarity known to the session's SQL."""
    spark.udf.register("rollkeep_nfkc", t._nfkc)
    for name, definition in statements().items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{definition}")
    return spark
