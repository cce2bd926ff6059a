"""One query for each operator, over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rollkeep.llm.anagram import spelling_variants
from rollkeep.llm.audit import filter_audit
from rollkeep.llm.chroma import align_members, melodies
from rollkeep.llm.decontaminate import decontaminate
from rollkeep.llm.html import main_texts
from rollkeep.llm.language import predict_languages
from rollkeep.llm.lm import score_texts
from rollkeep.llm.mixing import mix_sources
from rollkeep.llm.pii import find_personal_data
from rollkeep.llm.sharding import shard_by_bytes
from rollkeep.llm.simhash import near_duplicates
from rollkeep.llm.substring import remove_repeats
from rollkeep.llm.toxicity import score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op5_chroma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables hold no recordings: each vector of ``embeddings`` is played as a melody. Queries are the ids divisible by 50."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("vector"))
    return align_members(vectors.mapInArrow(melodies, "id long, audio binary"), F.col("id") % 50 == 0)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(table(spark, sf_dir, "documents"))


def op7_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_texts(table(spark, sf_dir, "pages"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants(table(spark, sf_dir, "documents"))


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op13_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return predict_languages(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_toxicity": op1_toxicity,
        "op2_sharding": op2_sharding,
        "op3_decontamination": op3_decontamination,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_chroma": op5_chroma,
        "op6_pii": op6_pii,
        "op7_html_text": op7_html_text,
        "op8_simhash": op8_simhash,
        "op9_lm_score": op9_lm_score,
        "op10_mixing": op10_mixing,
        "op11_spelling": op11_spelling,
        "op12_filter_audit": op12_filter_audit,
        "op13_language": op13_language,
    }


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all({}, '[^\\x20\\x09-\\x0D]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, n, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS p FROM i WHERE len(w) > 0)),
dw AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS t FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM iw))),
h AS (SELECT doc_id, p, dw.n AS n, item_id FROM dw JOIN iw ON dw.n = iw.n AND dw.t = iw.t),
c AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS x FROM h) GROUP BY 1),
s AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN s USING (doc_id)"""

SUBSTRING = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("coalesce(text, '')")} AS w FROM documents),
x AS (SELECT doc_id, p, sha256(array_to_string(w[p:p + 49], ' ')) AS t FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM d WHERE len(w) >= 50)),
f AS (SELECT doc_id, p, min(doc_id) OVER (PARTITION BY t) AS first FROM x),
g AS (SELECT DISTINCT doc_id, unnest(range(p, p + 50)) AS k FROM f WHERE first < doc_id),
k AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS k, unnest(w) AS word FROM d),
r AS (SELECT k.doc_id, count(g.k) AS n_removed, string_agg(word, ' ' ORDER BY k.k) FILTER (g.k IS NULL) AS kept FROM k LEFT JOIN g ON k.doc_id = g.doc_id AND k.k = g.k GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN r USING (doc_id)"""

MIXING = f"""
WITH d AS (SELECT doc_id, source, len({_WORDS.format("coalesce(text, '')")}) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w FROM d GROUP BY source),
o AS (SELECT *, row_number() OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST) AS k, sum(source_size) OVER () AS t, sum(w) OVER () AS ws FROM s),
c AS (SELECT *, CAST(t - 3.0::DOUBLE * coalesce(sum(source_size) OVER q, 0) AS DOUBLE) / (ws - coalesce(sum(w) OVER q, 0)) AS rate FROM o WINDOW q AS (ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT rate FROM c WHERE w * rate <= 3 * source_size ORDER BY k LIMIT 1),
g AS (SELECT source, source_size, CASE WHEN w * l.rate > 3 * source_size THEN 3.0::DOUBLE * source_size ELSE w * l.rate END AS target,
 CAST('0x' || substr(md5('10:' || coalesce(source, '')), 1, 8) AS BIGINT) / 4294967296.0::DOUBLE AS u FROM c, l),
r AS (SELECT doc_id, source, size, row_number() OVER (PARTITION BY source ORDER BY size, doc_id) - 1 AS k FROM d)
SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor((k + 1) * (target / source_size) + u) - floor(k * (target / source_size) + u) AS BIGINT) * size ELSE 0 END AS taken
FROM r JOIN g ON r.source IS NOT DISTINCT FROM g.source"""


#: CRC-32 from its polynomial: the 256 remainders of one byte, then a fold over the bytes of a text.
_CRC_TABLE = "SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS z FROM range(256) t(b)"
_BYTES = "list_transform(range(CAST(strlen({0}) AS BIGINT)), lambda i: CAST('0x' || substr(hex({0}), 2 * i + 1, 2) AS BIGINT))"
_CRC = "xor(list_reduce(list_prepend(4294967295, " + _BYTES + "), lambda c, b: xor(c >> 8, z[1 + (xor(c, b) & 255)])), 4294967295)"

SPELLING = f"""
WITH RECURSIVE z AS ({_CRC_TABLE}),
t AS (SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS d, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\u00C0-\u00FF]{{7,}}')) AS run FROM documents),
c AS (SELECT run, k, {_CRC.format("(d || ':' || run)")} AS h FROM (SELECT d, run, count(*) AS k FROM t GROUP BY ALL), z),
w AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM c) WHERE length(word) >= 7 GROUP BY 1 HAVING sum(k) >= 2),
v AS (SELECT word, n, p, substr(word, 1, p - 1) || substr(word, p + 1) AS v FROM (SELECT word, n, unnest(range(1, CAST(length(word) AS BIGINT) + 1)) AS p FROM w)),
e AS (SELECT a.word AS x, b.word AS y, b.n AS m FROM v a JOIN v b ON a.v = b.v AND a.p = b.p AND a.word <> b.word
 UNION SELECT v.word, w.word, w.n FROM v JOIN w ON v.v = w.word UNION SELECT w.word, v.word, v.n FROM v JOIN w ON v.v = w.word),
b AS (SELECT x, count(*) AS n_near, first(y ORDER BY m DESC, y) AS y, max(m) AS m FROM e GROUP BY x),
f AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN m >= 10 * n THEN y END AS form, CASE WHEN m >= 10 * n THEN m END AS form_n FROM w LEFT JOIN b ON word = x),
r AS (SELECT word, form AS top FROM f WHERE form IS NOT NULL UNION ALL SELECT r.word, f.form FROM r JOIN f ON r.top = f.word WHERE f.form IS NOT NULL)
SELECT word, form, coalesce(top, word) AS root, n, n_near, form_n FROM f LEFT JOIN (SELECT r.word AS of, top FROM r JOIN f ON top = f.word WHERE f.form IS NULL) ON word = of"""

FILTER_AUDIT = f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, {_WORDS.format("coalesce(text, '')")} AS w, min(doc_id) OVER (PARTITION BY coalesce(text, '')) AS first FROM documents),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY 1),
m AS (SELECT part, good, toxic, CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
 + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN d.doc_id > first THEN 16 ELSE 0 END AS mask
 FROM d LEFT JOIN l ON d.doc_id = l.doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM m GROUP BY 1, 2),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
o AS (SELECT a.f || b.f || c.f || d.f || e.f AS o FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
s AS (SELECT o, step, substr(o, step, 1) AS letter, CAST(1 << (ascii(substr(o, step, 1)) - 65) AS BIGINT) AS bit,
 CAST(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(o, i, 1)) - 65))) AS BIGINT) AS held FROM (SELECT o, unnest(range(1, 6)) AS step FROM o)),
q AS (SELECT part, o, step, letter, sum(CASE WHEN mask & (bit | coalesce(held, 0)) = 0 THEN n ELSE 0 END) AS kept, sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(held, 0) = 0 THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(held, 0) <> 0 THEN n ELSE 0 END) AS redundant, sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(held, 0) = 0 THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN mask & bit <> 0 AND mask & coalesce(held, 0) = 0 THEN toxic ELSE 0 END) AS toxic_lost
 FROM s, c GROUP BY 1, 2, 3, 4)
SELECT part, o AS filter_order, CAST(step AS INTEGER) AS step, {", ".join(f"CAST({x} AS BIGINT) AS {x}" for x in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"))}, CAST(sum(removed) OVER (PARTITION BY part, letter) AS BIGINT) AS shapley FROM q"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express: the others need trained models, SimHash or parsing, and are tested against plain Python."""
    return {"op3_decontamination": DECONTAMINATION, "op4_substring_dedup": SUBSTRING, "op10_mixing": MIXING, "op11_spelling": SPELLING, "op12_filter_audit": FILTER_AUDIT}
