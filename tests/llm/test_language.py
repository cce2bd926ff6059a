"""Language prediction: the path against trying all, words and scripts, mixed texts, held-out accuracy, awkward rows."""

from __future__ import annotations

import itertools
import re
import unicodedata
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rollkeep.llm import language
from rollkeep.llm.toxicity import held_out_part

FORM = "doc_id long, text string, lang string, held_out string, score int, source string"
WORDS = {
    "xa": "the house stands near that river where boats come with bread and wool every morning".split(),
    "xb": "das haus steht am fluss wohin jeden morgen schiffe mit brot und wolle kommen".split(),
    "xc": "дом стоит у реки куда каждое утро приходят лодки с хлебом и шерстью".split(),
}


def learned(n=60):
    rng = np.random.default_rng(8)
    rows = [(i * len(WORDS) + k, " ".join(rng.choice(w, 30)), lang, None, 1, "s") for i in range(n) for k, (lang, w) in enumerate(WORDS.items())]
    return rows


@pytest.fixture(scope="module")
def model(spark):
    return language.fit(spark.createDataFrame(learned(), FORM))


def test_path_is_the_best_of_all():
    rng = np.random.default_rng(1)
    lengths = [5, 0, 3, 6, 1, 5]
    first = np.concatenate([[0], np.cumsum(lengths)])
    scores, prior = rng.normal(0, 4, (first[-1], 3)).astype(np.float32), np.log([0.5, 0.3, 0.2])
    got = language.best_path(scores, first, prior, switch=3.0)
    for a, b in itertools.pairwise(first):
        if a < b:
            paths = list(itertools.product(range(3), repeat=b - a))
            value = [prior[p[0]] + sum(scores[a + i, x] for i, x in enumerate(p)) - 3 * sum(x != y for x, y in itertools.pairwise(p)) for p in paths]
            assert tuple(got[a:b]) == paths[int(np.argmax(value))]


def test_words_are_runs_of_one_script():
    texts = ["Ab1cd éÉ́x", None, "", "́ Да нет,日本語かな", "éa_b", "12 34", "Straße"]
    w = language.words_of(texts)
    got = [(int(t), texts[t][a - w.bounds[t] : b - w.bounds[t]]) for t, a, b in zip(w.text, w.start, w.end, strict=True)]
    assert got == [(0, "Ab"), (0, "cd"), (0, "éÉ́x"), (3, "Да"), (3, "нет"), (3, "日本語"), (3, "かな"), (4, "éa"), (4, "b"), (6, "Straße")]
    assert all(bool(re.search(r"[^\W\d_]", t or "")) == any(unicodedata.category(c)[0] == "L" for c in t or "") for t in texts)


def test_slots_cover_each_sequence_once():
    bits = language.BITS
    w = language.words_of(["abc de abc", "x abc"])
    grams, at, word = language.slots_of(w, 0, 5, bits)
    per = [np.sort(grams[:, a:b][grams[:, a:b] >= 0]) for a, b in itertools.pairwise([*at, grams.shape[1]])]
    assert [len(p) for p in per] == [3 + 4 + 3 + 2, 2 + 3 + 2 + 1, 12, 1 + 2 + 1 + 0, 12]
    assert (per[0] == per[2]).all() and (per[0] == per[4]).all() and word[0] == word[2] == word[4] != word[1]


def test_spans_of_mixed_texts(spark, model):
    a, b, c = (" ".join(w) for w in WORDS.values())
    texts = [(1, f"{a}. {b}; {c}!", None, None, 1, "s"), (2, "17 + 4", None, None, 1, "s"), (3, None, None, None, 1, "s"), (4, b, None, None, 1, "s")]
    spans = language.label_spans(spark.createDataFrame(texts, FORM), model).orderBy("doc_id", "start").collect()
    assert [(r["doc_id"], texts[r["doc_id"] - 1][1][r["start"] : r["end"]], r["lang"]) for r in spans] == [(1, a, "xa"), (1, b, "xb"), (1, c, "xc"), (4, b, "xb")]
    assert all(0.9 < r["score"] <= 1 for r in spans)


def test_scripts_rule_languages_out(model):
    w = language.words_of(["река the ωμέγα"])
    scores = language.word_scores(w, model)
    assert scores[0].tolist()[:2] == [language.RULED_OUT] * 2 and scores[0, 2] > language.RULED_OUT
    assert scores[1, 2] == language.RULED_OUT and scores[2].tolist() == [0, 0, 0]


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language.predict_languages(docs).join(docs, "doc_id").where("held_out").agg(F.avg(F.expr("int(lang_pred = lang)")), F.count("*")).first()
    assert got[1] > 300 and got[0] > 0.99


def test_awkward_rows(spark):
    rows = learned() + [(None, None, "xa", None, 1, None), (9001, "", None, None, 1, None), (9002, " 12 ́", "xa", None, 1, None), (9003, "the river " * 60000 + "дом", "xa", None, 1, None)]
    rows += [(9004, "brot", None, None, 1, None), (9004, "brot", None, None, 1, None), (9005, "x" * 300000, None, None, 1, None)]
    got = language.predict_languages(spark.createDataFrame(rows, FORM).repartition(3)).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "held_out", "lang_pred", "score"}
    by = {r["doc_id"]: r for r in got}
    assert all(r["held_out"] == (zlib.crc32(str(d).encode()) % 3 == 1) for d, r in by.items() if d is not None)
    assert [by[d]["lang_pred"] for d in (None, 9001, 9002, 9003, 9004)] == ["und", "und", "und", "xa", "xb"]
    assert all(0 <= r["score"] <= 1 and (r["lang_pred"] != "und" or r["score"] == 0) for r in got)
    known = {d: lang for d, _, lang, *_ in learned()}
    assert all(by[d]["lang_pred"] == lang for d, lang in known.items())


def test_held_out_labels_and_other_columns_change_nothing(spark):
    df = spark.createDataFrame(learned(), FORM)
    out = held_out_part(F.col("doc_id")) == 1
    swapped = df.withColumn("lang", F.when(out, F.lit("zz")).otherwise(F.col("lang"))).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(tuple, language.predict_languages(df).collect())) == sorted(map(tuple, language.predict_languages(swapped).collect()))


def test_nothing_to_learn_from(spark):
    rows = [(1, "some text", None, None, 1, "s"), (2, "", None, None, 1, "s")]
    assert {tuple(r)[2:] for r in language.predict_languages(spark.createDataFrame(rows, FORM)).collect()} == {("und", 0.0)}
    assert language.predict_languages(spark.createDataFrame([], FORM)).count() == 0


def test_many_languages_fit_the_table():
    assert language.bits_for(4) == language.BITS
    for k in (30, 300, 4096):
        assert k * sum(1 << b for b in language.bits_for(k)) <= language.CELLS or min(language.bits_for(k)) == 0
