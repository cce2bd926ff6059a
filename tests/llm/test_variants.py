"""Spelling variants against plain Python and SQL."""

from __future__ import annotations

import itertools
import random
import re
import zlib
from collections import Counter

import pytest

from rollkeep.llm import anagram, queries
from tests.parity import connection, differences

SF = "/root/testdata/sf0.001"
FORM = "doc_id long, text string, word string, n string, key int"


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def expected(rows):
    count = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = low(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            at = h % len(run)
            count[run[:at] + run[at + 1 :] if h % 31 == 0 else run] += 1
    n = {w: k for w, k in count.items() if len(w) >= 7 and k >= 2}
    around = {w: [x for x in n if near(w, x)] for w in n}
    form = {w: min(x, key=lambda y: (-n[y], y)) if x else None for w, x in around.items()}
    form = {w: f if f is not None and n[f] >= 10 * n[w] else None for w, f in form.items()}

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted((w, form[w], root(w), n[w], len(around[w]), n[form[w]] if form[w] else None) for w in n)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("word", "form", "root", "n", "n_near", "form_n").collect())


def test_awkward_texts(spark):
    rng = random.Random(5)
    stems = ["receive", "separated", "Éclairage", "ÿÀ×÷ßþa", "aaaaaaaa", "abcabcabc"]
    rows = []
    for i in range(400):
        words = []
        for _ in range(30):
            w = list(rng.choice(stems))
            for _ in range(rng.choice((0, 0, 0, 0, 1, 2))):
                at = rng.randrange(len(w))
                rng.choice((lambda: w.insert(at, rng.choice("aebÿ")), lambda: w.pop(at), lambda: w.__setitem__(at, rng.choice("aebß"))))()
            words.append("".join(w))
        rows.append((i, rng.choice((" ", "-", "9", "\x00")).join(words), "x", None, 1))
    rows += [(None, None, None, None, 1), (7, "", None, None, 1), (7, "receive recieve", None, None, 1), (7, "receive recieve", None, None, 1), (None, "separated", None, None, 1)]
    long = "ab" * 30000
    rows += [(9001, f"{long} {long}b {long} {long}b", None, None, 1)]
    want = expected(rows[:-1])
    got = rows_of(anagram.spelling_variants(spark.createDataFrame(rows, FORM).repartition(5)))
    assert [r for r in got if len(r[0]) < 1000] == want
    assert sum(r[1] is not None for r in want) > 10 and any(r[1] != r[2] for r in want if r[1])
    assert anagram.spelling_variants(spark.createDataFrame([], FORM)).count() == 0


def test_pairs_of_a_dense_vocabulary(spark):
    """Words of few letters, many of them anagrams of each other: each near pair once, no other."""
    words = ["".join(p) for n in (6, 7) for p in itertools.product("abc", repeat=n)][::3]
    got = [tuple(sorted(r)) for r in anagram.near_pairs(spark.createDataFrame([(w, 2) for w in words], "word string, n long")).select("a", "b").collect()]
    want = {tuple(sorted((x, y))) for x, y in itertools.combinations(words, 2) if abs(len(x) - len(y)) < 2 and near(x, y)}
    assert len(got) == len(set(got)) and set(got) == want


def test_roots_follow_every_step(spark):
    chain = [(f"w{i}", f"w{i + 1}") for i in range(11)] + [(f"leaf{i}", "w3") for i in range(50)]
    got = {r["word"]: r["root"] for r in anagram.roots(spark.createDataFrame(chain, "word string, form string")).collect()}
    assert got == {w: "w11" for w, _ in chain}


@pytest.mark.parametrize("name", ["op11_spelling", "op12_filter_audit"])
def test_same_rows_as_sql(spark, name):
    assert differences(queries.queries()[name](spark, SF), queries.oracle_sql()[name], connection(SF)) == ""
