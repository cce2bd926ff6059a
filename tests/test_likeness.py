"""Damaged names: likeness against trying all windows, the join against all pairs."""

from __future__ import annotations

import random

import pandas as pd
import pytest

from rollkeep.functions import fuzzy
from rollkeep.operators import split
from rollkeep.operators.likeness import damaged_names

NAMES = ["name of child", "date of birth", "order", "name", "sex", "papapapa", "جائے پیدائش"]


def shared(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        before = row
        row = [0]
        for j, y in enumerate(b):
            row.append(before[j] + 1 if x == y else max(before[j + 1], row[-1]))
    return row[-1]


def best(name, line):
    """The best likeness over whole windows and those cut at the ends."""
    s, t = (name, line) if len(name) <= len(line) else (line, name)
    n, k = len(s), len(t)
    cuts = [(0, e) for e in range(1, n)] + [(i, i + n) for i in range(k - n)] + [(i, k) for i in range(k - n, k)]
    return max((200.0 * shared(s, t[i:j]) / (n + j - i) for i, j in cuts), default=0.0)


def damaged(rng, name):
    w = list(name)
    for _ in range(rng.choice((0, 1, 1, 2, 3))):
        i = rng.randrange(len(w))
        rng.choice((lambda: w.insert(i, rng.choice("ab0")), lambda: len(w) > 1 and w.pop(i), lambda: w.__setitem__(i, rng.choice("xo1"))))()
    return "".join(w)


def lines(n=400):
    rng = random.Random(11)
    around = ["", " ", ": 12 may", " no. ", "the ", "x" * 40]
    made = [rng.choice(around) + damaged(rng, rng.choice(NAMES))[rng.choice((0, 0, 0, 1, 2)) :] + rng.choice(around) for _ in range(n)]
    return [*made, "", "n", "se", "of", "sex", "pa", "papa", "papapa", "rder: x", "orde"]


def test_best_window_is_the_best_of_all():
    for line in lines(150):
        for name in NAMES:
            if line:
                assert fuzzy.best_window(name, line) == pytest.approx(best(name, line)), (name, line)
    assert fuzzy.damaged_place("order", "rder: x", 85.0) == (0, 4, pytest.approx(8 / 9))
    assert fuzzy.damaged_place("order", "my orde", 85.0) == (3, 4, pytest.approx(8 / 9))


def test_join_loses_no_pair(spark):
    held = sorted(set(lines()))
    df = spark.createDataFrame([(x,) for x in held + held[:50]], "low string")
    got = {(r["low"], r["name"]): (r["at"], r["length"], r["ratio"]) for r in damaged_names(df, NAMES, 85.0, exact=True).collect()}
    want = {(x, n): best(n, x) / 100 for x in held for n in NAMES if x and best(n, x) >= 85.0}
    assert set(got) == set(want) and len(want) > 150
    assert all(got[k][2] == pytest.approx(v) for k, v in want.items())
    without = {(r["low"], r["name"]) for r in damaged_names(df, NAMES, 85.0).collect()}
    assert without == {k for k in want if k[1] not in k[0]}
    assert damaged_names(df.limit(0), NAMES, 85.0).count() == 0 and damaged_names(df, [], 85.0).count() == 0


def test_lost_grams_is_a_bound():
    rng = random.Random(2)
    for _ in range(3000):
        name = "".join(rng.choice("abcd") for _ in range(rng.randrange(4, 16)))
        window = damaged(rng, damaged(rng, name))[: len(name)]
        if window and 200.0 * shared(name, window) / (len(name) + len(window)) >= 85:
            assert len(set(fuzzy.grams(name)) & set(fuzzy.grams(window))) >= len(fuzzy.grams(name)) - fuzzy.lost_grams(len(name), 85.0)


def test_titles_as_scans_leave_them(spark):
    texts = [(1, "Certif1cate of Birth\nx\ny"), (2, "Certificate of Birth\nx\ny"), (3, "x\ny\nz\nCertif1cate of Birth"), (4, "Certif1cate of Birth\nx\ny\ncertificate of birth"), (5, None), (6, ""), (7, "rtificate of Deat\nz\nz\nz")]
    got = {r["i"]: (r["class"]["type"], r["class"]["top"]) for r in split.classified(spark.createDataFrame(texts, "i int, text string")).where("text is not null").collect()}
    assert got == {1: ("BIRTH", 6.0), 2: ("BIRTH", 6.0), 3: ("OTHER", 0.0), 4: ("BIRTH", 3.0), 6: ("OTHER", 0.0), 7: ("DEATH", 6.0)}


def test_a_line_is_not_repeated_for_its_pairs(spark):
    line = "".join(chr(0x4E00 + i) for i in range(5000)) + " dat3 of birth"
    found = damaged_names(spark.createDataFrame([(line,)], "low string"), NAMES, 85.0)
    assert [(r["name"], r["at"]) for r in found.collect()] == [("date of birth", 5002)]
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def placed(names, lines, least):
    found = fuzzy.placed.func(pd.Series(names), pd.Series(lines), pd.Series([least] * len(lines)))
    return [None if pd.isna(r.at) else (int(r.at) - 1, int(r.length), float(r.ratio)) for r in found.itertuples(index=False)]


def test_few_windows_of_a_long_line_are_compared(monkeypatch):
    """Prose has the letters of a label everywhere; only what may be like it is compared."""
    rng, calls, common = random.Random(5), [], fuzzy._common
    prose = " ".join(rng.choice("the under issued licence of court date birth certified sentences language and in".split()) for _ in range(4000))
    line = prose[:12000] + " licens3d undor the " + prose[12000:]
    want = fuzzy.damaged_place("licensed under the", line, 85.0)
    monkeypatch.setattr(fuzzy, "_common", lambda *a: (calls.append(1), common(*a))[1])
    assert placed(["licensed under the"], [line], 85.0) == [want] and want[2] > 0.85
    assert len(calls) < len(line) / 10


def test_lines_counted_together_lose_no_window(monkeypatch):
    monkeypatch.setattr(fuzzy, "COUNTED", 0)
    monkeypatch.setattr(fuzzy, "TOGETHER", 300)
    asked = [(n, x) for x in sorted(set(lines())) for n in [*NAMES, "na\0me", "aaaa"] if x] + [("name", "na\0me \U0001F600\ud800 nme"), ("name", "name"), ("name", "nam")]
    for least in (100.0, 85.0, 66.7, 30.0):
        assert placed([n for n, _ in asked], [x for _, x in asked], least) == [fuzzy.damaged_place(n, x, least) for n, x in asked]


def test_classes_take_the_heading_that_was_cut(spark):
    """A class doesn't cut its text into lines again, and no regular expression is needed to cut one."""
    plan = split.classified(spark.createDataFrame([(1, "a\r\rb\r\n \nc")], "i int, text string"))._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan.partition("Join")[0] and "split(" in plan and "|[" not in plan
    assert spark.createDataFrame([("a\r\rb\r\n \nc\r",)], "text string").select(split.lines(split.F.col("text"))).first()[0] == ["a", "b", "c"]
