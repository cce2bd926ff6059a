from __future__ import annotations

import random
from statistics import median

from rollkeep.operators import layout

WORDS = "document_id long, page_number long, text string, x0 double, y0 double, x1 double, y1 double, line_key string, order long"


def frame(spark, words):
    rows = [(1, 1, *w, None, None) if len(w) == 5 else (1, 1, *w) if len(w) == 7 else w for w in words]
    return spark.createDataFrame([(*r[:3], *map(float, r[3:7]), *r[7:]) for r in rows], WORDS)


def text_of(spark, words):
    return [r["text"] for r in layout.lines(frame(spark, words)).orderBy("line").collect()]


def test_lines_and_blocks(spark):
    words = [("Birth", 0.1, 0.10, 0.2, 0.12), ("Certificate", 0.21, 0.101, 0.4, 0.121), ("Name:", 0.1, 0.13, 0.2, 0.15), ("Ali", 0.22, 0.13, 0.3, 0.15), ("Foot", 0.1, 0.5, 0.2, 0.52), (" ", 0.1, 0.7, 0.2, 0.72)]
    got = [(r["line"], r["block"], r["text"]) for r in layout.lines(frame(spark, words).drop("line_key", "order")).orderBy("line").collect()]
    assert got == [(0, 0, "Birth Certificate"), (1, 0, "Name: Ali"), (2, 1, "Foot")]


def test_right_to_left(spark):
    assert text_of(spark, [("نام", 70, 10, 80, 12), ("علی", 50, 10, 60, 12)]) == ["نام علی"]
    # Two columns of a leftward row, the number in a column of its own goes with the row.
    assert text_of(spark, [("نام", 80, 10, 88, 20), ("علی", 70, 10, 78, 20), ("42", 10, 10, 18, 20)]) == ["نام علی 42"]
    # A label and its value in columns of either direction.
    assert text_of(spark, [("Name", 0, 10, 20, 20), ("of", 22, 10, 30, 20), ("علی", 100, 10, 120, 20), ("احمد", 124, 10, 140, 20)]) == ["Name of احمد علی"]


def test_runs_against_the_direction(spark):
    # From the left: Born, two Urdu words with a number between them, and an English word.
    row = [("Born", 0, 0, 10, 10), ("لاہور", 12, 0, 20, 10), ("1947", 22, 0, 30, 10), ("میں", 32, 0, 40, 10), ("only", 42, 0, 50, 10)]
    assert text_of(spark, row) == ["Born میں 1947 لاہور only"]
    # A number at the edge of such a stretch stays where the line has it.
    assert text_of(spark, row[:3] + row[4:]) == ["Born لاہور 1947 only"]


def test_spaces_follow_the_gap(spark):
    assert text_of(spark, [("42", 0, 0, 10, 10), (",", 10.5, 0, 12, 10), ("x", 13, 0, 20, 10)]) == ["42, x"]


def test_engines_order_within_runs(spark):
    # The engine gives the Urdu run from right to left.
    words = [("a", 0, 0, 5, 10, "1", 0), ("b", 7, 0, 12, 10, "1", 1), ("اول", 40, 0, 45, 10, "2", 2), ("دوم", 30, 0, 35, 10, "2", 3)]
    assert text_of(spark, words) == ["a b اول دوم"]
    assert text_of(spark, [w[:5] for w in words]) == ["a b اول دوم"]
    assert text_of(spark, [(w[0], *w[1:5], w[5], 9 - w[6]) for w in words]) == ["b a دوم اول"]


def expected(words):
    """The rules word by word in plain Python, for words without an engine's order."""
    kind = lambda t: None if not any(c.isalpha() for c in t) else sum("؀" <= c <= "ۿ" for c in t if c.isalpha()) * 2 > sum(map(str.isalpha, t))
    groups = []
    for w in sorted(words, key=lambda w: ((w[2] + w[4]) / 2, w[1], w[3], w[2], w[0])):
        for g in groups[::-1][:3]:
            top, bottom = min(x[2] for x in g), max(x[4] for x in g)
            low, common = min(w[4] - w[2], bottom - top), min(w[4], bottom) - max(w[2], top)
            if (common >= 0 if low <= 0 else max(common, 0) / low >= 0.5):
                g.append(w)
                break
        else:
            groups.append([w])
    groups = sorted(groups, key=lambda g: (min(x[2] for x in g), min(x[1] for x in g)))
    tall = median([h for g in groups if (h := max(x[4] for x in g) - min(x[2] for x in g)) > 0] or [0])
    out, block, bottom = [], 0, None
    for g in groups:
        high = median([w[4] - w[2] for w in g if w[4] > w[2]] or [1])
        columns = []
        for w in sorted(g, key=lambda w: (w[1], w[3], w[2], w[0])):
            if columns and max(w[1] - columns[-1][-1][3], columns[-1][-1][1] - w[3], 0) <= 3 * high:
                columns[-1].append(w)
            else:
                columns.append([w])
        read, bases = [], []
        for c in columns:
            kinds = [kind(w[0]) for w in c]
            base = next((k for k in kinds if k is not None), None)
            bases.append(base)
            if base:
                c, kinds = c[::-1], kinds[::-1]
            left = [next((k for k in kinds[:i][::-1] if k is not None), base) for i in range(len(c))]
            right = [next((k for k in kinds[i + 1 :] if k is not None), base) for i in range(len(c))]
            against = [base is not None and (k != base if k is not None else left[i] != base and right[i] != base) for i, k in enumerate(kinds)]
            row, held = [], []
            for w, a in zip([*c, None], [*against, False], strict=True):
                if a:
                    held.insert(0, w)
                    continue
                row, held = row + held + ([w] if w else []), []
            text = row[0][0]
            for p, w in zip(row, row[1:], strict=False):
                size = min(w[4] - w[2] if w[4] > w[2] else high, p[4] - p[2] if p[4] > p[2] else high)
                text += (" " if max(w[1] - p[3], p[1] - w[3], 0) > 0.08 * size else "") + w[0]
            read.append(text)
        if [b for b in bases if b is not None] and all(b for b in bases if b is not None):
            read.reverse()
        top = min(x[2] for x in g)
        block += bottom is not None and tall > 0 and top - bottom > 1.6 * tall
        bottom = max(x[4] for x in g)
        out.append((block, " ".join(read)))
    return out


def test_random_pages_as_plain_python(spark):
    rng, pages, rows = random.Random(4), {}, []
    for page in range(60):
        words = []
        for _ in range(rng.randrange(1, 40)):
            x, y, high = rng.randrange(0, 400, 3), rng.choice((rng.randrange(0, 200), 30 * rng.randrange(7))), rng.choice((0, 6, 10, 14))
            words.append((rng.choice(("Name", "of", "علی", "نام", "42", "-", "x9", "لاہور")), float(x), float(y), float(x + rng.randrange(4, 40)), float(y + high)))
        pages[page] = words
        rows += [(7, page, *w, None, None) for w in words]
    got = {}
    for r in layout.lines(frame(spark, rows).repartition(4)).orderBy("page_number", "line").collect():
        got.setdefault(r["page_number"], []).append((r["block"], r["text"]))
    assert got == {p: expected(w) for p, w in pages.items()}


def test_tasks_are_bounded_in_words(spark, monkeypatch):
    """Pages are dealt by the number of words, laid out where they are, and never joined with their lines."""
    monkeypatch.setattr(layout, "WORDS_A_TASK", 50)
    rows = [(7, page, f"w{k}", 20.0 * k, 0.0, 20.0 * k + 15, 10.0, None, None) for page in range(100) for k in range(10)]
    placed = layout.placed_words(frame(spark, rows))
    plan = placed._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange hashpartitioning") == 1
    assert placed.rdd.getNumPartitions() == 20
    assert max(len(part) for part in placed.rdd.glom().collect()) <= 150
    assert layout.lines(frame(spark, rows)).count() == 100


def test_empty(spark):
    assert layout.lines(frame(spark, [])).count() == 0
    assert layout.lines(frame(spark, [(None, None, "a", 0.0, 0.0, 1.0, 1.0, None, None), (None, None, None, 0.0, 0.0, 1.0, 1.0, None, None)])).count() == 1
