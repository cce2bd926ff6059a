"""The filter audit against plain Python."""

from __future__ import annotations

import itertools
import math
import re

import numpy as np
import pytest

from rollkeep.llm import audit

SF = "/root/testdata/sf0.001"
FORM = "doc_id long, text string, source string, part string, mask int, digest string, good int"


def failures(rows):
    least = {}
    for d, t, *_ in rows:
        if d is not None:
            least[t or ""] = min(d, least.get(t or "", d))
    out = []
    for d, t, s, *_ in rows:
        t = t or ""
        w = re.findall("[^\x20\x09-\x0d]+", t)
        fails = {f for f, bad in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), bool(re.search("[#$%&*|]", t)), d is not None and d > least[t]), strict=True) if bad}
        out.append((s or "", d, fails))
    return out


def expected(rows, labels):
    good, toxic = ({d for d, *x in labels if d is not None and x[i] == 1} for i in (0, 1))
    held, out = failures(rows), {}
    for part in {p for p, *_ in held}:
        docs = [(d, f) for p, d, f in held if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = docs
            for step, f in enumerate(order, 1):
                gone = [d for d, x in left if f in x]
                left = [(d, x) for d, x in left if f not in x]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), sum(f in x for _, x in docs) - len(gone), sum(x == {f} for _, x in docs), sum(d in good for d in gone), sum(d in toxic for d in gone)]
        for (p, order, step), v in out.items():
            if p == part:
                v.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def got(df):
    return {(r["part"], r["filter_order"], r["step"]): tuple(r[c] for c in "kept removed redundant unique_fails good_lost toxic_lost shapley".split()) for r in df.collect()}


def test_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source").orderBy("doc_id").limit(120).collect()
    extra = (None, None, None, None)
    rows = [(r[0], r[1], "x" if r[0] % 3 else None, *extra) for r in docs]
    rows += [(5000, None, None, *extra), (5001, "", "", *extra), (5001, "", "y", *extra), (None, "", "y", *extra), (None, None, "y", *extra), (4000, rows[0][1], "y", *extra), (4001, rows[0][1], "y", *extra), (4001, rows[0][1], "y", *extra)]
    rows += [(6000 + i, "same words " * 40 + "100%", "hot", *extra) for i in range(300)] + [(7000, "ABC " + "w " * 200000, "x", *extra)]
    labels = [(r["doc_id"], r["quality"], r["toxic"]) for r in spark.read.parquet(f"{SF}/labels.parquet").collect()] + [(4001, 1, 1), (4001, 0, 0), (6001, 1, 0), (6002, None, 1), (None, 1, 1), (99999, 1, 1)]
    df, marks = spark.createDataFrame(rows, FORM).repartition(4), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    want = expected(rows, labels)
    assert len(want) == 600 * len({k[0] for k in want})
    assert got(audit.filter_audit(df, marks)) == want
    assert audit.filter_audit(spark.createDataFrame([], FORM), marks).count() == 0
    nothing = got(audit.filter_audit(df, marks.limit(0)))
    assert {k: v[:4] for k, v in nothing.items()} == {k: v[:4] for k, v in want.items()} and not any(v[4] or v[5] for v in nothing.values())


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 6])
def test_the_walk_visits_all_orders_by_single_swaps(n):
    seen, before = set(), None
    for order, swap in audit.walk(n):
        if before is not None:
            turned = before.copy()
            turned[swap], turned[swap + 1] = turned[swap + 1], turned[swap]
            assert turned == order
        before = order.copy()
        seen.add(tuple(order))
    assert len(seen) == math.factorial(n)


def test_other_sets_of_filters():
    cells = np.random.default_rng(3).integers(0, 9, (3, 8))
    rows = audit.audit_orders(cells, "XYZ")
    assert len(rows["step"]) == 18 and set(rows["filter_order"]) == {"".join(p) for p in itertools.permutations("XYZ")}
    assert rows["kept"][rows["step"] == 3].tolist() == [cells[0, 0]] * 6
