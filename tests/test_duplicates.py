"""Duplicate candidates against plain Python, over workspaces, blank names and crowded numbers."""

from __future__ import annotations

import random

import pytest

from rollkeep.operators import counts, duplicates, search, split
from rollkeep.sources import scratch

FORM = "id long, workspace_id int, type_id string, name_key string, event_date string, number_key string, registration_key string, status string, created_at int"


def by_number(a, b):
    return b[5] == a[5] != "" or a[6] != "" and a[6] in (b[6], b[5])


def by_person(a, b):
    return a[3] != "" and a[2:5] == b[2:5] and a[5] != b[5]


def candidates(a, entries, agrees):
    found = [b for b in entries if b[0] != a[0] and b[1] == a[1] and b[7] != "VOID" and agrees(a, b)]
    return sorted(found, key=lambda b: (b[8], b[0]))[:20]


@pytest.fixture(scope="module")
def entries():
    rng = random.Random(7)
    rows = [(i, rng.randrange(2), rng.choice("AB"), rng.choice(["", "ann", "bob"]), rng.choice(["2001-01-01", "2002-02-02"]), f"n{rng.randrange(40)}", rng.choice(["", f"n{rng.randrange(40)}", "r1"]), rng.choice(["ACTIVE", "VOID"]), rng.randrange(50)) for i in range(300)]
    crowd = [(1000 + i, 0, "A", "carol", "2003-03-03", "x1" if i < 70 else f"y{i % 3}", "", "ACTIVE", i) for i in range(120)]
    return rows + crowd


def test_candidates(spark, entries):
    df = spark.createDataFrame(entries, FORM)
    for found, agrees in ((duplicates.same_number, by_number), (duplicates.same_person, by_person)):
        assert sorted(map(tuple, found(df).collect())) == sorted((a[0], b[0]) for a in entries for b in candidates(a, entries, agrees))


def test_classified(spark, entries):
    want = []
    for a in entries:
        number, person = candidates(a, entries, by_number), candidates(a, entries, by_person)
        both = [(b, True) for b in number] + [(b, False) for b in person if b not in number]
        ranked = sorted(both, key=lambda x: (not (x[1] and x[0][2] == a[2]), x[0][2] != a[2]))[:20]
        want += [(a[0], b[0], "same_name_and_event_date" if not n else "same_number" if b[2] == a[2] else "same_number_other_type", n and b[2] == a[2], i + 1) for i, (b, n) in enumerate(ranked)]
    got = [tuple(r) for r in duplicates.classified(spark.createDataFrame(entries, FORM)).collect()]
    assert sorted(got) == sorted(want)


def test_serials_of_large_and_null_batches(spark):
    rows = [(i, None if i % 10 == 0 else i % 10 // 7, (i * 37) % 1000) for i in range(1000)]
    got = counts.serials(spark.createDataFrame(rows, "id long, batch int, at int"), "batch", ["at", "id"]).collect()
    for batch in (None, 0, 1):
        mine = sorted((r for r in got if r["batch"] == batch), key=lambda r: (r["at"], r["id"]))
        assert [r["serial"] for r in mine] == list(range(1, len(mine) + 1))


def test_every_title_is_a_heading(spark):
    titles = ["Certificate of Birth", "DEATH CERTIFICATE", "Nikah Nama", "Certificate of  Registration of Marriage", "سرٹیفکیٹ", "Certified copy of a marriage"]
    df = spark.createDataFrame(list(enumerate(titles)), "i int, text string")
    assert [r[0] for r in df.orderBy("i").select(split.has_heading(df["text"])).collect()] == [True] * 5 + [False]


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key, default):
            return default

    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = Conf(), Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())


def test_keys_are_made_once(spark):
    entries = spark.createDataFrame([(i, 1, "t", "2020-01-01", f"N-{i % 3}", f"R {i}", "Ann Lee", "ACTIVE", i) for i in range(6)], "id long, workspace_id int, type_id string, event_date string, number string, registration_number string, primary_name string, status string, created_at int")
    keyed = search.with_keys(entries)
    for found, n in ((duplicates.same_number(keyed), 6), (duplicates.same_person(keyed), 24), (duplicates.classified(keyed), 30)):
        assert "EvalPython" not in found._jdf.queryExecution().toString() and found.count() == n
