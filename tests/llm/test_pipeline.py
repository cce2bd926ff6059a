"""The pipeline's stages against plain Python, each on its own input, and on awkward rows."""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from rollkeep.llm import simhash, toxicity
from rollkeep.llm.decontaminate import remove_contaminated
from rollkeep.llm.mixing import mix_documents, mix_sources
from rollkeep.llm.sharding import shard_by_bytes

SF = "/root/testdata/sf0.01"
FORM = "doc_id long, text string, lang string, source string, n_chars long, _score double, _row long, _marks string, copies int"


@pytest.fixture(scope="module")
def rows(spark):
    """Documents, then nulls, empty texts, repeated rows and ids; columns named like those the stages add."""
    held = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(400).collect()]
    long = " ".join(f"w{i}" for i in range(30_000))
    odd = [(9001, None, None, None, None), (9002, "", None, "", 0), (None, "a text without an id", "en", "s", 1), (9003, held[0][1], "en", "s", 1), (9003, held[0][1], "en", "s", 1), (9004, long, "en", "s", 1), (9005, long + " end", "en", "s", 1)]
    return [(*r, 0.5, 7, "m", 3) for r in held + odd]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, FORM).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FORM)


def as_rows(df):
    return Counter(map(repr, map(tuple, df.collect())))


def test_toxic_documents_go(spark, rows, docs, empty):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    scored = {(r["doc_id"], r["score"]) for r in toxicity.score_toxicity(docs, labels).collect()}
    bad = {i for i, s in scored if s >= toxicity.THRESHOLD}
    got = toxicity.drop_toxic(docs, labels)
    assert got.columns == docs.columns and bad
    assert as_rows(got) == Counter(repr(r) for r in rows if r[0] not in bad)
    assert toxicity.drop_toxic(empty, labels).count() == 0
    assert toxicity.drop_toxic(docs, labels.limit(0)).count() == len(rows)


def similar(marks):
    """Components by comparing every pair: within the distance, and with a chain in one of the fingerprints."""
    n, root = len(marks), list(range(len(marks)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    def chained(x):
        seg = [x >> (48 - 16 * i) & 0xFFFF for i in range(4)]
        return any(not seg[i] and seg[(i + 1) % 4].bit_count() <= 1 and sum(seg[(i + j) % 4].bit_count() for j in range(3)) <= simhash.AHEAD for i in range(4))

    for i in range(n):
        apart = np.bitwise_count(marks[i] ^ marks[i + 1 :]).sum(axis=1)
        for j in np.flatnonzero(apart <= simhash.APART) + i + 1:
            if any(chained(int(x)) for x in marks[i] ^ marks[j]):
                a, b = find(i), find(int(j))
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_one_of_each_group_stays(rows, docs, empty):
    marks = simhash.similar_marks(pa.array([r[1] for r in rows], pa.large_string()), simhash.SHINGLE, simhash.PARTS)
    group = similar(marks)
    best = {}
    for g, r in zip(group, rows, strict=True):
        key = (r[0] is None, r[0] or 0)
        best[g] = min(best.get(g, (key, r)), (key, r), key=lambda x: x[0])
    got = simhash.keep_one(docs)
    assert got.columns == docs.columns
    assert as_rows(got) == Counter(repr(r) for _, r in best.values())
    assert simhash.keep_one(empty).count() == 0


def test_near_copies_are_found(spark):
    """Copies of long texts with some words changed: recall by similarity, and no two different texts are joined."""
    rng = np.random.default_rng(8)
    texts, pairs = [], []
    for _ in range(150):
        w = [f"v{x}" for x in rng.integers(0, 5000, 400)]
        v = list(w)
        for at in rng.choice(400, 4, replace=False):
            v[at] = "changed"
        pairs.append((len(texts), len(texts) + 1))
        texts += [" ".join(w), " ".join(v)]
    shingles = lambda t: {tuple(t.split()[i : i + 5]) for i in range(396)}
    assert all(0.88 < len(shingles(texts[a]) & shingles(texts[b])) / len(shingles(texts[a]) | shingles(texts[b])) < 0.95 for a, b in pairs)
    kept = {r["doc_id"] for r in simhash.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert all(a in kept for a, _ in pairs)
    assert sum(b not in kept for _, b in pairs) >= 0.7 * len(pairs)  # 0.80 when written: similarity 0.9 makes texts differ in 10% of the bits


def test_contaminated_documents_go(spark, rows, docs, empty):
    items = [(1, " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", rows[5][1])[3:14])), (2, None), (3, "w29999 END"), (None, "")]
    frame = spark.createDataFrame(items, "item_id long, text string")
    low = lambda t: " " + " ".join(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))) + " "
    windows = set()
    for _, t in items:
        w = low(t).split()
        windows |= {" " + " ".join(w[i : i + 10]) + " " for i in range(max(len(w) - 9, min(1, len(w))))}
    got = remove_contaminated(docs, frame)
    assert got.columns == docs.columns
    want = [r for r in rows if not any(x in low(r[1]) for x in windows)]
    assert as_rows(got) == Counter(map(repr, want)) and len(want) < len(rows)
    assert remove_contaminated(empty, frame).count() == 0
    assert remove_contaminated(docs, frame.limit(0)).count() == len(rows)


def test_mixed_documents_are_those_that_are_taken(rows, docs, empty):
    taken = Counter()
    for r in mix_sources(docs).collect():
        taken[r["doc_id"]] += r["taken"]
    got, size = mix_documents(docs), lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert got.columns == docs.columns
    words = Counter()
    for r in got.collect():
        words[r["doc_id"]] += size(r["text"])
    assert {k: v for k, v in words.items() if v} == {k: v for k, v in taken.items() if v}
    assert set(as_rows(got)) <= set(map(repr, rows))
    assert mix_documents(empty).count() == 0


def test_sharded_documents(rows, docs, empty):
    got = shard_by_bytes(docs).collect()
    assert Counter((r["doc_id"], r["size"]) for r in got) == Counter((r[0], len((r[1] or "").encode()) + 1) for r in rows)
    assert shard_by_bytes(empty).count() == 0


def test_run_applies_every_stage(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, SF).cache()
        assert docs.columns == columns and 500 < docs.count() < before
        before = docs.count()
    rows = corpus_pipeline.run(spark, SF).collect()
    ids = {r[0] for r in docs.select("doc_id").collect()}
    assert {r["doc_id"] for r in rows} <= ids and {r["shard"] for r in rows} == set(range(16))


def test_a_group_of_near_copies_does_not_make_all_its_pairs(spark, monkeypatch):
    nodes = spark.createDataFrame([(i, [5 | (1 << i - 1 if i else 0) << 16]) for i in range(17)], "node long, marks array<long>")
    made, kept = [], simhash.materialize

    def seen(df):
        out = kept(df)
        made.extend([out.count()] if df.columns == ["a", "b", "chain"] else [])
        return out

    monkeypatch.setattr(simhash, "materialize", seen)
    assert {r["root"] for r in simhash.roots(nodes).collect()} == {0}
    assert sum(made) < 17 * 4


def test_no_similar_pair_is_left_out(spark, docs, rows):
    """The stage's groups hold every pair of texts that shares 80 of a hundred of its shingles, at the threshold itself and in crowds."""
    rng = np.random.default_rng(5)
    texts = [r[1] for r in rows]
    for k in range(120):
        w = [f"{'ab'[k % 2]}{x}" for x in rng.integers(0, 3000, int(rng.integers(5, 200)))]
        v = w + [f"new{x}" for x in range(len(w) // int(rng.integers(4, 7)))]
        texts += [" ".join(w), " ".join(v)]
    texts += [" ".join(f"n{i}" for i in range(13)), " ".join(f"n{i}" for i in range(11)) + " x y", " ".join(f"m{i}" for i in range(14)), " ".join(f"m{i}" for i in range(12))]  # of 9 and 10 shingles; 8 of 10 shared
    line = [f"often{i}" for i in range(60)]
    texts += [" ".join(line[:at] + [f"own{at}"] + line[at + 1 :]) for at in range(60)]
    texts += [" ".join(line * 2 + [f"end{i}" for i in range(k)]) for k in range(20)]

    def shingles(t):
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(1, len(w))))}

    sets, near = [shingles(t) for t in texts], []
    for i, a in enumerate(sets):
        near += [(i, j) for j in range(i) if 100 * len(a & sets[j]) >= 80 * len(a | sets[j])]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    stage = {r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, frame, SF).collect()}
    by_marks = similar(simhash.similar_marks(pa.array(texts, pa.large_string()), simhash.SHINGLE, simhash.PARTS))
    root = list(by_marks)
    for a, b in near:
        old, new = max(root[a], root[b]), min(root[a], root[b])
        root = [new if r == old else r for r in root]
    assert sum(by_marks[a] != by_marks[b] for a, b in near) > 20  # those that fingerprints leave out
    assert stage == {min(i for i, r in enumerate(root) if r == g) for g in set(root)}
