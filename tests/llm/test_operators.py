"""Each operator against plain Python, on sample rows and on awkward ones."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from rollkeep.llm import chroma, toxicity
from rollkeep.llm import words as words_of
from rollkeep.llm.decontaminate import decontaminate
from rollkeep.llm.mixing import mix_sources
from rollkeep.llm.sharding import shard_by_bytes
from rollkeep.llm.simhash import near_duplicates
from rollkeep.llm.substring import remove_repeats

SF = "/root/testdata/sf0.001"
FORM = "doc_id long, text string, lang string, source string, n_chars long, size long, k1 string, _fp string"
LONG = " ".join(f"w{i % 977}x{i}" for i in range(60000))


def low(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or ""))


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", t or "")


@pytest.fixture(scope="module")
def rows(spark):
    """Sample documents, then nulls, empty and very long texts, repeated rows and ids; columns with clashing names."""
    held = [tuple(r) + (1, "x", None) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").orderBy("doc_id").limit(150).collect()]
    tail = LONG[:3000]
    odd = [(9001, None, None, None, None), (9002, "", None, "", 0), (9003, " \n\t ", None, "src0", 4), (9004, LONG, "en", "src1", len(LONG)), (9005, tail + " end of it", "en", "src1", 1), (9006, "Ünï ÀB idiot x\x00y", "en", "src2", 1), (9005, tail + " end of it", "en", "src1", 1), (9007, held[0][1], "en", "src9", 1)]
    return held + [o + (1, "x", None) for o in odd]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, FORM).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], FORM)


def test_winnowing_takes_the_leftmost_smallest():
    rng = np.random.default_rng(2)
    a = rng.integers(0, 4, 300).astype(np.uint64)
    for width in (1, 2, 3, 7, 16, 35):
        assert words_of.sliding_argmin(a, width).tolist() == [i + int(np.argmin(a[i : i + width])) for i in range(len(a) - width + 1)]


def test_sharding(rows, docs, empty):
    got = shard_by_bytes(docs, 4).collect()
    assert sorted((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert shard_by_bytes(empty).count() == 0
    for s in {r["shard"] for r in got}:
        assert sorted(r["slot"] for r in got if r["shard"] == s) == list(range(sum(r["shard"] == s for r in got)))


def test_shards_are_even_and_keep_groups(spark):
    data = [(i, f"text {i % 700} " * (i % 700 % 9 + 1)) for i in range(2000)] + [(i, "same text") for i in range(5000, 6500)]
    got = shard_by_bytes(spark.createDataFrame(data, "doc_id long, text string"), 8).collect()
    sizes = Counter()
    for r in got:
        sizes[r["shard"]] += r["size"]
    assert len(sizes) == 8 and max(sizes.values()) < 1.15 * min(sizes.values())
    where = {}
    for r in got:
        where.setdefault(r["text_crc32"], set()).add(r["shard"])
    assert sum(len(v) > 1 for k, v in where.items() if k != zlib.crc32(b"same text")) == 0


def test_mixing(rows, docs, empty):
    got = mix_sources(docs).collect()
    size = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    order = sorted((s for s in size if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    weight = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}
    target, capped = {}, set()
    while True:
        rate = (sum(size.values()) - 3 * sum(size[s] for s in capped)) / max(1, sum(weight[s] for s in order if s not in capped))
        more = {s for s in order if s not in capped and weight[s] * rate > 3 * size[s]}
        if not more:
            break
        capped |= more
    target = {s: 3 * size[s] if s in capped else weight[s] * rate for s in order}
    source = {(r[0], len(words(r[1]))): r[3] for r in rows}
    taken, largest = Counter(), Counter()
    for r in got:
        s = source[r["doc_id"], r["size"]]
        assert r["source_size"] == size[s] and math.isclose(r["target"], target[s])
        assert 0 <= r["taken"] <= 3 * r["size"] and (r["size"] == 0 or r["taken"] % r["size"] == 0)
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - target[s]) <= 1.5 * largest[s] + 1e-6 for s in order)
    assert sorted(map(tuple, got), key=repr) == sorted(map(tuple, mix_sources(docs.repartition(5)).collect()), key=repr)
    assert mix_sources(empty).count() == 0


def test_decontamination(spark, rows, docs, empty):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, None), (None, "Unseen"), (901, "end OF it"), (902, " ".join(words(rows[3][1])[2:30])), (903, "ünï"), (902, "!!!")]
    got = {(r["doc_id"], r["n_words"]): r for r in decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
    form, windows = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"), {}
    for i, t in items:
        w = form.findall(low(t))
        for j in range(max(len(w) - 9, min(len(w), 1))):
            windows.setdefault(tuple(w[j : j + 10]), set()).add("" if i is None else str(i))
    seen = 0
    for r in rows:
        w, hit, ids = form.findall(low(r[1])), set(), set()
        for n in {len(k) for k in windows}:
            for j in range(len(w) - n + 1):
                if (k := tuple(w[j : j + n])) in windows:
                    hit |= set(range(j, j + n))
                    ids |= windows[k]
        g = got[r[0], len(w)]
        assert (g["n_hit"], g["n_items"], g["items_sha256"], g["contaminated"]) == (len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), bool(hit))
        seen += bool(hit)
    assert seen >= 3
    assert decontaminate(empty, spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert not any(r["contaminated"] for r in decontaminate(docs.limit(20), spark.createDataFrame([], "item_id long, text string")).collect())


def check_repeats(rows, docs):
    got = {(r["doc_id"], r["n_words"]): r for r in remove_repeats(docs).collect()}
    first: dict = {}
    for r in sorted(rows, key=lambda r: r[0]):
        w = words(r[1])
        cover = [False] * len(w)
        for j in range(len(w) - 49):
            if first.setdefault(tuple(w[j : j + 50]), r[0]) < r[0]:
                cover[j : j + 50] = [True] * 50
        kept = " ".join(x for x, c in zip(w, cover, strict=True) if not c)
        g = got[r[0], len(w)]
        assert (g["n_removed"], g["kept_sha256"]) == (sum(cover), hashlib.sha256(kept.encode()).hexdigest())
    assert got[9007, len(words(rows[0][1]))]["n_removed"] > 0


def test_substring(rows, docs, empty):
    check_repeats(rows, docs)
    assert remove_repeats(empty).count() == 0


def test_substring_with_colliding_hashes(spark, rows, monkeypatch):
    """Hashes of 5 bits: different spans look the same, and only their words tell them apart."""
    from rollkeep.llm import substring

    few = [r for r in rows if len(words(r[1])) < 400][:60] + [r for r in rows if r[0] in (9005, 9007)] + [rows[0]]

    def weak(of, at):
        def run(batches):
            for batch in of(batches):
                yield batch.set_column(at, batch.schema.names[at], pa.array(np.asarray(batch.column(at)) & 31))

        return run

    monkeypatch.setattr(substring, "runs", weak(weak(substring.runs, 2), 3))
    check_repeats(few, spark.createDataFrame(few, FORM))


def _mark(t):
    w = words(low(t))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), seed=42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def _components(ids, marks):
    root = list(range(len(ids)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    a = np.array(marks, dtype=np.uint64)
    for i in range(len(a)):
        for j in np.flatnonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= 3) + i + 1:
            x, y = find(i), find(int(j))
            root[max(x, y)] = min(x, y)
    least = {}
    for i, k in enumerate(ids):
        least[find(i)] = min(k, least.get(find(i), k))
    return [least[find(i)] for i in range(len(ids))]


def test_simhash(rows, docs, empty):
    got = {r["doc_id"]: r for r in near_duplicates(docs).collect()}
    marks = [_mark(r[1]) for r in rows]
    assert all(got[r[0]]["fingerprint"] == f"{m:016x}" for r, m in zip(rows, marks, strict=True))
    assert [got[r[0]]["component_id"] for r in rows] == _components([r[0] for r in rows], marks)
    assert near_duplicates(empty).count() == 0


def test_simhash_dense_groups(spark, monkeypatch):
    """Fingerprints in dense balls and chains, with the block path forced."""
    from rollkeep.llm import simhash

    rng = np.random.default_rng(5)
    marks = set()
    for c in rng.integers(0, 1 << 62, 12):
        at = int(c)
        for _ in range(40):
            marks.add(at)
            for _ in range(int(rng.integers(1, 5))):
                at ^= 1 << int(rng.integers(0, 63))
            marks.add(at)
    marks = sorted(marks)
    df = spark.createDataFrame([(m, [m]) for m in marks], "node long, marks array<long>")
    want = _components(marks, marks)
    for hot, block in ((64, 256), (2, 3)):
        monkeypatch.setattr(simhash, "HOT", hot)
        monkeypatch.setattr(simhash, "BLOCK", block)
        got = {r["node"]: r["root"] for r in simhash.roots(df).collect()}
        assert [got[m] for m in marks] == want


def test_similar_marks_against_plain_counting(rows):
    """Each bit of each fingerprint is what most shingles say."""
    from rollkeep.llm import simhash
    from rollkeep.llm.words import NOT_SPACE, blocks, mix, prefix_hash, span_hash

    texts = [r[1] for r in rows[:40]] + [None, "", "One", "one", "a b c d e"]
    got = simhash.similar_marks(pa.array(texts, pa.large_string()), 5, 3)
    for i, t in enumerate(texts):
        (b,) = blocks(pa.array([t], pa.string()), NOT_SPACE, 1 << 30)
        h, n = b.hashes(lower=True), len(b.start)
        spans = [(j, min(j + 5, n)) for j in range(max(1, n - 4))] if n else []
        grams = [int(span_hash(prefix_hash(h), np.array([x]), np.array([y]))[0]) for x, y in spans]
        for k in range(3):
            each = [int(mix(np.array([g], dtype=np.uint64) + np.uint64(k))[0]) for g in grams]
            assert got[i, k] == sum(1 << bit for bit in range(64) if 2 * sum(x >> bit & 1 for x in each) > len(each))
    assert (got[-3] == got[-2]).all() and not got[40:42].any()


def test_simhash_blocks_are_bounded_on_both_sides(spark, monkeypatch):
    """65 fingerprints share a key that thousands of others probe: no block holds more than its bound allows."""
    from rollkeep.llm import simhash

    base = 0x123456789ABCDEF0
    index = [base & ~0xFFFFFFFF | i * 0x10003 for i in range(65)]
    others = [(base ^ (1 << 32 + i % 16)) & ~0xFFFFFFFF | (i * 40503 & 0xFFFFFFFF) for i in range(1, 4000)]
    marks = sorted(set(index + others))
    plain = simhash._block_links(simhash.DISTANCE)
    monkeypatch.setattr(simhash, "BLOCK", 64)
    df = spark.createDataFrame([(m, [m]) for m in marks], "node long, marks array<long>")
    sizes = spark.sparkContext.accumulator(0)

    def watched(pdf):
        if len(pdf) > 64 * 8:
            sizes.add(1)
        return plain(pdf)

    monkeypatch.setattr(simhash, "_block_links", lambda distance: watched)
    got = {r["node"]: r["root"] for r in simhash.roots(df).collect()}
    assert [got[m] for m in marks] == _components(marks, marks) and sizes.value == 0


def _exploded_and_broadcast(plan):
    """Whether rows are exploded below a broadcast of a plan's text."""
    inside = None
    for line in plan.splitlines():
        depth = len(re.match(r"[\s:+\-*]*(\(\d+\))?\s*", line)[0])
        if inside is not None and depth <= inside:
            inside = None
        if inside is not None and "Generate explode" in line:
            return True
        if inside is None and "BroadcastExchange" in line:
            inside = depth
    return False


@pytest.mark.parametrize("parts", [1, 4])
def test_simhash_never_broadcasts_what_it_explodes(spark, monkeypatch, parts):
    """Spark sizes an explode by what goes in: few fingerprints would be broadcast with all their probes."""
    from rollkeep.llm import simhash

    rng, seen = np.random.default_rng(3), []
    base = 0x1234_5678_0000_0000
    marks = [base + i for i in range(8)] + rng.integers(0, 1 << 62, 3000).tolist()  # the first eight share a hot key
    kept = simhash.materialize
    df = kept(spark.createDataFrame([(m, [m + k for k in range(parts)]) for m in marks], "node long, marks array<long>"))
    monkeypatch.setattr(simhash, "materialize", lambda df: (seen.append(df._jdf.queryExecution().executedPlan().toString()), kept(df))[1])
    out = simhash.links(df, 3 * parts)
    seen.append(out._jdf.queryExecution().executedPlan().toString())
    assert any("Generate explode" in x and "Join" in x for x in seen) and any("BlockLinks" in x or "FlatMapGroupsInPandas" in x for x in seen)
    assert not any(map(_exploded_and_broadcast, seen))


def test_toxicity(spark, docs, empty):
    d = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    truth = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    got = [r for r in toxicity.score_toxicity(d, labels).collect() if r["doc_id"] in truth]
    for r in got[:100]:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7)
    held = [r for r in got if r["held_out"]]
    found = sum(r["predicted"] and truth[r["doc_id"]] for r in held)
    assert found >= 0.85 * sum(truth[r["doc_id"]] for r in held)
    assert found >= 0.95 * sum(r["predicted"] for r in held)
    odd = toxicity.score_toxicity(docs, labels)
    assert odd.count() == docs.count() and odd.where("score is null").count() == 0
    assert toxicity.score_toxicity(empty, labels).count() == 0
    assert {r["score"] for r in toxicity.score_toxicity(docs, labels.limit(0)).collect()} == {0.5}


def test_scores_keep_the_share_of_toxic_labels(spark):
    """A term that stands in 40% of toxic and 10% of clean texts; one text in ten is toxic."""
    data = [(i, int(i % 10 == 0), f"plain words {i}" + (" meh" if (i // 10) % 10 < 4 and i % 10 == 0 or i % 10 == 1 and (i // 10) % 10 < 9 else "")) for i in range(3000)]
    docs, labels = spark.createDataFrame([(i, t) for i, _, t in data], "doc_id long, text string"), spark.createDataFrame([(i, k) for i, k, _ in data], "doc_id long, toxic int")
    for bound in (8000, 300):
        score = {r["doc_id"]: r["score"] for r in toxicity.add_scores(docs, toxicity.fit(docs, labels, bound), "score").collect()}
        assert abs(sum(score.values()) / len(score) - 0.1) < 0.05
        assert all(score[i] < toxicity.THRESHOLD for i, _, t in data if "meh" in t)


def test_fit_keeps_terms_that_tell_only_together(spark):
    """An insult or a group alone is as often toxic as any text; together they always are, apart never."""
    rng = np.random.default_rng(11)
    filler = [f"word{i}" for i in range(300)]
    data = []
    for i in range(1600):
        a, b = rng.random(2) < 0.5
        text = list(rng.choice(filler, 12)) + ["zorgs"] * int(a) + ["blemmy"] * int(b)
        data.append((i, " ".join(rng.permutation(text)), int(a == b)))
    docs, labels = spark.createDataFrame([r[:2] for r in data], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in data], "doc_id long, toxic int")
    for bound in (8000, 1000):
        score = {r["doc_id"]: r["score"] for r in toxicity.add_scores(docs, toxicity.fit(docs, labels, bound), "score").collect()}
        assert sum((score[i] >= 0.5) == bool(k) for i, _, k in data) >= 0.95 * len(data)


def test_sample_is_bounded_in_rows(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(500)] + [(2, "other"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1), (4, 1)], "doc_id long, toxic int")
    assert sorted(map(tuple, toxicity.labelled_sample(docs, labels, 10).collect())) == [("", 0), ("other", 0), ("text 0", 1)]


def test_machine_learns_pairs():
    """Neither term alone tells; both together do."""
    rng = np.random.default_rng(0)
    rows, label = [], []
    for _ in range(400):
        a, b = rng.random(2) < 0.5
        rows.append((np.flatnonzero([a, b, True]), np.ones(int(a) + int(b) + 1)))
        label.append(float(a == b))
    m = toxicity.fit_machine(np.arange(3, dtype=np.uint64), rows, np.array(label), epochs=200, seed=3)
    s = m.scores(4, np.array([0, 0, 0, 1, 1, 2, 2, 3]), np.array([0, 1, 2, 0, 2, 1, 2, 2]), np.ones(8))
    assert s[0] > 0.7 and s[3] > 0.7 and s[1] < 0.3 and s[2] < 0.3







def test_chroma(spark):
    rng = np.random.default_rng(3)
    base = {i: chroma.melody(rng.normal(size=64)) for i in range(60)}
    rows = [(i, chroma.write_wave(x, chroma.RATE)) for i, x in base.items()]
    for k in (0, 50):
        y = base[k][5000:]
        rows += [(1000 + k, chroma.write_wave(y + rng.normal(0, 0.02, len(y)), chroma.RATE)), (2000 + k, rows[k][1])]
    rows += [(3000, None), (3050, b"no wave"), (3100, chroma.write_wave(np.zeros(10), 4096))]
    got = chroma.align(spark.createDataFrame(rows, "id long, audio binary"), chroma.F.expr("id % 50 = 0 and id < 1000 or id >= 3000")).collect()
    assert {(r["query_id"], r["class_id"]) for r in got} == {(0, 1000), (50, 1050)}
    assert all(r["error_rate"] < 0.05 and r["offset"] in (-19, -20) for r in got)


def test_integral_image_filters_are_stable():
    x = chroma.melody(np.linspace(-1, 1, 64))
    a, b = chroma.fingerprint(x, chroma.RATE), chroma.fingerprint(0.3 * x, chroma.RATE)
    assert np.bitwise_count(a ^ b).mean() < 1


def brute_matches(queries, recordings):
    """(query, recording, least bit error) of all pairs that any phase and offset brings within ERRORS."""
    out = {}
    for q, x in queries.items():
        for r, b in recordings.items():
            for p in chroma.PHASES:
                a = chroma.fingerprint(x[p:], chroma.RATE)
                for off in range(-30, 4):
                    lo, hi = max(0, -off), min(len(a), len(b) - off)
                    if hi - lo >= chroma.OVERLAP:
                        rate = float(np.bitwise_count(a[lo:hi] ^ b[lo + off : hi + off]).sum()) / (32 * (hi - lo))
                        if rate <= chroma.ERRORS and rate < out.get((q, r), 1.0):
                            out[q, r] = rate
    return out


def test_chroma_recall(spark):
    """Of what brute force finds among noisy cut copies at least 0.9 is found, nearly all under a tenth of bits in error."""
    rng = np.random.default_rng(9)
    base = {50 * i: chroma.melody(rng.normal(size=64)) for i in range(25)}
    heard = {i: chroma.read_wave(chroma.write_wave(x, chroma.RATE))[0] for i, x in base.items()}
    rows, codes, want = [(i, chroma.write_wave(x, chroma.RATE)) for i, x in base.items()], {}, {}
    for i, x in base.items():
        for k, noise in enumerate((0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4)):
            cut = x[int(rng.integers(0, 6000)) :]
            rows.append((10_001 + i + k, chroma.write_wave(cut + rng.normal(0, noise, len(cut)), chroma.RATE)))
            codes[rows[-1][0]] = chroma.fingerprint(*chroma.read_wave(rows[-1][1]))
            want |= brute_matches({i: heard[i]}, {rows[-1][0]: codes[rows[-1][0]]})
    got = {(r["query_id"], r["id"]) for r in chroma.align_members(spark.createDataFrame(rows, "id long, audio binary"), chroma.F.expr("id < 10000")).collect()}
    assert len(want) > 100 and len(got & set(want)) >= 0.9 * len(want)
    near = {k for k, rate in want.items() if rate < 0.1}
    assert len(got & near) >= 0.95 * len(near)


def test_chroma_of_nothing_and_of_stillness(spark):
    empty = spark.createDataFrame([], "id long, audio binary, key string")
    assert chroma.align_members(empty, chroma.F.expr("id % 50 = 0")).count() == 0
    still = [(i, chroma.write_wave(np.zeros(40000 + 300 * i), chroma.RATE), "k") for i in (0, 1, 2)]
    got = chroma.align_members(spark.createDataFrame(still, "id long, audio binary, key string"), chroma.F.expr("id % 50 = 0")).collect()
    assert {r["id"] for r in got} == {1, 2} and all(r["error_rate"] == 0 for r in got)
    marks = pa.RecordBatch.from_arrays([pa.array([7]), pa.array([[5] * 108], pa.list_(pa.int64()))], names=["class_id", "codes"])
    assert sum(len(b) for b in chroma.held_keys(iter([marks]))) == chroma.TABLES * -(-100 // chroma.REPEATED)


def test_chroma_names_every_copy(spark):
    rng = np.random.default_rng(4)
    base = {i: chroma.write_wave(chroma.melody(rng.normal(size=64)), chroma.RATE) for i in (0, 7, 50)}
    cut = chroma.write_wave(chroma.read_wave(base[0])[0][5000:], chroma.RATE)
    rows = [*base.items(), (101, base[0]), (102, base[0]), (103, cut), (104, cut)]
    got = chroma.align_members(spark.createDataFrame(rows, "id long, audio binary"), chroma.F.expr("id % 50 = 0")).collect()
    assert {(r["query_id"], r["class_id"], r["id"]) for r in got} == {(0, 0, 101), (0, 0, 102), (0, 103, 103), (0, 103, 104), (50, None, None)}
    assert len(got) == 5 and all(r["error_rate"] == 0 and r["offset"] == 0 for r in got if r["class_id"] == 0)



