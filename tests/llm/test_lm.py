"""The language model: base columns and scores against plain Python, what each part of the mixing is worth, and rare words."""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from rollkeep.llm import lm
from rollkeep.llm.words import NOT_SPACE, blocks

SF = "/root/testdata/sf0.01"
FORM = "doc_id long, text string, score string, row int"


def words(t):
    return re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))


@pytest.fixture(scope="module")
def rows(spark):
    held = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(250).collect()]
    odd = [(9001, None), (9002, ""), (9003, " \n\t"), (9004, "Ünï " * 3000), (9005, "x" * 5000), (9006, "a b c a b c A B D"), (None, "no id"), (9006, "a b c a b c A B D"), (9007, held[0][1])]
    return [(*r, "x", 1) for r in held + odd]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, FORM).repartition(3).cache()


def learned(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 5 != 1


def check_base(rows, got):
    count, tokens = Counter(), {}
    for i, t, *_ in rows:
        tokens[i, len(words(t)) + 1] = words(t) + [None]
        if learned(i):
            count.update(words(t) + [None])
    n, v = sum(count.values()), len(count)
    assert len(got) == len(rows)
    for r in got:
        t = tokens[r["doc_id"], r["n_tokens"]]
        assert r["train_tokens"] == n and r["n_known"] == sum(count[w] > 0 for w in t) and r["held_out"] != learned(r["doc_id"])
        assert math.isclose(r["base_score"], sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t), rel_tol=1e-9)
        assert r["score"] < 0 and math.isclose(r["bits_per_byte"], -r["score"] * math.log2(10) / (sum(len(w.encode()) + 1 for w in t[:-1]) + 1), rel_tol=1e-9)


def test_base_columns(spark, rows, docs, monkeypatch):
    check_base(rows, lm.score_texts(docs).collect())
    monkeypatch.setattr(lm, "FREQUENT", 64)
    check_base(rows, lm.score_texts(docs).collect())
    assert lm.score_texts(spark.createDataFrame([], FORM)).count() == 0
    alone = lm.score_texts(spark.createDataFrame([(6, "some words", "", 0)], FORM).where("crc32(string(doc_id)) % 5 = 1")).collect()
    assert all(r["n_known"] == 0 for r in alone)


class Held:
    def __init__(self, value):
        self.value = value


@pytest.fixture(scope="module")
def fitted(rows):
    """A model fitted without Spark, by the functions that tasks run."""
    batch = lambda texts: iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])])
    texts = [t for i, t, *_ in rows if learned(i)]
    count = Counter()
    pairs = np.zeros(lm.STATES * lm.STATES, dtype=np.int64)
    for r in lm.count_words(batch(texts)):
        if r.column("pair")[0].as_py():
            pairs[r.column("token").to_numpy()] += r.column("n").to_numpy()
        else:
            count.update(dict(zip(r.column("token").to_pylist(), r.column("n").to_pylist(), strict=True)))
    token, n = (np.array(x) for x in zip(*sorted(count.items()), strict=True))
    counts = lm.Counts.of(token, n, float(n.sum() + 0.5 * (len(n) + 1)), pairs.reshape(lm.STATES, -1))
    bits = 16
    flat = np.zeros(2 * lm.N_CONTEXTS << bits, dtype=np.float32)
    for r in lm.count_bits(Held(counts), bits)(batch(texts)):
        k, width = r.column("chunk")[0].as_py(), 1 << lm.CHUNK_BITS
        flat[k * width : (k + 1) * width] = np.frombuffer(pa.decompress(r.column("counts")[0].as_py(), decompressed_size=4 * width, codec="zstd", asbytes=True), dtype=np.int32)
    weight, table = lm.first_weights(), flat.reshape(-1, 2)
    width = weight.shape[1]
    total = np.zeros(lm.N_GATES * width * (width + 1))
    for r in lm.newton_sums(Held(counts), Held((table, weight)), bits, width)(batch(texts)):
        total[r.column("at").to_numpy()] += r.column("value").to_numpy()
    lm.newton_step(weight, total.reshape(lm.N_GATES, width, width + 1))
    return counts, table, lm.Model.of(bits, table, weight), texts


def read_plainly(model, r, text):
    """One text, unit by unit: weights, odds and refinement follow after the bits of a word code or a byte."""
    cost = 0.0
    for lane in range(r.t.first[text], r.t.first[text + 1], lm.LANE):
        bits = r.bits(np.arange(lane, min(lane + lm.LANE, r.t.first[text + 1])), model.slot_bits, True)
        weight = model.weight.astype(float).copy()
        odds = np.stack([lm.HITS, lm.MISSES], axis=1)
        refined = np.zeros((3, lm.STEPS + 1))
        for unit in range(bits.unit[-1] + 1):
            new_odds, low_steps, high_steps = odds.copy(), [], []
            for i in np.flatnonzero(bits.unit == unit):
                one, said, run = int(bits.bit[i]), int(bits.guess[i]), int(bits.run[i])
                guesses = [float(model.stretch[s]) for s in bits.slots[:, i]]
                seen = int(np.float32(guesses[-1]).view(np.uint32)) & 3
                gate = int(bits.kind[i]) * 3 + (0 if seen == 0 else 1 if seen < 3 else 2) + (lm.N_GATES if said else 0)
                x = [*guesses, said * math.log(odds[run][0] / odds[run][1]) if said else 0.0, 1.0]
                z = max(-lm.REACH, min(lm.REACH, sum(a * b for a, b in zip(weight[gate], x, strict=True))))
                p = 1 / (1 + math.exp(-z))
                weight[gate] += lm.RATE * (one - p) * np.array(x)
                place = (z + lm.REACH) * lm.STEPS / (2 * lm.REACH)
                low = min(int(place), lm.STEPS - 1)
                part, row = place - low, 0 if not said else 2 if run >= 2 else 1
                below, above = refined[row][low], refined[row][low + 1]
                final = 1 / (1 + math.exp(-(z + lm.SHARE * ((1 - part) * below + part * above))))
                low_steps.append((row, low, below + lm.REFINE * (1 - part) * (one - final)))
                high_steps.append((row, low + 1, above + lm.REFINE * part * (one - final)))
                cost += math.log(final if one else 1 - final)
                if said:
                    which = 0 if (said > 0) == bool(one) else 1
                    new_odds[run][which] = odds[run][which] + 0.25
            odds = new_odds
            for row, at, value in low_steps + high_steps:
                refined[row][at] = value
    return cost


def test_scores_equal_plain_mixing(fitted):
    counts, _, model, texts = fitted
    some = [texts[0], None, "a b c a b c a b c unseen unseen a b", texts[3], "zq" * 900, *texts[5:9], "word " * 3000]
    (b,) = blocks(pa.array(some, pa.string()), NOT_SPACE, lm.BLOCK)
    r = lm.Reading.of(b, counts)
    got = lm.read(model, r)
    for i in range(len(some) - 1):
        assert math.isclose(got[i], read_plainly(model, r, i), rel_tol=2e-3)
    for i, t in enumerate(some):  # and don't depend on what else is read
        (alone,) = blocks(pa.array([t], pa.string()), NOT_SPACE, lm.BLOCK)
        assert math.isclose(lm.read(model, lm.Reading.of(alone, counts))[0], got[i], rel_tol=1e-5)


def test_odds_are_counts_of_what_came_before(fitted):
    """The guess of the expected word, worked out for all bits at once, is what following the odds unit by unit gives."""
    counts, _, model, texts = fitted
    (b,) = blocks(pa.array([texts[0], "a b c a b c a b d unseen unseen a b", "", "zq zq zr " * 90], pa.string()), NOT_SPACE, lm.BLOCK)
    r = lm.Reading.of(b, counts)
    bits = r.bits(np.arange(len(r.t.token)), model.slot_bits, True)
    head = np.flatnonzero(np.diff(bits.unit, prepend=-1))
    lane_of = np.searchsorted(bits.first[r.t.first], head, side="right") - 1
    which = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(bits.bit))))
    got = lm.expected_guess(bits, head, lane_of, which)
    odds = {}
    for u in range(len(head)):
        mine = odds.setdefault((lane_of[u], bits.run[head[u]]), [lm.HITS[bits.run[head[u]]], lm.MISSES[bits.run[head[u]]]])
        came = set()
        for i in np.flatnonzero(which == u):
            assert math.isclose(got[i], bits.guess[i] * math.log(mine[0] / mine[1]), rel_tol=1e-5, abs_tol=1e-6)
            if bits.guess[i]:
                came.add(0 if (bits.guess[i] > 0) == (bits.bit[i] > 0) else 1)
        for w in came:
            mine[w] += 0.25
    assert (got != 0).any() and len(odds) > 4


def test_every_bit_is_counted(fitted):
    counts, table, model, texts = fitted
    (b,) = blocks(pa.array(texts, pa.string()), NOT_SPACE, 1 << 30)
    r = lm.Reading.of(b, counts)
    bits = r.bits(np.arange(len(r.t.token)), model.slot_bits, True)
    for k in range(lm.N_CONTEXTS):
        part = table[k << model.slot_bits : (k + 1) << model.slot_bits]
        assert part.sum(axis=0).tolist() == [int((bits.bit == 0).sum()), int((bits.bit == 1).sum())]
    # What the bits of a token spell tells it from all others.
    spelled = {}
    for i in range(0, len(r.t.token), 7):
        code = "".join(map(str, bits.bit[bits.first[i] : bits.first[i + 1]]))
        assert spelled.setdefault(code, r.t.token[i]) == r.t.token[i]
    assert len(set(spelled.values())) == len(spelled)


def test_what_each_part_is_worth(rows, fitted, monkeypatch):
    """Adapting weights and expected words make texts that weren't learned likelier; refinement costs little where there is nothing to refine."""
    counts, _, model, _ = fitted
    some = [t for i, t, *_ in rows if t and not learned(i)] + ["one two three four five six " * 40]
    (b,) = blocks(pa.array(some, pa.string()), NOT_SPACE, lm.BLOCK)
    r = lm.Reading.of(b, counts)
    whole = lm.read(model, r)
    with monkeypatch.context() as m:
        m.setattr(lm, "RATE", 0.0)
        assert lm.read(model, r).sum() < whole.sum()
    with monkeypatch.context() as m:
        m.setattr(lm, "SHARE", 0.0)
        assert abs(lm.read(model, r).sum() / whole.sum() - 1) < 1e-3
    with monkeypatch.context() as m:  # weights that are wrong throughout leave something to refine
        m.setattr(lm, "RATE", 0.0)
        off = lm.Model(model.slot_bits, model.stretch, model.weight * np.float32(0.5))
        plain = lm.read(off, r).sum() if m.setattr(lm, "SHARE", 0.0) is None else None
        m.setattr(lm, "SHARE", 1.0)
        assert lm.read(off, r).sum() > plain
    blind = lm.Reading(r.b, r.t, r.code, r.length, r.contexts, np.full_like(r.last, -1), r.run, r.spelled, r.kind, r.more)
    assert lm.read(model, blind)[-1] < 2 * whole[-1]


def test_held_out_prose_is_likelier_than_by_the_base(spark):
    held = lm.score_texts(spark.read.parquet(f"{SF}/documents.parquet")).where("held_out").collect()
    assert len(held) > 150 and sum(r["score"] for r in held) > sum(r["base_score"] for r in held) + 0.1 * sum(r["n_tokens"] for r in held)


def test_codes_are_prefix_codes():
    for code, length in ((lm.CODE, lm.CODE_LENGTH), lm.prefix_code(np.array([5.0, 1, 1, 9, 2, 7]))):
        codes = [format(b, f"0{n}b") for b, n in zip(code, length, strict=True)]
        assert len(set(codes)) == len(codes) and not any(a != b and b.startswith(a) for a in codes for b in codes)


def test_what_is_read_together_is_bounded_in_bits(fitted):
    """Neither long words nor many unseen ones make a group large, and sizes are what the bits turn out to be."""
    counts, _, model, texts = fitted
    some = ["x" * 200_000, " ".join(f"unseen{i}q" for i in range(20000)), *texts[:20], "", "é" * 65 + " " + "y" * 64]
    (b,) = blocks(pa.array(some, pa.string()), NOT_SPACE, 1 << 30)
    r = lm.Reading.of(b, counts)
    bits, units = r.sizes()
    parts = list(r.parts())
    assert np.concatenate(parts).tolist() == list(range(len(bits)))
    assert bits.max() < 1000 and max(int(bits[p].sum()) for p in parts) <= lm.COUNTED
    for p in parts[:2]:
        got = r.bits(p, model.slot_bits, True)
        assert (np.diff(got.first) == bits[p]).all() and got.unit[-1] + 1 == units[p].sum()


def test_parts_of_words_are_told_from_words(fitted):
    counts, _, model, _ = fitted
    a = "k" * lm.LONGEST
    (b,) = blocks(pa.array([a + "z", a + " z"], pa.string()), NOT_SPACE, lm.BLOCK)
    r = lm.Reading.of(b, counts)
    spelled = ["".join(map(str, r.bits(np.arange(x, y), model.slot_bits, False).bit)) for x, y in zip(r.t.first, r.t.first[1:], strict=False)]
    assert spelled[0] != spelled[1] and not spelled[0].startswith(spelled[1]) and not spelled[1].startswith(spelled[0])


def test_classes_follow_who_follows_whom():
    pairs = np.zeros((lm.STATES, lm.STATES), dtype=np.int64)
    rng = np.random.default_rng(3)
    for group in (range(1, 20), range(20, 45), range(100, 130)):
        for i in group:
            for j in group:
                pairs[i, j] = rng.integers(5, 50)
    pairs[3, 25] = 2
    got = lm.classes_of(pairs)
    assert len(set(got[1:20])) == len(set(got[20:45])) == len(set(got[100:130])) == 1 and len(set(got)) == 4 and got[0] == 0
    assert (lm.classes_of(np.zeros_like(pairs)) == 0).all()


def test_equal_tokens_are_counted_and_fitted_once(fitted):
    """Word codes with equal contexts are one unit, and the sums are those of all bits, taken one by one."""
    counts, table, model, texts = fitted
    batch = lambda: iter([pa.RecordBatch.from_arrays([pa.array([*texts[:40], *texts[:40], "zq" * 90, None], pa.string())], names=["text"])])
    some = list(lm.units_once(batch(), counts))
    (b,) = blocks(next(batch()).column("text"), NOT_SPACE, 1 << 30)
    r = lm.Reading.of(b, counts)
    words = [(u, n) for u, n in some if u.most == lm.WORD_BITS]
    assert sum(int(n.sum()) for _, n in words) == len(r.t.token) and sum(len(n) for _, n in words) <= len(r.t.token) // 2
    assert sum(int((u.length * n).sum()) for u, n in some) == r.sizes()[0].sum()

    weight = lm.first_weights()
    width = weight.shape[1]
    got, want = (np.zeros((lm.N_GATES, width, width + 1)) for _ in range(2))
    for s in lm.newton_sums(Held(counts), Held((table, weight)), model.slot_bits, width)(batch()):
        got.reshape(-1)[s.column("at").to_numpy()] += s.column("value").to_numpy()
    bits = r.bits(np.arange(len(r.t.token)), model.slot_bits, False)
    for i in range(len(bits.bit)):
        one = int(bits.bit[i])
        zeros, ones = np.maximum(table[bits.slots[:, i]].astype(float).T - [[1 - one], [one]], 0)
        seen, x = zeros[-1] + ones[-1], np.append(lm.stretched(zeros, ones), 1.0)
        gate = int(bits.kind[i]) * 3 + (0 if seen == 0 else 1 if seen < 3 else 2)
        p = 1 / (1 + math.exp(-float(weight[gate] @ x)))
        want[gate, :, :width] += np.outer(x, x) * max(p * (1 - p), 1e-4)
        want[gate, :, width] += x * (one - p)
    assert np.abs(got - want).max() < 1e-3 * np.abs(want).max() and (np.abs(got - want) < 1e-3 * np.abs(want) + 0.05).all()


def test_long_codes_cost_what_their_bits_cost(fitted, monkeypatch):
    """Products of probabilities are cut, so that no unit leaves the range of a number."""
    counts, _, model, texts = fitted
    (b,) = blocks(pa.array(texts[:9], pa.string()), NOT_SPACE, lm.BLOCK)
    whole = lm.read(model, lm.Reading.of(b, counts))
    monkeypatch.setattr(lm, "HALF", 8)
    assert int(lm.Reading.of(b, counts).length.max()) > lm.HALF and np.allclose(lm.read(model, lm.Reading.of(b, counts)), whole, rtol=1e-9)
