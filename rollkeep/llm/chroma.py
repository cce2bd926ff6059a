"""Operator 5: audio fingerprints from pitch-class frames, and recordings aligned by them."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rollkeep.llm.storage import lean_batches, materialize

#: Samples of a frame and from frame to frame, and the frequencies that count as pitches.
FRAME, HOP, LOWEST, HIGHEST = 1024, 256, 55.0, 1760.0
#: Frames and pitch classes that each of the 16 filters covers: (kind, first class, classes, frames).
#: Kinds compare halves: 0 low and high classes, 1 early and late frames, 2 the diagonal quarters, 3 the middle third of the classes with the rest.
FILTERS = [(k, c, h, w) for k, c, h, w in ((0, 0, 6, 8), (0, 3, 6, 4), (0, 6, 6, 8), (1, 0, 3, 8), (1, 3, 3, 8), (1, 6, 3, 8), (1, 9, 3, 8), (1, 0, 12, 4), (2, 0, 4, 8), (2, 4, 4, 8), (2, 8, 4, 8), (2, 2, 8, 4), (3, 0, 6, 4), (3, 3, 6, 8), (3, 6, 6, 4), (3, 0, 12, 8))]
SPAN = 8
#: What counts as the same recording: votes for one offset, frames that overlap, and the share of bits that differ.
VOTES, OVERLAP, ERRORS = 3, 16, 0.15
#: A landmark is a code and the one a span later; keys are these many bits of its 64, in so many choices. A query also asks for the keys
#: with its least certain bits turned, all ways of so many. Where a landmark repeats, a recording is found by one in so many.
KEY_BITS, TABLES, TURNED, REPEATED = 42, 3, 4, 8
#: A query is fingerprinted from these samples on, so that one of them falls near the frames of a recording cut anywhere.
PHASES = (0, 64, 128, 192)


def read_wave(data: bytes | None) -> tuple[np.ndarray, int]:
    """Mono samples in [-1, 1] and the rate of a PCM16 recording; nothing of what can't be read."""
    try:
        with wave.open(io.BytesIO(data or b"")) as w:
            if w.getsampwidth() != 2:
                return np.zeros(0), 1
            samples = np.frombuffer(w.readframes(w.getnframes()), dtype="<i2").reshape(-1, w.getnchannels())
            return samples.mean(axis=1) / 32768, w.getframerate()
    except (wave.Error, EOFError, ValueError):
        return np.zeros(0), 1


def write_wave(samples: np.ndarray, rate: int) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes((np.clip(samples, -1, 1) * 32767).astype("<i2").tobytes())
    return out.getvalue()


def pitch_classes(samples: np.ndarray, rate: int) -> np.ndarray:
    """The energy of the 12 pitch classes in each frame, each frame scaled to length 1."""
    n = (len(samples) - FRAME) // HOP + 1
    if n <= 0:
        return np.zeros((0, 12))
    frames = np.lib.stride_tricks.sliding_window_view(samples, FRAME)[::HOP][:n]
    energy = np.abs(np.fft.rfft(frames * np.hanning(FRAME), axis=1)) ** 2
    frequency = np.fft.rfftfreq(FRAME, 1 / rate)
    heard = (frequency >= LOWEST) & (frequency <= HIGHEST)
    note = np.round(12 * np.log2(frequency[heard] / 440)).astype(int) % 12
    out = energy[:, heard] @ np.eye(12)[note]
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def fingerprint(samples: np.ndarray, rate: int) -> np.ndarray:
    """One 32-bit number for each place of the filters: 16 filters of 2 bits, over an integral image."""
    return fingerprint_margins(samples, rate)[0]


def fingerprint_margins(samples: np.ndarray, rate: int) -> tuple[np.ndarray, np.ndarray]:
    """The codes, and how far each of their bits (the lowest first) is from turning."""
    image = pitch_classes(samples, rate)
    n = len(image) - SPAN + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32), np.zeros((0, 32))
    total = np.zeros((len(image) + 1, 13))
    total[1:, 1:] = image.cumsum(axis=0).cumsum(axis=1)
    t = np.arange(n)

    def area(t0: int, t1: int, c0: int, c1: int) -> np.ndarray:
        return total[t + t1, c1] - total[t + t0, c1] - total[t + t1, c0] + total[t + t0, c0]

    out, margin = np.zeros(n, dtype=np.uint32), np.zeros((n, 32))
    for f, (k, c, h, w) in enumerate(FILTERS):
        whole = area(0, w, c, c + h)
        if k == 0:
            part = area(0, w, c, c + h // 2)
        elif k == 1:
            part = area(0, w // 2, c, c + h)
        elif k == 2:
            part = area(0, w // 2, c, c + h // 2) + area(w // 2, w, c + h // 2, c + h)
        else:
            part = area(0, w, c + h // 3, c + h - h // 3)
        value = np.log((part + 0.02) / (whole - part + 0.02))
        level = np.digitize(value, (-0.4, 0.4, 1.6))  # empty areas, at 0, lie well within a level
        out = (out << np.uint32(2)) | (level ^ (level >> 1)).astype(np.uint32)  # neighbouring levels differ in one bit
        margin[:, 31 - 2 * f], margin[:, 30 - 2 * f] = np.abs(value - 0.4), np.minimum(np.abs(value + 0.4), np.abs(value - 1.6))
    return out, margin


def fingerprints(audio: str, phases: tuple[int, ...] = (0,)):
    """Arrow function: (id, phase, codes) of the recordings in a column of PCM16 WAV bytes, from some first samples on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("id"), batch.column(audio), strict=True):
                samples, rate = read_wave(x.as_py())
                codes = [fingerprint(samples[p:], rate).astype(np.int64) for p in phases]
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(phases), pa.int64()), pa.array(phases, pa.int32()), pa.array(codes, pa.list_(pa.int64()))], names=["id", "phase", "codes"])

    return run


def bit_errors(a: Column, b: Column, offset: Column) -> tuple[Column, Column]:
    """(frames, bits that differ) where code i of ``a`` stands against code i + offset of ``b``."""
    lo, hi = F.greatest(F.lit(0), -offset), F.least(F.size(a), F.size(b) - offset)
    frames = F.greatest(hi - lo, F.lit(0)).cast("int")
    pairs = F.zip_with(F.slice(a, (lo + 1).cast("int"), frames), F.slice(b, (lo + offset + 1).cast("int"), frames), lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return frames, F.aggregate(pairs, F.lit(0).cast("long"), lambda s, x: s + x)


def key_places() -> list[np.ndarray]:
    """The bits of a landmark that each choice keeps: the same in every run."""
    rng = np.random.default_rng(1)
    return [np.sort(rng.choice(64, KEY_BITS, replace=False)) for _ in range(TABLES)]


def landmarks(codes: np.ndarray) -> np.ndarray:
    """Each code with the one a filter's span later, as one 64-bit number.

    One code alone is shared by chance so often that such meetings would grow with the
    square of the recordings; two codes over different frames seldom are.
    """
    c = codes.astype(np.uint64)
    return (c[:-SPAN] << np.uint64(32)) | c[SPAN:] if len(c) > SPAN else np.zeros(0, dtype=np.uint64)


def _rows(names: tuple[str, str, str, str], owner: list, at: list, table: list, key: list) -> pa.RecordBatch:
    columns = [np.concatenate(x) if x else np.zeros(0, dtype=np.int64) for x in (owner, at, table, key)]
    return pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1].astype(np.int32)), pa.array(columns[2].astype(np.int32)), pa.array(columns[3])], names=list(names))


def held_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(class_id, j, t, key): the keys of recordings with codes. Of a run of equal landmarks each REPEATED-th counts, so that a
    constant stretch doesn't meet another at all places."""
    places = key_places()
    for batch in batches:
        for lo in range(0, len(batch), 256):
            owner, at, table, key = [], [], [], []
            part = batch.slice(lo, 256)
            for i, codes in zip(part.column("class_id").to_pylist(), part.column("codes").to_pylist(), strict=True):
                marks = landmarks(np.array(codes, dtype=np.int64))
                new = np.ones(len(marks), dtype=bool)
                new[1:] = marks[1:] != marks[:-1]
                place = np.arange(len(marks))
                kept = np.flatnonzero((place - np.maximum.accumulate(np.where(new, place, 0))) % REPEATED == 0)
                for t, bits in enumerate(places):
                    owner.append(np.full(len(kept), i))
                    at.append(kept)
                    table.append(np.full(len(kept), t))
                    key.append((marks[kept] & np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))).view(np.int64))
            yield _rows(("class_id", "j", "t", "key"), owner, at, table, key)


def asked_keys(audio: str, phases: tuple[int, ...]):
    """Arrow function: (asked_id, phase, i, t, key): the keys of queries, with their least certain bits as they are and turned."""
    places = key_places()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, x in zip(batch.column("id").to_pylist(), batch.column(audio), strict=True):
                samples, rate = read_wave(x.as_py())
                for phase in phases:
                    codes, margin = fingerprint_margins(samples[phase:], rate)
                    marks = landmarks(codes)
                    owner, at, table, key = [], [], [], []
                    both = np.concatenate([margin[SPAN:], margin[:-SPAN]], axis=1) if len(marks) else np.zeros((0, 64))
                    for t, bits in enumerate(places):
                        least = bits[np.argsort(both[:, bits], axis=1, kind="stable")[:, :TURNED]].astype(np.uint64)
                        plain = marks & np.bitwise_or.reduce(np.uint64(1) << bits.astype(np.uint64))
                        for way in range(1 << TURNED):
                            turned = np.zeros(len(marks), dtype=np.uint64)
                            for b in range(TURNED):
                                if way >> b & 1:
                                    turned |= np.uint64(1) << least[:, b]
                            owner.append(np.full(len(marks), i))
                            at.append(np.arange(len(marks)))
                            table.append(np.full(len(marks), t))
                            key.append((plain ^ turned).view(np.int64))
                    rows = _rows(("asked_id", "i", "t", "key"), owner, at, table, key)
                    yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(np.full(len(rows), phase, dtype=np.int32)), *rows.columns[1:]], names=["asked_id", "phase", "i", "t", "key"])

    return run


def _aligned(recordings: DataFrame, queries: Column, audio: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The readable recordings (id, key, codes), their classes (key, class_id, codes), and what :func:`align` returns with the query's key."""
    lean_batches(recordings.sparkSession)
    form = "id long, phase int, codes array<long>"
    codes = recordings.select("id", audio).mapInArrow(fingerprints(audio), form).drop("phase")
    found = materialize(codes.where(F.size("codes") > 0).withColumn("key", F.sha2(F.array_join(F.col("codes").cast("array<string>"), ","), 256)))
    classes = materialize(found.groupBy("key").agg(F.min("id").alias("class_id"), F.first("codes").alias("codes")))
    # Queries of equal bytes share the work; others of one class may differ in the other phases.
    sounds = recordings.where(queries).select("id", F.sha2(audio, 256).alias("sound"))
    mine = materialize(found.where(queries).select("id", "key").distinct().join(classes.select("key", "class_id"), "key").join(sounds, "id").select(F.col("id").alias("query_id"), F.col("class_id").alias("query_class"), "key", "sound"))
    one = materialize(mine.groupBy("query_class", "sound").agg(F.min("query_id").alias("id")))
    asked = mine.join(one.withColumnRenamed("id", "asked_id"), ["query_class", "sound"])
    heard = materialize(recordings.where(queries).select("id", F.sha2(audio, 256).alias("sound"), audio).join(one, ["id", "sound"]).dropDuplicates(["id", "sound"]).select("id", audio))
    phased = heard.mapInArrow(fingerprints(audio, PHASES), form)
    wanted = materialize(phased.join(one.select("id", "query_class"), "id").select(F.col("id").alias("asked_id"), "query_class", "phase", F.col("codes").alias("query_codes")))
    at = heard.mapInArrow(asked_keys(audio, PHASES), "asked_id long, phase int, i int, t int, key long").join(one.select(F.col("id").alias("asked_id"), "query_class"), "asked_id")
    among = classes.select("class_id", "codes").mapInArrow(held_keys, "class_id long, j int, t int, key long")
    votes = at.join(among, ["t", "key"]).where("query_class <> class_id").groupBy("asked_id", "class_id", "phase", (F.col("j") - F.col("i")).alias("offset")).agg(F.count("*").alias("votes"))
    best = votes.groupBy("asked_id", "class_id").agg(F.max(F.struct("votes", -F.abs("offset"), "offset", "phase")).alias("b")).where(F.col("b.votes") >= VOTES)
    pairs = best.select("asked_id", "class_id", F.col("b.offset").alias("offset"), F.col("b.phase").alias("phase"), F.col("b.votes").alias("votes")).join(wanted, ["asked_id", "phase"]).join(classes.select("class_id", "codes"), "class_id")
    frames, errors = bit_errors(F.col("query_codes"), F.col("codes"), F.col("offset"))
    checked = pairs.select("asked_id", "class_id", "offset", frames.alias("frames"), "votes", errors.alias("errors"))
    rated = checked.withColumn("error_rate", F.col("errors") / (32 * F.col("frames"))).where((F.col("frames") >= OVERLAP) & (F.col("error_rate") <= ERRORS))
    return found, classes, asked.join(rated, "asked_id", "left").select("query_id", "query_class", "class_id", "offset", "frames", "votes", "errors", "error_rate", "key")


def align(recordings: DataFrame, queries: Column, audio: str = "audio") -> DataFrame:
    """Where the recordings that meet ``queries`` (a condition on id) recur among all recordings.

    Recordings with equal fingerprints form a class named by its smallest id. Pairs of
    codes that a query and a class share vote for an offset; the offset with most votes is checked by
    bit errors over the whole overlap. Returns query_id, query_class, class_id, offset
    (frames), frames, votes, errors and error_rate; the query's own class is left out, and a
    query that nothing else matches has one row with nulls. For the members of the classes
    see :func:`align_members`.
    Recordings that can't be read or are too short have no codes and match nothing.
    """
    return _aligned(recordings, queries, audio)[2].drop("key")


def align_members(recordings: DataFrame, queries: Column, audio: str = "audio") -> DataFrame:
    """:func:`align` with a row for each recording that matches, named by ``id``.

    All members of a matched class are there, and so are the other members of the query's
    own class: at offset 0 without errors, and without votes as none were needed. A query
    that no other recording matches has one row with nulls.
    """
    found, classes, met = _aligned(recordings, queries, audio)
    met = materialize(met)
    members = found.select("id", "key").join(classes.select("key", "class_id"), "key").select("id", "class_id")
    others = met.where("class_id is not null").drop("key").join(members, "class_id")
    length = classes.select(F.col("class_id").alias("query_class"), F.size("codes").alias("frames"))
    none = F.lit(0).cast("long")
    own = met.select("query_id", "query_class").distinct().join(length, "query_class").join(members.withColumnRenamed("class_id", "query_class"), "query_class").where("id <> query_id")
    own = own.select("query_id", "query_class", F.col("query_class").alias("class_id"), F.lit(0).alias("offset"), "frames", F.lit(None).cast("long").alias("votes"), none.alias("errors"), F.lit(0.0).alias("error_rate"), "id")
    both = materialize(others.select(*own.columns).unionByName(own))
    alone = met.select("query_id", "query_class").distinct().join(both.select("query_id").distinct(), "query_id", "left_anti")
    return both.unionByName(alone, allowMissingColumns=True).select("query_id", "query_class", "class_id", "id", "offset", "frames", "votes", "errors", "error_rate")


RATE, NOTE = 4096, 512


def melody(vector: np.ndarray) -> np.ndarray:
    """A recording of a vector: one short note for each number, its pitch by the number's size."""
    v = np.nan_to_num(np.asarray(vector, dtype=float))
    step = np.clip(np.floor((v / max(np.abs(v).max(initial=0), 1e-9) + 1) * 18), 0, 36)
    phase = np.cumsum(np.repeat(110 * 2 ** (step / 12), NOTE)) * (2 * np.pi / RATE)
    return 0.5 * np.sin(phase)


def melodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, audio): WAV recordings of a vector column."""
    for batch in batches:
        for i in range(0, len(batch), 64):
            part = batch.slice(i, 64)
            waves = [write_wave(melody(np.array(v.as_py() or [], dtype=float)), RATE) for v in part.column("vector")]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(waves, pa.binary())], names=["id", "audio"])
