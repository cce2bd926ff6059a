"""Operator 6: personal data by fixed patterns and a linear-chain conditional random field."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rollkeep.llm.storage import lean_batches
from rollkeep.llm.words import NOT_SPACE, Block, blocks, split_words

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))

# Fixed patterns; a match of the last three lies within a run of RUN bytes. A match of IP that
# starts within a run of digits would start at the run's beginning as well.
LOCAL = b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(rb"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(rb"(?<![0-9])[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)")
CARD = re.compile(rb"[0-9](?:[\x20-]?[0-9])++")
PHONE = re.compile(rb"\+[0-9][\x20().0-9-]+[0-9]")

DIGIT = np.array([0x30 <= b <= 0x39 for b in range(256)])
RUN = np.array([chr(b) in "0123456789 ().+-" for b in range(256)])
MARKED = np.array([0x30 <= b <= 0x39 or chr(b) == "@" for b in range(256)])
#: What stands for an @ in labelled addresses, and the gap of a shortened IPv6 address.
SPELLED_AT = re.compile(rb"[(\[{<]at[)\]}>]|::", re.I)

#: The small labelled table: kind in brackets before what belongs to it. Lines without brackets are decoys.
TRAINING = """
call me at [phone:(415) 555-0137] after six
my number is [phone:(020) 555-9921] thanks
phone [phone:212-555-0188] or write
tel. [phone:030 5550 1234] office
mobile [phone:0171-555-2233] evenings
fax [phone:(044) 555-8710] please
ring [phone:617.555.0142] today
contact us on [phone:+1 (303) 555-7713] any time
she gave [phone:+44 20 5550 1234] as her number
write to [email:maria.lopez@mail.example.com] soon
mail [email:j_doe+news@example.org] for details
send it to [email:info@localhost] now
e-mail [email:anna(at)example.net] please
address [email:bob[at]mail.example.org] only
host [ip:192.168.10.24] is down
from [ip:10.0.0.1] port
server at [ip:203.0.113.77] answered
address [ip:2001:db8::8a2e:370:7334] replied
paid with [card:4111 1111 1111 1111] yesterday
card [card:5500000000000004] was refused
visa [card:4012-8888-8888-1881] expires
card number [card:378282246310005] on file
the meeting is on 2024-05-17 at noon
version 2.0.1 of the licence
License, Version 2.0.
under CC BY-NC 4.0.
order 48291 shipped
invoice 2023-000481 was paid
serial 9807915762804490 of the device
number 4417744280351548 in the list
item 1234567890123 in stock
from 1914 to 1918 in the war
it costs 1,299.50 in all
at 14:35 we left
chapter 3 page 271
release 10.4.3.900 is out
build 300.200.100.400 failed
section 12.3.4 applies
the score was 3-2 at last
room 555-A on floor 7
in 2019 there were 4520 of them
ratio 16:9 and 4:3
user@ home
@handle said so
100% of 20 cases
about 7 of 10 people
pages 120-135 and 201
ISBN 978-3-16-148410-0 in print
tracking 1Z999AA10123456784 left
born 1998 in the 12 districts
"""

#: Words whose features are held at once, and words that are decoded together (a longer sequence alone).
STEPS, TOGETHER = 256, 1 << 14
CUES = set("call number phone tel tel. mobile fax ring contact mail e-mail email write address host server from card visa ip version license, serial order invoice isbn chapter page section release build".split())
_EDGE = "([{<\"'"
_TRAIL = ".,;:!?)]}>\"'"


def luhn(digits: bytes) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        d -= 48
        if i % 2:
            d = d * 2 - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(word: bytes) -> Iterator[tuple[int, int]]:
    """Spans of e-mail addresses, leftmost first: around each @ the longest local part after the last match, and a domain."""
    done, at = 0, word.find(b"@")
    while at >= 0:
        before = word[done:at]
        local = len(before) - len(before.rstrip(LOCAL))
        m = DOMAIN.match(word, at + 1) if local else None
        if m:
            yield at - local, m.end()
        done = m.end() if m else at + 1  # a local part holds no @
        at = word.find(b"@", done)


def base_spans(b: Block) -> tuple[list[list[tuple[int, int, int]]], np.ndarray]:
    """For each text (kind, start, end) in code points by the fixed patterns; and, for each byte, its code point."""
    points = np.zeros(len(b.data) + 1, dtype=np.int64)
    np.cumsum((b.data & 0xC0) != 0x80, out=points[1:])
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(b.n)]

    def add(kind: int, text: int, start: int, end: int) -> None:
        zero = points[b.bounds[text]]
        out[text].append((kind, int(points[start] - zero), int(points[end] - zero)))

    at = np.flatnonzero(b.data == 0x40)
    for w in np.unique(np.searchsorted(b.start, at, side="right") - 1) if len(at) else ():
        start = int(b.start[w])
        text = int(np.searchsorted(b.first, w, side="right")) - 1
        for lo, hi in emails(b.data[start : b.end[w]].tobytes()):
            add(0, text, start + lo, start + hi)
    starts, ends, first = split_words(b.data, b.bounds, RUN)
    digits = np.zeros(len(b.data) + 1, dtype=np.int64)
    np.cumsum(DIGIT[b.data], out=digits[1:])
    for r in np.flatnonzero(digits[ends] - digits[starts] >= 4):
        start, text = int(starts[r]), int(np.searchsorted(first, r, side="right")) - 1
        run = b.data[start : ends[r]].tobytes()
        for m in IP.finditer(run):
            if all(len(p) <= 3 and int(p) <= 255 for p in (x.lstrip(b"0") or b"0" for x in m[0].split(b"."))):
                add(1, text, start + m.start(), start + m.end())
        for m in CARD.finditer(run):
            plain = m[0].replace(b" ", b"").replace(b"-", b"")
            if 13 <= len(plain) <= 19 and luhn(plain):
                add(2, text, start + m.start(), start + m.end())
        for m in PHONE.finditer(run):
            if 9 <= sum(48 <= c <= 57 for c in m[0]) <= 15:
                add(3, text, start + m.start(), start + m.end())
    return out, points


def _shape(word: str) -> str:
    """Letters as a, digits as 9 with the length of their run, other characters as they are."""
    out = []
    for m in re.finditer(r"[0-9]+|[^\W\d_]+|.", word, re.S):
        t = m[0]
        out.append(f"9{len(t) if len(t) < 5 else 5 if len(t) < 9 else 9 if len(t) < 13 else 13 if len(t) < 20 else 20}" if t[0] in "0123456789" else "a" if t[0].isalpha() else t)
    return "".join(out)


def _coarse(word: str) -> str:
    digits = re.sub(r"[^0-9]", "", word)
    n = len(digits)
    marks = "".join(sorted({c for c in word if c in "@.+-():/%,"}))
    card = "L" if 13 <= n <= 19 and luhn(digits.encode()) else ""
    parts = word.strip(_TRAIL).split(".")
    octets = "O" if len(parts) == 4 and all(p.isascii() and p.isdigit() and int(p) < 256 for p in parts if len(p) < 9) else ""
    return f"{min(n, 3) if n < 4 else 4 if n < 8 else 8 if n < 13 else 13}{'a' if any(c.isalpha() for c in word) else ''}{marks}{card}{octets}"


def features(words: list[str], first: int = 0, last: int | None = None) -> list[list[str]]:
    """The word-shape features of each word of a sequence, or of some of its words."""
    last = len(words) if last is None else min(last, len(words))
    shown = [words[i] if 0 <= i < len(words) else "" for i in range(first - 1, last + 1)]
    coarse, plain = [_coarse(w) for w in shown], [w.lower() for w in shown]
    if first == 0:
        coarse[0] = plain[0] = "<"
    if last == len(words):
        coarse[-1] = plain[-1] = ">"
    out = []
    for i, w in enumerate(shown[1:-1], 1):
        f = ["b", "s=" + _shape(w.rstrip(_TRAIL)), "c=" + coarse[i], "p=" + coarse[i - 1], "n=" + coarse[i + 1], f"pc={coarse[i - 1]}|{coarse[i]}", f"cn={coarse[i]}|{coarse[i + 1]}"]
        if plain[i - 1] in CUES:
            f.append("q=" + plain[i - 1])
        out.append(f)
    return out


@dataclass
class Field:
    """A fitted field: feature numbers, their weights by label, and weights of label pairs."""

    known: dict[str, int]
    weight: np.ndarray
    pair: np.ndarray

    def emissions(self, sequences: list[list[str]], first: int, last: int) -> np.ndarray:
        """Label scores of the words first..last of each sequence (sequence, place, label), zero after its end."""
        out = np.zeros((len(sequences), last - first, len(LABELS)))
        for i, s in enumerate(sequences):
            for j, f in enumerate(features(s, first, last) if first < len(s) else ()):
                ids = [self.known[x] for x in f if x in self.known]
                out[i, j] = self.weight[ids].sum(axis=0)
        return out

    def decode(self, sequences: list[list[str]]) -> list[np.ndarray]:
        """The likeliest labels of each sequence of words: Viterbi over all sequences at once.

        Features are made for STEPS words at a time; of those before only one byte for each
        label is kept, so that a sequence may be as long as a text.
        """
        lengths = np.array([len(s) for s in sequences])
        width, n = int(lengths.max(initial=0)), len(sequences)
        best, back = np.zeros((n, len(LABELS))), []
        for t in range(width):
            if t % STEPS == 0:
                e = self.emissions(sequences, t, min(t + STEPS, width))
            if t == 0:
                best = e[:, 0]
                continue
            through = best[:, :, None] + self.pair
            back.append(through.argmax(axis=1).astype(np.int8))
            best = np.where((t < lengths)[:, None], through.max(axis=1) + e[:, t % STEPS], best)
        label = best.argmax(axis=1)
        path = np.zeros((n, width), dtype=np.int8)
        rows = np.arange(n)
        for t in range(width - 1, -1, -1):
            inside = t < lengths
            path[inside, t] = label[inside]
            if t:
                label = np.where(inside, back[t - 1][rows, label], label)
        return [p[:n] for p, n in zip(path, lengths, strict=True)]


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def _words(text: str) -> list[tuple[str, int, int]]:
    return [(m[0], m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", text)]


def training_table(lines: str = TRAINING) -> list[tuple[list[str], list[int]]]:
    """Labelled lines as words and label numbers."""
    out = []
    for line in lines.strip().split("\n"):
        words, labels = [], []
        for part in re.split(r"(\[(?:email|ip|card|phone):(?:[^\[\]]|\[at\])*\])", line):
            m = re.match(r"\[(\w+):(.*)\]\Z", part)
            if m and m[1] in KINDS:
                for i, (w, *_) in enumerate(_words(m[2])):
                    words.append(w)
                    labels.append(1 + 2 * KINDS.index(m[1]) + (i > 0))
            else:
                for w, *_ in _words(part):
                    words.append(w)
                    labels.append(0)
        out.append((words, labels))
    return out


def fit_field(table: list[tuple[list[str], list[int]]], rounds: int = 150, decay: float = 0.02) -> Field:
    """Maximum likelihood with a Gaussian prior: forward-backward over all lines at once, AdaGrad."""
    sequences = [features(w) for w, _ in table]
    known = {x: i for i, x in enumerate(sorted({x for s in sequences for f in s for x in f}))}
    n, width, k = len(table), max(len(w) for w, _ in table), len(LABELS)
    lengths = np.array([len(w) for w, _ in table])
    place = np.array([(i, j, known[x]) for i, s in enumerate(sequences) for j, f in enumerate(s) for x in f]).T
    truth = np.zeros((n, width, k))
    for i, (_, labels) in enumerate(table):
        truth[i, np.arange(len(labels)), labels] = 1
    pairs = sum(truth[:, t, :].T @ truth[:, t + 1, :] for t in range(width - 1))
    field = Field(known, np.zeros((len(known), k)), np.zeros((k, k)))
    sums = [np.full_like(field.weight, 1e-2), np.full_like(field.pair, 1e-2)]
    rows = np.arange(n)
    for _ in range(rounds):
        e = np.zeros((n, width, k))
        np.add.at(e, (place[0], place[1]), field.weight[place[2]])
        ahead, behind = np.zeros((n, width, k)), np.zeros((n, width, k))
        ahead[:, 0] = e[:, 0]
        for t in range(1, width):
            ahead[:, t] = _logsum(ahead[:, t - 1, :, None] + field.pair, 1) + e[:, t]
        for t in range(width - 2, -1, -1):
            step = _logsum(field.pair + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where((t + 1 < lengths)[:, None], step, 0)
        total = _logsum(ahead[rows, lengths - 1], 1)
        inside = (np.arange(width) < lengths[:, None])[:, :, None]
        chance = np.exp(ahead + behind - total[:, None, None]) * inside
        expected = np.zeros((k, k))
        for t in range(1, width):
            both = ahead[:, t - 1, :, None] + field.pair + (e[:, t] + behind[:, t])[:, None, :] - total[:, None, None]
            expected += (np.exp(both) * (t < lengths)[:, None, None]).sum(axis=0)
        d_weight = np.zeros_like(field.weight)
        np.add.at(d_weight, place[2], (truth - chance)[place[0], place[1]])
        for value, slope, held in ((field.weight, d_weight, sums[0]), (field.pair, pairs - expected, sums[1])):
            slope = slope - decay * value
            held += slope**2
            value += 0.5 * slope / np.sqrt(held)
    return field


def sequences_of(b: Block, around: int = 2) -> list[tuple[int, int]]:
    """Runs of words (first, last + 1) within two words of one that holds a digit, an @ or what stands for it, each of one text.

    Every labelled word has such a word that near. The field may label others as well, such
    as "address the.", which have no shape of personal data and are never read.
    """
    spelled = [m.start() for m in SPELLED_AT.finditer(b.data.tobytes())]
    at = np.union1d(np.flatnonzero(MARKED[b.data]), np.array(spelled, dtype=np.int64))
    if not len(at):
        return []
    marked = np.unique(np.searchsorted(b.start, at, side="right") - 1)
    text = np.searchsorted(b.first, marked, side="right") - 1
    lo, hi = np.maximum(marked - around, b.first[text]), np.minimum(marked + around + 1, b.first[text + 1])
    new = np.ones(len(lo), dtype=bool)
    new[1:] = (lo[1:] > hi[:-1]) | (text[1:] != text[:-1])
    head = np.flatnonzero(new)
    return list(zip(lo[head].tolist(), hi[np.append(head[1:], len(lo)) - 1].tolist(), strict=True))


def added_spans(b: Block, field: Field, base: list[list[tuple[int, int, int]]], points: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """What the field finds besides the base spans of each text; spans that touch those are left out. Runs of words are decoded whole."""
    runs = sequences_of(b)
    labelled: list[np.ndarray] = [np.zeros(0)] * len(runs)
    some: list[int] = []
    for k in [*sorted(range(len(runs)), key=lambda k: runs[k][1] - runs[k][0]), None]:
        if some and (k is None or (len(some) + 1) * (runs[k][1] - runs[k][0]) > TOGETHER):
            for i, labels in zip(some, field.decode([[_word(b, w) for w in range(*runs[i])] for i in some]), strict=True):
                labelled[i] = labels
            some = []
        some.append(k)
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(b.n)]
    for (lo, _), labels in zip(runs, labelled, strict=True):
        j = 0
        while j < len(labels):
            label, start = int(labels[j]), j
            j += 1
            if label:
                kind = (label - 1) // 2
                while j < len(labels) and labels[j] == 2 * kind + 2:
                    j += 1
                span = _trimmed(b, points, kind, lo + start, lo + j - 1, _word(b, lo + start), _word(b, lo + j - 1))
                text = int(np.searchsorted(b.first, lo + start, side="right")) - 1
                if span and not any(s < span[2] and span[1] < e for _, s, e in base[text]):
                    out[text].append(span)
    return out


def _word(b: Block, w: int) -> str:
    return b.data[b.start[w] : b.end[w]].tobytes().decode("utf-8", "replace")


def _trimmed(b: Block, points: np.ndarray, kind: int, first: int, last: int, head: str, tail: str) -> tuple[int, int, int] | None:
    """The span of words first..last in code points, without punctuation at its ends."""
    zero = points[b.bounds[int(np.searchsorted(b.first, first, side="right")) - 1]]
    start, end = int(points[b.start[first]] - zero), int(points[b.end[last]] - zero)
    start += len(head) - len(head.lstrip("[{<\"'" if kind == 3 else _EDGE))
    end -= len(tail) - len(tail.rstrip(_TRAIL))
    return (kind, start, end) if start < end else None


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in sorted(spans))


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone (base spans), base_sha256, spans and n_added.

    Positions are code points, the end exclusive. Null texts count as empty and hold
    nothing; repeated rows and ids get equal results; an empty table gives no rows;
    other columns are ignored.
    """
    lean_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(fit_field(training_table()))  # of the fixed training table

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in blocks(batch.column("text"), NOT_SPACE):
                base, points = base_spans(b)
                more = added_spans(b, held.value, base, points)
                counts = np.array([[sum(s[0] == k for s in text) for k in range(4)] for text in base], dtype=np.int64).reshape(-1, 4)
                digests = [hashlib.sha256(_listed(t).encode()).hexdigest() for t in base]
                spans = [_listed(t + m) for t, m in zip(base, more, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id")[b.offset : b.offset + b.n], *(pa.array(counts[:, k]) for k in range(4)), pa.array(digests, pa.string()), pa.array(spans, pa.string()), pa.array([len(m) for m in more], pa.int64())],
                    names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"],
                )

    form = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long"
    return docs.select("doc_id", docs["text"].cast("string").alias("text")).mapInArrow(run, form)
