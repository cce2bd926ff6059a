"""Operator 9: language-model scores by online logistic context mixing.

A text is a sequence of lower-cased words and one end, each spelled in bits: a frequent
word by the bucket of its rank and its place there, any other by an escape and its bytes.
Three predictors guess each bit from counts under hashed contexts: for frequent words none,
the class of the short words before (which tells the language), the last word; for spelled ones the word so
far, the same with that class, the last three bytes. A fourth expects the word that followed the same word last time in this text, with
odds that adapt as the text is read. The stretched guesses are mixed by weights that a gate
selects (the place in the code, how often the third context was seen, whether a word is
expected); the weights follow the error of each bit, after each word code or byte. A last stage refines the
mixed probability by what came of such probabilities before. Words of over ``LONGEST`` bytes are spelled in parts.

Counts and starting weights come from all learned documents. The counts of words have no
bound; the slots of the bit counts grow with the corpus up to ``MOST_SLOTS``.
Texts are read in lanes of ``LANE`` words, side by side: contexts and expected words reach
over the whole text, what adapts (weights, odds, refinement) starts anew in each lane. What is read
together is bounded in bits, so that memory doesn't grow with words or texts.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rollkeep.llm.storage import lean_batches, materialize
from rollkeep.llm.words import LOWER, NOT_SPACE, VALUES, Block, blocks, mix, prefix_hash, span_hash

#: Bits of the number of slots of a predictor: one slot for so many bytes of learned text, between the bounds. The upper one keeps the tables of a task below 70 MB.
BYTES_A_SLOT, LEAST_SLOTS, MOST_SLOTS = 1, 16, 21
#: Slots of a chunk in which counts are summed.
CHUNK_BITS = 16
#: Short words tell what kind of text (which language, say) a word stands in: their longest length in bytes, the hashed states they
#: have, the classes these fall into by which follow each other, and how many before a word are asked.
SHORT, STATES, CLASSES, ASKED = 3, 256, 12, 6
#: Words whose counts are handed to every task: the most frequent ones, at most so many; other counts are joined. Those seen CODED times have a code, all others are spelled.
FREQUENT, CODED = 1 << 19, 2
#: Tokens of a lane; bits that are read together, and counted together; lanes that are read together; bytes of a block of texts; bytes after which a word goes on as another token.
LANE, TOGETHER, COUNTED, LANES, BLOCK, LONGEST = 1024, 1 << 20, 1 << 19, 4096, 1 << 20, 64
#: Tokens among which equal ones with equal contexts are counted and fitted as one.
ONCE = 1 << 20
#: What ends a spelled word, and a spelled part that goes on (no word holds a tab).
ENDS, GOES_ON = 0x20, 0x09
N_CONTEXTS = 3
_U = np.uint64
_M1, _M2 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F)
END = int(mix(np.array([0xE0D], dtype=_U)).view(np.int64)[0])


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """A prefix code of bytes, shorter for letters that are common in most languages: bits and lengths."""
    common = b" etaoinsrhldcumpgfbvy.,wkqxjz|0123456789-'!?*#$%&\xc3\xa9\xb3"
    order = list(dict.fromkeys(common)) + [b for b in range(256) if b not in common]
    bits, length = np.zeros(256, dtype=np.int64), np.zeros(256, dtype=np.int64)
    for i, b in enumerate(order):
        if i < 8:
            bits[b], length[b] = i, 4
        elif i < 24:
            bits[b], length[b] = (0b10 << 4) | (i - 8), 6
        elif i < 88:
            bits[b], length[b] = (0b110 << 6) | (i - 24), 9
        else:
            bits[b], length[b] = (0b111 << 8) | (i - 88), 11
    return bits, length


CODE, CODE_LENGTH = _codes()
SPELLED_LENGTH = CODE_LENGTH[LOWER].astype(np.int32)
#: Kinds of bits: the first of a word's code and all later ones; of spelled bytes by place in the word and in the byte's code.
WORD_BITS, BYTE_PLACES, BYTE_BITS = 32, 4, 11
N_KINDS = WORD_BITS + BYTE_PLACES * BYTE_BITS
#: Gates: kind of the bit, how often the third context was seen (never, once or twice, more often), and whether a word is expected.
N_GATES = 3 * N_KINDS
#: How fast the mixing weights and the refinement follow, and the share of the refinement that is used.
RATE, REFINE, SHARE = 0.03, 0.002, 1.0
#: Bits whose probabilities are multiplied before a logarithm is taken (no code has more than twice as many).
HALF = 32
#: Refinement: steps of the stretched probability, from -REACH to REACH.
STEPS, REACH = 24, 12.0
#: Pseudo-counts of hits and misses of an expected word by the run of hits before, and starting weight of that guess.
HITS, MISSES, EXPECTED = np.array([0.1, 1.0, 3.0, 8.0]), np.array([3.0, 2.0, 1.0, 0.5]), 0.6


@dataclass
class Tokens:
    """The tokens of a block: one END after the words of each text."""

    text: np.ndarray
    token: np.ndarray
    short: np.ndarray  # the state of a short word, 0 for other tokens
    word: np.ndarray  # number of the word in the block, -1 for END
    first: np.ndarray

    def pairs(self) -> np.ndarray:
        """(states, states): how often one short word is the next after another."""
        at = np.flatnonzero(self.short)
        near = self.text[at[1:]] == self.text[at[:-1]]
        return np.bincount(self.short[at[:-1]][near] * STATES + self.short[at[1:]][near], minlength=STATES * STATES)

    def kinds(self, classes: np.ndarray) -> np.ndarray:
        """The class that most of the last short words before each token have, 0 where there are none."""
        at = np.flatnonzero(self.short)
        mine = classes[self.short[at]].astype(_U)
        begin = np.searchsorted(at, self.first)
        start = np.repeat(begin[:-1], np.diff(begin))  # of each short word, the first in its text
        # A sum of the last ASKED, with 4 bits for each class.
        total = np.concatenate([[_U(0)], np.cumsum(_U(1) << (mine * _U(4)))])
        upto = np.arange(len(at))
        recent = total[1:] - total[np.maximum(upto + 1 - ASKED, start)]
        best, kind = np.zeros(len(at), dtype=np.uint8), np.zeros(len(at) + 1, dtype=np.int64)
        for c in range(CLASSES + 1):
            votes = 2 * ((recent >> _U(4 * c)) & _U(15)).astype(np.uint8) + (mine == c)
            kind[:-1][votes > best] = c
            np.maximum(best, votes, out=best)
        before = np.cumsum(self.short > 0) - (self.short > 0)  # short words before each token
        return kind[np.where(before > begin[:-1][self.text], before - 1, len(at))]


def tokens(b: Block) -> Tokens:
    n = len(b.start) + b.n
    ends = b.first[1:] + np.arange(b.n)  # place of each END
    is_word = np.ones(n, dtype=bool)
    is_word[ends] = False
    token = np.full(n, END, dtype=np.int64)
    token[is_word] = b.hashes(lower=True).view(np.int64)
    word = np.full(n, -1, dtype=np.int64)
    word[is_word] = np.arange(len(b.start))
    first = np.concatenate([[0], ends + 1])
    text = np.repeat(np.arange(b.n), np.diff(first))
    short = np.zeros(n, dtype=np.int64)
    brief = token.view(_U)[is_word] >> _U(40)
    short[is_word] = np.where((b.end - b.start) <= SHORT, brief.astype(np.int64) % (STATES - 1) + 1, 0)
    return Tokens(text, token, short, word, first)


def classes_of(pairs: np.ndarray) -> np.ndarray:
    """A class from 1 for each state: the two groups that follow each other most, for their sizes, are joined until CLASSES are left or none do more than by chance."""
    link = (pairs + pairs.T).astype(float)
    mass, total = link.sum(axis=1), max(link.sum(), 1.0)
    group, alive = np.arange(len(link)), mass > 0
    link[~alive], link[:, ~alive] = 0, 0
    while alive.sum() > 1:
        many = alive.sum() > CLASSES
        tie = link * total / np.maximum(np.outer(mass, mass), 1e-9)
        np.fill_diagonal(tie, -1)
        # Small groups first: their links say little, and joining them loses little.
        tie *= np.where(np.minimum.outer(mass, mass) < total * 1e-3, 2.0, 1.0)
        i, j = np.unravel_index(int(tie.argmax()), tie.shape)
        if tie[i, j] <= (0 if many else 1):
            break
        i, j = min(i, j), max(i, j)
        group[group == j] = i
        link[i] += link[j]
        link[:, i] += link[:, j]
        link[j], link[:, j] = 0, 0
        mass[i], mass[j], alive[j] = mass[i] + mass[j], 0, False
    largest = sorted(np.flatnonzero(alive), key=lambda g: (-mass[g], g))[:CLASSES]
    return np.array([largest.index(g) + 1 if g in largest else 0 for g in group])


def _spellings(b: Block, word: np.ndarray) -> pa.Array:
    """The lower-cased bytes of some words as a binary column; END is one zero byte."""
    start, length = np.append(b.start, len(b.data))[word], np.append(b.end - b.start, 1)[word]
    data = np.append(b.data, np.uint8(0))
    offsets = np.concatenate([[0], np.cumsum(length)])
    at = np.arange(offsets[-1]) - np.repeat(offsets[:-1] - start, length)
    return pa.Array.from_buffers(pa.binary(), len(word), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(LOWER[data[at]])])


def prefix_code(mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Huffman's code: bits and lengths."""
    heap = [(float(m), i, (i,)) for i, m in enumerate(mass)]
    heapq.heapify(heap)
    code, length = np.zeros(len(mass), dtype=np.int64), np.zeros(len(mass), dtype=np.int64)
    while len(heap) > 1:
        a, b = heapq.heappop(heap), heapq.heappop(heap)
        for one, (_, _, leaves) in enumerate((a, b)):
            for i in leaves:
                code[i] |= one << length[i]
                length[i] += 1
        heapq.heappush(heap, (a[0] + b[0], min(a[1], b[1]), a[2] + b[2]))
    return code, length


@dataclass
class Counts:
    """The frequent words (sorted, with counts and codes), the total of the base score, and the code of an escape."""

    word: np.ndarray
    word_count: np.ndarray
    total: float
    code: np.ndarray
    code_length: np.ndarray
    escape: int
    escape_length: int
    classes: np.ndarray
    near: tuple[int, np.ndarray] | None = None  # where words that begin with the same bits start

    @staticmethod
    def of(word: np.ndarray, count: np.ndarray, total: float, pairs: np.ndarray) -> Counts:
        """Codes by rank: a prefix code of the number of bits of the rank or an escape, then the rank's other bits."""
        rank = np.empty(len(word), dtype=np.int64)
        rank[np.lexsort((word, -count))] = np.arange(1, len(word) + 1)
        bits = np.floor(np.log2(np.maximum(rank, 1))).astype(np.int64)
        coded = count >= CODED
        mass = np.append(np.bincount(bits[coded], count[coded], minlength=1), max(total - count[coded].sum(), 1.0))
        code, length = prefix_code(mass)
        bits = np.minimum(bits, len(mass) - 2)  # beyond are only words without a code
        known = np.where(coded, (code[bits] << bits) | (rank - (1 << bits)), code[-1])
        return Counts(word, count, total, known, np.where(coded, length[bits] + bits, length[-1]), int(code[-1]), int(length[-1]), classes_of(pairs))

    def look_up(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each word is frequent, and its place. Words are hashes, so their first bits tell nearly where they stand."""
        if not len(self.word):
            return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted), dtype=np.int64)
        if self.near is None:
            bits = max(len(self.word).bit_length(), 1)
            self.near = bits, np.searchsorted(self.word, (np.arange(1 << bits) << (64 - bits)) + np.iinfo(np.int64).min)
        bits, near = self.near
        at, last = near[(wanted >> (64 - bits)) + (1 << (bits - 1))], len(self.word) - 1
        np.minimum(at, last, out=at)
        behind = np.flatnonzero(self.word[at] < wanted)
        for _ in range(8):
            at[behind] = np.minimum(at[behind] + 1, last)
            behind = behind[(self.word[at[behind]] < wanted[behind]) & (at[behind] < last)]
        if len(behind):
            at[behind] = np.minimum(np.searchsorted(self.word, wanted[behind]), last)
        return self.word[at] == wanted, at

    def places(self, token: np.ndarray) -> np.ndarray:
        """The place of each word; that after the last for all that aren't frequent."""
        found, at = self.look_up(token)
        return np.where(found, at, len(self.word))

    def codes(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.append(self.code, self.escape)[place], np.append(self.code_length, self.escape_length)[place]


def cut_long(b: Block) -> tuple[Block, np.ndarray, np.ndarray]:
    """The block with words of over LONGEST bytes cut into parts, and of each word whether it is such a part and whether it goes on."""
    n = b.end - b.start
    if n.max(initial=0) <= LONGEST:
        none = np.zeros(len(n), dtype=bool)
        return b, none, none
    n = np.maximum(-(-n // LONGEST), 1)
    which, i = _runs(n)
    start = b.start[which] + i * LONGEST
    first = np.concatenate([[0], np.cumsum(n)])[b.first]
    return Block(b.offset, b.data, b.bounds, start, np.minimum(start + LONGEST, b.end[which]), first), n[which] > 1, i < n[which] - 1


@dataclass
class Bits:
    """The bits of some tokens in order: slots by context, kind, value, and of each token the first bit (one entry more)."""

    slots: np.ndarray
    kind: np.ndarray
    bit: np.ndarray
    first: np.ndarray
    unit: np.ndarray  # the word code or the byte that a bit belongs to, counted from 0
    guess: np.ndarray | None  # the bit that is expected: 1, -1, or 0 for none
    run: np.ndarray | None


def _same_bits(a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """How many of the first bits of two codes, each to the left of 64 bits, are the same; all of the length if the codes are."""
    differ = a ^ b
    top = (differ & ~(differ >> _U(1))).astype(np.float64)  # no bit after the first, so that rounding doesn't carry
    return np.where(differ == 0, length, 1086 - (top.view(np.int64) >> 52))


@dataclass
class Units:
    """Word codes, or bytes of spelled words. The bits of a unit don't wait for each other, so they are worked out by planes: the first bits of all units, then the second."""

    code: np.ndarray  # to the left of 64 bits
    length: np.ndarray
    contexts: list[np.ndarray]
    kind: np.ndarray  # of the first bit
    most: int  # bits that have a kind of their own
    token: np.ndarray  # which of the tokens that were asked for
    place: np.ndarray  # 0 is a token's word code, then come its bytes
    before: np.ndarray  # bits of the token before the unit
    agreed: np.ndarray | None  # bits that are as expected, -1 where nothing is

    def planes(self, slot_bits: int, contexts: range, *carried: np.ndarray) -> Iterator[tuple[int, list[np.ndarray], np.ndarray, list[np.ndarray]]]:
        """Of each plane its number, the slots by context, the bits, and what is carried for the units that have it. Each predictor has its own slots."""
        length, code, keys, held = self.length.astype(np.uint8), self.code.copy(), [self.contexts[k] for k in contexts], list(carried)
        node, falling = np.ones(len(code), dtype=np.uint32), bool((length[1:] <= length[:-1]).all())
        for i in range(int(length.max(initial=0))):
            more = length > i
            n = np.count_nonzero(more)
            if n < len(more):
                more = slice(n) if falling else more
                length, code, node, keys, held = length[more], code[more], node[more], [x[more] for x in keys], [x[more] for x in held]
            bit = (code >> _U(63)).astype(np.uint32)
            code <<= _U(1)
            path, slots = node * np.uint32(0x9E3779B1), []
            for k, key in zip(contexts, keys, strict=True):
                h = key + path
                h ^= h >> np.uint32(15)
                h *= np.uint32(0x85EBCA6B)
                h ^= h >> np.uint32(13)
                h *= np.uint32(0xC2B2AE35)
                h >>= np.uint32(32 - slot_bits)
                h += np.uint32(k << slot_bits)
                slots.append(h.astype(np.intp))
            yield i, slots, bit, held
            node += node
            node += bit

    def kind_of(self, i: int) -> np.uint8:
        """What a bit's place adds to the kind of the first bit."""
        return np.uint8(min(i, self.most - 1))

    def longest_first(self) -> Units:
        """In an order that makes planes cheap."""
        return self.take(np.argsort(~self.length.astype(np.uint8), kind="stable"))

    def take(self, order: np.ndarray) -> Units:
        return Units(*(x if isinstance(x, int) else [y.take(order) for y in x] if isinstance(x, list) else x if x is None else x.take(order) for x in vars(self).values()))


def _short(keys: list[np.ndarray]) -> list[np.ndarray]:
    return [(mix(k + _U(i + 1)) >> _U(32)).astype(np.uint32) for i, k in enumerate(keys)]


def _runs(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lengths n: which length each element belongs to, and its place there."""
    which = np.repeat(np.arange(len(n)), n)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)


@dataclass
class Reading:
    """The tokens of a block with codes, contexts, and the token that is expected at each (-1: none)."""

    b: Block
    t: Tokens
    code: np.ndarray
    length: np.ndarray
    contexts: list[np.ndarray]
    last: np.ndarray
    run: np.ndarray
    spelled: np.ndarray
    kind: np.ndarray
    more: np.ndarray  # of each token: whether its word goes on
    place: np.ndarray | None = None  # of each token among the frequent words

    @staticmethod
    def of(whole: Block, counts: Counts, expects: bool = True) -> Reading:
        """``expects``: whether contexts and what is expected are worked out, too."""
        b, part, more = cut_long(whole)
        t = tokens(b)
        n, kind = len(t.token), t.kinds(counts.classes)
        if expects:
            before = _before(t)
            contexts, (last, run) = _contexts(kind, before), _expected(t, before)
        else:
            contexts, last, run = [], np.full(n, -1), np.zeros(n, dtype=np.int64)
        place = counts.places(t.token)
        if part.any():
            place[np.append(part, False)[t.word]] = len(counts.word)
        code, length = counts.codes(place)
        return Reading(b, t, code, length, contexts, last, run, (code == counts.escape) & (length == counts.escape_length), kind, np.append(more, False)[t.word], place)

    def before(self) -> np.ndarray:
        """The hash of the token before each in its text, 1 for none."""
        return _before(self.t)

    def sizes(self) -> tuple[np.ndarray, np.ndarray]:
        """Bits and units of each token."""
        bits = np.zeros(len(self.b.data) + 1, dtype=np.int64)
        np.cumsum(SPELLED_LENGTH.take(self.b.data), out=bits[1:])
        start, end = np.append(self.b.start, 0)[self.t.word], np.append(self.b.end, 0)[self.t.word]
        is_end = self.t.word < 0
        body = np.where(is_end, CODE_LENGTH[0], bits[end] - bits[start])
        return self.length + np.where(self.spelled, body + np.where(self.more, CODE_LENGTH[GOES_ON], CODE_LENGTH[ENDS]), 0), 1 + np.where(self.spelled, np.where(is_end, 1, end - start) + 1, 0)

    def parts(self) -> Iterator[np.ndarray]:
        """All tokens in order, so many at a time that their bits stay within bounds."""
        upto = np.cumsum(self.sizes()[0])
        lo = 0
        while lo < len(upto):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + COUNTED, side="right")))
            yield np.arange(lo, hi)
            lo = hi

    def units(self, some: np.ndarray) -> list[Units]:
        """The word codes of some tokens, and the bytes of those that are spelled."""
        return [self.word_units(some), *self.byte_units(some)]

    def word_units(self, some: np.ndarray) -> Units:
        code, length, last = _left(self.code[some], self.length[some]), self.length[some], self.last[some]
        asked = np.flatnonzero(last >= 0)
        agreed = np.full(len(some), -1, dtype=np.int64)
        wanted = last[asked]
        agreed[asked] = _same_bits(code[asked], _left(self.code[wanted], self.length[wanted]), length[asked])
        none = np.zeros(len(some), dtype=np.int64)
        return Units(code, length, [x[some] for x in self.contexts], none.astype(np.uint8), WORD_BITS, np.arange(len(some)), none, none, agreed)

    def byte_units(self, some: np.ndarray) -> Iterator[Units]:
        length, last, spelled = self.length[some], self.last[some], np.flatnonzero(self.spelled[some])
        if not len(spelled):
            return
        names = some[spelled]
        words = _spellings(self.b, self.t.word[names])
        offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[: len(words) + 1].astype(np.int64)
        size = np.diff(offsets) + 1  # what ends each
        first = offsets + np.arange(len(offsets))
        data = np.empty(int(first[-1]), dtype=np.uint8)
        inner = np.ones(len(data), dtype=bool)
        inner[first[1:] - 1] = False
        data[~inner] = np.where(self.more[names], GOES_ON, ENDS)
        data[inner] = np.frombuffer(words.buffers()[2], dtype=np.uint8)[: offsets[-1]]
        word, place = _runs(size)
        byte_bits = CODE_LENGTH[data]
        bits_before = np.cumsum(byte_bits) - byte_bits

        so_far = span_hash(prefix_hash(VALUES[data]), first[:-1][word], np.arange(len(data)))
        recent = np.zeros(len(data), dtype=_U)
        for k in (3, 2, 1):
            byte = np.zeros(len(data), dtype=_U)
            byte[k:] = data[:-k]
            recent = (recent << _U(8)) | np.where(place >= k, byte, _U(0))
        state = mix(self.kind[names].astype(_U) + _U(99))
        contexts = _short([so_far, so_far ^ state[word], recent + (np.minimum(place, 3).astype(_U) << _U(56))])
        # The spelled word that is expected, as far as it agrees: its byte at each place.
        agreed, at = np.full(len(data), -1, dtype=np.int64), last[spelled]
        fits = (at >= 0) & (self.t.word[at] >= 0) & self.spelled[at]
        if fits.any():
            begin, end = (np.append(x, 0)[self.t.word[at]] for x in (self.b.start, self.b.end))
            there = begin[word] + place
            byte = np.where(there == end[word], ENDS, LOWER[self.b.data[np.minimum(there, len(self.b.data) - 1)]])
            has = fits[word] & (there <= end[word])
            wrong = np.concatenate([[0], np.cumsum(~has | (byte != data))])
            alive = np.flatnonzero(has & (wrong[:-1] == wrong[first[:-1]][word]))
            agreed[alive] = _same_bits(BYTE_CODE[data[alive]], BYTE_CODE[byte[alive]], byte_bits[alive])
        yield Units(
            BYTE_CODE[data],
            byte_bits,
            [x ^ np.uint32(1 << 31) for x in contexts],  # nodes of bytes are told from those of word codes
            (WORD_BITS + np.minimum(place, BYTE_PLACES - 1) * BYTE_BITS).astype(np.uint8),
            BYTE_BITS,
            spelled[word],
            place + 1,
            length[spelled[word]] + bits_before - bits_before[first[:-1]][word],
            agreed,
        )

    def bits(self, some: np.ndarray, slot_bits: int, guesses: bool) -> Bits:
        """The bits of some tokens, one after another."""
        total, units = (x[some] for x in self.sizes())
        start, own = np.concatenate([[0], np.cumsum(total)]), np.cumsum(units) - units
        n = int(start[-1])
        slots, unit = np.empty((N_CONTEXTS, n), dtype=np.int32), np.empty(n, dtype=np.int32)
        kind, bit = np.empty(n, dtype=np.int16), np.empty(n, dtype=np.int8)
        guess, run = (np.zeros(n, dtype=np.int8), np.empty(n, dtype=np.int8)) if guesses else (None, None)
        for u in self.units(some):
            carried = start[u.token] + u.before, own[u.token] + u.place, u.kind, u.agreed, self.run[some[u.token]]
            for i, found, one, (at, number, first_kind, agreed, mine) in u.planes(slot_bits, range(N_CONTEXTS), *carried):
                at = at + i
                slots[:, at] = found
                kind[at], bit[at], unit[at] = first_kind + u.kind_of(i), one, number
                if guesses:
                    guess[at] = np.where(agreed > i, 1, np.where(agreed == i, -1, 0)) * (2 * one.astype(np.int8) - 1)
                    run[at] = mine
        return Bits(slots, kind, bit, start, unit, guess, run)


def _left(code: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Codes moved to the left of 64 bits."""
    return code.astype(_U) << (64 - length).astype(_U)


BYTE_CODE = _left(CODE, CODE_LENGTH)


def _before(t: Tokens) -> np.ndarray:
    before = np.concatenate([[0], t.token[:-1]])[: len(t.token)]
    before[t.first[:-1]] = 1
    return before.view(_U)


def _contexts(kind: np.ndarray, before: np.ndarray) -> list[np.ndarray]:
    """The contexts of word codes: none, the class, the word before."""
    return _short([np.zeros(len(kind), dtype=_U), mix(np.arange(CLASSES + 1, dtype=_U) + _U(99))[kind], before])


def _expected(t: Tokens, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The token that followed the same token last time in the text (-1: none), and by how long such tokens were right so far."""
    n = len(t.token)
    at, key = np.arange(n), before * _M1 + t.text.astype(_U) * _M2
    order = np.argsort(key)
    ranked = key[order]
    group = np.cumsum(np.concatenate([[False], ranked[1:] != ranked[:-1]])[:n]) << 32
    order = np.sort(group | order)  # within equal keys by place
    group, order = order >> 32, order & 0xFFFFFFFF
    last = np.full(n, -1)
    last[order[1:]] = np.where(group[1:] == group[:-1], order[:-1], -1)
    hit = (last >= 0) & (t.token == t.token[np.maximum(last, 0)])
    misses = np.maximum.accumulate(np.where(hit, -1, at))
    run = np.where(at == t.first[t.text], 0, np.concatenate([[0], (at - misses)[:-1]])) if n else at
    return last, np.digitize(run, [1, 3, 8])


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(pair, token, n): how often each word stands in some texts, and of each pair of states (token: their number) how often one follows the other."""
    pairs = np.zeros(STATES * STATES, dtype=np.int64)
    for batch in batches:
        for b in blocks(batch.column("text"), NOT_SPACE, BLOCK):
            t = tokens(b)
            token, n = np.unique(t.token, return_counts=True)
            pairs += t.pairs()
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(token), dtype=bool)), pa.array(token), pa.array(n)], names=["pair", "token", "n"])
    token = np.flatnonzero(pairs)
    yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(token), dtype=bool)), pa.array(token), pa.array(pairs[token])], names=["pair", "token", "n"])


def word_units(c: Counts, place: np.ndarray, kind: np.ndarray, before: np.ndarray) -> Units:
    """Word codes, by the place of the word, the class, and the word before."""
    (code, length), none = c.codes(place), np.zeros(len(place), dtype=np.int64)
    return Units(_left(code, length), length, _contexts(kind, before), none.astype(np.uint8), WORD_BITS, none, none, none, None)


def units_once(batches: Iterator[pa.RecordBatch], c: Counts, words: np.ndarray | None = None) -> Iterator[tuple[Units, np.ndarray]]:
    """All units of some texts, and how often each is meant. Of word codes that follow the same word within the same class, those of up to ONCE tokens are one.

    ``words``, by class and place, takes how often each word is met.
    """
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> Iterator[tuple[Units, np.ndarray]]:
        place, kind, before = (np.concatenate(x) for x in zip(*held, strict=True))
        held.clear()
        order = np.argsort(mix(before ^ ((place.astype(_U) << _U(8) | kind) * _M1)))
        place, kind, before = place[order], kind[order], before[order]
        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (kind[1:] != kind[:-1]) | (before[1:] != before[:-1])]))
        times = np.diff(np.append(first, len(order))).astype(np.int32)
        for lo in range(0, len(first), COUNTED >> 4):
            some, n = first[lo : lo + (COUNTED >> 4)], times[lo : lo + (COUNTED >> 4)]
            order = np.argsort(~c.codes(place[some])[1].astype(np.uint8), kind="stable")
            some, n = some[order], n[order]
            yield word_units(c, place[some], kind[some], before[some]), n

    for batch in batches:
        for b in blocks(batch.column("text"), NOT_SPACE, BLOCK):
            r = Reading.of(b, c, expects=False)
            if words is not None:
                np.add.at(words.reshape(-1), r.kind * words.shape[1] + r.place, np.int32(1))
            if len(r.place):
                held.append((r.place.astype(np.int32), r.kind.astype(np.uint8), r.before()))
            for some in r.parts():
                for units in r.byte_units(some):
                    units = units.longest_first()
                    yield units, np.ones(len(units.code), dtype=np.int32)
            if sum(len(x[0]) for x in held) > ONCE:
                yield from flush()
    if held:
        yield from flush()


def count_bits(counts_of, slot_bits: int):
    """Arrow function: (chunk, counts): a task's zeros and ones, slot by slot. Chunks are packed, as most counts of a task are small.

    Under the first two contexts the bits of a word's code depend on the word and the class alone,
    so these are counted first, and spelled in bits once.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, n = counts_of.value, N_CONTEXTS << slot_bits
        flat = np.zeros(2 * n, dtype=np.int32)
        words = np.zeros((CLASSES + 1, len(c.word) + 1), dtype=np.int32)

        def add(units: Units, contexts: range, times: np.ndarray) -> None:
            for _, slots, bit, (now,) in units.planes(slot_bits, contexts, times):
                for slot in slots:
                    slot *= 2
                    slot += bit
                    np.add.at(flat, slot, now)

        for units, times in units_once(batches, c, words):
            add(units, range(2 if units.most == WORD_BITS else 0, N_CONTEXTS), times)
        for k, table in enumerate((words.sum(axis=0, dtype=np.int32)[None], words)):
            kinds, places = np.nonzero(table)
            order = np.argsort(~np.append(c.code_length, c.escape_length)[places].astype(np.uint8), kind="stable")
            for lo in range(0, len(order), COUNTED >> 4):
                kind, place = (x[order[lo : lo + (COUNTED >> 4)]] for x in (kinds, places))
                add(word_units(c, place, kind, np.zeros(len(kind), dtype=_U)), range(k, k + 1), table[kind, place])
        width = 1 << min(CHUNK_BITS, slot_bits)
        for k in range(len(flat) // width):
            part = flat[k * width : (k + 1) * width]
            if part.any():
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([pa.compress(part.tobytes(), codec="zstd", asbytes=True)], pa.binary())], names=["chunk", "counts"])

    return run


def sum_chunks(width: int, packed: bool):
    """Arrow function: the sum of each chunk of a partition as they stream by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, x in zip(batch.column("chunk").to_pylist(), batch.column("counts"), strict=True):
                data = x.as_py()
                part = np.frombuffer(pa.decompress(data, decompressed_size=4 * width, codec="zstd", asbytes=True), dtype=np.int32) if packed else np.frombuffer(data, dtype=np.int64)
                held.setdefault(k, np.zeros(width, dtype=np.int64))
                held[k] += part
        for k, part in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["chunk", "counts"])

    return run


def stretched(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """The log odds of a one, drawn to even the fewer counts there are."""
    return np.log((ones + 0.02) / (zeros + 0.02)) * (1 - 1 / (1.5 + zeros + ones))


def marked(zeros: np.ndarray, ones: np.ndarray) -> np.ndarray:
    """Stretched guesses whose last two bits tell how often the slot was seen (3: three times and more)."""
    guess = stretched(zeros, ones).astype(np.float32).view(np.uint32) & ~np.uint32(3) | np.minimum(zeros + ones, 3).astype(np.uint32)
    return guess.view(np.float32)


def _gates(kind: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """The gate of each bit, by its kind and how often the slot of its third context was seen."""
    seen = (guess.view(np.uint32) & np.uint32(3)).astype(np.uint8)
    return kind * np.uint8(3) + (seen > 0) + (seen > 2)


def newton_sums(counts_of, held, slot_bits: int, width: int):
    """Arrow function: gradient and curvature of the mixing weights by gate over a task's texts, each bit's own count taken out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, weight = held.value
        start = weight.astype(np.float32)
        # The guess of each slot for a zero, and for a one, without that one's own count.
        without = np.empty((len(counts), 2), dtype=np.float32)
        for lo in range(0, len(counts), 1 << 16):
            zeros, ones = counts[lo : lo + (1 << 16)].T
            without[lo : lo + (1 << 16), 0] = marked(np.maximum(zeros - 1, 0), ones)
            without[lo : lo + (1 << 16), 1] = marked(zeros, np.maximum(ones - 1, 0))
        without = without.reshape(-1)
        total = np.zeros((N_GATES, width, width + 1))
        for u, times in units_once(batches, counts_of.value):
            for i, slots, bit, (kind, n) in u.planes(slot_bits, range(N_CONTEXTS), u.kind, times.astype(np.float32)):
                for slot in slots:
                    slot *= 2
                    slot += bit
                guesses = [without.take(slot) for slot in slots]
                gate = _gates(kind + u.kind_of(i), guesses[-1])
                order = np.argsort(gate, kind="stable")
                every = np.ones((width, len(bit)), dtype=np.float32)
                for k in range(N_CONTEXTS):
                    guesses[k].take(order, out=every[k], mode="clip")
                one, n = bit.astype(np.float32).take(order), n.take(order)
                ends = np.concatenate([[0], np.cumsum(np.bincount(gate, minlength=N_GATES))])
                for g in np.flatnonzero(np.diff(ends)):
                    mine = slice(ends[g], ends[g + 1])
                    x, p = every[:, mine], start[g] @ every[:, mine]
                    np.clip(p, -20, 20, out=p)
                    np.exp(-p, out=p)
                    p += np.float32(1)
                    np.divide(np.float32(1), p, out=p)
                    total[g, :, width] += x @ ((one[mine] - p) * n[mine])
                    curved = x * (np.maximum(p * (1 - p), np.float32(1e-4)) * n[mine])
                    for k in range(width):  # rows by vectors: a product of such flat matrices is slow
                        total[g, k, :width] += curved @ x[k]
        flat = total.reshape(-1)
        at = np.flatnonzero(flat)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "value"])

    return run


@dataclass
class Model:
    """Stretched guesses by slot (see :func:`marked`), and starting weights by gate: of the contexts, of the expected word, and a constant."""

    slot_bits: int
    stretch: np.ndarray
    weight: np.ndarray

    @staticmethod
    def of(slot_bits: int, counts: np.ndarray, weight: np.ndarray) -> Model:
        weight = np.insert(weight, N_CONTEXTS, 0.0, axis=1)
        again = weight.copy()
        again[:, N_CONTEXTS] = EXPECTED
        return Model(slot_bits, marked(*counts.T), np.concatenate([weight, again]).astype(np.float32))


def newton_step(weight: np.ndarray, total: np.ndarray) -> None:
    """Move the weights of each gate by its sums."""
    width = weight.shape[1]
    for g in range(len(weight)):
        ridge = np.eye(width) * (1 + 1e-4 * np.trace(total[g, :, :width]))
        weight[g] += np.clip(np.linalg.solve(total[g, :, :width] + ridge, total[g, :, width]), -1, 1)


def first_weights() -> np.ndarray:
    return np.tile(np.array([*[1.2 / N_CONTEXTS] * N_CONTEXTS, 0.0]), (N_GATES, 1))


def fit(texts: DataFrame, counts_of, slot_bits: int) -> Model:
    """Sum the bit counts, then fit the starting weights over all texts by a Newton step. A bounded number of slots comes to the driver and goes to every task."""
    spark = texts.sparkSession
    chunk_bits, n = min(CHUNK_BITS, slot_bits), N_CONTEXTS << slot_bits
    form = "chunk int, counts binary"
    parts = materialize(texts.mapInArrow(count_bits(counts_of, slot_bits), form))
    # In two steps, so that no task reads all parts of a chunk.
    salted = parts.repartition(F.col("chunk"), F.pmod(F.xxhash64("counts"), F.lit(8)))
    summed = salted.mapInArrow(sum_chunks(1 << chunk_bits, packed=True), form).repartition("chunk").mapInArrow(sum_chunks(1 << chunk_bits, packed=False), form)
    counts = np.zeros(2 * n, dtype=np.float32)
    for r in summed.toLocalIterator():
        counts[r["chunk"] << chunk_bits : (r["chunk"] + 1) << chunk_bits] = np.frombuffer(r["counts"], dtype=np.int64)
    counts = counts.reshape(n, 2)
    weight = first_weights()
    width = weight.shape[1]
    held = spark.sparkContext.broadcast((counts, weight))
    sums = texts.mapInArrow(newton_sums(counts_of, held, slot_bits, width), "at int, value double").groupBy("at").agg(F.sum("value").alias("value")).orderBy("at").collect()
    total = np.zeros(N_GATES * width * (width + 1))
    for r in sums:
        total[r["at"]] = r["value"]
    newton_step(weight, total.reshape(N_GATES, width, width + 1))
    held.unpersist()
    return Model.of(slot_bits, counts, weight)


def read(model: Model, r: Reading) -> np.ndarray:
    """The natural log of the probability of each text of a block. Where lanes are cut depends on the text alone.

    Lanes of like length are read together, so that their steps are full.
    """
    text, k = _runs(-(-np.diff(r.t.first) // LANE))
    begin = r.t.first[:-1][text] + k * LANE
    end = np.minimum(begin + LANE, r.t.first[1:][text])
    bits, units = (np.concatenate([[0], np.cumsum(x)]) for x in r.sizes())
    order = np.argsort(units[begin] - units[end], kind="stable")  # longest first
    upto = np.cumsum((bits[end] - bits[begin])[order])
    out, lo = np.zeros(len(begin)), 0
    while lo < len(order):
        hi = max(lo + 1, min(lo + LANES, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + TOGETHER, side="right"))))
        mine = order[lo:hi]
        lane, k = _runs((end - begin)[mine])
        some = begin[mine][lane] + k
        out[mine] = read_lanes(model, r, some, np.diff(units)[some], np.concatenate([[0], np.cumsum((end - begin)[mine])]))
        lo = hi
    return np.bincount(text, out, minlength=len(r.t.first) - 1)


def _steps(length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For chains that are walked side by side: the rank of each, the longest first, and where each step begins if the steps stand one after another."""
    rank = np.empty(len(length), dtype=np.int64)
    rank[np.argsort(-length, kind="stable")] = np.arange(len(length))
    active = np.bincount(length, minlength=1)[::-1].cumsum()[::-1][1:]
    return rank, np.concatenate([[0], np.cumsum(active)])


def read_lanes(model: Model, r: Reading, some: np.ndarray, n_units: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The natural log of the probability of each lane, the tokens first[i]..first[i + 1] of some.

    The bits of a unit (word code or byte) have gates of their own, so the weights of a gate wait
    only for the bits that the same gate had before in the lane: these chains are walked side by side.
    Odds are counts of what came before, and refinement reads the mixed guesses, one unit of every lane at a time.
    """
    n_lanes, n = len(first) - 1, int(n_units.sum())
    lane = np.repeat(np.repeat(np.arange(n_lanes), np.diff(first)), n_units)
    run = np.repeat(r.run[some], n_units)
    own = np.cumsum(n_units) - n_units
    units = [(u, own[u.token] + u.place) for u in r.units(some)]
    size, agreed = np.empty(n, dtype=np.int64), np.empty(n, dtype=np.int64)
    for u, number in units:
        size[number], agreed[number] = u.length, u.agreed
    odds = log_odds(lane, run, agreed > 0, (agreed >= 0) & (agreed < size))
    # Units by step, the lanes with most first.
    steps = np.bincount(lane, minlength=n_lanes)
    rank, edge = _steps(steps)
    at = edge[np.arange(n) - (np.cumsum(steps) - steps)[lane]] + rank[lane]
    sizes = np.empty(n, dtype=np.int64)
    sizes[at] = size
    begin = np.concatenate([[0], np.cumsum(sizes)])
    edge, start, n_bits = begin[edge].tolist(), begin[at].astype(np.int32), int(begin[-1])
    lane = rank[lane].astype(np.int32)
    row = np.where(run >= 2, 2, 1).astype(np.int32) * np.int32(STEPS + 1)

    planes, gates, lengths = [], [], []
    for u, number in units:
        there = np.full(n, -1)
        there[at[number]] = np.arange(len(number))
        order = there[there >= 0]  # units by step
        falling = np.argsort(~u.length[order].astype(np.uint8), kind="stable")
        by_step = np.empty(len(order), dtype=np.int64)  # where each stands once the longest are first
        by_step[falling] = np.arange(len(order))
        u, number = u.take(order[falling]), number[order[falling]]
        carried = u.kind, u.agreed.astype(np.int8), *(x.take(number) for x in (lane, odds, start, row))
        for i, slots, bit, (kind, agreed, lane_now, odds_now, to_unit, row_now) in u.planes(model.slot_bits, range(N_CONTEXTS), *carried):
            sign = bit.astype(np.float32)
            sign += sign
            sign -= np.float32(1)
            said = agreed >= i
            x = [model.stretch.take(slot) for slot in slots]
            gate = _gates(kind + u.kind_of(i), x[-1]) + said * np.uint16(N_GATES)
            x.append(odds_now * ((agreed > i).view(np.int8) * np.int8(2) - said.view(np.int8)))
            for guess in x[:-1]:
                guess *= sign
            # The chains of the plane, by gate and lane.
            inside = np.flatnonzero(np.bincount(gate, minlength=2 * N_GATES))
            local = np.zeros(2 * N_GATES, dtype=np.int32)
            local[inside] = np.arange(len(inside)) * n_lanes
            key = local.take(gate)
            key += lane_now
            if len(bit) < len(by_step):
                by_step = by_step[by_step < len(bit)]
            order = by_step.take(np.argsort((key.astype(np.uint16) if len(inside) * n_lanes <= 1 << 16 else key).take(by_step), kind="stable"))
            length = np.bincount(key, minlength=len(inside) * n_lanes)
            chain = np.flatnonzero(length)
            gates.append(inside[chain // n_lanes])
            lengths.append(length[chain])
            planes.append([x, order.astype(np.int32), to_unit + np.int32(i), (row_now * said + lane_now * np.int32(3 * (STEPS + 1))) * np.int32(2) + bit.view(np.int32), sign])
    if not planes:
        return np.zeros(n_lanes)
    # Guesses are turned so that what is right is positive: the error of a guess z is 1 / (1 + exp(z)).
    rank, step = _steps(np.concatenate(lengths))
    width = N_CONTEXTS + 2
    weight = np.empty((width, len(rank)), dtype=np.float32)
    weight[:, rank] = model.weight[np.concatenate(gates)].T
    x_all, done = np.empty((width, n_bits), dtype=np.float32), 0
    for plane, length in zip(planes, lengths, strict=True):
        x, order, sign = plane[0], plane[1], plane[4]
        place = np.arange(len(order))
        place -= np.repeat(np.cumsum(length) - length, length)
        place = step.take(place)
        place += np.repeat(rank[done : done + len(length)], length)
        to = np.empty(len(order), dtype=np.int64)
        to[order] = place
        for k, guess in enumerate((*x, sign)):
            x_all[k][to] = guess
        plane[0], plane[1] = None, to
        done += len(length)
    z_all, work = np.empty(n_bits, dtype=np.float32), np.empty((width, len(rank)), dtype=np.float32)
    rate, one, reach = np.float32(RATE), np.float32(1), np.float32(REACH)
    step = step.tolist()
    for lo, hi in zip(step, step[1:], strict=False):
        x, z, w, more = x_all[:, lo:hi], z_all[lo:hi], weight[:, : hi - lo], work[:, : hi - lo]
        np.multiply(w, x, out=more)
        np.add.reduce(more, axis=0, out=z)
        np.maximum(z, -reach, out=z)
        np.minimum(z, reach, out=z)
        off = np.exp(z)
        off += one
        np.divide(rate, off, out=off)
        np.multiply(x, off, out=more)
        w += more
    del x_all, weight, work

    # Refinement: what to add to the stretched probability, between two of its steps, by whether a word is expected.
    z, row_bit = np.empty(n_bits, dtype=np.float32), np.empty(n_bits, dtype=np.int32)
    for _, to, to_unit, rows, _ in planes:
        z[to_unit], row_bit[to_unit] = z_all.take(to), rows
    del planes, z_all
    sign, row = ((row_bit & 1) * 2 - 1).astype(np.float32), (row_bit >> 1).astype(np.int64)
    part = z * sign
    part += reach
    part *= np.float32(STEPS / (2 * REACH))
    low = np.minimum(part.astype(np.int32), STEPS - 1)
    part -= low
    row += low
    up = row + 1
    slow, share = np.float32(REFINE) * sign, np.float32(SHARE) * sign
    refined = np.zeros(n_lanes * 3 * (STEPS + 1), dtype=np.float32)
    for lo, hi in zip(edge, edge[1:], strict=False):
        row_now, up_now, part_now, z_now = row[lo:hi], up[lo:hi], part[lo:hi], z[lo:hi]
        below, above = refined.take(row_now), refined.take(up_now)
        more = above - below
        more *= part_now
        more += below
        more *= share[lo:hi]
        z_now += more
        off = np.exp(z_now)
        off += one
        np.divide(slow[lo:hi], off, out=off)
        rest = part_now * off
        above += rest
        off -= rest
        below += off
        refined[row_now] = below
        refined[up_now] = above
    np.negative(z, out=z)
    # The bits of a unit are multiplied before a logarithm is taken, at most HALF of them, so that products stay in range.
    cuts = begin[:-1]
    if size.max() > HALF:
        cuts = np.sort(np.concatenate([cuts, cuts[sizes > HALF] + HALF]))
    odds = np.exp(z, out=z).astype(np.float64)
    odds += 1
    cost = np.log(np.multiply.reduceat(odds, cuts))
    if len(cuts) > n:
        cost = np.add.reduceat(cost, np.searchsorted(cuts, begin[:-1]))
    return -np.bincount(np.repeat(np.arange(n_lanes), steps), cost[at], minlength=n_lanes)


def log_odds(lane: np.ndarray, run: np.ndarray, hit: np.ndarray, miss: np.ndarray) -> np.ndarray:
    """What a guess of the expected word weighs at each unit: the odds of its run of hits, by the units with a hit and those with a miss before in the lane; 0 where none is expected."""
    asked = np.flatnonzero(hit | miss)
    key = lane[asked] * len(HITS) + run[asked]
    key = key.astype(np.uint16 if key.max(initial=0) < 1 << 16 else np.int64)
    order = np.argsort(key, kind="stable")
    key, order = key[order], asked[order]
    opens = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])[: len(key)])
    first = np.repeat(opens, np.diff(np.append(opens, len(key))))
    held = []
    for start, kind in ((HITS, hit), (MISSES, miss)):
        came = kind[order]
        before = np.cumsum(came) - came
        held.append(start[run[order]] + 0.25 * (before - before[first]))
    out = np.zeros(len(lane), dtype=np.float32)
    out[order] = np.log(held[0] / held[1])
    return out


def expected_guess(bits: Bits, head: np.ndarray, lane_of: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The stretched guess of the expected word at each bit; 0 where none is expected."""
    right = (bits.guess > 0) == (bits.bit > 0)
    hit, miss = (np.add.reduceat(kind & (bits.guess != 0), head, dtype=np.int32) > 0 if len(head) else np.zeros(0, dtype=bool) for kind in (right, ~right))
    return bits.guess * log_odds(lane_of, bits.run[head], hit, miss)[which]


def score_batches(model_of, counts_of):
    """Arrow function: a row for each text; ``rare`` lists its different words that aren't among the frequent ones, and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, c = model_of.value, counts_of.value
        known = np.log10((c.word_count + 0.5) / c.total)
        for batch in batches:
            for b in blocks(batch.column("text"), NOT_SPACE, BLOCK):
                r = Reading.of(b, c)
                t, cost = r.t if r.b is b else tokens(b), read(model, r)
                at = r.place if r.b is b else c.places(t.token)
                found = at < len(c.word)
                base = np.append(known, 0.0)[at]
                rare = np.flatnonzero(~found)
                token, back = np.unique(t.token[rare], return_inverse=True)
                pairs, times = np.unique(t.text[rare] * len(token) + back, return_counts=True)
                lists = pa.array(np.searchsorted(pairs, np.arange(b.n + 1) * len(token)).astype(np.int32))
                more = pa.StructArray.from_arrays([pa.array(token[pairs % max(len(token), 1)]), pa.array(times)], names=["token", "times"])
                size = np.bincount(np.repeat(np.arange(b.n), np.diff(b.first)), b.end - b.start + 1, minlength=b.n) + 1
                yield pa.RecordBatch.from_arrays(
                    [batch.column(x)[b.offset : b.offset + b.n] for x in ("row", "doc_id")]
                    + [
                        pa.array(np.diff(t.first)),
                        pa.array(np.bincount(t.text, found, minlength=b.n).astype(np.int64)),
                        pa.array(np.bincount(t.text, base, minlength=b.n)),
                        pa.array(cost / np.log(10)),
                        pa.array(-cost / np.log(2) / size),
                        pa.ListArray.from_arrays(lists, more),
                    ],
                    names=["row", "doc_id", "n_tokens", "frequent", "frequent_base", "score", "bits_per_byte", "rare"],
                )

    return run


def most_frequent(table: DataFrame, key: str, count: str) -> tuple[np.ndarray, np.ndarray, list]:
    """The keys (sorted) and counts of all rows above the least count that leaves FREQUENT rows at most, and sizes by scale of count."""
    scale = F.floor(F.log2(count) * 8)
    sizes = table.groupBy(scale.alias("scale")).agg(F.count("*").alias("rows"), F.sum(count).alias("n")).orderBy(F.desc("scale")).collect()
    least, held = None, 0
    for r in sizes:
        held += r["rows"]
        if held > FREQUENT:
            break
        least = r["scale"]
    if least is None:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), sizes
    rows = table.where(scale >= least).select(key, count).toArrow()  # FREQUENT rows at most
    keys, counts = (np.array(rows.column(i), dtype=np.int64) for i in (0, 1))
    order = np.argsort(keys)
    return keys[order], counts[order], sizes


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and bits_per_byte.

    The model learns from documents whose crc32(doc_id as text) mod 5 isn't 1; a null doc_id
    is written as the empty string. Bytes are those of the words, a blank after each, and the
    end. Null texts count as empty: their only token is the end. Without learned documents
    nothing is known and what adapts starts from even guesses. Repeated rows and ids are
    documents like any others; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    lean_batches(spark)
    part = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    doc_type = docs.schema["doc_id"].dataType.simpleString()

    learned = docs.where(part != 1).select(text.alias("text"))
    size = learned.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    slot_bits = min(max(int(size // BYTES_A_SLOT).bit_length(), LEAST_SLOTS), MOST_SLOTS)
    counted = materialize(learned.mapInArrow(count_words, "pair boolean, token long, n long").groupBy("pair", "token").agg(F.sum("n").alias("count")))
    vocabulary, pairs = counted.where("not pair").drop("pair"), np.zeros(STATES * STATES, dtype=np.int64)
    for r in counted.where("pair").collect():  # STATES squared at most
        pairs[r["token"]] = r["count"]
    word, word_count, sizes = most_frequent(vocabulary, "token", "count")
    n_train, n_words = sum(r["n"] for r in sizes), sum(r["rows"] for r in sizes)
    total = float(n_train + 0.5 * (n_words + 1))

    counts = spark.sparkContext.broadcast(Counts.of(word, word_count, total, pairs.reshape(STATES, STATES)))  # of FREQUENT words at most
    model = spark.sparkContext.broadcast(fit(learned, counts, slot_bits))  # of MOST_SLOTS at most
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", text.alias("text"))
    form = f"row long, doc_id {doc_type}, n_tokens long, frequent long, frequent_base double, score double, bits_per_byte double, rare array<struct<token: long, times: long>>"
    scored = materialize(rows.mapInArrow(score_batches(model, counts), form))

    # The other words take their counts from the whole vocabulary.
    rare = scored.select("row", F.inline("rare")).join(vocabulary, "token", "left")
    base = F.log10((F.coalesce("count", F.lit(0)) + 0.5) / F.lit(total))
    looked = rare.groupBy("row").agg(F.sum(F.when(F.col("count").isNotNull(), F.col("times"))).alias("rare_known"), F.sum(F.col("times") * base).alias("rare_base"))
    return scored.join(looked, "row", "left").select(
        "doc_id",
        (part == 1).alias("held_out"),
        "n_tokens",
        (F.col("frequent") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(n_train).cast("long").alias("train_tokens"),
        (F.col("frequent_base") + F.coalesce("rare_base", F.lit(0.0))).alias("base_score"),
        "score",
        "bits_per_byte",
    )
