"""Log-probabilities of texts by logistic mixing of hashed-context bit predictors.

A text is the stream of its folded words, each with a space behind it, and an end mark. Every byte is a path of binary decisions
in a prefix code, which the one or two bytes of its word before it choose: what is likely there takes few. For each decision several
contexts (the bytes just before, the word so far, the word before it) name a slot of a hashed table of bit counts; each of them tells
the code. The slots' log-odds are mixed by weights, and a gate, made of how much the longer contexts have seen, chooses the weights.
The trained weights are where every text starts; from there they follow the text's own errors, block by block. Each decision is
predicted before it is seen, so the probabilities of all streams add up to one.

Every training text fills the tables and fits the weights: a task predicts each decision from what it has counted before, and
counts it then. What tasks learn about the weights adds up like what they count.
"""

from __future__ import annotations

import heapq
from collections import Counter
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from casegrain.llm.common import held_out, mixed, packed_block, powers, query, released, summed_blocks, table, text_batches, unpacked_block, with_columns
from casegrain.session import stored

#: Contexts: the last 2 and 4 bytes, the word so far, and that with the word before it.
LAST_BYTES = (2, 4)
CONTEXTS = len(LAST_BYTES) + 2
INPUTS = CONTEXTS + 1
#: Slots of each context's table (powers of two), and of the slices that the tables are summed by.
SLOT_BITS = (20, 22, 22, 22)
SLICE_BITS = 18
#: How strongly the starting weights are held near equal ones, and after how many decisions they are refined while a task counts.
PRIOR, REFINED = 20.0, 150_000
#: Words, and bytes of each at most, whose counts are sent to every task; all others are joined.
FREQUENT, FREQUENT_BYTES = 65_536, 64
#: Pairs of bytes that have a prefix code of their own for what follows, and where the numbers of single bytes begin.
OWN_CODES, OTHER = 512, 1 << 16
#: Bytes between two refinements of a text's weights, and how far one goes.
BLOCK, RATE = 512, 0.001
_TEXTS = 1 << 18
_SEGMENT = 1 << 16
_SLAB = 1 << 13

#: White space between words; in a folded stream it is a space, and a line break ends a text.
_INSIDE = np.array([0 if c in (10, 32) else c for c in range(256)], dtype=np.uint16)
_FOLD = bytes(32 if c in b"\x20\x09\x0a\x0b\x0c\x0d" else c for c in range(256))
_SPACE, _END = 32, 10
_STEP, _ALL = 0x9E3779B97F4A7C15, (1 << 64) - 1
_STATE = 128.0
_STEEPEST = np.float32(40)


def stream(texts: list[str]) -> np.ndarray:
    """The folded bytes of all texts: A to Z lower-cased, a space behind each word, a line break behind each text."""
    data = np.frombuffer(b"".join(t.encode("utf-8", "surrogatepass").lower().translate(_FOLD) + b" \n" for t in texts), dtype=np.uint8)
    before = np.append(np.uint8(_END), data[:-1])
    return data[(data != _SPACE) | (before != _SPACE) & (before != _END)]


def segments(data: np.ndarray) -> Iterator[tuple[np.ndarray, int]]:
    """A stream in parts of about `_SEGMENT` bytes, cut behind spaces, with how many bytes in front are there as context only."""
    spaces = np.flatnonzero(data == _SPACE) + 1 if len(data) > 2 * _SEGMENT else np.zeros(0, dtype=np.int64)
    at = 0
    while at < len(data):
        stop, known = len(data), at
        if stop - at > 2 * _SEGMENT:
            later = np.searchsorted(spaces, at + _SEGMENT)
            stop = int(spaces[later]) if later < len(spaces) else stop
        if at:  # back to the begin of the word before, and over five bytes at least
            earlier = np.searchsorted(spaces, at) - 1
            while earlier > 0 and (known == at or at - known < max(LAST_BYTES) or np.searchsorted(spaces, known) + 1 >= np.searchsorted(spaces, at)):
                earlier -= 1
                known = int(spaces[earlier])
            known = 0 if earlier <= 0 else known
        yield data[known:stop], at - known
        at = stop


def contexts(data: np.ndarray, bits: Sequence[int]) -> np.ndarray:
    """For every byte the first slot of each context, one row per context. Contexts end where the text begins."""
    n = len(data)
    down = [np.uint64(64 - b) for b in bits]
    out = np.empty((CONTEXTS, n), dtype=np.int64)
    text_edge = np.append(True, data[:-1] == _END)
    edge = text_edge | np.append(True, data[:-1] == _SPACE)
    starts = np.flatnonzero(text_edge)
    padded = np.append(np.zeros(max(LAST_BYTES), dtype=np.uint64), data)
    known, done = padded[max(LAST_BYTES) - 1:-1].copy(), 1
    for row, back in enumerate(LAST_BYTES):
        for k in range(done, back):
            known += padded[max(LAST_BYTES) - 1 - k:n + max(LAST_BYTES) - 1 - k] << np.uint64(8 * k)
        last, done, known = known, back, known | np.uint64(1 << 8 * back)
        for k in range(back):  # a text's first bytes know nothing of the text before
            own = starts + k
            own = own[own < n]
            known[own] &= np.uint64((1 << 8 * k) - 1)
        known *= np.uint64(_STEP)
        out[row] = known >> down[row]
        known = last
    at = np.arange(n)
    begins = np.flatnonzero(edge)
    word = np.cumsum(edge) - 1
    first = begins[word]
    up, inverse = powers(n)
    sums = np.zeros(n + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    so_far = (sums[:-1] - sums[first]) * inverse[first] + (at - first).astype(np.uint64)
    so_far *= np.uint64(0xD6E8FEB86659FD93)
    so_far ^= so_far >> np.uint64(32)
    so_far *= np.uint64(_STEP)
    out[len(LAST_BYTES)] = so_far >> down[len(LAST_BYTES)]
    ends = np.append(begins[1:], n)
    whole = mixed((sums[ends] - sums[begins]) * inverse[begins])
    previous = np.append(np.uint64(0), whole[:-1])
    previous[text_edge[begins]] = 0
    so_far ^= previous[word]
    so_far *= np.uint64(0xA24BAED4963EE407)
    out[-1] = so_far >> down[-1]
    return out


@dataclass
class Code:
    """Prefix codes of bytes, one behind the other: ``sizes`` of the paths, and from ``begins`` on each path's decision points, frequent
    ones first, and bits. ``choice`` has the first place of the code for each two bytes before, where there is more than one."""

    sizes: np.ndarray
    begins: np.ndarray
    points: np.ndarray
    bits: np.ndarray
    choice: np.ndarray | None = None

    def places(self, data: np.ndarray) -> np.ndarray:
        """Where each byte of a stream's part, which begins with a word, is found in ``sizes`` and ``begins``."""
        return data.astype(np.int64) if self.choice is None else self.choice.take(before(data)) + data

    def decisions(self, data: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """How many decisions each byte takes, and of all decisions in order the point and the bit."""
        places = self.places(data) if places is None else places
        sizes = self.sizes.take(places, mode="clip")
        upto = np.cumsum(sizes)
        at = np.repeat(self.begins.take(places, mode="clip") - (upto - sizes), sizes)
        at += np.arange(len(at))
        return sizes, self.points.take(at, mode="clip"), self.bits.take(at, mode="clip")


def before(data: np.ndarray) -> np.ndarray:
    """The last two bytes of the word so far as one number, the last one lowest; 0 for what is not there."""
    inside = _INSIDE.take(data)
    last = np.append(np.uint16(0), inside[:-1])
    pair = np.append(np.uint16(0), last[:-1])
    pair <<= 8
    pair += last
    pair *= last > 0
    return pair


def prefix_code(counts: np.ndarray) -> Code:
    """The Huffman code of these counts; every byte has a path, however rare."""
    heap = [(int(c) + 1, i, i) for i, c in enumerate(counts)]
    heapq.heapify(heap)
    parent, side, weight = np.zeros((3, 511), dtype=np.int64)
    fresh = 256
    while len(heap) > 1:
        (a, _, left), (b, _, right) = heapq.heappop(heap), heapq.heappop(heap)
        parent[left] = parent[right] = fresh
        side[right], weight[fresh] = 1, a + b
        heapq.heappush(heap, (a + b, fresh, fresh))
        fresh += 1
    point = np.zeros(511, dtype=np.uint8)
    point[sorted(range(256, 511), key=lambda x: (-weight[x], -x))] = np.arange(255)
    at, steps = np.arange(256), []
    while (at != 510).any():  # from all bytes up to the root
        steps.append((point[parent[at]], side[at].astype(np.int8), at != 510))
        at = np.where(at == 510, 510, parent[at])
    points, bits, there = (np.array(x)[::-1].T for x in zip(*steps))
    sizes = there.sum(axis=1)
    return Code(sizes, np.cumsum(sizes) - sizes, points[there], bits[there])


def chosen_codes(whole: np.ndarray, behind: dict[int, np.ndarray]) -> Code:
    """The code of all bytes, and others of the bytes behind these two, or behind this one (`OTHER` and it), which `before` numbers."""
    codes = [prefix_code(whole), *map(prefix_code, behind.values())]
    choice = np.zeros(1 << 16, dtype=np.int64)
    place = {key: 256 * i for i, key in enumerate(behind, 1)}
    for key in sorted(place, reverse=True):  # those of one byte before those of two
        if key >= OTHER:
            choice[key - OTHER::256] = place[key]
        else:
            choice[key] = place[key]
    lengths = np.cumsum([0, *[len(c.points) for c in codes]])
    return Code(np.concatenate([c.sizes for c in codes]), np.concatenate([c.begins + n for c, n in zip(codes, lengths)]),
                np.concatenate([c.points for c in codes]), np.concatenate([c.bits for c in codes]), choice)


def slots(first: np.ndarray, sizes: np.ndarray, point: np.ndarray, bits: int) -> np.ndarray:
    """The slot of every decision in one context's table: those of one context lie behind its first slot, so they share cache lines."""
    slot = np.repeat(first, sizes)
    slot += point
    slot &= (1 << bits) - 1
    return slot


def states(counts: np.ndarray) -> np.ndarray:
    """Pairs of counts (0, 1) as one 16-bit number: log-odds, and in its last two bits how much was seen."""
    zero, one = counts.reshape(-1, 2).T.astype(np.float64)
    odds = np.clip(np.round(np.log((one + 0.4) / (zero + 0.4)) * _STATE), -2000, 2000).astype(np.int16)
    seen = zero + one
    return (odds * 4 + ((seen > 0).astype(np.int16) + (seen > 2) + (seen > 16))).astype(np.int16)


@dataclass
class Model:
    """Byte code, one table of slot states per context, and starting weights (gate, input)."""

    code: Code
    bits: Sequence[int]
    tables: list[np.ndarray]
    weights: np.ndarray

    def inputs(self, data: np.ndarray, first: np.ndarray, places: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """How many decisions each byte takes, and of all decisions the bit, the inputs (one row each), and the gate."""
        sizes, point, bit = self.code.decisions(data, places)
        x = np.empty((INPUTS, len(point)), dtype=np.float32)
        gate = np.zeros(len(point), dtype=np.int64)
        for k in range(CONTEXTS):
            state = self.tables[k].take(slots(first[k], sizes, point, self.bits[k]), mode="clip")
            if k >= CONTEXTS - 3:  # only the longer contexts can be new
                gate *= 4
                gate += state & 3
            state >>= 2
            np.multiply(state, np.float32(1 / _STATE), out=x[k])
        x[CONTEXTS] = 0.25
        return sizes, bit, x, gate


GATES = 64
_EQUAL = np.append(np.full(CONTEXTS, 1.5 / CONTEXTS), 0.0)


class Fit:
    """Weights per gate by recursive Newton steps on the log loss, from equal weights on: every decision is taken in once.

    ``bend`` is the curvature so far, that of the prior included. What several of them learned adds up, see `learned` and `together`.
    """

    def __init__(self):
        self.weights = np.tile(_EQUAL, (GATES, 1))
        self.bend = np.tile(PRIOR * np.eye(INPUTS), (GATES, 1, 1))
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def add(self, bit: np.ndarray, x: np.ndarray, gate: np.ndarray) -> None:
        self.held.append((bit, x, gate.astype(np.uint8, copy=False)))
        if sum(len(h[0]) for h in self.held) >= REFINED:
            self.refine()

    def refine(self) -> None:
        if not self.held:
            return
        bit, x, gate = (np.concatenate(h, axis=-1) for h in zip(*self.held))
        self.held = []
        order = np.argsort(gate, kind="stable")
        bit = bit.take(order)
        ends = np.append(0, np.cumsum(np.bincount(gate, minlength=GATES)))
        some = np.flatnonzero(np.diff(ends))
        slope = np.zeros((GATES, INPUTS))
        for g in some.tolist():
            xs, ys = x.take(order[ends[g]:ends[g + 1]], axis=1), bit[ends[g]:ends[g + 1]]
            p = self.weights[g].astype(np.float32) @ xs
            np.negative(p, out=p)
            np.exp(np.minimum(p, _STEEPEST, out=p), out=p)
            p += np.float32(1)
            np.reciprocal(p, out=p)
            slope[g] = xs @ (ys - p)
            p -= p * p
            self.bend[g] += (xs * p) @ xs.T
        step = np.linalg.solve(self.bend[some], slope[some, :, None])[:, :, 0]
        self.weights[some] += step * np.minimum(1.0, 0.5 / np.maximum(np.abs(step).max(axis=1, keepdims=True), 1e-9))

    def learned(self) -> np.ndarray:
        """One row per gate: the curvature beyond the prior's, and its part of the sum that the weights are solved from."""
        self.refine()
        own = self.bend - PRIOR * np.eye(INPUTS)
        pull = (self.bend @ self.weights[:, :, None])[:, :, 0] - PRIOR * _EQUAL
        return np.concatenate([own.reshape(GATES, -1), pull], axis=1)


def together(learned: np.ndarray) -> np.ndarray:
    """The weights after the sum of what was learned; to five places, whatever the order of the sum."""
    bend = learned[:, :-INPUTS].reshape(-1, INPUTS, INPUTS) + PRIOR * np.eye(INPUTS)
    pull = learned[:, -INPUTS:] + PRIOR * _EQUAL
    return np.round(np.linalg.solve(bend, pull[:, :, None])[:, :, 0], 5).astype(np.float32)


def fitted_weights(model: Model, texts: list[str]) -> np.ndarray:
    """Weights per gate fitted to texts that did not fill the model's tables."""
    fit = Fit()
    if texts:
        data = stream(texts)
        _, bit, x, gate = model.inputs(data, contexts(data, model.bits))
        fit.add(bit, x, gate)
    return together(fit.learned())


def log_likelihoods(model: Model, texts: list[str], rate: float = RATE, block: int = BLOCK) -> np.ndarray:
    """The natural logarithm of each text's probability.

    What a text adds to the gates' weights starts at zero and follows the slope of its own log-likelihood, block by block.
    """
    out = np.zeros(len(texts))
    gated = np.ascontiguousarray(model.weights.T)
    doc, own, left = 0, np.zeros(INPUTS, dtype=np.float32), block
    for part, skip in segments(stream(texts)):
        first, places = contexts(part, model.bits)[:, skip:], model.code.places(part)[skip:]
        part = part[skip:]
        for low in range(0, len(part), _SLAB):
            slab = part[low:low + _SLAB]
            sizes, bit, x, gate = model.inputs(slab, first[:, low:low + _SLAB], places[low:low + _SLAB])
            upto = np.append(0, np.cumsum(sizes))
            mix = np.zeros(x.shape[1], dtype=np.float32)
            for k in range(INPUTS):
                mix += x[k] * gated[k].take(gate, mode="clip")
            sign = (2 * bit - 1).astype(np.float32)
            likely, docs, starts = np.empty(x.shape[1], dtype=np.float32), [], []
            # A block ends after so many bytes of its text, and with the text.
            begin = 0
            for end in [*(np.flatnonzero(slab == _END) + 1).tolist(), len(slab)]:
                while begin < end:
                    stop = min(end, begin + left)
                    a, b = upto[begin], upto[stop]
                    xs, turned = x[:, a:b], sign[a:b]
                    right = 1 / (1 + np.exp(np.minimum(-(mix[a:b] + own @ xs) * turned, _STEEPEST)))
                    likely[a:b] = right
                    docs.append(doc)
                    starts.append(a)
                    own = own + np.float32(rate) * (xs @ ((1 - right) * turned))
                    left -= stop - begin
                    left = left or block
                    begin = stop
                    if slab[stop - 1] == _END:
                        doc, own, left = doc + 1, np.zeros(INPUTS, dtype=np.float32), block
            np.add.at(out, docs, np.add.reduceat(np.log(likely), starts, dtype=np.float64))
    return out


class Tally:
    """Counts of words and of slots that one task gathers, and the weights that predicted each decision before it was counted."""

    def __init__(self, code: Code, bits: Sequence[int]):
        self.code, self.bits = code, bits
        self.tables = [np.zeros(2 << b, dtype=np.int32) for b in bits]
        self.fit = Fit()
        self.words: Counter[bytes] = Counter()

    def add_slots(self, data: np.ndarray) -> None:
        one = np.int32(1)
        for part, skip in segments(data):
            first, places = contexts(part, self.bits)[:, skip:], self.code.places(part)[skip:]
            part = part[skip:]
            for low in range(0, len(part), _SLAB):
                sizes, point, bit = self.code.decisions(part[low:low + _SLAB], places[low:low + _SLAB])
                x = np.empty((INPUTS, len(point)), dtype=np.float32)
                gate = np.zeros(len(point), dtype=np.uint8)
                for k, table_ in enumerate(self.tables):
                    slot = slots(first[k, low:low + _SLAB], sizes, point, self.bits[k])
                    pair = table_.view(np.int64).take(slot, mode="clip").view(np.int32)
                    if k >= CONTEXTS - 3:  # as in `Model.inputs`
                        gate *= 4
                        seen = pair[::2] + pair[1::2]
                        for least in (0, 2, 16):
                            gate += (seen > least).view(np.uint8)
                    odds = pair.astype(np.float32)
                    odds += np.float32(0.4)
                    np.log(np.divide(odds[1::2], odds[::2], out=x[k]), out=x[k])
                    slot *= 2
                    slot += bit
                    np.add.at(table_, slot, one)
                x[CONTEXTS] = 0.25
                self.fit.add(bit, x, gate)

    def blocks(self) -> Iterator[tuple[int, bytes]]:
        """The slices that hold anything: their numbers through all tables, and their counts."""
        at = 0
        for table_ in self.tables:
            for cut in table_.reshape(-1, 2 << SLICE_BITS):
                if cut.any():
                    yield at, packed_block(cut)
                at += 1


def words_of(data: np.ndarray) -> list[bytes]:
    """The tokens of a stream; the end mark is one."""
    return data.tobytes().replace(b"\n", b"\n ").split(b" ")[:-1]


def byte_code(docs: DataFrame, most: int = OWN_CODES) -> Code:
    """Prefix codes of the bytes of these texts: one for each byte before inside a word, and one for each of the ``most`` frequent two."""
    width = 1 << SLICE_BITS

    def count(batches) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << 24, dtype=np.int32)
        for _, texts in text_batches(batches, most=_TEXTS):
            data = stream(texts)
            at = before(data).astype(np.int64)
            at <<= 8
            at += data
            np.add.at(total, at, np.int32(1))
        single = total.reshape(256, -1).sum(axis=0, dtype=np.int32)
        for i, cut in enumerate([*total.reshape(-1, width), np.pad(single, (0, width - len(single)))]):
            if cut.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], type=pa.int32()), pa.array([packed_block(cut)], type=pa.binary())], names=["slice", "block"])

    def keyed(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows = unpacked_block(block.as_py(), "int64", width).reshape(-1, 256)
                n = rows.sum(axis=1)
                some = np.flatnonzero(n)
                yield pa.RecordBatch.from_arrays([pa.array(some + at * len(rows)), pa.array(n[some]), pa.array([rows[i].tobytes() for i in some], type=pa.binary())],
                                                 names=["key", "n", "counts"])

    parts = docs.select("text").mapInArrow(released(count), "slice int, block binary")
    found = stored(summed_blocks(parts, "int32", "int64", width).mapInArrow(keyed, "key bigint, n bigint, counts binary"), "bytes-behind")
    singles = found.where(F.col("key") >= OTHER).orderBy("key").collect()
    pairs = found.where(F.col("key") < OTHER).orderBy(F.desc("n"), "key").limit(most).collect()
    behind = {r["key"]: np.frombuffer(bytes(r["counts"]), dtype=np.int64) for r in [*singles, *pairs]}
    return chosen_codes(sum((c for key, c in behind.items() if key >= OTHER), np.zeros(256, dtype=np.int64)), behind)


def gathered(docs: DataFrame, code: Code, bits: Sequence[int]) -> DataFrame:
    """(word, n, slice, block, gate, fit): what the tasks count, and what they learn about the weights. Every text has part in all of it."""

    def gather(batches) -> Iterator[pa.RecordBatch]:
        def rows(words=(), counts=(), at=(), blocks=(), gates=(), fits=()):
            n = [len(words), len(at), len(gates)]
            gap = lambda k: [None] * k
            return pa.RecordBatch.from_arrays(
                [pa.array([*words, *gap(n[1] + n[2])], type=pa.binary()).cast(pa.string()), pa.array([*counts, *gap(n[1] + n[2])], type=pa.int64()),
                 pa.array([*gap(n[0]), *at, *gap(n[2])], type=pa.int32()), pa.array([*gap(n[0]), *blocks, *gap(n[2])], type=pa.binary()),
                 pa.array([*gap(n[0] + n[1]), *gates], type=pa.int32()), pa.array([*gap(n[0] + n[1]), *fits], type=pa.list_(pa.float64()))],
                names=["word", "n", "slice", "block", "gate", "fit"])

        tally = Tally(code, bits)
        for _, texts in text_batches(batches, most=_TEXTS):
            data = stream(texts)
            tally.words.update(words_of(data))
            if len(tally.words) > 100_000:
                yield rows(list(tally.words), list(tally.words.values()))
                tally.words = Counter()
            tally.add_slots(data)
        yield rows(list(tally.words), list(tally.words.values()))
        for at, block in tally.blocks():
            yield rows(at=[at], blocks=[block])
        learned = tally.fit.learned()
        some = np.flatnonzero(learned.any(axis=1)).tolist()
        yield rows(gates=some, fits=learned[some].tolist())

    return docs.select("text").mapInArrow(released(gather), "word string, n bigint, slice int, block binary, gate int, fit array<double>")


@dataclass
class Trained:
    """The mixing model, all words' counts (word, n), and the two totals of these counts."""

    model: Model
    counts: DataFrame
    tokens: int
    distinct: int


def train(docs: DataFrame, bits: Sequence[int] = SLOT_BITS) -> Trained:
    """The model of the texts in ``docs`` (null: empty). Repeated rows count as often as they are there; from an empty table comes a
    model that gives every decision even odds, with counts of nothing. Other columns are not read.

    All texts' words are counted, all texts fill the slots, and the starting weights are fitted to all of them. The driver gets the
    tables and one row per gate, whose sizes are fixed.
    """
    code = byte_code(docs)
    made = stored(gathered(docs, code, bits), "gathered")
    counts = stored(made.where("word is not null").groupBy("word").agg(F.sum("n").alias("n")), "word-counts")
    totals = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("tokens"), F.count(F.lit(1)).alias("distinct")).head()

    def settled(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                state = packed_block(states(unpacked_block(block.as_py(), "int64", 2 << SLICE_BITS)))
                yield pa.RecordBatch.from_arrays([pa.array([at], type=pa.int32()), pa.array([state], type=pa.binary())], names=["slice", "block"])

    wide = made.where("slice is not null").select("slice", "block")
    sums = summed_blocks(wide, "int32", "int64", 2 << SLICE_BITS).mapInArrow(settled, "slice int, block binary")
    tables = [np.zeros(1 << b, dtype=np.int16) for b in bits]
    begins = np.append(0, np.cumsum([1 << (b - SLICE_BITS) for b in bits]))
    for r in sums.toLocalIterator():
        k = int(np.searchsorted(begins, r["slice"], side="right")) - 1
        low = (r["slice"] - int(begins[k])) << SLICE_BITS
        tables[k][low:low + (1 << SLICE_BITS)] = unpacked_block(bytes(r["block"]), "int16", 1 << SLICE_BITS)
    learned = np.zeros((GATES, INPUTS * INPUTS + INPUTS))
    sums = [F.sum(F.col("fit")[i]) for i in range(learned.shape[1])]
    for gate, *row in made.where("gate is not null").groupBy("gate").agg(*sums).collect():
        learned[gate] = row
    model = Model(code, tuple(bits), tables, together(learned))
    return Trained(model, counts, int(totals["tokens"]), int(totals["distinct"]))


def frequent_words(counts: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """The most frequent words of up to `FREQUENT_BYTES` bytes, at most ``most``, by how often they are there: all words of a count, or none."""
    short = counts.where(F.octet_length("word") <= FREQUENT_BYTES)
    steps = short.groupBy(F.floor(F.log2("n") * 64).alias("step")).agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("step")).collect()
    total, least = 0, None
    for r in steps:
        total += r["words"]
        if total > most:
            break
        least = r["step"]
    if least is None:
        return {}
    return {r["word"].encode("utf-8", "surrogatepass"): r["n"] for r in short.where(F.floor(F.log2("n") * 64) >= least).toLocalIterator()}


def scored(docs: DataFrame, trained: Trained) -> DataFrame:
    """Rows of ``docs`` with n_tokens, n_known, base_score and score.

    Tokens are the words of the text, letters A to Z lower-cased, and one end. n_known are those that the counts know; base_score
    is the sum of log10((c + 0.5) / (N + 0.5 (V + 1))) over the tokens, score the base-10 logarithm of the text's probability in the
    mixing model, whose stream has the same words and nothing else. A null or empty text is one end; texts of any length are scored
    whole, repeated rows each for themselves. Columns of ``docs`` with these names are replaced.
    """
    spark, model = docs.sparkSession, trained.model
    known = frequent_words(trained.counts)
    sent = spark.sparkContext.broadcast((model, known))
    whole = trained.tokens + 0.5 * (trained.distinct + 1)
    new = ["n_tokens", "n_known", "base_score", "score"]
    keep = [c for c in docs.columns if c not in (*new, "text")]
    own = [f"_k{i}" for i in range(len(keep))]

    def score(batches) -> Iterator[pa.RecordBatch]:
        mixer, often = sent.value
        row = TaskContext.get().partitionId() << 40
        for batch, texts in text_batches(batches, most=_TEXTS):
            data = stream(texts)
            tokens = words_of(data)
            found = np.fromiter(map(often.get, tokens, repeat(0)), dtype=np.float64, count=len(tokens))
            stops = np.flatnonzero(data[(data == _SPACE) | (data == _END)] == _END)  # tokens end where these are
            doc = np.repeat(np.arange(len(texts)), np.diff(stops, prepend=-1))
            is_known = found > 0
            base = np.bincount(doc, weights=np.where(is_known, np.log10((found + 0.5) / whole), 0.0), minlength=len(texts))
            rare = np.flatnonzero(~is_known)
            others = [tokens[i] for i in rare.tolist()]
            names = list(dict.fromkeys(others))
            code = dict(zip(names, range(len(names))))
            ids = np.fromiter(map(code.__getitem__, others), dtype=np.int64, count=len(others))
            key, n = np.unique(doc[rare] * len(names) + ids, return_counts=True)
            words = pa.array([names[i] for i in key % max(len(names), 1)], type=pa.binary()).cast(pa.string())
            upto = np.searchsorted(key // max(len(names), 1), np.arange(len(texts) + 1)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(upto), pa.StructArray.from_arrays([words, pa.array(n)], names=["word", "n"]))
            yield with_columns(batch, own, {
                "_row": pa.array(np.arange(row, row + len(texts))), "n_tokens": pa.array(np.diff(stops, prepend=-1)),
                "_often": pa.array(np.bincount(doc, weights=is_known, minlength=len(texts)).astype(np.int64)), "_base": pa.array(base),
                "score": pa.array(log_likelihoods(mixer, texts) / np.log(10)), "_rare": lists})
            row += len(texts)

    named = docs.select(*[F.col(c).alias(o) for c, o in zip(keep, own)], "text")
    added = "_row bigint, n_tokens bigint, _often bigint, _base double, score double, _rare array<struct<word:string,n:bigint>>"
    schema = StructType([*named.drop("text").schema, *StructType.fromDDL(added)])
    made = stored(named.mapInArrow(released(score), schema), "scored")
    rare = made.select("_row", F.explode("_rare").alias("r")).select("_row", "r.word", F.col("r.n").alias("times"))
    c = F.coalesce("n", F.lit(0))
    rare = (rare.join(trained.counts, "word", "left").groupBy("_row")
            .agg(F.sum(F.col("times") * F.log10((c + 0.5) / whole)).alias("_more"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("_seen")))
    zero = F.lit(0)
    return made.drop("_rare").join(rare, "_row", "left").select(
        *[F.col(o).alias(k) for k, o in zip(keep, own)], "n_tokens", (F.col("_often") + F.coalesce("_seen", zero)).alias("n_known"),
        (F.col("_base") + F.coalesce("_more", zero.cast("double"))).alias("base_score"), "score")


@query("op11_context_mixing")
def op11_context_mixing(spark, sf_dir):
    """Every document's log-probability, by a model of those whose crc32 leaves another remainder than 1, and by their word counts."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", held_out(5, 1).alias("held_out"))
    trained = train(docs.where("not held_out"))
    return scored(docs, trained).select("doc_id", "held_out", "n_tokens", "n_known", F.lit(trained.tokens).cast("bigint").alias("train_tokens"),
                                        "base_score", "score")
