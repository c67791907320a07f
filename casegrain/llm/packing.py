"""Best-fit decreasing packing of documents into sequences of fixed length.

The packing is that of all pieces together, not of one task's share: pieces of equal length are interchangeable, so the
decisions need only how many there are of each length, at most ``capacity`` numbers.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from casegrain.llm.common import query, released, table, text_batches, with_columns, worker_state
from casegrain.session import stored

CAPACITY = 2048
END_ID = 0
TOKENIZER = "word_bpe_49k.json"


#: Words whose ids a Python worker remembers, about 150 bytes each: fewer take less memory and more encoding.
REMEMBERED = 400_000

#: A run of these after a letter and before white space is a token of its own (apostrophes and marks of special ids are not in it).
#: The mark comes first and the letter is looked back for: the search then skips all bytes that are no marks.
_TAIL = re.compile(rb"""[.,;:!?)*#%&$"\]](?<=[a-z].)[.,;:!?)*#%&$"\]]*+(?=[ \n])""")


class WordEncoder:
    """Token ids of many texts, each distinct word encoded once.

    For tokenizers that lower letters, split at white space and drop it, and keep letters apart from other characters: a
    text's ids are then the ids of its words in order. The words that are remembered are forgotten when they are more than
    ``most``, or their ids more than eight times as many.
    """

    def __init__(self, path: str, most: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        # Ids that end a word: then many words of letters can be encoded as one text.
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.last[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.begins = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.uint32)

    def _encoded(self, words: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words in some order, their ids in one array, and how many each has."""
        plain, other = [], []
        for w in words:
            (plain if w.isalpha() else other).append(w)
        ids = np.zeros(0, dtype=np.uint32)
        if plain:
            made = self.tokenizer.encode_batch_fast([" ".join(plain[i:i + 256]) for i in range(0, len(plain), 256)], add_special_tokens=False)
            ids = np.concatenate([np.array(m.ids, dtype=np.uint32) for m in made])
        ends = np.flatnonzero(self.last[ids]) + 1
        if len(ends) != len(plain) or len(plain) and ends[-1] != len(ids):  # some word of letters is several to the tokenizer
            plain, other, ids, ends = [], words, ids[:0], ends[:0]
        rest = [m.ids for m in self.tokenizer.encode_batch_fast(other, add_special_tokens=False)] if other else []
        return ([*plain, *other], np.concatenate([ids, *(np.array(r, dtype=np.uint32) for r in rest)]),
                np.append(np.diff(ends, prepend=0), np.array([len(r) for r in rest], dtype=np.int64)))

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array and the offsets of the texts, the end last."""
        joined = "\n".join([t.replace("\n", " ") for t in texts]) + "\n"
        lines = _TAIL.sub(rb" \g<0>", joined.encode("utf-8", "surrogatepass").lower()).decode("utf-8", "surrogatepass")
        lines = lines.replace("\t", " ").replace("\r", " ").split("\n")[:-1]
        words = " ".join(lines).split(" ")
        if len(self.known) > self.most or len(self.ids) > 8 * self.most:
            self.clear()
        # Each word is looked up once, and those that were new then once more.
        code = np.fromiter(map(self.known.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        if len(new := np.flatnonzero(code < 0)):
            unknown = [words[i] for i in new.tolist()]
            fresh = list(dict.fromkeys(unknown))
            for at in range(0, len(fresh), 8192):
                some, made, sizes = self._encoded(fresh[at:at + 8192])
                self.known.update(zip(some, range(len(self.known), len(self.known) + len(some))))
                self.ids = np.concatenate([self.ids, made])
                self.begins = np.append(self.begins, self.begins[-1] + np.cumsum(sizes))
            code[new] = np.fromiter(map(self.known.__getitem__, unknown), dtype=np.int64, count=len(new))
        sizes = self.begins[code + 1] - self.begins[code]
        upto = np.append(0, np.cumsum(sizes))
        ids = self.ids[np.repeat(self.begins[code] - upto[:-1], sizes) + np.arange(upto[-1])]
        word_ends = np.cumsum([line.count(" ") + 1 for line in lines])
        return ids, np.append(0, upto[word_ends])


class OpenBins:
    """Segment tree over remaining capacities 0 .. capacity: the tightest capacity with an open bin in logarithmic time.

    Bins of equal remaining capacity are runs of consecutive numbers.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.any = [False] * (2 * self.size)
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(self.size)]

    def _mark(self, room: int) -> None:
        node = self.size + room
        self.any[node] = bool(self.runs[room])
        while node > 1:
            node //= 2
            self.any[node] = self.any[2 * node] or self.any[2 * node + 1]

    def add(self, room: int, first: int, count: int) -> None:
        if room and count:
            self.runs[room].append((first, count))
            self._mark(room)

    def take(self, room: int) -> tuple[int, int]:
        run = self.runs[room].pop()
        self._mark(room)
        return run

    def tightest(self, need: int) -> int | None:
        """The smallest remaining capacity of at least ``need`` that an open bin has."""
        node = self.size + need
        if self.any[node]:
            return need
        while node > 1:
            if node % 2 == 0 and self.any[node + 1]:
                node += 1
                while node < self.size:
                    node = 2 * node if self.any[2 * node] else 2 * node + 1
                return node - self.size
            node //= 2
        return None


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Placements (length, first rank, pieces per bin, first bin, offset in it) and the number of bins.

    The longest pieces go first, each into the open bin with the least room that holds it, else into a new one. A bin that
    was the tightest stays so until it has no room for another piece of the length, so all bins of equal room are filled in
    one step: rank r of its length, counted from the first rank, goes to bin (r // per bin) at offset (r % per bin) * length.
    """
    bins, opened, plan = OpenBins(capacity), 0, []
    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            room = bins.tightest(length)
            if room is None:
                room, first, count = capacity, opened, -(-left // (capacity // length))
                opened += count
            else:
                first, count = bins.take(room)
            each = room // length
            full = min(count, left // each)
            part = left - full * each if full < count else 0
            plan.append((length, rank, each, first, capacity - room))
            bins.add(room - each * length, first, full)
            if part:
                bins.add(room - part * length, first + full, 1)
            bins.add(room, first + full + bool(part), count - full - bool(part))
            rank += full * each + part
            left -= full * each + part
    return plan, opened


def pieces(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, task, rank[, ids]): tokenised documents, cut where longer than a sequence.

    ``rank`` counts pieces of the same length within ``task``, so it holds only for a table that was stored.
    """

    def cut(batches) -> Iterator[pa.RecordBatch]:
        known, task = worker_state(), TaskContext.get().partitionId()
        encode = known.get((tokenizer, remembered)) or known.setdefault((tokenizer, remembered), WordEncoder(tokenizer, remembered))
        seen = np.zeros(capacity + 1, dtype=np.int64)
        for batch, texts in text_batches(batches):
            ids, offsets = encode(texts)
            sizes = np.diff(offsets) + 1
            n = -(-sizes // capacity)
            doc = np.repeat(np.arange(len(texts)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            start = piece * capacity
            length = np.minimum(capacity, sizes[doc] - start)
            whole = np.zeros(len(ids) + len(texts), dtype="<u4") + np.uint32(END_ID)
            ends = np.cumsum(sizes)
            body = np.ones(len(whole), dtype=bool)
            body[ends - 1] = False
            whole[body] = ids
            begin = (ends - sizes)[doc] + start
            cuts = [whole[b:b + k] for b, k in zip(begin, length)]
            order = np.argsort(length, kind="stable")
            ordered = length[order]
            rank = np.empty(len(length), dtype=np.int64)
            rank[order] = np.arange(len(length)) - np.searchsorted(ordered, ordered) + seen[ordered]
            np.add.at(seen, length, 1)
            columns = {
                "piece": pa.array(piece.astype(np.int32)), "start": pa.array(start), "length": pa.array(length),
                "ids_crc32": pa.array([zlib.crc32(c.tobytes()) for c in cuts], type=pa.int64()),
                "task": pa.array(np.full(len(doc), task, dtype=np.int32)), "rank": pa.array(rank)}
            if keep_ids:
                columns["ids"] = pa.array([c.astype(np.int32) for c in cuts], type=pa.list_(pa.int32()))
            yield with_columns(batch.select(["doc_id"]).take(pa.array(doc)), ["doc_id"], columns)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, task int, rank bigint"
    return docs.select("doc_id", "text").mapInArrow(released(cut, remembers=True), schema + (", ids array<int>" if keep_ids else ""))


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False, remembered: int = REMEMBERED) -> DataFrame:
    """Pieces of documents with the ``sequence_id`` and ``offset`` they are packed at, and their ids where asked for.

    A document is the ids of its text and an end id (0); a null text is empty. A document longer than ``capacity`` is cut
    into full pieces and a rest; all others stay whole. Sequences hold at most ``capacity`` ids without gaps. The number of
    sequences is that of best-fit decreasing over all pieces. Rows with equal or null ids are documents of their own; an
    empty table gives an empty result, other columns are not read.

    ``tokenizer`` is the path of a tokenizer file that every executor has. The driver gets one count per length, at most
    ``capacity`` numbers, and sends back the placements: a few per length and distinct room left, whatever the table's size.
    """
    made = stored(pieces(docs, tokenizer, capacity, keep_ids, remembered), "pieces")
    tallies = stored(made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "tallies")
    counts = {r["length"]: r["n"] for r in tallies.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, _ = best_fit_decreasing(counts, capacity)
    steps = np.array(sorted(plan), dtype=np.int64).reshape(-1, 5)

    before = F.sum("n").over(Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1))
    offsets = tallies.select("task", "length", F.coalesce(before, F.lit(0)).alias("before"))

    def place(batches) -> Iterator[pa.RecordBatch]:
        at_length = {k: (np.searchsorted(steps[:, 0], k), np.searchsorted(steps[:, 0], k, side="right"))
                     for k in np.unique(steps[:, 0])}
        for batch in batches:
            length, rank = (np.asarray(batch.column(batch.schema.get_field_index(c)), dtype=np.int64) for c in ("length", "rank"))
            row = np.empty(len(length), dtype=np.int64)
            for k in np.unique(length):
                own = length == k
                a, b = at_length[k]
                row[own] = a + np.searchsorted(steps[a:b, 1], rank[own], side="right") - 1
            _, first_rank, each, first, base = steps[row].T
            past = rank - first_rank
            yield with_columns(batch, keep, {"sequence_id": pa.array(first + past // each),
                                             "offset": pa.array(base + past % each * length)})

    keep = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
    ranked = made.join(offsets, ["task", "length"]).withColumn("rank", F.col("rank") + F.col("before")).select(*keep, "rank")
    schema = ranked.drop("rank").schema.add("sequence_id", "long").add("offset", "long")
    return ranked.mapInArrow(released(place), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids): the packed sequences, each of at most the capacity, from pieces that kept their ids."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))


def public_tokenizer(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op3_best_fit_packing")
def op3_best_fit_packing(spark, sf_dir):
    """Every document packed into sequences of 2048 ids."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizer())
