"""What the operators on documents share: the query registry, batches of texts, hashed words and code points."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Characters of text that one task holds as numbers at a time; a longer text is one batch of its own.
BATCH_CHARS = 400_000


def worker_state() -> dict:
    """A dictionary that the Python worker keeps for further tasks, until one of another operator begins there, see `released`."""
    import pyspark

    return vars(pyspark).setdefault("_document_worker_state", {})


def released(fn, remembers: bool = False):
    """``fn`` for ``mapInArrow``, after which the worker gives memory that is free back to the machine, for whatever runs there next.

    What the tasks of another operator left in `worker_state` goes before, unless ``fn`` is one that ``remembers``.
    """

    def run(batches):
        if not remembers:
            worker_state().clear()
        try:
            yield from fn(batches)
        finally:
            import ctypes
            import gc

            gc.collect()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim:
                trim(0)

    return run


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir)`` under ``name`` with its comparison SQL, if there is one."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(divisor: int, remainder: int, column: str = "doc_id") -> Column:
    """Whether crc32 of the id, written as text, leaves this remainder. A null id is written as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit(""))) % divisor == remainder


def text_batches(batches: Iterable[pa.RecordBatch], text: str = "text",
                 most: int = BATCH_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Slices of Arrow batches whose texts together are about ``most`` characters, with the texts (null: empty)."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = np.cumsum(np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64))
        start = 0
        while start < batch.num_rows:
            done = sizes[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, done + most, side="right")))
            part = batch.slice(start, stop - start)
            yield part, [t or "" for t in part.column(part.schema.get_field_index(text)).to_pylist()]
            start = stop


def with_columns(batch: pa.RecordBatch, keep: Sequence[str], new: dict[str, pa.Array]) -> pa.RecordBatch:
    """Columns of a batch by name, followed by new ones."""
    columns = {name: batch.column(batch.schema.get_field_index(name)) for name in keep} | new
    return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def packed_block(numbers: np.ndarray) -> bytes:
    """Numbers as compressed bytes."""
    return pa.compress(np.ascontiguousarray(numbers).tobytes(), codec="zstd", asbytes=True)


def unpacked_block(block: bytes, kind: str, length: int) -> np.ndarray:
    size = length * np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(block, decompressed_size=size, codec="zstd", asbytes=True), dtype=kind)


def summed_blocks(parts: DataFrame, kind: str, out: str, length: int) -> DataFrame:
    """(slice, block): the sum of all compressed blocks of a slice, from numbers of one kind to numbers of another.

    Blocks (slice int, block binary) of one slice follow each other in a task, which holds one sum at a time however many there are.
    """

    def add(batches) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], type=pa.int32()), pa.array([packed_block(total)], type=pa.binary())],
                                              names=["slice", "block"])

        at, total = None, None
        for batch in batches:
            for key, block in zip(batch.column(0).to_pylist(), batch.column(1)):
                if key != at:
                    if at is not None:
                        yield row()
                    at, total = key, np.zeros(length, dtype=out)
                total += unpacked_block(block.as_py(), kind, length)
        if at is not None:
            yield row()

    return (parts.select("slice", "block").repartition("slice").sortWithinPartitions("slice")
            .mapInArrow(add, "slice int, block binary"))


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every input bit over the whole word (in place for fresh arrays)."""
    x = x ^ (x >> np.uint64(33))
    x *= np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in one array and the offsets where texts begin, the end last."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return points, offsets


def folded(texts: Sequence[str], digits: bool) -> tuple[np.ndarray, np.ndarray]:
    """Code points of the texts in lower case and their offsets; what is no letter (or digit, where asked for) of ASCII is one
    space, and each text begins and ends with one."""
    points, offsets = code_points([f" {t.lower()} " for t in texts])
    blank = (_NO_WORD if digits else _NO_LETTER)[np.minimum(points, 127)]
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    keep[offsets[:-1]] = True
    points = np.where(blank, np.uint32(32), points)[keep]
    return points, np.append(0, np.cumsum(keep))[offsets]


_NO_WORD = np.array([not chr(c).isalnum() for c in range(127)] + [False])
_NO_LETTER = np.array([not chr(c).isalpha() for c in range(127)] + [False])

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


_KEPT_POWERS = 1 << 19


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first powers of the base and of its inverse. Few are kept for later calls, more are made anew."""
    def made(base: int, size: int) -> np.ndarray:
        steps = np.full(size, base, dtype=np.uint64)
        steps[:1] = 1
        return np.multiply.accumulate(steps)

    if n > _KEPT_POWERS:
        return made(_BASE, n), made(_INVERSE, n)
    if not _POWERS:
        _POWERS.update(up=made(_BASE, _KEPT_POWERS), down=made(_INVERSE, _KEPT_POWERS))
    return _POWERS["up"][:n], _POWERS["down"][:n]


#: ASCII white space and punctuation, which stand between words.
_BREAK = np.zeros(256, dtype=bool)
_BREAK[[c for c in range(128) if not chr(c).isalnum()]] = True


def hashed_words(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per word of all texts, and the offsets where each text's words begin, the end last.

    Words are runs without ASCII white space, punctuation and control characters, in lower case. All words are hashed at
    once: differences of a running polynomial sum.
    """
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b" ".join(encoded) + b" ", dtype=np.uint8)
    begins = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum([len(e) + 1 for e in encoded], out=begins[1:])
    space = _BREAK[data]
    edge = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = edge[0::2], edge[1::2]
    up, down = powers(len(data))
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up, out=sums[1:])
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    return words, np.searchsorted(starts, begins)


def shingles(texts: Sequence[str], width: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash per run of ``width`` words and the offsets of the texts. A shorter text with words is one shingle."""
    words, at = hashed_words(texts)
    counts = np.diff(at)
    made = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
    offsets = np.zeros(len(texts) + 1, dtype=np.int64)
    np.cumsum(made, out=offsets[1:])
    first = np.repeat(at[:-1] - offsets[:-1], made) + np.arange(offsets[-1])
    last = np.repeat(at[1:], made)
    total = np.zeros(offsets[-1], dtype=np.uint64)
    padded = np.append(words, np.zeros(width, dtype=np.uint64))
    for k in range(width):
        factor = np.uint64(pow(0xD6E8FEB86659FD93, k + 1, 1 << 64))
        total += np.where(first + k < last, padded[first + k], np.uint64(0)) * factor
    return mixed(total), offsets
