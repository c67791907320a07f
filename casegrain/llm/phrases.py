"""Fingerprints by locally consistent parsing: hierarchical phrases whose borders and names depend on nearby text alone.

A level first joins runs of equal symbols. Deterministic coin tossing then gives every symbol the position of the lowest bit
in which it differs from the one before, and that bit; four rounds leave six labels, unequal for neighbours. Phrases begin at
local minima of the labels, so they have from two to about a dozen symbols, and are named by a hash of what they hold. Names
are the symbols of the next level. Equal substrings are parsed alike but for a few symbols at their ends, wherever they stand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from casegrain.llm.common import code_points, mixed, powers, query, table

#: Levels whose phrases make up a fingerprint (about 9 and 27 characters), and the names kept of each.
LEVELS, KEPT = (2, 3), 32
_BATCH = 300_000


def _pair_labels() -> np.ndarray:
    a, b = np.meshgrid(np.arange(128), np.arange(128), indexing="ij")
    differ = a ^ b
    low = differ & -differ
    place = np.zeros_like(low)
    for bit in range(7):
        place[low == 1 << bit] = bit
    return (2 * place + ((b >> place) & 1)).astype(np.uint8).reshape(-1)


_PAIRS = _pair_labels()


def labels(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Labels 0 to 5, unequal for neighbours, of symbols that differ from the one before. ``first`` marks where texts begin;
    there the symbol counts as differing from the one before in the lowest bit."""
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = symbols[first] ^ symbols.dtype.type(1)
    differ = symbols ^ before
    low = differ & (~differ + differ.dtype.type(1))
    place = np.bitwise_count(low - low.dtype.type(1)).astype(symbols.dtype)
    out = (place * symbols.dtype.type(2) + ((symbols >> place) & symbols.dtype.type(1))).astype(np.uint8)
    for _ in range(3):
        before = np.empty_like(out)
        before[1:] = out[:-1]
        before[first] = out[first] ^ 1
        out = _PAIRS[before.astype(np.int32) * 128 + out]
    return out


def next_level(symbols: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The phrases of all texts, as symbols, and the offsets of the texts."""
    if not len(symbols):
        return symbols.astype(np.uint64), offsets
    begin = np.zeros(len(symbols) + 1, dtype=bool)
    begin[offsets] = True
    begin = begin[:-1]
    new = begin.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    length = np.diff(np.append(at, len(symbols)))
    single = symbols[at]
    names, first = _run_names(single, length), begin[at]
    tags = labels(single, first)
    border = first.copy()
    if len(tags) > 2:
        border[1:-1] |= (tags[1:-1] < tags[:-2]) & (tags[1:-1] < tags[2:]) & ~first[2:]
    starts = np.flatnonzero(border)
    ends = np.append(starts[1:], len(names))
    up, down = powers(len(names))
    sums = np.zeros(len(names) + 1, dtype=np.uint64)
    np.cumsum(names * up, out=sums[1:])
    phrases = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    runs_before = np.append(0, np.cumsum(new))[offsets]
    return phrases, np.append(0, np.cumsum(border))[runs_before]


def _run_names(symbols: np.ndarray, length: np.ndarray) -> np.ndarray:
    names = symbols.astype(np.uint64) + np.uint64(1)
    long = length > 1
    names[long] = mixed(names[long] ^ (length[long].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return names


def sketches(texts: list[str]) -> list[list[np.ndarray]]:
    """Per text and level, the smallest names (32 bits), at most `KEPT`, in ascending order."""
    symbols, offsets = code_points(texts)
    out: list[list[np.ndarray]] = [[] for _ in texts]
    for level in range(1, max(LEVELS) + 1):
        symbols, offsets = next_level(symbols, offsets)
        if level in LEVELS:
            short = (symbols >> np.uint64(32)).astype(np.uint32)
            for own, a, b in zip(out, offsets[:-1], offsets[1:]):
                names = np.unique(short[a:b])
                own.append(names[:KEPT])
    return out


def written(sketch: list[np.ndarray]) -> str:
    """A fingerprint: the names of each level in hexadecimal digits, levels by a colon."""
    return ":".join(s.astype(">u4").tobytes().hex() for s in sketch)


def likeness(a: list[np.ndarray], b: list[np.ndarray]) -> float:
    """Estimated Jaccard similarity of the phrase sets, the mean of the levels; 1 for two texts without phrases."""
    shares = []
    for x, y in zip(a, b):
        x, y = set(x.tolist()), set(y.tolist())
        if both := sorted(x | y)[:KEPT]:
            shares.append(sum(n in x and n in y for n in both) / len(both))
    return sum(shares) / len(shares) if shares else 1.0


def in_order(docs: DataFrame) -> DataFrame:
    """(doc_id, text, target, extra) in tasks by ascending id, each followed by its successor.

    Ids are cut at quantiles; ``target`` numbers the ranges. The rows with the smallest id of each range are dealt a second
    time, marked ``extra``, to the range before (those of the first to the last), so texts move once and no task needs
    another's rows. Null ids come last. The driver gets one number per range.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    asked = [i / parts for i in range(1, parts)]
    cuts = docs.select(F.percentile_approx("doc_id", asked, 100_000).alias("cuts")).first()["cuts"] if asked else []
    cuts = np.unique(np.array(cuts or [], dtype=np.int64))

    def ranges(ids: pd.Series) -> np.ndarray:
        null = ids.isna().to_numpy()
        at = np.searchsorted(cuts, ids.fillna(0).to_numpy(dtype=np.int64), side="right")
        return np.where(null, len(cuts), at)

    @F.pandas_udf("int")
    def range_of(ids: pd.Series) -> pd.Series:
        return pd.Series(ranges(ids)).astype("int32")

    firsts = (docs.where("doc_id is not null").select("doc_id", range_of("doc_id").alias("target"))
              .groupBy("target").agg(F.min("doc_id").alias("doc_id")).orderBy("target").collect())
    heads = np.array([r["doc_id"] for r in firsts], dtype=np.int64)
    owners = np.array([r["target"] for r in firsts], dtype=np.int64)
    if len(heads):
        # Null ids stand at the end of the last range.
        owners = np.append(owners, len(cuts)) if docs.where("doc_id is null").limit(1).count() and owners[-1] != len(cuts) else owners

    @F.pandas_udf("array<int>")
    def targets_of(ids: pd.Series) -> pd.Series:
        own = ranges(ids)
        at = np.searchsorted(heads, ids.fillna(0).to_numpy(dtype=np.int64))
        found = (at < len(heads)) & ~ids.isna().to_numpy()
        found[found] = heads[at[found]] == ids.to_numpy()[found].astype(np.int64)
        return pd.Series([[o, int(owners[i - 1])] if f else [o] for o, i, f in zip(own.tolist(), at.tolist(), found.tolist())])

    dealt = docs.select("doc_id", "text", F.posexplode(targets_of("doc_id")).alias("extra", "target"))
    return (dealt.repartitionById(len(cuts) + 1, F.col("target"))
            .sortWithinPartitions("extra", F.col("doc_id").asc_nulls_last(), "text"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every text, of its edited text, and their likeness.

    (doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) for every row. A null text is
    empty. In the edited text the last floor(n_chars / 4) code points are replaced by the first as many of the next text, by
    ascending id; equal ids go by text, null ids come last, after the last row comes the first. Equal texts have equal
    fingerprints. An empty table gives an empty result; other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType

    def parsed(ids: list, texts: list[str]) -> pa.RecordBatch:
        """Rows for all texts but the last, which is the next of the one before."""
        edited, hashes = [], []
        for text, after in zip(texts[:-1], texts[1:]):
            cut = len(text) // 4
            edited.append(text[:len(text) - cut] + after[:cut])
            hashes.append(hashlib.sha256(edited[-1].encode("utf-8", "surrogatepass")).hexdigest())
        found, changed = sketches(texts), sketches(edited)
        return pa.RecordBatch.from_arrays([
            pa.array(ids[:-1], type=types[0]), pa.array([len(t) for t in texts[:-1]], type=pa.int64()), pa.array(hashes, type=pa.string()),
            pa.array(map(written, found[:-1]), type=pa.string()), pa.array(map(written, changed), type=pa.string()),
            pa.array([likeness(a, b) for a, b in zip(found, changed)], type=pa.float64()),
            pa.array([likeness(a, b) for a, b in zip(found, found[1:])], type=pa.float64())], names=names)

    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    types = [pa.int64() if isinstance(kind, T.LongType) else pa.int32()]

    def walk(batches) -> Iterator[pa.RecordBatch]:
        ids, texts, size, done = [], [], 0, False
        for batch in batches:
            for i, text, extra in zip(*(batch.column(c).to_pylist() for c in range(3))):
                if done:
                    break
                ids.append(i)
                texts.append(text or "")
                size += len(texts[-1])
                done = extra > 0
                if size > _BATCH and len(texts) > 1:
                    yield parsed(ids, texts)
                    ids, texts = ids[-1:], texts[-1:]
                    size = len(texts[0])
        if texts and not done:  # ids are all null: the last text has no other after it
            ids.append(None)
            texts.append("")
        if len(texts) > 1:
            yield parsed(ids, texts)

    schema = T.StructType([T.StructField("doc_id", kind), T.StructField("n_chars", T.LongType())]
                          + [T.StructField(n, T.StringType()) for n in names[2:5]] + [T.StructField(n, T.DoubleType()) for n in names[5:]])
    return in_order(docs.select("doc_id", "text")).select("doc_id", "text", "extra").mapInArrow(walk, schema)


@query("op9_phrase_fingerprints")
def op9_phrase_fingerprints(spark, sf_dir):
    """Every document's fingerprint, that of its edited text, and what they have in common."""
    return fingerprints(table(spark, sf_dir, "documents"))
