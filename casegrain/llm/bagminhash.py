"""Near-duplicate texts by BagMinHash: weighted-Jaccard signatures of word shingle multisets, banded and verified.

A signature has ``bands * rows`` registers. Every shingle owns Poisson processes of points in time, one per dyadic range of
weights (0,1], (1,2], (2,4], ...; their rate grows with the length of the range. A point carries a register and a place in
its range, whose leading bits are the coin tosses that split the range in halves, again and again; it counts for a text when
its place lies below the shingle's count there. The earliest point of a register is the register's value, so two texts agree
in a register with probability equal to their weighted Jaccard similarity. Only points earlier than the time by which all
registers of a text are filled matter: a text needs about ``m log m`` points, however long it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from casegrain.llm.common import mixed, packed_block, query, released, shingles, summed_blocks, table, text_batches, unpacked_block
from casegrain.operators.resolve import canonical_ids
from casegrain.session import stored

SHINGLE_WORDS = 5
LEAST = 0.8
#: With 24 bands of 4 registers a pair at similarity 0.8 shares no band with probability (1 - 0.8^4)^24, 3 in a million.
BANDS, ROWS = 24, 4

#: Families of more texts than this are searched by their differences instead of pair by pair.
SMALL_FAMILY = 16

_BITS = 512
#: Counters of names (a power of two), and how many are summed at a time.
_COUNTER_BITS, _COUNTER_SLICE = 22, 1 << 16
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SPARE = 6.0


def bags(texts: list[str], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts, sorted inside each text, and the offsets of the texts."""
    hashes, offsets = shingles(texts, width)
    for a, b in zip(offsets[:-1], offsets[1:]):
        hashes[a:b].sort()
    return hashes, offsets


def _points(key, weight, owner, limit, m):
    """(owner, register, time, name) of the points of weighted elements that come before their owner's time limit."""
    found = []
    low, size, level = 0, 1, 1
    while True:
        at = np.flatnonzero(weight > low)
        if not len(at):
            break
        seed = mixed(key[at] + np.uint64(level * 0xA24BAED4963EE407 & 0xFFFFFFFFFFFFFFFF))
        time, step, rate = np.zeros(len(at)), 0, m * size
        until = limit[owner[at]]
        while len(at):
            # Few open processes take many steps at once; times are added one after the other either way.
            many = 1 if len(at) > 2048 else min(256, 1 + 16384 // len(at))
            steps = np.arange(step + 1, step + 1 + many, dtype=np.uint64) * _STEP
            name = mixed(seed[:, None] + steps[None, :])
            gap = -np.log(((name >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53) / rate
            gap[:, 0] += time
            times = np.add.accumulate(gap, axis=1)
            place = mixed(name ^ np.uint64(0x8BB84B93962EACC9))
            height = low + (place & np.uint64(size - 1)).astype(np.int64)
            row, col = np.nonzero((times < until[:, None]) & (height < weight[at][:, None]))
            register = (((place[row, col] >> np.uint64(32)) * np.uint64(m)) >> np.uint64(32)).astype(np.int64)
            found.append((owner[at][row], register, times[row, col], name[row, col]))
            going = times[:, -1] < until
            at, seed, until, time, step = at[going], seed[going], until[going], times[going, -1], step + many
        low, size, level = (1, 1, 2) if level == 1 else (low + size, low + size, level + 1)
    return [np.concatenate(x) for x in zip(*found)]


def signatures(hashes: np.ndarray, offsets: np.ndarray, m: int) -> np.ndarray:
    """One row of ``m`` register values per text; texts without shingles have zeros."""
    n = len(offsets) - 1
    total = np.diff(offsets)
    out = np.zeros((n, m), dtype=np.uint64)
    if not len(hashes):
        return out
    owner = np.repeat(np.arange(n), total)
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
    first = np.flatnonzero(new)
    weight = np.diff(np.append(first, len(hashes)))
    key, owner = hashes[first], owner[first]
    limit = (np.log(m) + _SPARE) / np.maximum(total, 1)
    open_texts = total > 0
    while open_texts.any():
        rows = np.flatnonzero(open_texts[owner])
        who, register, time, name = _points(key[rows], weight[rows], owner[rows], limit, m)
        slot = who * m + register
        best = np.full(n * m, np.inf)
        np.minimum.at(best, slot, time)
        wins = time == best[slot]
        flat = out.reshape(-1)
        flat[slot[wins]] = name[wins]
        open_texts &= np.isinf(best).reshape(n, m).any(axis=1)
        limit *= 2
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per band; keys of different bands differ."""
    cut = signature.reshape(len(signature), bands, rows)
    key = np.zeros(cut.shape[:2], dtype=np.uint64)
    for r in range(rows):
        key = mixed(key + cut[:, :, r])
    return mixed(key + np.arange(1, bands + 1, dtype=np.uint64) * _STEP).view(np.int64)


def sketches(docs: DataFrame, bands: int = BANDS, rows: int = ROWS, width: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, node, keys): a hash of the text and its band keys (null where the text has no word)."""

    def sketch(batches) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            hashes, offsets = bags(texts, width)
            keys = band_keys(signatures(hashes, offsets, bands * rows), bands, rows)
            has = np.diff(offsets) > 0
            ends = np.append(0, np.cumsum(has * bands)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys[has].reshape(-1)), mask=pa.array(~has))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), lists], names=["doc_id", "node", "keys"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return (docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("node"), "text")
            .mapInArrow(released(sketch), f"doc_id {kind}, node bigint, keys array<bigint>"))


def _shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted multisets."""
    x, nx = np.unique(a, return_counts=True)
    y, ny = np.unique(b, return_counts=True)
    at = np.minimum(np.searchsorted(x, y), len(x) - 1)
    return int(np.where(x[at] == y, np.minimum(nx[at], ny), 0).sum())


def _difference(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Names of what two sorted multisets have beyond each other; the side and the how-manieth copy are part of a name."""
    both = np.concatenate([a, b])
    names, where = np.unique(both, return_inverse=True)
    in_a, in_b = (np.bincount(w, minlength=len(names)) for w in (where[:len(a)], where[len(a):]))
    out = []
    for side, more in ((1, in_a - in_b), (2, in_b - in_a)):
        at = np.repeat(np.arange(len(names)), np.maximum(more, 0))
        copy = np.arange(len(at)) - np.searchsorted(at, at)
        out.append(mixed(names[at] ^ mixed((copy * 4 + side).astype(np.uint64))))
    return np.concatenate(out).view(np.int64)


def compared(pairs: DataFrame, contents: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b, large) with ``linked``: whether their multisets in ``contents`` (node, bag) are similar enough.

    Also ``total`` (size of their difference, or more where sizes alone rule a link out), ``need`` and ``over`` as `_across`
    uses them, and for large families the names of the difference and ``bits``: for each of `_BITS` remainders whether an odd number of names has it.
    """
    part = least / (1 + least)

    def test(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for large, x, y in zip(*(batch.column(i) for i in (2, 3, 4))):
                x, y = (np.frombuffer(v.as_py(), dtype=np.uint64) for v in (x, y))
                close = min(len(x), len(y)) >= least * max(len(x), len(y)) - 1e-9
                if not close and not large.as_py():
                    rows.append((False, len(x) + len(y), 0.0, 0.0, None, None))
                    continue
                shared = _shared(x, y)
                gone, new = len(x) - shared, len(y) - shared
                need = (1 - part) * gone + part * new
                names = _difference(x, y) if large.as_py() else None
                odd = None if names is None else np.packbits(np.bincount(names & (_BITS - 1), minlength=_BITS) & 1).view(np.int64)
                rows.append((shared >= least * (len(x) + len(y) - shared) - 1e-9, gone + new, need,
                             need - (1 - 2 * part) * len(x), names, odd))
            kinds = (pa.bool_(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            made = [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made],
                                             names=["a", "b", "linked", "total", "need", "over", "names", "bits"])

    joined = (pairs.join(contents.select(F.col("node").alias("a"), F.col("bag").alias("bag_a")), "a")
              .join(contents.select(F.col("node").alias("b"), F.col("bag").alias("bag_b")), "b"))
    return joined.select("a", "b", "large", "bag_a", "bag_b").mapInArrow(
        released(test), "a bigint, b bigint, linked boolean, total bigint, need double, over double, names array<bigint>, bits array<bigint>")


def _within(family: DataFrame) -> DataFrame:
    """Pairs of members of one small family that are in different groups."""
    x = family.select("a", F.col("b").alias("x"), F.col("group").alias("group_x"))
    y = family.select("a", F.col("b").alias("y"), F.col("group").alias("group_y"))
    return x.join(y, "a").where("x < y and group_x <> group_y").select("x", "y")


def _name_counters(families: DataFrame) -> np.ndarray:
    """Three rows by hashed slot: how often its names occur in ``families`` (a, names, group, need, over), their least ``need`` and
    their least positive ``over`` in eighths, rounded down; all up to 65,535.

    The first is 0 where all of them are in one group of one family: no member of another group has such a name.
    """
    bits = _COUNTER_BITS

    def merged(parts: list) -> list:
        slot, n, low, high, need, over = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(slot, kind="stable")
        slot = slot[order]
        first = np.flatnonzero(np.append(True, np.diff(slot) != 0)[:len(slot)])
        if not len(first):
            return [(slot, n, low, high, need, over)]
        return [(slot[first], np.add.reduceat(n[order], first), np.minimum.reduceat(low[order], first), np.maximum.reduceat(high[order], first),
                 np.minimum.reduceat(need[order], first), np.minimum.reduceat(over[order], first))]

    def tally(batches) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, dtype=np.int64)
        held = [(none,) * 6]
        for batch in batches:
            keys = [none.view(np.uint64), *_family_keys(batch)]
            slot = (np.concatenate(keys) >> np.uint64(64 - bits)).astype(np.int64)
            group, need, over = (np.asarray(batch.column(i)) for i in (2, 3, 4))
            need, over = (np.floor(np.clip(8 * x, 0, 65_535)).astype(np.int64) for x in (need, np.where(over > 0, over, np.inf)))
            group, need, over = (np.repeat(x, [len(k) for k in keys[1:]]) for x in (group, need, over))
            held.append(merged([(slot, np.ones(len(slot), dtype=np.int64), group, group, need, over)])[0])
            if sum(len(h[0]) for h in held[1:]) > max(500_000, len(held[0][0])):
                held = merged(held)
        slot, *values = merged(held)[0]
        cuts = np.searchsorted(slot, np.arange(0, (1 << bits) + 1, _COUNTER_SLICE))
        some = np.flatnonzero(np.diff(cuts))
        blocks = [packed_block(np.concatenate([x[cuts[i]:cuts[i + 1]] for x in (slot - i * _COUNTER_SLICE, *values)])) for i in some]
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(np.diff(cuts)[some]), pa.array(blocks, type=pa.binary())],
                                         names=["slice", "n", "block"])

    def shared(batches) -> Iterator[pa.RecordBatch]:
        def row():
            several = np.stack([np.where(low < high, np.minimum(total, 65_535), 0), need, over]).astype(np.uint16)
            return pa.RecordBatch.from_arrays([pa.array([at], type=pa.int32()), pa.array([packed_block(several)], type=pa.binary())],
                                              names=["slice", "block"])

        at = None
        for batch in batches:
            for key, n, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key != at:
                    if at is not None:
                        yield row()
                    at, total = key, np.zeros(_COUNTER_SLICE, dtype=np.int64)
                    low, high = (np.full(_COUNTER_SLICE, x, dtype=np.int64) for x in (np.iinfo(np.int64).max, np.iinfo(np.int64).min))
                    need, over = (np.full(_COUNTER_SLICE, 65_535, dtype=np.int64) for _ in range(2))
                slot, count, *values = unpacked_block(block.as_py(), "int64", 6 * n).reshape(6, n)
                total[slot] += count
                for known, better, value in zip((low, high, need, over), (np.minimum, np.maximum, np.minimum, np.minimum), values):
                    known[slot] = better(known[slot], value)
        if at is not None:
            yield row()

    counters = np.zeros((3, 1 << bits), dtype=np.uint16)
    parts = families.select("a", "names", "group", "need", "over").mapInArrow(released(tally), "slice int, n bigint, block binary")
    # Blocks of a slice follow each other in a task, which holds one slice at a time.
    sums = parts.repartition("slice").sortWithinPartitions("slice").mapInArrow(released(shared), "slice int, block binary")
    for r in sums.toLocalIterator():
        at = r["slice"] * _COUNTER_SLICE
        counters[:, at:at + _COUNTER_SLICE] = unpacked_block(bytes(r["block"]), "uint16", 3 * _COUNTER_SLICE).reshape(3, -1)
    return counters


def _family_keys(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The keys (name in family) of every row of a batch whose first columns are the family and the names."""
    for family, names in zip(batch.column(0).to_pylist(), batch.column(1)):
        seed = mixed(np.array([family], dtype=np.int64).view(np.uint64))
        yield mixed(np.asarray(names.values).view(np.uint64) ^ seed) if names.is_valid else np.zeros(0, dtype=np.uint64)


def _rare_names(families: DataFrame, least: float) -> DataFrame:
    """Members (a, b, total, need, over, bits, group) with ``rare``: keys (name in family) and places of the rarest names of their differences.

    Two members that are similar enough share a name among the rarest of both, at a place that leaves room for the rest (prefix
    filter); any order that all members follow will do. Here names are ordered by how often a table of hashed counters has seen
    them, which needs no join and has a fixed size. Pairs inside a group are not asked for, so names of one group alone come first,
    keep their places and go. So do names at places that leave no room for the least that another row of the name's slot asks for,
    which `_may_meet` then does by the names themselves.
    """
    bits = _COUNTER_BITS
    sent = families.sparkSession.sparkContext.broadcast(_name_counters(families))

    def rarest(batches) -> Iterator[pa.RecordBatch]:
        known = sent.value
        for batch in batches:
            found = []
            for keys, total, need, over in zip(_family_keys(batch), *(batch.column(i).to_pylist() for i in (3, 4, 5))):
                often, least_need, least_over = known[:, (keys >> np.uint64(64 - bits)).astype(np.int64)]
                order = np.lexsort((keys, often))
                # What they must share at least: a member that is linked to the origin meets only such as are not, which adds to its need.
                must = need if over <= 0 else min(need, over * (1 + least))
                upto = total - int(np.ceil(max(must, 1.0) - 1e-6)) + 1
                place = np.flatnonzero(often[order][:max(upto, 0)])
                room, at = total - place, order[place]
                may = room >= np.ceil(need + least_over[at] / 8 - 1e-6)
                if over > 0:
                    may |= room >= np.ceil(least_need[at] / 8 + over - 1e-6)
                place = place[may]
                found.append([{"key": k, "place": p} for k, p in zip(keys[order[place]].view(np.int64).tolist(), (place + 1).tolist())])
            rare = pa.array(found, type=pa.list_(pa.struct([("key", pa.int64()), ("place", pa.int64())])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[batch.column(i) for i in range(2, 8)], rare],
                                             names=["a", "b", "total", "need", "over", "bits", "group", "rare"])

    schema = "a bigint, b bigint, total bigint, need double, over double, bits array<bigint>, group bigint, rare array<struct<key:bigint,place:bigint>>"
    return families.select("a", "names", "b", "total", "need", "over", "bits", "group").mapInArrow(released(rarest), schema)


def _may_meet(named: DataFrame) -> DataFrame:
    """Rows of ``named`` (group, total, need, over, key, place) that `_across` may join with another of their key.

    Names of one group alone join no others, nor does a row whose place is too far back for whatever else has the name.
    """
    often = (named.groupBy("key").agg(
        F.min("group").alias("low"), F.max("group").alias("high"), F.min("need").alias("least_need"),
        F.min(F.when(F.col("over") > 0, F.col("over"))).alias("least_over")).where("low < high")
        .select(F.col("key").alias("name"), "least_need", "least_over"))
    room = F.col("total") - F.col("place") + 1
    may = (((F.col("over") > 0) & (room >= F.ceil(F.col("least_need") + F.col("over") - 1e-6)))
           | (room >= F.ceil(F.col("need") + F.col("least_over") - 1e-6)))
    return named.join(often, (F.col("key") == F.col("name")) & may, "left_semi")


def _across(rare: DataFrame) -> DataFrame:
    """Pairs of members of one large family (``rare``: see `_rare_names`) that are in different groups and may be similar enough.

    With the family's centre as origin, the intersection of two members follows from what their differences to it have in
    common: similarity is at least what was asked just if that is need(x) + over(y), where a member is linked to the origin if ``over``
    is not positive. Only members that share a rare name meet, see `_rare_names`: near copies that were edited in different
    places do not. Where ``bits`` differ, so do the names, which caps what two members share before any text is looked at.
    """
    cols = ["group", "total", "need", "over", "bits"]
    named = rare.select("b", *cols, F.explode("rare").alias("name"))
    named = stored(named.select("b", *cols, "name.key", "name.place"), "rare-names")
    shared = _may_meet(named)

    def side(name: str) -> DataFrame:
        return shared.select("key", *[F.col(c).alias(f"{c}_{name}") for c in ("b", *cols, "place")])

    must = F.ceil(F.col("need_y") + F.col("over_x") - 1e-6)
    differ = sum((F.bit_count(F.col("bits_x")[i].bitwiseXOR(F.col("bits_y")[i])) for i in range(_BITS // 64)), F.lit(0))
    return (side("x").where("over_x > 0").join(side("y"), "key")
            .where((F.col("group_x") != F.col("group_y")) & (F.col("total_x") + F.col("total_y") - differ >= 2 * must)
                   & (F.col("place_x") <= F.col("total_x") - must + 1) & (F.col("place_y") <= F.col("total_y") - must + 1))
            .select(F.least("b_x", "b_y").alias("x"), F.greatest("b_x", "b_y").alias("y")))


def near_duplicates(docs: DataFrame, least: float = LEAST, bands: int = BANDS, rows: int = ROWS,
                    width: int = SHINGLE_WORDS, small: int = SMALL_FAMILY) -> DataFrame:
    """(doc_id, node, group, class_id): documents linked by a weighted Jaccard similarity of at least ``least``.

    Every row of ``docs`` (doc_id, text) comes back once. ``class_id`` is the smallest doc_id of the connected texts; ``node``
    is a 64-bit hash of the text and ``group`` the smallest node of the connected texts. Words are lower-case runs without ASCII white space and punctuation; a text of fewer than
    ``width`` words is one shingle. Texts that are equal are one node, so copies are never paired. A null or wordless text is
    similar to nothing but its own copies are still one class. Repeated rows and ids are kept; the smallest id that is not
    null names a class, and it is null only where all ids are. An empty table gives an empty result, other columns are not read.

    Candidates share a band. The smallest node of a bucket is the origin of a family: every text of its buckets is compared
    with it. In a family of more than ``small`` texts all are compared once more, with the text nearest to the origin, which
    among edited copies is likely the one they come from. Pairs inside a family that this leaves in different groups come
    next: in a small family all of them, in a large one those that `_across` cannot rule out. No bucket is cut and no link
    between texts that share a bucket is lost.
    """
    rows_in = stored(sketches(docs, bands, rows, width), "sketches")
    texts = stored(rows_in.groupBy("node").agg(F.min("doc_id").alias("lead"), F.first("keys").alias("keys")), "texts")
    keyed = texts.select("node", F.explode("keys").alias("key"))
    buckets = stored(keyed.groupBy("key").agg(F.min("node").alias("first"), F.max("node").alias("last"))
                     .where("first < last").select("key", "first"), "buckets")
    met = stored(keyed.join(buckets, "key").where("node <> first")
                 .select(F.col("first").alias("a"), F.col("node").alias("b")).distinct(), "met")

    def bag(batches) -> Iterator[pa.RecordBatch]:
        for batch, own in text_batches(batches):
            hashes, offsets = bags(own, width)
            packed = [hashes[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, type=pa.binary())], names=["node", "bag"])

    wanted = met.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(texts.select("node", "lead"), "node")
    rows_of = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("_node"), "text")
    found = rows_of.join(wanted, (F.col("_node") == F.col("node")) & F.col("doc_id").eqNullSafe(F.col("lead")), "left_semi")
    # Rows that repeat both text and id match as often as they are there; one bag for each node stays.
    once = found.groupBy(F.col("_node").alias("node")).agg(F.min("text").alias("text"))
    contents = stored(once.mapInArrow(released(bag), "node bigint, bag binary"), "bags")

    def groups(links: DataFrame) -> DataFrame:
        edges = links.select(F.col("a").alias("entity_a"), F.col("b").alias("entity_b"))
        return canonical_ids(edges, texts.select("node"), "node").select("node", F.col("canonical_id").alias("group"))

    first = stored(compared(met.withColumn("large", F.lit(False)), contents, least), "compared")
    size = first.groupBy("a").agg((F.count(F.lit(1)) > small).alias("crowded"), F.min(F.struct("total", "b")).alias("near"))
    size = stored(size.select("a", "crowded", F.col("near.b").alias("centre")), "families")
    crowded = size.where("crowded").select("a", "centre")
    again = (met.join(crowded, "a").select("centre", "b").unionByName(crowded.select("centre", F.col("a").alias("b")))
             .where("centre <> b").select(F.col("centre").alias("a"), "b", F.lit(True).alias("large")).distinct())
    second = stored(compared(again, contents, least), "recentred")
    links = first.where("linked").unionByName(second.where("linked")).select("a", "b")
    grouped = stored(groups(links).withColumnRenamed("node", "b"), "groups")
    few = first.join(size.where("not crowded").select("a"), "a", "left_semi")
    more = (_within(few.join(grouped, "b")).unionByName(_across(_rare_names(second.join(grouped, "b"), least))).distinct()
            .select(F.col("x").alias("a"), F.col("y").alias("b"), F.lit(False).alias("large")))
    links = links.unionByName(stored(compared(more, contents, least).where("linked").select("a", "b"), "more-links"))
    classes = texts.select("node", "lead").join(groups(links), "node")
    names = classes.groupBy("group").agg(F.min("lead").alias("class_id"))
    named = stored(classes.join(names, "group").select("node", "group", "class_id"), "classes")
    return rows_in.select("doc_id", "node").join(named, "node").select("doc_id", "node", "group", "class_id")


@query("op10_bagminhash")
def op10_bagminhash(spark, sf_dir):
    """Every document with the smallest id of its near-duplicate class."""
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id")
