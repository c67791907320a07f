"""Word phrases that stick together, counted by vertical partitioning of a suffix tree.

Every word of a piece begins a suffix, cut after ``words`` words. Equal suffixes are one leaf with a total. Leaves are dealt to
groups by the prefix they begin with: a prefix is one word, or as many more as it takes until it has few enough leaves for the
memory of one group, and groups take prefixes in order until that memory is full. Each group builds the part of the tree below
its prefixes for itself, and a phrase's count is the sum of the leaf totals below its node.

Two passes bound counts from above before, by adding them up in hashed slots: first those of words and word pairs, then those of
longer runs whose pairs are left. What stays below the least count there cannot be part of a phrase that reaches it, so suffixes
end before it. That loses no occurrence of a phrase that counts.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from casegrain.llm.common import mixed, query, released, table, text_batches
from casegrain.operators.paging import top_per_group
from casegrain.session import stored

LEAST = 100
WORDS = 5
KEEP = 2000
#: An opened phrase counts instead of the part of it that has this share of its occurrences, in per cent.
SHARE = 100
#: Leaves that one group holds; a prefix with more is split by its next word.
GROUP_LEAVES = 200_000
#: Slots (powers of two) of a table of upper bounds: about one for every ``BYTES_A_SLOT`` bytes of text. A task reads one bit of each.
LEAST_BITS, MOST_BITS, SLICE_BITS = 24, 30, 18
BYTES_A_SLOT = 24
_CHUNK = 2_000_000
#: Text of one task that adds up suffixes.
TASK_BYTES = 1 << 28
#: Different suffixes that a task adds up before it sends them on.
_HELD = 1_000_000

#: What ends a piece, and what stands between its words.
_ENDS = b".,;:!?\x0a\x0b\x0c\x0d"
_FOLD = bytes(10 if c in _ENDS else 32 if c in b"\x20\x09" else c for c in range(256))


def cut_texts(texts: list[bytes], most: int) -> Iterator[bytes]:
    """Folded texts joined by piece ends, ``most`` bytes at a time or a little more; cuts lie at piece ends."""
    held, size = [], 0
    for text in texts:
        text = text.lower().translate(_FOLD)
        at = 0
        while len(text) - at > 2 * most and (end := text.find(b"\n", at + most)) >= 0:
            held.append(text[at:end])
            yield b"\n".join(held)
            held, size, at = [], 0, end + 1
        held.append(text[at:])
        size += len(text) - at
        if size > most:
            yield b"\n".join(held)
            held, size = [], 0
    if held:
        yield b"\n".join(held)


def numbered(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words in order as numbers of different words, -1 for a piece end, and the different words."""
    words = data.replace(b"\n", b" \n ").split(b" ")
    names = dict.fromkeys(words)
    names.pop(b"", None)
    names.pop(b"\n", None)
    names = list(names)
    code = dict(zip(names, range(len(names)))) | {b"\n": -1, b"": -2}
    ids = np.fromiter(map(code.__getitem__, words), dtype=np.int64, count=len(words))
    return ids[ids != -2], names


def by_language(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Language, numbered words and their names, for the texts of each language of a batch. Columns: lang, text."""
    for batch, texts in text_batches(batches, most=_CHUNK):
        langs: dict[str, list[bytes]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), texts):
            langs.setdefault(lang, []).append(text.encode("utf-8", "surrogatepass"))
        for lang, own in langs.items():
            for data in cut_texts(own, _CHUNK):
                yield lang, *numbered(data)


def slots_of(lang: str, ids: np.ndarray, names: list[bytes], words: int, bits: int) -> Iterator[np.ndarray]:
    """For runs of 1 word, 2 words, ... the slots of the runs at all positions; where a run passes a piece end, any slot."""
    import xxhash

    seed = xxhash.xxh3_64_intdigest(lang.encode("utf-8", "surrogatepass"))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in [*names, b""]), dtype=np.uint64, count=len(names) + 1)
    own = np.append(hashes[ids], np.zeros(words, dtype=np.uint64))
    run, down = own[:len(ids)], np.uint64(64 - bits)
    yield (run >> down).astype(np.int64)
    for k in range(1, words):
        run = mixed(run * np.uint64(0x9E3779B97F4A7C15) + own[k:k + len(ids)])
        yield (run >> down).astype(np.int64)


def in_pair(word: np.ndarray, bits: int) -> np.ndarray:
    """The slots that tell whether the words of these slots are in a pair that may reach the least count."""
    return (mixed(word.astype(np.uint64) + np.uint64(0xA24BAED4963EE407)) >> np.uint64(64 - bits)).astype(np.int64)


def reaching(tables: list[np.ndarray], lang: str, ids: np.ndarray, names: list[bytes], words: int, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For runs of 1 word, 2 words, ...: their slots, and the positions where the run lies inside a piece and may still reach the least count.

    That is so where it and all runs inside it lie in slots that do. ``tables``: the bits of single words and pairs, then those of longer
    runs and of the words that are in such a pair: no others are parts of phrases.
    """
    def passes(table: np.ndarray, slot: np.ndarray) -> np.ndarray:
        return (table[slot >> 3] >> (7 - (slot & 7)).astype(np.uint8)) & 1 == 1

    inside = ids >= 0
    for k, slot in enumerate(slots_of(lang, ids, names, words, bits), 1):
        if k > 1:  # the run from the next position that ends at the same word
            inside = inside & np.append(inside[1:], False)
        if (k > 2) < len(tables):
            at = np.flatnonzero(inside)
            at = at[passes(tables[k > 2], slot[at])]
            if k == 1 and len(tables) == 2:
                at = at[passes(tables[1], in_pair(slot[at], bits))]
            inside = np.zeros(len(ids), dtype=bool)
            inside[at] = True
        yield slot, inside


def bounds(docs: DataFrame, least: int, words: int, bits: int, known: list[bytes]) -> tuple[DataFrame, bytes]:
    """(lang, n): all words by language; and one bit per slot, set where the runs of the slot together reach ``least``.

    Without ``known`` bits the runs are single words and pairs, with those of these all longer ones that may still reach it; then
    the words of pairs that may reach it are marked as well.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)
    wanted = range(1, 3) if not known else range(3, words + 1)
    mask = (1 << SLICE_BITS) - 1

    def tally(batches) -> Iterator[pa.RecordBatch]:
        tables = [np.frombuffer(x, dtype=np.uint8) for x in sent.value]
        slots, counts, total = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)], {}

        def merged(slot: np.ndarray, count: np.ndarray) -> None:
            order = np.argsort(slot, kind="stable")
            slot = slot[order]
            first = np.flatnonzero(np.append(True, np.diff(slot) != 0)[:len(slot)])
            slots[:], counts[:] = [slot[first]], [np.minimum(np.add.reduceat(count[order], first), least) if len(first) else count]

        for lang, ids, names in by_language(batches):
            for k, (slot, inside) in enumerate(reaching(tables, lang, ids, names, words if known else 2, bits), 1):
                if k == 1:
                    word = slot
                if known and k == 2:
                    pairs = np.flatnonzero(inside)
                    some = np.unique(in_pair(word[np.concatenate([pairs, pairs + 1])], bits))
                    slots.append(some)
                    counts.append(np.full(len(some), least))
                if k in wanted:
                    some, count = np.unique(slot[inside], return_counts=True)
                    slots.append(some)
                    counts.append(count)
            total[lang] = total.get(lang, 0) + int((ids >= 0).sum())
            if sum(map(len, slots[1:])) > max(4_000_000, len(slots[0])):
                merged(np.concatenate(slots), np.concatenate(counts))
        merged(np.concatenate(slots), np.concatenate(counts))
        slot, count = slots[0], counts[0].astype(np.uint32)
        cuts = np.append(np.flatnonzero(np.append(True, np.diff(slot >> SLICE_BITS) != 0)[:len(slot)]), len(slot))
        blocks = [pa.compress(np.concatenate([np.diff(slot[a:b] & mask, prepend=0).astype(np.uint32), count[a:b]]).tobytes(), codec="zstd", asbytes=True)
                  for a, b in zip(cuts[:-1], cuts[1:])]
        sizes, empty = np.diff(cuts).tolist(), [None] * (len(cuts) - 1)
        yield pa.RecordBatch.from_arrays(
            [pa.array([*total, *empty], type=pa.string()), pa.array([*total.values(), *sizes], type=pa.int64()),
             pa.array([None] * len(total) + (slot[cuts[:-1]] >> SLICE_BITS).tolist(), type=pa.int32()),
             pa.array([None] * len(total) + blocks, type=pa.binary())], names=["lang", "n", "slice", "block"])

    def enough(batches) -> Iterator[pa.RecordBatch]:
        def row():
            return pa.RecordBatch.from_arrays([pa.array([at], type=pa.int32()), pa.array([np.packbits(sums >= least).tobytes()], type=pa.binary())],
                                              names=["slice", "bits"])

        at, sums = None, None
        for batch in batches:
            for key, n, block in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                if key != at:
                    if at is not None:
                        yield row()
                    at, sums = key, np.zeros(1 << SLICE_BITS, dtype=np.int64)
                both = np.frombuffer(pa.decompress(block.as_py(), decompressed_size=8 * n, codec="zstd", asbytes=True), dtype=np.uint32)
                sums[np.cumsum(both[:n], dtype=np.int64)] += both[n:]
        if at is not None:
            yield row()

    made = stored(docs.mapInArrow(released(tally), "lang string, n bigint, slice int, block binary"), "bounds")
    # Blocks of a slice follow each other in a task, which holds one sum at a time.
    sums = (made.where("slice is not null").select("slice", "n", "block").repartition("slice").sortWithinPartitions("slice")
            .mapInArrow(enough, "slice int, bits binary"))
    passed = np.zeros((1 << bits >> SLICE_BITS, 1 << SLICE_BITS >> 3), dtype=np.uint8)
    for r in sums.collect():
        passed[r["slice"]] = np.frombuffer(r["bits"], dtype=np.uint8)
    return made.where("lang is not null").groupBy("lang").agg(F.sum("n").alias("n")), passed.tobytes()


def equal_rows(columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The order that sorts rows of small numbers column by column, and where a row begins that differs from the one before."""
    bits = max(1, int(max(c.max() for c in columns) + 2).bit_length())
    each = 63 // bits
    keys = []
    for i in range(0, len(columns), each):
        key = np.zeros(len(columns[0]), dtype=np.int64)
        for c in columns[i:i + each]:
            key = (key << bits) + c + 1
        keys.append(key)
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= np.diff(key[order]) != 0
    return order, new


def phrases_of(names: pa.Array, columns: list[np.ndarray]) -> pa.Array:
    """The words whose numbers are in the columns (-1: none), joined by spaces."""
    parts = [names.take(pa.array(c, mask=c < 0)) for c in columns]
    return pc.binary_join_element_wise(*parts, " ", null_handling="skip")


def added_up(leaves: list[pa.Table]) -> pa.Table:
    """Leaves of several parts of the texts, each once."""
    return pa.concat_tables(leaves).group_by(["lang", "leaf"]).aggregate([("n", "sum")]).rename_columns({"n_sum": "n"}).select(["lang", "leaf", "n"])


def fewer_tasks(docs: DataFrame, size: int) -> DataFrame:
    """The rows in tasks of about `TASK_BYTES` of their ``size`` bytes of text, but two for each core at least: read as they lie, not shuffled."""
    return docs.coalesce(max(size // TASK_BYTES, 2 * docs.sparkSession.sparkContext.defaultParallelism, 1))


def leaves_of(docs: DataFrame, words: int, bits: int, known: list[bytes]) -> DataFrame:
    """(lang, leaf, n): the different suffixes of at most ``words`` words and how often each begins.

    Every task sends on each suffix that it has once, so the fewer tasks there are, the fewer rows there are.
    """
    sent = docs.sparkSession.sparkContext.broadcast(known)

    def suffixes(batches) -> Iterator[pa.RecordBatch]:
        tables, held, rows = [np.frombuffer(x, dtype=np.uint8) for x in sent.value], [], 0
        for lang, ids, names in by_language(batches):
            depth = np.zeros(len(ids), dtype=np.int64)
            for _, inside in reaching(tables, lang, ids, names, words, bits):
                depth += inside
            at = np.flatnonzero(depth)
            if not len(at):
                continue
            padded = np.append(ids, np.full(words, -1))
            columns = [np.where(depth[at] > k, padded[at + k], -1) for k in range(words)]
            order, new = equal_rows(columns)
            first = np.flatnonzero(new)
            counts = np.diff(np.append(first, len(order)))
            chosen = [c[order[first]] for c in columns]
            texts = phrases_of(pa.array(names, type=pa.binary()).cast(pa.string()), chosen)
            held.append(pa.table({"lang": pa.repeat(pa.scalar(lang, pa.string()), len(first)), "leaf": texts, "n": pa.array(counts)}))
            rows += len(first)
            if rows > _HELD:
                held = [added_up(held)]
                rows = len(held[0])
                if rows > _HELD // 2:
                    yield from held.pop().to_batches(max_chunksize=50_000)
                    rows = 0
        if held:
            yield from added_up(held).to_batches(max_chunksize=50_000)

    parts = docs.mapInArrow(released(suffixes), "lang string, leaf string, n bigint")
    return parts.groupBy("lang", "leaf").agg(F.sum("n").alias("n"))


def first_words(phrase: Column, n) -> Column:
    return F.substring_index(phrase, " ", n)


def grouped_by_prefix(leaves: DataFrame, budget: int, words: int) -> DataFrame:
    """Leaves with ``depth``, the words of the prefix they are dealt by, and ``group``: prefixes of together ``budget`` leaves or one.

    Only prefixes with more leaves than that are opened by a further word, so at most leaves / budget of them are looked up.
    """
    dealt = leaves.withColumn("prefix", first_words(F.col("leaf"), 1)).withColumn("depth", F.lit(1))
    sizes = stored(dealt.groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("size")), "prefixes")
    for depth in range(1, words):
        heavy = sizes.where((F.col("size") > budget)).select("lang", "prefix", F.lit(True).alias("heavy"))
        if heavy.isEmpty():
            break
        # A leaf that ends with a heavy prefix keeps it and stands alone there.
        longer = first_words(F.col("leaf"), depth + 1)
        dealt = stored(dealt.join(heavy, ["lang", "prefix"], "left").select(
            "lang", "leaf", "n", F.when(F.col("heavy"), longer).otherwise(F.col("prefix")).alias("prefix"),
            F.when(F.col("heavy"), depth + 1).otherwise(F.col("depth")).alias("depth")), "opened")
        sizes = stored(dealt.groupBy("lang", "prefix").agg(F.count(F.lit(1)).alias("size")), "prefixes")
    placed = stored(sizes.repartitionByRange("lang", "prefix").sortWithinPartitions("lang", "prefix")
                    .withColumn("_at", F.monotonically_increasing_id()), "placed").withColumn("_range", F.shiftright("_at", 33))
    totals = placed.groupBy("_range").agg(F.sum("size").alias("_total"))
    totals = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    upto = F.sum("size").over(Window.partitionBy("_range").orderBy("_at"))
    groups = placed.join(totals, "_range").select(
        "lang", "prefix", F.floor((F.col("_before") + upto - F.col("size")) / budget).alias("group"))
    return dealt.join(groups, ["lang", "prefix"]).select("group", "lang", "leaf", "n", "depth")


def counted(grouped: DataFrame, least: int, words: int) -> DataFrame:
    """(lang, phrase, size, a): phrases of up to ``words`` words that occur ``least`` times or more, from one subtree per group."""

    def subtree(rows: pa.Table) -> pa.Table:
        rows = rows.combine_chunks()
        split = pc.split_pattern(rows.column("leaf"), " ").combine_chunks()
        offsets = np.asarray(split.offsets)
        coded = split.values.dictionary_encode()
        codes, names = np.asarray(coded.indices, dtype=np.int64), coded.dictionary
        langs = rows.column("lang").combine_chunks().dictionary_encode()
        sizes = np.diff(offsets)
        columns = [np.asarray(langs.indices, dtype=np.int64)]
        for k in range(words):
            at = np.minimum(offsets[:-1] + k, len(codes) - 1)
            columns.append(np.where(sizes > k, codes[at], -1))
        order, _ = equal_rows(columns)
        columns, sizes = [c[order] for c in columns], sizes[order]
        n, depth = (np.asarray(rows.column(c), dtype=np.int64)[order] for c in ("n", "depth"))
        # Words that a leaf has in common with the one before it: the depth at which its branch leaves the path.
        common, same = np.zeros(len(order), dtype=np.int64), np.ones(len(order), dtype=bool)
        for c in columns:
            same = same & np.append(False, c[1:] == c[:-1])
            common += same
        out = []
        for k in range(1, words + 1):
            below = np.flatnonzero(sizes >= k)
            if not len(below):
                break
            # A leaf that ends higher up lies before all longer ones of its branch, so those of one node are neighbours.
            first = np.flatnonzero(common[below] <= k)
            total = np.add.reduceat(n[below], first)
            node = below[first]
            wanted = (total >= least) | (k < depth[node])
            node, total = node[wanted], total[wanted]
            texts = phrases_of(names, [c[node] for c in columns[1:k + 1]])
            out.append(pa.table({"lang": langs.dictionary.take(pa.array(columns[0][node])), "phrase": texts,
                                 "size": pa.array(np.full(len(node), k, dtype=np.int32)), "a": pa.array(total)}))
        return pa.concat_tables(out)

    nodes = grouped.groupBy("group").applyInArrow(subtree, "lang string, phrase string, size int, a bigint")
    # Nodes above a prefix that was opened have a part of their leaves in each of several groups.
    return nodes.groupBy("lang", "phrase", "size").agg(F.sum("a").alias("a")).where(F.col("a") >= least)


def counts(docs: DataFrame, least: int = LEAST, words: int = WORDS, budget: int = GROUP_LEAVES) -> tuple[DataFrame, DataFrame]:
    """(lang, n) with all words by language, and (lang, phrase, size, a): phrases of one word or more and their occurrences."""
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).head()[0] or 0
    bits = min(max((size // BYTES_A_SLOT).bit_length(), LEAST_BITS), MOST_BITS)
    totals, short = bounds(docs, least, words, bits, [])
    _, long = bounds(docs, least, words, bits, [short])
    leaves = stored(leaves_of(fewer_tasks(docs, size), words, bits, [short, long]), "leaves")
    return totals, stored(counted(grouped_by_prefix(leaves, budget, words), least, words), "phrases")


def collocations(docs: DataFrame, least: int = LEAST, words: int = WORDS, keep: int = KEEP, share: int = SHARE,
                 budget: int = GROUP_LEAVES) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``keep`` phrases whose words stick together most.

    ``docs`` has lang (null: ``und``) and text (null: empty); other columns are not read. Letters A to Z are lower-cased; pieces
    end at ``. , ; : ! ?`` and line breaks, words at spaces and tabs. A phrase is a run of 2 to ``words`` words inside a piece with
    ``least`` occurrences or more, overlapping ones included. Cut in two parts with l and r occurrences it scores
    floor(1000 a n / (l r)), n being all words of the language; the cut with the lowest score counts, of equal ones the first. A
    phrase falls out where a longer one that contains it has at least ``share`` per cent of its occurrences. Order: score, then a,
    then the phrase's bytes. Texts of any length are counted whole, repeated rows each for themselves; an empty table, or one
    without such phrases, gives an empty result.
    """
    totals, found = counts(docs, least, words, budget)
    phrases = found.where("size > 1").withColumn("w", F.split("phrase", " "))
    part = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cuts = (phrases.select("lang", "phrase", "a", "size", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
            .select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("left"), part(F.col("k") + 1, F.col("size")).alias("right")))
    cuts = (cuts.join(found.select("lang", F.col("phrase").alias("left"), F.col("a").alias("l")), ["lang", "left"])
            .join(found.select("lang", F.col("phrase").alias("right"), F.col("a").alias("r")), ["lang", "right"]).join(totals, "lang"))
    # Products of up to 36 digits, exact as decimals.
    exact = {c: f"cast({c} as decimal(16, 0))" for c in ("a", "n", "l", "r")}
    score = "(cast(1000 as decimal(4, 0)) * ({a} * {n})) div ({l} * {r})".format(**exact)
    cuts = cuts.selectExpr("lang", "phrase", "a", "n", f"struct({score} as score, k, l, r) as cut")
    best = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min("cut").alias("cut"))
    inner = F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda m: F.transform(
        F.sequence(F.lit(1), F.col("size") - m + 1), lambda first: F.array_join(F.slice("w", first, m), " "))))
    covered = (phrases.where("size > 2").select("lang", F.explode(F.array_distinct(inner)).alias("phrase"), "a")
               .groupBy("lang", "phrase").agg(F.max("a").alias("longer")))
    open_ = best.join(covered, ["lang", "phrase"], "left").where(F.coalesce(100 * F.col("longer") < share * F.col("a"), F.lit(True)))
    rows = open_.select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score")
    top = top_per_group(rows, ["lang"], [("score", "desc"), ("a", "desc"), ("phrase", "asc")], keep, "rank")
    return top.select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", "n", "score")


_SQL = r"""
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
  FROM documents),
runs AS MATERIALIZED (SELECT lang, w FROM (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces) WHERE len(w) > 0),
totals AS (SELECT lang, sum(len(w))::BIGINT AS n FROM runs GROUP BY lang),
grams AS MATERIALIZED (
  SELECT lang, k, p, count(*) AS f FROM (
    SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS p
    FROM (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM runs), range(1, 6) AS s(k) WHERE i + k - 1 <= len(w))
  GROUP BY ALL HAVING count(*) >= 100),
cand AS MATERIALIZED (SELECT lang, k, p, f AS a, string_split(p, ' ') AS w FROM grams WHERE k > 1),
cuts AS (SELECT *, array_to_string(w[:c], ' ') AS lp, array_to_string(w[c + 1:], ' ') AS rp FROM (SELECT *, unnest(range(1, k)) AS c FROM cand)),
scored AS (
  SELECT c.lang, c.p AS phrase, c.a, x.f AS l, y.f AS r, t.n, CAST((1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS BIGINT) AS score, c.c
  FROM cuts c JOIN grams x ON x.lang = c.lang AND x.p = c.lp JOIN grams y ON y.lang = c.lang AND y.p = c.rp JOIN totals t ON t.lang = c.lang),
best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
covered AS (
  SELECT lang, phrase, max(a) AS longer FROM (
    SELECT lang, a, array_to_string(w[i:i + m - 1], ' ') AS phrase FROM cand, range(2, 5) AS s(m), range(1, 5) AS u(i) WHERE m < k AND i + m - 1 <= k)
  GROUP BY lang, phrase)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best LEFT JOIN covered USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000"""


@query("op12_phrase_collocations", _SQL)
def op12_phrase_collocations(spark, sf_dir):
    """The 2000 phrases of each language whose words stick together most, of 2 to 5 words and 100 occurrences or more."""
    return collocations(table(spark, sf_dir, "documents"))
