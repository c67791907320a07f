"""Mixing sources to target weights by a low-discrepancy schedule of equal blocks of words."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from casegrain.llm.common import query, table
from casegrain.session import stored

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
BLOCK_WORDS = 2048
CELL_ROWS = 4096
CHUNK_SLOTS = 1 << 16
#: The words of a text, as the size counts them.
WORDS = r"[^\x20\x09-\x0D]+"


def targets(sizes: list[int], weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS) -> list[float]:
    """Each source's words: shares of the total by weight, at most ``repeats`` times its size, the excess shared again.

    Sources reach their limit in the order of size per weight, so one pass in that order finds those that do.
    """
    weight = [weights[i % len(weights)] for i in range(len(sizes))]
    out = [0.0] * len(sizes)
    words, weight_left = sum(sizes), sum(weight)
    for i in sorted(range(len(sizes)), key=lambda i: (sizes[i] / weight[i], i)):
        share = words / weight_left * weight[i]
        if repeats * sizes[i] <= share:
            out[i] = float(repeats * sizes[i])
            words -= repeats * sizes[i]
            weight_left -= weight[i]
        else:
            out[i] = share
    return out


@dataclass
class Mix:
    """``rows``: every document's place in its source's shuffled stream of words. ``taken``: what the schedule takes.

    rows: doc_id, key, source, size, source_size, target, source_ix, start. taken: slot, source_ix, start, epoch, from_word,
    words; (source_ix, start) names a row of positive size.
    """

    rows: DataFrame
    taken: DataFrame


def row_key() -> Column:
    """A hash of a row's id and text, by which sources are shuffled."""
    return F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce("text", F.lit("")))))


def schedule(spark, need: list[int], block: int) -> DataFrame:
    """(slot, source_ix, rank): which source each block of the mix comes from, and the how-manieth of its source it is.

    Slot i has the point frac(i * golden ratio), kept as a 64-bit integer; cumulative shares of the needed words map it to a
    source. Any stretch of slots has the sources in proportion to their shares, up to a few slots. Ranks count slots inside
    chunks, plus those of earlier chunks. Slots beyond a source's need fall out, and the few that it lacks close the schedule.
    """
    blocks = [-(-n // block) for n in need]
    n_slots = sum(blocks)
    edges = np.cumsum(np.array(need, dtype=np.float64)) / max(1, sum(need))
    chunks = -(-n_slots // CHUNK_SLOTS)

    def sources_of(chunk: int) -> tuple[np.ndarray, np.ndarray]:
        slot = np.arange(chunk * CHUNK_SLOTS, min(n_slots, (chunk + 1) * CHUNK_SLOTS), dtype=np.uint64)
        point = (slot * np.uint64(0x9E3779B97F4A7C15)).astype(np.float64) / 2.0 ** 64
        return slot, np.minimum(np.searchsorted(edges, point, side="right"), len(edges) - 1)

    def count(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk in batch.column(0).to_pylist():
                n = np.bincount(sources_of(chunk)[1], minlength=len(edges))
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.full(len(n), chunk)), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(n)],
                    names=["chunk", "source_ix", "n"])

    tasks = int(min(max(chunks, 1), 4096))
    counted = stored(spark.range(0, chunks, 1, tasks).mapInArrow(count, "chunk bigint, source_ix int, n bigint"), "slot-counts")
    before = F.sum("n").over(Window.partitionBy("source_ix").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1))
    starts = (counted.withColumn("before", F.coalesce(before, F.lit(0))).groupBy("chunk")
              .agg(F.sort_array(F.collect_list(F.struct("source_ix", "before"))).alias("list"))
              .select("chunk", F.transform("list", lambda x: x["before"]).alias("before")))

    def rank(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for chunk, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                slot, source = sources_of(chunk)
                order = np.argsort(source, kind="stable")
                ordered = source[order]
                ranks = np.empty(len(slot), dtype=np.int64)
                ranks[order] = np.arange(len(slot)) - np.searchsorted(ordered, ordered) + np.array(before)[ordered]
                yield pa.RecordBatch.from_arrays([
                    pa.array(slot.astype(np.int64)), pa.array(source.astype(np.int32)), pa.array(ranks)],
                    names=["slot", "source_ix", "rank"])

    ranked = starts.mapInArrow(rank, "slot bigint, source_ix int, rank bigint")
    limits = spark.createDataFrame([(i, b) for i, b in enumerate(blocks)], "source_ix int, blocks bigint")
    got = counted.groupBy("source_ix").agg(F.sum("n").alias("got"))
    lacking = (limits.join(got, "source_ix").where("got < blocks")
               .select("source_ix", F.explode(F.sequence("got", F.col("blocks") - 1)).alias("rank"))
               .select(F.lit(n_slots).cast("bigint").alias("slot"), "source_ix", "rank"))
    return (ranked.join(limits, "source_ix").where("rank < blocks").select("slot", "source_ix", "rank")
            .unionByName(lacking))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, repeats: int = MOST_REPEATS,
        block: int = BLOCK_WORDS) -> Mix | None:
    """All documents mixed so that sources have their target shares of the words; None for an empty table.

    Sources, by code point with null last, weigh ``weights`` in turn and share as many words as all documents have; no source
    takes more than ``repeats`` times its words. Every source is shuffled by a hash of id and text into one stream of words,
    which repeats; slots of the schedule take its blocks in order, the last one cut at the target. So reruns agree and what is
    taken of a source is its target, rounded. A null text has no words. Documents without words are listed and never taken.
    Equal rows follow each other in the stream. Other columns are not read.

    The driver gets one row per source. Streams are summed by cells of about ``CELL_ROWS`` documents, so a source with a third
    of all rows is spread over many tasks.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORDS)).cast("bigint")
    sized = stored(docs.select("doc_id", "source", size.alias("size"), row_key().alias("key")), "sized")
    sources = sized.groupBy("source").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")).collect()
    if not sources:
        return None
    sources.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["size"] for r in sources]
    goals = targets(sizes, weights, repeats)
    need = [int(np.floor(g + 0.5)) for g in goals]
    digits = [next(d for d in range(16) if r["n"] <= CELL_ROWS * 16 ** d) for r in sources]
    known = spark.createDataFrame(
        [(r["source"], i, s, g, n, d) for i, (r, s, g, n, d) in enumerate(zip(sources, sizes, goals, need, digits))],
        "_source string, source_ix int, source_size bigint, target double, need bigint, digits int")
    placed = (sized.join(known, F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
              .withColumn("cell", F.expr("substr(key, 1, digits)")))

    ahead = Window.partitionBy("source_ix").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = (placed.groupBy("source_ix", "cell").agg(F.sum("size").alias("words"))
             .select("source_ix", "cell", F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("cell_start")))
    inside = Window.partitionBy("source_ix", "cell").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = stored(placed.join(cells, ["source_ix", "cell"])
                  .withColumn("start", F.col("cell_start") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
                  .select("doc_id", "key", "source", "size", "source_size", "target", "need", "source_ix", "start"), "streams")

    turns = (rows.where("size > 0").select("source_ix", "start", "size", "need", F.explode(F.transform(
        F.sequence(F.lit(0), F.lit(repeats - 1)),
        lambda e: F.struct(e.alias("epoch"), (F.col("start") + e * F.col("source_size")).alias("at")))).alias("turn"))
        .select("source_ix", "start", "size", "need", "turn.epoch", "turn.at").where("at < need"))
    end = F.least(F.col("at") + F.col("size"), F.col("need"))
    parts = turns.select("source_ix", "start", "epoch", "at", end.alias("end"), F.explode(
        F.sequence(F.floor(F.col("at") / block), F.floor((end - 1) / block))).alias("rank"))
    low, high = F.greatest("at", F.col("rank") * block), F.least("end", (F.col("rank") + 1) * block)
    taken = (parts.join(schedule(spark, need, block), ["source_ix", "rank"])
             .select("slot", "source_ix", "start", "epoch", (low - F.col("at")).alias("from_word"), (high - low).alias("words")))
    return Mix(rows, taken)


def counted(docs: DataFrame, mixed: Mix | None) -> DataFrame:
    """(doc_id, key, source, size, source_size, target, taken, first_slot, n_slots): each document with the words that the slots of the
    schedule take of it, the first slot that takes any (null where none does), and how many pieces of it slots take."""
    def whole(n):
        return F.lit(n).cast("bigint")

    if mixed is None:
        return docs.select("doc_id", F.lit("").alias("key"), "source", *[whole(0).alias(c) for c in ("size", "source_size")],
                           F.lit(0.0).alias("target"), whole(0).alias("taken"), whole(None).alias("first_slot"), whole(0).alias("n_slots"))
    sums = mixed.taken.groupBy("source_ix", "start").agg(
        F.sum("words").alias("taken"), F.min("slot").alias("first_slot"), F.count(F.lit(1)).alias("n_slots"))
    used = mixed.rows.where("size > 0").join(sums, ["source_ix", "start"], "left")
    names = ["doc_id", "key", "source", "size", "source_size", "target"]
    return (used.select(*names, F.coalesce("taken", whole(0)).alias("taken"), "first_slot", F.coalesce("n_slots", whole(0)).alias("n_slots"))
            .unionByName(mixed.rows.where("size = 0").select(
                *names, whole(0).alias("taken"), whole(None).alias("first_slot"), whole(0).alias("n_slots"))))


@query("op2_source_mix", r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
    md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as key
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
    ([5, 2, 1])[1 + cast((row_number() over (order by source nulls last) - 1) % 3 as int)] as w,
    row_number() over (order by source nulls last) as ix
  from sized group by source),
o as (
  select *, sum(source_size) over () as words, sum(w) over () as weights,
    coalesce(sum(3 * source_size) over (order by source_size / w, ix rows between unbounded preceding and 1 preceding), 0) as gone,
    coalesce(sum(w) over (order by source_size / w, ix rows between unbounded preceding and 1 preceding), 0) as gone_w
  from s),
c as (select *, 3 * source_size <= (words - gone)::double / (weights - gone_w)::double * w as full_up from o),
f as (select max(words) - coalesce(sum(3 * source_size) filter (full_up), 0) as words,
        max(weights) - coalesce(sum(w) filter (full_up), 0) as weights from c),
t as (
  select c.source, c.source_size, case when full_up then (3 * source_size)::double
    else f.words::double / f.weights::double * w end as target from c, f),
n as (select *, row_number() over (order by source nulls last) - 1 as ix, cast(floor(target + 0.5) as bigint) as need from t),
g as (select *, cast(sum(need) over (order by ix) as double) / sum(need) over () as edge, (need + 2047) // 2048 as blocks from n),
slots as (select unnest(range(cast((select sum(blocks) from g) as bigint))) as slot),
points as (select slot, cast((cast(slot as uhugeint) * 11400714819323198485) % 18446744073709551616 as double) / 18446744073709551616.0 as point from slots),
drawn as (select slot, least((select count(*) from g where edge <= point), (select max(ix) from g)) as ix from points),
ranked as (select slot, ix, row_number() over (partition by ix order by slot) - 1 as rank from drawn),
schedule as (
  select slot, r.ix, rank from ranked r join g on g.ix = r.ix where rank < blocks
  union all
  select (select count(*) from slots), ix, unnest(range(coalesce(got, 0), blocks))
  from g left join (select ix as drawn_ix, count(*) as got from ranked group by 1) on drawn_ix = ix where coalesce(got, 0) < blocks),
p as (
  select row_number() over () as row, d.doc_id, d.size, g.source_size, g.target, g.need, g.ix,
    cast(sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows between unbounded preceding and current row) as bigint)
      - d.size as start
  from sized d join g on d.source is not distinct from g.source),
turns as (select row, ix, start + e * source_size as low, least(start + e * source_size + size, need) as stop from p, range(3) as s(e)
  where size > 0 and start + e * source_size < need),
pieces as (select *, unnest(range(low // 2048, (stop - 1) // 2048 + 1)) as rank from turns),
taken as (
  select row, sum(least(stop, (rank + 1) * 2048) - greatest(low, rank * 2048)) as taken, min(slot) as first_slot, count(*) as n_slots
  from pieces join schedule using (ix, rank) group by row)
select doc_id, cast(size as bigint) as size, source_size, target, cast(coalesce(taken, 0) as bigint) as taken, first_slot,
  coalesce(n_slots, 0) as n_slots
from p left join taken using (row)""")
def op2_source_mix(spark, sf_dir):
    """Every document with its size, the words that the mix takes of it, and the slots of the schedule that take them."""
    docs = table(spark, sf_dir, "documents")
    return counted(docs, mix(docs)).select("doc_id", "size", "source_size", "target", "taken", "first_slot", "n_slots")
