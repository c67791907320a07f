"""Exact nearest vectors by inner product with a table of distances to pivots.

For integer vectors, 2 <q, x> = |q|^2 + |x|^2 - |q - x|^2, and |q - x| is at least |d(q, p) - d(x, p)| for every pivot p. The
largest of these bounds over all pivots caps a candidate's score. Candidates of a block are taken in the order of their caps,
until the cap of the next one is below the query's k-th best score so far.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from casegrain.llm.common import query, table
from casegrain.session import stored

SCALE = 256
PIVOTS = 16
QUERY_BLOCK, ROW_BLOCK = 256, 1024
#: Bytes of the row blocks that a stripe holds, and of one block, at most or a little more; a task has all blocks of a stripe in memory.
STRIPE_BYTES, BLOCK_BYTES = 32 << 20, 1 << 20
NO_ID = (1 << 63) - 1


def usable(embeddings: DataFrame, scale: int = SCALE) -> DataFrame:
    """(rid, vec_id, v): floor(scale * x) per component, for vectors that are not null and have finite components only.

    A component that does not fit 64 bits then counts as not finite. Every row gets a number of its own.
    """
    scaled = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < 2.0 ** 62 / scale))
    return (embeddings.where(F.col("embedding").isNotNull() & F.coalesce(finite, F.lit(False)))
            .select(F.monotonically_increasing_id().alias("rid"), F.col("vec_id").cast("bigint").alias("vec_id"), scaled.alias("v")))


def _matrix(vectors, width: int, kind: type = np.int64) -> np.ndarray:
    out = np.zeros((len(vectors), width), dtype=kind)
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def _distances(rows: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    x, p = rows.astype(np.float64), pivots.astype(np.float64)
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None, :] - 2 * x @ p.T, 0))


def _scores(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as 64-bit integers: in floating point where that is exact, which is much faster."""
    most = float(np.abs(q.astype(np.int64)).max(initial=0)) * float(np.abs(rows.astype(np.int64)).max(initial=0)) * q.shape[-1]
    return (rows.astype(np.float64) @ q.astype(np.float64)).astype(np.int64) if most < 2 ** 52 else rows.astype(np.int64) @ q.astype(np.int64)


def blocks(rows: DataFrame, pivots: np.ndarray, size: int, kind: type = np.int64) -> DataFrame:
    """Rows (rid, vec_id, v, cell) packed into blocks of about ``size`` rows of one cell, fewer where vectors are long:
    (cell, part, n, rids, ids, vectors), components as numbers of this ``kind``."""
    width = pivots.shape[1]
    size = min(size, max(16, BLOCK_BYTES // max(1, width * np.dtype(kind).itemsize)))
    sizes = rows.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / size).alias("parts"))

    def packed(key, frame: pd.DataFrame) -> pd.DataFrame:
        own = _matrix(frame["v"].tolist(), width, kind)
        return pd.DataFrame({"cell": [key[0]], "part": [key[1]], "n": [len(frame)], "rids": [frame["rid"].to_numpy(dtype=np.int64).tobytes()],
                             "ids": [frame["vec_id"].fillna(NO_ID).to_numpy(dtype=np.int64).tobytes()], "vectors": [own.tobytes()]})

    dealt = rows.join(sizes, "cell").withColumn("part", F.pmod(F.xxhash64("rid"), F.col("parts")))
    return dealt.select("rid", F.coalesce("vec_id", F.lit(NO_ID)).alias("vec_id"), "v", "cell", "part").groupBy("cell", "part").applyInPandas(
        packed, "cell int, part bigint, n int, rids binary, ids binary, vectors binary")


def _best(queries, candidates, pivots: np.ndarray, k: int, floors: np.ndarray | None) -> list[tuple[int, int, int, int]]:
    """(query rid, vec_id, rid, score) of each query's ``k`` best in a block, of those that reach its floor."""
    (q_rids, q), (rids, ids, rows) = queries, candidates
    dq, dx = _distances(q, pivots), _distances(rows, pivots)
    q2, x2 = (q.astype(np.float64) ** 2).sum(1), (rows.astype(np.float64) ** 2).sum(1)
    apart = np.zeros((len(q), len(rows)))
    for p in range(dq.shape[1]):
        np.maximum(apart, np.abs(dq[:, p, None] - dx[None, :, p]), out=apart)
    # Distances are rounded: a little is taken off the bound, so that caps stay caps.
    apart = np.maximum(apart - 1e-9 * (dq.max(1)[:, None] + dx.max(1)[None, :]) - 1e-6, 0)
    caps = (q2[:, None] + x2[None, :] - apart * apart) / 2 * (1 + 1e-12) + 1e-3
    out = []
    for i in range(len(q)):
        floor = -np.inf if floors is None else floors[i]
        near = np.flatnonzero(caps[i] >= floor)
        near = near[np.argsort(-caps[i, near], kind="stable")]
        score, taken, step = np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64), 128
        at = 0
        while at < len(near) and caps[i, near[at]] >= floor:
            some = near[at:at + step]
            some = some[rids[some] != q_rids[i]]
            score = np.append(score, _scores(q[i], rows[some]))
            taken = np.append(taken, some)
            if len(score) >= k:
                floor = max(floor, np.partition(score, len(score) - k)[len(score) - k])
                kept = score >= floor
                score, taken = score[kept], taken[kept]
            at, step = at + step, step * 4
        best = np.lexsort((rids[taken], ids[taken], -score))[:k]
        out += [(int(q_rids[i]), int(ids[taken[b]]), int(rids[taken[b]]), int(score[b])) for b in best if score[b] >= floor]
    return out


def top_k(embeddings: DataFrame, queries: str, k: int = 5, pivots: int = PIVOTS, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for every row that the SQL condition ``queries`` picks, the ``k`` other rows of the
    highest inner product, ties to the smaller vec_id (null last).

    Exact. Vectors that are null or have null or non-finite components take no part; shorter vectors are padded with zeros.
    Rows with equal ids are rows of their own; a query with fewer others has all of them; an empty table gives an empty
    result; other columns are not read.

    Queries meet rows in blocks: rows are packed by nearest pivot, blocks dealt into stripes, and query blocks sent to every
    stripe. A first pass compares each query with one block of its own cell, so the second pass, over all blocks, starts with
    a score to beat. The driver gets the pivots only.
    """
    spark = embeddings.sparkSession
    rows = stored(usable(embeddings, scale), "vectors")
    far = F.greatest(F.array_max("v"), -F.array_min("v"))
    shape = rows.agg(F.coalesce(F.max(F.size("v")), F.lit(0)).alias("w"), F.coalesce(F.max(far), F.lit(0)).alias("far"), F.count(F.lit(1)).alias("n")).first()
    width, kind = shape["w"], np.int16 if shape["far"] < 2 ** 15 else np.int32 if shape["far"] < 2 ** 31 else np.int64
    names = F.xxhash64("v")
    chosen = rows.groupBy(names.alias("name")).agg(F.first("v").alias("v")).orderBy("name").limit(pivots).collect()
    table_of = _matrix([r["v"] for r in chosen], width)

    def celled(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _matrix(batch.column(2).to_pylist(), width)
            cell = np.argmin(_distances(own, table_of), axis=1) if len(own) else np.zeros(0)
            yield batch.append_column("cell", pa.array(cell.astype(np.int32)))

    rows = stored(rows.mapInArrow(celled, "rid bigint, vec_id bigint, v array<bigint>, cell int"), "cells")
    candidates = stored(blocks(rows, table_of, ROW_BLOCK, kind), "row-blocks")
    asked = stored(blocks(rows.where(queries), table_of, QUERY_BLOCK, kind), "query-blocks")

    # Rows are blocks here: a session of its own reads few of them at a time and passes few to Python.
    own = spark.newSession()
    own.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    own.conf.set("spark.sql.parquet.columnarReaderBatchSize", 16)
    own.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    # Every stripe gets all query blocks, so there are no more than the memory of a task asks for and all tasks have work.
    stripes = max(2 * spark.sparkContext.defaultParallelism, shape["n"] * (width * np.dtype(kind).itemsize + 16) // STRIPE_BYTES + 1)
    q = own.read.parquet(*asked.inputFiles()) if asked.inputFiles() else None
    if q is None or not candidates.inputFiles():
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score bigint")
    x = own.read.parquet(*candidates.inputFiles())
    q = q.select("cell", F.col("part").alias("q_part"), F.col("rids").alias("q_rids"), F.col("ids").alias("q_ids"), F.col("vectors").alias("q"))

    def compare(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for r in batch.to_pylist():
                ours = np.frombuffer(r["q_rids"], dtype=np.int64), np.frombuffer(r["q"], dtype=kind).reshape(-1, width)
                theirs = (*(np.frombuffer(r[c], dtype=np.int64) for c in ("rids", "ids")), np.frombuffer(r["vectors"], dtype=kind).reshape(-1, width))
                floors = np.frombuffer(r["floors"], dtype=np.float64) if r.get("floors") else None
                ids = dict(zip(*(np.frombuffer(r[c], dtype=np.int64).tolist() for c in ("q_rids", "q_ids"))))
                found += [(a, ids[a], b, c, d) for a, b, c, d in _best(ours, theirs, table_of, k, floors)]
            columns = list(zip(*found)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, type=pa.int64()) for c in columns],
                                             names=["q_rid", "query_id", "vec_id", "rid", "score"])

    hits = "q_rid bigint, query_id bigint, vec_id bigint, rid bigint, score bigint"
    first = stored(q.join(x.where("part = 0").drop("part", "n"), "cell").drop("cell", "q_part").mapInArrow(compare, hits), "first-hits")
    beat = first.groupBy("q_rid").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k).select("q_rid", "floor")

    def with_floors(key, block: pd.DataFrame, floor: pd.DataFrame) -> pd.DataFrame:
        known = dict(zip(floor["q_rid"], floor["floor"]))
        block["floors"] = [np.array([known.get(r, -np.inf) for r in np.frombuffer(b, dtype=np.int64)]).tobytes() for b in block["q_rids"]]
        return block[["q_rids", "q_ids", "q", "floors"]]

    where = own.read.parquet(*rows.inputFiles()).where(queries).select(F.col("rid").alias("q_rid"), "cell")
    sizes = q.groupBy("cell").agg((F.max("q_part") + 1).alias("parts"))
    of_block = (beat.join(where, "q_rid").join(sizes, "cell")
                .withColumn("q_part", F.pmod(F.xxhash64("q_rid"), F.col("parts"))).select("cell", "q_part", "q_rid", "floor"))
    q = stored(q.groupBy("cell", "q_part").cogroup(of_block.groupBy("cell", "q_part")).applyInPandas(
        with_floors, "q_rids binary, q_ids binary, q binary, floors binary"), "floors")
    q = q.withColumn("stripe", F.explode(F.sequence(F.lit(0), F.lit(stripes - 1))))
    x = x.select(F.pmod(F.xxhash64("cell", "part"), F.lit(stripes)).cast("int").alias("stripe"), "rids", "ids", "vectors")
    found = stored(q.join(x, "stripe").drop("stripe").mapInArrow(compare, hits), "hits")
    found = spark.read.schema(found.schema).parquet(*found.inputFiles())
    order = Window.partitionBy("q_rid", "query_id").orderBy(F.desc("score"), "vec_id", "rid")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.when(F.col("vec_id") != NO_ID, F.col("vec_id")).alias("vec_id"), "score")


@query("op7_pivot_topk", """
with v as (
  select row_number() over () as rid, vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
q as (select * from v where vec_id % 50 = 0),
s as (
  select q.rid, q.vec_id as query_id, x.vec_id,
    cast(list_sum(list_transform(list_zip(q.v, x.v), lambda p: p[1] * p[2])) as bigint) as score
  from q join v x on q.rid <> x.rid)
select query_id, cast(rank as int) as rank, vec_id, score
from (select *, row_number() over (partition by rid order by score desc, vec_id) as rank from s) where rank <= 5""")
def op7_pivot_topk(spark, sf_dir):
    """The five nearest other rows of every row whose id is divisible by 50."""
    return top_k(table(spark, sf_dir, "embeddings"), "vec_id % 50 = 0")
