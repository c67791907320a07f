"""A token index that is written once and read by every search.

Postings (token, table_name, pk, sign) lie in plain Parquet folders by token bucket and batch, sorted by token: a search prunes the
folders of other buckets, skips the files, row groups and pages of other tokens by their least and greatest one, and splits no text. Batch 0 is the
whole of the tables; each later batch holds what a set of changed rows adds (+1) and takes away (-1), and a record holds a token
where the signs add up to more than zero. So deleted rows are no hits, and no file is ever rewritten; ``compacted`` folds the batches
into a new index.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from casegrain.functions import identity, text
from casegrain.operators.paging import after_cursor, order_by

#: Token buckets, a folder each.
BUCKETS = 32
KEYS = ["token", "table_name", "pk"]


def bucket_of(token: Column) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(BUCKETS)).cast("int")


def row_postings(df: DataFrame, table_name: str, key: str, tokens: Column | None = None, sign: int = 1) -> DataFrame:
    """(token, table_name, pk, sign) for the tokens of every row, each once per row; by default those of all columns by type.

    The rows are dealt out by their content before they are split: what moves is the rows, which are far less than their postings.
    """
    tokens = text.tokens_typed(df.schema, key) if tokens is None else tokens
    plain = [name for name, kind in df.dtypes if not kind.startswith(("map", "array", "struct", "variant"))]
    return df.repartition(F.xxhash64(*plain)).select(F.explode(tokens).alias("token"), F.lit(table_name).alias("table_name"), F.col(key).cast("bigint").alias("pk"),
                     F.lit(sign).cast("tinyint").alias("sign"))


def write_batch(postings: DataFrame, path: str, batch: int) -> None:
    """Store one batch; written again it replaces itself. No shuffle: each task sorts what it has and adds a file to every bucket, so
    a token that most rows hold is in the files of all tasks."""
    (postings.withColumn("bucket", bucket_of(F.col("token"))).sortWithinPartitions("bucket", "token", "table_name", "pk")
     .write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/batch={batch}"))


def changed_postings(before: Sequence[DataFrame], after: Sequence[DataFrame]) -> DataFrame:
    """What changed rows take from the index and add to it: postings of their old versions (sign -1) and of the new ones; those that
    stay the same cancel out here."""
    signed = reduce(DataFrame.unionByName, [*before, *after])
    return signed.groupBy(*KEYS).agg(F.sum("sign").cast("tinyint").alias("sign")).where("sign <> 0")


@dataclass(frozen=True)
class PostingsIndex:
    """The index at a path, as of batch ``upto`` where that is given."""

    spark: SparkSession
    path: str
    upto: int | None = None

    def postings(self, terms: Sequence[str] | None = None) -> DataFrame:
        """Signed postings, only those of ``terms`` where given: the buckets prune folders, the tokens reach the Parquet readers."""
        df = self.spark.read.parquet(self.path)
        if self.upto is not None:
            df = df.where(F.col("batch") <= self.upto)
        if terms is not None:
            # Constants, which the optimiser folds before it prunes folders.
            df = df.where(F.col("bucket").isin([bucket_of(F.lit(t)) for t in terms]) & F.col("token").isin(list(terms)))
        return df.select(*KEYS, "sign", "batch")

    def live(self) -> DataFrame:
        """(token, table_name, pk) as it stands after all batches."""
        if self.upto == 0:
            return self.postings().select(*KEYS)
        return self.postings().groupBy(*KEYS).agg(F.sum("sign").alias("_n")).where("_n > 0").select(*KEYS)

    def held(self, terms: Sequence[str], record: Sequence[str] = ("table_name", "pk")) -> DataFrame:
        """(record, terms): the terms that each record holds at least one of, as an array. One row per record moves in the shuffle."""
        sums = [F.sum(F.when(F.col("token") == t, F.col("sign").cast("int")).otherwise(0)) > 0 for t in terms]
        found = F.array_compact(F.array(*[F.when(s, F.lit(t)) for s, t in zip(sums, terms)]))
        return self.postings(terms).groupBy(*record).agg(found.alias("terms")).where(F.size("terms") > 0)

    def all_of(self, terms: Sequence[str], record: Sequence[str] = ("table_name", "pk")) -> DataFrame:
        """Records that hold every term."""
        return self.held(terms, record).where(F.size("terms") == len(set(terms))).drop("terms")

    def all_known_of(self, terms: Sequence[str], record: Sequence[str] = ("table_name", "pk")) -> DataFrame:
        """Records that hold every term that any record holds."""
        held = self.held(terms, record)
        known = held.agg(F.size(F.array_distinct(F.flatten(F.collect_set("terms"))))).scalar()
        return held.where(F.size("terms") == known).drop("terms")

    def any_of(self, terms: Sequence[str], record: Sequence[str] = ("table_name", "pk")) -> DataFrame:
        """Records that hold some term, with how many of them, most first."""
        return (self.held(terms, record).withColumn("matched_terms", F.size("terms")).drop("terms")
                .orderBy(F.desc("matched_terms"), *record))


def compacted(index: PostingsIndex, path: str) -> PostingsIndex:
    """The index folded into one batch at a new path."""
    write_batch(index.live().withColumn("sign", F.lit(1).cast("tinyint")), path, 0)
    return PostingsIndex(index.spark, path)


PAGE_KEYS = [("global_id", "desc"), ("table_name", "asc")]


@dataclass(frozen=True)
class Page:
    """Rows of a page in order, the cursor of its last row (None for an empty page), whether more follow, and hits per table."""

    rows: DataFrame
    cursor: tuple | None
    has_more: bool
    hits: dict[str, int]


def search_page(index: PostingsIndex, tables: Mapping[str, tuple[DataFrame, str]], terms: Sequence[str], limit: int,
                after: tuple | None = None) -> Page:
    """Newest records of all tables that hold every term: one page, with the number of hits in each table.

    ``tables``: name -> (rows, key). Only the page's ids, ``limit`` at most, reach the driver; they are unpacked there and each table
    looks its rows up by its own key, which its scan can prune by. Hits are counted while the page is taken, in the same pass.
    """
    packed = F.coalesce(*[F.when(F.col("table_name") == name, identity.pack_global_id(name, F.col("pk"))) for name in tables])
    seen = Observation()
    hits = index.all_of(terms).withColumn("global_id", packed)
    hits = hits.observe(seen, *[F.count_if(F.col("table_name") == name).alias(name) for name in tables])
    if after is not None:
        hits = hits.where(after_cursor(hits.schema, PAGE_KEYS, after))
    found = hits.orderBy(*order_by(PAGE_KEYS)).limit(limit + 1).collect()
    page = found[:limit]
    parts = []
    for name, (rows, key) in tables.items():
        own = [r["pk"] for r in page if r["table_name"] == name]
        parts.append(rows.where(F.col(key).isin(own)).withColumns({"table_name": F.lit(name), "global_id": identity.pack_global_id(name, F.col(key))}))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return Page(rows.orderBy(*order_by(PAGE_KEYS)), (page[-1]["global_id"], page[-1]["table_name"]) if page else None, len(found) > limit, dict(seen.get))


def search_layers(index: PostingsIndex, entities: DataFrame, sources: Mapping[str, tuple[DataFrame, str]], terms: Sequence[str],
                  limit: int) -> DataFrame:
    """First entities by key that hold every term that occurs, each with the row of its own source, and the ``total``.

    ``index`` has entity keys as ``pk``'s stand-in column ``entity_key``; ``sources``: source table -> (rows, key). An entity whose
    source row is gone stays, with nulls. The page's keys, ``limit`` at most, are looked up in the entity layer and then in the sources.
    """
    seen = Observation()
    hits = index.all_known_of(terms, ["pk"]).observe(seen, F.count(F.lit(1)).alias("total"))
    keys = [r["pk"] for r in hits.select("pk", unsigned_key("pk").alias("_u")).orderBy("_u").limit(limit).collect()]
    found = entities.where(F.col("pk").isin(keys)).withColumn("total", F.lit(seen.get["total"]).cast("bigint"))
    parts = []
    for name, (rows, key) in sources.items():
        own = found.where(F.col("source_table") == name)
        ids = [r["row_id"] for r in own.select("row_id").collect()] if keys else []
        wanted = rows.where(F.col(key).isin([int(i) for i in ids])).withColumn("row_id", F.col(key).cast("string"))
        parts.append(own.join(F.broadcast(wanted), "row_id", "left"))  # a page of rows
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts).orderBy("entity_key")


def unsigned_key(key: str) -> Column:
    """A 64-bit key, kept signed in the index, in the order of unsigned numbers."""
    value = F.col(key).cast("decimal(20,0)")
    return F.when(value < 0, value + F.lit(str(2 ** 64)).cast("decimal(20,0)")).otherwise(value)


def signed_key(key: Column) -> Column:
    """An unsigned 64-bit key as the signed number with the same bits."""
    half, whole = (F.lit(str(n)).cast("decimal(20,0)") for n in (2 ** 63, 2 ** 64))
    return F.when(key >= half, key - whole).otherwise(key).cast("bigint")
