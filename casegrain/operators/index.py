"""Token index: postings, inverted lists, bitmaps, statistics."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from casegrain.functions import identity, text, values
from casegrain.operators.filters import any_of
from casegrain.operators.skew import hot_keys
from casegrain.session import spread

LIST_SIZE = 65536
LONG_LIST = 1_000_000  # fixed value: lists longer than this are flagged


def postings(df: DataFrame, table_name: str, key: str, terms: Sequence[str] | None = None) -> DataFrame:
    """(token, global_id, table_name, pk) for every token of every row, each once per row.

    ``terms`` keeps only those tokens, before rows are multiplied: a search then shuffles hits and nothing else.
    """
    if terms is None:
        tokens = text.tokens_typed(df.schema, key)
    else:
        # A row without any of the terms as plain text cannot hold them as tokens: it is not even split.
        cells = F.lower(F.concat_ws(" ", *[text.plain_text(f) for f in df.schema.fields if f.name != key]))
        df = df.where(any_of(F.contains(cells, F.lit(t)) for t in terms))
        tokens = F.array_intersect(text.all_tokens(df.schema, key), F.array(*[F.lit(t) for t in terms]))
    return (df.select(F.explode(tokens).alias("token"), F.col(key).cast("bigint").alias("pk"))
            .select("token", identity.pack_global_id(table_name, F.col("pk")).alias("global_id"),
                    F.lit(table_name).alias("table_name"), "pk"))


def write_postings(index: DataFrame, path: str) -> None:
    """Store postings ranged and sorted by token, so that a search for a few tokens skips all other files and row groups.

    The range runs over (token, global_id): a token held by a large share of the rows spreads over several files.
    """
    (index.repartitionByRange("token", "global_id").sortWithinPartitions("token", "global_id")
     .write.mode("overwrite").option("parquet.bloom.filter.enabled#token", "true").parquet(path))


def record_tokens(df: DataFrame, key: str, tokens: Column, unique_key: bool = False,
                  terms: Sequence[str] | None = None) -> DataFrame:
    """(key, token), each pair once. Tokens are distinct per row, so a unique key needs no further pass.

    ``terms`` keeps only those tokens, before rows are multiplied. Where keys may repeat, rows are dealt by their key first: a
    large file would be one task, that holds all its pairs; and pairs of a key need no second shuffle.
    """
    df = df if unique_key else spread(df, key)
    tokens = tokens if terms is None else F.array_intersect(tokens, F.array(*[F.lit(t) for t in terms]))
    pairs = df.select(key, F.explode(tokens).alias("token"))
    return pairs if unique_key else pairs.distinct()


def grouped_lists(pairs: DataFrame, keys: Sequence[str], item: str, max_items: int = LIST_SIZE) -> DataFrame:
    """Sorted list of the items of each group as ``(keys, part, items, frequency)``.

    Pairs must be distinct. A group with more than ``max_items`` items is spread over several parts by a hash of
    the item, so no task ever holds a whole hot group and nothing is cut off; other groups have the one part 0.
    """
    keys = list(keys)
    hot = hot_keys(pairs, keys, max_items)
    if hot is None:
        return (pairs.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("items"))
                .select(*keys, F.lit(0).alias("part"), "items", F.size("items").cast("bigint").alias("frequency")))
    spread = F.ceil(F.col("_total") / max_items).cast("int")
    part = F.when(F.col("_total").isNull(), 0).otherwise(F.pmod(F.xxhash64(item), spread)).cast("int")
    return (pairs.join(hot, keys, "left").withColumn("part", part)
            .repartition(*keys, "part")  # else the grouping would settle for rows placed by the keys alone
            .groupBy(*keys, "part")
            .agg(F.sort_array(F.collect_list(item)).alias("items"), F.max("_total").alias("_total"))
            .select(*keys, "part", "items", F.coalesce("_total", F.size("items").cast("bigint")).alias("frequency")))


def inverted_index(pairs: DataFrame, record: str, max_items: int = LIST_SIZE, long_list: int = LONG_LIST) -> DataFrame:
    """token -> record ids and frequency. Long lists are flagged and come in parts, never shortened."""
    return (grouped_lists(pairs.select("token", record), ["token"], record, max_items)
            .withColumnRenamed("items", "record_ids")
            .withColumn("long_list", F.col("frequency") > long_list))


def index_counters(df: DataFrame, key: str, tokens: Column, long_list: int = LONG_LIST) -> DataFrame:
    """Records processed, different tokens, tokens with long lists."""
    per_token = record_tokens(df, key, tokens, unique_key=True).groupBy("token").agg(F.count(F.lit(1)).alias("n"))
    counts = per_token.agg(F.count(F.lit(1)).alias("unique_tokens"), F.count_if(F.col("n") > long_list).alias("long_lists"))
    return counts.withColumn("records", df.agg(F.count(F.lit(1))).scalar())


def token_stats(index: DataFrame) -> DataFrame:
    """Records per token and table."""
    return index.groupBy("token", "table_name").agg(F.count(F.lit(1)).alias("records"))


def token_bitmap(index: DataFrame) -> DataFrame:
    """Mergeable set of row ids per token and table, as 64-bit words: bit ``pk mod 64`` of word ``pk div 64``.

    A rare token costs a few words, a frequent one a bit per row, and words merge with ``bit_or`` in hash aggregation
    with partial results before the shuffle. Rows are best dealt to all tasks (`spread`) before they are split. (Spark's own bitmap aggregate takes 4 KB for every token, and sorts.)
    """
    pk = F.col("pk")
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), pk.bitwiseAND(F.lit(63)).cast("int"))
    updated = [F.max("updated_at").alias("updated_at")] if "updated_at" in index.columns else []
    return index.groupBy("token", "table_name", F.shiftright(pk, 6).alias("word")).agg(F.bit_or(bit).alias("bits"), *updated)


def merge_bitmaps(*bitmaps: DataFrame) -> DataFrame:
    """Union of bitmap tables."""
    merged = bitmaps[0]
    for other in bitmaps[1:]:
        merged = merged.unionByName(other)
    updated = [F.max("updated_at").alias("updated_at")] if "updated_at" in merged.columns else []
    return merged.groupBy("token", "table_name", "word").agg(F.bit_or("bits").alias("bits"), *updated)


def bitmap_sizes(bitmaps: DataFrame) -> DataFrame:
    """Ids per token and table."""
    return bitmaps.groupBy("token", "table_name").agg(F.sum(F.bit_count("bits")).alias("ids"))


def bitmap_intersect(bitmaps: DataFrame, terms: Sequence[str]) -> DataFrame:
    """(table_name, pk) of the rows that hold all terms: words are joined on their number and combined bit by bit."""
    parts = [bitmaps.where(F.col("token") == t).select("table_name", "word", F.col("bits").alias(f"_{i}"))
             for i, t in enumerate(dict.fromkeys(terms))]
    both = reduce(lambda a, b: a.join(b, ["table_name", "word"]), parts)
    bits = reduce(lambda a, b: a.bitwiseAND(b), [F.col(f"_{i}") for i in range(len(parts))])
    positions = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit(F.col("_bits"), i) == 1)
    return (both.select("table_name", "word", bits.alias("_bits")).where("_bits <> 0")
            .select("table_name", F.explode(F.transform(positions, lambda i: F.col("word") * 64 + i)).alias("pk")))


def entity_rows(df: DataFrame, table_name: str, key: str) -> DataFrame:
    """First layer of the entity index: id, type, name and searchable text of every row."""
    payload = [c for c in df.columns if c != key]
    return df.select(
        identity.entity_key(F.lit(table_name), F.col(key)).alias("entity_key"),
        values.entity_type(payload).alias("entity_type"),
        F.lit(table_name).alias("source_table"),
        F.col(key).cast("string").alias("row_id"),
        values.entity_name(payload).alias("entity_name"),
        values.searchable_text(payload).alias("searchable_text"),
    )


def entity_tokens(entities: DataFrame, terms: Sequence[str] | None = None) -> DataFrame:
    """Second layer: (token, entity_key, entity_type), each entity once per token. ``terms`` keeps only those tokens."""
    tokens = text.tokens_words(F.col("searchable_text"))
    if terms is not None:
        entities = entities.where(any_of(F.contains(F.col("searchable_text"), F.lit(t)) for t in terms))
        tokens = F.array_intersect(tokens, F.array(*[F.lit(t) for t in terms]))
    return entities.select(F.explode(tokens).alias("token"), "entity_key", "entity_type")


def alpha_partition(token: Column) -> Column:
    """First letter of a token, or ``other``."""
    first = F.substring(token, 1, 1)
    return F.when(first.between("a", "z"), first).otherwise("other")


def write_alpha_partitions(pairs: DataFrame, path: str) -> None:
    """Index files by first letter. Rows are ranged by token first, so a crowded letter spans several tasks."""
    (pairs.withColumn("letter", alpha_partition(F.col("token")))
     .repartitionByRange("letter", "token", *[c for c in pairs.columns if c != "token"])
     .sortWithinPartitions("letter", "token")
     .write.mode("overwrite").partitionBy("letter").parquet(path))
