"""Search over the token index, over columns, and across sources."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import StringType

from casegrain.functions import values
from casegrain.functions.text import split_words
from casegrain.operators.filters import any_of, contains_text
from casegrain.operators.paging import keyset_page, order_by, page_with_total, top_per_group
from casegrain.operators.warehouse import union_all

SEARCH_KEYS = [("global_id", "desc"), ("table_name", "asc")]
MAX_PER_COLUMN = 20  # fixed value: most hits one column may contribute


def query_terms(query: str) -> list[str]:
    """Different lower-cased words of a query, in order."""
    return list(dict.fromkeys(query.lower().split()))


def _bit(terms: Sequence[str]) -> Column:
    if len(terms) > 62:
        raise ValueError("at most 62 different words per query")
    return reduce(lambda acc, it: acc.when(F.col("token") == it[1], F.lit(1 << it[0]).cast("bigint")),
                  list(enumerate(terms))[1:], F.when(F.col("token") == terms[0], F.lit(1).cast("bigint")))


def _found(index: DataFrame, terms: Sequence[str], record: Sequence[str]) -> DataFrame:
    """Per record the set of terms it holds as bits: one number per record moves in the shuffle."""
    return (index.where(F.col("token").isin(list(terms)))
            .groupBy(*record).agg(F.bit_or(_bit(terms)).alias("_bits")))


def postings_intersect(index: DataFrame, terms: Sequence[str], record: Sequence[str]) -> DataFrame:
    """Records that hold every term; a term nobody holds gives no record at all."""
    full = (1 << len(terms)) - 1
    return _found(index, terms, record).where(F.col("_bits") == full).drop("_bits")


def postings_intersect_lenient(index: DataFrame, terms: Sequence[str], record: Sequence[str]) -> DataFrame:
    """Records that hold every term that occurs anywhere."""
    found = _found(index, terms, record)
    known = index.where(F.col("token").isin(list(terms))).agg(F.bit_or(_bit(terms))).scalar()
    return found.where(F.col("_bits") == known).drop("_bits")


def search_any_ranked(index: DataFrame, terms: Sequence[str], record: Sequence[str]) -> DataFrame:
    """Records that hold at least one term, with the number of terms they hold."""
    return (_found(index, terms, record).withColumn("matched_terms", F.bit_count("_bits"))
            .drop("_bits").orderBy(F.desc("matched_terms"), *record))


def postings_lookup(hits: DataFrame, rows: DataFrame, key: str = "global_id") -> DataFrame:
    """Live source rows of the hits."""
    live = rows.where(F.col("is_deleted") == 0).drop("is_deleted") if "is_deleted" in rows.columns else rows
    return live.join(hits.select(key), key)


def search_all_tokens(index: DataFrame, rows: DataFrame, terms: Sequence[str], limit: int,
                      after: Sequence[object] | None = None) -> DataFrame:
    """Newest rows, over all tables, that hold every term: one page with ``has_more``.

    Rows with ``is_deleted`` other than 0 (if there is the column) leave the hits before these are paged, so they take no
    place on a page and do not count for ``has_more``. Only the page's ids are joined to the rows. Table ids have 16 bits
    and can collide, so the table's name takes part in the order and in the joins.
    """
    record = ["global_id", "table_name"]
    hits = postings_intersect(index, terms, record)
    if "is_deleted" in rows.columns:
        rows = rows.where(F.col("is_deleted") == 0).drop("is_deleted")
        hits = hits.join(rows.select(*record), record, "left_semi")
    page = keyset_page(hits, SEARCH_KEYS, limit, after)
    return rows.join(page, record).orderBy(*order_by(SEARCH_KEYS))


def search_three_layer(index: DataFrame, entities: DataFrame, sources: Mapping[str, tuple[DataFrame, str]], terms: Sequence[str],
                       limit: int) -> DataFrame:
    """First entities by key that hold every term that occurs, each with its row of its own source, and the ``total``.

    ``sources``: source table -> (rows, key); every source of ``entities`` belongs there. Columns that a source lacks are null.
    """
    hits = postings_intersect_lenient(index, terms, ["entity_key"])
    page = hits.orderBy("entity_key").limit(limit).withColumn("total", hits.agg(F.count(F.lit(1))).scalar())
    found = entities.join(page, "entity_key")
    parts = []
    for name, (rows, key) in sources.items():
        rows = rows.withColumn("row_id", F.col(key).cast("string"))
        parts.append(found.where(F.col("source_table") == name).join(rows, "row_id"))
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def hits_by_table(hits: DataFrame, source: str = "table_name") -> DataFrame:
    return hits.groupBy(source).agg(F.count(F.lit(1)).alias("hits"))


def text_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]


def search_rows(df: DataFrame, key: str, term: str, limit: int, offset: int = 0,
                columns: Sequence[str] | None = None) -> DataFrame:
    """Rows of one table with the term in any of its text columns, the columns it is in, and the type of the term."""
    columns = [c for c in (columns or text_columns(df)) if c in df.columns]
    found = df.where(any_of(contains_text(c, term) for c in columns))
    return (page_with_total(found, [(key, "asc")], limit, offset)
            .withColumn("matched_columns", values.matched_columns(columns, term))
            .withColumn("query_type", values.classify_value(F.lit(term))))


def column_hits(df: DataFrame, table_name: str, key: str, term: str) -> DataFrame:
    """(table_name, column_name, pk, value) for every text column holding the term.

    One scan per table: the cells are filtered in the array, only hits are exploded.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value")) for c in text_columns(df)])
    hits = F.filter(cells, lambda cell: contains_text(cell["value"], term))
    return (df.select(F.lit(table_name).alias("table_name"), F.col(key).cast("string").alias("pk"),
                      F.explode(hits).alias("hit"))
            .select("table_name", "hit.column_name", "pk", "hit.value"))


def search_columns(tables: Mapping[str, tuple[DataFrame, str]], term: str, per_column: int = 5) -> DataFrame:
    """At most ``per_column`` hits for every text column of every table (name -> (DataFrame, key)); `MAX_PER_COLUMN` can be asked for."""
    if per_column > MAX_PER_COLUMN:
        raise ValueError(f"at most {MAX_PER_COLUMN} hits of a column can be asked for")
    hits = union_all([column_hits(df, name, key, term) for name, (df, key) in tables.items()])
    return top_per_group(hits, ["table_name", "column_name"], [("pk", "asc")], per_column)


def search_sources(sources: Mapping[str, Mapping[str, tuple[DataFrame, str]]], term: str, per_column: int = 5) -> DataFrame:
    """``search_columns`` over several sources, with the type of the term."""
    found = union_all([search_columns(tables, term, per_column).withColumn("source", F.lit(source))
                       for source, tables in sources.items()])
    return found.withColumn("query_type", values.classify_value(F.lit(term)))


def _equal_first_text(tables: Mapping[str, tuple[DataFrame, str]], term: str, limit: int) -> dict[str, tuple[DataFrame, str]]:
    """Per table the rows whose first text column equals the term, half the limit by key, with that key's name."""
    return {name: (df.where(F.col(text_columns(df)[0]) == term).orderBy(key).limit(limit // 2), key) for name, (df, key) in tables.items()}


def search_global_duplicates(tables: Mapping[str, tuple[DataFrame, str]], term: str, limit: int = 20) -> DataFrame:
    """Rows whose first text column equals the term, half the limit per table, tagged with duplicate references."""
    parts = []
    for name, (hits, key) in _equal_first_text(tables, term, limit).items():
        tagged = values.with_duplicate_tag(hits)
        parts.append(tagged.select(F.lit(name).alias("table_name"), F.col(key).cast("bigint").alias("pk"), "tags",
                                   F.col("_has_duplicate_ref").alias("has_ref")))
    return union_all(parts)


def global_duplicates_by_table(found: DataFrame) -> DataFrame:
    """What ``search_global_duplicates`` found, one row per table: its rows by key (at most half the limit) and their number."""
    rows = F.sort_array(F.collect_list(F.struct("pk", "tags", "has_ref")))
    return found.groupBy("table_name").agg(rows.alias("results"), F.count(F.lit(1)).alias("total_results"))


def global_duplicate_refs(tables: Mapping[str, tuple[DataFrame, str]], term: str, limit: int = 20) -> DataFrame:
    """Different duplicate references (database and table both named) of the rows that ``search_global_duplicates`` finds."""
    pair = ["duplicate_db", "duplicate_table"]
    parts = [hits.where((F.col(pair[0]) != "") & (F.col(pair[1]) != ""))
             .select(F.col(pair[0]).alias("ref_database"), F.col(pair[1]).alias("ref_table"))
             for hits, _ in _equal_first_text(tables, term, limit).values() if set(pair) <= set(hits.columns)]
    if not parts:
        first = next(iter(tables.values()))[0]
        return first.sparkSession.createDataFrame([], "ref_database string, ref_table string, ref_type string")
    return union_all(parts).distinct().withColumn("ref_type", F.lit("duplicate"))


def fulltext_rank(df: DataFrame, fields: Sequence[str], term: str) -> DataFrame:
    """Rows whose fields together hold every word of the query, with a score between 0 and 1.

    The score is m / (m + 1) with m the number of occurrences of the query's words; words are not stemmed.
    """
    words = F.flatten(F.array(*[F.coalesce(split_words(F.regexp_replace(F.col(f), r"[@.#,;:]", " ")),
                                           F.array().cast("array<string>")) for f in fields]))
    terms = query_terms(term)
    wanted = F.array(*[F.lit(t) for t in terms])
    occurrences = F.size(F.filter("_words", lambda w: F.array_contains(wanted, w)))
    # A row without one of the words as plain text cannot hold it as a word: it is not even split.
    whole = F.lower(F.concat_ws(" ", *fields))
    for term in terms:
        df = df.where(F.contains(whole, F.lit(term)))
    return (df.withColumn("_words", words)
            .where(F.size(F.array_except(wanted, F.col("_words"))) == 0)
            .withColumn("rank", occurrences / (occurrences + 1)).drop("_words"))


def cross_source_match(df: DataFrame, value: str, source: str) -> DataFrame:
    """Per value: rows, the sources holding it with their matches, and whether more than one does.

    The number of sources is that of the registered databases, so the set per value stays small.
    """
    per_source = df.groupBy(value, source).agg(F.count(F.lit(1)).alias("_n"))
    return (per_source.groupBy(value)
            .agg(F.sum("_n").alias("matches"),
                 F.sort_array(F.collect_list(F.struct(F.col(source).alias("source"), F.col("_n").alias("matches")))).alias("sources"))
            .withColumn("has_duplicates", F.size("sources") > 1))
