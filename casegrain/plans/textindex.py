"""Tokenisers, token index and searches over it."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain.functions import identity, text
from casegrain.operators import index, paging, postings, search
from casegrain.operators.warehouse import union_all
from casegrain.plans.indexes import GONE, INDEXED, entity_index as stored_entities, entity_layer, rows_index, tokens_index, words_index
from casegrain.plans.registry import query
from casegrain.plans.values import anchors_with_duplicates
from casegrain.plans.views import table, view, with_views
from casegrain.session import fresh_dir

C = F.col
LABELS = {"part": "p_name", "customer": "c_name", "documents": "source"}

# ---- comparison SQL ------------------------------------------------------------------------------

_SEP = r"""[\s.,;:@\-_!?"''()\[\]{}]+"""
_STOP = ", ".join(f"'{w}'" for w in text.STOP_WORDS)
_TRIM = r"""[.,;:!?"''()\[\]{}@#$%^&*+\-=<>]+"""
_WORDS = r"list_filter(regexp_split_to_array(lower({0}), '[\s\p{{Z}}]+'), lambda w: w <> '')"


def _array(expr: str) -> str:
    return _WORDS.format(expr)


TOKENS_INDEX = (f"list_distinct(list_filter(regexp_split_to_array(lower(trim(text)), '{_SEP}'), lambda w: length(w) BETWEEN 2 AND 50 "
                f"AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN ({_STOP})))")


def tokens_words_sql(expr: str) -> str:
    return (f"list_distinct(list_filter(list_transform({_array(expr)}, lambda w: regexp_replace(w, '^{_TRIM}|{_TRIM}$', '', 'g')), "
            "lambda w: length(w) BETWEEN 2 AND 50 AND NOT regexp_matches(w, '^[0-9]+$')))")


_TYPED = {
    "part": f"list_concat({_array('p_name')}, {_array('p_brand')}, {_array('p_type')}, [CAST(p_size AS VARCHAR), printf('%.2f', p_retailprice)])",
    "customer": f"list_concat({_array('c_name')}, [CAST(c_nationkey AS VARCHAR), printf('%.2f', c_acctbal)], {_array('c_mktsegment')})",
    "documents": f"list_concat({_array('text')}, {_array('lang')}, {_array('source')}, [CAST(n_chars AS VARCHAR)])",
}
TOKENISED = "\nUNION ALL ".join(
    f"SELECT '{t}' AS table_name, {INDEXED[t]} AS pk, {LABELS[t]} AS label, {GONE[t]} AS gone, "
    f"CAST({identity.table_id(t)}::HUGEINT * 281474976710656 + {INDEXED[t]} AS UBIGINT) AS global_id, "
    f"list_distinct(list_filter({expr}, lambda w: length(w) >= 2)) AS tokens FROM {t}" for t, expr in _TYPED.items())
POSTINGS = f"tokenised AS ({TOKENISED}), postings AS (SELECT table_name, pk, global_id, unnest(tokens) AS token FROM tokenised)"


def has(*terms: str) -> str:
    return " AND ".join(f"list_contains(tokens, '{t}')" for t in terms)


# ---- tokenisers ----------------------------------------------------------------------------------


def _digest(tokens):
    return [F.size(tokens).cast("bigint").alias("n_tokens"), F.md5(F.array_join(F.sort_array(tokens), " ").cast("binary")).alias("digest")]


_DIGEST_SQL = "len({0}) AS n_tokens, md5(array_to_string(list_sort({0}), ' ')) AS digest"


@query("tokenize_typed", f"WITH {POSTINGS} SELECT table_name, pk, {_DIGEST_SQL.format('tokens')} FROM tokenised")
def tokenize_typed(spark, sf):
    parts = []
    for name, key in INDEXED.items():
        df = table(spark, sf, name)
        parts.append(df.select(F.lit(name).alias("table_name"), C(key).alias("pk"), text.tokens_typed(df.schema, key).alias("tokens")))
    return union_all(parts).select("table_name", "pk", *_digest(C("tokens")))


@query("tokenize_words", f"SELECT doc_id, {_DIGEST_SQL.format('tokens')} FROM (SELECT doc_id, {tokens_words_sql('text')} AS tokens FROM documents)")
def tokenize_words(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.tokens_words(C("text")).alias("tokens"))
    return docs.select("doc_id", *_digest(C("tokens")))


@query("tokenize_index", f"SELECT doc_id, {_DIGEST_SQL.format('tokens')} FROM (SELECT doc_id, {TOKENS_INDEX} AS tokens FROM documents)")
def tokenize_index(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", text.tokens_index(C("text")).alias("tokens"))
    return docs.select("doc_id", *_digest(C("tokens")))


_ALNUM = "list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')"


@query("tokenize_alnum", f"""SELECT token, count(*) AS occurrences FROM (SELECT unnest({_ALNUM}) AS token FROM documents) GROUP BY token""")
def tokenize_alnum(spark, sf):
    words = table(spark, sf, "documents").select(F.explode(text.tokens_alnum(C("text"))).alias("token"))
    return words.groupBy("token").agg(F.count(F.lit(1)).alias("occurrences"))


_PIG_FIELDS = ["first_name", "last_name", "primary_email", "primary_phone", "city", "country", "status"]
_PIG = (f"list_distinct(list_filter(regexp_split_to_array(lower(concat_ws(' ', {', '.join(_PIG_FIELDS)})), '[ .,;:@\\-_]+'), "
        "lambda w: length(w) BETWEEN 2 AND 50))")


@query("tokenize_pig", with_views("entity") + f"SELECT entity_id, array_to_string(list_sort({_PIG}), ' ') AS tokens FROM entity")
def tokenize_pig(spark, sf):
    tokens = text.tokens_fields(*[C(f) for f in _PIG_FIELDS])
    return view(spark, sf, "entity").select("entity_id", F.array_join(F.sort_array(tokens), " ").alias("tokens"))


@query("distinct_tokens", with_views("entity") + f"SELECT DISTINCT entity_id, unnest({_PIG}) AS token FROM entity")
def distinct_tokens(spark, sf):
    return index.record_tokens(view(spark, sf, "entity"), "entity_id", text.tokens_fields(*[C(f) for f in _PIG_FIELDS]))


# ---- index ---------------------------------------------------------------------------------------

_PAIRS = f"SELECT doc_id, unnest({TOKENS_INDEX}) AS token FROM documents"


def document_tokens(spark, sf):
    return tokens_index(spark, sf).live().select(C("pk").alias("doc_id"), "token")


@query("inverted_index", f"""
SELECT token, CAST(0 AS INT) AS part, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY doc_id) AS record_ids, count(*) AS frequency, false AS long_list
FROM ({_PAIRS}) GROUP BY token""")
def inverted_index(spark, sf):
    out = index.inverted_index(document_tokens(spark, sf), "doc_id")
    return out.withColumn("record_ids", F.array_join(C("record_ids").cast("array<string>"), ","))


@query("index_alpha_partitions", f"""
SELECT CASE WHEN substr(token, 1, 1) BETWEEN 'a' AND 'z' THEN substr(token, 1, 1) ELSE 'other' END AS letter, count(*) AS postings,
       count(DISTINCT token) AS tokens FROM ({_PAIRS}) GROUP BY 1""")
def index_alpha_partitions(spark, sf):
    path = fresh_dir(spark, "alpha")
    index.write_alpha_partitions(document_tokens(spark, sf), path)
    return (spark.read.parquet(path).groupBy("letter")
            .agg(F.count(F.lit(1)).alias("postings"), F.count_distinct("token").alias("tokens")))


@query("index_counters", f"""
SELECT (SELECT count(*) FROM documents) AS records, count(DISTINCT token) AS unique_tokens, CAST(0 AS BIGINT) AS long_lists FROM ({_PAIRS})""")
def index_counters(spark, sf):
    return index.index_counters(table(spark, sf, "documents"), "doc_id", text.tokens_index(C("text")))


@query("bulk_index", f"""WITH {POSTINGS}
SELECT 'rows' AS output, table_name, count(*) AS n FROM tokenised GROUP BY table_name
UNION ALL SELECT 'postings', table_name, count(*) FROM postings GROUP BY table_name
UNION ALL SELECT 'token_stats', table_name, count(DISTINCT token) FROM postings GROUP BY table_name""")
def bulk_index(spark, sf):
    base = fresh_dir(spark, "bulk")
    versions = union_all([
        table(spark, sf, t).select(F.lit(t).alias("table_name"), C(k).alias("pk"), F.to_json(F.struct("*")).alias("original_data"),
                                   F.expr(f"cast({GONE[t]} as tinyint)").alias("is_deleted")) for t, k in INDEXED.items()])
    versions.write.partitionBy("table_name").parquet(f"{base}/rows")
    # All tables are one union: their texts are split once, and one shuffle deals the postings of all.
    postings.write_batch(union_all([postings.row_postings(table(spark, sf, t), t, k) for t, k in INDEXED.items()]), f"{base}/postings", 0)
    whole = postings.PostingsIndex(spark, f"{base}/postings", 0)
    index.token_stats(whole.live()).write.parquet(f"{base}/token_stats")
    parts = {"rows": spark.read.parquet(f"{base}/rows"), "postings": whole.live(), "token_stats": spark.read.parquet(f"{base}/token_stats")}
    return union_all([df.groupBy("table_name").agg(F.count(F.lit(1)).alias("n")).withColumn("output", F.lit(part)) for part, df in parts.items()])


_UPKEEP = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS pk, unnest(list_distinct(list_filter({e}, lambda w: length(w) >= 2))) AS token FROM {t} WHERE NOT ({g})" for t, k, e, g in (
    ("part", "p_partkey", _TYPED["part"].replace("CAST(p_size AS VARCHAR)", "CAST(CASE WHEN p_size < 10 THEN p_size + 1000 ELSE p_size END AS VARCHAR)"), GONE["part"]),
    ("customer", "c_custkey", _TYPED["customer"].replace(_array("c_mktsegment"), f"CASE WHEN c_nationkey = 7 THEN ['moved', 'away'] ELSE {_array('c_mktsegment')} END"), GONE["customer"])))


@query("index_upkeep", f"SELECT table_name, token, count(*) AS records FROM ({_UPKEEP}) GROUP BY ALL")
def index_upkeep(spark, sf):
    """Token counts of an index that was built once and then kept up by two batches of changed and deleted rows."""
    path = fresh_dir(spark, "upkeep")
    keys = {t: INDEXED[t] for t in ("part", "customer")}
    part, customer = (table(spark, sf, t) for t in keys)
    now = {"part": part.withColumn("p_size", F.when(C("p_size") < 10, C("p_size") + 1000).otherwise(C("p_size"))),
           "customer": customer.withColumn("c_mktsegment", F.when(C("c_nationkey") == 7, "moved away").otherwise(C("c_mktsegment")))}
    postings.write_batch(union_all([postings.row_postings(df, t, keys[t]) for t, df in (("part", part), ("customer", customer))]), path, 0)
    changed = {"part": "p_size < 10 or p_size > 1000", "customer": "c_nationkey = 7"}
    old = [postings.row_postings(df.where(changed[t]), t, keys[t], sign=-1) for t, df in (("part", part), ("customer", customer))]
    new = [postings.row_postings(df.where(changed[t]), t, keys[t]) for t, df in now.items()]
    postings.write_batch(postings.changed_postings(old, new), path, 1)
    gone = [postings.row_postings(now[t].where("p_size between 46 and 999" if t == "part" else GONE[t]), t, keys[t], sign=-1) for t in keys]
    postings.write_batch(postings.changed_postings(gone, []), path, 2)
    return index.token_stats(postings.PostingsIndex(spark, path).live())


_ENTITY_COLS = {"part": ["p_name", "p_brand", "p_type"], "customer": ["c_name", "c_mktsegment"]}
_ENTITY_SQL = """
rows AS (SELECT 'customer' AS source_table, c_custkey AS row_id, 'person' AS entity_type, c_name AS entity_name, lower(concat_ws(' ', c_name, c_mktsegment)) AS txt FROM customer
 UNION ALL SELECT 'supplier', s_suppkey, 'company', s_name, lower(concat_ws(' ', s_name, CASE WHEN s_nationkey <> 0 THEN CAST(s_nationkey AS VARCHAR) END)) FROM supplier
 UNION ALL SELECT 'part', p_partkey, 'product', p_name, lower(concat_ws(' ', p_name, p_brand, p_type)) FROM part),
keyed AS (SELECT *, CAST('0x' || substr(md5(source_table || ':' || row_id), 1, 16) AS UBIGINT) AS entity_key FROM rows)"""


@query("entity_index", f"""WITH {_ENTITY_SQL}
SELECT token, CAST(0 AS INT) AS part, string_agg(CAST(entity_key AS VARCHAR), ',' ORDER BY entity_key) AS entity_keys, count(*) AS frequency,
  string_agg(DISTINCT entity_type, ',' ORDER BY entity_type) AS entity_types
FROM (SELECT entity_key, entity_type, unnest({tokens_words_sql('txt')}) AS token FROM keyed) GROUP BY token""")
def entity_index(spark, sf):
    kept, entities = stored_entities(spark, sf)
    pairs = kept.live().select("token", C("table_name").alias("entity_type"), postings.unsigned_key("pk").alias("entity_key"))
    lists = index.grouped_lists(pairs, ["token"], "entity_key")
    kinds = (pairs.groupBy("token").agg(F.array_join(F.sort_array(F.collect_set("entity_type")), ",").alias("entity_types")))
    return lists.join(kinds, "token").select("token", "part", F.array_join(C("items").cast("array<string>"), ",").alias("entity_keys"),
                                             "frequency", "entity_types")


@query("token_stats", f"WITH {POSTINGS} SELECT token, table_name, count(*) AS records FROM postings GROUP BY token, table_name")
def token_stats(spark, sf):
    return index.token_stats(rows_index(spark, sf, 0).live())


@query("token_bitmap", f"""WITH {POSTINGS}
SELECT token, table_name, pk // 64 AS word, count(*) AS ids FROM postings GROUP BY ALL""")
def token_bitmap(spark, sf):
    return index.token_bitmap(rows_index(spark, sf, 0).live()).select("token", "table_name", "word", F.bit_count("bits").cast("bigint").alias("ids"))


# ---- searches ------------------------------------------------------------------------------------


@query("postings_intersect", f"WITH {POSTINGS} SELECT table_name, pk FROM tokenised WHERE {has('red', 'economy')}")
def postings_intersect(spark, sf):
    return rows_index(spark, sf, 0).all_of(["red", "economy"])


@query("postings_intersect_lenient", f"WITH {POSTINGS} SELECT table_name, pk FROM tokenised WHERE {has('red', 'economy')}")
def postings_intersect_lenient(spark, sf):
    return rows_index(spark, sf, 0).all_known_of(["red", "nosuchtoken", "economy"])


@query("postings_lookup", f"WITH {POSTINGS} SELECT table_name, pk, label FROM tokenised WHERE {has('building')} AND NOT gone")
def postings_lookup(spark, sf):
    hits = rows_index(spark, sf).all_of(["building"])
    return source_rows(spark, sf).join(hits, ["table_name", "pk"]).select("table_name", "pk", "label")


def source_rows(spark, sf):
    return union_all([rows.withColumns({"table_name": F.lit(t), "pk": C(k)}).select("table_name", "pk", "label") for t, (rows, k) in labelled(spark, sf).items()])


def labelled(spark, sf):
    return {t: (table(spark, sf, t).select(k, C(LABELS[t]).alias("label")), k) for t, k in INDEXED.items()}


_ALL_TOKENS = f"""WITH {POSTINGS}, live AS (SELECT *, count(*) OVER (PARTITION BY table_name) AS table_hits, count(*) OVER () > 60 AS has_more FROM tokenised WHERE {has('en', 'the')} AND NOT gone)
SELECT CAST(global_id AS VARCHAR) AS global_id, table_name, pk, label, has_more, table_hits FROM live ORDER BY live.global_id DESC LIMIT 30 OFFSET 30"""


@query("search_all_tokens", _ALL_TOKENS)
def search_all_tokens(spark, sf):
    """Second page of live records with both words, and how many hits each record's table has in all."""
    terms, kept, tables = search.query_terms("The EN the"), rows_index(spark, sf), labelled(spark, sf)
    first = postings.search_page(kept, tables, terms, 30)
    page = postings.search_page(kept, tables, terms, 30, first.cursor)
    own = F.coalesce(*[F.when(C("table_name") == t, F.lit(n)) for t, n in page.hits.items()])
    return page.rows.select(C("global_id").cast("string").alias("global_id"), "table_name", F.coalesce(*INDEXED.values()).alias("pk"), "label",
                            F.lit(page.has_more).alias("has_more"), own.cast("bigint").alias("table_hits"))


@query("search_all_tokens_live", _ALL_TOKENS.replace(", table_hits FROM live", " FROM live"))
def search_all_tokens_live(spark, sf):
    return search_all_tokens(spark, sf).drop("table_hits")


@query("hits_by_table", f"WITH {POSTINGS} SELECT table_name, count(*) AS hits FROM tokenised WHERE {has('19')} GROUP BY table_name")
def hits_by_table(spark, sf):
    return search.hits_by_table(rows_index(spark, sf, 0).all_of(["19"]))


@query("search_three_layer", f"""WITH {_ENTITY_SQL}, hits AS (
  SELECT * FROM keyed WHERE list_contains({tokens_words_sql('txt')}, 'red') AND list_contains({tokens_words_sql('txt')}, 'standard'))
SELECT CAST(entity_key AS VARCHAR) AS entity_key, entity_type, entity_name, p.p_brand AS brand, (SELECT count(*) FROM hits) AS total
FROM hits JOIN part p ON p.p_partkey = row_id ORDER BY hits.entity_key LIMIT 40""")
def search_three_layer(spark, sf):
    found = three_layer(spark, sf, ["red", "standard", "zzzz"])
    return found.select(C("entity_key").cast("string").alias("entity_key"), "entity_type", "entity_name", "brand", "total")


def three_layer(spark, sf, terms):
    kept, entities = stored_entities(spark, sf)
    sources = {"part": (table(spark, sf, "part").select("p_partkey", C("p_brand").alias("brand")), "p_partkey"),
               "customer": (table(spark, sf, "customer").select("c_custkey", C("c_mktsegment").alias("segment")), "c_custkey"),
               "supplier": (table(spark, sf, "supplier").select("s_suppkey", C("s_nationkey").alias("nation")), "s_suppkey")}
    return postings.search_layers(kept, entities, sources, terms, 40)


@query("search_three_layer_customers", f"""WITH {_ENTITY_SQL}, hits AS (
  SELECT * FROM keyed WHERE list_contains({tokens_words_sql('txt')}, 'building'))
SELECT CAST(entity_key AS VARCHAR) AS entity_key, entity_type, entity_name, p.p_brand AS brand, c.c_mktsegment AS segment, (SELECT count(*) FROM hits) AS total
FROM hits LEFT JOIN part p ON source_table = 'part' AND p.p_partkey = row_id
  LEFT JOIN customer c ON source_table = 'customer' AND c.c_custkey = row_id ORDER BY hits.entity_key LIMIT 40""")
def search_three_layer_customers(spark, sf):
    found = three_layer(spark, sf, ["building", "zzzz"])
    return found.select(C("entity_key").cast("string").alias("entity_key"), "entity_type", "entity_name", "brand", "segment", "total")


@query("search_any_ranked", f"""
SELECT doc_id, len(list_intersect(tokens, ['the', 'that', 'her', 'with', 'ion'])) AS matched_terms
FROM (SELECT doc_id, {tokens_words_sql('text')} AS tokens FROM documents)
WHERE len(list_intersect(tokens, ['the', 'that', 'her', 'with', 'ion'])) > 0""")
def search_any_ranked(spark, sf):
    ranked = words_index(spark, sf).any_of(["the", "that", "her", "with", "ion"], ["pk"])
    return ranked.select(C("pk").alias("doc_id"), C("matched_terms").cast("bigint").alias("matched_terms"))


_REC = with_views("record")


@query("search_rows", _REC + """
SELECT id, name, (SELECT count(*) FROM record WHERE contains(lower(name), 'ring') OR contains(lower(category), 'ring') OR contains(lower(status), 'ring')) AS total_count,
  concat_ws(',', CASE WHEN contains(lower(name), 'ring') THEN 'name' END, CASE WHEN contains(lower(category), 'ring') THEN 'category' END,
    CASE WHEN contains(lower(status), 'ring') THEN 'status' END) AS matched_columns, 'general' AS query_type
FROM record WHERE contains(lower(name), 'ring') OR contains(lower(category), 'ring') OR contains(lower(status), 'ring') ORDER BY id LIMIT 25 OFFSET 5""")
def search_rows(spark, sf):
    found = search.search_rows(view(spark, sf, "record"), "id", "RING", 25, 5)
    return found.select("id", "name", "total_count", F.array_join("matched_columns", ",").alias("matched_columns"), "query_type")


def column_tables(spark, sf):
    keys = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "nation": "n_nationkey", "region": "r_regionkey"}
    return {t: (table(spark, sf, t), k) for t, k in keys.items()}


_CELLS = """cells AS (SELECT 'customer' AS table_name, 'c_name' AS column_name, CAST(c_custkey AS VARCHAR) AS pk, c_name AS value FROM customer
  UNION ALL SELECT 'customer', 'c_mktsegment', CAST(c_custkey AS VARCHAR), c_mktsegment FROM customer
  UNION ALL SELECT 'supplier', 's_name', CAST(s_suppkey AS VARCHAR), s_name FROM supplier
  UNION ALL SELECT 'part', 'p_name', CAST(p_partkey AS VARCHAR), p_name FROM part
  UNION ALL SELECT 'part', 'p_brand', CAST(p_partkey AS VARCHAR), p_brand FROM part
  UNION ALL SELECT 'part', 'p_type', CAST(p_partkey AS VARCHAR), p_type FROM part
  UNION ALL SELECT 'nation', 'n_name', CAST(n_nationkey AS VARCHAR), n_name FROM nation
  UNION ALL SELECT 'region', 'r_name', CAST(r_regionkey AS VARCHAR), r_name FROM region),
ranked AS (SELECT *, row_number() OVER (PARTITION BY table_name, column_name ORDER BY pk) AS n FROM cells WHERE contains(lower(value), 'er'))"""


@query("search_columns", f"WITH {_CELLS} SELECT table_name, column_name, pk, value FROM ranked WHERE n <= 5")
def search_columns(spark, sf):
    return search.search_columns(column_tables(spark, sf), "ER", 5).drop("position")


@query("search_sources", f"""WITH {_CELLS}
SELECT CASE WHEN table_name IN ('nation', 'region') THEN 'places' ELSE 'trade' END AS source, table_name, column_name, pk, value, 'general' AS query_type
FROM ranked WHERE n <= 20""")
def search_sources(spark, sf):
    tables = column_tables(spark, sf)
    places = {t: v for t, v in tables.items() if t in ("nation", "region")}
    trade = {t: v for t, v in tables.items() if t not in places}
    return search.search_sources({"places": places, "trade": trade}, "er", search.MAX_PER_COLUMN).drop("position")


@query("top_n_per_column", with_views("people") + """
SELECT source_table, nationkey, id, name, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY source_table, nationkey ORDER BY id) AS INT) AS position FROM people)
WHERE position <= 5""")
def top_n_per_column(spark, sf):
    return paging.top_per_group(view(spark, sf, "people"), ["source_table", "nationkey"], [("id", "asc")], 5)


_DUPS = """, firsts AS (SELECT id_type, id_number, arg_min(issuing_country, id) AS first_source, min(id) AS first_id FROM anchor GROUP BY id_type, id_number)
SELECT 'anchors' AS table_name, a.id AS pk, a.id > f.first_id AS has_ref,
  CASE WHEN a.id > f.first_id THEN 'duplicate_ref:' || f.first_source || '.' || a.id_type ELSE '' END AS tags
FROM (SELECT * FROM anchor WHERE id_type = 'en' ORDER BY id LIMIT 100) a JOIN firsts f ON a.id_type = f.id_type AND a.id_number = f.id_number"""


@query("search_global_dups", with_views("anchor") + _DUPS)
def search_global_dups(spark, sf):
    found = search.search_global_duplicates(duplicate_tables(spark, sf), "en", 200)
    return found.withColumn("tags", F.array_join("tags", ";"))


def duplicate_tables(spark, sf):
    anchors = anchors_with_duplicates(spark, sf).drop("tags")
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    return {"anchors": (anchors, "id"), "parts": (parts, "p_partkey")}


@query("search_global_dups_by_table", with_views("anchor") + f"""SELECT table_name, string_agg(pk || ':' || tags, ',' ORDER BY pk) AS results, count(*) AS total_results
FROM ({_DUPS.replace(", firsts AS", "WITH firsts AS")}) GROUP BY table_name""")
def search_global_dups_by_table(spark, sf):
    found = search.search_global_duplicates(duplicate_tables(spark, sf), "en", 200)
    grouped = search.global_duplicates_by_table(found.withColumn("tags", F.array_join("tags", ";")))
    named = F.transform("results", lambda r: F.concat_ws(":", r["pk"].cast("string"), r["tags"]))
    return grouped.withColumn("results", F.array_join(named, ","))


@query("search_global_dup_refs", with_views("anchor") + f"""SELECT DISTINCT split_part(substr(tags, 15), '.', 1) AS ref_database,
  split_part(substr(tags, 15), '.', 2) AS ref_table, 'duplicate' AS ref_type
FROM ({_DUPS.replace(", firsts AS", "WITH firsts AS")}) WHERE has_ref""")
def search_global_dup_refs(spark, sf):
    return search.global_duplicate_refs(duplicate_tables(spark, sf), "en", 200)


_FT_FIELDS = ["first_name", "last_name", "primary_email", "primary_phone", "city", "country"]
_FT = "list_concat(" + ", ".join(
    f"list_filter(regexp_split_to_array(lower(regexp_replace({f}, '[@.#,;:]', ' ', 'g')), '\\s+'), lambda w: w <> '')" for f in _FT_FIELDS) + ")"


@query("fulltext_rank", with_views("entity") + f"""
SELECT entity_id, round(m / (m + 1.0), 6) AS rank FROM (SELECT entity_id, len(list_filter({_FT}, lambda w: w IN ('asia', 'customer'))) AS m
  FROM entity WHERE list_contains({_FT}, 'asia') AND list_contains({_FT}, 'customer'))""")
def fulltext_rank(spark, sf):
    found = search.fulltext_rank(view(spark, sf, "entity"), _FT_FIELDS, "Asia customer")
    return found.orderBy(F.desc("rank"), F.desc("entity_id")).select("entity_id", F.round("rank", 6).alias("rank"))


@query("cross_source_match", with_views("anchor") + """
SELECT sha256(id_number) AS hash, CAST(sum(n) AS BIGINT) AS matches, string_agg(issuing_country || '=' || n, ',' ORDER BY issuing_country) AS sources,
  count(*) > 1 AS has_duplicates FROM (SELECT id_number, issuing_country, count(*) AS n FROM anchor GROUP BY ALL) GROUP BY id_number""")
def cross_source_match(spark, sf):
    a = view(spark, sf, "anchor").select(identity.id_hash(C("id_number"), fold=lambda c: c).alias("hash"), "issuing_country")
    counted = F.transform("sources", lambda s: F.concat_ws("=", s["source"], s["matches"].cast("string")))
    return search.cross_source_match(a, "hash", "issuing_country").withColumn("sources", F.array_join(counted, ","))
