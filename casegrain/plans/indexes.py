"""The indexes that searches read: built from the tables once per session and folder, in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from casegrain.functions import text
from casegrain.operators import index, postings
from casegrain.operators.postings import PostingsIndex
from casegrain.operators.warehouse import union_all
from casegrain.plans.views import table
from casegrain.session import fresh_dir

C = F.col
INDEXED = {"part": "p_partkey", "customer": "c_custkey", "documents": "doc_id"}
GONE = {"part": "p_size > 45", "customer": "c_acctbal < 0", "documents": "n_chars < 100"}  # rows treated as deleted


def built(spark: SparkSession, sf: str, kind: str) -> str:
    """The path of an index, made at first use. Another session, or another folder of tables, has its own."""
    known = vars(spark.sparkContext).setdefault("_casegrain_indexes", {})
    if (sf, kind) not in known:
        path = fresh_dir(spark, f"index-{kind}")
        BUILDERS[kind](spark, sf, path)
        known[sf, kind] = path
    return known[sf, kind]


def _rows(spark, sf, path):
    """All columns of three tables by type; a second batch takes the rows treated as deleted out again."""
    whole = [postings.row_postings(table(spark, sf, t), t, k) for t, k in INDEXED.items()]
    postings.write_batch(union_all(whole), path, 0)
    gone = [postings.row_postings(table(spark, sf, t).where(GONE[t]), t, k, sign=-1) for t, k in INDEXED.items()]
    postings.write_batch(union_all(gone), path, 1)


def _document_words(spark, sf, path):
    postings.write_batch(postings.row_postings(table(spark, sf, "documents"), "documents", "doc_id", text.tokens_words(C("text"))), path, 0)


def _document_tokens(spark, sf, path):
    postings.write_batch(postings.row_postings(table(spark, sf, "documents"), "documents", "doc_id", text.tokens_index(C("text"))), path, 0)


def _entities(spark, sf, path):
    """Two layers: rows of entities by key, and their tokens."""
    rows = entity_layer(spark, sf).withColumn("pk", postings.signed_key(C("entity_key")))
    rows.repartitionByRange("pk").sortWithinPartitions("pk").write.parquet(f"{path}/rows")
    rows = spark.read.parquet(f"{path}/rows")
    tokens = rows.select(F.explode(text.tokens_words(C("searchable_text"))).alias("token"), C("entity_type").alias("table_name"), "pk",
                         F.lit(1).cast("tinyint").alias("sign"))
    postings.write_batch(tokens, f"{path}/postings", 0)


BUILDERS = {"rows": _rows, "document-words": _document_words, "document-tokens": _document_tokens, "entities": _entities}


def entity_layer(spark, sf) -> DataFrame:
    c = table(spark, sf, "customer").select(C("c_custkey").alias("id"), C("c_name").alias("first_name"), C("c_mktsegment").alias("segment"))
    s = table(spark, sf, "supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("company_name"), C("s_nationkey").alias("nation"))
    p = table(spark, sf, "part").select(C("p_partkey").alias("id"), C("p_name").alias("product_name"), C("p_brand").alias("brand"), C("p_type").alias("type"))
    return union_all([index.entity_rows(df, name, "id") for name, df in (("customer", c), ("supplier", s), ("part", p))])


def rows_index(spark, sf, upto: int | None = None) -> PostingsIndex:
    """Tokens of part, customer and documents; as of batch 0 with the rows treated as deleted, else without them."""
    return PostingsIndex(spark, built(spark, sf, "rows"), upto)


def words_index(spark, sf) -> PostingsIndex:
    return PostingsIndex(spark, built(spark, sf, "document-words"), 0)


def tokens_index(spark, sf) -> PostingsIndex:
    return PostingsIndex(spark, built(spark, sf, "document-tokens"), 0)


def entity_index(spark, sf) -> tuple[PostingsIndex, DataFrame]:
    path = built(spark, sf, "entities")
    return PostingsIndex(spark, f"{path}/postings", 0), spark.read.parquet(f"{path}/rows")
