"""From raw documents to packed training sequences: toxicity, near duplicates, secrets, source mix, packing.

Each stage takes ``(spark, docs, sf_dir)`` and works on everything its predecessor kept; all but the last return the columns of
``documents``. Null texts count as empty in every stage; repeated rows and clashing extra columns are kept as they are; an
empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from casegrain.llm import bagminhash, mixing, packing, secrets, toxicity
from casegrain.session import stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below the threshold, by a model of the labelled ones that are not held out."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(toxicity.training_rows(docs, labels))
    return toxicity.scored(docs.select(*COLUMNS), model).where("toxic_predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class: the one with the smallest id (null last), then the smallest hash of its text;
    of rows equal in id and text the first by source, lang and n_chars."""
    classes = bagminhash.near_duplicates(docs.select("doc_id", "text"))
    lead = F.min(F.struct(F.col("doc_id").isNull().alias("null"), "doc_id", "node"))
    kept = classes.groupBy("group").agg(lead.alias("lead")).select(
        F.col("lead.doc_id").alias("_id"), F.col("lead.node").alias("_node"))
    node = F.xxhash64(F.coalesce("text", F.lit("")))
    rows = docs.select(*COLUMNS, node.alias("_hash")).join(
        kept, (F.col("_hash") == F.col("_node")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    first = Window.partitionBy("_hash", "doc_id").orderBy("source", "lang", "n_chars")
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by its kind; ``n_chars`` counts the new text (null for a null text)."""
    automata = secrets.train(docs.select("text"))
    clean = secrets.redacted(secrets.scan(docs.select(*COLUMNS), automata))
    return clean.withColumn("n_chars", F.length("text").cast("bigint")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, in whole documents: one that is taken to half or more counts as taken.

    So a source ends within half of its one cut document from its target. Where that is the source's first document and would
    leave nothing, the document nearest to the target in words stands for the source.
    """
    docs = docs.select(*COLUMNS)
    mixed = mixing.mix(docs)
    if mixed is None:
        return docs
    counts = mixing.counted(docs, mixed).where("taken > 0").select(
        "source", "key", F.floor(F.col("taken") / F.col("size") + 0.5).alias("copies"))
    # The first document with words is the only one at 0; taken to less than half, it leaves its source without any.
    empty = mixed.rows.where("size > 0 and start = 0 and target > 0 and 2 * need < size").select("source_ix")
    nearest = F.min(F.struct(F.abs(F.col("size") - F.col("target")), "key", "source")).alias("near")
    stand_in = (mixed.rows.where("size > 0").join(empty, "source_ix").groupBy("source_ix").agg(nearest)
                .select("near.source", "near.key", F.lit(1).cast("bigint").alias("copies")))
    copies = (counts.unionByName(stand_in).groupBy("source", "key").agg(F.sum("copies").alias("copies")).where("copies > 0")
              .select(F.col("source").alias("_source"), F.col("key").alias("_key"), "copies"))
    keyed = docs.withColumn("_key", mixing.row_key())
    same = Window.partitionBy("_key", "source").orderBy("lang", "n_chars")
    return (keyed.join(copies, "_key").where(F.col("source").eqNullSafe(F.col("_source")))
            .withColumn("_n", F.row_number().over(same)).where("_n = 1")
            .withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes: sequence and offset, sequences of 2048 ids.

    The stages before have left little room in the executors, so workers remember fewer words than `op3` alone lets them.
    """
    return packing.pack(docs, packing.public_tokenizer(), remembered=50_000)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("source_mix", mix_sources),
    ("packing", pack_sequences),
]

#: The stages fit models and sign texts, which SQL cannot express; tests compare each with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
