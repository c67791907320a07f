"""Streaming sources, sinks and rollups. Every rollup is a function that serves batch and stream alike."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.types import StructType

from casegrain.streaming.cdc import BatchTable

JSON_LINE = r"^\{.*\}$"  # fixed value: lines that count as log records


def run_available(writer: DataStreamWriter, checkpoint: str) -> None:
    """Process everything there is, in as many batches as the source's limits make, then stop."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def table_stream(spark: SparkSession, path: str, schema: StructType, **options: str) -> DataFrame:
    """New parquet files of a table as a stream. A pattern, unlike a plain path, may name one file as well as a folder."""
    return spark.readStream.schema(schema).options(**options).parquet(f"{path[:-1]}[{path[-1]}]")


def log_stream(spark: SparkSession, folder: str, **options: str) -> DataFrame:
    """Lines of growing log folders with the file they come from and the time they were read."""
    return (spark.readStream.options(**options).text(folder)
            .select("value", F.col("_metadata.file_path").alias("source_file"), F.current_timestamp().alias("ingested_at")))


def json_lines(lines: DataFrame, schema: StructType | str) -> DataFrame:
    """Only lines that are one JSON object, parsed; banners and cut lines are dropped."""
    return (lines.where(F.trim("value").rlike(JSON_LINE))
            .withColumn("record", F.from_json("value", schema))
            .where(F.col("record").isNotNull())
            .select("record.*", "source_file", "ingested_at"))


def audit_stream(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Audit lines from their own folder: the fields named by the pattern's groups plus the ingest time."""
    lines = log_stream(spark, folder)
    fields = F.regexp_extract_all("value", F.lit(pattern), F.lit(0))
    return lines.where(F.size(fields) > 0)


def time_parts(df: DataFrame, at: str) -> DataFrame:
    """Directory columns of a time, rounded down to five minutes before."""
    slot = F.window(F.col(at), "5 minutes").getField("start")
    return (df.withColumn("slot", slot)
            .withColumns({"year": F.date_format("slot", "yyyy"), "month": F.date_format("slot", "MM"),
                          "day": F.date_format("slot", "dd"), "hour": F.date_format("slot", "HH")}))


def time_bucketed_sink(df: DataFrame, at: str, path: str, rows_per_file: int = 1_000_000, daily: bool = False) -> DataStreamWriter:
    """Gzip JSON under year/month/day and, unless ``daily``, hour. Files roll by trigger interval and by size in rows."""
    folders = ["year", "month", "day"] if daily else ["year", "month", "day", "hour"]
    return (time_parts(df, at).writeStream.format("json").outputMode("append")
            .partitionBy(*folders).option("compression", "gzip")
            .option("maxRecordsPerFile", rows_per_file).option("path", path))


def drop_folder_stream(spark: SparkSession, folder: str, archive: str, schema: StructType | str) -> DataFrame:
    """Files dropped into a folder, each once; those done are moved to the archive."""
    return (spark.readStream.schema(schema).option("cleanSource", "archive").option("sourceArchiveDir", archive)
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(folder))


FILE_FIELDS = {"file": "file_path", "file_size": "file_size", "file_time": "file_modification_time"}


def filed_stream(spark: SparkSession, folder: str, schema: StructType | str, **options: str) -> DataFrame:
    """Records of JSON files dropped into a folder, each with its file's path, size and time; what cannot be read is in ``_corrupt_record``."""
    lines = (spark.readStream.schema(schema).options(**options).option("mode", "PERMISSIVE")
             .option("columnNameOfCorruptRecord", "_corrupt_record").json(folder))
    return lines.select("*", *[F.col(f"_metadata.{field}").alias(name) for name, field in FILE_FIELDS.items()])


def filed_batch(target: BatchTable, ledger: BatchTable):
    """``foreachBatch`` function: load the files that can be read whole, and enter every file into the ledger.

    A file with a record that cannot be read is failed, with its first such record as reason, and none of its rows are loaded. Files
    stay where they are until `settle_files`, for a batch may run again.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        bad = F.col("_corrupt_record").isNotNull()
        outcome = (batch.groupBy(*FILE_FIELDS).agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("bad"), F.min("_corrupt_record").alias("first"))
                   .select(*FILE_FIELDS, "rows", F.when(F.col("bad") > 0, "failed").otherwise("done").alias("status"),
                           F.when(F.col("bad") > 0, F.concat(F.lit("cannot be read: "), F.substring("first", 1, 200))).alias("reason")))
        ledger.append(outcome, batch_id)
        failed = ledger.batches().where((F.col("batch_id") == batch_id) & (F.col("status") == "failed"))
        target.append(batch.join(failed.select("file"), "file", "left_anti").drop("_corrupt_record", *FILE_FIELDS), batch_id)
        batch.unpersist()

    return write


def settle_files(ledger: BatchTable, folder: str, archive: str, errors: str) -> DataFrame:
    """Move the files that finished batches have entered: done ones to the archive, failed ones to the error folder.

    Only files still in the folder are looked at, so it may run at any time and again. Returns the ledger: one row per path, size and
    time, with status and reason.
    """
    spark = ledger.spark
    entries = ledger.versions()
    there = spark.read.format("binaryFile").load(folder).select(F.col("path").alias("file")) if _exists(spark, folder) else None
    if there is not None:
        due = entries.join(there, "file").select("file", "status").distinct()
        for r in due.toLocalIterator():  # names of files in the drop folder
            _move(spark, r["file"], errors if r["status"] == "failed" else archive)
    return entries


def _exists(spark: SparkSession, folder: str) -> bool:
    """Whether there are files in a folder."""
    found = spark._jvm.org.apache.hadoop.fs.Path(folder, "[!._]*")
    return bool(found.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(found))


def _move(spark: SparkSession, file: str, folder: str) -> None:
    """Move one file; the file system does it, no data passes through here."""
    paths = spark._jvm.org.apache.hadoop.fs.Path
    source, target = paths(file), paths(folder)
    files = source.getFileSystem(spark._jsc.hadoopConfiguration())
    files.mkdirs(target)
    files.rename(source, paths(target, source.getName()))


def rate_windows(log: DataFrame, at: str, who: str, endpoint: str, length: str = "1 minute", limit: int = 60) -> DataFrame:
    """Requests per caller, endpoint and fixed window, and whether they exceed the limit."""
    return (log.groupBy(F.window(at, length).alias("window"), who, endpoint)
            .agg(F.count(F.lit(1)).alias("requests"))
            .select(F.col("window.start").alias("window_start"), who, endpoint, "requests", (F.col("requests") > limit).alias("over_limit")))


def access_log_rollup(log: DataFrame, at: str, who: str, action: str, length: str = "1 hour") -> DataFrame:
    """Accesses per user and action in windows of time."""
    return (log.groupBy(F.window(at, length).alias("window"), who, action).agg(F.count(F.lit(1)).alias("accesses"))
            .select(F.col("window.start").alias("window_start"), who, action, "accesses"))


def partial_batch(store: BatchTable, counts):
    """``foreachBatch`` function: append what ``counts(batch)`` finds in this batch alone. However late a row is, it counts."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(counts(batch), batch_id)

    return write


def summed(store: BatchTable, keys: list[str], count: str, limit: int | None = None) -> DataFrame:
    """Groups with the counts of all batches added up, and whether they exceed the limit where one is given."""
    out = store.versions().groupBy(*keys).agg(F.sum(count).alias(count))
    return out if limit is None else out.withColumn("over_limit", F.col(count) > limit)


def once_batch(store: BatchTable, key: str):
    """``foreachBatch`` function: append each event of the batch once."""
    def write(batch: DataFrame, batch_id: int) -> None:
        store.append(batch.dropDuplicates([key]), batch_id)

    return write


def once(store: BatchTable, key: str) -> DataFrame:
    """Every event once, whichever batches delivered it and however late."""
    return store.versions().dropDuplicates([key])


def counter_batch(store: BatchTable, group: Column):
    """``foreachBatch`` function: rows per group of the batch, for a live status."""
    def write(batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(group.alias("unit")).agg(F.count(F.lit(1)).alias("rows"), F.current_timestamp().alias("at"))
        store.append(counts.withColumn("batch", F.lit(batch_id)), batch_id)

    return write
