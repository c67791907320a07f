"""Change data: newest versions, full and incremental synchronisation, applying events, batch and stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F
from pyspark.sql.types import StructType

from casegrain.operators.filters import typed_literal
from casegrain.operators.index import merge_bitmaps, token_bitmap

POLL_ROWS = 1000  # fixed value: changes taken per table and poll
TRIES = 3  # fixed value: attempts before rows count as dead letters


def latest_version(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Newest row of every key: highest in the first column of ``order``, among those in the next, and so on.

    Only the key and the order columns are aggregated, by maxima of plain values in hash aggregates with partial results before their
    shuffles; whole rows are neither sorted nor compared, a semi join picks them. A busy key is spread until the last step, which has
    one row per value of the first order column and task. Of rows that are equal in all order columns the one with the highest hash
    of its columns stays, and rows that are equal throughout are one. Null is oldest.
    """
    steps = [f"_o{i}" for i in range(len(order) + 1)]
    values = [F.col(key).alias("_key"), *[F.col(c).alias(s) for c, s in zip(order, steps)], F.xxhash64(*df.columns).alias(steps[-1])]
    slim = df.select(*values)
    for i in reversed(range(len(steps))):
        last = steps[i]
        after = [F.coalesce(F.max_by(s, last), F.max(F.when(F.col(last).isNull(), F.col(s)))).alias(s) for s in steps[i + 1:]]
        slim = slim.groupBy("_key", *steps[:i]).agg(F.max(last).alias(last), *after)
    same = F.col("_key").eqNullSafe(F.col(key))
    for c, s in zip([F.col(c) for c in order] + [F.xxhash64(*df.columns)], steps):
        same = same & c.eqNullSafe(F.col(s))
    return df.join(slim, same, "left_semi").distinct()


def live_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """Newest version of every key without those that are tombstones."""
    return latest_version(df, key, order).where(F.col("is_deleted") == 0)


def as_versions(events: DataFrame) -> DataFrame:
    """INSERT, UPDATE and DELETE events as row versions; a DELETE is a tombstone."""
    return events.withColumn("is_deleted", (F.col("op") == "DELETE").cast("tinyint"))


def apply_changes(base: DataFrame, events: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """State after the events, last writer per key wins, tombstones kept. Repeated events change nothing."""
    return latest_version(base.unionByName(as_versions(events), allowMissingColumns=True), key, order)


def high_water_mark(df: DataFrame, key: str) -> int:
    return df.agg(F.coalesce(F.max(key), F.lit(0))).head()[0]


def initial_sync(df: DataFrame, target: str, key: str, after: int | None = None) -> int:
    """Copy the rows beyond ``after`` and return the target's highest key, which parquet keeps in its footers.

    The source is read in its own splits (a database in key ranges), so nothing is shuffled. Run again with the returned mark after an interruption; it copies only what is missing.
    """
    rows = df if after is None else df.where(F.col(key) > after)
    rows.write.mode("append").parquet(target)
    return high_water_mark(df.sparkSession.read.parquet(target), key)


def incremental_sync(df: DataFrame, key: str, after: int, limit: int) -> DataFrame:
    """The next ``limit`` rows after the mark, in key order."""
    return df.where(F.col(key) > after).orderBy(key).limit(limit)


def poll_changes(df: DataFrame, at: Column, changed: str, tie: str, seconds: int = 10, limit: int = POLL_ROWS,
                 after: tuple | None = None) -> DataFrame:
    """Rows changed in the last ``seconds`` before ``at``, oldest first, at most ``limit``. Applying rows twice is harmless.

    ``after`` is the (changed, tie) of the last row of the poll before; with it, a window of more than ``limit`` rows comes in
    several polls and nothing is lost.
    """
    due = df.where((F.col(changed) > at - F.make_dt_interval(secs=F.lit(seconds))) & (F.col(changed) <= at))
    if after is not None:
        time, last = (typed_literal(v, df.schema[c].dataType) for v, c in zip(after, (changed, tie)))
        due = due.where((F.col(changed) > time) | ((F.col(changed) == time) & (F.col(tie) > last)))
    return due.orderBy(changed, tie).limit(limit)


def poll_all(df: DataFrame, at: Column, changed: str, tie: str, target: str, seconds: int = 10, limit: int = POLL_ROWS) -> DataFrame:
    """All rows of the window, polled ``limit`` at a time and appended to ``target``; the cursor is one row per poll."""
    after, rows = None, df.sparkSession.read.schema(df.schema)
    while True:
        page = poll_changes(df, at, changed, tie, seconds, limit, after)
        seen = Observation()
        (page.observe(seen, F.count(F.lit(1)).alias("n"), F.max(F.struct(changed, tie)).alias("last"))
         .write.mode("append").parquet(target))
        if seen.get["n"] < limit:
            return rows.parquet(target)
        after = tuple(seen.get["last"])


def sync_stats(df: DataFrame, name: str, key: str, changed: str, live: Column, synced_until: Column) -> DataFrame:
    """Live rows, highest key, last change and rows changed since the last sync."""
    return df.agg(F.count_if(live).alias("live_rows"), F.coalesce(F.max(key), F.lit(0)).alias("max_key"),
                  F.max(changed).cast("string").alias("last_sync"),
                  F.count_if(F.col(changed) > synced_until).alias("behind")).withColumn("table_name", F.lit(name))


def split_valid(events: DataFrame, valid: Column) -> tuple[DataFrame, DataFrame]:
    """(events that can be applied, events that cannot); an unknown outcome counts as invalid."""
    ok = F.coalesce(valid, F.lit(False))
    return events.where(ok), events.where(~ok)


def dead_letters(bad: DataFrame, table: str, key: str, error: str, attempts: int = 1) -> DataFrame:
    """One row per batch and table for the error table: key range, error, and the first row as a sample."""
    payload = F.to_json(F.struct("*"))
    return (bad.agg(F.min(key).alias("min_id"), F.max(key).alias("max_id"), F.count(F.lit(1)).alias("rows"),
                    F.min_by(payload, key).alias("sample"))
            .where(F.col("rows") > 0)
            .withColumns({"table_name": F.lit(table), "error": F.lit(error), "attempts": F.lit(attempts)}))


class BatchTable:
    """A Parquet folder partitioned by ``batch_id``, to which a stream appends what it makes of each micro-batch.

    A batch that runs again overwrites its own partition and no other; Spark's writers show a partition when it is complete, and
    its readers list what is there. What the batches hold is merged when read, so no batch rewrites older state. ``schema`` is
    what a table without any batch reads as. ``folded`` is an ordinary job that writes the merged rows as a new table, for which
    the stream is started again.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str | StructType | None = None):
        self.spark, self.path = spark, path
        if schema is not None:
            self.append(spark.createDataFrame([], schema), -1)

    def append(self, batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{self.path}/batch_id={batch_id}")

    def batches(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def versions(self) -> DataFrame:
        """The rows of all batches."""
        return self.batches().drop("batch_id")

    def folded(self, path: str, merge) -> BatchTable:
        """A new table with ``merge(versions)`` in place of all batches so far; later batches have higher numbers."""
        last = self.batches().agg(F.max("batch_id")).head()[0]
        new = BatchTable(self.spark, path)
        new.append(merge(self.versions()), -1 if last is None else last)
        return new


def upsert_batch(table: BatchTable, key: str, order: Sequence[str]):
    """``foreachBatch`` function: reduce the batch to the newest event per key and append it."""
    def write(batch: DataFrame, batch_id: int) -> None:
        table.append(latest_version(as_versions(batch), key, order), batch_id)

    return write


def dead_letter_batch(good: BatchTable, errors: BatchTable, valid: Column, table: str, key: str, row_id: str,
                      order: Sequence[str], error: str, tries: int = TRIES, apply=None):
    """``foreachBatch`` function: apply what is valid by ``key``, describe the rest by ``row_id`` in the error table.

    ``apply(rows, batch_id)``, by default an append to ``good``, is tried up to ``tries`` times. Rows that it cannot take even then
    go to the error table with that many attempts and the last error, and the stream goes on; invalid rows are not tried again.
    """
    apply = apply or good.append

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        ok, bad = split_valid(batch, valid)
        letters = dead_letters(bad, table, row_id, error)
        for attempt in range(1, tries + 1):
            try:
                apply(latest_version(as_versions(ok), key, order), batch_id)
                break
            except Exception as failure:  # whatever the target cannot take
                if attempt == tries:
                    letters = letters.unionByName(dead_letters(ok, table, row_id, str(failure).splitlines()[0][:200], attempt))
        errors.append(letters, batch_id)
        batch.unpersist()

    return write


def bitmap_batch(table: BatchTable):
    """``foreachBatch`` function: bitmaps of the batch's (token, table_name, pk), merged when read."""
    def write(batch: DataFrame, batch_id: int) -> None:
        table.append(token_bitmap(batch), batch_id)

    return write


def stored_bitmaps(table: BatchTable) -> DataFrame:
    return merge_bitmaps(table.versions())


def token_ttl(tokens: DataFrame, updated: str, now: Column, days: int = 3) -> DataFrame:
    """Token rows touched within the last ``days``."""
    return tokens.where(F.col(updated) >= now - F.make_dt_interval(days=F.lit(days)))
