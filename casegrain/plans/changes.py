"""Change data, table upkeep and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain.operators import tags as tagging
from casegrain.operators.index import bitmap_sizes
from casegrain.operators.warehouse import union_all
from casegrain.functions import text
from casegrain.plans.files import write_event_lines
from casegrain.plans.registry import query
from casegrain.plans.views import table, view, with_views
from casegrain.session import fresh_dir, spread
from casegrain.streaming import cdc, maintain, streams

C = F.col
ORDER = ["updated_at", "event_id"]


def event_stream(spark, sf):
    path = f"{sf}/events.parquet"
    return streams.table_stream(spark, path, table(spark, sf, "events").schema, maxFilesPerTrigger="64")


def change_stream(spark, sf):
    op = F.when(C("event_type") == "signup", "INSERT").when(C("event_type") == "error", "DELETE").otherwise("UPDATE")
    return event_stream(spark, sf).select("event_id", C("user_id").alias("pk"), op.alias("op"), "value", C("ts").alias("updated_at"))


# ---- batch ---------------------------------------------------------------------------------------

_NEWEST = """newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY pk ORDER BY updated_at DESC, event_id DESC) AS rn FROM change_log) WHERE rn = 1)"""
_VERSION_COLS = "pk, event_id, value, CAST(updated_at AS VARCHAR) AS updated_at"


def versions_out(df, *extra):
    return df.select("pk", "event_id", "value", C("updated_at").cast("string").alias("updated_at"), *extra)


@query("latest_version", with_views("change_log") + f", {_NEWEST} SELECT {_VERSION_COLS} FROM newest WHERE op <> 'DELETE'")
def latest_version(spark, sf):
    return versions_out(cdc.live_rows(cdc.as_versions(view(spark, sf, "change_log")), "pk", ORDER))


def _halves(spark, sf):
    log = view(spark, sf, "change_log")
    middle = log.agg(F.expr("(min(event_id) + max(event_id)) div 2")).scalar()
    return log.where(C("event_id") <= middle), log.where(C("event_id") > middle)


@query("apply_changes", with_views("change_log") + f", {_NEWEST} SELECT {_VERSION_COLS}, op = 'DELETE' AS deleted FROM newest")
def apply_changes(spark, sf):
    first, rest = _halves(spark, sf)
    base = cdc.latest_version(cdc.as_versions(first), "pk", ORDER)
    return versions_out(cdc.apply_changes(base, rest, "pk", ORDER), (C("is_deleted") == 1).alias("deleted"))


@query("initial_sync", """
SELECT o_orderstatus, count(*) AS n, CAST(sum(o_orderkey) AS BIGINT) AS keys, (SELECT max(o_orderkey) FROM orders) AS mark FROM orders GROUP BY 1""")
def initial_sync(spark, sf):
    target = fresh_dir(spark, "sync")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    half = orders.agg(F.expr("max(o_orderkey) div 2")).head()[0]
    mark = cdc.initial_sync(orders.where(C("o_orderkey") <= half), target, "o_orderkey")  # interrupted half way
    mark = cdc.initial_sync(orders, target, "o_orderkey", mark)
    return (spark.read.parquet(target).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.sum("o_orderkey").alias("keys"))
            .withColumn("mark", F.lit(mark).cast("bigint")))


@query("incremental_sync", """
SELECT o_orderkey, o_custkey, (SELECT max(o_orderkey) FROM (SELECT o_orderkey FROM orders WHERE o_orderkey > 1000 ORDER BY 1 LIMIT 500)) AS next_mark
FROM orders WHERE o_orderkey > 1000 ORDER BY o_orderkey LIMIT 500""")
def incremental_sync(spark, sf):
    batch = cdc.incremental_sync(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_orderkey", 1000, 500)
    return batch.withColumn("next_mark", batch.agg(F.max("o_orderkey")).scalar())


@query("poll_changes", with_views("change_log") + f"""
SELECT {_VERSION_COLS}, op FROM change_log WHERE updated_at > TIMESTAMP '2024-01-10 12:00:00' - INTERVAL 6 HOURS AND updated_at <= TIMESTAMP '2024-01-10 12:00:00'""")
def poll_changes(spark, sf):
    at = F.lit("2024-01-10 12:00:00").cast("timestamp_ntz")
    polled = cdc.poll_all(view(spark, sf, "change_log"), at, "updated_at", "event_id", fresh_dir(spark, "polled"), seconds=6 * 3600)
    return versions_out(polled, "op")


_DOC_TOKENS = "SELECT unnest(list_distinct(list_filter(regexp_split_to_array(lower(text), '[\\s\\p{Z}]+'), lambda w: length(w) >= 2))) AS token, doc_id FROM documents"


@query("token_ttl", f"""
WITH t AS (SELECT d.token, max(e.ts) AS updated_at FROM ({_DOC_TOKENS}) d JOIN events e ON e.event_id = d.doc_id GROUP BY d.token)
SELECT token, CAST(updated_at AS VARCHAR) AS updated_at FROM t WHERE updated_at >= TIMESTAMP '2024-01-05' - INTERVAL 3 DAYS""")
def token_ttl(spark, sf):
    tokens = table(spark, sf, "documents").select(
        C("doc_id").alias("event_id"),
        F.explode(F.array_distinct(F.filter(text.split_words(C("text")), lambda w: F.length(w) >= 2))).alias("token"))
    seen = tokens.join(table(spark, sf, "events").select("event_id", "ts"), "event_id").groupBy("token").agg(F.max("ts").alias("updated_at"))
    kept = cdc.token_ttl(seen, "updated_at", F.lit("2024-01-05").cast("timestamp_ntz"))
    return kept.select("token", C("updated_at").cast("string").alias("updated_at"))


# ---- upkeep --------------------------------------------------------------------------------------


@query("patch_update", with_views("category", "entity") + """
SELECT e.entity_id, CASE WHEN p.o_orderstatus IS NOT NULL AND p.o_orderstatus <> 'P' THEN p.o_orderstatus ELSE e.status END AS status,
  coalesce(p.priority, e.city) AS city, CASE WHEN p.entity_id IS NULL THEN '2020-01-01' ELSE '1998-01-01' END AS updated_at
FROM entity e LEFT JOIN (SELECT o_custkey AS entity_id, arg_min(o_orderstatus, o_orderkey) AS o_orderstatus, arg_min(o_orderpriority, o_orderkey) AS priority
  FROM orders WHERE o_totalprice > 400000 GROUP BY 1) p ON p.entity_id = e.entity_id""")
def patch_update(spark, sf):
    base = view(spark, sf, "entity").select("entity_id", "status", "city").withColumn("updated_at", F.lit("2020-01-01"))
    patches = (table(spark, sf, "orders").where("o_totalprice > 400000").groupBy(C("o_custkey").alias("entity_id"))
               .agg(F.min_by("o_orderstatus", "o_orderkey").alias("status"), F.min_by("o_orderpriority", "o_orderkey").alias("city"))
               .withColumn("status", F.when(C("status") == "P", "").otherwise(C("status"))))
    return tagging.patch_update(base, patches, "entity_id", ["status", "city"], F.lit("1998-01-01"))


@query("soft_delete", with_views("bank") + """
SELECT id, is_active AND entity_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0) AS is_active FROM bank""")
def soft_delete(spark, sf):
    doomed = table(spark, sf, "customer").where("c_acctbal < 0").select(C("c_custkey").alias("entity_id"))
    return tagging.soft_delete(view(spark, sf, "bank"), doomed, "entity_id").select("id", "is_active")


@query("purge_expired", with_views("api_key", "access_log") + """
SELECT 'sessions' AS kind, count(*) FILTER (WHERE coalesce(expires_at < TIMESTAMP '1998-01-01', false) OR revoked) AS deleted,
  count(*) FILTER (WHERE NOT (coalesce(expires_at < TIMESTAMP '1998-01-01', false) OR revoked)) AS kept FROM api_key
UNION ALL SELECT 'rate_windows', count(*) FILTER (WHERE created_at < TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR), count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-01-15' - INTERVAL 1 HOUR) FROM access_log
UNION ALL SELECT 'audit', count(*) FILTER (WHERE created_at < TIMESTAMP '2024-04-10' - INTERVAL 90 DAYS), count(*) FILTER (WHERE created_at >= TIMESTAMP '2024-04-10' - INTERVAL 90 DAYS) FROM access_log""")
def purge_expired(spark, sf):
    def at(day):
        return F.lit(day).cast("timestamp_ntz")

    log = view(spark, sf, "access_log")
    jobs = {
        "sessions": (view(spark, sf, "api_key"), F.coalesce(C("expires_at") < at("1998-01-01"), F.lit(False)) | C("revoked")),
        "rate_windows": (log, C("created_at") < at("2024-01-15") - F.expr("INTERVAL 1 HOUR")),
        "audit": (log, C("created_at") < at("2024-04-10") - F.expr("INTERVAL 90 DAYS")),
    }
    out = []
    for kind, (df, expired) in jobs.items():
        kept, deleted = maintain.purge(df, expired)
        out.append(deleted.select(F.lit(kind).alias("kind"), "deleted").withColumn("kept", kept.agg(F.count(F.lit(1))).scalar()))
    return union_all(out)


@query("work_sessions", with_views("work_session") + """
SELECT session_id, user_id, CAST(started_at AS VARCHAR) AS started_at, CAST(ended_at AS VARCHAR) AS ended_at,
  CAST(date_diff('second', started_at, ended_at) AS VARCHAR) AS duration_seconds
FROM work_session""")
def work_sessions(spark, sf):
    opened = table(spark, sf, "orders").select(C("o_orderkey").alias("session_id"), C("o_custkey").alias("user_id"), F.lit("open").alias("kind"), C("o_orderdate").alias("at"))
    closed = (table(spark, sf, "lineitem").join(table(spark, sf, "orders").where("o_orderstatus <> 'P'"), C("l_orderkey") == C("o_orderkey"))
              .select(C("l_orderkey").alias("session_id"), C("o_custkey").alias("user_id"), F.lit("close").alias("kind"), C("l_shipdate").alias("at")))
    sessions = maintain.work_sessions(opened.unionByName(closed), "session_id", "user_id")
    return sessions.select("session_id", "user_id", C("started_at").cast("string").alias("started_at"), C("ended_at").cast("string").alias("ended_at"),
                         C("duration_seconds").cast("string").alias("duration_seconds"))


# ---- streams -------------------------------------------------------------------------------------

EVENT_SCHEMA = "event_id bigint, user_id bigint, event_type string, value double, props struct<k: int>"


@query("log_tail_stream", """
SELECT event_id, user_id, event_type, CAST(json_extract_string(props, '$.k') AS INT) AS k, true AS has_origin FROM events""")
def log_tail_stream(spark, sf):
    logs, out = fresh_dir(spark, "logs"), fresh_dir(spark, "parsed")
    write_event_lines(spark, sf, logs)
    parsed = streams.json_lines(streams.log_stream(spark, logs), EVENT_SCHEMA)
    streams.run_available(parsed.writeStream.format("parquet").option("path", out), fresh_dir(spark, "ckpt"))
    return spark.read.parquet(out).select("event_id", "user_id", "event_type", C("props.k").alias("k"),
                                          (C("source_file").isNotNull() & C("ingested_at").isNotNull()).alias("has_origin"))


@query("audit_stream", with_views("access_log") + """
SELECT action, count(*) AS lines, CAST(sum(user_id) AS BIGINT) AS users FROM access_log GROUP BY action""")
def audit_stream(spark, sf):
    logs, out = fresh_dir(spark, "audit"), fresh_dir(spark, "audit-out")
    a = view(spark, sf, "access_log")
    a.select(F.format_string("audit user=%d action=%s endpoint=%s", "user_id", "action", "endpoint").alias("value")).write.text(logs)
    pattern = r"user=(\d+) action=(\S+)"
    lines = streams.audit_stream(spark, logs, pattern)
    fields = lines.select(F.regexp_extract("value", pattern, 1).cast("bigint").alias("user_id"), F.regexp_extract("value", pattern, 2).alias("action"), "ingested_at")
    streams.run_available(streams.time_bucketed_sink(fields, "ingested_at", out, daily=True), fresh_dir(spark, "ckpt"))
    return (spark.read.schema("user_id bigint, action string, ingested_at timestamp, year string, month string, day string").json(out)
            .groupBy("action").agg(F.count(F.lit(1)).alias("lines"), F.sum("user_id").alias("users")))


@query("drop_folder_stream", "SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS events FROM events GROUP BY event_type")
def drop_folder_stream(spark, sf):
    incoming, archive, out, ckpt = (fresh_dir(spark, n) for n in ("drop", "archive", "dropped", "ckpt"))
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    for kinds in ("event_type IN ('click', 'view')", "event_type NOT IN ('click', 'view')"):  # files already there, then new ones
        events.where(kinds).write.mode("append").json(incoming)
        dropped = streams.drop_folder_stream(spark, incoming, archive, "event_id bigint, user_id bigint, event_type string, _corrupt_record string")
        streams.run_available(dropped.drop("_corrupt_record").writeStream.format("parquet").option("path", out), ckpt)
    return spark.read.parquet(out).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("events"))


@query("drop_folder_ledger", """
SELECT 'done' AS status, true AS moved, count(*) AS rows FROM events UNION ALL SELECT 'failed', true, count(*) FROM region UNION ALL SELECT 'loaded', true, count(*) FROM events""")
def drop_folder_ledger(spark, sf):
    """Files dropped in two rounds, a broken one among them: what was loaded, and where each file ended."""
    incoming, archive, errors = (fresh_dir(spark, n) for n in ("incoming", "archive", "errors"))
    target, ledger = cdc.BatchTable(spark, fresh_dir(spark, "loaded")), cdc.BatchTable(spark, fresh_dir(spark, "ledger"))
    events = table(spark, sf, "events").select("event_id", "user_id", "event_type")
    middle = events.agg(F.expr("(min(event_id) + max(event_id)) div 2")).scalar()
    broken = table(spark, sf, "region").select(F.concat(F.lit('{"event_id": '), "r_name").alias("value"))
    ckpt = fresh_dir(spark, "ckpt")
    for part in (events.where(C("event_id") <= middle), events.where(C("event_id") > middle)):
        part.write.mode("append").json(incoming)
        if broken is not None:
            broken.write.mode("append").text(incoming)
            broken = None
        dropped = streams.filed_stream(spark, incoming, "event_id bigint, user_id bigint, event_type string, _corrupt_record string")
        streams.run_available(dropped.writeStream.foreachBatch(streams.filed_batch(target, ledger)), ckpt)
        entries = streams.settle_files(ledger, incoming, archive, errors)
    name = lambda c: F.element_at(F.split(c, "/"), -1)
    ended = union_all([spark.read.format("binaryFile").load(folder).select(name("path").alias("name"), F.lit(status).alias("ended"))
                       for folder, status in ((archive, "done"), (errors, "failed"))])
    found = (entries.withColumn("name", name("file")).join(ended, "name", "left")
             .groupBy("status", F.col("status").eqNullSafe(F.col("ended")).alias("moved")).agg(F.sum("rows").alias("rows")))
    loaded = target.versions().agg(F.count(F.lit(1)).alias("rows")).select(F.lit("loaded").alias("status"), F.lit(True).alias("moved"), "rows")
    return found.unionByName(loaded)


@query("time_bucketed_sink", """
SELECT strftime(ts, '%Y-%m-%d-%H') AS hour_dir, count(*) AS events, CAST(min(time_bucket(INTERVAL 5 MINUTES, ts)) AS VARCHAR) AS first_slot FROM events GROUP BY 1""")
def time_bucketed_sink(spark, sf):
    out = fresh_dir(spark, "buckets")
    events = event_stream(spark, sf).select("event_id", "event_type", C("ts"))  # logs arrive in time order: no shuffle
    streams.run_available(streams.time_bucketed_sink(events, "ts", out), fresh_dir(spark, "ckpt"))
    schema = "event_id bigint, event_type string, ts timestamp, slot timestamp, year string, month string, day string, hour string"
    return (spark.read.schema(schema).json(out).groupBy(F.concat_ws("-", "year", "month", "day", "hour").alias("hour_dir"))
            .agg(F.count(F.lit(1)).alias("events"), F.min("slot").cast("timestamp_ntz").cast("string").alias("first_slot")))


@query("stream_upsert", with_views("change_log") + f", {_NEWEST} SELECT {_VERSION_COLS}, op = 'DELETE' AS deleted FROM newest")
def stream_upsert(spark, sf):
    store = cdc.BatchTable(spark, fresh_dir(spark, "upsert"))
    writer = change_stream(spark, sf).writeStream.foreachBatch(cdc.upsert_batch(store, "pk", ORDER))
    streams.run_available(writer, fresh_dir(spark, "ckpt"))
    return versions_out(cdc.latest_version(store.versions(), "pk", ORDER), (C("is_deleted") == 1).alias("deleted"))


@query("dead_letter", with_views("change_log") + """
, bad AS (SELECT * FROM change_log WHERE NOT (value <= 60))
SELECT 'dead' AS kind, count(*) AS rows, CAST(min(event_id) AS VARCHAR) AS min_id, CAST(max(event_id) AS VARCHAR) AS max_id FROM bad
UNION ALL SELECT 'applied', count(DISTINCT pk), NULL, NULL FROM change_log WHERE value <= 60""")
def dead_letter(spark, sf):
    good, errors = (cdc.BatchTable(spark, fresh_dir(spark, n)) for n in ("good", "dead"))
    write = cdc.dead_letter_batch(good, errors, C("value") <= 60, "change_log", "pk", "event_id", ORDER, "value out of range")
    streams.run_available(change_stream(spark, sf).writeStream.foreachBatch(write), fresh_dir(spark, "ckpt"))
    dead = errors.versions().agg(F.sum("rows").alias("rows"), F.min("min_id").cast("string").alias("min_id"),
                                 F.max("max_id").cast("string").alias("max_id"))
    applied = cdc.latest_version(good.versions(), "pk", ORDER).agg(F.count(F.lit(1)).alias("rows"))
    return union_all([dead.withColumn("kind", F.lit("dead")), applied.withColumn("kind", F.lit("applied"))])


@query("stream_token_bitmap", f"""
SELECT token, count(*) AS ids FROM ({_DOC_TOKENS}) GROUP BY ALL""")
def stream_token_bitmap(spark, sf):
    path = f"{sf}/documents.parquet"
    docs = streams.table_stream(spark, path, table(spark, sf, "documents").schema, maxFilesPerTrigger="64")
    words = F.array_distinct(F.filter(text.split_words(C("text")), lambda w: F.length(w) >= 2))
    # Rows of one bitmap word meet in one task before they are split: a large file's task would hold the bitmaps of all its rows.
    docs = spread(docs.select("doc_id", "text"), F.shiftright("doc_id", 6))
    tokens = docs.select(F.explode(words).alias("token"), F.lit("documents").alias("table_name"), C("doc_id").alias("pk"))
    store = cdc.BatchTable(spark, fresh_dir(spark, "bitmaps"))
    streams.run_available(tokens.writeStream.foreachBatch(cdc.bitmap_batch(store)), fresh_dir(spark, "ckpt"))
    return bitmap_sizes(cdc.stored_bitmaps(store)).select("token", "ids")


@query("rate_windows", with_views("access_log") + """
SELECT CAST(time_bucket(INTERVAL 1 HOUR, created_at) AS VARCHAR) AS window_start, user_id, action, count(*) AS requests, count(*) > 2 AS over_limit
FROM access_log GROUP BY ALL""")
def rate_windows(spark, sf):
    log = event_stream(spark, sf).select("user_id", C("event_type").alias("action"), C("ts"))
    store = cdc.BatchTable(spark, fresh_dir(spark, "rates"))
    write = streams.partial_batch(store, lambda batch: streams.rate_windows(batch, "ts", "user_id", "action", "1 hour", 2).drop("over_limit"))
    streams.run_available(log.writeStream.foreachBatch(write), fresh_dir(spark, "ckpt"))
    out = streams.summed(store, ["window_start", "user_id", "action"], "requests", 2)
    return out.withColumn("window_start", C("window_start").cast("timestamp_ntz").cast("string"))


@query("access_log_rollup", with_views("access_log") + """
SELECT CAST(time_bucket(INTERVAL 1 HOUR, created_at) AS VARCHAR) AS window_start, user_id, action, count(*) AS accesses FROM access_log GROUP BY ALL""")
def access_log_rollup(spark, sf):
    log = view(spark, sf, "access_log").select("user_id", "action", C("created_at"))
    out = streams.access_log_rollup(log, "created_at", "user_id", "action")
    return out.withColumn("window_start", C("window_start").cast("timestamp_ntz").cast("string"))


@query("stream_event_dedup", with_views("change_log") + "SELECT op, count(*) AS events, CAST(sum(event_id) AS BIGINT) AS ids FROM change_log GROUP BY op")
def stream_event_dedup(spark, sf):
    store = cdc.BatchTable(spark, fresh_dir(spark, "dedup"))
    twice = change_stream(spark, sf).unionByName(change_stream(spark, sf))  # overlapping polls deliver every change twice
    streams.run_available(twice.writeStream.foreachBatch(streams.once_batch(store, "event_id")), fresh_dir(spark, "ckpt"))
    return streams.once(store, "event_id").groupBy("op").agg(F.count(F.lit(1)).alias("events"), F.sum("event_id").alias("ids"))


@query("stream_counters", "SELECT 'events.parquet' AS unit, count(*) AS rows FROM events")
def stream_counters(spark, sf):
    path = f"{sf}/events.parquet"
    source = streams.table_stream(spark, path, table(spark, sf, "events").schema).select("event_id", C("_metadata.file_path").alias("file"))
    unit = F.regexp_extract("file", r"([^/]+)$", 1)  # one line per file
    store = cdc.BatchTable(spark, fresh_dir(spark, "counters"))
    streams.run_available(source.writeStream.foreachBatch(streams.counter_batch(store, unit)), fresh_dir(spark, "ckpt"))
    return store.versions().groupBy("unit").agg(F.sum("rows").alias("rows"))
