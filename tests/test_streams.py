"""Streams in several batches give what their batch twin gives; repeated batches change nothing."""

import random

import pytest
from pyspark.sql import functions as F

from casegrain.operators import index
from casegrain.streaming import cdc, maintain, streams

SCHEMA = "event_id bigint, pk bigint, op string, value double, updated_at timestamp"


@pytest.fixture(scope="module")
def events(spark, tmp_path_factory):
    """Changes in six files, one per batch, not in time order across files."""
    rng = random.Random(11)
    path = str(tmp_path_factory.mktemp("changes"))
    rows = [(i, rng.randint(0, 40), rng.choice(["INSERT", "UPDATE", "DELETE"]), float(rng.randint(0, 100)), rng.randint(0, 86_400)) for i in range(600)]
    df = (spark.createDataFrame(rows, "event_id bigint, pk bigint, op string, value double, s bigint")
          .select("event_id", "pk", "op", "value", (F.timestamp_seconds(F.col("s") + 1_700_000_000)).alias("updated_at")))
    df.repartition(6).write.mode("overwrite").parquet(path)
    return path, spark.read.parquet(path)


def source(spark, path):
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(path)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)


ORDER = ["updated_at", "event_id"]


def test_upsert_stream_equals_batch_also_after_compaction(spark, events, tmp_path):
    path, batch = events
    store = cdc.BatchTable(spark, str(tmp_path / "store"))
    write = cdc.upsert_batch(store, "pk", ORDER)
    streams.run_available(source(spark, path).writeStream.foreachBatch(write), str(tmp_path / "ckpt"))
    assert store.batches().agg(F.max("batch_id")).first()[0] == 5
    wanted = cdc.latest_version(cdc.as_versions(batch), "pk", ORDER).select("pk", "event_id", "is_deleted")

    def state():
        return cdc.latest_version(store.versions(), "pk", ORDER).select("pk", "event_id", "is_deleted")

    same(state(), wanted)
    store = store.folded(str(tmp_path / "folded"), lambda v: cdc.latest_version(v, "pk", ORDER))
    write = cdc.upsert_batch(store, "pk", ORDER)
    assert store.versions().count() == wanted.count()
    same(state(), wanted)
    late = spark.createDataFrame([(10_000, 1, "DELETE", 0.0)], "event_id bigint, pk bigint, op string, value double").withColumn(
        "updated_at", F.timestamp_seconds(F.lit(1_800_000_000)))
    write(late, 6)
    write(late, 6)  # the same batch again
    assert state().where("pk = 1").head()["event_id"] == 10_000
    assert state().count() == wanted.count()


def test_applying_events_twice_changes_nothing(spark, events):
    _, batch = events
    empty = cdc.as_versions(batch).limit(0)
    once = cdc.apply_changes(empty, batch, "pk", ORDER)
    same(cdc.apply_changes(once, batch, "pk", ORDER).select("pk", "event_id"), once.select("pk", "event_id"))


def test_dead_letters_per_batch(spark, events, tmp_path):
    path, batch = events
    good, dead = (cdc.BatchTable(spark, str(tmp_path / n)) for n in ("good", "dead"))
    write = cdc.dead_letter_batch(good, dead, F.col("value") <= 90, "t", "pk", "event_id", ORDER, "out of range")
    streams.run_available(source(spark, path).writeStream.foreachBatch(write), str(tmp_path / "ckpt"))
    bad = batch.where("value > 90")
    totals = dead.versions().agg(F.sum("rows"), F.min("min_id"), F.max("max_id"), F.count(F.lit(1))).head()
    wanted = bad.agg(F.count(F.lit(1)), F.min("event_id"), F.max("event_id")).head()
    assert tuple(totals)[:3] == tuple(wanted) and 1 <= totals[3] <= 6
    assert '"value":' in dead.versions().head()["sample"]


def test_bitmap_stream_equals_batch(spark, events, tmp_path):
    path, batch = events
    store = cdc.BatchTable(spark, str(tmp_path / "bitmaps"))

    def tokens(df):
        return df.select(F.col("op").alias("token"), F.lit("t").alias("table_name"), F.col("event_id").alias("pk"))

    streams.run_available(tokens(source(spark, path)).writeStream.foreachBatch(cdc.bitmap_batch(store)), str(tmp_path / "ckpt"))
    columns = ["token", "table_name", "word", "bits"]
    same(cdc.stored_bitmaps(store).select(*columns), index.token_bitmap(tokens(batch)).select(*columns))


def test_rate_windows_count_rows_however_late(spark, events, tmp_path):
    path, batch = events  # files are not in time order
    store = cdc.BatchTable(spark, str(tmp_path / "rates"))
    keys = ["window_start", "pk", "op"]
    write = streams.partial_batch(store, lambda b: streams.rate_windows(b, "updated_at", "pk", "op", "1 hour", 2).drop("over_limit"))
    streams.run_available(source(spark, path).writeStream.foreachBatch(write), str(tmp_path / "ckpt"))
    assert store.batches().agg(F.max("batch_id")).first()[0] == 5
    columns = [*keys, "requests", "over_limit"]
    same(streams.summed(store, keys, "requests", 2).select(*columns), streams.rate_windows(batch, "updated_at", "pk", "op", "1 hour", 2).select(*columns))


def test_access_rollup_stream_equals_batch(spark, events, tmp_path):
    path, batch = events
    store = cdc.BatchTable(spark, str(tmp_path / "rollup"))
    write = streams.partial_batch(store, lambda b: streams.access_log_rollup(b, "updated_at", "pk", "op"))
    streams.run_available(source(spark, path).writeStream.foreachBatch(write), str(tmp_path / "ckpt"))
    columns = ["window_start", "pk", "op", "accesses"]
    same(streams.summed(store, columns[:3], "accesses").select(*columns), streams.access_log_rollup(batch, "updated_at", "pk", "op").select(*columns))


def test_redelivered_events_count_once(spark, events, tmp_path):
    path, batch = events
    twice = source(spark, path).unionByName(source(spark, path))
    store = cdc.BatchTable(spark, str(tmp_path / "once"))
    streams.run_available(twice.writeStream.foreachBatch(streams.once_batch(store, "event_id")), str(tmp_path / "ckpt"))
    same(streams.once(store, "event_id").select("event_id"), batch.select("event_id"))


def test_stream_queries_are_exact_on_many_unordered_files(spark, tmp_path):
    from casegrain.plans import catalog

    sf, folder = "/root/testdata/sf0.01", tmp_path / "many"
    folder.mkdir()
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(130, F.hash("event_id")).write.parquet(f"{folder}/events.parquet")
    assert catalog.QUERIES["rate_windows"](spark, str(folder)).agg(F.sum("requests")).first()[0] == events.count()
    assert catalog.QUERIES["stream_event_dedup"](spark, str(folder)).agg(F.sum("events")).first()[0] == events.count()


def test_batches_replace_themselves_and_fold_into_a_new_table(spark, tmp_path):
    store = cdc.BatchTable(spark, str(tmp_path / "store"), "unit string, rows bigint")
    assert store.versions().count() == 0
    add = lambda table, n: table.append(spark.createDataFrame([("a", 1)], "unit string, rows bigint"), n)
    total = lambda table: table.versions().agg(F.sum("rows")).first()[0]
    for n in (0, 1, 1):
        add(store, n)
    assert total(store) == 2
    new = store.folded(str(tmp_path / "new"), lambda v: v.groupBy("unit").agg(F.sum("rows").alias("rows")))
    assert total(new) == 2 and new.versions().count() == 1
    add(new, 2)
    assert total(new) == 3 and total(store) == 2


def test_attempts_are_counted_before_rows_are_dead_letters(spark, events, tmp_path):
    path, batch = events
    calls = []

    def broken(until):
        def apply(rows, batch_id):
            calls.append(batch_id)
            if calls.count(batch_id) <= until:
                raise ValueError("target is away")
            good.append(rows, batch_id)
        return apply

    for until, attempts in ((2, {1}), (9, {1, 3})):
        calls.clear()
        good, dead = (cdc.BatchTable(spark, str(tmp_path / f"{n}{until}"), schema) for n, schema in (("good", batch.schema), ("dead", None)))
        write = cdc.dead_letter_batch(good, dead, F.col("value") <= 90, "t", "pk", "event_id", ORDER, "out of range", apply=broken(until))
        streams.run_available(source(spark, path).writeStream.foreachBatch(write), str(tmp_path / f"ckpt{until}"))
        found = dead.versions().collect()
        assert {r["attempts"] for r in found} == attempts and set(map(calls.count, calls)) == {3}
        assert {r["error"] for r in found if r["attempts"] == 3} == ({"target is away"} if until == 9 else set())
        lost = batch.count() if until == 9 else batch.where("value > 90").count()
        assert sum(r["rows"] for r in found) == lost


def test_drop_folder_takes_every_file_once(spark, tmp_path):
    incoming, archive, out, ckpt = (str(tmp_path / n) for n in ("in", "archive", "out", "ckpt"))
    for lo in (0, 10):
        spark.range(lo, lo + 10).selectExpr("id AS event_id").write.mode("append").json(incoming)
        dropped = streams.drop_folder_stream(spark, incoming, archive, "event_id bigint, _corrupt_record string")
        streams.run_available(dropped.select("event_id").writeStream.format("parquet").option("path", out), ckpt)
    assert sorted(r[0] for r in spark.read.parquet(out).collect()) == list(range(20))


def test_a_broken_file_ends_in_the_error_folder_with_its_reason(spark, tmp_path):
    incoming, archive, errors = (str(tmp_path / n) for n in ("in", "archive", "errors"))
    target, ledger = (cdc.BatchTable(spark, str(tmp_path / n)) for n in ("loaded", "ledger"))
    (tmp_path / "in").mkdir()

    def poll():
        dropped = streams.filed_stream(spark, incoming, "event_id bigint, _corrupt_record string", maxFilesPerTrigger="2")
        streams.run_available(dropped.writeStream.foreachBatch(streams.filed_batch(target, ledger)), str(tmp_path / "ckpt"))
        return streams.settle_files(ledger, incoming, archive, errors)

    for n in range(3):
        (tmp_path / "in" / f"good{n}.json").write_text(f'{{"event_id": {2 * n}}}\n{{"event_id": {2 * n + 1}}}\n')
    (tmp_path / "in" / "bad.json").write_text('{"event_id": 50}\n{"event_id": \n')
    for _ in range(2):  # nothing new the second time
        entries = {r["file"].rsplit("/", 1)[1]: r for r in poll().collect()}
        assert {n: (r["status"], r["rows"]) for n, r in entries.items()} == {"bad.json": ("failed", 2)} | {f"good{n}.json": ("done", 2) for n in range(3)}
        assert entries["bad.json"]["reason"].startswith('cannot be read: {"event_id":') and entries["good0.json"]["reason"] is None
        assert sorted(r[0] for r in target.versions().collect()) == list(range(6))
        names = [sorted(p.name for p in (tmp_path / d).iterdir() if p.suffix == ".json") for d in ("in", "archive", "errors")]
        assert names == [[], [f"good{n}.json" for n in range(3)], ["bad.json"]]
    (tmp_path / "in" / "late.json").write_text('{"event_id": 99}\n')
    assert poll().count() == 5 and target.versions().count() == 7


def test_sync_resumes_and_polls_are_bounded(spark, events, tmp_path):
    _, batch = events
    target = str(tmp_path / "sync")
    mark = cdc.initial_sync(batch.where("event_id < 200"), target, "event_id")
    assert mark == 199
    assert cdc.initial_sync(batch, target, "event_id", mark) == 599
    assert spark.read.parquet(target).count() == 600
    assert [r["event_id"] for r in cdc.incremental_sync(batch, "event_id", 10, 5).collect()] == [11, 12, 13, 14, 15]
    latest = batch.agg(F.max("updated_at")).scalar()
    polled = cdc.poll_changes(batch, latest, "updated_at", "event_id", seconds=3600, limit=7).collect()
    assert len(polled) == 7 and polled == sorted(polled, key=lambda r: (r["updated_at"], r["event_id"]))
    whole = cdc.poll_changes(batch, latest, "updated_at", "event_id", seconds=3600, limit=10_000)
    same(cdc.poll_all(batch, latest, "updated_at", "event_id", str(tmp_path / "polled"), seconds=3600, limit=7), whole)


def test_purge_keeps_unknown(spark):
    df = spark.createDataFrame([(1,), (5,), (None,)], "age int")
    kept, deleted = maintain.purge(df, F.col("age") > 3)
    assert kept.count() == 2 and deleted.head()["deleted"] == 1


def test_open_sessions_have_no_end(spark):
    rows = [(1, 7, "open", 100), (1, 7, "close", 160), (2, 7, "open", 200)]
    df = spark.createDataFrame(rows, "sid bigint, uid bigint, kind string, s bigint").withColumn("at", F.timestamp_seconds("s"))
    got = maintain.work_sessions(df, "sid", "uid").orderBy("sid").collect()
    assert [(r["sid"], r["ended_at"] is None, r["duration_seconds"]) for r in got] == [(1, False, 60), (2, True, None)]
