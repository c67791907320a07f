"""Ingest, cleaning and sinks on small files."""

import pytest
from pyspark.sql import functions as F

from casegrain.operators import profile
from casegrain.sources import clean, imports, ingest, sinks


def write(path, *lines):
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_clean_columns():
    assert clean.clean_columns([" First  Name ", "first-name", "FIRST_NAME", "", "42", "9 lives", "__a__b__", "é"]) == [
        "first_name", "first_name_1", "first_name_2", "column_3", "column_4", "col_9_lives", "a_b", "column_7"]


@pytest.mark.parametrize("lines, wanted", [
    (["id;name", "1;x"], (";", True, 2)), (["id\tname", "1\tx"], ("\t", True, 2)), (["1,2", "3,4"], (",", False, 2)),
    (["a|b|c, d", "1|2|3, 4"], ("|", True, 3)), (["one"], (",", False, 1)), (["a@b.c,d", "1,2"], (",", False, 2))])
def test_sniff(spark, tmp_path, lines, wanted):
    d = ingest.sniff(spark, write(tmp_path / "f.csv", *lines))
    assert (d.delimiter, d.header, d.columns) == wanted


def test_csv_ingest(spark, tmp_path):
    path = write(tmp_path / "f.csv", "Part No;Name;Empty", "1;ring;", "1;ring;", ";;", "2;bolt;", "3;too;many;fields", '4;"a;b";', "5")
    assert sorted(tuple(r) for r in ingest.csv_ingest(spark, path).collect()) == [("1", "ring"), ("2", "bolt"), ("4", "a;b")]


def test_csv_keeps_values_that_differ_only_in_the_separator(spark, tmp_path):
    path = write(tmp_path / "f.csv", "a;b;c", "x|y;z;1", "x;y|z;1")
    assert ingest.csv_ingest(spark, path).count() == 2


def test_json_and_jsonl(spark, tmp_path):
    array = write(tmp_path / "a.json", '[{"b": {"x": 1}, "A": [1, 2]},', ' {}, {"b": {"x": 2.50}, "A": null}]')
    assert [tuple(r) for r in ingest.json_ingest(spark, array).orderBy("b_x").collect()] == [("[\"1\",\"2\"]", "1"), (None, "2.50")]
    single = write(tmp_path / "o.json", '{"k": true}')
    assert [tuple(r) for r in ingest.json_ingest(spark, single).collect()] == [("true",)]
    lines = write(tmp_path / "l.jsonl", '{"k": 1}', "banner", '{"k": 2', '{"k": 3}')
    assert sorted(r["k"] for r in ingest.jsonl_ingest(spark, lines).collect()) == ["1", "3"]


def test_folder_report(spark, tmp_path):
    folder = tmp_path / "in"
    (folder / "sub").mkdir(parents=True)
    write(folder / "a.csv", "id,name", "1,x", "2,y")
    write(folder / "sub" / "b.jsonl", '{"k": 1}')
    write(folder / "bad.json", "[{")
    write(folder / "notes.md", "no")
    report = ingest.ingest_folder(spark, str(folder), str(tmp_path / "out")).collect()
    assert sorted((r["file"].rsplit("/", 1)[1], r["status"], r["rows"]) for r in report) == [
        ("a.csv", "ok", 2), ("b.jsonl", "ok", 1), ("bad.json", "failed", 0)]
    assert len(ingest.list_files(spark, str(folder), recursive=False)) == 2


def test_empty_rows_columns_and_types(spark):
    df = spark.createDataFrame([(" ", None), ("a", " "), ("b", None)], "x string, y string")
    assert clean.drop_empty_columns(clean.drop_empty_rows(df)).columns == ["x"]
    raw = spark.createDataFrame([(" 12 ", "$1,200.50", "YES"), ("12.5", "€3", "0"), ("", "x", "maybe")], "i string, n string, b string")
    got = clean.coerce_types(raw, {"i": "BIGINT", "n": "NUMERIC", "b": "BOOLEAN"}).collect()
    assert [tuple(r) for r in got] == [(12, 1200.5, True), (None, 3.0, False), (None, None, None)]


def test_surrogate_key_has_no_gaps(spark):
    df = spark.range(1000).select((F.col("id") * 7 % 1000).alias("k")).repartition(5)
    got = clean.surrogate_key(df, ["k"]).orderBy("k").collect()
    assert [r["s_indx"] for r in got] == list(range(1, 1001))


def test_incremental_import_moves_the_mark(spark, tmp_path):
    df = spark.range(10).withColumnRenamed("id", "k")
    target = str(tmp_path / "t")
    imports.snapshot_import(df, target, F.col("k") <= 3)
    mark = imports.incremental_import(df, target, "k", 3)
    assert mark == 9 and imports.incremental_import(df, target, "k", mark) == 9
    assert spark.read.parquet(target).count() == 10


def test_warehouse_overwrite_touches_only_its_partitions(spark, tmp_path):
    rows = [(i, "a" if i % 2 else "b", 2020 + i % 3, f"{i}@x", str(i)) for i in range(60)]
    df = spark.createDataFrame(rows, "entity_id bigint, country string, year int, primary_email string, primary_phone string")
    sinks.warehouse_write(df, "wh_test", str(tmp_path / "wh"), buckets=4)
    sinks.warehouse_overwrite(df.where("country = 'a' AND year = 2020").limit(1), "wh_test")
    out = spark.table("wh_test")
    assert out.where("country = 'a' AND year = 2020").count() == 1
    assert out.count() == 60 - df.where("country = 'a' AND year = 2020").count() + 1
    plan = out.groupBy("entity_id").count()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan and "hashpartitioning" not in plan
    sinks.drop_table(spark, "wh_test")


def test_report_formats(spark, tmp_path):
    df = spark.range(5)
    sinks.write_report(df, str(tmp_path / "j"), "json")
    assert spark.read.json(str(tmp_path / "j" / "envelope")).head()["count"] == 5
    sinks.write_report(df, str(tmp_path / "c"))
    assert spark.read.option("header", True).csv(str(tmp_path / "c")).count() == 5


def test_profile_is_unmasked_only_on_request(spark):
    entities = spark.sql("SELECT 1L AS entity_id, 'n' AS full_name, 'e@x' AS primary_email, CAST(null AS STRING) AS primary_phone, 'c' AS city, 'y' AS country")
    anchors = spark.sql("SELECT 1L AS id, 1L AS entity_id, 'PAN' AS id_type, 'ABCDE1234F' AS id_number, true AS is_verified, true AS is_primary, 'IN' AS issuing_country")
    socials = spark.sql("SELECT 1L AS id, 1L AS entity_id, 'p' AS platform, 'h' AS handle, 3L AS follower_count, true AS is_active")
    banks = spark.sql("SELECT 1L AS id, 1L AS entity_id, 'b' AS bank_name, 's' AS account_type, '123456789' AS account_number, true AS is_active, true AS is_primary, DATE '2020-01-01' AS opened_at")
    cases = spark.sql("SELECT 1L AS case_id, 'C1' AS case_number, 'c' AS category, 'O' AS status, TIMESTAMP '2020-01-01 00:00:00' AS created_at, false AS is_deleted")
    roles = spark.sql("SELECT 1L AS case_id, 1L AS entity_id, 'suspect' AS role")
    for unmask, id_number, account in ((False, "XXXXX1234F", "XXXXX6789"), (True, "ABCDE1234F", "123456789")):
        row = profile.entity_profile(entities, anchors, socials, banks, cases, roles, unmask).head()
        assert row["identity_anchors"][0]["id_number"] == id_number and row["bank_accounts"][0]["account"] == account
        assert [c["contact_type"] for c in row["contacts"]] == ["email"]


def test_json_arrays_are_even_also_where_turns_are_equal(spark, tmp_path, monkeypatch):
    from casegrain.plans import files

    monkeypatch.setattr(files, "ARRAY_BYTES", 20_000, raising=False)
    sf = tmp_path / "tables"
    spark.range(0, 2000, 1, 4).selectExpr("1L as conv_id", "0L as turn", "'user' as role", "repeat('x', 100) as text").write.parquet(f"{sf}/conversations.parquet")
    files.write_json_arrays(spark, str(sf), f"{tmp_path}/out")
    sizes = [p.stat().st_size for p in (tmp_path / "out").rglob("*.txt")]
    assert len(sizes) == 20 and max(sizes) < 2 * sum(sizes) / len(sizes)
    assert ingest.json_ingest(spark, f"{tmp_path}/out/*").count() == 2000
