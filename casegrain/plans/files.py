"""Imports, ingest, cleaning and sinks: files are written to the shared folder from the driver's tables and read back."""

from __future__ import annotations

import math
import uuid

from pyspark.sql import functions as F

from casegrain.operators import tags as tagging
from casegrain.operators.warehouse import union_all
from casegrain.plans.registry import query
from casegrain.plans.views import table, view, with_views
from casegrain.session import fresh_dir
from casegrain.sources import clean, imports, ingest, sinks

C = F.col

# ---- imports -------------------------------------------------------------------------------------


@query("snapshot_import", """
SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY 1""")
def snapshot_import(spark, sf):
    target = fresh_dir(spark, "snapshot")
    imports.snapshot_import(table(spark, sf, "orders"), target, C("o_orderstatus") != "P")
    return (spark.read.parquet(target).groupBy("o_orderstatus")
            .agg(F.count(F.lit(1)).alias("n"), F.sum(C("o_totalprice").cast("decimal(18,2)")).cast("double").alias("total")))


@query("masked_projection_import", with_views("bank") + "SELECT id, entity_id, bank_name, account_type, is_active FROM bank")
def masked_projection_import(spark, sf):
    target = fresh_dir(spark, "masked")
    imports.snapshot_import(view(spark, sf, "bank"), target, columns=["id", "entity_id", "bank_name", "account_type", "is_active"])
    return spark.read.parquet(target)


@query("filtered_import", with_views("remark") + "SELECT id, entity_id, severity FROM remark WHERE NOT is_confidential")
def filtered_import(spark, sf):
    target = fresh_dir(spark, "filtered")
    imports.snapshot_import(view(spark, sf, "remark"), target, ~C("is_confidential"), ["id", "entity_id", "severity"])
    return spark.read.parquet(target)


@query("multi_table_fanin", """
SELECT 'trade' AS source_schema, 'customer' AS source_table, c_custkey AS id, c_name AS name, c_mktsegment AS segment FROM customer
UNION ALL SELECT 'trade', 'supplier', s_suppkey, s_name, NULL FROM supplier UNION ALL SELECT 'goods', 'part', p_partkey, p_name, p_type FROM part""")
def multi_table_fanin(spark, sf):
    t = {
        ("trade", "customer"): table(spark, sf, "customer").select(C("c_custkey").alias("id"), C("c_name").alias("name"), C("c_mktsegment").alias("segment")),
        ("trade", "supplier"): table(spark, sf, "supplier").select(C("s_suppkey").alias("id"), C("s_name").alias("name")),
        ("trade", "missing"): None,
        ("goods", "part"): table(spark, sf, "part").select(C("p_partkey").alias("id"), C("p_name").alias("name"), C("p_type").alias("segment")),
    }
    return imports.multi_table_fanin(t)


@query("incremental_import", """
SELECT o_orderstatus, count(*) AS n, (SELECT CAST(max(o_orderdate) AS VARCHAR) FROM orders) AS watermark FROM orders GROUP BY 1""")
def incremental_import(spark, sf):
    target = fresh_dir(spark, "increment")
    orders = table(spark, sf, "orders")
    first = "1997-01-01 00:00:00"
    imports.snapshot_import(orders, target, C("o_orderdate") <= F.lit(first).cast("timestamp_ntz"))
    mark = imports.incremental_import(orders, target, "o_orderdate", first)
    mark = imports.incremental_import(orders, target, "o_orderdate", mark)
    return (spark.read.parquet(target).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("watermark", F.lit(str(mark))))


@query("external_scan", "SELECT o_orderkey, o_custkey, o_orderpriority FROM orders WHERE o_orderpriority = '2-HIGH'")
def external_scan(spark, sf):
    base = fresh_dir(spark, "external")
    table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority").write.partitionBy("o_orderpriority").parquet(base)
    return imports.external_scan(spark, base).where("o_orderpriority = '2-HIGH'")


# ---- files of unknown shape ----------------------------------------------------------------------


def messy_parts(spark, sf, empty_name="2024"):
    """Parts with awkward names, blank and repeated rows, an empty column."""
    p = table(spark, sf, "part")
    rows = p.select(C("p_partkey").cast("string").alias("Part Key"), C("p_name").alias("Name (full)"), C("p_brand").alias("brand"),
                    C("p_type").alias("Brand!"), C("p_retailprice").cast("string").alias("price"), F.lit(None).cast("string").alias(empty_name))
    again = rows.where("brand = 'Brand#3'")
    blank = rows.where("brand = 'Brand#5'").select(*[F.lit(" ").alias(c) for c in rows.columns])
    return rows.unionByName(again).unionByName(blank)


_PARTS = "SELECT CAST(p_partkey AS VARCHAR) AS part_key, p_name AS name_full, p_brand AS brand, p_type AS brand_1, CAST(p_retailprice AS VARCHAR) AS price FROM part"


@query("csv_ingest", _PARTS)
def csv_ingest(spark, sf):
    path = fresh_dir(spark, "csv")
    messy_parts(spark, sf, "Notes").write.option("sep", ";").option("header", True).csv(path)
    return ingest.csv_ingest(spark, path)


ARRAY_BYTES = 16 << 20  # about what one file of a JSON array holds: its reader takes it whole


def write_json_arrays(spark, sf, path):
    """Conversations as files that hold one JSON array each (with an empty object first), one file per 16 MB of text.

    Files are dealt to tasks by their number, and turns to files by hash and place, so that no task writes much more than another
    and equal turns do not share a file.
    """
    c = table(spark, sf, "conversations")
    files = max(1, math.ceil((c.agg(F.sum(F.octet_length("text") + 100)).head()[0] or 0) / ARRAY_BYTES))
    file_no = F.pmod(F.xxhash64("conv_id", "turn", F.monotonically_increasing_id()), F.lit(files)).cast("int").alias("file_no")
    record = F.to_json(F.struct("conv_id", "turn", F.struct("role", "text").alias("msg"), F.array("role", F.lit("chat")).alias("tags")))
    body = c.select(file_no, F.lit(1).alias("ord"), F.concat(F.lit(","), record).alias("value"))
    numbers = spark.range(files).select(C("id").cast("int").alias("file_no"))
    frame = numbers.select("file_no", F.lit(0).alias("ord"), F.lit("[{}").alias("value")).unionByName(
        numbers.select("file_no", F.lit(2).alias("ord"), F.lit("]").alias("value")))
    (body.unionByName(frame).repartitionById(files, C("file_no")).sortWithinPartitions("file_no", "ord")
     .drop("ord").write.partitionBy("file_no").text(path))


@query("json_ingest", """
SELECT CAST(conv_id AS VARCHAR) AS conv_id, role AS msg_role, text AS msg_text, '["' || role || '","chat"]' AS tags, CAST(turn AS VARCHAR) AS turn FROM conversations""")
def json_ingest(spark, sf):
    path = fresh_dir(spark, "json")
    write_json_arrays(spark, sf, path)
    return ingest.json_ingest(spark, f"{path}/*")


def write_event_lines(spark, sf, path):
    """Events as JSON lines, mixed with banner lines and broken objects."""
    e = table(spark, sf, "events").select("event_id", "user_id", "event_type", "value", F.from_json("props", "k int").alias("props"))
    good = e.select(F.to_json(F.struct("*")).alias("value"))
    banner = e.where("event_type = 'signup'").select(F.concat(F.lit("=== started "), C("event_id").cast("string")).alias("value"))
    broken = e.where("event_type = 'error'").select(F.concat(F.lit('{"event_id": '), C("event_id").cast("string")).alias("value"))
    good.unionByName(banner).unionByName(broken).write.text(path)


@query("jsonl_ingest", """
SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, CAST(user_id AS VARCHAR) AS user_id, json_extract_string(props, '$.k') AS props_k FROM events""")
def jsonl_ingest(spark, sf):
    path = fresh_dir(spark, "jsonl")
    write_event_lines(spark, sf, path)
    return ingest.jsonl_ingest(spark, path).select("event_id", "event_type", "user_id", "props_k")


def give_extension(spark, folder, extension):
    """Rename the files Spark wrote below a folder, since text files always end in .txt."""
    jvm = spark._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    files = fs.listFiles(root, True)
    while files.hasNext():
        path = files.next().getPath()
        if path.getName().endswith(".txt"):
            fs.rename(path, jvm.org.apache.hadoop.fs.Path(path.getParent(), path.getName()[:-4] + extension))


@query("folder_ingest_report", """
SELECT 'csv' AS kind, 'ok' AS status, (SELECT count(*) FROM part) AS rows UNION ALL SELECT 'txt', 'ok', (SELECT count(*) FROM supplier)
UNION ALL SELECT 'json', 'ok', (SELECT count(*) FROM conversations) UNION ALL SELECT 'json', 'failed', 0
UNION ALL SELECT 'job', 'all', (SELECT count(*) FROM part) + (SELECT count(*) FROM supplier) + (SELECT count(*) FROM conversations)""")
def folder_ingest_report(spark, sf):
    folder = fresh_dir(spark, "incoming")
    messy_parts(spark, sf, "Notes").dropDuplicates().repartition("Part Key").write.option("sep", ";").option("header", True).csv(f"{folder}/parts")
    write_json_arrays(spark, sf, f"{folder}/chats")
    table(spark, sf, "region").select(F.concat(F.lit('{"name": '), "r_name").alias("value")).write.text(f"{folder}/broken")
    give_extension(spark, folder, ".json")
    suppliers = table(spark, sf, "supplier").select(F.concat_ws("|", C("s_suppkey").cast("string"), "s_name", C("s_acctbal").cast("string")).alias("value"))
    suppliers.write.text(f"{folder}/suppliers")
    report = ingest.ingest_folder(spark, folder, fresh_dir(spark, "tables"))
    per_kind = report.groupBy(F.element_at(F.split("file", r"\."), -1).alias("kind"), "status").agg(F.sum("rows").alias("rows"))
    job = report.agg(F.sum("rows").alias("rows")).select(F.lit("job").alias("kind"), F.lit("all").alias("status"), "rows")
    return per_kind.unionByName(job)


@query("quarantine", """
SELECT 'good' AS outcome, count(*) AS n FROM part UNION ALL SELECT 'field count', count(*) FROM part WHERE p_brand = 'Brand#7'""")
def quarantine(spark, sf):
    path = fresh_dir(spark, "mixed")
    p = table(spark, sf, "part")
    whole = p.select(F.concat_ws(";", C("p_partkey").cast("string"), "p_name", "p_brand").alias("value"))
    short = p.where("p_brand = 'Brand#7'").select(F.concat_ws(";", C("p_partkey").cast("string"), "p_name").alias("value"))
    whole.unionByName(short).write.text(path)
    good, bad = ingest.quarantine(ingest.read_delimited(spark, path, ingest.Dialect(";", False, 3)), "field count")
    loaded, errors = fresh_dir(spark, "loaded"), fresh_dir(spark, "errors")
    good.write.parquet(loaded)
    bad.write.parquet(errors)
    return union_all([spark.read.parquet(loaded).select(F.lit("good").alias("outcome")), spark.read.parquet(errors).select(C("reason").alias("outcome"))]
                     ).groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


# ---- cleaning ------------------------------------------------------------------------------------


@query("clean_columns", """
SELECT part_key, name_full, brand, brand_1, price, NULL::VARCHAR AS column_5 FROM (
  SELECT CAST(p_partkey AS VARCHAR) AS part_key, p_name AS name_full, p_brand AS brand, p_type AS brand_1, CAST(p_retailprice AS VARCHAR) AS price FROM part
  UNION ALL SELECT CAST(p_partkey AS VARCHAR), p_name, p_brand, p_type, CAST(p_retailprice AS VARCHAR) FROM part WHERE p_brand = 'Brand#3')""")
def clean_columns(spark, sf):
    return clean.rename_clean(messy_parts(spark, sf)).where("trim(brand) <> ''")


@query("drop_empty_rows", """
SELECT count(*) AS rows FROM (SELECT p_partkey FROM part UNION ALL SELECT p_partkey FROM part WHERE p_brand = 'Brand#3')""")
def drop_empty_rows(spark, sf):
    return clean.drop_empty_rows(messy_parts(spark, sf)).agg(F.count(F.lit(1)).alias("rows"))


_ALL = """(SELECT count(*) FROM part) + (SELECT count(*) FROM part WHERE p_brand IN ('Brand#3', 'Brand#5'))"""


@query("column_emptiness", f"""
SELECT unnest(['part_key', 'name_full', 'brand', 'brand_1', 'price', 'column_5']) AS column_name,
  round(unnest([x, x, x, x, x, 1.0]), 6) AS empty_ratio FROM (SELECT (SELECT count(*) FROM part WHERE p_brand = 'Brand#5') / ({_ALL}) AS x)""")
def column_emptiness(spark, sf):
    return clean.column_emptiness(clean.rename_clean(messy_parts(spark, sf))).withColumn("empty_ratio", F.round("empty_ratio", 6))


@query("drop_empty_columns", f"""
SELECT part_key, name_full, brand, brand_1, price FROM ({_PARTS} UNION ALL {_PARTS} WHERE p_brand = 'Brand#3')""")
def drop_empty_columns(spark, sf):
    return clean.drop_empty_columns(clean.drop_empty_rows(clean.rename_clean(messy_parts(spark, sf))))


@query("coerce_types", """
SELECT o_orderkey AS id, CAST(CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_custkey END AS VARCHAR) AS customer, o_totalprice AS price,
  CASE o_orderstatus WHEN 'F' THEN 'true' WHEN 'O' THEN 'false' END AS flag FROM orders""")
def coerce_types(spark, sf):
    o = table(spark, sf, "orders")
    raw = o.select(
        F.concat(F.lit(" "), C("o_orderkey").cast("string")).alias("id"),
        F.when(C("o_orderstatus") == "P", F.concat(C("o_custkey").cast("string"), F.lit(".5"))).otherwise(C("o_custkey").cast("string")).alias("customer"),
        F.concat(F.when(C("o_orderstatus") == "F", "$").otherwise("€"), F.format_number("o_totalprice", 2)).alias("price"),
        F.when(C("o_orderstatus") == "F", "Yes").when(C("o_orderstatus") == "O", "0").otherwise("maybe").alias("flag"))
    typed = clean.coerce_types(raw, {"id": "BIGINT", "customer": "BIGINT", "price": "NUMERIC", "flag": "BOOLEAN"})
    return typed.withColumns({c: C(c).cast("string") for c in ("customer", "flag")})  # nullable columns compare best as text


@query("dedup_rows", "SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def dedup_rows(spark, sf):
    return clean.dedup_rows(table(spark, sf, "orders").select("o_custkey", "o_orderstatus", "o_orderpriority"))


@query("flatten_json", """
SELECT event_id, CAST(json_extract_string(props, '$.k') AS INT) AS payload_props_k, event_type AS payload_kind, '["' || event_type || '"]' AS payload_tags FROM events""")
def flatten_json(spark, sf):
    nested = table(spark, sf, "events").select("event_id", F.struct(
        F.from_json("props", "k int").alias("props"), C("event_type").alias("kind"), F.array("event_type").alias("tags")).alias("payload"))
    return clean.flatten_json(nested)


@query("surrogate_key", """
SELECT o_orderkey, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS s_indx FROM orders""")
def surrogate_key(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey")
    return clean.surrogate_key(orders, ["o_custkey", "o_orderkey"]).select("o_orderkey", "s_indx")


# ---- sinks and reports ---------------------------------------------------------------------------


@query("warehouse_write", with_views("entity") + """
SELECT country, CAST(year(created_on) AS INT) AS year, count(*) AS entities, CAST(sum(CASE WHEN year(created_on) = 2021 THEN 100 ELSE risk_score END) AS BIGINT) AS risk
FROM entity GROUP BY ALL""")
def warehouse_write(spark, sf):
    name, path = f"wh_entities_{uuid.uuid4().hex[:12]}", fresh_dir(spark, "warehouse")
    cube = view(spark, sf, "entity").select("entity_id", "full_name", "primary_email", "primary_phone", "risk_score", "country",
                                            F.year("created_on").alias("year"))
    sinks.warehouse_write(cube, name, path, buckets=4)
    sinks.warehouse_overwrite(cube.where("year = 2021").withColumn("risk_score", F.lit(100)), name)
    sinks.drop_table(spark, name)  # an external table: the files stay
    return spark.read.orc(path).groupBy("country", "year").agg(F.count(F.lit(1)).alias("entities"), F.sum("risk_score").alias("risk"))


@query("delimited_write", with_views("bank") + """
SELECT kind, count(*) AS rows, CAST(sum(entity_id) AS BIGINT) AS ids FROM (SELECT 'comma' AS kind, entity_id FROM bank UNION ALL SELECT 'tab', entity_id FROM bank) GROUP BY kind""")
def delimited_write(spark, sf):
    rows = view(spark, sf, "bank").select("entity_id", "bank_name", "account_type")
    out = []
    for kind, sep in (("comma", ","), ("tab", "\t")):
        path = fresh_dir(spark, kind)
        sinks.delimited_write(rows, path, sep)
        back = spark.read.schema("entity_id bigint, bank_name string, account_type string").option("sep", sep).csv(path)
        out.append(back.agg(F.count(F.lit(1)).alias("rows"), F.sum("entity_id").alias("ids")).withColumn("kind", F.lit(kind)))
    return union_all(out)


@query("report_table", with_views("entity") + """
SELECT e.entity_id, e.primary_email, x.refs AS cross_refs, x.n > 1 AS has_duplicates
FROM (SELECT * FROM entity ORDER BY entity_id LIMIT 200) e
JOIN (SELECT primary_email, string_agg(DISTINCT city, ';' ORDER BY city) AS refs, count(DISTINCT city) AS n FROM entity GROUP BY 1) x USING (primary_email)""")
def report_table(spark, sf):
    path = fresh_dir(spark, "report")
    report = sinks.report_table(view(spark, sf, "entity"), "entity_id", "primary_email", "city", limit=200)
    flat = report.select("entity_id", "primary_email", F.array_join("cross_refs", ";").alias("cross_refs"), "has_duplicates")
    sinks.write_report(flat, path)
    return spark.read.option("header", True).schema(flat.schema).csv(path)


@query("report_all_tables", """
SELECT source AS _source_table, id, name FROM (
  SELECT 'customer' AS source, 0 AS t, * FROM (SELECT c_custkey AS id, c_name AS name FROM customer ORDER BY c_custkey LIMIT 10)
  UNION ALL SELECT 'supplier', 1, * FROM (SELECT s_suppkey, s_name FROM supplier ORDER BY s_suppkey LIMIT 10)
  UNION ALL SELECT 'part', 2, * FROM (SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 10)) ORDER BY t, id LIMIT 25""")
def report_all_tables(spark, sf):
    keys = {"customer": ("c_custkey", "c_name"), "supplier": ("s_suppkey", "s_name"), "part": ("p_partkey", "p_name")}
    tables = {t: (table(spark, sf, t).select(C(k).alias("id"), C(n).alias("name")), "id") for t, (k, n) in keys.items()}
    return sinks.report_all_tables(tables, limit=25)


@query("sample_report", with_views("entity", "tag", "category") + """, tables AS (
  SELECT city, country FROM (SELECT city, country, row_number() OVER (PARTITION BY city ORDER BY country) AS n FROM (SELECT DISTINCT city, country FROM entity)) WHERE n <= 10),
chosen AS (SELECT *, row_number() OVER (PARTITION BY city, country ORDER BY entity_id) AS n FROM entity SEMI JOIN tables USING (city, country))
SELECT e.city AS database, e.country AS table_name, e.entity_id AS record_id, e.primary_email AS email, coalesce(t.tags, '') AS tags FROM chosen e
LEFT JOIN (SELECT t.entity_id, string_agg(c.name, ';' ORDER BY c.name) AS tags FROM tag t JOIN category c ON c.category_id = t.category_id AND c.is_active GROUP BY 1) t USING (entity_id)
WHERE e.n <= 100""")
def sample_report(spark, sf):
    names = tagging.entity_categories(view(spark, sf, "tag"), view(spark, sf, "category")).select("entity_id", C("category_names").alias("tags"))
    rows = view(spark, sf, "entity").join(names, "entity_id", "left").select(
        C("city").alias("database"), C("country").alias("table_name"), C("entity_id").alias("record_id"), C("primary_email").alias("email"),
        F.coalesce("tags", F.array().cast("array<string>")).alias("tags"))
    return sinks.sample_report(rows, "database", "table_name", "record_id", "tags")


@query("sync_stats", """
SELECT 'orders' AS table_name, count(*) FILTER (WHERE o_orderstatus <> 'P') AS live_rows, coalesce(max(o_orderkey), 0) AS max_key,
  CAST(max(o_orderdate) AS VARCHAR) AS last_sync, (SELECT count(*) FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01') AS behind FROM orders
UNION ALL SELECT 'lineitem', count(*) FILTER (WHERE l_linestatus <> 'P'), coalesce(max(l_orderkey), 0), CAST(max(l_shipdate) AS VARCHAR),
  (SELECT count(*) FROM lineitem WHERE l_shipdate > TIMESTAMP '1998-01-01') FROM lineitem""")
def sync_stats(spark, sf):
    from casegrain.streaming.cdc import sync_stats as stats

    at = F.lit("1998-01-01").cast("timestamp_ntz")
    tables = {"orders": ("o_orderkey", "o_orderdate", C("o_orderstatus") != "P"), "lineitem": ("l_orderkey", "l_shipdate", C("l_linestatus") != "P")}
    return union_all([stats(table(spark, sf, t), t, key, ts, live, at) for t, (key, ts, live) in tables.items()])
