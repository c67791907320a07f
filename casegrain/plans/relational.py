"""Filters, pages, relational joins and summaries bound to the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from casegrain.operators import filters, joins, paging, tags, warehouse
from casegrain.plans.registry import query
from casegrain.plans.views import table, view, with_views

NOW = "1998-01-01"
BY_VALUE = [("value", "desc"), ("id", "asc")]


def text(name: str):
    return F.col(name).cast("string").alias(name)


def money(name: str):
    return F.col(name).cast("double").alias(name)


def record_rows(df: DataFrame, *extra: str) -> DataFrame:
    return df.select("id", "name", "category", "status", money("value"), *extra)


RECORD_COLS = "id, name, category, status, CAST(value AS DOUBLE) AS value"

# ---- filters ------------------------------------------------------------------------------------


@query("eq_filters", """
SELECT o_orderkey, o_custkey, o_orderpriority FROM orders
WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'""")
def eq_filters(spark, sf):
    wanted = {"o_orderstatus": "F", "o_orderpriority": "1-URGENT", "o_custkey": "", "no_such_column": "x"}
    found = filters.eq_filters(table(spark, sf, "orders"), wanted, ["o_orderstatus", "o_orderpriority", "o_custkey"])
    return found.select("o_orderkey", "o_custkey", "o_orderpriority")


@query("contains_search", with_views("record") + f"""
SELECT {RECORD_COLS} FROM record WHERE contains(lower(name), 'red') ORDER BY id""")
def contains_search(spark, sf):
    r = view(spark, sf, "record")
    return record_rows(r.where(filters.contains_text("name", "RED"))).orderBy("id")


@query("multi_column_search", with_views("record") + f"""
SELECT {RECORD_COLS} FROM record
WHERE (contains(lower(name), 'ring') OR contains(lower(category), 'ring') OR contains(lower(status), 'ring'))
  AND category = 'ECONOMY'""")
def multi_column_search(spark, sf):
    r = view(spark, sf, "record")
    return record_rows(filters.multi_column_search(r, ["name", "category", "status"], "Ring", {"category": "ECONOMY"}))


@query("any_type_search", with_views("record") + f"""
SELECT {RECORD_COLS}, (SELECT count(*) FROM record WHERE contains(concat_ws('|', CAST(id AS VARCHAR), lower(name),
       lower(category), lower(status), CAST(value AS VARCHAR)), '19')) AS total_count
FROM record
WHERE contains(concat_ws('|', CAST(id AS VARCHAR), lower(name), lower(category), lower(status), CAST(value AS VARCHAR)), '19')
ORDER BY id LIMIT 50 OFFSET 10""")
def any_type_search(spark, sf):
    found = filters.any_type_search(view(spark, sf, "record"), "19")
    return record_rows(paging.page_with_total(found, [("id", "asc")], 50, 10), "total_count")


@query("multi_filter", with_views("entity") + """
SELECT entity_id, status, risk_score, CAST(date_of_birth AS VARCHAR) AS date_of_birth FROM entity
WHERE status IN ('household', 'machinery') AND date_of_birth BETWEEN DATE '1960-01-01' AND DATE '1990-12-31'
  AND risk_score BETWEEN 20 AND 90""")
def multi_filter(spark, sf):
    found = filters.multi_filter(view(spark, sf, "entity"), statuses=["household", "machinery"], dob_from="1960-01-01",
                                 dob_to="1990-12-31", risk_min=20, risk_max=90)
    return found.select("entity_id", "status", "risk_score", text("date_of_birth"))


@query("active_only", with_views("case_file", "bank") + """
SELECT c.status, count(*) AS live_cases,
       (SELECT count(*) FROM bank WHERE is_active) AS active_accounts
FROM case_file c WHERE NOT c.is_deleted GROUP BY c.status""")
def active_only(spark, sf):
    cases = filters.active_only(view(spark, sf, "case_file"), deleted="is_deleted")
    accounts = filters.active_only(view(spark, sf, "bank"), active="is_active")
    return (cases.groupBy("status").agg(F.count(F.lit(1)).alias("live_cases"))
            .withColumn("active_accounts", accounts.agg(F.count(F.lit(1))).scalar()))


_CASES_FOUND = """NOT is_deleted AND status = 'O' AND category = '1-URGENT'
  AND (contains(lower(case_number), 'case-1') OR contains(lower(category), 'case-1'))"""


@query("list_cases", with_views("case_file") + f"""
SELECT case_id, case_number, status, CAST(created_at AS VARCHAR) AS created_at,
       (SELECT count(*) FROM case_file WHERE {_CASES_FOUND}) AS total_count
FROM case_file WHERE {_CASES_FOUND}
ORDER BY created_at DESC, case_id DESC LIMIT 50""")
def list_cases(spark, sf):
    live = filters.active_only(view(spark, sf, "case_file"), deleted="is_deleted")
    found = filters.multi_column_search(live, ["case_number", "category"], "case-1",
                                        {"status": "O", "category": "1-URGENT"})
    page = paging.page_with_total(found, [("created_at", "desc"), ("case_id", "desc")], 50)
    return page.select("case_id", "case_number", "status", text("created_at"), "total_count")


@query("high_risk_top", with_views("entity") + """
SELECT country, full_name, risk_score FROM entity WHERE risk_score >= 80 AND country = 'NATION_3'
ORDER BY risk_score DESC, entity_id LIMIT 10""")
def high_risk_top(spark, sf):
    return warehouse.high_risk_top(view(spark, sf, "entity"), "NATION_3").select("country", "full_name", "risk_score")


@query("multi_account_flag", with_views("bank") + """
SELECT entity_id, count(*) AS bank_count FROM bank GROUP BY entity_id HAVING count(*) >= 5
ORDER BY bank_count DESC, entity_id""")
def multi_account_flag(spark, sf):
    return warehouse.multi_account_entities(view(spark, sf, "bank")).orderBy(F.desc("bank_count"), "entity_id")


@query("current_as_of", with_views("work_session") + """
SELECT session_id, user_id, CAST(started_at AS VARCHAR) AS started_at FROM work_session
WHERE started_at <= TIMESTAMP '1998-01-01' AND (ended_at IS NULL OR ended_at > TIMESTAMP '1998-01-01')""")
def current_as_of(spark, sf):
    valid = filters.current_as_of(view(spark, sf, "work_session"), NOW, "started_at", "ended_at")
    return valid.select("session_id", "user_id", text("started_at"))


@query("get_by_pk", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50)""")
def get_by_pk(spark, sf):
    wanted = table(spark, sf, "lineitem").where("l_quantity >= 50").select(F.col("l_orderkey").alias("o_orderkey"))
    return filters.get_by_key(table(spark, sf, "orders"), "o_orderkey", wanted).select("o_orderkey", "o_custkey", "o_orderstatus")


# ---- pages --------------------------------------------------------------------------------------


@query("keyset_page", with_views("record") + f"""
SELECT {RECORD_COLS}, (SELECT count(*) > 50 FROM record) AS has_more
FROM record ORDER BY record.value DESC, id LIMIT 25 OFFSET 25""")
def keyset_page(spark, sf):
    r = view(spark, sf, "record")
    first = paging.keyset_page(r, BY_VALUE, 25)
    return record_rows(paging.keyset_page(r, BY_VALUE, 25, paging.next_cursor(first, BY_VALUE)), "has_more")


@query("keyset_cursor", with_views("record") + """
SELECT id, to_base64(encode('{"value":' || CAST(value AS VARCHAR) || ',"id":' || CAST(id AS VARCHAR) || '}')) AS cursor,
       CAST(value AS DOUBLE) AS decoded_value, id AS decoded_id
FROM record ORDER BY value DESC, id LIMIT 25""")
def keyset_cursor(spark, sf):
    r = view(spark, sf, "record")
    page = paging.offset_page(r, BY_VALUE, 25).withColumn("cursor", paging.cursor_column(BY_VALUE))
    keys = page.select("value", "id").schema
    decoded = page.withColumn("decoded", paging.decode_cursor(F.col("cursor"), keys))
    return decoded.select("id", "cursor", F.col("decoded.value").cast("double").alias("decoded_value"),
                          F.col("decoded.id").alias("decoded_id"))


@query("offset_page", with_views("record") + f"""
SELECT {RECORD_COLS}, (SELECT count(*) FROM record) AS total_count FROM record ORDER BY id LIMIT 40 OFFSET 100""")
def offset_page(spark, sf):
    return record_rows(paging.page_with_total(view(spark, sf, "record"), [("id", "asc")], 40, 100), "total_count")


@query("children_order", with_views("bank") + """
SELECT entity_id, id, is_primary, CAST(opened_at AS VARCHAR) AS opened_at FROM bank WHERE is_active
ORDER BY entity_id, is_primary DESC, opened_at DESC NULLS LAST, id""")
def children_order(spark, sf):
    live = view(spark, sf, "bank").where("is_active")
    order = [("is_primary", "desc"), ("opened_at", "desc"), ("id", "asc")]
    return paging.children_in_order(live, "entity_id", order).select("entity_id", "id", "is_primary", text("opened_at"))


@query("page_with_total", with_views("entity") + """
SELECT entity_id, risk_score, (SELECT count(*) FROM entity WHERE risk_score >= 50) AS total_count
FROM entity WHERE risk_score >= 50 ORDER BY risk_score DESC, entity_id DESC LIMIT 20 OFFSET 20""")
def page_with_total(spark, sf):
    found = view(spark, sf, "entity").where("risk_score >= 50")
    page = paging.page_with_total(found, [("risk_score", "desc"), ("entity_id", "desc")], 20, 20)
    return page.select("entity_id", "risk_score", "total_count")


# ---- joins --------------------------------------------------------------------------------------


@query("entity_cases", with_views("case_file", "case_role") + """
SELECT r.entity_id, r.case_id, c.case_number, r.role, CAST(c.created_at AS VARCHAR) AS created_at
FROM case_file c JOIN case_role r ON c.case_id = r.case_id
WHERE NOT c.is_deleted ORDER BY c.created_at DESC, r.case_id, r.entity_id, r.role""")
def entity_cases(spark, sf):
    linked = joins.entity_cases(view(spark, sf, "case_file"), view(spark, sf, "case_role"))
    return (linked.orderBy(F.desc("created_at"), "case_id", "entity_id", "role")
            .select("entity_id", "case_id", "case_number", "role", text("created_at")))


@query("case_entities", with_views("case_file", "case_role") + """
SELECT c.case_id, s.s_name AS name, r.role FROM case_file c JOIN case_role r ON c.case_id = r.case_id
JOIN supplier s ON s.s_suppkey = r.entity_id WHERE NOT c.is_deleted""")
def case_entities(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("entity_id"), F.col("s_name").alias("name"))
    linked = joins.case_entities(view(spark, sf, "case_file"), view(spark, sf, "case_role"), suppliers)
    return linked.orderBy("case_id", "role", "name").select("case_id", "name", "role")


@query("entity_categories", with_views("category", "tag") + """
SELECT t.entity_id, string_agg(c.name, ';' ORDER BY c.name, c.category_id) AS category_names,
       string_agg(CAST(c.category_id AS VARCHAR), ';' ORDER BY c.name, c.category_id) AS category_ids
FROM tag t JOIN category c ON c.category_id = t.category_id AND c.is_active GROUP BY t.entity_id""")
def entity_categories(spark, sf):
    out = tags.entity_categories(view(spark, sf, "tag"), view(spark, sf, "category"))
    return out.select("entity_id", F.array_join("category_names", ";").alias("category_names"),
                      F.array_join(F.col("category_ids").cast("array<string>"), ";").alias("category_ids"))


@query("category_members", with_views("tag", "app_user") + """
SELECT t.entity_id, t.entity_type, u.role AS user_role, CAST(t.assigned_at AS VARCHAR) AS assigned_at
FROM (SELECT *, CASE WHEN assigned_at < TIMESTAMP '1998-01-01' THEN 'user' ELSE 'entity' END AS entity_type FROM tag) t
LEFT JOIN app_user u ON t.entity_type = 'user' AND u.id = t.entity_id
WHERE t.category_id = 1""")
def category_members(spark, sf):
    kind = F.when(F.col("assigned_at") < F.lit(NOW).cast("timestamp_ntz"), "user").otherwise("entity")
    typed = view(spark, sf, "tag").withColumn("entity_type", kind)
    members = tags.category_members(typed, view(spark, sf, "app_user"), 1, ["role"])
    return (members.orderBy(F.desc("assigned_at"), "entity_id")
            .select("entity_id", "entity_type", F.col("role").alias("user_role"), text("assigned_at")))


@query("tag_any", with_views("entity", "tag") + """
SELECT entity_id, full_name FROM entity e WHERE EXISTS
 (SELECT 1 FROM tag t WHERE t.entity_id = e.entity_id AND t.category_id IN (1, 2))""")
def tag_any(spark, sf):
    return tags.tag_any(view(spark, sf, "entity"), view(spark, sf, "tag"), [1, 2]).select("entity_id", "full_name")


@query("tag_all", with_views("entity", "tag") + """
SELECT entity_id, full_name FROM entity e WHERE
 (SELECT count(DISTINCT category_id) FROM tag t WHERE t.entity_id = e.entity_id AND t.category_id IN (1, 2, 3)) = 3""")
def tag_all(spark, sf):
    return tags.tag_all(view(spark, sf, "entity"), view(spark, sf, "tag"), [1, 2, 3]).select("entity_id", "full_name")


_INCOMING = "SELECT DISTINCT o_custkey AS entity_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS category_id FROM orders"


@query("insert_absent", with_views("tag") + f"""
SELECT category_id, count(*) AS n, CAST(sum(entity_id) AS BIGINT) AS ids FROM
 (SELECT entity_id, category_id FROM tag UNION SELECT entity_id, category_id FROM ({_INCOMING})) GROUP BY category_id""")
def insert_absent(spark, sf):
    key = ["entity_id", "category_id"]
    have = view(spark, sf, "tag").select(*key)
    incoming = table(spark, sf, "orders").select(
        F.col("o_custkey").alias("entity_id"), F.substring("o_orderpriority", 1, 1).cast("int").alias("category_id"))
    return (joins.insert_absent(have, incoming, key).groupBy("category_id")
            .agg(F.count(F.lit(1)).alias("n"), F.sum("entity_id").alias("ids")))


@query("remove_matching", with_views("tag", "entity") + """
SELECT entity_id, category_id FROM tag WHERE entity_id NOT IN (SELECT entity_id FROM entity WHERE status = 'building')""")
def remove_matching(spark, sf):
    doomed = view(spark, sf, "entity").where("status = 'building'")
    return joins.remove_matching(view(spark, sf, "tag"), doomed, ["entity_id"]).select("entity_id", "category_id")


@query("contact_match", with_views("entity") + """
SELECT r.entity_id, least((SELECT min(m.entity_id) FROM entity m WHERE m.primary_email = r.primary_email),
                          (SELECT min(m.entity_id) FROM entity m WHERE m.primary_phone = r.primary_phone)) AS matched_id
FROM entity r""")
def contact_match(spark, sf):
    e = view(spark, sf, "entity")
    return joins.match_by_either(e, e, "entity_id", "entity_id", ["primary_email", "primary_phone"])


@query("column_catalog_match", """
WITH cat AS (SELECT table_name, column_name FROM duckdb_columns() WHERE table_name IN ('customer', 'supplier', 'part', 'nation', 'region')
             AND data_type = 'VARCHAR')
SELECT c.table_name, c.column_name, n.row_count
FROM cat c JOIN (SELECT 'customer' AS t, count(*) AS row_count FROM customer UNION ALL SELECT 'supplier', count(*) FROM supplier
  UNION ALL SELECT 'part', count(*) FROM part UNION ALL SELECT 'nation', count(*) FROM nation
  UNION ALL SELECT 'region', count(*) FROM region) n ON n.t = c.table_name
WHERE (contains(c.table_name, 'na') OR contains(c.column_name, 'na'))""")
def column_catalog_match(spark, sf):
    names = ["customer", "supplier", "part", "nation", "region"]
    tables = {n: table(spark, sf, n) for n in names}
    catalog = joins.column_catalog(tables, spark)
    hits = joins.column_catalog_match(catalog, "na", ["name", "title", "email"])
    sizes = warehouse.union_all([df.agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit(n))
                                 for n, df in tables.items()])
    return hits.join(sizes, "table_name").select("table_name", "column_name", "row_count")


# ---- summaries ----------------------------------------------------------------------------------

_FIN = """SELECT entity_id, count(*) AS account_count, sum(total_credit) AS total_credit, sum(total_debit) AS total_debit,
  sum(total_credit) - sum(total_debit) AS net_balance FROM bank WHERE is_active GROUP BY entity_id"""
_FIN_OUT = """SELECT entity_id, account_count, CAST(total_credit AS DOUBLE) AS total_credit,
  CAST(total_debit AS DOUBLE) AS total_debit, CAST(net_balance AS DOUBLE) AS net_balance"""


def _financial_rows(df):
    return df.select("entity_id", "account_count", money("total_credit"), money("total_debit"), money("net_balance"))


@query("financial_summary", with_views("bank") + f"{_FIN_OUT} FROM ({_FIN})")
def financial_summary(spark, sf):
    return _financial_rows(warehouse.financial_summary(view(spark, sf, "bank")))


@query("high_debit", with_views("bank") + f"{_FIN_OUT} FROM ({_FIN}) WHERE total_debit > total_credit AND total_credit > 0")
def high_debit(spark, sf):
    return _financial_rows(warehouse.high_debit(warehouse.financial_summary(view(spark, sf, "bank"))))


@query("risk_buckets", with_views("entity") + """
SELECT status, country, CAST(floor(risk_score / 10) * 10 AS BIGINT) AS risk_bucket, count(*) AS entity_count,
       round(avg(risk_score), 6) AS avg_risk, '1998-01-01' AS analysis_date
FROM entity GROUP BY status, country, floor(risk_score / 10) * 10""")
def risk_buckets(spark, sf):
    out = warehouse.risk_buckets(view(spark, sf, "entity"), F.lit(NOW).cast("date"))
    return out.select("status", "country", F.col("risk_bucket").cast("bigint").alias("risk_bucket"), "entity_count",
                      F.round("avg_risk", 6).alias("avg_risk"), text("analysis_date"))


@query("record_stats", with_views("record") + """
SELECT count(*) AS total, count(DISTINCT category) AS categories, CAST(coalesce(sum(value), 0) AS DOUBLE) AS total_value,
       round(CAST(coalesce(avg(value), 0) AS DOUBLE), 4) AS avg_value FROM record""")
def record_stats(spark, sf):
    out = warehouse.record_stats(view(spark, sf, "record"))
    return out.select("total", "categories", money("total_value"), F.round(F.col("avg_value").cast("double"), 4).alias("avg_value"))


@query("user_stats", with_views("app_user") + """
SELECT count(*) AS total_users, count(*) FILTER (WHERE role = 'admin') AS admins,
       count(*) FILTER (WHERE role = 'user') AS regular_users,
       count(*) FILTER (WHERE created_on > DATE '2022-01-01' - INTERVAL 7 DAYS) AS new_this_week,
       count(*) FILTER (WHERE last_login_at IS NOT NULL) AS ever_logged_in FROM app_user""")
def user_stats(spark, sf):
    return warehouse.user_stats(view(spark, sf, "app_user"), F.lit("2022-01-01").cast("date"))


@query("api_key_stats", with_views("api_key") + """
SELECT count(*) AS total_keys, count(*) FILTER (WHERE NOT revoked) AS active_keys,
       count(*) FILTER (WHERE last_used_at > TIMESTAMP '1998-01-01' - INTERVAL 24 HOURS) AS used_today,
       count(*) FILTER (WHERE expires_at < TIMESTAMP '1998-01-01') AS expired FROM api_key""")
def api_key_stats(spark, sf):
    return warehouse.api_key_stats(view(spark, sf, "api_key"), F.lit(NOW).cast("timestamp_ntz"))


@query("category_assignment_stats", with_views("category", "tag") + """
SELECT c.name, c.is_active, count(t.entity_id) AS assignment_count FROM category c
LEFT JOIN tag t ON t.category_id = c.category_id AND t.assigned_at > TIMESTAMP '1998-01-01'
GROUP BY c.category_id, c.name, c.is_active ORDER BY assignment_count DESC, c.name LIMIT 20""")
def category_assignment_stats(spark, sf):
    recent = view(spark, sf, "tag").where(F.col("assigned_at") > F.lit(NOW).cast("timestamp_ntz"))
    out = tags.assignment_stats(view(spark, sf, "category"), recent)
    return (out.orderBy(F.desc("assignment_count"), "name").limit(20)
            .select("name", "is_active", "assignment_count"))


@query("tag_stats", with_views("category", "tag") + """
SELECT c.category_id, c.name AS tag_name, count(t.entity_id) AS entity_count, CAST(max(t.assigned_at) AS VARCHAR) AS last_assigned_at
FROM category c LEFT JOIN tag t ON t.category_id = c.category_id GROUP BY c.category_id, c.name""")
def tag_stats(spark, sf):
    out = tags.assignment_stats(view(spark, sf, "category"), view(spark, sf, "tag"))
    return out.select("category_id", F.col("name").alias("tag_name"), F.col("assignment_count").alias("entity_count"),
                      text("last_assigned_at"))


@query("source_overview", """
SELECT 'people' AS source, 2 AS table_count, (SELECT count(*) FROM customer) + (SELECT count(*) FROM supplier) AS total_rows, 3 AS text_columns
UNION ALL SELECT 'goods', 1, (SELECT count(*) FROM part), 3
UNION ALL SELECT 'places', 2, (SELECT count(*) FROM nation) + (SELECT count(*) FROM region), 2""")
def source_overview(spark, sf):
    where = {"customer": "people", "supplier": "people", "part": "goods", "nation": "places", "region": "places"}
    out = warehouse.source_overview({n: (s, table(spark, sf, n)) for n, s in where.items()})
    return out.select("source", F.col("table_count").cast("int").alias("table_count"), "total_rows",
                      F.col("text_columns").cast("int").alias("text_columns"))




@query("warehouse_cube", with_views("entity", "anchor", "bank", "social", "property") + """
SELECT e.entity_id, e.first_name || ' ' || e.last_name AS full_name, e.risk_score, e.status, coalesce(a.id_types, '') AS id_types,
       coalesce(b.n, 0) AS bank_count, coalesce(s.n, 0) AS social_count, coalesce(p.n, 0) AS property_count,
       CAST(coalesce(p.v, 0) AS DOUBLE) AS net_asset_value, e.country, CAST(year(e.created_on) AS INT) AS year
FROM entity e
LEFT JOIN (SELECT entity_id, string_agg(DISTINCT id_type, ',' ORDER BY id_type) AS id_types FROM anchor GROUP BY entity_id) a USING (entity_id)
LEFT JOIN (SELECT entity_id, count(DISTINCT id) AS n FROM bank WHERE is_active GROUP BY entity_id) b USING (entity_id)
LEFT JOIN (SELECT entity_id, count(DISTINCT id) AS n FROM social WHERE is_active GROUP BY entity_id) s USING (entity_id)
LEFT JOIN (SELECT entity_id, count(DISTINCT id) AS n, sum(current_value) AS v FROM property GROUP BY entity_id) p USING (entity_id)""")
def warehouse_cube(spark, sf):
    parts = [view(spark, sf, n) for n in ("entity", "anchor", "bank", "social", "property")]
    out = warehouse.warehouse_cube(*parts)
    return (out.withColumn("id_types", F.array_join("id_types", ","))
            .withColumn("net_asset_value", F.col("net_asset_value").cast("double")))


# ---- unions -------------------------------------------------------------------------------------


@query("union_all_count", """
SELECT count(*) AS matches FROM (SELECT c_name AS name FROM customer UNION ALL SELECT s_name FROM supplier
  UNION ALL SELECT p_name FROM part) WHERE contains(lower(name), '00')""")
def union_all_count(spark, sf):
    names = [table(spark, sf, t).select(F.col(c).alias("name"))
             for t, c in (("customer", "c_name"), ("supplier", "s_name"), ("part", "p_name"))]
    return warehouse.union_all(names).where(filters.contains_text("name", "00")).agg(F.count(F.lit(1)).alias("matches"))
