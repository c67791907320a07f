"""Views that give the driver's tables the shape of the entity model.

The text is portable SQL, so the same definition feeds Spark and, as a CTE, the comparison SQL.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

from casegrain.session import spread

VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "entity": (("customer", "nation", "region"), """
SELECT c.c_custkey AS entity_id, c.c_name AS full_name, 'Customer' AS first_name, substr(c.c_name, 10) AS last_name,
       lower(c.c_mktsegment) AS status, CAST((c.c_custkey * 37) % 101 AS INT) AS risk_score,
       n.n_name AS country, r.r_name AS city, CAST(c.c_acctbal AS DECIMAL(18,2)) AS balance,
       concat('user', CAST(c.c_custkey % 97 AS STRING), '@example.com') AS primary_email,
       CAST(6000000000 + c.c_custkey % 89 AS STRING) AS primary_phone,
       DATE '1950-01-01' + CAST((c.c_custkey * 37) % 20000 AS INT) AS date_of_birth,
       DATE '2020-01-01' + CAST((c.c_custkey * 13) % 1500 AS INT) AS created_on
FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey JOIN region r ON n.n_regionkey = r.r_regionkey"""),
    "anchor": (("documents",), """
SELECT doc_id AS id, doc_id AS entity_id, lang AS id_type, trim(text) AS id_number, doc_id % 3 = 0 AS is_verified,
       doc_id % 7 = 0 AS is_primary, source AS issuing_country
FROM documents"""),
    "bank": (("orders",), """
SELECT o_orderkey AS id, o_custkey AS entity_id, o_orderpriority AS bank_name, o_orderstatus AS account_type,
       CAST(100000000000 + o_orderkey AS STRING) AS account_number,
       CAST(CASE WHEN o_orderstatus = 'F' THEN o_totalprice ELSE 0 END AS DECIMAL(18,2)) AS total_credit,
       CAST(CASE WHEN o_orderstatus = 'O' THEN o_totalprice ELSE 0 END AS DECIMAL(18,2)) AS total_debit,
       o_orderstatus <> 'P' AS is_active, o_orderkey % 5 = 0 AS is_primary, CAST(o_orderdate AS DATE) AS opened_at
FROM orders"""),
    "social": (("events",), """
SELECT event_id AS id, user_id AS entity_id, event_type AS platform, replace(replace(props, '{"k": ', ''), '}', '') AS handle,
       CAST(floor(value) AS BIGINT) AS follower_count, event_id % 10 <> 0 AS is_active, ts AS created_at
FROM events"""),
    "property": (("lineitem", "orders"), """
SELECT l.l_orderkey * 10 + l.l_linenumber AS id, o.o_custkey AS entity_id, l.l_returnflag AS property_type,
       CAST(l.l_extendedprice AS DECIMAL(18,2)) AS current_value, l.l_linestatus = 'O' AS is_active
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""),
    "remark": (("events",), """
SELECT event_id AS id, user_id AS entity_id, event_type AS severity, event_id % 4 = 0 AS is_confidential, ts AS created_at
FROM events"""),
    "category": (("orders",), """
SELECT DISTINCT CAST(substr(o_orderpriority, 1, 1) AS INT) AS category_id, substr(o_orderpriority, 3) AS name,
       o_orderpriority NOT LIKE '4%' AS is_active
FROM orders"""),
    "tag": (("orders",), """
SELECT o_custkey AS entity_id, CAST(substr(o_orderpriority, 1, 1) AS INT) AS category_id, max(o_orderdate) AS assigned_at
FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey, CAST(substr(o_orderpriority, 1, 1) AS INT)"""),
    "case_file": (("orders",), """
SELECT o_orderkey AS case_id, concat('CASE-', CAST(o_orderkey AS STRING)) AS case_number, o_orderpriority AS category,
       o_orderstatus AS status, o_orderdate AS created_at, o_orderkey % 50 = 0 AS is_deleted
FROM orders"""),
    "case_role": (("lineitem",), """
SELECT DISTINCT l_orderkey AS case_id, l_suppkey AS entity_id, l_linestatus AS role FROM lineitem"""),
    "record": (("part",), """
SELECT p_partkey AS id, p_name AS name, p_type AS category, p_brand AS status, CAST(p_retailprice AS DECIMAL(15,2)) AS value
FROM part"""),
    "change_log": (("events",), """
SELECT event_id, user_id AS pk, CASE event_type WHEN 'signup' THEN 'INSERT' WHEN 'error' THEN 'DELETE' ELSE 'UPDATE' END AS op,
       value, ts AS updated_at
FROM events"""),
    "access_log": (("events",), """
SELECT event_id AS id, user_id, event_type AS action, replace(replace(props, '{"k": ', ''), '}', '') AS endpoint, ts AS created_at
FROM events"""),
    "work_session": (("orders", "lineitem"), """
SELECT o.o_orderkey AS session_id, o.o_custkey AS user_id, o.o_orderdate AS started_at,
       max(CASE WHEN o.o_orderstatus = 'P' THEN NULL ELSE l.l_shipdate END) AS ended_at
FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey
GROUP BY o.o_orderkey, o.o_custkey, o.o_orderdate"""),
    "app_user": (("customer", "orders"), """
SELECT c.c_custkey AS id, CASE WHEN c.c_custkey % 20 = 0 THEN 'admin' ELSE 'user' END AS role,
       DATE '2020-01-01' + CAST((c.c_custkey * 13) % 1500 AS INT) AS created_on, max(o.o_orderdate) AS last_login_at
FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F'
GROUP BY c.c_custkey"""),
    "api_key": (("orders",), """
SELECT o_orderkey AS id, o_custkey AS user_id, o_orderstatus = 'P' AS revoked, o_orderdate AS last_used_at,
       CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE o_orderdate + INTERVAL '365' DAY END AS expires_at
FROM orders"""),
    "people": (("customer", "supplier"), """
SELECT 'customer' AS source_table, c_custkey AS id, c_name AS name, c_nationkey AS nationkey FROM customer
UNION ALL
SELECT 'supplier' AS source_table, s_suppkey AS id, s_name AS name, s_nationkey AS nationkey FROM supplier"""),
}


_SCHEMAS: dict[tuple[str, str], StructType] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables. Its schema is read from the footers once per application, not once per query."""
    path = f"{sf_dir}/{name}.parquet"
    known = (spark.sparkContext.applicationId, path)
    if known not in _SCHEMAS:
        _SCHEMAS[known] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[known]).parquet(path)


def view(spark: SparkSession, sf_dir: str, name: str, dealt: Mapping[str, Sequence[str]] | None = None) -> DataFrame:
    """One of the views above over the tables in ``sf_dir``.

    ``dealt``: base tables whose rows go to all tasks by the first of the columns named, the only ones that the view reads.
    """
    needed, text = VIEWS[name]
    for base in needed:
        rows = table(spark, sf_dir, base)
        if dealt and base in dealt:
            rows = spread(rows.select(*dealt[base]), dealt[base][0])
        rows.createOrReplaceTempView(base)
    return spark.sql(text)


def with_views(*names: str) -> str:
    """``WITH`` clause naming the views, to put before the comparison SQL."""
    text = ",\n".join(f"{name} AS ({VIEWS[name][1]})" for name in names)
    return f"WITH {text}\n".replace("explode(", "unnest(")  # the one spelling the engines do not share
