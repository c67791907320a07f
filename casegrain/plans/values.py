"""Column functions run over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain.functions import identity, masking, sql_functions, values
from casegrain.operators import tags as tagging
from casegrain.operators.warehouse import union_all
from casegrain.plans.registry import query
from casegrain.plans.views import VIEWS, table, view, with_views
from casegrain.session import spread, stored

C = F.col

# Identifiers of every kind, spelled from the keys of the tables.
VIEWS["identifier"] = (("customer",), """
SELECT c_custkey AS entity_id, k.kind, CASE k.kind
    WHEN 'aadhaar' THEN concat('4000 ', substr(c_name, 10, 4), '-', substr(c_name, 14, 4))
    WHEN 'pan' THEN concat(' abcde', substr(c_name, 15, 4), 'f ')
    WHEN 'passport' THEN concat('K1', substr(c_name, 12, 7))
    WHEN 'driving_license' THEN concat('MH12 2011', substr(c_name, 12, 7))
    WHEN 'voter_id' THEN concat('ABC/', substr(c_name, 12, 7))
    WHEN 'bank' THEN substr(c_name, 10, 9)
    WHEN 'ifsc' THEN concat('hdfc0', substr(c_name, 13, 6))
    WHEN 'email' THEN concat(lower(c_mktsegment), CAST(c_custkey AS STRING), '@Example.com')
    WHEN 'phone' THEN CAST(6000000000 + c_custkey AS STRING)
    WHEN 'short' THEN substr(c_name, 17)
    ELSE c_name END AS value
FROM (SELECT c_custkey, c_name, c_mktsegment,
      explode(split('aadhaar,pan,passport,driving_license,voter_id,bank,ifsc,email,phone,short,name', ',')) AS kind FROM customer) k""")

_COMPACT = "upper(regexp_replace(trim(value), '[ /-]', '', 'g'))"
_CLASSIFY = "CASE " + " ".join(
    f"WHEN regexp_matches({'lower(value)' if k == 'email' else _COMPACT}, '{p}') THEN '{k}'" for k, p in values.ID_PATTERNS
) + " ELSE 'general' END"


@query("classify_value", with_views("identifier", "bank") + f"""
SELECT kind, {_CLASSIFY} AS value_type, count(*) AS n FROM (SELECT kind, value FROM identifier UNION ALL
  SELECT 'account', account_number FROM bank UNION ALL SELECT 'document', trim(text) FROM documents) GROUP BY ALL""")
def classify_value(spark, sf):
    rows = union_all([
        view(spark, sf, "identifier").select("kind", "value"),
        view(spark, sf, "bank").select(F.lit("account").alias("kind"), C("account_number").alias("value")),
        table(spark, sf, "documents").select(F.lit("document").alias("kind"), F.trim("text").alias("value")),
    ])
    return (rows.groupBy("kind", values.classify_value(C("value")).alias("value_type"))
            .agg(F.count(F.lit(1)).alias("n")))


def _masked(name, fn, sql):
    @query(name, with_views("identifier") + f"SELECT entity_id, kind, {sql} AS masked FROM identifier")
    def run(spark, sf):
        return view(spark, sf, "identifier").select("entity_id", "kind", fn(C("value")).alias("masked"))


def _last(value, visible, short):
    return (f"CASE WHEN length({value}) < {visible} THEN '{'X' * short}' || {value} "
            f"ELSE repeat('X', length({value}) - {visible}) || right({value}, {visible}) END")


_EMAIL = """CASE WHEN strpos(trim(value), '@') <= 1 THEN '***@***'
  WHEN strpos(trim(value), '@') = 2 THEN left(trim(value), 1) || '***' || substr(trim(value), 2)
  ELSE left(trim(value), 1) || repeat('*', strpos(trim(value), '@') - 2) || substr(trim(value), strpos(trim(value), '@')) END"""

_masked("mask_aadhaar", masking.mask_aadhaar, "'XXXX-XXXX-' || right(regexp_replace(value, '[ -]', '', 'g'), 4)")
_masked("mask_pan", masking.mask_pan,
        "'XXXXX' || CASE WHEN length(trim(value)) < 5 THEN upper(trim(value)) ELSE substr(upper(trim(value)), 6) END")
_masked("mask_passport", masking.mask_passport, _last("upper(trim(value))", 2, 7))
_masked("mask_driving_license", masking.mask_driving_license, _last("upper(trim(value))", 3, 10))
_masked("mask_phone", masking.mask_phone, _last("trim(value)", 4, 6))
_masked("mask_bank_account", masking.mask_bank_account, _last("trim(value)", 4, 6))
_masked("mask_email", masking.mask_email, _EMAIL)
_masked("mask_lookahead", masking.mask_all_but_four,
        "CASE WHEN length(value) <= 4 THEN value ELSE repeat('X', length(value) - 4) || right(value, 4) END")


@query("mask_doc_number", with_views("identifier") + f"""
SELECT entity_id, kind, CASE WHEN kind = 'voter_id' THEN 'STORED-' || entity_id
  WHEN kind = 'aadhaar' THEN 'XXXX-XXXX-' || right(regexp_replace(value, '[ -]', '', 'g'), 4)
  WHEN kind = 'pan' THEN 'XXXXX' || substr(upper(trim(value)), 6)
  WHEN kind = 'driving_license' THEN {_last("upper(trim(value))", 3, 10)}
  ELSE {_last("upper(trim(value))", 2, 7)} END AS masked FROM identifier""")
def mask_doc_number(spark, sf):
    stored = F.when(C("kind") == "voter_id", F.concat(F.lit("STORED-"), C("entity_id"))).otherwise("")
    return view(spark, sf, "identifier").select(
        "entity_id", "kind", masking.mask_document(F.upper("kind"), C("value"), stored).alias("masked"))


@query("id_hash", with_views("identifier", "anchor") + """
SELECT kind, entity_id, sha256(upper(trim(value))) AS hash FROM identifier
UNION ALL SELECT 'document', entity_id, sha256(trim(id_number)) FROM anchor""")
def id_hash(spark, sf):
    ids = view(spark, sf, "identifier").select("kind", "entity_id", identity.id_hash(C("value")).alias("hash"))
    # Free text keeps its case here: engines disagree on upper-casing letters outside ASCII.
    texts = view(spark, sf, "anchor").select(F.lit("document").alias("kind"), "entity_id",
                                             identity.id_hash(C("id_number"), fold=lambda c: c).alias("hash"))
    return ids.unionByName(texts)


_KEYED = {"customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey"}
_KEYED_SQL = " UNION ALL ".join(f"SELECT '{t}' AS table_name, {k} AS pk FROM {t}" for t, k in _KEYED.items())


def _keyed(spark, sf):
    return {t: table(spark, sf, t).select(F.lit(t).alias("table_name"), C(k).alias("pk")) for t, k in _KEYED.items()}


@query("entity_key", f"""
SELECT table_name, pk, CAST(CAST('0x' || substr(md5(table_name || ':' || pk), 1, 16) AS UBIGINT) AS VARCHAR) AS entity_key
FROM ({_KEYED_SQL})""")
def entity_key(spark, sf):
    rows = union_all(list(_keyed(spark, sf).values()))
    return rows.withColumn("entity_key", identity.entity_key(C("table_name"), C("pk")).cast("string"))


_FNV = f"""list_reduce(list_transform(range(1, length(t) + 1), lambda i: CAST(ord(substr(t, i, 1)) AS HUGEINT)),
  lambda acc, b: (xor(acc, b) * {identity.FNV_PRIME}::HUGEINT) % 18446744073709551616::HUGEINT, {identity.FNV_OFFSET}::HUGEINT)"""


@query("token_hash", f"""
SELECT t AS token, CAST({_FNV} AS VARCHAR) AS token_hash FROM (
  SELECT DISTINCT lower(x) AS t FROM (SELECT p_name AS x FROM part UNION ALL SELECT c_name FROM customer UNION ALL SELECT o_orderpriority FROM orders))""")
def token_hash(spark, sf):
    words = union_all([table(spark, sf, t).select(F.lower(c).alias("token"))
                       for t, c in (("part", "p_name"), ("customer", "c_name"), ("orders", "o_orderpriority"))]).distinct()
    return words.withColumn("token_hash", identity.token_hash(C("token")).cast("string"))


_GID_SQL = " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, {k} AS pk, CAST({identity.table_id(t)}::HUGEINT * 281474976710656 + {k} AS VARCHAR) AS global_id, "
    f"{identity.table_id(t)} AS table_id, {k} AS row_id FROM {t}" for t, k in _KEYED.items())


@query("global_id", _GID_SQL)
def global_id(spark, sf):
    packed = union_all([df.withColumn("gid", identity.pack_global_id(t, C("pk"))) for t, df in _keyed(spark, sf).items()])
    return packed.select("table_name", "pk", C("gid").cast("string").alias("global_id"),
                         identity.unpack_table_id(C("gid")).alias("table_id"), identity.unpack_row_id(C("gid")).alias("row_id"))


def look_alikes(spark, sf):
    """Tables about different kinds of things under the column names entities use."""
    e = view(spark, sf, "entity").select(F.lit("customer").alias("src"), C("entity_id").alias("id"), "first_name", "last_name", "city", "status")
    s = table(spark, sf, "supplier").select(F.lit("supplier").alias("src"), C("s_suppkey").alias("id"), C("s_name").alias("company_name"))
    p = table(spark, sf, "part").select(F.lit("part").alias("src"), C("p_partkey").alias("id"), C("p_name").alias("product_name"), C("p_size").alias("size"))
    n = table(spark, sf, "nation").select(F.lit("nation").alias("src"), C("n_nationkey").cast("bigint").alias("id"), C("n_name").alias("name"))
    return union_all([e, s, p, n])


LOOK_ALIKES_SQL = with_views("entity") + """, look AS (
SELECT 'customer' AS src, entity_id AS id, first_name, last_name, city, status, NULL AS company_name, NULL AS product_name, NULL AS size, NULL AS name FROM entity
UNION ALL SELECT 'supplier', s_suppkey, NULL, NULL, NULL, NULL, s_name, NULL, NULL, NULL FROM supplier
UNION ALL SELECT 'part', p_partkey, NULL, NULL, NULL, NULL, NULL, p_name, p_size, NULL FROM part
UNION ALL SELECT 'nation', n_nationkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL, n_name FROM nation)
"""
KIND_SQL = """CASE WHEN first_name IS NOT NULL OR last_name IS NOT NULL THEN 'person' WHEN company_name IS NOT NULL THEN 'company'
  WHEN product_name IS NOT NULL THEN 'product' ELSE 'generic' END"""
NAME_SQL = """CASE WHEN first_name IS NOT NULL OR last_name IS NOT NULL THEN trim(coalesce(first_name, '') || ' ' || coalesce(last_name, ''))
  ELSE coalesce(company_name, product_name, name, 'Unknown') END"""
SEARCH_TEXT_SQL = """lower(concat_ws(' ', first_name, last_name, company_name, city, src, CASE WHEN id <> 0 THEN CAST(id AS VARCHAR) END, status,
  product_name, CASE WHEN size <> 0 THEN CAST(size AS VARCHAR) END, name))"""


@query("detect_entity_type", LOOK_ALIKES_SQL + f"SELECT src, id, {KIND_SQL} AS entity_type, {NAME_SQL} AS entity_name FROM look")
def detect_entity_type(spark, sf):
    rows = look_alikes(spark, sf)
    return rows.select("src", "id", values.entity_type(rows.columns).alias("entity_type"),
                       values.entity_name(rows.columns).alias("entity_name"))


@query("searchable_text", LOOK_ALIKES_SQL + f"SELECT src, id, {SEARCH_TEXT_SQL} AS searchable_text FROM look")
def searchable_text(spark, sf):
    rows = look_alikes(spark, sf)
    return rows.select("src", "id", values.searchable_text(rows.columns).alias("searchable_text"))


@query("trim_full_name", LOOK_ALIKES_SQL + """
SELECT src, id, trim(coalesce(first_name, name, '') || ' ' || coalesce(last_name, '')) AS full_name, coalesce(city, 'UNKNOWN') AS city FROM look""")
def trim_full_name(spark, sf):
    first = F.coalesce("first_name", "name", F.lit(""))
    return look_alikes(spark, sf).select("src", "id", values.full_name(first, C("last_name")).alias("full_name"),
                                         F.coalesce("city", F.lit("UNKNOWN")).alias("city"))


@query("null_defaults", LOOK_ALIKES_SQL + """
SELECT src, id, coalesce(nullif(status, ''), 'none') AS status, coalesce(size, -1) AS size FROM look""")
def null_defaults(spark, sf):
    return look_alikes(spark, sf).select("src", "id", values.null_default(C("status"), "none").alias("status"),
                                         F.coalesce("size", F.lit(-1)).alias("size"))


@query("highlight", """
SELECT doc_id, regexp_replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'),
  '(the)', '<mark class="hl">\\1</mark>', 'gi') AS marked FROM documents WHERE contains(lower(text), 'the')""")
def highlight(spark, sf):
    docs = table(spark, sf, "documents").where(F.contains(F.lower("text"), F.lit("the")))
    return docs.select("doc_id", values.highlight(C("text"), "The").alias("marked"))


@query("matched_columns", with_views("record") + """
SELECT id, concat_ws(',', CASE WHEN contains(lower(name), 'r') THEN 'name' END, CASE WHEN contains(lower(category), 'r') THEN 'category' END,
  CASE WHEN contains(lower(status), 'r') THEN 'status' END) AS matched FROM record""")
def matched_columns(spark, sf):
    cols = ["name", "category", "status"]
    return view(spark, sf, "record").select("id", F.array_join(values.matched_columns(cols, "R"), ",").alias("matched"))


@query("dup_tag", with_views("anchor") + """, firsts AS (
  SELECT id_type, id_number, arg_min(issuing_country, id) AS first_source, min(id) AS first_id FROM anchor GROUP BY id_type, id_number)
SELECT a.id, a.id > f.first_id AS has_ref,
       CASE WHEN a.id > f.first_id THEN a.id_type || ';duplicate_ref:' || f.first_source || '.' || a.id_type ELSE a.id_type END AS tags
FROM anchor a JOIN firsts f ON a.id_type = f.id_type AND a.id_number = f.id_number""")
def dup_tag(spark, sf):
    return values.with_duplicate_tag(anchors_with_duplicates(spark, sf)).select(
        "id", C("_has_duplicate_ref").alias("has_ref"), F.array_join("tags", ";").alias("tags"))


def anchors_with_duplicates(spark, sf):
    """Anchors with the source and type of the first record holding the same id, where that is another record."""
    hashed = view(spark, sf, "anchor").select("id", "id_type", "issuing_country", identity.id_hash(C("id_number"), fold=lambda c: c).alias("hash"))
    a = stored(hashed, "hashed")  # texts are read and hashed once, not for both sides of the join
    firsts = a.groupBy("id_type", "hash").agg(F.min_by("issuing_country", "id").alias("first_source"), F.min("id").alias("first_id"))
    repeated = C("id") > C("first_id")
    return (a.join(firsts, ["id_type", "hash"])
            .select("id", "id_type", F.array("id_type").alias("tags"), F.when(repeated, C("first_source")).alias("duplicate_db"),
                    F.when(repeated, C("id_type")).alias("duplicate_table")))


@query("distinct_dup_refs", with_views("anchor") + """, firsts AS (
  SELECT id_type, id_number, arg_min(issuing_country, id) AS first_source, min(id) AS first_id FROM anchor GROUP BY id_type, id_number)
SELECT DISTINCT f.first_source AS ref_database, a.id_type AS ref_table, 'duplicate' AS ref_type
FROM anchor a JOIN firsts f ON a.id_type = f.id_type AND a.id_number = f.id_number WHERE a.id > f.first_id""")
def distinct_dup_refs(spark, sf):
    refs = anchors_with_duplicates(spark, sf).where(C("duplicate_db").isNotNull())
    return refs.select(C("duplicate_db").alias("ref_database"), C("duplicate_table").alias("ref_table"),
                       F.lit("duplicate").alias("ref_type")).distinct()


@query("tag_match_any_all", with_views("tag", "category") + """, have AS (
  SELECT t.entity_id, list(c.name) AS names FROM tag t JOIN category c USING (category_id) WHERE c.is_active GROUP BY t.entity_id)
SELECT entity_id, list_contains(names, 'URGENT') OR list_contains(names, 'LOW') AS matches_any,
       list_contains(names, 'URGENT') AND list_contains(names, 'LOW') AS matches_all FROM have""")
def tag_match_any_all(spark, sf):
    have = tagging.entity_categories(view(spark, sf, "tag"), view(spark, sf, "category"))
    wanted = ["urgent", "Low"]
    return have.select("entity_id", tagging.tags_any(C("category_names"), wanted).alias("matches_any"),
                       tagging.tags_all(C("category_names"), wanted).alias("matches_all"))


@query("client_ip", with_views("access_log") + """
SELECT id, CASE WHEN action = 'click' THEN '10.0.0.' || endpoint || ', 172.16.0.1' WHEN action = 'view' THEN '10.1.0.' || endpoint
  ELSE '192.168.0.1:4000' END AS ip, 'GET /' || action || '/' || endpoint || ' → 200 (' || user_id || 'ms)' AS audit_action FROM access_log""")
def client_ip(spark, sf):
    log = view(spark, sf, "access_log")
    forwarded = F.when(C("action") == "click", F.concat(F.lit("10.0.0."), "endpoint", F.lit(", 172.16.0.1"))).otherwise("")
    real_ip = F.when(C("action") == "view", F.concat(F.lit("10.1.0."), "endpoint"))
    path = F.concat(F.lit("/"), "action", F.lit("/"), "endpoint")
    return log.select("id", values.client_ip(forwarded, real_ip, F.lit("192.168.0.1:4000")).alias("ip"),
                      values.audit_action(F.lit("GET"), path, F.lit(200), C("user_id")).alias("audit_action"))


@query("validate_values", with_views("entity") + """
SELECT rule, count(*) AS rows FROM (
  SELECT unnest(list_filter([CASE WHEN NOT regexp_matches(primary_email, '^[^\\s@]+@[^\\s@]+\\.[^\\s@]+$') THEN 'email_format' END,
    CASE WHEN NOT regexp_matches(full_name, '^[a-zA-Z0-9_]{3,30}$') THEN 'username_format' END,
    CASE WHEN risk_score NOT BETWEEN 0 AND 100 THEN 'risk_range' END,
    CASE WHEN status NOT IN ('active', 'inactive', 'flagged', 'deceased', 'unknown') THEN 'status_domain' END], lambda x: x IS NOT NULL)) AS rule
  FROM entity) GROUP BY rule""")
def validate_values(spark, sf):
    broken = view(spark, sf, "entity").select(F.explode(values.violations(values.entity_rules())).alias("rule"))
    return broken.groupBy("rule").agg(F.count(F.lit(1)).alias("rows"))


@query("validate_tables", with_views("entity", "anchor", "property", "bank", "social", "remark") + """
SELECT table_name, rule, count(*) AS rows FROM (
  SELECT 'entity' AS table_name, 'status_domain' AS rule FROM entity WHERE status NOT IN ('active', 'inactive', 'flagged', 'deceased', 'unknown')
  UNION ALL SELECT 'entity', 'risk_score_range' FROM entity WHERE risk_score NOT BETWEEN 0 AND 100
  UNION ALL SELECT 'anchor', 'id_type_domain' FROM anchor
    WHERE id_type NOT IN ('AADHAAR', 'PAN', 'PASSPORT', 'DRIVING_LICENSE', 'VOTER_ID', 'NPR', 'SSN', 'NIN', 'OTHER')
  UNION ALL SELECT 'property', 'property_type_domain' FROM property WHERE property_type NOT IN ('RESIDENTIAL', 'COMMERCIAL', 'AGRICULTURAL',
    'INDUSTRIAL', 'VACANT_LAND', 'VEHICLE', 'VESSEL', 'AIRCRAFT', 'JEWELRY', 'INTELLECTUAL_PROPERTY', 'OTHER')
  UNION ALL SELECT 'bank', 'account_type_domain' FROM bank
    WHERE account_type NOT IN ('SAVINGS', 'CURRENT', 'FIXED_DEPOSIT', 'NRE', 'NRO', 'DEMAT', 'CREDIT_CARD', 'LOAN', 'CRYPTO', 'OTHER')
  UNION ALL SELECT 'social', 'platform_domain' FROM social WHERE platform NOT IN ('TWITTER', 'FACEBOOK', 'INSTAGRAM', 'LINKEDIN', 'YOUTUBE',
    'TELEGRAM', 'WHATSAPP', 'REDDIT', 'TIKTOK', 'GITHUB', 'EMAIL', 'PHONE', 'OTHER')
  UNION ALL SELECT 'remark', 'severity_domain' FROM remark WHERE severity NOT IN ('INFO', 'LOW', 'MEDIUM', 'HIGH', 'CRITICAL'))
GROUP BY table_name, rule""")
def validate_tables(spark, sf):
    parts = []
    for name in ("entity", "anchor", "property", "bank", "social", "remark"):
        rows = view(spark, sf, name)
        broken = values.violations(values.table_rules(name, rows.columns))
        parts.append(rows.select(F.lit(name).alias("table_name"), F.explode(broken).alias("rule")))
    return union_all(parts).groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("rows"))


# Columns that no other view holds: gender, ownership percent, remark type.
VIEWS["person"] = (("customer",), "SELECT c_custkey AS entity_id, substr(c_mktsegment, 1, 1) AS gender FROM customer")
VIEWS["holding"] = (("lineitem",), "SELECT l_orderkey AS entity_id, CAST(l_quantity * 2.5 - 5 AS DECIMAL(5,2)) AS ownership_percent FROM lineitem")
VIEWS["note"] = (("events",), """
SELECT event_id AS entity_id, CASE event_type WHEN 'error' THEN 'ALERT' WHEN 'signup' THEN 'VERIFICATION' WHEN 'purchase' THEN 'FINANCIAL' ELSE event_type END AS remark_type
FROM events""")


@query("validate_details", with_views("person", "holding", "note") + """
SELECT 'entity' AS table_name, 'gender_domain' AS rule, count(*) AS rows FROM person WHERE gender NOT IN ('M', 'F', 'O')
UNION ALL SELECT 'property', 'ownership_percent_range', count(*) FROM holding WHERE ownership_percent NOT BETWEEN 0.01 AND 100
UNION ALL SELECT 'remark', 'remark_type_domain', count(*) FROM note
  WHERE remark_type NOT IN ('GENERAL', 'ALERT', 'CASE_NOTE', 'VERIFICATION', 'SOURCE_INTEL', 'FIELD_REPORT', 'LEGAL', 'FINANCIAL')""")
def validate_details(spark, sf):
    parts = []
    for name, shape in (("entity", "person"), ("property", "holding"), ("remark", "note")):
        rows = view(spark, sf, shape)
        parts.append(rows.select(F.lit(name).alias("table_name"), F.explode(values.violations(values.table_rules(name, rows.columns))).alias("rule")))
    return union_all(parts).groupBy("table_name", "rule").agg(F.count(F.lit(1)).alias("rows"))


@query("unique_violations", with_views("anchor", "social", "case_role") + """
SELECT rule, keys, CAST(coalesce(rows, 0) AS BIGINT) AS rows FROM (SELECT 'anchor' AS rule, count(*) AS keys, sum(n) AS rows FROM (SELECT count(*) AS n FROM anchor GROUP BY id_type, id_number HAVING count(*) > 1)
UNION ALL SELECT 'social', count(*), sum(n) FROM (SELECT count(*) AS n FROM social GROUP BY entity_id, platform, handle HAVING count(*) > 1)
UNION ALL SELECT 'case_role', count(*), sum(n) FROM (SELECT count(*) AS n FROM case_role GROUP BY case_id, entity_id, role HAVING count(*) > 1))""")
def unique_violations(spark, sf):
    anchors = view(spark, sf, "anchor").withColumn("hash", identity.id_hash(C("id_number"), fold=lambda c: c))
    checks = {"anchor": (anchors, ["id_type", "hash"]),
              "social": (view(spark, sf, "social"), ["entity_id", "platform", "handle"]),
              "case_role": (view(spark, sf, "case_role", {"lineitem": ["l_orderkey", "l_suppkey", "l_linestatus"]}), ["case_id", "entity_id", "role"])}
    return union_all([
        values.unique_violations(df, key).agg(F.count(F.lit(1)).alias("keys"), F.coalesce(F.sum("copies"), F.lit(0).cast("bigint")).alias("rows"))
        .withColumn("rule", F.lit(rule)) for rule, (df, key) in checks.items()])


@query("register_column_functions", with_views("identifier") + f"""
SELECT entity_id, kind, {_last("trim(value)", 4, 6)} AS phone, {_EMAIL} AS email,
  sha256(upper(trim(value))) AS hash, CAST(CAST('0x' || substr(md5(kind || ':' || entity_id), 1, 16) AS UBIGINT) AS VARCHAR) AS entity_key,
  {_CLASSIFY} AS value_type, CAST({_FNV.replace('(t)', '(lower(value))').replace('(t,', '(lower(value),')} AS VARCHAR) AS token_hash,
  CAST({identity.table_id('identifier')}::HUGEINT * 281474976710656 + entity_id AS VARCHAR) AS global_id,
  CASE WHEN kind = 'aadhaar' THEN 'XXXX-XXXX-' || right(regexp_replace(value, '[ -]', '', 'g'), 4)
    WHEN kind = 'pan' THEN 'XXXXX' || substr(upper(trim(value)), 6) WHEN kind = 'driving_license' THEN {_last("upper(trim(value))", 3, 10)}
    ELSE {_last("upper(trim(value))", 2, 7)} END AS document
FROM identifier""")
def register_column_functions(spark, sf):
    sql_functions.register_scalars(spark)
    spread(view(spark, sf, "identifier")).createOrReplaceTempView("identifier")
    return spark.sql("""SELECT entity_id, kind, mask_phone(value) AS phone, mask_email(value) AS email, id_hash(value) AS hash,
        CAST(entity_key(kind, CAST(entity_id AS STRING)) AS STRING) AS entity_key, classify_value(value) AS value_type,
        CAST(token_hash(value) AS STRING) AS token_hash, CAST(global_id(:table_id, entity_id) AS STRING) AS global_id,
        mask_document(kind, value) AS document FROM identifier""", args={"table_id": identity.table_id("identifier")})


@query("sql_table_functions", with_views("anchor", "entity", "tag") + """
SELECT t.entity_id, CAST(t.assigned_at AS VARCHAR) AS assigned_at, e.status,
  (SELECT min(a.entity_id) FROM anchor a JOIN entity e2 ON e2.entity_id = a.entity_id
   WHERE a.id_type = (SELECT id_type FROM anchor ORDER BY id LIMIT 1)
     AND a.id_number = (SELECT id_number FROM anchor ORDER BY id LIMIT 1)) AS looked_up
FROM tag t JOIN entity e ON e.entity_id = t.entity_id WHERE t.category_id = 2""")
def sql_table_functions(spark, sf):
    for name in ("anchor", "entity", "tag"):
        view(spark, sf, name).createOrReplaceTempView(f"{name}_v")
    sql_functions.register_tables(spark, "anchor_v", "entity_v", "tag_v")
    wanted = spark.table("anchor_v").orderBy("id").select("id_type", "id_number").head()
    found = spark.sql("SELECT entity_id FROM find_entity_by_govt_id(:kind, :number)",
                      args={"kind": wanted["id_type"], "number": wanted["id_number"]})
    members = spark.sql("""SELECT m.entity_id, CAST(m.assigned_at AS STRING) AS assigned_at, e.status
        FROM entities_by_category(2) m JOIN entity_v e ON e.entity_id = m.entity_id""")
    return members.withColumn("looked_up", found.select("entity_id").scalar())


@query("hash_trigger", with_views("anchor") + """
SELECT id, sha256(trim(id_number)) AS id_number_hash, '1998-01-01 00:00:00' AS updated_at FROM anchor""")
def hash_trigger(spark, sf):
    from casegrain.streaming.maintain import with_derived_hash

    out = with_derived_hash(view(spark, sf, "anchor"), F.lit("1998-01-01").cast("timestamp_ntz"), fold=lambda c: c)
    return out.select("id", "id_number_hash", C("updated_at").cast("string").alias("updated_at"))
