"""Entity resolution, profiles and the searches built on them."""

from __future__ import annotations

from pyspark.sql import functions as F

from casegrain.functions import identity
from casegrain.operators import filters, joins, paging, profile, resolve, search, tags
from casegrain.operators.warehouse import union_all
from casegrain.plans.registry import query
from casegrain.plans.views import VIEWS, table, view, with_views
from casegrain.session import fresh_dir, stored

C = F.col
DETECTED = "1998-01-01 00:00:00"


def hashed_anchors(spark, sf):
    """(id_type, id_hash, entity_id) of the anchors."""
    return view(spark, sf, "anchor").select("id_type", identity.id_hash(C("id_number"), fold=lambda c: c).alias("id_hash"), "entity_id")


def joined(column, *fields):
    """A list of structs as text."""
    return F.array_join(F.transform(column, lambda x: F.concat_ws(":", *[x[f].cast("string") for f in fields])), ";")


# ---- resolution ----------------------------------------------------------------------------------


@query("govt_id_lookup", with_views("anchor") + """
SELECT p.doc_id AS lookup_id, min(a.entity_id) AS entity_id, count(DISTINCT a.entity_id) AS candidates
FROM documents p JOIN anchor a ON a.id_type = p.lang AND sha256(a.id_number) = sha256(trim(p.text)) GROUP BY p.doc_id""")
def govt_id_lookup(spark, sf):
    asked = table(spark, sf, "documents").select(C("doc_id").alias("lookup_id"), C("lang").alias("id_type"),
                                                 identity.id_hash(C("text"), fold=lambda c: c).alias("id_hash"))
    known = (hashed_anchors(spark, sf).groupBy("id_type", "id_hash")
             .agg(F.min("entity_id").alias("entity_id"), F.count_distinct("entity_id").alias("candidates")))
    return asked.join(known, ["id_type", "id_hash"]).select("lookup_id", "entity_id", "candidates")


_STAR = """, centre AS (SELECT id_type, id_number, min(entity_id) AS entity_a, count(DISTINCT entity_id) AS n FROM anchor GROUP BY ALL)"""


@query("dup_pairs", with_views("anchor") + _STAR + """
SELECT c.entity_a, a.entity_id AS entity_b, a.id_type, sha256(a.id_number) AS id_hash FROM anchor a
JOIN centre c ON c.id_type = a.id_type AND c.id_number = a.id_number WHERE a.entity_id > c.entity_a""")
def dup_pairs(spark, sf):
    return resolve.star_links(stored(hashed_anchors(spark, sf), "hashed"), ["id_type", "id_hash"], "entity_id")


@query("dup_groups", with_views("anchor") + """
SELECT id_type, sha256(id_number) AS id_hash, CAST(0 AS INT) AS part, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY entity_id) AS members,
  count(*) AS dup_count FROM (SELECT DISTINCT id_type, id_number, entity_id FROM anchor) GROUP BY id_type, id_number HAVING count(*) > 1""")
def dup_groups(spark, sf):
    groups = resolve.dup_groups(hashed_anchors(spark, sf), ["id_type", "id_hash"], "entity_id")
    return groups.select("id_type", "id_hash", "part", F.array_join(C("items").cast("array<string>"), ",").alias("members"),
                         C("frequency").alias("dup_count"))


@query("shared_handles", with_views("social") + """
SELECT platform, handle, CAST(0 AS INT) AS part, string_agg(CAST(entity_id AS VARCHAR), ',' ORDER BY entity_id) AS entities, count(*) AS shared_count
FROM (SELECT DISTINCT platform, handle, entity_id FROM social WHERE is_active) GROUP BY platform, handle HAVING count(*) > 1""")
def shared_handles(spark, sf):
    live = view(spark, sf, "social").where("is_active")
    groups = resolve.dup_groups(live, ["platform", "handle"], "entity_id")
    return groups.select("platform", "handle", "part", F.array_join(C("items").cast("array<string>"), ",").alias("entities"),
                         C("frequency").alias("shared_count"))


@query("dup_edges", with_views("anchor") + _STAR + f"""
SELECT DISTINCT c.entity_a, a.entity_id AS entity_b, 'EXACT_ID' AS match_type, 1.0::DOUBLE AS similarity, '{DETECTED}' AS detected_at FROM anchor a
JOIN centre c ON c.id_type = a.id_type AND c.id_number = a.id_number WHERE a.entity_id > c.entity_a""")
def dup_edges(spark, sf):
    links = resolve.star_links(stored(hashed_anchors(spark, sf), "hashed"), ["id_type", "id_hash"], "entity_id")
    return resolve.typed_edges(links, "EXACT_ID", 1.0, F.lit(DETECTED))


VIEWS["named"] = (("customer", "supplier", "part", "nation"), """
SELECT c_custkey * 10 + 1 AS id, c_name AS name FROM customer UNION ALL SELECT s_suppkey * 10 + 2, s_name FROM supplier
UNION ALL SELECT p_partkey * 10 + 3, p_name FROM part UNION ALL SELECT n_nationkey * 10 + 4, n_name FROM nation""")


@query("fuzzy_name_edges", with_views("named") + """, n AS (SELECT lower(trim(name)) AS name, min(id) AS id FROM named GROUP BY 1)
SELECT a.id AS entity_a, b.id AS entity_b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS similarity
FROM n a JOIN n b ON a.id < b.id AND abs(length(a.name) - length(b.name)) <= 1 AND levenshtein(a.name, b.name) = 1
WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.8
UNION ALL SELECT n.id, m.id, 1.0 FROM named m JOIN n ON n.name = lower(trim(m.name)) WHERE m.id > n.id""")
def fuzzy_name_edges(spark, sf):
    edges = resolve.fuzzy_name_edges(view(spark, sf, "named"), "id", "name", 0.8)
    return edges.withColumn("similarity", F.round("similarity", 6))


VIEWS["titled"] = (("documents", "nation", "part"), """
SELECT doc_id * 10 AS id, translate(substr(split_part(text, '.', 1), 1, 30), 'äöüßàâáãåæçéèêëîïíìôóòõøœûùúñÿÄÖÜÀÂÁÇÉÈÊËÎÏÍÔÓÛÙÚÑ¿¡', 'aousaaaaaaceeeeiiiiooooooiuunyAOUAAACEEEEIIIOOUUUN??') AS name FROM documents
UNION ALL SELECT n_nationkey * 10 + 4, n_name FROM nation UNION ALL SELECT p_partkey * 10 + 3, p_name FROM part""")


@query("similar_names", with_views("titled") + """, n AS (SELECT lower(trim(name)) AS name, min(id) AS id FROM titled GROUP BY 1)
SELECT least(a.id, b.id) AS entity_a, greatest(a.id, b.id) AS entity_b, round(1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)), 6) AS similarity
FROM n a JOIN n b ON a.name < b.name WHERE 1 - levenshtein(a.name, b.name) / greatest(length(a.name), length(b.name)) >= 0.8 - 1e-9
UNION ALL SELECT n.id, m.id, 1.0 FROM titled m JOIN n ON n.name = lower(trim(m.name)) WHERE m.id > n.id""")
def similar_names(spark, sf):
    """Names (opening words of documents, nations, parts) with a similarity of 0.8 or more, however many edits that is."""
    edges = resolve.similar_name_edges(view(spark, sf, "titled"), "id", "name", 0.8)
    return edges.withColumn("similarity", F.round("similarity", 6))


_CONTACT = """, links AS (
  SELECT m.a AS entity_a, e.entity_id AS entity_b FROM entity e JOIN (SELECT primary_email AS h, min(entity_id) AS a FROM entity GROUP BY 1) m ON m.h = e.primary_email WHERE e.entity_id > m.a
  UNION SELECT m.a, e.entity_id FROM entity e JOIN (SELECT primary_phone AS h, min(entity_id) AS a FROM entity GROUP BY 1) m ON m.h = e.primary_phone WHERE e.entity_id > m.a)"""


@query("contact_edges", with_views("entity") + _CONTACT + "SELECT entity_a, entity_b, 'PHONE_EMAIL' AS match_type FROM links")
def contact_edges(spark, sf):
    links = resolve.contact_edges(view(spark, sf, "entity"), "entity_id", ["primary_email", "primary_phone"])
    return links.withColumn("match_type", F.lit("PHONE_EMAIL"))


@query("canonical_ids", with_views("entity").replace("WITH ", "WITH RECURSIVE ", 1) + """, handle AS (
  SELECT entity_id, primary_email || country AS h FROM entity UNION ALL SELECT entity_id, primary_phone || status FROM entity),
links AS (SELECT a.entity_id AS u, b.entity_id AS v FROM handle a JOIN handle b ON a.h = b.h AND a.entity_id <> b.entity_id),
reach AS (SELECT entity_id AS u, entity_id AS v FROM entity UNION SELECT r.u, l.v FROM reach r JOIN links l ON l.u = r.v)
SELECT u AS entity_id, min(v) AS canonical_id, min(v) <> u AS is_duplicate FROM reach GROUP BY u""")
def canonical_ids(spark, sf):
    e = view(spark, sf, "entity").withColumns({"mail": F.concat("primary_email", "country"), "phone": F.concat("primary_phone", "status")})
    return resolve.canonical_ids(resolve.contact_edges(e, "entity_id", ["mail", "phone"]), e, "entity_id")


@query("risk_propagation", with_views("social") + """, members AS (SELECT DISTINCT platform, handle, entity_id, CAST((entity_id * 37) % 101 AS INT) AS risk FROM social WHERE is_active)
SELECT a.entity_id, a.risk AS risk_score, max(b.risk) AS network_risk FROM members a
JOIN members b ON a.platform = b.platform AND a.handle = b.handle AND a.entity_id <> b.entity_id AND b.risk >= 80 GROUP BY a.entity_id, a.risk""")
def risk_propagation(spark, sf):
    live = view(spark, sf, "social").where("is_active")
    risks = live.select("entity_id", ((C("entity_id") * 37) % 101).cast("int").alias("risk_score")).distinct()
    return resolve.risk_propagation(live, risks, ["platform", "handle"], "entity_id")


# ---- profiles ------------------------------------------------------------------------------------

_MASKED_TEXT = "CASE WHEN length({0}) <= 4 THEN {0} ELSE repeat('X', length({0}) - 4) || right({0}, 4) END"
_BANKS = ("(SELECT entity_id, string_agg(concat_ws(':', bank_name, " + _MASKED_TEXT.format("account_number") +
          ", account_type, is_primary), ';' ORDER BY is_primary DESC, opened_at DESC NULLS LAST, id) AS bank_accounts FROM bank WHERE is_active GROUP BY entity_id)")
_SOCIAL = ("(SELECT entity_id, string_agg(concat_ws(':', platform, handle, follower_count), ';' ORDER BY follower_count DESC NULLS LAST, id) AS social_accounts "
           "FROM social WHERE is_active GROUP BY entity_id)")
_ANCHORS = ("(SELECT entity_id, md5(string_agg(concat_ws(':', id_type, " + _MASKED_TEXT.format("id_number") +
            ", is_verified, issuing_country), ';' ORDER BY is_primary DESC, id)) AS anchors FROM anchor GROUP BY entity_id)")
# One engine writes the capital of ß as SS, the other as one letter.
_DOC_MASK = """CASE lower(id_type) WHEN 'aadhaar' THEN 'XXXX-XXXX-' || right(regexp_replace(id_number, '[ -]', '', 'g'), 4)
  WHEN 'pan' THEN 'XXXXX' || CASE WHEN length(replace(trim(id_number), 'ß', 'SS')) < 5 THEN upper(replace(trim(id_number), 'ß', 'SS')) ELSE substr(upper(replace(trim(id_number), 'ß', 'SS')), 6) END
  WHEN 'driving_license' THEN CASE WHEN length(replace(trim(id_number), 'ß', 'SS')) < 3 THEN 'XXXXXXXXXX' || upper(replace(trim(id_number), 'ß', 'SS'))
    ELSE repeat('X', length(replace(trim(id_number), 'ß', 'SS')) - 3) || right(upper(replace(trim(id_number), 'ß', 'SS')), 3) END
  ELSE CASE WHEN length(replace(trim(id_number), 'ß', 'SS')) < 2 THEN 'XXXXXXX' || upper(replace(trim(id_number), 'ß', 'SS'))
    ELSE repeat('X', length(replace(trim(id_number), 'ß', 'SS')) - 2) || right(upper(replace(trim(id_number), 'ß', 'SS')), 2) END END"""
_DOCUMENTS = _ANCHORS.replace(_MASKED_TEXT.format("id_number"), _DOC_MASK)
_PROPS = ("(SELECT entity_id, string_agg(concat_ws(':', property_type, current_value), ';' ORDER BY current_value DESC NULLS LAST, id) AS properties "
          "FROM property WHERE is_active GROUP BY entity_id)")
_CASES = ("(SELECT r.entity_id, string_agg(concat_ws(':', c.case_number, c.status, c.category, r.role), ';' ORDER BY c.created_at DESC, c.case_id, r.role) AS cases "
          "FROM case_file c JOIN case_role r ON r.case_id = c.case_id WHERE NOT c.is_deleted GROUP BY r.entity_id)")
_REMARKS = ("(SELECT entity_id, string_agg(severity || '=' || n, ',' ORDER BY severity) AS remarks FROM "
            "(SELECT entity_id, severity, count(*) AS n FROM remark GROUP BY ALL) GROUP BY entity_id)")
_TAGS = ("(SELECT t.entity_id, string_agg(c.name, ',' ORDER BY c.name) AS tags FROM tag t JOIN category c ON c.category_id = t.category_id "
         "AND c.is_active GROUP BY t.entity_id)")

BANK_FIELDS = ("bank_name", "account", "account_type", "is_primary")
SOCIAL_FIELDS = ("platform", "handle", "follower_count")
ANCHOR_FIELDS = ("id_type", "id_number", "is_verified", "issuing_country")


def anchors_digest(column, *fields):
    return F.md5(joined(column, *fields).cast("binary"))


def map_text(column):
    return F.array_join(F.transform(F.sort_array(F.map_entries(column)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")


@query("remark_summary", with_views("remark") + f"SELECT entity_id, remarks FROM {_REMARKS}")
def remark_summary(spark, sf):
    return profile.remark_summary(view(spark, sf, "remark")).select("entity_id", map_text(C("remark_summary")).alias("remarks"))


@query("ordered_json_agg", with_views("bank") + f"SELECT entity_id, CAST(0 AS BIGINT) AS part, bank_accounts FROM {_BANKS}")
def ordered_json_agg(spark, sf):
    lists = profile.bank_list(view(spark, sf, "bank"), False, 10_000)
    return lists.df.select("entity_id", "part", joined("bank_accounts", *BANK_FIELDS).alias("bank_accounts"))


@query("distinct_sorted_array", with_views("bank") + """
SELECT entity_id, string_agg(DISTINCT bank_name, ',' ORDER BY bank_name) AS banks FROM bank GROUP BY entity_id""")
def distinct_sorted_array(spark, sf):
    return profile.distinct_sorted(view(spark, sf, "bank"), "entity_id", "bank_name", "banks").withColumn("banks", F.array_join("banks", ","))


@query("top_n_children", with_views("bank", "social") + """
SELECT entity_id, 'bank' AS kind, id, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY is_primary DESC, opened_at DESC NULLS LAST, id) AS INT) AS position FROM bank WHERE is_active) WHERE position <= 5
UNION ALL SELECT entity_id, 'social', id, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY entity_id ORDER BY follower_count DESC NULLS LAST, id) AS INT) AS position FROM social WHERE is_active) WHERE position <= 10""")
def top_n_children(spark, sf):
    banks = paging.top_per_group(view(spark, sf, "bank").where("is_active"), ["entity_id"], profile.BANK_ORDER, 5)
    socials = paging.top_per_group(view(spark, sf, "social").where("is_active"), ["entity_id"], profile.SOCIAL_ORDER, 10)
    return union_all([df.select("entity_id", F.lit(kind).alias("kind"), "id", "position") for kind, df in (("bank", banks), ("social", socials))])


def profiles(spark, sf, unmask=False, **given):
    names = ("entity", "anchor", "social", "bank", "case_file", "case_role")
    return profile.entity_profile(*[given[n] if n in given else view(spark, sf, n) for n in names], unmask=unmask)


_PROFILE_VIEWS = ("entity", "anchor", "social", "bank", "case_file", "case_role")
_PROFILE_FROM = f"""FROM entity e LEFT JOIN {_DOCUMENTS} a USING (entity_id) LEFT JOIN {_SOCIAL} s USING (entity_id) LEFT JOIN {_BANKS} b USING (entity_id)
LEFT JOIN {_CASES} k USING (entity_id)"""


@query("entity_profile", with_views(*_PROFILE_VIEWS) + f"""
SELECT e.entity_id, CAST(0 AS BIGINT) AS part, full_name, city || ':' || country AS addresses, 'phone:' || primary_phone || ';email:' || primary_email AS contacts,
  anchors, social_accounts, bank_accounts, cases {_PROFILE_FROM}""")
def entity_profile(spark, sf):
    return profiles(spark, sf).select(
        "entity_id", "part", "full_name", joined("addresses", "city", "country").alias("addresses"),
        joined("contacts", "contact_type", "value").alias("contacts"), *profile_columns())


def profile_columns():
    return [anchors_digest("identity_anchors", *ANCHOR_FIELDS).alias("anchors"), joined("social_accounts", *SOCIAL_FIELDS).alias("social_accounts"),
            joined("bank_accounts", *BANK_FIELDS).alias("bank_accounts"), joined("cases", "case_number", "status", "category", "role").alias("cases")]


@query("case_profiles", with_views(*_PROFILE_VIEWS) + f"""
SELECT x.case_id, x.role, e.entity_id, CAST(0 AS BIGINT) AS part, e.full_name, anchors, social_accounts, bank_accounts, cases {_PROFILE_FROM}
JOIN (SELECT c.case_id, r.role, r.entity_id FROM case_file c JOIN case_role r ON r.case_id = c.case_id WHERE NOT c.is_deleted) x USING (entity_id)""")
def case_profiles(spark, sf):
    roles = stored(view(spark, sf, "case_role"), "case-roles")
    linked = joins.entity_cases(view(spark, sf, "case_file"), roles).select("case_id", "role", "entity_id")
    full = profiles(spark, sf, case_role=roles).select("entity_id", "part", "full_name", *profile_columns())
    return profile.beside(linked, full, "entity_id", roles.count())


def categories_of(spark, sf):
    return tags.entity_categories(view(spark, sf, "tag"), view(spark, sf, "category"))


@query("entity_360", with_views("entity", "anchor", "property", "bank", "social", "tag", "category", "remark") + f"""
SELECT e.entity_id, CAST(0 AS BIGINT) AS part, e.risk_score, e.status, anchors, properties, bank_accounts, social_accounts, tags, remarks
FROM entity e LEFT JOIN {_ANCHORS} a USING (entity_id) LEFT JOIN {_PROPS} p USING (entity_id) LEFT JOIN {_BANKS} b USING (entity_id)
LEFT JOIN {_SOCIAL} s USING (entity_id) LEFT JOIN {_TAGS} t USING (entity_id) LEFT JOIN {_REMARKS} r USING (entity_id)""")
def entity_360(spark, sf):
    out = profile.entity_360(*[view(spark, sf, n) for n in ("entity", "anchor", "property", "bank", "social")],
                             categories_of(spark, sf), view(spark, sf, "remark"))
    return out.select(
        "entity_id", "part", "risk_score", "status", anchors_digest("identity_anchors", *ANCHOR_FIELDS).alias("anchors"),
        joined("properties", "property_type", "current_value").alias("properties"), joined("bank_accounts", *BANK_FIELDS).alias("bank_accounts"),
        joined("social_accounts", *SOCIAL_FIELDS).alias("social_accounts"), F.array_join("category_tags", ",").alias("tags"),
        map_text(C("remark_summary")).alias("remarks"))


def _top(view_name, order, n, text, alias):
    return (f"(SELECT entity_id, string_agg({text}, ';' ORDER BY rn) AS {alias} FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY {order}) AS rn "
            f"FROM {view_name}) WHERE rn <= {n} GROUP BY entity_id)")


_TOP_BANKS = _top("(SELECT * FROM bank WHERE is_active)", "is_primary DESC, opened_at DESC, id", 5, "concat_ws(':', bank_name, account_type, is_primary)", "bank_accounts")
_TOP_SOCIAL = _top("(SELECT * FROM social WHERE is_active)", "follower_count DESC NULLS LAST, id", 10, "concat_ws(':', platform, handle, follower_count)", "social_accounts")
_TOP_PROPS = _top("(SELECT * FROM property WHERE is_active)", "current_value DESC NULLS LAST, id", 5, "concat_ws(':', property_type, current_value)", "properties")

_TOP_ANCHORS = ("(SELECT entity_id, md5(string_agg(concat_ws(':', id_type, " + _MASKED_TEXT.format("id_number") + ", is_verified), ';' ORDER BY rn)) AS anchors "
                "FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY is_primary DESC, id) AS rn FROM anchor) WHERE rn <= 10 GROUP BY entity_id)")
_CONTACTS = "concat_ws(';', 'phone:' || primary_phone, 'email:' || primary_email) AS contacts"


def top_columns():
    return [anchors_digest("identity_anchors", "id_type", "id_masked", "is_verified").alias("anchors"),
            joined("contacts", "contact_type", "value").alias("contacts"), joined("bank_accounts", "bank_name", "account_type", "is_primary").alias("bank_accounts"),
            joined("social_accounts", *SOCIAL_FIELDS).alias("social_accounts"), joined("properties", "property_type", "current_value").alias("properties"),
            F.array_join("category_names", ",").alias("tags"), map_text(C("remark_summary")).alias("remarks")]


@query("entity_360_topn", with_views("entity", "anchor", "property", "bank", "social", "tag", "category", "remark") + f"""
SELECT e.entity_id, e.status, anchors, {_CONTACTS}, bank_accounts, social_accounts, properties, tags, remarks
FROM entity e LEFT JOIN {_TOP_ANCHORS} a USING (entity_id) LEFT JOIN {_TOP_BANKS} b USING (entity_id) LEFT JOIN {_TOP_SOCIAL} s USING (entity_id) LEFT JOIN {_TOP_PROPS} p USING (entity_id)
LEFT JOIN {_TAGS} t USING (entity_id) LEFT JOIN {_REMARKS} r USING (entity_id)""")
def entity_360_topn(spark, sf):
    out = profile.entity_360_top(*[view(spark, sf, n) for n in ("entity", "anchor", "bank", "social", "property")],
                                 categories_of(spark, sf), view(spark, sf, "remark"))
    return out.select("entity_id", "status", *top_columns())


@query("profile_export_json", with_views(*_PROFILE_VIEWS) + f"SELECT e.entity_id, full_name, bank_accounts, cases {_PROFILE_FROM}")
def profile_export_json(spark, sf):
    path = fresh_dir(spark, "profiles")
    full = profiles(spark, sf)
    full.write.option("compression", "gzip").option("maxRecordsPerFile", 100_000).json(path)
    back = spark.read.schema(full.schema).json(path)
    return back.select("entity_id", "full_name", joined("bank_accounts", *BANK_FIELDS).alias("bank_accounts"),
                       joined("cases", "case_number", "status", "category", "role").alias("cases"))


_YES = "CASE WHEN {0} THEN 'Yes' ELSE 'No' END"


def _lines(section, source, *fields):
    values = ", ".join(f"coalesce(CAST({f} AS VARCHAR), '')" for f in fields)
    return f"SELECT entity_id, '{section}' AS section, CAST(to_json([{values}]) AS VARCHAR) AS values FROM {source}"


_BIO = (("ID", "entity_id"), ("Full Name", "full_name"), ("Primary Phone", "primary_phone"), ("Primary Email", "primary_email"), ("Created At", "created_on"))


@query("profile_export_sections", with_views(*_PROFILE_VIEWS) + "\nUNION ALL ".join([
    *(_lines("bio", "entity", f"'{label}'", field) for label, field in _BIO),
    _lines("addresses", "entity", "city", "country"),
    _lines("documents", "anchor", "id_type", _DOC_MASK, "issuing_country", _YES.format("is_verified")),
    _lines("contacts", "entity WHERE primary_phone IS NOT NULL", "'phone'", "primary_phone"),
    _lines("contacts", "entity WHERE primary_email IS NOT NULL", "'email'", "primary_email"),
    _lines("social", "social", "platform", "handle", "follower_count", _YES.format("is_active")),
    _lines("bank", "bank", _MASKED_TEXT.format("account_number"), "bank_name", "account_type", _YES.format("is_primary")),
    _lines("cases", "case_file c JOIN case_role r ON r.case_id = c.case_id WHERE NOT c.is_deleted", "case_number", "status", "category", "role")]))
def profile_export_sections(spark, sf):
    path = fresh_dir(spark, "sections")
    profile.write_sections(profile.profile_sections(*[view(spark, sf, n) for n in _PROFILE_VIEWS]), path)
    back = spark.read.option("header", True).schema("entity_id bigint, values string, sort_key string, section string").csv(path)
    return back.select("entity_id", "section", "values")


# ---- composed searches ---------------------------------------------------------------------------

_FT = "list_filter(regexp_split_to_array(lower(regexp_replace(concat_ws(' ', first_name, last_name, primary_email, primary_phone, city, country), '[@.#,;:]', ' ', 'g')), '\\s+'), lambda w: w <> '')"
_MF = f"""list_contains({_FT}, 'asia') AND list_contains({_FT}, 'customer') AND status IN ('building', 'household', 'machinery') AND risk_score BETWEEN 10 AND 95
  AND date_of_birth >= DATE '1955-01-01' AND entity_id IN (SELECT entity_id FROM tag WHERE category_id IN (1, 2) GROUP BY entity_id HAVING count(DISTINCT category_id) = 2)"""


@query("multi_filter_search", with_views("entity", "tag", "category", "bank") + f"""
SELECT e.entity_id, e.status, e.risk_score, 0.666667 AS rank, tags, b.id_types, (SELECT count(*) FROM entity WHERE {_MF}) AS total_count
FROM (SELECT * FROM entity WHERE {_MF}) e
LEFT JOIN {_TAGS} t USING (entity_id)
LEFT JOIN (SELECT entity_id, string_agg(DISTINCT account_type, ',' ORDER BY account_type) AS id_types FROM bank GROUP BY 1) b USING (entity_id)
ORDER BY e.entity_id DESC LIMIT 20""".replace("0.666667", "CAST(0.666667 AS DOUBLE)"))
def multi_filter_search(spark, sf):
    fields = ["first_name", "last_name", "primary_email", "primary_phone", "city", "country"]
    ranked = search.fulltext_rank(view(spark, sf, "entity"), fields, "Asia Customer")
    kept = filters.multi_filter(ranked, statuses=["building", "household", "machinery"], dob_from="1955-01-01", risk_min=10, risk_max=95)
    found = tags.tag_all(kept, view(spark, sf, "tag"), [1, 2])
    page = paging.page_counted(found, [("rank", "desc"), ("entity_id", "desc")], 20)
    kinds = profile.distinct_sorted(view(spark, sf, "bank"), "entity_id", "account_type", "id_types")
    return (page.join(categories_of(spark, sf).select("entity_id", "category_names"), "entity_id", "left").join(kinds, "entity_id", "left")
            .orderBy(F.desc("rank"), F.desc("entity_id"))
            .select("entity_id", "status", "risk_score", F.round("rank", 6).alias("rank"), F.array_join("category_names", ",").alias("tags"),
                    F.array_join("id_types", ",").alias("id_types"), "total_count"))


@query("omni_search", with_views("entity", "anchor", "tag", "category", "bank", "social", "property", "remark") + f"""
, hits AS (SELECT entity_id AS record_id, primary_email, primary_phone FROM entity WHERE list_contains({_FT}, 'asia') AND list_contains({_FT}, 'customer')),
master AS (SELECT DISTINCT least((SELECT min(m.entity_id) FROM entity m WHERE m.primary_email = h.primary_email),
                                 (SELECT min(m.entity_id) FROM entity m WHERE m.primary_phone = h.primary_phone)) AS entity_id FROM hits h),
tagged AS (SELECT m.entity_id FROM master m WHERE m.entity_id IN (SELECT entity_id FROM tag WHERE category_id = 1))
SELECT e.entity_id, e.full_name, e.risk_score, anchors, {_CONTACTS}, bank_accounts, social_accounts, properties, tags, remarks, (SELECT count(*) FROM tagged) AS total_count
FROM tagged x JOIN entity e USING (entity_id) LEFT JOIN {_TOP_ANCHORS} a USING (entity_id) LEFT JOIN {_TOP_BANKS} b USING (entity_id) LEFT JOIN {_TOP_SOCIAL} s USING (entity_id)
LEFT JOIN {_TOP_PROPS} p USING (entity_id) LEFT JOIN {_TAGS} t USING (entity_id) LEFT JOIN {_REMARKS} r USING (entity_id)
ORDER BY e.risk_score DESC, e.entity_id LIMIT 20""")
def omni_search(spark, sf):
    entities = view(spark, sf, "entity")
    fields = ["first_name", "last_name", "primary_email", "primary_phone", "city", "country"]
    hits = search.fulltext_rank(entities, fields, "asia customer")
    masters = joins.match_by_either(hits, entities, "entity_id", "entity_id", ["primary_email", "primary_phone"])
    found = entities.join(masters.select(C("matched_id").alias("entity_id")).distinct(), "entity_id", "left_semi")
    tagged = tags.tag_any(found, view(spark, sf, "tag"), [1])
    page = stored(paging.page_counted(tagged, [("risk_score", "desc"), ("entity_id", "asc")], 20), "page")  # 20 rows, read often
    # Only the page is enriched: children are reduced to the page's entities before they are ranked.
    wanted = page.select("entity_id")
    children = [view(spark, sf, n).join(wanted, "entity_id", "left_semi") for n in ("anchor", "bank", "social", "property")]
    out = profile.entity_360_top(page, *children, categories_of(spark, sf).join(wanted, "entity_id", "left_semi"),
                                 view(spark, sf, "remark").join(wanted, "entity_id", "left_semi"))
    return out.orderBy(F.desc("risk_score"), "entity_id").select(
        "entity_id", "full_name", "risk_score", *top_columns(), "total_count")
