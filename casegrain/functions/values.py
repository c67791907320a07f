"""What a value or a row is: type of a value, kind and name of an entity, searchable text, rule checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from casegrain.operators.filters import contains_text
from casegrain.session import spread

# Kinds of identifiers and their patterns, first match in this order wins.
ID_PATTERNS = [
    ("aadhaar", r"^\d{12}$"),
    ("pan", r"^[A-Z]{5}\d{4}[A-Z]$"),
    ("passport", r"^[A-PR-WY][1-9]\d{7}$"),
    ("driving_license", r"^[A-Z]{2}\d{2} ?\d{4}\d{7}$"),
    ("voter_id", r"^[A-Z]{3}\d{7}$"),
    ("phone", r"^[6-9]\d{9}$"),
    ("email", r"^[^\s@]+@[^\s@]+\.[^\s@]+$"),
    ("bank_account", r"^\d{9,18}$"),
    ("ifsc", r"^[A-Z]{4}0[A-Z0-9]{6}$"),
]
EMAIL_PATTERN = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
USERNAME_PATTERN = r"^[a-zA-Z0-9_]{3,30}$"

# Allowed values of the entity model's columns.
GENDERS = ["M", "F", "O"]
ENTITY_STATUSES = ["active", "inactive", "flagged", "deceased", "unknown"]
SEVERITIES = ["INFO", "LOW", "MEDIUM", "HIGH", "CRITICAL"]
ID_TYPES = ["AADHAAR", "PAN", "PASSPORT", "DRIVING_LICENSE", "VOTER_ID", "NPR", "SSN", "NIN", "OTHER"]
PROPERTY_TYPES = ["RESIDENTIAL", "COMMERCIAL", "AGRICULTURAL", "INDUSTRIAL", "VACANT_LAND", "VEHICLE", "VESSEL", "AIRCRAFT", "JEWELRY",
                  "INTELLECTUAL_PROPERTY", "OTHER"]
ACCOUNT_TYPES = ["SAVINGS", "CURRENT", "FIXED_DEPOSIT", "NRE", "NRO", "DEMAT", "CREDIT_CARD", "LOAN", "CRYPTO", "OTHER"]
PLATFORMS = ["TWITTER", "FACEBOOK", "INSTAGRAM", "LINKEDIN", "YOUTUBE", "TELEGRAM", "WHATSAPP", "REDDIT", "TIKTOK", "GITHUB", "EMAIL",
             "PHONE", "OTHER"]
REMARK_TYPES = ["GENERAL", "ALERT", "CASE_NOTE", "VERIFICATION", "SOURCE_INTEL", "FIELD_REPORT", "LEGAL", "FINANCIAL"]

# Fields that lead the searchable text of a record.
PRIORITY_FIELDS = ["first_name", "last_name", "company_name", "email1", "mobile1", "city", "state"]


def classify_value(value: Column) -> Column:
    """Most specific identifier type the text can be, else ``general``.

    E-mail is judged on the text as given, every other type on its upper-cased form without space, - and /.
    """
    def first_match(compact: Column) -> Column:
        tests = [(F.lower(value) if kind == "email" else compact).rlike(pattern) for kind, pattern in ID_PATTERNS]
        return F.coalesce(*[F.when(hit, kind) for hit, (kind, _) in zip(tests, ID_PATTERNS)], F.lit("general"))

    # The lambda's argument is computed once per value, where a plain expression would be for every pattern.
    return F.transform(F.array(F.upper(F.regexp_replace(F.trim(value), "[ /-]", ""))), first_match)[0]


def _present(columns: Sequence[str], name: str) -> Column:
    return F.col(name).isNotNull() if name in columns else F.lit(False)


def _text(columns: Sequence[str], name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit("")) if name in columns else F.lit("")


def entity_type(columns: Sequence[str]) -> Column:
    """person, company or product by the name columns a record fills, else generic."""
    return (F.when(_present(columns, "first_name") | _present(columns, "last_name"), "person")
            .when(_present(columns, "company_name"), "company")
            .when(_present(columns, "product_name"), "product")
            .otherwise("generic"))


def entity_name(columns: Sequence[str]) -> Column:
    kind = entity_type(columns)
    person = F.trim(F.concat_ws(" ", _text(columns, "first_name"), _text(columns, "last_name")))
    return (F.when(kind == "person", person)
            .when(kind == "company", _text(columns, "company_name"))
            .when(kind == "product", _text(columns, "product_name"))
            .otherwise(F.coalesce(F.nullif(_text(columns, "name"), F.lit("")), F.lit("Unknown"))))


def searchable_text(columns: Sequence[str]) -> Column:
    """Lower-cased join of a record's values: priority fields first, the others in schema order.

    Empty values are left out; so are 0 and false outside the priority fields.
    """
    first = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in PRIORITY_FIELDS if c in columns]
    rest = [F.when(~F.col(c).cast("string").isin("", "0", "false"), F.col(c).cast("string"))
            for c in columns if c not in PRIORITY_FIELDS]
    return F.lower(F.concat_ws(" ", *first, *rest))


def full_name(first: Column, last: Column) -> Column:
    return F.trim(F.concat(first, F.lit(" "), F.coalesce(last, F.lit(""))))


def null_default(value: Column, default: object = "") -> Column:
    """Null and '' become the default."""
    return F.coalesce(F.nullif(value, F.lit("")), F.lit(default))


def escape_html(value: Column) -> Column:
    for plain, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        value = F.replace(value, F.lit(plain), F.lit(escaped))
    return value


def highlight(value: Column, term: str) -> Column:
    """HTML-escaped text with every occurrence of the term marked, whatever its case."""
    literal = term.replace("\\E", "\\E\\\\E\\Q")
    return F.regexp_replace(escape_html(value), f"(?i)(\\Q{literal}\\E)", '<mark class="hl">$1</mark>')


def matched_columns(columns: Sequence[str], term: str) -> Column:
    """Names of the columns whose text contains the term, in the order given."""
    return F.array_compact(F.array(*[F.when(contains_text(F.col(c).cast("string"), term), F.lit(c)) for c in columns]))


def with_duplicate_tag(df: DataFrame) -> DataFrame:
    """Tag records that name a duplicate (``duplicate_db`` and ``duplicate_table``, or a ready ``duplicate_ref``)."""
    blank = F.lit("")
    pair = F.lit(None).cast("string")
    has_db = F.lit(False)
    if {"duplicate_db", "duplicate_table"} <= set(df.columns):
        has_db = F.coalesce(F.col("duplicate_db") != blank, F.lit(False))
        full = has_db & F.coalesce(F.col("duplicate_table") != blank, F.lit(False))
        pair = F.when(full, F.concat(F.lit("duplicate_ref:"), F.col("duplicate_db"), F.lit("."), F.col("duplicate_table")))
    ref = F.nullif(F.col("duplicate_ref"), blank) if "duplicate_ref" in df.columns else F.lit(None).cast("string")
    tag = F.coalesce(pair, ref)
    tags = F.coalesce(F.col("tags"), F.array().cast("array<string>")) if "tags" in df.columns else F.array().cast("array<string>")
    return (df.withColumn("_has_duplicate_ref", has_db | ref.isNotNull())
            .withColumn("tags", F.when(tag.isNotNull(), F.array_append(tags, tag)).otherwise(tags)))


def client_ip(forwarded: Column, real_ip: Column, remote: Column) -> Column:
    blank = F.lit("")
    return F.coalesce(F.nullif(forwarded, blank), F.nullif(real_ip, blank), remote)


def audit_action(method: Column, path: Column, status: Column, millis: Column) -> Column:
    return F.format_string("%s %s → %d (%dms)", method, path, status, millis)


def violations(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks; like a CHECK constraint, an unknown outcome passes."""
    return F.array_compact(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules.items()]))


def entity_rules() -> dict[str, Column]:
    return {
        "email_format": F.col("primary_email").rlike(EMAIL_PATTERN),
        "username_format": F.col("full_name").rlike(USERNAME_PATTERN),
        "risk_range": F.col("risk_score").between(0, 100),
        "status_domain": F.col("status").isin(ENTITY_STATUSES),
    }


def table_rules(table: str, columns: Sequence[str]) -> dict[str, Column]:
    """Domains and ranges of the entity model's table as far as it has the columns: rule name -> check.

    A null passes. The model's own check of the gender lists NULL as a value and so refuses nothing; here other values break it.
    """
    domains = {"entity": {"gender": GENDERS, "status": ENTITY_STATUSES}, "anchor": {"id_type": ID_TYPES},
               "property": {"property_type": PROPERTY_TYPES}, "bank": {"account_type": ACCOUNT_TYPES},
               "social": {"platform": PLATFORMS}, "remark": {"remark_type": REMARK_TYPES, "severity": SEVERITIES}}
    ranges = {"entity": {"risk_score": (0, 100)}, "property": {"ownership_percent": ("0.01", "100.00")}}
    rules = {f"{c}_domain": F.col(c).isin(allowed) for c, allowed in domains[table].items() if c in columns}
    for c, (least, most) in ranges.get(table, {}).items():
        if c in columns:
            rules[f"{c}_range"] = F.col(c).between(F.lit(least).cast("decimal(5,2)"), F.lit(most).cast("decimal(5,2)"))
    return rules


def unique_violations(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that occur more than once, with their number of rows.

    Keys are dealt to all tasks before they are counted: most are different, so the task of a large file would hold all of its own.
    """
    return spread(df.select(*key), *key).groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where(F.col("copies") > 1)
