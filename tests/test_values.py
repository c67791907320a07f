"""Column functions on small literal rows: short values, nulls, unusual input."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casegrain.functions import identity, masking, sql_functions, text, values
from casegrain.operators import filters, paging, tags


def one(spark, column, **row):
    schema = T.StructType([T.StructField(k, T.LongType() if isinstance(v, int) else T.StringType()) for k, v in row.items()])
    return spark.createDataFrame([tuple(row.values())], schema).select(column).head()[0]


@pytest.mark.parametrize("fn, given, wanted", [
    (masking.mask_aadhaar, "1234 5678-9012", "XXXX-XXXX-9012"),
    (masking.mask_aadhaar, "12", "XXXX-XXXX-12"),
    (masking.mask_pan, " abcde1234f ", "XXXXX1234F"),
    (masking.mask_pan, "abc", "XXXXXABC"),
    (masking.mask_passport, "k1234567", "XXXXXX67"),
    (masking.mask_passport, "k", "XXXXXXXK"),
    (masking.mask_driving_license, "mh1220110012345", "XXXXXXXXXXXX345"),
    (masking.mask_driving_license, "ab", "XXXXXXXXXXAB"),
    (masking.mask_phone, "9876543210", "XXXXXX3210"),
    (masking.mask_phone, "321", "XXXXXX321"),
    (masking.mask_bank_account, "", "XXXXXX"),
    (masking.mask_email, "john@x.org", "j***@x.org"),
    (masking.mask_email, "j@x.org", "j***@x.org"),
    (masking.mask_email, "@x.org", "***@***"),
    (masking.mask_email, "nobody", "***@***"),
    (masking.mask_all_but_four, "123456", "XX3456"),
    (masking.mask_all_but_four, "123", "123"),
    (masking.mask_phone, None, None),
])
def test_masks(spark, fn, given, wanted):
    assert one(spark, fn(F.col("v")), v=given) == wanted


def test_masks_keep_the_length_and_hide_all_but_the_end(spark):
    rng = random.Random(8)
    words = ["".join(rng.choice("0123456789ABCX") for _ in range(rng.randint(4, 30))) for _ in range(200)]
    df = spark.createDataFrame([(w,) for w in words], "v string")
    for fn, visible in ((masking.mask_phone, 4), (masking.mask_bank_account, 4), (masking.mask_passport, 2),
                        (masking.mask_driving_license, 3), (masking.mask_all_but_four, 4)):
        for row in df.select("v", fn(F.col("v")).alias("m")).collect():
            assert row["m"] == "X" * (len(row["v"]) - visible) + row["v"][-visible:]


def test_sql_functions_agree_with_the_column_functions(spark):
    sql_functions.register_scalars(spark)
    given = ["", "a", "K12345678", "jo@ex.org", "j@x.y", "@", " 9876543210 ", "1234 5678-9012", "straße", "abcde1234f", None]
    spark.createDataFrame([(i, v) for i, v in enumerate(given)], "i bigint, v string").createOrReplaceTempView("given")
    c = F.col("v")
    pairs = {"mask_aadhaar(v)": masking.mask_aadhaar(c), "mask_pan(v)": masking.mask_pan(c), "mask_passport(v)": masking.mask_passport(c),
             "mask_driving_license(v)": masking.mask_driving_license(c), "mask_phone(v)": masking.mask_phone(c),
             "mask_bank_account(v)": masking.mask_bank_account(c), "mask_email(v)": masking.mask_email(c),
             "mask_all_but_four(v)": masking.mask_all_but_four(c), "id_hash(v)": identity.id_hash(c), "token_hash(v)": identity.token_hash(c),
             "mask_document('PAN', v)": masking.mask_document(F.lit("PAN"), c)}
    for call, column in pairs.items():
        ours = [r[0] for r in spark.table("given").select(column, "i").orderBy("i").collect()]
        theirs = [r[0] for r in spark.sql(f"SELECT {call}, i FROM given ORDER BY i").collect()]
        assert ours == theirs, call


def test_stored_mask_wins_and_unknown_types_use_the_passport_rule(spark):
    mask = masking.mask_document(F.col("k"), F.col("n"), F.col("s"))
    assert one(spark, mask, k="PAN", n="abcde1234f", s="KEPT") == "KEPT"
    assert one(spark, mask, k="PAN", n="abcde1234f", s="") == "XXXXX1234F"
    assert one(spark, mask, k="library card", n="ab1234", s=None) == "XXXX34"


@pytest.mark.parametrize("given, wanted", [
    ("1234-5678 9012", "aadhaar"), ("abcde1234f", "pan"), ("K1234567", "general"), ("K12345678", "passport"),
    ("MH12 20110012345", "driving_license"), ("abc1234567", "voter_id"), ("9876543210", "phone"), ("5876543210", "bank_account"),
    ("Jo@Ex.org", "email"), (" jo@ex.org", "general"), ("hdfc0123456", "ifsc"), ("12345678", "general"), ("", "general")])
def test_classify(spark, given, wanted):
    assert one(spark, values.classify_value(F.col("v")), v=given) == wanted


def fnv(word):
    h = identity.FNV_OFFSET
    for b in word.encode():
        h = ((h ^ b) * identity.FNV_PRIME) % 2**64
    return h


@pytest.mark.parametrize("word", ["", "a", "Hello", "straße", "日本", "x" * 50])
def test_token_hash_is_exact(spark, word):
    assert int(one(spark, identity.token_hash(F.col("v")), v=word)) == fnv(word.lower())


def test_entity_key_is_unsigned(spark):
    for row in range(20):
        key = one(spark, identity.entity_key(F.lit("t"), F.col("v")), v=row)
        assert int(key) == int.from_bytes(hashlib.md5(f"t:{row}".encode()).digest()[:8], "big")


def test_global_id_round_trip(spark):
    gid = identity.pack_global_id("documents", F.col("v"))
    for pk in (0, 1, 2**48 - 1):
        assert int(one(spark, gid, v=pk)) == (identity.table_id("documents") << 48) + pk
        assert one(spark, identity.unpack_row_id(gid), v=pk) == pk
        assert one(spark, identity.unpack_table_id(gid), v=pk) == identity.table_id("documents")
    assert identity.table_id_collisions(["part", "customer", "documents"]) == {}
    assert identity.table_id_collisions(["a", "part", "b"]) == {identity.table_id("a"): ["a", "b"]}  # 16 bits are few


def test_search_terms_are_literal_unless_asked(spark):
    df = spark.createDataFrame([("100% sure",), ("100 sure",), (None,)], "t string")
    assert df.where(filters.contains_text("t", "100%")).count() == 1
    assert df.where(filters.contains_text("t", "100%", wildcards=True)).count() == 2
    assert df.where(filters.contains_text("t", "_")).count() == 0


def test_highlight_escapes_and_marks(spark):
    assert one(spark, values.highlight(F.col("v"), "a.b"), v='<A.b> "axb"') == '&lt;<mark class="hl">A.b</mark>&gt; &quot;axb&quot;'


def test_violations_let_unknown_pass(spark):
    rules = {"r": F.col("v").rlike("^x"), "s": F.length("v") < 3}
    assert one(spark, values.violations(rules), v=None) == []
    assert one(spark, values.violations(rules), v="yyyy") == ["r", "s"]


def test_duplicate_tag_accepts_both_forms(spark):
    pair = spark.createDataFrame([(["x"], "db", "t"), (None, "db", ""), (["x"], None, None)],
                                 "tags array<string>, duplicate_db string, duplicate_table string")
    assert [(r["tags"], r["_has_duplicate_ref"]) for r in values.with_duplicate_tag(pair).collect()] == [
        (["x", "duplicate_ref:db.t"], True), ([], True), (["x"], False)]
    ref = spark.createDataFrame([("duplicate_ref:a.b",), (None,)], "duplicate_ref string")
    assert [(r["tags"], r["_has_duplicate_ref"]) for r in values.with_duplicate_tag(ref).collect()] == [
        (["duplicate_ref:a.b"], True), ([], False)]


def test_tags_any_and_all(spark):
    df = spark.createDataFrame([(["A", "b"],)], "have array<string>")
    row = df.select(tags.tags_any(F.col("have"), ["a", "z"]), tags.tags_all(F.col("have"), ["a", "B"]), tags.tags_all(F.col("have"), ["a", "z"])).head()
    assert tuple(row) == (True, True, False)


def test_tokenisers(spark):
    assert one(spark, text.tokens_words(F.col("v")), v='  "Hello," world! 123 a (x-y) hello') == ["hello", "world", "x-y"]
    assert one(spark, text.tokens_index(F.col("v")), v="The cat_and dog; 42 b cat") == ["cat", "dog"]
    assert one(spark, text.tokens_alnum(F.col("v")), v="A-b a") == ["a", "b", "a"]
    assert one(spark, text.tokens_index(F.col("v")), v="x" * 51) == []


def test_typed_tokens(spark):
    df = spark.sql("SELECT 7L AS id, 'Red Ring' AS name, 12 AS size, 3.456D AS price, DATE '2024-02-03' AS made, true AS ok, "
                   "TIMESTAMP '2020-01-01 00:00:00' AS created_at, CAST(null AS STRING) AS note, 5 AS one_digit")
    got = df.select(text.tokens_typed(df.schema, "id")).head()[0]
    assert got == ["red", "ring", "12", "3.46", "2024", "2024-02", "2024-02-03", "true"]


def test_tagged_lines_skip_comments_and_bad_ids(spark):
    lines = spark.createDataFrame([("1\tred ring",), ("# c\tx",), ("",), ("x\ty",), ("2",)], "value string")
    assert [tuple(r) for r in text.read_tagged_lines(lines).collect()] == [(1, "red ring")]


def test_cursor_that_is_none_gives_null(spark):
    schema = T.StructType([T.StructField("id", T.LongType())])
    assert one(spark, paging.decode_cursor(F.col("v"), schema), v="not-a-cursor") in (None, T.Row(id=None))


def test_every_domain_and_range_of_the_tables_is_checked(spark):
    cases = {
        "entity": [("gender", "F", "X"), ("status", "active", "gone"), ("risk_score", "100", "101")],
        "anchor": [("id_type", "PAN", "pan")],
        "property": [("property_type", "VESSEL", "BOAT"), ("ownership_percent", "0.01", "0.00"), ("ownership_percent", "100.00", "100.01")],
        "bank": [("account_type", "NRE", "PIGGY")],
        "social": [("platform", "GITHUB", "MYSPACE")],
        "remark": [("remark_type", "ALERT", "RUMOUR"), ("severity", "INFO", "info")]}
    for table, columns in cases.items():
        for name, good, bad in columns:
            kind = {"risk_score": "int", "ownership_percent": "decimal(5,2)"}.get(name, "string")
            df = spark.createDataFrame([(v,) for v in (good, bad, None)], f"{name} string").select(F.col(name).cast(kind).alias(name))
            broken = [r[0] for r in df.select(values.violations(values.table_rules(table, [name]))).collect()]
            rule = f"{name}_range" if kind != "string" else f"{name}_domain"
            assert broken == [[], [rule], []]


def test_token_hash_in_sql_is_exact_and_uses_no_wide_decimals(spark):
    sql_functions.register_scalars(spark)
    words = ["", "a", "Hello", "straße", "日本", "x" * 50, "ÿ\u0000z"]
    spark.createDataFrame([(w,) for w in words], "v string").createOrReplaceTempView("words")
    assert [int(r[1]) for r in sorted(spark.sql("SELECT v, token_hash(v) FROM words").collect())] == [fnv(w.lower()) for w in sorted(words)]
    assert "decimal(38" not in sql_functions.SCALARS["token_hash"][2].lower()


def test_spread_deals_the_rows_of_one_large_task(spark):
    from casegrain.session import spread

    rows = spark.range(0, 4000, 1, 1)
    sizes = [r["n"] for r in spread(rows).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 4000 and max(sizes) <= 400
    assert sorted(r["id"] for r in spread(rows, "id").collect()) == list(range(4000))


def test_keys_are_dealt_before_they_are_counted(spark):
    df = spark.createDataFrame([(i // 2, "x") for i in range(10)] + [(None, "x")] * 3 + [(99, "y")], "a int, b string")
    found = values.unique_violations(df, ["a", "b"])
    assert sorted((r["a"] is None, r["a"] or 0, r["copies"]) for r in found.collect()) == [(False, i, 2) for i in range(5)] + [(True, 0, 3)]
    plan = found._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hash") == 1 and plan.index("Exchange hash") > plan.rindex("HashAggregate")
