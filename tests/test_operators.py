"""Operators against brute force on small data, hot groups included."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from casegrain.operators import index, paging, profile, resolve, search, skew, tags
from casegrain.operators.joins import insert_absent


def records(spark, n=57):
    rng = random.Random(3)
    rows = [(i, rng.choice([None, 0, 1, 2, 3]), rng.choice("xyz")) for i in range(n)]
    return spark.createDataFrame(rows, "id bigint, value int, kind string")


@pytest.mark.parametrize("keys", [[("value", "desc"), ("id", "asc")], [("kind", "asc"), ("value", "desc"), ("id", "desc")], [("id", "asc")]])
def test_keyset_pages_add_up_to_the_sorted_table(spark, keys):
    df, seen, after = records(spark), [], None
    while True:
        page = paging.keyset_page(df, keys, 10, after)
        rows = page.collect()
        seen += [r["id"] for r in rows]
        if not rows[0]["has_more"]:
            break
        after = paging.next_cursor(page, keys)
    assert seen == [r["id"] for r in df.orderBy(*paging.order_by(keys)).collect()]


def test_pages_of_times_without_zone_do_not_depend_on_the_session(spark):
    df = spark.range(30).select("id", F.expr("TIMESTAMP_NTZ '2024-03-10 00:00:00' + make_dt_interval(0, 0, 20 * CAST(id AS INT))").alias("at"))
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        keys = [("at", "desc"), ("id", "asc")]
        first = paging.keyset_page(df, keys, 10)
        second = paging.keyset_page(df, keys, 10, paging.next_cursor(first, keys))
        assert sorted(r["id"] for r in second.collect()) == list(range(10, 20))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_total_survives_an_offset_past_the_end(spark):
    df = records(spark)
    assert paging.offset_page(df, [("id", "asc")], 10, 1000).count() == 0
    assert paging.total(df).head()["total"] == 57
    assert paging.page_with_total(df, [("id", "asc")], 5, 50).head()["total_count"] == 57


def test_top_per_group_limits_before_the_shuffle(spark):
    plan = paging.top_per_group(records(spark), ["kind"], [("value", "desc"), ("id", "asc")], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


@pytest.mark.parametrize("max_items", [3, 1000])
def test_grouped_lists_stay_whole_when_split(spark, max_items):
    pairs = spark.createDataFrame([("hot", i) for i in range(100)] + [("cold", 1), ("cold", 2)], "token string, id bigint")
    rows = index.grouped_lists(pairs, ["token"], "id", max_items).collect()
    for token, wanted in (("hot", list(range(100))), ("cold", [1, 2])):
        mine = [r for r in rows if r["token"] == token]
        assert sorted(i for r in mine for i in r["items"]) == wanted
        assert {r["frequency"] for r in mine} == {len(wanted)}
        assert all(r["items"] == sorted(r["items"]) for r in mine)
    assert len([r for r in rows if r["token"] == "hot"]) == (1 if max_items == 1000 else 34) or max_items == 3


@pytest.mark.parametrize("max_items", [4, 1000])
def test_ordered_lists_stay_whole_and_ordered_when_split(spark, max_items):
    rng = random.Random(5)
    rows = [(1, i, rng.choice([True, False]), rng.choice([None, 1, 2, 3])) for i in range(60)] + [(2, 100, True, 1), (2, 101, False, 2)]
    df = spark.createDataFrame(rows, "entity_id bigint, id bigint, is_primary boolean, score int")
    order = [("is_primary", "desc"), ("score", "desc"), ("id", "asc")]
    lists = skew.ordered_lists(df, "entity_id", order, {"id": F.col("id")}, "children", max_items)
    assert lists.split == (max_items == 4)
    got = lists.df.orderBy("entity_id", "part").collect()
    assert max(len(r["children"]) for r in got) <= max_items
    for entity in (1, 2):
        wanted = sorted((r for r in rows if r[0] == entity), key=lambda r: (not r[2], r[3] is None, -(r[3] or 0), r[1]))
        assert [c["id"] for r in got if r["entity_id"] == entity for c in r["children"]] == [r[1] for r in wanted]
    base = spark.createDataFrame([(1,), (2,), (3,)], "entity_id bigint")
    out = skew.attach_lists(base, "entity_id", [lists]).orderBy("entity_id", "part").collect()
    assert {r["entity_id"] for r in out} == {1, 2, 3}
    assert sum(len(r["children"] or []) for r in out) == len(rows)


def test_star_links_say_the_same_as_all_pairs(spark):
    rng = random.Random(9)
    rows = [(e, f"h{rng.randint(0, 6)}") for e in range(40)] + [(50, None), (51, None)]
    df = spark.createDataFrame(rows, "entity bigint, handle string")
    links = resolve.star_links(df, ["handle"], "entity").collect()
    pairs = {(a, b) for (a, x), (b, y) in itertools.combinations(rows, 2) if x is not None and x == y}
    members = {}
    for r in links:
        members.setdefault(r["entity_a"], {r["entity_a"]}).add(r["entity_b"])
    assert {p for group in members.values() for p in itertools.combinations(sorted(group), 2)} == pairs


@pytest.mark.parametrize("seed, chain", [(1, False), (2, False), (0, True)])
def test_canonical_ids_match_union_find(spark, seed, chain):
    rng = random.Random(seed)
    edges = [(i, i + 1) for i in range(60)] if chain else [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)]
    parent = list(range(82))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        ra, rb = find(a), find(b)
        parent[max(ra, rb)] = min(ra, rb)
    nodes = spark.range(82).withColumnRenamed("id", "entity")
    got = resolve.canonical_ids(spark.createDataFrame(edges, "entity_a bigint, entity_b bigint"), nodes, "entity").collect()
    assert {r["entity"]: r["canonical_id"] for r in got} == {i: find(i) for i in range(82)}
    assert all(r["is_duplicate"] == (r["entity"] != r["canonical_id"]) for r in got)


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edits", [1, 2])
def test_fuzzy_names_match_brute_force(spark, edits):
    rng = random.Random(4)
    names = ["".join(rng.choice("ab") for _ in range(rng.randint(1, 6))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    got = {(r["entity_a"], r["entity_b"]): r["similarity"] for r in resolve.fuzzy_name_edges(df, "id", "name", 0.5, edits).collect()}
    first = {n: min(i for i, m in enumerate(names) if m == n) for n in names}
    wanted = {(first[n], i): 1.0 for i, n in enumerate(names) if first[n] < i}
    for a, b in itertools.combinations(sorted(first, key=first.get), 2):
        similarity = 1 - levenshtein(a, b) / max(len(a), len(b))
        if levenshtein(a, b) <= edits and similarity >= 0.5:
            wanted[(first[a], first[b])] = similarity
    assert got.keys() == wanted.keys()
    assert all(abs(got[k] - wanted[k]) < 1e-9 for k in got)


def test_risk_is_never_seen_from_oneself(spark):
    handles = spark.createDataFrame([("p", "h", 1), ("p", "h", 2), ("p", "g", 3)], "platform string, handle string, entity bigint")
    risks = spark.createDataFrame([(1, 95), (2, 10), (3, 99)], "entity bigint, risk_score int")
    got = resolve.risk_propagation(handles, risks, ["platform", "handle"], "entity").collect()
    assert [(r["entity"], r["network_risk"]) for r in got] == [(2, 95)]


def postings(spark):
    rows = [("red", "t", i) for i in range(-70, 200, 3)] + [("ring", "t", i) for i in range(-70, 200, 5)] + [("red", "u", 1)]
    return spark.createDataFrame(rows, "token string, table_name string, pk bigint")


def test_strict_and_lenient_search(spark):
    idx, record = postings(spark), ["table_name", "pk"]
    both = {tuple(r) for r in search.postings_intersect(idx, ["red", "ring"], record).collect()}
    assert both == {("t", i) for i in range(-70, 200) if (i + 70) % 15 == 0}
    assert search.postings_intersect(idx, ["red", "nothing"], record).count() == 0
    assert search.postings_intersect_lenient(idx, ["red", "nothing", "ring"], record).count() == len(both)
    strict = {tuple(r) for r in search.postings_intersect(idx, ["ring"], record).collect()}
    lenient = {tuple(r) for r in search.postings_intersect_lenient(idx, ["ring", "nothing"], record).collect()}
    assert strict <= lenient


def test_bitmaps_give_the_same_hits_as_postings(spark):
    idx = postings(spark)
    bitmaps = index.token_bitmap(idx)
    hits = {tuple(r) for r in index.bitmap_intersect(bitmaps, ["red", "ring"]).collect()}
    assert hits == {tuple(r) for r in search.postings_intersect(idx, ["red", "ring"], ["table_name", "pk"]).collect()}
    merged = index.merge_bitmaps(bitmaps, bitmaps)
    assert {tuple(r) for r in index.bitmap_sizes(merged).collect()} == {("red", "t", 90), ("ring", "t", 54), ("red", "u", 1)}


def test_term_prefilter_loses_nothing(spark):
    df = spark.sql("SELECT id, concat('Word', id % 7, ' The') AS name, id * 1.5D AS price FROM range(50)")
    every = {tuple(r) for r in index.postings(df, "t", "id").where("token IN ('word3', '10.50', 'the')").collect()}
    assert {tuple(r) for r in index.postings(df, "t", "id", ["word3", "10.50", "the"]).collect()} == every


def test_search_columns_limits_each_column(spark):
    df = spark.createDataFrame([(i, "red", "Blue red" if i % 2 else "x") for i in range(30)], "id bigint, a string, b string")
    got = search.search_columns({"t": (df, "id")}, "RED", 4).groupBy("column_name").count().collect()
    assert {tuple(r) for r in got} == {("a", 4), ("b", 4)}


def test_insert_absent_takes_repeats_once(spark):
    have = spark.createDataFrame([(1, "a")], "k int, v string")
    new = spark.createDataFrame([(1, "b"), (2, "c"), (2, "c")], "k int, v string")
    assert sorted(tuple(r) for r in insert_absent(have, new, ["k"]).collect()) == [(1, "a"), (2, "c")]


def test_patch_keeps_what_is_not_supplied(spark):
    base = spark.createDataFrame([(1, "x", "y", "old"), (2, "x", "y", "old")], "k int, a string, b string, updated_at string")
    patch = spark.createDataFrame([(1, "", "new")], "k int, a string, b string")
    out = tags.patch_update(base, patch, "k", ["a", "b"], F.lit("now")).orderBy("k").collect()
    assert [tuple(r) for r in out] == [(1, "x", "new", "now"), (2, "x", "y", "old")]


def test_deleted_rows_take_no_place_on_a_page(spark):
    index_rows = spark.createDataFrame([(i, "t", w) for i in range(10) for w in ("a", "b")], "global_id long, table_name string, token string")
    rows = spark.createDataFrame([(i, "t", int(i >= 6)) for i in range(10)], "global_id long, table_name string, is_deleted int")
    page = search.search_all_tokens(index_rows, rows, ["a", "b"], 4)
    assert [(r["global_id"], r["has_more"]) for r in page.collect()] == [(i, True) for i in (5, 4, 3, 2)]
    rest = search.search_all_tokens(index_rows, rows, ["a", "b"], 4, paging.next_cursor(page, search.SEARCH_KEYS))
    assert [(r["global_id"], r["has_more"]) for r in rest.collect()] == [(1, False), (0, False)]


def test_every_source_of_a_page_is_looked_up(spark):
    named = spark.createDataFrame([(k, s, str(k % 4), "red") for k, s in enumerate("abcabcabcabc")],
                                  "entity_key long, source_table string, row_id string, token string")
    sources = {s: (spark.range(4).selectExpr(f"id AS {s}_id", f"concat('{s}', id) AS {s}_name"), f"{s}_id") for s in "abc"}
    found = search.search_three_layer(named.select("entity_key", "token"), named.drop("token"), sources, ["red", "none"], 7).collect()
    assert sorted((r["entity_key"], r[f"{r['source_table']}_name"], r["total"]) for r in found) == [
        (k, f"{'abc'[k % 3]}{k % 4}", 12) for k in range(7)]


def test_global_duplicates_by_table_and_their_references(spark):
    with_refs = spark.createDataFrame([(i, "x", "db", f"t{i % 2}") for i in range(4)] + [(4, "x", "", "t"), (5, "x", None, None), (6, "y", "other", "t")],
                                      "id long, word string, duplicate_db string, duplicate_table string")
    plain = spark.createDataFrame([(1, "x"), (2, "y")], "id long, word string")
    tables = {"refs": (with_refs, "id"), "plain": (plain, "id")}
    assert sorted(map(tuple, search.global_duplicate_refs(tables, "x").collect())) == [("db", "t0", "duplicate"), ("db", "t1", "duplicate")]
    assert search.global_duplicate_refs({"plain": (plain, "id")}, "x").count() == 0
    by_table = search.global_duplicates_by_table(search.search_global_duplicates(tables, "x")).collect()
    assert {r["table_name"]: ([x["pk"] for x in r["results"]], r["total_results"]) for r in by_table} == {"refs": ([*range(6)], 6), "plain": ([1], 1)}


def test_similar_names_are_those_of_brute_force(spark):
    draw = random.Random(8)
    texts = ["".join(draw.choices("abc ", k=draw.randint(0, 14))) for _ in range(120)]
    for text in list(texts):  # names a few edits away, long ones too
        for edits in (1, 3):
            letters = list(text * draw.choice((1, 3)))
            for _ in range(edits):
                at = draw.randint(0, len(letters))
                letters[at:at + draw.choice((0, 1))] = draw.choices("abcd", k=draw.choice((0, 1)))
            texts.append("".join(letters))
    rows = [(i, t) for i, t in enumerate([*texts, "shared segment", None, None])] + [(1000 + i, f"shared segment {i:03d}") for i in range(60)]
    df = spark.createDataFrame(rows, "id bigint, name string")
    first = {}
    for i, t in rows:
        if t is not None:
            first.setdefault(t.strip(" ").lower(), i)
    for threshold in (0.6, 0.8, 0.9):
        expected = {(first[t.strip(" ").lower()], i, 1.0) for i, t in rows if t is not None and first[t.strip(" ").lower()] != i}
        names = sorted(n for n in first if n)
        for k, a in enumerate(names):
            for b in names[k + 1:]:
                longer = max(len(a), len(b))
                if abs(len(a) - len(b)) <= longer * (1 - threshold) + 1e-9 and levenshtein(a, b) <= longer * (1 - threshold) + 1e-9:
                    expected.add((*sorted((first[a], first[b])), 1 - levenshtein(a, b) / longer))
        found = {(r["entity_a"], r["entity_b"], r["similarity"]) for r in resolve.similar_name_edges(df, "id", "name", threshold).collect()}
        assert {(a, b, round(s, 9)) for a, b, s in found} == {(a, b, round(s, 9)) for a, b, s in expected}


def test_name_joins_never_broadcast_exploded_names(spark):
    df = spark.createDataFrame([(i, f"name {i:05d}") for i in range(300)], "id bigint, name string")
    for edges in (resolve.fuzzy_name_edges(df, "id", "name", 0.8), resolve.similar_name_edges(df, "id", "name", 0.8)):
        plan = edges._jdf.queryExecution().sparkPlan().toString()
        joins = [line for line in plan.splitlines() if "Join" in line and ("_cut" in line or "s#" in line)]
        assert joins and all("SortMergeJoin" in line for line in joins), plan


def test_similar_names_compare_letters_before_they_compare_names(spark):
    draw = random.Random(9)
    names = {"shared " + "".join(draw.choices("abcdefgh\u00df\U0001f600", k=draw.randint(6, 20))) for _ in range(60)}
    for text in list(names):  # letters moved, doubled, cut off at either end
        at, n = draw.randint(0, len(text)), draw.randint(1, 3)
        names |= {text[n:] + text[:n], text[:at] + text[at:at + n] * 2 + text[at + n:], text[n:].strip(), text[:-n].strip(), text + text[-1] * n}
    names = sorted({t.strip(" ").lower() for t in (*names, "a" * 12, "a" * 13, "a" * 9 + "b" * 3, "ab" * 6, "ba" * 6, "ba" * 7)})
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    for threshold in (0.4, 0.8):
        edges = resolve.similar_name_edges(df, "id", "name", threshold)
        expected = {(i, k) for (i, a), (k, b) in itertools.combinations(enumerate(names), 2)
                    if levenshtein(a, b) <= max(len(a), len(b)) * (1 - threshold) + 1e-9}
        assert {(r["entity_a"], r["entity_b"]) for r in edges.collect()} == expected and expected
        plan = edges._jdf.queryExecution().optimizedPlan().toString()
        met = next(line for line in plan.splitlines() if "Join Inner" in line and "levenshtein" in line)
        assert met.index("bit_count") < met.index("levenshtein") and "lower(" not in plan  # names are made once


def test_fuzzy_name_edges_move_no_names_that_are_further_apart(spark):
    # All of these meet in one cut or more; few are one edit apart.
    names = [f"{i:03d}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(names)), "id bigint, name string")
    edges = resolve.fuzzy_name_edges(df, "id", "name", 0.5)
    assert edges.count() == sum(levenshtein(a, b) == 1 for a, b in itertools.combinations(names, 2))
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join Inner") == 2  # that of equal names, and the one in which others meet and are compared


def test_pairs_of_keys_that_repeat_are_dealt_before_they_are_made(spark):
    df = spark.createDataFrame([(1, ["a", "b"]), (1, ["b"]), (2, ["a"]), (None, ["c"]), (None, ["c"])], "k int, t array<string>")
    pairs = index.record_tokens(df, "k", F.col("t"))
    assert sorted((r["k"] or 0, r["token"]) for r in pairs.collect()) == [(0, "c"), (1, "a"), (1, "b"), (2, "a")]
    plan = pairs._jdf.queryExecution().executedPlan().toString().partition("Initial Plan")[0]
    assert plan.count("Exchange hash") == 1 and plan.index("Exchange hash") > plan.index("Generate")


def test_case_profiles_write_each_list_once(spark, tmp_path):
    from casegrain.plans.catalog import QUERIES

    at = str(tmp_path)
    tables = {
        "region": "SELECT 0 AS r_regionkey, 'ASIA' AS r_name", "nation": "SELECT 0 AS n_nationkey, 0 AS n_regionkey, 'INDIA' AS n_name",
        "customer": "SELECT id AS c_custkey, concat('Customer#', id) AS c_name, 'BUILDING' AS c_mktsegment, 0 AS c_nationkey, 1.0D AS c_acctbal FROM range(1000)",
        "documents": "SELECT id AS doc_id, 'en' AS lang, concat('text ', id) AS text, 'src' AS source FROM range(10)",
        "orders": """SELECT id * 50 + 1 AS o_orderkey, id % 1000 AS o_custkey, '1-URGENT' AS o_orderpriority, 'O' AS o_orderstatus, 1.0D AS o_totalprice,
                     TIMESTAMP '1995-01-01' AS o_orderdate FROM range(14000)""",
        "lineitem": "SELECT o.id * 50 + 1 AS l_orderkey, pmod(xxhash64(o.id, n.id), 1000) AS l_suppkey, 'O' AS l_linestatus FROM range(14000) o CROSS JOIN range(10) n",
        "events": """SELECT id AS event_id, id AS user_id, 'login' AS event_type, 1.0D AS value, '{"k": 1}' AS props, TIMESTAMP '1995-01-01' AS ts FROM range(10)"""}
    for name, text in tables.items():
        spark.sql(text).write.parquet(f"{at}/{name}.parquet")
    usual = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    try:
        QUERIES["case_profiles"](spark, at).write.parquet(f"{at}/out")
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", usual)
    back = spark.read.parquet(f"{at}/out")
    lists = back.groupBy("entity_id").agg(F.first("cases").alias("cases"), F.count(F.lit(1)).alias("n"), F.countDistinct("cases").alias("different"))
    lists = lists.agg(F.sum(F.length("cases")), F.sum("n"), F.max("different"), F.sum(F.size(F.split("cases", ";")))).head()
    roles = spark.read.parquet(f"{at}/lineitem.parquet").distinct().where("l_orderkey % 50 <> 0").count()
    assert roles > 130_000 and lists[1:] == (roles, 1, roles)
    files = sum(f.stat().st_size for f in (tmp_path / "out").glob("*.parquet"))
    assert lists[0] > 3 << 20 and files < lists[0]


def test_rows_beside_profiles_do_not_come_in_the_order_of_their_keys(spark):
    rows = spark.range(4000).selectExpr("id AS case_id", "id % 40 AS entity_id")
    rows = rows.unionByName(spark.createDataFrame([(5000, None), (5001, 99)], "case_id bigint, entity_id bigint"))
    profiles = spark.sql("SELECT id % 40 AS entity_id, id DIV 40 AS part, concat('list of ', id) AS cases FROM range(43)")
    usual = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if there were many
    try:
        found = [tuple(r) for r in profile.beside(rows, profiles, "entity_id", 0).select("case_id", "entity_id", "part", "cases").collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", usual)
    assert sorted(found) == sorted((i, i % 40, k // 40, f"list of {k}") for i in range(4000) for k in (i % 40, i % 40 + 40) if k < 43)
    assert sum(a[1] == b[1] for a, b in itertools.pairwise(found)) < 0.2 * len(found)
