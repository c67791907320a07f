"""The stored token index: what searches read, upkeep by batches, deleted rows."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from casegrain.operators import postings
from casegrain.operators.postings import PostingsIndex
from casegrain.plans import indexes
from casegrain.plans.catalog import QUERIES
from casegrain.session import fresh_dir

SF = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def table(spark, rows):
    return spark.createDataFrame(rows, "id bigint, name string")


def test_searches_read_postings_alone(spark):
    kept = indexes.rows_index(spark, SF)
    for found in (kept.all_of(["en", "the"]), kept.all_known_of(["en", "nosuch"]), kept.any_of(["en", "the"])):
        plan = plan_of(found)
        assert "split" not in plan and "explode" not in plan and "Generate" not in plan
        assert "PushedFilters: [In(token, [" in plan or "PushedFilters: [EqualTo(token," in plan
        assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
        assert "parquet/index-rows" in plan.replace("file:", "parquet/") or "index-rows" in plan
    for name in ("postings_intersect", "postings_intersect_lenient", "hits_by_table", "search_any_ranked", "token_stats", "token_bitmap"):
        plan = plan_of(QUERIES[name](spark, SF))
        assert "split(" not in plan and "documents.parquet" not in plan, name


def test_index_after_changes_is_the_index_built_anew(spark):
    draw = random.Random(4)
    words = [f"w{i}" for i in range(30)]
    now = {i: " ".join(draw.choices(words, k=5)) for i in range(200)}
    path = fresh_dir(spark, "changes")
    postings.write_batch(postings.row_postings(table(spark, list(now.items())), "t", "id"), path, 0)
    for batch in range(1, 5):
        touched = draw.sample(sorted(now), 40)
        old = [(i, now[i]) for i in touched if i in now]
        for i in touched[:15]:
            del now[i]
        now |= {i: " ".join(draw.choices(words, k=5)) for i in touched[15:]} | {1000 * batch + k: "fresh w1" for k in range(5)}
        new = [(i, now[i]) for i in [*touched[15:], *(1000 * batch + k for k in range(5))]]
        change = postings.changed_postings([postings.row_postings(table(spark, old), "t", "id", sign=-1)], [postings.row_postings(table(spark, new), "t", "id")])
        for _ in range(2):  # a batch that is written again replaces itself
            postings.write_batch(change, path, batch)
    kept = PostingsIndex(spark, path)
    anew = postings.row_postings(table(spark, list(now.items())), "t", "id").drop("sign")
    assert rows_of(kept.live()) == rows_of(anew)
    assert rows_of(kept.all_of(["fresh", "w1"])) == sorted(("t", i) for i, text in now.items() if {"fresh", "w1"} <= set(text.split()))
    held = defaultdict(set)
    for i, text in now.items():
        held[len({"w1", "w2", "w3"} & set(text.split()))].add(i)
    ranked = kept.any_of(["w1", "w2", "w3"], ["pk"]).collect()
    assert {r["pk"] for r in ranked} == held[1] | held[2] | held[3]
    assert [r["matched_terms"] for r in ranked] == sorted((r["matched_terms"] for r in ranked), reverse=True)
    folded = postings.compacted(kept, fresh_dir(spark, "folded"))
    assert rows_of(folded.live()) == rows_of(anew) and folded.postings().where("batch > 0 or sign < 1").isEmpty()


def test_deleted_rows_take_no_place_on_a_page(spark):
    rows = table(spark, [(i, "red car") for i in range(20)])
    path = fresh_dir(spark, "deleted")
    postings.write_batch(postings.row_postings(rows, "t", "id"), path, 0)
    postings.write_batch(postings.row_postings(rows.where("id >= 5"), "t", "id", sign=-1), path, 1)
    page = postings.search_page(PostingsIndex(spark, path), {"t": (rows, "id")}, ["red", "car"], 3)
    assert [r["id"] for r in page.rows.collect()] == [4, 3, 2] and page.has_more and page.hits == {"t": 5}
    rest = postings.search_page(PostingsIndex(spark, path), {"t": (rows, "id")}, ["red", "car"], 3, page.cursor)
    assert [r["id"] for r in rest.rows.collect()] == [1, 0] and not rest.has_more and rest.hits == {"t": 5}
    none = postings.search_page(PostingsIndex(spark, path), {"t": (rows, "id")}, ["blue"], 3)
    assert none.rows.isEmpty() and none.cursor is None and not none.has_more and none.hits == {"t": 0}
    assert postings.search_page(PostingsIndex(spark, path, 0), {"t": (rows, "id")}, ["red"], 3).hits == {"t": 20}


def test_rows_of_a_hot_token_are_spread_over_files(spark):
    path = fresh_dir(spark, "hot")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join so few rows again
    try:
        postings.write_batch(postings.row_postings(spark.range(4000).select("id", F.lit("common").alias("name")), "t", "id"), path, 0)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    files = spark.read.parquet(path).groupBy(F.col("_metadata.file_path")).count().collect()
    assert len(files) > 1 and max(r["count"] for r in files) < 4000


def test_rows_move_before_they_are_split_and_their_postings_stay(spark):
    made = postings.row_postings(table(spark, [(1, "red pen"), (1, "red pen"), (None, "blue"), (2, None)]), "t", "id")
    plan = plan_of(made)
    assert plan.count("Exchange") == 1 and plan.index("Generate") < plan.index("Exchange")
    assert sorted((r["token"], r["pk"] or 0, r["sign"]) for r in made.collect()) == [("blue", 0, 1)] + [("pen", 1, 1)] * 2 + [("red", 1, 1)] * 2


def test_entities_whose_source_row_is_gone_stay_in_the_layers(spark):
    kept, entities = indexes.entity_index(spark, SF)
    none = spark.createDataFrame([], "p_partkey bigint, brand string")
    found = postings.search_layers(kept, entities, {"part": (none, "p_partkey")}, ["red", "nosuch"], 5).collect()
    assert len(found) == 5 and found[0]["total"] > 5 and {r["brand"] for r in found} == {None}
    assert [r["entity_key"] for r in found] == sorted(r["entity_key"] for r in found)
