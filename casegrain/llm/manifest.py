"""Merkle manifest of a dataset: a content-addressed tree over all rows, and the proof of every row.

Rows are leaves; per source runs of ``fan`` consecutive digests become the digest of their concatenation until one is left,
and the sources' roots are joined to one root in the same way. Records map a digest to its children, by content alone. A
request for a leaf descends from the root by the digits of its rank in base ``fan``: at each record it takes the child that
the digit names and collects the others. Requests with the same leading digits travel as one until their digits differ, so
a level of the tree is one equi join on digests. A leaf's proof is its path, read backwards.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from casegrain.llm.common import held_out, query, table
from casegrain.session import stored

FAN = 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def joined_digest(*parts: Column) -> Column:
    """Lower-case hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts), 256)


def leaf_digest(**changed: Column) -> Column:
    """The digest of a row: each field as its UTF-8 byte count, ``:`` and its value, ``-`` where null."""
    values = [changed.get(f, F.col(f)).cast("string") for f in FIELDS]
    return joined_digest(*[F.coalesce(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v), F.lit("-")) for v in values])


def ranked(rows: DataFrame, tree: str, order: Sequence[str]) -> DataFrame:
    """Rows with ``rank`` (from 0, in the given order within their tree) and ``n`` (rows of the tree).

    Rows are ranged over tasks by tree and order, so a tree that holds most rows spreads over many tasks; ranks follow from
    the places inside a range and from how many rows of the tree the ranges before hold.
    """
    keys = [F.col(c).asc_nulls_first() for c in (tree, *order)]
    placed = stored(rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
                    .withColumn("_at", F.monotonically_increasing_id()), "placed")
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy(tree, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_rows"))
    whole = Window.partitionBy(tree)
    sizes = sizes.select(tree, "_range", "_first", F.sum("_rows").over(whole).alias("n"),
                         (F.sum("_rows").over(whole.orderBy("_range")) - F.col("_rows")).alias("_before"))
    return (placed.join(sizes, [tree, "_range"]).withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before"))
            .drop("_at", "_range", "_first", "_before"))


def grow(leaves: DataFrame, fan: int) -> tuple[list[DataFrame], DataFrame]:
    """From (tree, rank, n, digest) the records of each height, from 1, as (digest, children), and the roots (tree, height, digest).

    One shuffle a height, each a ``fan``-th of the one below. A lone leaf is its own root, of height 0.
    """
    level, height = leaves.select("tree", "rank", "n", "digest"), 0
    most = leaves.agg(F.max("n")).head()[0] or 0
    records, roots = [], []
    while True:
        roots.append(level.where("n = 1").select("tree", F.lit(height).alias("height"), "digest"))
        if most <= 1:
            return records, reduce(DataFrame.unionByName, roots)
        run = F.sort_array(F.collect_list(F.struct("rank", "digest")))["digest"]
        above = (level.where("n > 1").groupBy("tree", F.floor(F.col("rank") / fan).alias("rank"))
                 .agg(run.alias("children"), F.ceil(F.max("n") / fan).alias("n"))
                 .withColumn("digest", joined_digest(F.array_join("children", ""))))
        level, height, most = stored(above, "nodes"), height + 1, -(-most // fan)
        # Runs of equal leaves have equal digests: one record each.
        records.append(level.select("digest", "children").dropDuplicates(["digest"]))


def siblings(children: Column, digit: Column) -> Column:
    """The others of a run: those left of the chosen child and those right of it, each concatenated."""
    return F.struct(F.array_join(F.slice(children, F.lit(1), digit), "").alias("left"),
                    F.array_join(F.slice(children, digit + 2, F.greatest(F.size(children) - digit - 1, F.lit(0))), "").alias("right"))


def descend(requests: DataFrame, records: DataFrame, fan: int) -> DataFrame:
    """Requests (tree, rank, digest, path, ...) one height further down: one for each child, with its siblings at the path's end."""
    carried = [c for c in requests.columns if c not in ("rank", "digest", "path")]
    opened = requests.join(records, "digest").select(*carried, "rank", "path", "children", F.posexplode("children").alias("digit", "digest"))
    return opened.select(*carried, (F.col("rank") * fan + F.col("digit")).alias("rank"), "digest",
                         F.concat("path", F.array(siblings(F.col("children"), F.col("digit")))).alias("path"))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings on its path, root first, make."""
    return F.aggregate(F.reverse(path), leaf, lambda at, s: joined_digest(s["left"], at, s["right"]))


def proof_digest(path: Column) -> Column:
    """The digest of all siblings on a path, from the leaf's run up, left to right."""
    return F.sha2(F.array_join(F.transform(F.reverse(path), lambda s: F.concat(s["left"], s["right"])), ""), 256)


def manifest(rows: DataFrame, fan: int = FAN) -> DataFrame:
    """Rows (source, doc_id, leaf, ...) with ``subroot``, ``root`` and ``path``: siblings (left, right) from the root down to the leaf.

    Sources are ordered with null first, then by UTF-8 bytes; leaves of a source by doc_id, null first, rows of equal doc_id by
    their digest. Rows that are equal throughout have equal leaves, and which of them stands first changes no digest. A run of
    one digest is hashed as well, except for a lone leaf or subroot, which is its own root. An empty table gives an empty result.
    """
    # Null becomes the empty text and others get a letter in front: the key is never null and keeps the order.
    keyed = rows.withColumn("tree", F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("")))
    leaves = stored(ranked(keyed, "tree", ["doc_id", "leaf"]), "leaves")
    records, roots = grow(leaves.withColumnRenamed("leaf", "digest"), fan)

    named = roots.select(F.lit("").alias("top"), F.col("tree").alias("source_tree"), "height", F.col("digest").alias("subroot"))
    tops = stored(ranked(named, "top", ["source_tree"]), "subroots")
    top_records, top_root = grow(tops.select(F.col("top").alias("tree"), "rank", "n", F.col("subroot").alias("digest")), fan)
    root = top_root.head()
    no_path = F.array().cast("array<struct<left:string,right:string>>")
    at = top_root.select("tree", F.lit(0).cast("bigint").alias("rank"), "digest", no_path.alias("path"))
    for one in reversed(top_records):
        at = descend(at, one, fan)
    found = stored(at.select("rank", "path").join(tops, "rank")
                   .select(F.col("source_tree").alias("tree"), "height", "subroot", "path"), "subroot-paths")

    start = found.select("tree", "height", "subroot", F.lit(0).cast("bigint").alias("rank"), F.col("subroot").alias("digest"), "path")
    at = start.where(F.col("height") == len(records)).drop("height")
    for height in range(len(records), 1, -1):
        at = descend(at, records[height - 1], fan).unionByName(start.where(F.col("height") == height - 1).drop("height"))
    # The last step goes the other way round: each leaf looks up its run and takes its digit there.
    lone = start.where("height = 0").select("tree", F.col("rank").alias("run"), "subroot", "path", F.array("digest").alias("children"), F.lit(True).alias("lone"))
    runs = lone
    if records:
        opened = at.join(records[0], "digest").select("tree", F.col("rank").alias("run"), "subroot", "path", "children", F.lit(False).alias("lone"))
        runs = opened.unionByName(lone)
    digit = (F.col("rank") % fan).cast("int")
    own = F.when(F.col("lone"), F.col("path")).otherwise(F.concat("path", F.array(siblings(F.col("children"), digit))))
    out = (leaves.withColumn("run", F.floor(F.col("rank") / fan)).join(runs, ["tree", "run"])
           .where(F.get("children", digit) == F.col("leaf")))
    kept = [c for c in rows.columns if c not in ("subroot", "root", "path")]
    return out.select(*kept, "subroot", F.lit(root["digest"] if root else None).cast("string").alias("root"), own.alias("path"))


def verified(docs: DataFrame, fan: int = FAN) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified for every row of ``docs``.

    ``docs`` has `FIELDS`, each of which may be null, and, where rows were changed, ``now``: the text as it is now. The
    manifest is that of the text as it was; ``folded_root`` is made from the leaf as it is now and the original siblings, so
    ``verified`` tells whether the row is still the one of the manifest. Other columns are not read. Texts of any length,
    repeated rows and ids, and an empty table are as `manifest` says.
    """
    now = F.col("now") if "now" in docs.columns else F.col("text")
    changed = ~now.eqNullSafe(F.col("text"))
    rows = docs.select("doc_id", "source", leaf_digest().alias("leaf"), F.when(changed, leaf_digest(text=now)).alias("leaf_now"))
    out = manifest(stored(rows, "digests"), fan)
    again = folded(F.col("path"), F.coalesce("leaf_now", "leaf"))
    return (out.select("doc_id", "leaf", "subroot", "root", proof_digest(F.col("path")).alias("proof_sha256"), again.alias("folded_root"))
            .withColumn("verified", F.col("folded_root") == F.col("root")))


_LEVELS = 14


def _sql() -> str:
    """The manifest, level by level, for up to 3 ** 14 rows of a source."""
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))"
    crc = f"list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(coalesce(doc_id::VARCHAR, ''), ''), lambda d: ascii(d)::BIGINT)), lambda c, b: {step})"
    field = lambda v: f"coalesce(strlen({v}::VARCHAR) || ':' || {v}, '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(v) for v in (*FIELDS[:4], text)) + ")"
    even = f"(({crc}) & 1) = 1"  # the last complement turns the last bit
    ctes = [f"d AS MATERIALIZED (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {even} THEN {leaf('replace(text, chr(10), chr(0)[:0])')} ELSE {leaf('text')} END AS now FROM documents)",
            "e AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM d)",
            "a0 AS MATERIALIZED (SELECT source AS t, r, n, leaf AS h FROM e)"]

    def tree(a: str, s: str) -> None:
        for k in range(_LEVELS):
            ctes.append(f"{s}{k} AS MATERIALIZED (SELECT t, r, n > 1 AS hashed, coalesce(string_agg(h, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS le, "
                        f"coalesce(string_agg(h, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS ri FROM {a}{k} WINDOW w AS (PARTITION BY t, r // 3 ORDER BY r))")
            ctes.append(f"{a}{k + 1} AS MATERIALIZED (SELECT t, r // 3 AS r, (n + 2) // 3 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h FROM {a}{k} GROUP BY t, r // 3, n)")

    tree("a", "s")
    ctes.append(f"b0 AS MATERIALIZED (SELECT 0 AS t, row_number() OVER (ORDER BY t NULLS FIRST) - 1 AS r, count(*) OVER () AS n, h, t AS source FROM a{_LEVELS})")
    tree("b", "u")
    ctes.append("f0 AS MATERIALIZED (SELECT *, now AS f, '' AS p FROM e)")
    up = "CASE WHEN hashed THEN sha256(le || f || ri) ELSE f END AS f, CASE WHEN hashed THEN p || le || ri ELSE p END AS p"
    for k in range(_LEVELS):
        ctes.append(f"f{k + 1} AS MATERIALIZED (SELECT doc_id, source, leaf, f.r // 3 AS r, {up} FROM f{k} f JOIN s{k} s ON f.source IS NOT DISTINCT FROM s.t AND f.r = s.r)")
    ctes.append(f"g0 AS MATERIALIZED (SELECT doc_id, leaf, b0.h AS subroot, b0.r AS r, f, p FROM f{_LEVELS} f JOIN b0 ON f.source IS NOT DISTINCT FROM b0.source)")
    for k in range(_LEVELS):
        ctes.append(f"g{k + 1} AS MATERIALIZED (SELECT doc_id, leaf, subroot, g.r // 3 AS r, {up} FROM g{k} g JOIN u{k} u ON g.r = u.r)")
    return ("WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, leaf, subroot, b{_LEVELS}.h AS root, sha256(p) AS proof_sha256, f AS folded_root, f = b{_LEVELS}.h AS verified "
            f"FROM g{_LEVELS} CROSS JOIN b{_LEVELS}")


@query("op13_merkle_manifest", _sql())
def op13_merkle_manifest(spark, sf_dir):
    """The proof of every document, and which of them tampering with line breaks has changed."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    return verified(docs.withColumn("now", F.when(held_out(2, 0), F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))))
