"""Duplicates among entities: shared identifiers, similar names, connected groups, shared risk.

Links form a star: every member points to the smallest member of its group. A group of n entities gives n - 1
links instead of n * (n - 1) / 2 pairs and says the same: two entities are a pair exactly when they share the centre.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, functions as F

from casegrain.operators.index import grouped_lists
from casegrain.operators.paging import top_per_group
from casegrain.session import spread, stored


def dup_groups(df: DataFrame, keys: Sequence[str], entity: str, max_items: int = 65536) -> DataFrame:
    """Groups with more than one entity: their members (in parts when crowded) and their size.

    The pairs are stored first: they are read twice, and making them may mean hashing long texts.
    """
    pairs = stored(df.select(*keys, entity).distinct(), "members").dropna(subset=list(keys))
    members = grouped_lists(pairs, keys, entity, max_items)
    return members.where(F.col("frequency") > 1)


def star_links(df: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """(entity_a, entity_b, keys): every entity of a group linked to the smallest one; null keys make no group.

    ``df`` is read twice, so store keys that are costly to make, such as hashes of long texts, before.
    """
    pairs = df.select(*keys, F.col(entity).alias("entity_b")).distinct()
    centres = df.groupBy(*keys).agg(F.min(entity).alias("entity_a"), F.max(entity).alias("_last"))
    centres = centres.where(F.col("entity_a") < F.col("_last")).drop("_last")
    return pairs.join(centres, list(keys)).where(F.col("entity_a") < F.col("entity_b"))


def typed_edges(links: DataFrame, match_type: str, similarity: float, detected_at: Column) -> DataFrame:
    return links.select("entity_a", "entity_b", F.lit(match_type).alias("match_type"),
                        F.lit(similarity).alias("similarity"), detected_at.alias("detected_at")).distinct()


def contact_edges(df: DataFrame, entity: str, handles: Sequence[str]) -> DataFrame:
    """Links between entities sharing a phone or an e-mail, each link once."""
    links = [star_links(df, [h], entity).select("entity_a", "entity_b") for h in handles]
    merged = links[0]
    for other in links[1:]:
        merged = merged.unionByName(other)
    return merged.distinct()


def deletions(name: Column, edits: int = 1) -> Column:
    """The text itself and every text that up to ``edits`` deletions make of it."""
    def shorter(text: Column) -> Column:
        cut = F.transform(F.sequence(F.lit(1), F.length(text)),
                          lambda i: F.concat(F.substr(text, F.lit(1), i - 1), F.substr(text, i + 1)))
        return F.when(F.length(text) == 0, F.array(text)).otherwise(cut)

    out = F.array(name)
    for _ in range(edits):
        out = F.array_distinct(F.concat(F.array(name), F.flatten(F.transform(out, shorter)), out))
    return out


def fuzzy_name_edges(df: DataFrame, entity: str, name: str, threshold: float = 0.8, edits: int = 1) -> DataFrame:
    """Links between entities whose names are equal or at most ``edits`` edits apart, with their similarity.

    Of those, links below ``threshold`` fall out; names further apart are never linked, however long they are. Equal names
    are linked as a star. Two names within ``edits`` edits share a text that at most as many deletions make of either, so
    an equi join on hashes of those texts finds all of them; a name of n letters has about n ** edits / edits! of them. The
    names travel with these hashes, not with the pairs that meet.
    """
    folded = df.select(F.col(entity).alias("_id"), F.lower(F.trim(F.col(name))).alias("_name"))
    names = stored(folded.groupBy("_name").agg(F.min("_id").alias("_id")), "names")
    equal = star_links(folded, ["_name"], "_id").select("entity_a", "entity_b", F.lit(1.0).alias("similarity"))
    cuts = spread(names).select("_id", "_name", F.explode(F.transform(deletions(F.col("_name"), edits), lambda c: F.xxhash64(c))).alias("_cut"))
    # The planner takes exploded rows for as small as the stored names: without the hint it may send them through the driver.
    met = (cuts.select("_cut", F.col("_id").alias("entity_a"), F.col("_name").alias("_a")).hint("merge")
           .join(cuts.select("_cut", F.col("_id").alias("entity_b"), F.col("_name").alias("_b")), "_cut").where("entity_a < entity_b"))
    # Most names that meet are further apart, so they are compared where they meet and only links move on.
    close = met.select("entity_a", "entity_b", F.levenshtein("_a", "_b", edits).alias("_d"),
                       F.greatest(F.length("_a"), F.length("_b")).alias("_length"), F.xxhash64("_a", "_b").alias("_names")).where("_d >= 0")
    near = close.distinct().select("entity_a", "entity_b", (1 - F.col("_d") / F.col("_length")).alias("similarity"))
    return equal.unionByName(near.where(F.col("similarity") >= threshold))


def _most_edits(length: Column, threshold: float) -> Column:
    """Edits that a name of this length, the longer of two, may be away from one that is still similar enough."""
    return F.floor(length * (1 - threshold) + 1e-9).cast("int")


def _segment(i: Column, length: Column, edits: Column) -> tuple[Column, Column]:
    """Where segment ``i`` begins and how long it is, of a name cut into one segment more than ``edits``, as even as can be."""
    n = edits + 1
    each, longer_from = F.floor(length / n).cast("int"), n - length % n
    return i * each + F.greatest(F.lit(0), i - longer_from), each + (i >= longer_from).cast("int")


def _letters_before(name: Column) -> Column:
    """How often letters occur in the first 0, 1, 2 ... letters of a name: one number each, to be compared by ``_apart``.

    Letters fall into 16 classes by their code. A class has four bits, of which as many are set as it has letters, four at most.
    """
    def counted(seen: Column, letter: Column) -> Column:
        last, place = F.element_at(seen, -1), F.ascii(letter).bitwiseAND(15) * 4
        one, field = (F.call_function("shiftleft", F.lit(n).cast("bigint"), place) for n in (1, 15))
        return F.concat(seen, F.array(last.bitwiseOR(one).bitwiseOR(F.shiftleft(last.bitwiseAND(field), 1).bitwiseAND(field))))

    return F.aggregate(name, F.array(F.lit(0).cast("bigint")), counted)


def _apart(a: Column, b: Column) -> Column:
    """Letters that only one of two parts of names has, counted by ``_letters_before``.

    Parts that are ``e`` edits apart and differ by ``d`` in length cannot have more than ``2 * e - d`` of them.
    """
    return F.bit_count(a.bitwiseXOR(b))


def similar_name_edges(df: DataFrame, entity: str, name: str, threshold: float = 0.8) -> DataFrame:
    """Links between entities whose names are similar: 1 - edit distance / length of the longer one is at least ``threshold``.

    No number of edits is bound beforehand. A name is cut into one segment more than the edits it may be away, so a similar name
    that is not longer holds at least one of them unchanged, near the place where it stood: take the first segment ``i`` up to whose
    end there are no more than ``i`` edits, then it has none itself, at most ``i`` are before it and the others behind it. Names and
    their places are joined on a hash of length, segment number and text; where two meet, the letters before and behind the segment
    and those of both halves are compared first, as numbers, and the edit distance is taken of the few pairs that are left. Equal
    names are linked as a star. Names are trimmed and lower-cased; null and empty names have no links but those to equal ones.
    """
    folded = stored(df.select(F.col(entity).alias("_id"), F.lower(F.trim(F.col(name))).alias("_name")), "folded")
    equal = star_links(folded, ["_name"], "_id").select("entity_a", "entity_b", F.lit(1.0).alias("similarity"))
    names, letters = folded.where(F.length("_name") > 0).groupBy("_name").agg(F.min("_id").alias("_id")), F.split("_name", "")
    names = stored(spread(names).withColumns({
        "_length": F.length("_name"), "_before": _letters_before(letters), "_behind": _letters_before(F.reverse(letters))}), "names")
    longest = F.least(F.floor(F.col("_length") / threshold + 1e-9), F.lit(names.agg(F.max("_length")).head()[0] or 0)).cast("int")
    length, i, edits, shift = F.col("length"), F.col("i"), F.col("edits"), F.col("q") - F.col("begin")
    begin, size = _segment(i, length, edits)

    def placed(rows: DataFrame, at: Column, *more: Column) -> DataFrame:
        """Rows of (length, i, size) with the text of their names at ``at``, the letters on both sides of it and those of both halves."""
        text, half = F.substr("_name", at + 1, F.col("size")), F.least(F.floor(length / 2).cast("int"), F.col("_length"))
        return rows.select(F.xxhash64("length", "i", text).alias("_cut"), "_id", "_name", F.get("_before", at).alias("_before"),
                           F.get("_behind", F.col("_length") - at - F.col("size")).alias("_behind"),
                           F.get("_before", half).alias("_first"), F.get("_behind", F.col("_length") - half).alias("_second"), *more)

    def segments(rows: DataFrame) -> DataFrame:
        """Rows of names, once for each segment of names of ``length``."""
        cut = rows.withColumn("edits", _most_edits(length, threshold)).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("edits"))))
        return cut.withColumns({"begin": begin, "size": size})

    cut = placed(segments(names.withColumn("length", F.col("_length"))), F.col("begin"))
    near = segments(names.withColumn("length", F.explode(F.sequence(F.col("_length"), longest))))
    gap = length - F.col("_length")
    near = near.withColumns({"low": F.greatest(F.col("begin") - i, F.col("begin") - gap - (edits - i), F.lit(0)),
                             "high": F.least(F.col("begin") + i, F.col("begin") - gap + (edits - i), F.col("_length") - F.col("size"))})
    near = near.withColumn("q", F.explode(F.when(F.col("low") <= F.col("high"), F.sequence("low", "high"))))
    # Edits in the first half may move its end: that brings as many letters as the halves then differ in length, and the gap at most.
    met = placed(near, F.col("q"), (2 * i - F.abs(shift)).alias("_most_before"), (2 * (edits - i) - F.abs(shift + gap)).alias("_most_behind"),
                 (2 * edits + gap).alias("_most_halves"))
    # Both sides are dealt by hand: little is shuffled for the work that the pairs are, and the planner would make few tasks of it. It also
    # takes exploded rows for as small as the stored names: without the hint it sends them through the driver.
    x, y = spread(cut, "_cut").alias("x").hint("merge"), spread(met, "_cut").alias("y")
    most = _most_edits(F.length("x._name"), threshold)
    # Of two names of one length either may be the one that is cut; once is enough. One filter, as several would be turned round.
    pairs = (x.join(y, F.col("x._cut") == F.col("y._cut"))
             .where((_apart(F.col("x._before"), F.col("y._before")) <= F.col("_most_before"))
                    & (_apart(F.col("x._behind"), F.col("y._behind")) <= F.col("_most_behind"))
                    & (_apart(F.col("x._first"), F.col("y._first")) + _apart(F.col("x._second"), F.col("y._second")) <= F.col("_most_halves"))
                    & ((F.length("x._name") > F.length("y._name")) | (F.col("x._name") < F.col("y._name")))
                    & (F.call_function("levenshtein", "x._name", "y._name", most) >= 0))
             .select(F.col("x._id").alias("x"), F.col("y._id").alias("y"), F.col("x._name").alias("name_x"), F.col("y._name").alias("name_y")).distinct())
    links = pairs.select(F.least("x", "y").alias("entity_a"), F.greatest("x", "y").alias("entity_b"),
                         (1 - F.levenshtein("name_x", "name_y") / F.length("name_x")).alias("similarity"))
    return equal.unionByName(links)


def canonical_ids(edges: DataFrame, entities: DataFrame, entity: str, max_rounds: int = 50) -> DataFrame:
    """(entity, canonical_id, is_duplicate): the smallest id reachable over the links.

    Alternates two steps on the links until nothing changes: each entity sends its larger neighbours to the smallest
    entity it sees, then each entity hangs itself and its smaller neighbours below the smallest. Rounds grow with the
    logarithm of the longest chain. Every round is stored in the shared folder, so lineage stays short and a lost executor
    costs one round at most; only two numbers per round reach the driver.
    """
    def hang(directed: DataFrame, larger: bool) -> DataFrame:
        lowest = directed.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        moved = directed.join(lowest, "u")
        if larger:
            return moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        return moved.where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(
            lowest.where(F.col("u") != F.col("m")).select("u", F.col("m").alias("v")))

    def settle(links: DataFrame) -> tuple[DataFrame, dict]:
        """The stored links and their fingerprint, taken while they are written."""
        seen = Observation()
        watched = links.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("sum"))
        return stored(watched, "links"), seen.get

    links = (edges.select(F.greatest("entity_a", "entity_b").alias("u"), F.least("entity_a", "entity_b").alias("v"))
             .where("u <> v").distinct())
    links, seen = settle(links)
    for _ in range(max_rounds):
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = hang(both, larger=True).distinct()
        before = seen
        links, seen = settle(hang(large, larger=False).distinct())
        if seen == before:
            break
    else:
        raise RuntimeError(f"links did not settle in {max_rounds} rounds")
    centre = links.groupBy("u").agg(F.min("v").alias("_centre")).withColumnRenamed("u", entity)
    return (entities.select(entity).join(centre, entity, "left")
            .select(entity, F.coalesce("_centre", entity).alias("canonical_id"),
                    F.col("_centre").isNotNull().alias("is_duplicate")))


def risk_propagation(handles: DataFrame, risks: DataFrame, keys: Sequence[str], entity: str, least: int = 80) -> DataFrame:
    """Entities sharing a handle with another entity of high risk, with the highest such risk.

    Per handle only the two riskiest entities matter: everybody but the riskiest sees the first, that one the second.
    """
    members = handles.select(*keys, entity).distinct().join(risks.select(entity, "risk_score"), entity)
    top = top_per_group(members, keys, [("risk_score", "desc"), (entity, "asc")], 2)
    worst = top.groupBy(*keys).agg(
        F.max(F.when(F.col("position") == 1, F.col(entity))).alias("_first"),
        F.max(F.when(F.col("position") == 1, F.col("risk_score"))).alias("_risk_1"),
        F.max(F.when(F.col("position") == 2, F.col("risk_score"))).alias("_risk_2")).where(F.col("_risk_1") >= least)
    seen = F.when(F.col(entity) == F.col("_first"), F.col("_risk_2")).otherwise(F.col("_risk_1"))
    return (members.join(worst, list(keys)).withColumn("_seen", seen).where(F.col("_seen") >= least)
            .groupBy(entity, "risk_score").agg(F.max("_seen").alias("network_risk")))
