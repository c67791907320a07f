"""Language-model scores, collocations and the Merkle manifest: against brute force, and on tables of odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from casegrain.llm import collocations, manifest, scoring
from casegrain.llm.queries import QUERIES

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASHING = ["word", "n", "slice", "block", "tree", "rank", "path", "leaf", "root", "size", "group", "phrase", "score", "_row", "now", "top"]
ODD = [
    (None, None, None, None, None), (None, "no id at all", "en", None, 1), (1, None, "en", "a", None), (2, "", "en", "a", 0), (3, " \t\n ", None, "b", 3),
    (4, "x", "de", "b", 1), (5, "\x00 \U0001f600 ſ K İ 中文 ́\n\n", "fr", "", 5), (6, "!!! *** ???", "en", "b", 9), (7, "same words. here\nsame words", "en", "a", 90),
    (7, "same words. here\nsame words", "en", "a", 90), (8, "same words. here\nsame words", "en", "c", 90), (9, "long words and more of them " * 8_000, "es", "c", 7),
    (10, "y" * 150_000, "es", "c", 7), (11, "Mixed CASE words,words;more:words!", "en", "ß", 1), (12, "one  two\tthree\x0bfour\x0cfive\rsix", "und", "ß", None),
]


def odd(spark):
    return spark.createDataFrame(ODD, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def none(spark):
    return odd(spark).where("1 = 0")


# manifest

def sha(*parts):
    return hashlib.sha256("".join(parts).encode("utf-8")).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return sha(*["-" if v is None else f"{len(str(v).encode('utf-8'))}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def climb(digests, fan):
    """The root of these digests and, for each, the (left, right) siblings from its own run up."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for path, k in zip(paths, at):
            run = level[k // fan * fan:k // fan * fan + fan]
            path.append(("".join(run[:k % fan]), "".join(run[k % fan + 1:])))
        level = [sha(*level[i:i + fan]) for i in range(0, len(level), fan)]
        at = [k // fan for k in at]
    return level[0], paths


def brute_manifest(rows, now_of, fan):
    trees = defaultdict(list)
    for r in rows:
        trees[r[3]].append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode("utf-8")))
    made = {s: climb([x[2] for x in sorted(trees[s], key=lambda x: x[:3])], fan) for s in order}
    root, tops = climb([made[s][0] for s in order], fan)
    out = []
    for s, top in zip(order, tops):
        for (_, _, leaf, r), path in zip(sorted(trees[s], key=lambda x: x[:3]), made[s][1]):
            whole, folded = path + top, leaf_of(r[0], now_of(r), *r[2:])
            for left, right in whole:
                folded = sha(left, folded, right)
            out.append((r[0], leaf, made[s][0], root, sha(*[x for pair in whole for x in pair]), folded, folded == root))
    return out


@pytest.mark.parametrize("fan", [2, 3])
def test_manifest_is_that_of_brute_force(spark, fan):
    draw = random.Random(3)
    more = [(i, f"line {i}\nand {draw.random()}", "en", draw.choice(["a", "hot", "hot", "hot", f"s{i % 7}"]), i) for i in range(100, 330)]
    rows = [*ODD, *more]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in CLASHING if c != "now"])
    df = df.withColumn("now", F.when(F.col("doc_id") % 2 == 0, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text")))
    got = [tuple(r) for r in manifest.verified(df, fan).collect()]

    def now(r):
        return r[1].replace("\n", "") if r[0] is not None and r[0] % 2 == 0 and r[1] is not None else r[1]

    assert Counter(got) == Counter(brute_manifest(rows, now, fan))
    assert {g[6] for g in got} == {True, False}


def test_manifest_of_few_rows(spark):
    assert manifest.verified(none(spark).drop("now")).collect() == []
    one = spark.createDataFrame(ODD[:1], SCHEMA)
    row = manifest.verified(one).collect()[0]
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"] and row["proof_sha256"] == sha("")
    alike = spark.createDataFrame([ODD[8]] * 40, SCHEMA)  # all rows equal: every level has one record
    assert Counter(tuple(r) for r in manifest.verified(alike).collect()) == Counter(brute_manifest([ODD[8]] * 40, lambda r: r[1], 3))


# collocations

def brute_collocations(rows, least, words, keep, share):
    n, f = Counter(), Counter()
    for _, text, lang, *_ in rows:
        lang = "und" if lang is None else lang
        text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", text):
            run = [w for w in re.split("[ \t]+", piece) if w]
            n[lang] += len(run)
            for k in range(1, words + 1):
                f.update((lang, tuple(run[i:i + k])) for i in range(len(run) - k + 1))
    found = {x: a for x, a in f.items() if len(x[1]) > 1 and a >= least}
    hidden = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for i in range(len(p) - k + 1):
                if 100 * a >= share * f[lang, p[i:i + k]]:
                    hidden.add((lang, p[i:i + k]))
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) not in hidden:
            score, _, left, right = min((math.floor(Fraction(1000 * a * n[lang], f[lang, p[:k]] * f[lang, p[k:]])), k, f[lang, p[:k]], f[lang, p[k:]])
                                        for k in range(1, len(p)))
            out[lang].append((-score, -a, " ".join(p).encode("utf-8"), left, right))
    return [(lang, rank, p.decode("utf-8"), -a, left, right, n[lang], -score)
            for lang, all_ in out.items() for rank, (score, a, p, left, right) in enumerate(sorted(all_)[:keep], 1)]


@pytest.mark.parametrize("budget", [4, 200_000])
def test_collocations_are_those_of_brute_force(spark, budget):
    draw = random.Random(5)
    words = ["la", "de", "New", "York", "a", "a\x01", "a-b", "ß", "İ", "x" * 40]
    rows = [(i, "".join(draw.choice(words) + draw.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for _ in range(draw.randint(0, 60))),
             draw.choice(["en", "en", "en", "fr", None, "und"]), "s", i) for i in range(120)]
    rows = [*rows, *ODD, *[ODD[9]] * 3]
    df = spark.createDataFrame(rows, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    for least, keep, share in ((3, 2000, 100), (6, 10, 60)):
        got = collocations.collocations(df, least=least, keep=keep, share=share, budget=budget).collect()
        assert sorted(map(tuple, got)) == sorted(brute_collocations(rows, least, 5, keep, share))
    assert collocations.collocations(none(spark)).collect() == []


def test_large_counts_stay_exact():
    for size, kind in ((3, "small"), (1 << 40, "large")):
        columns = [np.array([size, 0, size, -1]), np.array([1, 2, 1, -1])]
        order, new = collocations.equal_rows(columns)
        assert [int(columns[0][i]) for i in order] == [-1, 0, size, size] and new.tolist() == [True, True, True, False], kind


def test_suffixes_are_added_up_in_few_tasks(spark, monkeypatch):
    rows = [(i, "one two three. four five six", "en", "s", 1) for i in range(400)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(40).select("lang", "text")
    few = 2 * spark.sparkContext.defaultParallelism
    assert collocations.fewer_tasks(docs, 10).rdd.getNumPartitions() == min(40, few)
    assert collocations.fewer_tasks(docs, (few + 3) * collocations.TASK_BYTES).rdd.getNumPartitions() == min(40, few + 3)
    seen, whole = [], collocations.leaves_of
    monkeypatch.setattr(collocations, "leaves_of", lambda d, *rest: seen.append(d.rdd.getNumPartitions()) or whole(d, *rest))
    _, found = collocations.counts(docs)
    assert {(r["phrase"], r["a"]) for r in found.collect()} >= {("one two three", 400), ("five six", 400), ("four", 400)} and seen[0] <= few


def test_texts_are_cut_at_piece_ends_alone():
    text = b"a b. " * 1000 + b"c" * 5000
    parts = list(collocations.cut_texts([text, b"d e"], 300))
    whole = b"\n".join(parts).replace(b"\n", b" \n ").split()
    assert whole == (text.translate(collocations._FOLD) + b"\nd e").replace(b"\n", b" \n ").split()
    assert max(map(len, parts)) < 6000 and len(parts) > 5


# scores

BITS = (18, 18, 18, 18)


def tokens_of(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")), "\n"]


def test_base_scores_are_those_of_brute_force(spark, monkeypatch):
    monkeypatch.setattr(scoring, "frequent_words", lambda counts, most=3, own=scoring.frequent_words: own(counts, 3))
    draw = random.Random(6)
    train = [(i, " ".join(draw.choices(["one", "two", "Three", "vier", "中文"], k=draw.randint(0, 30))), "en", "s", 1) for i in range(60)]
    known = spark.createDataFrame(train, SCHEMA)
    trained = scoring.train(known, BITS)
    counts = Counter(w for r in train for w in tokens_of(r[1]))
    total, distinct = sum(counts.values()), len(counts)
    assert (trained.tokens, trained.distinct) == (total, distinct) and {r["word"]: r["n"] for r in trained.counts.collect()} == counts
    asked = [*ODD, *train[:5], (99, "one two unseen three unseen\nfour", "en", "s", 1)]
    df = spark.createDataFrame(asked, SCHEMA).select("*", *[F.lit("clash").alias(c) for c in CLASHING])
    got = scoring.scored(df, trained).collect()
    assert set(got[0].asDict()) == {*df.columns, "n_tokens", "n_known", "base_score", "score"} - {"text"}
    want = Counter()
    for r in asked:
        own = tokens_of(r[1])
        base = sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in own)
        want[r[0], len(own), sum(counts[w] > 0 for w in own), round(base, 4)] += 1
    assert Counter((r["doc_id"], r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in got) == want
    assert all(r["score"] < 0 for r in got)


def small_model(texts):
    code = scoring.prefix_code(np.bincount(scoring.stream(texts), minlength=256))
    tally = scoring.Tally(code, BITS)
    tally.add_slots(scoring.stream(texts))
    model = scoring.Model(code, BITS, [scoring.states(t) for t in tally.tables], np.zeros((scoring.GATES, scoring.INPUTS), dtype=np.float32))
    model.weights = scoring.fitted_weights(model, texts[:20])
    return model, tally


def test_scores_are_those_of_mixing_one_decision_after_the_other():
    draw = random.Random(9)
    texts = [" ".join(draw.choices(["ab", "abc", "ba", "zu", "中"], k=draw.randint(0, 300))) for _ in range(40)]
    model, tally = small_model(texts)
    slots = defaultdict(lambda: [0, 0])
    for text in texts:  # counts kept by context itself
        data = scoring.stream([text])
        sizes, point, bit = model.code.decisions(data)
        first = scoring.contexts(data, BITS)
        for k in range(scoring.CONTEXTS):
            for s, b in zip(scoring.slots(first[k], sizes, point, BITS[k]).tolist(), bit.tolist()):
                slots[k, s][b] += 1
    for k, table in enumerate(tally.tables):
        assert {(s, *c) for (j, s), c in slots.items() if j == k} == {(i, *c) for i, c in enumerate(table.reshape(-1, 2).tolist()) if any(c)}
    for text in [*texts[:4], "ab unseen ba", ""]:
        data = scoring.stream([text])
        sizes, bit, x, gate = model.inputs(data, scoring.contexts(data, BITS))
        own, slope, total, at, left = np.zeros(scoring.INPUTS), np.zeros(scoring.INPUTS), 0.0, 0, scoring.BLOCK
        for size in sizes:
            for _ in range(size):
                xs = x[:, at].astype(float)
                p = 1 / (1 + math.exp(-float((model.weights[gate[at]] + own) @ xs)))
                total += math.log(p if bit[at] else 1 - p)
                slope += (bit[at] - p) * xs
                at += 1
            left -= 1
            if not left:
                own, slope, left = own + scoring.RATE * slope, np.zeros(scoring.INPUTS), scoring.BLOCK
        assert abs(total - scoring.log_likelihoods(model, [text])[0]) < 1e-3 * max(1, abs(total))


def test_scores_do_not_depend_on_neighbours_or_segments(monkeypatch):
    draw = random.Random(10)
    texts = ["", "one", " ".join(draw.choices(["ab", "abc", "ba", "zu"], k=90_000)), "z" * 300_000, "two words", ""]
    model, _ = small_model([t[:2000] for t in texts])
    together = scoring.log_likelihoods(model, texts)
    alone = [scoring.log_likelihoods(model, [t])[0] for t in texts]
    monkeypatch.setattr(scoring, "_SEGMENT", 1 << 30)
    whole = scoring.log_likelihoods(model, texts)
    assert np.allclose(together, alone, rtol=1e-3) and np.allclose(together, whole, rtol=1e-3)  # sums of 32-bit roundings


def test_codes_are_complete():
    for counts in (np.zeros(256, dtype=np.int64), np.arange(256) ** 3):
        code = scoring.prefix_code(counts)
        assert sum(Fraction(1, 2 ** int(s)) for s in code.sizes) == 1
        sizes, point, bit = code.decisions(np.arange(256, dtype=np.uint8))
        ends = np.append(0, np.cumsum(sizes))
        paths = {tuple(zip(point[a:b].tolist(), bit[a:b].tolist())) for a, b in zip(ends[:-1], ends[1:])}
        assert len(paths) == 256 and len({p for path in paths for p, _ in path}) == 255


def test_scores_of_a_model_of_nothing(spark):
    trained = scoring.train(none(spark), BITS)
    assert (trained.tokens, trained.distinct) == (0, 0)
    rows = scoring.scored(odd(spark), trained).collect()
    assert len(rows) == len(ODD) and {r["n_known"] for r in rows} == {0}
    assert all(math.isclose(r["base_score"], 0.0, abs_tol=1e-9) for r in rows)  # (0 + 0.5) / (0 + 0.5) a token
    assert scoring.scored(none(spark), trained).collect() == []


def test_held_out_documents_score_above_their_word_counts(spark):
    out = QUERIES["op11_context_mixing"](spark, "/root/testdata/sf0.01")
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    assert out.count() == docs.count() and out.columns[:6] == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score"]
    sums = out.where("held_out").agg(F.sum("score"), F.sum("base_score"), F.sum("n_tokens")).first()
    assert sums[0] > sums[1] and sums[2] > 10_000
    ids = {r["doc_id"] for r in out.where("held_out").collect()}
    assert ids == {r["doc_id"] for r in docs.collect() if zlib.crc32(str(r["doc_id"]).encode()) % 5 == 1}


def test_every_text_fills_the_slots_and_fits_the_weights(spark):
    draw = random.Random(12)
    rows = [(i, " ".join(draw.choices(["one", "two", "three", "vier"], k=draw.randint(0, 30))), "en", "s", 1) for i in range(200)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    trained = scoring.train(docs, BITS)
    tally = scoring.Tally(trained.model.code, BITS)
    tally.add_slots(scoring.stream([r[1] for r in rows]))
    assert all(np.array_equal(a, scoring.states(b)) for a, b in zip(trained.model.tables, tally.tables))
    assert np.abs(trained.model.weights - scoring.together(tally.fit.learned())).max() < 1e-4
    less = scoring.Tally(trained.model.code, BITS)
    less.add_slots(scoring.stream([r[1] for r in rows[:-1]]))
    assert np.abs(trained.model.weights - scoring.together(less.fit.learned())).max() > 1e-4
    # What parts of the rows learned adds up, whatever their order.
    parts = np.array([tally.fit.learned(), less.fit.learned()])
    assert np.array_equal(scoring.together(parts[0] + parts[1]), scoring.together(parts[1] + parts[0]))
    assert np.allclose(scoring.together(np.zeros_like(parts[0])), scoring._EQUAL, atol=1e-5)


def test_bytes_before_choose_the_code(spark):
    draw = random.Random(13)
    texts = [" ".join(draw.choices(["one", "two", "three", "vier", "\u00e9t\u00e9"], k=draw.randint(0, 30))) for _ in range(100)] + [None, "", "x" * 700]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA)
    data = scoring.stream([t or "" for t in texts])
    plain = scoring.prefix_code(np.bincount(data, minlength=256))
    for most in (0, 3, 512):
        code = scoring.byte_code(docs, most)
        sizes, point, bit = code.decisions(data)
        assert sizes.sum() < plain.decisions(data)[0].sum()
        # Every byte has a path wherever it comes, and paths are complete.
        assert all(sum(Fraction(1, 2 ** int(s)) for s in code.sizes[at:at + 256]) == 1 for at in set(code.choice.tolist()))
        # The paths tell the bytes, from the two bytes of the word before alone.
        paths = {at: {} for at in set(code.choice.tolist())}
        for at, found in paths.items():
            for byte in range(256):
                low = int(code.begins[at + byte])
                found[tuple(zip(code.points[low:low + code.sizes[at + byte]].tolist(), code.bits[low:low + code.sizes[at + byte]].tolist()))] = byte
        back, steps = [], list(zip(point.tolist(), bit.tolist()))
        upto = np.append(0, np.cumsum(sizes)).tolist()
        for a, b in zip(upto[:-1], upto[1:]):
            word = bytes(back).replace(b"\n", b" ").rsplit(b" ", 1)[-1][-2:].rjust(2, b"\0")
            back.append(paths[int(code.choice[word[0] * 256 + word[1]])][tuple(steps[a:b])])
        assert bytes(back) == data.tobytes()
