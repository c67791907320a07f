"""Operators on documents: against brute force, exact round trips and held-out rows, and on tables of odd rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import check
import corpus_pipeline
from casegrain.llm import bagminhash, chat, common, extract, language, mixing, packing, phrases, secrets, topk, toxicity
from casegrain.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Columns that operators use or give themselves.
CLASHING = ["node", "keys", "key", "size", "start", "target", "rank", "task", "piece", "secrets", "toxic_score", "lang_nearest",
            "main_text", "cell", "part", "_n", "_hash", "_key", "_copy", "extra", "held_out", "turn_block", "split", "v", "rid"]

ODD = [
    (None, None, None, None, None), (None, "no id at all, but five words", "en", None, 1), (1, None, "en", "a", None), (2, "", "en", "a", 0),
    (3, " \t\n ", None, "b", 3), (4, "x", "de", "b", 1), (5, "\x00 \U0001f600 ſ Kelvin K İ 中文 ́", "fr", "", 5), (6, "!!! *** ???", "en", "b", 9),
    (7, "same words here for all of us " * 3, "en", "a", 90), (7, "same words here for all of us " * 3, "en", "a", 90),
    (8, "same words here for all of us " * 3, "en", "c", 90), (9, "long words and more of them " * 20_000, "es", "c", 7),
    (10, "y" * 100_000, "es", "c", 7), (11, 'token = "aaaaaa" password=short AKIA' + "Z" * 30 + " deadbeef" * 4 + " " + "0a" * 20, "en", "a", 1),
]


def odd(spark):
    rows = spark.createDataFrame(ODD, SCHEMA)
    return rows.select("*", *[F.lit("clash").alias(c) for c in CLASHING])


def none(spark):
    return odd(spark).where("1 = 0")


def collected(df):
    return [r.asDict(recursive=True) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, name):
    problem, n = check.compare(spark, check.connect(SF), name, QUERIES[name], ORACLES[name], SF)
    assert problem is None and n, problem


def test_all_queries_are_registered():
    assert sorted(int(re.match(r"op(\d+)_", k)[1]) for k in QUERIES) == list(range(1, 14))


# language

def test_languages_of_held_out_texts(spark):
    out = QUERIES["op1_language_id"](spark, "/root/testdata/sf0.01").join(
        spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out")
    right, total = out.agg(F.sum((F.col("lang") == F.col("lang_pred")).cast("int")), F.count("*")).first()
    assert right >= 0.98 * total > 100


def test_language_of_odd_rows(spark):
    model = language.train(odd(spark))
    rows = collected(language.identify(odd(spark), model))
    assert len(rows) == len(ODD)
    for r in rows:
        letters = any(map(str.isalpha, r["text"] or ""))
        assert (r["lang_nearest"] != "und") == letters and 0 <= r["lang_score"] <= 1
    nothing = language.train(none(spark))
    assert {r["lang_nearest"] for r in collected(language.identify(odd(spark), nothing))} == {"und"}
    assert collected(language.identify(none(spark), model)) == []


def test_far_text_is_rejected(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.train(docs.select("text", "lang"))
    strange = spark.createDataFrame([("яблоко и груша растут в саду у старого дома",)], "text string")
    assert collected(language.identify(strange, model))[0]["lang_rejected"]


def test_language_made_of_copies_only(spark):
    words = {"aa": "the cat and the dog run to a house ", "bb": "der hund und die katze gehen nach haus ",
             "cc": "zwykly kot oraz pies idzie do swojego domu "}
    large = spark.range(3000).selectExpr(f"concat('{words['aa']}', id) text", "'aa' lang")
    # ten thousand rows of a few texts each: a share of the rows would miss most of them, and with them their language
    copies = spark.range(10_000).selectExpr(f"concat('{words['bb']}', repeat('und ', cast(id % 3 as int))) text", "'bb' lang")
    hot = spark.range(10_000).selectExpr(f"'{words['cc']}' text", "'cc' lang")
    model = language.train(large.union(copies).union(hot))
    assert Counter(model.languages) == {"aa": language.CENTROIDS, "bb": 3, "cc": 1}
    asked = spark.createDataFrame([(lang, text) for lang, text in words.items()], "lang string, text string")
    assert all(r["lang_nearest"] == r["lang"] for r in collected(language.identify(asked, model)))
    for text in range(12):
        alone = language.train(spark.range(2000).selectExpr(f"concat('{words['bb']}', '{chr(97 + text) * 5}') text", "'bb' lang"))
        assert alone.languages == ["bb"]


def test_copies_do_not_change_the_language_sample(spark):
    docs = spark.range(2500).selectExpr("translate(md5(string(id)), '0123456789', 'ghijklmnop') text", "'aa' lang")
    seen = language.train(docs, fit_rows=200, k=1)
    again = language.train(docs.union(docs).union(docs).repartition(5), fit_rows=200, k=1)
    assert np.allclose(seen.centroids, again.centroids, atol=1e-3)


# mixing

def test_targets_stop_at_three_times_the_size():
    assert mixing.targets([100, 100, 100]) == [500 / 8 * 3, 75.0, 37.5]
    out = mixing.targets([10, 1000, 1000, 0])
    assert out[0] == 30 and out[3] == 0 and abs(sum(out) - 2010) < 1e-9
    assert mixing.targets([0, 0]) == [0, 0]


def test_schedule_ranks_every_block_once(spark):
    need = [700, 90, 10, 0, 1]
    rows = collected(mixing.schedule(spark, need, 10))
    assert sorted((r["source_ix"], r["rank"]) for r in rows) == [(s, k) for s, n in enumerate(need) for k in range(-(-n // 10))]
    first = [r["source_ix"] for r in sorted(rows, key=lambda r: r["slot"])[:40]]
    assert 30 <= first.count(0) <= 38 and 2 <= first.count(1) <= 8


def test_mix_of_odd_rows_takes_what_it_should(spark):
    mixed = mixing.mix(odd(spark), block=7)
    rows = collected(mixing.counted(odd(spark), mixed))
    assert len(rows) == len(ODD)
    sums, goals, sizes = Counter(), {}, Counter()
    for r in rows:
        assert 0 <= r["taken"] <= 3 * r["size"]
        sums[r["source"]] += r["taken"]
        sizes[r["source"]] += r["size"]
        goals[r["source"]] = r["target"]
    for s, goal in goals.items():
        assert abs(sums[s] - goal) <= 0.5 and goal <= 3 * sizes[s]
    taken = collected(mixed.taken)
    assert all(0 < r["words"] <= 7 for r in taken)
    assert mixing.mix(none(spark)) is None and collected(mixing.counted(none(spark), None)) == []
    again = collected(mixing.counted(odd(spark), mixing.mix(odd(spark).repartition(5), block=7)))
    assert sorted(map(str, again)) == sorted(map(str, rows))


# packing

def brute_best_fit(lengths, capacity):
    rooms = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(rooms) if r >= n]
        if fits:
            i = min(fits, key=lambda i: rooms[i])
            rooms[i] -= n
        else:
            rooms.append(capacity - n)
    return len(rooms)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(5)
    for _ in range(60):
        capacity = rng.choice([7, 10, 64])
        lengths = [rng.randint(1, capacity) for _ in range(rng.randint(0, 120))]
        counts = Counter(lengths)
        plan, bins = packing.best_fit_decreasing(counts, capacity)
        assert bins == brute_best_fit(lengths, capacity)
        used = {}
        for length, n in counts.items():
            steps = sorted(p for p in plan if p[0] == length)
            for rank in range(n):
                _, first_rank, each, first, base = [s for s in steps if s[1] <= rank][-1]
                at = rank - first_rank
                used.setdefault(first + at // each, []).append((base + at % each * length, length))
        for places in used.values():
            upto = 0
            for offset, length in sorted(places):
                assert offset == upto
                upto += length
            assert upto <= capacity


def test_words_encode_like_whole_texts():
    rng = random.Random(3)
    parts = [*"aBcDé'.,;!…»<|>t s  \n\t\r\x1c\xa0́Ä1２ΣσÖß中*#%&$\"]()’ſK", "<|endoftext|>", "it's", "don't ", "&&& ", "end. ", "İ"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 40))) for _ in range(3000)]
    encode = packing.WordEncoder(packing.public_tokenizer(), most=2000)
    for at in range(0, len(texts), 500):
        ids, offsets = encode(texts[at:at + 500])
        for text, a, b in zip(texts[at:at + 500], offsets[:-1], offsets[1:]):
            assert encode.tokenizer.encode(text, add_special_tokens=False).ids == ids[a:b].tolist()


def test_marks_behind_letters_are_found_from_the_marks():
    assert packing._TAIL.sub(rb" \g<0>", b"end.) x. y.z 1. a, b;;\n") == b"end .) x . y.z 1. a , b ;;\n"


def test_packed_sequences_hold_the_documents(spark):
    path = packing.public_tokenizer()
    tokenizer = packing.WordEncoder(path).tokenizer
    packed = packing.pack(odd(spark), path, keep_ids=True)
    rows = collected(packed)
    want = Counter()
    for _, text, *_ in ODD:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for at in range(0, len(ids), 2048):
            cut = ids[at:at + 2048]
            want[at, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes())] += 1
    assert Counter((r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    whole = {r["sequence_id"]: r["ids"] for r in collected(packing.sequences(packed))}
    for r in rows:
        assert whole[r["sequence_id"]][r["offset"]:r["offset"] + r["length"]] == r["ids"]
    assert sum(map(len, whole.values())) == sum(r["length"] for r in rows) and max(map(len, whole.values())) <= 2048
    assert len(whole) == brute_best_fit([r["length"] for r in rows], 2048)
    assert collected(packing.pack(none(spark), path)) == []


# chat

def test_rotation_marks_the_speakers_own_words(spark):
    rows = [(1, 0, "ann", "hi"), (1, 1, "bob", "ho"), (1, 1, "bob", "ho"), (1, None, None, None), (1, 2, "system", "be kind"),
            (None, 5, "ann", "lost"), (2, 0, "system", "alone"), (1, 2_000_000, "ann", "late")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("split", F.lit("clash"))
    out = collected(chat.rotate(table))
    sides = {(r["conv_id"], r["perspective"]) for r in out}
    assert sides == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann")}
    for r in out:
        own = "".join(r["text"][s["start"]:s["end"]] for s in r["spans"])
        assert len(own) == r["assistant_chars"]
        if (r["conv_id"], r["perspective"], r["turn_block"]) == (1, "bob", 0):
            assert own == "ho<|im_end|>\n" and "user name=ann\nhi" in r["text"] and r["text"].count("ho<") == 1
    assert collected(chat.rotate(table.where("1 = 0"))) == []


def test_crowded_turns_are_split_in_order(spark):
    rows = [(None, k % 3, "ab"[k % 2], f"m{k}") for k in range(900)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = [r for r in collected(chat.rotate(table, part_rows=32)) if r["perspective"] == "a"]
    assert max(r["n_messages"] for r in out) <= 64 and sum(r["n_messages"] for r in out) == 900
    joined = "".join(r["text"] for r in sorted(out, key=lambda r: (r["turn_block"], r["split"])))
    order = [int(m) for m in re.findall(r"\nm(\d+)<", joined)]
    assert [k % 3 for k in order] == sorted(k % 3 for k in order)
    assert "Python" not in chat.rotate(table)._jdf.queryExecution().toString()


# secrets

def test_base_matches_are_those_of_the_patterns(spark):
    rng = random.Random(1)
    parts = ["token", "API_KEY", "apikey", "ſecret", "=", ":", " ", '"', "'", "abc", "deadbeef", "0123456789", "AKIA", "ZZZZZZZZ", "\n", "é", "x", "-", "."]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 60))) for _ in range(2000)] + [t or "" for _, t, *_ in ODD]
    for text, hexes, _ in zip(texts, *secrets.runs(texts)):
        want = [(m.start(), 0, m.end()) for m in re.finditer(
            r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert [(a, secrets.KINDS.index(k), b) for a, b, k, _ in secrets.base_spans(text, hexes)] == sorted(want)


def test_automata_know_formats_they_were_shown():
    rng = random.Random(2)
    value = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    learned = {"hex": secrets.learn([value("0123456789abcdef", 40) for _ in range(300)]),
               "access": secrets.learn(["AKIA" + value("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16) for _ in range(300)]),
               "assign": secrets.learn([value("0123456789abcdef", 18) for _ in range(300)]),
               "word": secrets.learn([value("etaoinshrdlu", rng.randint(8, 20)) for _ in range(300)]),
               "number": secrets.learn([value("0123456789", 16) for _ in range(300)])}
    assert len(learned["hex"].counts) < 60
    assert secrets.format_kind("AKIA" + value("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), learned) == "access"
    assert secrets.format_kind(value("0123456789abcdef", 32), learned) in ("hex", "assign")
    assert secrets.format_kind("4111111111111111", learned) is None
    assert secrets.format_kind("international2024", learned) is None


def test_credentials_without_a_digit_are_scored(spark):
    rng = random.Random(12)
    letters = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"
    value = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    learned = {"hex": secrets.learn([]), "access": secrets.learn([]),
               "assign": secrets.learn([value(letters + "0123456789", 20) for _ in range(300)]),
               "word": secrets.learn([value("etaoinshrdlu", rng.randint(8, 20)) for _ in range(300)]),
               "number": secrets.learn([value("0123456789", 16) for _ in range(300)])}
    texts = [f"key {value(letters, 20)} of uncharacteristically" for _ in range(40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    spans = [[(s["start"], s["end"], s["kind"]) for s in r["secrets"]] for r in collected(secrets.scan(docs, learned))]
    assert sum(s == [(4, 24, "like_assign")] for s in spans) >= 36 and all(s in ([], [(4, 24, "like_assign")]) for s in spans)


def test_secrets_of_odd_rows_are_cut_out(spark):
    automata = secrets.train(odd(spark))
    scanned = secrets.scan(odd(spark), automata)
    assert scanned.count() == len(ODD)
    clean = {r["doc_id"]: r["text"] for r in collected(secrets.redacted(scanned))}
    assert clean[11].startswith("[assign]") and "Z" * 20 not in clean[11] and "0a0a" not in clean[11] and clean[1] is None
    assert clean[4] == "x"
    assert collected(secrets.scan(none(spark), secrets.train(none(spark)))) == []


# extraction

def test_main_text_of_every_generated_page(spark):
    import html

    out = collected(QUERIES["op6_main_text"](spark, SF).join(spark.read.parquet(f"{SF}/pages.parquet"), "page_id"))
    assert len(out) > 20
    for r in out:
        body = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        blocks = [" ".join(html.unescape(re.sub(r"</?b>", "", b.replace("<br>", " "))).split()) for b in re.split(r"</?(?:h1|p)>", body)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_model_reads_its_labelled_pages_and_others():
    pages = [extract.settled(extract.parse(s)) for s in extract.LABELLED]
    model = extract.fit(pages, [])
    for source, page in zip(extract.LABELLED, pages):
        plain = extract.parse(re.sub(r' data-label="[01]"', "", source))
        assert [p > 0.5 for t, p in zip(plain.text, model.marginals(plain)) if t] == [bool(v) for t, v in zip(page.text, page.label) if t]
    other = """<body><div class="site-header">Acme</div><nav><a href=/>Home</a></nav><div class="post"><p>One &amp; two&nbsp;three,
        <i>four</i>.</p><p>Short.</p></div><div class="comments"><p>I disagree with all of that for many reasons.</p></div><div id=footer>c</div>"""
    assert extract.main_text(other, model) == "One & two three, four.\nShort."


def test_messages_give_the_marginals_of_enumeration():
    rng = random.Random(4)
    model = extract.fit([extract.settled(extract.parse(s)) for s in extract.LABELLED], [])
    page = extract.parse("<body><div class=ad><p>a</p></div><article><h1>t</h1><p>long text here</p></article><footer>f</footer>")
    n = len(page.parent)
    sums, total = [0.0] * n, 0.0
    for bits in range(1 << n):
        label = [(bits >> i) & 1 for i in range(n)]
        p = model.prior if label[0] else 1 - model.prior
        for i in range(n):
            for f in page.features[i]:
                p *= model.emit.get(f, (1, 1))[label[i]]
            if i:
                one = model.step.get((page.group[page.parent[i]], page.group[i]), model.usual)[label[page.parent[i]]]
                p *= one if label[i] else 1 - one
        total += p
        for i in range(n):
            sums[i] += p * label[i]
    assert np.allclose([s / total for s in sums], model.marginals(page))
    for _ in range(300):
        text = "".join(rng.choice(["<p>", "</p>", "<div class='x", ">", "<a href=", "&amp", "&#0;", "<!--", "-->", "<script>", "</script>", "<td>", "w", "<", "/", '"', "</"])
                       for _ in range(rng.randint(0, 30)))
        extract.main_text(text, model)


def test_odd_pages(spark):
    rows = [(1, None, None), (2, "u", ""), (None, None, "<p>" * 5000 + "deep"), (4, "u", "<div>" * 3000 + "x"), (5, "u", "<p>text & more")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("main_text", F.lit("clash"))
    out = collected(extract.extract(pages, extract.train(pages)))
    assert len(out) == 5 and out[0]["main_text"] == ""
    assert collected(extract.extract(pages.where("1 = 0"), extract.train(pages.where("1 = 0")))) == []


# top k

def test_top_k_is_exact_on_odd_vectors(spark):
    rng = np.random.default_rng(7)
    rows = [(int(i), [float(x) for x in rng.normal(size=8).astype(np.float32)]) for i in range(1500)]
    rows += [(50, [0.5] * 8)] * 40 + [(None, [0.25] * 8), (100, None), (150, [1.0, None]), (200, [float("nan")] * 8), (250, [float("inf")] + [0.0] * 7), (300, []), (301, [2.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("cell", F.lit("clash"))
    got = Counter(tuple(r) for r in topk.top_k(table, "vec_id % 50 = 0").collect())
    ok = [(i, np.pad(np.floor(256 * np.array(v, dtype=np.float32).astype(float)), (0, 8 - len(v))).astype(int)) for i, v in rows
          if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    want = Counter()
    for k, (i, q) in enumerate(ok):
        if i is not None and i % 50 == 0:
            near = sorted((-int(q @ x), j is None, j or 0) for n, (j, x) in enumerate(ok) if n != k)[:5]
            want.update((i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(near))
    assert got == want
    assert topk.top_k(table.where("1 = 0"), "vec_id % 50 = 0").collect() == []
    assert len(topk.top_k(table.where("vec_id in (0, 1, 2)"), "vec_id % 50 = 0").collect()) == 2


# toxicity

def test_toxicity_of_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    out = QUERIES["op8_nb_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r["toxic"], r["predicted"]): r["count"] for r in out.groupBy("toxic", "predicted").count().collect()}
    assert n[1, 1] >= 0.85 * (n[1, 1] + n[1, 0]) and n[1, 1] >= 0.85 * (n[1, 1] + n.get((0, 1), 0))


def test_tallies_and_features_are_exact(spark):
    texts = [t or "" for _, t, *_ in ODD]
    flat, ends = toxicity.features(texts)
    alone = [set(toxicity.features([t])[0].tolist()) for t in texts]
    assert [set(flat[a:b].tolist()) for a, b in zip(ends[:-1], ends[1:])] == alone
    assert all(b - a == len(s) for a, b, s in zip(ends[:-1], ends[1:], alone))
    labelled = spark.createDataFrame([(k % 2, t) for k, t in enumerate(texts)], "toxic int, text string").repartition(3)
    want = [Counter(), Counter()]
    for k, s in enumerate(alone):
        want[k % 2].update(s)
    got = {r["bucket"]: (r["zeros"], r["ones"]) for r in toxicity.tallies(labelled).collect()}
    assert got == {b: (want[0][b], want[1][b]) for b in want[0] | want[1]}


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 1), (9, 0), (10, 0), (2, None), (None, 1), (5, 3)], "doc_id long, toxic int")
    model = toxicity.train(toxicity.training_rows(odd(spark), labels))
    out = collected(toxicity.scored(odd(spark), model))
    assert len(out) == len(ODD) and all(0 <= r["toxic_score"] <= 1 for r in out)
    empty = toxicity.train(toxicity.training_rows(none(spark), labels))
    assert collected(toxicity.scored(none(spark), empty)) == []


# fingerprints

def test_edited_texts_and_fingerprints(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    out = collected(QUERIES["op9_phrase_fingerprints"](spark, sf).orderBy("doc_id"))
    assert len(out) == len(texts)
    known = {}
    for r, text, after in zip(out, texts, texts[1:] + texts[:1]):
        cut = len(text) // 4
        edited = text[:len(text) - cut] + after[:cut]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == phrases.written(phrases.sketches([text])[0]) == known.setdefault(text, r["fingerprint"])
        assert r["edited_fingerprint"] == phrases.written(phrases.sketches([edited])[0])
    assert np.mean([r["near_edited"] for r in out]) > 0.45 > 0.05 > np.mean([r["near_next"] for r in out])


def test_phrases_depend_on_nearby_text_alone():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh ") for _ in range(4000))
    middle, counts = word(), []
    for _ in range(5):
        symbols, offsets = phrases.code_points([word()[:rng.randint(0, 400)] + middle + word()[:rng.randint(0, 400)]])
        for _ in range(3):
            before = len(symbols)
            symbols, offsets = phrases.next_level(symbols, offsets)
            assert before / 13 <= len(symbols) <= before / 2 + 1
        counts.append(set(symbols.tolist()))
    shared = set.intersection(*counts)
    assert len(shared) >= 0.85 * 4000 / 27 / 1.3
    assert phrases.sketches(["a" * 5000])[0][0].size == 1


def test_fingerprints_of_odd_rows(spark):
    out = collected(phrases.fingerprints(odd(spark)))
    assert len(out) == len(ODD) and Counter(r["doc_id"] for r in out) == Counter(d[0] for d in ODD)
    ordered = sorted(ODD, key=lambda d: (d[0] is None, d[0] or 0, d[1] or ""))
    texts = [d[1] or "" for d in ordered]
    want = Counter()
    for d, text, after in zip(ordered, texts, texts[1:] + texts[:1]):
        cut = len(text) // 4
        want[d[0], hashlib.sha256((text[:len(text) - cut] + after[:cut]).encode()).hexdigest()] += 1
    assert Counter((r["doc_id"], r["edited_sha256"]) for r in out) == want
    assert collected(phrases.fingerprints(none(spark))) == []


# near duplicates

def words_of(text):
    return re.findall(r"[^\x00-/:-@\[-`{-\x7f]+", (text or "").lower())


def brute_classes(rows):
    bags, texts = {}, {}
    for i, t in rows:
        w = words_of(t)
        bags[t or ""] = Counter(zip(*[w[k:] for k in range(5)])) if len(w) >= 5 else Counter([tuple(w)] if w else [])
        texts.setdefault(t or "", []).append(i)
    keys = list(bags)
    root = {k: k for k in keys}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[n + 1:]:
            x, y = sum(bags[a].values()), sum(bags[b].values())
            if x and y and min(x, y) >= 0.8 * max(x, y):
                both = sum((bags[a] & bags[b]).values())
                if both >= 0.8 * (x + y - both) - 1e-9:
                    root[find(a)] = find(b)
    members = {}
    for k in keys:
        members.setdefault(find(k), []).extend(texts[k])
    lead = {c: min((i for i in m if i is not None), default=None) for c, m in members.items()}
    return Counter((i, lead[find(t or "")]) for i, t in rows)


@pytest.mark.parametrize("small", [2, 16, 10_000])
def test_near_duplicate_classes_are_those_of_brute_force(spark, small):
    rng = random.Random(11)
    words = [f"w{k}" for k in range(2000)]
    rows = [(d[0], d[1]) for d in ODD if len(d[1] or "") < 90_000]
    for family in range(2):
        base = [rng.choice(words) for _ in range(90)]
        for k in range(45):
            text = list(base)
            for _ in range(rng.randint(0, 5)):
                text[rng.randrange(len(text))] = rng.choice(words)
            if rng.random() < 0.3:
                at = rng.randrange(len(text))
                del text[at:at + rng.randint(1, 10)]
            rows += [(1000 * (family + 1) + k, " ".join(text))] * rng.choice([1, 1, 2])
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("node", F.lit("clash"))
    out = bagminhash.near_duplicates(docs, small=small)
    assert Counter((r["doc_id"], r["class_id"]) for r in out.collect()) == brute_classes(rows)


def test_signatures_estimate_weighted_jaccard():
    rng = random.Random(6)
    errors = []
    for _ in range(40):
        a = [rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)]
        b = [w if rng.random() > 0.1 else f"z{rng.randint(0, 9)}" for w in a]
        x, y = Counter(a), Counter(b)
        hashes, offsets = bagminhash.bags([" ".join(a), " ".join(b)], 1)
        own = bagminhash.signatures(hashes, offsets, 512)
        errors.append((own[0] == own[1]).mean() - sum((x & y).values()) / sum((x | y).values()))
    assert abs(np.mean(errors)) < 0.01 and np.std(errors) < 0.03
    hashes, offsets = bagminhash.bags(["one two three", "", "one two three", "one " * 3000], 1)
    own = bagminhash.signatures(hashes, offsets, 96)
    assert (own[0] == own[2]).all() and not own[1].any()
    assert (own[3] == bagminhash.signatures(hashes[offsets[3]:], offsets[3:] - offsets[3], 96)[0]).all()


def test_names_of_one_group_or_without_room_are_not_listed(spark):
    names = [[1, 2, 3, 4], [1, 2, 3, 5], [3, 4, 6], [7]]
    rows = [(9, b, n, len(n), need, over, [0] * 8, group) for b, n, need, over, group in zip(range(4), names, (0.5, 0.5, 0.5, 90.0), (0.5, -1.0, 0.5, 0.5), (1, 1, 2, 2))]
    families = spark.createDataFrame(rows, "a long, b long, names array<long>, total long, need double, over double, bits array<long>, group long")
    keys = dict(zip((n for own in names for n in own), (k for own in bagminhash._family_keys(
        pa.record_batch({"a": pa.array([9] * 4), "names": pa.array(names)})) for k in own.view(np.int64).tolist())))
    rare = {r["b"]: {x["key"] for x in r["rare"]} for r in bagminhash._rare_names(families, 0.8).collect()}
    assert rare == {0: {keys[3], keys[4]}, 1: {keys[3]}, 2: {keys[3], keys[4]}, 3: set()}  # 1 and 2 are in one group alone
    far = families.withColumn("need", F.lit(50.0))
    assert all(r["rare"] == [] for r in bagminhash._rare_names(far, 0.8).collect())


def test_only_rows_that_have_room_for_another_meet(spark):
    schema = "b long, group long, total long, need double, over double, key long, place int"
    draw = random.Random(3)
    rows = [(i, draw.randrange(6), t := draw.randint(1, 12), n := draw.uniform(0, t), n - draw.uniform(0, 6), draw.randrange(9), draw.randint(1, t))
            for i in range(200)]
    kept = {r["b"] for r in bagminhash._may_meet(spark.createDataFrame(rows, schema)).collect()}
    meet = set()
    for x in rows:
        for y in rows:
            if x[5] == y[5] and x[1] != y[1] and x[4] > 0:
                must = math.ceil(y[3] + x[4] - 1e-6)
                if x[6] <= x[2] - must + 1 and y[6] <= y[2] - must + 1:
                    meet |= {x[0], y[0]}
    assert meet and meet <= kept and len(kept) < len({r[0] for r in rows if len({s[1] for s in rows if s[5] == r[5]}) > 1})


def test_a_worker_forgets_what_another_operator_remembered():
    state = common.worker_state()
    state["words"] = 1
    assert list(common.released(lambda batches: iter(batches), remembers=True)([1])) == [1] and state == {"words": 1}
    assert list(common.released(lambda batches: iter(batches))([2])) == [2] and state == {}


def test_near_duplicates_of_no_rows(spark):
    assert bagminhash.near_duplicates(none(spark)).collect() == []


def test_repeated_rows_are_compared_once(spark, monkeypatch):
    text = " ".join(f"w{i}" for i in range(200))
    rows = [(1, text)] * 6 + [(2, text + " more")] * 5 + [(None, text + " again")] * 4 + [(None, "nothing like the others at all")]
    docs, seen, whole = spark.createDataFrame(rows, "doc_id long, text string"), [], bagminhash.compared

    def counting(pairs, contents, least):
        out = whole(pairs, contents, least)
        seen.append((pairs.count(), out.count(), contents.count(), contents.select("node").distinct().count()))
        return out

    monkeypatch.setattr(bagminhash, "compared", counting)
    out = collected(bagminhash.near_duplicates(docs))
    assert sorted((str(r["doc_id"]), str(r["class_id"])) for r in out) == sorted(
        (str(i), "None" if t.startswith("nothing") else "1") for i, t in rows)
    assert seen[0] == (2, 2, 3, 3) and all(a == b for a, b, *_ in seen)


# pipeline

def test_pipeline_stages_keep_what_they_should(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd(spark).select(*corpus_pipeline.COLUMNS)).cache()
    columns = corpus_pipeline.COLUMNS
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.stored(stage(spark, docs, sf), f"test-{name}")
        before, after = docs.count(), out.count()
        if name == "toxicity":
            assert out.columns == columns and 0.75 * before <= after <= before
        elif name == "near_duplicates":
            classes = brute_classes([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
            assert out.columns == columns and 0 < after < before
            kept = Counter(r["doc_id"] for r in out.collect())
            assert set(kept) == {c for _, c in classes}
        elif name == "secrets":
            assert out.columns == columns and after == before
            assert not [r for r in out.collect() if re.search(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}", r["text"] or "")]
        elif name == "source_mix":
            assert out.columns == columns and after > 0
            assert max(Counter((r["doc_id"], r["text"]) for r in out.collect()).values()) <= 3
        else:
            assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
        docs = out


def test_mix_leaves_no_source_without_documents(spark):
    row = lambda i, words, source: (i, " ".join(f"w{i}" for _ in range(words)), "en", source, words)
    rows = [row(i, 1000, "ab"[i % 2]) for i in range(80)] + [row(100, 100_000, "c")]
    docs = spark.createDataFrame(rows, SCHEMA)
    targets = {r["source"]: r["target"] for r in collected(mixing.counted(docs, mixing.mix(docs)))}
    assert 0 < targets["c"] < 50_000
    out = collected(corpus_pipeline.mix_sources(spark, docs, SF))
    assert Counter(r["doc_id"] for r in out if r["source"] == "c") == {100: 1}
    assert {r["source"] for r in out} == {"a", "b", "c"}
    same = [(1, "one and the same text " * 3, "en", s, 1) for s in ("a", "b", None)]
    out = collected(corpus_pipeline.mix_sources(spark, spark.createDataFrame(same, SCHEMA), SF))
    assert {r["source"] for r in out} == {"a", "b", None}


def test_pipeline_of_no_rows(spark):
    docs = none(spark)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs.select(*corpus_pipeline.COLUMNS), SF)
        assert docs.count() == 0


def test_blocks_of_vectors_stay_small(spark):
    """Components take the bytes they need, and blocks of long vectors have fewer rows."""
    rows = spark.range(200).selectExpr("id as rid", "id as vec_id", "transform(sequence(1, 8192), x -> x % 100 + id % 7) as v", "0 as cell")
    made = topk.blocks(rows, np.zeros((1, 8192), dtype=np.int64), 1024, np.int16).collect()
    assert sum(r["n"] for r in made) == 200 and all(len(r["vectors"]) == r["n"] * 8192 * 2 for r in made)
    assert max(len(r["vectors"]) for r in made) < 2 * topk.BLOCK_BYTES
    far = [[i % 5, 2 ** (10 if i else 20)] for i in range(120)]  # more than 16 bits
    found = topk.top_k(spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(far)], "vec_id bigint, embedding array<double>"), "vec_id % 50 = 0")
    scores = {q: max(256 * 256 * sum(a * b for a, b in zip(far[q], far[i])) for i in range(120) if i != q) for q in (0, 50, 100)}
    assert {r["query_id"]: r["score"] for r in found.where("rank = 1").collect()} == scores
