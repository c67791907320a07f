"""Language of a text: the nearest of several centroids per language, among normalised TF-IDF vectors of character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from casegrain.llm.common import folded, held_out, query, table, text_batches, with_columns

BUCKETS = 1 << 13
N_GRAMS = (1, 2, 3)
CENTROIDS = 4
#: Different texts per language that centroids are made of, at most, chosen by a hash of the text.
FIT_ROWS = 300
UNDETERMINED = "und"
_ROWS = 64
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def term_counts(texts: list[str]) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts by row and bucket) of at most `_ROWS` texts at a time; n-grams of letters, words apart."""
    for at in range(0, len(texts), _ROWS):
        own = texts[at:at + _ROWS]
        points, offsets = folded(own, digits=False)
        row = np.repeat(np.arange(len(own)), np.diff(offsets))
        cells = []
        for n in N_GRAMS:
            if len(points) < n:
                continue
            h = np.full(len(points) - n + 1, n, dtype=np.uint32)
            for k in range(n):
                h = (h ^ points[k:len(points) - n + 1 + k]) * _FACTORS[k]
                h ^= h >> np.uint32(15)
            whole = row[:len(h)] == row[n - 1:]
            cells.append(row[:len(h)][whole] * BUCKETS + (h[whole] % np.uint32(BUCKETS)))
        counts = np.bincount(np.concatenate(cells), minlength=len(own) * BUCKETS).reshape(len(own), BUCKETS)
        yield at, counts


def vectors(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Rows of length 1 (or 0) from counts: (1 + log count) * idf."""
    weight = np.zeros(counts.shape, dtype=np.float32)
    some = counts > 0
    weight[some] = 1 + np.log(counts[some])
    weight *= idf
    return weight / np.maximum(np.linalg.norm(weight, axis=1, keepdims=True), 1e-12)


def clustered(rows: np.ndarray, k: int, rounds: int = 12) -> np.ndarray:
    """Spherical k-means from far-apart first centroids: the first row, then always the row least like those chosen."""
    chosen = [0]
    like = rows @ rows[0]
    while len(chosen) < min(k, len(rows)):
        chosen.append(int(np.argmin(like)))
        like = np.maximum(like, rows @ rows[chosen[-1]])
    centroids = rows[chosen]
    for _ in range(rounds):
        near = np.argmax(rows @ centroids.T, axis=1)
        sums = np.stack([rows[near == j].sum(axis=0) if (near == j).any() else centroids[j] for j in range(len(centroids))])
        centroids = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centroids


@dataclass
class Model:
    """``centroids`` of ``languages`` (one per row) and the cosine distance that each reaches; ``idf`` per bucket."""

    idf: np.ndarray
    languages: list[str]
    centroids: np.ndarray
    reach: np.ndarray


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS, k: int = CENTROIDS) -> Model:
    """A model of ``labelled`` (text, lang); rows without text or lang are left out.

    Document frequencies count all rows. Centroids are clustered from at most ``fit_rows`` different texts per language, in one
    task per language; copies of a text count once. The driver gets one count per bucket and ``k`` centroids per language.
    """
    rows = labelled.where("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang"))
    hashed = rows.withColumn("_hash", F.xxhash64("text"))
    sizes = hashed.select("lang", "_hash").distinct().groupBy("lang").agg(F.count(F.lit(1)).alias("_n"))

    def frequencies(batches) -> Iterator[pa.RecordBatch]:
        found, seen = np.zeros(BUCKETS, dtype=np.int64), 0
        for _, texts in text_batches(batches):
            for _, counts in term_counts(texts):
                found += (counts > 0).sum(axis=0)
            seen += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(-1, BUCKETS)), pa.array(np.append(seen, found))], names=["bucket", "n"])

    total = dict(rows.select("text").mapInArrow(frequencies, "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect())
    if not total.get(-1):
        return Model(np.ones(BUCKETS, dtype=np.float32), [], np.zeros((0, BUCKETS), dtype=np.float32), np.zeros(0))
    found = np.array([total.get(i, 0) for i in range(BUCKETS)], dtype=np.float64)
    idf = (np.log((1 + total[-1]) / (1 + found)) + 1).astype(np.float32)

    def centres(key, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["pick", "_hash"]).head(fit_rows)
        own = np.concatenate([vectors(counts, idf) for _, counts in term_counts(frame["text"].tolist())])
        made = clustered(own, k)
        near = own @ made.T
        best = np.argmax(near, axis=1)
        away = 1 - near[np.arange(len(own)), best]
        reach = [float(np.quantile(away[best == j], 0.995)) + 0.1 if (best == j).any() else 1.0 for j in range(len(made))]
        return pd.DataFrame({"lang": key[0], "centroid": [m.astype(np.float32).tobytes() for m in made], "reach": reach})

    # Hashes are spread evenly, so this share holds more than fit_rows different texts of a language, or all it has; the
    # fit_rows smallest stay. Copies are merged in the map tasks, before the shuffle.
    share = (fit_rows + 6 * fit_rows ** 0.5 + 40) / F.col("_n")
    sample = (hashed.withColumn("pick", F.pmod("_hash", F.lit(1 << 30))).join(F.broadcast(sizes), "lang")
              .where(F.col("pick") / float(1 << 30) <= share).groupBy("lang", "pick", "_hash").agg(F.min("text").alias("text")))
    made = sample.groupBy("lang").applyInPandas(centres, "lang string, centroid binary, reach double").collect()
    if not made:
        return Model(idf, [], np.zeros((0, BUCKETS), dtype=np.float32), np.zeros(0))
    made.sort(key=lambda r: (r["lang"], bytes(r["centroid"])))
    return Model(idf, [r["lang"] for r in made], np.stack([np.frombuffer(bytes(r["centroid"]), dtype=np.float32) for r in made]),
                 np.array([r["reach"] for r in made]))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of ``docs`` with ``lang_nearest``, ``lang_score`` (cosine, 0 to 1) and ``lang_rejected``.

    A text that is farther from its nearest centroid than the centroid reaches is rejected; callers decide whether to believe
    the nearest language then. A text that is null or has no letter is "und" with score 0, and so is every text where nothing
    was learned. Equally near centroids: the first language by name. Columns of ``docs`` with these names are replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of centroids per language
    docs = docs.drop("lang_nearest", "lang_score", "lang_rejected")

    def nearest(batches) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch, texts in text_batches(batches):
            langs, scores, far = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.ones(len(texts), dtype=bool)
            for at, counts in term_counts(texts) if known.languages else ():
                like = vectors(counts, known.idf) @ known.centroids.T
                best = np.argmax(like, axis=1)
                for i, b in enumerate(best):
                    if any(map(str.isalpha, texts[at + i])):
                        langs[at + i] = known.languages[b]
                        scores[at + i] = min(1.0, max(0.0, float(like[i, b])))
                        far[at + i] = 1 - like[i, b] > known.reach[b]
            yield with_columns(batch, batch.schema.names, {"lang_nearest": pa.array(langs, type=pa.string()),
                                                           "lang_score": pa.array(scores), "lang_rejected": pa.array(far)})

    schema = T.StructType([*docs.schema.fields, T.StructField("lang_nearest", T.StringType()),
                           T.StructField("lang_score", T.DoubleType()), T.StructField("lang_rejected", T.BooleanType())])
    return docs.mapInArrow(nearest, schema)


@query("op1_language_id")
def op1_language_id(spark, sf_dir):
    """Every document's language, learned from the documents that are not held out (crc32 of the id mod 5 is 0)."""
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(~held_out(5, 0)).select("text", "lang"))
    return identify(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out(5, 0).alias("held_out"), F.col("lang_nearest").alias("lang_pred"), F.col("lang_score").alias("score"),
        F.col("lang_rejected").alias("rejected"))
