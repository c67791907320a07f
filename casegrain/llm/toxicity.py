"""Toxicity by a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql import types as T

from casegrain.llm.common import folded, held_out, query, released, table, text_batches
from casegrain.session import stored

N_GRAMS = (3, 4, 5)
BUCKETS = 1 << 19
#: Labelled rows that a model is fitted on, at most this many of each label, chosen by a hash of id and text.
FIT_ROWS = 3000
#: Buckets that a model keeps, at most, and the least significance of one.
FEATURES, LEAST_Z = 20_000, 5.0
#: Labels of up to this many rows (about 100 MB as a hash table) are sent to the documents; more are joined by a shuffle.
BROADCAST_LABELS = 250_000
_PART = 500_000
_BLOCK = 1024
THRESHOLD = 0.3

_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F, 0x165667B1], dtype=np.uint32)


def features(texts: list[str], buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray]:
    """The distinct n-gram buckets of every text and the offsets of the texts, the end last.

    n-grams are taken over lower-case words of letters and digits; anything else is one space, before and after a text too.
    """
    points, offsets = folded(texts, digits=True)
    found = []
    for n in N_GRAMS:
        if len(points) < n:
            continue
        h = np.full(len(points) - n + 1, n, dtype=np.uint32)
        for k in range(n):
            h = (h ^ points[k:len(points) - n + 1 + k]) * _FACTORS[k]
            h ^= h >> np.uint32(15)
        found.append((h % np.uint32(buckets)).astype(np.int32))
    seen = np.zeros(buckets, dtype=np.int32)
    out, ends = [], np.zeros(len(texts) + 1, dtype=np.int64)
    for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:])):
        own = np.concatenate([f[a:max(a, b - n + 1)] for n, f in zip(N_GRAMS, found)] or [np.zeros(0, np.int32)])
        marks = np.arange(len(own), dtype=np.int32)
        seen[own] = marks
        own = own[seen[own] == marks]
        out.append(own)
        ends[i + 1] = ends[i] + len(own)
    return np.concatenate(out) if out else np.zeros(0, np.int32), ends


@dataclass
class Model:
    """``weight`` per bucket (log-count ratio times fitted weight) and ``bias``; a text's log odds are their sum over its
    distinct buckets."""

    weight: np.ndarray
    bias: float

    def log_odds(self, texts: list[str]) -> np.ndarray:
        found, ends = features(texts, len(self.weight))
        sums = np.append(0.0, np.cumsum(self.weight[found], dtype=np.float64))
        return sums[ends[1:]] - sums[ends[:-1]] + self.bias


def fit(rows: list[np.ndarray], labels: np.ndarray, ratio: np.ndarray, prior: float, penalty: float = 1e-3,
        rounds: int = 200) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on rows of feature numbers, each feature scaled by its ratio.

    Each label has half of the weight; the bias is then moved to the share ``prior`` of label 1.
    """
    share = float(np.log(prior / (1 - prior)))
    labels = np.asarray(labels, dtype=np.float64)
    if not len(rows) or labels.min() == labels.max() or not len(ratio):
        return np.zeros(len(ratio)), share
    # Sums go over a part of the rows at a time: what is held is their feature numbers and little else.
    sizes = np.array([len(r) for r in rows])
    column, ends = np.concatenate(rows), np.append(0, np.cumsum(sizes))
    cuts = np.unique(np.append(np.searchsorted(ends, np.arange(0, ends[-1], _PART)), len(rows)))
    parts = [(lo, hi, column[ends[lo]:ends[hi]]) for lo, hi in zip(cuts[:-1], cuts[1:])]
    worth = np.where(labels == 1, 0.5 / labels.sum(), 0.5 / (1 - labels).sum())
    w, b = np.zeros(len(ratio)), 0.0
    g2, gb2 = np.full(len(ratio), 1e-12), 1e-12
    for _ in range(rounds):
        z, scaled, grad = np.full(len(rows), b), ratio * w, np.zeros(len(ratio))
        for lo, hi, own in parts:
            z[lo:hi] += np.bincount(np.repeat(np.arange(hi - lo), sizes[lo:hi]), weights=scaled[own], minlength=hi - lo)
        error = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) * worth
        for lo, hi, own in parts:
            grad += np.bincount(own, weights=np.repeat(error[lo:hi], sizes[lo:hi]), minlength=len(ratio))
        grad = grad * ratio + penalty * w / len(ratio) ** 0.5
        g2 += grad ** 2
        gb2 += error.sum() ** 2
        w -= 0.1 * grad / np.sqrt(g2)
        b -= 0.1 * error.sum() / np.sqrt(gb2)
    return w * ratio, b + share


def tallies(labelled: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, ones, zeros): in how many rows of ``labelled`` (toxic, text) of each label a bucket occurs.

    Every task sums its rows first and sends blocks of counts, so what is shuffled grows with the tasks and not the n-grams.
    """
    def tally(batches) -> Iterator[pa.RecordBatch]:
        found = np.zeros((2, buckets), dtype=np.int64)
        for batch, texts in text_batches(batches):
            flat, ends = features(texts, buckets)
            label = np.repeat(np.asarray(batch.column(0)), np.diff(ends))
            for k in (0, 1):
                found[k] += np.bincount(flat[label == k], minlength=buckets)
        cut = found.reshape(2, -1, _BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(cut.shape[1], dtype=np.int32)), *(
            pa.array([c.tobytes() for c in cut[k]], type=pa.binary()) for k in (1, 0))], names=["block", "ones", "zeros"])

    def added(key, frame: pd.DataFrame) -> pd.DataFrame:
        ones, zeros = (sum(np.frombuffer(b, dtype=np.int64) for b in frame[c]) for c in ("ones", "zeros"))
        at = np.flatnonzero(ones + zeros)
        return pd.DataFrame({"bucket": (key[0] * _BLOCK + at).astype("int32"), "ones": ones[at], "zeros": zeros[at]})

    return (labelled.select(F.col("toxic").cast("int").alias("toxic"), "text").mapInArrow(released(tally), "block int, ones binary, zeros binary")
            .groupBy("block").applyInPandas(added, "bucket int, ones bigint, zeros bigint"))


def train(labelled: DataFrame, fit_rows: int = FIT_ROWS, buckets: int = BUCKETS, kept: int = FEATURES,
          least_z: float = LEAST_Z, smoothing: float = 1.0) -> Model:
    """A model of ``labelled`` (doc_id, text, toxic 0 or 1; other labels are left out).

    Log-count ratios come from all rows. A bucket counts only where its shares of the two labels' rows differ by ``least_z``
    standard errors (long texts have thousands of n-grams, whose chance differences would else add up), and of those the
    ``kept`` most significant. Their weights are fitted on at most ``fit_rows`` rows of each label, those with the smallest
    hash of id and text, so reruns agree. The driver gets the kept buckets and their numbers in those rows.
    """
    rows = labelled.where(F.col("toxic").isin(0, 1))
    counts = {r["toxic"]: r["count"] for r in rows.groupBy("toxic").count().collect()}
    n1, n0 = counts.get(1, 0), counts.get(0, 0)
    prior = min(max(n1 / max(1, n1 + n0), 1e-3), 1 - 1e-3)
    weight = np.zeros(buckets, dtype=np.float32)
    if not n1 or not n0:
        return Model(weight, float(np.log(prior / (1 - prior))))
    both = (F.col("ones") + F.col("zeros")) / float(n1 + n0)
    error = F.sqrt(F.greatest(both * (1 - both), F.lit(1e-12)) * (1 / n1 + 1 / n0))
    z = F.abs(F.col("ones") / n1 - F.col("zeros") / n0) / error
    best = (tallies(rows, buckets).withColumn("z", z).where(F.col("z") >= least_z)
            .orderBy(F.desc("z"), "bucket").limit(kept).collect())
    best.sort(key=lambda r: r["bucket"])
    names = np.array([r["bucket"] for r in best], dtype=np.int64)
    ones, zeros = (np.array([r[c] for r in best], dtype=np.float64) for c in ("ones", "zeros"))
    ratio = np.log((ones + smoothing) / (n1 + 2 * smoothing)) - np.log((zeros + smoothing) / (n0 + 2 * smoothing))
    number = np.full(buckets, -1, dtype=np.int32)
    number[names] = np.arange(len(names))

    pick = F.xxhash64("doc_id", F.coalesce("text", F.lit("")))
    share = F.pmod(pick, F.lit(1 << 30)) / float(1 << 30)

    def found(batches) -> Iterator[pa.RecordBatch]:
        for batch, texts in text_batches(batches):
            flat, ends = features(texts, buckets)
            own = [number[flat[a:b]] for a, b in zip(ends[:-1], ends[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(
                [o[o >= 0].tobytes() for o in own], type=pa.binary())], names=["toxic", "pick", "found"])

    # Hashes are spread evenly: the share of a label holds more than fit_rows rows, of which the smallest stay.
    near = (fit_rows + 6 * fit_rows ** 0.5 + 40)
    sample = rows.where(share <= F.when(F.col("toxic") == 1, near / n1).otherwise(near / n0))
    seen = sample.select(F.col("toxic").cast("int").alias("toxic"), pick.alias("pick"), "text").mapInArrow(
        found, "toxic int, pick bigint, found binary").collect()
    seen.sort(key=lambda r: (r["toxic"], r["pick"], bytes(r["found"])))
    chosen = [r for k in (0, 1) for r in [r for r in seen if r["toxic"] == k][:fit_rows]]
    found_in, labels = [np.frombuffer(r["found"], dtype=np.int32) for r in chosen], np.array([r["toxic"] for r in chosen])
    del seen, chosen
    weights, bias = fit(found_in, labels, ratio, prior)
    weight[names] = weights
    return Model(weight, float(bias))


def scored(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` and ``toxic_score`` (0 to 1) of the whole text and ``toxic_predicted``.

    A null or empty text has the score of a text without any n-gram. Clashing columns of ``docs`` with these two names are
    replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weight, model.bias))  # fixed size: one number per bucket
    docs = docs.drop("toxic_score", "toxic_predicted")

    def score(batches) -> Iterator[pa.RecordBatch]:
        known = Model(*shared.value)
        for batch, texts in text_batches(batches):
            p = 1 / (1 + np.exp(-np.clip(known.log_odds(texts), -40, 40)))
            columns = list(batch.columns) + [pa.array(p), pa.array((p >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=[*batch.schema.names, "toxic_score", "toxic_predicted"])

    schema = T.StructType([*docs.schema.fields, T.StructField("toxic_score", T.DoubleType()),
                           T.StructField("toxic_predicted", T.IntegerType())])
    return docs.mapInArrow(released(score), schema)


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Labelled documents that are not held out: crc32 of the id mod 4 is not 2. A null id has no label."""
    kept = docs.where(~held_out(4, 2)).select("doc_id", "text")
    given = stored(labels.where("toxic is not null").select("doc_id", "toxic").distinct(), "labels")
    return kept.join(F.broadcast(given) if given.count() <= BROADCAST_LABELS else given, "doc_id")


@query("op8_nb_toxicity")
def op8_nb_toxicity(spark, sf_dir):
    """Every document's toxicity, by a model of the labelled documents that are not held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    out = scored(docs.select("doc_id", "text"), train(training_rows(docs, labels)))
    return out.select("doc_id", held_out(4, 2).alias("held_out"), F.col("toxic_score").alias("score"),
                      F.col("toxic_predicted").alias("predicted"))
