"""Toxicity scores by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Tasks turn texts into hashed features; one task learns from a bounded sample of labelled rows with per-coordinate rates and
L1 sparsity (McMahan et al., 2013); the few weights that are not zero are broadcast, and every whole text is scored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stridelake.llm.common import crc_fold, fresh, one_text, with_field

DIMENSIONS = 1 << 22
#: Labelled rows that are learnt from, at most.
TRAIN_ROWS = 24_000
#: Gaps of the skip-grams: pairs of words with so many words between them; 0 is the bigram.
GAPS = (0, 1)
#: Leading letters of a word that stand for its inflected forms.
STEM = 5
WORD = re.compile(r"[^\W\d_]+")
BLOCK = 1 << 16


class Features:
    """Hashed features of texts, each once: words, stems of words, and pairs of words at each gap. Hashes of words come from a bounded cache."""

    def __init__(self, dimensions: int = DIMENSIONS, cached: int = 400_000):
        self.dimensions, self.cached, self.codes = dimensions, cached, {}

    def of(self, text: str | None) -> np.ndarray:
        words = WORD.findall((text or "").lower())
        codes, out = self.codes, []
        if len(codes) > self.cached:
            codes.clear()
        for at in range(0, len(words), BLOCK):
            part = words[max(0, at - 1 - max(GAPS)) : at + BLOCK]  # overlapping: features count once, so repeats do no harm
            for word in set(part):
                if word not in codes:
                    codes[word] = xxhash.xxh32_intdigest(word) << 32 | xxhash.xxh32_intdigest(word[:STEM] + "-")
            both = np.fromiter(map(codes.__getitem__, part), dtype=np.uint64, count=len(part))
            h, stems = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
            grams = [h, stems, *(h[: -1 - g] * np.uint64(0x85EBCA77 + 2 * g) + h[1 + g :] * np.uint64(0xC2B2AE3D) for g in GAPS)]
            mixed = np.concatenate(grams) * np.uint64(0x9E3779B97F4A7C15)
            out.append(np.unique((mixed >> np.uint64(32)) % np.uint64(self.dimensions)))
        if not out:
            return np.zeros(0, dtype=np.int64)
        return (out[0] if len(out) == 1 else np.unique(np.concatenate(out))).astype(np.int64)


def ftrl(examples: list[tuple[np.ndarray, int]], epochs: int = 5, alpha: float = 0.3, beta: float = 1.0, l1: float = 8.0, l2: float = 0.1, dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray, float]:
    """Indices and values of the weights that are not zero, and the intercept. Examples are (features, label) in a fixed order."""
    z, n = np.zeros(dimensions), np.zeros(dimensions)
    z0 = n0 = w0 = 0.0

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + np.sqrt(ni)) / alpha + l2))

    for _ in range(epochs):
        for features, label in examples:
            zi, ni = z[features], n[features]
            w = weights(zi, ni)
            g = 1 / (1 + np.exp(-np.clip(w.sum() + w0, -35, 35))) - label
            n[features] = ni + g * g
            z[features] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha * w
            z0 += g - (np.sqrt(n0 + g * g) - np.sqrt(n0)) / alpha * w0
            n0 += g * g
            w0 = -z0 / ((beta + np.sqrt(n0)) / alpha + l2)
    seen = np.flatnonzero(np.abs(z) > l1)
    return seen, weights(z[seen], n[seen]), float(w0)


def learn(labelled: DataFrame) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights from labelled (doc_id, text, toxic), which must be bounded: all rows go through one task, as training_rows() gives them.

    No labelled row: no weights and an intercept of 0, so that every score is 0.5."""

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features = Features()
        for batch in batches:
            found = [features.of(t.as_py()).astype(np.int32) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["place", "toxic", "features"])

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = []
        for batch in batches:
            flat, ends = batch.column(2).flatten().to_numpy(), np.cumsum([len(x) for x in batch.column(2)])
            examples += zip(np.split(flat, ends[:-1]), batch.column(1).to_pylist(), strict=True) if batch.num_rows else []
        if examples:
            seen, values, intercept = ftrl(examples)
            yield pa.RecordBatch.from_arrays([pa.array([-1, *seen.tolist()], pa.int64()), pa.array([intercept, *values.tolist()], pa.float64())], names=["feature", "weight"])

    place = F.xxhash64("doc_id", F.lit(7))
    sample = labelled.select(place.alias("place"), F.col("toxic").cast("int").alias("toxic"), "text")
    held = sample.mapInArrow(extract, "place long, toxic int, features array<int>")
    # A bounded sample goes through one task: its rows and weights do not grow with the corpus.
    found = held.repartition(1).sortWithinPartitions("place", "toxic").mapInArrow(train, "feature long, weight double").collect()
    feature, weight = np.array([r[0] for r in found], dtype=np.int64), np.array([r[1] for r in found])
    own = feature >= 0
    return feature[own], weight[own], float(weight[~own].sum())


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], text: str = "text") -> DataFrame:
    """docs with a last column score (underscores added if docs has it), from 0 to 1. Null and empty texts have no features and get
    the intercept's score. Whole texts are read, in blocks."""
    (name,) = fresh(docs, "score")
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index(text)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, values, intercept = held.value
        table, features = np.zeros(DIMENSIONS, dtype=np.float32), Features()
        table[seen] = values
        for batch in batches:
            sums = np.array([table[features.of(t.as_py())].sum(dtype=np.float64) for t in batch.column(at)]) + intercept
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(1 / (1 + np.exp(-np.clip(sums, -35, 35))), pa.float64())], names=[*batch.schema.names, name])

    return docs.mapInArrow(score, with_field(docs.schema, (name, "double")))


def training_rows(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, text, toxic of at most `rows` labelled documents outside the held-out fold, by the least hashes of their ids.

    An id has one row: of several labels of it the greatest counts, of several texts the least. Rows without id or label are
    not used."""
    usable = labels.filter("doc_id IS NOT NULL AND toxic IS NOT NULL").filter(crc_fold(F.col("doc_id")) != 0)
    chosen = usable.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id", F.lit(7)), "doc_id").limit(rows)
    return one_text(docs, chosen)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document. A null id is not held out. Repeated rows get equal scores."""
    model = learn(training_rows(docs, labels))
    held_out = F.coalesce(crc_fold(F.col("doc_id")) == 0, F.lit(False))
    return scored(docs.select("doc_id", "text"), model).select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
