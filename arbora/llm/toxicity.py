"""Toxicity by multiple-instance learning: a text is toxic if one of its sentences is."""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import by_few, free_name, table, tidy

#: Labelled rows that the model is fitted on at most: those whose doc_ids have the smallest hashes. Everything else sees all rows.
SAMPLE = 12_000
#: Bytes of their features at most, so that long texts don't crowd the task that learns; then the rows with the smallest hashes again.
SAMPLE_BYTES = 1 << 28
BITS, PREFIXES = 18, (4, 5)
STEPS, BATCH, RATE, DECAY = 470, 256, 0.08, 5e-5
#: Sample documents that a feature must be in to have a weight.
LEAST_DOCS = 3
#: Words whose weights a task remembers.
REMEMBERED = 100_000
SENTENCE, WORD = re.compile(r"[^.!?\n]+"), re.compile(r"\w+")


@lru_cache(maxsize=REMEMBERED)
def features(word: str) -> tuple[int, ...]:
    """The word's place among the weights, and those of its beginnings, of as many letters each as PREFIXES says."""
    mask = (1 << BITS) - 1
    return xxhash.xxh32_intdigest(word.encode(), 0) & mask, *(xxhash.xxh32_intdigest(word[:n].encode(), n) & mask for n in PREFIXES if len(word) > n)


@dataclass
class Model:
    """A sentence's score is bias plus its words' weights, squashed; a text's is the noisy-or of its sentences'."""

    weights: np.ndarray
    bias: float

    def fit(self, flat: np.ndarray, lengths: np.ndarray, sentences: np.ndarray, labels: np.ndarray) -> Model:
        """flat: the features of all sentences; lengths: their number in each sentence; sentences: how many each document has; labels:
        of the documents, 0 or 1. No sentence has a label."""
        if not len(labels) or labels.min() == labels.max():
            return self
        first_sentence = np.concatenate([[0], np.cumsum(sentences)])
        place = np.concatenate([[0], np.cumsum(lengths)])[first_sentence]
        seen = np.zeros(len(self.weights), np.int64)
        for a, b in itertools.pairwise(place.tolist()):
            seen[np.unique(flat[a:b])] += 1
        usable = seen >= LEAST_DOCS
        chance = np.random.default_rng(5)
        w = np.append(self.weights, self.bias)
        first, second, step = np.zeros_like(w), np.zeros_like(w), 0
        epochs = max(1, STEPS // -(-len(labels) // BATCH))
        for epoch in range(epochs):
            order = chance.permutation(len(labels))
            rate = RATE * (1 - epoch / epochs) + RATE / 10
            for at in range(0, len(order), BATCH):
                picked = order[at : at + BATCH]
                own = np.concatenate([lengths[first_sentence[i] : first_sentence[i + 1]] for i in picked])
                if not len(own):
                    continue
                doc = np.repeat(np.arange(len(picked)), sentences[picked])
                values = np.concatenate([flat[place[i] : place[i + 1]] for i in picked])
                of, known = np.repeat(np.arange(len(own)), own), usable[values]
                of, values = of[known], values[known]
                z = w[-1] + np.bincount(of, w[values], len(own))
                total = np.bincount(doc, np.logaddexp(0, z), len(picked))
                pull = np.where(labels[picked] == 1, -1 / np.expm1(np.clip(total, 1e-6, 500)), 1.0)
                by_sentence = pull[doc] / (1 + np.exp(-z))
                slope = np.bincount(values, by_sentence[of], len(w)).astype(np.float64)
                slope[-1] = by_sentence.sum()
                slope /= len(picked)
                slope[:-1] += DECAY * w[:-1]
                step += 1
                first = 0.9 * first + 0.1 * slope
                second = 0.99 * second + 0.01 * slope * slope
                w = w - rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
        return Model(w[:-1], float(w[-1]))


def untaught() -> Model:
    return Model(np.zeros(1 << BITS), -6.0)


def sentence_features(text: str | None) -> list[np.ndarray]:
    found = []
    for sentence in SENTENCE.findall(text or ""):
        words = set(WORD.findall(sentence.lower()))
        found.append(np.array(sorted({f for x in words for f in features(x)}), np.int32))
    return found


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Learns from labels.toxic of documents that aren't held out: sample of them and sample_bytes of features at most, the same for the same rows.

    A document with several labels is toxic if one says so; a null label is none. Of rows that share a doc_id one text is read.
    """
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    chosen = known.groupBy(F.col("doc_id").alias("id")).agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(sample)
    rows = by_few(docs).select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("id"))
    rows = rows.groupBy("id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text"))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            each = [sentence_features(t.as_py()) for t in batch.column("text")]
            flat = [np.concatenate(d).tobytes() if d else b"" for d in each]
            lengths = [np.array([len(s) for s in d], np.int32).tobytes() for d in each]
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("toxic").cast(pa.int32()), pa.array(lengths, pa.binary()), pa.array(flat, pa.binary())], ["id", "toxic", "lengths", "flat"])
        features.cache_clear()
        tidy()

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read, held = [], 0
        for row in (row for batch in batches for row in zip(*(batch.column(c).to_pylist() for c in ("id", "toxic", "lengths", "flat")))):
            held += len(row[2]) + len(row[3])
            if held > sample_bytes and read:
                break
            read.append(row)
        read.sort(key=lambda r: r[0])
        lengths, flat = (np.frombuffer(b"".join(r[k] for r in read), np.int32) for k in (2, 3))
        sentences, toxic = np.array([len(r[2]) // 4 for r in read], np.int64), np.array([r[1] for r in read], np.int64)
        del read
        model = untaught().fit(flat, lengths, sentences, toxic)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.astype(np.float32).tobytes()], pa.binary()), pa.array([model.bias], pa.float64())], ["weights", "bias"])
        tidy()

    # The sample is bounded, so one task can learn from it; the driver gets the weights only.
    made = rows.mapInArrow(extract, "id long, toxic int, lengths binary, flat binary")
    one = made.repartition(1).sortWithinPartitions(F.xxhash64("id"), "id").mapInArrow(learn, "weights binary, bias double").first()
    return Model(np.frombuffer(one["weights"], np.float32).astype(np.float64), one["bias"]) if one else untaught()


def scored(docs: DataFrame, model: Model, threshold: float = 0.5) -> DataFrame:
    """docs with score, predicted, n_sentences and offending: start-end, in characters, of each sentence that alone reaches threshold,
    or of the worst one where only all together do.

    Sentences end at . ! ? and line feeds. A null or empty text, or one without sentences, scores 0. The score depends on
    nothing but the text, and on all of it. Columns of docs stay; those named like a result's give way; an empty table gives an empty one.
    """
    weights, bias = model.weights.astype(np.float32), model.bias
    names = ["score", "predicted", "n_sentences", "offending"]
    own = free_name(docs, "toxicity")

    @F.pandas_udf("score double, predicted int, n_sentences long, offending string")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        memory: dict[str, float] = {}
        for texts in batches:
            yield scores(texts, memory)
        memory.clear()
        tidy()

    def scores(texts: pd.Series, memory: dict[str, float]) -> pd.DataFrame:

        def weight(word: str) -> float:
            value = float(sum(weights[f] for f in features.__wrapped__(word)))
            if len(memory) < REMEMBERED:  # the first ones stay: frequent words come early
                memory[word] = value
            return value

        rows = []
        for text in texts:
            spans, values = [], []
            for m in SENTENCE.finditer(text or ""):
                z = bias
                for word in set(WORD.findall(m[0].lower())):
                    v = memory.get(word)
                    z += weight(word) if v is None else v
                spans.append(m.span())
                values.append(z)
            z = np.array(values)
            score = float(-np.expm1(-np.logaddexp(0, z).sum())) if values else 0.0
            bad = np.flatnonzero(1 / (1 + np.exp(-z)) >= threshold).tolist() if values else []
            if not bad and values and score >= threshold:
                bad = [int(z.argmax())]
            rows.append((score, int(score >= threshold), len(values), ",".join(f"{spans[i][0]}-{spans[i][1]}" for i in bad)))
        return pd.DataFrame(rows, columns=names)

    kept = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in names]
    return by_few(docs).select(*kept, judge(F.col("text")).alias(own)).select(*kept, *(F.col(f"{own}.{c}").alias(c) for c in names))


def op5_toxicity_noisy_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents, by a model that learned from rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return scored(docs, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "n_sentences", "offending")
