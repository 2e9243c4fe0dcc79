"""Toxicity: multiple-instance learning from document labels, with noisy-or over sentences.

A document is a bag of sentences. Each sentence has a probability from a
logistic model over its hashed words
and their beginnings; a document is toxic unless all its
sentences are not: 1 - prod(1 - p). The gradient of the document likelihood
flows to the sentences, so the model learns which sentences offend though only
documents are labelled, and it can point at them.

The model is fitted on the driver on a bounded sample of labelled rows
(MOST_TRAINING); scoring is a pass over the scan partitions without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, released, whole_text

#: Labelled rows the model is fitted on, at most, of each label; chosen by the md5 of the id.
MOST_TRAINING = 2700
BITS = 20
PREFIXES = (4, 5)
STEPS = 300
RATE = 0.15
PENALTY = 2e-5
#: Training documents that must have a feature for it to count.
LEAST_DOCS = 4
THRESHOLD = 0.7
#: Words of a sentence, at most: longer ones are cut, so that one score never stands for a whole text.
SENTENCE_WORDS = 40
CACHE_WORDS = 300_000
#: Texts that a worker turns into strings together.
SLICE_TEXTS = 500

_SENTENCE = re.compile(r"[^.!?\n]+")
_STOP = re.compile(r"[.!?\n]+")
_WORD = re.compile(r"\w+")


def bags(text: str) -> list[set[str]]:
    """The distinct words of each sentence, or of each run of SENTENCE_WORDS words of a long one."""
    out = []
    for sentence in _STOP.split(text.lower()):
        found = _WORD.findall(sentence)
        for first in range(0, len(found), SENTENCE_WORDS):
            out.append(set(found[first : first + SENTENCE_WORDS]))
    return out


def word_features(word: str, mask: int) -> tuple[int, ...]:
    """Feature numbers of a word: itself and its beginnings, so inflected forms share what they have in common."""
    parts = [word, *("^" + word[:k] for k in PREFIXES if len(word) > k)]
    return tuple(zlib.crc32(p.encode("utf-8", "surrogatepass")) & mask for p in parts)


class Model:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights, bias
        self.known: dict[str, float] = {}

    def word(self, word: str) -> float:
        """The word's part of a sentence's sum; those of frequent words are kept."""
        got = self.known.get(word)
        if got is None:
            got = float(self.weights[list(word_features(word, len(self.weights) - 1))].sum())
            if len(self.known) < CACHE_WORDS:
                self.known[word] = got
        return got

    def sums(self, bags_: list[set[str]]) -> np.ndarray:
        word = self.word
        # In the order of words, so that equal sentences have equal sums to the last digit.
        return np.array([math.fsum(map(word, bag)) for bag in bags_]) + self.bias

    def document_score(self, bags_: list[set[str]]) -> float:
        """Noisy-or of the sentences; without any the score is 0."""
        if not bags_:
            return 0.0
        return float(1 - np.exp(-np.log1p(np.exp(np.clip(self.sums(bags_), -30, 30))).sum()))


def fit(texts: list[str], labels: list[int], bits: int = BITS, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY) -> Model:
    """Maximum likelihood of the document labels by Adam; rows of few examples train as well."""
    size = 1 << bits
    known: dict[str, tuple[int, ...]] = {}
    docs_, sentences_, features_ = array("i"), array("i"), array("i")  # some bytes a number, not some dozens
    n, spread = 0, np.zeros(size, np.int32)  # texts that have each feature
    for i, text in enumerate(texts):
        mine = len(features_)
        for bag in bags(text):
            docs_.append(i)
            for w in sorted(bag):
                if w not in known:
                    known[w] = word_features(w, size - 1)
                features_.extend(known[w])
                sentences_.extend([n] * len(known[w]))
            n += 1
        spread[np.unique(np.array(features_[mine:], np.int32))] += 1
    y = np.array(labels, float)
    doc, sentence, feature = (np.array(x, np.int32) for x in (docs_, sentences_, features_))
    del docs_, sentences_, features_, known
    # A feature that few documents have would learn those documents by heart.
    often = spread >= LEAST_DOCS
    sentence, feature = sentence[often[feature]], feature[often[feature]]
    used, feature = np.unique(feature, return_inverse=True)
    w, b = np.zeros(len(used)), -4.0
    if not n or y.min(initial=1) == y.max(initial=0):
        return Model(np.zeros(size), b)
    balance = np.where(y > 0, 0.5 / max(y.mean(), 1e-9), 0.5 / max(1 - y.mean(), 1e-9))
    # The two classes weigh the same while fitting.
    mean, square = np.zeros(len(used) + 1), np.zeros(len(used) + 1)
    for step in range(1, steps + 1):
        z = np.clip(np.bincount(sentence, w[feature], n) + b, -30, 30)
        p = 1 / (1 + np.exp(-z))
        none = np.exp(-np.bincount(doc, np.log1p(np.exp(z)), len(texts)))
        any_ = np.clip(1 - none, 1e-9, 1)
        # d loglik / dz of a sentence: p * (y * none / any - (1 - y)).
        slope = balance * (y * none / any_ - (1 - y))
        ds = slope[doc] * p
        grad = np.append(np.bincount(feature, ds[sentence], len(used)) / len(texts) - penalty * w, ds.sum() / len(texts))
        mean = 0.9 * mean + 0.1 * grad
        square = 0.999 * square + 0.001 * grad**2
        move = rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        # Words can only speak for an offence: else harmless words around one would hide it.
        w, b = np.maximum(w + move[:-1], 0), b + move[-1]
    weights = np.zeros(size)
    weights[used] = w
    return Model(weights, float(b))


def training_rows(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MOST_TRAINING) -> tuple[list[str], list[int]]:
    """Texts and labels of rows that are not held out: `most` of each label at most, by the md5 of the id."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out("doc_id"))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(label).alias("_y"))
    order = [F.md5(F.col("_id").cast("string").cast("binary")), F.col("_id")]
    picked = [known.filter(F.col("_y") == y).orderBy(*order).limit(most) for y in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * most rows at most
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), whole_text().alias("_t")).join(chosen, "_id")
    # Repeated ids count once, so the sample keeps its bound.
    rows = rows.groupBy("_id").agg(F.min("_t").alias("_t"), F.max("_y").alias("_y")).orderBy("_id")
    got = rows.collect()
    return [r["_t"] for r in got], [int(r["_y"]) for r in got]


def held_out(doc_id: str):
    """Whether a row is never learned from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(3)) == 1, F.lit(False))


def _slices(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in arrow:
        for first in range(0, batch.num_rows, SLICE_TEXTS):
            yield batch.slice(first, SLICE_TEXTS)


def _score(weights: np.ndarray, bias: float, inside: str | None):
    def run(arrow: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(weights, bias)
        for batch in _slices(arrow):
            scores, spans = [], []
            texts = pc.struct_field(batch.column(inside), "text") if inside else batch.column("_text")
            for text in texts.to_pylist():
                text = text or ""
                s = model.document_score(bags(text))
                scores.append(s)
                # Only where a document offends it pays to look for the place.
                spans.append(worst_sentence(model, text) if s >= THRESHOLD else (None, None))
            rest = batch if inside else batch.drop_columns(["_text"])
            starts, ends = [a for a, _ in spans], [b for _, b in spans]
            columns = [*rest.columns, pa.array(scores, pa.float64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*rest.schema.names, "score", "worst_start", "worst_end"])

    return run


def worst_sentence(model: Model, text: str) -> tuple[int | None, int | None]:
    """(start, end) in code points of the sentence with the highest score, the first of equals."""
    spans = [m.span() for m in _SENTENCE.finditer(text) if _WORD.search(text, m.start(), m.end())]
    if not spans:
        return None, None
    return spans[int(np.argmax([model.sums(bags(text[a:b])).max(initial=-np.inf) for a, b in spans]))]


def score(docs: DataFrame, model: Model, keep: list[str], inside: str | None = None) -> DataFrame:
    """The columns `keep` of docs, with score, worst_start and worst_end.

    The text is the column `text`, or the string field `text` of the kept struct
    column `inside`, which then goes to the workers once.

    A null text is empty; a text without words has score 0. Repeated rows score
    alike. An empty table gives no rows. Other columns are never looked at.
    """
    read = docs.select(*keep) if inside else docs.select(*keep, whole_text().alias("_text"))
    schema = docs.select(*keep).schema.add("score", "double").add("worst_start", "long").add("worst_end", "long")
    return read.mapInArrow(released(_score(model.weights.astype(np.float32), model.bias, inside)), schema)


def trained(docs: DataFrame, labels: DataFrame) -> Model:
    return fit(*training_rows(docs, labels))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs, model, ["doc_id"]).select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).cast("int").alias("predicted"), "worst_start", "worst_end"
    )
