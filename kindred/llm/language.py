"""Language identification by a string kernel.

Kernel: the number of distinct byte n-grams (n = 1 .. 4, hashed to BINS, of the lower-cased
text with runs of anything but letters as one space) that two texts share, over the geometric
mean of their own numbers: a blended-spectrum presence kernel. Nystroem: features are
kernel values to landmark texts times the inverse square root of the landmarks' own kernel.
One-versus-rest ridge regression on the features gives a score a language. All steps after
the kernel's counts are linear, so landmarks and weights are multiplied into one matrix
(BINS x languages) once, and texts are scored by products of presence matrices with it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import slices
from kindred.plans.scratch import Scratch

BINS = 1 << 16
_GAP = re.compile(r"[\W\d_]+")
_ROWS = 64


@dataclass(frozen=True)
class LanguageParams:
    """sample: texts to learn from, about (the bound of the fit's sample), and per_language of each language, at most; landmarks of a language, and most_landmarks in all; ridge; sharpness of the score's softmax."""

    sample: int = 25_600
    per_language: int = 400
    landmarks: int = 32
    most_landmarks: int = 2048
    ridge: float = 0.5
    sharpness: float = 5.0


@dataclass(frozen=True)
class LanguageModel:
    labels: tuple[str, ...]
    weights: np.ndarray  # BINS x labels
    bias: np.ndarray
    sharpness: float

    def scores(self, presence: np.ndarray) -> np.ndarray:
        size = np.sqrt(presence.sum(axis=1, dtype=np.float64)).astype(np.float32)
        return (presence @ self.weights) / np.maximum(size, 1)[:, None] + self.bias


def grams(text: str) -> np.ndarray:
    """Bins of all n-grams of a text, repeats included."""
    b = np.frombuffer((" " + _GAP.sub(" ", text.lower()) + " ").encode(), dtype=np.uint8).astype(np.uint32)
    out, h = [], np.zeros(len(b), dtype=np.uint32)
    for n in range(1, 5):
        if len(b) < n:
            break
        h = h[: len(b) - n + 1] * np.uint32(0x01000193) + b[n - 1 :] + np.uint32(n)
        out.append((h * np.uint32(0x9E3779B1)) >> np.uint32(16))
    return np.concatenate(out)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _presence(texts: list[str]) -> np.ndarray:
    p = np.zeros((len(texts), BINS), dtype=np.float32)
    for i, t in enumerate(texts):
        p[i, grams(t)] = 1
    return p


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch):
            own = [(l, t.decode()) for l, t in zip(part.column("lang").to_pylist(), texts) if t]
            own = [(l, np.packbits(_presence([t])[0] > 0).tobytes()) for l, t in own if has_letter(t)]
            yield pa.RecordBatch.from_arrays([pa.array([l for l, _ in own], pa.string()), pa.array([b for _, b in own], pa.binary())], ["lang", "bits"])


def _unpacked(rows: list[tuple[str, bytes]]) -> np.ndarray:
    """Presence of packed texts (label, bits), one a row."""
    return np.unpackbits(np.frombuffer(b"".join(b for _, b in rows), dtype=np.uint8).reshape(len(rows), -1), axis=1).astype(np.float32)


def fit(docs: DataFrame, params: LanguageParams = LanguageParams()) -> LanguageModel | None:
    """A model from the rows of docs whose lang is set and whose crc32(doc_id as text) mod 5 is not 0.

    The fit's sample is params.sample texts at most, about, dealt by a hash of doc_id and text
    evenly over all languages, rows that repeat both counting once; only if there are more
    languages than that is it a sample of them.
    The model holds BINS numbers a language. None if there is nothing to learn from.
    """
    known = docs.where(F.col("lang").isNotNull() & ~held_out() & F.col("doc_id").isNotNull())
    dealt = F.xxhash64(F.lit(11), "doc_id", "text")
    counts = Scratch(docs.sparkSession).save(known.groupBy("lang").agg(F.approx_count_distinct(dealt, 0.02).alias("n")), "languages")
    languages = max(1, counts.count())
    quota, kept = min(params.per_language, max(1, params.sample // languages)), min(1.0, params.sample / languages)
    counts = counts.where(F.pmod(F.xxhash64(F.lit(13), "lang"), F.lit(1_000_000)) < 1_000_000 * kept) if kept < 1 else counts
    share = F.pmod(dealt, F.lit(1_000_000)) < F.lit(1_000_000 * quota) / F.col("n")
    # The counts are bounded by the sample: one row a language, and about params.sample of them.
    sample = known.select("doc_id", "lang", "text").join(F.broadcast(counts), "lang").where(share).dropDuplicates(["doc_id", "lang", "text"])
    rows = sample.select("lang", "text").mapInArrow(_packed, "lang string, bits binary").collect()
    if not rows:
        return None
    rows = sorted((r["lang"], bytes(r["bits"])) for r in rows)
    labels = tuple(sorted({l for l, _ in rows}))
    rng, marks = np.random.default_rng(3), []
    for label in labels:
        own = [r for r in rows if r[0] == label]
        marks += [own[i] for i in rng.permutation(len(own))[: max(1, min(params.landmarks, params.most_landmarks // len(labels)))]]
    marks = marks if len(marks) <= params.most_landmarks else [marks[i] for i in sorted(rng.permutation(len(marks))[: params.most_landmarks])]
    landmark = _unpacked(marks)
    landmark /= np.sqrt(landmark.sum(axis=1, keepdims=True))
    value, vector = np.linalg.eigh((landmark @ landmark.T).astype(np.float64))
    good = value > 1e-6 * value[-1]
    root = vector[:, good] / np.sqrt(value[good])
    feature = []
    for i in range(0, len(rows), _ROWS):
        part = _unpacked(rows[i : i + _ROWS])
        feature.append((part @ landmark.T / np.sqrt(part.sum(axis=1, keepdims=True))) @ root)
    phi = np.concatenate(feature)
    place = {label: i for i, label in enumerate(labels)}
    which = np.array([place[l] for l, _ in rows])
    y = np.where(which[:, None] == np.arange(len(labels)), 1.0, -1.0)
    # Each language weighs the same, whatever its share of the sample.
    weight = (1.0 / np.bincount(which))[which] * len(rows) / len(labels)
    mean, centre = np.average(phi, axis=0, weights=weight), np.average(y, axis=0, weights=weight)
    x = (phi - mean) * np.sqrt(weight)[:, None]
    w = np.linalg.solve(x.T @ x + params.ridge * np.eye(x.shape[1]), x.T @ ((y - centre) * np.sqrt(weight)[:, None]))
    return LanguageModel(labels, (landmark.T @ (root @ w)).astype(np.float32), (centre - mean @ w).astype(np.float32), params.sharpness)


def held_out(column: str = "doc_id"):
    """Whether crc32 of the id as text is divisible by 5 (null id: no)."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _predict(model: LanguageModel | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k = batch.schema.get_field_index("text")
            names = [*(n for i, n in enumerate(batch.schema.names) if i != k), "lang_pred", "score", "margin"]
            for part, raw in slices(batch):
                texts = [t.decode() if t else "" for t in raw]
                pred, score, lead = ["und"] * len(texts), [0.0] * len(texts), [-1.0] * len(texts)
                some = [i for i, t in enumerate(texts) if model is not None and has_letter(t)]
                for at in range(0, len(some), _ROWS):
                    rows = some[at : at + _ROWS]
                    margin = model.scores(_presence([texts[i] for i in rows])).astype(np.float64)
                    p = np.exp(model.sharpness * (margin - margin.max(axis=1, keepdims=True)))
                    p /= p.sum(axis=1, keepdims=True)
                    for i, best, own, raw_ in zip(rows, p.argmax(axis=1), p, margin):
                        pred[i], score[i], lead[i] = model.labels[best], float(own[best]), float(raw_[best])
                rest = [c for i, c in enumerate(part.columns) if i != k]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(lead, pa.float64())], names)

    return run


def predict(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of docs; only text goes into a prediction.

    und with score 0: null text, text without a letter, or no model. Rows with equal texts
    get equal results. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", held_out().alias("held_out"), "text")
    return rows.mapInArrow(_predict(model), f"doc_id {kind}, held_out boolean, lang_pred string, score double, margin double").drop("margin")


def identify(docs: DataFrame, model: LanguageModel | None) -> DataFrame:
    """docs with columns lang_pred, score and margin; columns of these names are replaced.

    margin: the best language's regression value. It was fitted to 1 for texts of the language
    and to -1 for others, whatever the number of languages; -1 where nothing is predicted.
    """
    if model is None:
        return docs.withColumn("lang_pred", F.lit("und")).withColumn("score", F.lit(0.0)).withColumn("margin", F.lit(-1.0))
    own = docs.drop("lang_pred", "score", "margin").withColumn("kept_text", F.col("text"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "text")
    out = own.mapInArrow(_predict(model), f"{schema}, lang_pred string, score double, margin double").withColumnRenamed("kept_text", "text")
    return out.select(*[c for c in docs.columns if c not in ("lang_pred", "score", "margin")], "lang_pred", "score", "margin")
