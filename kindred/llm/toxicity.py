"""Toxicity by a classifier chain over features of words.

The chain predicts its categories one after the other. Each is a logistic regression over
the distinct words of a text (letters and digits) and their beginnings, each scaled by how
much more often the category's texts have it (a naive Bayes log ratio), and over the probabilities of all
earlier categories. While fitting, those come from out-of-fold predictions, so that later
models see earlier ones as they are on unseen texts. Categories are conditions on the label
table, so a table with finer labels makes a longer chain; with the given one the order is
low quality, toxic and of low quality, toxic: the reported label comes last and is fed by
the other two.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kindred.llm.text import MARKS, Words, slices

BITS = 18
#: Bytes of the beginnings of words that are features too, so that other forms of a word are known by it.
PREFIXES = (4, 6, 8)
#: (name, SQL condition on a row of labels), in the order of the chain.
CATEGORIES = (("low_quality", "quality = 0"), ("toxic_junk", "toxic = 1 and quality = 0"), ("toxic", "toxic = 1"))


@dataclass(frozen=True)
class ToxicityParams:
    """sample: labelled texts that are learned from, of each side of the last category, about (the bound of the fit's sample); folds of the chain; least_df: texts of the sample that a word must be in; ridge; steps of the optimiser."""

    sample: int = 2500
    folds: int = 5
    least_df: int = 3
    ridge: float = 0.003
    steps: int = 150


@dataclass(frozen=True)
class Chain:
    """names of the categories; weights: categories x bins; bias; link: weights of earlier probabilities, lower triangular."""

    names: tuple[str, ...]
    weights: np.ndarray
    bias: np.ndarray
    link: np.ndarray

    def probabilities(self, bins: np.ndarray, bound: np.ndarray) -> np.ndarray:
        """Texts x categories; texts without words have zeros."""
        p = np.zeros((len(bound) - 1, len(self.names)))
        for c in range(len(self.names)):
            p[:, c] = _sigmoid(_sums(self.weights[c], bins, bound) + self.bias[c] + p[:, :c] @ self.link[c, :c])
        return np.where(np.diff(bound)[:, None] > 0, p, 0.0)


def word_bins(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct bins of each text's words and of their beginnings, end to end, and their bounds."""
    w = Words(texts, MARKS)
    owner = np.repeat(np.arange(len(texts), dtype=np.uint64), w.count) << np.uint64(BITS)
    both = [owner | w.hash >> np.uint64(64 - BITS)]
    for n in PREFIXES:
        long, h = w.prefixes(n)
        both.append(owner[long] | h >> np.uint64(64 - BITS))
    some = np.unique(np.concatenate(both))
    bound = np.searchsorted(some, np.arange(len(texts) + 1, dtype=np.uint64) << np.uint64(BITS))
    return (some & np.uint64((1 << BITS) - 1)).astype(np.int64), bound


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in slices(batch):
            bins, bound = word_bins(texts)
            lists = pa.array([bins[a:b].astype(np.int32).tobytes() for a, b in zip(bound[:-1], bound[1:])], pa.binary())
            yield pa.RecordBatch.from_arrays([part.column("y"), lists], ["y", "bins"])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _sums(w: np.ndarray, bins: np.ndarray, bound: np.ndarray) -> np.ndarray:
    run = np.concatenate([[0.0], np.cumsum(w[bins], dtype=np.float64)])
    return run[bound[1:]] - run[bound[:-1]]


def _logistic(lists: list[np.ndarray], dense: np.ndarray, y: np.ndarray, width: int, p: ToxicityParams) -> tuple[np.ndarray, float, np.ndarray]:
    """Weights of the words, bias, weights of the dense columns: balanced, ridged logistic regression by Adam over all rows, on words scaled by their log ratios."""
    n, k, pos = len(y), dense.shape[1], int(y.sum())
    if not 0 < pos < n:
        return np.zeros(width), 30.0 if pos else -30.0, np.zeros(k)
    bins, bound = _flat(lists)
    owner = np.repeat(np.arange(n), np.diff(bound))
    yes = np.bincount(bins, weights=y[owner], minlength=width)
    no = np.bincount(bins, minlength=width) - yes
    scale = np.abs(np.log((yes + 1) / (pos + 2)) - np.log((no + 1) / (n - pos + 2)))
    theta, m, v = np.zeros(width + 1 + k), np.zeros(width + 1 + k), np.zeros(width + 1 + k)
    share = np.where(y > 0, 0.5 / pos, 0.5 / (n - pos))
    for t in range(1, p.steps + 1):
        err = share * (_sigmoid(_sums(theta[:width] * scale, bins, bound) + theta[width] + dense @ theta[width + 1 :]) - y)
        g = np.concatenate([scale * np.bincount(bins, weights=err[owner], minlength=width), [err.sum()], dense.T @ err])
        g += p.ridge * np.concatenate([theta[:width], [0.0], theta[width + 1 :]])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta -= 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-9)
    return theta[:width] * scale, float(theta[width]), theta[width + 1 :]


def _flat(lists: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in lists])]).astype(np.int64)


def fit_chain(lists: list[np.ndarray], labels: np.ndarray, names: tuple[str, ...], p: ToxicityParams = ToxicityParams()) -> Chain:
    """A chain from lists of word bins and labels (texts x categories: 0, 1, or NaN where unknown, which that category's models leave out)."""
    df = np.bincount(np.concatenate([*lists, np.empty(0, np.int64)]).astype(np.int64), minlength=1 << BITS)
    used = np.flatnonzero(df >= p.least_df)
    place = np.full(1 << BITS, -1)
    place[used] = np.arange(len(used))
    lists = [x[x >= 0] for x in (place[l] for l in lists)]
    flat, bound = _flat(lists)
    n, k = labels.shape
    fold = np.arange(n) % p.folds
    weights, bias, link = np.zeros((k, 1 << BITS), dtype=np.float32), np.zeros(k), np.zeros((k, k))
    ahead = np.zeros((n, 0))
    for c in range(k):
        known = ~np.isnan(labels[:, c])
        model = lambda rows, c=c: _logistic([lists[i] for i in rows], ahead[rows], labels[rows, c], len(used), p)
        held = np.zeros(n)
        for f in range(p.folds if c + 1 < k else 0):
            w, b, d = model(np.flatnonzero(known & (fold != f)))
            held = np.where(fold == f, _sigmoid(_sums(w, flat, bound) + b + ahead @ d), held)
        w, b, d = model(np.flatnonzero(known))
        weights[c, used], bias[c], link[c, :c] = w, b, d
        ahead = np.column_stack([ahead, held])
    return Chain(names, weights, bias, link)


def fit(docs: DataFrame, labels: DataFrame, params: ToxicityParams = ToxicityParams(), categories: tuple[tuple[str, str], ...] = CATEGORIES) -> Chain | None:
    """A chain from the labelled texts of docs, or None without texts on both sides of the last category.

    The sample is bounded by params.sample texts a side. Of labels that repeat an id, the
    greatest answer of each category counts; of texts that repeat it, the least. Null labels
    are unknown; a null id is labelled by nothing.
    """
    names = [name for name, _ in categories]
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").alias("l_id")).agg(*[F.max(F.expr(f"cast({rule} as int)")).alias(name) for name, rule in categories])
    last = F.col(names[-1])
    count = {r[0]: r[1] for r in known.where(last.isNotNull()).groupBy(last).agg(F.count_if(F.lit(True))).collect()}
    if len(count) < 2:
        return None
    deal = F.pmod(F.xxhash64(F.lit(5), "l_id"), F.lit(1_000_000))
    picked = [known.where((last == k) & (deal < 1_000_000 * params.sample / n)).limit(2 * params.sample) for k, n in sorted(count.items())]
    picked = picked[0].union(picked[1]).select("l_id", F.array(*[F.col(c).cast("double") for c in names]).alias("y"))
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("l_id"))
    rows = rows.groupBy("l_id").agg(F.min("text").alias("text"), F.first("y").alias("y")).select("text", "y").mapInArrow(_features, "y array<double>, bins binary").collect()
    rows = sorted(([-1.0 if x is None else x for x in r["y"]], bytes(r["bins"])) for r in rows)
    if len({y[-1] for y, _ in rows}) < 2:
        return None
    rows = [rows[i] for i in np.random.default_rng(1).permutation(len(rows))]
    y = np.array([y for y, _ in rows])
    return fit_chain([np.frombuffer(b, dtype=np.int32) for _, b in rows], np.where(y < 0, np.nan, y), tuple(names), params)


def _score(chain: Chain | None, names: tuple[str, ...], threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                p = np.zeros((len(texts), len(names))) if chain is None else chain.probabilities(*word_bins(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x >= threshold) for x in p.T], *[pa.array(np.ascontiguousarray(x)) for x in p.T]], ["doc_id", *names, *[f"p_{c}" for c in names]])

    return run


def score_toxicity(docs: DataFrame, chain: Chain | None, threshold: float = 0.5) -> DataFrame:
    """doc_id, a decision and a probability (p_ and its name) for each category, for every row of docs.

    Texts without words (null, empty, blank, marks only) and all texts without a chain have
    probabilities of 0. Equal texts have equal results; texts are read whole. Only doc_id and
    text are read. An empty table gives none.
    """
    names = chain.names if chain else tuple(c for c, _ in CATEGORIES)
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"{c} boolean" for c in names) + ", " + ", ".join(f"p_{c} double" for c in names)
    return docs.select("doc_id", "text").mapInArrow(_score(chain, names, threshold), schema)
