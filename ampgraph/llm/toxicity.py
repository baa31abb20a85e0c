"""Toxicity scores by non-negative positive-unlabelled learning.

A linear classifier over hashed words and word beginnings learns from confirmed toxic documents and unlabelled
text. The risk on clean text is estimated as the unlabelled risk less the share that toxic text has in it (the
class prior); where that estimate turns negative on a batch, the step goes the other way (Kiryo et al., 2017).
All weights begin at zero and all features of the training texts take part; follow-the-regularised-leader steps
keep those at zero whose gradients don't add up.
"""

from __future__ import annotations

import itertools
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, stable_order
from .quality import labelled, score_documents

BITS = 18
#: Most labelled rows that training reads as confirmed and as unlabelled, by hash order of the ids: bounds on its one task.
POSITIVES, UNLABELLED = 3000, 9000
PREFIXES = (3, 4, 5)
#: Words whose scores a worker keeps.
CACHE = 150_000
_words = re.compile(r"[^\W\d_]+").findall


def word_features(word: str) -> list[int]:
    """Hashed: the word, and its beginnings where it is longer than they are."""
    parts = [word, *("^" + word[:k] for k in PREFIXES if len(word) >= k)]
    return [(zlib.crc32(p.encode("utf-8", "replace")) * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - BITS) for p in parts]


class _WordScores(dict):
    """The sum of a word's weights, kept by word."""

    def __init__(self, weights: np.ndarray):
        super().__init__()
        self.weights = weights

    def __missing__(self, word: str) -> float:
        if len(self) >= CACHE:
            self.clear()
        value = self[word] = float(self.weights[word_features(word)].sum())
        return value


_scores: dict[int, _WordScores] = {}


def score_text(text: bytes, weights: np.ndarray, bias: float) -> float:
    """Probability from the distinct words of a whole text."""
    if id(weights) not in _scores:
        _scores.clear()
        _scores[id(weights)] = _WordScores(weights)
    words = sorted(set(_words(text.decode("utf-8", "replace").lower())))
    z = bias + sum(map(_scores[id(weights)].__getitem__, words))
    return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


def _rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct words of all documents end to end by number, where each document begins, and features by word (-1: none)."""
    number: dict[str, int] = {}
    made, features = [], array("i")
    for text in texts:
        own = []
        for word in set(_words(text.decode("utf-8", "replace").lower())):
            k = number.setdefault(word, len(number))
            if k * (1 + len(PREFIXES)) == len(features):
                f = word_features(word)
                features.extend(f + [-1] * (1 + len(PREFIXES) - len(f)))
            own.append(k)
        made.append(np.sort(np.array(own, np.int32)))
    starts = np.cumsum([0, *map(len, made)])
    return np.concatenate([np.empty(0, np.int32), *made]), starts, np.array(features, np.int32).reshape(-1, 1 + len(PREFIXES))


def risk_slopes(z: np.ndarray, n_p: int, prior: float) -> np.ndarray:
    """The risk's derivatives by the scores of a batch (its first ``n_p`` are confirmed), under sigmoid losses.

    While the clean part of the risk is not negative they are those of the whole risk; else those of the negated
    clean part, which leads back.
    """
    q = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    slope = q * (1 - q)
    g = np.concatenate([-prior * slope[:n_p] / n_p, slope[n_p:] / (len(z) - n_p)])
    if q[n_p:].mean() < prior * q[:n_p].mean():
        return -g
    g[:n_p] -= prior * slope[:n_p] / n_p
    return g


def train(positive: list[bytes], unlabelled: list[bytes], prior: float, epochs: int = 40, batch: int = 512, alpha: float = 0.5, beta: float = 1e-3, l1: float = 0.01) -> tuple[np.ndarray, float]:
    """Weights and bias that lessen the non-negative risk, by FTRL-proximal steps on batches.

    A feature's input is whether it is in the document, less its share among the unlabelled ones, times its rarity
    there (minus the logarithm of that share, 1 for a single document). Without a text of either kind all is zero.
    """
    size = 1 << BITS
    if not positive or not unlabelled:
        return np.zeros(size, np.float32), 0.0
    n_p, n_u = len(positive), len(unlabelled)
    words, starts, features = _rows(positive + unlabelled)
    docs = [np.unique(f[f >= 0]) for f in (features[words[a:b]] for a, b in itertools.pairwise(starts.tolist()))]
    share = np.bincount(np.concatenate(docs[n_p:]), minlength=size) / n_u
    scale = np.where(share > 0, -np.log(np.maximum(share, 1 / n_u)) / max(np.log(n_u), 1e-9), 0.0)
    w, z, n = np.zeros(size), np.zeros(size), np.zeros(size)
    bias, steps = float(np.log(prior / (1 - prior))), 1e-6
    rng = np.random.default_rng(5)
    for _ in range(epochs):
        parts = max(1, min(n_u // batch, n_p))
        for p, u in zip(np.array_split(rng.permutation(n_p), parts), np.array_split(n_p + rng.permutation(n_u), parts), strict=True):
            some = [docs[d] for d in np.concatenate([p, u])]
            flat, sizes = np.concatenate(some), np.array([len(x) for x in some])
            owner = np.repeat(np.arange(len(some)), sizes)
            score = bias - (w * scale) @ share + np.bincount(owner, (w * scale)[flat], len(some))
            g = risk_slopes(score, len(p), prior)
            grad = (np.bincount(flat, g[owner], size) - share * g.sum()) * scale
            z += grad - (np.sqrt(n + grad * grad) - np.sqrt(n)) / alpha * w
            n += grad * grad
            w = np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha))
            steps += g.sum() ** 2
            bias -= 0.1 * g.sum() / np.sqrt(steps)
    return (w * scale).astype(np.float32), float(bias - (w * scale) @ share)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, epochs: int = 40, id_column: str = "doc_id", text_column: str = "text") -> tuple[np.ndarray, float]:
    """Weights and bias.

    Training reads, in one task, at most ``positives`` documents labelled 1 as confirmed ones, and at most
    ``unlabelled`` labelled documents without their labels; all are outside the held-out fold, and first by a hash
    of their id. ``prior`` defaults to the share of 1 among all labels outside that fold.
    """
    known = labelled(labels, label, id_column)
    if prior is None:
        share = known.agg(F.avg("label")).first()[0]
        prior = min(max(share or 0.0, 1e-3), 0.5)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    marked = known.where("label = 1").orderBy(*stable_order("doc_id")).limit(positives).select("doc_id", F.lit(1).alias("positive"))
    other = known.orderBy(*stable_order("doc_id")).limit(unlabelled).select("doc_id", F.lit(0).alias("positive"))
    rows = texts.join(F.broadcast(marked.unionByName(other)), "doc_id").select(F.xxhash64("doc_id", "text", "positive").alias("order"), "text", "positive")

    def learn(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[list, list] = ([], [])
        for b in it:
            for t, y in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True):
                seen[y].append(t)
        w, bias = train(seen[1], seen[0], prior, epochs)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    got = map_batches(rows.repartition(1).sortWithinPartitions("order"), learn, "w binary, bias double").first()
    return (np.frombuffer(got["w"], np.float32), got["bias"]) if got else (np.zeros(1 << BITS, np.float32), 0.0)


def toxicity_scores(docs: DataFrame, labels: DataFrame, label: str = "toxic", threshold: float = 0.5, prior: float | None = None, positives: int = POSITIVES, unlabelled: int = UNLABELLED, epochs: int = 40, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row: the probability that ``label`` is 1, from the whole text.

    The model of ``fit`` (1 MB) is broadcast. Ids, languages and sources are no inputs. A null or empty text scores
    by the bias alone; without positive labels every score is 0.5. Null ids stay null; repeated rows are each
    scored; an empty table gives an empty one.
    """
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return score_documents(texts, score_text, fit(docs, labels, label, prior, positives, unlabelled, epochs, id_column, text_column), threshold)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that score under ``threshold``, with all their columns; rows without words stay.

    Without positive labels nothing is known to be toxic, and every row stays.
    """
    model = fit(docs, labels, text_column=text_column)
    if not model[0].any():
        return docs
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index(text_column)

    def keep(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            ok = [not t.strip() or score_text(t, *shared.value) < threshold for t in as_bytes(batch.column(place))]
            yield batch.filter(pa.array(ok, pa.bool_()))
        _scores.clear()

    return map_batches(docs, keep, docs.schema)
