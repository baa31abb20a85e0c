"""Quality scores: hashed word n-gram logistic regression trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_batches, mix64, stable_order

BITS = 18
#: Most labelled documents that training reads: a bound on its one task, by hash order of the ids.
SAMPLE = 8000
#: Token codes that a worker keeps.
CACHE = 150_000

_SHAPES = ((re.compile(r"[^\W\d_]+"), lambda m: "A" if len(m[0]) > 1 and m[0].isupper() else "a"), (re.compile(r"\d+"), "0"), (re.compile(r"([^\w\s])\1+"), r"\1\1"))


class _Codes(dict):
    """64-bit codes of a token: of its lower-cased form, and of its shape (letter case, digits, doubled signs)."""

    def __missing__(self, token: bytes) -> tuple[int, int]:
        if len(self) >= CACHE:
            self.clear()
        text = shape = token.decode("utf-8", "replace")
        for pattern, to in _SHAPES:
            shape = pattern.sub(to, shape)
        word = text.lower().encode()
        code = self[token] = (zlib.crc32(word) << 32 | zlib.adler32(word), zlib.crc32(shape.encode("utf-8", "replace")))
        return code


_codes = _Codes()


def ngrams(text: bytes) -> list[np.ndarray]:
    """Hashed features of a whole text, by family: words, word pairs, and shapes by one, two and three.

    A shape also tells whether its token repeats the one before. Without tokens there are no features.
    """
    tokens = text.split()
    if not tokens:
        return []
    codes = np.array([_codes[t] for t in tokens], np.uint64)
    word, shape = mix64(codes[:, 0]), codes[:, 1] * np.uint64(2)
    shape[1:] += word[1:] == word[:-1]
    shape = mix64(shape + np.uint64(1 << 40))
    k = np.uint64(0x9E3779B97F4A7C15)
    pair = mix64(word[:-1] * k + word[1:])
    two = mix64(shape[:-1] * k + shape[1:])
    three = mix64(two[:-1] * k + shape[2:])
    return [(x >> np.uint64(64 - BITS)).astype(np.int64) for x in (word, pair, shape, two, three) if len(x)]


def score_text(text: bytes, weights: np.ndarray, bias: float) -> float:
    """Probability from the sparse dot product: each family's features weigh by their relative frequency."""
    z = bias + sum(float(weights[x].mean()) for x in ngrams(text))
    return 1 / (1 + np.exp(-min(max(z, -30.0), 30.0)))


@dataclass
class FollowTheRegularisedLeader:
    """FTRL-proximal logistic regression (McMahan et al., 2013) on sparse rows; the last weight is the bias."""

    size: int
    alpha: float = 0.5
    beta: float = 0.1
    l1: float = 0.002
    l2: float = 0.01

    def __post_init__(self):
        self.z, self.n = np.zeros(self.size + 1), np.zeros(self.size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        l1 = np.where(np.arange(self.size + 1)[at] == self.size, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, x: np.ndarray, label: int) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - label) * x
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / self.alpha
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def train(rows: list[tuple[bytes, int]], epochs: int = 3) -> tuple[np.ndarray, float]:
    model = FollowTheRegularisedLeader(1 << BITS)
    made = []
    for text, label in rows:
        at, x = [np.array([model.size])], [np.ones(1)]
        for family in ngrams(text):
            u, c = np.unique(family, return_counts=True)
            at.append(u)
            x.append(c / len(family))
        at, where = np.unique(np.concatenate(at), return_inverse=True)
        made.append((at.astype(np.int32), np.bincount(where, np.concatenate(x)).astype(np.float32), label))
    for _ in range(epochs):
        for at, x, label in made:
            model.learn(at, x, label)
    w = model.weights()
    return w[:-1].astype(np.float32), float(w[-1])


def held_out(id_column: str = "doc_id") -> Column:
    """The fold that no label is learned from: crc32 of the id as text is divisible by 5 (a null id never)."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def labelled(labels: DataFrame, label: str, id_column: str = "doc_id") -> DataFrame:
    """(doc_id, label) outside the held-out fold; rows without id or label are ignored, of repeated ids the largest label counts."""
    rows = labels.where(F.col(id_column).isNotNull() & F.col(label).isNotNull() & ~held_out(id_column))
    return rows.groupBy(F.col(id_column).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", threshold: float = 0.3, sample: int = SAMPLE, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row: the probability that ``label`` is 1, from the whole text.

    Training reads at most ``sample`` labelled documents outside the held-out fold, the first by a hash of
    their id, in one task; its weights (1 MB) are broadcast. Ids, languages and sources are no inputs. A null or
    empty text scores by the bias alone; without labels every score is 0.5. Null ids stay null; repeated rows
    are each scored; an empty table gives an empty one.
    """
    chosen = labelled(labels, label, id_column).orderBy(*stable_order("doc_id")).limit(sample)
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text").alias("order"), "text", "label")

    def fit(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = [(t, y) for b in it for t, y in zip(as_bytes(b.column(1)), b.column(2).to_pylist(), strict=True)]
        w, bias = train(seen) if seen else (np.zeros(1 << BITS, np.float32), 0.0)
        yield pa.RecordBatch.from_arrays([pa.array([w.tobytes()], pa.binary()), pa.array([bias])], names=["w", "bias"])

    got = map_batches(rows.repartition(1).sortWithinPartitions("order"), fit, "w binary, bias double").first()
    weights = np.frombuffer(got["w"], np.float32) if got else np.zeros(1 << BITS, np.float32)
    return score_documents(texts, score_text, (weights, got["bias"] if got else 0.0), threshold)


def score_documents(texts: DataFrame, score, model: tuple, threshold: float) -> DataFrame:
    """(doc_id, held_out, score, predicted) by a function of a text's bytes and a broadcast model."""
    shared = texts.sparkSession.sparkContext.broadcast(model)

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            s = pa.array([float(score(t, *shared.value)) for t in as_bytes(batch.column(1))], pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0), s], names=["doc_id", "score"])
        _codes.clear()

    scored = map_batches(texts.select("doc_id", "text"), scan, f"doc_id {dict(texts.dtypes)['doc_id']}, score double")
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
