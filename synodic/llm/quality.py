"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

The pairwise part is scored in linear time: sum over factors of half (sum of v*x) squared minus the
sum of (v*x) squared. Metadata is the table's own count of signs (``n_chars``, if there is such a column):
its size, and how far it is from the text's. Null and empty texts get the score of a document without
words, a null count that of the text; texts may be of any length; repeated rows are scored each, whatever
their id; other columns of the input are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Shared, bucket_of, labelled_sample, over_texts, record, sigmoid, words_of

STATS = 14
BINS = 16


@dataclass(frozen=True)
class QualityConfig:
    """``max_train`` bounds the labelled documents the machine is fitted on (by hash order of the id)."""

    buckets: int = 1 << 16
    factors: int = 8
    max_train: int = 6000
    epochs: int = 12
    rate: float = 0.05
    decay: float = 1e-5


def statistics(text: str, n_chars: int | None = None) -> list[float]:
    """Structure statistics of a text and metadata, each between 0 and 1."""
    n = len(text)
    told = n if n_chars is None else max(int(n_chars), 0)
    metadata = [min(1.0, np.log1p(told) / 14), min(1.0, abs(told - n) / max(n, 1))]
    if not n:
        return [0.0] * (STATS - 2) + metadata
    words = text.split()
    lines = text.split("\n")
    n_words = max(len(words), 1)
    raw = text.encode("utf-8", "surrogatepass")
    counts = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, digits = counts[65:91].sum(), counts[48:58].sum()
    letters = counts[65:91].sum() + counts[97:123].sum() + counts[192:].sum()
    stops = counts[[33, 44, 46, 63]].sum()
    symbols = counts[33:48].sum() + counts[58:65].sum() + counts[91:97].sum() + counts[123:127].sum() - stops
    return [
        upper / max(letters, 1),
        digits / n,
        min(1.0, 4 * symbols / n),
        min(1.0, 8 * stops / n),
        min(1.0, 8 * counts[33] / n),
        min(1.0, letters / n_words / 16),
        min(1.0, np.log1p(n) / 14),
        min(1.0, np.log1p(n / len(lines)) / 10),
        len(set(words)) / n_words,
        len(set(lines)) / len(lines),
        min(1.0, 4 * counts[192:].sum() / n),
        sum(not w[-1].isalpha() for w in words) / n_words,
        *metadata,
    ]


def features(texts: list[str], buckets: int, counts_told: list | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, feature, value) triples, sorted by document; one-hot bins follow the word buckets."""
    hashes, counts = words_of(texts)
    doc = np.repeat(np.arange(len(texts)), counts)
    key, tf = np.unique(doc * buckets + (hashes % np.uint64(buckets)).astype(np.int64), return_counts=True)
    doc, index, value = key // buckets, key % buckets, np.log1p(tf).astype(np.float32)
    norm = np.sqrt(np.bincount(doc, value * value, minlength=len(texts)))
    value = value / np.maximum(norm, 1e-9)[doc]
    stats = np.array([statistics(t, n) for t, n in zip(texts, counts_told or [None] * len(texts), strict=True)])
    bins = np.minimum((stats * BINS).astype(int), BINS - 1) + buckets + np.arange(STATS) * BINS
    every = np.repeat(np.arange(len(texts)), STATS)
    doc, index = np.concatenate((doc, every)), np.concatenate((index, bins.ravel()))
    value = np.concatenate((value, np.full(len(every), STATS**-0.5))).astype(np.float32)
    order = np.argsort(doc, kind="stable")
    return doc[order], index[order], value[order]


class FactorisationMachine:
    """y = bias + w.x + pairwise; logistic loss, Adagrad on mini-batches."""

    def __init__(self, size: int, factors: int, seed: int = 7):
        self.bias = 0.0
        self.w = np.zeros(size, dtype=np.float32)
        self.v = np.random.default_rng(seed).normal(0, 0.02, (size, factors)).astype(np.float32)

    def margins(self, doc, index, value, n: int) -> np.ndarray:
        """Every document needs one feature at least; the statistics see to that."""
        if not n:
            return np.zeros(0)
        first = np.searchsorted(doc, np.arange(n))
        vx = self.v[index] * value[:, None]
        sums, squares = np.add.reduceat(vx, first), np.add.reduceat(vx * vx, first)
        return self.bias + np.add.reduceat(self.w[index] * value, first) + 0.5 * (sums * sums - squares).sum(1)

    def fit(self, doc, index, value, label, config: QualityConfig) -> FactorisationMachine:
        n, rng = len(label), np.random.default_rng(11)
        if not n:
            return self
        share = np.clip(label.mean(), 0.01, 0.99)
        self.bias = float(np.log(share / (1 - share)))
        seen_w, seen_v, seen_b = np.full(len(self.w), 1e-6, np.float32), np.full(self.v.shape, 1e-6, np.float32), 1e-6
        first = np.append(np.searchsorted(doc, np.arange(n)), len(doc))
        for _ in range(config.epochs):
            order = rng.permutation(n)
            for some in np.array_split(order, max(1, n // 64)):
                rows = np.concatenate([np.arange(first[i], first[i + 1]) for i in some])
                length = first[some + 1] - first[some]
                own, ix, x = np.repeat(np.arange(len(some)), length), index[rows], value[rows]
                cut = np.concatenate(([0], np.cumsum(length)[:-1]))
                vx = self.v[ix] * x[:, None]
                sums = np.add.reduceat(vx, cut)
                y = self.bias + np.add.reduceat(self.w[ix] * x, cut) + 0.5 * (sums**2 - np.add.reduceat(vx * vx, cut)).sum(1)
                g = (sigmoid(y) - label[some]).astype(np.float32) / len(some)
                unique, back = np.unique(ix, return_inverse=True)
                gw = np.bincount(back, g[own] * x).astype(np.float32) + config.decay * self.w[unique]
                gv_rows = g[own][:, None] * x[:, None] * (sums[own] - vx)
                gv = np.stack([np.bincount(back, gv_rows[:, f]) for f in range(gv_rows.shape[1])], 1).astype(np.float32) + config.decay * self.v[unique]
                seen_w[unique] += gw * gw
                seen_v[unique] += gv * gv
                seen_b += float(g.sum()) ** 2
                self.w[unique] -= config.rate * gw / np.sqrt(seen_w[unique])
                self.v[unique] -= config.rate * gv / np.sqrt(seen_v[unique])
                self.bias -= config.rate * float(g.sum()) / np.sqrt(seen_b)
        return self


def metadata(docs: DataFrame) -> list[str]:
    return [c for c in ("n_chars",) if c in docs.columns and isinstance(docs.schema[c].dataType, T.NumericType)]


def told(part) -> list | None:
    return part.column("n_chars").to_pylist() if "n_chars" in part.schema.names else None


def fit_quality(docs: DataFrame, labels: DataFrame, config: QualityConfig = QualityConfig(), doc_id="doc_id", text="text", label="quality") -> FactorisationMachine:
    """Fit on labelled rows whose crc32(id) mod 4 is not 2; features are made on the executors."""
    buckets = config.buckets
    sample = labelled_sample(docs, labels, doc_id, text, label, bucket_of(doc_id, 4) != 2, config.max_train, metadata(docs))

    def featurise(part, texts):
        doc, index, value = features(texts, buckets, told(part))
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        pairs = [(index[a:b].astype(np.int32).tobytes(), value[a:b].tobytes()) for a, b in zip(cut, cut[1:], strict=False)]
        return record(id=part.column(doc_id).cast("string"), label=part.column("label"), ix=[p[0] for p in pairs], x=[p[1] for p in pairs])

    rows = over_texts(sample, text, featurise, "id string, label int, ix binary, x binary").toArrow().sort_by("id").to_pylist()
    ix, x = [np.frombuffer(r["ix"], np.int32) for r in rows], [np.frombuffer(r["x"], np.float32) for r in rows]
    machine = FactorisationMachine(buckets + STATS * BINS, config.factors)
    if not rows:
        return machine
    doc = np.repeat(np.arange(len(rows)), [len(i) for i in ix])
    return machine.fit(doc, np.concatenate(ix), np.concatenate(x), np.array([r["label"] for r in rows], dtype=np.float32), config)


def score_quality(docs: DataFrame, machine: FactorisationMachine, config: QualityConfig = QualityConfig(), doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, score (0 to 1) of every whole text."""
    shared, buckets = Shared(docs.sparkSession, machine), config.buckets

    def score(part, texts):
        return record(doc_id=part.column(doc_id), score=sigmoid(shared.value.margins(*features(texts, buckets, told(part)), len(texts)).astype(np.float64)))

    kind = docs.schema[doc_id].dataType.simpleString()
    return over_texts(docs.select(doc_id, text, *metadata(docs)), text, score, f"doc_id {kind}, score double")


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, config: QualityConfig = QualityConfig()) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    scored = score_quality(docs, fit_quality(docs, labels, config), config)
    return scored.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
