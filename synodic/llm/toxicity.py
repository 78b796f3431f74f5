"""Toxicity: gradient-boosted trees over dense features with isotonic calibration.

Features: lexicon densities, lexicon words near a second-person word, capitals, punctuation and
obfuscation rates. The lexicon is a short fixed list and the words that the labelled sample shows
far more often in toxic texts. The calibration is by margins of five folds, for each of which the lexicon
and the trees are learned from the other four. Null and empty texts have all features 0; texts may be of
any length; repeated rows are scored each, whatever their id; words that tie for the last places of the
lexicon go by the alphabet; other columns of the input are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, bucket_of, labelled_sample, over_texts, record, sigmoid, written

# Insults of everyday use, second-person words, signs that stand for letters.
INSULTS = frozenset("idiot idiots moron morons stupid scum trash loser losers pathetic disgusting worthless clown clowns dumb imbecile fool garbage hate kill ugly filthy vermin idiota imbécil estúpido basura asqueroso crétin débile stupide ordure minable dumm dummkopf abschaum ekelhaft wertlos".split())
SECOND = frozenset("you your yours yourself u ur tu te toi ton ta tes vous votre vos du dich dir dein deine sie ihr euch euer usted ustedes tú ti vosotros".split())
DISGUISE = str.maketrans("013457@$!|+", "oieastasilt")
EDGES = " \t\r\n.,;:!?\"'()[]{}<>|*%&#$~_-=+/\\«»¿¡…“”’"
INNER = re.compile(r"[.\-_*'’]")
N_FEATURES = 14
FOLDS = 5


@dataclass(frozen=True)
class ToxicityConfig:
    """``max_train`` bounds the labelled documents (by hash order of the id), ``max_lexicon`` the learned words."""

    max_train: int = 8000
    trees: int = 80
    depth: int = 3
    rate: float = 0.15
    bins: int = 32
    max_lexicon: int = 200
    min_docs: int = 4
    min_ratio: float = 6.0


def plain(word: str) -> tuple[str, bool]:
    """A lower-case word without edge signs and disguise; whether it was disguised."""
    bare = word.strip(EDGES)
    if bare.isalpha():
        return bare, False
    opened = INNER.sub("", word.translate(DISGUISE)).strip(EDGES)
    return (opened, True) if opened.isalpha() else (bare, False)


def features(text: str, learned: frozenset) -> list[float]:
    if not text:
        return [0.0] * N_FEATURES
    words = text.lower().split()
    n, chars = max(len(words), 1), len(text)
    tally = Counter(words)
    listed = found = hidden = distinct = second = odd = 0
    hits = set()
    for word, count in tally.items():
        if word.isalpha():
            base, disguised = word, False
        else:
            base, disguised = plain(word)
            odd += count * (not base.isalpha())
        if base in SECOND:
            second += count
        a, b = base in INSULTS, base in learned
        if a or b:
            listed, found, hidden, distinct = listed + a * count, found + b * count, hidden + disguised * count, distinct + 1
            hits.add(word)
    near = best = 0
    if hits:
        at = [i for i, w in enumerate(words) if w in hits]
        for i in at:
            near += any(w.strip(EDGES) in SECOND for w in words[max(0, i - 5) : i + 6])
        # densest run of 50 words
        left = 0
        for right, i in enumerate(at):
            while i - at[left] >= 50:
                left += 1
            best = max(best, right - left + 1)
    total = listed + found
    spelled = len(re.findall(r"\b(?:\w[ .\-*_]){3,}\w\b", text)) if hits else 0
    return [
        listed / n, found / n, np.log1p(listed), np.log1p(found), np.log1p(distinct), np.log1p(best), near / max(total, 1), np.log1p(near), second / n,
        sum(map(str.isupper, text)) / chars, (text.count("!") + text.count("?")) / chars, odd / n, hidden / max(total, 1) + spelled / n, np.log1p(n),
    ]


@dataclass
class BoostedTrees:
    """Histogram trees of fixed depth on the logistic loss; leaves are 2**depth values in heap order."""

    edges: list = field(default_factory=list)
    trees: list = field(default_factory=list)
    base: float = 0.0

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), int)

    def fit(self, x: np.ndarray, y: np.ndarray, config: ToxicityConfig) -> BoostedTrees:
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, config.bins)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
        # zero is the usual value of a density: give it a bin of its own
        self.edges = [np.unique(np.concatenate((e, [1e-12], np.quantile(c[c > 0], np.linspace(0, 1, 9)[1:-1]) if (c > 0).any() else []))) for e, c in zip(self.edges, x.T, strict=True)]
        share = np.clip(y.mean() if len(y) else 0.5, 0.01, 0.99)
        self.base, b, width = float(np.log(share / (1 - share))), self.binned(x), max(len(e) for e in self.edges) + 1
        margin = np.full(len(y), self.base)
        for _ in range(config.trees if len(y) else 0):
            p = sigmoid(margin)
            g, h, node, split = y - p, p * (1 - p) + 1e-6, np.zeros(len(y), int), []
            for level in range(config.depth):
                best = np.full(2**level, 1e-6), np.zeros(2**level, int), np.full(2**level, width)
                for j in range(b.shape[1]):
                    key = node * width + b[:, j]
                    gs = np.bincount(key, g, 2**level * width).reshape(-1, width).cumsum(1)
                    hs = np.bincount(key, h, 2**level * width).reshape(-1, width).cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + 1) + (gt - gs) ** 2 / (ht - hs + 1) - gt**2 / (ht + 1)
                    gain[(hs < 1) | (ht - hs < 1)] = 0
                    at = gain.argmax(1)
                    top = gain[np.arange(len(gain)), at]
                    better = top > best[0]
                    best[0][better], best[1][better], best[2][better] = top[better], j, at[better]
                split.append((best[1], best[2]))
                node = 2 * node + (b[np.arange(len(y)), best[1][node]] > best[2][node])
            leaf = config.rate * np.bincount(node, g, 2**config.depth) / (np.bincount(node, h, 2**config.depth) + 1)
            self.trees.append((split, leaf))
            margin += leaf[node]
        return self

    def margins(self, x: np.ndarray) -> np.ndarray:
        b, out, rows = self.binned(x), np.full(len(x), self.base), np.arange(len(x))
        for split, leaf in self.trees:
            node = np.zeros(len(x), int)
            for feature, cut in split:
                node = 2 * node + (b[rows, feature[node]] > cut[node])
            out += leaf[node]
        return out


def isotonic(score: np.ndarray, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pool-adjacent-violators fit: thresholds and non-decreasing values, a pseudo-count at either end."""
    order = np.argsort(score, kind="stable")
    blocks: list[list[float]] = []
    for s, y in zip(score[order], label[order], strict=True):
        blocks.append([s, s, float(y), 1.0])
        while len(blocks) > 1 and (blocks[-2][1] == blocks[-1][0] or blocks[-2][2] / blocks[-2][3] >= blocks[-1][2] / blocks[-1][3]):
            top = blocks.pop()
            blocks[-1] = [blocks[-1][0], top[1], blocks[-1][2] + top[2], blocks[-1][3] + top[3]]
    at = np.array([v for a in blocks for v in (a[0], a[1])])
    value = np.array([(a[2] + 0.02) / (a[3] + 0.04) for a in blocks for _ in (0, 1)])
    return at, np.maximum.accumulate(value) if len(value) else value


@dataclass
class ToxicityModel:
    learned: frozenset
    trees: BoostedTrees
    at: np.ndarray
    value: np.ndarray

    def scores(self, texts: list[str]) -> np.ndarray:
        x = np.array([features(t, self.learned) for t in texts]).reshape(-1, N_FEATURES)
        margin = self.trees.margins(x)
        return np.interp(margin, self.at, self.value) if len(self.at) else sigmoid(margin)


def learned_words(sample: DataFrame, text: str, config: ToxicityConfig) -> list[frozenset]:
    """For each fold the lexicon that the others show, and at last that of all: words in at least ``min_docs`` toxic texts whose share there is ``min_ratio`` times that elsewhere."""

    def tally(part, texts):
        counts: Counter = Counter()
        for t, y, k in zip(texts, part.column("label").to_pylist(), part.column("fold").to_pylist(), strict=True):
            counts.update((w, y, k) for w in {plain(w)[0] for w in set(t.lower().split())} if len(w) > 1)
        keys = list(counts)
        return record(word=[k[0] for k in keys], label=[int(k[1]) for k in keys], fold=[int(k[2]) for k in keys], n=[counts[k] for k in keys])

    words = over_texts(sample, text, tally, "word string, label long, fold long, n long")
    n = [(F.sum(F.when((F.col("label") == y) & (F.col("fold") == k), F.col("n")).otherwise(0)).alias(f"{'ba'[y]}{k}")) for y in (1, 0) for k in range(FOLDS)]
    toxic = sum(F.col(f"a{k}") for k in range(FOLDS))
    by_word = written(words.groupBy("word").agg(*n).filter(toxic >= config.min_docs))
    sizes = {(r["label"], r["fold"]): r["n"] for r in sample.groupBy("label", "fold").agg(F.count("*").alias("n")).collect()}
    out = []
    for left in range(FOLDS + 1):
        others = [k for k in range(FOLDS) if k != left]
        a, b = (sum(F.col(f"{c}{k}") for k in others) for c in "ab")
        bad, good = (max(sum(sizes.get((y, k), 0) for k in others), 1) for y in (1, 0))
        ratio = ((a + 0.5) / bad) / ((b + 0.5) / good)
        kept = by_word.filter((a >= config.min_docs) & (ratio >= config.min_ratio)).orderBy(F.desc(a * F.log(ratio)), "word").limit(config.max_lexicon)
        out.append(frozenset(r["word"] for r in kept.collect()))
    return out


def fit_toxicity(docs: DataFrame, labels: DataFrame, config: ToxicityConfig = ToxicityConfig(), doc_id="doc_id", text="text", label="toxic") -> ToxicityModel:
    """Fit on labelled rows whose crc32(id) mod 4 is not 2; calibrated on folds by hash of the id that chose none of what scores them."""
    sample = labelled_sample(docs, labels, doc_id, text, label, bucket_of(doc_id, 4) != 2, config.max_train)
    sample = written(sample.withColumn("fold", F.pmod(F.xxhash64(doc_id), F.lit(FOLDS))))
    lexicons = learned_words(sample, text, config)

    def featurise(part, texts):
        return record(id=part.column(doc_id).cast("string"), label=part.column("label"), fold=part.column("fold"), x=[np.array([features(t, words) for words in lexicons]).tobytes() for t in texts])

    rows = over_texts(sample, text, featurise, "id string, label int, fold long, x binary").toArrow().sort_by("id").to_pylist()
    x = np.array([np.frombuffer(r["x"]) for r in rows]).reshape(-1, FOLDS + 1, N_FEATURES)
    y, fold = np.array([r["label"] for r in rows], dtype=float), np.array([r["fold"] for r in rows], dtype=int)
    margin = np.zeros(len(y))
    for k in range(FOLDS if len(y) >= 10 else 0):
        margin[fold == k] = BoostedTrees().fit(x[fold != k, k], y[fold != k], config).margins(x[fold == k, k])
    at, value = isotonic(margin, y) if len(y) >= 10 else (np.zeros(0), np.zeros(0))
    return ToxicityModel(lexicons[-1], BoostedTrees().fit(x[:, -1], y, config), at, value)


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, config: ToxicityConfig = ToxicityConfig(), doc_id="doc_id", text="text") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``."""
    model = Shared(docs.sparkSession, fit_toxicity(docs, labels, config, doc_id, text))

    def score(part, texts):
        return record(doc_id=part.column(doc_id), score=model.value.scores(texts))

    scored = over_texts(docs.select(doc_id, text), text, score, f"doc_id {docs.schema[doc_id].dataType.simpleString()}, score double")
    return scored.select("doc_id", (bucket_of("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
