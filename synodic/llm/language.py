"""Language ID: interpolated Kneser-Ney character models, kept in sorted hash arrays.

The text is lower-cased, every run of other signs than letters becomes one space. The language with
the lowest cross-entropy per sign is chosen; a document is rejected if its cross-entropy lies far
beyond what all but the last hundredth of a calibration sample of that language shows, or beyond
that of signs drawn evenly from the languages' letters. Null texts and texts without letters are ``und``,
score 0, rejected; ties go to the first language by name; texts may be of any length; repeated rows are
judged each, whatever their id.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, bucket_of, over_texts, record, splitmix

FACTOR = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class LanguageConfig:
    """``per_language`` sizes the sample of each language that the models are fitted on (a share by hash of the id), and as many again for calibration.

    ``max_languages`` bounds the languages that are learned, those with most documents (the first by name among equal ones).
    """

    order: int = 4
    per_language: int = 300
    discount: float = 0.75
    slack: float = 4.0
    max_languages: int = 200


def letter_table() -> np.ndarray:
    """Of each code point below 2**16: itself as a letter, or the space."""
    return np.array([c if chr(c).isalpha() else 32 for c in range(0x10000)], dtype=np.uint32)


def signs(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs of all texts in order, and how many each text has."""
    joined = "\n" + "\n".join(t.lower().replace("\n", " ") for t in texts)
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    mark = points == 10
    code = table[np.minimum(points, 0xFFFF)]
    if (far := points > 0xFFFF).any():
        kinds, back = np.unique(points[far], return_inverse=True)
        code[far] = np.array([c if chr(c).isalpha() else 32 for c in kinds], dtype=np.uint32)[back]
    text, code = (np.cumsum(mark) - 1)[~mark], code[~mark]
    keep = np.ones(len(code), dtype=bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (text[1:] != text[:-1])
    return code[keep], np.bincount(text[keep], minlength=len(texts))


def padded(code: np.ndarray, counts: np.ndarray, pad: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text with ``pad`` spaces before it."""
    if not len(counts):
        return code, counts
    starts = np.concatenate(([0], np.cumsum(counts)[:-1]))
    return np.insert(code, np.repeat(starts, pad), np.uint32(32)), counts + pad


def gram_hashes(code: np.ndarray, order: int, ends: np.ndarray | None = None) -> np.ndarray:
    """Hash of the ``order`` signs that end at each place (or at ``ends``); places before order-1 are void."""
    n = len(code)
    h = np.zeros(n if ends is None else len(ends), dtype=np.uint64)
    for back in range(order - 1, -1, -1):
        if ends is None:
            h *= FACTOR
            h[back:] += code[: n - back] + np.uint64(1)
        else:
            h = h * FACTOR + code[ends - back] + np.uint64(1)
    return splitmix(h + np.uint64(order))


def hash_of(gram: str) -> int:
    return int(gram_hashes(np.array([ord(c) for c in gram], dtype=np.uint32), len(gram))[-1])


@dataclass
class LanguageModels:
    """probs[n]: sorted hashes and log-probabilities by language; backs[n]: the same of contexts of n signs."""

    names: list
    order: int
    probs: dict
    backs: dict
    floor: np.ndarray
    mean: np.ndarray
    spread: np.ndarray
    most: float = np.inf

    def logs(self, code: np.ndarray) -> np.ndarray:
        n = len(code)
        out = np.zeros((n, len(self.names)), dtype=np.float32)
        open_ = np.arange(n)
        for order in range(self.order, 0, -1):
            keys, values = self.probs[order]
            h = gram_hashes(code, order, None if len(open_) == n else open_)
            at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
            hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
            out[open_[hit]] += values[at[hit]]
            open_ = open_[~hit]
            if not len(open_):
                return out
            if order > 1:
                keys, values = self.backs[order - 1]
                h = gram_hashes(code, order - 1, open_ - 1)
                at = np.minimum(np.searchsorted(keys, h), max(len(keys) - 1, 0))
                hit = keys[at] == h if len(keys) else np.zeros(len(h), bool)
                out[open_[hit]] += values[at[hit]]
        out[open_] += self.floor
        return out

    def entropies(self, texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nats per sign by text and language, and the number of letters."""
        code, counts = signs(texts, table)
        pad = max(self.order - 1, 1)
        code, counts = padded(code, counts, pad)
        logs = self.logs(code)
        starts = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(int)
        body = np.ones(len(code), dtype=bool)
        for k in range(pad):
            body[starts + k] = False
        logs[~body] = 0
        total = -np.add.reduceat(logs, starts, dtype=np.float64) if len(starts) else np.zeros((0, len(self.names)))
        letters = np.add.reduceat((code != 32).astype(np.int64), starts) if len(starts) else np.zeros(0, int)
        return total / np.maximum(counts - pad, 1)[:, None], letters

    def predict(self, texts: list[str], table: np.ndarray, slack: float) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
        """Language, score, whether rejected, cross-entropy."""
        if not self.names:
            return ["und"] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool), np.zeros(len(texts))
        ce, letters = self.entropies(texts, table)
        best = ce.argmin(1)
        low = ce[np.arange(len(ce)), best]
        score = 1 / np.exp(-np.minimum(letters, 60)[:, None] * (ce - low[:, None])).sum(1)
        limit = self.mean[best] + slack * self.spread[best] / np.sqrt(np.minimum(np.maximum(letters, 1), 400))
        limit = np.minimum(limit, self.most)
        some = letters > 0
        return [self.names[b] if ok else "und" for b, ok in zip(best, some, strict=True)], np.where(some, score, 0.0), ~some | (low > limit), low


def kneser_ney(counts: dict[str, Counter], order: int, discount: float) -> LanguageModels:
    """The models from counts of grams of the highest order; lower orders count left neighbours."""
    names = sorted(counts)
    levels: dict[str, dict[int, Counter]] = {}
    for name in names:
        by = {order: counts[name]}
        for n in range(order - 1, 0, -1):
            by[n] = Counter(g[1:] for g in by[n + 1])
        levels[name] = by
    alphabet = max(len({g for name in names for g in levels[name][1]}), 1) + 1
    floor = np.full(len(names), -np.log(alphabet), dtype=np.float32)
    lower: dict[str, np.ndarray] = {}
    probs, backs = {}, {}
    for n in range(1, order + 1):
        totals = [defaultdict(float) for _ in names]
        kinds = [defaultdict(float) for _ in names]
        for i, name in enumerate(names):
            for g, c in levels[name][n].items():
                totals[i][g[:-1]] += c
                kinds[i][g[:-1]] += 1
        grams = sorted({g for name in names for g in levels[name][n]})
        table = {}
        for g in grams:
            below = lower[g[1:]] if n > 1 else np.full(len(names), 1 / alphabet)
            row = below.copy()
            for i, name in enumerate(names):
                if total := totals[i].get(g[:-1]):
                    row[i] = max(levels[name][n].get(g, 0) - discount, 0) / total + discount * kinds[i][g[:-1]] / total * below[i]
            table[g] = row
        lower = table

        def packed(rows: dict) -> tuple[np.ndarray, np.ndarray]:
            keys = np.array([hash_of(g) for g in rows], dtype=np.uint64)
            values = np.log(np.array(list(rows.values())).reshape(len(rows), len(names)) + 1e-300).astype(np.float32)
            by = np.argsort(keys)
            return keys[by], values[by]

        probs[n] = packed(table)
        contexts = sorted({c for t in totals for c in t}) if n > 1 else []
        if n > 1:
            backs[n - 1] = packed({c: np.array([discount * kinds[i][c] / totals[i][c] if totals[i].get(c) else 1.0 for i in range(len(names))]) for c in contexts})
        else:
            floor = np.array([np.log(discount * kinds[i][""] / totals[i][""] / alphabet) if totals[i].get("") else -np.log(alphabet) for i in range(len(names))], dtype=np.float32)
    return LanguageModels(names, order, probs, backs, floor, np.zeros(len(names)), np.ones(len(names)))


def even_entropy(counts: dict[str, Counter], share: float = 0.999) -> float:
    """Nats per sign of even draws from the signs that make up ``share`` of each language's, so that a stray row adds none."""
    kept = set()
    for grams in counts.values():
        signs_of = Counter()
        for g, c in grams.items():
            signs_of[g[-1]] += c
        seen, total = 0, sum(signs_of.values())
        for sign, c in signs_of.most_common():
            if seen >= share * total:
                break
            kept.add(sign)
            seen += c
    return float(np.log(len(kept) + 1))


def fit_language(docs: DataFrame, config: LanguageConfig = LanguageConfig(), doc_id="doc_id", text="text", lang="lang", allowed=None) -> LanguageModels:
    """Learn from text and non-null lang where ``allowed`` (default: crc32(id) mod 3 is not 1) holds.

    The sample is a share of each language by hash of the id, sized for twice ``per_language``
    documents: one half fits the models, the other calibrates the rejection.
    """
    allowed = bucket_of(doc_id, 3) != 1 if allowed is None else allowed
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & F.col(doc_id).isNotNull() & allowed).select(doc_id, text, lang, F.xxhash64(doc_id).alias("h"))
    sizes = known.groupBy(lang).agg(F.count("*").alias("n")).orderBy(F.desc("n"), lang).limit(config.max_languages).collect()
    if not sizes:
        return LanguageModels([], config.order, {}, {}, np.zeros(0), np.zeros(0), np.zeros(0))
    shares = docs.sparkSession.createDataFrame([(r[0], min(1.0, 2 * config.per_language / r[1])) for r in sizes], f"`{lang}` string, share double")
    sample = known.join(F.broadcast(shares), lang).filter(F.pmod("h", F.lit(1 << 20)) < F.col("share") * (1 << 20)).select(doc_id, text, lang, F.pmod(F.shiftright("h", 21), F.lit(2)).alias("side"))
    order = config.order

    def tally(part, texts):
        table, counts = letter_table(), Counter()
        for t, name, side in zip(texts, part.column(lang).to_pylist(), part.column("side").to_pylist(), strict=True):
            if side == 0:
                continue
            code, n = signs([t], table)
            s = "".join(map(chr, padded(code, n, max(order - 1, 1))[0]))
            counts.update((name, s[i : i + order]) for i in range(len(s) - order + 1))
        keys = list(counts)
        return record(lang=[k[0] for k in keys], gram=[k[1] for k in keys], n=[counts[k] for k in keys]) if keys else None

    counts: dict[str, Counter] = defaultdict(Counter)
    for r in over_texts(sample, text, tally, "lang string, gram string, n long", 1 << 22).groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow().to_pylist():
        counts[r["lang"]][r["gram"]] = r["n"]
    models = kneser_ney(counts, order, config.discount)
    if not models.names:
        return models
    shared = Shared(docs.sparkSession, models)

    def measure(part, texts):
        ce, letters = shared.value.entropies(texts, letter_table())
        names = part.column(lang).to_pylist()
        own = [shared.value.names.index(x) if x in shared.value.names else -1 for x in names]
        ok = [k for k, (o, s, n) in enumerate(zip(own, part.column("side").to_pylist(), letters, strict=True)) if o >= 0 and s == 0 and n > 0]
        return record(own=np.array([own[k] for k in ok], dtype=np.int64), ce=np.array([ce[k, own[k]] for k in ok], dtype=float), n=np.array([letters[k] for k in ok], dtype=np.int64))

    seen = over_texts(sample, text, measure, "own long, ce double, n long").toPandas()
    for i in range(len(models.names)):
        part = seen[seen.own == i]
        # stray rows do not move the median
        mean = float(np.median(part.ce)) if len(part) else 3.0
        over = (part.ce - mean) * np.sqrt(np.minimum(part.n, 400)) if len(part) else np.array([4.0])
        # beyond the last hundredth, one document at least, so that a stray row moves nothing; never less than a quarter of a nat over 400 signs
        models.mean[i], models.spread[i] = mean, max(float(np.quantile(over, 0.99, method="lower")), 5.0)
    models.most = even_entropy(counts)
    return models


def detect(docs: DataFrame, models: LanguageModels, config: LanguageConfig = LanguageConfig(), text="text") -> DataFrame:
    """All columns of ``docs`` and lang_pred, score, rejected, cross_entropy; an error if ``docs`` has such a column already."""
    shared, slack = Shared(docs.sparkSession, models), config.slack
    if taken := {c.lower() for c in docs.columns} & {"lang_pred", "score", "rejected", "cross_entropy"}:
        raise ValueError(f"rename these columns first: {sorted(taken)}")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema) + ", lang_pred string, score double, rejected boolean, cross_entropy double"
    tables: list = []

    def judge(part, texts):
        if not tables:
            tables.append(letter_table())
        names, score, rejected, ce = shared.value.predict(texts, tables[0], slack)
        return record(**dict(zip(part.schema.names, part.columns, strict=True)), lang_pred=names, score=score, rejected=rejected, cross_entropy=ce.astype(float))

    return over_texts(docs, text, judge, schema)


def known_language(docs: DataFrame, models: LanguageModels, config: LanguageConfig = LanguageConfig(), text="text") -> DataFrame:
    """The rows of ``docs`` that are not rejected, with their columns as they are."""
    shared, slack, tables = Shared(docs.sparkSession, models), config.slack, []

    def judge(part, texts):
        if not tables:
            tables.append(letter_table())
        return part.filter(pa.array(~shared.value.predict(texts, tables[0], slack)[2]))

    return over_texts(docs, text, judge, docs.schema)


def language(docs: DataFrame, config: LanguageConfig = LanguageConfig()) -> DataFrame:
    """doc_id, held_out, lang_pred, score, rejected for every row of ``docs``."""
    found = detect(docs.select("doc_id", "text"), fit_language(docs, config), config)
    return found.select("doc_id", (bucket_of("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score", "rejected")
