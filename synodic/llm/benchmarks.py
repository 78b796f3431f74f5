"""Benchmark decontamination: BM25 over test items with block-max WAND, then overlap of question and answer.

Every passage of every document is a query against the inverted index of the test items. Items longer
than a passage are indexed as parts of about equal length that a passage can hold, and an item is
retrieved with any of its parts. Postings lie in blocks with their largest score: the upper level of
blocks, of ``range`` neighbouring items, tells for all passages of a slice at once which of them could
reach the threshold anywhere, without a posting being read; the others are passed over. For those the
search goes through the lists, item at a time: the pivot follows from the lists' largest scores, blocks
of the lists that cannot reach the threshold are skipped, and scores are summed only where both bounds
allow it. All items at or above the threshold are verified: enough of the question's, and of the
answer's, five-word shingles stand in the document. The answer is an item's last sentence if it has
several, else its last third.

The index has a bound: ``max_index_words`` postings are broadcast at once, longer benchmarks go in
as many rounds as they need; document frequencies and the mean length are those of all rounds. Null and
empty texts and items match nothing; items with fewer than five words are one shingle of that many;
texts may be of any length; repeated rows are judged each, whatever their id; ties in the score are all
retrieved; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Shared, IS_SPACE, over_texts, record, splitmix, words_of

SHINGLE = 5


@dataclass(frozen=True)
class DecontaminationConfig:
    """Passages of ``window`` words, each ``stride`` after the last; scores are shares of an item's (of a longer item, a part's) score against itself, ``share`` is the threshold."""

    window: int = 64
    stride: int = 32
    k1: float = 1.2
    b: float = 0.75
    share: float = 0.5
    question: float = 0.6
    answer: float = 0.6
    block: int = 16
    range: int = 2
    max_index_words: int = 2_000_000


def shingles(words: np.ndarray, size: int = SHINGLE) -> np.ndarray:
    """Hashes of all runs of ``size`` words."""
    if len(words) < size or not size:
        return np.empty(0, dtype=np.uint64)
    h = np.full(len(words) - size + 1, size, dtype=np.uint64)
    for k in range(size):
        h = splitmix(h ^ words[k : len(words) - size + 1 + k]) + np.uint64(k + 1)
    return h


def question_and_answer(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of an item's question and answer; either takes words of the other up to five, if there are so many."""
    parts = [n for n in (len(plain([p])[0]) for p in re.split(r"(?<=[.?!])\s+|\n+", text)) if n]
    words = plain([text])[0]
    cut = sum(parts[:-1]) if len(parts) > 1 else len(words) - len(words) // 3
    return words[: max(cut, SHINGLE)], words[min(cut, max(0, len(words) - SHINGLE)) :]


def parts_of(words: np.ndarray, window: int) -> list[np.ndarray]:
    """An item's words in as few parts of about equal length as hold ``window`` words at most."""
    return np.array_split(words, -(-len(words) // window))


SEPARATES = IS_SPACE.copy()
SEPARATES[[b for b in range(33, 127) if not chr(b).isalnum()]] = True


def plain(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of letters, digits and signs beyond ASCII, and the number in each text."""
    return words_of(texts, between=SEPARATES)


@dataclass
class ItemStats:
    """Of all items: number of parts, their mean length, and the terms with the number of parts that hold each."""

    parts: int
    mean: float
    terms: np.ndarray
    holding: np.ndarray

    def of(self, term: int) -> int:
        return int(self.holding[np.searchsorted(self.terms, np.uint64(term))])


def item_stats(rows: DataFrame, item_text: str, config: DecontaminationConfig) -> ItemStats:
    """By one pass over the items; the driver takes a row for each distinct term."""

    def count(part, texts):
        terms, n, parts, total = [], [], 0, 0
        for t in texts:
            words = plain([t])[0]
            if len(words):
                for piece in parts_of(words, config.window):
                    terms.append(np.unique(piece))
                    parts, total = parts + 1, total + len(piece)
        if not parts:
            return None
        terms, n = np.unique(np.concatenate(terms), return_counts=True)
        kind = np.concatenate((np.zeros(len(terms), np.int32), np.array([1, 2], np.int32)))
        return record(kind=kind, term=np.concatenate((terms.view(np.int64), [0, 0])), n=np.concatenate((n, [parts, total])).astype(np.int64))

    got = over_texts(rows, item_text, count, "kind int, term long, n long").groupBy("kind", "term").agg(F.sum("n").alias("n")).toArrow()
    kind, term, n = (got.column(k).to_numpy() for k in ("kind", "term", "n"))
    parts, total = int(n[kind == 1].sum()), int(n[kind == 2].sum())
    terms = np.ascontiguousarray(term[kind == 0]).view(np.uint64)
    by = np.argsort(terms)
    return ItemStats(parts, total / max(parts, 1), terms[by], n[kind == 0][by])


@dataclass
class ItemIndex:
    """Postings by term: parts of items, scores (as shares of the part's score against itself), and the largest score of each block of postings."""

    ids: list
    owner: np.ndarray
    terms: np.ndarray
    items: list[np.ndarray]
    scores: list[np.ndarray]
    blocks: list[np.ndarray]
    most: np.ndarray
    best: np.ndarray
    question: list[np.ndarray]
    answer: list[np.ndarray]
    sizes: list[int]
    block: int
    range: int
    common: np.ndarray
    common_most: float

    def __post_init__(self):
        """The upper level: for each term the ranges of items that hold it, each with the term's largest score there."""
        ranges, most = [], []
        for i, s in zip(self.items, self.scores, strict=True):
            at, first = np.unique(i // self.range, return_index=True)
            ranges.append(at)
            most.append(np.maximum.reduceat(s, first))
        self.n_ranges = -(-len(self.best) // self.range)
        self.lengths = np.array([len(r) for r in ranges], dtype=np.int64)
        self.offsets = np.cumsum(self.lengths) - self.lengths
        self.ranges = np.concatenate([*ranges, np.zeros(0, np.int64)]).astype(np.int64)
        self.range_most = np.concatenate([*most, np.zeros(0)])

    @classmethod
    def build(cls, rows: list[tuple[object, str]], config: DecontaminationConfig, stats: ItemStats | None = None) -> ItemIndex:
        """The index of ``rows``; ``stats`` where these are not all items."""
        rows = [(i, t) for i, t in rows if t and len(plain([t])[0])]
        whole = [plain([t])[0] for _, t in rows]
        cut = [parts_of(w, config.window) for w in whole]
        owner = np.repeat(np.arange(len(rows)), [len(c) for c in cut]).astype(np.int64)
        words = [w for c in cut for w in c]
        mean = stats.mean if stats else np.mean([len(w) for w in words]) if words else 1.0
        n = stats.parts if stats else len(words)
        by_term: dict[int, list[tuple[int, float]]] = {}
        for k, w in enumerate(words):
            for term, tf in zip(*np.unique(w, return_counts=True), strict=True):
                by_term.setdefault(int(term), []).append((k, tf * (config.k1 + 1) / (tf + config.k1 * (1 - config.b + config.b * len(w) / mean))))
        terms = np.array(sorted(by_term), dtype=np.uint64)
        items, scores, blocks = [], [], []
        best = np.zeros(len(words))
        for term in terms:
            post = by_term[int(term)]
            df = stats.of(int(term)) if stats else len(post)
            idf = np.log(1 + (n - df + 0.5) / (df + 0.5))
            items.append(np.array([k for k, _ in post]))
            scores.append(np.array([s for _, s in post]) * idf)
            best[items[-1]] += scores[-1]
        scores = [s / best[i] for s, i in zip(scores, items, strict=True)]
        blocks = [np.maximum.reduceat(s, np.arange(0, len(s), config.block)) for s in scores]
        halves = [question_and_answer(t) for _, t in rows]
        question, answer = ([np.unique(shingles(h[k], min(SHINGLE, len(w)))) for h, w in zip(halves, whole, strict=True)] for k in (0, 1))
        most = np.array([b.max() for b in blocks]) if blocks else np.zeros(0)
        # terms of most items, as long as they weigh less than half of the threshold in every item
        common, weighs = np.zeros(len(terms), dtype=bool), np.zeros(len(words))
        for t in sorted(range(len(terms)), key=lambda t: (-len(items[t]), t)):
            more = weighs.copy()
            more[items[t]] += scores[t]
            if more.max() > config.share / 2:
                break
            weighs, common[t] = more, True
        return cls([i for i, _ in rows], owner, terms, items, scores, blocks, most, best, question, answer, [min(SHINGLE, len(w)) for w in whole], config.block, config.range, common, float(weighs.max()) if len(words) else 0.0)

    def wand(self, terms: list[int], threshold: float) -> list[tuple[int, float]]:
        """All parts whose summed score over the terms reaches the threshold, by block-max WAND."""
        cursors = [[0, t] for t in terms]
        out = []
        while True:
            live = [c for c in cursors if c[0] < len(self.items[c[1]])]
            live.sort(key=lambda c: self.items[c[1]][c[0]])
            bound, pivot = 0.0, -1
            for k, (_, t) in enumerate(live):
                bound += self.most[t]
                if bound >= threshold:
                    pivot = k
                    break
            if pivot < 0:
                return out
            item = int(self.items[live[pivot][1]][live[pivot][0]])
            while pivot + 1 < len(live) and self.items[live[pivot + 1][1]][live[pivot + 1][0]] == item:
                pivot += 1
            # the blocks that would hold the pivot item bound it closer
            close, past = 0.0, len(self.best)
            for at, t in live[: pivot + 1]:
                place = min(int(np.searchsorted(self.items[t], item)), len(self.items[t]) - 1)
                k = max(place, at) // self.block
                close += self.blocks[t][k]
                past = min(past, int(self.items[t][min((k + 1) * self.block, len(self.items[t])) - 1]) + 1)
            if pivot + 1 < len(live):
                past = min(past, int(self.items[live[pivot + 1][1]][live[pivot + 1][0]]))
            if close < threshold:
                target = max(past, item + 1)
            elif self.items[live[0][1]][live[0][0]] == item:
                total = sum(float(self.scores[t][at]) for at, t in live[: pivot + 1])
                if total >= threshold:
                    out.append((item, total))
                target = item + 1
            else:
                target = item
            for c in live[: pivot + 1]:
                c[0] = max(c[0], int(np.searchsorted(self.items[c[1]], target)))

    def passages(self, words: np.ndarray, counts: np.ndarray, config: DecontaminationConfig) -> dict[tuple[int, int], float]:
        """(document, item) of the retrieved items with the best score of a passage; documents lie one after the other.

        Terms of most items together weigh ``common_most`` at most. A passage goes to the search only
        if in some range of items the largest scores of its other terms could make up for the rest.
        """
        if not len(words) or not len(self.terms):
            return {}
        place = np.minimum(np.searchsorted(self.terms, words), len(self.terms) - 1)
        known = self.terms[place] == words
        at = np.flatnonzero(known)
        term = place[at]
        firsts = np.cumsum(counts) - counts
        blocks_of = -(-counts // config.stride)
        first_block = np.cumsum(blocks_of) - blocks_of
        doc_of_word = np.repeat(np.arange(len(counts)), counts)
        block = first_block[doc_of_word] + (np.arange(len(words)) - firsts[doc_of_word]) // config.stride
        rare = ~self.common[term]
        # each block of words and term once, then a row for each range of items
        key = np.unique(block[at[rare]] * len(self.terms) + term[rare])
        term_of, block_of = key % len(self.terms), key // len(self.terms)
        n = self.lengths[term_of]
        flat = np.repeat(self.offsets[term_of] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        place, weight, block_of = self.ranges[flat], self.range_most[flat], np.repeat(block_of, n)
        doc_of_block = np.repeat(np.arange(len(counts)), blocks_of)
        keys, weights = [], []
        for back in range(max(1, config.window // config.stride)):
            start = block_of - back
            ok = start >= first_block[doc_of_block[block_of]]
            keys.append(start[ok] * self.n_ranges + place[ok])
            weights.append(weight[ok])
        key, back = np.unique(np.concatenate(keys), return_inverse=True)
        sums = np.bincount(back, np.concatenate(weights), minlength=len(key))
        key, sums = key[(reach := sums >= config.share - self.common_most)], sums[reach]
        if not len(key):
            return {}
        windows, cuts = np.unique(key // self.n_ranges, return_index=True)
        best = np.maximum.reduceat(sums, cuts)
        out: dict[tuple[int, int], float] = {}
        for w, bound in zip(windows.tolist(), best.tolist(), strict=True):
            doc = int(doc_of_block[w])
            start = firsts[doc] + (w - first_block[doc]) * config.stride
            a, b = np.searchsorted(at, [start, min(start + config.window, firsts[doc] + counts[doc])])
            own = np.unique(term[a:b])
            # with the common terms that the passage has, no longer with all
            if bound + self.most[own[self.common[own]]].sum() < config.share:
                continue
            for part, score in self.wand(own.tolist(), config.share):
                found = int(self.owner[part])
                out[doc, found] = max(score, out.get((doc, found), 0.0))
        return out


def overlap(part: np.ndarray, whole: np.ndarray) -> float:
    """Share of one sorted set of hashes in another; an empty part is wholly in it."""
    if not len(part):
        return 1.0
    if not len(whole):
        return 0.0
    at = np.minimum(np.searchsorted(whole, part), len(whole) - 1)
    return float((whole[at] == part).mean())


def contaminated(docs: DataFrame, items: DataFrame, config: DecontaminationConfig = DecontaminationConfig(), doc_id="doc_id", text="text", item_id="item_id", item_text="text") -> DataFrame:
    """doc_id, item_id, score, question, answer (shares found) of all verified pairs; one row a document row and item."""
    kinds = f"doc_id {docs.schema[doc_id].dataType.simpleString()}, item_id {items.schema[item_id].dataType.simpleString()}, score double, question double, answer double"
    out = None
    for index in indexes(items, config, item_id, item_text):
        found = searched(docs.select(doc_id, text), index, config, doc_id, text, kinds)
        out = found if out is None else out.unionByName(found)
    return out


def indexes(items: DataFrame, config: DecontaminationConfig, item_id: str, item_text: str) -> Iterator[ItemIndex]:
    """The index of each round, one at least."""
    rows = items.filter(F.col(item_text).isNotNull()).select(item_id, item_text)
    total = rows.agg(F.sum(F.size(F.split(item_text, r"\s+"))).alias("n")).first()["n"] or 0
    rounds = max(1, -(-total // config.max_index_words))
    stats = item_stats(rows, item_text, config) if rounds > 1 else None
    for k in range(rounds):
        some = rows if rounds == 1 else rows.filter(F.pmod(F.xxhash64(item_id, item_text), F.lit(rounds)) == k)
        yield ItemIndex.build(sorted(((r[0], r[1]) for r in some.collect()), key=str), config, stats)


def verified(texts: list[str], index: ItemIndex, config: DecontaminationConfig) -> list[tuple[int, int, float, float, float]]:
    """(place of the text, item, score, question, answer) of retrieved items that stand in the text."""
    words, counts = plain(texts)
    cuts = np.concatenate(([0], np.cumsum(counts)))
    out, whole = [], {}
    for (k, item), score in sorted(index.passages(words, counts, config).items()):
        size = index.sizes[item]
        if (k, size) not in whole:
            whole = {(k, size): np.unique(shingles(words[cuts[k] : cuts[k + 1]], size))}
        q, a = overlap(index.question[item], whole[k, size]), overlap(index.answer[item], whole[k, size])
        if q >= config.question and a >= config.answer:
            out.append((k, item, score, q, a))
    return out


def searched(docs: DataFrame, index: ItemIndex, config: DecontaminationConfig, doc_id: str, text: str, kinds: str) -> DataFrame:
    shared = Shared(docs.sparkSession, index)

    def rows(part, texts):
        found = verified(texts, shared.value, config)
        if not found:
            return None
        at, items, score, q, a = zip(*found, strict=True)
        return record(doc_id=part.column(doc_id).take(pa.array(at)), item_id=[shared.value.ids[k] for k in items], score=score, question=q, answer=a)

    return over_texts(docs, text, rows, kinds)


def decontaminate(docs: DataFrame, items: DataFrame, config: DecontaminationConfig = DecontaminationConfig(), text="text", item_id="item_id", item_text="text") -> DataFrame:
    """The rows of ``docs`` that hold no test item, each row judged by its own text whatever its id."""
    for index in indexes(items, config, item_id, item_text):
        docs = clean(docs, index, config, text)
    return docs


def clean(docs: DataFrame, index: ItemIndex, config: DecontaminationConfig, text: str) -> DataFrame:
    shared = Shared(docs.sparkSession, index)

    def rows(part, texts):
        keep = np.ones(len(texts), dtype=bool)
        keep[[k for k, *_ in verified(texts, shared.value, config)]] = False
        return part.filter(pa.array(keep))

    return over_texts(docs, text, rows, docs.schema)
