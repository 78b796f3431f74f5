"""Suffix-array dedup against a dictionary of all 50-byte strings."""

import hashlib
import random

import numpy as np
import pytest

from synodic.llm import suffixes
from synodic.llm.suffixes import SuffixConfig, dedup, segments

from .test_operators import SCHEMA, corpus


def expected(rows):
    """By (id, text) rows; rows with one id are one document."""
    first = {}
    for k, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - 49):
            if k is not None:
                first[b[i : i + 50]] = min(k, first.get(b[i : i + 50], k))
    out = []
    for k, t in rows:
        b = (t or "").encode()
        m = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if k is not None and first[b[i : i + 50]] < k:
                m[i : i + 50] = True
        out.append((k, len(b), int(m.sum()), int((np.diff(m.astype(int), prepend=0) == 1).sum()), hashlib.sha256(np.frombuffer(b, np.uint8)[~m].tobytes()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, config):
    docs = spark.createDataFrame([(k, t, "en", "s", 1, 0.5, "x") for k, t in rows], SCHEMA).repartition(3)
    return sorted((tuple(r) for r in dedup(docs, config).collect()), key=str)


def lines(seed=5, n=60):
    """Texts made of common lines, periodic stretches and lines that a text repeats."""
    rng = random.Random(seed)
    common = ["".join(rng.choice("abcd efgh") for _ in range(rng.randint(30, 120))) for _ in range(12)]
    out = []
    for _ in range(n):
        own = ["".join(rng.choice("ijkl mnop") for _ in range(rng.randint(5, 90))) for _ in range(3)]
        out.append("\n".join(rng.choice([*common, *own, "word " * rng.randint(8, 40), "-" * rng.randint(40, 130)]) for _ in range(rng.randint(1, 14))))
    return out


@pytest.mark.parametrize("config", [SuffixConfig(), SuffixConfig(crowd=2), SuffixConfig(crowd=3, buffer=40, bucket_bytes=200)])
def test_against_a_dictionary(spark, config):
    rows = list(enumerate([*corpus(40, 2), *lines(), "é" * 70, None, ""]))
    assert found(spark, rows, config) == expected(rows)


def test_rows_with_one_id_and_without(spark):
    texts = lines(9, 24)
    rows = [(None if k % 7 == 3 else k // 3, t) for k, t in enumerate([*texts, *texts[:10], texts[0], texts[0]])]
    for config in (SuffixConfig(), SuffixConfig(crowd=2, buffer=30)):
        assert found(spark, rows, config) == expected(rows)


def test_texts_longer_than_slices(spark):
    rng = random.Random(3)
    long = "".join(rng.choice("abcdefghij klmnop") for _ in range(400_000))
    rows = [(1, long), (2, "x" + long[70_000:330_000] + "y" * 100), (3, long[:100_000]), (4, "z" * 300_000), (5, "z" * 299_000 + long[-60:])]
    assert found(spark, rows, SuffixConfig()) == expected(rows)


def test_collisions_are_seen(monkeypatch):
    """Where all hashes are equal, the bytes decide what neighbours have in common."""
    monkeypatch.setattr(suffixes.HashedText, "same", lambda self, i, j, length: np.ones(len(i), bool))
    rng = np.random.default_rng(1)
    slots = rng.integers(97, 99, (40, 50)).astype(np.uint8)
    slots[7] = slots[8]
    order, common = segments(slots, np.zeros(40, np.int64))
    for a in range(1, 40):
        x, y = slots[order[a]], slots[order[a - 1]]
        assert common[a] == (50 if (x == y).all() else int((x == y).argmin()))
