"""Embedding near-dedup against all pairs."""

import numpy as np
import pytest

from synodic.llm.vectors import VectorConfig, keyed_vectors, near_vectors, one_round
from pyspark.sql import functions as F

from .test_operators import roots

SMALL = VectorConfig(block=16, stripe=8, sample=64)


def unit(x):
    return x / np.linalg.norm(x, axis=-1, keepdims=True)


def table(spark, x, kind="double"):
    return spark.createDataFrame([(k, None if v is None else [None if c is None else float(c) for c in v]) for k, v in enumerate(x)], f"vec_id long, embedding array<{kind}>")


def expected(x):
    linked = unit(x) @ unit(x).T >= 0.9
    np.fill_diagonal(linked, False)
    root = roots(len(x), np.argwhere(np.tril(linked)).tolist())
    return [(k, int(linked[k].sum()), root[k], root[k] == k) for k in range(len(x))]


def found(spark, x, config=VectorConfig(), kind="double"):
    return sorted(tuple(r) for r in near_vectors(table(spark, x, kind), config).collect())


@pytest.mark.parametrize("config", [VectorConfig(), SMALL])
def test_all_pairs(spark, config):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(20, 16))
    x = np.array([c + rng.normal(size=16) * s for c in centres for s in (0, 0, 0.1, 0.2, 0.3)])
    odd = [None, [0.0] * 16, [float("nan")] * 16, [1.0, None] * 8, [1.0]]
    got = found(spark, [*x.tolist(), *odd], config)
    assert got[:100] == expected(x) and got[100:] == [(k, 0, k, True) for k in range(100, 105)]


def test_crowd_of_near_copies(spark):
    """One component far larger than a block: copies close by, further off, and a chain that only just holds."""
    rng = np.random.default_rng(5)
    centre = unit(rng.normal(size=24))
    x = unit(centre + np.repeat([0.02, 0.05, 0.09, 0.11], 60)[:, None] * rng.normal(size=(240, 24)))
    x = np.concatenate((x, x[:5], unit(rng.normal(size=(40, 24)))))
    want = expected(x)
    got = found(spark, x, SMALL)
    assert sum(a == b for a, b in zip(got, want, strict=True)) >= 0.99 * len(want)
    assert [r[1] for r in got[:120]] == [r[1] for r in want[:120]]


def test_crowd_without_links(spark):
    """Links of a few pairs within a crowd of vectors that are all alike: rounds go on until the sample's links are found."""
    rng = np.random.default_rng(9)
    n, planted = 3000, 100
    centre = unit(rng.normal(size=64))
    x = unit(np.sqrt(0.8) * centre + np.sqrt(0.2) * unit(rng.normal(size=(n, 64))))
    x[-planted:] = unit(x[:planted] + 0.44 * unit(rng.normal(size=(planted, 64))))
    want, got = expected(x), found(spark, x)
    assert all(a[1] <= b[1] for a, b in zip(got, want, strict=True))
    assert sum(r[1] for r in got) >= 0.97 * sum(r[1] for r in want)


@pytest.mark.parametrize("n", [2000, 8000, 20000])
def test_recall_just_above_the_threshold(spark, n):
    """Scattered single-precision vectors with pairs at cosines from 0.90 to 0.92."""
    rng = np.random.default_rng(n)
    x = unit(rng.normal(size=(n, 64)))
    k = n // 20
    side = rng.normal(size=(k, 64))
    side = unit(side - (side * x[:k]).sum(1, keepdims=True) * x[:k])
    cosine = rng.uniform(0.9, 0.92, size=(k, 1))
    x[-k:] = cosine * x[:k] + np.sqrt(1 - cosine**2) * side
    x = x.astype(np.float32)
    linked = (unit(x[:k].astype(float)) * unit(x[-k:].astype(float))).sum(1) >= 0.9
    got = found(spark, x, kind="float")
    hit = [got[n - k + i][2] == i for i in np.flatnonzero(linked)]
    assert np.mean(hit) >= 0.97 and sum(r[1] for r in got) <= 2 * linked.sum() + 4


def test_easy_links_do_not_end_the_rounds(spark):
    """The sample holds thousands of links of a tight clump; pairs just above the threshold elsewhere are found all the same."""
    rng = np.random.default_rng(12)
    n, clump, k = 8000, 200, 300
    x = unit(rng.normal(size=(n, 64)))
    x[:clump] = unit(x[0] + 0.01 * rng.normal(size=(clump, 64)))
    own = x[clump : clump + k]
    side = rng.normal(size=(k, 64))
    side = unit(side - (side * own).sum(1, keepdims=True) * own)
    cosine = rng.uniform(0.9005, 0.905, size=(k, 1))
    x[-k:] = cosine * own + np.sqrt(1 - cosine**2) * side
    got = found(spark, x)
    assert sum(got[n - k + i][2] != clump + i for i in range(k)) <= 3


def test_same_pairs_however_dealt(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(150, 12))
    x = np.concatenate([centres, centres + 0.2 * rng.normal(size=centres.shape), rng.normal(size=(500, 12))])
    classes = keyed_vectors(table(spark, x), "vec_id", "embedding").select(F.col("vec_id").alias("id"), "v").cache()
    before, out = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in ("1", "2", "50"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
            out.append(sorted(tuple(r) for r in one_round(classes, range(4), 5, VectorConfig(), "<f8").collect()))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(out[0]) > 50 and out[0] == out[1] == out[2]


def test_repeated_and_missing_ids(spark):
    a, b, c = [1.0, 0.0], [0.0, 1.0], [1.0, 0.01]
    rows = [(1, a), (1, b), (2, c), (None, a), (3, None), (None, None), (4, b)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert sorted((tuple(r) for r in got), key=str) == sorted([(1, 1, 1, True), (1, 1, 1, True), (2, 1, 1, False), (None, 0, None, False), (3, 0, 3, True), (None, 0, None, False), (4, 1, 1, False)], key=str)


def test_empty_table(spark):
    assert near_vectors(table(spark, []).limit(0)).count() == 0
