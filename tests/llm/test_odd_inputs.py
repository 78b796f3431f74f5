"""Empty tables, missing ids, ids that are texts, very long texts, clashing columns: each has a defined result."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from synodic.llm.benchmarks import contaminated, decontaminate
from synodic.llm.common import dropped, scratch_dir, written
from synodic.llm.jaccard import drop_near_copies, jaccard_join
from synodic.llm.language import fit_language, known_language, language
from synodic.llm.licenses import find_licenses
from synodic.llm.pieces import encode_table
from synodic.llm.quality import quality
from synodic.llm.secrets import find_secrets, redact
from synodic.llm.suffixes import dedup
from synodic.llm.toxicity import toxicity

from .test_operators import SCHEMA, corpus, docs_of

ITEMS = "item_id long, text string"


def labels_of(spark, n):
    return spark.createDataFrame([(k, k % 2, int(k % 5 == 0)) for k in range(n)], "doc_id long, quality int, toxic int")


def test_empty_tables_of_all(spark):
    none = docs_of(spark, ["x"]).limit(0)
    items = spark.createDataFrame([(1, "a test item of some words in a row")], ITEMS)
    outs = [contaminated(none, items), decontaminate(none, items), drop_near_copies(none), known_language(none, fit_language(none)), redact(none), dedup(none), find_licenses(none), encode_table(none), find_secrets(none)]
    assert all(out.count() == 0 for out in outs)
    docs = docs_of(spark, ["some words", None])
    assert contaminated(docs, items.limit(0)).count() == 0 and quality(docs, labels_of(spark, 0)).count() == 2 and toxicity(docs, labels_of(spark, 0)).count() == 2


def test_very_long_texts(spark):
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefghij") for _ in range(6)) for _ in range(2000)]
    long = " ".join(rng.choices(words, k=60_000))  # 400 kB, several slices
    secret = "password = hunter2hunter"
    texts = [long + " " + secret + " all rights reserved", long, "x" * 300_000, long[:-40], None]
    docs = docs_of(spark, texts)
    found = {r.doc_id: r for r in find_secrets(docs).collect()}
    assert found[0].spans == f"assign:{len(long) + 1}:{len(long) + 1 + len(secret)}" and found[2].n_assign == 0
    assert {r.doc_id: r.n_base for r in find_licenses(docs).collect()}[0] == 1
    assert {r.doc_id: r.component_id for r in jaccard_join(docs).collect()} == {0: 0, 1: 0, 2: 2, 3: 0, 4: 4}
    kept = {r.doc_id: r.n_bytes - r.n_removed for r in dedup(docs).collect()}
    assert kept[1] == 0 and kept[3] == 0 and kept[2] == 300_000
    assert all(r.round_trip for r in encode_table(docs).collect())
    labels = labels_of(spark, 4)
    assert quality(docs, labels).count() == toxicity(docs, labels).count() == language(docs).count() == 5
    item = " ".join(long.split()[40_000:40_040])
    items = spark.createDataFrame([(7, item)], ITEMS)
    assert {(r.doc_id, r.item_id) for r in contaminated(docs, items).collect()} == {(0, 7), (1, 7), (3, 7)}
    assert sorted(r.doc_id for r in decontaminate(docs, items).collect()) == [2, 4]
    assert {r.doc_id: len(r.text) for r in redact(docs).filter("doc_id = 0").collect()}[0] == len(texts[0]) - len(secret) + len("[ASSIGN]")


def test_missing_and_repeated_ids(spark):
    texts = corpus(9, 3)[:9]
    rows = [(None, texts[0]), (None, texts[1]), (3, texts[2]), (3, texts[3]), (4, None)]
    docs = spark.createDataFrame([(k, t, "en", "s", 1, 0.5, "x") for k, t in rows], SCHEMA)
    labels = spark.createDataFrame([(3, 1, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    for out in (quality(docs, labels), toxicity(docs, labels), language(docs), find_secrets(docs), find_licenses(docs), encode_table(docs), dedup(docs), jaccard_join(docs)):
        assert sorted(str(r.doc_id) for r in out.collect()) == ["3", "3", "4", "None", "None"]
    assert drop_near_copies(docs).count() == 5


def test_ids_that_are_texts(spark):
    docs = docs_of(spark, ["token = abcdefgh", "plain"]).withColumn("doc_id", F.concat(F.lit("d"), "doc_id"))
    labels = spark.createDataFrame([("d0", 1, 0)], "doc_id string, quality int, toxic int")
    for out in (quality(docs, labels), toxicity(docs, labels), find_secrets(docs), find_licenses(docs), encode_table(docs), language(docs)):
        assert {r.doc_id for r in out.collect()} == {"d0", "d1"}


def test_tables_go(spark):
    out = written(spark.range(5))
    dropped(spark, out)
    with pytest.raises(Exception, match="(?i)path|exist|found"):
        spark.read.parquet(out.written_at).count()
    assert scratch_dir(spark) in out.written_at


def test_pipeline_on_odd_rows(spark, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    base = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400)
    text = base.filter("lang = 'en' and n_chars > 400").first().text
    noise = "".join(random.Random(1).choice("abcdefghijklmnopqrstuvwxyz    ") for _ in range(500))
    odd = [(900_001, text + " zz", "en"), (900_002, text + " password = hunter2hunter end of the text", "en"), (900_003, None, None), (None, text + " qq ww ee", "en"), (900_004, noise, None), (900_005, "Все люди рождаются свободными и равными", None)]
    more = spark.createDataFrame([(k, t, lang, "s", len(t or "")) for k, t, lang in odd], "doc_id long, text string, lang string, source string, n_chars long")
    docs = base.unionByName(more).withColumn("score", F.lit(-5.0))
    for name in ("documents", "benchmark"):
        (docs if name == "documents" else spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")).write.parquet(f"{tmp_path}/{name}.parquet")
    kept, seen = docs, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        kept = written(stage(spark, kept, str(tmp_path)))
        assert kept.columns == docs.columns
        seen.append({r.doc_id: r for r in kept.collect()})
    assert not {900_003, 900_004, 900_005} & set(seen[0]) and all(r.score == -5.0 for r in seen[3].values())
    assert None in seen[1] and len({900_001, 900_002} & set(seen[1])) <= 1
    redacted = seen[3].get(900_002)
    assert redacted is None or "hunter2" not in redacted.text
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in rows} == set(seen[3]) and all(r.round_trip for r in rows)
    empty = f"{tmp_path}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_last_stage_takes_bounded_batches(spark, monkeypatch):
    """20 MB of texts in one task reach the last stage of the pipeline in batches of a few MB, whoever writes its rows."""
    import corpus_pipeline

    def sizes(docs, **_):
        return docs.mapInArrow(lambda batches: (b.slice(0, 1).set_column(0, "doc_id", pa.array([b.nbytes], pa.int64())) for b in batches), "doc_id long, next_ids string")

    monkeypatch.setattr(corpus_pipeline, "encode_table", sizes)
    docs = spark.range(0, 2000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 10_000).alias("next_ids"))
    assert max(r.doc_id for r in corpus_pipeline.tokens(spark, docs, "").collect()) < 8 << 20
