"""A corpus pipeline: language ID, near-copy removal, benchmark decontamination, secret redaction, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as
Parquet in the shared folder and reads them again for the next. All stages but the last return the
columns of documents. Rejected languages, all but one document of each near-copy component, and
documents that hold a test item go; secrets are replaced in the text; the last stage gives the ids.
Stages that filter or change texts in Python write their own rows, as written() bounds the memory of a batch;
the last one is written once, by its caller, in batches that are bounded too.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from synodic.llm.benchmarks import decontaminate
from synodic.llm.common import bounded, dropped, written
from synodic.llm.jaccard import drop_near_copies
from synodic.llm.language import fit_language, known_language
from synodic.llm.pieces import encode_table
from synodic.llm.secrets import redact


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return written(known_language(docs, fit_language(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return written(decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


def secret_redaction(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return written(redact(docs))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bounded(encode_table(docs, digest=False, generation=25_000).drop("next_ids"))


STAGES = [("language ID", language_id), ("n-gram Jaccard join", near_copies), ("benchmark decontamination", decontamination), ("secret scans", secret_redaction), ("SentencePiece encoding", tokens)]

#: SQL can't express the language models nor the piece lattice; tests hold run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = docs if hasattr(docs, "written_at") else written(docs)
            if before is not None:
                dropped(spark, before)
            before = docs
    return docs
