"""Queries op1_ to op10_ over the tables of a folder; each applies its operator to the whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .benchmarks import contaminated
from .jaccard import jaccard_join
from .language import language
from .licenses import find_licenses
from .pieces import encode_table
from .quality import quality
from .secrets import find_secrets
from .suffixes import dedup
from .toxicity import toxicity
from .vectors import near_vectors


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark, sf_dir):
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_secret_scan(spark, sf_dir):
    return find_secrets(table(spark, sf_dir, "documents"))


def op3_sentencepiece(spark, sf_dir):
    return encode_table(table(spark, sf_dir, "documents"))


def op4_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents"))


def op5_suffix_dedup(spark, sf_dir):
    return dedup(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_license_scan(spark, sf_dir):
    return find_licenses(table(spark, sf_dir, "documents"))


def op8_decontamination(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_embedding_dedup(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op10_language_id(spark, sf_dir):
    return language(table(spark, sf_dir, "documents"))


def secret_counts(spark, sf_dir):
    """The counts of op2's base patterns."""
    return op2_secret_scan(spark, sf_dir).select("doc_id", "n_assign", "n_access", "n_hex")


def license_base_phrases(spark, sf_dir):
    """What op7 finds of the base phrases."""
    return op7_license_scan(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = {
    "secret_counts": r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x FROM documents),
a AS (SELECT doc_id, x, regexp_extract_all(x, '(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS g FROM t)
SELECT doc_id, CAST(len(list_filter(g, lambda s: length(s) >= 6)) AS BIGINT) AS n_assign, CAST(len(list_filter(regexp_extract_all(x, 'AKIA[A-Z0-9]+'), lambda s: length(s) >= 20)) AS BIGINT) AS n_access,
CAST(len(list_filter(regexp_extract_all(x, '[0-9a-f]+'), lambda s: length(s) >= 24)) AS BIGINT) AS n_hex FROM a
""",
    "license_base_phrases": rf"""
WITH t AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
p AS (SELECT doc_id, w, list_filter(range(len(w)), lambda i: w[i + 1] = 'cc' AND w[i + 2] = 'by') AS c, list_filter(range(len(w)), lambda i: w[i + 1] = 'general' AND w[i + 2] = 'public' AND w[i + 3] = 'license') AS g,
list_filter(range(len(w)), lambda i: w[i + 1] = 'all' AND w[i + 2] = 'rights' AND w[i + 3] = 'reserved') AS r FROM t)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(c) + len(g) + len(r) AS BIGINT) AS n_base, list_min(c || g || r) AS first_word, list_max(c || g || r) AS last_word,
array_to_string(list_filter([CASE WHEN len(c) > 0 THEN 'cc-by' END, CASE WHEN len(g) > 0 THEN 'gpl' END, CASE WHEN len(r) > 0 THEN 'reserved' END], lambda s: s IS NOT NULL), ',') AS base_labels FROM p
""",
    "op4_jaccard_join": rf"""
WITH RECURSIVE t AS (SELECT doc_id, regexp_extract_all({LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM t),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id != b.doc_id GROUP BY 1, 2),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * i >= 80 * (x.n + y.n - i)),
r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id JOIN c ON c.node = d.doc_id
""",
    "op5_suffix_dedup": r"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 49)) AS i, h FROM t),
k AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 100)) AS s FROM w),
o AS (SELECT s, min(doc_id) AS m FROM k GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
v AS (SELECT k.doc_id, k.i FROM k JOIN o USING (s) WHERE k.doc_id > o.m),
g AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 THEN 0 ELSE 1 END AS new FROM v),
z AS (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS z FROM g),
spans AS (SELECT doc_id, z, min(i) AS a, max(i) + 50 AS b FROM z GROUP BY 1, 2),
kept AS (SELECT s.doc_id, s.z, substr(t.h, 2 * coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.z), 0) + 1, 2 * (s.a - coalesce(lag(s.b) OVER (PARTITION BY s.doc_id ORDER BY s.z), 0))) AS part, s.a, s.b FROM spans s JOIN t ON t.doc_id = s.doc_id),
sums AS (SELECT doc_id, CAST(sum(b - a) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(part, '' ORDER BY z) AS head, max(b) AS last FROM kept GROUP BY 1)
SELECT t.doc_id, CAST(length(t.h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(CASE WHEN last IS NULL THEN t.h ELSE head || substr(t.h, 2 * last + 1) END)) AS kept_sha256 FROM t LEFT JOIN sums ON sums.doc_id = t.doc_id
""",
    "op9_embedding_dedup": """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(embedding, lambda c: c != 0)) > 0),
e AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id != b.vec_id AND len(a.x) = len(b.x) WHERE list_cosine_similarity(a.x, b.x) >= 0.9),
n AS (SELECT a, count(*) AS n FROM e GROUP BY 1),
r AS (SELECT vec_id AS node, vec_id AS root FROM embeddings UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node),
c AS (SELECT node, min(root) AS component_id FROM r GROUP BY 1)
SELECT vec_id, coalesce(n.n, 0) AS n_links, c.component_id, vec_id = c.component_id AS kept FROM embeddings LEFT JOIN n ON n.a = vec_id JOIN c ON c.node = vec_id
""",
}


def queries() -> dict:
    every = [op1_quality_classifier, op2_secret_scan, op3_sentencepiece, op4_jaccard_join, op5_suffix_dedup, op6_toxicity, op7_license_scan, op8_decontamination, op9_embedding_dedup, op10_language_id]
    return {f.__name__: f for f in [*every, secret_counts, license_base_phrases]}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
