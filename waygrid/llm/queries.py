"""The queries of this subpackage, by name: (spark, sf_dir) -> DataFrame, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .decontaminate import contamination
from .jaccard_join import jaccard_join
from .language_id import language_id
from .lm_score import held_out_by_id, lm_score
from .packing import pack_best_fit, pieces
from .pii import pii
from .secrets import secrets
from .suffix_dedup import suffix_dedup
from .topk_search import top_k
from .toxicity import toxicity

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


OP1_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: CAST(floor(CAST(c AS DOUBLE) * 1024) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(CAST(q.v AS DOUBLE[]), CAST(x.v AS DOUBLE[])) AS BIGINT) AS score
  FROM v q JOIN v x ON q.vec_id % 100 = 0 AND x.vec_id <> q.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score FROM s
)
SELECT query_id, "rank", vec_id, score FROM r WHERE "rank" <= 10
"""


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"), repo_cols=("lang",)).drop("span_list")


def op4_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P

    return pack_best_fit(pieces(table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id(table(spark, sf_dir, "documents"), held_out_by_id("doc_id", 5, 0))


def op6_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"), held_out_by_id("doc_id", 7, 2))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "n_links")


OP8_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(generate_series(1, len(w) - 3), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM w
), e AS (SELECT doc_id, unnest(s) AS g FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN s x ON x.doc_id = a JOIN s y ON y.doc_id = b WHERE 100 * i >= 85 * (len(x.s) + len(y.s) - i)),
u AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(n, k) USING KEY (n) AS (
  SELECT doc_id, doc_id FROM s
  UNION
  (SELECT u.b, min(c.k) FROM c JOIN u ON u.a = c.n JOIN recurring.c r ON r.n = u.b GROUP BY u.b, r.k HAVING min(c.k) < r.k)
)
SELECT doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, k AS component_id,
  (SELECT CAST(count(DISTINCT list_sort(y.s)) AS BIGINT) FROM u JOIN s y ON y.doc_id = u.b WHERE u.a = s.doc_id AND list_sort(y.s) <> list_sort(s.s)) AS n_links
FROM s JOIN c ON n = doc_id
"""


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), held_out_by_id("doc_id", 3, 1))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_topk_search, op2_decontamination, op3_secret_scan, op4_best_fit_packing, op5_language_id, op6_lm_score, op7_suffix_dedup, op8_jaccard_join, op9_toxicity, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return {"op1_topk_search": OP1_SQL, "op8_jaccard_join": OP8_SQL}
