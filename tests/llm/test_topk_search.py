import numpy as np
import pytest
from pyspark.sql import functions as F

from waygrid.llm import topk_search
from waygrid.llm.topk_search import top_k


def brute(rows, k):
    ok = [(i, [int(c) for c in np.floor(np.array(v, np.float32).astype(float) * 1024)]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    out = []
    for i, q in ok:
        if i % 100 == 0:
            best = sorted((-sum(a * b for a, b in zip(q, x, strict=False)), j) for j, x in ok if j != i)[:k]
            out += [(i, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    return sorted(out)


def rows_of(df):
    return sorted(tuple(r) for r in df.select("query_id", "rank", "vec_id", "score").collect())


@pytest.mark.parametrize("shard", [64, 16_384])
def test_brute_force(spark, shard, monkeypatch):
    monkeypatch.setattr(topk_search, "SHARD", shard)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    rows = [(i, (centres[i % 6] * rng.uniform(0.2, 2) + rng.normal(size=8) * 0.2).tolist()) for i in range(700)]
    rows += [(i, rows[5][1]) for i in range(900, 1101)] + [(1200, None), (1300, [1.0] * 7 + [float("nan")]), (1400, [1.0] * 7 + [None]), (1500, [0.0] * 8), (1600, [1.0] * 7 + [float("inf")])]
    df = spark.createDataFrame([(*r, 5) for r in rows], "vec_id long, embedding array<float>, score int")
    assert rows_of(top_k(df, F.col("vec_id") % 100 == 0)) == brute(rows, 10)


def test_few_and_none(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (7, [0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(top_k(df, F.col("vec_id") % 100 == 0)) == brute(rows, 10) and len(brute(rows, 10)) == 2
    assert top_k(df.limit(0), F.col("vec_id") % 100 == 0).count() == 0


def test_whole_table(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    assert rows_of(top_k(df, F.col("vec_id") % 100 == 0)) == brute(rows, 10)


def test_large_components_and_lengths(spark, monkeypatch):
    """Products beyond 2^53, one longer vector, an empty one, and shards that meet their queries in parts."""
    monkeypatch.setattr(topk_search, "SHARD", 50)
    monkeypatch.setattr(topk_search, "PART", 2000)
    rng = np.random.default_rng(8)
    rows = [(i * 4, (rng.integers(-300_000, 300_000, 64)).astype(float).tolist()) for i in range(300)]
    rows += [(5, [1.0, 2.0]), (7, []), (9, [3.0] * 66), (11, [1e30] * 64)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert rows_of(top_k(df, F.col("vec_id") % 100 == 0)) == brute(rows[:-1], 10)


def test_repeated_ids(spark):
    rows = [(0, [2.0, 1.0]), (0, [1.0, 5.0]), (1, [1.0, 1.0]), (1, [1.0, 1.0]), (2, [0.0, 3.0])]
    got = rows_of(top_k(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), F.col("vec_id") % 100 == 0, scale=1))
    assert got == [(0, 1, 2, 15), (0, 2, 1, 6), (0, 3, 1, 6)]
