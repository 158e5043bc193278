import numpy as np
import pandas as pd
import pytest

from waygrid.llm.decontaminate import normal

from . import brute
from .test_jaccard_join import brute as classes


def frame(rows, columns):
    return pd.DataFrame([tuple(r) for r in rows], columns=columns).astype({"doc_id": object})


@pytest.fixture(scope="module")
def sf_dir():
    return "/root/testdata/sf0.01"  # the smallest has too few labels to learn from


@pytest.fixture(scope="module")
def steps(spark, sf_dir):
    import corpus_pipeline as p

    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    odd = spark.createDataFrame([(None, None, None, None, None), (-1, "", "en", "s", 0), (-2, "x token=abcdefgh1 y", None, None, 9), (-2, "x token=abcdefgh1 y", None, None, 9), (-3, "Zz9Zz9Zz9Zz9Zz9Zz9Zz9Zz9", "en", "s", 1)], docs.schema)
    docs = docs.union(odd)
    for _, f in p.STAGES:
        after = f(spark, docs, sf_dir)
        rows = after.collect()
        out.append((frame(docs.collect(), docs.columns), frame(rows, after.columns)))
        if f is not p.STAGES[-1][1]:
            assert after.columns == p.COLUMNS
            docs = spark.createDataFrame(rows, docs.schema)
    return out


def pairs(df):
    return [(None if i != i or i is None else int(i), t) for i, t in zip(df.doc_id, df.text, strict=True)]


def test_toxicity_drops_and_keeps(steps):
    before, after = steps[0]
    assert 0.8 * len(before) < len(after) < len(before)
    gone = before[~before.text.isin(list(after.text))]
    assert gone.text.str.contains("idiot|moron|stupid|scum|loser|trash|clown|pathetic|worthless|disgusting|réeux|achlich|achkeit|bo").mean() > 0.9


def test_one_of_each_class_stays(steps):
    before, after = steps[1]
    rows = pairs(before)
    component = {(d, c) for d, n, c, _ in classes(rows, 5, 80) if n and d != "None"}
    kept = [str(i) for i, t in pairs(after) if i is not None and t.split()]
    assert sorted(kept) == sorted({c for _, c in component})
    assert sum(not (t or "").split() for _, t in pairs(after)) == sum(not (t or "").split() for _, t in rows)


def test_no_passage_is_left(steps, spark, sf_dir):
    before, after = steps[2]
    bench = [normal(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    has = lambda t: any(b in normal(t or "") for b in bench)
    assert not any(has(t) for t in after.text)
    assert len(after) >= sum(not has(t) for t in before.text) - 2 and len(after) < len(before)


def test_secrets_are_masked(steps):
    before, after = steps[3]
    assert len(before) == len(after) and not any(sum(brute.secrets(t or "")[0]) for t in after.text)
    texts = {int(i): t for i, t in pairs(after) if i is not None}
    for i, t in pairs(before):
        if i is not None and not sum(brute.secrets(t)[0]) and i > 0:
            assert texts[i] == t or "[REDACTED]" in texts[i]
    assert texts[-2] == "x [REDACTED] y" and texts[-3] == "[REDACTED]"


def test_sequences(steps):
    before, after = steps[4]
    assert set(after.doc_id.dropna()) == set(before.doc_id.dropna())
    for _, g in after.sort_values("offset").groupby("sequence_id"):
        assert g.length.sum() <= 1024 and (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length.to_numpy())[:-1]]).all()


def test_run(spark, sf_dir):
    import corpus_pipeline as p

    assert p.run(spark, sf_dir).count() > 100
