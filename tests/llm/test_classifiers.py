import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from waygrid.llm.language_id import language_id, viterbi
from waygrid.llm.lm_score import held_out_by_id
from waygrid.llm.toxicity import Field, toxicity


def test_viterbi_is_brute_force():
    rng = np.random.default_rng(1)
    sizes = np.array([5, 0, 1, 7, 3])
    scores = rng.normal(size=(16, 3))
    got, at = viterbi(scores, sizes, 1.0), 0
    for n in sizes:
        best = max(np.ndindex(*[3] * n), key=lambda p: sum(scores[at + i, k] for i, k in enumerate(p)) - sum(a != b for a, b in zip(p, p[1:], strict=False))) if n else ()
        assert got[at : at + n].tolist() == list(best)
        at += n


@pytest.fixture(scope="module")
def big(spark):
    return "/root/testdata/sf0.01"


def test_language_held_out(spark, big):
    docs = spark.read.parquet(f"{big}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None), (-1, "", "en"), (-2, "123 !! \u00bd \u00b2 \u2460 \u2167 _", "fr"), (-3, "слово слово", None), (-4, "the of and is", None)], "doc_id long, text string, lang string")
    both = docs.select("doc_id", "text", "lang").union(odd).withColumn("score", F.lit("x"))
    got = language_id(both, held_out_by_id("doc_id", 5, 0)).toPandas()
    assert len(got) == docs.count() + 5
    truth = {r.doc_id: r.lang for r in docs.collect()}
    held = got[got.held_out & got.doc_id.isin(list(truth))]
    assert (held.lang_pred == held.doc_id.map(truth)).mean() > 0.97
    by = {int(r.doc_id): r for r in got[got.doc_id < 0].itertuples()}
    assert by[-1].lang_pred == by[-2].lang_pred == "und" and by[-4].lang_pred == "en" and by[-3].lang_pred != "und"
    assert got[got.doc_id.isna()].lang_pred.tolist() == ["und"] and got.score.between(0, 1).all()
    assert language_id(both.limit(0), held_out_by_id("doc_id", 5, 0)).count() == 0


def test_language_spans(spark, big):
    docs = spark.read.parquet(f"{big}/documents.parquet").select("doc_id", "text", "lang")
    pick = {r.lang: " ".join(r.text.split()[:60]) for r in docs.where("length(text) > 1000 and doc_id % 3 = 0").collect()}
    mixed = spark.createDataFrame([(-9, pick["en"] + " " + pick["de"], None)], "doc_id long, text string, lang string")
    row = language_id(docs.union(mixed), held_out_by_id("doc_id", 5, 0)).where("doc_id = -9").first()
    names = [s.split(":")[0] for s in row.spans.split(",")]
    assert names == ["en", "de"] and abs(int(row.spans.split(",")[0].split(":")[2]) - 60) <= 6


def test_toxicity_held_out(spark, big):
    docs, labels = (spark.read.parquet(f"{big}/{t}.parquet") for t in ("documents", "labels"))
    odd = spark.createDataFrame([(None, None), (-1, ""), (-2, "you idiot, what a pathetic and stupid moron"), (-3, "of the and")], "doc_id long, text string")
    both = docs.select("doc_id", "text").union(odd).withColumn("score", F.lit("x"))
    more = labels.union(labels.limit(3)).union(spark.createDataFrame([(None, 1, 1), (12345678, 1, 1)], "doc_id long, quality int, toxic int"))
    got = toxicity(both, more, held_out_by_id("doc_id", 3, 1)).toPandas()
    assert len(got) == docs.count() + 4 and got.score.between(0, 1).all() and ((got.score >= 0.7) == (got.predicted == 1)).all()
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    held = got[got.held_out & got.doc_id.isin(list(toxic))]
    truth = held.doc_id.map(toxic)
    assert held.predicted[truth == 1].mean() > 0.7 and held.predicted[truth == 0].mean() < 0.03
    by = {int(r.doc_id): r for r in got[got.doc_id < 0].itertuples()}
    assert by[-2].predicted == 1 and "4:10" in by[-2].spans.split(",") and by[-1].predicted == by[-3].predicted == 0
    assert toxicity(both.limit(0), labels, held_out_by_id("doc_id", 3, 1)).count() == 0
    assert set(toxicity(both, labels.limit(0), held_out_by_id("doc_id", 3, 1)).toPandas().score) == {0.0}


def test_marginals_are_brute_force():
    rng = random.Random(1)
    field = Field({"a": 3.0, "b": 3.0})
    field.weights, field.moves = np.array([-2.0, 1.5, 3.0]), np.array([[0.5, -1.0], [-0.3, 0.7]])
    for n, places in ((1, [0]), (6, [0, 3, 4]), (7, [2, 6]), (8, [5])):
        found = [(rng.choice([1, 2]),) for _ in places]
        emit = [field.weights[0] + (field.weights[found[places.index(i)][0]] if i in places else 0) for i in range(n)]
        total, one = 0.0, np.zeros(n)
        for p in np.ndindex(*[2] * n):
            w = np.exp(sum(e for e, k in zip(emit, p, strict=True) if k) + sum(field.moves[a, b] for a, b in zip(p, p[1:], strict=False)))
            total += w
            one += w * np.array(p)
        assert field.marginals(places, found, n) == pytest.approx((one / total)[places].tolist())
