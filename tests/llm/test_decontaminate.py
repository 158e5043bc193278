import random

import numpy as np
import pytest

from waygrid.llm import decontaminate as module
from waygrid.llm.decontaminate import EDITS_IN, Passages, align, contamination, decontaminate, normal


def least_edits(p, t):
    """Of p against any stretch of t."""
    cost = [0] * (len(t) + 1)
    for c in p:
        new = [cost[0] + 1]
        for j, d in enumerate(t):
            new.append(min(cost[j] + (c != d), cost[j + 1] + 1, new[j] + 1))
        cost = new
    return min(cost)


def test_align():
    rng = random.Random(2)
    for _ in range(60):
        p, t = bytes(rng.choices(b"ab", k=rng.randint(1, 12))), bytes(rng.choices(b"ab", k=rng.randint(0, 30)))
        got = align(np.frombuffer(p, np.uint8), np.frombuffer(t, np.uint8), -len(p), len(t), len(p))
        assert got[0] == least_edits(p, t)
        assert least_edits(p, t[got[1] : got[2]]) == got[0]


def test_something_survives_every_budget():
    for m in range(module.Q, 3000):
        q, budget = module.gram_size(m), m // EDITS_IN
        assert q >= 3 and m - q + 1 - q * budget >= 1


def edited(rng, text, n):
    t = list(text)
    for _ in range(n):
        i = rng.randrange(len(t))
        kind = rng.randrange(3)
        if kind == 0:
            t[i] = rng.choice("abcdeé")
        elif kind == 1:
            del t[i]
        else:
            t.insert(i, rng.choice("abcde"))
    return "".join(t)


@pytest.mark.parametrize("block", [4 << 20, 600])
def test_brute_force(spark, sf_dir, block, monkeypatch):
    monkeypatch.setattr(module, "BLOCK", block)
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcde", k=rng.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(n)) for i, n in enumerate((2, 3, 4, 10, 20, 40, 70))] + [(50, None), (51, "  "), (52, "abc"), (53, "zzzz  Zq")]
    items += [(60, items[4][1])]
    docs = []
    for i in range(150):
        k, passage = rng.choice(items[:7])
        m = len(normal(passage))
        docs.append((i, (prose(rng.randint(0, 15)) + " " + edited(rng, passage, rng.randint(0, m // EDITS_IN + 3)) + "\n" + prose(rng.randint(0, 15))).upper()))
    docs += [(None, items[3][1]), (None, None), (500, ""), (501, "x ZZZZ\nzq y"), (502, "a" * 3_000), (502, items[5][1])]
    want = sorted((str(i), k) for i, t in docs for k, p in items if p and normal(p) and t and least_edits(normal(p), normal(t)) <= len(normal(p)) // EDITS_IN)
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id long, text string, item_id int")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = contamination(d, b).collect()
    assert sorted((str(r.doc_id), r.item_id) for r in got) == want and len(want) > 60
    bad = {i for i, _ in want}
    assert sorted(str(r.doc_id) + str(r.text) for r in decontaminate(d, b).collect()) == sorted(str(i) + str(t) for i, t in docs if not any(p and normal(p) and t and least_edits(normal(p), normal(t)) <= len(normal(p)) // EDITS_IN for _, p in items))
    assert bad and contamination(d.limit(0), b).count() == contamination(d, b.limit(0)).count() == 0


def test_long_text():
    rng = random.Random(1)
    passage = " ".join("".join(rng.choices("abcdef", k=6)) for _ in range(30))
    long = "".join(rng.choices("uvwxyz ", k=1_048_500)) + edited(rng, passage, 5) + "".join(rng.choices("uvwxyz ", k=300_000))
    hits = Passages([(3, passage)]).search([long, "nothing"])
    assert len(hits[0]) == 1 and hits[1] == []


def test_whole_passages_of_the_tables(spark, sf_dir):
    docs, bench = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in bench.collect() if normal(b.text) in normal(d.text)}
    assert want and want <= {(r.doc_id, r.item_id) for r in contamination(docs, bench).collect()}
