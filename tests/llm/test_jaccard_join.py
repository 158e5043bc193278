import random
import re

import numpy as np
import pytest

from waygrid.llm.graph import components
from waygrid.llm.jaccard_join import apart, bands, bit_sketch, jaccard_join, limit, one_of_each, signatures, sketch_distances, sketch_matrix
from waygrid.llm.winnow import mix


def brute(rows, k, percent):
    sets = []
    for _, t in rows:
        w = [x for x in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if x]
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent, links = list(range(len(rows))), [set() for _ in rows]

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if rows[i][0] is not None and rows[j][0] is not None and sets[i] and sets[j]:
                n = len(sets[i] & sets[j])
                if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
                    parent[find(i)] = find(j)
                    if sets[i] != sets[j]:
                        links[i].add(frozenset(sets[j]))
                        links[j].add(frozenset(sets[i]))
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted((str(d), len(sets[i]), str(least.get(find(i))), len(links[i])) for i, (d, _) in enumerate(rows))


def rows_of(df):
    return sorted((str(r.doc_id), r.n_shingles, str(r.component_id), r.n_links) for r in df.collect())


def test_parts_never_miss_a_link():
    rng = np.random.default_rng(2)
    for percent in (80, 85):
        for n in (1, 5, 6, 7, 13, 20, 50, 100, 333, 1000, 5000):
            a = np.unique(mix(rng.integers(0, 1 << 62, n).astype(np.uint64)))
            for _ in range(20):
                drop = int(rng.integers(0, max(1, limit(2 * n, percent)) + 1))
                b = np.unique(np.r_[a[: len(a) - drop // 2], mix(rng.integers(0, 1 << 62, drop - drop // 2).astype(np.uint64))])
                both = len(np.intersect1d(a, b))
                assert apart(bit_sketch(a), bit_sketch(b)) <= len(a) + len(b) - 2 * both if len(b) else True
                if len(b) and 100 * both >= percent * (len(a) + len(b) - both):
                    sig, which = signatures([a, b], percent)
                    assert np.intersect1d(sig[which == 0], sig[which == 1]).size
    assert all(s <= p for p, s in zip(*bands(85)[1:], strict=True))


def test_folded_sketches_agree():
    rng = np.random.default_rng(3)
    sketches = [bit_sketch(np.unique(mix(rng.integers(0, 1 << 62, n).astype(np.uint64)))) for n in (5, 100, 140, 600, 700, 3000, 9)]
    bits = sketch_matrix(sketches)
    for x in range(7):
        assert sketch_distances(bits, x, np.arange(7)).tolist() == [apart(sketches[x], y) for y in sketches]


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (-7, 102), (9, 9)]
    got = {r.node: r.label for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: -7, 101: -7, 102: -7, -7: -7}


@pytest.mark.parametrize(("k", "percent", "row"), [(4, 85, 4096), (4, 85, 20), (5, 80, 50)])
def test_brute_force(spark, sf_dir, monkeypatch, k, percent, row):
    """With row at 20 and 50 the larger neighbourhoods are dealt to many blocks."""
    monkeypatch.setattr("waygrid.llm.jaccard_join.ROW", row)
    rng = random.Random(k)
    words = ["".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(400)]
    base = [rng.choices(words, k=n) for n in (1, 2, 4, 5, 8, 9, 30, 60, 120, 120)]
    rows = []
    for i in range(260):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 5])):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((i, rng.choice([" ", "\n", " \t"]).join(w)))
    # a chain: each is close to the next only
    chain = rng.choices(words, k=100)
    for i in range(300, 340):
        chain[(3 * (i - 300)) % 100] = f"new{i}"
        rows.append((i, " ".join(chain)))
    rows += [(None, rows[0][1]), (None, None), (1000, None), (1001, ""), (1002, " \n"), (5, rows[9][1]), (5, "one two"), (1003, "ONE two"), (1004, "x " * 5000), (1005, "x " * 5001)]
    rows += [(2000 + i, rows[30][1]) for i in range(50)]
    # a cloud around one text, near and far from its centre and from one another
    centre = rng.choices(words, k=60)
    for i in range(3000, 3150):
        w = list(centre)
        for _ in range(rng.randint(0, 5)):
            w[rng.randrange(len(w))] = rng.choice(words[:3])
        rows.append((i, " ".join(w)))
    df = spark.createDataFrame([(*r, 0) for r in rows], "doc_id long, text string, node int")
    want = brute(rows, k, percent)
    assert rows_of(jaccard_join(df, k, percent)) == want
    if row != 20:
        assert [r[:3] for r in rows_of(jaccard_join(df, k, percent, count=False))] == [r[:3] for r in want]
    assert jaccard_join(df.limit(0)).count() == 0
    if row < 4096:
        return
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(jaccard_join(docs, k, percent)) == brute([(r.doc_id, r.text) for r in docs.collect()], k, percent)


def test_one_of_each_keeps_odd_columns(spark):
    text = "one two three four five six seven"
    rows = [(1, text, "a", 1, 2), (2, text, "b", 3, 4), (None, text, "c", 5, 6), (3, None, "d", 7, 8), (4, "", "e", 9, 0), (1, text, "f", 1, 1), (9, "other words stand here alone today", "g", 0, 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, `a.b` string, mark_ int, __mark int")
    got = one_of_each(df)
    assert got.columns == df.columns
    kept = sorted((str(r[0]), r[1]) for r in got.collect())
    assert kept == sorted([("1", text), ("None", text), ("3", None), ("4", ""), ("9", rows[6][1])], key=lambda r: r[0])
    assert one_of_each(df.limit(0)).count() == 0
