"""Every bigram has its arc, whatever its share of the corpus."""

import math
import zlib
from collections import Counter

import pytest

from waygrid.llm.lm_score import held_out_by_id, lm_score

from .test_lm_score import token_list


def brute(rows, least, d=0.75):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    toks = [token_list(t) for _, t in rows]
    one, two = Counter(), Counter()
    for h, w in zip(held, toks, strict=True):
        if not h:
            one.update(w)
            two.update(zip([None, *w[:-1]], w, strict=True))
    n, v = sum(one.values()), len(one)
    ctx = Counter()
    for (a, _), c in two.items():
        ctx[a] += c
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    kept = {k: c for k, c in two.items() if c >= least}
    mass, below = Counter(), Counter()
    for (a, b), c in kept.items():
        mass[a] += (c - d) / ctx[a]
        below[a] += p1(b)
    out = []
    for (i, _), h, w in zip(rows, held, toks, strict=True):
        score = 0
        for a, b in zip([None, *w[:-1]], w, strict=True):
            if (a, b) in kept:
                score += math.log10((kept[a, b] - d) / ctx[a])
            else:
                score += math.log10(p1(b)) + (math.log10((1 - mass[a]) / (1 - below[a])) if mass[a] else 0)
        out.append((str(i), h, len(w), sum(one[x] > 0 for x in w), n, sum(math.log10(p1(x)) for x in w), score))
    return sorted(out, key=lambda r: (r[0], r[2], r[5]))


@pytest.mark.parametrize("least", [1, 2])
def test_no_bigram_is_dropped_by_its_share(spark, monkeypatch, least):
    """With a share that leaves few words frequent, as a large corpus has, the scores stay those of all bigrams."""
    monkeypatch.setattr("waygrid.llm.lm_score.SHARE", 0.03)
    words = [f"w{i * i * i % 41 % (7 + i % 30)}" for i in range(600)]
    rows = [(i, " ".join(words[i : i + i % 9])) for i in range(590)] + [(900, "rare pair"), (901, "rare pair"), (902, None), (None, "w1 unseen"), (903, "pair rare w2 rare")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score(df, held_out_by_id("doc_id", 7, 2), least=least).collect()), key=lambda r: (r[0], r[2], r[5]))
    want = brute(rows, least)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
