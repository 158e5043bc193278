import math
import re
import zlib
from collections import Counter

import pytest

from waygrid.llm.lm_score import held_out_by_id, lm_score

END = object()


def token_list(t):
    return [w for w in re.split("[\x20\x09-\x0d]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")) if w] + [END]


def brute(rows, share=2e-6, d=0.75):
    held = [zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2 for i, _ in rows]
    toks = [token_list(t) for _, t in rows]
    one, two, ctx = Counter(), Counter(), Counter()
    for h, w in zip(held, toks, strict=True):
        if not h:
            one.update(w)
            for a, b in zip([None, *w[:-1]], w, strict=True):
                two[a, b] += 1
                ctx[a] += 1
    n, v = sum(one.values()), len(one)
    ctx = {**one, None: one[END]}
    p1 = lambda w: (one[w] + 1) / (n + v + 1)
    freq = lambda w: one[w] > share * n or w is None
    kept = {k: c for k, c in two.items() if c > max(1, share * n) and freq(k[0]) and freq(k[1])}
    held_mass, below = Counter(), Counter()
    for (a, b), c in kept.items():
        held_mass[a] += (c - d) / ctx[a]
        below[a] += p1(b)
    out = []
    for (i, _), h, w in zip(rows, held, toks, strict=True):
        base = sum(math.log10(p1(x)) for x in w)
        score = 0
        for a, b in zip([None, *w[:-1]], w, strict=True):
            if (a, b) in kept:
                score += math.log10((kept[a, b] - d) / ctx[a])
            else:
                score += math.log10(p1(b)) + (math.log10((1 - held_mass[a]) / (1 - below[a])) if held_mass[a] else 0)
        out.append((str(i), h, len(w), sum(one[x] > 0 for x in w), n, base, score))
    return sorted(out, key=lambda r: (r[0], r[2], r[5]))


def test_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, "Is and\tretitioning"), (None, None), (5000, None), (5001, ""), (5002, "ÉÀ éa novelword novelword"), (1, "the the")]
    df = spark.createDataFrame([(*r, 3.0) for r in rows], "doc_id long, text string, score double")
    got = sorted(((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in lm_score(df, held_out_by_id("doc_id", 7, 2)).collect()), key=lambda r: (r[0], r[2], r[5]))
    want = brute(rows)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    for g, w in zip(got, want, strict=True):
        assert g[5:] == pytest.approx(w[5:], rel=1e-9)
    known = [r for r in want if r[1]]
    assert sum(r[6] for r in known) > sum(r[5] for r in known)  # the model is better than its base on held-out text
    assert lm_score(df.limit(0), held_out_by_id("doc_id", 7, 2)).count() == 0
