import hashlib
import random

import numpy as np
import pytest

from waygrid.llm.suffix_dedup import suffix_dedup, suffix_order, window_groups


def brute(rows, w):
    first = {}
    for i, t in rows:
        if i is not None:
            b = (t or "").encode()
            for s in range(len(b) - w + 1):
                k = b[s : s + w]
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for s in range(len(b) - w + 1):
                if first[b[s : s + w]] < i:
                    gone[s : s + w] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        edges = np.diff(np.r_[0, gone.astype(int)])
        out.append((str(i), len(b), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def rows_of(df):
    return sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect())


def test_suffix_order_is_lexicographic():
    rng = np.random.default_rng(5)
    for n, top in ((1, 3), (2, 3), (3, 2), (4, 2), (7, 3), (50, 2), (400, 2), (999, 4), (1000, 3), (1001, 200)):
        x = rng.integers(1, top + 1, n)
        assert suffix_order(x).tolist() == sorted(range(n), key=lambda i: x[i:].tolist())
    text = np.frombuffer(b"abcabcabcabxabcabcabcabc" * 3, np.uint8)
    valid = np.arange(len(text)) + 9 <= len(text)
    order, new = window_groups(text, valid, 9)
    got = [bytes(text[i : i + 9]) for i in order]
    assert got == sorted(got) and [k == 0 or got[k] != got[k - 1] for k in range(len(got))] == new.tolist()


def test_brute_force(spark, sf_dir):
    rng = random.Random(3)
    words = ["".join(rng.choices("abcé", k=rng.randint(1, 9))) for _ in range(60)]
    prose = lambda n: " ".join(rng.choices(words, k=n))
    shared = [prose(30) for _ in range(4)]
    rows = [(i, prose(rng.randint(0, 60)) + rng.choice(["", *shared]) + prose(9) + rng.choice(["", shared[0][:60], "a" * 300, "ab" * 90])) for i in range(150)]
    rows += [(i, rows[3][1]) for i in range(200, 230)] + [(3, rows[3][1]), (3, shared[0]), (None, shared[1] * 2), (None, None), (5, None), (6, ""), (-4, shared[2]), (1 << 40, shared[3] + "!")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, chunk int")
    assert rows_of(suffix_dedup(df)) == brute(rows, 50)
    assert suffix_dedup(df.limit(0)).count() == 0
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert rows_of(suffix_dedup(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()], 50)


@pytest.mark.parametrize("cut", [64])
def test_long_text_in_segments(spark, cut, monkeypatch):
    rng = random.Random(4)
    long = "".join(rng.choices("abcdefgh ", k=1_300_000))
    rows = [(1, long), (2, "x" + long[1_000_000:1_100_000] + "y"), (3, long[1_048_500:1_048_700])]
    got = {r.doc_id: r for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1].n_removed == 0 and got[2].n_removed == 100_000 and got[2].n_spans == 1 and got[3].n_removed == 200
