import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from waygrid.llm.packing import best_two_fit, pack_best_fit, pieces

TEXTS = [None, "", " ", "a  b", "x\n\n y \n", "it's 's  't\tq", "é ü\xa0z 😀 1234 foo,bar.\nBaz", "word " * 3000, "q" * 40_000, "<|endoftext|> z", "a <|endoftext|>\n<|endoftext|> b <|endoftext |>", "the of and x", " lead", "trail "]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    rows = [(i, t, 7) for i, t in enumerate(TEXTS)] + [(None, "none", 1), (3, "a  b", 2)]
    return spark.createDataFrame(rows, "doc_id long, text string, offset int").union(spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("doc_id + 100", "text", "1"))


def test_pieces_and_bins(docs):
    got = pack_best_fit(pieces(docs, P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).toPandas()
    tok = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    want = []
    for r in docs.collect():
        ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        while at < len(ids):
            n = (len(ids) - at) % 1024 or 1024
            want.append((str(r.doc_id), at, n, zlib.crc32(ids[at : at + n].tobytes())))
            at += n
    text = lambda x: str(int(x)) if x == x else "None"
    assert sorted(want) == sorted((text(d), int(s), int(n), int(c)) for d, s, n, c in zip(got.doc_id, got.start, got.length, got.ids_crc32, strict=True))
    total = 0
    for _, g in got.sort_values("offset").groupby("sequence_id"):
        assert (g.offset.to_numpy() == np.r_[0, np.cumsum(g.length.to_numpy())[:-1]]).all() and g.length.sum() <= 1024
        total += 1
    assert total <= -(-got.length.sum() // 1024) * 1.02 + 1
    assert pack_best_fit(pieces(docs.limit(0), P.path("byte_bpe_50k.json"), P.path("byte_bpe_50k.tiktoken"), P.PATTERN)).count() == 0


def plain(lengths, size):
    """Best-two-fit, literally: lengths of the pieces of each bin."""
    left, out = sorted(lengths, reverse=True), []
    while left:
        held, gap = [], size
        while fits := [n for n in left if n <= gap]:
            held.append(fits[0])
            left.remove(fits[0])
            gap -= fits[0]
        if gap and left and len(held) > 1:
            n = held[-1]
            sums = [(a + b, a, b) for i, a in enumerate(left) for b in left[i + 1 :] if n < a + b <= gap + n]
            if sums:
                _, a, b = max(sums)
                held = [*held[:-1], a, b]
                left.remove(a)
                left.remove(b)
                left = sorted([*left, n], reverse=True)
        out.append(sorted(held))
    return sorted(out)


def test_two_fill_tighter_than_one():
    # 600 + 400 leaves 24; 250 + 170 in the place of 400 leaves 4
    bins, _ = best_two_fit(np.array([600, 400, 250, 170]), 1024)
    assert bins[0] == bins[2] == bins[3] != bins[1]
    rng = np.random.default_rng(5)
    for size, n in ((50, 40), (100, 60), (1024, 50)):
        lengths = rng.integers(1, size + 1, n)
        bins, _ = best_two_fit(lengths, size)
        assert sorted(sorted(lengths[bins == b].tolist()) for b in set(bins.tolist())) == plain(lengths.tolist(), size)
    lengths = np.random.default_rng(1).integers(1, 1025, 3000)
    bins, places = best_two_fit(lengths, 1024)
    assert np.bincount(bins, lengths).max() <= 1024 and len(set(zip(bins.tolist(), places.tolist(), strict=True))) == 3000
