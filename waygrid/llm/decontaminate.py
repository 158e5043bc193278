"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

Texts are compared lower-cased with each run of white space as one space, as UTF-8. A
passage of m bytes is found where a stretch of a document is within BUDGET(m) = m //
EDITS_IN edits of it.

* Lemma: one edit destroys at most q of the passage's q-grams (q is Q, less for short
  passages). Of each passage only its rarest q * BUDGET(m) + spare q-grams are looked
  up, so `spare` of them survive.
* A match keeps its hits within BUDGET(m) diagonals (document place minus passage
  place), so hits are counted, by distinct passage place, in diagonal bands of twice
  that width that overlap by half. Bands with `spare` hits or more are verified.
* Verification is a semi-global alignment of the whole passage by the cells of the band
  and of BUDGET(m) diagonals to each side alone.

The passages are collected only up to BLOCK bytes at a time; a larger benchmark is
worked through in blocks, each a step of the same scan. Documents aren't shuffled.

Defined cases: null texts match nothing, neither do null or blank passages; passages
shorter than Q bytes must occur unchanged; repeated passages are reported under each
id, repeated documents each; a null id is kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, session, text_or_empty
from .winnow import SEGMENT, gram_hashes

Q, EDITS_IN = 8, 10
BLOCK = 4 << 20
TABLE = 22


def gram_size(m: int) -> int:
    """The q for a passage of m bytes: Q, or as much less as lets two q-grams or more survive its budget."""
    budget = m // EDITS_IN
    return min(Q, (m - 1) // (budget + 1)) if budget else Q


def normal(text: str) -> bytes:
    return " ".join(text.replace("\x00", " ").lower().split()).encode()


def align(passage: np.ndarray, text: np.ndarray, low: int, high: int, budget: int) -> tuple[int, int, int] | None:
    """The least edits, at most budget, of the passage against a stretch of the text, and that stretch, by
    paths within the diagonals (place in the text less place in the passage) low to high."""
    n, wide = len(text), high - low + 1
    far = len(passage) + budget + n + 1
    place = np.arange(low, high + 1)
    inside = (place >= 0) & (place <= n)
    cost, start = np.where(inside, 0, far), place.copy()
    padded = np.full(len(passage) + wide, -1, np.int64)
    a, b = max(0, -low), max(0, min(n - low, len(padded)))
    padded[a:b] = text[a + low : b + low]
    for r, c in enumerate(passage.tolist()):
        place = place + 1
        step = cost + (padded[r : r + wide] != c)
        # a passage byte without counterpart: from the next diagonal
        up = np.r_[cost[1:], far] + 1
        step, came = np.where(up < step, up, step), np.where(up < step, np.r_[start[1:], 0], start)
        step[(place < 0) | (place > n)] = far
        if place[0] <= 0 <= place[-1]:
            step[-int(place[0])], came[-int(place[0])] = up[-int(place[0])], np.r_[start[1:], 0][-int(place[0])]
        # a run of document bytes without counterpart: the best of what lies to the left
        key = (step - place) * (wide + 1) + np.arange(wide, 0, -1)
        from_ = wide - np.minimum.accumulate(key) % (wide + 1)
        cost, start = np.minimum(step[from_] + place - place[from_], far), came[from_]
        cost[place > n] = far
        if cost.min() > budget:
            return None
    end = int(cost.argmin())
    return (int(cost[end]), int(start[end]), int(place[end])) if cost[end] <= budget else None


class Passages:
    """A block of passages, ready to be searched for."""

    def __init__(self, items: list[tuple[int, str]]):
        items = [(i, normal(t)) for i, t in items if t and normal(t)]
        self.ids, self.texts = [i for i, _ in items], [t for _, t in items]
        self.short = [k for k, t in enumerate(self.texts) if len(t) < Q]
        self.budget = np.array([len(t) // EDITS_IN for t in self.texts], np.int64)
        self.longest = max(map(len, self.texts), default=0)
        self.spare = np.zeros(len(items), np.int64)
        by: dict[int, list[int]] = {}
        for k, t in enumerate(self.texts):
            if len(t) >= Q:
                by.setdefault(gram_size(len(t)), []).append(k)
        self.indexes = [self.index(q, some) for q, some in sorted(by.items())]

    def index(self, q: int, some: list[int]) -> tuple:
        """(q, sorted grams, their first rows, how many rows each, passage and place of each row, table of hash prefixes)."""
        grams = {k: gram_hashes(np.frombuffer(self.texts[k], np.uint8), q) for k in some}
        every, counts = np.unique(np.concatenate(list(grams.values())), return_counts=True)
        key, item, place = [], [], []
        for k, g in grams.items():
            keep = min(len(g), q * int(self.budget[k]) + max(2, len(self.texts[k]) // 8))
            rare = np.argsort(counts[np.searchsorted(every, g)], kind="stable")[:keep]
            self.spare[k] = keep - q * self.budget[k]
            key.append(g[rare])
            item.append(np.full(keep, k))
            place.append(rare)
        key = np.concatenate(key)
        order = np.argsort(key, kind="stable")
        keys, first, times = np.unique(key[order], return_index=True, return_counts=True)
        table = np.zeros(1 << TABLE, bool)
        table[(keys >> np.uint64(64 - TABLE)).astype(np.int64)] = True
        return q, keys, first, times, np.concatenate(item)[order], np.concatenate(place)[order], table

    def search(self, texts: list[str]) -> list[list[tuple[int, int, int, int]]]:
        """Of each text: (number of the passage, first, end, edits), places in the normal form, in bytes."""
        out: list[dict] = [{} for _ in texts]
        held, owner, begin, size = [], [], [], 0
        overlap = 2 * self.longest + 2
        for i, text in enumerate(texts):
            body = normal(text)
            for k in self.short:
                if (at := body.find(self.texts[k])) >= 0:
                    out[i][k] = (k, at, at + len(self.texts[k]), 0)
            for at in range(0, max(1, len(body) - overlap), SEGMENT):
                piece = body[at : at + SEGMENT + overlap]
                held.append(piece)
                owner.append(i)
                begin.append(at)
                size += len(piece) + 1
                if size >= SEGMENT:
                    self.scan(held, owner, begin, out)
                    held, owner, begin, size = [], [], [], 0
        if held:
            self.scan(held, owner, begin, out)
        return [sorted(o.values()) for o in out]

    def scan(self, held: list[bytes], owner: list[int], begin: list[int], out: list[dict]) -> None:
        data = np.frombuffer(b"\x00".join(held), np.uint8)
        for index in self.indexes:
            if len(data) >= index[0]:
                self.verify(data, index, held, owner, begin, out)

    def verify(self, data: np.ndarray, index: tuple, held: list[bytes], owner: list[int], begin: list[int], out: list[dict]) -> None:
        q, known, first, every, items, places, table = index
        h = gram_hashes(data, q)
        at = np.flatnonzero(table[(h >> np.uint64(64 - TABLE)).astype(np.int64)])
        found = np.minimum(np.searchsorted(known, h[at]), len(known) - 1)
        real = known[found] == h[at]
        at, found = at[real], found[real]
        times = every[found]
        row = np.repeat(first[found] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        item, place, at = items[row], places[row], np.repeat(at, times)
        edges = np.cumsum([0, *[len(p) + 1 for p in held]])
        piece = np.searchsorted(edges, at, "right") - 1
        diagonal = at - edges[piece] - place
        width = np.maximum(self.budget[item], 1)
        band = diagonal // width
        shift = int(band.min(initial=0)) - 1
        span = int(band.max(initial=0)) - shift + 2
        keys = ((np.r_[piece, piece] * len(self.ids) + np.r_[item, item]) * span + np.r_[band, band - 1] - shift) * (self.longest + 1) + np.r_[place, place]
        keys = np.unique(keys) // (self.longest + 1)
        keys, hits = np.unique(keys, return_counts=True)
        band, rest = keys % span + shift, keys // span
        item, piece = rest % len(self.ids), rest // len(self.ids)
        for k, p, b in zip(*(x[hits >= self.spare[item]].tolist() for x in (item, piece, band)), strict=True):
            passage, budget = self.texts[k], int(self.budget[k])
            lo, w = b * max(budget, 1), max(budget, 1)
            region_at = max(0, lo - budget)
            region = held[p][region_at : max(0, lo + 2 * w + len(passage) + budget)]
            diagonals = lo - budget - region_at, lo + 2 * w + budget - region_at
            have = out[owner[p]].get(k)
            if have and have[3] == 0:
                continue
            if (exact := region.find(passage)) >= 0:
                got = (0, exact, exact + len(passage))
            else:
                got = align(np.frombuffer(passage, np.uint8), np.frombuffer(region, np.uint8), *diagonals, budget)
            if got:
                s = begin[p] + region_at
                mine = (k, s + got[1], s + got[2], got[0])
                if not have or (mine[3], mine[1]) < (have[3], have[1]):
                    out[owner[p]][k] = mine


def blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list[tuple[int, str]]]:
    """The passages, at most about BLOCK bytes at a time."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item"), F.col(text_col).alias("body")).where("body is not null")
    n = max(1, -(-int(items.agg(F.coalesce(F.sum(F.octet_length("body")), F.lit(0))).first()[0]) // BLOCK))
    for k in range(n):
        yield [(r.item, r.body) for r in items.where(F.pmod(F.xxhash64("item", "body"), F.lit(n)) == k).collect()]


def searched(rows: DataFrame, text: str, passages: list[tuple[int, str]], use: Callable, ddl) -> DataFrame:
    """use(batch, hits, passages) makes each batch of the result."""
    shared = rows.sparkSession.sparkContext.broadcast(passages)

    def run(batches):
        block = Passages(shared.value)
        for batch in batches:
            if batch.num_rows:
                texts = [t or "" for t in batch.column(batch.schema.get_field_index(text)).to_pylist()]
                yield use(batch, block.search(texts), block)

    return rows.mapInArrow(run, ddl)


MATCHES = "doc_id long,item_id long,start int,end int,edits int"


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and passage in it: (doc_id, item_id, start, end, edits); start and
    end are code points of the normal form of the best place."""
    session(docs)
    rows = text_or_empty(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")), "body")
    schema = arrow_schema(MATCHES)

    def use(batch, hits, block):
        ids, texts, out = batch.column(0).to_pylist(), batch.column(1).to_pylist(), [[], [], [], [], []]
        for i, t, found in zip(ids, texts, hits, strict=True):
            body = normal(t) if found else b""
            for k, s, e, edits in found:
                row = (i, block.ids[k], len(body[:s].decode(errors="ignore")), len(body[:e].decode(errors="ignore")), edits)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, schema, strict=True)], schema=schema)

    result = None
    for passages in blocks(benchmark, item_col, item_text_col):
        part = searched(rows, "body", passages, use, MATCHES)
        result = part if result is None else result.unionByName(part)
    return result


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, that hold no passage."""
    session(docs)

    def use(batch, hits, block):
        return batch.filter(pa.array([not h for h in hits], pa.bool_()))

    for passages in blocks(benchmark, item_col, item_text_col):
        docs = searched(docs, text_col, passages, use, docs.schema)
    return docs
