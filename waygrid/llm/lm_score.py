"""Language-model scores by a weighted backoff automaton.

The model is an absolutely discounted bigram model that backs off to add-one word
probabilities (which are also the base score). Its automaton has a state per context,
an arc per kept bigram and a failure arc per state; a failure costs the state's
backoff weight and leads to the root, which reads every word. The state after a word
depends on that word alone, so one left-to-right traversal is a shift and a lookup.

Counts cover all training text, and every bigram of at least `least` occurrences has an
arc, at any size of the corpus (`least` is 1 or a small constant). Only words and bigrams whose share of the training
tokens is over SHARE are collected and broadcast, at most 1/SHARE of each, so that no
bucket meets a very common key. All others stay distributed: a bigram lives in the
bucket of its context if that is rare, else of its word if that is rare, else of its
own hash, and each task of the scoring pass asks those buckets for arcs and the bucket
of each rare word for its count and backoff. The answers return to that task's documents.

Words and bigrams are known by 56-bit hashes, which travel in seven bytes; counts of
bigrams travel by context, so that a context's hash goes once per batch and bucket.

Documents of one task are numbered as they come, so an input that is itself the result
of a shuffle is written first: a lost task's rows then come back in the same order.

Defined cases: a null text is empty and scores its end token alone; a null id counts
as the empty string where ids are hashed; rows that repeat are trained on and scored
one by one; with an empty table nothing is returned.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, discard, pack, release, session, stored_bytes, text_or_empty
from .winnow import join, mix
from .words import WordHashes

SHARE = 2e-6
DISCOUNT = 0.75
END, START = np.uint64(0x5EED), np.uint64(0x57A7)
#: Tokens that a batch gathers before it sends counts, and stored bytes for which one bucket is planned.
BATCH, BUCKET = 1 << 21, 16 << 20
#: Of a hash, the bits that are kept.
KEPT = np.uint64((1 << 56) - 1)
#: Of a bigram's hash, the bits by which a bucket, whose size is bounded, knows its arcs.
KEY = np.uint64((1 << 48) - 1)
COUNT = np.dtype([("h", "<u8"), ("c", "<u4")])
TOTAL = np.dtype([("h", "<u8"), ("c", "<u8")])
ASK = np.dtype([("h", "<u8"), ("row", "<u4"), ("n", "<u4")])
TELL = np.dtype([("row", "<u4"), ("known", "<u4"), ("base", "<f8"), ("more", "<f8")])
GAIN = np.dtype([("row", "<u4"), ("more", "<f8")])
PAIR = np.dtype([("a", "<u8"), ("w", "<u8"), ("c", "<u4")])
PAIR_ASK = np.dtype([("key", "<u8"), ("row", "<u4")])
#: A bigram's arc less what its context, if frequent (number), takes off.
ARC = np.dtype([("key", "<u8"), ("number", "<i4"), ("gain", "<f8")])
FAIL = np.dtype([("h", "<u8"), ("fail", "<f8")])
SUMS = np.dtype([("number", "<u4"), ("held", "<f8"), ("below", "<f8")])
#: Rows of the model: what the blob holds.
WORDS, ARCS, FAILS, HOT, PARTS = range(5)


def slot_of(h: np.ndarray, n: int) -> np.ndarray:
    return (mix(h) >> np.uint64(40)).astype(np.int64) % n


def tokens(hashes: WordHashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts, an end after each, and where each text's tokens end."""
    parts = []
    for t in texts:
        parts += (hashes.of(t) & KEPT, END_ARRAY)
    sizes = np.array([len(p) + 1 for p in parts[::2]], np.int64)
    return np.concatenate(parts), np.cumsum(sizes)


END_ARRAY = np.array([END])


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.ones(len(keys), bool)
    first[1:] = keys[1:] != keys[:-1]
    starts = np.flatnonzero(first)
    return keys[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def pair_hash(a: np.ndarray, w: np.ndarray) -> np.ndarray:
    return join(mix(a), w) & KEPT


def contexts_of(h: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The word before each token, START before the first."""
    out = np.empty(len(h), np.uint64)
    out[1:] = h[:-1]
    out[np.r_[0, ends[:-1]]] = START
    return out


def found(keys: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Places of h in the sorted keys, -1 for others."""
    if not len(keys):
        return np.full(len(h), -1)
    at = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
    return np.where(keys[at] == h, at, -1)


class Automaton:
    """What is broadcast: frequent words with their backoffs and frequent bigrams, at most 1/SHARE of each."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, total: int, types: int, texts: int):
        self.norm = float(total + types + 1)
        words, counts = np.append(words, START), np.append(counts, np.uint64(texts))
        order = np.argsort(words)
        self.words, self.counts = words[order], counts[order].astype(np.float64)
        self.log1 = self.base(self.counts)
        self.keys, self.arcs = np.empty(0, np.uint64), np.empty(0)
        self.fail = self.taken = np.zeros(len(words) + 1)  # at -1 is nothing

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 1) / self.norm)

    def numbers(self, h: np.ndarray) -> np.ndarray:
        return found(self.words, h)

    def slots(self, a: np.ndarray, w: np.ndarray, key: np.ndarray, slots: int) -> np.ndarray:
        """The bucket of each bigram: no key that many tokens share decides it."""
        return slot_of(np.where(self.numbers(a) < 0, a, np.where(self.numbers(w) < 0, w, key)), slots)

    def back_off(self, held: np.ndarray, below: np.ndarray) -> None:
        """From the frequent contexts' sums over their arcs."""
        self.fail = np.append(backoff(held, below), 0.0)
        self.taken = self.fail + np.append(np.log10(np.maximum(self.counts, 1)), 0.0)

    def add(self, arcs: np.ndarray) -> None:
        arcs = arcs[np.argsort(arcs["key"])]
        self.keys, self.arcs = arcs["key"].copy(), arcs["gain"] - self.taken[arcs["number"]]


def backoff(held: np.ndarray, below: np.ndarray) -> np.ndarray:
    return np.where(held > 0, np.log10(np.maximum(1 - held, 1e-12) / np.maximum(1 - below, 1e-12)), 0.0)


def gathered(rows: DataFrame, slots: int) -> DataFrame:
    """(slot, blob) of COUNT: the batch's words."""
    schema = arrow_schema("slot int,blob binary")

    def run(batches):
        hashes, held, size = WordHashes(), [], 0

        def send():
            keys, counts = np.unique(np.concatenate(held), return_counts=True)
            out = np.empty(len(keys), COUNT)
            out["h"], out["c"] = keys, counts
            slot, blob = pack(out, slot_of(keys, slots), slots)
            return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(blob, pa.binary())], schema=schema)

        for batch in batches:
            if batch.num_rows:
                keys = tokens(hashes, batch.column(0).cast(pa.binary()).to_pylist())[0]
                held.append(keys)
                size += len(keys)
                if size >= BATCH:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return rows.select("body").mapInArrow(run, "slot int,blob binary")


def short(h: np.ndarray, wide: int = 7) -> bytes:
    return np.ascontiguousarray(np.ascontiguousarray(h).view(np.uint8).reshape(-1, 8)[:, :wide]).tobytes()


def from_short(blob: bytes, n: int, place: int, wide: int = 7) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :wide] = np.frombuffer(blob, np.uint8, wide * n, place).reshape(-1, wide)
    return out.view(np.uint64)[:, 0]


def widths(dtype: np.dtype) -> list[int]:
    return [6 if f == "key" else 7 if dtype[f] == np.uint64 else dtype[f].itemsize for f in dtype.names]


def columns(records: np.ndarray) -> bytes:
    """The fields one after another, which shuffles compress better than records; hashes without their empty bytes."""
    return b"".join(short(records[f], k) if records.dtype[f] == np.uint64 else np.ascontiguousarray(records[f]).tobytes() for f, k in zip(records.dtype.names, widths(records.dtype), strict=True))


def from_columns(blobs: list[bytes], dtype: np.dtype) -> np.ndarray:
    wide = widths(dtype)
    out, at = np.empty(sum(len(b) // sum(wide) for b in blobs), dtype), 0
    for blob in blobs:
        n, place = len(blob) // sum(wide), 0
        for f, k in zip(dtype.names, wide, strict=True):
            out[f][at : at + n] = from_short(blob, n, place, k) if dtype[f] == np.uint64 else np.frombuffer(blob, dtype[f], n, place)
            place += n * k
        at += n
    return out


def by_context(pairs: np.ndarray) -> bytes:
    """PAIR records as their number of contexts, the contexts, the number of words of each, words and counts."""
    pairs = pairs[np.argsort(pairs["a"], kind="stable")]
    starts = np.flatnonzero(np.r_[True, pairs["a"][1:] != pairs["a"][:-1]])
    sizes = np.diff(np.r_[starts, len(pairs)]).astype("<u4")
    return np.uint32(len(starts)).tobytes() + short(pairs["a"][starts]) + sizes.tobytes() + short(pairs["w"]) + pairs["c"].tobytes()


def from_contexts(blobs: list[bytes]) -> np.ndarray:
    parts = []
    for blob in blobs:
        k = int(np.frombuffer(blob, "<u4", 1)[0])
        sizes = np.frombuffer(blob, "<u4", k, 4 + 7 * k)
        n, at = int(sizes.sum()), 4 + 11 * k
        part = np.empty(n, PAIR)
        part["a"], part["w"], part["c"] = np.repeat(from_short(blob, k, 4), sizes), from_short(blob, n, at), np.frombuffer(blob, "<u4", n, at + 7 * n)
        parts.append(part)
    return np.concatenate(parts) if parts else np.empty(0, PAIR)


def bigrams(rows: DataFrame, shared, slots: int) -> DataFrame:
    """(slot, blob) of PAIR by context, once per bigram of a batch."""
    schema = arrow_schema("slot int,blob binary")

    def run(batches):
        hashes, model, held, size = WordHashes(), shared.value, [], 0

        def send():
            a, w = (np.concatenate(x) for x in zip(*held, strict=True))
            key, first, counts = np.unique(pair_hash(a, w), return_index=True, return_counts=True)
            out = np.empty(len(key), PAIR)
            out["a"], out["w"], out["c"] = a[first], w[first], counts
            slot, blob = pack(out, model.slots(out["a"], out["w"], key, slots), slots)
            return pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array([by_context(np.frombuffer(b, PAIR)) for b in blob], pa.binary())], schema=schema)

        for batch in batches:
            if batch.num_rows:
                h, ends = tokens(hashes, batch.column(0).cast(pa.binary()).to_pylist())
                held.append((contexts_of(h, ends), h))
                size += len(h)
                if size >= BATCH:
                    yield send()
                    held, size = [], 0
        if held:
            yield send()

    return rows.select("body").mapInArrow(run, "slot int,blob binary")


def pair_totals(sent: DataFrame, tasks: int, least: int) -> DataFrame:
    """(slot, blob) of the bigrams of at least least occurrences, PAIR."""

    def run(table: pa.Table) -> pa.Table:
        got = from_contexts(table.column("blob").to_pylist())
        key = pair_hash(got["a"], got["w"])
        order = np.argsort(key, kind="stable")
        key, got = key[order], got[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        out = got[starts]
        out["c"] = np.add.reduceat(got["c"], starts)
        return pa.table({"slot": table.column("slot")[:1].cast(pa.int32()), "blob": pa.array([out[out["c"] >= least].tobytes()], pa.binary())})

    return sent.repartition(tasks, "slot").groupBy("slot").applyInArrow(run, "slot int,blob binary")


def rare_words(pairs: DataFrame, counted: DataFrame, shared, slots: int) -> DataFrame:
    """(slot, kind, blob): for each bucket of bigrams, the counts of the rare words that stand behind rare contexts."""

    def ask(batches):
        model = shared.value
        for batch in batches:
            for back, blob in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                got = np.frombuffer(blob, PAIR)
                w = np.unique(got["w"][(model.numbers(got["a"]) < 0) & (model.numbers(got["w"]) < 0)])
                slot, parts = pack(w, slot_of(w, slots), slots)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array([back] * len(slot), pa.int32()), pa.array(parts, pa.binary())], names=["slot", "back", "blob"])

    def tell(left: pa.Table, right: pa.Table) -> pa.Table:
        have, out = np.frombuffer(b"".join(right.column("blob").to_pylist()), TOTAL), []
        for blob in left.column("blob").to_pylist():
            out.append(have[found(have["h"], np.frombuffer(blob, "<u8"))].tobytes())
        return pa.table({"slot": left.column("back").cast(pa.int32()), "blob": pa.array(out, pa.binary())})

    asked = pairs.mapInArrow(ask, "slot int,back int,blob binary")
    return asked.groupBy("slot").cogroup(counted.select("slot", "blob").groupBy("slot")).applyInArrow(tell, "slot int,blob binary")


def arcs_of(pairs: DataFrame, counts: DataFrame, shared, hot: float) -> DataFrame:
    """(slot, what, blob): ARCS, the backoffs of rare contexts (FAILS), frequent bigrams (HOT) and the sums of frequent contexts (PARTS)."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        model, out = shared.value, []
        got = np.frombuffer(b"".join(left.column("blob").to_pylist()), PAIR)
        have = np.frombuffer(b"".join(right.column("blob").to_pylist()), TOTAL)
        have = have[np.argsort(have["h"], kind="stable")]
        if len(got):
            a, w = model.numbers(got["a"]), model.numbers(got["w"])

            def count(number, h):
                return np.where(number >= 0, model.counts[number], have["c"][found(have["h"], h)] if len(have) else 0)

            context, c = count(a, got["a"]), got["c"] - DISCOUNT
            log1 = model.base(count(w, got["w"]))
            arc = np.empty(len(got), ARC)
            arc["key"], arc["number"], arc["gain"] = pair_hash(got["a"], got["w"]) & KEY, a, np.log10(c) - log1
            rare = a < 0
            if rare.any():
                h, which = np.unique(got["a"][rare], return_inverse=True)
                fail = np.empty(len(h), FAIL)
                fail["h"], fail["fail"] = h, backoff(np.bincount(which, c[rare] / context[rare]), np.bincount(which, 10.0 ** log1[rare]))
                arc["gain"][rare] -= np.log10(context[rare]) + fail["fail"][which]
                out.append((FAILS, fail))
            if not rare.all():
                number, which = np.unique(a[~rare], return_inverse=True)
                part = np.empty(len(number), SUMS)
                part["number"], part["held"], part["below"] = number, np.bincount(which, c[~rare] / context[~rare]), np.bincount(which, 10.0 ** log1[~rare])
                out.append((PARTS, part))
            often = got["c"] > hot
            out += [(ARCS, arc[~often]), (HOT, arc[often])]
        slot = left.column("slot")[0].as_py() if left.num_rows else 0
        return pa.table({"slot": pa.array([slot] * len(out), pa.int32()), "what": pa.array([k for k, _ in out], pa.int32()), "blob": pa.array([columns(x) if k in (ARCS, HOT) else x.tobytes() for k, x in out], pa.binary())})

    return pairs.groupBy("slot").cogroup(counts.groupBy("slot")).applyInArrow(run, "slot int,what int,blob binary")


def frequent_sums(model_rows: DataFrame, size: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """The sums of the frequent contexts by number, on the driver."""

    def deal(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                got = np.frombuffer(blob, SUMS)
                slot, parts = pack(got, got["number"].astype(np.int64) % slots, slots)
                yield pa.RecordBatch.from_arrays([pa.array(slot, pa.int32()), pa.array(parts, pa.binary())], names=["slot", "blob"])

    def add(table: pa.Table) -> pa.Table:
        got = np.frombuffer(b"".join(table.column("blob").to_pylist()), SUMS)
        number, which = np.unique(got["number"], return_inverse=True)
        out = np.empty(len(number), SUMS)
        out["number"], out["held"], out["below"] = number, np.bincount(which, got["held"]), np.bincount(which, got["below"])
        return pa.table({"blob": pa.array([out.tobytes()], pa.binary())})

    sent = model_rows.where(F.col("what") == PARTS).select("blob").mapInArrow(deal, "slot int,blob binary")
    got = np.frombuffer(b"".join(r.blob for r in sent.groupBy("slot").applyInArrow(add, "blob binary").collect()), SUMS)
    held, below = np.zeros(size), np.zeros(size)
    held[got["number"]], below[got["number"]] = got["held"], got["below"]
    return held, below


def totals(sent: DataFrame, tasks: int) -> DataFrame:
    """A row per slot: its number of keys, the sum of their counts, keys and counts (TOTAL)."""

    def run(table: pa.Table) -> pa.Table:
        got = np.frombuffer(b"".join(table.column("blob").to_pylist()), COUNT)
        keys, counts = summed(got["h"], got["c"].astype(np.uint64))
        out = np.empty(len(keys), TOTAL)
        out["h"], out["c"] = keys, counts
        return pa.table({"slot": table.column("slot")[:1], "types": pa.array([len(keys)], pa.int64()), "total": pa.array([int(counts.sum())], pa.int64()), "blob": pa.array([out.tobytes()], pa.binary())})

    return sent.repartition(tasks, "slot").groupBy("slot").applyInArrow(run, "slot int,types long,total long,blob binary")


def frequent(counted: DataFrame, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Keys and counts over least, on the driver: at most 1/SHARE."""

    def run(batches):
        for batch in batches:
            for blob in batch.column(0).to_pylist():
                got = np.frombuffer(blob, TOTAL)
                yield pa.RecordBatch.from_arrays([pa.array([got[got["c"] > least].tobytes()], pa.binary())], names=["blob"])

    got = np.frombuffer(b"".join(r.blob for r in counted.select("blob").mapInArrow(run, "blob binary").collect()), TOTAL)
    return got["h"], got["c"]


ROWS = "kind int,slot int,chunk int,doc_id long,held_out boolean,n_tokens long,known long,base double,score double,blob binary"


def scored(rows: DataFrame, shared, slots: int) -> DataFrame:
    """Kind 1, a text with the sums over its frequent words and bigrams, in row order by chunk; 0, its other words, and 2, its other bigrams, to their bucket."""
    schema = arrow_schema(ROWS)

    def run(batches):
        hashes, model, chunk = WordHashes(), shared.value, TaskContext.get().partitionId()
        row, asked, held, wanted, waiting = 0, [], 0, [], 0

        def table(kind, n, **columns):
            return pa.RecordBatch.from_arrays([pa.array(columns.get(f.name, [kind if f.name == "kind" else chunk if f.name == "chunk" else None] * n), f.type) for f in schema], schema=schema)

        def send():
            got = np.concatenate(asked)
            slot, blob = pack(got, slot_of(got["h"], slots), slots)
            return table(0, len(slot), slot=slot, blob=[columns(np.frombuffer(b, ASK)) for b in blob])

        def send_pairs():
            got, where = (np.concatenate(x) for x in zip(*wanted, strict=True))
            slot, blob = pack(got, where, slots)
            return table(2, len(slot), slot=slot, blob=[columns(np.frombuffer(b, PAIR_ASK)) for b in blob])

        for batch in batches:
            if not batch.num_rows:
                continue
            h, ends = tokens(hashes, batch.column(2).cast(pa.binary()).to_pylist())
            n = len(ends)
            number = model.numbers(h)
            doc = np.repeat(np.arange(n), np.diff(np.r_[0, ends]))
            has = number >= 0
            base = np.bincount(doc[has], model.log1[number[has]], n) if has.any() else np.zeros(n)
            context = contexts_of(h, ends)
            key = pair_hash(context, h)
            at = found(model.keys, key & KEY)
            gain = model.fail[model.numbers(context)]
            gain[at >= 0] += model.arcs[at[at >= 0]]
            beyond = np.bincount(doc, gain, n)
            other = np.flatnonzero(at < 0)
            if len(other):
                out = np.empty(len(other), PAIR_ASK)
                out["key"], out["row"] = key[other] & KEY, row + doc[other]
                wanted.append((out, model.slots(context[other], h[other], key[other], slots)))
                waiting += len(out)
                if waiting >= BATCH // 4:
                    yield send_pairs()
                    wanted, waiting = [], 0
            yield table(1, n, slot=[(chunk * 31 + row // 64) % slots] * n, doc_id=batch.column(0), held_out=batch.column(1), n_tokens=np.diff(np.r_[0, ends]), known=np.bincount(doc[has], minlength=n), base=base, score=beyond, blob=[(row + i).to_bytes(4, "little") for i in range(n)])
            rare = np.flatnonzero(~has)
            if len(rare):
                order = rare[np.lexsort((h[rare], doc[rare]))]
                first = np.ones(len(order), bool)
                first[1:] = (h[order][1:] != h[order][:-1]) | (doc[order][1:] != doc[order][:-1])
                at = np.flatnonzero(first)
                out = np.empty(len(at), ASK)
                out["h"], out["row"], out["n"] = h[order[at]], row + doc[order[at]], np.diff(np.r_[at, len(order)])
                asked.append(out)
                held += len(out)
                if held >= BATCH // 4:
                    yield send()
                    asked, held = [], 0
            row += n
        if held:
            yield send()
        if waiting:
            yield send_pairs()

    return rows.select("doc_id", "held_out", "body").mapInArrow(run, ROWS)


def answered(sent: DataFrame, have: DataFrame, shared) -> DataFrame:
    """The texts' rows, and the sums over their other words (kind 0) and bigrams (2) by chunk."""
    schema = arrow_schema(ROWS)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        kind = left.column("kind")[0].as_py() if left.num_rows else 1
        if kind == 1:
            return left.select([f.name for f in schema])
        model, what, held = shared.value, right.column("what").to_pylist(), right.column("blob").to_pylist()
        of = lambda k, dtype: np.sort(np.frombuffer(b"".join([b for b, w in zip(held, what, strict=True) if w == k]), dtype), order="h")
        words, fails = of(WORDS, TOTAL), of(FAILS, FAIL)
        arcs = np.sort(from_columns([b for b, w in zip(held, what, strict=True) if w == ARCS], ARC), order="key")
        gains = arcs["gain"] - model.taken[arcs["number"]]

        def sums(blobs):
            if kind == 2:
                got = from_columns(blobs, PAIR_ASK)
                at = found(arcs["key"], got["key"])
                hit = at >= 0
                row, which = np.unique(got["row"][hit], return_inverse=True)
                out = np.empty(len(row), GAIN)
                out["row"], out["more"] = row, np.bincount(which, gains[at[hit]], len(row))
                return out
            got = from_columns(blobs, ASK)
            at, back = found(words["h"], got["h"]), found(fails["h"], got["h"])
            c, fail = np.zeros(len(got)), np.zeros(len(got))
            c[at >= 0], fail[back >= 0] = words["c"][at[at >= 0]], fails["fail"][back[back >= 0]]
            row, which = np.unique(got["row"], return_inverse=True)
            out = np.empty(len(row), TELL)
            out["row"], out["known"], out["base"], out["more"] = row, np.bincount(which, got["n"] * (c > 0)), np.bincount(which, got["n"] * model.base(c)), np.bincount(which, got["n"] * fail)
            return out

        chunks, blobs = left.column("chunk").to_numpy(), left.column("blob").to_pylist()
        out_chunk, out_blob = [], []
        order = np.argsort(chunks, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(chunks[order])) + 1):
            out_chunk.append(int(chunks[part[0]]))
            out_blob.append(columns(sums([blobs[i] for i in part])))
        n = len(out_chunk)
        return pa.table([pa.array({"kind": [kind] * n, "chunk": out_chunk, "blob": out_blob}.get(f.name, [None] * n), f.type) for f in schema], schema=schema)

    return sent.groupBy("kind", "slot").cogroup(have.groupBy("kind", "slot")).applyInArrow(run, ROWS)


OUT = "doc_id long,held_out boolean,n_tokens long,n_known long,train_tokens long,base_score double,score double"


def put_together(rows: DataFrame, total: int) -> DataFrame:
    schema = arrow_schema(OUT)

    def run(table: pa.Table) -> pa.Table:
        import pyarrow.compute as pc

        texts, told, gained = (table.filter(pc.equal(table["kind"], k)) for k in (1, 0, 2))
        n = texts.num_rows
        row = np.frombuffer(b"".join(texts["blob"].to_pylist()), "<u4").astype(np.int64)
        got, more = from_columns(told["blob"].to_pylist(), TELL), from_columns(gained["blob"].to_pylist(), GAIN)
        size = int(row.max(initial=-1)) + 1
        known = texts["known"].to_numpy() + np.bincount(got["row"], got["known"], size)[row].astype(np.int64)
        base = texts["base"].to_numpy() + np.bincount(got["row"], got["base"], size)[row]
        beyond = texts["score"].to_numpy() + (np.bincount(got["row"], got["more"], size) + np.bincount(more["row"], more["more"], size))[row]
        return pa.table([texts["doc_id"], texts["held_out"], texts["n_tokens"], pa.array(known, pa.int64()), pa.array(np.full(n, total), pa.int64()), pa.array(base), pa.array(base + beyond)], schema=schema)

    return rows.groupBy("chunk").applyInArrow(run, OUT)


def held_out_by_id(id_col: str, modulus: int, rest: int) -> Column:
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % modulus == rest


def lm_score(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", least: int = 2) -> DataFrame:
    """One row per input row; the model learns from rows where held_out is false and keeps bigrams of at least least occurrences."""
    spark = session(docs)
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    slots = max(tasks, stored_bytes(docs) // BUCKET)
    rows = text_or_empty(docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("body")), "body")
    if "Exchange" in rows._jdf.queryExecution().executedPlan().toString():
        rows = cut(rows)
    train = rows.where(~F.col("held_out"))
    counted = cut(totals(gathered(train, slots), tasks))
    total, types = counted.agg(F.coalesce(F.sum("total"), F.lit(0)), F.coalesce(F.sum("types"), F.lit(0))).first()
    words, counts = frequent(counted, SHARE * total)
    model = Automaton(words, counts, total, types, int(counts[words == END].sum()))
    shared = spark.sparkContext.broadcast(model)
    pairs = cut(pair_totals(bigrams(train, shared, slots), tasks, least))
    known = counted.select("slot", "blob").unionByName(rare_words(pairs, counted, shared, slots))
    learnt = cut(arcs_of(pairs, known, shared, SHARE * total))
    model.back_off(*frequent_sums(learnt, len(model.words), slots))
    model.add(from_columns([r.blob for r in learnt.where(F.col("what") == HOT).select("blob").collect()], ARC))
    discard(pairs)
    del pairs, known
    release(spark)
    whole = spark.sparkContext.broadcast(model)
    have = counted.select(F.lit(0).alias("kind"), "slot", F.lit(WORDS).alias("what"), "blob").unionByName(
        learnt.where(F.col("what").isin(ARCS, FAILS)).select(F.when(F.col("what") == ARCS, 2).otherwise(0).alias("kind"), "slot", "what", "blob")
    )
    return put_together(answered(scored(rows, whole, slots), have, whole), total)
