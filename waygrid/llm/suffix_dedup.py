"""Exact removal of repeated passages through a distributed difference-cover suffix array.

A byte goes if a string of ``window`` bytes that covers it also starts in a document
with a smaller id. Equal windows have equal least grams, so the suffixes are
partitioned by the hash of their window's least gram before they are sorted: equal
windows meet in one bucket, and each bucket sorts its own suffixes by the
difference-cover algorithm (names of sampled triples, recursion on the names until
they differ, merge of the remaining third, comparison of
adjacent prefixes).

0. copy: a text that a smaller document has whole is settled by its digest and leaves.
1. ask: each chunk of texts sends every least gram once, with its smallest document; a bucket
   answers the documents of grams that came from more than one. A gram that a chunk
   has seen in two documents is answered at once, so a gram in a third of all
   documents is one record per chunk.
2. sort: texts meet the answers by chunk (a hash of the id). Runs of windows with a
   repeated least gram go to the gram's bucket as strings, each string once a chunk.
   The bucket builds the suffix array and takes each group of equal windows' smallest
   document.
3. remove: the same chunks of texts (from the same exchange) meet those minima and cut.

Nothing is broadcast or collected. A task holds one chunk or one bucket; their
number follows the input.

Defined cases: null text is empty; a null id neither removes nor loses anything;
rows that repeat an id aren't smaller than each other; texts under ``window`` bytes
stay whole; every input row gives one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, buckets_for, cut, pack, session, stored_bytes, text_or_empty
from .winnow import mix, runs, segments

GRAM = 16
ASK = np.dtype([("f", "<u4"), ("g", "u1"), ("d", "<i8")])
TOLD = np.dtype([("d", "<i8"), ("f", "<u4")])
MINIMA = np.dtype([("s", "<u8"), ("f", "<u8"), ("a", "<u4"), ("b", "<u4"), ("m", "<i8")])
OUT = "doc_id long,n_bytes long,n_removed long,n_spans long,kept_sha256 string"


def slot_of(fp: np.ndarray, n: int) -> np.ndarray:
    """A least gram's bucket; least hashes are small numbers, so they are mixed first."""
    return (mix(fp) >> np.uint64(40)).astype(np.int64) % n


def chunk_of(ids: np.ndarray, n: int) -> np.ndarray:
    return (ids ^ (ids >> 15)) % n


def chunk_column(id_col: str, body: str, n: int) -> Column:
    """chunk_of in SQL; rows without an id go by their text."""
    i = F.coalesce(F.col(id_col), F.xxhash64(body))
    return F.pmod(i.bitwiseXOR(F.shiftright(i, 15)), F.lit(n)).cast("int")


def name_triples(x: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, int]:
    """Dense names (from 1) of the triples of x at the places at; x is padded."""
    top = int(x.max()) + 1
    if top < 1 << 21:
        key = (x[at].astype(np.uint64) * np.uint64(top) + x[at + 1].astype(np.uint64)) * np.uint64(top) + x[at + 2].astype(np.uint64)
        if top <= 128:
            seen = np.zeros(top**3, bool)
            seen[key] = True
            names = np.cumsum(seen)
            return names[key], int(names[-1])
    else:
        pair, _ = name_pairs(x[at], x[at + 1])
        return name_pairs(pair, x[at + 2])
    order = np.argsort(key)
    return ranked(key[order], order)


def name_pairs(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, int]:
    key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
    order = np.argsort(key)
    return ranked(key[order], order)


def ranked(sorted_key: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    new = np.ones(len(order), np.int64)
    new[1:] = sorted_key[1:] != sorted_key[:-1]
    names = np.empty(len(order), np.int64)
    names[order] = np.cumsum(new)
    return names, int(new.sum())


def suffix_order(x: np.ndarray) -> np.ndarray:
    """Places of x in the order of their suffixes. x holds values from 1."""
    n = len(x)
    if n < 3:
        return np.array(sorted(range(n), key=lambda i: x[i:].tolist()), np.int64)
    padded = np.zeros(n + 4, np.int64)
    padded[:n] = x
    at = np.concatenate([np.arange(1, n + (n % 3 == 1), 3), np.arange(2, n, 3)])
    names, most = name_triples(padded, at)
    if most < len(at):
        # the sampled names, first those at 1 modulo 3 and then those at 2, are a text of their own
        order = suffix_order(names)
        rank = np.empty(len(names), np.int64)
        rank[order] = np.arange(1, len(names) + 1)
    else:
        order, rank = np.argsort(names), names
    ranks = np.zeros(n + 4, np.int64)
    ranks[at] = rank
    sampled = at[order]
    sampled = sampled[sampled < n]
    zero = np.arange(0, n, 3)
    key = (padded[zero] << 32) | ranks[zero + 1]
    by = np.argsort(key)
    zero, key = zero[by], key[by]
    is_one = sampled % 3 == 1
    first, second = sampled[is_one], sampled[~is_one]
    before = np.searchsorted((padded[first] << 32) | ranks[first + 1], key)
    names2, _ = name_pairs(np.r_[padded[zero], padded[second]], np.r_[padded[zero + 1], padded[second + 1]])
    wide = (names2 << 32) | np.r_[ranks[zero + 2], ranks[second + 2]]
    before += np.searchsorted(wide[len(zero) :], wide[: len(zero)])
    out = np.empty(n, np.int64)
    taken = before + np.arange(len(zero))
    out[taken] = zero
    rest = np.ones(n, bool)
    rest[taken] = False
    out[rest] = sampled
    return out


def window_groups(text: np.ndarray, valid: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid places in suffix order, and whether each begins a new group of equal windows."""
    used = np.cumsum(np.bincount(text, minlength=256) > 0)
    order = suffix_order(used[text].astype(np.int64))
    order = order[valid[order]]
    padded = np.zeros(len(text) + 8, np.uint64)
    padded[: len(text)] = text
    wide = np.zeros(len(text), np.uint64)
    for j in range(8):
        wide = (wide << np.uint64(8)) | padded[j : j + len(text)]
    new = np.zeros(len(order), bool)
    new[:1] = True
    for at in [*range(0, window - 7, 8), max(0, window - 8)]:
        w = wide[order + at]
        new[1:] |= w[1:] != w[:-1]
    return order, new


def left_over(texts: pa.Table, gone: pa.Table) -> pa.Table:
    """The rows of a chunk that aren't settled as copies."""
    settled = set(zip(gone.column("doc_id").to_pylist(), gone.column("mark").to_pylist(), strict=True))
    if not settled:
        return texts
    return texts.filter(pa.array([k not in settled for k in zip(texts.column("doc_id").to_pylist(), texts.column("mark").to_pylist(), strict=True)], pa.bool_()))


def ask(texts: DataFrame, gone: DataFrame, window: int, slots: int, chunks: int) -> DataFrame:
    """(kind, slot, blob): 0, grams to a bucket; 1, (document, gram) known to be repeated, to a chunk."""
    schema = arrow_schema("kind int,slot int,blob binary")

    def rows(kind, found):
        return [pa.array([kind] * len(found[0]), pa.int32()), pa.array(found[0], pa.int32()), pa.array(found[1], pa.binary())]

    def send(ids: list[int], texts: list[bytes]):
        fps, docs_of = [], []
        for data, owner, _, edges in segments(texts, window):
            fp, piece, _, _ = runs(data, edges, window, GRAM)
            fps.append(fp)
            docs_of.append(np.array(ids, np.int64)[owner[piece]])
        if not fps:
            return
        fp, doc = np.concatenate(fps), np.concatenate(docs_of)
        order = np.lexsort((doc, fp))
        fp, doc = fp[order], doc[order]
        keep = np.ones(len(fp), bool)
        keep[1:] = (fp[1:] != fp[:-1]) | (doc[1:] != doc[:-1])
        fp, doc = fp[keep], doc[keep]
        first = np.ones(len(fp), bool)
        first[1:] = fp[1:] != fp[:-1]
        group = np.cumsum(first) - 1
        many = np.bincount(group)[group] > 1
        out = np.empty(int(first.sum()), ASK)
        out["f"], out["g"], out["d"] = fp[first] & np.uint64(0xFFFFFFFF), (fp[first] >> np.uint64(32)) & np.uint64(0xFF), doc[first]
        yield pa.RecordBatch.from_arrays(rows(0, pack(out, slot_of(fp[first], slots), slots)), schema=schema)
        told = np.empty(int(many.sum()), TOLD)
        told["d"], told["f"] = doc[many], fp[many] & np.uint64(0xFFFFFFFF)
        yield pa.RecordBatch.from_arrays(rows(1, pack(told, chunk_of(told["d"], chunks), chunks)), schema=schema)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows:
            held = [(i, t) for i, t in zip(*texts_of(left_over(left, right)), strict=True) if i is not None and len(t) >= window]
            out = list(send([i for i, _ in held], [t for _, t in held]))
        return pa.Table.from_batches(out, schema)

    return texts.groupBy("chunk").cogroup(gone.groupBy("chunk")).applyInArrow(run, "kind int,slot int,blob binary")


def answer(asked: DataFrame, chunks: int, tasks: int) -> DataFrame:
    """(slot, blob): to each chunk, its documents' grams that other documents hold too."""

    def run(table: pa.Table) -> pa.Table:
        if table.column("kind")[0].as_py():
            return table.select(["slot", "blob"])
        got = np.frombuffer(b"".join(table.column("blob").to_pylist()), ASK)
        key = got["f"].astype(np.uint64) | (got["g"].astype(np.uint64) << np.uint64(32))
        order = np.argsort(key, kind="stable")
        key = key[order]
        same = np.zeros(len(key) + 1, bool)
        same[1:-1] = key[1:] == key[:-1]
        hit = order[same[1:] | same[:-1]]
        told = np.empty(len(hit), TOLD)
        told["d"], told["f"] = got["d"][hit], got["f"][hit]
        slot, blob = pack(told, chunk_of(told["d"], chunks), chunks)
        return pa.table({"slot": pa.array(slot, pa.int32()), "blob": pa.array(blob, pa.binary())})

    return asked.repartition(tasks, "kind", "slot").groupBy("kind", "slot").applyInArrow(run, "slot int,blob binary")


def texts_of(table: pa.Table) -> tuple[list[int | None], list[bytes]]:
    return table.column("doc_id").to_pylist(), table.column("body").cast(pa.binary()).to_pylist()


def strings(texts: DataFrame, told: DataFrame, window: int, slots: int) -> DataFrame:
    """(slot, chunk, blob): runs of windows with a repeated least gram, each string once a chunk."""
    schema = arrow_schema("slot int,chunk int,blob binary")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        chunk = right.column("slot")[0].as_py()
        ids, texts = texts_of(left)
        told = np.frombuffer(b"".join(right.column("blob").to_pylist()), TOLD)
        known, number = np.unique(told["d"], return_inverse=True)
        pairs = np.unique((number.astype(np.uint64) << np.uint64(32)) | told["f"])
        rank = {d: i for i, d in enumerate(known.tolist())}
        held = [(i, t) for i, t in zip(ids, texts, strict=True) if i in rank]
        numbers = np.array([rank[i] for i, _ in held], np.uint64)
        found: dict[tuple[int, int], list] = {}
        for data, owner, _, edges in segments([t for _, t in held], window):
            fp, piece, a, b = runs(data, edges, window, GRAM)
            doc = owner[piece]
            key = (numbers[doc] << np.uint64(32)) | (fp & np.uint64(0xFFFFFFFF))
            at = np.minimum(np.searchsorted(pairs, key), len(pairs) - 1)
            hit = np.flatnonzero(pairs[at] == key)
            raw = data.tobytes()
            for f, d, s, e in zip(fp[hit].tolist(), doc[hit].tolist(), a[hit].tolist(), (b[hit] + window - 1).tolist(), strict=True):
                piece_bytes = raw[s:e]
                k, i = (f, xxhash.xxh64_intdigest(piece_bytes)), held[d][0]
                if x := found.get(k):
                    x[0], x[1] = min(x[0], i), max(x[1], i)
                else:
                    found[k] = [i, i, piece_bytes]
        if not found:
            return schema.empty_table()
        head = np.empty(len(found), HEAD)
        head["f"], head["s"] = np.array([k for k, _ in found], np.uint64), np.array([s for _, s in found], np.uint64)
        head["lo"], head["hi"], head["n"] = [x[0] for x in found.values()], [x[1] for x in found.values()], [len(x[2]) for x in found.values()]
        body = [x[2] for x in found.values()]
        slot = slot_of(head["f"], slots)
        out_slot, out_blob = [], []
        order = np.argsort(slot, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(slot[order])) + 1):
            out_slot.append(int(slot[part[0]]))
            out_blob.append(len(part).to_bytes(4, "little") + head[part].tobytes() + b"".join([body[i] for i in part]))
        return pa.table([pa.array(out_slot, pa.int32()), pa.array([chunk] * len(out_slot), pa.int32()), pa.array(out_blob, pa.binary())], schema=schema)

    return texts.groupBy("chunk").cogroup(told.groupBy("slot")).applyInArrow(run, "slot int,chunk int,blob binary")


HEAD = np.dtype([("f", "<u8"), ("s", "<u8"), ("lo", "<i8"), ("hi", "<i8"), ("n", "<u4")])


def minima(sent: DataFrame, window: int, tasks: int) -> DataFrame:
    """(chunk, blob): of each chunk's strings, the runs of windows that a smaller document than the chunk's largest holds."""

    def run(table: pa.Table) -> pa.Table:
        heads, bodies, chunks = [], [], []
        for chunk, blob in zip(table.column("chunk").to_pylist(), table.column("blob").to_pylist(), strict=True):
            n = int.from_bytes(blob[:4], "little")
            heads.append(np.frombuffer(blob, HEAD, n, 4))
            bodies.append(blob[4 + n * HEAD.itemsize :])
            chunks.append(np.full(n, chunk, np.int64))
        head, chunk, raw = np.concatenate(heads), np.concatenate(chunks), np.frombuffer(b"".join(bodies), np.uint8)
        begin = np.cumsum(head["n"].astype(np.int64)) - head["n"]
        _, first, which = np.unique(head["s"], return_index=True, return_inverse=True)
        low, high = np.full(len(first), np.iinfo(np.int64).max), np.full(len(first), np.iinfo(np.int64).min)
        np.minimum.at(low, which, head["lo"])
        np.maximum.at(high, which, head["hi"])
        size = head["n"][first].astype(np.int64)
        ends = np.cumsum(size)
        text = raw[np.repeat(begin[first] - (ends - size), size) + np.arange(ends[-1])]
        owner = np.repeat(np.arange(len(first)), size)
        valid = np.arange(len(text)) + window <= ends[owner]
        order, new = window_groups(text, valid, window)
        starts = np.flatnonzero(new)
        least = np.minimum.reduceat(low[owner[order]], starts)
        best = np.empty(len(text), np.int64)
        best[order] = least[np.cumsum(new) - 1]
        # runs of windows of one string with one minimum, if anyone is above it
        place = np.flatnonzero(valid)
        who, value = owner[place], best[place]
        cut = np.ones(len(place), bool)
        cut[1:] = (who[1:] != who[:-1]) | (value[1:] != value[:-1])
        a = np.flatnonzero(cut)
        b = np.r_[a[1:], len(place)]
        keep = value[a] < high[who[a]]
        a, b = a[keep], b[keep]
        who, value, begin_at = who[a], value[a], place[a] - (ends - size)[who[a]]
        length = b - a
        # each record of a string gets the string's runs
        per = np.bincount(who, minlength=len(first))
        run_at = np.cumsum(per) - per
        times = per[which]
        record = np.repeat(np.arange(len(head)), times)
        run_no = np.repeat(run_at[which] - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))
        useful = value[run_no] < head["hi"][record]
        record, run_no = record[useful], run_no[useful]
        out = np.empty(len(record), MINIMA)
        out["s"], out["f"], out["a"], out["b"], out["m"] = head["s"][record], head["f"][record], begin_at[run_no], begin_at[run_no] + length[run_no], value[run_no]
        ids, blobs = pack(out, chunk[record], int(chunk.max()) + 1)
        return pa.table({"chunk": pa.array(ids, pa.int32()), "blob": pa.array(blobs, pa.binary())})

    return sent.repartition(tasks, "slot").groupBy("slot").applyInArrow(run, "chunk int,blob binary")


def remove(texts: DataFrame, low: DataFrame, settled: DataFrame, window: int) -> DataFrame:
    """One row of OUT per text that isn't settled as a copy."""
    schema = arrow_schema(OUT)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return schema.empty_table()
        settled = right.filter(pc.is_null(right.column("blob")))
        right = right.filter(pc.is_valid(right.column("blob")))
        ids, texts = texts_of(left_over(left, settled))
        gone: list[list[tuple[int, int]]] = [[] for _ in ids]
        got = np.frombuffer(b"".join(right.column("blob").to_pylist()), MINIMA)
        if len(got):
            got = got[np.argsort(got["s"], kind="stable")]
            grams = np.unique(got["f"])
            usable = [t if i is not None else b"" for i, t in zip(ids, texts, strict=True)]
            for data, owner, begin, edges in segments(usable, window):
                fp, piece, a, b = runs(data, edges, window, GRAM)
                at = np.minimum(np.searchsorted(grams, fp), len(grams) - 1)
                hit = np.flatnonzero(grams[at] == fp)
                if not len(hit):
                    continue
                raw = data.tobytes()
                key = np.array([xxhash.xxh64_intdigest(raw[s:e]) for s, e in zip(a[hit].tolist(), (b[hit] + window - 1).tolist(), strict=True)], np.uint64)
                lo, hi = np.searchsorted(got["s"], key), np.searchsorted(got["s"], key, "right")
                times = hi - lo
                which = np.repeat(hit, times)
                row = got[np.repeat(lo - (np.cumsum(times) - times), times) + np.arange(int(times.sum()))]
                doc = owner[piece[which]]
                mine = np.array([i if i is not None else 0 for i in ids], np.int64)[doc]
                use = row["m"] < mine
                start = a[which] - edges[piece[which]] + begin[piece[which]]
                for d, s, e in zip(doc[use].tolist(), (start + row["a"])[use].tolist(), (start + row["b"] + window - 1)[use].tolist(), strict=True):
                    gone[d].append((s, e))
        rows = [[], [], [], [], []]
        for i, text, cuts in zip(ids, texts, gone, strict=True):
            kept, spans, at = [], 0, 0
            last = -1
            for s, e in sorted(cuts):
                if s > last:
                    kept.append(text[at:s])
                    spans += 1
                    last = at = e
                elif e > last:
                    last = at = e
            kept.append(text[at:])
            rest = b"".join(kept)
            for c, v in zip(rows, (i, len(text), len(text) - len(rest), spans, hashlib.sha256(rest).hexdigest()), strict=True):
                c.append(v)
        return pa.table([pa.array(c, f.type) for c, f in zip(rows, schema, strict=True)], schema=schema)

    right = low.unionByName(settled, allowMissingColumns=True)
    return texts.groupBy("chunk").cogroup(right.groupBy("chunk")).applyInArrow(run, OUT)


def copies(rows: DataFrame, window: int) -> DataFrame:
    """Rows whose whole text is also a document with a smaller id's: they lose every byte. A row per input row."""
    marks = rows.where("doc_id is not null").select("chunk", "doc_id", "mark", F.octet_length("body").cast("long").alias("n_bytes")).where(F.col("n_bytes") >= window)
    first = marks.groupBy("mark").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("mark", "first")
    return marks.join(first, "mark").where("doc_id > first")


def suffix_dedup(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    spark = session(docs)
    size = stored_bytes(docs)
    slots, chunks = buckets_for(2 * size), buckets_for(size) | 1
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = text_or_empty(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")), "body")
    rows = rows.select(chunk_column("doc_id", "body", chunks).alias("chunk"), "doc_id", "body", F.md5(F.col("body").cast("binary")).alias("mark"))
    gone = cut(copies(rows, window))
    # one exchange of the texts, by chunk, serves all three meetings
    settled = gone.select("chunk", "doc_id", "mark").distinct()
    told = answer(ask(rows, settled, window, slots, chunks), chunks, tasks)
    low = minima(strings(rows, told, window, slots), window, tasks)
    whole = gone.select("doc_id", "n_bytes", F.col("n_bytes").alias("n_removed"), F.lit(1).cast("long").alias("n_spans"), F.sha2(F.lit(""), 256).alias("kept_sha256"))
    return remove(rows, low, settled, window).unionByName(whole)
