"""Language identification: script ranges, then Viterbi over per-word scores.

Learning counts, over all training text, the letters of each script and the byte
n-grams (ORDERS, within words and their borders) of each language. n-grams are
hashed to FEATURES numbers, so the model is one row of FEATURES floats a language,
whatever the size of the corpus. Each task sends a language's counts in slices; a slice
is summed over groups of tasks first and over the FEW groups after that.

Prediction: a word's script narrows the candidates to languages that use the script
for at least SHARE of their letters (if there are none, all stay); its score for a
candidate is the sum of log-probabilities of its n-grams. Viterbi with a switching
penalty labels every word of the whole text; runs of one label are the spans. The
label that covers most letters is the prediction, its share of the letters the score.

Batches of texts go through Viterbi in step, a word of each text at a time.

Defined cases: null text or text without letters is ``und`` with score 0, as is every
text when there is nothing to learn from; ties go to the language that sorts first;
null ids are kept and count as the empty string where ids are hashed.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, session, text_or_empty
from .winnow import mix

FEATURES, SLICE = 1 << 15, 1 << 11
ORDERS = (2, 3, 4)
SHARE, PENALTY, SMOOTH = 0.01, 10.0, 0.5
CACHE, TOKENS = 300_000, 1 << 21
#: Groups of tasks whose counts are summed first.
FEW = 256
ALNUM = re.compile(r"[^\W\d_]+")
#: First code points of script ranges, in order; each range ends where the next begins.
RANGES = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"), (0x0600, "Arabic"),
    (0x0780, "other"), (0x0900, "Devanagari"), (0x0980, "Indic"), (0x0E00, "Thai"), (0x0E80, "other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "other"), (0x3040, "Kana"),
    (0x3130, "Hangul"), (0x3190, "other"), (0x3400, "Han"), (0xA000, "other"), (0xAC00, "Hangul"), (0xD7B0, "other"), (0xF900, "Han"), (0xFB00, "other"),
]
SCRIPTS = sorted({s for _, s in RANGES})
STARTS = np.array([a for a, _ in RANGES])
SCRIPT_OF = np.array([SCRIPTS.index(s) for _, s in RANGES])


def letters_of(text: str) -> list[str]:
    """The runs of letters (Unicode category L) of a text; the pattern alone also takes other numerals than digits."""
    words = ALNUM.findall(text)
    if all(map(str.isalpha, words)):
        return words
    return [w for run in words for w in (run if run.isalpha() else "".join(c if c.isalpha() else " " for c in run)).split()]


def scripts(words: list[str]) -> np.ndarray:
    """The script of each word's first letter."""
    return SCRIPT_OF[np.searchsorted(STARTS, [ord(w[0]) for w in words], "right") - 1]


def grams(joined: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of the n-grams of space-separated words, and where each begins."""
    data = np.frombuffer(b" " + joined + b" ", np.uint8).astype(np.uint64)
    space = data == 32
    out, at, code, inner = [], [], data, np.zeros(len(data), bool)
    for n in range(2, max(ORDERS) + 1):
        if len(data) < n:
            break
        if n > 2:
            inner = inner[:-1] | space[n - 2 : len(space) - 1]
        else:
            inner = inner[:-1]
        code = (code[:-1] << np.uint64(8)) | data[n - 1 :]
        if n in ORDERS:
            # no space inside, and not the gap between two words alone
            use = np.flatnonzero(~inner & ~(space[: len(inner)] & space[n - 1 :]))
            out.append((mix(code[use] + np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64))) & np.uint64(FEATURES - 1)).astype(np.int64))
            at.append(use)
    return (np.concatenate(out), np.concatenate(at)) if out else (np.empty(0, np.int64), np.empty(0, np.int64))


def learn(rows: DataFrame, train: Column) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Languages, log-probabilities [language, feature] and shares [language, script]."""
    schema = arrow_schema("lang string,part int,blob binary")
    width = FEATURES + SLICE  # scripts are the last slice

    def count(batches):
        held: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, some in texts.items():
                words = letters_of(" ".join(some).lower())
                if words:
                    total = held.setdefault(lang, np.zeros(width, np.int64))
                    total[:FEATURES] += np.bincount(grams(" ".join(words).encode())[0], minlength=FEATURES)
                    total[FEATURES:] += np.bincount(scripts(words), [len(w) for w in words], SLICE).astype(np.int64)
        for lang, total in held.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * (width // SLICE)), pa.array(range(width // SLICE), pa.int32()), pa.array([x.tobytes() for x in total.reshape(-1, SLICE)], pa.binary())], schema=schema)

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(b, np.int64) for b in table.column("blob").to_pylist())
        return pa.table([table.column("lang")[:1], table.column("part")[:1], pa.array([total.tobytes()], pa.binary())], schema=schema)

    sent = rows.where(train & F.col("lang").isNotNull()).select("lang", "body").mapInArrow(count, "lang string,part int,blob binary")
    # in two levels, so that no group takes a blob of every task
    some = sent.withColumn("few", F.pmod(F.spark_partition_id(), F.lit(FEW))).groupBy("lang", "part", "few").applyInArrow(add, "lang string,part int,blob binary")
    got = some.groupBy("lang", "part").applyInArrow(add, "lang string,part int,blob binary").collect()
    langs = sorted({r.lang for r in got})
    counts = np.zeros((len(langs), width))
    for r in got:
        counts[langs.index(r.lang), r.part * SLICE : (r.part + 1) * SLICE] = np.frombuffer(r.blob, np.int64)
    log = counts[:, :FEATURES] + SMOOTH
    log = np.log(log / log.sum(1, keepdims=True)) if langs else log
    share = counts[:, FEATURES : FEATURES + len(SCRIPTS)]
    return langs, log.astype(np.float32), share / np.maximum(share.sum(1, keepdims=True), 1)


class WordScores:
    """Scores of words, with a bounded cache."""

    def __init__(self, log: np.ndarray, share: np.ndarray):
        self.log, self.may = np.ascontiguousarray(log.T), share.T >= SHARE
        self.clear()

    def clear(self) -> None:
        self.seen, self.scores, self.letters = {}, np.zeros((0, self.log.shape[1]), np.float32), np.zeros(0, np.int64)

    def place(self, fresh: list[str]) -> None:
        """Gives the words numbers and scores."""
        parts = [letters_of(w) for w in fresh]
        scores, letters = np.zeros((len(fresh), self.log.shape[1]), np.float32), np.array([sum(map(len, p)) for p in parts])
        flat = [(i, w) for i, p in enumerate(parts) for w in p]
        if flat:
            coded = [w.encode() for _, w in flat]
            feature, at = grams(b" ".join(coded))
            starts = np.cumsum([0, *[len(c) + 1 for c in coded]])
            # an n-gram that begins at the space before a word is the word's
            which = np.searchsorted(starts, at, "right") - 1
            which = np.minimum(which, len(flat) - 1)
            owner = np.array([i for i, _ in flat])[which]
            order = np.argsort(owner, kind="stable")
            owner, values = owner[order], self.log[feature[order]]
            first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            scores[owner[first]] = np.add.reduceat(values, first)
            has = np.flatnonzero(letters)
            may = self.may[scripts([parts[i][0] for i in has])]
            may[~may.any(1)] = True
            scores[has] = np.where(may, scores[has], scores[has] - 1e4)
        self.seen.update(zip(fresh, range(len(self.scores), len(self.scores) + len(fresh)), strict=True))
        self.scores, self.letters = np.concatenate([self.scores, scores]), np.concatenate([self.letters, letters])

    def of(self, texts: list[str]) -> list[list[int]]:
        if len(self.seen) > CACHE:
            self.clear()
        words = [t.lower().split() for t in texts]
        get = self.seen.get
        got = [[get(w) for w in ws] for ws in words]
        fresh = list(dict.fromkeys(w for ws, ns in zip(words, got, strict=True) if None in ns for w, n in zip(ws, ns, strict=True) if n is None))
        if fresh:
            self.place(fresh)
            get = self.seen.get
            got = [[get(w) for w in ws] if None in ns else ns for ws, ns in zip(words, got, strict=True)]
        return got


def viterbi(scores: np.ndarray, sizes: np.ndarray, penalty: float) -> np.ndarray:
    """The label of every token. scores: [token, label], text after text; sizes: tokens of each text."""
    labels = np.zeros(len(scores), np.int64)
    order = np.argsort(-sizes, kind="stable")
    starts = (np.cumsum(sizes) - sizes)[order]
    sizes = sizes[order]
    active = np.searchsorted(-sizes, -np.arange(1, int(sizes.max(initial=0)) + 1), "right")  # texts longer than t
    if not len(active):
        return labels
    best = np.zeros(len(scores), np.int16)
    moved = np.zeros(scores.shape, bool)
    value = scores[starts[: active[0]]].copy()
    ends = value.copy()
    for t in range(1, len(active)):
        n, at = active[t], starts[: active[t]] + t
        value = value[:n]
        top = value.argmax(1)
        jump = value[np.arange(n), top] - penalty
        move = value < jump[:, None]
        best[at], moved[at] = top, move
        value = np.where(move, jump[:, None], value) + scores[at]
        ends[:n] = value
    now = ends.argmax(1)
    for t in range(len(active) - 1, -1, -1):
        n, at = active[t], starts[: active[t]] + t
        labels[at] = now[:n]
        if t:
            rows = np.arange(n)
            now[:n] = np.where(moved[at, now[:n]], best[at], now[:n])
    return labels


OUT = "doc_id long,held_out boolean,lang_pred string,score double,spans string"


def language_id(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: lang_pred, score, spans (lang:first word:end word, comma-joined)."""
    spark = session(docs)
    rows = text_or_empty(docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out.alias("held_out"), F.col(lang_col).alias("lang"), F.col(text_col).alias("body")), "body")
    langs, log, share = learn(rows, ~F.col("held_out"))
    shared = spark.sparkContext.broadcast((langs, log, share))
    schema = arrow_schema(OUT)

    def run(batches):
        langs, log, share = shared.value
        words = WordScores(log, share)
        ids, held, numbers, size = [], [], [], 0

        def out():
            sizes = np.array([len(n) for n in numbers], np.int64)
            flat = np.concatenate([np.array(n, np.int64) for n in numbers]) if numbers else np.empty(0, np.int64)
            letters = words.letters[flat]
            label = viterbi(words.scores[flat], sizes, PENALTY)
            doc = np.repeat(np.arange(len(sizes)), sizes)
            weight = np.bincount(doc * len(langs) + label, letters, len(sizes) * len(langs)).reshape(len(sizes), len(langs))
            total = weight.sum(1)
            top = weight.argmax(1)
            score = weight[np.arange(len(sizes)), top] / np.maximum(total, 1)
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (label[1:] != label[:-1])]) if len(doc) else np.empty(0, np.int64)
            spans = [[] for _ in sizes]
            starts = np.cumsum(sizes) - sizes
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(doc)], strict=True) if len(first) else ():
                d = doc[a]
                spans[d].append(f"{langs[label[a]]}:{a - starts[d]}:{b - starts[d]}")
            known = total > 0
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(held, pa.bool_()), pa.array([langs[k] if ok else "und" for k, ok in zip(top, known, strict=True)]), pa.array(np.where(known, score, 0.0)), pa.array([",".join(s) if ok else "" for s, ok in zip(spans, known, strict=True)])],
                schema=schema,
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            if not langs:
                n = batch.num_rows
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(["und"] * n), pa.array([0.0] * n), pa.array([""] * n)], schema=schema)
                continue
            if len(words.seen) > CACHE and ids:
                yield out()
                ids, held, numbers, size = [], [], [], 0
            ids += batch.column(0).to_pylist()
            held += batch.column(1).to_pylist()
            numbers += (got := words.of(batch.column(2).to_pylist()))
            size += sum(map(len, got))
            if size * len(langs) >= TOKENS * 4:
                yield out()
                ids, held, numbers, size = [], [], [], 0
        if ids:
            yield out()

    return rows.select("doc_id", "held_out", "body").mapInArrow(run, OUT)
