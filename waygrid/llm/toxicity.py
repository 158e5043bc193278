"""Toxic spans by a linear-chain conditional random field.

Learning (a bounded sample: the first POSITIVES toxic and NEGATIVES other labelled
training rows by a hash of their id):

1. features are a token's word and its prefixes; those whose document frequency
   differs enough between the two kinds of rows form the lexicon (at most LEXICON);
2. a token of a toxic row with a feature of STRONG log-odds is a labelled toxic
   token, every other token is a labelled clean one;
3. a two-state CRF over the tokens' features is fitted by gradient ascent on the
   exact likelihood (forward-backward) of FIT_ROWS rows of each kind, whole: a text is
   cut into pieces of FIT_TOKENS tokens, and equal pieces count once, with a weight;
4. a logistic curve turns the document's evidence into the probability of its label.

Scoring runs over whole texts. Tokens without a lexicon feature share one potential,
so a gap of n of them is one matrix power, and forward-backward takes as many steps
as there are tokens with features. The score is the calibrated log-odds that any
token is toxic; tokens whose marginal is at least SPAN are the offending offsets.

Defined cases: null and empty texts have no tokens and get the score of no evidence;
a null id is kept and counts as the empty string where ids are hashed; labels that
repeat an id count once, as toxic if any of them is; without labelled rows of both
kinds every score is 0.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, map_rows, session, text_or_empty

POSITIVES, NEGATIVES = 4000, 8000
LEXICON, LEAST_DOCS, LEAST_ODDS, STRONG = 3000, 4, 2.0, 2.5
PREFIXES = (4, 5, 6, 7)
#: Of the sample, the field's weights are fitted on this many rows of each kind, in pieces of this many tokens.
FIT_ROWS, FIT_TOKENS, STEPS = 500, 200, 40
SPAN = 0.5
CACHE = 600_000
JUNK = re.compile(r"[\W_]+")
TOKEN = re.compile(r"\S+")


def features(raw: str) -> list[str]:
    word = JUNK.sub("", raw.lower())
    return [word, *["^" + word[:n] for n in PREFIXES if len(word) > n]] if word else []


def sample(docs: DataFrame, labels: DataFrame, train: Column) -> DataFrame:
    """(toxic, body): the bounded sample of labelled training rows."""
    marks = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic")).where(train)
    pick = lambda kind, n: marks.where(F.col("toxic") == kind).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)
    chosen = pick(1, POSITIVES).unionByName(pick(0, NEGATIVES))
    # at most POSITIVES + NEGATIVES ids: small enough to broadcast at any size of the input
    return docs.join(F.broadcast(chosen), "doc_id").select("toxic", "body")


def lexicon(rows: DataFrame) -> tuple[dict[str, float], tuple[int, int]]:
    """Log-odds of the features that tell the two kinds of rows apart."""

    def make():
        def step(columns):
            held: dict[tuple[str, int], int] = {}
            for toxic, text in zip(*columns, strict=True):
                held["", toxic] = held.get(("", toxic), 0) + 1
                for f in {f for w in set(text.split()) for f in features(w)}:
                    held[f, toxic] = held.get((f, toxic), 0) + 1
            return [[f for f, _ in held], [t for _, t in held], list(held.values())]

        return step

    counts = map_rows(rows, make, "f string,toxic int,n long").groupBy("f").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("pos"), F.sum(F.when(F.col("toxic") == 0, F.col("n")).otherwise(0)).alias("neg"))
    whole = counts.where("f = ''").first()
    if not whole or not whole.pos or not whole.neg:
        return {}, (0, 0)
    odds = F.log((F.col("pos") + 0.5) / (whole.pos + 1)) - F.log((F.col("neg") + 0.5) / (whole.neg + 1))
    # a feature counts for what is left after its chance error
    sure = odds - F.sqrt(1 / (F.col("pos") + 0.5))
    top = counts.where(f"f <> '' and pos >= {LEAST_DOCS}").withColumn("sure", sure).where(F.col("sure") >= LEAST_ODDS).orderBy(F.desc("sure"), "f").limit(LEXICON)
    return {r.f: r.sure for r in top.select("f", "sure").collect()}, (whole.pos, whole.neg)


class Field:
    """The fitted CRF and the calibration; small and bounded, so it is broadcast."""

    def __init__(self, odds: dict[str, float]):
        self.odds, self.number = odds, {f: i + 1 for i, f in enumerate(odds)}
        self.weights = np.zeros(len(odds) + 1)  # at 0 the bias, for the toxic state
        self.moves = np.zeros((2, 2))
        self.curve = (0.0, 0.0, 0.0)
        self.powers: dict[int, np.ndarray] = {}

    def of(self, raw: str) -> tuple[int, ...]:
        return tuple(self.number[f] for f in features(raw) if f in self.number)

    def potential(self, numbers: tuple[int, ...]) -> float:
        return float(self.weights[0] + sum(self.weights[i] for i in numbers))

    def gap(self, n: int) -> np.ndarray:
        """The normalised product of n steps over tokens without features."""
        if n not in self.powers:
            if len(self.powers) > 4096:
                self.powers.clear()
            step, out = np.exp(self.moves) * np.exp([0.0, self.weights[0]]), np.eye(2)
            k = n
            while k:
                if k & 1:
                    out = out @ step
                step = step @ step
                step, k = step / step.max(), k >> 1
            self.powers[n] = out / out.max()
        return self.powers[n]

    def marginals(self, places: list[int], found: list[tuple[int, ...]], n: int) -> list[float]:
        """P(toxic) of the tokens at places, of n tokens."""
        vectors, gaps, last = [], [], -1
        for p, f in zip(places, found, strict=True):
            vectors.append(np.exp([0.0, min(30.0, self.potential(f))]))
            gaps.append(p - last - 1)
            last = p
        move, forward, alpha = np.exp(self.moves), [], np.ones(2)
        for k, (g, v) in enumerate(zip(gaps, vectors, strict=True)):
            # before the first token there is no transition
            if k == 0:
                alpha = (np.exp([0.0, self.weights[0]]) @ self.gap(g - 1)) @ move * v if g else v
            else:
                alpha = alpha @ self.gap(g) @ move * v
            alpha = alpha / alpha.sum()
            forward.append(alpha)
        beta, out = self.gap(n - 1 - last) @ np.ones(2), []
        for k in range(len(places) - 1, -1, -1):
            both = forward[k] * beta
            out.append(float(both[1] / both.sum()))
            beta = self.gap(gaps[k]) @ (move @ (vectors[k] * beta))
            beta = beta / beta.max()
        return out[::-1]

    def evidence(self, marginals: list[float]) -> tuple[float, float]:
        """Log-odds that any token is toxic, and the expected number of toxic tokens."""
        none = sum(math.log1p(-min(p, 1 - 1e-12)) for p in marginals)
        any_ = max(-math.expm1(none), 1e-9)
        return max(-12.0, min(12.0, math.log(any_) - max(none, -12.0))), math.log1p(sum(marginals))

    def score(self, evidence: tuple[float, float]) -> float:
        a, b, c = self.curve
        z = a + b * evidence[0] + c * evidence[1]
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def fit(odds: dict[str, float], rows: pd.DataFrame) -> Field:
    """rows: toxic, n (tokens), places and numbers of the tokens with features."""
    field = Field(odds)
    strong = {i for f, i in field.number.items() if odds[f] >= STRONG}
    pieces: dict[tuple, int] = {}
    for r in pd.concat([rows[(rows.toxic == k) & (rows.n > 0)].head(FIT_ROWS) for k in (1, 0)]).itertuples():
        parts: dict[int, list] = {}
        for p, f in zip(r.places, r.found, strict=True):
            parts.setdefault(p // FIT_TOKENS, []).append((p % FIT_TOKENS, f, r.toxic == 1 and any(i in strong for i in f)))
        for k in range(-(-r.n // FIT_TOKENS)):
            piece = (min(FIT_TOKENS, r.n - k * FIT_TOKENS), tuple(parts.get(k, ())))
            pieces[piece] = pieces.get(piece, 0) + 1
    n_docs, longest = len(pieces), max((n for n, _ in pieces), default=0)
    if not n_docs:
        return field
    sets, index = [()], {(): 0}
    token = np.zeros((longest, n_docs), np.int64)
    gold = np.zeros((longest, n_docs))
    for j, (_, hits) in enumerate(pieces):
        for p, f, bad in hits:
            if f not in index:
                index[f] = len(sets)
                sets.append(f)
            token[p, j] = index[f]
            gold[p, j] = bad
    weight = np.array(list(pieces.values()), float)
    alive = np.arange(longest)[:, None] < np.array([n for n, _ in pieces])[None, :]
    times = np.broadcast_to(weight, alive.shape)[alive]
    has = np.zeros((len(sets), len(field.weights)))
    has[:, 0] = 1
    for i, f in enumerate(sets):
        has[i, list(f)] = 1
    seen = np.bincount(token[alive], gold[alive] * times, len(sets)) @ has
    pairs = alive[1:]
    g0, g1 = gold[:-1][pairs].astype(int), gold[1:][pairs].astype(int)
    moved = np.bincount(g0 * 2 + g1, np.broadcast_to(weight, pairs.shape)[pairs], minlength=4).reshape(2, 2)
    step_w, step_m = np.zeros_like(field.weights), np.zeros((2, 2))
    for _ in range(STEPS):
        emit = np.exp(np.clip(has @ field.weights, -30, 30))[token]
        move = np.exp(field.moves)
        forward, backward = np.empty((longest, n_docs, 2)), np.ones((longest, n_docs, 2))
        a = np.stack([np.ones(n_docs), emit[0]], 1)
        for t in range(longest):
            if t:
                a = np.where(alive[t][:, None], (a @ move) * np.stack([np.ones(n_docs), emit[t]], 1), a)
            a = a / a.sum(1, keepdims=True)
            forward[t] = a
        b = np.ones((n_docs, 2))
        expected = np.zeros((2, 2))
        for t in range(longest - 2, -1, -1):
            right = b * np.stack([np.ones(n_docs), emit[t + 1]], 1)
            on = alive[t + 1]
            both = forward[t][:, :, None] * move[None] * right[:, None, :]
            both = both / both.sum((1, 2), keepdims=True)
            expected += (both[on] * weight[on][:, None, None]).sum(0)
            b = np.where(on[:, None], right @ move.T, b)
            b = b / b.max(1, keepdims=True)
            backward[t] = b
        p = forward * backward
        p = (p / p.sum(2, keepdims=True))[:, :, 1]
        grad_w = seen - np.bincount(token[alive], p[alive] * times, len(sets)) @ has - 0.02 * field.weights
        grad_m = moved - expected - 0.02 * field.moves
        # steps scaled by the running square of the gradient
        step_w, step_m = step_w + grad_w**2, step_m + grad_m**2
        field.weights += 0.7 * grad_w / np.sqrt(step_w + 1e-9)
        field.moves += 0.7 * grad_m / np.sqrt(step_m + 1e-9)
    data = np.array([[1.0, *field.evidence(field.marginals(r.places, r.found, r.n))] for r in rows.itertuples()])
    want, w = (rows.toxic == 1).to_numpy(float), np.zeros(3)
    for _ in range(40):
        q = 1 / (1 + np.exp(-np.clip(data @ w, -30, 30)))
        h = (data * (q * (1 - q))[:, None]).T @ data + np.diag([1e-3, 1e-2, 1e-2])
        w += np.linalg.solve(h, data.T @ (want - q) - np.array([1e-3, 1e-2, 1e-2]) * w)
    field.curve = tuple(w)
    field.powers = {}
    return field


class Found:
    """Features of the tokens of a text, with a bounded cache by token."""

    def __init__(self, field: Field):
        self.field, self.seen = field, {}

    def of(self, text: str) -> tuple[list[int], list[tuple[int, ...]], int]:
        seen, words = self.seen, text.split()
        got = [seen.get(w) for w in words]
        if None in got:
            if len(seen) > CACHE:
                seen.clear()
            for i, w in enumerate(words):
                if got[i] is None:
                    got[i] = seen[w] = self.field.of(w)
        if not any(got):
            return [], [], len(words)
        places = [i for i, f in enumerate(got) if f]
        return places, [got[i] for i in places], len(words)


def train_field(rows: DataFrame, labels: DataFrame, train: Column) -> Field:
    picked = cut(sample(rows, labels, train))
    odds, (pos, neg) = lexicon(picked)
    if not odds:
        return Field({})

    def make():
        found = Found(Field(odds))

        def step(columns):
            out = [[], [], [], []]
            for toxic, text in zip(*columns, strict=True):
                places, numbers, n = found.of(text)
                for c, v in zip(out, (toxic, n, places, " ".join(",".join(map(str, f)) for f in numbers)), strict=True):
                    c.append(v)
            return out

        return step

    got = map_rows(picked, make, "toxic int,n int,places array<int>,found string").toPandas()
    got = got.assign(key=got.places.map(str)).sort_values(["n", "toxic", "found", "key"], kind="stable")
    got["places"] = [list(p) for p in got.places]
    got["found"] = [[tuple(map(int, f.split(","))) for f in s.split()] for s in got.found]
    return fit(odds, got.sample(frac=1, random_state=7))


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: score, predicted, and the offending spans as start:end, comma-joined.

    held_out is an expression of the column doc_id; the field learns from labelled rows where it is false.
    """
    spark = session(docs)
    rows = text_or_empty(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")), "body")
    shared = spark.sparkContext.broadcast(train_field(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")), ~held_out))

    def make():
        field = shared.value
        found, nothing = Found(field), field.score(field.evidence([])) if field.odds else 0.0

        def step(columns):
            ids, held, texts = columns
            scores, spans = [], []
            for text in texts:
                places, numbers, n = found.of(text)
                if not places:
                    scores.append(nothing)
                    spans.append("")
                    continue
                marginals = field.marginals(places, numbers, n)
                scores.append(field.score(field.evidence(marginals)))
                bad = {p for p, q in zip(places, marginals, strict=True) if q >= SPAN}
                spans.append(",".join(f"{m.start()}:{m.end()}" for i, m in enumerate(TOKEN.finditer(text)) if i in bad) if bad else "")
            return [ids, held, scores, [int(s >= threshold) for s in scores], spans]

        return step

    return map_rows(rows.select("doc_id", held_out.alias("held_out"), "body"), make, "doc_id long,held_out boolean,score double,predicted int,spans string")


def without_toxic(docs: DataFrame, labels: DataFrame, held_out: Column, threshold: float = 0.7, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose score is below threshold."""
    spark = session(docs)
    rows = text_or_empty(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("body")), "body")
    shared = spark.sparkContext.broadcast(train_field(rows, labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")), ~held_out))

    def run(batches):
        field = shared.value
        found, nothing = Found(field), field.score(field.evidence([])) if field.odds else 0.0
        for batch in batches:
            keep = []
            for text in batch.column(batch.schema.get_field_index(text_col)).to_pylist():
                places, numbers, n = found.of(text or "")
                keep.append((field.score(field.evidence(field.marginals(places, numbers, n))) if places else nothing) < threshold)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
