"""Exact top-k inner-product search through a pivot-distance index.

Inner products become distances by one more coordinate: with M the largest norm, x'
= (x, sqrt(M^2 - |x|^2)) and q' = (q, 0) have |q' - x'|^2 = |q|^2 + M^2 - 2 q.x, so
the largest products are the nearest neighbours.

Index: every vector is keyed by its nearest pivot and its distance to it, range-sorted
by (pivot, distance, id) and cut into annuli of at most ANNULUS vectors. The sort splits
any key, so equal vectors are no hot group. Pivots come from a bounded sample.

Search, in two rounds over shards of consecutive annuli:
1. each query scans the shard that holds its own distance to its nearest pivot, for a
   first bound on its k-th score;
2. it visits the other shards that a lower bound of the distance does not exclude: for
   pivot p and an annulus of radii [r, R], |q' - x'| >= max(0, |q' - p| - R, r - |q' - p|).
   In a shard, annuli are expanded outward from the query's own distance and the
   expansion stops where the bound passes the k-th best.
Queries travel in blocks, so a (query, shard) visit is no row of its own.

Rounding: with e = 8 (dim + 8) / 2^53, a squared distance of vectors of norms up to R is
off by at most e * 4 R^2, so a distance by at most 2 R sqrt(e); bounds give way by that
much (`slack`). Scores are exact: products are doubles only while every sum of them is
below 2^53, else 64-bit integers.

Defined cases: vectors that are null or hold null or non-finite components take no part,
neither do those of a scaled norm of 2^31 or more, whose products may not fit a long;
a shorter vector counts as filled up with zeros; a query never returns its own id; ties
go to the smaller id; with fewer than k candidates all are returned; rows that repeat an
id are candidates of their own, and the least of their vectors is the query.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema, cut, session

PIVOTS, SAMPLE = 32, 4096
ANNULUS, SHARD, BLOCK = 512, 16_384, 1024
MAX_SHARDS = 1 << 16
NONE = -np.iinfo(np.int64).max
#: Bytes of query vectors that meet a shard in one task.
PART = 64 << 20
EXACT = 1 << 53


def usable(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """(vec_id, v): floor(scale * x) of each component as long, rows that take part only."""
    x = F.col(vector_col)
    fine = x.isNotNull() & F.col(id_col).isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    small = F.forall(x, lambda c: F.abs(c.cast("double") * scale) < 2.0**31)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fine & small, F.transform(x, lambda c: F.floor(c.cast("double") * scale))).alias("v")).where("v is not null")
    return rows.where(squares("v") < 2.0**62)


def squares(v: str) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, c: a + c.cast("double") * c)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy()
    return flat.reshape(len(column), -1).astype(np.float64)


def slack(dim: int, top: float) -> float:
    """How far a distance of vectors of squared norms up to top may be off."""
    return 2 * (8 * (dim + 8) / EXACT * top) ** 0.5


def products(q: np.ndarray, x: np.ndarray, top: float) -> np.ndarray:
    """Inner products of integer vectors, exact."""
    return q @ x.T if top < EXACT else q.astype(np.int64) @ x.astype(np.int64).T


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(top - (x * x).sum(1), 0))[:, None]], 1)


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = (a * a).sum(1)[:, None] + (b * b).sum(1)[None] - 2 * a @ b.T
    return np.sqrt(np.maximum(d, 0))


def pivots_of(index: DataFrame, top: float) -> np.ndarray:
    """Centres of a few rounds of k-means on a bounded sample."""
    rows = index.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("v").collect()
    x = lifted(np.array([r.v for r in rows], np.float64), top)
    centres = x[:: max(1, len(x) // PIVOTS)][:PIVOTS]
    for _ in range(5):
        near = distances(x, centres).argmin(1)
        centres = np.array([x[near == k].mean(0) if (near == k).any() else centres[k] for k in range(len(centres))])
    return centres


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the rows of vectors where is_query, an expression of vec_id, holds."""
    spark = session(vectors)
    ddl = "query_id long,rank int,vec_id long,score long"
    index = usable(vectors, id_col, vector_col, scale)
    head = index.agg(F.count(F.lit(1)), F.max(squares("v")), F.max(F.size("v"))).first()
    if not head[0]:
        return spark.createDataFrame([], ddl)
    # a component more than any vector has, so that none is empty
    count, top, dim = head[0], float(head[1]), head[2] + 1
    index = index.withColumn("v", F.concat("v", F.array_repeat(F.lit(0).cast("long"), F.lit(dim) - F.size("v"))))
    off = 2 * slack(dim, top)
    pivots = pivots_of(index, top)
    tools = spark.sparkContext.broadcast((pivots, top))

    def keyed(batches):
        pivots, top = tools.value
        for batch in batches:
            if batch.num_rows:
                d = distances(lifted(matrix(batch.column(1)), top), pivots)
                near = d.argmin(1)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(near, pa.int32()), pa.array(d[np.arange(len(d)), near])], names=["vec_id", "v", "pivot", "far"])

    shards = int(min(MAX_SHARDS, max(1, -(-count // SHARD))))
    placed = index.mapInArrow(keyed, "vec_id long,v array<long>,pivot int,far double")
    placed = cut(placed.repartitionByRange(shards, "pivot", "far", "vec_id").sortWithinPartitions("pivot", "far", "vec_id").withColumn("shard", F.spark_partition_id()))
    # a row per shard and pivot: at most MAX_SHARDS + PIVOTS
    radii = placed.groupBy("shard", "pivot").agg(F.min("far").alias("lo"), F.max("far").alias("hi")).toPandas()
    meta = spark.sparkContext.broadcast(tuple(radii[c].to_numpy() for c in ("shard", "pivot", "lo", "hi")))

    def gap(d: np.ndarray, pivot, lo, hi) -> np.ndarray:
        """A lower bound of the distance of each query [row] to each part [column]."""
        return np.maximum(np.maximum(d[:, pivot] - hi[None], lo[None] - d[:, pivot]), 0)

    def best_possible(apart: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """An upper bound of the product of vectors that far apart."""
        return (norm[:, None] + top - np.maximum(apart - off, 0) ** 2) / 2 + off * off + 1

    def home(batches):
        (pivots, top), (shard, pivot, lo, hi) = tools.value, meta.value
        for batch in batches:
            if batch.num_rows:
                q = matrix(batch.column(1))
                d = distances(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots)
                near = gap(d, pivot, lo, hi) + (pivot[None] != d.argmin(1)[:, None]) * 1e12
                yield from blocks(batch.column(0), batch.column(1), shard[near.argmin(1)], np.full(len(q), NONE))

    def blocks(ids, vectors, shard, bound):
        """Query blocks: rows of one shard go together."""
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            for a in range(0, len(part), BLOCK):
                use = part[a : a + BLOCK]
                blob = matrix(vectors.take(pa.array(use))).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([int(shard[use[0]])], pa.int32()), pa.array([ids.take(pa.array(use)).to_numpy().astype(np.int64).tobytes()]), pa.array([blob]), pa.array([bound[use].tobytes()])], names=["shard", "ids", "q", "bound"])

    block_ddl = "shard int,ids binary,q binary,bound binary"

    def visit(queries: pa.Table, rows: pa.Table) -> pa.Table:
        empty = arrow_schema("query_id long,vec_id long,score long").empty_table()
        if not queries.num_rows or not rows.num_rows:
            return empty
        pivots, top = tools.value
        order = np.lexsort([rows.column(c).to_numpy() for c in ("vec_id", "far", "pivot")])
        rows = rows.take(pa.array(order))
        ids, pivot, far = (rows.column(c).to_numpy() for c in ("vec_id", "pivot", "far"))
        x = matrix(rows.column("v").combine_chunks())
        cuts = np.flatnonzero(np.r_[True, pivot[1:] != pivot[:-1]])
        edges = [a for s, e in zip(cuts, [*cuts[1:], len(ids)], strict=True) for a in range(s, e, ANNULUS)]
        ends = [*edges[1:], len(ids)]
        lo, hi, of = far[edges], far[np.array(ends) - 1], pivot[edges]
        out_q, out_v, out_s = [], [], []
        for block in queries.to_pylist():
            qid, bound = np.frombuffer(block["ids"], np.int64), np.frombuffer(block["bound"], np.int64)
            q = np.frombuffer(block["q"]).reshape(len(qid), -1)
            norm = (q * q).sum(1)
            d = distances(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots)
            # the best product that an annulus could hold
            most = best_possible(gap(d, of, lo, hi), norm)
            best_s, best_i = np.full((len(q), k), NONE), np.full((len(q), k), np.iinfo(np.int64).max)
            for a in np.argsort(-most.max(0), kind="stable").tolist():
                use = np.flatnonzero(most[:, a] >= np.maximum(bound, best_s[:, -1]).astype(np.float64))
                if not len(use):
                    continue
                some, names = x[edges[a] : ends[a]], ids[edges[a] : ends[a]]
                s = np.where(names[None] == qid[use][:, None], NONE, products(q[use], some, top).astype(np.int64))
                if s.shape[1] > k:  # ties at the cut go to the smaller id
                    kth = np.partition(s, s.shape[1] - k, 1)[:, s.shape[1] - k]
                    s = np.where(s >= np.maximum(kth, best_s[use, -1])[:, None], s, NONE)
                every_s, every_i = np.concatenate([best_s[use], s], 1), np.concatenate([best_i[use], np.broadcast_to(names, s.shape)], 1)
                keep = np.lexsort((every_i, -every_s), axis=1)[:, :k]
                best_s[use], best_i[use] = np.take_along_axis(every_s, keep, 1), np.take_along_axis(every_i, keep, 1)
            row, col = np.nonzero(best_s > NONE)
            out_q.append(qid[row])
            out_v.append(best_i[row, col])
            out_s.append(best_s[row, col])
        return pa.table([pa.array(np.concatenate(c)) for c in (out_q, out_v, out_s)], schema=empty.schema)

    def search(queries: DataFrame) -> DataFrame:
        queries = cut(queries)
        # a row per shard, at most MAX_SHARDS: a shard that many queries visit meets them in parts
        parts = queries.groupBy("shard").agg(F.ceil(F.sum(F.length("q")) / PART).cast("int").alias("parts"))
        ways = lambda x: F.broadcast(parts.select(F.col("shard").alias("to"), F.col("parts").alias(x)))
        there = placed.join(ways("m"), F.col("shard") == F.col("to")).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("m") - 1))).drop("m", "to")
        dealt = queries.join(ways("n"), F.col("shard") == F.col("to")).withColumn("part", F.pmod(F.xxhash64("ids"), F.col("n")).cast("int")).drop("n", "to")
        return dealt.groupBy("shard", "part").cogroup(there.groupBy("shard", "part")).applyInArrow(visit, "query_id long,vec_id long,score long")

    asked = placed.where(is_query).groupBy("vec_id").agg(F.min("v").alias("v"))
    first = cut(search(asked.mapInArrow(home, block_ddl)))
    bound = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))

    def away(batches):
        (pivots, top), (shard, pivot, lo, hi) = tools.value, meta.value
        for batch in batches:
            if not batch.num_rows:
                continue
            q, kth = matrix(batch.column(1)), np.array([NONE if s is None else s for s in batch.column(2).to_pylist()], np.int64)
            d = distances(np.concatenate([q, np.zeros((len(q), 1))], 1), pivots)
            near = gap(d, pivot, lo, hi) + (pivot[None] != d.argmin(1)[:, None]) * 1e12
            may = best_possible(gap(d, pivot, lo, hi), (q * q).sum(1)) >= kth[:, None].astype(np.float64)
            may &= shard[None] != shard[near.argmin(1)][:, None]
            pair = np.unique(np.nonzero(may)[0] * (int(shard.max()) + 1) + shard[np.nonzero(may)[1]])
            row, to = pair // (int(shard.max()) + 1), pair % (int(shard.max()) + 1)
            if len(row):
                yield from blocks(batch.column(0).take(pa.array(row)), batch.column(1).take(pa.array(row)), to, kth[row])

    second = search(asked.join(bound, F.col("vec_id") == F.col("query_id"), "left").select("vec_id", "v", "kth").mapInArrow(away, block_ddl))
    # a query's partial lists meet: at most k from each shard that it visits
    ranked = F.expr(f"slice(sort_array(collect_list(struct(score as s, -vec_id as i)), false), 1, {k})")
    best = first.unionByName(second).groupBy("query_id").agg(ranked.alias("best"))
    return best.select("query_id", F.posexplode("best").alias("at", "x")).select("query_id", (F.col("at") + 1).cast("int").alias("rank"), (-F.col("x.i")).alias("vec_id"), F.col("x.s").alias("score"))
