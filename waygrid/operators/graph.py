"""Shortest paths, service areas, matrices, betweenness and components.

Two forms of search. ``relax`` is a driver-controlled frontier relaxation over
DataFrames: it holds no graph in one place and suits any size. The others run
kernels on executors over a network in shared files (``net``), many origins at once.
"""

from __future__ import annotations

import tempfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import net


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster shares; without a cluster, where none is named, one of this machine."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if not folder and not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return folder or tempfile.mkdtemp(prefix="waygrid-")


def cut(df: DataFrame) -> DataFrame:
    """df, materialised in the folder that the cluster shares."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def relax(arcs: DataFrame, seeds: DataFrame, limit: float | None = None) -> DataFrame:
    """(origin, node, cost): least costs from seeds (origin, node, cost) along arcs (u, v, w).

    Each round sends only nodes that got cheaper, so it is label correction; a cost over
    limit is never kept. The arcs' partitioning by u is made once and used by every round.
    """
    arcs = arcs.select("u", "v", "w").where("w is not null").repartition("u").cache()
    best = cut(seeds.groupBy("origin", "node").agg(F.min("cost").alias("cost")))
    frontier = best
    while True:
        reached = frontier.join(arcs, F.col("node") == F.col("u")).groupBy("origin", F.col("v").alias("node")).agg(F.min(F.col("cost") + F.col("w")).alias("cost"))
        if limit is not None:
            reached = reached.where(F.col("cost") <= limit)
        old = best.select("origin", "node", F.col("cost").alias("old"))
        both = cut(reached.join(old, ["origin", "node"], "full_outer"))
        frontier = both.where("cost is not null and (old is null or cost < old)").select("origin", "node", "cost")
        if frontier.isEmpty():
            arcs.unpersist()
            return best
        best = both.select("origin", "node", F.least(F.coalesce("cost", "old"), F.coalesce("old", "cost")).alias("cost"))


def dealt(rows: DataFrame, *by: str) -> DataFrame:
    """rows over four times as many tasks as there are cores, so that none holds many."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism, *by)


def batch(names: str, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names.split())


def trees(arcs: DataFrame, origins: DataFrame, limit: float | None = None) -> DataFrame:
    """(origin, node, cost) of every node that is reached from the node of each origin (origin, node)."""
    folder, most = net.write(arcs, [origins]), net.INF if limit is None else limit

    def run(batches):
        graph = net.opened(folder)
        for rows in batches:
            for origin, node in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                touched = graph.spread(graph.at([node]), [0.0], most)
                yield batch("origin node cost", np.full(len(touched), origin), graph.ids[touched], graph.cost[touched])
                graph.clear(touched)

    return dealt(origins.select(F.col("origin").cast("long"), F.col("node").cast("long"))).mapInArrow(run, "origin long,node long,cost double")


def labelled(arcs: DataFrame, origins: DataFrame, labels: DataFrame, limit: float | None = None, whole: bool = False) -> DataFrame:
    """(origin, label, cost): the least cost from each origin (origin, node) to a node of each label (label, node).

    Only what is asked for leaves the search. whole: labels out of reach too, without a cost.
    """
    folder, most = net.write(arcs, [origins], labels), net.INF if limit is None else limit

    def run(batches):
        graph = net.opened(folder)
        for rows in batches:
            for origin, node in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                touched = graph.spread(graph.at([node]), [0.0], most)
                cost, found = graph.by_label(), graph.labels
                graph.clear(touched)
                if not whole:
                    found, cost = found[cost < net.INF], cost[cost < net.INF]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), origin)), pa.array(found), pa.array(cost, mask=cost == net.INF)], names=["origin", "label", "cost"])

    return dealt(origins.select(F.col("origin").cast("long"), F.col("node").cast("long"))).mapInArrow(run, "origin long,label long,cost double")


def matrix(arcs: DataFrame, origins: DataFrame, destinations: DataFrame, limit: float | None = None) -> DataFrame:
    """(origin, destination, cost): a row per pair, cost null where unreachable. origins (origin, node); destinations (destination, node)."""
    rows = labelled(arcs, origins, destinations.select(F.col("destination").alias("label"), "node"), limit, True)
    return rows.withColumnRenamed("label", "destination")


def pair_costs(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, cost) of the cheapest path of each pair (pair_id, source, target) that has one, searched from both ends."""
    folder = net.write(arcs, [pairs.select(F.col(c).alias("node")) for c in ("source", "target")], reverse=True)

    def run(batches):
        graph = net.opened(folder)
        for rows in batches:
            pair, source, target = (c.to_pylist() for c in rows.columns)
            out = []
            for p, s, t in zip(pair, graph.at(source).tolist(), graph.at(target).tolist(), strict=True):
                found = net.route(graph, s, t)
                if found:
                    out.append((p, found[0]))
            yield batch("pair_id cost", pa.array([p for p, _ in out], pa.int64()), pa.array([c for _, c in out], pa.float64()))

    asked = pairs.select(*[F.col(c).cast("long") for c in ("pair_id", "source", "target")]).where("source is not null and target is not null")
    return dealt(asked).mapInArrow(run, "pair_id long,cost double")


#: Targets of one source from which on one search of the whole network is made for all.
WHOLE = 100


def paths(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(pair_id, step, edge_id) of the cheapest path of each pair (pair_id, source, target); ties go to the smaller edge."""
    folder = net.write(arcs, [pairs.select(F.col(c).alias("node")) for c in ("source", "target")], reverse=True)

    def run(batches):
        graph = net.opened(folder)
        positive = not len(graph.w) or graph.w.min() > 0
        for rows in batches:
            pair, source, target = (c.to_pylist() for c in rows.columns)
            by: dict[int, list] = {}
            for p, s, t in zip(pair, graph.at(source).tolist(), graph.at(target).tolist(), strict=True):
                by.setdefault(s, []).append((p, t))
            for s, targets in by.items():
                out = []
                if len(targets) < WHOLE or not positive:
                    found = ((p, net.route(graph, s, t)) for p, t in targets)
                    out = [(p, i, e) for p, x in found if x for i, e in enumerate(x[1])]
                else:
                    touched = graph.spread([s], [0.0])
                    out = [(p, i, e) for p, t in targets if graph.cost[t] < net.INF for i, e in enumerate(graph.path_back(s, t))]
                    graph.clear(touched)
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.int64()) for i in range(3)], names=["pair_id", "step", "edge_id"])

    asked = pairs.select(*[F.col(c).cast("long") for c in ("pair_id", "source", "target")]).where("source is not null and target is not null")
    return dealt(asked, "source").mapInArrow(run, "pair_id long,step long,edge_id long")


def seeded_spans(arcs: DataFrame, seeds: DataFrame, limit: float) -> DataFrame:
    """The rows of ``spans`` within limit of the seeds (origin, node, cost) of each origin, cut at the boundary: no reached node leaves the search."""
    folder = net.write(arcs, [seeds])

    def run(batches):
        graph = net.opened(folder)
        for rows in batches:
            for origin, nodes, costs in zip(*(c.to_pylist() for c in rows.columns), strict=True):
                touched = graph.spread(graph.at(nodes), costs, limit)
                inside = touched[graph.cost[touched] < limit]
                out, n = graph.leaving(inside)
                start, w = np.repeat(graph.cost[inside], n), graph.w[out]
                graph.clear(touched)
                end = start + w
                part = np.where(end > limit, (limit - start) / np.where(w > 0, w, 1.0), 1.0)
                yield batch("origin edge_id start_fraction end_fraction start_cost end_cost", np.full(len(out), origin), graph.edge[out], np.zeros(len(out)), part, start, np.minimum(end, limit))

    asked = seeds.groupBy(F.col("origin").cast("long").alias("origin")).agg(F.collect_list(F.struct(F.col("node").cast("long").alias("node"), F.col("cost").cast("double").alias("cost"))).alias("x"))
    schema = "origin long,edge_id long,start_fraction double,end_fraction double,start_cost double,end_cost double"
    return dealt(asked.select("origin", F.col("x.node").alias("nodes"), F.col("x.cost").alias("costs"))).mapInArrow(run, schema)


def spans(arcs: DataFrame, reached: DataFrame, limit: float, cut_at_boundary: bool = True) -> DataFrame:
    """(origin, edge_id, start_fraction, end_fraction, start_cost, end_cost): edge parts within limit."""
    rows = reached.join(arcs.where("w is not null"), F.col("node") == F.col("u")).where(F.col("cost") < limit)
    end = F.col("cost") + F.col("w")
    fraction = F.when(end > limit, (limit - F.col("cost")) / F.col("w")).otherwise(1.0) if cut_at_boundary else F.lit(1.0)
    return rows.select("origin", "edge_id", F.lit(0.0).alias("start_fraction"), fraction.alias("end_fraction"), F.col("cost").alias("start_cost"), (F.least(end, F.lit(limit)) if cut_at_boundary else end).alias("end_cost"))


def betweenness(arcs: DataFrame, pairs: DataFrame) -> DataFrame:
    """(edge_id, score, n_pairs, normalized): demand of the pairs (pair_id, source, target, demand) over their paths.

    normalized: the score's share of all demand that found a path; a pair without demand takes no part.
    """
    wanted = pairs.where("demand > 0")
    rows = cut(paths(arcs, wanted).join(wanted.select("pair_id", "demand"), "pair_id"))
    routed = rows.where("step = 0").agg(F.sum("demand").alias("routed"))  # one row
    scores = rows.groupBy("edge_id").agg(F.sum("demand").alias("score"), F.count(F.lit(1)).alias("n_pairs"))
    return scores.join(F.broadcast(routed)).select("edge_id", "score", "n_pairs", (F.col("score") / F.col("routed")).alias("normalized"))


def weak_components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node that undirected edges (u, v) connect each node with."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct().cache()
    label = cut(both.select(F.col("u").alias("node"), F.col("u").alias("component")).distinct())
    while True:
        near = both.join(label.withColumnRenamed("node", "v"), "v").groupBy("u").agg(F.min("component").alias("least"))
        step = label.join(near, F.col("node") == F.col("u")).select("node", "component", F.least("component", "least").alias("least"))
        # the label of one's label: paths of labels halve each round
        jump = step.select(F.col("node").alias("at"), F.col("least").alias("beyond"))
        new = cut(step.join(jump, F.col("least") == F.col("at")).select("node", F.col("component").alias("old"), F.least("least", "beyond").alias("component")))
        label = new.select("node", "component")
        if new.where("component <> old").isEmpty():
            both.unpersist()
            return label
