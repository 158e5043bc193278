import itertools
import random

import pytest

from waygrid.operators import graph, reach


def area(ring):
    return sum(a[0] * b[1] - b[0] * a[1] for a, b in itertools.pairwise([*ring, ring[0]])) / 2


def sides(cells):
    for c, r in cells:
        for dc, dr, *line in ((0, -1, 0, 0, 1, 0), (1, 0, 1, 0, 1, 1), (0, 1, 1, 1, 0, 1), (-1, 0, 0, 1, 0, 0)):
            if (c + dc, r + dr) not in cells:
                yield (c + line[0], r + line[1], c + line[2], r + line[3])


@pytest.mark.parametrize("seed", range(20))
def test_rings_enclose_the_cells(seed):
    rng = random.Random(seed)
    cells = {(rng.randrange(8), rng.randrange(8)) for _ in range(rng.randrange(1, 50))}
    lines = list(sides(cells))
    rings = reach.chain(lines)
    walked = sorted((*a, *b) for ring in rings for a, b in itertools.pairwise([*ring, ring[0]]))
    assert walked == sorted(lines) and sum(map(area, rings)) == len(cells)


def test_hole_and_corner():
    frame = {(c, r) for c in range(3) for r in range(3)} - {(1, 1)}
    assert sorted(map(area, reach.chain(sides(frame)))) == [-1, 9]
    assert sorted(map(area, reach.chain(sides({(0, 0), (1, 1)})))) == [1, 1]
    assert reach.chain([]) == []


def test_boundary_and_rings(spark):
    rows = [(1, 0, 0), (1, 1, 0), (2, 5, 5)]
    found = reach.boundary(spark.createDataFrame(rows, "area_id long, col long, row long"), "area_id")
    got = {(r.area_id, r.x1, r.y1, r.x2, r.y2) for r in found.collect()}
    assert got == {(k, *s) for k in (1, 2) for s in sides({(c, r) for a, c, r in rows if a == k})}
    assert {r.area_id: r.area for r in reach.rings(found, "area_id").collect()} == {1: 2.0, 2: 1.0}


def test_a_leg_without_a_path_ends_the_total(spark):
    arcs = spark.createDataFrame([(0, 1, 2.0, 0), (1, 0, 3.0, 1), (2, 0, 1.0, 2)], "u long, v long, w double, edge_id long")
    points = spark.createDataFrame([(1, i, n) for i, n in enumerate((0, 1, 1, 0, 2, 0))], "trip long, seq long, node long")
    got = sorted((r.leg, r.cost, r.total) for r in reach.waypoint_legs(arcs, points).collect())
    assert got == [(0, 2.0, 2.0), (1, 0.0, 2.0), (2, 3.0, 5.0), (3, None, None), (4, 1.0, None)]


def test_betweenness_is_brute_force(spark):
    """Weights are powers of two, so that no two paths tie."""
    ends = [(u, v) for u, v in itertools.permutations(range(5), 2) if (u * 3 + v) % 4]
    rows = [(u, v, float(2**i), i) for i, (u, v) in enumerate(ends)]
    arcs = spark.createDataFrame([*rows, (7, 8, 1.0, 99)], "u long, v long, w double, edge_id long")
    pairs = [(a * 10 + b, a, b, float((a + b) % 3)) for a, b in itertools.permutations(range(5), 2)] + [(100, 0, 8, 5.0)]
    score, routed = {}, 0.0
    for _, a, b, demand in pairs:
        todo, best = [(0.0, a, ())], None
        while todo:
            c, at, path = todo.pop()
            if at == b and (best is None or c < best[0]):
                best = c, path
            todo += [(c + w, v, (*path, e)) for u, v, w, e in rows if u == at and len(path) < 4]
        if best and demand > 0:
            routed += demand
            for e in best[1]:
                score[e] = score.get(e, 0) + demand
    got = graph.betweenness(arcs, spark.createDataFrame(pairs, "pair_id long, source long, target long, demand double")).collect()
    assert {r.edge_id: r.score for r in got} == score
    assert {r.edge_id: r.normalized for r in got} == pytest.approx({e: s / routed for e, s in score.items()})
