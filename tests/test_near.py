"""Snapping: long segments, and many targets in one place."""

import math
import random

from waygrid.operators import joins, relate


def metres(p, s):
    """From a point to a segment in the plane around the point."""
    flat = lambda lon, lat: (math.radians(lon - p[0]) * math.cos(math.radians(p[1])) * 6371000.0, math.radians(lat - p[1]) * 6371000.0)
    (ax, ay), (bx, by) = flat(*s[:2]), flat(*s[2:])
    square = (bx - ax) ** 2 + (by - ay) ** 2
    t = max(0.0, min(1.0, (-ax * (bx - ax) - ay * (by - ay)) / square)) if square else 0.0
    return math.hypot(ax + t * (bx - ax), ay + t * (by - ay))


def test_segments_of_any_length(spark):
    rng = random.Random(4)
    place = lambda: (6 + rng.random(), 53 + rng.random())
    segs = [(*place(), *place()) for _ in range(60)] + [(6.5, 53.1, 6.5, 53.9), (6.1, 53.5, 6.9, 53.5), (6.3, 53.3, 6.3, 53.3)]
    pts = [place() for _ in range(200)] + [(6.5, 53.5), (6.3, 53.31)]
    want = {(i, j) for i, p in enumerate(pts) for j, s in enumerate(segs) if metres(p, s) <= 2000}
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "point_id long, lon double, lat double")
    b = spark.createDataFrame([(j, *s) for j, s in enumerate(segs)], "edge_id long, from_lon double, from_lat double, to_lon double, to_lat double")
    got = [(r.point_id, r.edge_id) for r in joins.near_segments(a, b, 2000.0, 0.05).collect()]
    assert set(got) == want and len(got) == len(want)
    assert any(max(abs(s[0] - s[2]), abs(s[1] - s[3])) > 0.1 for _, j in want for s in [segs[j]])


def test_many_targets_and_segments_of_one_place(spark):
    """Snaps and nearest segments over thinned candidates are those over all pairs."""
    rng = random.Random(8)
    spots = [(6 + rng.random() / 10, 53 + rng.random() / 10) for _ in range(5)]
    nodes = [(i, *spots[rng.randrange(5)]) for i in range(60)]
    edges = [(i, rng.randrange(60), rng.randrange(60)) for i in range(150)]
    pts = [(i, *(spots[i] if i < 3 else (6 + rng.random() / 10, 53 + rng.random() / 10))) for i in range(12)]
    p = spark.createDataFrame(pts, "point_id long, lon double, lat double")
    t = spark.createDataFrame(nodes, "node_id long, t_lon double, t_lat double")
    e = spark.createDataFrame(edges, "edge_id long, from_node long, to_node long")
    pairs = joins.within(p, t, 5000.0, 0.05)
    few = joins.thinned(t, [], "node_id", 3)
    assert few.count() == 15
    ranks = lambda rows: sorted((r.point_id, r["rank"], r.node_id) for r in joins.nearest(rows, "point_id", "node_id", 3).collect())
    assert ranks(joins.within(p, few, 5000.0, 0.05)) == ranks(pairs)
    every = pairs.select("point_id", pairs.node_id.alias("from_node"), "distance_m").join(e, "from_node")
    want = sorted((r.point_id, r["rank"], r.edge_id, r.a, r.b, r.distance_m) for r in relate.nearest_segments(every, "point_id", 4).collect())
    got = relate.nearest_segments_of_places(p, t, e, "point_id", 5000.0, 0.05, 4).collect()
    assert sorted((r.point_id, r["rank"], r.edge_id, r.a, r.b, r.distance_m) for r in got) == want and want


def test_best_hop_takes_the_nearest_of_each_component(spark):
    """One row a point and component enters the pairs, however many candidates there are."""
    side = lambda point: [(point, n, n % 3, float((n * 7 + point) % 50)) for n in range(90)]
    s = spark.createDataFrame(side(1) + side(2), "point long, node long, component long, distance_m double")
    got = relate.best_hop(spark.createDataFrame([(1, 2)], "origin long, destination long"), s, s, 40.0).collect()
    want = min(a[3] + b[3] for a in side(1) for b in side(2) if a[2] == b[2] and max(a[3], b[3]) <= 40)
    assert [r.hop_m for r in got] == [want]
