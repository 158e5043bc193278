"""Registered queries read their whole tables."""

from waygrid.plans import registry
from waygrid.plans.tables import stop_times
from waygrid.sources.synth import table


def scan(rows, stop, start, slack):
    """Earliest arrivals by repeated passes over all connections until nothing changes."""
    best, on, changed = {stop: start - slack}, set(), True
    while changed:
        changed = False
        for trip, seq, a, b, dep, arr in rows:
            if dep >= start and ((trip, seq - 1) in on or a in best and best[a] + slack <= dep):
                if (trip, seq) not in on:
                    on.add((trip, seq))
                    changed = True
                if arr < best.get(b, arr + 1):
                    best[b], changed = arr, True
    return {**best, stop: start}


def test_earliest_arrivals_of_all_suppliers(spark, sf_dir):
    trips = {}
    for r in stop_times(spark, sf_dir).collect():
        trips.setdefault(r.trip, []).append((r.seq, r.stop, r.arrival, r.departure))
    rows = []
    for trip, calls in trips.items():
        calls.sort()
        rows += [(trip, i, a[1], b[1], a[3], b[2]) for i, (a, b) in enumerate(zip(calls, calls[1:], strict=False))]
    want = {(r.s_suppkey, stop, at) for r in table(spark, sf_dir, "supplier").collect() for stop, at in scan(rows, r.s_suppkey, 9000 + r.s_suppkey * 31 % 3000, 30).items()}
    got = registry.queries()["net230_earliest_arrivals"](spark, sf_dir).collect()
    assert {(r.request, r.stop, r.arrival) for r in got} == want and len(got) == len(want)
