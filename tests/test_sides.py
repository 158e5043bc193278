"""Joins on the borders of boxes and windows, where a last digit or a tie decides."""

import duckdb
import pytest

from waygrid.plans import registry


def both(spark, folder, name, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    want = c.sql(registry.oracle_sql()[name])
    got = registry.queries()[name](spark, str(folder)).select(*want.columns)
    return sorted(map(tuple, got.collect()), key=str), sorted(want.fetchall(), key=str)


@pytest.mark.parametrize("name", ["net103_areas", "net104_timezones"])
def test_points_on_a_side_of_a_box(spark, tmp_path, name):
    """Customer 13480 lies on a side whose sum of doubles isn't the nearest double of the decimal."""
    for t, where in (("customer", "c_custkey IN (2480, 13370, 13480)"), ("supplier", "s_suppkey < 90")):
        duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.1/{t}.parquet' WHERE {where}) TO '{tmp_path}/{t}.parquet'")
    got, want = both(spark, tmp_path, name, "customer", "supplier")
    assert got == want and got


def test_tasks_of_windows_follow_the_rows(spark, monkeypatch):
    """A task's rows grew with the table; copies of a window change nothing."""
    from waygrid.operators import relate

    monkeypatch.setattr(relate, "ROWS_A_TASK", 50)
    rows = [(k, s, s + (k * s) % 9) for k in range(40) for s in range(0, 100, 7)]
    one = relate.merge_windows(spark.createDataFrame(rows, "edge_id long, s long, e long"), ["edge_id"], "s", "e")
    many = relate.merge_windows(spark.createDataFrame(rows * 2, "edge_id long, s long, e long"), ["edge_id"], "s", "e")
    assert sorted(map(tuple, many.collect())) == sorted(map(tuple, one.collect()))
    assert many.rdd.getNumPartitions() == 24


def test_islands_of_equal_spans(spark, tmp_path):
    """Copies of a span change no island (the SQL's two windows may order copies differently)."""
    for name, times in (("one", 1), ("three", 3)):
        duckdb.sql(f"COPY (SELECT * FROM '/root/testdata/sf0.001/lineitem.parquet', range({times})) TO '{tmp_path}/{name}.parquet'")
        (tmp_path / name).mkdir()
        (tmp_path / f"{name}.parquet").rename(tmp_path / name / "lineitem.parquet")
    found = [sorted(map(tuple, registry.queries()["net149_interval_coalescing"](spark, str(tmp_path / n)).collect())) for n in ("one", "three")]
    assert found[0] == found[1] and found[0]
