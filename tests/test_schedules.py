import pytest

from waygrid.functions import schedules as S

WORK, ALL = 31, 127


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("24/7", [(ALL, 0, 1440, True)]),
        ("Mo-Fr 07:00-19:00", [(WORK, 420, 1140, True)]),
        ("(Sa-Mo 22:00-26:00)", [(97, 1320, 120, True)]),
        ("07:00-09:00,16:00-18:00", [(ALL, 420, 540, True), (ALL, 960, 1080, True)]),
        ("Mo-Fr 07:00-19:00; We 10:00-12:00", [(WORK - 4, 420, 1140, True), (4, 600, 720, True)]),
        ("Mo-Fr 08:00-12:00, We 14:00-18:00", [(WORK, 480, 720, True), (4, 840, 1080, True)]),
        ("Mo-Fr 07:00-19:00; PH off", [(WORK, 420, 1140, False)]),
        ("Su,PH", [(192, 0, 1440, False)]),
        ("Mo 10:00-12:00; Mo 13:00-14:00", [(1, 780, 840, True)]),
        *[(t, None) for t in ("", "PH off", "Su off", "Mo 10:00-10:00", "Mo 25:00-26:00", "sunrise-sunset", "Nov 1-Apr 1", "Mo-PH", "Mo 10:00-12:00 x", "Mo-Fr 10:00+", 'Mo "on request"', "Mo 10:00-49:00")],
    ],
)
def test_weekly_rules(text, want):
    assert S.weekly_rules(text) == want


def test_entries():
    got = S.entries("no @ (Mo-Fr 07:00-19:00; Sa 10:00-12:00); 30 @ weight > 7500 kg ; yes@(wet);x @ (Mo AND weight>3)")
    assert [(e[0], e[1], e[2]) for e in got] == [("no", "time", None), ("30", "vehicle", "weight"), ("yes", "unsupported", None), ("x", "unsupported", None)]
    assert got[0][4] == [(WORK, 420, 1140, True), (32, 600, 720, True)] and got[1][3] == pytest.approx(7.5)
    assert S.entries("no @ (Mo); broken") is None and S.entries(" ; ") is None and S.entries(None) is None
    assert S.entries("a @ height<3")[0][1] == "unsupported" and S.entries("a @ height>3 furlongs")[0][1] == "unsupported"


def test_column(spark):
    df = spark.createDataFrame([(1, "no @ (22:00-06:00)"), (2, None), (3, "broken"), (4, "")], "id long, tag string")
    got = {r.id: r.e for r in df.select("id", S.conditional("tag").alias("e")).collect()}
    assert got[2] is got[3] is got[4] is None
    assert [(e.value, e.kind, e.above, [(r.days, r.start_minute, r.end_minute) for r in e.rules]) for e in got[1]] == [("no", "time", None, [(ALL, 1320, 360)])]
