import random
from datetime import timedelta

import pytest
from conftest import at
from pyspark.sql import functions as F

from tarmac.functions import numeric
from tarmac.operators import ordered
from tarmac.operators.asof import asof_observation
from tarmac.operators.forecast_asof import forecast_asof
from tarmac.operators.polygons import polygon_rows, rejected_polygons
from tarmac.sources.tables import read_polygons, write_table

T = "2022-09-25 12:00:00"
OBS = "station:string datetime:ts line_no:long temperature:double"


def newest(rows, observations):
    grid = rows("station:string bucket_end:ts", [("KDEN", T)])
    out = asof_observation(grid, rows(OBS, observations), ["temperature"], [F.col("line_no")])
    return [r.temperature for r in out.collect()]


def test_asof_takes_the_newest_and_never_looks_ahead(rows):
    old, fresh, ahead = ("2022-09-25 05:00:00", "2022-09-25 07:00:00", "2022-09-25 13:00:00")
    assert newest(rows, [("KDEN", old, 1, 1.0), ("KDEN", fresh, 2, 2.0), ("KDEN", ahead, 3, 3.0)]) == [2.0]
    assert newest(rows, [("KDEN", old, 1, 1.0)]) == [None]
    assert newest(rows, [("KDEN", fresh, 1, 1.0), ("KDEN", fresh, 2, 2.0)]) == [2.0]
    assert newest(rows, [("KDEN", fresh, 1, 1.0), ("KDEN", "2022-09-25 11:00:00", 2, None)]) == [None]
    assert newest(rows, [("KDEN", "2022-09-25 06:00:00", 1, 4.0)]) == [4.0]
    assert newest(rows, [("KDEN", "2022-09-25 05:59:59.999999", 1, 4.0)]) == [None]
    assert newest(rows, [("KATL", fresh, 1, 1.0)]) == [None]


LINES = (
    "station:string kind:string validity_start:ts from_time:ts tempo_start:ts becmg_start:ts issue_ts:ts line_no:long "
    "visibility:double wind_speed:double"
)
ISSUED, VALID, STARTED = "2022-09-25 05:20:00", "2022-09-25 06:00:00", "2022-09-25 11:00:00"


def line(no, start=None, vis=None, wind=None, kind="original", valid=VALID):
    return ("KDEN", kind, valid, start, None, None, ISSUED, no, vis, wind)


def in_force(rows, lines, legacy=False):
    grid = rows("station:string bucket_end:ts", [("KDEN", T)])
    out = forecast_asof(grid, rows(LINES, lines), ["visibility", "wind_speed"], ["issue_ts", "line_no"], legacy=legacy)
    return [(r.visibility, r.wind_speed) for r in out.collect()]


def test_equal_spine_rows_stay_apart(rows):
    grid = rows("station:string bucket_end:ts", [("KDEN", T)] * 3 + [("KATL", T)])
    out = forecast_asof(grid, rows(LINES, [line(0, vis=6.0, wind=10.0)]), ["visibility"], ["issue_ts", "line_no"])
    assert sorted((r.station, r.visibility) for r in out.collect()) == [("KATL", None)] + [("KDEN", 6.0)] * 3


def test_instants_off_the_grid_fail(rows):
    grid = rows("station:string bucket_end:ts", [("KDEN", "2022-09-25 10:07:00")])
    with pytest.raises(Exception, match="grid"):
        asof_observation(grid, rows(OBS, [("KDEN", T, 1, 1.0)]), ["temperature"], [F.col("line_no")]).collect()
    with pytest.raises(Exception, match="grid"):
        forecast_asof(grid, rows(LINES, [line(0, vis=6.0)]), ["visibility"], ["issue_ts", "line_no"]).collect()


def test_coordinates_without_halves_are_listed(rows):
    path = "Deviation Probability/FCST060/FLVL250/Contour/TRSH070/POLY003"
    leaves = rows("source_file:string path:string coords:doubles", [("a", path, [1.0, 2.0, 3.0]), ("b", path, [1.0, 3.0]), ("c", "x", [1.0])])
    assert [r.centroid_lat for r in polygon_rows(leaves).collect()] == [1.0]
    assert [r.source_file for r in rejected_polygons(leaves).collect()] == ["a"]


def test_change_line_over_base_line(rows):
    lines = [line(0, vis=6.0, wind=10.0), line(1, STARTED, wind=20.0)]
    assert in_force(rows, lines) == [(6.0, 20.0)]
    assert in_force(rows, lines, legacy=True) == [(6.0, 10.0)]
    later = [line(0, vis=6.0, wind=10.0), line(1, "2022-09-25 12:00:01", wind=20.0)]
    assert in_force(rows, later) == [(6.0, 10.0)]


def test_last_started_line_in_file_order(rows):
    lines = [line(0, wind=1.0), line(1, STARTED, wind=2.0), line(2, "2022-09-25 07:00:00", wind=3.0)]
    assert in_force(rows, lines) == [(None, 3.0)]


def test_newest_report_only(rows):
    lines = [
        line(0, wind=1.0, valid="2022-09-25 00:00:00"),
        line(1, wind=2.0, valid="2022-09-25 06:00:00"),
        line(2, wind=3.0, valid="2022-09-25 12:15:00"),
    ]
    assert in_force(rows, lines) == [(None, 2.0)]
    # Not older than six hours before the day asked for.
    assert in_force(rows, [line(0, wind=1.0, valid="2022-09-24 18:00:00")]) == [(None, 1.0)]
    assert in_force(rows, [line(0, wind=1.0, valid="2022-09-24 17:59:00")]) == [(None, None)]


def test_a_report_without_started_lines_still_hides_older_ones(rows):
    lines = [line(0, wind=1.0, valid="2022-09-25 00:00:00"), line(1, "2022-09-25 15:00:00", wind=2.0)]
    assert in_force(rows, lines) == [(None, None)]


def test_overlay(rows):
    lines = [line(0, wind=10.0), line(1, wind=12.0, kind="amended"), line(2, vis=3.0, kind="corrected")]
    assert in_force(rows, lines) == [(3.0, 12.0)]


def brute_force(lines, t, legacy):
    """The rule spelled out over a list."""
    day = t.replace(hour=0, minute=0)
    values = {}
    for kind in ("original", "amended", "corrected"):
        mine = [x for x in lines if x[1] == kind and day - timedelta(hours=6) <= x[2] <= t]
        if not mine:
            continue
        newest = max(x[2] for x in mine)
        mine = sorted((x for x in mine if x[2] == newest), key=lambda x: x[7])
        started = [i for i, x in enumerate(mine) if any(s is not None and s <= t for s in x[3:6])]
        bases = [i for i, x in enumerate(mine) if all(s is None for s in x[3:6])]
        change = mine[started[-1]] if started else None
        base = mine[bases[-1]] if bases else None
        above = [i for i in bases if started and i < started[-1]]
        above = mine[above[-1]] if above else None
        for place, name in ((8, "visibility"), (9, "wind_speed")):
            for source in (base, change, above) if legacy else (change, base):
                if source is not None and source[place] is not None:
                    values[name] = source[place]
                    break
    return values.get("visibility"), values.get("wind_speed")


def test_forecast_asof_against_brute_force(rows, spark):
    dice = random.Random(7)
    start = at("2022-09-25 00:00:00")
    lines = []
    for no in range(160):
        valid = start + timedelta(hours=6 * dice.randrange(0, 10), minutes=dice.choice([0, 0, 7]))

        def maybe(chance):
            return valid + timedelta(minutes=dice.randrange(-300, 1500)) if dice.random() < chance else None

        lines.append(
            ("KDEN", dice.choice(["original", "amended", "corrected"]), valid, maybe(0.3), maybe(0.2), maybe(0.2), start, no)
            + (dice.choice([None, float(no)]), dice.choice([None, float(no + 1000)]))
        )
    times = [start + timedelta(minutes=15 * i) for i in range(1, 300)]
    grid = rows("station:string bucket_end:ts", [("KDEN", t) for t in times])
    for legacy in (False, True):
        out = forecast_asof(grid, rows(LINES, lines), ["visibility", "wind_speed"], ["issue_ts", "line_no"], legacy=legacy)
        got = {r.bucket_end: (r.visibility, r.wind_speed) for r in out.collect()}
        assert got == {t: brute_force(lines, t, legacy) for t in times}


def test_block_fill(rows):
    spec = "station:string block:long pos:int v:double v_observed:double"
    data = [("A", 0, i, {5: 3.0}.get(i), {0: 9.0, 3: 7.0}.get(i)) for i in range(16)]
    out = {r.pos: r.v for r in ordered.block_fill(rows(spec, data), ["v"]).collect()}
    assert (out[0], out[4], out[5], out[6], out[15]) == (9.0, 7.0, 3.0, 3.0, 3.0)
    assert out[1] is None


def random_history(dice, n=400):
    """Rows with gaps of days, so that whole chunks are empty or hold only nulls."""
    t, out = at("2024-01-01 00:00:00"), []
    for _ in range(n):
        t += timedelta(minutes=15 * dice.choice([1, 1, 1, 2, 300]))
        out.append((dice.choice("AB"), t, dice.choice([None, None, None, float(dice.randrange(100))])))
    return out


def test_neighbours_against_brute_force(rows):
    data = random_history(random.Random(3))
    out = ordered.neighbours(rows("k:string t:ts v:double", data), ["k"], "t", last=["v"], coming=["v"], before=["v"], after=["v"])
    got = {(r.k, r.t): (r.v__last, r.v__coming, r.v__before, r.v__after) for r in out.collect()}
    for key in "AB":
        mine = [r for r in data if r[0] == key]
        for i, (_, t, _) in enumerate(mine):
            back = [r[2] for r in mine[: i + 1] if r[2] is not None]
            ahead = [r[2] for r in mine[i:] if r[2] is not None]
            expected = (
                back[-1] if back else None,
                ahead[0] if ahead else None,
                mine[i - 1][2] if i else None,
                mine[i + 1][2] if i + 1 < len(mine) else None,
            )
            assert got[key, t] == expected


def test_fill_stays_within_the_station_and_is_idempotent(rows):
    df = rows("k:string t:ts v:double", [("A", "2024-01-01 00:00:00", 5.0), ("B", "2024-01-02 00:00:00", None), ("A", "2024-01-09 00:00:00", None)])
    once = ordered.fill_forward(df, ["k"], "t", ["v"])
    got = sorted((r.k, r.t, r.v) for r in once.collect())
    assert [g[2] for g in got] == [5.0, 5.0, None]
    assert sorted(ordered.fill_forward(once, ["k"], "t", ["v"]).collect()) == sorted(once.collect())
    both = ordered.fill_both(df, ["k"], "t", ["v"])
    assert sorted(r.v or 0 for r in both.collect()) == [0, 5.0, 5.0]


def test_shifted_against_brute_force(rows):
    data = [("A", i, float(i)) for i in range(100)] + [("B", i, float(1000 + i)) for i in range(7)]
    out = ordered.shifted(
        rows("k:string pos:long v:double", data), ["k"], "pos", "v", {"up": 12, "down": -3}, chunk_rows=16
    ).collect()
    assert len(out) == len(data)
    have = {(k, p): v for k, p, v in data}
    for r in out:
        assert r.up == have.get((r.k, r.pos + 12)) and r.down == have.get((r.k, r.pos - 3))


def test_category_codes(rows):
    df = rows("id:long label:string", [(1, "b"), (2, "a"), (3, "c"), (4, "a"), (5, "aaab"), (6, None)])
    got = {r.id: r.code for r in ordered.category_codes(df, "label", "code").collect()}
    assert got == {1: 2, 2: 0, 3: 3, 4: 0, 5: 1, 6: None}


LAYERS = " ".join(f"cover_type_{i}:string altitude_{i}:int cloud_type_{i}:string" for i in (1, 2, 3))


def test_cloud_bands(rows):
    df = rows(LAYERS, [("SCT", 1500, None, "BKN", 1800, "CB", "OVC", 40000, None), ("FEW", 0, None, "VV", 300, None, None, None, None)])
    bands = numeric.cloud_bands(numeric.layer_columns())
    first, second = df.select(*[e.alias(n) for n, e in bands.items()]).collect()
    assert (first.cover_500_2000, first.CB_500_2000, first.TCU_500_2000) == (7, 1, 0)
    assert sum(v for v in first) == 8
    assert second.cover_0_500 == 0
    legacy = numeric.cloud_bands(numeric.layer_columns(), legacy=True)
    assert len(legacy) == 16
    assert df.select(*[e.alias(n) for n, e in legacy.items()]).collect()[1].cover_0_500 is None


def test_cloud_severity(rows):
    df = rows(LAYERS, [("BKN", 1000, "CB", None, None, None, None, None, None), (None,) * 9])
    corrected, clear = (r[0] for r in df.select(numeric.cloud_severity(numeric.layer_columns())).collect())
    legacy = df.select(numeric.cloud_severity(numeric.layer_columns(), legacy=True)).first()[0]
    assert round(legacy, 6) == 0.56902 and round(corrected, 6) == 0.96902 and clear == 0


def test_whole_miles_and_rounding(rows):
    df = rows("v:double", [(16093.0,), (8046.0,), (1609.0,), (1610.0,)])
    # 16093 m is one step short of ten miles and still capped; 1609 m is short of one.
    assert [r[0] for r in df.select(numeric.whole_miles(F.col("v"))).collect()] == [6, 4, 0, 1]
    df = rows("v:double", [(-0.4,), (0.5,), (1.5,), (2.5,)])
    assert [r[0] for r in df.select(numeric.clip_round(F.col("v"))).collect()] == [0, 0, 2, 2]


def test_polygons(rows, spark, tmp_path):
    path = "Deviation Probability/FCST060/FLVL250/Contour/TRSH070/POLY003"
    leaves = rows(
        "source_file:string path:string coords:doubles",
        [
            ("2022_12_18_23_45_GMT.Forecast.h5", path, [10.0, 20.0, 30.0, 1.0, 2.0, 3.0]),
            ("none.h5", path, []),
            ("none.h5", path.replace("POLY", "LINE"), [1.0, 2.0]),
            ("none.h5", path, [1.0, 2.0]),
        ],
    )
    write_table(leaves, f"{tmp_path}/leaves")
    got = sorted(polygon_rows(read_polygons(spark, f"{tmp_path}/leaves")).collect(), key=lambda r: r.centroid_lat)
    assert tuple(got[1]) == (at("2022-12-18 23:45"), 60, 25000, 70, "POLY003", 20.0, 2.0)
    assert got[0].datetime_utc is None and len(got) == 2
