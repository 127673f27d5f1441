import random

from conftest import at
from pyspark.sql import functions as F

from tarmac.operators import features, joins, quality, scale, series, split, submission
from tarmac.operators.counts import distinct_flights, zero_filled_arrivals
from tarmac.operators.dedup import first_seen
from tarmac.operators.spine import spine, station_order
from tarmac.sources import flights

STATIONS = ["KDEN", "KMEM"]


def arrivals(rows, data):
    df = rows("gufi:string station:string arrival_ts:ts", data)
    return df.withColumn("station_ord", station_order(F.col("station"), STATIONS))


def counts(spark, rows, data, legacy=False):
    grid = spine(spark, STATIONS, "2022-09-01 00:00:00", "2022-09-02 23:00:00", "all")
    out = zero_filled_arrivals(grid, arrivals(rows, data), legacy)
    return {(r.station, r.bucket_end): r.value for r in out.collect()}


def test_right_closed_counts(spark, rows):
    times = ["13:00:01", "13:15:00", "13:15:00.000001", "13:59:59", "14:00:00"]
    data = [(f"g{i}", "KDEN", f"2022-09-01 {t}") for i, t in enumerate(times)]
    corrected, legacy = counts(spark, rows, data), counts(spark, rows, data, legacy=True)

    def by(c):
        return [c["KDEN", at(f"2022-09-01 {t}")] for t in ("13:15", "13:30", "13:45", "14:00", "14:15")]

    assert by(corrected) == [2, 1, 0, 2, 0] and by(legacy) == [2, 1, 0, 1, 0]
    assert all(v == 0 for (s, _), v in corrected.items() if s == "KMEM")
    assert len(corrected) == 2 * 48 * 4


def test_a_flight_counts_once(spark, rows):
    data = [("g1", "KMEM", "2022-09-01 10:05:00"), ("g1", "KDEN", "2022-09-01 12:05:00"), ("g1", "KDEN", "2022-09-01 18:05:00"),
            (None, "KDEN", "2022-09-01 12:05:00"), ("g2", "KXXX", "2022-09-01 12:05:00"), ("g3", "KDEN", None)]
    got = {k: v for k, v in counts(spark, rows, data).items() if v}
    assert got == {("KDEN", at("2022-09-01 12:15")): 1}
    assert [(r.gufi, r.station, r.arrival_ts) for r in first_seen(arrivals(rows, data)).collect()] == [
        ("g1", "KDEN", at("2022-09-01 12:05"))
    ]


def test_on_the_hour_arrival_still_marks_its_flight_in_the_legacy_count(spark, rows):
    data = [("g1", "KDEN", "2022-09-01 14:00:00"), ("g1", "KMEM", "2022-09-01 15:05:00")]
    assert sum(counts(spark, rows, data, legacy=True).values()) == 0


def test_arrivals_are_conserved(spark, rows):
    dice = random.Random(1)
    data = [
        (f"g{i}", dice.choice(STATIONS), f"2022-09-0{dice.choice([1, 2, 3])} {dice.randrange(24):02d}:{dice.randrange(60):02d}:30")
        for i in range(300)
    ]
    inside = sum(1 for d in data if d[2] < "2022-09-03")
    assert sum(counts(spark, rows, data).values()) == inside


def test_distinct_flights_has_both_ends(rows):
    df = rows("gufi:string station:string ts:ts", [("a", "K", "2022-09-01 10:15:00"), ("a", "K", "2022-09-01 10:20:00")])
    got = {r.time_bucket: r.flights for r in distinct_flights(df).collect()}
    assert got == {at("2022-09-01 10:00"): 1, at("2022-09-01 10:15"): 1}


def test_thin_out(rows):
    spec = "arrival_airport:string gufi:string at:ts n:long"
    same = [("K", "g1", "2022-09-01 00:20:00", 1), ("K", "g2", "2022-09-01 00:20:30", 2), ("K", "g1", "2022-09-01 00:20:40", 3)]
    kept = flights.thin_out(rows(spec, same), ["at"], [F.col("n")]).collect()
    assert sorted(r.n for r in kept) == [1, 2]
    assert [r.n for r in flights.thin_out(rows(spec, same), ["at"], [F.col("n")], legacy=True).collect()] == [1]


def test_tracks_union_equals_outer_join(rows):
    a = rows("gufi:string arrival_airport:string estimated_arrival_time:ts", [("g1", "K", "2022-09-01 00:00:00"), ("g2", "K", None)])
    d = rows("gufi:string arrival_airport:string estimated_departure_time:ts", [("g1", "K", "2022-09-01 05:00:00")])
    union = joins.merge_tracks(a, d)
    # The flag as data: true where there is a flight at all, false likewise.
    flagged = [a.withColumn("is_arrival", F.col("gufi").isNotNull()), d.withColumn("is_arrival", F.col("gufi").isNull())]
    outer = joins.outer_join_tracks(*flagged).select(*union.columns)
    assert union.count() == 3
    assert sorted(map(str, union.collect())) == sorted(map(str, outer.collect()))


def test_null_flights_meet_only_in_the_legacy_join(rows):
    r = rows("arrival_airport:string gufi:string x:long", [("K", None, 1), ("K", "g", 2)])
    t = rows("arrival_airport:string gufi:string y:long", [("K", None, 1), ("K", "g", 2)])
    a = rows("arrival_airport:string gufi:string aircraft_type:string", [("K", None, "B"), ("K", "g", "A")])
    assert joins.enrich_flights(r, t, a).count() == 1
    legacy = joins.enrich_flights(r, t, a, legacy=True)
    assert legacy.count() == 2 and set(legacy.columns) == {"arrival_airport", "gufi", "x", "y", "aircraft_type"}


def test_weather_join_does_not_fan_out(rows):
    weather = rows(
        "station:string datetime:ts n:long t:double",
        [("K", "2022-09-01 10:01:00", 1, 1.0), ("K", "2022-09-01 10:14:00", 2, 2.0), ("K", "2022-09-01 10:14:00", 3, 3.0)],
    )
    latest = joins.latest_per_bucket(weather, ["t"], [F.col("datetime"), F.col("n")])
    rows_ = rows("station:string time_bucket:ts t:double", [("K", "2022-09-01 10:00:00", 9.0), ("K", "2022-09-01 10:15:00", 8.0)])
    got = {r.time_bucket: (r.t, r.t_taf) for r in joins.join_weather(rows_, latest).collect()}
    assert got == {at("2022-09-01 10:00"): (9.0, 3.0), at("2022-09-01 10:15"): (8.0, None)}


def test_flight_preparation(rows):
    df = rows(
        "arrival_runway_actual_time:string estimated_arrival_time:string is_arrival:boolean arrival_airport:string",
        [
            ("2022-09-01 10:20:00", "2022-09-01 10:01:00", True, "K"),
            ("2022-09-01 10:20:00", "2022-09-01 10:01:00", True, "K"),
            ("2022-09-01 10:20:00", None, True, "K"),
            ("2022-09-01 10:20:00", "not a date", False, "K"),
            ("not a date", None, True, "K"),
            ("2022-09-01 10:20:00", None, True, None),
        ],
    )
    got = sorted(r.time_bucket for r in features.prepare_flights(df).collect())
    assert got == [at("2022-09-01 10:00"), at("2022-09-01 10:15")]


def test_scaling(rows):
    df = rows("station:string v:double", [("A", 2.0), ("A", 4.0), ("A", 3.0), ("B", 7.0)])
    params = scale.fit_minmax(df, ["v"])
    scaled = scale.apply_minmax(df, params, ["v"])
    assert sorted((r.station, r.v) for r in scaled.collect()) == [("A", 0.0), ("A", 0.5), ("A", 1.0), ("B", 0.0)]
    back = scale.invert_minmax(scaled, params, ["v"])
    assert sorted(back.collect()) == sorted(df.collect())
    two = rows("v:double", [(1.0,), (3.0,)])
    assert sorted(r.v for r in scale.apply_zscore(two, scale.fit_zscore(two, ["v"])).collect()) == [-1.0, 1.0]
    flat = rows("v:double", [(5.0,), (5.0,)])
    assert {r.v for r in scale.apply_zscore(flat, scale.fit_zscore(flat, ["v"])).collect()} == {0.0}


def test_hash_split_is_stable_and_near_its_fraction(spark):
    df = spark.range(20_000).withColumnRenamed("id", "k")
    first = split.hash_split(df.repartition(7), ["k"])
    second = split.hash_split(df.repartition(3), ["k"])
    assert first.exceptAll(second).count() == 0
    assert abs(first.filter("part = 'train'").count() / 20_000 - 0.8) < 0.02


def test_exact_quantiles(rows):
    import numpy as np

    dice = random.Random(5)
    data = [("A", dice.choice([1.5, 2.25, dice.uniform(-50, 50)])) for _ in range(501)] + [("B", 4.0)]
    qs = [0.0, 0.05, 0.5, 0.95, 1.0]
    got = {r.k: r for r in series.exact_quantiles(rows("k:string v:double", data), ["k"], "v", qs).collect()}
    values = [v for k, v in data if k == "A"]
    expected = np.quantile(values, qs)
    np.testing.assert_allclose([got["A"][f"q{int(q * 100):02d}"] for q in qs], expected, rtol=1e-12)
    assert got["A"].samples == 501 and abs(got["A"].mean - np.mean(values)) < 1e-9
    assert got["B"].q50 == 4.0


def test_windows_stay_within_a_series(rows):
    data = [("A", c, f"2024-01-0{c + 1} {h:02d}:00:00", float(100 * c + h)) for c in (0, 1) for h in range(20)]
    df = rows("station:string cycle:int t:ts v:double", data)
    out = series.supervised_windows(df, ["station", "cycle"], "t", "v").collect()
    assert len(out) == 2 * (20 - 3 - 12)
    for r in out:
        assert r.v_lag_0 - r.v_lag_3 == 3 and r.v_step_12 - r.v_lag_0 == 12


def test_series_forms(rows):
    df = rows("s:string t:ts v:double", [("a", "2024-01-01 00:15:00", 2.0), ("a", "2024-01-01 00:00:00", 1.0), ("b", "2024-01-01 00:00:00", 5.0)])
    got = {r.s: (r.start, r.length, r.v) for r in series.dense_series(df, ["s"], "t", ["v"]).collect()}
    assert got["a"] == (at("2024-01-01 00:00"), 2, [1.0, 2.0])
    wide = {r.t: (r.a, r.b) for r in series.pivot_series(df, "t", "s", ["a", "b"], "v").collect()}
    assert wide[at("2024-01-01 00:15")] == (2.0, None)
    assert split.full_series(df, ["s"], 2).count() == 2


def test_template_and_submission(spark, rows):
    grid = spine(spark, ["KDEN"], "2022-09-25 00:00:00", "2022-09-25 23:00:00", "all")
    template = submission.template_rows(grid)
    ids = [r.ID for r in template.orderBy("bucket_end").collect()]
    assert len(ids) == 72 and ids[0] == "KDEN_220925_0100_15" and ids[-1] == "KDEN_220925_2100_180"
    made = submission.to_submission(
        rows("station:string at:ts prediction:double", [("KDEN", "2022-09-25 01:15:00", 2.5), ("KDEN", "2022-09-25 01:45:00", -3.0)])
    )
    done = {r.ID: r.Value for r in submission.complete_submission(template, made).collect()}
    assert done["KDEN_220925_0100_15"] == 2 and done["KDEN_220925_0100_30"] == 2 and done["KDEN_220925_2100_180"] == 0


def test_scores_and_audits(rows):
    df = rows("y:double p:double", [(1.0, 2.0), (3.0, 3.0), (None, 1.0)])
    assert abs(df.agg(quality.rmse(F.col("y"), F.col("p"))).first()[0] - 0.5**0.5) < 1e-12
    audit = {r["column"]: r.nulls for r in quality.null_audit(df).collect()}
    assert audit == {"y": 1, "p": 0}


def test_flights_of_equal_times_are_counted_apart(rows):
    from tarmac.operators.features import prepare_flights

    spec = "gufi:string arrival_airport:string is_arrival:boolean arrival_runway_actual_time:ts"
    one = ("KDEN", True, "2022-09-01 10:20:00")
    df = rows(spec, [("g1", *one), ("g1", *one), ("g2", *one)])
    assert prepare_flights(df).count() == 2 and prepare_flights(df, legacy=True).count() == 1
    assert "gufi" not in prepare_flights(df).columns


def test_outer_join_keeps_both_sides(rows):
    from tarmac.operators.joins import outer_join_tracks

    spec = "gufi:string is_arrival:boolean arrival_airport:string"
    left = rows(spec + " a:long", [("g", True, "K", 1), ("g", True, "K", 2), ("h", True, "K", 3), (None, True, "K", 4)])
    right = rows(spec + " b:long", [("g", True, "K", 5), ("i", True, "K", 6), (None, True, "K", 7)])
    got = sorted(outer_join_tracks(left, right).select("gufi", "a", "b").collect(), key=str)
    want = sorted(left.join(right, ["gufi", "is_arrival", "arrival_airport"], "full_outer").select("gufi", "a", "b").collect(), key=str)
    assert got == want and len(got) == 6
