from types import SimpleNamespace

import pytest
from conftest import at
from pyspark.sql import functions as F

from tarmac import schemas, session
from tarmac.functions import casting
from tarmac.sources import flights, tables
from tarmac.streaming.ingest import append_new, stream_new_files


@pytest.fixture()
def flight_folder(tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)

    head = "relevant_date,gufi,arrival_runway_actual_time,arrival_runway_actual,departure_runway_actual_time,departure_runway_actual\n"
    put("KDEN_2022-09-01.runways_data_set.csv", head + "x,g1,2022-09-01 10:20:00,08,,\nx,g2,not a date,,2022-09-01 11:00:00,26\n")
    put("KATL_2022-09-02.runways_data_set.csv", head + "x,g3,2022-09-02 10:20:00,08,,\n")
    put("KDEN_2022-09-01_2022-09-02.runways_data_set.csv", head + "x,g9,2022-09-01 10:20:00,08,,\n")
    put("KDEN_2022-09-01.TFM_track_data_set.csv", "gufi,arrival_runway_estimated_time,timestamp\ng1,2022-09-01 10:25:00,2022-09-01 09:00:00\n")
    return str(tmp_path)


def test_daily_files(spark, flight_folder):
    runways = flights.read_daily(spark, flight_folder, "runways_data_set")
    got = {r.gufi: r for r in flights.runway_flights(runways).collect()}
    assert set(got) == {"g1", "g2", "g3"}
    assert got["g1"].arrival_airport == "KDEN" and got["g3"].arrival_airport == "KATL"
    assert got["g1"].arrival_runway_actual_time == at("2022-09-01 10:20") and got["g1"].is_arrival
    assert got["g2"].arrival_runway_actual_time is None and not got["g2"].is_arrival
    tracks = flights.renamed_tracks(flights.read_daily(spark, flight_folder, "TFM_track_data_set"), "TFM_track_data_set")
    assert tracks.first().estimated_arrival_time == at("2022-09-01 10:25")


def test_parts_with_empty_files(spark, tmp_path, rows):
    tables.write_table(rows("a:long", [(1,)]), f"{tmp_path}/x/one")
    tables.write_table(rows("a:long b:string", [(2, "z")]), f"{tmp_path}/x/two")
    (tmp_path / "x" / "one" / "part-empty.parquet").write_bytes(b"")
    got = sorted((r.a, r.b) for r in tables.read_parts(spark, f"{tmp_path}/x", schemas.schema("a:long b:string")).collect())
    assert got == [(1, None), (2, "z")]


def test_a_broken_part_is_not_lost_in_silence(spark, tmp_path):
    tables.write_table(spark.range(10), f"{tmp_path}/x")
    (tmp_path / "x" / "part-broken.parquet").write_bytes(b"PAR1 this is no table PAR1")
    with pytest.raises(Exception, match="part-broken"):
        tables.read_parts(spark, f"{tmp_path}/x", schemas.schema("id:long")).collect()


def test_columns_are_found_by_each_files_own_header(spark, tmp_path):
    (tmp_path / "a.csv").write_text('k,v,extra\n1,"x, y",e\n2,,\n')
    (tmp_path / "b.csv").write_text("\ufeffv, other,k\nz,o,3\n\nbad,o,four\n")
    (tmp_path / "c.csv").write_text("")
    (tmp_path / "d.csv").write_text("k\n5\n")
    got = tables.read_csv(spark, str(tmp_path), schemas.schema("v:string k:int")).collect()
    assert sorted(((r.k or 0), r.v) for r in got if r.v) == [(0, "bad"), (1, "x, y"), (3, "z")]
    assert sorted(r.k for r in got if r.v is None) == [2, 5]


def test_daily_files_by_folder_and_in_two_orders(spark, tmp_path):
    for place, text in {
        "KDEN/2022-09-01/ETD_data_set": "timestamp,x,departure_runway_estimated_time,gufi\n2022-09-01 08:00:00,q,2022-09-01 09:00:00,g1\n",
        "KATL/2022-09-02/ETD_data_set": "gufi,departure_runway_estimated_time,timestamp\ng2,2022-09-02 09:00:00,2022-09-02 08:00:00\n",
        "KATL/2022-09-01_2022-09-02/ETD_data_set": "gufi,departure_runway_estimated_time,timestamp\ng9,2022-09-02 09:00:00,\n",
    }.items():
        (tmp_path / place).mkdir(parents=True)
        (tmp_path / place / "part-0.csv").write_text(text)
    pattern = r"/([^/]+)/(\d{4}-\d{2}-\d{2})/(\w+)/[^/]+$"
    got = flights.read_daily(spark, str(tmp_path), "ETD_data_set", pattern, "*.csv").collect()
    assert sorted((r.gufi, r.arrival_airport, r.departure_runway_estimated_time, r.timestamp) for r in got) == [
        ("g1", "KDEN", at("2022-09-01 09:00"), at("2022-09-01 08:00")),
        ("g2", "KATL", at("2022-09-02 09:00"), at("2022-09-02 08:00")),
    ]


def test_compaction(spark, tmp_path):
    tables.write_table(spark.range(1000).repartition(20), f"{tmp_path}/small")
    tables.compact(spark, f"{tmp_path}/small", f"{tmp_path}/large", schemas.schema("id:long"), target_bytes=4000)
    large = spark.read.parquet(f"{tmp_path}/large")
    assert 1 < len(large.inputFiles()) < 20 and large.count() == 1000


def test_template_columns_are_found_by_name(spark, tmp_path):
    (tmp_path / "t.csv").write_text("Value,ID\n0,KDEN_220925_0100_15\n")
    assert tuple(tables.read_template(spark, str(tmp_path / "t.csv")).first()) == ("KDEN_220925_0100_15", 0)


def test_ingest_takes_each_source_once(spark, tmp_path, rows):
    spec, sink = "source_file:string v:long", f"{tmp_path}/sink"
    append_new(rows(spec, [("a", 1), ("b", 2)]), sink)
    append_new(rows(spec, [("a", 99), ("c", 3)]), sink)
    assert sorted((r.source_file, r.v) for r in spark.read.parquet(sink).collect()) == [("a", 1), ("b", 2), ("c", 3)]


def test_stream_takes_each_file_once(spark, tmp_path, rows):
    source, sink, done = (f"{tmp_path}/{n}" for n in ("in", "out", "done"))
    for n in (1, 2):
        tables.write_table(rows("v:long", [(n,)]), source, mode="append")
        for _ in range(2):
            stream_new_files(spark, source, sink, schemas.schema("v:long"), done)
    assert sorted(r.v for r in spark.read.parquet(sink).collect()) == [1, 2]


def test_casts(rows):
    df = rows("a:long b:double c:string", [(1, float("nan"), "x"), (2**40, 2.5, "7")])
    narrow = casting.downcast(df)
    assert [t for _, t in narrow.dtypes] == ["int", "float", "string"]
    assert [r.a for r in narrow.collect()] == [1, None]
    assert [r.b for r in casting.null_not_nan(df).collect()] == [None, 2.5]
    assert [r.c for r in casting.conform(df, schemas.schema("c:int missing:ts")).collect()] == [None, 7]


class Session:
    """Just the parts of a session that name the shared folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = SimpleNamespace(master=master)
        self.conf = SimpleNamespace(get=lambda key, default: folder if key == "spark.checkpoint.dir" else default)


def test_shared_folder_comes_from_the_session():
    assert session.scratch(Session("spark://x", "hdfs://n/shared/"), "x").startswith("hdfs://n/shared/tarmac/x-")
    local = Session("local[2]")
    local.conf.get = lambda key, default=None: "file:/w/house" if key == "spark.sql.warehouse.dir" else default
    assert session.scratch(local, "x").startswith("file:/w/house-scratch/tarmac/x-")
    assert session.scratch(local, "x") != session.scratch(local, "x")
    with pytest.raises(ValueError):
        session.scratch(Session("spark://x"), "x")


def test_scan_is_pruned_and_filtered(spark):
    from conftest import TESTDATA

    df = tables.table(spark, TESTDATA, "events").filter(F.col("value") > 100).select("ts")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(value), GreaterThan(value,100.0)]" in plan
    assert "ReadSchema: struct<ts:timestamp_ntz,value:double>" in plan
