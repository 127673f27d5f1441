from conftest import at
from pyspark.sql import functions as F

from tarmac.functions import extract
from tarmac.sources import reports

OBSERVED = """2022/09/01 00:53
KDEN 010053Z 26020G35KT 10SM FEW030 SCT045CB BKN100 OVC200 31/M02 A2992

2022/09/01 00:55
KATL 010055Z 09017KT 9999 CLR 25/20 Q1011

2022/09/01 00:56
EGLL 010056Z 09017KT 9999 CLR 25/20 Q1011
2022/09/01 00:57
"""


def observed(rows, legacy=False, text=OBSERVED):
    df = reports.parse_observations(rows("value:string source_file:string", [(text, "a.txt")]), legacy=legacy)
    return {r.station_id: r for r in df.collect()}


def test_observation_fields(rows):
    got = observed(rows)
    assert set(got) == {"KDEN", "KATL"}
    r = got["KDEN"]
    assert r.datetime == at("2022-09-01 00:53") and r.block_no == 0
    assert (r.wind_direction, r.wind_speed, r.wind_gust) == (260, 20, 35)
    assert round(r.visibility, 1) == 16093.4
    assert (r.temperature, r.dew_point) == (31, -2)
    assert r.altimeter_tenths_hpa == 10132
    layers = [(r[f"cover_type_{i}"], r[f"altitude_{i}"], r[f"cloud_type_{i}"]) for i in (1, 2, 3)]
    assert layers == [("FEW", 3000, None), ("SCT", 4500, "CB"), ("BKN", 10000, None)]
    a = got["KATL"]
    assert (a.visibility, a.altimeter_tenths_hpa, a.cover_type_1, a.altitude_1) == (9999, 10110, "CLR", None)


def test_observation_fields_legacy(rows):
    r = observed(rows, legacy=True)["KDEN"]
    assert (r.wind_direction, r.wind_speed, r.wind_gust, r.visibility, r.altimeter_tenths_hpa) == (None,) * 5


def test_duplicates_and_rejects(rows):
    texts = rows("value:string source_file:string", [(OBSERVED + OBSERVED, "a.txt")])
    assert reports.parse_observations(texts).count() == 2
    rejected = reports.rejected_observations(texts).collect()
    assert {r.block for r in rejected} == {"2022/09/01 00:57"}


def fields(rows, line, base="2022-09-01 00:00:00", legacy=False):
    df = rows("block:string issue_ts:ts", [(line, base)]).withColumn("line", F.col("block"))
    return extract.forecast_fields(extract.with_validity(df, legacy=legacy), legacy=legacy).first()


def test_validity_is_not_a_temperature(rows):
    line = "KDEN 010000Z 0100/0206 09010KT"
    assert fields(rows, line).temperature is None
    legacy = fields(rows, line, legacy=True)
    # The legacy pattern takes the last two digits before the slash and the first two after it.
    assert (legacy.temperature, legacy.dew_point) == (0, 2)


def test_forecast_visibility(rows):
    for text, expected, legacy in [("P6SM", 6, 6), ("9999", 6, 6), ("1/2SM", 0.5, 2), ("1 1/2SM", 1.5, 2), ("3SM", 3, 3)]:
        line = f"FM010300 18012KT {text} BKN008"
        assert fields(rows, line).visibility == expected
        assert fields(rows, line, legacy=True).visibility == legacy


def test_forecast_pressure(rows):
    assert fields(rows, "X QNH2992INS").altimeter_tenths_hpa == 10132
    assert fields(rows, "X QNH1013HPA").altimeter_tenths_hpa == 10130
    assert fields(rows, "X A2992").altimeter_tenths_hpa == 10132
    assert fields(rows, "X A2992", legacy=True).altimeter_tenths_hpa is None


FORECAST = """2022/09/30 18:00
TAF KDEN 301720Z 3018/0124 09010KT P6SM FEW030
  FM302100 18012G25KT 3SM BKN008
  TEMPO 3022/0102 1/2SM OVC004

2022/09/30 18:00
Ammendment
TAF AMD KATL 301720Z 3018/0118 09012KT P6SM SKC
2022/09/30 18:05
CORRECTION
TAF COR KMIA 301720Z 3018/0118 09012KT P6SM SKC
"""


def test_forecast_lines(rows):
    texts = rows("value:string source_file:string", [(FORECAST, "/x/taf.20220930.18Z.txt")])
    got = reports.parse_forecasts(texts).orderBy("block_no", "line_no").collect()
    assert [(r.station_id, r.kind) for r in got] == [("KDEN", "original")] * 3 + [("KATL", "amended"), ("KMIA", "corrected")]
    main, change, sporadic = got[:3]
    assert main.datetime == at("2022-09-30 18:00")
    assert (main.validity_start, main.validity_end) == (at("2022-09-30 18:00"), at("2022-10-02 00:00"))
    assert main.from_time is None and change.from_time == at("2022-09-30 21:00")
    assert (sporadic.tempo_start, sporadic.tempo_end) == (at("2022-09-30 22:00"), at("2022-10-01 02:00"))
    assert (change.wind_speed, change.wind_gust, change.visibility) == (12, 25, 3)


def test_block_with_both_markers_is_both_kinds(rows):
    text = "2022/09/30 18:00\nAmmendment Correction\nTAF KATL 301720Z 3018/0118 09012KT"
    texts = rows("value:string source_file:string", [(text, "taf.20220930.18Z.txt")])
    assert sorted(r.kind for r in reports.parse_forecasts(texts).collect()) == ["amended", "corrected"]


def test_text_files(spark, tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "a.txt").write_text(OBSERVED)
    (tmp_path / "deep" / "b.txt").write_bytes(OBSERVED.replace("CLR", "CLR \xe9").encode("latin-1"))
    (tmp_path / "c.csv").write_text("no report")
    read = reports.read_texts_any_encoding(spark, str(tmp_path))
    assert read.count() == 2
    assert reports.parse_observations(read).count() == 4
    assert read.filter(F.contains("value", F.lit("é"))).count() == 1
    plain = reports.read_texts(spark, str(tmp_path))
    assert sorted(r.source_file.rsplit("/", 1)[1] for r in plain.collect()) == ["a.txt", "b.txt"]
