"""Records of several lines out of files that are read by splits."""

import csv
import io
import random

import pytest
from pyspark.sql import functions as F

from tarmac import schemas
from tarmac.functions import text
from tarmac.session import settings
from tarmac.sources import records, reports, tables


def splits(size):
    return {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "60"}


def blocks_of(df):
    return sorted((r.source_file.rsplit("/", 1)[1], r.block_no, r.block) for r in df.collect())


@pytest.mark.parametrize("size", [23, 200, 1 << 20])
def test_blocks_of_splits_equal_those_of_whole_texts(spark, tmp_path, size):
    dice = random.Random(size)
    stamp = "2024/03/01 10:00"
    for name in "abcde":
        parts = []
        for _ in range(30):
            parts.append(dice.choice([stamp, f"x {stamp} y {stamp}", "\n", "KDEN 0110 line", "\r\n", " ", "\n\n", f"\n{stamp}\n", "é" * 9]))
        (tmp_path / f"{name}.txt").write_text("".join(parts))
    (tmp_path / "first.txt").write_text(f"{stamp}\nA\n\n{stamp}\nB")
    (tmp_path / "none.txt").write_text("no stamp\nat all\n")
    (tmp_path / "void.txt").write_text("")
    whole = text.split_blocks(reports.read_texts(spark, str(tmp_path)))
    with settings(spark, splits(size)):
        got = blocks_of(records.read_blocks(spark, str(tmp_path)))
    assert got == blocks_of(whole)


def test_a_split_file_has_several_tasks(spark, tmp_path):
    (tmp_path / "big.txt").write_text("2024/03/01 10:00\nKDEN 011000Z\n" * 500)
    with settings(spark, splits(2000)):
        lines = records.numbered_lines(spark, str(tmp_path), "*.txt")
        assert lines.select("split").distinct().count() > 5
        assert records.read_blocks(spark, str(tmp_path)).count() == 500


def python_rows(content):
    rows = [r for r in csv.reader(io.StringIO(content, newline=""), strict=False) if r]
    return rows[0], rows[1:]


@pytest.mark.parametrize("size", [41, 1 << 20])
def test_csv_records_equal_a_parser_that_reads_the_whole_file(spark, tmp_path, size):
    dice = random.Random(size)
    want = []
    for number in range(6):
        header = ["k", "v", "w"] if number % 2 else ["v", "extra", "k", "w"]
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator=dice.choice(["\n", "\r\n"]))
        writer.writerow(header)
        for i in range(40):
            pick = lambda: dice.choice(["", "plain", "a,b", 'q"uo"te', "two\nlines", "\n", '"', "k,v,w", "\nv,extra,k,w\n", '","', "é\n\n\nü", 'end"\n'])  # noqa: E731, B023
            row = {name: pick() for name in header} | {"k": str(number * 100 + i)}
            writer.writerow([row[n] for n in header])
            want.append((int(row["k"]), row["v"] or None, row["w"] or None))
        (tmp_path / f"{number}.csv").write_text(out.getvalue(), newline="")
    with settings(spark, splits(size)):
        got = tables.read_csv(spark, str(tmp_path), schemas.schema("k:long v:string w:string")).collect()
    assert sorted(((r.k, r.v, r.w) for r in got), key=str) == sorted(want, key=str)


def test_quotes_inside_plain_fields_are_text(spark, tmp_path):
    content = 'k,v\n1,5" pipe\n2,"a""b"\n3,"x"y\n\n4,""\n5,\nk,v\n'
    (tmp_path / "a.csv").write_text(content)
    header, rows = python_rows(content)
    got = tables.csv_rows(spark, str(tmp_path)).collect()
    assert {tuple(r.header) for r in got} == {tuple(header)}
    assert sorted([c or "" for c in r.cells] for r in got) == sorted(rows)
    assert [r.cells for r in got if r.cells[0] == "4"] == [["4", ""]] and [r.cells for r in got if r.cells[0] == "5"] == [["5", None]]


def test_a_quoted_header_and_a_quote_that_never_ends(spark, tmp_path):
    (tmp_path / "a.csv").write_text('"two\nlines",k\nx,1\n"open,2\n3,4\n')
    got = sorted(tuple(r.cells) for r in tables.csv_rows(spark, str(tmp_path)).collect())
    assert got[-1] == ("x", "1") and len(got) == 2  # the rest of the file is one record


def test_long_quoted_fields(spark, tmp_path):
    (tmp_path / "a.csv").write_text("k,v\n1,\"" + "x" * 200_000 + "\n" + 'y""' * 5000 + '"\n')
    got = tables.read_csv(spark, str(tmp_path), schemas.schema("k:long v:string")).first()
    assert got.k == 1 and got.v == "x" * 200_000 + "\n" + 'y"' * 5000


def test_probe_lists_what_is_no_table(spark, tmp_path):
    tables.write_table(spark.range(10), f"{tmp_path}/x/a b")
    tables.write_table(spark.range(0), f"{tmp_path}/x/none")
    (tmp_path / "x" / "part-zero.parquet").write_bytes(b"")
    assert tables.probe_parts(spark, f"{tmp_path}/x").count() == 0
    (tmp_path / "x" / "part-bad.parquet").write_bytes(b"PAR1 and so on, cut off")
    sound, rejected = tables.read_sound_parts(spark, f"{tmp_path}/x", schemas.schema("id:long"))
    assert sound.count() == 10
    assert [(r.path.rsplit("/", 1)[1], r.length, r.reason) for r in rejected.collect()] == [("part-bad.parquet", 23, "no mark at the end")]


def test_a_fault_the_probe_cannot_see_still_fails(spark, tmp_path):
    tables.write_table(spark.range(10), f"{tmp_path}/x")
    (tmp_path / "x" / "part-odd.parquet").write_bytes(b"PAR1" + b"\x00" * 40 + b"\x08\x00\x00\x00PAR1")
    sound, rejected = tables.read_sound_parts(spark, f"{tmp_path}/x", schemas.schema("id:long"))
    assert rejected.count() == 0
    with pytest.raises(Exception, match="part-odd"):
        sound.collect()


def test_written_fields_come_back_as_they_were(spark, tmp_path, rows):
    data = [(1, " lead"), (2, "trail \n"), (3, 'q"'), (4, "a,b\nc"), (5, None), (6, "\\")]
    tables.write_csv(rows("k:long v:string", data), f"{tmp_path}/c")
    got = tables.read_csv(spark, f"{tmp_path}/c", schemas.schema("k:long v:string")).collect()
    assert sorted((r.k, r.v) for r in got) == data


def test_rejected_forecast_blocks_give_no_lines_and_no_second_search(spark):
    """Fields are computed once a block and once a line, however the rows are filtered."""
    from conftest import TESTDATA

    from tarmac.plans import QUERIES

    for name in ("parse_forecast_lines", "parse_observation_text"):
        plan = QUERIES[name](spark, TESTDATA)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("regexp_extract(") <= 25, name
    texts = spark.createDataFrame([("no date\nno report", "x/taf.20240301.06Z.txt")], "value string, source_file string")
    assert reports.parse_forecasts(texts).count() == 0
    assert reports.parse_forecasts(texts.withColumn("value", F.lit(None).cast("string"))).count() == 0
