import pytest
from pyspark.sql import functions as F

from tracewright.sources import dataformat, split, tables

ONE = "C:\\run\\a.d,,\nbanner\nAcquired : 15/12/2014 7:23:34 PM using Batch x,,\nTime [Sec],Li7,Mg24\n0.5,1,2\n1.0,3,nan\n1.5,x,4\n,,\n,,\nPrinted: now,,\n"
TWO = "C:\\run\\b.d,,\nbanner\nAcquired : 15/12/2014 7:25:34 PM using Batch x,,\nTime [Sec],Mg24,Li7,U238\n0.5,20,10,9\n,,\n,,\nPrinted: now,,\n"
FORMAT = {"header": 3, "footer": 3, "meta": {"0": [["path"], "([^,]*)"], "Acquired": [["date", "method"], "Acquired *: (.*) using ([^,]*)"]}}


@pytest.fixture
def lines(spark, tmp_path):
    (tmp_path / "s 1.csv").write_text(ONE)
    (tmp_path / "s2.csv").write_text(TWO)
    (tmp_path / "note.txt").write_text("no trace")
    return dataformat.scan_lines(spark, str(tmp_path), ".csv")


def test_traces(lines):
    got = dataformat.traces(lines, FORMAT)
    assert got.columns == ["sample", "file", "idx", "time", "Li7", "Mg24", "total_counts"]
    rows = [tuple(r) for r in got.drop("file").orderBy("sample", "idx").collect()]
    assert rows == [("s1", 0, 0.5, 1.0, 2.0, 3.0), ("s1", 1, 1.0, 3.0, None, 3.0), ("s1", 2, 1.5, None, 4.0, 4.0), ("s2", 0, 0.5, 10.0, 20.0, 30.0)]


def test_metadata_and_dates(lines):
    meta = {r.file: r.meta for r in dataformat.metadata(lines, dataformat.checked(FORMAT)).collect()}
    assert meta["s2.csv"] == {"path": "C:\\run\\b.d", "date": "15/12/2014 7:25:34 PM", "method": "Batch x"}
    starts = dataformat.metadata(lines, dataformat.checked(FORMAT)).select(F.regexp_replace(F.regexp_replace("file", " ", ""), ".csv", "").alias("sample"), dataformat.parsed_date(F.col("meta")["date"]).alias("start"))
    timed = dataformat.with_universal_time(dataformat.traces(lines, FORMAT), starts)
    assert timed.where("sample = 's2'").first().u_time == 120.5
    in_turn = dataformat.with_universal_time(dataformat.traces(lines, FORMAT))
    assert in_turn.where("sample = 's2'").first().u_time == 2.0


def test_variants(spark, lines):
    assert dataformat.traces(lines, FORMAT | {"header": "Time ["}).count() == 4
    assert dataformat.traces(lines, FORMAT | {"time_unit": "ms"}).agg(F.max("time")).first()[0] == 0.0015
    assert dataformat.traces(lines, FORMAT | {"replace": {"Mg24": "Zn66"}}).columns[4:6] == ["Li7", "Zn66"]
    with pytest.raises(ValueError):
        dataformat.checked({"time_unit": "years"})
    with pytest.raises(ValueError):
        dataformat.checked({"time_divide": 3})
    assert {r.step: r.rows for r in dataformat.explained(lines, FORMAT).collect()}["data rows"] == 4


def test_same_names_are_numbered(spark):
    texts = spark.createDataFrame([("a.csv", ONE), ("a.txt", ONE)], "file string, text string")
    got = dataformat.traces(dataformat.lines_of(texts, "file", "text"), FORMAT)
    assert {r.sample for r in got.collect()} == {"a_0", "a_1"}


def test_nested_metadata(spark):
    got = spark.range(1).select(dataformat.nested_metadata(F.lit("Lens:A=1;B=2\nnothing\nGas:C=x"))).first()[0]
    assert got == {"Lens": {"A": "1", "B": "2"}, "Gas": {"C": "x"}}


def test_sections(spark):
    text = "head\nskip\n# one\n1\n2\n# two\n3\n# one\n"
    lines = dataformat.lines_of(spark.createDataFrame([("f", text)], "file string, text string"), "file", "text")
    got = split.by_regex(lines, "^# (.*)", global_rows=1).orderBy("section", "line_no").collect()
    assert [(r.section, r.name, r.line_no, r.line) for r in got][:4] == [(0, "one", -1, "head"), (0, "one", 0, "# one"), (0, "one", 1, "1"), (0, "one", 2, "2")]
    assert split.by_regex(lines, "^#", trim_head=1).where("section = 0").orderBy("line_no").first().name == "no_name_0"


def test_maps(spark):
    row = spark.range(1).select(tables.vertices(F.lit("0,0,1;30,40,1")).alias("v"), tables.settings(F.lit("ScanSpeed=5;Spot=2")).alias("s"), F.lit(1.0).alias("t"), F.lit(5.0).alias("speed"))
    got = tables.on_scan(row, "t", "v", "speed").first()
    assert (got.d, got.x, got.y, got.s["Spot"]) == (20.0, 12.0, 16.0, "2")
    assert spark.range(1).select(tables.image_map(F.lit('<ImageMap><Size Width="2" Height="3"/><Center X="1" Y="0"/></ImageMap>')).alias("m")).first().m.Size._Width == 2.0


def test_written_traces_read_back(spark, tmp_path):
    df = spark.createDataFrame([("a", 0, 0.5, 1.0), ("a", 1, 1.0, 2.0), ("b", 0, 0.5, 3.0)], "sample string, idx int, time double, v double")
    tables.write_traces(df, str(tmp_path / "t"), ["v"], {"v": F.col("v") > 1})
    got = {(r.sample, r.idx): r.v for r in tables.read_traces(spark, str(tmp_path / "t")).collect()}
    assert got == {("a", 0): None, ("a", 1): 2.0, ("b", 0): 3.0}
