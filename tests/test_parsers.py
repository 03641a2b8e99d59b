import pytest
from pyspark.sql import functions as F

from tracewright.sources import parsers


def test_two_parsers_and_one_of_the_caller_s(spark):
    df = spark.createDataFrame([("a", "Laser:spot=50;rate=10 Hz\nno category\nGas: He=0.8 ; Ar = 1.0;odd\nEmpty:"), ("b", None), ("c", "")], "file string, block string").repartition(2)
    got = sorted(map(tuple, parsers.parsed(df, "categories").collect()))
    assert got == [("a", "Gas", "Ar", "1.0"), ("a", "Gas", "He", "0.8"), ("a", "Laser", "rate", "10 Hz"), ("a", "Laser", "spot", "50")]
    pairs = spark.createDataFrame([("a", "date: 2020-01-01 10:00\nuser=x:y\nnothing")], "file string, block string")
    assert sorted(map(tuple, parsers.parsed(pairs, "pairs").collect())) == [("a", 0, "date", "2020-01-01 10:00"), ("a", 1, "user", "x:y")]

    @parsers.parser("words", "word string, n long")
    def words(lines):
        for w in sorted({w for x in lines for w in x.split()}):
            yield w, sum(x.split().count(w) for x in lines)

    try:
        out = parsers.parsed(spark.createDataFrame([("a", 1, "x y\nx"), ("b", 2, "z")], "file string, k int, block string"), "words")
        assert out.dtypes == [("file", "string"), ("k", "int"), ("word", "string"), ("n", "bigint")]
        assert sorted(map(tuple, out.collect())) == [("a", 1, "x", 2), ("a", 1, "y", 1), ("b", 2, "z", 1)]
    finally:
        del parsers.PARSERS["words"]
    with pytest.raises(ValueError):
        parsers.parsed(df, "words")


def test_by_sql_and_from_lines(spark):
    spark.udtf.register("parse_metadata", parsers.table_function())
    spark.createDataFrame([("f", 0, "head"), ("f", 1, "A:x=1"), ("f", 2, "B:y=2;z=3"), ("f", 3, "C:no=0"), ("g", 1, "D:q=9")], "file string, line_no int, line string").createOrReplaceTempView("header_lines")
    parsers.header_blocks(spark.table("header_lines"), 1, 3).createOrReplaceTempView("header_blocks")
    got = spark.sql("SELECT b.file, m.* FROM header_blocks b, LATERAL parse_metadata('categories', b.block) m").collect()
    assert sorted(map(tuple, got)) == [("f", "A", "x", "1"), ("f", "B", "y", "2"), ("f", "B", "z", "3"), ("g", "D", "q", "9")]
    with pytest.raises(Exception, match="name of a parser"):
        spark.sql("SELECT * FROM parse_metadata('unknown', 'x')").collect()


def test_null_blocks(spark):
    assert parsers.parsed(spark.createDataFrame([("a", None)], "file string, block string"), "pairs").collect() == []
    assert parsers.parsed(spark.range(3).select(F.lit("k: v").alias("block"), "id"), "pairs").count() == 3
