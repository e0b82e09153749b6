"""Many small files: written in tasks dealt by number, and lines parsed without a parser for each cell."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tidewell.sources import files


def test_files_of_lines(spark, tmp_path):
    rows = [(f"{i % 7}/{i}.csv", "a,b" if i % 3 else None, f"{i},{k}" if i % 3 else None) for i in range(40) for k in range(5)] + [("long.csv", "a,b", str(k)) for k in range(9001)]
    files.sink_files(spark.createDataFrame(rows, "name string, head string, line string"), str(tmp_path / "out"))
    got = {str(p.relative_to(tmp_path / "out")): p.read_text().splitlines() for p in (tmp_path / "out").rglob("*.csv")}
    assert len(got) == 41 and sum(not v for v in got.values()) == 14
    assert all(v[0] == "a,b" and sorted(v[1:]) == [f"{n[2:-4]},{k}" for k in range(5)] for n, v in got.items() if v and n != "long.csv")
    assert got["long.csv"][0] == "a,b" and sorted(map(int, got["long.csv"][1:])) == list(range(9001))


@pytest.mark.parametrize("line", ("1,2,3", "", ",,", "a, b ,c", '1,"x, y",3', '"q""q",2', "1,2,3,4,5,6", '1,2,3,4,"5",6', "x", None))
def test_cells_as_the_parser_has_them(spark, line):
    one = spark.createDataFrame([(line,)], "line string")
    row = one.select(F.from_csv("line", F.lit("c0 string, c1 string, c2 string, c3 string")).alias("r")).first().r or [None] * 4
    got = one.select(files.cells_of("line", 4).alias("c")).first().c or []
    assert [v or None for v in [*got, *[None] * 4][:4]] == list(row)


def test_a_line_of_very_many_cells(spark):
    one = spark.createDataFrame([(",".join(["7"] * 30000),)], "line string")  # beyond the parser's columns
    assert one.select(files.cells_of("line", 32).alias("c")).first().c == ["7"] * 32
