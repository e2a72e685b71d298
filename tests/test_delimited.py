import pytest

from panelweave.sources import read_delimited, write_delimited

SCHEMA = "id INT, name STRING, x DOUBLE"


def test_texts_come_back_as_they_were(spark, tmp_path):
    rows = [(1, 'a "b" ; c', 1.5), (2, " lead ", None), (3, "", 0.0), (4, None, 2.0), (5, "two\nlines", -1.0),
            (6, "\\back", 1e300), (7, '"', 1.0), (8, ";", 1.0), (None, "é\t", 3.0)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    write_delimited(df, str(tmp_path / "t"))
    back = read_delimited(spark, str(tmp_path / "t"), SCHEMA, multiline=True)
    assert sorted(map(tuple, back.collect()), key=str) == sorted(rows, key=str)


@pytest.mark.parametrize("cell", ["7,5", "bad"])
def test_bad_cells_fail(spark, tmp_path, cell):
    (tmp_path / "t.csv").write_text(f"id;name;x\n1;a;{cell}\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|FAILFAST|BadRecord|CAST"):
        read_delimited(spark, str(tmp_path / "t.csv"), SCHEMA).collect()


def test_quotes_as_pandas_writes_them(spark, tmp_path):
    (tmp_path / "t.csv").write_text('id;name;x\n1;"a ""b"" ; c";\n2;"";1.0\n')
    got = read_delimited(spark, str(tmp_path / "t.csv"), SCHEMA).collect()
    assert [tuple(r) for r in got] == [(1, 'a "b" ; c', None), (2, "", 1.0)]
