import io
import zipfile

import pytest

from twinframe import shared, sinks
from twinframe.sources import files, tables, workbooks


def put(path, text, encoding="utf-8"):
    path.write_bytes(text.encode(encoding))
    return str(path)


def test_csv_is_text_and_only_empty_is_null(spark, tmp_path, rows):
    path = put(tmp_path / "a.csv", 'ID,Name,Note\n007,"",x\n2,NA,null\n3,"a ""q"", b\nnext",\n')
    df = files.read_file(spark, path)
    assert df.columns == ["id", "name", "note"] and {f.dataType.simpleString() for f in df.schema} == {"string"}
    assert rows(df) == [("007", None, "x"), ("2", "NA", "null"), ("3", 'a "q", b\nnext', None)]


@pytest.mark.parametrize("multi_line", [True, False])
def test_csv_row_lengths(spark, tmp_path, rows, multi_line):
    short = put(tmp_path / "short.csv", "a,b,c\n1,2\n3,4,5\n")
    assert rows(files.read_csv(spark, short, multi_line=multi_line)) == [("1", "2", None), ("3", "4", "5")]
    long = put(tmp_path / "long.csv", "a,b\n1,2\n3,4,5\n")
    with pytest.raises(Exception, match="more fields than the header"):
        files.read_csv(spark, long, multi_line=multi_line).count()


@pytest.mark.parametrize("encoding, found", [
    ("utf-8", "UTF-8"), ("utf-8-sig", "UTF-8"), ("utf-16", "UTF-16"), ("iso-8859-1", "ISO-8859-1")])
def test_encodings(spark, tmp_path, rows, encoding, found):
    path = put(tmp_path / "e.csv", "id,name\n1,Zoé\n2,ö\n", encoding)
    assert files.detect_encoding(spark, path) == found
    df = files.read_csv(spark, path)
    assert df.columns == ["id", "name"] and rows(df) == [("1", "Zoé"), ("2", "ö")]


def test_delimiters(spark, tmp_path, rows):
    assert rows(files.read_file(spark, put(tmp_path / "a.txt", "x|y\n1|a,b\n"), format="csv", sep="|")) == [("1", "a,b")]
    assert rows(files.read_file(spark, put(tmp_path / "a.tsv", "x\ty\n1\tb\n"), format="csv", sep="\t")) == [("1", "b")]


def test_json_orients(spark, tmp_path, rows):
    read = lambda text, orient: files.read_json(spark, put(tmp_path / f"{orient}.json", text), orient)
    records = read('[{"ID": 1, "n": "a"}, {"ID": 2}]', "records")
    assert rows(records.select("id", "n")) == [(1, "a"), (2, None)]
    index = read('{"r1": {"id": 1, "n": "a"}, "r2": {"id": 2, "n": null}}', "index")
    assert rows(index.select("id", "n")) == [("1", "a"), ("2", None)]
    columns = read('{"id": {"0": 1, "1": 2}, "n": {"0": "a", "1": "b"}}', "columns")
    assert rows(columns.select("id", "n")) == [("1", "a"), ("2", "b")]
    assert rows(read('[[1, "a"], [2]]', "values")) == [("1", "a"), ("2", None)]
    with pytest.raises(ValueError):
        files.read_json(spark, str(tmp_path), "split")


def test_file_sizes(spark, tmp_path, rows):
    path = put(tmp_path / "a.csv", "a,b\n")
    assert [(r.path[-5:], r.bytes) for r in files.file_sizes(spark, path).collect()] == [("a.csv", 4)]


def test_unknown_format(spark):
    with pytest.raises(ValueError, match="unsupported format"):
        files.read_file(spark, "book.xlsx")


def test_tables(spark, rows):
    spark.createDataFrame([(1, "a", 1.5), (2, "b", 2.5), (3, "c", 3.5)], "Id int, s string, v double").createOrReplaceTempView("some_rows")
    assert rows(tables.read_table(spark, "some_rows", columns=["V", "id"], where="WHERE v > 2")) == [(2, 2.5), (3, 3.5)]
    assert tables.read_table(spark, query="SELECT * FROM some_rows", limit="2").count() == 2
    assert tables.read_table(spark, "some_rows", columns=["nope"]).columns == []
    for limit in (0, -1, "x"):
        with pytest.raises(ValueError):
            tables.read_table(spark, "some_rows", limit=limit)
    with pytest.raises(ValueError):
        tables.read_table(spark)
    assert tables.normalize_where("   ") is None and tables.normalize_where(" where a = 1") == "a = 1"


def archive(inner):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in inner.items():
            z.writestr(name, text)
    return out.getvalue()


BOOK = ("<workbook name='B'><datasources><datasource name='Parameters'/><datasource caption='Sales' name='x'>"
        "<metadata-record><local-name>[Amount]</local-name><local-type>real</local-type></metadata-record>"
        "<metadata-record><local-name>[System X]</local-name></metadata-record></datasource>"
        "<datasource name='Plain'><column name='[City]' datatype='string'/></datasource>"
        "<datasource name='Loose'><thing name='[Any]' type='nominal'/></datasource></datasources>"
        "<worksheet/><worksheet/><dashboard/></workbook>")


def test_workbooks(spark, tmp_path, rows):
    (tmp_path / "a.twbx").write_bytes(archive({"a.twb": BOOK, "Data/x.csv": "Id,City\n1,\n2,Ulm\n"}))
    (tmp_path / "b.tdsx").write_bytes(archive({"b.tds": "<datasource name='Solo'><column name='[A]'/></datasource>",
                                               "x.tsv": "Id\tCity\n1\tA,B\n"}))
    found = workbooks.read_archives(spark, str(tmp_path))
    listed = workbooks.workbook_catalog(found).select("datasource_name", "column_name", "datatype", "raw_name", "found_by")
    assert rows(listed) == [
        ("Loose", "Any", "nominal", "[Any]", "element-search"), ("Plain", "City", "string", "[City]", "column-element"),
        ("Sales", "Amount", "real", "[Amount]", "metadata-record"), ("Solo", "A", "unknown", "[A]", "column-element")]
    inventory = {r.path[-6:]: r for r in workbooks.workbook_inventory(found).collect()}
    assert (inventory["a.twbx"].datasource_count, inventory["a.twbx"].worksheet_count, inventory["a.twbx"].has_csv) == (3, 2, True)
    assert rows(workbooks.embedded_frame(found, ["id", "city"]).select("id", "city")) == [("1", "A,B"), ("1", None), ("2", "Ulm")]
    best = workbooks.match_source(workbooks.workbook_catalog(found), "sale").collect()
    assert [r.datasource_name for r in best] == ["Sales"]


def _grouped_rows(monkeypatch, spark, call):
    """What `call` returns, and the most rows that a grouping or join of it reads."""
    sizes, whole = [], type(spark.range(1)).groupBy
    monkeypatch.setattr(type(spark.range(1)), "groupBy", lambda df, *by: (sizes.append(df.count()), whole(df, *by))[1])
    return call(), max(sizes)


def test_inventory_groups_one_row_an_archive(spark, monkeypatch):
    """Archives are counted where they are read; those of one path add up, and one without a path is listed."""
    twice = "<workbook name='B'><datasource name='P'/><datasource/><datasource name='Parameters'/><worksheet/></workbook>"
    found = spark.createDataFrame(
        [("a", archive({"a.twb": BOOK, "x.csv": ""})), ("b", archive({"b.twb": twice})), ("b", archive({"b.twb": twice})),
         (None, archive({"c.tds": "<datasource caption='C' name='Parameters'/>", "y.hyper": ""}))], "path string, content binary")
    listed, rows = _grouped_rows(monkeypatch, spark, lambda: workbooks.workbook_inventory(found))
    assert rows == 4
    assert sorted((tuple(r) for r in listed.drop("file_size").collect()), key=repr) == [
        ("a", "B", 3, 2, 1, False, False, True), ("b", "B", 2, 2, 0, False, False, False),
        (None, "Parameters", 0, 0, 0, True, False, False)]


def test_catalog_parses_archives_once(spark):
    """The joins read the stored elements, not the archives again."""
    found = spark.createDataFrame([(p, archive({"a.twb": BOOK})) for p in ("a", "b", "b")], "path string, content binary")
    listed = workbooks.workbook_catalog(found)
    assert "MapIn" not in listed._jdf.queryExecution().executedPlan().toString()
    names = [("Loose", "Any", 0), ("Plain", "City", 0), ("Sales", "Amount", 0)]
    assert sorted(tuple(r) for r in listed.select("path", "datasource_name", "column_name", "position").collect()) == [
        (p, *n) for p in ("a", "b") for n in names]


def test_sinks(spark, tmp_path, rows):
    df = spark.createDataFrame([("a", "", 'q "x", y')], "n string, e string, t string")
    sinks.write_results(df, str(tmp_path / "r"), "one")
    sinks.write_results(df, str(tmp_path / "r"), "two")
    assert sorted(r.run_id for r in spark.read.parquet(str(tmp_path / "r")).collect()) == ["one", "two"]
    sinks.write_csv(df, str(tmp_path / "c"))
    assert len(list((tmp_path / "c").glob("*.csv"))) == 1
    assert rows(files.read_csv(spark, str(tmp_path / "c"))) == [("a", None, 'q "x", y')]
    assert sinks.report_folder("My Run/1").startswith("my_run_1-")
    first, second = (sinks.write_report(df, str(tmp_path / "reports"), n) for n in ("A/B", "a b"))
    assert first != second and rows(files.read_csv(spark, first)) == rows(files.read_csv(spark, second))


def test_long_reports_are_gzipped_in_parts(spark, tmp_path, rows, monkeypatch):
    monkeypatch.setattr(sinks, "FILE_ROWS", 3)
    df = spark.createDataFrame([(f"n{i}", None if i % 2 else 'q "x", y') for i in range(8)], "n string, t string").coalesce(1)
    sinks.write_csv(df, str(tmp_path / "long"), single_file=False)
    assert len(list((tmp_path / "long").glob("*.csv.gz"))) == 3
    assert rows(files.read_csv(spark, str(tmp_path / "long"), multi_line=False)) == rows(df)


def _file(folder, name, text, encoding="utf-8"):
    folder.mkdir(exist_ok=True)
    (folder / name).write_bytes(text.encode(encoding))
    return str(folder)


@pytest.mark.parametrize("row,good", [("1,2", True), ("1", True), ("1,2,", False), ("1,2,,", False), ("1,2,,x", False),
                                      ('5"x,6"x', True), ('5"x,6"x,7', False), ('5",6",7', False), ('a,"b"c', True), ('a, "b,c"', False),
                                      ('"1,5",2', True), ('"a ""b"", c",2', True), ('"x\ny",2', True), ('"x\ny",2,', False)])
def test_field_counts(spark, tmp_path, row, good):
    path = _file(tmp_path / "f", "a.csv", f"a,b\n{row}\n3,4\n")
    if good:
        assert files.read_csv(spark, path).count() == 2
    else:
        with pytest.raises(Exception, match="more fields"):
            files.read_csv(spark, path).collect()
        with pytest.raises(Exception, match="more fields"):
            files.read_csv(spark, path).count()


def test_headers_of_a_folder_must_agree(spark, tmp_path):
    _file(tmp_path / "f", "1.csv", "a,b\n1,2\n")
    path = _file(tmp_path / "f", "2.csv", "b,a\n3,4\n")
    with pytest.raises(Exception, match="(?i)header"):
        files.read_csv(spark, path).collect()


def test_mixed_encodings(spark, tmp_path, rows):
    _file(tmp_path / "f f", "1.csv", "a,b\né,2\n")
    _file(tmp_path / "f f", "3.csv", "a,b\nü,3\n", "utf-16")
    path = _file(tmp_path / "f f", "2.csv", "a,b\nñ,1\n", "latin-1")
    assert rows(files.read_csv(spark, path)) == [("é", "2"), ("ñ", "1"), ("ü", "3")]


def test_json_by_lines_and_documents(spark, tmp_path, rows):
    _file(tmp_path / "f", "1.json", '{"a": 1, "b": "x"}\n{"a": 2, "b": "y"}\n\n{"a": 3, "b": "z"}\n')
    assert rows(files.read_json(spark, str(tmp_path / "f"))) == [(1, "x"), (2, "y"), (3, "z")]
    path = _file(tmp_path / "f", "2.json", '[{"a": 4,\n "b": "q"},\n {"a": 5, "b": "r"}]')
    assert [r[0] for r in rows(files.read_json(spark, path))] == [1, 2, 3, 4, 5]
    assert files.read_json(spark, str(tmp_path / "f" / "1.json"), lines=True).count() == 3


@pytest.mark.parametrize("text", ['{"a": 1}\n{"a": 2}\n{"a":', '{"a": 1}\n{"a": 2}\nx\n{"a": 3}', '{"a": 1}\n\n{"a"', '{"a": 1', '[{"a": 1}, {"a"'])
def test_broken_json_is_an_error(spark, tmp_path, text):
    path = _file(tmp_path / "f", "1.json", text)
    with pytest.raises(Exception, match="(?i)malformed"):
        files.read_json(spark, path).collect()


def test_marks_within_a_file_are_text(spark, tmp_path, rows):
    (tmp_path / "f").mkdir()
    (tmp_path / "f" / "1.csv").write_bytes(b"a,b\n\xff\xfe,1\n\xe9,2\n")
    assert rows(files.read_csv(spark, str(tmp_path / "f"))) == [("\xe9", "2"), ("\xff\xfe", "1")]


def test_json_columns_of_several_files(spark, tmp_path, rows):
    _file(tmp_path / "f", "1.json", '{"a": {"0": "1", "1": "2"}, "b": {"0": "x", "1": "y"}}')
    path = _file(tmp_path / "f", "2.json", '{"a": {"0": "3", "1": "4"}, "b": {"0": "z", "1": null}}')
    assert rows(files.read_json(spark, path, "columns")) == [("1", "x"), ("2", "y"), ("3", "z"), ("4", None)]


def test_shared_folder_comes_from_the_session(spark):
    assert shared.new_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_written_keeps_rows_and_types(spark, rows):
    df = spark.createDataFrame([(1, "a", None)], "i int, `a b (c)` string, d decimal(5,2)")
    out = shared.written(df)
    assert out.schema == df.schema and rows(out) == rows(df)
    void = spark.sql("SELECT 1 AS i, NULL AS n")
    assert shared.written(void) is void


def test_spread(spark):
    assert shared.spread(spark.range(10, numPartitions=1)).rdd.getNumPartitions() == 4
    assert shared.spread(spark.range(10, numPartitions=9)).rdd.getNumPartitions() == 9
