import csv
import io
import pathlib
import random

import pytest
from conftest import code_of
from pyspark.sql import functions as F

from gridloom import ROW_ID, Catalog, Field, delimited, imports, records, row_id, tables, workbooks
from gridloom.functions.names import normalize_headers
from suite.workbook_bytes import workbook


def put(folder, name, text):
    path = pathlib.Path(folder(name))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(path)


def test_header_names():
    assert normalize_headers([" a ", "a", "", None, "b", "a"]) == ["a", "a_2", "column_3", "column_4", "b", "a_3"]


def test_colliding_header_names_are_refused(spark, folder):
    path = put(folder, "clash.csv", "a,a_2,a\n1,2,3\n")
    assert code_of(delimited.read_csv, spark, path) == "duplicate_dataset_fields"


def test_csv_edges(spark, folder):
    text = '﻿id,name,note,\n1,"a ""b""",x,y\n\n2,short\n,,,\n3, padded ,z,w,extra\n'
    found = imports.scan(delimited.read_csv(spark, put(folder, "edges.csv", text)))
    assert [f.name for f in found.fields] == ["id", "name", "note", "column_4"]
    rows = [tuple(r) for r in found.numbered().orderBy(ROW_ID).collect()]
    assert rows == [
        (1, 1, 'a "b"', "x", "y"), (2, 2, "short", None, None), (3, None, None, None, None), (4, 3, "padded", "z", "w"),
    ]
    assert found.row_count == 4 and all(f.nullable for f in found.fields)


@pytest.mark.parametrize(
    ("first", "second", "code"),
    [
        ("a,b", "b,a", "file_header_mismatch"), ("a,b", "a,b,c", "file_header_mismatch"), (" a,b", "a,b", "file_header_mismatch"),
        ("a,a", "a,b", "file_header_mismatch"), ("a,b", "a,b", None), (" a,", " a,", None), ("\ufeffa,b", "a,b", None),
    ],
)
def test_files_share_one_header(spark, folder, first, second, code):
    put(folder, "two/1.csv", f"{first}\n1,2\n")
    put(folder, "two/2.csv", f"{second}\n3,4\n")
    if code:
        assert code_of(imports.scan_csv, spark, folder("two")) == code
    else:
        assert imports.scan_csv(spark, folder("two")).row_count == 2


def test_quoted_newlines_need_multi_line(spark, folder):
    path = put(folder, "lines.csv", 'id,text\n1,"two\nlines"\n2,one\n')
    df = delimited.read_csv(spark, path, multi_line=True)
    assert [r.text for r in df.collect()] == ["two\nlines", "one"]


def test_file_gate(spark, folder):
    assert code_of(delimited.read_csv, spark, put(folder, "notes.txt", "a\n1\n")) == "unsupported_file_type"
    assert code_of(delimited.read_csv, spark, put(folder, "none.csv", "")) == "empty_file"
    assert delimited.check_file_type("x/Book.XLSM") == "xlsm"


def test_broken_utf8_fails_the_import(spark, folder):
    path = put(folder, "latin.csv", b"a,b\ncaf\xe9,1\n")
    assert code_of(imports.import_csv, spark, path, folder("out")) == "file_parse_failed"


def test_header_only_file(spark, folder):
    out, count = imports.import_csv(spark, put(folder, "head.csv", "a,b\n"), folder("out"))
    assert count == 0 and out.columns == [ROW_ID, "a", "b"]


def test_import_with_edited_fields(spark, folder):
    path = put(folder, "sales.csv", "order_id,amount,order_date\n1,10.5,2026-01-02\n2,20,2026-01-03\n")
    fields, count, head = imports.preview(spark, path)
    assert [(f.type, f.nullable) for f in fields] == [("integer", False), ("decimal", False), ("date", False)]
    assert count == 2 and head.count() == 2
    edited = [Field("paid", "integer", True, 1), Field("key", "text", False, 0)]
    out, count = imports.import_csv(spark, path, folder("sales"), fields=edited)
    assert [tuple(r) for r in out.orderBy(ROW_ID).collect()] == [(1, 10, "1"), (2, 20, "2")]
    assert code_of(imports.import_csv, spark, path, folder("sales"), fields=edited) == "physical_table_exists"
    bad = [Field("day", "integer", True, 2)]
    assert code_of(imports.import_csv, spark, path, folder("bad"), fields=bad) == "invalid_field_value"


def test_row_ids_over_many_splits(spark, folder):
    """Small splits, several files of different size, ids still in source order."""
    expected = []
    for part, size in enumerate((3000, 10, 9000)):
        rows = [part * 100_000 + i for i in range(size)]
        put(folder, f"many/part-{part}.csv", "v\n" + "\n".join(map(str, rows)) + "\n")
        expected += rows
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = imports.scan(delimited.read_csv(spark, folder("many")))
        got = [tuple(r) for r in found.numbered().orderBy(ROW_ID).collect()]
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert found.splits.count() > 5
    assert got == [(i, v) for i, v in enumerate(expected, 1)]


def test_moved_splits_never_give_wrong_ids(spark, folder):
    """Small files are packed otherwise in the second scan: right ids or an error, never others."""
    expected = []
    for part in range(12):
        rows = [part * 100 + i for i in range(5 + part)]
        put(folder, f"small/part-{part:02d}.csv", "v\n" + "\n".join(map(str, rows)) + "\n")
        expected += rows
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    old = {k: spark.conf.get(k) for k in keys}
    outcomes = set()
    try:
        for later in (("134217728", "4194304"), ("100", "0"), ("200", "10"), ("134217728", "0")):
            for k, v in zip(keys, ("134217728", "4194304")):
                spark.conf.set(k, v)
            found = imports.scan(delimited.read_csv(spark, folder("small")))
            for k, v in zip(keys, later):
                spark.conf.set(k, v)
            try:
                assert [tuple(r) for r in found.numbered().orderBy(ROW_ID).collect()] == [(i, v) for i, v in enumerate(expected, 1)]
                outcomes.add("right")
            except Exception as error:
                assert "file splits changed" in str(error)
                outcomes.add("refused")
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert outcomes == {"right", "refused"}


def test_renumber_small_buckets(spark):
    df = spark.range(1, 5001).withColumnRenamed("id", ROW_ID).withColumn("v", F.col(ROW_ID)).filter("v % 3 <> 0")
    got = row_id.renumber(df, bucket_rows=64).orderBy(ROW_ID).collect()
    assert [r.v for r in got] == [v for v in range(1, 5001) if v % 3] and [r[0] for r in got] == list(range(1, len(got) + 1))


def test_pages(spark, folder):
    out, count = tables.write(spark.range(45).withColumnRenamed("id", "v"), folder("paged"), order_by=["v"])
    assert count == 45
    assert [r.v for r in tables.page(out, 2, 20).collect()] == list(range(20, 40))
    assert [r.v for r in tables.page(out, 3, 20).collect()] == list(range(40, 45))
    assert code_of(tables.page, out, 0, 20) == "invalid_page"
    assert code_of(tables.page, out, 1, 201) == "invalid_page_size"
    assert code_of(tables.open_table, spark, folder("absent")) == "physical_table_not_found"


def test_page_filter_reaches_the_scan(spark, folder):
    out, _ = tables.write(spark.range(10), folder("t"))
    plan = tables.page(out, 1, 5)._jdf.queryExecution().toString()
    assert "GreaterThan(_das_row_id,0)" in plan and "LessThanOrEqual(_das_row_id,5)" in plan


def test_declared_fields_survive_the_table(spark, folder):
    df = spark.createDataFrame([("n", 1.5), ("s", 2.5)], "region string, revenue double")
    declared = [Field("region", "text", False, 0), Field("revenue", "decimal", True, 1)]
    out, _ = tables.write(df, folder("view"), fields=declared, kind="data_view")
    from gridloom.types import fields_of

    assert fields_of(tables.open_table(spark, folder("view"))) == declared
    broken = df.withColumn("region", F.lit(None).cast("string"))
    with pytest.raises(Exception, match="null in non-nullable field region"):
        tables.write(broken, folder("broken"), fields=declared)


def test_catalog_names(spark, folder):
    catalog = Catalog(spark, folder("catalog"))
    first = catalog.register("p", " sales ", "x", 2, [Field("a", "text")])
    assert first.startswith("dataset_")
    assert code_of(catalog.register, "p", "sales", "y", 2, []) == "dataset_name_conflict"
    assert code_of(catalog.register, "p", "  ", "y", 2, []) == "invalid_dataset_name"
    catalog.register("q", "sales", "y", 3, [])
    catalog.register("p", "later", "z", 3, [])
    assert [r.name for r in catalog.listing("p").collect()] == ["later", "sales"]


def test_workbooks_infer_from_typed_cells(spark, folder):
    import datetime as dt

    head = ["customer", "score", "rate", "seen", "flag", "code"]
    books = [
        [head, ["a", 1, 0.5, dt.datetime(2026, 1, 5, 10, 30), True, "1"], [None] * 6, ["b", -2, 2, dt.datetime(2026, 1, 6), False, "0"]],
        [head, ["c", 0, 1.25, None, True, "1"]],
    ]
    for i, rows in enumerate(books):
        put(folder, f"books/b{i}.xlsx", workbook(rows))
    found = imports.scan(workbooks.read_workbooks(spark, folder("books")))
    # typed cells: -2 and 0/1 are integers here, while text 0/1 is boolean
    assert [f.type for f in found.fields] == ["text", "integer", "decimal", "datetime", "boolean", "boolean"]
    assert [f.nullable for f in found.fields] == [False, False, False, True, False, False]
    rows = [tuple(r) for r in found.numbered().orderBy(ROW_ID).collect()]
    assert rows == [
        (1, "a", 1, 0.5, dt.datetime(2026, 1, 5, 10, 30), True, True),
        (2, "b", -2, 2.0, dt.datetime(2026, 1, 6), False, False),
        (3, "c", 0, 1.25, None, True, True),
    ]


def test_workbooks_must_share_a_header(spark, folder):
    put(folder, "odd/a.xlsx", workbook([["a"], [1]]))
    put(folder, "odd/b.xlsx", workbook([["b"], [1]]))
    assert code_of(workbooks.read_workbooks, spark, folder("odd")) == "workbook_header_mismatch"
    assert code_of(workbooks.read_workbooks, spark, put(folder, "n/notes.txt", "x")) == "unsupported_file_type"


def test_part_numbers_beyond_five_digits(spark, folder):
    import pandas as pd

    pathlib.Path(folder("parts")).mkdir()
    for part, v in ((99999, 1), (100000, 2), (7, 0)):
        pd.DataFrame({"v": [v]}).to_parquet(f"{folder('parts')}/part-{part:05d}-x.parquet")
    got = row_id.number_files(spark.read.parquet(folder("parts"))).orderBy(ROW_ID).collect()
    assert [r.v for r in got] == [0, 1, 2]


def test_numbering_deals_no_rows_by_file(spark, folder):
    """All rows of a file would land in one task, however large it is."""
    spark.range(20).coalesce(1).write.parquet(folder("one"))
    spark.range(20).write.option("header", True).csv(folder("ones"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for out in (row_id.number_files(spark.read.parquet(folder("one"))), imports.scan_csv(spark, folder("ones")).numbered()):
            plan = out._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
            assert [(r[0], r[1]) for r in out.orderBy(ROW_ID).collect()] == [(i + 1, i) for i in range(20)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_split_lines_are_walked_by_few_tasks_and_not_again(spark, folder):
    """Small splits share a task, and header, types and cells come from the records as written once."""
    rows = "".join(f'{i},"a\n""b"" {i}"\n' for i in range(300))
    path = put(folder, "many/part-00000.csv", f"id,note\n{rows}")
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "100")
        lines = records.walked_lines(spark, [path])
        assert lines.rdd.getNumPartitions() <= spark.sparkContext.defaultParallelism
        assert lines.select("block").distinct().count() > 30
        df = records.read_records(spark, path)
        assert "MapInArrow" not in df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    found = imports.scan_csv(spark, path, multi_line="split")
    assert [tuple(r) for r in found.numbered().orderBy(ROW_ID).collect()] == [(i + 1, i, f'a\n"b" {i}') for i in range(300)]


def test_csv_copies_grow_in_files(spark, folder, monkeypatch):
    """A writer's task takes a bounded share of a large table, and the order of the files is that of the rows."""
    from suite import ingest

    spark.range(5000).withColumn("note", F.repeat(F.lit("x\n"), 3)).write.parquet(folder("with space"))
    df = spark.read.parquet(folder("with space"))
    assert len(list(pathlib.Path(ingest.drop_csv(df, "id")).glob("part-*"))) == 6
    monkeypatch.setattr(ingest, "FILE_BYTES", 1000)
    path = ingest.drop_csv(df, "id")
    assert len(list(pathlib.Path(path).glob("part-*"))) > 12
    read = delimited.read_csv(spark, path, multi_line=True)
    assert [r[0] for r in imports.scan(read).numbered().orderBy(ROW_ID).select("id").collect()] == list(range(5000))


SHEET = """<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row>
<row r="3"><c r="A3" t="str"><v>calc</v></c><c r="B3" s="1"><v>1.5</v></c><c r="C3" t="e"><v>#N/A</v></c></row>
<row r="4"><c r="B4" s="2"><v>0.25</v></c><c r="C4" s="0"><v>2.50</v></c><c r="D4"><v>9</v></c></row>
</sheetData></worksheet>"""


def test_workbook_parts(folder):
    """Shared and rich strings, custom date formats, the 1904 calendar, a later active sheet."""
    import io
    import zipfile

    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w") as book:
        book.writestr("xl/workbook.xml", f"""<workbook {main} xmlns:r="urn:r"><workbookPr date1904="1"/>
            <bookViews><workbookView activeTab="1"/></bookViews>
            <sheets><sheet name="a" r:id="r1"/><sheet name="b" r:id="r2"/></sheets></workbook>""")
        book.writestr("xl/_rels/workbook.xml.rels", """<Relationships><Relationship Id="r1" Target="worksheets/no.xml"/>
            <Relationship Id="r2" Target="/xl/worksheets/sheet2.xml"/></Relationships>""")
        book.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>na</t><rPh><t>x</t></rPh></si><si><r><t>no</t></r><r><t>te</t></r></si></sst>")
        book.writestr("xl/styles.xml", f"""<styleSheet {main}><numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/>
            <numFmt numFmtId="171" formatCode="0.00&quot;days&quot;"/></numFmts>
            <cellXfs><xf numFmtId="171"/><xf numFmtId="170"/><xf numFmtId="20"/></cellXfs></styleSheet>""")
        book.writestr("xl/worksheets/sheet2.xml", SHEET)
    rows = [[c and (c["kind"], c["text"]) for c in row] for row in workbooks.sheet_rows(buffer.getvalue())]
    assert rows == [
        [("text", "na"), None, ("text", "note")],
        [("text", "calc"), ("datetime", "1904-01-02T12:00:00"), ("text", "#N/A")],
        [None, ("time", "06:00:00"), ("decimal", "2.5"), ("integer", "9")],
    ]


def test_a_quoted_line_break_is_noticed(spark, folder):
    put(folder, "torn/a.csv", 'id,note\n1,"two\nlines"\n2,"whole, ""quoted"""\n')
    assert code_of(imports.scan_csv, spark, folder("torn")) == "file_parse_failed"
    found = imports.scan_csv(spark, folder("torn"), multi_line=True)
    assert [(f.name, f.type) for f in found.fields] == [("id", "integer"), ("note", "text")] and found.row_count == 2
    put(folder, "short/a.csv", 'id,note\n1\n2,b,extra\n3,"c ""q"""\n')
    assert imports.scan_csv(spark, folder("short")).row_count == 3


def test_torn_lines_of_equal_width_are_noticed(spark, folder):
    path = put(folder, "equal.csv", 'id,note\n1,"two\nx, lines"\n2,plain\n')
    assert code_of(imports.scan_csv, spark, path) == "file_parse_failed"
    found = imports.scan_csv(spark, path, multi_line="split")
    assert [tuple(r) for r in found.numbered().orderBy(ROW_ID).collect()] == [(1, 1, "two\nx, lines"), (2, 2, "plain")]


@pytest.mark.parametrize("block", [16, 40, 1 << 20])
def test_split_records_at_any_border(spark, folder, block):
    """Whatever bytes a file is cut at, records, cells and ids are those of a plain reader."""
    rng = random.Random(block)
    bits = ["a", "\n", "\n\n", '"', '""', ",", "é漢", " ", "\n,\n", "x\ty", ""]
    want = []
    for f in range(2):
        out = io.StringIO(newline="")
        writer = csv.writer(out, lineterminator="\n")
        writer.writerow(["id", "no\nte", "z"])
        for i in range(25):
            row = [str(len(want)), "".join(rng.choice(bits) for _ in range(rng.randrange(6))), rng.choice(["", "p", "q\nr"])]
            want.append(row)
            writer.writerow(row)
            if rng.random() < 0.2:
                out.write("  \n")
        put(folder, f"border{block}/part-0000{f}.csv", out.getvalue())
    size = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        df = records.read_records(spark, folder(f"border{block}"))
        counted = df.groupBy(row_id.PATH, row_id.BLOCK).agg(F.count(F.lit(1)).alias("rows"), F.min(row_id.MARK).alias("first_mark"))
        got = row_id.number_splits(df, counted).orderBy(ROW_ID).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    assert got[0].__fields__ == [ROW_ID, "id", "no\nte", "z"]
    assert [r[0] for r in got] == list(range(1, len(want) + 1))
    plain = lambda text: text or None
    assert [[plain(c) for c in r[1:]] for r in got] == [[plain(c) for c in r] for r in want]


@pytest.mark.parametrize("text", ['id,a\n1,"open\n2,b\n', 'id,a\n1,5" pipe\n2,b\n3,6" pipe\n'])
def test_quotes_that_do_not_pair_are_refused(spark, folder, text):
    assert code_of(records.read_records, spark, put(folder, f"unpaired{len(text)}.csv", text)) == "file_parse_failed"


def test_split_records_of_odd_files(spark, folder):
    assert code_of(records.read_records, spark, put(folder, "nothing.csv", "")) == "empty_file"
    put(folder, "heads/a.csv", "id,a\n1,x\n")
    put(folder, "heads/b.csv", "id,b\n1,x\n")
    assert code_of(records.read_records, spark, folder("heads")) == "file_header_mismatch"
    crlf = put(folder, "crlf.csv", 'id,a,\r\n1,"x ""y""",z\r\n2\r\n3,b,c,d\r\n')
    got = records.read_records(spark, crlf).drop(row_id.PATH, row_id.BLOCK, row_id.MARK)
    assert got.columns == ["id", "a", "column_3"]
    assert sorted(map(tuple, got.collect()), key=str) == [("1", 'x "y"', "z"), ("2", None, None), ("3", "b", "c")]
    assert records.read_records(spark, put(folder, "headonly.csv", "id,a\n")).count() == 0
