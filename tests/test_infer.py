import datetime as dt

import pytest
from conftest import code_of
from pyspark.sql import functions as F

from gridloom import Field, WorkspaceError, infer
from gridloom.functions import cells
from gridloom.types import validate_fields

CASES = {
    "all_flags": (["1", "0", "1"], "boolean", False),
    "words": (["Yes", "no", "TRUE"], "boolean", False),
    "signed": (["-7", "8", "9"], "decimal", False),
    "zeros": (["007", "12", "3"], "integer", False),
    "digits_and_flag": (["1", "2", "0"], "integer", False),
    "exponent": (["1e3", ".5", "5."], "decimal", False),
    "suffix": (["1d", "2", "3"], "text", False),
    "underscore": (["1_000", "2.5", "3"], "decimal", False),
    "not_finite": (["nan", "inf", "-Infinity"], "decimal", False),
    "short_date": (["2026-1-5", "2026-11-30", "2026-02-28"], "date", False),
    "bad_date": (["2026-02-30", "2026-02-28", "2026-02-27"], "text", False),
    "year": (["2026", "2025", "2024"], "integer", False),
    "moment": (["2026-01-05T10:20:30", "2026-01-05 10:20", "2026-01-05T10:20:30.5"], "datetime", False),
    "offset": (["2026-01-05T10:20:30+08:00", "2026-01-05T10:20:30Z", "2026-01-05"], "datetime", False),
    "date_and_moment": (["2026-01-05", "2026-01-06T00:00", "2026-01-07"], "datetime", False),
    "blank": (["", " ", None], "text", True),
    "some_blank": (["5", " ", "12"], "integer", True),
    "too_long": (["123456789012345678901", "1", "5"], "decimal", False),
    "mixed": (["a", "1", "2026-01-01"], "text", False),
}


@pytest.fixture(scope="module")
def edges(spark):
    rows = list(zip(*[values for values, _, _ in CASES.values()]))
    return spark.createDataFrame(rows, ", ".join(f"{n} string" for n in CASES))


def test_inference_of_every_case(edges):
    found = {f.name: (f.type, f.nullable) for f in infer.infer_fields(edges)}
    assert found == {n: (kind, nullable) for n, (_, kind, nullable) in CASES.items()}


def test_lazy_inference_agrees(edges):
    rows = infer.inferred_table(edges).orderBy("order").collect()
    assert [(r.name, r.inferred_type, r.nullable) for r in rows] == [(n, k, b) for n, (_, k, b) in CASES.items()]


def test_typed_values(edges):
    row = infer.typed(edges, infer.infer_fields(edges)).first()
    assert (row.all_flags, row.words, row.signed, row.zeros) == (True, True, -7.0, 7)
    assert (row.exponent, row.underscore, row.short_date) == (1000.0, 1000.0, dt.date(2026, 1, 5))
    assert row.offset == dt.datetime(2026, 1, 5, 2, 20, 30)
    assert row.date_and_moment == dt.datetime(2026, 1, 5)
    assert row.blank is None and row.too_long == 123456789012345678901.0


def test_empty_table_is_text_and_not_nullable(spark):
    fields = infer.infer_fields(spark.createDataFrame([], "a string, b string"))
    assert [(f.type, f.nullable) for f in fields] == [("text", False)] * 2


def test_strip_covers_unicode_space(spark):
    df = spark.createDataFrame([(" 　x \t",), (" ",), ("é ",), ("",)], "c string")
    assert [r[0] for r in df.select(cells.normalize_cell(F.col("c"))).collect()] == ["x", None, "é", None]


def test_remap_renames_recasts_and_drops_by_order(spark):
    df = spark.createDataFrame([("3", 2.9, "x"), ("4", -2.9, "y")], "a string, b double, c string")
    source = [Field(n, "text", True, i) for i, n in enumerate(df.columns)]
    out = infer.remap(df, source, [Field("whole", "integer", True, 1), Field("amount", "decimal", True, 0)])
    assert out.columns == ["whole", "amount"]
    assert [tuple(r) for r in out.collect()] == [(2, 3.0), (-2, 4.0)]


def test_remap_refuses_unknown_order_and_bad_values(spark):
    df = spark.createDataFrame([("3",), ("x",)], "a string")
    source = [Field("a", "text", True, 0)]
    assert code_of(infer.remap, df, source, [Field("a", "text", True, 4)]) == "invalid_dataset_field_order"
    target = [Field("a", "integer", True, 0)]
    assert infer.count_bad(df, source, target) == {"a": 1}
    with pytest.raises(Exception, match="invalid_field_value"):
        infer.remap(df, source, target).collect()


def test_coerce_between_types(spark):
    df = spark.sql("SELECT true AS b, 7L AS i, 1.0D AS d, DATE'2026-01-05' AS day, TIMESTAMP_NTZ'2026-01-05 10:00:00' AS t")

    def as_type(name, kind):
        return df.select(cells.coerce(F.col(name), df.schema[name].dataType, kind)).first()[0]

    assert as_type("b", "text") == "True" and as_type("b", "integer") == 1 and as_type("b", "decimal") == 1.0
    assert as_type("i", "boolean") is False and as_type("i", "text") == "7"
    assert as_type("d", "boolean") is False  # its text is 1.0, which is no word for true
    assert as_type("t", "date") == dt.date(2026, 1, 5) and as_type("t", "text") == "2026-01-05T10:00:00"
    assert as_type("day", "datetime") == dt.datetime(2026, 1, 5) and as_type("day", "integer") is None


@pytest.mark.parametrize(
    ("names", "code"),
    [
        (["a", " "], "invalid_dataset_fields"),
        (["_das_row_id"], "reserved_dataset_field_name"),
        (["x" * 64], "dataset_field_name_too_long"),
        (["é" * 32], "dataset_field_name_too_long"),
        (["a", "a"], "duplicate_dataset_fields"),
    ],
)
def test_schema_rules(names, code):
    fields = [Field(n, "text") for n in names]
    assert code_of(validate_fields, fields) == code
    with pytest.raises(WorkspaceError, match="data_view"):
        validate_fields(fields, "data_view")


def test_longest_name_passes():
    validate_fields([Field("x" * 63, "text")])
