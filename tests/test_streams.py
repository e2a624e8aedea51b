import pathlib

from conftest import code_of

from gridloom import Field, Step, drops, recipe, tables
from gridloom.operators.steps import Flow
from gridloom.streaming import batches
from gridloom.types import ROW_ID, fields_of

FIELDS = [Field("id", "integer", True, 0), Field("name", "text", True, 1), Field("at", "datetime", True, 2)]


def drop(folder, name, *lines):
    path = pathlib.Path(folder("in")) / name
    path.parent.mkdir(exist_ok=True)
    path.write_text("\n".join(("id,name,at", *lines)) + "\n")


def test_each_file_arrives_once(spark, folder):
    def run():
        drops.ingest(drops.read_csv_drops(spark, folder("in"), FIELDS), folder("out"), folder("log"))
        return sorted(tuple(r)[:2] for r in spark.read.parquet(folder("out")).collect())

    drop(folder, "a.csv", "1,x,2026-01-05T10:00", "2,,2026-01-05T10:01")
    assert run() == [(1, "x"), (2, None)]
    drop(folder, "b.csv", "3,z,2026-01-05T10:02")
    assert run() == [(1, "x"), (2, None), (3, "z")]
    assert run() == [(1, "x"), (2, None), (3, "z")]


def test_deduplicate_within_the_delay(spark, folder):
    drop(folder, "a.csv", "1,x,2026-01-05T10:00", "1,x,2026-01-05T10:01", "2,y,2026-01-05T10:02")
    stream = drops.read_csv_drops(spark, folder("in"), FIELDS)
    steps = [Step("deduplicate", 1, {"fields": ["id", "name"]}), Step("fill_null", 0, {"field": "name", "value": "-"})]
    assert code_of(drops.apply_steps, stream, steps) == "invalid_cleaning_step"
    clean = drops.apply_steps(stream, steps, event_time="at", delay="1 hour")
    drops.ingest(clean, folder("out"), folder("log"))
    drop(folder, "b.csv", "2,y,2026-01-05T10:30", "3,,2026-01-05T10:31")
    drops.ingest(drops.apply_steps(drops.read_csv_drops(spark, folder("in"), FIELDS), steps, event_time="at", delay="1 hour"), folder("out"), folder("log"))
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(folder("out")).collect()) == [(1, "x"), (2, "y"), (3, "-")]


def test_table_steps_are_refused_on_streams(spark, folder):
    drop(folder, "a.csv", "1,x,2026-01-05")
    stream = drops.read_csv_drops(spark, folder("in"), FIELDS)
    step = Step("sort", 0, {"by": [{"field": "id"}]})
    assert code_of(drops.apply_steps, stream, [step]) == "invalid_cleaning_step"


STRICT = [Field("id", "integer", False, 0), Field("name", "text", True, 1), Field("at", "datetime", True, 2)]


def test_bad_cells_stop_the_stream(spark, folder):
    drop(folder, "a.csv", "1,x,2026-01-05T10:00", "ten,y,2026-01-05T10:01")
    try:
        drops.ingest(drops.read_csv_drops(spark, folder("in"), STRICT), folder("out"), folder("log"))
    except Exception as error:
        assert "invalid_field_value: id=ten" in str(error)
    else:
        raise AssertionError("a bad cell was taken")


def test_bad_rows_can_be_diverted(spark, folder):
    drop(folder, "a.csv", "1,x,2026-01-05T10:00", "ten,y,soon", ",z,", "4,,")
    stream = drops.read_csv_drops(spark, folder("in"), STRICT, on_bad="mark")
    drops.ingest(drops.accepted(stream), folder("out"), folder("log"))
    drops.ingest(drops.rejected(stream), folder("bad"), folder("badlog"))
    assert sorted(tuple(r)[:2] for r in spark.read.parquet(folder("out")).collect()) == [(1, "x"), (4, None)]
    assert sorted(r[drops.BAD] for r in spark.read.parquet(folder("bad")).collect()) == ["id=", "id=ten; at=soon"]


def test_a_streamed_table_has_row_ids_and_fields(spark, folder):
    for name, rows in (("a.csv", ["1,x,2026-01-05T10:00", "2,y,"]), ("b.csv", ["3,z,"])):
        drop(folder, name, *rows)
        drops.ingest(drops.read_csv_drops(spark, folder("in"), STRICT), folder("out"), folder("log"))
    stored = drops.as_table(spark, folder("out"), STRICT)
    assert sorted(r[0] for r in stored.collect()) == [1, 2, 3] and [f.name for f in fields_of(stored)] == ["id", "name", "at"]
    assert tables.page(stored, 1, 2).count() == 2


def test_ids_stay_when_files_arrive(spark, folder):
    def run():
        drops.ingest(drops.read_csv_drops(spark, folder("in"), STRICT), folder("out"), folder("log"))
        return {r["id"]: r[0] for r in drops.as_table(spark, folder("out"), STRICT).collect()}

    drop(folder, "m.csv", *[f"{i},x," for i in range(300)])
    first = run()
    drop(folder, "a.csv", *[f"{i},x," for i in range(300, 600)])
    second = run()
    assert {k: second[k] for k in first} == first and sorted(second.values()) == list(range(1, 601))


def test_a_lost_run_is_replayed_once(spark, folder):
    """A batch written but not committed is invisible; its replay, and one after the commit, leave it once."""
    table = batches.BatchTable(spark, folder("out"))
    first = spark.range(10).selectExpr("id")
    table.append(first, "q", 0)
    spark.range(10, 15).selectExpr("id").write.parquet(folder("out") + "/_batch=q-1")
    assert table.rows().count() == 10
    table.append(spark.range(10, 20).selectExpr("id"), "q", 1)
    table.append(spark.range(10, 20).selectExpr("id"), "q", 1)
    table.append(spark.range(20, 22).selectExpr("id"), "other", 0)
    assert sorted((r["id"], r[0]) for r in table.rows().collect()) == [(i, i + 1) for i in range(22)]
    assert table.ledger().count() == 3


def test_deduplication_over_batches_is_the_table_step(spark, folder):
    lines = [f"{i % 7},{'abc'[i % 3] if i % 5 else ''},2026-01-05T10:{i:02d}" for i in range(40)]
    whole = spark.createDataFrame([(i + 1, i % 7, "abc"[i % 3] if i % 5 else None) for i in range(40)], f"{ROW_ID} long, id long, name string")
    for k, part in enumerate((lines[:15], lines[15:16], lines[16:])):
        drop(folder, f"{'zma'[k]}.csv", *part)
        stream = drops.read_csv_drops(spark, folder("in"), FIELDS)
        drops.ingest(stream, folder("out"), folder("log"), deduplicate=["id", "name"], order_by=["at"])
    kept = recipe.fold(Flow(whole), [Step("deduplicate", 0, {"fields": ["id", "name"]})]).df
    got = sorted(((r[0], r["id"], r["name"]) for r in drops.committed(spark, folder("out")).collect()))
    assert [r[1:] for r in got] == [(r["id"], r["name"]) for r in kept.orderBy(ROW_ID).collect()] and [r[0] for r in got] == list(range(1, len(got) + 1))
    assert code_of(drops.ingest, stream, folder("out"), folder("log"), deduplicate=["gone"]) == "invalid_cleaning_step"


def test_nothing_committed_is_no_table(spark, folder):
    assert code_of(drops.committed, spark, folder("none")) == "physical_table_not_found"
