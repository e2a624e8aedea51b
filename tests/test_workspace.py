"""The commit log: whole commits, races, and what each transform leaves in it."""

import json
import os
import threading

import pytest
from conftest import code_of

from gridloom import Scope, Step, WorkspaceError
from gridloom.plans.workspace import CommitLog, Workspace


def together(calls):
    """Run all calls at once; their results or errors in order."""
    found, gate = [None] * len(calls), threading.Barrier(len(calls))

    def one(i, call):
        gate.wait()
        try:
            found[i] = call()
        except Exception as error:
            found[i] = error

    threads = [threading.Thread(target=one, args=x) for x in enumerate(calls)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    return found


def named(name, asset):
    return {"id": asset, "project_id": "p", "kind": "dataset", "name": name, "path": "x", "row_count": 0, "fields": []}


def test_one_writer_of_a_name_wins(spark, folder):
    logs = [CommitLog(spark, folder("ws")) for _ in range(5)]
    found = together([lambda log=log, i=i: log.commit(table=named("same", f"d{i}")) for i, log in enumerate(logs)])
    won = [f for f in found if isinstance(f, int)]
    assert len(won) == 1
    assert all(f.code == "dataset_name_conflict" for f in found if not isinstance(f, int))
    assert logs[0].tables().count() == 1


def test_writers_of_other_names_retry(spark, folder):
    logs = [CommitLog(spark, folder("ws")) for _ in range(6)]
    found = together([lambda log=log, i=i: log.commit(table=named(f"n{i}", f"d{i}")) for i, log in enumerate(logs)])
    assert sorted(found) == [1, 2, 3, 4, 5, 6]
    assert {r["name"] for r in logs[0].tables().collect()} == {f"n{i}" for i in range(6)}
    assert not [n for n in os.listdir(folder("ws/log")) if n.startswith(".") and not n.endswith(".crc")]


def test_an_entry_is_never_replaced(spark, folder):
    log = CommitLog(spark, folder("ws"))
    assert log._create(1, json.dumps({"version": 1})) and not log._create(1, json.dumps({"version": 9}))
    assert [r["version"] for r in log.entries().collect()] == [1] and log.latest() == 1


def test_transforms_leave_edges_and_log_rows(spark, folder):
    ws = Workspace(spark, folder("ws"))
    os.makedirs(folder("in"))
    with open(folder("in") + "/a.csv", "w") as file:
        file.write("id,v\n1,5\n2,\n3,7\n")
    data, source = ws.import_csv("p", "sales", folder("in") + "/a.csv", source_id="file-1", asset_id="d1")
    clean, derived = ws.execute("p", "clean", source, "r1", [Step("drop_null_rows", 0, {"fields": ["v"]})], asset_id="d2")
    scope = Scope(spark, {"dataset_sales": data, "dataset_clean": ws.open(derived)})
    view, _ = ws.save("p", "totals", scope, "SELECT sum(v) AS total FROM dataset_clean", asset_id="v1")
    assert view.first()["total"] == 12
    assert ws.run("p", scope, "SELECT id FROM dataset_sales").count() == 3
    assert {(e.source_id, e.target_id) for e in ws.commits.edges().collect()} == {("file-1", "d1"), ("d1", "d2"), ("r1", "d2"), ("v1", "v1")}
    assert [(r["sql"], r["row_count"]) for r in ws.history("p").collect()] == [("SELECT id FROM dataset_sales", 3)]
    listed = ws.listing("p").collect()
    assert [(r["name"], r["row_count"]) for r in listed] == [("clean", 2), ("sales", 3)]
    assert [f["name"] for f in listed[0]["fields"]] == ["id", "v"]
    assert [r["action"] for r in ws.commits.log().orderBy("version").collect()] == ["dataset.created", "recipe.executed", "sql.query_saved", "sql.query_executed"]


def test_what_fails_publishes_nothing(spark, folder):
    ws = Workspace(spark, folder("ws"))
    ws.add("p", "one", spark.range(2), asset_id="d1")
    before = len(os.listdir(folder("ws/dataset")))
    assert code_of(ws.add, "p", " one ", spark.range(5)) == "dataset_name_conflict"
    with pytest.raises(Exception):
        ws.execute("p", "two", "d1", "r", [Step("calculate", 0, {"target": "x", "expression": "raise_error('no')"})])
    with pytest.raises(WorkspaceError):
        ws.open("absent")
    ws.add("q", "one", spark.range(1))  # another project's names are its own
    assert ws.commits.latest() == 2 and ws.commits.edges().count() == 0
    assert len(os.listdir(folder("ws/dataset"))) == before + 1
