"""Every registered query against its SQL, on the smallest tables."""

import os
import shutil
import subprocess
import sys

import pytest

from suite import load_all
from suite.compare import compare, connect
from suite.registry import ORACLE, QUERIES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
load_all()


@pytest.fixture(scope="module")
def duck():
    return connect(SF_DIR)


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="no test tables")
@pytest.mark.parametrize("name", list(QUERIES))
def test_agrees_with_sql(spark, duck, name):
    assert compare(spark, duck, SF_DIR, name) == ""


def test_every_query_has_sql():
    assert set(ORACLE) == set(QUERIES)


def test_entry(spark):
    from __spark_entry__ import entry

    assert entry(spark).columns == ["label", "value"] and entry(spark).count() == 5


def test_core_works_without_optional_parts(tmp_path):
    """A copy of the sources without the optional package still gives its queries."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    skip = shutil.ignore_patterns("llm", "__pycache__")
    for folder in ("gridloom", "suite"):
        shutil.copytree(os.path.join(root, folder), tmp_path / folder, ignore=skip)
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        shutil.copy(os.path.join(root, name), tmp_path / name)
    code = "import __spark_entry__ as e; print(len(e.queries()), len(e.oracle_sql()), any(n.startswith('op') for n in e.queries()))"
    for leftover in (False, True):
        if leftover:
            (tmp_path / "gridloom" / "llm" / "__pycache__").mkdir(parents=True)
        done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)})
        assert done.stdout.split() == [str(len(QUERIES)), str(len(ORACLE)), "False"], done.stderr
