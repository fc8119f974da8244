"""Every registered query against its SQL on the smallest given tables."""

import os
import subprocess
import sys
from pathlib import Path

import pytest
from compare import check_rows, connect, spark_rows

import __spark_entry__ as registry
from curioledger.workload.checks import all_checks
from curioledger.workload.queries import all_queries

ROOT = Path(__file__).resolve().parent.parent

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    return connect(FOLDER)


OWN = sorted(all_queries())


def test_every_query_has_a_check():
    assert set(OWN) == set(all_checks())
    assert set(OWN) <= set(registry.queries())


@pytest.mark.parametrize("absent", ["corpus_pipeline", "curioledger.llm", "xxhash", "public_tokenizers"])
def test_optional_part_may_be_missing(absent):
    """Without the training-data operators, or what only they need, the rest imports and registers."""
    code = (
        "import sys; sys.modules['corpus_pipeline'] = None\n"
        "import importlib.util as u, __spark_entry__ as e\n"
    )
    hidden = code.replace(
        "sys.modules['corpus_pipeline'] = None",
        "sys.meta_path.insert(0, type('Hide', (), {'find_spec': staticmethod(hide)}))",
    )
    define = (
        "def hide(name, path=None, target=None):\n"
        f"    if name == '{absent}':\n"
        "        raise ModuleNotFoundError(name, name=name)\n"
    )
    check = "assert e.registered is None and 'pipeline' not in e.queries() and e.queries()"
    subprocess.run([sys.executable, "-c", define + hidden + check], cwd=ROOT, check=True)


@pytest.mark.parametrize("name", OWN)
def test_query_matches_sql(spark, con, name):
    found = spark_rows(registry.queries()[name](spark, FOLDER))
    expected = check_rows(con, registry.oracle_sql()[name])
    assert found == expected


def test_entry_has_rows(spark):
    assert registry.entry(spark).count() > 0
