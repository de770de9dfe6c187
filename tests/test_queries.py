import subprocess
import sys
from pathlib import Path

import pytest

import oracle
from groundlake.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def database():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracles()))
def test_query_equals_its_sql(spark, database, name):
    assert oracle.differences(registry.queries()[name](spark, SF), registry.oracles()[name], database) == ""


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(registry.oracles())))
def test_query_without_sql_has_rows(spark, name):
    assert registry.queries()[name](spark, SF).count() > 0


def test_everything_imports_without_a_session():
    code = "import __spark_entry__ as e; assert len(e.queries()) > 100 and e.oracle_sql().keys() <= e.queries().keys()"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).parents[1], check=True, timeout=120)
