"""Every registered query of the engine against DuckDB."""

import pytest

from quern.plans import catalog
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(name, spark, duck, sf_dir):
    same_rows(catalog.QUERIES[name](spark, sf_dir), duck, catalog.ORACLE[name])


def test_all_have_sql():
    assert set(catalog.QUERIES) == set(catalog.ORACLE)
