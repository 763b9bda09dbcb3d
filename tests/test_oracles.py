"""Every registered ranking query against its SQL in DuckDB."""

import pytest

from quillrank.plans.oracles import oracle_sql
from quillrank.plans.queries import queries
from tests.conftest import rows_of


def test_every_query_has_an_oracle():
    assert set(queries()) == set(oracle_sql())


@pytest.mark.parametrize("name", sorted(queries()))
def test_equals_sql(spark, sf_dir, duck, name):
    assert rows_of(queries()[name](spark, sf_dir).toPandas()) == rows_of(duck.execute(oracle_sql()[name]).df())
