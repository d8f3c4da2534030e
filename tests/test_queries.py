"""Every registered query against its SQL, on the smallest data."""

import pytest

import compare
from mailsieve.catalog import spark_queries
import __spark_entry__ as entry

OWN = list(spark_queries.QUERIES)


@pytest.fixture(scope="module")
def db(sf_dir):
    return compare.database(sf_dir)


@pytest.mark.parametrize("name", OWN)
def test_query(spark, db, sf_dir, name):
    problem = compare.compare(spark, db, name, sf_dir)
    assert problem in ("", "equal but empty"), problem


def test_every_query_is_known_to_the_oracle():
    assert set(OWN) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())
