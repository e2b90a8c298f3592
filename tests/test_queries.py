import pytest

import __spark_entry__ as entry_point
from lexloom import plans
from oracle import expected, rows

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query_matches_its_sql(spark, name):
    got = plans.QUERIES[name](spark, FOLDER).toArrow()
    if name in plans.ORACLE:
        want = expected(plans.ORACLE[name], FOLDER)
        assert sorted(got.column_names) == sorted(want.column_names)
        assert rows(got) == rows(want)
    else:
        assert got.num_rows > 0


def test_entry(spark):
    assert entry_point.entry(spark).count() == 200
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
