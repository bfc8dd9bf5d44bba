"""Every registered query with SQL gives the rows that DuckDB gives."""

import pytest

import geoweave.plans.corridor_queries  # noqa: F401
import geoweave.plans.feature_queries  # noqa: F401
import geoweave.plans.mesh_queries  # noqa: F401
import geoweave.plans.more_queries  # noqa: F401
import geoweave.plans.outline_queries  # noqa: F401
import geoweave.plans.route_queries  # noqa: F401
import geoweave.plans.text_queries  # noqa: F401
import geoweave.plans.triangulation_queries  # noqa: F401
import geoweave.plans.view_queries  # noqa: F401
from geoweave.plans.queries import ORACLES, QUERIES

SMALL = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sql, same, name):
    same(QUERIES[name](spark, SMALL).toPandas(), sql(SMALL, ORACLES[name]))


@pytest.mark.parametrize("name", ["clipped_lines", "clipped_polygons"])
def test_query_matches_sql_where_results_lie_between_whole_numbers(spark, sql, same, name):
    same(QUERIES[name](spark, "/root/testdata/sf0.01").toPandas(), sql("/root/testdata/sf0.01", ORACLES[name]))


def test_entry_has_rows(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
