"""Results that lie on the border between two whole numbers or two tiles, which larger tables bring."""

import duckdb
import pytest

from geoweave.functions import shapes as s
from geoweave.plans.queries import ORACLES, QUERIES
import geoweave.plans.more_queries  # noqa: F401
import geoweave.plans.text_queries  # noqa: F401

# keys of the tables sf0.1 or of copies of it with shifted keys
ROWS = {
    "clipped_polygons": ("part", "SELECT unnest([13106, 29855, 57736, 79429])::BIGINT AS p_partkey, unnest([14, 37, 24, 39])::INT AS p_size"),
    "linear_remap": ("orders", "SELECT 745050::BIGINT AS o_orderkey"),
    "tile_lines": ("part", "SELECT unnest([57589, 147525])::BIGINT AS p_partkey, unnest([44, 28])::INT AS p_size"),
}


@pytest.mark.parametrize("name", sorted(ROWS))
def test_rows_on_a_border_match_sql(spark, sql, same, tmp_path, name):
    table, rows = ROWS[name]
    duckdb.connect().execute(f"COPY ({rows}) TO '{tmp_path}/{table}.parquet' (FORMAT parquet)")
    wanted = sql(tmp_path, ORACLES[name])
    assert len(wanted)
    same(QUERIES[name](spark, str(tmp_path)).toPandas(), wanted)


def test_slab_area(spark):
    ring = [(0.0, 0.0), (4.0, 0.0), (4.0, 1.0), (2.0, 1.0), (2.0, 3.0), (0.0, 3.0)]
    rows = spark.createDataFrame([(ring, [0.0, 0.0, 1.0, 1.0, 3.0, 3.0]), ([], [0.0, 1.0])], "ring array<struct<x:double,y:double>>, h array<double>")
    assert [r[0] for r in rows.select(s.slab_area(rows.ring, rows.h)).collect()] == [8.0, 0.0]
