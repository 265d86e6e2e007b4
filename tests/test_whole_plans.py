"""Whole jobs: every row takes part, and neither a query nor its SQL leaves some out."""

import duckdb
import pytest
from test_queries import TABLES, table

from lodestone import plans

DATA = "/root/testdata/sf0.01"
CUTS = {
    "geo_neighbour_join": " AND event_id % 20 = 1",
    "image_species_join": " WHERE p_size < 10",
    "shortfall": " WHERE lang = 'de'",
}


@pytest.mark.parametrize("name", sorted(CUTS))
def test_every_row_takes_part(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    assert CUTS[name] not in plans.SQL[name]
    whole = con.execute(plans.SQL[name]).df()
    assert table(plans.QUERIES[name](spark, DATA).toPandas()) == table(whole)
