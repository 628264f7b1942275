"""The corpus queries that have SQL, against it, over whole tables."""

import os

import duckdb
import pytest

from tessera.llm.oracles import ORACLES
from tessera.llm.queries import QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(spark, name, sf):
    sf_dir = f"/root/testdata/{sf}"
    if not os.path.isdir(sf_dir):
        pytest.skip("no tables")
    duck = duckdb.connect()
    duck.sql("set enable_progress_bar=false")
    for table in ("documents", "embeddings"):
        duck.sql(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    got, want = QUERIES[name](spark, sf_dir).toPandas(), duck.sql(ORACLES[name]).df()
    columns = sorted(got.columns)
    assert columns == sorted(want.columns) and len(got)
    rows = [sorted(map(repr, x[columns].itertuples(index=False, name=None))) for x in (got, want)]
    assert rows[0] == rows[1]
