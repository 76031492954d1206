"""Base columns of operators whose method is beyond SQL, against SQL."""

import duckdb
import pytest

from twinlathe.llm import license_scan, quality_rules


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("module, name", [(license_scan, "license_base_places"), (quality_rules, "quality_base_counts")])
def test_base_columns_equal_sql(spark, module, name, sf):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/{sf}/documents.parquet'")
    got = module.QUERIES[name](spark, f"/root/testdata/{sf}")
    theirs = con.execute(f"SELECT {', '.join(got.columns)} FROM ({module.ORACLE_SQL[name]})").fetchall()
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(theirs, key=repr) and theirs
