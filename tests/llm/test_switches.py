"""Beyond the size up to which tables are broadcast, the rows stay the same."""

import pytest

from tessera.llm import exact
from tessera.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_warc", "op9_exact_dedup", "op12_filter_audit"])
def test_large_branch(spark, monkeypatch, name):
    want = sorted(map(str, QUERIES[name](spark, SF).collect()))
    monkeypatch.setattr(exact, "FEW_GROUPS", 0)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert sorted(map(str, QUERIES[name](spark, SF).collect())) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
