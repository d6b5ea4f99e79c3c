"""Plans: what reaches the scan, and which joins and exchanges there are."""

import re

from tessera.plans import registry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_integrity_reads_keys_only(spark):
    text = plan(registry.QUERIES["Q8_referential_integrity"](spark, SF))
    assert text.count("LeftAnti") == 9 and "Cartesian" not in text
    schemas = re.findall(r"ReadSchema: struct<([^>]*)>", text)
    assert schemas and all(s.count(":") <= 1 for s in schemas)


def test_filters_reach_the_scan(spark):
    text = plan(registry.QUERIES["U1_audit_query"](spark, SF))
    assert "TakeOrderedAndProject" in text and re.search(r"PushedFilters: \[\w", text) and "event_type" in text
    assert "props" not in re.search(r"ReadSchema: struct<([^>]*)>", text)[1]


def test_one_aggregate_profiles_all_columns(spark):
    text = plan(registry.QUERIES["M2_distribution"](spark, SF))
    assert text.count("FileScan") == 1 and text.count("Exchange") == 1


def test_range_joins_are_equi_joins(spark):
    for name in ("U7_hunk_overlap", "T18_rule_validation"):
        text = plan(registry.QUERIES[name](spark, SF))
        assert "NestedLoop" not in text and "Cartesian" not in text


def test_facets_share_one_pass(spark):
    text = plan(registry.QUERIES["R12_statistics"](spark, SF))
    assert text.count("Expand") == 1
