"""The catalogue comes from Spark's reading of the tables."""

import pytest

from tessera.plans import registry, source_queries

SF = "/root/testdata/sf0.001"


def test_catalog_counts_what_the_columns_hold(spark):
    rows = {(r["table_name"], r["column_name"]): r["filled"] for r in source_queries.catalog(spark, SF).collect()}
    for name in source_queries.GIVEN:
        df = spark.read.parquet(f"{SF}/{name}.parquet")
        assert {n for (t, _), n in rows.items() if t == name} == {df.count()}
    assert rows["archive", "photo"] == 0


@pytest.mark.parametrize("name", ["E4_key_assembly", "E5_segments", "E6_cluster_tables"])
def test_tables_are_scanned(spark, name):
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup(f"reads {name}", name)
    registry.QUERIES[name](spark, SF).collect()
    jobs = tracker.getJobIdsForGroup(f"reads {name}")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    # A scan, an exchange and a row for each table: more than the one job that shows rows of the driver.
    assert len(jobs) > 4
