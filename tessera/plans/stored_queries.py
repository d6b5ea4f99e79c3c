"""Searches and traversals over stored look-up tables, which an application writes once for each folder of tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import graph as g
from tessera.plans.catalog_queries import QUESTION
from tessera.plans.registry import ORACLES, query
from tessera.plans.roles import edges, rules
from tessera.sources import stored

_made: dict[tuple, object] = {}


def once(spark, sf, name, make):
    """What ``make`` stored for this application and folder."""
    key = (spark.sparkContext.applicationId, sf, name)
    if key not in _made:
        _made[key] = make()
    return _made[key]


def adjacency(spark, sf):
    """Edges along and, where others lean on a node, against them."""
    def steps():
        all_ = edges(spark, sf)
        return all_.select("source", "target").union(g.filter_edges(all_, ("uses", "depends-on", "reads")).select("target", "source"))

    return once(spark, sf, "adjacency", lambda: stored.store_adjacency(steps()))


@query("G12_stored_impact", ORACLES["G12_impact"])
def impact(spark, sf):
    return stored.stored_reach(spark, adjacency(spark, sf), ["s:1"], 3)


@query("G23_stored_neighbourhood", ORACLES["G23_api_impact"])
def neighbourhood(spark, sf):
    both = once(spark, sf, "undirected", lambda: stored.store_adjacency(g.both_ways(edges(spark, sf))))
    return stored.stored_reach(spark, both, ["n:3"], 3).groupBy("distance").agg(F.count("*").alias("n"))


@query("R8_stored_search", ORACLES["R8_keyword_search"])
def search(spark, sf):
    index = once(spark, sf, "postings", lambda: stored.store_postings(rules(spark, sf), "doc_id", "text"))
    return stored.stored_search(spark, index, QUESTION, "doc_id")
