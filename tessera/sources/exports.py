"""Sinks of graphs and rows (I1-I4): JSON, GraphML, DOT, Mermaid, GEXF, CSV lines, JSONL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.quality import union_all


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), F.regexp_replace(c, '"', '\\\\"'), F.lit('"'))


def _xml(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def graph_lines(nodes: DataFrame, edges: DataFrame, kind: str) -> DataFrame:
    """(part, line) rows of a graph in a text format; sorted by part and line they make the file.

    A row a node or edge, so a graph of any size is written by ``write.text``.
    """
    one = nodes.sparkSession.range(1)
    s, t, i, y = F.col("source"), F.col("target"), F.col("id"), F.col("type")
    node, edge, head, tail = {
        "dot": (F.concat(F.lit("  "), _quoted(i), F.lit(" [label="), _quoted(F.col("name")), F.lit("];")), F.concat(F.lit("  "), _quoted(s), F.lit(" -> "), _quoted(t), F.lit(" [label="), _quoted(y), F.lit("];")), "digraph g {", "}"),
        "mermaid": (F.concat(F.lit("  "), F.regexp_replace(i, "[^A-Za-z0-9]", "_"), F.lit("["), _quoted(F.col("name")), F.lit("]")), F.concat(F.lit("  "), F.regexp_replace(s, "[^A-Za-z0-9]", "_"), F.lit(" -->|"), y, F.lit("| "), F.regexp_replace(t, "[^A-Za-z0-9]", "_")), "graph TD", ""),
        "graphml": (F.concat(F.lit('<node id="'), _xml(i), F.lit('"><data key="type">'), _xml(y), F.lit("</data></node>")), F.concat(F.lit('<edge source="'), _xml(s), F.lit('" target="'), _xml(t), F.lit('"><data key="type">'), _xml(y), F.lit("</data></edge>")), '<graphml><graph edgedefault="directed">', "</graph></graphml>"),
        "gexf": (F.concat(F.lit('<node id="'), _xml(i), F.lit('" label="'), _xml(F.col("name")), F.lit('"/>')), F.concat(F.lit('<edge source="'), _xml(s), F.lit('" target="'), _xml(t), F.lit('" label="'), _xml(y), F.lit('"/>')), '<gexf version="1.3"><graph defaultedgetype="directed">', "</graph></gexf>"),
        "json": (F.to_json(F.struct("id", "type", "name")), F.to_json(F.struct("source", "target", "type")), '{"format":"graph"}', '{"end":true}'),
        "cytoscape": (F.to_json(F.struct(F.struct("id", F.col("name").alias("label"), "type").alias("data"))), F.to_json(F.struct(F.struct(F.concat(s, F.lit(">"), t).alias("id"), "source", "target", "type").alias("data"))), '{"elements":[', "]}"),
        "csv": (F.concat_ws(",", i, y, F.col("name")), F.concat_ws(",", s, t, y), "id,type,name|source,target,type", ""),
    }[kind]
    return union_all([
        one.select(F.lit(0).alias("part"), F.lit(head).alias("line")), nodes.select(F.lit(1).alias("part"), node.alias("line")),
        edges.select(F.lit(2).alias("part"), edge.alias("line")), one.select(F.lit(3).alias("part"), F.lit(tail).alias("line")),
    ])


def csv_line(*columns: Column) -> Column:
    """One CSV line; fields with a comma, quote or line end are quoted."""
    def field(c: Column) -> Column:
        text = F.coalesce(c.cast("string"), F.lit(""))
        return F.when(text.rlike('[",\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)

    return F.concat_ws(",", *[field(c) for c in columns])


def training_lines(conversations: DataFrame, key: str, order: str, role: str, text: str) -> DataFrame:
    """I4: one JSON line a conversation with its messages in order."""
    ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(role).alias("role"), F.col(text).alias("content"))))
    messages = F.transform(ordered, lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))
    return conversations.groupBy(key).agg(messages.alias("messages")).select(key, F.to_json(F.struct("messages")).alias("line"))
