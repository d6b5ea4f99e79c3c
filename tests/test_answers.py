"""Answers by intent, level and evidence, in the words they must have."""

import pytest

from tessera.operators import mining


@pytest.fixture(scope="module")
def found(spark):
    questions = spark.createDataFrame([(1, "data-flow"), (2, "impact"), (3, "code-location"), (4, "explanation"), (5, "search"), (6, "data-flow"), (7, "business-rule")], "question_id int, intent string")
    nodes = spark.createDataFrame([(q, f"n{k}", f"N{k}", "program" if k else "data-structure", float(-k), "Long text" if k % 2 else "", "f.cbl:7" if k == 1 else None) for q in (1, 2, 3, 4, 6, 7) for k in range(12)], "question_id int, id string, name string, type string, score double, description string, location string")
    rules = spark.createDataFrame([(7, "R1", "pay", "Pays.", "a*b", 0.666), (7, "R2", "pay", "Stays.", "", 0.5)], "question_id int, name string, category string, description string, formula string, confidence double")
    flows = spark.createDataFrame([(1, "BALANCE", "P1, P2", ""), (1, "RATE", None, "P3")], "question_id int, item string, producers string, consumers string")
    paths = spark.createDataFrame([(q, "N0 → N1 → N2") for q in (2, 4)], "question_id int, steps string")
    return questions, nodes, rules, flows, paths


def said(found, level):
    return {r["question_id"]: r for r in mining.answers(*found, level=level).collect()}


def test_levels(found):
    brief, normal, detailed = (said(found, x) for x in ("brief", "normal", "detailed"))
    assert normal[1]["answer"] == "Data flow analysis:\n\n**BALANCE**:\n  • Produced by: P1, P2\n**RATE**:\n  • Consumed by: P3"
    assert normal[1]["follow_ups"] == ["What would be affected if N0 changes?", "What does N0 depend on?", "Explain how N0 works"]
    assert normal[6]["answer"] == "No data flows found for the specified data."
    assert normal[2]["answer"] == "**10 components would be affected:**\n\n" + "\n".join(f"• N{k} ({'program' if k else 'data-structure'})" for k in range(10))
    assert detailed[2]["answer"] == normal[2]["answer"] + "\n\n**Impact paths:**\n  N0 → N1 → N2"
    assert brief[3]["answer"] == "Found in: " + ", ".join(f"N{k}" for k in range(12))
    assert normal[3]["answer"].startswith("I found 12 relevant location(s):\n\n• **N0** (data-structure): No description\n• **N1** (program) (f.cbl:7): Long text\n") and normal[3]["answer"].count("\n") == 6
    assert brief[4]["answer"] == "**N0** is a data-structure." and normal[4]["answer"] == "**N0** is a data-structure.\n\nIt connects to: N1, N2"
    assert normal[5]["answer"].startswith("I couldn't find specific information") and normal[5]["follow_ups"] == [] and normal[5]["sources"] == []
    assert normal[7]["answer"] == "Found 2 business rule(s):\n\n**R1** (pay):\n  Pays.\n  Formula: `a*b`\n  Confidence: 67%\n**R2** (pay):\n  Stays.\n  Confidence: 50%"
    assert "Formula" not in brief[7]["answer"] and normal[7]["sources"] == [f"n{k}" for k in range(10)] and len(normal[7]["follow_ups"]) == 4
    with pytest.raises(ValueError):
        mining.answers(*found, level="long")


def test_merged_percentiles(spark):
    """Sketches of many windows, merged: counts and extremes exact, ranks within the stated error."""
    import random

    from tessera.operators import telemetry

    rng = random.Random(3)
    rows = [(g, f"2024-01-01 {k % 24:02}:{k % 60:02}:00", rng.gauss(0, 1) ** 3) for g in "ab" for k in range(5000)] + [("a", "2024-01-01 00:00:00", None), ("a", "2024-01-01 00:00:00", float("nan"))]
    points = spark.createDataFrame(rows, "g string, ts string, v double").selectExpr("g", "cast(ts AS timestamp) AS ts", "v")
    for r in telemetry.merged_percentiles(telemetry.percentile_sketches(points, ["g"], "ts", "v", "10 minutes"), ["g"]).collect():
        values = sorted(v for g, _, v in rows if g == r["g"] and v == v and v is not None)
        assert (r["n"], r["low"], r["high"]) == (5000, values[0], values[-1])
        for q, p in ((0.5, r["p50"]), (0.95, r["p95"]), (0.99, r["p99"])):
            assert abs(sum(v <= p for v in values) / len(values) - q) <= 2 * telemetry.KLL_ERROR
