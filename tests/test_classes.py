"""Rules meet lines, hunks and patterns by classes: equal ones meet once, and nothing is lost."""

import random

from tessera.operators import catalog, traces


def test_crowded_lines_meet_crowded_rules(spark):
    """40,000 events on a line and 40,000 rules over it would be 1.6 billion pairs."""
    n = 40_000
    events = spark.range(n).selectExpr("'f' AS file", "7L AS line", "concat('Click of user ', id) AS text")
    rules = spark.range(n).selectExpr("id AS rule", "'f' AS file", "5L AS first", "9L AS last", "array('click', 'x') AS terms")
    counts = traces.range_counts(events, rules)
    assert counts.count() == n and {r["hits"] for r in counts.select("hits").distinct().collect()} == {n}
    got = traces.validated_rules(events, rules).drop("rule").distinct().collect()
    assert [tuple(r) for r in got] == [(n, n, 1.0, True, "click")]
    hunks = spark.range(n).selectExpr("id AS hunk", "'f' AS file", "4L AS first", "6L AS last", "array('w') AS words")
    assert [tuple(r) for r in catalog.overlap_counts(hunks, rules).select("n", "first_hunk").distinct().collect()] == [(n, 0)]
    rows = catalog.match_classes(hunks, rules, rules.selectExpr("rule", "'w' AS term")).groupBy("kind").count().collect()
    assert {tuple(r) for r in rows} == {("hunk", n), ("rule", n), ("lines", 1), ("keywords", 1)}


def test_validated_rules_of_odd_events(spark):
    r = random.Random(5)
    words = ["a", "b", "c", "d"]
    events = [(r.choice("fg"), r.randint(0, 30), r.choice([None, "", " ".join(r.choices([*words, "B", "q"], k=r.randint(1, 5)))])) for _ in range(200)]
    rules = []
    for rule in range(40):
        first = r.randint(0, 30)
        rules.append((rule % 36, r.choice("fgh"), first, first + r.randint(-1, 9), r.choice([["a", "b", "x"], ["c"], ["d", "d", "q"], []])))
    want = {}
    for rule, file, first, last, terms in rules:
        for f, line, text in events:
            if f == file and first <= line <= last:
                told = set(text.lower().split(" ")) if text is not None else None
                ok = told is not None and len(set(terms) & told) >= 0.3 * len(terms)
                seen = want.setdefault(rule, [0, 0])
                seen[0] += 1
                seen[1] += ok
    got = traces.validated_rules(spark.createDataFrame(events, "file string, line long, text string"), spark.createDataFrame(rules, "rule int, file string, first long, last long, terms array<string>"))
    assert {x["rule"]: [x["events"], x["matched"]] for x in got.collect()} == want


def test_match_classes_expand_to_all_matches(spark):
    r = random.Random(9)
    hunks = [(k, r.choice(["f", "g", None]), a, a + r.randint(0, 6), r.choices("uvwxyz", k=2)) for k in range(60) for a in [r.randint(0, 90)]]
    rules = [(k, r.choice("fg"), a, a + r.randint(0, 40)) for k in range(30) for a in [r.randint(0, 90)]]
    terms = [(k, t) for k in range(20) for t in r.choices("uvwxyz", k=3)]
    h = spark.createDataFrame(hunks, "hunk long, file string, first long, last long, words array<string>")
    g, t = spark.createDataFrame(rules, "rule long, file string, first long, last long"), spark.createDataFrame(terms, "rule long, term string")
    want = {(x["hunk"], x["rule"]): round(x["score"], 9) for x in catalog.hunk_matches(h, g, t).collect()}
    rows = catalog.match_classes(h, g, t).collect()
    sides = {k: {x[k]: (x["lines_class"], x["words_class"]) for x in rows if x["kind"] == k} for k in ("hunk", "rule")}
    pairs = {k: {(x["hunk"], x["rule"]): x["score"] for x in rows if x["kind"] == k} for k in ("lines", "keywords")}
    got = {}
    for a, (la, wa) in sides["hunk"].items():
        for b, (lb, wb) in sides["rule"].items():
            score = pairs["lines"].get((la, lb), pairs["keywords"].get((wa, wb)))
            if score is not None:
                got[a, b] = round(score, 9)
    assert got == want and len(sides["hunk"]) == 60 and len(sides["rule"]) == 30


def test_patterns_of_equal_rules(spark):
    n = 20_000
    rules = spark.range(n).selectExpr("id", "'d' AS domain", "array('big', 'bolt', 'z') AS words")
    patterns = spark.range(5_000).selectExpr("concat('big ', id) AS pattern", "'d' AS domain", "array('big', string(id)) AS words").unionByName(spark.sql("SELECT 'big bolt' AS pattern, 'd' AS domain, array('big', 'bolt') AS words"))
    got = catalog.best_pattern(rules, patterns, "id", "domain")
    assert got.count() == n and [tuple(x) for x in got.select("pattern", "score").distinct().collect()] == [("big bolt", 2 / 3)]
