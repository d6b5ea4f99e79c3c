"""Fragments, greedy matches, mappings, risks and coverage against plain loops in the survey's order."""

import random
import re

from tessera.operators import compare


def fragments(lines, opens, closes):
    out, current = [], None
    for i, line in enumerate(lines, 1):
        if re.search(opens, line.strip()) or current is None:
            if current:
                out.append(current)
            current = [i, i]
        else:
            current[1] = i
            if re.search(closes, line.strip()):
                out.append(current)
                current = None
    return out + ([current] if current else [])


def words(text):
    return {w for w in re.sub("[^a-z0-9]", " ", text.lower()).split() if len(w) > 2}


def likeness(a, b):
    a, b = words(a), words(b)
    return len(a & b) / max(len(a), len(b)) if a and b else 0


def mappings(old, new, rules):
    """Rules first, pair by pair; then each legacy fragment in turn takes the best modern one left."""
    out = []
    for rule, name, low, high in rules:
        a = [f for f in old if f[0] <= high and f[1] >= low]
        b = [f for f in new if re.sub("[^a-z0-9]", "", name.lower()) in f[2].lower()]
        if a and b:
            kind = "direct" if len(a) == len(b) == 1 else "split" if len(a) == 1 else "merged" if len(b) == 1 else "refactored"
            for i in range(max(len(a), len(b))):
                x, y = a[i] if i < len(a) else a[0], b[i] if i < len(b) else b[0]
                out.append((rule, x[0], y[0], kind, likeness(x[2], y[2])))
    used_a, used_b = {m[1] for m in out}, {m[2] for m in out}
    for x in old:
        best = None
        for y in new:
            score = likeness(x[2], y[2])
            if x[0] not in used_a and y[0] not in used_b and score > 0.3 and (best is None or score > best[1]):
                best = (y, score)
        if best:
            out.append((None, x[0], best[0][0], "direct" if best[1] > 0.7 else "refactored", best[1]))
            used_b.add(best[0][0])
    return out


def test_random_programs(spark):
    rng = random.Random(8)
    vocabulary = ["BEGIN", "END", "alpha", "beta", "gamma", "delta", "rate", "an", "x"]
    code = {k: [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5))) for _ in range(rng.randrange(1, 25))] for k in range(25)}
    later = {k: [re.sub("alpha|rate", lambda m: rng.choice([m[0], "omega"]), x) for x in lines] for k, lines in code.items()}
    rules = [(k, f"R{k}{n}", name, low, low + rng.randrange(4)) for k in code for n, name in enumerate(["Omega", "no such"]) for low in [rng.randrange(1, 9)]]
    frames = [spark.createDataFrame([(k, i, x) for k, lines in c.items() for i, x in enumerate(lines, 1)], "k int, line_no int, line string") for c in (code, later)]
    old, new = (compare.code_fragments(f, "k", "^BEGIN", "END$") for f in frames)
    of = {}
    for side, (frame, c) in enumerate(((old, code), (new, later))):
        rows = sorted((r["k"], r["start_line"], r["end_line"], r["content"]) for r in frame.collect())
        want = [(k, a, b, "\n".join(lines[a - 1 : b])) for k, lines in c.items() for a, b in fragments(lines, "^BEGIN", "END$")]
        assert rows == sorted(want)
        of[side] = {k: [r[1:] for r in rows if r[0] == k] for k in c}
    ruled = spark.createDataFrame(rules, "k int, rule string, name string, first_line int, last_line int")
    want = {k: mappings(of[0][k], of[1][k], [r[1:] for r in rules if r[0] == k]) for k in code}
    found = compare.code_mappings(old, new, "k", ruled).cache()
    plain = sorted(((k, *m[:4], round(m[4], 9)) for k in code for m in want[k]), key=str)
    assert sorted(((r["k"], r["rule"], r["a"], r["b"], r["kind"], round(r["confidence"], 9)) for r in found.collect()), key=str) == plain
    risks = set()
    for k, some in want.items():
        risks |= {(k, m[1], "high" if m[4] < 0.3 else "medium", f"Low confidence mapping ({int(m[4] * 100 + 0.5)}%)") for m in some if m[4] < 0.5}
        for a, b, _ in of[0][k]:
            n = sum(r[0] == k and a <= r[4] and b >= r[3] for r in rules)
            if n and a not in {m[1] for m in some}:
                risks.add((k, a, "critical", f"Unmapped legacy code contains {n} business rule(s)"))
    assert {tuple(r) for r in compare.risk_areas(found, old, "k", ruled).collect()} == risks
    for r in compare.mapping_summary(found, old, "k").collect():
        size, some = {a: b - a + 1 for a, b, _ in of[0][r["k"]]}, want[r["k"]]
        assert r["mappings"] == len(some) and r["coverage"] == int(sum(size[m[1]] for m in some) / sum(size.values()) * 100 + 0.5)
        assert abs(r["mean_confidence"] - (sum(m[4] for m in some) / len(some) if some else 0)) < 1e-9


def test_matches_by_rounds_are_those_in_turn(spark):
    rng = random.Random(9)
    rows = [(g, a, b, rng.choice([0.2, 0.4, 0.5, 0.8])) for g in range(6) for a in range(15) for b in range(12) if rng.random() < 0.6]
    got = {(r["g"], r["a"]): (r["b"], r["kind"]) for r in compare.greedy_matches(spark.createDataFrame(rows, "g int, a int, b int, score double"), ["g"]).collect()}
    want = {}
    for g in range(6):
        used = set()
        for a in range(15):
            free = sorted((-s, b) for h, c, b, s in rows if (h, c) == (g, a) and s > 0.3 and b not in used)
            if free:
                used.add(free[0][1])
                want[g, a] = (free[0][1], "direct" if -free[0][0] > 0.7 else "refactored")
    assert got == want


def test_classes_meet_as_their_members_do_a_part_at_a_time(spark, monkeypatch):
    rng = random.Random(10)
    monkeypatch.setattr(compare, "TURNS", 7)
    monkeypatch.setattr(compare, "CANDIDATES", 30)
    score = {(g, i, j): rng.choice([0.2, 0.4, 0.4, 0.8, 0.8]) for g in range(3) for i in range(4) for j in range(5) if rng.random() < 0.8}
    old = [(g, a, rng.randrange(4)) for g in range(3) for a in range(40 * g)]
    new = [(g, b, rng.randrange(5)) for g in range(3) for b in range(35)]
    frames = [spark.createDataFrame(rows, schema) for rows, schema in ((old, "g int, a int, ka int"), (new, "g int, b int, kb int"), ([(*k, s) for k, s in score.items()], "g int, ka int, kb int, score double"))]
    cuts = []
    got = {(r["g"], r["a"]): r["b"] for r in compare.class_matches(*frames, ["g"], cut=lambda df: cuts.append(df) or compare.checkpointed(df)).collect()}
    want, used = {}, set()
    for g, a, k in sorted(old):
        free = sorted((-score[g, k, j], b) for h, b, j in new if h == g and score.get((g, k, j), 0) > 0.3 and (g, b) not in used)
        if free:
            want[g, a] = free[0][1]
            used.add((g, free[0][1]))
    assert got == want and len(want) > 40
    assert len(cuts) > 3 + 80 // 7


def test_a_row_of_scores_stands_for_two_classes(spark):
    old, new = (spark.range(400).selectExpr("1 AS g", f"id AS {c}", f"0L AS k{c}") for c in "ab")
    scores = spark.createDataFrame([(1, 0, 0, 0.9)], "g int, ka long, kb long, score double")
    rows = compare.class_matches(old, new, scores, ["g"]).collect()
    assert sorted((r["a"], r["b"]) for r in rows) == [(k, k) for k in range(400)]


def test_words_are_taken_from_a_fragment_once(spark):
    df = spark.createDataFrame([(1, 1, "alpha beta")], "k int, start_line int, content string")
    plan = compare.fragment_scores(df, df, "k")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    # Nothing above the explode reads the text.
    assert not [line for line in plan if "Project" in line and "regexp_replace" in line and "_word#" in line]
