"""Deep comparison against plain walks over random nested documents."""

import json
import random

from tessera.operators import compare


def grow(rng, depth):
    kind = rng.choice(["n", "s", "b", "null"] + ["o", "a"] * 2 * (depth > 0))
    if kind == "o":
        return {k: grow(rng, depth - 1) for k in rng.sample(["a", "b", "c d", "e'f", "g.h", "1"], rng.randrange(4))}
    if kind == "a":
        return [grow(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {"n": rng.choice([1, 2, 2.0005, -7.25]), "s": rng.choice(["x", "X", " x", ""]), "b": rng.random() < 0.5, "null": None}[kind]


def change(rng, v, depth=6):
    if rng.random() < 0.08:
        return grow(rng, 2)
    if isinstance(v, dict):
        out = {k: change(rng, x) for k, x in v.items() if rng.random() > 0.1}
        return out | ({"new": 1} if rng.random() < 0.1 else {})
    if isinstance(v, list):
        out = [change(rng, x) for x in v]
        rng.shuffle(out) if rng.random() < 0.2 else None
        return out[: len(out) - 1] if out and rng.random() < 0.1 else out
    return v


def child(path, key):
    if isinstance(key, int):
        return f"{path}[{key}]"
    return (f"{path}.{key}" if path else key) if key.replace("_", "").isalnum() else path + "['" + key.replace("'", "\\'") + "']"


def kind(v):
    return "boolean" if isinstance(v, bool) else {dict: "object", list: "array", str: "string", type(None): "null"}.get(type(v), "number")


def walk(a, b, arrays, strings, path=""):
    at = path or "root"
    if a is None:
        return [] if b is None else [(at, "extra", "critical")]
    if b is None:
        return [(at, "missing", "critical")]
    if kind(a) != kind(b):
        return [(at, "type-mismatch", "critical")]
    wrong = [(at, "value-mismatch", "critical")]
    if isinstance(a, dict):
        out = []
        for k in {**a, **b}:
            p = child(path, k)
            out += [(p, "extra", "warning")] if k not in a else [(p, "missing", "critical")] if k not in b else walk(a[k], b[k], arrays, strings, p)
        return out
    if isinstance(a, list):
        if arrays == "unordered":
            sort = lambda v: sorted(json.dumps(plain(x), sort_keys=True) for x in v)
            return wrong if sort(a) != sort(b) else []
        n = max(len(a), len(b))
        return [d for i in range(n) for d in walk(a[i] if i < len(a) else None, b[i] if i < len(b) else None, arrays, strings, child(path, i))]
    if kind(a) == "number":
        return wrong if abs(a - b) > 0.001 else []
    fold = {"exact": str, "trim": lambda s: s.strip(" "), "fold": str.lower}[strings]
    return wrong if (fold(a) != fold(b) if isinstance(a, str) else a != b) else []


def plain(v):
    return {k: plain(x) for k, x in v.items()} if isinstance(v, dict) else [plain(x) for x in v] if isinstance(v, list) else v


def flat(v, path="$"):
    if isinstance(v, (dict, list)) and v:
        items = v.items() if isinstance(v, dict) else enumerate(v)
        return [x for k, c in items for x in flat(c, child(path, k))]
    return [(path, {True: "true", False: "false"}[v] if isinstance(v, bool) else None if v is None else "{}" if v == {} else "[]" if v == [] else str(v))]


def test_random_documents(spark):
    rng = random.Random(11)
    pairs = [(grow(rng, 5),) for _ in range(150)]
    pairs = [(a, change(rng, a)) for (a,) in pairs]
    one = {"x": {"a": {"b": {"c": {"d": {"x": 1, "y": 2}}}}, "l": [1, 2]}}
    pairs.append((one, {"x": {"a": {"b": {"c": {"d": {"x": 2, "y": 1}}}}, "l": [2, 1]}}))
    sides = [spark.createDataFrame([(k, json.dumps(p[i])) for k, p in enumerate(pairs)], "k long, j string") for i in (0, 1)]
    for arrays, strings in (("ordered", "exact"), ("unordered", "fold"), ("ordered", "trim")):
        want = sorted((k, *d) for k, (a, b) in enumerate(pairs) for d in walk(a, b, arrays, strings))
        got = sorted(map(tuple, compare.differences(*sides, "k", "j", arrays=arrays, strings=strings).select("k", "path", "type", "severity").collect()))
        assert got == want
    want = sorted(((k, *x) for k, (a, _) in enumerate(pairs) for x in flat(a)), key=str)
    assert sorted((tuple(r) for r in compare.leaves(sides[0], "k", "j").select("k", "path", "value").collect()), key=str) == want
    status = {(r["k"], r["path"]): r["status"] for r in compare.deep_compare(*sides, "k", "j").collect()}
    last = len(pairs) - 1
    assert status[last, "$.x.a.b.c.d.x"] == "different" and status[last, "$.x.l[0]"] == "different"


def test_cases(spark):
    rows = [(1, '{"a":1}', '{"a":1.0001}'), (2, "not json", "not json "), (3, None, '{"a":1}'), (4, '{"a":1,"a":2}', "{}"), (5, "[]", "{}"), (6, '{"a":{}}', '{"a":{"b":[{"c":null}]}}'), (7, None, None), (8, '{"secret":1}', '{"secret":2}')]
    a = spark.createDataFrame([r[:2] for r in rows] + [(9, "1")], "k long, j string").selectExpr("*", "1 AS path", "2 AS v")
    b = spark.createDataFrame([(r[0], r[2]) for r in rows] + [(10, "1")], "k long, j string").selectExpr("*", "1 AS path", "2 AS a")
    got = {(r["k"], r["path"], r["type"], r["severity"]) for r in compare.differences(a, b, "k", "j", strings="trim", ignore=("secret",)).collect()}
    assert got == {(3, "root", "extra", "critical"), (4, "root", "type-mismatch", "critical"), (5, "root", "type-mismatch", "critical"), (6, "a.b", "extra", "warning"), (9, "root", "missing", "critical"), (10, "root", "extra", "critical")}
    assert compare.differences(a.limit(0), b.limit(0), "k", "j").collect() == [] and compare.leaves(a.limit(0), "k", "j").collect() == []
