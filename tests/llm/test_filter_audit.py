"""The filter audit against a plain replay of every order, with edge cases."""

import re
from collections import Counter
from itertools import permutations

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


def plain(docs, labels):
    """Replay of (id, text, source) rows by the definition, document by document."""
    good = {k for k, q, _ in labels if q == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    out = Counter()
    for doc_id, text, source in docs:
        t = text or ""
        words = re.findall("[^\x20\x09-\x0d]+", t)
        least = min((i for i, other, _ in docs if i is not None and (other or "") == t), default=None)
        fails = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t),
            "D": bool(re.search("[#$%&*|]", t)),
            "E": doc_id is not None and least is not None and doc_id > least,
        }
        for order in permutations("ABCDE"):
            alive = True
            for step, f in enumerate(order, 1):
                key = (source or "", "".join(order), step)
                now = alive and fails[f]
                out[key, "kept"] += alive and not now
                out[key, "removed"] += now
                out[key, "redundant"] += fails[f] and not alive
                out[key, "unique_fails"] += fails[f] and sum(fails.values()) == 1
                out[key, "good_lost"] += now and doc_id in good
                out[key, "toxic_lost"] += now and doc_id in toxic
                out[(source or "", f), "shapley"] += now
                alive = alive and not now
    return out


def test_cases(spark):
    from tessera.llm.filter_audit import COUNTS, document_flags, replay

    long = " ".join(f"word{k}" for k in range(300))
    docs = [
        (1, long, "a"), (2, long, "a"), (2, long, "b"), (3, long + " $", "a"), (None, long, "a"), (4, None, None), (5, "", ""), (6, "LOUD WORDS", "a"),
        (7, "x " * 50_000, "b"), (8, "\x0b\x0c\t ", "b"), (9, "\x85 \xa0x", "a"), (9, "\x85 \xa0x", "a"), (10, long, "b"), (-1, "pipe|", "c"), (None, None, "c"),
    ]
    labels = [(1, 1, 0), (2, 0, 1), (2, 1, 0), (7, None, 1), (None, 1, 1), (6, 0, 0), (10, 1, None)]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").selectExpr("*", "1 AS fails", "'k' AS part", "true AS good")
    said = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = replay(document_flags(df, said)).collect()
    want = plain(docs, labels)
    assert len(rows) == 600 * 4 and {r["part"] for r in rows} == {"a", "b", "c", ""}
    for r in rows:
        key = (r["part"], r["filter_order"], r["step"])
        for c in COUNTS:
            assert r[c] == want[key, c], (key, c)
        assert r["shapley"] == want[(r["part"], r["filter_order"][r["step"] - 1]), "shapley"]
    assert replay(document_flags(df.limit(0), said)).collect() == []
    assert len(replay(document_flags(df, said.limit(0))).where("good_lost + toxic_lost > 0").collect()) == 0
    for filters in ("", "AA", "ABCDEFG"):
        with pytest.raises(ValueError):
            replay(document_flags(df, said), filters)


def test_equals_duckdb(spark):
    from tessera.llm.filter_audit import SQL, op11_filter_audit

    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(SQL)
    columns = [c[0] for c in cursor.description]
    got = sorted(tuple(r[c] for c in columns) for r in op11_filter_audit(spark, SF).collect())
    assert got == sorted(cursor.fetchall())
