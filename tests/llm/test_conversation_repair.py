"""Conversation repair against every edit sequence (short runs), a shortest path (whole tables) and edge cases."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

SF = "/root/testdata/sf0.1"
GRAMMAR = re.compile("(s?(ua)+)?")
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def after_damage(rows):
    """Rows of one conversation (conv, turn, role, text) as the contract damages and orders them."""
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        out += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    return sorted(out, key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).digest()))


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def shortest(rows, found):
    """Least (cost, audit) and the repaired lines, by a shortest path over (row, last initial)."""
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, i, last, lines = heapq.heappop(heap)
        if (i, last) in done:
            continue
        done.add((i, last))
        if i == len(rows) and last in ("", "a"):
            return cost, audit, lines
        follows = {"": "su", "s": "u", "u": "a", "a": "u"}[last]
        new = {"u": "user", "a": "assistant"}
        for x in follows.replace("s", ""):
            heapq.heappush(heap, (cost + 2, audit + "I", i, x, (*lines, f"{new[x]}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(heap, (cost + 3, audit + "D", i + 1, last, lines))
        if found[i] in ("blank", "duplicate"):
            continue
        more = found[i] == "truncated"
        if role[:1] and role[:1] in follows:
            heapq.heappush(heap, (cost + more, audit + "K", i + 1, role[0], (*lines, f"{role}:{text}")))
        for x in follows.replace("s", ""):
            heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, x, (*lines, f"{new[x]}:{text}")))
    raise AssertionError


def plain(rows):
    rows = after_damage(rows)
    found = faults(rows)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    cost, audit, lines = shortest(rows, found)
    return (gaps, *(found.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


NAMES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def check(rows, got):
    groups = {}
    for r in rows:
        groups.setdefault(r[0], []).append(r)
    found = {r["conv_id"]: tuple(r[n] for n in NAMES) for r in got}
    assert len(got) == len(found) and set(found) == set(groups)
    for conv, some in groups.items():
        assert found[conv] == plain(some), conv


def every_edit(kinds):
    """Least (cost, audit) of all edit sequences with up to three insertions between turns."""
    best = None
    inserts = [c for n in range(4) for c in itertools.product("ua", repeat=n)]
    for between in itertools.product(inserts, repeat=len(kinds) + 1):
        for edits in itertools.product("DKua", repeat=len(kinds)):
            roles, audit, cost = "", "", 0
            for gap, kind, edit in itertools.zip_longest(between, kinds, edits):
                roles, audit, cost = roles + "".join(gap), audit + "I" * len(gap), cost + 2 * len(gap)
                if edit is None:
                    continue
                roles += {"D": "", "K": kind.lower()}.get(edit, edit)
                audit += edit if edit in "DK" else "R"
                cost += {"D": 3, "K": 0}.get(edit, 2) + (edit != "D" and kind.isupper())
            if (best is None or (cost, audit) < best) and GRAMMAR.fullmatch(roles):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("length", [0, 1, 2])
def test_every_edit_sequence(length):
    from tessera.llm.conversation_repair import END, Conversation

    for kinds in itertools.product("suaoSUAO", repeat=length):
        c = Conversation(1)
        roles = [{"s": "system", "u": "user", "a": "assistant", "o": "tool"}[k.lower()] for k in kinds]
        zero = dict.fromkeys(("rows", "turns", "blank", "duplicate", "truncated", "illegal"), 0)
        c.add({**zero, "low": None, "high": None, "first": "", "last": "", "classes": "".join(kinds), "dead": [0] * (length + 1), "roles": roles, "texts": ["x"] * length}, END)
        r = c.result()
        assert (r["cost"], r["audit"]) == every_edit(kinds), kinds


def test_all_conversations(spark):
    from tessera.llm.conversation_repair import op13_conversation_repair

    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    batch = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    check(rows, op13_conversation_repair(spark, SF).collect())
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == batch


def test_long_conversations_are_cut(spark):
    """One conversation holds most rows and lies over many chunks and partitions."""
    from tessera.llm.conversation_repair import repair_conversations

    rng = random.Random(5)
    texts = ["", " ", "\x0b", "Yes.", "no", "Well?", "a b!", None, "\x85", "ok. \n"] + [f"text {k}{rng.choice('.!? x')}" for k in range(400)]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "ux"]
    rows = [(7, rng.choice([None, *range(-3, 900)]), rng.choice(roles[:2] * 6 + roles), rng.choice(texts)) for _ in range(2500)]
    rows += [(k, t, rng.choice(roles), rng.choice(texts)) for k in (None, -1, 8, 9, 10) for t in rng.sample([None, *range(9)], 7)]
    rows += [(11, 4, "user", "Same text.")] * 300 + [(12, k, "assistant", "Same text") for k in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(7)
    check(rows, repair_conversations(df).collect())
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        check(rows, repair_conversations(df, chunk_turns=3).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_cases(spark):
    from tessera.llm.conversation_repair import repair_conversations

    # A conversation all of whose rows are dropped, one of blanks, one of very long texts, one of null turns.
    dropped = next(k for k in range(1000) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    rows = [(dropped, 0, "user", "Hi."), (2001, 1, None, None), (2001, 2, "user", ""), (2002, 5, "user", "x" * 2_000_000 + "."), (2002, 9, "assistant", "y" * 2_000_000), (2003, None, "user", "A."), (2003, None, "assistant", "B.")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS n", "'k' AS audit", "'m' AS mark")
    got = repair_conversations(df).collect()
    check(rows, got)
    gone = next(r for r in got if r["conv_id"] == dropped)
    assert tuple(gone[n] for n in NAMES) == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert repair_conversations(df.limit(0)).collect() == []
    named = spark.createDataFrame([("a", 1, "user", "A."), ("b", 2, "assistant", "B.")], "id string, t int, r string, x string")
    check([tuple(r) for r in named.collect()], repair_conversations(named, "id", "t", "r", "x").collect())
