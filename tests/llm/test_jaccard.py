import random
import re

import pytest

from tessera.llm.jaccard import jaccard_components, op9_ngram_jaccard


def words(text):
    low = (text or "").translate({c: c + 32 for c in range(65, 91)})
    return re.findall("[^\x20\x09-\x0d]+", low)


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, (_, a) in enumerate(sets):
        for j in range(i):
            b = sets[j][1]
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                root[max(find(i), find(j))] = min(find(i), find(j))
    groups = {}
    for i, (d, _) in enumerate(sets):
        groups.setdefault(find(i), []).append(d)
    return sorted((d, len(s), min(groups[find(i)])) for i, (d, s) in enumerate(sets))


def near_copies(seed):
    r = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    rows, bases = [], [[r.choice(vocabulary) for _ in range(r.choice([3, 5, 8, 40, 90, 300]))] for _ in range(12)]
    for k in range(240):
        w = list(r.choice(bases))
        for _ in range(r.choice([0, 0, 1, 1, 2, 5])):
            w[r.randrange(len(w))] = r.choice(vocabulary)
        rows.append((k * 3, r.choice([" ", "\n", "\t "]).join(w).upper() if r.random() < 0.3 else " ".join(w)))
    return rows + [(1, None), (2, ""), (4, " \n"), (5, "É é"), (7, "é é"), (8, "É é"), (10, "x")]


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force(spark, seed):
    rows = near_copies(seed)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_long_runs_are_cut_into_tiles(spark, monkeypatch):
    """Tiles of four rows: nearly every run is long, and its tiles meet in pairs."""
    from tessera.llm import jaccard

    monkeypatch.setattr(jaccard, "TILE", 4)
    rows = near_copies(3)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_columns_and_empty_table(spark):
    df = spark.createDataFrame([(3, "a b c d e f", "k"), (3, "a b c d e f", None), (None, "a b c d e f", "z")], "doc_id long, text string, sid string")
    assert sorted(jaccard_components(df).collect(), key=str) == sorted([(3, 2, 3), (3, 2, 3), (None, 2, 3)], key=str)
    assert jaccard_components(df.limit(0)).collect() == []


def test_query_over_documents(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    assert sorted(map(tuple, op9_ngram_jaccard(spark, sf).collect())) == brute(rows)


def test_hot_keys_are_salted_and_their_runs_meet(spark, monkeypatch):
    """Every cell is hot: all runs are cut by set, and their centres meet in a second level."""
    from tessera.llm import jaccard

    monkeypatch.setattr(jaccard, "HOT_CELLS", 10**9)
    monkeypatch.setattr(jaccard, "TILE", 4)
    rows = near_copies(4)
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_rows_of_null_id_link_others(spark):
    """Two texts that only a row without id joins are one component; rows of null id alone have no name."""
    near = lambda x, y: 100 * len(shingles(x) & shingles(y)) >= 80 * len(shingles(x) | shingles(y))
    a, between, far = (" ".join(f"w{i}" for i in range(k, k + 60)) for k in (0, 5, 10))
    assert near(a, between) and near(between, far) and not near(a, far)
    nobody = " ".join(f"n{i}" for i in range(40))
    rows = [(5, a), (9, far), (None, between), (None, nobody), (None, nobody + " more")]
    got = jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(((r["doc_id"] or 0), r["component_id"] or 0) for r in got) == [(0, 0), (0, 0), (0, 5), (5, 5), (9, 5)]


def test_sketch_is_summed_in_levels(spark, monkeypatch):
    import zlib

    import numpy as np

    from tessera.llm import jaccard

    monkeypatch.setattr(jaccard, "FAN_IN", 3)
    size = jaccard.SKETCH // jaccard.PIECES
    part = lambda k: zlib.compress(np.full(size, k, np.uint32).tobytes(), 1)
    rows = [(piece, task, part(task + piece)) for piece in (0, 1, jaccard.PIECES - 1) for task in range(20)]
    got = jaccard._sum_sketch(spark.createDataFrame(rows, "piece int, task int, counts binary"))
    assert [int(got[p * size]) for p in (0, 1, 2, jaccard.PIECES - 1)] == [190, 210, 0, 190 + 20 * (jaccard.PIECES - 1)]
