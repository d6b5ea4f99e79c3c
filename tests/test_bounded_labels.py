"""Labels of one node are merged in groups of a bounded number of places."""

import random

from tessera.operators import condensation as c


def test_parts_of_places(spark, monkeypatch):
    monkeypatch.setattr(c, "PLACES", 10)
    r = random.Random(2)
    rows = [(i, lo, lo + r.randrange(1, 30)) for i in (1, 2) for lo in [r.randrange(200) for _ in range(15)]] * 2
    got = [tuple(x) for x in c.merged(spark.createDataFrame(rows, "id long, lo long, hi long")).select("id", "lo", "hi").collect()]
    for i in (1, 2):
        places = sorted(p for j, lo, hi in got if j == i for p in range(lo, hi))
        assert places == sorted({p for j, lo, hi in rows if j == i for p in range(lo, hi)})
    assert all(lo // 10 == (hi - 1) // 10 for _, lo, hi in got)
