"""File programs against a plain run, step by step, over random programs."""

import random


def run(steps, records):
    out = []
    for file in {f for _, f, _, _ in steps}:
        held, at, is_open = [d for _, d in sorted((n, d) for f, n, d in records if f == file)], 0, False
        for step, _, operation, data in sorted(s for s in steps if s[1] == file):
            status, got = "00", None
            if operation.startswith("OPEN"):
                is_open, at = True, 0
                held = [] if operation == "OPEN-OUTPUT" else held
            elif not is_open:
                status = "42"
            elif operation == "CLOSE":
                is_open = False
            elif operation == "WRITE":
                held = [*held, data]
            elif at >= len(held):
                status = "10"
            else:
                got, at = held[at], at + 1
            out.append((step, file, operation, status, got))
    return sorted(out)


def test_random_programs(spark):
    from tessera.sources.parsers import file_program

    rng = random.Random(2)
    steps, records = [], [(f"f{f}", n, f"r{n}") for f in range(0, 12, 2) for n in range(f // 2)]
    for f in range(12):
        operations = ["OPEN", "READ", "READ", "READ", "WRITE", "CLOSE"] + ["OPEN-OUTPUT"] * (f % 3 > 0)
        steps += [(100 * f + k, f"f{f}", rng.choice(operations), rng.choice([None, f"w{k}"])) for k in range(60)]
    got = file_program(spark.createDataFrame(steps, "step int, file string, operation string, data string"), spark.createDataFrame(records, "file string, record_no int, data string"))
    assert sorted(map(tuple, got.collect())) == run(steps, records)
    assert {r["status"] for r in got.collect()} == {"00", "10", "42"}
    assert file_program(spark.createDataFrame(steps, "step int, file string, operation string, data string").limit(0), spark.createDataFrame(records, "file string, record_no int, data string")).collect() == []
