"""Pseudonyms against a plain Feistel network, and dates as one permutation of all days."""

import datetime
import hashlib
import random

from tessera.llm import pii

KEY = "a key"


def digest(*parts):
    return hashlib.sha256(":".join(parts).encode()).hexdigest()


def feistel(left, right, a, b, key):
    """Eight rounds over 0..a-1 and 0..b-1, each side moved by a digest of the other in turn."""
    for k in range(8):
        if k % 2 == 0:
            left = (left + int(digest(key, str(k), str(right))[:14], 16) % a) % a
        else:
            right = (right + int(digest(key, str(k), str(left))[:14], 16) % b) % b
    return left, right


def feistel_text(text, key):
    half = len(text) // 2
    left, right = text[:half], text[half:]

    def moved(part, d):
        out = ""
        for p, c in enumerate(part):
            draw = int(d[(p % 32) * 2 : (p % 32) * 2 + 2], 16)
            base, size = (48, 10) if "0" <= c <= "9" else (97, 26) if "a" <= c <= "z" else (65, 26) if "A" <= c <= "Z" else (None, None)
            out += c if base is None else chr(base + (ord(c) - base + draw) % size)
        return out

    for k in range(8):
        if k % 2 == 0:
            left = moved(left, digest(key, str(k), right))
        else:
            right = moved(right, digest(key, str(k), left))
    return left + right


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10


def card(value):
    digits = "".join(filter(str.isdigit, value))
    inner = digits[1:-1]
    half = len(inner) // 2
    left, right = feistel(int(inner[:half]), int(inner[half:]), 10**half, 10 ** (len(inner) - half), f"{KEY}:card")
    body = digits[0] + str(left).zfill(half) + str(right).zfill(len(inner) - half)
    new = iter(body + str(-luhn(body + "0") % 10))
    return "".join(next(new) if c.isdigit() else c for c in value)


def ssn(value):
    area, group, serial = map(int, value.split("-"))
    place = area - 2 if area > 666 else area - 1
    left, right = feistel(place * 99 + group - 1, serial - 1, 898 * 99, 9999, f"{KEY}:ssn")
    area = left // 99
    return f"{area + 2 if area > 664 else area + 1:03d}-{left % 99 + 1:02d}-{right + 1:04d}"


def ipv4(value):
    p = list(map(int, value.split(".")))
    left, right = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, f"{KEY}:ipv4")
    return f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"


def phone(value):
    digits = "".join(filter(str.isdigit, value))
    prefix, digits = digits[:-10], digits[-10:]
    area, exchange, line = int(digits[:3]), int(digits[3:6]), int(digits[6:])
    low, size = (lambda x: 200 if x >= 200 else 0), (lambda x: 800 if x >= 200 else 200)
    left, right = feistel((area - low(area)) * size(exchange) + exchange - low(exchange), line, size(area) * size(exchange), 10_000, f"{KEY}:phone")
    new = iter(prefix + f"{left // size(exchange) + low(area):03d}{left % size(exchange) + low(exchange):03d}{right:04d}")
    return "".join(next(new) if c.isdigit() else c for c in value)


def iban(value):
    compact = value.replace(" ", "")
    account = feistel_text(compact[4:], f"{KEY}:iban{compact[:2]}")
    number = "".join(str(int(c, 36)) for c in account + compact[:2] + "00")
    new = iter(compact[:2] + f"{98 - int(number) % 97:02d}" + account)
    return "".join(next(new) if c != " " else c for c in value)


def email(value):
    local, _, host = value.partition("@")
    return feistel_text(local, f"{KEY}:email{host.lower()}") + "@" + host


def date(day):
    spans = {1: (303, 111, 997), 304: (1503, 567, 773), 1504: (1903, 189, 773), 1904: (2099, 147, 487), 2100: (2499, 189, 773), 2500: (9699, 3402, 773), 9700: (9999, 276, 397)}
    start = max(y for y in spans if y <= day.year)
    _, a, b = spans[start]
    first = datetime.date(start, 1, 1)
    left, right = feistel((day - first).days // b, (day - first).days % b, a, b, f"{KEY}:date")
    return first + datetime.timedelta(left * b + right)


def run(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.pseudonymize(rows, KEY).collect()}
    return [got[k] for k in range(len(texts))]


def test_equals_a_plain_feistel_network(spark):
    r = random.Random(8)
    number = lambda n: "".join(r.choice("0123456789") for _ in range(n))
    cases = []
    for k in range(60):
        body = r.choice("3456") + number(r.choice([11, 13, 14, 17]))
        digits = body + str(-luhn(body + "0") % 10)
        cases.append((card, " ".join(digits[i : i + 4] for i in range(0, len(digits), 4)) if k % 2 else digits))
        cases.append((ssn, f"{r.choice([r.randint(1, 665), r.randint(667, 899)]):03d}-{r.randint(1, 99):02d}-{r.randint(1, 9999):04d}"))
        cases.append((ipv4, ".".join(str(r.randint(0, 255)) for _ in range(4))))
        cases.append((phone, r.choice(["({}) {}-{}", "{}-{}-{}", "+1 {} {} {}"]).format(r.randint(200, 999), r.randint(200, 999), number(4))))
        account = number(18)
        check = 98 - int("".join(str(int(c, 36)) for c in account + "DE00")) % 97
        compact = f"DE{check:02d}{account}"
        cases.append((iban, " ".join(compact[i : i + 4] for i in range(0, 22, 4)) if k % 2 else compact))
        cases.append((email, f"{r.choice(['Ann', 'bo.b', 'x_9', 'Q'])}{number(k % 4)}@Mail{k % 3}.example.org"))
        day = datetime.date(1, 1, 1) + datetime.timedelta(r.randrange(3_652_058))
        cases.append((lambda v: date(datetime.date.fromisoformat(v)).isoformat(), day.isoformat()))
    for (plain, value), got in zip(cases, run(spark, [v for _, v in cases]), strict=True):
        assert got == plain(value), value
    again = [(k, v) for k, (_, v) in enumerate(cases)] * 2
    rows = spark.createDataFrame(again, "doc_id long, text string")
    assert len(set(map(tuple, pii.pseudonymize(rows, KEY).collect()))) == len(cases)  # repeated rows get equal pseudonyms


def test_days_of_1490_to_2600_stay_apart(spark):
    days = [datetime.date(1490, 1, 1) + datetime.timedelta(k) for k in range(0, (datetime.date(2601, 1, 1) - datetime.date(1490, 1, 1)).days, 7)]
    got = run(spark, [d.isoformat() for d in days])
    assert len(set(got)) == len(days) and sum(a == b.isoformat() for a, b in zip(got, days, strict=True)) < 10
    assert got[::997] == [date(d).isoformat() for d in days[::997]]
    some = days[::41]
    for layout in ("{0:04d}/{1:02d}/{2:02d}", "{2:02d}.{1:02d}.{0:04d}", "{2:02d}-{1:02d}-{0:04d}", "{1:02d}/{2:02d}/{0:04d}"):
        write = lambda d, f=layout: f.format(d.year, d.month, d.day)
        assert run(spark, [write(d) for d in some]) == [write(date(d)) for d in some], layout
