"""Hostile headers, record ids, and revisits held against their responses."""

import hashlib
import re

import pytest

from tessera.llm.warc import check_revisits, header_value, parse_record, plan_records, read_bundles, record_bytes, write_bundles

HOSTILE = ["http://a/\r\n\r\nx", "a\r\nContent-Length: 3", "\r", "\n", "a b\tc", "http://ü/\x00\x85\x7f", "", "x: y"]
PAYLOAD = b"\r\n\r\nWARC/1.1\r\n" * 20


@pytest.mark.parametrize("url", HOSTILE)
def test_urls_stay_one_line(url):
    digest = hashlib.sha256(PAYLOAD).hexdigest()
    headers, block = parse_record(record_bytes(7, url, PAYLOAD, digest, None))
    assert block == PAYLOAD and headers["content-length"] == str(len(PAYLOAD)) and headers["x-page"] == "7"
    assert headers["warc-target-uri"] == header_value(url) and not re.search(r"[\x00-\x20\x7f]", headers["warc-target-uri"])
    assert re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\dZ", headers["warc-date"])


def frame(spark):
    big = "<p>" + "y" * 300
    rows = [(k, HOSTILE[k % len(HOSTILE)], big) for k in range(3, 20)] + [(1, "u", big)] * 3 + [(None, "v", big)] * 2 + [(30, "u", "small")] * 2 + [(31, None, None), (4, "other", "z" * 200)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS refers_to", "'k' AS payload", "true AS repeated")


def test_round_trip_of_hostile_rows(spark):
    rows, df = frame(spark)
    got = check_revisits(read_bundles(write_bundles(plan_records(df), 500, 2000))).collect()
    assert len(got) == len(rows) and len({r["record_id"] for r in got}) == len(rows)
    want = []
    for page, url, html in rows:
        revisit = page is not None and page > 1 and html is not None and html.startswith("<p>")
        payload = (html or "").encode()
        want.append((page, len(payload), hashlib.sha256(payload).hexdigest(), "revisit" if revisit else "response", 1 if revisit else None, header_value(url or "")))
    assert sorted(map(str, want)) == sorted(str(tuple(r)[:6]) for r in got)
    assert all((r["payload"] is None) == (r["record_type"] == "revisit") for r in got)


def test_a_revisit_without_its_response_is_found(spark):
    _, df = frame(spark)
    records = read_bundles(write_bundles(plan_records(df)))
    check_revisits(records)
    with pytest.raises(ValueError):
        check_revisits(records.where("page_id <> 1"))
    with pytest.raises(ValueError):
        check_revisits(records.selectExpr("page_id", "payload_bytes + (CASE record_type WHEN 'revisit' THEN 1 ELSE 0 END) AS payload_bytes", "payload_digest", "record_type", "refers_to"))
