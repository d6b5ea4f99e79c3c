"""The registered queries over small tables: SQL twins, round trips and properties."""

import hashlib
import re
import zlib

import duckdb
import pytest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["op2_line_dedup", "op9_ngram_jaccard", "op10_warc_bundles"])
def test_equals_duckdb(spark, name):
    from tessera.llm.registry import ORACLES, QUERIES

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(ORACLES[name])
    columns = [c[0] for c in cursor.description]
    want = sorted(map(str, cursor.fetchall()))
    got = sorted(str(tuple(r[c] for c in columns)) for r in QUERIES[name](spark, SF).collect())
    assert got == want


def test_line_dedup_cases(spark):
    from tessera.llm.line_dedup import line_dedup

    long = "This line is long enough to be counted as repeated"
    rows = [(k, f"{'  ' if k % 2 else ''}{long.upper() if k % 3 else long}\nown {k}\n{long}", "x") for k in range(6)]
    rows += [(10, None, None), (11, "", None), (3, rows[3][1], "x"), (None, long, "x"), (12, "É" * 45 + "\nshort", "y"), (13, "é" * 45, "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_lines string")
    got = {(r["doc_id"], r["text"], r["n_lines"], r["n_dropped"]) for r in line_dedup(df).collect()}
    want = {(k, f"own {k}", 3, 2) for k in range(5)} | {(5, rows[5][1], 3, 0), (10, "", 1, 0), (11, "", 1, 0), (None, long, 1, 0), (12, "É" * 45 + "\nshort", 2, 0), (13, "é" * 45, 1, 0)}
    assert got == want
    assert line_dedup(df.limit(0)).collect() == []


def test_mix_reaches_targets(spark):
    from tessera.llm.mixing import op3_source_mix, targets

    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op3_source_mix(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    sizes, taken = {}, {}
    for r in rows:
        d = docs[r["doc_id"]]
        assert r["size"] == len(re.findall("[^\x20\x09-\x0d]+", d["text"] or "")) and r["taken"] in (0, r["size"], 2 * r["size"])
        sizes[d["source"]] = sizes.get(d["source"], 0) + r["size"]
        taken[d["source"]] = taken.get(d["source"], 0) + r["taken"]
    want = targets(sizes)
    for r in rows:
        s = docs[r["doc_id"]]["source"]
        assert r["source_size"] == sizes[s] and r["target"] == float(want[s])
        assert abs(taken[s] - want[s]) <= max(1, 0.02 * sizes[s])
    assert sorted(map(tuple, rows)) == sorted(map(tuple, op3_source_mix(spark, SF).collect()))


def test_mix_cases(spark):
    from tessera.llm.mixing import fit_counts, mix, targets

    assert targets({None: 10, "b": 10, "a": 100}) == {"a": 140, "b": 20, None: 20}
    assert targets({}) == {} and targets({"a": 0}) == {"a": 0}
    for budget in (0, 1, 999, 12345, 49_999, 50_000, 60_000):
        lengths, counts = [0, 3, 7, 500, 1000], [4, 100, 100, 20, 39]
        k = fit_counts(lengths, counts, budget, "s")
        assert all(0 <= a <= b for a, b in zip(k, counts))
        total = sum(n * c for n, c in zip(lengths, counts))
        assert budget >= total or budget - sum(a * n for a, n in zip(k, lengths)) < 8
    rows = [(k, "a b c", "big") for k in range(3000)] + [(5000, None, None), (5001, "", "big"), (5001, "", "big"), (5002, "x y", None), (5003, "x y z w", "zz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS size", "'k' AS copies")
    out = mix(df).collect()
    assert len(out) == len(rows)
    assert sum(r["copies"] * r["size"] for r in out if r["source"] == "big") in range(13480, 13520) and {r["copies"] for r in out if r["source"] == "zz"} == {2}
    assert mix(df.limit(0)).collect() == []


def test_warc_cases(spark):
    from tessera.llm.warc import BundleWriter, plan_records, read_bundles, read_record, record_bytes, write_bundles

    page = "<p>" + "x" * 200 + "é</p>"
    rows = [(1, "u", page), (2, None, page), (3, "u", page), (1, "u", page), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", page), (7, "u", ""), (8, "u", "y" * 3_000_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'k' AS digest")
    got = sorted(((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in read_bundles(write_bundles(plan_records(df), 1000, 4000)).collect()), key=str)
    n = len(page.encode())
    want = [(1, "response", None, n)] * 2 + [(2, "revisit", 1, n), (3, "revisit", 1, n), (4, "response", None, 5), (5, "response", None, 5), (6, "response", None, 0), (None, "response", None, n), (7, "response", None, 0), (8, "response", None, 3_000_000)]
    assert got == sorted(want, key=str)
    assert read_bundles(write_bundles(plan_records(df.limit(0)))).collect() == []
    w = BundleWriter(100)
    for k in range(9):
        w.add(k, record_bytes(k, "u", b"z" * 40 * k, hashlib.sha256(b"z" * 40 * k).hexdigest(), None))
    body = w.close()
    for r in w.index:
        headers, block = read_record(body, r["frame"], r["at"], r["length"])
        assert headers["warc-record-id"] == f"<urn:page:{r['id']}>" and block == b"z" * 40 * r["id"]


def test_media_round_trip(spark):
    import numpy as np

    from tessera.llm.media import cosine_hash, decode_png, encode_png, media_features, op6_media_columns, pad, store_media

    rng = np.random.default_rng(1)
    for kind in (0, 1, 2):
        x = rng.integers(0, 256, (12, 96), dtype=np.uint8)
        assert (decode_png(encode_png(x, kind)) == x).all()
    with pytest.raises(ValueError):
        broken = bytearray(encode_png(x))
        broken[60] ^= 1
        decode_png(bytes(broken))
    assert len(pad(b"")) == 576 and len(pad(b"a" * 576)) == 576 and len(pad(b"a" * 577)) == 1152
    smooth = np.add.outer(np.arange(96), np.arange(96)).astype(np.uint8)
    assert bin(int(cosine_hash(smooth), 16) ^ int(cosine_hash(np.minimum(smooth.astype(int) + 2, 255).astype(np.uint8)), 16)).count("1") <= 6
    docs = {r["doc_id"]: (r["text"] or "").encode() for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    for r in op6_media_columns(spark, SF).collect():
        payload = pad(docs[r["doc_id"]])
        assert (r["n_bytes"], r["payload_bytes"]) == (len(docs[r["doc_id"]]), len(payload))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
    df = spark.createDataFrame([(1, None, "a"), (1, None, "b"), (None, "x" * 100_000, "c")], "doc_id long, text string, media string")
    assert sorted(r["n_bytes"] for r in media_features(store_media(df)).collect()) == [0, 0, 100_000]
    assert media_features(store_media(df.limit(0))).collect() == []


def test_paeth_and_average_filters():
    import struct

    import numpy as np

    from tessera.llm.media import SIGNATURE, _chunk, decode_png

    rng = np.random.default_rng(2)
    x = rng.integers(0, 256, (6, 9), dtype=np.uint8).astype(int)
    rows = []
    for y in range(6):
        kind, line = (3, 4)[y % 2], []
        for c in range(9):
            a, b, d = (x[y, c - 1] if c else 0), (x[y - 1, c] if y else 0), (x[y - 1, c - 1] if y and c else 0)
            p = a + b - d
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d)))[2]
            line.append((x[y, c] - ((a + b) // 2 if kind == 3 else paeth)) % 256)
        rows.append(bytes([kind, *line]))
    png = SIGNATURE + _chunk(b"IHDR", struct.pack(">IIBBBBB", 9, 6, 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(b"".join(rows))) + _chunk(b"IEND", b"")
    assert (decode_png(png) == x).all()


def test_language_held_out_accuracy(spark):
    from tessera.llm.langid import detect_language, fit_languages, op8_language_id

    sf = "/root/testdata/sf0.01"
    lang = {r["doc_id"]: r["lang"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in op8_language_id(spark, sf).collect() if lang[r["doc_id"]]]
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in rows)
    assert sum(lang[r["doc_id"]] == r["lang_pred"] for r in held) >= 0.95 * len(held)
    df = spark.createDataFrame([(1, None, "en", 0), (2, "123 !", "en", 0), (3, "the cat and the dog", "en", 0), (4, "x" * 100_000, None, 0)], "doc_id long, text string, lang string, score int")
    got = {r["doc_id"]: r["lang_pred"] for r in detect_language(df, fit_languages(df)).collect()}
    assert got == {1: "und", 2: "und", 3: "en", 4: "en"}
    assert {r["lang_pred"] for r in detect_language(df, fit_languages(df.limit(0))).collect()} == {"und"}


def test_quality_held_out_accuracy(spark):
    from tessera.llm.quality import fit_quality, op5_quality_classifier, score_documents, with_statistics

    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in op5_quality_classifier(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    held = [(rows[r["doc_id"]], r["quality"]) for r in labels if rows[r["doc_id"]]["held_out"]]
    assert sum(r["predicted"] == q for r, q in held) >= 0.98 * len(held)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in rows.values())
    df = spark.createDataFrame([(1, None, 1), (2, "", 0), (2, "Text " * 30_000, None)], "doc_id long, text string, score int")
    stats = with_statistics(df)
    nothing = fit_quality(stats.selectExpr("stats", "1 AS label").limit(0))
    assert {r["score"] for r in score_documents(df, nothing).collect()} == {0.5}
    one = fit_quality(stats.selectExpr("stats", "1 AS label"))
    assert all(0 <= r["score"] <= 1 for r in score_documents(df, one).collect())


def test_pipeline_stages(spark):
    """Each stage against a plain computation on what the stage before kept."""
    import corpus_pipeline as p
    from tests.llm.test_jaccard import brute

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept, frames = [], docs
    for k, (_, stage) in enumerate(p.STAGES):
        frames = stage(spark, frames, SF).cache()
        kept.append(frames.collect())
        assert k == 4 or frames.columns == docs.columns
    bad = {r["doc_id"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect() if r["quality"] == 0}
    quality, lines, near, mixed, encoded = kept
    assert len({r["doc_id"] for r in quality} & bad) <= len(bad) // 3 and len(quality) >= 0.85 * (docs.count() - len(bad))
    assert {r["doc_id"] for r in lines} == {r["doc_id"] for r in quality}
    components = brute([(r["doc_id"], r["text"]) for r in lines])
    assert {r["doc_id"] for r in near} == {d for d, n, c in components if d == c}
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in near}
    words = lambda rows: sum(len((r["text"] or "").split()) for r in rows)
    assert abs(words(mixed) - 1.5 * words(near)) < 0.05 * words(near)
    assert len(encoded) == len(mixed)
