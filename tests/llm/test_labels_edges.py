"""Null ids, empty tables and repeated rows of the classifiers; their parts against plain computations."""

import math
import re
import zlib

import numpy as np

from tessera.llm import langid, quality

TEXTS = {"en": "the cat sat on the mat and looked at the dog", "de": "der hund und die katze sitzen auf dem dach", "fr": "le chat est sur la table avec le chien"}


def folder(spark, tmp_path, docs, labels):
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


def test_queries_on_hard_rows(spark, tmp_path):
    docs = [(k, f"{TEXTS[lang]} {k % 7}", lang, "s") for k, lang in enumerate(list(TEXTS) * 40)]
    docs += [docs[3]] * 3 + [(None, TEXTS["de"], "de", "s"), (500, None, "en", None), (501, "", None, "s"), (502, "word " * 100_000, "en", "s"), (503, "1 2 3", "en", "s")]
    sf = folder(spark, tmp_path, docs, [(k, k % 2, 0) for k in range(100)] + [(3, 1, 0), (None, 1, 0), (9999, 0, 0)])
    rows = langid.op8_language_id(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        assert (r["lang_pred"] == "und") == (r["doc_id"] in (500, 501, 503)) and 0 <= r["score"] <= 1
    assert len({tuple(r) for r in rows if r["doc_id"] == 3}) == 1
    assert {r["lang_pred"] for r in rows if r["doc_id"] is None} == {"de"}
    rows = quality.op5_quality_classifier(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        assert r["held_out"] == (r["doc_id"] is None or zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_queries_on_empty_tables(spark, tmp_path):
    sf = folder(spark, tmp_path, [], [])
    assert langid.op8_language_id(spark, sf).collect() == [] and quality.op5_quality_classifier(spark, sf).collect() == []


def test_language_vectors_equal_a_plain_count():
    text = "Grüße, the  CAT-42 é!"
    raw = text.lower().encode()
    kept = bytes(c if c >= 128 or chr(c).isalpha() else 32 for c in b" " + raw + b" ")
    kept = re.sub(b" +", b" ", kept)
    want = np.zeros(langid.CELLS)
    for k in range(len(kept) - 2):
        code = (kept[k] << 16 | kept[k + 1] << 8 | kept[k + 2]) * 2654435761 % 2**32
        want[code >> 20] += 1
    got = langid.trigram_counts([text])[0]
    assert (got == want).all()
    idf = np.linspace(0.5, 2, langid.CELLS).astype(np.float32)
    rows = langid.weighted(np.array([got]), idf)[0]
    plain = [math.log(1 + c) * float(w) for c, w in zip(want, idf, strict=True)]
    norm = math.sqrt(sum(x * x for x in plain))
    assert np.allclose(rows, [x / norm for x in plain], atol=1e-6)


def test_nearest_centroid_by_brute_force(spark):
    rng = np.random.default_rng(3)
    docs = [(k, " ".join(rng.permutation(TEXTS[lang].split())[:6]), lang) for k, lang in enumerate(list(TEXTS) * 30)]
    model = langid.fit_languages(spark.createDataFrame(docs, "doc_id long, text string, lang string"))
    texts = [t for _, t, _ in docs]
    found, score, rejected = model.predict(texts)
    for text, lang, s, far in zip(texts, found, score, rejected, strict=True):
        v = langid.weighted(langid.trigram_counts([text]), model.idf)[0]
        cosines = [float(sum(a * b for a, b in zip(v, c, strict=True) if a)) for c in model.centroids]
        best = max(range(len(cosines)), key=cosines.__getitem__)
        assert lang == model.languages[best] and abs(s - cosines[best]) < 1e-5 and far == (s < model.limits[best])
    assert sum(a == c for a, (_, _, c) in zip(found, docs, strict=True)) >= 85


def test_ridge_and_isotonic_equal_plain_solutions(spark):
    """Weights of partition-summed normal equations against one least-squares solution; pooled blocks against all averages."""
    rng = np.random.default_rng(4)
    stats = rng.standard_normal((400, len(quality.STATISTICS))).astype(np.float32)
    label = (stats[:, 0] + 0.3 * rng.standard_normal(400) > 0).astype(int)
    df = spark.createDataFrame([(s.tolist(), int(y)) for s, y in zip(stats, label, strict=True)], "stats array<float>, label int").repartition(5)
    model = quality.fit_quality(df, features=40)
    z = model.features(stats.astype(float))
    penalty = np.sqrt(np.append(np.full(40, 1e-3 * 400), 1e-9))
    want = np.linalg.lstsq(np.vstack([z, np.diag(penalty)]), np.append(label, np.zeros(41)), rcond=None)[0]
    assert np.allclose(z @ model.weights, z @ want, atol=1e-6)
    assert np.allclose(model.mean, stats.astype(float).mean(axis=0), atol=1e-5) and np.allclose(model.scale, stats.astype(float).std(axis=0), atol=1e-5)
    x, p = np.arange(8.0), np.array([0, 3, 1, 2, 2, 0, 5, 4.0])
    n = np.full(8, 5.0)
    _, means = quality.isotonic(x, p, n)
    # The least-squares non-decreasing fit is the max over starts of the min over ends of averages.
    fit = [max(min(p[a : b + 1].sum() / n[a : b + 1].sum() for b in range(k, 8)) for a in range(k + 1)) for k in range(8)]
    assert np.allclose(sorted(set(np.round(means, 12))), sorted(set(np.round(fit, 12))))
    assert (np.diff(model.score(stats[np.argsort(model.raw(stats.astype(float)))].astype(float))) >= -1e-12).all()
