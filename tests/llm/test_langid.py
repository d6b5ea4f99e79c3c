"""The training rows of the language model where texts have many copies."""

from tessera.llm.langid import fit_languages


def test_copies_do_not_crowd_out_other_texts(spark):
    from pyspark.sql import functions as F

    copied = spark.range(2000).select(F.concat(F.lit("AAA the same line stands in many places "), "id").alias("text"))
    draw = F.pmod(F.xxhash64(F.lit(11), "text"), F.lit(1 << 30)) / float(1 << 30)
    text = copied.where(draw < 0.02).orderBy("text").first()["text"]  # drawn where the draw is by text
    words = [f"{a}{b}" for a in ("wald", "see", "berg", "haus", "licht") for b in ("lich", "ung", "chen", "weg")]
    others = [f"ein {words[k % 20]} und {words[k * 7 % 19]} mit {words[k * 3 % 17]} bei {k}" for k in range(600)]
    df = spark.createDataFrame([(t, "de") for t in [text] * 600 + others] + [("one two", "en")] * 5, "text string, lang string")
    model = fit_languages(df, sample_rows=100)
    assert model.languages.count("de") > 1 and model.languages.count("en") == 1
    _, _, rejected = model.predict(others)
    assert rejected.mean() < 0.1


def test_weights_keep_the_share_of_copies(spark):
    from tessera.llm.langid import training_texts

    df = spark.createDataFrame([("copied", "x")] * 5000 + [(f"own {k}", "x") for k in range(5000)] + [("a", "y")] * 3 + [("b", "y")], "text string, lang string")
    got = {(r["lang"], r["text"]): r["weight"] for r in training_texts(df, {"x": 10000, "y": 4}, 400, 11).collect()}
    assert got["x", "copied"] == 200 and (got["y", "a"], got["y", "b"]) == (3, 1)
    own = [w for (lang, t), w in got.items() if t.startswith("own")]
    assert set(own) == {1} and 140 <= len(own) <= 260
