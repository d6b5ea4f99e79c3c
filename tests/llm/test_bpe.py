import hashlib
import random

import pytest

from tessera.llm.bpe import WordBpe, bpe_decode, bpe_encode, default_path

TEXTS = [
    "", " ", "Hello, World! it's we'll THEY'RE 12345", "İstanbul ΣΑΣ é ß ẞ ﬁ",
    "a\x85b c d\x1ce​f　g", "aaaaaaaaaaaaaaaaaaaaaaa " * 7, "<|endoftext|>x <|startoftext|><|endoftext|>",
    "\U0001f600\U0001f3f3️‍\U0001f308 你好สวัสดี الع", "x" * 3000, "l'été d'où '' 's's", "tab\tnew\nline\r\n ٠١ ½ Ⅷ",
]


@pytest.fixture(scope="module")
def theirs():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_path())
    t.no_padding()
    t.no_truncation()
    return t


def noise(seed):
    r = random.Random(seed)
    pool = "abcdefgh ISTANBUL\n'.,!?0123456789éüßÑΣİ你\U0001f600́‍\t"
    return "".join(r.choice(pool) for _ in range(r.randint(0, 200)))


def test_ids_and_texts_equal_the_library(theirs):
    texts = TEXTS + [noise(k) for k in range(400)]
    bpe = WordBpe(default_path())
    ids, offsets = bpe.encode_batch(texts)
    for k, text in enumerate(texts):
        want = theirs.encode(text, add_special_tokens=False).ids
        got = ids[offsets[k] : offsets[k + 1]].tolist()
        assert got == want, text
        assert bpe.decode(got) == theirs.decode(want, skip_special_tokens=False)


def test_one_at_a_time_merging_agrees():
    texts = TEXTS + [noise(k) for k in range(100)]
    a, b = WordBpe(default_path()), WordBpe(default_path(), cache_words=0)
    b.in_order = False
    x, y = a.encode_batch(texts), b.encode_batch(texts)
    assert x[0].tolist() == y[0].tolist() and x[1].tolist() == y[1].tolist()


def test_frame_keeps_columns_and_nulls(spark, theirs):
    df = spark.createDataFrame([(1, None, "k"), (1, "Same text", None), (1, "Same text", None), (None, "", "z")], "doc_id long, text string, n_tokens string")
    rows = bpe_decode(bpe_encode(df)).collect()
    assert len(rows) == 4 and {r["n_tokens"] for r in rows} == {"k", None, "z"}
    for r in rows:
        assert list(r["ids"]) == theirs.encode(r["text"] or "", add_special_tokens=False).ids
    clash = bpe_encode(df.withColumnRenamed("n_tokens", "ids"))
    assert clash.columns == ["doc_id", "text", "ids"] and dict(clash.dtypes)["ids"] == "array<int>"
    assert bpe_encode(df.limit(0)).collect() == []
    both = bpe_encode(df, decoded_col="back").drop("text").collect()
    assert sorted(map(str, both)) == sorted(map(str, bpe_decode(bpe_encode(df), text_col="back").drop("text").collect()))


def test_query_over_documents(spark, theirs):
    from tessera.llm.bpe import op7_bpe

    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in op7_bpe(spark, sf).collect():
        ids = theirs.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(theirs.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_lookup_is_bounded_in_bytes():
    """Long pieces without white space empty the look-up by their bytes; ids stay those of the library."""
    import public_tokenizers
    from tokenizers import Tokenizer

    from tessera.llm.bpe import WordBpe

    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = WordBpe(path, cache_bytes=100_000), Tokenizer.from_file(path)
    texts = [f"{'abcd' * 4000}{k} short words é{k} here" for k in range(12)] + ["short words here", ""]
    for text in texts:
        ids, offsets = own.encode_batch([text, text])
        assert ids[: offsets[1]].tolist() == ids[offsets[1] :].tolist() == library.encode(text, add_special_tokens=False).ids
        assert own.held <= 100_000 + 4 * len(text)
