"""The whole pipeline, and each stage against a plain computation on what the stage before kept."""

import hashlib
import re
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as p
from tests.llm.test_jaccard import brute
from tests.llm.test_mixing import plain_targets, words

SF = "/root/testdata/sf0.001"
EDGES = " \t\n\x0b\x0c\r"


def plain_lines(rows):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda line: line.strip(EDGES).translate(low)
    held = {}
    for r in rows:
        for line in (r["text"] or "").split("\n"):
            if len(key(line)) >= 40:
                held.setdefault(key(line), set()).add(r["doc_id"])
    repeated = {k: max(ids) for k, ids in held.items() if len(ids) >= 5}
    return {r["doc_id"]: "\n".join(x for x in (r["text"] or "").split("\n") if repeated.get(key(x), r["doc_id"]) == r["doc_id"]) for r in rows}


def test_run_and_stages(spark):
    docs, kept = spark.read.parquet(f"{SF}/documents.parquet"), []
    frame = docs
    for k, (_, stage) in enumerate(p.STAGES):
        frame = stage(spark, frame, SF).cache()
        kept.append(frame.collect())
        assert k == 4 or frame.columns == docs.columns
    quality, lines, near, mixed, encoded = kept
    whole = {r["doc_id"]: r["text"] for r in docs.collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert all(whole[r["doc_id"]] == r["text"] for r in quality)
    right = sum((d in {r["doc_id"] for r in quality}) == (q == 1) for d, q in labels.items())
    assert right >= 0.9 * len(labels)
    assert {r["doc_id"]: r["text"] for r in lines} == plain_lines(quality)
    assert all(r["n_chars"] == len(r["text"]) for r in lines)
    first = {d for d, _, c in brute([(r["doc_id"], r["text"]) for r in lines]) if d == c}
    assert {r["doc_id"] for r in near} == first and len(near) == len(first)
    sizes, taken = Counter(), Counter()
    for r in near:
        sizes[r["source"]] += words(r["text"])
    for r in mixed:
        taken[r["source"]] += words(r["text"])
    longest = max(words(r["text"]) for r in near)
    assert all(abs(taken[s] - t) <= longest + 1 for s, t in plain_targets(dict(sizes)).items())
    copies = Counter(r["doc_id"] for r in mixed)
    texts = {r["doc_id"]: r["text"] for r in near}
    assert max(copies.values()) <= 2 and all(texts[r["doc_id"]] == r["text"] for r in mixed)
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for r in mixed:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        want[r["doc_id"], r["source"], len(ids), tuple(ids), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()] += 1
    plain = lambda rows: Counter((r["doc_id"], r["source"], r["n_tokens"], tuple(r["ids"]), r["decoded_sha256"]) for r in rows)
    assert plain(encoded) == want
    assert plain(p.run(spark, SF).collect()) == want
    assert re.fullmatch("[0-9a-f]{64}", encoded[0]["decoded_sha256"])
