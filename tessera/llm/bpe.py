"""Operator 7, BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from tessera.llm.common import documents, ship, small_batches

#: White space as the vocabulary's normaliser knows it (Unicode White_Space).
_SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_SPACES = regex.compile(f"[{_SPACE}]+")
_SEPARATORS = regex.compile("[\x1c-\x1f]")
_STRIP = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2028\u2029\u202f\u205f\u3000" + "".join(map(chr, range(0x2000, 0x200B)))


def _byte_chars() -> list[str]:
    """The printable stand-in of each byte: printable Latin-1 is itself, others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in own]
    table = {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [table[b] for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary with word ends, read from a tokenizers JSON file.

    Words of a batch lie in one flat array of symbol ids. Each round finds every
    pair's rank by binary search over the sorted pair keys, takes each word's
    lowest rank and merges all its occurrences from left to right; words without
    pairs leave the array. Where a merge could make a pair of lower rank than
    its own, only the leftmost occurrence is merged in a round, so that results
    equal one-at-a-time merging for any vocabulary.
    """

    def __init__(self, path: str, cache_words: int = 300_000, cache_bytes: int = 64 << 20):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.special.values()]) + 1)
        for token, k in [*vocab.items(), *self.special.items()]:
            self.tokens[k] = token
        self.base = len(self.tokens)
        self.token_array = pa.array(self.tokens, pa.string())
        chars = _byte_chars()
        self.inner = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        left, right, made = [], [], []
        for pair in model["merges"]:
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left.append(vocab[a])
            right.append(vocab[b])
            made.append(vocab[a + b])
        keys = np.array(left, np.int64) * self.base + np.array(right, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.made = np.array(made, np.int64)
        first_use = np.full(self.base, len(made), np.int64)
        np.minimum.at(first_use, np.array(left), np.arange(len(made)))
        np.minimum.at(first_use, np.array(right), np.arange(len(made)))
        self.in_order = bool((first_use[self.made] > np.arange(len(made))).all())
        split = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.words = regex.compile(split.replace("\\s", _SPACE)).findall
        self.cut = regex.compile("(" + "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")").split if self.special else None
        self.cache_words, self.cache_bytes, self.cache, self.held = cache_words, cache_bytes, {}, 0
        self.flat, self.starts, self.sizes = np.empty(0, np.int32), np.empty(0, np.int64), np.empty(0, np.int64)

    def normalize(self, text: str) -> str:
        """NFC, each character lower-cased alone. White space parts words whatever its length, so it stays."""
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return text.replace("Σ", "σ").lower()

    def pieces(self, text: str) -> list[str]:
        """The stretches between white space; str.split knows four separators more than the vocabulary."""
        return text.split() if _SEPARATORS.search(text) is None else _SPACES.split(text.strip(_STRIP))

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Token ids of the words, flat, and the number of each word's tokens."""
        raw = [w.encode() for w in words]
        sizes = np.array([len(b) for b in raw], np.int64)
        data = np.frombuffer(b"".join(raw), np.uint8)
        symbols = self.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.last[data[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_owner = [], []
        none = len(self.made)
        while symbols.size:
            pair = symbols[:-1] * self.base + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), self.keys.size - 1)
            rank = np.where((self.keys[at] == pair) & (owner[:-1] == owner[1:]), self.ranks[at], none)
            rank = np.append(rank, none)
            begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            lengths = np.diff(np.append(begins, owner.size))
            low = np.repeat(np.minimum.reduceat(rank, begins), lengths)
            live = low < none
            if not live.all():
                done_ids.append(symbols[~live])
                done_owner.append(owner[~live])
                symbols, owner, rank, low = symbols[live], owner[live], rank[live], low[live]
                if not symbols.size:
                    break
            hit = np.flatnonzero(rank == low)
            if not self.in_order:
                hit = hit[np.append(True, owner[hit][1:] != owner[hit][:-1])]
            else:
                # Of a run of overlapping hits (a a a a) every second one merges, from the left.
                run = np.append(True, np.diff(hit) != 1)
                first = np.maximum.accumulate(np.where(run, np.arange(hit.size), 0))
                hit = hit[(np.arange(hit.size) - first) % 2 == 0]
            symbols[hit] = self.made[rank[hit]]
            keep = np.ones(symbols.size, bool)
            keep[hit + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        if not done_ids:
            return np.empty(0, np.int32), np.zeros(len(words), np.int64)
        ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
        order = np.argsort(owner, kind="stable")
        return ids[order].astype(np.int32), np.bincount(owner, minlength=len(words))

    def _learn(self, new: list[str]) -> None:
        """Add pieces to the look-up: their words are merged once each and put together again."""
        lists = [self.words(p) for p in new]
        place = {}
        for words in lists:
            for w in words:
                place.setdefault(w, len(place))
        ids, sizes = self.merge(list(place))
        starts = np.cumsum(sizes) - sizes
        order = np.fromiter((place[w] for words in lists for w in words), np.int64)
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        taken = sizes[order]
        ends = np.cumsum(taken)
        flat = ids[np.arange(int(taken.sum())) + np.repeat(starts[order] - (ends - taken), taken)]
        bounds = np.append(0, ends)[np.append(0, np.cumsum(lengths))]
        self.starts = np.concatenate([self.starts, self.flat.size + bounds[:-1]])
        self.sizes = np.concatenate([self.sizes, np.diff(bounds)])
        self.flat = np.concatenate([self.flat, flat])

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, flat, and the offsets of each text's ids.

        Pieces already met by this worker are looked up; the look-up is emptied
        at ``cache_words`` pieces or ``cache_bytes`` (at most four a character).
        """
        if len(self.cache) > self.cache_words or self.held > self.cache_bytes:
            self.held, self.cache, self.flat, self.starts, self.sizes = 0, {}, self.flat[:0], self.starts[:0], self.sizes[:0]
        if not self.cache:
            for token, k in self.special.items():
                self.cache[f" {token}"] = len(self.cache)  # no piece begins with a space
                self.flat = np.append(self.flat, np.int32(k))
                self.starts, self.sizes = np.append(self.starts, self.flat.size - 1), np.append(self.sizes, 1)
        cache, new, counts, places = self.cache, [], [], []
        for text in texts:
            if self.cut is not None and any(s in text for s in self.special):
                found = []
                for k, part in enumerate(self.cut(text)):
                    found += [f" {part}"] if k % 2 else self.pieces(self.normalize(part))
            else:
                found = self.pieces(self.normalize(text))
            counts.append(len(found))
            for w in set(found).difference(cache):
                cache[w] = len(cache)
                self.held += 4 * len(w)
                new.append(w)
            places.append(np.fromiter(map(cache.__getitem__, found), np.int64, len(found)))
        if new:
            self._learn(new)
        place = np.concatenate(places) if places else np.empty(0, np.int64)
        sizes = self.sizes[place]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if ends.size else 0
        ids = self.flat[np.arange(total) + np.repeat(self.starts[place] - (ends - sizes), sizes)]
        return ids, np.append(0, ends)[np.append(0, np.cumsum(counts))]

    def decode_lists(self, lists: pa.ListArray) -> pa.Array:
        """As the file's missing decoder has it: tokens joined by one space; unknown ids are left out."""
        flat, offsets = lists.flatten(), np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)))
        known = np.asarray(pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(self.tokens))), False))
        if not known.all():
            offsets, flat = np.append(0, np.cumsum(known))[offsets], flat.filter(pa.array(known))
        return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.token_array.take(flat)), " ")

    def decode(self, ids) -> str:
        """:meth:`decode_lists` of one list."""
        return self.decode_lists(pa.array([list(ids)], pa.list_(pa.int32())))[0].as_py()


_models: dict[str, WordBpe] = {}


def model(path: str) -> WordBpe:
    """The worker's one copy of a vocabulary."""
    if path not in _models:
        _models[path] = WordBpe(path)
    return _models[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_encode(docs: DataFrame, path: str | None = None, text_col: str = "text", ids_col: str = "ids", decoded_col: str | None = None) -> DataFrame:
    """Adds ``ids`` (array of int) to every row; null text is empty and has no ids.

    With ``decoded_col`` the ids are decoded again in the same pass. All input
    columns are kept, but those of the new names are replaced. The vocabulary
    file must be readable at ``path`` on every executor.
    """
    ship(docs.sparkSession)
    path = path or default_path()
    docs = docs.drop(ids_col, *([decoded_col] if decoded_col else []))
    at, names = docs.columns.index(text_col), [*docs.columns, ids_col, *([decoded_col] if decoded_col else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            ids, offsets = bpe.encode_batch([t or "" for t in batch.column(at).to_pylist()])
            lists = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(ids))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, *([bpe.decode_lists(lists)] if decoded_col else [])], names=names)

    fields = [*docs.schema.fields, StructField(ids_col, ArrayType(IntegerType())), *([StructField(decoded_col, StringType())] if decoded_col else [])]
    return docs.mapInArrow(run, StructType(fields))


def bpe_decode(encoded: DataFrame, path: str | None = None, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Adds the decoded text of ``ids_col``, in place of a column of that name; null ids decode to an empty text."""
    ship(encoded.sparkSession)
    path = path or default_path()
    encoded = encoded.drop(text_col)
    at, names = encoded.columns.index(ids_col), [*encoded.columns, text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, bpe.decode_lists(batch.column(at))], names=names)

    return encoded.mapInArrow(run, StructType([*encoded.schema.fields, StructField(text_col, StringType())]))


def op7_bpe(spark, sf_dir):
    """Digests of the ids and of the decoded texts of all documents."""
    small_batches(spark)
    decoded = bpe_encode(documents(spark, sf_dir).select("doc_id", "text"), decoded_col="decoded")
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
