"""Encoding of texts with a public byte-level BPE vocabulary, by batched numpy merge rounds."""

from __future__ import annotations

import heapq
import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from frameloom.session import ship_package

#: Where the vocabulary files of public tokenizers are; they are never copied into the repository.
TOKENIZER_FOLDER = os.environ.get("FRAMELOOM_TOKENIZERS", "/opt/tokenizers")
VOCABULARY = "byte_bpe_50k.json"

#: Words kept in a task's cache; when it is full it is emptied, which changes the speed and not the result.
CACHED_WORDS = 200_000

#: Words of more bytes are merged by a queue: rounds over them would go on for as long as there are different pairs.
LONG_WORD = 2000

#: Texts of a batch are encoded in portions of so many characters, so that long texts bound the memory used.
PORTION_CHARS = 1_000_000

# Fixed value: the pattern that splits text into words before the merges, as published with the vocabulary.
WORD_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _visible_bytes() -> dict[str, int]:
    """The character that stands for each byte in the vocabulary file: printable Latin-1 as it is, others from U+0100 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class ByteBpe:
    """A byte-level BPE vocabulary as sorted arrays, and the words encoded so far."""

    _loaded: dict[str, ByteBpe] = {}

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocabulary, merges = model["vocab"], model["merges"]
        self.base = np.zeros(256, np.int64)
        for character, byte in _visible_bytes().items():
            self.base[byte] = vocabulary[character]
        self.size = max(vocabulary.values()) + 1
        keys, made = [], []
        for merge in merges:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            keys.append(vocabulary[left] * self.size + vocabulary[right])
            made.append(vocabulary[left + right])
        order = np.argsort(np.array(keys, np.int64), kind="stable")
        #: Pair keys in order; the rank of a merge is its place in the file.
        self.keys = np.array(keys, np.int64)[order]
        self.ranks = order.astype(np.int64)
        self.made = np.array(made, np.int64)[order]
        self.words = regex.compile(WORD_PATTERN)
        self.pairs: dict[int, tuple[int, int]] = {}
        self._forget()

    def _forget(self) -> None:
        self.places: dict[str, int] = {}
        self.flat, self.starts, self.lengths = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def _learn(self, words: list[str]) -> None:
        """Put the ids of new words into the cache: one flat array, and where each word's ids begin in it."""
        merged = self.merge([w.encode() for w in words])
        lengths = np.fromiter(map(len, merged), np.int64, len(merged))
        ends = len(self.flat) + np.cumsum(lengths)
        self.places.update(zip(words, range(len(self.starts), len(self.starts) + len(words)), strict=True))
        self.flat = np.concatenate([self.flat, *merged])
        self.starts = np.concatenate((self.starts, ends - lengths))
        self.lengths = np.concatenate((self.lengths, lengths))

    @classmethod
    def load(cls, path: str) -> ByteBpe:
        """One instance per process and file."""
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merge_long(self, word: bytes) -> np.ndarray:
        """The ids of one long word: pairs wait in a queue by rank, then place, and merge in linked lists."""
        if not self.pairs:
            self.pairs = dict(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist(), strict=True), strict=True))
        symbols = self.base[np.frombuffer(word, np.uint8)].tolist()
        n, size = len(symbols), self.size
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            if found := self.pairs.get(key := symbols[i] * size + symbols[i + 1]):
                queue.append((found[0], i, key))
        heapq.heapify(queue)
        while queue:
            _, i, key = heapq.heappop(queue)
            j = after[i] if symbols[i] >= 0 else n
            if j >= n or symbols[i] * size + symbols[j] != key:
                continue  # one of the two has merged otherwise
            symbols[i], symbols[j] = self.pairs[key][1], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for left, right in ((before[i], i), (i, after[i])):
                if left >= 0 and right < n and (found := self.pairs.get(key := symbols[left] * size + symbols[right])):
                    heapq.heappush(queue, (found[0], left, key))
        return np.array([x for x in symbols if x >= 0], np.int32)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each word.

        All words lie in one flat array of symbols. A round looks up every adjacent pair by binary search over the
        sorted pair keys, takes the lowest rank of each word and merges that pair wherever it occurs in the word
        (from the left where occurrences overlap); words without a pair left are finished. Merging all occurrences
        at once is exact, as a pair with a merged symbol always has a higher rank than the merge that made it.
        """
        done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(words)
        for i, w in enumerate(words):
            if len(w) > LONG_WORD:
                done[i] = self.merge_long(w)
        words = [w if len(w) <= LONG_WORD else b"" for w in words]
        lengths = np.array([len(w) for w in words], np.int64)
        symbols = self.base[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), lengths)
        none = len(self.keys)
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            keys = symbols[:-1] * self.size + symbols[1:]
            at = np.minimum(np.searchsorted(self.keys, keys), none - 1)
            known = inside & (self.keys[at] == keys)
            rank = np.where(known, self.ranks[at], none)
            starts = np.flatnonzero(np.concatenate(([True], ~inside)))
            lowest = np.minimum.reduceat(np.concatenate((rank, [none])), starts)
            ends = np.append(starts[1:], len(symbols))
            # The last place of a word holds the pair across its end, which isn't known and so has no rank.
            finished = lowest == none
            if finished.any():
                for i in np.flatnonzero(finished):
                    done[owner[starts[i]]] = symbols[starts[i] : ends[i]].astype(np.int32)
                keep = np.repeat(~finished, ends - starts)
                if not keep.any():
                    break
                live = np.flatnonzero(keep)
                pair_at = np.where(np.concatenate((rank, [none])) < none, np.append(at, 0), -1)[live]
                rank_here = np.concatenate((rank, [none]))[live]
                symbols, owner = symbols[live], owner[live]
                lowest = np.repeat(lowest[~finished], (ends - starts)[~finished])
            else:
                pair_at = np.append(at, -1)
                rank_here = np.append(rank, none)
                lowest = np.repeat(lowest, ends - starts)
            hit = (rank_here == lowest) & (rank_here < none)
            # Of a run of overlapping hits (a a a) every second one from its start merges.
            places = np.flatnonzero(hit)
            first = np.concatenate(([True], np.diff(places) > 1))
            run_start = places[np.maximum.accumulate(np.where(first, np.arange(len(places)), 0))]
            places = places[(places - run_start) % 2 == 0]
            symbols[places] = self.made[pair_at[places]]
            keep = np.ones(len(symbols), bool)
            keep[places + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        return done

    def _words(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(place in the cache of every word of the texts, number of words of each text)."""
        split = [self.words.findall(t) if t else [] for t in texts]
        flat = [w for words in split for w in words]
        distinct = set(flat)
        missing = [w for w in distinct if w not in self.places]
        if missing and len(self.places) + len(missing) > CACHED_WORDS:
            self._forget()
            missing = list(distinct)
        if missing:
            self._learn(missing)
        return np.fromiter(map(self.places.__getitem__, flat), np.int64, len(flat)), np.fromiter(map(len, split), np.int64, len(split))

    def count(self, texts: list[str | None]) -> np.ndarray:
        """The number of ids of each text."""
        words, n_words = self._words(texts)
        sums = np.concatenate(([0], np.cumsum(self.lengths[words])))
        ends = np.cumsum(n_words)
        return sums[ends] - sums[ends - n_words]

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts in a row, number of ids of each text); null and empty texts have none."""
        words, n_words = self._words(texts)
        lengths = self.lengths[words]
        sums = np.concatenate(([0], np.cumsum(lengths)))
        ids = self.flat[np.repeat(self.starts[words] - sums[:-1], lengths) + np.arange(sums[-1])]
        ends = np.cumsum(n_words)
        return ids, sums[ends] - sums[ends - n_words]


def _portions(texts: list[str | None], limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``limit`` characters; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > limit:
            yield begin, i
            begin, size = i, 0
        size += n
    yield begin, len(texts)


def _vocabulary_path(path: str | None) -> str:
    return path or os.path.join(TOKENIZER_FOLDER, VOCABULARY)


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(key, ids): the token ids of every document, without special tokens.

    Method: batched numpy merge rounds (``ByteBpe.merge``). One pass without shuffle: each task splits its texts
    into words, encodes the words it hasn't met yet in one batch, and gathers the ids. Null and empty texts have an
    empty list; strings of special tokens are ordinary text; the rest of the columns is ignored; repeated rows and
    null keys come out as they are; an empty table gives an empty result. ``vocabulary`` is the path of the
    vocabulary file, which all executors must see (by default in the folder FRAMELOOM_TOKENIZERS).
    """
    path = _vocabulary_path(vocabulary)
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path)
        for batch in batches:
            keys, texts = batch.column(0), batch.column(1).to_pylist()
            for begin, end in _portions(texts, PORTION_CHARS):
                ids, counts = bpe.encode(texts[begin:end])
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                yield pa.RecordBatch.from_arrays([keys.slice(begin, end - begin), lists], names=[key, "ids"])

    chosen = documents.select(key, text)
    schema = T.StructType([chosen.schema[0], T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return chosen.mapInArrow(run, schema)


def count_tokens(documents: DataFrame, keys: list[str], text: str = "text", vocabulary: str | None = None) -> DataFrame:
    """(keys, tokens): the number of token ids of every document, as ``encode_corpus`` would give."""
    path = _vocabulary_path(vocabulary)
    ship_package(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe.load(path)
        for batch in batches:
            texts = batch.column(len(keys)).to_pylist()
            counts = [bpe.count(texts[begin:end]) for begin, end in _portions(texts, PORTION_CHARS)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(np.concatenate(counts).astype(np.int64))], names=[*keys, "tokens"])

    chosen = documents.select(*keys, text)
    schema = T.StructType([*chosen.schema.fields[: len(keys)], T.StructField("tokens", T.LongType())])
    return chosen.mapInArrow(run, schema)
