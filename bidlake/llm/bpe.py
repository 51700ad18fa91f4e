"""Byte-level BPE: frequent words by a transducer lexicon, all others by exact merges."""

from __future__ import annotations

import heapq
import json
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.llm.lexicon import Lexicon, compile_lexicon, ship
from bidlake.session import cut

# Fixed value: the pre-tokenizer pattern of byte-level BPE vocabularies.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words of the lexicon, and of a task's memory of other words; both bound memory, neither changes a result.
LEXICON_WORDS, REMEMBERED = 100_000, 100_000
#: Bytes of text, and ids, worked on at once; a batch has any number of them.
CHUNK, IDS = 1_000_000, 250_000
#: For texts of ASCII and Latin letters alone, the same pattern in the faster standard module.
_LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u02af"
_PLAIN = re.compile(rf"'(?:[stmd]|re|ve|ll)| ?[{_LETTERS}]+| ?[0-9]+| ?[^\s0-9{_LETTERS}]+|\s+(?!\S)|\s+").findall
_OTHER = re.compile(rf"[^\t-\r -~\xa1-\xa9\xab\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7{_LETTERS}]").search
_GENERAL = regex.compile(PATTERN).findall


def split_all(text: str) -> list[str]:
    """The pre-tokens of a text without special tokens."""
    return _GENERAL(text) if _OTHER(text) else _PLAIN(text)


def byte_letters() -> dict[str, int]:
    """The printable letters that stand for the 256 bytes: visible Latin-1 for itself, the rest from U+0100 on."""
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Merges and token bytes; small enough to be broadcast (a vocabulary file's size)."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            said = json.load(file)
        if said.get("normalizer") or said["pre_tokenizer"].get("add_prefix_space"):
            raise ValueError("only plain byte-level vocabularies are known")
        letters, vocab = byte_letters(), said["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in said["added_tokens"]}
        self.token_bytes = {i: bytes(letters[c] for c in token) for token, i in vocab.items()}
        self.token_bytes |= {i: content.encode() for content, i in self.special.items()}
        self.single = [0] * 256
        for letter, byte in letters.items():
            self.single[byte] = vocab[letter]
        pairs = [merge if isinstance(merge, list) else merge.split(" ") for merge in said["model"]["merges"]]
        self.merges = {(vocab[left], vocab[right]): rank for rank, (left, right) in enumerate(pairs)}
        self.merged = [vocab[left + right] for left, right in pairs]

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank, leftmost first, is merged until none is left."""
        ids = [self.single[b] for b in word]
        if len(ids) > 200:
            return self._merge_long(ids)
        rank, merged, none = self.merges.get, self.merged, len(self.merged)
        ranks = [rank(pair, none) for pair in zip(ids, ids[1:])]
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            ids[at] = new = merged[best]
            del ids[at + 1], ranks[at]
            if at:
                ranks[at - 1] = rank((ids[at - 1], new), none)
            if at < len(ranks):
                ranks[at] = rank((new, ids[at + 1]), none)
        return ids

    def _merge_long(self, ids: list[int]) -> list[int]:
        """The same by a heap over a linked list, for words of any length."""
        merges, n = self.merges, len(ids)
        after, prior = [*range(1, n), -1], [*range(-1, n - 1)]
        heap = [(merges[pair], at, *pair) for at, pair in enumerate(zip(ids, ids[1:])) if pair in merges]
        heapq.heapify(heap)
        while heap:
            best, at, left, right = heapq.heappop(heap)
            gone = after[at]
            if ids[at] != left or gone < 0 or ids[gone] != right:
                continue
            ids[at], ids[gone] = self.merged[best], -1
            after[at] = after[gone]
            if after[gone] >= 0:
                prior[after[gone]] = at
            for x in (prior[at], at):
                if x >= 0 and after[x] >= 0 and (pair := (ids[x], ids[after[x]])) in merges:
                    heapq.heappush(heap, (merges[pair], x, *pair))
        return [i for i in ids if i >= 0]


def _slices(batch: pa.RecordBatch, place: int, lengths: Callable[[pa.Array], pa.Array], most: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of whole rows; each has up to ``most`` by ``lengths`` of that column, or one row."""
    ends = np.cumsum(pc.fill_null(lengths(batch.column(place)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start, n = 0, batch.num_rows
    while start < n:
        done = int(ends[start - 1]) if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, done + most, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def frequent_words(texts: DataFrame, text_col: str, words: int) -> list[bytes]:
    """Pre-tokens of the most frequent stretches between blanks, over all texts; about ``words`` stretches come to the driver.

    The count that so many stretches reach is taken from a table of counts, so that no task sends its own most frequent ones.
    """
    stretches = texts.select(F.explode(F.split(F.col(text_col), " ", -1)).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    often = cut(stretches.filter("n > 1 and length(word) between 1 and 60"))
    level = F.least(F.floor(F.log2("n") * 32), F.lit(2000)).cast("int").alias("level")  # few levels, each 2 % of a count wide
    held, least = 0, None
    for row in often.groupBy(level).count().orderBy(F.desc("level")).collect():
        if held and held + row["count"] > words:
            break
        held, least = held + row["count"], row["level"]
    if least is None:
        return []
    top = often.filter(F.floor(F.log2("n") * 32) >= least).orderBy(F.desc("n"), "word").limit(words).select("word") if held > words else often.filter(F.floor(F.log2("n") * 32) >= least).select("word")
    return sorted({piece.encode() for row in top.collect() for piece in split_all(f" {row[0]}")})


def bpe_encode(texts: DataFrame, path: str, text_col: str = "text", ids_col: str = "ids", words: int = LEXICON_WORDS) -> DataFrame:
    """Add the token ids of every whole text, as the vocabulary at ``path`` (on the driver) has them.

    A text without tokens, empty or null, gets an empty array; texts may have any length; equal texts get equal
    ids; other columns stay, and one named ``ids_col`` is replaced. The lexicon is compiled from the
    most frequent pre-tokens of these very texts; which words it holds changes speed only.
    """
    spark = texts.sparkSession
    vocabulary = Vocabulary(path)
    name = ship(spark, compile_lexicon(frequent_words(texts, text_col, words), vocabulary.merge))
    shared = spark.sparkContext.broadcast(vocabulary)
    kept = [c for c in texts.columns if c != ids_col]
    place = kept.index(text_col)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(shared.value, Lexicon(SparkFiles.get(name)))
        for batch in batches:
            for rows in _slices(batch, place, pc.binary_length, CHUNK):
                offsets, ids = encoder.encode([t or "" for t in rows.column(place).to_pylist()])
                column = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([*rows.columns, column], names=[*kept, ids_col])

    schema = texts.select(*kept).schema.add(ids_col, T.ArrayType(T.IntegerType()))
    return texts.select(*kept).mapInArrow(encode, schema)


class Encoder:
    """Encodes lists of texts in one task."""

    def __init__(self, vocabulary: Vocabulary, lexicon: Lexicon) -> None:
        self.vocabulary, self.lexicon, self.memory = vocabulary, lexicon, {}
        longest = sorted(vocabulary.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return split_all(text)
        return [p for i, part in enumerate(self.special.split(text)) for p in ([part] if i % 2 else split_all(part))]

    def unseen(self, word: str, raw: bytes) -> list[int]:
        if (ids := self.memory.get(word)) is None:
            special = self.vocabulary.special.get(word)
            ids = self.vocabulary.merge(raw) if special is None else [special]
            if len(self.memory) >= REMEMBERED:
                self.memory.clear()
            if len(raw) < 64:
                self.memory[word] = ids
        return ids

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Offsets of the texts in the ids of all, and those ids."""
        flat: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, text in enumerate(texts):
            flat += self.pieces(text)
            ends[i + 1] = len(flat)
        if not flat:
            return ends, np.zeros(0, np.int64)
        codes, words = pd.factorize(np.array(flat, object))
        raw = [w.encode() for w in words]
        rows = self.lexicon.rows(raw)
        missing = np.flatnonzero(rows < 0)
        extra = [self.unseen(words[i], raw[i]) for i in missing]
        starts, counts = np.zeros(len(raw), np.int64), np.zeros(len(raw), np.int64)
        known = rows >= 0
        starts[known] = self.lexicon.starts[rows[known]]
        counts[known] = self.lexicon.starts[rows[known] + 1] - starts[known]
        base = len(self.lexicon.ids)
        counts[missing] = [len(x) for x in extra]
        starts[missing] = base + np.cumsum(counts[missing]) - counts[missing]
        table = np.concatenate([self.lexicon.ids, np.fromiter((i for x in extra for i in x), np.int64, int(counts[missing].sum()))])
        n = counts[codes]
        upto = np.concatenate([[0], np.cumsum(n)])
        where = np.repeat(starts[codes] - upto[:-1], n) + np.arange(upto[-1])
        return upto[ends], table[where]


def bpe_decode(encoded: DataFrame, path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """Add the text of each array of ids; null or empty arrays give the empty text; unknown ids give nothing.

    Bytes that aren't UTF-8 become U+FFFD. Other columns stay, and one named ``text_col`` is replaced.
    """
    vocabulary = Vocabulary(path)
    size = max(vocabulary.token_bytes) + 2  # the last stands for unknown ids
    tokens = [vocabulary.token_bytes.get(i, b"") for i in range(size)]
    shared = encoded.sparkSession.sparkContext.broadcast(tokens)
    kept = [c for c in encoded.columns if c != text_col]
    place = kept.index(ids_col)

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = shared.value
        for batch in batches:
            for rows in _slices(batch, place, pc.list_value_length, IDS):
                column = rows.column(place)
                flat = column.flatten().to_numpy(zero_copy_only=False)  # without the null arrays' ids
                flat = np.where((flat >= 0) & (flat < size - 1), flat, size - 1).astype(np.int64)  # null: NaN
                ends = np.cumsum([0, *(n or 0 for n in column.value_lengths().to_pylist())])
                texts = [b"".join(map(tokens.__getitem__, flat[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())], names=[*kept, text_col])

    schema = encoded.select(*kept).schema.add(text_col, T.StringType())
    return encoded.select(*kept).mapInArrow(decode, schema)
