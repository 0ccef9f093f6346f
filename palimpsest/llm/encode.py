"""Problem 7: encoding a corpus with a public byte-level BPE, through a lexicon of its frequent words."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.llm.lexicon import Lexicon, compile_lexicon
from palimpsest.runtime import Scratch, spread, write_bytes

VOCABULARY = "byte_bpe_50k.tiktoken"
LEXICON_WORDS = 1 << 15
MEMO = 1 << 16
_loaded: dict = {}


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def load_ranks(path: str) -> dict[bytes, int]:
    if ("ranks", path) not in _loaded:
        with open(path, "rb") as f:
            _loaded["ranks", path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _loaded["ranks", path]


def word_pattern():
    if "pattern" not in _loaded:
        import public_tokenizers

        _loaded["pattern"] = regex.compile(public_tokenizers.PATTERN)
    return _loaded["pattern"]


def merge_word(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Exact merges of one word: always the pair of least rank, the leftmost of equal ones.

    Pairs wait in a heap and parts are linked, so a word of n bytes takes n log n steps.
    """
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    end, nxt, prev = list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(word[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = nxt[i] if end[i] >= 0 else n
        if j >= n or end[j] != stop:
            continue  # one of the two parts was merged meanwhile
        end[i], nxt[i] = stop, nxt[j]
        end[j] = -1
        if nxt[i] < n:
            prev[nxt[i]] = i
            if (r := ranks.get(word[i : end[nxt[i]]])) is not None:
                heapq.heappush(heap, (r, i, end[nxt[i]]))
        if prev[i] >= 0 and (r := ranks.get(word[prev[i] : stop])) is not None:
            heapq.heappush(heap, (r, prev[i], stop))
    out, i = [], 0
    while i < n:
        out.append(ranks[word[i : end[i]]])
        i = nxt[i]
    return out


class Encoder:
    """Texts to ids: memo of words seen here, then the mapped lexicon, then exact merges."""

    def __init__(self, lexicon: str | None, vocabulary: str):
        self.lexicon = Lexicon(lexicon) if lexicon else None
        self.ranks = load_ranks(vocabulary)
        self.split = word_pattern().findall
        self.memo: dict[str, list[int]] = {}

    def word(self, w: str) -> list[int]:
        raw = w.encode("utf-8", "replace")
        ids = self.lexicon.get(raw) if self.lexicon else None
        if ids is None:
            ids = merge_word(raw, self.ranks)
        if len(self.memo) >= MEMO:
            self.memo.clear()
        if len(raw) <= 64:
            self.memo[w] = ids
        return ids

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo, add = self.memo, out.extend
        for w in self.split(text):
            ids = memo.get(w)
            add(self.word(w) if ids is None else ids)
        return out


def frequent_words(texts: DataFrame, column: str, words: int) -> DataFrame:
    """(word, n): the most frequent words over all texts, ties by the word. Words over 64 bytes are not counted."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, seen = word_pattern().findall, Counter()

        def out():
            return pa.RecordBatch.from_pydict({"word": pa.array(list(seen), pa.string()), "n": pa.array(list(seen.values()), pa.int64())})

        for batch in batches:
            for text in batch.column(0).to_pylist():
                if text:
                    seen.update(split(text))
            if len(seen) > 4 * MEMO:
                yield out()
                seen.clear()
        yield out()

    return (
        texts.select(column)
        .mapInArrow(count, "word string, n long")
        .where(F.octet_length("word") <= 64)
        .groupBy("word")
        .agg(F.sum("n").alias("n"))
        .orderBy(F.desc("n"), "word")
        .limit(words)
    )


def build_lexicon(texts: DataFrame, column: str, vocabulary: str, words: int = LEXICON_WORDS) -> str:
    """Name under which executors find the compiled lexicon of at most ``words`` words (SparkFiles)."""
    spark = texts.sparkSession
    ranks = load_ranks(vocabulary)
    rows = frequent_words(texts, column, words).collect()  # bounded by ``words``
    data = compile_lexicon([(raw := r["word"].encode(), merge_word(raw, ranks)) for r in rows])
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:16]}-{Scratch(spark, 'x').root[-8:]}.bin"
    path = f"{Scratch(spark, 'lexicon').root}/{name}"
    write_bytes(spark, path, data)
    spark.sparkContext.addFile(path)
    return name


def encode_column(texts: DataFrame, key: str, column: str, vocabulary: str | None = None, words: int = LEXICON_WORDS, only_count: bool = False) -> DataFrame:
    """(key, ids) or, with ``only_count``, (key, tokens), one row for each row of ``texts``.

    - a null and an empty text have no ids (an empty list, 0 tokens); a blank text has the ids of its
      blanks, like any text; strings of special tokens are ordinary text;
    - unpaired surrogates cannot come from Parquet strings; repeated keys keep their rows;
    - an empty table gives an empty result; words outside the lexicon are merged exactly, whatever their length.
    """
    vocabulary = vocabulary or vocabulary_path()
    source = spread(texts.select(F.col(key).alias("k"), F.col(column).alias("t")))
    name = build_lexicon(source, "t", vocabulary, words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _loaded:
            _loaded[name] = Encoder(SparkFiles.get(name), vocabulary)
        encode = _loaded[name].encode
        for batch in batches:
            found = [encode(t) if t else [] for t in batch.column(1).to_pylist()]
            made = pa.array([len(x) for x in found], pa.int32()) if only_count else pa.array(found, pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), made], ["k", "v"])

    kind = source.schema["k"].dataType.simpleString()
    return source.mapInArrow(run, f"k {kind}, v {'int' if only_count else 'array<int>'}").toDF(key, "tokens" if only_count else "ids")
