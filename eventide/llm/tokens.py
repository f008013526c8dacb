"""Encoding of a corpus with a public byte-level BPE (problem 8).

Byte-level BPE never merges across pre-tokens ("words"), so a corpus needs
each distinct word encoded once:

1. one pass cuts every text into words and writes them, a block of some
   BLOCK_WORDS positions at a time: the block's distinct words, numbered, and
   per text the numbers of its words in order of position;
2. the blocks' word lists are exploded with their numbers; the distinct words
   of the corpus are shuffled, and each is encoded once;
3. the ids are joined back by word and brought to their block, where texts are
   reassembled by position.

Scale: a word crosses the network once per block and not once per occurrence,
so the most frequent word is no hot key; a text's positions travel as one
array of small numbers.  A block is bounded but for a single text longer than
it.  Nothing is collected or broadcast by hand, and no text is cut twice.

Decoding goes the same way: a block's distinct tokens are exploded with their
numbers, joined to the token-byte table, whose size is that of the vocabulary
file, and the bytes put back by position.

Defined results: null, empty texts give an empty list; blank texts their
white-space tokens; repeated rows each get their row; texts of any length are
encoded whole; special-token strings in a text are ordinary text; an empty
table gives no rows; a text that is no valid Unicode cannot occur in a string
column; of the caller's columns only the key is kept, so no name can clash.
"""

from __future__ import annotations

import base64
import functools
import re
import unicodedata
from array import array
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventide.runtime import stage

BLOCK_WORDS = 1 << 20
# Below this code point the character classes of all Unicode versions agree.
_STABLE_END = 0x530
# The pre-tokenizer's pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


@functools.lru_cache(maxsize=4)
def _vocabulary(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.lru_cache(maxsize=4)
def _encoder(path: str):
    import tiktoken

    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=_vocabulary(path), special_tokens={})


def _ranges(kind: str) -> str:
    """Character-class text of the stable code points of a general category."""
    return "".join(re.escape(chr(c)) for c in range(_STABLE_END) if unicodedata.category(chr(c))[0] == kind)


@functools.lru_cache(maxsize=1)
def _cutters():
    """Words of a stable text, whether a text is stable, and the tokenizer's own cutter for the others."""
    from tokenizers import pre_tokenizers

    letter, number, space = _ranges("L"), _ranges("N"), r"\t-\r \x85\xa0"
    named = {r"\p{L}": f"[{letter}]", r"\p{N}": f"[{number}]", r"[^\s\p{L}\p{N}]": f"[^{space}{letter}{number}]", r"\S": f"[^{space}]", r"\s": f"[{space}]"}
    plain = re.sub(r"\[\^\\s\\p\{L\}\\p\{N\}\]|\\p\{[LN]\}|\\[sS]", lambda m: named[m.group()], PATTERN)
    return re.compile(plain).findall, re.compile(f"[\\x00-{chr(_STABLE_END - 1)}]*+").fullmatch, pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=True)


def cut(text: str) -> list[str]:
    """Words of a text; their concatenation is the text."""
    words, stable, exact = _cutters()
    if stable(text):
        return words(text)
    # newer letters: the tokenizer's own classes decide
    return [text[a:b] for _, (a, b) in exact.pre_tokenize_str(text)]


class _Numbers(dict):
    """Numbers its keys in order of first use."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


_BLOCK = ["__block", "__words", "__size", "__at"]
_BLOCK_SCHEMA = "__block bigint, __words array<{}>, __size tinyint, __at binary"


def _block_columns(block: int, words: pa.Array, at: np.ndarray, ends: np.ndarray, null: np.ndarray | None = None) -> list[pa.Array]:
    """Columns _BLOCK of a block: per row its word numbers as bytes, two a number where the block's words allow, and a last row with the words."""
    n, size = len(ends) - 1, 2 if len(words[0]) <= 1 << 16 else 4
    data = at.astype(f"<u{size}").tobytes()
    offsets = (ends * size).astype(np.int64)
    places = pa.LargeBinaryArray.from_buffers(pa.large_binary(), n, [None if null is None else pa.array(~null).buffers()[1], pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)]).cast(pa.binary())
    return [pa.array([block] * (n + 1), pa.int64()), pa.concat_arrays([pa.nulls(n, words.type), words]), pa.array([size] * n + [None], pa.int8()), pa.concat_arrays([places, pa.nulls(1, pa.binary())])]


def _cut_batches(carry: Sequence[str], block_words: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            kept = batch.select(list(carry))
            texts = batch.column("text").to_pylist()
            start = 0
            while start < len(texts):
                numbers, flat, ends = _Numbers(), array("i"), [0]
                for text in texts[start:]:
                    if text:
                        flat.extend(map(numbers.__getitem__, cut(text)))
                    ends.append(len(flat))
                    if len(flat) >= block_words:
                        break
                n = len(ends) - 1
                words = pa.array([list(numbers)], pa.list_(pa.string()))
                columns = [pa.concat_arrays([kept.column(c).slice(start, n), pa.nulls(1, kept.column(c).type)]) for c in carry]
                columns += _block_columns(block, words, np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32), np.array(ends))
                yield pa.RecordBatch.from_arrays(columns, [*carry, *_BLOCK])
                block += 1
                start += n

    return run


def _blocks(rows: DataFrame, carry: Sequence[str]) -> DataFrame:
    """Staged table: per text its carried columns, __block and __at (numbers of its words); per block one row with __words."""
    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in carry)
    return stage(rows.select(*carry, "text").mapInArrow(_cut_batches(carry, BLOCK_WORDS), f"{kinds}, {_BLOCK_SCHEMA.format('string')}"))


def _coded(blocks: DataFrame, path: str) -> DataFrame:
    """(__b, __k, __ids): the ids of every word of every block; each distinct word of the corpus is encoded once."""

    def encode_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bpe = _encoder(path)
        for batch in batches:
            yield pd.DataFrame({"__word": batch["__word"], "__ids": [bpe.encode_ordinary(w) for w in batch["__word"]]})

    words = blocks.where("__words is not null").select("__block", F.posexplode("__words").alias("__k", "__word"))
    distinct = words.groupBy("__word").agg(F.lit(1).alias("one")).select("__word")
    return words.join(distinct.mapInPandas(encode_words, "__word string, __ids array<int>"), "__word").select(F.col("__block").alias("__b"), "__k", "__ids")


def _by_number(coded: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(number of ids of each word, all their ids) of a block in order of word number."""
    lists = coded.sort_by("__k").column("__ids").combine_chunks()
    return np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy()


def _positions(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(word numbers of all texts of a block, where each text ends)."""
    rows = table.column("__at").combine_chunks().cast(pa.large_binary())
    size = next((x for x in table.column("__size").to_pylist() if x), 2)
    offsets = np.frombuffer(rows.buffers()[1], np.int64)[rows.offset : rows.offset + len(rows) + 1]
    data = rows.buffers()[2]
    at = np.frombuffer(data, f"<u{size}", (offsets[-1] - offsets[0]) // size, offsets[0]) if data is not None and len(offsets) else np.zeros(0, np.uint16)
    return at.astype(np.int64), (offsets - offsets[0]) // size


def _reassemble(blocks: DataFrame, coded: DataFrame, carry: Sequence[str], out: str, kind: str, fill: Callable[[pa.Table, pa.Table], pa.Array]) -> DataFrame:
    """Carried columns and ``out`` of every text, ``fill`` making a block's values from its texts and its coded words (__b, ..)."""
    texts = blocks.where("__words is null").select(*carry, "__block", "__size", "__at")

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        return pa.table([*[left.column(c) for c in carry], fill(left, right)], names=[*carry, out])

    schema = ", ".join(f"`{c}` {blocks.schema[c].dataType.simpleString()}" for c in carry) + f", {out} {kind}"
    return texts.groupBy("__block").cogroup(coded.groupBy("__b")).applyInArrow(one, schema)


def _encoded(rows: DataFrame, carry: Sequence[str], path: str, kind: str, fill: Callable[[pa.Table, pa.Table], pa.Array]) -> DataFrame:
    blocks = _blocks(rows, carry)
    return _reassemble(blocks, _coded(blocks, path), carry, "__out", kind, fill)


def _fill_ids(texts: pa.Table, coded: pa.Table) -> pa.Array:
    at, ends = _positions(texts)
    lengths, ids = _by_number(coded) if coded.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    n = lengths[at]
    stop = np.cumsum(n, dtype=np.int64)
    # each output place: its word's first id, plus how far into the word it is
    first = (np.cumsum(lengths, dtype=np.int64) - lengths)[at]
    values = ids[np.repeat(first - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)]
    offsets = np.concatenate([[0], stop])[ends]
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _fill_counts(texts: pa.Table, coded: pa.Table) -> pa.Array:
    at, ends = _positions(texts)
    lengths = _by_number(coded)[0] if coded.num_rows else np.zeros(0, np.int64)
    stop = np.concatenate([[0], np.cumsum(lengths[at], dtype=np.int64)])
    return pa.array(np.diff(stop[ends]), pa.int64())


def encode(df: DataFrame, key: str, text: str, path: str | None = None, out: str = "ids") -> DataFrame:
    """(key, ids) of every row of ``df``."""
    rows = df.select(F.col(key).alias("key"), F.col(text).alias("text"))
    return _encoded(rows, ["key"], path or default_path(), "array<int>", _fill_ids).select(F.col("key").alias(key), F.col("__out").alias(out))


def count(df: DataFrame, text: str, path: str | None = None, out: str = "n_tokens") -> DataFrame:
    """The columns of ``df`` but ``text``, which ``out`` replaces: the number of its tokens. No ids move to the texts, only their numbers."""
    carry = [c for c in df.columns if c not in (text, out)]
    rows = df.select(*[F.col(c).alias(f"c{i}") for i, c in enumerate(carry)], F.col(text).alias("text"))
    counted = _encoded(rows, [f"c{i}" for i in range(len(carry))], path or default_path(), "bigint", _fill_counts)
    return counted.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(carry)], F.col("__out").alias(out))


def token_bytes(spark, path: str | None = None) -> DataFrame:
    """(token, bytes) of every token of a vocabulary file."""
    return spark.createDataFrame([(i, bytearray(b)) for b, i in _vocabulary(path or default_path()).items()], "token int, bytes binary")


def _token_batches(block_tokens: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of rows of ids, like those of texts: distinct tokens as __words, places as __at; null ids have null places."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = TaskContext.get().partitionId() << 33
        for batch in batches:
            keys, lists = batch.column("key"), batch.column("ids")
            ends = np.cumsum(lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))
            start = 0
            while start < len(lists):
                n = max(1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + block_tokens, "right")) - start)
                part = lists.slice(start, n)
                tokens, at = np.unique(part.flatten().to_numpy(), return_inverse=True)
                null = np.asarray(part.is_null())
                sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
                columns = _block_columns(block, pa.array([tokens.tolist()], pa.list_(pa.int32())), at, np.concatenate([[0], np.cumsum(sizes)]), null)
                yield pa.RecordBatch.from_arrays([pa.concat_arrays([keys.slice(start, n), pa.nulls(1, keys.type)]), *columns], ["key", *_BLOCK])
                block += 1
                start += n

    return run


def _fill_bytes(texts: pa.Table, coded: pa.Table) -> pa.Array:
    at, ends = _positions(texts)
    held = coded.sort_by("__k").column("__bytes").to_pylist() if coded.num_rows else []
    if None in held:
        raise ValueError("id outside the vocabulary")
    data, length = np.frombuffer(b"".join(held), np.uint8), np.array([len(x) for x in held], np.int64)
    n = length[at] if len(at) else np.zeros(0, np.int64)
    stop = np.cumsum(n)
    first = (np.cumsum(length) - length)[at] if len(at) else n
    whole = data[np.repeat(first - (stop - n), n) + np.arange(stop[-1] if len(stop) else 0)].tobytes()
    places = np.concatenate([[0], stop])[ends].tolist()
    null = texts.column("__at").is_null().to_pylist()
    return pa.array([None if gone else whole[a:b].decode("utf-8", "replace") for gone, a, b in zip(null, places, places[1:])], pa.string())


def decode(df: DataFrame, key: str, ids: str = "ids", path: str | None = None, out: str = "text") -> DataFrame:
    """(key, text) of rows of ids, equal rows each theirs; null ids give null, ids outside the vocabulary are an error."""
    rows = df.select(F.col(key).alias("key"), F.col(ids).cast("array<int>").alias("ids"))
    kind = rows.schema["key"].dataType.simpleString()
    blocks = stage(rows.mapInArrow(_token_batches(BLOCK_WORDS), f"key {kind}, {_BLOCK_SCHEMA.format('int')}"))
    asked = blocks.where("__words is not null").select(F.col("__block").alias("__b"), F.posexplode("__words").alias("__k", "token"))
    known = asked.join(token_bytes(df.sparkSession, path), "token", "left").select("__b", "__k", F.col("bytes").alias("__bytes"))
    return _reassemble(blocks, known, ["key"], "__out", "string", _fill_bytes).select(F.col("key").alias(key), F.col("__out").alias(out))
