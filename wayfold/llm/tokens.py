"""Token ids by a public tokenizer file, cut into pieces of a sequence's length.

The tokenizer's file treats white space only as a border and lower-cases, so a text's ids are
those of its white-space-delimited parts end to end, A-Z lower-cased. A process encodes a part
that it still remembers only once.
"""

from __future__ import annotations

import os
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wayfold.llm.common import WordCache, gathered, gathered_ranges, released, slices, small_batches, stored, string_bytes, word_codes
from wayfold.llm.packing import ordinals, packed

CAPACITY = 4096
END_ID = 1
#: Plain words in one string, and strings encoded by one call: an encoding keeps much more than its ids.
JOINED, ENCODED = 128, 64
#: Words that normal forms and lower-casing leave one run of letters and one of punctuation.
PLAIN = r"^[A-Za-z\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{FF}]+[!-/:-@\[-`{-~]*$"
MARKS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLOSED = r"[!-/:-@\[-`{-~]$"

_TOKENIZERS: dict = {}
_ENDS: dict[str, np.ndarray] = {}
_CACHES: dict[str, WordCache] = {}


def tokenizer(path: str):
    """The tokenizer of a file, loaded once in a process; one thread, as tasks already fill the cores."""
    if path not in _TOKENIZERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        _TOKENIZERS[path] = Tokenizer.from_file(path)
    return _TOKENIZERS[path]


def id_bytes(path: str) -> int:
    """2 if all ids of the tokenizer fit in 16 bits, else 4."""
    return 2 if tokenizer(path).get_vocab_size() <= 1 << 16 else 4


def _encoded(words: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of distinct words end to end, and their bounds.

    Words of plain letters and closing punctuation are encoded many to a string, as an
    encoding object costs more than a word: each of their one or two parts ends in one token
    that the vocabulary marks as a word's end. All others are encoded on their own.
    """
    array = pa.array(words, pa.string())
    plain = pc.match_substring_regex(array, PLAIN).to_numpy(zero_copy_only=False)
    parts = 1 + pc.match_substring_regex(array, CLOSED).to_numpy(zero_copy_only=False)[plain].astype(np.int64)
    lines = array.filter(pa.array(plain)).to_pylist()
    flat = _ids([" ".join(lines[at : at + JOINED]) for at in range(0, len(lines), JOINED)], path)[0]
    ends = np.flatnonzero(_word_ends(path)[flat]) + 1
    if len(ends) != parts.sum():  # a vocabulary of another kind
        plain, flat, ends, parts = np.zeros(len(words), bool), flat[:0], ends[:0], parts[:0]
    own, lengths = _ids(array.filter(pa.array(~plain)).to_pylist(), path)
    sizes = np.concatenate((np.diff(ends[np.cumsum(parts) - 1], prepend=0), lengths)).astype(np.int64)
    place = np.empty(len(words), np.int64)
    place[np.concatenate((np.flatnonzero(plain), np.flatnonzero(~plain)))] = np.arange(len(words))
    at, bounds = gathered(np.concatenate(([0], np.cumsum(sizes))), place)
    return np.concatenate((flat, own))[at], bounds


def _ids(strings: list[str], path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of strings end to end, and each string's number."""
    own, lengths, flat = tokenizer(path), [], [np.zeros(0, np.uint32)]
    for start in range(0, len(strings), ENCODED):
        made = [x.ids for x in own.encode_batch_fast(strings[start : start + ENCODED], add_special_tokens=False)]
        lengths += map(len, made)
        flat.append(np.fromiter(chain.from_iterable(made), np.uint32))
    return np.concatenate(flat), np.array(lengths, np.int64)


def _word_ends(path: str) -> np.ndarray:
    """Whether each id's token ends a word."""
    if path not in _ENDS:
        vocabulary = tokenizer(path).get_vocab()
        _ENDS[path] = np.zeros(max(vocabulary.values()) + 1, bool)
        _ENDS[path][[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return _ENDS[path]


def text_ids(texts: pa.Array, path: str, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """All texts' ids (unsigned 32 bits) end to end, each text's followed by end_id, and their bounds."""
    special = pc.any(pc.match_substring(texts, "<|")).as_py()  # special tokens in a text are told by case
    vocabulary, codes, bounds = word_codes(texts if special else pc.ascii_lower(texts))
    if path not in _CACHES:
        _CACHES[path] = WordCache(lambda words: _encoded(words, path))
    cache = _CACHES[path]
    # a plain word's letters and closing punctuation are parts of their own: letters recur far more often
    stems = pc.if_else(pc.match_substring_regex(vocabulary, PLAIN), pc.ascii_rtrim(vocabulary, MARKS), vocabulary)
    tails = _tails(vocabulary, stems)
    coded = [x.dictionary_encode() for x in (stems, tails)]
    words = [*coded[0].dictionary.to_pylist(), *coded[1].dictionary.to_pylist()]
    row = cache.rows(words)
    both = np.stack((row[coded[0].indices.to_numpy()], row[len(coded[0].dictionary) :][coded[1].indices.to_numpy()]), axis=1).ravel() if len(vocabulary) else np.zeros(0, np.int64)
    index, ends = gathered(cache.bounds, both)
    own = np.append(cache.values[index] if len(index) else np.zeros(0, np.uint32), np.uint32(end_id))
    word_bounds = np.append(ends[::2], ends[-1] + 1)
    index, ends = gathered(word_bounds, np.insert(codes, bounds[1:], len(vocabulary)))
    return own[index], ends[bounds + np.arange(len(bounds))]


def _tails(words: pa.Array, stems: pa.Array) -> pa.Array:
    """What each word has beyond its stem."""
    raw, at = string_bytes(words)
    lengths = pc.binary_length(stems).to_numpy().astype(np.int64)
    index, bounds = gathered_ranges(at[:-1] + lengths, at[1:])
    return pa.StringArray.from_buffers(len(words), pa.py_buffer(bounds.astype(np.int32)), pa.py_buffer(raw[index]))


def pieces(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, ranked: bool = False) -> DataFrame:
    """(key, piece, start, length, ids_crc32[, ids][, _part, _ordinal]): every text's ids and end_id, in pieces of at most capacity.

    Only texts of more than capacity ids are cut, losslessly: all pieces but the last are full.
    Null texts are as empty: one piece that holds end_id alone. Rows with null keys and
    repeated rows each get their pieces. Other columns of docs are not read. ids are little-endian
    unsigned integers of id_bytes(path) bytes; _ordinal numbers the pieces of one length in a
    task, _part is the task's number (both hold once the rows are written).
    """
    small_batches(docs.sparkSession)
    kind = dict(docs.dtypes)[key]

    def run(batches):
        task, seen = TaskContext.get(), {}
        for part in slices(batches, "text"):
            ids, bounds = text_ids(part.column("text"), path, end_id)
            counts = -(-np.diff(bounds) // capacity)
            row = np.repeat(np.arange(len(counts)), counts)
            piece = np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(bounds)[row] - start)
            at = bounds[row] + start
            crc = [zlib.crc32(ids[a : a + n]) for a, n in zip(at.tolist(), length.tolist(), strict=True)]
            columns = [part.column("key").take(pa.array(row)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
            names = ["key", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns.append(pa.array([ids[a : a + n].astype(f"<u{width}").tobytes() for a, n in zip(at.tolist(), length.tolist(), strict=True)], pa.binary()))
                names.append("ids")
            if ranked:
                columns += [pa.array(np.full(len(length), task.partitionId(), np.int32)), pa.array(ordinals(length.tolist(), seen), pa.int64())]
                names += ["_part", "_ordinal"]
            yield pa.RecordBatch.from_arrays(columns, names=names)
        released()

    schema = f"key {kind}, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids + ", _part int, _ordinal long" * ranked
    width = id_bytes(path)
    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def packed_texts(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """pieces() of every text, packed by linear grouping; they are written and reread, so their numbers hold."""
    return packed(stored(pieces(docs, path, key, text, capacity, ranked=True), "pieces"), capacity=capacity)
