"""Language identification by prediction by partial matching (PPM).

One variable-order byte context tree for each language, to a depth of ORDER bytes, kept as
two sorted key tables: (context, symbol) with its code length, and context with the code
length of an escape. Statistics are frozen after learning. Escape probabilities follow method C
(distinct / (total + distinct)), without exclusion; below order zero all 256 bytes are as likely.

A text is coded as its words (maximal runs between ASCII white space, lower-cased), each followed
by one space, in contexts that go on across words; a space before the first is context only. From
a word's fourth byte on, contexts lie inside ' word ', so those code lengths are computed once for
a distinct word of a slice; those of its first three bytes (HEAD) depend on the three bytes before
the space, and are computed once for a distinct joint of both. Their sum is the text's exact code length.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wayfold.llm.common import TEXTS_A_TASK, annotated, gathered, per_row, slices, string_bytes, word_codes

#: Longest context in bytes; first bytes of a word whose contexts reach beyond the space before it.
ORDER, HEAD = 4, 3
#: Distinct texts learned from, for each language, and languages learned, those with most texts (documented bounds of the sample).
SAMPLE_PER_LANG, MOST_LANGUAGES = 600, 200
#: Distinct words that one coding pass takes at once; bounds memory.
WORDS_AT_ONCE = 25_000
#: Bytes of the table of whole code lengths at most; without it each context's escapes are added up.
TABLE_BYTES = 128 << 20
#: Bytes of text over which a score compares code lengths.
SCORED_BYTES = 16
UNDETERMINED = "und"

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def _spaced(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of ' word ' for all words end to end, and their bounds."""
    return string_bytes(pc.binary_join_element_wise(" ", words, " ", "") if len(words) else words)


def _keys(raw: np.ndarray, at: np.ndarray, depth: np.ndarray, order: int) -> list[np.ndarray]:
    """The context key of the bytes at `at` for each order, where depth bytes or more come before.

    A key holds the order in its top byte and the context's bytes below; 0 where a context is too long.
    """
    wide = raw.astype(np.uint64)
    keys, key = [np.zeros(len(at), np.uint64)], np.zeros(len(at), np.uint64)
    for k in range(1, order + 1):
        ok = depth >= k
        key = np.where(ok, key | (wide[np.maximum(at - k, 0)] << np.uint64(8 * (k - 1))), key)
        keys.append(np.where(ok, key | np.uint64(k << 56), np.uint64(0)))
    return keys


def symbol_counts(texts: pa.Array, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """(context, symbol) keys of whole texts' streams ' word word ... ', and how often each occurs."""
    vocabulary, codes, bounds = word_codes(pc.utf8_lower(texts))
    raw, ends = string_bytes(pc.binary_join_element_wise(vocabulary, " ", "") if len(vocabulary) else vocabulary)
    starts = np.append(raw, 32).astype(np.uint8), np.append(ends, len(raw) + 1)  # one more segment: the opening space
    full = bounds[1:] > bounds[:-1]
    index, at = gathered(starts[1], np.insert(codes, bounds[:-1][full], len(vocabulary)))
    stream = starts[0][index]
    first = at[bounds[:-1][full] + np.arange(int(full.sum()))]  # each text's opening space
    depth = np.arange(len(stream)) - np.repeat(first, np.diff(np.append(first, len(stream))))
    coded = np.flatnonzero(depth > 0)
    found = []
    for k, key in enumerate(_keys(stream, coded, depth[coded], order)):
        ok = depth[coded] >= k
        found.append(np.unique((key[ok] << np.uint64(8)) | stream[coded][ok] | np.uint64(k << 56), return_counts=True))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


@dataclass
class ContextTrees:
    """Frozen statistics of all languages; the rows of the matrices are languages' columns."""

    languages: list[str]
    order: int
    symbol_keys: np.ndarray
    symbol_bits: np.ndarray
    context_keys: np.ndarray
    escape_bits: np.ndarray

    @classmethod
    def learn(cls, counts: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER) -> ContextTrees:
        """counts: of each language, distinct symbol_counts() keys and their numbers."""
        languages = sorted(counts)
        symbol_keys = np.unique(np.concatenate([counts[x][0] for x in languages])) if languages else np.zeros(0, np.uint64)
        tops = (symbol_keys >> np.uint64(56)) << np.uint64(56)
        of_context = ((symbol_keys & np.uint64((1 << 56) - 1)) >> np.uint64(8)) | tops
        context_keys, parent = np.unique(of_context, return_inverse=True)
        symbol_bits = np.full((len(symbol_keys), len(languages)), np.inf, np.float32)
        escape_bits = np.zeros((len(context_keys), len(languages)), np.float32)
        for n, language in enumerate(languages):
            count = np.zeros(len(symbol_keys))
            count[np.searchsorted(symbol_keys, counts[language][0])] = counts[language][1]
            total = np.bincount(parent, count, len(context_keys))
            distinct = np.bincount(parent, count > 0, len(context_keys))
            seen = count > 0
            symbol_bits[seen, n] = -np.log2(count[seen] / (total + distinct)[parent[seen]])
            known = total > 0
            escape_bits[known, n] = -np.log2(distinct[known] / (total + distinct)[known])
        return cls(languages, order, symbol_keys, symbol_bits, context_keys, escape_bits)

    def bits(self, raw: np.ndarray, at: np.ndarray, depth: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """Code lengths of the bytes at `at` in each language, in bits, summed by owner; depth bytes come before each."""
        n = len(self.languages)
        if not len(self.context_keys):
            return np.repeat(8.0 * np.bincount(owner, minlength=owners)[:, None], n, axis=1)
        code, older, symbol_row, whole = self._tables()
        coded, node = code[raw], np.zeros(len(at), np.int64)  # the empty context is the first key
        rows, path = np.arange(len(at)), []
        for k in range(self.order + 1):  # to each byte's deepest known context
            path.append((rows, node[rows]))
            rows = rows[depth[rows] > k]
            deeper = older[node[rows], coded[at[rows] - k - 1]]
            known = deeper >= 0
            rows = rows[known]
            node[rows] = deeper[known]
        if whole is not None:
            made = whole[node, coded[at]]
        else:
            made = np.full((len(at), n), 8, np.float32)
            for rows, own in path:  # from the empty context up: an escape and what is below, or the symbol
                found = symbol_row[own, coded[at[rows]]]
                made[rows] += self.escape_bits[own]
                hit = found >= 0
                symbol = self.symbol_bits[found[hit]]
                made[rows[hit]] = np.where(np.isinf(symbol), made[rows[hit]], symbol)
        return np.stack([np.bincount(owner, made[:, i], owners) for i in range(n)], axis=1)

    def tail_bits(self, words: pa.Array) -> np.ndarray:
        """Code length of each 'word ' from its fourth byte on, whose contexts begin at the space before it."""
        out = np.zeros((len(words), len(self.languages)))
        for start in range(0, len(words), WORDS_AT_ONCE):
            part = words.slice(start, WORDS_AT_ONCE)
            raw, bounds = _spaced(part)
            lengths = np.diff(bounds)
            depth = np.arange(len(raw)) - np.repeat(bounds[:-1], lengths)
            at = np.flatnonzero(depth > HEAD)
            out[start : start + len(part)] = self.bits(raw, at, depth[at], np.repeat(np.arange(len(lengths)), lengths)[at], len(part))
        return out

    def joint_bits(self, joints: np.ndarray) -> np.ndarray:
        """Code length of each joint's head (see _joints)."""
        out = np.zeros((len(joints), len(self.languages)))
        for start in range(0, len(joints), WORDS_AT_ONCE):
            part = joints[start : start + WORDS_AT_ONCE]
            heads, tails = (part >> 26) & 3, (part >> 24) & 3
            raw = np.zeros((len(part), 2 * HEAD + 1), np.uint8)
            for i in range(HEAD):
                raw[:, i] = (part >> (8 * (HEAD - 1 - i))) & 255
                raw[:, HEAD + 1 + i] = (part >> (28 + 8 * (HEAD - 1 - i))) & 255
            raw[:, HEAD] = 32
            row, place = np.nonzero(np.arange(HEAD)[None, :] < heads[:, None])
            out[start : start + len(part)] = self.bits(raw.ravel(), row * raw.shape[1] + HEAD + 1 + place, tails[row] + 1 + place, row, len(part))
        return out

    def _tables(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray | None]:
        """Bytes as small codes; by (context, code) the context with that byte before it, and the symbol's row, -1 for none;
        and by (context, code) the whole code length with all escapes, where that table is not above TABLE_BYTES."""
        if "_dense" not in self.__dict__:
            low = np.uint64((1 << 56) - 1)
            order = (self.context_keys >> np.uint64(56)).astype(np.int64)
            used = np.unique((self.symbol_keys & np.uint64(255)).astype(np.int64))
            head = np.maximum(8 * (order - 1), 0).astype(np.uint64)
            first = ((self.context_keys >> head) & np.uint64(255)).astype(np.int64)  # the oldest byte of each context
            used = np.unique(np.concatenate((used, first[order > 0])))
            code = np.full(256, len(used), np.int64)
            code[used] = np.arange(len(used))
            older = np.full((len(self.context_keys), len(used) + 1), -1, np.int32)
            symbol_row = older.copy()
            deep = np.flatnonzero(order > 0)
            parent = (self.context_keys[deep] & ((np.uint64(1) << head[deep]) - np.uint64(1))) | ((order[deep] - 1).astype(np.uint64) << np.uint64(56))
            older[np.searchsorted(self.context_keys, parent), code[first[deep]]] = deep
            tops = (self.symbol_keys >> np.uint64(56)) << np.uint64(56)
            context = np.searchsorted(self.context_keys, ((self.symbol_keys & low) >> np.uint64(8)) | tops)
            symbol_row[context, code[(self.symbol_keys & np.uint64(255)).astype(np.int64)]] = np.arange(len(self.symbol_keys))
            whole = None
            if symbol_row.size * len(self.languages) * 4 <= TABLE_BYTES:
                whole = np.full((*symbol_row.shape, len(self.languages)), 8, np.float32)
                below = np.full(len(order), -1)
                below[deep] = np.searchsorted(self.context_keys, parent)
                for k in range(self.order + 1):
                    own = np.flatnonzero(order == k)
                    whole[own] = (whole[below[own]] if k else np.float32(8)) + self.escape_bits[own][:, None, :]
                    row, column = np.nonzero(symbol_row[own] >= 0)
                    symbol = self.symbol_bits[symbol_row[own[row], column]]
                    whole[own[row], column] = np.where(np.isinf(symbol), whole[own[row], column], symbol)
            self._dense = code, older, symbol_row, whole
        return self._dense


def _joints(vocabulary: pa.Array, codes: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Of each word of the texts: the up to three bytes before the space before it, and its own first three, as one number.

    Layout, from the top: three bytes of the head, two bits its length (the closing space counts),
    two bits the tail's length, three bytes of the tail.
    """
    raw, ends = string_bytes(vocabulary)
    size = np.diff(ends)
    padded = np.concatenate((np.full(HEAD, 32, np.uint8), raw, np.full(HEAD, 32, np.uint8))).astype(np.int64)
    head = np.zeros(len(size), np.int64)
    for i in range(HEAD):
        head = (head << 8) | np.where(i < size, padded[HEAD + ends[:-1] + i], np.where(i == size, 32, 0))
    head = (head << 2) | np.minimum(size + 1, HEAD)
    last = [padded[HEAD + ends[1:] - 1 - i] for i in range(HEAD)]  # last[0] is a word's last byte
    before, first = np.concatenate((codes[:1], codes[:-1])), np.zeros(len(codes), bool)
    first[bounds[:-1][bounds[1:] > bounds[:-1]]] = True
    second = np.concatenate(([False], first[:-1])) & ~first
    older = np.concatenate((before[:1], before[:-1]))
    length, one, two, three = size[before], last[0][before], last[1][before], last[2][before]
    tail = (three << 16) | (two << 8) | one
    tail = np.where(length == 2, (32 << 16) | (two << 8) | one, tail)  # the space before a short word, and what came before that
    tail = np.where(length == 1, (last[0][older] << 16) | (32 << 8) | one, tail)
    tail = np.where(second & (length == 1), (32 << 8) | one, tail)
    count = np.where(second & (length == 1), 2, HEAD)
    tail, count = np.where(first, 0, tail), np.where(first, 0, count)
    return (head[codes] << 26) | (count << 24) | tail


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", order: int = ORDER, per_lang: int = SAMPLE_PER_LANG, most_languages: int = MOST_LANGUAGES) -> ContextTrees:
    """Learn from at most per_lang distinct texts of each of the most_languages languages with most rows.

    Rows with null text or lang are left out; of languages with as many rows those first by name
    count. Texts are drawn by their own hash, and equal texts of a language count once, so neither
    a language nor a text that holds most rows makes the sample larger or a hot task. Whole texts are
    counted, on the executors; the driver gets the sample's context counts. An empty table teaches nothing.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("text is not null and lang is not null")
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.approx_count_distinct("text").alias("n"), F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "lang").limit(most_languages).collect()}
    if not counts:
        return ContextTrees.learn({}, order)
    hashed = rows.withColumn("_h", F.xxhash64(F.lit(17), F.col("text")))
    rate = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, 2 * (per_lang + 32) / max(1, n)))])
    drawn = hashed.filter(F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30)) < F.coalesce(rate[F.col("lang")], F.lit(0.0)))
    once = drawn.groupBy("lang", "_h").agg(F.min("text").alias("text"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("_h"))
    chosen = once.withColumn("_r", place).filter(F.col("_r") <= per_lang).select("lang", "text").repartition(1 + len(counts) * per_lang // TEXTS_A_TASK)

    def count(batches):
        for batch in batches:
            for part in slices([batch], "text"):
                names = part.column("lang").dictionary_encode()
                for n, name in enumerate(names.dictionary.to_pylist()):
                    keys, numbers = symbol_counts(part.column("text").filter(pc.equal(names.indices, n)), order)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(keys), pa.string()), pa.array(keys.view(np.int64)), pa.array(numbers, pa.int64())], names=["lang", "key", "n"])

    table = chosen.mapInArrow(count, "lang string, key long, n long").groupBy("lang", "key").agg(F.sum("n").alias("n")).toArrow()
    names = table["lang"].combine_chunks().dictionary_encode()
    code, keys, numbers = names.indices.to_numpy(), table["key"].to_numpy().view(np.uint64), table["n"].to_numpy()
    return ContextTrees.learn({name: (keys[code == n], numbers[code == n]) for n, name in enumerate(names.dictionary.to_pylist())}, order)


def code_lengths(trees: ContextTrees, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Exact code length of each whole text in each language, in bits, and the number of bytes coded."""
    vocabulary, codes, bounds = word_codes(pc.utf8_lower(texts))
    if not len(codes):
        return np.zeros((len(texts), len(trees.languages))), np.zeros(len(texts))
    joints, which = np.unique(_joints(vocabulary, codes, bounds), return_inverse=True)
    tails, heads = trees.tail_bits(vocabulary), trees.joint_bits(joints)
    total = per_row(tails[codes] + heads[which], bounds)
    return total, per_row(pc.binary_length(vocabulary).to_numpy().astype(np.int64)[codes] + 1, bounds)


def score_texts(trees: ContextTrees, texts: pa.Array) -> tuple[list[str], np.ndarray]:
    """Of each text: the language with the shortest code (ties: first by name), and its score.

    The score is that language's share of 2^-bits over SCORED_BYTES bytes of average code length, so
    it doesn't go to 1 with the text's length: two languages that code a text alike get half each.
    """
    letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    known = letters & (len(trees.languages) > 0)
    labels, scores = np.full(len(texts), UNDETERMINED, object), np.zeros(len(texts))
    if not known.any():  # a text with a letter has a word
        return labels.tolist(), scores
    total, size = code_lengths(trees, texts)
    best = total.argmin(axis=1)
    over = (total - total.min(axis=1, keepdims=True)) * (np.minimum(SCORED_BYTES, size) / np.maximum(size, 1))[:, None]
    labels[known] = np.array(trees.languages, object)[best[known]]
    scores[known] = (1 / np.exp2(-over).sum(axis=1))[known]
    return labels.tolist(), scores


def identify(docs: DataFrame, trees: ContextTrees, text: str = "text") -> DataFrame:
    """docs with lang_pred and score, for every row and its whole text; no shuffle.

    Null text, or none of its characters a letter: lang_pred 'und', score 0; likewise if no
    language was learned. Columns of docs named lang_pred or score are replaced; all other
    columns stay. Repeated rows each get the same answer. Languages that code a text alike are
    told by name. A text of any length is one vocabulary of its own; words are coded WORDS_AT_ONCE
    at a time. No rows in: no rows out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)
    return annotated(docs, text, FIELDS, lambda texts: list(score_texts(shared.value, texts)))


def held_out(column: str = "doc_id", folds: int = 4, fold: int = 2):
    """Whether crc32 of the id as text falls in the fold that learning never sees; null ids do not."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))


__all__ = ["ContextTrees", "code_lengths", "fit", "held_out", "identify", "score_texts", "symbol_counts"]
