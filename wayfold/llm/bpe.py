"""Byte-level BPE over rank files: padded numpy matrices, merged round by round.

A text's pieces are the matches of the tokenizer's pattern. White-space-plus-word segments
hold whole matches, so each process splits and encodes a segment that it still remembers only
once. Distinct pieces are bucketed by length into padded matrices of ids; each round looks up
the ranks of all neighbouring pairs in a hash table, merges every row's leftmost pair of the
least rank, and closes the gaps; rows without a pair left drop out. A row takes as many rounds as
it has merges, so rows of over LONG bytes take their merges from a queue by rank and place instead.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from dataclasses import dataclass
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from wayfold.llm.common import WordCache, annotated, gathered

#: Pieces longer than this many bytes are merged by a queue (about 100 bytes of memory a byte).
LONG = 128
#: Cells of one matrix at most.
CELLS = 1_000_000
NO_RANK = np.int64(1) << 40
NONE = int(NO_RANK)
#: Unicode white space, as the pattern's engine has it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]


class PairTable:
    """(left id, right id) -> rank: open addressing over numpy arrays, linear probing, at most half full."""

    def __init__(self, left: np.ndarray, right: np.ndarray, rank: np.ndarray):
        self.bits = max(4, int(2 * max(1, len(left)) - 1).bit_length())
        size = 1 << self.bits
        self.keys, self.ranks = np.full(size + 64, -1, np.int64), np.full(size + 64, NO_RANK, np.int64)
        keys = (left.astype(np.int64) << 32) | right
        slots, todo, self.probes = self._slot(keys), np.arange(len(keys)), 1
        while len(todo):
            if slots.max() >= len(self.keys):  # a cluster at the end
                self.keys = np.concatenate((self.keys, np.full(64, -1, np.int64)))
                self.ranks = np.concatenate((self.ranks, np.full(64, NO_RANK, np.int64)))
            free = np.flatnonzero(self.keys[slots] < 0)
            _, first = np.unique(slots[free], return_index=True)
            placed = free[first]
            self.keys[slots[placed]], self.ranks[slots[placed]] = keys[todo[placed]], rank[todo[placed]]
            left_over = np.ones(len(todo), bool)
            left_over[placed] = False
            todo, slots = todo[left_over], slots[left_over] + 1
            self.probes += bool(len(todo))
        self.keys = np.concatenate((self.keys, np.full(self.probes, -1, np.int64)))
        self.ranks = np.concatenate((self.ranks, np.full(self.probes, NO_RANK, np.int64)))

    def mapping(self) -> dict[int, int]:
        """The same as a dictionary: left << 32 | right to the rank."""
        full = self.keys >= 0
        return dict(zip(self.keys[full].tolist(), self.ranks[full].tolist(), strict=True))

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, NO_RANK where there is none or an id is negative (padding)."""
        keys = (left.astype(np.int64) << 32) | right
        keys = np.where((left < 0) | (right < 0), np.int64(-2), keys)
        slots = self._slot(keys)
        found = self.keys[slots]
        out = np.where(found == keys, self.ranks[slots], NO_RANK)
        flat, flat_keys, flat_slots = out.ravel(), keys.ravel(), slots.ravel()
        todo = np.flatnonzero(((found != keys) & (found >= 0) & (keys >= 0)).ravel())
        step = 1
        while len(todo) and step < self.probes:
            own = self.keys[flat_slots[todo] + step]
            hit = own == flat_keys[todo]
            flat[todo[hit]] = self.ranks[flat_slots[todo[hit]] + step]
            todo = todo[~hit & (own >= 0)]
            step += 1
        return flat.reshape(keys.shape)


@dataclass
class Vocabulary:
    """Token bytes by rank, and what follows from them."""

    ranks: dict[bytes, int]
    pattern: str

    def __post_init__(self):
        left, right, rank = [], [], []
        get = self.ranks.get
        for token, r in self.ranks.items():
            for cut in range(1, len(token)):
                a, b = get(token[:cut]), get(token[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    rank.append(r)
        self.pairs = PairTable(np.array(left, np.int64), np.array(right, np.int64), np.array(rank, np.int64))
        self.byte_ids = np.array([self.ranks[bytes([b])] for b in range(256)], np.int64)
        by_rank = sorted((r, t) for t, r in self.ranks.items())
        top = by_rank[-1][0] + 1
        tokens = [b""] * top
        for r, t in by_rank:
            tokens[r] = t
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.token_bounds = np.concatenate(([0], np.cumsum([len(t) for t in tokens], dtype=np.int64)))
        self.matches = regex.compile(self.pattern)
        self.segments = regex.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.spaces = set(regex.findall(f"[{SPACE}]", "".join(map(chr, range(0x3001)))))
        self.cache = WordCache(self._encode_segments)
        self.rank_of: dict[int, int] | None = None

    def encode_pieces(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all pieces end to end, and their bounds; a piece that is a token is that token."""
        lengths = np.fromiter(map(len, pieces), np.int64, len(pieces))
        whole = np.fromiter((self.ranks.get(p, -1) for p in pieces), np.int64, len(pieces))
        known = np.flatnonzero(whole >= 0)
        made = [(known, np.ones(len(known), np.int64), whole[known])]  # pieces, their numbers of ids, and the ids
        for i in np.flatnonzero((whole < 0) & (lengths > LONG)).tolist():
            ids = self._merge_long(self.byte_ids[np.frombuffer(pieces[i], np.uint8)])
            made.append((np.array([i]), np.array([len(ids)]), ids))
        todo = np.flatnonzero((whole < 0) & (lengths <= LONG))
        todo = todo[np.argsort(lengths[todo], kind="stable")]
        start = 0
        while start < len(todo):  # buckets of like lengths
            width = int(lengths[todo[start]])
            width += width // 4
            end = min(int(np.searchsorted(lengths[todo], width, side="right")), start + max(1, CELLS // max(1, width)))
            self._merge_bucket([pieces[i] for i in todo[start:end].tolist()], todo[start:end], made)
            start = end
        at, sizes, flat = (np.concatenate(x).astype(np.int64) for x in zip(*made, strict=True))
        place = np.empty(len(pieces), np.int64)
        place[at] = np.arange(len(at))
        index, bounds = gathered(np.concatenate(([0], np.cumsum(sizes))), place)
        return flat[index], bounds

    def _merge_bucket(self, pieces: list[bytes], at: np.ndarray, made: list) -> None:
        lengths = np.array([len(p) for p in pieces])
        ids = np.full((len(pieces), int(lengths.max(initial=0))), -1, np.int64)
        ids[np.arange(ids.shape[1])[None, :] < lengths[:, None]] = self.byte_ids[np.frombuffer(b"".join(pieces), np.uint8)]
        ranks = self.pairs.ranks_of(ids[:, :-1], ids[:, 1:])
        while len(ids):
            best = ranks.argmin(axis=1) if ranks.shape[1] else np.zeros(len(ids), np.int64)
            rows = np.arange(len(ids))
            least = ranks[rows, best] if ranks.shape[1] else np.full(len(ids), NO_RANK)
            done = least >= NO_RANK
            if done.any():
                own = ids[done]
                made.append((at[done], lengths[done], own[np.arange(own.shape[1])[None, :] < lengths[done][:, None]]))
                ids, ranks, at, lengths, best, least = (x[~done] for x in (ids, ranks, at, lengths, best, least))
                if not len(ids):
                    return
                rows = np.arange(len(ids))
            column = np.arange(ids.shape[1] - 1)[None, :]
            ids[rows, best] = least
            source = column + (column > best[:, None])  # close the gap at best + 1
            ids = np.take_along_axis(ids, source, axis=1)
            ranks = np.take_along_axis(np.concatenate((ranks, np.full((len(ids), 1), NO_RANK)), axis=1), source, axis=1)[:, :-1]
            lengths = lengths - 1
            width = int(lengths.max())
            ids, ranks = ids[:, :width], ranks[:, : max(0, width - 1)]
            for shift in (-1, 0):  # the pairs on either side of the merged id
                where = best + shift
                ok = np.flatnonzero((where >= 0) & (where + 1 < width))
                if len(ok):
                    ranks[ok, where[ok]] = self.pairs.ranks_of(ids[ok, where[ok]], ids[ok, where[ok] + 1])

    def _merge_long(self, ids: np.ndarray) -> np.ndarray:
        """One long piece: its least-rank pair from a queue, the leftmost of equal ones, and links to the neighbours that are left."""
        if self.rank_of is None:
            self.rank_of = self.pairs.mapping()
        n, rank_of = len(ids), self.rank_of.get
        ranks = self.pairs.ranks_of(ids[:-1], ids[1:])
        known = np.flatnonzero(ranks < NO_RANK)
        queue = ((ranks[known] << 32) | known).tolist()
        queue.sort()
        own = array("q", np.append(ranks, NO_RANK).tobytes())  # the rank of the pair that begins at a place; -1 if its token is gone
        token, after, before = (array("q", x.astype(np.int64).tobytes()) for x in (ids, np.arange(1, n + 1), np.arange(-1, n - 1)))
        while queue:
            least = heappop(queue)
            rank, at = least >> 32, least & 0xFFFFFFFF
            if own[at] != rank:  # merged or changed since
                continue
            gone = after[at]
            behind = after[gone]
            own[gone], token[at], after[at] = -1, rank, behind
            own[at] = NONE
            if behind < n:
                before[behind] = at
                new = rank_of((rank << 32) | token[behind])
                if new is not None:
                    own[at] = new
                    heappush(queue, (new << 32) | at)
            ahead = before[at]
            if ahead >= 0:
                new = rank_of((token[ahead] << 32) | rank)
                own[ahead] = NONE if new is None else new
                if new is not None:
                    heappush(queue, (new << 32) | ahead)
        return np.frombuffer(token, np.int64)[np.frombuffer(own, np.int64) >= 0]

    def _encode_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all segments end to end, and their bounds."""
        # segments that start with white space and end without it can be matched as one string
        spaced = np.array([s[0] in self.spaces and s[-1] not in self.spaces for s in segments])
        joined = self.matches.findall("".join(s for s, ok in zip(segments, spaced.tolist(), strict=True) if ok))
        ends = np.cumsum(np.fromiter(map(len, joined), np.int64, len(joined)))
        lengths = np.fromiter(map(len, segments), np.int64, len(segments))
        counts = np.zeros(len(segments), np.int64)
        counts[spaced] = np.diff(np.searchsorted(ends, np.cumsum(lengths[spaced]), side="right"), prepend=0)
        alone = [self.matches.findall(segments[i]) for i in np.flatnonzero(~spaced).tolist()]
        counts[~spaced] = [len(x) for x in alone]
        order = np.concatenate((np.flatnonzero(spaced), np.flatnonzero(~spaced)))
        pieces = list(chain(joined, chain.from_iterable(alone)))  # in the order of `order`
        distinct = list(dict.fromkeys(pieces))
        row = dict(zip(distinct, range(len(distinct)), strict=True))
        codes = np.fromiter(map(row.__getitem__, pieces), np.int64, len(pieces))
        flat, bounds = self.encode_pieces([p.encode("utf-8", "surrogatepass") for p in distinct])
        at, ends = gathered(bounds, codes)
        segment_bounds = ends[np.concatenate(([0], np.cumsum(counts[order])))]
        place = np.empty(len(segments), np.int64)
        place[order] = np.arange(len(order))
        back, out = gathered(segment_bounds, place)
        return flat[at[back]].astype(np.uint32), out

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts end to end, as unsigned 32-bit integers, and each text's bounds; null is as empty."""
        parts = [self.segments.findall(text or "") for text in texts]
        distinct = list(dict.fromkeys(chain.from_iterable(parts)))
        row = dict(zip(distinct, self.cache.rows(distinct).tolist(), strict=True))
        bounds = np.concatenate(([0], np.cumsum([len(x) for x in parts], dtype=np.int64)))
        rows = np.fromiter(map(row.__getitem__, chain.from_iterable(parts)), np.int64, bounds[-1])
        at, ends = gathered(self.cache.bounds, rows)
        return self.cache.values[at] if len(at) else np.zeros(0, np.uint32), ends[bounds]

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids' tokens."""
        return self.token_bytes[gathered(self.token_bounds, ids.astype(np.int64))[0]].tobytes()


_LOADED: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file (base64 token and rank on each line), loaded once in a process."""
    if (path, pattern) not in _LOADED:
        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        _LOADED[path, pattern] = Vocabulary(ranks, pattern)
    return _LOADED[path, pattern]


def round_trip(docs: DataFrame, path: str, pattern: str, text: str = "text") -> DataFrame:
    """docs with n_tokens, ids_sha256 (of ids as little-endian unsigned 32 bits) and decoded_sha256, for every row.

    Whole texts; null is as empty (no tokens, digests of nothing). The file must lie at path on
    every executor. No shuffle; clashing columns of docs are replaced.
    """

    def run(texts: pa.Array) -> list:
        own = vocabulary(path, pattern)
        counts, hashes, decoded = [], [], []
        flat, bounds = own.encode(texts.to_pylist())
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            ids = flat[a:b]
            counts.append(b - a)
            hashes.append(hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest())
            decoded.append(hashlib.sha256(own.decode(ids)).hexdigest())
        return [counts, hashes, decoded]

    return annotated(docs, text, FIELDS, run)
