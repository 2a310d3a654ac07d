"""Operators on documents: brute force, exact round trips and held-out accuracy; odd rows of every kind."""

from __future__ import annotations

import base64
import hashlib
import math
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wayfold.llm import bpe, language_id, packing, quality_knn, quality_rules, simhash, token_matrix, tokens
from wayfold.llm import common
from wayfold.llm.common import WordCache, slices, word_codes

SF = "/root/testdata/sf0.01"
WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = [None, "", " \n\t ", "a", "Don't STOP, it's 12 o'clock…", "the the the the the the", "x" * 5000, "word " * 30_000, "über Straße\x0bnaïve\x0cgarçon\r\nÉté!!", "日本語 テキスト 中文字", "a # b | c * d & e\n\na # b | c * d & e\n", "\x1c\x85  ", "<|endoftext|> <|ENDOFTEXT|> x", "a\u0301 e\u0308 İstanbul ΣΑΣ", "🙂👩‍👩‍👧 !!! ??? ..."]


def odd_rows(spark):
    """Odd texts twice, a null key, and columns that clash with what operators add."""
    rows = [(i, t, "en", "s", 1.0, True) for i, t in enumerate(ODD)] + [(3, ODD[3], None, None, None, None), (None, "nobody knows my key", "de", None, None, None), (99, ODD[4], "fr", "s", 2.0, False)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, KEPT boolean")


def text_of(row):
    return row["text"] or ""


words_of = re.compile(r"[^\x20\x09-\x0D]+").findall


# helpers


def test_word_codes_equal_the_pattern():
    vocabulary, codes, bounds = word_codes(pa.array(ODD))
    made = [[vocabulary[int(c)].as_py() for c in codes[a:b]] for a, b in zip(bounds, bounds[1:])]
    assert made == [words_of(t or "") for t in ODD]


def test_slices_hold_every_row_and_bound_text():
    batch = pa.RecordBatch.from_arrays([pa.array(ODD)], names=["text"])
    parts = list(slices([batch], "text", 1000))
    assert [t for p in parts for t in p.column(0).to_pylist()] == ODD
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(0).to_pylist()) <= 1000 for p in parts)


def test_word_cache_forgets_and_repeats():
    cache = WordCache(lambda words: (np.array([ord(c) for w in words for c in w]), np.cumsum([0, *map(len, words)])), 5)
    for words in (["ab", "c", "ab"], ["c", "d", "eee"], ["ab", "x", "y", "z", "w", "c"]):
        rows = cache.rows(words)
        assert ["".join(map(chr, cache.values[cache.bounds[r] : cache.bounds[r + 1]])) for r in rows] == words


# 1 quality rules


def brute_statistics(text):
    words = words_of(text or "")
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    inside = {i + k for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if words_of(x)]
    return [len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(inside)]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="ab#|\n \t\x0bé", max_size=80)), max_size=6))
def test_statistics_equal_brute_force(texts):
    made = quality_rules.statistics(pa.array(texts, pa.string()))[0]
    assert made.tolist() == [brute_statistics(t) for t in texts]


def test_repeats_with_keys_beyond_64_bits():
    codes, row = np.array([0, 1, 2, 0, 1, 2, 5, 5]), np.zeros(8, np.int64)
    assert quality_rules._repeated(codes, row, 1 << 40, 1).tolist() == quality_rules._repeated(codes, row, 6, 1).tolist() == [True] * 6 + [False] * 2


def test_trees_fit_and_keep_their_monotone_features():
    rng = np.random.default_rng(0)
    x = rng.random((800, 3))
    y = ((x[:, 0] < 0.5) ^ (rng.random(800) < 0.1)).astype(float)
    trees = quality_rules.grow(x, y, {0: -1, 1: 1})
    assert ((trees.score(x) > 0.5) == (x[:, 0] < 0.5)).mean() > 0.95
    for feature, sign in ((0, -1), (1, 1)):
        for _ in range(20):
            line = np.repeat(rng.random((1, 3)), 50, axis=0)
            line[:, feature] = np.linspace(0, 1, 50)
            assert (sign * np.diff(trees.score(line)) >= -1e-12).all()
    assert quality_rules.grow(x, np.ones(800), {}).score(x).min() > 0.9
    assert quality_rules.grow(np.zeros((0, 3)), np.zeros(0), {}).score(x[:2]).tolist() == [0.5, 0.5]


def test_flat_trees_score_like_a_walk_from_root_to_leaf():
    rng = np.random.default_rng(4)
    x = rng.random((300, 4))
    trees = quality_rules.grow(x, (x[:, 0] + x[:, 1] * x[:, 2] > 0.8).astype(float), {0: 1})
    for row, score in zip(x, trees.score(x), strict=True):
        margin = trees.base
        for node in trees.roots.tolist():
            while trees.left[node] != node:
                node = int(trees.left[node] if row[trees.feature[node]] <= trees.threshold[node] else trees.right[node])
            margin += trees.value[node]
        assert abs(score - 1 / (1 + math.exp(-margin))) < 1e-12


def test_quality_rules_learn_from_other_rows_than_they_judge(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    held = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    made = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.fit(docs, labels.filter(~held))).join(labels, "doc_id").filter(held).filter("not base_failed").toPandas()
    assert len(made) > 30 and (made["kept"] == (made["quality"] == 1)).mean() > 0.9


def test_quality_rules_on_odd_rows(spark):
    docs = odd_rows(spark)
    labels = spark.createDataFrame([(4, 1), (5, 0), (7, 0), (None, 1), (8, None)], "doc_id long, quality int")
    made = quality_rules.judge(docs, quality_rules.fit(docs, labels))
    assert "KEPT" not in made.columns and made.count() == docs.count()
    for r in made.collect():
        expected = brute_statistics(r["text"])
        assert [r[c] for c in quality_rules.COUNTS] == expected
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert r["base_failed"] == failed and (not failed or not r["kept"])
    empty = quality_rules.judge(docs.limit(0), quality_rules.fit(docs.limit(0), labels.limit(0)))
    assert empty.count() == 0


def test_quality_rules_find_junk(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    made = quality_rules.judge(docs.select("doc_id", "text"), quality_rules.fit(docs, labels)).join(labels, "doc_id").filter("not base_failed").toPandas()
    assert (made["kept"] == (made["quality"] == 1)).mean() > 0.95


# 3 quality classifier


def test_quality_votes_are_exact_and_odd_rows_hold(spark):
    texts = pa.array([t for t in ODD if t and t.strip()])
    shares = quality_knn.term_shares(texts)
    labels = np.arange(len(texts)) % 2
    voters = quality_knn.Voters.learn(shares, labels, 0.7)
    own = quality_knn._unit(shares @ voters.projection)
    cosines = own @ voters.vectors.T
    for i, score in enumerate(voters.score(texts, 3)):
        near = np.argsort(-cosines[i], kind="stable")[:3]  # whole numbers: equal ones are told by place
        weight = np.maximum(cosines[i][near], 0) * voters.weights[near]
        assert abs(score - (weight * labels[near]).sum() / weight.sum()) < 1e-4
    assert (cosines == np.rint(cosines)).all() and np.abs(cosines).max() < 2**24
    docs = odd_rows(spark)
    made = quality_knn.classify(docs, voters).collect()
    assert len(made) == docs.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in made)
    assert all(abs(r["score"] - 0.7) < 1e-9 for r in made if not words_of(text_of(r)))
    none = quality_knn.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert {r["score"] for r in quality_knn.classify(docs, none).collect()} == {0.5}


def test_quality_on_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    voters = quality_knn.fit(docs, labels.filter(~quality_knn.held_out()))
    made = quality_knn.classify(docs.select("doc_id", "text"), voters).join(labels, "doc_id").filter(quality_knn.held_out()).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 5 == 0 for i in made["doc_id"])
    assert (made["predicted"] == made["quality"]).mean() > 0.95


def test_equal_cosines_go_to_the_first():
    products = np.array([[5, 7, 7, 7, 1], [3, 3, 3, 3, 3], [1, 2, 3, 4, 5]], np.float32)
    assert quality_knn.nearest(products, 2).tolist() == [[1, 2], [0, 1], [3, 4]]


# 10 language ID


def brute_stream(text):
    words = words_of((text or "").lower())
    return (" " + "".join(w + " " for w in words)).encode() if words else b""


def brute_counts(texts, order):
    counts: dict = {}
    for text in texts:
        stream = brute_stream(text)
        for i in range(1, len(stream)):
            for k in range(min(order, i) + 1):
                counts.setdefault(stream[i - k : i], Counter())[stream[i]] += 1
    return counts


def brute_bits(counts, order, text):
    """PPM by dictionaries over the whole text: counts[context][symbol], longest context first."""
    stream, bits = brute_stream(text), 0.0
    for i in range(1, len(stream)):
        for k in range(min(order, i), -1, -1):
            seen = counts.get(stream[i - k : i])
            if seen is None:
                continue
            total, distinct = sum(seen.values()), len(seen)
            if stream[i] in seen:
                bits -= math.log2(seen[stream[i]] / (total + distinct))
                break
            bits -= math.log2(distinct / (total + distinct))
        else:
            bits += 8
    return bits


short_texts = st.lists(st.text(alphabet="abcé 中\n", max_size=14), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(short_texts, short_texts, short_texts)
def test_code_lengths_equal_brute_force(one, two, asked):
    trees = language_id.ContextTrees.learn({n: language_id.symbol_counts(pa.array(t)) for n, t in (("x", one), ("y", two))})
    made, size = language_id.code_lengths(trees, pa.array(asked))
    by_levels = language_id.ContextTrees(trees.languages, trees.order, trees.symbol_keys, trees.symbol_bits, trees.context_keys, trees.escape_bits)
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(language_id, "TABLE_BYTES", 0)
        assert np.allclose(language_id.code_lengths(by_levels, pa.array(asked))[0], made, rtol=1e-5)
    assert size.tolist() == [max(0, len(brute_stream(t)) - 1) for t in asked]
    for n, own in enumerate((one, two)):
        counts = brute_counts(own, language_id.ORDER)
        assert np.allclose(made[:, n], [brute_bits(counts, language_id.ORDER, t) for t in asked], rtol=1e-4)


def test_scores_do_not_grow_with_length():
    trees = language_id.ContextTrees.learn({n: language_id.symbol_counts(pa.array([t])) for n, t in (("x", "aba bab abba"), ("y", "aba bab cbbc"))})
    _, score = language_id.score_texts(trees, pa.array(["abba baba " * 20, "abba baba " * 2000]))
    assert abs(score[0] - score[1]) < 0.02 and 0.5 < score[0] < 1


def test_repeated_rows_and_languages_do_not_grow_the_samples(spark):
    many = spark.range(5000).selectExpr("7 as doc_id", "concat('wort ', id % 3) as text", "'de' as lang").unionByName(spark.range(300).selectExpr("cast(null as long) as doc_id", "concat('word ', id) as text", "concat('l', id % 30) as lang"))
    trees = language_id.fit(many.unionByName(many.filter("doc_id = 7")), per_lang=2, most_languages=5)
    assert trees.languages == ["de", "l0", "l1", "l10", "l11"]
    labels = spark.createDataFrame([(7, 1), (7, 1), (8, 0), (8, 1), (None, 0), (9, 0), (10, 0), (11, 0)], "doc_id long, quality int")
    docs = many.select("doc_id", "text").unionByName(spark.range(8, 12).selectExpr("id as doc_id", "cast(null as string) as text"))
    made = quality_rules.labelled_sample(docs, labels, "quality", 2).collect()
    assert sorted(r["doc_id"] for r in made)[0] == 7 and len(made) == 3 and all(r["label"] == (r["doc_id"] == 7) for r in made)
    assert all(r["doc_id"] != 8 for r in made)


def test_language_on_held_out_rows_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    trees = language_id.fit(docs.filter(~language_id.held_out()))
    made = language_id.identify(docs, trees).filter(language_id.held_out()).toPandas()
    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in made["doc_id"])
    known = made[made["lang_pred"] != "und"]
    assert (known["lang_pred"] == known["lang"]).mean() > 0.95 and len(known) > 0.9 * len(made)
    odd = language_id.identify(odd_rows(spark), trees).collect()
    for r in odd:
        lettered = any(c.isalpha() for c in text_of(r))
        assert (r["lang_pred"] == "und") == (not lettered) and 0 <= r["score"] <= 1
    nothing = language_id.fit(odd_rows(spark).limit(0))
    assert {r["lang_pred"] for r in language_id.identify(odd_rows(spark), nothing).collect()} == {"und"}


# 5 byte-level BPE


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.vocabulary(BYTE_BPE, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def reference(vocabulary):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abtheZ  \n\t\x0b\x1c\x85\xa0\u2003é中文'sxt19½!?…🙂", max_size=60))
def test_ids_equal_tiktoken(text):
    own = bpe.vocabulary(BYTE_BPE, public_tokenizers.PATTERN)
    other = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=own.ranks, special_tokens={})
    ids, _ = own.encode([text])
    assert ids.tolist() == other.encode_ordinary(text) and own.decode(ids) == text.encode()


def test_long_unbroken_text_takes_seconds(vocabulary, reference):
    text = "".join(np.random.default_rng(3).choice(list("abcdefghijklmnopqrstuvwxyz"), 1_000_000))
    start = time.perf_counter()
    ids = vocabulary.encode_pieces([text.encode()])[0]
    assert time.perf_counter() - start < 40 and vocabulary.decode(ids) == text.encode()
    part = text[:150_000]
    assert vocabulary.encode_pieces([part.encode()])[0].tolist() == reference.encode_ordinary(part)


@pytest.mark.parametrize("text", ["a" * 3000, "ab" * 1500, "theinof" * 300, "中文" * 400, " " * 500 + "x", "!" * 300, "\n" * 300])
def test_long_pieces_equal_tiktoken(vocabulary, reference, text):
    assert vocabulary.encode([text])[0].tolist() == reference.encode_ordinary(text)


def test_pair_table_holds_all_pairs():
    rng = np.random.default_rng(1)
    keys = np.unique(rng.integers(0, 300, (4000, 2)), axis=0)
    table = bpe.PairTable(keys[:, 0], keys[:, 1], np.arange(len(keys)))
    assert (table.ranks_of(keys[:, 0], keys[:, 1]) == np.arange(len(keys))).all()
    known = {tuple(k) for k in keys.tolist()}
    other = rng.integers(-1, 300, (2000, 2))
    miss = np.array([tuple(k) not in known for k in other.tolist()])
    assert ((table.ranks_of(other[:, 0], other[:, 1]) == bpe.NO_RANK) == miss).all()


def test_round_trip_on_odd_rows(spark, reference):
    docs = odd_rows(spark)
    made = bpe.round_trip(docs, BYTE_BPE, public_tokenizers.PATTERN).collect()
    assert len(made) == docs.count()
    for r in made:
        ids = reference.encode_ordinary(text_of(r))
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text_of(r).encode()).hexdigest()
    assert bpe.round_trip(docs.limit(0), BYTE_BPE, public_tokenizers.PATTERN).count() == 0


# 6 and 8 packing


def test_ids_equal_the_tokenizer():
    texts = ODD + ["don't we'll rock'n'roll foo-bar a.b ÉTÉ!! ǅ x++ ++x __a__ </w> w</w> ÿ× \u1e9b\u0323,"]
    ids, bounds = tokens.text_ids(pa.array(texts), WORD_BPE)
    own = tokens.tokenizer(WORD_BPE)
    for i, t in enumerate(texts):
        assert ids[bounds[i] : bounds[i + 1]].tolist() == own.encode(t or "", add_special_tokens=False).ids + [1]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="abcÉé!.'s-_ \n\u0301İ9中", max_size=30), max_size=5))
def test_ids_equal_the_tokenizer_on_any_text(texts):
    ids, bounds = tokens.text_ids(pa.array(texts, pa.string()), WORD_BPE)
    own = tokens.tokenizer(WORD_BPE)
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == [own.encode(t, add_special_tokens=False).ids + [1] for t in texts]


def laid_out(plan, histogram, capacity):
    """All pieces of a histogram as the plan lays them; checks that sequences are gapless and hold."""
    runs = plan.arrays()
    keys = runs["length"] * 2**45 + runs["rank"]
    filled: dict[int, list] = {}
    for length, count in histogram.items():
        rank = np.arange(count)
        row = np.searchsorted(keys, length * 2**45 + rank, side="right") - 1
        assert (runs["length"][row] == length).all()
        over = rank - runs["rank"][row]
        for s, o in zip(runs["sequence"][row] + over // runs["each"][row], runs["offset"][row] + over % runs["each"][row] * length, strict=True):
            filled.setdefault(int(s), []).append((int(o), length))
    for own in filled.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return filled


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(1, 60), max_size=25))
def test_plans_are_gapless(histogram):
    for planner in (packing.linear_grouping, packing.best_fit_decreasing):
        filled = laid_out(planner(histogram, 64), histogram, 64)
        alone = sum(v for k, v in histogram.items() if k > 32)  # no two of these fit in one sequence
        assert len(filled) <= 1.7 * max(1, alone, -(-sum(k * v for k, v in histogram.items()) // 64)) + 1


def test_linear_grouping_is_near_the_bound():
    rng = np.random.default_rng(3)
    histogram = {int(k): int(v) for k, v in zip(*np.unique(np.clip(rng.lognormal(6.5, 1.2, 60_000), 1, 4096).astype(int), return_counts=True), strict=True)}
    plan = packing.linear_grouping(histogram)
    assert len(laid_out(plan, histogram, 4096)) <= 1.01 * sum(k * v for k, v in histogram.items()) / 4096 + 1


def plain_best_fit(histogram, capacity):
    """Sequences that best fit decreasing makes, by a loop over all pieces and open sequences."""
    bins: list[int] = []
    for x in sorted(Counter(histogram).elements(), reverse=True):
        fits = [i for i, room in enumerate(bins) if room >= x]
        if fits:
            bins[min(fits, key=lambda i: bins[i])] -= x
        else:
            bins.append(capacity - x)
    return len(bins)


def test_best_fit_equals_a_plain_loop():
    histogram = Counter(np.random.default_rng(5).integers(1, 60, 400).tolist())
    assert len(laid_out(packing.best_fit_decreasing(histogram, 64), histogram, 64)) == plain_best_fit(histogram, 64)


def test_segment_tree_equals_a_scan():
    rng, tree, some = np.random.default_rng(6), packing.SegmentTree(100), set()
    for _ in range(2000):
        c = int(rng.integers(0, 101))
        if rng.random() < 0.5:
            tree.put(c, c not in some)
            some ^= {c}
        assert tree.least(c) == min((x for x in some if x >= c), default=None)


def check_placed(rows, ids_of, capacity):
    """Placed pieces: losslessly cut, gapless, within capacity."""
    sequences: dict[int, list] = {}
    for r in rows:
        ids = ids_of[r["doc_id"]]
        assert zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes()) == r["ids_crc32"]
        assert r["start"] == r["piece"] * capacity and (r["length"] == capacity or r["start"] + r["length"] == len(ids))
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity


@pytest.mark.parametrize("capacity", [4096, 64])
def test_packing_on_odd_rows(spark, capacity):
    docs = odd_rows(spark)
    own = tokens.tokenizer(WORD_BPE)
    ids_of = {r["doc_id"]: own.encode(text_of(r), add_special_tokens=False).ids + [1] for r in docs.collect()}
    made = packing.packed(tokens.pieces(docs, WORD_BPE, capacity=capacity), capacity=capacity).collect()
    check_placed(made, ids_of, capacity)
    assert len(made) == sum(-(-len(ids_of[r["doc_id"]]) // capacity) for r in docs.collect())
    assert packing.packed(tokens.pieces(docs.limit(0), WORD_BPE)).count() == 0


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_packing_of_other_pieces_and_hot_lengths(spark, broadcast_bytes):
    frame = spark.range(500).repartition(5).selectExpr("cast(null as long) as doc_id", "cast(0 as int) as piece", "cast(case when id % 3 = 0 then 10 else 1 + id % 20 end as long) as length", "'old' as offset")
    made = packing.packed(frame, capacity=32, broadcast_bytes=broadcast_bytes).collect()
    places = {(r["sequence_id"], r["offset"]) for r in made}
    assert len(made) == len(places) == 500 and set(made[0].asDict()) == {"doc_id", "piece", "length", "sequence_id", "offset"}
    ends = Counter()
    for r in made:
        ends[r["sequence_id"]] += r["length"]
    assert max(ends.values()) <= 32
    with pytest.raises(ValueError):
        packing.packed(frame, capacity=8)


def test_token_matrices_round_trip(spark):
    docs = odd_rows(spark)
    own = tokens.tokenizer(WORD_BPE)
    rows = token_matrix.written(docs, WORD_BPE, capacity=256).collect()
    lengths = Counter(-(-min(256, n - a) // 1) for n in (len(own.encode(text_of(r), add_special_tokens=False).ids) + 1 for r in docs.collect()) for a in range(0, n, 256))
    assert len(rows) == plain_best_fit(lengths, 256)
    matrix = token_matrix.as_numpy([bytes(r["ids"]) for r in rows], rows[0]["width"])
    assert matrix.shape == (len(rows), 256)
    pieces: dict = {}
    for r, ids in zip(rows, matrix, strict=True):
        cu = r["cu_lengths"]
        assert cu[0] == 0 and cu[-1] == r["n_tokens"] and r["resets"] == cu[:-1] and not ids[r["n_tokens"] :].any()
        position = token_matrix.positions(np.array(cu), 256)
        assert all(position[x] == 0 for x in r["resets"]) and (np.diff(position[: cu[-1]]) != 1).sum() == len(cu) - 2
        for k, p, a, b in zip(r["keys"], r["pieces"], cu, cu[1:], strict=False):
            pieces.setdefault((k, p), []).append(ids[a:b].tolist())
    for r in docs.collect():
        ids = own.encode(text_of(r), add_special_tokens=False).ids + [1]
        got = [x for p in range(-(-len(ids) // 256)) for x in pieces[r["doc_id"], p][0]]
        assert got == ids
    assert sum(map(len, pieces.values())) == sum(-(-(len(own.encode(text_of(r), add_special_tokens=False).ids) + 1) // 256) for r in docs.collect())
    assert token_matrix.matrices(docs.limit(0), WORD_BPE).count() == 0


# 7 SimHash


def brute_fingerprint(text):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="abAÉé \n\x0b!", max_size=60))
def test_fingerprint_equals_brute_force(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def brute_components(values):
    parent = list(range(len(values)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 4:
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return [root(i) for i in range(len(values))]


def crowd(seed, n=350):
    rng = np.random.default_rng(seed)
    values = [int(x) for x in rng.integers(0, 2**63, n, dtype=np.uint64)]
    for _ in range(n):  # chains, and a dense group around the first
        v = values[int(rng.integers(0, len(values)))] if rng.random() < 0.5 else values[0]
        for b in rng.integers(0, 64, int(rng.integers(1, 6))):
            v ^= 1 << int(b)
        values.append(v)
    return list(dict.fromkeys([0, 2**64 - 1, *values]))


@pytest.mark.parametrize("small", [8, 400])
def test_vantage_trees_find_all_links(monkeypatch, small):
    monkeypatch.setattr(simhash, "SMALL", small)
    values = sorted(crowd(small))
    points = np.array(values, np.uint64)
    parent = np.arange(len(points))
    for mask, radius in simhash.masks():
        tree = simhash.VantageTree.build(points, mask, radius, 60)
        assert tree.leaves > 3
        for _, at in tree.shards(points):
            made = simhash.linked(points[at], mask, radius)
            parent = simhash._merged(parent, at, at[made])
    assert parent.tolist() == brute_components(values)


def test_dense_leaves_equal_brute_force_and_take_seconds():
    """Points of one value in a block, of few differing bits, and chains: all links; 100,000 of one block value in seconds."""
    rng = np.random.default_rng(8)
    for kind in ("block", "ball", "low"):
        low = {"block": rng.integers(0, 2**63, 2500, dtype=np.uint64) << np.uint64(22), "ball": np.bitwise_or.reduce(np.uint64(1) << rng.integers(0, 64, (2500, 6), dtype=np.uint64), axis=1), "low": rng.integers(0, 2**13, 4000, dtype=np.uint64)}[kind]
        points = np.unique(np.concatenate((low, low[:300] ^ np.uint64(1 << 40), low[:300] ^ np.uint64(0b111 << 50))))
        mask, radius = simhash.masks()[0]
        made = simhash.linked(points, mask, radius)
        same = np.flatnonzero([m == 0 for m in (points & mask)])
        expected = np.array(brute_components([int(x) for x in points[same]]))
        groups = {}
        assert all(groups.setdefault(int(b), int(a)) == int(a) for a, b in zip(made[same], expected, strict=True)), kind
    points = np.unique(rng.integers(0, 2**42, 100_000, dtype=np.uint64) << np.uint64(22))
    start = time.perf_counter()
    simhash.linked(points, *simhash.masks()[0])
    assert time.perf_counter() - start < 30


@pytest.mark.parametrize("held", [4_000_000, 50])
def test_links_and_components_equal_brute_force(spark, monkeypatch, held):
    values = sorted(crowd(11, 200))
    signed = [int(x) for x in np.array(values, np.uint64).view(np.int64)]
    edges = simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long"), leaf=60, held=held)
    label = {r["a"]: r["root"] for r in simhash.components(edges).collect()}
    made = [label.get(x, x) for x in signed]
    expected = brute_components(values)
    groups = {}
    for a, b in zip(made, expected, strict=True):
        assert groups.setdefault(a, b) == b
    assert len(groups) == len(set(expected))


def test_block_radii_are_checked():
    with pytest.raises(ValueError):
        simhash.masks(((32, 1), (32, 1)))


def test_near_duplicates_on_odd_rows(spark):
    text = " ".join(f"w{i}" for i in range(300))
    more = [(50, text), (51, text.upper()), (52, text + " end"), (49, text), (None, text)]
    docs = odd_rows(spark).select("doc_id", "text").unionByName(spark.createDataFrame(more, "doc_id long, text string"))
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    made = simhash.near_duplicates(docs).collect()
    assert len(made) == len(rows)
    prints = [brute_fingerprint(t) for _, t in rows]
    label = brute_components(prints)
    least = {}
    for (k, _), c in zip(rows, label, strict=True):
        if k is not None:
            least[c] = min(k, least.get(c, k))
    expected = Counter((k, f"{p:016x}", least.get(c)) for (k, _), p, c in zip(rows, prints, label, strict=True))
    assert Counter((r["doc_id"], f"{r['fp'] % 2**64:016x}", r["component_id"]) for r in made) == expected
    for most in (1_000_000, 0):
        kept = Counter(r["doc_id"] for r in simhash.deduplicated(docs, most).collect())
        assert kept == Counter([*set(least.values()), *(k for k, _ in rows if k is None)])
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_repeated_ids_with_unlike_texts_keep_a_certain_row(spark):
    text, other = (" ".join(f"{c}{i}" for i in range(200)) for c in "vw")
    rows = [(5, text, "a"), (5, text + " x", "b"), (5, other, "c"), (3, other, "d"), (5, text, "a"), (None, text, "e"), (None, text, "f"), (9, other, "g")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _removed string").repartition(3)
    first = None
    for most in (1_000_000, 0):
        made = sorted((r["doc_id"] or 0, r["_removed"]) for r in simhash.deduplicated(docs.repartition(2 + most % 5), most).collect())
        assert [m[0] for m in made] == [0, 0, 3, 5] and made[2] == (3, "d") and made[3][1] in "ab"
        first = first or made
        assert made == first


def test_hot_keys_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 10)
    rows = spark.range(1000).repartition(4).selectExpr("id", "case when id % 3 = 0 then 7 else id end as k")
    side = rows.groupBy("k").agg(F.count("*").alias("_n"), F.min("id").alias("least"))
    made = common.spread_join(rows, side, "k", 1000)
    assert {(r["id"], r["least"]) for r in made.collect()} == {(i, 0 if i % 3 == 0 else 7 if False else i) if i % 3 == 0 or i != 7 else (7, 0) for i in range(1000)}
    assert made.count() == 1000


def test_base64_ranks_are_read(vocabulary):
    assert vocabulary.ranks[base64.b64decode("IA==")] < 256
