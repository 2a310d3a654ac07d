"""Operators on pages and vectors: SQL, brute force and round trips."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tests.oracle import assert_same, connection
from wayfold.llm import exact_topk, queries, url_filter, warc
from wayfold.session import prepare

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
@pytest.mark.parametrize("sf", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_sql(spark, name, sf):
    assert_same(queries.QUERIES[name](prepare(spark), sf).toPandas(), connection(sf).sql(queries.ORACLE_SQL[name]).df())


URLS = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7x?q=1#f", "https://example.com/en/6", "http://x.net/de/1", "http://a.example.net/de/8/9", "http://org/es/", "http://notorg/es/", "http://b.org/es?x=1", "ftp://u@h:80/p?utm_source=a&b=2&ref=z#t", "http://www.h:80/p/", "http://h:80/p?b=2", "a://b://c/d", "http://ÄÖ.com/en/\nx", "http://listed.com/a?x=1&utm_medium=q", "https://www.listed.com/a/?x=1"]


def page_rows(spark, repeated=1):
    rows = [(i, u, f"<p>{i}</p>", "clash", "clash") for _ in range(repeated) for i, u in enumerate(URLS)] + [(None, URLS[4], None, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string, host string, Verdict string")


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_url_rules_and_list(spark, broadcast_bytes):
    listed = spark.createDataFrame([("listed.com/a?x=1",), ("listed.com/a?x=1",), (None,), ("h:80/p?b=2",)], "canonical string")
    made = {(r["page_id"], r["host"], r["path"], r["rule"], r["verdict"]) for r in url_filter.judge(page_rows(spark, 2), listed, broadcast_bytes=broadcast_bytes).collect()}
    by_id = {r[0]: r[1:] for r in made}
    assert len(made) == len(URLS) + 1
    assert by_id[0] == by_id[1] == by_id[2] == by_id[3] == ("", "", None, "allow")
    assert by_id[4] == by_id[None] == ("a.example.com", "/en/7x", "example.com/en/7", "allow")
    assert by_id[5] == ("example.com", "/en/6", "com/en/", "block")
    assert by_id[6] == ("x.net", "/de/1", "net/de/", "allow")
    assert by_id[7] == ("a.example.net", "/de/8/9", "example.net/de/8", "block")
    assert by_id[8] == ("org", "/es/", "org/es/", "block")
    assert by_id[9] == ("notorg", "/es/", None, "allow") and by_id[10] == ("b.org", "/es", None, "allow")
    assert by_id[11] == ("u@h:80", "/p", None, "allow") and by_id[13] == ("h:80", "/p", None, "block")
    assert by_id[14] == ("b:", "//c/d", None, "allow") and by_id[15][:2] == ("ÄÖ.com", "/en/\nx")
    assert by_id[16][3] == by_id[17][3] == "block"
    assert url_filter.judge(page_rows(spark).limit(0), listed).count() == 0
    assert {r["verdict"] for r in url_filter.judge(page_rows(spark).filter("page_id > 15"), listed.limit(0)).collect()} == {"allow"}


def test_bloom_filter_has_no_false_negatives_and_few_false_positives(spark):
    urls = spark.range(4000).selectExpr("concat('h.com/', id) as canonical")
    listed = urls.filter("substring(canonical, 7) < 2000")
    blocks = -(-listed.count() * url_filter.BITS_PER_URL // url_filter.BLOCK_BITS)
    made = url_filter.passing(urls, url_filter.bloom_blocks(listed, blocks), blocks)
    assert made.join(listed, "canonical", "left_semi").filter("not possible").count() == 0
    assert made.join(listed, "canonical", "left_anti").filter("possible").count() < 0.03 * 4000
    one = url_filter.passing(urls, url_filter.bloom_blocks(listed, 1), 1)
    assert one.filter("possible").count() > 3900  # a filter that is far too small passes nearly all
    exact = url_filter.listed_among(urls, listed)
    assert exact.filter("listed").count() == listed.count() and exact.count() == 4000


def test_list_is_not_a_rule_on_hosts(spark):
    """Pages of one host, without a rule, get both verdicts by the list; the exact join takes nothing that isn't listed."""
    made = queries.op2_url_filter(prepare(spark), "/root/testdata/sf0.1").filter("rule is null").select("host", "path", "verdict").collect()
    by_host: dict = {}
    for r in made:
        by_host.setdefault(r["host"], set()).add(r["verdict"])
    assert sum(len(v) == 2 for v in by_host.values()) > 20


def test_plan_of_url_filter_has_no_python(spark):
    plan = queries.QUERIES["op2_url_filter"](prepare(spark), SF)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def b32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def odd_pages(spark):
    tricky = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nxyz\r\n\r\n"
    rows = [(5, "http://b.com/x", "same"), (3, "http://a.com/x", "same"), (4, None, "same"), (4, None, "same"), (3, "http://a.com/x", "same"), (7, "http://a.com/", None), (8, "http://www.A.com", ""), (9, "bad\r\nurl", tricky), (None, "http://n.com/", "same"), (None, None, None), (10, "http://z.com/ü?q#f", "ß" * 70_000)]
    return spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, PAYLOAD_BYTES string"), rows


def test_archives_round_trip(spark, tmp_path):
    pages, rows = odd_pages(spark)
    made = warc.archived(pages, path=f"{tmp_path}/w").collect()
    first: dict = {}
    for p, _, html in rows:
        if p is not None:
            first[html or ""] = min(p, first.get(html or "", p))
    expected = []
    for p, _, html in rows:
        data = (html or "").encode()
        again = p is not None and p > first[html or ""]
        expected.append((p, len(data), b32(data), "revisit" if again else "response", first[html or ""] if again else None))
    key = lambda t: tuple((x is None, x) for x in t)
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in made), key=key) == sorted(expected, key=key)
    assert warc.archived(pages.limit(0), path=f"{tmp_path}/e").count() == 0
    large = warc.archived(pages, 10, path=f"{tmp_path}/l").filter("record_type = 'revisit'").collect()
    assert large == []


def test_revisits_by_shuffle_equal_those_by_broadcast(spark):
    pages, _ = odd_pages(spark)
    both = [sorted(r["record"] for r in warc.records(pages, broadcast_revisits=n).collect()) for n in (0, 10)]
    assert both[0] == both[1]


def read(data: bytes, size: int = 7):
    """Records of an uncompressed stream that comes in parts of `size` bytes."""
    parser = warc.Parser()
    out = [r for a in range(0, len(data), size) for r in parser.feed(data[a : a + size])]
    parser.close()
    return out


def test_damaged_archive_is_told(spark):
    record = (warc.records(odd_pages(spark)[0].filter("page_id = 10")).first()["record"] + "\r\n\r\n").encode()
    assert len([warc.capture(*r) for r in read(record, 4096)]) == 1
    with pytest.raises(ValueError, match="digest"):
        [warc.capture(*r) for r in read(record.replace("ßß".encode(), "ßs!".encode(), 1), 4096)]
    with pytest.raises(ValueError):
        read(record[:-500], 4096)


def test_parser_follows_lengths():
    stream = b"WARC/1.1\r\nA: b\r\nContent-Length: 6\r\n\r\nx\r\n\r\ny\r\n\r\nWARC/1.0\r\nContent-Length: 0\r\n\r\n\r\n\r\nWARC/1.0\r\nContent-Length: 2\r\n\r\n\r\n\r\n\r\n"
    for size in (1, 2, 3, 5, 1000):
        assert [b for _, b in read(stream, size)] == [b"x\r\n\r\ny", b"", b"\r\n"]
    with pytest.raises(ValueError):
        read(b"HTTP/1.1 200 OK\r\n")


def test_files_are_bounded_members(spark, tmp_path):
    """Large pages under small bounds: files of few chunks, each record a member that can be read on its own."""
    rng = np.random.default_rng(2)
    texts = ["".join(map(chr, rng.integers(33, 0x800, 40_000).tolist())) for _ in range(30)]
    pages = spark.createDataFrame([(i, f"http://h{i}.com/", t + "\r\n") for i, t in enumerate(texts)], "page_id long, url string, html string").repartition(2)
    warc.write(pages, f"{tmp_path}/w", chunk_bytes=100_000, file_chunks=2)
    files = sorted(tmp_path.glob("w/*.warc.gz"))
    assert len(files) >= 8 and not list(tmp_path.glob("w/*.txt"))
    seen = 0
    for file in files:
        data, members = file.read_bytes(), []
        assert len(data) < 2 * (100_000 + 80_000)
        while data:
            inflater = zlib.decompressobj(31)
            members.append(inflater.decompress(data) + inflater.flush())
            data = inflater.unused_data
        kinds = [read(m, 1 << 16) for m in members if m]
        assert all(len(k) == 1 for k in kinds) and kinds[0][0][0]["warc-type"] == "warcinfo"
        assert gzip.decompress(file.read_bytes()) == b"".join(members)
        seen += len(kinds) - 1
    assert seen == 30
    made = {r["page_id"]: r["payload_bytes"] for r in warc.read_runs(spark, f"{tmp_path}/w").collect()}
    assert made == {i: len(t.encode()) + 2 for i, t in enumerate(texts)}


def test_repeated_captures_span_ranges(spark, tmp_path):
    pages = spark.createDataFrame([(None, "http://h.com/", "x")] * 300, "page_id long, url string, html string").repartition(3)
    warc.write(pages, f"{tmp_path}/w")
    made = warc.merged_index(warc.read_runs(spark, f"{tmp_path}/w"), 40).collect()
    sizes = np.unique([r["range"] for r in made], return_counts=True)[1]
    assert len(made) == 300 and len(sizes) >= 5 and sizes.max() < 150


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.integers(0, 9), max_size=7).map(sorted), max_size=9))
def test_loser_tree_merges(runs):
    order = list(warc.LoserTree(runs))
    assert [runs[r][i] for r, i in order] == sorted(x for run in runs for x in run)
    assert order == sorted(order, key=lambda x: (runs[x[0]][x[1]], x[0], x[1]))


def test_index_is_globally_ordered(spark, tmp_path):
    rows = [(i, f"http://h{i % 3 if i % 2 else 0}.com/", f"p{i}") for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    warc.write(pages, f"{tmp_path}/w")
    made = warc.merged_index(warc.read_runs(spark, f"{tmp_path}/w"), 60).orderBy("range", "position").collect()
    keys = [(r["urlkey"], r["timestamp"], r["page_id"]) for r in made]
    assert keys == sorted(keys) and len(keys) == 400 and len({r["range"] for r in made}) > 4


@pytest.mark.parametrize("url,key", [("http://www.Ex.com/A?b#c", "com,ex)/a?b"), ("https://a.b.org", "org,b,a)/"), ("", ")/"), ("x", "x)/")])
def test_surt(url, key):
    assert warc.surt(url) == key


def brute_top(rows, k, every):
    """By Python's integers; scores beyond 64 bits are held to the nearest long."""
    valid = [(i, [math.floor(1024 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out, seen = [], {}
    for i, v in valid:
        if i % every == 0:
            seen[i] = min(v, seen.get(i, v))
    for i, v in seen.items():
        found = sorted((-sum(a * b for a, b in zip(v, w)), j) for j, w in valid if j != i)[:k]
        out += [(i, r, j, max(-(2**63), min(2**63 - 1, -s))) for r, (s, j) in enumerate(found, 1)]
    return sorted(out)


@pytest.mark.parametrize("n,width,kind", [(300, 8, "cluster"), (40, 3, "ties"), (6, 4, "few"), (0, 1, "empty"), (30, 2, "3e5"), (30, 2, "1e7"), (30, 3, "1e30"), (60, 3, "mixed")])
def test_top_k_equals_brute_force(spark, monkeypatch, n, width, kind):
    monkeypatch.setattr(exact_topk, "BLOCK", 16)
    monkeypatch.setattr(exact_topk, "CELL_BLOCKS", 2)
    monkeypatch.setattr(exact_topk, "STEP", 8)
    monkeypatch.setattr(exact_topk, "SAMPLE", 50)
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, width)) * 0.02 + rng.integers(0, 4, (n, 1)) * 0.3
    if kind == "ties":
        x = rng.integers(0, 2, (n, width)).astype(float)
    if kind[0] in "13":
        x = x * float(kind)
    if kind == "mixed":  # ordinary vectors, some with a component of 2^41, some beyond 64 bits
        x[::7, 0] = 2.0**41
        x[3::7] *= 1e7
        x[5::13, 1] = -3e38
    rows = [(i, [float(np.float32(v)) for v in row]) for i, row in enumerate(x)]
    rows += [(1000, None), (None, [1.0] * width), (1010, [float("nan")] * width), (1020, [float("inf")] * width), (1030, [None] * width)]
    rows += [rows[0], rows[3], (20, [0.5] * width)] if n > 20 else []
    frame = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<float>, score string, rank int")
    made = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in exact_topk.top_k(frame, 5, 10).collect())
    assert made == brute_top(rows, 5, 10)


def test_largest_doubles_take_part(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.7e308, 0.0]), (2, [-1.7e308, 1.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r["vec_id"], r["score"]) for r in exact_topk.top_k(frame, 3, 10).orderBy("rank").collect()] == [(1, 2**63 - 1), (3, 2 * 1024**2), (2, -(2**63))]


def test_vectors_of_unlike_length_are_padded(spark):
    frame = spark.createDataFrame([(0, [1.0, 1.0]), (1, [1.0]), (2, [1.0, 1.0, 9.0]), (3, [])], "vec_id long, embedding array<float>")
    assert [(r["vec_id"], r["score"]) for r in exact_topk.top_k(frame, 3, 10).orderBy("rank").collect()] == [(2, 2 * 1024**2), (1, 1024**2), (3, 0)]


def clustered(rng, n, width=16, groups=12):
    return rng.normal(size=(n, width)) * 0.004 + rng.normal(size=(groups, width))[rng.integers(0, groups, n)]


def counted(monkeypatch):
    """Numbers of candidates that are evaluated from now on."""
    seen, scores = [], exact_topk.scores
    monkeypatch.setattr(exact_topk, "scores", lambda q, c: seen.append(len(c)) or scores(q, c))
    return seen


def test_bounds_prune_clustered_candidates(monkeypatch):
    x = np.floor(1024 * clustered(np.random.default_rng(4), 4000))
    pivots = exact_topk.far_apart(x[:500], 16)
    block = exact_topk.Block.of(np.arange(4000), x, pivots)
    seen = counted(monkeypatch)
    at, best = exact_topk.search(7, 7, block, block, -math.inf, 10, float(np.sqrt((pivots**2).sum(axis=1)).max()))
    exact = (x[7:8] @ x.T)[0]
    exact[7] = -np.inf
    assert best.tolist() == sorted(exact, reverse=True)[:10] and sum(seen) < 0.25 * 4000


def test_cells_that_cannot_help_get_no_queries():
    rng = np.random.default_rng(9)
    x = np.floor(1024 * clustered(rng, 3000))
    pivots = exact_topk.far_apart(x[:600], 24)
    far = float(np.sqrt((pivots**2).sum(axis=1)).max())
    block = exact_topk.Block.of(np.arange(3000), x, pivots)
    near = block.table.argmin(axis=1)
    cells = [np.flatnonzero(near == p) for p in np.unique(near)]
    low, high = (np.stack([f(block.table[c], axis=0) for c in cells]) for f in (np.min, np.max))
    square = np.array([block.square[c].max() for c in cells])
    q = block.at(np.arange(0, 3000, 100))
    product = q.v @ x.T
    floors = np.sort(product, axis=1)[:, -10]
    gains = exact_topk.reachable(q, low, high, square, floors, far)
    needed = np.stack([(product[:, c] >= floors[:, None]).any(axis=1) for c in cells], axis=1)
    assert not (needed & ~gains).any() and gains.mean() < 0.4
