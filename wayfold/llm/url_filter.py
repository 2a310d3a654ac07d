"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

Native: DataFrame functions only. The filter is a table of blocks of eight 64-bit words; a
URL has one block and one bit in each word, so a probe is one equi-join on the block and a
test of eight bits. Its size follows from the number of listed URLs, so it is broadcast only
up to BROADCAST_BYTES and shuffled by block beyond. URLs that pass the filter go on to an
exact hash join with the list, which removes false positives; all others skip that shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BITS_PER_URL, WORDS = 12, 8
BLOCK_BITS = 64 * WORDS
BROADCAST_BYTES = 32 << 20
#: (verdict, host, path); the longest rule that fits decides.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host after the first '://', A-Z lower-cased, and path up to '?', '#' or the end; '' for null or no '://'."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(raw) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(raw, _UPPER, _LOWER), path


def canonical(url: Column) -> Column:
    """host + path + query for comparison: no scheme, leading 'www.', fragment, closing slash, or utm_ and ref parameters.

    '' for null or no '://'.
    """
    host, path = host_and_path(url)
    query = F.regexp_extract(F.regexp_replace(F.coalesce(url, F.lit("")), r"#[\s\S]*$", ""), r"\?([\s\S]*)$", 1)
    kept = F.array_join(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[^=]*|ref)(=|$)")), "&")
    base = F.concat(F.regexp_replace(host, r"^www\.", ""), F.regexp_replace(path, r"/+$", ""))
    return F.when(host == "", F.lit("")).when(kept != "", F.concat(base, F.lit("?"), kept)).otherwise(base)


def _place(url: Column, blocks: Column) -> tuple[Column, list[Column]]:
    """Block and the bit in each word of a canonical URL."""
    block = F.pmod(F.xxhash64(url), blocks)
    bits = F.xxhash64(url, F.lit(1))
    return block, [F.shiftrightunsigned(bits, 8 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom_blocks(listed: DataFrame, blocks: int, url: str = "canonical") -> DataFrame:
    """(block, w0..w7) of the listed canonical URLs; words are partial bit_or aggregates."""
    block, bits = _place(F.col(url), F.lit(blocks))
    rows = listed.select(block.alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(F.expr(f"shiftleft(1L, b{i})")).alias(f"w{i}") for i in range(WORDS)])


def passing(urls: DataFrame, filter_blocks: DataFrame, blocks: int, url: str = "canonical", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """urls and possible (boolean): false means certainly not listed."""
    block, bits = _place(F.col(url), F.lit(blocks))
    side = filter_blocks.withColumnRenamed("block", "_block")
    side = F.broadcast(side) if blocks * (8 + 8 * WORDS) <= broadcast_bytes else side
    hit = F.lit(True)
    for i, bit in enumerate(bits):
        hit = hit & (F.getbit(F.col(f"w{i}"), bit) == 1)
    joined = urls.withColumn("_at", block).join(side, F.col("_at") == F.col("_block"), "left")
    return joined.select(*urls.columns, F.coalesce(hit, F.lit(False)).alias("possible"))


def listed_among(urls: DataFrame, listed: DataFrame, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """urls (with a column canonical) and listed (boolean): whether the canonical URL is in listed(canonical).

    Repeated and null entries of the list count once and not at all; an empty list lists nothing.
    """
    listed = listed.select("canonical").filter("canonical is not null").distinct()
    blocks = max(1, -(-listed.count() * BITS_PER_URL // BLOCK_BITS))
    probed = passing(urls, bloom_blocks(listed, blocks), blocks, broadcast_bytes=broadcast_bytes)
    exact = listed.withColumn("_listed", F.lit(True)).hint("shuffle_hash")
    found = probed.filter("possible").join(exact, "canonical", "left").select(*urls.columns, F.coalesce("_listed", F.lit(False)).alias("listed"))
    return found.unionByName(probed.filter(~F.col("possible")).select(*urls.columns, F.lit(False).alias("listed")))


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """Rule string and verdict of the longest rule that fits host (or a domain above it) and path; nulls if none does."""
    rule = verdict = None
    for kind, own, prefix in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r)):
        fits = ((host == own) | host.endswith(f".{own}")) & path.startswith(prefix)
        rule = F.when(fits, own + prefix) if rule is None else rule.when(fits, own + prefix)
        verdict = F.when(fits, kind) if verdict is None else verdict.when(fits, kind)
    return rule, verdict


def judge(pages: DataFrame, listed: DataFrame, rules=RULES, key: str = "page_id", url: str = "url", broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """(key, host, path, rule, verdict) of every page: the longest fitting rule's verdict, else block if listed, else allow.

    Null URLs and URLs without '://' have empty host and path, fit no rule and are allowed
    unless '' is listed. Repeated rows and null keys each come back; other columns are not read.
    """
    host, path = host_and_path(F.col("_url"))
    urls = pages.select(F.col(key).alias("_key"), F.col(url).alias("_url")).select("_key", host.alias("host"), path.alias("path"), canonical(F.col("_url")).alias("canonical"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    known = listed_among(urls, listed, broadcast_bytes)
    return known.select(F.col("_key").alias(key), "host", "path", rule.alias("rule"), F.coalesce(verdict, F.when(F.col("listed"), "block").otherwise("allow")).alias("verdict"))
