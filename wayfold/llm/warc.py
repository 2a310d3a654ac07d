"""WARC archives with revisit records, and capture histories by external index merge.

Records are laid out natively; tasks make a gzip member of each and hand Spark's text writer chunks of
members, so any store that Spark writes to will do and commits are atomic by task. Files are bounded
in bytes, begin with a warcinfo record and end in .warc.gz; the writer's line separator is an
empty gzip member. Only digests and ids are shuffled to tell revisits. Files are read as streams of
lines that Spark inflates: records are put together by Content-Length, every payload is checked
against its digest, and each file's captures are sorted: a run. Runs meet in key ranges (quantiles of a
bounded sample over URL key, timestamp, id, run and place, so neither a hot URL nor repeated rows
fall in one range), where a loser tree merges them; ranges end to end are the globally ordered
capture histories.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm.common import new_path, released, small_batches, stored

#: Payloads of at least this many bytes are revisited; smaller ones are always responses.
LEAST_BYTES = 0
#: Revisits that are broadcast to the pages at most (about 100 bytes each); more are joined by shuffle.
BROADCAST_REVISITS = 200_000
#: Compressed bytes of a chunk of members, above which it is closed, and chunks in one file: a file has some 64 MB.
CHUNK_BYTES, FILE_CHUNKS = 4 << 20, 16
#: Captures wanted in one range; keys sampled for each border, and for all at most (about 100 bytes each).
RANGE_ROWS, BORDER_KEYS, SAMPLE_KEYS = 20_000, 16, 1_000_000
#: Between a file's chunks: a gzip member of nothing.
EMPTY_MEMBER = bytes.fromhex("1f8b08000000000000ff" "0300" "0000000000000000")
END = b"\r\n\r\n"
CRAWL_START = 1704067200  # 2024-01-01
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

CAPTURE = "page_id long, urlkey string, timestamp long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def base32_of_hex(digest: Column) -> Column:
    """Bare base32 of a 160-bit hex string: each 20 bits are five hex digits and four characters."""
    parts = []
    for i in range(8):
        value = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        parts += [F.substring(F.lit(_BASE32), F.shiftright(value, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*parts)


def records(pages: DataFrame, least_bytes: int = LEAST_BYTES, broadcast_revisits: int = BROADCAST_REVISITS) -> DataFrame:
    """(record): the text of each page's WARC record, without its closing line ends.

    Null html is an empty payload. Of equal payloads of least_bytes or more, the rows with the
    smallest non-null page_id are responses, those with larger ids revisit it; rows with a null
    page_id are responses. The capture time is CRAWL_START plus page_id seconds (the table has
    none). A URL's line ends are percent-encoded.
    """
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    own = base.withColumn("digest", F.sha1(F.col("html").cast("binary"))).withColumn("bytes", F.octet_length("html"))
    groups = own.filter(F.col("bytes") >= least_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    firsts = stored(groups.filter("n > 1 and first is not null").select("digest", "first"), "warc-firsts")
    side = firsts.withColumnRenamed("digest", "_digest")
    side = F.broadcast(side) if firsts.count() <= broadcast_revisits else side
    told = own.join(side, F.col("digest") == F.col("_digest"), "left").withColumn("refers", F.when(F.col("page_id") > F.col("first"), F.col("first")))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.concat(http, F.when(F.col("refers").isNull(), F.col("html")).otherwise(""))
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    url = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    when = F.date_format(F.timestamp_seconds(F.lit(CRAWL_START) + F.coalesce("page_id", F.lit(0))), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    revisit = F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers").cast("string"), F.lit(">\r\n"))
    head = [F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("refers").isNull(), "response").otherwise("revisit"), F.lit("\r\nWARC-Record-ID: <urn:page:"), page, F.lit(">\r\nWARC-Date: "), when, F.lit("\r\nWARC-Target-URI: "), url, F.lit("\r\nWARC-Payload-Digest: sha1:"), base32_of_hex(F.col("digest")), F.lit("\r\n"), F.coalesce(revisit, F.lit("")), F.lit("Content-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"), F.lit("\r\n\r\n"), block]
    return told.select(F.concat(*head).alias("record"))


def member(record: bytes) -> bytes:
    """A record and its closing line ends as a gzip member."""
    return gzip.compress(record + END, 6, mtime=0)


def warcinfo(name: str) -> bytes:
    """The record that a file begins with."""
    fields = b"software: wayfold\r\nformat: WARC File Format 1.1\r\n"
    head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:warcinfo:{name}>\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(fields)}\r\n\r\n"
    return head.encode() + fields


def write(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, chunk_bytes: int = CHUNK_BYTES, file_chunks: int = FILE_CHUNKS) -> None:
    """Write a record for each page, each a gzip member, as .warc.gz files in the folder path.

    A task holds one chunk at a time: chunk_bytes and one record at most. The driver gives the files
    their endings when all are written.
    """
    spark = pages.sparkSession
    small_batches(spark)

    def chunks(batches):
        task, number, held, size = TaskContext.get().partitionId(), 0, [], 0
        for batch in batches:
            for record in batch.column(0):
                if not held and number % file_chunks == 0:  # the writer begins a file every file_chunks rows
                    held.append(member(warcinfo(f"{task}-{number // file_chunks}")))
                held.append(member(record.as_buffer().to_pybytes()))
                size += len(held[-1])
                if size >= chunk_bytes:
                    yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["chunk"])
                    number, held, size = number + 1, [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([b"".join(held)], pa.binary())], names=["chunk"])
        released()

    made = records(pages, least_bytes).select(F.col("record").cast("binary").alias("record")).mapInArrow(chunks, "chunk binary")
    writer = made.select(F.col("chunk").cast("string")).write.option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1")
    writer.option("maxRecordsPerFile", file_chunks).text(path)
    paths = spark._jvm.org.apache.hadoop.fs.Path
    store = paths(path).getFileSystem(spark._jsc.hadoopConfiguration())
    for file in store.globStatus(paths(f"{path}/part-*.txt")):
        store.rename(file.getPath(), paths(path, file.getPath().getName().removesuffix(".txt") + ".warc.gz"))


def surt(url: str) -> str:
    """Sort-friendly URL key: host labels reversed, lower case, then path and query without fragment."""
    rest = url.partition("://")[2] or url
    host = re.match(r"[^/?#]*", rest)[0]
    tail = rest[len(host) :].partition("#")[0].lower()
    labels = host.lower().removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + (tail or "/")


class Parser:
    """Headers and block of each record of an uncompressed WARC stream that comes in parts; holds one record and a part at most."""

    def __init__(self):
        self.parts, self.size, self.headers, self.wanted = [], 0, None, 0

    def feed(self, data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
        self.parts.append(data)
        self.size += len(data)
        while self.size > len(END) and self.size >= self.wanted:
            whole = b"".join(self.parts)
            if self.headers is None:
                end = whole.find(END)
                if not whole.startswith(b"WARC/"):
                    raise ValueError(f"no WARC record: {whole[:40]!r}")
                if end < 0:
                    self.parts = [whole]
                    return
                lines = whole[:end].decode("utf-8", "surrogateescape").split("\r\n")[1:]
                self.headers = {name.lower(): value.strip() for name, _, value in (line.partition(":") for line in lines)}
                self.wanted, rest = int(self.headers["content-length"]) + len(END), whole[end + len(END) :]
            else:
                size = self.wanted - len(END)
                if whole[size : self.wanted] != END:
                    raise ValueError("a record doesn't end as it should")
                yield self.headers, whole[:size]
                self.headers, self.wanted, rest = None, 0, whole[size + len(END) :]
            self.parts, self.size = [rest], len(rest)

    def close(self) -> None:
        """At the stream's end; the line end that a reader of lines adds to the last one is left over."""
        if self.headers is not None or b"".join(self.parts) not in (b"", END):
            raise ValueError("an archive ends within a record")


def capture(headers: dict[str, str], block: bytes) -> tuple | None:
    """The CAPTURE row of a record, None for other kinds. Raises if a response's payload doesn't match its digest."""
    if headers["warc-type"] not in ("response", "revisit"):
        return None
    http, _, payload = block.partition(END)
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest = headers["warc-payload-digest"].removeprefix("sha1:")
    if headers["warc-type"] == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {headers['warc-record-id']} doesn't match its digest")
    ids = [re.search(r"urn:page:(-?\d+)", headers.get(h, "")) for h in ("warc-record-id", "warc-refers-to")]
    page, refers = (int(m[1]) if m else None for m in ids)
    when = int(np.datetime64(headers["warc-date"].removesuffix("Z"), "s").astype(np.int64))
    return page, surt(headers["warc-target-uri"]), when, size, digest, headers["warc-type"], refers


def _order(row: tuple) -> tuple:
    return row[1], row[2], row[0] is not None, row[0] or 0


class LoserTree:
    """k-way merge of sorted runs: each inner node keeps the loser of its match, so a pop replays one path."""

    def __init__(self, runs: list[list]):
        self.runs, self.at = runs, [0] * len(runs)
        self.k = max(1, len(runs))
        self.losers = [-1] * self.k
        for run in range(len(runs)):
            self._play(run)

    def _beats(self, a: int, b: int) -> bool:
        """Whether run a's head comes before run b's; exhausted runs come last, ties go to the earlier run."""
        heads = [self.runs[r][self.at[r]] if self.at[r] < len(self.runs[r]) else None for r in (a, b)]
        if heads[0] is None or heads[1] is None:
            return heads[1] is None and (heads[0] is not None or a < b)
        return (heads[0], a) < (heads[1], b)

    def _play(self, run: int) -> None:
        node = (run + self.k) // 2
        while node:
            other = self.losers[node]
            if other < 0:  # the first to come waits for its opponent
                self.losers[node] = run
                return
            if self._beats(other, run):
                self.losers[node], run = run, other
            node //= 2
        self.losers[0] = run

    def __iter__(self) -> Iterator[tuple[int, int]]:
        """(run, position) in merged order."""
        for _ in range(sum(map(len, self.runs))):
            run = self.losers[0]
            yield run, self.at[run]
            self.at[run] += 1
            self._play(run)


def read_runs(spark: SparkSession, path: str) -> DataFrame:
    """CAPTURE rows of all archives in path, with run (the file) and seq (the place in its sorted run).

    A file is inflated and parsed as it is read, by one task; what a task holds is a record, a
    batch of lines and its file's captures, whose number the file's bytes bound.
    """
    small_batches(spark)
    lines = spark.read.option("lineSep", END.decode()).option("pathGlobFilter", "*.warc.gz").text(path)
    lines = lines.select(F.xxhash64("_metadata.file_path").alias("run"), F.col("value").cast("binary").alias("value"))
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def sorted_run(name: int, parser: Parser, rows: list[tuple]) -> pa.RecordBatch:
        parser.close()
        rows.sort(key=_order)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * len(kinds)
        arrays = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.int64()), pa.array(range(len(rows)), pa.int64()), *arrays], names=["run", "seq", *_NAMES])

    def run(batches):
        name, parser, rows = None, Parser(), []
        for batch in batches:
            for own, value in zip(batch.column("run").to_pylist(), batch.column("value"), strict=True):
                if own != name:
                    if name is not None:
                        yield sorted_run(name, parser, rows)
                    name, parser, rows = own, Parser(), []
                rows += [x for r in parser.feed(value.as_py() + END) if (x := capture(*r))]
        if name is not None:
            yield sorted_run(name, parser, rows)
        released()

    return lines.mapInArrow(run, f"run long, seq long, {CAPTURE}")


_NAMES = [c.split()[0] for c in CAPTURE.split(", ")]


def merged_index(runs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """CAPTURE rows with range and position: ordered by (range, position), captures are ordered by URL key, timestamp and id.

    Null ids come first among equal keys; ties go by run and place in it, and may span ranges.
    """
    n = runs.count()
    parts = max(1, -(-n // range_rows))
    rate = min(1.0, min(SAMPLE_KEYS, BORDER_KEYS * parts) / max(1, n))
    draw = F.pmod(F.xxhash64("run", "seq", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keys = sorted((r["urlkey"], r["timestamp"], r["page_id"] is not None, r["page_id"] or 0, r["run"], r["seq"]) for r in runs.filter(draw < rate).select("urlkey", "timestamp", "page_id", "run", "seq").collect())
    parts = max(1, min(parts, len(keys)))
    borders = runs.sparkSession.sparkContext.broadcast([keys[len(keys) * i // parts] for i in range(1, parts)])

    def place(batches):
        from bisect import bisect_right

        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("urlkey", "timestamp", "page_id", "run", "seq")), strict=True)
            found = [bisect_right(borders.value, (u, t, p is not None, p or 0, r, s)) for u, t, p, r, s in rows]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int32())], names=[*batch.schema.names, "range"])

    def merge(table):
        order = np.lexsort((table["seq"].to_numpy(), table["run"].to_numpy()))
        table = table.take(pa.array(order))
        run = table["run"].to_numpy()
        starts = np.flatnonzero(np.concatenate(([True], run[1:] != run[:-1]))).tolist()
        rows = list(zip(*(table[c].to_pylist() for c in ("urlkey", "timestamp", "page_id")), strict=True))
        keys = [(u, t, p is not None, p or 0) for u, t, p in rows]
        own = [keys[a:b] for a, b in zip(starts, [*starts[1:], len(keys)], strict=True)]
        at = pa.array([starts[r] + i for r, i in LoserTree(own)], pa.int64())
        return table.take(at).select([*_NAMES, "range"]).append_column("position", pa.array(np.arange(len(keys))))

    ranged = runs.mapInArrow(place, f"run long, seq long, {CAPTURE}, range int")
    return ranged.groupBy("range").applyInArrow(merge, f"{CAPTURE}, range int, position long")


def archived(pages: DataFrame, least_bytes: int = LEAST_BYTES, path: str | None = None) -> DataFrame:
    """Write archives of pages, read them back, and return the merged index of all captures, a row for each page."""
    spark = pages.sparkSession
    path = path or new_path(spark, "warc")
    write(pages, path, least_bytes)
    return merged_index(stored(read_runs(spark, path), "warc-runs"))
