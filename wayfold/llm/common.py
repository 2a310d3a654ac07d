"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of text that one numpy pass works on; a single longer text is a slice of its own.
SLICE_BYTES = 2 << 20
#: Bytes that Spark sends to a Python worker at once; rows of long texts would else make very large batches.
BATCH_BYTES = "8m"
#: Rows of one key that one task joins at least; keys that can be hot at most (see spread_join).
HOT_ROWS, HOT_KEYS = 1000, 1000
#: Sampled texts that one task turns into statistics.
TEXTS_A_TASK = 128


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, else one made for a session in one process."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="wayfold-"))
        base = spark.sparkContext.getCheckpointDir()
    return base.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/wayfold/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, codec: str = "snappy") -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark, path = df.sparkSession, new_path(df.sparkSession, label)
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(df: DataFrame) -> None:
    """Delete a table that stored() wrote and nothing reads any more."""
    spark, path = df.sparkSession, df.stored_path
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def slices(batches: Iterable[pa.RecordBatch], column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut record batches so that the text of each slice is about limit bytes at most."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).cumsum()
        start = 0
        while start < batch.num_rows:
            base = size[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(size, base + limit, side="right")))
            yield batch.slice(start, end - start)
            start = end


def small_batches(spark: SparkSession) -> None:
    """Bound what the session hands to Python workers at once."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def released() -> None:
    """Give memory that a task has freed back to the system: workers are reused and would keep it between tasks."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def annotated(df: DataFrame, column: str, fields: list[T.StructField], fn: Callable[[pa.Array], list]) -> DataFrame:
    """df and more columns that fn computes from the text column, slice by slice.

    No shuffle: rows go through Arrow where they lie. fn gets one Arrow string array (nulls
    included) and returns one array for each field. A column of df whose name, in any case,
    equals that of a new field is replaced.
    """
    small_batches(df.sparkSession)
    taken = {f.name.lower() for f in fields} - {column.lower()}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])
    schema = T.StructType([*df.schema.fields, *fields])
    names = [f.name for f in schema.fields]
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, column):
            made = fn(part.column(column))
            extra = [x if isinstance(x, pa.Array) else pa.array(x, kind, from_pandas=True) for x, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*part.columns, *extra], names=names)
        released()

    return df.mapInArrow(run, schema)


def word_codes(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Words between ASCII white space: distinct words, each word's index in them, and each text's bounds."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat, bounds = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    bounds = bounds - bounds[0]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    vocabulary = coded.dictionary
    empty = pc.index(vocabulary, pa.scalar("", vocabulary.type)).as_py() if len(vocabulary) else -1
    if empty >= 0:
        full = codes != empty
        bounds = np.concatenate(([0], np.cumsum(full)))[bounds]
        codes = codes[full]
    return vocabulary, codes, bounds


def per_row(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of values between bounds; works for empty rows and for matrices."""
    total = np.concatenate((np.zeros((1, *values.shape[1:]), values.dtype), np.cumsum(values, axis=0)))
    return total[bounds[1:]] - total[bounds[:-1]]


def string_bytes(strings: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an Arrow string array end to end, and each string's bounds in them."""
    binary = strings.cast(pa.large_binary())
    _, offsets, data = binary.buffers()
    bounds = np.frombuffer(offsets, np.int64, len(binary) + 1, binary.offset * 8)
    raw = np.frombuffer(data, np.uint8)[bounds[0] : bounds[-1]] if data is not None and len(binary) else np.zeros(0, np.uint8)
    return raw, bounds - bounds[0]


def gathered(bounds: np.ndarray, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that lay the segments named by codes end to end, and the bounds of the result."""
    return gathered_ranges(bounds[:-1][codes], bounds[1:][codes])


def gathered_ranges(starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices that lay ranges end to end, and the bounds of the result."""
    lengths = stops - starts
    ends = np.concatenate(([0], np.cumsum(lengths)))
    return np.repeat(starts - ends[:-1], lengths) + np.arange(ends[-1]), ends


class WordCache:
    """Rows of numpy arrays that were computed for words seen before, in this process; holds `limit` words at most.

    make(words) returns one array whose rows belong to the words, or the values of all words
    end to end and the bounds of each one's.
    """

    def __init__(self, make: Callable[[list[str]], np.ndarray | tuple[np.ndarray, np.ndarray]], limit: int = 300_000):
        self.make, self.limit = make, limit
        self.index: dict[str, int] = {}
        self.values: np.ndarray | None = None
        self.bounds = np.zeros(1, np.int64)

    def rows(self, words: list[str]) -> np.ndarray:
        """Each word's row number in values, or segment number in bounds."""
        if len(self.index) + len(words) > self.limit and self.index:
            self.index, self.values, self.bounds = {}, None, np.zeros(1, np.int64)
        found = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        missing = np.flatnonzero(found < 0).tolist()
        if missing:
            new = list(dict.fromkeys(words[i] for i in missing))
            made = self.make(new)
            values = made[0] if isinstance(made, tuple) else made
            if isinstance(made, tuple):
                self.bounds = np.concatenate((self.bounds, made[1][1:] + self.bounds[-1]))
            self.values = values if self.values is None else np.concatenate((self.values, values))
            first = len(self.index)
            self.index.update(zip(new, range(first, first + len(new)), strict=True))
            found[missing] = range(first, first + len(new)) if len(new) == len(missing) else [self.index[words[i]] for i in missing]
        return found


def spread_join(rows: DataFrame, side: DataFrame, key: str, total: int, size: str = "_n") -> DataFrame:
    """rows joined with side by key, where a hot key's rows are dealt over several tasks.

    side has a row for each key, with the number of rows it meets in the column size; total is the
    number of rows. A key of over HOT_ROWS rows, or over 1 / HOT_KEYS of all, gets salts: there are
    fewer than HOT_KEYS such keys, so they are broadcast to tell the rows, and only their rows of side repeat.
    """
    bar = max(HOT_ROWS, total // HOT_KEYS)
    hot = side.filter(F.col(size) > bar).select(key, F.ceil(F.col(size) / bar).alias("_salts"))
    dealt = rows.join(F.broadcast(hot), key, "left").withColumn("_salt", F.coalesce(F.pmod(F.monotonically_increasing_id(), F.col("_salts")), F.lit(0))).drop("_salts")
    salts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col(size) / bar), F.lit(1)) - 1))
    return dealt.join(side.withColumn("_salt", salts).drop(size), [key, "_salt"]).drop("_salt")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, most: int, seed: int = 29) -> DataFrame:
    """(doc_id, text, label): at most `most` labelled ids of each class, drawn by a hash, each with one text.

    Null ids and labels are left out, and ids that are labelled both 0 and 1. Where a doc_id is
    repeated in docs, the text with the least hash counts, so no number of repeated rows makes the
    sample larger. The driver gets about twice the sample's ids; the ids are broadcast to the texts,
    and only the sample's texts are shuffled.
    """
    spark = docs.sparkSession
    rows = labels.select(F.col("doc_id").alias("doc_id"), F.col(label).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)")
    told = rows.groupBy("doc_id").agg(F.min("label").alias("label"), F.max("label").alias("_most")).filter("label = _most").select("doc_id", "label")
    counts = {r["label"]: r["n"] for r in told.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    hashed = told.withColumn("_h", F.xxhash64(F.lit(seed), F.col("doc_id")))
    rate = [min(1.0, (2 * most + 64) / max(1, counts.get(c, 0))) for c in (0, 1)]
    draw = F.pmod("_h", F.lit(1 << 30)) / F.lit(float(1 << 30))
    drawn = sorted((r["_h"], r["doc_id"], r["label"]) for r in hashed.filter(draw < F.when(F.col("label") == 1, rate[1]).otherwise(rate[0])).collect())
    kept = [(i, c) for own in (0, 1) for _, i, c in [r for r in drawn if r[2] == own][:most]]
    chosen = spark.createDataFrame(kept, told.schema)
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "label")
    one = texts.agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("_t")).select("doc_id", F.col("_t.text").alias("text"), "label")
    return one.repartition(1 + len(kept) // TEXTS_A_TASK, "doc_id")


__all__ = ["WordCache", "annotated", "discard", "gathered", "gathered_ranges", "labelled_sample", "new_path", "per_row", "released", "shared_dir", "slices", "small_batches", "spread_join", "stored", "string_bytes", "word_codes"]
