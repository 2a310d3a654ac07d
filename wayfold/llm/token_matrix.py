"""Packed token-id matrices: best-fit-decreasing packing, segment lengths and position resets.

Pieces of at most `capacity` ids (longer texts are cut losslessly) are packed by
packing.best_fit_decreasing, whose open sequences are found through a segment tree over
capacities. Pieces are ranked without a sort of the data, and ids are shuffled once, to their
sequences. Rows are matrices'
rows: ids as little-endian unsigned integers, padded to the full width; the lengths' running
sums tell the segments, and positions start anew where each begins.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wayfold.llm import tokens
from wayfold.llm.common import new_path, stored
from wayfold.llm.packing import best_fit_decreasing, placed, ranked

CAPACITY = 4096
#: Of pieces and matrices: ids hardly shrink by anything faster.
CODEC = "zstd"


def matrices(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """A row for each sequence: sequence_id, n_tokens, width (bytes of an id), ids, cu_lengths, resets, keys, pieces.

    ids holds capacity ids, pad_id beyond n_tokens. cu_lengths: 0 and each segment's end;
    resets: where position 0 recurs. keys and pieces name the segments, in order. Every piece
    of every row is in exactly one sequence: null texts (their end id alone), null keys and
    repeated rows too. An empty table has no sequences.
    """
    width = tokens.id_bytes(path)
    made = stored(tokens.pieces(docs, path, key, text, capacity, with_ids=True, ranked=True), "matrix-pieces", CODEC)
    own, histogram = ranked(made)
    laid = placed(own.select(F.col(key).alias("key"), "piece", "length", "ids", "_rank"), best_fit_decreasing(histogram, capacity))
    parts = F.sort_array(F.collect_list(F.struct("offset", "length", "key", "piece", "ids")))  # a sequence's pieces: capacity ids at most
    rows = laid.groupBy("sequence_id").agg(parts.alias("_x"))
    ends = F.transform("_x", lambda x: (x["offset"] + x["length"]).cast("int"))
    joined = F.aggregate("_x", F.lit(b"").cast("binary"), lambda all_, x: F.concat(all_, x["ids"]))
    padding = pad_id.to_bytes(width, "little")
    return rows.select(
        "sequence_id",
        F.element_at(ends, -1).alias("n_tokens"),
        F.lit(width).alias("width"),
        F.rpad(joined, F.lit(capacity * width), F.lit(padding)).alias("ids"),
        F.concat(F.array(F.lit(0)), ends).alias("cu_lengths"),
        F.transform("_x", lambda x: x["offset"].cast("int")).alias("resets"),
        F.transform("_x", lambda x: x["key"]).alias("keys"),
        F.transform("_x", lambda x: x["piece"]).alias("pieces"),
    )


def write(rows: DataFrame, path: str) -> None:
    """Write matrices' rows as Parquet: a row's ids are one binary value, so as_numpy() takes a file's rows back at once."""
    rows.write.option("compression", CODEC).parquet(path)


def written(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """matrices() of docs, written to the shared folder and read back."""
    to = new_path(docs.sparkSession, "matrices")
    write(matrices(docs, path, key, text, capacity), to)
    return read_matrix(docs.sparkSession, to)


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def as_numpy(ids: list[bytes], width: int) -> np.ndarray:
    """The id matrix of some rows."""
    return np.frombuffer(b"".join(ids), f"<u{width}").reshape(len(ids), -1) if ids else np.zeros((0, 0), f"<u{width}")


def positions(cu_lengths: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """Position ids of one row: they start anew with each segment, and stay 0 in the padding."""
    out = np.zeros(capacity, np.int64)
    lengths = np.diff(cu_lengths)
    out[: cu_lengths[-1]] = np.arange(cu_lengths[-1]) - np.repeat(cu_lengths[:-1], lengths)
    return out
