"""Best-fit packing of documents into sequences of a fixed number of tokens, by sums of squares.

A document of more tokens than a sequence holds is cut: its first piece has what is left over, all
others fill a sequence each. The pieces are dealt to shards of a bounded size by a hash. Each shard
is packed in one task, largest pieces first: a piece goes where the sum of the squared counts of
open bins per residual gap becomes smallest, which keeps gaps of all sizes in stock for the pieces
that are still to come. A bin is opened only if the piece fits no gap.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import encoder, slices
from .scratch import materialize

SEQUENCE_TOKENS = 1024
END_ID = 2
#: Pieces in a shard, on average. A shard leaves a few bins open, whatever its size.
SHARD_PIECES = 40_000


def pack(lengths: np.ndarray, capacity: int = SEQUENCE_TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece; the lengths are 1 to ``capacity``. The largest are placed first."""
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # of open bins, by the tokens that they still take
    stock: list[list[int]] = [[] for _ in range(capacity + 1)]
    opened = 0
    for i in np.argsort(-lengths, kind="stable"):
        size = int(lengths[i])
        if size == capacity:
            bins[i] = opened
            opened += 1
            continue
        # Half the change of the sum, for gaps from size up: one bin fewer there, one more at gap - size.
        change = 1 - count[size:capacity]
        change[1:] += count[1 : capacity - size]
        change = np.where(count[size:capacity] > 0, change, np.iinfo(np.int64).max)
        best = int(change.argmin()) if len(change) else 0
        if len(change) and change[best] < np.iinfo(np.int64).max:
            gap = size + best
            at = stock[gap].pop()
            count[gap] -= 1
        else:
            gap, at = capacity, opened
            opened += 1
        bins[i], offsets[i] = at, capacity - gap
        if gap > size:
            count[gap - size] += 1
            stock[gap - size].append(at)
    return bins, offsets


PIECES = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("piece", T.IntegerType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()),
    ]
)


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than a sequence."""
    first = total % capacity or min(total, capacity)
    return [(0, first)] + [(at, capacity) for at in range(first, total, capacity)]


def _decoded(texts: pa.Array) -> list[str]:
    """Texts as str, null as empty. Bytes that are not UTF-8 become U+FFFD; Spark hands them on as they are."""
    try:
        return [x or "" for x in texts.to_pylist()]
    except UnicodeDecodeError:
        return [x.as_buffer().to_pybytes().decode("utf-8", "replace") if x.is_valid else "" for x in texts]


def token_pieces(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = SEQUENCE_TOKENS, end_id: int = END_ID
) -> DataFrame:
    """(id, piece, start, length, ids_crc32) of every piece of every row's tokens and their end.

    Null text is empty: one piece that holds the end alone. Bytes of a text that are not UTF-8 are
    encoded as U+FFFD. Rows that repeat an id are documents of their own, and null ids stay null.
    Other columns are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder()
        for whole in batches:
            for batch in slices(whole):
                rows = []
                for doc, ids in zip(
                    batch["id"].to_pylist(), coder.encode_batch(_decoded(batch["text"])), strict=True
                ):
                    tokens = np.array([*ids, end_id], "<u4")
                    for k, (start, length) in enumerate(cut(len(tokens), capacity)):
                        rows.append((doc, k, start, length, zlib.crc32(tokens[start : start + length].tobytes())))
                columns = zip(*rows, strict=True)
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=PIECES.names
                )

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, PIECES)


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, shard_pieces: int = SHARD_PIECES) -> DataFrame:
    """``pieces`` (id, piece, length, ...) with the sequence that each lies in and its offset there.

    Sequences are numbered by shard and by bin in it. The pieces of a sequence fill it from 0 without a gap.
    No pieces give an empty result.
    """
    pieces = materialize(pieces, "pieces")
    shards = max(1, math.ceil(pieces.count() / shard_pieces))
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )

    def run(shard: pd.DataFrame) -> pd.DataFrame:
        number = int(shard["shard"].iloc[0])
        shard = shard.drop(columns="shard").sort_values(["length", "id", "piece"], ascending=False, na_position="last")
        bins, offsets = pack(shard["length"].to_numpy(np.int64), capacity)
        return shard.assign(sequence_id=(number << 32) + bins, offset=offsets)

    dealt = pieces.withColumn("shard", F.pmod(F.xxhash64("id", "piece", "ids_crc32"), F.lit(shards)))
    return dealt.groupBy("shard").applyInPandas(run, schema)


def pack_documents(docs: DataFrame) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    return pack_pieces(token_pieces(docs)).withColumnRenamed("id", "doc_id")


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens; one row per piece."""
    return pack_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage, the last: the packed pieces of the documents that are left."""
    return pack_documents(docs)
