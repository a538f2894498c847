"""Near-duplicate embeddings by random-hyperplane sign hashing in several tables.

Equal vectors are first folded into one with a weight. Every table hashes a vector to the signs of
its products with random hyperplanes; vectors with the same signs in a table meet in a bucket.
There all cosines are taken in double precision. A pair that meets in several tables counts in the
first of them only, so nothing but a number of links and a spanning forest leaves a bucket: pairs
are never written out. A large bucket is cut into chunks, and pairs of chunks are compared in tasks
of a bounded size. Components are then joined by stars.

Signs per table and the number of tables follow from the number of vectors: buckets of a few
dozen unrelated vectors, and a chance below ``MISS`` that a pair right at the threshold meets in
no table.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .components import connected_components
from .groups import binaries, map_groups
from .scratch import materialize

MIN_COSINE = 0.95
MISS = 1e-6
BUCKET_VECTORS = 64
CHUNK_VECTORS = 1024
SEED = 20_240


def plan_tables(n: int, min_cosine: float = MIN_COSINE, miss: float = MISS) -> tuple[int, int]:
    """(signs, tables) for ``n`` vectors."""
    signs = min(30, max(6, math.ceil(math.log2(max(n, 1) / BUCKET_VECTORS + 1))))
    same = (1 - math.acos(min_cosine) / math.pi) ** signs
    return signs, math.ceil(math.log(miss) / math.log1p(-same))


def hyperplanes(dim: int, signs: int, tables: int) -> np.ndarray:
    return np.random.default_rng([SEED, dim, signs, tables]).standard_normal((dim, tables * signs))


def sign_bits(vectors: np.ndarray, signs: int, tables: int) -> np.ndarray:
    """Whether each product is positive, one row a vector, table after table."""
    return vectors @ hyperplanes(vectors.shape[1], signs, tables) > 0


def codes_of(bits: np.ndarray, signs: int) -> np.ndarray:
    """int32 codes, one row a vector and one column a table."""
    return (bits.reshape(len(bits), bits.shape[1] // signs, signs) * (1 << np.arange(signs))).sum(axis=2).astype(np.int32)


def unit_rows(vectors: np.ndarray) -> np.ndarray:
    """The rows at length 1, in double precision."""
    vectors = vectors.astype("<f8")
    unit = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    return unit / np.linalg.norm(unit, axis=1, keepdims=True)


def star_edges(mask: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, root) of a star on each component of the links in ``mask``; the root is the smallest id."""
    far = np.iinfo(np.int64).max
    a, b = rows.copy(), columns.copy()
    while True:
        low_b = np.minimum(b, np.where(mask, a[:, None], far).min(axis=0, initial=far))
        low_a = np.minimum(a, np.where(mask, low_b[None, :], far).min(axis=1, initial=far))
        if (low_a == a).all() and (low_b == b).all():
            break
        a, b = low_a, low_b
    nodes, roots = np.concatenate([rows, columns]), np.concatenate([a, b])
    moved = nodes != roots
    return nodes[moved], roots[moved]


def _matrix(column: pa.ChunkedArray, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(binaries(column)), dtype).reshape(len(column), -1)


def near_embeddings(
    embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", min_cosine: float = MIN_COSINE
) -> DataFrame:
    """(vec_id, n_links, component_id, kept), one row for each row of ``embeddings``.

    Vectors that are null, empty, zero, or hold null or non-finite components link with nothing, as
    do rows with a null id (whose component_id is null, kept true). Vectors of different lengths
    never link. Equal rows are vectors of their own that link with one another. Rows that share an
    id but not the vector are one node: their links add up. An empty table gives an empty result.
    """
    v = F.col(vector_col).cast("array<double>")
    # Components of single precision are sent as they are; bits of the tables before a bucket's own tell who met there.
    dtype = "<f4" if embeddings.schema[vector_col].dataType == T.ArrayType(T.FloatType()) else "<f8"
    rows = embeddings.select(F.col(id_col).cast("long").alias("id"), v.alias("v"))
    sound = F.coalesce(
        (F.size("v") > 0)
        & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
        & F.exists("v", lambda x: x != 0),
        F.lit(False),
    )
    rows = materialize(
        rows.select("id", F.when(sound & F.col("id").isNotNull(), F.col("v")).alias("v")).withColumn(
            "class", F.when(F.col("v").isNotNull(), F.sha2(F.concat_ws(",", F.col("v").cast("array<string>")), 256))
        ),
        "vectors",
    )
    classes = rows.where("v IS NOT NULL").groupBy("class").agg(
        F.min("id").alias("id"), F.count(F.lit(1)).alias("weight"), F.first("v").alias("v")
    )
    classes = materialize(classes.select("class", "id", "weight", "v"), "vector-classes")
    signs, tables = plan_tables(classes.count(), min_cosine)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = np.array([len(x) for x in whole["v"]], np.int64)
            for dim in np.unique(lengths):
                batch = whole.filter(pa.array(lengths == dim))
                vectors = np.ascontiguousarray(batch["v"].flatten().to_numpy(zero_copy_only=False), "<f8").reshape(-1, dim)
                bits = sign_bits(unit_rows(vectors), signs, tables)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"],
                        batch["weight"],
                        pa.array([int(dim)] * len(vectors), pa.int32()),
                        pa.array([x.tobytes() for x in vectors.astype(dtype)], pa.binary()),
                        pa.array([x.tobytes() for x in np.packbits(bits, axis=1, bitorder="little")], pa.binary()),
                        pa.array(codes_of(bits, signs).tolist(), pa.list_(pa.int32())),
                    ],
                    names=["id", "weight", "dim", "vector", "bits", "code"],
                )

    coded = classes.select("id", "weight", "v").mapInArrow(
        hashed, "id long, weight long, dim int, vector binary, bits binary, code array<int>"
    )
    coded = materialize(coded, "codes")
    in_tables = coded.select("id", "weight", "dim", "vector", "bits", F.posexplode("code").alias("t", "bucket"))
    in_tables = in_tables.withColumn("bits", F.substring("bits", F.lit(1), F.ceil(F.col("t") * signs / 8).cast("int")))
    # The buckets that need several chunks; they are few, and written first, so that the join knows their
    # size and moves no vectors to learn that most buckets aren't among them.
    large = (
        coded.select("dim", F.posexplode("code").alias("t", "bucket"))
        .groupBy("dim", "t", "bucket")
        .count()
        .where(F.col("count") > CHUNK_VECTORS)
        .select("dim", "t", "bucket", F.ceil(F.col("count") / CHUNK_VECTORS).cast("int").alias("chunks"))
    )
    met = in_tables.join(materialize(large, "large-buckets"), ["dim", "t", "bucket"], "left")
    met = met.withColumn("chunks", F.coalesce("chunks", F.lit(1)))
    met = met.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    met = met.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    low, high = F.least("chunk", "other"), F.greatest("chunk", "other")
    met = met.select(
        F.xxhash64("dim", "t", "bucket", low, high).alias("group"),
        "dim", "t", "bucket", low.alias("low"), high.alias("high"),
        "chunk", "id", "weight", "vector", "bits",
    )

    def links(group: pa.Table) -> Iterator[pa.RecordBatch]:
        # Two groups may share a hash: take them apart by what they are.
        parts: dict[tuple, list[int]] = {}
        for i, name in enumerate(zip(*(group[c].to_pylist() for c in ("dim", "t", "bucket", "low", "high")), strict=True)):
            parts.setdefault(name, []).append(i)
        for (_, t, _, low, high), rows in parts.items():
            part = group if len(parts) == 1 else group.take(rows)
            yield from bucket(part, t, low, high)

    def bucket(part: pa.Table, t: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        ids, weights = part["id"].to_numpy(), part["weight"].to_numpy()
        vectors, chunk = unit_rows(_matrix(part["vector"], dtype)), part["chunk"].to_numpy()
        a = np.flatnonzero(chunk == low)
        b = a if low == high else np.flatnonzero(chunk == high)
        mask = vectors[a] @ vectors[b].T >= min_cosine
        if low == high:
            np.fill_diagonal(mask, False)
        if t and mask.any():
            bits = np.unpackbits(_matrix(part["bits"], "u1"), axis=1, bitorder="little")[:, : t * signs]
            codes = codes_of(bits, signs)
        for earlier in range(t):
            if not mask.any():
                return
            mask &= codes[a, earlier][:, None] != codes[b, earlier][None, :]
        if not mask.any():
            return
        found_a = mask @ weights[b]
        nodes, counts = ids[a], found_a
        if low != high:
            nodes, counts = np.concatenate([ids[a], ids[b]]), np.concatenate([found_a, weights[a] @ mask])
        seen = counts > 0
        child, root = star_edges(mask, ids[a], ids[b])
        if low == high:
            child, first = np.unique(child, return_index=True)
            root = root[first]
        none = np.full(len(child), 0)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.concatenate([nodes[seen], child])),
                pa.array(np.concatenate([counts[seen], none])),
                pa.array(np.concatenate([nodes[seen], root])),
            ],
            names=["id", "links", "root"],
        )

    found = materialize(map_groups(met, "group", links, "id long, links long, root long"), "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    components = connected_components(found.where("id <> root"), "id", "root")
    # Members of a class have its links, and one another's.
    per_class = (
        classes.select("class", F.col("id").alias("rep"), "weight")
        .join(counts.withColumnRenamed("id", "rep"), "rep", "left")
        .join(components.withColumnRenamed("node", "rep"), "rep", "left")
        .select(
            "class",
            (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    return (
        rows.select("id", "class")
        .join(per_class, "class", "left")
        .select(
            F.col("id").alias("vec_id"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
            F.coalesce("component_id", "id").alias("component_id"),
        )
        .withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
    )


def op8_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per vector: its links, its component, and whether it is the one that stays."""
    return near_embeddings(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
