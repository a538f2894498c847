"""Quality classifier: a convolutional network over bytes, in numpy.

A text is read as UTF-8 bytes in overlapping chunks that cover all of it. Every filter looks at WIDTH
bytes and has a learned weight for each byte value at each place; its responses are rectified and
max-pooled over a chunk. A chunk's pooled responses give a logit, and the mean of the chunks'
logits, weighted by their lengths, gives one probability.

The network is fitted on the driver to chunks of at most ``MAX_TRAINING_DOCS`` labelled documents
(all of them, or those whose hashed ids are smallest), at most ``MAX_TRAINING_CHUNKS`` each, spaced
evenly over the whole text. Scores read whole texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CHUNK_BYTES = 512
STEP_BYTES = 448  # chunks overlap by the rest
WIDTH = 4
FILTERS = 16
#: Bounds of the training sample.
MAX_TRAINING_DOCS = 2000
MAX_TRAINING_CHUNKS = 4
EPOCHS = 14
MIN_SCORE = 0.3
#: Bytes of a text that are convolved at once.
SEGMENT_CHUNKS = 64


def chunk_starts(size: int) -> np.ndarray:
    """Where the chunks of ``size`` bytes begin; an empty text has one empty chunk."""
    return np.arange(0, max(1, size - (CHUNK_BYTES - STEP_BYTES)), STEP_BYTES)


@dataclass
class Network:
    """``taps[j, byte, f]``: the weight of a byte at place j for filter f."""

    taps: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: float

    def pair_tables(self) -> tuple[np.ndarray, np.ndarray]:
        """The weights of two bytes at a time, indexed by first + 256 * second."""
        first = (self.taps[0][None, :, :] + self.taps[1][:, None, :] + self.bias).reshape(65536, -1)
        second = (self.taps[2][None, :, :] + self.taps[3][:, None, :]).reshape(65536, -1)
        return first.astype(np.float32), second.astype(np.float32)

    def score(self, text: bytes | pa.Buffer, tables: tuple[np.ndarray, np.ndarray]) -> float:
        """The probability of quality 1 of a whole text, in memory that doesn't grow with it."""
        starts, total, weight = chunk_starts(len(text)), 0.0, 0
        for k in range(0, len(starts), SEGMENT_CHUNKS):
            part = starts[k : k + SEGMENT_CHUNKS]
            raw = bytes(text[part[0] : part[-1] + CHUNK_BYTES])
            data = np.frombuffer(raw + b"\0" * WIDTH, np.uint8).astype(np.uint16)
            pairs = data[:-1] + (data[1:] << 8)
            n = max(1, len(raw) - WIDTH + 1)  # windows that lie in the text
            responses = tables[0][pairs[:n]]
            responses += tables[1][pairs[2 : n + 2]]
            for start in part - part[0]:
                length = max(1, min(CHUNK_BYTES, len(raw) - start))
                end = max(start + 1, min(start + CHUNK_BYTES - WIDTH + 1, n))
                begin = min(start, n - 1)
                pooled = np.maximum(responses[begin:end].max(axis=0), 0)
                total += length * float(pooled @ self.out)
                weight += length
        return float(1 / (1 + np.exp(-(total / weight + self.out_bias))))


def fit(chunks: list[list[bytes]], labels: list[int], seed: int = 7) -> Network:
    """Fit a network to documents given as chunks. Without documents of both kinds all scores are alike."""
    rng = np.random.default_rng(seed)
    network = Network(
        rng.normal(0, 0.3, (WIDTH, 256, FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32),
        rng.normal(0, 0.3, FILTERS).astype(np.float32),
        0.0,
    )
    y = np.array(labels, np.float32)
    rate = float(np.clip(y.mean(), 0.01, 0.99)) if len(y) else 0.5
    network.out_bias = float(np.log(rate / (1 - rate)))
    if len(set(labels)) < 2:
        network.out[:] = 0
        return network
    # Chunks as rows of bytes; a window that reaches beyond a chunk never wins.
    flat = [(d, c) for d, doc in enumerate(chunks) for c in doc]
    owner = np.array([d for d, _ in flat])
    length = np.array([max(1, len(c)) for _, c in flat], np.float32)
    weight = length / np.bincount(owner, length, len(chunks))[owner]
    data = np.zeros((len(flat), CHUNK_BYTES), np.uint8)
    for k, (_, c) in enumerate(flat):
        data[k, : len(c)] = np.frombuffer(c, np.uint8)
    first_of = np.searchsorted(owner, np.arange(len(chunks) + 1))
    params = [network.taps, network.bias, network.out, np.array([network.out_bias], np.float32)]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step, windows = 0, CHUNK_BYTES - WIDTH + 1
    for epoch in range(EPOCHS):
        order = rng.permutation(len(chunks))
        for at in range(0, len(order), 32):
            docs = order[at : at + 32]
            rows = np.concatenate([np.arange(first_of[d], first_of[d + 1]) for d in docs])
            group = np.repeat(np.arange(len(docs)), [first_of[d + 1] - first_of[d] for d in docs])
            x = data[rows]
            valid = np.maximum(1, length[rows].astype(int) - WIDTH + 1)
            responses = params[0][0][x[:, :windows]]
            for j in range(1, WIDTH):
                responses += params[0][j][x[:, j : windows + j]]
            responses[np.arange(windows)[None, :] >= valid[:, None]] = -1e9
            peak = responses.argmax(axis=1)
            pooled = np.take_along_axis(responses, peak[:, None, :], 1)[:, 0, :] + params[1]
            active = pooled > 0
            pooled = pooled * active
            share = weight[rows]
            doc_pooled = np.zeros((len(docs), FILTERS), np.float32)
            np.add.at(doc_pooled, group, pooled * share[:, None])
            error = (1 / (1 + np.exp(-(doc_pooled @ params[2] + params[3][0]))) - y[docs]) / len(docs)
            back = error[group, None] * share[:, None] * params[2][None, :] * active
            grads = [np.zeros_like(params[0]), back.sum(axis=0), error @ doc_pooled + 1e-4 * params[2], np.array([error.sum()])]
            filters = np.broadcast_to(np.arange(FILTERS), peak.shape)
            for j in range(WIDTH):
                np.add.at(grads[0][j], (np.take_along_axis(x, peak + j, 1), filters), back)
            step += 1
            speed = 0.02 * (1 - epoch / EPOCHS)
            for p, g, (m, v) in zip(params, grads, moments, strict=True):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                p -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    network.taps, network.bias, network.out, network.out_bias = *params[:3], float(params[3][0])
    return network


def held_out(doc_id: Column) -> Column:
    """Whether a document's label is never learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _bytes_of(texts: pa.Array) -> Iterator[bytes | pa.Buffer]:
    """The bytes of each text as they are, also where they are not UTF-8; none for null."""
    return (x.as_buffer() if x.is_valid else b"" for x in texts)


def _training_chunks(text: bytes | pa.Buffer) -> list[bytes]:
    starts = chunk_starts(len(text))
    if len(starts) > MAX_TRAINING_CHUNKS:
        starts = starts[np.linspace(0, len(starts) - 1, MAX_TRAINING_CHUNKS).round().astype(int)]
    return [bytes(text[s : s + CHUNK_BYTES]) for s in starts]


def train(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_TRAINING_DOCS) -> Network:
    """Fit a network to ``labels`` (doc_id, quality) of ``docs`` (doc_id, text), without those held out.

    At most ``max_docs`` documents are used, those with the smallest hashes of their ids. A label
    that is null, or given twice with different values, is not used.
    """
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("id"), F.col("quality").cast("int").alias("quality"))
        .where(F.col("id").isNotNull() & F.col("quality").isin(0, 1) & ~held_out(F.col("id")))
        .groupBy("id")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("most"))
        .where("quality = most")
        .orderBy(F.xxhash64("id"), "id")
        .limit(max_docs)
        .select("id", "quality")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            chunks = [_training_chunks(x) for x in _bytes_of(batch["text"])]
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["quality"], pa.array(chunks, pa.list_(pa.binary()))], names=["id", "quality", "chunks"]
            )

    texts = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    # max_docs ids at most are broadcast, and as many documents collected, in chunks of a bounded size.
    sample = texts.join(F.broadcast(chosen), "id").mapInArrow(run, "id long, quality int, chunks array<binary>")
    sample = sample.groupBy("id").agg(F.min("quality").alias("quality"), F.min("chunks").alias("chunks"))
    rows = sorted((r.id, r.quality, [bytes(c) for c in r.chunks]) for r in sample.toLocalIterator())
    return fit([c for _, _, c in rows], [q for _, q, _ in rows])


def score_texts(docs: DataFrame, network: Network) -> DataFrame:
    """``docs`` and a column ``score``. Null text scores as empty.

    Only texts go to Python, and one number a row comes back; all other columns stay in the JVM. A column of
    ``docs`` that is called score is replaced.
    """

    @F.arrow_udf(T.DoubleType())
    def score(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tables = network.pair_tables()
        for batch in texts:
            yield pa.array((network.score(x, tables) for x in _bytes_of(batch)), pa.float64())

    return docs.withColumn("score", score(F.col("text").cast("string")))


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: held_out, score, and predicted (score of at least 0.3)."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    network = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_texts(docs.select("doc_id", "text"), network).select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= MIN_SCORE).cast("int").alias("predicted"),
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: the documents that the classifier takes for quality 1.

    The network learns from the labels of all documents, so that it doesn't depend on what an
    earlier stage left.
    """
    network = train(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    rows = docs.select(F.struct("*").alias("row"), F.col("text"))
    return score_texts(rows, network).where(F.col("score") >= MIN_SCORE).select("row.*")
