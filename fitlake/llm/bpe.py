"""BPE encoding and decoding by tree concatenation.

A long text is cut into halves until the parts are short; the parts are encoded in parallel, and
neighbours are joined up the tree. At a join the tokens next to the cut may be wrong, because a
merge could span it. So a window around the cut is encoded again, and grows until both sides agree
with it exactly; then the tokens before it, those of the window and those after it are the tokens
of the joined text.

A side of the window agrees in one of two ways:

* It ends at a place where the splitting pattern of the vocabulary always splits, whatever stands
  around it (``_certain_split``). Merges never cross such a place.
* It ends inside a run of one kind of characters, which is one unit for the merges, and the
  window's outermost token is the same token at the same place as before. Tokens are those of a
  byte pair encoding exactly if each pair of neighbours is, so the concatenation is exact.

The result equals that of the ``tokenizers`` library with the same vocabulary, also for texts that
contain the string of a special token.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Characters in a leaf of the tree, and in the first window on each side of a join.
LEAF_CHARS = 4096
WINDOW_CHARS = 32
#: Fixed values of the vocabulary.
SPECIAL_TOKEN = "<|endoftext|>"
SPECIAL_ID = 50256
CERTAIN_SPACE = " \t\n\r"


def vocabulary_path() -> str:
    """Where the rank file of the vocabulary is, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


def _kind(char: str) -> str:
    """L letter, N number, O other, S space; ? where libraries could disagree."""
    if char in CERTAIN_SPACE:
        return "S"
    category = unicodedata.category(char)
    if category[0] in "LN":
        return category[0]
    return "O" if category[0] in "PSM" else "?"


def _certain_split(before: str, after: str) -> bool:
    """Whether the pattern splits between the two characters in any surroundings.

    No unit of the pattern goes on from a letter, number or other sign to a different kind, but
    for an apostrophe with letters after it. A space may belong to what follows it.
    """
    a, b = _kind(before), _kind(after)
    return a in "LNO" and b != "?" and a != b and before != "'"


class Encoder:
    """Encodes and decodes with a rank file."""

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS, window_chars: int = WINDOW_CHARS, threads: int = 2):
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.plain = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}
        )
        self.token_bytes = {rank: token for token, rank in ranks.items()} | {SPECIAL_ID: SPECIAL_TOKEN.encode()}
        self.leaf_chars, self.window_chars, self.threads = leaf_chars, window_chars, threads

    def _left(self, text: str, ids: list[int], reach: int) -> tuple[int, int, bool]:
        """(characters, tokens, certain) of the window's part before the join, at least ``reach`` characters if it can."""
        n = len(text)
        for at in range(n - 1, max(0, n - reach), -1):
            if _certain_split(text[at - 1], text[at]):
                return n - at, self._tokens_of(ids, len(text[at:].encode()), True), True
        if reach >= n:
            return n, len(ids), True
        kind = _kind(text[-1])
        if kind in "LNO":
            size, tokens = 0, 0
            wanted = len(text[n - reach :].encode())
            while size < wanted and tokens < len(ids):
                tokens += 1
                size += len(self.token_bytes[ids[-tokens]])
            part = text.encode()[-size:].decode("utf-8", "replace")
            if tokens < len(ids) and text.endswith(part) and part[0] != "'" and all(_kind(c) == kind for c in part):
                return len(part), tokens, False
        return -1, -1, False

    def _right(self, text: str, ids: list[int], reach: int) -> tuple[int, int, bool]:
        """The same of its part after the join."""
        n = len(text)
        for at in range(1, min(n, reach)):
            if _certain_split(text[at - 1], text[at]):
                return at, self._tokens_of(ids, len(text[:at].encode()), False), True
        if reach >= n:
            return n, len(ids), True
        kind = _kind(text[0])
        if kind in "LNO":
            size, tokens = 0, 0
            wanted = len(text[:reach].encode())
            while size < wanted and tokens < len(ids):
                size += len(self.token_bytes[ids[tokens]])
                tokens += 1
            part = text.encode()[:size].decode("utf-8", "replace")
            if tokens < len(ids) and text.startswith(part) and all(_kind(c) == kind for c in part):
                return len(part), tokens, False
        return -1, -1, False

    def _tokens_of(self, ids: list[int], size: int, at_end: bool) -> int:
        """How many tokens at an end of ``ids`` have ``size`` bytes."""
        tokens = 0
        while size > 0:
            tokens += 1
            size -= len(self.token_bytes[ids[-tokens] if at_end else ids[tokens - 1]])
        if size:
            raise ValueError("a certain split lies inside a token")
        return tokens

    def join(self, left: str, left_ids: list[int], right: str, right_ids: list[int]) -> list[int]:
        """The tokens of ``left + right`` from those of each."""
        if not left or not right:
            return left_ids or right_ids
        reach = self.window_chars
        while True:
            chars, before, sure_before = self._left(left, left_ids, reach)
            more, after, sure_after = self._right(right, right_ids, reach)
            if chars >= 0 and more >= 0:
                window = self.plain.encode_ordinary(left[len(left) - chars :] + right[:more])
                if (sure_before or window[0] == left_ids[len(left_ids) - before]) and (
                    sure_after or window[-1] == right_ids[after - 1]
                ):
                    return left_ids[: len(left_ids) - before] + window + right_ids[after:]
            reach *= 2

    def _tree(self, nodes: list[tuple[str, list[int]]]) -> list[int]:
        while len(nodes) > 1:
            nodes = [
                (a[0] + b[0], self.join(*a, *b)) for a, b in zip(nodes[::2], nodes[1::2], strict=False)
            ] + nodes[len(nodes) & ~1 :]
        return nodes[0][1]

    def encode_batch(self, texts: list[str]) -> list[list[int]]:
        """The ids of each text; the leaves of all of them are encoded together."""
        plans, leaves = [], []
        for text in texts:
            parts = []
            for part in text.split(SPECIAL_TOKEN):
                n = max(1, -(-len(part) // self.leaf_chars))
                cuts = [len(part) * i // n for i in range(n + 1)]
                pieces = [part[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
                parts.append(pieces)
                leaves += pieces
            plans.append(parts)
        encoded = iter(self.plain.encode_ordinary_batch(leaves, num_threads=self.threads))
        out = []
        for parts in plans:
            ids: list[int] = []
            for k, pieces in enumerate(parts):
                if k:
                    ids.append(SPECIAL_ID)
                tokens = self._tree([(piece, next(encoded)) for piece in pieces])
                ids = ids + tokens if ids else tokens
            out.append(ids)
        return out

    def encode(self, text: str) -> list[int]:
        return self.encode_batch([text])[0]

    def decode(self, ids) -> str:
        """The text of ids; bytes that are no UTF-8 become replacement characters."""
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> Encoder:
    """One encoder for each worker and vocabulary."""
    return Encoder(path or vocabulary_path())


def slices(batch: pa.RecordBatch, text: str = "text", budget: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about ``budget`` bytes of text each, one row at least."""
    sizes = pc.binary_length(batch[text]).fill_null(0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, size in enumerate(sizes):
        if held and held + size > budget:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(size)
    if start < batch.num_rows:
        yield batch.slice(start)


def ids_array(lists: list[list[int]]) -> pa.Array:
    offsets = np.zeros(len(lists) + 1, np.int32)
    np.cumsum([len(x) for x in lists], out=offsets[1:])
    flat = np.fromiter((i for x in lists for i in x), np.int32, int(offsets[-1]))
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def encode_texts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, decoded: bool = False
) -> DataFrame:
    """(id, ids) of each row, and with ``decoded`` the text that the ids decode to.

    ``path`` names the rank file on every machine; None takes that of the installed vocabularies.
    Null text is encoded as empty; empty text has no ids. Rows that repeat an id each give a row,
    null ids stay null. Other columns are not read, whatever their names.
    """
    kind = docs.schema[id_col].dataType
    fields = [T.StructField("id", kind), T.StructField("ids", T.ArrayType(T.IntegerType()))]
    schema = T.StructType(fields + [T.StructField("decoded", T.StringType())] * decoded)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for whole in batches:
            for batch in slices(whole):
                found = coder.encode_batch([x or "" for x in batch["text"].to_pylist()])
                columns = [batch["id"], ids_array(found)]
                if decoded:
                    columns.append(pa.array([coder.decode(x) for x in found], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of tokens, and digests of its ids and of their decoded text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_texts(docs, decoded=True).select(
        F.col("id").alias("doc_id"),
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
