"""N-gram Jaccard join with signature trees.

A document is its set of word shingles, hashed to 64 bits. Documents of equal sets are folded into
one class at once. Pairs of sets are then ruled out from the top down by the largest overlap that
bits and sizes leave possible, and every step is exact: no pair at or above the threshold is lost.

* Top nodes. The bits of a set are its rarest tokens: so many that two sets which link must share one
  (see ``prefixes``). Nodes are (bit, size
  class). They are traversed against each other as a join on the bit: nodes without a common bit, or
  of sizes that can't link, never meet. Which tokens are common is counted over all sets; the order
  among them decides how much is ruled out, never what is found.
* Sets that meet in small nodes are ruled out in pairs: an overlap is at most the number of common
  bits and what follows a set's bits. Nodes with more than ``NODE_SETS`` sets (crowds of near
  copies) give no pairs: each set in them hangs on the node's first one, and on that of the next
  smaller size class.
* What is still connected forms a group, whose texts meet in one task. There a signature tree has
  token bitmaps of sets in its leaves, the OR of the bitmaps and the range of the sizes in inner
  nodes, and is traversed against itself. What remains is compared exactly, unless links already
  found join the two.

Groups are bounded. A large one is cut into chunks by set size and hash; chunks are first compared
with themselves and with one common document, so that a crowd of near copies collapses; then only
pairs of chunks that are not yet joined, of sizes that can link, are compared. Links leave a task
as a spanning forest; pairs of a crowd are never written out. Components come from stars.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .groups import binaries, map_groups
from .scratch import materialize

WORDS, PERCENT = 5, 80
#: Sets in a top node beyond which it gives no pairs.
NODE_SETS = 32
#: Common tokens that tasks are told of at most (8 bytes each); it bounds what is broadcast, not what is found.
MAX_COMMON = 1 << 20
#: Tokens that a task counts at a time; 8 bytes each.
RUN_TOKENS = 2 << 20
#: Counted rows from which a token is common.
COMMON_ROWS = 16
#: Shingles in a chunk, about; two chunks meet in a task.
CHUNK_SHINGLES = 250_000
FANOUT = 8
SEED = 97

_U = np.uint64


def _mix(x: np.ndarray) -> np.ndarray:
    """A well-mixed 64-bit value of each 64-bit value."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _byte_tables() -> tuple[np.ndarray, np.ndarray]:
    """(random value of each byte with A-Z as a-z, whether it is white space)."""
    values = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.uint64) * _U(2) + _U(1)
    values[ord("A") : ord("Z") + 1] = values[ord("a") : ord("z") + 1]
    space = np.zeros(256, bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    return values, space


@lru_cache(maxsize=1)
def _powers(size: int) -> np.ndarray:
    return np.cumprod(np.full(size, 0x9E3779B97F4A7C15 | 1, np.uint64))


def shingles(text: bytes, words: int) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles.

    A text with fewer than ``words`` words is one shingle, one without words has none.
    """
    values, space = _byte_tables()
    data = np.frombuffer(text, np.uint8)
    blank = np.ones(len(data) + 2, bool)
    blank[1:-1] = space[data]
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(starts):
        return np.zeros(0, np.uint64)
    lengths = ends - starts
    power = _powers(1 << int(lengths.max()).bit_length())
    inside = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    terms = values[data[~blank[1:-1]]] * power[inside]
    word = _mix(np.add.reduceat(terms, np.cumsum(lengths) - lengths) + lengths.astype(np.uint64))
    size = min(words, len(word))
    n = len(word) - size + 1
    out = np.full(n, size, np.uint64)
    for j in range(size):
        out = _mix(out + word[j : j + n])
    return np.unique(out)


def prefixes(n: int, percent: int) -> tuple[int, int]:
    """How many of its first tokens, in one order for all sets, are the bits of a set of ``n`` tokens.

    Two sets that link share one of the first number's tokens of the larger and the second's of the smaller.
    """
    return n + n * -percent // 100 + 1, n + n * -2 * percent // (100 + percent) + 1


def rarest(hashes: np.ndarray, common: np.ndarray, count: int) -> np.ndarray:
    """The first ``count`` of a sorted set's tokens, in an order in which those in ``common`` (sorted) come last."""
    if len(common):
        late = common[np.minimum(np.searchsorted(common, hashes), len(common) - 1)] == hashes
        hashes = np.concatenate([hashes[~late], hashes[late]])
    return hashes[:count]


def can_link(overlap: np.ndarray, a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether an overlap of sets of sizes a and b is enough: 100 * both >= percent * either."""
    return (100 + percent) * overlap >= percent * (a + b)


class SignatureTree:
    """A tree over the bitmaps and sizes of sets, and the traversal of it against itself."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        sizes = np.array([len(s) for s in sets], np.int64)
        self.order = np.lexsort((np.array([s[0] if len(s) else 0 for s in sets], np.uint64), sizes))
        bits = 1 << max(8, min(14, int(4 * np.median(sizes)).bit_length()))
        maps = np.zeros((len(sets), bits // 64), np.uint64)
        for row, k in enumerate(self.order):
            place = sets[k] & _U(bits - 1)
            np.bitwise_or.at(maps[row], (place >> _U(6)).astype(np.int64), _U(1) << (place & _U(63)))
        sizes = sizes[self.order]
        # slack: members whose bit another member of the same set has; no bitmap shows them.
        slack = sizes - np.bitwise_count(maps).sum(axis=1, dtype=np.int64)
        self.levels = [(maps, sizes, sizes, slack)]
        while len(self.levels[-1][1]) > 1:
            maps, low, high, slack = self.levels[-1]
            at = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (
                    np.bitwise_or.reduceat(maps, at),
                    np.minimum.reduceat(low, at),
                    np.maximum.reduceat(high, at),
                    np.maximum.reduceat(slack, at),
                )
            )

    def _possible(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of pairs of nodes, those of which some members might link; the largest overlap of each."""
        maps, low, high, slack = self.levels[level]
        fits = (100 * high[a] >= self.percent * low[b]) & (100 * high[b] >= self.percent * low[a])
        most = np.full(len(a), -1, np.int64)
        rows = np.flatnonzero(fits)
        step = max(1, (4 << 20) // maps.shape[1] // 8)
        for at in range(0, len(rows), step):
            part = rows[at : at + step]
            shared = np.bitwise_count(maps[a[part]] & maps[b[part]]).sum(axis=1, dtype=np.int64)
            most[part] = np.minimum(shared + np.minimum(slack[a[part]], slack[b[part]]), np.minimum(high[a[part]], high[b[part]]))
        return np.where(fits & can_link(most, low[a], low[b], self.percent), most, -1)

    def candidates(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Pairs of sets (positions in ``order``) that the tree doesn't rule out, in bounded blocks."""
        top = len(self.levels) - 1
        stack = [(top, np.zeros(1, np.int64), np.zeros(1, np.int64))]
        while stack:
            level, a, b = stack.pop()
            most = self._possible(level, a, b)
            alive = most >= 0
            if level == 0:
                alive &= a != b
                if alive.any():
                    yield a[alive], b[alive], most[alive]
                continue
            a, b = a[alive], b[alive]
            count = len(self.levels[level - 1][1])
            for at in range(0, len(a), 1024):
                children = np.arange(FANOUT)
                x = (a[at : at + 1024, None, None] * FANOUT + children[None, :, None]) + np.zeros((1, 1, FANOUT), np.int64)
                y = (b[at : at + 1024, None, None] * FANOUT + children[None, None, :]) + np.zeros((1, FANOUT, 1), np.int64)
                keep = (x <= y) & (x < count) & (y < count)
                if keep.any():
                    stack.append((level - 1, x[keep], y[keep]))

    def links(self, parent: list[int]) -> Iterator[tuple[int, int]]:
        """Links that join sets not yet joined in ``parent`` (a forest by position in ``sets``)."""

        def root(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for a, b, most in self.candidates():
            for k in np.argsort(-most, kind="stable"):
                x, y = int(self.order[a[k]]), int(self.order[b[k]])
                p, q = root(x), root(y)
                if p == q:
                    continue
                s, t = self.sets[x], self.sets[y]
                both = len(s) + len(t) - len(np.unique(np.concatenate([s, t])))
                if can_link(both, len(s), len(t), self.percent):
                    parent[max(p, q)] = min(p, q)
                    yield x, y


def _tree_links(words: int, percent: int):
    def body(group: pa.Table) -> Iterator[pa.RecordBatch]:
        ids, known = group["id"].to_pylist(), group["known"].to_pylist()
        first: dict = {}
        parent = [first.setdefault(label, i) for i, label in enumerate(known)]
        if len(first) < 2:
            return
        sets = [shingles(text, words) for text in binaries(group["text"])]
        found = list(SignatureTree(sets, percent).links(parent))
        if found:
            yield pa.RecordBatch.from_pydict(
                {"a": pa.array([ids[x] for x, _ in found], pa.int64()), "b": pa.array([ids[y] for _, y in found], pa.int64())}
            )

    return body


def _compare(texts: DataFrame, members: DataFrame, words: int, percent: int, label: str) -> DataFrame:
    """Links (a, b) inside the groups of ``members`` (id, group, known)."""
    wanted = texts.join(members, "id").select("group", "id", "known", "text")
    return materialize(map_groups(wanted, "group", _tree_links(words, percent), "a long, b long"), label)


def _size_class(percent: int):
    """Sets in classes that aren't the same or neighbours differ too much in size to link."""
    step = math.log(100 / percent) if percent < 100 else 1e-9
    return F.floor(F.log(F.col("n")) / step * (1 - 1e-12)).cast("long")


def _common_tokens(source: DataFrame, words: int) -> np.ndarray:
    """The tokens that ``COMMON_ROWS`` rows hold, sorted; the most common ``MAX_COMMON`` if there are more.

    Tokens are counted in runs of ``RUN_TOKENS``, of which those that occur once send nothing: a token that is
    rarer than once in a run may be missed, and then counts as rare.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def run() -> pa.RecordBatch:
            tokens, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            several = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(tokens[several].view(np.int64)), pa.array(counts[several])], names=["token", "rows"]
            )

        size = 0
        for batch in batches:
            for text in binaries(batch["text"]):
                held.append(shingles(text, words))
                size += len(held[-1])
                if size >= RUN_TOKENS:
                    yield run()
                    size = 0
        if held:
            yield run()

    counts = source.where("id IS NOT NULL").mapInArrow(counted, "token long, rows long").groupBy("token").agg(F.sum("rows").alias("rows"))
    most = counts.where(F.col("rows") >= COMMON_ROWS).orderBy(F.desc("rows"), "token").limit(MAX_COMMON).select("token").toPandas()
    return np.sort(most["token"].to_numpy(np.int64).view(np.uint64))


def _sets(source: DataFrame, words: int, percent: int, common: np.ndarray) -> DataFrame:
    """(id, n, digest, bits) of every row."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, digests, bits = [], [], [np.zeros(0, np.int64)]
            for text in binaries(batch["text"]):
                found = shingles(text, words)
                sizes.append(len(found))
                digests.append(hashlib.blake2b(found.tobytes(), digest_size=16).digest())
                bits.append(rarest(found, common, prefixes(len(found), percent)[0] if len(found) else 0).view(np.int64))
            offsets = pa.array(np.cumsum([len(k) for k in bits]), pa.int32())
            kept = pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(bits)))
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), kept],
                names=["id", "n", "digest", "bits"],
            )

    return materialize(source.mapInArrow(hashed, "id long, n long, digest binary, bits array<long>"), "shingles")


def _meetings(classes: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) between classes that connect all pairs which the top nodes don't rule out.

    A set lies in the nodes of its bits and its size class, and in those of the class below, where only
    smaller sets are met: so a pair meets once for each common bit, in the class of the smaller set.
    """
    places = classes.select("rep", "n", F.posexplode("bits").alias("pos", "token"))
    several = places.groupBy("token").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select("token")
    own = _size_class(percent)
    places = places.join(several, "token").withColumn("own", own).withColumn("size", F.explode(F.array("own", F.col("own") - 1)))
    places = materialize(places.withColumn("own", F.col("own") == F.col("size")), "places")
    nodes = places.groupBy("token", "size").agg(F.count(F.lit(1)).alias("sets"), F.count_if("own").alias("small")).where("sets > 1 AND small > 0")
    crowds = materialize(nodes.where(F.col("sets") > NODE_SETS).select("token", "size"), "crowded-nodes")
    few = places.join(nodes.where(F.col("sets") <= NODE_SETS).select("token", "size"), ["token", "size"])
    crowded = materialize(places.join(crowds, ["token", "size"]), "crowded")

    x, y = (few.select("token", "size", F.col("rep").alias(r), F.col("n").alias(n), F.col("own").alias(o)) for r, n, o in (("a", "x", "own_a"), ("b", "y", "own_b")))
    sizes = (F.col("x") * 100 >= F.col("y") * percent) & (F.col("y") * 100 >= F.col("x") * percent)
    pairs = x.join(y, ["token", "size"]).where((F.col("a") < F.col("b")) & (F.col("own_a") | F.col("own_b")) & sizes)
    pairs = pairs.groupBy("a", "b", "x", "y").agg(F.count(F.lit(1)).alias("shared"))
    # Bits of a set that lie in crowded nodes, where pairs aren't counted.
    unseen = materialize(crowded.groupBy("rep").agg(F.count(F.lit(1)).alias("unseen")), "unseen-bits")
    for end, name in (("a", "unseen_a"), ("b", "unseen_b")):
        pairs = pairs.join(unseen.select(F.col("rep").alias(end), F.col("unseen").alias(name)), end, "left")
    rest = F.expr(f"(greatest(x, y) * {percent} + 99) div 100 - 1")
    both = F.col("unseen_a").isNotNull() & F.col("unseen_b").isNotNull()
    most = F.col("shared") + F.when(both, F.least("unseen_a", "unseen_b")).otherwise(0) + rest
    pairs = pairs.where(most * (100 + percent) >= (F.col("x") + F.col("y")) * percent).select("a", "b")

    short = F.col("own") & (F.col("pos") < F.expr(f"n - (n * {2 * percent} + {99 + percent}) div {100 + percent} + 1"))
    first = crowded.where(short).groupBy("token", "size").agg(F.min("rep").alias("b"))
    stars = crowded.join(first, ["token", "size"]).where("rep <> b").select(F.col("rep").alias("a"), "b").distinct()
    return pairs.unionAll(stars)


def link_components(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = WORDS,
    percent: int = PERCENT,
    chunk_shingles: int = CHUNK_SHINGLES,
) -> DataFrame:
    """(id, n_shingles, component_id), one row for each row of ``docs``.

    Two documents link if 100 * size of the intersection >= ``percent`` * size of the union of
    their shingle sets. Null text counts as empty; documents without words have no shingles and
    link with nothing, as do rows with a null id (whose component_id is null). Rows that repeat an
    id are one node: what links with one links with all. Extra columns are not read, whatever
    their names. An empty table gives an empty result.
    """
    source = docs.select(
        F.col(id_col).cast("long").alias("id"),
        F.encode(F.coalesce(F.col(text_col).cast("string"), F.lit("")), "UTF-8").alias("text"),
    )
    base = _sets(source, words, percent, _common_tokens(source, words))
    # Equal sets have equal bits: any of them does.
    by_set = base.where("n > 0 AND id IS NOT NULL").groupBy("digest")
    first = F.min("id").alias("rep"), F.first("n").alias("n")
    classes = materialize(by_set.agg(*first), "classes")
    near = _meetings(by_set.agg(*first, F.first("bits").alias("bits")), percent)
    groups = connected_components(near).withColumnRenamed("node", "id").withColumnRenamed("component", "root")
    sized = classes.select(F.col("rep").alias("id"), "n").groupBy("id").agg(F.max("n").alias("n"))
    members = materialize(groups.join(sized, "id").withColumn("size", _size_class(percent)), "members")

    # Small groups are compared whole. Of large ones, each cell (group and size class) is cut into
    # chunks, which its smallest document joins.
    chunks = lambda total: F.ceil(F.sum("n") / chunk_shingles).cast("long").alias(total)
    weights = members.groupBy("root").agg(chunks("parts"))
    large = materialize(
        members.join(weights.where("parts > 1").select("root"), "root")
        .groupBy("root", "size")
        .agg(chunks("parts"), F.min("id").alias("pivot")),
        "cells",
    )
    part = F.pmod(F.xxhash64("id"), F.col("parts"))
    whole = members.join(weights.where("parts = 1"), "root").select("id", F.xxhash64("root").alias("group"))
    cut = members.join(large, ["root", "size"])
    own = cut.select("id", F.xxhash64("root", "size", part).alias("group"))
    pivots = large.select(
        F.col("pivot").alias("id"), "root", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("p")
    ).select("id", F.xxhash64("root", "size", "p").alias("group"))
    first = whole.unionAll(own.unionAll(pivots).distinct()).withColumn("known", F.col("id"))
    # The texts of these documents alone are shuffled again.
    texts = materialize(source.join(members.select("id"), "id", "left_semi"), "near-texts")
    links = _compare(texts, first, words, percent, "links")
    if not large.isEmpty():
        fine = connected_components(links).withColumnRenamed("node", "id").withColumnRenamed("component", "known")
        inside = cut.select("id", "root", "size", "n").join(fine, "id", "left").withColumn("known", F.coalesce("known", "id"))
        inside = materialize(inside, "inside")
        # Crowds that are joined already get chunks of their own; the others share chunks.
        crowds = (
            inside.groupBy("root", "size", "known").agg(F.sum("n").alias("total")).where(F.col("total") >= chunk_shingles // 4)
        )
        named = inside.join(
            crowds.select("root", "size", "known", F.col("known").alias("crowd")), ["root", "size", "known"], "left"
        ).withColumn("crowd", F.coalesce("crowd", F.lit(-1).cast("long")))
        counts = named.groupBy("root", "size", "crowd").agg(chunks("parts"))
        named = named.join(counts, ["root", "size", "crowd"]).withColumn("part", part)
        pieces = counts.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")
        x, y = pieces.alias("x"), pieces.alias("y")
        order = lambda t: F.struct(f"{t}.size", f"{t}.crowd", f"{t}.part")
        pairs = x.join(
            y,
            (F.col("x.root") == F.col("y.root"))
            & (F.col("y.size") - F.col("x.size")).isin(0, 1)
            & (order("x") <= order("y"))
            & ((F.col("x.crowd") != F.col("y.crowd")) | (F.col("x.crowd") == -1)),
        )
        name = [F.col("x.root"), *(F.col(f"{t}.{c}") for t in "xy" for c in ("size", "crowd", "part"))]
        sides = [pairs.select("x.root", *(f"{t}.{c}" for c in ("size", "crowd", "part")), F.xxhash64(*name).alias("group")) for t in "xy"]
        placed = named.join(sides[0].unionAll(sides[1]).distinct(), ["root", "size", "crowd", "part"]).select("id", "group", "known")
        links = links.unionAll(_compare(texts, placed, words, percent, "more-links"))

    components = connected_components(links)
    per_class = classes.select("digest", F.col("rep").alias("node")).join(components, "node", "left")
    per_class = per_class.select("digest", F.coalesce("component", "node").alias("component"))
    return base.select("id", "n", "digest").join(per_class, "digest", "left").select(
        "id",
        F.col("n").alias("n_shingles"),
        F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.coalesce("component", "id"))
        .otherwise(F.col("id"))
        .alias("component_id"),
    )


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document: its number of 3-word shingles and its component at a similarity of 0.9."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return link_components(docs, words=3, percent=90).withColumnRenamed("id", "doc_id")


def _mark(docs: DataFrame) -> Column:
    """A hash that tells the texts of one id apart."""
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit("")))


def _variants(docs: DataFrame) -> DataFrame | None:
    """(doc_id, mark, node) of the ids that stand at different texts, with a number for each text; None if no id does."""
    marks = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), _mark(docs).alias("mark"))
    shared = marks.groupBy("doc_id").agg(F.min("mark").alias("low"), F.max("mark").alias("high"))
    several = materialize(shared.where("low < high").select("doc_id"), "shared-ids")
    if several.isEmpty():
        return None
    # Numbers below all ids.
    least = marks.agg(F.min("doc_id").alias("least"))
    found = marks.join(several, "doc_id").distinct().join(F.broadcast(least))
    return materialize(
        found.select("doc_id", "mark", (F.col("least") - 1 - F.monotonically_increasing_id()).alias("node")), "variants"
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: of each component of near copies, the document of the smallest id stays.

    Five words and a similarity of 0.8. Rows without an id stay. Rows of one id and different texts
    are documents of their own; those of one id and the same text are one.
    """
    rows = docs.select(
        F.struct("*").alias("row"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
        _mark(docs).alias("mark"),
    )
    variants = _variants(docs)
    if variants is None:
        nodes = rows.withColumn("node", F.col("doc_id"))
        gone = link_components(nodes, "node").where("id <> component_id").select(F.col("id").alias("node")).distinct()
    else:
        nodes = rows.join(variants, ["doc_id", "mark"], "left").withColumn("node", F.coalesce("node", "doc_id"))
        found = link_components(nodes, "node").where("id IS NOT NULL").select(F.col("id").alias("node"), "component_id")
        found = materialize(found.distinct(), "components")
        named = found.join(variants, "node", "left").withColumn("doc_id", F.coalesce("doc_id", "node"))
        first = named.groupBy("component_id").agg(F.min(F.struct("doc_id", "node")).alias("first"))
        gone = found.join(first.select("first.node"), "node", "left_anti").select("node")
    kept = nodes.join(gone, "node", "left_anti").select("node", "row")
    return kept.where("node IS NOT NULL").dropDuplicates(["node"]).unionAll(kept.where("node IS NULL")).select("row.*")
