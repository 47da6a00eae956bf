"""Groups of near copies: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more, beside links that another method has found.

The links are found exactly.  Two sets of that similarity share a shingle among the first fifth of either in any common order
(prefix filtering), so every text names its first fifth, and texts that name a common shingle are a bucket.  The order puts shingles
that a sample of the texts repeats last, so passages that many texts share route nobody; it decides the cost only, never the result.

No pair of texts is ever a row.  Members are compared inside a task that gives a forest with their components, one edge for a member at most:

* in each bucket by bit maps of the sets, whose differing bits bound the overlap from above; the components over all buckets
  hold every pair that may be similar, and most texts are in none;
* in each of these components by the full sets.  The texts of a component meet once, and what is connected already is not compared again.

Groups beyond a task's share (``BLOCK``, ``WEIGHT``) compare one member with all others first, and then what is apart from it with all, in blocks.

Defined results: words are split at white space, ASCII letters in lower case; a text of fewer than five words is one shingle,
and texts without a word are copies of each other; texts are told apart by a 64-bit hash; groups are connected components.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed, whole_text
from barloom.llm.components import connected_components

SHINGLE, SEED = 5, 42
#: Similarity of near copies, as a fraction.
OVER, UNDER = 4, 5
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: One text of so many is sampled for the order; shingles of at least so many sampled texts go last.
SAMPLE, OFTEN, MOST_OFTEN = 16, 3, 100_000
BROADCAST_ROWS = 250_000
#: Members of a group, and shingles in all, that one task compares with one another.
BLOCK, WEIGHT = 1024, 1_000_000
#: Where a member stands: on one of two sides that are compared with each other, or on both.
LEFT, RIGHT, BOTH = 0, 1, 2


def shingles(data: bytes) -> np.ndarray:
    """Hashes of the distinct shingles of the UTF-8 bytes of one text, ascending."""
    words = data.translate(LOWER).split()
    n = len(words)
    joined = b" ".join(words)
    if n <= SHINGLE:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64).view(np.int64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
    starts = np.concatenate(([0], ends[: n - SHINGLE]))
    h = xxhash.xxh64_intdigest
    found = [h(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    return np.unique(np.array(found, np.uint64).view(np.int64))


def text_id(text: str) -> Column:
    return F.xxhash64(whole_text(text))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """tid and set (array of long) of every row of ``texts`` (tid, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                sets = pa.array([shingles(x.as_py()) for x in part.column(1)], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), sets], names=["tid", "set"])

    return texts.mapInArrow(run, "tid long, set array<long>")


def first_shingles(texts: DataFrame) -> DataFrame:
    """tid and shingle: the first fifth of each text's shingles, those that many texts share last."""
    sampled = texts.where(F.pmod(F.col("tid"), F.lit(SAMPLE)) == 0)
    counted = shingle_sets(sampled).distinct().select(F.explode("set").alias("shingle")).groupBy("shingle").agg(F.count(F.lit(1)).alias("n"))
    often = counted.where(F.col("n") >= OFTEN).orderBy(F.desc("n"), "shingle").limit(MOST_OFTEN).collect()
    common = dict(sorted((r.shingle, r.n) for r in often))
    keys, counts = np.fromiter(common, np.int64, len(common)), np.fromiter(common.values(), np.int64, len(common))
    sent = texts.sparkSession.sparkContext.broadcast((keys, counts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts = sent.value
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                names, found = [], []
                for tid, data in zip(part.column(0).to_pylist(), part.column(1), strict=True):
                    s = shingles(data.as_py())
                    if len(keys):
                        where = np.minimum(np.searchsorted(keys, s), len(keys) - 1)
                        s = s[np.argsort(np.where(keys[where] == s, counts[where], 0), kind="stable")]
                    s = s[: len(s) - (len(s) * OVER + UNDER - 1) // UNDER + 1]
                    names.append(np.full(len(s), tid, np.int64))
                    found.append(s)
                if names:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(names)), pa.array(np.concatenate(found))], names=["tid", "shingle"])

    return texts.mapInArrow(run, "tid long, shingle long")


def bit_map(hashes: np.ndarray) -> bytes:
    """The low bits of hashes as a bit map of two to four times as many bits."""
    bits = np.zeros(1 << max(3, (2 * len(hashes)).bit_length()), np.uint8)
    bits[hashes & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def may_be_near(n: int, x: bytes, m: int, y: bytes) -> bool:
    """False only if the bit maps of sets of n and m hashes show that the sets are too different."""
    a, b, bits = int.from_bytes(x, "little"), int.from_bytes(y, "little"), 8 * min(len(x), len(y))
    low = (1 << bits) - 1
    folded = []
    for v in (a, b):
        while v > low:
            half = 1 << ((v.bit_length() - 1).bit_length() - 1)
            v = (v & ((1 << half) - 1)) | (v >> half)
        folded.append(v)
    a, b = folded
    most = min(n - (a & ~b).bit_count(), m - (b & ~a).bit_count())
    return most * (UNDER + OVER) >= (n + m) * OVER


def bit_maps(texts: DataFrame) -> DataFrame:
    """tid, n and bits of every row of ``texts`` (tid, data)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(x.as_py()) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(map(len, sets), pa.int64()), pa.array(map(bit_map, sets), pa.binary())], names=["tid", "n", "bits"])

    return texts.mapInArrow(run, "tid long, n long, bits binary")


def may_be_near_to(sizes: np.ndarray, data: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """By bit maps, as ``may_be_near``: which of some members may be similar enough to one of them."""
    lengths = np.array([len(x) for x in data], np.int64)
    place = np.zeros(len(data), np.int64)
    folded: dict[tuple[int, int], np.ndarray] = {}
    for length in np.unique(lengths).tolist():
        of = np.flatnonzero(lengths == length)
        place[of] = np.arange(len(of))
        folded[length, length] = np.frombuffer(b"".join(data[u] for u in of.tolist()), np.uint8).reshape(-1, length)

    def maps(length: int, to: int) -> np.ndarray:
        """The bit maps of a length, folded to a shorter one."""
        if (length, to) not in folded:
            longer = maps(length, 2 * to)
            folded[length, to] = longer[:, :to] | longer[:, to:]
        return folded[length, to]

    def near(v: int, others: np.ndarray) -> np.ndarray:
        out = np.zeros(len(others), bool)
        for length in np.unique(lengths[others]).tolist():
            of = np.flatnonzero(lengths[others] == length)
            to = min(length, int(lengths[v]))
            x, y = maps(int(lengths[v]), to)[place[v]], maps(length, to)[place[others[of]]]
            n, m = sizes[v], sizes[others[of]]
            if to >= 8:
                x, y = np.ascontiguousarray(x).view(np.uint64), np.ascontiguousarray(y).view(np.uint64)
            less, more = (np.bitwise_count(z).sum(axis=1, dtype=np.int64) for z in (x & ~y, y & ~x))
            out[of] = np.minimum(n - less, m - more) * (UNDER + OVER) >= (n + m) * OVER
        return out

    return near


def near_to(sizes: np.ndarray, data: list[bytes]) -> Callable[[int, np.ndarray], np.ndarray]:
    """By texts: which of some members are similar enough to one of them."""
    ends = np.cumsum(sizes)
    values, numbers = np.unique(np.concatenate([shingles(x) for x in data]), return_inverse=True)
    sets = np.split(numbers, ends[:-1])
    marked = np.zeros(len(values), bool)

    def near(v: int, others: np.ndarray) -> np.ndarray:
        marked[sets[v]] = True
        both = np.array([np.count_nonzero(marked[sets[u]]) for u in others.tolist()], np.int64)
        marked[sets[v]] = False
        return both * (UNDER + OVER) >= (sizes[v] + sizes[others]) * OVER

    return near


def forest(sides: np.ndarray, sizes: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Pairs of members, one fewer than members at most, with the components of all pairs of different sides that are near."""
    apart, found = np.ones(len(sides), bool), []
    for start in range(len(sides)):
        waiting = [start] if apart[start] else []
        apart[start] = False
        while waiting:
            v = waiting.pop()
            fits = np.minimum(sizes, sizes[v]) * UNDER >= np.maximum(sizes, sizes[v]) * OVER
            others = np.flatnonzero(apart & fits & ((sides == BOTH) | (sides != sides[v])))
            if len(others):
                others = others[near(v, others)]
                apart[others] = False
                waiting += others.tolist()
                found += [(v, u) for u in others.tolist()]
    return found


def compared(placed: DataFrame, payload: DataFrame, near_of: Callable) -> DataFrame:
    """Edges (a, b) of a forest of each task's share of ``placed`` (group, i, j, side, node), by what ``payload`` (node, n, data) holds of the members."""

    def edges(rows: list[tuple]) -> pa.RecordBatch:
        sides, nodes, sizes = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        found = forest(sides, sizes, near_of(sizes, [r[3] for r in rows])) if len(rows) > 1 else []
        pairs = np.sort(nodes[np.array(found, np.int64).reshape(-1, 2)], axis=1)
        pairs = pairs[pairs[:, 0] < pairs[:, 1]]
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, []
        for batch in batches:
            keys = zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)
            for key, *row in zip(keys, *(batch.column(k).to_pylist() for k in range(3, 7)), strict=True):
                if key != last and rows:
                    yield edges(rows)
                    rows = []
                last = key
                rows.append(row)
        if rows:
            yield edges(rows)

    share = ["group", "i", "j"]
    rows = placed.join(payload, "node").repartition(*share).sortWithinPartitions(*share, "side", "node").select(*share, "side", "node", "n", "data")
    return checkpointed(rows.mapInArrow(run, "a long, b long").distinct())


def at(number: str) -> Column:
    """The block of a member, of ``number`` blocks."""
    return F.pmod(F.xxhash64("node"), F.col(number)).cast("int")


def each(number: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(number) - 1))


def forests(members: DataFrame, payload: DataFrame, near_of: Callable) -> DataFrame:
    """Edges (a, b) with the components of all near pairs of a group of ``members`` (group, node, weight)."""
    parts = F.greatest(F.ceil(F.count(F.lit(1)) / BLOCK), F.ceil(F.sum("weight") / WEIGHT)).cast("int")
    large = checkpointed(members.groupBy("group").agg(parts.alias("parts"), F.min_by("node", F.xxhash64("node")).alias("centre")).where("parts > 1"))
    zero, side = F.lit(0), lambda k: F.lit(k).alias("side")
    whole = members.join(large, "group", "left_anti")
    found = compared(whole.select("group", zero.alias("i"), zero.alias("j"), side(BOTH), "node"), payload, near_of)
    if large.isEmpty():
        return found
    rows = checkpointed(members.join(large, "group"))
    centres = large.select("group", zero.alias("i"), each("parts").alias("j"), side(LEFT), F.col("centre").alias("node"))
    stars = compared(centres.union(rows.select("group", zero.alias("i"), at("parts").alias("j"), side(RIGHT), "node")), payload, near_of)
    linked = (F.least("node", "centre") == F.col("a")) & (F.greatest("node", "centre") == F.col("b"))
    rest = checkpointed(rows.where("node <> centre").join(stars, linked, "left_anti"))
    blocks = checkpointed(rest.groupBy("group").agg(parts.alias("blocks")))
    left = rest.join(blocks, "group").select("group", at("blocks").alias("i"), each("parts").alias("j"), side(LEFT), "node")
    right = rows.join(blocks, "group").select("group", each("blocks").alias("i"), at("parts").alias("j"), side(RIGHT), "node")
    return found.union(stars).union(compared(left.union(right), payload, near_of))


def near_components(texts: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """tid and root of the texts (tid, data) that have near copies or links in ``linked`` (a, b); copies of one text share their tid."""
    named = first_shingles(texts).groupBy("shingle").agg(F.array_sort(F.collect_set("tid")).alias("members"))
    buckets = checkpointed(named.where(F.size("members") > 1).select("members").distinct())
    members = buckets.select(F.xxhash64("members").alias("group"), F.explode("members").alias("node"), F.lit(0).alias("weight"))
    maps = checkpointed(bit_maps(texts).dropDuplicates(["tid"]).withColumnsRenamed({"tid": "node", "bits": "data"}))
    groups = checkpointed(connected_components(forests(members, maps, may_be_near_to)).distinct())
    sizes = checkpointed(groups.join(maps, "node").select(F.col("root").alias("group"), "node", F.col("n").alias("weight")))
    few = F.broadcast(sizes) if sizes.count() <= BROADCAST_ROWS else sizes
    whole = texts.join(few.select(F.col("node").alias("tid")), "tid", "left_semi").dropDuplicates(["tid"])
    whole = whole.join(sizes.select("node", F.col("weight").alias("n")), F.col("tid") == F.col("node")).select("node", "n", "data")
    edges = forests(sizes, checkpointed(whole), near_to)
    return connected_components(edges.union(linked) if linked is not None else edges).distinct().select(F.col("node").alias("tid"), "root")


def texts_of(df: DataFrame, text: str = "text") -> DataFrame:
    """tid and data of every row."""
    return df.select(text_id(text).alias("tid"), whole_text(text).cast("binary").alias("data"))


def components(df: DataFrame, key: str = "doc_id", text: str = "text", linked: DataFrame | None = None) -> DataFrame:
    """doc_id, tid (hash of the text) and root (one tid of the group) of every row."""
    roots = checkpointed(near_components(texts_of(df, text), linked))
    rows = df.select(F.col(key).cast("long").alias("doc_id"), text_id(text).alias("tid"))
    return rows.join(roots, "tid", "left").select("doc_id", "tid", F.coalesce("root", "tid").alias("root"))
