"""SimHash near-duplicates found through pivot distance tables.

Fingerprints are grouped first, so exact copies are one row.  For each distinct fingerprint the table holds its Hamming distances
to 33 reference fingerprints: a base, and for each of four 16-bit blocks the base with eight sets of bits of that block flipped.
All comes from this table until the last step:

* Routing: the distance to a flipped reference less that to the base says how many bits of the set differ from the base, so the eight
  differences of a block are coordinates that depend on that block alone.  Fingerprints within two bits agree on two blocks, hence on all
  sixteen coordinates of one of six pairs of blocks: these are the join keys (the coordinates of a block take 45,332 values for its 65,536 patterns).
* Discarding: a pair is dropped when any of the 33 distances differs by more than two (the triangle inequality makes that safe).
* The survivors are verified on the fingerprints.  ``candidate_counts`` tells how many pairs each step leaves.

Buckets of more than ``MAX_BUCKET`` fingerprints (large families of near copies) never emit their pairs: each member takes
itself and its 64 neighbours at one bit as references of its own, and members with a common reference are within two bits by the
triangle inequality, and the reverse.  At most 65 members can have one reference, so those groups are small whatever the data.

Defined results: null and empty texts and texts without a word have fingerprint zero and link like any
other; a text of one or two words is one shingle; repeated rows and ties link at distance zero; a null doc_id
takes part and never becomes the component_id unless all are null; very long texts are read whole; an empty table gives an empty result; other columns, whatever their names, are not read
(``deduplicated`` passes them through).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from barloom.llm import near_copies
from barloom.llm.common import checkpointed, fresh_name
from barloom.llm.components import connected_components

SHINGLE, SEED, REACH = 3, 42, 2
MAX_BUCKET = 64
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
SLAB = 1 << 16


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


BLOCKS, SETS = 4, 8
#: The base of the reference fingerprints, and sets of bits of a block: hashes of the numbers from 0 on.
BASE = xxhash.xxh64_intdigest(b"\0", SEED)
FLIPS = tuple(xxhash.xxh64_intdigest(bytes([i + 1]), SEED) & 0xFFFF for i in range(SETS))


def fingerprint(data: bytes) -> int:
    """64-bit SimHash of the UTF-8 bytes of one text, as an unsigned integer."""
    words = data.translate(LOWER).split()
    n = len(words)
    if n == 0:
        return 0
    joined = b" ".join(words)
    if n < SHINGLE:
        hashes = [xxhash.xxh64_intdigest(joined, SEED)]
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1)
        starts = np.concatenate(([0], ends[: n - SHINGLE]))
        h = xxhash.xxh64_intdigest
        hashes = [h(joined[a:b], SEED) for a, b in zip(starts.tolist(), (ends[SHINGLE - 1 :] - 1).tolist(), strict=True)]
    total = np.zeros(64, np.int64)
    for k in range(0, len(hashes), SLAB):
        part = np.array(hashes[k : k + SLAB], dtype="<u8").view(np.uint8).reshape(-1, 8)
        total += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits(total * 2 > len(hashes), bitorder="little")
    return int(set_bits.view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = [signed(fingerprint(x.as_py())) for x in batch.column(1)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints, pa.int64())], names=["doc_id", "fp"])


def fingerprints(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row."""
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).cast("binary").alias("data"))
    return docs.mapInArrow(_fingerprints, "doc_id long, fp long")


def pivot_table(prints: DataFrame) -> DataFrame:
    """fp, p (distance to the base) and p0 to p3: per block the distances to its eight references, a byte each."""
    to = lambda reference: F.bit_count(F.col("fp").bitwiseXOR(F.lit(signed(reference)))).cast("long")

    def packed(block: int) -> Column:
        out = F.lit(0).cast("long")
        for i, flips in enumerate(FLIPS):
            out = out.bitwiseOR(F.shiftleft(to(BASE ^ flips << 16 * block), 8 * i))
        return out

    return prints.select("fp", to(BASE).alias("p"), *(packed(k).alias(f"p{k}") for k in range(BLOCKS)))


def coordinate(column: Column, i: int) -> Column:
    return F.shiftright(column, 8 * i).bitwiseAND(F.lit(255))


def near_by_pivots(a: str, b: str, reach: int = REACH) -> Column:
    """Whether no coordinate of the pivot distances differs by more than ``reach``."""
    out = F.abs(F.col(f"{a}.p") - F.col(f"{b}.p")) <= reach
    for k in range(BLOCKS):
        for i in range(SETS):
            out = out & (F.abs(coordinate(F.col(f"{a}.p{k}"), i) - coordinate(F.col(f"{b}.p{k}"), i)) <= reach)
    return out


def block_coordinates(block: int) -> Column:
    """The eight distances of a block less that to the base, a byte each: what the references say about this block alone."""
    out = F.lit(0).cast("long")
    for i in range(SETS):
        out = out.bitwiseOR(F.shiftleft(coordinate(F.col(f"p{block}"), i) - F.col("p") + 64, 8 * i))
    return out


def bucket_keys() -> Column:
    """Array of join keys: for each pair of blocks its number and the coordinates of both."""
    pairs = [(i, j) for i in range(BLOCKS) for j in range(i + 1, BLOCKS)]
    return F.array(*(F.struct(F.lit(k).alias("pair"), F.col(f"c{i}").alias("c1"), F.col(f"c{j}").alias("c2")) for k, (i, j) in enumerate(pairs)))


def buckets(prints: DataFrame) -> DataFrame:
    """The pivot table in buckets (pair, c1, c2) of two members at least, with their number n."""
    table = pivot_table(prints).withColumns({f"c{k}": block_coordinates(k) for k in range(BLOCKS)})
    routed = checkpointed(table.select("fp", "p", *(f"p{k}" for k in range(BLOCKS)), F.explode(bucket_keys()).alias("key")).select("*", "key.*").drop("key"))
    sizes = checkpointed(routed.groupBy("pair", "c1", "c2").agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    return checkpointed(routed.join(sizes, ["pair", "c1", "c2"]))


def bucket_pairs(members: DataFrame) -> DataFrame:
    """Pairs (x, y) of fingerprints of a bucket."""
    same = (F.col("x.pair") == F.col("y.pair")) & (F.col("x.c1") == F.col("y.c1")) & (F.col("x.c2") == F.col("y.c2"))
    return members.alias("x").join(members.alias("y"), same & (F.col("x.fp") < F.col("y.fp")))


def within_reach() -> Column:
    return F.bit_count(F.col("x.fp").bitwiseXOR(F.col("y.fp"))) <= REACH


def links(prints: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose components are those of all pairs within two bits."""
    members = buckets(prints)
    pairs = bucket_pairs(members.where(F.col("n") <= max_bucket)).where(near_by_pivots("x", "y") & within_reach())
    many = members.where(F.col("n") > max_bucket).select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(signed(1 << i))) for i in range(64)))
    named = many.select("fp", F.explode(flips).alias("name"))
    hubs = named.groupBy("name").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    stars = hubs.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).where("a <> b").distinct()
    return pairs.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).union(stars)


def candidate_counts(df: DataFrame, key: str = "doc_id", text: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row: distinct fingerprints, pairs that meet in a bucket, those that the pivots leave, and those within reach (a pair counts in each of its buckets)."""
    prints = checkpointed(fingerprints(df, key, text).select("fp").distinct())
    members = buckets(prints)
    met = bucket_pairs(members.where(F.col("n") <= max_bucket))
    one = lambda c: F.count(F.when(c, 1))
    counted = met.agg(F.count(F.lit(1)).alias("met"), one(near_by_pivots("x", "y")).alias("left_by_pivots"), one(within_reach()).alias("within_reach"))
    return counted.withColumn("fingerprints", F.lit(prints.count()))


def components(df: DataFrame, key: str = "doc_id", text: str = "text", max_bucket: int = MAX_BUCKET) -> DataFrame:
    """doc_id, fp and component_id (smallest doc_id reachable over links) of every row."""
    docs = checkpointed(fingerprints(df, key, text))
    prints = checkpointed(docs.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n")))
    rooted = checkpointed(connected_components(links(prints.select("fp"), max_bucket)))
    linked = rooted.join(prints, rooted.node == prints.fp)
    smallest = linked.groupBy("root").agg(F.min("first").alias("component_id"))
    by_link = rooted.join(smallest, "root").select(F.col("node").alias("fp"), "component_id")
    named = checkpointed(prints.join(by_link, "fp", "left").select("fp", "n", F.coalesce("component_id", "first").alias("component_id")))
    return docs.join(named.select("fp", "component_id"), "fp").select("doc_id", "fp", "component_id")


def text_links(texts: DataFrame, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """Links (a, b) between texts (tid, data) whose components are those of all pairs of fingerprints within two bits."""
    prints = checkpointed(texts.mapInArrow(_fingerprints, "doc_id long, fp long").distinct())
    first = checkpointed(prints.groupBy("fp").agg(F.min("doc_id").alias("first")))
    same = prints.join(first, "fp").where("first <> doc_id").select(F.col("first").alias("a"), F.col("doc_id").alias("b"))
    x, y = (first.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}")) for k in "ab")
    apart = links(first.select("fp"), max_bucket).join(x, "a").join(y, "b").select(F.col("first_a").alias("a"), F.col("first_b").alias("b"))
    return same.union(apart)


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the one with the smallest key (null last), then the smallest hash of the text.

    Fingerprints within two bits link texts, as in ``components``.  They hardly find more than exact copies, so the pairs of
    ``near_copies`` (5-word shingles, similarity 0.8) link texts beside them.
    Rows with the key and the text of the chosen one are reduced after the join; where it is not repeated, the texts are shuffled once only.
    """
    found = checkpointed(near_copies.components(df, key, text, text_links(near_copies.texts_of(df, text))))
    mark = fresh_name(df, "__kept")
    tid, n = f"{mark}_tid", f"{mark}_n"
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("kept"), F.col("tid").alias("kept_tid"))
    first = found.groupBy("root").agg(F.min(order).alias("first")).select("first.*")
    found = first.join(found, F.col("kept").eqNullSafe(F.col("doc_id")) & (F.col("kept_tid") == F.col("tid")))
    kept = checkpointed(found.groupBy(F.col("kept").alias(mark), F.col("kept_tid").alias(tid)).agg(F.count(F.lit(1)).alias(n)))
    names = df.columns
    joined = df.join(kept, df[key].eqNullSafe(F.col(mark)) & (near_copies.text_id(text) == F.col(tid))).select(*(F.col(f"`{c}`") for c in names), tid, n)
    once = joined.where(F.col(n) == 1).drop(n, tid)
    if kept.where(F.col(n) > 1).isEmpty():
        return once
    return once.unionByName(joined.where(F.col(n) > 1).dropDuplicates([tid]).drop(n, tid))


def digest(df: DataFrame) -> DataFrame:
    return components(df).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
