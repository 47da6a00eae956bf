"""Repeated strings across a corpus by difference-cover suffix sorting of bounded depth.

Only prefixes of ``length`` units decide (400 bytes; or 51 words, see ``WORDS``), so the suffix order is needed to that depth and no further:

1. Positions of every text are sampled by a difference cover (for bytes modulo 273: 17 residues, a perfect difference set): any
   two positions have a common shift below the modulus that makes both sampled.  Sampled suffixes are named by
   their first ``name`` units (128 bytes) and sorted by name; a name found once is decided and dropped.
2. If two suffixes agree on 400 bytes, then the sampled suffixes at their common shift agree on 128, so
   only suffixes within 272 bytes before a surviving sample can repeat.  These remaining suffixes are merged in by
   their 400-byte prefix, sorted, and equal neighbours are the repeats.

Names are hashes of the bytes (XXH3 of 128 bits, of which the part and 48 bits are compared in step 1, which is only a filter, and the part and 72 bits in step 2), as the alternative, ranks from a recursion over
triples, moves 16 bytes for every byte of text several times over, far beyond the disk allowed.  A chance collision needs two of the
suffixes left in step 2 to agree on those: 1e13 of them, in a million parts, give about one in a hundred.

Equal texts are one text from the start: they are represented by a 64-bit hash of the bytes and their number, and if a text occurs twice and has 400 bytes, all of it goes.
One copy of equal texts is compared where the texts that have copies are few enough to be known to all tasks; otherwise
copies travel, and change nothing.
Within a batch of texts, repeats are found at once and one witness is sent on, so a passage in a third
of all documents sends one row per batch, not one per document.  Texts are shuffled once for step 2 of each scheme, and once for the result.

Defined results: a null text is the empty text; texts shorter than 400 bytes lose nothing and give nothing; repeated rows count as
copies of each other (each occurrence counts); very long texts are read whole; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import gc
import time
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed

LENGTH = 400
#: Rows of names that a task holds before it sends them.
HELD_ROWS = 3 << 18
PART_BYTES = 64 << 20
#: Bytes of a name that are sent in steps 1 and 2; the number of the part adds to them.
NARROW, WIDE = 6, 9
#: Texts with copies, up to which one row of each is chosen before texts are shuffled.
BROADCAST_ROWS = 250_000


@cache
def difference_cover(q: int = 16) -> list[int]:
    """Singer's perfect difference set modulo q*q + q + 1: powers of a generator of GF(q**3) that lie in a plane over GF(q); q is 4 or 16."""
    # GF(2**6) by x^6 + x + 1 and GF(2**12) by x^12 + x^6 + x^4 + x + 1; the plane is the kernel of the trace to GF(q)
    polynomial, top = {4: (0b1000011, 64), 16: (0b1000001010011, 4096)}[q]
    table, x = [], 1
    for _ in range(top - 1):
        table.append(x)
        x <<= 1
        if x & top:
            x ^= polynomial
    log = {v: i for i, v in enumerate(table)}
    power = lambda v, n: table[log[v] * n % (top - 1)]
    return sorted({k % (q * q + q + 1) for k, v in enumerate(table) if v ^ power(v, q) ^ power(v, q * q) == 0})


@dataclass(frozen=True)
class Scheme:
    """What is compared: strings of ``length`` units (bytes, or words apart by white space), sampled by the cover of ``q``.

    With ``across``, a string counts only where another text has it.
    """

    length: int
    q: int
    words: bool = False
    across: bool = False

    @property
    def modulus(self) -> int:
        return self.q * self.q + self.q + 1

    @property
    def name(self) -> int:
        """Units of a name of step 1: a sample lies in the first ``modulus`` places of a repeat, and its name ends inside."""
        return self.length - self.modulus + 1

    def units(self, data: bytes) -> tuple[int, bytes, np.ndarray | None]:
        """How many units there are, the bytes that are compared, and for words where each begins (and one more would)."""
        if not self.words:
            return len(data), data, None
        found = data.split()
        return len(found), b" ".join(found), np.cumsum([0, *map(len, found)]) + np.arange(len(found) + 1)

    def strings(self, body: bytes, begins: np.ndarray | None, places: np.ndarray, length: int) -> list[bytes]:
        """The strings of ``length`` units at ``places``."""
        if begins is None:
            return [body[a : a + length] for a in places.tolist()]
        return [body[a:b] for a, b in zip(begins[places].tolist(), (begins[places + length] - 1).tolist(), strict=True)]

    def sampled(self, n: int) -> np.ndarray:
        """Sampled places at which a name fits, in a text of n units that can hold a repeat."""
        chosen = np.zeros(self.modulus, bool)
        chosen[difference_cover(self.q)] = True
        return np.flatnonzero(np.resize(chosen, n - self.name + 1)) if n >= self.length else np.zeros(0, np.int64)


    def before(self, marks: np.ndarray, n: int) -> Iterator[np.ndarray]:
        """Places at which a repeat may start, given the surviving samples of a text of n units; at most HELD_ROWS at once."""
        starts, ends = np.maximum(marks - self.modulus + 1, 0), np.minimum(marks, n - self.length) + 1
        cut = np.flatnonzero(starts[1:] > ends[:-1])
        starts, ends = starts[np.concatenate(([0], cut + 1))], ends[np.concatenate((cut, [len(ends) - 1]))]
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            for k in range(a, b, HELD_ROWS):
                yield np.arange(k, min(b, k + HELD_ROWS))


BYTES = Scheme(LENGTH, 16)
#: Passages of more than 50 words that another text has as well, however they are broken into lines.
WORDS = Scheme(51, 4, words=True, across=True)


def names_of(strings: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """128-bit names: the low half, and the high half."""
    raw = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, strings)), "<u8").reshape(-1, 2)
    return raw[:, 0].copy(), raw[:, 1].copy()


def runs(places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of consecutive numbers of a sorted array."""
    if not len(places):
        return places, places
    cut = np.flatnonzero(np.diff(places) != 1)
    return places[np.concatenate(([0], cut + 1))], places[np.concatenate((cut, [len(places) - 1]))] + 1


def pack_places(places: np.ndarray) -> bytes:
    """Sorted places as compressed differences (parts hold scattered places, so runs would not be shorter)."""
    return zstandard.ZstdCompressor(level=1).compress(np.diff(places, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def unpack_places(blobs: list[bytes]) -> np.ndarray:
    """The places of all blobs, sorted, each once."""
    out = []
    for blob in blobs:
        raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(4, -1)
        out.append(np.cumsum(np.ascontiguousarray(raw.T).view("<u4")[:, 0], dtype=np.int64))
    return np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)


class Sender:
    """Collects (text, places, names), settles repeats inside the batch and gives the witnesses by part."""

    def __init__(self, parts: int, width: int, across: bool):
        self.parts, self.width, self.across = parts, width, across
        self.clear()

    def clear(self) -> None:
        self.texts: list[int] = []
        self.owners: list[int] = []
        self.names: list[tuple[np.ndarray, np.ndarray]] = []
        self.places: list[np.ndarray] = []
        self.rows = 0

    def add(self, text: int, names: tuple[np.ndarray, np.ndarray], places: np.ndarray) -> None:
        if not self.texts or self.texts[-1] != text:
            self.texts.append(text)
        self.owners.append(len(self.texts) - 1)
        self.names.append(names)
        self.places.append(places.astype(np.uint32))
        self.rows += len(places)

    def flush(self) -> tuple[list[tuple[int, bytes]], list[tuple[int, bytes]]]:
        """Witnesses (part, blob), and repeats known already (text, places).

        A name that repeats in the batch sends one witness, and the others are known; where only other texts count, a name
        that repeats in one text alone sends all its places.
        """
        if not self.rows:
            self.clear()
            return [], []
        low, high = (np.concatenate(x) for x in zip(*self.names, strict=True))
        owner = np.repeat(np.array(self.owners, np.uint32), [len(x) for x in self.places])
        places = np.concatenate(self.places)
        order, group = grouped(low, high)
        several = differ(owner[order], group) if self.across else np.bincount(group) > 1
        same = several[group]
        first = np.diff(group, prepend=-1) > 0
        known_rows = np.sort(order[same])
        known = []
        edges = np.flatnonzero(np.diff(owner[known_rows].astype(np.int64), prepend=-1, append=-1)) if len(known_rows) else np.zeros(1, np.int64)
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            known.append((self.texts[owner[known_rows[a]]], pack_places(places[known_rows[a:b]].astype(np.int64))))
        send = first | ~same
        sent, flag = order[send], same[send]
        part = (high[sent] >> np.uint64(32)) % np.uint64(self.parts)  # bits that are not sent, so that a part adds to the name
        by = np.lexsort((sent, part))
        sent, flag, part = sent[by], flag[by], part[by].astype(np.int64)
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        blobs = []
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            rows = sent[a:b]
            own, at = np.unique(owner[rows], return_inverse=True)
            texts = np.array([self.texts[i] for i in own], "<i8")
            names = np.stack((low[rows], high[rows]), axis=1).astype("<u8").view(np.uint8)
            rest = np.diff(at, prepend=0).astype("<i4").tobytes() + np.diff(places[rows].astype(np.int64), prepend=0).astype("<i4").tobytes() + np.packbits(flag[a:b]).tobytes()
            squeezed = zstandard.ZstdCompressor(level=1).compress(rest)
            head = np.array([b - a, len(own), len(squeezed)], "<i4").tobytes()
            blobs.append((int(part[a]), head + texts.tobytes() + names[:, : self.width].tobytes() + squeezed))
        self.clear()
        return blobs, known


def grouped(low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of names, and in it the number of the distinct name of each."""
    order = np.argsort(low, kind="stable")
    same, apart = low[order[1:]] == low[order[:-1]], high[order[1:]] != high[order[:-1]]
    if (same & apart).any():
        order = np.lexsort((high, low))
        same, apart = low[order[1:]] == low[order[:-1]], high[order[1:]] != high[order[:-1]]
    return order, np.cumsum(np.concatenate(([False], ~same | apart)))


def differ(values: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Whether a group (numbered in order) holds different values."""
    starts = np.flatnonzero(np.diff(group, prepend=-1))
    return np.minimum.reduceat(values, starts) != np.maximum.reduceat(values, starts)


def opened(blob: bytes, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Names (two arrays), texts, places and flags of a blob."""
    n, m, z = np.frombuffer(blob, "<i4", 3).tolist()
    texts = np.frombuffer(blob, "<i8", m, 12)
    at = 12 + 8 * m
    names = np.zeros((n, 16), np.uint8)
    names[:, :width] = np.frombuffer(blob, np.uint8, n * width, at).reshape(n, width)
    names = names.view("<u8")
    rest = zstandard.ZstdDecompressor().decompress(blob[at + n * width : at + n * width + z])
    owner = np.cumsum(np.frombuffer(rest, "<i4", n))
    places = np.cumsum(np.frombuffer(rest, "<i4", n, 4 * n)).astype(np.uint32)
    flags = np.unpackbits(np.frombuffer(rest, np.uint8, offset=8 * n), count=n).astype(bool)
    return names[:, 0].copy(), names[:, 1].astype(np.uint8) if width < 10 else names[:, 1].copy(), texts[owner], places, flags


def settle(blobs: list[bytes], width: int, across: bool) -> tuple[np.ndarray, np.ndarray]:
    """Texts and places whose names occur at two different places (or in two texts) at least: sort, and compare neighbours."""
    low, high, texts, places, flags = (np.concatenate(x) for x in zip(*(opened(b, width) for b in blobs), strict=True))
    order, group = grouped(low, high)
    del low, high
    texts, places = texts[order], places[order]
    several = (np.bincount(group, weights=flags[order]) > 0) | differ(texts, group)
    if not across:
        several |= differ(places, group)
    keep = several[group]
    return texts[keep], places[keep].astype(np.int64)


def by_text(texts: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by text and place, each pair once; and where each text begins, with the end."""
    order = np.lexsort((places, texts))
    texts, places = texts[order], places[order]
    fresh = np.concatenate(([True], (texts[1:] != texts[:-1]) | (places[1:] != places[:-1]))) if len(texts) else np.zeros(0, bool)
    texts, places = texts[fresh], places[fresh]
    edges = np.flatnonzero(np.concatenate(([True], texts[1:] != texts[:-1], [True]))) if len(texts) else np.zeros(1, np.int64)
    return texts, places, edges


def pack_texts(texts: np.ndarray, places: np.ndarray) -> bytes:
    """Places of many texts in one compressed blob."""
    texts, places, edges = by_text(texts, places)
    counts = np.diff(edges).astype("<i4")
    steps = np.diff(places, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4).T
    head = np.array([len(counts), len(places)], "<i4").tobytes()
    return zstandard.ZstdCompressor(level=1).compress(head + texts[edges[:-1]].astype("<i8").tobytes() + counts.tobytes() + steps.tobytes())


def unpack_texts(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    m, n = np.frombuffer(raw, "<i4", 2).tolist()
    texts, counts = np.frombuffer(raw, "<i8", m, 8), np.frombuffer(raw, "<i4", m, 8 + 8 * m)
    steps = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, 8 + 12 * m).reshape(4, n).T).view("<i4")[:, 0]
    return np.repeat(texts, counts), np.cumsum(steps, dtype=np.int64)


def batch_of(rows: list[tuple], types: tuple, names: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=list(names))


SENT = "part int, blob binary, text_id long, places binary"
SENT_TYPES, SENT_NAMES = (pa.int32(), pa.binary(), pa.int64(), pa.binary()), ("part", "blob", "text_id", "places")


def _send(sender: Sender) -> Iterator[pa.RecordBatch]:
    blobs, known = sender.flush()
    rows = [(p, b, None, None) for p, b in blobs] + [(t % sender.parts, None, t, x) for t, x in known]
    if rows:
        yield batch_of(rows, SENT_TYPES, SENT_NAMES)


def repeats(sent: DataFrame, parts: int, width: int, across: bool) -> DataFrame:
    """text_id and places (packed) of everything that repeats, from what ``_send`` gives: one row per text.

    A task settles its parts and sends what it found in one blob per bucket of texts, so rows do not grow with texts times parts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for part, blob, text, places in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if blob is None:
                    known = unpack_places([places])
                    found.append((np.full(len(known), text), known))
                else:
                    held.setdefault(part, []).append(blob)
        for part in list(held):
            found.append(settle(held.pop(part), width, across))
        if not found:
            return
        texts, places = (np.concatenate(x) for x in zip(*found, strict=True))
        bucket = texts % parts
        order = np.argsort(bucket, kind="stable")
        texts, places, bucket = texts[order], places[order], bucket[order]
        edges = np.flatnonzero(np.diff(bucket, prepend=-1, append=-1))
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield batch_of([(int(bucket[a]), pack_texts(texts[a:b], places[a:b]))], (pa.int32(), pa.binary()), ("bucket", "blob"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[bytes]] = {}
        for batch in batches:
            for bucket, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held.setdefault(bucket, []).append(blob)
        for bucket in list(held):
            texts, places = (np.concatenate(x) for x in zip(*map(unpack_texts, held.pop(bucket)), strict=True))
            texts, places, edges = by_text(texts, places)
            rows = [(int(texts[a]), pack_places(places[a:b])) for a, b in zip(edges[:-1], edges[1:], strict=True)]
            for k in range(0, len(rows), 4096):
                yield batch_of(rows[k : k + 4096], (pa.int64(), pa.binary()), ("text_id", "places"))

    found = sent.repartitionById(parts, "part").mapInArrow(run, "bucket int, blob binary")
    return checkpointed(found.repartitionById(parts, "bucket").mapInArrow(merge, "text_id long, places binary"))


def released(df: DataFrame) -> None:
    """Let Spark drop the shuffle files that nothing refers to any more (they are temporary copies of the text's size)."""
    for _ in range(2):  # what the first round lets go of may hold more
        gc.collect()
        df.sparkSession.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def repeated_windows(df: DataFrame, scheme: Scheme = BYTES) -> DataFrame:
    """text_id and places: packed starts (in units) of strings of the scheme's length that also start elsewhere.

    ``df`` has text_id (a hash of the text) and data (its bytes).
    """
    spark = df.sparkSession
    df = df.where(F.octet_length("data") >= (2 * scheme.length - 1 if scheme.words else scheme.length))
    total = df.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), total // PART_BYTES)

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = Sender(parts, NARROW, False)
        for batch in batches:
            for text, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                n, body, begins = scheme.units(data.as_py())
                places = scheme.sampled(n)
                for k in range(0, len(places), HELD_ROWS):
                    some = places[k : k + HELD_ROWS]
                    sender.add(text, names_of(scheme.strings(body, begins, some, scheme.name)), some)
                    if sender.rows >= HELD_ROWS:
                        yield from _send(sender)
        yield from _send(sender)

    near = repeats(df.mapInArrow(sample, SENT), parts, NARROW, False)
    released(df)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender, last_text = Sender(parts, WIDE, scheme.across), None
        for batch in batches:
            for text, data, blobs in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if text == last_text:  # copies lie side by side
                    continue
                last_text = text
                n, body, begins = scheme.units(data.as_py())
                for some in scheme.before(unpack_places([blobs.as_py()]), n):
                    sender.add(text, names_of(scheme.strings(body, begins, some, scheme.length)), some)
                    if sender.rows >= HELD_ROWS:
                        yield from _send(sender)
        yield from _send(sender)

    joined = df.join(near.withColumnRenamed("text_id", "near_id"), F.col("text_id") == F.col("near_id")).select("text_id", "data", "places").sortWithinPartitions("text_id")
    out = repeats(joined.mapInArrow(merge, SENT), parts, WIDE, scheme.across)
    released(df)
    return out


def removed(df: DataFrame, key: str = "doc_id", text: str = "text", passages: Scheme | None = None) -> DataFrame:
    """doc_id, n_bytes, kept (the remaining bytes), n_removed and n_spans of every document.

    With ``passages``, also n_passage_units: units (words) covered by strings of that scheme that another document has; they are only counted.
    """
    data = F.coalesce(F.col(text), F.lit("")).cast("binary")
    docs = df.select(F.col(key).cast("long").alias("doc_id"), F.xxhash64(data, F.octet_length(data)).alias("text_id"), data.alias("data"))
    copies = checkpointed(docs.groupBy("text_id").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first")).where("n > 1"))
    once = docs
    if copies.count() <= BROADCAST_ROWS:
        once = docs.join(F.broadcast(copies), "text_id", "left").where(F.col("n").isNull() | F.col("first").eqNullSafe(F.col("doc_id")))
    marks = copies.join(repeated_windows(once.select("text_id", "data")), "text_id", "full")
    shared = repeated_windows(once.select("text_id", "data"), passages).withColumnRenamed("places", "shared") if passages else None
    marks = marks.join(shared, "text_id", "full") if passages else marks.withColumn("shared", F.lit(None).cast("binary"))
    marks = checkpointed(marks.select(F.col("text_id").alias("mark_id"), "places", "shared", F.coalesce("n", F.lit(1)).alias("n")))
    released(df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, value, places, shared, n in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), batch.column(3), batch.column(4).to_pylist(), strict=True):
                data = value.as_py()
                if (n or 1) > 1 and passages and len(data) >= passages.length:
                    units = passages.units(data)[0]
                    covered = units if units >= passages.length else 0
                else:
                    covered = sum(b - a for a, b in spans_of(shared.as_py(), passages.length)) if shared.is_valid else 0
                if (n or 1) > 1 and len(data) >= LENGTH:
                    rows.append((doc, len(data), len(data), 1, b"", covered))
                else:
                    spans = spans_of(places.as_py(), LENGTH) if places.is_valid else []
                    borders = [0, *(x for span in spans for x in span), len(data)]
                    kept = b"".join(data[a:b] for a, b in zip(borders[::2], borders[1::2], strict=True))
                    rows.append((doc, len(data), len(data) - len(kept), len(spans), kept, covered))
                if len(rows) >= 1024:
                    yield batch_of(rows, kinds, names)
                    rows = []
            if rows:
                yield batch_of(rows, kinds, names)

    kinds, names = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64()), ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "n_passage_units")
    joined = docs.join(marks, F.col("text_id") == F.col("mark_id"), "left").select("doc_id", "data", "places", "shared", "n")
    found = joined.mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, n_passage_units long")
    return found if passages else found.drop("n_passage_units")


def spans_of(packed: bytes, length: int) -> list[tuple[int, int]]:
    """Maximal runs covered by strings of ``length`` that start at the packed places."""
    spans: list[tuple[int, int]] = []
    for a, b in zip(*(x.tolist() for x in runs(unpack_places([packed]))), strict=True):
        if spans and a <= spans[-1][1]:
            spans[-1] = (spans[-1][0], b - 1 + length)
        else:
            spans.append((a, b - 1 + length))
    return spans


def digest(df: DataFrame) -> DataFrame:
    """The contract's columns, and beside them what is left and the words in passages of more than 50 words that another document has."""
    found = removed(df, passages=WORDS)
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"), (F.col("n_bytes") - F.col("n_removed")).alias("kept_bytes"), F.col("n_passage_units").alias("n_passage_words"))


#: The same for DuckDB, in plain terms: every string of 400 bytes (as hexadecimal digits, cut from blocks of 1,024 bytes) and of 51 words, counted.
ORACLE = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS hx, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
n AS (SELECT *, len(hx) // 2 AS nb FROM d),
bl AS (SELECT r, nb, p0, substr(hx, 2 * p0 + 1, 2846) AS part FROM (SELECT r, nb, hx, unnest(range(0, nb - 399, 1024)) AS p0 FROM n WHERE nb >= 400)),
w AS (SELECT r, p0 + j AS i, md5(substr(part, 2 * j + 1, 800)) AS h FROM (SELECT r, p0, part, unnest(range(0, least(1024, nb - 399 - p0))) AS j FROM bl)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY h) AS c FROM w) WHERE c > 1),
g AS (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM m),
s AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS k FROM g),
sp AS (SELECT r, min(i) AS a, max(i) + 400 AS b FROM s GROUP BY r, k),
e AS (SELECT *, lag(b, 1, 0) OVER (PARTITION BY r ORDER BY a) AS before FROM sp),
kp AS (SELECT r, string_agg(substr(hx, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) || substr(any_value(hx), 2 * max(b) + 1) AS kh, sum(b - a) AS removed, count(*) AS spans FROM e JOIN n USING (r) GROUP BY r),
v AS (SELECT r, i, md5(array_to_string(list_slice(ws, i, i + 50), ' ')) AS h FROM (SELECT r, ws, unnest(range(1, len(ws) - 49)) AS i FROM d WHERE len(ws) >= 51)),
o AS (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nx FROM v JOIN (SELECT h FROM v GROUP BY h HAVING count(DISTINCT r) > 1) USING (h)),
pw AS (SELECT r, sum(least(51, coalesce(nx - i, 51))) AS words FROM o GROUP BY r)
SELECT doc_id, nb::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kh, hx))) AS kept_sha256, (nb - coalesce(removed, 0))::BIGINT AS kept_bytes, coalesce(words, 0)::BIGINT AS n_passage_words
FROM n LEFT JOIN kp USING (r) LEFT JOIN pw USING (r)
"""
