"""WARC writing, segment reassembly and chunked transfer decoding.

The writer lays every page out as WARC records: an HTTP response whose body is framed in chunks, cut into segments (a first record
and continuation records that name it) when it is longer than a segment; pages whose payload an earlier-chosen response
already holds become revisit records.  The archives are ordinary ``.warc.gz`` files, each record a gzip member of its own, written through Spark's own
file systems: a member ends in the high byte of the record's length, which is zero, so the text writer's line end is that byte.

The reader takes archives of any number of members (or none: plain files), groups continuation records by the identifier of their origin, orders them by
segment number, verifies the total length, decodes the chunked framing and checks the payload's digest; what a revisit refers to is found by
its digest.  Only segmented records are shuffled with their blocks, grouped by origin (one page, never more).

Defined results: a null html is the empty payload; of equal payloads the row with the largest page_id is the response (rows that share it are all
responses), ties of null ids count below every id; an archive that misses a segment or whose lengths differ gives an error instead of a short payload; an empty table gives an
empty result; very long pages are segmented; columns other than page_id, url and html, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.common import checkpointed, delete_folder, ensure_checkpoint_dir

SEGMENT = 32_768
CHUNK = 4_096
RECORDS_PER_FILE = 384
#: Longer blocks are always segmented, so that a record's length has a zero high byte and files keep to a size.
MOST_SEGMENT = 4 << 20
DATE = "2024-01-01T00:00:00Z"
CRLF = b"\r\n"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    """Chunked transfer framing of a body."""
    parts = [b"%x\r\n%b\r\n" % (len(p), p) for k in range(0, len(payload), size) if (p := payload[k : k + size])]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; trailers are skipped, broken framing is an error."""
    out, at = [], 0
    while True:
        end = body.index(CRLF, at)
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != CRLF:
            raise ValueError("a chunk does not end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def record(kind: str, record_id: str, block: bytes, fields: list[tuple[str, str]]) -> bytes:
    """One WARC record with the CRLF CRLF that follows it."""
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<{record_id}>"), ("WARC-Date", DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in lines) + CRLF + block + CRLF + CRLF


def member(data: bytes) -> bytes:
    """A gzip member of a record, without its last byte (zero, as records are shorter than 16 MB)."""
    packer = zlib.compressobj(3, zlib.DEFLATED, 31)
    out = packer.compress(data) + packer.flush()
    if out[-1]:
        raise ValueError("a record of 16 MB or more")
    return out[:-1]


def unpacked(data: bytes) -> bytes:
    """The bytes of an archive: all its gzip members, or the file as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        reader = zlib.decompressobj(31)
        out.append(reader.decompress(data))
        if not reader.eof:
            raise ValueError("the last member is cut short")
        data = reader.unused_data.lstrip(b"\0")
    return b"".join(out)


def one_line(text: str | None) -> str:
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to_url: str | None, is_revisit: bool, unique: str, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one page."""
    named = lambda *parts: f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(parts))}"
    origin, segment = named(unique), min(segment, MOST_SEGMENT)
    http = ("Content-Type", "application/http; msgtype=response")
    common = [http, ("WARC-Target-URI", one_line(url)), ("WARC-Payload-Digest", f"sha1:{digest_of(payload)}"), ("X-Page-ID", "" if page_id is None else str(page_id))]
    if is_revisit:
        head = b"HTTP/1.1 200 OK\r\n\r\n"
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Target-URI", one_line(refers_to_url)), ("WARC-Refers-To-Date", DATE)]
        yield record("revisit", origin, head, common + more)
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    pieces = [block[k : k + segment] for k in range(0, len(block), segment)]
    if len(pieces) == 1:
        yield record("response", origin, block, common)
        return
    for number, piece in enumerate(pieces, 1):
        fields = [("WARC-Segment-Number", str(number))]
        if number == 1:
            yield record("response", origin, piece, common + fields)
            continue
        fields.append(("WARC-Segment-Origin-ID", f"<{origin}>"))
        if number == len(pieces):
            fields.append(("WARC-Segment-Total-Length", str(len(block))))
        yield record("continuation", named(unique, str(number)), piece, fields)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of every record of one archive."""
    at = 0
    while at < len(data):
        if data.startswith(CRLF, at):
            at += 2
            continue
        if not data.startswith(b"WARC/", at):
            raise ValueError(f"no record begins at byte {at}")
        end = data.index(b"\r\n\r\n", at)
        lines = data[at:end].decode().split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        length = int(fields["content-length"])
        start = end + 4
        if start + length > len(data):
            raise ValueError("the last record is cut short")
        yield fields, data[start : start + length]
        at = start + length


def with_roles(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", salts: int = 64) -> DataFrame:
    """page_id, url, payload, refers_to, refers_to_url, is_revisit: of equal payloads the largest page_id is the response.

    The largest ids are aggregated before the shuffle; those of payloads that occur more than once are joined back, salted.
    """
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    twice = rows.groupBy("digest").agg(F.max("page_id").alias("top"), F.max_by(F.struct("url"), F.struct("page_id", "url")).alias("at"), F.count(F.lit(1)).alias("n")).where("n > 1")
    twice = twice.select("digest", "top", F.col("at.url").alias("top_url"), F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    salted = rows.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    joined = salted.join(twice, ["digest", "salt"], "left")
    again = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top"))
    return joined.select("page_id", "url", "payload", F.when(again, F.col("top")).alias("refers_to"), F.when(again, F.col("top_url")).alias("refers_to_url"), again.alias("is_revisit"))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT, records_per_file: int = RECORDS_PER_FILE) -> None:
    """Write the records of ``with_roles`` rows as archive files under ``path`` (any file system Spark knows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n in range(batch.num_rows):
                page_id, url, payload, to, again, unique = (batch.column(i)[n].as_py() for i in range(6))
                out = [member(x) for x in records_of(page_id, url, payload, to, again, unique, segment)]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    # the same row gets the same identifier when a task runs again
    unique = F.concat_ws(":", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.sha1("payload"), F.monotonically_increasing_id().cast("string"))
    rows = pages.select("page_id", "url", "payload", "refers_to_url", "is_revisit", unique.alias("unique"))
    records = rows.mapInArrow(run, "record binary").select(F.col("record").cast("string").alias("value"))
    records.write.mode("overwrite").option("lineSep", "\0").option("maxRecordsPerFile", records_per_file).text(path)
    spark = pages.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    folder = hadoop(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    for status in files.listStatus(folder):
        if (name := status.getPath().getName()).startswith("part-"):
            files.rename(status.getPath(), hadoop(folder, name.removesuffix(".txt") + ".warc.gz"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """Records of the archives under ``path``: kind, origin, number, total, page_id, digest, block."""
    schema = "kind string, origin string, number int, total long, page_id long, digest string, block binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: int(x) if x else None
        pack = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for value in batch.column(0):
                rows, held = [], 0
                for f, block in parse(unpacked(value.as_py())):
                    own = f["warc-record-id"].strip("<>")
                    rows.append((f["warc-type"], f.get("warc-segment-origin-id", own).strip("<>"), number(f.get("warc-segment-number")), number(f.get("warc-segment-total-length")), number(f.get("x-page-id")), f.get("warc-payload-digest", "").removeprefix("sha1:"), block))
                    held += len(block)
                    if held > 1 << 22 or len(rows) >= 512:
                        yield pack(rows)
                        rows, held = [], 0
                if rows:
                    yield pack(rows)

    kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in schema.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc*").load(path).select("content")
    return files.mapInArrow(run, schema)


def reassembled(records: DataFrame) -> DataFrame:
    """One row per page: page_id, payload, payload_digest, payload_bytes, record_type, refers_to.

    Segments are grouped by the record they continue and ordered by number; every number from 1 must be there and the lengths
    must add up to the total, or the job fails.
    """
    segmented = records.where("number is not null")
    part = F.struct("number", "total", "page_id", "digest", "block")
    grouped = segmented.groupBy("origin").agg(F.sort_array(F.collect_list(part)).alias("parts"))
    block = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["block"]))
    whole = grouped.select(F.element_at("parts", 1)["page_id"].alias("page_id"), F.element_at("parts", 1)["digest"].alias("digest"), F.element_at("parts", -1)["total"].alias("total"), F.element_at("parts", -1)["number"].alias("last"), F.size("parts").alias("n"), block.alias("block"))
    broken = (F.col("n") != F.col("last")) | ~F.col("total").eqNullSafe(F.length("block").cast("long"))
    whole = whole.select("page_id", "digest", F.when(broken, F.raise_error("a segment is missing, or the total length differs").cast("binary")).otherwise(F.col("block")).alias("block"))
    single = records.where("number is null and kind = 'response'").select("page_id", "digest", "block")
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            payloads, digests = [], []
            for said, block in zip(batch.column(1).to_pylist(), batch.column(2), strict=True):
                head, _, body = block.as_py().partition(b"\r\n\r\n")
                payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
                if (own := digest_of(payload)) != said:
                    raise ValueError("the payload's digest differs")
                payloads.append(payload)
                digests.append(own)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(payloads, pa.binary()), pa.array(digests)], names=["page_id", "payload", "payload_digest"])

    responses = single.unionByName(whole).mapInArrow(run, "page_id long, payload binary, payload_digest string")
    responses = responses.select("page_id", "payload", "payload_digest", F.length("payload").cast("long").alias("payload_bytes"), F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to"))
    return responses


def described(records: DataFrame, salts: int = 64) -> DataFrame:
    """page_id, payload_digest, payload_bytes, record_type, refers_to of every page; revisits get length and page of the response with their digest (salted: one payload may have most of them)."""
    responses = checkpointed(reassembled(records).drop("payload"))
    revisits = checkpointed(records.where("kind = 'revisit'").select("page_id", F.col("digest").alias("payload_digest"), F.lit("revisit").alias("record_type")))
    held = responses.join(revisits.select("payload_digest").distinct(), "payload_digest", "left_semi").groupBy("payload_digest").agg(F.max("payload_bytes").alias("payload_bytes"), F.max("page_id").alias("refers_to"))
    held = held.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    salted = revisits.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(salts)).cast("int"))
    known = salted.join(held, ["payload_digest", "salt"], "left").drop("salt")
    known = known.withColumn("payload_bytes", F.coalesce("payload_bytes", F.raise_error(F.lit("a revisit refers to no response")).cast("long")))
    return responses.unionByName(known)


def digest(pages: DataFrame) -> DataFrame:
    """Write archives of all pages to the shared folder, read them back and describe each page; the archives are deleted then."""
    spark = pages.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(with_roles(pages), path)
    out = checkpointed(described(read_archives(spark, path)).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"))
    delete_folder(spark, path)
    return out


#: The same for DuckDB: 20 bits of the hash, five hexadecimal digits, are four letters of base 32.
ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT *, sha1(h) AS x, max(page_id) OVER (PARTITION BY h) AS top FROM p),
r AS (SELECT *, top IS NOT NULL AND page_id IS DISTINCT FROM top AS again FROM d)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(x, (i // 4 * 5 + 1)::INT, 5))::INT >> (15 - i % 4 * 5)::INT) & 31) + 1, 1)), '') AS payload_digest,
CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN again THEN top END AS refers_to FROM r
"""
