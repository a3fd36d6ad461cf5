"""WARC archives: writing, sequential reading, revisits (operator 10).

Each record is one gzip member.  A response record's block is an HTTP header
and the payload; a revisit's block is the HTTP header alone (profile
identical-payload-digest), whose Content-Length still gives the payload's size.

The reader goes through a file once: it inflates piece by piece, takes the
record header up to the blank line, frames the block by Content-Length, expects
two line ends and the end of the member, and holds block and payload against
their digests.  Its memory is one record.

Rows: null payloads count as empty; null page_ids are records without an
X-Page-Id field and sort after all others; of rows with equal id and payload
the first by place in the input is the response and the others revisit it.
Extra columns pass by.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_folder, open_input, prepare, publish, table
from .exact import SALT_ROWS, located

#: Payloads below this many bytes are never revisits.
MIN_REVISIT = 100
#: Bytes that the reader takes from a file at once.
READ = 1 << 16
# Of the WARC 1.1 format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


class WarcError(ValueError):
    pass


def digest_matches(stated: str, data: bytes) -> bool:
    """Is ``algorithm:value`` the digest of the data?  The value may be hexadecimal or base 32.

    Of an algorithm that is not known here nothing can be said; that is no damage.
    """
    name, _, value = stated.partition(":")
    name = name.strip().lower().replace("-", "")
    if name not in ("md5", "sha1", "sha256", "sha384", "sha512"):
        return True
    raw, value = hashlib.new(name, data).digest(), value.strip()
    return value.lower() == raw.hex() or value.upper().rstrip("=") == base64.b32encode(raw).decode().rstrip("=")


def record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    head = VERSION + b"\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode()
    head += f"Content-Length: {len(block)}\r\n\r\n".encode()
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(head) + z.compress(block) + z.compress(b"\r\n\r\n") + z.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, copied: bool, refers_to: int | None) -> bytes:
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if copied else http + payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{url}:{digest}")
    fields = [
        ("WARC-Type", "revisit" if copied else "response"),
        ("WARC-Record-ID", f"<urn:uuid:{name}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", _line(url or "")),
        ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()),
        ("WARC-Payload-Digest", "sha256:" + digest),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if copied:
        fields.append(("WARC-Profile", PROFILE))
    if refers_to is not None:
        fields.append(("X-Refers-To-Page-Id", str(refers_to)))
    return record(fields, block)


def _line(text: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in text)


def read_members(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record of a stream."""
    rest = stream.read(READ)
    while rest:
        z = zlib.decompressobj(31)
        plain, head, fields, need = bytearray(), None, {}, 0
        while True:
            plain += z.decompress(rest)
            rest = z.unused_data
            if head is None and (end := plain.find(b"\r\n\r\n")) >= 0:
                head, *lines = bytes(plain[:end]).split(b"\r\n")
                if not head.startswith(b"WARC/"):
                    raise WarcError("not a WARC record")
                fields = {k.strip().lower(): v.strip() for k, _, v in (x.decode().partition(":") for x in lines)}
                if not fields.get("content-length", "").isdigit():
                    raise WarcError("a record without Content-Length cannot be framed")
                need = int(fields["content-length"])
                del plain[: end + 4]
            if z.eof:
                break
            rest = stream.read(READ)
            if not rest:
                raise WarcError("the file ends within a member")
        if head is None or len(plain) != need + 4 or plain[need:] != b"\r\n\r\n":
            raise WarcError("the block does not match its Content-Length")
        block = bytes(plain[:need])
        if not digest_matches(fields.get("warc-block-digest", ""), block):
            raise WarcError("the block does not match its digest")
        yield fields, block
        rest = rest or stream.read(READ)


def read_records(stream) -> Iterator[tuple[int | None, int | None, str | None, str, int | None, bytes | None]]:
    """page_id, payload bytes, payload digest, type, refers_to, payload (of responses).

    A response's size and SHA-256 are those of its payload, whatever its head
    says or leaves out; a revisit's are the stated ones, null where it states none.
    """
    for fields, block in read_members(stream):
        kind = fields.get("warc-type")
        if kind not in ("response", "revisit"):
            continue
        http, _, payload = block.partition(b"\r\n\r\n")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.decode("latin-1").partition(":") for x in http.split(b"\r\n")[1:])}
        length, stated = headers.get("content-length", ""), fields.get("warc-payload-digest", "")
        if kind == "response":
            if length.isdigit() and len(payload) != int(length) or not digest_matches(stated, payload):
                raise WarcError("the payload does not match its head or its digest")
            size, digest = len(payload), hashlib.sha256(payload).hexdigest()
        else:
            size, digest, payload = int(length) if length.isdigit() else None, stated.removeprefix("sha256:") or None, None
        own, other = fields.get("x-page-id"), fields.get("x-refers-to-page-id")
        yield int(own) if own is not None else None, size, digest, kind, int(other) if other is not None else None, payload


def with_first(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and refers_to: the page that shows the same payload first.

    Groups of equal payloads are counted before the shuffle, and what a large
    group's rows look up is dealt to many salts.  The payloads themselves are
    shuffled once, by their place in the input.
    """
    html = F.coalesce(F.col("html"), F.lit(""))
    page_id, digest = F.col("page_id").cast("long").alias("page_id"), F.sha2(html.cast("binary"), 256).alias("digest")
    pages = located(pages.select("page_id", "url", "html"))
    keys = pages.where(F.octet_length(html) >= MIN_REVISIT).select("locator", page_id, digest)
    order = F.struct(F.col("page_id").isNull().alias("absent"), "page_id", "locator")
    groups = keys.groupBy("digest").agg(F.min(order).alias("lead"), F.count(F.lit(1)).alias("n")).where("n > 1")
    salts = F.ceil(F.col("n") / SALT_ROWS).cast("int")
    groups = groups.select("digest", "lead", F.explode(F.sequence(F.lit(0), salts - 1)).alias("salt"), salts.alias("salts"))
    own = keys.join(groups.where("salt = 0").select("digest", "salts"), "digest")
    own = own.withColumn("salt", F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int"))
    later = own.join(groups.select("digest", "salt", "lead"), ["digest", "salt"]).where(F.col("locator") != F.col("lead.locator"))
    later = later.select("locator", F.col("lead.page_id").alias("refers_to"), F.lit(True).alias("copied"))
    rows = pages.select("locator", page_id, "url", "html", digest).join(later, "locator", "left")
    return rows.select("page_id", "url", "html", "digest", "refers_to", F.coalesce("copied", F.lit(False)).alias("copied"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write a file of records for each partition; returns (part, records)."""
    spark = pages.sparkSession
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, n = TaskContext.get().partitionId(), 0
        first_batch = next(batches, None)
        if first_batch is None:
            return

        def write(out) -> None:
            nonlocal n
            batch = first_batch
            while batch is not None:
                for page, url, html, digest, refers_to, copied in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    out.write(page_record(page, url, (html or "").encode(), digest, copied, refers_to))
                    n += 1
                batch = next(batches, None)

        publish(folder, f"pages-{part:05d}.warc.gz", write)
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int64()), "records": pa.array([n], pa.int64())})

    return with_first(pages).mapInArrow(run, "part long, records long")


def read_archives(spark: SparkSession, folder: str, parts: list[int]) -> DataFrame:
    """Rows of all records of the archives, one task a file."""
    prepare(spark)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for part in batch.column(0).to_pylist():
                with open_input(folder, f"pages-{part:05d}.warc.gz") as stream:
                    rows = [x[:5] for x in read_records(stream)]
                columns = zip(*rows, strict=True) if rows else [[]] * 5
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    listed = spark.createDataFrame([(p,) for p in parts], "part long").repartitionByRange(max(1, len(parts)), "part")
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
    return listed.mapInArrow(run, schema)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "warc")
    done = write_archives(table(spark, sf_dir, "pages"), folder).collect()  # one row a file
    return read_archives(spark, folder, sorted(r["part"] for r in done))


OP10_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), q AS (
  SELECT page_id, strlen(h) AS payload_bytes, sha256(h) AS payload_digest,
         CASE WHEN strlen(h) >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first
  FROM p
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM q
"""
