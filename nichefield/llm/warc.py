"""WARC archives: writing a record per page, and reading archives by splitting them at gzip members.

Each record is a gzip member of its own. Readers get byte ranges: a task looks for the gzip magic in its range, takes a
candidate only when its header is sound and the inflated text begins with a WARC version and has a header block, and
owns every record that starts inside the range, reading past its end for the last one. Bytes that look like a member
inside compressed data are passed over, because a proved member is followed to its end before the search goes on.

Archives are written by the tasks, each attempt under a name of its own, and only files named by a finished attempt
are read, so a lost executor leaves at most a file nobody reads. Files go through Arrow's file systems (local paths,
file://, s3://, hdfs:// ...), so the folder must be one that all executors reach.

Defined cases: a null html is an empty payload; equal payloads (empty ones too, from ``MIN_BYTES`` on) are one response,
that of the largest page_id, and revisits; null urls become ``about:blank``; an empty table writes no archive. Pages without
an identifier are left out unless ``unnamed`` asks for them, as op9 does: their record has a random id and no page header and
comes back with a null page_id. They refer to an equal payload of a page with identifier; without one each is a response, so
that no payload is lost (the SQL twin calls it a revisit of nothing).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.common import shared_dir
from .common import checkpointed, pieces, table

#: Payloads of fewer bytes are always responses of their own.
MIN_BYTES = 0
#: Bytes of an archive that one reading task looks for records in, and that it reads at once.
SPLIT_BYTES, READ_BYTES = 32 << 20, 1 << 20
VERSION = b"WARC/1.1"
MAGIC = b"\x1f\x8b\x08"
EMPTY_DATE = "1970-01-01T00:00:00Z"
_HEADER = re.compile(rb"WARC/1\.[01]\r\n(?:[^\r\n]+\r\n)+\r\n")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:uuid:{uuid.uuid4()}>" if page is None else f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}')}>"


def member(page: int | None, url: str, payload: bytes, refers_to: int | None, date: str = EMPTY_DATE) -> bytes:
    """One record as a gzip member. A revisit has the digest and size of its payload, but not the payload."""
    kind = "response" if refers_to is None else "revisit"
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page)}", f"WARC-Date: {date}", f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}",
            f"WARC-Payload-Digest: sha1:{digest(payload)}", *([] if page is None else [f"WARC-Identified-Page: {page}"]), "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page: {refers_to}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + (payload if refers_to is None else b"")
    text = b"\r\n".join([VERSION, *(h.encode() for h in head), b"Content-Length: %d" % len(block), b"", b""]) + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(text) + z.flush()


def parse(text: bytes) -> dict | None:
    """Headers (lower-cased names), payload and HTTP headers of one record, or None if it is not one."""
    found = _HEADER.match(text)
    if not found:
        return None
    lines = found[0].decode("utf-8", "replace").split("\r\n")[1:-2]
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(headers.get("content-length", "-1"))
    block = text[found.end():found.end() + size]
    if size < 0 or len(block) != size:
        return None
    http, _, payload = block.partition(b"\r\n\r\n")
    return headers | {"http": http, "payload": payload}


def filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or not path.startswith("file:") else "file://" + path.removeprefix("file:"))


def records(path: str, start: int, stop: int, read_bytes: int = READ_BYTES):
    """The records of an archive that start in [start, stop)."""
    store, name = filesystem(path)
    with store.open_input_file(name) as f:
        size = f.size()
        stop = min(stop, size)
        base, held = start, b""

        def more() -> bool:
            nonlocal held
            got = f.read_at(min(read_bytes, size - base - len(held)), base + len(held))
            held += got
            return bool(got)

        at = start
        while at < stop:
            held, base = held[at - base:], at
            while len(held) < len(MAGIC) and more():
                pass
            hit = held.find(MAGIC)
            if hit < 0:
                # The magic may lie across what is held and what comes next.
                at = base + max(1, len(held) - len(MAGIC) + 1)
                continue
            at = base + hit
            if at >= stop:
                return
            found, used = _member(held, hit, more, lambda: held)
            if found is None:
                at += 1
            else:
                yield found
                at += used


def _member(held: bytes, hit: int, more, now):
    """The record whose gzip member starts at ``hit`` and the member's size, or None."""
    z, text, fed = zlib.decompressobj(31), [], hit
    proved = False
    try:
        while not z.eof:
            data = now()[fed:fed + (64 << 10)]
            if not data:
                if not more():
                    return None, 0
                continue
            fed += len(data)
            text.append(z.decompress(data))
            if not proved and sum(map(len, text)) >= len(VERSION):
                if not b"".join(text).startswith(b"WARC/1."):
                    return None, 0
                proved = True
    except zlib.error:
        return None, 0
    return parse(b"".join(text)), fed - hit - len(z.unused_data)


def with_revisits(pages: DataFrame, min_bytes: int = MIN_BYTES, unnamed: bool = False) -> DataFrame:
    """(page_id, url, html, refers_to): of equal payloads the largest page_id is the response the others refer to.

    The groups are counted on the payload's SHA-256 and size, combined on the map side; they come back by a join that
    adaptive execution splits where a payload is hot, or by a broadcast when few payloads repeat.
    """
    rows = (pages if unnamed else pages.where("page_id is not null")).select(
        F.col("page_id").cast("bigint").alias("page_id"), F.coalesce("url", F.lit("about:blank")).alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.unhex(F.sha2("html", 256)))
    groups = checkpointed(rows.where(F.octet_length("html") >= min_bytes).groupBy("sha").agg(F.max("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
                          .where("n > 1").drop("n"))
    n = groups.count()
    joined = rows.join(F.broadcast(groups) if n <= 500_000 else groups, "sha", "left")
    return joined.select("page_id", "url", "html", F.expr("if(first <=> page_id, null, first)").alias("refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, html, refers_to) to archives under ``folder``; (path, bytes, records) of each archive."""
    def work(batches):
        store = out = path = None
        size = count = 0
        for piece in pieces(batches, "html"):
            if out is None:
                path = f"{folder.rstrip('/')}/{uuid.uuid4().hex}.warc.gz"
                store, name = filesystem(path)
                store.create_dir(name.rpartition("/")[0], recursive=True)
                out = store.open_output_stream(name, compression=None)
            for page, url, html, refers in zip(*(piece.column(k).to_pylist() for k in ("page_id", "url", "html", "refers_to"))):
                data = member(page, url, html.encode(), refers)
                out.write(data)
                size, count = size + len(data), count + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "bytes": pa.array([size], pa.int64()), "records": pa.array([count], pa.int64())})

    return checkpointed(pages.mapInArrow(work, "path string, bytes bigint, records bigint"))


def read_archives(spark: SparkSession, archives: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(page_id, record_id, record_type, url, payload, payload_bytes, payload_digest, refers_to) of every record.

    ``archives`` has ``path`` and ``bytes``. ``payload_bytes`` and ``payload_digest`` are those of the whole payload,
    for a response computed from what was read and for a revisit as its headers state them.
    """
    ranges = archives.select("path", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(split_bytes).cast("bigint"))).alias("start"))

    def work(batches):
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                held, size = [], 0
                for r in records(path, start, start + split_bytes):
                    held.append(r)
                    size += len(r["payload"])
                    if size >= 4 << 20:
                        yield rows_of(held)
                        held, size = [], 0
                if held:
                    yield rows_of(held)

    def rows_of(found):
        def http_size(r):
            m = re.search(rb"(?i)content-length:\s*(\d+)", r["http"])
            return int(m[1]) if m else None

        revisit = [r.get("warc-type") == "revisit" for r in found]
        number = lambda v: None if v is None else int(v)
        return pa.RecordBatch.from_pydict({
            "page_id": pa.array([number(r.get("warc-identified-page")) for r in found], pa.int64()),
            "record_id": pa.array([r.get("warc-record-id") for r in found]), "record_type": pa.array([r.get("warc-type") for r in found]),
            "url": pa.array([r.get("warc-target-uri") for r in found]),
            "payload": pa.array([None if v else r["payload"] for r, v in zip(found, revisit)], pa.binary()),
            "payload_bytes": pa.array([http_size(r) if v else len(r["payload"]) for r, v in zip(found, revisit)], pa.int64()),
            "payload_digest": pa.array([r.get("warc-payload-digest", "").removeprefix("sha1:") if v else digest(r["payload"]) for r, v in zip(found, revisit)]),
            "refers_to": pa.array([number(r.get("warc-refers-to-page")) for r in found], pa.int64())})

    # A round-robin deal of the ranges: a few rows, each standing for up to split_bytes of an archive.
    tasks = max(1, archives.agg(F.sum(F.ceil(F.col("bytes") / split_bytes)).alias("n")).first()["n"] or 1)
    return ranges.repartition(int(min(tasks, 100_000))).mapInArrow(
        work, "page_id bigint, record_id string, record_type string, url string, payload binary, payload_bytes bigint, payload_digest string, refers_to bigint")


def op9_warc(spark, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    archives = write_archives(with_revisits(table(spark, sf_dir, "pages"), unnamed=True), folder)
    return read_archives(spark, archives, 8 << 20).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op9_warc": op9_warc}
ORACLES = {"op9_warc": """
    with p as materialized (select page_id, encode(coalesce(html, '')) as b from pages),
         g as materialized (select b, max(page_id) as first from p group by b),
         h as materialized (select p.page_id, octet_length(p.b)::bigint as payload_bytes, sha1(p.b) as hex, g.first from p join g on p.b = g.b)
    select page_id, payload_bytes,
           array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
               (((('0x' || substr(hex, (k * 5) // 4 + 1, 1))::int * 16 + coalesce(nullif('0x' || substr(hex, (k * 5) // 4 + 2, 1), '0x'), '0x0')::int)
                 >> (3 - (k * 5) % 4)) & 31) + 1, 1) for k in range(0, 32)], '') as payload_digest,
           case when first = page_id then 'response' else 'revisit' end as record_type,
           case when first = page_id then null else first end as refers_to
    from h"""}
