"""WARC archives: written a record per page, read back by boundary chains.

Archives are gzip members, one for each record. Reading starts anywhere: tasks look in byte ranges
for everything that could begin a record and emit its offset with the offset its length leads to.
Magic inside a payload gives such candidates too; only what pointer jumping reaches from the start
of a file is a record.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veritrail.llm.common import forget, materialise, table
from veritrail.scratch import scratch_path

LEAST_REVISIT = 1000  # shorter payloads are stored each time
FILE_BYTES = 1 << 30
RANGE_BYTES = 4 << 20
DATE = "2000-01-01T00:00:00Z"
# Fixed values of the formats: a gzip member's first bytes, a record's first line, the revisit profile.
MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1."
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:veritrail:page:"

ARCHIVES = "file string, bytes long, records long"
RECORDS = "file string, offset long, successor long, record_type string, record_id string, target_uri string, refers_to_id string, payload_bytes long, payload_digest string"


def _store(root: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(root)


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *(f"{k}: {v}" for k, v in headers), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit of refers_to with the HTTP header alone."""
    urn = lambda i: f"<{URN}{'' if i is None else i}>"
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    uri = " ".join((url or "").split()) or f"{URN}{'' if page_id is None else page_id}"
    headers = [("WARC-Record-ID", urn(page_id)), ("WARC-Date", DATE), ("WARC-Target-URI", uri), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    if refers_to is None:
        return warc_record("response", headers, http + payload)
    return warc_record("revisit", [*headers, ("WARC-Refers-To", urn(refers_to)), ("WARC-Profile", PROFILE)], http)


def member(record: bytes) -> bytes:
    packed = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packed.compress(record) + packed.flush()


def revisit_groups(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """digest, response_id of payloads of least bytes and more that several rows share; only digests are shuffled."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    keyed = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("bytes"))
    shared = keyed.filter(F.col("bytes") >= least).groupBy("digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n"))
    return shared.filter("n > 1 and response_id is not null").select("digest", "response_id")


def write_archives(pages: DataFrame, root: str, file_bytes: int = FILE_BYTES, least: int = LEAST_REVISIT) -> DataFrame:
    """Write a record per row of pages (page_id, url, html) below root, which all executors reach; ARCHIVES.

    Of equal payloads of least bytes and more, the row with the largest page_id is a response and
    the others revisit it: several rows with that page_id are all responses, rows without a page_id
    revisit, unless none of the group has one (then all are responses). Null html is an empty
    payload. The list of archives is a written table: what a lost or repeated task left is in
    no list and is never read. An empty table writes no archive.
    """
    shared = materialise(revisit_groups(pages, least), "shared")
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    given = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    told = given.withColumn("digest", F.sha1("html")).join(shared, "digest", "left")
    told = told.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("response_id")), F.col("response_id")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        out, name, size, n, made = None, "", 0, 0, []

        def close():
            if out is not None:
                out.close()
                made.append((name, size, n))

        for batch in batches:
            for page_id, url, text, refers_to in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html", "refers_to"))):
                if out is None or size >= file_bytes:
                    close()
                    store.create_dir(folder, recursive=True)
                    name, n = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{folder}/{name}", compression=None)
                    first = member(warc_record("warcinfo", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n"))
                    out.write(first)
                    size = len(first)
                packed = member(page_record(page_id, url, text.encode(), refers_to))
                out.write(packed)
                size, n = size + len(packed), n + 1
        close()
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*made)], ["file", "bytes", "records"])

    archives = materialise(told.mapInArrow(write, ARCHIVES), "archives")
    forget(shared)
    return archives


def parse_record(data: bytes) -> dict | None:
    """Header fields, payload and digest of one record; None if its lengths don't hold."""
    head, mark, body = data.partition(b"\r\n\r\n")
    if not mark or not head.startswith(VERSION):
        return None
    lines = head.decode("utf-8", "replace").split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()) or len(body) != int(length) + 4 or not body.endswith(b"\r\n\r\n"):
        return None
    kind, block = fields.get("warc-type", ""), body[:-4]
    payload, size = block, len(block)
    if fields.get("content-type", "").startswith("application/http"):
        http, _, payload = block.partition(b"\r\n\r\n")
        said = [x.partition(b":")[2].strip() for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")]
        size = int(said[0]) if kind == "revisit" and said and said[0].isdigit() else len(payload)
    digest = hashlib.sha1(payload).hexdigest()
    if kind == "revisit":  # its payload is the other record's
        digest = base64.b32decode(fields.get("warc-payload-digest", "").removeprefix("sha1:")).hex()
    return {
        "record_type": kind, "record_id": fields.get("warc-record-id", "").strip("<>"), "target_uri": fields.get("warc-target-uri"),
        "refers_to_id": fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None, "payload_bytes": size, "payload_digest": digest, "payload": payload,
    }


def _unpack(stream, at: int, size: int, step: int = 1 << 16) -> tuple[bytes, int] | None:
    """The gzip member that begins at an offset and the offset after it; None if it is none or no record."""
    engine, parts, here, told = zlib.decompressobj(31), [], at, False
    try:
        while not engine.eof:
            if here >= size:
                return None
            chunk = stream.read_at(min(step, size - here), here)
            here += len(chunk)
            parts.append(engine.decompress(chunk))
            if not told and sum(map(len, parts)) >= len(VERSION):
                if not b"".join(parts).startswith(VERSION):
                    return None
                told = True
    except zlib.error:
        return None
    return b"".join(parts), here - len(engine.unused_data)


def record_candidates(archives: DataFrame, root: str, range_bytes: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """RECORDS (and payload) for all that could be a record in any byte range: true ones and magic inside payloads."""
    total = archives.agg(F.sum("bytes")).first()[0] or 0
    ranges = archives.filter("bytes > 0").select("file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(range_bytes).cast("long"))).alias("start"))
    parts = max(int(archives.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // (4 * range_bytes) + 1)
    schema = RECORDS + (", payload binary" if payload else "")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, folder = _store(root)
        for batch in batches:
            for file, size, start in zip(*(batch[c].to_pylist() for c in ("file", "bytes", "start"))):
                with store.open_input_file(f"{folder}/{file}") as stream:
                    data = stream.read_at(min(range_bytes + len(MAGIC) - 1, size - start), start)
                    rows, held, at = [], 0, data.find(MAGIC)
                    while 0 <= at < range_bytes:
                        got = _unpack(stream, start + at, size)
                        record = got and parse_record(got[0])
                        if record:
                            rows.append({"file": file, "offset": start + at, "successor": got[1], **record})
                            held += record["payload_bytes"] if payload else 0
                        if held > range_bytes:
                            yield _batch(rows, names, schema, types)
                            rows, held = [], 0
                        at = data.find(MAGIC, at + 1)
                    if rows:
                        yield _batch(rows, names, schema, types)

    return ranges.repartition(parts, "file", "start").mapInArrow(find, schema)


def _batch(rows: list[dict], names: list[str], schema: str, types: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], types[c.split()[1]]) for n, c in zip(names, schema.split(", "))], names)


def reachable(links: DataFrame) -> DataFrame:
    """file, offset of what is reached from offset 0 of each file over links (file, offset, successor).

    Pointer jumping: every round doubles the length of all jumps and of the chains reached, so
    rounds grow with the logarithm of the records in the longest file; each is written. Only counts
    come to the driver.
    """
    jumps = materialise(links.select("file", "offset", "successor"), "jumps")
    seen = materialise(jumps.filter("offset = 0").select("file", "offset"), "seen")
    n = seen.count()
    while n:
        ahead = seen.join(jumps, ["file", "offset"]).select("file", F.col("successor").alias("offset"))
        # a successor at the end of a file, or where nothing was found, begins no record
        onward = jumps.select("file", "offset", F.col("successor").alias("middle")).join(jumps.select("file", F.col("offset").alias("middle"), "successor"), ["file", "middle"]).select("file", "offset", "successor")
        more = materialise(seen.unionByName(ahead.join(links.select("file", "offset"), ["file", "offset"], "left_semi")).distinct(), "seen")
        last = more.count()
        forget(seen)
        seen = more
        if last == n:
            break
        n = last
        longer = materialise(onward, "jumps")
        forget(jumps)
        jumps = longer
    forget(jumps)
    return seen


def read_archives(archives: DataFrame, root: str, range_bytes: int = RANGE_BYTES, payload: bool = False) -> DataFrame:
    """RECORDS (and payload) of archives (file, bytes) below root: what a chain from the start of its file reaches.

    A file cut short gives the records before the cut; what stands after damage isn't reached and
    isn't returned. A revisit has no payload of its own: bytes and digest are those it names. The
    memory of a task is a byte range and a record.
    """
    found = materialise(record_candidates(archives, root, range_bytes, payload), "candidates")
    return found.join(reachable(found.select("file", "offset", "successor")), ["file", "offset"], "left_semi")


def archived_pages(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of page records (others left out)."""
    number = lambda c: F.regexp_extract(c, f"^{URN}(-?[0-9]+)$", 1).try_cast("long")
    return records.filter(F.col("record_type").isin("response", "revisit")).select(
        number(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", number(F.col("refers_to_id")).alias("refers_to")
    )


def op12_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written to archives and read back; nulls, repeats and empty tables as write_archives() states."""
    root = scratch_path(spark, "warc")
    return archived_pages(read_archives(write_archives(table(spark, sf_dir, "pages"), root), root))


OP12_SQL = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS size, sha1(coalesce(html, '')) AS digest FROM pages),
g AS (SELECT digest, max(page_id) AS last, count(*) AS n FROM p GROUP BY digest)
SELECT page_id, size::BIGINT AS payload_bytes, digest AS payload_digest, CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
CASE WHEN size >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p JOIN g USING (digest)
"""
