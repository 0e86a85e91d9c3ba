"""Web archives: WARC records packaged in ZIP archives, and a reader that fetches records
by byte range.

Writing (``write_archives``): each task writes one archive of stored (uncompressed) members,
``archive/data.warc.gz`` with one gzip member per record and ``indexes/index.cdxj`` with
one line per record (offset and length inside the member). The archive's name carries the
task attempt, and only names returned by successful tasks enter the checkpointed manifest,
so a retried or speculative task leaves at most an unread file.

Reading (``read_records``): from the archive's tail the end-of-central-directory record is
found, through ZIP64's where its fields say so, then the central directory, the local
headers of the members and the index; records are fetched by range reads. No archive is
extracted or read whole: the index is streamed and records are read one by one.

Defined cases: null html is an empty payload; a null page_id is written without its header and
never referred to; repeated rows are records each; a very long page is one record, held whole
while it is written or read; empty tables write no archive; other columns are never read.

Files are reached through ``pyarrow.fs`` by URI below the shared folder that the cluster
names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import checkpoint_dir, cut_lineage

MIN_REVISIT = 1000       # payloads shorter than this are always stored
DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
LIMIT32, LIMIT16 = 0xFFFFFFFF, 0xFFFF
DATE = "2024-01-01T00:00:00Z"

# --- ZIP packaging ---------------------------------------------------------------------


class StoredZip:
    """Writes stored members one after the other to a stream; sizes are patched in through
    ZIP64 data descriptors, so nothing is held in memory but the directory. With
    ``zip64`` every size and offset is written in its 64-bit form, whatever its size."""

    def __init__(self, out, zip64: bool = False):
        self.out, self.at, self.members, self.zip64 = out, 0, [], zip64

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def open(self, name: str) -> None:
        raw = name.encode()
        self.members.append({"name": raw, "offset": self.at, "size": 0, "crc": 0})
        extra = struct.pack("<HHQQ", 1, 16, 0, 0)  # a ZIP64 field: the descriptor has 64-bit sizes
        self._put(struct.pack("<IHHHHHIIIHH", 0x04034B50, 45, 0x0808, 0, 0, 0x21, 0, LIMIT32, LIMIT32,
                              len(raw), len(extra)) + raw + extra)
        self.members[-1]["data"] = self.at

    def write(self, data: bytes) -> int:
        """Returns the data's offset inside the member."""
        m = self.members[-1]
        at = m["size"]
        m["crc"], m["size"] = zlib.crc32(data, m["crc"]), at + len(data)
        self._put(data)
        return at

    def close_member(self) -> None:
        m = self.members[-1]
        self._put(struct.pack("<IIQQ", 0x08074B50, m["crc"], m["size"], m["size"]))

    def finish(self) -> None:
        start, big = self.at, self.zip64
        for m in self.members:
            wide = big or m["size"] >= LIMIT32 or m["offset"] >= LIMIT32
            extra = struct.pack("<HHQQQ", 1, 24, m["size"], m["size"], m["offset"]) if wide else b""
            size, offset = (LIMIT32, LIMIT32) if wide else (m["size"], m["offset"])
            self._put(struct.pack("<IHHHHHHIIIHHHHHII", 0x02014B50, 45, 45, 0x0808, 0, 0, 0x21, m["crc"], size, size,
                                  len(m["name"]), len(extra), 0, 0, 0, 0, offset) + m["name"] + extra)
        size, n = self.at - start, len(self.members)
        if big or start >= LIMIT32 or size >= LIMIT32 or n >= LIMIT16:
            at = self.at
            self._put(struct.pack("<IQHHIIQQQQ", 0x06064B50, 44, 45, 45, 0, 0, n, n, size, start))
            self._put(struct.pack("<IIQI", 0x07064B50, 0, at, 1))
            n, size, start = LIMIT16, LIMIT32, LIMIT32
        self._put(struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, n, n, size, start, 0))


def directory(file, size: int) -> dict[str, tuple[int, int]]:
    """Stored members of a ZIP file: name -> (offset of the data, length). ``file`` offers
    ``read_at(n, offset)``. Members that are compressed are left out."""
    tail_at = max(0, size - 22 - LIMIT16)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06", 0, max(0, len(tail) - 18))  # the record has 22 bytes at least
    while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
        at = tail.rfind(b"PK\x05\x06", 0, at)
    if at < 0:
        raise ValueError("no end of central directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    if LIMIT16 == n or LIMIT32 in (length, start):
        sig, _, at64, _ = struct.unpack("<IIQI", file.read_at(20, tail_at + at - 20))
        if sig == 0x07064B50:
            head = file.read_at(56, at64)
            if head[:4] != b"PK\x06\x06":
                raise ValueError("no ZIP64 end of central directory")
            n, length, start = struct.unpack_from("<QQQ", head, 32)
    listing, out, p = file.read_at(length, start), {}, 0
    for _ in range(n):
        (sig, _, _, _, method, _, _, _, packed, full, n_name, n_extra, n_note, _, _, _, offset) = struct.unpack_from(
            "<IHHHHHHIIIHHHHHII", listing, p)
        if sig != 0x02014B50:
            raise ValueError("broken central directory")
        name = listing[p + 46:p + 46 + n_name].decode()
        e, end = p + 46 + n_name, p + 46 + n_name + n_extra
        while e + 4 <= end:
            kind, size_e = struct.unpack_from("<HH", listing, e)
            if kind == 1:  # ZIP64: only the fields that are at their limit, in this order
                q = e + 4
                if full == LIMIT32:
                    full, q = struct.unpack_from("<Q", listing, q)[0], q + 8
                if packed == LIMIT32:
                    packed, q = struct.unpack_from("<Q", listing, q)[0], q + 8
                if offset == LIMIT32:
                    offset = struct.unpack_from("<Q", listing, q)[0]
            e += 4 + size_e
        p = end + n_note
        if method == 0:
            local = file.read_at(30, offset)
            l_name, l_extra = struct.unpack_from("<HH", local, 26)
            out[name] = (offset + 30 + l_name + l_extra, packed)
    return out


# --- WARC records ----------------------------------------------------------------------

def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id, url, payload: bytes, digest: str, refers_to) -> bytes:
    """One record. A response holds an HTTP message with the payload, a revisit its header
    only; both carry the digest of the full payload. ``refers_to`` None: a response."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit = refers_to is not None
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
            f"WARC-Date: {DATE}", f"WARC-Target-URI: {''.join((url or 'about:blank').split())}",
            f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
            f"Content-Length: {len(block)}"]
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                 f"WARC-Refers-To: {record_id(refers_to)}", f"X-Refers-To-Page: {refers_to}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Headers, and what the payload itself shows: its length and SHA-1 where it is there."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    h = dict(x.split(": ", 1) for x in lines[1:])
    block = rest[:int(h["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    said = dict(x.split(b": ", 1) for x in http.split(b"\r\n")[1:])
    response = h["WARC-Type"] == "response"
    digest = h["WARC-Payload-Digest"].removeprefix("sha1:")
    if response and hashlib.sha1(payload).hexdigest() != digest:
        raise ValueError("payload differs from its digest")
    page, to = h.get("X-Page-Id"), h.get("X-Refers-To-Page")
    return {"page_id": int(page) if page else None, "url": h["WARC-Target-URI"],
            "payload_bytes": len(payload) if response else int(said[b"Content-Length"]),
            "payload_digest": digest, "record_type": h["WARC-Type"], "refers_to": int(to) if to else None,
            "payload": payload if response else None}


# --- on Spark --------------------------------------------------------------------------

def classify(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to: a page whose payload of ``min_revisit`` bytes
    or more also belongs to a page with a larger page_id refers to the largest of them.

    Digests are aggregated before the shuffle, and those that pages share are checkpointed, so
    that the join back is a plain one, which AQE splits for a payload of very many pages."""
    body = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    held = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html",
                        F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("n"))
    last = cut_lineage(held.where(F.col("n") >= min_revisit).groupBy("digest")
                       .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies"))
    return (held.join(last, "digest", "left")
            .withColumn("refers_to", F.when((F.col("n") >= min_revisit) & ~F.col("page_id").eqNullSafe(F.col("last")), F.col("last")))
            .select("page_id", "url", "html", "digest", "refers_to"))


ARCHIVE_BYTES, ARCHIVE_RECORDS = 1 << 30, 1_000_000


def write_archives(records: DataFrame, zip64: bool = False, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Writes ``classify`` rows; returns the checkpointed manifest (uri, records). A task goes
    on to another archive at ``archive_bytes`` or ``ARCHIVE_RECORDS``, so no archive and no
    index grows with a task's rows; tasks without rows write none."""
    spark = records.sparkSession
    root = f"{checkpoint_dir(spark)}/warc-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]):
        from pyspark import TaskContext
        out = z = name = None
        index: list[bytes] = []

        def finished() -> pa.RecordBatch:
            z.close_member()
            z.open(INDEX)
            for line in index:
                z.write(line + b"\n")
            z.close_member()
            z.finish()
            out.close()
            done = pa.RecordBatch.from_arrays([pa.array([f"{root}/{name}"]), pa.array([len(index)], pa.int64())], ["uri", "records"])
            index.clear()
            return done

        for b in batches:
            cols = [b.column(i).to_pylist() for i in range(5)]
            for page, url, html, digest, to in zip(*cols):
                if z is None:
                    store, path = pafs.FileSystem.from_uri(root)
                    store.create_dir(path, recursive=True)
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.wacz"
                    out = store.open_output_stream(f"{path}/{name}")
                    z = StoredZip(out, zip64)
                    z.open(DATA)
                raw = warc_record(page, url, (html or "").encode(), digest, to)
                pack = zlib.compressobj(1, zlib.DEFLATED, 31)
                data = pack.compress(raw) + pack.flush()
                index.append(json.dumps({"offset": z.write(data), "length": len(data), "filename": DATA}).encode())
                if z.at >= archive_bytes or len(index) >= ARCHIVE_RECORDS:
                    yield finished()
                    z = None
        if z is not None:
            yield finished()

    return cut_lineage(records.select("page_id", "url", "html", "digest", "refers_to").mapInArrow(run, "uri string, records long"))


def index_lines(file, at: int, length: int, step: int = 1 << 20) -> Iterator[dict]:
    """Entries of an index member, read ``step`` bytes at a time."""
    rest, end = b"", at + length
    while at < end:
        got = file.read_at(min(step, end - at), at)
        at += len(got)
        *lines, rest = (rest + got).split(b"\n")
        yield from map(json.loads, lines)
    if rest:
        yield json.loads(rest)


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_records(manifest: DataFrame, batch: int = 1000, payloads: bool = False) -> DataFrame:
    """Every record of the archives listed in ``manifest`` (uri), by range reads; the
    payload itself (null for a revisit) only if asked for."""
    names = [c.split()[0] for c in RECORDS.split(", ")] + ["payload"] * payloads
    schema = RECORDS + ", payload binary" * payloads
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()] + [pa.binary()] * payloads

    def as_batch(rows: list[dict]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)

    def run(batches: Iterator[pa.RecordBatch]):
        rows: list[dict] = []
        for b in batches:
            for uri in b.column(0).to_pylist():
                store, path = pafs.FileSystem.from_uri(uri)
                with store.open_input_file(path) as f:
                    members = directory(f, f.size())
                    for entry in index_lines(f, *members[INDEX]):
                        data_at, _ = members[entry["filename"]]
                        raw = zlib.decompress(f.read_at(entry["length"], data_at + entry["offset"]), 31)
                        rows.append(parse_record(raw))
                        if len(rows) >= batch:
                            yield as_batch(rows)
                            rows = []
        if rows:
            yield as_batch(rows)

    n = max(1, manifest.count())
    return manifest.select("uri").repartition(n, "uri").mapInArrow(run, schema)


def round_trip(pages: DataFrame) -> DataFrame:
    """Writes every page and reads the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Null html is an empty payload; pages without page_id are responses unless a page with
    one shares their payload; rows that repeat a page_id are responses alike where it is the
    largest; an empty table gives no rows; extra columns are ignored."""
    manifest = write_archives(classify(pages))
    return read_records(manifest).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS n, sha1(coalesce(html, '')) AS d FROM pages),
l AS (SELECT d, max(page_id) AS last FROM p WHERE n >= 1000 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last AND last IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM p LEFT JOIN l ON p.d = l.d
"""
