import gzip
import hashlib
import io
import zipfile

import pytest
from pyarrow import fs as pafs

from feedlens.llm import warc

SCHEMA = "page_id long, url string, html string, digest string, n long, last long"


def pages(spark):
    big, other = "<p>" + "x" * 1200 + "ü</p>", "<p>" + "y" * 996
    rows = [(1, "http://a", big), (2, "http://b", big), (9, None, big), (3, "http://c d\r\n", "<p>small</p>"), (4, "http://e", "<p>small</p>"),
            (5, "http://f", None), (6, "", ""), (7, "http://g", other), (8, "http://g", other + "\r\n\r\nz"), (9, "http://h", big),
            (None, "http://n", big), (None, None, None), (10, "http://i", other)]
    return spark.createDataFrame([(*r, "clash", 1, 2) for r in rows], SCHEMA), rows


def brute(rows):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        last = max((j for j, _, h in rows if j is not None and (h or "").encode() == body), default=None)
        revisit = len(body) >= 1000 and last is not None and i != last
        out.append((i, len(body), hashlib.sha1(body).hexdigest(), "revisit" if revisit else "response", last if revisit else None))
    return sorted(out, key=str)


def test_round_trip(spark):
    df, rows = pages(spark)
    assert sorted(map(tuple, warc.round_trip(df).collect()), key=str) == brute(rows)
    assert warc.round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


@pytest.mark.parametrize("zip64", [False, True])
def test_archives_are_zip_and_warc(spark, zip64):
    df, rows = pages(spark)
    manifest = warc.write_archives(warc.classify(df).coalesce(1), zip64)
    uri = manifest.first()["uri"]
    store, path = pafs.FileSystem.from_uri(uri)
    with store.open_input_file(path) as f:
        data = f.read()
        members = warc.directory(f, f.size())
    z = zipfile.ZipFile(io.BytesIO(data))
    assert z.testzip() is None and z.namelist() == [warc.DATA, warc.INDEX] == list(members)
    assert all(i.compress_type == zipfile.ZIP_STORED for i in z.infolist())
    assert all(data[at:at + n] == z.read(name) for name, (at, n) in members.items())
    assert gzip.decompress(z.read(warc.DATA)).count(b"WARC/1.1\r\n") == len(rows)
    got = warc.read_records(manifest, batch=2, payloads=True).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows)
    html = {(i, (h or "").encode()) for i, _, h in rows}
    assert all((r["page_id"], bytes(r["payload"])) in html for r in got if r["record_type"] == "response")
    assert all(r["payload"] is None for r in got if r["record_type"] == "revisit")


class Memory:
    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


def test_directories_of_other_writers():
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("plain", b"stored text")
        z.writestr("packed", b"left out " * 50, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a note PK\x05\x06 with a signature"
    data = out.getvalue()
    got = warc.directory(Memory(data), len(data))
    assert list(got) == ["plain"] and data[got["plain"][0]:][:got["plain"][1]] == b"stored text"
    with pytest.raises(ValueError):
        warc.directory(Memory(b"no archive"), 10)


def test_damaged_payload_is_noticed():
    raw = warc.warc_record(1, "http://a", b"payload", hashlib.sha1(b"payload").hexdigest(), None)
    assert warc.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        warc.parse_record(raw.replace(b"payload\r\n\r\n", b"pxyload\r\n\r\n"))


def test_archives_end_at_a_size(spark):
    df, rows = pages(spark)
    manifest = warc.write_archives(warc.classify(df).coalesce(1), archive_bytes=900).collect()
    assert len(manifest) > 2 and sum(m["records"] for m in manifest) == len(rows) and len({m["uri"] for m in manifest}) == len(manifest)
    got = warc.read_records(spark.createDataFrame(manifest)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got), key=str) == brute(rows)


def test_a_payload_of_most_pages_is_split(spark):
    """Half of the rows share one payload: the join back is one that Spark splits."""
    hot = "".join(hashlib.sha512(str(i).encode()).hexdigest() for i in range(300))    # longer than a compressed block
    df = spark.range(1200).selectExpr("id AS page_id", "'u' AS url", f"if(id % 2 = 0, '{hot}', concat('other ', id % 70)) AS html")
    keep = {c: spark.conf.get(c, None) for c in ("spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes",
                                                 "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.skewJoin.skewedPartitionFactor")}
    try:
        for c, v in zip(keep, ("256k", "128k", "-1", "1.5")):
            spark.conf.set(c, v)
        done = warc.classify(df.repartition(16))
        done.collect()
        assert done.where("refers_to is not null").count() == 599
        assert "skew=true" in done._jdf.queryExecution().executedPlan().toString()
    finally:
        for c, v in keep.items():
            spark.conf.unset(c) if v is None else spark.conf.set(c, v)
