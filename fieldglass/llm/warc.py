"""WARC writing, reading and transaction assembly.

Each page is a capture of three records: a request, a response (or a revisit of an equal payload) and a metadata
record. Request and metadata name the response by WARC-Concurrent-To; assembly brings the three together by that
identifier and emits one nested row per capture. Records are gzip members of their own, in archives of about
``archive_bytes`` in the shared folder, which begin with a warcinfo record.

Of equal payloads of at least ``least`` bytes the one with the largest page_id is the response; the others are
revisits, which carry the payload's digest, in their HTTP header its length, and the response's identifier, target and
date (WARC-Refers-To, -Target-URI, -Date). Readers find a revisit's page by that identifier.

Scale: a partial aggregate by digest finds the payloads that repeat, and a join on the digest tells their pages; no
group of copies is ever gathered. Identifiers follow from page_id, url and digest, so a repeated attempt writes the
same ones. Assembly is one aggregate by capture, and revisits find their responses by one join on the identifier.

Defined cases: null html is an empty payload. A null page_id is never the response of a group unless all are null,
in which case all are responses. Rows that repeat page_id, url and html share identifiers and come back as often as
they were written; of a page_id with several urls the revisits name the greatest. A null url has no target header. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
import uuid
import zlib
from urllib.parse import quote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.common import Scratch, arrow, shuffle_width, table
from fieldglass.llm.files import read_file, write_file

SPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _record(kind: str, rid: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", f"<{rid}>"), ("WARC-Date", DATE), *headers, ("Content-Length", str(len(block)))]
    raw = b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _line(url: str | None) -> str:
    """What a request for the url asks for, as printable ASCII."""
    try:
        parts = urlsplit(url or "/")
        return quote((parts.path or "/") + (f"?{parts.query}" if parts.query else ""), safe="%/?:@!$&'()*+,;=-._~")
    except ValueError:
        return "/"


def _name(kind: str, *of) -> str:
    return uuid.uuid5(SPACE, json.dumps([kind, *of])).urn


def _uri(header: str, url: str | None) -> list[tuple[str, str]]:
    return [(header, url.replace("\r", "%0D").replace("\n", "%0A"))] if url is not None else []


def capture_records(page_id, url, payload: bytes, digest: str, keeper, keeper_url=None) -> list[bytes]:
    """The gzip members of a page's request, response or revisit, and metadata records. ``keeper`` is the page whose
    response has this payload, None if no other page has it."""
    main, target = _name("main", page_id, url, digest), _uri("WARC-Target-URI", url)
    about = [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    with_ = [("WARC-Concurrent-To", f"<{main}>")]
    ask = f"GET {_line(url)} HTTP/1.1\r\nAccept: text/html\r\n\r\n".encode()
    out = [_record("request", _name("request", page_id, url, digest), target + with_ + [("Content-Type", "application/http; msgtype=request")], ask)]
    if keeper is not None and keeper != page_id:
        of = [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{_name('main', keeper, keeper_url, digest)}>"), *_uri("WARC-Refers-To-Target-URI", keeper_url), ("WARC-Refers-To-Date", DATE)]
        out.append(_record("revisit", main, target + of + about, http))
    else:
        out.append(_record("response", main, target + about, http + payload))
    fields = json.dumps({"page_id": page_id}).encode()
    out.append(_record("metadata", _name("metadata", page_id, url, digest), target + with_ + [("Content-Type", "application/json")], fields))
    return out


def archive_head(name: str) -> bytes:
    """The warcinfo record of an archive."""
    return _record("warcinfo", _name("warcinfo", name), [("Content-Type", "application/warc-fields")], b"software: fieldglass\r\nformat: WARC File Format 1.1\r\n")


def members(raw: bytes):
    """(headers, block) of each record of an archive of gzip members."""
    view, at = memoryview(raw), 0
    while at < len(view):
        z, parts, step = zlib.decompressobj(31), [], 1 << 13
        pos = at
        while not z.eof:
            if pos >= len(view):
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(view[pos : pos + step]))
            pos += step
        at = min(pos, len(view)) - len(z.unused_data)
        data = b"".join(parts)
        head, _, rest = data.partition(b"\r\n\r\n")
        headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        yield headers, rest[: int(headers["Content-Length"])]


def _write(folder: str, archive_bytes: int):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, paths, held, parts = TaskContext.get().partitionId(), [], 0, []

        def close():
            nonlocal held, parts
            name = f"warc-{part:06d}-{len(paths):04d}"
            paths.append(write_file(folder, name, [archive_head(name), *parts]))
            held, parts = 0, []

        for b in batches:
            for page, url, html, keeper, keeper_url in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                payload = (html or "").encode()
                new = capture_records(page, url, payload, hashlib.sha1(payload).hexdigest(), keeper, keeper_url)
                parts += new
                held += sum(map(len, new))
                if held >= archive_bytes:
                    close()
        if parts:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 1000, archive_bytes: int = 32 << 20) -> DataFrame:
    """Write all pages; the manifest (path), to be kept by the caller."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    key = F.when(F.octet_length("html") >= least, F.sha1(F.col("html").cast("binary")))
    again = p.select("page_id", "url", key.alias("digest")).where("digest is not null").groupBy("digest").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("page_id", "url")).alias("keeper")).where("n > 1")
    rows = p.withColumn("digest", key).join(again, "digest", "left")
    rows = rows.select("page_id", "url", "html", F.col("keeper.page_id").alias("keeper"), F.col("keeper.url").alias("keeper_url"))
    return rows.transform(arrow, _write(folder, archive_bytes), "path string")


def _read(folder: str, with_payload: bool):
    def run(batches):
        import pyarrow as pa

        kinds = [("type", pa.string()), ("record_id", pa.string()), ("concurrent_to", pa.string()), ("refers_to", pa.string()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("fields", pa.string()), ("payload", pa.binary())]
        for b in batches:
            for path in b.column(0).to_pylist():
                rows = []

                def batch(rows):
                    cols = zip(*rows, strict=True) if rows else [()] * len(kinds)
                    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, kinds, strict=True)], [k for k, _ in kinds])

                held = 0
                for h, block in members(read_file(folder, path)):
                    kind, size, digest, fields, payload = h["WARC-Type"], None, None, None, None
                    if kind in ("response", "revisit"):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        if kind == "response":
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            size = int(dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])["Content-Length"])
                            digest, payload = h["WARC-Payload-Digest"].removeprefix("sha1:"), None
                    elif kind == "metadata":
                        fields = block.decode()
                    ids = [h.get(x, "<>")[1:-1] or None for x in ("WARC-Record-ID", "WARC-Concurrent-To", "WARC-Refers-To")]
                    rows.append((kind, *ids, h.get("WARC-Target-URI"), size, digest, fields, payload if with_payload else None))
                    held += len(block)
                    if held > 8 << 20:
                        yield batch(rows)
                        rows, held = [], 0
                yield batch(rows)

    return run


def read_archives(manifest: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """All records: type, record_id, concurrent_to, refers_to, url, payload_bytes, payload_digest, fields (JSON), payload."""
    schema = "type string, record_id string, concurrent_to string, refers_to string, url string, payload_bytes long, payload_digest string, fields string, payload binary"
    return manifest.repartition(shuffle_width(manifest.sparkSession)).transform(arrow, _read(folder, with_payload), schema)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, url, response, request and metadata structs; a missing part is null."""
    r = records.where("type <> 'warcinfo'").withColumn("capture_id", F.coalesce("concurrent_to", "record_id"))
    main = F.col("type").isin("response", "revisit")
    struct = F.struct("record_id", "type", "refers_to", "payload_bytes", "payload_digest", "payload")
    groups = r.groupBy("capture_id").agg(
        F.sum(F.when(main, 1).otherwise(0)).alias("n"),
        F.first("url", ignorenulls=True).alias("url"),
        F.first(F.when(main, struct), ignorenulls=True).alias("response"),
        F.first(F.when(F.col("type") == "request", F.struct("record_id")), ignorenulls=True).alias("request"),
        F.first(F.when(F.col("type") == "metadata", F.struct("record_id", "fields")), ignorenulls=True).alias("metadata"),
    )
    return groups.withColumn("copy", F.explode(F.sequence(F.lit(1), F.greatest("n", F.lit(1)).cast("int")))).drop("n")


def with_referred(captures: DataFrame, scratch: Scratch) -> DataFrame:
    """Captures with ``refers_to``: the metadata fields of the capture that a revisit's record names; else null.

    Only revisits are joined, with a table of the responses, so Spark can split a response that very many refer to."""
    known = captures.where("response.type = 'response'").select(F.col("response.record_id").alias("known"), F.col("metadata.fields").alias("refers_to"))
    known = scratch.put(known.dropDuplicates(["known"]), "responses")
    to = F.col("response.refers_to")
    revisits = captures.where(to.isNotNull()).join(known, to == F.col("known"), "left").drop("known")
    return revisits.unionByName(captures.where(to.isNull()).withColumn("refers_to", F.lit(None).cast("string")))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "warc")
    manifest = scratch.put(write_archives(table(spark, sf_dir, "pages"), scratch.path("files")), "manifest")
    captures = scratch.put(assemble(read_archives(manifest, scratch.path("files"), with_payload=False)), "captures")
    page = lambda c: F.get_json_object(c, "$.page_id").cast("long")
    return with_referred(captures, scratch).select(
        page("metadata.fields").alias("page_id"), "response.payload_bytes", "response.payload_digest",
        F.col("response.type").alias("record_type"), page("refers_to").alias("refers_to"),
    )
