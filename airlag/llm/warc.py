"""WARC archives: written by tasks, read back by byte ranges.

Writing: payloads are grouped by digest on a slim table; of equal payloads one
is stored and the others become revisit records.  Rows learn that by a join whose
hot digests (an error page, the empty payload) are salted, so that copies of one
payload are written by many tasks.  Every task writes its rows
into archive files of its own, one gzip member per record, and returns a
manifest row per file.  Names are unique to the attempt and only files named
by the manifest, which Spark commits, are archives; what a lost task left is
never read.

Reading: archives are cut into byte ranges.  A task scans its range for the
gzip magic, checks each candidate by decoding the start of the member up to a
WARC header, and owns exactly the records that start inside its range, reading
on past the end for the last one.  So a file of any size is read in parallel
without an index.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from airlag.llm.common import keep_folder, read_table, salted_join, scratch, ship_package
from airlag.session import ensure_checkpoint_dir

MAGIC = b"\x1f\x8b\x08"
FILE_BYTES = 1 << 30
SPLIT_BYTES = 8 << 20
MIN_REVISIT_BYTES = 0
CHUNK = 1 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "path string, bytes long, records long"
RECORDS = ("record_id string, url string, record_type string, refers_to string, payload_digest string, "
           "payload_bytes long, payload binary, path string, offset long")


def open_folder(folder: str):
    """File system and path of a URI or path, as tasks use it."""
    if folder.startswith("file:"):
        folder = "/" + folder[len("file:"):].lstrip("/")
    return pafs.FileSystem.from_uri(folder)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def urn(key) -> str:
    return f"<urn:page:{'' if key is None else key}>"


def encode_record(key, url, payload: bytes, refers_to, revisit: bool, date: str) -> bytes:
    """One gzip member.  A revisit keeps the HTTP header with the payload's
    length, the digest and the record it refers to, and drops the payload."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {urn(key)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
            "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {urn(refers_to)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + z.flush()


def decode_record(raw: bytes) -> dict:
    """Fields of a decoded member; a response whose payload does not have the
    digest in its header is an error."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[:int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    if not revisit and digest != base32_sha1(payload):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    length = int(next(x for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
    key = lambda name: fields[name][len("<urn:page:"):-1] or None if name in fields else None
    return {"record_id": key("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"),
            "record_type": "revisit" if revisit else "response", "refers_to": key("WARC-Refers-To"),
            "payload_digest": digest, "payload_bytes": length, "payload": None if revisit else payload}


def members(f, lo: int, hi: int, strict: bool = False) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded bytes) of the records that start in [lo, hi) of an open file.

    A magic without a WARC header behind it is no record; a record that cannot
    be decoded to its end is an error.  ``strict``: the file holds records and
    nothing else, so one must start at 0 and wherever one ends, up to the end of
    the file; the reader of a record looks at the start of the next, also
    beyond ``hi``."""
    f.seek(lo)
    base, buf, at, ended = lo, b"", lo, False
    due = strict and lo == 0

    def more() -> bool:
        nonlocal buf, ended
        got = f.read(CHUNK)
        buf, ended = buf + got, not got
        return bool(got)

    while at < hi or due:
        while at + len(MAGIC) > base + len(buf) and not ended:
            more()
        p = buf.find(MAGIC, at - base)
        if due and p != at - base:
            if ended and at == base + len(buf):
                return
            raise ValueError(f"no record at {at}")
        if p < 0:
            at = max(at, base + len(buf) - len(MAGIC) + 1)
            if ended or at >= hi:
                return
            buf, base = buf[at - base:], at
            more()
            continue
        start = base + p
        if start >= hi and not due:
            return
        buf, base = buf[p:], start
        while len(buf) < 512 and not ended:
            more()
        try:
            if zlib.decompressobj(31).decompress(buf[:4096], 7) != b"WARC/1.":
                raise zlib.error("no record")
        except zlib.error as e:
            if due:
                raise ValueError(f"no record at {start}") from e
            at = start + 1
            continue
        if start >= hi:
            return
        try:
            z = zlib.decompressobj(31)
            parts, fed = [z.decompress(buf)], len(buf)
            while not z.eof:
                if not more():
                    raise zlib.error("cut off")
                parts.append(z.decompress(buf[fed:]))
                fed = len(buf)
        except zlib.error as e:
            raise ValueError(f"damaged record at {start}") from e
        yield start, b"".join(parts)
        due = strict
        at = base + fed - len(z.unused_data)
        buf, base = buf[at - base:], at


def write_warc(pages: DataFrame, folder: str, date: str, id_col: str = "page_id", url_col: str = "url",
               payload_col: str = "html", min_bytes: int = MIN_REVISIT_BYTES,
               file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write a record per row below ``folder`` and return the manifest
    (``path, bytes, records``), stored as a table.

    Of the rows with equal payloads of at least ``min_bytes`` bytes, those with
    the largest id are responses (a repeated row with that id too) and the
    others revisit it; smaller payloads are all responses.  A null payload is
    empty, a null id is an empty URN and the smallest, a null URL is left out.
    An empty table gives no files; other columns are ignored whatever their
    names."""
    spark = pages.sparkSession
    ship_package(spark)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(payload_col), F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    kept = (rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
            .agg(F.max("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    kept = scratch(kept, "warc-repeats")
    plan = salted_join(rows, kept.select("digest", "first", F.lit(True).alias("repeated")), ["digest"],
                       kept.select("digest", "n"), pages.count(), "left").select(
        "id", "url", "payload", "first",
        (F.coalesce("repeated", F.lit(False)) & ~F.col("id").eqNullSafe(F.col("first"))).alias("revisit"))

    def write(batches):
        fs, root = open_folder(folder)
        fs.create_dir(root, recursive=True)
        out, done, size, count = None, [], 0, 0

        def close():
            nonlocal out
            if out is not None:
                out.close()
                done.append((path, size, count))
                out = None

        for batch in batches:
            for r in batch.to_pylist():
                if out is None or size >= file_bytes:
                    close()
                    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    path = f"{folder}/{name}"
                    out, size, count = fs.open_output_stream(f"{root}/{name}", compression=None), 0, 0
                member = encode_record(r["id"], r["url"], r["payload"].encode(), r["first"], r["revisit"], date)
                out.write(member)
                size, count = size + len(member), count + 1
        close()
        paths, sizes, counts = zip(*done) if done else ((), (), ())
        yield pa.RecordBatch.from_pydict({
            "path": pa.array(paths, pa.string()), "bytes": pa.array(sizes, pa.int64()),
            "records": pa.array(counts, pa.int64())})

    return scratch(plan.mapInArrow(write, MANIFEST), "warc-manifest")


def read_warc(files: DataFrame, split_bytes: int = SPLIT_BYTES, with_payload: bool = True) -> DataFrame:
    """Records of the archives in ``files`` (``path, bytes``), one row each,
    with columns ``record_id, url, record_type, refers_to, payload_digest,
    payload_bytes, payload, path, offset``.  Payloads are always decoded and
    checked; without ``with_payload`` they are null in the result.  A file that
    has not the size in ``files`` is an error; with a column ``records``, as in
    the manifest of ``write_warc``, so are bytes between records."""
    ship_package(files.sparkSession)
    strict = "records" in files.columns
    count = files.agg(F.sum(F.ceil(F.col("bytes") / split_bytes))).first()[0] or 1
    splits = (files.where("bytes > 0").select(
        "path", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("lo"))
        .select("path", "bytes", "lo", (F.col("lo") + split_bytes).alias("hi"))
        # a task per range: split rows are tiny, and a size-based plan would put them into one task
        .repartition(int(count), "path", "lo"))
    names = [x.split()[0] for x in RECORDS.split(", ")]
    schema = pa.schema([(n, pa.binary() if n == "payload" else pa.int64() if n in ("payload_bytes", "offset")
                         else pa.string()) for n in names])

    def read(batches):
        rows, held = [], 0
        for batch in batches:
            for s in batch.to_pylist():
                fs, path = open_folder(s["path"])
                with fs.open_input_file(path) as f:
                    if f.size() != s["bytes"]:
                        raise ValueError(f"{s['path']} has {f.size()} bytes, not {s['bytes']}")
                    for at, raw in members(f, s["lo"], s["hi"], strict):
                        r = decode_record(raw) | {"path": s["path"], "offset": at}
                        if not with_payload:
                            r["payload"] = None
                        rows.append(r)
                        held += len(r["payload"] or b"") + 500
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
        yield pa.RecordBatch.from_pylist(rows, schema)

    return splits.mapInArrow(read, RECORDS)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = keep_folder(spark, f"{ensure_checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}")
    files = write_warc(read_table(spark, sf_dir, "pages"), folder, "2026-01-01T00:00:00Z")
    return read_warc(files, with_payload=False).select(
        F.col("record_id").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").cast("long").alias("refers_to"))
