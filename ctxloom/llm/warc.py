"""WARC archives through a chunked record table.

Writing: a page becomes rows (record, chunk number, bytes). The row that is cut holds the payload and all
its chunks, about twice a page's size, at once; the archive's writer then takes one chunk at a time:
each task streams its rows into one gzip-per-record archive in the shared folder and returns a manifest
row. Reading: each archive is streamed and yields (record, chunk number, bytes so far, chunk) rows with an
incremental SHA-1 that is complete on a record's last row. Archives that no manifest row names (of lost
or repeated tasks) are never read.
"""
from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_path, path_prefix, spill

CHUNK = 1 << 18
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _once(df: DataFrame, rows: int = 100_000) -> bool:
    """Whether df has no more than rows, so that it may be broadcast."""
    return df.limit(rows + 1).count() <= rows


def label_revisits(pages: DataFrame, least: int = 1000, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", most: int = 100_000, salts: int = 16) -> DataFrame:
    """(page_id, url, payload, digest, bytes, refers_to, again): refers_to is the largest page_id of the records with
    the same payload of at least least bytes, null on that record itself and on all others. Rows that repeat
    that largest id are each a response; a null id is smaller than any. again says that several rows have the id.

    Payloads stay where they are: the table of payloads that repeat, which has none of them, is broadcast if it
    has no more than most rows. A larger one is joined by digest and one of some salts, so that no payload of
    many records, and none below least, makes a large group.
    """
    slim = pages.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    slim = slim.select("page_id", F.octet_length("payload").cast("long").alias("bytes"), F.when(F.octet_length("payload") >= least, F.sha1("payload")).alias("digest"))
    keep = spill(slim.filter("digest is not null").groupBy("digest").agg(F.max("page_id").alias("keep"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("digest", "keep"), "warc-repeated")
    ids = spill(slim.groupBy("page_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.coalesce("page_id", F.lit(0)).alias("same_id"), F.col("page_id").isNull().alias("same_null"), F.lit(True).alias("again")), "warc-ids")
    base = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col).cast("binary"), F.lit(b"")).alias("payload"))
    base = base.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload").cast("long"))
    base = base.join(F.broadcast(ids) if _once(ids, most) else ids, (F.coalesce("page_id", F.lit(0)) == F.col("same_id")) & (F.col("page_id").isNull() == F.col("same_null")), "left")
    if _once(keep, most):
        out = base.join(F.broadcast(keep), "digest", "left")
    else:
        keep = keep.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        long = base.filter(F.col("bytes") >= least).withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int"))
        out = long.join(keep, ["digest", "salt"], "left").drop("salt").unionByName(base.filter(F.col("bytes") < least).withColumn("keep", F.lit(None).cast("long")))
    out = out.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("keep")), F.col("keep")))
    return out.select("page_id", "url", "payload", "digest", "bytes", "refers_to", F.coalesce("again", F.lit(False)).alias("again"))


def chunk_rows(records: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Rows of one record follow each other; revisits have one empty chunk."""
    sent = F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise(F.lit(b""))
    last = F.greatest(F.ceil(F.octet_length("sent") / chunk) - 1, F.lit(0)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(F.col("sent"), i * chunk + 1, F.lit(chunk)))
    return records.withColumn("sent", sent).select("page_id", "url", "digest", "bytes", "refers_to", "again", F.octet_length("sent").alias("sent_bytes"), F.posexplode(pieces).alias("no", "data"))


def _head(page_id, url, digest, size, refers_to, sent, mark: str) -> bytes:
    """mark tells apart the records of rows that repeat an id; a revisit names its page."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n"
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}{mark}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(http) + sent}"]
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_archives(records: DataFrame, folder: str, chunk: int = CHUNK) -> DataFrame:
    """The manifest (path, records) of the archives written. Paths that pyarrow's file systems can open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        serial = uuid.uuid4().hex
        name, out, gz, n = f"{root}/{serial}.warc.gz", None, None, 0
        for b in batches:
            cols = [b.column(i) for i in range(9)]
            for r in range(b.num_rows):
                page_id, url, digest, size, refers_to, again, sent, no, data = (c[r].as_py() for c in cols)
                out = out or store.open_output_stream(name, compression=None)
                if no == 0:
                    gz = zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(gz.compress(_head(page_id, url, digest, size, refers_to, sent, f":{serial}-{n}" if again else "")))
                    left, n = sent, n + 1
                out.write(gz.compress(data))
                left -= len(data)
                if not left:
                    out.write(gz.compress(b"\r\n\r\n") + gz.flush())
        if out:
            out.close()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["path", "records"])

    return chunk_rows(records, chunk).mapInArrow(run, "path string, records long")


class _Stream:
    """Bytes of a file of gzip members (or a plain one), read in pieces."""

    def __init__(self, f, piece: int = 1 << 16):
        self.f, self.piece, self.z, self.buf, self.raw = f, piece, None, bytearray(), b""

    def fill(self) -> bool:
        while True:
            if not self.raw:
                self.raw = self.f.read(self.piece)
                if not self.raw:
                    return False
            if self.z is None:
                self.z = zlib.decompressobj(47)
            got = self.z.decompress(self.raw, self.piece * 4)
            self.raw = self.z.unconsumed_tail
            if self.z.eof:  # what follows the member may also still stand in unconsumed_tail
                self.raw, self.z = self.z.unused_data, None
            if got:
                self.buf += got
                return True

    def line(self) -> bytes | None:
        while (at := self.buf.find(b"\r\n")) < 0:
            if not self.fill():
                return None
        out = bytes(self.buf[:at])
        del self.buf[: at + 2]
        return out

    def take(self, n: int) -> bytes:
        while not self.buf and self.fill():
            pass
        out = bytes(self.buf[:n])
        del self.buf[: len(out)]
        if n and not out:
            raise EOFError("archive ends within a record")
        return out


def _fields(stream: _Stream) -> tuple[dict[str, str], int]:
    """Header fields up to the empty line, and how many bytes they took."""
    out, used = {}, 2
    while line := stream.line():
        k, _, v = line.decode().partition(":")
        out[k.strip().lower()] = v.strip()
        used += len(line) + 2
    if line is None:
        raise EOFError("archive ends within a record")
    return out, used


def parse(f, chunk: int = CHUNK) -> Iterator[dict]:
    """Chunk rows of one archive, in order."""
    s = _Stream(f)
    while (line := s.line()) is not None:
        if not line.startswith(b"WARC/"):
            if line:
                raise ValueError("not a WARC record")
            continue
        warc, _ = _fields(s)
        total = int(warc["content-length"])
        status = s.line()
        if status is None:
            raise EOFError("archive ends within a record")
        http, used = _fields(s)
        used += len(status) + 2
        digest = base64.b32decode(warc["warc-payload-digest"].removeprefix("sha1:")).hex()
        row = {"record_id": warc["warc-record-id"], "record_type": warc["warc-type"], "refers_to": warc.get("warc-refers-to"), "url": warc.get("warc-target-uri"), "payload_bytes": int(http["content-length"])}
        left, no, so_far, sha = total - used, 0, 0, hashlib.sha1()
        while True:
            data = bytearray()
            while left and len(data) < chunk:
                got = s.take(min(left, chunk - len(data)))
                data += got
                left -= len(got)
            sha.update(data)
            so_far += len(data)
            if not left and row["record_type"] == "response" and (sha.hexdigest() != digest or so_far != row["payload_bytes"]):
                raise ValueError(f"{row['record_id']}: payload does not match its digest")
            yield row | {"chunk_no": no, "bytes_so_far": so_far, "payload_digest": None if left else digest, "data": bytes(data)}
            no += 1
            if not left:
                break


SCHEMA = "record_id string, record_type string, refers_to string, url string, payload_bytes long, chunk_no long, bytes_so_far long, payload_digest string"


def read_archives(manifest: DataFrame, chunk: int = CHUNK, data: bool = True, batch_bytes: int = 8 << 20) -> DataFrame:
    """The chunked record table of the archives that manifest (path) names; payload_digest is set on a record's last chunk."""
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["data"] * data

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64() if n in ("payload_bytes", "chunk_no", "bytes_so_far") else pa.binary() if n == "data" else pa.string() for n in names]
        for b in batches:
            for path in b.column(0):
                rows, held = [], 0
                with fs.LocalFileSystem().open_input_stream(path.as_py(), compression=None) if ":" not in path.as_py() else _open(path.as_py()) as f:
                    for row in parse(f, chunk):
                        rows.append([row[n] for n in names])
                        held += (len(row["data"]) if data else 0) + 200
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    return manifest.select("path").mapInArrow(run, SCHEMA + ", data binary" * data)


def _open(uri: str):
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path, compression=None)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Writes a record for each row of pages and reads the archives back: page_id, payload_bytes,
    payload_digest, record_type, refers_to, chunks.

    Null html is an empty payload; a null url has no target header; a null page_id comes back null; rows
    that repeat are records of their own, with record ids of their own. A very long page is written and read
    in chunks. An empty table gives an empty result. Other columns are not read.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    manifest = spill(write_archives(label_revisits(pages, least), folder).withColumn("path", F.concat(F.lit(path_prefix(folder)), "path")), "warc-manifest")
    table = read_archives(manifest.repartition(max(1, spark.sparkContext.defaultParallelism * 2)), data=False)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]*)[:>]', 1) as bigint)")
    return table.filter(F.col("payload_digest").isNotNull()).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"), (F.col("chunk_no") + 1).alias("chunks"))

