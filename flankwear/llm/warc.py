"""WARC archives of pages, and the normaliser of monolithic gzip archives.

``write_archives`` writes pages as WARC records into archives that are one gzip stream each (as many tools
leave them), ``normalise`` inflates every such stream once, front to back, and writes each record as a gzip
member of its own beside a sidecar index of offsets, and ``read_records`` reads records by offset.

A payload of at least ``MIN_REVISIT`` bytes that several pages share is stored once, with the smallest
page_id; the others become revisit records.  Digests, groups and the join run in Spark; only rows whose
digest may repeat (a fixed-size bitmap tells) are shuffled, so a payload that a third of all pages share is
one row of the groups and a split join.  Tasks hold one record at a time; archives end at
``MAX_ARCHIVE`` bytes, so a normalising task is bounded.  File names carry the task attempt and only
committed tasks' files are listed in the staged manifest, so retries do no harm.

Files go below the shared folder of ``spark.checkpoint.dir``, through pyarrow's file systems (file, hdfs,
s3, gs); nothing is written to a machine's own folders.

Defined results: null html is an empty payload; a null url has no target header; white space and control
characters in a url are percent-encoded; a null page_id is written without an id and refers like any other
page; rows that repeat a page_id are records of their own, alike in type; an empty table writes no file.
"""
from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flankwear.llm.common import bitmap, in_bitmap, stage
from flankwear.session import checkpoint_dir

MIN_REVISIT = 100
MAX_ARCHIVE = 256 << 20      # uncompressed bytes after which an archive is closed
_READ = 1 << 20
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def with_revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, digest, refers_to (the page whose record holds an equal payload, else null)."""
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    same = stage(rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
                 .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"))
    suspect = in_bitmap(bitmap(same.select(F.xxhash64("digest").alias("h")), "h"), F.xxhash64("digest"))
    alone = rows.where(~suspect).withColumn("refers_to", F.lit(None).cast("bigint"))
    shared = rows.where(suspect).join(same, "digest", "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return alone.unionByName(shared.withColumn("refers_to", refers).drop("first"))


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, number: str) -> bytes:
    body = _HTTP.encode() + (payload if refers is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers is None else 'revisit'}",
            f"WARC-Record-ID: <urn:x-record:{number}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        clean = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)
        head.append(f"WARC-Target-URI: {clean}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers is not None:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"X-Refers-To-Page: {refers}"]
    head += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http;msgtype=response",
             f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + body + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, max_bytes: int = MAX_ARCHIVE) -> DataFrame:
    """Write ``with_revisits`` rows as archives of one gzip stream each; manifest of (path, records, bytes)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        task = TaskContext.get()
        done, out, squeeze, path = [], None, None, ""
        size = count = 0

        def close() -> None:
            nonlocal out
            if out is not None:
                out.write(squeeze.flush())
                out.close()
                done.append((path, count, size))
                out = None

        for batch in batches:
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to")]
            for i in range(batch.num_rows):
                if out is None:
                    name = f"{task.partitionId():05d}-{task.taskAttemptId()}-{len(done)}"
                    path, size, count = f"{base}/{name}.warc.gz", 0, 0
                    out, squeeze = store.open_output_stream(path, compression=None), zlib.compressobj(1, zlib.DEFLATED, 31)
                data = _record(*(c[i].as_py() for c in cols), number=f"{name}-{count}")
                out.write(squeeze.compress(data))
                size, count = size + len(data), count + 1
                if size >= max_bytes:
                    close()
        close()
        yield pa.record_batch([pa.array([x[k] for x in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))],
                              ["path", "records", "bytes"])

    store, base = _open(folder)
    store.create_dir(base)
    return stage(records.mapInArrow(run, "path string, records bigint, bytes bigint"))


def header_fields(head: bytes) -> dict[str, str]:
    """Named fields of a record's head, names in lower case; a line that begins with white space goes on with the one
    before it; of fields of one name the last one counts."""
    out: dict[str, str] = {}
    name = None
    for line in head.decode("utf-8", "surrogatepass").replace("\r\n", "\n").split("\n")[1:]:
        if line[:1] in (" ", "\t") and name is not None:
            out[name] = f"{out[name]} {line.strip()}".strip()
        elif ":" in line:
            name, value = line.split(":", 1)
            name = name.strip().lower()
            out[name] = value.strip()
    return out


def records_of(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(headers, block, raw record) of a gzip stream of WARC records, whatever its members; one record in memory."""
    inflate, buf = zlib.decompressobj(31), bytearray()

    def more() -> bool:
        nonlocal inflate
        for chunk in chunks:
            while chunk:
                buf.extend(inflate.decompress(chunk))
                chunk = b""
                if inflate.eof:
                    chunk, inflate = inflate.unused_data, zlib.decompressobj(31)
            return True
        return False

    while True:
        while (cut := buf.find(b"\r\n\r\n")) < 0:
            if not more():
                if buf.strip():
                    raise ValueError("the archive ends within a record")
                return
        fields = header_fields(bytes(buf[:cut]))
        end = cut + 4 + int(fields["content-length"])
        while len(buf) < end + 4:
            if not more():
                raise ValueError("the archive ends within a record")
        yield fields, bytes(buf[cut + 4:end]), bytes(buf[:end + 4])
        del buf[:end + 4]


def _chunks(store: fs.FileSystem, path: str) -> Iterator[bytes]:
    with store.open_input_stream(path, compression=None) as f:
        while chunk := f.read(_READ):
            yield chunk


def normalise(manifest: DataFrame, folder: str) -> DataFrame:
    """Rewrite each archive of ``manifest`` (path) with one gzip member per record and a sidecar index
    (``.idx``: offset, length, type, record id per line); index table of path, offset, length, type, record_id."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = _open(folder)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path in batch.column("path").to_pylist():
                target = f"{base}/{path.rsplit('/', 1)[1].removesuffix('.warc.gz')}-n{attempt}.warc.gz"
                rows, at = [], 0
                with store.open_output_stream(target, compression=None) as out:
                    for fields, _, raw in records_of(_chunks(store, path)):
                        z = zlib.compressobj(6, zlib.DEFLATED, 31)
                        member = z.compress(raw) + z.flush()
                        out.write(member)
                        rows.append((target, at, len(member), fields["warc-type"], fields["warc-record-id"]))
                        at += len(member)
                with store.open_output_stream(target.removesuffix(".warc.gz") + ".idx", compression=None) as out:
                    out.write("".join(f"{o}\t{n}\t{t}\t{r}\n" for _, o, n, t, r in rows).encode())
                types = (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.record_batch([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)],
                                      ["path", "offset", "length", "type", "record_id"])

    n = max(1, manifest.count())
    return stage(manifest.repartition(n).mapInArrow(run, "path string, offset bigint, length bigint, type string, record_id string"))


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """Read the records of an index by offset: page_id, url, record_type, payload_bytes and payload_digest (of the
    stored payload; a revisit has the digest of its header and no bytes), refers_to."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, _ = _open(folder)
        name, source = None, None
        for batch in batches:
            rows = []
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                if path != name:
                    if source is not None:
                        source.close()
                    name, source = path, store.open_input_file(path)
                source.seek(offset)
                (h, block, _), = records_of(iter([source.read(length)]))
                payload = block.partition(b"\r\n\r\n")[2]
                kept = h["warc-type"] == "response"
                rows.append((int(h["x-page-id"]) if "x-page-id" in h else None, h.get("warc-target-uri"), h["warc-type"],
                             len(payload) if kept else None,
                             hashlib.sha256(payload).hexdigest() if kept else h["warc-payload-digest"].removeprefix("sha256:"),
                             int(h["x-refers-to-page"]) if "x-refers-to-page" in h else None))
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64())
            names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"]
            yield pa.record_batch([pa.array([x[k] for x in rows], t) for k, t in enumerate(types)], names)
        if source is not None:
            source.close()

    return index.mapInArrow(run, "page_id bigint, url string, record_type string, payload_bytes bigint, "
                                 "payload_digest string, refers_to bigint")


def archive_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = MIN_REVISIT) -> tuple[DataFrame, DataFrame]:
    """Write, normalise and read back ``pages`` (page_id, url, html): (records with full payload sizes, index)."""
    folder = f"{checkpoint_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = normalise(write_archives(with_revisits(pages, min_bytes), folder), folder)
    back = stage(read_records(index, folder))
    held = back.where("record_type = 'response'")
    sizes = held.select(F.col("page_id").alias("refers_to"), "payload_digest", F.col("payload_bytes").alias("size")) \
        .where("refers_to is not null").distinct()
    revisits = back.where("record_type = 'revisit'").join(sizes, ["refers_to", "payload_digest"], "left")
    revisits = revisits.withColumn("payload_bytes", F.col("size")).drop("size")
    return held.unionByName(revisits), index
