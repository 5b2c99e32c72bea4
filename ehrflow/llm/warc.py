"""A deterministic, sharded WARC writer, and a reader of its archives.

Records are range-sorted by page_id into shards; a shard rolls to a new file
once it has ``roll_bytes`` of compressed records. Each record is a gzip member
of its own, with headers made anew from the payload: lengths, digests, and a
record id derived from page_id and digest. Nothing depends on the time, the
attempt or the machine, so reruns give the same bytes.

A task writes its files under temporary names and returns a line of the
manifest for each. Only then are the files that the manifest names renamed to
their final names (a task that ran twice left other temporary names, which
nobody names), and at last the manifest is written beside them; an archive
without one is not complete.

Of records with equal payloads of at least ``min_bytes`` bytes, that with the
largest page_id is a response, the others are revisits that refer to it.

Files are opened with pyarrow's file systems by the URI of the folder, which
must be one that all executors share.

Defined results: a null html is an empty payload; a null page_id is sorted
first, and is the response only if all of its equals are null (then each is);
rows that share the largest page_id and the payload are each a response; a
null url has no target URI. An empty table gives an empty manifest. Other
columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ehrflow.llm._shared import written

MIN_BYTES = 1000
ROLL_BYTES = 16 << 20
SHARD_BYTES = 64 << 20              # of payload, about
DATE = "2024-01-01T00:00:00Z"       # of every record, so that reruns agree
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")   # RFC 4122, for URLs

MANIFEST_SCHEMA = "shard int, roll int, temporary string, final string, records long, bytes long, sha256 string"
RECORD_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary"


def record_types(pages: DataFrame, min_bytes: int = MIN_BYTES) -> DataFrame:
    """page_id, url, payload, digest, record_type and refers_to. Payloads stay
    out of the grouping, which sees digests only; copies meet in the tasks
    before they are shuffled."""
    payload = F.coalesce(F.col("html").cast("binary"), F.lit(b""))
    rows = pages.select("page_id", "url", payload.alias("payload")).withColumn("digest", F.sha1("payload"))
    best = written(rows.filter(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("page_id").alias("best"), F.count("*").alias("n")).filter("n > 1")
                   .select(F.col("digest").alias("__digest"), "best"), "digests")
    revisit = F.col("best").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return (rows.join(best, F.col("digest") == F.col("__digest"), "left")
            .select("page_id", "url", "payload", "digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("best")).alias("refers_to")))


def _record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'{page_id}/{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, kind: str, refers_to: int | None) -> bytes:
    """One WARC record, not compressed."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head + (payload if kind == "response" else b"")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + quote(url, safe="!#$%&'()*+,/:;=?@[]~"))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{hashlib.sha1(block).hexdigest()}",
              f"X-Payload-Length: {len(payload)}", f"X-Page-ID: {'' if page_id is None else page_id}"]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _writer(folder: str, roll_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        shard, attempt = TaskContext.get().partitionId(), uuid.uuid4().hex
        out, roll, temporary, lines = None, 0, "", []
        records = size = 0
        digest = hashlib.sha256()

        def close() -> None:
            nonlocal out, roll
            out.close()
            lines.append((shard, roll, temporary, f"shard-{shard:06d}-{roll:05d}.warc.gz", records, size, digest.hexdigest()))
            out, roll = None, roll + 1

        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "record_type", "refers_to"))):
                if out is None:
                    temporary, records, size, digest = f"_temporary-{shard:06d}-{roll:05d}-{attempt}", 0, 0, hashlib.sha256()
                    out = fs.open_output_stream(f"{base}/{temporary}")
                member = _gzip(record(*row))
                out.write(member)
                digest.update(member)
                records, size = records + 1, size + len(member)
                if size >= roll_bytes:
                    close()
        if out is not None:
            close()
        yield _rows(lines, [pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()], ["shard", "roll", "temporary", "final", "records", "bytes", "sha256"])

    return write


def _gzip(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)            # a gzip member without a time
    return packer.compress(data) + packer.flush()


def _rows(rows: list[tuple], kinds: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _committer(folder: str):
    def commit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for temporary, final in zip(batch.column("temporary").to_pylist(), batch.column("final").to_pylist()):
                if fs.get_file_info(f"{base}/{temporary}").type == pafs.FileType.File:      # else an earlier attempt has moved it
                    fs.move(f"{base}/{temporary}", f"{base}/{final}")
                if fs.get_file_info(f"{base}/{final}").type != pafs.FileType.File:
                    raise FileNotFoundError(f"{base}/{final}")
            yield batch

    return commit


def uri(folder: str) -> str:
    """``folder`` as pyarrow takes it: file:///x for Hadoop's file:/x."""
    if folder.startswith("file:/") and not folder.startswith("file://"):
        return "file://" + folder[len("file:"):]
    return folder


def write(pages: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, shard_bytes: int = SHARD_BYTES, min_bytes: int = MIN_BYTES) -> DataFrame:
    """Write the archive of ``pages`` (page_id, url, html) into the new folder;
    returns the manifest, which is also in its ``_manifest``."""
    spark, at = pages.sparkSession, uri(folder)
    total = pages.agg(F.coalesce(F.sum(F.octet_length("html")), F.lit(0))).first()[0]
    shards = max(1, -(-int(total) // shard_bytes))
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    order = [F.col("page_id"), F.col("digest"), F.col("url")]
    ranged = record_types(pages, min_bytes).repartitionByRange(shards, *order).sortWithinPartitions(*order)
    lines = written(ranged.mapInArrow(_writer(at, roll_bytes), MANIFEST_SCHEMA), "manifest")
    lines.mapInArrow(_committer(at), MANIFEST_SCHEMA).drop("temporary").write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def _members(stream, step: int = 1 << 20) -> Iterator[bytes]:
    unpack, parts, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(step)):
        parts.append(unpack.decompress(data))
        data = unpack.unused_data if unpack.eof else b""
        if unpack.eof:
            yield b"".join(parts)
            unpack, parts = zlib.decompressobj(31), []
    if parts and any(parts):
        raise ValueError("the last record is cut off")


def parse(data: bytes) -> tuple:
    """A row of ``RECORD_SCHEMA`` from one record; lengths and digests that do
    not agree with its bytes are errors."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines if ": " in line) | {line[:-1]: "" for line in lines if line.endswith(":")}
    length = int(fields["Content-Length"])
    block, digest = rest[:length], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if not version.startswith("WARC/") or rest[length:] != b"\r\n\r\n" or hashlib.sha1(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha1:"):
        raise ValueError(f"damaged record {fields.get('WARC-Record-ID')}")
    kind, n = fields["WARC-Type"], int(fields["X-Payload-Length"])
    payload = block.partition(b"\r\n\r\n")[2]
    if kind == "response" and (len(payload) != n or hashlib.sha1(payload).hexdigest() != digest):
        raise ValueError(f"damaged payload {fields['WARC-Record-ID']}")
    number = lambda name: int(fields[name]) if fields.get(name, "").strip() not in ("", "None") else None
    return number("X-Page-ID"), n, digest, kind, number("X-Refers-To-Page-ID"), fields.get("WARC-Target-URI"), payload if kind == "response" else None


def _reader(folder: str, keep_payload: bool):
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "payload"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for final in batch.column("final").to_pylist():
                rows, size = [], 0
                with fs.open_input_stream(f"{base}/{final}", compression=None) as stream:
                    for data in _members(stream):
                        row = parse(data)
                        rows.append(row if keep_payload else (*row[:6], None))
                        size += len(data)
                        if size >= 4 << 20:
                            yield _rows(rows, kinds, names)
                            rows, size = [], 0
                yield _rows(rows, kinds, names)

    return read


def read(spark: SparkSession, folder: str, keep_payload: bool = True) -> DataFrame:
    """All records of a complete archive; the files are dealt to as many tasks
    as the session shuffles to."""
    files = spark.read.parquet(f"{folder}/_manifest").select("final")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = files.repartition(n, "final").mapInArrow(_reader(uri(folder), keep_payload), RECORD_SCHEMA)
    return rows if keep_payload else rows.drop("payload")
