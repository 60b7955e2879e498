"""WARC archives: write them, normalise whole-file gzip streams, read them back by index.

`write_archives` writes each partition as one archive that is a single gzip stream, as many crawlers' tools leave it.
`normalise` inflates every such stream once, from start to end in bounded pieces, and writes each of its records as a gzip member of
its own, with a sidecar index of where each member starts and ends. `read_records` gives the records of the normalised archives, member by member through the index.

Of records with equal payloads of at least `least_bytes` bytes the one with the smallest page_id is a response, the others are revisits
that refer to it; shorter payloads are all responses. Null html is an empty payload. A revisit holds the response's HTTP header, with the length of the full payload, and
no payload. Null ids and urls are written as empty values and read back as null; rows that repeat an id and payload are alike: all responses if theirs is the smallest id.
Extra columns are ignored.

Files go to the folder in spark.checkpoint.dir, through pyarrow's file systems; each is written under another name and moved, so a task that runs again
leaves the same file.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.llm.common import attach, bounded_batches, fresh_path, release, text_of, written

#: Payload bytes of an archive, about; bytes inflated at a time.
ARCHIVE_BYTES, PIECE = 32 << 20, 1 << 20
_SYMBOLS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"  # RFC 4648, base 32
RECORD = "page_id {id}, url string, record_type string, refers_to {id}, payload_bytes long, payload_digest string, payload binary"


def sha1_base32(col):
    """SHA-1 as upper-case base 32: 32 symbols of 5 bits, four of them to every 5 hex digits."""
    digits = F.sha1(col)
    parts = [F.conv(F.substring(digits, i, 5), 16, 10).cast("int") for i in range(1, 41, 5)]
    symbol = lambda n, shift: F.substring(F.lit(_SYMBOLS), F.shiftright(n, shift).bitwiseAND(31) + 1, F.lit(1))
    return F.concat(*(symbol(n, shift) for n in parts for shift in (15, 10, 5, 0)))


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, payload_bytes, payload_digest, refers_to): refers_to is set for revisits."""
    lean = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_of(html_col).alias("html"))
    told = lean.select("page_id", F.octet_length("html").cast("long").alias("payload_bytes"), sha1_base32(F.col("html")).alias("payload_digest"))
    small = written(told, "payloads")
    total = small.count()
    first = small.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    revisits = attach(small, first.filter("_n > 1"), "payload_digest", "_n", "page_id", total).filter("_first IS NOT NULL AND NOT page_id <=> _first")
    revisits = revisits.filter(F.col("payload_bytes") >= least_bytes).select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("_first").alias("refers_to")).distinct()
    marked = lean.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", sha1_base32(F.col("html")))
    return marked.join(revisits, F.col("page_id").eqNullSafe(F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left").drop("_id", "_digest")


def _opened(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder)


def _line(value) -> str:
    return "" if value is None else str(value).replace("\r", "%0D").replace("\n", "%0A")


def record(page_id, url, html: bytes | None, digest: str, length: int, refers_to) -> bytes:
    """One WARC record: a response, or without its payload a revisit."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length
    kind = "response" if refers_to is None else "revisit"
    block = http + (html or b"" if refers_to is None else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{_line(page_id)}>", f"WARC-Target-URI: {_line(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to is not None:
        head += [f"WARC-Refers-To: <urn:page:{_line(refers_to)}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    return ("\r\n".join([*head, f"Content-Length: {len(block)}", "", ""])).encode() + block + b"\r\n\r\n"


def write_archives(records: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Writes each partition as one gzip stream or more of about ARCHIVE_BYTES; gives (archive, records), one row a file."""
    bounded_batches(records.sparkSession, 256)

    def run(batches):
        release()
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        part, n, out, made = TaskContext.get().partitionId(), 0, None, 0

        def closed():
            out.write(packer.flush())
            out.close()
            fs.move(partial, name)
            return pa.RecordBatch.from_pylist([{"archive": name, "records": n}], pa.schema([("archive", pa.string()), ("records", pa.int64())]))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    name, size, n = f"{root}/pages-{part:06d}-{made:04d}.warc.gz", 0, 0
                    partial, made = f"{name}.{TaskContext.get().taskAttemptId()}", made + 1
                    out, packer = fs.open_output_stream(partial, compression=None), zlib.compressobj(level, zlib.DEFLATED, 31)
                raw = record(row["page_id"], row["url"], None if row["refers_to"] is not None else row["html"].encode(), row["payload_digest"], row["payload_bytes"], row["refers_to"])
                out.write(packer.compress(raw))
                size, n = size + len(raw), n + 1
                if size >= ARCHIVE_BYTES:
                    yield closed()
                    out = None
        if out is not None:
            yield closed()

    return records.select("page_id", "url", "html", "payload_digest", "payload_bytes", "refers_to").mapInArrow(run, "archive string, records long")


def inflated(stream, piece: int = PIECE) -> Iterator[bytes]:
    """The bytes of a gzip file, inflated once in pieces of at most `piece` bytes; members that follow each other are read through."""
    machine = zlib.decompressobj(31)
    fed = b""
    while True:
        fed = machine.unconsumed_tail or fed or stream.read(piece)
        if not fed:
            break
        out, fed = machine.decompress(fed, piece), b""
        if out:
            yield out
        if machine.eof:
            fed, machine = machine.unused_data, zlib.decompressobj(31)
    if rest := machine.flush():
        yield rest


def split_records(pieces: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records of an inflated stream, by the lengths in their headers; holds one record and one piece at most."""
    held = bytearray()
    for piece in pieces:
        held += piece
        while (end := held.find(b"\r\n\r\n")) >= 0:
            length = next(int(x.split(b":")[1]) for x in bytes(held[:end]).split(b"\r\n") if x.lower().startswith(b"content-length:"))
            whole = end + 4 + length + 4
            if len(held) < whole:
                break
            yield bytes(held[:whole])
            del held[:whole]
    if held.strip():
        raise ValueError("the archive ends within a record")


INDEX = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])


def parsed(raw: bytes) -> tuple[dict[str, str], bytes, bytes]:
    """A record's header fields, its HTTP header and its payload."""
    head, _, block = raw.partition(b"\r\n\r\n")
    fields = {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in head.decode().split("\r\n")[1:])}
    http, _, payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")
    return fields, http, payload


def normalise(archives: DataFrame, folder: str, level: int = 4) -> DataFrame:
    """Rewrites whole-stream archives record by record beside a sidecar index; gives (archive, index, records)."""

    def run(batches):
        release()
        fs, root = _opened(folder)
        fs.create_dir(root, recursive=True)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                name, index, at = f"{root}/{path.rpartition('/')[2]}", [], 0
                partial = f"{name}.{TaskContext.get().taskAttemptId()}"
                with fs.open_input_stream(path, compression=None) as stream, fs.open_output_stream(partial, compression=None) as out:
                    for raw in split_records(inflated(stream)):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(raw) + packer.flush()
                        fields, _, _ = parsed(raw)
                        out.write(member)
                        index.append({"record_id": fields["warc-record-id"], "record_type": fields["warc-type"], "offset": at, "length": len(member)})
                        at += len(member)
                fs.move(partial, name)
                sidecar = io.BytesIO()
                with pa.ipc.new_file(sidecar, INDEX) as writer:
                    writer.write_table(pa.Table.from_pylist(index, INDEX))
                with fs.open_output_stream(f"{partial}.index", compression=None) as out:
                    out.write(sidecar.getvalue())
                fs.move(f"{partial}.index", f"{name}.index")
                yield pa.RecordBatch.from_pylist([{"archive": name, "index": f"{name}.index", "records": len(index)}], pa.schema([("archive", pa.string()), ("index", pa.string()), ("records", pa.int64())]))

    return archives.mapInArrow(run, "archive string, index string, records long")


def read_records(normalised: DataFrame, folder: str, id_type: str = "bigint", with_payload: bool = True) -> DataFrame:
    """The records of normalised archives, each read as a member of its own from where the index says."""
    import base64
    import hashlib

    integer = id_type in ("bigint", "int", "smallint", "tinyint")
    value = lambda urn: (int(x) if integer else x) if (x := urn.removeprefix("<urn:page:").removesuffix(">")) else None

    def run(batches):
        release()
        fs, _ = _opened(folder)
        for batch in batches:
            for path, index in zip(batch.column("archive").to_pylist(), batch.column("index").to_pylist()):
                with fs.open_input_file(index) as side:
                    places = pa.ipc.open_file(pa.BufferReader(side.read())).read_all().to_pylist()
                found = []
                with fs.open_input_file(path) as data:
                    for place in places:
                        fields, http, payload = parsed(zlib.decompress(data.read_at(place["length"], place["offset"]), 31))
                        full = int(next(x for x in http.decode().split("\r\n") if x.lower().startswith("content-length:")).split(":")[1])
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if fields["warc-type"] == "response" and (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()) != (full, digest):
                            raise ValueError(f"{path}: the payload at {place['offset']} is not what its header says")
                        refers = fields.get("warc-refers-to")
                        found.append((value(fields["warc-record-id"]), fields["warc-target-uri"] or None, fields["warc-type"], value(refers) if refers else None, full, digest, payload if with_payload else None))
                        if len(found) >= 256:
                            yield batch_of(found)
                            found = []
                yield batch_of(found)

    def batch_of(rows):
        kind = pa.int64() if integer else pa.string()
        names, kinds = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"], [kind, pa.string(), pa.string(), kind, pa.int64(), pa.string(), pa.binary()]
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    return normalised.mapInArrow(run, RECORD.format(id="bigint" if integer else "string"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = fresh_path(spark, "warc")
    # each list of files is a written table: reading it again doesn't write the archives again
    archives = written(write_archives(deduplicated(pages), f"{folder}/streams"), "archives")
    normal = written(normalise(archives.repartition(max(1, archives.count()), F.col("archive")), f"{folder}/members"), "normal")
    records = read_records(normal.repartition(max(1, normal.count()), F.col("archive")), folder, with_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


QUERIES = {"op6_warc": op6_warc}
ORACLES = {
    "op6_warc": r"""
WITH h AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages),
d AS (SELECT page_id, payload_bytes, array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, 1 + 5 * (k // 4), 5) AS BIGINT) >> (15 - 5 * (k % 4))) & 31)::INT, 1) FOR k IN range(32)], '') AS payload_digest FROM h),
f AS (SELECT payload_digest, min(page_id) AS first FROM d GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM d JOIN f USING (payload_digest)
"""
}
