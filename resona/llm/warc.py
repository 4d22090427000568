"""WARC archives: whole-file gzip streams made into one gzip member per record, with an offset index beside them."""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.skew import join_groups
from ..session import stage_path
from .registry import query, table

END = "\r\n\r\n"
MIN_REVISIT = 1000
READ = 1 << 20
INDEX = "file string, source string, record long, offset long, length long, record_id string, record_type string"
_INDEX = pa.schema([("file", pa.string()), ("source", pa.string()), ("record", pa.int64()), ("offset", pa.int64()),
                    ("length", pa.int64()), ("record_id", pa.string()), ("record_type", pa.string())])


def _fs(uri: str):
    """File system of a shared folder and the path in it; on every executor, by the scheme of the address."""
    from pyarrow import fs

    if uri.startswith(("/", "file:")):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def revisits(pages: DataFrame, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """pages (page_id, payload) with digest, payload_bytes, record_type, refers_to.

    Of equal payloads of min_bytes or more the one with the largest page_id is the response. Groups are reduced before
    the join, and groups with many rows are salted, so no task holds a group. Rows without page_id are responses and referred to by none.
    """
    sized = pages.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "digest", F.sha1(F.col("payload").cast("binary")))
    # Short payloads and rows without id are groups of their own.
    key = F.when((F.col("payload_bytes") >= min_bytes) & F.col("page_id").isNotNull(), F.col("digest"))
    keyed = sized.withColumn("_key", key)
    groups = keyed.where(F.col("_key").isNotNull()).groupBy("_key").agg(
        F.max("page_id").alias("_last"), F.count(F.lit(1)).alias("_n")).where("_n > 1")
    joined = join_groups(keyed, groups, ["_key"], "_n", "page_id")
    again = F.col("_last").isNotNull() & (F.col("page_id") != F.col("_last"))
    return joined.select("page_id", "url", "payload", "payload_bytes", "digest",
                         F.when(again, "revisit").otherwise("response").alias("record_type"),
                         F.when(again, F.col("_last")).alias("refers_to"))


def record_text(url: F.Column) -> F.Column:
    """A WARC record without its closing blank lines; a revisit has the digest and size of what it stands for, but no content."""
    def line(name: str, value: F.Column) -> F.Column:
        return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")

    revisit = F.col("record_type") == "revisit"
    body = F.when(revisit, F.lit("")).otherwise(F.col("payload"))
    return F.concat(
        F.lit("WARC/1.1\r\n"), line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.col("page_id").cast("string"), F.lit(">"))),
        line("WARC-Target-URI", F.regexp_replace(url, r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        F.lit("Content-Type: text/html\r\n"), F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(END), body)


def write_streams(records: DataFrame, path: str) -> None:
    """One gzip stream per task, written by Spark; a record ends with two line ends, which is the writer's separator."""
    records.select(record_text(F.col("url"))).write.option("lineSep", END).option("compression", "gzip").text(path)


def files_of(spark, path: str, suffix: str) -> list[str]:
    """Addresses of the data files in a folder. Their number is that of the tasks that wrote it."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = at.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(at)
    return sorted(x for s in found if (x := s.getPath().toString()).endswith(suffix) and not s.getPath().getName().startswith(("_", ".")))


class _Stream:
    """Reads bytes of a gzip stream (one member or several) with bounded memory."""

    def __init__(self, source):
        self.source, self.inflate, self.raw, self.have, self.over = source, zlib.decompressobj(31), b"", bytearray(), False

    def _more(self) -> bool:
        while not self.over:
            self.raw = self.raw or self.source.read(READ)
            if not self.raw:
                self.over = True
                break
            self.have += self.inflate.decompress(self.raw, READ)
            self.raw = self.inflate.unconsumed_tail
            if self.inflate.eof:
                self.raw, self.inflate = self.inflate.unused_data, zlib.decompressobj(31)
            return True
        return False

    def header(self) -> bytes | None:
        """Bytes up to and with the next empty line; None at the end."""
        seen = 0
        while (at := self.have.find(b"\r\n\r\n", max(0, seen - 3))) < 0:
            seen = len(self.have)
            if not self._more():
                if self.have.strip():
                    raise ValueError("a record is cut off")
                return None
        out = bytes(self.have[:at + 4])
        del self.have[:at + 4]
        return out

    def blocks(self, n: int) -> Iterator[bytes]:
        """The next n bytes in pieces."""
        while n:
            if not self.have and not self._more():
                raise ValueError("a record is cut off")
            out = bytes(self.have[:min(n, READ)])
            del self.have[:len(out)]
            n -= len(out)
            if out:
                yield out


def parse_header(raw: bytes) -> dict[str, str]:
    """Fields of a record's header, names in lower case; the first of repeated ones."""
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        name, sep, value = line.partition(":")
        if sep:
            out.setdefault(name.strip().lower(), value.strip())
    return out


def normalise(spark, sources: list[str], target: str) -> DataFrame:
    """Rewrite each file with one gzip member per record into the folder target; returns the index rows.

    A task inflates a file once, as a stream, and holds one block at a time, so neither the file nor a record must
    fit in memory. The archive and its index (`.idx`, tab-separated) are written under names of the attempt and then renamed, so a task
    that runs twice leaves the same files. An empty file gives an empty archive.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = _fs(target)
        for batch in batches:
            for source in batch.column("source").to_pylist():
                name = source.rsplit("/", 1)[-1].removesuffix(".txt.gz").removesuffix(".gz") + ".warc.gz"
                attempt, rows, offset = f".{name}-{uuid.uuid4().hex}", [], 0
                at, path = _fs(source)
                with at.open_input_stream(path, compression=None) as raw, fs.open_output_stream(
                        f"{folder}/{attempt}", compression=None) as out:
                    stream = _Stream(raw)
                    while (head := stream.header()) is not None:
                        fields = parse_header(head)
                        deflate, start = zlib.compressobj(6, zlib.DEFLATED, 31), offset
                        pieces = [head]
                        for piece in stream.blocks(int(fields["content-length"])):
                            offset += out.write(deflate.compress(b"".join(pieces)))
                            pieces = [piece]
                        if b"".join(stream.blocks(4)) != b"\r\n\r\n":
                            raise ValueError(f"record {len(rows)} of {source} has no end mark")
                        pieces.append(b"\r\n\r\n")
                        offset += out.write(deflate.compress(b"".join(pieces)) + deflate.flush())
                        rows.append({"file": f"{target}/{name}", "source": source, "record": len(rows), "offset": start,
                                     "length": offset - start, "record_id": fields.get("warc-record-id"),
                                     "record_type": fields.get("warc-type")})
                with fs.open_output_stream(f"{folder}/{attempt}.idx", compression=None) as out:
                    for r in rows:
                        out.write("\t".join(str(r[c]) for c in ("offset", "length", "record_id", "record_type")).encode() + b"\n")
                fs.move(f"{folder}/{attempt}", f"{folder}/{name}")
                fs.move(f"{folder}/{attempt}.idx", f"{folder}/{name}.idx")
                yield pa.RecordBatch.from_pylist(rows, schema=_INDEX)

    fs, folder = _fs(target)
    fs.create_dir(folder, recursive=True)
    listed = spark.createDataFrame([(s,) for s in sources], "source string").repartition(max(1, len(sources)))
    return listed.mapInArrow(run, INDEX)


RECORD = "record_id string, record_type string, refers_to string, digest string, payload_bytes long, content_sha1 string, content_bytes long"
_RECORD = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("digest", pa.string()),
                     ("payload_bytes", pa.int64()), ("content_sha1", pa.string()), ("content_bytes", pa.int64())])


def read_archives(spark, files: list[str]) -> DataFrame:
    """One row per record, found by the index beside each archive; the content is digested anew, not taken from the header."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column("file").to_pylist():
                fs, path = _fs(file)
                rows = []
                with fs.open_input_stream(f"{path}.idx", compression=None) as index, fs.open_input_file(path) as archive:
                    lines = index.read().decode().splitlines()
                    for line in lines:
                        offset, length = map(int, line.split("\t")[:2])
                        archive.seek(offset)
                        member = _Stream(pa.BufferReader(archive.read(length)))
                        fields = parse_header(member.header())
                        sha, size = hashlib.sha1(), 0
                        for piece in member.blocks(int(fields["content-length"])):
                            sha.update(piece)
                            size += len(piece)
                        digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
                        rows.append({"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"),
                                     "refers_to": fields.get("warc-refers-to"), "digest": digest or None, "content_bytes": size,
                                     "payload_bytes": int(fields.get("x-payload-length", size)), "content_sha1": sha.hexdigest()})
                        if len(rows) == 1000:
                            yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema=_RECORD)

    return spark.createDataFrame([(f,) for f in files], "file string").repartition(max(1, len(files))).mapInArrow(run, RECORD)


ORACLE = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes from pages),
d as (select *, sha1(html) as payload_digest from p),
m as (select payload_digest, max(page_id) as last from d where payload_bytes >= 1000 group by payload_digest)
select page_id, payload_bytes, d.payload_digest,
  case when last is not null and payload_bytes >= 1000 and page_id <> last then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and page_id <> last then last end as refers_to
from d left join m on d.payload_digest = m.payload_digest
"""


@query("op8_warc", ORACLE)
def op8(spark, sf_dir):
    """Writes whole-file streams, normalises them, and reads the normalised archives by their index."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url", F.coalesce("html", F.lit("")).alias("payload"))
    top = stage_path(spark, "warc")
    write_streams(revisits(pages), f"{top}/streams")
    index = normalise(spark, files_of(spark, f"{top}/streams", ".gz"), f"{top}/archives")
    index.write.parquet(f"{top}/index")
    records = read_archives(spark, files_of(spark, f"{top}/archives", ".warc.gz"))
    number = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d+)>$", 1).cast("long")
    whole = F.when(F.col("record_type") == "revisit", F.col("digest")).otherwise(F.col("content_sha1"))
    size = F.when(F.col("record_type") == "revisit", F.col("payload_bytes")).otherwise(F.col("content_bytes"))
    return records.select(number("record_id").alias("page_id"), size.alias("payload_bytes"), whole.alias("payload_digest"),
                          "record_type", number("refers_to").alias("refers_to"))
