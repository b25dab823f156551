"""WARC archives: monolithic gzip files written from pages, normalised to a member for each record, read by their index.

Crawlers and plain gzip tools write an archive as one gzip stream, of which nothing can be read without inflating all
before it. The normaliser inflates such a file once, from its beginning to its end, cuts it into records by their
stated lengths, writes each record as a gzip member of its own into a new archive, and gives a row for each: the
sidecar index of file, offset and length. A record is then read by one seek.

* `write_archives`: one record for each page, one gzip stream for each partition. Spark's text writer does it: a
  record is a row, and the line separator is what ends a record. Of pages with equal payloads of REVISIT_BYTES or
  more, that with the least id is a response and the others revisit it.
* `normalised`: Spark's text reader inflates each file in one pass and hands on pieces between blank lines; a task
  puts them together again, one record at a time, so that memory follows the largest record and not the file. A file
  is written under a name of the attempt, and only the index of attempts that were committed names it, so lost
  executors and repeated tasks leave at most files that nothing refers to.
* `records`: the index dealt out by stretches of the files; each record is read by its offset, and its payload held
  against the stated digest.

Defined results: a null payload is empty; null ids are written as such, are never the least unless all are null, and
come back null; rows of one id are records of their own, all responses if their payload is the least id's; a null
address is left out, line breaks in one are escaped; columns other than id, address and payload are ignored; an empty
table gives no records. A file that is no archive, ends within a record, or holds a payload with another digest than
it states, fails the job.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from labframe.llm.common import guarded, new_path, removed, stored

#: Least payload that is revisited, and bytes of an archive that one task reads by offsets.
REVISIT_BYTES, STRETCH = 100, 64 << 20
#: Fixed values of the format: what ends a header or a record, its version, the profile of revisits, the media type.
GAP, VERSION, HTTP = "\r\n\r\n", "WARC/1.1", "application/http; msgtype=response"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: How a page's id is written, and what stands for a null one.
URN, NO_ID = "urn:page:", "urn:page-without-id"
INDEX = "file string, offset bigint, length bigint, record_id string, record_type string, target string"
RECORD = "record_id string, target string, payload_bytes bigint, payload_digest string, record_type string, refers_to string"
_NUMBERS, _TEXTS = pa.int64(), pa.string()


def _urn(c: Column) -> Column:
    return F.coalesce(F.concat(F.lit(URN), F.url_encode(c.cast("string"))), F.lit(NO_ID))


def _id(urn: Column, kind: str) -> Column:
    return F.when(urn.startswith(URN), F.url_decode(F.substr(urn, F.lit(len(URN) + 1)))).cast(kind)


def record_texts(df: DataFrame, id_column: str, payload: str, target: str, date: str) -> DataFrame:
    """(value): the record of each row of df, up to the gap that ends it.

    Only digests that occur more than once have a first row to know; payloads are dealt out by digest once, and Spark
    splits the share of a digest that very many rows have.
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = df.select(F.col(id_column).alias("id"), F.col(target).alias("target"), body.alias("body"), F.sha2(body.cast("binary"), 256).alias("digest"))
    many = rows.where(F.octet_length("body") >= REVISIT_BYTES).groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    rows = rows.join(stored(many, "firsts").hint("shuffle_hash"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    n = F.octet_length("body").cast("string")
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"), F.lit("Content-Length: "), n, F.lit(GAP))
    block = F.when(again, head).otherwise(F.concat(head, "body"))
    address = F.replace(F.replace("target", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    fields = [
        F.lit(f"{VERSION}\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", F.concat(F.lit("<"), _urn(F.col("id")), F.lit(">"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", address), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "digest")),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", F.concat(F.lit("<"), _urn(F.col("first")), F.lit(">"))))).otherwise(""),
        line("Content-Type", F.lit(HTTP)),
        F.concat(F.lit("Content-Length: "), F.octet_length("block").cast("string"), F.lit(GAP)),
    ]
    return rows.withColumn("block", block).select(F.concat(*fields, "block").alias("value"))


def write_archives(df: DataFrame, path: str, id_column: str = "page_id", payload: str = "html", target: str = "url", date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes a record for each row of df to archives in a new folder, each one gzip stream."""
    guarded(df.columns, [id_column, payload, target], "write_archives")
    record_texts(df, id_column, payload, target, date).write.option("lineSep", GAP).option("compression", "gzip").text(path)


class Cutter:
    """Cuts the bytes of an archive, given piece by piece, into records (fields, block)."""

    def __init__(self) -> None:
        self.held = bytearray()
        self.fields: dict[str, str] | None = None

    def feed(self, data: bytes) -> Iterator[tuple[bytes, dict[str, str]]]:
        """The records, as they stand with the gap after them, that end within what was given so far."""
        self.held += data
        while True:
            if self.fields is None:
                at = self.held.find(b"\r\n\r\n")
                if at < 0:
                    return
                self.fields, self.start = fields(bytes(self.held[:at])), at + 4
                self.needed = self.start + int(self.fields["content-length"])
            if len(self.held) < self.needed + 4:
                return
            if self.held[self.needed : self.needed + 4] != b"\r\n\r\n":
                raise ValueError(f"record {self.fields['warc-record-id']} does not end where it states")
            yield bytes(self.held[: self.needed + 4]), self.fields
            del self.held[: self.needed + 4]
            self.fields = None

    def end(self, file: str) -> None:
        if self.held.strip():
            raise ValueError(f"{file} ends within a record")


def fields(header: bytes) -> dict[str, str]:
    """The named fields of a record's header, by lower-cased name."""
    first, *lines = header.decode("utf-8", "replace").split("\r\n")
    if not re.fullmatch(r"WARC/\d\.\d", first):
        raise ValueError(f"not a record: {first[:40]!r}")
    found = {name.strip().lower(): value.strip() for name, _, value in (x.partition(":") for x in lines)}
    if not {"warc-type", "warc-record-id", "content-length"} <= found.keys():
        raise ValueError(f"a record lacks its type, id or length: {sorted(found)}")
    return found


def _opened(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", uri))


def _bare(urn: str | None) -> str | None:
    return urn and urn.strip("<>")


def normalised(spark: SparkSession, source: str, folder: str, level: int = 6) -> DataFrame:
    """The stored index (see INDEX) of new archives in `folder`, in which each record of the archives of `source` is a gzip member.

    Files end in .gz, or are plain; ones that have members already are read alike.
    """
    pieces = spark.read.option("lineSep", GAP).text(source).select(F.col("value").cast("binary").alias("piece"), F.col("_metadata.file_path").alias("source"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, base = _opened(folder)
        files.create_dir(base, recursive=True)
        at, cutter, out, name, offset = None, None, None, "", 0
        for batch in batches:
            rows = []
            for piece, of in zip(batch.column("piece"), batch.column("source").to_pylist(), strict=True):
                if of != at:
                    if cutter:
                        cutter.end(at)
                        out.close()
                    at, cutter, offset = of, Cutter(), 0
                    name = f"records-{uuid.uuid4().hex}.warc.gz"
                    out = files.open_output_stream(f"{base}/{name}", compression=None)  # it would compress by the ending
                for record, head in cutter.feed(piece.as_py() + b"\r\n\r\n"):
                    packed = zlib.compressobj(level, zlib.DEFLATED, 31)
                    member = packed.compress(record) + packed.flush()
                    out.write(member)
                    rows.append((f"{folder}/{name}", offset, len(member), _bare(head["warc-record-id"]), head["warc-type"], head.get("warc-target-uri")))
                    offset += len(member)
            yield _batch(rows, INDEX)
        if cutter:
            cutter.end(at)
            out.close()

    return stored(pieces.mapInArrow(rewrite, INDEX), "index")


def _batch(rows: Iterable[tuple], ddl: str) -> pa.RecordBatch:
    names, kinds = zip(*(x.strip().split(" ") for x in ddl.split(",")), strict=True)
    columns = zip(*rows, strict=True) if rows else [[]] * len(names)
    kind = {"bigint": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kind[k]) for c, k in zip(columns, kinds, strict=True)], list(names))


def records(index: DataFrame, payload: bool = False, batch_bytes: int = 4_000_000) -> DataFrame:
    """The records of an index (see RECORD), and their payloads if asked for, each read by its offset.

    A response's length and digest are those of the bytes at hand, a revisit's those that it states of the payload it refers to.
    """
    ddl = RECORD + (", payload binary" if payload else "")
    dealt = index.select("file", "offset", "length").repartition("file", F.floor(F.col("offset") / STRETCH)).sortWithinPartitions("file", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, handle = None, None
        for batch in batches:
            rows, held = [], 0
            for file, offset, length in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")), strict=True):
                if file != at:
                    files, path = _opened(file)
                    at, handle = file, files.open_input_file(path)
                handle.seek(offset)
                ((record, head),) = Cutter().feed(zlib.decompress(handle.read(length), 31))
                rows.append(described(record, head)[: len(ddl.split(","))])
                held += len(record)
                if payload and held > batch_bytes:
                    yield _batch(rows, ddl)
                    rows, held = [], 0
            yield _batch(rows, ddl)

    return dealt.mapInArrow(read, ddl)


def described(record: bytes, head: dict[str, str]) -> tuple:
    """One record as a row of RECORD with its payload."""
    block = record[record.index(b"\r\n\r\n") + 4 : -4]
    http, _, body = block.partition(b"\r\n\r\n") if head.get("content-type", "").startswith("application/http") else (b"", b"", block)
    stated = head.get("warc-payload-digest", "").removeprefix("sha256:")
    n, digest = len(body), hashlib.sha256(body).hexdigest()
    if head["warc-type"] == "revisit":
        length = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        n, digest, body = (int(length[1]) if length else None), stated, None
    elif stated and re.fullmatch("[0-9a-f]{64}", stated) and stated != digest:
        raise ValueError(f"record {head['warc-record-id']} has digest {digest}, not {stated}")
    return _bare(head["warc-record-id"]), head.get("warc-target-uri"), n, digest, head["warc-type"], _bare(head.get("warc-refers-to")), body


def dangling(found: DataFrame) -> DataFrame:
    """Revisits of `records` without a response of the id and digest that they name."""
    there = found.where("record_type = 'response'").select(F.col("record_id").alias("refers_to"), "payload_digest")
    return found.where("record_type = 'revisit'").join(there, ["refers_to", "payload_digest"], "left_anti")


def archived(df: DataFrame, id_column: str = "page_id", payload: str = "html", target: str = "url") -> DataFrame:
    """(id, payload_bytes, payload_digest, record_type, refers_to) of each row of df, read back from normalised archives; these go afterwards."""
    spark, kind = df.sparkSession, df.schema[id_column].dataType.simpleString()
    whole, single = new_path(spark, "archives"), new_path(spark, "members")
    write_archives(df, whole, id_column, payload, target)
    index = normalised(spark, whole, single)
    found = records(index).select(_id(F.col("record_id"), kind).alias(id_column), "payload_bytes", "payload_digest", "record_type", _id(F.col("refers_to"), kind).alias("refers_to"))
    out = stored(found, "records")
    removed(spark, whole, single)
    return out
