"""Media columns: content-defined chunks, stored once, rebuild verified media.

A text's bytes, padded to blocks of 64, are the samples of an 8-bit mono wave file. A rolling gear hash over the
last 32 bytes cuts the file where its high bits are zero, so equal passages give equal chunks wherever they stand.
A first pass gives every file's ordered list of chunk digests. Digests that occur more than once get an owner, the
first file and place, by a grouping; a join tells each file which of its chunks it owns or has to refer to. A second
pass cuts the files again and keeps the bytes of a file's own chunks and of those it owns. So each distinct chunk is
stored once and most files need no other. To read back, files that refer to others' chunks join them from the stored
table, chunks are put in order, the length and digest of the file are verified, and the features come from the parsed
wave file.

Only digests and row numbers are shuffled by digest, never bytes. The second pass meets what the first found by a
join on the row number: the marks are broadcast if they were counted and are few, otherwise Spark deals out the texts,
once.

Defined results: null and empty texts give one block of zeros; repeated rows share their chunks and give equal
values; columns other than key and text are ignored; an empty table gives an empty table. A file that does not match
its digest fails the job.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import BROADCAST_ROWS, by_bytes, discarded, guarded, stored

#: Bytes to pad to; chunk sizes: least, most, and the high bits that are zero at a cut (about 1,024 bytes apart).
BLOCK, LEAST, MOST, CUT_BITS = 64, 256, 8192, 10
BATCH_BYTES = 4_000_000
#: Samples a second that the header states.
RATE = 8000
_GEAR = np.random.default_rng(20240307).integers(0, 1 << 32, 256, np.uint32)


def payload(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (max(BLOCK, -(-len(raw) // BLOCK) * BLOCK) - len(raw))


def wave(samples: bytes) -> bytes:
    """A RIFF wave file of 8-bit mono samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(samples), b"WAVE", b"fmt ", 16, 1, 1, RATE, RATE, 1, 8, b"data", len(samples)) + samples


def samples(file: bytes) -> bytes:
    """The samples of such a file, found by walking its chunks."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("not a wave file")
    at = 12
    while at + 8 <= len(file):
        name, n = struct.unpack_from("<4sI", file, at)
        if name == b"data":
            return file[at + 8 : at + 8 + n]
        at += 8 + n + (n & 1)
    raise ValueError("a wave file without samples")


def cuts(data: bytes) -> list[int]:
    """Ends of the chunks of a file. The gear hash of all places at once: windows of 1, 2, 4, ... 32 bytes by doubling."""
    h, width = _GEAR[np.frombuffer(data, np.uint8)], 1
    while width < 32:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    ends, start = [], 0
    for at in (np.flatnonzero(h >> np.uint32(32 - CUT_BITS) == 0) + 1).tolist():
        while at - start > MOST:
            start += MOST
            ends.append(start)
        if at - start >= LEAST:
            ends.append(at)
            start = at
    while len(data) - start > MOST:
        start += MOST
        ends.append(start)
    return ends if ends and ends[-1] == len(data) else [*ends, len(data)]


def chunks(file: bytes) -> list[tuple[bytes, bytes]]:
    """(digest, bytes) of the chunks in order."""
    ends = cuts(file)
    return [(hashlib.blake2b(c, digest_size=16).digest(), c) for a, b in zip([0, *ends[:-1]], ends, strict=True) for c in (file[a:b],)]


#: What a file has of a chunk: a reference, bytes that only it needs, or bytes that others refer to.
ELSEWHERE, UNIQUE, SHARED = 0, 1, 2
FILES = "row bigint, id {id}, n_bytes bigint, file_sha256 string, digests array<binary>, lengths array<int>, kept array<tinyint>, bytes array<binary>"


def numbered(df: DataFrame, **columns: str) -> DataFrame:
    """The named columns and `row`, a row's number in a table read from files."""
    return df.select(F.monotonically_increasing_id().alias("row"), *(F.col(c).alias(to) for to, c in columns.items()))


def listed(df: DataFrame, id_column: str, text: str) -> DataFrame:
    """(row, at, digest) of the chunks of each file."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            found = [[d for d, _ in chunks(wave(payload(t)))] for t in batch.column("text").to_pylist()]
            of = np.repeat(np.arange(len(found)), [len(x) for x in found])
            at = np.concatenate([np.arange(len(x), dtype=np.int32) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column("row").take(pa.array(of)), pa.array(at), pa.array([d for x in found for d in x], pa.binary())], ["row", "at", "digest"])

    return numbered(df, id=id_column, text=text).mapInArrow(cut, "row bigint, at int, digest binary")


def store(df: DataFrame, id_column: str = "doc_id", text: str = "text", few: int = BROADCAST_ROWS) -> DataFrame:
    """The stored files (see FILES): ordered chunk lists, each distinct chunk's bytes in one file.

    df is read twice and its rows are known by their place, so it has to be a table read from files (or stored).
    """
    guarded(df.columns, [id_column, text], "media")
    kind = df.schema[id_column].dataType.simpleString()
    every = stored(listed(df, id_column, text), "chunks")
    owners = every.groupBy("digest").agg(F.min(F.struct("row", "at")).alias("owner"), F.count("*").alias("n")).where("n > 1").select("digest", "owner")
    owners = stored(owners, "owners")
    mine = (F.col("owner.row") == F.col("row")) & (F.col("owner.at") == F.col("at"))
    marked = every.join(owners, "digest").select("row", "at", F.when(mine, SHARED).otherwise(ELSEWHERE).cast("tinyint").alias("kept"))
    marks = stored(marked.groupBy("row").agg(F.collect_list(F.struct("at", "kept")).alias("marks")), "marks")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["row", "id", "n_bytes", "file_sha256", "digests", "lengths", "kept", "bytes"]
        types = [pa.int64(), pa.string(), pa.list_(pa.binary()), pa.list_(pa.int32()), pa.list_(pa.int8()), pa.list_(pa.binary())]
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            out = []
            for t, known in zip(batch.column("text").to_pylist(), batch.column("marks").to_pylist(), strict=True):
                body = wave(payload(t))
                parts, kept = chunks(body), {m["at"]: m["kept"] for m in known or []}
                kept = [kept.get(at, UNIQUE) for at in range(len(parts))]
                out.append((len((t or "").encode()), hashlib.sha256(body).hexdigest(), [d for d, _ in parts], [len(c) for _, c in parts], kept, [c if k else None for (_, c), k in zip(parts, kept, strict=True)]))
            yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("id"), *(pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True))], names)

    n = marks.agg(F.sum(F.size("marks"))).first()[0] or 0
    rows = numbered(df, id=id_column, text=text).join(F.broadcast(marks) if n <= few else marks, "row", "left")
    files = stored(rows.select("row", "id", "text", "marks").mapInArrow(write, FILES.format(id=kind)), "media")
    discarded(every, owners, marks)
    return files


def rebuilt(files: DataFrame) -> DataFrame:
    """(row, id, n_bytes, file_sha256, bytes: the chunks in order) of each stored file."""
    whole = F.forall("kept", lambda k: k != ELSEWHERE)
    own = files.where(whole).select("row", "id", "n_bytes", "file_sha256", "bytes")
    parts = lambda df: df.select("row", F.posexplode(F.arrays_zip("digests", "kept", "bytes")).alias("at", "c")).select("row", "at", F.col("c.digests").alias("digest"), "c.kept", "c.bytes")
    loose = parts(files.where(~whole))
    wanted = loose.where(F.col("kept") == ELSEWHERE).select("digest", "row", "at")
    shared = parts(files.where(F.exists("kept", lambda k: k == SHARED))).where(F.col("kept") == SHARED).select("digest", "bytes")  # one row a digest
    found = wanted.join(shared, "digest").select("row", "at", "bytes").unionByName(loose.where(F.col("kept") != ELSEWHERE).select("row", "at", "bytes"))
    put = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("at", "bytes"))).alias("parts")).select("row", F.transform("parts", lambda p: p["bytes"]).alias("bytes"))
    heads = files.where(~whole).select("row", "id", "n_bytes", "file_sha256")
    return own.unionByName(heads.join(put, "row").select("row", "id", "n_bytes", "file_sha256", "bytes"))


def features(files: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """(id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) from the stored bytes."""
    kind = files.schema["id"].dataType.simpleString()
    names = [id_column, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for n, sha, parts in zip(batch.column("n_bytes").to_pylist(), batch.column("file_sha256").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                body = b"".join(parts)
                if (got := hashlib.sha256(body).hexdigest()) != sha:
                    raise ValueError(f"a rebuilt file has digest {got}, not {sha}")
                data = samples(body)
                wide = np.frombuffer(data, np.uint8).astype(np.int64) - 128
                out.append((n, len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-BLOCK:]), len(body), got, f"chunks={len(parts)};peak={np.abs(wide).max()};energy={int((wide * wide).sum())}"))
            columns = list(zip(*out, strict=True)) if out else [[]] * 7
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([batch.column("id"), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names)

    return rebuilt(files).select("id", "n_bytes", "file_sha256", "bytes").mapInArrow(read, f"`{id_column}` {kind}, n_bytes bigint, payload_bytes bigint, payload_sha256 string, tail_crc32 bigint, media_bytes bigint, media_sha256 string, feature string")
