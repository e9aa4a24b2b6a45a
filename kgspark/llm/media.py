"""Media columns: payloads kept losslessly in archive files, and a data source that reads them back.

Writing: each payload becomes an 8-bit grey PNG of 64 samples a line (so payloads are padded to a
multiple of 64 bytes; the unpadded length is a tEXt chunk).  A task writes its images as members of tar
files, each under a name of its attempt's own, so nothing is ever renamed or replaced; beside each archive lies an
index of its members' offsets and sizes.  What successful tasks return is written, last, as the list of archives that
count: files of lost or repeated attempts are in no list.

Reading: the data source `media_archive` reads that list on the driver (names and sizes only; without one, all archives
of the directory count) and plans partitions of byte ranges, MOST_RANGES at most; a partition has the members whose
headers begin in its range.  Its task streams them in Arrow batches.  A member that cannot be read, or whose checksums are
wrong, is tried again by itself from its offset, the file opened anew; other members are not read twice.

Files are reached through pyarrow's file systems, so the directory may be a local shared folder, HDFS or
an object store.

Cases: null or empty text: 64 zero bytes, n_bytes 0.  Null doc_id: a member without a number.  Repeated
rows: a member each, with equal values.  Ties: there are none.  Empty table or directory: no rows.  Very long texts: one
member at a time is in memory.  Columns but doc_id and text, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
import re
import struct
import tarfile
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from kgspark.llm.common import chunks, documents, new_path, texts_of

LINE = 64
ARCHIVE_BYTES = 256 << 20
#: Bytes of a range, and the most ranges: with more bytes ranges grow.
RANGE_BYTES = 8 << 20
MOST_RANGES = 50_000
#: The file that lists the archives of a directory that count, with their sizes.
LIST = "archives.json"
BATCH_BYTES = 4 << 20
ATTEMPTS = 4
SIGNATURE = b"\x89PNG\r\n\x1a\n"


def padded(raw: bytes) -> bytes:
    return raw.ljust(max(LINE, -(-len(raw) // LINE) * LINE), b"\0")


def chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def encode(raw: bytes, level: int = 3) -> bytes:
    """The PNG whose samples are the padded bytes of raw."""
    lines = np.frombuffer(padded(raw), dtype=np.uint8).reshape(-1, LINE)
    filtered = np.zeros((len(lines), LINE + 1), dtype=np.uint8)  # each line begins with filter type 0
    filtered[:, 1:] = lines
    head = struct.pack(">IIBBBBB", LINE, len(lines), 8, 0, 0, 0, 0)
    return SIGNATURE + chunk(b"IHDR", head) + chunk(b"tEXt", b"Length\0" + str(len(raw)).encode()) + chunk(b"IDAT", zlib.compress(filtered, level)) + chunk(b"IEND", b"")


def decode(media: bytes) -> tuple[bytes, int]:
    """(payload, unpadded length); ValueError if a checksum or the form is wrong."""
    if not media.startswith(SIGNATURE):
        raise ValueError("not a PNG")
    at, parts = len(SIGNATURE), {}
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, data = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if len(data) < n or struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(data, zlib.crc32(kind)):
            raise ValueError(f"bad {kind!r} chunk")
        parts[kind] = data
        at += 12 + n
    width, height = struct.unpack_from(">II", parts[b"IHDR"])
    lines = np.frombuffer(zlib.decompress(parts[b"IDAT"]), dtype=np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes(), int(parts[b"tEXt"].split(b"\0")[1])


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return pa.fs.LocalFileSystem(), uri
    return pa.fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


class Archive:
    """Tar files of one attempt of a task, `<stem>-<n>.tar`, each with `<stem>-<n>.idx`: pairs of (offset of a member's
    header, size of its data) as 64-bit numbers.  `written` has (name, bytes, members) of those complete."""

    def __init__(self, uri: str, stem: str, limit: int = ARCHIVE_BYTES):
        self.fs, self.dir = file_system(uri)
        self.stem, self.limit = stem, limit
        self.written: list[tuple[str, int, int]] = []
        self.stream = None

    def add(self, name: str, data: bytes) -> None:
        if self.stream is None:
            self.name = f"{self.stem}-{len(self.written):05d}"
            self.stream, self.at, self.index = self.fs.open_output_stream(f"{self.dir}/{self.name}.tar"), 0, []
        info = tarfile.TarInfo(name)
        info.size = len(data)
        head = info.tobuf(tarfile.GNU_FORMAT)
        block = head + data + b"\0" * (-len(data) % tarfile.BLOCKSIZE)
        self.index.append((self.at + len(head) - tarfile.BLOCKSIZE, len(data)))
        self.stream.write(block)
        self.at += len(block)
        if self.at >= self.limit:
            self.close()

    def close(self) -> None:
        if self.stream is None:
            return
        end = b"\0" * 2 * tarfile.BLOCKSIZE
        self.stream.write(end)
        self.stream.close()
        self.stream = None
        with self.fs.open_output_stream(f"{self.dir}/{self.name}.idx") as f:
            f.write(np.array(self.index, dtype="<i8").tobytes())
        self.written.append((f"{self.name}.tar", self.at + len(end), len(self.index)))


WRITTEN = pa.schema([("name", pa.string()), ("bytes", pa.int64()), ("members", pa.int64())])


def write_archives(docs: DataFrame, uri: str) -> int:
    """Write every text as a member; returns their number.  An action: one pass, no shuffle."""
    fs, path = file_system(uri)
    fs.create_dir(path, recursive=True)

    def run(batches):
        task = TaskContext.get()
        archive = Archive(uri, f"part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}")
        for batch in batches:
            for part in chunks(batch, "text"):
                for doc, text in zip(part.column("doc_id").to_pylist(), texts_of(part).cast(pa.large_binary()).to_pylist()):
                    archive.add("null.png" if doc is None else f"{doc}.png", encode(text))
        archive.close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*archive.written) if archive.written else [[]] * 3, WRITTEN.types)], schema=WRITTEN)

    # one row an archive of 256 MB, or a task
    found = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "name string, bytes long, members long").collect()
    with fs.open_output_stream(f"{path}/{LIST}") as f:
        f.write(json.dumps(sorted([r["name"], r["bytes"]] for r in found)).encode())
    return sum(r["members"] for r in found)


def listed(fs: pa.fs.FileSystem, path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the archives of a directory that count."""
    if fs.get_file_info(f"{path}/{LIST}").type == pa.fs.FileType.File:
        with fs.open_input_stream(f"{path}/{LIST}") as f:
            return [(f"{path}/{name}", size) for name, size in json.loads(f.read())]
    found = fs.get_file_info(pa.fs.FileSelector(path, recursive=True, allow_not_found=True))
    return sorted((f.path, f.size) for f in found if f.path.endswith(".tar"))


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int

    def __init__(self, path: str, start: int, end: int):
        super().__init__(path)
        self.path, self.start, self.end = path, start, end


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range_bytes = int(options.get("rangebytes", 0))
        self.attempts = int(options.get("attempts", ATTEMPTS))

    def partitions(self) -> list[InputPartition]:
        fs, path = file_system(self.uri)
        found = listed(fs, path)
        step = self.range_bytes or max(RANGE_BYTES, -(-sum(size for _, size in found) // MOST_RANGES))
        return [ByteRange(name, at, min(at + step, size)) for name, size in found for at in range(0, size, step)] or [ByteRange("", 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        fs, _ = file_system(self.uri)
        with fs.open_input_stream(partition.path[: -len(".tar")] + ".idx") as f:
            index = np.frombuffer(f.read(), dtype="<i8").reshape(-1, 2)
        first, last = np.searchsorted(index[:, 0], [partition.start, partition.end])
        source = Members(fs, partition.path, self.attempts)
        names, media, size = [], [], 0
        for offset, n in index[first:last].tolist():
            name, data = source.member(offset, n)
            names.append(name)
            media.append(data)
            size += n
            if size >= BATCH_BYTES:
                yield self.batch(names, media)
                names, media, size = [], [], 0
        if names:
            yield self.batch(names, media)

    @staticmethod
    def batch(names: list[str], media: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(media, pa.binary())], names=["member", "media"])


class Members:
    """Reads single members of one archive by offset, again and again if need be."""

    def __init__(self, fs: pa.fs.FileSystem, path: str, attempts: int = ATTEMPTS, pause: float = 0.2):
        self.fs, self.path, self.attempts, self.pause = fs, path, attempts, pause
        self.file = None

    def member(self, offset: int, size: int) -> tuple[str, bytes]:
        for left in range(self.attempts - 1, -1, -1):
            try:
                if self.file is None:
                    self.file = self.fs.open_input_file(self.path)
                block = self.file.read_at(tarfile.BLOCKSIZE + size, offset)
                info = tarfile.TarInfo.frombuf(block[: tarfile.BLOCKSIZE], "utf-8", "strict")
                data = block[tarfile.BLOCKSIZE :]
                if info.size != size or len(data) != size:
                    raise ValueError(f"{size} bytes expected at {offset}")
                decode(data)
                return info.name, data
            except (OSError, ValueError, tarfile.HeaderError, zlib.error, struct.error, KeyError):
                self.file = None
                if not left:
                    raise
                time.sleep(self.pause * (self.attempts - left))
        raise AssertionError


class MediaArchive(DataSource):
    """spark.read.format("media_archive").load(directory): member string, media binary."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "member string, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(dict(self.options))


def feature(payload: bytes) -> str:
    """Mean, deviation and entropy of the samples, and a bit for each column that is brighter than the whole."""
    samples = np.frombuffer(payload, dtype=np.uint8)
    share = np.bincount(samples, minlength=256) / len(samples)
    entropy = -float((share[share > 0] * np.log2(share[share > 0])).sum())
    bright = samples.reshape(-1, LINE).mean(axis=0) > samples.mean()
    return f"mean={samples.mean():.4f};dev={samples.std():.4f};entropy={abs(entropy):.4f};columns={np.packbits(bright).tobytes().hex()}"


COLUMNS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])
DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def described(media: DataFrame) -> DataFrame:
    """What the stored bytes hold, from the stored bytes alone."""

    def run(batches):
        for batch in batches:
            out = [[] for _ in COLUMNS]
            for member, data in zip(batch.column("member").to_pylist(), batch.column("media")):
                data = data.as_py()
                payload, n = decode(data)
                number = member.partition(".")[0]
                row = (None if number == "null" else int(number), n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-LINE:]), len(data), hashlib.sha256(data).hexdigest(), feature(payload))
                for column, value in zip(out, row):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, COLUMNS.types)], schema=COLUMNS)

    return media.mapInArrow(run, DDL)


def media_column(docs: DataFrame, uri: str, **options) -> DataFrame:
    """Write the texts of docs to archives under uri and return (member, media) read back from there."""
    spark = docs.sparkSession
    write_archives(docs, uri)
    spark.dataSource.register(MediaArchive)
    return spark.read.format("media_archive").options(**options).load(uri)


def op2_media_columns(spark, sf_dir):
    return described(media_column(documents(spark, sf_dir), new_path(spark, "media")))
