"""Media columns: payloads kept as lossless images in archives, and a data source that reads them back.

Each task writes its images into archives (stored members behind a directory of their places), a new one from
``ARCHIVE`` bytes on. The data source plans partitions as byte ranges of the archives. A partition reads the
directory of its archive, takes the members that begin in its range, and streams their payloads in Arrow batches
of a bounded number of bytes. A directory that cannot be read is read again; after the last attempt it gives one
row with the error and no member for the archive. A member that cannot be read or does not match its checksum is
read again by its own offset, and after the last attempt gives a row with its error and a null payload; the
others are not affected.

The image form is an 8-bit grey PNG, ``WIDTH`` samples a row, without row filters. Payloads are filled up with
byte 255, which no UTF-8 text holds, to a positive multiple of ``WIDTH``; so the unpadded length is known.

Defined results: null or empty text is one row of 255; equal texts give equal values; a null doc_id stays null;
repeated rows are members each; texts of any length are stored whole; an empty table gives no archive and an empty
result; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import hashlib
import io
import struct
import time
import zipfile
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import filesystem, in_arrow, shared_dir, slices, utf8

WIDTH = 576
RANGE = 8 << 20  # bytes of an archive in a partition
ARCHIVE = 32 << 20  # bytes from which on a task begins a new archive
BATCH = 4 << 20  # bytes of payload in an Arrow batch
_MAGIC = b"\x89PNG\r\n\x1a\n"


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def to_image(payload: bytes, width: int = WIDTH, level: int = 1) -> bytes:
    """A grey PNG with the payload as samples; its length must be a positive multiple of the width."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, width)
    lines = np.zeros((len(rows), width + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def from_image(image: bytes) -> np.ndarray:
    """The samples of a grey PNG as written by ``to_image``, height by width."""
    if image[:8] != _MAGIC:
        raise ValueError("not a PNG")
    at, width, data = 8, 0, []
    while at < len(image):
        (n,), kind = struct.unpack_from(">I", image, at), image[at + 4 : at + 8]
        body = image[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", image, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError("damaged PNG chunk")
        if kind == b"IHDR":
            width, _, depth, colour, *_ = struct.unpack(">IIBBBBB", body)
            if (depth, colour) != (8, 0):
                raise ValueError("only 8-bit grey")
        elif kind == b"IDAT":
            data.append(body)
        at += n + 12
    lines = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(-1, width + 1)
    if lines[:, 0].any():
        raise ValueError("filtered rows")
    return lines[:, 1:]


def padded(text: bytes, width: int = WIDTH) -> bytes:
    return text + b"\xff" * (max(width, -(-len(text) // width) * width) - len(text))


def write_archives(docs: DataFrame, width: int = WIDTH, most: int = ARCHIVE) -> tuple[str, list[tuple[str, int]]]:
    """Folder and (path, bytes) of the archives. A repeated task writes the same files again."""
    uri = shared_dir(docs.sparkSession, "media")

    def write(batches):
        from pyspark import TaskContext

        at, folder = filesystem(uri)
        at.create_dir(folder, recursive=True)
        task = TaskContext.get()
        rows, serial, n = (row for whole in batches for batch in slices(whole, "text") for row in _payloads(batch)), 0, 0
        row = next(rows, None)
        while row is not None:
            path = f"{folder}/part-{task.partitionId():06d}-{serial:05d}.zip"
            draft = f"{path}.{task.taskAttemptId()}.draft"
            with at.open_output_stream(draft) as out, zipfile.ZipFile(sink := _Sink(out), "w", zipfile.ZIP_STORED, allowZip64=True) as archive:
                while row is not None and sink.size < most:
                    doc, data = row
                    # Its place in the task parts members of one document id.
                    archive.writestr(zipfile.ZipInfo(f"{'null' if doc is None else doc}-{n}.png"), to_image(padded(data, width)))
                    n += 1
                    row = next(rows, None)
            at.move(draft, path)
            serial += 1
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([at.get_file_info(path).size], pa.int64())], ["path", "bytes"])

    table = in_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), write, "path string, bytes long")
    return uri, sorted((r["path"], r["bytes"]) for r in table.collect())  # a row for each archive


def _payloads(batch: pa.RecordBatch):
    """doc_id and bytes of each text of a batch."""
    raw, starts = utf8(batch.column("text"))
    data = raw.tobytes()
    for doc, a, b in zip(batch.column("doc_id").to_pylist(), starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        yield doc, data[a:b]


class _Sink(io.RawIOBase):
    """A stream that only goes forward, for zipfile."""

    def __init__(self, out):
        self.out, self.size = out, 0

    def writable(self) -> bool:
        return True

    def write(self, data) -> int:
        self.out.write(data)
        self.size += len(data)
        return len(data)


@dataclass
class ByteRange(InputPartition):
    path: str
    size: int
    begin: int
    end: int


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri = options["path"]
        self.range = int(options.get("range", RANGE))
        self.attempts = int(options.get("attempts", 3))

    def partitions(self) -> list[ByteRange]:
        """Ranges from names and sizes alone; the directories are read by the tasks."""
        at, folder = filesystem(self.uri)
        files = [x for x in at.get_file_info(pafs.FileSelector(folder, allow_not_found=True)) if x.path.endswith(".zip")]
        return [ByteRange(x.path, x.size, a, min(a + self.range, x.size)) for x in sorted(files, key=lambda x: x.path) for a in range(0, x.size, self.range)] or [ByteRange("", 0, 0, 0)]

    def member(self, at: pafs.FileSystem, path: str, info: zipfile.ZipInfo) -> tuple[bytes | None, str | None]:
        """One member by its own offset, with its own attempts."""
        error = None
        for attempt in range(self.attempts):
            try:
                with at.open_input_file(path) as file:
                    return read_member(file, info), None
            except (OSError, ValueError, struct.error) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * attempt)
        return None, error

    def members(self, at: pafs.FileSystem, part: ByteRange) -> tuple[list[zipfile.ZipInfo], str | None]:
        """The members that begin in a range, from the archive's directory, with attempts of its own."""
        error = None
        for attempt in range(self.attempts):
            try:
                with at.open_input_file(part.path) as file, zipfile.ZipFile(file) as archive:
                    return [x for x in archive.infolist() if part.begin <= x.header_offset < part.end], None
            except (OSError, ValueError, struct.error, zipfile.BadZipFile) as e:
                error = f"{type(e).__name__}: {e}"
                time.sleep(0.05 * attempt)
        return [], error

    def read(self, part: ByteRange):
        if not part.path:
            return
        at, _ = filesystem(self.uri)
        names = ["member", "offset", "length", "payload", "error"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.string()]
        rows, held = [], 0
        members, error = self.members(at, part)
        if error:
            if part.begin == 0:  # one row for the archive, whatever the number of its ranges
                yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip((None, None, part.size, None, f"{part.path}: {error}"), kinds, strict=True)], names)
            return
        with at.open_input_file(part.path) as file:
            for info in members:
                try:
                    data, error = read_member(file, info), None
                except (OSError, ValueError, struct.error):
                    data, error = self.member(at, part.path, info)
                rows.append((info.filename, info.header_offset, info.file_size, data, error))
                held += len(data or b"")
                if held >= BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
                    rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def read_member(file, info: zipfile.ZipInfo) -> bytes:
    file.seek(info.header_offset)
    head = file.read(30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError("no member at this offset")
    name, extra = struct.unpack_from("<HH", head, 26)
    file.seek(info.header_offset + 30 + name + extra)
    data = file.read(info.compress_size)
    if info.compress_type != zipfile.ZIP_STORED or len(data) != info.file_size or zlib.crc32(data) != info.CRC:
        raise ValueError("member does not match its checksum")
    return data


class ArchiveSource(DataSource):
    """``spark.read.format("media_archives").load(folder)``: member, offset, length, payload, error."""

    @classmethod
    def name(cls) -> str:
        return "media_archives"

    def schema(self) -> str:
        return "member string, offset long, length long, payload binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def read_archives(spark: SparkSession, uri: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archives").load(uri)


def feature(samples: np.ndarray) -> str:
    """Difference hash of the image: 64 bits, brighter-than-the-next over nine means of eight bands of rows."""
    height, width = samples.shape
    rows = np.add.reduceat(samples.astype(np.int64), np.arange(8) * height // 8 if height >= 8 else np.minimum(np.arange(8), height - 1), axis=0)
    columns = np.add.reduceat(rows, np.arange(9) * width // 9, axis=1) / np.diff(np.r_[np.arange(9) * width // 9, width])
    return np.packbits(columns[:, :-1] > columns[:, 1:]).tobytes().hex()


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def features(media: DataFrame) -> DataFrame:
    """What the stored images hold, a row for each member; a member or archive that can't be read has only its error."""

    def run(batches):
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
        names = [x.split()[0] for x in FEATURES.split(", ")]
        for batch in batches:
            out = []
            for member, data, error in zip(batch.column("member").to_pylist(), batch.column("payload").to_pylist(), batch.column("error").to_pylist(), strict=True):
                doc = (member or "null-").rpartition("-")[0]
                doc = None if doc == "null" else int(doc)
                if data is not None:
                    try:
                        samples = from_image(data)
                    except (ValueError, struct.error, zlib.error) as e:
                        data, error = None, f"{type(e).__name__}: {e}"
                if data is None:
                    out.append((doc, *[None] * 7, error))
                    continue
                payload = samples.tobytes()
                out.append((doc, len(payload.rstrip(b"\xff")), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), feature(samples), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [[]] * 9, kinds, strict=True)], names)

    return in_arrow(media.select("member", "payload", "error"), run, FEATURES)
