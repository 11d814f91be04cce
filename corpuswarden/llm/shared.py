"""What the operators share: the shared folder, tables written in it, and array stores that workers map.

Everything an operator keeps between jobs goes to ``spark.checkpoint.dir``, the one folder that all
executors and the driver see. A folder of its own is made only where that setting is missing and all runs in
one process on this machine (tests).

Stages in Python go through ``in_arrow``: batches of a bounded number of bytes, and at the end of each task the
worker gives back what it holds, so that no stage pays for the one before it.
"""

from __future__ import annotations

import atexit
import ctypes
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession

_own_root: list[str] = []
#: Most bytes of an Arrow batch that a Python stage is given; a larger row comes alone.
BATCH_BYTES = 8 << 20
_UNITS = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40, "p": 1 << 50}
_LIMIT = "spark.sql.execution.arrow.maxBytesPerBatch"


def shared_dir(spark: SparkSession, name: str) -> str:
    """URI of a new, empty folder below ``spark.checkpoint.dir``."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is not set: executors and the driver need a folder that all of them see")
        if not _own_root:
            _own_root.append("file://" + tempfile.mkdtemp(prefix="spark-shared-"))
        root = _own_root[0]
    if "://" not in root and not root.startswith("file:"):
        root = "file://" + os.path.abspath(root)
    elif root.startswith("file:/") and not root.startswith("file://"):
        root = "file://" + root[len("file:") :]
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """The rows written once as Parquet in the shared folder and read again: a cut in the lineage."""
    spark, path = df.sparkSession, shared_dir(df.sparkSession, name)
    schema = df.schema
    df.write.parquet(path)
    table = spark.read.schema(schema).parquet(path)
    table._kept_at = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete the files of tables made by ``kept`` that nothing reads any more."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._kept_at)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh(taken: list[str], *names: str) -> list[str]:
    """Column names for the operator's own use that the input does not have."""
    have, out = {t.lower() for t in taken}, []
    for name in names:
        while name.lower() in have:
            name += "_"
        have.add(name.lower())
        out.append(name)
    return out


def released() -> None:
    """Give unused memory of this worker back to the machine."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):
        pass  # another C library


def in_bytes(setting: str) -> int:
    """Bytes of a setting such as 64m or 1g; without a unit, of bytes."""
    text = str(setting).strip().lower().removesuffix("b")
    unit = text[-1:] if text[-1:] in _UNITS else ""
    return int(float(text.removesuffix(unit) or 0) * _UNITS.get(unit, 1))


def in_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with batches of ``BATCH_BYTES`` at most and memory released at the end of each task."""
    conf = df.sparkSession.conf
    if not 0 < in_bytes(conf.get(_LIMIT)) <= BATCH_BYTES:
        conf.set(_LIMIT, str(BATCH_BYTES))

    names = df.columns
    if any(c in "".join(names) for c in ".`"):  # Spark would take such a name for a field of a column
        df = df.toDF(*[f"c{k}" for k in range(len(names))])

    def tidy(batches):
        try:
            yield from run(b.rename_columns(names) for b in batches)
        finally:
            released()

    return df.mapInArrow(tidy, schema)


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


def put_bytes(uri: str, parts: list[bytes | memoryview]) -> None:
    """Write a file whole or not at all; a repeated task writes the same bytes over it."""
    at, path = filesystem(uri)
    at.create_dir(path.rpartition("/")[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    with at.open_output_stream(draft) as out:
        for part in parts:
            out.write(part)
    at.move(draft, path)


@functools.cache
def _local_copy(uri: str) -> str:
    """Path of a file on this machine: the file itself if the store is mounted, else one copy for each worker.

    The copy goes when the worker ends.
    """
    at, path = filesystem(uri)
    if isinstance(at, pafs.LocalFileSystem):
        return path
    folder = tempfile.mkdtemp(prefix="arrays-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    own = os.path.join(folder, path.rpartition("/")[2])
    pafs.copy_files(path, own, source_filesystem=at, destination_filesystem=pafs.LocalFileSystem())
    return own


def put_arrays(uri: str, arrays: dict[str, np.ndarray]) -> None:
    """Arrays one after another, each at a multiple of 64 bytes, behind a header of names, types and places."""
    head, at, parts = [], 0, []
    for name, x in arrays.items():
        x = np.ascontiguousarray(x)
        head.append(f"{name} {x.dtype.str} {len(x)} {at}")
        parts += [memoryview(x).cast("B") if x.nbytes else b"", b"\0" * (-x.nbytes % 64)]
        at += x.nbytes + -x.nbytes % 64
    top = "\n".join(head).encode()
    size = 64 * ((len(top) + 16) // 64 + 1)
    put_bytes(uri, [f"{size:08d}".encode() + top.ljust(size - 8, b"\n"), *parts])


def map_arrays(uri: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory and not read."""
    raw = np.memmap(_local_copy(uri), dtype=np.uint8, mode="r")
    size = int(bytes(raw[:8]))
    out = {}
    for line in bytes(raw[8:size]).decode().split("\n"):
        if line:
            name, kind, n, at = line.split()
            kind, n, at = np.dtype(kind), int(n), size + int(at)
            out[name] = raw[at : at + n * kind.itemsize].view(kind)
    return out


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts one after another, and where each begins (n + 1 places); null: empty."""
    column = column.cast(pa.large_binary()).fill_null(b"")
    n = len(column)
    _, places, data = column.buffers()
    starts = np.frombuffer(places, dtype=np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[starts[0] : starts[-1]], starts - starts[0]


def slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Parts of a batch with about ``most`` bytes of text each; a longer text comes alone."""
    _, starts = utf8(batch.column(column))
    at = 0
    while at < batch.num_rows:
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, "right")) - 1)
        yield batch.slice(at, end - at)
        at = end
