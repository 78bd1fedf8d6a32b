"""Plumbing shared by the operators: tables, durable cuts of lineage, text chunks and packed arrays.

Intermediate tables go to the folder that ``spark.checkpoint.dir`` names (shared by all machines),
so that a lost executor costs a re-read and not a re-computation of everything before it.
"""

from __future__ import annotations

import contextlib
import struct
import tempfile
import uuid
from collections.abc import Iterator
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame, SparkSession

#: Bytes of text that a task works on at once.
CHUNK_BYTES = 2 << 20
#: Lists that take the paths which ``settle`` writes.
_recorders: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; only where none is set in local mode (tests), one of our own. A cluster
    without the setting is an error, as its machines share no folder of their own."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        root = spark.conf.get("spark.leafworks.scratch", None)
        if not root and not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        if not root:
            root = f"file://{tempfile.mkdtemp(prefix='leafworks-')}"
            spark.conf.set("spark.leafworks.scratch", root)
    return root.rstrip("/")


def settle(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: a durable cut of its lineage."""
    spark = df.sparkSession
    path = f"{shared_root(spark)}/leafworks/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for paths in _recorders:
        paths.append(path)
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return spark.read.schema(df.schema).parquet(path)


def width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_bytes(column: pa.Array) -> list[bytes]:
    """Texts as UTF-8; a null is an empty text."""
    return [b"" if x is None else x for x in column.cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], column: str, most: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Record batches cut so that ``column`` holds about ``most`` bytes in each; no row is divided."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes, dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            before = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(at, to - at)
            at = to


def squeeze(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(array).tobytes())


def unsqueeze(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), dtype=kind)


def deltas(ascending: np.ndarray) -> bytes:
    """A non-descending array of unsigned 32-bit numbers, small."""
    return squeeze(np.diff(ascending.astype(np.uint32), prepend=np.uint32(0)))


def undeltas(blob: bytes) -> np.ndarray:
    return np.cumsum(unsqueeze(blob, np.uint32), dtype=np.int64)


def low_bytes(array: np.ndarray, n: int) -> bytes:
    """The low ``n`` bytes of unsigned 64-bit numbers."""
    return array.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def from_low_bytes(blob: bytes, n: int) -> np.ndarray:
    out = np.zeros((len(blob) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(blob, np.uint8).reshape(-1, n)
    return out.view("<u8").ravel()


def pack_texts(texts: list[bytes]) -> bytes:
    lengths = np.array([len(x) for x in texts], dtype=np.uint32)
    raw = struct.pack("<I", len(texts)) + lengths.tobytes() + b"".join(texts)
    return zstandard.ZstdCompressor(level=5).compress(raw)


def unpack_texts(blob: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    (n,) = struct.unpack_from("<I", raw)
    ends = 4 + 4 * n + np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64)
    starts = np.concatenate(([4 + 4 * n], ends[:-1])) if n else ends
    return [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist())]


@contextlib.contextmanager
def recorded() -> Iterator[list[str]]:
    """The paths that are settled meanwhile."""
    paths: list[str] = []
    _recorders.append(paths)
    try:
        yield paths
    finally:
        _recorders.remove(paths)


def drop(spark: SparkSession, paths: list[str], reading: DataFrame | None = None) -> list[str]:
    """Delete settled tables, but for those that ``reading`` comes from; returns what stays."""
    held = [unquote(f) for f in reading.inputFiles()] if reading is not None else []
    stays = [p for p in paths if any(p.split("://")[-1].lstrip("/") in f for f in held)]
    for path in set(paths) - set(stays):
        hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
    return stays
