"""Helpers shared by the training-data operators: scratch tables, packed blobs, word hashes.

Scratch tables live under ``spark.checkpoint.dir`` (shared by driver and executors), so a lost
executor never loses a stage that was already written.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_LOWER = "abcdefghijklmnopqrstuvwxyz"
#: A word of the contracts: a run of anything but space, tab, LF, VT, FF, CR. ``bytes.split`` uses the same set.
WORD = r"[^\x20\x09-\x0D]+"

_FALLBACK: list[str] = []
_MADE: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where none is set, a temporary one in a single local JVM (tests), an error elsewhere."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if master != "local" and not master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    if not _FALLBACK:
        _FALLBACK.append("file://" + tempfile.mkdtemp(prefix="factloom-"))
    return _FALLBACK[0]


def scratch_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/factloom-{uuid.uuid4().hex[:12]}-{name}"
    _MADE.append((spark, path))
    return path


def table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch = path
    return out


def drop(made_table: DataFrame) -> None:
    """Delete a table made by ``table`` that nothing reads any more."""
    spark, path = made_table.sparkSession, made_table.scratch
    if (spark, path) in _MADE:
        _MADE.remove((spark, path))
    drop_path(spark, path)


def fresh(name: str, *taken: list[str]) -> str:
    """A column name that none of the given column lists holds, whatever the case."""
    held = {c.lower() for columns in taken for c in columns}
    while name.lower() in held:
        name += "_"
    return name


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def release(since: int = 0) -> None:
    """Delete the scratch tables made after the first ``since`` ones; call when their results are written."""
    while len(_MADE) > since:
        spark, path = _MADE.pop()
        try:
            drop_path(spark, path)
        except Exception:  # the session has ended
            pass


def made() -> int:
    return len(_MADE)


def _forget_local() -> None:
    import shutil

    for path in _FALLBACK:
        shutil.rmtree(path.removeprefix("file://"), ignore_errors=True)


atexit.register(_forget_local)
atexit.register(release)


def width(spark: SparkSession) -> int:
    """Partitions of a shuffle, as the session sets them for its data and cluster."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))


def block_place(wide: int) -> Column:
    """Partition of a block (``part << 32 | number``): blocks of neighbouring parts go to neighbouring partitions, so that few
    large blocks spread evenly where hashes would collide."""
    return F.pmod(F.shiftright("block", 32) + F.col("block").bitwiseAND(F.lit(0xFFFFFFFF)) * 31, F.lit(wide)).cast("int")


# -- packed blobs ------------------------------------------------------------------------------


def pack_words(words: list[bytes]) -> bytes:
    """Sorted words share prefixes, so deflate shrinks them well."""
    sizes = np.fromiter(map(len, words), np.uint32, len(words)).tobytes()
    return zlib.compress(np.uint32(len(words)).tobytes() + sizes + b"".join(words), 6)


def unpack_words(blob: bytes) -> list[bytes]:
    raw = zlib.decompress(blob)
    n = int(np.frombuffer(raw, np.uint32, 1)[0])
    ends = np.cumsum(np.frombuffer(raw, np.uint32, n, 4), dtype=np.int64).tolist()
    at, out = 4 + 4 * n, []
    start = 0
    for end in ends:
        out.append(raw[at + start : at + end])
        start = end
    return out


def pack_array(a: np.ndarray) -> bytes:
    return zlib.compress(np.ascontiguousarray(a).tobytes(), 1)


def unpack_array(blob: bytes, kind) -> np.ndarray:
    return np.frombuffer(zlib.decompress(blob), kind)


def pack_uints(a: np.ndarray) -> bytes:
    """Unsigned integers by byte planes; planes of zeros at the top cost nothing."""
    wide = max(1, (int(a.max(initial=0)).bit_length() + 7) // 8)
    planes = np.ascontiguousarray(a.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :wide].T)
    return bytes([wide]) + zlib.compress(planes.tobytes(), 6)


def unpack_uints(blob: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(blob[1:]), np.uint8).reshape(blob[0], -1)
    out = np.zeros(planes.shape[1], np.int64)
    for i, plane in enumerate(planes):
        out |= plane.astype(np.int64) << (8 * i)
    return out


def numbering() -> dict:
    """A dictionary that numbers new keys as they are asked for."""
    numbers: dict = defaultdict()
    numbers.default_factory = numbers.__len__
    return numbers


def by_shard(words: list[bytes], shard: np.ndarray) -> np.ndarray:
    """Places of the words in order of shard and word."""
    order = np.array(sorted(range(len(words)), key=words.__getitem__), np.int64)
    return order[np.argsort(shard[order], kind="stable")]


class WordHash(dict):
    """64-bit hash of a word, remembered for up to ``room`` words."""

    room = 300_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.room:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit (a fixed public bit mixer)."""
    with np.errstate(over="ignore"):
        x = x ^ (x >> np.uint64(30))
        x = x * np.uint64(0xBF58476D1CE4E5B9)
        x = x ^ (x >> np.uint64(27))
        x = x * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


# -- Arrow streams -----------------------------------------------------------------------------


def rows_of(batches: Iterator[pa.RecordBatch], names: list[str]) -> Iterator[tuple]:
    """Rows as tuples, one batch in memory at a time; binary columns stay bytes."""
    for batch in batches:
        yield from zip(*(batch.column(n).to_pylist() for n in names), strict=True)


def groups_of(rows: Iterator[tuple], keys: int) -> Iterator[tuple[tuple, Iterator[tuple]]]:
    """Runs of rows that agree in their first ``keys`` values; the stream is sorted by them."""
    from itertools import groupby

    return groupby(rows, key=lambda r: r[:keys])


def emit(schema: pa.Schema, rows: Iterator[tuple], batch: int = 4096, batch_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of at most ``batch`` rows, ended early when blobs fill ``batch_bytes``."""
    held: list[tuple] = []
    size = 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row if isinstance(v, bytes))
        if len(held) >= batch or size >= batch_bytes:
            yield _batch(schema, held)
            held, size = [], 0
    if held:
        yield _batch(schema, held)


def _batch(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


def map_arrow(df: DataFrame, make: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    return df.mapInArrow(make, schema)
