"""Helpers shared by the operators: reading tables, Arrow batches as numpy
arrays, word positions and rolling fingerprints, and bucketed text tables."""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recframe.session import checkpoint_dir

#: Rows in one Arrow batch; with texts of a few KB a batch stays at a few MB.
BATCH_ROWS = 1000
#: Bytes in one Arrow batch (or one row), whatever the length of its texts.
BATCH_BYTES = 2 << 20
#: Text bytes handled at once by the numpy passes of one task.
BLOCK_BYTES = 512 << 10

_U = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Bound the Arrow batches that Python tasks receive, in rows and bytes, for
    what is written inside; the session's own settings hold again afterwards."""
    mine = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(BATCH_ROWS), "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES)}
    before = {k: spark.conf.get(k, None) for k in mine}
    try:
        for k, v in mine.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def written_small(df: DataFrame) -> DataFrame:
    """``written`` with small Arrow batches."""
    with small_batches(df.sparkSession):
        return written(df)


_trimmed: int | None = None


def hand_back(done: bool = False) -> None:
    """Return unused memory, once as a task begins and where its work is ``done``:
    Spark keeps Python workers for later tasks, with all that they hold."""
    global _trimmed
    pa.default_memory_pool().release_unused()
    context = TaskContext.get()
    task = context.taskAttemptId() if context else None
    if done or task is None or task != _trimmed:
        _trimmed = task
        with suppress(OSError, AttributeError):  # glibc only
            ctypes.CDLL("libc.so.6").malloc_trim(0)


def frugal(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for ``mapInArrow``, handing unused memory back as it goes."""
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hand_back()
        for out in run(batches):
            yield out
            del out
            pa.default_memory_pool().release_unused()
        hand_back(done=True)
    return task


def frugal_group(run: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """The same for ``applyInArrow``."""
    def task(part: pa.Table) -> pa.Table:
        hand_back()
        out = run(part)
        hand_back(done=True)
        return out
    return task


def frugal_cogroup(run: Callable[[pa.Table, pa.Table], pa.Table]) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """The same for ``applyInArrow`` of two tables."""
    def task(left: pa.Table, right: pa.Table) -> pa.Table:
        hand_back()
        out = run(left, right)
        hand_back(done=True)
        return out
    return task


def text_bytes(col: str = "text") -> Column:
    """UTF-8 bytes of a text column; null counts as empty."""
    return F.coalesce(F.col(col), F.lit("")).cast("binary")


def row_key() -> Column:
    """Key that tells documents apart: rows that agree in it are repeated rows."""
    return F.xxhash64(F.col("doc_id"), F.col("text"))


def id_or_least(col: str = "doc_id") -> Column:
    """doc_id for ordering; null stands before every other id."""
    return F.coalesce(F.col(col).cast("long"), F.lit(-(1 << 63)))


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared checkpoint folder, read back: cuts
    the lineage, and the planner knows its size."""
    path = f"{checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def total_bytes(docs: DataFrame) -> int:
    got = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()
    return int(got["b"] or 0)


def buckets_for(n_bytes: int, bucket_bytes: int = 2 << 20) -> int:
    """How many buckets keep one bucket at about ``bucket_bytes`` of text."""
    return max(1, -(-n_bytes // bucket_bytes))


# ---------------------------------------------------------------- Arrow to numpy
def flat(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all rows, offsets) of a binary column; null rows are empty."""
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks) if col.num_chunks else pa.array([], pa.binary())
    if col.null_count:
        col = col.fill_null(b"")
    wide = pa.types.is_large_binary(col.type) or pa.types.is_large_string(col.type)
    kind = np.int64 if wide else np.int32
    bufs = col.buffers()
    if len(col) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offs = np.frombuffer(bufs[1], kind)[col.offset:col.offset + len(col) + 1].astype(np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
    return data[offs[0]:offs[-1]], offs - offs[0]


def blocks(batch: pa.RecordBatch, column: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into slices of at most ``limit`` text bytes (or one row)."""
    for start, stop in slices(flat(batch.column(column))[1], limit):
        yield batch.slice(start, stop - start)


def slices(offs: np.ndarray, limit: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive rows of at most ``limit`` bytes (or one row)."""
    start, n = 0, len(offs) - 1
    while start < n:
        stop = int(np.searchsorted(offs, offs[start] + limit, side="right")) - 1
        stop = min(max(stop, start + 1), n)
        yield start, stop
        start = stop


# ------------------------------------------------------------------------- words
def _classes(separators: list[tuple[int, int]]) -> np.ndarray:
    word = np.ones(256, bool)
    for lo, hi in separators:
        word[lo:hi + 1] = False
    return word


#: Bytes inside words once A-Z is lower-cased: [^\x00-\x2F\x3A-\x60\x7B-\x7F]
ALNUM_WORD = _classes([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: Bytes inside words cut at ASCII white space: [^\x20\x09-\x0D]
SPACE_WORD = _classes([(0x20, 0x20), (0x09, 0x0D)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20
#: For bytes.translate: lower-case A-Z and turn every separator into a space.
ALNUM_TABLE = bytes(int(LOWER[i]) if ALNUM_WORD[LOWER[i]] else 0x20 for i in range(256))


def alnum_words(text: bytes) -> list[bytes]:
    return text.translate(ALNUM_TABLE).split()


def word_spans(data: np.ndarray, offs: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start byte, end byte, row) of every word; words end at row borders."""
    inside = word[data]
    prev = np.empty(len(data), bool)
    nxt = np.empty(len(data), bool)
    if len(data):
        prev[0] = nxt[-1] = False
        prev[1:], nxt[:-1] = inside[:-1], inside[1:]
        borders = offs[1:-1]
        borders = borders[(borders > 0) & (borders < len(data))]
        prev[borders] = False
        nxt[borders - 1] = False
    starts = np.flatnonzero(inside & ~prev)
    ends = np.flatnonzero(inside & ~nxt) + 1
    rows = np.searchsorted(offs, starts, side="right") - 1
    return starts, ends, rows


# ------------------------------------------------------------------ fingerprints
def _power_tables(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    inv = pow(base, -1, 1 << 64)
    up = np.full(n + 1, base, _U)
    down = np.full(n + 1, inv, _U)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=_U), np.cumprod(down, dtype=_U)


class Roller:
    """Polynomial fingerprints mod 2**64 of any interval of a sequence: one
    prefix sum, then (P[end] - P[start]) * base**-start, then a bit mixer.

    The value depends only on the elements of the interval, so equal intervals
    have equal fingerprints on every partition."""

    def __init__(self, base: int):
        self.base, self.up, self.down = base, np.zeros(0, _U), np.zeros(0, _U)

    def prefix(self, values: np.ndarray) -> np.ndarray:
        n = len(values)
        if len(self.up) < n + 1:
            self.up, self.down = _power_tables(self.base, max(n, 1 << 16))
        out = np.zeros(n + 1, _U)
        np.cumsum(values * self.up[:n], dtype=_U, out=out[1:])
        return out

    def spans(self, prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((prefix[ends] - prefix[starts]) * self.down[starts])


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit over the word."""
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    x = x ^ (x >> _U(32))
    x = x * _U(0xD6E8FEB86659FD93)
    return x ^ (x >> _U(32))


def byte_values(seed: int) -> np.ndarray:
    """A random 64-bit value for each byte."""
    return mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


_BYTES = byte_values(11)
_BYTE_ROLL, _WORD_ROLL = Roller(0x9E3779B97F4A7C15 | 1), Roller(0xC2B2AE3D27D4EB4F | 1)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit fingerprint of the bytes of each span."""
    return _BYTE_ROLL.spans(_BYTE_ROLL.prefix(_BYTES[data]), starts, ends)


def window_hashes(values: np.ndarray, starts: np.ndarray, width: int | np.ndarray, roll: Roller = _WORD_ROLL) -> np.ndarray:
    """64-bit fingerprint of ``width`` consecutive values from each start."""
    return roll.spans(roll.prefix(values), starts, starts + width)


def signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def merge_intervals(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of half-open intervals as sorted, disjoint, non-touching ones."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], np.maximum.accumulate(ends[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    heads = np.flatnonzero(new)
    return s[heads], e[np.append(heads[1:], len(s)) - 1]


# -------------------------------------------------------------- packed exchanges
def pack(keys: np.ndarray, n_parts: int, *more: np.ndarray) -> Iterator[tuple[int, list[bytes]]]:
    """Split equal-length arrays by the range of ``keys`` (uint64): (part, the
    slice of each array as bytes).  One row of an exchange then carries many keys."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    part = part_of(keys, n_parts)
    heads = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
    cols = [keys, *(m[order] for m in more)]
    for lo, hi in zip(heads, np.append(heads[1:], len(keys)), strict=True):
        yield int(part[lo]), [c[lo:hi].tobytes() for c in cols]


def part_of(keys: np.ndarray, n_parts: int) -> np.ndarray:
    """Range part of uniformly spread 64-bit keys."""
    return ((keys >> _U(32)) * _U(n_parts) >> _U(32)).astype(np.int64)


def unpack(values: list[bytes], kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(all elements, index of the row each came from)."""
    size = np.dtype(kind).itemsize
    lens = np.array([len(v) // size for v in values], np.int64)
    return np.frombuffer(b"".join(values), kind), np.repeat(np.arange(len(values)), lens)


def shared_keys(packed: DataFrame) -> DataFrame:
    """Exchange of keys: of rows (part, bucket, keys, many), which keys occur in
    two buckets or are marked as occurring more than once in one.  Returns them
    to each bucket that has them: (bucket, keys).

    Within a bucket keys are distinct, so a key has one entry a bucket at most,
    however frequent it is."""
    def run(part: pa.Table) -> pa.Table:
        keys, row = unpack(part.column("keys").to_pylist(), _U)
        many, _ = unpack(part.column("many").to_pylist(), np.bool_)
        order = np.argsort(keys, kind="stable")
        keys, row, many = keys[order], row[order], many[order]
        heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.zeros(0, np.int64)
        size = np.diff(np.append(heads, len(keys)))
        keep = np.repeat((size > 1) | np.maximum.reduceat(many, heads), size) if len(keys) else np.zeros(0, bool)
        keys, row = keys[keep], row[keep]
        order = np.argsort(row, kind="stable")
        keys, row = keys[order], row[order]
        heads = np.flatnonzero(np.append(True, row[1:] != row[:-1])) if len(row) else np.zeros(0, np.int64)
        bucket = part.column("bucket").to_numpy()
        return pa.Table.from_arrays(
            [pa.array(bucket[row[heads]], pa.int32()), pa.array([keys[lo:hi].tobytes() for lo, hi in zip(heads, np.append(heads[1:], len(keys)), strict=False)], pa.binary())],
            ["bucket", "keys"])

    return packed.groupBy("part").applyInArrow(frugal_group(run), "bucket int, keys binary")


PACKED = "part int, bucket int, keys binary, many binary"


def packed_table(bucket: int, keys: np.ndarray, n_parts: int) -> pa.Table:
    """Rows for ``shared_keys`` from all (repeating) keys of one bucket.

    Keys that are least ones of many (minimizers) crowd at the low end, so the
    parts are ranges of the mixed keys."""
    values, counts = np.unique(keys, return_counts=True)
    rows = list(pack(mix(values), n_parts, values, counts > 1))
    return pa.Table.from_arrays(
        [pa.array([p for p, _ in rows], pa.int32()), pa.array([bucket] * len(rows), pa.int32()),
         pa.array([c[1] for _, c in rows], pa.binary()), pa.array([c[2] for _, c in rows], pa.binary())],
        ["part", "bucket", "keys", "many"])


def has_key(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of ``keys`` are in the sorted array ``wanted``."""
    if not len(wanted):
        return np.zeros(len(keys), bool)
    return wanted[np.minimum(np.searchsorted(wanted, keys), len(wanted) - 1)] == keys
