"""What the corpus operators share: the shared folder, Arrow text access and vectorised word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text bytes that a task works on at a time; temporary arrays take about fifty times as much.
CHUNK_BYTES = 2 << 20

#: Bytes 0x20 and 0x09-0x0D part the words of `[^\x20\x09-\x0D]+`.
WHITE = np.zeros(256, bool)
WHITE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

WORD_PATTERN = r"[^\x20\x09-\x0D]+"

LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder under spark.checkpoint.dir, which driver and executors share.

    Only a local session may lack that setting; it then gets a folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/leakloom/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cut the lineage: write df as a table in the shared folder and read it again."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of doc_id as text, modulo folds; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def text_parts(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of runs of rows with up to limit bytes of text, or one row with more; null is empty."""
    values = batch.column(batch.schema.get_field_index(column))
    if values.null_count:
        values = values.fill_null("")
    buffers, wide = values.buffers(), pa.types.is_large_string(values.type)
    offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, count=len(values) + 1 + values.offset)[values.offset :].astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(values):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def word_spans(data: np.ndarray, offsets: np.ndarray, separator: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word in the bytes of several texts; a word never spans two texts."""
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none, none, none
    gap = separator[data]
    before = np.empty(n, bool)
    before[0], before[1:] = True, gap[:-1]
    before[offsets[:-1][offsets[:-1] < n]] = True
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, gap[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    word = ~gap
    starts = np.flatnonzero(word & before)
    rows = np.searchsorted(offsets, starts, "right") - 1
    return starts, np.flatnonzero(word & after) + 1, rows


#: An odd multiplier, so that it has an inverse modulo 2**64.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES)
        _powers[:] = [np.cumprod(np.concatenate(([np.uint64(1)], np.full(size - 1, x, np.uint64)))) for x in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers whose output bits all depend on all input bits."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word with A-Z lower-cased: a polynomial of its bytes, by differences of one running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    powers, inverses = _power_tables(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((LOWER[data].astype(np.uint64) + np.uint64(1)) * powers, out=total[1:])
    return mix((total[ends] - total[starts]) * inverses[starts] + (ends - starts).astype(np.uint64))
