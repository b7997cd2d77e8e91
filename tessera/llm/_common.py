"""Helpers shared by the corpus operators: shared folders, tables, and vectorised word scanning."""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than space, tab, line feed, vertical tab, form feed and carriage return.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Bytes of text that the vectorised scanners take at once; a longer document is taken whole.
CHUNK_BYTES = 2 << 20
#: Rows that a task of a round writes at least, and tasks that a round has whatever its rows.
ROUND_ROWS, ROUND_TASKS = 16_384, 8

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share. Where none is named, a local session gets one of its own; a cluster must name one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    current = spark.sparkContext._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    own = "file://" + tempfile.mkdtemp(prefix="tessera-shared-")
    spark.sparkContext.setCheckpointDir(own)
    return own


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage through reliable storage in the shared folder."""
    shared_dir(df.sparkSession)
    if df.sparkSession.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        df.sparkSession.sparkContext.setCheckpointDir(shared_dir(df.sparkSession))
    return df.checkpoint()


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df does not have, whatever the case of its letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def columns(df: DataFrame) -> list[Column]:
    """All columns of df, whatever is in their names."""
    return [_named(c) for c in df.columns]


def _named(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def carried(df: DataFrame, *own: str) -> DataFrame:
    """(own.., carried): the columns that an operator works with, and all others in one struct, where their names meet none of the operator's."""
    others = [_named(c) for c in df.columns if c not in own]
    return df.select(*own, F.struct(*others or [F.lit(True).alias("none")]).alias("carried"))


def restored(df: DataFrame, names: list[str], *own: str) -> list[Column]:
    """The columns of these names and in this order, of a table that came from `carried`."""
    return [F.col(c) if c in own else F.col("carried").getField(c).alias(c) for c in names]


def new_folder(spark: SparkSession, kind: str) -> str:
    return f"{shared_dir(spark)}/{kind}-{uuid.uuid4().hex}"


def few(df: DataFrame, rows: int) -> DataFrame:
    """df, of about so many rows at most, in no more partitions than they fill, so that rounds write files and run tasks by their rows and not by the number of shuffle partitions.

    It belongs where a shuffle or a write follows anyway, as it hides how rows are dealt: each task costs the driver its launch, its result and
    its metrics, and a round has some ten stages.
    Each file that an executor writes to a local folder costs it child processes (Hadoop sets permissions by chmod where it has no native library), which share
    its memory until they run and are then counted with it.
    """
    return df.coalesce(max(ROUND_TASKS, math.ceil(rows / ROUND_ROWS)))


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through a table in the shared folder. Unlike a checkpoint's, its plan carries no constraints, which rounds of joins would multiply."""
    path = new_folder(df.sparkSession, "round")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (murmur3's constants)."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    size = 1 << max(16, (n + 1).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
        up[0] = down[0] = 1
        _powers[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _powers[size]


def text_chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split an Arrow string column into (first row, end row, UTF-8 bytes, row offsets) of bounded size; null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + size, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """64-bit codes of the whitespace-separated words of a chunk, and the row of each.

    A code is a polynomial of the word's bytes modulo 2**64, finalised together with its length. Two given
    words agree with probability of about 2**-60; whoever needs more compares the words behind equal codes.
    lower: A-Z count as a-z.
    """
    n = len(data)
    if not n:
        return np.zeros(0, U64), np.zeros(0, np.int64)
    solid = ~((data == 32) | ((data - np.uint8(9)) <= 4))
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner] = False
    starts = np.flatnonzero(solid & ~before)
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    after[inner - 1] = False
    ends = np.flatnonzero(solid & ~after) + 1
    if lower:
        data = np.where((data >= 65) & (data <= 90), data | np.uint8(32), data)
    up, down = _power_tables(n)
    total = np.zeros(n + 1, U64)
    np.cumsum((data.astype(U64) + U64(1)) * up[:n], out=total[1:])
    codes = (total[ends] - total[starts]) * down[starts]
    codes = mix64(codes + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))
    rows = np.searchsorted(offsets, starts, "right") - 1
    return codes, rows


def span_codes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit codes, never 0, of the given spans of bytes. Spans that share a code under one seed are apart under another, but for a chance of about 2**-60."""
    values = mix64(np.arange(1, 257, dtype=U64) * U64(_BASE) + U64(seed * 0xD6E8FEB86659FD93 % (1 << 64)))
    up, down = _power_tables(len(data))
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(values[data] * up[: len(data)], out=total[1:])
    codes = mix64((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
    return np.where(codes == 0, U64(1), codes)


def gram_hashes(codes: np.ndarray, k: int) -> np.ndarray:
    """Codes of every k consecutive words; entries that cross into another row are for the caller to mask."""
    n = len(codes) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    out = np.zeros(n, U64)
    for j in range(k):
        out = out * U64(_BASE) + codes[j : j + n]
    return mix64(out)


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window of the given width, by doubling."""
    done, reach = x, 1
    while reach * 2 <= width:
        done, reach = np.minimum(done[: len(done) - reach], done[reach:]), reach * 2
    if reach < width:
        gap = width - reach
        done = np.minimum(done[: len(done) - gap], done[gap:])
    return done


def batch_of(schema: pa.Schema, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def spread(counts: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of the runs of the given lengths, end to end."""
    counts = np.asarray(counts, np.int64)
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)
