"""Shared helpers: stored intermediate tables, bounded samples, array plumbing."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cloakframe.session import checkpoint_dir, remove


def stored(df: DataFrame, codec: str = "zstd") -> DataFrame:
    """Write ``df`` once into the shared checkpoint folder and read it back.

    The copy outlives lost executors, and every consumer reads the same rows.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/llm-{uuid.uuid4().hex}"
    df.write.option("compression", codec).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Remove tables of :func:`stored` that nothing reads any more: what was made of them is stored itself."""
    for df in tables:
        remove(df.sparkSession, df.stored_path)


@contextmanager
def small_batches(spark: SparkSession, rows: int):
    """Inside, at most so many rows go to Python at a time: for tables whose rows are large."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(key: Column | str, parts: int) -> Column:
    """crc32 of the key as text, modulo ``parts``; a null key counts as an empty text."""
    key = F.col(key) if isinstance(key, str) else key
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % parts


def labelled_ids(labels: DataFrame, label: str, most: int) -> DataFrame:
    """(doc_id, y): a fixed pseudo-random sample of at most ``most`` labelled rows per class.

    Rows with crc32(doc_id) mod 5 = 0 are held out.  Rows without id or label
    are left aside; a document labelled twice counts once, with its highest label.
    """
    rows = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", 5) != 0))
        .groupBy("doc_id").agg(F.max("y").alias("y"))
    )
    order = [F.xxhash64(F.col("doc_id").cast("string"), F.lit(label)), F.col("doc_id")]
    return rows.where("y = 1").orderBy(*order).limit(most).unionByName(rows.where("y = 0").orderBy(*order).limit(most))


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """A contiguous plain string array, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and row offsets (starting at 0) of a plain string array."""
    if not len(texts):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    body = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return body[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int = 12 << 20):
    """(first row, end row) of runs of whole texts of about ``most`` bytes; a longer text runs alone."""
    if not len(texts):
        return
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    lo = 0
    while lo < len(texts):
        hi = int(np.searchsorted(offsets, int(offsets[lo]) + most, side="right")) - 1
        hi = min(max(hi, lo + 1), len(texts))
        yield lo, hi
        lo = hi


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words_of(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """All words ([^ tab..return]+) of plain texts in order, and the number of the first word of every text (and one past the last).

    ``lower`` turns A-Z into a-z; other letters stay.
    """
    body, offsets = raw(texts)
    keep = ~((body == 32) | ((body >= 9) & (body <= 13)))
    first = keep.copy()
    first[1:] &= ~keep[:-1]
    begins = offsets[:-1][offsets[:-1] < len(body)]
    first[begins] = keep[begins]
    before = np.concatenate([[0], np.cumsum(first)])
    rest = body[keep]
    if lower:
        rest = _LOWER[rest]
    starts = np.append(np.flatnonzero(first[keep]), len(rest)).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts) - 1, pa.py_buffer(starts), pa.py_buffer(np.ascontiguousarray(rest)))
    return words, before[offsets]


def hash64(words: pa.Array) -> np.ndarray:
    """64-bit hash of every string of an array (meant for distinct ones)."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.to_pylist()), np.uint64, len(words))
