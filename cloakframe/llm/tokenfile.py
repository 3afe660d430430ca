"""Token-id output: frequency ranks in a byte-aligned variable-length code with separate control bytes.

Ids are replaced by their rank of frequency in the corpus, so frequent ids take
one byte.  Four ranks share a control byte (two bits each: bytes - 1); control
and data bytes are kept apart, which lets numpy decode a whole block by table
lookup.  Blocks of whole documents stand in ascending doc_id order in files that
Spark writes and commits; the ranked ids lie beside them as a table.

Defined cases: a null or empty text has only its end id.  Rows without doc_id
come first.  Rows with the same doc_id stand in order of their ids.  An empty
table gives files without blocks and no rows.  Other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from cloakframe.llm.common import stored
from cloakframe.llm.tokens import encoder
from cloakframe.session import checkpoint_dir

BLOCK_IDS = 1 << 18
BLOCKS = "shard int, block int, n_ids long, control binary, data binary, docs binary, has_id binary, lengths binary"
_BLOCKS = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("n_ids", pa.int64()), ("control", pa.binary()), ("data", pa.binary()),
    ("docs", pa.binary()), ("has_id", pa.binary()), ("lengths", pa.binary()),
])
#: For each control byte: the byte lengths of its four values.
_LENGTHS = ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3).astype(np.uint8) + 1


def encode_values(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values."""
    values = np.ascontiguousarray(values, np.uint32)
    extra = (values > 0xFF).astype(np.uint8) + (values > 0xFFFF) + (values > 0xFFFFFF)
    code = np.zeros(-(-len(values) // 4) * 4, np.uint8)
    code[: len(values)] = extra
    code = code.reshape(-1, 4)
    control = code[:, 0] | (code[:, 1] << 2) | (code[:, 2] << 4) | (code[:, 3] << 6)
    parts = values.astype("<u4").view(np.uint8).reshape(-1, 4)
    return control.tobytes(), parts[np.arange(4) <= extra[:, None]].tobytes()


def decode_values(control: bytes, data: bytes, n: int) -> np.ndarray:
    """Inverse of encode_values, for ``n`` values."""
    lens = _LENGTHS[np.frombuffer(control, np.uint8)].reshape(-1)[:n]
    body = np.concatenate([np.frombuffer(data, np.uint8), np.zeros(3, np.uint8)])
    at = np.cumsum(lens, dtype=np.int32) - lens
    out = body[at].astype(np.uint32)
    for k in (1, 2, 3):
        more = np.flatnonzero(lens > k)
        if len(more):
            out[more] |= body[at[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def _tokenize(path: str, end_id: int, lower: bool):
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def run(batches):
        code = encoder(path, lower)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            docs = batch.column("doc_id")
            for lo, hi, ids, at in code.encode(batch.column("text")):
                out = [encode_row(np.concatenate([ids[at[k] : at[k + 1]], end])) for k in range(hi - lo)]
                yield pa.RecordBatch.from_arrays([docs.slice(lo, hi - lo), pa.array(out, pa.binary())], schema=schema)

    return run


def encode_row(ids: np.ndarray) -> bytes:
    """Ids of one document on the way to its file: 16 bits each where they fit, compressed."""
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    body = ids.astype("<u4" if wide else "<u2").tobytes()
    return (b"4" if wide else b"2") + len(body).to_bytes(8, "little") + bytes(pa.compress(body, "zstd", asbytes=True))


def decode_row(row: bytes) -> np.ndarray:
    body = pa.decompress(row[9:], int.from_bytes(row[1:9], "little"), "zstd", asbytes=True)
    return np.frombuffer(body, "<u4" if row[:1] == b"4" else "<u2").astype(np.uint32)


def _count(batches):
    total = np.zeros(0, np.int64)
    for batch in batches:
        for row in batch.column("ids"):
            part = np.bincount(decode_row(row.as_py()))
            if len(part) > len(total):
                part, total = total, part
            total[: len(part)] += part
    used = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["id", "n"])


def _write_blocks(ranked: np.ndarray):
    def run(batches):
        rank = np.zeros(int(ranked.max()) + 1 if len(ranked) else 1, np.uint32)
        rank[ranked] = np.arange(len(ranked), dtype=np.uint32)
        shard, block = TaskContext.get().partitionId(), 0
        docs, has, rows, n = [], [], [], 0

        def out():
            ids = np.concatenate(rows)
            control, data = encode_values(rank[ids])
            lens, wide = encode_values(np.array([len(r) for r in rows])), np.array(docs, "<i8").tobytes()
            cells = [shard, block, len(ids), control, data, wide, np.array(has, np.uint8).tobytes(), len(lens[0]).to_bytes(8, "little") + lens[0] + lens[1]]
            return pa.RecordBatch.from_arrays([pa.array([c], f.type) for c, f in zip(cells, _BLOCKS, strict=True)], schema=_BLOCKS)

        for batch in batches:
            for doc, row in zip(batch.column("doc_id").to_pylist(), batch.column("ids"), strict=True):
                rows.append(decode_row(row.as_py()))
                docs.append(doc or 0)
                has.append(doc is not None)
                n += len(rows[-1])
                if n >= BLOCK_IDS:
                    yield out()
                    docs, has, rows, n, block = [], [], [], 0, block + 1
        if rows:
            yield out()

    return run


def write_token_files(docs: DataFrame, folder: str, path: str, end_id: int = 2, lower: bool = True) -> None:
    """Tokenize all documents and write ``folder``/blocks and ``folder``/vocabulary.

    One scan tokenizes; ids are counted per task and summed, so at most one row
    per vocabulary entry comes to the driver; one range shuffle of compressed
    ids brings the documents into order.  ``lower``: the vocabulary lower-cases.
    """
    ids = stored(docs.select("doc_id", "text").mapInArrow(_tokenize(path, end_id, lower), "doc_id long, ids binary"), "none")
    counts = ids.select("ids").mapInArrow(_count, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toPandas()
    counts = counts.sort_values(["n", "id"], ascending=[False, True], ignore_index=True)
    ranked = counts["id"].to_numpy(np.int64)
    spark = docs.sparkSession
    spark.createDataFrame(counts.assign(rank=range(len(counts))), "id long, n long, rank long").coalesce(1).write.parquet(f"{folder}/vocabulary")
    ordered = ids.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "ids")
    ordered.mapInArrow(_write_blocks(ranked), BLOCKS).write.option("compression", "none").parquet(f"{folder}/blocks")


def _read_blocks(ranked: np.ndarray):
    def run(batches):
        for batch in batches:
            for r in batch.to_pylist():
                ids = ranked[decode_values(r["control"], r["data"], r["n_ids"])].astype(np.uint32)
                docs, has = np.frombuffer(r["docs"], "<i8"), np.frombuffer(r["has_id"], np.uint8) == 0
                k = int.from_bytes(r["lengths"][:8], "little")
                lens = decode_values(r["lengths"][8 : 8 + k], r["lengths"][8 + k :], len(docs))
                ends = np.concatenate([[0], np.cumsum(lens, dtype=np.int64)])
                yield r["shard"], r["block"], pa.array(docs, mask=has), ends, ids

    return run


def _checksums(ranked: np.ndarray):
    def run(batches):
        for shard, block, docs, ends, ids in _read_blocks(ranked)(batches):
            n, body = len(docs), ids.astype("<u4")
            crc = [zlib.crc32(body[ends[k] : ends[k + 1]]) for k in range(n)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([shard] * n, pa.int32()), pa.array([block] * n, pa.int32()), docs, pa.array(ends[:-1]), pa.array(np.diff(ends)), pa.array(crc, pa.int64())],
                names=["shard", "block", "doc_id", "at", "n_tokens", "ids_crc32"],
            )

    return run


def _ids(ranked: np.ndarray):
    def run(batches):
        for shard, block, docs, ends, ids in _read_blocks(ranked)(batches):
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([docs, lists], names=["doc_id", "ids"])

    return run


def _open(spark: SparkSession, folder: str) -> tuple[DataFrame, np.ndarray]:
    ranked = spark.read.parquet(f"{folder}/vocabulary").orderBy("rank").toPandas()["id"].to_numpy(np.int64)
    return spark.read.schema(BLOCKS).parquet(f"{folder}/blocks"), ranked


def read_token_ids(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, ids array) of every document in the files."""
    blocks, ranked = _open(spark, folder)
    return blocks.mapInArrow(_ids(ranked), "doc_id long, ids array<int>")


def read_token_digest(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, decoded from the files.

    Starts are running sums of block sizes: within a shard by block, and over
    shards by their totals, of which there is one row per file.
    """
    blocks, ranked = _open(spark, folder)
    rows = blocks.mapInArrow(_checksums(ranked), "shard int, block int, doc_id long, at long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("shard", "block", "n_ids")
    totals = sizes.groupBy("shard").agg(F.sum("n_ids").alias("n")).select(
        "shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("before")
    )
    begins = sizes.select("shard", "block", (F.sum("n_ids").over(Window.partitionBy("shard").orderBy("block")) - F.col("n_ids")).alias("within"))
    begins = begins.join(totals, "shard").select("shard", "block", (F.col("before") + F.col("within")).alias("first"))
    return rows.join(begins, ["shard", "block"]).select("doc_id", (F.col("first") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")


def token_digest(docs: DataFrame, path: str, end_id: int = 2, lower: bool = True, folder: str | None = None) -> DataFrame:
    """Write the token files (into the checkpoint folder if none is named) and read them back as a digest."""
    spark = docs.sparkSession
    folder = folder or f"{checkpoint_dir(spark)}/tokens-{uuid.uuid4().hex}"
    write_token_files(docs, folder, path, end_id, lower)
    return read_token_digest(spark, folder)
