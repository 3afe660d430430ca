"""Image files as a Spark source: bytes with type and size read from the header."""

from __future__ import annotations

import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession


def header(data: bytes | None) -> tuple[str | None, int | None, int | None]:
    """(format, width, height) of PNG, GIF, BMP, JPEG and WebP bytes; nulls for anything else or a header cut short."""
    data = data or b""
    try:
        if data[:8] == b"\x89PNG\r\n\x1a\n":
            return "png", *struct.unpack(">II", data[16:24])
        if data[:6] in (b"GIF87a", b"GIF89a"):
            return "gif", *struct.unpack("<HH", data[6:10])
        if data[:2] == b"BM":
            width, height = struct.unpack("<ii", data[18:26])
            return "bmp", width, abs(height)
        if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
            return "webp", *_webp(data)
        if data[:2] == b"\xff\xd8":
            return "jpeg", *_jpeg(data)
    except struct.error:
        pass
    return None, None, None


def _webp(data: bytes) -> tuple[int, int]:
    kind = data[12:16]
    if kind == b"VP8X":
        return tuple(1 + int.from_bytes(data[k : k + 3].ljust(3, b"\0"), "little") for k in (24, 27))
    if kind == b"VP8L":
        bits = struct.unpack("<I", data[21:25])[0]
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    width, height = struct.unpack("<HH", data[26:30])
    return width & 0x3FFF, height & 0x3FFF


def _jpeg(data: bytes) -> tuple[int, int]:
    """Size from the frame segment; other segments are skipped by their length."""
    at = 2
    while True:
        marker, length = struct.unpack(">HH", data[at : at + 4])
        if 0xFFC0 <= marker <= 0xFFCF and marker not in (0xFFC4, 0xFFC8, 0xFFCC):
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        if marker < 0xFF01 or marker == 0xFFDA:
            raise struct.error("no frame")
        at += 2 + length


def with_headers(files: DataFrame, content: str = "content") -> DataFrame:
    """``files`` with ``format``, ``width`` and ``height`` of its image bytes."""
    carried = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in files.schema.fields)

    def run(batches):
        for batch in batches:
            found = [header(data.as_py()) for data in batch.column(content)]
            columns = [pa.array([f[i] for f in found], kind) for i, kind in enumerate((pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], names=[*batch.schema.names, "format", "width", "height"])

    return files.mapInArrow(run, f"{carried}, format string, width int, height int")


def read_images(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Image files below a folder: path, modificationTime, length, content (and partition columns), format, width, height."""
    return with_headers(spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path))
