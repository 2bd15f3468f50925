"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()

#: bytes of `[^\x00-\x2F\x3A-\x60\x7B-\x7F]` after lower-casing A-Z; every other byte becomes a space
WORD_BYTES = bytes(
    (b + 32 if 0x41 <= b <= 0x5A else b) if b >= 0x80 or 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A
    else 0x20 for b in range(256))

#: as WORD_BYTES, but digits are separators too
LETTER_BYTES = bytes(0x20 if 0x30 <= b <= 0x39 else WORD_BYTES[b] for b in range(256))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    """Place of a public vocabulary file (default of the path parameters)."""
    import public_tokenizers
    return public_tokenizers.path(name)


def read_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def byte_list(column: pa.Array | pa.ChunkedArray) -> list:
    """A string column as a list of UTF-8 ``bytes`` (None for null)."""
    return column.cast(pa.large_binary()).to_pylist()


def row_slices(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Row ranges ``(first, end)`` of a text column of about ``size`` bytes each,
    so that only so much of an Arrow batch stands as Python objects at a time
    (one row at least: a text is never cut)."""
    ends = np.cumsum(np.r_[0, pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(ends, ends[at] + size, "right")) - 1)
        yield at, end
        at = end


def text_slices(column: pa.Array, size: int = 4 << 20) -> Iterator[tuple[int, list]]:
    """``(first row, texts)`` of a text column in slices of about ``size`` bytes."""
    for at, end in row_slices(column, size):
        yield at, byte_list(column.slice(at, end - at))


def give_back() -> None:
    """Hands freed memory back to the system: Python workers outlive their task,
    and what one stage leaves with them would add to the next one's need."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):       # not glibc
        pass


def lower_ascii(text: Column) -> Column:
    """``text`` with A-Z (and nothing else) in lower case.  Pure ASCII values,
    where the two agree, take the fast built-in."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)) \
            .otherwise(F.translate(text, UPPER, LOWER))


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of ``doc_id`` written as text, modulo ``n`` (null for a null id)."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def crc32_of(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF


def text_key(text: Column) -> Column:
    """A narrow key that tells rows with one doc_id but different texts apart."""
    return F.xxhash64(text, F.octet_length(text))
