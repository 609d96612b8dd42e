"""Helpers the operators of this package share: staged tables, text blocks, hashed words and windows."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

U64 = np.uint64
#: Words of the operators on shingles and windows: runs of anything but ASCII white space.
SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors see: the session's checkpoint folder, else one in the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir')}/_staged").rstrip("/")


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: lineage ends there, lost executors cost nothing."""
    path = f"{shared_folder(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """The columns an operator works on and no other; null text is empty text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def text_blocks(batches: Iterable[pa.RecordBatch], limit: int, column: str = "text") -> Iterator[pa.Table]:
    """Rows regrouped into tables of about ``limit`` bytes of text; one longer text is a block of its own."""
    held, size = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = np.cumsum(pa.compute.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        start = 0
        while start < batch.num_rows:
            before = int(sizes[start - 1]) if start else 0
            stop = max(start + 1, int(np.searchsorted(sizes, before + max(limit - size, 0), "right")))
            part = int(sizes[stop - 1]) - before
            if held and size + part > limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
                continue
            held.append(batch.slice(start, stop - start))
            size += part
            start = stop
            if size >= limit:
                yield pa.Table.from_batches(held)
                held, size = [], 0
    if held:
        yield pa.Table.from_batches(held)


def raw_text(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts one after the other, and where each begins (one more entry than texts)."""
    array = column.combine_chunks().cast(pa.large_string()) if isinstance(column, pa.ChunkedArray) else column.cast(pa.large_string())
    if isinstance(array, pa.ChunkedArray):
        array = pa.concat_arrays(array.chunks) if array.num_chunks else pa.array([], pa.large_string())
    array = array.fill_null("")
    _, ends, data = array.buffers()
    starts = np.frombuffer(ends, np.int64)[array.offset : array.offset + len(array) + 1] if len(array) else np.zeros(1, np.int64)
    body = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None and starts[-1] > starts[0] else np.zeros(0, np.uint8)
    return body, starts - starts[0]


def byte_table(not_word: Iterable[int]) -> np.ndarray:
    """True for the bytes that belong to words."""
    is_word = np.ones(256, bool)
    is_word[list(not_word)] = False
    return is_word


def lower_ascii(body: np.ndarray) -> np.ndarray:
    """A-Z to a-z, every other byte as it is."""
    to = np.arange(256, dtype=np.uint8)
    to[65:91] += 32
    return to[body]


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit values (xor-shift and multiply)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2^64, and of its inverse."""
    up, down = np.full(n + 1, base, U64), np.full(n + 1, pow(base, -1, 1 << 64), U64)
    up[0] = down[0] = 1
    return np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)


def rolling(values: np.ndarray, starts: np.ndarray, stops: np.ndarray, base: int) -> np.ndarray:
    """Scrambled polynomial hash of values[start:stop] for every pair."""
    up, down = _powers(base, len(values))
    sums = np.concatenate([np.zeros(1, U64), np.cumsum(values * up[:-1], dtype=U64)])
    return mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(U64) * U64(0x9E3779B97F4A7C15))


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
#: Bits of a little-endian 8-byte load that belong to a word of 0 to 8 remaining bytes.
KEEP = np.array([(1 << 8 * n) - 1 for n in range(9)], U64)
LONG_WORD = 4096


def word_hash(body: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """64-bit hash of body[start:stop] for every pair, eight bytes of all words at a time; 8 more bytes follow the body."""
    loads = np.ndarray((len(body) - 7,), "<u8", buffer=body, strides=(1,))
    size = stop - start
    out = mix(size.astype(U64) * U64(BASES[0]) + (loads[start] & KEEP[np.minimum(size, 8)]))
    at, more = 8, np.flatnonzero(size > 8)
    while len(more):
        left = size[more] - at
        out[more] = mix(out[more] * U64(BASES[1]) + (loads[start[more] + at] & KEEP[np.minimum(left, 8)]))
        at, more = at + 8, more[left > 8]
        if at >= LONG_WORD:
            for i in more:
                rest = hashlib.blake2b(body[start[i] + at : stop[i]].tobytes(), digest_size=8).digest()
                out[i] = mix(out[i] ^ U64(int.from_bytes(rest, "little")))
            break
    return out


class Words:
    """Words of a block of texts.

    ``start``/``stop`` are byte positions, ``first`` has the number of the first word of each text (one more entry
    than texts), ``doc`` the text of each word, ``hash`` a 64-bit hash of each word.
    """

    def __init__(self, column, is_word: np.ndarray, lower: bool = False, hashed: bool = True):
        body, offsets = raw_text(column)
        self.body = lower_ascii(body) if lower else body
        self.padded = np.concatenate([self.body, np.zeros(8, np.uint8)])
        self.offsets = offsets
        inside = np.zeros(len(body) + 2, bool)
        inside[1:-1] = is_word[self.body]
        turn = inside[1:] != inside[:-1]
        begins, ends = turn & inside[1:], turn & inside[:-1]
        seam = offsets[inside[offsets] & inside[offsets + 1]]  # two texts that meet inside a run of word bytes
        begins[seam] = ends[seam] = True
        self.start, self.stop = np.flatnonzero(begins), np.flatnonzero(ends)
        self.first = np.searchsorted(self.start, offsets).astype(np.int64)
        self.count = np.diff(self.first)
        self.hash = word_hash(self.padded, self.start, self.stop) if hashed else None

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.count)), self.count)

    def windows(self, size: int) -> np.ndarray:
        """Numbers of the words at which a window of ``size`` words of one text starts."""
        end = np.repeat(self.first[1:], self.count)
        return np.flatnonzero(np.arange(len(end)) + size <= end)

    def window_hash(self, at: np.ndarray, size: int, which: int = 0) -> np.ndarray:
        return rolling(self.hash, at, at + size, BASES[which] ^ (0 if which == 0 else size * 2))


def signed(x: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(x).view(np.int64)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions start, start + 1, ... (count of them) for every pair, one after the other."""
    total = int(counts.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(counts)
    return np.arange(total) - np.repeat(ends - counts, counts) + np.repeat(starts, counts)


def merged_cover(starts: np.ndarray, stops: np.ndarray, length: int) -> np.ndarray:
    """True at the positions below ``length`` that some [start, stop) covers."""
    step = np.zeros(length + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, stops, -1)
    return np.cumsum(step[:-1]) > 0


def set_apart(df: DataFrame, *own: str) -> tuple[DataFrame, list[str]]:
    """``df`` with every column but ``own`` under a neutral name, so that no added column can clash; the names to give back."""
    return df.toDF(*[c if c in own else f"other_{i}" for i, c in enumerate(df.columns)]), df.columns
