"""Removal of word windows that occur more than once in the corpus, by level-wise doubling.

Levels go from a quarter of the wanted length (or an eighth, a sixteenth: at most ``FIRST`` words) to the wanted length,
each at most twice the one before: 9, 18 and 35 words. A window can only repeat if the shorter windows inside it do, so each level hashes the
windows that survived the last one alone, and levels end when no candidates survive. Longer levels than the wanted
length cannot remove another word: a longer repeated window consists of repeated windows of the wanted length.

The first level looks at minimizers only: of the short windows inside a window of the wanted length the one with the
smallest hash (leftmost on ties). Equal windows choose the same one, so a window whose minimizer occurs once occurs
once itself; about one word in fourteen begins a minimizer. From the second level on all windows inside those that are left are
counted, and only those that repeat are extended.

Each level is one aggregate over (hash) that counts and keeps one position. Tasks combine their own repetitions before
the shuffle, so a passage that a third of all texts share is one row per task. What goes back to the documents are the
windows counted once, which need no join with the repeated ones: their only position is in the aggregate.

Windows are compared by 64-bit hashes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import SPACES, U64, Words, byte_table, merged_cover, ragged, signed, staged, table, text_blocks, texts_of

LENGTH = 35
FIRST = 12
BLOCK_BYTES = 1 << 20
WORD_BYTES = byte_table(SPACES)


def levels_of(length: int, first: int = FIRST) -> list[int]:
    """Window lengths of the levels, each at most twice the one before; the first has at most ``first`` words."""
    found = [length]
    while found[0] > first or len(found) == 1:
        found.insert(0, -(-found[0] // 2))
        if found[0] == 1:
            break
    return found


def minimizers(words: Words, short: int, long: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts of the windows of ``long`` words, the word at which each one's minimizer starts, hashes by word."""
    starts = words.windows(long)
    if not len(starts):
        return starts, starts, np.zeros(0, U64)
    n = len(words.hash)
    at = np.arange(max(n - short + 1, 0))
    hashes = words.window_hash(at, short)
    bits = U64(int(n).bit_length())
    least = (hashes >> bits << bits) | at.astype(U64)
    span = 1
    width = long - short + 1
    while span * 2 <= width:
        least = np.minimum(least[: len(least) - span], least[span:])
        span *= 2
    least = np.minimum(least[: len(least) - (width - span)], least[width - span :]) if width > span else least
    chosen = least[starts] & U64((1 << int(bits)) - 1)
    return starts, chosen.astype(np.int64), hashes


def sieve_of(words: Words, levels: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Minimizers of the shortest level in the windows of the longest: fewer rows than for any level between."""
    return minimizers(words, levels[0], levels[-1])


def _rows(hashes: np.ndarray, docs: pa.Array, text: np.ndarray, at: np.ndarray) -> Iterator[pa.RecordBatch]:
    if len(at):
        yield pa.RecordBatch.from_arrays([pa.array(signed(hashes)), docs.take(pa.array(text)), pa.array(at, pa.int32())], names=["hash", "doc", "at"])


ROW = "hash bigint, doc bigint, at int"


def _single(rows: DataFrame) -> DataFrame:
    """``(doc, single)``: the positions whose hash occurs once, per document."""
    once = rows.groupBy("hash").agg(F.count("*").alias("n"), F.min("doc").alias("doc"), F.min("at").alias("at")).filter("n = 1")
    return once.groupBy("doc").agg(F.collect_list("at").alias("single"))


def _spread(column: pa.ChunkedArray, first: np.ndarray) -> np.ndarray:
    """Positions within each text, as numbers of words of the block."""
    lists = column.combine_chunks()
    lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
    sizes = pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    return lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64) + np.repeat(first[:-1], sizes)


def _gather(positions: np.ndarray, words: Words) -> pa.Array:
    """The inverse of ``_spread`` for sorted positions."""
    ends = np.searchsorted(positions, words.first)
    inside = positions - np.repeat(words.first[:-1], np.diff(ends))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(inside, pa.int32()))


def _kept(words: Words, removed: np.ndarray, text: int) -> str:
    """SHA-256 of the kept words of one text, joined by one space."""
    a, b = words.first[text], words.first[text + 1]
    keep = np.flatnonzero(~removed[a:b]) + a
    if not len(keep):
        return hashlib.sha256(b"").hexdigest()
    # a word and one space: the bytes of all of them are the joined text with one space too many
    size = words.stop[keep] - words.start[keep]
    out = words.padded[ragged(words.start[keep], size + 1)]
    out[np.cumsum(size + 1) - 1] = 32
    return hashlib.sha256(out[:-1].tobytes()).hexdigest()


def remove_repeated(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256, removed)`` for every row of ``docs`` (``doc_id``, ``text``).

    ``removed`` are the ranges of words that repeated windows cover. Null, empty and short texts lose nothing. Rows
    that repeat a document (same id and text) repeat all its windows. Rows are told apart by id and text together, so
    they may share an id or have none.
    """
    texts = texts_of(docs).withColumn("doc", F.xxhash64("doc_id", "text"))
    lengths = levels_of(length)
    long = lengths[1]

    def first_level(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, BLOCK_BYTES):
            words = Words(block.column("text"), WORD_BYTES)
            _, chosen, hashes = sieve_of(words, lengths)
            chosen = np.unique(chosen) if len(chosen) else chosen
            text = words.doc[chosen]
            yield from _rows(hashes[chosen], block.column("doc").combine_chunks(), text, chosen - words.first[text])

    def candidates(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Windows of the second level inside windows whose minimizer repeats; a text without any is finished here."""
        for block in text_blocks(batches, BLOCK_BYTES):
            words = Words(block.column("text"), WORD_BYTES)
            starts, chosen, _ = sieve_of(words, lengths)
            alone = np.zeros(len(words.hash) + 1, bool)
            alone[_spread(block.column("single"), words.first)] = True
            whole = starts[~alone[chosen]]
            open_ = np.flatnonzero(merged_cover(whole, whole + length - long + 1, len(words.hash)))
            lists = _gather(open_, words)
            some = np.diff(np.searchsorted(open_, words.first)) > 0
            none = np.zeros(len(words.hash), bool)
            done = [None if s else _kept(words, none, i) for i, s in enumerate(some)]
            text = pa.compute.if_else(pa.array(some), block.column("text").combine_chunks(), pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id").combine_chunks(), block.column("doc").combine_chunks(), pa.array(words.count, pa.int64()), text, lists, pa.array(done, pa.string())],
                names=["doc_id", "doc", "n_words", "text", "open", "kept_sha256"],
            )

    def windows(size: int):
        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in text_blocks(batches, BLOCK_BYTES):
                words = Words(block.column("text"), WORD_BYTES)
                at = _spread(block.column("open"), words.first)
                text = np.searchsorted(words.first, at, "right") - 1
                yield from _rows(words.window_hash(at, size), block.column("doc").combine_chunks(), text, at - words.first[text])

        return run

    def survivors(size: int, longer: int):
        """Windows of the next level, all of whose windows of this level repeat at its two ends."""

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for block in text_blocks(batches, BLOCK_BYTES):
                words = Words(block.column("text"), WORD_BYTES)
                repeated = np.zeros(len(words.hash) + longer, bool)
                repeated[_spread(block.column("open"), words.first)] = True
                repeated[_spread(block.column("single"), words.first)] = False
                starts = words.windows(longer)
                open_ = starts[repeated[starts] & repeated[starts + longer - size]]
                place = block.schema.get_field_index("open")
                yield from block.drop_columns(["single"]).set_column(place, "open", _gather(open_, words)).combine_chunks().to_batches()

        return run

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in text_blocks(batches, BLOCK_BYTES):
            words = Words(block.column("text"), WORD_BYTES)
            repeated = np.zeros(len(words.hash), bool)
            repeated[_spread(block.column("open"), words.first)] = True
            repeated[_spread(block.column("single"), words.first)] = False
            at = np.flatnonzero(repeated)
            gone = merged_cover(at, at + length, len(repeated))
            edge = np.zeros(len(gone) + 1, bool)
            edge[words.first] = True
            turn = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
            begin = np.flatnonzero(gone & ((turn[:-1] == 1) | edge[:-1]))
            end = np.flatnonzero(gone & ((turn[1:] == -1) | edge[1:])) + 1
            text = words.doc[begin] if len(begin) else begin
            ends = np.searchsorted(begin, words.first)
            ranges = pa.StructArray.from_arrays([pa.array(begin - words.first[text]), pa.array(end - words.first[text])], names=["start", "stop"])
            total = np.concatenate([[0], np.cumsum(gone)])
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").combine_chunks(), pa.array(words.count, pa.int64()), pa.array(total[words.first[1:]] - total[words.first[:-1]], pa.int64()),
                    pa.array([_kept(words, gone, i) for i in range(len(words.count))], pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ranges),
                ],
                names=["doc_id", "n_words", "n_removed", "kept_sha256", "removed"],
            )

    single = _single(texts.select("doc", "text").mapInArrow(first_level, ROW))
    level = staged(
        texts.join(single.hint("shuffle_hash"), "doc", "left")
        .mapInArrow(candidates, "doc_id bigint, doc bigint, n_words bigint, text string, open array<int>, kept_sha256 string"), "level",
    )
    ranges = "array<struct<start:bigint,stop:bigint>>"
    done = level.filter("text is null").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", F.expr(f"cast(array() as {ranges})").alias("removed"))
    open_ = level.filter("text is not null").select("doc_id", "doc", "text", "open")
    for size, longer in zip(lengths[1:], [*lengths[2:], None]):
        single = _single(open_.select("doc", "text", "open").mapInArrow(windows(size), ROW))
        joined = open_.join(single.hint("shuffle_hash"), "doc", "left")
        if longer:
            open_ = staged(joined.mapInArrow(survivors(size, longer), "doc bigint, doc_id bigint, text string, open array<int>"), "level")
    last = joined.mapInArrow(cut, f"doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, removed {ranges}")
    return done.unionByName(last)


def op4_substring(spark: SparkSession, folder: str) -> DataFrame:
    return remove_repeated(table(spark, folder, "documents")).drop("removed")


SQL = r"""
with cut as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') w from documents),
windows as (select doc_id, i, array_to_string(w[i + 1:i + 35], ' ') s from (select doc_id, w, unnest(range(len(w) - 34)) i from cut where len(w) >= 35)),
repeated as (select doc_id, i from windows join (select s from windows group by s having count(*) > 1) using (s)),
gone as (select distinct doc_id, unnest(range(i, i + 35)) p from repeated),
words as (select doc_id, unnest(w) word, unnest(range(len(w))) p from cut),
kept as (
  select doc_id, count(*) n_kept, string_agg(word, ' ' order by p) kept from words anti join gone using (doc_id, p) group by doc_id
)
select doc_id, len(w) n_words, len(w) - coalesce(n_kept, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256 from cut left join kept using (doc_id)
"""
