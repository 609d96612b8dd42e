"""Document fingerprints in the manner of I-Match.

1. Document frequencies of all terms over all documents. A task counts its own terms and ships them packed, by ranges of
   the term hash; one aggregate per range adds them up. Terms are 40-bit hashes of words.
2. The lexicon: terms whose document frequency lies in a band, given as shares of the number of documents. Since the
   frequencies of all terms add up to the mean number of distinct terms times the number of documents, at most
   mean / ``LOW`` terms can lie above the lower edge, whatever the size of the corpus. That bounds the broadcast.
3. A document's distinct lexicon terms, in order, are hashed once whole and once for each randomised subset of the
   lexicon. Subsets come at sampling rates 1/2, 1/4, ...; for any length of text some rates hold about one of its
   terms, so equal components say how much of two texts is alike, not only whether they are equal.

Likeness of two fingerprints: equal components among those that either text fills, at the sampling rates that leave
some component of one of the two empty (denser ones differ for the least edit), and the whole hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import BASES, SPACES, U64, Words, byte_table, mix, table, text_blocks, texts_of

#: The band of document frequencies, as shares of all documents.
LOW, HIGH = 0.001, 0.2
RATES = 12
SUBSETS = 5
BLOCK_BYTES = 1 << 20
#: Text that one range of documents holds, and one range of terms is counted from.
RANGE_BYTES = 16 << 20
TERM_BITS = 40
WORD_BYTES = byte_table([*SPACES, *b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"])


def distinct_terms(column) -> tuple[np.ndarray, np.ndarray]:
    """Distinct terms of each text in order, one text after the other, and how many each has."""
    words = Words(column, WORD_BYTES, lower=True)
    terms = words.hash >> U64(64 - TERM_BITS)
    own = [np.unique(terms[a:b]) for a, b in zip(words.first[:-1], words.first[1:])]
    return (np.concatenate(own) if own else terms), np.array([len(x) for x in own], np.int64)


def _add(terms: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(terms, kind="stable")
    terms, counts = terms[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], terms[1:] != terms[:-1]])) if len(terms) else np.zeros(0, np.int64)
    return terms[first], np.add.reduceat(counts, first) if len(first) else counts


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> np.ndarray:
    """Terms in the band, in order. Frequencies are counted over all rows of ``docs``, texts without terms included."""
    spark = docs.sparkSession
    total, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # as many ranges as keep what one of them holds bounded, even if no two tasks had a term in common
    ranges = max(256, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")), size // RANGE_BYTES)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, counts = np.zeros(0, U64), np.zeros(0, np.int64)
        fresh: list[np.ndarray] = []
        for block in text_blocks(batches, BLOCK_BYTES):
            fresh.append(distinct_terms(block.column("text"))[0])
            if sum(map(len, fresh)) > max(1_000_000, len(terms)):
                new = np.concatenate(fresh)
                terms, counts = _add(np.concatenate([terms, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
                fresh = []
        new = np.concatenate([np.zeros(0, U64), *fresh])
        terms, counts = _add(np.concatenate([terms, new]), np.concatenate([counts, np.ones(len(new), np.int64)]))
        part = (terms * U64(ranges) >> U64(TERM_BITS)).astype(np.int64)
        edges = np.searchsorted(part, np.arange(ranges + 1))
        some = np.flatnonzero(np.diff(edges))
        for i in range(0, len(some), 64):
            rows = [(int(r), slice(edges[r], edges[r + 1])) for r in some[i : i + 64]]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r for r, _ in rows], pa.int32()), pa.array([_pack(terms[s]) for _, s in rows], pa.binary()), pa.array([_pack(counts[s], False) for _, s in rows], pa.binary())],
                names=["part", "terms", "counts"],
            )

    def total_of(group: pa.Table) -> pa.Table:
        terms = [_unpack(x) for x in group.column("terms").to_pylist()]
        counts = [_unpack(x, False).astype(np.int64) for x in group.column("counts").to_pylist()]
        found, n = _add(np.concatenate(terms), np.concatenate(counts))
        band = (n >= low * total) & (n <= high * total)
        return pa.table({"term": pa.array(found[band].astype(np.int64)), "n": pa.array(n[band])})

    found = docs.select("text").mapInArrow(count, "part int, terms binary, counts binary").groupBy("part").applyInArrow(total_of, "term bigint, n bigint")
    return np.sort(found.select("term").toArrow().column("term").to_numpy().astype(U64))


def _pack(values: np.ndarray, ordered: bool = True) -> bytes:
    """Numbers below 2^40 by byte position, so that high bytes, mostly zero, lie together; ordered ones as steps."""
    steps = np.diff(values.astype(np.int64), prepend=0) if ordered else values
    return np.ascontiguousarray(steps.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5].T).tobytes()


def _unpack(packed: bytes, ordered: bool = True) -> np.ndarray:
    places = np.frombuffer(packed, np.uint8).reshape(5, -1)
    out = np.zeros((places.shape[1], 8), np.uint8)
    out[:, :5] = places.T
    values = out.view("<u8").ravel()
    return np.cumsum(values, dtype=U64) if ordered else values


def components(terms: np.ndarray, sizes: np.ndarray, band: np.ndarray) -> np.ndarray:
    """A row of components for each text: the whole hash, then every subset's, zero if the text has none of its terms.

    Texts without lexicon terms are hashed with all their terms, so that they are not all alike.
    """
    text = np.repeat(np.arange(len(sizes)), sizes)
    if len(band):
        inside = band[np.minimum(np.searchsorted(band, terms), len(band) - 1)] == terms
    else:
        inside = np.zeros(len(terms), bool)
    bare = np.bincount(text[inside], minlength=len(sizes)) == 0
    use = inside | bare[text]
    terms, text = terms[use], text[use]
    out = np.zeros((len(sizes), 1 + SUBSETS * RATES), U64)
    value = mix(terms ^ U64(BASES[0]))
    np.add.at(out[:, 0], text, value)
    for k in range(SUBSETS):
        bits, used = U64(0), 64
        for rate in range(1, RATES + 1):
            if used + rate > 64:
                bits, used = mix(terms + U64((k * RATES + rate) * BASES[1] % (1 << 64))), 0
            drawn = np.flatnonzero((bits >> U64(used) & U64((1 << rate) - 1)) == 0)
            used += rate
            np.add.at(out[:, (k * RATES) + rate], text[drawn], value[drawn])
    out[:, 1:] = mix(out[:, 1:]) >> U64(32)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Likeness of fingerprints row by row, 0 to 1; 1 for equal ones, also of texts without words."""
    same = a[:, 1:].reshape(-1, SUBSETS, RATES) == b[:, 1:].reshape(-1, SUBSETS, RATES)
    filled_a, filled_b = (x[:, 1:].reshape(-1, SUBSETS, RATES) != 0 for x in (a, b))
    sparse = (~filled_a).any(1) | (~filled_b).any(1)
    used = (filled_a | filled_b) & sparse[:, None, :]
    equal = (a == b).all(1)
    return np.where(equal, 1.0, (same & used).sum((1, 2)) / (1 + used.sum((1, 2))))


def written(parts: np.ndarray) -> list[str]:
    """Fingerprints as text: 16 hex digits of the whole, then 8 for each subset."""
    whole = [f"{x:016x}" for x in parts[:, 0].tolist()]
    rest = [row.tobytes().hex() for row in parts[:, 1:].astype(">u4")]
    return [a + b for a, b in zip(whole, rest)]


class Cuts:
    """First keys of ranges of documents in the order (id descending, rows without id last; hash of the text)."""

    def __init__(self, keys: list[tuple[int | None, int]]):
        """``keys`` in that order."""
        named, rest = [k for k in keys if k[0] is not None], [k for k in keys if k[0] is None]
        self.keys = keys
        self.at = np.array([~i for i, _ in named], np.int64)  # ascending, without overflow
        self.hash = np.array([h for _, h in named], np.int64)
        self.rest = np.array([h for _, h in rest], np.int64)

    def part(self, ids: pa.Array, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the range of each row, and whether the row is the first of its range."""
        none = pc.is_null(ids).to_numpy(zero_copy_only=False)
        at = ~pc.fill_null(ids, 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = np.searchsorted(self.at, at, "right")
        low = np.searchsorted(self.at, at, "left")
        for a, b in {(x, y) for x, y in zip(low.tolist(), part.tolist()) if x < y}:  # ranges that begin within one id
            rows = np.flatnonzero((low == a) & (part == b))
            part[rows] = a + np.searchsorted(self.hash[a:b], hashes[rows], "right")
        part[none] = len(self.at) + np.searchsorted(self.rest, hashes[none], "right")
        part = part - 1
        whole = np.concatenate([self.hash, self.rest])
        first = np.where(none, part >= len(self.at), (part < len(self.at)) & (self.at[np.clip(part, 0, max(len(self.at) - 1, 0))] == at if len(self.at) else False))
        return part, first & (whole[part] == hashes)


def ordered_ranges(docs: DataFrame) -> DataFrame:
    """``docs`` (``doc_id``, ``text``) dealt by descending id into even ranges; the first row of each also follows the range before.

    Adds ``part``, and ``guest``: true for the row that only follows. Rows without id come last; equal ids, and rows
    without id, are ordered by a hash of their text, so they spread over ranges as well. Ranges are those that Spark
    draws for the keys alone; their first keys, one row a range, go back to the texts and decide the range of a row by
    binary search. Rows that repeat a document are in one range, which is read as a stream.
    """
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("bytes")).first()["bytes"] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-int(size) // RANGE_BYTES))
    order = [F.col("doc_id").desc_nulls_last(), F.col("hash")]
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("hash"))
    own = F.struct(F.col("doc_id").isNull().alias("none"), F.bitwise_not("doc_id").alias("at"), "hash", "doc_id")
    firsts = keyed.select("doc_id", "hash").repartitionByRange(parts, *order).groupBy(F.spark_partition_id().alias("part")).agg(F.min(own).alias("first"))
    cuts = spark.sparkContext.broadcast(Cuts([(r["first"]["doc_id"], r["first"]["hash"]) for r in sorted(firsts.collect(), key=lambda r: (r["first"]["none"], r["first"]["at"] or 0, r["first"]["hash"]))]))

    def deal(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            part, first = cuts.value.part(batch.column("doc_id"), batch.column("hash").to_numpy())
            yield _dealt(batch, part, False)
            guests = np.flatnonzero(first)
            if len(guests):
                before = (part[guests] - 1) % len(cuts.value.keys)
                yield _dealt(batch.take(pa.array(guests)), before, True)

    rows = keyed.mapInArrow(deal, "doc_id bigint, text string, hash bigint, part int, guest boolean")
    return rows.repartitionById(max(len(cuts.value.keys), 1), F.col("part")).sortWithinPartitions("part", "guest", *order).drop("hash")


def _dealt(batch: pa.RecordBatch, part: np.ndarray, guest: bool) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(part.astype(np.int32)), pa.array(np.full(len(part), guest))], names=[*batch.schema.names, "part", "guest"])


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """Fingerprint of each text and of its edited text.

    ``docs`` has ``doc_id`` and ``text``; null is empty text. The edited text has its last half (rounded down, in code
    points) replaced by as many first code points of the next document by descending id, after the last the first.
    Columns: ``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next``. A lone
    document is its own next one. Repeated rows follow each other.
    """
    texts = texts_of(docs)
    band = docs.sparkSession.sparkContext.broadcast(lexicon(texts, low, high))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None
        for block in text_blocks(batches, BLOCK_BYTES):
            rows = block if held is None else pa.concat_tables([held, block])
            yield from _batch(rows, band.value)
            held = rows.slice(rows.num_rows - 1)

    columns = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered_ranges(texts).mapInArrow(run, columns)


def _batch(rows: pa.Table, band: np.ndarray) -> Iterator[pa.RecordBatch]:
    """All rows but the last; a guest only closes its range, and repeated guests of one id stand for the first."""
    texts, guest = rows.column("text").to_pylist(), rows.column("guest").to_pylist()
    own = [i for i in range(len(texts) - 1) if not guest[i]]
    if not own:
        return
    parts = components(*distinct_terms(rows.column("text")), band)
    edited = []
    for i in own:
        half = len(texts[i]) // 2
        edited.append(texts[i][: len(texts[i]) - half] + texts[i + 1][:half])
    changed = components(*distinct_terms(pa.array(edited, pa.string())), band)
    here, after = parts[own], parts[[i + 1 for i in own]]
    yield pa.RecordBatch.from_arrays(
        [
            rows.column("doc_id").combine_chunks().take(pa.array(own)), pa.array([len(texts[i]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]), pa.array(written(here)), pa.array(written(changed)),
            pa.array(likeness(here, changed)), pa.array(likeness(here, after)),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def op7_fingerprint(spark: SparkSession, folder: str) -> DataFrame:
    return fingerprints(table(spark, folder, "documents"))
