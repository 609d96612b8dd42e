"""Packing of documents into sequences of a fixed length by a grouping genetic algorithm on islands.

A document longer than a sequence is cut; whole sequences stand alone, and one piece of each document is left to pack.
Pieces are dealt over islands of about ``ISLAND`` pieces by a hash. An island holds a few packings of its pieces. A
crossover injects well-filled bins of one packing into another as they are, takes out the bins that hold an injected
piece a second time, and puts the displaced pieces back, each into the bin where it leaves the least room. A packing
counts by its number of bins, then by the sum of squared fills (Falkenauer's measure). After each epoch the best bins
of an island migrate to another one as lists of lengths: there they are filled with pieces of those lengths and take
part in the crossovers. An island that needs no more bins than its lengths add up to is done.

Bins with much room are dealt over fewer islands, whole, and go through the same again, until one island holds them
all or none is left. A packing never gets worse: the bins as they are make one of its island's first packings.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import raw_text, staged, table, text_blocks, texts_of

CAPACITY = 2048
END_ID = 0
BLOCK_BYTES = 4 << 20
ISLAND = 4096
POPULATION = 5
EPOCHS = 3
GENERATIONS = 8
ELITES = 64
#: Bins with more room than this part of the capacity are packed again with those of other islands.
ROOMY = 64
#: White space as long as this, and characters beyond plain Latin letters, go to the library itself.
LONG_SPACE = 1000


def byte_of_char() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: printable ones for themselves, the rest from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Token ids as the ``tokenizers`` library gives them for a byte-level vocabulary file.

    Its merges are in the order of their ids, so the same vocabulary runs as ranks in ``tiktoken``, three times as fast.
    The two libraries may judge rare characters differently, and one cannot take very long white space; texts with such
    go to ``tokenizers`` whole.
    """

    def __init__(self, file: str, pattern: str):
        """``file`` is the text of the vocabulary file."""
        import tiktoken
        from tokenizers import Tokenizer

        found = json.loads(file)
        vocab, to_byte = found["model"]["vocab"], byte_of_char()
        self.special = {t["content"]: t["id"] for t in found["added_tokens"]}
        ranks = {bytes(to_byte[c] for c in t): i for t, i in vocab.items() if t not in self.special}
        order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in found["model"]["merges"]]
        if order != sorted(order):
            raise ValueError("merges are not in the order of their ids")
        self.fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.library = Tokenizer.from_str(file)

    def encode(self, text: str, plain: bool) -> np.ndarray:
        if not plain:
            return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)
        return self.fast.encode_to_numpy(text, allowed_special="all")

    @staticmethod
    def plain_texts(column: pa.ChunkedArray) -> np.ndarray:
        """Which texts both libraries split alike."""
        body, offsets = raw_text(column)
        odd = body >= 0xC9
        odd[:-1] |= (body[:-1] == 0xC2) & ((body[1:] == 0x85) | (body[1:] == 0xA0))
        space = np.zeros(len(body) + 2, bool)
        space[1:-1] = (body == 0x20) | ((body >= 0x09) & (body <= 0x0D))
        turn = np.flatnonzero(space[1:] != space[:-1])
        starts, stops = turn[0::2], turn[1::2]
        odd[starts[stops - starts >= LONG_SPACE]] = True
        # the long run may begin in an earlier text
        seen = np.concatenate([[0], np.cumsum(odd)])
        long_runs = [(a, b) for a, b in zip(starts.tolist(), stops.tolist()) if b - a >= LONG_SPACE]
        out = seen[offsets[1:]] == seen[offsets[:-1]]
        for a, b in long_runs:
            out[np.searchsorted(offsets, a, "right") - 1 : np.searchsorted(offsets, b, "left")] = False
        return out


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter than the capacity."""
    first = (length - 1) % capacity + 1
    return [(0, first)] + [(at, capacity) for at in range(first, length, capacity)]


def encoded_pieces(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: the pieces of every row, null text being empty."""
    file = docs.sparkSession.sparkContext.broadcast(Path(path).read_text(encoding="utf-8"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(file.value, pattern)
        for block in text_blocks(batches, BLOCK_BYTES):
            out = []
            for doc, text, plain in zip(block.column("doc_id").to_pylist(), block.column("text").to_pylist(), encoder.plain_texts(block.column("text")).tolist()):
                ids = np.append(encoder.encode(text, plain), np.uint32(END_ID)).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    out.append((doc, piece, start, length, zlib.crc32(ids[start : start + length].tobytes())))
            columns = list(zip(*out))
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return texts_of(docs).mapInArrow(run, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint")


class Island:
    """Packings of the pieces of one island: an array with the bin of each piece for each packing."""

    def __init__(self, lengths: np.ndarray, capacity: int, seed: int):
        self.lengths, self.capacity = lengths, capacity
        self.least = -(-int(lengths.sum()) // capacity)
        self.random = np.random.default_rng(seed)

    def fills(self, bins: np.ndarray) -> np.ndarray:
        return np.bincount(bins, self.lengths).astype(np.int64)

    def worth(self, bins: np.ndarray) -> tuple[int, float]:
        """Fewer bins first, then fuller ones beside emptier ones; lower is better."""
        fills = self.fills(bins)
        return int((fills > 0).sum()), -float(((fills / self.capacity) ** 2).sum())

    def best_fit(self, bins: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Put the pieces where each leaves the least room, in the order given; the others stay in their bins (numbered without gaps)."""
        placed = np.ones(len(bins), bool)
        placed[pieces] = False
        n = int(bins[placed].max()) + 1 if placed.any() else 0
        room = (self.capacity - np.bincount(bins[placed], self.lengths[placed], n)).astype(np.int64).tolist()
        open_bins: list[list[int]] = [[] for _ in range(self.capacity + 1)]
        mask = 0
        for b, free in enumerate(room):
            if free:
                open_bins[free].append(b)
                mask |= 1 << free
        for i, length in zip(pieces.tolist(), self.lengths[pieces].tolist()):
            fitting = mask >> length
            if fitting:
                free = length + (fitting & -fitting).bit_length() - 1
                b = open_bins[free].pop()
                if not open_bins[free]:
                    mask ^= 1 << free
            else:
                free, b, n = self.capacity, n, n + 1
            bins[i] = b
            free -= length
            if free:
                open_bins[free].append(b)
                mask |= 1 << free
        return bins

    def fresh(self, shuffled: float) -> np.ndarray:
        """Best fit of all pieces, longest first; with ``shuffled`` the order is blurred by that share of the capacity."""
        key = self.lengths + self.random.random(len(self.lengths)) * shuffled * self.capacity
        return self.best_fit(np.zeros(len(self.lengths), np.int64), np.argsort(-key, kind="stable"))

    def inject(self, into: np.ndarray, donated: list[np.ndarray]) -> np.ndarray:
        """``into`` with the donated bins as they are; pieces of bins that held any of their pieces are placed anew."""
        if not donated:
            return into
        number = np.full(len(into), -1, np.int64)
        for k, pieces in enumerate(donated):
            number[pieces] = k
        taken = number >= 0
        spoiled = np.zeros(int(into.max()) + 1, bool)
        spoiled[into[taken]] = True
        displaced = np.flatnonzero(spoiled[into] & ~taken)
        stay = ~spoiled[into]
        _, bins = np.unique(into[stay], return_inverse=True)
        child = np.zeros(len(into), np.int64)
        child[stay] = bins + len(donated)
        child[taken] = number[taken]
        return self.best_fit(child, displaced[np.argsort(-self.lengths[displaced], kind="stable")])

    def members(self, bins: np.ndarray) -> list[np.ndarray]:
        order = np.argsort(bins, kind="stable")
        return np.split(order, np.flatnonzero(np.diff(bins[order])) + 1)

    def well_filled(self, bins: np.ndarray) -> list[np.ndarray]:
        """Half of the fuller half of the bins, drawn at random."""
        fills = self.fills(bins)
        middle = np.median(fills[fills > 0])
        found = [m for m in self.members(bins) if fills[bins[m[0]]] >= middle]
        return [m for m, yes in zip(found, self.random.random(len(found)) < 0.5) if yes]

    def filled_from(self, patterns: list[list[int]]) -> list[np.ndarray]:
        """Bins of own pieces with the lengths that migrated bins have, no piece twice."""
        stock: dict[int, list[int]] = {}
        for i, length in enumerate(self.lengths.tolist()):
            stock.setdefault(length, []).append(i)
        out = []
        for pattern in patterns:
            found = []
            for length in pattern:
                if stock.get(length):
                    found.append(stock[length].pop())
            if len(found) == len(pattern):
                out.append(np.array(found, np.int64))
            else:
                for i in found:
                    stock[int(self.lengths[i])].append(i)
        return out

    def mutate(self, bins: np.ndarray) -> np.ndarray:
        """The emptiest bins and a few others are dissolved, their pieces placed anew."""
        fills = self.fills(bins)
        some = np.flatnonzero(fills > 0)
        worst = some[np.argsort(fills[some], kind="stable")[: max(1, len(some) // 50)]]
        gone = np.isin(bins, np.concatenate([worst, self.random.choice(some, max(1, len(some) // 50))]))
        left = np.zeros(len(bins), np.int64)
        left[~gone] = np.unique(bins[~gone], return_inverse=True)[1]
        pieces = np.flatnonzero(gone)
        return self.best_fit(left, pieces[np.argsort(-(self.lengths[pieces] + self.random.random(len(pieces)) * 40), kind="stable")])

    def evolve(self, packings: list[np.ndarray], patterns: list[list[int]], population: int, generations: int) -> list[np.ndarray]:
        """The packings after some generations, best first."""
        found = sorted(packings, key=self.worth)
        if found and self.worth(found[0])[0] <= self.least:
            return found[:1]
        while len(found) < population:
            found.append(self.fresh(0.0 if not found else 0.05 * len(found)))
            if self.worth(found[-1])[0] <= self.least:
                break
        found.sort(key=self.worth)
        if self.worth(found[0])[0] <= self.least:
            return found[:1]
        migrated = self.filled_from(patterns)
        if migrated:
            found.append(self.inject(found[0], migrated))
        for _ in range(generations):
            children = []
            for k in range(population):
                mother, father = found[0] if k == 0 else found[self.random.integers(len(found))], found[self.random.integers(len(found))]
                children.append(self.mutate(self.inject(mother.copy(), self.well_filled(father))))
            found = sorted(found + children, key=self.worth)[:population]
            if self.worth(found[0])[0] <= self.least:
                return found[:1]
        return found


STATE = "island int, unit bigint, length int, genes array<bigint>"
STATE_TYPE = pa.schema([("island", pa.int32()), ("unit", pa.int64()), ("length", pa.int32()), ("genes", pa.list_(pa.int64()))])


def _state_of(rows: pa.Table) -> tuple[pa.Table, np.ndarray, list[np.ndarray]]:
    """Rows in order of their units, lengths, packings."""
    rows = rows.sort_by("unit")
    genes = rows.column("genes").to_pylist()
    lengths = rows.column("length").to_numpy().astype(np.int64)
    grid = np.array(genes, np.int64).reshape(len(rows), len(genes[0]))
    return rows, lengths, [np.unique(grid[:, k], return_inverse=True)[1] for k in range(grid.shape[1])]


def evolved(state: DataFrame, elites: DataFrame, capacity: int, epoch: int, population: int, generations: int) -> DataFrame:
    """One epoch on every island; a task holds the pieces of one island, ``ISLAND`` of them on average."""

    def run(key, rows: pa.Table, guests: pa.Table) -> pa.Table:
        if not len(rows):
            return STATE_TYPE.empty_table()
        rows, lengths, packings = _state_of(rows)
        island = Island(lengths, capacity, 1_000_003 * epoch + key[0].as_py())
        patterns = sorted(guests.column("lengths").to_pylist(), key=lambda p: (-sum(p), p))
        found = island.evolve(packings, patterns, population, generations)
        genes = pa.array(np.stack(found, axis=1).tolist(), pa.list_(pa.int64()))
        return pa.Table.from_arrays([rows.column("island"), rows.column("unit"), rows.column("length"), genes], schema=STATE_TYPE)

    return state.groupBy("island").cogroup(elites.groupBy("island")).applyInArrow(run, STATE)


def migrants(state: DataFrame, islands: int, step: int, elites: int = ELITES) -> DataFrame:
    """``(island, lengths)``: the fullest bins of each island's best packing, addressed to the island ``step`` further."""

    def run(rows: pa.Table) -> pa.Table:
        rows, lengths, packings = _state_of(rows)
        target = (rows.column("island")[0].as_py() + step) % islands
        bins = packings[0]
        order = np.lexsort((-lengths, bins))
        found = np.split(lengths[order], np.flatnonzero(np.diff(bins[order])) + 1)
        best = sorted(((-int(b.sum()), b.tolist()) for b in found))[:elites]
        return pa.table({"island": pa.array([target] * len(best), pa.int32()), "lengths": pa.array([b for _, b in best], pa.list_(pa.int32()))})

    return state.groupBy("island").applyInArrow(run, "island int, lengths array<int>")


def sequences_of(state: DataFrame, capacity: int) -> DataFrame:
    """``(unit, length, sequence_id, offset, room)``: the best packing; a sequence is named by its first piece."""

    def run(rows: pa.Table) -> pa.Table:
        rows, lengths, packings = _state_of(rows)
        units = rows.column("unit").to_numpy()
        bins = packings[0]
        order = np.argsort(bins, kind="stable")  # pieces of a bin in order of their units
        head = np.flatnonzero(np.concatenate([[True], np.diff(bins[order]) > 0]))
        ends = np.cumsum(lengths[order])
        before = ends - lengths[order]
        size = np.diff(np.append(head, len(order)))
        fill = np.add.reduceat(lengths[order], head)
        return pa.table(
            {
                "unit": units[order], "length": pa.array(lengths[order], pa.int32()), "sequence_id": np.repeat(units[order][head], size),
                "offset": before - np.repeat(before[head], size), "room": pa.array(np.repeat(capacity - fill, size), pa.int32()),
            }
        )

    return state.groupBy("island").applyInArrow(run, "unit bigint, length int, sequence_id bigint, offset bigint, room int")


def pack(
    pieces: DataFrame, capacity: int = CAPACITY, island: int = ISLAND, epochs: int = EPOCHS, population: int = POPULATION, generations: int = GENERATIONS
) -> DataFrame:
    """``(unit, sequence_id, offset)`` for every piece (``unit`` unique, ``length`` from 1 to ``capacity``).

    Pieces as long as a sequence stand alone. An empty table gives no rows. Equal lengths may change places between
    runs of different settings; the same table and settings give the same packing.
    """
    whole = pieces.filter(F.col("length") >= capacity).select("unit", F.col("unit").alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))
    left = pieces.filter(F.col("length") < capacity).select("unit", F.col("length").cast("int"), F.col("unit").alias("sequence_id"))
    size, done, level = left.count(), [whole], 0
    while size:
        islands = -(-size // island)
        number = F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(islands)).cast("int")
        # at first no packing is known; later the bins as they are make one
        genes = F.array(F.col("sequence_id")) if level else F.array().cast("array<bigint>")
        state = left.select(number.alias("island"), "unit", "length", genes.alias("genes"))
        elites = pieces.sparkSession.createDataFrame([], "island int, lengths array<int>")
        for epoch in range(epochs):
            state = staged(evolved(state, elites, capacity, epochs * level + epoch, population, generations), "islands")
            elites = migrants(state, islands, 1 << epoch)
        packed = staged(sequences_of(state, capacity), "packed")
        if islands == 1:
            done.append(packed.select("unit", "sequence_id", "offset"))
            break
        # bins with room go on, whole
        roomy = F.col("room") > capacity // ROOMY
        done.append(packed.filter(~roomy).select("unit", "sequence_id", "offset"))
        left = packed.filter(roomy).select("unit", "length", "sequence_id")
        before, size, level = size, left.count(), level + 1
        if size > 0.9 * before:  # almost no bin was filled: other neighbours will not fill them either
            done.append(packed.filter(roomy).select("unit", "sequence_id", "offset"))
            break
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out


def pack_documents(docs: DataFrame, path: str, pattern: str, capacity: int = CAPACITY, **settings: int) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` for every piece of every row of ``docs``.

    Null and empty texts are documents of one id, the end mark. Repeated rows, rows that share an id and rows without
    one are documents of their own. Columns beyond ``doc_id`` and ``text`` are ignored.
    """
    pieces = staged(encoded_pieces(docs, path, pattern, capacity).withColumn("unit", F.monotonically_increasing_id()), "pieces")
    return pieces.join(pack(pieces, capacity, **settings), "unit").drop("unit")


def op13_packing(spark: SparkSession, folder: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, folder, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
