"""Benchmark decontamination with suffix arrays over the training texts.

Every task turns its training texts into shards, sorts the shard's suffixes of words into a suffix array, and
binary-searches every suffix of every test item in it. A search gives the longest verbatim match and, by its lower
and upper bound, all places where the first words of the suffix occur. Nothing is shuffled: what is known about a
training text is known in the task that reads it, so a passage that a third of all texts share costs no more than
any other.

Only suffixes that begin with as many words of the test vocabulary as the shortest window has can hold a window; the
others are left out of the array, which loses no match of that length or more.

Test items are read in blocks for which at most ``block_bytes`` of arrays are built, one broadcast and one narrow pass
for each, so a broadcast never exceeds that size however many items there are; one item that is larger is a block of its
own, and its arrays grow with its words, not with their square. Only the first words of a suffix, as many as a window
has, are kept for each suffix; the rest is read from the item's words while a search goes deeper.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.shared import U64, Words, byte_table, merged_cover, ragged, set_apart, table, text_blocks, texts_of

WINDOW = 10
BLOCK_BYTES = 32 << 20
SHARD_BYTES = 4 << 20
#: Words are runs of a-z, 0-9 and everything beyond ASCII, after A-Z became a-z.
WORD_BYTES = byte_table([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])

MARKED = "hits array<struct<start:bigint,stop:bigint>>, items array<string>, longest bigint"


def word_bytes(limit: int, window: int) -> int:
    """Most bytes that ``test_suffixes`` builds for a word of a block of at most ``limit`` bytes."""
    per = max(64 // (max(limit, 1).bit_length() + 1), 1)
    return 8 * (6 + 2 * -(-window // per))


def item_blocks(items: DataFrame, limit: int, window: int = WINDOW) -> Iterator[list[tuple[str | None, str]]]:
    """Test items in lists of at most ``limit`` bytes of text and of arrays (one longer item is a list of its own)."""
    held, size = [], 0
    for item, text in items.toLocalIterator():
        words = Words(pa.chunked_array([pa.array([text], pa.string())]), WORD_BYTES, hashed=False).count
        n = max(len(text.encode()), int(words[0]) * word_bytes(limit, window))
        if held and size + n > limit:
            yield held
            held, size = [], 0
        held.append((item, text))
        size += n
    yield held


def test_suffixes(items: list[tuple[str | None, str]], window: int) -> dict:
    """The test side of the search: vocabulary, packed words of every suffix, length of its window, its item."""
    words = Words(pa.chunked_array([pa.array([t for _, t in items], pa.string())]), WORD_BYTES, lower=True)
    vocabulary, code = np.unique(words.hash, return_inverse=True)
    bits = int(len(vocabulary) + 1).bit_length()
    per = 64 // bits
    counts = words.count
    deepest = max(int(counts.max(initial=0)), 1)
    depth = -(-deepest // per)
    doc, at = words.doc, np.arange(len(code))
    left = np.repeat(words.first[1:], counts) - at
    need = np.minimum(window, np.repeat(counts, counts))
    use = left >= need
    place = at[use]
    coded = np.concatenate([code.astype(U64) + U64(1), np.zeros(max(window, per) + per, U64)])
    packed = np.zeros(len(code), U64)
    for k in range(per):
        packed |= coded[k : k + len(code)] << U64(bits * (per - 1 - k))
    low, high = (np.zeros((len(place), min(-(-window // per), depth)), U64) for _ in range(2))
    for k in range(low.shape[1] * per):
        within = k < need[use]
        here = coded[np.minimum(place + k, len(coded) - 1)]
        shift = U64(bits * (per - 1 - k % per))
        low[:, k // per] |= np.where(within, here, U64(0)) << shift
        high[:, k // per] |= np.where(within, here, U64((1 << bits) - 1)) << shift
    return {
        "vocabulary": vocabulary, "bits": bits, "per": per, "depth": depth, "packed": packed, "place": place, "low": low, "high": high,
        "left": left[use], "need": need[use], "item": doc[use], "names": [i for i, _ in items], "shortest": int(need.min(initial=window)),
    }


class Suffixes:
    """Column d of the packed words of each whole test suffix, read from the words of the items; zero after an item's end."""

    def __init__(self, tests: dict):
        per, bits = tests["per"], tests["bits"]
        self.per, self.packed, self.place, self.left = per, tests["packed"], tests["place"], tests["left"]
        self.depth = tests["depth"]
        self.keep = np.array([((1 << bits * n) - 1) << bits * (per - n) for n in range(per + 1)], U64)

    def __len__(self) -> int:
        return len(self.place)

    def at(self, rows: np.ndarray, d: int) -> np.ndarray:
        there = np.minimum(self.place[rows] + d * self.per, len(self.packed) - 1)
        return self.packed[there] & self.keep[np.clip(self.left[rows] - d * self.per, 0, self.per)]


class Windows:
    """Column d of dense rows of packed words, as ``Suffixes`` gives it."""

    def __init__(self, rows: np.ndarray):
        self.rows, self.depth = rows, rows.shape[1]

    def __len__(self) -> int:
        return len(self.rows)

    def at(self, rows: np.ndarray, d: int) -> np.ndarray:
        return self.rows[rows, d]


class Shard:
    """Suffix array of the texts of one block, down to the length of the longest test item."""

    def __init__(self, words: Words, tests: dict):
        per, bits, depth = tests["per"], tests["bits"], tests["depth"]
        vocabulary = tests["vocabulary"]
        self.per = per
        n = len(words.hash)
        #: One empty place after each text keeps words of two texts apart.
        self.place = np.arange(n) + words.doc
        self.begin = words.first[:-1] + np.arange(len(words.count))
        size = n + len(words.count)
        codes = np.zeros(size + (depth + 1) * per + 1, U64)
        if len(vocabulary):
            near = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
            codes[self.place] = np.where(vocabulary[near] == words.hash, near + 1, 0).astype(U64)
        unknown = np.where(codes == 0, np.arange(len(codes)), len(codes))
        run = np.minimum.accumulate(unknown[::-1])[::-1] - np.arange(len(codes))
        kept = np.flatnonzero(run >= tests["shortest"])
        self.run = run
        self.packed = np.zeros(size + depth * per + 1, U64)
        if not len(kept):
            self.suffix = kept
            return
        for k in range(per):
            self.packed |= codes[k : k + len(self.packed)] << U64(bits * (per - 1 - k))
        self.suffix = self._sorted(kept, depth)

    def _sorted(self, kept: np.ndarray, depth: int) -> np.ndarray:
        order = kept[np.argsort(self.packed[kept], kind="stable")]
        keys = self.packed[order]
        new = np.concatenate([[True], keys[1:] != keys[:-1]])
        for d in range(1, depth):
            group = np.cumsum(new)
            tied = np.flatnonzero(~(new & np.concatenate([new[1:], [True]])))
            if not len(tied):
                break
            deeper = self.packed[order[tied] + d * self.per]
            by = np.lexsort((deeper, group[tied]))
            order[tied] = order[tied][by]
            deeper, of = deeper[by], group[tied][by]
            new[tied] = np.concatenate([[True], (deeper[1:] != deeper[:-1]) | (of[1:] != of[:-1])])
        return order

    def bound(self, queries: Suffixes | Windows, upper: bool) -> np.ndarray:
        """Number of suffixes below each query (at or below, if ``upper``), by binary search."""
        low, high = np.zeros(len(queries), np.int64), np.full(len(queries), len(self.suffix), np.int64)
        open_ = np.flatnonzero(low < high)
        while len(open_):
            mid = (low[open_] + high[open_]) // 2
            at, before, tied = self.suffix[mid], np.full(len(open_), upper), np.arange(len(open_))
            for d in range(queries.depth):
                have, want = self.packed[at[tied] + d * self.per], queries.at(open_[tied], d)
                before[tied] = (have < want) | ((have == want) & upper)
                tied = tied[have == want]
                if not len(tied):
                    break
            low[open_[before]] = mid[before] + 1
            high[open_[~before]] = mid[~before]
            open_ = open_[low[open_] < high[open_]]
        return low

    def longest(self, queries: Suffixes, length: np.ndarray, bits: int) -> np.ndarray:
        """Words of the longest verbatim match of each test suffix: the better of its two neighbours in the array."""
        at, best = self.bound(queries, False), np.zeros(len(queries), np.int64)
        for near in (at - 1, at):
            some = np.flatnonzero((near >= 0) & (near < len(self.suffix)))
            place, same, going = self.suffix[near[some]], np.zeros(len(some), np.int64), np.arange(len(some))
            for d in range(queries.depth):
                differ = self.packed[place[going] + d * self.per] ^ queries.at(some[going], d)
                for k in range(self.per):
                    going_on = (differ >> U64(bits * (self.per - 1 - k))) == 0
                    same[going[going_on]] += 1
                going = going[differ == 0]
                if not len(going):
                    break
            best[some] = np.maximum(best[some], np.minimum(same, np.minimum(length[some], self.run[place])))
        return best


def _mark(words: Words, tests: dict) -> tuple[list, list, list]:
    """Hit word ranges, item names and longest match of each text of a block."""
    n = len(words.count)
    hits, items, longest = [[] for _ in range(n)], [[] for _ in range(n)], [0] * n
    shard = Shard(words, tests)
    if not len(shard.suffix) or not len(tests["need"]):
        return hits, items, longest
    match = shard.longest(Suffixes(tests), tests["left"], tests["bits"])
    found = np.flatnonzero(match >= tests["need"])
    first, past = shard.bound(Windows(tests["low"][found]), False), shard.bound(Windows(tests["high"][found]), True)
    places = shard.suffix[ragged(first, past - first)]
    which = np.repeat(found, past - first)
    covered = merged_cover(places, places + tests["need"][which], len(shard.run))[shard.place]
    turn = np.diff(np.concatenate([[0], covered.astype(np.int8), [0]]))
    doc = words.doc
    edge = np.zeros(len(covered) + 1, bool)
    edge[words.first] = True
    begin = np.flatnonzero(covered & ((turn[:-1] == 1) | edge[:-1]))
    end = np.flatnonzero(covered & ((turn[1:] == -1) | edge[1:])) + 1
    for b, e in zip(begin, end):
        hits[doc[b]].append({"start": int(b - words.first[doc[b]]), "stop": int(e - words.first[doc[b]])})
    of = np.searchsorted(shard.begin, places, "right") - 1
    for d, i in np.unique(np.stack([of, tests["item"][which]], 1), axis=0):
        if tests["names"][i] is not None:
            items[d].append(tests["names"][i])
    for d, m in zip(of, match[which]):
        longest[d] = max(longest[d], int(m))
    return hits, items, longest


def _join_ranges(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for r in sorted([*a, *b], key=lambda r: (r["start"], r["stop"])):
        if out and r["start"] <= out[-1]["stop"]:
            out[-1]["stop"] = max(out[-1]["stop"], r["stop"])
        else:
            out.append(dict(r))
    return out


def match_items(docs: DataFrame, items: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Columns of ``docs`` (``doc_id``, ``text`` and any others) with ``n_words``, ``hits``, ``items`` and ``longest``.

    ``hits`` are the ranges of words inside an occurrence of a window of ``items`` (``item_id``, ``text``), ``items``
    the names of the items whose windows occur, ``longest`` the words of the longest verbatim match that reaches a
    window's length. Null or wordless texts have no words and no hits; items without words search for nothing; an
    item without id marks words but is not named; rows that repeat an id are one item; repeated documents each get
    their row. Output keeps every input row.
    """
    spark = docs.sparkSession
    asked = items.select(F.col("item_id").cast("string"), F.coalesce("text", F.lit("")))
    own = [f for f in docs.schema.fields]
    out = docs
    for number, block in enumerate(item_blocks(asked, block_bytes, window)):
        shared = spark.sparkContext.broadcast(test_suffixes(block, window))

        def run(batches: Iterable[pa.RecordBatch], shared=shared, earlier=number > 0) -> Iterator[pa.RecordBatch]:
            tests = shared.value
            for part in text_blocks(batches, SHARD_BYTES):
                words = Words(part.column("text"), WORD_BYTES, lower=True)
                hits, names, longest = _mark(words, tests)
                if earlier:
                    hits = [_join_ranges(a, b) for a, b in zip(part.column("hits").to_pylist(), hits)]
                    names = [sorted({*a, *b}) for a, b in zip(part.column("items").to_pylist(), names)]
                    longest = [max(a, b) for a, b in zip(part.column("longest").to_pylist(), longest)]
                    part = part.drop_columns(["n_words", "hits", "items", "longest"])
                names = [sorted(set(x)) for x in names]
                part = part.append_column("n_words", pa.array(words.count, pa.int64()))
                part = part.append_column("hits", pa.array(hits, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))))
                part = part.append_column("items", pa.array(names, pa.list_(pa.string())))
                part = part.append_column("longest", pa.array(longest, pa.int64()))
                yield from part.combine_chunks().to_batches()

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
        out = out.mapInArrow(run, f"{schema}, n_words bigint, {MARKED}")
    return out


def decontaminate(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without a word inside an occurrence of a test window; columns as they were, null texts stay."""
    apart, names = set_apart(docs, "text")
    return match_items(apart, items, window).filter(F.size("hits") == 0).select(*apart.columns).toDF(*names)


def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = match_items(texts_of(table(spark, folder, "documents")), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, r: a + r.stop - r.start)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"),
    )


SQL = r"""
with cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents
), asked as (
  select item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark
), sized as (select item_id, w, least(10, len(w)) n from asked where len(w) > 0),
item_windows as (
  select distinct item_id, n, array_to_string(w[i + 1:i + n], ' ') as words from (select item_id, w, n, unnest(range(len(w) - n + 1)) i from sized)
), starts as (
  select doc_id, w, n, unnest(range(len(w) - n + 1)) i from cut, (select distinct n from sized) where len(w) >= n
), found as (
  select doc_id, i, s.n, item_id from starts s join item_windows t on s.n = t.n and array_to_string(s.w[s.i + 1:s.i + s.n], ' ') = t.words
), words as (
  select doc_id, count(distinct p) n_hit from (select doc_id, unnest(range(i, i + n)) p from found) group by doc_id
), named as (
  select doc_id, count(*) n_items, string_agg(item, ',' order by item) names from (select distinct doc_id, cast(item_id as varchar) item from found) group by doc_id
)
select doc_id, len(w) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from cut left join words using (doc_id) left join named using (doc_id)
"""
