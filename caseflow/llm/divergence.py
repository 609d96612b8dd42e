"""Source divergence audit: how far the term use of each source is from the other sources and from its language.

Single-pass in-memory indexing. Each task reads its texts once and builds a block of postings (term, source, count,
documents) until ``block_bytes`` are held; then the block is spilled as a run sorted by (shard, language, term), packed
in rows of at most ``ROW_POSTINGS`` postings. A shard is a hash range of the terms. Spark brings the rows of a shard
together in order of their first terms, and one heap merges them: a row is opened when its first term is due, so that a
task holds one open row a run and no more.

Distances between sources are sums over all kept terms. They are not built term by term for every pair: with p0 the
share of a term that a source lacks, ``sum |p - q|`` is the value for terms that both lack, plus one sum for each
source alone (from prefix sums over its shares), plus a correction for each term that both have. Only the corrections
are streamed over the postings; tasks add theirs up before the shuffle.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.shared import U64, Words, byte_table, ragged, staged, table, text_blocks, word_hash

MIN_DOCS = 30
SCALE = 1_000_000_000
SMOOTH = 5
TOP_TERMS = 50
TEXT_BYTES = 2 << 20
BLOCK_BYTES = 64 << 20
ROW_POSTINGS = 8192
PAIRS_HELD = 1 << 20
#: Terms are runs of ASCII letters and characters beyond ASCII.
TERM_BYTES = byte_table([*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
RUN = "shard int, lang string, first binary, terms array<binary>, docs array<bigint>, sizes array<int>, names array<string>, codes array<int>, counts array<bigint>"
FREQUENCY = "lang string, term string, source string, count bigint, total bigint, first boolean"


def sums_by_key(keys: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order and the sum of each array of values by key."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    new = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    return keys[new], *[np.add.reduceat(v[order], new) if len(new) else v[:0] for v in values]


def _encoded(array: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Distinct values and the number of each entry's value."""
    found = array.dictionary_encode()
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False).astype(np.int64)


class Block:
    """Postings held in memory: sums by (source, term), with the distinct terms as one Arrow array."""

    def __init__(self):
        self.groups: dict[tuple[str, str], int] = {}
        self.parts: list[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        self.size = 0

    def add(self, texts: pa.Table) -> None:
        """Count the terms of a table of texts; each (language, source) also gets the empty term, with a count of 0."""
        names = zip(texts.column("lang").to_pylist(), texts.column("source").to_pylist())
        group = np.array([self.groups.setdefault(n, len(self.groups)) for n in names], np.int64)
        words = Words(texts.column("text"), TERM_BYTES, lower=True, hashed=False)
        here = np.unique(group)
        self._hold(pa.array([b""], pa.large_binary()), here, np.zeros(len(here), np.int64), np.zeros(len(here), np.int64), np.zeros(len(here), np.int64))
        n = len(words.start)
        if not n:
            return
        # one array of words and the gaps between them, over the bytes as they are
        cuts = np.empty(2 * n, np.int64)
        cuts[0::2], cuts[1::2] = words.start, words.stop
        terms, code = _encoded(pa.Array.from_buffers(pa.large_binary(), 2 * n - 1, [None, pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(words.body))]))
        code, width = code[::2], len(terms)
        in_text, count = sums_by_key(words.doc * width + code, np.ones(n, np.int64))
        keys, count, docs = sums_by_key(group[in_text // width] * width + in_text % width, count, np.ones(len(in_text), np.int64))
        self._hold(terms, keys // width, keys % width, count, docs)

    def _hold(self, terms, group, code, count, docs) -> None:
        self.parts.append((terms, group, code, count, docs))
        self.size += terms.nbytes + 32 * len(group)

    def combine(self) -> None:
        """One part instead of many: equal terms become one."""
        if len(self.parts) < 2:
            return
        ends = np.cumsum([0] + [len(p[0]) for p in self.parts])
        terms, renumbered = _encoded(pa.concat_arrays([p[0] for p in self.parts]))
        group = np.concatenate([p[1] for p in self.parts])
        code = renumbered[np.concatenate([p[2] + e for p, e in zip(self.parts, ends)])]
        width = len(terms)
        keys, count, docs = sums_by_key(group * width + code, np.concatenate([p[3] for p in self.parts]), np.concatenate([p[4] for p in self.parts]))
        used, code = np.unique(keys % width, return_inverse=True)  # gaps are no terms
        self.parts, self.size = [], 0
        self._hold(terms.take(pa.array(used)), keys // width, code, count, docs)

    def spill(self, shards: int) -> Iterator[pa.RecordBatch]:
        """The rows of one run; the block is empty afterwards."""
        self.combine()
        if not self.parts:
            return
        terms, group, code, count, docs = self.parts[0]
        names = sorted(self.groups, key=self.groups.get)
        langs = sorted({n[0] for n in names})
        lang = np.array([langs.index(n[0]) for n in names], np.int64)[group]
        order = pc.sort_indices(terms).to_numpy(zero_copy_only=False)
        place = np.empty(len(terms), np.int64)
        place[order] = np.arange(len(terms))
        shard = shard_of(terms, shards)[code]
        by = np.lexsort((group, place[code], lang, shard))
        group, code, count, docs, lang, shard = (x[by] for x in (group, code, count, docs, lang, shard))
        self.__init__()
        new_term = np.concatenate([[True], (code[1:] != code[:-1]) | (lang[1:] != lang[:-1])])
        new_part = np.concatenate([[True], (shard[1:] != shard[:-1]) | (lang[1:] != lang[:-1])])
        heads = np.append(np.flatnonzero(new_term), len(code))
        rows, start = [], 0
        for i in range(len(heads) - 1):  # terms stay whole
            at, end = heads[i], heads[i + 1]
            if i and (new_part[at] or end - heads[start] > ROW_POSTINGS):
                rows.append((start, i))
                start = i
        rows.append((start, len(heads) - 1))
        out = []
        for first, last in rows:
            a, b = heads[first], heads[last]
            found, codes = np.unique(group[a:b], return_inverse=True)
            own = terms.take(pa.array(code[heads[first:last]])).to_pylist()
            out.append(
                (
                    int(shard[a]), langs[lang[a]], own[0], own, np.add.reduceat(docs[a:b], heads[first:last] - a).tolist(),
                    np.diff(heads[first : last + 1]).tolist(), [names[g][1] for g in found.tolist()], codes.tolist(), count[a:b].tolist(),
                )
            )
            if len(out) == 64:
                yield _batch(out, RUN_TYPE)
                out = []
        if out:
            yield _batch(out, RUN_TYPE)


RUN_TYPE = pa.schema(
    [
        ("shard", pa.int32()), ("lang", pa.string()), ("first", pa.binary()), ("terms", pa.list_(pa.binary())), ("docs", pa.list_(pa.int64())),
        ("sizes", pa.list_(pa.int32())), ("names", pa.list_(pa.string())), ("codes", pa.list_(pa.int32())), ("counts", pa.list_(pa.int64())),
    ]
)
FREQUENCY_TYPE = pa.schema([("lang", pa.string()), ("term", pa.string()), ("source", pa.string()), ("count", pa.int64()), ("total", pa.int64()), ("first", pa.bool_())])


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)


def shard_of(terms: pa.Array, shards: int) -> np.ndarray:
    """Shard of each term; the empty term of the group markers is in shard 0."""
    _, ends, data = terms.cast(pa.large_binary()).buffers()
    cuts = np.frombuffer(ends, np.int64)[terms.offset : terms.offset + len(terms) + 1]
    body = np.concatenate([np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(8, np.uint8)])
    return np.where(cuts[1:] > cuts[:-1], (word_hash(body, cuts[:-1], cuts[1:]) % U64(shards)).astype(np.int64), 0)


def spilled_runs(docs: DataFrame, shards: int, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Runs of all tasks (``RUN``), one scan of the texts."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, limit = Block(), block_bytes
        for texts in text_blocks(batches, TEXT_BYTES):
            block.add(texts)
            if block.size > limit:
                block.combine()
                if block.size > block_bytes // 2:
                    yield from block.spill(shards)
        yield from block.spill(shards)

    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    return texts.mapInArrow(run, RUN)


def merge_runs(rows: Iterable[dict], min_docs: int) -> Iterator[tuple]:
    """Frequencies of the terms in at least ``min_docs`` documents of their language, from rows in order of (shard, lang, first)."""
    rows = iter(rows)
    heap, due, number = [], next(rows, None), 0
    while heap or due is not None:
        while due is not None and (not heap or (due["shard"], due["lang"], due["first"]) <= heap[0][:3]):
            ends = np.concatenate([[0], np.cumsum(due["sizes"])]).tolist()
            heapq.heappush(heap, (due["shard"], due["lang"], due["first"], number, 0, due, ends))
            due, number = next(rows, None), number + 1
        key = heap[0][:3]
        docs, slices = 0, []
        while heap and heap[0][:3] == key:
            shard, lang, _, n, i, row, ends = heap[0]
            docs += row["docs"][i]
            slices.append((row, ends[i], ends[i + 1]))
            if i + 1 < len(row["terms"]):
                heapq.heapreplace(heap, (shard, lang, row["terms"][i + 1], n, i + 1, row, ends))
            else:
                heapq.heappop(heap)
            # a later row of the same term opens now
            while due is not None and (due["shard"], due["lang"], due["first"]) == key:
                ends = np.concatenate([[0], np.cumsum(due["sizes"])]).tolist()
                heapq.heappush(heap, (due["shard"], due["lang"], due["first"], number, 0, due, ends))
                due, number = next(rows, None), number + 1
        if docs < min_docs and key[2]:
            continue
        found: dict[str, int] = {}
        for row, a, b in slices:
            names = row["names"]
            for code, count in zip(row["codes"][a:b], row["counts"][a:b]):
                found[names[code]] = found.get(names[code], 0) + count
        total, term = sum(found.values()), key[2].decode()
        for i, (source, count) in enumerate(found.items()):
            yield key[1], term, source, count, total, i == 0


def term_frequencies(docs: DataFrame, min_docs: int = MIN_DOCS, shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(lang, term, source, count, total, first)``: count of each kept term by source, and in its language.

    ``first`` marks one row a term. Every (lang, source) has a row of the empty term with count 0. Null text, lang and
    source are empty. Repeated rows are documents of their own.
    """
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    shards = shards or 4 * parts

    def merge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for row in merge_runs((r for b in batches for i in range(b.num_rows) for r in b.slice(i, 1).to_pylist()), min_docs):
            out.append(row)
            if len(out) == 16384:
                yield _batch(out, FREQUENCY_TYPE)
                out = []
        if out:
            yield _batch(out, FREQUENCY_TYPE)

    runs = spilled_runs(docs, shards, block_bytes).repartition(parts, "shard").sortWithinPartitions("shard", "lang", "first")
    return runs.mapInArrow(merge, FREQUENCY)


def _share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(10^9 (count + 5) / (n + 5 v)), on decimals."""
    top = (count + F.lit(SMOOTH)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", top, (n + v * SMOOTH).cast("decimal(20,0)")).cast("bigint") + 1


def pair_corrections(shares: DataFrame, held: int = PAIRS_HELD) -> DataFrame:
    """``(lang, source, item, value)``: what the terms that two sources (source < item) both have change in their distance.

    ``shares`` has ``lang, term, source, p, p0``. Rows of a term come one after the other, sources in order; pairs are
    added up in the task and leave it when more than ``held`` are in hand.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number: dict[tuple[str, str], int] = {}
        keys, sums, rest = [], [], None

        def leave() -> pa.RecordBatch:
            key, total = sums_by_key(np.concatenate(keys), np.concatenate(sums))
            names = list(number)
            left, right = [names[i] for i in (key >> 31).tolist()], [names[i] for i in (key & 0x7FFFFFFF).tolist()]
            out = [[n[0] for n in left], [n[1] for n in left], [n[1] for n in right]]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out] + [pa.array(total)], names=["lang", "source", "item", "value"])

        def add(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            lang, source = rows.column("lang").to_pylist(), rows.column("source").to_pylist()
            p, p0 = (rows.column(c).to_numpy() for c in ("p", "p0"))
            code = np.array([number.setdefault(x, len(number)) for x in zip(lang, source)], np.int64)
            new = _borders(rows)
            end = np.append(new[1:], len(code))
            partners = np.repeat(end, end - new) - np.arange(len(code)) - 1
            reach = np.cumsum(partners)
            start = 0
            while start < len(code):  # about ``held`` pairs at a time
                stop = max(start + 1, int(np.searchsorted(reach, (reach[start - 1] if start else 0) + held, "right")))
                n = partners[start:stop]
                i, j = np.repeat(np.arange(start, stop), n), ragged(np.arange(start, stop) + 1, n)
                value = np.abs(p[i] - p[j]) - np.abs(p[i] - p0[j]) - np.abs(p0[i] - p[j]) + np.abs(p0[i] - p0[j])
                key, total = sums_by_key(code[i] << 31 | code[j], value)
                keys.append(key)
                sums.append(total)
                if sum(map(len, keys)) > held:
                    keys[:], sums[:] = [[x] for x in sums_by_key(np.concatenate(keys), np.concatenate(sums))]
                    if len(keys[0]) > held // 2:
                        yield leave()
                        keys.clear()
                        sums.clear()
                start = stop
            if not keys:
                number.clear()

        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows])
            last = int(_borders(rows)[-1]) if len(rows) else 0  # the last term may go on
            rest = rows.slice(last)
            yield from add(rows.slice(0, last))
        if rest is not None and len(rest):
            yield from add(rest)
        if keys:
            yield leave()

    by_term = shares.select("lang", "term", "source", "p", "p0").repartition("lang", "term").sortWithinPartitions("lang", "term", "source")
    return by_term.mapInArrow(run, "lang string, source string, item string, value bigint")


def _borders(rows: pa.Table) -> np.ndarray:
    """Where a new (lang, term) begins."""
    if not len(rows):
        return np.zeros(0, np.int64)
    change = np.ones(len(rows), bool)
    pairs = [pc.not_equal(rows.column(c).slice(1), rows.column(c).slice(0, len(rows) - 1)).to_numpy(zero_copy_only=False) for c in ("lang", "term")]
    change[1:] = pairs[0] | pairs[1]
    return np.flatnonzero(change)


def source_divergence(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP_TERMS, shards: int | None = None, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(lang, source, part, item, value, rank)`` from ``text, lang, source`` of ``docs``.

    Part ``pair``: distance of the source to each other source of its language; part ``term``: the ``top`` terms that
    the source uses more than its language does, by how much. Shares are whole billionths. An empty table gives no
    rows; a language without kept terms has pairs of value 0; null is ''. Columns beyond the three are ignored.
    """
    frequencies = staged(term_frequencies(docs, min_docs, shards, block_bytes), "frequencies")
    langs = frequencies.groupBy("lang").agg(F.count_if((F.col("term") != "") & F.col("first")).alias("v"), F.sum("count").alias("n_lang"))
    by_group = frequencies.groupBy("lang", "source").agg(F.sum("count").alias("n"))
    # a table of one row a source: written, so that the planner sees its size before it decides how to join
    groups = by_group.join(langs, "lang").withColumn("p0", F.when(F.col("v") > 0, _share(F.lit(0), F.col("n"), F.col("v"))).otherwise(0))
    groups = staged(groups, "groups")
    shares = frequencies.filter("term <> ''").join(groups, ["lang", "source"]).withColumns(
        {"p": _share(F.col("count"), F.col("n"), F.col("v")), "q": _share(F.col("total"), F.col("n_lang"), F.col("v"))}
    )

    # each source alone: sum over its terms of |p - p0 of the other|, from running sums over its shares
    alike = shares.groupBy("lang", "source", F.col("p").alias("at")).agg(F.count(F.lit(1)).alias("terms"))
    alike = alike.withColumns({"sum": F.col("terms") * F.col("at"), "item": F.lit(None).cast("string"), "own": F.lit(0).cast("bigint"), "v": F.lit(0).cast("bigint")})
    other = groups.select("lang", F.col("source").alias("item"), F.col("p0").alias("at"))
    asked = groups.select("lang", "source", F.col("p0").alias("own"), "v").join(other, "lang").filter("source <> item")
    asked = asked.withColumns({"terms": F.lit(0).cast("bigint"), "sum": F.lit(0).cast("bigint")})
    whole = Window.partitionBy("lang", "source")
    below = whole.orderBy("at").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    columns = ["lang", "source", "item", "at", "terms", "sum", "own", "v"]
    seen = alike.select(*columns).unionByName(asked.select(*columns)).select(
        "lang", "source", "item", "at", "own", "v",
        F.sum("terms").over(below).alias("n_below"), F.sum("sum").over(below).alias("s_below"),
        F.sum("terms").over(whole).alias("n_all"), F.sum("sum").over(whole).alias("s_all"),
    ).filter("item IS NOT NULL")
    gap = F.abs(F.col("own") - F.col("at"))
    alone = seen.select(
        "lang", "source", "item",
        (F.col("at") * (2 * F.col("n_below") - F.col("n_all")) + F.col("s_all") - 2 * F.col("s_below") - F.col("n_all") * gap).alias("value"),
        (gap * F.col("v")).alias("lacking"),
    )
    swapped = [F.col("item").alias("source"), F.col("source").alias("item")]
    both = pair_corrections(shares)
    parts = [
        alone.select("lang", "source", "item", (F.col("value") + F.col("lacking")).alias("value")), alone.select("lang", *swapped, "value"),
        both, both.select("lang", *swapped, "value"),
    ]
    summed = parts[0]
    for more in parts[1:]:
        summed = summed.unionByName(more)
    pairs = summed.groupBy("lang", "source", "item").agg(F.sum("value").alias("value")).withColumn("part", F.lit("pair"))
    terms = shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"), F.lit("term").alias("part"))
    order = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    ranked = pairs.withColumn("rank", F.row_number().over(order)).unionByName(terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top))
    return ranked.select("lang", "source", "part", "item", "value", "rank")


SQL = """
with d as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as doc,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') as words from documents),
  w as (select lang, source, doc, unnest(words) as term from d),
  kept as (select lang, term, count(*) as total from w group by 1, 2 having count(distinct doc) >= 30),
  groups as (select distinct lang, source from d),
  c as (select lang, source, term, count(*) as n from w semi join kept using (lang, term) group by 1, 2, 3),
  v as (select lang, count(*) as v, sum(total) as n_lang from kept group by 1),
  cells as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, k.total, sum(coalesce(c.n, 0)) over (partition by g.lang, g.source) as n_group
    from groups g join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
  p as (select cells.lang, source, term, n, 1 + (1000000000::hugeint * (n + 5)) // (n_group + 5 * v) as p,
    1 + (1000000000::hugeint * (total + 5)) // (n_lang + 5 * v) as q from cells join v on v.lang = cells.lang),
  pairs as (select a.lang, a.source, b.source as item, coalesce(s.value, 0) as value from groups a join groups b on a.lang = b.lang and a.source <> b.source
    left join (select x.lang, x.source, y.source as item, sum(abs(x.p - y.p)) as value from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3) s
      on s.lang = a.lang and s.source = a.source and s.item = b.source),
  found as (select lang, source, 'pair' as part, item, value::bigint as value from pairs union all
    select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as int) as rank from found)
where part = 'pair' or rank <= 50
"""


def op11_divergence(spark: SparkSession, folder: str) -> DataFrame:
    return source_divergence(table(spark, folder, "documents"))
