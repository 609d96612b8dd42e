"""Near-duplicate documents by bottom-k sketches of one hash function.

1. A document's sketch holds the ``SKETCH`` smallest hashes of its distinct 5-word shingles. Documents with equal sets
   are one class; from here on a class is its smallest document.
2. Inverted lists: retained values that two or more classes hold. Two classes with the wanted similarity share at
   least ``overlap_of`` retained values, so they also share one of the first ``size - overlap + 1`` values of their
   sketches in an order common to all, rarest value first (prefix filter). Only those entries go into lists; a value
   of a passage that many documents share is late in that order and rarely enters.
3. Candidates: the members of a list meet the list's centre (its member with the fewest values of its own), not each
   other. The union of two sketches estimates the similarity, what passes is verified on full sets, and links give
   components.
4. Lists whose members are now in one component are settled. The members of the others are compared again on all their
   shingles, so that no link is lost: shingles in an order common to all, rarest first, give each document a prefix,
   and a shared shingle at one position bounds the overlap, hence the size of a partner. Entries meet under the shingle
   and a band of sizes, the smaller set as host. Of a group's entries only those outside its largest component meet
   the others; two members of one component never meet. What is left is verified like before.

Sketches of 64 values: for a pair at exactly the threshold, the number of shared values is at least a binomial with
64 draws of 0.85; it falls below 38 with a chance of about 10^-7. Sets below 55 shingles use the exact bound.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseflow.llm.components import components
from caseflow.llm.shared import BASES, SPACES, U64, Words, byte_table, mix, rolling, set_apart, signed, staged, table, text_blocks, texts_of

SHINGLE = 5
SKETCH = 64
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 85
#: Least number of shared retained values, for sketches cut at SKETCH.
OVERLAP = 38
#: Ratio of the sizes in neighbouring bands.
BAND = 0.95
BLOCK_BYTES = 1 << 20

WORD_BYTES = byte_table(SPACES)


def shingle_sets(column) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text; with fewer words than a shingle, the whole sequence is one."""
    words = Words(column, WORD_BYTES, lower=True)
    size = np.minimum(SHINGLE, words.count)
    many = np.maximum(words.count - SHINGLE + 1, (words.count > 0).astype(np.int64))
    at = np.arange(len(words.hash))
    at = at[at < np.repeat(words.first[:-1] + many, words.count)]
    hashes = rolling(words.hash, at, at + np.repeat(size, many), BASES[0])
    ends = np.cumsum(many)
    for end, n in zip(ends, many):
        own = np.sort(hashes[end - n : end])
        yield own[np.concatenate([[True], own[1:] != own[:-1]])] if n else own


def _sketches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches, BLOCK_BYTES):
        count, left, right, kept = [], [], [], []
        for own in shingle_sets(block.column("text")):
            count.append(len(own))
            left.append(mix(own).sum(dtype=U64))
            right.append(mix(own ^ U64(BASES[1])).sum(dtype=U64))
            kept.append(signed(own[:SKETCH]))
        size = np.array([len(x) for x in kept])
        flat = np.concatenate(kept) if kept else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays(
            [
                block.column("doc_id").combine_chunks(), block.column("own").combine_chunks(), pa.array(count, pa.int64()), pa.array(signed(np.array(left, U64))),
                pa.array(signed(np.array(right, U64))),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), pa.array(flat)),
            ],
            names=["doc_id", "own", "n_shingles", "left", "right", "sketch"],
        )


def overlap_of(n):
    """Least shared retained values of a set of ``n`` shingles with any set it links to."""
    return F.when(n * 100 <= SKETCH * PERCENT, F.ceil(n * PERCENT / 100)).otherwise(F.lit(OVERLAP)).cast("int")


def _likely(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose union sketch holds enough values of both."""
    for batch in batches:
        keep = []
        for a, b in zip(*(_lists(batch.column(c)) for c in ("sketch_a", "sketch_b"))):
            a, b = a.view(U64), b.view(U64)
            union = np.union1d(a, b)[:SKETCH]
            both = np.intersect1d(a, b, assume_unique=True)
            keep.append(np.count_nonzero(both <= union[-1]) * SKETCH >= OVERLAP * len(union))
        yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _lists(column) -> Iterator[np.ndarray]:
    ends, flat = column.offsets.to_numpy(), column.values.to_numpy()
    return (flat[x:y] for x, y in zip(ends[:-1], ends[1:]))


def _linked(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs whose full sets reach the threshold."""
    for block in text_blocks(batches, 2 * BLOCK_BYTES, "text_a"):
        for part in text_blocks(block.to_batches(), 2 * BLOCK_BYTES, "text_b"):
            sets = zip(shingle_sets(part.column("text_a")), shingle_sets(part.column("text_b")))
            both = [(len(np.intersect1d(a, b, assume_unique=True)), len(a) + len(b)) for a, b in sets]
            keep = pa.array([100 * i >= PERCENT * (n - i) for i, n in both], pa.bool_())
            yield from part.select(["a", "b"]).filter(keep).combine_chunks().to_batches()


def _verified(pairs: DataFrame, sketches: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (``a`` < ``b``) that link, first by union sketch, then on full sets."""

    def sides(pairs: DataFrame, of: DataFrame, name: str) -> DataFrame:
        for side in ("a", "b"):
            pairs = pairs.join(of.select(F.col("doc_id").alias(side), F.col(name).alias(f"{name}_{side}")), side)
        return pairs

    likely = staged(sides(pairs, sketches, "sketch").mapInArrow(_likely, "a bigint, b bigint"), "likely")
    return staged(sides(likely, texts, "text").mapInArrow(_linked, "a bigint, b bigint"), "links")


def _values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in text_blocks(batches, BLOCK_BYTES):
        sets = [signed(s) for s in shingle_sets(block.column("text"))]
        ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
        held = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets)))
        yield pa.RecordBatch.from_arrays([*(block.column(c).combine_chunks() for c in ("doc_id", "label")), held], names=["doc_id", "label", "held"])


def _rest(texts: DataFrame, members: DataFrame) -> DataFrame:
    """All pairs ``(a, b)`` of ``members`` (``doc_id``, ``label``) with different labels that can still link."""
    whole = texts.join(members, "doc_id").select("doc_id", "label", "text")
    sets = staged(whole.mapInArrow(_values, "doc_id bigint, label bigint, held array<bigint>"), "sets")
    held = sets.select("doc_id", "label", F.size("held").cast("long").alias("n"), F.explode("held").alias("value"))
    common = staged(held.groupBy("value").agg(F.count("*").alias("held_by")).filter("held_by > 1"), "shared")
    n = F.col("n")
    room = F.floor(((n - F.col("at")) * (100 + PERCENT) - n * PERCENT) / PERCENT)
    band = lambda size: F.floor(F.ln(size.cast("double")) / F.lit(-np.log(BAND).item())).cast("int")
    entries = staged(
        held.join(common, "value").groupBy("doc_id", "label", "n").agg(F.array_sort(F.collect_list(F.struct("held_by", "value"))).alias("shared"))
        .select("doc_id", "label", "n", (n - F.size("shared")).alias("alone"), F.posexplode("shared").alias("at", "entry"))
        .select("doc_id", "label", "n", "entry.value", (F.col("alone") + F.col("at")).alias("at"))
        .filter(F.col("at") <= n - F.ceil(n * PERCENT / 100)).withColumn("room", room), "entries",
    )
    hosts = entries.filter("room >= n").withColumn("band", band(n))
    probes = entries.filter(F.col("room") * 100 >= n * PERCENT).withColumn("band", F.explode(F.sequence(band(F.ceil(n * PERCENT / 100)), band(F.least("room", "n")))))
    key = ["value", "band"]
    labels = hosts.select(*key, "label").unionByName(probes.select(*key, "label")).groupBy(*key, "label").agg(F.count("*").alias("rows"))
    mixed = staged(
        labels.groupBy(*key).agg(F.count("*").alias("labels"), F.max(F.struct("rows", "label")).alias("most")).filter("labels > 1").select(*key, F.col("most.label").alias("major")), "mixed",
    )
    hosts, probes = (x.join(mixed, key).withColumn("minor", F.col("label") != F.col("major")) for x in (hosts, probes))
    probes = probes.select(*key, *[F.col(c).alias(f"{c}_x") for c in ("doc_id", "label", "n", "room", "minor")])
    can = (F.col("label") != F.col("label_x")) & (n <= F.col("room_x")) & (F.col("n_x") <= F.col("room")) & ((n < F.col("n_x")) | ((n == F.col("n_x")) & (F.col("doc_id") < F.col("doc_id_x"))))
    met = [p.join(h, key).filter(can).select("doc_id", "doc_id_x") for p, h in ((probes, hosts.filter("minor")), (probes.filter("minor_x"), hosts.filter("not minor")))]
    return met[0].unionByName(met[1]).select(F.least("doc_id", "doc_id_x").alias("a"), F.greatest("doc_id", "doc_id_x").alias("b")).distinct()


def _grouped(texts: DataFrame) -> DataFrame:
    """``(doc_id, own, n_shingles, group)`` for every row of ``texts`` (``doc_id``, here the number of a row, ``own``, ``text``)."""
    seen = staged(texts.mapInArrow(_sketches, "doc_id bigint, own bigint, n_shingles bigint, `left` bigint, `right` bigint, sketch array<bigint>"), "sketches")
    key = ["left", "right", "n_shingles"]
    classes = staged(seen.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("rep")), "classes")
    reps = staged(seen.select("doc_id", "n_shingles", "sketch").join(classes.select(F.col("rep").alias("doc_id")), "doc_id"), "reps")
    held = reps.select("doc_id", "n_shingles", F.explode("sketch").alias("value"))
    common = staged(held.groupBy("value").agg(F.count("*").alias("held_by")).filter("held_by > 1"), "values")
    size = F.least("n_shingles", F.lit(SKETCH))
    lists = staged(
        held.join(common, "value").groupBy("doc_id", "n_shingles")
        .agg(F.array_sort(F.collect_list(F.struct("held_by", "value"))).alias("shared"))
        .withColumn("take", size - overlap_of(F.col("n_shingles")) + 1 - (size - F.size("shared")))
        .filter("take > 0").select("doc_id", (size - F.size("shared")).alias("alone"), F.explode(F.slice("shared", 1, F.col("take").cast("int"))).alias("entry"))
        .select("doc_id", "alone", "entry.value"), "lists",
    )
    centres = staged(
        lists.groupBy("value").agg(F.min(F.struct("alone", "doc_id")).alias("least"), F.count("*").alias("members")).filter("members > 1")
        .select("value", F.col("least.doc_id").alias("centre")), "centres",
    )
    first = lists.join(centres, "value").filter("doc_id <> centre").select(F.least("doc_id", "centre").alias("a"), F.greatest("doc_id", "centre").alias("b")).distinct()
    # the one time that texts are shuffled: those of list members, for everything that follows
    listed = staged(lists.join(centres, "value").select("doc_id").distinct(), "listed")
    whole = staged(texts.select("doc_id", "text").join(listed, "doc_id"), "texts")
    sketches = staged(reps.select("doc_id", "sketch").join(listed, "doc_id"), "listed")
    links = _verified(first, sketches, whole)
    found = components(links)
    placed = staged(
        lists.join(centres, "value").join(found.withColumnRenamed("node", "doc_id"), "doc_id", "left")
        .select("value", "doc_id", F.coalesce("label", "doc_id").alias("label")), "placed",
    )
    unsettled = staged(placed.groupBy("value").agg(F.min("label").alias("low"), F.max("label").alias("high")).filter("low < high").select("value"), "unsettled")
    more = _verified(_rest(whole, placed.join(unsettled, "value").select("doc_id", "label").distinct()), sketches, whole)
    found = components(links.unionByName(more))
    of_class = staged(classes.join(found.withColumnRenamed("node", "rep"), "rep", "left").select(*key, F.coalesce("label", "rep").alias("group")), "components")
    return seen.select("doc_id", "own", *key).join(of_class, key, "left").select("doc_id", "own", "n_shingles", F.coalesce("group", "doc_id").alias("group"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` for every row of ``docs`` (``doc_id``, ``text``); links as in the module text.

    Rows are numbered as they are written, and all work is on those numbers; so rows that repeat a document, that share
    an id but not the text, or that have no id are told apart. ``component_id`` is the smallest id in the component, for
    rows without id as well; null if no row of it has one. Null, empty and wordless texts have no shingles and are
    components of their own.
    """
    numbered = texts_of(docs).select(F.monotonically_increasing_id().alias("doc_id"), F.col("doc_id").cast("bigint").alias("own"), "text")
    grouped = staged(_grouped(staged(numbered, "rows")), "groups")
    low = grouped.groupBy("group").agg(F.min("own").alias("component_id"))
    return grouped.join(low, "group").select(F.col("own").alias("doc_id"), "n_shingles", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One row of each group stays: the one with the smallest id, or any of a group without ids. Rows without words all stay."""
    apart, names = set_apart(docs, "doc_id", "text")
    rows = staged(apart.withColumn("row", F.monotonically_increasing_id()), "rows")
    grouped = _grouped(rows.select(F.col("row").alias("doc_id"), F.col("doc_id").cast("bigint").alias("own"), F.coalesce("text", F.lit("")).alias("text")))
    kept = grouped.groupBy("group").agg(F.min(F.struct(F.col("own").isNull().alias("none"), "own", "doc_id")).alias("first"))
    return rows.join(kept.select(F.col("first.doc_id").alias("row")), "row", "left_semi").select(*apart.columns).toDF(*names)


def op10_neardup(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates(table(spark, folder, "documents")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


SQL = r"""
with recursive cut as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') w from documents
), shingles as (
  select distinct doc_id, array_to_string(w[i + 1:i + 5], ' ') s from (select doc_id, w, unnest(range(greatest(len(w) - 4, 1))) i from cut where len(w) > 0)
), sized as (select doc_id, count(*) n from shingles group by doc_id),
links as (
  select a, b from (select x.doc_id a, y.doc_id b, count(*) shared from shingles x join shingles y on x.s = y.s and x.doc_id <> y.doc_id group by all)
  join sized p on p.doc_id = a join sized q on q.doc_id = b where 100 * shared >= 85 * (p.n + q.n - shared)
), reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a)
select doc_id, coalesce(n, 0) n_shingles, least(doc_id, coalesce(low, doc_id)) component_id, least(doc_id, coalesce(low, doc_id)) = doc_id kept
from cut left join sized using (doc_id) left join (select a doc_id, min(b) low from reach group by a) using (doc_id)
"""
