"""Large JSON array files read by many tasks.

A file is read in fragments that end at a closing brace, which Spark's text reader cuts out of any byte range. What
a fragment does to the state of a scanner (inside a string or not, depth of the brackets) is known for either state it
may begin in, so each byte range is summed up once without knowing what lies before it; the sums of the ranges, one row
each, are chained, and a second pass cuts every range into elements. An element that runs over a border between ranges
comes out in parts, which are put together by file and place.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MARKS = re.compile(r'["\\{}\[\]]')
STRING_MARKS = re.compile(r'["\\]')


def scan(text: str, quoted: bool, depth: int) -> Iterator[tuple[int, bool, int]]:
    """(position after the mark, inside a string, depth) at every bracket and quote that counts."""
    at, end = 0, len(text)
    while at < end:
        found = (STRING_MARKS if quoted else MARKS).search(text, at)
        if found is None:
            return
        mark, at = found.group(), found.end()
        if mark == "\\":
            at += quoted  # the escaped character means nothing
            continue
        if mark == '"':
            quoted = not quoted
        elif mark in "{[":
            depth += 1
        else:
            depth -= 1
        yield at, quoted, depth


def after(text: str, quoted: bool, depth: int) -> tuple[bool, int]:
    """State of the scanner behind a text."""
    for _, quoted, depth in scan(text, quoted, depth):
        pass
    return quoted, depth


def _fragments(spark: SparkSession, path: str) -> DataFrame:
    """(file, start, value): text up to each closing brace, and the byte range it begins in; fragments of a range are in order."""
    lines = spark.read.option("lineSep", "}").text(path)
    return lines.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), "value")


def _ranges(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[str, int, Iterator[str]]]:
    """The fragments of a task, range by range."""
    rows = ((f, s, v) for b in batches for f, s, v in zip(*(b.column(i).to_pylist() for i in range(3))))
    row = next(rows, None)
    while row is not None:
        file, start = row[:2]

        def own(first=row):
            nonlocal row
            row = first
            while row is not None and row[:2] == (file, start):
                yield row[2]
                row = next(rows, None)

        yield file, start, own()


def array_elements(spark: SparkSession, path: str) -> DataFrame:
    """(file, place, element): the objects of JSON array files, each as one line of text; ``place`` orders those of a file."""
    fragments = _fragments(spark, path)

    def sums(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, texts in _ranges(batches):
            states = [(False, 0), (True, 0)]
            for text in texts:
                states = [after(text + "}", *s) for s in states]
            columns = [[file], [start], [states[0][0]], [states[0][1]], [states[1][0]], [states[1][1]]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["file", "start", "quoted0", "depth0", "quoted1", "depth1"])

    # one row a byte range, as many as the scan has tasks
    known = fragments.mapInArrow(sums, "file string, start bigint, quoted0 boolean, depth0 bigint, quoted1 boolean, depth1 bigint").collect()
    begins: dict[tuple[str, int], tuple[bool, int]] = {}
    state, file = (False, 0), None
    for r in sorted(known, key=lambda r: (r["file"], r["start"])):
        if r["file"] != file:
            state, file = (False, 0), r["file"]
        begins[r["file"], r["start"]] = state
        quoted, depth = state
        state = (r["quoted1"], depth + r["depth1"]) if quoted else (r["quoted0"], depth + r["depth0"])
    shared = spark.sparkContext.broadcast(begins)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for file, start, texts in _ranges(batches):
            quoted, depth = shared.value[file, start]
            # depth 1 is the array itself; what is open at the border is the end of an element that began before
            part: list[str] = []
            inside, whole, number = depth > 1, depth <= 1, 0
            out: list[tuple] = []
            for text in texts:
                text += "}"
                begin = 0
                for at, quoted, depth in scan(text, quoted, depth):
                    if not inside and depth == 2 and not quoted and text[at - 1] == "{":
                        inside, begin, whole, part = True, at - 1, True, []
                    elif inside and depth == 1 and not quoted:
                        part.append(text[begin:at])
                        out.append((file, start, number, whole, "".join(part)))
                        number, inside, part = number + 1, False, []
                if inside:
                    part.append(text[begin:])
                if len(out) >= 1024:
                    yield _rows(out)
                    out = []
            if inside and part:
                out.append((file, start, number, False, "".join(part)))
            if out:
                yield _rows(out)

    pieces = fragments.mapInArrow(cut, "file string, start bigint, number bigint, whole boolean, text string")
    one_line = F.translate("text", "\r\n", "  ").alias("element")  # neither stands in a string of JSON
    whole = pieces.filter("whole").select("file", F.struct("start", "number").alias("place"), one_line)
    # at most two parts a range: a tail that goes on in the next ranges and ends in one of them
    split = pieces.filter("NOT whole")
    ends = split.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "number", "text"))).alias("parts"))
    joined = ends.mapInArrow(_put_together, "file string, start bigint, number bigint, text string")
    return whole.unionByName(joined.select("file", F.struct("start", "number").alias("place"), one_line))


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names=["file", "start", "number", "whole", "text"])


def _put_together(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Parts in order of their places; an element is complete where its brackets are closed."""
    for batch in batches:
        for file, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            held, state, begun = [], (False, 0), None
            for p in parts:
                begun = begun or (p["start"], p["number"])
                held.append(p["text"])
                state = after(p["text"], *state)
                if state == (False, 0):
                    yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (file, *begun, "".join(held))], names=["file", "start", "number", "text"])
                    held, begun = [], None
