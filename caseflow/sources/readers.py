"""Readers: everything arrives as text and is typed in an explicit later step."""

from __future__ import annotations

import csv

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from caseflow.functions.typing import NUMBER_SHAPE, to_number
from caseflow.session import written_lines
from caseflow.sources.arrays import array_elements

DELIMITERS = [",", ";", "\t", "|"]
HEAD_LINES = 64

TX_LOG_SCHEMA = T.StructType(
    [
        T.StructField("op", T.StringType()),
        T.StructField("ts", T.DoubleType()),
        T.StructField("dry_run", T.BooleanType()),
        T.StructField("run_id", T.StringType()),
        T.StructField("path", T.StringType()),
        T.StructField("rows", T.LongType()),
        T.StructField("pre_exists", T.BooleanType()),
        T.StructField("created", T.BooleanType()),
        T.StructField("hash", T.StringType()),
        T.StructField("src", T.StringType()),
        T.StructField("dest", T.StringType()),
        T.StructField("ok", T.BooleanType()),
        T.StructField("prediction", T.StringType()),
        T.StructField("field", T.StringType()),
        T.StructField("value", T.DoubleType()),
        T.StructField("threshold", T.DoubleType()),
        T.StructField("count", T.LongType()),
        T.StructField("stderr", T.StringType()),
    ]
)

CALL_SCHEMA = T.StructType(
    [
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("tool_name", T.StringType()),
        T.StructField("inputs", T.StringType()),
        T.StructField("outputs", T.StringType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("tokens_used", T.LongType()),
        T.StructField("cost_usd", T.DoubleType()),
        T.StructField("co2_grams", T.DoubleType()),
        T.StructField("cache_hit", T.BooleanType()),
        T.StructField("step_id", T.StringType()),
        T.StructField("run_id", T.StringType()),
    ]
)


def read_table(spark: SparkSession, path: str, sep: str = ",", multiline: bool = False) -> DataFrame:
    """Header CSV as trimmed strings; empty cells and missing tail cells are null.

    With ``multiline`` quoted cells may hold line ends; a file is one task then, so it is asked for only where it is needed.
    """
    return (
        spark.read.option("header", True)
        .option("sep", sep)
        .option("mode", "PERMISSIVE")
        .option("multiLine", multiline)
        .option("ignoreLeadingWhiteSpace", True)
        .option("ignoreTrailingWhiteSpace", True)
        .csv(path)
    )


def read_records(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """JSON lines, or JSON arrays of objects, one a file. Either is read by many tasks however large a file is.

    The objects of an array are written as JSON lines to the shared folder first, so that the reader that infers the
    schema and the one that reads see the same lines.
    """
    first = spark.read.text(path).filter(F.trim("value") != "").first()
    reader = spark.read.schema(schema) if schema else spark.read
    if first is None or not first["value"].lstrip().startswith("["):
        return reader.json(path)
    return reader.json(written_lines(array_elements(spark, path).select(F.col("element").alias("value"))))


def read_auto(spark: SparkSession, path: str) -> DataFrame:
    """By suffix; otherwise JSON when the first line opens an object or array, else delimited text."""
    if path.endswith((".json", ".jsonl")):
        return read_records(spark, path)
    if path.endswith(".csv"):
        return read_table(spark, path)
    if path.endswith(".parquet"):
        return spark.read.parquet(path)
    kind = sniff_text(spark, path)
    return read_records(spark, path) if kind["kind"] == "json" else read_table(spark, path, kind.get("sep", ","), kind.get("multiline", False))


def sniff_text(spark: SparkSession, path: str) -> dict:
    """Format of a text file from its first two records: csv with its delimiter, json or text.

    Delimited text has as many cells in both records, more than one, a quoted cell counting as one however many lines it
    holds; ``multiline`` says that one of them holds several. A record is looked for in the first ``HEAD_LINES`` lines.
    """
    head = [r["value"] + "\n" for r in spark.read.text(path).limit(HEAD_LINES).collect()]
    lines = [x for x in head if x.strip()]
    if lines and lines[0].lstrip()[:1] in ("{", "["):
        return {"kind": "json"}
    found = None
    for sep in DELIMITERS:
        records = [cells for cells in csv.reader(head, delimiter=sep) if any(c.strip() for c in cells)][:2]
        if len(records) == 2 and all(len(cells) > 1 for cells in records):
            same = len(records[0]) == len(records[1])
            if same or found is None:
                found = {"kind": "csv", "sep": sep} | ({"multiline": True} if any("\n" in c for cells in records for c in cells) else {})
            if same:
                break
    return found or {"kind": "text"}


def text_stats(df: DataFrame, text: str, key: str | None = None) -> DataFrame:
    """Line and character counts of texts, per key or over all rows."""
    lines = F.size(F.split(F.col(text), "\n"))
    aggs = [
        F.count(text).alias("texts"),
        F.sum(lines.cast("long")).alias("line_count"),
        F.sum(F.length(text).cast("long")).alias("character_count"),
    ]
    return (df.groupBy(key) if key else df).agg(*aggs)


def type_columns(df: DataFrame, keep_raw: bool = False) -> DataFrame:
    """Give every text column the type all of its filled cells agree on: long, double or string.

    One pass decides all columns; ``keep_raw`` keeps the text as ``<col>__raw``.
    """
    text_cols = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    if not text_cols:
        return df
    votes = []
    for c in text_cols:
        t = F.trim(F.col(f"`{c}`"))
        filled = t.isNotNull() & (t != "")
        votes += [
            F.count_if(filled).alias(f"{c}__filled"),
            F.count_if(filled & t.rlike("^[+-]?[0-9]{1,18}$")).alias(f"{c}__whole"),
            F.count_if(filled & t.rlike(NUMBER_SHAPE)).alias(f"{c}__number"),
        ]
    v = df.agg(*votes).first()
    out = []
    for f in df.schema.fields:
        c = F.col(f"`{f.name}`")
        if f.name not in text_cols:
            out.append(c)
            continue
        filled, whole, number = v[f"{f.name}__filled"], v[f"{f.name}__whole"], v[f"{f.name}__number"]
        if filled and whole == filled:
            out.append(F.trim(c).try_cast("long").alias(f.name))
        elif filled and number == filled:
            out.append(to_number(c).alias(f.name))
        else:
            t = F.trim(c)
            out.append(F.when(t != "", t).alias(f.name))
        if keep_raw:
            out.append(c.alias(f"{f.name}__raw"))
    return df.select(*out)


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """Fail before any job when a column is absent."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; available columns {df.columns}")
    return df


def register(name: str, df: DataFrame) -> DataFrame:
    """Name a result so that later SQL can use it."""
    df.createOrReplaceTempView(name)
    return df


def read_log(spark: SparkSession, path: str, schema: T.StructType = TX_LOG_SCHEMA) -> DataFrame:
    return spark.read.schema(schema).json(path)
