"""Sinks: claims, sorted JSON, append-only logs and the quality report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_claims(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Nested claims as JSON lines, one file per task."""
    df.write.mode(mode).json(path)


def write_json_sorted(df: DataFrame, path: str, key: list[str], mode: str = "overwrite") -> None:
    """Deterministic JSON lines: columns in name order, rows range-sorted by key over the part files."""
    ordered = df.select(*sorted(df.columns))
    ordered.orderBy(*key).write.mode(mode).json(path)


def append_log(df: DataFrame, path: str, run_id: str, dry_run: bool = False) -> None:
    """Append records with time, run id and dry-run flag."""
    stamped = df.withColumns(
        {
            "ts": F.unix_micros(F.current_timestamp()) / F.lit(1e6),
            "run_id": F.lit(run_id),
            "dry_run": F.lit(dry_run),
        }
    )
    stamped.write.mode("append").json(path)


def quality_report(profile: DataFrame, metrics: DataFrame, title: str = "Data report") -> DataFrame:
    """Markdown lines (line_no, line) from a profile (name, dtype, missing, rows) and a one-row metrics frame.

    Both inputs have one row per column or metric, so numbering them is a small sort.
    """
    head = profile.agg(F.max("rows").alias("rows")).select(
        F.posexplode(
            F.array(
                F.lit("# " + title),
                F.lit(""),
                F.lit("## Schema"),
                F.format_string("Rows: %d", F.col("rows")),
                F.lit(""),
                F.lit("| column | dtype | missing |"),
                F.lit("|---|---|---:|"),
            )
        ).alias("pos", "line")
    )
    body = profile.select(
        F.col("pos"), F.format_string("| %s | %s | %.3f |", "name", "dtype", "missing").alias("line")
    )
    names = metrics.columns
    pairs = F.array(
        *[F.struct(F.lit(i).alias("pos"), F.lit(n).alias("n"), F.col(n).cast("double").alias("v")) for i, n in enumerate(names)]
    )
    tail = metrics.select(F.explode(pairs).alias("m")).select(
        F.col("m.pos").alias("pos"), F.format_string("- **%s**: %.6f", F.col("m.n"), F.col("m.v")).alias("line")
    )
    gap = tail.sparkSession.sql("SELECT pos, line FROM VALUES (0, ''), (1, '## Metrics') AS t(pos, line)")
    parts = [head, body, gap, tail]
    tagged = [p.select(F.lit(i).alias("part"), F.col("pos").cast("int").alias("pos"), "line") for i, p in enumerate(parts)]
    lines = tagged[0].unionByName(tagged[1]).unionByName(tagged[2]).unionByName(tagged[3])
    numbered = lines.agg(F.array_sort(F.collect_list(F.struct("part", "pos", "line"))).alias("all")).select(
        F.posexplode("all").alias("line_no", "l")
    )
    return numbered.select((F.col("line_no") + 1).alias("line_no"), F.col("l.line").alias("line"))


def write_report(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """The report is a few dozen lines; it leaves as one text file."""
    lines.orderBy("line_no").select(F.col("line").alias("value")).coalesce(1).write.mode(mode).text(path)
