"""Complaint texts: load statistics, entity extraction and the enrichment hook."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions import text as tx

ENTITY_COLUMNS = ["flight_number", "flight_date", "origin", "destination", "incident_type", "delay_hours"]
HOOK_BONUS = 30


def value_counts_map(df: DataFrame, column: str) -> DataFrame:
    """One row with a value -> count map; meant for columns with few values."""
    return df.groupBy(column).count().agg(
        F.map_from_entries(F.collect_list(F.struct(F.col(column), F.col("count")))).alias(f"{column}_counts")
    )


def load_stats(df: DataFrame, created: str = "created_at", text: str = "text", by: list[str] | None = None) -> DataFrame:
    """Rows, time span and mean text length, plus the same per value of each ``by`` column (grouping sets)."""
    aggs = [
        F.count(F.lit(1)).alias("rows"),
        F.min(created).alias("first_created"),
        F.max(created).alias("last_created"),
        F.avg(F.length(text)).alias("avg_text_length"),
    ]
    if not by:
        return df.agg(*aggs)
    cols = [F.col(c) for c in by]
    return df.groupingSets([[]] + [[c] for c in cols], *cols).agg(*aggs)


def complaint_score(df: DataFrame, text: str = "text") -> DataFrame:
    scored = df.withColumn("complaint_score", tx.keyword_count(F.col(text)))
    return scored.withColumn("has_complaint_keywords", F.col("complaint_score") > 0)


def extract_entities(df: DataFrame, text: str, reference_date: Column, strict: bool = True) -> DataFrame:
    """Add the flight, place, date, incident and confidence columns; confidence in integer hundredths."""
    c = F.col(text)
    staged = df.withColumns(
        {
            "flight_number": tx.entity_code(c, strict),
            "__places": tx.airport_codes(c),
            "__date": tx.mentioned_date(c, reference_date),
            "incident_type": tx.incident_types(c),
            "delay_hours": tx.delay_hours(c),
        }
    )
    return staged.withColumns(
        {
            "flight_date": F.date_format("__date", "yyyy-MM-dd"),
            "origin": F.get("__places", F.lit(0)),
            "destination": F.get("__places", F.lit(1)),
            "confidence_pct": tx.extraction_score(
                F.col("flight_number"), F.col("__places"), F.col("__date"), F.col("incident_type")
            ),
            "extraction_method": F.lit("regex"),
        }
    ).drop("__places", "__date")


def extraction_stats(df: DataFrame, threshold_pct: int = 60, by: str | None = None) -> DataFrame:
    aggs = [
        F.count(F.lit(1)).alias("total_processed"),
        F.count("flight_number").alias("flight_numbers_extracted"),
        F.count("flight_date").alias("dates_extracted"),
        F.count("origin").alias("airports_extracted"),
        F.count("incident_type").alias("incidents_identified"),
        F.count_if(F.col("confidence_pct") >= threshold_pct).alias("high_confidence"),
    ]
    return (df.groupBy(by) if by else df).agg(*aggs)


def enrich_low_confidence(
    df: DataFrame,
    fn: Callable[[pd.DataFrame], pd.DataFrame] | None = None,
    threshold_pct: int = 60,
) -> DataFrame:
    """Hand rows below the threshold to ``fn`` in Arrow batches and merge its non-empty answers; other rows pass through.

    ``fn`` gets a pandas batch and returns the same rows; filled entity columns replace the old ones, the
    confidence rises by 30 points (at most 100) and the method becomes ``regex+hook``. Without ``fn`` nothing changes.
    """
    if fn is None:
        return df
    wanted = [c for c in ENTITY_COLUMNS if c in df.columns]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            weak = batch.index[batch["confidence_pct"] < threshold_pct]
            if len(weak):
                answer = fn(batch.loc[weak].copy())
                for c in wanted:
                    filled = answer[c].notna() & (answer[c].astype(str).str.strip() != "")
                    batch.loc[weak, c] = answer[c].where(filled, batch.loc[weak, c])
                batch.loc[weak, "confidence_pct"] = (batch.loc[weak, "confidence_pct"] + HOOK_BONUS).clip(upper=100)
                batch.loc[weak, "extraction_method"] = "regex+hook"
            yield batch

    return df.mapInPandas(run, df.schema)
