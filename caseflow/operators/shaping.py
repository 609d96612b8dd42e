"""Projections, filters and guards."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Alias lists, first present wins; date formats in the order they are tried.
COMPLAINT_ALIASES = {
    "text": ["text", "tweet", "message", "content"],
    "airline": ["airline", "airline_sentiment_target", "target"],
    "sentiment": ["airline_sentiment", "sentiment", "label"],
    "created_at": ["tweet_created", "created_at", "date", "timestamp"],
    "user": ["name", "user", "username", "screen_name"],
}
DATE_FORMATS = ["yyyy-MM-dd", "MM/dd/yyyy", "yyyy/MM/dd", "dd-MMM-yyyy"]
SIGNIFICANT_DELAY_MINUTES = 180


def standardize_columns(df: DataFrame, aliases: dict[str, list[str]] = COMPLAINT_ALIASES) -> DataFrame:
    """Add each standard column from its first present alias; an existing standard column stays."""
    new = {}
    for name, options in aliases.items():
        found = next((o for o in options if o in df.columns), None)
        if found and name not in df.columns:
            new[name] = F.col(found)
    return df.withColumns(new) if new else df


def filter_in(df: DataFrame, column: str, values: list | None) -> DataFrame:
    """Membership; no column or no values means no filter."""
    if not values or column not in df.columns:
        return df
    return df.filter(F.col(column).isin(list(values)))


def filter_handles(df: DataFrame, column: str, handles: list[str] | None) -> DataFrame:
    """Membership with and without the leading ``@``."""
    bare = [h.removeprefix("@") for h in handles or []]
    return filter_in(df, column, sorted({x for h in bare for x in (h, "@" + h)}))


def filter_date_range(df: DataFrame, column: str, start: str | None = None, end: str | None = None) -> DataFrame:
    """Inclusive at both ends; a missing bound is open. Literals keep the type of the column, so it pushes down."""
    kind = df.schema[column].dataType.simpleString()
    kind = kind if kind in ("date", "timestamp", "timestamp_ntz") else "timestamp"
    c = F.col(column) if kind == df.schema[column].dataType.simpleString() else F.col(column).try_cast(kind)
    if start:
        df = df.filter(c >= F.lit(start).cast(kind))
    if end:
        df = df.filter(c <= F.lit(end).cast(kind))
    return df


def filter_month(df: DataFrame, column: str, month: str) -> DataFrame:
    """``YYYY-MM`` as a half-open range, which Parquet min/max statistics can prune."""
    year, number = map(int, month.split("-"))
    first = date(year, number, 1)
    after = date(year + number // 12, number % 12 + 1, 1)
    kind = df.schema[column].dataType.simpleString()
    return df.filter(
        (F.col(column) >= F.lit(first.isoformat()).cast(kind)) & (F.col(column) < F.lit(after.isoformat()).cast(kind))
    )


def _minutes(df: DataFrame, *names: str) -> Column:
    found = next((n for n in names if n in df.columns), None)
    return F.coalesce(F.col(found).try_cast("double"), F.lit(0.0)) if found else F.lit(0.0)


def derive_fact_flags(df: DataFrame) -> DataFrame:
    """Numeric delays (bad gives 0), cancelled flag, entity key, date text, delay and eligibility flags."""
    arrival = _minutes(df, "arr_delay", "arr_delay_new")
    departure = _minutes(df, "dep_delay", "dep_delay_new")
    if "cancelled" in df.columns:
        raw = F.col("cancelled").cast("string")
        number = F.when(raw == "Y", 1.0).when(raw == "N", 0.0).otherwise(raw.try_cast("double"))
        cancelled = F.coalesce(number == 1, F.lit(False))
    else:
        cancelled = F.lit(False)
    out = df.withColumns(
        {
            "arr_delay_minutes": arrival,
            "dep_delay_minutes": departure,
            "is_cancelled": cancelled,
            "entity_key": F.concat(F.col("carrier"), F.col("fl_num").cast("string")),
            "date_str": F.date_format("flight_date", "yyyy-MM-dd"),
            "significant_delay": arrival >= SIGNIFICANT_DELAY_MINUTES,
        }
    )
    return out.withColumn("refund_eligible", F.col("is_cancelled") | F.col("significant_delay"))


def select_existing(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.select(*[c for c in columns if c in df.columns])


def parse_date(c: Column, formats: list[str] = DATE_FORMATS) -> Column:
    """First format that fits; null when none does."""
    return F.coalesce(*[F.try_to_date(F.trim(c), f) for f in formats])


def parse_dates_multi(df: DataFrame, column: str, into: str, formats: list[str] = DATE_FORMATS) -> tuple[DataFrame, DataFrame]:
    """Rows with a readable date, and a one-row count of the dropped ones."""
    parsed = df.withColumn(into, parse_date(F.col(column), formats))
    dropped = parsed.agg(
        F.count_if(F.col(into).isNotNull()).alias("kept"), F.count_if(F.col(into).isNull()).alias("dropped")
    )
    return parsed.filter(F.col(into).isNotNull()), dropped


_COMPARE = {
    ">=": lambda v, t: v >= t,
    ">": lambda v, t: v > t,
    "<=": lambda v, t: v <= t,
    "<": lambda v, t: v < t,
    "==": lambda v, t: v == t,
}


def guard(metrics: DataFrame, metric: str, op: str, threshold: float, fail: bool = False) -> DataFrame:
    """(metric, value, threshold, ok) from a one-row metrics frame.

    A missing or non-numeric metric is an error; ``fail`` turns a breach into one as well.
    """
    if metric not in metrics.columns:
        raise ValueError(f"metric {metric!r} not found; available {metrics.columns}")
    value = F.col(metric).try_cast("double")
    checked = F.when(value.isNull(), F.raise_error(F.lit(f"metric {metric} is not numeric"))).otherwise(value)
    ok = _COMPARE[op](checked, F.lit(float(threshold)))
    if fail:
        ok = F.when(
            ~ok, F.raise_error(F.format_string(f"guard failed: {metric} %s {op} {threshold}", checked.cast("string")))
        ).otherwise(ok)
    return metrics.select(
        F.lit(metric).alias("metric"),
        checked.alias("value"),
        F.lit(float(threshold)).alias("threshold"),
        ok.cast("boolean").alias("ok"),
    )
