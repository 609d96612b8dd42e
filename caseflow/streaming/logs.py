"""Structured Streaming twins of the telemetry and case operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import DataStreamWriter
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from caseflow.operators import matching, telemetry
from caseflow.operators.telemetry import DEFAULT_LIMITS


def stream_log(spark: SparkSession, path: str, schema: T.StructType, fmt: str = "json", files_per_trigger: int = 100) -> DataFrame:
    """Follow files as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).format(fmt).load(path)


def live_run_stats(calls: DataFrame, delay: str = "1 hour", by_day: bool = False) -> DataFrame:
    """Running figures per run, as the batch figures give them. Use update mode.

    A run's state stays for good; ``by_day`` gives figures per run and day instead, whose state leaves with the watermark,
    and ``finished_runs`` gives each run's figures once, when it has ended.
    """
    n = F.count(F.lit(1))
    keys = ["run_id", F.window("timestamp", "1 day")] if by_day else ["run_id"]
    return (
        calls.withWatermark("timestamp", delay)
        .groupBy(*keys)
        .agg(
            n.alias("tools_executed"), F.sum("cost_usd").alias("total_cost_usd"), F.sum("co2_grams").alias("total_co2_grams"),
            F.sum("tokens_used").alias("total_tokens"), (F.count_if("cache_hit") / n * 100).alias("cache_hit_rate"),
            F.min("timestamp").alias("first_call"), F.max("timestamp").alias("last_call"),
        )
    )


def tumbling_impact(calls: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Cost and CO2 per closed window. Use append mode."""
    return telemetry.tumbling_impact(calls.withWatermark("timestamp", delay), width)


def run_sessions(calls: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Sessions per run when end markers are missing. Use append mode."""
    return (
        calls.withWatermark("timestamp", delay)
        .groupBy("run_id", F.session_window("timestamp", gap).alias("s"))
        .agg(F.count(F.lit(1)).alias("calls"))
        .select("run_id", F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "calls")
    )


def quota_breach(charges: DataFrame, limits: dict[str, float] = DEFAULT_LIMITS, delay: str = "10 minutes") -> DataFrame:
    """One alert per (app, metric) at the charge, in event time, whose running usage first exceeds the limit. Use append mode.

    Charges wait in the state until the watermark has passed them and are then added up in order of time and id, so the
    alert does not depend on the order or the batches in which they arrive, and is the one of the batch query. A charge
    that comes later than ``delay`` does not count, as usual with watermarks; an alert comes ``delay`` after its charge.
    Once a key has its alert, its state is that alone.
    """
    out = "app string, metric string, usage double, limit double, breach_ts timestamp, breach_id long"
    held = "usage double, alerted boolean, at array<long>, ids array<long>, amounts array<double>"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        limit = limits.get(key[1])
        usage, alerted, *waiting = state.get if state.exists else (0.0, False, [], [], [])
        waiting = list(zip(*waiting))
        passed = state.getCurrentWatermarkMs() * 1000
        for rows in batches:
            if limit is not None and not alerted:
                waiting += [r for r in zip(rows["at"].tolist(), rows["charge_id"].tolist(), rows["amount"].tolist()) if r[0] >= passed]
        waiting.sort()
        due = 0
        while due < len(waiting) and waiting[due][0] < passed and not alerted:
            at, charge, amount = waiting[due]
            usage, due = usage + amount, due + 1
            if usage > limit:
                alerted, waiting = True, []
                yield pd.DataFrame(
                    {"app": [key[0]], "metric": [key[1]], "usage": [usage], "limit": [float(limit)], "breach_ts": [pd.Timestamp(at, unit="us")], "breach_id": [charge]}
                )
        waiting = waiting[due:] if not alerted else []
        state.update((usage, alerted, [r[0] for r in waiting], [r[1] for r in waiting], [float(r[2]) for r in waiting]))
        if waiting:
            state.setTimeoutTimestamp(max(waiting[0][0] // 1000, state.getCurrentWatermarkMs()) + 1)

    timed = charges.withWatermark("ts", delay).withColumn("at", F.unix_micros("ts")).withColumn("amount", F.col("amount").cast("double"))
    return timed.groupBy("app", "metric").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def finished_runs(calls: DataFrame, ends: DataFrame, delay: str = "10 minutes", idle: str = "6 hours") -> DataFrame:
    """Figures of each run once, when it has ended; its state leaves with them. Use append mode.

    ``ends`` has ``run_id, timestamp`` of the end markers. A run ends when the watermark passes its marker, or, without
    one, ``idle`` after its last call (``closed`` is false then). Calls that come after that open the run anew.
    """
    out = "run_id string, started timestamp, ended timestamp, closed boolean, tools_executed long, total_cost_usd double, total_co2_grams double, total_tokens long, cache_hit_rate double"
    held = "started long, last long, marker long, calls long, cost double, co2 double, tokens long, hits long"
    idle_ms = int(pd.Timedelta(idle).total_seconds() * 1000)

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, last, marker, n, cost, co2, tokens, hits = state.get if state.exists else (-1, -1, -1, 0, 0.0, 0.0, 0, 0)
        passed = state.getCurrentWatermarkMs()
        for rows in batches:
            is_mark = rows["is_end"].astype(bool)
            marks, own = rows[is_mark], rows[~is_mark]
            if len(marks):
                marker = max(marker, int(marks["at"].max()))
            if len(rows):
                first = int(rows["at"].min())
                started, last = (first if started < 0 else min(started, first)), max(last, int(rows["at"].max()))
            n, tokens, hits = n + len(own), tokens + int(own["tokens_used"].fillna(0).sum()), hits + int(own["cache_hit"].eq(True).sum())
            cost, co2 = cost + float(own["cost_usd"].fillna(0).sum()), co2 + float(own["co2_grams"].fillna(0).sum())
        over = (marker if marker >= 0 else last + idle_ms * 1000) // 1000
        if over < passed:
            state.remove()
            yield pd.DataFrame(
                {
                    "run_id": [key[0]], "started": [pd.Timestamp(started, unit="us")], "ended": [pd.Timestamp(marker if marker >= 0 else last, unit="us")], "closed": [marker >= 0],
                    "tools_executed": [n], "total_cost_usd": [cost], "total_co2_grams": [co2], "total_tokens": [tokens], "cache_hit_rate": [100.0 * hits / n if n else 0.0],
                }
            )
        else:
            state.update((started, last, marker, n, cost, co2, tokens, hits))
            state.setTimeoutTimestamp(max(over, passed) + 1)

    figures = ["tokens_used", "cost_usd", "co2_grams", "cache_hit"]
    made = calls.select("run_id", "timestamp", *figures, F.lit(False).alias("is_end"))
    marked = ends.select("run_id", "timestamp", *[F.lit(None).cast(made.schema[c].dataType).alias(c) for c in figures], F.lit(True).alias("is_end"))
    both = made.unionByName(marked).withWatermark("timestamp", delay).withColumn("at", F.unix_micros("timestamp"))
    return both.groupBy("run_id").applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)


def cache_dedup(calls: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Each content key passes once within the watermark."""
    return calls.withWatermark("timestamp", delay).dropDuplicatesWithinWatermark(["key"])


def stream_cases(claims: DataFrame, facts: DataFrame, sink: Callable[[DataFrame, int], None], tolerance: int = 1) -> DataStreamWriter:
    """Match every micro-batch of claims against the static facts; the ranked best match needs a whole batch.

    The facts are looked through once, before the stream starts.
    """
    ready = matching.prepared(facts)

    def each(batch: DataFrame, batch_id: int) -> None:
        sink(matching.match_cascade(batch, ready, tolerance), batch_id)

    return claims.writeStream.foreachBatch(each)


def run_scheduled(writer: DataStreamWriter, checkpoint: str) -> None:
    """Work off everything that has arrived and stop; an external scheduler decides when."""
    writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
