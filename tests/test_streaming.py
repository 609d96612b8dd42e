"""A stream that has worked off all files gives what its batch twin gives."""

from pyspark.sql import functions as F

from caseflow.operators import matching, shaping, telemetry
from caseflow.streaming import logs
from tests import fixtures

CALLS = "call_id long, run_id string, `timestamp` timestamp, cost_usd double, co2_grams double, tokens_used long, cache_hit boolean, key string"


def _calls(spark):
    return spark.range(60).selectExpr(
        "id as call_id", "concat('r', id % 3) as run_id", "timestamp_seconds(1700000000 + id * 60) as timestamp", "0.5D as cost_usd",
        "1.0D as co2_grams", "id as tokens_used", "id % 2 = 0 as cache_hit", "concat('k', id % 10) as key",
    )


def _run(df, spark, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name)


def _stream(spark, df, folder, schema):
    df.repartition(3).write.mode("overwrite").json(str(folder))
    return logs.stream_log(spark, str(folder), schema, files_per_trigger=10)


def test_live_run_stats(spark, tmp_path):
    calls = _calls(spark)
    out = _run(logs.live_run_stats(_stream(spark, calls, tmp_path / "c", CALLS)), spark, "live", "complete")
    got = {r["run_id"]: (r["tools_executed"], r["total_cost_usd"]) for r in out.collect()}
    want = {r["run_id"]: (r["tools_executed"], r["total_cost_usd"]) for r in telemetry.live_run_stats(calls).collect()}
    assert got == want and out.count() == len(want)
    days = _run(logs.live_run_stats(_stream(spark, calls, tmp_path / "e", CALLS), by_day=True), spark, "live_days", "complete")
    assert days.agg(F.sum("tools_executed")).first()[0] == calls.count()


def test_tumbling_and_sessions(spark, tmp_path):
    calls = _calls(spark)
    out = _run(logs.tumbling_impact(_stream(spark, calls, tmp_path / "c", CALLS), "10 minutes", "0 minutes"), spark, "tumb", "append")
    want = {r["window_start"]: r["calls"] for r in telemetry.tumbling_impact(calls, "10 minutes").collect()}
    got = {r["window_start"]: r["calls"] for r in out.collect()}
    assert got.items() <= want.items() and len(got) >= len(want) - 1  # the last window is still open
    sessions = logs.run_sessions(_stream(spark, calls, tmp_path / "d", CALLS), "1 minute", "0 minutes")
    assert _run(sessions, spark, "sess", "append").count() > 0


def test_quota_breach_equals_batch_in_any_order(spark, tmp_path):
    """The same alert whatever the order of arrival and the number of batches; late charges within the delay count."""
    limits = {"cpu_ms": 95.0}
    charges = spark.range(60).selectExpr("id as charge_id", "timestamp_seconds(1700000000 + cast(id * 7 % 60 as int)) as ts", "concat('a', id % 2) as app", "'cpu_ms' as metric", "cast(1 + id * 13 % 19 as double) as amount")
    want = {r["app"]: (r["breach_id"], r["breach_ts"]) for r in telemetry.quota_usage(charges, limits).collect()}
    assert len(want) == 2 and None not in want.values()
    close = spark.sql("select 999L as charge_id, timestamp_seconds(1700100000) as ts, 'late' as app, 'cpu_ms' as metric, 0.0D as amount")
    schema = "charge_id long, ts timestamp, app string, metric string, amount double"
    for n, order in enumerate((F.col("charge_id"), -F.col("charge_id"), F.hash("charge_id"))):
        folder = tmp_path / f"q{n}"
        rows = charges.orderBy(order).collect()
        size = (60, 7, 20)[n]
        for i in range(0, 60, size):
            spark.createDataFrame(rows[i : i + size], schema).coalesce(1).write.mode("append").json(str(folder))
        close.coalesce(1).write.mode("append").json(str(folder))
        out = _run(logs.quota_breach(logs.stream_log(spark, str(folder), schema, files_per_trigger=1), limits, "5 minutes"), spark, f"quota{n}", "append")
        assert sorted((r["app"], (r["breach_id"], r["breach_ts"])) for r in out.collect()) == sorted(want.items())


def test_finished_runs_leave_the_state(spark, tmp_path):
    calls = _calls(spark)  # runs r0, r1 and r2, a call a minute
    stamp = lambda m: f"timestamp_seconds(1700000000 + {m} * 60)"
    ends = spark.sql(f"select 'r0' as run_id, {stamp(58)} as timestamp union all select 'r1', {stamp(59)}")
    later = spark.sql(f"select 900L as call_id, 'r9' as run_id, {stamp(5000)} as timestamp, 0.5D as cost_usd, 1.0D as co2_grams, 1L as tokens_used, false as cache_hit, 'k' as key")
    for n, df in enumerate((calls.filter("call_id < 30"), calls.filter("call_id >= 30"), later)):
        df.coalesce(1).write.mode("append").json(str(tmp_path / "c"))
    ends.coalesce(1).write.json(str(tmp_path / "e"))
    stream = logs.finished_runs(logs.stream_log(spark, str(tmp_path / "c"), CALLS, files_per_trigger=1), logs.stream_log(spark, str(tmp_path / "e"), "run_id string, timestamp timestamp"), "10 minutes", "1 hour")
    q = stream.writeStream.outputMode("append").format("memory").queryName("finished").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {r["run_id"]: r for r in spark.table("finished").collect()}
    want = {r["run_id"]: r for r in telemetry.live_run_stats(calls).collect()}
    assert set(got) == {"r0", "r1", "r2"} and [got[r]["closed"] for r in ("r0", "r1", "r2")] == [True, True, False]
    assert all(got[r][c] == want[r][c] for r in want for c in ("tools_executed", "total_cost_usd", "total_co2_grams", "total_tokens", "cache_hit_rate"))
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] == 1  # the run that is still open


def test_cache_dedup(spark, tmp_path):
    out = _run(logs.cache_dedup(_stream(spark, _calls(spark), tmp_path / "c", CALLS), "2 hours"), spark, "dedup", "append")
    assert out.count() == 10


def test_stream_cases(spark, tmp_path):
    facts = shaping.derive_fact_flags(fixtures.flights(spark))
    claims = spark.createDataFrame([(1, "UA731", "2015-03-04", None, None, "cancelled"), (2, None, None, None, None, None)], "claim_id int, flight_number string, flight_date string, origin string, destination string, incident_type string")
    schema = claims.schema
    claims.write.json(str(tmp_path / "in"))
    writer = logs.stream_cases(logs.stream_log(spark, str(tmp_path / "in"), schema), facts, lambda df, i: df.drop("fact").write.mode("append").parquet(str(tmp_path / "out")))
    logs.run_scheduled(writer, str(tmp_path / "chk"))
    got = {r["claim_id"]: r["match_status"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r["claim_id"]: r["match_status"] for r in matching.match_cascade(claims, facts).collect()}
    assert got == want == {1: "matched", 2: "insufficient_data"}
