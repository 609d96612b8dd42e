"""Queries over calls, logs, files and the regression tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import impact as imp
from caseflow.functions import text as tx
from caseflow.operators import catalog as cat
from caseflow.operators import profiling as prof
from caseflow.operators import regress as reg
from caseflow.operators import telemetry as tel
from caseflow.plans.registry import query
from caseflow.sources import files as fil
from caseflow.sources import writers

_COST = "case model when 'claude-3-5-sonnet' then {a} when 'gpt-4' then {b} else {c} end"
IMPACT_SQL = """
select *, case when model is not null and tokens_used > 0 then floor(tokens_used * 0.7::double) * {pin} + (tokens_used - floor(tokens_used * 0.7::double)) * {pout} else 0 end
    + latency_ms / 1000 * heavy * 0.0001::double + mb * 0.00001::double as cost_usd,
  case when model is not null and tokens_used > 0 then tokens_used / 1000 * {co2} else 0 end + latency_ms / 1000 * heavy * 0.8::double + mb * 0.05::double as co2_grams
from (select *, case when tool_name in ('train_lr', 'eval', 'split', 'profile') then 10 else 1 end as heavy,
  case when tool_name in ('read_csv', 'write_file', 'write_json', 'zip') then greatest(0.01::double, (length(inputs) + length(outputs)) / 1048576.0::double) else 0 end as mb from calls)""".format(
    pin=_COST.format(a="3e-6", b="30e-6", c="0.5e-6"), pout=_COST.format(a="15e-6", b="60e-6", c="1.5e-6"),
    co2="case model when 'claude-3-5-sonnet' then 0.5::double when 'gpt-4' then 8.5::double when 'gpt-3.5-turbo' then 1.2::double else 2.0::double end",
)
CALL_CTES = {"metered": IMPACT_SQL}
CATEGORY_SQL = "case when tool_name in ('read_csv','write_file') then 'data' when tool_name = 'train_lr' then 'ml' when tool_name = 'emit_report' then 'reporting' when tool_name = 'generate' then 'model' else 'other' end"


def metered(t):
    return tel.with_impact(t("calls"))


@query("estimate_impact", ["calls"], "select call_id, round(cost_usd, 9) as cost_usd, round(co2_grams, 6) as co2_grams from metered", CALL_CTES)
def estimate_impact(t):
    return metered(t).select("call_id", F.round("cost_usd", 9).alias("cost_usd"), F.round("co2_grams", 6).alias("co2_grams"))


@query(
    "impact_tier", ["calls"],
    """select call_id, case when co2_grams < 1 and cost_usd < 0.01::double then 'minimal' when co2_grams < 10 and cost_usd < 0.1::double then 'moderate' else 'significant' end as tier from metered""",
    CALL_CTES,
)
def impact_tier(t):
    return metered(t).select("call_id", imp.impact_tier(F.col("cost_usd"), F.col("co2_grams")).alias("tier"))


@query(
    "estimate_tokens",
    sql="""select conv_id, turn, greatest(1, length(text) // 4)::bigint as tokens, round(greatest(1, length(text) // 4) * 1e-6::double + 100 * 2e-6::double, 9) as cost_usd,
           round((greatest(1, length(text) // 4) + 100) / 1000 * 2.0::double, 6) as co2_grams, role from conversations""",
)
def estimate_tokens(t):
    n = imp.estimate_tokens(F.col("text"))
    cost = imp.model_call_cost(F.lit("in-house"), n, F.lit(100))
    return t("conversations").select(
        "conv_id", "turn", "role", n.alias("tokens"), F.round(cost["cost_usd"], 9).alias("cost_usd"), F.round(cost["co2_grams"], 6).alias("co2_grams")
    )


@query(
    "content_key", ["calls"],
    """select call_id, sha256(coalesce(model, 'none') || ':{"props":"' || replace(inputs, '"', '\\"') || '","tool":"' || tool_name || '"}') as key from calls""".replace("\\\\", "\\"),
)
def content_key(t):
    key = imp.content_key(F.coalesce("model", F.lit("none")), {"tool": F.col("tool_name"), "props": F.col("inputs")})
    return t("calls").select("call_id", key.alias("key"))


@query(
    "run_metrics", ["calls"],
    f"""select run_id, count(*) as total_tools, sum(tokens_used)::bigint as total_tokens, round(sum(cost_usd), 6) as total_cost_usd, round(sum(co2_grams), 4) as total_co2_grams,
        round(sum(latency_ms), 4) as total_latency_ms, round(count(*) filter (where cache_hit) / count(*) * 100, 6) as cache_hit_rate,
        count(*) filter (where {CATEGORY_SQL} = 'data') as data_calls, count(*) filter (where {CATEGORY_SQL} = 'ml') as ml_calls,
        arg_min(tool_name, call_id) filter (where cost_usd = top_cost) as most_expensive_tool, arg_min(tool_name, call_id) filter (where co2_grams = top_co2) as most_carbon_intensive_tool
        from (select *, max(cost_usd) over (partition by run_id) as top_cost, max(co2_grams) over (partition by run_id) as top_co2 from metered) group by run_id""",
    CALL_CTES,
)
def run_metrics(t):
    out = tel.run_metrics(metered(t))
    count = lambda k: F.coalesce(F.try_element_at("tools_by_category", F.lit(k)), F.lit(0))
    return out.select(
        "run_id", "total_tools", "total_tokens", F.round("total_cost_usd", 6).alias("total_cost_usd"), F.round("total_co2_grams", 4).alias("total_co2_grams"),
        F.round("total_latency_ms", 4).alias("total_latency_ms"), F.round("cache_hit_rate", 6).alias("cache_hit_rate"), count("data").alias("data_calls"),
        count("ml").alias("ml_calls"), "most_expensive_tool", "most_carbon_intensive_tool",
    )


@query(
    "historical_totals", ["calls"],
    """select count(*) as runs_analyzed, round(sum(c), 6) as total_cost_usd, round(sum(g), 4) as total_co2_grams, sum(k)::bigint as total_tokens, round(avg(c), 6) as avg_cost_per_run, round(avg(g), 4) as avg_co2_per_run
       from (select run_id, sum(cost_usd) as c, sum(co2_grams) as g, sum(tokens_used) as k, max("timestamp") as e from metered group by run_id order by e desc, run_id desc limit 10)""",
    CALL_CTES,
)
def historical_totals(t):
    out = tel.historical_totals(tel.run_metrics(metered(t)))
    digits = {"total_cost_usd": 6, "total_co2_grams": 4, "avg_cost_per_run": 6, "avg_co2_per_run": 4}
    return out.withColumns({c: F.round(c, n) for c, n in digits.items()})


@query(
    "pruning", ["calls"],
    """select run_id, 'cache_opportunity' as type, tool_name as tool, count(*) as uses, null::bigint as call_id from metered group by run_id, tool_name having count(*) > 2
       union all select run_id, 'expensive_operation', tool_name, null, call_id from metered where cost_usd > 0.001::double or co2_grams > 1""",
    CALL_CTES,
)
def pruning(t):
    return tel.pruning_suggestions(metered(t))


def keyed_calls(t):
    return t("calls").withColumn("key", imp.content_key(F.coalesce("model", F.lit("none")), {"tool": F.col("tool_name"), "props": F.col("inputs")}))


@query(
    "cache_lookup", ["calls"],
    """select c.call_id, s.stored_by is not null as hit, s.outputs as cached_outputs from calls c left join
       (select coalesce(model, 'none') as m, tool_name, inputs, min(call_id) as stored_by, arg_min(outputs, call_id) as outputs from calls where cache_hit group by 1, 2, 3) s
       on coalesce(c.model, 'none') = s.m and c.tool_name = s.tool_name and c.inputs = s.inputs""",
)
def cache_lookup(t):
    calls = keyed_calls(t)
    return tel.cache_lookup(calls, tel.build_cache(calls.filter("cache_hit"))).select("call_id", "hit", "cached_outputs")


@query(
    "cache_stats", ["calls"],
    """select count(*) as calls, round(sum(cost_usd), 6) as total_cost_usd, round(sum(co2_grams), 4) as total_co2_grams, sum(tokens_used)::bigint as total_tokens,
       round(count(*) filter (where cache_hit) / count(*) * 100, 4) as cache_hit_rate from (select * from metered order by "timestamp" desc, call_id desc limit 100)""",
    CALL_CTES,
)
def cache_stats(t):
    out = tel.cache_stats(metered(t))
    return out.withColumns({"total_cost_usd": F.round("total_cost_usd", 6), "total_co2_grams": F.round("total_co2_grams", 4), "cache_hit_rate": F.round("cache_hit_rate", 4)})


@query(
    "replay_verify", ["calls"],
    """select run_id, position, issue from (select coalesce(e.run_id, a.run_id) as run_id, coalesce(e.position, a.position) as position,
         case when a.run_id is null then 'missing_call' when e.run_id is null then 'extra_call' when e.model is distinct from a.model then 'model_mismatch' when e.outputs <> a.outputs then 'output_mismatch' end as issue
         from (select run_id, model, outputs, row_number() over (partition by run_id order by "timestamp", call_id) as position from calls) e full join
           (select run_id, model, case when latency_ms > 100 then outputs || 'x' else outputs end as outputs, row_number() over (partition by run_id order by "timestamp", call_id) as position from calls where tokens_used > 0) a
         on e.run_id = a.run_id and e.position = a.position) where issue is not null""",
)
def replay_verify(t):
    calls = t("calls").select("run_id", "call_id", "timestamp", "model", "outputs", "latency_ms", "tokens_used")
    replay = calls.filter("tokens_used > 0").withColumn("outputs", F.when(F.col("latency_ms") > 100, F.concat("outputs", F.lit("x"))).otherwise(F.col("outputs")))
    return tel.replay_verify(calls, replay, ["timestamp", "call_id"])


@query(
    "latest_run", ["tx_log"],
    "select run_id, ts as started from tx_log where op = 'RUN_START' order by ts desc, run_id desc limit 1",
)
def latest_run(t):
    return tel.latest_run(t("tx_log"))


@query(
    "undo_list", ["tx_log"],
    """select run_id, op, case when op = 'ZIP' then dest else path end as path, ts from tx_log where op in ('WRITE_FILE', 'ZIP', 'MAKE_DIR') and created
       and run_id = (select run_id from tx_log where op = 'RUN_START' order by ts desc, run_id desc limit 1)""",
)
def undo_list(t):
    return tel.undo_list(t("tx_log"))


LIMITS = {"io_bytes": 1_500_000.0, "files_written": 2_000_000.0, "cpu_ms": 900_000.0, "model_calls": 1e12}


@query(
    "quota_breach", ["charges"],
    """select app, metric, usage, lim as "limit", round(least(100, usage / lim * 100), 6) as usage_pct, breach_id from
       (select app, metric, max(lim) as lim, sum(amount) as usage, arg_min(charge_id, run) filter (where run > lim) as breach_id from
         (select *, sum(amount) over (partition by app, metric order by ts, charge_id rows unbounded preceding) as run from
           (select *, case metric when 'io_bytes' then 1500000.0::double when 'files_written' then 2000000.0::double when 'cpu_ms' then 900000.0::double when 'model_calls' then 1e12::double end as lim from charges)
         where lim is not null) group by app, metric)""",
)
def quota_breach(t):
    out = tel.quota_usage(t("charges"), LIMITS)
    return out.select("app", "metric", "usage", "limit", F.round("usage_pct", 6).alias("usage_pct"), "breach_id")


@query(
    "run_sessions", ["tx_log"],
    """select run_id, started, ended, records, ended is null or ended < started as is_open from (select run_id, min(ts) filter (where op = 'RUN_START') as started,
       max(ts) filter (where op = 'RUN_END') as ended, count(*) as records from tx_log group by run_id)""",
)
def run_sessions(t):
    return tel.run_sessions(t("tx_log"))


@query(
    "live_run_stats", ["calls"],
    """select run_id, count(*) as tools_executed, round(sum(cost_usd), 6) as total_cost_usd, round(sum(co2_grams), 4) as total_co2_grams, sum(tokens_used)::bigint as total_tokens,
       round(count(*) filter (where cache_hit) / count(*) * 100, 6) as cache_hit_rate from metered group by run_id""",
    CALL_CTES,
)
def live_run_stats(t):
    out = tel.live_run_stats(metered(t)).drop("first_call", "last_call")
    return out.withColumns({"total_cost_usd": F.round("total_cost_usd", 6), "total_co2_grams": F.round("total_co2_grams", 4), "cache_hit_rate": F.round("cache_hit_rate", 6)})


@query(
    "tumbling_impact", ["calls"],
    """select cast(cast(date_trunc('day', "timestamp") as date) as varchar) as window_start, count(*) as calls, round(sum(cost_usd), 6) as cost_usd, round(sum(co2_grams), 4) as co2_grams from metered group by 1""",
    CALL_CTES,
)
def tumbling_impact(t):
    out = tel.tumbling_impact(metered(t), "1 day")
    return out.select(F.col("window_start").cast("date").cast("string").alias("window_start"), "calls", F.round("cost_usd", 6).alias("cost_usd"), F.round("co2_grams", 4).alias("co2_grams"))


# ---- files ----

CATEGORY_CASE = "case " + " ".join(
    f"when ext in ({', '.join(repr(e) for e in exts)}) then '{name}'" for name, exts in fil.CATEGORIES.items()
) + " else 'other' end"
STOP = ", ".join(f"'{w}'" for w in sorted(tx.STOP_WORDS))
CATALOG_CTES = {
    "files0": r"select path, split_part(path, '/', -1) as name, lower(regexp_extract(split_part(path, '/', -1), '[^.](\.[^./\\]+)$', 1)) as ext, size, content, modified from page_files",
    "files": f"""select path, name, ext as extension, size, modified, {CATEGORY_CASE} as category,
        case when ext = '.csv' then 'CSV data with ' || (len(trim(content)) - len(replace(trim(content), chr(10), '')) + 1) || ' rows, columns: ' || split_part(trim(content), chr(10), 1)
          when ext = '.json' then 'JSON data structure containing configuration or data records'
          when ext in ('.py', '.js') then 'Source code file (' || upper(substr(ext, 2)) || ') containing functions and logic' when ext = '.md' then 'Markdown documentation or notes'
          when ext in ('.txt', '.html') then 'Text document with approximately ' || len(regexp_extract_all(trim(content), '\\S+')) || ' words'
          when ext in ('.pdf', '.png', '.jpg', '.jpeg') then 'Visual content: ' || name else '' end as summary, case when ext in ('.txt','.md','.csv','.json','.py','.js','.html') then
        list_sort(list_distinct(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{M}}\\p{{N}}_]+'), lambda w: regexp_matches(w, '^[a-z]{{3,}}$') and w not in ({STOP}))))[1:10]
        when ext in ('.pdf', '.png', '.jpg', '.jpeg') then ['visual', 'document', 'image'] else [] end as keywords from files0""",
}


def page_catalog_rows(t):
    return fil.catalog_entries(t("page_files"), "path", "content", "size", "modified")


@query("page_catalog", ["page_files"], "select path, name, extension, size, category, summary, array_to_string(keywords, ',') as keywords from files", CATALOG_CTES)
def page_catalog(t):
    return page_catalog_rows(t).select("path", "name", "extension", "size", "category", "summary", F.array_join("keywords", ",").alias("keywords"))


@query(
    "catalog_summary", ["page_files"],
    "select category, extension, count(*) as files, round(sum(size) / 1048576.0::double, 2) as total_mb from files group by rollup(category, extension)", CATALOG_CTES,
)
def catalog_summary(t):
    return cat.catalog_summary(page_catalog_rows(t))


INDEX_SQL = "select distinct kind, term, path from (select 'keyword' as kind, unnest(keywords) as term, path from files union all select 'category', category, path from files)"


@query("inverted_index", ["page_files"], f"select kind, term, path from ({INDEX_SQL})", CATALOG_CTES)
def inverted_index(t):
    return cat.postings(cat.inverted_index(page_catalog_rows(t)))


@query("index_terms", ["page_files"], f"select kind, term, count(*) as n_files from ({INDEX_SQL}) group by kind, term", CATALOG_CTES)
def index_terms(t):
    return cat.index_terms(page_catalog_rows(t))


@query(
    "organize_plan", ["page_files"],
    """select strategy, path, folder, folder || '/' || name as target from (
         select 'by_type' as strategy, path, category || '_files' as folder, name from files union all
         select 'by_date', path, strftime(modified, '%Y-%m'), name from files union all
         select 'semantic', path, folder, name from (select *, count(*) over (partition by folder) as n from (select path, name, coalesce(keywords[1], 'misc') || '_related' as folder from files)) where n > 1)""",
    CATALOG_CTES,
)
def organize_plan(t):
    rows = page_catalog_rows(t)
    plans = [cat.organize_plan(rows, s).select(F.lit(s).alias("strategy"), "path", "folder", "target") for s in ("by_type", "by_date", "semantic")]
    return plans[0].unionByName(plans[1]).unionByName(plans[2])


@query(
    "manifest_diff",
    sql="""select url as path, case when length(html) > 4000 then 'missing-now' else 'hash-mismatch' end as issue from pages where length(html) > 4000 or contains(html, 'href')""",
)
def manifest_diff(t):
    pages = t("pages")
    old = pages.select(F.col("url").alias("path"), F.sha2("html", 256).alias("sha256"))
    now = pages.filter(F.length("html") <= 4000).select(F.col("url").alias("path"), F.sha2(F.regexp_replace("html", "href", "HREF"), 256).alias("sha256"))
    return tel.manifest_diff(old, now).select("path", "issue")


# ---- regression, charts, report ----


@query(
    "hash_split",
    sql="select o_orderkey, case when ('0x' || substr(md5(o_orderkey || ':1337'), 1, 2))::int / 255.0::double < 0.8::double then 'train' else 'val' end as part from orders",
)
def hash_split(t):
    return reg.hash_split(t("orders").select("o_orderkey"), "o_orderkey", 0.8, 1337)


@query(
    "linear_fit", ["parts"],
    """select p_type, regr_count(price, weight)::bigint as n, round(regr_slope(price, weight), 6) as slope, round(regr_intercept(price, weight), 4) as intercept from parts group by p_type""",
)
def linear_fit(t):
    out = reg.fit_one_feature(t("parts"), "price", "weight", ["p_type"])
    return out.select("p_type", "n", F.round("slope", 6).alias("slope"), F.round("intercept", 4).alias("intercept"))


LINEAR_CTES = {
    "split": "select *, ('0x' || substr(md5(p_partkey || ':1337'), 1, 2))::int / 255.0::double < 0.8::double as is_train from parts",
    # two features by their normal equations on centred sums
    "m": """select avg(price) as my, avg(weight) as m1, avg(p_size) as m2, var_pop(weight) as s11, var_pop(p_size) as s22, covar_pop(weight, p_size) as s12,
      covar_pop(weight, price) as s1y, covar_pop(p_size, price) as s2y from split where is_train""",
    "w": "select *, (s1y * s22 - s2y * s12) / (s11 * s22 - s12 * s12) as w1, (s2y * s11 - s1y * s12) / (s11 * s22 - s12 * s12) as w2 from m",
    "scored": "select s.*, my + w1 * (weight - m1) + w2 * (p_size - m2) as prediction from split s, w",
    "metrics": """select avg(power(price - prediction, 2)) as mse, avg(abs(price - prediction)) as mae, 1 - sum(power(price - prediction, 2)) / (var_pop(price) * count(*)) as r2 from scored where not is_train""",
}


def _fitted(t):
    parts = reg.hash_split(t("parts"), "p_partkey", 0.8, 1337)
    model = reg.train_linear(parts.filter("part = 'train'"), "price", ["weight", "p_size"])
    return parts, model


@query("linear_score", ["parts"], "select p_partkey, round(prediction, 4) as prediction from scored", LINEAR_CTES)
def linear_score(t):
    parts, model = _fitted(t)
    return reg.score_linear(parts, model).select("p_partkey", F.round("prediction", 4).alias("prediction"))


@query("regression_metrics", ["parts"], 'select round(mse, 3) as "MSE", round(mae, 4) as "MAE", round(r2, 6) as "R2" from metrics', LINEAR_CTES)
def regression_metrics(t):
    parts, model = _fitted(t)
    out = reg.regression_metrics(reg.score_linear(parts.filter("part = 'val'"), model), "price", "prediction")
    return out.select(F.round("MSE", 3).alias("MSE"), F.round("MAE", 4).alias("MAE"), F.round("R2", 6).alias("R2"))


@query(
    "regression_run", ["parts"],
    "select 'R2' as metric, round(r2, 6) as value, 0.6::double as threshold, r2 >= 0.6 as ok from metrics", LINEAR_CTES,
)
def regression_run(t):
    _, _, gate = reg.run_regression(t("parts"), "p_partkey", "price", ["weight", "p_size"])
    return gate.withColumn("value", F.round("value", 6))


PART_COLS = ["p_name", "p_brand", "p_type", "p_size", "weight", "price"]


@query(
    "viz_stats", ["parts"],
    " union all ".join(
        f"select '{c}' as name, '{'numeric' if c in ('p_size', 'weight', 'price') else 'categorical'}' as kind, count({c}) as sample_size, count(distinct {c}) as unique_count, "
        + (f"min({c})::double as min_value, max({c})::double as max_value, (max({c}) - min({c}))::double as value_range" if c in ("p_size", "weight", "price") else "null::double, null::double, null::double")
        + " from parts"
        for c in ["p_size", "weight", "price", "p_name", "p_brand", "p_type"]
    ),
)
def viz_stats(t):
    return prof.viz_stats(t("parts").select(*PART_COLS)).drop("pos", "has_nulls")


@query(
    "recommend_charts", ["parts"],
    """select * from (values (1, 'bar_chart', 0.85::double, 'p_name', 'p_size'), (2, 'histogram', 0.8::double, 'p_size', null), (3, 'scatter_plot', 0.75::double, 'p_size', 'weight'))
       as v("rank", chart, confidence, x_field, y_field) where (select count(distinct p_name) from parts) > 8""",
)
def recommend_charts(t):
    return prof.recommend_charts(prof.viz_stats(t("parts").select(*PART_COLS)))


@query(
    "report_lines", ["parts"],
    """select row_number() over (order by part, pos) as line_no, line from (
         select 0 as part, 0 as pos, '# Data report' as line union all select 0, 1, '' union all select 0, 2, '## Schema' union all select 0, 3, 'Rows: ' || count(*) from parts union all select 0, 4, '' union all
         select 0, 5, '| column | dtype | missing |' union all select 0, 6, '|---|---|---:|' union all
         select 1, pos, '| ' || name || ' | ' || dtype || ' | ' || printf('%.3f', missing) || ' |' from (
           select unnest(range(6)) as pos, unnest(['p_name','p_brand','p_type','p_size','weight','price']) as name, unnest(['string','string','string','number','number','number']) as dtype,
             unnest([avg((p_name is null)::int), avg((p_brand is null)::int), avg((p_type is null)::int), avg((p_size is null)::int), avg((weight is null)::int), avg((price is null)::int)]) as missing from parts) union all
         select 2, 0, '' union all select 2, 1, '## Metrics' union all
         select 3, 0, '- **MSE**: ' || printf('%.6f', mse) from metrics union all select 3, 1, '- **MAE**: ' || printf('%.6f', mae) from metrics union all select 3, 2, '- **R2**: ' || printf('%.6f', r2) from metrics)""",
    LINEAR_CTES,
)
def report_lines(t):
    parts, model = _fitted(t)
    metrics = reg.regression_metrics(reg.score_linear(parts.filter("part = 'val'"), model), "price", "prediction")
    return writers.quality_report(prof.profile(t("parts").select(*PART_COLS)), metrics)
