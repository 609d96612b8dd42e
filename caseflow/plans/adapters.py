"""The driver's tables seen as the inputs of the operators.

Each adapter is one select that Spark and the check database both understand, so a query and its reference SQL
start from the same rows. ``{name}`` stands for a table or another adapter.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from caseflow.session import held

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]

PLACES = "ORD,LAX,JFK,LGA,ATL,DFW,DEN,PHX,LAS,SEA,SFO,MIA,BOS,MSP,DTW,PHL,CLT,IAH,EWR,MCO,LHR,CDG,NRT,FRA,AMS"
FIRST_NAMES = "Maria,John,Anna,Peter,Lucia,Omar,Ines,David,Sofia,Marko,Elena,Tomas,Greta,Pavel,Nadia,Hugo"


def _pick(items: str, position: str) -> str:
    """The item at a 0-based position of a comma list."""
    return f"split_part('{items}', ',', cast({position} + 1 as int))"


def _place(engine: str, position: str) -> str:
    """The airport at a 0-based position; in Spark from a constant array, as ``split_part`` cuts its list anew in every row."""
    if engine != "spark":
        return _pick(PLACES, position)
    at = f"cast({position} + 1 as int)"
    return f"coalesce(try_element_at(split('{PLACES}', ','), {at}), case when {at} is not null then '' end)"


def _letters(digest: str, count: int) -> str:
    """Pseudo-random lower-case letters from a hex digest."""
    return f"translate(substr({digest}, 1, {count}), '0123456789abcdef', 'bcdfghaeiolmnrst')"


def _days(engine: str, later: str, earlier: str) -> str:
    """Whole days between two times, as an integer."""
    if engine == "spark":
        return f"datediff({later}, {earlier})"
    return f"cast(date_diff('day', cast({earlier} as date), cast({later} as date)) as int)"


def _sql(engine: str) -> dict[str, tuple[list[str], str]]:
    d = _days(engine, "l_shipdate", "o_orderdate")
    cap = lambda s: f"upper(substr({s}, 1, 1)) || substr({s}, 2, 40)"
    dig = "lpad(cast((c_custkey * 7919 + 2015550000) % 10000000000 as string), 10, '0')"
    wide = "decimal(38, 0)" if engine == "spark" else "hugeint"
    # Spark joins in the order given: the small tables first, so that line items are dealt once
    fact_tables = """{lineitem} join {orders} on l_orderkey = o_orderkey
                 join {supplier} on l_suppkey = s_suppkey join {customer} on o_custkey = c_custkey"""
    if engine == "spark":
        fact_tables = """(select l.*, s_nationkey from {lineitem} l join {supplier} on l_suppkey = s_suppkey)
                 join (select o_orderkey, o_orderdate, c_nationkey from {orders} join {customer} on o_custkey = c_custkey) on l_orderkey = o_orderkey"""
    ts = "cast(ts as timestamp)" if engine == "spark" else "ts"
    ts_seconds = "unix_seconds(cast(ts as timestamp))" if engine == "spark" else "cast(floor(epoch(ts)) as bigint)"
    return {
        "facts_raw": (
            ["lineitem", "orders", "supplier", "customer"],
            f"""
            select ((cast(l_orderkey as {wide}) * 8 + l_linenumber) * 4294967296 + l_partkey) * 4294967296 + l_suppkey as fact_id,
                   l_orderkey as order_key,
                   chr(cast(65 + s_nationkey as int)) || 'A' as carrier,
                   cast(l_suppkey as string) as fl_num,
                   cast(l_shipdate as date) as flight_date,
                   {_place(engine, "s_nationkey")} as origin,
                   {_place(engine, "c_nationkey")} as dest,
                   case when l_linenumber = 7 and l_returnflag = 'A' then 'n/a' else cast({d} * 4 as string) end as arr_delay,
                   cast({d} * 2 as string) as dep_delay,
                   case l_returnflag when 'R' then '1.00' when 'A' then '0.00' else 'N' end as cancelled,
                   case when l_returnflag = 'R' then l_linestatus end as cancellation_code
            from {fact_tables}
            """,
        ),
        "claims": (
            ["orders", "facts_raw"],
            """
            select o_orderkey as claim_id, 'user_' || cast(o_custkey as string) as user, '@carrier' || coalesce(carrier, '') as airline,
                   case when o_orderkey % 11 <> 0 and o_orderkey % 13 <> 0 then carrier || fl_num end as flight_number,
                   case o_orderkey % 5 when 0 then cast(flight_date as string) when 1 then cast(flight_date + 1 as string)
                     when 2 then cast(flight_date - 1 as string) when 3 then cast(flight_date + 40 as string) end as flight_date,
                   case when o_orderkey % 13 <> 0 then origin end as origin,
                   case when o_orderkey % 7 <> 0 then dest end as destination,
                   case o_orderkey % 4 when 0 then 'cancelled' when 1 then 'delay, delayed' when 2 then 'baggage' end as incident_type,
                   case o_orderkey % 6 when 0 then 'Flight cancelled, I need my money back' when 1 then 'Delayed for hours at the gate'
                     when 2 then 'They lost bag number two and charged a bag fee' when 3 then 'Paid for WiFi that did not work'
                     when 4 then 'My luggage is still missing' else 'Terrible service' end as original_text
            from {orders} left join (
              select order_key, min_by(carrier, fact_id) as carrier, min_by(fl_num, fact_id) as fl_num,
                     min_by(flight_date, fact_id) as flight_date, min_by(origin, fact_id) as origin, min_by(dest, fact_id) as dest
              from {facts_raw} group by order_key) own on o_orderkey = order_key
            """,
        ),
        "people": (
            ["customer"],
            f"""
            select c_custkey, c_nationkey, c_mktsegment, c_acctbal, first_name, {cap("l0")} as last_name,
                   lower(substr(first_name, 1, 1)) || '.' || l0 as mail_user, {cap("f0")} || ' ' || kind as firm
            from (select *, {_pick(FIRST_NAMES, "c_custkey % 16")} as first_name, {_pick("Corp,Inc,LLC,Group", "c_custkey % 4")} as kind,
                         {_letters("md5(cast(c_custkey as string))", 8)} as l0, {_letters("md5('firm' || cast(c_custkey % 400 as string))", 6)} as f0
                  from {{customer}}) a
            """,
        ),
        "crm": (
            ["people"],
            f"""
            select c_custkey * 2 as pos, c_custkey as base_key, 'CUST' || lpad(cast(c_custkey as string), 7, '0') as customer_id,
                   first_name || ' ' || last_name as name,
                   case when c_custkey % 23 = 5 then '' when c_custkey % 17 = 0 then mail_user || '(at)mail'
                        else mail_user || '@' || {_pick("acme.com,mail.org,techflow.io,example.net", "c_custkey % 4")} end as email,
                   case when c_custkey % 19 = 0 then '' when c_custkey % 17 = 0 then 'not-a-phone'
                        when c_custkey % 4 = 0 then '(' || substr({dig}, 1, 3) || ') ' || substr({dig}, 4, 3) || '-' || substr({dig}, 7, 4)
                        when c_custkey % 4 = 1 then substr({dig}, 1, 3) || '.' || substr({dig}, 4, 3) || '.' || substr({dig}, 7, 4)
                        when c_custkey % 4 = 2 then '1' || {dig} else {dig} end as phone,
                   case when c_custkey % 29 = 0 then '' else firm end as company,
                   case when c_custkey % 17 = 0 then 'invalid' when c_custkey % 31 = 0 then ''
                        when c_custkey % 3 = 0 then '$' || cast(cast(round(abs(c_acctbal) * 9) as bigint) as string)
                        else cast(cast(round(abs(c_acctbal) * 9) as bigint) as string) end as revenue,
                   {_pick("active,inactive,potential,unknown", "c_custkey % 4")} as status,
                   case when c_custkey % 5 = 0 then '2023-12-01' when c_custkey % 17 = 0 then 'never' else '2024-01-15' end as last_contact
            from {{people}}
            union all
            select c_custkey * 2 + 1, c_custkey, 'CUST' || lpad(cast(c_custkey as string), 7, '0'),
                   first_name || ' ' || substr(last_name, 1, 3) || 'x' || substr(last_name, 5, 40),
                   case when c_custkey % 3 = 0 then '' else substr(mail_user, 3, 40) || '@acme.com' end,
                   {dig}, firm, cast(cast(round(abs(c_acctbal) * 11) as bigint) as string), 'active', '2024-01-20'
            from {{people}} where c_mktsegment = 'MACHINERY'
            """,
        ),
        "payments": (
            ["orders", "people"],
            """
            select o_orderkey as transaction_id,
                   case when o_orderkey % 97 = 0 then 'CUST' || lpad(cast(o_custkey + 90000000 as string), 8, '0')
                        when o_orderkey % 11 = 0 then first_name || ' ' || substr(last_name, 1, 7)
                        else 'CUST' || lpad(cast(o_custkey as string), 7, '0') end as customer_reference,
                   case when o_orderkey % 101 = 0 then 'invalid' else cast(cast(round(o_totalprice * 100) as bigint) as string) end as amount,
                   cast(o_orderdate as date) as pay_date,
                   case o_orderstatus when 'F' then 'completed' when 'O' then 'pending' else 'failed' end as status
            from {orders} join {people} on o_custkey = c_custkey
            """,
        ),
        "tickets": (
            ["orders", "people"],
            """
            select o_orderkey as ticket_id,
                   case o_orderkey % 3 when 0 then first_name || ' ' || last_name || ' from ' || firm
                     when 1 then first_name || ' ' || last_name || ' - ' || firm else first_name || ' ' || last_name end as customer,
                   case when o_orderkey % 9 = 0 then 'help' || cast(o_custkey as string) || '@nowhere.example'
                     else mail_user || '@acme.com' end as email,
                   cast(o_orderdate as date) as created,
                   case o_orderkey % 4 when 0 then 'angry' when 1 then 'frustrated' when 2 then 'concerned' else 'interested' end as sentiment,
                   case o_orderkey % 6 when 0 then 'potential upsell $50k' when 1 then '$2000 daily loss' else 'minimal' end as revenue_impact
            from {orders} join {people} on o_custkey = c_custkey
            """,
        ),
        "cust360": (
            ["crm"],
            """
            select pos, customer_id, name, email, phone, company, status, last_contact,
                   case when base_key % 97 = 0 then null else cast(base_key * 37 % 90000 as double) + 0.5 end as revenue,
                   case base_key % 7 when 0 then 'angry' when 1 then 'concerned' when 2 then 'frustrated' when 3 then 'happy' end as sentiment,
                   case base_key % 9 when 0 then 'potential upsell $50k' when 1 then 'interested in upgrade' when 2 then 'upsell 12,500' else 'minimal' end as revenue_impact,
                   cast(base_key % 5 as bigint) as support_issues,
                   case base_key % 8 when 0 then 'failed' when 1 then 'pending' else 'completed' end as payment_status
            from {crm}
            """,
        ),
        "customers_a": (
            ["crm"],
            "select base_key as pid, customer_id as id, name, email, phone, company, revenue, status from {crm} where pos = base_key * 2",
        ),
        "customers_b": (
            ["people"],
            f"""
            select c_custkey as rid,
                   case when c_custkey % 13 = 0 then '' when c_custkey % 37 = 0 or c_custkey % 19 = 0 then 'OLD' || cast(c_custkey as string)
                        else 'CUST' || lpad(cast(c_custkey as string), 7, '0') end as id,
                   case when c_custkey % 19 = 0 then 'Estate ' || substr(last_name, 3, 2) when c_custkey % 3 = 0 then last_name || ', ' || first_name
                        when c_custkey % 3 = 1 then first_name || ' ' || last_name else substr(first_name, 1, 1) || ' ' || last_name end as name,
                   case c_custkey % 7 when 0 then mail_user || '@other.example' when 1 then ''
                        else mail_user || '@' || {_pick("acme.com,mail.org,techflow.io,example.net", "c_custkey % 4")} end as email,
                   case when c_custkey % 9 = 0 then '2015550123' else {dig} end as phone,
                   case when c_custkey % 8 = 0 then 'Unrelated Holding' else firm end as company,
                   case when c_custkey % 41 = 0 then 'n/a'
                        else cast(cast(round(abs(c_acctbal) * 9 * (1 + (c_custkey % 31 - 15) / 100.0)) as bigint) as string) end as revenue,
                   {_pick("current,suspended,closed,unknown", "c_custkey % 4")} as status
            from {{people}}
            """,
        ),
        "orders_ref": (
            ["orders"],
            """
            select o_orderkey as rid, case when o_orderkey % 19 = 0 then 'gone-' else '' end || cast(o_orderkey as string) as id,
                   cast(cast(round(o_totalprice * (1 + (o_orderkey % 31 - 15) / 100.0)) as bigint) as string) as amount,
                   case o_orderkey % 5 when 0 then 'active' when 1 then 'suspended' when 2 then 'ended' when 3 then 'live' else 'other' end as status
            from {orders}
            """,
        ),
        "orders_own": (
            ["orders"],
            """
            select o_orderkey as pid, cast(o_orderkey as string) as id,
                   case when o_orderkey % 53 = 0 then 'unknown' else '$' || cast(cast(round(o_totalprice) as bigint) as string) end as amount,
                   case o_orderstatus when 'F' then 'closed' when 'O' then 'active' else 'paused' end as status
            from {orders}
            """,
        ),
        "messages": (
            ["documents"],
            """
            select doc_id, case doc_id % 8
                     when 0 then '@united UA123 on 2/14 from ORD was cancelled, please refund me. '
                     when 1 then 'we sat at LAX, AA456 delayed 4 hours on Feb 15th and our connection left. '
                     when 2 then 'no seat on DL789 from ATL to JFK, cancelled yesterday and no refund so far. '
                     when 3 then 'stuck 3 hours at gate, 5 hr delay, baggage lost on 03/07/2015 '
                     when 4 then 'B6 234 bumped for maintenance, luggage gone, paid $1,250.50 '
                     else '' end || text as tweet,
                   case doc_id % 4 when 0 then '@united' when 1 then 'AmericanAir' when 2 then '@Delta' else 'other' end as airline,
                   case doc_id % 3 when 0 then 'negative' when 1 then 'neutral' else 'positive' end as airline_sentiment,
                   source as name, cast(date '2015-02-10' + cast(doc_id % 11 as int) as timestamp) as tweet_created
            from {documents}
            """,
        ),
        "calls": (
            ["events"],
            f"""
            select event_id as call_id, 'run_' || lpad(cast(user_id as string), 6, '0') as run_id, {ts} as "timestamp",
                   case event_type when 'view' then 'read_csv' when 'click' then 'train_lr' when 'signup' then 'generate'
                     when 'error' then 'write_file' else 'emit_report' end as tool_name,
                   case when event_type = 'signup' then case event_id % 4 when 0 then 'claude-3-5-sonnet' when 1 then 'gpt-4'
                     when 2 then 'gpt-3.5-turbo' else 'in-house' end end as model,
                   props as inputs, cast(event_id % 50 as string) as outputs, value as latency_ms,
                   (event_id * 37) % 500 as tokens_used, event_id % 3 = 0 as cache_hit
            from {{events}}
            """.replace('"timestamp"', "`timestamp`" if engine == "spark" else '"timestamp"'),
        ),
        "tx_log": (
            ["events"],
            f"""
            select event_id, 'run_' || lpad(cast(user_id as string), 6, '0') as run_id, {ts_seconds} as ts,
                   case event_type when 'signup' then 'RUN_START' when 'view' then 'WRITE_FILE' when 'click' then 'MAKE_DIR'
                     when 'error' then 'ZIP' else 'RUN_END' end as op,
                   'out/' || cast(event_id as string) as path, 'zip/' || cast(event_id as string) as dest, event_id % 2 = 0 as created
            from {{events}}
            """,
        ),
        "charges": (
            ["events"],
            f"""
            select event_id as charge_id, {ts} as ts, 'app_' || cast(user_id % 40 as string) as app,
                   case event_type when 'view' then 'io_bytes' when 'click' then 'files_written' when 'signup' then 'cpu_ms'
                     when 'error' then 'model_calls' else 'unmetered' end as metric,
                   cast(round(value * 100) as double) as amount
            from {{events}}
            """,
        ),
        "page_files": (
            ["pages"],
            f"""
            select page_id, split_part(split_part(url, '?', 1), '#', 1) || case page_id % 6 when 0 then '.txt' when 1 then '.csv' when 2 then '.pdf'
                     when 3 then '.html' when 4 then '.py' else '' end as path, html as content, length(html) as size,
                   cast(date '2024-01-01' + cast(page_id % 400 as int) as timestamp) as modified
            from {{pages}}
            """,
        ),
        "parts": (
            ["part"],
            """
            select p_partkey, p_name, p_brand, p_type, p_size,
                   cast(p_partkey % 1000 as double) + (p_partkey * 7 % 13) * 0.5 as weight, p_retailprice as price
            from {part}
            """,
        ),
    }


_SPARK, _CHECK = _sql("spark"), _sql("check")


class Inputs:
    """Tables and adapters of one data folder as DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self._made, self._held = spark, folder, {}, set()

    def __call__(self, name: str) -> DataFrame:
        if name not in self._made:
            if name in TABLES:
                self._made[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                needs, sql = _SPARK[name]
                self._made[name] = self.spark.sql(sql, **{n: self(n) for n in needs})
        return self._made[name]

    def hold(self, name: str) -> DataFrame:
        """The adapter's rows written once, for queries that read them more than once; adapters on top read them from there."""
        if name not in self._held:
            self._made[name] = held(self(name))
            self._held.add(name)
        return self._made[name]


def with_adapters(names: list[str], body: str, extra: dict[str, str] | None = None) -> str:
    """Reference SQL: the adapters (and further named selects) as CTEs, then the body."""
    done: dict[str, str] = {}

    def add(name: str) -> None:
        if name in TABLES or name in done:
            return
        needs, sql = _CHECK[name]
        for n in needs:
            add(n)
        done[name] = sql.format(**{n: n for n in needs})

    for name in names:
        add(name)
    done.update(extra or {})
    if not done:
        return body
    return "with " + ",\n".join(f"{n} as ({s})" for n, s in done.items()) + "\n" + body
