"""Queries over facts, claims and complaint texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import text as tx
from caseflow.operators import decisions as dec
from caseflow.operators import extraction as ext
from caseflow.operators import matching as mat
from caseflow.operators import shaping as shp
from caseflow.plans.registry import query
from caseflow.sources import readers

FLAG_SQL = """
select *, coalesce(try_cast(arr_delay as double), 0.0) as arr_delay_minutes, coalesce(try_cast(dep_delay as double), 0.0) as dep_delay_minutes,
  cancelled in ('1.00', 'Y') as is_cancelled, carrier || fl_num as entity_key, cast(flight_date as varchar) as date_str,
  coalesce(try_cast(arr_delay as double), 0.0) >= 180 as significant_delay,
  cancelled in ('1.00', 'Y') or coalesce(try_cast(arr_delay as double), 0.0) >= 180 as refund_eligible
from facts_raw"""

# one row per entity and date: the last row's values at the first row's place
UNIQUE_SQL = """
select first_id as pos, f.* exclude (fact_id) from facts f join
  (select entity_key, date_str, min(fact_id) as first_id, max(fact_id) as last_id from facts group by 1, 2) g on f.fact_id = g.last_id"""

CLAIM_KEYS_SQL = """
select *, nullif(regexp_extract(upper(flight_number), '^[A-Z]{1,3}[0-9]+'), '') as k, try_cast(flight_date as date) as fd from claims
where coalesce(flight_number, '') <> '' or coalesce(origin, '') <> ''"""

TIER_SQL = {
    "t12": """
select claim_id, case when off = 0 then 1 else 2 end as tier, case when off = 0 then 100 else 90 - 10 * abs(off) end as score, off as tie, pos
from (select claim_id, k, fd, unnest([-1, 0, 1]) as off from keyed where k is not null and fd is not null) c
join uniq f on f.entity_key = c.k and f.date_str = cast(c.fd + c.off as varchar)""",
    "t3": """
select claim_id, 3 as tier, 60 as score, 0 as tie, min(pos) as pos from keyed join uniq on entity_key = k
where claim_id not in (select claim_id from t12) group by claim_id""",
    "t4": """
select claim_id, 4 as tier, score, 0 as tie, pos from (
  select c.claim_id, f.pos,
    case when f.origin = c.origin then 30 else 0 end + case when f.dest = c.destination then 30 else 0 end
    + case when c.fd is null then 0 when f.date_str = cast(c.fd as varchar) then 20
        when abs(date_diff('day', c.fd, cast(f.date_str as date))) <= 1 then 15 else 0 end as score
  from keyed c join uniq f on f.origin = c.origin or f.dest = c.destination
  where c.claim_id not in (select claim_id from t12) and c.claim_id not in (select claim_id from t3)) where score >= 40""",
    "best": """
select * from (select *, row_number() over (partition by claim_id order by tier, score desc, tie, pos) as rn
  from (select * from t12 union all select * from t3 union all select * from t4)) where rn = 1""",
    "cascade": """
select *, case when coalesce(flight_number, '') = '' and coalesce(origin, '') = '' then 'insufficient_data' when score is null then 'no_matches'
    when final_pct >= 70 then 'matched' else 'low_confidence' end as match_status
from (select c.*, b.tier, b.score, f.carrier as bts_carrier, f.fl_num as bts_flight_num, f.date_str as bts_date, f.origin as bts_origin,
    f.dest as bts_destination, f.is_cancelled as bts_cancelled, f.significant_delay as bts_delayed, f.arr_delay_minutes as bts_minutes,
    least(100, b.score + case when coalesce(c.incident_type, '') like '%cancel%' and f.is_cancelled then 10
      when coalesce(c.incident_type, '') like '%delay%' and f.significant_delay then 10
      when f.is_cancelled or f.significant_delay then 5 else 0 end) as final_pct
  from claims c left join best b on c.claim_id = b.claim_id left join uniq f on f.pos = b.pos)""",
}
MATCH_CTES = {"facts": FLAG_SQL, "uniq": UNIQUE_SQL, "keyed": CLAIM_KEYS_SQL, **TIER_SQL}
MATCH_USES = ["facts_raw", "claims"]

INTL = "('LHR','CDG','NRT','ICN','FRA','AMS','YYZ','YVR')"
BUSY = "('JFK','LAX','ORD','ATL','DFW','SFO','LAS','SEA')"
DECIDE_CTES = {
    **MATCH_CTES,
    "ruled": f"""
select *, bts_origin in {INTL} or bts_destination in {INTL} as abroad,
  case when bts_origin in {INTL} or bts_destination in {INTL} then 800.0::double
    when bts_origin in {BUSY} or bts_destination in {BUSY} then 450.0::double else 350.0::double end as price,
  regexp_matches(lower(original_text), 'lost bag|baggage|luggage|suitcase|checked bag') as bag,
  regexp_matches(lower(original_text), 'wifi|internet') as wifi,
  regexp_matches(lower(original_text), 'fee') as fee
from cascade where match_status = 'matched'""",
    "decided": """
select *, bts_cancelled as c, not bts_cancelled and bts_minutes >= case when abroad then 360 else 180 end as s from ruled""",
    "decisions": """
select *, c or s or bag or wifi as eligible, case when c or s then 'cash' when bag or wifi then 'partial' end as refund_type,
  case when c or s then 7 when bag or wifi then 30 end as deadline,
  least(price, case when bag and fee then 75.0::double else price end, case when wifi then 25.0::double else price end) as amount,
  concat_ws('; ', case when c then 'Flight cancellation' end, case when s then 'Significant delay (' || printf('%.1f', bts_minutes / 60) || ' hours)' end,
    case when bag then 'Potential baggage delay/loss' end, case when wifi then 'WiFi service issues' end) as reasons,
  concat_ws('; ', case when c then '14 CFR 259.5(b)(1) - Automatic refund required for cancelled flights' end,
    case when s and abroad then '14 CFR 259.5(b)(2) - International flights delayed 360+ minutes' when s then '14 CFR 259.5(b)(2) - Domestic flights delayed 180+ minutes' end,
    case when bag then '14 CFR 259.8 - Baggage delayed 12+ hours' end,
    case when wifi then '14 CFR 259.6 - Ancillary services not provided (WiFi, seat assignments, etc.)' end) as citations,
  coalesce(nullif(concat_ws('; ', case when c then 'BTS data confirms flight was cancelled' end, case when s then 'BTS data shows ' || printf('%.1f', bts_minutes) || ' minute arrival delay' end,
    case when bag then 'Tweet mentions baggage issues' end, case when wifi then 'Tweet mentions WiFi/internet problems' end), ''), 'Flight performance within normal parameters') as evidence
from decided""",
}


def facts(t):
    return shp.derive_fact_flags(t("facts_raw"))


def matched_inputs(t):
    """Claims and facts for matching: raw facts are joined once for both, claims written as every tier reads them."""
    t.hold("facts_raw")
    return t.hold("claims"), facts(t)


def cascade(t):
    return mat.match_cascade(*matched_inputs(t))


def decided_cases(t):
    """Matched and decided claims, and the unmatched rest."""
    all_claims = cascade(t)
    return dec.decide(mat.matched_cases(all_claims)), mat.unmatched_cases(all_claims)


@query(
    "fact_flags", ["facts_raw"],
    "select cast(fact_id as varchar) as fact_id, entity_key, date_str, arr_delay_minutes, dep_delay_minutes, is_cancelled, significant_delay, refund_eligible from facts",
    {"facts": FLAG_SQL},
)
def fact_flags(t):
    return facts(t).select(
        F.col("fact_id").cast("string").alias("fact_id"), "entity_key", "date_str", "arr_delay_minutes", "dep_delay_minutes", "is_cancelled", "significant_delay", "refund_eligible"
    )


@query(
    "group_performance", ["facts_raw"],
    """select carrier, count(*) as total, round(avg(is_cancelled::int), 6) as cancellation_rate, round(avg(significant_delay::int), 6) as significant_delay_rate,
       round(avg(refund_eligible::int), 6) as refund_eligible_rate, cast(min(flight_date) as varchar) as first_date, cast(max(flight_date) as varchar) as last_date
       from facts group by rollup(carrier)""",
    {"facts": FLAG_SQL},
)
def group_performance(t):
    out = mat.group_performance(facts(t))
    return out.select(
        "carrier", "total", *[F.round(c, 6).alias(c) for c in ("cancellation_rate", "significant_delay_rate", "refund_eligible_rate")],
        F.col("first_date").cast("string").alias("first_date"), F.col("last_date").cast("string").alias("last_date"),
    )


@query("filter_in", sql="select l_orderkey, l_linenumber, l_returnflag, l_quantity from lineitem where l_returnflag in ('R', 'A')")
def filter_in(t):
    return shp.filter_in(t("lineitem"), "l_returnflag", ["R", "A"]).select("l_orderkey", "l_linenumber", "l_returnflag", "l_quantity")


@query(
    "filter_handles", ["messages"],
    "select airline, count(*) as n from messages where airline in ('united', '@united', 'AmericanAir', '@AmericanAir') group by airline",
)
def filter_handles(t):
    return shp.filter_handles(t("messages"), "airline", ["@united", "AmericanAir"]).groupBy("airline").agg(F.count(F.lit(1)).alias("n"))


@query(
    "filter_date_range",
    sql="""select o_orderkey, o_totalprice from orders where o_orderdate >= timestamp '1996-03-01' and o_orderdate <= timestamp '1997-02-28'""",
)
def filter_date_range(t):
    return shp.filter_date_range(t("orders"), "o_orderdate", "1996-03-01", "1997-02-28").select("o_orderkey", "o_totalprice")


@query(
    "filter_month",
    sql="select l_orderkey, l_linenumber, l_partkey, l_quantity from lineitem where year(l_shipdate) = 1997 and month(l_shipdate) = 12",
)
def filter_month(t):
    return shp.filter_month(t("lineitem"), "l_shipdate", "1997-12").select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "parse_dates_multi", ["facts_raw"],
    """select date_form, count(*) filter (where d is not null) as kept, count(*) filter (where d is null) as dropped, cast(max(d) as varchar) as last_date from (
         select date_form, case date_form when 0 then try_strptime(txt, '%Y-%m-%d') when 1 then try_strptime(txt, '%m/%d/%Y')
           when 2 then try_strptime(txt, '%Y/%m/%d') when 3 then try_strptime(txt, '%d-%b-%Y') end::date as d from (
           select day(flight_date) % 5 as date_form, case day(flight_date) % 5 when 0 then strftime(flight_date, '%Y-%m-%d') when 1 then strftime(flight_date, '%m/%d/%Y')
             when 2 then strftime(flight_date, '%Y/%m/%d') when 3 then strftime(flight_date, '%d-%b-%Y') else 'no date' end as txt from facts_raw)) group by date_form""",
)
def parse_dates_multi(t):
    form = F.dayofmonth("flight_date") % 5
    texts = t("facts_raw").select(
        form.cast("long").alias("date_form"),
        F.when(form == 0, F.date_format("flight_date", "yyyy-MM-dd"))
        .when(form == 1, F.date_format("flight_date", "MM/dd/yyyy"))
        .when(form == 2, F.date_format("flight_date", "yyyy/MM/dd"))
        .when(form == 3, F.date_format("flight_date", "dd-MMM-yyyy"))
        .otherwise("no date")
        .alias("txt"),
    )
    d = shp.parse_date(F.col("txt"))
    return texts.groupBy("date_form").agg(
        F.count_if(d.isNotNull()).alias("kept"), F.count_if(d.isNull()).alias("dropped"), F.max(d).cast("string").alias("last_date")
    )


@query(
    "match_tolerance", MATCH_USES,
    """select claim_id, tier, score as score_pct, f.entity_key, f.date_str from
       (select *, row_number() over (partition by claim_id order by tier, score desc, tie, pos) as rn from t12) b join uniq f on f.pos = b.pos where rn = 1""",
    {k: MATCH_CTES[k] for k in ("facts", "uniq", "keyed", "t12")},
)
def match_tolerance(t):
    out = mat.match_tolerance(*matched_inputs(t))
    return out.select("claim_id", "tier", "score_pct", F.concat("fact.carrier", "fact.fl_num").alias("entity_key"), F.col("fact.date_str").alias("date_str"))


@query(
    "match_key_only", MATCH_USES, "select claim_id, score as score_pct, f.entity_key, f.date_str from t3 join uniq f on f.pos = t3.pos",
    {k: MATCH_CTES[k] for k in ("facts", "uniq", "keyed", "t12", "t3")},
)
def match_key_only(t):
    out = mat.match_key_only(*matched_inputs(t))
    return out.select("claim_id", "score_pct", F.concat("fact.carrier", "fact.fl_num").alias("entity_key"), F.col("fact.date_str").alias("date_str"))


@query(
    "match_partial", MATCH_USES,
    "select claim_id, score as score_pct, f.entity_key, f.date_str, f.origin, f.dest from best join uniq f on f.pos = best.pos where tier = 4",
    {k: MATCH_CTES[k] for k in ("facts", "uniq", "keyed", "t12", "t3", "t4", "best")},
)
def match_partial(t):
    out = mat.match_partial(*matched_inputs(t))
    return out.select(
        "claim_id", "score_pct", F.concat("fact.carrier", "fact.fl_num").alias("entity_key"), F.col("fact.date_str").alias("date_str"),
        F.col("fact.origin").alias("origin"), F.col("fact.dest").alias("dest"),
    )


@query(
    "match_cascade", MATCH_USES,
    "select claim_id, match_status, tier, score as score_pct, final_pct, bts_carrier, bts_flight_num, bts_date, bts_origin, bts_destination, bts_cancelled from cascade",
    MATCH_CTES,
)
def match_cascade(t):
    return cascade(t).select(
        "claim_id", "match_status", "tier", "score_pct", "final_pct", F.col("fact.carrier").alias("bts_carrier"), F.col("fact.fl_num").alias("bts_flight_num"),
        F.col("fact.date_str").alias("bts_date"), F.col("fact.origin").alias("bts_origin"), F.col("fact.dest").alias("bts_destination"),
        F.col("fact.is_cancelled").alias("bts_cancelled"),
    )


@query(
    "match_status", MATCH_USES,
    """select claim_id, match_status, case when match_status = 'low_confidence' then bts_carrier || bts_flight_num || ' on ' || bts_date end as suggested
       from cascade where match_status <> 'matched'""",
    MATCH_CTES,
)
def match_status(t):
    return mat.unmatched_cases(cascade(t)).select("claim_id", "match_status", "suggested")


@query(
    "match_stats", MATCH_USES,
    """select count(*) as total, count(*) filter (where m) as successful_matches, count(*) filter (where m and final_pct >= 80) as high_confidence_matches,
       count(*) filter (where m and final_pct < 80) as low_confidence_matches, count(*) filter (where not m) as no_matches,
       count(*) filter (where s >= 90) as bin_90, count(*) filter (where s >= 80 and s < 90) as bin_80, count(*) filter (where s >= 70 and s < 80) as bin_70,
       count(*) filter (where s >= 60 and s < 70) as bin_60, count(*) filter (where s < 60) as bin_low, round(avg(m::int), 6) as match_rate
       from (select *, match_status = 'matched' as m, case when match_status <> 'insufficient_data' then coalesce(score, 0) end as s from cascade)""",
    MATCH_CTES,
)
def match_stats(t):
    return mat.match_stats(cascade(t)).withColumn("match_rate", F.round("match_rate", 6))


@query(
    "decide", MATCH_USES,
    """select claim_id, eligible as refund_eligible, refund_type, deadline as airline_deadline_days, amount as estimated_refund_amount,
       case when reasons = '' then 'No DOT refund criteria met' else reasons end as refund_reason, nullif(citations, '') as dot_rule_citation,
       evidence as evidence_summary, case when bag and not (c or s) then 'medium' else 'high' end as confidence_level,
       case when bag and not (c or s) then 'Provide baggage claim tickets and tracking information'
         when not eligible then 'Contact airline customer service for voluntary compensation' end as customer_action_required from decisions""",
    DECIDE_CTES,
)
def decide(t):
    return decided_cases(t)[0].select(
        "claim_id", "refund_eligible", "refund_type", "airline_deadline_days", "estimated_refund_amount", "refund_reason", "dot_rule_citation",
        "evidence_summary", "confidence_level", "customer_action_required",
    )


@query(
    "decision_summary", MATCH_USES,
    """select bts_carrier, count(*) as total_cases, count(*) filter (where eligible) as eligible_refunds, count(*) filter (where c) as cancelled_flights,
       count(*) filter (where s) as significant_delays, count(*) filter (where bag) as baggage_issues, count(*) filter (where wifi) as ancillary_issues,
       coalesce(sum(amount) filter (where eligible), 0.0::double) as total_refund_amount, round(avg(eligible::int), 6) as eligibility_rate,
       round(coalesce(avg(amount) filter (where eligible), 0.0::double), 4) as average_refund_amount from decisions group by rollup(bts_carrier)""",
    DECIDE_CTES,
)
def decision_summary(t):
    out = dec.decision_summary(decided_cases(t)[0])
    return out.withColumns({"eligibility_rate": F.round("eligibility_rate", 6), "average_refund_amount": F.round("average_refund_amount", 4)})


@query(
    "case_breakdown", MATCH_USES,
    """select bts_carrier, cases, amount, case when bts_carrier is null then waiting end as manual_review,
       case when bts_carrier is null then round(cases / (cases + waiting), 6) end as compliance_rate
       from (select bts_carrier, count(*) as cases, round(sum(amount), 2) as amount from decisions where eligible group by rollup(bts_carrier)),
       (select count(*) as waiting from cascade where match_status <> 'matched')""",
    DECIDE_CTES,
)
def case_breakdown(t):
    return dec.case_figures(mat.flattened(cascade(t))).withColumn("compliance_rate", F.round("compliance_rate", 6))


@query(
    "build_claim", MATCH_USES,
    """select 'RFC-20240501-' || printf('%04d', rn) as claim_no,
       claim_id, bts_carrier as carrier, reasons as reason, amount, case when refund_type = 'cash' then 'high' else 'medium' end as priority
       from (select *, row_number() over (order by claim_id) - 1 as rn from decisions where eligible)""",
    DECIDE_CTES,
)
def build_claim(t):
    decisions, _ = decided_cases(t)
    claims = dec.build_claims(decisions, "20240501", ["claim_id"])
    return claims.select(
        F.col("claim.claim_id").alias("claim_no"), "claim_id", F.col("claim.flight.carrier").alias("carrier"), F.col("claim.refund.reason").alias("reason"),
        F.col("claim.refund.estimated_amount").alias("amount"), F.col("claim.priority").alias("priority"),
    )


@query(
    "reply_queue", MATCH_USES,
    """select claim_id, "user" as recipient, bts_carrier || bts_flight_num || ' on ' || bts_date as flight, true as refund_eligible, 'high' as priority, false as requires_followup,
         'Hello @' || "user" || ', flight ' || bts_carrier || bts_flight_num || ' on ' || bts_date || ' qualifies for a refund: ' || reasons || '. Estimated amount $' || printf('%.2f', amount)
         || ' (' || case refund_type when 'cash' then 'Cash' else 'Partial' end || '), due within ' || deadline || ' days. Legal basis: ' || citations || '. Evidence: ' || evidence
         || '. This is based on public flight data and is not legal advice.' as content
       from decisions where eligible union all
       select claim_id, "user", coalesce(flight_number, 'Unknown'), false, 'medium', true, 'Hello @' || "user" || case match_status
         when 'insufficient_data' then ', please send the flight number, the flight date and both airports so we can check your case.'
         when 'low_confidence' then ', was your flight ' || bts_carrier || bts_flight_num || ' on ' || bts_date || '? Please confirm it and both cities before we continue.'
         else ', we found no flight that fits. Please check the details, or ask ' || airline || ' for a voluntary compensation.' end from cascade where match_status <> 'matched'""",
    DECIDE_CTES,
)
def reply_queue(t):
    return dec.reply_queue(*decided_cases(t))


def _money(amount: str) -> str:
    out = f"printf('%.2f', {amount})"
    for _ in range(3):  # up to a thousand millions
        out = rf"regexp_replace({out}, '([0-9])([0-9]{{3}})([.,])', '\1,\2\3')"
    return out


@query(
    "summary_blocks", MATCH_USES,
    f"""select '[{{"type":"header","text":"Daily case report"}},{{"type":"section","text":"*Total cases:* ' || (n + waiting) || '\\n*Eligible:* ' || n || '\\n*Manual review:* ' || waiting
         || '\\n*Estimated refunds:* $' || {_money('amount')} || '"}},{{"type":"section","text":"*By carrier:*\\n' || lines || '"}}'
         || case when waiting > 0 then ',{{"type":"section","text":"*' || waiting || ' cases require manual review*"}}' else '' end || ']' as blocks
       from (select count(*) as n, round(sum(amount), 2) as amount from decisions where eligible), (select count(*) as waiting from cascade where match_status <> 'matched'),
       (select string_agg(line, '\\n' order by line) as lines from (select '• ' || bts_carrier || ': ' || count(*) || ' cases, $' || {_money('round(sum(amount), 2)')} as line from decisions where eligible group by bts_carrier))""",
    DECIDE_CTES,
)
def summary_blocks(t):
    return dec.summary_blocks(dec.case_figures(mat.flattened(cascade(t))))


# ---- complaint texts ----


@query(
    "standardize_columns", ["messages"],
    "select doc_id, airline, airline_sentiment as sentiment, name as \"user\", cast(cast(tweet_created as date) as varchar) as created_day, length(tweet) as text_length from messages",
)
def standardize_columns(t):
    out = shp.standardize_columns(t("messages"))
    return out.select("doc_id", "airline", "sentiment", "user", F.col("created_at").cast("date").cast("string").alias("created_day"), F.length("text").cast("long").alias("text_length"))


@query(
    "keyword_score", ["messages"],
    "select doc_id, n > 0 as has_complaint_keywords, n as complaint_score from (select doc_id, len(regexp_extract_all(lower(tweet), '"
    + "|".join(tx.COMPLAINT_WORDS) + "')) as n from messages)",
)
def keyword_score(t):
    return ext.complaint_score(t("messages"), "tweet").select("doc_id", "has_complaint_keywords", F.col("complaint_score").cast("long").alias("complaint_score"))


@query(
    "load_stats", ["messages"],
    """select airline, airline_sentiment, count(*) as "rows", cast(cast(min(tweet_created) as date) as varchar) as first_created,
       cast(cast(max(tweet_created) as date) as varchar) as last_created, round(avg(length(tweet)), 4) as avg_text_length
       from messages group by grouping sets ((), (airline), (airline_sentiment))""",
)
def load_stats(t):
    out = ext.load_stats(t("messages"), "tweet_created", "tweet", ["airline", "airline_sentiment"])
    return out.select(
        "airline", "airline_sentiment", "rows", F.col("first_created").cast("date").cast("string").alias("first_created"),
        F.col("last_created").cast("date").cast("string").alias("last_created"), F.round("avg_text_length", 4).alias("avg_text_length"),
    )


@query(
    "text_stats",
    sql=r"""select lang, count(*) as texts, sum(len(string_split(text, chr(10))))::bigint as line_count, sum(length(text))::bigint as character_count from documents group by lang""",
)
def text_stats(t):
    return readers.text_stats(t("documents"), "text", "lang")


CODE_RE = r"\b([A-Z][A-Z0-9])\s*(\d{1,4})\b"
PLACE_RE = r"(?i)\b(" + "|".join(tx.AIRPORTS) + r")\b"


@query(
    "extract_codes", ["messages"],
    rf"""select doc_id, nullif(regexp_extract(tweet, '{CODE_RE}', 1) || regexp_extract(tweet, '{CODE_RE}', 2), '') as flight_number,
        array_to_string(list_transform(regexp_extract_all(tweet, '{CODE_RE}'), lambda x: regexp_replace(x, '\s+', '', 'g')), ',') as codes from messages""",
)
def extract_codes(t):
    c = F.col("tweet")
    return t("messages").select("doc_id", tx.entity_code(c).alias("flight_number"), F.array_join(tx.entity_codes(c), ",").alias("codes"))


PLACES_SQL = f"""select doc_id, list_distinct_ordered as p from (select doc_id,
   list_filter(u, lambda x, i: list_position(u, x) = i) as list_distinct_ordered from (
   select doc_id, list_transform(regexp_extract_all(tweet, '{PLACE_RE}', 1), lambda x: upper(x)) as u from messages))"""


@query(
    "extract_places", ["messages"],
    "select doc_id, p[1] as origin, p[2] as destination, len(p) as n_places from places", {"places": PLACES_SQL},
)
def extract_places(t):
    p = tx.airport_codes(F.col("tweet"))
    return t("messages").select("doc_id", F.get(p, F.lit(0)).alias("origin"), F.get(p, F.lit(1)).alias("destination"), F.size(p).cast("long").alias("n_places"))


MONTHS_SQL = "list_position(['jan','feb','mar','apr','may','jun','jul','aug','sep','oct','nov','dec'], lower(regexp_extract(tweet, {m}, 1)))"
FULL_RE, SHORT_RE = r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b", r"\b(\d{1,2})/(\d{1,2})\b"
NAMED_RE = r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{1,2})\b"


def _ymd(y: str, m: str, d: str) -> str:
    return f"try_cast({y} || '-' || lpad({m}, 2, '0') || '-' || lpad({d}, 2, '0') as date)"


DATES_SQL = f"""select doc_id, coalesce(
    case when length(fy) = 4 then {_ymd("fy", f"regexp_extract(tweet, '{FULL_RE}', 1)", f"regexp_extract(tweet, '{FULL_RE}', 2)")} end,
    case when regexp_matches(tweet, '{SHORT_RE}') then {_ymd("'2015'", f"regexp_extract(tweet, '{SHORT_RE}', 1)", f"regexp_extract(tweet, '{SHORT_RE}', 2)")} end,
    case when regexp_matches(tweet, '{NAMED_RE}') then {_ymd("'2015'", "cast(" + MONTHS_SQL.format(m="'" + NAMED_RE + "'") + " as varchar)", f"regexp_extract(tweet, '{NAMED_RE}', 2)")} end,
    case lower(regexp_extract(tweet, '(?i)\\b(yesterday|today)\\b', 1)) when 'yesterday' then created - 1 when 'today' then created end) as d
  from (select *, cast(tweet_created as date) as created, case when length(regexp_extract(tweet, '{FULL_RE}', 3)) = 2 then '20' || regexp_extract(tweet, '{FULL_RE}', 3)
    else regexp_extract(tweet, '{FULL_RE}', 3) end as fy from messages)"""


@query("extract_dates", ["messages"], "select doc_id, cast(d as varchar) as flight_date from dates", {"dates": DATES_SQL})
def extract_dates(t):
    return t("messages").select("doc_id", tx.mentioned_date(F.col("tweet"), F.col("tweet_created")).cast("string").alias("flight_date"))


def _incident_sql() -> str:
    hits = ", ".join(f"lower(regexp_extract(tweet, '(?i){p}', 1))" for p in tx.INCIDENT_PATTERNS)
    late = " or ".join(f"regexp_matches(tweet, '(?i){p}')" for p in tx.DELAY_PATTERNS)
    hours = ", ".join(f"try_cast(regexp_extract(tweet, '(?i){p}', 1) as int)" for p in tx.DELAY_PATTERNS)
    return f"""select doc_id, nullif(array_to_string(list_sort(list_distinct(list_filter([{hits}, case when {late} then 'delay' else '' end], lambda w: w <> ''))), ', '), '') as incident_type,
        coalesce({hours}) as delay_hours from messages"""


INCIDENTS_SQL = _incident_sql()


@query("extract_incidents", ["messages"], "select doc_id, incident_type, delay_hours from incidents", {"incidents": INCIDENTS_SQL})
def extract_incidents(t):
    return t("messages").select("doc_id", tx.incident_types(F.col("tweet")).alias("incident_type"), tx.delay_hours(F.col("tweet")).alias("delay_hours"))


EXTRACT_CTES = {
    "codes": rf"select doc_id, nullif(regexp_extract(tweet, '{CODE_RE}', 1) || regexp_extract(tweet, '{CODE_RE}', 2), '') as code from messages",
    "places": PLACES_SQL,
    "dates": DATES_SQL,
    "incidents": INCIDENTS_SQL,
    "extracted": """select doc_id, code, d, p, incident_type, case when code is not null then 30 else 0 end
      + case when len(p) >= 2 then 20 when len(p) = 1 then 10 else 0 end + case when d is not null then 20 else 0 end
      + case when incident_type is not null then 20 else 0 end as confidence_pct
      from codes join places using (doc_id) join dates using (doc_id) join incidents using (doc_id)""",
}


@query("extraction_confidence", ["messages"], "select doc_id, confidence_pct from extracted", EXTRACT_CTES)
def extraction_confidence(t):
    return ext.extract_entities(t("messages"), "tweet", F.col("tweet_created")).select("doc_id", "confidence_pct")


@query(
    "extraction_stats", ["messages"],
    """select count(*) as total_processed, count(code) as flight_numbers_extracted, count(d) as dates_extracted, count(p[1]) as airports_extracted,
       count(incident_type) as incidents_identified, count(*) filter (where confidence_pct >= 60) as high_confidence from extracted""",
    EXTRACT_CTES,
)
def extraction_stats(t):
    return ext.extraction_stats(ext.extract_entities(t("messages"), "tweet", F.col("tweet_created")))


@query(
    "enrich_hook", ["messages"],
    """select doc_id, case when confidence_pct < 60 then coalesce(nullif(upper(substr(lang, 1, 2)), ''), code) else code end as flight_number,
       case when confidence_pct < 60 then least(100, confidence_pct + 30) else confidence_pct end as confidence_pct,
       case when confidence_pct < 60 then 'regex+hook' else 'regex' end as extraction_method from extracted join documents using (doc_id)""",
    EXTRACT_CTES,
)
def enrich_hook(t):
    """A stand-in for a model: it answers with the language code as the flight number."""
    found = ext.extract_entities(t("messages"), "tweet", F.col("tweet_created")).join(t("documents").select("doc_id", "lang"), "doc_id")

    def answer(batch):
        batch["flight_number"] = batch["lang"].str[:2].str.upper()
        return batch

    slim = found.drop("tweet", "tweet_created", "name", "airline", "airline_sentiment")
    return ext.enrich_low_confidence(slim, answer).select("doc_id", "flight_number", "confidence_pct", "extraction_method")


@query(
    "intent",
    sql="select conv_id, turn, role, md5(text) as text_md5, case "
    + " ".join(f"when regexp_matches(lower(text), '{'|'.join(words)}') then '{name}'" for name, _, words in tx.INTENT_RULES)
    + f" else '{tx.INTENT_DEFAULT[0]}' end as category from conversations",
)
def intent(t):
    return t("conversations").select("conv_id", "turn", "role", F.md5("text").alias("text_md5"), tx.intent(F.col("text"))["category"].alias("category"))


@query(
    "keywords",
    sql="select doc_id, array_to_string(list_sort(list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{M}\\p{N}_]+'), lambda w: regexp_matches(w, '^[a-z]{3,}$') and w not in ("
    + ", ".join(f"'{w}'" for w in tx.STOP_WORDS) + "))))[1:10], ',') as keywords from documents",
)
def keywords(t):
    return t("documents").select("doc_id", F.array_join(tx.keywords(F.col("text")), ",").alias("keywords"))


@query(
    "parse_person_company", ["tickets"],
    r"""select ticket_id, nullif(trim(case when led <> '' then led else bare end), '') as person,
        case when trim(case when led <> '' then led else bare end) <> '' then trim(regexp_extract(customer, '(?:from|at)\s+(.+)', 1)) else '' end as company
        from (select *, regexp_extract(customer, '^([A-Za-z\s]+)\s+(?:from|at|-)\s+', 1) as led, regexp_extract(customer, '^([A-Za-z\s]+)$', 1) as bare from tickets)""",
)
def parse_person_company(t):
    return t("tickets").select("ticket_id", tx.person_company(F.col("customer")).alias("p")).select("ticket_id", "p.person", "p.company")


@query(
    "parse_money", ["messages"],
    r"""select doc_id, try_cast(replace(regexp_extract(tweet, '\$?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([kK]?)\b', 1), ',', '') as double)
        * case when regexp_extract(tweet, '\$?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([kK]?)\b', 2) <> '' then 1000 else 1 end as amount from messages""",
)
def parse_money(t):
    return t("messages").select("doc_id", tx.money_mention(F.col("tweet")).alias("amount"))
