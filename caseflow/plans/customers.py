"""Queries over customers: cleaning, duplicates, reconciliation, cross-reference and insights."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseflow.functions import similarity as sim
from caseflow.functions import typing as ty
from caseflow.operators import insights as ins
from caseflow.operators import profiling as prof
from caseflow.operators import resolve as res
from caseflow.operators import shaping as shp
from caseflow.operators import xref
from caseflow.plans.registry import query

ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789 .@()-,"


def bits_sql(source: str, key: str, text: str) -> str:
    """Per text the bit masks of its letters and its letters as numbers, for ``pct_sql`` (texts up to 62 letters)."""
    return f"""select {key} as k, {text} as s, length({text}) as n, (1::bigint << length({text})) - 1 as ones,
      list_transform(range(len(letters)), lambda q: coalesce(list_sum(list_transform(range(length({text})), lambda p:
        case when substr({text}, (p + 1)::int, 1) = letters[q + 1] then 1::bigint << p::int else 0 end)), 0)::bigint) as masks,
      list_transform(range(length({text})), lambda p: list_position(letters, substr({text}, (p + 1)::int, 1))) as idx
      from {source}, (select string_split('{ALPHABET}', '') as letters)"""


def pct_sql(a: str, b: str) -> str:
    """Indel ratio in percent of two ``bits_sql`` rows: equal 100, empty 0, halves to even."""
    lcs = (
        f"({a}.n - bit_count(list_reduce(list_prepend({a}.ones, list_transform({b}.idx, lambda q: {a}.masks[q])), "
        f"lambda v, m: ((v + (v & m)) | (v & ~m)) & {a}.ones)))"
    )
    return (
        f"(case when {a}.s = {b}.s then 100 when {a}.n = 0 or {b}.n = 0 then 0 "
        f"else cast(round_even(100.0::double * (2.0::double * {lcs} / ({a}.n + {b}.n)), 0) as int) end)"
    )


def token_key_sql(text: str) -> str:
    return f"array_to_string(list_sort(string_split(trim(regexp_replace(lower({text}), '[^a-z0-9_]+', ' ', 'g')), ' ')), ' ')"


# ---- cleaning and typing ----


@query(
    "clean_phone", ["crm"],
    """select pos, case when phone = '' then '' when length(d) = 10 then '(' || substr(d, 1, 3) || ') ' || substr(d, 4, 3) || '-' || substr(d, 7, 4) else phone end as phone
       from (select pos, phone, case when length(r) = 11 and r like '1%' then substr(r, 2) else r end as d from
       (select *, regexp_replace(phone, '[^0-9]', '', 'g') as r from crm))""",
)
def clean_phone(t):
    return t("crm").select("pos", ty.clean_phone(F.col("phone")).alias("phone"))


@query("email_check", ["crm"], r"select pos, email = '' or regexp_matches(email, '^[a-zA-Z0-9._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}$') as is_valid from crm")
def email_check(t):
    return t("crm").select("pos", ty.is_valid_email(F.col("email")).alias("is_valid"))


@query("clean_amount", ["crm"], "select pos, try_cast(nullif(regexp_replace(revenue, '[^0-9.]', '', 'g'), '') as double) as revenue from crm")
def clean_amount(t):
    return t("crm").select("pos", ty.clean_amount(F.col("revenue")).alias("revenue"))


@query(
    "coerce", ["crm"],
    r"""select pos, case when trim(revenue) = '' then 'null' when regexp_matches(revenue, '[.eE]') and try_cast(revenue as double) is not null then 'number'
        when regexp_matches(trim(revenue), '^[+-]?[0-9]+$') then 'integer' else 'string' end as kind,
        case when regexp_matches(trim(revenue), '^[+-]?[0-9]+$') then try_cast(revenue as double) end as number from crm""",
)
def coerce(t):
    return t("crm").select("pos", ty.coerce(F.col("revenue")).alias("c")).select("pos", "c.kind", "c.number")


KIND_SQL = r"""case when {v} is null or {v} in ('', 'NULL') then 'missing' when lower(trim({v})) in ('true','false','yes','no','1','0','y','n') then 'boolean'
  when regexp_matches({v}, '^-?[0-9]+$') then 'integer' when regexp_matches(trim({v}), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$') then 'number'
  when regexp_matches(trim({v}), '^([0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}|[0-9]{{2}}/[0-9]{{2}}/[0-9]{{4}}|[0-9]{{2}}-[0-9]{{2}}-[0-9]{{4}})') then 'date' else 'string' end"""


@query(
    "value_kind", ["crm"],
    f"select pos, {KIND_SQL.format(v='revenue')} as revenue_kind, {KIND_SQL.format(v='last_contact')} as contact_kind, {KIND_SQL.format(v='phone')} as phone_kind from crm",
)
def value_kind(t):
    return t("crm").select(
        "pos", *[ty.value_kind(F.col(c)).alias(n) for c, n in (("revenue", "revenue_kind"), ("last_contact", "contact_kind"), ("phone", "phone_kind"))]
    )


CRM_COLS = ["customer_id", "name", "email", "phone", "company", "revenue", "status", "last_contact"]
CRM_CELLS = " union all ".join(f"select {i} as pos, '{c}' as name, {c} as v from crm" for i, c in enumerate(CRM_COLS))
SCHEMA_SQL = """
select pos, name, rows_, case when filled = 0 then 'empty' when b = top then 'boolean' when i = top then 'integer' when n = top then 'number' when d = top then 'date' else 'string' end as type,
  case when filled = 0 then 0 else top / filled end as confidence, (rows_ - filled) / rows_ as missing_rate
from (select *, greatest(b, i, n, d, s) as top from (
  select pos, name, count(*) as rows_, count(*) filter (where kind <> 'missing') as filled, count(*) filter (where kind = 'boolean') as b,
    count(*) filter (where kind = 'integer') as i, count(*) filter (where kind = 'number') as n, count(*) filter (where kind = 'date') as d,
    count(*) filter (where kind = 'string') as s from (select pos, name, {kind} as kind from cells) group by pos, name))"""
SCHEMA_CTES = {"cells": CRM_CELLS, "inferred": SCHEMA_SQL.format(kind=KIND_SQL.format(v="v"))}


@query(
    "infer_schema", ["crm"],
    """select name, type, round(confidence, 6) as confidence, round(missing_rate, 6) as missing_rate, samples from inferred join
       (select name, array_to_string(list(v order by rn), '|') as samples from (select name, v, row_number() over (partition by name order by k) as rn
         from (select unnest(['customer_id','name','email','phone','company','revenue','status','last_contact']) as name,
           unnest([customer_id, name, email, phone, company, revenue, status, last_contact]) as v, pos as k from crm) where v <> '' and v <> 'NULL') where rn <= 5 group by name) using (name)""",
    SCHEMA_CTES,
)
def infer_schema(t):
    crm = t("crm").select(*CRM_COLS)
    samples = prof.column_samples(t("crm").select("pos", *CRM_COLS), ["pos"]).filter("name <> 'pos'")
    schema = prof.infer_schema(crm).join(F.broadcast(samples), "name")  # one row per column
    return schema.select(
        "name", "type", F.round("confidence", 6).alias("confidence"), F.round("missing_rate", 6).alias("missing_rate"), F.array_join("sample_values", "|").alias("samples")
    )


@query(
    "schema_issues", ["crm"],
    """select name, issue, level from (
         select name, 'low_confidence' as issue, 'warning' as level from inferred where confidence < 0.99 union all
         select name, 'high_missing', 'warning' from inferred where missing_rate > 0.5 union all
         select name, 'review_type', 'recommendation' from inferred where confidence < 0.7 union all
         select name, 'fill_missing', 'recommendation' from inferred where missing_rate > 0.3 union all
         select name, 'categorical', 'recommendation' from inferred where type = 'string' and confidence > 0.8)""",
    SCHEMA_CTES,
)
def schema_issues(t):
    return prof.schema_issues(prof.infer_schema(t("crm").select(*CRM_COLS)), threshold=0.99)


@query(
    "infer_props_schema",
    sql="""select name, type, round(confidence, 6) as confidence, round(missing_rate, 6) as missing_rate from inferred""",
    extra={
        "cells": "select k as name, json_extract_string(props, '$.' || k) as v from (select props, unnest(json_keys(props)) as k from events)",
        "n_all": "select count(props) as rows_ from events",
        "inferred": """select name, case when b = top then 'boolean' when i = top then 'integer' when n = top then 'number' when d = top then 'date' else 'string' end as type,
          case when filled = 0 then 0 else top / filled end as confidence, (rows_ - filled) / rows_ as missing_rate
          from (select *, greatest(b, i, n, d, s) as top from (select name, count(*) filter (where kind <> 'missing') as filled,
            count(*) filter (where kind = 'boolean') as b, count(*) filter (where kind = 'integer') as i, count(*) filter (where kind = 'number') as n,
            count(*) filter (where kind = 'date') as d, count(*) filter (where kind = 'string') as s from (select name, """
        + KIND_SQL.format(v="v") + """ as kind from cells) group by name)), n_all""",
    },
)
def infer_props_schema(t):
    out = prof.infer_records_schema(t("events"), "props")
    return out.select("name", "type", F.round("confidence", 6).alias("confidence"), F.round("missing_rate", 6).alias("missing_rate"))


@query(
    "profile", ["crm"],
    r"""select name, rows_ as "rows", case when num = filled and num > 0 then 'number' else 'string' end as dtype, round((rows_ - filled) / rows_, 6) as missing
        from (select name, count(*) as rows_, count(*) filter (where v <> '') as filled,
          count(*) filter (where regexp_matches(trim(v), '^[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?$')) as num from cells group by name)""",
    {"cells": CRM_CELLS},
)
def profile(t):
    return prof.profile(t("crm").select(*CRM_COLS)).select("name", "rows", "dtype", F.round("missing", 6).alias("missing"))


CONTAINS_SQL = {
    "vals": "select lower(trim(name)) as n, count(*) as r from crm where trim(name) <> '' group by 1",
    "hits": "select a.n as name_a, b.n as name_b, a.r as rows_a, b.r as rows_b from vals a join vals b on a.n <> b.n and contains(b.n, a.n)",
}


CALLED_SQL = {k: v.replace("from crm", "from (select name from crm union all select split_part(name, ' ', 1) from crm where pos % 7 = 0)") for k, v in CONTAINS_SQL.items()}


@query("contains_pairs", ["crm"], "select * from hits", CALLED_SQL)
def contains_pairs(t):
    """Full names, and for some rows the first name alone, which lies inside many of them."""
    names = t("crm").select("name")
    return res.contains_pairs(names.unionByName(t("crm").filter("pos % 7 = 0").select(F.split_part("name", F.lit(" "), F.lit(1)).alias("name"))), "name")


@query(
    "messy_score", ["crm"],
    """select 2 as customer_points, least(h, 1)::bigint as name_points, g as gap_points, (2 + least(h, 1) + g)::bigint as score, 2 + least(h, 1) + g >= 3 as is_messy
       from (select count(distinct n) as h from (select name_a as n from hits union all select n from vals where r > 1)),
       (select count(*) as g from (select name from cells group by name having count(*) filter (where v is null or v = '') > 0))""",
    {"cells": CRM_CELLS, **CONTAINS_SQL},
)
def messy_score(t):
    return prof.messy_score(t("crm").select(*CRM_COLS), res.similar_name_anchors(t("crm"), "name"))


@query(
    "duplicate_summary", ["crm"],
    """select n as duplicates_found, greatest(0, 100 - 10 * n)::bigint as quality_score, firsts as first_conflicts from
       (select count(*) as n from dups), (select string_agg(first_pos || ':' || pos || ':' || v, ', ' order by pos) as firsts from (select * from dups order by pos limit 5))""",
    {"dups": """select v, first_pos, pos from (select lower(trim(customer_id)) as v, pos, min(pos) over (partition by lower(trim(customer_id))) as first_pos from crm) where pos > first_pos"""},
)
def duplicate_summary(t):
    return prof.duplicate_summary(t("crm"), "customer_id", "pos")


@query(
    "completeness", ["crm"],
    "select pos, round((" + " + ".join(f"(trim({c}) <> '')::int" for c in CRM_COLS) + f") / {len(CRM_COLS)}.0::double, 6) as completeness from crm",
)
def completeness(t):
    return t("crm").select("pos", F.round(prof.completeness(t("crm"), CRM_COLS), 6).alias("completeness"))


# ---- similarity and resolution ----


@query(
    "similarity", ["crm"],
    f"""select a.k as pos, {pct_sql("a", "b")} as ratio_pct, {pct_sql("c", "d")} as token_sort_pct,
        cast(round(100 - levenshtein(a.s, b.s) * 100.0 / greatest(a.n, b.n)) as int) as levenshtein_pct
        from a join b using (k) join c using (k) join d using (k)""",
    {
        "a": bits_sql("crm", "pos", "name"), "b": bits_sql("(select pos, company || ' ' || name as w from crm)", "pos", "w"),
        "c": bits_sql(f"(select pos, {token_key_sql('name')} as w from crm)", "pos", "w"),
        "d": bits_sql(f"(select pos, {token_key_sql("company || ' ' || name")} as w from crm)", "pos", "w"),
    },
)
def similarity(t):
    name, other = F.col("name"), F.concat("company", F.lit(" "), F.col("name"))
    return t("crm").select(
        "pos", sim.ratio(name, other).alias("ratio_pct"), sim.token_sort_ratio(name, other).alias("token_sort_pct"),
        sim.levenshtein_pct(name, other).alias("levenshtein_pct"),
    )


@query(
    "email_similarity", ["crm"],
    f"""select a.k as pos, least(100, {pct_sql("a", "b")} + case when contains(a.s, '@') and contains(b.s, '@') and split_part(a.s, '@', 2) = split_part(b.s, '@', 2) then 20 else 0 end) as email_pct
        from a join b using (k)""",
    {"a": bits_sql("crm", "pos", "email"), "b": bits_sql("(select pos, lower(replace(name, ' ', '.')) || '@acme.com' as w from crm)", "pos", "w")},
)
def email_similarity(t):
    other = F.concat(F.lower(F.regexp_replace("name", " ", ".")), F.lit("@acme.com"))
    return t("crm").select("pos", sim.email_similarity(F.col("email"), other).alias("email_pct"))


# all pairs; the name alone must reach 60, since the other fields give 5,000 of the 8,000 points at most
FUZZY_CTES = {
    "people_": "select name, email, company, min(pos) as pos from crm group by 1, 2, 3",
    "bn": bits_sql("people_", "pos", "name"), "be": bits_sql("people_", "pos", "email"), "bc": bits_sql("people_", "pos", "company"),
    "named": f"select * from (select na.k as id_a, nb.k as id_b, {pct_sql('na', 'nb')} as n from bn na join bn nb on na.k < nb.k) where n >= 60",
}


FUZZY_SQL = f"""select * from (select id_a, id_b, named.n * 50 + case when ea.n > 0 and eb.n > 0 then {pct_sql("ea", "eb")} else 0 end * 30
        + case when ca.n > 0 and cb.n > 0 then {pct_sql("ca", "cb")} else 0 end * 20 as score
        from named join be ea on ea.k = id_a join be eb on eb.k = id_b join bc ca on ca.k = id_a join bc cb on cb.k = id_b)
        where score >= 8000"""


@query("fuzzy_pairs", ["crm"], FUZZY_SQL, FUZZY_CTES)
def fuzzy_pairs(t):
    return res.fuzzy_pairs(t("crm"), "pos")


# the rule as it is told: row by row, a row without an anchor among its earlier partners becomes an anchor
CLUSTER_CTES = {
    **FUZZY_CTES,
    "pairs": FUZZY_SQL,
    "later": "select id_b as id, list(id_a) as ps, row_number() over (order by id_b) as rn from pairs group by id_b",
    "anchors": """with recursive walk(rn, found) as (
        select 0::bigint, (select coalesce(list(distinct id_a), []) from pairs where id_a not in (select id_b from pairs))
        union all select l.rn, case when list_has_any(l.ps, w.found) then w.found else list_append(w.found, l.id) end from walk w join later l on l.rn = w.rn + 1)
      select unnest(arg_max(found, rn)) as anchor from walk""",
    "taken": "select id_b as id, min(id_a) as anchor from pairs where id_a in (select anchor from anchors) and id_b not in (select anchor from anchors) group by id_b",
    "clustered": """select c.*, coalesce(t.anchor, c.first) as cluster from (
        select r.*, case when r.email <> '' then p.pos else r.pos end as first from crm r join people_ p on p.name = r.name and p.email = r.email and p.company = r.company) c
      left join taken t on t.id = c.first""",
}


@query("dedupe_customers", ["crm"], "select pos, customer_id, cluster from clustered", CLUSTER_CTES)
def dedupe_customers(t):
    return res.dedupe_customers(t("crm"), "pos").select("pos", "customer_id", "cluster")


@query(
    "golden_clusters", ["crm"],
    """select cluster, min(pos) as pos, count(*) as merged_rows, """
    + ", ".join(f"arg_min({c}, pos) filter (where {c} <> '') as {c}" for c in ["customer_id", "name", "email", "phone", "company", "status", "last_contact"])
    + ", max(try_cast(nullif(regexp_replace(revenue, '[^0-9.]', '', 'g'), '') as double)) as revenue from clustered group by cluster",
    CLUSTER_CTES,
)
def golden_clusters(t):
    rows = t("crm").drop("base_key").withColumn("revenue", ty.clean_amount(F.col("revenue")))
    return res.golden_record(res.dedupe_customers(rows, "pos"), "cluster", "pos")


@query(
    "golden_record", ["crm"],
    """select customer_id, min(pos) as pos, count(*) as merged_rows, """
    + ", ".join(f"arg_min({c}, pos) filter (where {c} <> '') as {c}" for c in ["name", "email", "phone", "company", "status", "last_contact"])
    + ", max(try_cast(nullif(regexp_replace(revenue, '[^0-9.]', '', 'g'), '') as double)) as revenue from crm group by customer_id",
)
def golden_record(t):
    rows = t("crm").drop("base_key").withColumn("revenue", ty.clean_amount(F.col("revenue")))
    return res.golden_record(rows, "customer_id", "pos")


@query("drop_absorbed", ["crm"], "select pos, customer_id from clustered where pos = cluster", CLUSTER_CTES)
def drop_absorbed(t):
    rows = res.dedupe_customers(t("crm"), "pos").select("pos", "customer_id", "cluster")
    return res.drop_absorbed(rows, rows.filter("pos <> cluster"), "pos").select("pos", "customer_id")


@query(
    "reconcile_exact", ["payments", "crm"],
    "select transaction_id, customer_reference as matched_id, 100 as match_pct from payments where customer_reference in (select customer_id from crm)",
)
def reconcile_exact(t):
    return res.reconcile_exact(t("payments"), t("crm"), "customer_reference", "customer_id").select("transaction_id", "matched_id", "match_pct")


RECONCILE_CTES = {
    "refs": "select distinct customer_reference as ref from payments where customer_reference not in (select customer_id from crm) and customer_reference <> ''",
    "names_": "select name, arg_min(customer_id, pos) as customer_id, min(pos) as pos from crm where trim(name) <> '' group by name",
    "br": bits_sql("refs", "ref", "ref"), "bn": bits_sql("names_", "name", "name"),
    "best_ref": f"""select ref, customer_id as matched_id, pct as match_pct from (select *, row_number() over (partition by ref order by pct desc, pos) as rn
      from (select a.k as ref, n.customer_id, n.pos, {pct_sql("a", "b")} as pct from br a cross join bn b join names_ n on n.name = b.k)
      where pct >= 80) where rn = 1""",
}


@query(
    "reconcile_fuzzy", ["payments", "crm"],
    "select transaction_id, matched_id, match_pct from payments join best_ref on customer_reference = ref", RECONCILE_CTES,
)
def reconcile_fuzzy(t):
    return res.reconcile_fuzzy(t("payments"), t("crm"), "customer_reference", "customer_id", "name", "pos").select("transaction_id", "matched_id", "match_pct")


@query(
    "orphans", ["payments", "crm"],
    """select transaction_id, customer_reference from payments where customer_reference not in (select customer_id from crm) and customer_reference not in (select ref from best_ref)""",
    RECONCILE_CTES,
)
def orphans(t):
    matched = res.reconcile(t("payments"), t("crm"), "customer_reference", "customer_id", "name", "pos")
    return res.orphans(t("payments"), matched, "transaction_id").select("transaction_id", "customer_reference")


@query(
    "payment_rollup", ["payments"],
    """select customer_reference, sum(try_cast(amount as double)) as total_payments, cast(max(pay_date) as varchar) as last_payment_date,
       arg_max(status, cast(pay_date as varchar) || lpad(cast(transaction_id as varchar), 20, '0')) as payment_status
       from payments where try_cast(amount as double) is not null group by customer_reference""",
)
def payment_rollup(t):
    out = res.payment_rollup(t("payments"), "customer_reference", "amount", "pay_date", "status", "transaction_id")
    return out.withColumn("last_payment_date", F.col("last_payment_date").cast("string"))


UPSERT_SQL = f"""select ticket_name, ticket_email, pos as entity_pos, score from (select *, row_number() over (partition by ticket_name, ticket_email order by score desc, pos) as rn
        from (select r.name as ticket_name, r.email as ticket_email, ek as pos, c.n * 60 + case when ee_.n > 0 then {pct_sql("re_", "ee_")} else 0 end * 40 as score
          from (select rk, ek, named.n from named) c join recs r on r.k = c.rk join bre re_ on re_.k = c.rk join bee ee_ on ee_.k = c.ek) where score >= 8000) where rn = 1"""
# all pairs; the name must reach 67, since the e-mail gives 4,000 of the 8,000 points at most
UPSERT_CTES = {
        "parsed": r"""select trim(case when led <> '' then led else bare end) as name, email, ticket_id, created, sentiment, revenue_impact from (select *, regexp_extract(customer, '^([A-Za-z\s]+)\s+(?:from|at|-)\s+', 1) as led,
          regexp_extract(customer, '^([A-Za-z\s]+)$', 1) as bare from tickets)""",
        "recs": "select *, row_number() over () as k from (select distinct name, email from parsed where name <> '' and email <> '')",
        "ents": "select name, email, min(pos) as pos from crm group by 1, 2",
        "brn": bits_sql("recs", "k", "name"), "bre": bits_sql("recs", "k", "email"), "ben": bits_sql("ents", "pos", "name"), "bee": bits_sql("ents", "pos", "email"),
        "named": f"select * from (select a.k as rk, b.k as ek, {pct_sql('a', 'b')} as n from brn a cross join ben b) where n >= 67",
    }


INSERT_CTES = {
    **UPSERT_CTES,
    "matched": UPSERT_SQL,
    "placed": r"""select t.*, m.entity_pos, sha256(t.name || chr(31) || t.email) as rec_id from parsed t
      left join matched m on m.ticket_name = t.name and m.ticket_email = t.email where t.name <> '' and t.email <> ''""",
    "newp": "select distinct rec_id as k, name, email from placed where entity_pos is null",
    "nn": bits_sql("newp", "k", "name"), "ne": bits_sql("newp", "k", "email"),
    "alike": f"select * from (select na.k as id_a, nb.k as id_b, {pct_sql('na', 'nb')} as n from nn na join nn nb on na.k < nb.k) where n >= 67",
    "pairs": f"""select id_a, id_b from (select id_a, id_b, alike.n as points from alike) join ne ea on ea.k = id_a join ne eb on eb.k = id_b
      where points * 60 + {pct_sql("ea", "eb")} * 40 >= 8000""",
    **{k: CLUSTER_CTES[k] for k in ("later", "anchors", "taken")},
    "updates": """select entity_pos as pos, count(*) as support_issues, arg_max(sentiment, {'c': created, 't': ticket_id}) as sentiment,
        arg_max(revenue_impact, {'c': created, 't': ticket_id}) as revenue_impact from placed where entity_pos is not null group by 1""",
}


@query(
    "reconcile_upsert", ["tickets", "crm"],
    """select w.name as ticket_name, w.email as ticket_email, w.entity_pos, w.score, c.customer_id, u.support_issues, u.sentiment, u.revenue_impact
       from who w join crm c on c.pos = w.entity_pos join updates u on u.pos = w.entity_pos union all
       select w.name, w.email, null, null, 'SUP-' || substr(i.anchor, 1, 12), i.support_issues, i.sentiment, i.revenue_impact
       from who w left join taken t on t.id = w.rec_id join inserted i on i.anchor = coalesce(t.anchor, w.rec_id) where w.entity_pos is null""",
    {
        **INSERT_CTES,
        "who": "select distinct p.name, p.email, p.rec_id, p.entity_pos, m.score from placed p left join matched m on m.ticket_name = p.name and m.ticket_email = p.email",
        "inserted": """select coalesce(t.anchor, p.rec_id) as anchor, count(*) as support_issues, arg_max(sentiment, {'c': created, 't': ticket_id}) as sentiment,
          arg_max(revenue_impact, {'c': created, 't': ticket_id}) as revenue_impact from placed p left join taken t on t.id = p.rec_id where entity_pos is null group by 1""",
    },
)
def reconcile_upsert(t):
    out = res.upserted_people(t("crm").drop("base_key"), res.ticket_people(t("tickets")), "pos")
    return out.withColumnsRenamed({"name": "ticket_name", "email": "ticket_email"}).select(
        "ticket_name", "ticket_email", "entity_pos", "score", "customer_id", "support_issues", "sentiment", "revenue_impact"
    )


@query(
    "upsert_customers", ["tickets", "crm"],
    """select customer_id, name, email, support_issues, sentiment, revenue_impact from crm left join updates using (pos) union all
       select 'SUP-' || substr(coalesce(t.anchor, p.rec_id), 1, 12), arg_min(name, {'c': created, 't': ticket_id}), arg_min(email, {'c': created, 't': ticket_id}), count(*),
         arg_max(sentiment, {'c': created, 't': ticket_id}), arg_max(revenue_impact, {'c': created, 't': ticket_id})
       from placed p left join taken t on t.id = p.rec_id where entity_pos is null group by coalesce(t.anchor, p.rec_id)""",
    INSERT_CTES,
)
def upsert_customers(t):
    tickets = res.ticket_people(t("tickets"))
    out = res.reconcile_upsert(t("crm").drop("base_key"), tickets, "pos")
    return out.select("customer_id", "name", "email", "support_issues", "sentiment", "revenue_impact")


# ---- cross-reference ----

MATCH_FIELDS = ["id", "email", "name"]
XREF_FIELDS = ["id", "name", "email", "phone", "company", "revenue", "status"]


def xref_matches(t):
    return xref.xref_match(t("customers_a"), t("customers_b"), MATCH_FIELDS)


XREF_CTES = {
    "pa": f"select pid as k, lower(trim(id)) as id, lower(trim(email)) as email, {token_key_sql('name')} as name from customers_a",
    "rb": f"select rid as k, lower(trim(id)) as id, lower(trim(email)) as email, {token_key_sql('name')} as name from customers_b",
    "pe": bits_sql("pa", "k", "email"), "re": bits_sql("rb", "k", "email"), "pn": bits_sql("pa", "k", "name"), "rn": bits_sql("rb", "k", "name"),
    # all pairs
    "scored": f"""select a.k as pid, b.k as rid, case when a.id <> '' and b.id <> '' then case when a.id = b.id then 100 else 0 end else 0 end
        + case when a.email <> '' and b.email <> '' then least(100, {pct_sql("ea", "eb")} + case when contains(a.email, '@') and contains(b.email, '@') and split_part(a.email, '@', 2) = split_part(b.email, '@', 2) then 20 else 0 end) else 0 end
        + case when a.name <> '' and b.name <> '' then {pct_sql("na", "nb")} else 0 end as score_sum,
        (a.id <> '' and b.id <> '')::int + (a.email <> '' and b.email <> '')::int + (a.name <> '' and b.name <> '')::int as valid_fields
      from pa a cross join rb b join pe ea on ea.k = a.k join re eb on eb.k = b.k join pn na on na.k = a.k join rn nb on nb.k = b.k""",
    "matches": """select pid, rid, score_sum, valid_fields, score_sum / valid_fields / 100 as confidence from (select *, row_number() over (partition by pid order by score_sum / valid_fields desc, rid) as rn
      from scored where valid_fields > 0 and score_sum > 60 * valid_fields) where rn = 1""",
}


@query("xref_match", ["customers_a", "customers_b"], "select pid, rid, score_sum, valid_fields, round(confidence, 6) as confidence from matches", XREF_CTES)
def xref_match(t):
    return xref_matches(t).withColumn("confidence", F.round("confidence", 6))


@query(
    "xref_missing", ["customers_a", "customers_b"],
    "select pid, 'reference_0' as source, 'missing_reference' as type, 'medium' as severity, 'Verify record existence or check for data entry errors' as recommended_action from customers_a where pid not in (select pid from matches)", XREF_CTES,
)
def xref_missing(t):
    return xref.xref_missing(t("customers_a"), xref_matches(t), "reference_0").drop("confidence_factor")


def _order_matches(t):
    own, ref = t("orders_own"), t("orders_ref")
    return own.join(ref, "id").select("pid", "rid")


@query(
    "xref_numeric", ["orders_own", "orders_ref"],
    """select pid, case when x is null or y is null then 'numeric_format_error' else 'numeric_mismatch' end as type,
       case when abs(x - y) > greatest(abs(x), abs(y)) * 0.1::double then 'high' else 'medium' end as severity, round(abs(x - y), 2) as measure
       from (select pid, try_cast(replace(replace(a.amount, '$', ''), ',', '') as double) as x, try_cast(replace(replace(b.amount, '$', ''), ',', '') as double) as y
         from orders_own a join orders_ref b using (id))
       where x is null or y is null or (abs(x - y) > greatest(abs(x), abs(y)) * 0.05::double and abs(x - y) > 1)""",
)
def xref_numeric(t):
    return xref.discrepancies(t("orders_own"), t("orders_ref"), _order_matches(t), ["amount"], "reference_0").select("pid", "type", "severity", "measure")


@query(
    "xref_status", ["orders_own", "orders_ref"],
    """select pid, 'status_mismatch' as type, sa as primary_value, sb as reference_value,
       case when (coalesce(na, '') = 'active') <> (coalesce(nb, '') = 'active') then 'high' else 'medium' end as severity
       from (select pid, a.status as sa, b.status as sb,
         case when a.status in ('active','current','live') then 'active' when a.status in ('inactive','suspended','paused') then 'inactive' when a.status in ('closed','terminated','ended') then 'closed' end as na,
         case when b.status in ('active','current','live') then 'active' when b.status in ('inactive','suspended','paused') then 'inactive' when b.status in ('closed','terminated','ended') then 'closed' end as nb
         from orders_own a join orders_ref b using (id)) where na is distinct from nb""",
)
def xref_status(t):
    out = xref.discrepancies(t("orders_own"), t("orders_ref"), _order_matches(t), ["status"], "reference_0")
    return out.select("pid", "type", "primary_value", "reference_value", "severity")


def _status_sql(c: str) -> str:
    return f"case when {c} in ('active','current','live') then 'active' when {c} in ('inactive','suspended','paused') then 'inactive' when {c} in ('closed','terminated','ended') then 'closed' end"


def _phone_sql(c: str) -> str:
    d = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    return f"case when length({d}) = 11 and {d} like '1%' then substr({d}, 2) else {d} end"


GENERIC = ["id", "name", "company"]
DISCREPANCY_CTES = {
    **XREF_CTES,
    "m": "select m.pid, m.rid, m.confidence, " + ", ".join(f"a.{c} as a_{c}, b.{c} as b_{c}" for c in XREF_FIELDS)
    + " from matches m join customers_a a using (pid) join customers_b b using (rid)",
    **{f"g{c}": bits_sql("m", "pid", f"lower(a_{c})") for c in GENERIC},
    **{f"h{c}": bits_sql("m", "pid", f"lower(b_{c})") for c in GENERIC},
    "found": " union all ".join(
        [
            f"""select pid, '{c}' as field, 'value_mismatch' as type, case when pct > 50 then 'low' else 'medium' end as severity from
                (select m.pid, {pct_sql("g", "h")} as pct from m join g{c} g on g.k = m.pid join h{c} h on h.k = m.pid where m.a_{c} <> '' and m.b_{c} <> '') where pct < 80"""
            for c in GENERIC
        ]
        + [
            """select pid, 'email', case when split_part(lower(a_email), '@', 1) = split_part(lower(b_email), '@', 1) and contains(a_email, '@') and contains(b_email, '@') then 'email_domain_mismatch' else 'email_mismatch' end,
               case when split_part(lower(a_email), '@', 1) = split_part(lower(b_email), '@', 1) and contains(a_email, '@') and contains(b_email, '@') then 'low' else 'medium' end
               from m where a_email <> '' and b_email <> '' and lower(trim(a_email)) <> lower(trim(b_email))""",
            f"""select pid, 'phone', 'phone_mismatch', 'medium' from (select pid, {_phone_sql('a_phone')} as x, {_phone_sql('b_phone')} as y from m) where x <> y and length(x) = 10 and length(y) = 10""",
            f"""select pid, 'status', 'status_mismatch', case when (coalesce(x, '') = 'active') <> (coalesce(y, '') = 'active') then 'high' else 'medium' end
               from (select pid, {_status_sql('a_status')} as x, {_status_sql('b_status')} as y from m) where x is distinct from y""",
            """select pid, 'revenue', case when x is null or y is null then 'numeric_format_error' else 'numeric_mismatch' end,
               case when abs(x - y) > greatest(abs(x), abs(y)) * 0.1::double then 'high' else 'medium' end from (
               select pid, try_cast(replace(a_revenue, '$', '') as double) as x, try_cast(replace(b_revenue, '$', '') as double) as y from m where a_revenue <> '' and b_revenue <> '')
               where x is null or y is null or (abs(x - y) > greatest(abs(x), abs(y)) * 0.05::double and abs(x - y) > 1)""",
        ]
    ),
}


@query("xref_discrepancies", ["customers_a", "customers_b"], "select pid, field, type, severity from found", DISCREPANCY_CTES)
def xref_discrepancies(t):
    out = xref.discrepancies(t("customers_a"), t("customers_b"), xref_matches(t), XREF_FIELDS, "reference_0")
    return out.select("pid", "field", "type", "severity")


@query(
    "xref_custom", ["orders_own", "orders_ref"],
    "select pid, 'custom:lost_dollar' as type, 'medium' as severity from orders_own a join orders_ref b using (id) where contains(a.amount, '$') and not contains(b.amount, '$') and b.status = 'other'",
)
def xref_custom(t):
    rule = F.col("p_amount").contains("$") & ~F.col("r_amount").contains("$") & (F.col("r_status") == "other")
    out = xref.discrepancies(t("orders_own"), t("orders_ref"), _order_matches(t), ["amount", "status"], "reference_0", {"lost_dollar": rule})
    return out.filter(F.col("type").startswith("custom:")).select("pid", "type", "severity")


@query(
    "record_confidence", ["customers_a", "customers_b"],
    """select pid, round(base, 2) as cross_reference_score, round(fill, 2) as completeness_score, round(base * 0.7::double + fill * 0.3::double, 2) as overall_score,
       case when round(base * 0.7::double + fill * 0.3::double, 2) < 0.7::double then 'low_confidence' else '' end as validation_flags
       from (select a.pid, case when m.pid is null then 0.8::double else m.confidence * (1 - 0.1::double * coalesce(f.n, 0)) end as base,
         (""" + " + ".join(f"(trim(a.{c}) <> '')::int" for c in XREF_FIELDS) + f""") / {len(XREF_FIELDS)}.0::double as fill
         from customers_a a left join m on m.pid = a.pid left join (select pid, count(*) as n from found group by pid) f on f.pid = a.pid)""",
    DISCREPANCY_CTES,
)
def record_confidence(t):
    primary, reference, matches = t("customers_a"), t("customers_b"), xref_matches(t)
    found = xref.discrepancies(primary, reference, matches, XREF_FIELDS, "reference_0")
    return xref.record_confidence(primary, xref.source_confidence(primary, matches, found, "reference_0"), XREF_FIELDS)


@query(
    "two_source_confidence", ["customers_a", "customers_b"],
    """select pid, round(base, 2) as cross_reference_score from (
         select a.pid, case when m.pid is null then 0.8::double else m.confidence * (1 - 0.1::double * coalesce(f.n, 0)) end
           * case when m.pid is null or a.pid % 2 = 1 then 0.8::double else m.confidence * (1 - 0.1::double * coalesce(f.n, 0)) end as base
         from customers_a a left join m on m.pid = a.pid left join (select pid, count(*) as n from found group by pid) f on f.pid = a.pid)""",
    DISCREPANCY_CTES,
)
def two_source_confidence(t):
    """The second source only knows customers with an even number."""
    primary, matches = t("customers_a"), xref_matches(t)
    found = xref.discrepancies(primary, t("customers_b"), matches, XREF_FIELDS, "reference_0")
    even = [x.filter("pid % 2 = 0") for x in (matches, found)]
    sources = [xref.source_confidence(primary, matches, found, "reference_0"), xref.source_confidence(primary, *even, "reference_1")]
    return xref.record_confidence(primary, xref.union_sources(sources), XREF_FIELDS).select("pid", "cross_reference_score")


@query("select_existing", ["crm"], "select pos, name, email from crm")
def select_existing(t):
    return shp.select_existing(t("crm"), ["pos", "name", "no_such_column", "email"])


# ---- insights ----


@query(
    "executive_summary", ["cust360"],
    """select count(*) as total_customers, sum(coalesce(revenue, 0)) as total_revenue, count(*) filter (where status = 'active') as active_customers,
       count(*) filter (where sentiment = 'angry') as satisfaction_risk, sum(support_issues)::bigint as support_burden,
       round(count(*) filter (where status = 'active') / count(*) * 100, 1) as retention_rate, round(sum(coalesce(revenue, 0)) / count(*), 2) as average_per_customer,
       count(*) filter (where revenue > 50000) as high_value_customers from cust360""",
)
def executive_summary(t):
    return ins.executive_summary(t("cust360"))


@query(
    "quality_score", ["cust360"],
    """select count(*) as "rows", round(100 - 20 * (count(*) filter (where name = '') + count(*) filter (where email = '') + count(*) filter (where phone = '') + count(*) filter (where company = '')) / count(*) + 6, 6) as quality_score from cust360""".replace("+ 6,", "+ 0,"),
)
def quality_score(t):
    return ins.data_quality_score(t("cust360")).withColumn("quality_score", F.round("quality_score", 6))


@query(
    "concentration_risk", ["cust360"],
    """select n as customers, k as top_customers, round(p, 6) as concentration_pct, p > 60 as is_risk, case when p > 80 then 'high' when p > 60 then 'medium' end as severity from
       (select max(n) as n, max(k) as k, sum(v) filter (where rn <= k) / sum(v) * 100 as p from
         (select coalesce(revenue, 0) as v, row_number() over (order by coalesce(revenue, 0) desc) as rn, count(*) over () as n, greatest(1, count(*) over () // 5) as k from cust360))""",
)
def concentration_risk(t):
    return ins.concentration_risk(t("cust360")).withColumn("concentration_pct", F.round("concentration_pct", 6))


@query(
    "share_risk", ["cust360"],
    """select risk, round(p, 6) as share_pct, case when p > lim then 'high' else 'medium' end as severity from (
         select 'customer_satisfaction' as risk, 20 as lim, count(*) filter (where sentiment in ('angry','frustrated','concerned')) / count(*) * 100 as p from cust360 union all
         select 'payment_processing', 10, count(*) filter (where payment_status = 'failed') / count(*) * 100 from cust360) where p > 0""",
)
def share_risk(t):
    return ins.share_risks(t("cust360")).withColumn("share_pct", F.round("share_pct", 6))


@query(
    "segment_mode", ["cust360"],
    """select 'market_expansion' as type, segment, n as customers from (select case when lower(company) like '%corp%' then 'Corp' when lower(company) like '%inc%' then 'Inc' when lower(company) like '%llc%' then 'LLC' else 'Other' end as segment,
         count(*) as n from cust360 where revenue > 50000 group by 1 order by n desc, segment limit 1)
       union all select 'product_expansion', null, count(*) from cust360 where regexp_matches(lower(revenue_impact), 'interested|upgrade|expand')
       union all select 'operational_efficiency', null, count(*) from cust360 where support_issues > 2""",
)
def segment_mode(t):
    return ins.opportunities(t("cust360"))


ACTIONS_SQL = """
select * from (
  select 'Recover Failed Payments' as title, 1 as priority, coalesce(sum(revenue), 0) as impact_score, count(*) as affected_customers from cust360 where payment_status = 'failed' union all
  select 'Re-engage High-Value Inactive Customers', 1, coalesce(sum(revenue), 0), count(*) from cust360 where status = 'inactive' and revenue > 25000 union all
  select 'Re-establish Contact with Dormant Customers', 2, count(*) * 1000.0::double, count(*) from cust360 where last_contact like '%2023%' union all
  select 'Emergency Customer Recovery', 1, count(*) * 5000.0::double, count(*) from cust360 where sentiment = 'angry' union all
  select 'Proactive Support for Concerned Customers', 2, count(*) * 2000.0::double, count(*) from cust360 where sentiment = 'concerned' union all
  select 'Execute Upsell Campaign', 2, sum(case when revenue_impact like '%$50k%' then 50000.0::double else 12500.0::double end), count(*) from cust360 where lower(revenue_impact) like '%upsell%')
where affected_customers > 0"""


@query("action_candidates", ["cust360"], "select * from acts", {"acts": ACTIONS_SQL})
def action_candidates(t):
    return ins.action_candidates(t("cust360")).select("title", "priority", "impact_score", "affected_customers")


@query("top_actions", ["cust360"], "select * from acts order by priority, impact_score desc, title limit 3", {"acts": ACTIONS_SQL})
def top_actions(t):
    return ins.top_actions(ins.action_candidates(t("cust360")), 3).select("title", "priority", "impact_score", "affected_customers")


@query(
    "conflict_insights", ["cust360"],
    """select count(*) filter (where sentiment = 'angry') as angry, count(*) filter (where lower(revenue_impact) like '%upsell%') as upsell,
       count(*) filter (where payment_status = 'failed') as failed_payments, count(*) filter (where status = 'inactive') as inactive,
       coalesce(sum(revenue) filter (where status = 'inactive'), 0) as revenue_at_risk from cust360""",
)
def conflict_insights(t):
    return res.conflict_insights(t("cust360"))


@query(
    "guard_check", ["cust360"],
    """select 'quality_score' as metric, round(100 - 20 * (count(*) filter (where name = '') + count(*) filter (where email = '') + count(*) filter (where phone = '') + count(*) filter (where company = '')) / count(*), 6) as value,
       90.0::double as threshold, 100 - 20 * (count(*) filter (where name = '') + count(*) filter (where email = '') + count(*) filter (where phone = '') + count(*) filter (where company = '')) / count(*) >= 90 as ok from cust360""",
)
def guard_check(t):
    return shp.guard(ins.data_quality_score(t("cust360")), "quality_score", ">=", 90.0).withColumn("value", F.round("value", 6))
