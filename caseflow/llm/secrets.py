"""Secret scans with corpus-wide ownership frequency, in DataFrame functions alone.

Patterns find base spans (assignments, access keys, long hex strings), which always stay, and other long tokens with
letters and digits. Every candidate value is hashed; per hash the distinct repositories and owners that hold it are
counted. A value that many owners or very many repositories hold is a copied example; one that few hold and that looks
like a credential is live. Tokens beside the base spans are reported if live, and every document gets counts of both.

Positions need no search of their own: between the matches of a pattern lie the pieces that splitting by it gives, and
a running sum over both says where each match stops. Nothing is compared with all other matches of a document.

Texts are read once; the written table of candidates holds no text. Counts come from three aggregates that combine in
the map tasks, so a value that a third of all documents hold is a few rows per task. The verdicts are a written table,
and both sides of its join are plain exchanges, which adaptive execution splits where a value is frequent.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseflow.llm.shared import staged, table

#: From so many owners on, a value is a copied example.
EXAMPLE_OWNERS = 3
BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
#: As the longest runs with at least 16 and 32 characters, since no shorter run can hold a match.
ACCESS = r"(AKIA[A-Z0-9]{12,})"
HEX = r"([0-9a-f]{32,})"
TOKEN = r"([A-Za-z0-9+/_=-]{20,})"

#: A value that at least so many repositories hold is a copied example, whoever owns them.
EXAMPLE_REPOS = 20
#: A live-looking value has so many characters, and a tenth of them are digits and a tenth letters.
LIVE_LEAST = 12

HIT = "array<struct<kind:int,at:int,gap:int,width:int,value:string>>"


def hits(text: Column, pattern: str, kind: int, gate: Column) -> Column:
    """Matches of a pattern with one group, each with the length of the gap before it; only looked for behind ``gate``."""
    whole, group = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), whole.alias("whole"), group.alias("group"))
    found = F.transform(
        F.filter(zipped, lambda h: h["whole"].isNotNull()),
        lambda h, i: F.struct(F.lit(kind).alias("kind"), i.alias("at"), F.length(h["gap"]).alias("gap"), F.length(h["whole"]).alias("width"), h["group"].alias("value")),
    )
    return F.when(gate, found).otherwise(F.expr(f"cast(array() as {HIT})"))


def candidates(docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source") -> DataFrame:
    """``(row, doc_id, owner, repo, hits)``: the matches of all kinds in every row of ``docs``, without their positions."""
    text = F.coalesce("text", F.lit(""))
    long = text.rlike(r"[A-Za-z0-9+/_=-]{20}")
    found = F.concat(
        hits(text, ASSIGN, 0, F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))), hits(text, ACCESS, 1, F.contains(text, F.lit("AKIA"))),
        hits(text, HEX, 2, long), hits(text, TOKEN, 3, long),
    )
    return docs.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce(F.col(owner_col).cast("string"), F.lit("")).alias("owner"),
        F.coalesce(F.col(repo_col).cast("string"), F.lit("")).alias("repo"), found.alias("hits"),
    )


def placed(found: DataFrame) -> DataFrame:
    """``(row, owner, repo, kind, start, stop, value)``: base spans, and tokens that touch none of them.

    A match stops where the gaps and matches of its kind up to it end, a running sum. A token touches a base span that
    starts at or before it and stops behind its start, or one that starts behind it and before its end; both are looked
    up from running extremes, so the work is in proportion to the matches of a document.
    """
    each = found.filter(F.size("hits") > 0).select("row", "owner", "repo", F.explode("hits").alias("h")).select("row", "owner", "repo", "h.*")
    in_kind = Window.partitionBy("row", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(F.col("gap") + F.col("width")).over(in_kind).cast("int")
    each = each.withColumn("stop", stop).withColumn("start", F.col("stop") - F.col("width"))
    least = F.element_at(F.array(*[F.lit(n) for n in (ASSIGN_LEAST, 16, 32, 20)]), F.col("kind") + 1)
    value, base = F.col("value"), F.col("kind") < 3
    each = each.filter((F.length(value) >= least) & (base | (value.rlike("[0-9]") & value.rlike("[A-Za-z]"))))
    up = Window.partitionBy("row").orderBy("start").rangeBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy("row").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, -1)
    each = each.withColumns({"reached": F.max(F.when(base, F.col("stop"))).over(up), "next": F.min(F.when(base, F.col("start"))).over(down)})
    touches = (F.coalesce("reached", F.lit(0)) > F.col("start")) | (F.coalesce("next", F.col("stop")) < F.col("stop"))
    return each.filter(base | ~touches).select("row", "owner", "repo", "kind", "start", "stop", "value")


def looks_live(value: Column) -> Column:
    """Long enough, with digits and letters in some number."""
    share = lambda other: F.length(F.regexp_replace(value, other, "")) * 10 >= F.length(value)
    return (F.length(value) >= LIVE_LEAST) & share("[^0-9]") & share("[^A-Za-z]")


def ownership(values: DataFrame) -> DataFrame:
    """``(hash, repos, owners, looks)``: in how many repositories and with how many owners each candidate hash occurs, and how it looks."""
    held = values.groupBy("hash", "owner", "repo").agg(F.max("looks").alias("looks"))
    by_owner = held.groupBy("hash", "owner").agg(F.count("*").alias("repos"), F.max("looks").alias("looks"))
    return by_owner.groupBy("hash").agg(F.sum("repos").alias("repos"), F.count("*").alias("owners"), F.max("looks").alias("looks"))


def scan(
    docs: DataFrame, repo_col: str = "doc_id", owner_col: str = "source", example_owners: int = EXAMPLE_OWNERS, example_repos: int = EXAMPLE_REPOS
) -> DataFrame:
    """``(doc_id, base, tokens, n_live, n_example)`` for every row of ``docs``.

    ``base`` are the spans of the fixed patterns, ``tokens`` the other candidates that are live: values that look live
    and that fewer than ``example_owners`` owners and ``example_repos`` repositories hold. ``n_live`` and ``n_example``
    count all candidates by class. A null text has no spans; a null owner or repository counts as one of its own; rows
    that repeat a document add no repository.
    """
    found = staged(candidates(docs, repo_col, owner_col), "secrets")
    each = placed(found).withColumn("looks", looks_live(F.col("value")))
    each = staged(each.select("row", "owner", "repo", "kind", "start", "stop", "looks", F.sha2("value", 256).alias("hash")), "values")
    live = F.col("looks") & (F.col("owners") < example_owners) & (F.col("repos") < example_repos)
    verdict = staged(ownership(each).select("hash", live.alias("live")), "ownership")
    span = F.struct("start", "kind", "stop")
    judged = each.join(verdict, "hash").groupBy("row").agg(
        F.array_sort(F.collect_list(F.when(F.col("kind") < 3, span))).alias("base"),
        F.array_sort(F.collect_list(F.when((F.col("kind") == 3) & F.col("live"), span))).alias("tokens"),
        F.count_if("live").alias("n_live"), F.count_if(~F.col("live")).alias("n_example"),
    )
    none = F.expr("cast(array() as array<struct<start:int,kind:int,stop:int>>)")
    zero = F.lit(0).cast("long")
    some = found.filter(F.size("hits") > 0).select("row", "doc_id").join(judged, "row", "left").select(
        "doc_id", F.coalesce("base", none).alias("base"), F.coalesce("tokens", none).alias("tokens"), F.coalesce("n_live", zero).alias("n_live"), F.coalesce("n_example", zero).alias("n_example")
    )
    rest = found.filter(F.size("hits") == 0).select("doc_id", none.alias("base"), none.alias("tokens"), zero.alias("n_live"), zero.alias("n_example"))
    return some.unionByName(rest)


def joined(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined, in order of start, then kind."""
    name = lambda k: F.element_at(F.array(*[F.lit(n) for n in (*BASE_KINDS, "token")]), k + 1)
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", name(s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = scan(table(spark, folder, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as bigint)").alias(f"n_{n}") for k, n in enumerate(BASE_KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "tokens")).alias("spans"), "n_live", "n_example")


_KINDS = ((0, "assign", ASSIGN, 8), (1, "access", ACCESS, 16), (2, "hex", HEX, 32), (3, "token", TOKEN, 20))


def _quoted(pattern: str) -> str:
    return pattern.replace("'", "''")


SQL = (
    "with "
    + ",\n".join(
        f"""raw{k} as (
  select doc_id, source, unnest(regexp_extract_all(coalesce(text, ''), '{_quoted(p)}', 0)) m, unnest(regexp_extract_all(coalesce(text, ''), '{_quoted(p)}', 1)) v,
    unnest((regexp_split_to_array(coalesce(text, ''), '{_quoted(p)}'))[:-2]) gap, unnest(range(len(regexp_extract_all(coalesce(text, ''), '{_quoted(p)}', 0)))) i from documents
), placed{k} as (
  select doc_id, source, {k} kind, '{n}' name, v, len(v) size, cast(sum(len(gap) + len(m)) over (partition by doc_id order by i) as bigint) stop, len(m) width from raw{k}
)"""
        for k, n, p, _ in _KINDS
    )
    + """, spans as (
"""
    + " union all ".join(f"select doc_id, source, kind, name, v, stop - width as start, stop from placed{k} where size >= {least}" for k, _, _, least in _KINDS)
    + f"""
), used as (
  select * from spans s where kind < 3 or (regexp_matches(v, '[0-9]') and regexp_matches(v, '[A-Za-z]')
    and not exists (select 1 from spans b where b.kind < 3 and b.doc_id = s.doc_id and b.start < s.stop and s.start < b.stop))
), live as (
  select v, count(distinct coalesce(source, '')) < {EXAMPLE_OWNERS} and count(distinct coalesce(source, '') || chr(0) || coalesce(cast(doc_id as varchar), '')) < {EXAMPLE_REPOS}
    and len(v) >= {LIVE_LEAST} and len(regexp_replace(v, '[^0-9]', '', 'g')) * 10 >= len(v) and len(regexp_replace(v, '[^A-Za-z]', '', 'g')) * 10 >= len(v) live from used group by v
),
judged as (select * from used join live using (v)),
rows as (
  select doc_id, count(*) filter (kind = 0) n_assign, count(*) filter (kind = 1) n_access, count(*) filter (kind = 2) n_hex,
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3) base,
    string_agg(name || ':' || start || ':' || stop, ',' order by start, kind) filter (kind < 3 or live) spans,
    count(*) filter (live) n_live, count(*) filter (not live) n_example
  from judged group by doc_id
)
select doc_id, coalesce(n_assign, 0) n_assign, coalesce(n_access, 0) n_access, coalesce(n_hex, 0) n_hex, sha256(coalesce(base, '')) base_sha256,
  coalesce(spans, '') spans, coalesce(n_live, 0) n_live, coalesce(n_example, 0) n_example
from documents left join rows using (doc_id)
"""
)
