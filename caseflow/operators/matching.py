"""Match claims to fact rows: dated key, key alone, then shared attributes; best one per claim.

Claims: ``claim_id, flight_number, flight_date, origin, destination`` (dates as ``yyyy-MM-dd`` text).
Facts: ``fact_id`` (a long in row order), ``entity_key, flight_date`` (date), ``origin, dest`` and the flag columns.

No tier ever pairs all rows that share a key. The facts are reduced once to the place of each entity and date, with the
fact that counts there, and from those to the first fact per key and per group of attributes. A tier asks a fixed number of
questions a claim, by one equi-join, and only for claims that are still open. Scores are integer hundredths.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.session import cut_lineage, held

FACT_COLUMNS = [
    "carrier", "fl_num", "date_str", "origin", "dest", "is_cancelled", "significant_delay", "refund_eligible",
    "arr_delay_minutes", "dep_delay_minutes",
]
TIERS = ("keyed_date", "key_only", "partial")


def _key(kind: str, *parts: Column) -> Column:
    return F.concat_ws("\x1f", F.lit(kind), *parts)


def fact_places(facts: DataFrame) -> DataFrame:
    """(entity_key, date_str, pos, fact): the last row of an entity on a date counts, at the place of the first one.

    Of rows that share the last id the least fact is taken, so that repeated rows multiply nothing. A row without id has
    no place: ``pos`` and ``fact`` are null where no other row is there.
    """
    back = F.when(F.col("fact_id").isNotNull(), F.struct((-F.col("fact_id")).alias("back"), F.struct(*FACT_COLUMNS).alias("fact")))
    last = F.min(back)
    return facts.groupBy("entity_key", "date_str").agg(F.min("fact_id").alias("pos"), last.alias("last")).select(
        "entity_key", "date_str", "pos", F.col("last.fact").alias("fact")
    )


def _first(places: DataFrame, *keys: str | Column) -> DataFrame:
    """Keys with ``f``, the first place under them."""
    return places.groupBy(*keys).agg(F.min(F.when(F.col("pos").isNotNull(), F.struct("pos", "fact"))).alias("f"))


def key_lookup(places: DataFrame) -> DataFrame:
    """(lookup, pos, fact): the first fact of every entity."""
    return _first(places.filter("entity_key IS NOT NULL"), F.col("entity_key").alias("lookup")).select("lookup", "f.*")


def route_lookup(places: DataFrame) -> DataFrame:
    """(lookup, pos, fact): the first fact under every shared attribute, all kinds from one row a route and date."""
    o, d, day = F.col("origin"), F.col("dest"), F.col("date_str")
    routes = _first(places.filter("fact.origin IS NOT NULL OR fact.dest IS NOT NULL"), F.col("fact.origin").alias("origin"), F.col("fact.dest").alias("dest"), "date_str")
    both = o.isNotNull() & d.isNotNull()
    keys = [
        F.when(both, _key("od", o, d)),
        F.when(both, _key("odt", o, d, day)),
        F.when(o.isNotNull(), _key("ot", o, day)),
        F.when(d.isNotNull(), _key("dt", d, day)),
    ]
    exploded = routes.select(F.explode(F.array_compact(F.array(*keys))).alias("lookup"), "f.*")
    return _first(exploded, "lookup").select("lookup", "f.*")


def _asked(claims: DataFrame) -> DataFrame:
    """(claim_id, key, day, o, d) of the claims that can be matched at all; blanks are null."""
    key = F.regexp_extract(F.upper("flight_number"), "^[A-Z]{1,3}[0-9]+", 0)
    return claims.filter(sufficient()).select(
        "claim_id", F.when(key != "", key).alias("key"), F.try_to_date("flight_date", "yyyy-MM-dd").alias("day"),
        F.when(F.col("origin") != "", F.col("origin")).alias("o"), F.when(F.col("destination") != "", F.col("destination")).alias("d"),
    )


def _order(tier: Column, score: Column, tie: Column, reason: Column) -> Column:
    """The better of two hits of a claim is the smaller one."""
    return F.struct(
        tier.alias("tier"), (-score).alias("score"), tie.alias("tie"), F.col("pos"), reason.alias("reason"), F.col("fact")
    ).alias("hit")


def _dated_hits(asked: DataFrame, places: DataFrame, tolerance: int) -> DataFrame:
    """(claim_id, hit): places of the claim's entity on its date and the days around it."""
    reach = [k for k in range(-tolerance, tolerance + 1) if k == 0 or 90 - 10 * abs(k) >= 40]
    probes = asked.filter("key IS NOT NULL AND day IS NOT NULL").select("claim_id", "key", "day", F.explode(F.array(*map(F.lit, reach))).alias("gap"))
    probes = probes.select("claim_id", "key", F.date_format(F.date_add("day", F.col("gap")), "yyyy-MM-dd").alias("on"), "gap")
    hits = probes.join(places, (F.col("key") == F.col("entity_key")) & (F.col("on") == F.col("date_str")))
    gap = F.col("gap")
    exact, away = gap == 0, F.abs(gap)
    reason = F.when(exact, "exact_key_date").otherwise(F.concat(F.lit("key_date_within_"), away.cast("string"), F.lit("d")))
    return hits.select("claim_id", _order(F.when(exact, 1).otherwise(2), F.when(exact, 100).otherwise(90 - 10 * away), gap, reason))


def _key_hits(asked: DataFrame, lookup: DataFrame) -> DataFrame:
    """(claim_id, hit): the first place of the claim's entity."""
    hits = asked.filter("key IS NOT NULL").select("claim_id", "key").join(lookup, F.col("key") == F.col("lookup"))
    return hits.select("claim_id", _order(F.lit(3), F.lit(60), F.lit(0), F.lit("key_only")))


def _route_hits(asked: DataFrame, lookup: DataFrame, tolerance: int) -> DataFrame:
    """(claim_id, hit): the first place under each group of attributes that the claim names."""
    o, d, day = F.col("o"), F.col("d"), F.col("day")
    both = o.isNotNull() & d.isNotNull()

    def probe(when: Column, score: int, key: Column, reason: str) -> Column:
        return F.when(when, F.struct(F.lit(score).alias("score"), key.alias("lookup"), F.lit(reason).alias("reason")))

    probes = [probe(both, 60, _key("od", o, d), "partial_origin+destination")]
    for offset in range(-tolerance, tolerance + 1):
        text = F.date_format(F.date_add(day, offset), "yyyy-MM-dd")
        gap = abs(offset)
        label = "date" if gap == 0 else f"date_within_{gap}d"
        bonus = 20 if gap == 0 else max(10, 20 - 5 * gap)
        probes += [
            probe(both & day.isNotNull(), 60 + bonus, _key("odt", o, d, text), f"partial_origin+destination+{label}"),
            probe(o.isNotNull() & day.isNotNull(), 30 + bonus, _key("ot", o, text), f"partial_origin+{label}"),
            probe(d.isNotNull() & day.isNotNull(), 30 + bonus, _key("dt", d, text), f"partial_destination+{label}"),
        ]
    kept = F.filter(F.array_compact(F.array(*probes)), lambda p: p["score"] >= 40)
    hits = asked.select("claim_id", F.explode(kept).alias("p")).select("claim_id", "p.*").join(lookup, "lookup")
    return hits.select("claim_id", _order(F.lit(4), F.col("score"), F.lit(0), F.col("reason")))


def sufficient() -> Column:
    """A claim needs a key or an origin to be matched at all."""
    return (F.coalesce(F.col("flight_number"), F.lit("")) != "") | (F.coalesce(F.col("origin"), F.lit("")) != "")


def prepared(facts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The places and both lookups as written tables, for many batches of claims against the same facts."""
    places = cut_lineage(fact_places(facts).filter("pos IS NOT NULL"))
    return places, cut_lineage(key_lookup(places)), cut_lineage(route_lookup(places))


def match_claims(
    claims: DataFrame, facts: DataFrame | tuple[DataFrame, DataFrame, DataFrame], tolerance: int = 1, tiers: tuple[str, ...] = TIERS
) -> DataFrame:
    """Best match per matched claim: (claim_id, tier, score_pct, reason, fact). ``facts`` may be ``prepared``.

    A later tier is asked only by the claims that the earlier ones found nothing for; inside a tier the higher score wins,
    then the earlier date offset (dated key) or the earlier fact. ``claims`` are read once a tier, facts once.
    """
    if isinstance(facts, tuple):
        places, by_key, by_route = facts
    else:
        places = fact_places(facts)
        places = places.filter("pos IS NOT NULL") if "partial" in tiers else places
        places = held(places) if len(tiers) > 1 else places  # each tier reads them
        by_key, by_route = key_lookup(places), route_lookup(places)
    ways = {
        "keyed_date": lambda asked: _dated_hits(asked, places, tolerance),
        "key_only": lambda asked: _key_hits(asked, by_key),
        "partial": lambda asked: _route_hits(asked, by_route, tolerance),
    }
    open_, found = _asked(claims), None
    for tier in [t for t in TIERS if t in tiers]:
        best = ways[tier](open_).groupBy("claim_id").agg(F.min("hit").alias("m"))
        found = best if found is None else found.unionByName(best)
        # the hit itself is asked for, not only its id, so that both uses of ``best`` share one exchange
        open_ = open_.join(best, "claim_id", "left").filter("m IS NULL").drop("m")
    # a claim whose best place has no id stays unmatched
    return found.filter("m.pos IS NOT NULL").select(
        "claim_id", F.col("m.tier").alias("tier"), (-F.col("m.score")).alias("score_pct"), F.col("m.reason").alias("match_reason"), F.col("m.fact").alias("fact")
    )


def match_tolerance(claims: DataFrame, facts: DataFrame, tolerance: int = 1) -> DataFrame:
    return match_claims(claims, facts, tolerance, ("keyed_date",))


def match_key_only(claims: DataFrame, facts: DataFrame, tolerance: int = 1) -> DataFrame:
    """Claims that only the undated key can place."""
    return match_claims(claims, facts, tolerance, ("keyed_date", "key_only")).filter("tier = 3")


def match_partial(claims: DataFrame, facts: DataFrame, tolerance: int = 1) -> DataFrame:
    """Claims placed by shared attributes after both key tiers found nothing."""
    return match_claims(claims, facts, tolerance).filter("tier = 4")


def match_cascade(claims: DataFrame, facts: DataFrame | tuple[DataFrame, DataFrame, DataFrame], tolerance: int = 1, threshold_pct: int = 70) -> DataFrame:
    """Every claim with its status, pre-bonus and final score and the fact it matched.

    The final score adds 10 when the claim names what happened to the fact, 5 when the fact had any issue.
    """
    best = match_claims(claims, facts, tolerance)
    joined = claims.join(best, "claim_id", "left")
    incident = F.lower(F.coalesce(F.col("incident_type"), F.lit("")))
    cancelled = F.coalesce(F.col("fact.is_cancelled"), F.lit(False))
    delayed = F.coalesce(F.col("fact.significant_delay"), F.lit(False))
    bonus = (
        F.when(incident.contains("cancel") & cancelled, 10)
        .when(incident.contains("delay") & delayed, 10)
        .when(cancelled | delayed, 5)
        .otherwise(0)
    )
    final = F.least(F.lit(100), F.col("score_pct") + bonus)
    status = (
        F.when(~sufficient(), "insufficient_data")
        .when(F.col("score_pct").isNull(), "no_matches")
        .when(final >= threshold_pct, "matched")
        .otherwise("low_confidence")
    )
    return joined.withColumns({"final_pct": final, "match_status": status}).withColumn(
        "suggested",
        F.when(
            F.col("match_status") == "low_confidence",
            F.concat(F.col("fact.carrier"), F.col("fact.fl_num"), F.lit(" on "), F.col("fact.date_str")),
        ),
    )


def matched_cases(cascade: DataFrame) -> DataFrame:
    """Matched claims with the fact columns flattened under ``bts_`` names."""
    return flattened(cascade.filter("match_status = 'matched'"))


def flattened(cascade: DataFrame) -> DataFrame:
    """All claims with the fact columns under ``bts_`` names, whatever their status."""
    names = {
        "carrier": "bts_carrier", "fl_num": "bts_flight_num", "date_str": "bts_date", "origin": "bts_origin",
        "dest": "bts_destination", "is_cancelled": "bts_cancelled", "significant_delay": "bts_significant_delay",
        "refund_eligible": "bts_refund_eligible", "arr_delay_minutes": "bts_arr_delay_minutes",
        "dep_delay_minutes": "bts_dep_delay_minutes",
    }
    return cascade.select(
        *[c for c in cascade.columns if c not in ("fact", "suggested")], *[F.col(f"fact.{k}").alias(v) for k, v in names.items()]
    )


def unmatched_cases(cascade: DataFrame) -> DataFrame:
    return cascade.filter("match_status <> 'matched'").drop("fact", "tier")


def match_stats(cascade: DataFrame) -> DataFrame:
    """Counts by outcome and the five-bin histogram of the score before the bonus."""
    s = F.when(F.col("match_status") != "insufficient_data", F.coalesce(F.col("score_pct"), F.lit(0)))
    matched = F.col("match_status") == "matched"
    return cascade.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(matched).alias("successful_matches"),
        F.count_if(matched & (F.col("final_pct") >= 80)).alias("high_confidence_matches"),
        F.count_if(matched & (F.col("final_pct") < 80)).alias("low_confidence_matches"),
        F.count_if(~matched).alias("no_matches"),
        F.count_if(s >= 90).alias("bin_90"),
        F.count_if((s >= 80) & (s < 90)).alias("bin_80"),
        F.count_if((s >= 70) & (s < 80)).alias("bin_70"),
        F.count_if((s >= 60) & (s < 70)).alias("bin_60"),
        F.count_if(s < 60).alias("bin_low"),
        F.coalesce(F.avg(matched.cast("double")), F.lit(0.0)).alias("match_rate"),
    )


def group_performance(facts: DataFrame, key: str = "carrier") -> DataFrame:
    """Totals, cancellation, delay and eligibility rates and the date span per group, and overall (key null)."""
    return facts.rollup(key).agg(
        F.count(F.lit(1)).alias("total"),
        F.avg(F.col("is_cancelled").cast("double")).alias("cancellation_rate"),
        F.avg(F.col("significant_delay").cast("double")).alias("significant_delay_rate"),
        F.avg(F.col("refund_eligible").cast("double")).alias("refund_eligible_rate"),
        F.min("flight_date").alias("first_date"),
        F.max("flight_date").alias("last_date"),
    )
