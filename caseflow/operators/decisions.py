"""Refund decisions, claims, replies and their summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import any_word
from caseflow.operators.positions import running_position
from caseflow.session import held

# Thresholds, price steps, airport groups and citation texts of the rule set.
DEFAULT_RULES = {
    "domestic_significant_delay_minutes": 180,
    "international_significant_delay_minutes": 360,
    "baggage_delay_hours": 12,
}
INTERNATIONAL_AIRPORTS = ["LHR", "CDG", "NRT", "ICN", "FRA", "AMS", "YYZ", "YVR"]
BUSY_AIRPORTS = ["JFK", "LAX", "ORD", "ATL", "DFW", "SFO", "LAS", "SEA"]
PRICE_DOMESTIC, PRICE_BUSY, PRICE_INTERNATIONAL = 350.0, 450.0, 800.0
BAG_FEE, WIFI_FEE = 75.0, 25.0
BAGGAGE_WORDS = ["lost bag", "baggage", "luggage", "suitcase", "checked bag"]
WIFI_WORDS = ["wifi", "internet"]
CITATIONS = {
    "cancelled": "14 CFR 259.5(b)(1) - Automatic refund required for cancelled flights",
    "domestic": "14 CFR 259.5(b)(2) - Domestic flights delayed {domestic_significant_delay_minutes}+ minutes",
    "international": "14 CFR 259.5(b)(2) - International flights delayed {international_significant_delay_minutes}+ minutes",
    "baggage": "14 CFR 259.8 - Baggage delayed {baggage_delay_hours}+ hours",
    "ancillary": "14 CFR 259.6 - Ancillary services not provided (WiFi, seat assignments, etc.)",
}
# Reason, evidence and action texts.
REASONS = {
    "cancelled": "Flight cancellation",
    "delayed": "Significant delay (%.1f hours)",
    "baggage": "Potential baggage delay/loss",
    "wifi": "WiFi service issues",
    "none": "No DOT refund criteria met",
}
EVIDENCE = {
    "cancelled": "BTS data confirms flight was cancelled",
    "delayed": "BTS data shows %s minute arrival delay",
    "baggage": "Tweet mentions baggage issues",
    "wifi": "Tweet mentions WiFi/internet problems",
    "none": "Flight performance within normal parameters",
}
ACTIONS = {
    "baggage": "Provide baggage claim tickets and tracking information",
    "none": "Contact airline customer service for voluntary compensation",
}


def _joined(*parts: Column) -> Column:
    found = F.array_compact(F.array(*parts))
    return F.when(F.size(found) > 0, F.array_join(found, "; "))


def decide(cases: DataFrame, text: str = "original_text", rules: dict | None = None) -> DataFrame:
    """Eligibility, amount, type, deadline, reasons, citations and evidence per matched case."""
    cfg = {**DEFAULT_RULES, **(rules or {})}
    cite = {k: F.lit(v.format(**cfg)) for k, v in CITATIONS.items()}
    o, d = F.coalesce("bts_origin", F.lit("")), F.coalesce("bts_destination", F.lit(""))
    routed = (o != "") & (d != "")
    abroad = routed & (o.isin(INTERNATIONAL_AIRPORTS) | d.isin(INTERNATIONAL_AIRPORTS))
    busy = routed & (o.isin(BUSY_AIRPORTS) | d.isin(BUSY_AIRPORTS))
    price = F.when(abroad, PRICE_INTERNATIONAL).when(busy, PRICE_BUSY).otherwise(PRICE_DOMESTIC)
    limit = F.when(abroad, cfg["international_significant_delay_minutes"]).otherwise(
        cfg["domestic_significant_delay_minutes"]
    )
    minutes = F.coalesce(F.col("bts_arr_delay_minutes"), F.lit(0.0))
    cancelled = F.coalesce(F.col("bts_cancelled"), F.lit(False))
    words = F.coalesce(F.col(text), F.lit(""))

    base = cases.withColumns(
        {
            "is_case_cancelled": cancelled,
            "is_case_delayed": ~cancelled & (minutes >= limit),
            "is_case_baggage": any_word(words, BAGGAGE_WORDS),
            "is_case_wifi": any_word(words, WIFI_WORDS),
        }
    )
    c, s = F.col("is_case_cancelled"), F.col("is_case_delayed")
    bag, wifi = F.col("is_case_baggage"), F.col("is_case_wifi")
    fee = bag & any_word(words, ["fee"])
    amount = F.least(price, F.when(fee, BAG_FEE).otherwise(price), F.when(wifi, WIFI_FEE).otherwise(price))
    cash = c | s
    eligible = cash | bag | wifi
    return base.withColumns(
        {
            "refund_eligible": eligible,
            "estimated_refund_amount": amount,
            "refund_type": F.when(cash, "cash").when(eligible, "partial"),
            "airline_deadline_days": F.when(cash, 7).when(eligible, 30),
            "confidence_level": F.when(bag & ~cash, "medium").otherwise("high"),
            "customer_action_required": F.when(bag & ~cash, ACTIONS["baggage"]).when(~eligible, ACTIONS["none"]),
            "refund_reason": F.coalesce(
                _joined(
                    F.when(c, F.lit(REASONS["cancelled"])),
                    F.when(s, F.format_string(REASONS["delayed"], minutes / 60)),
                    F.when(bag, F.lit(REASONS["baggage"])),
                    F.when(wifi, F.lit(REASONS["wifi"])),
                ),
                F.lit(REASONS["none"]),
            ),
            "dot_rule_citation": _joined(
                F.when(c, cite["cancelled"]),
                F.when(s, F.when(abroad, cite["international"]).otherwise(cite["domestic"])),
                F.when(bag, cite["baggage"]),
                F.when(wifi, cite["ancillary"]),
            ),
            "evidence_summary": F.coalesce(
                _joined(
                    F.when(c, F.lit(EVIDENCE["cancelled"])),
                    F.when(s, F.format_string(EVIDENCE["delayed"], minutes.cast("string"))),
                    F.when(bag, F.lit(EVIDENCE["baggage"])),
                    F.when(wifi, F.lit(EVIDENCE["wifi"])),
                ),
                F.lit(EVIDENCE["none"]),
            ),
        }
    )


def decision_summary(decisions: DataFrame, key: str = "bts_carrier") -> DataFrame:
    """Totals, rule counts, amount, rate and average per carrier and overall (key null)."""
    ok = F.col("refund_eligible")
    amount = F.sum(F.when(ok, F.col("estimated_refund_amount")).otherwise(0.0))
    n_ok = F.count_if(ok)
    return decisions.rollup(key).agg(
        F.count(F.lit(1)).alias("total_cases"),
        n_ok.alias("eligible_refunds"),
        F.count_if("is_case_cancelled").alias("cancelled_flights"),
        F.count_if("is_case_delayed").alias("significant_delays"),
        F.count_if("is_case_baggage").alias("baggage_issues"),
        F.count_if("is_case_wifi").alias("ancillary_issues"),
        amount.alias("total_refund_amount"),
        (n_ok / F.count(F.lit(1))).alias("eligibility_rate"),
        F.when(n_ok > 0, amount / n_ok).otherwise(0.0).alias("average_refund_amount"),
    )


def case_breakdown(decisions: DataFrame, unmatched: DataFrame, key: str = "bts_carrier") -> DataFrame:
    """Eligible cases and amount per carrier and overall, with the share of eligible among eligible and unmatched."""
    per = decisions.filter("refund_eligible").rollup(key).agg(
        F.count(F.lit(1)).alias("cases"), F.round(F.sum("estimated_refund_amount"), 2).alias("amount")
    )
    waiting = unmatched.agg(F.count(F.lit(1)).alias("manual_review"))
    both = per.crossJoin(F.broadcast(waiting))  # one row
    overall = F.col(key).isNull()
    return both.select(
        key,
        "cases",
        "amount",
        F.when(overall, F.col("manual_review")).alias("manual_review"),
        F.when(overall, F.col("cases") / (F.col("cases") + F.col("manual_review"))).alias("compliance_rate"),
    )


def case_figures(claims: DataFrame, key: str = "bts_carrier") -> DataFrame:
    """``case_breakdown`` in one pass over all claims, decided and waiting alike (``matching.flattened``).

    One aggregate by carrier counts what is eligible and, in a group without carrier, what waits for review; the overall
    row is added up from those few rows, so neither claims nor facts are read a second time.
    """
    decided = decide(claims)
    matched = F.col("match_status") == "matched"
    ok = matched & F.col("refund_eligible")
    per = decided.groupBy(ok.alias("ok"), F.when(ok, F.col(key)).alias(key)).agg(
        F.count_if(ok).alias("cases"), F.sum(F.when(ok, F.col("estimated_refund_amount"))).alias("amount"), F.count_if(~matched).alias("waiting")
    )
    waiting, overall = F.sum("waiting"), F.grouping_id() == 1
    both = per.rollup(F.struct("ok", key).alias("g")).agg(F.sum("cases").alias("cases"), F.round(F.sum("amount"), 2).alias("amount"), waiting.alias("waiting"), overall.alias("overall"))
    share = F.col("cases") / (F.col("cases") + F.col("waiting"))
    return both.filter("(overall OR g.ok) AND cases > 0").select(
        F.col(f"g.{key}").alias(key), "cases", "amount", F.when(F.col("overall"), F.col("waiting")).alias("manual_review"), F.when(F.col("overall"), share).alias("compliance_rate")
    )


CLAIM_COLUMNS = [
    "user", "bts_carrier", "bts_flight_num", "bts_date", "bts_origin", "bts_destination", "incident_type", "original_text", "bts_cancelled",
    "bts_arr_delay_minutes", "refund_reason", "dot_rule_citation", "estimated_refund_amount", "refund_type", "airline_deadline_days", "final_pct",
    "evidence_summary",
]


def build_claims(decisions: DataFrame, claim_day: str, order_by: list[str]) -> DataFrame:
    """Nested claim per eligible case, numbered in the given order from 0, with four digits or as many as it takes."""
    # written with the columns of the claim alone: dealing them by ranges reads the rows twice
    eligible = held(decisions.filter("refund_eligible").select(*dict.fromkeys(["claim_id", *CLAIM_COLUMNS, *order_by])))
    numbered = running_position(eligible, [], order_by, "claim_no")
    claim = F.struct(
        F.concat(F.lit(f"RFC-{claim_day}-"), F.format_string("%04d", F.col("claim_no") - 1)).alias("claim_id"),
        F.struct(F.coalesce("user", F.lit("Unknown")).alias("handle"), F.lit("direct_message").alias("contact_method")).alias("passenger"),
        F.struct(
            F.col("bts_carrier").alias("carrier"), F.col("bts_flight_num").alias("flight_number"), F.col("bts_date").alias("date"),
            F.col("bts_origin").alias("origin"), F.col("bts_destination").alias("destination"),
        ).alias("flight"),
        F.struct(
            F.col("incident_type").alias("type"), F.col("original_text").alias("description"),
            F.col("bts_cancelled").alias("bts_cancelled"), F.col("bts_arr_delay_minutes").alias("bts_delay_minutes"),
        ).alias("incident"),
        F.struct(
            F.lit(True).alias("eligible"), F.col("refund_reason").alias("reason"), F.col("dot_rule_citation").alias("citation"),
            F.col("estimated_refund_amount").alias("estimated_amount"), F.col("refund_type").alias("refund_type"),
            F.col("airline_deadline_days").alias("deadline_days"),
        ).alias("refund"),
        F.struct(
            F.lit(True).alias("bts_data_match"), (F.col("final_pct") / 100).alias("match_confidence"),
            F.col("evidence_summary").alias("summary"),
        ).alias("evidence"),
        F.lit("pending_review").alias("status"),
        F.when(F.col("refund_type") == "cash", "high").otherwise("medium").alias("priority"),
    )
    return numbered.select("claim_id", claim.alias("claim"))


# A full letterhead is up to the caller; these are the facts each kind of reply must carry.
REPLY_ELIGIBLE = (
    "Hello @%s, flight %s qualifies for a refund: %s. Estimated amount $%.2f (%s), due within %d days. "
    "Legal basis: %s. Evidence: %s."
)
REPLY_INSUFFICIENT = "Hello @%s, please send the flight number, the flight date and both airports so we can check your case."
REPLY_LOW = "Hello @%s, was your flight %s? Please confirm it and both cities before we continue."
REPLY_NONE = "Hello @%s, we found no flight that fits. Please check the details, or ask %s for a voluntary compensation."
DISCLAIMER = " This is based on public flight data and is not legal advice."


def reply_queue(decisions: DataFrame, unmatched: DataFrame, disclaimer: bool = True) -> DataFrame:
    """Drafts for eligible cases (high priority) and for all unmatched ones (medium, follow-up)."""
    handle = F.coalesce(F.col("user"), F.lit("Valued Customer"))
    flight = F.concat(F.col("bts_carrier"), F.col("bts_flight_num"), F.lit(" on "), F.col("bts_date"))
    body = F.format_string(
        REPLY_ELIGIBLE, handle, flight, F.col("refund_reason"), F.col("estimated_refund_amount"), F.initcap("refund_type"),
        F.col("airline_deadline_days"), F.col("dot_rule_citation"), F.col("evidence_summary"),
    )
    yes = decisions.filter("refund_eligible").select(
        "claim_id", handle.alias("recipient"), flight.alias("flight"), F.lit(True).alias("refund_eligible"),
        (F.concat(body, F.lit(DISCLAIMER)) if disclaimer else body).alias("content"), F.lit("high").alias("priority"),
        F.lit(False).alias("requires_followup"),
    )
    status = F.col("match_status")
    other = (
        F.when(status == "insufficient_data", F.format_string(REPLY_INSUFFICIENT, handle))
        .when(status == "low_confidence", F.format_string(REPLY_LOW, handle, F.coalesce("suggested", F.lit("a similar one"))))
        .otherwise(F.format_string(REPLY_NONE, handle, F.coalesce("airline", F.lit("the airline"))))
    )
    no = unmatched.select(
        "claim_id", handle.alias("recipient"), F.coalesce("flight_number", F.lit("Unknown")).alias("flight"),
        F.lit(False).alias("refund_eligible"), other.alias("content"), F.lit("medium").alias("priority"),
        F.lit(True).alias("requires_followup"),
    )
    return yes.unionByName(no)


def summary_blocks(breakdown: DataFrame, key: str = "bts_carrier") -> DataFrame:
    """Notification blocks as one JSON text, from the per-carrier breakdown (one row per carrier)."""
    total = F.max_by("cases", key_is_total(key))
    review = F.max("manual_review")
    amount = F.max_by("amount", key_is_total(key))
    lines = F.array_sort(
        F.collect_list(
            F.when(
                F.col(key).isNotNull(),
                F.format_string("• %s: %d cases, $%s", F.col(key), F.col("cases"), F.format_number("amount", 2)),
            )
        )
    )
    one = breakdown.agg(total.alias("eligible"), review.alias("review"), amount.alias("amount"), lines.alias("lines"))

    def block(kind: str, text: Column) -> Column:
        return F.struct(F.lit(kind).alias("type"), text.alias("text"))

    counts = F.format_string(
        "*Total cases:* %d\n*Eligible:* %d\n*Manual review:* %d\n*Estimated refunds:* $%s",
        F.col("eligible") + F.col("review"), F.col("eligible"), F.col("review"), F.format_number("amount", 2),
    )
    blocks = F.array(
        block("header", F.lit("Daily case report")),
        block("section", counts),
        block("section", F.concat(F.lit("*By carrier:*\n"), F.array_join("lines", "\n"))),
        F.when(F.col("review") > 0, block("section", F.format_string("*%d cases require manual review*", F.col("review")))),
    )
    return one.select(F.to_json(F.array_compact(blocks)).alias("blocks"))


def key_is_total(key: str) -> Column:
    """Orders the overall row (null key) last, for ``max_by``."""
    return F.when(F.col(key).isNull(), 1).otherwise(0)
