"""Executive figures, risks, opportunities and ranked actions over a customer table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.functions.text import company_class, money_mention
from caseflow.functions.typing import is_blank
from caseflow.operators.positions import top_share

# Thresholds of the rules.
HIGH_VALUE, INACTIVE_VALUE = 50000, 25000
NEGATIVE_SENTIMENTS = ["angry", "frustrated", "concerned"]
CRITICAL_COLUMNS = ["name", "email", "phone", "company"]
DORMANT_VALUE, ANGRY_VALUE, CONCERNED_VALUE = 1000, 5000, 2000
EFFORT = {
    "Recover Failed Payments": ("revenue_recovery", 1, "immediate", "medium"),
    "Re-engage High-Value Inactive Customers": ("retention", 1, "1-2 weeks", "high"),
    "Re-establish Contact with Dormant Customers": ("retention", 2, "2-4 weeks", "medium"),
    "Emergency Customer Recovery": ("satisfaction", 1, "24-48 hours", "high"),
    "Proactive Support for Concerned Customers": ("satisfaction", 2, "1 week", "medium"),
    "Execute Upsell Campaign": ("growth", 2, "2-4 weeks", "medium"),
}


def _num(c: str) -> Column:
    return F.coalesce(F.col(c).cast("string").try_cast("double"), F.lit(0.0))


def executive_summary(df: DataFrame) -> DataFrame:
    n = F.count(F.lit(1))
    active = F.count_if(F.col("status") == "active")
    revenue = F.sum(_num("revenue"))
    return df.agg(
        n.alias("total_customers"),
        F.coalesce(revenue, F.lit(0.0)).alias("total_revenue"),
        active.alias("active_customers"),
        F.count_if(F.col("sentiment") == "angry").alias("satisfaction_risk"),
        F.coalesce(F.sum(_num("support_issues")), F.lit(0.0)).cast("long").alias("support_burden"),
        F.when(n > 0, F.round(active / n * 100, 1)).otherwise(0.0).alias("retention_rate"),
        F.when(n > 0, F.round(revenue / n, 2)).otherwise(0.0).alias("average_per_customer"),
        F.count_if(_num("revenue") > HIGH_VALUE).alias("high_value_customers"),
    )


def data_quality_score(df: DataFrame, conflicts_resolved: int = 0, columns: list[str] = CRITICAL_COLUMNS) -> DataFrame:
    """100 less 20 per missing share of each critical column, plus up to 10 for resolved conflicts, within 0..100."""
    present = [c for c in columns if c in df.columns]
    n = F.count(F.lit(1))
    penalty = reduce(lambda a, b: a + b, [F.count_if(is_blank(F.col(c))) / n * 20 for c in present], F.lit(0.0))
    score = 100.0 - penalty + min(conflicts_resolved * 2, 10)
    return df.agg(
        n.alias("rows"),
        F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(100.0), score))).otherwise(0.0).alias("quality_score"),
    )


def concentration_risk(df: DataFrame, revenue: str = "revenue") -> DataFrame:
    """Revenue share of the top fifth of the customers; a risk above 60 %, high above 80 %."""
    values = df.select(_num(revenue).alias("revenue"))
    top = top_share(values, "revenue")
    pct = F.when(F.col("total") > 0, F.col("top_sum") / F.col("total") * 100)
    return top.select(
        F.col("n").alias("customers"),
        F.col("k").alias("top_customers"),
        pct.alias("concentration_pct"),
        F.coalesce(pct > 60, F.lit(False)).alias("is_risk"),
        F.when(pct > 80, "high").when(pct > 60, "medium").alias("severity"),
    )


def share_risks(df: DataFrame) -> DataFrame:
    """Negative sentiment (high above 20 %) and failed payments (high above 10 %); a zero share is no risk."""
    n = F.count(F.lit(1))
    one = df.agg(
        (F.count_if(F.col("sentiment").isin(NEGATIVE_SENTIMENTS)) / n * 100).alias("sentiment"),
        (F.count_if(F.col("payment_status") == "failed") / n * 100).alias("payment"),
    )

    def risk(name: str, share: str, limit: int) -> Column:
        return F.struct(
            F.lit(name).alias("risk"), F.col(share).alias("share_pct"), F.when(F.col(share) > limit, "high").otherwise("medium").alias("severity")
        )

    rows = F.array(risk("customer_satisfaction", "sentiment", 20), risk("payment_processing", "payment", 10))
    return one.select(F.explode(rows).alias("r")).select("r.*").filter("share_pct > 0")


def opportunities(df: DataFrame) -> DataFrame:
    """Leading company class among high-value customers, customers asking for more, support-heavy customers."""
    valued = df.filter(_num("revenue") > HIGH_VALUE)
    classes = valued.groupBy(company_class(F.coalesce(F.col("company"), F.lit(""))).alias("segment")).agg(F.count(F.lit(1)).alias("customers"))
    segment = classes.orderBy(F.col("customers").desc(), "segment").limit(1).select(
        F.lit("market_expansion").alias("type"), "segment", "customers"
    )
    counts = df.agg(
        F.count_if(F.coalesce(F.col("revenue_impact").rlike("(?i)interested|upgrade|expand"), F.lit(False))).alias("wants"),
        F.count_if(_num("support_issues") > 2).alias("heavy"),
    )
    rows = F.array(
        F.struct(F.lit("product_expansion").alias("type"), F.lit(None).cast("string").alias("segment"), F.col("wants").alias("customers")),
        F.struct(F.lit("operational_efficiency").alias("type"), F.lit(None).cast("string").alias("segment"), F.col("heavy").alias("customers")),
    )
    return segment.unionByName(counts.select(F.explode(rows).alias("r")).select("r.*").filter("customers > 0"))


def action_candidates(df: DataFrame, dormant_year: int = 2023) -> DataFrame:
    """Six rules in one pass: affected customers and impact of each rule that hits anybody."""
    revenue = _num("revenue")
    failed = F.col("payment_status") == "failed"
    idle = (F.col("status") == "inactive") & (revenue > INACTIVE_VALUE)
    old = F.coalesce(F.col("last_contact").cast("string").contains(str(dormant_year)), F.lit(False))
    upsell = F.coalesce(F.col("revenue_impact").rlike("(?i)upsell"), F.lit(False))
    zero = F.lit(0.0)
    rules = {
        "Recover Failed Payments": (failed, revenue),
        "Re-engage High-Value Inactive Customers": (idle, revenue),
        "Re-establish Contact with Dormant Customers": (old, F.lit(float(DORMANT_VALUE))),
        "Emergency Customer Recovery": (F.col("sentiment") == "angry", F.lit(float(ANGRY_VALUE))),
        "Proactive Support for Concerned Customers": (F.col("sentiment") == "concerned", F.lit(float(CONCERNED_VALUE))),
        "Execute Upsell Campaign": (upsell, F.coalesce(money_mention(F.col("revenue_impact")), zero)),
    }
    aggs = []
    for i, (hit, worth) in enumerate(rules.values()):
        aggs += [F.count_if(hit).alias(f"n{i}"), F.coalesce(F.sum(F.when(hit, worth)), zero).alias(f"v{i}")]
    rows = [
        F.struct(
            F.lit(EFFORT[title][0]).alias("category"), F.lit(title).alias("title"), F.lit(EFFORT[title][1]).alias("priority"),
            F.col(f"v{i}").alias("impact_score"), F.col(f"n{i}").alias("affected_customers"), F.lit(EFFORT[title][2]).alias("timeline"),
            F.lit(EFFORT[title][3]).alias("effort"),
        )
        for i, title in enumerate(rules)
    ]
    return df.agg(*aggs).select(F.explode(F.array(*rows)).alias("r")).select("r.*").filter("affected_customers > 0")


def top_actions(actions: DataFrame, k: int = 10) -> DataFrame:
    return actions.orderBy("priority", F.col("impact_score").desc(), "title").limit(k)
