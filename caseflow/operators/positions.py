"""Row positions, running totals and top-share sums without sorting a whole group in one task.

Rows are dealt by ranges of (keys, order), whose borders Spark draws from a sample of the rows, so a key of any size
lies in as many ranges as its share of the rows. The dealt rows are written once, with their place in the range. What
lies before a range is one figure: only the first key of a range can have begun in an earlier one, so the totals that
are carried forward are at most one row a range.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from caseflow.session import held

#: Bits of ``monotonically_increasing_id`` that count the rows within a partition.
ROW_BITS = 33
LARGEST = 1.7976931348623157e308


def ordered_ranges(df: DataFrame, keys: list[str], order_by: list[str]) -> DataFrame:
    """``df`` in ranges of (keys, order), with ``__part`` (the range) and ``__row`` (the place in it, from 0). Rows that tie lie in one range."""
    place = F.monotonically_increasing_id()
    dealt = df.repartitionByRange(*keys, *order_by).sortWithinPartitions(*keys, *order_by).withColumn("__at", place)
    fixed = held(dealt)  # borders are drawn anew if the ranges are computed a second time
    return fixed.withColumns({"__part": F.shiftright("__at", ROW_BITS), "__row": F.col("__at").bitwiseAND(F.lit((1 << ROW_BITS) - 1))}).drop("__at")


def _joined(a: DataFrame, b: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """``a`` with the other columns of ``b``, null being equal to null."""
    b = b.select(*[F.col(c).alias(f"__of_{c}") if c in on else F.col(c) for c in b.columns])
    same = reduce(lambda x, y: x & y, [F.col(c).eqNullSafe(F.col(f"__of_{c}")) for c in on])
    return a.join(b, same, how).drop(*[f"__of_{c}" for c in on])


def _carried(sums: DataFrame, keys: list[str], value: str) -> DataFrame:
    """``sums`` (one row a range and key) with ``__before``: what the key has in earlier ranges."""
    earlier = Window.partitionBy(*keys).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # at most one row a range
    return sums.withColumn("__before", F.sum(value).over(earlier))


def running_position(df: DataFrame, keys: list[str], order_by: list[str], into: str) -> DataFrame:
    """1-based position of each row within its keys. Null is a key like any other; rows that tie get positions in any order."""
    ranges = ordered_ranges(df, keys, order_by)
    if not keys:  # the place in the range is the position in it
        ends = _carried(ranges.groupBy("__part").agg(F.count(F.lit(1)).alias("__n")), [], "__n").select("__part", "__before")
        placed = ranges.join(F.broadcast(ends), "__part")  # one row a range
        return placed.withColumn(into, F.col("__row") + 1 + F.coalesce("__before", F.lit(0))).drop("__part", "__row", "__before")
    sizes = ranges.groupBy("__part", *keys).agg(F.count(F.lit(1)).alias("__n"))
    carried = _carried(sizes, keys, "__n").filter("__before IS NOT NULL").select("__part", "__before")  # one row a range at most
    inside = F.row_number().over(Window.partitionBy("__part", *keys).orderBy("__row"))
    # the first key of a range is the one whose rows are counted as the rows of the range are
    numbered = ranges.withColumn("__in_key", inside).join(F.broadcast(carried), "__part", "left")
    before = F.when(F.col("__in_key") == F.col("__row") + 1, F.coalesce("__before", F.lit(0))).otherwise(0)
    return numbered.withColumn(into, F.col("__in_key") + before).drop("__part", "__row", "__in_key", "__before")


def first_crossing(df: DataFrame, keys: list[str], order_by: list[str], amount: str, limit: str) -> DataFrame:
    """Per key: total amount, its limit, and the first row at which the running total exceeds the limit.

    Amounts are charges (never negative), so the crossing lies in the first range whose end total is over. The columns
    named in ``order_by`` come back under ``breach``; null when the limit holds. Null is a key like any other.
    """
    ranges = ordered_ranges(df, keys, order_by)
    sums = ranges.groupBy("__part", *keys).agg(F.sum(amount).alias("__sum"), F.max(limit).alias("__limit"))
    totals = sums.groupBy(*keys).agg(F.sum("__sum").alias("total"), F.max("__limit").alias("limit"))
    ends = _carried(sums, keys, "__sum").withColumn("__before", F.coalesce("__before", F.lit(0.0)))
    over = ends.filter(F.col("__before") + F.col("__sum") > F.col("__limit"))
    crossing = over.groupBy(*keys).agg(F.min_by(F.struct("__part", "__before"), "__part").alias("c")).select(*keys, "c.__part", "c.__before")
    inside = _joined(ranges, crossing, ["__part", *keys])
    run = Window.partitionBy("__part", *keys).orderBy("__row").rowsBetween(Window.unboundedPreceding, 0)
    hit = inside.withColumn("__run", F.sum(amount).over(run) + F.col("__before")).filter(F.col("__run") > F.col(limit))
    hit = hit.groupBy(*keys).agg(F.min(F.struct(*order_by)).alias("breach"), F.min("__run").alias("usage_at_breach"))
    return _joined(totals, hit, keys, "left")


def top_share(df: DataFrame, value: str, share: int = 5, buckets: int = 4096, levels: int = 3) -> DataFrame:
    """(n, total, k, top_sum): the sum of the ``max(1, n div share)`` largest values, exactly, in one way for every size.

    Each level cuts the range that holds the k-th largest value into ``buckets`` equal parts, adds up what lies above
    and goes on with the part the k-th value is in. The last part is looked at by distinct value. No window sees more
    than ``buckets`` rows but the last, whose part is 1 / buckets^levels of the range.
    """
    base = df.select(F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("v"))
    whole = base.agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    k = F.greatest(F.lit(1), F.floor(F.col("n") / share)).cast("long").alias("k")
    state = whole.select("n", "total", k, "lo", "hi", F.lit(0).cast("long").alias("above"), F.lit(0.0).alias("above_sum"))
    down = Window.orderBy(F.col("part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    for _ in range(levels):
        inside = base.crossJoin(F.broadcast(state)).filter("v between lo and hi")  # one row
        width = F.col("hi") - F.col("lo")
        part = F.when(width > 0, F.least(F.floor((F.col("v") - F.col("lo")) / width * buckets), F.lit(buckets - 1))).otherwise(F.lit(0))
        known = ["n", "total", "k", "above", "above_sum"]
        parts = inside.groupBy(part.alias("part")).agg(
            F.count(F.lit(1)).alias("m"), F.sum("v").alias("s"), F.min("v").alias("lo"), F.max("v").alias("hi"), *[F.max(c).alias(c) for c in known]
        )
        placed = parts.withColumns({
            "before": F.col("above") + F.coalesce(F.sum("m").over(down), F.lit(0)),
            "before_sum": F.col("above_sum") + F.coalesce(F.sum("s").over(down), F.lit(0.0)),
        })
        cut = placed.filter("before < k and before + m >= k")
        state = cut.select("n", "total", "k", "lo", "hi", F.col("before").alias("above"), F.col("before_sum").alias("above_sum"))
    values = base.crossJoin(F.broadcast(state)).filter("v between lo and hi").groupBy(F.col("v").alias("part")).agg(
        F.count(F.lit(1)).alias("m"), *[F.max(c).alias(c) for c in known]
    )
    seen = F.coalesce(F.sum("m").over(down), F.lit(0)) + F.col("above")
    taken = values.withColumn("taken", F.greatest(F.lit(0), F.least(F.col("m"), F.col("k") - seen)))
    rest = taken.agg((F.max("above_sum") + F.sum(F.col("taken") * F.col("part"))).alias("top_sum"))
    first = whole.select("n", "total", k)
    return first.crossJoin(F.broadcast(rest))  # one row each


def _clamped(v: Column) -> Column:
    """Infinite values as the largest finite ones."""
    return F.when(v == float("inf"), LARGEST).when(v == float("-inf"), -LARGEST).otherwise(v)


def medians(df: DataFrame, columns: list[str], buckets: int = 1024, levels: int = 5) -> DataFrame:
    """One row with the exact median of every column (null where it has no number), all columns side by side.

    The two middle values of each column are found as ``top_share`` finds its value: the range that holds a wanted rank
    is cut in ``buckets`` equal parts, counts decide the part to go on with, and ranges of one value are done. After the
    levels the last ranges are looked at by distinct value. Cells leave a task as counts only.
    """
    cells = F.array(*[F.struct(F.lit(i).alias("c"), _clamped(F.col(f"`{c}`").cast("double")).alias("v")) for i, c in enumerate(columns)])
    base = df.select(F.explode(cells).alias("x")).select("x.c", "x.v").filter("v IS NOT NULL AND NOT isnan(v)")
    whole = base.groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
    ranks = F.explode(F.array(F.floor((F.col("n") + 1) / 2), F.floor(F.col("n") / 2) + 1)).alias("k")
    state = whole.select("c", F.lit(0).cast("long").alias("above"), "lo", "hi", ranks).distinct()  # two rows a column at most
    down = Window.partitionBy("c", "k").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    for level in range(levels + 1):
        inside = base.join(F.broadcast(state), "c").filter("v between lo and hi")
        # halves, so that the width of the widest range is a number
        width = F.col("hi") / 2 - F.col("lo") / 2
        part = F.when(width > 0, F.least(F.floor((F.col("v") / 2 - F.col("lo") / 2) / width * buckets), F.lit(buckets - 1)).cast("double")).otherwise(0.0)
        parts = inside.groupBy("c", "k", (part if level < levels else F.col("v")).alias("part")).agg(
            F.count(F.lit(1)).alias("m"), F.min("v").alias("lo"), F.max("v").alias("hi"), F.max("above").alias("above")
        )
        placed = parts.withColumn("above", F.col("above") + F.coalesce(F.sum("m").over(down), F.lit(0)))
        state = placed.filter("above < k AND above + m >= k").select("c", "above", "lo", "hi", "k")
    found = state.groupBy("c").agg((F.min("lo") * 0.5 + F.max("hi") * 0.5).alias("v"))
    return found.agg(*[F.max(F.when(F.col("c") == i, F.col("v"))).alias(c) for i, c in enumerate(columns)])
