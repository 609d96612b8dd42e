"""Text to entities: Column expressions over whole texts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, code lists and patterns that decide results.
COMPLAINT_WORDS = [
    "delay", "cancel", "stuck", "late", "missed", "refund", "compensation", "terrible", "worst", "never",
    "awful", "horrible", "ruined", "hours", "wait", "gate", "flight", "baggage", "lost",
]
AIRPORTS = [
    "ORD", "LAX", "JFK", "LGA", "ATL", "DFW", "DEN", "PHX", "LAS", "SEA",
    "SFO", "MIA", "BOS", "MSP", "DTW", "PHL", "CLT", "IAH", "EWR", "MCO",
]
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
INCIDENT_PATTERNS = [
    r"\b(cancel|cancelled|canceled)\b",
    r"\b(delay|delayed)\b",
    r"\b(missed\s+connection|missed\s+flight)\b",
    r"\b(lost\s+bag|baggage|luggage)\b",
    r"\b(overbook|bumped)\b",
    r"\b(mechanical\s+issue|maintenance)\b",
]
DELAY_PATTERNS = [
    r"(\d+)\s*(?:hour|hr|h)\s*delay",
    r"delayed\s*(\d+)\s*(?:hour|hr|h)",
    r"stuck\s*(\d+)\s*(?:hour|hr|h)",
    r"(\d+)\s*hr\s*(?:late|delay)",
]
STOP_WORDS = [
    "the", "and", "for", "are", "but", "not", "you", "all", "can", "had", "her", "was", "one", "our", "out", "day",
    "get", "has", "him", "his", "how", "man", "new", "now", "old", "see", "two", "way", "who", "boy", "did", "its",
    "let", "put", "say", "she", "too", "use",
]
INTENT_RULES = [
    ("data_analysis", 0.8, ["analyze", "analysis", "insights", "report"]),
    ("web_research", 0.85, ["search", "find", "research", "web"]),
    ("data_processing", 0.75, ["clean", "process", "organize", "structure"]),
    ("visualization", 0.9, ["visualize", "chart", "graph", "plot", "dashboard"]),
    ("plan_generation", 0.8, ["plan", "generate", "create", "build"]),
]
INTENT_DEFAULT = ("general_automation", 0.6)
INTENT_SUGGESTIONS = {
    "data_analysis": "data.profile,viz.recommend,io.emit_report",
    "web_research": "web.search,nlp.summarize",
    "data_processing": "data.infer_schema,data.clean,data.validate",
    "visualization": "viz.recommend,viz.render,io.export",
    "plan_generation": "planner.generate,io.validate",
    "general_automation": "data.profile,io.emit_report",
}

# What a text must hold, in lower case, before a pattern can match; looked for first, since most texts hold none of it.
INCIDENT_NEEDLES = [["cancel"], ["delay"], ["missed"], ["lost", "baggage", "luggage"], ["overbook", "bumped"], ["mechanical", "maintenance"]]
DELAY_NEEDLES = [["delay"], ["delay"], ["stuck"], ["late", "delay"]]

_STRICT_CODE = r"\b([A-Z][A-Z0-9])\s*(\d{1,4})\b"
_LOOSE_CODE = r"(?i)\b([A-Z]{2,3})\s*(\d{1,4})\b"


def _gated(c: Column, needles: list[str], hit: Column) -> Column:
    """``hit`` where the text holds one of the needles, else an empty text."""
    low = F.lower(c)
    return F.when(reduce(lambda x, y: x | y, [low.contains(n) for n in needles]), hit).otherwise(F.lit(""))


def any_word(c: Column, words: list[str]) -> Column:
    """True when the text holds any of the words as a case-insensitive substring."""
    return F.coalesce(F.lower(c).rlike("|".join(words)), F.lit(False))


def keyword_count(c: Column, words: list[str] = COMPLAINT_WORDS) -> Column:
    return F.coalesce(F.regexp_count(F.lower(c), F.lit("|".join(words))), F.lit(0))


def entity_codes(c: Column, strict: bool = True) -> Column:
    """All carrier+number codes in order of appearance, without inner blanks."""
    found = F.regexp_extract_all(c, F.lit(_STRICT_CODE if strict else _LOOSE_CODE), F.lit(0))
    return F.transform(found, lambda x: F.regexp_replace(x, r"\s+", ""))


def entity_code(c: Column, strict: bool = True) -> Column:
    """First code, or null. ``strict=False`` also takes lower case and plain words such as ``on 2``."""
    code = F.regexp_replace(F.regexp_extract(c, _STRICT_CODE if strict else _LOOSE_CODE, 0), r"\s+", "")
    return F.when(code != "", code)


def airport_codes(c: Column, places: list[str] = AIRPORTS) -> Column:
    """Distinct known three-letter codes in order of first appearance."""
    found = F.regexp_extract_all(c, F.lit(r"(?i)\b(" + "|".join(places) + r")\b"), F.lit(1))
    return F.array_distinct(F.transform(found, lambda x: F.upper(x)))


def mentioned_date(c: Column, reference_date: Column) -> Column:
    """First usable date: M/D/Y, then M/D, then month name and day, then yesterday or today.

    Dates without a year take the year of ``reference_date``.
    """
    year = F.date_format(reference_date, "yyyy")

    def ymd(y: Column, m: Column, d: Column) -> Column:
        return F.try_to_date(F.concat_ws("-", y, F.lpad(m, 2, "0"), F.lpad(d, 2, "0")), "yyyy-MM-dd")

    # every pattern scans the text once; its short hit is taken apart afterwards
    full = F.split(_gated(c, ["/"], F.regexp_extract(c, r"\b(\d{1,2})/(\d{1,2})/(\d{2,4})\b", 0)), "/")
    full_year = F.get(full, F.lit(2))
    full_year = F.when(F.length(full_year) == 2, F.concat(F.lit("20"), full_year)).otherwise(full_year)
    short = F.split(_gated(c, ["/"], F.regexp_extract(c, r"\b(\d{1,2})/(\d{1,2})\b", 0)), "/")
    named = F.regexp_extract(c, r"(?i)\b(Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]*\s+(\d{1,2})\b", 0)
    month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(named, 1, 3)))
    relative = F.lower(_gated(c, ["yesterday", "today"], F.regexp_extract(c, r"(?i)\b(yesterday|today)\b", 1)))
    return F.coalesce(
        F.when(F.length(full_year) == 4, ymd(full_year, F.get(full, F.lit(0)), F.get(full, F.lit(1)))),
        F.when(F.size(short) == 2, ymd(year, F.get(short, F.lit(0)), F.get(short, F.lit(1)))),
        F.when(named != "", ymd(year, month_no.cast("string"), F.regexp_extract(named, r"(\d+)$", 1))),
        F.when(relative == "yesterday", F.date_sub(reference_date, 1)).when(
            relative == "today", reference_date.cast("date")
        ),
    )


def _delay_hits(c: Column) -> list[Column]:
    return [_gated(c, n, F.regexp_extract(c, "(?i)" + p, 1)) for p, n in zip(DELAY_PATTERNS, DELAY_NEEDLES)]


def delay_hours(c: Column) -> Column:
    """First integer of the first delay pattern that matches."""
    return F.coalesce(*[h.try_cast("int") for h in _delay_hits(c)])


def incident_types(c: Column) -> Column:
    """Distinct incident words, sorted and joined by ``, ``; null when nothing is mentioned."""
    hits = [F.lower(_gated(c, n, F.regexp_extract(c, "(?i)" + p, 1))) for p, n in zip(INCIDENT_PATTERNS, INCIDENT_NEEDLES)]
    delayed = reduce(lambda x, y: x | y, [h != "" for h in _delay_hits(c)])
    words = F.array(*hits, F.when(delayed, F.lit("delay")).otherwise(F.lit("")))
    kept = F.array_sort(F.array_distinct(F.filter(words, lambda w: w != "")))
    return F.when(F.size(kept) > 0, F.array_join(kept, ", "))


def extraction_score(code: Column, places: Column, date: Column, incident: Column) -> Column:
    """Integer hundredths: 30 code, 20/10 places, 20 date, 20 incident."""
    return (
        F.when(code.isNotNull(), 30).otherwise(0)
        + F.when(F.size(places) >= 2, 20).when(F.size(places) == 1, 10).otherwise(0)
        + F.when(date.isNotNull(), 20).otherwise(0)
        + F.when(incident.isNotNull(), 20).otherwise(0)
    )


def person_company(c: Column) -> Column:
    """struct(person, company) from ``X from Y``, ``X at Y``, ``X - Y`` or a bare name."""
    led = F.regexp_extract(c, r"^([A-Za-z\s]+)\s+(?:from|at|-)\s+", 1)
    bare = F.regexp_extract(c, r"^([A-Za-z\s]+)$", 1)
    person = F.trim(F.when(led != "", led).otherwise(bare))
    company = F.trim(F.regexp_extract(c, r"(?:from|at)\s+(.+)", 1))
    return F.struct(
        F.when(person != "", person).alias("person"),
        F.when((person != "") & (company != ""), company).otherwise(F.lit("")).alias("company"),
    )


def money_mention(c: Column) -> Column:
    """First amount in the text; a ``k`` right after it means thousands."""
    pattern = r"\$?([0-9][0-9,]*(?:\.[0-9]+)?)\s?([kK]?)\b"
    amount = F.regexp_replace(F.regexp_extract(c, pattern, 1), ",", "").try_cast("double")
    return amount * F.when(F.regexp_extract(c, pattern, 2) != "", 1000).otherwise(1)


def company_class(c: Column) -> Column:
    """Corp, Inc, LLC or Other by substring, first hit wins."""
    low = F.lower(c)
    return (
        F.when(low.contains("corp"), "Corp")
        .when(low.contains("inc"), "Inc")
        .when(low.contains("llc"), "LLC")
        .otherwise("Other")
    )


def keywords(c: Column, k: int = 10) -> Column:
    """First ``k`` of the distinct words with three letters or more, alphabetical, without stop words."""
    words = F.regexp_extract_all(F.lower(c), F.lit(r"(?<![\p{L}\p{M}\p{N}_])([a-z]{3,})(?![\p{L}\p{M}\p{N}_])"), F.lit(1))
    return F.slice(F.array_sort(F.array_except(words, F.array(*[F.lit(w) for w in STOP_WORDS]))), 1, k)


def intent(c: Column) -> Column:
    """struct(category, confidence, suggestions) by the first keyword group that hits."""
    category, confidence = F.lit(INTENT_DEFAULT[0]), F.lit(INTENT_DEFAULT[1])
    for name, score, words in reversed(INTENT_RULES):
        hit = any_word(c, words)
        category = F.when(hit, F.lit(name)).otherwise(category)
        confidence = F.when(hit, F.lit(score)).otherwise(confidence)
    suggestions = F.create_map(*[F.lit(x) for kv in INTENT_SUGGESTIONS.items() for x in kv])
    return F.struct(
        category.alias("category"), confidence.alias("confidence"), suggestions[category].alias("suggestions")
    )
