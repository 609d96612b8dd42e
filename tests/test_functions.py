import hashlib
import random

import pytest
from pyspark.sql import functions as F

from caseflow.functions import impact, similarity, text, typing
from caseflow.operators import regress


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(column.alias("r")).first()["r"]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        prev = 0
        for j, y in enumerate(b):
            prev, row[j + 1] = row[j + 1], prev + 1 if x == y else max(row[j + 1], row[j])
    return row[-1]


def plain_ratio(a, b):
    if a == b:
        return 100
    return 0 if not a or not b else round(100 * (2 * lcs(a, b) / (len(a) + len(b))))


@pytest.mark.parametrize(
    "raw,want",
    [("(555) 123-4567", "(555) 123-4567"), ("15559876543", "(555) 987-6543"), ("555.444.3333", "(555) 444-3333"), ("", ""), (None, ""), ("not-a-phone", "not-a-phone")],
)
def test_clean_phone(spark, raw, want):
    assert one(spark, typing.clean_phone(F.col("v")), raw) == want


@pytest.mark.parametrize("raw,want", [("$1,200.50", 1200.5), ("50000", 50000.0), ("invalid", None), ("", None), ("1.2.3", None)])
def test_clean_amount(spark, raw, want):
    assert one(spark, typing.clean_amount(F.col("v")), raw) == want


def test_money_amount_is_strict(spark):
    assert one(spark, typing.money_amount(F.col("v")), "$1,000") == 1000.0
    assert one(spark, typing.money_amount(F.col("v")), "USD 5") is None


@pytest.mark.parametrize("raw,want", [("a@b.com", True), ("d.brown@invalid-email", False), ("", True), (None, True)])
def test_valid_email(spark, raw, want):
    assert one(spark, typing.is_valid_email(F.col("v")), raw) is want


@pytest.mark.parametrize(
    "raw,want",
    [("yes", "boolean"), ("1", "boolean"), ("-12", "integer"), ("1e3", "number"), ("nan", "number"), ("2024-01-02x", "date"), ("01/02/2024", "date"), ("abc", "string"), ("NULL", "missing"), ("1d", "string")],
)
def test_value_kind(spark, raw, want):
    assert one(spark, typing.value_kind(F.col("v")), raw) == want


@pytest.mark.parametrize("raw,kind,number", [(" 12 ", "integer", 12.0), ("1.5", "number", 1.5), ("2E2", "number", 200.0), ("here", "string", None), ("  ", "null", None)])
def test_coerce(spark, raw, kind, number):
    got = one(spark, typing.coerce(F.col("v")), raw)
    assert (got["kind"], got["number"]) == (kind, number)


def test_ratio_equals_plain_lcs(spark):
    rnd = random.Random(7)
    words = ["".join(rnd.choice("abcdeé ") for _ in range(rnd.randint(0, 90))) for _ in range(400)]
    pairs = list(zip(words, reversed(words)))
    got = spark.createDataFrame(pairs, "a string, b string").select("a", "b", similarity.ratio("a", "b").alias("r")).collect()
    assert all(r["r"] == plain_ratio(r["a"], r["b"]) for r in got)


def test_token_sort_and_email(spark):
    df = spark.createDataFrame([("Smith, John", "john smith", "a.b@x.com", "a.c@x.com")], "a string, b string, c string, d string")
    r = df.select(similarity.token_sort_ratio(F.col("a"), F.col("b")).alias("t"), similarity.email_similarity(F.col("c"), F.col("d")).alias("e")).first()
    assert r["t"] == 100 and r["e"] == 100


def test_sql_functions(spark):
    similarity.register_sql_functions(spark)
    r = spark.sql("select fuzzy_ratio('abcd', 'abce') as a, edit_similarity('abcd', 'abce') as b").first()
    assert (r["a"], r["b"]) == (75, 75)


def test_entity_code_strict_and_loose(spark):
    assert one(spark, text.entity_code(F.col("v")), "late on 2 B6 234") == "B6234"
    assert one(spark, text.entity_code(F.col("v"), strict=False), "late on 2 UA1") == "on2"


@pytest.mark.parametrize(
    "raw,want",
    [("on 02/03/15", "2015-02-03"), ("on 2/14 again", "2015-02-14"), ("Feb 15 late", "2015-02-15"), ("Feb 15th", None), ("cancelled yesterday", "2015-02-19"), ("today", "2015-02-20"), ("Monday", None), ("13/45", None)],
)
def test_mentioned_date(spark, raw, want):
    got = one(spark, text.mentioned_date(F.col("v"), F.lit("2015-02-20").cast("date")).cast("string"), raw)
    assert got == want


def test_incidents_and_hours(spark):
    assert one(spark, text.incident_types(F.col("v")), "Delayed, lost bag, 5 hr delay") == "delay, delayed, lost bag"
    assert one(spark, text.delay_hours(F.col("v")), "stuck 3 hours, 5 hr delay") == 5
    assert one(spark, text.incident_types(F.col("v")), "fine") is None


def test_person_company(spark):
    for raw, want in [("John Smith from Acme Corp", ("John Smith", "Acme Corp")), ("Lisa Chen - InnovateCorp", ("Lisa Chen", "")), ("Jane", ("Jane", "")), ("123", (None, ""))]:
        assert tuple(one(spark, text.person_company(F.col("v")), raw)) == want


def test_money_mention(spark):
    assert one(spark, text.money_mention(F.col("v")), "potential upsell $50k") == 50000.0
    assert one(spark, text.money_mention(F.col("v")), "about 1,250.50 a year") == 1250.5


def test_keywords_and_intent(spark):
    assert one(spark, text.keywords(F.col("v")), "The zebra and a fähig apple ate") == ["apple", "ate", "zebra"]
    assert one(spark, text.intent(F.col("v")), "please chart and find")["category"] == "web_research"
    assert one(spark, text.intent(F.col("v")), "hello")["confidence"] == 0.6


def test_split_byte_is_md5(spark):
    rows = spark.range(300).select("id", regress.split_byte(F.col("id"), 1337).alias("b")).collect()
    assert all(r["b"] == hashlib.md5(f"{r['id']}:1337".encode()).digest()[0] for r in rows)


def test_impact(spark):
    df = spark.createDataFrame([("train_lr", 1000.0, 0, None, 0), ("generate", 0.0, 1000, "gpt-4", 0), ("read_csv", 0.0, 0, None, 10)], "t string, l double, k int, m string, c int")
    got = df.select(impact.tool_impact(F.col("t"), F.col("l"), F.col("k"), F.col("m"), F.col("c")).alias("i")).collect()
    assert got[0]["i"]["cost_usd"] == pytest.approx(0.001) and got[0]["i"]["co2_grams"] == pytest.approx(8.0)
    assert got[1]["i"]["cost_usd"] == pytest.approx(700 * 30e-6 + 300 * 60e-6) and got[1]["i"]["co2_grams"] == pytest.approx(8.5)
    assert got[2]["i"]["co2_grams"] == pytest.approx(0.01 * 0.05)


def test_content_key(spark):
    key = impact.content_key(F.lit("m"), {"b": F.lit("x"), "a": F.lit(1)})
    assert one(spark, key, "") == hashlib.sha256(b'm:{"a":1,"b":"x"}').hexdigest()
