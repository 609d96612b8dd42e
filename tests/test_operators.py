import random
from datetime import date
from itertools import combinations, product

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseflow.functions.typing import clean_amount
from caseflow.operators import candidates, catalog, decisions, extraction, insights, matching, positions, profiling, regress, resolve, shaping, telemetry, xref
from caseflow.plans import customers
from caseflow.plans.adapters import Inputs
from caseflow.sources import arrays, files, readers, writers
from tests import fixtures
from tests.test_functions import plain_ratio


def test_shaping(spark):
    df = spark.createDataFrame([("hi", "x", "neg")], "message string, target string, airline_sentiment string")
    assert set(shaping.standardize_columns(df).columns) >= {"text", "airline", "sentiment"}
    assert shaping.filter_in(df, "nope", ["a"]).count() == 1
    assert shaping.filter_handles(df, "target", ["@x"]).count() == 1
    dates = spark.createDataFrame([("2024-01-02",), ("01/03/2024",), ("2024/01/04",), ("05-Jan-2024",), ("soon",)], "d string")
    kept, dropped = shaping.parse_dates_multi(dates, "d", "day")
    assert kept.count() == 4 and dropped.first()["dropped"] == 1


def test_guard(spark):
    m = spark.createDataFrame([(0.5,)], "R2 double")
    assert shaping.guard(m, "R2", "<", 0.6).first()["ok"] is True
    assert shaping.guard(m, "R2", ">=", 0.6).first()["ok"] is False
    with pytest.raises(ValueError):
        shaping.guard(m, "MAE", ">=", 1)
    with pytest.raises(Exception, match="guard failed"):
        shaping.guard(m, "R2", ">=", 0.6, fail=True).collect()


def test_profile_and_schema(spark):
    p = {r["name"]: r for r in profiling.profile(fixtures.crm(spark)).collect()}
    assert p["revenue"]["dtype"] == "string" and p["email"]["missing"] == pytest.approx(1 / 8)
    s = {r["name"]: r for r in profiling.infer_schema(fixtures.crm(spark)).collect()}
    assert s["revenue"]["type"] == "integer" and s["revenue"]["confidence"] == pytest.approx(6 / 7)
    assert s["last_contact"]["type"] == "date"
    assert profiling.duplicate_summary(fixtures.crm(spark), "customer_id", "pos").first()["quality_score"] == 90
    empty = spark.createDataFrame([(None,)], "a string")
    assert profiling.infer_schema(empty).first()["type"] == "empty"


def test_messy_score(spark):
    crm = fixtures.crm(spark)
    r = profiling.messy_score(crm, resolve.similar_name_anchors(crm, "name")).first()
    assert r["is_messy"] and r["customer_points"] == 2 and r["name_points"] == 0


def _claims(spark):
    texts = fixtures.complaints(spark)
    return extraction.extract_entities(texts, "original_text", F.col("day").cast("date")).withColumn("user", F.lit("u")).withColumn("airline", F.lit("x"))


def test_complaint_chain(spark):
    facts = shaping.derive_fact_flags(fixtures.flights(spark))
    cascade = matching.match_cascade(_claims(spark), facts)
    got = {r["claim_id"]: r for r in cascade.collect()}
    assert (got[1]["match_status"], got[1]["final_pct"], got[1]["fact"]["fl_num"]) == ("matched", 100, "731")
    assert got[3]["flight_date"] == "2015-03-06"
    assert got[4]["match_status"] == "insufficient_data"
    assert (got[8]["tier"], got[8]["score_pct"]) == (4, 50)  # LHR is not a known place, so origin and date only
    dec = {r["claim_id"]: r for r in decisions.decide(matching.matched_cases(cascade)).collect()}
    assert (dec[1]["refund_type"], dec[1]["estimated_refund_amount"]) == ("cash", 450.0)
    assert dec[2]["refund_reason"] == "Significant delay (4.0 hours)"
    assert dec[5]["refund_eligible"] is False
    assert (dec[6]["refund_type"], dec[6]["estimated_refund_amount"], dec[6]["airline_deadline_days"]) == ("partial", 75.0, 30)
    assert dec[7]["estimated_refund_amount"] == 25.0
    stats = matching.match_stats(cascade).first()
    assert stats["total"] == 8 and stats["successful_matches"] + stats["no_matches"] == 8
    claims = decisions.build_claims(decisions.decide(matching.matched_cases(cascade)), "20240501", ["claim_id"])
    assert sorted(r["claim"]["claim_id"] for r in claims.collect())[0] == "RFC-20240501-0000"


def test_case_figures_equal_breakdown(spark):
    facts = shaping.derive_fact_flags(fixtures.flights(spark))
    claims = spark.createDataFrame([(1, "UA731", "2015-03-04", None, None, "cancelled", "lost bag fee"), (2, None, None, None, None, None, "x"), (3, "ZZ9", None, "ORD", "SEA", "delay", "wifi")], "claim_id int, flight_number string, flight_date string, origin string, destination string, incident_type string, original_text string")
    for some in (claims, claims.filter("claim_id = 2"), claims.limit(0)):
        found = matching.match_cascade(some, facts)
        want = decisions.case_breakdown(decisions.decide(matching.matched_cases(found)), matching.unmatched_cases(found))
        assert sorted(map(tuple, decisions.case_figures(matching.flattened(found)).collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)


def test_match_equals_nested_loops(spark):
    """The lookup join against the rule written as loops, with one hot route and one hot key."""
    rnd = random.Random(3)
    days = [f"2020-01-{d:02d}" for d in range(1, 13)]
    facts, claims = [], []
    for i in range(300):
        hot = rnd.random() < 0.4
        facts.append((i, rnd.choice(days), "AB" if hot else rnd.choice(["CD", "EF"]), "1" if hot else str(rnd.randint(1, 6)),
                      "ORD" if hot else rnd.choice(["LAX", "JFK"]), rnd.choice(["SEA", "DEN"]), "0", rnd.choice(["0", "200"]), rnd.choice(["0", "1"]), None))
    for i in range(200):
        claims.append((i, rnd.choice([None, "AB1", "CD2", "ZZ9", "EF6"]), rnd.choice([None, *days, "2020-03-01"]), rnd.choice([None, "ORD", "LAX"]), rnd.choice([None, "SEA", "DEN"])))
    cols = "fact_id bigint, day string, carrier string, fl_num string, origin string, dest string, dep_delay string, arr_delay string, cancelled string, cancellation_code string"
    fdf = shaping.derive_fact_flags(spark.createDataFrame(facts, cols).selectExpr("*", "cast(day as date) as flight_date"))
    cdf = spark.createDataFrame(claims, "claim_id int, flight_number string, flight_date string, origin string, destination string")
    got = {r["claim_id"]: (r["tier"], r["score_pct"], r["fact"]["carrier"] + r["fact"]["fl_num"], r["fact"]["date_str"]) for r in matching.match_claims(cdf, fdf).collect()}

    lookup = {}
    for f in facts:
        lookup[(f[2] + f[3], f[1])] = f  # first insertion keeps its place, last value wins
    from datetime import date, timedelta

    want = {}
    for cid, code, day, o, d in claims:
        if not code and not o:
            continue
        found = []
        if code and day and (code, day) in lookup:
            found = [(1, 100, (code, day))]
        if code and day and not found:
            for off in (-1, 1):
                other = (date.fromisoformat(day) + timedelta(days=off)).isoformat()
                if (code, other) in lookup:
                    found.append((2, 80, (code, other)))
        if code and not found:
            found = [(3, 60, k) for k in lookup if k[0] == code][:1]
        if not found and (o or d):
            for k, f in lookup.items():
                s = (30 if o and f[4] == o else 0) + (30 if d and f[5] == d else 0)
                if day:
                    gap = abs((date.fromisoformat(f[1]) - date.fromisoformat(day)).days)
                    s += 20 if gap == 0 else 15 if gap <= 1 else 0
                if s >= 40:
                    found.append((4, s, k))
        if found:
            best = max(found, key=lambda x: x[1])
            want[cid] = (best[0], best[1], best[2][0], best[2][1])
    assert got == want


def test_repeated_fact_ids_do_not_multiply_claims(spark):
    facts = [(1, "AB", "1", "ORD", "SEA"), (1, "AB", "1", "ORD", "SEA"), (1, "CD", "2", "ORD", "SEA"), (2, "EF", "3", "LAX", "DEN")]
    cols = "fact_id bigint, carrier string, fl_num string, origin string, dest string"
    more = ["date '2020-01-02' as flight_date", "'0' as dep_delay", "'0' as arr_delay", "'0' as cancelled", "cast(null as string) as cancellation_code"]
    fdf = shaping.derive_fact_flags(spark.createDataFrame(facts, cols).selectExpr("*", *more))
    cdf = spark.createDataFrame([(1, "AB1", "2020-01-02", None, None), (2, "EF3", None, None, None)], "claim_id int, flight_number string, flight_date string, origin string, destination string")
    for given in (fdf, matching.prepared(fdf)):
        assert sorted(r["claim_id"] for r in matching.match_claims(cdf, given).collect()) == [1, 2]


def _people(rnd, n):
    firsts, out = ["Maria", "John", "Ana"], []
    for i in range(n):
        last = "".join(rnd.choice("abcdefgh") for _ in range(7)).capitalize()
        first = "Maria" if rnd.random() < 0.5 else rnd.choice(firsts)
        out.append((i, f"{first} {last}", f"{first[0].lower()}.{last.lower()}@x.com", rnd.choice(["Acme", "Beta", ""])))
    for i in range(n // 3):  # edited copies and plain copies
        _, name, email, company = out[rnd.randrange(n)]
        spot = rnd.randrange(2, len(name) - 1)
        changed = name[:spot] + rnd.choice("xyz") + name[spot + 1 :] if i % 2 else name
        out.append((n + i, changed, email if i % 3 else "", company))
    return out


@pytest.mark.parametrize("hot_block", [3, 1000])
def test_scored_pairs_equal_all_pairs(spark, hot_block):
    """Short, empty, long and many-lettered texts, one table and two, at low and high bounds."""
    rnd = random.Random(hot_block)
    texts = ["", "a", "b", "ab", "ba", "aaa", "aaaa", "Ünïcode ß", "ünïcode s", "日本語テキスト", "日本語のテキスト"]
    texts += ["".join(rnd.choice("abcde ") for _ in range(rnd.randint(1, 18))) for _ in range(90)]
    base = "".join(rnd.choice("abcdefghij ") for _ in range(90))
    texts += [base[: rnd.randint(60, 90)] + "".join(rnd.choice("xyz") for _ in range(rnd.randint(0, 20))) for _ in range(12)]
    texts = sorted(set(texts))
    rows = [(i, t, str(len(t) % 2)) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "id bigint, text string, parity string")
    other = spark.createDataFrame([(100 + i, t[::-1] if i % 3 else t, p) for i, t, p in rows], "id bigint, text string, parity string")
    keep = lambda found: found["text"]
    for bound in (35, 60, 75, 100):
        pct = {(i, j): _ratio(a, b) for (i, a, _), (j, b, _) in combinations(rows, 2)}
        found = candidates.scored_pairs(df, None, "text", bound, ["text"], keep, hot_block=hot_block).collect()
        assert sorted(map(tuple, found)) == sorted((i, j, n) for (i, j), n in pct.items() if n >= bound)
        found = candidates.scored_pairs(df, other, "text", bound, ["text"], keep, ("parity",), "parity", hot_block).collect()
        want = [(i, j, _ratio(a, b)) for i, a, p in rows for j, b, q in map(tuple, other.collect()) if p == q]
        assert sorted(map(tuple, found)) == sorted(w for w in want if w[2] >= bound)
    assert candidates.scored_pairs(df.limit(0), other, "text", 80, ["text"], keep).count() == 0
    within = candidates.scored_pairs(df.limit(9), other, None, 1, ["text"], lambda found: found["text_filled"].astype(int), within="parity", hot_block=hot_block)
    left, right = df.limit(9).collect(), other.collect()
    assert sorted(map(tuple, within.collect())) == sorted((a["id"], b["id"], int(bool(a["text"] and b["text"]))) for a in left for b in right if a["parity"] == b["parity"])


def test_either_bound_loses_no_sum():
    for threshold, first, second, rest in ((8000, 50, 30, 20), (8000, 60, 40, 0), (9000, 50, 30, 20), (6000, 10, 90, 0), (3000, 50, 30, 20)):
        p, q = candidates.either_bound(threshold, first, second, rest)
        assert all(x >= p or y >= q for x in range(101) for y in range(101) if first * x + second * y + 100 * rest >= threshold)


def _ratio(a, b):
    return 100 if a == b else plain_ratio(a, b)


KATE = [(900, "Kate Miller", "kate.miller@x.com", "Acme"), (901, "Cate Miller", "cate.miller@x.com", "Beta"), (902, "Cate Miller", "cate.miller@x.com", "Acme"),
        (903, "", "no.name@x.com", "Acme"), (904, "", "no.nama@x.com", "Beta"), (905, "", "", "Acme")]


@pytest.mark.parametrize("hot_block", [2, 1000])
def test_fuzzy_pairs_equal_all_pairs(spark, hot_block):
    rows = _people(random.Random(7), 60) + KATE
    df = spark.createDataFrame(rows, "pos int, name string, email string, company string")
    found = [(r["id_a"], r["id_b"], r["score"]) for r in resolve.fuzzy_pairs(df, "pos", 80, hot_block).collect()]
    first, want = {}, set()
    for pos, *person in rows:
        first.setdefault(tuple(person), pos)
    for (a, i), (b, j) in combinations(sorted(first.items(), key=lambda x: x[1]), 2):
        s = sum(w * _ratio(x, y) for w, x, y in zip((50, 30, 20), a, b) if w == 50 or (x and y))
        if s >= 8000:
            want.add((i, j, s))
    assert sorted(found) == sorted(want) and {(900, 902), (903, 904)} <= {(i, j) for i, j, _ in want}


@pytest.mark.parametrize("hot_block", [4, 1000])
def test_all_pairs_equal_brute_force(spark, hot_block):
    """One table and two, bounds on one text or on one of two, blank, long and many-lettered texts."""
    rnd = random.Random(hot_block)
    word = lambda most, letters="abcdef ": "".join(rnd.choice(letters) for _ in range(rnd.randint(0, most)))
    rows = [(i, word(9), word(7), str(i % 3)) for i in range(70)] + [(70, "x" * 90, "日本語", "0"), (71, "x" * 88 + "yz", "日本の語", "0"), (72, "", "", "1"), (73, "", "", "1")]
    two = [(100 + i, b, a, k) for i, a, b, k in rows]
    schema = "id bigint, a string, b string, k string"
    left, right = spark.createDataFrame(rows, schema), spark.createDataFrame(two, schema)

    def score(found):
        total = 60 * found["a"] + 30 * found["b"] * found["b_filled"] + 1000 * found["k"]
        return np.where(total >= 5500, total, -1)

    def plain(x, y):
        return 60 * _ratio(x[1], y[1]) + (30 * _ratio(x[2], y[2]) if x[2] and y[2] else 0) + 1000 * (x[3] == y[3])

    for bounds in ([{"a": 25}], [{"a": 60}, {"a": 25, "b": 32}]):
        for other, pairs in ((None, combinations(rows, 2)), (right, product(rows, two))):
            want = sorted((x[0], y[0], n) for x, y in pairs if (n := plain(x, y)) >= 5500)
            found = candidates.all_pairs(left, other, bounds, ["a", "b"], score, ("k",), hot_block)
            assert sorted(map(tuple, found.collect())) == want and len(want) > 40
    assert candidates.all_pairs(left.limit(0), right, [{"a": 25}], ["a", "b"], score, ("k",)).count() == 0


@pytest.mark.parametrize("sparse", [1, 10**9])
def test_all_pairs_in_large_blocks_equal_brute_force(spark, sparse, monkeypatch):
    """Blocks are compared in pieces, and a least weighted sum loses no pair."""
    rnd = random.Random(sparse)
    word = lambda most: "".join(rnd.choice("abcdef ") for _ in range(rnd.randint(0, most)))
    rows = [(i, word(9), word(7)) for i in range(90)] + [(90, "", ""), (91, "", ""), (92, "a", ""), (93, "", "b")]
    two = [(100 + i, b, a) for i, a, b in rows]
    left, right = (spark.createDataFrame(x, "id bigint, a string, b string") for x in (rows, two))
    monkeypatch.setattr(candidates, "SPARSE", sparse)
    monkeypatch.setattr(candidates, "MOST_BLOCKS", 2)
    score = candidates.weighted({"a": 60, "b": 30}, 5000, ())
    for other, pairs in ((None, combinations(rows, 2)), (right, product(rows, two))):
        want = sorted((x[0], y[0], n) for x, y in pairs if (n := 60 * _ratio(x[1], y[1]) + 30 * _ratio(x[2], y[2])) >= 5000)
        found = candidates.all_pairs(left, other, [{"a": 34}], ["a", "b"], score, (), 4, 8, ({"a": 60, "b": 30}, 5000), 40)
        assert sorted(map(tuple, found.collect())) == want and len(want) > 40


def test_blocks_grow_before_rows_are_shuffled_more_often():
    size = lambda rows: candidates._blocks(rows, candidates.HOT_BLOCK, candidates.BLOCK_ROWS, candidates.SHIPPED_ROWS)
    assert [size(n) for n in (0, 900, 100_000, 1_000_000, 6_480_000, 32_000_000)] == [1, 1, 8, 31, 32, 123]


def test_fuzzy_pairs_write_few_bytes_a_row(spark, tmp_path):
    """What a row writes does not depend on how many keys its texts offer."""
    df = spark.createDataFrame(_people(random.Random(5), 225), "pos int, name string, email string, company string")
    sc = spark.sparkContext
    before = sc.getCheckpointDir()
    sc.setCheckpointDir(str(tmp_path))
    resolve.fuzzy_pairs(df, "pos").count()
    written = sum(f.stat().st_size for f in tmp_path.rglob("part-*"))
    if before:
        sc.setCheckpointDir(before.rsplit("/", 1)[0])
    assert 0 < written < 1000 * 300


def test_changed_initials_are_found_by_every_fuzzy_join(spark):
    people = spark.createDataFrame(KATE[:1], "pos int, name string, email string, company string").withColumn("customer_id", F.lit("K1"))
    records = spark.createDataFrame([("r", "Cate Miller", "cate.miller@x.com")], "rec_id string, name string, email string")
    assert resolve.upsert_matches(people, records, "pos").first()["entity_pos"] == 900
    refs = spark.createDataFrame([("Cate Miller",)], "ref string")
    assert resolve.best_names(refs, people, "name", "customer_id", "pos", 80).first()["matched_id"] == "K1"
    one, two = people.select(F.col("pos").alias("pid"), F.lit("1").alias("id"), "email", "name"), records.select(F.lit(5).alias("rid"), F.lit("2").alias("id"), "email", "name")
    for id_ in ("2", ""):  # ids that differ, and no id
        other = two.withColumn("id", F.lit(id_))
        found = xref.xref_match(one, other, ["id", "email", "name"]).count()
        assert found == 1, id_


def test_best_names_go_tier_by_tier(spark, monkeypatch):
    """The best of all names, ties included; only texts without a better name are compared at a low bound."""
    rnd = random.Random(13)
    names = sorted({f"{rnd.choice(['Maria', 'Ana'])} {''.join(rnd.choice('abcdefgh') for _ in range(rnd.randint(3, 9)))}" for _ in range(120)})
    names += [base := "".join(rnd.choice("abcdefgh ") for _ in range(120)).strip(), base[:60] + "x" + base[60:]]
    refs = [*names[:20], *(n[:-1] for n in names[10:60]), *(n[2:-1] for n in names[50:90]), base, base + "y", "CUST900123", "CUST900124"]
    people = [(f"K{i % 90}", n, len(names) - i) for i, n in enumerate([*names, *names[:5]])]
    lefts, scored = {}, resolve.scored_pairs

    def seen(left, right, index, bound, *args, **more):
        lefts[bound] = {r["id"] for r in left.collect()}
        return scored(left, right, index, bound, *args, **more)

    monkeypatch.setattr(resolve, "scored_pairs", seen)
    df = spark.createDataFrame(people, "customer_id string, name string, pos int")
    found = resolve.best_names(spark.createDataFrame([(r,) for r in refs], "ref string"), df, "name", "customer_id", "pos", 80).collect()
    want = {}
    for ref in refs:
        pct, pos, own = max((_ratio(ref, n), -pos, c) for c, n, pos in people)
        if pct >= 80:
            want[ref] = (own, pct)
    assert {r["ref"]: (r["matched_id"], r["match_pct"]) for r in found} == want and len(found) == len(want)
    assert not lefts[95] & set(names[:20]) and base in lefts[95]
    assert lefts[80] == {r for r in refs if want.get(r, ("", 0))[1] < 90}


def test_keys_hold_what_both_sides_have(spark):
    """Texts of characters that no partner has offer nothing; near texts meet by what is left of them, not by a few letters."""
    r, bands = 0.945, list(range(8, 18))
    digits = frozenset(candidates.numbered_letters("CUST900123"))
    assert list(candidates.keys_of("CUST900123", "", True, 0.795, {}, bands, False)) and not list(candidates.keys_of("CUST900123", "", True, 0.795, {}, bands, False, digits))
    keys = lambda text, left: set(np.concatenate([k for _, k in candidates.keys_of(text, "", left, r, {}, bands, False)]).tolist())
    ref = keys("Maria bcdefga", True)
    assert ref & keys("Maria bcdefgah", False) and not ref & keys("Maria agfedcbh", False)


def test_star_clusters_equal_sequential_rule(spark):
    rnd = random.Random(11)
    n = 60
    edges = sorted({tuple(sorted(rnd.sample(range(n), 2))) for _ in range(70)})
    got = {r["id"]: r["anchor"] for r in resolve.star_clusters(spark.range(n), spark.createDataFrame(edges, "id_a long, id_b long")).collect()}
    near, taken = set(edges), {}
    for i in range(n):
        if i in taken:
            continue
        taken[i] = i
        for j in range(i + 1, n):
            if j not in taken and (i, j) in near:
                taken[j] = i
    assert got == taken


def test_dedupe_and_golden_record(spark):
    crm = fixtures.crm(spark)
    clustered = resolve.dedupe_customers(crm, "pos")
    clusters = {r["pos"]: r["cluster"] for r in clustered.collect()}
    assert clusters[5] == 1 and len(set(clusters.values())) == 7
    golden = resolve.golden_record(clustered.withColumn("revenue", clean_amount(F.col("revenue"))), "cluster", "pos")
    row = golden.filter("cluster = 1").first()
    assert (row["name"], row["revenue"], row["merged_rows"]) == ("Omar Haddad", 66500.0, 2)


def test_payments_and_tickets(spark):
    crm, pay = fixtures.crm(spark), fixtures.payments(spark)
    matched = resolve.reconcile(pay, crm, "customer_reference", "customer_id", "name", "pos")
    got = {r["transaction_id"]: r["matched_id"] for r in matched.collect()}
    assert got["P-6"] == "K02" and "P-7" not in got
    assert [r["transaction_id"] for r in resolve.orphans(pay, matched, "transaction_id").collect()] == ["P-7"]
    roll = {r["matched_id"]: r for r in resolve.payment_rollup(matched, "matched_id", "amount", "pay_date", "status", "transaction_id").collect()}
    assert roll["K02"]["total_payments"] == 10500.0 and roll["K03"]["payment_status"] == "failed"
    merged = resolve.reconcile_upsert(crm, resolve.ticket_people(fixtures.tickets(spark)), "pos").collect()
    assert len(merged) == 8 + 3  # Petra matches; Omar, Ines and Yuki are new
    assert next(r for r in merged if r["customer_id"] == "K01")["support_issues"] == 1


def test_reconcile_upsert_updates_and_inserts(spark, tmp_path):
    """The query gives every person of the tickets, with the entity that was updated or inserted for them."""
    people = [(i, i % 5, "BUILDING", 100.0 + i) for i in range(1, 13)]
    spark.createDataFrame(people, "c_custkey bigint, c_nationkey int, c_mktsegment string, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    orders = [(k, k % 12 + 1, "O", 10.0, date(2024, 1, 1 + k % 28)) for k in range(1, 61)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    inputs = Inputs(spark, str(tmp_path))
    rows, tickets = customers.reconcile_upsert(inputs).collect(), resolve.ticket_people(inputs("tickets"))
    assert sorted((r["ticket_name"], r["ticket_email"]) for r in rows) == sorted(map(tuple, tickets.select("name", "email").distinct().collect()))
    updated, inserted = ([r for r in rows if (r["entity_pos"] is None) == new] for new in (False, True))
    assert updated and inserted
    assert all(r["customer_id"] == f"CUST{r['entity_pos'] // 2:07d}" and r["score"] >= 8000 for r in updated)
    assert all(r["customer_id"].startswith("SUP-") and r["score"] is None for r in inserted)
    assert sum({r["customer_id"]: r["support_issues"] for r in rows}.values()) == 60


def test_equal_people_are_matched_without_comparing(spark, monkeypatch):
    people = spark.createDataFrame([(7, "Kate Miller", "k@x.com"), (3, "Kate Miller", "k@x.com"), (4, "Cate Miller", "k@x.com"), (5, "Bo", "")], "pos int, name string, email string")
    records = spark.createDataFrame([("r", "Kate Miller", "k@x.com"), ("s", "Katie Miller", "k@x.com"), ("t", "Bo", ""), (None, "Cate Miller", "k@x.com")], "rec_id string, name string, email string")
    compared, pairs = [], resolve._upsert_pairs

    def seen(left, *rest):
        compared.extend(r["id"] for r in left.collect())
        return pairs(left, *rest)

    monkeypatch.setattr(resolve, "_upsert_pairs", seen)
    got = {r["rec_id"]: (r["entity_pos"], r["score"]) for r in resolve.upsert_matches(people, records, "pos").collect()}
    assert got == {"r": (3, 10000), "s": (3, 60 * plain_ratio("Katie Miller", "Kate Miller") + 4000), None: (4, 10000)}
    assert sorted(compared) == ["s", "t"]


def test_contains_pairs(spark):
    df = spark.createDataFrame([("Ann",), ("Joanna",), ("ann",), ("Bo",), ("Bob",), ("",)], "name string")
    got = {(r["name_a"], r["name_b"], r["rows_a"]) for r in resolve.contains_pairs(df, "name").collect()}
    assert got == {("ann", "joanna", 2), ("bo", "bob", 1)}


def test_other_ids_are_compared_only_without_a_better_match(spark, monkeypatch):
    """A mean of two texts beside two different ids is 200 / 3 at most: rows with a match above that do not look there."""
    cols = "id string, email string, name string"
    p = spark.createDataFrame([(0, "1", "ann@x.com", "Ann Lee"), (1, "2", "bob@y.org", "Bob Ray")], "pid int, " + cols)
    r = spark.createDataFrame([(5, "", "ann.lee@x.com", "Anne Lou"), (6, "9", "ann@x.com", "Ann Lee"), (7, "8", "bob@y.org", "Bob Ray")], "rid int, " + cols)
    asked, pairs = [], xref.all_pairs

    def seen(a, b, *rest, **more):
        if a.filter("own_id <> ''").count() and b.filter("own_id <> ''").count():
            asked.extend(x["id"] for x in a.collect())
        return pairs(a, b, *rest, **more)

    monkeypatch.setattr(xref, "all_pairs", seen)
    got = {x["pid"]: (x["rid"], x["score_sum"], x["valid_fields"]) for x in xref.xref_match(p, r, ["id", "email", "name"]).collect()}
    assert got == {0: (5, 167, 2), 1: (7, 200, 3)} and asked == [1]


def test_xref(spark):
    cols = "id string, email string, name string, phone string, revenue string, status string"
    p = spark.createDataFrame([(0, "1", "a@x.com", "Ann Lee", "5551234567", "$100", "active"), (1, "2", "b@x.com", "Bob Ray", "1", "50", "paused"), (2, "3", "", "Zoe", "", "x", "")], "pid int, " + cols)
    r = spark.createDataFrame([(0, "1", "a@y.com", "Lee, Ann", "15559999999", "150", "closed"), (1, "", "b@x.com", "Bob Rey", "1", "51", "suspended")], "rid int, " + cols)
    m = xref.xref_match(p, r, ["id", "email", "name"])
    assert {(x["pid"], x["rid"]) for x in m.collect()} == {(0, 0), (1, 1)}
    found = xref.discrepancies(p, r, m, ["email", "phone", "revenue", "status"], "reference_0")
    got = {(x["pid"], x["type"], x["severity"]) for x in found.collect()}
    assert got == {(0, "email_domain_mismatch", "low"), (0, "phone_mismatch", "medium"), (0, "numeric_mismatch", "high"), (0, "status_mismatch", "high")}
    assert [x["pid"] for x in xref.xref_missing(p, m, "reference_0").collect()] == [2]
    assert found.filter("field = 'revenue'").first()["recommended_action"] == "Investigate revenue discrepancy - possible data sync issue"
    conf = xref.record_confidence(p, xref.source_confidence(p, m, found, "reference_0"), ["id", "email", "name"])
    by = {x["pid"]: x for x in conf.collect()}
    assert by[2]["cross_reference_score"] == 0.8 and (by[0]["cross_reference_score"], by[0]["overall_score"]) == (0.57, 0.7)


@pytest.mark.parametrize("hot_block", [1, 1000])
def test_xref_hot_blocks_change_nothing(spark, hot_block):
    rnd = random.Random(2)
    rows = [(i, str(i) if i % 4 else "", f"u{i % 9}@x.com" if i % 5 else "", n, "", "", "") for i, n, *_ in _people(rnd, 60)]
    cols = "id string, email string, name string, phone string, revenue string, status string"
    p = spark.createDataFrame(rows, "pid int, " + cols)
    r = spark.createDataFrame([(i, "x" + k if i % 3 else k, e, n if i % 2 else " ".join(reversed(n.split())), *rest) for i, k, e, n, *rest in rows], "rid int, " + cols)
    got = {(x["pid"], x["rid"]) for x in xref.xref_match(p, r, ["id", "email", "name"], hot_block).collect()}
    want = {(x["pid"], x["rid"]) for x in xref.xref_match(p, r, ["id", "email", "name"], 10**9).collect()}
    assert got == want and len(got) > 40


def test_positions(spark):
    rnd = random.Random(1)
    values = [(i, "hot" if rnd.random() < 0.6 else "k", rnd.randrange(50), float(rnd.choice([0, 0, 5, 9, 40]))) for i in range(500)]
    df = spark.createDataFrame(values, "id long, k string, t long, v double")
    got = {r["id"]: r["p"] for r in positions.running_position(df, ["k"], ["t", "id"], "p").collect()}
    for k in ("hot", "k"):
        order = [i for i, kk, t, _ in sorted(values, key=lambda x: (x[2], x[0])) if kk == k]
        assert [got[i] for i in order] == list(range(1, len(order) + 1))
    for buckets in (2, 4096):
        top = positions.top_share(df, "v", 5, buckets).first()
        assert (top["k"], top["top_sum"]) == (100, sum(sorted((v for *_, v in values), reverse=True)[:100]))
    assert positions.top_share(df.limit(3), "v").first()["k"] == 1


def test_one_key_holds_nine_tenths_of_the_rows(spark):
    """The hot key is dealt over all ranges; positions and the crossing are those of the whole key; null is a key."""
    n = 4000
    df = spark.range(n).selectExpr("id as charge_id", "case when id % 10 > 0 then 'hot' when id % 20 > 0 then null else 'k' || id % 7 end as app", "'m' as metric", "cast((id * 7919) % 4000 as bigint) as ts", "1.0D as amount", "900.5D as top")
    rows = df.collect()
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # ranges this small would be joined to one
    reset = lambda: spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    parts = positions.ordered_ranges(df, ["app"], ["ts"]).groupBy("__part").count().collect()
    assert len(parts) > 2 and max(r["count"] for r in parts) < 0.6 * n
    order = {}
    for r in sorted(rows, key=lambda r: r["ts"]):
        order.setdefault(r["app"], []).append(r["charge_id"])
    got = {r["charge_id"]: r["p"] for r in positions.running_position(df, ["app"], ["ts"], "p").collect()}
    assert got == {c: i + 1 for ids in order.values() for i, c in enumerate(ids)}
    whole = {r["charge_id"]: r["p"] for r in positions.running_position(df, [], ["ts"], "p").collect()}
    assert whole == {r["charge_id"]: i + 1 for i, r in enumerate(sorted(rows, key=lambda r: r["ts"]))}
    found = {r["app"]: (r["total"], r["breach"] and r["breach"]["charge_id"]) for r in positions.first_crossing(df, ["app", "metric"], ["ts", "charge_id"], "amount", "top").collect()}
    assert found == {a: (float(len(ids)), ids[900] if len(ids) > 900 else None) for a, ids in order.items()}
    assert positions.running_position(df.limit(0), ["app"], ["ts"], "p").count() == 0
    reset()


def test_claim_numbers_beyond_four_digits(spark):
    decided = spark.range(10_001).selectExpr("id as claim_id", "true as refund_eligible", "'u' as user", "'AA' as bts_carrier", "'1' as bts_flight_num", "'2020-01-01' as bts_date", "'A' as bts_origin", "'B' as bts_destination", "'delay' as incident_type", "'t' as original_text", "false as bts_cancelled", "1.0D as bts_arr_delay_minutes", "'r' as refund_reason", "'c' as dot_rule_citation", "1.0D as estimated_refund_amount", "'cash' as refund_type", "7 as airline_deadline_days", "80 as final_pct", "'e' as evidence_summary")
    ids = {r["claim_id"]: r["claim"]["claim_id"] for r in decisions.build_claims(decided, "20240501", ["claim_id"]).collect()}
    assert len(set(ids.values())) == 10_001 and (ids[7], ids[9_999], ids[10_000]) == ("RFC-20240501-0007", "RFC-20240501-9999", "RFC-20240501-10000")


def test_fact_ids_of_large_keys(spark):
    from caseflow.plans.adapters import _sql

    key, line = 2**40, "select cast({k} as bigint) as l_orderkey, 7 as l_linenumber, cast({p} as bigint) as l_partkey, cast({s} as bigint) as l_suppkey, date '2020-01-01' as l_shipdate, 'R' as l_returnflag, 'O' as l_linestatus"
    spark.sql(" union all ".join(line.format(k=k, p=p, s=s) for k in (1, key) for p in (1, 2**31) for s in (1, 2**31))).createOrReplaceTempView("big_lines")
    spark.sql(f"select cast(k as bigint) as o_orderkey, 1 as o_custkey, date '2020-01-01' as o_orderdate from values (1), ({key}) as t(k)").createOrReplaceTempView("big_orders")
    spark.sql("select cast(s as bigint) as s_suppkey, 1 as s_nationkey from values (1), (2147483648) as t(s)").createOrReplaceTempView("big_suppliers")
    spark.sql("select 1 as c_custkey, 2 as c_nationkey").createOrReplaceTempView("big_customers")
    text = _sql("spark")["facts_raw"][1].format(lineitem="big_lines", orders="big_orders", supplier="big_suppliers", customer="big_customers")
    rows = spark.sql(text).select("fact_id", "order_key").orderBy("fact_id").collect()
    assert len({r["fact_id"] for r in rows}) == 8 and [r["order_key"] for r in rows] == [1] * 4 + [key] * 4


def test_quota_usage(spark):
    rows = [("a", "cpu_ms", 10.0, i, i) for i in range(20)] + [("b", "cpu_ms", 1.0, 3, 100)]
    df = spark.createDataFrame(rows, "app string, metric string, amount double, ts long, charge_id long")
    got = {r["app"]: r for r in telemetry.quota_usage(df, {"cpu_ms": 75.0}).collect()}
    assert got["a"]["breach_id"] == 7 and got["a"]["usage_pct"] == 100.0 and got["b"]["breach_id"] is None


def test_telemetry_rules(spark):
    calls = spark.createDataFrame(
        [(1, "r", "read_csv", None, 50.0, 0), (2, "r", "planner", "gpt-4", 1500.0, 50), (3, "r", "train_lr", None, 5000.0, 0)] + [(i, "r", "planner", "gpt-4", 2000.0, 100) for i in (4, 5, 6)],
        "call_id long, run_id string, tool_name string, model string, latency_ms double, tokens_used long",
    ).withColumns({"inputs": F.lit("{}"), "outputs": F.lit("{}"), "cache_hit": F.col("call_id") == 2, "timestamp": F.timestamp_seconds("call_id")})
    metered = telemetry.with_impact(calls)
    sugg = telemetry.pruning_suggestions(metered).collect()
    assert ("cache_opportunity", "planner", 4) in {(s["type"], s["tool"], s["uses"]) for s in sugg}
    m = telemetry.run_metrics(metered).first()
    assert m["tools_by_category"] == {"data": 1, "ml": 1, "other": 4} and m["most_carbon_intensive_tool"] == "train_lr"
    replay = calls.filter("call_id < 6")
    issues = telemetry.replay_verify(calls, replay, ["call_id"]).collect()
    assert [(i["position"], i["issue"]) for i in issues] == [(6, "missing_call")]
    assert telemetry.replay_counts(calls, replay).first()["actual_calls"] == 5


def test_insights(spark):
    df = fixtures.crm(spark).withColumns({"revenue": clean_amount(F.col("revenue")), "sentiment": F.when(F.col("pos") == 2, "angry"), "support_issues": F.lit(1), "payment_status": F.when(F.col("pos") == 2, "failed"), "revenue_impact": F.when(F.col("pos") == 3, "potential upsell $50k")})
    s = insights.executive_summary(df).first()
    assert (s["total_customers"], s["active_customers"], s["high_value_customers"], s["retention_rate"]) == (8, 5, 3, 62.5)
    actions = insights.top_actions(insights.action_candidates(df)).collect()
    assert actions[0]["title"] == "Recover Failed Payments" and {a["title"] for a in actions} >= {"Execute Upsell Campaign", "Emergency Customer Recovery"}
    assert next(a for a in actions if a["title"] == "Execute Upsell Campaign")["impact_score"] == 50000.0
    assert insights.concentration_risk(df).first()["top_customers"] == 1


def test_regression(spark):
    df = spark.range(200).selectExpr("id", "cast(id % 7 as double) as a", "case when id % 5 = 0 then null else cast(id as double) end as b").selectExpr("*", "3 + 2 * a + 0.5 * coalesce(b, 99) as y")
    model, metrics, gate = regress.run_regression(df, "id", "y", ["a", "b"])
    coef = {r["term"]: r["coef"] for r in model.collect()}
    assert coef["a"] == pytest.approx(2, abs=0.3) and gate.first()["ok"]
    exact = regress.train_linear(df.filter("b is not null"), "y", ["a", "b"]).collect()
    assert [r["coef"] for r in exact] == pytest.approx([3, 2, 0.5], abs=1e-6)
    tiny = spark.createDataFrame([(1, 1.0), (2, 2.0)], "k int, y double")
    parts = regress.hash_split(tiny, "k", 1.1)
    assert {r["k"]: r["part"] for r in parts.collect()} == {1: "train", 2: "val"}
    flat = spark.createDataFrame([("$1,000", 900.0), ("oops", 1.0)], "t string, p double")
    r = regress.regression_metrics(flat, "t", "p").first()
    assert (r["MSE"], r["MAE"], r["R2"]) == (10000.0, 100.0, 0.0)


def test_sources_and_report(spark, tmp_path):
    csv = tmp_path / "t.csv"
    csv.write_text("a,b,c\n1, x ,2.5\n3,,\n")
    typed = readers.type_columns(readers.read_auto(spark, str(csv)))
    assert [f.dataType.simpleString() for f in typed.schema.fields] == ["bigint", "string", "double"]
    (tmp_path / "semi.dat").write_text("a;b\n1;2\n")
    assert readers.sniff_text(spark, str(tmp_path / "semi.dat")) == {"kind": "csv", "sep": ";"}
    (tmp_path / "arr.json").write_text('[{"a": 1}, {"a": 2}]')
    assert readers.read_records(spark, str(tmp_path / "arr.json")).count() == 2
    (tmp_path / "late.json").write_text("\n" * 40 + '[{"a": 1}, {"a": 2}]')
    assert readers.read_records(spark, str(tmp_path / "late.json")).count() == 2
    (tmp_path / "quoted.dat").write_text('\n"a, b"|c\n"1, 2"|3\n')
    assert readers.sniff_text(spark, str(tmp_path / "quoted.dat")) == {"kind": "csv", "sep": "|"}
    writers.write_claims(spark.createDataFrame([(1, ("x", 2))], "claim_id int, claim struct<a:string,b:int>"), str(tmp_path / "claims"))
    assert spark.read.json(str(tmp_path / "claims")).first()["claim"]["b"] == 2
    assert readers.register("typed_rows", typed).count() == spark.sql("select * from typed_rows").count() == 2
    assert readers.read_table(spark, str(csv)).columns == ["a", "b", "c"]
    with pytest.raises(ValueError, match="missing columns"):
        readers.require_columns(typed, ["zzz"])
    writers.append_log(spark.createDataFrame([("RUN_START",)], "op string"), str(tmp_path / "log"), "r1")
    writers.append_log(spark.createDataFrame([("RUN_END",)], "op string"), str(tmp_path / "log"), "r1")
    assert readers.read_log(spark, str(tmp_path / "log")).count() == 2
    manifest = files.checksum_manifest(spark, str(tmp_path / "log"))
    assert manifest.filter("path like 'part-%'").count() >= 2
    cat = files.file_catalog(spark, str(tmp_path))
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe broken")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "t.csv").write_text("x,y\n" + "1,2\n" * 900)
    (tmp_path / "pic.PNG").write_bytes(b"\x89PNG")
    (tmp_path / "mixed.Txt").write_text("case of a suffix")
    (tmp_path / "none").write_text("no suffix")
    cat = files.file_catalog(spark, str(tmp_path))
    assert {r["category"] for r in cat.collect()} >= {"spreadsheets", "data", "images"}
    of = {r["path"].rsplit("/", 2)[-2] + "/" + r["name"]: r for r in cat.collect()}
    assert of["sub/t.csv"]["summary"].startswith("CSV data with 902 rows") and of[tmp_path.name + "/bad.txt"]["error"] and of["sub/t.csv"]["error"] is None
    assert {"mixed.Txt", "none", "pic.PNG"} <= {r["name"] for r in cat.collect()} and "suffix" in of[tmp_path.name + "/mixed.Txt"]["keywords"]
    assert catalog.index_terms(cat).filter("kind = 'category' and term = 'spreadsheets'").first()["n_files"] == 2
    assert catalog.search_index(cat, "Spreadsheets").count() == 2
    assert catalog.catalog_summary(cat).filter("category is null").count() == 1
    metrics = spark.createDataFrame([(1.0, 0.5, 0.9)], "MSE double, MAE double, R2 double")
    lines = [r["line"] for r in writers.quality_report(profiling.profile(typed), metrics).orderBy("line_no").collect()]
    assert lines[3] == "Rows: 2" and lines[-1] == "- **R2**: 0.900000" and "| b | string | 0.500 |" in lines
    writers.write_json_sorted(spark.createDataFrame([(2, 1), (1, 5)], "b int, a int"), str(tmp_path / "s"), ["b"])
    assert "".join(p.read_text() for p in sorted((tmp_path / "s").glob("part-*"))).splitlines() == ['{"a":5,"b":1}', '{"a":1,"b":2}']


def test_quoted_cells_over_several_lines(spark, tmp_path):
    path = tmp_path / "notes.txt"
    path.write_text('\nname;note\n"Ann ""A""";"first\nsecond; third\n\nfourth"\nBob;"x"\n')
    assert readers.sniff_text(spark, str(path)) == {"kind": "csv", "sep": ";", "multiline": True}
    rows = {r["name"]: r["note"] for r in readers.read_auto(spark, str(path)).collect()}
    assert len(rows) == 2 and rows["Bob"] == "x" and "fourth" in [v for k, v in rows.items() if k != "Bob"][0]
    (tmp_path / "plain.txt").write_text("a,b\n1,2\n")
    assert readers.sniff_text(spark, str(tmp_path / "plain.txt")) == {"kind": "csv", "sep": ","}
    (tmp_path / "prose.txt").write_text("Dear Ann, hello\nno cells here\n")
    assert readers.sniff_text(spark, str(tmp_path / "prose.txt")) == {"kind": "text"}
    (tmp_path / "open.txt").write_text('a,"b\n' + "more\n" * 100)
    assert readers.sniff_text(spark, str(tmp_path / "open.txt"))["kind"] == "text"


def test_json_arrays_are_read_by_byte_ranges(spark, tmp_path):
    """Strings with brackets, quotes and escapes, nested values, pretty print, several files; ranges of a few bytes."""
    import json

    rnd = random.Random(4)
    odd = ["}", "{", "]\\", '\\"}', '"', "a,b", "日本", "x" * 50, "", "\n", "{[", "\\\\"]
    rows = [{"id": i, "s": rnd.choice(odd) + rnd.choice(odd), "n": {"a": [i, {"b": rnd.choice(odd)}], "c": None}} for i in range(120)]
    folder = tmp_path / "arrays"
    folder.mkdir()
    (folder / "a.json").write_text(json.dumps(rows[:50]))
    (folder / "b.json").write_text("\n " + json.dumps(rows[50:110], indent=2, ensure_ascii=False) + "\n")
    (folder / "c.json").write_text(json.dumps(rows[110:], separators=(",", ":")))
    (folder / "d.json").write_text("[]")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    for size in ("37", "400", "1m"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = arrays.array_elements(spark, str(folder)).orderBy("file", "place").collect()
        assert [json.loads(r["element"]) for r in found] == rows
    spark.conf.set("spark.sql.files.maxPartitionBytes", keep[0])
    spark.conf.set("spark.sql.files.openCostInBytes", keep[1])
    got = readers.read_records(spark, str(folder / "b.json"))
    assert sorted((r["id"], r["s"]) for r in got.collect()) == [(r["id"], r["s"]) for r in rows[50:110]]
    assert readers.read_records(spark, str(folder / "c.json"), "id long, s string").count() == 10
    assert readers.read_records(spark, str(folder / "d.json"), "id long").count() == 0


def test_medians(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 1.5, 1.5, 2.0]), rnd.gauss(0, 1e6), float(i % 2), rnd.choice([1e308, -1e308, 0.0]), None) for i in range(701)]
    df = spark.createDataFrame(rows, "a double, b double, c double, d double, e double")
    for part in (df, df.limit(2), df.limit(1), df.limit(0)):
        for buckets, levels in ((1024, 5), (2, 3)):
            got = positions.medians(part, df.columns, buckets, levels).first()
            assert got == part.agg(*[F.median(c).alias(c) for c in df.columns]).first()
    model = {r["term"]: r for r in regress.train_linear(df.selectExpr("b as y", "a", "c"), "y", ["a", "c"], "median").collect()}
    assert model["a"]["impute_value"] == df.filter("b IS NOT NULL").agg(F.median("a")).first()[0]


def test_distinct_counts_and_posting_blocks(spark):
    df = spark.createDataFrame([(i, "x" if i % 3 else None, f"v{i % 7}", None) for i in range(500)], "a int, b string, c string, d string")
    for exact in (True, False):
        got = {r["name"]: r["unique_count"] for r in profiling.distinct_counts(df, exact).collect()}
        assert (got["b"], got["c"], got["d"]) == (1, 7, 0) and abs(got["a"] - 500) <= (0 if exact else 75)
    paths = [f"/data/{'common/' if i % 2 else ''}file{i}.txt" for i in range(103)] + ["/data", ""]
    cat = spark.createDataFrame([(p, "docs", ["rare"] if i % 50 == 0 else []) for i, p in enumerate(paths)], "path string, category string, keywords array<string>")
    index = catalog.inverted_index(cat, 10)
    blocks = index.collect()
    assert max(r["n_files"] for r in blocks) == 10 and sum(r["n_files"] for r in blocks if r["term"] == "docs") == len(paths)
    flat = sorted(tuple(r) for r in catalog.postings(index).collect())
    assert flat == sorted(tuple(r) for r in catalog.index_entries(cat).distinct().collect())
    assert all(r["first"] <= r["last"] for r in blocks)


def test_enrich_hook_keeps_strong_rows(spark):
    found = extraction.extract_entities(fixtures.complaints(spark), "original_text", F.col("day").cast("date"))
    done = extraction.enrich_low_confidence(found, lambda b: b.assign(origin="JFK"), 60)
    got = {r["claim_id"]: r for r in done.collect()}
    assert got[1]["extraction_method"] == "regex" and got[4]["extraction_method"] == "regex+hook" and got[4]["origin"] == "JFK"
    assert got[4]["confidence_pct"] == 30 and done.count() == found.count()


def test_charts(spark):
    df = spark.createDataFrame([("2024-01-01", "a", 1.0), ("2024-01-02", "b", 2.0)], "d string, c string, v double")
    rec = profiling.recommend_charts(profiling.viz_stats(df))
    assert [r["chart"] for r in rec.orderBy("rank").collect()] == ["line_chart", "bar_chart", "histogram", "pie_chart"]
    assert '"chart_type":"line_chart"' in profiling.preview_config(rec).first()["config"]


def test_operator_catalog():
    from caseflow.operators import operator_catalog

    assert {"matching.match_cascade", "xref.xref_match", "positions.top_share"} <= set(operator_catalog())


def test_column_samples_sort_nothing_but_the_first(spark):
    df = spark.range(1000).selectExpr("id", "if(id < 3, '', concat('v', 999 - id)) as a", "if(id = 7, 'NULL', null) as b")
    out = profiling.column_samples(df, ["id"], 2)
    assert {r["name"]: r["sample_values"] for r in out.collect()} == {"id": ["0", "1"], "a": ["v996", "v995"], "b": []}
    plan = df._jdf.queryExecution().executedPlan().toString() + out._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and plan.count("TakeOrderedAndProject") >= 3


def test_matching_reads_facts_once_and_asks_later_tiers_for_open_claims(spark):
    flights = spark.createDataFrame([(1, "AB", "1", "ORD", "SEA"), (2, "AB", "2", "ORD", "LAX"), (3, "CD", "3", "BOS", "SEA")], "fact_id long, carrier string, fl_num string, origin string, dest string")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    flights = flights.mapInArrow(counted, flights.schema).selectExpr("*", "date '2020-01-05' as flight_date")
    rows = [(1, "AB1", "2020-01-06", None, None), (2, "AB2", None, "BOS", "SEA"), (3, "ZZ9", "2020-01-05", "BOS", "SEA"), (4, "ZZ9", None, None, None)]
    claims = spark.createDataFrame(rows, "claim_id long, flight_number string, flight_date string, origin string, destination string")
    got = {r["claim_id"]: (r["tier"], r["score_pct"], r["match_reason"], r["fact"]["fl_num"]) for r in matching.match_claims(claims, shaping.derive_fact_flags(flights)).collect()}
    assert got == {1: (2, 80, "key_date_within_1d", "1"), 2: (3, 60, "key_only", "2"), 3: (4, 80, "partial_origin+destination+date", "3")}
    assert seen.value == 3


def test_positions_without_keys_need_no_window_over_the_rows(spark):
    df = spark.range(5000).selectExpr("(id * 7919) % 5000 as id", "concat('t', id) as t")
    out = positions.running_position(df, [], ["id"], "at")
    assert out.filter("at <> id + 1").isEmpty() and out.count() == 5000
    assert "row_number" not in out._jdf.queryExecution().toString()
