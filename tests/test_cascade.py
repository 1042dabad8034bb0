"""Cascade target by transaction (D12): by hand and against a plain count."""
import datetime as dt
import random

from rebound.operators import cascade

D0 = dt.date(2026, 1, 1)
LEVELS = (("country", "code"), ("code",), ())
OUT = "country string, code string, provider string, known date, won boolean"
ASK = "id long, country string, code string, provider string, day date"


def day(n):
    return D0 + dt.timedelta(days=n)


def run(spark, asked, outcomes, least=2):
    out = cascade.cascade_targets(spark.createDataFrame(asked, ASK), spark.createDataFrame(outcomes, OUT), "provider", "day", "known", "won",
                                  LEVELS, least)
    return {r["id"]: (r["cascade_provider"], r["cascade_level"], r["cascade_rate"], r["cascade_support"]) for r in out.collect()}


def test_own_provider_is_left_out_and_levels_back_off(spark):
    outcomes = ([("FR", "51", "a", day(1), True)] * 2 + [("FR", "51", "b", day(1), True), ("FR", "51", "b", day(1), False)]
                + [("DE", "51", "c", day(1), False)] * 3 + [("DE", "05", "d", day(1), True)] * 2)
    got = run(spark, [(1, "FR", "51", "a", day(5)), (2, "FR", "51", "z", day(5)), (3, "IT", "51", "a", day(5)), (4, "IT", "77", "a", day(5)),
                      (5, "DE", "51", "c", day(5)), (6, "FR", "51", None, day(5))], outcomes)
    assert got == {1: ("b", 0, 0.5, 2), 2: ("a", 0, 1.0, 2), 3: ("b", 1, 0.5, 2), 4: ("d", 2, 1.0, 2), 5: ("a", 1, 1.0, 2), 6: ("a", 0, 1.0, 2)}


def test_only_earlier_days_count(spark):
    outcomes = [("FR", "51", "a", day(3), True), ("FR", "51", "a", day(4), True), ("FR", "51", "a", day(9), False)]
    got = run(spark, [(i, "FR", "51", "x", day(i)) for i in (3, 4, 5, 9, 10)], outcomes)
    assert got == {3: (None,) * 4, 4: (None,) * 4, 5: ("a", 0, 1.0, 2), 9: ("a", 0, 1.0, 2), 10: ("a", 0, 2 / 3, 3)}


def test_nulls_ties_repeats_and_empty_tables(spark):
    outcomes = [(None, "51", p, day(1), True) for p in ("b", "a", "b", "a")] + [("FR", "51", None, day(1), True)] * 9 + [("FR", "51", "q", None, True)] * 9
    outcomes += [("FR", "", "n", day(1), None)] * 2
    got = run(spark, [(1, None, "51", "x", day(2)), (1, None, "51", "x", day(2)), (2, "FR", "", "x", day(2)), (3, None, "51", "x", None)], outcomes)
    assert got == {1: ("a", 0, 1.0, 2), 2: ("n", 0, 0.0, 2), 3: (None,) * 4}
    assert run(spark, [(1, "FR", "51", "x", day(2))], []) == {1: (None,) * 4}
    assert run(spark, [], outcomes) == {}


def test_against_a_plain_count(spark):
    rng = random.Random(4)
    pick = lambda *v: rng.choice(v)
    outcomes = [(pick("FR", "DE", None), pick("51", "05"), pick("a", "b", "c", None), day(rng.randrange(30)), pick(True, False)) for _ in range(400)]
    asked = [(i, pick("FR", "DE", "IT", None), pick("51", "05", "99"), pick("a", "b", None), day(rng.randrange(35))) for i in range(150)]

    def plain(country, code, own, when):
        for level, cols in enumerate(LEVELS):
            found = []
            for p in "abc":
                rows = [o for o in outcomes if o[2] == p and o[3] < when and ("country" not in cols or o[0] == country) and ("code" not in cols or o[1] == code)]
                if p != own and len(rows) >= 8:
                    found.append((-sum(o[4] for o in rows) / len(rows), p, len(rows)))
            if found:
                less, p, n = min(found)
                return p, level, -less, n
        return (None,) * 4

    got = run(spark, asked, outcomes, least=8)
    assert got == {i: plain(*rest) for i, *rest in asked}
    assert {v[1] for v in got.values()} == {None, 0, 1, 2}
