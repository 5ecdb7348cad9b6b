"""Answers that are known exactly, with noise off and with seeded noise."""

import pytest

from tests.fixtures import session, tables


@pytest.fixture(scope="module")
def catalog(spark):
    return tables(spark)


def ask(s, sql, args=None):
    rows = [tuple(r) for r in s.sql(sql, args).collect()]
    return sorted(rows, key=lambda r: tuple((x is not None, str(x)) for x in r))


NOISELESS = [
    ("SELECT count(*) FROM test_customers", [(18,)]),
    ("SELECT count(*) FROM test_purchases", [(36,)]),
    ("SELECT count(city), count(DISTINCT city) FROM test_customers", [(17, 2)]),
    ("SELECT count(DISTINCT cid) FROM test_purchases", [(14,)]),
    ("SELECT city, count(DISTINCT id) FROM test_customers GROUP BY 1", [("*", 3), ("Berlin", 8), ("Rome", 7)]),
    ("SELECT count(*) FROM test_customers WHERE planet = 'Earth'", [(17,)]),
    ("SELECT sum(id) FROM test_customers", [(151,)]),
    ("SELECT sum(discount) FROM test_customers", [(19.0,)]),
    ("SELECT city, sum(id) FROM test_customers GROUP BY 1", [("*", None), ("Berlin", 68), ("Rome", 59)]),
    ("SELECT city, round(sum(discount), 4) FROM test_customers GROUP BY 1", [("*", None), ("Berlin", 9.0), ("Rome", pytest.approx(4.8333, abs=1e-4))]),
    ("SELECT sum(discount) FROM test_customers_negative", [(-19.0,)]),
    ("SELECT sum(discount) FROM test_customers_mixed", [(2.5,)]),
    ("SELECT 1 FROM test_patients", [(1,)] * 11),
    ("SELECT count(*), count(city), count(DISTINCT city) FROM test_patients", [(11, 11, 2)]),
    ("SELECT city FROM test_patients GROUP BY 1", [("Berlin",), ("Rome",)]),
    ("SELECT count(*), count(city), count(DISTINCT city) FROM test_customers WHERE city = 'London'", [(0, 0, 0)]),
    ("SELECT count(*), count(city), count(DISTINCT city) FROM empty_test_customers", [(0, 0, 0)]),
    ("SELECT count(DISTINCT planet) FROM test_customers", [(1,)]),
    ("SELECT city, count(DISTINCT city) FROM test_customers GROUP BY 1", [("*", 3), ("Berlin", 3), ("Rome", 3)]),
    ("SELECT discount, count(DISTINCT id) FROM test_customers GROUP BY 1", [(None, 4), (0.5, 4), (1.0, 6), (2.0, 4)]),
    ("SELECT floor_by(discount, 2) AS f, count(*) FROM test_customers GROUP BY 1", [(0.0, 13), (2.0, 4)]),
    ("SELECT city FROM test_customers", [("*",)] * 3 + [("Berlin",)] * 8 + [("Rome",)] * 7),
    ("SELECT 1, city FROM test_customers", [(1, "*")] * 3 + [(1, "Berlin")] * 8 + [(1, "Rome")] * 7),
    ("SELECT city FROM test_customers GROUP BY 1 HAVING length(city) <> 4", [("*",), ("Berlin",)]),
    ("SELECT city, is_suppress_bin(*) FROM test_customers GROUP BY 1", [("*", True), ("Berlin", False), ("Rome", False)]),
    ("SELECT city, avg(id) - sum(id) / count(id) AS d FROM test_customers GROUP BY 1 HAVING city <> '*'", [("Berlin", 0.0), ("Rome", 0.0)]),
    ("SELECT 2 * length(city) AS n FROM test_customers GROUP BY city ORDER BY count(*) DESC LIMIT 2", [(12,), (8,)]),
    ("SELECT count(*) FROM led_with_victim", [(21,)]),
    ("SELECT a.city, a.n, b.n FROM (SELECT city, count(*) n FROM test_customers GROUP BY 1) a FULL OUTER JOIN (SELECT city, count(*) n FROM test_patients GROUP BY 1) b ON a.city = b.city", [("*", 3, None), ("Berlin", 8, 6), ("Rome", 7, 3)]),
    ("WITH c AS (SELECT city FROM test_customers GROUP BY 1) SELECT count(*) FROM c", [(3,)]),
    ("SELECT city FROM test_customers GROUP BY 1 EXCEPT SELECT city FROM test_patients GROUP BY 1", [("*",)]),
    ("SELECT name FROM test_products WHERE id > 3 OR price < 2", [("Food",), ("Movie",)]),
    ("SELECT EXISTS (SELECT city FROM test_customers)", [(True,)]),
    ("SELECT city, count(*) FROM test_customers WHERE 1 = 0 GROUP BY 1", []),
]


@pytest.mark.parametrize("sql, want", NOISELESS)
def test_noiseless(spark, catalog, sql, want):
    assert ask(session(spark, catalog), sql) == want


def groups(rows):
    return {"/".join(map(str, r[:-1])): r[-1] for r in rows}


BASE = {"math/f/prof": 4, "math/m/prof": 4, "history/f/prof": 4, "history/m/prof": 4, "cs/m/prof": 4}


@pytest.mark.parametrize("name, change", [
    ("led_base", {}), ("led_with_victim", {"cs/m/prof": 5}), ("led_with_two_victims", {"cs/m/prof": 6}), ("led_with_three_cs_women", {"cs/f/prof": 3}), ("led_with_different_titles", {}), ("led_with_star_bucket", {"cs/m/prof": 5, "*/*/*": 3}),
])
def test_low_effect_detection(spark, catalog, name, change):
    assert groups(ask(session(spark, catalog), f"SELECT dept, gender, title, count(*) FROM {name} GROUP BY 1, 2, 3")) == BASE | change
    assert groups(ask(session(spark, catalog), f"SELECT dept, gender, title, count(DISTINCT id) FROM {name} GROUP BY 1, 2, 3")) == BASE | change


FOUR = {k: v for k, v in BASE.items() if not k.startswith("cs")}


@pytest.mark.parametrize("name, want, n", [("star_bucket", FOUR | {"*/*/*": 3}, 19), ("star_bucket_suppressed_1", FOUR, 16), ("star_bucket_suppressed_2", FOUR, 16), ("star_bucket_empty", {}, 0), ("star_bucket_only", {"*/*/*": 5}, 5)])
def test_suppress_bin(spark, catalog, name, want, n):
    s = session(spark, catalog)
    assert groups(ask(s, f"SELECT dept, gender, title, count(*) FROM {name} GROUP BY 1, 2, 3")) == want
    assert len(ask(s, f"SELECT dept, gender, title FROM {name}")) == n
    s.set("compute_suppress_bin", False)
    assert "*/*/*" not in groups(ask(s, f"SELECT dept, gender, title, count(*) FROM {name} GROUP BY 1, 2, 3"))


def test_histogram(spark, catalog):
    s = session(spark, catalog, "histogram")
    one = lambda sql: ask(s, sql)[0][0]
    assert one("SELECT count_histogram(id) FROM test_histogram") == [[None, 3], [1, 4], [2, 3]]
    assert one("SELECT count_histogram(id, 5) FROM test_histogram") == [[0, 7], [5, 2]]
    assert len(ask(s, "SELECT unnest_histogram(h) FROM (SELECT count_histogram(id) h FROM test_histogram) x")) == 3
    assert one("SELECT count_histogram(id) FROM empty_test_customers") == []
    direct = session(spark, catalog, "histogram", "direct")
    assert ask(direct, "SELECT count_histogram(id, 5), count_noise(*) FROM test_histogram") == [([[0, 7], [5, 2], [10, 1]], 0.0)]


NOISY = [
    ("SELECT count(*) FROM test_customers", [(4,)]),
    ("SELECT count(*) FROM test_purchases", [(23,)]),
    ("SELECT count(city), count(DISTINCT city) FROM test_customers", [(4, 1)]),
    ("SELECT count(DISTINCT cid) FROM test_purchases", [(9,)]),
    ("SELECT city, count(DISTINCT id) FROM test_customers GROUP BY 1", [("*", 16), ("Rome", 8)]),
    ("SELECT count(*) FROM test_customers WHERE planet = 'Earth'", [(17,)]),
    ("SELECT sum(id), sum_noise(id) FROM test_customers", [(34, 58.0)]),
    ("SELECT sum(discount), sum_noise(discount) FROM test_customers", [(pytest.approx(7.8854094), 8.0)]),
    ("SELECT city, sum(id), sum_noise(id) FROM test_customers GROUP BY 1", [("*", 122, 54.0), ("Rome", 64, 60.0)]),
    ("SELECT city, sum(discount), sum_noise(discount) FROM test_customers GROUP BY 1", [("*", pytest.approx(12.012415), 9.5), ("Rome", pytest.approx(4.601863, abs=1e-5), pytest.approx(4.4))]),
    ("SELECT count_noise(*), count_noise(city), count_noise(DISTINCT city) FROM test_customers", [(7.0, pytest.approx(6.8), 0.0)]),
    ("SELECT count(*), count(city), count(DISTINCT city) FROM test_patients", [(4, 4, 0)]),
    ("SELECT floor_by(age, 30) f, count(*) FROM test_patients GROUP BY 1", [(None, 23)]),
    ("SELECT floor_by(age, 30) f, floor_by(age, 106) g, count(*) FROM test_patients GROUP BY 1, 2", [(None, None, 9)]),
    ("SELECT count(*) FROM test_customers WHERE city = 'Berlin'", [(17,)]),
    ("SELECT count(*) FROM test_customers WHERE city = 'Berlin' UNION SELECT count(*) FROM test_customers GROUP BY city HAVING city = 'Berlin'", [(17,)]),
    ("SELECT count(*) FROM test_customers WHERE city = 'Berlin' AND round_by(discount, 2) = 0", [(7,)]),
    ("SELECT count(*) FROM test_customers AS c JOIN test_purchases ON c.id = cid WHERE city = 'Berlin'", [(44,)]),
    ("SELECT count(*) FROM test_purchases JOIN test_customers AS c ON cid = c.id WHERE city = 'Berlin'", [(44,)]),
]


@pytest.mark.parametrize("sql, want", NOISY)
def test_noisy(spark, catalog, sql, want):
    assert ask(session(spark, catalog, "noisy"), sql) == want


def test_misc(spark, catalog):
    s = session(spark, catalog, "misc")
    assert ask(s, "SELECT count(*) FROM test_purchases") == [(34,)] and ask(s, "SELECT count(*) FROM test_customers") == [(16,)]
    assert ask(s, "SELECT city, count(*) FROM test_customers GROUP BY 1") == [("*", 2), ("Berlin", 9), ("Rome", 7)]
    assert ask(s, "SELECT age, count(*) FROM test_patients GROUP BY 1 HAVING age IS NULL OR age > 40") == [(None, 2), (57, 2), (64, 2)]


def test_datetime(spark, catalog):
    s = session(spark, catalog, "default")
    assert ask(s, "SELECT count(*) FROM test_datetime GROUP BY ts") == [(9,)]
    assert ask(s, "SELECT count(*) FROM test_datetime GROUP BY tz") == [(11,)]
    assert ask(s, "SELECT count(*) FROM test_datetime WHERE date_trunc('year', ts) = timestamp_ntz '2012-01-01'") == [(11,)]
    assert ask(s, "SELECT count(*) FROM test_datetime WHERE extract(century from ts) = 21") == [(9,)]
    assert ask(s, "SELECT count(*) FROM test_datetime WHERE date_part('century', ts) = 21") == [(9,)]


def test_order_of_rows_and_partitions_changes_nothing(spark, catalog):
    s = session(spark, catalog, "noisy")
    before = ask(s, "SELECT city, count(*), sum(id) FROM test_customers GROUP BY 1")
    spark.table("test_customers").orderBy("discount").repartition(5).createOrReplaceTempView("test_customers")
    assert ask(s, "SELECT city, count(*), sum(id) FROM test_customers GROUP BY 1") == before


def test_low_values_by_turns(spark):
    """Identifiers that share values or none, in several groups: the settled parts and the rest are those of the turns alone."""
    import random

    import pandas as pd

    from hushql.operators import program

    rng = random.Random(8)
    rows = set()
    for group in ("a", "b", None):
        for inst in (0, 1):
            for aid in range(40):
                h = rng.getrandbits(64) - (1 << 63)
                kind = rng.choice(["own", "one", "mixed"])
                for k in range(1 if kind == "one" else rng.choice([1, 2, 5])):
                    rows.add((group, False, inst, f"{aid}-{k}" if kind == "own" else f"one {rng.randrange(6)}" if kind == "one" else f"mixed {rng.randrange(40)}", h))
    rows = sorted(rows, key=str)
    low = spark.createDataFrame(rows, "l0 string, star boolean, inst int, v string, h long").repartition(3)
    spec = program.Spec(None, ["string"], ["bigint", "bigint"], [], None)
    got = sorted((tuple(r) for r in program.assigned(low, spec, "f0").collect()), key=str)
    turns = program._greedy(["l0", "star"], 2, "f0")
    want = []
    for group in ("a", "b", None):
        frame = pd.DataFrame([r for r in rows if r[0] == group], columns=["l0", "star", "inst", "v", "h"])
        want += [(group, False, int(r.inst), r.leg, int(r.h), float(r.c)) for r in turns(frame).itertuples()]
    key = lambda r: str(tuple(r[i] for i in (0, 2, 4)))
    have = sorted(((r[0], r[1], r[2], r[3], r[4], r[5]) for r in got), key=key)
    assert have == sorted(want, key=key)
