"""Small tables with known anonymous answers."""

import re
from pathlib import Path

from hushql.config import Config
from hushql.labels import Catalog
from hushql.session import Session

CITIES = [(0, None, None), (1, "Berlin", 1), (2, "Berlin", 1), (3, "Rome", 0.5), (4, "London", 2), (5, "Berlin", 2), (6, "Rome", 1), (7, "Rome", 0.5), (8, "Berlin", 0), (9, "Rome", 1), (10, "Berlin", 2), (11, "Rome", 1.5), (12, "Rome", 0.5), (13, "Rome", 0.5), (14, "Berlin", 1.5), (15, "Berlin", 1), (16, "Berlin", 1), (17, "Madrid", 2)]
PURCHASES = "0,0 0,1 0,3 1,1 2,1 3,1 4,1 5,1 6,1 7,1 8,2 9,1 10,2 11,1 12,1 13,2 1,2 2,2 3,2 4,2 5,2 6,2 7,1 8,1 9,2 1,2 1,2 2,1 3,0 n,n 4,3 5,3 6,4 7,-1 7,4 8,-2 9,-3 10,-4"
PATIENTS = "0,,Berlin,37 1,John,Berlin,37 2,Alice,Berlin,37 3,Bob,Berlin,37 4,Emma,Berlin,64 5,John,Berlin,57 6,Bob,Berlin,19 7,Alice,Rome,37 8,Dan,Rome,37 9,Anna,Rome,64 10,Mike,London,64 11,Mike,London,57 12,Mike,London,16 13,Mike,London,17"
LED = [(i + 1, d, g, "prof") for i, (d, g) in enumerate([x for x in (("math", "m"), ("math", "f"), ("history", "m"), ("history", "f"), ("cs", "m")) for _ in range(4)])]
DEPT = "id int, dept string, gender string, title string"


def known_salt() -> str:
    """The salt under which the known noisy answers were drawn, as the fixture notes give it."""
    notes = (Path(__file__).resolve().parents[1] / "FIXTURES.md").read_text()
    return re.search(r"The fixed salt for every golden is `([^`]+)`", notes)[1]


def tables(spark) -> Catalog:
    catalog = Catalog(spark)

    def make(name, rows, schema, *aids):
        spark.createDataFrame(rows, schema).createOrReplaceTempView(name)
        catalog.mark_personal(name, *aids) if aids else catalog.mark_public(name)

    number = lambda x: None if x == "n" else int(x)
    real = "id int, city string, discount float, planet string"
    make("test_customers", [(i, c, None if d is None else float(d), "Earth" if i else None) for i, c, d in CITIES], real, "id")
    make("test_customers_negative", [(i, c, None if d is None else -float(d), "Earth") for i, c, d in CITIES], real, "id")
    make("test_customers_mixed", [(i, c, None if d is None else float(d) - 1, "Earth") for i, c, d in CITIES], real, "id")
    make("empty_test_customers", [], "id int, name string, city string, discount float", "id")
    make("test_purchases", [tuple(map(number, p.split(","))) for p in PURCHASES.split()], "cid int, pid int", "cid")
    make("test_products", [(0, None, None), (1, "Food", 1.5), (2, "Car", 100.0), (3, "House", 400.0), (4, "Movie", 10.0)], "id int, name string, price float")
    make("test_patients", [(int(i), n or None, c, int(a)) for i, n, c, a in (p.split(",") for p in PATIENTS.split())], "id int, name string, city string, age int", "id", "name")
    victim = [*LED, (21, "cs", "f", "prof")]
    two = [*victim, (22, "cs", "f", "prof")]
    make("led_base", LED, DEPT, "id")
    make("led_with_victim", victim, DEPT, "id")
    make("led_with_two_victims", two, DEPT, "id")
    make("led_with_three_cs_women", [*two, (23, "cs", "f", "prof")], DEPT, "id")
    make("led_with_different_titles", [*victim, (22, "cs", "f", "asst")], DEPT, "id")
    make("led_with_star_bucket", [*victim, (22, "biol", "f", "asst"), (23, "chem", "m", "asst"), (24, "biol", "f", "prof")], DEPT, "id")
    base = LED[:16]
    make("star_bucket", [*base, (17, "phys", "m", "prof"), (18, "chem", "f", "asst"), (20, "cs", "f", "prof")], DEPT, "id")
    make("star_bucket_suppressed_1", [*base, (17, "phys", "m", "prof"), (18, "phys", "m", "prof")], DEPT, "id")
    make("star_bucket_suppressed_2", [*base, (17, "chem", "f", "prof"), (18, "phys", "m", "asst")], DEPT, "id")
    make("star_bucket_empty", [], DEPT, "id")
    make("star_bucket_only", [(1, "math", "m", "asst"), (2, "math", "f", "prof"), (3, "phys", "m", "asst"), (4, "cs", "f", "prof"), (5, "history", "f", "asst")], DEPT, "id")
    histo = [(i, str(k)) for i, n in [*((i, 1) for i in range(1, 5)), *((i, 2) for i in range(5, 8)), (8, 6), (9, 7), (10, 13)] for k in range(n)]
    make("test_histogram", histo, "id int, value string", "id")
    dates = spark.sql("SELECT cast(id as int) id, date '2012-05-14' d, timestamp_ntz '2012-05-14' ts, timestamp '2012-05-14 07:00:00+00:00' tz FROM range(1, 8)")
    dates.createOrReplaceTempView("test_datetime")
    catalog.mark_personal("test_datetime", "id")
    spark.sql("SELECT cast(1 as int) id, '' name, '' city, cast(1 as float) discount, date '2000-01-01' birthday, timestamp_ntz '2000-01-01' last_seen, timestamp '2000-01-01' last_seen_tz WHERE false").createOrReplaceTempView("test_validation")
    catalog.mark_personal("test_validation", "id")
    catalog.mark_not_filterable("test_validation", "birthday")
    return catalog


def session(spark, catalog, kind="noiseless", level="anonymized_trusted", **more) -> Session:
    config = Config(salt=known_salt())
    kinds = {
        "noiseless": {"noise_layer_sd": 0.0, "low_count_layer_sd": 0.0, "outlier_count_max": 1, "top_count_max": 3},
        "noisy": {"noise_layer_sd": 7.0, "low_count_layer_sd": 2.0, "low_count_min_threshold": 2},
        "misc": {"low_count_min_threshold": 2, "low_count_layer_sd": 0.0},
        "histogram": {"noise_layer_sd": 0.0, "low_count_layer_sd": 0.0, "low_count_min_threshold": 2},
        "default": {},
    }
    config.set("strict", False)
    for name, value in {**kinds[kind], **more}.items():
        config.set(name, value)
    config.set("session_access_level", level)
    return Session(spark, catalog, config)
