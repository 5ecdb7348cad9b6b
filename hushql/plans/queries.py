"""Registered queries over the TPC-H-like tables, and the same answers in plain SQL.

They run with noise off, where answers follow from counts and sums alone; seeded noise is held to known answers in tests.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hushql.config import Config, HushError
from hushql.labels import Catalog, analyze_filterability
from hushql.operators.program import plain_histogram
from hushql.plans.noise_truth import noisy, noisy_bins
from hushql.session import Session
from hushql.sources.tables import load

THRESHOLD = 3


def session(spark: SparkSession, sf_dir: str, sql: str | None = None, **more) -> Session:
    config = Config(salt="public benchmark salt", strict=False, noise_layer_sd=0.0, low_count_layer_sd=0.0, outlier_count_max=1, top_count_max=3, session_access_level="anonymized_trusted", **more)
    return Session(spark, load(spark, sf_dir, sql), config)


@dataclass
class Truth:
    """Plain SQL of an anonymous answer with noise off: labels, identifiers and aggregated columns of a base query.

    An aggregate is (kind, column) with kind rows, value, sum or distinct; distinct is of the only identifier.
    """

    source: str
    labels: list[tuple[str, bool]]
    aids: list[str]
    aggs: list[tuple[str, str]]
    suppress: bool = True
    filtered: bool = True
    merged: bool = False  # with low-effect merges, for three labels or more

    def _merges(self, ls: list[str], legs: list[str]) -> list[str]:
        """con from con0: rows of low groups that one label isolates from a single high group, and another tells nothing of, move there."""
        others = {c: ", ".join(x for x in ls if x != c) for c in ls}
        seen = ", ".join(f"count(*) OVER (PARTITION BY {o}) AS n_{c}, sum(CASE WHEN low THEN 0 ELSE 1 END) OVER (PARTITION BY {o}) AS high_{c}, max(CASE WHEN NOT low THEN {c} END) OVER (PARTITION BY {o}) AS to_{c}" for c, o in others.items())
        isolated = {c: f"(n_{c} = 2 AND high_{c} = 1)" for c in ls}
        moves = " UNION ALL ".join(f"SELECT {', '.join(f's.{x} AS s_{x}' for x in ls)}, {', '.join(f's.to_{x} AS {x}' if x == c else f's.{x} AS {x}' for x in ls)} FROM led AS s WHERE {isolated[c]}" for c in ls)
        pair = " AND ".join(f"con0.{x} IS NOT DISTINCT FROM m.s_{x}" for x in ls)
        rest = f"{', '.join(legs)}"
        return [
            f"low0 AS (SELECT {', '.join(ls)}, sum(CASE WHEN n >= {THRESHOLD} THEN 1 ELSE 0 END) < {len(self.aids)} AS low FROM (SELECT {', '.join(ls)}, inst, count(aid) AS n FROM con0 GROUP BY {', '.join(ls)}, inst) AS z GROUP BY {', '.join(ls)})",
            f"led0 AS (SELECT *, {seen} FROM low0)",
            f"led AS (SELECT * FROM led0 WHERE low AND ({' OR '.join(f'n_{c} = 1' for c in ls)}) AND ({' OR '.join(isolated.values())}))",
            f"moves AS ({moves})",
            f"rerouted AS (SELECT {', '.join(ls)}, inst, aid, {rest} FROM con0 WHERE NOT EXISTS (SELECT 1 FROM moves AS m WHERE {pair}) UNION ALL SELECT {', '.join(f'm.{x}' for x in ls)}, inst, aid, {rest} FROM con0 JOIN moves AS m ON {pair})",
            f"con AS (SELECT {', '.join(ls)}, inst, aid, {', '.join(f'sum({f}) AS {f}' for f in legs)} FROM rerouted GROUP BY {', '.join(ls)}, inst, aid)",
        ]

    def sql(self, select: str, tail: str = "") -> str:
        k, n = len(self.labels), len(self.aids)
        ls = [f"l{i}" for i in range(k)]
        keys = [*ls, "star"]
        cols = [f"{sql} AS l{i}" for i, (sql, _) in enumerate(self.labels)] + [f"{a} AS a{i}" for i, a in enumerate(self.aids)] + [f"{c or 'NULL'} AS x{i}" for i, (_, c) in enumerate(self.aggs)]
        out = [f"base AS (SELECT {', '.join(cols)} FROM {self.source})"]
        xs = [f"x{i}" for i in range(len(self.aggs))]
        some = "coalesce(" + ", ".join(f"CAST(a{i} AS VARCHAR)" for i in range(n)) + ") IS NOT NULL"
        out.append("inst AS (" + " UNION ALL ".join(f"SELECT {', '.join([*ls, *xs])}, {i} AS inst, CAST(a{i} AS VARCHAR) AS aid FROM base WHERE {some}" for i in range(n)) + ")")
        legs, sums = [], []
        for i, (kind, _) in enumerate(self.aggs):
            legs += [f"f{i}p", f"f{i}n"] if kind == "sum" else [f"f{i}"]
            sums += {
                "rows": [f"CAST(count(*) AS DOUBLE) AS f{i}"], "value": [f"CAST(count(x{i}) AS DOUBLE) AS f{i}"], "distinct": [f"CAST(1 AS DOUBLE) AS f{i}"],
                "sum": [f"sum(CASE WHEN x{i} >= 0 THEN CAST(x{i} AS DOUBLE) END) AS f{i}p", f"sum(CASE WHEN x{i} <= 0 THEN -CAST(x{i} AS DOUBLE) END) AS f{i}n"],
            }[kind]
        by = lambda *c: (", ".join(c)) or "1"
        out.append(f"{'con0' if self.merged else 'con'} AS (SELECT {', '.join([*ls, 'inst', 'aid', *sums])} FROM inst GROUP BY {by(*ls, 'inst', 'aid')})")
        if self.merged:
            out += self._merges(ls, legs)
        pair = lambda a, b, c: " AND ".join([f"{a}.{x} IS NOT DISTINCT FROM {b}.{x}" for x in c]) or "true"
        if self.filtered:
            out.append(f"low AS (SELECT {', '.join([*ls, ''])}sum(CASE WHEN n >= {THRESHOLD} THEN 1 ELSE 0 END) < {n} AS low FROM (SELECT {', '.join([*ls, 'inst'])}, count(aid) AS n FROM con GROUP BY {by(*ls, 'inst')}) AS z GROUP BY {by(*ls)})")
            moved = [f"CASE WHEN low.low THEN {repr('*') if text else 'NULL'} ELSE con.l{i} END AS l{i}" for i, (_, text) in enumerate(self.labels)]
            out.append(f"moved AS (SELECT {', '.join([*moved, 'low.low AS star', 'inst', 'aid', *legs])} FROM con JOIN low ON {pair('con', 'low', ls)}" + ("" if self.suppress else " WHERE NOT low.low") + ")")
            out.append(f"keyed AS (SELECT {', '.join([*keys, 'inst', 'aid'])}, {', '.join(f'sum({f}) AS {f}' for f in legs)} FROM moved GROUP BY {by(*keys, 'inst', 'aid')})")
            out.append(f"groups AS (SELECT {', '.join(keys)} FROM (SELECT {', '.join([*keys, 'inst'])}, count(aid) AS n FROM keyed GROUP BY {by(*keys, 'inst')}) AS z GROUP BY {by(*keys)} HAVING sum(CASE WHEN n >= {THRESHOLD} THEN 1 ELSE 0 END) = {n} AND (NOT star OR (SELECT count(*) FROM low WHERE low) > 1))")
        else:
            out.append(f"keyed AS (SELECT false AS star, inst, aid, {', '.join(legs)} FROM con)")
            out.append("groups AS (SELECT false AS star)")
        floor = THRESHOLD if self.filtered else 0
        joins, values = [], []
        for f in legs:
            out.append(f"r{f} AS (SELECT {', '.join([*keys, 'inst', 'aid', f])}, row_number() OVER (PARTITION BY {', '.join([*keys, 'inst', 'aid IS NULL'])} ORDER BY {f} DESC) AS rk FROM keyed WHERE {f} IS NOT NULL)")
            out.append(f"t{f} AS (SELECT {', '.join([*keys, 'inst'])}, sum({f}) FILTER (aid IS NOT NULL) AS total, coalesce(sum({f}) FILTER (aid IS NULL), 0) AS unacc, greatest(max({f}) FILTER (aid IS NOT NULL AND rk = 1) - sum({f}) FILTER (aid IS NOT NULL AND rk BETWEEN 2 AND 4) / 3.0, 0) AS flat FROM r{f} GROUP BY {by(*keys, 'inst')} HAVING count(aid) >= 4)")
            for i in range(n):
                joins.append(f"LEFT JOIN t{f} AS t{f}_{i} ON t{f}_{i}.inst = {i} AND {pair('g', f't{f}_{i}', keys)}")
        best = lambda f: "list_max([{'flat': CAST(0 AS DOUBLE), 'sum': CAST(0 AS DOUBLE)}, " + ", ".join(f"{{'flat': CAST(coalesce(t{f}_{i}.flat, 0) AS DOUBLE), 'sum': CAST(coalesce(t{f}_{i}.total - t{f}_{i}.flat + greatest(t{f}_{i}.unacc - t{f}_{i}.flat, 0), 0) AS DOUBLE)}}" for i in range(n)) + "])"
        lack = lambda f, i: f"t{f}_{i}.total IS NULL"
        for i, (kind, _) in enumerate(self.aggs):
            if kind == "sum":
                null = " OR ".join(f"({lack(f'f{i}p', j)} AND {lack(f'f{i}n', j)})" for j in range(n))
                values.append(f"CASE WHEN {null} THEN NULL ELSE ({best(f'f{i}p')}).sum - ({best(f'f{i}n')}).sum END AS v{i}")
            elif kind == "distinct":
                values.append(f"greatest(coalesce((SELECT count(aid) FROM keyed AS d WHERE {pair('d', 'g', keys)}), 0), {floor}) AS v{i}")
            else:
                values.append(f"CASE WHEN {' OR '.join(lack(f'f{i}', j) for j in range(n))} THEN {floor} ELSE CAST(greatest(round(({best(f'f{i}')}).sum), {floor}) AS BIGINT) END AS v{i}")
        out.append(f"ans AS (SELECT {', '.join([*(f'g.{x}' for x in keys), *values])} FROM groups AS g {' '.join(joins)})")
        return f"WITH {', '.join(out)} SELECT {select} FROM ans {tail}"


def _q(sql: str, truth: str | None, **config) -> tuple[Callable, str | None]:
    return (lambda spark, sf_dir: session(spark, sf_dir, sql, **config).sql(sql)), truth


#: One statement for each rule that refuses, with its message.
REFUSED = [
    ("SELECT o_custkey FROM orders", "Selecting or grouping by an AID column will result in a fully censored output."),
    ("SELECT _metadata FROM orders", "System columns are not allowed in this context."),
    ("SELECT count(*) FROM orders WHERE o_totalprice > 5", "Only equalities are allowed in pre-anonymization filters."),
    ("SELECT count(*) FROM customer WHERE c_custkey = 5", "AID columns can't be referenced by pre-anonymization filters."),
    ("SELECT count(*) FROM customer, orders", "Feature 'CROSS JOIN in anonymizing queries' is not currently supported."),
    ("SELECT count(*) FROM customer JOIN orders ON c_custkey < o_custkey", "Only equalities are allowed in pre-anonymization filters."),
    ("SELECT max(o_totalprice) FROM orders", "Unsupported aggregate in query."),
    ("SELECT sum(DISTINCT o_totalprice) FROM orders", "Unsupported distinct qualifier at aggregate argument."),
    ("SELECT sum(o_totalprice + 1) FROM orders", "Unsupported expression as aggregate argument."),
    ("SELECT count(*) FROM orders GROUP BY CUBE (o_orderstatus)", "Feature 'GROUPING SETS' is not currently supported."),
    ("SELECT count_histogram(o_orderkey) FROM orders", "count_histogram argument must be an AID column."),
    ("SELECT upper(o_orderstatus) FROM orders", "Unsupported function used for generalization."),
    ("SELECT count(*) FROM orders GROUP BY o_totalprice + 1", "Use of operators for generalization is not supported."),
    ("SELECT count(*) FROM customer GROUP BY substring(c_name, c_nationkey)", "Non-primary arguments for a generalization function have to be simple constants."),
    ("SELECT row_number() OVER (ORDER BY o_totalprice) FROM orders", "Feature 'window functions' is not currently supported."),
    ("SELECT DISTINCT o_orderstatus FROM orders", "Feature 'DISTINCT' is not currently supported."),
    ("SELECT count(*), (SELECT 1) FROM orders", "Feature 'SubLinks' is not currently supported."),
    ("SELECT explode(array(1)) FROM orders", "Feature 'SRF functions' is not currently supported."),
    ("SELECT count(*) FROM orders JOIN (SELECT 1 AS k) AS x ON o_custkey = k", "Feature 'Subqueries in anonymizing queries' is not currently supported."),
    ("WITH x AS (SELECT 1 AS k) SELECT count(*) FROM orders", "Feature 'WITH' is not currently supported."),
    ("INSERT INTO orders SELECT * FROM orders", "Feature 'non-select query' is not currently supported."),
    ("FROM orders INSERT OVERWRITE DIRECTORY '/nowhere' USING csv SELECT *", "Feature 'non-select query' is not currently supported."),
    ("SELECT TRANSFORM(o_custkey) USING 'cat' FROM orders", "Statement requires direct access level."),
    ("TABLE orders", "Feature 'reading a personal table outside of SELECT' is not currently supported."),
    ("DROP VIEW orders", "Statement requires direct access level."),
    ("EXPLAIN COST SELECT o_orderstatus FROM orders", "Statement requires direct access level."),
    ("SELECT * FROM region", "Tables without an anonymization label can't be accessed in anonymized mode."),
]


def _message(s: Session, sql: str) -> str:
    try:
        s.sql(sql)
    except HushError as e:
        return str(e)
    return "accepted"


def _refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a trusted analyst is told for each of REFUSED; region has no label here."""
    s = session(spark, sf_dir)
    s.catalog.unmark_table("region")
    return spark.createDataFrame([(i, _message(s, sql)) for i, (sql, _) in enumerate(REFUSED)], "n int, message string")


def _administered(spark: SparkSession, sf_dir: str) -> Catalog:
    """Labels set, changed and taken back."""
    load(spark, sf_dir, "customer, nation, orders")
    catalog = Catalog(spark)
    catalog.mark_personal("customer", "c_custkey", "c_name")
    catalog.mark_personal("customer", "c_custkey")
    catalog.mark_public("nation")
    catalog.mark_personal("orders", "o_custkey")
    catalog.unmark_table("orders")
    for column in ("c_acctbal", "c_name"):
        catalog.mark_not_filterable("customer", column)
    catalog.mark_filterable("customer", "c_name")
    for role, level in (("analyst", "anonymized_untrusted"), ("gone", "direct")):
        catalog.mark_role(role, level)
    catalog.unmark_role("gone")
    return catalog


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _administered(spark, sf_dir).show()


def _roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each role's level, and whether it may group by a step that isn't a round number."""
    catalog = _administered(spark, sf_dir)
    catalog.mark_role("auditor", "anonymized_trusted")
    catalog.mark_role("owner", "direct")
    rows = []
    for role in ("analyst", "auditor", "owner"):
        s = Session(spark, catalog, Config(), role=role)
        rows.append((role, s.access_level(), _message(s, "SELECT floor_by(c_acctbal, 37) AS b, count(*) AS n FROM customer GROUP BY 1") == "accepted"))
    return spark.createDataFrame(rows, "role string, level string, may_generalize boolean")


def _explained(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The plan of an anonymizing query by EXPLAIN: operators, no sizes or counts of rows."""
    plan = session(spark, sf_dir, "customer").sql("EXPLAIN FORMATTED SELECT c_mktsegment, count(*) FROM customer GROUP BY 1")
    return plan.selectExpr("plan LIKE '%Aggregate%' AS plan", "plan LIKE '%sizeInBytes%' OR plan LIKE '%rowCount%' AS figures")


def _sticky(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two sessions over one catalog, with the salt that it made, give the same noise."""
    catalog = load(spark, sf_dir, "orders")
    sql = "SELECT o_orderstatus AS s, count(*) AS n, sum(o_totalprice) AS t FROM orders GROUP BY 1"
    one, two = (Session(spark, catalog, Config(session_access_level="anonymized_trusted")).sql(sql) for _ in range(2))
    both = one.join(two.toDF("s2", "n2", "t2"), F.col("s").eqNullSafe(F.col("s2")), "full")
    return both.agg(F.min((F.col("n") == F.col("n2")) & (F.abs(F.col("t") - F.col("t2")) < 1)).alias("same"))


def _noisy_average() -> tuple[Callable, str]:
    sql = "SELECT o_orderstatus, round(avg(o_totalprice), 2) AS mean, round(avg_noise(o_totalprice), 3) AS sd FROM orders GROUP BY 1"
    base = ("orders", "o_orderstatus", "o_custkey", ["orders.o_orderstatus"], [], _noisy_config())
    truth = f"SELECT s.l0 AS o_orderstatus, round(s.v / n.v, 2) AS mean, round(s.sd / n.v, 3) AS sd FROM ({noisy(*base, summed='o_totalprice')}) AS s JOIN ({noisy(*base)}) AS n ON s.l0 IS NOT DISTINCT FROM n.l0"
    return (lambda spark, sf_dir: Session(spark, load(spark, sf_dir, sql), _noisy_config()).sql(sql)), truth


def _noisy_histogram() -> tuple[Callable, str]:
    sql = "SELECT b[0] AS bin, b[1] AS size FROM (SELECT unnest_histogram(h) AS b FROM (SELECT count_histogram(o_custkey, 2) AS h FROM orders) AS x) AS y"
    return (lambda spark, sf_dir: Session(spark, load(spark, sf_dir, sql), _noisy_config()).sql(sql)), noisy_bins("orders", "o_custkey", 2, _noisy_config())


def _direct(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    return Session(spark, load(spark, sf_dir, sql), Config(salt="public benchmark salt")).sql(sql)


def _noisy_config() -> Config:
    return Config(salt="public benchmark salt", session_access_level="anonymized_trusted")


def _noisy_q(sql: str, select: str, truth: tuple, **more) -> tuple[Callable, str]:
    """A query with noise on, and its seeds, draws and noise in plain SQL."""
    return (lambda spark, sf_dir: Session(spark, load(spark, sf_dir, sql), _noisy_config()).sql(sql)), f"{select} FROM ({noisy(*truth, _noisy_config(), **more)}) AS z"


def _histogram_truth(source: str, label: str, aid: str, size: int, select: str) -> str:
    """Bins of rows per identifier with noise off: small bins share one without label if it is no small bin itself."""
    return (
        f"WITH per AS (SELECT {label} AS l, count(*) AS n FROM {source} WHERE {aid} IS NOT NULL GROUP BY {label}, {aid}), bins AS (SELECT l, n // {size} * {size} AS bin, count(*) AS size FROM per GROUP BY 1, 2), "
        f"ok AS (SELECT l FROM per GROUP BY l HAVING count(*) >= {THRESHOLD} OR l IS NULL), "
        f"every AS (SELECT l, bin, size FROM bins WHERE size >= {THRESHOLD} UNION ALL SELECT l, NULL, sum(size) FROM bins WHERE size < {THRESHOLD} GROUP BY l HAVING count(*) > 1 AND sum(size) >= {THRESHOLD}) "
        f"SELECT {select} FROM (SELECT every.l, bin, CAST(size AS BIGINT) AS size FROM every JOIN ok ON every.l IS NOT DISTINCT FROM ok.l) AS z"
    )


_SEG, _STATUS = ("c_mktsegment", True), ("o_orderstatus", True)
_LINE = ["l_suppkey", "l_partkey"]
#: Zero may be a group's label with either sign in DuckDB; Spark groups it as positive.
_UNSIGNED = "CASE WHEN l0 = 0 THEN CAST(0 AS DOUBLE) ELSE l0 END"
_EVENT = ("event_type", True)
_CO = "orders JOIN customer ON o_custkey = c_custkey"
_JOIN = "SELECT {} FROM orders JOIN customer ON o_custkey = c_custkey"
_TWO = [("l_returnflag", True), ("l_linestatus", True)]
_FEW = [("o_orderpriority", True), ("date_trunc('month', o_orderdate)", False)]


def _registry() -> dict[str, tuple[Callable, str | None]]:
    one = lambda source, label, aid, *aggs, **k: Truth(source, [label] if label else [], [aid], list(aggs), filtered=bool(label), **k)
    customers = one("customer", _SEG, "c_custkey", ("rows", ""))
    out = {
        "count_star_grouped": _q("SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1", customers.sql("l0 AS c_mktsegment, v0 AS n")),
        "count_star_global": _q("SELECT count(*) AS n FROM orders", one("orders", None, "o_custkey", ("rows", "")).sql("v0 AS n")),
        "count_star_orders_by_status": _q(
            "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1",
            one("orders", _STATUS, "o_custkey", ("rows", "")).sql("l0 AS o_orderstatus, v0 AS n"),
        ),
        "count_column": _q(
            "SELECT event_type, count(value) AS n FROM events GROUP BY 1",
            one("events", _EVENT, "user_id", ("value", "value")).sql("l0 AS event_type, v0 AS n"),
        ),
        "count_distinct_aid": _q(
            "SELECT event_type, count(DISTINCT user_id) AS n FROM events GROUP BY 1",
            one("events", _EVENT, "user_id", ("distinct", "")).sql("l0 AS event_type, v0 AS n"),
        ),
        "count_distinct_values": _q(
            "SELECT count(DISTINCT o_orderpriority) AS n FROM orders",
            "SELECT count(*) AS n FROM (SELECT o_orderpriority FROM orders GROUP BY 1 HAVING count(DISTINCT o_custkey) >= 3) AS z",
        ),
        "sum_double": _q(
            "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1",
            one("orders", _STATUS, "o_custkey", ("sum", "o_totalprice")).sql("l0 AS o_orderstatus, round(v0, 2) AS total"),
        ),
        "sum_mixed_sign": _q(
            "SELECT c_mktsegment, round(sum(c_acctbal), 2) AS total FROM customer GROUP BY 1",
            one("customer", _SEG, "c_custkey", ("sum", "c_acctbal")).sql("l0 AS c_mktsegment, round(v0, 2) AS total"),
        ),
        "sum_int": _q(
            "SELECT sum(c_nationkey) AS total FROM customer",
            one("customer", None, "c_custkey", ("sum", "c_nationkey")).sql("CAST(round(v0) AS BIGINT) AS total"),
        ),
        "avg_column": _q(
            "SELECT o_orderstatus, round(avg(o_totalprice), 2) AS mean FROM orders GROUP BY 1",
            one("orders", _STATUS, "o_custkey", ("sum", "o_totalprice"), ("value", "o_totalprice")).sql(
                "l0 AS o_orderstatus, round(v0 / v1, 2) AS mean",
            ),
        ),
        "noise_functions": _q(
            "SELECT c_mktsegment, count_noise(*) AS a, sum_noise(c_acctbal) AS b, avg_noise(c_acctbal) AS c FROM customer"
            " GROUP BY 1",
            customers.sql("l0 AS c_mktsegment, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, CAST(0 AS DOUBLE) AS c"),
        ),
        "implicit_group_expand": _q(
            "SELECT n_name, c_mktsegment FROM customer JOIN nation ON c_nationkey = n_nationkey",
            Truth("customer JOIN nation ON c_nationkey = n_nationkey", [("n_name", True), _SEG], ["c_custkey"], [("rows", "")]).sql(
                "l0 AS n_name, l1 AS c_mktsegment",
                "CROSS JOIN unnest(range(v0)) AS e(i)",
            ),
        ),
        "constant_target": _q(
            "SELECT 1 AS one, c_mktsegment, count(*) AS n FROM customer GROUP BY 2",
            customers.sql("CAST(1 AS INTEGER) AS one, l0 AS c_mktsegment, v0 AS n"),
        ),
        "group_without_aggregate": _q(
            "SELECT c_nationkey FROM customer GROUP BY 1",
            one("customer", ("c_nationkey", False), "c_custkey", ("rows", "")).sql("l0 AS c_nationkey"),
        ),
        "floor_by": _q(
            "SELECT floor_by(c_acctbal, 1000) AS band, count(*) AS n FROM customer GROUP BY 1",
            one("customer", ("floor(c_acctbal / 1000) * CAST(1000 AS DOUBLE)", False), "c_custkey", ("rows", "")).sql(
                "l0 AS band, v0 AS n",
            ),
        ),
        "ceil_by": _q(
            "SELECT ceil_by(c_acctbal, 2000) AS band, count(*) AS n FROM customer GROUP BY 1",
            one("customer", ("ceil(c_acctbal / 2000) * CAST(2000 AS DOUBLE)", False), "c_custkey", ("rows", "")).sql(
                f"{_UNSIGNED} AS band, v0 AS n",
            ),
        ),
        "round_by": _q(
            "SELECT round_by(c_acctbal, 500) AS band, count(*) AS n FROM customer GROUP BY 1",
            one("customer", ("round_even(c_acctbal / 500, 0) * CAST(500 AS DOUBLE)", False), "c_custkey", ("rows", "")).sql(
                f"{_UNSIGNED} AS band, v0 AS n",
            ),
        ),
        "width_bucket": _q(
            "SELECT width_bucket(c_acctbal, -1000, 10000, 11) AS b, count(*) AS n FROM customer GROUP BY 1",
            one(
                "customer",
                (
                    (
                        "CAST(CASE WHEN c_acctbal < -1000 THEN 0 WHEN c_acctbal >= 10000 THEN 12 ELSE floor((c_acctbal + 1000) / 1000) +"
                        " 1 END AS BIGINT)"
                    ),
                    False,
                ),
                "c_custkey",
                ("rows", ""),
            ).sql(
                "l0 AS b, v0 AS n",
            ),
        ),
        "substring": _q(
            "SELECT substring(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders GROUP BY 1",
            one("orders", ("substring(o_orderpriority, 1, 1)", True), "o_custkey", ("rows", "")).sql("l0 AS p, v0 AS n"),
        ),
        "extract_year": _q(
            "SELECT cast(extract(year from o_orderdate) as int) AS y, count(*) AS n FROM orders GROUP BY 1",
            one("orders", ("CAST(extract(year from o_orderdate) AS INTEGER)", False), "o_custkey", ("rows", "")).sql(
                "l0 AS y, v0 AS n",
            ),
        ),
        "extract_century": _q(
            "SELECT cast(extract(century from o_orderdate) as int) AS c, count(*) AS n FROM orders GROUP BY 1",
            one("orders", ("CAST(extract(century from o_orderdate) AS INTEGER)", False), "o_custkey", ("rows", "")).sql(
                "l0 AS c, v0 AS n",
            ),
        ),
        "rounding_cast": _q(
            "SELECT cast(l_quantity AS int) AS q, count(*) AS n FROM lineitem GROUP BY 1",
            Truth("lineitem", [("CAST(round_even(l_quantity, 0) AS INTEGER)", False)], _LINE, [("rows", "")]).sql(
                "l0 AS q, v0 AS n",
            ),
        ),
        "where_equality": _q(
            "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'",
            one("orders WHERE o_orderstatus = 'F' AND o_orderpriority = '1-URGENT'", None, "o_custkey", ("rows", "")).sql(
                "v0 AS n",
            ),
        ),
        "where_generalized": _q(
            "SELECT o_orderstatus, count(*) AS n FROM orders WHERE substring(o_orderpriority, 1, 1) = '2' GROUP BY 1",
            one("orders WHERE o_orderpriority LIKE '2%'", _STATUS, "o_custkey", ("rows", "")).sql("l0 AS o_orderstatus, v0 AS n"),
        ),
        "where_never": _q("SELECT count(*) AS n FROM orders WHERE 1 = 0", "SELECT count(*) AS n FROM orders WHERE false"),
        "having": _q(
            "SELECT c_nationkey, count(*) AS n FROM customer GROUP BY 1 HAVING count(*) > 60",
            one("customer", ("c_nationkey", False), "c_custkey", ("rows", "")).sql("l0 AS c_nationkey, v0 AS n", "WHERE v0 > 60"),
        ),
        "join_two_identifiers": _q(
            _JOIN.format("c_mktsegment, count(*) AS n") + " GROUP BY 1",
            Truth(_CO, [_SEG], ["o_custkey", "c_custkey"], [("rows", "")]).sql("l0 AS c_mktsegment, v0 AS n"),
        ),
        "left_join_public": _q(
            "SELECT n_name, count(*) AS n FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
            one("customer LEFT JOIN nation ON c_nationkey = n_nationkey", ("n_name", True), "c_custkey", ("rows", "")).sql(
                "l0 AS n_name, v0 AS n",
            ),
        ),
        "multi_aid_count": _q(
            "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY 1, 2",
            Truth("lineitem", _TWO, _LINE, [("rows", "")]).sql("l0 AS l_returnflag, l1 AS l_linestatus, v0 AS n"),
        ),
        "multi_aid_sum": _q(
            "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS total FROM lineitem GROUP BY 1",
            Truth("lineitem", _TWO[:1], _LINE, [("sum", "l_extendedprice")]).sql("l0 AS l_returnflag, round(v0, 2) AS total"),
        ),
        "suppress_bin": _q(
            "SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, count(*) AS n FROM orders GROUP BY 1, 2",
            Truth("orders", _FEW, ["o_custkey"], [("rows", "")]).sql("l0 AS o_orderpriority, CAST(l1 AS TIMESTAMP) AS m, v0 AS n"),
        ),
        "suppress_bin_off": _q(
            "SELECT o_orderpriority, date_trunc('week', o_orderdate) AS w, count(*) AS n FROM orders GROUP BY 1, 2",
            Truth(
                "orders",
                [("o_orderpriority", True), ("date_trunc('week', o_orderdate)", False)],
                ["o_custkey"],
                [("rows", "")],
                suppress=False,
            ).sql(
                "l0 AS o_orderpriority, CAST(l1 AS TIMESTAMP) AS w, v0 AS n",
            ),
            compute_suppress_bin=False,
        ),
        "is_suppress_bin": _q(
            "SELECT c_name, is_suppress_bin(*) AS b, count(*) AS n FROM customer GROUP BY 1",
            one("customer", ("c_name", True), "c_custkey", ("rows", "")).sql("l0 AS c_name, star AS b, v0 AS n"),
        ),
        "union_of_answers": _q(
            "SELECT c_mktsegment AS x FROM customer GROUP BY 1 UNION SELECT o_orderstatus FROM orders GROUP BY 1",
            "SELECT c_mktsegment AS x FROM customer GROUP BY 1 UNION SELECT o_orderstatus FROM orders GROUP BY 1",
        ),
        "except_of_answers": _q(
            "SELECT c_nationkey FROM customer GROUP BY 1 EXCEPT SELECT s_nationkey FROM supplier GROUP BY 1",
            "SELECT c_nationkey FROM customer GROUP BY 1 HAVING count(*) >= 3 EXCEPT SELECT s_nationkey FROM supplier GROUP"
            " BY 1 HAVING count(*) >= 3",
        ),
        "full_outer_of_answers": _q(
            "SELECT a.s, a.n AS n, b.n AS m FROM (SELECT c_nationkey AS s, count(*) AS n FROM customer GROUP BY 1) a FULL"
            " OUTER JOIN (SELECT s_nationkey AS s, count(*) AS n FROM supplier GROUP BY 1) b ON a.s = b.s",
            "SELECT a.s, a.n AS n, b.n AS m FROM (" + one("customer", ("c_nationkey", False), "c_custkey", ("rows", "")).sql("l0 AS s, v0 AS n") + ") a FULL OUTER JOIN (" + one("supplier", ("s_nationkey", False), "s_suppkey", ("rows", "")).sql("l0 AS s, v0 AS n") + ") b ON a.s = b.s",
        ),
        "cte_over_answer": _q(
            "WITH c AS (SELECT c_mktsegment AS s, count(*) AS n FROM customer GROUP BY 1) SELECT max(n) AS most, count(*) AS"
            " groups FROM c",
            "SELECT max(n) AS most, count(*) AS groups FROM (" + customers.sql("l0 AS s, v0 AS n") + ") AS c",
        ),
        "order_limit": _q(
            "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2",
            customers.sql("l0 AS c_mktsegment, v0 AS n", "ORDER BY v0 DESC, l0 LIMIT 2"),
        ),
        "unrestricted_public": _q(
            "SELECT p_brand, max(p_retailprice) AS top FROM part WHERE p_size > 10 OR p_brand LIKE '%1' GROUP BY 1",
            "SELECT p_brand, max(p_retailprice) AS top FROM part WHERE p_size > 10 OR p_brand LIKE '%1' GROUP BY 1",
        ),
        "parameters": (
            lambda spark, sf_dir: session(spark, sf_dir).sql("SELECT count(*) AS n FROM orders WHERE o_orderstatus = :s", {"s": "O"}),
            one("orders WHERE o_orderstatus = 'O'", None, "o_custkey", ("rows", "")).sql("v0 AS n"),
        ),
        "led_merge": _q(
            "SELECT c_nationkey, c_mktsegment, floor_by(c_acctbal, 5000) AS band, count(*) AS n FROM customer GROUP BY 1, 2, 3",
            Truth(
                "customer",
                [("c_nationkey", False), _SEG, ("floor(c_acctbal / 5000) * CAST(5000 AS DOUBLE)", False)],
                ["c_custkey"],
                [("rows", "")],
                merged=True,
            ).sql(
                "l0 AS c_nationkey, l1 AS c_mktsegment, l2 AS band, v0 AS n",
            ),
        ),
        "led_merge_sum": _q(
            "SELECT o_orderstatus, o_orderpriority, date_trunc('quarter', o_orderdate) AS q, round(sum(o_totalprice), 2) AS"
            " total FROM orders GROUP BY 1, 2, 3",
            Truth(
                "orders",
                [_STATUS, ("o_orderpriority", True), ("date_trunc('quarter', o_orderdate)", False)],
                ["o_custkey"],
                [("sum", "o_totalprice")],
                merged=True,
            ).sql(
                "l0 AS o_orderstatus, l1 AS o_orderpriority, CAST(l2 AS TIMESTAMP) AS q, round(v0, 2) AS total",
            ),
        ),
        "count_histogram": _q(
            "SELECT b[0] AS bin, b[1] AS size FROM (SELECT unnest_histogram(h) AS b FROM (SELECT count_histogram(o_custkey,"
            " 5) AS h FROM orders) AS x) AS y",
            _histogram_truth("orders", "NULL", "o_custkey", 5, "bin, size"),
        ),
        "count_histogram_grouped": _q(
            "SELECT event_type, b[0] AS bin, b[1] AS size FROM (SELECT event_type, unnest_histogram(h) AS b FROM (SELECT"
            " event_type, count_histogram(user_id) AS h FROM events GROUP BY 1) AS x) AS y",
            _histogram_truth("events", "event_type", "user_id", 1, "l AS event_type, bin, size"),
        ),
        "direct_histogram": (
            lambda spark, sf_dir: _direct(
                spark,
                sf_dir,
                "SELECT event_type, b[0] AS bin, b[1] AS size FROM (SELECT event_type, unnest_histogram(h) AS b FROM (SELECT"
                " event_type, count_histogram(user_id, 2) AS h FROM events GROUP BY 1) AS x) AS y",
            ),
            (
                "SELECT event_type, n // 2 * 2 AS bin, count(*) AS size FROM (SELECT event_type, user_id, count(*) AS n FROM"
                " events WHERE user_id IS NOT NULL GROUP BY 1, 2) AS z GROUP BY 1, 2"
            ),
        ),
        "direct_noise": (
            lambda spark, sf_dir: _direct(
                spark,
                sf_dir,
                "SELECT o_orderstatus, count(*) AS n, count_noise(*) AS a, sum_noise(o_totalprice) AS b, is_suppress_bin(*) AS c"
                " FROM orders GROUP BY 1",
            ),
            (
                "SELECT o_orderstatus, count(*) AS n, CAST(0 AS DOUBLE) AS a, CAST(0 AS DOUBLE) AS b, false AS c FROM orders"
                " GROUP BY 1"
            ),
        ),
        "plain_histogram": (
            lambda spark, sf_dir: plain_histogram(spark.read.parquet(f"{sf_dir}/orders.parquet"), [], "o_custkey", 5).selectExpr("explode(histogram) AS b").selectExpr(
                "b[0] AS bin",
                "b[1] AS size",
            ),
            (
                "SELECT n // 5 * 5 AS bin, count(*) AS size FROM (SELECT count(*) AS n FROM orders WHERE o_custkey IS NOT NULL"
                " GROUP BY o_custkey) AS z GROUP BY 1"
            ),
        ),
        "filterability": (
            lambda spark, sf_dir: analyze_filterability(spark.read.parquet(f"{sf_dir}/events.parquet"), 0.1).selectExpr(
                "column",
                "round(share, 6) AS share",
            ),
            " UNION ALL ".join(
                (f"SELECT '{c}' AS \"column\", round(max(n) / sum(n), 6) AS share FROM (SELECT count(*) AS n FROM events GROUP BY {c}) AS z HAVING max(n) / sum(n) >= 0.1" for c in ("event_id", "ts", "user_id", "event_type", "value", "props")),
            ),
        ),
        "floor_function": _q(
            "SELECT floor(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY 1",
            Truth("lineitem", [("floor(l_quantity)", False)], _LINE, [("rows", "")]).sql("l0 AS q, v0 AS n"),
        ),
        "ceil_function": _q(
            "SELECT ceil(l_tax) AS t, count(*) AS n FROM lineitem GROUP BY 1",
            Truth("lineitem", [("ceil(l_tax)", False)], _LINE, [("rows", "")]).sql("l0 AS t, v0 AS n"),
        ),
        "round_function": _q(
            "SELECT round(value) AS v, count(*) AS n FROM events GROUP BY 1",
            one("events", ("round_even(value, 0)", False), "user_id", ("rows", "")).sql(f"{_UNSIGNED} AS v, v0 AS n"),
        ),
        "transparent_cast": _q(
            "SELECT floor_by(cast(c_nationkey AS double), 5) AS band, count(*) AS n FROM customer GROUP BY 1",
            one("customer", ("floor(c_nationkey / 5) * CAST(5 AS DOUBLE)", False), "c_custkey", ("rows", "")).sql(
                "l0 AS band, v0 AS n",
            ),
        ),
        "datetime_text": _q(
            "SELECT substring(cast(o_orderdate AS string), 1, 7) AS m, count(*) AS n FROM orders GROUP BY 1",
            one("orders", ("strftime(o_orderdate, '%Y-%m')", True), "o_custkey", ("rows", "")).sql("l0 AS m, v0 AS n"),
        ),
        "date_trunc_decade": _q(
            "SELECT date_trunc('decade', o_orderdate) AS d, count(*) AS n FROM orders GROUP BY 1",
            one("orders", ("date_trunc('decade', o_orderdate)", False), "o_custkey", ("rows", "")).sql(
                "CAST(l0 AS TIMESTAMP) AS d, v0 AS n",
            ),
        ),
        "extract_decade": _q(
            "SELECT cast(extract(decade from o_orderdate) as int) AS d, cast(extract(millennium from o_orderdate) as int) AS"
            " k, count(*) AS n FROM orders GROUP BY 1, 2",
            Truth(
                "orders",
                [
                    ("CAST(extract(decade from o_orderdate) AS INTEGER)", False),
                    ("CAST(extract(millennium from o_orderdate) AS INTEGER)", False),
                ],
                ["o_custkey"],
                [("rows", "")],
            ).sql(
                "l0 AS d, l1 AS k, v0 AS n",
            ),
        ),
        "right_join": _q(
            "SELECT n_name, count(*) AS n FROM supplier RIGHT JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
            one("supplier RIGHT JOIN nation ON s_nationkey = n_nationkey", ("n_name", True), "s_suppkey", ("rows", "")).sql(
                "l0 AS n_name, v0 AS n",
            ),
        ),
        "full_join": _q(
            "SELECT c_mktsegment, count(*) AS n FROM orders FULL JOIN customer ON o_custkey = c_custkey GROUP BY 1",
            Truth("orders FULL JOIN customer ON o_custkey = c_custkey", [_SEG], ["o_custkey", "c_custkey"], [("rows", "")]).sql(
                "l0 AS c_mktsegment, v0 AS n",
            ),
        ),
        "join_using": _q(
            "SELECT a.o_orderstatus AS s, count(*) AS n FROM orders AS a JOIN orders AS b USING (o_orderkey) GROUP BY 1",
            Truth(
                "orders AS a JOIN orders AS b ON a.o_orderkey = b.o_orderkey",
                [("a.o_orderstatus", True)],
                ["a.o_custkey", "b.o_custkey"],
                [("rows", "")],
            ).sql(
                "l0 AS s, v0 AS n",
            ),
        ),
        "join_order": _q(
            "SELECT c_mktsegment, count(*) AS n FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1",
            Truth(_CO, [_SEG], ["o_custkey", "c_custkey"], [("rows", "")]).sql("l0 AS c_mktsegment, v0 AS n"),
        ),
        "access_level": _q(
            "SELECT access_level() AS level, 'access_level()' AS name",
            "SELECT 'anonymized_trusted' AS level, 'access_level()' AS name",
        ),
        "show_labels": _q(
            "SELECT objtype, objname, label FROM show_labels() WHERE objname LIKE 'lineitem%'",
            "SELECT 'table' AS objtype, 'lineitem' AS objname, 'personal' AS label UNION ALL SELECT 'column',"
            " 'lineitem.l_suppkey', 'aid' UNION ALL SELECT 'column', 'lineitem.l_partkey', 'aid'",
        ),
        "show_settings": _q(
            "SELECT name, setting FROM show_settings() WHERE name LIKE '%count_m%'",
            "SELECT * FROM (VALUES ('low_count_mean_gap', '2.0'), ('low_count_min_threshold', '3'), ('outlier_count_max',"
            " '1'), ('outlier_count_min', '1'), ('top_count_max', '3'), ('top_count_min', '3')) AS t(name, setting)",
        ),
        "shared_state": _q(
            "SELECT c_mktsegment, count(*) AS n, 2 * count(*) AS twice, count(c_name) AS named FROM customer GROUP BY 1"
            " HAVING count(*) + count(*) > 3",
            one("customer", _SEG, "c_custkey", ("rows", ""), ("value", "c_name")).sql(
                "l0 AS c_mktsegment, v0 AS n, 2 * v0 AS twice, v1 AS named",
                "WHERE 2 * v0 > 3",
            ),
        ),
        "refusals": (
            _refusals,
            " UNION ALL ".join(
                (f"SELECT {i} AS n, '{message.replace(chr(39), chr(39) * 2)}' AS message" for i, (_, message) in enumerate(REFUSED)),
            ),
        ),
        "label_administration": (
            _labelled,
            (
                "SELECT * FROM (VALUES ('table', 'customer', 'personal'), ('table', 'nation', 'public'), ('column',"
                " 'customer.c_custkey', 'aid'), ('column', 'customer.c_acctbal', 'not_filterable'), ('role', 'analyst',"
                " 'anonymized_untrusted')) AS t(objtype, objname, label)"
            ),
        ),
        "access_of_roles": (
            _roles,
            (
                "SELECT * FROM (VALUES ('analyst', 'anonymized_untrusted', false), ('auditor', 'anonymized_trusted', true),"
                " ('owner', 'direct', true)) AS t(role, level, may_generalize)"
            ),
        ),
        "explain_without_figures": (_explained, "SELECT true AS plan, false AS figures"),
        "describe_columns": _q(
            "DESCRIBE nation",
            "SELECT * FROM (VALUES ('n_nationkey', 'int', CAST(NULL AS VARCHAR)), ('n_name', 'string', NULL), ('n_regionkey',"
            " 'int', NULL)) AS t(col_name, data_type, comment)",
        ),
        "sticky_noise": (_sticky, "SELECT true AS same"),
        "noisy_join": _noisy_q(
            "SELECT n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
            "SELECT l0 AS n_name, v AS n",
            ("customer JOIN nation ON c_nationkey = n_nationkey", "n_name", "c_custkey", ["nation.n_name"], []),
        ),
        "noisy_average": _noisy_average(),
        "noisy_histogram": _noisy_histogram(),
        "noisy_two_identifiers": _noisy_q(
            "SELECT l_returnflag, count(*) AS n, round(count_noise(*), 6) AS sd FROM lineitem GROUP BY 1",
            "SELECT l0 AS l_returnflag, v AS n, round(sd, 6) AS sd",
            ("lineitem", "l_returnflag", _LINE, ["lineitem.l_returnflag"], []),
        ),
        "noisy_joined_identifiers": _noisy_q(
            "SELECT c_mktsegment, round(sum(o_totalprice), 1) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1",
            "SELECT l0 AS c_mktsegment, round(v, 1) AS total",
            (_CO, "c_mktsegment", ["o_custkey", "c_custkey"], ["customer.c_mktsegment"], []),
            summed="o_totalprice",
        ),
        "noisy_counts": _noisy_q(
            "SELECT c_mktsegment, count(*) AS n, count_noise(*) AS sd FROM customer GROUP BY 1",
            "SELECT l0 AS c_mktsegment, v AS n, sd",
            ("customer", "c_mktsegment", "c_custkey", ["customer.c_mktsegment"], []),
        ),
        "noisy_contributions": _noisy_q(
            "SELECT o_orderstatus, count(*) AS n, round(count_noise(*), 6) AS sd FROM orders GROUP BY 1",
            "SELECT l0 AS o_orderstatus, v AS n, round(sd, 6) AS sd",
            ("orders", "o_orderstatus", "o_custkey", ["orders.o_orderstatus"], []),
        ),
        "noisy_sums": _noisy_q(
            "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, round(sum_noise(o_totalprice), 3) AS sd FROM orders"
            " GROUP BY 1",
            "SELECT l0 AS o_orderstatus, round(v, 2) AS total, round(sd, 3) AS sd",
            ("orders", "o_orderstatus", "o_custkey", ["orders.o_orderstatus"], []),
            summed="o_totalprice",
        ),
        "noisy_filter_seed": _noisy_q(
            "SELECT count(*) AS n FROM orders WHERE o_orderstatus = 'O'",
            "SELECT v AS n",
            ("orders WHERE o_orderstatus = 'O'", "NULL", "o_custkey", ["orders.o_orderstatus"], ["O"]),
            grouped=False,
        ),
        "noisy_generalized": _noisy_q(
            "SELECT substring(o_orderpriority, 1, 1) AS p, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1",
            "SELECT l0 AS p, v AS n",
            (
                "orders WHERE o_orderstatus = 'F'",
                "substr(o_orderpriority, 1, 1)",
                "o_custkey",
                ["substring,orders.o_orderpriority,1,1", "orders.o_orderstatus"],
                ["F"],
            ),
        ),
    }

    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for name, (query, _) in _registry().items()}


def oracle_sql() -> dict[str, str]:
    return {name: truth for name, (_, truth) in _registry().items() if truth}
