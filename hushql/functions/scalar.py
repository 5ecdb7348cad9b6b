"""Scalar functions of the query language as SQL text over Spark built-ins.

Doubles round half to even, decimals half away from zero; a step that isn't positive gives null.
"""

from __future__ import annotations

from pyspark.sql import SparkSession

STEPPED = {"floor_by": "floor", "ceil_by": "ceil", "round_by": "rint"}
ROUNDED = {"floor": "floor", "ceil": "ceil", "ceiling": "ceil"}
#: name: index of the argument that must be a column.
PRIMARY = {
    **dict.fromkeys(STEPPED, 0), **dict.fromkeys(ROUNDED, 0), "round": 0, "width_bucket": 0, "substring": 0, "substr": 0,
    "date_trunc": 1, "extract": 1, "date_part": 1,
}
UNTRUSTED = {"floor_by", "round_by", "floor", "round", "substring", "substr"}


def extract(field: str, sql: str) -> str:
    """A field of a date or time, with those that Spark lacks."""
    year = f"extract(year from {sql})"
    extra = {"century": f"ceil({year} / 100D)", "decade": f"floor({year} / 10D)", "millennium": f"ceil({year} / 1000D)", "epoch": f"unix_timestamp({sql})"}
    return f"cast({extra.get(field) or f'extract({field} from {sql})'} as double)"


def date_trunc(field: str, sql: str, kind: str) -> str:
    year = f"extract(year from {sql})"
    first = {"century": f"(ceil({year} / 100D) - 1) * 100 + 1", "decade": f"floor({year} / 10D) * 10", "millennium": f"(ceil({year} / 1000D) - 1) * 1000 + 1"}.get(field)
    out = f"to_timestamp(make_date(cast({first} as int), 1, 1))" if first else f"date_trunc('{field}', {sql})"
    return f"cast({out} as timestamp_ntz)" if kind == "timestamp_ntz" else out


def call(name: str, args: list[str], kinds: list[str]) -> str:
    """SQL of a generalization; the first kind is that of the column."""
    at = PRIMARY[name]
    value, kind = args[at], kinds[at]
    if name in STEPPED:
        step = args[1]
        if kind.startswith("decimal"):
            fn = {"rint": "round"}.get(STEPPED[name], STEPPED[name])
            return f"if({step} <= 0, null, cast({fn}({value} / {step}) * {step} as {kind}))"
        return f"if({step} <= 0, null, {STEPPED[name]}(cast({value} as double) / {step}) * cast({step} as double))"
    if name in ROUNDED:
        return f"cast({ROUNDED[name]}({value}) as {kind})" if kind in ("double", "float") or kind.startswith("decimal") else f"cast({value} as double)"
    if name == "round":
        if len(args) == 2:
            return f"round({value}, {args[1]})"
        return f"cast(rint({value}) as {kind})" if kind in ("double", "float") else f"round({value})"
    if name in ("substring", "substr"):
        start, size = args[1], args[2] if len(args) > 2 else None
        if size is None:
            return f"substring({value}, greatest({start}, 1))"
        return f"substring({value}, greatest({start}, 1), greatest(0, least({start}, 1) + {size} - 1))"
    if name == "date_trunc":
        return date_trunc(args[0].strip("'").lower(), value, kind)
    if name in ("extract", "date_part"):
        return extract(args[0].strip("'").lower(), value)
    return f"{name}({', '.join(args)})"


def register(spark: SparkSession) -> None:
    """The stepped functions for use over anonymized results, once for each Spark session."""
    if spark.conf.get("spark.hushql.registered", "") == "true":
        return
    spark.conf.set("spark.hushql.registered", "true")
    for name, fn in STEPPED.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(v DOUBLE, k DOUBLE) RETURNS DOUBLE RETURN if(k <= 0, null, {fn}(v / k) * k)")
