"""Seeds and noise as column expressions: FNV-1a and salted SHA-256 over unsigned 64-bit values held in BIGINT."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASIS, PRIME, MASK = 0xCBF29CE484222325, 0x100000001B3, (1 << 64) - 1
#: A drawn zero would make the logarithm infinite; it counts as the least positive draw.
LEAST = 1 / 4294967296.0


def signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def fnv(data: bytes | str) -> int:
    h = BASIS
    for byte in data.encode() if isinstance(data, str) else data:
        h = (h ^ byte) * PRIME & MASK
    return h


# One step on a BIGINT without overflow: the prime is 2**40 + 435, so halves are multiplied apart.
_LO, _HI = "((h ^ b) & 4294967295L)", "shiftrightunsigned(h ^ b, 32)"
_P = f"({_LO} * 435L)"
_Q = f"({_HI} * 435L + shiftrightunsigned({_P}, 32) + shiftleft({_LO}, 8))"
STEP = f"(h, b) -> shiftleft({_Q} & 4294967295L, 32) | ({_P} & 4294967295L)"


def fnv_steps(low: str, high: str, byte: str) -> tuple[str, str]:
    """SQL: low and high half of the hash after one more byte, without a lambda, so that Spark compiles it."""
    x = f"({low} ^ {byte})"
    p = f"({x} * 435L)"
    return f"({p} & 4294967295L)", f"(({high} * 435L + shiftrightunsigned({p}, 32) + shiftleft({x}, 8)) & 4294967295L)"


def with_long_hash(rows: DataFrame, value: str, name: str) -> DataFrame:
    """``rows`` with the hash of the eight little-endian bytes of a BIGINT column, null where that is null.

    Two bytes a projection: each half is read several times, so in one expression the steps would multiply.
    """
    kept, low, high = rows.columns, f"{BASIS & 0xFFFFFFFF}L", f"{BASIS >> 32}L"
    for k in range(0, 8, 2):
        for byte in (k, k + 1):
            low, high = fnv_steps(low, high, f"(shiftrightunsigned({value}, {8 * byte}) & 255L)")
        rows = rows.select(*kept, F.expr(low).alias("low__"), F.expr(high).alias("high__"))
        low, high = "low__", "high__"
    return rows.select(*kept, F.expr("shiftleft(high__, 32) | low__").alias(name))


def fnv_text(sql: str) -> str:
    """SQL: hash of the UTF-8 bytes of a string."""
    code = f"hex(encode({sql}, 'utf-8'))"
    bytes_ = f"transform(filter(sequence(1, length({code})), i -> i % 2 = 1), i -> cast(conv(substring({code}, i, 2), 16, 10) as bigint))"
    return f"if(length({sql}) = 0, {signed(BASIS)}L, aggregate({bytes_}, {signed(BASIS)}L, {STEP}))"


def with_aid_hash(rows: DataFrame, name: str, kinds: list[str]) -> DataFrame:
    """``rows`` with the hash of ``aid``, whose type is that of ``inst``; a 32-bit integer is widened without its sign."""
    texts = [i for i, kind in enumerate(kinds) if kind == "string" or kind.startswith("varchar")]
    numbers = [i for i in range(len(kinds)) if i not in texts]
    if numbers:
        wide = " ".join(f"when {i} then " + ("cast(aid as bigint) & 4294967295L" if kinds[i] == "int" else "cast(aid as bigint)") for i in numbers)
        rows = with_long_hash(rows.withColumn("long__", F.expr(f"case inst {wide} end")), "long__", name).drop("long__")
    if texts:
        other = F.col(name) if numbers else F.lit(None).cast("bigint")
        rows = rows.withColumn(name, F.when(F.col("inst").isin(texts), F.expr(fnv_text("cast(aid as string)"))).otherwise(other))
    return rows


def _swapped(sql: str) -> str:
    return "concat(" + ", ".join(f"substring({sql}, {i}, 2)" for i in range(15, 0, -2)) + ")"


def noise_seed(seed: str, salt: str, step: str) -> str:
    """SQL: first eight bytes, little-endian, of SHA-256(salt, seed), with the step mixed in."""
    data = f"concat(unhex('{salt.encode().hex()}'), unhex({_swapped(f"lpad(hex({seed}), 16, '0')")}))"
    return f"(cast(conv({_swapped(f'substring(sha2({data}, 256), 1, 16)')}, 16, -10) as bigint) ^ {signed(fnv(step))}L)"


def uniform(seed: str, salt: str, step: str, low: str, high: str) -> str:
    """SQL: integer drawn evenly from low to high."""
    s = noise_seed(seed, salt, step)
    return f"element_at(transform(array({s}), s -> cast({low} + ((shiftrightunsigned(s, 32) ^ s) & 4294967295L) % ({high} - {low} + 1) as int)), 1)"


def normal(seed: str, salt: str, step: str, sd: str) -> str:
    """SQL: normal draw by the sine half of the polar transform."""
    s = noise_seed(seed, salt, step)
    return f"element_at(transform(array({s}), s -> ({sd}) * sqrt(-2 * ln(greatest((s & 4294967295L) / 4294967295D, {LEAST!r}D))) * sin(2 * pi() * (shiftrightunsigned(s, 32) / 4294967295D))), 1)"


def threshold(seed: str, config) -> str:
    """SQL: noisy number of entities that a group needs."""
    mean = config.low_count_min_threshold + config.low_count_mean_gap * config.low_count_layer_sd * math.sqrt(2)
    if not config.low_count_layer_sd:
        return f"{float(max(mean, config.low_count_min_threshold))!r}D"
    return f"greatest({mean!r}D + {normal(seed, config.salt, 'suppress', repr(float(config.low_count_layer_sd)) + 'D')}, {float(config.low_count_min_threshold)!r}D)"


def number_text(value: float) -> str:
    """Shortest text that reads back as the number: plain from 1e-4 to below 1e15, else with an exponent."""
    if value == 0 or not math.isfinite(value):
        return {math.inf: "Infinity", -math.inf: "-Infinity"}.get(value, "NaN" if value != value else "0" if math.copysign(1, value) > 0 else "-0")
    digits = repr(float(value))
    if 1e-4 <= abs(value) < 1e15:
        if "e" in digits:
            from decimal import Decimal

            digits = format(Decimal(digits), "f")
        return digits.removesuffix(".0")
    mantissa, _, exponent = f"{float(value):e}".partition("e")
    if "e" in digits:
        mantissa = digits.partition("e")[0].removesuffix(".0")
    else:
        mantissa = digits.replace(".", "").rstrip("0")
        mantissa = mantissa[0] + ("." + mantissa[1:] if len(mantissa) > 1 else "")
    return f"{mantissa}e{exponent[0]}{int(exponent[1:]):02d}"


def label_text(sql: str, kind: str) -> str:
    """SQL: text of a group's label by which it is hashed; null is NULL."""
    if kind in ("tinyint", "smallint", "int", "bigint"):
        out = f"cast({sql} as string)"
    elif kind in ("float", "double") or kind.startswith("decimal"):
        d = f"cast({sql} as double)"
        whole = f"cast(cast({d} as bigint) as string)"
        plain = rf"regexp_replace(cast({d} as string), '\\.0$', '')"
        long_ = rf"regexp_replace(cast(cast({d} as decimal(38, 18)) as string), '\\.?0+$', '')"
        spelled = rf"regexp_replace(regexp_replace(cast({d} as string), '\\.0E', 'E'), 'E(-?)(\\d+)$', 'e$1$2')"
        out = f"case when {d} = 0 then '0' when abs({d}) < 1e15D and {d} = floor({d}) then {whole} when not contains(cast({d} as string), 'E') then {plain} when abs({d}) between 1e-4D and 1e15D then {long_} else {spelled} end"
    elif kind == "boolean":
        out = f"if({sql}, 't', 'f')"
    elif kind == "timestamp":
        out = f"concat(date_format({sql}, \"yyyy-MM-dd'T'HH:mm:ss\"), '+00:00')"
    elif kind == "timestamp_ntz":
        out = f"date_format({sql}, \"yyyy-MM-dd'T'HH:mm:ss\")"
    else:
        out = f"cast({sql} as string)"
    return f"if({sql} is null, 'NULL', {out})"


def label_hash(sql: str, kind: str) -> str:
    return fnv_text(label_text(sql, kind))


def money_round(value: float) -> float:
    """Nearest of 1, 2, 5 times a power of ten."""
    if value <= 1e-10:
        return 1e-10
    power = 10.0 ** math.floor(math.log10(value))
    scaled = value / power
    return power * (1 if scaled < 1.5 else 2 if scaled < 3.5 else 5 if scaled < 7.5 else 10)


def is_money(value: float) -> bool:
    return value > 0 and abs(value - money_round(value)) < 1e-12 * max(1.0, value)


def reported_sd(sd: str) -> Column:
    """Standard deviation as it is told: rounded up to a money-style step of a twentieth."""
    r = f"(0.05D * ({sd}))"
    power = f"pow(10D, floor(log10({r})))"
    step = f"({power} * case when {r} / {power} < 1.5 then 1D when {r} / {power} < 3.5 then 2D when {r} / {power} < 7.5 then 5D else 10D end)"
    return F.expr(f"if(({sd}) = 0, 0D, if({r} <= 1e-10D, 1e-10D * ceil(({sd}) / 1e-10D), {step} * ceil(({sd}) / {step})))")
