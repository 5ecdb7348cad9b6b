"""Seeded noise in plain SQL for DuckDB: the oracle of anonymous answers over integer identifiers with noise on.

Unsigned 64-bit values are UBIGINT; a product is taken as UHUGEINT and reduced.
"""

from __future__ import annotations

import math

from hushql.config import Config
from hushql.functions.hashing import BASIS, PRIME, fnv


def folded(bytes_: str) -> str:
    """FNV-1a of a list of UBIGINT bytes."""
    step = f"lambda h, b: ((xor(h, b)::UHUGEINT * {PRIME}) % 18446744073709551616)::UBIGINT"
    return f"list_reduce(list_prepend({BASIS}::UBIGINT, {bytes_}), {step})"


def long_hash(value: str) -> str:
    """Of the eight little-endian bytes of a number that isn't negative."""
    return folded("[" + ", ".join(f"(({value})::UBIGINT >> {8 * k}) & 255::UBIGINT" for k in range(8)) + "]")


def text_hash(value: str) -> str:
    """Of an ASCII text; null hashes as NULL."""
    return folded(f"list_transform(string_split(coalesce({value}, 'NULL'), ''), lambda c: ascii(c)::UBIGINT)")


def noise_seed(seed: str, salt: str, step: str) -> str:
    data = f"unhex('{salt.encode().hex()}' || " + " || ".join(f"printf('%02x', (({seed}) >> {8 * k}) & 255::UBIGINT)" for k in range(8)) + ")"
    parts = " | ".join(f"(('0x' || substr(d, {2 * k + 1}, 2))::UBIGINT << {8 * k})" for k in range(8))
    return f"xor(list_transform([sha256({data})], lambda d: {parts})[1], {fnv(step)}::UBIGINT)"


def uniform(seed: str, salt: str, step: str, low: str, high: str) -> str:
    return f"({low} + list_transform([{noise_seed(seed, salt, step)}], lambda s: xor(s >> 32, s) & 4294967295::UBIGINT)[1] % ({high} - {low} + 1))::INTEGER"


def normal(seed: str, salt: str, step: str, sd: str) -> str:
    draw = f"sqrt(-2 * ln(greatest((s & 4294967295::UBIGINT) / 4294967295.0::DOUBLE, {1 / 4294967296.0!r}::DOUBLE))) * sin(2 * pi() * ((s >> 32) / 4294967295.0::DOUBLE))"
    return f"(({sd}) * list_transform([{noise_seed(seed, salt, step)}], lambda s: {draw})[1])"


def reported(sd: str) -> str:
    """A standard deviation as it is told."""
    r = f"(0.05::DOUBLE * ({sd}))"
    power = f"pow(10::DOUBLE, floor(log10({r})))"
    step = f"({power} * CASE WHEN {r} / {power} < 1.5 THEN 1 WHEN {r} / {power} < 3.5 THEN 2 WHEN {r} / {power} < 7.5 THEN 5 ELSE 10 END)"
    return f"{step} * ceil(({sd}) / {step})"


def noisy(source: str, label: str, aid: str | list[str], materials: list[str], constants: list[str], config: Config, summed: str | None = None, grouped: bool = True) -> str:
    """Query of (l0, v, sd): noisy counts of rows, or sums of a column that isn't negative, by a text label.

    Identifiers have 64 bits and aren't null; ``materials`` seed the query and ``constants`` are texts that a filter compares
    with. Low groups go: where the data have two or more, the suppress bin isn't written here.
    """
    c, salt, aids = config, config.salt, [aid] if isinstance(aid, str) else aid
    omin, omax, tmin, tmax = c.outlier_count_min, c.outlier_count_max, c.top_count_min, c.top_count_max
    sql_seed = 0
    for m in set(materials):
        sql_seed ^= fnv(m)
    mean = c.low_count_min_threshold + c.low_count_mean_gap * c.low_count_layer_sd * math.sqrt(2)
    label_set = [*(f"{fnv(t)}::UBIGINT" for t in constants), *([text_hash("l0")] if grouped else [])]
    bucket = f"{sql_seed}::UBIGINT"
    if label_set:
        bucket = f"list_reduce(list_prepend({bucket}, list_distinct([{', '.join(label_set)}])), lambda a, b: xor(a, b))"
    value = f"sum({summed})::DOUBLE" if summed else "count(*)::DOUBLE"
    floor = c.low_count_min_threshold if grouped else 0
    each = " UNION ALL ".join(f"SELECT {label} AS l0, {i} AS inst, {a} AS a, {value} AS v FROM {source} GROUP BY 1, 2, 3" for i, a in enumerate(aids))
    same = lambda x, y: f"{x}.l0 IS NOT DISTINCT FROM {y}.l0 AND {x}.inst = {y}.inst"
    threshold = f"{mean!r}::DOUBLE + {normal('aid_seed', salt, 'suppress', repr(float(c.low_count_layer_sd)) + '::DOUBLE')}"
    # The sum is that of the identifier whose outliers flatten most, the noise that of the one with the largest SD.
    flattest = "list_max(list_append(list({'flat': flat, 'sum': kept}), {'flat': 0::DOUBLE, 'sum': 0::DOUBLE})).sum"
    noisiest = "list_max(list_append(list({'sd': sd, 'size': abs(noise), 'noise': noise}), {'sd': 0::DOUBLE, 'size': 0::DOUBLE, 'noise': 0::DOUBLE}))"
    ctes = [
        f"con AS (SELECT l0, inst, {long_hash('a')} AS h, v FROM ({each}) AS z WHERE a IS NOT NULL)",
        "tot AS (SELECT l0, inst, count(*) AS n, sum(v) AS total, bit_xor(h) AS aid_seed FROM con GROUP BY 1, 2)",
        "ranked AS (SELECT *, row_number() OVER (PARTITION BY l0, inst ORDER BY v DESC, h DESC) AS r FROM con)",
        f"adj AS (SELECT *, greatest(0, {omax + tmax} - n) AS adj FROM tot WHERE n >= {omin + tmin})",
        f"cut AS (SELECT *, CASE WHEN adj // 2 > {omax - omin} THEN {omax - omin} WHEN adj - adj // 2 > {tmax - tmin} THEN adj - {tmax - tmin} ELSE adj // 2 END AS o_cut FROM adj)",
        f"lim AS (SELECT *, {omax} - o_cut AS o, {tmax} - (adj - o_cut) AS t FROM cut)",
        f"flat_seeds AS (SELECT lim.l0, lim.inst, bit_xor(h) AS flat_seed FROM lim JOIN ranked AS k ON {same('lim', 'k')} AND r <= o + t GROUP BY 1, 2)",
        f"drawn AS (SELECT lim.*, {uniform('flat_seed', salt, 'outlier', str(omin), 'o')} AS n_out, {uniform('flat_seed', salt, 'top', str(tmin), 't')} AS n_top FROM lim JOIN flat_seeds AS f ON {same('lim', 'f')})",
        f"tops AS (SELECT d.l0, d.inst, coalesce(sum(v) FILTER (r <= n_out), 0) AS outliers, sum(v) FILTER (r > n_out) / any_value(n_top) AS top_avg FROM drawn AS d JOIN ranked AS k ON {same('d', 'k')} AND r <= n_out + n_top GROUP BY 1, 2)",
        f"flatted AS (SELECT d.*, top_avg, greatest(outliers - top_avg * n_out, 0) AS flat, total - greatest(outliers - top_avg * n_out, 0) AS kept FROM drawn AS d JOIN tops AS t ON {same('d', 't')})",
        f"sds AS (SELECT *, {float(c.noise_layer_sd)!r}::DOUBLE * greatest(kept / n, 0.5::DOUBLE * top_avg) AS sd FROM flatted)",
        f"done AS (SELECT *, {normal(bucket, salt, 'noise', 'sd')} + {normal('aid_seed', salt, 'noise', 'sd')} AS noise, n >= greatest({threshold}, {float(c.low_count_min_threshold)!r}::DOUBLE) AS enough FROM sds)",
        f"best AS (SELECT l0, bool_and(enough) AS enough, {flattest} + {noisiest}.noise AS v, {noisiest}.sd AS sd FROM done GROUP BY 1 HAVING count(*) = {len(aids)})",
    ]
    shown = "v" if summed else f"greatest(round(v), {floor})::BIGINT AS v"
    return f"WITH {', '.join(ctes)} SELECT l0, {shown}, {reported('sd')} AS sd FROM best" + (" WHERE enough" if grouped else "")


def noisy_bins(source: str, aid: str, size: int, config: Config) -> str:
    """Query of (bin, size): the noisy histogram of rows per identifier over a whole table, small bins in one without label."""
    c = config
    mean = c.low_count_min_threshold + c.low_count_mean_gap * c.low_count_layer_sd * math.sqrt(2)
    high = f"n >= greatest({mean!r}::DOUBLE + {normal('seed', c.salt, 'suppress', repr(float(c.low_count_layer_sd)) + '::DOUBLE')}, {float(c.low_count_min_threshold)!r}::DOUBLE)"
    sd = f"{float(c.noise_layer_sd)!r}::DOUBLE"
    noise = f"{normal('0::UBIGINT', c.salt, 'count_histogram', sd)} + {normal('seed', c.salt, 'count_histogram', sd)}"
    ctes = [
        f"per AS (SELECT {long_hash('a')} AS h, n // {size} * {size} AS bin FROM (SELECT {aid} AS a, count(*) AS n FROM {source} WHERE {aid} IS NOT NULL GROUP BY 1) AS z)",
        "bins AS (SELECT bin, count(*) AS n, bit_xor(h) AS seed FROM per GROUP BY 1)",
        f"judged AS (SELECT *, {high} AS high FROM bins)",
        "rest AS (SELECT count(*) AS n_bins, sum(n) AS n, bit_xor(seed) AS seed FROM judged WHERE NOT high)",
        f"every AS (SELECT bin, n, seed FROM judged WHERE high UNION ALL SELECT NULL, n, seed FROM rest WHERE n_bins > 1 AND {high})",
    ]
    return f"WITH {', '.join(ctes)} SELECT bin, greatest(round(n + {noise}), {c.low_count_min_threshold})::BIGINT AS size FROM every"
