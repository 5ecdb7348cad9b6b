"""The relational program of one anonymizing query: contributions, low-count filter, merges, suppress bin, noise.

All state is the relation (group, identifier instance, identifier) -> contributions. Merging groups is re-keying those
rows and summing again, so every step is a join, a window or an aggregate that Spark distributes and can spill.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hushql.config import Config
from hushql.functions import hashing as H


@dataclass(frozen=True)
class Family:
    """An aggregate's contributions, shared by all aggregates that need the same: rows, value, sum, distinct or histogram."""

    kind: str
    arg: str = ""
    type: str = ""
    aid: int = 0
    bin: int = 1


@dataclass
class Spec:
    """``base`` columns: labels l0.., identifiers a0.., and the families' arguments."""

    base: DataFrame
    label_types: list[str]
    aid_types: list[str]
    families: list[Family]
    config: Config
    sql_seed: int = 0
    base_labels: tuple[int, ...] = ()
    filtered: bool = True
    legs: list[tuple[str, str]] = field(default_factory=list)

    @property
    def labels(self) -> list[str]:
        return [f"l{i}" for i in range(len(self.label_types))]

    @property
    def keys(self) -> list[str]:
        return [*self.labels, "star"]


def same(left: DataFrame, right: DataFrame, columns: list[str]) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & left[c].eqNullSafe(right[c])
    return out


def joined(left: DataFrame, right: DataFrame, columns: list[str], how: str = "inner") -> DataFrame:
    """Null-safe join on equally named columns; the left ones stay."""
    renamed = right.select([F.col(c).alias(f"{c}__r") if c in columns else F.col(c) for c in right.columns])
    cond = F.lit(True)
    for c in columns:
        cond = cond & F.col(c).eqNullSafe(F.col(f"{c}__r"))
    return left.join(renamed, cond, how).drop(*[f"{c}__r" for c in columns])


def instances(spec: Spec, columns: list[str]) -> DataFrame:
    """Rows by identifier instance, without those whose identifiers are all null."""
    n = len(spec.aid_types)
    rows = spec.base.where(F.coalesce(*[F.col(f"a{i}").cast("string") for i in range(n)]).isNotNull()) if n > 1 else spec.base.where("a0 is not null")
    if n == 1:
        return rows.select(*columns, F.lit(0).alias("inst"), F.col("a0").alias("aid"))
    each = F.array(*[F.struct(F.lit(i).alias("inst"), F.col(f"a{i}").cast("string").alias("aid")) for i in range(n)])
    return rows.select(*columns, F.explode(each).alias("x_")).select(*columns, "x_.inst", "x_.aid")


def hashed(rows: DataFrame, spec: Spec) -> DataFrame:
    """Rows with the hash of their identifier; where no result depends on seeds, any hash breaks ties as well."""
    if spec.config.exact:
        return rows.withColumn("h", F.when(F.col("aid").isNotNull(), F.xxhash64("aid")))
    return H.with_aid_hash(rows, "h", spec.aid_types)


def contributions(spec: Spec) -> DataFrame:
    """(labels, inst, aid, h, one column for each leg): null where the identifier doesn't contribute to the leg."""
    sums = []
    for i, f in enumerate(spec.families):
        x = F.col(f.arg) if f.arg else None
        if f.kind == "rows":
            spec.legs.append((f"f{i}", f"f{i}"))
            sums.append(F.count("*").cast("double").alias(f"f{i}"))
        elif f.kind == "value":
            spec.legs.append((f"f{i}", f"f{i}"))
            sums.append(F.count(x).cast("double").alias(f"f{i}"))
        elif f.kind == "sum":
            spec.legs += [(f"f{i}p", f"f{i}p"), (f"f{i}n", f"f{i}n")]
            sums += [F.sum(F.when(x >= 0, x.cast("double"))).alias(f"f{i}p"), F.sum(F.when(x <= 0, -x.cast("double"))).alias(f"f{i}n")]
    args = list(dict.fromkeys(f.arg for f in spec.families if f.arg and f.kind in ("value", "sum")))
    return hashed(instances(spec, [*spec.labels, *args]).groupBy(*spec.labels, "inst", "aid").agg(*sums or [F.count("*").alias("f")]), spec)


def summed(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The same relation under new keys."""
    values = [c for c in rows.columns if c not in (*keys, "inst", "aid", "h")]
    return rows.groupBy(*keys, "inst", "aid").agg(F.first("h").alias("h"), *[F.sum(c).alias(c) for c in values])


def low_count(rows: DataFrame, keys: list[str], spec: Spec) -> DataFrame:
    """(keys, low): whether any identifier instance has fewer entities than its noisy threshold."""
    # Contributions are never negative. To look at them keeps their columns, so that this reads the very shuffle that the sums read.
    looked = " or ".join(f"{c} <=> -1D" for c in rows.columns if c not in (*keys, "inst", "aid", "h"))
    seen = rows.groupBy(*keys, "inst").agg(F.expr(f"count(if({looked}, null, aid)) as n"), F.bit_xor("h").alias("seed"))
    enough = F.expr(f"n >= {H.threshold('coalesce(seed, 0L)', spec.config)}")
    if len(spec.aid_types) == 1:
        return seen.select(*keys, (~enough).alias("low"))
    return seen.groupBy(*keys).agg((F.sum(enough.cast("int")) < len(spec.aid_types)).alias("low"))


def led_routes(groups: DataFrame, labels: list[str]) -> DataFrame:
    """(s_labels, labels): where the rows of low groups go that one column isolates while another tells nothing."""
    known, unknown, targets = [], F.lit(0), []
    for c in labels:
        others = Window.partitionBy(*[x for x in labels if x != c])
        groups = groups.withColumn(f"n_{c}", F.count("*").over(others)).withColumn(f"p_{c}", F.max(F.when(~F.col("low"), F.struct(F.col(c).alias("v")))).over(others))
        isolating = (F.col(f"n_{c}") == 2) & F.col(f"p_{c}").isNotNull()
        known.append(isolating)
        unknown = unknown + (F.col(f"n_{c}") == 1).cast("int")
        moved = F.struct(*[(F.col(f"p_{c}.v") if x == c else F.col(x)).alias(x) for x in labels])
        targets.append(F.when(isolating, moved))
    merged = groups.where(F.col("low") & (unknown > 0) & (sum((k.cast("int") for k in known), F.lit(0)) > 0))
    to = merged.select(*[F.col(x).alias(f"s_{x}") for x in labels], F.explode(F.filter(F.array(*targets), lambda t: t.isNotNull())).alias("t_"))
    return to.select(*[f"s_{x}" for x in labels], *[F.col(f"t_.{x}").alias(x) for x in labels])


def rerouted(rows: DataFrame, routes: DataFrame, labels: list[str]) -> DataFrame:
    """Rows of the routed groups under each of their targets, all others as they are."""
    back = routes.select([F.col(f"s_{x}").alias(x) for x in labels] + [F.col(x).alias(f"t_{x}") for x in labels])
    out = joined(rows, back.withColumn("hit_", F.lit(True)), labels, "left")
    moved = [F.when(F.col("hit_"), F.col(f"t_{x}")).otherwise(F.col(x)).alias(x) for x in labels]
    return out.select(*moved, *[c for c in rows.columns if c not in labels])


class Routing:
    """Where each group's rows end: its own group, the groups it is merged into, or the suppress bin."""

    def __init__(self, spec: Spec, rows: DataFrame):
        self.spec, self.labels = spec, spec.labels
        groups = low_count(rows, self.labels, spec)
        self.led = None
        if len(self.labels) > 2:
            self.led = led_routes(groups, self.labels)
            rows = summed(rerouted(rows, self.led, self.labels), self.labels)
            groups = low_count(rows, self.labels, spec)
        self.groups, self.rows = groups, rows

    def keyed(self, rows: DataFrame) -> DataFrame:
        """Rows with keys in place of labels; re-keyed rows of one identifier may repeat."""
        out = joined(rows, self.groups, self.labels)
        return self._binned(out)

    def _binned(self, rows: DataFrame) -> DataFrame:
        config = self.spec.config
        if not config.compute_suppress_bin:
            rows = rows.where(~F.col("low"))
        keys = []
        for x, kind in zip(self.labels, self.spec.label_types):
            in_bin = F.lit(config.text_label_for_suppress_bin if kind.startswith(("string", "varchar", "char")) else None)
            keys.append(F.when(F.col("low"), in_bin.cast(kind)).otherwise(F.col(x)).alias(x))
        return rows.select(*keys, F.col("low").alias("star"), *[c for c in rows.columns if c not in (*self.labels, "low")])

    def everywhere(self, rows: DataFrame) -> DataFrame:
        """As ``keyed``, for rows that don't yet stand under the merged groups."""
        return self.keyed(rerouted(rows, self.led, self.labels) if self.led is not None else rows)

    def final(self) -> tuple[DataFrame, DataFrame]:
        """Contributions by key, and the keys that are emitted: the bin only if it merges two groups and passes itself."""
        spec, keyed = self.spec, self.keyed(self.rows)
        plain = keyed.where(~F.col("star"))
        if not spec.config.compute_suppress_bin:
            return plain, self._binned(self.groups).select(*spec.keys)
        bin_rows = summed(keyed.where("star"), spec.keys)
        counted = self.groups.where("low").agg(F.count("*").alias("merged_")).where("merged_ > 1")
        bin_key = low_count(bin_rows, spec.keys, spec).where(~F.col("low")).select(*spec.keys).join(F.broadcast(counted), how="left_semi")
        keys = self._binned(self.groups.where(~F.col("low"))).select(*spec.keys).union(bin_key)
        return plain.unionByName(bin_rows), keys


def grouped(rows: DataFrame, spec: Spec) -> DataFrame:
    """Rows with their keys as one struct ``g``: never null itself, it joins and is dealt out as it is grouped."""
    return rows.select(F.struct(*spec.keys).alias("g"), *[c for c in rows.columns if c not in spec.keys])


def bucket_seed(spec: Spec) -> str:
    """SQL over ``g``: what all of a group's noise is seeded with."""
    own = f"{H.signed(spec.sql_seed)}L"
    hashes = [H.label_hash(f"g.{x}", t) for x, t in zip(spec.labels, spec.label_types)] + [f"{H.signed(b)}L" for b in spec.base_labels]
    if spec.config.exact or not hashes:
        return "0L" if spec.config.exact else own
    return f"aggregate(array_distinct(cast(array({', '.join(hashes)}) as array<bigint>)), {own}, (a, b) -> a ^ b)"


def summable(legs: DataFrame, spec: Spec) -> DataFrame:
    """(g, inst, leg, s): flattened sum, flattening and noise of one leg for one identifier instance.

    ``legs`` has (g, inst, leg, h, c), h null for contributions that no identifier accounts for.
    """
    c, keys = spec.config, ["g", "inst", "leg"]
    added = lambda known: F.coalesce(F.sum(F.when(known, F.col("c"))), F.lit(0.0))
    totals = legs.groupBy(*keys).agg(
        F.count("h").alias("n"),
        added(F.col("h").isNotNull()).alias("total"),
        added(F.col("h").isNull()).alias("unacc"),
        F.coalesce(F.bit_xor("h"), F.lit(0)).alias("aid_seed"),
    )
    most = c.outlier_count_max + c.top_count_max
    # Contributions without identifier come last; a filter on them here would reach the scan and read it once more.
    order = Window.partitionBy(*keys).orderBy(F.col("h").isNull(), F.desc("c"), F.desc(F.expr("h ^ shiftleft(1L, 63)")))
    top = legs.withColumn("r", F.row_number().over(order)).where((F.col("r") <= most) & F.col("h").isNotNull())
    top = top.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", "c", "h"))).alias("top"))
    omin, omax, tmin, tmax = c.outlier_count_min, c.outlier_count_max, c.top_count_min, c.top_count_max
    rows = totals.join(top, keys).where(f"n >= {omin + tmin}")
    o_range, t_range = omax - omin, tmax - tmin
    o_cut = f"case when adj div 2 > {o_range} then {o_range} when adj - adj div 2 > {t_range} then adj - {t_range} else adj div 2 end"
    if c.exact or (omin == omax and tmin == tmax):
        drawn = [f"{omin} AS n_out", f"{tmin} AS n_top"]
    else:
        flat_seed = "aggregate(slice(top, 1, o + t), 0L, (a, x) -> a ^ x.h) AS flat_seed"
        out, tops = H.uniform("flat_seed", c.salt, "outlier", str(omin), "o"), H.uniform("flat_seed", c.salt, "top", str(tmin), "t")
        drawn = [flat_seed, f"{out} AS n_out", f"{tops} AS n_top"]
    noise = "0D"
    if c.noise_layer_sd:
        noise = f"{H.normal(bucket_seed(spec), c.salt, 'noise', 'sd')} + {H.normal('aid_seed', c.salt, 'noise', 'sd')}"
    add = "0D, (a, x) -> a + x.c"
    return rows.selectExpr(
        *keys, "n", "total", "unacc", "aid_seed", "top",
        f"greatest(0, {omax + tmax} - n) AS adj", f"cast({o_cut} as int) AS o_cut", f"{omax} - o_cut AS o", f"{tmax} - cast(adj - o_cut as int) AS t", *drawn,
        f"aggregate(slice(top, 1, n_out), {add}) AS outliers", f"aggregate(slice(top, n_out + 1, n_top), {add}) / n_top AS top_avg",
        "greatest(outliers - top_avg * n_out, 0D) AS flat", "total - flat AS kept", f"{float(c.noise_layer_sd)!r}D * greatest(kept / n, 0.5D * top_avg) AS sd", f"{noise} AS noise",
    ).selectExpr(*keys, "named_struct('flat', flat, 'sum', kept + greatest(unacc - flat, 0D), 'sd', sd, 'size', abs(noise), 'noise', noise) AS s")


def pivoted(legs: DataFrame, spec: Spec, names: list[str]) -> DataFrame:
    """(g, one struct column for each leg and instance)."""
    at = [(name, i) for name in names for i in range(len(spec.aid_types))]
    own = [F.max(F.when((F.col("leg") == name) & (F.col("inst") == i), F.col("s"))).alias(f"{name}_{i}") for name, i in at]
    return summable(legs, spec).groupBy("g").agg(*own)


def melted(rows: DataFrame, spec: Spec) -> DataFrame | None:
    """(g, inst, leg, h, c): the contributions by leg."""
    if not spec.legs:
        return None
    each = F.array(*[F.struct(F.lit(name).alias("leg"), F.col(column).alias("c")) for name, column in spec.legs])
    rows = grouped(rows, spec).select("g", "inst", "h", F.explode(each).alias("x_"))
    return rows.select("g", "inst", F.col("x_.leg").alias("leg"), "h", F.col("x_.c").alias("c")).where("c is not null")


def across(name: str, spec: Spec, zero: bool = True) -> tuple[str, str, str]:
    """SQL over the instances of a leg: flattened sum by the largest flattening, noise and its SD by the largest SD."""
    parts = [f"{name}_{i}" for i in range(len(spec.aid_types))]
    sums = ", ".join([*(f"if({p} is null, null, named_struct('flat', {p}.flat, 'sum', {p}.sum))" for p in parts), "named_struct('flat', 0D, 'sum', 0D)"])
    noises = [f"if({p} is null, null, named_struct('sd', {p}.sd, 'size', {p}.size, 'noise', {p}.noise))" for p in parts]
    sds = ", ".join([*noises, "named_struct('sd', 0D, 'size', 0D, 'noise', 0D)"])
    return f"array_max(array({sums})).sum", f"array_max(array({sds})).noise", f"array_max(array({sds})).sd"


def lacking(name: str, spec: Spec) -> str:
    return "(" + " or ".join(f"{name}_{i} is null" for i in range(len(spec.aid_types))) + ")"


def _greedy(spec_keys: list[str], n_inst: int, leg: str):
    """Low-count values given to identifiers in turn: fewest values first, each takes its last free value."""

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        out = []
        for inst in range(n_inst):
            part = frame[(frame["inst"] == inst) & frame["h"].notna()]
            by: dict[int, list] = {}
            for value, h in sorted(zip(part["v"], part["h"].astype("int64")), key=lambda x: x[0]):
                by.setdefault(int(h) & H.MASK, []).append(value)
            order = sorted(by, key=lambda a: (len(by[a]), a))
            left, used, given = len(set(part["v"])), set(), dict.fromkeys(order, 0)
            while left:
                for a in order:
                    values = by[a]
                    while values and values[-1] in used:
                        values.pop()
                    if values:
                        used.add(values.pop())
                        given[a] += 1
                        left -= 1
                    if not left:
                        break
            out += [(inst, leg, H.signed(a), float(n)) for a, n in given.items() if n]
        made = pd.DataFrame(out, columns=["inst", "leg", "h", "c"])
        for k in reversed(spec_keys):
            made.insert(0, k, pd.Series([frame[k].iloc[0]] * len(made), dtype=frame[k].dtype))
        return made

    return assign


def assigned(low: DataFrame, spec: Spec, leg: str) -> DataFrame:
    """Contributions of identifiers from rows (keys, inst, v, h) of low values, each value given to one identifier.

    Identifiers and values that reach each other are settled on their own. Where an identifier shares no value, it gets all
    that it has; where a value's identifiers have no other, the least of them gets it. Both are counts. Only identifiers
    of several values that share some go through the turns, in Python.
    """
    rows = low.select(F.struct(*spec.keys, "inst").alias("k"), "v", "h")
    rows = rows.join(rows.groupBy("k", "h").agg(F.count("*").alias("n_values")), ["k", "h"])
    least = F.min(F.struct(F.expr("h ^ shiftleft(1L, 63)"), "h"))["h"]
    values = rows.groupBy("k", "v").agg(F.count("*").alias("n_aids"), F.max("n_values").alias("most_values"), least.alias("least"))
    rows = rows.join(values, ["k", "v"])
    shares = rows.groupBy("k", "h").agg(F.max("n_aids").alias("most_aids"), F.count("*").cast("double").alias("c"))
    made = lambda x, h, c: x.select("k.*", F.lit(leg).alias("leg"), F.col(h).alias("h"), c.alias("c"))
    alone = made(shares.where("most_aids = 1"), "h", F.col("c"))
    single = made(values.where("n_aids > 1 and most_values = 1"), "least", F.lit(1.0))
    rest = rows.where("most_values > 1").join(shares.where("most_aids > 1").select("k", "h"), ["k", "h"])
    schema = ", ".join([*(f"{k} {t}" for k, t in zip(spec.labels, spec.label_types)), "star boolean", "inst int", "leg string", "h bigint", "c double"])
    turns = rest.select("k.*", "v", "h").groupBy(*spec.keys).applyInPandas(_greedy(spec.keys, len(spec.aid_types), leg), schema)
    return alone.unionByName(single).unionByName(turns)


def distinct_values(i: int, f: Family, spec: Spec, routing: Routing | None) -> tuple[DataFrame, DataFrame]:
    """Counts of values that enough entities have, and contributions from the others.

    Where the counted column is the only identifier each low value has one identifier, so nothing needs assigning.
    """
    rows = instances(spec, [*spec.labels, f.arg]).where(F.col(f.arg).isNotNull()).withColumnRenamed(f.arg, "v").distinct()
    rows = hashed(routing.everywhere(rows) if routing else rows.withColumn("star", F.lit(False)), spec).select(*spec.keys, "v", "inst", "aid", "h").distinct()
    c = spec.config
    per = rows.groupBy(*spec.keys, "v", "inst").agg(F.count("h").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("seed"))
    good = F.expr(f"n >= {c.low_count_min_threshold} and n >= {H.threshold('seed', c)}").cast("int")
    values = per.groupBy(*spec.keys, "v").agg((F.sum(good) == len(spec.aid_types)).alias("high"))
    high = values.where("high").groupBy(*spec.keys).agg(F.count("*").alias(f"hc{i}"))
    low = joined(rows, values.where(~F.col("high")).drop("high"), [*spec.keys, "v"])
    own = len(spec.aid_types) == 1 and f.aid == 0 and f.bin == 0
    if own:
        return high, low.groupBy(*spec.keys, "inst", "h").agg(F.lit(1.0).alias("c")).select(*spec.keys, "inst", F.lit(f"f{i}").alias("leg"), "h", "c")
    return high, assigned(low.where("h is not null").select(*spec.keys, "inst", "v", "h"), spec, f"f{i}")


def histogram(i: int, f: Family, spec: Spec, routing: Routing | None) -> DataFrame:
    """(keys, histogram): bins of rows per entity, those of too few entities in one bin without label."""
    c, n = spec.config, len(spec.aid_types)
    counted = F.col(f"a{f.aid}").cast("string").alias("who")
    base = spec.base.select("*", counted).where("who is not null")
    inner = Spec(base, spec.label_types, spec.aid_types, [], c, spec.sql_seed, spec.base_labels)
    n_rows = base.groupBy(*spec.labels, "who").agg(F.count("*").alias("n_rows"))
    n_rows = (routing.everywhere(n_rows) if routing else n_rows.withColumn("star", F.lit(False))).groupBy(*spec.keys, "who").agg(F.sum("n_rows").alias("n_rows"))
    pairs = instances(inner, [*spec.labels, "who"]).distinct()
    pairs = (routing.everywhere(pairs) if routing else pairs.withColumn("star", F.lit(False))).distinct()
    pairs = hashed(pairs, spec)
    rows = joined(pairs, n_rows.withColumn("bin", F.expr(f"n_rows div {f.bin} * {f.bin}")).drop("n_rows"), [*spec.keys, "who"])

    def bins(at: list[str], source: DataFrame) -> DataFrame:
        seen = source.select(*at, "inst", "aid", "h").distinct().groupBy(*at, "inst").agg(F.count("aid").alias("n"), F.coalesce(F.bit_xor("h"), F.lit(0)).alias("seed"))
        enough = F.expr(f"n >= {H.threshold('seed', c)}").cast("int")
        own = lambda name: F.max(F.when(F.col("inst") == f.aid, F.col(name))).alias(name)
        return seen.groupBy(*at).agg((F.sum(enough) == n).alias("high"), own("n"), own("seed"))

    sd = f"{float(c.noise_layer_sd)!r}D"
    noise = "0D"
    if c.noise_layer_sd:
        noise = f"{H.normal('group_seed', c.salt, 'count_histogram', sd)} + {H.normal('seed', c.salt, 'count_histogram', sd)}"
    seeded = lambda x: x.withColumn("g", F.struct(*spec.keys)).withColumn("group_seed", F.expr(bucket_seed(spec)))
    size = F.expr(f"greatest(cast(round(n + {noise}) as bigint), {c.low_count_min_threshold}L)")
    each = bins([*spec.keys, "bin"], rows)
    high = seeded(each.where("high")).select(*spec.keys, "bin", size.alias("size"))
    low = each.where(~F.col("high")).drop("high", "n", "seed")
    merged = joined(rows, low, [*spec.keys, "bin"])
    several = joined(bins(spec.keys, merged), low.groupBy(*spec.keys).agg(F.count("*").alias("n_bins")), spec.keys)
    bin_ = seeded(several.where("high and n_bins > 1")).select(*spec.keys, F.lit(None).cast("bigint").alias("bin"), size.alias("size"))
    all_ = high.unionByName(bin_)
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col("bin").isNotNull().alias("k"), "bin", "size"))), lambda x: F.array(x["bin"], x["size"]))
    return all_.groupBy(*spec.keys).agg(listed.alias(f"h{i}"))


def run(spec: Spec) -> DataFrame:
    """(labels, star, and for each family its value v<i> and noise s<i>)."""
    rows = contributions(spec)
    routing = None
    if spec.filtered:
        routing = Routing(spec, rows)
        rows, keys = routing.final()
    else:
        rows = rows.withColumn("star", F.lit(False))
        keys = spec.base.sparkSession.range(1).select(F.lit(False).alias("star"))
    legs, names, extra = melted(rows, spec), [name for name, _ in spec.legs], []
    for i, f in enumerate(spec.families):
        if f.kind == "distinct":
            high, low = distinct_values(i, f, spec, routing)
            low = grouped(low, spec)
            legs, names = low if legs is None else legs.unionByName(low), [*names, f"f{i}"]
            extra.append(high)
        elif f.kind == "histogram":
            extra.append(histogram(i, f, spec, routing))
    parts = [*([pivoted(legs, spec, names)] if legs is not None else []), *(grouped(part, spec) for part in extra)]
    out = keys.select("*", F.struct(*spec.keys).alias("g"))
    for part in parts:
        out = out.join(part, "g", "left")
    floor = spec.config.low_count_min_threshold if spec.filtered else 0
    made = [*spec.labels, "star"]
    for i, f in enumerate(spec.families):
        if f.kind == "histogram":
            made.append(F.coalesce(F.col(f"h{i}"), F.expr("cast(array() as array<array<bigint>>)")).alias(f"v{i}"))
            continue
        if f.kind == "sum":
            (ps, pn, pd_), (ns, nn, nd) = across(f"f{i}p", spec), across(f"f{i}n", spec)
            null = " or ".join(f"(f{i}p_{k} is null and f{i}n_{k} is null)" for k in range(len(spec.aid_types)))
            value, to = f"(({ps}) + ({pn})) - (({ns}) + ({nn}))", {"tinyint": "bigint", "smallint": "bigint", "int": "bigint", "bigint": "decimal(38,0)"}.get(f.type, f.type)
            value = f"round({value})" if to in ("bigint", "decimal(38,0)") else value
            made.append(F.expr(f"if({null}, null, cast({value} as {to}))").alias(f"v{i}"))
            p, n = H.reported_sd(pd_), H.reported_sd(nd)
            made.append(F.when(F.expr(null), None).otherwise(F.sqrt(p * p + n * n)).alias(f"s{i}"))
            continue
        s, n, sd = across(f"f{i}", spec)
        lack = lacking(f"f{i}", spec)
        if f.kind == "distinct":
            value = f"greatest(coalesce(hc{i}, 0L) + if({lack}, 0L, cast(round({s} + {n}) as bigint)), {floor}L)"
            made.append(F.expr(value).alias(f"v{i}"))
            made.append(F.when(F.expr(f"{lack} and coalesce(hc{i}, 0L) = 0"), None).when(F.expr(lack), F.lit(0.0)).otherwise(H.reported_sd(sd)).alias(f"s{i}"))
        else:
            made.append(F.expr(f"if({lack}, {floor}L, greatest(cast(round({s} + {n}) as bigint), {floor}L))").alias(f"v{i}"))
            made.append(F.when(F.expr(lack), None).otherwise(H.reported_sd(sd)).alias(f"s{i}"))
    return out.select(*made)


def plain_histogram(df: DataFrame, by: list[str], column: str, bin_size: int = 1) -> DataFrame:
    """Ordinary histogram of rows per value of a column, for direct access; values that are null are left out."""
    if bin_size is None or bin_size < 1:
        raise ValueError("bin_size must be a positive number")
    per = df.where(F.col(column).isNotNull()).groupBy(*by, column).agg(F.count("*").alias("n_"))
    bins = per.groupBy(*by, F.expr(f"n_ div {int(bin_size)} * {int(bin_size)}").alias("bin_")).agg(F.count("*").alias("size_"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("bin_", "size_"))), lambda x: F.array(x["bin_"], x["size_"]))
    return bins.groupBy(*by).agg(listed.alias("histogram"))
